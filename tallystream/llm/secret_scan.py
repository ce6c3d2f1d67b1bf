"""Secret scans: three base patterns, and high-entropy strings by a sliding window.

A candidate string (CANDIDATE: at least WINDOW characters of a token alphabet, with a letter
and a digit) gets a class (hex, upper or mixed). A window of WINDOW characters slides over
it; the count of each character and the sum of count * log2(count) change by the character
that enters and the one that leaves, and the largest window entropy is held against the
class's threshold. The allow list (ALLOWED) suppresses identifiers that look random but
aren't secret, and candidates inside a base span aren't reported twice; base spans always
stay.

Positions are code points, end exclusive. Matches of a kind are leftmost and don't overlap;
a match that fails its length still uses up its characters.

Defined results: NULL texts are empty and give no spans; equal rows give equal rows; an
empty table gives none. Columns of any other name are carried; scan replaces base_spans and
secret_spans, redact keeps a user's columns of these names. Texts are scanned whole, in time
linear in their length and their number of candidates. Column functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, fresh, let, plain, walk

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a shorter run holds no longer match either
HEX = r"[0-9a-f]{32,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
_TOKEN = "A-Za-z0-9+/_=-"
CANDIDATE = rf"(?<![{_TOKEN}])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[{_TOKEN}]{{{WINDOW},}}"
#: Bits a character, by class.
THRESHOLDS = {"hex": 3.0, "upper": 3.4, "mixed": 3.6}
ALLOWED = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUIDs
    SLUG := r"^([A-Za-z]+|[0-9]+)([-_/=+]+([A-Za-z]+|[0-9]+))*[-_/=+]*$",  # paths and dates of plain words and numbers
    r"(?i)example|sample|placeholder|dummy|changeme|xxxx",
    r"^(sha(1|256|384|512)-|sha(1|256|384|512)=)",  # published checksums
]
SPAN, FOUND = "struct<start:int,kind:int,end:int>", "struct<start:int,kind:int,end:int,value:string>"
OPEN = 3  # the kind of candidates


def _spans(text: Column, pattern: str, kind: int, value: int = 0, least: int = 0) -> Column:
    """Spans of a pattern's matches whose group value has at least so many characters; each with its match as value."""
    found, values, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(value)), F.split(text, pattern, -1)
    each = F.filter(F.arrays_zip(between.alias("b"), found.alias("m"), values.alias("v")), lambda x: x["m"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["b"])
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), (x["m"] if kind == OPEN else F.lit(None).cast("string")).alias("value"))
        return end, F.when(F.length(x["v"]) >= least, span)

    return F.when(F.rlike(text, F.lit(pattern)), walk(each, F.lit(0), step, FOUND)).otherwise(F.array().cast(f"array<{FOUND}>"))


def window_entropy(s: Column, width: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, over windows of a string of ALPHABET characters; of the whole string if it is shorter.

    One fold over the characters carries the counts, the window's characters and the sum of count * log2(count).
    """
    term = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(width + 2)])
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    init = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.array_repeat(F.lit(-1), width).alias("ring"), F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))

    def step(a: Column, new: Column) -> Column:
        slot = a["i"] % width
        old = F.get(a["ring"], slot)
        cn, co = F.get(a["n"], new), F.get(a["n"], F.greatest(old, F.lit(0)))
        gone = F.when(old >= 0, F.get(term, F.greatest(co - 1, F.lit(0))) - F.get(term, co)).otherwise(F.lit(0.0))
        total = F.when(new == old, a["sum"]).otherwise(a["sum"] + F.get(term, cn + 1) - F.get(term, cn) + gone)
        counts = F.when(new == old, a["n"]).otherwise(F.transform(a["n"], lambda c, k: c + (k == new).cast("int") - (k == old).cast("int")))
        best = F.when(a["i"] + 1 >= width, F.greatest(a["best"], F.lit(math.log2(width)) - total / width)).otherwise(a["best"])
        return F.struct(counts.alias("n"), F.transform(a["ring"], lambda c, k: F.when(k == slot, new).otherwise(c)).alias("ring"), (a["i"] + 1).alias("i"), total.alias("sum"), best.alias("best"))

    def done(a: Column) -> Column:
        return F.when(a["i"] == 0, F.lit(0.0)).when(a["i"] < width, F.log2(a["i"].cast("double")) - a["sum"] / a["i"]).otherwise(a["best"])

    return F.when(F.length(s) > 0, F.aggregate(codes, init, step, done)).otherwise(F.lit(0.0))


def _is_slug(s: Column) -> Column:
    """SLUG for a string of ALPHABET: a letter or digit first, and no letter beside a digit. A repeated group would take a stack frame for each part."""
    return F.rlike(s, F.lit("^[A-Za-z0-9]")) & ~F.rlike(s, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"))


def is_secret_like(s: Column) -> Column:
    """True if a candidate isn't allowed and its best window reaches its class's threshold."""
    least = F.when(F.rlike(s, F.lit("^[0-9a-fA-F]+$")), THRESHOLDS["hex"]).when(F.rlike(s, F.lit("^[A-Z0-9]+$")), THRESHOLDS["upper"]).otherwise(THRESHOLDS["mixed"])
    allowed = F.lit(False)
    for p in ALLOWED:
        allowed = allowed | (_is_slug(s) if p == SLUG else F.rlike(s, F.lit(p)))
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(s) >= least)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base_spans and secret_spans (base ones and those by entropy), arrays of (start, kind, end) ordered by start, then kind.

    Columns of docs with these names are replaced, the text among them only after it is read; no other name is used up.
    """
    rest = [c for c in docs.columns if c not in ("base_spans", "secret_spans")]
    own, more = fresh(docs, "base_spans_"), fresh(docs, "open_")
    t = plain(f"`{text}`")
    base = F.array_sort(F.concat(_spans(t, ASSIGN, 0, 2, 8), _spans(t, ACCESS, 1), _spans(t, HEX, 2)))
    staged = docs.select(*[F.col(f"`{c}`") for c in rest], base.alias(own), _spans(t, CANDIDATE, OPEN).alias(more))
    span = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))

    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        """reach is the largest end of base spans so far: a candidate that ends by then is inside one."""
        shown = F.when(x["kind"] < OPEN, F.lit(True)).when(x["end"] <= reach, F.lit(False)).otherwise(is_secret_like(x["value"]))
        return F.when(x["kind"] < OPEN, F.greatest(reach, x["end"])).otherwise(reach), F.when(shown, span(x))

    bare = F.transform(F.col(own), span)
    every = F.when(F.size(more) > 0, walk(F.array_sort(F.concat(own, more)), F.lit(-1), step, SPAN)).otherwise(bare)
    return staged.select(*[F.col(f"`{c}`") for c in rest], bare.alias("base_spans"), every.alias("secret_spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same columns, with each stretch covered by spans replaced by mark. A NULL text stays NULL.

    Overlapping spans, and those that touch an earlier one's inside, share a mark. The text is cut once for each CHUNK
    spans, then each cut by its own, so many spans in a long text don't each read it whole.
    """
    names = docs.columns
    spans = fresh(docs, "spans_")
    pair = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(raw := fresh(docs, "raw_")))
    found = scan(pair.select(raw, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")), raw).select(raw, "row", F.col("secret_spans").alias(spans))
    t = plain(f"`{raw}`")
    kind = "struct<start:int,end:int>"

    def merge(a: Column, x: Column) -> tuple[Column, Column]:
        """A span that begins inside what is covered gives only what it adds, without another mark."""
        return F.greatest(a, x["end"]), F.when(x["end"] > a, F.struct(F.when(x["start"] < a, a).otherwise(x["start"]).alias("start"), F.when(x["start"] < a, -x["end"]).otherwise(x["end"]).alias("end")))

    def cut(a: Column, x: Column) -> Column:
        end = F.abs(x["end"])
        gap = F.substring(a["text"], a["at"] - a["base"] + 1, x["start"] - a["at"])
        return F.struct(end.alias("at"), a["base"].alias("base"), a["text"].alias("text"), F.concat(a["out"], gap, F.when(x["end"] < 0, F.lit("")).otherwise(F.lit(mark))).alias("out"))

    def piece(whole: Column, c: Column, begin: Column) -> Column:
        last = F.abs(F.element_at(c, -1)["end"])
        return F.aggregate(c, F.struct(begin.alias("at"), begin.alias("base"), F.substring(whole, begin + 1, last - begin).alias("text"), F.lit("").alias("out")), cut, lambda a: a["out"])

    def pieces(whole: Column, all_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int"))
        begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.abs(F.get(all_, F.greatest(k * CHUNK - 1, F.lit(0)))["end"]))
        cuts = F.transform(starts, lambda k: piece(whole, F.slice(all_, k * CHUNK + 1, F.lit(CHUNK)), begin(k)))
        return F.concat(F.array_join(cuts, ""), F.substring(whole, F.abs(F.element_at(all_, -1)["end"]) + 1, F.length(whole)))

    new = let(walk(F.col(spans), F.lit(0), merge, kind), lambda all_: let(t, lambda whole: pieces(whole, all_)))
    new = F.when(F.size(spans) > 0, new).otherwise(F.col(raw))
    return found.select(*[new.alias(text) if c == text else F.col(f"row.`{c}`") for c in names])
