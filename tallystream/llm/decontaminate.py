"""Benchmark decontamination by template windows.

Words lose surrounding punctuation and become canonical: numbers (digits or number words)
<num>, units <unit>, a number with its unit <num><unit>, capitalised words <name>, others
their lower case; a second form keeps names as lower-case words. A window is WINDOW canonical
words; a benchmark window counts only if at least LITERAL of its words are literal. Document
windows are first held against a bitmap of benchmark windows of fixed size, then joined by
hash, whatever the size of the benchmark. An item of fewer than WINDOW canonical words has one
window, of all its words; documents then have windows of that length too. For each pair of
document and item the slots' values are compared: a value of the item must always stand for
the same value in the document and the other way round (CONSISTENT of the slots in matched
windows, in the worse direction), which verbatim copies and re-parameterised ones do and
chance matches don't.

Consistency is that of the whole document or of one occurrence in it, so several variants of an
item on one page don't hide each other. Occurrences are the matched windows at one aligned
start (document position less item position), and those met in order of the text until the item
begins anew (copies with words put in or left out).

A pair is reported if at least ENOUGH distinct windows of the item match, or all of a shorter
item's, consistently in the whole document or in one occurrence. Its figures are the whole
document's if these are consistent, otherwise those of its most consistent (then longest) occurrence.

Defined results: NULL texts, and items with fewer than LITERAL literal words in each of their
windows, match nothing; repeated documents add to one pair; items with the same text each make
a pair; pairs with a NULL doc_id are reported under NULL; empty tables give none. Columns of
any name are carried. Whole texts are read; only slots of matched windows leave a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, plain

WINDOW, LITERAL, ENOUGH, CONSISTENT = 8, 3, 5, 0.8
BITMAP_BITS, SLICE_BYTES, FEW = 1 << 24, 1 << 20, 100_000
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km mi ft in yd mg g kg t lb lbs oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres dollar dollars cent cents euro euros percent degree degrees kwh kw w v hz khz mhz ghz kb mb gb tb mph kph".split())
_EDGE = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>«»“”‘’„…*_`~|/\\"
_NUMBER = re.compile(r"[+\-−]?[$€£]?\d[\d.,]*%?")
_JOINED = re.compile(r"([+\-−]?[$€£]?\d[\d.,]*)-?([A-Za-z]+)")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def canonical(word: str) -> tuple[str, str, str]:
    """(form with names replaced, form with names as words, slot kind and value or ''); empty forms for a word of punctuation."""
    w = word.strip(_EDGE)
    if not w:
        return "", "", ""
    low = w.lower()
    if _NUMBER.fullmatch(w) or low in NUMBER_WORDS:
        return "<num>", "<num>", "n" + low
    if (m := _JOINED.fullmatch(w)) and m[2].lower() in UNITS:
        return "<num><unit>", "<num><unit>", "j" + low
    if low in UNITS:
        return "<unit>", "<unit>", "u" + low
    if w[0].isupper():
        return "<name>", low, "p" + low
    return low, low, ""


def windows(texts: pa.Array, sizes: list[int], whole: bool = False) -> Iterator[tuple]:
    """For both forms and each size: (size, hashes, text index, word position, slots of the distinct words, distinct word at each place, place of each window).

    whole: windows of fewer than WINDOW words are only those that are all of a text.
    """
    lists = pc.ascii_split_whitespace(texts)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    enc = lists.flatten().dictionary_encode()
    forms = [canonical(w) for w in enc.dictionary.to_pylist()]
    ids = enc.indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), lengths)
    real = np.array([bool(f[0]) for f in forms], bool)
    if len(ids):
        on = real[ids]
        ids, doc = ids[on], doc[on]
    start = np.searchsorted(doc, np.arange(len(texts)))
    count = np.bincount(doc, minlength=len(texts)) if len(ids) else np.zeros(len(texts), np.int64)
    pos = np.arange(len(ids)) - start[doc] if len(ids) else ids
    literal = np.array([not f[2] for f in forms], bool)
    slots = [f[2] for f in forms]
    named = np.array([s[:1] == "p" for s in slots], bool)
    for form in (0, 1):
        if not len(ids):
            continue
        own = np.array([xxhash.xxh64_intdigest(f[form].encode(), 1 + form) for f in forms], np.uint64)[ids]
        plain_ = np.cumsum(np.r_[0, (literal | named if form else literal)[ids]])
        for size in sizes:
            n = len(ids) - size + 1
            if n <= 0:
                continue
            h = np.zeros(n, np.uint64)
            for k in range(size):
                h = h * _MULT + own[k : k + n]
            inside = (doc[:n] == doc[size - 1 :]) & (plain_[size:] - plain_[:-size] >= LITERAL)
            if whole and size < WINDOW:
                inside &= count[doc[:n]] == size
            at = np.flatnonzero(inside)
            h ^= h >> np.uint64(29)
            yield size, h[at], doc[at], pos[at], slots, ids, at


def _slots_of(slots: list[str], ids: np.ndarray, at: np.ndarray, size: int) -> list[list[str]]:
    """The slot values of windows, '' for literal words."""
    return [[slots[i] for i in ids[k : k + size].tolist()] for k in at.tolist()]


def _rows(df: DataFrame, key: str, text: str, bitmap: np.ndarray | None, sizes: list[int]) -> DataFrame:
    """(h, _key, pos, slots, src, size) of windows; only those in the bitmap, if there is one. src tells texts under one key apart."""
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(bitmap) if bitmap is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value if shared is not None else None
        for b in batches:
            rows = max(1, int(b.num_rows * SLICE_BYTES / max(1, b.nbytes)))
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                src = np.array([xxhash.xxh64_intdigest(t.as_buffer()) for t in part.column("_t")], np.uint64).view(np.int64)
                for size, h, doc, pos, slots, ids, at in windows(part.column("_t"), sizes, bits is None):
                    if bits is not None:
                        low = h & np.uint64(BITMAP_BITS - 1)
                        on = np.flatnonzero(bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                    else:
                        on = np.arange(len(h))
                    keys = part.column("_key").take(pa.array(doc[on]))
                    arrays = [pa.array(h[on].view(np.int64)), keys, pa.array(pos[on].astype(np.int32)), pa.array(_slots_of(slots, ids, at[on], size), pa.list_(pa.string())), pa.array(src[doc[on]]), pa.array(np.full(len(on), size, np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["h", "_key", "pos", "slots", "src", "size"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias("_key"), plain(f"`{text}`").alias("_t")).mapInArrow(run, f"h long, _key {kind}, pos int, slots array<string>, src long, size int")


def bitmap_of(item_windows: DataFrame) -> np.ndarray:
    """BITMAP_BITS / 8 bytes, whatever the number of windows: 64-bit words are or-ed on the executors."""
    low = F.col("h").bitwiseAND(F.lit(BITMAP_BITS - 1))
    words = item_windows.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (low % 64).cast("int"))).alias("b"))
    bits = np.zeros(BITMAP_BITS // 64, np.int64)
    found = words.toArrow()  # in one job, not in one for each partition
    bits[found["w"].to_numpy()] = found["b"].to_numpy()
    return bits.astype("<i8").view(np.uint8)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, enough: int = ENOUGH) -> DataFrame:
    """(key, item, n_windows, item_windows, coverage, consistency, verbatim) of each reported pair."""
    theirs = _rows(benchmark, item, item_text, None, [*range(LITERAL, WINDOW), size]).select("h", F.col("_key").alias("_item"), F.col("pos").alias("_pos"), F.col("slots").alias("_slots"), "size").distinct()
    about = theirs.agg(F.count(F.lit(1)).alias("n"), F.collect_set("size").alias("sizes")).first()  # at most WINDOW sizes
    theirs = theirs.drop("size")
    ours = _rows(docs, key, text, bitmap_of(theirs), sorted(about["sizes"])).select("h", "_key", F.col("src").alias("_src"), F.col("pos").alias("_at"), F.col("slots").alias("_seen"))
    right = theirs.withColumnRenamed("h", "_h")
    # A small benchmark is broadcast, so that a window in very many documents isn't one task's.
    met = ours.join(F.broadcast(right) if about["n"] <= FEW else right, F.col("h") == F.col("_h"))
    # Counts of each slot pair at each window of the item: both forms and repeated rows meet here.
    spots = met.groupBy("_key", "_src", "_item", "_at", "_pos", "_slots", "_seen").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("_key", "_src", "_item").orderBy("_at", "_pos")
    before, at_before = F.lag("_pos").over(run), F.lag("_at").over(run)
    spots = spots.withColumn("_new", ((F.col("_pos") < before) | (F.col("_pos") == before) & (F.col("_at") > at_before)).cast("int"))
    spots = spots.withColumn("_run", F.coalesce(F.sum("_new").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))
    occurrence = lambda kind, src, where: F.struct(F.lit(kind).alias("kind"), src.cast("long").alias("src"), where.cast("long").alias("where"))
    all_ = F.array(occurrence(0, F.lit(0), F.lit(0)), occurrence(1, F.col("_src"), F.col("_at") - F.col("_pos")), occurrence(2, F.col("_src"), F.col("_run")))
    spots = spots.withColumn("_o", F.explode(all_)).groupBy("_key", "_item", "_o", "_pos", "_slots", "_seen").agg(F.sum("n").alias("n"))
    pairs = F.filter(F.arrays_zip(F.col("_slots").alias("a"), F.col("_seen").alias("b")), lambda x: x["a"] != "")
    votes = spots.select("_key", "_item", "_o", "_pos", F.explode_outer(pairs).alias("p"), "n")
    votes = votes.groupBy("_key", "_item", "_o", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("n"), F.collect_set("_pos").alias("at"))
    # Each slot pair counts for its value in the item (side 0) and its value in the document (side 1).
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("v")), F.struct(F.lit(1).alias("side"), F.col("b").alias("v"))))
    by_value = votes.withColumn("s", sides).groupBy("_key", "_item", "_o", "s").agg(
        F.sum(F.when(F.col("a").isNotNull(), F.col("n")).otherwise(0)).alias("all"),
        F.max(F.when(F.col("a").isNotNull(), F.col("n")).otherwise(0)).alias("best"),
        F.sum(F.when(F.col("a") != F.col("b"), F.col("n")).otherwise(0)).alias("changed"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("s.side") == 0, F.col("at"))))).alias("at"),
    )
    mine = lambda c, side: F.sum(F.when(F.col("s.side") == side, F.col(c)).otherwise(0))
    per_part = by_value.groupBy("_key", "_item", "_o").agg(
        mine("all", 0).alias("all"), F.least(mine("best", 0), mine("best", 1)).alias("best"), mine("changed", 0).alias("changed"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_windows")
    )
    per_part = per_part.withColumn("consistency", F.when(F.col("all") > 0, F.col("best") / F.col("all")).otherwise(F.lit(1.0))).filter(F.col("consistency") >= CONSISTENT)
    lengths = theirs.groupBy(F.col("_item").alias("_i")).agg(F.countDistinct("_pos").alias("item_windows"))
    found = per_part.join(lengths, F.col("_item").eqNullSafe(F.col("_i"))).filter(F.col("n_windows") >= F.least(F.lit(enough), F.col("item_windows")))
    shown = F.struct((F.col("_o.kind") == 0).alias("whole"), "consistency", "n_windows", (F.col("changed") == 0).alias("verbatim"), "item_windows")
    return found.groupBy("_key", "_item").agg(F.max(shown).alias("m")).select(
        F.col("_key").alias(key), F.col("_item").alias(item), "m.n_windows", "m.item_windows", (F.col("m.n_windows") / F.col("m.item_windows")).alias("coverage"), "m.consistency", "m.verbatim",
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in no reported pair. Those without an id can't be told apart, and stay."""
    name = fresh(docs, "_k")
    bad = contaminated(docs, benchmark, key, text).select(F.col(f"`{key}`").alias(name)).distinct()
    return docs.join(bad, F.col(f"`{key}`") == F.col(name), "left_anti")
