"""Chat formatting with typed content parts.

A turn holds parts: text, image, audio or document. A visitor goes over the parts in order
and gives each its piece: the escaped text, or a placeholder; attachments are recorded in
order with kind, reference and the number of tokens that the placeholder stands for. Turns
become

    <s>[INST] text [/INST]</s>   <s>[SYS] text [/SYS]</s>   <s>[ASST] text [/ASST]</s>
    <s>[ROLE]role[/ROLE]text</s>                            for any other role

Control strings inside texts and roles get one backslash more after their first character,
and lose it when read back, so no text can open or close a turn and every text survives.
The loss mask covers assistant texts, as code-point spans of the formatted string.

Defined results: a NULL text or list of parts is empty, a NULL role is an empty one, rows of equal turn go by
role and then text, repeated rows are repeated turns, rows with a NULL conv_id form one
conversation, and an empty table gives none. Only columns named here are read. A conversation
becomes one row, as its output is one string; nothing else is gathered. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain, substrings, walk

ROLES = {"user": "INST", "system": "SYS", "assistant": "ASST"}
_INNER = r"(/?s>|/?(?:INST|SYS|ASST|ROLE)\]|(?:image|audio|document)>)"
ESCAPE, UNESCAPE = rf"([<\[])(\\*){_INNER}", rf"([<\[])\\(\\*){_INNER}"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<kind:string,ref:string,tokens:bigint>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, UNESCAPE, "$1$2$3")


def text_parts(text: Column) -> Column:
    none = F.lit(None)
    s = F.struct(
        F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"),
        none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages"),
    )
    return F.array(s.cast(PART))


def part_tokens(p: Column) -> Column:
    """Tokens that a placeholder stands for: image patches, audio frames, document pages; 0 for text and unknown sizes."""
    zero = F.lit(0).cast("long")
    image = F.ceil(F.coalesce(p["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(0)) / PATCH)
    audio = F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE)
    pages = F.coalesce(p["pages"], F.lit(0)).cast("long") * PAGE_TOKENS
    return F.when(p["type"] == "image", image).when(p["type"] == "audio", audio).when(p["type"] == "document", pages).otherwise(zero).cast("long")


def flatten_parts(parts: Column) -> Column:
    """The visitor's text: pieces in order. A part of unknown type gives its text.

    Neighbouring texts are joined before they are escaped, so none can complete another's control string.
    """
    init = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))

    def visit(a: Column, p: Column) -> Column:
        media = p["type"].isin("image", "audio", "document")
        closed = F.concat(a["done"], escape(a["open"]), F.lit("<"), p["type"], F.lit(">"))
        return F.struct(F.when(media, closed).otherwise(a["done"]).alias("done"), F.when(media, F.lit("")).otherwise(F.concat(a["open"], plain(p["text"]))).alias("open"))

    return plain(F.aggregate(parts, init, visit, lambda a: F.concat(a["done"], escape(a["open"]))))


def attachments(parts: Column) -> Column:
    """The visitor's attachments, in the order of their placeholders."""
    kept = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p["type"].isin("image", "audio", "document"))
    return F.transform(kept, lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")).cast(ATTACHMENT))


def _open(role: Column) -> Column:
    out = F.concat(F.lit("<s>[ROLE]"), escape(role), F.lit("[/ROLE]"))
    for r, m in ROLES.items():
        out = F.when(role == r, F.lit(f"<s>[{m}] ")).otherwise(out)
    return out


def _close(role: Column) -> Column:
    out = F.lit("</s>")
    for r, m in ROLES.items():
        out = F.when(role == r, F.lit(f" [/{m}]</s>")).otherwise(out)
    return out


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: Column | None = None, text: str = "text") -> DataFrame:
    """conv_id, formatted, loss (array of start, n), attachments, expanded_tokens: one row a conversation."""
    parts = text_parts(F.col(text)) if parts is None else parts
    r = plain(role)
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"), flatten_parts(parts).alias("body"), attachments(parts).alias("files"))
    rows = rows.select("conv_id", F.struct("turn", "role", "body", _open(F.col("role")).alias("open"), _close(F.col("role")).alias("close"), "files").alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def step(at: Column, t: Column) -> tuple[Column, Column]:
        begin, n = at + F.length(t["open"]), F.length(t["body"])
        return begin + n + F.length(t["close"]), F.when(t["role"] == "assistant", F.struct(begin.alias("start"), n.alias("n")))

    files = F.flatten(F.transform("ts", lambda t: t["files"]))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: F.concat(t["open"], t["body"], t["close"])), "").alias("formatted"),
        walk(F.col("ts"), F.lit(0), step, "struct<start:int,n:int>").alias("loss"),
        files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("expanded_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and loss_text, from formatted and loss alone. Placeholders stay in the texts."""

    def one(p: Column) -> Column:
        other = F.substring_index(F.substring(p, 10, F.length(p)), "[/ROLE]", 1)
        out = F.struct(unescape(other).alias("role"), unescape(F.substring(p, F.length(other) + 17, F.length(p))).alias("text"))
        for r, m in ROLES.items():
            head, tail = len(f"<s>[{m}] "), len(f" [/{m}]")
            inner = F.substring(p, F.lit(head + 1), F.length(p) - head - tail)
            out = F.when(F.startswith(p, F.lit(f"<s>[{m}] ")), F.struct(F.lit(r).alias("role"), unescape(inner).alias("text"))).otherwise(out)
        return out

    pieces = F.split("formatted", "</s>", -1)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), one)
    loss = F.array_join(F.transform(substrings(F.col("formatted"), F.col("loss")), unescape), "")
    return chats.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def digest(chats: DataFrame) -> DataFrame:
    """What was read back, as counts and SHA-256 digests."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(chats).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are control strings."""
    hard = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
