"""What several operators share: sizes, blocks and a request/reply exchange between blocks and shards.

An operator that needs global facts about what its documents hold (how often does this word
occur anywhere?) works in three steps, each bounded by the size of a block or shard:

1. documents are dealt to blocks of about BLOCK_BYTES by a hash of their content, and each
   block asks every shard, in one packed row, about the distinct keys that it holds;
2. each shard, which owns a hash range of keys, merges the questions of all blocks and
   answers each block in one packed row, in the order of its question;
3. each block reads its documents again (the same exchange, which Spark reuses) beside the
   answers.

A key that all documents share costs one entry a block, whatever its frequency, so hot keys
don't skew shards; hot sources or copies don't skew blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Word separators: the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES, MOST_KEYS = 12 << 20, 1 << 17
#: Items of a fold whose outputs are appended one by one; whole chunks are appended after that.
CHUNK = 128


def plain(c: Column | str) -> Column:
    """A text column with NULL as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def walk(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """The outputs of a fold in order, without NULLs. step(state, item) gives the next state and an output.

    Outputs are gathered in chunks, since each append copies what it appends to.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(a: Column, x: Column) -> Column:
        after, out = step(a["s"], x)
        return F.struct(after.alias("s"), F.array_append(a["out"], out).alias("out"))

    def several(a: Column, c: Column) -> Column:
        done = F.aggregate(c, F.struct(a["s"].alias("s"), none.alias("out")), one)
        return let(done, lambda r: F.struct(r["s"].alias("s"), F.array_append(a["out"], r["out"]).alias("out")))

    chunks = let(items, lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda k: F.slice(v, k * CHUNK + 1, F.lit(CHUNK))))
    chunks = F.when(F.size(items) > 0, chunks)
    begin = F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.coalesce(F.filter(F.flatten(F.aggregate(chunks, begin, several, lambda a: a["out"])), lambda x: x.isNotNull()), none)


def substrings(text: Column, spans: Column) -> Column:
    """The stretches (start, n) of a text, which are in order and don't overlap. The text is read once for each CHUNK of them, not for each."""

    def several(whole: Column, c: Column) -> Column:
        base, last = F.element_at(c, 1)["start"], F.element_at(c, -1)
        part = F.struct(base.alias("base"), F.substring(whole, base + 1, last["start"] + last["n"] - base).alias("text"))
        return let(part, lambda p: F.transform(c, lambda x: F.substring(p["text"], x["start"] - p["base"] + 1, x["n"])))

    def all_(whole: Column, v: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda k: let(F.slice(v, k * CHUNK + 1, F.lit(CHUNK)), lambda c: several(whole, c))))

    found = let(spans, lambda v: F.when(F.size(v) > 0, let(text, lambda whole: all_(whole, v))))
    return F.coalesce(found, F.array().cast("array<string>"))


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df is called so (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one pass over one column, one number to the driver."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def blocks_for(total: int, size: int = BLOCK_BYTES) -> int:
    return max(1, math.ceil(total / size))


def even_keys(n: int) -> list[int]:
    """n integers that Spark's hash partitioning deals to n different partitions of n, so that no task gets two blocks; for very many, 0 to n - 1."""
    if n > MOST_KEYS:
        return list(range(n))
    out, left, start = np.full(n, -1, np.int64), n, 0
    u = np.uint32
    with np.errstate(over="ignore"):
        while left:
            v = np.arange(start, start + 4 * n, dtype=np.uint32)
            k = v * u(0xCC9E2D51)
            k = (k << u(15) | k >> u(17)) * u(0x1B873593)
            h = u(42) ^ k
            h = (h << u(13) | h >> u(19)) * u(5) + u(0xE6546B64)
            h ^= u(4)
            for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                h = (h ^ h >> u(shift)) * u(by)
            place = (h ^ h >> u(16)).view(np.int32).astype(np.int64) % n
            for at, value in zip(*np.unique(place, return_index=True)):
                if out[at] < 0:
                    out[at], left = v[value], left - 1
            start += 4 * n
    return out.tolist()


def into_blocks(docs: DataFrame, n: int, *keys: str) -> DataFrame:
    """Adds _block, dealt by a hash of the keys, and partitions by it."""
    place = F.pmod(F.xxhash64(*keys, F.lit(7)), F.lit(n)).cast("int")
    block = F.element_at(F.lit(even_keys(n)).cast("array<int>"), place + 1) if 1 < n <= MOST_KEYS else place
    return docs.withColumn("_block", block).repartition(n, "_block")


ASK = "shard int, block int, data binary"
REPLY = "block int, shard int, data binary"


def exchange(blocks: DataFrame, ask: Callable, serve: Callable, finish: Callable, schema: str, shards: int) -> DataFrame:
    """ask(pdf) gives (shard, bytes) pairs for a block; serve(list of bytes) gives a reply for each; finish(pdf, {shard: bytes}) gives the block's rows.

    blocks must have _block. Replies are matched to questions by block, and serve gets the
    questions ordered by block, so reruns agree.
    """

    places = even_keys(shards)
    index = {x: i for i, x in enumerate(places)}

    def asks(key: tuple, t: pa.Table) -> pa.Table:
        got = ask(t)
        block = key[0].as_py()
        return pa.table({"shard": pa.array([places[x] for x, _ in got], pa.int32()), "block": pa.array([block] * len(got), pa.int32()), "data": pa.array([x for _, x in got], pa.binary())})

    def serves(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        replies = serve(t["data"].to_pylist())
        return pa.table({"block": t["block"], "shard": pa.array([key[0].as_py()] * len(replies), pa.int32()), "data": pa.array(replies, pa.binary())})

    def finishes(_: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        return finish(t, {index[x]: y for x, y in zip(replies["shard"].to_pylist(), replies["data"].to_pylist())})

    asked = blocks.groupBy("_block").applyInArrow(asks, ASK).repartition(shards, "shard")
    replied = asked.groupBy("shard").applyInArrow(serves, REPLY)
    return blocks.groupBy("_block").cogroup(replied.groupBy("block")).applyInArrow(finishes, schema)


def slices(batches: Iterator[pa.RecordBatch], most: int, column: int) -> Iterator[pa.RecordBatch]:
    """Rows cut and joined to stretches of up to about most bytes in a text column, or a row that is longer."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    for b in batches:
        texts = b.column(column)
        edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        i = 0
        while i < len(texts):
            j = min(len(texts), max(i + 1, int(np.searchsorted(edges, edges[i] + (most - size), side="right")) - 1))
            if held and size + int(edges[j] - edges[i]) > most:
                yield joined()
                held, size = [], 0
                continue
            held.append(b.slice(i, j - i))
            size += int(edges[j] - edges[i])
            i = j
    if held:
        yield joined()


def running(sizes: DataFrame, place: str, size: str, name: str, width: int = 1024) -> DataFrame:
    """(place, name): the sum of size over smaller places, for places that are distinct integers from 0 on.

    Runs of width places are summed first, so a task orders width places, or as many runs.
    """
    runs = sizes.withColumn("_running_run", F.floor(F.col(place) / width))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = runs.groupBy(F.col("_running_run").alias("_running_head")).agg(F.sum(size).alias("_running_all"))
    heads = heads.withColumn("_running_ahead", F.sum("_running_all").over(up_to(Window.orderBy("_running_head"))) - F.col("_running_all"))
    inner = runs.withColumn("_running_in", F.sum(size).over(up_to(Window.partitionBy("_running_run").orderBy(place))) - F.col(size))
    return inner.join(heads, F.col("_running_run") == F.col("_running_head")).select(place, (F.col("_running_in") + F.col("_running_ahead")).alias(name))


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder; lineage ends there."""
    shared = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():  # noqa: SLF001
        df.sparkSession.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()
