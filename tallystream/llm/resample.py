"""Importance resampling towards a target by hashed n-grams, counted in word tries.

The features of a text are its runs of 1 to ORDER consecutive words; a feature falls into the bucket
of its CRC-32. A bucket's gain is the log ratio of its smoothed shares in the target and in the
documents, a document's weight the sum of its features' gains. Gumbel noise of a seeded hash of the
document's id is added, and the documents with the highest scores are drawn, which is a sample without
replacement in proportion to exp(weight).

Each task reads its texts in stretches of SLICE bytes and builds a trie of each stretch's words: a node
for each distinct run of words, with the number of times that it occurs and its CRC state, which is
that of its parent led on through one more word (crc.joined). Counting adds up nodes' counts by bucket;
a task gives one total for each bucket, whatever it has read, and the totals are merged by a grouped
sum. Scoring builds the same tries again, attaches to each node the sum of the gains on its path, and
adds for each place in a text the gains of the longest path that starts there. Only the gains, BUCKETS
numbers, are broadcast.

Ranks are places in ranges of the score, so no task orders more than about ROWS documents.

Defined results: a NULL text has no words, 0 features and weight 0; a NULL id has the hash of an empty
one and is ordered last among ties; repeated rows count and are drawn each by itself, equal ones in any
order; with an empty target all shares are equal in it; empty documents give an empty result. Other
columns are ignored by draw and carried by drawn.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import crc
from .common import blocks_for, fresh, kept, plain, running, slices

ORDER, BUCKETS, SEED, LEAST_WORDS, PERCENT = 3, 10_000, 42, 20, 5
SLICE, ROWS = 4 << 20, 1 << 20
#: Lower-cases A-Z, keeps digits, letters and all bytes of other characters, and blanks the rest.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Trie:
    """The runs of 1 to ORDER words of some texts. For each level: counts, states and parents of its nodes, and the node that starts at each word (-1: none)."""

    def __init__(self, texts: pa.Array):
        edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        folded = (texts.buffers()[2].to_pybytes() if texts.buffers()[2] else b"")[edges[0] : edges[-1]].translate(_FOLD)
        lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer((edges - edges[0]).astype(np.int32)), pa.py_buffer(folded)))
        enc = lists.flatten().dictionary_encode()
        values = enc.dictionary.cast(pa.binary()).to_pylist()
        ids, doc = enc.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        if b"" in values:  # blanks at a text's edge
            real = ids != values.index(b"")
            ids, doc = ids[real], doc[real]
        self.doc = doc
        self.words = np.bincount(doc, minlength=len(texts))
        first, after = crc.of_each(values), crc.of_each([b" " + v for v in values])
        length = np.fromiter(map(len, values), np.int64, len(values)) + 1
        nodes, counts = ids, np.bincount(ids, minlength=len(values))
        self.levels = [(counts, first, np.zeros(len(values), np.int64), nodes)]
        for level in range(1, ORDER):
            n = len(ids) - level
            there = np.flatnonzero((doc[:n] == doc[level:]) & (nodes[:n] >= 0)) if n > 0 else np.zeros(0, np.int64)
            arcs, place, counts = np.unique(nodes[there] * len(values) + ids[there + level], return_inverse=True, return_counts=True)
            parent, word = arcs // max(1, len(values)), arcs % max(1, len(values))
            states = crc.joined(self.levels[-1][1][parent], after[word], length[word])
            nodes = np.full(len(ids), -1, np.int64)
            nodes[there] = place
            self.levels.append((counts, states, parent, nodes))

    def totals(self, buckets: int) -> np.ndarray:
        """How many features each bucket holds."""
        return sum(np.bincount((states % np.uint32(buckets)).astype(np.int64), weights=counts, minlength=buckets) for counts, states, _, _ in self.levels).astype(np.int64)

    def features(self) -> np.ndarray:
        return sum(np.maximum(self.words - level, 0) for level in range(ORDER))

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """The sum of gains over each text's features: each node holds its path's, and each place takes its longest path."""
        path = np.zeros(0, np.int64)
        at_place = np.zeros(len(self.doc), np.int64)
        for level, (_, states, parent, nodes) in enumerate(self.levels):
            own = gains[(states % np.uint32(len(gains))).astype(np.int64)]
            path = own + path[parent] if level else own
            there = np.flatnonzero(nodes >= 0)
            at_place[there] = path[nodes[there]]
        run = np.r_[0, np.cumsum(at_place)]
        ends = np.cumsum(self.words)
        return run[ends] - run[ends - self.words]


def bucket_totals(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into it; buckets without any have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, SLICE, 0):
            total += Trie(part.column(0)).totals(buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    return docs.select(plain(f"`{text}`").alias("_t")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket; buckets numbers come to the driver for each side."""
    counts = []
    for df, column in ((docs, text), (target, target_text)):
        n = np.zeros(buckets, np.int64)
        for r in bucket_totals(df, column, buckets).collect():
            n[r.bucket] = r.n
        counts.append(n.tolist())
    ours, theirs = (float(sum(c) + buckets) for c in counts)
    return np.array([math.floor(1000 * math.log(float(t + 1) * ours / (float(s + 1) * theirs))) for s, t in zip(*counts)], np.int64)


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score) of each document."""
    attached = docs.sparkSession.sparkContext.broadcast(gains(docs, target, text, target_text, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE, 1):
            trie = Trie(part.column(1))
            arrays = [part.column(0), *(pa.array(x.astype(np.int64)) for x in (trie.words, trie.features(), trie.weights(attached.value)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(f"`{key}`").alias("_key"), plain(f"`{text}`").alias("_t")).mapInArrow(run, f"_key {kind}, n_words long, n_features long, weight long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return found.select(F.col("_key").alias(key), "n_words", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"))


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of each document; rank is NULL for those not drawn."""
    scored = kept(score(docs, target, key, text, target_text, buckets, seed))
    long = F.col("n_words") >= least
    rows, able = scored.agg(F.count(F.lit(1)), F.count(F.when(long, F.lit(1)))).first()
    order = [~long, -F.col("score"), F.col(f"`{key}`").asc_nulls_last()]
    part, other, rows_, before, place = (fresh(scored, n) for n in ("_part", "_other", "_rows", "_before", "_place"))
    ranged = kept(scored.repartitionByRange(blocks_for(rows, ROWS), *order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(F.col(part).alias(other)).agg(F.count(F.lit(1)).alias(rows_))
    within = ranged.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    ranked = within.join(running(sizes, other, rows_, before), F.col(part) == F.col(other)).withColumn(place, F.col(place) + F.col(before))
    drawn_ = long & (F.col(place) <= percent * able // 100)
    return ranked.select(key, "n_words", "n_features", "weight", "score", F.when(drawn_, F.col(place)).cast("long").alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options: object) -> DataFrame:
    """The drawn documents with all their columns. Ids should be distinct: a drawn id keeps all its rows."""
    name = fresh(docs, "_k")
    ids = draw(docs, target, key, **options).filter("rank IS NOT NULL").select(F.col(f"`{key}`").alias(name)).distinct()
    return docs.join(ids, F.col(f"`{key}`").eqNullSafe(F.col(name)), "left_semi")


def bucket_of(words: list[str], buckets: int = BUCKETS) -> int:
    return zlib.crc32(" ".join(words).encode()) % buckets
