"""An index of texts by their byte grams, for keywords that arrive later or are too many for one automaton.

build packs the normalised texts into slices of about SLICE bytes, each a row that is written once, and
notes for each slice the distinct grams of 1 to GRAM bytes in it: the postings (gram, slice). Texts
never stand beside grams.

A keyword's grams are looked up in the postings' frequencies; if one is in no slice, no text holds the
keyword. Else the postings of its two rarest grams are intersected (a shorter keyword is itself a gram),
which leaves the slices that may hold it. Each slice then meets the keywords that it may hold, its texts
once, and reads the texts through automata of up to ARCS arcs of these keywords, a stretch at a time, which verifies
them. So what is shuffled is the packed texts once, the postings, and a row for each slice and keyword
that it may hold; a task holds one slice and one automaton, however many texts and keywords there are.

Keywords that are too many for one automaton and known by now have another way (by_runs), as common grams keep
few of them from a slice. A keyword of letters and digits lies within a run of these, so pack's slices list the
pieces of their distinct runs that a filter of all keywords (of fixed size) lets pass, these pieces are joined with the
keywords, and a slice gets back those that it does hold: at most as many as its own text has pieces, however
many keywords there are. It looks them up in its runs again and needs neither automata nor postings; other keywords
take the way above.

Rows with NULL or repeated keys keep their own results; a NULL text is empty; an empty keyword is in every
text; NULL keywords are ignored; equal rules count each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from .automaton import Automaton, _ranges, distinct, sliced

GRAM, SLICE, CHOSEN = 4, 16 << 20, 2
#: Most arcs of an automaton (4 bytes each), if no two words share a prefix.
ARCS = 1 << 25
RULE = "array<struct<code: string, word: string, times: bigint>>"
#: Bytes of runs (ASCII letters and digits, and all of other characters), keywords that lie within runs, and the bits of their filter.
RUN = np.array([x >= 0x80 or chr(x).isalnum() for x in range(256)])
PLAIN = r"^[0-9A-Za-z\x{80}-\x{10FFFF}]{1,64}\z"
FILTER_BITS = 26
#: Bytes of a slice and of a stretch whose runs are found at once.
RUN_SLICE, RUN_STRETCH = 8 << 20, 1 << 20


def grams_of(data: np.ndarray, edges: np.ndarray, size: int) -> np.ndarray:
    """The grams of size bytes at all places of the texts between edges, as numbers that tell their size; a text's are those inside it."""
    n = len(data) - size + 1
    if size == 0 or n <= 0:
        return np.zeros(0, np.int64)
    out = np.full(n, size, np.int64)
    for k in range(size):
        out = out << 8 | data[k : k + n]
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    return out[text[:n] == text[size - 1 :]]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]], (edges - edges[0]).astype(np.int64)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t[name]
    return c.chunk(0) if c.num_chunks else pa.array([], c.type)


def build(df: DataFrame, key: str, text: str, path: str, slice_bytes: int = SLICE) -> None:
    """Writes the tables slices, postings and frequencies under path."""
    pack(df, key, text, path, slice_bytes)
    post(df.sparkSession, path)


def pack(df: DataFrame, key: str, text: str, path: str, slice_bytes: int = SLICE) -> None:
    """Writes the table slices under path."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId() << 40

        def full() -> pa.RecordBatch:
            nonlocal size, number
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            size, number = 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([_packed(whole)], pa.binary())], names=["slice", "data"])

        for b in sliced(batches, 1, slice_bytes):
            if held and size + b.nbytes > slice_bytes:
                yield full()
            held.append(b)
            size += b.nbytes
        if held:
            yield full()

    rows = df.select(F.col(f"`{key}`").alias("_key"), normalize_text(F.col(f"`{text}`")).alias("_n"))
    rows.mapInArrow(packed, "slice long, data binary").write.parquet(f"{path}/slices")


def post(spark: SparkSession, path: str) -> None:
    """Writes the tables postings and frequencies of the slices under path."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(1)):
                parts = [_bytes_of(t) for _, t in _stretches(_column(_unpacked(data), "_n"))]
                found = distinct(np.concatenate([np.zeros(1, np.int64), *(distinct(grams_of(raw, edges, k)) for raw, edges in parts for k in range(1, GRAM + 1))]))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), number))], names=["gram", "slice"])

    slices = spark.read.schema("slice long, data binary").parquet(f"{path}/slices")
    slices.mapInArrow(posted, "gram long, slice long").write.parquet(f"{path}/postings")
    postings = spark.read.schema("gram long, slice long").parquet(f"{path}/postings")
    postings.groupBy("gram").agg(F.count(F.lit(1)).alias("slices")).write.parquet(f"{path}/frequencies")


def _stretches(texts: pa.Array, *most: int) -> Iterator[tuple[int, pa.Array]]:
    """A slice's texts in stretches that one reading takes, with the place of their first."""
    at = 0
    for b in sliced(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]), 0, *most):
        yield at, b.column(0)
        at += b.num_rows


def _words(spark: SparkSession, path: str, rules: DataFrame, codes: list[str] | None) -> DataFrame:
    """(id, n, rules) of the distinct normalised words; written, so rules are made once and ids stay. With codes, rules are their numbers."""
    name, given = f"{path}/words-{uuid.uuid4().hex}", rules.filter("word IS NOT NULL").withColumn("n", normalize_text(F.col("word")))
    if codes is None:
        each = given.groupBy("n", "code", "word").agg(F.count(F.lit(1)).alias("times"))
        found = each.groupBy("n").agg(F.collect_list(F.struct("code", "word", "times")).alias("rules"))
    else:
        found = given.groupBy("n").agg(F.array(*[F.count_if(F.col("code").eqNullSafe(c)) for c in codes]).cast("array<bigint>").alias("rules"))
    found.withColumn("id", F.monotonically_increasing_id()).write.parquet(name)
    return spark.read.schema(f"id long, n string, rules {RULE if codes is None else 'array<bigint>'}").parquet(name)


def candidates(spark: SparkSession, path: str, words: DataFrame) -> DataFrame:
    """(slice, id) of the slices that hold the rarest grams of a word, from (id, n)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = np.frombuffer(w.encode(), np.uint8)
                found = np.unique(grams_of(raw, np.array([0, len(raw)]), min(GRAM, len(raw)))) if len(raw) else np.zeros(1, np.int64)
                ids.append(np.full(len(found), i))
                grams.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(grams))], names=["id", "gram"])

    frequencies = spark.read.schema("gram long, slices long").parquet(f"{path}/frequencies").withColumnRenamed("gram", "_gram")
    known = words.select("id", "n").mapInArrow(split, "id long, gram long").join(frequencies, F.col("gram") == F.col("_gram"), "left")
    rarest = known.groupBy("id").agg(F.min(F.coalesce("slices", F.lit(0))).alias("least"), F.slice(F.array_sort(F.collect_list(F.struct("slices", "gram"))), 1, CHOSEN).alias("rare")).filter("least > 0")
    wanted = rarest.select("id", F.size("rare").alias("_need"), F.explode("rare.gram").alias("_gram"))
    postings = spark.read.schema("gram long, slice long").parquet(f"{path}/postings")
    met = wanted.join(postings, F.col("_gram") == F.col("gram")).groupBy("slice", "id", "_need").agg(F.count(F.lit(1)).alias("_got"))
    return met.filter("_got = _need").select("slice", "id")


def _chunks(words: list[bytes]) -> Iterator[slice]:
    """Stretches of words whose automaton has up to ARCS arcs. Neighbours share prefixes, so words should be sorted."""
    width = len(set(b"".join(words))) + 1
    size = np.cumsum([0, *(len(w) for w in words)])
    i = 0
    while i < len(words):
        j = max(i + 1, int(np.searchsorted(size, size[i] + ARCS // width, side="right")) - 1)
        yield slice(i, j)
        i = j


def _binary(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings of these places."""
    edges = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(size, out=edges[1:])
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(data[_ranges(begin, size)])])


def _runs(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The text of each run of least bytes or more, its place among the distinct runs, and these."""
    data, edges = _bytes_of(texts)
    inside, border = RUN[data], np.zeros(len(data) + 1, bool)
    border[edges] = True
    begin = np.flatnonzero(inside & (border[:-1] | ~np.r_[False, inside[:-1]]))
    size = np.flatnonzero(inside & (border[1:] | ~np.r_[inside[1:], False])) + 1 - begin
    begin, size = begin[size >= least], size[size >= least]
    runs = _binary(data, begin, size).dictionary_encode()
    return np.searchsorted(edges, begin, side="right") - 1, runs.indices.to_numpy().astype(np.int64), runs.dictionary


def _hashes(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray | int], np.ndarray]:
    """A function of places and sizes that hashes the strings there: sums of bytes times powers, so each takes a few steps."""
    n, base = len(data), 0x9E3779B97F4A7C15
    powers = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), x, np.uint64)], dtype=np.uint64)
    back, sums = powers(pow(base, -1, 1 << 64)), np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base)[:n], out=sums[1:])

    def hashed(at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        h = (sums[at + size] - sums[at]) * back[at]
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(29)

    return hashed


def _pieces(runs: pa.Array, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, hashes) of all pieces of the runs with each of these sizes, which ascend."""
    data, edges = _bytes_of(runs)
    hashed, end, at = _hashes(data), np.repeat(edges[1:], np.diff(edges)), np.arange(len(data))
    for size in sizes:
        at = at[at + size <= end[at]]
        if not len(at):
            return
        yield size, at, hashed(at, size)


def _bits(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> np.uint64(k) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64) for k in (0, 19, 38)]


def _filter(words: DataFrame) -> np.ndarray:
    """The bits of all words, 64 by 64: of fixed size, however many there are."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
        for b in batches:
            data, edges = _bytes_of(b.column(0))
            for p in _bits(_hashes(data)(edges[:-1], np.diff(edges))):
                np.bitwise_or.at(bits, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], names=["at", "bits"])

    marked = words.select("n").mapInArrow(mark, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[marked["at"].to_numpy()] = marked["bits"].to_numpy().view(np.uint64)
    return out


def held(spark: SparkSession, path: str, words: DataFrame) -> DataFrame:
    """(slice, n, rules) of the words that a slice's runs hold, from words that lie within runs; n as bytes."""
    sizes = sorted(r[0] for r in words.select(F.octet_length("n")).distinct().collect())
    shared = spark.sparkContext.broadcast(_filter(words))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(1)):
                found = [pa.array([], pa.binary())]
                for _, texts in _stretches(_column(_unpacked(data), "_n"), RUN_STRETCH):
                    runs = _runs(texts, sizes[0])[2]
                    raw = _bytes_of(runs)[0]
                    for size, at, h in _pieces(runs, sizes):
                        for k in range(3):
                            p = _bits(h)[k]
                            on = (bits[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                            at, h = at[on], h[on]
                        found.append(_binary(raw, at, np.full(len(at), size)).unique())
                found = pa.chunked_array(found).unique()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), number, np.int64)), found], names=["slice", "_piece"])

    slices = spark.read.schema("slice long, data binary").parquet(f"{path}/slices")
    pieces = slices.mapInArrow(look, "slice long, _piece binary")
    return pieces.join(words.select(F.col("n").cast("binary").alias("n"), "rules"), F.col("_piece") == F.col("n")).select("slice", "n", "rules")


class _Known:
    """Words, to be found in runs."""

    MAY = 22

    def __init__(self, words: pa.Array):
        self.data, self.edges = _bytes_of(words)
        size = np.diff(self.edges)
        h, self.n = _hashes(self.data)(self.edges[:-1], size), len(words)
        self.may = np.zeros(1 << self.MAY, bool)
        self.may[h & np.uint64((1 << self.MAY) - 1)] = True
        order = np.lexsort((h, size))
        self.sizes, first = np.unique(size[order], return_index=True)
        self.by_size = {int(s): (h[o], o) for s, o in zip(self.sizes, np.split(order, first[1:]))}

    def inside(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (run, word), ordered by run. Equal hashes are compared byte by byte."""
        data, edges = _bytes_of(runs)
        run, out = np.repeat(np.arange(len(runs)), np.diff(edges)), [np.zeros(0, np.int64)]
        for size, at, h in _pieces(runs, self.sizes.tolist()):
            may = self.may[h & np.uint64((1 << self.MAY) - 1)]
            at, h, (hashes, words) = at[may], h[may], self.by_size[size]
            low = np.searchsorted(hashes, h)
            count = np.searchsorted(hashes, h, side="right") - low
            at, word = np.repeat(at, count), words[_ranges(low, count)]
            span = np.arange(size)
            same = (data[at[:, None] + span] == self.data[self.edges[word][:, None] + span]).all(axis=1)
            out.append(run[at[same]] * self.n + word[same])
        pairs = distinct(np.concatenate(out))
        return pairs // max(1, self.n), pairs % max(1, self.n)

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (text, word), by their places, ordered by text."""
        text, place, runs = _runs(texts, int(self.sizes[0]))
        run, word = self.inside(runs)
        first = np.searchsorted(run, np.arange(len(runs) + 1))
        both = distinct(text * max(1, len(runs)) + place)
        text, place = both // max(1, len(runs)), both % max(1, len(runs))
        count = np.diff(first)[place]
        both = distinct(np.repeat(text, count) * self.n + word[_ranges(first[place], count)])
        return both // self.n, both % self.n


def _verified(spark: SparkSession, path: str, rules: DataFrame, found: Callable[[pa.Array, pa.Array, Iterator], pa.Table], schema: str, by_runs: bool, codes: list[str] | None = None) -> DataFrame:
    """found(keys, rules of each word, hits) makes a slice's rows; hits are (texts, words) by their places."""

    def verify(_: tuple, slices: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(slices):
            return pa.table({k: pa.array([], t) for k, t in zip(names, types)})
        rows, wanted = _unpacked(slices["data"][0]), wanted.sort_by([("plain", "ascending"), ("n", "ascending")]).combine_chunks()
        texts, n_odd = _column(rows, "_n"), len(wanted) - sum(wanted["plain"].to_pylist())
        words = _column(wanted, "n")
        odd, plain = words.slice(0, n_odd).to_pylist(), words.slice(n_odd)

        def hits() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for part in _chunks(odd):
                automaton = Automaton(odd[part])
                for at, some in _stretches(texts):
                    text, word = automaton.find(some)
                    yield text + at, word + part.start
            if len(plain):
                known = _Known(plain)
                for at, some in _stretches(texts, RUN_STRETCH):
                    text, word = known.find(some)
                    yield text + at, word + n_odd

        return found(_column(rows, "_key"), _column(wanted, "rules"), hits())

    like = spark.createDataFrame([], schema)
    names = like.columns
    types = [f.type for f in like.toArrow().schema]
    slices = spark.read.schema("slice long, data binary").parquet(f"{path}/slices")
    words = _words(spark, path, rules, codes)
    odd = words.filter(~F.col("n").rlike(PLAIN)) if by_runs else words
    plain = words.filter(F.col("n").rlike(PLAIN)) if by_runs else words.limit(0)
    with_odd = not by_runs or not odd.isEmpty()
    if by_runs and with_odd:
        post(spark, path)
    shape = [F.col("n").cast("binary").alias("n"), "rules"]
    wanted = candidates(spark, path, odd).join(odd, "id").select("slice", *shape, F.lit(False).alias("plain")) if with_odd else words.limit(0).select(F.lit(0).cast("long").alias("slice"), *shape, F.lit(False).alias("plain"))
    if by_runs and not plain.isEmpty():
        wanted = wanted.union(held(spark, path, plain).withColumn("plain", F.lit(True)))
    return slices.groupBy("slice").cogroup(wanted.groupBy("slice")).applyInArrow(verify, schema)


def matches(spark: SparkSession, path: str, rules: DataFrame, key: str, kind: str, by_runs: bool = False) -> DataFrame:
    """(key, code, word) for each rule's keyword in each indexed text. kind: the key's type."""

    def found(keys: pa.Array, rules_: pa.Array, hits: Iterator) -> pa.Table:
        text, word = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *hits))
        # A word's rules one after another, each as often as it was given.
        given = [[(r["code"], r["word"]) for r in rs for _ in range(r["times"])] for rs in rules_.to_pylist()]
        size = np.fromiter(map(len, given), np.int64, len(given))
        flat, begin, n = [g for gs in given for g in gs], np.cumsum(size) - size, size[word]
        at = pa.array(np.repeat(begin[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
        codes, words = pa.array([c for c, _ in flat], pa.string()), pa.array([w for _, w in flat], pa.string())
        return pa.table({"_key": keys.take(pa.array(np.repeat(text, n))), "code": codes.take(at), "word": words.take(at)})

    return _verified(spark, path, rules, found, f"_key {kind}, code string, word string", by_runs).withColumnRenamed("_key", key)


def counts(spark: SparkSession, path: str, rules: DataFrame, kind: str, codes: list[str], by_runs: bool = False) -> DataFrame:
    """(_key, _s): for each indexed text the number of rules of each code whose keyword it holds."""

    def found(keys: pa.Array, rules_: pa.Array, hits: Iterator) -> pa.Table:
        total = np.zeros((len(keys), len(codes)), np.int64)
        each = rules_.flatten().to_numpy().reshape(len(rules_), len(codes))
        for text, word in hits:
            for j in range(len(codes)):
                total[:, j] += np.bincount(text, weights=each[word, j], minlength=len(keys)).astype(np.int64)
        edges = np.arange(0, len(keys) * len(codes) + 1, max(1, len(codes)), dtype=np.int32)
        return pa.table({"_key": keys, "_s": pa.ListArray.from_arrays(edges, pa.array(total.ravel().astype(np.int32)))})

    return _verified(spark, path, rules, found, f"_key {kind}, _s array<int>", by_runs, codes)
