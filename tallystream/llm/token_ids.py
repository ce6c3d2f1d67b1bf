"""Token ids in binary files: Simple-8b words with selectors, escapes and block offsets.

A 64-bit word holds a selector in its low four bits and as many ids as fit into the other 60 at one
width: selector s holds COUNTS[s] ids of BITS[s] bits, so a run of 120 zeros takes one word, and an id
below 2**60 at most one. The last selector is an escape: the id, which needs more than 60 bits, is the
next in the block's list of escapes. Each word takes the most ids that it can, in order. Packing
begins anew every BLOCK ids, and a frame stores where each block's words and escapes begin, so any
range of ids is decoded without what is ahead of it, and all blocks of a range at once.

A file is a sequence of frames of about FRAME ids (whole documents). A frame, in 8-byte units and
little-endian: HEAD integers (MAGIC, number of the file, of the frame, of documents, of ids, of blocks,
of words, of escapes, bytes of the keys, and the ids of the file ahead of the frame); the number of ids
of each document; where each block's words and escapes begin (two arrays); the words; the escapes; the
documents' keys as an Arrow stream; zeros; and as its last byte a line feed, so that Spark's text sink
writes the files and its commit protocol keeps those of lost tasks out. Spark's binaryFile source
reads them.

Documents are dealt to files by ranges of the key (and a hash of the text, so that many rows of one key
don't meet in one task) and sorted in each, so the ids' order is that of the keys over all files; the
place of a file's first id is a sum over the files before it, made in two levels.

A text is cut ahead of single spaces that begin a word, where a byte-level tokenizer's pattern always
begins a new piece; each distinct piece of a file is encoded once, and a worker keeps up to CACHE pieces
for its next files. So texts of any length take memory by their bytes, not by their encodings. Other kinds
of tokenizers encode whole texts. Strings of special tokens in a text are ordinary text.

Defined results: a NULL or empty text has the end id alone; rows of one key come in the order of their
texts' hashes, equal rows share their values up to their places; a NULL key is ordered first; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .common import blocks_for, fresh, kept, plain, running, slices, text_bytes

COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
ESCAPE, BLOCK, PAD = 15, 4096, 120
FRAME, FILE_BYTES, CACHE = 1 << 20, 16 << 20, 3 << 19
MAGIC, HEAD = int.from_bytes(b"S8BIDS1\0", "little"), 10
_U = np.uint64


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For each place the selector that holds the most of the ids from there on. ids: a row for each block, with PAD zeros after it."""
    need = np.searchsorted(np.array([1 << b for b in BITS], _U), ids.ravel(), side="right").astype(np.uint8)
    out, most, size = np.full(len(need), ESCAPE, np.uint8), need, 1
    for s in range(len(BITS) - 1, -1, -1):
        n = int(COUNTS[s])
        if n > size:  # the widest id among n, from two windows of the size before
            wide = np.full(len(need), ESCAPE, np.uint8)
            wide[: len(need) - n + 1] = np.maximum(most[: len(need) - n + 1], most[n - size : len(need) - size + 1])
            most, size = wide, n
        out[most <= s] = s
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, where each block's words begin, escapes, where each block's escapes begin."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.zeros((blocks, BLOCK + PAD), _U)
    for b in range(blocks):
        part = ids[b * BLOCK : (b + 1) * BLOCK]
        padded[b, : len(part)] = part
    select, flat = _selectors(padded) if blocks else np.zeros(0, np.uint8), padded.ravel()
    first = np.arange(blocks) * (BLOCK + PAD)
    at, end, starts = first, first + np.minimum(BLOCK, len(ids) - np.arange(blocks) * BLOCK), [np.zeros(0, np.int64)]
    while len(at):  # all blocks in step
        starts.append(at)
        at = at + COUNTS[select[at]]
        more = at < end
        at, end = at[more], end[more]
    at = np.sort(np.concatenate(starts))
    chosen = select[at]
    words = chosen.astype(_U)
    for s, bits in enumerate(BITS):
        mine = np.flatnonzero(chosen == s)
        if bits and len(mine):
            for k in range(int(COUNTS[s])):
                words[mine] |= flat[at[mine] + k] << _U(4 + bits * k)
    beyond = at[chosen == ESCAPE]
    return words, np.searchsorted(at, first), flat[beyond], np.searchsorted(beyond, first)


def unpack(words: np.ndarray, block_words: np.ndarray, escapes: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of whole blocks, whose words begin at block_words (ahead of which words are ignored)."""
    blocks = len(block_words)
    if not blocks:
        return np.zeros(0, _U)
    words = words[block_words[0] :]
    begin = block_words - block_words[0]
    chosen = (words & _U(15)).astype(np.int64)
    ahead = np.cumsum(COUNTS[chosen]) - COUNTS[chosen]
    block = np.repeat(np.arange(blocks), np.diff(np.r_[begin, len(words)]))
    at = ahead - ahead[begin][block] + block * (BLOCK + PAD)
    out = np.zeros(blocks * (BLOCK + PAD), _U)
    for s, bits in enumerate(BITS):
        mine = np.flatnonzero(chosen == s)
        if bits and len(mine):
            w, mask = words[mine], _U((1 << bits) - 1)
            for k in range(int(COUNTS[s])):
                out[at[mine] + k] = w >> _U(4 + bits * k) & mask
    out[at[chosen == ESCAPE]] = escapes
    return out.reshape(blocks, BLOCK + PAD)[:, :BLOCK].reshape(-1)[:n_ids]


def frame(ids: np.ndarray, counts: np.ndarray, keys: pa.Array, file: int, number: int, ahead: int) -> bytes:
    words, block_words, escapes, block_escapes = pack(ids)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", keys.type)])) as out:
        out.write_batch(pa.record_batch([keys], names=["key"]))
    names = sink.getvalue().to_pybytes()
    head = [MAGIC, file, number, len(counts), len(ids), len(block_words), len(words), len(escapes), len(names), ahead]
    body = b"".join(np.asarray(x).astype("<i8").tobytes() for x in (head, counts, block_words, block_escapes)) + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes() + names
    return body + b"\0" * (-len(body) - 1 & 7) + b"\n"


class Frame:
    """A frame as it lies in a file's bytes; nothing is decoded before it is asked for."""

    def __init__(self, data: memoryview, at: int = 0):
        ints = lambda n, kind="<i8": (np.frombuffer(data, kind, n, self.end), setattr(self, "end", self.end + 8 * n))[0]
        self.end = at
        magic, self.file, self.number, docs, self.n_ids, blocks, words, escapes, names, self.ahead = ints(HEAD).tolist()
        if magic != MAGIC:
            raise ValueError("not a frame of token ids")
        self.counts, self.block_words, self.block_escapes = ints(docs), ints(blocks), ints(blocks)
        self.words, self.escapes = ints(words, "<u8"), ints(escapes, "<u8")
        self.keys = pa.ipc.open_stream(pa.py_buffer(data[self.end : self.end + names])).read_all()["key"].combine_chunks()
        self.end += names + (-names - 1 & 7) + 1

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from begin to end; only their blocks are decoded."""
        end = self.n_ids if end is None else end
        if end <= begin:
            return np.zeros(0, _U)
        a, b = begin // BLOCK, -(-end // BLOCK)
        last, last_escape = np.r_[self.block_words, len(self.words)][b], np.r_[self.block_escapes, len(self.escapes)][b]
        got = unpack(self.words[:last], self.block_words[a:b], self.escapes[self.block_escapes[a] : last_escape], min(self.n_ids, b * BLOCK) - a * BLOCK)
        return got[begin - a * BLOCK : end - a * BLOCK]


def frames(data: bytes) -> Iterator[Frame]:
    view, at = memoryview(data), 0
    while at < len(view):
        f = Frame(view, at)
        yield f
        at = f.end


# Bytes that begin a character which surely isn't white space: ASCII graphics and lead bytes of blocks without spaces.
_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = _GRAPHIC[0xC3:0xE1] = _GRAPHIC[0xE4:] = True
_IN_WORD = _GRAPHIC.copy()
_IN_WORD[0x80:0xC2] = True


class Encoder:
    """Encodes texts by distinct pieces; see the module."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        kind = json.loads(spec)
        pre = kind.get("pre_tokenizer") or {}
        self.by_pieces = kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space")
        feed = self._batch(["\n"])[0]
        self.feed = int(feed[0]) if len(feed) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.begin, self.size = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each piece's begin and how many they are. Pieces without inner white space are joined by line feeds, which stay tokens of their own."""
        offsets, data = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1], np.frombuffer(values.buffers()[2], np.uint8)
        odd = np.r_[0, np.cumsum(~_IN_WORD[data[offsets[0] : offsets[-1]]])]
        bad = odd[offsets[1:] - offsets[0]] - odd[offsets[:-1] - offsets[0]] - (data[offsets[:-1]] == 32)
        joinable = np.flatnonzero((bad == 0) & (np.diff(offsets) > 1)) if self.feed is not None else np.zeros(0, np.int64)
        rest = np.setdiff1d(np.arange(len(values)), joinable)
        parts, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(joinable), 1 << 14):
            at = [joinable[j : j + 1024] for j in range(i, min(i + (1 << 14), len(joinable)), 1024)]
            for ids in self._batch(["\n".join(values.take(pa.array(a)).to_pylist()) for a in at]):
                feeds = ids == self.feed
                sizes.append(np.diff(np.r_[-1, np.flatnonzero(feeds), len(ids)]) - 1)
                parts.append(ids[~feeds])
        for i in range(0, len(rest), 4096):
            each = self._batch(values.take(pa.array(rest[i : i + 4096])).to_pylist())
            sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
            parts.extend(each)
        size, order = np.concatenate(sizes), np.r_[joinable, rest]
        begin, length = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
        begin[order], length[order] = np.cumsum(size) - size, size
        return np.concatenate(parts), begin, length

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has. texts has no NULLs."""
        if not self.by_pieces:
            each = self._batch(texts.to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.fromiter(map(len, each), np.int64, len(each))
        edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        cut = np.zeros(len(data) + 1, bool)
        cut[: max(0, len(data) - 1)] = (data[:-1] == 32) & _GRAPHIC[data[1:]]
        cut[edges] = True
        cuts = np.flatnonzero(cut).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        place = pc.index_in(coded.dictionary, self.known)
        new = coded.dictionary.filter(pc.is_null(place))
        at = place.fill_null(0).to_numpy().astype(np.int64)
        if len(new):
            at[np.flatnonzero(pc.is_null(place).to_numpy(zero_copy_only=False))] = len(self.known) + np.arange(len(new))
            flat, begin, length = self._pieces(new)
            self.known, self.begin, self.size = pa.concat_arrays([self.known, new]), np.r_[self.begin, len(self.flat) + begin], np.r_[self.size, length]
            self.flat = np.concatenate([self.flat, flat])
        which = at[coded.indices.to_numpy()]
        size = self.size[which]
        total = np.r_[0, np.cumsum(size)]
        out = np.empty(total[-1], np.uint32)
        for i in range(0, len(which), 1 << 18):
            w, n = which[i : i + (1 << 18)], size[i : i + (1 << 18)]
            out[total[i] : total[i + len(w)]] = self.flat[np.repeat(self.begin[w] - (total[i : i + len(w)] - total[i]), n) + np.arange(total[i + len(w)] - total[i])]
        if len(self.known) > CACHE:
            self._forget()
        return out, np.diff(total[np.searchsorted(cuts, edges)])


_ENCODERS: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """One for each tokenizer and worker."""
    name = zlib.crc32(spec.encode())
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(spec)
    return _ENCODERS[name]


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 2, file_bytes: int = FILE_BYTES, frame_ids: int = FRAME) -> None:
    """Files of docs' token ids in the order of the key. tokenizer: the tokenizer's JSON (a vocabulary, so it is broadcast)."""
    n, hashed = blocks_for(text_bytes(docs, f"`{text}`"), file_bytes), fresh(docs, "_h")
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer)
    base = docs.select(F.col(f"`{key}`").alias("_key"), plain(f"`{text}`").alias("_t"), F.xxhash64(f"`{text}`").alias(hashed))
    dealt = base.repartitionByRange(n, "_key", hashed).sortWithinPartitions("_key", hashed).select("_key", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = _encoder(spec.value), TaskContext.get().partitionId()
        end = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        number = ahead = waiting = 0

        def full() -> pa.RecordBatch:
            nonlocal number, ahead, waiting
            ids, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            data = frame(ids, counts, pa.concat_arrays([h[2] for h in held]), file, number, ahead)
            held.clear()
            number, ahead, waiting = number + 1, ahead + len(ids), 0
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["data"])  # the sink adds the line feed

        for part in slices(batches, file_bytes, 1):
            ids, counts = encoder.encode(part.column(1))
            edges = np.r_[0, np.cumsum(counts)]
            ids = np.insert(ids, edges[1:], end[0]) if len(end) else ids
            counts = counts + len(end)
            edges = np.r_[0, np.cumsum(counts)]
            i = 0
            while i < len(counts):  # up to frame_ids, or one document
                j = max(i + 1, int(np.searchsorted(edges, edges[i] + frame_ids - waiting, side="right")) - 1)
                held.append((ids[edges[i] : edges[j]], counts[i:j], part.column(0).slice(i, j - i)))
                waiting += int(edges[j] - edges[i])
                i = j
                if waiting >= frame_ids or j < len(counts):
                    yield full()
        if held:
            yield full()

    # the bytes of a frame, as they are, are what the text sink writes
    dealt.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value")).write.text(path)


def read(spark: SparkSession, path: str, key: str, kind: str, with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32), with the ids too if they are asked for. kind: the key's type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for f in frames(content.as_buffer()):
                    ids = f.ids()
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    edges = np.r_[0, np.cumsum(f.counts)]
                    crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                    arrays = [pa.array(np.full(len(crcs), f.file), pa.int64()), f.keys, pa.array(edges[:-1] + f.ahead), pa.array(f.counts), pa.array(crcs, pa.int64())]
                    names = ["_file", "_key", "_at", "n_tokens", "ids_crc32"]
                    if with_ids:
                        arrays.append(pa.LargeListArray.from_arrays(edges, pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = kept(files.mapInArrow(run, f"_file long, _key {kind}, _at long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if with_ids else "")))
    sizes = rows.groupBy(F.col("_file").alias("_f")).agg(F.sum("n_tokens").alias("_n"))
    out = rows.join(running(sizes, "_f", "_n", "_before"), F.col("_file") == F.col("_f"))
    return out.select(F.col("_key").alias(key), (F.col("_before") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def stored(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 2, file_bytes: int = FILE_BYTES, frame_ids: int = FRAME) -> DataFrame:
    """Writes docs' ids to a folder of the shared store and gives what is read back from it."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, key, text, end_id, file_bytes, frame_ids)
    return read(spark, path, key, docs.schema[key].dataType.simpleString())
