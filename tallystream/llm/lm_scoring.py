"""Language-model scores by a weighted backoff automaton over word bigrams.

States are the start, each word seen in training, and an empty root. A seen bigram is an arc
with weight (c(h,w) + K p(w)) / (c(h) + K); a state's failure arc leads to the root with
weight K / (c(h) + K), and the root has an arc for every word, p(w) being the additive
unigram (c + 0.1) / (N + 0.1 (V + 1)) that is also the base. Each state's weights add up to
one. A text is read left to right: an arc if there is one, else the failure arc and the
root's; the state is then the word read.

K comes from a fixed grid by the leave-one-out likelihood of all training documents, which
the same pass computes.

Counts are of all training documents. The automaton is never in one place: each block of
documents asks the shards that own its bigrams and words for their counts (common.exchange),
builds the states, arcs and failure arcs that its texts can reach, and reads its texts through
them in step, so memory is bounded by the block and the shard, and what is moved grows with
the input. Histories are of one word: with two, the distinct n-grams that blocks ask about
would more than double.

Defined results: a NULL or empty text is one end token; repeated rows are scored and counted
each; without training documents c, N and V are 0; a NULL id has the fold of an empty string;
an empty table gives an empty result. Whole texts are read; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, exchange, into_blocks, kept, plain, text_bytes

ALPHA = 0.1
GRID = [1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0, 65536.0]
FOLDS = 10
BLOCK, SHARD, STRETCH = 10 << 20, 24 << 20, 256
_END, _START = np.uint64(xxhash.xxh64_intdigest(b"", 5)), np.uint64(xxhash.xxh64_intdigest(b" ", 5))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Automaton:
    """A weighted backoff automaton in arrays, with a weight for each value of K in ks.

    States are the words by number, then the start, then the root. An arc is a number
    state * width + word in sorted order; its target is the word's own state if the word was
    seen in training, else the root. fail is the weight of a state's failure arc to the root,
    root that of the root's arc for a word.
    """

    def __init__(self, n_words: int, arcs: np.ndarray, weight: np.ndarray, fail: np.ndarray, root: np.ndarray, seen: np.ndarray):
        self.start, self.root_state, self.width = n_words, n_words + 1, n_words
        self.arcs, self.weight, self.fail, self.root = arcs, weight, fail, root
        self.after = np.where(seen, np.arange(n_words), self.root_state)

    def traverse(self, ids: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Log-probabilities (docs, ks) of token sequences, each read once from left to right.

        All sequences are read in step. Long ones are cut into stretches, whose first state is
        the one after the token before, as the automaton's memory is one token.
        """
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(doc)])
        cuts = -(-size // STRETCH)
        within = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = np.repeat(first, cuts) + within * STRETCH
        length = np.minimum(np.repeat(first + size, cuts) - begin, STRETCH)
        order = np.argsort(-length, kind="stable")
        begin, length, within = begin[order], length[order], within[order]
        state = np.where(within == 0, self.start, self.after[ids[begin - 1]]) if len(ids) else begin
        total = np.zeros((len(begin), self.fail.shape[1]))
        for step in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(-length, -step))  # the stretches that have a token here
            word = ids[begin[:m] + step]
            want = state[:m] * self.width + word
            at = np.minimum(np.searchsorted(self.arcs, want), max(0, len(self.arcs) - 1))
            has = self.arcs[at] == want if len(self.arcs) else np.zeros(m, bool)
            hit, miss = np.flatnonzero(has), np.flatnonzero(~has)
            total[hit] += self.weight[at[hit]]
            total[miss] += self.fail[state[miss]] + self.root[word[miss], None]
            state[:m] = self.after[word]
        out = np.zeros((docs, total.shape[1]))
        np.add.at(out, doc[begin], total)
        return out


def _tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, the token at each place (0 is the end), and the document of each place."""
    flat = pc.ascii_split_whitespace(pc.ascii_lower(texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)))
    n = pc.list_value_length(flat).to_numpy(zero_copy_only=False)
    enc = flat.flatten().dictionary_encode()
    values = enc.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.array([_END, *(xxhash.xxh64_intdigest(w, 5) for w in values)], np.uint64)
    ids, doc = enc.indices.to_numpy().astype(np.int64) + 1, np.repeat(np.arange(len(n)), n)
    if b"" in values:  # white space at a text's edge
        real = ids != values.index(b"") + 1
        ids, doc = ids[real], doc[real]
    ends = np.searchsorted(doc, np.arange(len(n)), side="right")
    return hashes, np.insert(ids, ends, 0), np.insert(doc, ends, np.arange(len(n)))


class _Block:
    """A block's distinct words and bigrams, in the order of their hashes. Words have odd hashes, bigrams even ones."""

    def __init__(self, table: pa.Table, shards: int):
        self.hashes, self.ids, self.doc = _tokens(table["_t"])
        self.held = table["held_out"].to_numpy().astype(bool)
        first = np.r_[True, self.doc[1:] != self.doc[:-1]]
        self.before = np.where(first, len(self.hashes), np.r_[0, self.ids[:-1]])  # one more id for the start
        pair = self.before * (len(self.hashes) + 1) + self.ids
        distinct, self.pair = np.unique(pair, return_inverse=True)
        self.distinct = distinct
        context = np.r_[self.hashes, _START][distinct // (len(self.hashes) + 1)]
        both = (context * _A ^ self.hashes[distinct % (len(self.hashes) + 1)]) * _B
        both ^= both >> np.uint64(31)
        train = ~self.held[self.doc]
        n_words, n_pairs = np.bincount(self.ids[train], minlength=len(self.hashes)), np.bincount(self.pair[train], minlength=len(distinct))
        key = np.concatenate([self.hashes | np.uint64(1), both & ~np.uint64(1)])
        count = np.concatenate([n_words, n_pairs])
        if len(table) and not len(key):
            raise AssertionError
        self.order = np.argsort(key)
        self.key, self.count = key[self.order], count[self.order]
        edges = [i * (1 << 64) // shards for i in range(1, shards)]
        self.cuts = [0, *np.searchsorted(self.key, np.array(edges, np.uint64)).tolist(), len(self.key)]


def _pack(key: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted keys as differences of as many bytes as they need; counts compressed."""
    gaps = np.diff(key, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    low = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return struct.pack("<IB", len(key), width) + low + zs.ZstdCompressor(1).compress(count.astype("<u4").tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = struct.unpack_from("<IB", data)
    low = np.zeros((n, 8), np.uint8)
    low[:, :width] = np.frombuffer(data, np.uint8, n * width, 5).reshape(n, width)
    return np.cumsum(low.view("<u8").ravel(), dtype=np.uint64), np.frombuffer(zs.ZstdDecompressor().decompress(data[5 + n * width :]), "<u4")


def _serve(asks: list[bytes]) -> list[bytes]:
    """Totals in the order of each question, after the shard's number of trained words and tokens."""
    parts = [_unpack(a) for a in asks]
    key = np.concatenate([p[0] for p in parts])
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=np.concatenate([p[1] for p in parts])[order]).astype(np.int64) if len(s) else np.zeros(0, np.int64)
    words = (s[new] & np.uint64(1)).astype(bool)
    head = struct.pack("<QQ", int((total[words] > 0).sum()), int(total[words].sum()))
    back = np.empty(len(key), np.int64)
    back[order] = total[group]
    out, at = [], 0
    for k, _ in parts:
        out.append(head + zs.ZstdCompressor(1).compress(back[at : at + len(k)].astype("<u8").tobytes()))
        at += len(k)
    return out


def _finish(table: pa.Table, replies: dict[int, bytes], shards: int, key: str) -> pa.Table:
    b = _Block(table, shards)
    totals, v, n = [], 0, 0
    for s in range(shards):
        a, c = struct.unpack_from("<QQ", replies[s])
        v, n = v + a, n + c
        totals.append(np.frombuffer(zs.ZstdDecompressor().decompress(replies[s][16:]), "<u8"))
    back = np.empty(len(b.key), np.float64)
    back[b.order] = np.concatenate(totals)
    c_word, c_pair = back[: len(b.hashes)], back[len(b.hashes) :]
    docs = len(table)
    starts = c_word[0]  # each training document has one end, so as many starts
    scale = n + ALPHA * (v + 1)
    p_word = (c_word + ALPHA) / scale
    p, c_h, c_hw = p_word[b.ids], np.r_[c_word, starts][b.before], c_pair[b.pair]

    def per_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(b.doc, weights=x, minlength=docs)

    ks = np.array(GRID)
    # The part of the automaton that this block's texts can reach.
    width = len(b.hashes)
    known = np.flatnonzero(c_pair > 0)
    context, word = b.distinct[known] // (width + 1), b.distinct[known] % (width + 1)
    c_state = np.r_[c_word, starts, 0.0]
    weight = np.log10((c_pair[known, None] + ks * p_word[word, None]) / (c_state[context, None] + ks))
    automaton = Automaton(width, context * width + word, weight, np.log10(ks / (c_state[:, None] + ks)), np.log10(p_word), c_word > 0)
    scores, loo = automaton.traverse(b.ids, b.doc, docs), np.zeros((docs, len(GRID)))
    train = ~b.held[b.doc]
    less = np.maximum((np.where(train, c_word[b.ids] - 1, 0) + ALPHA) / max(scale - 1, ALPHA), 1e-300)
    for j, k in enumerate(GRID):
        loo[:, j] = per_doc(np.where(train, np.log10((np.maximum(c_hw - 1, 0) + k * less) / (np.maximum(c_h - 1, 0) + k)), 0.0))
    lists = lambda x: pa.ListArray.from_arrays(np.arange(0, docs * len(GRID) + 1, len(GRID), dtype=np.int32), pa.array(x.ravel()))
    return pa.table({
        key: table[key], "held_out": table["held_out"], "n_tokens": np.bincount(b.doc, minlength=docs), "n_known": per_doc(c_word[b.ids] > 0).astype(np.int64),
        "train_tokens": np.full(docs, n, np.int64), "base_score": per_doc(np.log10(p)), "scores": lists(scores), "loo": lists(loo),
    })


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score): training leaves out fold 0.

    block and shard are bytes of text; raise both with the executors' memory, since the
    number of packed rows is the product of the numbers of blocks and shards.
    """
    total = text_bytes(docs, text)
    n, shards = blocks_for(total, block), blocks_for(total, shard)
    held = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0
    base = docs.select(F.col(key), plain(text).alias("_t"), held.alias("held_out"))
    blocks = into_blocks(base, n, key, "_t")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, scores array<double>, loo array<double>"

    def ask(t: pa.Table) -> list[tuple[int, bytes]]:
        b = _Block(t, shards)
        return [(s, _pack(b.key[i:j], b.count[i:j])) for s, (i, j) in enumerate(zip(b.cuts, b.cuts[1:]))]

    out = kept(exchange(blocks, ask, _serve, lambda t, r: _finish(t, r, shards, key), schema, shards))
    fits = out.agg(*[F.sum(F.get("loo", F.lit(j))) for j in range(len(GRID))]).first()
    best = max(range(len(GRID)), key=lambda j: fits[j] if fits[j] is not None else 0.0)
    return out.select(key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.get("scores", F.lit(best)).alias("score"), F.lit(GRID[best]).alias("backoff"))


def held_out(key: object, folds: int = FOLDS) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % folds == 0
