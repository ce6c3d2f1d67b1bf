"""Removal of repeated 100-byte strings, exact to the byte, by suffix arrays of shards.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller doc_id, or
earlier in the document). Strings are judged on the input.

Each string of LENGTH bytes has an anchor: the place of its smallest GRAM-byte hash, the
leftmost of equal ones. Equal strings have equal anchors at equal places. Strings that start
SIDE bytes or more ahead of their anchor (its left side) all hold the SIDE bytes before it, the
others (its right side) those after it; a side's hash is of the anchor and these bytes, so
short lines that otherwise unlike documents share don't bring documents together. So

1. blocks ask the shards that own the hashes of sides which of them occur more than once
   anywhere (common.exchange's packed rows, here twice in a row);
2. for each repeated side a block sends the stretch of text made of its strings, once a block for equal stretches, with its earliest place;
3. a shard collapses equal stretches to the earliest, drops those whose side has no other
   surroundings, joins the rest and builds their suffix array by induced sorting: suffixes are
   classed, leftmost-smaller (LMS) substrings are sorted by a first induction and named, the
   reduced string is sorted, and its order induces the whole array; then permuted common
   prefixes tell which neighbours share LENGTH bytes, and the earliest place of each run stays;
4. blocks cover the bytes of the strings that a shard marked.

The induction handles a bucket at a time with numpy; the reduced string is sorted by the same
induction, level after level, while it has at most MOST_NAMES names; one of more names, where
the induction would go through nearly as many buckets as there are places, is sorted by
doubling its ranks. Anchor hashes only choose candidates; equality is
decided on bytes.

Defined results: NULL and short texts lose nothing; of repeated rows with one doc_id and text
one counts as earlier; rows with one doc_id and different texts are ordered by a hash of the
text; a NULL doc_id counts as larger than any; an empty table gives an empty result. Other columns are
ignored. Long texts are searched in pieces.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASK, REPLY, blocks_for, even_keys, into_blocks, plain, text_bytes

LENGTH, GRAM, SIDE = 100, 40, 30
SPREAD = LENGTH - GRAM + 1  # grams in a string
PIECE = 1 << 18
BLOCK, SHARD = 8 << 20, 6 << 20
MOST_NAMES = 4096
SEPARATOR = 0xFF  # in no UTF-8 text
_TABLE = np.array([xxhash.xxh64_intdigest(bytes([i]), 17) for i in range(256)], np.uint64)
_M = [np.uint64(xxhash.xxh64_intdigest(bytes([i]), 23) | 1) for i in range(7)]


# --- suffix arrays


def classify(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successor; t ends with a unique smallest value."""
    change = np.flatnonzero(t[:-1] != t[1:])
    run = np.diff(change, prepend=-1)  # all of a run of one value is classed by its end
    return np.append(np.repeat(t[change] < t[change + 1], run), True)


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The order of all suffixes from an order of the LMS ones."""
    n = len(t)
    counts = np.bincount(t, minlength=size)
    end = np.cumsum(counts)
    start = end - counts
    sa = np.full(n, -1, np.int32)
    placed = np.bincount(t[lms], minlength=size)
    order = np.argsort(t[lms], kind="stable")
    sorted_lms = lms[order]
    first = np.cumsum(placed) - placed
    c = t[sorted_lms]
    sa[end[c] - placed[c] + np.arange(len(lms)) - first[c]] = sorted_lms
    head = start.copy()

    def put(found: np.ndarray, low: bool) -> None:
        """Found suffixes, in scan order, at the front or back of their buckets."""
        c = t[found]
        order = np.argsort(c, kind="stable")
        found, c = found[order], c[order]
        at = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
        values, k = c[at], np.diff(at, append=len(c))
        rank = np.arange(len(c)) - np.repeat(at, k)
        if low:
            sa[head[c] + rank] = found
            head[values] += k
        else:
            sa[tail[c] - 1 - rank] = found
            tail[values] -= k

    def larger(chunk: np.ndarray) -> np.ndarray:
        p = chunk[chunk > 0] - 1
        return p[~small[p]]

    def smaller(chunk: np.ndarray) -> np.ndarray:
        p = chunk[chunk > 0] - 1
        return p[small[p]]

    used = np.flatnonzero(counts)
    for b in used.tolist():
        at = start[b]
        while at < head[b]:
            chunk, at = sa[at : head[b]].copy(), head[b]
            put(larger(chunk), True)
        if placed[b]:
            put(larger(sa[end[b] - placed[b] : end[b]]), True)
    tail = end.copy()
    for b in used[::-1].tolist():
        at = end[b]
        while at > tail[b]:
            chunk, at = sa[tail[b] : at][::-1].copy(), tail[b]
            put(smaller(chunk), False)
        if head[b] > start[b]:
            put(smaller(sa[start[b] : head[b]][::-1]), False)
    sa[0] = n - 1
    return sa


def _doubled(names: np.ndarray) -> np.ndarray:
    """The suffix order of a string of names, by doubling ranks."""
    r, k, n = names.astype(np.int64), 1, len(names)
    while True:
        key = (r + 1) * (r.max() + 2)
        key[: n - k] += r[k:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.cumsum(np.r_[0, s[1:] != s[:-1]])
        r = np.empty(n, np.int64)
        r[order] = rank
        k *= 2
        if rank[-1] == n - 1 or k >= 2 * n:
            return order


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of bytes, without the end marker."""
    t = np.append(data.astype(np.int16) + 1, np.int16(0)).astype(np.int16)  # 16 bits sort by radix
    return _sorted(t, 257)[1:]


def _sorted(t: np.ndarray, size: int) -> np.ndarray:
    """The order of the suffixes of a string of numbers below size that ends with its only 0."""
    if len(t) < 3:
        return np.arange(len(t))[::-1]
    small = classify(t)
    at = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = induce(t, small, at, size)
    is_lms = np.zeros(len(t), bool)
    is_lms[at] = True
    order = sa[is_lms[sa]]
    length = np.zeros(len(t), np.int32)
    length[at] = np.diff(np.r_[at, len(t) - 1]) + 1
    length[at[-1]] = 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    off = 0
    while len(live):
        live = live[off < length[a[live]]]
        ok = t[a[live] + off] == t[b[live] + off]
        same[live[~ok]] = False
        live = live[ok]
        off += 1
    name = np.empty(len(t), np.int32)
    names = np.cumsum(np.r_[0, ~same])
    name[order] = names
    if names[-1] < len(at) - 1:
        # The reduced string is sorted in the same way; one with so many names that a bucket holds next to nothing, by its ranks.
        order = at[_sorted(name[at], int(names[-1]) + 1) if names[-1] < MOST_NAMES else _doubled(name[at])]
    return induce(t, small, order, size)


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in order with the one before, through the permuted array.

    Only irreducible values are compared byte by byte; the others are one less than the value
    at the place before in the text.
    """
    n = len(data)
    phi = np.empty(n, np.int32)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    before = np.r_[0, data]  # before[i] is the byte ahead of i
    irreducible = (phi <= 0) | (np.arange(n) == 0) | (before[:n] != before[np.maximum(phi, 0)])
    plcp = np.zeros(n, np.int64)
    live = np.flatnonzero(irreducible & (phi >= 0))
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    word = np.zeros(n + 1, np.uint64)
    for k in range(8):
        word |= padded[k : n + 1 + k] << np.uint64(8 * k)
    length = np.zeros(len(live), np.int64)
    a, b, who = live.copy(), phi[live].astype(np.int64), np.arange(len(live))
    while len(who):
        room = np.minimum(n - a, n - b)
        x = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        low = x & (~x + np.uint64(1))
        equal = np.where(x == 0, 8, np.bitwise_count(np.maximum(low, np.uint64(1)) - np.uint64(1)) // 8)
        equal = np.minimum(equal, room)
        length[who] += equal
        on = (equal == 8) & (room > 8)
        a, b, who = a[on] + 8, b[on] + 8, who[on]
    plcp[live] = length
    last = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    plcp = np.maximum(plcp[last] - (np.arange(n) - last), 0)
    return plcp[sa]


# --- anchors


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of width values."""
    out, w = x, 1
    while w * 2 <= width:
        out = f(out[: len(out) - w], out[w:])
        w *= 2
    return f(out[: len(out) - (width - w)], out[width - w :]) if w < width else out


def anchors(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(twice the place, and 1 for the right side, hash of what all strings share, first string, last string) of anchors' sides; inside tells for each string start whether it is one."""
    if len(data) < LENGTH or not inside.any():
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    h, w, parts = _TABLE[data], 1, {}
    parts[1] = h
    for m in _M[:5]:
        h = h[: len(h) - w] * m + h[w:]
        w *= 2
        parts[w] = h
    n = len(data) - GRAM + 1
    g = parts[32][:n] * _M[5] + parts[8][32 : 32 + n]
    g ^= g >> np.uint64(32)
    g *= _M[6]
    g ^= g >> np.uint64(29)
    low = _slide(g, SPREAD, np.minimum)  # a value for each string
    low = np.where(inside, low, np.uint64(0))
    covered = _slide(np.r_[np.zeros(SPREAD - 1, np.uint64), low, np.zeros(SPREAD - 1, np.uint64)], SPREAD, np.maximum)
    place = np.flatnonzero(covered[: len(g)] == g)
    strings = np.flatnonzero(inside)
    owner = np.searchsorted(place, strings)
    live = np.arange(len(strings))
    while len(live):
        live = live[g[place[owner[live]]] != low[strings[live]]]
        owner[live] += 1
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    last = np.r_[first[1:] - 1, len(owner) - 1]
    own, low, high = place[owner[first]], strings[first], strings[last]
    left, right = np.flatnonzero(low <= own - SIDE), np.flatnonzero(high > own - SIDE)
    a, b = own[left], own[right]
    ids = np.concatenate([2 * a, 2 * b + 1])
    key = np.concatenate([g[a - SIDE] * _M[1] + g[a], g[b] * _M[2] + g[b + SIDE + 1]]) * _M[0]  # smallest hashes are small, so they are spread over the shards' ranges
    order = np.argsort(ids)
    firsts, lasts = np.concatenate([low[left], np.maximum(low[right], b - SIDE + 1)]), np.concatenate([np.minimum(high[left], a - SIDE), high[right]])
    return ids[order], (key ^ key >> np.uint64(32))[order], firsts[order], lasts[order]


class _Texts:
    """A block's documents, in order, as one run of bytes."""

    def __init__(self, table: pa.Table, key: str):
        table = table.append_column("_h", pa.array([xxhash.xxh64_intdigest(t) for t in table["_t"].cast(pa.binary()).to_pylist()], pa.uint64()))
        self.table = table.sort_by([(key, "ascending"), ("_h", "ascending")])  # NULL keys come last
        raw = self.table["_t"].cast(pa.binary()).to_pylist()
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.start = np.r_[0, np.cumsum(self.sizes)]
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of all pieces; the parts of one that was cut are joined."""
        found = []
        ends = self.start[1:]
        n = len(self.data)
        for s in range(0, n, PIECE):
            strings = np.arange(s, min(s + PIECE, n - LENGTH + 1))
            if not len(strings):
                break
            doc_end = ends[np.searchsorted(ends, strings, side="right")]
            p, h, a, b = anchors(self.data[s : s + len(strings) + LENGTH - 1], strings + LENGTH <= doc_end)
            found.append((p + 2 * s, h, a + s, b + s))
        if not found:
            return anchors(self.data[:0], np.zeros(0, bool))
        p, h, a, b = (np.concatenate(x) for x in zip(*found))
        new = np.r_[True, p[1:] != p[:-1]] if len(p) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        return p[at], h[at], a[at], np.maximum.reduceat(b, at) if len(at) else b


def _cuts(sorted_: np.ndarray, shards: int) -> list[int]:
    return [0, *np.searchsorted(sorted_, np.array([i * (1 << 64) // shards for i in range(1, shards)], np.uint64)).tolist(), len(sorted_)]


def _sorted_bytes(key: np.ndarray) -> bytes:
    gaps = np.diff(key, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return struct.pack("<IB", len(key), width) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_sorted_bytes(data: bytes) -> tuple[np.ndarray, int]:
    n, width = struct.unpack_from("<IB", data)
    low = np.zeros((n, 8), np.uint8)
    low[:, :width] = np.frombuffer(data, np.uint8, n * width, 5).reshape(n, width)
    return np.cumsum(low.view("<u8").ravel(), dtype=np.uint64), 5 + n * width


def _ask_anchors(texts: _Texts, shards: int) -> list[tuple[int, bytes]]:
    """Distinct anchor hashes, and whether they repeat in the block."""
    _, h, _, _ = texts.anchors()
    u, c = np.unique(h, return_counts=True)
    cuts = _cuts(u, shards)
    return [(s, _sorted_bytes(u[i:j]) + np.packbits(c[i:j] > 1).tobytes()) for s, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]


def _serve_anchors(asks: list[bytes]) -> list[bytes]:
    """A bit for each hash asked: it occurs more than once."""
    keys, more = [], []
    for a in asks:
        k, at = _from_sorted_bytes(a)
        keys.append(k)
        more.append(np.unpackbits(np.frombuffer(a, np.uint8, offset=at), count=len(k)))
    _, group, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    many = count + np.bincount(group, weights=np.concatenate(more), minlength=len(count)) > 1
    bits = many[group]
    ends = np.cumsum([len(k) for k in keys])
    return [np.packbits(bits[e - len(k) : e]).tobytes() for k, e in zip(keys, ends)]


def _ask_stretches(texts: _Texts, replies: dict[int, bytes], shards: int, key: str) -> list[tuple[int, bytes]]:
    """For each shard: documents, and distinct stretches with anchor hash, earliest place, and the places of its repeats in the block."""
    _, h, a, b = texts.anchors()
    u = np.unique(h)
    cuts = _cuts(u, shards)
    bits = [np.unpackbits(np.frombuffer(replies[s], np.uint8), count=j - i) for s, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
    if not bits:
        return []
    repeated = u[np.concatenate(bits).astype(bool)]
    on = np.flatnonzero(np.isin(h, repeated))
    h, a, b = h[on], a[on], b[on]
    doc = np.searchsorted(texts.start, a, side="right") - 1
    shard = np.searchsorted(np.array([i * (1 << 64) // shards for i in range(1, shards)], np.uint64), h, side="right")
    raw = texts.data.tobytes()
    ids, ties = texts.table[key].to_pylist(), texts.table["_h"].to_pylist()
    out = []
    for s in np.unique(shard).tolist():
        mine = np.flatnonzero(shard == s)
        first: dict[bytes, int] = {}
        again = []  # (place, length): later equal stretches of this block
        rows = []
        for i in mine.tolist():
            x, y = int(a[i]), int(b[i])
            text = raw[x : y + LENGTH]
            if text in first:
                again.append((x, y - x + 1))
            else:
                first[text] = len(rows)
                rows.append((int(h[i]), int(doc[i]), x - int(texts.start[doc[i]]), x, text))
        used = sorted({r[1] for r in rows})
        local = {d: k for k, d in enumerate(used)}
        head = struct.pack("<III", len(used), len(rows), len(again))
        docs = b"".join(struct.pack("<BqQI", ids[d] is None, ids[d] or 0, ties[d], d) for d in used)
        col = lambda v, kind: np.array(v, kind).tobytes()
        body = (
            col([r[0] for r in rows], "<u8") + col([local[r[1]] for r in rows], "<u4") + col([r[2] for r in rows], "<u8") + col([r[3] for r in rows], "<u8") + col([len(r[4]) for r in rows], "<u4")
            + col([x for x, _ in again], "<u8") + col([n for _, n in again], "<u4")
        )
        out.append((s, zs.ZstdCompressor(3).compress(head + docs + body + b"".join(r[4] for r in rows))))
    return out


def _read_stretches(data: bytes) -> tuple[list, dict[str, np.ndarray], np.ndarray, np.ndarray, list[bytes]]:
    raw = zs.ZstdDecompressor().decompress(data)
    n_docs, n, n_again = struct.unpack_from("<III", raw)
    docs = [struct.unpack_from("<BqQI", raw, 12 + 21 * i) for i in range(n_docs)]
    at, cols = 12 + 21 * n_docs, []
    for kind, k in (("<u8", n), ("<u4", n), ("<u8", n), ("<u8", n), ("<u4", n), ("<u8", n_again), ("<u4", n_again)):
        cols.append(np.frombuffer(raw, kind, k, at))
        at += k * int(kind[-1])
    ends = at + np.cumsum(cols[4], dtype=np.int64)
    texts = [raw[e - m : e] for e, m in zip(ends.tolist(), cols[4].tolist())]
    return docs, {"hash": cols[0], "doc": cols[1], "pos": cols[2], "place": cols[3]}, cols[5], cols[6], texts


def repeated_strings(texts: list[bytes], order: np.ndarray, offset: np.ndarray) -> list[np.ndarray]:
    """For each of distinct texts: which of its strings also start earlier, by (order, offset + place), in these texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(t + bytes([SEPARATOR]) for t in texts), np.uint8)
    start = np.r_[0, np.cumsum(sizes + 1)]
    sa = suffix_array(data)
    run = np.cumsum(common_prefixes(data, sa) < LENGTH)
    owner = np.searchsorted(start, sa, side="right") - 1
    place = sa - start[owner]
    real = place + LENGTH <= sizes[owner]
    owner, place, run = owner[real], place[real], run[real]
    key = np.lexsort((offset[owner] + place, order[owner], run))
    owner, place, run = owner[key], place[key], run[key]
    later = np.r_[False, run[1:] == run[:-1]]
    out = [np.zeros(m - LENGTH + 1, bool) for m in sizes.tolist()]
    flat = np.zeros(start[-1], bool)
    flat[start[owner] + place] = later
    for i, m in enumerate(sizes.tolist()):
        out[i] = flat[start[i] : start[i] + m - LENGTH + 1]
    return out


def _serve_stretches(asks: list[bytes]) -> list[bytes]:
    """For each block: places and lengths of runs of strings that start earlier elsewhere."""
    parts = [_read_stretches(a) for a in asks]
    docs = [(d[0], d[1], d[2], k, d[3]) for k, p in enumerate(parts) for d in p[0]]
    rank_of = np.empty(len(docs), np.int64)
    rank_of[sorted(range(len(docs)), key=docs.__getitem__)] = np.arange(len(docs))
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    part = np.concatenate([np.full(len(p[4]), k) for k, p in enumerate(parts)])
    row = np.concatenate([np.arange(len(p[4])) for p in parts])
    hash_ = np.concatenate([p[1]["hash"] for p in parts])
    order = np.concatenate([rank_of[base[k] + p[1]["doc"].astype(np.int64)] for k, p in enumerate(parts)])
    pos = np.concatenate([p[1]["pos"] for p in parts]).astype(np.int64)
    texts = [t for p in parts for t in p[4]]
    earliest: dict[bytes, int] = {}
    by_place = np.lexsort((pos, order))
    whole = np.zeros(len(texts), bool)
    for i in by_place.tolist():
        if earliest.setdefault(texts[i], i) != i:
            whole[i] = True
    heads = np.array(sorted(earliest.values()), np.int64)
    _, group, count = np.unique(hash_[heads], return_inverse=True, return_counts=True)
    several = heads[count[group] > 1]
    marks: dict[int, np.ndarray] = {}
    if len(several):
        marks = dict(zip(several.tolist(), repeated_strings([texts[i] for i in several.tolist()], order[several], pos[several])))
    out: list[list[tuple[int, int]]] = [list(zip(p[2].tolist(), p[3].tolist())) for p in parts]
    for i in range(len(texts)):
        at = int(parts[part[i]][1]["place"][row[i]])
        if whole[i]:
            out[part[i]].append((at, len(texts[i]) - LENGTH + 1))
        elif i in marks and marks[i].any():
            edge = np.flatnonzero(np.diff(np.r_[0, marks[i].astype(np.int8), 0]))
            out[part[i]] += [(at + int(x), int(y - x)) for x, y in zip(edge[::2], edge[1::2])]
    return [zs.ZstdCompressor(3).compress(np.array(x, "<u8").tobytes()) if x else b"" for x in out]


def _remove(texts: _Texts, replies: list[bytes], key: str) -> pa.Table:
    """For each document its bytes that stay, and the (start, end) of those that go."""
    runs = [np.frombuffer(zs.ZstdDecompressor().decompress(r), "<u8").reshape(-1, 2) for r in replies if r]
    n = len(texts.data)
    gone = np.zeros(n + 1, np.int32)
    for r in runs:
        at, k = r[:, 0].astype(np.int64), r[:, 1].astype(np.int64)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + k + LENGTH - 1, -1)
    removed = np.cumsum(gone[:n]) > 0
    kept_, spans = [], []
    for s, e in zip(texts.start[:-1].tolist(), texts.start[1:].tolist()):
        part = removed[s:e]
        edge = np.flatnonzero(np.diff(np.r_[0, part.astype(np.int8), 0]))
        spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
        kept_.append(texts.data[s:e][~part].tobytes() if len(edge) else texts.data[s:e].tobytes())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({key: texts.table[key], "n_bytes": pa.array(texts.sizes), "kept": pa.array(kept_, pa.binary()), "removed": pa.array(spans, span)})


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(key, n_bytes, kept, removed): the bytes that stay (kept.cast("string") is a text only where no character was cut), and the spans of bytes that go. key must be an integer column."""
    total = text_bytes(docs, text)
    n, shards = blocks_for(total, block), blocks_for(total, shard)
    base = docs.select(key, plain(text).alias("_t"))
    blocks = into_blocks(base, n, key, "_t")
    kind = docs.schema[key].dataType.simpleString()

    places = even_keys(shards)
    index = {x: i for i, x in enumerate(places)}

    def rows(block_id: int, got: list[tuple[int, bytes]]) -> pa.Table:
        return pa.table({"shard": pa.array([places[s] for s, _ in got], pa.int32()), "block": pa.array([block_id] * len(got), pa.int32()), "data": pa.array([b for _, b in got], pa.binary())})

    def served(f):
        def run(k: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by("block")
            return pa.table({"block": t["block"], "shard": pa.array([k[0].as_py()] * len(t), pa.int32()), "data": pa.array(f(t["data"].to_pylist()), pa.binary())})

        return run

    def second(k: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        return rows(k[0].as_py(), _ask_stretches(_Texts(t, key), {index[s]: d for s, d in zip(r["shard"].to_pylist(), r["data"].to_pylist())}, shards, key))

    grouped = blocks.groupBy("_block")
    first = grouped.applyInArrow(lambda k, t: rows(k[0].as_py(), _ask_anchors(_Texts(t, key), shards)), ASK).repartition(shards, "shard")
    known = first.groupBy("shard").applyInArrow(served(_serve_anchors), REPLY)
    asked = grouped.cogroup(known.groupBy("block")).applyInArrow(second, ASK).repartition(shards, "shard")
    marked = asked.groupBy("shard").applyInArrow(served(_serve_stretches), REPLY)
    return grouped.cogroup(marked.groupBy("block")).applyInArrow(
        lambda k, t, r: _remove(_Texts(t, key), r["data"].to_pylist(), key), f"`{key}` {kind}, n_bytes long, kept binary, removed array<struct<start:bigint,end:bigint>>"
    )


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of dedup's rows."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(key, "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
