"""SimHash near-duplicates: exact links at a Hamming radius, by vantage-point trees.

Fingerprints come from 4-word shingles (see fingerprints). Equal ones collapse first, so a
group of copies costs one node. A 64-bit fingerprint is cut into m parts; two fingerprints
within RADIUS bits agree on at least m - RADIUS parts, so each set of that many parts gives a
family of shards (the fingerprints that share those parts' bits, distance zero in that
projection), each fingerprint lies in one shard of every family, and every link lies inside
at least one shard. m grows with the number of fingerprints, so that an even shard stays
small; while the fingerprints are few, only some bits of the parts are shared, so that a shard has
about BUCKET_ROWS fingerprints, and one with over MOST_ROWS is dealt by all of them. Inside a
shard a vantage-point tree splits fingerprints at the median distance from a
vantage point; queries go to the inner side, the outer side, or both if they are within
RADIUS of the boundary, and end at leaves that are compared in full, or at balls so small that all
in them are linked. A shard gives a spanning
star of each of its local components instead of all pairs. Stars of all shards are joined to
components by alternating large-star and small-star steps, each written to the shared folder.

Defined results: NULL texts are empty; texts without words have fingerprint zero and link
like any other; repeated rows and ties share a component; NULL ids never are the smallest,
unless a component has no other; an empty table gives none. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, kept, plain, slices

WORDS, SEED, RADIUS, LEAF, SHARD_ROWS, BUCKET_ROWS, MOST_ROWS = 4, 42, 4, 48, 4096, 512, 2048
_CHUNK = 255 * 256
#: Bytes of texts whose shingles a task holds at once.
SLICE_BYTES = 1 << 20
#: A key with more rows than this, and more than a MOST_HOT-th of all, is dealt over SALTS places.
HOT, MOST_HOT, SALTS = 256, 100_000, 32
#: Near copies: words of a shingle, least similarity, bits between fingerprints of candidates, bands of min-hashes, least and most rows of a chunk.
SHINGLE, SIMILAR, WIDE, BANDS, ROWS, LEAST_ROWS, CHUNK_ROWS = 5, 0.8, 22, 16, 4, 256, 8192
_MULT = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array([xxhash.xxh64_intdigest(bytes([i]), 71) | 1 for i in range(BANDS * ROWS)], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, bit 0 first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), _CHUNK):
        bits = np.unpackbits(h[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:  # sums of 255 rows fit a byte
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text."""
    w = text.encode().lower().split()  # both are ASCII only on bytes
    if not w:
        return 0
    joined = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        h = np.array([digest(joined, seed)], np.uint64)
    else:
        at = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = [0, *at[: len(w) - words].tolist()]
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (at[words - 1 :] - 1).tolist())), np.uint64, len(w) - words + 1)
    set_ = (bit_counts(h) * 2 > len(h)).astype(np.uint8)
    return int(np.packbits(set_, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(key, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t, words, seed) for t in b.column("_t").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(f.view(np.int64))], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, plain(text).alias("_t")).mapInArrow(run, f"`{key}` {kind}, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in each of n nodes' components."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


class VantageTree:
    """A tree over distinct fingerprints."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf, self.splits = points, leaf, 0
        self.root = self._build(np.arange(len(points)))

    def _build(self, ids: np.ndarray) -> tuple:
        if len(ids) <= self.leaf:
            return ("leaf", ids)
        vantage = self.points[ids[len(ids) // 2]]
        d = distance(self.points[ids], vantage)
        mid = int(np.median(d))
        inner = d <= mid
        if inner.all():  # the median is the largest distance
            mid -= 1
            inner = d <= mid
        if not inner.any() or inner.all():
            return ("leaf", ids)
        self.splits += 1
        return ("split", vantage, mid, self._build(ids[inner]), self._build(ids[~inner]))

    def within(self, point: np.uint64, radius: int) -> np.ndarray:
        """Indices of the points within radius of one."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node[0] == "leaf":
                out.append(node[1][distance(self.points[node[1]], point) <= radius])
                continue
            d = int(distance(node[1], point))
            if d <= node[2] + radius:
                stack.append(node[3])
            if d > node[2] - radius:
                stack.append(node[4])
        return np.concatenate(out)

    def links(self, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of indices that connect all points within radius: every such pair is joined by them, but not each is listed."""
        out_a, out_b = [], []
        stack = [(self.root, np.arange(len(self.points)))]
        while stack:
            node, asks = stack.pop()
            if not len(asks):
                continue
            if node[0] == "split":
                d = distance(self.points[asks], node[1]).astype(np.int64)
                stack += [(node[3], asks[d <= node[2] + radius]), (node[4], asks[d > node[2] - radius])]
                continue
            ids = node[1]
            wide = distance(self.points[ids], self.points[ids[0]])
            if len(ids) > 2 and 2 * int(wide.max()) <= radius:  # all of the leaf are linked: only those from outside ask
                out_a.append(ids[1:])
                out_b.append(np.full(len(ids) - 1, ids[0]))
                asks = np.setdiff1d(asks, ids)
            for k in range(0, len(asks), 1 << 14):
                part = asks[k : k + (1 << 14)]
                for j in range(0, len(ids), 64):
                    near = distance(self.points[part][:, None], self.points[ids[j : j + 64]][None, :]) <= radius
                    near &= part[:, None] != ids[j : j + 64][None, :]
                    rows = np.flatnonzero(near.any(axis=1))
                    if not len(rows):
                        continue
                    # Queries with the same hits are joined to one of them.
                    hits = near[rows]
                    _, first, same = np.unique(np.packbits(hits, axis=1), axis=0, return_index=True, return_inverse=True)
                    out_a.append(part[rows])
                    out_b.append(part[rows[first[same.ravel()]]])
                    r, c = np.nonzero(hits[first])
                    out_a.append(part[rows[first[r]]])
                    out_b.append(ids[j : j + 64][c])
        none = np.zeros(0, np.int64)
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def parts_for(n: int, radius: int = RADIUS, rows: int = MOST_ROWS) -> int:
    """Parts of a fingerprint so that an even shard of n fingerprints has so many at most."""
    m = radius + 1
    while m < radius + 5 and n / 2 ** (64 * (m - radius) / m) > rows:
        m += 1
    return m


def part_masks(m: int, radius: int = RADIUS) -> list[int]:
    """A mask for each set of m - radius of the m parts."""
    cuts = [round(64 * i / m) for i in range(m + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fewer_bits(mask: int, bits: int) -> int:
    """The lowest bits of a mask: what agrees in the mask agrees in these."""
    out = 0
    while mask and bits:
        out, mask, bits = out | mask & -mask, mask & (mask - 1), bits - 1
    return out


def stars(nodes: DataFrame, n: int, radius: int = RADIUS, rows: int = BUCKET_ROWS, most: int = MOST_ROWS) -> DataFrame:
    """(a, b): edges that connect what is linked, from distinct fingerprints in the column fp."""
    masks = part_masks(parts_for(n, radius, most), radius)
    few = [fewer_bits(m, max(0, (n // rows).bit_length() - 1)) for m in masks]
    pairs = list(dict.fromkeys(zip(few, masks))) if few[0] else [(0, masks[0])]  # without any bits all families would be the same
    shards = max(1, n * len(pairs) // SHARD_ROWS)
    family = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, (m, _) in enumerate(pairs)]))
    dealt = nodes.select("fp", family.alias("s")).select("fp", F.col("s.i").alias("i"), F.col("s.v").alias("v"))
    if few[0]:
        # A value with too many fingerprints is dealt by all bits of its parts. Its family's number tells both kinds apart.
        crowded = dealt.groupBy(F.col("i").alias("_i"), F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
        whole = F.element_at(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for _, m in pairs]), F.col("i") + 1)
        dealt = dealt.join(crowded, (F.col("i") == F.col("_i")) & (F.col("v") == F.col("_v")), "left")
        dealt = dealt.select("fp", F.when(F.col("_n").isNull(), F.col("i")).otherwise(F.col("i") + len(pairs)).alias("i"), F.when(F.col("_n").isNull(), F.col("v")).otherwise(whole).alias("v"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("i", "v"), F.lit(shards)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        fp, i, v = (t[c].to_numpy() for c in ("fp", "i", "v"))
        order = np.lexsort((fp, v, i))
        fp, i, v = fp[order].view(np.uint64), i[order], v[order]
        new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (v[1:] != v[:-1])])
        a, b = [], []
        for s, e in zip(new.tolist(), [*new[1:].tolist(), len(fp)]):
            if e - s < 2:
                continue
            x, y = VantageTree(fp[s:e]).links(radius)
            if len(x):
                label = local_components(e - s, x, y)
                apart = np.flatnonzero(label != np.arange(e - s))
                a.append(fp[s:e][apart])
                b.append(fp[s:e][label[apart]])
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("shard").applyInArrow(run, "a long, b long").distinct()


def hot_join(left: DataFrame, right: DataFrame, on: str, key: str, spread: str, rows: int) -> DataFrame:
    """left joined with right (one row a key) where left[on] = right[key]. left has about rows rows.

    Keys of many rows are dealt over SALTS places by a hash of left[spread], beside as many
    copies of their row of right. Hot keys have at least rows / MOST_HOT rows each, so there
    are at most MOST_HOT of them to broadcast.
    """
    hot = left.groupBy(F.col(on).alias("_hot")).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > max(HOT, rows // MOST_HOT)).select("_hot")
    hot = kept(hot)
    if not hot.first():
        return left.join(right, F.col(on) == F.col(key))
    salted = left.join(F.broadcast(hot), F.col(on) == F.col("_hot"), "left")
    salted = salted.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread, F.lit(3)), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    each = right.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_place", F.explode(copies)).drop("_hot")
    return salted.join(each, (F.col(on) == F.col(key)) & (F.col("_salt") == F.col("_place"))).drop("_salt", "_place")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node but the roots.

    Large-star and small-star alternate until nothing changes; each round's edges are written
    to the shared folder, and only counts and a checksum reach the driver. Hubs are dealt out.
    """
    e = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    sum_ = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    was = e.agg(F.count("u"), sum_).first()
    while was[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = hot_join(both.filter("v > u"), low, "u", "k", "v", was[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = kept(large)
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        moved = hot_join(large, low, "u", "k", "v", was[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = kept(moved.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("u"), sum_).first()
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def smallest(nodes: DataFrame, links: DataFrame, node: str, low: str) -> DataFrame:
    """(_node, component) for the linked nodes: the smallest low of each component. nodes has one row a node."""
    linked = kept(links.union(links.select(F.col("root").alias("node"), "root").distinct()))
    lows = linked.join(nodes.select(node, low), F.col("node") == F.col(node)).groupBy(F.col("root").alias("_root")).agg(F.min(low).alias("component"))
    return hot_join(linked, lows, "root", "_root", "node", linked.count()).select(F.col("node").alias("_node"), "component")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over links."""
    fps = kept(fingerprints(docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text")), "_id", "_text"))
    nodes = kept(fps.groupBy("fp").agg(F.min("_id").alias("low")))
    found = smallest(nodes, connected(stars(nodes.select("fp"), nodes.count(), radius)), "fp", "low")
    by_fp = nodes.join(found, F.col("fp") == F.col("_node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "low").alias("component_id"))
    by_fp = kept(by_fp)  # a plain table, so that a fingerprint of very many copies is split when it is joined
    return fps.join(by_fp, F.col("fp") == F.col("_fp")).select(F.col("_id").alias(key), "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- near copies by the similarity of their shingles


def shingle_hashes(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the distinct hashes of its runs of size words (of all its words, if there are fewer)."""
    out = []
    for t in texts:
        w = t.encode().lower().split()
        h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
        n = min(size, len(h))
        x = np.zeros(max(0, len(h) - n + 1) if n else 0, np.uint64)
        for k in range(n):
            x = x * _MULT + h[k : k + len(x)]
        x ^= x >> np.uint64(29)
        out.append(np.unique(x * _MULT))
    return out


def set_fingerprint(h: np.ndarray) -> int:
    """SimHash of a set of hashes."""
    return int(np.packbits((bit_counts(h) * 2 > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0]) if len(h) else 0


def band_keys(h: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band of smallest permuted hashes."""
    low = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(h), 1 << 14):
        x = h[i : i + (1 << 14), None] * _ODD[None, : bands * rows]
        low = np.minimum(low, (x ^ x >> np.uint64(32)).min(axis=0))
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = (key ^ low[r::rows]) * _MULT
        key ^= key >> np.uint64(31)
    return key


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def similar_stars(sets: list[np.ndarray], fp: np.ndarray, similarity: float = SIMILAR, radius: int = WIDE) -> list[tuple[int, int]]:
    """Pairs of indices that connect all sets of similarity or more: candidates by a vantage-point tree, nearest first, then the sets themselves.

    Two sets that are connected already aren't compared.
    """
    tree, n = VantageTree(fp), len(sets)
    label, out = np.arange(n), []
    size = np.array([len(s) for s in sets])
    for i in range(1, n):
        near = tree.within(fp[i], radius)
        near = near[(near < i) & (label[near] != label[i])]
        near = near[(np.minimum(size[near], size[i]) >= similarity * np.maximum(size[near], size[i]) - 1e-9)]
        near = near[np.lexsort((near, distance(fp[near], fp[i])))]
        while len(near):
            j, near = int(near[0]), near[1:]
            if jaccard(sets[i], sets[j]) >= similarity - 1e-9:
                out.append((i, j))
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
                near = near[label[near] != label[i]]
    return out


def similar_edges(texts: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """(a, b): edges that connect distinct texts of similar shingles. texts has u (a text's digest) and _text, one row a text."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_BYTES, 1):
            sets = shingle_hashes(b.column("_text").to_pylist())
            lists = [band_keys(h).view(np.int64) for h in sets]
            fp = np.array([set_fingerprint(h) for h in sets], np.uint64).view(np.int64)
            at = np.arange(0, len(sets) * BANDS + 1, BANDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column("u"), pa.array(fp), pa.ListArray.from_arrays(at, pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))], names=["u", "fp", "bands"])

    dealt = texts.select("u", "_text").mapInArrow(keys, "u string, fp long, bands array<long>").select("u", "fp", F.explode("bands").alias("band"))
    dealt = kept(dealt)
    counts = dealt.groupBy(F.col("band").alias("_b")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # A band that only one text has links nothing; one of very many texts is cut into chunks, and each two chunks meet.
    dealt = dealt.join(counts, F.col("band") == F.col("_b")).drop("_b")
    size = F.least(F.lit(CHUNK_ROWS), F.greatest(F.lit(LEAST_ROWS), F.pow(F.col("_n"), F.lit(2 / 3))))
    dealt = dealt.withColumn("_k", F.ceil(F.col("_n") / size).cast("int"))
    mine = F.pmod(F.xxhash64("u", F.lit(9)), F.col("_k")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    dealt = dealt.withColumn("_p", F.explode(pair)).select("u", "fp", "band", F.col("_p.i").alias("i"), F.col("_p.j").alias("j"))
    shard = F.pmod(F.xxhash64("band", "i", "j"), F.lit(1 << 20)).cast("int")

    def groups(t: pa.Table) -> pa.Table:
        """The members of each connected set of candidates, under a digest of the list, so that bands with the same members agree."""
        t = t.sort_by([("band", "ascending"), ("i", "ascending"), ("j", "ascending"), ("u", "ascending")])
        band, i, j = (t[c].to_numpy() for c in ("band", "i", "j"))
        fp, u = t["fp"].to_numpy().view(np.uint64), t["u"].to_pylist()
        cut = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]).tolist()
        ids, members, prints = [], [], []
        for s, e in zip(cut, [*cut[1:], len(u)]):
            points, place = np.unique(fp[s:e], return_inverse=True)
            x, y = VantageTree(points).links(WIDE)
            label = local_components(len(points), x, y)[place]
            order = np.argsort(label, kind="stable")
            at = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]]).tolist()
            for a, b in zip(at, [*at[1:], e - s]):
                if b - a > 1:
                    mine_ = sorted(u[s + k] for k in order[a:b].tolist())
                    ids += [xxhash.xxh3_128_hexdigest("".join(mine_))] * len(mine_)
                    members += mine_
        return pa.table({"g": pa.array(ids, pa.string()), "m": pa.array(members, pa.string())})

    found = dealt.withColumn("_shard", shard).groupBy("_shard").applyInArrow(groups, "g string, m string").distinct()

    def verified(t: pa.Table) -> pa.Table:
        t = t.sort_by([("g", "ascending"), ("m", "ascending")])
        g, m, text = t["g"].to_pylist(), t["m"].to_pylist(), t["_text"]
        a, b, s = [], [], 0
        while s < len(g):
            e = s + 1
            while e < len(g) and g[e] == g[s]:
                e += 1
            sets = shingle_hashes(text.slice(s, e - s).to_pylist())
            for x, y in similar_stars(sets, np.array([set_fingerprint(h) for h in sets], np.uint64), similarity):
                a.append(m[s + x])
                b.append(m[s + y])
            s = e
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    with_text = found.join(texts.select("u", "_text"), F.col("m") == F.col("u")).select("g", "m", "_text")
    return with_text.groupBy("g").applyInArrow(verified, "a string, b string").distinct()


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILAR) -> DataFrame:
    """One document of each group of near copies: texts whose sets of SHINGLE-word runs have a Jaccard similarity of similarity or more, and what these connect.

    Of a group the row of the smallest (key, digest of its text) stays, once; NULL keys count
    as larger than any. Texts without words are copies of each other. Candidates are texts
    that share a band of min-hashes and whose SimHash fingerprints lie within WIDE bits (by
    vantage-point trees in the bands' shards); what links is then decided on the sets.
    """
    name, first, id_ = fresh(docs, "_u"), fresh(docs, "_first"), fresh(docs, "_key")
    t = plain(f"`{text}`")
    digest = F.md5(F.when(F.rlike(t, F.lit(WORD)), t).otherwise(F.lit("")).cast("binary"))
    marked = docs.withColumn(name, digest)
    pairs = marked.select(F.col(name).alias("u"), F.col(f"`{key}`").alias("k"))
    order = F.struct(F.col("k").isNull().alias("n"), F.col("k").alias("k"), F.col("u").alias("u"))
    nodes = kept(pairs.groupBy("u").agg(F.min(order).alias("low")))
    texts = docs.select(digest.alias("u"), t.alias("_text")).groupBy("u").agg(F.any_value("_text").alias("_text"))
    found = smallest(nodes, connected(similar_edges(texts, similarity)), "u", "low")
    best = nodes.join(found, F.col("u") == F.col("_node"), "left").select(F.coalesce("component", "low").alias("c")).distinct()
    best = best.select(F.col("c.u").alias(first), F.col("c.k").alias(id_))
    return marked.join(best, (F.col(name) == F.col(first)) & F.col(f"`{key}`").eqNullSafe(F.col(id_))).drop(first, id_).dropDuplicates([name, key]).select(*[F.col(f"`{c}`") for c in docs.columns])
