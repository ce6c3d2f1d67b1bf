"""Near copies by shingle similarity, against every pair; hubs in components; the choice of the row that stays."""

import random

import numpy as np
import pytest

from tallystream.llm import simhash


def sets(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def same(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def texts():
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(3000))
    out = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 40, 120, 400]))]
        for _ in range(rng.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w) + " " * rng.randrange(2))
        base[rng.randrange(len(base))] = "x"
    line = " ".join(word() for _ in range(30))
    out += [line + " " + " ".join(word() for _ in range(60)) for _ in range(20)]
    rows = [(i * 7 % 101, t) for i, t in enumerate(out)]
    return rows + [(500, None), (501, ""), (502, " \t"), (2, rows[5][1]), (rows[5][0], rows[5][1]), (rows[5][0], "other text of the same id"), (None, rows[9][1]), (None, "alone"), (None, "alone")]


def expected(rows):
    found = [sets(t or "") for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and same(found[i], found[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(x, []).append(rows[i])
    return [(min((k is None, k or 0) for k, _ in g), {t for _, t in g}) for g in groups.values()]


@pytest.mark.parametrize("chunk", [8192, 4])
def test_keep_one(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(simhash, "LEAST_ROWS", min(chunk, simhash.LEAST_ROWS))
    rows = texts()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _u string").repartition(4)
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    want = expected(rows)
    assert len(left) == len(want)
    for (null, k), of in want:
        mine = [(i, t) for i, t in left if t in of]
        assert len(mine) == 1 and (mine[0][0] is None, mine[0][0] or 0) == (null, k)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = random.Random(3)
    hit = tried = 0
    while tried < 300:
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        v = list(w)
        for _ in range(4):
            v[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        a, b = simhash.shingle_hashes([" ".join(w), " ".join(v)])
        if 0.8 <= simhash.jaccard(a, b) < 0.86:
            tried += 1
            near = (simhash.set_fingerprint(a) ^ simhash.set_fingerprint(b)).bit_count() <= simhash.WIDE
            hit += near and bool((simhash.band_keys(a) == simhash.band_keys(b)).any())
    assert hit >= 299


def test_tree_within():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    tree = simhash.VantageTree(fp, leaf=16)
    for p in fp[:20]:
        assert sorted(tree.within(p, 26).tolist()) == np.flatnonzero(simhash.distance(fp, p) <= 26).tolist()


def test_hubs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    edges = [(1, k) for k in range(2, 60)] + [(59, 70), (70, 71), (100, 101), (101, 102), (103, 102)]
    got = {r.node: r.root for r in simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in [*range(2, 60), 70, 71]}, **{k: 100 for k in (101, 102, 103)}}


def test_trees_split_and_find_all_links(spark):
    """Fingerprints of the table and planted neighbours: all links by brute force, whatever shards and trees are; trees do split."""
    rng = np.random.default_rng(9)
    fps = [r.fp for r in simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")).collect()]
    base = np.array(fps, np.int64).view(np.uint64)
    moved = base.copy()
    for _ in range(4):
        moved ^= np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)
    ball = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    fp = np.unique(np.concatenate([base, moved, ball, ball ^ np.uint64(3 << 40)]))
    near = np.array([simhash.distance(fp, x) <= 4 for x in fp])
    want = simhash.local_components(len(fp), *np.nonzero(near))
    nodes = spark.createDataFrame([(x,) for x in fp.view(np.int64).tolist()], "fp long")
    for rows, most in ((simhash.BUCKET_ROWS, simhash.MOST_ROWS), (64, 100), (8, 16), (10**6, 10**6)):
        edges = simhash.stars(nodes, len(fp), rows=rows, most=most).collect()
        place = {x: i for i, x in enumerate(fp.view(np.int64).tolist())}
        a, b = np.array([place[e.a] for e in edges]), np.array([place[e.b] for e in edges])
        assert (simhash.local_components(len(fp), a, b) == want).all()
    assert simhash.VantageTree(fp).splits > 10
