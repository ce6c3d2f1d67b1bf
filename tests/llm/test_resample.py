"""Importance resampling against plain Python, on a whole table and on awkward rows; checksums of joined strings."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallystream.llm import crc
from tallystream.llm import queries as Q
from tallystream.llm import resample as R

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def reference(docs, target, percent=5, least=20):
    found = [(k, *features(t)) for k, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    out = []
    for k, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([k, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(out):
        r.append(None)
    for i, r in enumerate(order[: percent * len(order) // 100]):
        r[5] = i + 1
    return sorted(map(str, out))


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    got = Q.op12_importance_resampling(spark, D)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    rows = got.collect()
    want = reference(docs, target)
    words = {k: features(t)[0] for k, t in docs}
    assert sorted(str([r[0], words[r[0]], *r[1:]]) for r in rows) == want and sum(r.rank is not None for r in rows) > 3


def awkward():
    rng = random.Random(1)
    words = ["a", "B", "ÉÄ", "é", "the", "The", "x" * 700, "1", "日本", "nul\x00", "a-b", "_", "​", " "]
    return [None, "", " ", "\x00", "---"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(200)]


@pytest.mark.parametrize("ranges", [1 << 20, 16])
def test_awkward_rows_and_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(R, "ROWS", ranges)
    docs = [(i if i % 50 else None, t) for i, t in enumerate(awkward())]
    df = spark.createDataFrame(docs, "id long, words string").withColumn("_range", F.lit(1)).withColumn("_key", F.lit(2)).repartition(4)
    target = spark.createDataFrame([("the a É 1",), (None,)], "words string")
    got = R.draw(df, target, "id", "words", "words", percent=40)
    assert sorted(str(list(r)) for r in got.collect()) == reference(docs, ["the a É 1", None], 40)
    kept = R.drawn(df.filter("id IS NOT NULL"), target, "id", text="words", target_text="words", percent=40)
    assert kept.columns == df.columns and 0 < kept.count() < 200


def test_ties_repeated_and_empty(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(7, text)] * 60 + [(3, text)], "doc_id long, text string")
    got = R.draw(df, df.limit(0).select("text"), percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 31)) and len({(r.weight, r.score) for r in got if r.doc_id == 7}) == 1
    assert R.draw(df.limit(0), df).collect() == []


def test_tries(monkeypatch):
    monkeypatch.setattr(R, "ORDER", 3)
    texts = [t or "" for t in awkward()]
    trie = R.Trie(pa.array(["skipped", *texts]).slice(1))
    want = Counter(b for t in texts for b in features(t)[1])
    assert {b: n for b, n in enumerate(trie.totals(10000).tolist()) if n} == dict(want)
    assert trie.features().tolist() == [len(features(t)[1]) for t in texts]
    gains = np.random.default_rng(1).integers(-9, 9, 10000)
    assert trie.weights(gains).tolist() == [int(sum(gains[b] for b in features(t)[1])) for t in texts]
    assert R.Trie(pa.array([], pa.string())).totals(10).sum() == 0


def test_checksums_of_joined_strings():
    rng = random.Random(2)
    for most in (30, 70_000):
        a, b = ([rng.randbytes(rng.choice([0, 1, 9, rng.randint(0, most)])) for _ in range(500)] for _ in range(2))
        got = crc.joined(crc.of_each(a), crc.of_each(b), np.array([len(x) for x in b]))
        assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]
    assert len(crc.joined(*(np.zeros(0, np.uint32),) * 2, np.zeros(0, np.int64))) == 0
