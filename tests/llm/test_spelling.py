"""Spelling variants against plain Python: words, links of all pairs, forms and roots; hot segments, awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallystream.llm import queries as Q
from tallystream.llm import spelling as S

D = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def word_counts(docs):
    n = Counter()
    for key, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return n


def pairs_of(words):
    """All pairs one edit apart: words that become equal when a letter is taken from one or replaced by a mark in both."""
    seen = defaultdict(set)
    for w in words:
        seen[w].add(w)
        for i in range(len(w)):
            seen[w[:i] + w[i + 1 :], "cut"].add(w)
            seen[w[:i] + "\0" + w[i + 1 :], "mark"].add(w)
    out = set()
    for k, ws in seen.items():
        if isinstance(k, tuple) and k[1] == "mark":
            out |= {(a, b) for a in ws for b in ws if a < b}
        elif isinstance(k, tuple) and k[0] in words:
            out |= {(min(k[0], b), max(k[0], b)) for b in ws if b != k[0]}
    return out


def reference(n):
    near = defaultdict(set)
    for a, b in pairs_of(set(n)):
        near[a].add(b)
        near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    root = {}
    for w in n:
        root[w] = w
        while root[w] in form:
            root[w] = form[root[w]]
    return sorted(str((w, form.get(w), root[w], n[w], len(near[w]), n[form[w]] if w in form else None)) for w in n)


def shown(df):
    return sorted(str((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect())


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    got = Q.op13_spelling_variants(spark, D)
    assert sorted(got.dtypes) == sorted([("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")])
    want = reference({w: c for w, c in word_counts(docs).items() if c >= 3})
    assert shown(got) == want and len(want) > 100


def vocabulary():
    """Words over few letters, so segments are hot and all kinds of edits are there; chains of counts; long words."""
    rng = random.Random(1)
    letters = "abcé÷"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(4000)}
    words |= {"prefix" + "".join(rng.choice(letters) for _ in range(5)) for _ in range(500)} | {"".join(rng.choice(letters) for _ in range(5)) + "suffix" for _ in range(500)}
    long = "x" * 3000
    words |= {long, long + "x", "y" + long, long[:1500] + "z" + long[1501:], "aab", "aaab", "aabb"}
    return {w: rng.choice([3, 6, 7, 12, 50, 200, 999]) for w in sorted(words)}


@pytest.mark.parametrize("hot", [S.HOT, 2])
def test_all_links_of_hot_segments(spark, hot):
    n = vocabulary()
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    found = [tuple(r) for r in S.links(df, hot).select("word", "near", "n", "near_n").collect()]
    assert len(found) == len(set(found)) and {(min(a, b), max(a, b)) for a, b, *_ in found} == pairs_of(set(n)) and len(found) == len(pairs_of(set(n)))
    assert all(n[a] == x and n[b] == y for a, b, x, y in found)
    if hot != S.HOT:
        assert shown(S.variants(df, hot=hot)) == reference(n)


def test_chains_of_forms(spark):
    n = {"a" * 5 + chr(97 + i) * i: 3 * 2**i for i in range(1, 2)} | {"aaaa" + "b" * i: 3 * 2**i for i in range(1, 30)}
    assert shown(S.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == reference(n)


def test_words_of_awkward_texts(spark):
    rng = random.Random(2)
    parts = ["Straße", "ÀÉÎÕÜ", "÷×÷×÷", "hello", "HELLO", "Ωmega", "wörld", "naïve", "ab", "ﬁnest", "Łódźa", "x1yyyyy", "日本hello日本", " ", "-", "\x00", "a" * 4000]
    docs = [(None, "hello Hello hELLO"), (1, None), (2, ""), (3, "  "), (4, "wörld"), (4, "wörld"), (4, "wörld")]
    docs += [(i % 90, "".join(rng.choice(parts) + rng.choice(["", " ", "é", "\n"]) for _ in range(rng.randint(0, 50)))) for i in range(400)]
    df = spark.createDataFrame(docs, "id long, t string").withColumn("_t", F.lit(1)).withColumn("word", F.lit("x")).repartition(3)
    got = {r.word: r.n for r in S.words(df, "id", "t").collect()}
    assert got == {w: c for w, c in word_counts(docs).items() if c >= 3}
    names, n = S.counted(["1", "2"], pa.array(["zzzzz", "ab cdefg", "cdefg"]).slice(1), typo=None)
    assert dict(zip(names.to_pylist(), n.tolist())) == {"cdefg": 2}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.variants(S.words(none)).collect() == []
    assert S.variants(S.words(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))).collect() == []
    assert shown(S.variants(spark.createDataFrame([("alone", 3)], "word string, n long"))) == reference({"alone": 3})
