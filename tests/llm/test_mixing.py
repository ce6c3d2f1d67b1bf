"""Mixing against a plain-Python version of quotas, seeded blocks and texts."""

import heapq
import random
import re
from collections import Counter, defaultdict

import pytest

from tallystream.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(9)
    out = [(1, "only three words", "tiny", "en"), (2, None, "nothing", "en"), (3, "", "nothing", None), (4, " a  b\tc\n", None, "x")]
    for i in range(5, 120):
        out.append((i, " ".join(f"w{i}_{k}" for k in range(rng.choice([1, 7, 31, 32, 33, 200, 1500]))), rng.choice(["big", "big", "big", "mid"]), "de"))
    return [*out, out[10], out[10], (None, "no id at all", "mid", "fr")]


def targets(data):
    size = Counter()
    for _, t, s, _ in data:
        size[s] += len(WORDS.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in full)
        want = {s: 3 * size[s] if s in full else (total - sum(3 * size[x] for x in full)) * weight[s] / free for s in names}
        over = {s for s in names if want[s] > 3 * size[s] + 1e-9}
        if not over:
            return size, want
        full |= over


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, source string, lang string").repartition(4)


@pytest.mark.parametrize("shard_words", [500, 1 << 18])
def test_figures_and_texts(spark, docs, shard_words):
    data = rows()
    size, want = targets(data)
    got = mixing.mix(docs, shard_words=shard_words, block=8).collect()
    taken = defaultdict(int)
    source = {i: s for i, _, s, _ in data}
    for r in got:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * sum(size.values()) and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    # words by highest quotients, one at a time
    votes = {s: w for s, w in want.items() if w > 0}
    heap = [(-v, (s is None, s or ""), s, 0) for s, v in votes.items()]
    heapq.heapify(heap)
    seats = Counter()
    for _ in range(round(sum(want.values()))):
        _, order, s, k = heapq.heappop(heap)
        seats[s] += 1
        heapq.heappush(heap, (-votes[s] / (2 * k + 3), order, s, k + 1))
    assert {s: n for s, n in taken.items() if n} == dict(seats)
    texts = mixing.corpus(docs, shard_words=shard_words, block=8)
    assert texts.columns == ["doc_id", "text", "source", "lang", "copy", "words"]
    again = mixing.corpus(docs.repartition(7), shard_words=shard_words, block=8)
    mixed = texts.collect()
    assert Counter(map(tuple, mixed)) == Counter(map(tuple, again.collect()))
    by_doc, by_key = Counter(), Counter()
    whole = defaultdict(set)
    for i, t, _, _ in data:
        whole[i].add(t)
    for r in mixed:
        assert len(WORDS.findall(r.text)) == r.words > 0
        own = next(iter(whole[r.doc_id]))
        if r.text not in whole[r.doc_id]:
            it = iter(WORDS.findall(own))
            assert all(w in it for w in r.text.split(" "))  # in the order of the text
        by_doc[r.doc_id] += r.words
    for r in got:
        by_key[r.doc_id] += r.taken
    assert {k: n for k, n in by_key.items() if n} == dict(by_doc)


def test_blocks_are_chosen_by_seed(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(40)), s) for i, s in enumerate(["a"] * 60 + ["b"] * 10)], "doc_id long, text string, source string")
    one, two = (mixing.corpus(docs, seed=x, weights=(1, 3)).filter("source = 'a'") for x in (1, 2))
    assert sum(r.words for r in one.collect()) == sum(r.words for r in two.collect()) and {r.text for r in one.collect()} != {r.text for r in two.collect()}
    parts = [r for r in one.collect() if r.words < 40]
    assert len(parts) > 5  # blocks lie apart, not in one stretch


def test_no_rows(docs):
    assert mixing.corpus(docs.limit(0)).count() == mixing.mix(docs.limit(0)).count() == 0
    assert mixing.corpus(docs.filter("source = 'nothing'")).count() == 0 and mixing.mix(docs.filter("source = 'nothing'")).count() == 2
