"""Scores, ranks and matches on awkward keys and keywords; the chat path's parts; the completer's failures."""

import json
import random
import struct
import time
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallystream.functions import codec
from tallystream.functions.jurisdiction import detect_jurisdiction, with_detection_struct
from tallystream.functions.legal import create_legal_request
from tallystream.operators import automaton, chat, completion, gram_index, relational
from tallystream.plans import queries as plans
from tallystream.sources import tables

D = "/root/testdata/sf0.001"


def js(value):
    """ECMAScript's string of a JSON value inside an array; a ValueError for an object that has none."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return ",".join(map(js, value))
    if isinstance(value, dict):
        if "toString" in value:
            raise ValueError
        return "[object Object]"
    if isinstance(value, int | float):
        value = float(value)
        text = "0" if value == 0 else format(Decimal(repr(value)), "f") if 1e-6 <= abs(value) < 1e21 else repr(value)
        if "e" in text:
            digits, power = text.split("e")
            return f"{digits.removesuffix('.0')}e{int(power):+d}"
        return text.rstrip("0").rstrip(".") if "." in text else text
    return str(value)


TEXTS = [(1, "Germany Deutschland"), (1, "ایران german"), (None, "Germany"), (2, None), (3, ""), (None, None)]
WANT = {"Germany Deutschland": (0, 3, 0), "ایران german": (1, 1, 0), "Germany": (0, 2, 0), None: (0, 0, 0), "": (0, 0, 0)}


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(TEXTS, "id long, t string")


#: Limits of the three ways: literals, an automaton, the gram index.
WAYS = [(100, 1 << 18), (-1, 1 << 18), (-1, -1)]


def way(monkeypatch, limits):
    monkeypatch.setattr(relational, "LITERALS", limits[0])
    monkeypatch.setattr(relational, "AUTOMATON_BYTES", limits[1])


@pytest.mark.parametrize("limits", WAYS)
def test_scores_of_repeated_and_null_keys(spark, small, monkeypatch, limits):
    way(monkeypatch, limits)
    rules = plans.keywords(spark)
    got = sorted(map(str, ((r.id, r.code, r.score) for r in relational.keyword_scores(small, rules, "id", "t").collect())))
    assert got == sorted(str((i, c, WANT[t][k])) for i, t in TEXTS for k, c in enumerate(("IR", "DE", "US")))
    ranks = sorted(map(str, ((r.id, r.code, r.score, r["rank"]) for r in relational.ranked_scores(small, rules, "id", "t").collect())))
    want = []
    for i, t in TEXTS:
        order = sorted(range(3), key=lambda k: (-WANT[t][k], k))
        want += [str((i, ("IR", "DE", "US")[k], WANT[t][k], n + 1)) for n, k in enumerate(order)]
    assert ranks == sorted(want)
    matches = sorted(map(str, map(tuple, relational.keyword_matches(small, rules, "id", "t").collect())))
    assert matches == sorted(map(str, [(1, "DE", "germany"), (1, "DE", "german"), (1, "DE", "deutschland"), (1, "IR", "ایران"), (1, "DE", "german"), (None, "DE", "germany"), (None, "DE", "german")]))


@pytest.mark.parametrize("limits", WAYS)
def test_keywords_are_normalised(spark, small, monkeypatch, limits):
    way(monkeypatch, limits)
    rules = spark.createDataFrame([("DE", 0, " GERMANY "), ("IR", 0, "ايران"), ("IR", 1, None)], "code string, pos int, word string")
    assert sorted(map(str, map(tuple, relational.keyword_matches(small, rules, "id", "t").collect()))) == sorted(map(str, [(1, "DE", " GERMANY "), (1, "IR", "ايران"), (None, "DE", " GERMANY ")]))
    assert relational.keyword_scores(small, rules, "id", "t").filter("score > 0").count() == 3
    assert relational.keyword_scores(small.limit(0), rules, "id", "t").count() == 0


def test_plans(spark):
    df = plans.phrased(spark, D).withColumn("r", F.lit("x"))
    rules = plans.keywords(spark)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString() + x._jdf.queryExecution().executedPlan().toString()
    for x in (relational.keyword_scores(df, rules, "doc_id", "m"), relational.ranked_scores(df, rules, "doc_id", "m"), with_detection_struct(df, "m", "r"), df.select(detect_jurisdiction(F.col("m"), F.col("r")).alias("d"))):
        text = plan(x)
        assert "Exchange" not in text and "Join" not in text and "Python" not in text
        assert x._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") <= 25 and x._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 1


def test_numbers(spark):
    values = {1e21: "1e+21", 123456789.0: "123456789", 0.1: "0.1", -2.5: "-2.5", 1e-6: "0.000001", 1.5e-7: "1.5e-7", 1e20: "100000000000000000000", 1.7976931348623157e308: "1.7976931348623157e+308", 12345678.9: "12345678.9", 100.0: "100"}
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert {r.v: r.s for r in df.select("v", codec.js_number(F.col("v")).alias("s")).collect()} == values
    assert {v: js(v) for v in values} == values and js([0, -0.0, 10, 1e300, 2**70]) == "0,0,10,1e+300,1.1805916207174113e+21"


def test_chat_path_limit_and_files(spark, tmp_path):
    codec.allow_repeated_keys(spark)
    df = spark.createDataFrame([(1, '{"message":"' + "é" * 20 + '"}'), (2, '{"message":" "}'), (3, None)], "id long, body string")
    assert [tuple(r)[:2] for r in chat.answer(df, keep=("id",), limit=30).orderBy("id").collect()] == [(1, 413), (2, 200), (3, 500)]
    (tmp_path / "in.jsonl").write_text('{"message":"سلام"}\n{"message":1,"message":2}\n')
    got = chat.answer(tables.read_requests(spark, str(tmp_path / "in.jsonl")))
    tables.write_replies(got, str(tmp_path / "json"))
    tables.write_replies(got, str(tmp_path / "plain"), plain=True)
    plain = sorted(r.value for r in spark.read.text(str(tmp_path / "plain")).collect())
    assert plain == sorted([plans.responder.RULES[0][1], plans.responder.ECHO + "2"])
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "json")).select(codec.decode_reply(F.col("value"))).collect()) == plain
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "json")).collect()) == sorted('{"reply":"' + p + '"}' for p in plain)


def test_completer_answers_and_timeout(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 6)], "id long, m string").coalesce(1)

    def short(asks):
        return [(True, '{"choices":[{"message":{"content":"ok"}}]}') for a in asks if len(a["messages"][0]["content"]) != 3]

    got = {r.id: r.reply for r in completion.complete(df, "id", "m", short).collect()}
    assert got == {i: "ok" if i != 3 else completion.RELAY_ERROR[1] for i in range(1, 6)}

    def slow(asks):
        time.sleep(30)
        return []

    began = time.perf_counter()
    assert completion.complete(df.limit(1), "id", "m", slow, timeout=0.2).first().reply == completion.RELAY_ERROR[1]
    assert time.perf_counter() - began < 20


def brute(rows, rules):
    """(key, code, word) by Python's own search, on normalised strings without odd letters."""
    return sorted(str((k, c, w)) for k, t in rows for c, w in rules if w is not None and w.strip().lower() in (t or "").lower().strip())


@pytest.mark.parametrize("limits", WAYS)
def test_nested_short_repeated_and_empty_keywords(spark, monkeypatch, limits):
    """Few letters, so that all keywords nest and occur; rules that repeat, under several codes, empty and NULL."""
    way(monkeypatch, limits)
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcéz ") for _ in range(n))
    rows = [(rng.choice([None, 1, 2, i]), rng.choice([text(rng.randint(0, 60)), text(3000)])) for i in range(60)] + [(7, None), (8, "")]
    rules = [(rng.choice(["IR", "DE", "US", "XX", None]), text(rng.randint(1, 9)).strip() or "q") for _ in range(60)] + [("DE", ""), ("US", None), ("IR", "ab"), ("IR", "ab"), ("IR", "AB"), ("DE", "a" * 900)]
    df, given = spark.createDataFrame(rows, "_n long, t string").repartition(3), spark.createDataFrame(rules, "code string, word string")
    want = brute(rows, rules)
    assert sorted(str(tuple(r)) for r in relational.keyword_matches(df, given, "_n", "t").collect()) == want
    score = lambda k, t, code: len([1 for x in brute([(k, t)], rules) if f"'{code}'" in x.split(",")[1]])
    dense = sorted(str((k, c, score(k, t, c))) for k, t in rows for c in ("DE", "XX"))
    assert sorted(str(tuple(r)) for r in relational.keyword_scores(df, given, "_n", "t", ("DE", "XX")).collect()) == dense
    assert relational.keyword_matches(df.limit(0), given, "_n", "t").count() == 0
    assert relational.keyword_scores(df, given.limit(0), "_n", "t").filter("score <> 0").count() == 0


@pytest.mark.parametrize("n", [101, 9_999, 80_000])
def test_many_keywords(spark, n):
    """Literals end at 100; 80,000 keywords have more bytes than one automaton takes."""
    words = [f"{i * 7919 % 100_003:06d}" for i in range(n)]
    rules = spark.createDataFrame([("IR" if i % 3 else "US", w) for i, w in enumerate(words)], "code string, word string")
    rows = [(i, " ".join(words[j] for j in range(i, n, 97)) + " 1234567 99") for i in range(20)]
    text = dict(rows)
    got = {(r.id, r.code): r.score for r in relational.keyword_scores(spark.createDataFrame(rows, "id long, t string"), rules, "id", "t").collect()}
    for i, t in text.items():
        there = {t[k : k + 6] for k in range(len(t) - 5)}
        assert got[i, "US"] == sum(w in there for w in words[::3]) and got[i, "IR"] == sum(w in there for w in words) - got[i, "US"] and got[i, "DE"] == 0


def test_index_serves_keywords_that_arrive_later(spark, tmp_path):
    rows = [(i, f"text {i} of many, code{i % 7}x " + "filler " * 300) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(5)
    path = str(tmp_path / "index")
    gram_index.build(df, "id", "t", path, slice_bytes=20_000)
    slices = spark.read.parquet(f"{path}/slices").count()
    assert slices > 20
    for words in (["code3x", "text 39 "], ["nowhere", "code9x"], ["z", "39"]):
        rules = spark.createDataFrame([("IR", w) for w in words], "code string, word string")
        assert sorted(str(tuple(r)) for r in gram_index.matches(spark, path, rules, "id", "long").collect()) == brute(rows, [("IR", w) for w in words])
    held = lambda w: gram_index.candidates(spark, path, spark.createDataFrame([(0, w)], "id long, n string")).count()
    assert 1 <= held("text 39 ") < slices / 4 and held("nowhere") == 0 and held("") == slices


def test_automaton_reads_in_stretches(monkeypatch):
    monkeypatch.setattr(automaton, "STRETCH", 8)
    rng = random.Random(2)
    for _ in range(100):
        letters = "abcé"[: rng.randint(1, 4)]
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 30))]
        texts = ["".join(rng.choice(letters + "x") for _ in range(rng.choice([0, 1, 7, 8, 9, 300]))) for _ in range(rng.randint(0, 9))]
        row, word = automaton.Automaton([w.encode() for w in words]).find(pa.array(["skipped", *texts], pa.string()).slice(1))
        assert list(zip(row.tolist(), word.tolist())) == [(i, j) for i, t in enumerate(texts) for j, w in enumerate(words) if w in t]


def test_numbers_as_ecmascript_spells_them(spark):
    """Shortest digits that read back, as Python's repr has them too; Java's own are longer for some."""
    rng = random.Random(3)
    values = [5e-324, 1e-323, 2.2250738585072014e-308, 2e-44, 2e23, 9.5e-7, 1e23, 8.41e21, 9.999999999999999e22, 4.35e-10, 1e-7, 123456.7]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(63)))[0] for _ in range(1500)] + [rng.getrandbits(60) * 2.0 ** -rng.randint(0, 1100) for _ in range(500)]
    values = [v for v in values if v == v and v not in (0.0, float("inf"))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", codec.js_number(F.col("v")).alias("s")).collect():
        assert r.s == js(r.v), r


def test_statuses_of_odd_bodies(spark):
    codec.allow_repeated_keys(spark)
    ok = '{"message":"a"}'
    bodies = {None: 500, "": 500, " ": 400, ok: 200, f" \n{ok}\t": 200, ok + " trailing": 400, ok + ok: 400, ok + "]": 400, ok + "}": 400, ok + "]}": 400, ok + ',{"message":"b"}': 400, ok + ',"b":1': 400, "[1]": 200, "[1],[2]": 400, "[1]]": 400, "[1]}": 400, '{"message":5e-324}': 200}
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "_b long, body string")
    got = {r["_b"]: r for r in chat.answer(df, keep=("_b",)).collect()}
    for i, (b, status) in enumerate(bodies.items()):
        assert got[i].status == status and (got[i].reply is None) == (status == 400), b
        assert status != 500 or got[i].reply == plans.responder.SERVER_ERROR
    assert got[len(bodies) - 1].reply == plans.responder.ECHO + "5e-324"


def test_json_text(spark):
    rng = random.Random(4)
    texts = ["", '"', "\\", "\\u000B", "\x7f", "é😀‌", "\u2028", *("".join(chr(rng.choice([*range(33), 34, 92, 47, 117, 233])) for _ in range(rng.randint(1, 30))) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", codec.encode_reply(F.col("t")).alias("j"), codec.encode_request(F.col("t")).alias("r"))
    for r in df.collect():
        assert r.j == json.dumps({"reply": r.t}, ensure_ascii=False, separators=(",", ":")) and json.loads(r.r) == {"message": r.t}
    assert df.sparkSession.range(1).select(codec.encode_reply(F.lit(None).cast("string"))).first()[0] == "{}"


def test_names_of_kept_columns(spark):
    df = spark.createDataFrame([(1, "Germany")], "_m long, `a.b` string")
    assert create_legal_request(df, "a.b", keep=("_m",)).first().query == "Germany" and create_legal_request(df, "a.b", keep=("_m", "a.b")).columns[:2] == ["_m", "a.b"]


def test_arrays_of_any_depth_without_python(spark):
    rng = random.Random(5)

    def value(depth):
        kind = rng.randint(0, 9 if depth else 6)
        return [None, True, False, rng.choice([0, 1, -2.5, 1e21, 5e-324, 123456789012345678901]), rng.choice(["", "a", ",", "[x]", "é\"\\"]), {"a": 1}, {"toString": 1} if rng.random() < 0.1 else "s"][kind] if kind < 7 else [value(depth - 1) for _ in range(rng.randint(0, 4))]

    arrays = [[value(4) for _ in range(rng.randint(0, 5))] for _ in range(400)] + [[[[]]], [[], []], [[None]], []]
    deep = 1
    for _ in range(300):
        deep = [deep]
    arrays.append([deep, 2])
    df = spark.createDataFrame([(i, json.dumps({"message": a})) for i, a in enumerate(arrays)], "i int, b string").select("i", codec.decode_message(F.col("b")).alias("m"))
    for r in df.collect():
        try:
            want = js(arrays[r.i])
        except ValueError:
            want = None
        assert r.m == want, arrays[r.i]
    plan = plans.chat_path(spark, D)._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_slices_get_only_the_keywords_they_hold(spark, tmp_path, monkeypatch):
    """Keywords of common grams, which the rarest grams don't keep from a slice: what is shuffled follows the texts, not the keywords."""
    rng = random.Random(6)
    parts = ["".join(rng.choice("abcdé") for _ in range(4)) for _ in range(12)]
    word = lambda: "".join(rng.choice(parts) for _ in range(3))
    rows = [(i, " ".join(word() for _ in range(6)) + "-x.y " + "ab" * rng.randint(0, 3)) for i in range(120)]
    words = sorted({word() for _ in range(900)} | {"ab", "é", "no such", "-x.y", "b", *parts})
    rules = spark.createDataFrame([("IR" if i % 2 else "DE", w) for i, w in enumerate(words)], "code string, word string")
    df, path = spark.createDataFrame(rows, "id long, t string").repartition(4), str(tmp_path / "index")
    gram_index.pack(df, "id", "t", path, 1_000)
    given = spark.createDataFrame([(i, w, [1]) for i, w in enumerate(words) if w.isalnum()], "id long, n string, rules array<bigint>")
    got = gram_index.held(spark, path, given).groupBy("slice").count().collect()
    held = sum(any(w in t for _, t in rows) for w in words if w.isalnum())
    assert len(got) > 8 and max(r["count"] for r in got) <= held < len(words) - 50
    want = brute(rows, [tuple(r) for r in rules.collect()])
    found = gram_index.matches(spark, path, rules, "id", "long", by_runs=True).collect()
    assert sorted(str(tuple(r)) for r in found) == want
    monkeypatch.setattr(relational, "LITERALS", 0)
    monkeypatch.setattr(relational, "AUTOMATON_BYTES", 0)
    posted = []
    monkeypatch.setattr(gram_index, "post", lambda *_: posted.append(1))
    scores = relational.keyword_scores(df, rules.filter("word RLIKE '^[a-dé]+$'"), "id", "t", ["IR", "DE"]).collect()
    assert not posted and sum(r.score for r in scores) == len([x for x in want if "-x.y" not in x and "no such" not in x])
