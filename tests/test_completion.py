"""The completer's halving, circuit and log; the relay's path; a query that is stopped and started again."""

import json
import sys
import time
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallystream.functions import codec
from tallystream.operators import completion as C

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def said(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


def echo(asks):
    return [(True, said("re " + str(a["messages"][0].get("content", "-")))) for a in asks]


def test_only_failing_rows_fall_back(spark):
    def poison(asks):
        if any("bad" in a["messages"][0]["content"] for a in asks):
            raise ValueError
        return echo(asks)

    rows = [(i, "bad" if i in (3, 40, 41, 99) else f"m{i}") for i in range(100)]
    got = {r.id: r.reply for r in C.complete(spark.createDataFrame(rows, "id long, m string").coalesce(1), "id", "m", poison, batch=32, trip=20).collect()}
    assert got == {i: C.RELAY_ERROR[1] if m == "bad" else "re " + m for i, m in rows}


def test_dead_provider_costs_a_bounded_number_of_timeouts(spark):
    def dead(asks):
        time.sleep(60)
        return []

    df = spark.range(0, 10_000, numPartitions=2).select("id", F.concat(F.lit("m"), "id").alias("m"))
    began = time.perf_counter()
    got = C.complete(df, "id", "m", dead, timeout=0.5, retries=1, trip=4).collect()
    assert len(got) == 10_000 and {r.reply for r in got} == {C.RELAY_ERROR[1]} and time.perf_counter() - began < 20


def test_circuit_closes_again():
    calls = []

    def flaky(asks):
        calls.append(len(asks))
        if len(calls) <= 3:
            raise OSError
        return echo(asks)

    ask = [{"messages": [{"content": "x"}]}]
    caller = C.Caller(flaky, C.Patience(batch=1, trip=3, rest=0.2))
    assert caller.answers(ask * 10) == [(False, None)] * 10 and len(calls) == 3
    assert caller.answers(ask)[0] == (False, None) and len(calls) == 3
    time.sleep(0.25)
    assert all(ok for ok, _ in caller.answers(ask * 5)) and len(calls) == 8


def recorder(path):
    """A completer that notes each request in a file and fails for some."""

    def ask(asks):
        contents = [a["messages"][0].get("content", "none") for a in asks]
        with open(path, "a") as f:
            f.writelines(json.dumps(c) + "\n" for c in contents)
        return [(c != "fails", said("re " + c)) for c in contents]

    return ask


def asked(path):
    return Counter(json.loads(x) for x in path.read_text().splitlines())


def test_log_asks_once(spark, tmp_path):
    notes, log = tmp_path / "notes", str(tmp_path / "log")
    df = spark.createDataFrame([(i, f"m{i % 5}") for i in range(50)] + [(None, "m1"), (50, "fails"), (51, None)], "id long, m string").repartition(4)

    ask = recorder(notes)
    want = sorted(str((i, 200, "re " + m if m and m != "fails" else C.RELAY_ERROR[1] if m else "re none")) for i, m in df.collect())
    for batch in ("a", "a"):
        assert sorted(str(tuple(r)) for r in C.complete(df, "id", "m", ask, log=log, batch_id=batch).collect()) == want
        assert set(asked(notes).values()) == {1} and len(asked(notes)) == 7
    C.complete(df, "id", "m", ask, log=log, batch_id="b").collect()  # a later batch asks only what failed
    assert asked(notes) == Counter({f"m{i}": 1 for i in range(5)} | {"none": 1, "fails": 2})


def test_query_stopped_and_started_again(spark, tmp_path):
    source, notes, log, out = tmp_path / "in", tmp_path / "notes", str(tmp_path / "log"), tmp_path / "out"
    like = "id long, m string"
    spark.createDataFrame([(i, f"m{i}") for i in range(30)], like).write.parquet(str(source))
    stream = lambda: spark.readStream.schema(like).parquet(str(source))
    out.write_text("in the way")  # answers are logged, then writing them out fails
    with pytest.raises(Exception):  # noqa: B017
        C.completion_sink(stream(), "id", "m", recorder(notes), str(out), log, str(tmp_path / "state")).awaitTermination()
    assert len(asked(notes)) == 30
    out.unlink()
    for _ in range(2):
        C.completion_sink(stream(), "id", "m", recorder(notes), str(out), log, str(tmp_path / "state")).awaitTermination()
        spark.createDataFrame([(30, "m30"), (31, "m3")], like).write.mode("append").parquet(str(source))
    got = [(r.id, r.reply) for r in spark.read.parquet(str(out)).collect()]
    assert sorted(got) == [(i, f"re m{i}") for i in range(30)] + [(30, "re m30"), (31, "re m3")]
    assert set(asked(notes).values()) == {1} and len(asked(notes)) == 31


def test_relay(spark, monkeypatch):
    codec.allow_repeated_keys(spark)
    rows = [(1, '{"message":"a \\"b\\""}'), (2, '{"message":[1,{"x":null}]}'), (3, "{}"), (4, None), (5, "{bad"), (6, '{"message":"' + "x" * 200 + '"}'), (7, '{"message":null}'), (7, '{"message":"fail"}'), (None, '{"message":"none"}')]
    df = spark.createDataFrame(rows, "id long, b string")

    def provider(asks):
        out = []
        for a in asks:
            m = a["messages"][0]
            assert a["model"] == C.MODEL and m["role"] == "user"
            out.append((m.get("content") != "fail", "{}" if m.get("content") == "none" else said(json.dumps(m.get("content", "undefined")))))
        return out

    got = sorted((str(r.id), r.status, r.reply or "", r.response or "") for r in C.relay(df, "id", "b", provider, limit=100).collect())
    text = lambda x: json.dumps({"reply": x}, ensure_ascii=False, separators=(",", ":"))
    bad = C.RELAY_ERROR[1]
    want = [("1", 200, '"a \\"b\\""'), ("2", 200, '[1, {"x": null}]'), ("3", 200, '"undefined"'), ("4", 200, '"undefined"'), ("7", 200, "null"), ("7", 200, bad), ("None", 200, bad)]
    assert got == sorted([(i, s, r, text(r)) for i, s, r in want] + [("5", 400, "", ""), ("6", 413, "", "")])
    none = C.relay(df, "id", "b", provider, credential="NO_SUCH_KEY_SET", limit=100)
    assert Counter(r.status for r in none.collect()) == {500: 7, 400: 1, 413: 1} and none.filter("status = 500").first().reply == C.MISSING_KEY[1]
