"""SQL functions against the column functions, sources and sinks of records, observed counts."""

import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallystream.functions import jurisdiction, responder, sql
from tallystream.operators import chat
from tallystream.plans import queries as plans
from tallystream.sources import tables
from tallystream.streaming import metrics
from test_engine import D, VECTORS


def test_sql_functions(spark):
    sql.register(spark)
    df = spark.createDataFrame([(i, q, r) for i, (q, r, *_) in enumerate(VECTORS)], "id int, q string, r string")
    got = spark.sql("SELECT id, detect_jurisdiction(q, r) AS d, rule_reply(q) AS reply FROM {df}", df=df)
    for r in got.collect():
        assert ((r.d.jurisdiction or {"code": None})["code"], r.d.confidence, r.d.source) == tuple(VECTORS[r.id][2:])
    assert {r.id: r.reply for r in got.collect()} == {r.id: r.y for r in df.select("id", responder.rule_reply(F.col("q")).alias("y")).collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    hits = spark.sql("SELECT id, k.code, k.word FROM {df}, LATERAL keyword_hits(q) k WHERE id = 8", df=df).collect()
    assert {(r.code, r.word) for r in hits} == {("DE", "germany"), ("DE", "german"), ("US", "american law"), ("US", "united states")}
    assert sql.literal("it's \\n") == "'it\\'s \\\\n'" and spark.sql("SELECT " + sql.literal("it's \\n")).first()[0] == "it's \\n"


BODIES = ['{"message":\n "سلام"\n}', '{"message":"a\\nb"}', "", "{bad", '{"message":"' + "x" * 300 + '"}', '{"message":"plain"}']


def test_records_with_line_feeds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text("".join(b + tables.RECORD_END for b in BODIES))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # splits fall inside bodies
    try:
        got = chat.answer(tables.read_requests(spark, str(tmp_path / "in"), tables.RECORD_END), limit=200)
        assert sorted(r.status for r in got.collect()) == sorted([200, 200, 500, 400, 413, 200] * 3)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    marked = got.filter("reply IS NOT NULL").withColumn("p", F.contains("reply", F.lit("plain")))
    tables.write_replies(marked, str(tmp_path / "out"), plain="p", end=tables.RECORD_END)
    want = [json.dumps({"reply": r.reply}, ensure_ascii=False, separators=(",", ":")) if not r.p else r.reply for r in marked.collect()]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out"), lineSep=tables.RECORD_END).collect()) == sorted(want)
    stream = chat.answer(tables.stream_requests(spark, str(tmp_path / "in"), tables.RECORD_END), limit=200).filter("reply IS NOT NULL")
    for _ in range(2):  # the second run finds nothing new
        assert tables.stream_replies(stream.withColumn("p", F.contains("reply", F.lit("plain"))), str(tmp_path / "streamed"), str(tmp_path / "state"), plain="p", end=tables.RECORD_END).awaitTermination(120)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "streamed"), lineSep=tables.RECORD_END).collect()) == sorted(want)


def test_failed_task_leaves_no_output(spark, tmp_path):
    df = spark.range(0, 100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("reply"))
    with pytest.raises(Exception, match="no"):
        tables.write_replies(df, str(tmp_path / "out"), mode="errorifexists")
    assert not [p for p in (tmp_path / "out").rglob("*") if p.name.startswith(("part-", "_SUCCESS")) and "_temporary" not in str(p)]


def test_observed_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.txt").write_text("".join(b + tables.RECORD_END for b in BODIES))
    seen, want = Observation(), {"requests": 12, "answered": 6, "too_large": 2, "malformed": 2, "failed": 2, "fallback": 0}
    metrics.observed(chat.answer(tables.read_requests(spark, str(tmp_path / "in"), tables.RECORD_END), limit=200), seen).collect()
    assert seen.get == want
    log = metrics.MetricsLog("chat")
    spark.streams.addListener(log)
    try:
        source = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"), lineSep=tables.RECORD_END).select(F.col("value").alias("body"))
        query = metrics.observed(chat.answer(source, limit=200), "chat").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(50):
            if len(log.rows) == 2:
                break
            __import__("time").sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert [r["requests"] for r in log.rows] == [6, 6]
    total = log.table(spark).groupBy().sum().first().asDict()
    assert {n: total[f"sum({n})"] for n in want} == want


@pytest.mark.parametrize("name", ["stream_bubbles", "stream_detect"])
@pytest.mark.parametrize("parts", [1, 3])
def test_streams_of_tables_in_parts(spark, tmp_path, name, parts):
    """A table may be one file or a folder of part files."""
    for t in ("conversations", "documents"):
        spark.read.parquet(f"{D}/{t}.parquet").repartition(parts).write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = lambda d: sorted(map(str, plans.queries()[name](spark, d).collect()))
    got = rows(str(tmp_path))
    assert got and got == rows(D)


@pytest.mark.parametrize("name", ["stream_bubbles", "stream_detect"])
@pytest.mark.parametrize("how", ["pattern", "old"])
def test_streams_of_tables_with_odd_files(spark, tmp_path, name, how):
    """Files named like patterns are read once, and ones dated long before 1970 too."""
    for t in ("conversations", "documents"):
        spark.read.parquet(f"{D}/{t}.parquet").repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
        part = min((tmp_path / f"{t}.parquet").glob("part-*"))
        os.utime(part, (-1e6, -1e6)) if how == "old" else part.rename(part.with_name("part[0].parquet"))
    rows = lambda d: sorted(map(str, plans.queries()[name](spark, d).collect()))
    got = rows(str(tmp_path))
    assert got and got == rows(D)


def test_jurisdiction_dim_normalises_a_text_once(spark):
    plan = plans.queries()["jurisdiction_dim"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and plan.count("Contains(") == sum(map(len, jurisdiction.KEYWORDS.values()))


def test_keyword_hits_without_join(spark):
    plan = plans.queries()["sql_keyword_hits"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("translate(") == 1
    rows = [(1, None), (1, ""), (1, "Germany"), (None, "ايران"), (1, "Germany")]
    hits = spark.sql("SELECT i, k.word FROM {p}, LATERAL keyword_hits(t) k", p=spark.createDataFrame(rows, "i int, t string")).collect()
    assert sorted(map(str, map(tuple, hits))) == sorted(map(str, [(1, "germany"), (1, "german")] * 2 + [(None, "ایران")]))
    assert [r.code for r in spark.sql("SELECT code FROM keyword_hits('Germany')").collect()] == ["DE", "DE"]
