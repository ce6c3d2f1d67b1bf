"""Transcripts of shuffled streams and paired streams, against the batch results."""

import random

from pyspark.sql import functions as F

from tallystream.operators import transcript
from tallystream.streaming import dialogue


def started(df, path, state):
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()


def joined(spark, path):
    out = {}
    for r in sorted(spark.read.parquet(path).filter("NOT late").collect(), key=lambda r: (r.conv_id, r.turn)):
        out[r.conv_id] = out.get(r.conv_id, "") + r.piece
    return out


LIKE = "conv_id long, turn long, role string, text string, at timestamp"


def write(spark, rows, path):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string")
    df.withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def minute(m):
    return f"2026-01-01 {m // 60:02d}:{m % 60:02d}:00"


def test_shuffled_turns_give_the_batch_transcript(spark, tmp_path):
    dialogue.use_rocksdb(spark)
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{t}", "<b>", "", None]), minute(t)) for c in range(12) for t in range(rng.randint(1, 9))]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    shuffled = rng.sample(rows, len(rows))
    for i in range(0, len(rows), 20):
        write(spark, shuffled[i : i + 20] + ([(None, 1, "user", "x", minute(0)), (1, None, "user", "x", minute(0))] if not i else []), source)
    stream = spark.readStream.schema(LIKE).option("maxFilesPerTrigger", 1).parquet(source)
    query = started(dialogue.transcripts(stream, "at", "1 hour", 60_000), out, state)
    assert query.awaitTermination(120) and len(query.recentProgress) > 2
    want = {r.conv_id: r.transcript for r in transcript.render(spark.createDataFrame([r[:4] for r in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert {k: v for k, v in joined(spark, out).items() if v} == {k: v for k, v in want.items() if v}


def test_a_missing_turn_is_given_up(spark, tmp_path):
    dialogue.use_rocksdb(spark)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run(rows):
        write(spark, rows, source)
        stream = spark.readStream.schema(LIKE).parquet(source)
        assert started(dialogue.transcripts(stream, "at", "30 minutes", 120_000, style="bare"), out, state).awaitTermination(120)

    text = lambda s: "".join(f"<div>🧑: {c}</div>" for c in s)
    run([(1, 0, "user", "a", minute(0)), (1, 2, "user", "c", minute(2)), (1, 5, "user", "f", minute(20)), (2, 1, "user", "z", minute(3))])
    assert joined(spark, out) == {1: text("a")}  # 2 and 5 wait for 1
    run([(None, None, "tick", None, minute(45)), (3, 0, "user", "n", minute(40))])
    assert joined(spark, out) == {1: text("ac"), 2: text("z"), 3: text("n")}  # 5 has a timer of its own
    run([(None, None, "tick", None, minute(120)), (1, 1, "user", "b", minute(50)), (3, 1, "user", "m", minute(50))])
    assert joined(spark, out) == {1: text("acf"), 2: text("z"), 3: text("nm")}
    assert [(r.turn, r.piece) for r in spark.read.parquet(out).filter("late").collect()] == [(1, text("b"))]


def test_pairs(spark, tmp_path):
    asks = [(c, t, f"q{c}{t}", f"2026-01-01 00:{t:02d}:{c:02d}") for c in range(5) for t in range(0, 20, 2)]
    answers = [(c, t, f"a{c}{t}", f"2026-01-01 00:{t:02d}:{c + 20:02d}") for c, t, *_ in asks if (c + t) % 3] + [(0, 0, "too late", "2026-01-01 00:09:00"), (9, 9, "nobody asked", "2026-01-01 00:10:00")]
    tick = "2026-01-02 00:00:00"
    for name, column, rows in (("asks", "text", [*asks, (-1, -1, "tick", tick)]), ("answers", "reply", [*answers, (-2, -2, "tick", tick)])):
        for part in (rows[: len(rows) // 2], rows[len(rows) // 2 : -1], rows[-1:]):
            spark.createDataFrame(part, f"c long, t long, {column} string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, column: spark.readStream.schema(f"c long, t long, {column} string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    both = dialogue.pairs(read("asks", "text"), read("answers", "reply"), ["c", "t"], "at", "2 minutes", "1 minute")
    started(both.withColumn("shown", dialogue.exchange_bubbles(F.col("text"), F.col("reply"), "bare")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {(r.c, r.t): (r.reply, r.shown) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    replied = {(c, t): a for c, t, a, _ in answers if a not in ("too late", "nobody asked")}
    for c, t, text, _ in asks:
        reply = replied.get((c, t))
        assert got[c, t] == (reply, f"<div>🧑: {text}</div>" + (f"<div>🤖: {reply}</div>" if reply else transcript.FAILED))
    assert set(got) - {(-1, -1)} == {(c, t) for c, t, *_ in asks}
