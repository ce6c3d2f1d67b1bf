"""What the pipeline's stages hold at once beside the JVM's heap: workers, copies of a text, stretches of a batch, jobs."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark import SparkContext

from tallystream.llm import decontaminate, simhash, toxicity


def rows(n=240):
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(300))
    return [(i, " ".join([word() for _ in range(40)] + ["vile", "scum"] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(n)]


def test_training_starts_no_workers_for_its_list(spark, monkeypatch):
    """A list that becomes rows by parallelize() leaves a daemon and Python workers in each executor."""
    df = spark.createDataFrame(rows(), "doc_id int, text string, toxic long").repartition(3)
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    for key in ("int", "string", "bigint", "decimal(12,2)"):
        d, other = (x.withColumn("doc_id", x.doc_id.cast(key)) for x in (docs, labels))
        want = toxicity.fit(sorted_rows(d, other), true_numbers(other))
        with monkeypatch.context() as m:
            m.setattr(SparkContext, "parallelize", lambda *a, **b: (_ for _ in ()).throw(AssertionError("parallelize")))
            got = toxicity.train(d, other)
        assert (got.toxic, got.ordinary, got.weights) == (want.toxic, want.ordinary, want.weights)


def sorted_rows(docs, labels):
    zlib = toxicity.zlib
    found = docs.join(labels.filter(toxicity.fold("doc_id", 3) != 1), "doc_id").collect()
    return [(r.text, int(r.toxic > 0)) for r in sorted(found, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))]


def true_numbers(labels):
    y = [r.toxic > 0 for r in labels.filter(toxicity.fold("doc_id", 3) != 1).collect()]
    return (len(y) - sum(y), sum(y))


def test_a_text_is_sent_once(spark, monkeypatch):
    model = toxicity.fit([(t, y) for _, t, y in rows()])
    df = spark.createDataFrame([(1, "vile scum w1", "x"), (2, None, "y"), (3, "", "z"), (4, "w1 w2", None)], "doc_id long, text string, _t string")
    sent = []
    frame = type(df)
    was = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: sent.append(self.columns) or was(self, *a, **b))
    for text, columns in (("text", 3), ("TEXT", 3)):
        got = toxicity.score(df, model, text)
        assert len(sent.pop()) == columns and got.columns == ["doc_id", "text", "_t", "score"]
        assert {tuple(r)[:3]: r.score for r in got.collect()} == {tuple(r): model.score(r.text or "") for r in df.collect()}
    # a text that the score replaces is still read
    assert [r.text for r in toxicity.score(df, model, "text", "text").sort("doc_id").collect()] == [model.score(t) for t in ("vile scum w1", "", "", "w1 w2")]


def test_words_compressed_together_are_bounded():
    model = toxicity.fit([(t, y) for _, t, y in rows()])
    rng = random.Random(6)
    texts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(1000)) for _ in range(200)]
    pair = toxicity.Pair(model.ordinary, model.toxic)
    alone = np.concatenate([pair.histograms([t]) for t in texts])
    seen, count = [], toxicity.Pair._count
    pair._count = lambda held, out: seen.append(sum(len(p) for _, p in held)) or count(pair, held, out)
    assert (pair.histograms(texts) == alone).all()
    assert max(seen) <= toxicity.HELD + 1000 and sum(seen) == 200_000 and len(seen) > 4


def test_the_bitmap_takes_one_job(spark):
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    h = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64)
    items = spark.createDataFrame(pa.table({"h": h}))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("bitmap", "bitmap")
        bits = decontaminate.bitmap_of(items)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap"))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = np.zeros(decontaminate.BITMAP_BITS, np.uint8)
    want[h.view(np.uint64) & np.uint64(decontaminate.BITMAP_BITS - 1)] = 1
    assert (np.unpackbits(bits, bitorder="little") == want).all()
    assert jobs <= 4
    assert not decontaminate.bitmap_of(items.limit(0)).any()


def test_shingles_are_held_for_a_stretch_of_a_batch(spark, monkeypatch):
    """Peak of the function that mapInArrow runs, on one batch of 10 MB."""
    rng = random.Random(7)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(250)) for _ in range(5000)]
    df = spark.createDataFrame([("a", "x")], "u string, _text string")
    kept = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: kept.append(f) or self.selectExpr("u", "0L AS fp", "array(1L) AS bands"))
    simhash.similar_edges(df)
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts)], names=["u", "_text"])
    tracemalloc.start()
    got = pa.Table.from_batches(list(kept[0](iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert got["u"].to_pylist() == [str(i) for i in range(len(texts))]
    sets = simhash.shingle_hashes(texts[::500])
    assert got["bands"].to_pylist()[::500] == [simhash.band_keys(s).view(np.int64).tolist() for s in sets]
    assert peak < 10
