import pytest
from oracle import compare
from pyspark.sql import functions as F

from tallystream.functions import codec, responder
from tallystream.functions.jurisdiction import KEYWORDS, detect_jurisdiction, with_detection
from tallystream.functions.legal import create_legal_request
from tallystream.functions.text import FOLD_FROM, FOLD_TO, JS_WS
from tallystream.operators import completion, relational, transcript
from tallystream.plans import queries as plans

D = "/root/testdata/sf0.001"

VECTORS = [
    (None, None, None, 0.0, "undetermined"), ("ایران", None, "IR", 0.65, "keyword"), ("ایرانی", None, "IR", 0.75, "keyword"),
    ("دادگاه ایران در تهران", None, "IR", 0.8500000000000001, "keyword"), ("قانون ایران و حقوق ایران در تهران و تبریز", None, "IR", 0.95, "keyword"),
    ("Germany", None, "DE", 0.75, "keyword"), ("religious law", None, "US", 0.65, "keyword"), ("german ایران", None, "IR", 0.5, "keyword"),
    ("germany american law united states", None, "DE", 0.5, "keyword"), ("آمريكا", None, "US", 0.65, "keyword"), ("united  states", None, None, 0.0, "undetermined"),
    ("unİted states", None, None, 0.0, "undetermined"), ("ایران", "de", "DE", 1.0, "explicit"), (None, "Us", "US", 1.0, "explicit"),
    ("ایران", "FR", "IR", 0.65, "keyword"), ("", " IR", None, 0.0, "undetermined"), ("", "ır", "IR", 1.0, "explicit"), ("GERMAN", "", "DE", 0.65, "keyword"),
]


@pytest.mark.parametrize("name", list(plans.oracle_sql()))
def test_oracle(spark, name):
    compare(spark, name, plans.queries()[name], plans.oracle_sql()[name], D)


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_vectors(spark):
    df = spark.createDataFrame([(i, q, r) for i, (q, r, *_) in enumerate(VECTORS)], "id int, q string, r string")
    wide = {x.id: (x.code, x.confidence, x.source) for x in with_detection(df, "q", "r").collect()}
    deep = {x.id: ((x.d.jurisdiction or {"code": None})["code"], x.d.confidence, x.d.source) for x in df.select("id", detect_jurisdiction(F.col("q"), F.col("r")).alias("d")).collect()}
    for i, v in enumerate(VECTORS):
        assert wide[i] == deep[i] == tuple(v[2:]), v


def test_constants():
    assert [len(w) for w in KEYWORDS.values()] == [9, 8, 8]
    assert [ord(c) for c in FOLD_FROM + FOLD_TO] == [0x64A, 0x649, 0x643, 0x6CC, 0x6CC, 0x6A9]
    assert len(set(JS_WS)) == 25 and "‌" not in JS_WS and "\u0085" not in JS_WS


def test_winner_matches_rank(spark):
    df = plans.phrased(spark, D)
    s = relational.keyword_scores(df, plans.keywords(spark), "doc_id", "m")
    a = {tuple(r) for r in relational.winners(s, "doc_id").collect()}
    b = {(r.doc_id, r.code, r.score) for r in relational.jurisdiction_rank(s, "doc_id").filter("rank = 1").collect()}
    assert a == b and {"IR", "DE", "US"} <= {x[1] for x in a if x[2]}


def test_plan_has_no_shuffle_or_python(spark):
    for df in (with_detection(plans.phrased(spark, D), "m"), create_legal_request(plans.phrased(spark, D), "m")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and plan.count("translate(") <= 1


def test_replies(spark):
    df = spark.createDataFrame([("  ",), ("‌",), ("  hi ",), ("چطوري",), (None,)], "m string")
    got = [r[0] for r in df.select(responder.rule_reply(F.col("m"))).collect()]
    assert got == [responder.BLANK_REPLY, responder.ECHO + "‌", responder.ECHO + "  hi ", responder.ECHO + "چطوري", responder.BLANK_REPLY]


def test_decode(spark):
    df = spark.createDataFrame([('{"message":[1,"a",null,[2,3]]}',), ('{"message":{"toString":1}}',), ("{bad",), ('{"message":1.0}',)], "b string")
    rows = df.select(codec.decode_message(F.col("b")), codec.uncoercible(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [("1,a,,2,3", False), ("[object Object]", True), (None, False), ("1", False)]


def test_completer_failure(spark):
    df = spark.createDataFrame([(1, "x")], "id long, m string")

    def bad(_):
        raise RuntimeError

    assert completion.complete(df, "id", "m", bad).collect()[0].reply == completion.RELAY_ERROR[1]
    assert completion.complete(df, "id", "m", bad, credential="NO_SUCH_KEY_SET").collect()[0].status == 500


def test_transcript_order_and_escape(spark):
    df = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "<b>"), (1, 2, "system", "x")], "conv_id long, turn long, role string, text string")
    got = transcript.render(df, escape=True).collect()[0].transcript
    assert got == transcript.BUBBLES["classes"][0] + "&lt;b&gt;</div>" + transcript.FAILED
