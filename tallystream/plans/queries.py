"""Registered queries of the chat and legal operators, with their DuckDB counterparts.

The driver's text tables hold none of the keywords, so each row gets a phrase in front,
chosen by its key; Spark and DuckDB share the list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, responder
from ..functions import sql as sql_functions
from ..functions.jurisdiction import CODES, JURISDICTIONS, KEYWORDS, jurisdiction_struct, jurisdictions, keywords, with_detection, with_detection_struct, with_scores
from ..functions.legal import ASSISTANT, PROMPT_HEAD, PROMPT_TAIL, UNKNOWN, create_legal_request, legal_system_prompt
from ..functions.text import FOLD_FROM, FOLD_TO, JS_WS, normalize_text
from ..operators import chat, completion, gram_index, relational, transcript
from ..sources.shared import delete, shared_folder
from ..sources.tables import table
from ..streaming import dialogue, metrics, stream

PHRASES = [
    "", "ایران", "ایرانی", "قانون ایران", "دادگاه ایران در تهران", "قانون ایران و حقوق ایران در تهران و تبریز", "Germany", "GERMAN",
    "Deutsches Recht in Deutschland", "united states", "religious law", "german ایران", "germany american law united states",
    "Germany ایران", "ايران", "آمريكا", "ایرانى", "درشت", "ایالات متحده آمریکا", "french law", "german german german",
    "united  states", "american laws and previous lawsuits", "ایران آلمان آمریکا", "Iran", "حقوق آمریکا و قانون آمریکا و دادگاه آمریکا", "أمريكا",
]
REQUESTED = [None, "ir", "DE", "FR", " us"]
CHAT = ["", "   ", "\t", " ", "سلام", "چطوری", "چطوری سلام", "سلامت باشید", "چطوري", "  hi ", "‌", " a "]
ROUTES = [("GET", "/"), ("GET", "/ping"), ("POST", "/chat"), ("POST", "/"), ("GET", "/nope")]
#: Request bodies made of each conversation row: a name, Spark SQL over (conv_id, m, j) and DuckDB SQL over the same, j being m as JSON.
FORMS = [
    ("string", "concat('{\"message\":', j, '}')", "'{\"message\":' || j || '}'"),
    ("spaced", "concat(' {\"a\":[], \"message\" : ', j, '}\\n')", "' {\"a\":[], \"message\" : ' || j || '}' || chr(10)"),
    ("number", "concat('{\"message\":', conv_id, '}')", "'{\"message\":' || conv_id || '}'"),
    ("digits", "concat('{\"message\":\"', conv_id, '\"}')", "'{\"message\":\"' || conv_id || '\"}'"),
    ("true", "'{\"message\":true}'", "'{\"message\":true}'"), ("false", "'{\"message\":false}'", "'{\"message\":false}'"), ("null", "'{\"message\":null}'", "'{\"message\":null}'"),
    ("no_message", "concat('{\"text\":', j, '}')", "'{\"text\":' || j || '}'"), ("list", "concat('[', j, ']')", "'[' || j || ']'"),
    ("array", "concat('{\"message\":[', conv_id, ',', j, ',null,[true]]}')", "'{\"message\":[' || conv_id || ',' || j || ',null,[true]]}'"),
    ("object", "concat('{\"message\":{\"a\":', j, '}}')", "'{\"message\":{\"a\":' || j || '}}'"), ("no_text", "concat('{\"message\":{\"toString\":', j, '}}')", "'{\"message\":{\"toString\":' || j || '}}'"),
    ("trailing", "concat('{\"message\":', j, '} ', conv_id)", "'{\"message\":' || j || '} ' || conv_id"), ("two", "concat('{\"message\":', j, '}{}')", "'{\"message\":' || j || '}{}'"),
    ("open", "concat('{\"message\":', j)", "'{\"message\":' || j"), ("bare", "j", "j"), ("none", "CAST(NULL AS STRING)", "NULL"), ("empty", "''", "''"),
]
#: Provider's responses made of each conversation row, in the same way.
RESPONSES = [
    ("content", "concat('{\"choices\":[{\"message\":{\"content\":', j, '}}]}')", "'{\"choices\":[{\"message\":{\"content\":' || j || '}}]}'"),
    ("first", "concat('{\"choices\":[{\"message\":{\"content\":', j, '}},{\"message\":{\"content\":\"no\"}}]}')", "'{\"choices\":[{\"message\":{\"content\":' || j || '}},{\"message\":{\"content\":\"no\"}}]}'"),
    ("no_choice", "concat('{\"choices\":[],\"id\":', conv_id, '}')", "'{\"choices\":[],\"id\":' || conv_id || '}'"), ("no_choices", "concat('{\"id\":', conv_id, '}')", "'{\"id\":' || conv_id || '}'"),
    ("no_message", "'{\"choices\":[{}]}'", "'{\"choices\":[{}]}'"), ("no_content", "'{\"choices\":[{\"message\":{}}]}'", "'{\"choices\":[{\"message\":{}}]}'"), ("null", "'{\"choices\":[{\"message\":{\"content\":null}}]}'", "'{\"choices\":[{\"message\":{\"content\":null}}]}'"),
]
#: Keywords for many: words of the tables, by the table that they are from.
WORDS = "[a-z0-9]{4,}"
KEYWORD_TABLES = {"chat": ("conversations", "text"), "page": ("pages", "html"), "item": ("benchmark", "text")}


def pick(values: list[str | None], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def q(s: str | None) -> str:
    if s is None:
        return "NULL"
    plain = "'" + s.replace("'", "''") + "'"
    for c in sorted({c for c in s if c.isspace() and c != " " or c in "‌﻿"}):
        plain = plain.replace(c, f"' || chr({ord(c)}) || '")
    return f"({plain})"


def q_pick(values: list[str | None], key: str) -> str:
    return f"([{', '.join(map(q, values))}])[({key} % {len(values)} + 1)::INT]"


def phrased(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat(pick(PHRASES, F.col("doc_id")), F.lit(" "), F.col("text")).alias("m"))


SQL_P = f"p AS (SELECT doc_id, {q_pick(PHRASES, 'doc_id')} || ' ' || text AS m FROM documents)"
SQL_N = f"n AS (SELECT doc_id, m, trim(translate(lower(m), {q(FOLD_FROM)}, {q(FOLD_TO)}), {q(JS_WS)}) AS n FROM p)"
SQL_K = "k(code, pos, word) AS (VALUES " + ", ".join(f"('{c}', {i}, {q(w)})" for i, (c, ws) in enumerate(KEYWORDS.items()) for w in ws) + ")"
SQL_S = "s AS (SELECT n.doc_id, c.code, c.pos, count(k.word)::INT AS score FROM n CROSS JOIN (SELECT DISTINCT code, pos FROM k) c LEFT JOIN k ON k.code = c.code AND contains(n.n, k.word) GROUP BY ALL)"
SQL_R = "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos)::INT AS rank FROM s)"
SQL_D = """d AS (SELECT doc_id, CASE WHEN top > 0 THEN code END AS code,
  CASE WHEN top = 0 THEN 0::DOUBLE WHEN top = second THEN 0.5::DOUBLE ELSE least(0.95::DOUBLE, 0.55::DOUBLE + top::DOUBLE * 0.1::DOUBLE) END AS confidence,
  CASE WHEN top = 0 THEN 'undetermined' ELSE 'keyword' END AS source
  FROM (SELECT doc_id, max(code) FILTER (rank = 1) AS code, max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 2) AS second FROM r GROUP BY doc_id))"""
SQL_ALL = f"WITH {SQL_P}, {SQL_N}, {SQL_K}, {SQL_S}, {SQL_R}, {SQL_D}"
SQL_DIM = "(VALUES " + ", ".join("(" + ", ".join(map(q, j)) + ")" for j in JURISDICTIONS) + ") j(code, name_fa, name_en, language, status)"
SQL_PROMPT = "concat_ws(chr(10), {}, {}, 'Target jurisdiction: ' || coalesce(j.name_fa || ' (' || j.code || ')', {}) || '.', {})".format(q(f"You are {ASSISTANT}."), q(PROMPT_HEAD), q(UNKNOWN), ", ".join(map(q, PROMPT_TAIL)))


def chat_rows(spark: SparkSession, d: str) -> DataFrame:
    """User rows of the conversations, each led by a phrase of CHAT, and the phrases alone as turns of conversation -1."""
    c = table(spark, d, "conversations").filter("role = 'user'")
    led = c.select("conv_id", "turn", F.concat(pick(CHAT, F.col("conv_id") + F.col("turn")), F.col("text")).alias("m"))
    return led.union(spark.createDataFrame([(-1, i, p) for i, p in enumerate(CHAT)], "conv_id long, turn long, m string"))


SQL_C = (
    f"c AS (SELECT conv_id, turn, {q_pick(CHAT, '(conv_id + turn)')} || text AS m FROM conversations WHERE role = 'user' "
    "UNION ALL SELECT * FROM (VALUES " + ", ".join(f"((-1)::BIGINT, {i}::BIGINT, {q(p)})" for i, p in enumerate(CHAT)) + ") v)"
)
SQL_RULES = f"CASE WHEN trim(m, {q(JS_WS)}) = '' THEN {q(responder.BLANK_REPLY)} " + " ".join(f"WHEN contains(m, {q(w)}) THEN {q(r)}" for w, r in responder.RULES) + f" ELSE {q(responder.ECHO)} || m END"


def formed(spark: SparkSession, d: str, forms: list[tuple[str, str, str]]) -> DataFrame:
    """(conv_id, turn, form, m, body): each conversation row in each form."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("m"))
    j = c.withColumn("j", codec.json_text(F.col("m")))
    return j.select("conv_id", "turn", "m", F.inline(F.array(*[F.struct(F.lit(n).alias("form"), F.expr(e).alias("body")) for n, e, _ in forms])))


def sql_formed(forms: list[tuple[str, str, str]]) -> str:
    listed = " UNION ALL ".join(f"SELECT conv_id, turn, m, '{n}' AS form, {e} AS body FROM j" for n, _, e in forms)
    return f"j AS (SELECT conv_id, turn, coalesce(text, '') AS m, to_json(coalesce(text, ''))::VARCHAR AS j FROM conversations), f AS ({listed})"


#: What a body's message is as a string, by its JSON type; NULL if it can't become one.
SQL_MESSAGE = """CASE WHEN json_type(body, '$.message.toString') IS NOT NULL AND json_type(body, '$.message') = 'OBJECT' THEN NULL ELSE coalesce(CASE json_type(body, '$.message') WHEN 'VARCHAR' THEN body->>'$.message' WHEN 'OBJECT' THEN '[object Object]'
  WHEN 'BOOLEAN' THEN CASE body->>'$.message' WHEN 'true' THEN 'true' END WHEN 'UBIGINT' THEN nullif(body->>'$.message', '0') WHEN 'ARRAY' THEN concat(body->>'$.message[0]', ',', body->>'$.message[1]', ',,true') END, '') END"""


def routed(spark: SparkSession, d: str) -> DataFrame:
    """Each chat row under each route."""
    routes = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(p).alias("path")) for m, p in ROUTES])
    return chat_rows(spark, d).select("conv_id", "turn", "m", F.inline(routes))


def many_rules(spark: SparkSession, d: str) -> DataFrame:
    """(code, word): the words of three tables."""
    parts = [table(spark, d, t).select(F.lit(c).alias("code"), F.explode(F.regexp_extract_all(F.lower(x), F.lit(WORDS), F.lit(0))).alias("word")) for c, (t, x) in KEYWORD_TABLES.items()]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


SQL_MANY = "k AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS code, unnest(regexp_extract_all(lower({x}), '{WORDS}')) AS word FROM {t}" for c, (t, x) in KEYWORD_TABLES.items()) + ")"


def late_rules(spark: SparkSession, d: str) -> DataFrame:
    """Longer words of the benchmark, which arrive after the texts were indexed."""
    return many_rules(spark, d).filter("code = 'item' AND length(word) >= 8")


def indexed_matches(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/index-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"  # noqa: SLF001
    gram_index.build(table(spark, d, "documents"), "doc_id", "text", path)
    return gram_index.matches(spark, path, late_rules(spark, d), "doc_id", "bigint").select("doc_id", "word")


def relay_path(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of all forms through the relay, whose provider says how long a string message is, sends no message for a number and fails for the rest."""
    codec.allow_repeated_keys(spark)

    def provider(asks: list[dict]) -> list[tuple[bool, str | None]]:
        import json

        out: list[tuple[bool, str | None]] = []
        for a in asks:
            m = a["messages"][0].get("content")
            out.append((isinstance(m, int | str) and not isinstance(m, bool), json.dumps({"choices": [{"message": {"content": f"len {len(m)}"}} if isinstance(m, str) else {}]})))
        return out

    rows = formed(spark, d, FORMS).select(F.struct("conv_id", "turn", "form").alias("k"), "body")
    return completion.relay(rows, "k", "body", provider).select("k.conv_id", "k.turn", "k.form", "status", "reply", "response")


#: Bodies for the whole path, and what each gets: (body, status, reply). The last body is repeated to exceed the limit.
PATHS = [
    ("{bad", 400, None), ('"x"', 400, None), ("7", 400, None), ("[1]", 200, responder.BLANK_REPLY), ('{"message":"a","message":"سلام"}', 200, responder.RULES[0][1]),
    ('{"message":[1,"a",null,[2,3]]}', 200, responder.ECHO + "1,a,,2,3"), ('{"message":[]}', 200, responder.BLANK_REPLY), ('{"message":[{"toString":1}]}', 500, responder.SERVER_ERROR), ('{"message":{"toString":1}}', 500, responder.SERVER_ERROR),
    ('{"message":1e21}', 200, responder.ECHO + "1e+21"), ('{"message":1.50}', 200, responder.ECHO + "1.5"), ('{"message":0.000001}', 200, responder.ECHO + "0.000001"), ('{"message":-1.25e-9}', 200, responder.ECHO + "-1.25e-9"),
    ('{"message":123456789012345678901}', 200, responder.ECHO + "123456789012345680000"), ('{"message":[1e21,0.5,true]}', 200, responder.ECHO + "1e+21,0.5,true"), ("{}", 200, responder.BLANK_REPLY), ("x", 413, None),
]


def chat_path(spark: SparkSession, d: str) -> DataFrame:
    """Each chat row as a request body, and PATHS as turns of conversation -2."""
    codec.allow_repeated_keys(spark)
    bodies = chat_rows(spark, d).select("conv_id", "turn", codec.encode_request(F.col("m")).alias("body"))
    more = spark.createDataFrame([(-2, i, b, s == 413) for i, (b, s, _) in enumerate(PATHS)], "conv_id long, turn long, body string, big boolean")
    more = more.select("conv_id", "turn", F.when(F.col("big"), F.repeat("body", F.lit(codec.RULE_SERVER_LIMIT + 1))).otherwise(F.col("body")).alias("body"))
    return chat.answer(bodies.union(more), "body", ("conv_id", "turn"))


#: Forms that aren't one JSON object or array.
REFUSED = ("trailing", "two", "open", "bare", "none", "empty")


def chat_statuses(spark: SparkSession, d: str) -> DataFrame:
    codec.allow_repeated_keys(spark)
    return chat.answer(formed(spark, d, FORMS), "body", ("conv_id", "turn", "form"))


def transcript_of(style: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: transcript.render(table(s, d, "conversations"), style=style)


def stream_bubbles(spark: SparkSession, d: str) -> DataFrame:
    """Bubbles of the conversations as a file stream, into the shared folder."""
    name = f"{shared_folder(spark)}/stream-{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"  # noqa: SLF001
    source = stream.table_stream(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), f"{name}/in")
    stream.run_available(stream.bubble_stream(source, "bare").select("conv_id", "turn", "bubble"), f"{name}/out", f"{name}/state").awaitTermination()
    delete(spark, f"{name}/state")
    delete(spark, f"{name}/in")
    return spark.read.schema("conv_id long, turn long, bubble string").parquet(f"{name}/out")


def stream_detect(spark: SparkSession, d: str) -> DataFrame:
    """Runs to completion over the table as a file stream, into the shared folder."""
    name = f"{shared_folder(spark)}/stream-{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"  # noqa: SLF001
    source = stream.table_stream(table(spark, d, "documents").select("doc_id", "text"), f"{name}/in")
    p = source.select("doc_id", F.concat(pick(PHRASES, F.col("doc_id")), F.lit(" "), F.col("text")).alias("m"))
    stream.run_available(stream.detect_stream(p, "m").drop("m"), f"{name}/out", f"{name}/state").awaitTermination()
    delete(spark, f"{name}/state")
    delete(spark, f"{name}/in")
    return spark.read.schema("doc_id long, code string, confidence double, source string").parquet(f"{name}/out")


def published(spark: SparkSession, rows: DataFrame, tick: DataFrame, path: str) -> DataFrame:
    """rows as a stream of about three micro-batches in the order of a hash, and a last one that moves the watermark on."""
    rows.repartition(F.xxhash64(*rows.columns)).write.parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    tick.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(path)


def _stream_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"  # noqa: SLF001


def _minute(turn: Column) -> Column:
    return F.timestamp_seconds(F.lit(1_767_225_600).cast("long") + turn.cast("long") * 60)


TICK = 10_000_000  # a turn that is later than all


def stream_transcript(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the conversations in any order, folded to transcripts; what a conversation's pieces add up to."""
    dialogue.use_rocksdb(spark)
    name = _stream_folder(spark)
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", _minute(F.col("turn")).alias("at"))
    tick = spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[:4]], _minute(F.lit(TICK)).alias("at"))
    out = dialogue.transcripts(published(spark, rows, tick, f"{name}/in"), "at", "30 days", 60_000)
    stream.run_available(out, f"{name}/out", f"{name}/state").awaitTermination()
    pieces = spark.read.schema("conv_id long, turn long, upto long, piece string, late boolean").parquet(f"{name}/out").filter("NOT late AND piece <> ''")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy("conv_id").agg(whole.alias("transcript"))


def stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    """User turns and assistant turns as two streams; a user turn without a reply becomes a failed call."""
    name, c = _stream_folder(spark), table(spark, d, "conversations")
    asks = c.filter("role = 'user'").select("conv_id", "turn", "text", _minute(F.col("turn")).alias("at"))
    replies = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"), (_minute(F.col("turn") - 1) + F.expr("INTERVAL 5 seconds")).alias("at"))
    tick = lambda n, text: spark.range(1).select(F.lit(n).cast("long").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.lit("").alias(text), _minute(F.lit(TICK)).alias("at"))
    both = dialogue.pairs(published(spark, asks, tick(-1, "text"), f"{name}/asks"), published(spark, replies, tick(-2, "reply"), f"{name}/replies"), ["conv_id", "turn"], "at", "30 days", "1 minute")
    shown = both.select("conv_id", "turn", F.col("replied_at").isNotNull().alias("answered"), dialogue.exchange_bubbles(F.col("text"), F.col("reply")).alias("bubbles"))
    stream.run_available(shown, f"{name}/out", f"{name}/state").awaitTermination()
    return spark.read.schema("conv_id long, turn long, answered boolean, bubbles string").parquet(f"{name}/out").filter("turn >= 0")


def by_sql(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    """A statement over p, the documents with phrases, with the SQL functions."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        sql_functions.register(spark)
        return spark.sql(statement, p=phrased(spark, d).withColumn("r", pick(REQUESTED, F.col("doc_id"))))

    return run


def chat_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the statuses of all forms of bodies, observed while they are answered and written."""
    seen = Observation()
    answers = metrics.observed(chat_statuses(spark, d), seen)
    answers.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k, v) for k, v in seen.get.items()], "name string, n long")


def jurisdiction_dim(spark: SparkSession, d: str) -> DataFrame:
    """The dimension with numbers of documents, counted side by side: the filter of a join by code would be pushed below the detection, with the normalisation once for each keyword."""
    counted = with_detection(phrased(spark, d), "m").agg(*[F.count_if(F.col("code") == c).alias(c) for c in CODES])
    n = counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("n_documents")) for c in CODES])))
    return jurisdictions(spark).join(n, "code")


def completion_call(spark: SparkSession, d: str) -> DataFrame:
    """The completer adapter with a deterministic completer that echoes the length and fails on every seventh."""

    def echo(asks: list[dict]) -> list[tuple[bool, str | None]]:
        import json

        sizes = [len(a["messages"][0]["content"]) for a in asks]
        return [(n % 7 != 0, json.dumps({"choices": [{"message": {"content": f"len {n}"}}]})) for n in sizes]

    return completion.complete(phrased(spark, d), "doc_id", "m", echo)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    col = F.col
    return {
        "detect_jurisdiction": lambda s, d: with_detection(phrased(s, d), "m").drop("m"),
        "detect_explicit": lambda s, d: with_detection(phrased(s, d).withColumn("r", pick(REQUESTED, col("doc_id"))), "m", "r").drop("m", "r"),
        "normalize_text": lambda s, d: phrased(s, d).select("doc_id", normalize_text(col("m")).alias("normalized")),
        "keyword_matches": lambda s, d: relational.keyword_matches(phrased(s, d), keywords(s), "doc_id", "m"),
        "keyword_scores": lambda s, d: relational.keyword_scores(phrased(s, d), keywords(s), "doc_id", "m"),
        "keyword_scores_wide": lambda s, d: with_scores(phrased(s, d), "m", "score_").drop("m"),
        "jurisdiction_rank": lambda s, d: relational.ranked_scores(phrased(s, d), keywords(s), "doc_id", "m"),
        "detect_struct": lambda s, d: with_detection_struct(phrased(s, d).withColumn("r", pick(REQUESTED, col("doc_id"))), "m", "r").select(
            "doc_id", *[col(f"detection.jurisdiction.{n}").alias(n) for n in ("code", "name_fa", "name_en", "language", "status")], "detection.confidence", "detection.source"
        ),
        "jurisdiction_dim": jurisdiction_dim,
        "keyword_dim": lambda s, d: keywords(s).select("code", "word").join(relational.keyword_matches(phrased(s, d), keywords(s), "doc_id", "m").groupBy("code", "word").agg(F.count(F.lit(1)).alias("n")), ["code", "word"], "left").select("code", "word", F.coalesce("n", F.lit(0)).cast("long").alias("n_documents")),
        "legal_system_prompt": lambda s, d: with_detection(phrased(s, d), "m").select("doc_id", "code", legal_system_prompt(jurisdiction_struct(col("code"))).alias("prompt")),
        "create_legal_request": lambda s, d: create_legal_request(phrased(s, d), "m", keep=("doc_id",)).select(
            "doc_id", "query", col("jurisdiction.code").alias("code"), col("jurisdiction.name_en").alias("name_en"), col("jurisdictionConfidence").alias("confidence"),
            col("jurisdictionSource").alias("source"), col("needsJurisdictionClarification").alias("needs_clarification"), col("systemPrompt").alias("prompt"), F.size("evidence").alias("n_evidence"),
        ),
        "rule_reply": lambda s, d: chat_rows(s, d).select("conv_id", "turn", responder.rule_reply(col("m")).alias("reply")),
        "route_dispatch": lambda s, d: routed(s, d).select("conv_id", "turn", "method", "path", responder.route_status(col("method"), col("path")).alias("status"), responder.route_reply(col("method"), col("path"), col("m")).alias("reply")),
        "chat_request_decode": lambda s, d: formed(s, d, [f for f in FORMS if f[0] not in REFUSED]).select("conv_id", "turn", "form", F.when(~codec.uncoercible(col("body")), codec.decode_message(col("body"))).alias("message")),
        "chat_response_encode": lambda s, d: chat_rows(s, d).select("conv_id", "turn", codec.encode_reply(responder.rule_reply(col("m"))).alias("j")).select("conv_id", "turn", codec.decode_reply(col("j")).alias("reply")),
        "client_filter_trimmed": lambda s, d: transcript.drop_blank(chat_rows(s, d), "m"),
        "client_filter_nonempty": lambda s, d: transcript.drop_empty(chat_rows(s, d), "m"),
        "completion_payload": lambda s, d: phrased(s, d).select("doc_id", completion.payload(col("m")).alias("p")).select("doc_id", "p.model", F.explode("p.messages").alias("x")).select("doc_id", "model", "x.role", "x.content"),
        "completion_extract": lambda s, d: formed(s, d, RESPONSES).select("conv_id", "turn", "form", completion.extract_reply(col("body")).alias("reply")),
        "chat_statuses": chat_statuses,
        "chat_response_json": lambda s, d: chat_rows(s, d).select("conv_id", "turn", codec.encode_reply(responder.rule_reply(col("m"))).alias("response"), codec.encode_request(col("m")).alias("request")),
        "relay_path": relay_path,
        "keyword_scores_many": lambda s, d: relational.keyword_scores(table(s, d, "documents"), many_rules(s, d), "doc_id", "text", list(KEYWORD_TABLES)),
        "keyword_index_matches": indexed_matches,
        "completion_call": completion_call,
        "missing_key_reply": lambda s, d: completion.missing_key(phrased(s, d).select("doc_id")),
        "transcript_render": lambda s, d: transcript.render(table(s, d, "conversations")),
        "transcript_plain": transcript_of("plain"),
        "transcript_bare": transcript_of("bare"),
        "chat_path": chat_path,
        "stream_detect": stream_detect,
        "stream_bubbles": stream_bubbles,
        "sql_detect_jurisdiction": by_sql("SELECT doc_id, d.jurisdiction.code AS code, d.jurisdiction.name_fa AS name_fa, d.jurisdiction.name_en AS name_en, d.jurisdiction.language AS language, d.jurisdiction.status AS status, d.confidence AS confidence, d.source AS source FROM (SELECT doc_id, detect_jurisdiction(m, r) AS d FROM {p})"),
        "sql_keyword_hits": by_sql("SELECT doc_id, k.code, k.word FROM {p}, LATERAL keyword_hits(m) k"),
        "sql_prompt": by_sql("SELECT doc_id, d.code AS code, legal_system_prompt(d) AS prompt FROM (SELECT doc_id, detect_jurisdiction(m).jurisdiction AS d FROM {p})"),
        "sql_normalize_text": by_sql("SELECT doc_id, normalize_text(m) AS normalized FROM {p}"),
        "chat_metrics": chat_metrics,
        "stream_transcript": stream_transcript,
        "stream_pairs": stream_pairs,
    }


def oracle_sql() -> dict[str, str]:
    reply = f"SELECT conv_id, turn, {SQL_RULES} AS reply FROM c"
    code = "CASE upper(coalesce(r, '')) WHEN 'IR' THEN 'IR' WHEN 'DE' THEN 'DE' WHEN 'US' THEN 'US' END"
    turns = lambda style: f"CASE role WHEN 'user' THEN {q(transcript.BUBBLES[style][0])} ELSE {q(transcript.BUBBLES[style][1])} END || text || '</div>'"
    rendered = lambda style: f"SELECT conv_id, string_agg({turns(style)}, '' ORDER BY turn) AS transcript FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id"
    detect = f"{SQL_ALL} SELECT * FROM d"
    statuses = (
        f"WITH {sql_formed(FORMS)}, g AS (SELECT conv_id, turn, form, CASE WHEN coalesce(body, '') = '' THEN 500 WHEN NOT json_valid(body) THEN 400 WHEN json_type(body) NOT IN ('OBJECT', 'ARRAY') THEN 400 END AS bad, CASE WHEN json_valid(body) THEN {SQL_MESSAGE} END AS m FROM f) "
        f"SELECT conv_id, turn, form, coalesce(bad, CASE WHEN m IS NULL THEN 500 ELSE 200 END)::INT AS status, CASE WHEN bad = 400 THEN NULL WHEN bad = 500 OR m IS NULL THEN {q(responder.SERVER_ERROR)} ELSE {SQL_RULES} END AS reply FROM g"
    )
    struct = (
        f"{SQL_ALL}, e AS (SELECT doc_id, {q_pick(REQUESTED, 'doc_id')} AS r FROM documents), f AS (SELECT doc_id, {code} AS x FROM e), "
        "g AS (SELECT d.doc_id, coalesce(x, code) AS code, CASE WHEN x IS NULL THEN confidence ELSE 1::DOUBLE END AS confidence, CASE WHEN x IS NULL THEN source ELSE 'explicit' END AS source FROM d JOIN f USING (doc_id)) "
        f"SELECT g.doc_id, g.code, j.name_fa, j.name_en, j.language, j.status, g.confidence, g.source FROM g LEFT JOIN {SQL_DIM} ON j.code = g.code"
    )
    return {
        "detect_jurisdiction": detect,
        "stream_detect": detect,
        "detect_explicit": f"{SQL_ALL}, e AS (SELECT doc_id, {q_pick(REQUESTED, 'doc_id')} AS r FROM documents), f AS (SELECT doc_id, {code} AS x FROM e) "
        "SELECT d.doc_id, coalesce(x, code) AS code, CASE WHEN x IS NULL THEN confidence ELSE 1::DOUBLE END AS confidence, CASE WHEN x IS NULL THEN source ELSE 'explicit' END AS source FROM d JOIN f USING (doc_id)",
        "normalize_text": f"WITH {SQL_P}, {SQL_N} SELECT doc_id, n AS normalized FROM n",
        "keyword_matches": f"WITH {SQL_P}, {SQL_N}, {SQL_K} SELECT doc_id, code, word FROM n JOIN k ON contains(n.n, k.word)",
        "keyword_scores": f"{SQL_ALL} SELECT doc_id, code, score FROM s",
        "keyword_scores_wide": f"{SQL_ALL} SELECT doc_id, " + ", ".join(f'max(score) FILTER (code = \'{c}\') AS "score_{c}"' for c in CODES) + " FROM s GROUP BY doc_id",
        "jurisdiction_rank": f"{SQL_ALL} SELECT doc_id, code, score, rank FROM r",
        "jurisdiction_dim": f"{SQL_ALL} SELECT j.*, count(d.doc_id) AS n_documents FROM {SQL_DIM} LEFT JOIN d ON d.code = j.code GROUP BY ALL",
        "keyword_dim": f"WITH {SQL_P}, {SQL_N}, {SQL_K} SELECT k.code, k.word, count(n.doc_id) AS n_documents FROM k LEFT JOIN n ON contains(n.n, k.word) GROUP BY ALL",
        "legal_system_prompt": f"{SQL_ALL} SELECT d.doc_id, d.code, {SQL_PROMPT} AS prompt FROM d LEFT JOIN {SQL_DIM} ON j.code = d.code",
        "create_legal_request": f"{SQL_ALL} SELECT d.doc_id, trim(p.m, {q(JS_WS)}) AS query, d.code, j.name_en, confidence, source, d.code IS NULL AS needs_clarification, {SQL_PROMPT} AS prompt, 0::INT AS n_evidence FROM d JOIN p USING (doc_id) LEFT JOIN {SQL_DIM} ON j.code = d.code",
        "rule_reply": f"WITH {SQL_C} {reply}",
        "chat_response_encode": f"WITH {SQL_C} {reply}",
        "route_dispatch": f"WITH {SQL_C}, r(method, path) AS (VALUES {', '.join(map(str, ROUTES))}) SELECT conv_id, turn, method, path, CASE WHEN method = 'GET' AND path IN ('/', '/ping') OR method = 'POST' AND path = '/chat' THEN 200 ELSE 404 END::INT AS status, "
        f"CASE WHEN method = 'GET' AND path = '/' THEN 'OK' WHEN method = 'GET' AND path = '/ping' THEN 'pong' WHEN method = 'POST' AND path = '/chat' THEN {SQL_RULES} END AS reply FROM c CROSS JOIN r",
        "chat_request_decode": f"WITH {sql_formed([f for f in FORMS if f[0] not in REFUSED])} SELECT conv_id, turn, form, {SQL_MESSAGE} AS message FROM f",
        "chat_statuses": statuses,
        "chat_response_json": f"WITH {SQL_C} SELECT conv_id, turn, json_object('reply', {SQL_RULES})::VARCHAR AS response, json_object('message', m)::VARCHAR AS request FROM c",
        "relay_path": f"WITH {sql_formed(FORMS)}, g AS (SELECT conv_id, turn, form, CASE WHEN coalesce(body, '') <> '' AND (NOT json_valid(body) OR json_type(body) NOT IN ('OBJECT', 'ARRAY')) THEN 400 ELSE 200 END::INT AS status, CASE WHEN json_valid(body) AND json_type(body, '$.message') = 'VARCHAR' THEN 'len ' || length(body->>'$.message') ELSE {q(completion.RELAY_ERROR[1])} END AS said FROM f) "
        "SELECT conv_id, turn, form, status, CASE WHEN status = 200 THEN said END AS reply, CASE WHEN status = 200 THEN json_object('reply', said)::VARCHAR END AS response FROM g",
        "keyword_scores_many": f"WITH {SQL_MANY}, c(code) AS (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in KEYWORD_TABLES)}), h AS (SELECT doc_id, code, count(*)::INT AS score FROM (SELECT doc_id, lower(text) AS n FROM documents) JOIN k ON contains(n, word) GROUP BY ALL) "
        "SELECT d.doc_id, c.code, coalesce(h.score, 0) AS score FROM documents d CROSS JOIN c LEFT JOIN h ON h.doc_id = d.doc_id AND h.code = c.code",
        "keyword_index_matches": f"WITH {SQL_MANY} SELECT doc_id, word FROM (SELECT doc_id, lower(text) AS n FROM documents) JOIN (SELECT word FROM k WHERE code = 'item' AND length(word) >= 8) ON contains(n, word)",
        "client_filter_trimmed": f"WITH {SQL_C} SELECT conv_id, turn, trim(m, {q(JS_WS)}) AS m FROM c WHERE trim(m, {q(JS_WS)}) <> ''",
        "client_filter_nonempty": f"WITH {SQL_C} SELECT conv_id, turn, m FROM c WHERE m <> ''",
        "completion_payload": f"WITH {SQL_P} SELECT doc_id, {q(completion.MODEL)} AS model, 'user' AS role, m AS content FROM p",
        "completion_extract": f"WITH {sql_formed(RESPONSES)} SELECT conv_id, turn, form, CASE WHEN json_type(body, '$.choices[0].message') IS NULL THEN {q(completion.RELAY_ERROR[1])} ELSE body->>'$.choices[0].message.content' END AS reply FROM f",
        "completion_call": f"WITH {SQL_P} SELECT doc_id, 200::INT AS status, CASE WHEN length(m) % 7 = 0 THEN {q(completion.RELAY_ERROR[1])} ELSE 'len ' || length(m) END AS reply FROM p",
        "missing_key_reply": f"SELECT doc_id, {completion.MISSING_KEY[0]}::INT AS status, {q(completion.MISSING_KEY[1])} AS reply FROM documents",
        "transcript_render": rendered("classes"),
        "transcript_plain": rendered("plain"),
        "transcript_bare": rendered("bare"),
        "sql_keyword_hits": f"WITH {SQL_P}, {SQL_N}, {SQL_K} SELECT doc_id, code, word FROM n JOIN k ON contains(n.n, k.word)",
        "sql_prompt": f"{SQL_ALL} SELECT d.doc_id, d.code, {SQL_PROMPT} AS prompt FROM d LEFT JOIN {SQL_DIM} ON j.code = d.code",
        "sql_normalize_text": f"WITH {SQL_P}, {SQL_N} SELECT doc_id, n AS normalized FROM n",
        "chat_metrics": f"WITH s AS ({statuses}) SELECT unnest(['requests', 'answered', 'too_large', 'malformed', 'failed', 'fallback']) AS name, unnest([count(*), count(*) FILTER (status = 200), count(*) FILTER (status = 413), count(*) FILTER (status = 400), count(*) FILTER (status = 500), 0]) AS n FROM s",
        "sql_detect_jurisdiction": struct,
        "stream_transcript": rendered("classes"),
        "stream_pairs": f"SELECT u.conv_id, u.turn, a.conv_id IS NOT NULL AS answered, {q(transcript.BUBBLES['classes'][0])} || u.text || '</div>' || CASE WHEN a.conv_id IS NULL THEN {q(transcript.FAILED)} ELSE {q(transcript.BUBBLES['classes'][1])} || a.text || '</div>' END AS bubbles "
        "FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'",
        "stream_bubbles": f"SELECT conv_id, turn, {turns('bare')} AS bubble FROM conversations WHERE role IN ('user', 'assistant')",
        "chat_path": f"WITH {SQL_C} SELECT conv_id, turn, 200::INT AS status, {SQL_RULES} AS reply FROM c UNION ALL SELECT * FROM (VALUES " + ", ".join(f"((-2)::BIGINT, {i}::BIGINT, {st}::INT, {q(r)})" for i, (_, st, r) in enumerate(PATHS)) + ") v",
        "detect_struct": struct,
    }
