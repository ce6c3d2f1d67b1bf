"""The classifier, prompt and rules as SQL functions, which Catalyst inlines: no Python runs.

    register(spark)
    spark.sql("SELECT doc_id, detect_jurisdiction(text, NULL).source FROM documents")
    spark.sql("SELECT doc_id, k.word FROM documents, LATERAL keyword_hits(text) k")
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .jurisdiction import BASE, CEILING, CODES, EXPLICIT_CONFIDENCE, JURISDICTION_TYPE, JURISDICTIONS, KEYWORDS, STEP, TIE_CONFIDENCE
from .legal import ASSISTANT, PROMPT_HEAD, PROMPT_TAIL, UNKNOWN
from .responder import BLANK_REPLY, ECHO, RULES
from .text import FOLD_FROM, FOLD_TO, JS_WS


def literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def statements(assistant: str = ASSISTANT) -> list[str]:
    """CREATE statements, each function after those that it uses."""
    ws = literal(JS_WS)
    row = ", ".join(f"{n}: STRING" for n in JURISDICTION_TYPE.fieldNames())
    rows = " ".join(f"WHEN {literal(j[0])} THEN named_struct(" + ", ".join(f"{literal(n)}, {literal(v)}" for n, v in zip(JURISDICTION_TYPE.fieldNames(), j)) + ")" for j in JURISDICTIONS)
    scores = ", ".join(" + ".join(f"int(contains(n, {literal(w)}))" for w in KEYWORDS[c]) for c in CODES)
    codes, words = ", ".join(map(literal, CODES)), ", ".join(f"named_struct('code', {literal(c)}, 'word', {literal(w)})" for c in CODES for w in KEYWORDS[c])
    normalized = f"btrim(translate(lower(coalesce(t, '')), {literal(FOLD_FROM)}, {literal(FOLD_TO)}), {ws})"
    lines = ", ".join([literal(f"You are {assistant}."), literal(PROMPT_HEAD), f"concat('Target jurisdiction: ', coalesce(concat(jurisdiction.name_fa, ' (', jurisdiction.code, ')'), {literal(UNKNOWN)}), '.')", *map(literal, PROMPT_TAIL)])
    rules = " ".join(f"WHEN contains(m, {literal(w)}) THEN {literal(r)}" for w, r in RULES)
    functions = [
        ("js_trim(t STRING) RETURNS STRING", f"btrim(t, {ws})"),
        ("normalize_text(t STRING) RETURNS STRING", normalized),
        (f"jurisdiction(code STRING) RETURNS STRUCT<{row}>", f"CASE code {rows} END"),
        ("jurisdiction_scores(n STRING) RETURNS ARRAY<INT>", f"array({scores})"),
        ("explicit_code(requested STRING) RETURNS STRING", f"CASE WHEN upper(coalesce(requested, '')) IN ({codes}) THEN upper(requested) END"),
        (
            f"jurisdiction_from(s ARRAY<INT>, wanted STRING) RETURNS STRUCT<jurisdiction: STRUCT<{row}>, confidence: DOUBLE, source: STRING>",
            f"named_struct('jurisdiction', jurisdiction(CASE WHEN wanted IS NOT NULL THEN wanted WHEN array_max(s) > 0 THEN element_at(array({codes}), int(array_position(s, array_max(s)))) END), "
            f"'confidence', CASE WHEN wanted IS NOT NULL THEN {EXPLICIT_CONFIDENCE}D WHEN array_max(s) = 0 THEN 0D WHEN get(sort_array(s, false), 0) = get(sort_array(s, false), 1) THEN {TIE_CONFIDENCE}D ELSE least({CEILING}D, {BASE}D + double(array_max(s)) * {STEP}D) END, "
            "'source', CASE WHEN wanted IS NOT NULL THEN 'explicit' WHEN array_max(s) = 0 THEN 'undetermined' ELSE 'keyword' END)",
        ),
        (f"detect_jurisdiction(query STRING, requested STRING DEFAULT NULL) RETURNS STRUCT<jurisdiction: STRUCT<{row}>, confidence: DOUBLE, source: STRING>", "jurisdiction_from(jurisdiction_scores(normalize_text(query)), explicit_code(requested))"),
        (f"legal_system_prompt(jurisdiction STRUCT<{row}>) RETURNS STRING", f"concat_ws('\\n', {lines})"),
        ("rule_reply(message STRING) RETURNS STRING", f"(SELECT CASE WHEN btrim(m, {ws}) = '' THEN {literal(BLANK_REPLY)} {rules} ELSE concat({literal(ECHO)}, m) END FROM (SELECT coalesce(message, '') AS m))"),
        # A generator alone (which takes no SQL function): it runs row by row, while Spark joins a subquery of rows with all distinct texts.
        ("keyword_hits(t STRING) RETURNS TABLE(code STRING, word STRING)", f"SELECT code, word FROM inline(get(transform(array({normalized}), n -> filter(array({words}), k -> contains(n, k.word))), 0))"),
    ]
    return [f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}" for head, body in functions]


def register(spark: SparkSession, assistant: str = ASSISTANT) -> None:
    """Makes the functions known to the session, as temporary ones."""
    for s in statements(assistant):
        spark.sql(s)
