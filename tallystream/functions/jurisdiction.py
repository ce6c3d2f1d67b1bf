"""Jurisdiction detection: explicit code first, then keyword evidence.

The whole classifier is a stack of projections: no shuffle, no Python. Scores are staged
as real columns, since the top, the runner-up, the winner and the confidence reuse them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bound, normalize_text, or_empty

# The three jurisdictions, in tie-break order.
JURISDICTIONS = [
    ("IR", "ایران", "Iran", "fa", "enabled"),
    ("DE", "آلمان", "Germany", "de", "planned"),
    ("US", "ایالات متحده آمریکا", "United States", "en", "planned"),
]
# The keywords of each jurisdiction.
KEYWORDS = {
    "IR": ["ایران", "ایرانی", "قانون ایران", "قوانین ایران", "دادگاه ایران", "حقوق ایران", "تهران", "تبریز", "رشت"],
    "DE": ["آلمان", "قانون آلمان", "حقوق آلمان", "دادگاه آلمان", "germany", "german", "deutschland", "deutsches recht"],
    "US": ["آمریکا", "ایالات متحده", "قانون آمریکا", "حقوق آمریکا", "دادگاه آمریکا", "united states", "american law", "us law"],
}
CODES = [j[0] for j in JURISDICTIONS]
# Confidences.
EXPLICIT_CONFIDENCE, TIE_CONFIDENCE, BASE, STEP, CEILING = 1.0, 0.5, 0.55, 0.1, 0.95

JURISDICTION_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "name_fa", "name_en", "language", "status")])
KEYWORD_TYPE = T.StructType([T.StructField("code", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("word", T.StringType())])


def jurisdictions(spark: SparkSession) -> DataFrame:
    """The dimension: three rows."""
    return spark.createDataFrame(JURISDICTIONS, JURISDICTION_TYPE)


def keywords(spark: SparkSession) -> DataFrame:
    """The rules, one row for each keyword: (code, pos, word)."""
    return spark.createDataFrame([(c, i, w) for c, ws in KEYWORDS.items() for i, w in enumerate(ws)], KEYWORD_TYPE)


def jurisdiction_struct(code: Column) -> Column:
    """The dimension row of a code as a struct, NULL for an unknown code."""
    names = JURISDICTION_TYPE.fieldNames()
    rows = F.create_map(*[x for row in JURISDICTIONS for x in (F.lit(row[0]), F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]))])
    return F.try_element_at(rows, code)


def score(normalized: Column, code: str) -> Column:
    """How many of a code's keywords occur in the text (presence, not frequency)."""
    return sum((F.contains(normalized, F.lit(w)).cast("int") for w in KEYWORDS[code][1:]), F.contains(normalized, F.lit(KEYWORDS[code][0])).cast("int"))


def explicit_code(requested: Column) -> Column:
    """The requested code if it is known (upper-cased, not trimmed), else NULL."""
    up = F.upper(or_empty(requested))
    return F.when(up.isin(*CODES), up)


def with_scores(df: DataFrame, query: str, prefix: str = "_s_") -> DataFrame:
    """Adds the integer columns <prefix>IR, <prefix>DE and <prefix>US."""
    out = df.withColumn(f"{prefix}n", normalize_text(F.col(query)))
    return out.select(*df.columns, *[score(F.col(f"{prefix}n"), c).alias(f"{prefix}{c}") for c in CODES])


def with_detection(df: DataFrame, query: str, requested: str | None = None) -> DataFrame:
    """Adds code, confidence and source. df must not have columns of these names."""
    wanted = explicit_code(F.col(requested)) if requested else F.lit(None).cast("string")
    staged = with_scores(df, query)
    scores = F.array(*[F.col(f"_s_{c}") for c in CODES])
    staged = staged.select(*df.columns, wanted.alias("_wanted"), scores.alias("_scores"))
    staged = staged.select(*df.columns, "_wanted", "_scores", F.sort_array("_scores", asc=False).alias("_down"))
    top, second = F.get("_down", F.lit(0)), F.get("_down", F.lit(1))
    best = F.element_at(F.array(*map(F.lit, CODES)), F.array_position("_scores", top).cast("int"))
    confidence = F.when(top == second, F.lit(TIE_CONFIDENCE)).otherwise(F.least(F.lit(CEILING), F.lit(BASE) + top.cast("double") * F.lit(STEP)))
    has = F.col("_wanted").isNotNull()
    return staged.select(
        *df.columns,
        F.when(has, F.col("_wanted")).when(top == 0, F.lit(None).cast("string")).otherwise(best).alias("code"),
        F.when(has, F.lit(EXPLICIT_CONFIDENCE)).when(top == 0, F.lit(0.0)).otherwise(confidence).alias("confidence"),
        F.when(has, F.lit("explicit")).when(top == 0, F.lit("undetermined")).otherwise(F.lit("keyword")).alias("source"),
    )


def with_detection_struct(df: DataFrame, query: str, requested: str | None = None, name: str = "detection") -> DataFrame:
    """Adds the detection as one struct column: jurisdiction, confidence, source."""
    found = with_detection(df, query, requested)
    return found.select(*df.columns, F.struct(jurisdiction_struct(F.col("code")).alias("jurisdiction"), "confidence", "source").alias(name))


def detect_jurisdiction(query: Column, requested: Column | None = None) -> Column:
    """The same struct as one column expression. Text, scores and the rest are each bound once, so nothing is computed twice."""
    wanted = explicit_code(requested) if requested is not None else F.lit(None).cast("string")

    def from_scores(x: Column) -> Column:
        s, want = x["s"], x["want"]
        top, second = F.array_max(s), F.get(F.sort_array(s, asc=False), F.lit(1))
        return F.struct(s.alias("s"), want.alias("want"), top.alias("top"), second.alias("second"), (want.isNull() & (top == 0)).alias("none"))

    def shown(x: Column) -> Column:
        best = F.element_at(F.array(*map(F.lit, CODES)), F.array_position(x["s"], x["top"]).cast("int"))
        has = x["want"].isNotNull()
        confidence = F.when(x["top"] == x["second"], F.lit(TIE_CONFIDENCE)).otherwise(F.least(F.lit(CEILING), F.lit(BASE) + x["top"].cast("double") * F.lit(STEP)))
        return F.struct(
            jurisdiction_struct(F.when(~x["none"], F.coalesce(x["want"], best))).alias("jurisdiction"),
            F.when(has, F.lit(EXPLICIT_CONFIDENCE)).when(x["none"], F.lit(0.0)).otherwise(confidence).alias("confidence"),
            F.when(has, "explicit").when(x["none"], "undetermined").otherwise("keyword").alias("source"),
        )

    scores = bound(normalize_text(query), lambda n: F.array(*[score(n, c) for c in CODES]))
    return bound(bound(F.struct(scores.alias("s"), wanted.alias("want")), from_scores), shown)
