"""Chat transcripts as markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim, or_empty

# Bubbles of the three clients (user, ai), and the transport failure text.
BUBBLES = {
    "classes": ('<div class="msg user">🧑 شما: ', '<div class="msg ai">🤖 AI: '),
    "plain": ('<div class="msg">🧑 شما: ', '<div class="msg">🤖 AI: '),
    "bare": ("<div>🧑: ", "<div>🤖: "),
}
FAILED = '<div class="msg ai">❌ خطا در اتصال به سرور</div>'


def drop_blank(df: DataFrame, text: str) -> DataFrame:
    """Drops blank messages and trims the others."""
    return df.withColumn(text, js_trim(or_empty(F.col(text)))).filter(F.col(text) != "")


def drop_empty(df: DataFrame, text: str) -> DataFrame:
    """Drops empty messages only; white space passes."""
    return df.withColumn(text, or_empty(F.col(text))).filter(F.col(text) != "")


def bubble(role: Column, text: Column, style: str = "classes", escape: bool = False) -> Column:
    """One bubble; a NULL assistant text is the transport failure. Raw text isn't safe for a browser; see escape."""
    user, ai = BUBBLES[style]
    t = text
    if escape:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            t = F.replace(t, F.lit(a), F.lit(b))
    return F.when(role == "user", F.concat(F.lit(user), or_empty(t), F.lit("</div>"))).when(
        role == "assistant", F.when(text.isNull(), F.lit(FAILED)).otherwise(F.concat(F.lit(ai), t, F.lit("</div>")))
    )


def render(df: DataFrame, conv: str = "conv_id", turn: str = "turn", style: str = "classes", escape: bool = False) -> DataFrame:
    """(conv, transcript): bubbles of user and assistant rows by turn; other roles have none."""
    rows = df.filter(F.col("role").isin("user", "assistant")).select(conv, turn, bubble(F.col("role"), F.col("text"), style, escape).alias("_b"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(turn), F.col("_b"))))
    return rows.groupBy(conv).agg(F.array_join(F.transform(parts, lambda x: x["_b"]), "").alias("transcript"))
