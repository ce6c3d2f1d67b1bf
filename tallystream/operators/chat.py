"""The whole path of a chat request: size, JSON, coercion, rules, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import RULE_SERVER_LIMIT, decode_message, malformed, missing, uncoercible, within_limit
from ..functions.responder import SERVER_ERROR, rule_reply


def answer(df: DataFrame, body: str = "body", keep: tuple[str, ...] = (), limit: int = RULE_SERVER_LIMIT) -> DataFrame:
    """keep, status and reply of each body.

    413 for a body over the limit and 400 for one that is no JSON object or array, both without
    a reply; 500 with the server's error text for a request without a body (NULL or empty) and
    for a message that can't become a string; else 200 and the rule's reply. Call
    codec.allow_repeated_keys first.
    """
    kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    names, back = [f"_k{i}" for i in range(len(keep))], [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    b = F.coalesce(F.col(f"`{body}`"), F.lit(""))
    fits = within_limit(b, limit)
    small = df.select(*kept, fits.alias("_fits"), F.when(fits, b).alias("_b"))
    staged = small.select(*names, "_fits", missing(F.col("_b")).alias("_none"), malformed(F.col("_b")).alias("_bad"), uncoercible(F.col("_b")).alias("_un"), decode_message(F.col("_b")).alias("_m"))
    refused = ~F.col("_fits") | (F.col("_bad") & ~F.col("_none"))
    failed = F.col("_none") | F.col("_un") | F.col("_m").isNull()
    none = F.lit(None).cast("string")
    return staged.select(
        *back,
        F.when(~F.col("_fits"), F.lit(413)).when(refused, F.lit(400)).when(failed, F.lit(500)).otherwise(F.lit(200)).alias("status"),
        F.when(refused, none).when(failed, F.lit(SERVER_ERROR)).otherwise(rule_reply(F.col("_m"))).alias("reply"),
    )
