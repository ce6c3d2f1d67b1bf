"""Prompt and request record for legal questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jurisdiction import jurisdiction_struct, with_detection
from .text import js_trim, or_empty

#: Name in the prompt's first line; pass your own.
ASSISTANT = "Legal AI Core"
# The prompt's lines around the target line, and the word for an unknown jurisdiction.
PROMPT_HEAD = "Answer legal questions cautiously and distinguish retrieved law from general reasoning."
PROMPT_TAIL = [
    "Never silently mix laws from different jurisdictions.",
    "If jurisdiction is unknown or the available evidence is insufficient, say so clearly.",
    "Do not invent statutes, article numbers, cases, citations, dates, or legal authorities.",
    "When evidence is supplied, base legal claims on that evidence and preserve its source metadata.",
    "This response is informational and is not a substitute for advice from a qualified lawyer.",
]
UNKNOWN = "نامشخص"


def legal_system_prompt(jurisdiction: Column, assistant: str = ASSISTANT) -> Column:
    """Eight lines; only the target line varies with the jurisdiction struct."""
    target = F.when(jurisdiction.isNull(), F.lit(UNKNOWN)).otherwise(F.concat(jurisdiction["name_fa"], F.lit(" ("), jurisdiction["code"], F.lit(")")))
    return F.concat_ws("\n", F.lit(f"You are {assistant}."), F.lit(PROMPT_HEAD), F.concat(F.lit("Target jurisdiction: "), target, F.lit(".")), *map(F.lit, PROMPT_TAIL))


def create_legal_request(df: DataFrame, message: str, requested: str | None = None, keep: tuple[str, ...] = (), assistant: str = ASSISTANT) -> DataFrame:
    """The seven-field request record, after the columns named in keep."""
    names, back = [f"_k{i}" for i in range(len(keep))], [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    kept = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)]
    base = df.select(*kept, F.col(f"`{message}`").alias("_m"), (F.col(f"`{requested}`") if requested else F.lit(None).cast("string")).alias("_r"))
    found = with_detection(base, "_m", "_r" if requested else None)
    staged = found.select(*names, "_m", "confidence", "source", jurisdiction_struct(F.col("code")).alias("jurisdiction"))
    return staged.select(
        *back,
        js_trim(or_empty(F.col("_m"))).alias("query"),
        "jurisdiction",
        F.col("confidence").alias("jurisdictionConfidence"),
        F.col("source").alias("jurisdictionSource"),
        F.col("jurisdiction").isNull().alias("needsJurisdictionClarification"),
        legal_system_prompt(F.col("jurisdiction"), assistant).alias("systemPrompt"),
        F.array().cast("array<string>").alias("evidence"),
    )
