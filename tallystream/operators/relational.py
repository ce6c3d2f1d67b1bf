"""The classifier as relational operators: keyword matches, dense scores and a ranking.

It gives the same results as functions.jurisdiction and takes keywords as data. Their number
and bytes are checked first. Up to LITERALS keywords are literals of a projection, so scores and
ranks are made row by row, without a join, an exchange or Python. Up to AUTOMATON_BYTES bytes of
keywords are one automaton, which is broadcast and reads each text once, without an exchange
either. More keywords meet the texts through slices of them and the pieces of their runs (operators.gram_index), and no text is copied. The three
ways give the same rows; rows with a NULL or repeated key keep their own. Keywords are normalised
like texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jurisdiction import CODES
from ..functions.text import normalize_text
from ..sources.shared import shared_folder
from . import gram_index
from .automaton import Automaton, sliced

#: Most literals, bytes of one automaton's keywords, and bytes of its arcs.
LITERALS, AUTOMATON_BYTES, ARCS_BYTES = 100, 1 << 19, 64 << 20
Rules = list[tuple[str | None, str | None, str]]


def _collected(rules: DataFrame) -> tuple[Rules | None, Automaton | None]:
    """(code, word, normalised word) of each rule if they are at most LITERALS or fit one automaton, and this automaton."""
    r = rules.filter("word IS NOT NULL").select("code", "word", normalize_text(F.col("word")).alias("n"))
    n, size = r.agg(F.count(F.lit(1)), F.sum(F.octet_length("n") + 1)).first()
    if n > LITERALS and (size or 0) > AUTOMATON_BYTES:
        return None, None
    given = [tuple(x) for x in r.limit(n).collect()]
    if n <= LITERALS:
        return given, None
    automaton = Automaton([w.encode() for *_, w in given])
    return (given, automaton) if automaton.goto.nbytes <= ARCS_BYTES else (None, None)


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").alias("_key"), normalize_text(F.col(f"`{text}`")).alias("_n"))


def _packed(df: DataFrame, key: str, text: str) -> str:
    """New slices of the texts in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/grams-{uuid.uuid4().hex}"
    gram_index.pack(df, key, text, path, gram_index.RUN_SLICE)
    return path


def keyword_matches(df: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, word) for each rule whose keyword a text contains."""
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    given, automaton = _collected(rules)
    if given is None:
        return gram_index.matches(spark, _packed(df, key, text), rules, key, kind, by_runs=True)
    left = _keyed(df, key, text)
    if automaton is None:  # at most LITERALS rows are broadcast
        right = F.broadcast(rules.filter("word IS NOT NULL").select("code", "word", normalize_text(F.col("word")).alias("_w")))
        return left.join(right, F.contains(F.col("_n"), F.col("_w"))).select(F.col("_key").alias(key), "code", "word")
    shared = spark.sparkContext.broadcast((automaton, pa.array([c for c, *_ in given], pa.string()), pa.array([w for _, w, _ in given], pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, codes, words = shared.value
        for b in sliced(batches, 1):
            row, word = map(pa.array, found.find(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), codes.take(word), words.take(word)], names=["_key", "code", "word"])

    return left.mapInArrow(run, f"_key {kind}, code string, word string").withColumnRenamed("_key", key)


def _total(terms: list[Column]) -> Column:
    """A sum as a balanced tree, so that its depth is small."""
    if len(terms) < 2:
        return terms[0] if terms else F.lit(0)
    return _total(terms[: len(terms) // 2]) + _total(terms[len(terms) // 2 :])


def _scored(df: DataFrame, rules: DataFrame, key: str, text: str, codes: Sequence[str]) -> DataFrame:
    """(_key, _s): an array with a score for each code."""
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    given, automaton = _collected(rules)
    if given is None:
        return gram_index.counts(spark, _packed(df, key, text), rules, kind, list(codes), by_runs=True)
    left = _keyed(df, key, text)
    if automaton is None:
        hit = lambda w: F.contains(F.col("_n"), F.lit(w)).cast("int")
        return left.select("_key", F.array(*[_total([hit(n) for c, _, n in given if c == code]) for code in codes]).alias("_s"))
    wide = len(codes)
    shared = spark.sparkContext.broadcast((automaton, np.array([codes.index(c) if c in codes else wide for c, *_ in given], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, place = shared.value
        for b in sliced(batches, 1):
            row, word = found.find(b.column(1))
            total = np.bincount(row * (wide + 1) + place[word], minlength=b.num_rows * (wide + 1)).reshape(b.num_rows, wide + 1)
            total = total[:, :wide].astype(np.int32).ravel()  # without rules of other codes
            lists = pa.ListArray.from_arrays(np.arange(0, len(total) + 1, wide, dtype=np.int32), pa.array(total))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["_key", "_s"])

    return left.mapInArrow(run, f"_key {kind}, _s array<int>")


def keyword_scores(df: DataFrame, rules: DataFrame, key: str, text: str, codes: Sequence[str] = CODES) -> DataFrame:
    """(key, code, score): dense, zero where no keyword matched; as many rows for each row of df as there are codes."""
    rows = F.array(*[F.struct(F.lit(c).alias("code"), F.get("_s", F.lit(i)).alias("score")) for i, c in enumerate(codes)])
    return _scored(df, rules, key, text, codes).select(F.col("_key").alias(key), F.inline(rows))


def ranked_scores(df: DataFrame, rules: DataFrame, key: str, text: str, codes: Sequence[str] = CODES) -> DataFrame:
    """(key, code, score, rank): the rank goes by descending score, then by the order of codes, within each row of df."""
    at = lambda i: F.get("_s", F.lit(i))
    better = lambda i: _total([((at(j) > at(i)) | (F.lit(j < i) & (at(j) == at(i)))).cast("int") for j in range(len(codes)) if j != i])
    rows = F.array(*[F.struct(F.lit(c).alias("code"), at(i).alias("score"), (better(i) + 1).alias("rank")) for i, c in enumerate(codes)])
    return _scored(df, rules, key, text, codes).select(F.col("_key").alias(key), F.inline(rows))


def jurisdiction_rank(scores: DataFrame, key: str) -> DataFrame:
    """Adds the rank by descending score to scores with one row for each key and code; ties in the order of CODES."""
    order = F.array_position(F.array(*map(F.lit, CODES)), F.col("code"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), order)))


def winners(scores: DataFrame, key: str) -> DataFrame:
    """(key, code, score) of the first rank, as one aggregation (no window)."""
    order = F.array_position(F.array(*map(F.lit, CODES)), F.col("code"))
    return scores.groupBy(key).agg(F.max_by(F.struct("code", "score"), F.struct("score", -order)).alias("_w")).select(key, "_w.code", "_w.score")
