"""Completion requests: payload, an injected completer, fallbacks, an answer log and a circuit breaker.

A completer takes a list of payload dicts and returns a list of (ok, response JSON). It
runs on the executors, one call for up to `batch` rows; credentials come from its own
closure or environment and never enter a DataFrame.

A call that fails is tried again, then its rows are halved, so only the rows that fail get the
fallback. After `trip` failures in a row a partition's circuit is open: its rows get the fallback
at once, and only every `rest` seconds one more call is tried, which closes the circuit if it
succeeds. So a dead provider costs a partition `trip` timeouts, and one more each `rest` seconds.

With a log, answers are kept under a hash of the request: rows with equal requests share one
call, and a batch that runs again asks nothing that it has asked before.
"""

from __future__ import annotations

import json
import logging
import os
import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..functions.codec import RELAY_LIMIT, encode_reply, json_text, malformed, missing, within_limit

LOG = logging.getLogger("tallystream")
# Model name and replies.
MODEL = "openai/gpt-4o-mini"
MISSING_KEY = (500, "API KEY تنظیم نشده روی سرور")
RELAY_ERROR = (200, "❌ خطا در AI")

Completer = Callable[[list[dict]], list[tuple[bool, str | None]]]


def payload(message: Column, model: str = MODEL) -> Column:
    """struct<model, messages: array<struct<role, content>>> with one user message."""
    return F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), message.alias("content"))).alias("messages"))


def extract_reply(response: Column, ok: Column | None = None) -> Column:
    """content of the first choice; the fallback if there is no message; NULL if only content is missing."""
    choice = F.get(F.from_json(response, "choices array<struct<message struct<content string>>>")["choices"], F.lit(0))
    failed = choice["message"].isNull() if ok is None else (~ok | choice["message"].isNull())
    return F.when(failed, F.lit(RELAY_ERROR[1])).otherwise(choice["message"]["content"])


def request_json(message: Column, model: str = MODEL) -> Column:
    """The payload as JSON text, from the message's JSON text; without content if the message is NULL (undefined)."""
    content = F.when(message.isNull(), F.lit("")).otherwise(F.concat(F.lit(',"content":'), message))
    return F.concat(F.lit('{"model":' + json.dumps(model) + ',"messages":[{"role":"user"'), content, F.lit("}]}"))


def missing_key(df: DataFrame) -> DataFrame:
    """The answer to each row if no credential is set."""
    return df.withColumns({"status": F.lit(MISSING_KEY[0]), "reply": F.lit(MISSING_KEY[1])})


@dataclass
class Patience:
    """How a partition calls its completer."""

    batch: int = 64
    retries: int = 0
    timeout: float | None = None
    trip: int = 5
    rest: float = 30.0


class Caller:
    """One partition's calls: retries, halving and the circuit."""

    def __init__(self, completer: Completer, how: Patience):
        self.completer, self.how, self.failures, self.since = completer, how, 0, 0.0

    def _once(self, asks: list[dict]) -> list[tuple[bool, str | None]]:
        """The completer's answers; an error if they aren't one for each question or take longer than the timeout."""
        if self.how.timeout is None:
            got = self.completer(asks)
        else:
            done: queue.Queue = queue.Queue()

            def run() -> None:
                try:
                    done.put((self.completer(asks), None))
                except Exception as e:  # noqa: BLE001
                    done.put((None, e))

            threading.Thread(target=run, daemon=True).start()
            try:
                got, failed = done.get(timeout=self.how.timeout)
            except queue.Empty:
                raise TimeoutError(f"no answer within {self.how.timeout} s") from None
            if failed is not None:
                raise failed
        got = [(bool(ok), response) for ok, response in got]
        if len(got) != len(asks):
            raise ValueError(f"{len(got)} answers to {len(asks)} questions")
        return got

    def _may_call(self) -> bool:
        return self.failures < self.how.trip or time.monotonic() - self.since >= self.how.rest

    def _tried(self, asks: list[dict]) -> list[tuple[bool, str | None]] | None:
        for _ in range(self.how.retries + 1):
            if not self._may_call():
                return None
            try:
                got = self._once(asks)
            except Exception as e:  # noqa: BLE001  a provider may raise anything; the row gets the fallback
                self.failures, self.since = self.failures + 1, time.monotonic()
                LOG.warning("%s: %s", type(e).__name__, e)
            else:
                self.failures = 0
                return got
        return None

    def answers(self, asks: list[dict]) -> list[tuple[bool, str | None]]:
        """An answer for each question; (False, None) for those that fail."""
        out, stack = [(False, None)] * len(asks), [(i, min(i + self.how.batch, len(asks))) for i in range(0, len(asks), self.how.batch)][::-1]
        while stack:
            i, j = stack.pop()
            got = self._tried(asks[i:j])
            if got is not None:
                out[i:j] = got
            elif j - i > 1 and self._may_call():
                stack += [((i + j) // 2, j), (i, (i + j) // 2)]
        return out


def _called(df: DataFrame, key: str, request: str, completer: Completer, how: Patience) -> DataFrame:
    """(key, ok, response) for each row; request is the payload's JSON text."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = Caller(completer, how)
        for b in batches:
            answers = caller.answers([json.loads(x) for x in b["_request"]])
            yield pd.DataFrame({"_key": b["_key"], "ok": [a[0] for a in answers], "response": [a[1] for a in answers]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{request}`").alias("_request")).mapInPandas(call, f"_key {kind}, ok boolean, response string")


def _asked(df: DataFrame, key: str, request: str, completer: Completer, how: Patience, log: str | None, batch: str | None) -> DataFrame:
    if log is None:
        return _called(df, key, request, completer, how)
    spark = df.sparkSession
    hashed = df.select(F.col(f"`{key}`").alias("_key"), F.sha2(request, 256).alias("_hash"), F.col(f"`{request}`").alias("_request"))
    new = hashed.groupBy("_hash").agg(F.first("_request").alias("_request"))  # equal hashes have equal requests
    new = new.join(logged(spark, log, batch), F.col("_hash") == F.col("hash"), "left_anti")
    given = _called(new, "_hash", "_request", completer, how)
    given.select(F.col("_key").alias("hash"), "ok", "response", F.lit(batch).cast("string").alias("batch"), F.current_timestamp().alias("at")).write.mode("append").parquet(log)
    return hashed.join(logged(spark, log, batch), F.col("_hash") == F.col("hash")).select("_key", "ok", "response")


def logged(spark: SparkSession, log: str, batch: str | None = None) -> DataFrame:
    """(hash, ok, response) of a log's answers, one for each request: good ones, and those that failed in this batch."""
    kind = "hash string, ok boolean, response string, batch string, at timestamp"
    try:
        rows = spark.read.schema(kind).parquet(log)
    except AnalysisException:  # nothing was logged yet
        return spark.createDataFrame([], "hash string, ok boolean, response string")
    return rows.filter(F.col("ok") | F.col("batch").eqNullSafe(F.lit(batch))).groupBy("hash").agg(F.max_by(F.struct("ok", "response"), F.struct("ok", -F.unix_micros("at"))).alias("a")).select("hash", "a.ok", "a.response")


def complete(
    df: DataFrame, key: str, message: str, completer: Completer, retries: int = 0, credential: str | None = None, timeout: float | None = None,
    batch: int = 64, trip: int = 5, rest: float = 30.0, log: str | None = None, batch_id: str | None = None,
) -> DataFrame:
    """(key, status, reply). credential names an environment variable that must be set on the driver, checked first. log is the answer log's folder."""
    if credential is not None and not os.environ.get(credential):
        return missing_key(df.select(F.col(f"`{key}`").alias(key)))
    asks = df.select(F.col(f"`{key}`").alias("_key"), request_json(F.when(F.col(f"`{message}`").isNotNull(), json_text(F.col(f"`{message}`")))).alias("_request"))
    called = _asked(asks, "_key", "_request", completer, Patience(batch, retries, timeout, trip, rest), log, batch_id)
    return called.select(F.col("_key").alias(key), F.lit(RELAY_ERROR[0]).alias("status"), extract_reply(F.col("response"), F.col("ok")).alias("reply"))


def relay(df: DataFrame, key: str, body: str, completer: Completer, credential: str | None = None, limit: int = RELAY_LIMIT, how: Patience | None = None, log: str | None = None, batch_id: str | None = None) -> DataFrame:
    """(key, status, reply, response): the relay's whole path for each request body, response being the text that it sends.

    413 for a body over the limit and 400 for one that is no JSON object or array; 500 if the credential
    isn't set; else 200 with the provider's content, or with the fallback if the provider fails or sends no
    message. A request without a body has an undefined message, which is sent without content. The message
    is sent as it is, whatever its type. Call codec.allow_repeated_keys first.
    """
    b = F.coalesce(F.col(f"`{body}`"), F.lit(""))
    fits = within_limit(b, limit)
    rows = df.select(F.col(f"`{key}`").alias("_key"), fits.alias("_fits"), F.when(fits, b).alias("_b"))
    refused = F.when(~F.col("_fits"), F.lit(413)).when(~missing(F.col("_b")) & malformed(F.col("_b")), F.lit(400))
    set_ = credential is None or bool(os.environ.get(credential))
    judged = rows.withColumn("_refused", F.coalesce(refused, F.lit(None if set_ else MISSING_KEY[0])))
    text = F.lit(None if set_ else MISSING_KEY[1]).cast("string")
    early = judged.filter("_refused IS NOT NULL").select("_key", F.col("_refused").alias("status"), F.when(F.col("_refused") == MISSING_KEY[0], text).alias("reply"))
    if set_:
        message = F.to_json(F.try_variant_get(F.try_parse_json("_b"), "$.message", "variant"))
        asks = judged.filter("_refused IS NULL").select("_key", request_json(message).alias("_request"))
        called = _asked(asks, "_key", "_request", completer, how or Patience(), log, batch_id)
        early = early.unionByName(called.select("_key", F.lit(RELAY_ERROR[0]).alias("status"), extract_reply(F.col("response"), F.col("ok")).alias("reply")))
    return early.select(F.col("_key").alias(key), "status", "reply", F.when(F.col("status").isin(200, 500), encode_reply(F.col("reply"))).alias("response"))


def completion_sink(df: DataFrame, key: str, message: str, completer: Completer, out: str, log: str, checkpoint: str, how: Patience | None = None, **trigger: object) -> StreamingQuery:
    """Answers a stream's messages, a folder of out for each micro-batch: (key, status, reply).

    A micro-batch that runs again after a failure finds its answers in the log and replaces its own folder, so
    each row has one answer, and no request is asked again unless its answer was never logged.
    """
    p = how or Patience()

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        done = complete(batch, key, message, completer, p.retries, None, p.timeout, p.batch, p.trip, p.rest, log, str(number))
        done.write.mode("overwrite").parquet(f"{out}/batch_id={number}")
        batch.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
