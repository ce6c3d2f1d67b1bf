"""Sources and sinks: Parquet tables, JSON requests, JSON and text responses, settings."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.codec import allow_repeated_keys, encode_reply


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ends a body or reply that may hold line feeds.
RECORD_END = "\x1e"


def read_requests(spark: SparkSession, path: str, end: str = "\n") -> DataFrame:
    """A body for each record, as the column body: a line, or what RECORD_END ends if bodies hold line feeds.

    Spark splits files by bytes and finds the records' ends. Bodies over a limit stay: operators.chat answers them.
    """
    allow_repeated_keys(spark)
    return spark.read.text(path, lineSep=end).select(F.col("value").alias("body"))


def stream_requests(spark: SparkSession, path: str, end: str = "\n") -> DataFrame:
    allow_repeated_keys(spark)
    return spark.readStream.text(path, lineSep=end).select(F.col("value").alias("body"))


def _texts(df: DataFrame, reply: str, plain: bool | str) -> DataFrame:
    text, json = F.col(f"`{reply}`"), encode_reply(F.col(f"`{reply}`"))
    return df.select((F.when(F.col(f"`{plain}`"), text).otherwise(json) if isinstance(plain, str) else text if plain else json).alias("value"))


def write_replies(df: DataFrame, path: str, reply: str = "reply", plain: bool | str = False, end: str = "\n", mode: str = "overwrite") -> None:
    """JSON objects with a reply, or plain text; plain may name a column that tells which, row by row.

    A job's files appear when it commits, so a task that fails leaves none.
    """
    _texts(df, reply, plain).write.mode(mode).text(path, lineSep=end)


def stream_replies(df: DataFrame, path: str, checkpoint: str, reply: str = "reply", plain: bool | str = False, end: str = "\n") -> StreamingQuery:
    """The same of a stream, each row once: the sink's own log names the files of complete micro-batches."""
    out = _texts(df, reply, plain).writeStream.format("text").option("path", path).option("lineSep", end)
    return out.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A Spark setting, else an environment variable (dots as underscores, upper case), else the default."""
    return spark.conf.get(name, None) or os.environ.get(name.replace(".", "_").upper()) or default
