"""The same column functions on unbounded input: stateless, append mode, no watermark needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.jurisdiction import with_detection
from ..functions.responder import rule_reply
from ..operators.transcript import bubble


def detect_stream(df: DataFrame, query: str, requested: str | None = None) -> DataFrame:
    return with_detection(df, query, requested)


def reply_stream(df: DataFrame, message: str) -> DataFrame:
    return df.withColumn("reply", rule_reply(F.col(message)))


def bubble_stream(df: DataFrame, style: str = "classes") -> DataFrame:
    """One bubble row a turn; appending them by turn gives the transcript."""
    return df.filter(F.col("role").isin("user", "assistant")).withColumn("bubble", bubble(F.col("role"), F.col("text"), style))


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, append Parquet files to path and stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(df: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For sinks that need a whole batch, such as a completer."""
    return df.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_stream(rows: DataFrame, path: str) -> DataFrame:
    """A table's rows as a stream, by way of a copy of them in path, a new folder whose name holds no characters of patterns.

    Over the table's own files a stream may get other rows than a read: Spark's stream source takes a file or folder name that
    holds one of *?[]{} for a pattern and then reads files of the folder repeatedly, and leaves out files dated long before 1970.
    """
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)
