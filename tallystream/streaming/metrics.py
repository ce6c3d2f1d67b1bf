"""The log as data: counts of statuses and fallbacks, observed while answers are made.

    answers = observed(chat.answer(df), "chat")              # a batch: pass an Observation instead of a name
    log = MetricsLog("chat"); spark.streams.addListener(log)  # a stream: a row of counts for each micro-batch
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from ..operators.completion import RELAY_ERROR

LOG = logging.getLogger("tallystream")
#: Names of the counts, and what they count.
COUNTS = {"answered": "status = 200", "too_large": "status = 413", "malformed": "status = 400", "failed": "status = 500"}


def observed(answers: DataFrame, name: str | Observation) -> DataFrame:
    """The same rows of (status, reply); the counts are taken in passing, without another job."""
    counts = [F.count_if(F.expr(what)).alias(n) for n, what in COUNTS.items()]
    fallback = F.count_if((F.col("status") == RELAY_ERROR[0]) & (F.col("reply") == RELAY_ERROR[1])).alias("fallback")
    return answers.observe(name, F.count(F.lit(1)).alias("requests"), *counts, fallback)


class MetricsLog(StreamingQueryListener):
    """Keeps and logs the counts of each micro-batch of streams whose observation has this name."""

    def __init__(self, name: str):
        self.name, self.rows = name, []

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and row["requests"]:
            self.rows.append({"batch": event.progress.batchId, **row.asDict()})
            (LOG.warning if row["failed"] or row["fallback"] else LOG.info)("%s", self.rows[-1])

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """(batch, requests, answered, too_large, malformed, failed, fallback)."""
        names = ["batch", "requests", *COUNTS, "fallback"]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in self.rows], ", ".join(f"{n} long" for n in names))
