"""What a stream has done, batch by batch, as a table."""

from __future__ import annotations

import json
import threading
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("input_rows", T.LongType()),  # rows of the source: result pages
        T.StructField("fetched", T.LongType()),
        T.StructField("inserted", T.LongType()),
        T.StructField("known_keys", T.LongType()),  # rows of state after the batch
    ]
)


class ProgressTable(StreamingQueryListener):
    """Stores a row for each batch of the session's ingesting streams under ``path``.

    A batch that is run again has a row for each run; :func:`batch_progress` takes the last one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def _event(self, run_id: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._event(str(event.runId))

    def onQueryProgress(self, event) -> None:
        held = json.loads(event.progress.json)
        seen = held.get("observedMetrics", {})
        if "landing" not in seen and "fresh" not in seen:
            return
        row = (
            held["id"],
            held["batchId"],
            datetime.fromisoformat(held["timestamp"].replace("Z", "")),
            held.get("batchDuration"),
            held["numInputRows"],
            seen.get("landing", {}).get("fetched", 0),
            seen.get("fresh", {}).get("inserted", 0),
            sum(s["numRowsTotal"] for s in held.get("stateOperators", [])),
        )
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._event(str(event.runId)).set()

    def wait(self, query: StreamingQuery, timeout: float = 60.0) -> None:
        """Until the query has ended and all its batches are stored."""
        query.awaitTermination()
        if not self._event(str(query.runId)).wait(timeout):
            raise TimeoutError("the end of the query has not been reported")


def batch_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and batch: the last run's."""
    latest = F.max_by(F.struct(*[f for f in PROGRESS.fieldNames() if f not in ("query_id", "batch_id")]), "started_at")
    rows = spark.read.schema(PROGRESS).parquet(path)
    return rows.groupBy("query_id", "batch_id").agg(latest.alias("_l")).select("query_id", "batch_id", "_l.*")


def run_totals(progress: DataFrame) -> DataFrame:
    """Rows fetched, inserted and skipped by each query, the figures ``batch_stats`` has for batch jobs."""
    return progress.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("fetched").alias("total_fetched"),
        F.sum("inserted").alias("total_inserted"),
        (F.sum("fetched") - F.sum("inserted")).alias("duplicates_skipped"),
        F.sum("duration_ms").alias("duration_ms"),
        F.max_by("known_keys", "batch_id").alias("known_keys"),
    )
