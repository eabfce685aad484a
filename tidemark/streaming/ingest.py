"""Incremental landing and staging of result pages.

Which postings are new is known to the stream's own state, one narrow row per key, so a batch reads its pages
and nothing of what was landed before. Each micro-batch writes its own ``batch=`` folder in overwrite mode and
the state is versioned by batch, so a batch that is run again after a failure replaces itself and nothing is
doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.ingest import NATURAL_KEY, dedup_first_wins
from tidemark.operators.stage import flatten_posting
from tidemark.schemas import RAW_POSTINGS
from tidemark.sources.landing import PAGE, landed_rows

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PAGES = T.StructType(
    [*PAGE.fields, T.StructField("search_role", T.StringType()), T.StructField("country_code", T.StringType())]
)
#: The sight of a key that brings its posting: of equal times and roles, any will do but always the same one.
SIGHT = T.StructType(
    [
        *[T.StructField(k, T.StringType()) for k in NATURAL_KEY],
        T.StructField("extracted_at", T.TimestampNTZType()),
        T.StructField("search_role", T.StringType()),
        T.StructField("file", T.StringType()),
    ]
)


def batch_path(out: str, table: str, batch: int) -> str:
    return f"{out}/{table}/batch={batch}"


def earlier(spark: SparkSession, out: str, table: str, schema: T.StructType, batch: int) -> DataFrame | None:
    """Rows of a table written by batches before this one."""
    if batch == 0:
        return None
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(whole).parquet(f"{out}/{table}").filter(F.col("batch") < batch).drop("batch")


def keep_state_on_disk(spark: SparkSession) -> None:
    """State beside the executors' memory, with changes and not whole copies in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def sightings(pages: DataFrame) -> DataFrame:
    """Where each posting of the pages stands: its key, time, role and ``file``."""
    rows = landed_rows(pages.withColumn("file", F.col("_metadata.file_path")), batch_id="", keep=["file"])
    return rows.select(SIGHT.fieldNames())


def first_sights(seen: DataFrame) -> DataFrame:
    """Of a stream of sightings, the keys of a batch with their first sight ever and the time of the last."""
    values = F.struct("extracted_at", "search_role", "file")
    return seen.groupBy(*NATURAL_KEY).agg(F.min(values).alias("first"), F.max("extracted_at").alias("last"))


def postings_seen(spark: SparkSession, landing: str, fresh: DataFrame, *, batch_id: str) -> DataFrame:
    """The landing rows of the sights in ``fresh``, read again from their files.

    The files are those of one batch, so the source's limit on files bounds their list. They hold each new key's first
    sight, so the first one of a key in them by role and file is it; of several in a file, any will do but always the same.
    """
    files = [r["file"] for r in fresh.select("file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], RAW_POSTINGS)
    pages = spark.read.schema(PAGES).option("basePath", landing).json(files)
    rows = landed_rows(pages.withColumn("file", F.col("_metadata.file_path")), batch_id=batch_id, keep=["file"])
    sorted_by = rows.drop("extracted_at").withColumn("content", F.xxhash64("raw_data"))
    first = dedup_first_wins(sorted_by, None, order=("search_role", "file", "content"))
    return first.join(fresh.select(*NATURAL_KEY, "extracted_at"), list(NATURAL_KEY)).select(RAW_POSTINGS.fieldNames())


def stream_ingest(
    spark: SparkSession, landing: str, out: str, checkpoint: str, *, max_files: int = 100, horizon: str | None = None
) -> StreamingQuery:
    """Land and stage all page files not seen before, ``max_files`` at a time, then stop.

    Writes ``fresh`` (where each new posting stands), ``raw``, ``stg_jobs`` and ``quarantine`` under ``out``.
    A key is new once: its first sight by time and role is landed, later ones never. With a ``horizon`` ('30
    days'), keys leave the state when they have not come for that long, so its size is bounded; a posting that
    comes again later is landed again, and which of a key's sights in the same batch is taken is not defined.
    The stream reports rows ``fetched`` and ``inserted`` per batch (see ``progress``).
    """
    keep_state_on_disk(spark)
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).json(landing)
    seen = sightings(pages).observe("landing", F.count(F.lit(1)).alias("fetched"))
    if horizon is None:
        new = first_sights(seen)
        taken = new.filter(F.col("first.extracted_at") == F.col("last")).select(*NATURAL_KEY, "first.*")
    else:
        timed = seen.withColumn("seen", F.current_timestamp()).withWatermark("seen", horizon)
        taken = timed.dropDuplicatesWithinWatermark(list(NATURAL_KEY)).drop("seen")
    taken = taken.observe("fresh", F.count(F.lit(1)).alias("inserted"))

    def land(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(batch_path(out, "fresh", number))
        fresh = session.read.schema(SIGHT).parquet(batch_path(out, "fresh", number))
        rows = postings_seen(session, landing, fresh, batch_id=f"batch-{number}")
        rows.write.mode("overwrite").parquet(batch_path(out, "raw", number))
        raw = session.read.schema(RAW_POSTINGS).parquet(batch_path(out, "raw", number))
        jobs, bad = flatten_posting(raw)
        jobs.withColumn("processed_at", F.current_timestamp().cast("timestamp_ntz")).write.mode("overwrite").parquet(
            batch_path(out, "stg_jobs", number)
        )
        bad.write.mode("overwrite").parquet(batch_path(out, "quarantine", number))

    return (
        taken.writeStream.foreachBatch(land)
        .outputMode("update" if horizon is None else "append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
