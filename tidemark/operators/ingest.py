"""Choosing what to ingest: duplicates, the role and country grid, recency, batch figures."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NATURAL_KEY = ("job_platform_id", "country_code")
#: The folder column of staged postings that are stored by date.
POSTED = "posted_date"


def dedup_first_wins(
    new: DataFrame,
    existing: DataFrame | None,
    *,
    keys: Sequence[str] = NATURAL_KEY,
    order: Sequence[str] = ("extracted_at", "search_role"),
) -> DataFrame:
    """Rows whose key is new, the first per key.

    The rank is cut to 1, so Spark drops later copies of a key before it shuffles, and a key with
    very many copies brings one row per task.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = new.withColumn("_n", nth).filter(F.col("_n") == 1).drop("_n")
    if existing is None:
        return first
    return first.join(existing.select(*keys), list(keys), "left_anti").select(*new.columns)


def active_grid(
    roles: DataFrame, countries: DataFrame, *, role: str | None = None, country: str | None = None
) -> DataFrame:
    """Every active role with every active country, or with the one asked for.

    The active countries, a fixed dimension of a few rows, are unfolded under each role.
    """
    r = roles.filter("is_active")
    c = countries.filter("is_active")
    if role is not None:
        r = r.filter(F.col("role_name") == role)
    if country is not None:
        c = c.filter(F.col("country_code") == country)
    listed = c.agg(F.collect_list(F.struct("country_code", "country_name"))).scalar()
    cells = r.select(F.col("role_name").alias("search_role"), listed.alias("places"))
    return cells.select("search_role", F.inline("places"))


def in_grid(postings: DataFrame, grid: DataFrame) -> DataFrame:
    return postings.join(grid, ["search_role", "country_code"], "left_semi")


def recent_postings(
    jobs: DataFrame, *, as_of: date, days: int | None = None, months: int | None = None
) -> DataFrame:
    """Postings of the last ``days``; a month counts 30 days. A table stored by date is read from its first folder on."""
    span = days if days is not None else (months or 0) * 30
    if not span:
        return jobs
    since = F.date_sub(F.lit(as_of), span)
    recent = jobs.filter(F.col("job_posted_at") >= since.cast("timestamp_ntz"))
    return recent.filter(F.col(POSTED) >= since).drop(POSTED) if POSTED in jobs.columns else recent


def save_by_date(jobs: DataFrame, path: str) -> None:
    """Staged postings in a folder per posted date; those without a date have a folder of their own.

    Rows are rebalanced by date before writing: Spark splits a date with many postings over several files.
    """
    dated = jobs.withColumn(POSTED, F.to_date("job_posted_at")).hint("rebalance", POSTED)
    dated.write.mode("overwrite").partitionBy(POSTED).parquet(path)


def read_by_date(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(POSTED, T.DateType())])).parquet(path)


def batch_stats(fetched: DataFrame, inserted: DataFrame) -> DataFrame:
    """Per batch: rows fetched, inserted and skipped, and the seconds between its first and last row."""
    got = fetched.groupBy("extraction_batch_id").agg(
        F.count(F.lit(1)).alias("total_fetched"),
        F.min("extracted_at").alias("_from"),
        F.max("extracted_at").alias("_to"),
    )
    kept = inserted.groupBy("extraction_batch_id").agg(F.count(F.lit(1)).alias("_kept"))
    total = F.coalesce("_kept", F.lit(0).cast("bigint"))
    return got.join(kept, "extraction_batch_id", "left").select(
        "extraction_batch_id",
        "total_fetched",
        total.alias("total_inserted"),
        (F.col("total_fetched") - total).alias("duplicates_skipped"),
        F.timestamp_diff("SECOND", "_from", "_to").alias("elapsed_seconds"),
    )


def seed_dims(existing: DataFrame, seeds: DataFrame, *, key: str) -> DataFrame:
    """The dimension with those seeds it lacks."""
    return existing.unionByName(seeds.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def unprocessed(raw: DataFrame, staged: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Raw rows that have no staged row; with a ``limit``, the oldest of them."""
    done = staged.select(F.col("raw_job_id").alias("id"))
    left = raw.join(done, "id", "left_anti").select(*raw.columns)
    return left if limit is None else left.orderBy("extracted_at", "id").limit(limit)
