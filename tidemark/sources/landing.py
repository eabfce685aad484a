"""Landed search results and the taxonomy file."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import TAXONOMY

PAGE = T.StructType(
    [T.StructField("results", T.ArrayType(T.StringType())), T.StructField("count", T.LongType())]
)


def landed_rows(
    pages: DataFrame, *, batch_id: str, as_of: datetime | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per result of a page. ``pages`` hold results, search_role and country_code; works on streams.

    ``raw_data`` is the result's text as the page has it. Only its id is parsed here: a result that is no object, or has
    no id, is dropped. Further columns of the pages named in ``keep`` come last.
    """
    stamp = F.current_timestamp() if as_of is None else F.lit(as_of)
    results = pages.select("search_role", "country_code", *keep, F.explode("results").alias("posting"))
    return (
        results.withColumn("job_platform_id", F.try_variant_get(F.from_json("posting", "id variant")["id"], "$", "string"))
        .filter(F.col("job_platform_id").isNotNull())
        .select(
            F.xxhash64("job_platform_id", "country_code").alias("id"),
            "job_platform_id",
            "search_role",
            "country_code",
            F.col("posting").alias("raw_data"),
            stamp.cast("timestamp_ntz").alias("extracted_at"),
            F.lit(batch_id).alias("extraction_batch_id"),
            *keep,
        )
    )


def land_postings(
    spark: SparkSession,
    path: str,
    *,
    batch_id: str,
    role: str | None = None,
    country: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """Result pages ``{results: [...], count}``, one per line, as landing rows; results without an id are dropped.

    ``role`` and ``country`` name the search of these pages; without them they are read from
    ``search_role=`` and ``country_code=`` folders, so that one read covers all searches.
    """
    schema = T.StructType(list(PAGE.fields))
    for name, value in (("search_role", role), ("country_code", country)):
        if value is None:
            schema.add(name, T.StringType())
    pages = spark.read.schema(schema).json(path)
    if role is not None:
        pages = pages.withColumn("search_role", F.lit(role))
    if country is not None:
        pages = pages.withColumn("country_code", F.lit(country))
    return landed_rows(pages, batch_id=batch_id, as_of=as_of)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """The taxonomy file ``{skills: [{name, category, subcategory, aliases}]}``, one row per skill."""
    schema = T.StructType([T.StructField("skills", T.ArrayType(TAXONOMY))])
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("skills"))
