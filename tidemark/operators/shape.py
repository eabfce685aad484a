"""Rows shaped for charts: shares, top lists and headline figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import exact_ratio


def category_share(demand: DataFrame) -> DataFrame:
    """Jobs per skill category and their share; a missing category is 'Other', a missing count is 1."""
    category = F.coalesce(F.nullif(F.col("skill_category"), F.lit("")), F.lit("Other"))
    jobs = F.coalesce(F.nullif(F.col("job_count"), F.lit(0).cast("bigint")), F.lit(1).cast("bigint"))
    counted = demand.groupBy(category.alias("skill_category")).agg(F.sum(jobs).alias("job_count"))
    total = demand.agg(F.sum(jobs)).scalar()
    return counted.withColumn("share", exact_ratio(F.col("job_count"), total, 4))


def top_n_by(df: DataFrame, *, measure: str, n: int = 15, ties: tuple[str, ...] = ("skill_name",)) -> DataFrame:
    """The ``n`` rows with the highest ``measure``; rows without it are left out."""
    return df.filter(F.col(measure).isNotNull()).orderBy(F.desc(measure), *ties).limit(n)


def contract_share(mix: DataFrame) -> DataFrame:
    """Contract kinds that occur, with their share, from a ``contract_mix`` row."""
    kinds = ["full_time", "part_time", "contract"]
    total = F.col("full_time") + F.col("part_time") + F.col("contract")
    long = mix.withColumn("_total", total).unpivot("_total", kinds, "contract_kind", "job_count")
    used = long.filter(F.col("job_count") > 0)
    return used.select("contract_kind", "job_count", exact_ratio(F.col("job_count"), F.col("_total"), 4).alias("share"))


def headline(df: DataFrame, *, measure: str, ties: tuple[str, ...] = ("skill_name",)) -> DataFrame:
    """The first row by ``measure``."""
    return top_n_by(df, measure=measure, n=1, ties=ties)
