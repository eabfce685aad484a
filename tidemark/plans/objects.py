"""The library's view and functions as objects of a session's catalog, for those who write SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark import schemas
from tidemark.operators import marts


def register_view(spark: SparkSession, job_skills: DataFrame, skills: DataFrame, jobs: DataFrame, *, name: str = "enriched") -> None:
    """The enriched rows as a view: worked out when read, by the plan of the query that reads it."""
    marts.enriched(job_skills, skills, jobs).createOrReplaceTempView(name)


def register_functions(spark: SparkSession) -> None:
    """``currency_by_region(code)`` and ``value_midpoint(low, high)`` as SQL functions, which Catalyst inlines."""
    cases = " ".join(f"WHEN '{code}' THEN '{currency}'" for code, (_, currency) in schemas.COUNTRIES.items())
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION currency_by_region(code STRING) RETURNS STRING "
        f"RETURN CASE code {cases} ELSE '{schemas.DEFAULT_CURRENCY}' END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION value_midpoint(low DECIMAL(18, 2), high DECIMAL(18, 2)) RETURNS DECIMAL(19, 3) "
        "RETURN (coalesce(low, high) + coalesce(high, low)) * 0.5BD"
    )
