"""Checks on keys, required columns and references. An empty result, or zero failures, is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# the grain of each mart
MART_KEYS = {
    "skill_demand": ("skill_id", "search_role", "country_code"),
    "skill_cooccurrence": ("skill_id_1", "skill_id_2", "search_role"),
    "salary_by_skill": ("skill_id", "search_role", "country_code", "salary_currency"),
    "company_leaderboard": ("company_name", "search_role", "country_code"),
    "role_similarity": ("role_1", "role_2"),
    "skills_by_country": ("skill_id", "search_role", "country_code"),
}


def dq_not_null(df: DataFrame, *, columns: Sequence[str]) -> DataFrame:
    """NULLs per required column."""
    nulls = df.agg(F.lit(0).alias("_row"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return nulls.unpivot("_row", list(columns), "column_name", "failures").drop("_row")


def dq_unique(df: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


def dq_relationships(child: DataFrame, parent: DataFrame, *, key: str) -> DataFrame:
    """Child rows whose key has no parent row."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def dq_mart_keys(marts: dict[str, DataFrame]) -> DataFrame:
    """Repeated keys per mart."""
    result = None
    for name, df in marts.items():
        repeated = dq_unique(df, keys=MART_KEYS[name]).agg(
            F.lit(name).alias("mart"), F.count(F.lit(1)).alias("failures")
        )
        result = repeated if result is None else result.unionByName(repeated)
    return result
