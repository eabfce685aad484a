"""Building all marts from staging tables, the way a scheduled run does."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import marts

# columns that order the rows of each mart's files
SORTS = {
    "skill_demand": ["search_role", "country_code", "rank_in_role_country"],
    "skill_cooccurrence": ["search_role", "skill_id_1", "skill_id_2"],
    "salary_by_skill": ["search_role", "country_code", "rank_by_salary"],
    "company_leaderboard": ["search_role", "country_code", "rank_in_role_country"],
    "role_similarity": ["role_1", "role_2"],
    "skills_by_country": ["search_role", "skill_name", "rank_by_country"],
}


def save_enriched(enr: DataFrame, out: str, *, table: str | None = None, buckets: int = 0) -> DataFrame:
    """Write the enriched rows once, for all marts to read: the columns that marts use.

    With a ``table`` name and ``buckets`` the rows are bucketed by job, so the marts' joins and
    distinct counts by job need no shuffle.
    """
    spark = enr.sparkSession
    enr = enr.select(*[c for c in enr.columns if c in marts.MART_COLUMNS])
    if table is not None and buckets:
        writer = enr.write.mode("overwrite").option("path", f"{out}/enriched").bucketBy(buckets, "job_id")
        writer.sortBy("job_id").saveAsTable(table)
        return spark.table(table)
    enr.write.mode("overwrite").parquet(f"{out}/enriched")
    return spark.read.parquet(f"{out}/enriched")


def mart_frames(enr: DataFrame, jobs: DataFrame, *, as_of: date | None = None) -> dict[str, DataFrame]:
    return {
        "skill_demand": marts.skill_demand(enr, as_of=as_of),
        "skill_cooccurrence": marts.skill_cooccurrence(enr, as_of=as_of),
        "salary_by_skill": marts.salary_by_skill(enr, as_of=as_of),
        "company_leaderboard": marts.company_leaderboard(jobs, as_of=as_of),
        "role_similarity": marts.role_similarity(enr, as_of=as_of),
        "skills_by_country": marts.skills_by_country(enr, as_of=as_of),
    }


def write_marts(frames: dict[str, DataFrame], out: str) -> None:
    """Replace the mart tables, in folders per role where a mart has one.

    Rows are rebalanced by role before writing: Spark splits a large role over several files.
    """
    for name, mart in frames.items():
        if "search_role" in mart.columns:
            spread = mart.hint("rebalance", "search_role").sortWithinPartitions(*SORTS[name])
            spread.write.mode("overwrite").partitionBy("search_role").parquet(f"{out}/{name}")
        else:
            mart.sortWithinPartitions(*SORTS[name]).write.mode("overwrite").parquet(f"{out}/{name}")


def build(
    spark: SparkSession, job_skills: DataFrame, skills: DataFrame, jobs: DataFrame, out: str, *, as_of: date
) -> dict[str, DataFrame]:
    """Enriched rows and six marts under ``out``; returns them as read back."""
    enr = save_enriched(marts.enriched(job_skills, skills, jobs), out)
    write_marts(mart_frames(enr, jobs, as_of=as_of), out)
    return {name: spark.read.parquet(f"{out}/{name}") for name in SORTS}
