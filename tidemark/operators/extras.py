"""Trends over snapshots, totals over all segments, spelling variants, and matching people to roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exact import cents, exact_ratio
from tidemark.operators.marts import jobs_per_segment
from tidemark.session import saved


def skill_trend(history: DataFrame) -> DataFrame:
    """Change of jobs and share of a skill from one snapshot to the next.

    Without a row in the snapshot just before, a change is null. Only the distinct dates go into one window.
    """
    dates = history.select("snapshot_date").distinct()
    dates = dates.withColumn("_previous", F.lag("snapshot_date").over(Window.orderBy("snapshot_date")))
    history = history.join(dates, "snapshot_date")
    before = Window.partitionBy("skill_name", "search_role", "country_code").orderBy("snapshot_date")
    adjacent = F.lag("snapshot_date").over(before) == F.col("_previous")
    hundredths = F.floor(F.col("demand_percentage") * 100.0 + 0.5).cast("bigint")
    return history.select(
        "snapshot_date",
        "skill_name",
        "search_role",
        "country_code",
        "job_count",
        "demand_percentage",
        F.when(adjacent, F.col("job_count") - F.lag("job_count").over(before)).alias("job_count_change"),
        F.when(adjacent, (hundredths - F.lag(hundredths).over(before)) / F.lit(100.0)).alias("percentage_change"),
    )


def skill_demand_rollup(enr: DataFrame) -> DataFrame:
    """Demand per (skill, role, country), per (skill, role) and per skill; NULL stands for all.

    Groups are counted once at the finest level and the counts rolled up, so the postings are not expanded.
    """
    fine = enr.groupBy("skill_id", "skill_name", "skill_category", "search_role", "country_code").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cents(F.col("salary_min"))).alias("s"),
        F.count("salary_min").alias("c"),
    )
    skill = [F.col("skill_id"), F.col("skill_name"), F.col("skill_category")]
    role, country = F.col("search_role"), F.col("country_code")
    counted = fine.groupingSets([[*skill, role, country], [*skill, role], skill], *skill, role, country).agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("n").alias("job_count"),
        (F.sum("s").cast("double") / (F.nullif(F.sum("c"), F.lit(0).cast("bigint")) * 100)).alias("avg_salary_min"),
    )
    jobs = jobs_per_segment(enr)
    totals = jobs.groupingSets([[role, country], [role], []], role, country).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("total_jobs").alias("total_jobs")
    )
    d, t = counted.alias("d"), totals.alias("t")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("level", "search_role", "country_code")]
    return d.join(t, same).select(
        "d.skill_id",
        "d.skill_name",
        "d.skill_category",
        "d.search_role",
        "d.country_code",
        "d.job_count",
        "t.total_jobs",
        exact_ratio(F.col("d.job_count"), F.col("t.total_jobs"), 2, percent=True).alias("demand_percentage"),
        "d.avg_salary_min",
    )


def normalize_tags(enr: DataFrame, aliases: DataFrame) -> DataFrame:
    """Spelling variants under one name, counted together per job."""
    known = aliases.select(F.lower("alias").alias("_key"), F.col("canonical").alias("_name"))
    joined = enr.join(known, F.lower("skill_name") == F.col("_key"), "left")
    name = F.coalesce("_name", F.col("skill_name"))
    return joined.groupBy("job_id", "search_role", "country_code", name.alias("skill_name")).agg(
        F.sum("mention_count").alias("mention_count")
    )


def posting_match(candidate_skills: DataFrame, role_skills: DataFrame, *, limit: int = 10) -> DataFrame:
    """Roles whose skills a candidate has most of, with what is missing.

    The roles' skills are written once: Catalyst knows their size and broadcasts them if they are small, so rows dealt
    by candidate stay where they are.
    """
    role_skills = saved(role_skills.select("search_role", "skill_name"), "role-skills")
    totals = role_skills.groupBy("search_role").agg(F.count_distinct("skill_name").alias("role_skills"))
    asked = role_skills.select("search_role", "skill_name").distinct()
    have = candidate_skills.select("candidate_id", "skill_name").distinct()
    matched = have.join(asked, "skill_name").groupBy("candidate_id", "search_role").agg(
        F.count(F.lit(1)).alias("matched_skills")
    )
    scored = matched.join(totals, "search_role").select(
        "candidate_id",
        "search_role",
        "matched_skills",
        (F.col("role_skills") - F.col("matched_skills")).alias("missing_skills"),
        exact_ratio(F.col("matched_skills"), F.col("role_skills"), 4).alias("score"),
    )
    best = Window.partitionBy("candidate_id").orderBy(F.desc("score"), F.desc("matched_skills"), "search_role")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))
