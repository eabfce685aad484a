"""Questions asked of the marts: filters, top-k lists and small aggregates.

Views over several segments, totals and search want the uncut aggregates (``skill_demand(top_n=None)``,
``company_segments``); the lists of one segment read the ranked marts. Global views average the per-country averages without weights, as their callers expect;
``weighted=True`` weights by jobs where offered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import mean_exact

DEMAND_COLUMNS = [
    "skill_name",
    "skill_category",
    "search_role",
    "country_code",
    "job_count",
    "demand_percentage",
    "avg_salary_min",
    "avg_salary_max",
    "avg_salary_midpoint",
    "rank_in_role_country",
    "rank_in_role_global",
]
PAIR_COLUMNS = [
    "skill_name_1",
    "skill_category_1",
    "skill_name_2",
    "skill_category_2",
    "search_role",
    "cooccurrence_count",
    "jaccard_similarity",
    "prob_skill2_given_skill1",
    "prob_skill1_given_skill2",
]


def _pair_order() -> list[Column]:
    return [F.desc("cooccurrence_count"), F.asc("skill_name_1"), F.asc("skill_name_2")]


def _segment(mart: DataFrame, role: str | None, country: str | None = None) -> DataFrame:
    if role is not None:
        mart = mart.filter(F.col("search_role") == role)
    if country is not None:
        mart = mart.filter(F.col("country_code") == country)
    return mart


# --- demand -----------------------------------------------------------------------------------


def demand_top(demand: DataFrame, *, role: str, country: str, limit: int = 30) -> DataFrame:
    return _segment(demand, role, country).select(*DEMAND_COLUMNS).orderBy("rank_in_role_country").limit(limit)


def demand_top_global(demand: DataFrame, *, role: str, limit: int = 30) -> DataFrame:
    return (
        _segment(demand, role)
        .groupBy("skill_name", "skill_category", "search_role")
        .agg(
            F.sum("job_count").alias("job_count"),
            mean_exact(F.col("demand_percentage"), 2).alias("demand_percentage"),
            mean_exact(F.col("avg_salary_min")).alias("avg_salary_min"),
            mean_exact(F.col("avg_salary_max")).alias("avg_salary_max"),
            mean_exact(F.col("avg_salary_midpoint")).alias("avg_salary_midpoint"),
            F.min("rank_in_role_global").alias("rank_in_role_global"),
        )
        .orderBy(F.desc("job_count"), "skill_name", "skill_category")
        .limit(limit)
    )


def demand_all(demand: DataFrame, *, max_rank: int = 30, limit: int | None = None) -> DataFrame:
    """The leading skills of every role and country; ``limit`` is a caller's page size."""
    ranked = (
        demand.filter(F.col("rank_in_role_country") <= max_rank)
        .select(*DEMAND_COLUMNS)
        .orderBy("search_role", "country_code", "rank_in_role_country")
    )
    return ranked if limit is None else ranked.limit(limit)


# --- co-occurrence ----------------------------------------------------------------------------


def cooccurrence_top(cooc: DataFrame, *, role: str, min_count: int = 5, limit: int = 100) -> DataFrame:
    frequent = _segment(cooc, role).filter(F.col("cooccurrence_count") >= min_count)
    return frequent.select(*PAIR_COLUMNS).orderBy(*_pair_order()).limit(limit)


def cooccurrence_for_skill(
    cooc: DataFrame, *, role: str, skill: str, min_count: int = 5, limit: int = 100
) -> DataFrame:
    """Pairs with ``skill`` on either side; ``paired_skill`` is the other side."""
    either = (F.col("skill_name_1") == skill) | (F.col("skill_name_2") == skill)
    other = F.when(F.col("skill_name_1") == skill, F.col("skill_name_2")).otherwise(F.col("skill_name_1"))
    found = _segment(cooc, role).filter(either & (F.col("cooccurrence_count") >= min_count))
    return found.select(*PAIR_COLUMNS, other.alias("paired_skill")).orderBy(*_pair_order()).limit(limit)


def skill_network_edges(cooc: DataFrame, *, role: str, min_count: int = 10, limit: int = 50) -> DataFrame:
    return (
        _segment(cooc, role)
        .filter(F.col("cooccurrence_count") >= min_count)
        .orderBy(*_pair_order())
        .limit(limit)
        .select(
            F.col("skill_name_1").alias("source"),
            F.col("skill_name_2").alias("target"),
            F.col("cooccurrence_count").alias("weight"),
            F.coalesce("jaccard_similarity", F.lit(0.0)).alias("similarity"),
            F.col("skill_category_1").alias("source_category"),
            F.col("skill_category_2").alias("target_category"),
        )
    )


def skill_network_nodes(edges: DataFrame) -> DataFrame:
    """Both ends of the edges, with their weighted degree over those edges."""
    ends = edges.select(F.col("source").alias("id"), F.col("source_category").alias("category"), "weight").unionByName(
        edges.select(F.col("target").alias("id"), F.col("target_category").alias("category"), "weight")
    )
    filled = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("Other"))
    return ends.withColumn("category", filled).groupBy("id", "category").agg(F.sum("weight").alias("count"))


# --- countries --------------------------------------------------------------------------------


def region_names(df: DataFrame, countries: DataFrame, *, upper_fallback: bool = True) -> DataFrame:
    """Add ``country_name``; an unknown code shows itself, in capitals by default."""
    names = countries.select("country_code", F.col("country_name").alias("_known"))
    code = F.upper("country_code") if upper_fallback else F.col("country_code")
    joined = df.join(names, "country_code", "left")
    return joined.withColumn("country_name", F.coalesce("_known", code)).drop("_known")


def skill_by_country(mart: DataFrame, countries: DataFrame, *, skill: str, role: str) -> DataFrame:
    found = _segment(mart, role).filter((F.col("skill_name") == skill) & (F.col("job_count") >= 3))
    named = region_names(found, countries, upper_fallback=False)
    return named.select(
        "skill_name",
        "skill_category",
        "search_role",
        "country_code",
        "country_name",
        "job_count",
        "demand_percentage",
        "rank_by_country",
        "top_country_for_skill",
        "top_country_demand_pct",
    ).orderBy(F.desc("demand_percentage"), "country_code")


def countries_with_data(jobs: DataFrame, countries: DataFrame) -> DataFrame:
    seen = jobs.filter(F.col("country_code").isNotNull()).select("country_code").distinct()
    return region_names(seen, countries).select("country_code", "country_name").orderBy("country_name")


# --- pay --------------------------------------------------------------------------------------


def salary_skills(sal: DataFrame, *, role: str, country: str, min_jobs: int = 5, limit: int = 50) -> DataFrame:
    return (
        _segment(sal, role, country)
        .filter(F.col("jobs_with_skill") >= min_jobs)
        .select(
            "skill_name",
            "skill_category",
            "search_role",
            "country_code",
            "salary_currency",
            "jobs_with_skill",
            "avg_salary_with_skill",
            "median_salary_with_skill",
            "market_avg_salary",
            "salary_premium_absolute",
            "salary_premium_percentage",
            "rank_by_salary",
        )
        .orderBy(F.desc_nulls_last("salary_premium_percentage"), "skill_name", "salary_currency")
        .limit(limit)
    )


def salary_skills_global(
    sal: DataFrame, *, role: str, min_jobs: int = 5, limit: int = 50, weighted: bool = False
) -> DataFrame:
    """Per-skill pay over all countries; ``weighted=True`` weights by jobs and keeps currencies apart."""
    measures = [
        "avg_salary_with_skill",
        "median_salary_with_skill",
        "market_avg_salary",
        "salary_premium_absolute",
        "salary_premium_percentage",
    ]
    keys = ["skill_name", "skill_category", "search_role"]

    def mean(c: str) -> Column:
        if not weighted:
            return mean_exact(F.col(c), 2)
        units = F.floor(F.col(c) * 100.0 + 0.5).cast("bigint")
        jobs = F.sum(F.when(units.isNotNull(), F.col("jobs_with_skill")))
        return F.sum(units * F.col("jobs_with_skill")).cast("double") / (F.nullif(jobs, F.lit(0).cast("bigint")) * 100)

    if weighted:
        keys.append("salary_currency")
    return (
        _segment(sal, role)
        .filter(F.col("jobs_with_skill") >= min_jobs)
        .groupBy(*keys)
        .agg(F.sum("jobs_with_skill").alias("jobs_with_skill"), *[mean(c).alias(c) for c in measures])
        .filter(F.col("jobs_with_skill") >= min_jobs)
        .orderBy(F.desc_nulls_last("salary_premium_percentage"), *keys)
        .limit(limit)
    )


def _ranked_pay(
    sal: DataFrame, role: str, country: str | None, measure: str, columns: list[str], min_jobs: int, limit: int
) -> DataFrame:
    rows = _segment(sal, role, country).filter((F.col("jobs_with_skill") >= min_jobs) & F.col(measure).isNotNull())
    if country is None:
        rows = rows.groupBy("skill_name", "skill_category").agg(
            *[mean_exact(F.col(c), 2).alias(c) for c in columns], F.sum("jobs_with_skill").alias("jobs_with_skill")
        )
    shown = rows.select("skill_name", "skill_category", *columns, "jobs_with_skill")
    return shown.orderBy(F.desc(measure), "skill_name", "skill_category").limit(limit)


def top_paying_skills(
    sal: DataFrame, *, role: str, country: str | None = None, min_jobs: int = 5, limit: int = 15
) -> DataFrame:
    columns = ["avg_salary_with_skill", "salary_premium_percentage"]
    return _ranked_pay(sal, role, country, "avg_salary_with_skill", columns, min_jobs, limit)


def premium_skills(
    sal: DataFrame, *, role: str, country: str | None = None, min_jobs: int = 5, limit: int = 15
) -> DataFrame:
    columns = ["salary_premium_percentage", "salary_premium_absolute", "avg_salary_with_skill", "market_avg_salary"]
    return _ranked_pay(sal, role, country, "salary_premium_percentage", columns, min_jobs, limit)


def salary_range(sal: DataFrame, *, role: str, country: str | None = None, min_jobs: int = 5) -> DataFrame:
    pay = F.col("avg_salary_with_skill")
    return (
        _segment(sal, role, country)
        .filter((F.col("jobs_with_skill") >= min_jobs) & pay.isNotNull())
        .agg(
            F.min(pay).alias("min_salary"),
            F.max(pay).alias("max_salary"),
            mean_exact(pay, 2).alias("avg_salary"),
            mean_exact(F.col("market_avg_salary"), 2).alias("market_avg"),
        )
    )


# --- skills dimension -------------------------------------------------------------------------


def skill_categories(skills: DataFrame) -> DataFrame:
    known = skills.filter(F.col("skill_category").isNotNull())
    return known.select("skill_category").distinct().orderBy("skill_category")


def skills_list(skills: DataFrame, *, category: str | None = None) -> DataFrame:
    chosen = skills if category is None else skills.filter(F.col("skill_category") == category)
    return chosen.select("skill_name", "skill_category", "skill_subcategory").orderBy("skill_name")


# --- companies --------------------------------------------------------------------------------


def leaderboard_top(lb: DataFrame, *, role: str, country: str, limit: int = 50) -> DataFrame:
    return (
        _segment(lb, role, country)
        .select(
            "company_name",
            "search_role",
            "country_code",
            "job_count",
            "avg_salary_min",
            "avg_salary_max",
            "avg_salary_midpoint",
            "full_time_count",
            "part_time_count",
            "contract_count",
            "rank_in_role_country",
        )
        .orderBy("rank_in_role_country")
        .limit(limit)
    )


def leaderboard_global(lb: DataFrame, *, role: str, limit: int = 50) -> DataFrame:
    pay = ["avg_salary_min", "avg_salary_max", "avg_salary_midpoint"]
    counts = ["full_time_count", "part_time_count", "contract_count"]
    return (
        _segment(lb, role)
        .groupBy("company_name", "search_role")
        .agg(
            F.sum("job_count").alias("job_count"),
            *[mean_exact(F.col(c)).alias(c) for c in pay],
            *[F.sum(c).alias(c) for c in counts],
        )
        .orderBy(F.desc("job_count"), "company_name")
        .limit(limit)
    )


def contract_mix(lb: DataFrame, *, role: str, country: str | None = None) -> DataFrame:
    """Postings per contract kind over the companies of ``lb``, 0 where there are none."""

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0).cast("bigint"))

    return _segment(lb, role, country).agg(
        total("full_time_count").alias("full_time"),
        total("part_time_count").alias("part_time"),
        total("contract_count").alias("contract"),
    )


def company_search(lb: DataFrame, *, query: str, role: str | None = None, limit: int = 20) -> DataFrame:
    """Companies whose name contains ``query``, whatever the case; wildcards in it stand for themselves."""
    found = _segment(lb, role).filter(F.contains(F.lower("company_name"), F.lower(F.lit(query))))
    return (
        found.groupBy("company_name", "search_role", "country_code")
        .agg(F.sum("job_count").alias("job_count"))
        .orderBy(F.desc("job_count"), "company_name", "search_role", "country_code")
        .limit(limit)
    )


# --- careers ----------------------------------------------------------------------------------


def difficulty(similarity: Column, *, easy: float = 0.5, moderate: float = 0.3) -> Column:
    return F.when(similarity >= easy, "easy").when(similarity >= moderate, "moderate").otherwise("significant")


def role_pairs(sim: DataFrame) -> DataFrame:
    return sim.select(
        "role_1",
        "role_2",
        "shared_skills_count",
        "role_1_unique_skills",
        "role_2_unique_skills",
        "jaccard_similarity",
        "overlap_coefficient",
        "dice_coefficient",
        "top_shared_skills",
    ).orderBy(F.desc("jaccard_similarity"), "role_1", "role_2")


def role_transitions(sim: DataFrame, *, role: str, easy: float = 0.5, moderate: float = 0.3) -> DataFrame:
    """Roles to move to from ``role``, nearest first."""
    other = F.when(F.col("role_1") == role, F.col("role_2")).otherwise(F.col("role_1"))
    near = sim.filter((F.col("role_1") == role) | (F.col("role_2") == role))
    return near.select(
        other.alias("target_role"),
        F.col("jaccard_similarity").alias("similarity"),
        F.col("shared_skills_count").alias("shared_skills"),
        difficulty(F.col("jaccard_similarity"), easy=easy, moderate=moderate).alias("difficulty"),
        F.slice("top_shared_skills", 1, 10).alias("shared_skill_list"),
    ).orderBy(F.desc("similarity"), "target_role")


def similarity_matrix(sim: DataFrame, *, roles: list[str] | None = None, long: bool = False) -> DataFrame:
    """Square matrix of Jaccard values: 1 on the diagonal, 0 where a pair is missing.

    ``long=True`` gives the cells (row, col, value) that exist, for many roles. ``roles`` limits rows and columns
    and spares the pivot a pass that looks them up.
    """
    value = F.col("jaccard_similarity")
    there = sim.select(F.col("role_1").alias("row"), F.col("role_2").alias("col"), value.alias("value"))
    back = sim.select(F.col("role_2").alias("row"), F.col("role_1").alias("col"), value.alias("value"))
    seen = there.select("row").union(back.select("row")).distinct()
    diagonal = seen.select("row", F.col("row").alias("col"), F.lit(1.0).alias("value"))
    cells = there.unionByName(back).unionByName(diagonal)
    if roles is not None:
        cells = cells.filter(F.col("row").isin(roles) & F.col("col").isin(roles))
    if long:
        return cells
    return cells.groupBy("row").pivot("col", roles).agg(F.first("value")).fillna(0.0)


def skill_gap(
    demand: DataFrame,
    role_skills: DataFrame,
    sim: DataFrame,
    *,
    from_role: str,
    to_role: str,
    target_top: int = 20,
    limit: int = 10,
) -> DataFrame:
    """Most asked skills of ``to_role`` that ``from_role`` does not already have, with the similarity of both."""
    target = (
        demand.filter(F.col("search_role") == to_role)
        .groupBy("skill_name", "skill_category")
        .agg(F.sum("job_count").alias("job_count"))
        .orderBy(F.desc("job_count"), "skill_name", "skill_category")
        .limit(target_top)
    )
    known = role_skills.filter(F.col("search_role") == from_role).select("skill_name")
    between = (F.col("role_1") == min(from_role, to_role)) & (F.col("role_2") == max(from_role, to_role))
    # The pair is one row of the mart: a scalar, NULL where the mart has no such pair.
    pair = sim.filter(between).agg(F.max(F.struct("jaccard_similarity", "shared_skills_count"))).scalar()
    missing = target.join(known, "skill_name", "left_anti").withColumn("_pair", pair)
    return (
        missing.filter(F.col("_pair").isNotNull())
        .select(
            F.lit(from_role).alias("from_role"),
            F.lit(to_role).alias("to_role"),
            "skill_name",
            "skill_category",
            "job_count",
            F.col("_pair.jaccard_similarity").alias("similarity"),
            F.col("_pair.shared_skills_count").alias("shared_skills_count"),
            difficulty(F.col("_pair.jaccard_similarity")).alias("difficulty"),
        )
        .orderBy(F.desc("job_count"), "skill_name")
        .limit(limit)
    )


# --- dashboard --------------------------------------------------------------------------------


def summary_stats(jobs: DataFrame, job_skills: DataFrame) -> DataFrame:
    """Jobs, skills, countries, roles and companies in one row.

    Postings are counted per (role, country, company) first, so the three distinct counts expand
    the few combinations and not the postings.
    """
    combos = jobs.groupBy("search_role", "country_code", "company_name").agg(F.count(F.lit(1)).alias("_n"))
    skills = job_skills.agg(F.count_distinct("skill_id")).scalar()
    return combos.agg(
        F.coalesce(F.sum("_n"), F.lit(0).cast("bigint")).alias("total_jobs"),
        F.count_distinct("country_code").alias("total_countries"),
        F.count_distinct("search_role").alias("total_roles"),
        F.count_distinct("company_name").alias("total_companies"),
    ).withColumn("total_skills", skills)


def filter_options(jobs: DataFrame, skills: DataFrame, countries: DataFrame) -> DataFrame:
    """Values to filter by, one row each: kind, value and the label to show."""
    segments = jobs.select("search_role", "country_code").distinct()
    roles = segments.select(
        F.lit("role").alias("kind"), F.col("search_role").alias("value"), F.col("search_role").alias("label")
    ).distinct()
    places = countries_with_data(segments, countries).select(
        F.lit("country").alias("kind"), F.col("country_code").alias("value"), F.col("country_name").alias("label")
    )
    groups = skill_categories(skills).select(
        F.lit("skill_category").alias("kind"),
        F.col("skill_category").alias("value"),
        F.col("skill_category").alias("label"),
    )
    return roles.unionByName(places).unionByName(groups)


def active_roles(roles: DataFrame) -> DataFrame:
    return roles.filter("is_active").select("role_name", "role_category").orderBy("role_category", "role_name")
