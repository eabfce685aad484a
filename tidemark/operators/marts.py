"""The enriched posting-skill view and the six marts built on it.

``(job_id, skill_id)`` is unique in the enriched rows (``upsert_tags`` keeps it so and
``dq_unique`` checks it), hence jobs per skill are plain counts that combine map-side. Only
"jobs having any skill" needs a distinct count, and its first shuffle is by job.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exact import (
    cents,
    exact_ratio,
    exact_ratio_wide,
    half_cents,
    int_div,
    mean_units,
    product,
    value_midpoint,
)
from tidemark.functions.ranking import split_row_number, value_stats
from tidemark.session import saved


#: What marts read of the enriched rows: no long text, which every skill of a posting would repeat.
MART_COLUMNS = (
    "job_id skill_id skill_name skill_category skill_subcategory mention_count job_platform_id search_role country_code "
    "job_title company_name salary_min salary_max salary_is_predicted salary_currency salary_midpoint contract_type "
    "contract_time job_posted_at job_posted_date"
).split()


def enriched(job_skills: DataFrame, skills: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per (job, skill) with skill category, posting columns, pay midpoint and posted date.

    Postings without any skill do not appear; a skill missing from the dimension keeps a NULL category.
    """
    dim = skills.select("skill_id", "skill_category", "skill_subcategory")
    posting = jobs.withColumns(
        {
            "salary_midpoint": value_midpoint(F.col("salary_min"), F.col("salary_max")),
            "job_posted_date": F.to_date("job_posted_at"),
        }
    ).withColumnRenamed("title", "job_title")
    facts = job_skills.select("job_id", "skill_id", "skill_name", "mention_count")
    return facts.join(posting, "job_id").join(dim, "skill_id", "left")


def with_period(mart: DataFrame, as_of: date | None) -> DataFrame:
    """Label rows with the 30 days up to ``as_of``. The labels filter nothing."""
    if as_of is None:
        return mart
    return mart.withColumns(
        {"period_start": F.lit(as_of - timedelta(days=30)), "period_end": F.lit(as_of), "updated_at": F.current_timestamp()}
    )


def jobs_per_segment(enr: DataFrame) -> DataFrame:
    """Jobs having at least one skill, per (role, country)."""
    return (
        enr.select("search_role", "country_code", "job_id")
        .distinct()
        .groupBy("search_role", "country_code")
        .agg(F.count(F.lit(1)).alias("total_jobs"))
    )


def skill_demand(enr: DataFrame, *, top_n: int | None = 50, as_of: date | None = None) -> DataFrame:
    """Jobs, share of the segment's jobs, mean pay and two ranks per (skill, role, country).

    Both ranks are taken before the cut to ``top_n`` skills per (role, country). With None all skills stay, for totals
    and history, and there is no ``rank_in_role_country``.
    """
    counted = enr.groupBy(
        "skill_id", "skill_name", "skill_category", "skill_subcategory", "search_role", "country_code"
    ).agg(
        F.count(F.lit(1)).alias("job_count"),
        mean_units(cents(F.col("salary_min")), 100).alias("avg_salary_min"),
        mean_units(cents(F.col("salary_max")), 100).alias("avg_salary_max"),
        mean_units(half_cents(F.col("salary_midpoint")), 200).alias("avg_salary_midpoint"),
    )
    order = [F.desc("job_count"), F.col("skill_name"), F.col("skill_id")]
    ranked = split_row_number(
        counted,
        ["search_role"],
        [F.desc("job_count"), F.col("skill_name"), F.col("country_code"), F.col("skill_id")],
        "rank_in_role_global",
    )
    rank = []
    if top_n is not None:
        in_segment = F.row_number().over(Window.partitionBy("search_role", "country_code").orderBy(*order))
        ranked = ranked.withColumn("rank_in_role_country", in_segment).filter(F.col("rank_in_role_country") <= top_n)
        rank = [F.col("rank_in_role_country").cast("bigint").alias("rank_in_role_country")]
    mart = ranked.join(jobs_per_segment(enr), ["search_role", "country_code"]).select(
        "skill_id",
        "skill_name",
        "skill_category",
        "skill_subcategory",
        "search_role",
        "country_code",
        "job_count",
        F.col("total_jobs").alias("total_jobs_for_role"),
        exact_ratio(F.col("job_count"), F.col("total_jobs"), 2, percent=True).alias("demand_percentage"),
        "avg_salary_min",
        "avg_salary_max",
        "avg_salary_midpoint",
        *rank,
        "rank_in_role_global",
    )
    return with_period(mart, as_of)


def skill_cooccurrence(enr: DataFrame, *, min_count: int = 5, as_of: date | None = None) -> DataFrame:
    """Pairs of skills asked for by the same job, per role, with Jaccard and both conditional shares.

    A pair cannot be more frequent than its rarer skill, so skills under ``min_count`` in a role
    leave before the self join; the result is the same and the long tail makes no pairs.
    """
    totals = enr.groupBy("search_role", "skill_id", "skill_name", "skill_category").agg(
        F.count(F.lit(1)).alias("total")
    )
    tags = enr.select("job_id", "search_role", "skill_id")
    if min_count > 1:
        frequent = totals.filter(F.col("total") >= min_count).select("search_role", "skill_id")
        tags = tags.join(frequent, ["search_role", "skill_id"], "left_semi")

    # Both sides need the same columns, so they share one shuffle.
    same = (F.col("a.job_id") == F.col("b.job_id")) & (F.col("a.search_role") == F.col("b.search_role"))
    pairs = (
        tags.alias("a")
        .join(tags.alias("b"), same & (F.col("a.skill_id") < F.col("b.skill_id")))
        .groupBy("a.search_role", F.col("a.skill_id").alias("skill_id_1"), F.col("b.skill_id").alias("skill_id_2"))
        .agg(F.count(F.lit(1)).alias("cooccurrence_count"))
        .filter(F.col("cooccurrence_count") >= min_count)
    )

    def side(i: int) -> DataFrame:
        return totals.select(
            "search_role",
            F.col("skill_id").alias(f"skill_id_{i}"),
            F.col("skill_name").alias(f"skill_name_{i}"),
            F.col("skill_category").alias(f"skill_category_{i}"),
            F.col("total").alias(f"skill_{i}_total"),
        )

    both = F.col("cooccurrence_count")
    mart = (
        pairs.join(side(1), ["search_role", "skill_id_1"])
        .join(side(2), ["search_role", "skill_id_2"])
        .select(
            "skill_id_1",
            "skill_name_1",
            "skill_category_1",
            "skill_id_2",
            "skill_name_2",
            "skill_category_2",
            "search_role",
            "cooccurrence_count",
            "skill_1_total",
            "skill_2_total",
            exact_ratio(both, F.col("skill_1_total") + F.col("skill_2_total") - both, 4).alias("jaccard_similarity"),
            exact_ratio(both, F.col("skill_1_total"), 4).alias("prob_skill2_given_skill1"),
            exact_ratio(both, F.col("skill_2_total"), 4).alias("prob_skill1_given_skill2"),
        )
    )
    return with_period(mart, as_of)


def _pay_stats(rows: DataFrame, keys: list[str], prefix: str, *, min_jobs: int) -> DataFrame:
    """Jobs, pay sum, ends and median of ``value`` per group, with a prefix."""
    counted = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("freq"))
    stats = value_stats(counted, keys, min_rows=min_jobs)
    return stats.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in stats.columns if c not in keys])


def salary_by_skill(enr: DataFrame, *, min_jobs: int = 5, as_of: date | None = None) -> DataFrame:
    """Pay of jobs asking for a skill against all paid jobs of the (role, country).

    Pay is counted in half-cents per distinct value first, so sums, ends and the exact median all
    work on counted values.
    """
    paid = enr.filter(F.col("salary_midpoint") > 0).withColumn("value", half_cents(F.col("salary_midpoint")))
    segment = ["search_role", "country_code"]
    skill = ["skill_id", "skill_name", "skill_category", *segment, "salary_currency"]
    paid_jobs = paid.select("job_id", *segment, "value").distinct()
    market = _pay_stats(paid_jobs, segment, "m", min_jobs=1)
    by_skill = _pay_stats(paid, skill, "s", min_jobs=min_jobs)

    # A segment's rows here are skills with enough paid jobs: as many as the vocabulary, whatever the number of jobs.
    best = Window.partitionBy(*segment).orderBy(
        (F.col("s_total").cast("double") / F.col("s_jobs")).desc(), "skill_name", "skill_id", "salary_currency"
    )
    ranked = by_skill.withColumn("rank_by_salary", F.row_number().over(best).cast("bigint"))
    two_hundred = F.lit(200).cast("decimal(3,0)")

    def mean_pay(p: str) -> Column:
        return exact_ratio_wide(F.col(f"{p}_total"), F.col(f"{p}_jobs") * two_hundred, 2)

    def median_pay(p: str) -> Column:
        quarter_cents = F.col(f"{p}_median_lo") + F.col(f"{p}_median_hi")
        return int_div(quarter_cents + F.lit(2).cast("bigint"), F.lit(4).cast("bigint")) / F.lit(100.0)

    def end_pay(c: str) -> Column:
        return int_div(F.col(c) + F.lit(1).cast("bigint"), F.lit(2).cast("bigint")) / F.lit(100.0)

    gap = product(F.col("s_total"), F.col("m_jobs")) - product(F.col("m_total"), F.col("s_jobs"))
    mart = ranked.join(market, segment).select(
        "skill_id",
        "skill_name",
        "skill_category",
        "search_role",
        "country_code",
        "salary_currency",
        F.col("s_jobs").alias("jobs_with_skill"),
        mean_pay("s").alias("avg_salary_with_skill"),
        median_pay("s").alias("median_salary_with_skill"),
        end_pay("s_low").alias("min_salary_with_skill"),
        end_pay("s_high").alias("max_salary_with_skill"),
        F.col("m_jobs").alias("total_jobs_with_salary"),
        mean_pay("m").alias("market_avg_salary"),
        median_pay("m").alias("market_median_salary"),
        exact_ratio_wide(gap, product(F.col("s_jobs"), F.col("m_jobs") * 200), 2).alias("salary_premium_absolute"),
        exact_ratio_wide(gap, product(F.col("m_total"), F.col("s_jobs")), 2, percent=True).alias(
            "salary_premium_percentage"
        ),
        "rank_by_salary",
    )
    return with_period(mart, as_of)


def company_segments(jobs: DataFrame) -> DataFrame:
    """Postings, pay and contract kinds per (company, role, country): all companies, for totals and search."""
    midpoint = value_midpoint(F.col("salary_min"), F.col("salary_max"))
    return jobs.filter(F.col("company_name") != "").groupBy("company_name", "search_role", "country_code").agg(
        F.count(F.lit(1)).alias("job_count"),
        mean_units(cents(F.col("salary_min")), 100).alias("avg_salary_min"),
        mean_units(cents(F.col("salary_max")), 100).alias("avg_salary_max"),
        mean_units(half_cents(midpoint), 200).alias("avg_salary_midpoint"),
        F.count_if(F.col("contract_time") == "full_time").alias("full_time_count"),
        F.count_if(F.col("contract_time") == "part_time").alias("part_time_count"),
        F.count_if(F.col("contract_type") == "contract").alias("contract_count"),
        F.count_if(F.col("contract_type") == "permanent").alias("permanent_count"),
    )


def company_leaderboard(jobs: DataFrame, *, top_n: int = 100, as_of: date | None = None) -> DataFrame:
    """The ``top_n`` companies of each (role, country) with their ``company_segments`` and rank in the country."""
    company = saved(company_segments(jobs), "companies")
    in_segment = F.row_number().over(
        Window.partitionBy("search_role", "country_code").orderBy(F.desc("job_count"), "company_name")
    )
    top = company.withColumn("rank_in_role_country", in_segment).filter(F.col("rank_in_role_country") <= top_n)
    in_country = split_row_number(
        company.groupBy("company_name", "country_code").agg(F.sum("job_count").alias("company_total_jobs_in_country")),
        ["country_code"],
        [F.desc("company_total_jobs_in_country"), F.col("company_name")],
        "rank_in_country",
    )
    mart = (
        top.join(in_country, ["company_name", "country_code"], "left")
        .withColumn("roles_hiring", F.array("search_role"))
        .withColumn("rank_in_role_country", F.col("rank_in_role_country").cast("bigint"))
    )
    return with_period(mart, as_of)


def role_skills(enr: DataFrame, *, min_jobs: int = 3) -> DataFrame:
    """Skills of a role that at least ``min_jobs`` of its jobs ask for."""
    return (
        enr.groupBy("search_role", "skill_id", "skill_name")
        .agg(F.count(F.lit(1)).alias("job_count"))
        .filter(F.col("job_count") >= min_jobs)
    )


def role_similarity(
    enr: DataFrame, *, min_jobs: int = 3, max_shared: int = 10, as_of: date | None = None
) -> DataFrame:
    """Overlap of the skill sets of every two roles, also of those sharing nothing.

    The result itself has a row per pair of roles; roles are a fixed dimension. Shared skills are
    listed alphabetically, at most ``max_shared``, NULL when there is none.
    """
    skills = role_skills(enr, min_jobs=min_jobs)
    totals = skills.groupBy("search_role").agg(F.count_distinct("skill_id").alias("total"))
    # Each role meets the later ones: the sorted role list (one entry per role) is unfolded from its place on.
    listed = totals.agg(F.array_sort(F.collect_list(F.struct("search_role", "total"))).alias("roles"))
    pairs = (
        listed.select("roles", F.posexplode("roles").alias("at", "one"))
        .select("one", F.explode(F.slice("roles", F.col("at") + 2, F.size("roles"))).alias("two"))
        .select(
            F.col("one.search_role").alias("role_1"),
            F.col("two.search_role").alias("role_2"),
            F.col("one.total").alias("role_1_total"),
            F.col("two.total").alias("role_2_total"),
        )
    )
    names = skills.select("search_role", "skill_name").distinct()
    one = names.select("skill_name", F.col("search_role").alias("role_1"))
    two = names.select("skill_name", F.col("search_role").alias("role_2"))
    shared = one.join(two, "skill_name").filter(F.col("role_1") < F.col("role_2"))
    counts = shared.groupBy("role_1", "role_2").agg(F.count(F.lit(1)).alias("shared"))
    first = F.row_number().over(Window.partitionBy("role_1", "role_2").orderBy("skill_name"))
    tops = (
        shared.withColumn("_n", first)
        .filter(F.col("_n") <= max_shared)
        .groupBy("role_1", "role_2")
        .agg(F.array_sort(F.collect_list("skill_name")).alias("top_shared_skills"))
    )
    t1, t2, s = F.col("role_1_total"), F.col("role_2_total"), F.col("shared_skills_count")
    mart = (
        pairs.join(counts, ["role_1", "role_2"], "left")
        .join(tops, ["role_1", "role_2"], "left")
        .withColumn("shared_skills_count", F.coalesce("shared", F.lit(0).cast("bigint")))
        .select(
            "role_1",
            "role_2",
            "shared_skills_count",
            (t1 - s).alias("role_1_unique_skills"),
            (t2 - s).alias("role_2_unique_skills"),
            "role_1_total",
            "role_2_total",
            exact_ratio(s, t1 + t2 - s, 4).alias("jaccard_similarity"),
            exact_ratio(s, F.least(t1, t2), 4).alias("overlap_coefficient"),
            exact_ratio(s * 2, t1 + t2, 4).alias("dice_coefficient"),
            "top_shared_skills",
        )
    )
    return with_period(mart, as_of)


def skills_by_country(enr: DataFrame, *, min_jobs: int = 3, as_of: date | None = None) -> DataFrame:
    """Share of a skill over the countries of a role, with the leading country.

    Ranks are taken over all rows; the leading country only over rows with ``min_jobs`` jobs, so
    the two can disagree.
    """
    counted = enr.groupBy("skill_id", "skill_name", "skill_category", "search_role", "country_code").agg(
        F.count(F.lit(1)).alias("job_count")
    )
    over = Window.partitionBy("skill_name", "search_role")
    ratio = F.col("job_count") / F.col("total_jobs")
    ranked = counted.join(jobs_per_segment(enr), ["search_role", "country_code"]).select(
        "*",
        exact_ratio(F.col("job_count"), F.col("total_jobs"), 2, percent=True).alias("demand_percentage"),
        F.row_number().over(over.orderBy(ratio.desc(), "country_code", "skill_id")).cast("bigint").alias("rank_by_country"),
    )
    leading = over.orderBy(F.desc("demand_percentage"), "country_code", "skill_id")
    mart = ranked.filter(F.col("job_count") >= min_jobs).select(
        "skill_id",
        "skill_name",
        "skill_category",
        "search_role",
        "country_code",
        "job_count",
        "total_jobs",
        "demand_percentage",
        "rank_by_country",
        F.first("country_code").over(leading).alias("top_country_for_skill"),
        F.first("demand_percentage").over(leading).alias("top_country_demand_pct"),
    )
    return with_period(mart, as_of)
