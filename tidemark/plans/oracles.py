"""ANSI SQL equivalents of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

import re

from tidemark.schemas import GENERIC_WORDS
from tidemark.sources.mapping import taxonomy_rows

W = r"\p{L}\p{N}_"

# Named subqueries in dependency order; a query takes along those it names, directly or not.
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def _needed(sql: str) -> list[str]:
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in PARTS:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(PARTS[name])
    return [name for name in PARTS if name in found]


def build(select: str) -> str:
    names = _needed(select)
    if not names:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in names) + "\n" + select


def ratio(num: str, den: str, digits: int, *, percent: bool = False) -> str:
    s = 10 ** (digits + (2 if percent else 0))
    return f"(((2 * {s} * CAST({num} AS HUGEINT) + ({den})) // (2 * ({den})))::BIGINT / {float(10**digits)})"


def signed_ratio(num: str, den: str, digits: int, *, percent: bool = False) -> str:
    s = 10 ** (digits + (2 if percent else 0))
    return (
        f"((CASE WHEN ({num}) < 0 THEN -1 ELSE 1 END) * "
        f"((2 * {s} * abs({num}) + ({den})) // (2 * ({den})))::BIGINT / {float(10**digits)})"
    )


def mean_units(units: str, per: int) -> str:
    return f"(sum({units})::DOUBLE / nullif(count({units}) * {per}, 0)::DOUBLE)"


def mean_exact(value: str, digits: int = 4) -> str:
    return mean_units(f"floor({value} * {float(10**digits)} + 0.5)::BIGINT", 10**digits)


# --- mapping A --------------------------------------------------------------------------------

part(
    "pt_jobs",
    """
    SELECT o_orderkey AS job_id, CAST(o_orderkey AS VARCHAR) AS job_platform_id, c_mktsegment AS search_role,
      n_name AS country_code, 'Posting ' || CAST(o_orderkey AS VARCHAR) AS title, c_name AS company_name,
      CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice * 0.8 AS DECIMAL(18,2)) END AS salary_min,
      CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_totalprice * 1.2 AS DECIMAL(18,2)) END AS salary_max,
      'USD' AS salary_currency,
      CASE o_orderstatus WHEN 'P' THEN 'permanent' WHEN 'F' THEN 'contract' ELSE '' END AS contract_type,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'full_time' WHEN '5-LOW' THEN 'part_time' ELSE '' END AS contract_time,
      o_orderdate AS job_posted_at
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
part(
    "pt_skills",
    """
    SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS skill_id, p_brand AS skill_name,
      'cat' || CAST(CAST(substr(p_brand, 7) AS BIGINT) % 5 AS VARCHAR) AS skill_category, '' AS skill_subcategory
    FROM part""",
)
part(
    "pt_tags",
    """
    SELECT l_orderkey AS job_id, CAST(substr(p_brand, 7) AS BIGINT) AS skill_id, p_brand AS skill_name,
      count(*) AS mention_count
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
part(
    "pt_enr",
    """
    SELECT t.job_id, t.skill_id, t.skill_name, s.skill_category, s.skill_subcategory, t.mention_count,
      j.job_platform_id, j.search_role, j.country_code, j.title AS job_title, j.company_name, j.salary_min, j.salary_max,
      j.salary_currency, j.contract_type, j.contract_time, j.job_posted_at,
      CAST(j.job_posted_at AS DATE) AS job_posted_date,
      CAST(100 * j.salary_min AS BIGINT) AS lo_cents, CAST(100 * j.salary_max AS BIGINT) AS hi_cents,
      CASE WHEN j.salary_min IS NOT NULL AND j.salary_max IS NOT NULL
             THEN CAST(100 * j.salary_min AS BIGINT) + CAST(100 * j.salary_max AS BIGINT)
           ELSE 2 * CAST(100 * coalesce(j.salary_min, j.salary_max) AS BIGINT) END AS mid_half
    FROM pt_tags t LEFT JOIN pt_skills s ON t.skill_id = s.skill_id JOIN pt_jobs j ON t.job_id = j.job_id""",
)

# --- marts ------------------------------------------------------------------------------------

part(
    "pt_totals",
    "SELECT search_role, country_code, count(DISTINCT job_id) AS total_jobs FROM pt_enr GROUP BY ALL",
)


def demand_sql(top_n: int | None) -> str:
    return f"""
    SELECT skill_id, skill_name, skill_category, skill_subcategory, search_role, country_code, job_count,
      total_jobs AS total_jobs_for_role, demand_percentage, avg_salary_min, avg_salary_max, avg_salary_midpoint,
      rank_in_role_country, rank_in_role_global
    FROM (
      SELECT c.*, t.total_jobs, {ratio("job_count", "total_jobs", 2, percent=True)} AS demand_percentage,
        row_number() OVER (PARTITION BY c.search_role, c.country_code ORDER BY job_count DESC, skill_name, skill_id)
          AS rank_in_role_country,
        row_number() OVER (PARTITION BY c.search_role ORDER BY job_count DESC, skill_name, c.country_code, skill_id)
          AS rank_in_role_global
      FROM (
        SELECT skill_id, skill_name, skill_category, skill_subcategory, search_role, country_code,
          count(DISTINCT job_id) AS job_count, {mean_units("lo_cents", 100)} AS avg_salary_min,
          {mean_units("hi_cents", 100)} AS avg_salary_max, {mean_units("mid_half", 200)} AS avg_salary_midpoint
        FROM pt_enr GROUP BY ALL) c
      JOIN pt_totals t ON c.search_role = t.search_role AND c.country_code = t.country_code)
    {"" if top_n is None else f"WHERE rank_in_role_country <= {top_n}"}"""


part("pt_demand", demand_sql(50))
part("pt_uncut", demand_sql(None))
part("pt_demand10", demand_sql(10))

part(
    "pt_pairs",
    f"""
    SELECT p.*, a.total AS skill_1_total, b.total AS skill_2_total,
      {ratio("cooccurrence_count", "a.total + b.total - cooccurrence_count", 4)} AS jaccard_similarity,
      {ratio("cooccurrence_count", "a.total", 4)} AS prob_skill2_given_skill1,
      {ratio("cooccurrence_count", "b.total", 4)} AS prob_skill1_given_skill2
    FROM (
      SELECT a.skill_id AS skill_id_1, a.skill_name AS skill_name_1, a.skill_category AS skill_category_1,
        b.skill_id AS skill_id_2, b.skill_name AS skill_name_2, b.skill_category AS skill_category_2,
        a.search_role, count(DISTINCT a.job_id) AS cooccurrence_count
      FROM pt_enr a JOIN pt_enr b ON a.job_id = b.job_id AND a.skill_id < b.skill_id GROUP BY ALL) p
    JOIN (SELECT skill_id, search_role, count(DISTINCT job_id) AS total FROM pt_enr GROUP BY ALL) a
      ON a.skill_id = p.skill_id_1 AND a.search_role = p.search_role
    JOIN (SELECT skill_id, search_role, count(DISTINCT job_id) AS total FROM pt_enr GROUP BY ALL) b
      ON b.skill_id = p.skill_id_2 AND b.search_role = p.search_role""",
)
part("pt_cooc", "SELECT * FROM pt_pairs WHERE cooccurrence_count >= 5")

part(
    "pt_pay",
    """
    SELECT skill_id, skill_name, skill_category, e.search_role, e.country_code, salary_currency,
      count(*) AS n, sum(mid_half) AS s, min(mid_half) AS lo, max(mid_half) AS hi, median(mid_half) AS med
    FROM pt_enr e WHERE mid_half > 0 GROUP BY ALL HAVING count(*) >= 5""",
)
part(
    "pt_market",
    """
    SELECT search_role, country_code, count(*) AS mn, sum(mid_half) AS ms, median(mid_half) AS mmed
    FROM (SELECT DISTINCT job_id, search_role, country_code, mid_half FROM pt_enr WHERE mid_half > 0) GROUP BY ALL""",
)
part(
    "pt_sal",
    f"""
    SELECT skill_id, skill_name, skill_category, p.search_role, p.country_code, salary_currency, n AS jobs_with_skill,
      {ratio("s", "n * 200", 2)} AS avg_salary_with_skill,
      ((2 * med)::BIGINT + 2) // 4 / 100.0::DOUBLE AS median_salary_with_skill,
      (lo + 1) // 2 / 100.0::DOUBLE AS min_salary_with_skill, (hi + 1) // 2 / 100.0::DOUBLE AS max_salary_with_skill,
      mn AS total_jobs_with_salary, {ratio("ms", "mn * 200", 2)} AS market_avg_salary,
      ((2 * mmed)::BIGINT + 2) // 4 / 100.0::DOUBLE AS market_median_salary,
      {signed_ratio("s * mn - ms * n", "n * mn * 200", 2)} AS salary_premium_absolute,
      {signed_ratio("s * mn - ms * n", "ms * n", 2, percent=True)} AS salary_premium_percentage,
      row_number() OVER (PARTITION BY p.search_role, p.country_code
        ORDER BY s::DOUBLE / n DESC, skill_name, skill_id, salary_currency) AS rank_by_salary
    FROM pt_pay p JOIN pt_market m ON p.search_role = m.search_role AND p.country_code = m.country_code""",
)


def leaderboard_sql(top_n: int | None) -> str:
    return f"""
    WITH c AS (
      SELECT company_name, search_role, country_code, count(DISTINCT job_id) AS job_count,
        {mean_units("CAST(100 * salary_min AS BIGINT)", 100)} AS avg_salary_min,
        {mean_units("CAST(100 * salary_max AS BIGINT)", 100)} AS avg_salary_max,
        {mean_units("CAST(200 * (coalesce(salary_min, salary_max) + coalesce(salary_max, salary_min)) / 2 AS BIGINT)", 200)}
          AS avg_salary_midpoint,
        count(DISTINCT CASE WHEN contract_time = 'full_time' THEN job_id END) AS full_time_count,
        count(DISTINCT CASE WHEN contract_time = 'part_time' THEN job_id END) AS part_time_count,
        count(DISTINCT CASE WHEN contract_type = 'contract' THEN job_id END) AS contract_count,
        count(DISTINCT CASE WHEN contract_type = 'permanent' THEN job_id END) AS permanent_count
      FROM pt_jobs WHERE company_name IS NOT NULL AND company_name <> '' GROUP BY ALL),
    k AS (
      SELECT company_name, country_code, sum(job_count)::BIGINT AS company_total_jobs_in_country,
        row_number() OVER (PARTITION BY country_code ORDER BY sum(job_count) DESC, company_name) AS rank_in_country
      FROM c GROUP BY company_name, country_code),
    r AS (
      SELECT *, row_number() OVER (PARTITION BY search_role, country_code ORDER BY job_count DESC, company_name)
        AS rank_in_role_country FROM c)
    SELECT r.*, k.rank_in_country, k.company_total_jobs_in_country, r.search_role AS roles_hiring
    FROM r LEFT JOIN k ON r.company_name = k.company_name AND r.country_code = k.country_code
    {"" if top_n is None else f"WHERE rank_in_role_country <= {top_n}"}"""


part("pt_lb", leaderboard_sql(100))
part("pt_segments", leaderboard_sql(None))
part("pt_lb10", leaderboard_sql(10))

part(
    "pt_names",
    """
    SELECT DISTINCT l_orderkey AS job_id, p_name AS skill_name, n_name AS search_role
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
part(
    "pt_roleset",
    """
    SELECT search_role, skill_name, count(DISTINCT job_id) AS job_count
    FROM pt_names GROUP BY ALL HAVING count(DISTINCT job_id) >= 40""",
)
part(
    "pt_sim",
    f"""
    WITH t AS (SELECT search_role, count(DISTINCT skill_name) AS total FROM pt_roleset GROUP BY ALL),
    p AS (
      SELECT a.search_role AS role_1, a.total AS role_1_total, b.search_role AS role_2, b.total AS role_2_total
      FROM t a CROSS JOIN t b WHERE a.search_role < b.search_role),
    m AS (
      SELECT a.search_role AS role_1, b.search_role AS role_2, a.skill_name
      FROM pt_roleset a JOIN pt_roleset b ON a.skill_name = b.skill_name AND a.search_role < b.search_role),
    g AS (
      SELECT p.role_1, p.role_2, p.role_1_total, p.role_2_total, count(DISTINCT m.skill_name) AS s,
        list_sort(list(DISTINCT m.skill_name) FILTER (WHERE m.skill_name IS NOT NULL)) AS names
      FROM p LEFT JOIN m ON p.role_1 = m.role_1 AND p.role_2 = m.role_2 GROUP BY ALL)
    SELECT role_1, role_2, s AS shared_skills_count, role_1_total - s AS role_1_unique_skills,
      role_2_total - s AS role_2_unique_skills, role_1_total, role_2_total,
      {ratio("s", "role_1_total + role_2_total - s", 4)} AS jaccard_similarity,
      {ratio("s", "least(role_1_total, role_2_total)", 4)} AS overlap_coefficient,
      {ratio("2 * s", "role_1_total + role_2_total", 4)} AS dice_coefficient,
      array_to_string(names[1:10], '|') AS top_shared_skills
    FROM g""",
)


def country_sql(min_jobs: int) -> str:
    return f"""
    SELECT skill_id, skill_name, skill_category, search_role, country_code, job_count, total_jobs, demand_percentage,
      rank_by_country,
      first_value(country_code) OVER w AS top_country_for_skill,
      first_value(demand_percentage) OVER w AS top_country_demand_pct
    FROM (
      SELECT c.*, t.total_jobs, {ratio("job_count", "total_jobs", 2, percent=True)} AS demand_percentage,
        row_number() OVER (PARTITION BY skill_name, c.search_role
          ORDER BY job_count::DOUBLE / total_jobs DESC, c.country_code, skill_id) AS rank_by_country
      FROM (
        SELECT skill_id, skill_name, skill_category, search_role, country_code, count(DISTINCT job_id) AS job_count
        FROM pt_enr GROUP BY ALL) c
      JOIN pt_totals t ON c.search_role = t.search_role AND c.country_code = t.country_code)
    WHERE job_count >= {min_jobs}
    WINDOW w AS (PARTITION BY skill_name, search_role ORDER BY demand_percentage DESC, country_code, skill_id)"""


part("pt_bycountry", country_sql(3))
part(
    "pt_countries",
    """SELECT n_name AS country_code, n_name || ' (' || r_name || ')' AS country_name
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
)

ORACLES: dict[str, str] = {}


def oracle(key: str, select: str) -> None:
    ORACLES[key] = select


MONEY_ENR = """
    CAST(salary_min AS DOUBLE) AS salary_min, CAST(salary_max AS DOUBLE) AS salary_max,
    mid_half / 200.0::DOUBLE AS salary_midpoint"""
oracle(
    "enriched",
    f"""SELECT job_id, skill_id, skill_name, skill_category, skill_subcategory, mention_count, job_platform_id,
      search_role, country_code, job_title, company_name, salary_currency, contract_type, contract_time, job_posted_at,
      job_posted_date, {MONEY_ENR} FROM pt_enr""",
)
oracle(
    "enriched_view",
    """SELECT search_role, country_code,
      CASE lower(substr(country_code, 1, 2)) WHEN 'gb' THEN 'GBP' WHEN 'us' THEN 'USD' WHEN 'au' THEN 'AUD' WHEN 'br' THEN 'BRL'
        WHEN 'ca' THEN 'CAD' WHEN 'in' THEN 'INR' WHEN 'mx' THEN 'MXN' WHEN 'nz' THEN 'NZD' WHEN 'pl' THEN 'PLN'
        WHEN 'ru' THEN 'RUB' WHEN 'sg' THEN 'SGD' WHEN 'za' THEN 'ZAR'
        ELSE CASE WHEN lower(substr(country_code, 1, 2)) IN ('at', 'be', 'de', 'fr', 'it', 'nl') THEN 'EUR' ELSE 'USD' END END AS currency,
      count(*) AS tags,
      CAST(sum((coalesce(salary_min, salary_max) + coalesce(salary_max, salary_min)) * 0.5::DECIMAL(2, 1)) AS DOUBLE) AS midpoints
      FROM pt_enr WHERE skill_category IS NOT NULL GROUP BY 1, 2""",
)
oracle(
    "jobs_estimated",
    """SELECT 'search_role' AS level, search_role AS member, count(DISTINCT job_id) AS jobs, true AS within_error FROM pt_enr GROUP BY 2
      UNION ALL SELECT 'country_code', country_code, count(DISTINCT job_id), true FROM pt_enr GROUP BY 2""",
)
oracle(
    "pay_quantiles",
    """SELECT search_role, count(*) AS jobs, true AS within_error FROM pt_jobs
      WHERE coalesce(salary_min, salary_max) IS NOT NULL GROUP BY 1""",
)
oracle("skill_demand", "SELECT * FROM pt_demand10")
oracle("skill_cooccurrence", "SELECT * FROM pt_pairs WHERE cooccurrence_count >= 60")
oracle("salary_by_skill", "SELECT * FROM pt_sal")
oracle("company_leaderboard", "SELECT * FROM pt_lb10")
oracle("role_similarity", "SELECT * FROM pt_sim")
oracle("skills_by_country", country_sql(15))

# --- serving ----------------------------------------------------------------------------------

DEMAND = """skill_name, skill_category, search_role, country_code, job_count, demand_percentage, avg_salary_min,
  avg_salary_max, avg_salary_midpoint, rank_in_role_country, rank_in_role_global"""
oracle(
    "demand_top",
    f"""SELECT {DEMAND} FROM pt_demand WHERE search_role = 'BUILDING' AND country_code = 'NATION_6'
        ORDER BY rank_in_role_country LIMIT 30""",
)
oracle(
    "demand_top_global",
    f"""SELECT skill_name, skill_category, search_role, sum(job_count)::BIGINT AS job_count,
      {mean_exact("demand_percentage", 2)} AS demand_percentage, {mean_exact("avg_salary_min")} AS avg_salary_min,
      {mean_exact("avg_salary_max")} AS avg_salary_max, {mean_exact("avg_salary_midpoint")} AS avg_salary_midpoint,
      min(rank_in_role_global) AS rank_in_role_global
      FROM pt_uncut WHERE search_role = 'BUILDING' GROUP BY ALL ORDER BY job_count DESC, skill_name LIMIT 30""",
)
oracle(
    "demand_all",
    f"""SELECT {DEMAND} FROM pt_demand WHERE rank_in_role_country <= 30""",
)
PAIR = """skill_name_1, skill_category_1, skill_name_2, skill_category_2, search_role, cooccurrence_count,
  jaccard_similarity, prob_skill2_given_skill1, prob_skill1_given_skill2"""
PAIR_ORDER = "ORDER BY cooccurrence_count DESC, skill_name_1, skill_name_2"
oracle("cooccurrence_top", f"SELECT {PAIR} FROM pt_cooc WHERE search_role = 'MACHINERY' {PAIR_ORDER} LIMIT 100")
oracle(
    "cooccurrence_for_skill",
    f"""SELECT {PAIR}, CASE WHEN skill_name_1 = 'Brand#7' THEN skill_name_2 ELSE skill_name_1 END AS paired_skill
        FROM pt_cooc WHERE search_role = 'MACHINERY' AND (skill_name_1 = 'Brand#7' OR skill_name_2 = 'Brand#7')
        {PAIR_ORDER} LIMIT 100""",
)
part(
    "pt_edges",
    f"""SELECT skill_name_1 AS source, skill_name_2 AS target, cooccurrence_count AS weight,
      coalesce(jaccard_similarity, 0.0::DOUBLE) AS similarity, skill_category_1 AS source_category,
      skill_category_2 AS target_category
      FROM pt_cooc WHERE search_role = 'MACHINERY' AND cooccurrence_count >= 10 {PAIR_ORDER} LIMIT 50""",
)
oracle("skill_network_edges", "SELECT * FROM pt_edges")
oracle(
    "skill_network_nodes",
    """SELECT id, coalesce(nullif(category, ''), 'Other') AS category, sum(weight)::BIGINT AS count FROM (
      SELECT source AS id, source_category AS category, weight FROM pt_edges
      UNION ALL SELECT target, target_category, weight FROM pt_edges) GROUP BY 1, 2""",
)
oracle(
    "skill_by_country",
    """SELECT b.skill_name, b.skill_category, b.search_role, b.country_code,
      coalesce(c.country_name, b.country_code) AS country_name, b.job_count, b.demand_percentage, b.rank_by_country,
      b.top_country_for_skill, b.top_country_demand_pct
      FROM pt_bycountry b LEFT JOIN pt_countries c ON b.country_code = c.country_code
      WHERE skill_name = 'Brand#7' AND search_role = 'MACHINERY'""",
)
oracle(
    "salary_skills",
    """SELECT skill_name, skill_category, search_role, country_code, salary_currency, jobs_with_skill,
      avg_salary_with_skill, median_salary_with_skill, market_avg_salary, salary_premium_absolute,
      salary_premium_percentage, rank_by_salary
      FROM pt_sal WHERE search_role = 'BUILDING' AND country_code = 'NATION_6' AND jobs_with_skill >= 5
      ORDER BY salary_premium_percentage DESC NULLS LAST, skill_name LIMIT 50""",
)


def pay_means(columns: list[str]) -> str:
    return ", ".join(f"{mean_exact(c, 2)} AS {c}" for c in columns)


ALL_PAY = [
    "avg_salary_with_skill",
    "median_salary_with_skill",
    "market_avg_salary",
    "salary_premium_absolute",
    "salary_premium_percentage",
]
oracle(
    "salary_skills_global",
    f"""SELECT skill_name, skill_category, search_role, sum(jobs_with_skill)::BIGINT AS jobs_with_skill,
      {pay_means(ALL_PAY)} FROM pt_sal WHERE search_role = 'BUILDING' AND jobs_with_skill >= 5 GROUP BY 1, 2, 3
      ORDER BY salary_premium_percentage DESC NULLS LAST, skill_name LIMIT 50""",
)
oracle(
    "top_paying_skills",
    f"""SELECT skill_name, skill_category, {pay_means(["avg_salary_with_skill", "salary_premium_percentage"])},
      sum(jobs_with_skill)::BIGINT AS jobs_with_skill FROM pt_sal WHERE search_role = 'BUILDING' GROUP BY 1, 2
      ORDER BY avg_salary_with_skill DESC, skill_name LIMIT 15""",
)
oracle(
    "premium_skills",
    """SELECT skill_name, skill_category, salary_premium_percentage, salary_premium_absolute, avg_salary_with_skill,
      market_avg_salary, jobs_with_skill FROM pt_sal WHERE search_role = 'BUILDING' AND country_code = 'NATION_6'
      ORDER BY salary_premium_percentage DESC, skill_name LIMIT 15""",
)
oracle(
    "salary_range",
    f"""SELECT min(avg_salary_with_skill) AS min_salary, max(avg_salary_with_skill) AS max_salary,
      {mean_exact("avg_salary_with_skill", 2)} AS avg_salary, {mean_exact("market_avg_salary", 2)} AS market_avg
      FROM pt_sal WHERE search_role = 'BUILDING'""",
)
oracle("skill_categories", "SELECT DISTINCT skill_category FROM pt_skills")
oracle(
    "skills_list",
    "SELECT skill_name, skill_category, skill_subcategory FROM pt_skills WHERE skill_category = 'cat2'",
)
oracle(
    "leaderboard_top",
    """SELECT company_name, search_role, country_code, job_count, avg_salary_min, avg_salary_max, avg_salary_midpoint,
      full_time_count, part_time_count, contract_count, rank_in_role_country FROM pt_lb
      WHERE search_role = 'BUILDING' AND country_code = 'NATION_6' ORDER BY rank_in_role_country LIMIT 50""",
)
oracle(
    "leaderboard_global",
    f"""SELECT company_name, search_role, sum(job_count)::BIGINT AS job_count,
      {", ".join(f"{mean_exact(c)} AS {c}" for c in ("avg_salary_min", "avg_salary_max", "avg_salary_midpoint"))},
      sum(full_time_count)::BIGINT AS full_time_count, sum(part_time_count)::BIGINT AS part_time_count,
      sum(contract_count)::BIGINT AS contract_count FROM pt_segments WHERE search_role = 'BUILDING' GROUP BY 1, 2
      ORDER BY job_count DESC, company_name LIMIT 50""",
)
MIX = """SELECT coalesce(sum(full_time_count), 0)::BIGINT AS full_time, coalesce(sum(part_time_count), 0)::BIGINT AS part_time,
      coalesce(sum(contract_count), 0)::BIGINT AS contract FROM pt_segments WHERE search_role = 'BUILDING'"""
oracle("contract_mix", MIX)
oracle(
    "company_search",
    """SELECT company_name, search_role, country_code, sum(job_count)::BIGINT AS job_count FROM pt_segments
      WHERE company_name ILIKE '%R#0000001%' GROUP BY 1, 2, 3
      ORDER BY job_count DESC, company_name, search_role, country_code LIMIT 20""",
)
oracle("role_pairs", """SELECT role_1, role_2, shared_skills_count, role_1_unique_skills, role_2_unique_skills,
      jaccard_similarity, overlap_coefficient, dice_coefficient, top_shared_skills FROM pt_sim""")
DIFFICULTY = "CASE WHEN {0} >= 0.5 THEN 'easy' WHEN {0} >= 0.3 THEN 'moderate' ELSE 'significant' END"
oracle(
    "role_transitions",
    f"""SELECT CASE WHEN role_1 = 'NATION_6' THEN role_2 ELSE role_1 END AS target_role,
      jaccard_similarity AS similarity, shared_skills_count AS shared_skills,
      {DIFFICULTY.format("jaccard_similarity")} AS difficulty, top_shared_skills AS shared_skill_list
      FROM pt_sim WHERE role_1 = 'NATION_6' OR role_2 = 'NATION_6'""",
)
part(
    "pt_cells",
    """SELECT role_1 AS "row", role_2 AS col, jaccard_similarity AS value FROM pt_sim
      UNION ALL SELECT role_2, role_1, jaccard_similarity FROM pt_sim
      UNION ALL SELECT r, r, 1.0::DOUBLE FROM (SELECT role_1 AS r FROM pt_sim UNION SELECT role_2 FROM pt_sim)""",
)
MATRIX_ROLES = [f"NATION_{i}" for i in range(25)]
oracle(
    "similarity_matrix",
    'SELECT "row", '
    + ", ".join(f"coalesce(max(value) FILTER (WHERE col = '{r}'), 0.0::DOUBLE) AS \"{r}\"" for r in MATRIX_ROLES)
    + ' FROM pt_cells GROUP BY "row"',
)
oracle("similarity_cells", "SELECT * FROM pt_cells")
oracle(
    "skill_gap",
    f"""SELECT 'NATION_9' AS from_role, 'NATION_6' AS to_role, skill_name, skill_category, job_count, similarity,
      shared_skills_count, difficulty
      FROM (SELECT skill_name, 'names' AS skill_category, sum(job_count)::BIGINT AS job_count FROM (
          SELECT skill_name, count(DISTINCT job_id) AS job_count FROM pt_names WHERE search_role = 'NATION_6' GROUP BY 1)
        GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20) t
      CROSS JOIN (SELECT jaccard_similarity AS similarity, shared_skills_count,
          {DIFFICULTY.format("jaccard_similarity")} AS difficulty
        FROM pt_sim WHERE role_1 = 'NATION_6' AND role_2 = 'NATION_9') p
      WHERE skill_name NOT IN (SELECT skill_name FROM pt_roleset WHERE search_role = 'NATION_9')
      ORDER BY job_count DESC, skill_name LIMIT 10""",
)
oracle(
    "summary_stats",
    """SELECT (SELECT count(*) FROM pt_jobs) AS total_jobs, (SELECT count(DISTINCT skill_id) FROM pt_tags) AS total_skills,
      count(DISTINCT country_code) AS total_countries, count(DISTINCT search_role) AS total_roles,
      count(DISTINCT company_name) AS total_companies FROM pt_jobs""",
)
oracle(
    "filter_options",
    """SELECT DISTINCT 'role' AS kind, search_role AS value, search_role AS label FROM pt_jobs
      UNION ALL SELECT DISTINCT 'country', j.country_code, coalesce(country_name, upper(j.country_code))
        FROM pt_jobs j LEFT JOIN pt_countries c ON c.country_code = j.country_code
      UNION ALL SELECT DISTINCT 'skill_category', skill_category, skill_category FROM pt_skills""",
)
oracle(
    "countries_with_data",
    """SELECT DISTINCT j.country_code, coalesce(country_name, upper(j.country_code)) AS country_name
      FROM pt_jobs j LEFT JOIN pt_countries c ON c.country_code = j.country_code""",
)
part(
    "pt_roles",
    """SELECT c_mktsegment AS role_name, CASE WHEN min(c_acctbal) < 0 THEN 'mixed' ELSE 'solvent' END AS role_category,
      c_mktsegment <> 'FURNITURE' AS is_active FROM customer GROUP BY 1""",
)
oracle("active_roles", "SELECT role_name, role_category FROM pt_roles WHERE is_active")

# --- shaping ----------------------------------------------------------------------------------

oracle(
    "category_share",
    f"""SELECT skill_category, job_count, {ratio("job_count", "total", 4)} AS share FROM (
      SELECT coalesce(nullif(skill_category, ''), 'Other') AS skill_category, sum(job_count)::BIGINT AS job_count,
        (SELECT sum(job_count)::BIGINT FROM pt_uncut) AS total FROM pt_uncut GROUP BY 1)""",
)
oracle(
    "top_n_by",
    """SELECT skill_name, search_role, country_code, salary_premium_percentage FROM pt_sal
      WHERE salary_premium_percentage IS NOT NULL
      ORDER BY salary_premium_percentage DESC, skill_name, search_role, country_code LIMIT 15""",
)
oracle(
    "contract_share",
    f"""SELECT contract_kind, job_count, {ratio("job_count", "total", 4)} AS share FROM (
      SELECT k AS contract_kind, n AS job_count, sum(n) OVER () AS total FROM (
        SELECT 'full_time' AS k, full_time AS n FROM ({MIX}) UNION ALL SELECT 'part_time', part_time FROM ({MIX})
        UNION ALL SELECT 'contract', contract FROM ({MIX}))) WHERE job_count > 0""",
)
oracle(
    "headline",
    """SELECT skill_name, search_role, country_code, avg_salary_with_skill FROM pt_sal
      ORDER BY avg_salary_with_skill DESC, skill_name, search_role, country_code LIMIT 1""",
)



# --- ingest -----------------------------------------------------------------------------------

part(
    "pt_event",
    """SELECT CAST(user_id AS VARCHAR) AS job_platform_id, event_type AS country_code, event_id AS search_role,
      ts AS extracted_at, 'batch-' || event_type AS extraction_batch_id, value FROM events""",
)
part(
    "pt_fresh",
    """SELECT * EXCLUDE (n) FROM (
        SELECT *, row_number() OVER (PARTITION BY job_platform_id, country_code ORDER BY extracted_at, search_role) AS n
        FROM pt_event) e
      WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM pt_event x WHERE x.value > 95
        AND x.job_platform_id = e.job_platform_id AND x.country_code = e.country_code)""",
)
oracle(
    "land_postings",
    """SELECT job_platform_id, search_role, country_code, 'batch-1' AS extraction_batch_id, title
      FROM pt_jobs, (SELECT unnest([1, 2]) AS copy)
      WHERE job_id % 97 <> 0 AND (copy = 1 OR job_id % 10 = 0)""",
)
oracle("dedup_first_wins", "SELECT * FROM pt_fresh")
oracle(
    "active_grid",
    """SELECT role_name AS search_role, c.country_code, c.country_name, coalesce(n, 0) AS postings
      FROM pt_roles CROSS JOIN pt_countries c
      LEFT JOIN (SELECT search_role, country_code, count(*) AS n FROM pt_jobs GROUP BY ALL) j
        ON j.search_role = role_name AND j.country_code = c.country_code
      WHERE is_active""",
)
oracle(
    "in_grid",
    """SELECT job_id, search_role, country_code FROM pt_jobs
      WHERE search_role = 'BUILDING' AND country_code = 'NATION_6'""",
)
oracle(
    "recent_postings",
    """SELECT job_id, search_role, country_code, job_posted_at FROM pt_jobs
      WHERE job_posted_at >= DATE '1998-08-02' - INTERVAL 180 DAY""",
)
oracle("recent_postings_stored", ORACLES["recent_postings"])
oracle(
    "batch_stats",
    """SELECT e.extraction_batch_id, e.n AS total_fetched, coalesce(f.n, 0) AS total_inserted,
      e.n - coalesce(f.n, 0) AS duplicates_skipped, date_sub('second', e.a, e.b) AS elapsed_seconds
      FROM (SELECT extraction_batch_id, count(*) AS n, min(extracted_at) AS a, max(extracted_at) AS b FROM pt_event
        GROUP BY 1) e
      LEFT JOIN (SELECT extraction_batch_id, count(*) AS n FROM pt_fresh GROUP BY 1) f
        ON e.extraction_batch_id = f.extraction_batch_id""",
)
part(
    "pt_brandterms",
    """
    WITH b AS (
      SELECT p_brand AS name, CAST(substr(p_brand, 7) AS BIGINT) AS k, list(DISTINCT p_name) AS names
      FROM part GROUP BY 1, 2),
    t AS (
      SELECT name AS term, name, k FROM b
      UNION ALL SELECT unnest(names), name, k FROM b WHERE k % 4 <> 0)
    SELECT term, name AS canonical, CASE WHEN k % 5 <> 0 THEN 'group ' || CAST(k % 5 AS VARCHAR) ELSE 'Unknown' END AS category,
      CASE WHEN k % 3 <> 0 THEN 'kind' ELSE '' END AS subcategory FROM t""",
)
oracle("taxonomy_terms", "SELECT * FROM pt_brandterms")
oracle(
    "seed_dims",
    """SELECT country_code, CASE WHEN contains(country_name, 'AFRICA') THEN country_name ELSE 'seed ' || country_name END
      AS country_name, true AS is_active FROM pt_countries""",
)
oracle(
    "unprocessed",
    """SELECT o_orderkey AS id, o_orderdate AS extracted_at FROM orders
      WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)

# --- staging ----------------------------------------------------------------------------------

part(
    "pt_staged",
    """
    SELECT job_platform_id, search_role, country_code, title,
      CASE WHEN job_id % 7 = 1 THEN '' ELSE company_name END AS company_name,
      'Order ' || job_platform_id AS description,
      CASE WHEN job_id % 9 = 0 THEN '' ELSE country_code END AS location_display,
      CASE WHEN job_id % 9 = 0 THEN '' ELSE 'World|' || country_code END AS location_areas,
      CASE WHEN job_id % 6 = 0 THEN '' ELSE 'jobs' END AS category_tag,
      CASE WHEN job_id % 6 = 0 THEN '' ELSE search_role END AS category_label,
      CAST(salary_min AS DOUBLE) AS salary_min, CAST(salary_max AS DOUBLE) AS salary_max,
      job_id % 4 = 0 AS salary_is_predicted, 'USD' AS salary_currency, contract_type, contract_time, '' AS redirect_url,
      CASE WHEN job_id % 11 = 0 OR job_id % 13 = 0 THEN NULL ELSE job_posted_at END AS job_posted_at
    FROM pt_jobs WHERE job_id % 97 <> 0""",
)
oracle("flatten_posting", "SELECT * FROM pt_staged")
oracle("stream_ingest", "SELECT * FROM pt_staged")
oracle(
    "stream_progress",
    """SELECT n + again AS total_fetched, n AS total_inserted, again AS duplicates_skipped, n AS known_keys
      FROM (SELECT count(*) AS n, count(*) FILTER (WHERE job_id % 10 = 0) AS again FROM pt_jobs WHERE job_id % 97 <> 0)""",
)
oracle(
    "posting_quarantine",
    """SELECT page_id AS id, url AS job_platform_id, 'payload is not a JSON object' AS parse_error
      FROM pages WHERE page_id % 3 <> 0""",
)
oracle(
    "currency_by_region",
    """SELECT doc_id AS job_id, lang AS country_code,
      CASE WHEN lang IN ('de', 'fr') THEN 'EUR' ELSE 'USD' END AS salary_currency FROM documents""",
)
oracle("value_midpoint", """SELECT job_id,
      CAST(coalesce(salary_min, salary_max) + coalesce(salary_max, salary_min) AS DOUBLE) / 2 AS salary_midpoint
      FROM pt_jobs""")
oracle(
    "region_names",
    """SELECT lang AS country_code, count(*) AS postings,
      CASE lang WHEN 'de' THEN 'Germany' WHEN 'fr' THEN 'France' ELSE upper(lang) END AS country_name
      FROM documents GROUP BY 1""",
)
oracle(
    "upsert_stage",
    """SELECT job_platform_id, country_code, search_role,
      CASE WHEN job_posted_at < TIMESTAMP '1997-01-01' THEN title ELSE title || ' again' END AS title,
      job_posted_at AS extracted_at,
      CASE WHEN job_posted_at < TIMESTAMP '1996-01-01' THEN job_posted_at
           ELSE TIMESTAMP '2024-01-01 12:00:00' END AS processed_at
      FROM pt_jobs""",
)
oracle("upsert_stage_table", ORACLES["upsert_stage"])
oracle(
    "upsert_tags",
    """SELECT l_orderkey AS job_id, CAST(substr(p_brand, 7) AS BIGINT) AS skill_id, p_brand AS skill_name,
      coalesce(sum(l_linenumber) FILTER (WHERE l_linenumber >= 3),
               sum(l_linenumber) FILTER (WHERE l_linenumber <= 3))::BIGINT AS mention_count,
      CASE WHEN min(l_linenumber) <= 3 THEN TIMESTAMP '2023-01-01' ELSE TIMESTAMP '2024-01-01' END AS extracted_at
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
)
oracle("upsert_tags_table", ORACLES["upsert_tags"])
SNAPSHOT = """skill_id, skill_name, search_role, country_code, job_count, demand_percentage, avg_salary_min,
      avg_salary_max"""
oracle("snapshot_demand", f"SELECT DATE '2024-01-01' AS snapshot_date, {SNAPSHOT} FROM pt_uncut")
part(
    "pt_founds",
    """SELECT l_orderkey AS job_id, p_brand AS skill_name, min(p_type) AS category, count(*) AS mention_count,
      CAST(substr(p_brand, 7) AS BIGINT) AS k
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
oracle(
    "assign_tag_ids",
    """SELECT job_id, skill_name, category, mention_count, CASE WHEN k <= 15 THEN k ELSE 0 END AS skill_id
      FROM pt_founds""",
)
oracle(
    "assign_tag_ids_dim",
    """SELECT * FROM pt_skills WHERE skill_id <= 15
      UNION ALL SELECT 0, skill_name, arg_min(category, (job_id, category)), '' FROM pt_founds WHERE k > 15 GROUP BY 2""",
)
oracle(
    "layer_counts",
    """SELECT 'raw.jobs' AS table_name, count(*) AS count FROM orders
      UNION ALL SELECT 'staging.stg_jobs', count(*) FROM pt_jobs
      UNION ALL SELECT 'staging.stg_job_skills', count(*) FROM pt_tags
      UNION ALL SELECT 'staging.dim_skills', count(*) FROM pt_skills
      UNION ALL SELECT 'staging.dim_job_roles', count(*) FROM pt_roles
      UNION ALL SELECT 'staging.dim_countries', count(*) FROM pt_countries""",
)
oracle(
    "progress",
    f"""SELECT total_raw, processed, total_skills, total_raw - processed AS remaining,
      {ratio("processed", "total_raw", 1, percent=True)} AS progress_percent
      FROM (SELECT (SELECT count(*) FROM customer) AS total_raw,
        (SELECT count(DISTINCT o_custkey) FROM orders) AS processed, (SELECT count(*) FROM pt_tags) AS total_skills)""",
)

# --- text -------------------------------------------------------------------------------------
# A consuming pattern needs a boundary character on either side. Doubling every such character, in
# text and terms alike, lets neighbouring matches have one each.


def literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def doubled(term: str) -> str:
    return re.sub(r"(\W)", r"\1\1", term)


part(
    "pt_docs",
    f"""SELECT doc_id AS job_id, text, source, lang,
      '  ' || regexp_replace(text, '([^{W}])', '\\1\\1', 'g') || '  ' AS dbl FROM documents""",
)
part(
    "pt_taxo",
    "SELECT * FROM (VALUES "
    + ", ".join(
        "(" + ", ".join(literal(v) for v in (r["name"], r["category"], r["subcategory"], "|".join(r["aliases"] or []))) + ")"
        for r in taxonomy_rows()
    )
    + ") v(name, category, subcategory, aliases)",
)
part(
    "pt_terms",
    "SELECT term, canonical, coalesce(category, 'Unknown') AS category, coalesce(subcategory, '') AS subcategory"
    " FROM (VALUES "
    + ", ".join(
        "(" + ", ".join(literal(v) for v in (t, r["name"], r["category"], r["subcategory"])) + ")"
        for r in taxonomy_rows()
        for t in [r["name"], *(r["aliases"] or [])]
    )
    + ") v(term, canonical, category, subcategory)",
)
def phrase_hits() -> str:
    phrases = sorted({t for r in taxonomy_rows() for t in [r["name"], *(r["aliases"] or [])] if re.search(r"\W", t)})
    return " UNION ALL ".join(
        f"""SELECT job_id, {literal(t)} AS term,
          len(regexp_extract_all(lower(dbl), {literal(f"[^{W}]" + re.escape(doubled(t.lower())) + f"[^{W}]")})) AS n
          FROM pt_docs"""
        for t in phrases
    )


part(
    "pt_hits",
    f"""SELECT job_id, canonical AS skill_name, category, subcategory, sum(n)::BIGINT AS mention_count
      FROM (
        SELECT job_id, lower(word) AS term, count(*) AS n
        FROM (SELECT job_id, unnest(regexp_extract_all(text, '[{W}]+')) AS word FROM pt_docs) GROUP BY 1, 2
        UNION ALL {phrase_hits()}) h
      JOIN pt_terms t ON h.term = t.term
      WHERE n > 0 GROUP BY 1, 2, 3, 4""",
)
part(
    "pt_looks",
    f"""SELECT job_id, text, list_transform(regexp_extract_all(dbl,
      '[^{W}]([A-Z][a-z]+[A-Z][a-z]*|[A-Z]{{2,}}|[a-zA-Z]+\\p{{Nd}}+|[a-zA-Z]+--[a-zA-Z]+)[^{W}]', 1),
      lambda x: replace(x, '--', '-')) AS looks FROM pt_docs""",
)
part(
    "pt_routed",
    """SELECT d.job_id, coalesce(k, 0) AS known_skills,
      coalesce(k, 0) < 5 OR ('0x' || substr(md5(CAST(d.job_id AS VARCHAR)), 1, 8))::BIGINT % 10 = 0 AS needs_discovery
      FROM pt_docs d LEFT JOIN (SELECT job_id, count(*) AS k FROM pt_hits GROUP BY 1) h ON d.job_id = h.job_id""",
)
part(
    "pt_cands",
    """SELECT job_id, (generate_subscripts(looks, 1) - 1)::INTEGER AS position, unnest(looks) AS text, 'other' AS label,
      0.8::DOUBLE AS score
      FROM pt_looks WHERE length(trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) >= 50""",
)
GENERIC = ", ".join(literal(w) for w in GENERIC_WORDS)
part(
    "pt_checked",
    f"""SELECT job_id, position, text AS skill_name, 'Other' AS category, label AS subcategory, score AS confidence,
      lower(text) IN (SELECT lower(name) FROM pt_taxo) AS verified
      FROM (SELECT *, row_number() OVER (PARTITION BY job_id, lower(text) ORDER BY position) AS n FROM pt_cands
        WHERE length(text) >= 2)
      WHERE n = 1 AND lower(text) NOT IN ({GENERIC})""",
)
METHOD = "CASE WHEN verified THEN 'gliner_verified' ELSE 'gliner_unverified' END"


def merged_sql(where: str) -> str:
    return f"""
    SELECT * EXCLUDE (n, priority) FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id, lower(skill_name) ORDER BY priority, position NULLS FIRST, skill_name)
        AS n
      FROM (
        SELECT job_id, skill_name, category, subcategory, mention_count, NULL::DOUBLE AS confidence, true AS verified,
          'taxonomy' AS extraction_method, NULL::INTEGER AS position, 1 AS priority FROM pt_hits
        UNION ALL
        SELECT job_id, skill_name, category, subcategory, 1, confidence, verified, {METHOD}, position,
          CASE WHEN verified THEN 2 ELSE 3 END FROM pt_checked {where}))
    WHERE n = 1"""


part("pt_merged", merged_sql(""))
part("pt_hybrid", merged_sql("WHERE job_id IN (SELECT job_id FROM pt_routed WHERE needs_discovery)"))
oracle(
    "compile_terms",
    f"""SELECT term, canonical, '(?iu)(?<![{W}])\\Q' || term || '\\E(?![{W}])' AS pattern,
      CASE WHEN regexp_full_match(term, '[{W}]+') THEN 'word' ELSE 'phrase' END AS kind,
      regexp_extract(lower(term), '[{W}]+') AS anchor FROM pt_brandterms""",
)
oracle("extract_terms", "SELECT * FROM pt_hits")
oracle("extract_terms_basic", "SELECT * FROM pt_hits")
oracle(
    "extract_phrases",
    f"""SELECT * FROM (WITH b AS (SELECT regexp_extract_all(lower(text), '[{W}]+|[^{W}]+') AS t FROM benchmark),
      phrases AS (SELECT DISTINCT array_to_string(t[i:i + k - 1], '') AS name
        FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM b), (SELECT unnest([3, 5]) AS k)
        WHERE regexp_matches(t[i], '^[{W}]') AND i + k - 1 <= len(t)),
      kept AS (SELECT name FROM (SELECT name, regexp_extract_all(name, '[{W}]+') AS w FROM phrases) WHERE len(w) = len(list_distinct(w))),
      d AS (SELECT job_id, regexp_extract_all(lower(text), '[{W}]+|[^{W}]+') AS t FROM pt_docs),
      places AS (SELECT job_id, t, unnest(range(1, len(t) + 1)) AS i FROM d),
      held AS (SELECT job_id, array_to_string(t[i:i + k - 1], '') AS name FROM places, (SELECT unnest([3, 5]) AS k)
        WHERE regexp_matches(t[i], '^[{W}]') AND i + k - 1 <= len(t))
      SELECT job_id, name AS skill_name, 'phrase' AS category, '' AS subcategory, count(*) AS mention_count
      FROM held JOIN kept USING (name) GROUP BY ALL)""",
)
oracle(
    "rebuild",
    "SELECT job_id, skill_name, mention_count, extraction_method FROM pt_hybrid WHERE verified",
)
oracle(
    "rebuild_tables",
    f"""SELECT 'stg_jobs' AS table_name, CAST(job_id AS VARCHAR) AS key, lang AS value FROM pt_docs
      UNION ALL SELECT 'stg_job_skills', job_id || '|' || skill_name, mention_count || '|' || verified || '|' || extraction_method
        FROM pt_merged
      UNION ALL SELECT 'dim_skills', skill_name, any_value(category || '|' || subcategory) FROM pt_merged GROUP BY skill_name
      UNION ALL SELECT 'discoveries', skill_key, name || '|' || occurrence_count || '|' || first_seen FROM pt_alldisc
      UNION ALL SELECT 'quarantine', CAST(job_id AS VARCHAR), 'payload is not a JSON object' FROM pt_docs WHERE job_id % 40 = 7""",
)
oracle(
    "term_coverage",
    """SELECT l.job_id, coalesce(k, 0) AS matched_skills, coalesce(m, 0)::BIGINT AS total_mentions,
      array_to_string(list_sort(list_filter(list_distinct(looks),
        lambda x: NOT list_contains(coalesce(names, []), x)))[1:20], '|') AS unmatched_potential_terms,
      least(1.0::DOUBLE, coalesce(k, 0)::DOUBLE / greatest(1, len(list_distinct(looks)))) AS coverage_confidence
      FROM pt_looks l LEFT JOIN (SELECT job_id, count(*) AS k, sum(mention_count) AS m, list(skill_name) AS names
        FROM pt_hits GROUP BY 1) h ON l.job_id = h.job_id""",
)
oracle("route_docs", "SELECT * FROM pt_routed")
oracle("candidate_terms", "SELECT * FROM pt_cands")
oracle("candidate_terms_finder", "SELECT * FROM pt_cands")
oracle(
    "clean_candidates",
    f"""SELECT job_id, position, text AS skill_name,
      CASE label WHEN 'database' THEN 'Database' WHEN 'etl tool' THEN 'Data Engineering' ELSE 'Other' END AS category,
      label AS subcategory, score AS confidence
      FROM (SELECT *, row_number() OVER (PARTITION BY job_id, lower(text) ORDER BY position) AS n FROM (
          SELECT job_id, position, text,
            CASE length(text) % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'etl tool' ELSE 'other' END AS label,
            least(10, length(text)) / 10.0::DOUBLE AS score FROM pt_cands)
        WHERE score >= 0.5 AND length(text) >= 2)
      WHERE n = 1 AND lower(text) NOT IN ({GENERIC})""",
)
oracle("verify_candidates", f"SELECT *, {METHOD} AS extraction_method FROM pt_checked")
oracle("merge_terms", "SELECT * FROM pt_merged")
oracle("merge_terms_new", "SELECT * FROM pt_merged WHERE extraction_method = 'gliner_unverified'")
oracle("hybrid_extract", "SELECT * FROM pt_hybrid")
oracle("hybrid_extract_new", "SELECT * FROM pt_hybrid WHERE extraction_method = 'gliner_unverified'")
oracle(
    "extraction_stats",
    """SELECT n AS total_extractions, n - d AS fast_path_only, d AS finder_invoked, v AS verified_skills,
      u AS unverified_skills, (n - d)::DOUBLE / greatest(1, n) AS fast_path_ratio, d::DOUBLE / greatest(1, n) AS finder_ratio
      FROM (SELECT count(*) AS n, count(*) FILTER (WHERE needs_discovery) AS d FROM pt_routed)
      CROSS JOIN (SELECT count(*) FILTER (WHERE verified) AS v, count(*) FILTER (WHERE NOT verified) AS u FROM pt_hybrid)""",
)

# --- discovery --------------------------------------------------------------------------------



def sightings_sql(merged: str) -> str:
    seen = "TIMESTAMP '2024-01-01' + to_minutes(h.job_id % 525600)"
    return f"""SELECT h.*, lower(skill_name) AS skill_key, d.source || ' @ ' || d.lang AS context, {seen} AS seen_at,
      row_number() OVER (PARTITION BY lower(skill_name) ORDER BY {seen}, h.job_id, position) AS nth
      FROM {merged} h JOIN pt_docs d ON h.job_id = d.job_id WHERE extraction_method = 'gliner_unverified'"""


def disc_sql(sightings: str) -> str:
    return f"""SELECT skill_key, max(skill_name) FILTER (WHERE nth = 1) AS name,
      max(category) FILTER (WHERE nth = 1) AS category, max(subcategory) FILTER (WHERE nth = 1) AS subcategory,
      min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS occurrence_count,
      sum(floor(confidence * 1000.0 + 0.5)::BIGINT)::DOUBLE / (count(*) * 1000)::DOUBLE AS avg_confidence,
      string_agg(context, '|' ORDER BY nth) FILTER (WHERE nth <= 5) AS sample_contexts, false AS is_promoted
      FROM {sightings} GROUP BY 1"""


part("pt_seen", sightings_sql("pt_hybrid"))
part("pt_disc", disc_sql("pt_seen"))
part("pt_allseen", sightings_sql("pt_merged"))
part("pt_alldisc", disc_sql("pt_allseen"))
FIT = "occurrence_count >= 3 AND avg_confidence >= 0.75"
oracle("discoveries", "SELECT * FROM pt_disc")
oracle("promotion_candidates", f"SELECT * FROM pt_disc WHERE {FIT}")
oracle(
    "promote_terms",
    f"""SELECT name, category, subcategory, nullif(aliases, '') AS aliases FROM pt_taxo
      UNION ALL SELECT name, category, subcategory, '' FROM pt_disc
        WHERE {FIT} AND skill_key NOT IN (SELECT lower(name) FROM pt_taxo)""",
)
oracle(
    "promote_terms_dim",
    f"""SELECT skill_name, skill_category, skill_subcategory FROM pt_skills
      UNION ALL SELECT name, category, subcategory FROM pt_disc
        WHERE {FIT} AND name NOT IN (SELECT skill_name FROM pt_skills)""",
)
oracle(
    "discovery_stats",
    f"""SELECT count(*) AS total_discoveries, 0::BIGINT AS promoted_count,
      count(*) FILTER (WHERE {FIT}) AS pending_promotion,
      (SELECT string_agg(name || ':' || category || ':' || CAST(occurrence_count AS VARCHAR), '|'
          ORDER BY occurrence_count DESC, skill_key)
        FROM (SELECT * FROM pt_disc ORDER BY occurrence_count DESC, skill_key LIMIT 10)) AS top_pending
      FROM pt_disc""",
)
# Staged documents have neither title nor company, so all contexts are alike.
part("pt_streamed", disc_sql("(SELECT * REPLACE (' @ ' AS context) FROM pt_allseen)"))
oracle("stream_discoveries", "SELECT * FROM pt_streamed")
oracle(
    "stream_job_skills",
    "SELECT job_id, skill_name, skill_name AS entry, mention_count, verified, extraction_method FROM pt_merged",
)
oracle(
    "stream_promotions",
    f"""SELECT skill_key, category, occurrence_count,
      {FIT} AND skill_key NOT IN (SELECT lower(name) FROM pt_taxo) AS is_promoted FROM pt_alldisc""",
)

# --- quality and extras -----------------------------------------------------------------------

oracle(
    "dq_not_null",
    """SELECT 'job_id' AS column_name, count(*) FILTER (WHERE job_id IS NULL) AS failures FROM pt_enr
      UNION ALL SELECT 'salary_min', count(*) FILTER (WHERE salary_min IS NULL) FROM pt_enr
      UNION ALL SELECT 'salary_max', count(*) FILTER (WHERE salary_max IS NULL) FROM pt_enr""",
)
oracle(
    "dq_unique",
    "SELECT l_suppkey, l_partkey, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
oracle(
    "dq_relationships",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)


def repeats(mart: str, table: str, keys: str) -> str:
    return f"""SELECT '{mart}' AS mart, count(*) AS failures
      FROM (SELECT {keys} FROM {table} GROUP BY {keys} HAVING count(*) > 1)"""


oracle(
    "dq_mart_keys",
    " UNION ALL ".join(
        [
            repeats("skill_demand", "pt_demand", "skill_id, search_role, country_code"),
            repeats("skill_cooccurrence", "pt_cooc", "skill_id_1, skill_id_2, search_role"),
            repeats("salary_by_skill", "pt_sal", "skill_id, search_role, country_code, salary_currency"),
            repeats("company_leaderboard", "pt_lb", "company_name, search_role, country_code"),
            "SELECT 'role_similarity', 0",
            repeats("skills_by_country", "pt_bycountry", "skill_id, search_role, country_code"),
        ]
    ),
)


def snapshot_at(year: int) -> str:
    known = demand_sql(None).replace("pt_totals", f"(SELECT search_role, country_code, count(DISTINCT job_id) AS total_jobs "
        f"FROM pt_enr WHERE job_posted_at < TIMESTAMP '{year}-01-01' GROUP BY ALL)")
    known = known.replace("FROM pt_enr GROUP BY ALL) c", f"FROM pt_enr WHERE job_posted_at < TIMESTAMP '{year}-01-01' GROUP BY ALL) c")
    return f"SELECT DATE '{year}-01-01' AS snapshot_date, {SNAPSHOT} FROM ({known})"


part("pt_history", " UNION ALL ".join(snapshot_at(y) for y in (1996, 1998, 2000)))
oracle(
    "skill_trend",
    """SELECT snapshot_date, skill_name, search_role, country_code, job_count, demand_percentage,
      CASE WHEN lag(snapshot_date) OVER w = previous THEN job_count - lag(job_count) OVER w END AS job_count_change,
      CASE WHEN lag(snapshot_date) OVER w = previous THEN (floor(demand_percentage * 100.0 + 0.5)::BIGINT
        - lag(floor(demand_percentage * 100.0 + 0.5)::BIGINT) OVER w) / 100.0::DOUBLE END AS percentage_change
      FROM pt_history JOIN (SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS previous
        FROM (SELECT DISTINCT snapshot_date FROM pt_history)) USING (snapshot_date) WINDOW w AS (PARTITION BY skill_name, search_role, country_code ORDER BY snapshot_date)""",
)
oracle(
    "skill_demand_rollup",
    f"""SELECT d.skill_id, skill_name, skill_category, d.search_role, d.country_code, job_count, total_jobs,
      {ratio("job_count", "total_jobs", 2, percent=True)} AS demand_percentage, avg_salary_min
      FROM (
        SELECT skill_id, skill_name, skill_category, search_role, country_code, count(DISTINCT job_id) AS job_count,
          {mean_units("lo_cents", 100)} AS avg_salary_min
        FROM pt_enr GROUP BY GROUPING SETS ((skill_id, skill_name, skill_category, search_role, country_code),
          (skill_id, skill_name, skill_category, search_role), (skill_id, skill_name, skill_category))) d
      JOIN (SELECT search_role, country_code, count(DISTINCT job_id) AS total_jobs FROM pt_enr
        GROUP BY GROUPING SETS ((search_role, country_code), (search_role), ())) t
      ON d.search_role IS NOT DISTINCT FROM t.search_role AND d.country_code IS NOT DISTINCT FROM t.country_code""",
)
oracle(
    "normalize_tags",
    """SELECT job_id, search_role, country_code,
      CASE WHEN skill_id > 20 THEN 'Brand#' || CAST(skill_id - 20 AS VARCHAR) ELSE skill_name END AS skill_name,
      sum(mention_count)::BIGINT AS mention_count FROM pt_enr GROUP BY 1, 2, 3, 4""",
)
oracle(
    "posting_match",
    f"""SELECT * FROM (
      SELECT candidate_id, m.search_role, matched_skills, total - matched_skills AS missing_skills,
        {ratio("matched_skills", "total", 4)} AS score,
        row_number() OVER (PARTITION BY candidate_id
          ORDER BY {ratio("matched_skills", "total", 4)} DESC, matched_skills DESC, m.search_role) AS rank
      FROM (SELECT o_custkey AS candidate_id, r.search_role, count(DISTINCT n.skill_name) AS matched_skills
        FROM pt_names n JOIN orders ON o_orderkey = n.job_id JOIN pt_roleset r ON r.skill_name = n.skill_name
        GROUP BY 1, 2) m
      JOIN (SELECT search_role, count(*) AS total FROM pt_roleset GROUP BY 1) t ON t.search_role = m.search_role)
      WHERE rank <= 3""",
)


def oracle_sql() -> dict[str, str]:
    return {key: build(sql) for key, sql in ORACLES.items()}
