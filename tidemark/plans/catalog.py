"""Every registered query: an operator applied to whole tables of ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import exact
from tidemark.functions.patterns import END, POTENTIAL_TERM, START, segments
from tidemark.operators import discovery, extras, ingest, marts, quality, serve, shape, sketches, stage, text
from tidemark.plans import build, objects
from tidemark.session import saved, scratch_dir
from tidemark.sources import landing, mapping
from tidemark.streaming import discoveries as stream_discovery
from tidemark.streaming import ingest as streams
from tidemark.streaming import progress as stream_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Of a quantile's rank, by ``sketches.QUANTILE_K``.
QUANTILE_ERROR = 0.0133


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- dimensions of mapping A ------------------------------------------------------------------


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = mapping.table(spark, sf_dir, "region")
    return (
        mapping.table(spark, sf_dir, "nation")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_name").alias("country_code"),
            F.concat("n_name", F.lit(" ("), "r_name", F.lit(")")).alias("country_name"),
            F.lit(True).alias("is_active"),
        )
    )


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        mapping.table(spark, sf_dir, "customer")
        .groupBy(F.col("c_mktsegment").alias("role_name"))
        .agg(F.when(F.min("c_acctbal") < 0, "mixed").otherwise("solvent").alias("role_category"))
        .select(
            "role_name",
            "role_category",
            (F.col("role_name") != "FURNITURE").alias("is_active"),
        )
    )


def joined_list(df: DataFrame, column: str) -> DataFrame:
    """Show an array column as text, its values joined by '|'."""
    return df.withColumn(column, F.array_join(column, "|"))


# --- marts ------------------------------------------------------------------------------------


@query
def enriched(spark, sf_dir):
    money = {c: F.col(c).cast("double") for c in ("salary_min", "salary_max", "salary_midpoint")}
    return mapping.postings(spark, sf_dir).withColumns(money)


@query
def enriched_view(spark, sf_dir):
    """Pay of paid jobs per currency, by SQL over the registered view and functions."""
    tables = mapping.job_skills(spark, sf_dir), mapping.skills(spark, sf_dir), mapping.jobs(spark, sf_dir)
    objects.register_view(spark, *tables, name="enriched_postings")
    objects.register_functions(spark)
    return spark.sql(
        """SELECT search_role, country_code, currency_by_region(lower(substr(country_code, 1, 2))) AS currency, count(*) AS tags,
          CAST(sum(value_midpoint(salary_min, salary_max)) AS DOUBLE) AS midpoints
        FROM enriched_postings WHERE skill_category IS NOT NULL GROUP BY search_role, country_code"""
    )


@query
def jobs_estimated(spark, sf_dir):
    """Jobs per role and per country from one table of sketches, held against the exact counts."""
    enr = mapping.postings(spark, sf_dir)
    stored = saved(sketches.segment_sketches(enr, ["search_role", "country_code"], count="job_id"), "sketches")
    out = None
    for level in ("search_role", "country_code"):
        guess = sketches.distinct_estimates(stored, [level])
        exact_count = enr.select(level, "job_id").distinct().groupBy(level).agg(F.count(F.lit(1)).alias("jobs"))
        close = F.abs(F.col("estimate") - F.col("jobs")) <= sketches.distinct_error() * F.col("jobs")
        one = guess.join(exact_count, level).select(F.lit(level).alias("level"), F.col(level).alias("member"), "jobs", close.alias("within_error"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def pay_quantiles(spark, sf_dir):
    """Quartiles of pay per role from sketches per role and country; whether their exact ranks are within the error."""
    jobs = mapping.jobs(spark, sf_dir)
    paid = jobs.withColumn("value", exact.half_cents(exact.value_midpoint(F.col("salary_min"), F.col("salary_max"))))
    stored = saved(sketches.segment_sketches(paid, ["search_role", "country_code"], measure="value"), "sketches")
    wanted = (0.25, 0.5, 0.75)
    guess = sketches.quantile_estimates(stored, ["search_role"], wanted)
    ranks = [F.count_if(F.col("value") <= F.get("quantiles", k)).alias(f"r{k}") for k in range(len(wanted))]
    held = paid.filter(F.col("value").isNotNull()).join(guess, "search_role").groupBy("search_role").agg(F.count(F.lit(1)).alias("jobs"), *ranks)
    close = F.lit(True)
    for k, q in enumerate(wanted):
        close = close & (F.abs(F.col(f"r{k}") / F.col("jobs") - q) <= 2 * QUANTILE_ERROR)
    return held.select("search_role", "jobs", close.alias("within_error"))


@query
def skill_demand(spark, sf_dir):
    return marts.skill_demand(mapping.postings(spark, sf_dir), top_n=10)


@query
def skill_cooccurrence(spark, sf_dir):
    return marts.skill_cooccurrence(mapping.postings(spark, sf_dir), min_count=60)


@query
def salary_by_skill(spark, sf_dir):
    return marts.salary_by_skill(mapping.postings(spark, sf_dir))


@query
def company_leaderboard(spark, sf_dir):
    return joined_list(marts.company_leaderboard(mapping.jobs(spark, sf_dir), top_n=10), "roles_hiring")


def _similarity(spark, sf_dir):
    return marts.role_similarity(mapping.part_name_postings(spark, sf_dir), min_jobs=40)


@query
def role_similarity(spark, sf_dir):
    return joined_list(_similarity(spark, sf_dir), "top_shared_skills")


@query
def skills_by_country(spark, sf_dir):
    return marts.skills_by_country(mapping.postings(spark, sf_dir), min_jobs=15)


# --- serving ----------------------------------------------------------------------------------


def _demand(spark, sf_dir):
    return marts.skill_demand(mapping.postings(spark, sf_dir))


def _demand_uncut(spark, sf_dir):
    return marts.skill_demand(mapping.postings(spark, sf_dir), top_n=None)


def _pairs(spark, sf_dir):
    return marts.skill_cooccurrence(mapping.postings(spark, sf_dir))


def _pay(spark, sf_dir):
    return marts.salary_by_skill(mapping.postings(spark, sf_dir))


def _companies(spark, sf_dir):
    return marts.company_leaderboard(mapping.jobs(spark, sf_dir))


def _companies_uncut(spark, sf_dir):
    return marts.company_segments(mapping.jobs(spark, sf_dir))


@query
def demand_top(spark, sf_dir):
    return serve.demand_top(_demand(spark, sf_dir), role="BUILDING", country="NATION_6")


@query
def demand_top_global(spark, sf_dir):
    return serve.demand_top_global(_demand_uncut(spark, sf_dir), role="BUILDING")


@query
def demand_all(spark, sf_dir):
    return serve.demand_all(_demand(spark, sf_dir))


@query
def cooccurrence_top(spark, sf_dir):
    return serve.cooccurrence_top(_pairs(spark, sf_dir), role="MACHINERY")


@query
def cooccurrence_for_skill(spark, sf_dir):
    return serve.cooccurrence_for_skill(_pairs(spark, sf_dir), role="MACHINERY", skill="Brand#7")


@query
def skill_network_edges(spark, sf_dir):
    return serve.skill_network_edges(_pairs(spark, sf_dir), role="MACHINERY")


@query
def skill_network_nodes(spark, sf_dir):
    return serve.skill_network_nodes(skill_network_edges(spark, sf_dir))


@query
def skill_by_country(spark, sf_dir):
    mart = marts.skills_by_country(mapping.postings(spark, sf_dir))
    return serve.skill_by_country(mart, countries(spark, sf_dir), skill="Brand#7", role="MACHINERY")


@query
def salary_skills(spark, sf_dir):
    return serve.salary_skills(_pay(spark, sf_dir), role="BUILDING", country="NATION_6")


@query
def salary_skills_global(spark, sf_dir):
    return serve.salary_skills_global(_pay(spark, sf_dir), role="BUILDING")


@query
def top_paying_skills(spark, sf_dir):
    return serve.top_paying_skills(_pay(spark, sf_dir), role="BUILDING")


@query
def premium_skills(spark, sf_dir):
    return serve.premium_skills(_pay(spark, sf_dir), role="BUILDING", country="NATION_6")


@query
def salary_range(spark, sf_dir):
    return serve.salary_range(_pay(spark, sf_dir), role="BUILDING")


@query
def skill_categories(spark, sf_dir):
    return serve.skill_categories(mapping.skills(spark, sf_dir))


@query
def skills_list(spark, sf_dir):
    return serve.skills_list(mapping.skills(spark, sf_dir), category="cat2")


@query
def leaderboard_top(spark, sf_dir):
    return serve.leaderboard_top(_companies(spark, sf_dir), role="BUILDING", country="NATION_6")


@query
def leaderboard_global(spark, sf_dir):
    return serve.leaderboard_global(_companies_uncut(spark, sf_dir), role="BUILDING")


@query
def contract_mix(spark, sf_dir):
    return serve.contract_mix(_companies_uncut(spark, sf_dir), role="BUILDING")


@query
def company_search(spark, sf_dir):
    return serve.company_search(_companies_uncut(spark, sf_dir), query="R#0000001")


@query
def role_pairs(spark, sf_dir):
    return joined_list(serve.role_pairs(_similarity(spark, sf_dir)), "top_shared_skills")


@query
def role_transitions(spark, sf_dir):
    return joined_list(serve.role_transitions(_similarity(spark, sf_dir), role="NATION_6"), "shared_skill_list")


@query
def similarity_matrix(spark, sf_dir):
    """Every role by every role."""
    return serve.similarity_matrix(_similarity(spark, sf_dir), roles=[f"NATION_{i}" for i in range(25)])


@query
def similarity_cells(spark, sf_dir):
    return serve.similarity_matrix(_similarity(spark, sf_dir), long=True)


@query
def skill_gap(spark, sf_dir):
    enr = mapping.part_name_postings(spark, sf_dir)
    demand = enr.groupBy("search_role", "skill_name", F.lit("names").alias("skill_category")).agg(
        F.count(F.lit(1)).alias("job_count")
    )
    known = marts.role_skills(enr, min_jobs=40)
    return serve.skill_gap(demand, known, _similarity(spark, sf_dir), from_role="NATION_9", to_role="NATION_6")


@query
def summary_stats(spark, sf_dir):
    return serve.summary_stats(mapping.jobs(spark, sf_dir), mapping.job_skills(spark, sf_dir))


@query
def filter_options(spark, sf_dir):
    return serve.filter_options(
        mapping.jobs(spark, sf_dir), mapping.skills(spark, sf_dir), countries(spark, sf_dir)
    )


@query
def countries_with_data(spark, sf_dir):
    return serve.countries_with_data(mapping.jobs(spark, sf_dir), countries(spark, sf_dir))


@query
def active_roles(spark, sf_dir):
    return serve.active_roles(roles(spark, sf_dir))


# --- shaping ----------------------------------------------------------------------------------

SEGMENT_TIES = ("skill_name", "search_role", "country_code")


@query
def category_share(spark, sf_dir):
    return shape.category_share(_demand_uncut(spark, sf_dir))


@query
def top_n_by(spark, sf_dir):
    top = shape.top_n_by(_pay(spark, sf_dir), measure="salary_premium_percentage", ties=SEGMENT_TIES)
    return top.select(*SEGMENT_TIES, "salary_premium_percentage")


@query
def contract_share(spark, sf_dir):
    return shape.contract_share(contract_mix(spark, sf_dir))


@query
def headline(spark, sf_dir):
    first = shape.headline(_pay(spark, sf_dir), measure="avg_salary_with_skill", ties=SEGMENT_TIES)
    return first.select(*SEGMENT_TIES, "avg_salary_with_skill")


# --- ingest -----------------------------------------------------------------------------------

AS_OF = date(2024, 1, 1)
AS_OF_TIME = datetime(2024, 1, 1, 12)


def _event_rows(spark, sf_dir):
    """Events as landed rows: a user is found under an event type, often more than once."""
    return mapping.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_platform_id"),
        F.col("event_type").alias("country_code"),
        F.col("event_id").alias("search_role"),
        F.col("ts").alias("extracted_at"),
        F.concat(F.lit("batch-"), "event_type").alias("extraction_batch_id"),
        "value",
    )


def _fresh_events(spark, sf_dir):
    rows = _event_rows(spark, sf_dir)
    landed = rows.filter(F.col("value") > 95).select("job_platform_id", "country_code").distinct()
    return ingest.dedup_first_wins(rows, landed)


def _landing_folder(spark, sf_dir):
    """Mapping A written as result pages in a new shared folder."""
    folder = scratch_dir(spark, "landing")
    mapping.write_pages(mapping.jobs(spark, sf_dir), folder)
    return folder


def _landed(spark, sf_dir):
    return landing.land_postings(spark, _landing_folder(spark, sf_dir), batch_id="batch-1", as_of=AS_OF_TIME)


@query
def land_postings(spark, sf_dir):
    title = F.get_json_object("raw_data", "$.title").alias("title")
    return _landed(spark, sf_dir).select("job_platform_id", "search_role", "country_code", "extraction_batch_id", title)


@query
def dedup_first_wins(spark, sf_dir):
    return _fresh_events(spark, sf_dir)


@query
def active_grid(spark, sf_dir):
    """Postings in every cell of the role and country grid."""
    grid = ingest.active_grid(roles(spark, sf_dir), countries(spark, sf_dir))
    counted = mapping.jobs(spark, sf_dir).groupBy("search_role", "country_code").agg(F.count(F.lit(1)).alias("n"))
    cells = grid.join(counted, ["search_role", "country_code"], "left")
    return cells.withColumn("postings", F.coalesce("n", F.lit(0).cast("bigint"))).drop("n")


@query
def in_grid(spark, sf_dir):
    grid = ingest.active_grid(roles(spark, sf_dir), countries(spark, sf_dir), role="BUILDING", country="NATION_6")
    return ingest.in_grid(mapping.jobs(spark, sf_dir), grid).select("job_id", "search_role", "country_code")


@query
def recent_postings(spark, sf_dir):
    recent = ingest.recent_postings(mapping.jobs(spark, sf_dir), as_of=date(1998, 8, 2), months=6)
    return recent.select("job_id", "search_role", "country_code", "job_posted_at")


@query
def recent_postings_stored(spark, sf_dir):
    """The same from a table stored by posted date, of which only recent folders are read."""
    jobs, path = mapping.jobs(spark, sf_dir), scratch_dir(spark, "by-date")
    ingest.save_by_date(jobs, path)
    recent = ingest.recent_postings(ingest.read_by_date(spark, path, jobs.schema), as_of=date(1998, 8, 2), months=6)
    return recent.select("job_id", "search_role", "country_code", "job_posted_at")


@query
def batch_stats(spark, sf_dir):
    return ingest.batch_stats(_event_rows(spark, sf_dir), _fresh_events(spark, sf_dir))


def _brand_taxonomy(spark, sf_dir):
    """Brands as taxonomy entries, with the names of their parts as aliases."""
    number = F.substring("p_brand", 7, 10).cast("int")
    return (
        mapping.table(spark, sf_dir, "part")
        .groupBy("p_brand")
        .agg(F.collect_set("p_name").alias("aliases"))
        .select(
            F.col("p_brand").alias("name"),
            F.when(number % 5 != 0, F.concat(F.lit("group "), (number % 5).cast("string"))).alias("category"),
            F.when(number % 3 != 0, F.lit("kind")).alias("subcategory"),
            F.when(number % 4 != 0, F.col("aliases")).alias("aliases"),
        )
    )


@query
def taxonomy_terms(spark, sf_dir):
    return text.taxonomy_terms(_brand_taxonomy(spark, sf_dir))


@query
def seed_dims(spark, sf_dir):
    known = countries(spark, sf_dir).filter(F.col("country_name").contains("AFRICA"))
    seeds = countries(spark, sf_dir).withColumn("country_name", F.concat(F.lit("seed "), "country_name"))
    return ingest.seed_dims(known, seeds, key="country_code")


@query
def unprocessed(spark, sf_dir):
    raw = mapping.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("extracted_at")
    )
    staged = mapping.table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    return ingest.unprocessed(raw, staged.select(F.col("l_orderkey").alias("raw_job_id")))


# --- staging ----------------------------------------------------------------------------------

STAGED = [
    "job_platform_id",
    "search_role",
    "country_code",
    "title",
    "company_name",
    "description",
    "location_display",
    "location_areas",
    "category_tag",
    "category_label",
    "salary_min",
    "salary_max",
    "salary_is_predicted",
    "salary_currency",
    "contract_type",
    "contract_time",
    "redirect_url",
    "job_posted_at",
]


def _shown(jobs):
    money = {c: F.col(c).cast("double") for c in ("salary_min", "salary_max")}
    return joined_list(jobs.select(*STAGED), "location_areas").withColumns(money)


@query
def flatten_posting(spark, sf_dir):
    raw = ingest.dedup_first_wins(_landed(spark, sf_dir), None)
    return _shown(stage.flatten_posting(raw)[0])


@query
def posting_quarantine(spark, sf_dir):
    """Pages as payloads: the HTML ones are no JSON objects, those in an envelope are."""
    body = F.when(F.col("page_id") % 3 == 0, F.to_json(F.struct(F.col("page_id").alias("id")))).otherwise(F.col("html"))
    raw = mapping.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"),
        F.col("url").alias("job_platform_id"),
        F.lit("page").alias("search_role"),
        F.lit("us").alias("country_code"),
        body.alias("raw_data"),
        F.lit(AS_OF_TIME).cast("timestamp_ntz").alias("extracted_at"),
    )
    return stage.flatten_posting(raw)[1].select("id", "job_platform_id", "parse_error")


@query
def currency_by_region(spark, sf_dir):
    docs = mapping.documents(spark, sf_dir).select("job_id", "country_code")
    return stage.currency_by_region(docs)


@query
def value_midpoint(spark, sf_dir):
    middle = exact.value_midpoint(F.col("salary_min"), F.col("salary_max")).cast("double")
    return mapping.jobs(spark, sf_dir).select("job_id", middle.alias("salary_midpoint"))


@query
def region_names(spark, sf_dir):
    asked = mapping.documents(spark, sf_dir).groupBy("country_code").agg(F.count(F.lit(1)).alias("postings"))
    return serve.region_names(asked, schemas.countries(spark))


def _stage_rows(spark, sf_dir):
    jobs = mapping.jobs(spark, sf_dir).select(
        "job_platform_id",
        "country_code",
        "search_role",
        "title",
        F.col("job_posted_at").alias("extracted_at"),
        F.col("job_posted_at").alias("processed_at"),
    )
    old = jobs.filter(F.col("extracted_at") < F.lit("1997-01-01").cast("timestamp_ntz"))
    new = jobs.filter(F.col("extracted_at") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    new = new.withColumns({"title": F.concat("title", F.lit(" again")), "processed_at": F.lit(AS_OF_TIME).cast("timestamp_ntz")})
    return old, new


@query
def upsert_stage(spark, sf_dir):
    return stage.upsert_stage(*_stage_rows(spark, sf_dir), as_of=AS_OF_TIME)


def _upserted(spark, old, batches, merge, keys):
    """A table of 16 buckets after the batches, one after the other."""
    path = scratch_dir(spark, "buckets")
    stage.write_buckets(old, path, keys=keys, buckets=16)
    for new in batches:
        stage.upsert_into(path, new, merge, keys=keys, buckets=16)
    return stage.read_buckets(spark, path, old.schema).drop("bucket")


@query
def upsert_stage_table(spark, sf_dir):
    """The same on a stored table, in two batches."""
    old, new = _stage_rows(spark, sf_dir)
    early = F.col("extracted_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    merge = lambda have, add: stage.upsert_stage(have, add, as_of=AS_OF_TIME)
    return _upserted(spark, old, [new.filter(early), new.filter(~early)], merge, ingest.NATURAL_KEY)


def _line_tags(spark, sf_dir, lines, stamp):
    part = mapping.table(spark, sf_dir, "part").select(
        "p_partkey", F.substring("p_brand", 7, 10).cast("bigint").alias("skill_id"), F.col("p_brand").alias("skill_name")
    )
    return (
        mapping.table(spark, sf_dir, "lineitem")
        .filter(lines)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("job_id"), "skill_id", "skill_name")
        .agg(F.sum("l_linenumber").alias("mention_count"), F.lit(stamp).cast("timestamp_ntz").alias("extracted_at"))
    )


def _tag_rows(spark, sf_dir):
    old = _line_tags(spark, sf_dir, F.col("l_linenumber") <= 3, datetime(2023, 1, 1))
    return old, _line_tags(spark, sf_dir, F.col("l_linenumber") >= 3, datetime(2024, 1, 1))


@query
def upsert_tags(spark, sf_dir):
    return stage.upsert_tags(*_tag_rows(spark, sf_dir))


@query
def upsert_tags_table(spark, sf_dir):
    """The same on a stored table, in two batches of jobs."""
    old, new = _tag_rows(spark, sf_dir)
    even = F.col("job_id") % 2 == 0
    return _upserted(spark, old, [new.filter(even), new.filter(~even)], stage.upsert_tags, ("job_id", "skill_id"))


@query
def snapshot_demand(spark, sf_dir):
    return stage.snapshot_demand(_demand_uncut(spark, sf_dir), as_of=AS_OF)


def _found_tags(spark, sf_dir):
    part = mapping.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    found = (
        mapping.table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("job_id"), F.col("p_brand").alias("skill_name"))
        .agg(F.min("p_type").alias("category"), F.count(F.lit(1)).alias("mention_count"))
        .withColumn("subcategory", F.lit(""))
    )
    known = mapping.skills(spark, sf_dir).filter(F.col("skill_id") <= 15)
    return stage.assign_tag_ids(found, known)


@query
def assign_tag_ids(spark, sf_dir):
    """Facts with their ids, where a new id shows as 0."""
    facts, _ = _found_tags(spark, sf_dir)
    old = F.when(F.col("skill_id") == F.xxhash64("skill_name"), F.lit(0).cast("bigint")).otherwise(F.col("skill_id"))
    return facts.select("job_id", "skill_name", "category", "mention_count", old.alias("skill_id"))


@query
def assign_tag_ids_dim(spark, sf_dir):
    _, dim = _found_tags(spark, sf_dir)
    old = F.when(F.col("skill_id") == F.xxhash64("skill_name"), F.lit(0).cast("bigint")).otherwise(F.col("skill_id"))
    return dim.withColumn("skill_id", old)


@query
def rebuild(spark, sf_dir):
    """Skills of all postings staged anew, by the posting's platform id."""
    raw, work = mapping.document_postings(spark, sf_dir), scratch_dir(spark, "rebuild")
    tables = stage.rebuild(raw, mapping.taxonomy(spark), as_of=AS_OF_TIME, work=work)
    ids = tables["stg_jobs"].select("job_id", F.col("job_platform_id").cast("bigint").alias("posting"))
    skills = tables["stg_job_skills"].filter("verified").join(ids, "job_id")
    return skills.select(F.col("posting").alias("job_id"), "skill_name", "mention_count", "extraction_method")


@query
def rebuild_tables(spark, sf_dir):
    """All five tables staged anew, by their keys; every fortieth document has an older payload that is no object."""
    raw, work = mapping.document_postings(spark, sf_dir), scratch_dir(spark, "rebuild")
    broken = raw.filter(F.col("job_platform_id").cast("bigint") % 40 == 7).withColumn("raw_data", F.lit("[]"))
    tables = stage.rebuild(raw.unionByName(broken), mapping.taxonomy(spark), as_of=AS_OF_TIME, work=work, mode="discover_all")
    jobs = tables["stg_jobs"]
    ids = jobs.select("job_id", "job_platform_id")
    line = lambda *columns: F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    shown = {
        "stg_jobs": jobs.select(F.col("job_platform_id").alias("key"), F.col("country_code").alias("value")),
        "stg_job_skills": tables["stg_job_skills"].join(ids, "job_id").select(
            line("job_platform_id", "skill_name").alias("key"), line("mention_count", "verified", "extraction_method").alias("value")
        ),
        "dim_skills": tables["dim_skills"].select(
            F.col("skill_name").alias("key"), line("skill_category", "skill_subcategory").alias("value")
        ),
        "discoveries": tables["discoveries"].select(
            F.col("skill_key").alias("key"), line("name", "occurrence_count", "first_seen").alias("value")
        ),
        "quarantine": tables["quarantine"].select(F.col("job_platform_id").alias("key"), F.col("parse_error").alias("value")),
    }
    out = None
    for name, rows in shown.items():
        one = rows.select(F.lit(name).alias("table_name"), "key", "value")
        out = one if out is None else out.unionByName(one)
    return out


@query
def layer_counts(spark, sf_dir):
    return stage.layer_counts(
        {
            "raw.jobs": mapping.table(spark, sf_dir, "orders"),
            "staging.stg_jobs": mapping.jobs(spark, sf_dir),
            "staging.stg_job_skills": mapping.job_skills(spark, sf_dir),
            "staging.dim_skills": mapping.skills(spark, sf_dir),
            "staging.dim_job_roles": roles(spark, sf_dir),
            "staging.dim_countries": countries(spark, sf_dir),
        }
    )


@query
def progress(spark, sf_dir):
    raw, staged = mapping.table(spark, sf_dir, "customer"), mapping.table(spark, sf_dir, "orders")
    served = staged.select("o_custkey").distinct()
    return stage.progress(raw, served, mapping.job_skills(spark, sf_dir))


# --- text -------------------------------------------------------------------------------------


def _terms(spark):
    return text.taxonomy_terms(mapping.taxonomy(spark))


def _found(spark, sf_dir):
    return text.extract_terms(mapping.documents(spark, sf_dir), _terms(spark))


@query
def compile_terms(spark, sf_dir):
    terms = text.taxonomy_terms(_brand_taxonomy(spark, sf_dir))
    return text.compile_terms(terms).select("term", "canonical", "pattern", "kind", "anchor")


@query
def extract_terms(spark, sf_dir):
    return _found(spark, sf_dir)


@query
def extract_terms_basic(spark, sf_dir):
    return text.extract_terms(mapping.documents(spark, sf_dir), _terms(spark), special="basic")


@query
def extract_phrases(spark, sf_dir):
    """A taxonomy of thousands of phrases: every two and three neighbouring words of the benchmark."""
    parts = mapping.table(spark, sf_dir, "benchmark").select(segments(F.lower("text")).alias("parts"))
    some = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.rlike(F.get("parts", i - 1), F.lit("^[\\p{L}\\p{N}_]")))
    phrases = F.transform(some, lambda i: F.array(*[F.array_join(F.slice("parts", i, F.lit(k)), "") for k in (3, 5)]))
    words = F.split(F.col("name"), r"[^\p{L}\p{N}_]+")
    once = F.size(F.array_distinct(words)) == F.size(words)  # no phrase can begin within itself
    names = parts.select(F.explode(F.flatten(phrases)).alias("name")).distinct().filter(F.rlike("name", F.lit("[\\p{L}\\p{N}_]$")) & once)
    taxonomy = names.select(
        "name", F.lit("phrase").alias("category"), F.lit("").alias("subcategory"), F.array().cast("array<string>").alias("aliases")
    )
    return text.extract_terms(mapping.documents(spark, sf_dir), text.taxonomy_terms(taxonomy))


@query
def term_coverage(spark, sf_dir):
    coverage = text.term_coverage(mapping.documents(spark, sf_dir), _found(spark, sf_dir))
    return joined_list(coverage, "unmatched_potential_terms")


def _routed(spark, sf_dir):
    return text.route_docs(mapping.documents(spark, sf_dir), _found(spark, sf_dir))


@query
def route_docs(spark, sf_dir):
    return _routed(spark, sf_dir)


@query
def candidate_terms(spark, sf_dir):
    return text.candidate_terms(mapping.documents(spark, sf_dir))


def _technical_words():
    """A finder as a model would be: made once per worker, asked with lists of texts."""
    import regex

    looks = regex.compile(f"{START}{POTENTIAL_TERM}{END}")
    return lambda texts: [[{"text": t, "label": "other", "score": 0.8} for t in looks.findall(text)] for text in texts]


@query
def candidate_terms_finder(spark, sf_dir):
    """Candidates by a finder of the user's own, which looks for what the built-in one does."""
    return text.candidate_terms(mapping.documents(spark, sf_dir), _technical_words)


def _graded(spark, sf_dir):
    """Candidates with labels and scores that vary with their length."""
    size = F.length("text")
    label = F.when(size % 3 == 0, "database").when(size % 3 == 1, "etl tool").otherwise("other")
    cands = text.candidate_terms(mapping.documents(spark, sf_dir))
    return cands.withColumns({"label": label, "score": F.least(F.lit(10), size) / F.lit(10.0)})


@query
def clean_candidates(spark, sf_dir):
    return text.clean_candidates(_graded(spark, sf_dir))


def _verified(spark, sf_dir):
    cleaned = text.clean_candidates(text.candidate_terms(mapping.documents(spark, sf_dir)))
    return text.verify_candidates(cleaned, _terms(spark))


@query
def verify_candidates(spark, sf_dir):
    return _verified(spark, sf_dir)


@query
def merge_terms(spark, sf_dir):
    return text.merge_terms(_found(spark, sf_dir), _verified(spark, sf_dir))[0]


@query
def merge_terms_new(spark, sf_dir):
    return text.merge_terms(_found(spark, sf_dir), _verified(spark, sf_dir))[1]


def _hybrid(spark, sf_dir):
    return text.hybrid_extract(mapping.documents(spark, sf_dir), _terms(spark))


@query
def hybrid_extract(spark, sf_dir):
    return _hybrid(spark, sf_dir)[0]


@query
def hybrid_extract_new(spark, sf_dir):
    return _hybrid(spark, sf_dir)[1]


@query
def extraction_stats(spark, sf_dir):
    docs, terms = mapping.documents(spark, sf_dir), _terms(spark)
    found = saved(text.extract_terms(docs, terms), "found")
    return text.extraction_stats(text.route_docs(docs, found), text.hybrid_extract(docs, terms, found=found)[0])


# --- discovery --------------------------------------------------------------------------------


def _discoveries(spark, sf_dir):
    docs = mapping.documents(spark, sf_dir).select("job_id", "context", "seen_at")
    return discovery.discoveries(saved(_hybrid(spark, sf_dir)[1].join(docs, "job_id"), "seen"))


@query
def discoveries(spark, sf_dir):
    return joined_list(_discoveries(spark, sf_dir), "sample_contexts")


@query
def promotion_candidates(spark, sf_dir):
    return joined_list(discovery.promotion_candidates(_discoveries(spark, sf_dir)), "sample_contexts")


def _promoted(spark, sf_dir):
    fit = discovery.promotion_candidates(_discoveries(spark, sf_dir))
    return discovery.promote_terms(mapping.taxonomy(spark), mapping.skills(spark, sf_dir), fit)


@query
def promote_terms(spark, sf_dir):
    return joined_list(_promoted(spark, sf_dir)[0], "aliases")


@query
def promote_terms_dim(spark, sf_dir):
    return _promoted(spark, sf_dir)[1].select("skill_name", "skill_category", "skill_subcategory")


@query
def discovery_stats(spark, sf_dir):
    stats = discovery.discovery_stats(saved(_discoveries(spark, sf_dir), "discoveries"))
    line = F.transform("top_pending", lambda e: F.concat_ws(":", e["name"], e["category"], e["occurrences"].cast("string")))
    return stats.withColumn("top_pending", F.array_join(line, "|"))


# --- incremental ------------------------------------------------------------------------------


@query
def stream_ingest(spark, sf_dir):
    """All pages landed and staged through the stream, as the staged table it leaves."""
    out = scratch_dir(spark, "stream-ingest")
    run = streams.stream_ingest(spark, _landing_folder(spark, sf_dir), out, f"{out}/checkpoint", max_files=60)
    run.awaitTermination()
    return _shown(spark.read.parquet(f"{out}/stg_jobs"))


@query
def stream_progress(spark, sf_dir):
    """What the ingesting stream reports of its batches, added up."""
    out = scratch_dir(spark, "stream-progress")
    listener = stream_log.ProgressTable(spark, f"{out}/progress")
    spark.streams.addListener(listener)
    try:
        folder = _landing_folder(spark, sf_dir)
        listener.wait(streams.stream_ingest(spark, folder, out, f"{out}/checkpoint", max_files=60))
    finally:
        spark.streams.removeListener(listener)
    totals = stream_log.run_totals(stream_log.batch_progress(spark, f"{out}/progress"))
    return totals.select("total_fetched", "total_inserted", "duplicates_skipped", "known_keys")


#: Documents of a staged file.
STAGED_ROWS = 10_000


def _discovered(spark, sf_dir, *, batches, **options):
    """Documents staged in files of about ``STAGED_ROWS`` and taken by the stream in ``batches``: its output folder and its checkpoint."""
    out = scratch_dir(spark, "stream-discoveries")
    each = max(1, -(-mapping.table(spark, sf_dir, "documents").count() // (3 * STAGED_ROWS)))
    jobs = stage.flatten_posting(mapping.document_postings(spark, sf_dir))[0]
    jobs.withColumn("processed_at", F.col("extracted_at")).repartition(3 * each, "job_id").write.parquet(f"{out}/staged")
    run = stream_discovery.stream_discoveries(
        spark,
        f"{out}/staged",
        out,
        f"{out}/check",
        taxonomy=mapping.taxonomy(spark),
        mode="discover_all",
        max_files=3 * each // batches,
        **options,
    )
    run.awaitTermination()
    return out, f"{out}/check"


@query
def stream_discoveries(spark, sf_dir):
    """Discoveries the stream leaves after all documents, a third of the files a batch, none promoted in between."""
    totals = stream_discovery.stream_totals(spark, *_discovered(spark, sf_dir, batches=3, min_count=10**9))
    return joined_list(totals, "sample_contexts")


@query
def stream_promotions(spark, sf_dir):
    """What one batch of all documents promotes."""
    totals = stream_discovery.stream_totals(spark, *_discovered(spark, sf_dir, batches=1))
    return totals.select("skill_key", "category", "occurrence_count", "is_promoted")


@query
def stream_job_skills(spark, sf_dir):
    """Facts the stream leaves, a third of the files a batch, with their skills' entries, by the posting's platform id."""
    out, _ = _discovered(spark, sf_dir, batches=3, min_count=10**9)
    facts, dim = (spark.read.parquet(f"{out}/{t}") for t in ("stg_job_skills", "dim_skills"))
    ids = spark.read.parquet(f"{out}/staged").select("job_id", F.col("job_platform_id").cast("bigint").alias("posting"))
    entries = dim.select("skill_id", F.col("skill_name").alias("entry"))
    return facts.join(entries, "skill_id").join(ids, "job_id").select(
        F.col("posting").alias("job_id"), "skill_name", "entry", "mention_count", "verified", "extraction_method"
    )


# --- quality ----------------------------------------------------------------------------------


@query
def dq_not_null(spark, sf_dir):
    return quality.dq_not_null(mapping.postings(spark, sf_dir), columns=["job_id", "salary_min", "salary_max"])


@query
def dq_unique(spark, sf_dir):
    return quality.dq_unique(mapping.table(spark, sf_dir, "lineitem"), keys=["l_suppkey", "l_partkey"])


@query
def dq_relationships(spark, sf_dir):
    """Documents that have no label."""
    docs = mapping.table(spark, sf_dir, "documents").select("doc_id", "source")
    return quality.dq_relationships(docs, mapping.table(spark, sf_dir, "labels"), key="doc_id")


@query
def dq_mart_keys(spark, sf_dir):
    enr = build.save_enriched(mapping.postings(spark, sf_dir), scratch_dir(spark, "marts"))
    frames = build.mart_frames(enr, mapping.jobs(spark, sf_dir))
    return quality.dq_mart_keys(frames)


# --- extras -----------------------------------------------------------------------------------


@query
def skill_trend(spark, sf_dir):
    """Demand over the postings known at the start of three years, and how it moved."""
    enr = mapping.postings(spark, sf_dir)
    history = None
    for year in (1996, 1998, 2000):
        known = enr.filter(F.col("job_posted_at") < F.lit(f"{year}-01-01").cast("timestamp_ntz"))
        one = stage.snapshot_demand(marts.skill_demand(known, top_n=None), as_of=date(year, 1, 1))
        history = one if history is None else history.unionByName(one)
    return extras.skill_trend(history)


@query
def skill_demand_rollup(spark, sf_dir):
    return extras.skill_demand_rollup(mapping.postings(spark, sf_dir))


@query
def normalize_tags(spark, sf_dir):
    """Brands above 20 counted as spellings of the brand twenty below."""
    variants = mapping.skills(spark, sf_dir).filter(F.col("skill_id") > 20)
    aliases = variants.select(
        F.upper("skill_name").alias("alias"),
        F.concat(F.lit("Brand#"), (F.col("skill_id") - 20).cast("string")).alias("canonical"),
    )
    return extras.normalize_tags(mapping.postings(spark, sf_dir), aliases)


@query
def posting_match(spark, sf_dir):
    """Customers as candidates whose skills are the parts they bought."""
    orders = mapping.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("candidate_id"))
    enr = mapping.part_name_postings(spark, sf_dir)
    have = enr.join(orders, F.col("job_id") == F.col("o_orderkey")).select("candidate_id", "skill_name")
    have = mapping.dealt(have, mapping.table(spark, sf_dir, "lineitem"), "candidate_id")
    return extras.posting_match(have, marts.role_skills(enr, min_jobs=40), limit=3)
