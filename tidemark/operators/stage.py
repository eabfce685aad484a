"""From landed JSON to typed staging tables, and keeping those tables up."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions.exact import exact_ratio
from tidemark.operators import discovery, text
from tidemark.operators.ingest import NATURAL_KEY
from tidemark.session import saved

# --- cleaning ---------------------------------------------------------------------------------


def currency_by_region(df: DataFrame, *, default: str = schemas.DEFAULT_CURRENCY) -> DataFrame:
    """Add ``salary_currency`` by ``country_code``."""
    known = F.create_map(*[F.lit(x) for code, (_, cur) in schemas.COUNTRIES.items() for x in (code, cur)])
    return df.withColumn("salary_currency", F.coalesce(F.try_element_at(known, F.col("country_code")), F.lit(default)))


#: What is read of a posting. All is taken in one pass over it, as each lookup by path goes through its keys again.
POSTING = (
    "struct<title string, company variant, description string, location struct<display_name string, area array<string>>,"
    " category struct<tag string, label string>, salary_min decimal(18,2), salary_max decimal(18,2), salary_is_predicted variant,"
    " contract_type string, contract_time string, redirect_url string, created string>"
)


def _field(path: str) -> Column:
    return F.col(f"_read.{path}")


def _text(path: str) -> Column:
    return F.coalesce(_field(path), F.lit(""))


def _company() -> Column:
    """The company's name, whether it comes as an object, as plain text or not at all."""
    company = _field("company")
    is_object = F.schema_of_variant(company).startswith("OBJECT")
    name = F.when(is_object, F.try_variant_get(company, "$.display_name", "string")).otherwise(F.try_variant_get(company, "$", "string"))
    return F.coalesce(name, F.lit(""))


def _posted_at() -> Column:
    created = F.when(F.rlike(_field("created"), F.lit(r"^\d{4}-\d{2}-\d{2}")), _field("created"))
    return F.try_to_timestamp(created).cast("timestamp_ntz")


def flatten_posting(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed postings, and the raw rows whose payload is not a JSON object.

    Missing text is ''; a malformed date is NULL; the session's time zone should be UTC.
    """
    parsed = raw.withColumn("_posting", F.try_parse_json("raw_data"))
    fine = F.col("_posting").isNotNull() & F.ltrim("raw_data").startswith("{")
    bad = parsed.filter(~fine).drop("_posting").withColumn("parse_error", F.lit("payload is not a JSON object"))
    predicted = _field("salary_is_predicted")
    is_text = F.schema_of_variant(predicted) == "STRING"
    read = parsed.filter(fine).withColumn("_read", F.try_variant_get("_posting", "$", POSTING)).drop("_posting")
    good = read.select(
        F.xxhash64(*NATURAL_KEY).alias("job_id"),
        "job_platform_id",
        "search_role",
        "country_code",
        _text("title").alias("title"),
        _company().alias("company_name"),
        _text("description").alias("description"),
        _text("location.display_name").alias("location_display"),
        F.coalesce(_field("location.area"), F.array().cast("array<string>")).alias("location_areas"),
        _text("category.tag").alias("category_tag"),
        _text("category.label").alias("category_label"),
        _field("salary_min").alias("salary_min"),
        _field("salary_max").alias("salary_max"),
        F.coalesce(is_text & (F.try_variant_get(predicted, "$", "string") == "1"), F.lit(False)).alias("salary_is_predicted"),
        _text("contract_type").alias("contract_type"),
        _text("contract_time").alias("contract_time"),
        _text("redirect_url").alias("redirect_url"),
        _posted_at().alias("job_posted_at"),
        "extracted_at",
        F.col("id").alias("raw_job_id"),
    )
    return currency_by_region(good), bad


def posting_texts(jobs: DataFrame) -> DataFrame:
    """What is searched for skills, and the context remembered with a discovery."""
    return jobs.select(
        "job_id",
        F.concat_ws(" ", "title", "description").alias("text"),
        F.concat_ws(" @ ", "title", "company_name").alias("context"),
        F.col("extracted_at").alias("seen_at"),
    )


# --- upkeep -----------------------------------------------------------------------------------


def upsert_stage(target: DataFrame, new: DataFrame, *, as_of: datetime) -> DataFrame:
    """Add postings with a new key. A known key keeps its values; only ``processed_at`` moves."""
    nth = F.row_number().over(Window.partitionBy(*NATURAL_KEY).orderBy("extracted_at", "search_role"))
    first = new.withColumn("_n", nth).filter(F.col("_n") == 1).drop("_n")
    old, add = target.alias("t"), first.alias("n")
    same = [F.col(f"t.{k}") == F.col(f"n.{k}") for k in NATURAL_KEY]
    there = F.col("t.job_platform_id").isNotNull()
    again = F.col("n.job_platform_id").isNotNull()

    def pick(c: str) -> Column:
        if c == "processed_at":
            return F.when(again, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("t.processed_at")).alias(c)
        return F.when(there, F.col(f"t.{c}")).otherwise(F.col(f"n.{c}")).alias(c)

    return old.join(add, same, "full_outer").select(*[pick(c) for c in target.columns])


def upsert_tags(target: DataFrame, new: DataFrame) -> DataFrame:
    """Add (job, skill) rows; a known pair takes the newest ``mention_count`` and keeps the rest."""
    keys = ["job_id", "skill_id"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("extracted_at"), F.desc("mention_count")))
    last = new.withColumn("_n", nth).filter(F.col("_n") == 1).drop("_n")
    old, add = target.alias("t"), last.alias("n")
    same = [F.col(f"t.{k}") == F.col(f"n.{k}") for k in keys]
    there = F.col("t.job_id").isNotNull()

    def pick(c: str) -> Column:
        if c == "mention_count":
            return F.coalesce(f"n.{c}", f"t.{c}").alias(c)
        return F.when(there, F.col(f"t.{c}")).otherwise(F.col(f"n.{c}")).alias(c)

    return old.join(add, same, "full_outer").select(*[pick(c) for c in target.columns])


def _in_buckets(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def write_buckets(table: DataFrame, path: str, *, keys: Sequence[str], buckets: int) -> None:
    """A table in folders by a hash of its keys, as :func:`upsert_into` needs it."""
    spread = _in_buckets(table, keys, buckets).repartition("bucket")
    spread.write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    whole = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(whole).parquet(path)


def upsert_into(
    path: str, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], *, keys: Sequence[str], buckets: int
) -> list[int]:
    """Merge ``new`` rows into the table at ``path``, reading and writing only the buckets that they fall into.

    ``merge(old, new)`` is :func:`upsert_stage` or :func:`upsert_tags`; ``new`` has the table's columns, and
    ``buckets`` is what the table was written with. Both merges give the same again for the same rows, so a job that failed
    while it replaced buckets is mended by running it again. Returns the buckets replaced.
    """
    spark = new.sparkSession
    dealt = saved(_in_buckets(new, keys, buckets), "upsert")
    touched = sorted(r["bucket"] for r in dealt.select("bucket").distinct().collect())  # ``buckets`` at most
    old = read_buckets(spark, path, new.schema).filter(F.col("bucket").isin(touched)).drop("bucket")
    merged = _in_buckets(merge(old, dealt.drop("bucket")), keys, buckets).repartition("bucket")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def assign_tag_ids(found: DataFrame, dim: DataFrame, *, order: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """Found skills with ids, and the dimension grown by the names it lacked.

    A name is matched exactly. A new one takes the category of its first row by ``order`` and a hash
    of itself as id, so that no counter is shared; ``dq_unique(dim, keys=["skill_id"])`` guards the hash.
    """
    kinds = found.groupBy("skill_name", "category", "subcategory").agg(F.min(order).alias("_first"))
    earliest = F.min(F.struct("_first", "category", "subcategory"))
    new = (
        kinds.groupBy("skill_name")
        .agg(earliest.alias("k"))
        .join(dim.select("skill_name"), "skill_name", "left_anti")
        .select(
            F.xxhash64("skill_name").alias("skill_id"),
            "skill_name",
            F.col("k.category").alias("skill_category"),
            F.col("k.subcategory").alias("skill_subcategory"),
        )
    )
    grown = dim.unionByName(new, allowMissingColumns=True)
    # A new name's id is its hash, so facts only meet the known dimension.
    tagged = found.filter(F.col("skill_name").isNotNull()).join(dim.select("skill_name", "skill_id"), "skill_name", "left")
    return tagged.withColumn("skill_id", F.coalesce("skill_id", F.xxhash64("skill_name"))), grown


def snapshot_demand(demand: DataFrame, *, as_of: date) -> DataFrame:
    """A dated copy of the demand for the history; give it the uncut one (``skill_demand(top_n=None)``)."""
    return demand.select(
        F.lit(as_of).alias("snapshot_date"),
        "skill_id",
        "skill_name",
        "search_role",
        "country_code",
        "job_count",
        "demand_percentage",
        "avg_salary_min",
        "avg_salary_max",
    )


def write_snapshot(snapshot: DataFrame, history: str) -> None:
    """Append to the history; running a date again replaces that date."""
    writer = snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("snapshot_date").parquet(history)


def rebuild(
    raw: DataFrame, taxonomy: DataFrame, *, as_of: datetime, work: str | None = None, **options
) -> dict[str, DataFrame]:
    """Staging tables made anew from all raw rows.

    With ``work``, a shared folder, the typed postings and the skills found in them are written there first, so
    that both are worked out once for all tables.
    """
    jobs, bad = flatten_posting(raw)
    if work is not None:
        jobs.write.mode("overwrite").parquet(f"{work}/postings")
        jobs = raw.sparkSession.read.parquet(f"{work}/postings")
    docs = posting_texts(jobs)
    merged, new = text.hybrid_extract(docs, text.taxonomy_terms(taxonomy), **options)
    if work is not None:
        merged.write.mode("overwrite").parquet(f"{work}/skills")
        merged = raw.sparkSession.read.parquet(f"{work}/skills")
        new = text.new_discoveries(merged)
    spark = raw.sparkSession
    facts, dim = assign_tag_ids(merged, spark.createDataFrame([], schemas.DIM_SKILLS))
    seen = new.join(docs.select("job_id", "context", "seen_at"), "job_id")
    stamp = F.lit(as_of).cast("timestamp_ntz")
    return {
        "stg_jobs": jobs.withColumn("processed_at", stamp),
        "stg_job_skills": facts.select(
            "job_id", "skill_id", "skill_name", "mention_count", "verified", "extraction_method"
        ).withColumn("extracted_at", stamp),
        "dim_skills": dim,
        "discoveries": discovery.discoveries(seen),
        "quarantine": bad,
    }


def layer_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("count")) for name, df in tables.items()]
    result = counts[0]
    for one in counts[1:]:
        result = result.unionByName(one)
    return result


def progress(raw: DataFrame, staged: DataFrame, job_skills: DataFrame) -> DataFrame:
    """How far staging is: raw and processed rows, what remains, and skills found."""
    total, done = F.col("total_raw"), F.col("processed")
    counts = raw.agg(F.count(F.lit(1)).alias("total_raw")).withColumns(
        {
            "processed": staged.agg(F.count(F.lit(1))).scalar(),
            "total_skills": job_skills.agg(F.count(F.lit(1))).scalar(),
        }
    )
    return counts.withColumns(
        {"remaining": total - done, "progress_percent": exact_ratio(done, total, 1, percent=True)}
    )
