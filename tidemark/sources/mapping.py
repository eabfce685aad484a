"""The star-schema and document tables seen as postings.

Mapping A reads orders as postings, part brands as skills, market segments as roles and nations
as countries. Mapping B reads documents as postings whose text holds the skills.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.marts import enriched


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping A: one staged posting per order."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country_code"))
    customer = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "country_code", F.col("c_mktsegment").alias("search_role"), "c_name")
    )
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            key.alias("job_id"),
            key.cast("string").alias("job_platform_id"),
            "search_role",
            "country_code",
            F.concat(F.lit("Posting "), key.cast("string")).alias("title"),
            F.col("c_name").alias("company_name"),
            F.when(key % 5 != 0, (price * 0.8).cast("decimal(18,2)")).alias("salary_min"),
            F.when(key % 3 != 0, (price * 1.2).cast("decimal(18,2)")).alias("salary_max"),
            F.lit("USD").alias("salary_currency"),
            F.when(F.col("o_orderstatus") == "P", "permanent")
            .when(F.col("o_orderstatus") == "F", "contract")
            .otherwise("")
            .alias("contract_type"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "full_time")
            .when(F.col("o_orderpriority") == "5-LOW", "part_time")
            .otherwise("")
            .alias("contract_time"),
            F.col("o_orderdate").alias("job_posted_at"),
        )
    )


#: Rows of a task that groups lines: tasks grow in number, not in size.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, counted: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by keys to as many tasks as ``counted``, a stored table of as many rows, has parts of ``TASK_ROWS``."""
    return rows.repartition(max(8, -(-counted.count() // TASK_ROWS)), *keys)


def _lines(spark: SparkSession, sf_dir: str, part: DataFrame, *columns: str) -> DataFrame:
    """An order's lines with columns of their parts, by ``job_id``: all that follows by job needs no other shuffle."""
    lineitem = table(spark, sf_dir, "lineitem")
    lines = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("job_id"), *columns)
    return dealt(lines, lineitem, "job_id")


def _brand_id() -> Column:
    return F.substring("p_brand", 7, 10).cast("bigint")


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping A: brands as the skill dimension."""
    return (
        table(spark, sf_dir, "part")
        .select(_brand_id().alias("skill_id"), F.col("p_brand").alias("skill_name"))
        .distinct()
        .select(
            "skill_id",
            "skill_name",
            F.concat(F.lit("cat"), (F.col("skill_id") % 5).cast("string")).alias("skill_category"),
            F.lit("").alias("skill_subcategory"),
        )
    )


def job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping A: brands of an order's lines, one row per (order, brand) with the number of lines."""
    part = table(spark, sf_dir, "part").select("p_partkey", _brand_id().alias("skill_id"))
    return (
        _lines(spark, sf_dir, part, "skill_id")
        .groupBy("job_id", "skill_id")
        .agg(F.count(F.lit(1)).alias("mention_count"))
        .withColumn("skill_name", F.concat(F.lit("Brand#"), F.col("skill_id").cast("string")))
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping A: postings with their skills, the input of the marts."""
    return enriched(job_skills(spark, sf_dir), skills(spark, sf_dir), jobs(spark, sf_dir))


def part_name_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping A with part names as skills and nations as roles, where role skill sets differ."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.xxhash64("p_name").alias("skill_id"), F.col("p_name").alias("skill_name")
    )
    tags = _lines(spark, sf_dir, part, "skill_id", "skill_name").distinct()
    roles = jobs(spark, sf_dir).select("job_id", F.col("country_code").alias("search_role"))
    return tags.join(roles, "job_id")


# --- postings as landed JSON ------------------------------------------------------------------


def posting_json(postings: DataFrame) -> DataFrame:
    """Mapping A postings as the JSON a search returns, in all the shapes that occur.

    By remainders of the key: no id, company as text or absent, malformed or absent date, location
    that is no object, predicted flag as text or number, no category.
    """
    key = F.col("job_id")
    created = F.concat(F.date_format("job_posted_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    plain = F.to_json(
        F.struct(
            F.when(key % 97 != 0, key).alias("id"),
            "title",
            F.concat(F.lit("Order "), key.cast("string")).alias("description"),
            F.when(key % 11 == 0, "soon").when(key % 13 != 0, created).alias("created"),
            "salary_min",
            "salary_max",
            F.nullif("contract_type", F.lit("")).alias("contract_type"),
            F.nullif("contract_time", F.lit("")).alias("contract_time"),
            F.when(
                key % 6 != 0, F.struct(F.lit("jobs").alias("tag"), F.col("search_role").alias("label"))
            ).alias("category"),
        )
    )

    def quoted(c: str) -> Column:
        return F.concat(F.lit('"'), F.col(c), F.lit('"'))

    company = F.when(key % 7 == 0, F.concat(F.lit('"company":'), quoted("company_name"))).when(
        key % 7 != 1, F.concat(F.lit('"company":{"display_name":'), quoted("company_name"), F.lit("}"))
    )
    place = quoted("country_code")
    location = F.when(key % 9 == 0, F.concat(F.lit('"location":'), place)).otherwise(
        F.concat(F.lit('"location":{"area":["World",'), place, F.lit('],"display_name":'), place, F.lit("}"))
    )
    predicted = (
        F.when(key % 4 == 0, '"salary_is_predicted":"1"')
        .when(key % 4 == 1, '"salary_is_predicted":1')
        .when(key % 4 == 2, '"salary_is_predicted":"0"')
    )
    open_ended = F.substring(plain, F.lit(1), F.length(plain) - 1)
    whole = F.concat(F.concat_ws(",", open_ended, company, location, predicted), F.lit("}"))
    return postings.select("job_id", "search_role", "country_code", whole.alias("posting"))


def write_pages(postings: DataFrame, path: str) -> None:
    """Land postings as result pages of at most 50, one page per line; every tenth posting is found twice.

    Pages are rebalanced by search, so the number of files follows their size and not the tasks that made them.
    """
    rows = posting_json(postings)
    again = rows.filter(F.col("job_id") % 10 == 0).withColumn("page", F.lit(-1) - F.floor(F.col("job_id") / 500))
    once = rows.withColumn("page", F.floor(F.col("job_id") / 50))
    pages = (
        once.unionByName(again)
        .groupBy("search_role", "country_code", "page")
        .agg(F.array_join(F.array_sort(F.collect_list("posting")), ",").alias("list"), F.count(F.lit(1)).alias("n"))
    )
    line = F.concat(F.lit('{"results":['), "list", F.lit('],"count":'), F.col("n").cast("string"), F.lit("}"))
    lines = pages.select("search_role", "country_code", line.alias("value"))
    lines.hint("rebalance", "search_role", "country_code").write.partitionBy("search_role", "country_code").text(path)


# --- mapping B --------------------------------------------------------------------------------

# Frequent words of the document table, frozen so that every scale uses the same taxonomy.
TAXONOMY_WORDS = (
    "that with this from tion ther thon than thre thnt thes thha thhe thed erin thble anea thor thea thin "
    "thti eron then thly thtion thing thsh thnd thst thou erre eran erth erhe ered eror erat thwh erly ernd "
    "für ción éeau éeux"
).split()
TAXONOMY_ALIASES = {
    "that": ["thth"],
    "tion": ["attion", "ertion"],
    "from": ["of the", "from-the"],
    "this": ["This is the"],
    "éeux": ["éle"],
}


def taxonomy_rows() -> list[dict]:
    return [
        {
            "name": word,
            "category": None if i % 7 == 6 else f"group {i % 5}",
            "subcategory": None if i % 3 == 2 else f"kind {i % 4}",
            "aliases": TAXONOMY_ALIASES.get(word),
        }
        for i, word in enumerate(TAXONOMY_WORDS)
    ]


def taxonomy(spark: SparkSession) -> DataFrame:
    """Mapping B: the word taxonomy."""
    return spark.createDataFrame(pa.Table.from_pylist(taxonomy_rows()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping B: one posting per document, its source as role and its language as country."""
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("job_id"),
        "text",
        F.col("source").alias("search_role"),
        F.col("lang").alias("country_code"),
        F.concat_ws(" @ ", "source", "lang").alias("context"),
        F.timestamp_add("MINUTE", (F.col("doc_id") % 525600).cast("int"), start).alias("seen_at"),
    )


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping B: documents as raw landed rows."""
    docs = documents(spark, sf_dir)
    payload = F.to_json(F.struct(F.col("job_id").alias("id"), F.col("text").alias("description")))
    return docs.select(
        F.xxhash64(F.col("job_id").cast("string"), "country_code").alias("id"),
        F.col("job_id").cast("string").alias("job_platform_id"),
        "search_role",
        "country_code",
        payload.alias("raw_data"),
        F.col("seen_at").alias("extracted_at"),
        F.lit("batch-0").alias("extraction_batch_id"),
    )
