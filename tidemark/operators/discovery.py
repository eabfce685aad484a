"""Tracking terms the taxonomy does not know and promoting the frequent, trusted ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEEN_ORDER = ("seen_at", "job_id", "position")


def _key() -> Column:
    return F.lower(F.trim("skill_name"))


#: What the rows of one name come to, in a form that adds up: no mean and no order of arrival.
COUNTED = T.StructType(
    [
        T.StructField("skill_key", T.StringType()),
        T.StructField("seen_at", T.TimestampNTZType()),  # of the first sight, as the next five
        T.StructField("job_id", T.LongType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("subcategory", T.StringType()),
        T.StructField("last_seen", T.TimestampNTZType()),
        T.StructField("occurrence_count", T.LongType()),
        T.StructField("thousandths", T.LongType()),
        T.StructField(
            "contexts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("seen_at", T.TimestampNTZType()),
                        T.StructField("job_id", T.LongType()),
                        T.StructField("position", T.IntegerType()),
                        T.StructField("context", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def count_discoveries(
    new: DataFrame, *, max_contexts: int = 5, context_chars: int = 100, default_confidence: float = 0.8
) -> DataFrame:
    """The rows of each name whatever the case, counted: the columns of ``COUNTED``.

    ``new`` holds job_id, position, skill_name, category, subcategory, confidence, context, seen_at. Of contexts
    the first few stay; they are cut before they are collected.
    """
    rows = new.filter(F.length(F.trim("skill_name")) >= 2).withColumn("skill_key", _key())
    thousandths = F.floor(F.coalesce("confidence", F.lit(default_confidence)) * 1000.0 + 0.5).cast("bigint")
    first = F.min(F.struct(*SEEN_ORDER, F.trim("skill_name").alias("name"), "category", "subcategory"))
    counted = rows.groupBy("skill_key").agg(
        first.alias("_first"),
        F.max("seen_at").alias("last_seen"),
        F.count(F.lit(1)).alias("occurrence_count"),
        F.sum(thousandths).alias("thousandths"),
    )
    nth = F.row_number().over(Window.partitionBy("skill_key").orderBy(*SEEN_ORDER))
    contexts = (
        rows.filter(F.col("context") != "")
        .withColumn("_n", nth)
        .filter(F.col("_n") <= max_contexts)
        .groupBy("skill_key")
        .agg(F.array_sort(F.collect_list(F.struct(*SEEN_ORDER, F.substring("context", 1, context_chars).alias("context")))).alias("contexts"))
    )
    none = F.array().cast(COUNTED["contexts"].dataType)
    return counted.join(contexts, "skill_key", "left").select(
        "skill_key", "_first.*", "last_seen", "occurrence_count", "thousandths", F.coalesce("contexts", none).alias("contexts")
    )


def shown_discoveries(counted: DataFrame) -> DataFrame:
    """Counted rows as discoveries: first spelling and category, first and last sight, count, mean confidence."""
    return counted.select(
        "skill_key",
        "name",
        F.coalesce("category", F.lit("Other")).alias("category"),
        F.coalesce("subcategory", F.lit("")).alias("subcategory"),
        F.col("seen_at").alias("first_seen"),
        "last_seen",
        "occurrence_count",
        (F.col("thousandths").cast("double") / (F.col("occurrence_count") * 1000).cast("double")).alias("avg_confidence"),
        F.col("contexts.context").alias("sample_contexts"),
        F.lit(False).alias("is_promoted"),
    )


def discoveries(new: DataFrame, **options) -> DataFrame:
    """One row per name whatever the case; rows and options as :func:`count_discoveries` has them."""
    return shown_discoveries(count_discoveries(new, **options))


def promotion_candidates(disc: DataFrame, *, min_count: int = 3, min_confidence: float = 0.75) -> DataFrame:
    fit = (F.col("occurrence_count") >= min_count) & (F.col("avg_confidence") >= min_confidence)
    return disc.filter(~F.col("is_promoted") & fit).orderBy(F.desc("occurrence_count"), "skill_key")


def promote_terms(taxonomy: DataFrame, dim: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Taxonomy and skill dimension with the candidates they lacked.

    The taxonomy compares names whatever the case, the dimension compares them exactly.
    """
    entries = candidates.select(
        "name", "category", "subcategory", F.array().cast("array<string>").alias("aliases"), "skill_key"
    )
    there = taxonomy.select(F.lower("name").alias("skill_key"))
    fresh = entries.join(there, "skill_key", "left_anti").select("name", "category", "subcategory", "aliases")
    rows = candidates.select(
        F.xxhash64("name").alias("skill_id"),
        F.col("name").alias("skill_name"),
        F.col("category").alias("skill_category"),
        F.col("subcategory").alias("skill_subcategory"),
    )
    grown = dim.unionByName(rows.join(dim.select("skill_name"), "skill_name", "left_anti"), allowMissingColumns=True)
    return taxonomy.unionByName(fresh, allowMissingColumns=True), grown


def discovery_stats(disc: DataFrame, *, top: int = 10, min_count: int = 3, min_confidence: float = 0.75) -> DataFrame:
    """Totals and the most frequent terms not promoted, in one row."""
    pending = promotion_candidates(disc, min_count=min_count, min_confidence=min_confidence)
    rounded = F.floor(F.col("avg_confidence") * 100.0 + 0.5) / 100.0
    head = (
        disc.filter(~F.col("is_promoted"))
        .orderBy(F.desc("occurrence_count"), "skill_key")
        .limit(top)
        .select(
            F.struct(
                (-F.col("occurrence_count")).alias("order"),
                "skill_key",
                F.struct(
                    "name", "category", F.col("occurrence_count").alias("occurrences"), rounded.alias("avg_confidence")
                ).alias("entry"),
            ).alias("r")
        )
    )
    return disc.agg(
        F.count(F.lit(1)).alias("total_discoveries"), F.count_if("is_promoted").alias("promoted_count")
    ).withColumns(
        {
            "pending_promotion": pending.agg(F.count(F.lit(1))).scalar(),
            "top_pending": head.agg(F.array_sort(F.collect_list("r"))["entry"]).scalar(),
        }
    )
