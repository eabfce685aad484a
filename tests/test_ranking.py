"""Split ranks and medians against plain ones, with one group holding most rows."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.exact import exact_ratio, exact_ratio_wide, value_midpoint
from tidemark.functions.ranking import split_row_number, value_stats


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_split_row_number_is_row_number(spark, seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice(["hot", "hot", "hot", "a", None]), rng.randint(1, 4), f"{rng.choice('abé')}{rng.randint(0, 10**6):07d}")
        for _ in range(3000)
    ]
    df = spark.createDataFrame(rows, "g string, n bigint, name string").distinct()
    order = [F.desc("n"), F.col("name")]
    plain = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    got = split_row_number(plain, ["g"], order, "rank")
    assert got.count() == df.count()
    assert got.filter(F.col("rank") != F.col("want")).count() == 0


def test_a_hot_group_of_like_names_spreads_over_tasks(spark):
    """Equal counts and names with a common start: nothing but the end of the name tells the rows apart."""
    df = spark.range(100_000).select(
        F.lit("hot").alias("g"), F.lit(7).alias("n"), F.format_string("common-start%09d", F.col("id") * 7919 % 100_000).alias("name")
    )
    order = [F.desc("n"), F.col("name")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ranked = split_row_number(df, ["g"], order, "rank")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = {r[0].rsplit("/", 1)[1] for r in spark.read.parquet(*ranked.inputFiles()).select(F.input_file_name()).distinct().collect()}
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert len(tasks) >= 4
    assert ranked.join(want, "name").filter(F.col("rank") != F.col("want")).count() == 0
    assert ranked.count() == 100_000


@pytest.mark.parametrize("seed", [4, 5])
def test_value_stats(spark, seed):
    rng = random.Random(seed)
    groups = {"hot": 5001, "even": 500, "two": 2, "one": 1}
    data = {g: [rng.choice([rng.randint(1, 10**8), 77]) for _ in range(n)] for g, n in groups.items()}
    rows = [(g, v) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, value bigint")
    hist = df.groupBy("g", "value").agg(F.count(F.lit(1)).alias("freq"))
    got = {r["g"]: r for r in value_stats(hist, ["g"]).collect()}
    for g, vs in data.items():
        r = got[g]
        assert (r["jobs"], int(r["total"]), r["low"], r["high"]) == (len(vs), sum(vs), min(vs), max(vs))
        assert r["median_lo"] == statistics.median_low(vs)
        assert r["median_hi"] == statistics.median_high(vs)
    assert {r["g"] for r in value_stats(hist, ["g"], min_rows=3).collect()} == {"hot", "even"}


def test_exact_ratio(spark):
    df = spark.createDataFrame([(29, 200, 0.15), (1, 3, 0.33), (0, 7, 0.0), (5, 0, None)], "a bigint, b bigint, want double")
    got = df.select(exact_ratio(F.col("a"), F.col("b"), 2).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    wide = df.select(exact_ratio_wide(-F.col("a"), F.col("b"), 2).alias("got"), (-F.col("want")).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in wide)


def test_value_midpoint(spark):
    df = spark.createDataFrame([(10, 15, 12.5), (10, None, 10.0), (None, 15, 15.0), (None, None, None)], "a int, b int, want double")
    lo, hi = F.col("a").cast("decimal(18,2)"), F.col("b").cast("decimal(18,2)")
    got = df.select(value_midpoint(lo, hi).cast("double").alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
