"""Ranks and medians over groups that may hold a large share of all rows.

A plain ``row_number()`` sends a whole group to one task. Here the rows are sorted by ranges of the whole order,
whose cut points Spark takes from a sample of it, so a group spreads over as many ranges as it has rows for;
each range numbers its own rows and is shifted by the rows of the group in the ranges before. Results are those
of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exact import int_div
from tidemark.session import saved

_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (left[x].eqNullSafe(right[y]) for x, y in pairs))


def split_row_number(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column], name: str) -> DataFrame:
    """Add ``row_number() over (partition_by order by order_by)`` as bigint ``name``.

    The sorted rows are written to the shared folder, so that numbers and shifts come from the same ranges. The
    order should tell rows apart: only equal rows stay in one range whatever their number.
    """
    parts = list(partition_by)
    place = F.monotonically_increasing_id()  # range number, then place in the range
    rows = saved(df.orderBy(*parts, *order_by).withColumn("_place", place), "ranked")
    rows = rows.withColumn("_range", F.shiftright("_place", 33))
    held = rows.groupBy("_range", *parts).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*parts).orderBy("_range").rowsBetween(*_BEFORE))
    shifts = held.select(
        *[F.col(c).alias(f"_o_{c}") for c in ("_range", *parts)],
        (F.coalesce(earlier, F.lit(0).cast("bigint")) - F.col("_first") + 1).alias("_shift"),
    )
    same = null_safe(rows, shifts, [(c, f"_o_{c}") for c in ("_range", *parts)])
    return rows.join(shifts, same).select(*[rows[c] for c in df.columns], (F.col("_place") + F.col("_shift")).alias(name))


def value_stats(hist: DataFrame, keys: Sequence[str], *, min_rows: int = 1) -> DataFrame:
    """Size, sum, ends and both middle values of each group of counted integers.

    ``hist`` holds one row per (keys, value) with its ``freq``. Neighbouring values share a bucket
    (at most 4096 of them); buckets are summed up first, and only the values of the one or two
    that hold the middle are ordered. Adds ``jobs``, ``total`` (decimal), ``low``, ``high``,
    ``median_lo`` and ``median_hi``; groups under ``min_rows`` are left out.
    """
    keys = list(keys)
    bucket = F.shiftright("value", 12)
    buckets = hist.groupBy(*keys, bucket.alias("_bucket")).agg(
        F.sum("freq").alias("_n"),
        F.sum(F.col("value") * F.col("freq")).alias("_sum"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
    )
    whole = Window.partitionBy(*keys)
    earlier = F.sum("_n").over(whole.orderBy("_bucket").rowsBetween(*_BEFORE))
    spread = buckets.select(
        *[F.col(c).alias(f"_k_{c}") for c in (*keys, "_bucket")],
        "_n",
        F.coalesce(earlier, F.lit(0).cast("bigint")).alias("_before"),
        F.sum("_n").over(whole).alias("jobs"),
        F.sum(F.col("_sum").cast("decimal(20,0)")).over(whole).alias("total"),
        F.min("_min").over(whole).alias("low"),
        F.max("_max").over(whole).alias("high"),
    )
    one, two = F.lit(1).cast("bigint"), F.lit(2).cast("bigint")
    nth_low, nth_high = int_div(F.col("jobs") - one, two), int_div(F.col("jobs"), two)
    middle = spread.filter(
        (F.col("jobs") >= min_rows)
        & (F.col("_before") <= nth_high)
        & (F.col("_before") + F.col("_n") > nth_low)
    )
    values = hist.withColumn("_bucket", bucket)
    near = values.join(middle, null_safe(values, middle, [(c, f"_k_{c}") for c in (*keys, "_bucket")]))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("value").rowsBetween(*_SO_FAR)
    upto = near.withColumn("_upto", F.col("_before") + F.sum("freq").over(inside))
    return upto.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("jobs", "total", "low", "high")],
        F.min(F.when(F.col("_upto") > nth_low, F.col("value"))).alias("median_lo"),
        F.min(F.when(F.col("_upto") > nth_high, F.col("value"))).alias("median_hi"),
    )
