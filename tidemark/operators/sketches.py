"""Distinct counts and quantiles that merge: sketches per segment, stored once, read at any coarser level.

They are for those who ask for them: the marts count exactly. A sketch's error does not depend on how often it
was merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct-count sketch. The relative standard error is 1.04 / sqrt(2 ** LG_K): 0.8 %.
LG_K = 14
#: Size of a quantile sketch. The rank error is 1.33 % at most, with 99 % confidence.
QUANTILE_K = 200


def distinct_error(lg_k: int = LG_K, *, deviations: float = 3.0) -> float:
    """The relative error that an estimate stays within, for so many standard deviations."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


def segment_sketches(
    rows: DataFrame, by: Sequence[str], *, count: str | None = None, measure: str | None = None, lg_k: int = LG_K, k: int = QUANTILE_K
) -> DataFrame:
    """A row per segment: ``distinct_sketch`` of the values of ``count``, ``quantile_sketch`` of a whole-number ``measure``.

    Null values are left out. Sketches are built map-side and only they are shuffled, so a segment with a large
    share of all rows is no hot one.
    """
    made = []
    if count is not None:
        made.append(F.hll_sketch_agg(count, lg_k).alias("distinct_sketch"))
    if measure is not None:
        made.append(F.kll_sketch_agg_bigint(F.col(measure).cast("bigint"), k).alias("quantile_sketch"))
    return rows.groupBy(*by).agg(*made)


def distinct_estimates(sketches: DataFrame, by: Sequence[str], *, name: str = "estimate") -> DataFrame:
    """Distinct values at a coarser level than the sketches', from them alone."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias(name))


def quantile_estimates(sketches: DataFrame, by: Sequence[str], quantiles: Sequence[float], *, name: str = "quantiles") -> DataFrame:
    """The values at ``quantiles`` at a coarser level than the sketches', and how many values there are."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("quantile_sketch").alias("_merged"))
    at = F.array(*[F.kll_sketch_get_quantile_bigint("_merged", F.lit(float(q))) for q in quantiles])
    return merged.select(*by, F.kll_sketch_get_n_bigint("_merged").alias("values"), at.alias(name))
