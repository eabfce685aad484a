"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ordered_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place (from 1) in the order: sorted by ranges, numbered in each, shifted by the ranges before."""
    at = fresh(df, "range_row")
    kept = saved(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")
    ranges = kept.groupBy(F.shiftright(at, 33).alias("_range")).count()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranges.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    joined = kept.join(shifts, F.shiftright(F.col(at), 33) == F.col("_range"))
    place = F.col(at) - F.shiftleft(F.col("_range"), 33) + F.col("_before") + 1
    return joined.withColumn(name, place).select(*df.columns, name)


# --- Arrow batches as flat arrays ---------------------------------------------------------------

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """What a task has freed goes back to the system: a Python worker lives on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 4_000_000) -> Iterable[pa.RecordBatch]:
    """The batches cut so that a text column holds about ``max_bytes`` (always whole rows)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def list_slices(batch: pa.RecordBatch, column: str, max_values: int = 250_000) -> Iterable[pa.RecordBatch]:
    """The batch cut so that a list column holds about ``max_values`` values (always whole rows)."""
    upto = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch.column(column)), 0)))
    start = 0
    while start < batch.num_rows:
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + max_values, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def whole(texts: pa.Array) -> pa.Array:
    """A copy with 64-bit offsets that is no view of a longer array; null is empty."""
    return pa.compute.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets of each (one more than texts); null is empty."""
    texts = whole(texts)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), bounds - bounds[0]
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the stretches of ``values`` between ``bounds``; empty stretches give 0."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), dtype=np.float64)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=np.float64)
    return out


def flat_words(texts: pa.Array, *, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words between the six ASCII blanks, A-Z lowered unless told otherwise, and each text's bounds among them."""
    texts = whole(texts)
    lists = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts) if lower else texts)
    bounds = np.asarray(lists.offsets).astype(np.int64)
    words = lists.flatten()
    bounds = bounds - bounds[0]
    full = np.asarray(pa.compute.not_equal(words, ""))
    if not full.all():
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        words = words.filter(pa.array(full))
    return words, bounds
