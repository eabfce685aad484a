"""Mixing sources to target weights by balanced sampling (the cube method).

Each source's target is a multiple of its size: every document is taken the whole part of that number of
times, and once more with the fractional part as its inclusion probability. The flight phase of the cube
method moves these probabilities along the null space of two balances, words and documents, until a
document is in or out. It runs on blocks of bounded size, each leaving two documents open at most; those
meet in new blocks, level by level, until one block per source lands the last two.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, ordered_number, saved, text_of

#: Documents that one task balances at a time.
BLOCK = 5000
#: How often a source may be repeated at most.
MOST = 3.0
UNIT = "unit bigint, src string, size bigint, base bigint, p double, order bigint"


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("bigint")


def flight(size: list[int], p: list[float], rng: random.Random) -> list[float]:
    """Probabilities moved to 0 or 1 with sums of ``p`` and ``p * size`` kept; two stay open at most."""
    p = list(p)
    window: list[int] = []
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        window.append(i)
        while len(window) == 3:
            a, b, c = (size[k] for k in window)
            move = (b - c, c - a, a - b)
            if not any(move):
                move = (1, -1, 0)
            up = min((1 - p[k]) / m if m > 0 else -p[k] / m for k, m in zip(window, move, strict=True) if m)
            down = min(p[k] / m if m > 0 else (p[k] - 1) / m for k, m in zip(window, move, strict=True) if m)
            step = up if rng.random() * (up + down) < down else -down
            for k, m in zip(window, move, strict=True):
                p[k] = min(1.0, max(0.0, p[k] + step * m))
                if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                    p[k] = float(round(p[k]))
            window = [k for k in window if 0 < p[k] < 1]
    return p


def landing(size: list[int], p: list[float], rng: random.Random) -> list[float]:
    """The last open ones: the balance of documents is dropped first, then that of words."""
    p = list(p)
    left = [i for i in range(len(p)) if 0 < p[i] < 1]
    if len(left) == 2 and min(size[i] for i in left) > 0:
        i, j = left
        move = {i: size[j], j: -size[i]}
        up = min((1 - p[k]) / m if m > 0 else -p[k] / m for k, m in move.items())
        down = min(p[k] / m if m > 0 else (p[k] - 1) / m for k, m in move.items())
        step = up if rng.random() * (up + down) < down else -down
        for k, m in move.items():
            p[k] += step * m
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = float(round(p[k]))
    return [1.0 if 0 < x < 1 and rng.random() < x else float(x == 1.0) for x in p]


def _level(open_units: DataFrame, level: int, block: int) -> tuple[DataFrame, bool]:
    """One round over the open units; whether it was the last (a single block in each source)."""
    counts = open_units.groupBy("src").count().withColumn("blocks", F.ceil(F.col("count") / block))
    last = not counts.filter("blocks > 1").take(1)
    dealt = open_units.join(counts.select(F.col("src").alias("of"), "blocks"), F.col("src").eqNullSafe(F.col("of"))).withColumn(
        "block", F.pmod(F.xxhash64("order", F.lit(level)), F.col("blocks"))
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "size", "unit"], kind="stable")
        rng = random.Random(f"{key[0]!r}:{key[1]}:{level}")
        size, p = rows["size"].tolist(), rows["p"].tolist()
        p = flight(size, p, rng)
        rows["p"] = landing(size, p, rng) if last else p
        return rows[["unit", "src", "size", "base", "p", "order"]]

    return dealt.groupBy("src", "block").applyInPandas(run, UNIT), last


def targets(sizes: DataFrame, *, total: float | None = None, most: float = MOST) -> DataFrame:
    """``target`` of each source: ``sizes`` has ``src`` and ``source_size``, a row per source.

    Sources by code point, null last, weigh 1, 2, 3 and so on in turn. Targets stop at ``most`` times the
    source's size, the rest is shared again by weight, until none is above.
    """
    ranked = ordered_number(sizes, [F.col("src").isNull(), F.col("src")], "rank").withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    ranked = saved(ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))), "mix-sources")
    total = total if total is not None else float(ranked.agg(F.sum("source_size")).head()[0] or 0)
    capped: Column = F.lit(False)
    share = 0.0
    while True:
        row = ranked.agg(
            F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("weight"),
        ).head()
        if not row["weight"]:
            break
        share = (total - row["full"]) / row["weight"]
        above = ~capped & (F.col("weight") * share > F.col("cap"))
        if not ranked.filter(above).take(1):
            break
        capped = capped | above
    return ranked.select("src", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("weight") * F.lit(share)).alias("target"))


def mix(units: DataFrame, *, block: int = BLOCK, most: float = MOST) -> DataFrame:
    """How much of each unit the mix takes. ``units``: ``unit`` (any id), ``src``, ``size``, a row each.

    Units go in the order of ``order``, a hash that the caller gives where ids do not tell the same from run to
    run; else it is made of the three.

    Returns unit, src, size, ``source_size``, ``target``, ``taken`` (words, repeats counted) and ``copies``.
    Units without words are never taken, as nothing is gained by them. Null sources are a source. Reruns on
    the same rows agree: order and draws come from hashes. An empty table gives no rows.
    """
    sizes = units.groupBy("src").agg(F.sum("size").alias("source_size"))
    goal = saved(targets(sizes, most=most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    whole = F.floor(rate + 1e-12)
    joined = units.join(goal.select(F.col("src").alias("of"), "source_size", "target"), F.col("src").eqNullSafe(F.col("of")))
    start = joined.select(
        "unit",
        "src",
        "size",
        whole.alias("base"),
        F.when((F.col("size") > 0) & (rate > whole + 1e-12), rate - whole).otherwise(0.0).alias("p"),
        F.col("order") if "order" in units.columns else F.xxhash64("unit", "src", "size").alias("order"),
    )
    done, left, level, last = None, saved(start, "mix-units"), 0, False
    while not last:
        settled = left.filter("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        moved, last = _level(left.filter("p > 0 and p < 1"), level, block)
        left, level = saved(moved, "mix-level"), level + 1
    done = done.unionByName(left)
    copies = (F.col("base") + F.col("p").cast("bigint")).cast("bigint")
    return done.join(goal.select(F.col("src").alias("of"), "source_size", "target"), F.col("src").eqNullSafe(F.col("of"))).select(
        "unit", "src", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), F.when(F.col("size") > 0, copies).otherwise(0).cast("bigint").alias("copies")
    )


def mix_documents(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``mix`` over documents: doc_id, size, source_size, target, taken, copies; a row per input row."""
    units = docs.select(F.col("doc_id").alias("unit"), F.col("source").alias("src"), words_in(text_of()).alias("size"))
    return mix(units, block=block).select(F.col("unit").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def mixed_rows(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The documents that the mix takes, all columns kept, with ``copies`` (how often) and ``taken`` (words).

    If ``docs`` has columns of these names, the new ones get an underscore before theirs. Draws follow a hash of
    id, source and text, so they do not depend on how the rows are cut; rows equal in these stand for each other.
    """
    row = fresh(docs, "mix_row")
    kept = saved(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    copies, taken = fresh(docs, "copies"), fresh(docs, "taken")
    units = kept.select(F.col(row).alias("unit"), F.col("source").alias("src"), words_in(text_of()).alias("size"), F.xxhash64("doc_id", "source", "text").alias("order"))
    chosen = mix(units, block=block).filter("copies > 0").select(F.col("unit").alias(row), F.col("copies").alias(copies), F.col("taken").alias(taken))
    return kept.join(chosen, row).drop(row)
