"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved


def components(links: DataFrame, *, rounds: int = 100) -> DataFrame:
    """``node`` and ``root`` (the smallest node it can reach) of every node that has a link.

    ``links`` has columns ``a`` and ``b`` of an ordered type; direction, repeats, loops and nulls do not matter.
    Every node ends as a leaf of its component's root, so what is kept is a row per node; each round is
    written to the shared folder. Counting combines before each shuffle, so a hub is no hot key: a node's
    least neighbour is a minimum. Links that are not done after ``rounds`` are an error.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "cc-links")
    for turn in range(rounds + 1):
        # Each link from both of its ends, in one read. What is known of a node's neighbours tells whether to go on, too.
        ends = F.array(*(F.struct(F.col(x).alias("of"), F.col(y).alias("other")) for x, y in (("hi", "lo"), ("lo", "hi"))))
        below, above = F.count_if(F.col("other") < F.col("of")), F.count_if(F.col("other") > F.col("of"))
        least = edges.select(F.inline(ends)).groupBy("of").agg(F.min("other").alias("best"), below.alias("below"), above.alias("above"))
        least = saved(least, "cc-least")
        # Done when every node has one link downwards at most and no node is both below and above.
        if not least.filter("below > 1 or (below = 1 and above > 0)").take(1):
            break
        if turn == rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        # Large star: each larger neighbour links to the least of the neighbourhood and the node.
        to = least.select("of", F.least("best", "of").alias("best"))
        large = edges.join(to, F.col("lo") == F.col("of")).select("hi", F.col("best").alias("lo")).distinct()
        # Small star: the smaller neighbours and the node link to the least of them.
        floor = large.groupBy(F.col("hi").alias("of")).agg(F.min("lo").alias("best"))
        down = large.join(floor, F.col("hi") == F.col("of"))
        small = down.select(F.col("lo").alias("hi"), F.col("best").alias("lo")).unionAll(floor.select(F.col("of").alias("hi"), F.col("best").alias("lo")))
        edges = saved(small.filter("hi <> lo").distinct(), "cc-round")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
