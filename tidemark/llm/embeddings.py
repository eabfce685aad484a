"""Near-duplicate embeddings: an exact range join in a metric space.

Cosine 0.9 or more means a Euclidean distance of sqrt(0.2) at most between the vectors at unit length. Pivots
cut the space into cells of the vectors nearest to them. By the triangle inequality a vector can have a
neighbour in another cell only if it is no more than twice that distance farther from that pivot than from
its own, and within that distance of the cell's radius; there it is a guest. Cells join independently;
large ones in blocks, so that no task grows with a group of near copies. Equal vectors are joined as one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved
from tidemark.llm.components import components

SIMILAR = 0.9
#: Vectors that a cell holds about; there are PIVOTS cells at most, as every task reads all pivots.
CELL, PIVOTS = 2000, 1024
#: Vectors in a block of a cell.
BLOCK = 2048


def comparable() -> Column:
    """Whether ``embedding`` can be compared: no null in it, all finite, not all zero."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def _linked(x: np.ndarray, y: np.ndarray, similar: float):
    """(rows of x, rows of y) with cosine ``similar`` or more, a strip at a time."""
    for start in range(0, len(x), 512):
        a, b = np.nonzero(x[start : start + 512] @ y.T >= similar)
        yield a + start, b


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merge along all pairs: the larger root always goes under the smaller, until nothing moves."""
        while len(a):
            ra, rb = self.roots()[a], self.up[b]
            some = ra != rb
            a, b, ra, rb = a[some], b[some], ra[some], rb[some]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return self.up
            self.up = above


def _cells(nodes: DataFrame, dim: int, similar: float) -> DataFrame:
    """Each node in its home cell and where it is a guest: cell, guest, node, copies, embedding."""
    spark = nodes.sparkSession
    far = math.sqrt(2 - 2 * similar) + 1e-9
    k = max(1, min(PIVOTS, nodes.count() // CELL))
    chosen = nodes.orderBy(F.xxhash64("embedding"), "node").limit(k).select("embedding").toArrow()
    shared = spark.sparkContext.broadcast(unit(chosen.column("embedding").combine_chunks(), dim))

    def home(batches):
        for batch in batches:
            if batch.num_rows:
                d = _distances(unit(batch.column("embedding"), dim), shared.value)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(d[np.arange(len(d)), cell])], ["cell", "d"])

    radius = np.full(k, -np.inf)
    for r in nodes.mapInArrow(home, "cell bigint, d double").groupBy("cell").agg(F.max("d").alias("r")).collect():
        radius[r["cell"]] = r["r"]
    radii = spark.sparkContext.broadcast(radius)

    def place(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                d = _distances(unit(part.column("embedding"), dim), shared.value)
                cell = d.argmin(1)
                own = d[np.arange(len(d)), cell]
                reach = (d <= own[:, None] + 2 * far) & (d <= radii.value[None] + far)
                # A pair is found in the home cell of its smaller cell number.
                reach &= np.arange(k)[None] <= cell[:, None]
                reach[np.arange(len(d)), cell] = True
                row, to = np.nonzero(reach)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(to != cell[row]), *(part.column(c).take(at) for c in ("node", "copies", "embedding"))], ["cell", "guest", "node", "copies", "embedding"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    return nodes.mapInArrow(place, f"cell bigint, guest boolean, node bigint, copies bigint, embedding {kind}")


def _cell_links(placed: DataFrame, dim: int, similar: float) -> DataFrame:
    """node, ``links`` (vectors linked, from one pair of blocks) and ``root`` (a node it is connected to there)."""
    counts = placed.groupBy("cell", "guest").count()
    blocks = counts.groupBy("cell").agg(*[F.coalesce(F.sum(F.when(F.col("guest") == g, F.ceil(F.col("count") / BLOCK))), F.lit(0)).alias(n) for g, n in ((False, "homes"), (True, "guests"))])
    dealt = placed.join(blocks, "cell").withColumn("mine", F.when(F.col("guest"), F.col("homes") + F.pmod(F.xxhash64("node"), F.greatest("guests", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.greatest("homes", F.lit(1)))))
    mine, homes = F.col("mine"), F.col("homes")
    # A block of homes meets itself, later homes and all guests; guests do not meet each other.
    as_left = F.when(~F.col("guest"), F.transform(F.sequence(mine, homes + F.col("guests") - 1), lambda o: F.struct(mine.alias("x"), o.alias("y"), F.lit(True).alias("left"))))
    before = F.when(F.col("guest"), homes - 1).otherwise(mine - 1)
    as_right = F.when(before >= 0, F.transform(F.sequence(F.lit(0).cast("bigint"), before), lambda o: F.struct(o.alias("x"), mine.alias("y"), F.lit(False).alias("left"))))
    none = F.array().cast("array<struct<x:bigint,y:bigint,left:boolean>>")
    tasks = dealt.select("cell", "node", "copies", "embedding", F.explode(F.concat(F.coalesce(as_left, none), F.coalesce(as_right, none))).alias("t")).select("cell", "t.x", "t.y", "t.left", "node", "copies", "embedding")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("node")
        left = rows.column("left").to_numpy().astype(bool)
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        v = unit(rows.column("embedding").combine_chunks(), dim)
        l, r = np.flatnonzero(left), np.flatnonzero(~left)
        alone = not len(r) and rows.column("x")[0].as_py() == rows.column("y")[0].as_py()
        if alone:
            r = l
        links, forest = np.zeros(len(node), dtype=np.int64), _Forest(len(node))
        for a, b in _linked(v[l], v[r], similar):
            a, b = l[a], r[b]
            if alone:
                a, b = a[a < b], b[a < b]
            links += np.bincount(a, copies[b], len(node)).astype(np.int64) + np.bincount(b, copies[a], len(node)).astype(np.int64)
            forest.join(a, b)
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "links": links[some], "root": node[forest.roots()[some]]})

    return tasks.groupBy("cell", "x", "y").applyInArrow(run, "node bigint, links bigint, root bigint")


def link_embeddings(vectors: DataFrame, *, similar: float = SIMILAR) -> DataFrame:
    """One row per input row: vec_id, ``n_links``, ``component_id``, ``kept``.

    ``n_links`` counts the other rows with cosine ``similar`` or more in double precision, ``component_id`` is
    the smallest vec_id reachable by links. Vectors that are null, zero, or hold null or non-finite
    components link with nothing and are their own component; vectors of different lengths never link.
    Repeated rows are vectors of their own, linked with each other; null ids are kept and name a
    component only if no other id there does. Other columns are left out.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    vectors = vectors.select("vec_id", F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    good = vectors.filter(comparable())
    grouped = good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    nodes = saved(grouped.withColumn("node", F.monotonically_increasing_id()), "vec-nodes")
    found = None
    for (dim,) in nodes.select(F.size("embedding")).distinct().collect():
        mine = nodes.filter(F.size("embedding") == dim)
        part = _cell_links(saved(_cells(mine, dim, similar), "vec-cells"), dim, similar)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = saved(found, "vec-links")
    root = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    full = nodes.join(root, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = full.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    full = full.join(heads, "root").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    rows = good.join(full, "embedding").select("vec_id", "n_links", "component_id")
    rows = rows.unionAll(vectors.filter(~comparable()).select("vec_id", F.lit(0).cast("bigint"), F.col("vec_id")))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
