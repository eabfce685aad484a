"""Near-duplicates: consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

Equal texts are one node. A node's shingles are its runs of five words, weighed by frequency in the text and
rarity in the corpus. Each sample of the signature is the shingle that improved consistent weighted sampling
draws from one bin of the text's shingles (bins by hash; an empty bin borrows from the next). A shingle heavier
than UNIT goes to the bins in pieces of that weight, so that no bin depends on a few heavy shingles and two texts
agree on a sample as often as they are similar. Bands of samples propose pairs, the weighted Jaccard similarity
decides.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, saved, slices, text_of
from tidemark.llm.components import components
from tidemark.llm.decontaminate import shingles_of, word_codes

SIMILAR = 0.8
#: Samples: so many rounds over all shingles, each giving a sample for every bin.
ROUNDS, BINS = 8, 12
#: Weight of a piece of a shingle, at most: what one that occurs once weighs at most, so that only repeated ones are cut.
UNIT = 2.0
#: Samples in a band: a pair of similarity 0.8 meets in one of the 16 bands with probability 0.99, one of 0.9 with 0.99997.
ROWS = 6
#: How often the outsiders of a bucket meet a member of its main class before they meet all members.
MEETINGS = 1
#: Counters of the sketch of document frequencies, in each of its two rows.
WIDTH = 1 << 20
PART = 1 << 12
#: Steps of rounded-up weights: 2 at most, in 8 bits.
STEPS = 127
U = np.uint64
SHIFT = U(64 - 20)


def _mixed(codes: np.ndarray, salt: int) -> np.ndarray:
    out = (codes ^ U(salt * 0x9E3779B97F4A7C15 % 2**64)) * U(0xBF58476D1CE4E5B9)
    out ^= out >> U(29)
    out *= U(0x94D049BB133111EB)
    out ^= out >> U(32)
    return out


def _cells(codes: np.ndarray) -> list[np.ndarray]:
    return [(_mixed(codes, salt) >> SHIFT).astype(np.int64) for salt in (101, 202)]


def per_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in a row, how often each occurs there, and the texts' bounds."""
    codes, bounds = word_codes(texts)
    parts = [np.unique(shingles_of(codes[a:b]), return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.array([len(s) for s, _ in parts], dtype=np.int64)
    if not len(parts):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate([s for s, _ in parts]), np.concatenate([c for _, c in parts]), np.concatenate([[0], np.cumsum(sizes)])


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and a count-min sketch of how many hold each shingle, over all of ``docs``.

    The sketch has a fixed number of counters whatever the size of the corpus. Its estimate is never too
    low, and alike for every document, so that similarities stay true Jaccard similarities of their weights.
    """

    def run(batches):
        total, n = np.zeros(2 * WIDTH + PART, dtype=np.int64), 0
        for batch in slices(batches, "text"):
            codes, _, _ = per_text(batch.column("text"))
            n += batch.num_rows
            for row, cell in enumerate(_cells(codes)):
                total[row * WIDTH : (row + 1) * WIDTH] += np.bincount(cell, minlength=WIDTH)
        total[2 * WIDTH] = n
        team = TaskContext.get().partitionId() // 64
        parts = total.reshape(-1, PART)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * PART, pa.int32()), pa.array(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), team)), pa.array(np.arange(len(parts))), flat], ["team", "part", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        summed = np.zeros(PART, dtype=np.int64)
        for batch in rows.to_batches():
            summed += batch.column("counts").flatten().to_numpy().reshape(-1, PART).sum(0)
        return rows.slice(0, 1).set_column(2, "counts", pa.array([summed.tolist()], pa.list_(pa.int64())))

    form = "team bigint, part bigint, counts array<bigint>"
    sketch = docs.select(text_of().alias("text")).mapInArrow(run, form)
    # Tasks' counters are summed by teams of 64, then by part: what meets in a group stays small.
    by_team = sketch.groupBy("team", "part").applyInArrow(add, form)
    summed = by_team.groupBy("part").applyInArrow(add, form).select("part", "counts").toArrow()
    table = np.zeros((2 * WIDTH // PART + 1, PART), dtype=np.int64)
    for batch in summed.to_batches():
        table[batch.column("part").to_numpy()] = batch.column("counts").flatten().to_numpy().reshape(-1, PART)
    return int(table[-1, 0]), table[:-1].reshape(2, WIDTH)


def rarity(documents: int, table: np.ndarray) -> np.ndarray:
    """Weights from 1 (in every document) to 2 (in none) by the logarithm of the document frequency."""
    return (1 + np.log((1 + documents) / (1 + np.minimum(table, documents))) / np.log(2 + documents)).astype(np.float32)


def weights(sketch: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    one, two = _cells(codes)
    return counts * np.maximum(sketch[0][one], sketch[1][two]).astype(np.float64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    u = rng.uniform(size=(4, 1 << 16))
    r = -np.log(u[0]) - np.log(u[1])
    c = -np.log(u[2]) - np.log(u[3])
    return r.astype(np.float32), np.log(c).astype(np.float32)


R, LOG_C = _tables()


def in_pieces(codes: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles cut into pieces of UNIT and a rest, each with a code of its own.

    Piece by piece, the least weights of two texts sum to the least of the whole, so similarities stay the same.
    There are no more pieces than twice the words.
    """
    pieces = np.maximum(np.ceil(weight / UNIT), 1).astype(np.int64)
    each = np.repeat(np.arange(len(codes)), pieces)
    place = np.arange(len(each)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    ends = np.concatenate([[0], np.cumsum(pieces)])
    return codes[each] + place.astype(U) * U(0xD6E8FEB86659FD93), np.minimum(weight[each] - place * UNIT, UNIT), ends[bounds]


def samples(codes: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signatures of the texts: (texts, ROUNDS * BINS) 32-bit numbers; texts without shingles get zeros."""
    n = len(bounds) - 1
    out = np.zeros((n, ROUNDS, BINS), dtype=np.uint32)
    codes, weight, bounds = in_pieces(codes, weight, bounds)
    owner = np.repeat(np.arange(n) * BINS, np.diff(bounds))
    log_w = np.log(weight).astype(np.float32)
    rows = np.arange(n)[:, None]
    low, none = U(0xFFFF), np.iinfo(np.int64).max
    for k in range(ROUNDS):
        h = _mixed(codes, k + 1)
        r, log_c = R.take((h & low).astype(np.int64)), LOG_C.take(((h >> U(16)) & low).astype(np.int64))
        beta = ((h >> U(32)) & low).astype(np.float32) / np.float32(1 << 16)
        t = np.floor(log_w / r + beta)
        value = (log_c - r * (t - beta + 1)).view(np.int32)
        # The least value of each bin, with a name of (shingle, t) in the lower half of the number.
        value ^= (value >> 31) & np.int32(0x7FFFFFFF)
        name = ((h + t.astype(np.int64).astype(U)) * U(0x9E3779B97F4A7C15) >> U(32)) | U(1)
        best = np.full(n * BINS, none)
        np.minimum.at(best, owner + ((h >> U(48)) % U(BINS)).astype(np.int64), (value.astype(np.int64) << 32) | name.astype(np.int64))
        mine = np.where(best == none, 0, best & 0xFFFFFFFF).astype(np.uint32).reshape(n, BINS)
        # An empty bin takes the next full one's sample, marked by how far it was.
        place, far = np.tile(np.arange(BINS), (n, 1)), np.zeros((n, BINS), dtype=np.uint32)
        for _ in range(BINS - 1):
            empty = mine[rows, place] == 0
            if not empty.any():
                break
            place = np.where(empty, (place + 1) % BINS, place)
            far += empty.astype(np.uint32)
        out[:, k] = mine[rows, place] + far * np.uint32(0x85EBCA6B)
    return out.reshape(n, -1)


def brief(signature: np.ndarray) -> np.ndarray:
    """Two mixed bits of every sample, as numbers of 64 bits: (texts, samples / 32)."""
    mixed = (signature * np.uint32(0xC2B2AE35)) >> np.uint32(30)
    two = np.stack([mixed >> np.uint32(1), mixed & np.uint32(1)], 2).astype(np.uint8).reshape(len(signature), ROUNDS * BINS * 2)
    return np.packbits(two, axis=1).view(np.int64)


def allowed(n: Column, similar: float) -> Column:
    """How many samples of a pair this similar may differ in their two bits, short of 4.2 standard deviations.

    Two texts agree on a sample as often as they are similar, whatever their weights, as heavy shingles are in pieces.
    ``n``: shingles of the smaller text, as short texts fill few bins; its pieces are no fewer.
    """
    p = (1 - similar) * 0.75
    independent = F.least(F.lit(float(BINS)), n * 0.6) * ROUNDS
    return (p + 4.2 * F.sqrt(p * (1 - p) / independent)) * (ROUNDS * BINS)


def differing(a: str, b: str) -> Column:
    """In how many samples two ``brief`` arrays differ."""
    odd = F.lit(0x5555555555555555)

    def one(i):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))

    return reduce(lambda x, y: x + y, [one(i) for i in range(ROUNDS * BINS // 32)])


def bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.astype(U).reshape(len(signature), ROUNDS * BINS // ROWS, ROWS)
    out = np.zeros(parts.shape[:2], dtype=U)
    for i in range(ROWS):
        out = _mixed(out ^ parts[:, :, i], i + 11)
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted (codes, weights)."""
    _, at, other = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][at], b[1][other]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared)) if len(at) else 0.0


def _signed(docs: DataFrame, sketch) -> DataFrame:
    """node, doc_id, total weight and band keys of every text that has a word."""

    def run(batches):
        for batch in slices(batches, "text"):
            codes, counts, bounds = per_text(batch.column("text"))
            w = weights(sketch.value, codes, counts)
            full = np.flatnonzero(np.diff(bounds))
            signature = samples(codes, w, bounds)[full]
            keys, short = bands(signature), brief(signature)
            total = np.add.reduceat(w, bounds[:-1][full]) if len(full) else np.zeros(0)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (short, keys)]
            at = pa.array(full)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(at), batch.column("doc_id").take(at), pa.array(total), pa.array(np.diff(bounds)[full]), *lists], ["node", "doc_id", "total", "n", "brief", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.md5(text_of().cast("binary")).alias("node"), "doc_id", text_of().alias("text"))
    return texts.mapInArrow(run, f"node string, doc_id {kind}, total double, n bigint, brief array<bigint>, bands array<bigint>")


def _rounded(texts: DataFrame, sketch) -> DataFrame:
    """``held`` of each node: a number for each shingle and time it occurs, its weight rounded up in the last 8 bits."""

    def run(batches):
        for batch in slices(batches, "text"):
            codes, counts, bounds = per_text(batch.column("text"))
            each = np.repeat(np.arange(len(codes)), counts)
            time = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
            units = np.ceil(weights(sketch.value, codes[each], 1) * STEPS).astype(U)
            held = ((_mixed(codes[each] + time.astype(U), 55) & ~U(255)) | units).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(counts)])[bounds]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(held))], ["node", "held"])

    return texts.mapInArrow(run, "node string, held array<bigint>")


def could_reach(a: str, b: str, similar: float) -> Column:
    """Whether two texts' shared shingles, weights rounded up, can make them similar; never false for those that are."""
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0).cast("bigint"), lambda total, x: total + x.bitwiseAND(F.lit(255).cast("bigint")))
    both = (F.col("sa.total") + F.col("sb.total")) * STEPS
    return shared * (1 + similar) >= both * (similar * (1 - 1e-9))


def _texts(some: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the nodes in ``some``, read from one of the documents with that text."""
    keys = nodes.join(some, "node", "left_semi").select("node", F.col("doc_id").alias("first_id"))
    named = docs.select(F.md5(text_of().cast("binary")).alias("node"), "doc_id", text_of().alias("text"))
    return named.join(keys, "node").filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("node").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, sketch, similar: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar enough, with ``similarity``."""
    some = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    texts = _texts(some, docs, nodes)

    def run(batches):
        for batch in batches:
            for part in slices([batch], "text_a"):
                left = per_text(part.column("text_a"))
                for piece, skip in _pieces(part, "text_b"):
                    right = per_text(piece.column("text_b"))
                    got = []
                    for i in range(piece.num_rows):
                        a, b = (
                            (c[at[k] : at[k + 1]], weights(sketch.value, c[at[k] : at[k + 1]], n[at[k] : at[k + 1]]))
                            for (c, n, at), k in ((left, i + skip), (right, i))
                        )
                        got.append(similarity(a, b))
                    keep = pa.array([x >= similar for x in got])
                    yield pa.RecordBatch.from_arrays([piece.column("a").filter(keep), piece.column("b").filter(keep), pa.array(got).filter(keep)], ["a", "b", "similarity"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a string, b string, similarity double").distinct()


def _pieces(batch: pa.RecordBatch, column: str):
    skip = 0
    for piece in slices([batch], column):
        yield piece, skip
        skip += piece.num_rows


def classes(docs: DataFrame, *, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): ``node``, ``doc_id`` (the smallest with that text), ``n_docs``, ``class_node``; verified (a, b).

    A bucket of a band is not expanded into pairs: every member is compared with the bucket's first, then those
    not yet in the class of most of their bucket with a member of it, MEETINGS times. Those
    still outside it are compared with all members of other classes in the bucket, so that no link between classes that some band proposes is left out. Pairs that their total
    weights two bits of every sample, or shared shingles of rounded-up weight rule out are not verified.
    """
    spark = docs.sparkSession
    documents, table = document_frequencies(docs)
    sketch = spark.sparkContext.broadcast(rarity(documents, table))
    rows = saved(_signed(docs, sketch), "dup-signed")
    nodes = saved(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("total", "n", "brief")).alias("sign"), F.min("bands").alias("bands")), "dup-nodes")
    members = nodes.select("node", "sign", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("node", "sign")).alias("first")).filter("members > 1")
    members = saved(members.join(shared, ["band", "key"]), "dup-buckets")
    fits = F.least("sa.total", "sb.total") >= F.greatest("sa.total", "sb.total") * similar * (1 - 1e-9)
    fits &= differing("sa.brief", "sb.brief") <= allowed(F.least("sa.n", "sb.n"), similar)
    stars = members.filter("node <> first.node").select(F.col("first.node").alias("a"), F.col("node").alias("b"), F.col("first.sign").alias("sa"), F.col("sign").alias("sb"))
    tried = saved(stars.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "dup-tried")
    links = saved(_verified(tried, docs, nodes, sketch, similar), "dup-links")
    root = saved(components(links), "dup-roots")
    buckets = members.select("node", "sign", "band", "key")
    for turn in range(1, MEETINGS + 2):
        named = buckets.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # Of each class in a bucket: its size and a member that differs from turn to turn.
        draw = F.struct(F.xxhash64("node", "band", F.lit(turn)), "node", "sign")
        sizes = named.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("one"))
        mixed = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "root", "one")).alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
        named = saved(named.join(mixed.select("band", "key", F.col("most.root").alias("main"), F.col("most.one").alias("one")), ["band", "key"]), "dup-mixed")
        few = named.filter("root <> main").select("band", "key", F.col("node").alias("a"), F.col("sign").alias("sa"), F.col("root").alias("ra"), "one")
        if turn <= MEETINGS:
            pairs = few.select("a", F.col("one.node").alias("b"), "sa", F.col("one.sign").alias("sb")).filter(fits)
        else:
            held = saved(_rounded(_texts(named.select("node").distinct(), docs, nodes), sketch), "dup-rounded")
            few = few.join(held.select(F.col("node").alias("a"), F.col("held").alias("ha")), "a")
            many = named.select("band", "key", F.col("node").alias("b"), F.col("sign").alias("sb"), F.col("root").alias("rb"))
            many = many.join(held.select(F.col("node").alias("b"), F.col("held").alias("hb")), "b")
            pairs = few.join(many, ["band", "key"]).filter((F.col("ra") != F.col("rb")) & fits & could_reach("ha", "hb", similar))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = saved(pairs.join(tried, ["a", "b"], "left_anti"), "dup-pairs")
        if pairs.take(1):
            more = saved(_verified(pairs, docs, nodes, sketch, similar), "dup-more")
            tried = tried.unionAll(pairs)
            if more.take(1):
                links = links.unionAll(more)
                root = saved(components(links), "dup-roots")
    ended = nodes.join(root, "node", "left").select("node", "doc_id", "n_docs", F.coalesce("root", "node").alias("class_node"))
    ended = saved(ended, "dup-classes")
    sketch.destroy()  # all that needs it is written
    return ended, links


def near_duplicates(docs: DataFrame, *, similar: float = SIMILAR) -> DataFrame:
    """One row per input row: doc_id, ``class_id``, ``class_size`` (rows in it), ``n_links``, ``kept``.

    ``class_id`` is the smallest doc_id among texts linked by similarity, directly or not. ``n_links`` counts
    the other texts found directly similar by the comparisons made. Texts without a word (null and empty ones
    too) are in a class of their own. Repeated rows share a class; null ids are kept and never name a class
    that has another. ``kept`` marks the rows whose id names their class. Other columns are left out.
    """
    nodes, links = classes(docs, similar=similar)
    each = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    heads = nodes.groupBy("class_node").agg(F.min("doc_id").alias("class_id"), F.sum("n_docs").alias("class_size"))
    full = nodes.join(heads, "class_node").join(each, "node", "left").select("node", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = docs.select("doc_id", F.md5(text_of().cast("binary")).alias("node")).join(full, "node", "left")
    own = F.col("class_size").isNull()
    return rows.select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        (own | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def keep_one(docs: DataFrame, *, similar: float = SIMILAR) -> DataFrame:
    """One row of each class, that with the smallest doc_id; rows without a word all stay. Columns stay as they are."""
    row, node = fresh(docs, "dup_row"), fresh(docs, "dup_node")
    nodes, _ = classes(docs, similar=similar)
    marked = saved(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(node, F.md5(text_of().cast("binary"))), "dup-docs")
    mine = marked.select(F.col(row).alias("r"), F.col(node).alias("node"), F.col("doc_id").alias("i")).join(nodes.select("node", "class_node"), "node", "left")
    # Null ids come last.
    chosen = mine.filter("class_node is not null").groupBy("class_node").agg(F.min(F.struct(F.col("i").isNull(), "i", "r")).alias("best")).select(F.col("best.r").alias(row))
    own = mine.filter("class_node is null").select(F.col("r").alias(row))
    return marked.join(chosen.unionAll(own), row, "left_semi").select(*docs.columns)
