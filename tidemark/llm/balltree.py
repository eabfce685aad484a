"""Ranked lexical search: exact maximum inner products by sparse ball trees.

A document is the vector of its terms' saturated frequencies, an item that of its terms' rarities; the score
is their inner product in whole numbers. Documents stay where they are read: each block of them becomes a ball
tree over the terms that the items use. A node knows its documents' range, and their radius about the
centroid, so no document under it scores above item . centroid + |item| * radius, where the item's length counts
only the terms that some document under the node holds. Nodes are taken best first;
those whose bound, rounded up, lies below the item's tenth score so far are left out with all below them, and
leaves are scored exactly. A first descent to each item's nearest leaf in every block gives scores that
start the full search, so a block that holds nothing better is left at its upper nodes.
"""

from __future__ import annotations

import dataclasses
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import flat_bytes, row_sums, saved, slices, text_of
from tidemark.llm.pieces import gather

TOP = 10
#: Documents of one tree and of one leaf.
BLOCK_DOCS, LEAF_DOCS = 8192, 32
#: Words of items that one pass over the documents holds; more items take more passes.
PASS_WORDS = 1_000_000
#: Turns of the two means that cut a node.
STEPS = 3
#: Relative room for rounding in doubles, far above what sums of a million terms lose.
ROOM = 1e-9
#: Candidates kept before they are cut to the best of each item.
KEPT = 2_000_000

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters, digits and whatever is not ASCII, A-Z lowered, and each text's bounds among them."""
    data, ends = flat_bytes(texts)
    word = _WORD[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inside = ends[:-1][ends[:-1] < len(data)]
    start[inside] = word[inside]
    held = _LOWER[data[word]]
    offsets = np.append((np.cumsum(word) - 1)[start], len(held)).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(start)])[ends]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(held.tobytes())), bounds


@dataclasses.dataclass(frozen=True)
class Items:
    """The items of one pass: ids, and the terms of each (numbers in the vocabulary) with their counts."""

    ids: list
    vocabulary: pa.Array
    at: np.ndarray
    term: np.ndarray
    count: np.ndarray


def _counted(row: np.ndarray, term: np.ndarray, rows: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct terms and their counts: bounds, terms, counts."""
    key, count = np.unique(row * max(1, terms) + term, return_counts=True)
    return np.searchsorted(key, np.arange(rows + 1) * max(1, terms)), key % max(1, terms), count


def passes(benchmark: DataFrame, pass_words: int = PASS_WORDS):
    """The items in parts of bounded size. Only one part is at the driver at a time."""
    items = saved(benchmark.select("item_id", text_of().alias("text")), "items")
    words = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).head()[0]
    parts = max(1, math.ceil(words / pass_words))
    for part in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toArrow()
        terms, bounds = terms_of(mine.column("text").combine_chunks())
        coded = terms.dictionary_encode()
        row = np.repeat(np.arange(mine.num_rows), np.diff(bounds))
        yield Items(mine.column("item_id").to_pylist(), coded.dictionary, *_counted(row, np.asarray(coded.indices).astype(np.int64), mine.num_rows, len(coded.dictionary)))


def code_documents(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """Documents with a term at all: ``doc_id``, ``n`` terms, and the ``terms`` of the vocabulary with their ``tf``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for batch in slices(batches, "text"):
            words, bounds = terms_of(batch.column("text"))
            known = pa.compute.index_in(words, value_set=shared.value)
            hit = np.flatnonzero(np.asarray(known.is_valid()))
            row = np.searchsorted(bounds, hit, side="right") - 1
            term = np.asarray(known.drop_null()).astype(np.int64)
            at, term, tf = _counted(row, term, batch.num_rows, len(shared.value))
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (term, tf)]
            n = np.diff(bounds)
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tf"])
            yield out.filter(pa.array(n > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tf array<int>")


# --- trees ----------------------------------------------------------------------------------------


@dataclasses.dataclass(frozen=True)
class Tree:
    """A block's documents in the order of the leaves, and its nodes; children follow their parent."""

    place: np.ndarray  # of each document in the order of ids: settles equal scores
    at: np.ndarray
    term: np.ndarray
    value: np.ndarray
    first: np.ndarray  # of each node's documents
    end: np.ndarray
    left: np.ndarray  # child, or -1
    right: np.ndarray
    radius: np.ndarray


FIELDS = [f.name for f in dataclasses.fields(Tree)]


def centroid(term: np.ndarray, x: np.ndarray, docs: int, size: int) -> np.ndarray:
    return np.bincount(term, weights=x, minlength=size) / docs


def plant(place: np.ndarray, at: np.ndarray, term: np.ndarray, value: np.ndarray, size: int, leaf_docs: int = LEAF_DOCS) -> tuple[np.ndarray, Tree]:
    """A ball tree over documents with ``value`` for each of ``size`` terms.

    A node is cut in two by which of two means its documents are nearer to, a quarter of them at least on each
    side; the means begin as documents far apart. Returns the order the documents were put in and the tree.
    """
    x = value.astype(np.float64)
    norm = np.add.reduceat(np.append(x * x, 0.0), at[:-1]) * (np.diff(at) > 0) if len(at) > 1 else np.zeros(0)
    order = np.arange(len(at) - 1)
    first, end, left, right, radius = [], [], [], [], []
    todo = [(0, len(order), -1, False)]

    def dots(docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        t, bounds = gather(term, at, docs)
        w, _ = gather(x, at, docs)
        return np.diff(np.concatenate([[0.0], np.cumsum(w * dense[t])])[bounds])

    def dense(doc: int) -> np.ndarray:
        out = np.zeros(size)
        out[term[at[doc] : at[doc + 1]]] = x[at[doc] : at[doc + 1]]
        return out

    while todo:
        a, b, parent, is_right = todo.pop()
        node = len(first)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        docs = order[a:b]
        t, _ = gather(term, at, docs)
        w, _ = gather(x, at, docs)
        c = centroid(t, w, max(1, b - a), size)
        square = float(c @ c)
        away = norm[docs] - 2 * dots(docs, c) + square
        # Cancellation loses some of the squares' size; what is added covers it.
        reach = float(away.max(initial=0.0)) + ROOM * (float(norm[docs].max(initial=0.0)) + square)
        for column, v in ((first, a), (end, b), (left, -1), (right, -1), (radius, math.sqrt(max(0.0, reach)) * (1 + ROOM))):
            column.append(v)
        if b - a > leaf_docs and away.max() > ROOM * square:
            one = int(docs[np.argmax(away)])
            other = int(docs[np.argmax(norm[docs] - 2 * dots(docs, dense(one)))])
            means = dense(one), dense(other)
            for _ in range(STEPS):
                side = dots(docs, means[1] - means[0]) > float(means[1] @ means[1] - means[0] @ means[0]) / 2
                halves = [docs[~side], docs[side]]
                if not len(halves[0]) or not len(halves[1]):
                    break
                means = tuple(centroid(gather(term, at, h)[0], gather(x, at, h)[0], len(h), size) for h in halves)
            order[a:b] = docs[np.argsort(dots(docs, means[1] - means[0]), kind="stable")]
            middle = a + min(max(int((~side).sum()), (b - a + 3) // 4), 3 * (b - a) // 4)
            todo += [(middle, b, node, True), (a, middle, node, False)]
    t, bounds = gather(term, at, order)
    v, _ = gather(value, at, order)
    return order, Tree(place[order], bounds, t, v, *map(np.array, (first, end, left, right, radius)))


class Search:
    """The items' best documents of one tree; ``floor`` holds a score that each item's tenth is known to reach."""

    def __init__(self, tree: Tree, items: Items, weight: np.ndarray, floor: np.ndarray, top: int):
        self.tree, self.items, self.top = tree, items, top
        self.whole = items.count * weight[items.term]  # exact
        self.floor = np.maximum(floor, 1)
        self.best = np.zeros((len(items.ids), top), dtype=np.int64)
        self.found: list[np.ndarray] = []  # (item, document, score)
        self.held = 0
        self.column = np.full(len(weight), -1, dtype=np.int64)
        self.scored = 0

    def bounds(self, node: int, some: np.ndarray) -> np.ndarray:
        """No document under the node scores more for these items."""
        tree = self.tree
        a, b = tree.first[node], tree.end[node]
        part = slice(tree.at[a], tree.at[b])
        c = centroid(tree.term[part], tree.value[part], max(1, b - a), len(self.column))
        term, at = gather(self.items.term, self.items.at, some)
        q, _ = gather(self.whole, self.items.at, some)
        # Documents differ from the centroid only on terms that it has, so only those of the item's matter.
        q = q * (c[term] > 0)
        return (row_sums(q * c[term], at) + np.sqrt(row_sums(q * q, at)) * tree.radius[node]) * (1 + ROOM) + 1

    def leaf(self, node: int, some: np.ndarray) -> None:
        """Score the node's documents exactly and raise the items' floors."""
        tree = self.tree
        a, b = int(tree.first[node]), int(tree.end[node])
        part = slice(tree.at[a], tree.at[b])
        used = np.unique(tree.term[part])
        self.column[used] = np.arange(len(used))
        held = np.zeros((b - a, len(used) + 1), dtype=np.int64)
        held[np.repeat(np.arange(b - a), np.diff(tree.at[a : b + 1])), self.column[tree.term[part]]] = tree.value[part]
        term, at = gather(self.items.term, self.items.at, some)
        w, _ = gather(self.whole, self.items.at, some)
        products = held[:, self.column[term]] * w  # a term that no document here holds is the last column, 0
        self.column[used] = -1
        run = np.concatenate([np.zeros((b - a, 1), dtype=np.int64), np.cumsum(products, axis=1)], axis=1)
        scores = (run[:, at[1:]] - run[:, at[:-1]]).T
        self.scored += scores.size
        better = scores >= self.floor[some][:, None]
        i, d = np.nonzero(better)
        if not len(i):
            return
        self.found.append(np.stack([some[i], a + d, scores[i, d]]))
        self.held += len(i)
        rows = np.unique(i)
        mine = some[rows]
        both = np.concatenate([self.best[mine], scores[rows]], axis=1)
        self.best[mine] = -np.partition(-both, self.top - 1, axis=1)[:, : self.top]
        self.floor[mine] = np.maximum(self.floor[mine], self.best[mine].min(axis=1))
        if self.held > KEPT:
            self.cut()

    def cut(self) -> None:
        """Keep the best of each item: by score, then by the order of ids."""
        if not self.found:
            return
        item, doc, score = np.concatenate(self.found, axis=1)
        order = np.lexsort([self.tree.place[doc], -score, item])
        item, doc, score = item[order], doc[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        nth = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        keep = nth < self.top
        self.found, self.held = [np.stack([item[keep], doc[keep], score[keep]])], int(keep.sum())

    def descend(self) -> None:
        """Each item's way down to the leaf with the best bounds."""
        todo = [(0, np.arange(len(self.items.ids)))]
        while todo:
            node, some = todo.pop()
            left, right = int(self.tree.left[node]), int(self.tree.right[node])
            if left < 0:
                self.leaf(node, some)
                continue
            goes = self.bounds(left, some) >= self.bounds(right, some)
            todo += [(child, mine) for child, mine in ((left, some[goes]), (right, some[~goes])) if len(mine)]

    def run(self) -> None:
        """Best first: the node with the largest bound of any item, for the items it can still give something."""
        every = np.arange(len(self.items.ids))
        bound = self.bounds(0, every)
        heap = [(-float(bound.max(initial=0.0)), 0, every, bound)]
        while heap:
            _, node, some, bound = heapq.heappop(heap)
            open_ = bound >= self.floor[some]
            some = some[open_]
            if not len(some):
                continue
            if self.tree.left[node] < 0:
                self.leaf(node, some)
                continue
            for child in (int(self.tree.left[node]), int(self.tree.right[node])):
                bound = self.bounds(child, some)
                open_ = bound >= self.floor[some]
                if open_.any():
                    heapq.heappush(heap, (-float(bound[open_].max()), child, some[open_], bound[open_]))


# --- the search -----------------------------------------------------------------------------------


def build_trees(coded: DataFrame, stats: tuple[int, int], weight: np.ndarray, *, block_docs: int = BLOCK_DOCS, leaf_docs: int = LEAF_DOCS) -> DataFrame:
    """A row for each block of documents: their ``ids`` and the fields of its tree."""
    n_docs, n_terms = stats
    shared = coded.sparkSession.sparkContext.broadcast(weight)

    def tree_of(ids: pa.Array, n: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        weight = shared.value
        wide = n.astype(object) if 75 * int(n.max(initial=0)) * n_docs >= 2**63 else n
        m = 25 + (75 * wide * n_docs // n_terms).astype(np.int64)
        value = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(at)))
        heavy = (weight[term] > 0) & (value > 0)
        at = np.concatenate([[0], np.cumsum(heavy)])[at]
        place = np.empty(len(ids), dtype=np.int64)
        place[np.asarray(pa.compute.sort_indices(ids, null_placement="at_end"))] = np.arange(len(ids))
        order, tree = plant(place, at, term[heavy], value[heavy], len(weight), leaf_docs)
        columns = [ids.take(pa.array(order)), *(pa.array(getattr(tree, f)) for f in FIELDS)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.RecordBatch.from_arrays(lists, ["ids", *FIELDS])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            batch = batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column("terms")), 0))
            while batch.num_rows:
                room = block_docs - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == block_docs:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        ids, n, terms, tf = (whole.column(c).combine_chunks() for c in ("doc_id", "n", "terms", "tf"))
        at = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(terms)))]).astype(np.int64)
        return tree_of(ids, np.asarray(n), at, np.asarray(terms.flatten()).astype(np.int64), np.asarray(tf.flatten()).astype(np.int64))

    kind = coded.schema["doc_id"].dataType.simpleString()
    types = {"radius": "double"}
    return coded.mapInArrow(run, f"ids array<{kind}>, {', '.join(f'`{f}` array<{types.get(f, "bigint")}>' for f in FIELDS)}")


def search_trees(trees: DataFrame, items: Items, weight: np.ndarray, floor: np.ndarray, *, top: int = TOP, descend: bool = False) -> DataFrame:
    """Each block's best documents of each item: ``item`` (its place), ``doc_id``, ``score``."""
    shared = trees.sparkSession.sparkContext.broadcast((items, weight, floor))

    def run(batches):
        items, weight, floor = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                ids, *fields = (batch.column(c).slice(k, 1).flatten() for c in ("ids", *FIELDS))
                found = Search(Tree(*map(np.asarray, fields)), items, weight, floor, top)
                found.descend() if descend else found.run()
                found.cut()
                if found.found:
                    item, doc, score = found.found[0]
                    yield pa.RecordBatch.from_arrays([pa.array(item), ids.take(pa.array(doc)), pa.array(score)], ["item", "doc_id", "score"])

    return trees.mapInArrow(run, f"item bigint, doc_id {trees.schema['ids'].dataType.elementType.simpleString()}, score bigint")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def rank_documents(docs: DataFrame, benchmark: DataFrame, *, top: int = TOP, pass_words: int = PASS_WORDS, block_docs: int = BLOCK_DOCS, leaf_docs: int = LEAF_DOCS) -> DataFrame:
    """The ``top`` documents of each row of ``benchmark``: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``.

    Only scores above 0 count; equal ones go by ascending id, null ids last. Texts that are null or hold no term
    are no documents, items without a known term have no rows; repeated rows each count; empty tables give no
    rows. Other columns are left out. The items are the query set, held in parts of ``pass_words`` words (at most one
    item more); a part is a pass over all documents, which are not shuffled. From each block of documents only
    the best of each item move on.
    """
    spark = docs.sparkSession
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {kinds[1].simpleString()}, rank int, doc_id {kinds[0]}, score bigint")
    for items in passes(benchmark, pass_words):
        coded = saved(code_documents(docs, items.vocabulary), "coded")
        n_docs, n_terms = coded.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
        if not n_docs or not len(items.vocabulary):
            continue
        # No more rows than the part has terms.
        held = coded.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        df = np.zeros(len(items.vocabulary), dtype=np.int64)
        df[held.column("term").to_numpy()] = held.column("count").to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for k in df.tolist()], dtype=np.int64)
        trees = saved(build_trees(coded, (n_docs, n_terms), weight, block_docs=block_docs, leaf_docs=leaf_docs), "trees")
        floor = np.zeros(len(items.ids), dtype=np.int64)
        near = _ranked(search_trees(trees, items, weight, floor, top=top, descend=True), top)
        tenth = near.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).filter(F.col("n") == top).toArrow()
        floor[tenth.column("item").to_numpy()] = tenth.column("low").to_numpy()
        names = spark.createDataFrame(list(enumerate(items.ids)), f"item bigint, item_id {kinds[1].simpleString()}")
        best = _ranked(search_trees(trees, items, weight, floor, top=top), top)
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


#: Lower-case terms of a text, as DuckDB writes it.
_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS t FROM documents),
held AS (SELECT doc_id, r, len(t) AS n, t FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM held),
q AS (SELECT r, any_value(item_id) AS item_id, term, count(*) AS c FROM (
    SELECT r, item_id, unnest(t) AS term FROM (SELECT item_id, row_number() OVER () AS r, {_TERMS} AS t FROM benchmark)) GROUP BY r, term),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (
    SELECT r, doc_id, n, unnest(t) AS term FROM held) SEMI JOIN q USING (term) GROUP BY r, term),
df AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
v AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * n_docs) // n_terms)))) AS v FROM tf JOIN df USING (term), total),
scored AS (SELECT q.r AS item, any_value(item_id) AS item_id, v.r, any_value(doc_id) AS doc_id, sum(c * v)::BIGINT AS score
    FROM q JOIN v USING (term) GROUP BY q.r, v.r HAVING sum(c * v) > 0)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank FROM scored) WHERE rank <= 10
"""
