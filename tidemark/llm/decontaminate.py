"""Benchmark passages in documents: SimHash of item-sized windows, then exact similarity.

An item's shingles are its runs of five words (all its words, if fewer), weighed by their rarity among the
items. Over each document slide windows as long as an item; a window's fingerprint is the SimHash of its
weighted shingles. Fingerprints are cut into blocks, and an index over the items' blocks is asked with every
block at a small distance, which by the pigeonhole principle returns every item within its radius; what it
returns is verified by the exact weighted overlap of shingles. A window that holds no shingle of an item has
no overlap with it, so windows are made only where some shingle of an item of that size stands.
"""

from __future__ import annotations

import dataclasses
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat_words, saved, slices, text_of

SHINGLE = 5
SIMILAR = 0.8
BITS, BLOCKS = 64, 8
#: Standard deviations of the distance by which an item's radius exceeds what is expected of its worst window.
ROOM = 4.0
#: Words of items that one pass over the documents holds; more items take more passes.
PASS_WORDS = 2_000_000
TRIM = "\"'`.,;:!?()[]{}<>*_#~|«»“”‘’…-–—/\\&%$@+="


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without marks at their ends, and each text's bounds; words of marks alone do not count."""
    words, bounds = flat_words(texts)
    if not len(words):
        return np.zeros(0, np.uint64), bounds
    coded = words.dictionary_encode()
    bare = pa.compute.utf8_lower(pa.compute.utf8_trim(coded.dictionary, characters=TRIM)).to_pylist()
    code = np.fromiter((xxhash.xxh64_intdigest(w) if w else 0 for w in bare), dtype=np.uint64, count=len(bare))
    codes = code[np.asarray(coded.indices)]
    full = codes != 0
    return codes[full], np.concatenate([[0], np.cumsum(full)])[bounds]


def shingle_codes(codes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A hash of each run of ``width`` words; as many as there are places to start."""
    n = max(0, len(codes) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = (out ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def shingles_of(codes: np.ndarray) -> np.ndarray:
    return shingle_codes(codes, min(SHINGLE, max(1, len(codes)))) if len(codes) else np.zeros(0, np.uint64)


def _signs(codes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of a mixed hash."""
    mixed = (codes ^ (codes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(27)
    return np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).reshape(-1, BLOCKS)


@dataclasses.dataclass(frozen=True)
class Index:
    """The items of one pass."""

    ids: list
    words: np.ndarray  # words in each item
    total: np.ndarray  # weight of each item
    shingle: np.ndarray  # distinct shingles of the items, in order
    weight: np.ndarray
    width: np.ndarray  # words in the shingle
    holder: np.ndarray  # items by shingle
    holder_at: np.ndarray
    fingerprint: np.ndarray  # (items, BLOCKS) bytes
    radius: np.ndarray  # of each item: fingerprints up to this distance are all found
    table: np.ndarray  # (BLOCKS, 256) items whose block is near, one bit each
    counts: list[dict[int, int]]


def radius_of(weights: np.ndarray, other: float) -> int:
    """The distance that windows with overlap ``SIMILAR`` stay within, by the weights of an item's shingles.

    A bit differs with probability angle / pi. The angle is the widest of two cases: the lightest shingles are
    missing, as many as the overlap allows, or the heaviest; each is replaced by one of weight ``other``, the most
    that any shingle weighs.
    """
    total, square = weights.sum(), (weights**2).sum()
    least = 1.0
    for missing in (np.sort(weights), np.sort(weights)[::-1]):
        n = int(np.searchsorted(np.cumsum(missing), (1 - SIMILAR) * total + 1e-9, side="right"))
        shared = square - (missing[:n] ** 2).sum()
        least = min(least, shared / math.sqrt(square * (shared + n * other**2))) if shared > 0 else 0.0
    p = math.acos(max(0.0, min(1.0, least))) / math.pi
    return min(BITS, math.ceil(BITS * p + ROOM * math.sqrt(BITS * p * (1 - p))))


def build_index(items: list[tuple[object, np.ndarray]], rarity: dict[int, float]) -> Index:
    kept = [(i, codes) for i, codes in items if len(codes)]
    grams = [shingles_of(codes) for _, codes in kept]
    shingle = np.unique(np.concatenate(grams)) if kept else np.zeros(0, np.uint64)
    weight = np.array([rarity[int(s)] for s in shingle])
    width = np.zeros(len(shingle), dtype=np.int64)
    pairs, prints, totals, counts, reach = [], [], [], [], []
    for n, ((_, codes), g) in enumerate(zip(kept, grams, strict=True)):
        at = np.searchsorted(shingle, g)
        width[at] = min(SHINGLE, len(codes))
        pairs.append(np.stack([at, np.full(len(at), n)], 1))
        prints.append(_packed((_signs(g) * weight[at][:, None]).sum(0, keepdims=True))[0])
        totals.append(weight[at].sum())
        some, c = np.unique(at, return_counts=True)
        counts.append(dict(zip(some.tolist(), c.tolist(), strict=True)))
        reach.append(radius_of(weight[some] * c, float(weight.max())))
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    fingerprint = np.array(prints, dtype=np.uint8).reshape(-1, BLOCKS)
    radius = np.array(reach, dtype=np.int64)
    value = np.arange(256, dtype=np.uint8)
    near = np.bitwise_count(value[:, None, None] ^ fingerprint.T[None]) <= radius // BLOCKS  # value, block, item
    table = np.packbits(near.transpose(1, 0, 2), axis=2)
    return Index(
        [i for i, _ in kept],
        np.array([len(c) for _, c in kept], dtype=np.int64),
        np.array(totals),
        shingle,
        weight,
        width,
        pairs[:, 1],
        np.searchsorted(pairs[:, 0], np.arange(len(shingle) + 1)),
        fingerprint,
        radius,
        table,
        counts,
    )


def within_radius(index: Index, prints: np.ndarray) -> np.ndarray:
    """(window, item) pairs no further apart than the item's radius, by the block index."""
    out = []
    for start in range(0, len(prints), 4096):
        part = prints[start : start + 4096]
        maybe = index.table[0][part[:, 0]]
        for b in range(1, BLOCKS):
            maybe |= index.table[b][part[:, b]]
        w, i = np.nonzero(np.unpackbits(maybe, axis=1, count=len(index.ids)))
        near = np.bitwise_count(part[w] ^ index.fingerprint[i]).sum(1) <= index.radius[i]
        out.append(np.stack([w[near] + start, i[near]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def search(index: Index, codes: np.ndarray) -> list[tuple[int, float, int, int]]:
    """The items found in one document: (item, similarity, first word, word after the last), best window each."""
    if not len(index.ids) or not len(codes):
        return []
    hits = []  # place, shingle
    for width in np.unique(index.width):
        got = shingle_codes(codes, int(width))
        at = np.minimum(np.searchsorted(index.shingle, got), len(index.shingle) - 1)
        place = np.flatnonzero((index.shingle[at] == got) & (index.width[at] == width))
        hits.append(np.stack([place, at[place]], 1))
    hits = np.concatenate(hits)
    if not len(hits):
        return []
    # Windows of the sizes of the items that hold the shingle, wherever they cover it.
    wanted = set()
    for place, s in hits.tolist():
        for item in index.holder[index.holder_at[s] : index.holder_at[s + 1]].tolist():
            wanted.add((int(index.words[item]), place, int(index.width[s])))
    windows: dict[int, set[int]] = {}
    for size, place, width in wanted:
        low, high = place + width - size, place
        last = max(0, len(codes) - size)
        windows.setdefault(size, set()).update(range(max(0, low), max(0, min(high, last)) + 1))
    best: dict[int, tuple[float, int, int]] = {}
    for size, starts in sorted(windows.items()):
        width = min(SHINGLE, size)
        first = np.array(sorted(starts))
        base, grams = int(first[0]), shingle_codes(codes[first[0] : first[-1] + size], width)
        at = np.minimum(np.searchsorted(index.shingle, grams), len(index.shingle) - 1)
        known = index.shingle[at] == grams
        # Words that no item has weigh as much as a shingle of one item.
        weight = np.where(known, index.weight[at], index.weight.max())
        run = np.concatenate([np.zeros((1, BITS)), np.cumsum(_signs(grams) * weight[:, None], 0)])
        ends = np.minimum(first - base + size - width + 1, len(grams))
        prints = _packed(run[ends] - run[first - base])
        for w, near in itertools.groupby(within_radius(index, prints).tolist(), key=lambda pair: pair[0]):
            place = at[first[w] - base : ends[w]][known[first[w] - base : ends[w]]]
            some, c = np.unique(place, return_counts=True)
            there = list(zip(some.tolist(), c.tolist(), strict=True))
            # What shares no shingle has no overlap.
            holders = {i for s in some for i in index.holder[index.holder_at[s] : index.holder_at[s + 1]].tolist()}
            for item in (i for _, i in near if i in holders and index.words[i] == size):
                mine = index.counts[item]
                shared = sum(index.weight[s] * min(k, mine[s]) for s, k in there if s in mine)
                similar = shared / index.total[item]
                if similar >= SIMILAR - 1e-9 and similar > best.get(item, (0.0,))[0] + 1e-12:
                    best[item] = (float(min(1.0, similar)), int(first[w]), int(first[w]) + size)
    return [(i, *found) for i, found in sorted(best.items())]


def shingle_rarity(benchmark: DataFrame) -> DataFrame:
    """Each shingle of the items with ``weight`` = 1 + ln(items / items that hold it)."""

    def run(batches):
        for batch in slices(batches, "text"):
            codes, bounds = word_codes(batch.column("text"))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                some = np.unique(shingles_of(codes[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64))], ["shingle"])

    held = benchmark.select(text_of().alias("text")).mapInArrow(run, "shingle bigint")
    return held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))


def passes(benchmark: DataFrame, pass_words: int = PASS_WORDS) -> list[Index]:
    """The items in parts of bounded size, one index each. Only one part is at the driver at a time."""
    items = saved(benchmark.select("item_id", text_of().alias("text")), "items").withColumn("n", F.size(F.split("text", r"\s+")))
    head = items.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).head()
    parts = max(1, math.ceil(head["words"] / pass_words))
    held = saved(shingle_rarity(items), "rarity")
    for part in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").select("item_id", "text").toArrow()
        codes, bounds = word_codes(mine.column("text").combine_chunks())
        rows = list(zip(mine.column("item_id").to_pylist(), (codes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)), strict=True))
        some = shingle_rarity(benchmark.sparkSession.createDataFrame(mine)).select("shingle") if parts > 1 else None
        counts = (held if some is None else held.join(some, "shingle", "left_semi")).toArrow()
        n = {s & (2**64 - 1): c for s, c in zip(counts.column("shingle").to_pylist(), counts.column("n").to_pylist(), strict=True)}
        yield build_index(rows, {s: 1 + math.log(head["items"] / c) for s, c in n.items()})


def find_passages(docs: DataFrame, benchmark: DataFrame, *, pass_words: int = PASS_WORDS) -> DataFrame:
    """Every (doc_id, item_id) whose text holds a window like the item, with ``similarity`` and its words.

    ``similarity`` is the weight of the item's shingles that the best window holds, as a share of the item's
    weight: 0.8 or more. ``first_word`` and ``end_word`` are places among the words with letters or digits.
    Null and empty texts and items match nothing; repeated rows each count; an empty benchmark gives no rows.
    Other columns are left out. The benchmark is the query set: it is held in parts of ``pass_words`` words
    (at most one item more), and each part is a pass over all documents, without a shuffle.
    """
    spark = docs.sparkSession
    types = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    names = ["doc_id", "item_id", "similarity", "first_word", "end_word"]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = None
    for index in passes(benchmark, pass_words):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in slices(batches, "text"):
                rows = [(n, shared.value.ids[item], *rest) for n, found in _found(shared.value, batch.column("text")) for item, *rest in found]
                if rows:
                    n, *columns = zip(*rows, strict=True)
                    ids = batch.column("doc_id").take(pa.array(n))
                    yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names)

        part = texts.mapInArrow(run, f"{types}, similarity double, first_word bigint, end_word bigint")
        out = part if out is None else out.unionByName(part)
    return out


def _found(index: Index, texts: pa.Array):
    """(row, items found) of the rows that hold a shingle of some item."""
    if not len(index.ids):
        return
    codes, bounds = word_codes(texts)
    hit = np.zeros(len(codes), dtype=bool)
    marks = np.zeros(1 << 20, dtype=bool)
    marks[(index.shingle >> np.uint64(44)).astype(np.int64)] = True
    for width in np.unique(index.width):
        got = shingle_codes(codes, int(width))
        maybe = np.flatnonzero(marks[(got >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(index.shingle, got[maybe]), len(index.shingle) - 1)
        hit[maybe[index.shingle[at] == got[maybe]]] = True
    rows = np.unique(np.searchsorted(bounds, np.flatnonzero(hit), side="right") - 1)
    for n in rows.tolist():
        found = search(index, codes[bounds[n] : bounds[n + 1]])
        if found:
            yield n, found


def without_passages(docs: DataFrame, benchmark: DataFrame, *, pass_words: int = PASS_WORDS) -> DataFrame:
    """The rows of ``docs`` whose text holds no passage of the benchmark. Columns stay as they are."""
    spark = docs.sparkSession
    for index in passes(benchmark, pass_words):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in slices(batches, "text"):
                keep = np.ones(batch.num_rows, dtype=bool)
                for n, _ in _found(shared.value, batch.column("text")):
                    keep[n] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
