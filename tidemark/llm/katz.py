"""Katz backoff scores of whole texts.

Counts are discounted by Good-Turing, what the discounts free is left to the shorter history, and backoff
weights are normalised exactly: for every history the probabilities of all known words and of the unknown
word sum to one. A token's probability is that of its pair if training saw it, else the history's backoff
weight times that of the word, else that of the unknown word.

Texts are coded in slices of some megabytes, saved once. Each slice asks for its distinct words, pairs and
histories; the keys go to their range of the key space, are summed there over all slices, and each slice is
told the sums. These tables (words, pairs, histories), partitioned by key range, are the model. Words and
pairs are named by 64-bit hashes; with n distinct names two are equal with probability about n * n / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import flat_words, give_back, remainder, row_sums, saved, slices

END, START = 1, 2
#: Counts above this are not discounted.
TRUSTED = 5
#: Bytes of text of a slice, and keys of a range (all slices together).
SLICE_BYTES, RANGE_KEYS = 8_000_000, 1_000_000

CODED = "slice bigint, doc_ids array<{}>, train array<boolean>, sizes array<int>, names binary, code binary, n_names bigint, n_tokens bigint"
ASKED = "part bigint, slice bigint, keys binary, addends binary"
TOLD = "part bigint, slice bigint, sums binary, first binary, tops array<bigint>"


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed, the bytes of equal weight of all numbers together."""
    flat = np.ascontiguousarray(numbers).reshape(-1)
    return zstandard.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, flat.itemsize).T).tobytes(), 1)


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def coded_slices(docs: DataFrame) -> DataFrame:
    """Slices of ``docs``: ids, training marks, tokens of each text (end included), names of words, tokens as places in them."""

    def run(batches):
        seen = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", SLICE_BYTES):
            words, bounds = flat_words(batch.column("text"))
            n = np.diff(bounds)
            coded = words.dictionary_encode()
            order = np.argsort(-np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)), kind="stable")
            place = np.empty(len(order), dtype=np.uint32)
            place[order] = np.arange(2, len(order) + 2)
            names = [xxhash.xxh64_intdigest(w) for w in coded.dictionary.take(pa.array(order)).to_pylist()]
            code = np.zeros(len(words) + len(n), dtype=np.uint32)
            code[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = place[np.asarray(coded.indices)]
            row = {
                "slice": seen, "doc_ids": batch.column("doc_id").to_pylist(), "train": batch.column("train").to_pylist(), "sizes": (n + 1).tolist(),
                "names": _packed(np.array([END, START, *names], dtype=np.uint64)), "code": _packed(code), "n_names": len(names) + 2, "n_tokens": len(code),
            }
            yield pa.RecordBatch.from_pydict({k: pa.array([v], _type(k, batch)) for k, v in row.items()})
            seen += 1
            del row, code, names, words, bounds, coded, order, place
            give_back()

    def _type(name, batch):
        kinds = {"doc_ids": pa.list_(batch.schema.field("doc_id").type), "train": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32()), "names": pa.binary(), "code": pa.binary()}
        return kinds.get(name, pa.int64())

    sent = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce("train", F.lit(False)).alias("train"))
    return sent.mapInArrow(run, CODED.format(docs.schema["doc_id"].dataType.simpleString()))


class Slice:
    """A coded slice opened: its words and pairs as sorted distinct keys, and the places of its tokens in them."""

    def __init__(self, row: dict):
        self.id, self.doc_ids, self.train = row["slice"], row["doc_ids"], row["train"]
        names = _unpacked(row["names"], np.uint64)
        self.words, at = np.unique(names, return_inverse=True)
        at = at.astype(np.int32)
        size = np.asarray(row["sizes"], dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(size)])
        code = _unpacked(row["code"], np.uint32)
        history = np.roll(code, 1)
        history[self.bounds[:-1]] = 1
        self.word, self.history = at[code], at[history]
        self.start, self.end = at[1], at[0]

    def learned(self) -> np.ndarray:
        return np.repeat(np.asarray(self.train, dtype=np.float64), np.diff(self.bounds))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the distinct pairs, a token of each, and the pair of each token."""
        key = self.words[self.history] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.word]
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
        order = np.argsort(key)
        key = key[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.empty(len(key), dtype=np.int32)
        at[order] = np.cumsum(fresh, dtype=np.int32) - 1
        return key[fresh], order[fresh], at


def _asked(at: int, keys: np.ndarray, addends: np.ndarray, parts: int):
    """A row for each key range that the sorted ``keys`` of slice ``at`` meet; ``addends`` has a column for each key."""
    step = 2**64 // parts + 1
    cuts = [0, *np.searchsorted(keys, np.array([i * step for i in range(1, parts)], dtype=np.uint64)).tolist(), len(keys)]
    rows = [
        {"part": i, "slice": at, "keys": _packed(np.diff(keys[a:b], prepend=np.uint64(0))), "addends": _packed(addends[:, a:b])}
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
        if a < b
    ]
    return pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("keys", pa.binary()), ("addends", pa.binary())]))


def tally(asked: DataFrame, kind: type) -> DataFrame:
    """Sums over all slices, told to each slice in the order of its keys.

    ``first`` marks the key in one of the slices that add to it, so that a pass over the slices meets each key once;
    ``tops`` has of these keys how many have a sum of 1, 2, ... TRUSTED + 1, how many there are, and their whole sum.
    """

    def summed(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["slice"])
        keys = [np.cumsum(_unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
        addends = np.concatenate([_unpacked(r["addends"], kind).reshape(-1, len(k)) for r, k in zip(rows, keys, strict=True)], axis=1)
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.stack([np.bincount(at, weights=a)[at] for a in addends]).astype(kind)
        adding = np.flatnonzero(addends[0] > 0)
        first = np.zeros(len(at), dtype=bool)
        first[adding[np.unique(at[adding], return_index=True)[1]]] = True
        told, start = [], 0
        for r, k in zip(rows, keys, strict=True):
            s, f = sums[:, start : start + len(k)], first[start : start + len(k)]
            own = s[0][f].astype(np.int64)
            tops = [*np.bincount(np.minimum(own, TRUSTED + 2), minlength=TRUSTED + 3)[1 : TRUSTED + 2].tolist(), len(own), int(own.sum())]
            told.append({"part": r["part"], "slice": r["slice"], "sums": _packed(s), "first": _packed(f), "tops": tops})
            start += len(k)
        return pa.Table.from_pylist(told, pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("sums", pa.binary()), ("first", pa.binary()), ("tops", pa.list_(pa.int64()))]))

    def run(group: pa.Table) -> pa.Table:
        told = summed(group)
        give_back()
        return told

    return asked.groupBy("part").applyInArrow(run, TOLD)


def _totals(told: DataFrame) -> tuple[dict[int, int], int, int]:
    """(how many keys have a sum of 1, 2, ... , number of keys, sum of all)."""
    sums = told.agg(*[F.coalesce(F.sum(F.col("tops")[i]), F.lit(0)) for i in range(TRUSTED + 3)]).head()
    return {r: int(sums[r - 1]) for r in range(1, TRUSTED + 2)}, int(sums[TRUSTED + 1]), int(sums[TRUSTED + 2])


def discounts(n: dict[int, int]) -> dict[int, float]:
    """Good-Turing discount of the counts 1 to TRUSTED, from how many words or pairs have each count.

    Where the numbers of counts give no discount between 0 and 1, half a count is taken off instead.
    """
    out = {}
    for r in range(1, TRUSTED + 1):
        d = 0.0
        if all(n.get(i) for i in (1, r, r + 1, TRUSTED + 1)):
            common = (TRUSTED + 1) * n[TRUSTED + 1] / n[1]
            if common < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(n: np.ndarray, d: dict[int, float]) -> np.ndarray:
    return n * np.array([0.0, *d.values(), 1.0])[np.minimum(n, TRUSTED + 1)]


def _told(df: DataFrame, told: DataFrame, name: str) -> DataFrame:
    """``df`` with what each slice was told, by key range."""
    blocks = F.sort_array(F.collect_list(F.struct("part", "sums", "first"))).alias(name)
    return df.join(told.groupBy("slice").agg(blocks), "slice")


def _sums(blocks: list[dict], kind: type, width: int = 1) -> np.ndarray:
    return np.concatenate([_unpacked(b["sums"], kind).reshape(width, -1) for b in blocks], axis=1)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            give_back()


def score(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    ``docs``: doc_id, text, ``train``. A null or empty text is the end alone. Null and repeated ids are kept,
    rows with a null ``train`` are not learned from; other columns are left out. With nothing to learn from,
    every token is unknown.
    """
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    coded = saved(coded_slices(docs), "katz-slices")
    n_names, n_tokens = (int(x) for x in coded.agg(F.coalesce(F.sum("n_names"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).head())
    few, many = n_names // RANGE_KEYS + 1, n_tokens // RANGE_KEYS + 1

    def ask_words(batches):
        for s in map(Slice, _rows(batches)):
            yield _asked(s.id, s.words, np.bincount(s.word, weights=s.learned(), minlength=len(s.words)).astype(np.int64)[None], few)

    def ask_pairs(batches):
        for s in map(Slice, _rows(batches)):
            keys, _, at = s.pairs()
            yield _asked(s.id, keys, np.bincount(at, weights=s.learned()).astype(np.int64)[None], many)

    words = saved(tally(coded.mapInArrow(ask_words, ASKED), np.int64), "katz-words")
    pairs = saved(tally(coded.mapInArrow(ask_pairs, ASKED), np.int64), "katz-pairs")
    n1, distinct, tokens = _totals(words)
    d1, d2 = discounts(n1), discounts(_totals(pairs)[0])
    kept1 = tokens - sum(r * n1[r] * (1 - d) for r, d in d1.items())
    # Without a discounted count nothing would be left for the unknown word; it then counts as half a token.
    total = tokens if kept1 < tokens else tokens + 0.5
    unknown = 1 - kept1 / total

    def p(c):
        return np.where(c > 0, discounted(c, d1) / total, unknown)

    def ask_histories(batches):
        for row in _rows(batches):
            s = Slice(row)
            c, n = _sums(row["words"], np.int64)[0], _sums(row["pairs"], np.int64)[0]
            own = np.flatnonzero(np.concatenate([_unpacked(b["first"], np.bool_) for b in row["pairs"]]))
            token = s.pairs()[1][own]
            addends = [np.bincount(s.history[token], weights=w, minlength=len(s.words)) for w in (discounted(n[own], d2), p(c[s.word[token]]))]
            yield _asked(s.id, s.words, np.stack(addends), few)

    known = _told(_told(coded, words, "words"), pairs, "pairs")
    histories = saved(tally(known.mapInArrow(ask_histories, ASKED), np.float64), "katz-histories")

    def run(batches):
        for row in _rows(batches):
            s = Slice(row)
            c, n = _sums(row["words"], np.int64)[0], _sums(row["pairs"], np.int64)[0]
            kept, lower = _sums(row["histories"], np.float64, 2)
            # A history occurs as often as its word, the start as often as the end.
            times = c.astype(np.float64)
            times[s.start] = c[s.end]
            # A history none of whose counts is discounted leaves half a token, so that unseen words stay possible.
            times = np.maximum(np.where(kept >= times - 1e-9, times + 0.5, times), 0.5)
            # What is left for unseen words, over what the shorter history gives them; a history never seen backs off whole.
            alpha = np.where(kept > 0, (1 - kept / times) / np.maximum(1 - lower, 1e-12), 1.0)
            n = n[s.pairs()[2]]
            given = np.where(n > 0, discounted(n, d2) / times[s.history], alpha[s.history] * p(c)[s.word])
            base = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))[s.word]
            size = np.diff(s.bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s.doc_ids, id_type), pa.array(s.train, pa.bool_()), pa.array(size),
                    pa.array(row_sums(c[s.word] > 0, s.bounds).astype(np.int64)), pa.array(np.full(len(size), tokens, dtype=np.int64)),
                    pa.array(row_sums(base, s.bounds)), pa.array(row_sums(np.log10(given), s.bounds)),
                ],
                ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = f"doc_id {kind.simpleString()}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return _told(known, histories, "histories").mapInArrow(run, schema)


def training(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", (remainder(F.col("doc_id"), 5) != 1).alias("train"))
