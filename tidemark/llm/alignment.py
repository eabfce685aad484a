"""Alignment of two tokenizers over the same bytes: for each token start, the other side's token that covers it.

Both sides cut a blank and the text into tokens whose bytes join to the same bytes. Token starts of a batch of
texts, keyed by text, go through ``merge_asof`` in both directions: the last start of the other side at or
before a start is that of the token which covers it. Two tokens overlap exactly if one of them covers the
other's start, so the union of both directions is the set of all overlaps. Overlaps whose tokens end together
close a group; they are the links.
"""

from __future__ import annotations

import dataclasses
import functools
import json
import os
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import pieces
from tidemark.llm.common import give_back, list_slices, saved, slices, whole

#: What some pattern engine may take for a blank; only between other letters is a text cut.
BLANKS = [c for c in range(0x110000) if chr(c).isspace()] + [0x180E, 0x200B, 0x2060, 0xFEFF]


_LIST = "array<int>"
COLUMNS = {
    "n_a": "bigint",
    "n_b": "bigint",
    "a_ids": _LIST,
    "b_ids": _LIST,
    "overlap_a": _LIST,
    "overlap_b": _LIST,
    "link_a": _LIST,
    "link_b": _LIST,
    "a_linked": _LIST,
    "b_linked": _LIST,
    "groups": "string",
}
SUMMED = ("n_a", "n_b", "a_linked", "b_linked", "groups")
#: Bytes of text aligned at once (whole rows).
SLICE_BYTES = 1_000_000
#: Bytes of the strings that the byte-level tokenizer gets, about.
JOINED_BYTES = 16_384
#: Parts whose ids a worker remembers from slice to slice, at most, and their letters.
KNOWN_PARTS = 300_000
KNOWN_LETTERS = 32


@dataclasses.dataclass(frozen=True)
class ByteLevel:
    """A byte-level vocabulary: its file's text, and the bytes of each id."""

    spec: str
    tokens: list[bytes]


def load_byte_level(path: str) -> ByteLevel:
    """The vocabulary in a tokenizer file. Special tokens stand for no bytes, as texts never hold them as such."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    held = json.loads(spec)
    if held["pre_tokenizer"]["type"] != "ByteLevel" or held["normalizer"] or not held["pre_tokenizer"].get("use_regex", True):
        raise ValueError(f"{path}: not a plain byte-level vocabulary")
    vocab = held["model"]["vocab"]
    # Bytes that print stand for themselves; the others, in order, for the letters from 256 on.
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    of = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}
    tokens = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in held["added_tokens"])]))
    for token, i in vocab.items():
        tokens[i] = bytes(of[c] for c in token)
    for t in held["added_tokens"]:
        tokens[t["id"]] = b""
    return ByteLevel(spec, tokens)


@functools.lru_cache(maxsize=2)
def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(spec)
    out.encode_special_tokens = True
    return out


@functools.lru_cache(maxsize=1)
def _blank() -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    out[BLANKS] = True
    return out


def encode_byte_level(side: ByteLevel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row and each text's bounds among them; null is empty.

    The pattern that cuts texts before merging never reaches over a place before a single blank between other
    letters, so the stretches between such places are encoded once each.
    """
    points, at, bounds, held = pieces.code_points(whole(texts))
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(len(bounds), dtype=np.int64)
    blank = _blank()[points]
    cut = np.zeros(len(points), dtype=bool)
    cut[1:-1] = (points[1:-1] == 0x20) & ~blank[:-2] & ~blank[2:]
    cut[bounds[:-1][bounds[:-1] < len(points)]] = True
    starts = np.flatnonzero(cut)
    coded = pieces.parts_of(held, at[starts])
    which = np.asarray(coded.indices)
    # A stretch of a single blank and other letters can stand beside its like in one string without a change.
    last = np.append(starts[1:], len(points)) - 1
    plain = np.zeros(len(coded.dictionary), dtype=bool)
    plain[which] = (last > starts) & ~blank[np.minimum(starts + 1, last)] & ~blank[last]
    ids, inner = _encode_parts(side, coded.dictionary, plain)
    out, part_bounds = pieces.gather(ids, inner, which)
    return out, part_bounds[np.searchsorted(starts, bounds)]


@functools.lru_cache(maxsize=2)
def _known(spec: str) -> dict[str, bytes]:
    """Ids of the short parts that this worker has met in earlier slices."""
    return {}


def _encode_parts(side: ByteLevel, parts: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each part in turn. The same words fill most slices, so only those not met lately are encoded."""
    names, known = parts.to_pylist(), _known(side.spec)
    coded = [known.get(name) for name in names]
    new = np.flatnonzero([ids is None for ids in coded])
    if len(new):
        ids, bounds = _encode_new(side, parts.take(pa.array(new)), plain[new])
        held, at = ids.astype(np.int32).tobytes(), (bounds * 4).tolist()
        for i, a, b in zip(new.tolist(), at, at[1:], strict=False):
            coded[i] = held[a:b]
        short = [i for i in new.tolist() if len(names[i]) <= KNOWN_LETTERS]
        if len(known) + len(short) > KNOWN_PARTS:
            known.clear()
        known.update((names[i], coded[i]) for i in short[:KNOWN_PARTS])
    upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4)])
    return np.frombuffer(b"".join(coded), dtype=np.int32).astype(np.int64), upto


def _encode_new(side: ByteLevel, parts: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each part in turn; the plain ones are joined to strings of some size and told apart by their bytes."""
    joined = parts.filter(pa.array(plain))
    ends = np.cumsum(np.asarray(pa.compute.binary_length(joined)))
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, JOINED_BYTES)[1:])) + 1
    held = "".join(joined.to_pylist()).encode()
    at = [0, *ends[cuts - 1].tolist(), len(held)]
    strings = [held[a:b].decode() for a, b in zip(at, at[1:], strict=False) if a < b]
    strings += parts.filter(pa.array(~plain)).to_pylist()
    found = [e.ids for e in _tokenizer(side.spec).encode_batch_fast(strings, add_special_tokens=False)]
    ids = np.concatenate([np.array(some, dtype=np.int64) for some in found])
    # Tokens in each part: the plain ones come first, then the others, and part ends are token ends.
    size = np.fromiter(map(len, side.tokens), dtype=np.int64, count=len(side.tokens))
    order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
    part_ends = np.cumsum(np.asarray(pa.compute.binary_length(parts))[order])
    upto = np.concatenate([[0], np.searchsorted(np.cumsum(size[ids]), part_ends, side="right")])
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return pieces.gather(ids, upto, place)


@dataclasses.dataclass(frozen=True)
class Side:
    ids: np.ndarray
    bounds: np.ndarray
    ends: np.ndarray  # of each token among the bytes of all texts

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends])[: len(self.ends)]

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def _kept(ids: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(bounds)
    return ids[np.repeat(keep, counts)], np.concatenate([[0], np.cumsum(counts * keep)])


def _spells(tokens: list[bytes], ids: np.ndarray, bounds: np.ndarray, held: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Whether each text's tokens join to its bytes."""
    size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.concatenate([[0], np.cumsum(size[ids])])[bounds]
    same = np.diff(ends) == np.diff(text_at)
    ids, bounds = _kept(ids, bounds, same)
    flat = pieces.spelt(tokens, ids)[: size[ids].sum()]
    theirs = held[np.repeat(same, np.diff(text_at))]
    wrong = np.flatnonzero(flat != theirs)
    at = np.concatenate([[0], np.cumsum(np.diff(text_at) * same)])
    same[np.searchsorted(at, wrong, side="right") - 1] = False
    return same


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens (their places among all) that share a byte, in order."""
    left = pd.DataFrame({"row": a.row, "start": a.starts, "a": np.arange(len(a.ids))})
    right = pd.DataFrame({"row": b.row, "start": b.starts, "b": np.arange(len(b.ids))})
    covers_a = pd.merge_asof(left, right, on="start", by="row")
    covers_b = pd.merge_asof(right, left, on="start", by="row")
    # Tokens that start together are found from both sides.
    covers_b = covers_b[a.starts[covers_b["a"].to_numpy()] != covers_b["start"].to_numpy()]
    over_a, over_b = (np.concatenate([covers_a[c].to_numpy(), covers_b[c].to_numpy()]).astype(np.int64) for c in ("a", "b"))
    order = np.argsort(over_a + over_b, kind="stable")  # along a text neither side goes back
    return over_a[order], over_b[order]


@functools.lru_cache(maxsize=4)
def _decimals(n: int, end: str) -> pa.Array:
    return pa.array([f"{i}{end}" for i in range(n)], pa.large_string())


def group_texts(a: Side, b: Side, link_a: np.ndarray, link_b: np.ndarray) -> pa.Array:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``: ids of both sides, in order."""
    n = 1 + int(max(a.ids.max(initial=0), b.ids.max(initial=0)))
    last_a, last_b = np.zeros(len(a.ids), dtype=bool), np.zeros(len(b.ids), dtype=bool)
    last_a[link_a], last_b[link_b] = True, True
    # Tokens of the other side before: of A, those in earlier groups; of B, those in groups up to its own.
    group_a = np.concatenate([[0], np.cumsum(last_a)[:-1]]) if len(a.ids) else np.zeros(0, np.int64)
    group_b = np.concatenate([[0], np.cumsum(last_b)[:-1]]) if len(b.ids) else np.zeros(0, np.int64)
    place = np.empty(len(a.ids) + len(b.ids), dtype=np.int64)
    upto_a, upto_b = link_a + 1, np.concatenate([[0], link_b + 1])
    order_a = np.arange(len(a.ids)) + upto_b[group_a]
    order_b = np.arange(len(b.ids)) + upto_a[group_b]
    final_b = np.zeros(len(b.ids), dtype=bool)
    final_b[b.bounds[1:][np.diff(b.bounds) > 0] - 1] = True
    place[order_a] = a.ids + n * last_a
    place[order_b] = b.ids + n * np.where(final_b, 3, np.where(last_b, 2, 0))
    kinds = pa.concat_arrays([_decimals(n, end) for end in (",", "|", ";", "")])
    flat = kinds.take(pa.array(place))
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[: len(flat) + 1][a.bounds + b.bounds].copy()
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data or pa.py_buffer(b""))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def align_batch(left: ByteLevel, right: pieces.Model, texts: pa.Array, wanted: Sequence[str] = tuple(COLUMNS)) -> dict[str, pa.Array]:
    texts = whole(texts)
    blank = pa.compute.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    spaced = pa.compute.if_else(pa.compute.equal(texts, ""), texts, blank)
    _, offsets, data = spaced.buffers()
    text_at = np.frombuffer(offsets, dtype=np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    held = np.frombuffer(data if data is not None else b"", dtype=np.uint8)[text_at[0] : text_at[-1]]
    text_at = text_at - text_at[0]
    sides = [(left.tokens, *encode_byte_level(left, spaced)), (right.pieces, *pieces.encode(right, texts))]
    same = np.diff(text_at) > 0
    for side in sides:
        same &= _spells(*side, held, text_at)
    out = []
    for tokens, ids, bounds in sides:
        ids, bounds = _kept(ids, bounds, same)
        size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        out.append(Side(ids, bounds, np.cumsum(size[ids])))
    a, b = out
    over_a, over_b = overlaps(a, b)
    link = a.ends[over_a] == b.ends[over_b]
    link_a, link_b = over_a[link], over_b[link]
    over_at = np.searchsorted(over_a, a.bounds)
    link_at = np.searchsorted(link_a, a.bounds)

    def places(side: Side, which: np.ndarray, at: np.ndarray) -> pa.Array:
        return _lists(which - np.repeat(side.bounds[:-1], np.diff(at)), at)

    made = {
        "n_a": lambda: pa.array(np.diff(a.bounds)),
        "n_b": lambda: pa.array(np.diff(b.bounds)),
        "a_ids": lambda: _lists(a.ids, a.bounds),
        "b_ids": lambda: _lists(b.ids, b.bounds),
        "overlap_a": lambda: places(a, over_a, over_at),
        "overlap_b": lambda: places(b, over_b, over_at),
        "link_a": lambda: places(a, link_a, link_at),
        "link_b": lambda: places(b, link_b, link_at),
        "a_linked": lambda: _lists(a.ids[link_a], link_at),
        "b_linked": lambda: _lists(b.ids[link_b], link_at),
        "groups": lambda: group_texts(a, b, link_a, link_b).cast(pa.string()),
    }
    return {c: made[c]() for c in wanted}


def align_texts(
    docs: DataFrame, left: ByteLevel, right: pieces.Model, *, id_col: str = "doc_id", columns: Sequence[str] = tuple(COLUMNS)
) -> DataFrame:
    """One row per input row: its id and both sides' tokens of a blank and the text, as far as ``columns`` asks.

    ``a_ids`` and ``b_ids`` are the ids, ``n_a`` and ``n_b`` of them; ``overlap_a[i]`` and ``overlap_b[i]`` the places
    (from 0) of two tokens that share bytes; ``link_a`` and ``link_b`` those that end together as well, the last
    tokens of each group, and ``a_linked`` and ``b_linked`` their ids; ``groups`` the ids group by group. A text that is null, empty or not spelt by both sides' tokens (one with
    the word mark in it) has no tokens. Null and repeated row ids are kept, other columns left out. Nothing is
    shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast((left, right))

    def run(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            found = align_batch(*shared.value, batch.column("text"), columns)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *found.values()], [id_col, *found])
            del found
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{c} {COLUMNS[c]}' for c in columns)}")


def pair_counts(linked: DataFrame) -> DataFrame:
    """How often each (a, b) of ids is linked in ``a_linked`` and ``b_linked`` of all rows.

    Linked tokens end together, so the bytes of one end with the other's: the vocabularies alone bound the
    pairs (by their tokens' lengths added up; 324,298 for the two that are installed), whatever the texts.
    """

    def run(batches):
        for batch in (part for whole_batch in batches for part in list_slices(whole_batch, "a_linked")):
            a, b = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in ("a_linked", "b_linked"))
            code, n = np.unique((a << 32) | b, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code >> 32), pa.array(code & (2**32 - 1)), pa.array(n)], ["a", "b", "n"])
            del a, b, code, n
            give_back()

    parts = linked.select("a_linked", "b_linked").mapInArrow(run, "a bigint, b bigint, n bigint")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"))


def summary(aligned: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per row of :func:`align_texts`: sizes, the groups' digest, and how usual its links are in all rows.

    Of its columns those in ``SUMMED`` are needed.

    ``n_best`` counts the links whose pair is the most frequent one of its B id, ties included; ``count_sum`` adds up
    the links' counts. Rows without tokens have zeros and an empty digest; an empty table gives no rows.
    """
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    kept = saved(
        aligned.select(
            id_col,
            "n_a",
            "n_b",
            digest.alias("groups_sha256"),
            "a_linked",
            "b_linked",
        ),
        "links",
    )
    counts = pair_counts(kept).toArrow()
    a, b, n = (counts.column(c).to_numpy() for c in ("a", "b", "n"))
    order = np.argsort(code := (a << 32) | b)
    most = np.zeros(int(b.max(initial=0)) + 1, dtype=np.int64)
    np.maximum.at(most, b, n)
    shared = kept.sparkSession.sparkContext.broadcast((code[order], n[order], most))
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches):
        codes, n, most = shared.value
        for batch in (part for whole_batch in batches for part in list_slices(whole_batch, "a_linked")):
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(batch.column("a_linked"))))]).astype(np.int64)
            a, b = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in ("a_linked", "b_linked"))
            some, inverse = np.unique((a << 32) | b, return_inverse=True)
            count = n[np.searchsorted(codes, some)][inverse]
            upto = np.concatenate([[0], np.cumsum(count)])
            best = np.concatenate([[0], np.cumsum(count == most[b])])
            links = pa.array(np.diff(bounds))
            sums = [pa.array(np.diff(x[bounds]).astype(np.int64)) for x in (best, upto)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), links, links, *sums, batch.column("groups_sha256")], names)
            del a, b, some, inverse, count, upto, best, sums
            give_back()

    kind = aligned.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{c} bigint' for c in names[1:-1])}, groups_sha256 string")
