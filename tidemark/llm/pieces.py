"""Encoding and decoding by a byte-pair vocabulary of pieces: vectorised merge rounds.

A text is cut wherever no piece holds the two letters on both sides of the place, which no merge can cross.
Each distinct stretch of a slice of texts is merged once. All stretches lie in flat arrays of symbols. A round
finds the best ranked pair of neighbours in each stretch, merges its places from the left at once, closes the
gaps and lets go of stretches without a pair, until none is left.

Merging all places of a pair at once equals merging them one after the other unless the new piece takes part
in a pair of the same or a better rank, which would come in between. Such ranks are known from the vocabulary:
of them only the leftmost place is merged in a round.
"""

from __future__ import annotations

import codecs
import dataclasses
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, list_slices, slices, whole

MARK = "▁"
NONE = np.int64(2**62)
#: Longer stretches whose places have to be merged one by one leave the rounds for a heap.
ONE_BY_ONE = 256
FILTER_BITS = 22
#: Bytes of text encoded at once (whole rows).
SLICE_BYTES = 2_000_000


@dataclasses.dataclass(frozen=True)
class Model:
    pieces: list[bytes]  # what each id decodes to; nothing for control ids
    opens: np.ndarray  # whether the piece begins with the word mark
    control: np.ndarray
    is_byte: np.ndarray
    byte_id: np.ndarray  # the id of each of the 256 bytes
    letter: np.ndarray  # by code point: the letter's number among the pieces' letters, 0 if in none
    letter_id: np.ndarray  # by letter: the id of the piece that is this letter, or -1
    joined: np.ndarray  # by two letters: whether some piece holds them side by side
    pair: np.ndarray  # sorted (left id, right id) codes of all pairs that make a piece
    made: np.ndarray  # the piece each makes
    filter: np.ndarray  # marks of the pairs' hashes
    rank: np.ndarray  # by id, 0 is best; equal scores share a rank
    early: np.ndarray  # by rank: a piece of it can be part of a pair of this rank or a better one
    end_id: int


def _slot(pair: np.ndarray) -> np.ndarray:
    return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def load_model(path: str) -> Model:
    """The byte-pair model in a vocabulary file that leaves texts as they are but for a word mark in front.

    A model with other rules for its texts, or without pieces for single bytes, is an error.
    """
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_file=path)
    n = read.get_piece_size()
    ids = range(n)
    if read.normalize("  Aﬁ①  b ") != "▁▁▁Aﬁ①▁▁b▁" or sum(map(read.is_byte, ids)) != 256:
        raise ValueError(f"{path}: texts are changed by other rules, or bytes have no pieces")
    text = [read.id_to_piece(i) for i in ids]
    special = [read.is_control(i) or read.is_unknown(i) or read.is_byte(i) or read.is_unused(i) for i in ids]
    plain = {text[i]: i for i in ids if not special[i]}
    scores = {i: read.get_score(i) for i in plain.values()}
    order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
    rank = np.full(n, NONE)
    for i, s in scores.items():
        rank[i] = order[s]
    letters = sorted({c for p in plain for c in p})
    number = {c: k + 1 for k, c in enumerate(letters)}
    letter = np.zeros(0x110000, dtype=np.int32)
    letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    letter[ord(" ")] = number.get(MARK, 0)
    joined = np.zeros((len(letters) + 1, len(letters) + 1), dtype=bool)
    early = np.zeros(len(order), dtype=bool)
    made = {}
    for p, i in plain.items():
        for k in range(1, len(p)):
            joined[number[p[k - 1]], number[p[k]]] = True
            left, right = plain.get(p[:k]), plain.get(p[k:])
            if left is not None and right is not None:
                made[left * n + right] = i
                for part in (left, right):
                    early[rank[part]] |= len(text[part]) > 1 and rank[i] <= rank[part]
    pair = np.array(sorted(made), dtype=np.int64)
    marks = np.zeros(1 << FILTER_BITS, dtype=bool)
    marks[_slot(pair)] = True
    is_byte = np.array([read.is_byte(i) for i in ids])
    byte_id = np.zeros(256, dtype=np.int64)
    byte_id[[int(text[i][3:-1], 16) for i in np.flatnonzero(is_byte)]] = np.flatnonzero(is_byte)

    def shown(i: int) -> bytes:
        if read.is_control(i):
            return b""
        if read.is_byte(i):
            return bytes([int(text[i][3:-1], 16)])
        return read.decode([i]).encode() if read.is_unknown(i) else text[i].replace(MARK, " ").encode()

    return Model(
        [shown(i) for i in ids],
        np.array([t.startswith(MARK) for t in text]),
        np.array([read.is_control(i) for i in ids]),
        is_byte,
        byte_id,
        letter,
        np.array([-1, *(plain.get(c, -1) for c in letters)], dtype=np.int64),
        joined,
        pair,
        np.array([made[p] for p in pair.tolist()], dtype=np.int64),
        marks,
        rank,
        early,
        read.eos_id(),
    )


# --- merging --------------------------------------------------------------------------------------


def _pairs(model: Model, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The pieces that neighbours make, -1 for none. Symbols beyond the ids stand for letters without a piece."""
    n = len(model.pieces)
    out = np.full(len(left), -1, dtype=np.int64)
    code = left * n + right
    maybe = np.flatnonzero((left < n) & (right < n) & model.filter[_slot(code)])
    if len(maybe) and len(model.pair):
        at = np.minimum(np.searchsorted(model.pair, code[maybe]), len(model.pair) - 1)
        found = model.pair[at] == code[maybe]
        out[maybe[found]] = model.made[at[found]]
    return out


def _one_by_one(model: Model, symbols: list[int]) -> list[int]:
    """The same merges on one stretch, each best and leftmost pair in turn, by a heap."""
    n, last = len(model.pieces), len(symbols)
    after, before = list(range(1, last + 1)), list(range(-1, last - 1))
    made = dict(zip(model.pair.tolist(), model.made.tolist(), strict=True))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < last and symbols[i] < n and symbols[j] < n:
            piece = made.get(symbols[i] * n + symbols[j])
            if piece is not None:
                heapq.heappush(heap, (int(model.rank[piece]), i, symbols[i], symbols[j], piece))

    for i in range(last - 1):
        offer(i, i + 1)
    while heap:
        _, i, left, right, piece = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= last or symbols[j] != right:
            continue
        symbols[i], symbols[j], after[i] = piece, -1, after[j]
        if after[j] < last:
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [s for s in symbols if s >= 0]


def merge_rounds(model: Model, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``symbols`` between ``bounds`` after all merges, and their new bounds."""
    word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    made = np.full(len(symbols), -1, dtype=np.int64)
    if len(symbols):
        made[:-1] = np.where(word[1:] == word[:-1], _pairs(model, symbols[:-1], symbols[1:]), -1)
    rank = np.where(made >= 0, model.rank[made], NONE)
    done_words, done_symbols = [], []
    while len(symbols):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(word)))
        best = np.minimum.reduceat(rank, first)
        alive = best < NONE
        if not alive.all():
            stay = np.repeat(alive, size)
            done_words.append(word[~stay])
            done_symbols.append(symbols[~stay])
            symbols, word, made, rank = symbols[stay], word[stay], made[stay], rank[stay]
            if not len(symbols):
                break
            size, best = size[alive], best[alive]
            first = np.cumsum(size) - size
        hit = np.flatnonzero(rank == np.repeat(best, size))
        # Of touching places every other one, from the left.
        run = np.concatenate([[True], np.diff(hit) > 1])
        head = np.flatnonzero(run)
        hit = hit[(np.arange(len(hit)) - np.repeat(head, np.diff(np.append(head, len(hit))))) % 2 == 0]
        mine = np.searchsorted(first, hit, side="right") - 1
        leftmost = np.concatenate([[True], mine[1:] != mine[:-1]])
        single = model.early[best[mine]]
        if (single & ~leftmost).any():
            large = np.unique(mine[single & ~leftmost & (size[mine] > ONE_BY_ONE)])
            for w in large.tolist():
                rest = _one_by_one(model, symbols[first[w] : first[w] + size[w]].tolist())
                done_words.append(np.full(len(rest), word[first[w]]))
                done_symbols.append(np.array(rest, dtype=np.int64))
            ok = (~single | leftmost) & ~np.isin(mine, large)
            hit = hit[ok]
        else:
            large = np.zeros(0, dtype=np.int64)
        symbols[hit] = made[hit]
        keep = np.ones(len(symbols), dtype=bool)
        keep[hit + 1] = False
        for w in large.tolist():
            keep[first[w] : first[w] + size[w]] = False
        place = np.cumsum(keep) - 1
        at = place[hit]
        symbols, word, made, rank = symbols[keep], word[keep], made[keep], rank[keep]
        # Only pairs beside a merged place are new.
        beside = np.zeros(len(symbols) + 1, dtype=bool)
        beside[at] = beside[at - 1] = True
        new = np.flatnonzero(beside[:-1])
        inner = new[(new + 1 < len(symbols))]
        inner = inner[word[inner + 1] == word[inner]] if len(inner) else inner
        made[new], rank[new] = -1, NONE
        made[inner] = _pairs(model, symbols[inner], symbols[inner + 1])
        rank[inner] = np.where(made[inner] >= 0, model.rank[made[inner]], NONE)
    words = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
    out = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
    order = np.argsort(words, kind="stable")
    return out[order], np.searchsorted(words[order], np.arange(len(bounds)))


def _as_bytes(model: Model, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters without a piece become the ids of their bytes."""
    n = len(model.pieces)
    strange = np.flatnonzero(symbols >= n)
    if not len(strange):
        return symbols, bounds
    spelt = [chr(c).encode() for c in (symbols[strange] - n).tolist()]
    times = np.ones(len(symbols), dtype=np.int64)
    times[strange] = list(map(len, spelt))
    out = np.repeat(symbols, times)
    out[out >= n] = model.byte_id[np.frombuffer(b"".join(spelt), dtype=np.uint8)]
    return out, np.concatenate([[0], np.cumsum(times)])[bounds]


def stretches(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of the stretches of these lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of texts without nulls: all code points, each one's byte offset (one more at the end), the texts' bounds among them, the bytes."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = bytes(data[int(ends[0]) : int(ends[-1])]) if data is not None else b""
    points = np.frombuffer(held.decode().encode("utf-32-le"), dtype=np.uint32)
    size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return points, at, np.searchsorted(at, ends - ends[0]), held


def parts_of(held: bytes, starts: np.ndarray) -> pa.DictionaryArray:
    """The stretches of the bytes that begin at ``starts`` (the first at 0), each distinct one once."""
    offsets = np.append(starts, len(held)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(held)).dictionary_encode()


def gather(flat: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``which`` of ``flat`` one after the other, and their bounds."""
    taken = pa.LargeListArray.from_arrays(pa.array(bounds.astype(np.int64)), pa.array(flat)).take(pa.array(which))
    return np.asarray(taken.flatten()), np.asarray(taken.offsets).astype(np.int64)


def spelt(tokens: list[bytes], ids: np.ndarray) -> np.ndarray:
    """The bytes of the tokens one after the other."""
    data = pa.array(tokens, pa.large_binary()).take(pa.array(ids)).buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def encode(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row without the end id, and each text's bounds among them; null is empty."""
    texts = whole(texts)
    texts = pa.compute.replace_substring(texts, MARK, " ")
    marked = pa.compute.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    points, at, bounds, held = code_points(pa.compute.if_else(pa.compute.equal(texts, ""), texts, marked))
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    letter = model.letter[points]
    cut = np.ones(len(points), dtype=bool)
    cut[1:] = ~model.joined[letter[:-1], letter[1:]]
    cut[bounds[:-1][bounds[:-1] < len(points)]] = True
    starts = np.flatnonzero(cut)
    coded = parts_of(held, at[starts])
    flat, _, ends, _ = code_points(coded.dictionary)
    own = model.letter_id[model.letter[flat]]
    symbols = np.where(own >= 0, own, flat.astype(np.int64) + len(model.pieces))
    ids, inner = _as_bytes(model, *merge_rounds(model, symbols, ends))
    out, word_bounds = gather(ids, inner, np.asarray(coded.indices))
    return out, word_bounds[np.searchsorted(starts, bounds)]


def encode_texts(docs: DataFrame, model: Model, *, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: its id and ``ids``, the ids of the whole text with the end id after them.

    A null or empty text has the end id alone. Null and repeated row ids are kept; other columns are left out.
    Nothing is shuffled; a task holds a slice of whole texts. A stretch that has no safe cut and no blank takes
    as many rounds as it has different pairs, so its time grows with its length times that.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, bounds = encode(shared.value, batch.column("text"))
            ends = np.insert(ids, bounds[1:], shared.value.end_id).astype(np.int32)
            offsets = (bounds + np.arange(len(bounds))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ends))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


# --- decoding -------------------------------------------------------------------------------------

codecs.register_error("tidemark-each-byte", lambda e: ("�", e.start + 1))


def decode(model: Model, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The texts of the stretches of ``ids``: pieces joined, the first one's word mark gone, bytes that spell nothing as U+FFFD each."""
    sizes = np.array(list(map(len, model.pieces)), dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])
    row = ends[bounds]
    seen = np.flatnonzero(~model.control[ids])
    begin = row[:-1].copy()
    if len(seen):
        first = np.minimum(np.searchsorted(seen, bounds[:-1]), len(seen) - 1)
        there = (seen[first] >= bounds[:-1]) & (seen[first] < bounds[1:])
        begin += there & model.opens[ids[seen[first]]]
    held = spelt(model.pieces, ids).tobytes()[: ends[-1]]
    out = [held[a:b].decode(errors="tidemark-each-byte") for a, b in zip(begin.tolist(), row[1:].tolist(), strict=True)]
    # Bytes on the two sides of a control id do not spell a letter together.
    parted = np.flatnonzero(model.control[ids[1:-1]] & model.is_byte[ids[:-2]] | model.control[ids[1:-1]] & model.control[ids[:-2]]) + 1
    for n in np.unique(np.searchsorted(bounds, parted, side="right") - 1).tolist():
        controls = np.flatnonzero(model.control[ids[bounds[n] : bounds[n + 1]]]) + bounds[n]
        cuts = [int(begin[n]), *np.maximum(ends[controls], begin[n]).tolist(), int(row[n + 1])]
        out[n] = "".join(held[a:b].decode(errors="tidemark-each-byte") for a, b in zip(cuts, cuts[1:], strict=False))
    return out


def decode_ids(encoded: DataFrame, model: Model, *, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text that its ids stand for, in place of the ids.

    Null ids give null, no ids an empty text; control ids show nothing. An id outside the vocabulary, or a null
    among the ids, is an error. A column named ``decoded`` that is there already gives way by another name.
    """
    kept = [c for c in encoded.columns if c != ids_col]
    name = fresh(encoded.select(kept), "decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    at = encoded.columns.index(ids_col)
    others = [k for k in range(len(encoded.columns)) if k != at]
    size = len(model.pieces)

    def run(batches):
        for batch in batches:
            for part in list_slices(batch, ids_col):
                yield decoded(part)

    def decoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(at)
        values = lists.flatten()
        counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if values.null_count or (len(values) and not 0 <= pa.compute.min(values).as_py() <= pa.compute.max(values).as_py() < size):
            raise ValueError(f"an id is null or not below {size}")
        texts = pa.array(decode(shared.value, np.asarray(values).astype(np.int64), bounds), pa.string())
        texts = pa.compute.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in others), texts], [*kept, name])

    types = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept)
    return encoded.mapInArrow(run, f"{types}{', ' if types else ''}`{name}` string")
