"""Token counts: a trie of distinct pre-tokens, scored once per shared prefix.

A pre-token is a word between ASCII blanks, in the case it is written in, with the word mark before it. Its tokens are those of the best
segmentation under a unigram model over a given vocabulary. All distinct pre-tokens of a slice of texts go
into one trie, level by level; the best score of a prefix is found once from the scores of the shorter
prefixes on its path, however many pre-tokens share it. Each pre-token's count is the one at its last node.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat_words, slices

MARK = "▁"
#: Longer pre-tokens are scored by themselves, so that the trie's depth is bounded.
DEEPEST = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclasses.dataclass(frozen=True)
class Vocabulary:
    scores: dict[str, float]
    #: For each length: sorted hashes of its pieces, their scores, and marks of the hashes' upper bits.
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    byte_score: float


def vocabulary(pieces: list[str]) -> Vocabulary:
    """A unigram model over ``pieces`` in order of rank: shares follow Zipf's law, a byte of an unknown letter comes last."""
    norm = np.log(sum(1 / (r + 2) for r in range(len(pieces)))) if pieces else 0.0
    scores: dict[str, float] = {}
    for r, piece in enumerate(pieces):
        if piece:
            scores.setdefault(piece, float(-np.log(r + 2) - norm))
    lengths: dict[int, list[str]] = {}
    for piece in scores:
        lengths.setdefault(len(piece), []).append(piece)
    by_length = {}
    for n, some in sorted(lengths.items()):
        h = np.zeros(len(some), dtype=np.uint64)
        points = np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n)
        for i in range(n):
            h = h * BASE + points[:, i]
        order = np.argsort(h)
        marks = np.zeros(1 << 20, dtype=bool)
        marks[((h * MIX) >> np.uint64(44)).astype(np.int64)] = True
        by_length[n] = (h[order], np.array([scores[some[i]] for i in order]), marks)
    return Vocabulary(scores, by_length, float(-np.log(len(pieces) + 2) - norm - 10.0))


def load_pieces(path: str) -> list[str]:
    """The normal pieces of a vocabulary file in order of rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def _utf8_size(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


def count_one(vocab: Vocabulary, word: str) -> int:
    """Tokens of one pre-token, prefix by prefix; of equal scores, fewer tokens."""
    longest = max(vocab.by_length, default=1)
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode("utf-8", "surrogatepass"))
        score, n = best[end - 1]
        top = (score + size * vocab.byte_score, n - size)
        for start in range(max(0, end - longest), end):
            s = vocab.scores.get(word[start:end])
            if s is not None:
                top = max(top, (best[start][0] + s, best[start][1] - 1))
        best.append(top)
    return -best[-1][1]


def count_words(vocab: Vocabulary, words: list[str]) -> np.ndarray:
    """Tokens of each of the distinct ``words`` (the mark not yet put before them)."""
    marked = [MARK + w for w in words]
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    out = np.zeros(len(marked), dtype=np.int64)
    for i in np.flatnonzero(lengths > DEEPEST):
        out[i] = count_one(vocab, marked[i])
    rows = np.flatnonzero(lengths <= DEEPEST)
    rows = rows[np.argsort(-lengths[rows], kind="stable")]  # those that end early come last
    if not len(rows):
        return out
    points = np.frombuffer("".join(marked[i] for i in rows).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    size = lengths[rows]
    first = np.cumsum(size) - size
    node = np.zeros(len(rows), dtype=np.int64)
    # Of each level: parent, hash of the prefix, best score, tokens. Level 0 is the root.
    levels = [(np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64))]
    for depth in range(1, int(size[0]) + 1):
        alive = int(np.searchsorted(-size, -depth, side="right"))
        char = points[first[:alive] + depth - 1]
        key, inverse = np.unique((node[:alive] << 21) | char, return_inverse=True)
        parent, char = key >> 21, key & ((1 << 21) - 1)
        above = levels[-1]
        code = above[1][parent] * BASE + char.astype(np.uint64)
        size_here = _utf8_size(char)
        best = above[2][parent] + size_here * vocab.byte_score
        tokens = above[3][parent] + size_here
        ancestor, power = np.arange(len(key)), np.ones(1, np.uint64)
        for n in range(1, depth + 1):
            ancestor = parent if n == 1 else levels[depth - n + 1][0][ancestor]
            power = power * BASE  # an array, which wraps around quietly
            if n not in vocab.by_length:
                if n > max(vocab.by_length, default=0):
                    break
                continue
            hashes, scores, marks = vocab.by_length[n]
            part = code - levels[depth - n][1][ancestor] * power
            maybe = np.flatnonzero(marks[((part * MIX) >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(hashes, part[maybe]), len(hashes) - 1)
            found = hashes[at] == part[maybe]
            maybe, at = maybe[found], at[found]
            s = levels[depth - n][2][ancestor[maybe]] + scores[at]
            t = levels[depth - n][3][ancestor[maybe]] + 1
            better = (s > best[maybe]) | ((s == best[maybe]) & (t < tokens[maybe]))
            best[maybe[better]], tokens[maybe[better]] = s[better], t[better]
        levels.append((parent, code, best, tokens))
        node[:alive] = inverse
        done = size[:alive] == depth
        out[rows[:alive][done]] = tokens[inverse[done]]
    return out


def count_tokens(docs: DataFrame, vocab: Vocabulary, *, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, ``n_words`` (pre-tokens) and ``n_tokens`` of the whole text.

    A null or empty text has 0 of both. Null and repeated ids are kept; other columns are left out. Nothing is
    shuffled, and what a task holds is bounded by a slice of whole texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        for batch in slices(batches, "text", 16_000_000):
            words, bounds = flat_words(batch.column("text"), lower=False)
            coded = words.dictionary_encode()
            counts = count_words(shared.value, coded.dictionary.to_pylist())
            total = np.concatenate([[0], np.cumsum(counts[np.asarray(coded.indices)] if len(words) else [])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(bounds)), pa.array(np.diff(total[bounds]))], [id_col, "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint")
