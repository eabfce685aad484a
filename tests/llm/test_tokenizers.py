"""Encoding, decoding and alignment against the tokenizers' own libraries and brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment, catalog, pieces
from tidemark.llm.common import table

ODD = [
    None, "", " ", "   ", "▁", "a▁b", "a  b" + " " * 40 + "c", " " * 1000, "a" * 100, "ab" * 700, "thethethethe" * 80,
    "你好世界　これは日本語です", "😀😀 zwölf\x00", "<s> </s> <unk> <0x41> <|endoftext|>", "\n\n\t x'll  don't\x1c y", "trail  ", " " * 400 + "of the",
]


def random_texts(n: int) -> list[str]:
    rng = random.Random(5)
    alphabets = ["abc the", "thenofgir ▁", "atiofrnge ", "  \n\t=x(", [chr(c) for c in [*range(9, 14), 0x1C, 0x85, 0xA0, 0x3000, 0x200B, *[32] * 5, *range(97, 123), 0xE9, 0x4E00, 0x1F600, 39]]]
    return ["".join(rng.choice(a) for _ in range(rng.randint(0, 200))) for _ in range(n) for a in alphabets]


@pytest.fixture(scope="module")
def theirs():
    return sentencepiece.SentencePieceProcessor(model_file=catalog.vocabulary_path())


@pytest.fixture(scope="module")
def model():
    return pieces.load_model(catalog.vocabulary_path())


@pytest.fixture(scope="module")
def byte_level():
    return alignment.load_byte_level(catalog.vocabulary_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def byte_bpe():
    out = Tokenizer.from_file(catalog.vocabulary_path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


def test_merge_rounds_are_the_library(model, theirs):
    texts = ODD + random_texts(400)
    ids, bounds = pieces.encode(model, pa.array(texts, pa.string()))
    want = theirs.encode([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == want
    assert pieces.decode(model, ids, bounds) == [theirs.decode(w) for w in want]


def test_decoding_any_ids_is_the_library(model, theirs):
    rng = random.Random(6)
    rows = [[rng.randrange(rng.choice([4, 300, 32000])) for _ in range(rng.randint(0, 20))] for _ in range(3000)]
    bounds = np.cumsum([0, *map(len, rows)])
    assert pieces.decode(model, np.array([i for r in rows for i in r]), bounds) == [theirs.decode(r) for r in rows]


def test_a_heap_and_rounds_merge_alike(model):
    symbols = np.array([model.letter_id[model.letter[ord(c)]] for c in "thethengofthe" * 30])
    got, _ = pieces.merge_rounds(model, symbols.copy(), np.array([0, len(symbols)]))
    assert got.tolist() == pieces._one_by_one(model, symbols.tolist())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(spark, texts):
    rows = [(k if k % 7 else None, t, "x", "y") for k, t in enumerate(texts)] + [(1, "again", "x", "y")] * 3
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded string")


def test_encode_and_decode_odd_rows(spark, model, theirs):
    docs = rows_of(spark, ODD)
    got = pieces.decode_ids(pieces.encode_texts(docs, model).withColumnRenamed("doc_id", "decoded"), model)
    assert got.columns == ["decoded", "_decoded"]
    want = [(r["doc_id"], theirs.decode(theirs.encode(r["text"] or ""))) for r in docs.collect()]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert pieces.encode_texts(docs.limit(0), model).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert sorted(map(tuple, pieces.decode_ids(nulls, model).collect())) == [(1, None), (2, "")]
    with pytest.raises(Exception, match="not below"):
        pieces.decode_ids(spark.createDataFrame([([32000],)], "ids array<int>"), model).collect()


def test_op11_is_the_library(spark, sf_dir, theirs):
    got = {tuple(r) for r in catalog.QUERIES["op11_sentencepiece"](spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    want = set()
    for r in table(spark, sf_dir, "documents").collect():
        ids = theirs.encode(r["text"] or "", add_eos=True)
        want.add((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(theirs.decode(ids))))
    assert got == want


def brute(text, byte_level, byte_bpe, model, theirs):
    """Ids of both sides, all overlaps and links by comparing every two tokens' byte ranges, and the groups."""
    if not text:
        return None
    a, b = byte_bpe.encode(" " + text, add_special_tokens=False).ids, theirs.encode(text)
    parts = [[byte_level.tokens[i] for i in a], [model.pieces[i] for i in b]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    ends_a, ends_b = ([0, *itertools.accumulate(map(len, p))] for p in parts)
    over = {(i, j) for i in range(len(a)) for j in range(len(b)) if ends_a[i] < ends_b[j + 1] and ends_b[j] < ends_a[i + 1]}
    links = sorted((i, j) for i, j in over if ends_a[i + 1] == ends_b[j + 1])
    groups, at_a, at_b = [], 0, 0
    for i, j in links:
        groups.append(",".join(map(str, a[at_a : i + 1])) + "|" + ",".join(map(str, b[at_b : j + 1])))
        at_a, at_b = i + 1, j + 1
    return a, b, over, links, ";".join(groups)


def test_alignment_is_brute_force(spark, byte_level, byte_bpe, model, theirs):
    texts = [t[:300] if t else t for t in ODD] + random_texts(60)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, groups string")
    for r in alignment.align_texts(docs, byte_level, model).collect():
        want = brute(texts[r["doc_id"]], byte_level, byte_bpe, model, theirs) or ([], [], set(), [], "")
        assert (r["a_ids"], r["b_ids"], r["groups"]) == (want[0], want[1], want[4])
        assert set(zip(r["overlap_a"], r["overlap_b"], strict=True)) == want[2]
        assert list(zip(r["link_a"], r["link_b"], strict=True)) == want[3]
    assert alignment.summary(alignment.align_texts(docs.limit(0), byte_level, model)).count() == 0


def expected_summary(rows, *tools):
    found = [(i, brute(t, *tools)) for i, t in rows]
    counts = Counter((w[0][i], w[1][j]) for _, w in found if w for i, j in w[3])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, w in found:
        if w is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        pairs = [(w[0][i], w[1][j]) for i, j in w[3]]
        best = sum(counts[p] == most[p[1]] for p in pairs)
        out.append((doc_id, len(w[0]), len(w[1]), len(pairs), len(pairs), best, sum(counts[p] for p in pairs), sha(w[4])))
    return Counter(out)


def test_op12_summary_of_odd_rows(spark, byte_level, byte_bpe, model, theirs):
    docs = rows_of(spark, [t[:300] if t else t for t in ODD])
    got = alignment.summary(alignment.align_texts(docs, byte_level, model))
    want = expected_summary([(r["doc_id"], r["text"]) for r in docs.collect()], byte_level, byte_bpe, model, theirs)
    assert Counter(map(tuple, got.collect())) == want


def test_op12_over_the_documents(spark, sf_dir, byte_level, byte_bpe, model, theirs):
    short = table(spark, sf_dir, "documents").filter("length(text) < 1500")
    got = alignment.summary(alignment.align_texts(short, byte_level, model))
    want = expected_summary([(r["doc_id"], r["text"]) for r in short.collect()], byte_level, byte_bpe, model, theirs)
    assert Counter(map(tuple, got.collect())) == want
    assert catalog.QUERIES["op12_tokenizer_alignment"](spark, sf_dir).columns == got.columns


def test_linked_pairs_end_alike(byte_level, model):
    """The bound on the table of counts: pairs of which one's bytes end with the other's."""
    by_bytes = defaultdict(list)
    for i, token in enumerate(model.pieces):
        by_bytes[token].append(i)
    short = {(a, b) for a, token in enumerate(byte_level.tokens) for k in range(len(token)) for b in by_bytes.get(token[k:], ())}
    by_bytes = defaultdict(list)
    for i, token in enumerate(byte_level.tokens):
        by_bytes[token].append(i)
    long = {(a, b) for b, token in enumerate(model.pieces) for k in range(len(token)) for a in by_bytes.get(token[k:], ())}
    assert len(short | long) == 324_298


def test_a_worker_gives_back_what_it_has_freed():
    import numpy as np
    import pyarrow as pa

    from tidemark.llm.common import give_back

    held = [pa.array(np.arange(100_000)).cast(pa.string()) for _ in range(20)]
    del held
    give_back()
    with open("/proc/self/statm") as f:
        before = int(f.read().split()[1])
    held = [str(i) * 4 for i in range(1_000_000)]
    del held
    give_back()
    with open("/proc/self/statm") as f:
        assert (int(f.read().split()[1]) - before) * 4096 < 40_000_000


def test_parts_met_in_an_earlier_slice_are_not_encoded_again(monkeypatch):
    import public_tokenizers

    left = alignment.load_byte_level(str(public_tokenizers.path("byte_bpe_50k.json")))
    new, encode = [], alignment._encode_new
    monkeypatch.setattr(alignment, "_encode_new", lambda side, parts, plain: new.extend(parts.to_pylist()) or encode(side, parts, plain))
    texts = pa.array([" zyx wvu zyx", None, " a  b", ""])
    once = alignment.encode_byte_level(left, texts)
    assert " zyx" in new and len(new) == len(set(new))
    new.clear()
    again = alignment.encode_byte_level(left, texts)
    assert not new
    assert all((a == b).all() for a, b in zip(once, again, strict=True))
