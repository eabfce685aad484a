"""The corpus operators against brute force, and on nulls, empty and long texts, repeats, ties and clashing names."""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import catalog, components, decontaminate, embeddings, katz, language, license, mixing, neardup, pii, tokens, toxicity
from tidemark.llm.common import saved, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string, words string"
LONG = "one two three four five six seven eight nine ten " * 3000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns named as results are."""
    rows = [
        (1, "Mail me at bob@example.com now", "en", "a", 30, 1.0, "x", "y"),
        (1, "Mail me at bob@example.com now", "en", "a", 30, 1.0, "x", "y"),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 1.0, "x", "y"),
        (None, "no id at all, but some words", "en", None, 28, 1.0, "x", "y"),
        (4, LONG, "en", "b", len(LONG), 1.0, "x", "y"),
        (5, "12 34 !!", "de", "b", 8, 1.0, "x", "y"),
        (6, "Zwölf Boxkämpfer 😀 jagen +49 (30) 1234567 GNU General Public License", "de", "b", 60, 1.0, "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (6, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int")


def operators(spark):
    bench = spark.createDataFrame([(1, "seven eight nine ten one two"), (2, None), (3, "")], "item_id bigint, text string")
    vocab = tokens.vocabulary(["▁", "▁m", "a", "il", "e"])
    return {
        "katz": lambda d: katz.score(katz.training(d)),
        "license": lambda d: license.summary(license.scan_licenses(d)),
        "language": lambda d: language.identify(d, language.fit(d)),
        "tokens": lambda d: tokens.count_tokens(d, vocab),
        "toxicity": lambda d: toxicity.score_texts(d, toxicity.fit(d, labels(spark))),
        "neardup": neardup.near_duplicates,
        "mixing": mixing.mix_documents,
        "pii": lambda d: pii.digest(pii.find_pii(d)),
        "passages": lambda d: decontaminate.find_passages(d, bench),
    }


@pytest.mark.parametrize("name", ["katz", "license", "language", "tokens", "toxicity", "neardup", "mixing", "pii"])
def test_a_row_for_each_row(spark, odd, name):
    run = operators(spark)[name]
    got = run(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([1, 1, 2, 3, None, 4, 5, 6])
    assert run(odd.limit(0)).count() == 0


def test_passages_on_odd_rows(spark, odd):
    run = operators(spark)["passages"]
    assert [(r["doc_id"], r["item_id"], r["similarity"]) for r in run(odd).collect()] == [(4, 1, 1.0)]
    assert run(odd.limit(0)).count() == 0
    assert decontaminate.find_passages(odd, odd.selectExpr("doc_id item_id", "text").limit(0)).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd, sf_dir):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf_dir).count() == 0, name
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns[: len(odd.columns)] == odd.columns, name
        if name == "language":
            assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 1, 1, 4, 6]
        if name == "near_duplicates":
            assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 1, 4, 6]
        if name == "personal_data":
            text = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert text[1] == "Mail me at <EMAIL> now" and "<PHONE> GNU" in text[6]
    assert {"copies", "taken"} <= set(docs.columns)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


def test_katz_is_normalised_and_equal_to_brute_force(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op1_katz_scores"](spark, sf_dir).collect()}
    said = {i: [*words(t), None] for i, t in texts.items()}
    train = [i for i in said if zlib.crc32(str(i).encode()) % 5 != 1]
    one, two, context = Counter(w for i in train for w in said[i]), Counter(p for i in train for p in zip([0, *said[i]], said[i], strict=False)), Counter()
    for (h, _), n in two.items():
        context[h] += n
    total = sum(one.values())

    def discounts(counts):
        n, out = Counter(counts.values()), {}
        for r in range(1, 6):
            d = 0
            if all(n[j] for j in (1, r, r + 1, 6)) and 6 * n[6] < n[1]:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - 6 * n[6] / n[1]) / (1 - 6 * n[6] / n[1])
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    d1, d2 = discounts(one), discounts(two)
    unknown = 1 - sum(n * d1.get(n, 1) for n in one.values()) / total

    def lower(w):
        return one[w] * d1.get(one[w], 1) / total if w in one else unknown

    kept, below = Counter(), Counter()
    for (h, w), n in two.items():
        kept[h] += n * d2.get(n, 1)
        below[h] += lower(w)

    context = {h: n + 0.5 * (kept[h] >= n - 1e-9) for h, n in context.items()}

    def p(h, w):
        if (h, w) in two:
            return two[h, w] * d2.get(two[h, w], 1) / context[h]
        return ((1 - kept[h] / context[h]) / (1 - below[h]) if h in context else 1) * lower(w)

    for h in ("the", "der", 0):
        assert sum(p(h, w) for w in one) + p(h, "never seen") == pytest.approx(1)
    for i, ts in said.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(w in one for w in ts), total)
        assert r["score"] == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip([0, *ts], ts, strict=False)))
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 0.5) / (total + 0.5 * (len(one) + 1))) for w in ts))


def test_passages_against_containment(spark, sf_dir, docs, texts):
    items = {r["item_id"]: r["text"] for r in table(spark, sf_dir, "benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in catalog.QUERIES["op2_decontamination"](spark, sf_dir).collect()}
    assert got >= {(i, j) for i, t in texts.items() for j, item in items.items() if item in t}
    n_words = {i: len(t.split()) for i, t in texts.items()}
    assert all(n_words[i] >= 0.7 * len(items[j].split()) for i, j in got)


def test_one_changed_word_is_still_a_passage_and_every_near_fingerprint_is_found(spark):
    item = " ".join(f"word{i}" for i in range(40))
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    rows = [(1, "before " + item.replace("word20 ", "other ") + " after"), (2, " ".join(f"word{i}" for i in range(20))), (3, item.upper())]
    got = {r["doc_id"] for r in decontaminate.find_passages(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == {1, 3}
    rng = np.random.default_rng(3)
    codes = [rng.integers(1, 2**63, 20).astype(np.uint64) for _ in range(60)]
    index = decontaminate.build_index(list(enumerate(codes)), {int(s): 1.0 for c in codes for s in decontaminate.shingles_of(c)})
    prints = index.fingerprint[:20].copy()
    prints[:, :3] ^= rng.integers(0, 256, (20, 3)).astype(np.uint8)
    near = np.bitwise_count(prints[:, None] ^ index.fingerprint[None]).sum(2) <= index.radius
    assert {tuple(x) for x in decontaminate.within_radius(index, prints).tolist()} == {tuple(x) for x in np.argwhere(near).tolist()}


def test_passages_of_uneven_weight_are_found():
    """Items of which 20 heavy shingles stand in the document and 30 light ones are replaced: overlap 0.8."""
    rng = np.random.default_rng(4)
    items = [(k, rng.integers(1, 2**63, 54).astype(np.uint64)) for k in range(200)]
    rarity = {}
    for _, codes in items:
        grams = decontaminate.shingles_of(codes).tolist()
        rarity |= {g: 6.0 if n < 20 else 1.0 for n, g in enumerate(grams)}
    index = decontaminate.build_index(items, rarity)
    for k, codes in items:
        doc = np.concatenate([rng.integers(1, 2**63, 30).astype(np.uint64), codes[:24], rng.integers(1, 2**63, 60).astype(np.uint64)])
        assert k in [found[0] for found in decontaminate.search(index, doc)]


def test_licenses_against_brute_force(spark, sf_dir, texts):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r in catalog.QUERIES["op3_license_scan"](spark, sf_dir).collect():
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]].translate(LOWER))
        places = [(i, label) for p, label in phrases.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(ws), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == (min(places)[0], max(places)[0]) if places else (None, None)
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def test_language_held_out(spark, sf_dir, docs):
    got = catalog.QUERIES["op4_language_id"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_code_lengths_are_of_a_distribution(spark, docs):
    model = language.fit(docs, documents=30)
    share = np.exp2(-model.bits.reshape(-1, model.n, len(model.languages)).astype(float))
    share[:, 0] *= 256 - (model.n - 1)
    assert np.allclose(share.sum(1), 1, atol=1e-3)


def test_tokens_against_one_by_one():
    vocab = tokens.vocabulary(["▁", "a", "b", "▁a", "ab", "abc", "é", "ba", "▁ab"])
    some = sorted({"".join(x) for n in range(1, 6) for x in __import__("itertools").product("abé漢", repeat=n)}) + ["ab" * 200]
    assert tokens.count_words(vocab, some).tolist() == [tokens.count_one(vocab, "▁" + w) for w in some]


def test_token_counts_of_whole_texts_in_their_own_case(spark, sf_dir, texts):
    vocab = tokens.vocabulary(["▁", "T", "▁T", "▁The", "▁the", "he", "USA", "u", "s", "a"])
    some = ["The USA", "the usa", "\tTHE  the\nThe ", "", None, "É é Zwölf 😀"]
    frame = spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string")
    for found, by, known in (
        (tokens.count_tokens(frame, vocab), vocab, dict(enumerate(some))),
        (catalog.QUERIES["op5_token_counts"](spark, sf_dir), tokens.vocabulary(tokens.load_pieces(catalog.vocabulary_path())), texts),
    ):
        one = functools.cache(lambda w, by=by: tokens.count_one(by, "▁" + w))
        for r in found.collect():
            ws = re.findall(r"[^\x20\x09-\x0D]+", known[r["doc_id"]] or "")
            assert (r["n_words"], r["n_tokens"]) == (len(ws), sum(map(one, ws)))


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * 0.25).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, x[0].tolist()), (900, x[0].tolist()), (901, None), (902, [0.0] * 8), (903, [float("nan")] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    cell, block, embeddings.CELL, embeddings.BLOCK = embeddings.CELL, embeddings.BLOCK, 20, 16
    try:
        got = embeddings.link_embeddings(frame).collect()
    finally:
        embeddings.CELL, embeddings.BLOCK = cell, block
    ids = [i for i, v in rows[:302]]
    y = np.array([v for _, v in rows[:302]], dtype=float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.9
    label = np.arange(302)
    for _ in range(302):
        label = np.array([label[near[i]].min() for i in range(302)])
    want = Counter((ids[i], int(near[i].sum() - 1), ids[label[i]]) for i in range(302))
    want.update((i, 0, i) for i in (901, 902, 903, 904, 905))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert embeddings.link_embeddings(frame.limit(0)).count() == 0


def test_held_out_labels_change_no_score(spark, sf_dir):
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = marks.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.score_texts(docs, toxicity.fit(toxicity.training_rows(docs), m)).collect() for m in (marks, other))
    assert other.exceptAll(marks).count() > 0
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_components_of_links_that_are_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "saved", lambda df, purpose: written.append(purpose) or saved(df, purpose))
    links = spark.createDataFrame([(0, 4), (5, 0), (0, 5), (1, 2), (3, 3)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {0: 0, 4: 0, 5: 0, 1: 1, 2: 1} and "cc-round" not in written
    written.clear()
    chain = spark.createDataFrame([(0, 1), (1, 2)], "a bigint, b bigint")
    assert {r["node"]: r["root"] for r in components.components(chain).collect()} == {0: 0, 1: 0, 2: 0}
    assert written.count("cc-round") == 1


def test_components_that_do_not_end_are_an_error(spark):
    chain = spark.range(60).selectExpr("id a", "id + 1 b")
    assert components.components(chain).filter("root = 0").count() == 61
    with pytest.raises(RuntimeError, match="rounds"):
        components.components(chain, rounds=1)


def test_mixed_rows_do_not_depend_on_how_rows_are_cut(spark, docs):
    want = Counter(tuple(r) for r in mixing.mixed_rows(docs, block=16).collect())
    for n in (1, 5):
        assert Counter(tuple(r) for r in mixing.mixed_rows(docs.repartition(n), block=16).collect()) == want


def test_toxicity_learns_words(spark):
    rng = np.random.default_rng(1)
    rows = [" ".join(f"w{k}" for k in rng.integers(0, 400, 60)) + (" idiot" if i % 3 == 0 else "") for i in range(600)]
    model = toxicity.train(rows, np.array([float(i % 3 == 0) for i in range(600)]), ["en"] * 600, prior=1 / 3)
    p = toxicity.scores(model, pa.array(["w1 w2 idiot w3", "w1 w2 w3", ""]))
    assert p[0] > 0.5 > 0.3 > p[1] and p[2] < 0.3


def test_toxicity_learns_from_every_label(spark):
    rows = [(i, f"a b w{i % 7}" + (" idiot" if i % 3 == 0 else "") + (" seldom" if i % 10 == 0 else ""), "en", int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    models = [toxicity.fit(d, docs.select("doc_id", "toxic"), rows=20) for d in (docs, docs.repartition(3))]
    code, _ = toxicity.hashed(pa.array(["seldom"]))
    assert code[0] in models[0].known
    one, two = (toxicity.scores(m, pa.array(["a b w1", "a b idiot w2", ""])) for m in models)
    assert (one == two).all() and one[1] > one[0]


def test_near_duplicates_against_brute_force(spark, sf_dir, docs, texts):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op8_minhash_neardup"](spark, sf_dir).collect()}
    n, counters = neardup.document_frequencies(docs)
    sketch = neardup.rarity(n, counters)
    ids = sorted(texts)
    codes, counts, at = neardup.per_text(pa.array([texts[i] for i in ids]))
    sets = [(codes[a:b], neardup.weights(sketch, codes[a:b], counts[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
    label = {i: i for i in ids}
    for k, i in enumerate(ids):
        for m in range(k):
            if neardup.similarity(sets[k], sets[m]) >= 0.8 and label[i] != label[ids[m]]:
                low, high = sorted((label[i], label[ids[m]]))
                label = {x: low if y == high else y for x, y in label.items()}
    assert {i: r["class_id"] for i, r in got.items()} == label


def test_samples_agree_as_often_as_texts_are_similar():
    a = " ".join(f"w{i}" for i in range(400))
    b = a.replace("w100 ", "x ").replace("w300 ", "y ")
    codes, counts, at = neardup.per_text(pa.array([a, b]))
    weight = np.where(codes % np.uint64(2) == 0, 1.0, 2.0) * counts
    parts = [(codes[i:j], weight[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
    signature = neardup.samples(codes, weight, at)
    assert (signature[0] == signature[1]).mean() == pytest.approx(neardup.similarity(*parts), abs=0.1)


@pytest.mark.parametrize(("shared", "weight", "own"), [(2, 500.0, 50), (12, 100.0, 100), (12, 100.0, 0), (300, 1.5, 40)])
def test_samples_agree_as_often_as_texts_with_heavy_shingles_are_similar(shared, weight, own):
    rng = np.random.default_rng(23)
    agree, due = [], []
    for _ in range(20):
        codes = rng.integers(1, 2**63, shared + 2 * own).astype(np.uint64)
        parts = []
        for mine in (codes[shared : shared + own], codes[shared + own :]):
            some = np.concatenate([codes[:shared], mine])
            order = np.argsort(some)
            parts.append((some[order], np.array([weight] * shared + [1.0] * own)[order]))
        signature = neardup.samples(*(np.concatenate(x) for x in zip(*parts, strict=True)), np.array([0, shared + own, 2 * (shared + own)]))
        agree.append((signature[0] == signature[1]).mean())
        due.append(neardup.similarity(*parts))
    assert np.mean(agree) == pytest.approx(np.mean(due), abs=0.03)


def test_texts_that_repeat_a_line_are_near_duplicates(spark):
    rows = [(2 * i + k, f"again{i} " * 300 + " ".join(f"own{i}of{k}x{j}" for j in range(14))) for i in range(20) for k in range(2)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: i - i % 2 for i in range(40)}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(50, 51), (60, 50), (70, 70)] + [(100, i) for i in range(101, 140)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 51: 50, 60: 50, **{i: 100 for i in range(100, 140)}}


def test_mix_comes_near_its_targets(spark, sf_dir, texts):
    docs = table(spark, sf_dir, "documents")
    got = mixing.mix_documents(docs, block=40).collect()
    again = mixing.mix_documents(docs.repartition(3), block=40).collect()
    assert sorted(got) == sorted(again)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size, taken, goal = Counter(), Counter(), {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])) and r["taken"] <= 3 * r["size"]
        size[s] += r["size"]
        taken[s] += r["taken"]
        goal[s] = r["target"]
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size))}
    want, full = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        share = rest / max(1, sum(w for s, w in weight.items() if s not in full))
        want = {s: 3 * size[s] if s in full else share * weight[s] for s in size}
        over = {s for s in size if s not in full and want[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    longest = max(r["size"] for r in got)
    assert all(goal[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= longest for s in size)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_against_brute_force(spark, sf_dir, texts):
    hard = ["a@b.c@d.e a%x@d.ef.gh", "x" * 50000, "a@b.c%x@d.ef", "1.2.3.4.5.6.7.8 0001.0.0.255", "4111 1111-1111 1111 9", "4111111111111111", "😀 +1 (2) 345-678.90- +12", "@@ a@b", "GB82 WEST 1234 5698 7654 32"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(hard)], "doc_id bigint, text string")
    for found, known in ((pii.digest(pii.find_pii(frame)), dict(enumerate(hard))), (catalog.QUERIES["op10_pii"](spark, sf_dir), texts)):
        for r in found.collect():
            want = base_spans(known[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), known[r["doc_id"]][:80]
            assert [r[f"n_{k}"] for k in BASE] == [sum(x.startswith(k) for x in want) for k in BASE]
            assert set(want) <= set(r["spans"].split(",")) | {""}
    assert "iban:0:27" in pii.digest(pii.find_pii(frame)).filter("doc_id = 8").head()["spans"]


def test_native_operators_run_no_python(docs):
    for frame in (pii.digest(pii.find_pii(docs)), pii.redact(docs), license.summary(license.scan_licenses(docs, idf=dict.fromkeys({w for t in license.TEMPLATES for w in t.words.split()}, 1.0)))):
        assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())


def test_results_do_not_depend_on_case_of_clashing_columns(docs):
    assert neardup.keep_one(docs.withColumn("DUP_ROW", F.lit(1)).withColumn("dup_node", F.lit("x"))).columns[-2:] == ["DUP_ROW", "dup_node"]
