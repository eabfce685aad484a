"""Ball-tree search against scoring every document, and its bounds against every score below a node."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import balltree, catalog
from tidemark.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=10):
    """Every item against every document; equal rows are told apart by their place."""
    said = [(i, Counter(terms(t))) for i, t in docs]
    said = [(i, c) for i, c in said if c]
    n_docs, n_terms = len(said), sum(c.total() for _, c in said)
    df = Counter(t for _, c in said for t in c)
    out = []
    for item, text in items:
        wanted, found = Counter(terms(text)), []
        for doc_id, held in said:
            m, score = 100 - 75 + (75 * held.total() * n_docs) // n_terms, 0
            for t, c in wanted.items():
                if t in held:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += c * w * ((1_000_000_000 * held[t]) // (1000 * held[t] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        found.sort()
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(found[:top])]
    return Counter(out)


def made_up(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Ünïcode", "x-y", "a_b", "7"]
    topic = [rng.sample(words, 12) for _ in range(8)]
    docs = [(k, " ".join(rng.choices(rng.choice(topic), k=rng.randint(1, 40)))) for k in range(n)]
    docs += [(n + k, docs[0][1]) for k in range(30)] + [(0, docs[0][1])] * 3
    items = [(k, " ".join(rng.choices(rng.choice(topic), k=rng.randint(1, 10)))) for k in range(20)]
    return docs, items


ODD = [(None, None), (900, ""), (None, "w1 w2 W3"), (901, "w1 " * 5000), (902, "!! --"), (902, "w1\x00w2é")]


@pytest.mark.parametrize(("block", "leaf"), [(64, 4), (8192, 32), (7, 100)])
def test_search_is_brute_force(spark, block, leaf):
    docs, items = made_up(150)
    docs, items = docs + ODD, [*items, (3, "w1 w1 é"), (3, "w1 w1 é"), (None, "w5"), (7, None), (8, ""), (9, "unknown")]
    left = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, rank int, item_id string").repartition(3)
    right = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id bigint, text string, score int, doc_id string")
    got = balltree.rank_documents(left, right, block_docs=block, leaf_docs=leaf)
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == brute(docs, items)
    parts = balltree.rank_documents(left, right, block_docs=block, leaf_docs=leaf, pass_words=15)
    assert Counter(map(tuple, parts.collect())) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = made_up(10)
    left = spark.createDataFrame(docs, "doc_id bigint, text string")
    right = spark.createDataFrame(items, "item_id bigint, text string")
    for a, b in ((left.limit(0), right), (left, right.limit(0)), (left.limit(0), right.limit(0))):
        got = balltree.rank_documents(a, b)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_op13_is_brute_force(spark, sf_dir):
    got = catalog.QUERIES["op13_lexical_search"](spark, sf_dir)
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    assert Counter(map(tuple, got.collect())) == brute(docs, items)


def a_tree(leaf):
    """Documents of eight topics on terms of their own, planted; and items on the terms of one topic each."""
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(np.arange(20 * (k % 8), 20 * (k % 8) + 20), 10, replace=False)) for k in range(640)]
    at = np.arange(641) * 10
    term = np.concatenate(lists)
    value = rng.integers(700_000, 900_000, len(term))
    weight = rng.integers(4000, 9000, 160)
    _, tree = balltree.plant(np.arange(640), at, term, value, 160, leaf)
    item_term = np.concatenate([np.sort(rng.choice(np.arange(20 * k, 20 * k + 20), 6, replace=False)) for k in range(8)])
    items = balltree.Items(list(range(8)), pa.array([str(k) for k in range(160)]), np.arange(9) * 6, item_term, np.ones(48, dtype=np.int64))
    return tree, items, weight


def test_bounds_hold_and_prune():
    tree, items, weight = a_tree(8)
    search = balltree.Search(tree, items, weight, np.zeros(8, dtype=np.int64), 10)
    dense = np.zeros((640, 160), dtype=np.int64)
    dense[np.repeat(np.arange(640), np.diff(tree.at)), tree.term] = tree.value
    query = np.zeros((8, 160), dtype=np.int64)
    query[np.repeat(np.arange(8), 6), items.term] = weight[items.term]
    scores = query @ dense.T
    for node in range(len(tree.first)):
        assert (search.bounds(node, np.arange(8)) >= scores[:, tree.first[node] : tree.end[node]].max(axis=1)).all()
    search.run()
    search.cut()
    found = {(i, d, s) for i, d, s in search.found[0].T.tolist()}
    want = {(i, int(d), int(scores[i, d])) for i in range(8) for d in np.lexsort([tree.place, -scores[i]])[:10]}
    assert found == want
    assert search.scored < scores.size / 2


def test_equal_documents_are_one_leaf():
    at = np.arange(201) * 2
    order, tree = balltree.plant(np.arange(200), at, np.tile([0, 1], 200), np.tile([5, 7], 200), 2, 4)
    assert len(tree.first) == 1 and sorted(order.tolist()) == list(range(200))
