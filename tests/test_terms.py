"""Terms found by hashes against their patterns, one by one, on texts made to be awkward."""

from __future__ import annotations

import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from tidemark.functions.patterns import END, POTENTIAL_TERM, START, special_terms
from tidemark.operators import text
from tidemark.plans import catalog
from tidemark.schemas import TAXONOMY

W = r"[\p{L}\p{N}_]"
TERMS = [
    "data", "big data", "big  data", "big data big", "a a", "a b a", "c", "C++", "C#", ".NET", "Node.js", "Vue.js", "D3.js", "F#", "+a", "a+", "+a+b",
    "asp.net core", "Éa", "éa b", "x_y", "++", "->", "from-the", "b,", "(a)", "data big data", "İx", "a" * 40, "7", "a 7",
]


def pattern(term: str, strict: bool, special: str = "full") -> regex.Pattern:
    if term in special_terms(special):
        return regex.compile("(?iu)" + special_terms(special)[term])
    before = "(?<=" if strict and not regex.match(W, term) else "(?<!"
    after = "(?=" if strict and not regex.search(f"{W}$", term) else "(?!"
    return regex.compile(f"{before}{W}){regex.escape(term.lower())}{after}{W})")


def made_up(n: int) -> list[str]:
    rng = random.Random(11)
    bits = ["a", "b", "big", "data", "c", "C", "éa", "Éa", "x_y", "7", "İx", "node", "Node", "js", "net", "vue", "d3", "f", "F", "from", "the", "asp", "core", "a" * 40]
    gaps = [" ", " ", " ", "  ", "+", "++", "#", "# ", ".", ".", "-", "->", ", ", ",", "(", ")", "\n", ""]
    return ["".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [
        rng.choice(gaps) + rng.choice(bits) for _ in range(200)
    ]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("special", ["full", "basic"])
def test_terms_are_their_patterns(spark, strict, special):
    texts = ["", None, "++", " a a a a ", "big data big data big", "data big data big data", "+a+b", *made_up(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "job_id bigint, text string").repartition(4)
    entries = spark.createDataFrame([(t, "k", "s", None) for t in TERMS], TAXONOMY)
    got = text.extract_terms(docs, text.taxonomy_terms(entries), strict=strict, special=special)
    want = Counter()
    for job_id, said in enumerate(texts):
        for term in TERMS:
            own = term in special_terms(special)
            n = len(list(pattern(term, strict, special).finditer((said or "") if own else (said or "").lower())))
            if n:
                want[job_id, term] = n
    assert {(r["job_id"], r["skill_name"]): r["mention_count"] for r in got.collect()} == dict(want)


def test_names_and_aliases_add_up(spark):
    docs = spark.createDataFrame([(1, "Big Data, big data and BD; bd."), (1, "big data")], "job_id bigint, text string")
    entries = spark.createDataFrame([("Big Data", None, None, ["BD", "bd."]), ("Other", "x", "y", ["big data"])], TAXONOMY)
    got = text.extract_terms(docs, text.taxonomy_terms(entries))
    rows = {(r["skill_name"], r["category"], r["subcategory"]): r["mention_count"] for r in got.collect()}
    assert rows == {("Big Data", "Unknown", ""): 3 + 2 + 1, ("Other", "x", "y"): 3}


def test_one_plan_for_any_number_of_terms(spark, sf_dir):
    from tidemark.plans import catalog
    from tidemark.sources import mapping

    def shape(df) -> list[str]:
        shown = df._jdf.queryExecution().optimizedPlan().toString()
        return [w for w in regex.findall(r"Join|Generate|Aggregate|Repartition|Python", shown.split("Relation")[0])]

    few = text.extract_terms(mapping.documents(spark, sf_dir), catalog._terms(spark))
    many = catalog.QUERIES["extract_phrases"](spark, sf_dir)
    assert shape(few)[:3] == shape(many)[:3] == ["Aggregate", "Join", "Generate"] or shape(few)[:2] == shape(many)[:2]
    for df in (few, many):
        exchanged = " ".join(regex.findall(r"Exchange hashpartitioning.*", df._jdf.queryExecution().executedPlan().toString()))
        assert "parts" not in exchanged and "lowered" not in exchanged and "text#" not in exchanged
    empty = text.extract_terms(mapping.documents(spark, sf_dir), text.taxonomy_terms(spark.createDataFrame([], TAXONOMY)))
    assert empty.count() == 0
    assert many.agg(F.count(F.lit(1))).head()[0] > 0


def test_words_that_begin_no_term_stay_in_the_scan(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "big data and big cats"), (2, None), (3, "none here")], "job_id bigint, text string")
    entries = text.taxonomy_terms(spark.createDataFrame([("big data", "x", "y", ["cats"])], TAXONOMY))
    met = []
    real = text._beginnings

    def spy(*args):
        met.append(real(*args))
        return met[-1]

    monkeypatch.setattr(text, "_beginnings", spy)
    got = [text.extract_terms(docs, entries).collect()]
    assert met[-1].filter("word is not null").count() == 6  # big, big and cats, for one and for two words
    monkeypatch.setattr(text, "ANCHORS", 1)
    got.append(text.extract_terms(docs, entries).collect())
    assert got[0] == got[1] and got[0][0]["mention_count"] == 2


def test_words_are_unfolded_and_not_looked_at_one_by_one_in_arrays(spark):
    docs = spark.createDataFrame([(1, "Red hat, red  hat; blue")], "job_id bigint, text string")
    terms = spark.createDataFrame([("red hat", "Red Hat", "a", ""), ("blue", "Blue", "a", "")], "term string, canonical string, category string, subcategory string")
    found = text.extract_terms(docs, terms)
    assert {(r["skill_name"], r["mention_count"]) for r in found.collect()} == {("Red Hat", 1), ("Blue", 1)}
    assert "posexplode" in found._jdf.queryExecution().optimizedPlan().toString()


def test_extraction_stats_finds_the_terms_once(spark, sf_dir, monkeypatch):
    calls, whole = [], text.extract_terms
    monkeypatch.setattr(text, "extract_terms", lambda *a, **k: calls.append(1) or whole(*a, **k))
    catalog.QUERIES["extraction_stats"](spark, sf_dir)
    assert len(calls) == 1


def test_a_technical_word_is_matched_without_going_back():
    """No part gives letters back, and what is found is what the pattern that did so found."""
    assert regex.fullmatch(f"{POTENTIAL_TERM}b", "a-bb") is None
    backing = r"(?:[A-Z][a-z]+[A-Z][a-z]*|[A-Z]{2,}|[a-zA-Z]+\p{Nd}+|[a-zA-Z]+-[a-zA-Z]+)"
    draw = random.Random(3)
    for _ in range(3000):
        line = "".join(draw.choices("AbCd12-_é ", k=14))
        assert regex.findall(f"{START}{POTENTIAL_TERM}{END}", line) == regex.findall(f"{START}{backing}{END}", line), line
