"""Small hand-made cases with results worked out by hand."""

from __future__ import annotations

import json
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import discovery, extras, ingest, marts, quality, serve, shape, stage, text
from tidemark.plans import catalog

RAW = "id long, job_platform_id string, search_role string, country_code string, raw_data string, extracted_at timestamp_ntz"
T0 = datetime(2024, 1, 1)


def flat(spark, *payloads, country="gb"):
    rows = [(i, str(i), "Data Engineer", country, p if isinstance(p, str) else json.dumps(p), T0) for i, p in enumerate(payloads)]
    good, bad = stage.flatten_posting(spark.createDataFrame(rows, RAW))
    return {r["raw_job_id"]: r for r in good.collect()}, bad.collect()


def test_parser_shapes(spark):
    good, bad = flat(
        spark,
        {"id": 1, "company": {"display_name": "Acme"}, "salary_is_predicted": "1", "created": "2024-01-05T10:00:00Z"},
        {"id": 2, "company": "Plain Ltd", "salary_is_predicted": 1, "created": "soon"},
        {"id": 3, "salary_is_predicted": "0", "location": "London", "title": None},
        {"id": 4, "company": {}, "location": {"area": ["UK", "London"], "display_name": "London"}, "salary_min": 10.5},
        "not json",
        "[1]",
    )
    assert [good[i]["company_name"] for i in range(4)] == ["Acme", "Plain Ltd", "", ""]
    assert [good[i]["salary_is_predicted"] for i in range(4)] == [True, False, False, False]
    assert [good[i]["job_posted_at"] for i in range(4)] == [datetime(2024, 1, 5, 10), None, None, None]
    assert good[2]["location_areas"] == [] and good[2]["location_display"] == "" and good[2]["title"] == ""
    assert good[3]["location_areas"] == ["UK", "London"] and float(good[3]["salary_min"]) == 10.5
    assert good[0]["salary_currency"] == "GBP"
    assert sorted(r["id"] for r in bad) == [4, 5]
    assert flat(spark, {"id": 1}, country="xx")[0][0]["salary_currency"] == "USD"


def test_first_role_wins(spark):
    rows = [("1", "gb", "B", 1), ("1", "gb", "A", 1), ("1", "us", "A", 2), ("2", "gb", "A", 3), ("2", "gb", "C", 2)]
    new = spark.createDataFrame(rows, "job_platform_id string, country_code string, search_role string, extracted_at int")
    got = {(r[0], r[1], r[2]) for r in ingest.dedup_first_wins(new, None).collect()}
    assert got == {("1", "gb", "A"), ("1", "us", "A"), ("2", "gb", "C")}
    landed = new.filter("job_platform_id = '2'").select("job_platform_id", "country_code")
    assert ingest.dedup_first_wins(new, landed).count() == 2


def terms(spark, *entries):
    return text.taxonomy_terms(spark.createDataFrame(list(entries), schemas.TAXONOMY))


def found(spark, body, *entries, **options):
    docs = spark.createDataFrame([(1, body)], "job_id long, text string")
    rows = text.extract_terms(docs, terms(spark, *[(*e, "c", "s", a) for *e, a in entries]), **options).collect()
    return {r["skill_name"]: r["mention_count"] for r in rows}


def test_special_terms(spark):
    body = "C++ and c#, .NET or .NET6; Node.js, NodeJS node.js. React, reactor, re-act spark-based éspark Spark C++x"
    entries = [("C++", []), ("C#", []), (".NET", []), ("Node.js", ["NodeJS"]), ("React", []), ("Spark", ["spark"])]
    got = found(spark, body, *entries)
    # Node.js finds all three spellings, its alias finds one of them again
    assert got == {"C++": 1, "C#": 1, ".NET": 1, "Node.js": 4, "React": 1, "Spark": 4}
    assert found(spark, ".NET6", (".NET", []), special="basic") == {".NET": 1}


def test_symbol_edges(spark):
    assert found(spark, "F# F#a", ("F#", [])) == {"F#": 1}
    assert found(spark, "F# F#a", ("F#", []), strict=True) == {"F#": 1}
    assert found(spark, "only F# here", ("F#", []), strict=True) == {}
    assert found(spark, "only F# here", ("F#", [])) == {"F#": 1}


def brute(body, entries):
    out = {}
    for name, aliases in entries:
        n = sum(len(re.findall(rf"\b{re.escape(t)}\b", body, re.IGNORECASE)) for t in [name, *aliases])
        if n:
            out[name] = n
    return out


ENTRIES = [
    ("machine learning", ["ML"]),
    ("data", []),
    ("a a", []),
    ("big data", ["big-data"]),
    ("Élan vital", ["élan"]),
    ("c", []),
    ("x_y", ["x y"]),
]
BODY = "Machine Learning, big data big data;big-data a a a a. ML mlx ÉLAN VITAL élan x_y x y data_ C machine  learning"


def test_phrases_as_brute_force(spark):
    assert found(spark, BODY, *ENTRIES) == brute(BODY, ENTRIES)
    assert found(spark, BODY, *ENTRIES, strict=True) == brute(BODY, ENTRIES)


def test_taxonomy_defaults(spark):
    t = terms(spark, ("A", None, None, None), ("B", "c", "s", ["b1", "b2"]))
    rows = {(r["term"], r["canonical"], r["category"], r["subcategory"]) for r in t.collect()}
    assert rows == {("A", "A", "Unknown", ""), ("B", "B", "c", "s"), ("b1", "B", "c", "s"), ("b2", "B", "c", "s")}


def test_custom_finder_and_merge(spark):
    def make_finder():
        def find(texts):
            return [
                [{"text": " Polars ", "label": "big data tool", "score": 0.81234}, {"text": "POLARS", "label": "other", "score": 0.9}]
                + [{"text": "data", "label": "other", "score": 0.9}, {"text": "Weak", "label": "other", "score": 0.4}]
                + [{"text": "python", "label": "programming language", "score": 0.7}]
                for _ in texts
            ]

        return find

    body = "Python and many other things are asked for in this long enough posting text"
    docs = spark.createDataFrame([(1, body), (2, "short")], "job_id long, text string")
    known = terms(spark, ("Python", "Lang", "", []), ("SQL", "Lang", "", []))
    merged, new = text.hybrid_extract(docs, known, finder=make_finder)
    rows = {r["skill_name"]: r for r in merged.collect()}
    assert set(rows) == {"Python", "Polars"}
    assert rows["Python"]["extraction_method"] == "taxonomy" and rows["Python"]["mention_count"] == 1
    assert rows["Polars"]["category"] == "Big Data" and rows["Polars"]["confidence"] == 0.812
    assert [r["skill_name"] for r in new.collect()] == ["Polars"]
    only, _ = text.hybrid_extract(docs, known, finder=make_finder, mode="fast_only")
    assert [r["skill_name"] for r in only.collect()] == ["Python"]
    verified = text.verify_candidates(text.clean_candidates(text.candidate_terms(docs, make_finder)), known)
    assert {r["skill_name"]: r["extraction_method"] for r in verified.collect()} == {
        "Polars": "gliner_unverified",
        "python": "gliner_verified",
    }


SIGHTING = "job_id long, position int, skill_name string, category string, subcategory string, confidence double, context string, seen_at timestamp_ntz"


def test_discoveries_and_promotion(spark):
    def rows(name, scores, contexts=None):
        return [
            (i, 0, n, "Other", "other", s, (contexts or ["c"] * 9)[i], datetime(2024, 1, 1, 0, i))
            for i, (n, s) in enumerate(zip(name, scores))
        ]

    many = [f"{i}" * 150 for i in range(7)]
    data = (
        rows(["Foo", "FOO ", "foo"], [0.7, 0.8, 0.9])
        + rows(["Bar"] * 3, [0.5, 0.6, 0.7])
        + rows(["Baz"] * 2, [0.99, 0.99])
        + rows(["Qux"] * 7, [None] * 7, many)
        + rows(["x"], [0.9])
    )
    disc = discovery.discoveries(spark.createDataFrame(data, SIGHTING))
    got = {r["skill_key"]: r for r in disc.collect()}
    assert set(got) == {"foo", "bar", "baz", "qux"}
    assert got["foo"]["name"] == "Foo" and got["foo"]["avg_confidence"] == 0.8
    assert got["qux"]["sample_contexts"] == [c[:100] for c in many[:5]] and got["qux"]["avg_confidence"] == 0.8
    fit = discovery.promotion_candidates(disc)
    assert [r["skill_key"] for r in fit.collect()] == ["qux", "foo"]
    taxonomy = spark.createDataFrame([("FOO", "Known", "", [])], schemas.TAXONOMY)
    dim = spark.createDataFrame([(1, "FOO", "Known", "")], schemas.DIM_SKILLS)
    grown, dims = discovery.promote_terms(taxonomy, dim, fit)
    assert sorted(r["name"] for r in grown.collect()) == ["FOO", "Qux"]
    assert sorted(r["skill_name"] for r in dims.collect()) == ["FOO", "Foo", "Qux"]
    stats = discovery.discovery_stats(disc, top=2).first()
    assert (stats["total_discoveries"], stats["pending_promotion"]) == (4, 2)
    assert [e["name"] for e in stats["top_pending"]] == ["Qux", "Bar"]


ENR = "job_id long, skill_id long, skill_name string, skill_category string, search_role string, country_code string"


def test_role_pairs_without_and_with_many_shared(spark):
    rows, job = [], 0
    for role, names in (("A", range(12)), ("B", range(12)), ("C", [99])):
        for _ in range(3):
            job += 1
            rows += [(job, n, f"s{n:02d}", "c", role, "gb") for n in names]
    sim = {(r["role_1"], r["role_2"]): r for r in marts.role_similarity(spark.createDataFrame(rows, ENR)).collect()}
    assert sim["A", "B"]["shared_skills_count"] == 12 and sim["A", "B"]["jaccard_similarity"] == 1.0
    assert sim["A", "B"]["top_shared_skills"] == [f"s{n:02d}" for n in range(10)]
    assert sim["A", "C"]["shared_skills_count"] == 0 and sim["A", "C"]["top_shared_skills"] is None
    assert sim["A", "C"]["role_1_unique_skills"] == 12
    moves = serve.role_transitions(spark.createDataFrame([r.asDict() for r in sim.values()]), role="B").collect()
    assert [(r["target_role"], r["difficulty"]) for r in moves] == [("A", "easy"), ("C", "significant")]


def test_rank_gap_between_countries(spark):
    """The first country by share has too few rows: its rank stays taken, the next one leads."""
    rows, job = [], 0
    for country, having, total in (("aa", 2, 2), ("bb", 6, 10), ("cc", 3, 10)):
        for i in range(total):
            job += 1
            rows.append((job, 1 if i < having else 2, "x" if i < having else "y", "c", "R", country))
    got = marts.skills_by_country(spark.createDataFrame(rows, ENR)).filter("skill_name = 'x'").collect()
    assert {r["country_code"]: r["rank_by_country"] for r in got} == {"bb": 2, "cc": 3}
    assert {r["top_country_for_skill"] for r in got} == {"bb"} and {r["top_country_demand_pct"] for r in got} == {60.0}


def test_cooccurrence_pruning_changes_nothing(spark):
    rows = [(j, s, f"s{s}", "c", "R", "gb") for j in range(40) for s in range(8) if (j * 7 + s * s) % (s + 2) < 2]
    enr = spark.createDataFrame(rows, ENR)
    whole = marts.skill_cooccurrence(enr, min_count=1)
    want = {tuple(r) for r in whole.filter("cooccurrence_count >= 6").collect()}
    assert {tuple(r) for r in marts.skill_cooccurrence(enr, min_count=6).collect()} == want and want


def test_upserts(spark):
    job = "job_platform_id string, country_code string, search_role string, title string, extracted_at timestamp_ntz, processed_at timestamp_ntz"
    old = spark.createDataFrame([("1", "gb", "R", None, T0, T0)], job)
    new = spark.createDataFrame([("1", "gb", "R", "new", T0, None), ("2", "gb", "R", "b", T0, None)], job)
    now = datetime(2024, 2, 1)
    once = stage.upsert_stage(old, new, as_of=now)
    assert {(r["job_platform_id"], r["title"], r["processed_at"]) for r in once.collect()} == {("1", None, now), ("2", "b", now)}
    assert {tuple(r) for r in stage.upsert_stage(once, new, as_of=now).collect()} == {tuple(r) for r in once.collect()}
    tag = "job_id long, skill_id long, skill_name string, mention_count long, extracted_at timestamp_ntz"
    a = spark.createDataFrame([(1, 1, "x", 5, T0), (1, 2, "y", 5, T0)], tag)
    b = spark.createDataFrame([(1, 1, "x", 2, now), (1, 1, "x", 9, T0), (3, 1, "x", 1, now)], tag)
    got = {(r[0], r[1]): r["mention_count"] for r in stage.upsert_tags(a, b).collect()}
    assert got == {(1, 1): 2, (1, 2): 5, (3, 1): 1}


def test_first_category_and_stable_ids(spark):
    rows = [(2, "New", "B", ""), (1, "New", "A", ""), (3, "Old", "Z", "")]
    facts = spark.createDataFrame(rows, "job_id long, skill_name string, category string, subcategory string")
    dim = spark.createDataFrame([(7, "Old", "Kept", "")], schemas.DIM_SKILLS)
    tagged, grown = stage.assign_tag_ids(facts, dim)
    by_name = {r["skill_name"]: r for r in grown.collect()}
    assert by_name["New"]["skill_category"] == "A" and by_name["Old"]["skill_category"] == "Kept"
    assert {r["skill_id"] for r in tagged.filter("skill_name = 'New'").collect()} == {by_name["New"]["skill_id"]}
    assert quality.dq_unique(grown, keys=["skill_id"]).count() == 0


def test_fixed_dimensions(spark):
    roles, countries = schemas.roles(spark), schemas.countries(spark)
    assert ingest.active_grid(roles, countries).count() == 15 * 18
    assert ingest.active_grid(roles, countries, role="Data Engineer", country="gb").count() == 1
    codes = spark.createDataFrame([("gb",), ("zz",)], "country_code string")
    assert {r["country_name"] for r in serve.region_names(codes, countries).collect()} == {"United Kingdom", "ZZ"}
    assert {r["country_name"] for r in serve.region_names(codes, countries, upper_fallback=False).collect()} == {"United Kingdom", "zz"}
    assert len(schemas.GENERIC_WORDS) == 52 and len(set(schemas.GENERIC_WORDS)) == 52
    days = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2023, 11, 1),)], "job_posted_at timestamp_ntz")
    assert ingest.recent_postings(days, as_of=date(2024, 1, 10), months=1).count() == 1


def test_search_takes_wildcards_literally(spark):
    lb = spark.createDataFrame(
        [("100% Real", "R", "gb", 2), ("1000 Reals", "R", "gb", 9)],
        "company_name string, search_role string, country_code string, job_count long",
    )
    assert [r["company_name"] for r in serve.company_search(lb, query="0% r").collect()] == ["100% Real"]


def test_shapes(spark):
    mix = spark.createDataFrame([(3, 0, 1)], "full_time long, part_time long, contract long")
    assert {(r[0], r[2]) for r in shape.contract_share(mix).collect()} == {("full_time", 0.75), ("contract", 0.25)}
    demand = spark.createDataFrame([("a", 3), (None, None), ("", 0)], "skill_category string, job_count long")
    assert {tuple(r) for r in shape.category_share(demand).collect()} == {("a", 3, 0.6), ("Other", 2, 0.4)}


def test_trend(spark):
    rows = [(date(2024, m, 1), "x", "R", "gb", n, p) for m, n, p in ((1, 5, 10.1), (2, 8, 10.4))]
    history = spark.createDataFrame(
        rows, "snapshot_date date, skill_name string, search_role string, country_code string, job_count long, demand_percentage double"
    )
    last = extras.skill_trend(history).orderBy(F.desc("snapshot_date")).first()
    assert (last["job_count_change"], last["percentage_change"]) == (3, 0.3)


def test_properties(spark, sf_dir):
    from tidemark.sources import mapping

    sim = marts.role_similarity(mapping.part_name_postings(spark, sf_dir), min_jobs=3)
    for r in sim.collect():
        assert 0 <= r["jaccard_similarity"] <= r["dice_coefficient"] <= r["overlap_coefficient"] <= 1
        j = r["jaccard_similarity"]
        assert abs(r["dice_coefficient"] - 2 * j / (1 + j)) < 2e-4


def test_a_missing_snapshot_is_no_step(spark):
    days = [date(2025, 1, d) for d in (1, 2, 3)]
    rows = [(d, "gap", "r", "gb", n, 1.0) for d, n in ((days[0], 5), (days[2], 9))]
    rows += [(d, "whole", "r", "gb", n, 1.0) for d, n in zip(days, (1, 3, 6), strict=True)]
    history = spark.createDataFrame(
        rows, "snapshot_date date, skill_name string, search_role string, country_code string, job_count long, demand_percentage double"
    )
    got = {(r["skill_name"], r["snapshot_date"]): r["job_count_change"] for r in extras.skill_trend(history).collect()}
    assert [got["whole", d] for d in days] == [None, 2, 3]
    assert got["gap", days[0]] is None and got["gap", days[2]] is None


UNCUT = ("demand_top_global", "category_share", "snapshot_demand", "skill_trend", "leaderboard_global", "contract_mix", "company_search")


@pytest.mark.parametrize("key", UNCUT)
def test_totals_search_and_history_do_not_depend_on_the_cut_of_a_mart(spark, sf_dir, monkeypatch, key):
    want = sorted(map(str, catalog.QUERIES[key](spark, sf_dir).collect()))
    for mart in (marts.skill_demand, marts.company_leaderboard):
        monkeypatch.setitem(mart.__kwdefaults__, "top_n", 1)
    assert sorted(map(str, catalog.QUERIES[key](spark, sf_dir).collect())) == want
