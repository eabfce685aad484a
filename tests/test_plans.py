"""What the physical plans must and must not hold."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.operators import ingest, marts, text
from tidemark.plans import build, catalog
from tidemark.session import scratch_dir
from tidemark.sources import mapping


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_and_no_python(spark, sf_dir):
    for key in ("skill_demand", "skill_cooccurrence", "salary_by_skill", "company_leaderboard", "role_similarity",
                "skills_by_country", "active_grid", "hybrid_extract", "discoveries", "skill_gap"):
        shown = plan(catalog.QUERIES[key](spark, sf_dir))
        assert not re.search(r"Cartesian|NestedLoop|Python|Pandas|ArrowEval", shown), key


def test_copies_of_a_key_leave_before_the_shuffle(spark, sf_dir):
    shown = plan(ingest.dedup_first_wins(catalog._event_rows(spark, sf_dir), None))
    assert shown.count("WindowGroupLimit") == 2
    assert shown.count("WindowGroupLimit") == plan(marts.skill_demand(mapping.postings(spark, sf_dir))).count("WindowGroupLimit")


def test_texts_are_not_shuffled(spark, sf_dir):
    found = text.extract_terms(mapping.documents(spark, sf_dir), catalog._terms(spark))
    shown = plan(found)
    assert "BroadcastHashJoin" in shown
    exchanges = [line for line in shown.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "job_id" in exchanges[0]
    wide = found.join(mapping.documents(spark, sf_dir).select("job_id", "context"), "job_id")
    assert "lowered" not in " ".join(re.findall(r"Exchange.*", plan(wide)))


def test_scans_read_what_they_need(spark, sf_dir):
    shown = plan(marts.company_segments(mapping.jobs(spark, sf_dir)))
    schema = re.search(r"FileScan parquet \[([^\]]*o_orderkey[^\]]*)\]", shown).group(1)
    assert "o_orderdate" not in schema
    recent = ingest.recent_postings(mapping.jobs(spark, sf_dir), as_of=__import__("datetime").date(1998, 8, 2), days=30)
    assert "GreaterThanOrEqual(o_orderdate" in plan(recent)


def test_bucketed_rows_join_by_job_without_a_shuffle(spark, sf_dir):
    saved = build.save_enriched(
        mapping.postings(spark, sf_dir), scratch_dir(spark, "bucketed"), table="bucketed_postings", buckets=4
    )
    one = saved.select("job_id", F.col("skill_id").alias("a"))
    two = saved.select("job_id", F.col("skill_id").alias("b"))
    joined = one.hint("merge").join(two, "job_id").filter("a < b")
    assert "Exchange hashpartitioning" not in plan(joined)
    assert plan(marts.jobs_per_segment(saved)).count("Exchange hashpartitioning") == 1
    want = {tuple(r) for r in marts.skill_cooccurrence(mapping.postings(spark, sf_dir)).collect()}
    assert {tuple(r) for r in marts.skill_cooccurrence(saved).collect()} == want
    spark.sql("DROP TABLE bucketed_postings")


def test_lines_are_dealt_by_job_in_tasks_of_one_size(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mapping, "TASK_ROWS", 100)
    n = -(-mapping.table(spark, sf_dir, "lineitem").count() // 100)
    assert "job_id#" in plan(mapping.job_skills(spark, sf_dir)) and f", {n}), REPARTITION_BY_NUM" in plan(mapping.job_skills(spark, sf_dir))
