"""Stored tables: buckets that are upserted, folders by date, sketches, stream figures, catalog objects."""

from __future__ import annotations

import os
import re
from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.operators import ingest, marts, sketches, stage
from tidemark.plans import build, objects
from tidemark.session import saved, scratch_dir
from tidemark.sources import mapping
from tidemark.streaming import progress
from tidemark.streaming.ingest import stream_ingest

TAGS = "job_id bigint, skill_id bigint, mention_count bigint, extracted_at timestamp_ntz"
KEYS = ("job_id", "skill_id")


def tags(spark, jobs, count, day):
    return spark.createDataFrame([(j, j % 3, count, datetime(2024, 1, day)) for j in jobs], TAGS)


def files(path):
    found = {}
    for folder in os.listdir(path):
        if folder.startswith("bucket="):
            found[int(folder[7:])] = sorted(f for f in os.listdir(f"{path}/{folder}") if f.endswith(".parquet"))
    return found


def test_an_upsert_leaves_other_buckets_alone(spark):
    path = scratch_dir(spark, "test-buckets")
    old, new = tags(spark, range(500), 1, 1), tags(spark, [3, 7, 700], 9, 2)
    stage.write_buckets(old, path, keys=KEYS, buckets=32)
    before = files(path)
    touched = stage.upsert_into(path, new, stage.upsert_tags, keys=KEYS, buckets=32)
    after = files(path)
    assert 1 <= len(touched) <= 3
    assert {b for b in after if after[b] != before.get(b)} == set(touched)
    want = stage.upsert_tags(old, new)
    for _ in range(2):  # once more, as after a failure
        got = stage.read_buckets(spark, path, old.schema).drop("bucket")
        assert got.count() == want.count() == 501
        assert got.exceptAll(want).count() == 0
        stage.upsert_into(path, new, stage.upsert_tags, keys=KEYS, buckets=32)
    assert stage.upsert_into(path, new.limit(0), stage.upsert_tags, keys=KEYS, buckets=32) == []
    assert stage.read_buckets(spark, path, old.schema).count() == 501


def test_an_upsert_reads_its_buckets_only(spark):
    path = scratch_dir(spark, "test-pruned")
    stage.write_buckets(tags(spark, range(500), 1, 1), path, keys=KEYS, buckets=32)
    some = stage.read_buckets(spark, path, tags(spark, [], 1, 1).schema).filter(F.col("bucket").isin([1, 2]))
    assert some.inputFiles() and "PartitionFilters: [isnotnull(bucket" in some._jdf.queryExecution().executedPlan().toString() or "bucket#" in re.search(
        r"PartitionFilters: \[([^\]]*)", some._jdf.queryExecution().executedPlan().toString()
    ).group(1)


def test_recent_postings_read_recent_folders(spark, sf_dir):
    path = scratch_dir(spark, "test-dates")
    jobs = mapping.jobs(spark, sf_dir).withColumn("job_posted_at", F.when(F.col("job_id") % 50 != 0, F.col("job_posted_at")))
    ingest.save_by_date(jobs, path)
    stored = ingest.read_by_date(spark, path, jobs.schema)
    recent = ingest.recent_postings(stored, as_of=date(1998, 8, 2), days=30)
    want = ingest.recent_postings(jobs, as_of=date(1998, 8, 2), days=30)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "posted_date" in re.search(r"PartitionFilters: \[([^\]]*)", plan).group(1)
    assert recent.columns == jobs.columns
    assert recent.exceptAll(want).count() == want.exceptAll(recent).count() == 0
    assert stored.count() == jobs.count()
    metrics = recent._jdf.queryExecution().executedPlan()
    assert metrics is not None and len(stored.filter(F.col("posted_date") >= "1998-07-03").inputFiles()) > 0


def test_sketches_merge_within_their_errors(spark):
    rows = spark.range(200_000).select(
        (F.col("id") % 7).alias("fine"), (F.col("id") % 2).alias("coarse"), (F.col("id") * 31 % 50_021).alias("job"), (F.col("id") * 17 % 10_007).alias("pay")
    )
    stored = saved(sketches.segment_sketches(rows, ["fine", "coarse"], count="job", measure="pay"), "test-sketches")
    exact = {r[0]: r[1] for r in rows.groupBy("coarse").agg(F.count_distinct("job")).collect()}
    for r in sketches.distinct_estimates(stored, ["coarse"]).collect():
        assert abs(r["estimate"] - exact[r["coarse"]]) <= sketches.distinct_error() * exact[r["coarse"]]
    whole = sketches.distinct_estimates(stored.withColumn("all", F.lit(1)), ["all"]).head()
    assert abs(whole["estimate"] - 50_021) <= sketches.distinct_error() * 50_021
    for r in sketches.quantile_estimates(stored, ["coarse"], [0.1, 0.5, 0.9]).collect():
        mine = rows.filter(F.col("coarse") == r["coarse"])
        assert r["values"] == mine.count()
        for q, v in zip([0.1, 0.5, 0.9], r["quantiles"], strict=True):
            assert abs(mine.filter(F.col("pay") <= v).count() / r["values"] - q) <= 2 * 0.0133
    empty = sketches.segment_sketches(rows.limit(0), ["fine"], count="job", measure="pay")
    assert sketches.distinct_estimates(empty, ["fine"]).count() == sketches.quantile_estimates(empty, ["fine"], [0.5]).count() == 0
    nulls = sketches.segment_sketches(spark.createDataFrame([(1, None), (1, 5)], "g int, v int"), ["g"], count="v", measure="v")
    assert sketches.distinct_estimates(nulls, ["g"]).head()["estimate"] == 1
    assert sketches.quantile_estimates(nulls, ["g"], [0.5]).head()["values"] == 1


def test_a_stream_reports_its_batches(spark):
    out = scratch_dir(spark, "test-progress")
    listener = progress.ProgressTable(spark, f"{out}/progress")
    spark.streams.addListener(listener)
    try:
        for ids in ([1, 2, 3], [3, 4], [5]):
            results = ",".join(f'{{"id":{i}}}' for i in ids)
            page = spark.createDataFrame([(f'{{"results":[{results}],"count":{len(ids)}}}',)], "value string")
            page.coalesce(1).write.mode("append").text(f"{out}/pages/search_role=R/country_code=gb")
            listener.wait(stream_ingest(spark, f"{out}/pages", out, f"{out}/check", max_files=1))
    finally:
        spark.streams.removeListener(listener)
    batches = progress.batch_progress(spark, f"{out}/progress")
    assert sorted((r["batch_id"], r["fetched"], r["inserted"]) for r in batches.collect()) == [(0, 3, 3), (1, 2, 1), (2, 1, 1)]
    total = progress.run_totals(batches).collect()
    assert [(r["total_fetched"], r["total_inserted"], r["duplicates_skipped"], r["known_keys"]) for r in total] == [(6, 5, 1, 5)]
    assert all(r["duration_ms"] > 0 and r["started_at"] is not None for r in batches.collect())


def test_saved_rows_hold_no_long_text(spark, sf_dir):
    jobs = mapping.jobs(spark, sf_dir).withColumn("description", F.repeat(F.col("title"), 100))
    enr = marts.enriched(mapping.job_skills(spark, sf_dir), mapping.skills(spark, sf_dir), jobs)
    kept = build.save_enriched(enr, scratch_dir(spark, "test-narrow"))
    assert "description" in enr.columns and "description" not in kept.columns
    narrow = enr.select(*[c for c in enr.columns if c in marts.MART_COLUMNS])
    assert "description" not in narrow._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_functions_are_inlined(spark):
    objects.register_functions(spark)
    row = spark.sql("SELECT currency_by_region('gb') a, currency_by_region('xx') b, currency_by_region(NULL) c, value_midpoint(10, NULL) d, value_midpoint(10, 15) e").head()
    assert (row["a"], row["b"], row["c"], float(row["d"]), float(row["e"])) == ("GBP", "USD", "USD", 10.0, 12.5)
