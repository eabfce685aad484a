"""Streams against the batch they stand for."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import discovery, ingest, stage, text
from tidemark.plans import build
from tidemark.session import scratch_dir
from tidemark.sources import landing, mapping
from tidemark.streaming.discoveries import _count_up, stream_discoveries, stream_totals
from tidemark.streaming.ingest import stream_ingest


def write_page(spark, folder, name, ids):
    results = ",".join(f'{{"id":{i},"title":"t{i}"}}' for i in ids)
    rows = spark.createDataFrame([(f'{{"results":[{results}],"count":{len(ids)}}}',)], "value string")
    rows.coalesce(1).write.mode("append").text(f"{folder}/search_role=R/country_code=gb")


def test_ingest_takes_only_what_is_new(spark):
    out = scratch_dir(spark, "test-ingest")
    pages = f"{out}/pages"
    write_page(spark, pages, "a", [1, 2, 3])
    write_page(spark, pages, "b", [3, 4])
    stream_ingest(spark, pages, out, f"{out}/check", max_files=1).awaitTermination()
    first = spark.read.parquet(f"{out}/stg_jobs")
    assert sorted(int(r["job_platform_id"]) for r in first.collect()) == [1, 2, 3, 4]
    write_page(spark, pages, "c", [4, 5])
    stream_ingest(spark, pages, out, f"{out}/check", max_files=1).awaitTermination()
    again = spark.read.parquet(f"{out}/stg_jobs")
    assert sorted(int(r["job_platform_id"]) for r in again.collect()) == [1, 2, 3, 4, 5]
    stream_ingest(spark, pages, out, f"{out}/check", max_files=1).awaitTermination()
    assert spark.read.parquet(f"{out}/raw").count() == 5
    whole = landing.land_postings(spark, pages, batch_id="b", as_of=datetime(2024, 1, 1))
    assert whole.select("job_platform_id").distinct().count() == 5


def rows_read(spark, since):
    """Rows that stages from ``since`` on have read, and the number of the next stage."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    held = [(s.stageId(), s.inputRecords()) for s in (stages.apply(k) for k in range(stages.size()))]
    return sum(n for k, n in held if k >= since), 1 + max((k for k, _ in held), default=-1)


def test_a_batch_reads_its_own_rows_only(spark):
    """Twenty batches of new and known postings: what a batch reads does not grow, and the whole is the batch job."""
    out = scratch_dir(spark, "test-flat")
    read, stage_id = [], rows_read(spark, 0)[1]
    for k in range(20):
        write_page(spark, f"{out}/pages", "p", range(k * 50, k * 50 + 100))
        _, stage_id = rows_read(spark, stage_id)
        stream_ingest(spark, f"{out}/pages", out, f"{out}/check").awaitTermination()
        n, stage_id = rows_read(spark, stage_id)
        read.append(n)
    assert max(read[1:]) <= 1.2 * min(read[1:]), read
    pages = landing.land_postings(spark, f"{out}/pages", batch_id="b", as_of=datetime(2024, 1, 1))
    want = ingest.dedup_first_wins(pages, None)
    got = spark.read.parquet(f"{out}/raw")
    columns = ["id", "job_platform_id", "search_role", "country_code", "raw_data"]
    assert got.count() == want.count() == 1050
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0


def test_landed_text_is_the_page_s_own_and_a_bad_result_costs_no_page(spark):
    """Keys in the page's order; a result with a key twice is quarantined and does not take its neighbours with it."""
    out = scratch_dir(spark, "test-text")
    results = ['{"title":"b","id":1,"x":1.50}', '{"id":2,"id":2}', '{"title":"c"}', "null", "7", '{"id":"3"}']
    rows = spark.createDataFrame([(f'{{"results":[{",".join(results)}],"count":6}}',)], "value string")
    rows.coalesce(1).write.text(f"{out}/pages/search_role=R/country_code=gb")
    stream_ingest(spark, f"{out}/pages", out, f"{out}/check").awaitTermination()
    raw = {r["job_platform_id"]: r["raw_data"] for r in spark.read.parquet(f"{out}/raw").collect()}
    assert raw["1"] == results[0] and raw["3"] == results[5]
    assert {r["job_platform_id"] for r in spark.read.parquet(f"{out}/quarantine").collect()} == {"2"}
    assert {r["job_platform_id"] for r in spark.read.parquet(f"{out}/stg_jobs").collect()} == {"1", "3"}


def test_the_first_role_of_a_batch_wins(spark):
    out = scratch_dir(spark, "test-first")
    for role in ("B", "A", "C"):
        rows = spark.createDataFrame([(f'{{"results":[{{"id":1,"title":"{role}"}}],"count":1}}',)], "value string")
        rows.coalesce(1).write.text(f"{out}/pages/search_role={role}/country_code=gb")
    stream_ingest(spark, f"{out}/pages", out, f"{out}/check").awaitTermination()
    assert [r["search_role"] for r in spark.read.parquet(f"{out}/raw").collect()] == ["A"]


def test_a_horizon_bounds_the_state(spark):
    out = scratch_dir(spark, "test-horizon")
    for ids in ([1, 2, 3], [3, 4], [4, 5]):
        write_page(spark, f"{out}/pages", "p", ids)
        query = stream_ingest(spark, f"{out}/pages", out, f"{out}/check", horizon="1 hour")
        query.awaitTermination()
    assert sorted(int(r["job_platform_id"]) for r in spark.read.parquet(f"{out}/stg_jobs").collect()) == [1, 2, 3, 4, 5]


def staged(spark, sf_dir, out, files):
    jobs, _ = stage.flatten_posting(mapping.document_postings(spark, sf_dir))
    jobs.withColumn("processed_at", F.col("extracted_at")).repartition(files, "job_id").write.parquet(f"{out}/staged")
    return jobs


def test_one_batch_is_the_batch_job(spark, sf_dir):
    out = scratch_dir(spark, "test-discoveries")
    jobs = staged(spark, sf_dir, out, 2)
    taxonomy = mapping.taxonomy(spark)
    stream_discoveries(spark, f"{out}/staged", out, f"{out}/check", taxonomy=taxonomy).awaitTermination()
    docs = stage.posting_texts(jobs)
    merged, new = text.hybrid_extract(docs, text.taxonomy_terms(taxonomy))
    want = discovery.discoveries(new.join(docs.select("job_id", "context", "seen_at"), "job_id"))
    columns = ["skill_key", "name", "occurrence_count", "avg_confidence", "first_seen", "sample_contexts"]
    got = stream_totals(spark, out, f"{out}/check")
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert spark.read.parquet(f"{out}/job_skills").count() == merged.count()
    facts, dim = stage.assign_tag_ids(merged, spark.createDataFrame([], schemas.DIM_SKILLS))
    named = ["job_id", "skill_id", "skill_name", "mention_count", "verified", "extraction_method"]
    assert spark.read.parquet(f"{out}/stg_job_skills").select(named).exceptAll(facts.select(named)).count() == 0
    assert spark.read.parquet(f"{out}/stg_job_skills").count() == facts.count()
    grown = spark.read.parquet(f"{out}/dim_skills").select(dim.columns)
    assert grown.exceptAll(dim).count() == dim.exceptAll(grown).count() == 0
    fit = {r["skill_key"] for r in discovery.promotion_candidates(want).collect()}
    assert {r["skill_key"] for r in got.filter("is_promoted").collect()} == fit


def test_totals_over_batches_and_restarts_are_the_batch_job(spark, sf_dir):
    """One file a batch, stopped and started anew, and a batch run again: the same ten columns as all at once."""
    out = scratch_dir(spark, "test-totals")
    jobs = staged(spark, sf_dir, out, 3)
    run = {"taxonomy": mapping.taxonomy(spark), "max_files": 1, "min_count": 10**9, "mode": "discover_all"}
    stream_discoveries(spark, f"{out}/staged", out, f"{out}/check", **run).awaitTermination()
    late = jobs.withColumn("job_id", F.col("job_id") + 1).withColumn("processed_at", F.col("extracted_at"))
    late.coalesce(1).write.mode("append").parquet(f"{out}/staged")
    stream_discoveries(spark, f"{out}/staged", out, f"{out}/check", **run).awaitTermination()
    # The last batch's counts once more, as if it had failed after they were counted.
    last = spark.read.schema(discovery.COUNTED).parquet(f"{out}/counts/batch=3")
    last.write.parquet(f"{out}/again")
    spark.read.parquet(f"{out}/again").write.mode("overwrite").parquet(f"{out}/counts/batch=3")
    assert _count_up(spark, out, f"{out}/check-totals")
    docs = stage.posting_texts(jobs.unionByName(late.select(jobs.columns)))
    _, new = text.hybrid_extract(docs, text.taxonomy_terms(mapping.taxonomy(spark)), mode="discover_all")
    want = discovery.discoveries(new.join(docs.select("job_id", "context", "seen_at"), "job_id"))
    got = stream_totals(spark, out, f"{out}/check").select(want.columns)
    assert want.columns == ["skill_key", "name", "category", "subcategory", "first_seen", "last_seen", "occurrence_count", "avg_confidence", "sample_contexts", "is_promoted"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_promoted_term_is_known_to_the_next_batch(spark, sf_dir):
    out = scratch_dir(spark, "test-promotion")
    staged(spark, sf_dir, out, 3)
    run = {"taxonomy": mapping.taxonomy(spark), "max_files": 1, "min_count": 2, "min_confidence": 0.5}
    stream_discoveries(spark, f"{out}/staged", out, f"{out}/check", **run).awaitTermination()
    promoted = spark.read.parquet(f"{out}/promoted")
    assert promoted.select(F.lower("name")).distinct().count() == promoted.count() > 0
    early = promoted.filter("batch = 0").select(F.lower("name").alias("k"))
    later = spark.read.parquet(f"{out}/counts").filter("batch > 0")
    assert later.join(early, later["skill_key"] == early["k"]).count() == 0


def test_build_and_snapshots(spark, sf_dir):
    out = scratch_dir(spark, "test-build")
    tags, dim, jobs = (f(spark, sf_dir) for f in (mapping.job_skills, mapping.skills, mapping.jobs))
    built = build.build(spark, tags, dim, jobs, out, as_of=date(2024, 1, 1))
    assert built["skill_demand"].filter("search_role = 'BUILDING'").count() > 0
    assert built["skill_demand"].first()["period_start"] == date(2023, 12, 2)
    for day in (date(2024, 1, 1), date(2024, 1, 8), date(2024, 1, 8)):
        stage.write_snapshot(stage.snapshot_demand(built["skill_demand"], as_of=day), f"{out}/history")
    assert spark.read.parquet(f"{out}/history").count() == 2 * built["skill_demand"].count()
