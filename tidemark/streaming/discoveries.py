"""Skill extraction over a stream of staged postings, with a taxonomy that grows between batches.

A batch reads the taxonomy as earlier batches left it and writes its facts and its counts per new term. The
counts go through a second stream, whose state keeps one total per term: a batch touches the totals of its own
terms and reads no earlier counts. Terms that have become frequent are promoted. Totals remember the last batch they hold,
so running a batch again adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidemark.operators import discovery, stage, text
from tidemark.schemas import DIM_SKILLS, STG_JOBS, TAXONOMY
from tidemark.streaming.ingest import batch_path, earlier, keep_state_on_disk

MAX_CONTEXTS = 5


def _in_micros(kind: T.DataType) -> T.DataType:
    """Times as whole microseconds, which pass through Python unchanged."""
    if isinstance(kind, T.TimestampNTZType):
        return T.LongType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_in_micros(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _in_micros(f.dataType)) for f in kind])
    return kind


#: A total: the counted columns without the key, and the last batch it holds.
TOTAL = T.StructType([*_in_micros(discovery.COUNTED).fields[1:], T.StructField("batch", T.LongType())])
CONTEXT = TOTAL["contexts"].dataType.elementType.fieldNames()
TOUCHED = T.StructType([T.StructField("skill_key", T.StringType()), *TOTAL.fields])


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def _micros(time: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _epoch(), time)


def _time(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, _epoch())


def _with_times(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    entry = lambda c: F.struct(change(c["seen_at"]).alias("seen_at"), c["job_id"], c["position"], c["context"])
    return df.withColumns(
        {c: change(F.col(c)) for c in ("seen_at", "last_seen")} | {"contexts": F.transform("contexts", entry)}
    )


class Totals(StatefulProcessor):
    """Per term: what all batches so far counted. A batch brings one row, added up before it comes here."""

    def init(self, handle) -> None:
        self.total = handle.getValueState("total", TOTAL)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        total = None
        if self.total.exists():
            held = self.total.get()
            total = (*held[:9], [tuple(c) for c in held[9]], held[10])
        for row in sorted(rows, key=lambda r: r.batch):
            total = added(total, row)
        self.total.update(total)
        contexts = [Row(**dict(zip(CONTEXT, c, strict=True))) for c in total[9]]
        yield Row(**dict(zip(TOUCHED.fieldNames(), (key[0], *total[:9], contexts, total[10]), strict=True)))

    def close(self) -> None:
        pass


def added(total: tuple | None, row) -> tuple:
    """The total with the counts of one more batch; those of a batch it holds already leave it as it is."""
    sight = (int(row.seen_at), int(row.job_id), int(row.position), row.name, row.category, row.subcategory)
    contexts = [tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in row.contexts]
    one = (*sight, int(row.last_seen), int(row.occurrence_count), int(row.thousandths), contexts, int(row.batch))
    if total is None:
        return one
    if total[10] >= one[10]:
        return total
    first = min(total, one, key=lambda t: t[:3])[:6]
    both = sorted([*total[9], *contexts], key=lambda c: c[:3])[:MAX_CONTEXTS]
    return (*first, max(total[6], one[6]), total[7] + one[7], total[8] + one[8], both, one[10])


def _count_up(spark: SparkSession, out: str, checkpoint: str) -> list[int]:
    """Take new counts into the totals; the numbers of the ``touched`` folders written."""
    whole = T.StructType([*discovery.COUNTED.fields, T.StructField("batch", T.LongType())])
    parts = spark.readStream.schema(whole).option("ignoreMissingFiles", True).parquet(f"{out}/counts")
    totals = _with_times(parts, _micros).groupBy("skill_key").transformWithState(Totals(), TOUCHED, "Update", "None")
    runs: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(batch_path(out, "touched", number))
        runs.append(number)

    query = totals.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    return runs


def stream_discoveries(
    spark: SparkSession,
    staged: str,
    out: str,
    checkpoint: str,
    *,
    taxonomy: DataFrame,
    finder: text.Finder | None = None,
    max_files: int = 100,
    min_count: int = 3,
    min_confidence: float = 0.75,
    mode: str = "hybrid",
) -> StreamingQuery:
    """Extract skills from staged postings not seen before, then stop.

    Writes ``job_skills`` (all columns of the merge), ``stg_job_skills`` and ``dim_skills`` (facts with ids, and
    the skills each batch was the first to find), ``counts`` (new terms per batch), ``touched`` (totals that a
    batch moved) and ``promoted`` (taxonomy entries) under ``out``; an entry promoted by one batch is known to
    the next. :func:`stream_totals` reads the totals.
    """
    keep_state_on_disk(spark)
    jobs = spark.readStream.schema(STG_JOBS).option("maxFilesPerTrigger", max_files).parquet(staged)

    def extract(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        promoted = earlier(session, out, "promoted", TAXONOMY, number)
        known = taxonomy if promoted is None else taxonomy.unionByName(promoted, allowMissingColumns=True)
        docs = stage.posting_texts(batch)
        merged, _ = text.hybrid_extract(docs, text.taxonomy_terms(known), finder=finder, mode=mode)
        merged.write.mode("overwrite").parquet(batch_path(out, "job_skills", number))
        skills = session.read.schema(merged.schema).parquet(batch_path(out, "job_skills", number))

        before = earlier(session, out, "dim_skills", DIM_SKILLS, number)
        dim = session.createDataFrame([], DIM_SKILLS) if before is None else before
        facts, grown = stage.assign_tag_ids(skills, dim)
        stamped = facts.select("job_id", "skill_id", "skill_name", "mention_count", "verified", "extraction_method").join(
            batch.select("job_id", "extracted_at"), "job_id"
        )
        stamped.write.mode("overwrite").parquet(batch_path(out, "stg_job_skills", number))
        fresh = grown.join(dim.select("skill_id"), "skill_id", "left_anti").select(DIM_SKILLS.fieldNames())
        fresh.write.mode("overwrite").parquet(batch_path(out, "dim_skills", number))

        seen = text.new_discoveries(skills).join(docs.select("job_id", "context", "seen_at"), "job_id")
        counts = discovery.count_discoveries(seen, max_contexts=MAX_CONTEXTS)
        counts.write.mode("overwrite").parquet(batch_path(out, "counts", number))
        runs = _count_up(session, out, f"{checkpoint}-totals")
        fit = known.sparkSession.createDataFrame([], TAXONOMY)
        if runs:
            touched = session.read.schema(TOUCHED).parquet(*[batch_path(out, "touched", n) for n in runs])
            shown = discovery.shown_discoveries(_with_times(touched.filter(F.col("batch") == number), _time))
            there = known.select(F.lower("name").alias("skill_key"))
            fit = discovery.promotion_candidates(shown, min_count=min_count, min_confidence=min_confidence)
            fit = fit.join(there, "skill_key", "left_anti").select(
                "name", "category", "subcategory", F.array().cast("array<string>").alias("aliases")
            )
        fit.write.mode("overwrite").parquet(batch_path(out, "promoted", number))

    return (
        jobs.writeStream.foreachBatch(extract)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_totals(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    """Discoveries of all batches so far, with those promoted marked: read from the state, not added up again."""
    state = spark.read.format("statestore").option("stateVarName", "total").load(f"{checkpoint}-totals")
    totals = discovery.shown_discoveries(_with_times(state.select("key.skill_key", "value.*"), _time))
    promoted = spark.read.schema(TAXONOMY).parquet(f"{out}/promoted").select(F.lower("name").alias("skill_key")).distinct()
    marked = totals.drop("is_promoted").join(promoted.withColumn("_p", F.lit(True)), "skill_key", "left")
    return marked.withColumn("is_promoted", F.coalesce("_p", F.lit(False))).drop("_p")
