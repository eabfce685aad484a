"""Finding taxonomy terms and new candidates in posting text.

``docs`` hold ``job_id`` and ``text``. The text itself never goes through a shuffle: matching is
done where the text is read and only (job, term) rows move on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.functions.patterns import WORD, potential_terms, segments, special_terms, term_pattern
from tidemark.schemas import CANDIDATES, generic_words, label_categories

# Terms that hold no word at all, which are rare; more of them are an error.
BARE_TERMS = 1000
# Up to so many first words of terms are looked for within the scan; with more of them, every word meets the join.
ANCHORS = 10_000

Finder = Callable[[], Callable[[list[str]], list[list[dict]]]]


def taxonomy_terms(taxonomy: DataFrame) -> DataFrame:
    """One row per name or alias, with the name it stands for."""
    alias = F.coalesce("aliases", F.array().cast("array<string>"))
    return taxonomy.select(
        F.explode(F.concat(F.array("name"), alias)).alias("term"),
        F.col("name").alias("canonical"),
        F.coalesce("category", F.lit("Unknown")).alias("category"),
        F.coalesce("subcategory", F.lit("")).alias("subcategory"),
    )


def compile_terms(terms: DataFrame, *, special: str = "full", strict: bool = False) -> DataFrame:
    """Terms with their ``pattern`` and the parts by which texts are searched for them.

    ``kind`` is 'word' for a term that is a single word, 'own' for one with a pattern of its own, else 'phrase'.
    ``core`` holds the term's words and what stands between them, ``lead`` and ``trail`` the symbols before and
    after; ``anchor`` is its first word. A term is its own ``rival`` if it can begin before it has ended.
    """
    term = F.col("term")
    own = term.isin(*special_terms(special))
    is_word = F.rlike(term, F.lit(rf"^{WORD}+$"))
    read = terms.select("*", own.alias("_own"), segments(F.lower(term)).alias("_parts"))
    parts, none = F.col("_parts"), F.lit("")
    starts, ends = (F.rlike(F.element_at(parts, k), F.lit(f"^{WORD}")) for k in (1, -1))
    n, lead = F.size(parts), F.when(starts, 0).otherwise(1)
    length = F.greatest(n - lead - F.when(ends, 0).otherwise(1), F.lit(0))
    core = F.slice(parts, lead + 1, length)
    first = F.get(core, 0)
    # Some words at the start are those at the end, and the same stands between them.
    border = lambda b: F.slice(core, F.lit(1), b * 2 - 1) == F.slice(core, F.size(core) - b * 2 + 2, b * 2 - 1)
    shorter = F.when(length > 1, F.sequence(F.lit(1), F.floor(length / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    return read.select(
        *terms.columns,
        term_pattern(term, special=special, strict=strict).alias("pattern"),
        F.when(F.col("_own"), "own").when(is_word, "word").otherwise("phrase").alias("kind"),
        F.when(~F.col("_own"), first).alias("anchor"),
        F.when(starts, none).otherwise(F.element_at(parts, 1)).alias("lead"),
        core.alias("core"),
        F.when(ends | (n < 2), none).otherwise(F.element_at(parts, -1)).alias("trail"),
        F.exists(shorter, border).alias("rival"),
    )


def _beginnings(texts: DataFrame, words: list[int], before: int, after: int, anchors: list[str] | None) -> DataFrame:
    """A row for each word of a text and each number of ``words``: the hash of so many words and what is between.

    With ``anchors``, only for words that some term begins with. Words are unfolded to rows first and hashed after that
    choice, so that Spark compiles the whole way; functions over arrays it would interpret word by word.
    ``before`` and ``after`` are how many symbols beside them are kept, one more than any term has; a blank
    stands for the start and the end of the text, which no word character can precede or follow.
    """
    parts, word, i = F.col("parts"), F.col("word"), F.col("place")
    n = F.size(parts)
    start = F.when(F.rlike(F.get(parts, 0), F.lit(f"^{WORD}")), 0).otherwise(1).alias("start")
    placed = texts.select("job_id", "parts", start).select("job_id", "parts", "start", F.posexplode_outer("parts").alias("at", "word"))
    chosen = F.col("at") % 2 == F.col("start") if anchors is None else word.isin(anchors)
    placed = placed.filter(chosen).select("job_id", "parts", "word", (F.col("at") + 1).alias("place"))

    left = F.concat(F.when(i == 2, " ").otherwise(""), F.coalesce(F.get(parts, i - 2), F.lit("")))
    left = F.when(i == 1, "").otherwise(F.right(left, F.lit(before)))

    def right(k: int) -> Column:
        whole = F.concat(F.get(parts, i + (2 * k - 2)), F.when(i + (2 * k - 1) == n, " ").otherwise(""))
        return F.coalesce(F.left(whole, F.lit(after)), F.lit(""))

    def key(k: int) -> Column:
        return F.when(i + (2 * k - 2) <= n, F.xxhash64(F.slice(parts, i, F.lit(2 * k - 1))))

    each = [F.struct(key(k).alias("key"), *([right(k).alias("right")] if after else [])) for k in words]
    edge = [left.alias("left")] if before else []
    return placed.select("job_id", "word", "place", *edge, F.inline_outer(F.array(*each)))


def _edges(strict: bool, before: int, after: int) -> Column:
    """Whether the symbols beside the words are those of the term, and no word character touches them."""
    ok = F.lit(True)
    if before:
        there = F.col("left") == F.col("lead") if strict else F.endswith("left", F.col("lead")) & (F.length("left") > F.length("lead"))
        ok = ok & ((F.col("lead") == "") | there)
    if after:
        there = F.col("right") == F.col("trail") if strict else F.startswith("right", F.col("trail")) & (F.length("right") > F.length("trail"))
        ok = ok & ((F.col("trail") == "") | there)
    return ok


def _by_pattern(texts: DataFrame, terms: list[Row]) -> DataFrame:
    """Mentions of the few terms that no word leads to, counted where the text is read."""
    counts = [
        F.struct(
            F.lit(t["term"]).alias("term"),
            F.when(F.contains("lowered", F.lit(t["probe"])), F.regexp_count("text", F.lit(t["pattern"]))).otherwise(0).alias("n"),
        )
        for t in terms
    ]
    some = F.filter(F.array(*counts), lambda c: c["n"] > 0)
    return texts.select("job_id", F.inline_outer(some)).filter("n > 0")


def extract_terms(docs: DataFrame, terms: DataFrame, *, special: str = "full", strict: bool = False) -> DataFrame:
    """Taxonomy terms found per job with their number of mentions; counts of a name and its aliases add up.

    However many terms there are, the plan is the same: each word of a text goes on with the hashes of the words
    that begin with it, as many as some term has, and these meet the terms' hashes in one join. The text stays
    where it is read. Terms with a pattern of their own, a fixed list, and terms without a word are counted by
    pattern within the scan.
    """
    compiled = compile_terms(terms, special=special, strict=strict).withColumn("words", ((F.size("core") + 1) / 2).cast("int"))
    bare = (F.col("kind") == "own") | (F.size("core") == 0)
    # One row: the numbers of words, and the longest symbols, that the terms have.
    shape = compiled.filter(~bare).agg(
        F.sort_array(F.collect_set("words")).alias("words"),
        F.coalesce(F.max(F.length("lead")), F.lit(0)).alias("lead"),
        F.coalesce(F.max(F.length("trail")), F.lit(0)).alias("trail"),
        F.coalesce(F.bool_or("rival"), F.lit(False)).alias("rival"),
    ).head()
    stem = F.when(F.col("term").endswith(".js"), F.substring_index("term", ".js", 1)).otherwise(F.col("term"))
    few = compiled.filter(bare).select("term", "pattern", F.lower(stem).alias("probe")).distinct().limit(BARE_TERMS + 1).collect()
    if len(few) > BARE_TERMS:
        raise ValueError(f"more than {BARE_TERMS} terms without a word")
    first = [r["anchor"] for r in compiled.filter(~bare).select("anchor").distinct().limit(ANCHORS + 1).collect()]
    anchors = sorted(first) if len(first) <= ANCHORS else None
    before, after = (shape[c] + 1 if shape[c] else 0 for c in ("lead", "trail"))
    read = docs.select("job_id", "text", F.lower("text").alias("lowered"))
    labels = ["canonical", "category", "subcategory"]
    wanted = compiled.filter(~bare).select(
        F.xxhash64("core").alias("key"), F.col("anchor").alias("word"), "lead", "trail", "term", "rival", "words", *labels
    )
    found = _beginnings(read.select("job_id", segments(F.col("lowered")).alias("parts")), shape["words"] or [1], before, after, anchors)
    found = found.join(wanted, ["key", "word"]).filter(_edges(strict, before, after))
    if shape["rival"]:
        counted = found.groupBy("job_id", "term", *labels).agg(
            F.count(F.lit(1)).alias("n"),
            F.sort_array(F.collect_list(F.when(F.col("rival"), F.col("place")))).alias("places"),
            F.max("words").alias("words"),
        )
        found = counted.withColumn("n", F.when(F.size("places") > 0, _apart(F.col("places"), F.col("words"))).otherwise(F.col("n")))
    else:
        found = found.withColumn("n", F.lit(1).cast("bigint"))
    found = found.select("job_id", *labels, "n")
    if few:
        theirs = compiled.filter(bare).select("term", *labels)
        found = found.unionByName(_by_pattern(read, few).join(theirs, "term").select("job_id", *labels, F.col("n").cast("bigint").alias("n")))
    return (
        found.groupBy("job_id", F.col("canonical").alias("skill_name"), "category", "subcategory")
        .agg(F.sum("n").alias("mention_count"))
    )


def _apart(places: Column, words: Column) -> Column:
    """How many of the places, taken from the left, begin after the one before has ended."""
    none = F.struct(F.lit(0).alias("free"), F.lit(0).cast("bigint").alias("n"))

    def take(held: Column, place: Column) -> Column:
        taken = F.struct((place + words * 2 - 1).alias("free"), (held["n"] + 1).alias("n"))
        return F.when(place >= held["free"], taken).otherwise(held)

    return F.aggregate(places, none, take, lambda held: held["n"])


def term_coverage(docs: DataFrame, found: DataFrame, *, max_terms: int = 20) -> DataFrame:
    """How much of a text's technical vocabulary the taxonomy knows."""
    seen = docs.select("job_id", F.array_distinct(potential_terms(F.col("text"))).alias("potential"))
    known = found.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("matched"),
        F.sum("mention_count").alias("mentions"),
        F.collect_set("skill_name").alias("names"),
    )
    none = F.array().cast("array<string>")
    matched = F.coalesce("matched", F.lit(0).cast("bigint"))
    unknown = F.array_sort(F.array_except("potential", F.coalesce("names", none)))
    return seen.join(known, "job_id", "left").select(
        "job_id",
        matched.alias("matched_skills"),
        F.coalesce("mentions", F.lit(0).cast("bigint")).alias("total_mentions"),
        F.slice(unknown, 1, max_terms).alias("unmatched_potential_terms"),
        F.least(F.lit(1.0), matched / F.greatest(F.lit(1), F.size("potential"))).alias("coverage_confidence"),
    )


# --- routing ----------------------------------------------------------------------------------


def needs_discovery(known: Column, job_id: Column, *, mode: str, min_known: int, sample_rate: float) -> Column:
    """Whether a job goes to the candidate finder: few known skills, or one in 1/rate of the others.

    The sample is drawn by a hash of the id, so it does not depend on the order of rows.
    """
    if mode == "discover_all":
        return F.lit(True)
    if mode == "fast_only":
        return F.lit(False)
    few = known < min_known
    if sample_rate <= 0:
        return few
    digest = F.conv(F.substring(F.md5(job_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return few | (digest % int(1 / sample_rate) == 0)


def route_docs(
    docs: DataFrame, found: DataFrame, *, mode: str = "hybrid", min_known: int = 5, sample_rate: float = 0.1
) -> DataFrame:
    counts = found.groupBy("job_id").agg(F.count(F.lit(1)).alias("_known"))
    known = F.coalesce("_known", F.lit(0).cast("bigint"))
    routed = needs_discovery(known, F.col("job_id"), mode=mode, min_known=min_known, sample_rate=sample_rate)
    return (
        docs.select("job_id")
        .join(counts, "job_id", "left")
        .select("job_id", known.alias("known_skills"), routed.alias("needs_discovery"))
    )


# --- candidates -------------------------------------------------------------------------------

DEFAULT_LABEL = "other"
DEFAULT_SCORE = 0.8


def _long_enough(docs: DataFrame, min_chars: int) -> DataFrame:
    bare = F.btrim(F.col("text"), F.lit(" \t\n\r\f\v"))
    return docs.filter(F.length(bare) >= min_chars)


def candidate_terms(
    docs: DataFrame, finder: Finder | None = None, *, min_chars: int = 50, batch_size: int = 8
) -> DataFrame:
    """Possible new terms: (job_id, position, text, label, score).

    ``finder()`` is called once per Python worker and returns a function from a list of texts to a
    list of ``{"text", "label", "score"}`` lists. Without one, words that look technical are taken.
    """
    texts = _long_enough(docs.select("job_id", "text"), min_chars)
    if finder is None:
        return texts.select(
            "job_id",
            F.posexplode(potential_terms(F.col("text"))).alias("position", "text"),
            F.lit(DEFAULT_LABEL).alias("label"),
            F.lit(DEFAULT_SCORE).alias("score"),
        )

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = finder()
        for batch in batches:
            ids, rows = batch["job_id"].tolist(), []
            for at in range(0, len(batch), batch_size):
                some = batch["text"].iloc[at : at + batch_size].tolist()
                for job_id, entities in zip(ids[at : at + batch_size], model(some), strict=True):
                    rows += [(job_id, i, e["text"], e["label"], float(e["score"])) for i, e in enumerate(entities)]
            yield pd.DataFrame(rows, columns=CANDIDATES.fieldNames())

    return texts.mapInPandas(find, CANDIDATES)


def clean_candidates(
    cands: DataFrame,
    labels: DataFrame | None = None,
    generic: DataFrame | None = None,
    *,
    min_confidence: float = 0.5,
    min_len: int = 2,
) -> DataFrame:
    """Confident, named, non-generic candidates, the first per (job, name whatever the case)."""
    spark = cands.sparkSession
    labels = label_categories(spark) if labels is None else labels
    generic = generic_words(spark) if generic is None else generic
    name = F.trim("text")
    usable = cands.filter((F.col("score") >= min_confidence) & (F.length(name) >= min_len)).select(
        "job_id",
        "position",
        name.alias("skill_name"),
        F.lower(name).alias("skill_key"),
        "label",
        (F.floor(F.col("score") * 1000.0 + 0.5) / 1000.0).alias("confidence"),
    )
    first = F.row_number().over(Window.partitionBy("job_id", "skill_key").orderBy("position"))
    once = usable.withColumn("_n", first).filter(F.col("_n") == 1).drop("_n")
    return (
        once.join(generic.select(F.lower("word").alias("skill_key")), "skill_key", "left_anti")
        .join(labels.select("label", F.col("category").alias("_category")), "label", "left")
        .select(
            "job_id",
            "position",
            "skill_name",
            F.coalesce("_category", F.lit("Other")).alias("category"),
            F.col("label").alias("subcategory"),
            "confidence",
        )
    )


def verify_candidates(cands: DataFrame, terms: DataFrame) -> DataFrame:
    """Mark candidates whose name is a canonical taxonomy name."""
    known = terms.select(F.lower("canonical").alias("_key")).distinct().withColumn("_known", F.lit(True))
    joined = cands.join(known, F.lower("skill_name") == F.col("_key"), "left").drop("_key")
    verified = F.coalesce("_known", F.lit(False))
    method = F.when(verified, "gliner_verified").otherwise("gliner_unverified")
    return joined.select(*cands.columns, verified.alias("verified"), method.alias("extraction_method"))


# --- merging ----------------------------------------------------------------------------------

MERGED_COLUMNS = [
    "job_id",
    "skill_name",
    "category",
    "subcategory",
    "mention_count",
    "confidence",
    "verified",
    "extraction_method",
    "position",
]


def _stacked(known: DataFrame, cands: DataFrame) -> DataFrame:
    """Taxonomy hits over verified over unverified candidates, as one set of rows with a priority."""
    one = known.withColumns(
        {"verified": F.lit(True), "extraction_method": F.lit("taxonomy"), "_priority": F.lit(1)}
    )
    two = cands.withColumn("_priority", F.when(F.col("verified"), 2).otherwise(3))
    return one.unionByName(two, allowMissingColumns=True).withColumn(
        "mention_count", F.coalesce("mention_count", F.lit(1).cast("bigint"))
    )


def _best(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("job_id", F.lower("skill_name")).orderBy("_priority", "position", "skill_name")
    best = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == 1)
    return best.select(*MERGED_COLUMNS)


def new_discoveries(merged: DataFrame) -> DataFrame:
    return merged.filter(F.col("extraction_method") == "gliner_unverified")


def merge_terms(known: DataFrame, cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per (job, name whatever the case), and those among them that nobody knew."""
    merged = _best(_stacked(known, cands))
    return merged, new_discoveries(merged)


def hybrid_extract(
    docs: DataFrame,
    terms: DataFrame,
    *,
    finder: Finder | None = None,
    mode: str = "hybrid",
    min_known: int = 5,
    sample_rate: float = 0.1,
    special: str = "full",
    found: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Taxonomy hits for all jobs, candidates for the routed ones, merged.

    ``found`` is what :func:`extract_terms` gives for them, if it is there already.

    The built-in finder is cheaper than a second look at the texts, so it runs on all of them and
    its rows are routed after the shuffle by job. A custom finder sees only the texts routed to it.
    """
    found = extract_terms(docs, terms, special=special) if found is None else found
    rule = {"mode": mode, "min_known": min_known, "sample_rate": sample_rate}
    if mode == "fast_only":
        nothing = docs.sparkSession.createDataFrame([], CANDIDATES)
        return merge_terms(found, verify_candidates(clean_candidates(nothing), terms))
    if finder is not None:
        routed = route_docs(docs, found, **rule).filter("needs_discovery").select("job_id")
        cands = candidate_terms(docs.join(routed, "job_id", "left_semi"), finder)
        return merge_terms(found, verify_candidates(clean_candidates(cands), terms))
    cands = verify_candidates(clean_candidates(candidate_terms(docs)), terms)
    rows = _stacked(found, cands)
    known = F.count_if(F.col("_priority") == 1).over(Window.partitionBy("job_id"))
    routed = needs_discovery(F.col("_known"), F.col("job_id"), **rule)
    merged = _best(rows.withColumn("_known", known).filter((F.col("_priority") == 1) | routed))
    return merged, new_discoveries(merged)


def extraction_stats(routed: DataFrame, merged: DataFrame) -> DataFrame:
    """Totals of one extraction run in one row."""
    pair = F.struct(F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("unverified"))
    skills = merged.agg(pair.alias("pair")).scalar()  # asked twice, worked out once
    total = F.col("total_extractions")
    runs = routed.agg(
        F.count(F.lit(1)).alias("total_extractions"),
        F.count_if(~F.col("needs_discovery")).alias("fast_path_only"),
        F.count_if("needs_discovery").alias("finder_invoked"),
    )
    return runs.withColumns(
        {
            "verified_skills": skills["verified"],
            "unverified_skills": skills["unverified"],
            "fast_path_ratio": F.col("fast_path_only") / F.greatest(F.lit(1), total),
            "finder_ratio": F.col("finder_invoked") / F.greatest(F.lit(1), total),
        }
    )
