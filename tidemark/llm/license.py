"""Licence scan by a positional index of rare words.

The words of the licence templates are weighed by how rare they are in the corpus. Each template is entered
in the index under the two rarest words of its mandatory key phrase. A file's rare licence words are looked
up there; an entry and the word's position give the place where the template would start; the second rare
word must stand at its relative position; then the whole key phrase is verified, and the template's score
is the rarity-weighted share of its words that stand where it has them. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    key: str
    base: bool = False


# The four base phrases, then templates of our own.
TEMPLATES = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "software released into the public domain"),
)
#: Share of a template's weight that gives its label.
ENOUGH = 0.7
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLACE = "array<struct<t:int,start:bigint>>"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lowered. Two letters whose lower case is ASCII, but which are not, are set aside first."""
    kept = F.replace(F.replace(text, F.lit("İ"), F.lit("ı")), F.lit("K"), F.lit("ĸ"))
    return F.array_remove(F.split(F.lower(kept), SPLIT), "")


def rarity(docs: DataFrame, templates=TEMPLATES, *, text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of every template word over all of ``docs``.

    What reaches the driver is one number per template word.
    """
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    held = F.array_intersect(words_of(text_of(text_col)), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    df = {r["word"]: r["count"] for r in rows}
    return {w: math.log((1 + df.get("", 0)) / (1 + df.get(w, 0))) + 0.01 for w in vocabulary}


def _at(text: str, phrase: str) -> int:
    """Where a phrase's words start within a template's."""
    words, key = text.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, *, idf: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_words``, ``places`` (label, base, start of the key phrase, score).

    Every place where a key phrase stands is found, whatever the weights. A null text is empty and has
    neither words nor places; null and repeated ids are kept, other columns left out.
    """
    idf = idf if idf is not None else rarity(docs, templates, text_col=text_col)
    postings: dict[str, list[Column]] = {}
    entries = []
    for n, t in enumerate(templates):
        key, words, shift = t.key.split(), t.words.split(), _at(t.words, t.key)
        first, *others = sorted(range(len(key)), key=lambda i: (-idf[key[i]], i))
        second = others[0] if others else first
        postings.setdefault(key[first], []).append(F.struct(F.lit(n).alias("t"), F.lit(first).alias("off")))
        total = sum(idf[w] for w in words)
        entries.append(
            F.struct(
                F.lit(t.label).alias("label"),
                F.lit(t.base).alias("base"),
                F.lit(key[second]).alias("second"),
                F.lit(second).alias("second_off"),
                F.array(*map(F.lit, key)).alias("key"),
                F.array(*[F.struct(F.lit(w).alias("word"), F.lit(i - shift).alias("off"), F.lit(idf[w] / total).alias("weight")) for i, w in enumerate(words)]).alias("words"),
            )
        )
    index = F.create_map(*[x for w, p in sorted(postings.items()) for x in (F.lit(w), F.array(*p))])
    known = F.array(*entries)
    anchors = F.array(*map(F.lit, sorted(postings)))
    rare = F.array_compact(F.transform("words", lambda w, i: F.when(F.array_contains(anchors, w), F.struct(i.alias("at"), w.alias("word")))))

    def starts(hit):
        return F.transform(F.element_at(index, hit["word"]), lambda p: F.struct(p["t"].alias("t"), (hit["at"] - p["off"]).cast("bigint").alias("start")))

    def word_at(i):
        return F.get(F.col("words"), i.cast("int"))

    def stands(c):
        entry = F.get(known, c["t"])
        whole = F.slice(F.col("words"), (c["start"] + 1).cast("int"), F.size(entry["key"])) == entry["key"]
        return (c["start"] >= 0) & (word_at(c["start"] + entry["second_off"]) == entry["second"]) & F.when(c["start"] >= 0, whole).otherwise(False)

    def scored(c):
        entry = F.get(known, c["t"])
        share = F.aggregate(entry["words"], F.lit(0.0), lambda acc, w: acc + F.when(word_at(c["start"] + w["off"]) == w["word"], w["weight"]).otherwise(0.0))
        return F.struct(entry["label"].alias("label"), entry["base"].alias("base"), c["start"].alias("start"), F.least(share, F.lit(1.0)).alias("score"))

    cut = docs.select(F.col(id_col), words_of(text_of(text_col)).alias("words"))
    looked = cut.select(id_col, "words", F.when(F.arrays_overlap("words", anchors), F.flatten(F.transform(rare, starts))).otherwise(F.array().cast(PLACE)).alias("entries"))
    return looked.select(
        id_col,
        F.size("words").cast("bigint").alias("n_words"),
        F.transform(F.filter("entries", stands), scored).alias("places"),
    )


def summary(found: DataFrame) -> DataFrame:
    """Counts, first and last place of the base phrases, labels and the best score."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])

    def joined(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.filter("places", lambda p: p["base"] | (p["score"] >= ENOUGH))).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )
