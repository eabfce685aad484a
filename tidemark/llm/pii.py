"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only. Quantifiers are possessive and each pattern can start only where a run of its
characters starts, so every text is scanned in time proportional to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, text_of

# The four base kinds, in the order of the digest.
BASE_KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KINDS = (*BASE_KINDS, "iban")
#: Something cheap to find without which a kind cannot occur.
NEEDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
}
#: Certainty of a span that passed its check, and words that raise it when they stand before.
BELIEF = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": r"mail|contact|write|reach",
    "ip": r"\bip\b|host|server|address|login",
    "card": r"card|visa|credit|payment|debit",
    "phone": r"phone|tel|call|mobile|fax",
    "iban": r"iban|bank|account|transfer",
}
NEAR = 40
SPAN = "array<struct<start:bigint,end:bigint,hit:string,near:string>>"


def proposed(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points, and the characters before each."""
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    pieces = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc, piece):
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.length(piece["hit"])
        near = F.lower(F.right(piece["gap"], F.lit(NEAR)))
        span = F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("hit"), near.alias("near"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(piece["hit"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    found = F.aggregate(pieces, zero, step, lambda acc: acc["spans"])
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(F.array().cast(SPAN))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check over a string of digits."""

    def worth(i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + worth(i))
    return total % 10 == 0


def mod97(hit: Column) -> Column:
    """The remainder check of bank account numbers, blanks left out."""
    bare = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 100), F.substring(bare, 1, 4))

    def step(acc, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
CHECKS = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda hit: F.length(_digits(hit)).between(16, 19) & luhn(_digits(hit)),
    "phone": lambda hit: F.length(_digits(hit)).between(8, 15),
    "iban": lambda hit: F.length(F.replace(hit, F.lit(" "), F.lit(""))).between(15, 34) & mod97(hit),
}


def confirmed(text: Column, kind: str) -> Column:
    """Spans of one kind that pass its check, each with a score between 0 and 1."""
    good = F.filter(proposed(text, kind), lambda s: CHECKS[kind](s["hit"]))
    return F.transform(
        good,
        lambda s: F.struct(
            F.lit(kind).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            (F.lit(BELIEF[kind]) + F.when(s["near"].rlike(CONTEXT[kind]), 0.1).otherwise(0.0)).alias("score"),
        ),
    )


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``spans``, an array of (kind, start, end, score).

    Order is by kind as in ``KINDS``, then start; places are code points, the end exclusive. A null text is
    the empty text and has no spans. Null and repeated ids are kept as they are; other columns are left out.
    """
    text = text_of(text_col)
    each = docs.select(F.col(id_col), *[confirmed(text, k).alias(f"in_{k}") for k in KINDS])
    return each.select(F.col(id_col), F.concat(*[f"in_{k}" for k in KINDS]).alias("spans"))


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans, all spans as text and the highest score."""

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("pii_score"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets, ``n_chars`` counted anew.

    Overlapping spans become one, under the kind that starts first. All other columns and rows stay; a null
    text stays null.
    """
    name = fresh(docs, "spans")
    spans = F.concat(*[confirmed(text_of(), k) for k in KINDS])
    marked = docs.withColumn(name, F.array_sort(spans, lambda a, b: F.coalesce(F.nullif(F.signum(a["start"] - b["start"]), F.lit(0.0)), F.signum(b["end"] - a["end"])).cast("int")))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        start = F.greatest(s["start"], acc["at"])
        kept = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (start - acc["at"]).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["parts"], F.array(kept, mark)).alias("parts"))

    def rest(acc):
        tail = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length(F.col("text")))
        return F.array_join(F.concat(acc["parts"], F.array(tail)), "")

    text = F.when(F.size(name) > 0, F.aggregate(name, zero, step, rest)).otherwise(F.col("text"))
    out = marked.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
