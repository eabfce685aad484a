"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts with escape method C and full exclusion: a byte
not seen in the longest known context escapes to the next shorter one, down to all 256 bytes alike. After
training the statistics are frozen, so the exact code length of a byte is a fixed function of the byte and
of the context kept for it; all languages' code lengths of all contexts make one table, and scoring a
text is a table look-up per byte.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat_bytes, remainder, row_sums, slices

ORDER = 3
#: The fit reads about so many documents of each language, chosen by a hash of the id, and whole.
FIT_DOCUMENTS = 1500
#: Contexts seen less often than this share of a language's bytes are left out of its tree.
LEAST_SHARE = 1e-5
UNKNOWN = "und"
#: Symbol 0 stands before the text and for every byte that training never saw.
OTHER = 0


@dataclasses.dataclass(frozen=True)
class Model:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol
    n: int  # number of symbols
    state: np.ndarray  # last three symbols -> row of bits
    bits: np.ndarray  # (state * n + symbol, language) -> code length in bits


def _grams(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Counts of (three bytes before, byte), packed into one number, by language; 256 stands before a text."""
    for batch in slices(batches, "text"):
        data, bounds = flat_bytes(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        code = _history(data.astype(np.int64), bounds, 257, 256) * 257 + data
        owner = np.repeat(np.arange(len(langs)), np.diff(bounds))
        for lang in sorted(set(langs)):
            rows = np.array([x == lang for x in langs])
            got, count = np.unique(code[rows[owner]], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(got), pa.string()), pa.array(got), pa.array(count.astype(np.int64))], ["lang", "gram", "n"]
            )


def _history(symbols: np.ndarray, bounds: np.ndarray, n: int, before: int) -> np.ndarray:
    """The last three symbols before each, as one number; ``before`` fills in at the start of a text."""
    out = np.zeros(len(symbols), dtype=symbols.dtype)
    starts = bounds[:-1][bounds[1:] > bounds[:-1]]
    ends = bounds[1:][bounds[1:] > bounds[:-1]]
    for back in (3, 2, 1):
        shifted = np.empty_like(symbols)
        shifted[back:] = symbols[:-back] if back < len(symbols) else 0
        shifted[:back] = before
        for i in range(back):
            at = starts + i
            shifted[at[at < ends]] = before
        out *= n
        out += shifted
    return out


def fit(docs: DataFrame, *, documents: int = FIT_DOCUMENTS, least_share: float = LEAST_SHARE) -> Model:
    """Train on rows with a text and a language.

    Reads about ``documents`` whole documents of each language (all, if there are fewer), chosen by a hash of
    the id, so that the fit and the model are bounded. Counting is distributed; what reaches the driver is
    one count for each language and four bytes in a row.
    """
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return compile_model({}, least_share)
    share = F.create_map(*[x for lang, c in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1.0, documents / c)))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.filter(draw < F.element_at(share, F.col("lang"))).select("lang", "text")
    counts = chosen.mapInArrow(_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return compile_model({lang: counts[counts["lang"] == lang] for lang in sorted(sizes)}, least_share)


def compile_model(counts: dict[str, pd.DataFrame], least_share: float = LEAST_SHARE) -> Model:
    """The table of code lengths from each language's counts of four bytes in a row."""
    languages = sorted(counts)
    seen = np.zeros(257, dtype=bool)
    parts = {}
    for lang in languages:
        gram, n = counts[lang]["gram"].to_numpy(np.int64), counts[lang]["n"].to_numpy(np.int64)
        parts[lang] = (np.stack([gram // 257**k % 257 for k in (3, 2, 1, 0)]), n)
        seen[np.unique(parts[lang][0])] = True
    seen[256] = False
    symbol = np.where(seen[:256], np.cumsum(seen[:256]), OTHER).astype(np.int32)
    a = int(symbol.max()) + 1
    to = np.concatenate([symbol, [OTHER]])
    tables, kept = {}, [set(), set(), set(), set()]
    for lang, (g, n) in parts.items():
        h3, h2, h1, s = (to[x].astype(np.int64) for x in g)
        full = pd.DataFrame({"h3": (h3 * a + h2) * a + h1, "h2": h2 * a + h1, "h1": h1, "h0": 0 * h1, "s": s, "n": n})
        tables[lang] = [full.groupby([f"h{k}", "s"])["n"].sum() for k in range(ORDER + 1)]
        for k in range(1, ORDER + 1):
            total = full.groupby(f"h{k}")["n"].sum()
            kept[k].update(total.index[total >= max(2, least_share * n.sum())])
    # A state for each context kept in some tree, the empty one first; a history leads to the longest.
    state = np.zeros(a**3, dtype=np.int32)
    contexts = [(0, 0)]
    for k in range(1, ORDER + 1):
        for c in sorted(kept[k]):
            if k == 3:
                state[c] = len(contexts)
            else:
                state.reshape(-1, a**k)[:, c] = len(contexts)
            contexts.append((k, c))
    order = np.array([k for k, _ in contexts])
    code = np.array([c for _, c in contexts], dtype=np.int64)
    bits = np.zeros((len(contexts), a, max(1, len(languages))), dtype=np.float32)
    unseen = 256 - (a - 1)  # how many bytes symbol 0 stands for
    for i, lang in enumerate(languages):
        p = np.zeros((len(contexts), a))
        left, escape = np.ones((len(contexts), a), dtype=bool), np.ones(len(contexts))
        for k in range(ORDER, -1, -1):
            deep = np.flatnonzero(order >= k)
            series = tables[lang][k]
            have, inverse = np.unique(series.index.get_level_values(f"h{k}").to_numpy(np.int64), return_inverse=True)
            dense = np.zeros((len(have) + 1, a))
            dense[inverse, series.index.get_level_values("s").to_numpy(np.int64)] = series.to_numpy()
            at = np.searchsorted(have, code[deep] % a**k)
            at = np.where((at < len(have)) & (have[np.minimum(at, len(have) - 1)] == code[deep] % a**k), at, len(have))
            cnt = dense[at] * left[deep]
            n, d = cnt.sum(1), (cnt > 0).sum(1)
            some = d > 0
            rows = deep[some]
            share = escape[rows] / (n + d)[some]
            p[rows] += share[:, None] * cnt[some]
            escape[rows] = share * d[some]
            left[rows] &= cnt[some] == 0
        weight = np.where(np.arange(a) == OTHER, unseen, 1)
        rest = (left * weight).sum(1)
        p += left * (escape / np.maximum(rest, 1))[:, None]
        bits[:, :, i] = -np.log2(np.maximum(p, 1e-300))
    return Model(languages, symbol, a, state, bits.reshape(-1, bits.shape[2]))


def code_lengths(model: Model, texts: pa.Array) -> np.ndarray:
    """Bits of each text under each language: (texts, languages)."""
    data, bounds = flat_bytes(texts)
    out = np.zeros((len(bounds) - 1, len(model.languages)))
    block = 1 << 20  # so that memory does not grow with the length of a text
    symbols = model.symbol[data]
    for start in range(0, len(symbols), block):
        stop, lead = min(len(symbols), start + block), max(0, start - 3)
        inside = np.clip(bounds, lead, stop) - lead
        part = symbols[lead:stop]
        history = _history(part, inside, model.n, OTHER)[start - lead :]
        cost = model.bits.take(model.state[history].astype(np.int64) * model.n + part[start - lead :], axis=0)
        out += row_sums(cost, np.clip(bounds, start, stop) - start)
    return out


def verdicts(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language of each text and how sure it is (its posterior share); no letter gives ``und``, 0."""
    bits = code_lengths(model, texts)
    lettered = np.asarray(pa.compute.fill_null(pa.compute.match_substring_regex(texts.cast(pa.large_string()), r"\p{L}"), False))
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = bits.argmin(1)
    gap = np.minimum(bits - bits.min(1, keepdims=True), 1000)
    score = np.where(lettered, 1 / np.exp2(-gap).sum(1), 0.0)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], score


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score``.

    Only the text is used. A null text, or one without a letter, is ``und`` with score 0, as is every text
    if nothing was learned. Ties go to the first language by name. Other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, "text"):
            lang, score = verdicts(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text is in some language; ``lang`` becomes the predicted one. Columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches):
        for batch in slices(batches, "text"):
            lang, _ = verdicts(shared.value, batch.column("text"))
            known = pa.array([x != UNKNOWN for x in lang])
            if at is not None:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(lang, batch.schema.field(at).type))
            yield batch.filter(known)

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(remainder(F.col("doc_id"), 5) != 0)
