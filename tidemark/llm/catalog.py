"""The registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, balltree, decontaminate, embeddings, katz, language, license, mixing, neardup, pieces, pii, tokens, toxicity
from tidemark.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_katz_scores(spark, sf_dir):
    scored = katz.score(katz.training(table(spark, sf_dir, "documents")))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op2_decontamination(spark, sf_dir):
    """Every document and benchmark item whose passage it holds."""
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_license_scan(spark, sf_dir):
    return license.summary(license.scan_licenses(table(spark, sf_dir, "documents")))


@query
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(language.training_rows(docs)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    """A vocabulary file of the installed public tokenizers; any other can be given to the loading functions."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_token_counts(spark, sf_dir):
    vocab = tokens.vocabulary(tokens.load_pieces(vocabulary_path()))
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocab)


@query
def op6_embedding_neardup(spark, sf_dir):
    return embeddings.link_embeddings(table(spark, sf_dir, "embeddings"))


@query
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs), table(spark, sf_dir, "labels"))
    held = (remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return toxicity.score_texts(docs, model).select("doc_id", held, "score", predicted, "flagged")


@query
def op8_minhash_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_source_mixing(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


@query
def op10_pii(spark, sf_dir):
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


@query
def op11_sentencepiece(spark, sf_dir):
    model = pieces.load_model(vocabulary_path())
    encoded = pieces.encode_texts(table(spark, sf_dir, "documents"), model)
    spelt = F.array_join(F.col("ids").cast("array<string>"), " ")
    digests = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelt, 256).alias("ids_sha256"), "ids")
    decoded = pieces.decode_ids(digests, model)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_tokenizer_alignment(spark, sf_dir):
    left, right = alignment.load_byte_level(vocabulary_path("byte_bpe_50k.json")), pieces.load_model(vocabulary_path())
    return alignment.summary(alignment.align_texts(table(spark, sf_dir, "documents"), left, right, columns=alignment.SUMMED))


@query
def op13_lexical_search(spark, sf_dir):
    return balltree.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES: dict[str, str] = {"op13_lexical_search": balltree.ORACLE}
