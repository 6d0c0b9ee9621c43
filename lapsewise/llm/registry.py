"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm import bpe, decontaminate, html_text, jaccard, language, pii, prefixes, repeats, runs, secrets, toxicity, urls, vectors
from lapsewise.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_url_filter(spark, d):
    judged = urls.judge_urls(table(spark, d, "pages"), urls.fit_urls(spark))
    return judged.withColumnRenamed("id", "page_id")


@query
def op2_suffix_repeats(spark, d):
    return repeats.remove_repeats(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


@query
def op3_ngram_jaccard(spark, d):
    return jaccard.near_duplicates(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


@query
def op4_language(spark, d):
    docs = table(spark, d, "documents")
    apart = language.held_out(F.col("doc_id"))
    model = language.fit_languages(docs.where(~apart), public_tokenizers.path("piece_bpe_32k.model"), "doc_id")
    found = language.predict_languages(docs, model)
    return found.select(
        F.col("id").alias("doc_id"), language.held_out(F.col("id")).alias("held_out"), F.col("lang").alias("lang_pred"), "score"
    )


@query
def op5_decontamination(spark, d):
    found = decontaminate.find_overlaps(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


@query
def op6_html_text(spark, d):
    return html_text.extract_text(table(spark, d, "pages")).withColumnRenamed("id", "page_id")


@query
def op7_byte_bpe(spark, d):
    coded = bpe.encode_corpus(
        table(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return coded.withColumnRenamed("id", "doc_id")


@query
def op8_epsilon_grid(spark, d):
    found = vectors.near_vectors(table(spark, d, "embeddings")).withColumnRenamed("id", "vec_id")
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query
def op9_secrets(spark, d):
    return secrets.digest(secrets.find_secrets(table(spark, d, "documents")))


@query
def op10_pii(spark, d):
    return pii.digest(pii.find_pii(table(spark, d, "documents")))


@query
def op11_toxicity(spark, d):
    docs = table(spark, d, "documents")
    network = toxicity.fit_toxicity(docs.where(~language.held_out(F.col("doc_id"))), table(spark, d, "labels"))
    found = toxicity.score_texts(docs, network)
    return found.select(
        F.col("id").alias("doc_id"),
        language.held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op12_periodic_runs(spark, d):
    return runs.digest(runs.word_runs(table(spark, d, "documents"), reorder=runs.planted_tail))


@query
def op13_prefix_trie(spark, d):
    return prefixes.rebuilt_trie(table(spark, d, "conversations"))
