"""Thin queries: each applies one operator to its whole table and derives the returned columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import oracles
from turnloom.llm.chat_format import digests, format_conversations
from turnloom.llm.embedding_dedup import link_embeddings
from turnloom.llm.html_text import extract_text
from turnloom.llm.importance import resample
from turnloom.llm.license_scan import scan_licenses
from turnloom.llm.minhash_dedup import link_near_duplicates
from turnloom.llm.mixing import mix_sources
from turnloom.llm.packing import pack_documents
from turnloom.llm.periodic_runs import find_runs, repeat_tails, run_digests
from turnloom.llm.quality_rules import judge_quality
from turnloom.llm.substring_dedup import remove_repeated_windows
from turnloom.llm.toxicity import fit_toxicity, score_toxicity
from turnloom.llm.url_filters import filter_urls
from turnloom.llm.workspace import Workspace, settled

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return settled(spark, lambda ws: filter_urls(pages, keep_html=False, workspace=ws).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return digests(format_conversations(turns.unionByName(own)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return settled(spark, lambda ws: judge_quality(docs, with_text=False, workspace=ws).drop("lang", "source"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out)
    work = Workspace(spark)
    model = fit_toxicity(docs, labels, workspace=work)
    work.close()
    scored = score_toxicity(docs, model, keep_text=False)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return settled(spark, lambda ws: link_near_duplicates(docs, workspace=ws).select("doc_id", "n_shingles", "component_id", "kept"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return settled(spark, lambda ws: pack_documents(docs, TOKENIZER, workspace=ws))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return settled(spark, lambda ws: mix_sources(docs, with_text=False, workspace=ws).select("doc_id", "size", "source_size", "target", "taken", "draws"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return settled(spark, lambda ws: remove_repeated_windows(docs, digest=True, workspace=ws).select("doc_id", "n_words", "n_removed", "kept_sha256"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return settled(spark, lambda ws: link_embeddings(vectors, keep_vector=False, workspace=ws).select("vec_id", "n_links", "component_id", "kept"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"), keep_text=False)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return run_digests(find_runs(repeat_tails(docs), keep_text=False))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text")
    return settled(spark, lambda ws: resample(docs, target, keep_text=False, workspace=ws))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return settled(spark, lambda ws: extract_text(pages, keep_html=False, workspace=ws))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_chat_format, op3_quality_rules, op4_toxicity, op5_minhash_dedup, op6_packing, op7_mixing, op8_substring_dedup, op9_embedding_dedup, op10_license_scan,
        op11_periodic_runs, op12_importance_resampling, op13_html_extraction,
    )
}

#: The others have no SQL form (fitted models, tokens, hash-drawn mixtures); tests hold all of them against brute force.
ORACLES = oracles.ORACLES
