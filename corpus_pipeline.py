"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet in the shared folder, and has deleted all others that it needed on the
way. run() gives each stage's table to the next one and deletes it once that
one's is written; it keeps no state between calls, so runs do not disturb each
other. All stages but the last return the columns of documents, as they came
except for `text` and, where that has changed, `n_chars`; columns of any other
names are carried along.

Defined cases, for all stages: an empty table gives an empty table with the same
columns; repeated rows and null ids are rows like others. By stage, null and
empty texts are rejected by the quality rules, stay in near-dedup and substring
dedup (they are copies of nothing), are never drawn by mixing, and are packed
as one end token. Null languages and sources are groups of their own. Very long
texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.minhash_dedup import link_near_duplicates
from turnloom.llm.mixing import mix_sources, mixture
from turnloom.llm.packing import pack_documents
from turnloom.llm.quality_rules import judge_quality
from turnloom.llm.substring_dedup import remove_repeated_windows
from turnloom.llm.workspace import Workspace, release, settled

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Columns that operators read; all others get names of their own while an operator runs.
_READ = ("doc_id", "text", "lang", "source")


def _documents(spark: SparkSession, docs: DataFrame, operator: Callable[[DataFrame, Workspace], DataFrame], new_text: bool = False) -> DataFrame:
    """The operator's rows with the columns of docs, in their order; n_chars counted again where texts are new."""
    inner = {c: c if c in _READ else f"tl_column_{i}" for i, c in enumerate(docs.columns)}

    def build(ws: Workspace) -> DataFrame:
        rows = operator(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items())), ws)
        out = {c: F.col(n) for c, n in inner.items()}
        if new_text and "n_chars" in inner:
            out["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
        return rows.select(*(v.alias(c) for c, v in out.items()))

    return settled(spark, build)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the outlier test rejects."""
    return _documents(spark, docs, lambda d, ws: judge_quality(d, workspace=ws).where("kept"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return _documents(spark, docs, lambda d, ws: link_near_duplicates(d, with_text=True, workspace=ws).where("chosen"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated windows."""
    return _documents(spark, docs, lambda d, ws: remove_repeated_windows(d, workspace=ws), new_text=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as drawn, the last of a source cut, shard by shard in shuffled order."""
    return _documents(spark, docs, lambda d, ws: mixture(mix_sources(d, workspace=ws)), new_text=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture's documents in sequences of 4096 tokens.

    Packing sorts by length, so it is the numbers of the sequences that are mixed: pieces of all lengths lie evenly over them.
    """
    return settled(spark, lambda ws: pack_documents(docs.select("doc_id", "text"), TOKENIZER, spread=True, workspace=ws))


STAGES = [("quality_rules", quality_rules), ("minhash_dedup", minhash_dedup), ("substring_dedup", substring_dedup), ("mixing", mix), ("packing", pack)]

#: Fitted estimates, hashes and tokens have no SQL form; tests/llm/test_pipeline.py checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        release(before)
    return docs
