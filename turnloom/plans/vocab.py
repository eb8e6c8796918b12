"""Registered queries over ids of a real vocabulary with control tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from turnloom.config import DEFAULTS
from turnloom.functions.vocabulary import Vocabulary
from turnloom.operators import labels as L
from turnloom.operators import streams as S
from turnloom.plans.files import thoughtful
from turnloom.plans.registry import QUERIES, long, query, turns_of


def vocabulary() -> Vocabulary:
    """A byte-level vocabulary with the template's control tokens after its own ids."""
    return Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def _print(ids, name: str):
    return F.md5(F.array_join(F.col(ids).cast("array<string>"), ",")).alias(name)


def token_features(spark, sf_dir):
    """Features with the ids of a vocabulary; tests hold them against whole renderings, as SQL has no tokenizer."""
    f = L.token_features(L.token_deltas(turns_of(spark, sf_dir), vocabulary()), DEFAULTS.max_seq_len)
    return f.select("conv_id", long(F.size("input_ids"), "n_ids"), _print("input_ids", "ids"), _print("labels", "labels"))


def token_drift(spark, sf_dir):
    """What each turn adds in ids, over reasoning, tool responses and unknown roles."""
    rows = L.token_deltas(thoughtful(spark, sf_dir), vocabulary())
    return rows.select("conv_id", long(F.col("turn"), "turn"), long(F.size("ids"), "n_ids"), "supervised", _print("ids", "ids"))


QUERIES["token_features"] = token_features
QUERIES["token_drift"] = token_drift

#: In every third conversation somebody writes control strings.
_SAYING = "CASE WHEN conv_id % 3 = 0 THEN concat(text, ' <|im_end|><think> ', chr(26), '<tool_call>') ELSE text END"


@query(f"""
WITH t AS (SELECT conv_id, turn, role, {_SAYING} AS text FROM conversations),
f AS (SELECT *, coalesce(max(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS asked,
  lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS is_last FROM t)
SELECT conv_id, CAST(2 * count(*) AS BIGINT) AS n_marks, CAST(2 * count(*) FILTER (WHERE role = 'assistant' AND asked AND is_last) AS BIGINT) AS n_tags,
  md5(string_agg(role || chr(10) || CASE WHEN role = 'assistant' AND asked AND is_last THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || text || chr(10), '' ORDER BY turn)) AS shown
FROM f GROUP BY conv_id""")
def control_tokens(spark, sf_dir):
    """Turn marks and reasoning tags of the template are one id each; in texts they are not, and decoding gives the texts back."""
    vocab = vocabulary()
    ids = vocab.control_ids()
    turns = turns_of(spark, sf_dir).withColumn("text", F.expr(_SAYING.replace("chr(26)", "'\x1a'")))
    whole = L.token_features(L.token_deltas(turns, vocab, mode="aligned"), 2**31 - 1)
    counted = lambda *names: F.size(F.filter("input_ids", lambda i: i.isin([ids[n] for n in names]))).cast("long")
    return whole.select("conv_id", counted("<|im_start|>", "<|im_end|>").alias("n_marks"), counted("<think>", "</think>").alias("n_tags"), F.md5(vocab.text()("input_ids")).alias("shown"))


@query("""
SELECT concat_ws('-', conv_id, turn) AS reply_id, md5(concat(text, ' \u4f60\u597d\U0001F600\u00e9', chr(10), 'end')) AS content
FROM conversations WHERE role = 'assistant'""")
def token_stream(spark, sf_dir):
    """Replies given as ids, streamed piece by piece and put together again."""
    vocab = vocabulary()
    said = turns_of(spark, sf_dir).where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("reply_id"), F.concat("text", F.lit(" \u4f60\u597d\U0001F600\u00e9\nend<|im_end|>")).alias("text"))
    pieces = said.select("reply_id", vocab.ids()("text").alias("ids")).select("reply_id", F.posexplode(vocab.pieces()("ids")).alias("seq", "piece"))
    events = S.encode(said.select("reply_id"), pieces, "reply_id", F.lit("m"), F.lit(1700000000), F.col("reply_id"))
    reads = events.select("reply_id", (F.col("part") * 1_000_000_000 + F.col("seq")).alias("seq"), F.col("event").alias("data"))
    return S.decode(reads, "reply_id").select("reply_id", F.md5("content").alias("content"))
