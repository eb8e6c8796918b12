"""Every operator takes odd rows, empty tables and clashing columns, with a defined result."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers
from turnloom.llm.chat_format import digests, format_conversations
from turnloom.llm.embedding_dedup import link_embeddings
from turnloom.llm.importance import resample
from turnloom.llm.license_scan import scan_licenses
from turnloom.llm.minhash_dedup import link_near_duplicates
from turnloom.llm.mixing import mix_sources, mixture
from turnloom.llm.packing import pack_documents
from turnloom.llm.periodic_runs import find_runs
from turnloom.llm.quality_rules import judge_quality
from turnloom.llm.substring_dedup import remove_repeated_windows
from turnloom.llm.toxicity import fit_toxicity, score_toxicity
from turnloom.llm.url_filters import filter_urls

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LABELS = "doc_id long, toxic int"


def toxicity(docs):
    labels = docs.sparkSession.createDataFrame([(5, 1), (6, 0), (None, 1), (7, None), (99, 1)], LABELS)
    return score_toxicity(docs, fit_toxicity(docs, labels))


OPERATORS = {
    "quality": judge_quality,
    "toxicity": toxicity,
    "minhash": lambda d: link_near_duplicates(d, with_text=True),
    "packing": lambda d: pack_documents(d, TOKENIZER),
    "mixing": mix_sources,
    "substring": lambda d: remove_repeated_windows(d, digest=True),
    "license": scan_licenses,
    "runs": find_runs,
    "importance": lambda d: resample(d, d.select("text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_with_clashing_columns(spark, name):
    rows = helpers.odd_documents()
    docs = helpers.with_clashes(helpers.frame(spark, rows))
    out = OPERATORS[name](docs)
    got = out.collect()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    if name == "packing":
        assert sum(r["start"] == 0 for r in got) == len(rows)
    else:
        assert len(got) == len(rows)
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    added = {c for c in out.columns if c not in docs.columns}
    kept = [c for c in helpers.CLASHES if c in out.columns]
    assert added and kept
    for column in ("plan", "group", "row", "key"):
        assert all(r[column] == "mine" for r in got)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](helpers.frame(spark, [])).collect() == []


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_defined_results(spark):
    docs = helpers.frame(spark, helpers.odd_documents())
    near = by_id(link_near_duplicates(docs))
    assert [near[i]["n_shingles"] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert near[9]["component_id"] == 8 and not near[9]["kept"] and near[None]["component_id"] is None and near[None]["kept"]
    assert sum(r["chosen"] for r in link_near_duplicates(docs).where("doc_id in (8, 9)").collect()) == 1
    cut = by_id(remove_repeated_windows(docs))
    assert cut[1]["text"] is None and cut[1]["n_words"] == 0 and cut[8]["n_removed"] == 120 and cut[6]["n_removed"] == 0
    judged = by_id(judge_quality(docs))
    assert all(judged[i]["base_failed"] and not judged[i]["kept"] for i in (1, 2, 3, 4, 5, 8))
    packed = by_id(pack_documents(docs, TOKENIZER).where("start = 0"))
    assert [packed[i]["doc_tokens"] for i in (1, 2, 3)] == [1, 1, 1]
    mixed = by_id(mix_sources(docs))
    assert [mixed[i]["size"] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 4] and mixed[1]["taken"] == 0
    assert mixed[3]["source_size"] == 0 and mixed[3]["target"] == 0.0
    scored = by_id(toxicity(docs))
    assert all(0 <= r["score"] <= 1 for r in scored.values())
    found = by_id(scan_licenses(docs))
    assert found[1]["n_words"] == 0 and found[1]["labels"] == "" and found[1]["first_word"] is None and found[1]["score"] == 0.0


def test_mixture_draws_whole_and_cut_texts(spark):
    docs = helpers.frame(spark, helpers.odd_documents())
    drawn = mixture(mix_sources(docs))
    assert all(len((r["text"] or "").encode().split()) == r["draw"]["words"] for r in drawn.collect())


def test_conversations(spark):
    said = [(1, 2, "user", "b"), (1, 1, None, None), (1, None, "assistant", "#\\<"), (1, 2, "user", "a"), (None, 1, "a:\nb", "x"), (2, 1, "assistant", "é😀"), (2, 1, "assistant", "é😀")]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine"))
    got = {r["conv_id"]: r for r in digests(format_conversations(turns)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 4, None: 1, 2: 2}
    assert got[1]["loss_chars"] == 3 and got[2]["loss_chars"] == 4 and got[None]["loss_chars"] == 0
    assert digests(format_conversations(turns.where("false"))).collect() == []


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [1.0, float("nan")], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (9, [1.0], 1), (10, [], 1), (11, [1e-300, 0.0], 1), (12, [1e300, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("mine") for c in ("node", "space", "cell", "vector")})
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in link_embeddings(table).collect()]
    assert sorted(got, key=repr) == sorted([(1, 5, 1, True), (1, 5, 1, True), (2, 5, 1, False), (None, 5, 1, False), (11, 5, 1, False), (12, 5, 1, False), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10))], key=repr)
    assert link_embeddings(table.where("false")).collect() == []


def test_pages(spark):
    rows = [(1, None, None), (2, "no scheme", "<a href='//x.org/'>"), (3, "HTTP://Example.COM/en/7?q", None), (4, "http://a.net", ""), (5, "http://a.example.net/de/8#x", None), (6, "http://b.org/es/1", None), (6, "http://b.org/es/1", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("mine") for c in ("src", "suffix", "fit", "good")})
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages).select("page_id", "host", "path", F.coalesce("rule", F.lit("-")).alias("rule"), "verdict").collect())
    assert got == [(1, "", "", "-", "allow"), (2, "", "", "-", "allow"), (3, "example.com", "/en/7", "example.com/en/7", "allow"), (4, "a.net", "", "-", "allow"), (5, "a.example.net", "/de/8", "example.net/de/8", "allow"), (6, "b.org", "/es/1", "org/es/", "block"), (6, "b.org", "/es/1", "org/es/", "block")]
    assert filter_urls(pages.where("false")).collect() == []
