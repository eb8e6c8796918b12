"""The pipeline's stages against plain Python, each on its own input, and on odd rows."""

import collections
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm import helpers
from tests.llm.test_brute_force import SF, SPACE, expected_limit, expected_quality, near_groups, removed


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = docs.collect()
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality_rules", "minhash_dedup", "substring_dedup", "mixing", "packing"]
    judged = expected_quality([(r["doc_id"], r["text"] or "", r["lang"], r["source"]) for r in rows])
    good = stages["quality_rules"](spark, docs, SF)
    assert good.columns == columns
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    assert texts == {r["doc_id"]: r["text"] for r in rows if judged[r["doc_id"]][0] and judged[r["doc_id"]][1] <= expected_limit(judged)}
    unique = stages["minhash_dedup"](spark, good, SF)
    groups = near_groups(texts)
    left = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert unique.columns == columns and left == {d: t for d, t in texts.items() if groups[d][1] == d}
    cut = stages["substring_dedup"](spark, unique, SF)
    want = removed(left)
    after = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == columns and set(after) == set(left)
    for d, r in after.items():
        assert hashlib.sha256(" ".join(SPACE.findall(r["text"])).encode()).hexdigest() == want[d][2] and r["n_chars"] == len(r["text"])
    mixed = stages["mixing"](spark, cut, SF)
    assert mixed.columns == columns
    drawn = collections.Counter(r["source"] for r in mixed.collect() for _ in SPACE.findall(r["text"]))
    sizes = collections.Counter(r["source"] for r in after.values() for _ in SPACE.findall(r["text"]))
    assert abs(sum(drawn.values()) - sum(sizes.values())) <= len(sizes)
    times = collections.Counter()
    for r in mixed.collect():
        whole = SPACE.findall(after[r["doc_id"]]["text"])
        own = SPACE.findall(r["text"])
        assert own == whole[: len(own)] and r["n_chars"] == len(r["text"])
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 3
    packed = stages["packing"](spark, mixed, SF).collect()
    assert sum(r["start"] == 0 for r in packed) == mixed.count()
    # sequences are numbered without gaps, and short pieces do not wait for the end
    last = max(r["sequence_id"] for r in packed)
    assert {r["sequence_id"] for r in packed} == set(range(last + 1))
    halves = [[r["length"] for r in packed if (r["sequence_id"] > last / 2) == late] for late in (False, True)]
    assert last < 8 or 0.5 < np.mean(halves[0]) / np.mean(halves[1]) < 2


CLASHES = ("kept", "draws", "size", "sequence_id", "chosen", "n_words", "component_id", "tl_row", "n removed", "dot.ted", "group", "rank")


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_odd_rows(spark, name):
    rows = helpers.odd_documents()
    docs = helpers.frame(spark, rows).withColumns({c: F.lit(f"mine {c}") for c in CLASHES})
    out = dict(pipeline.STAGES)[name](spark, docs, "")
    got = out.collect()
    if name == "packing":
        assert sum(r["start"] == 0 for r in got) == len(rows)
        return
    assert out.columns == docs.columns
    assert all(r[c] == f"mine {c}" for r in got for c in CLASHES)
    ids = sorted(str(r["doc_id"]) for r in got)
    want = {
        "quality_rules": lambda: [r for r in rows if len(SPACE.findall(r[1] or "")) >= 50 and r[0] not in (8, 9)],
        "minhash_dedup": lambda: [r for i, r in enumerate(rows) if i < 9],
        "substring_dedup": lambda: rows,
    }
    if name in want:
        assert ids == sorted(str(r[0]) for r in want[name]())
    else:
        assert not {"1", "2", "3"} & set(ids) and all(r["text"] for r in got)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_empty_table(spark, name):
    docs = helpers.frame(spark, [])
    out = dict(pipeline.STAGES)[name](spark, docs, "")
    assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)


def test_runs_leave_one_table_each(spark):
    """Two runs at once agree, and of each only the result's table is left."""
    from turnloom.llm import workspace

    workspace.cleanup()
    one, two = pipeline.run(spark, SF), pipeline.run(spark, SF)
    assert sorted(one.collect()) == sorted(two.collect())
    left = [root for root in workspace._roots if os.path.exists(root)]
    assert len(left) == 2 and all(os.listdir(root) == ["001-result"] for root in left)
    workspace.release(one)
    assert sum(os.path.exists(root) for root in left) == 1 and two.count() > 0
