"""Ids of a real vocabulary: control tokens, what turns add, decoding and streaming by piece."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from turnloom.config import DEFAULTS
from turnloom.functions.vocabulary import GUARD, Vocabulary, guarded, stream_pieces
from turnloom.operators import conversations as C
from turnloom.operators import labels as L
from turnloom.operators import template as M

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
TURNS = "conv_id int, turn int, role string, text string"


@pytest.fixture(scope="module", params=FILES)
def vocabulary(request):
    return Vocabulary(public_tokenizers.path(request.param))


def odd_turns(seed: int, conversations: int = 60):
    rng = random.Random(seed)
    texts = ["", "hello there", "  two  spaces ", "line\nfeed\n", "\n\n\nlate start", 30 * "\n" + "far", "\u4f60\u597d \U0001F600", "a <|im_start|>user b", "</think>", "<think>\nsome thought\n</think>\n\nanswer", "<think>a</think><think>b</think>c", f"x{GUARD}y<{GUARD}|im_end|>", "<tool_response>wrapped</tool_response>", "<tool_call>{}</tool_call>", None]
    roles = ["user", "assistant", "assistant", "tool", "system", "critic", "user"]
    return [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(conversations) for t in range(rng.randint(1, 9))]


def brute(spark, turns, vocabulary):
    """Per turn: the ids of the whole rendering up to it without as many as the rendering before it has."""
    nested = C.nest(turns).select("conv_id", F.explode(C.prefixes(F.col("messages"))).alias("p")).select("conv_id", F.size("p").alias("k"), M.render(M.rich(F.col("p"))).alias("text"))
    rows = nested.collect()
    ids = {(r["conv_id"], r["k"]): i for r, i in zip(rows, vocabulary.encode([r["text"] for r in rows]), strict=True)}
    return {(c, k - 1): whole[len(ids.get((c, k - 1), [])) :] for (c, k), whole in ids.items()}


def test_turns_add_what_whole_renderings_add(spark, vocabulary):
    """With control strings anywhere taken as tokens, as a tokenizer takes a whole prompt."""
    turns = spark.createDataFrame(odd_turns(3), TURNS).where("text IS NULL OR NOT contains(text, '\x1a')")
    turns = turns.withColumn("turn", F.expr("CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT)"))
    got = {(r["conv_id"], r["turn"]): list(r["ids"]) for r in L.token_deltas(turns, vocabulary, guard=False).collect()}
    expected = brute(spark, turns, vocabulary)
    assert got == expected and sum(map(len, got.values())) > 500
    drifted = L.features(L.flat_deltas(turns), 10**6, vocabulary.ids()).collect()
    whole = {r["conv_id"]: list(r["input_ids"]) for r in L.token_features(L.token_deltas(turns, vocabulary, guard=False), 10**6).collect()}
    assert any(list(r["input_ids"]) != whole[r["conv_id"]] for r in drifted)  # cutting by characters is not the same


def test_guarded_texts_are_ordinary(spark, vocabulary):
    """Guarded turns give the ids that the same rendering gives where texts cannot be taken for control strings."""
    rows = odd_turns(4)
    turns = spark.createDataFrame(rows, TURNS)
    ids = vocabulary.control_ids()
    marks = {i for s, i in ids.items() if s not in ("<think>", "</think>", "<tool_response>", "</tool_response>")}
    got = L.token_deltas(turns, vocabulary, mode="aligned").collect()
    for r in got:
        found = [i for i in r["ids"] if i in marks]
        # turn marks only at the ends; tool turns may share them
        assert found in ([], [ids["<|im_start|>"], ids["<|im_end|>"]], [ids["<|im_start|>"]], [ids["<|im_end|>"]])
    plain = [r for r in rows if r[3] is not None and r[2] == "user"]
    shown = spark.createDataFrame(plain, TURNS).select("text", guarded(F.col("text")).alias("g")).collect()
    assert all(len(set(vocabulary.encode([r["g"]])[0]) & set(ids.values())) == 0 for r in shown)
    if "byte" in vocabulary.path:
        assert [vocabulary.decode(vocabulary.encode([r["g"]]))[0] for r in shown] == [r["text"] for r in shown]


def test_features_of_a_vocabulary(spark, vocabulary):
    turns = spark.createDataFrame(odd_turns(5), TURNS).where("text IS NULL OR NOT contains(text, '\x1a')")
    turns = turns.withColumn("turn", F.expr("CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT)"))
    role = {(r["conv_id"], r["turn"]): r["role"] for r in turns.collect()}
    expected: dict = {}
    for (c, t), ids in sorted(brute(spark, turns, vocabulary).items()):
        one = expected.setdefault(c, ([], []))
        one[0].extend(ids)
        one[1].extend(ids if role[c, t] == "assistant" else [DEFAULTS.ignore_label] * len(ids))
    for most in (25, 10**6):
        rows = L.token_features(L.token_deltas(turns, vocabulary, guard=False), most).collect()
        assert {r["conv_id"]: (list(r["input_ids"]), list(r["labels"]), list(r["attention_mask"])) for r in rows} == {c: (i[:most], y[:most], [1] * len(i[:most])) for c, (i, y) in expected.items()}


def test_decoding_leaves_special_tokens_out(spark, vocabulary):
    text = "<|im_start|>assistant\n<think>\nso</think> well<|im_end|>\n"
    ids = vocabulary.encode([text])
    kept, shown = vocabulary.decode(ids, skip_special=False)[0], vocabulary.decode(ids)[0]
    assert "<|im_end|>" in kept and "<think>" in shown and "<|im" not in shown
    if "byte" in vocabulary.path:
        assert kept == text and shown == "assistant\n<think>\nso</think> well\n"
    with pytest.raises(ValueError, match="im_start"):
        L.token_deltas(spark.createDataFrame([], TURNS), Vocabulary(vocabulary.path, (("<think>", False),)))


def test_pieces_join_to_the_decoding(spark):
    vocabulary = Vocabulary(public_tokenizers.path(FILES[0]))
    rng = random.Random(6)
    parts = ["word ", "long" * 30, "\u4f60\u597d\u4e16\u754c", "\U0001F468\u200d\U0001F469\u200d\U0001F467", "\u00e9t\u00e9 ", "\n\n", "\ufffd", "\ufffd\ufffd\ufffd", "<|im_end|>", "</think>", "\u0930\u094d", " "]
    for _ in range(150):
        ids = vocabulary.encode(["".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))])[0]
        if rng.random() < 0.3:
            ids = ids[: rng.randint(0, len(ids))]  # may end inside a character
        pieces = list(stream_pieces(vocabulary, ids))
        assert len(pieces) == len(ids) + 1
        assert "".join(pieces) == vocabulary.decode([ids])[0]
        # what is shown is never taken back, and no shown piece ends inside a word
        assert all(p == "" or p[-1].isspace() or ord(p[-1]) >= 0x2E80 for p in pieces[:-1])
    rows = spark.createDataFrame([(1, vocabulary.encode(["one two \U0001F600 three"])[0]), (2, []), (3, None)], "k int, ids array<int>")
    got = {r["k"]: r["p"] for r in rows.select("k", vocabulary.pieces()("ids").alias("p")).collect()}
    assert "".join(got[1]) == "one two \U0001F600 three" and got[1][0] == "" and got[2] == [""] and got[3] is None


def test_column_functions_take_a_bounded_portion(spark, monkeypatch):
    """However many rows a batch has, ids, texts and pieces are worked out for a portion of them; nulls and long values keep their place."""
    import pandas as pd

    from turnloom.functions import vocabulary as V

    monkeypatch.setattr(V, "AT_ONCE", 100)
    vocabulary, taken = Vocabulary(public_tokenizers.path(FILES[0])), []
    texts = [*(f"word {i} " * (i % 9) for i in range(300)), None, "", "long " * 500, None, "end"]
    udf = vocabulary._column(lambda given: taken.append(sum(map(len, given))) or [len(t) for t in given], V.T.IntegerType(), "").func
    got = pd.concat(udf(iter([pd.Series(texts), pd.Series([], dtype=object)])))
    assert [None if pd.isna(n) else n for n in got] == [None if t is None else len(t) for t in texts]
    assert len(taken) > 50 and sorted(taken)[-2] <= 200 and max(taken) <= 200 + 2500
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    shown = rows.select("k", "t", vocabulary.ids()("t").alias("ids")).select("k", "t", vocabulary.text()("ids").alias("back"), vocabulary.pieces()("ids").alias("p")).collect()
    assert [(r["back"], None if r["p"] is None else "".join(r["p"])) for r in sorted(shown)] == [(t, t) for t in texts]
