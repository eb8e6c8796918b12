"""Golden strings, invariants and edge rows of the conversation operators."""

import hashlib
import json
import math
from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.config import DEFAULT_SYSTEM, Settings
from turnloom.functions import text as X
from turnloom.functions import tokens as K
from turnloom.operators import conversations as C
from turnloom.operators import labels as L
from turnloom.operators import streams as S
from turnloom.operators import template as M
from turnloom.operators import training as G
from turnloom.sources import tables
from turnloom.sources.logs import read_log
from turnloom.streaming import replies as live

TURNS = "conv_id long, turn long, role string, text string"
NO_THINK = "<think>\n\n</think>\n\n"


def block(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def turns(spark, *conversations):
    rows = [(c, i, role, text) for c, conversation in enumerate(conversations) for i, (role, text) in enumerate(conversation)]
    return spark.createDataFrame(rows, TURNS)


def nested_deltas(df):
    rows = C.nest(df).select("conv_id", L.nested_deltas(M.rich(F.col("messages"))).alias("d")).collect()
    return {r["conv_id"]: r["d"] for r in rows}


def test_golden_deltas(spark):
    df = turns(
        spark,
        [("system", "S"), ("user", "hello one"), ("assistant", "ans1"), ("user", "hello two"), ("assistant", "ans2")],
        [("user", "q"), ("assistant", "a"), ("assistant", "b")],
        [("user", "q"), ("assistant", "<think>\n" + 200 * "z" + "\n</think>\n\na"), ("user", "q2")],
    )
    got = nested_deltas(df)
    assert got[0] == [block("system", "S"), block("user", "hello one"), block("assistant", NO_THINK + "ans1"), "llo two<|im_end|>\n", block("assistant", NO_THINK + "ans2")]
    assert got[1][1:] == [block("assistant", NO_THINK + "a"), "nt\n" + NO_THINK + "b<|im_end|>\n"]
    assert [len(d) for d in got[2]] == [29, 253, 0]
    final = C.nest(df).select("conv_id", F.length(M.render(M.rich(F.col("messages")))).alias("n")).collect()
    assert {r["conv_id"]: r["n"] for r in final}[2] == 93


def test_newlines_before_an_answer(spark):
    for n in (1, 19, 25):
        df = turns(spark, [("user", "q"), ("assistant", n * "\n" + "a"), ("user", "hello")])
        flat = [r["delta"] for r in L.flat_deltas(df).orderBy("turn").collect()]
        assert flat == nested_deltas(df)[0]


PIECES = st.sampled_from(["a", "b", " ", "é", "😀", "\n", 30 * "\n", "<think>", "</think>", "<tool_response>", "</tool_response>"])
WORDS = st.one_of(st.none(), st.text(alphabet="ab é😀\n", max_size=8), st.lists(PIECES, max_size=6).map("".join), st.just("<tool_response>r</tool_response>"))
PLAIN = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "assistant", "tool", "critic", None]), WORDS), min_size=1, max_size=7)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PLAIN, min_size=40, max_size=60))
def test_window_form_is_the_prefix_form(spark, conversations):
    df = turns(spark, *conversations)
    flat, final = {}, {}
    for r in L.flat_deltas(df).orderBy("conv_id", "turn").collect():
        flat.setdefault(r["conv_id"], []).append(r["delta"])
    assert flat == nested_deltas(df)
    for r in L.flat_deltas(df, mode="aligned").orderBy("conv_id", "turn").collect():
        final[r["conv_id"]] = final.get(r["conv_id"], "") + r["delta"]
    whole = C.nest(df).select("conv_id", M.render(M.rich(F.col("messages"))).alias("p")).collect()
    assert final == {r["conv_id"]: r["p"] for r in whole}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PLAIN, min_size=1, max_size=4), st.integers(1, 200), st.sampled_from(["reference", "aligned"]))
def test_feature_invariants(spark, conversations, most, mode):
    deltas = L.flat_deltas(turns(spark, *conversations), mode=mode)
    rows = {r["conv_id"]: r for r in L.features(deltas, most).collect()}
    report = {r["conv_id"]: r for r in L.label_report(deltas, most).collect()}
    for conv, conversation in enumerate(conversations):
        r = rows[conv]
        assert len(r["input_ids"]) == len(r["labels"]) == len(r["attention_mask"]) == report[conv]["n_tokens"] <= most
        assert all(y in (-100, x) for x, y in zip(r["input_ids"], r["labels"])) and set(r["attention_mask"]) <= {1}
        assert sum(y != -100 for y in r["labels"]) == report[conv]["n_supervised"]
        if all(role != "assistant" for role, _ in conversation):
            assert set(r["labels"]) <= {-100}
    padded = L.pad_batches(L.features(deltas, most), batch_size=2).collect()
    for batch in {r["batch_id"] for r in padded}:
        own = [r for r in padded if r["batch_id"] == batch]
        longest = max(sum(r["attention_mask"]) for r in own)
        for r in own:
            n = sum(r["attention_mask"])
            assert len(r["input_ids"]) == len(r["labels"]) == len(r["attention_mask"]) == longest
            assert r["input_ids"][n:] == [151643] * (longest - n) and r["labels"][n:] == [-100] * (longest - n)


def test_aligned_deltas_are_the_final_rendering(spark):
    df = turns(spark, [("system", "S"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")])
    whole = "".join(r["delta"] for r in L.flat_deltas(df, mode="aligned").orderBy("turn").collect())
    assert whole == C.nest(df).select(M.render(M.rich(F.col("messages"))).alias("p")).first()["p"]


@pytest.mark.parametrize("ranges", [4096, 3, 1])
def test_numbered_ranks_everything_once(spark, monkeypatch, ranges):
    monkeypatch.setattr(L, "RANGES", ranges)
    monkeypatch.setattr(L, "RANGE_KEYS", 10)
    keys = [5, -3, 9000, 4096, 8192, 1, 100000, *((i * 0x9E3779B97F4A7C15) % 2**63 for i in range(1, 500))]
    ranked = L.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k").orderBy("rank").collect()
    assert [r["k"] for r in ranked] == sorted(keys) and [r["rank"] for r in ranked] == list(range(len(keys)))
    assert L.numbered(spark.createDataFrame([], "k long"), "k").collect() == []


def test_numbered_sorts_no_sparse_keys_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(L, "RANGE_KEYS", 100)
    frame = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    counted = L.numbered(frame, "k")
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1  # the counts of at most RANGES ranges
    assert counted.agg(F.max("rank"), F.count("*")).first() == (19_999, 20_000)


def test_history_edges(spark):
    rows = spark.createDataFrame([(0, []), (1, [("user", "a")]), (2, [("system", "s"), *[("user", str(i)) for i in range(6)]])], f"id int, m {C.MESSAGES}")
    ensured = {r["id"]: r["e"] for r in rows.select("id", C.ensure_system(F.col("m"), DEFAULT_SYSTEM).alias("e")).collect()}
    assert [m["role"] for m in ensured[0]] == ["system"] and [m["role"] for m in ensured[1]] == ["system", "user"] and len(ensured[2]) == 7
    cut = {n: rows.where("id = 2").select(C.history_window(F.col("m"), n).alias("w")).first()["w"] for n in (3, 5, 6, 20)}
    assert [[m["content"] for m in cut[n]] for n in (3, 5)] == [["s", "3", "4", "5"], ["s", "1", "2", "3", "4", "5"]] and len(cut[6]) == len(cut[20]) == 7
    assert rows.where("id = 0").select(C.history_window(F.col("m"), 3).alias("w"), C.clear_history(F.col("m")).alias("c"), C.prefixes(F.col("m")).alias("p")).first() == ([], [], [])


def test_content_that_is_no_string(spark, tmp_path):
    calls = [{"type": "function", "function": {"name": "f", "arguments": {"b": [1, 2.5, "x,y:\\\"z"], "a": None}}}, {"name": "g", "arguments": '{"raw":1}'}, {"name": "h", "arguments": 7}]
    said = [{"role": "user", "content": 5}, {"role": "user", "content": "q"}, {"role": "assistant", "content": {"a": 1}, "reasoning_content": 3, "tool_calls": calls}, {"role": "tool", "content": ["r"]}, {"role": "user", "content": True}]
    (tmp_path / "in.jsonl").write_text(json.dumps({"messages": said}) + "\n")
    read = tables.read_conversations(spark, str(tmp_path / "in.jsonl"), calls=True)
    shown = "".join(f"{chr(10) if i else ''}<tool_call>\n{{\"name\": \"{n}\", \"arguments\": {a}}}\n</tool_call>" for i, (n, a) in enumerate([("f", json.dumps(calls[0]["function"]["arguments"])), ("g", '{"raw":1}'), ("h", "7")]))
    want = block("user", "") + block("user", "q") + block("assistant", shown) + "<|im_start|>user\n<tool_response>\n\n</tool_response><|im_end|>\n" + block("user", "")
    assert read.select(M.render(F.col("messages")).alias("p")).first()["p"] == want
    plain = tables.read_conversations(spark, str(tmp_path / "in.jsonl")).first()["messages"]
    assert [tuple(m) for m in plain] == [("user", None), ("user", "q"), ("assistant", None), ("tool", None), ("user", None)]


def test_token_features_of_a_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    df = turns(spark, [("user", "What's <|endoftext|> up?"), ("assistant", "Not much 😀"), ("user", "")], [("user", "x" * 500)])
    encoder, _ = K.tokenizer_file(public_tokenizers.path("byte_bpe_50k.json"))
    deltas = {}
    for r in L.flat_deltas(df).orderBy("conv_id", "turn").collect():
        deltas.setdefault(r["conv_id"], []).append((tokenizer.encode(r["delta"], add_special_tokens=False).ids, r["supervised"]))
    for r in L.features(L.flat_deltas(df), 60, K.plug_in_tokenizer(encoder)).collect():
        assert r["input_ids"] == [i for ids, _ in deltas[r["conv_id"]] for i in ids][:60]
        assert r["labels"] == [i if mine else -100 for ids, mine in deltas[r["conv_id"]] for i in ids][:60]


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from turnloom.sources import shared

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_root(session("spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_root(session("local-cluster[2,1,1024]"))
    assert shared.shared_root(session("spark://host:7077", "hdfs://x/")) == "hdfs://x"
    assert shared.shared_root(session("local[4]"))


def test_strict_reader_fails_and_reads(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    rows = [{"messages": [{"role": "user", "content": "你好"}, {"role": "assistant", "content": "a\nb"}]}, {"messages": [{"role": "user", "content": None}]}]
    good.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n")
    bad.write_text(good.read_text() + '{"messages": []}\n')
    read = tables.read_conversations(spark, str(good))
    assert [[tuple(m) for m in r["messages"]] for r in read.collect()] == [[("user", "你好"), ("assistant", "a\nb")], [("user", None)]]
    with pytest.raises(Exception, match="no list of messages"):
        tables.read_conversations(spark, str(bad)).collect()
    assert tables.read_conversations(spark, str(bad), strict=False).count() == 3
    tables.write_conversations(read, str(tmp_path / "out"))
    assert tables.read_conversations(spark, str(tmp_path / "out")).count() == 2


def test_settings_from_environment():
    found = Settings.from_env({"MAX_SEQ_LEN": "7", "STREAM": "TRUE", "PEAK_RATE": "0.5", "OTHER": "x"})
    assert (found.max_seq_len, found.stream, found.peak_rate, found.epochs) == (7, True, 0.5, 2)


def test_unicode_strip_and_leading_int(spark):
    rows = spark.createDataFrame([("\x1c　 a b \x85",), ("",), ("12px",), (" -3",), ("x",)], "t string")
    got = rows.select(X.strip(F.col("t")).alias("s"), X.leading_int(F.col("t")).alias("i")).collect()
    assert [r["s"] for r in got] == [r["t"].strip() for r in rows.collect()] and [r["i"] for r in got] == [None, None, 12, -3, None]


def test_tokens_round_trip_and_plug_in(spark):
    rows = spark.createDataFrame([("a😀中",), ("",), (None,)], "t string")
    ids = rows.select(K.code_points(F.col("t")).alias("i")).collect()
    assert [r["i"] for r in ids[:2]] == [[97, 0x1F600, 0x4E2D], []]
    special = spark.createDataFrame([([151644, 97, 151668],)], "i array<int>")
    assert special.select(K.from_code_points(F.col("i")).alias("t")).first()["t"] == "a</think>"
    assert special.select(K.from_code_points(F.col("i"), skip_special=False).alias("t")).first()["t"] == "<|im_start|>a</think>"
    assert K.special_tokens(spark).where("special").count() == 14 and K.special_tokens(spark).count() == 26

    def load():
        return lambda texts: [[len(w) for w in t.split()] for t in texts]

    encode = K.plug_in_tokenizer(load)
    got = spark.createDataFrame([("ab c",), (None,)], "t string").select(encode("t").alias("i")).collect()
    assert [r["i"] for r in got] == [[2, 1], None]


def test_stream_round_trip(spark):
    said = {"a": "x\ny\"\\😀", "b": ""}
    replies = spark.createDataFrame(list(said.items()), "id string, content string")
    events = S.encode(replies, S.characters(replies), "id", F.lit("m"), F.lit(1), F.col("id")).withColumn("seq", F.col("part") * 1000 + F.col("seq"))
    rows = events.orderBy("id", "seq").collect()
    direct = S.encode_characters(replies, "id", F.lit("m"), F.lit(1), F.col("id")).withColumn("seq", F.col("part") * 1000 + F.col("seq"))
    assert direct.drop("position").orderBy("id", "seq").collect() == rows
    assert [r["position"] for r in direct.orderBy("id", "seq").collect()] == [*range(len(said["a"]) + 2), 0, 1]
    assert [r["event"] for r in rows if r["id"] == "b"][1] == "data: [DONE]\n\n"
    stop = json.loads([r["event"] for r in rows if r["id"] == "b"][0][6:])
    assert stop["choices"][0] == {"index": 0, "delta": {}, "finish_reason": "stop"} and stop["object"] == "chat.completion.chunk"
    first = json.loads(rows[0]["event"][6:])
    assert first["choices"][0] == {"index": 0, "delta": {"content": "x"}, "finish_reason": None}
    for mode in ("lossy", "buffered"):
        got = S.decode(events.withColumnRenamed("event", "data"), "id", mode=mode).collect()
        assert {r["id"]: r["content"] for r in got} == said
    body = replies.select("id", S.completion(F.col("content"), F.lit("m"), F.col("id"), F.lit(1)).alias("body"))
    whole = json.loads(body.where("id = 'a'").first()["body"])
    assert whole["choices"][0]["message"] == {"role": "assistant", "content": said["a"]} and whole["usage"]["total_tokens"] == 0


def arrive(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps({"reply_id": r, "seq": i, "line": line, "at": at}) for r, i, line, at in rows))


def piece(text):
    return f'data: {{"choices":[{{"delta":{{"content":"{text}"}}}}]}}'


def taken_in(spark, source, out):
    live.run_available(live.read_lines(spark, str(source), 1), str(out))
    return sorted((r["reply_id"], r["content"], r["done"]) for r in spark.read.schema(live.REPLIES).parquet(str(out)).collect())


def test_live_replies_come_once(spark, tmp_path):
    """Across the hour, over several batches and calls, in any order, and dropped from state when over."""
    source, out = tmp_path / "in", tmp_path / "out"
    arrive(source, "1", ("r", 1, "", "2024-01-01T00:59:58Z"), ("r", 0, piece("a"), "2024-01-01T00:59:59Z"), ("open", 0, piece("x"), "2024-01-01T00:59:59Z"))
    assert taken_in(spark, source, out) == []
    arrive(source, "2", ("r", 3, "data: [DONE]", "2024-01-01T01:00:02Z"), ("r", 2, piece("b"), "2024-01-01T01:00:01Z"))
    assert taken_in(spark, source, out) == [("r", "ab", True)]
    # `open` never ends: it is given out once event time has passed it by more than the allowance, also by quiet batches
    arrive(source, "3", ("s", 0, piece("c"), "2024-01-01T01:05:00Z"), ("s", 1, "data: broken", "2024-01-01T01:05:00Z"), ("s", 2, "data: [DONE]", "2024-01-01T01:05:00Z"))
    assert taken_in(spark, source, out) == [("r", "ab", True), ("s", "c", True)]
    arrive(source, "4", ("t", 0, piece("d"), "2024-01-01T03:00:00Z"))
    assert taken_in(spark, source, out) == [("open", "x", False), ("r", "ab", True), ("s", "c", True)]
    # too late for the stream, and nothing is written twice
    arrive(source, "5", ("open", 1, piece("y"), "2024-01-01T01:00:00Z"))
    assert taken_in(spark, source, out) == [("open", "x", False), ("r", "ab", True), ("s", "c", True)]
    bounded = spark.read.schema(live.LINES).json(str(source))
    assert {r["reply_id"]: r["content"] for r in live.replies_of_batch(bounded).collect()} == {"r": "ab", "open": "xy", "s": "c", "t": "d"}


def test_live_state_is_dropped(spark, tmp_path):
    """Marks of replies that are over go once event time has passed them twice by the allowance."""
    source, out = tmp_path / "in", tmp_path / "out"
    for i in range(3):
        arrive(source, str(i), *((f"r{i}", k, piece("a") if k < 2 else "data: [DONE]", f"2024-01-01T00:0{i}:00Z") for k in range(3)))
    assert len(taken_in(spark, source, out)) == 3

    def held():
        state = spark.read.format("statestore").option("stateVarName", "facts").load(f"{out}-state")
        return sorted(r["key"][0] for r in state.select("key").collect())

    assert held() == ["r0", "r1", "r2"]
    for i, at in enumerate(("01:00:00", "02:00:00", "03:00:00")):
        arrive(source, f"later{i}", (f"t{i}", 0, piece("d"), f"2024-01-01T{at}Z"))
        taken_in(spark, source, out)
    assert not {"r0", "r1", "r2"} & set(held())


def test_live_lines_that_come_again(spark, tmp_path):
    """A line that comes twice counts once, and none opens a reply again that has been given out."""
    source, out = tmp_path / "in", tmp_path / "out"
    line = lambda seq, text, at="2024-01-01T00:00:00Z": ("r", seq, text, at)
    arrive(source, "1", line(0, piece("a")), line(1, piece("b")))
    taken_in(spark, source, out)
    arrive(source, "2", line(1, piece("b")), line(2, "data: [DONE]"))
    assert taken_in(spark, source, out) == [("r", "ab", True)]
    arrive(source, "3", line(0, piece("a")), line(2, "data: [DONE]"))
    assert taken_in(spark, source, out) == [("r", "ab", True)]
    # long after: still not given out a second time
    arrive(source, "4", ("x", 0, piece("c"), "2024-01-01T05:00:00Z"), ("x", 1, "data: [DONE]", "2024-01-01T05:00:00Z"))
    arrive(source, "5", line(0, piece("a")), line(1, piece("b")))
    assert taken_in(spark, source, out) == [("r", "ab", True), ("x", "c", True)]


def test_chunks_hold_the_lines(spark):
    """A chunk is what a task reads of a reply and time at once; lines that come twice stay by themselves, in their order."""
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    said = ["a", "\U0001F600b", "", "\u4f60", "e\u0301"]
    rows = [("r", i, piece(x), at) for i, x in enumerate(said)] + [("s", -1, piece("z"), at), ("s", 3, "data: [DONE]", at), ("r", 5, "data: [DONE]", at), (None, 0, piece("x"), at), ("r", None, piece("x"), at)]
    lines = spark.createDataFrame(rows, live.LINES).coalesce(1)
    got = {c["reply_id"]: c for c in live.chunks(lines).collect()}
    assert len(got) == 2 and live.chunks(lines).count() == 2
    assert (got["r"]["steps"], got["r"]["sizes"], got["r"]["text"], got["r"]["ends"]) == ([0, 1, 1, 1, 1, 1], [1, 2, 0, 1, 2, 0], "".join(said), 5)
    assert (got["s"]["steps"], got["s"]["sizes"], got["s"]["text"], got["s"]["ends"]) == ([-1, 4], [1, 0], "z", 3)
    again = spark.createDataFrame([*rows, ("r", 1, piece("other"), at)], live.LINES).coalesce(1)
    assert [c["text"] for c in live.chunks(again).collect() if c["reply_id"] == "r"] == [*said, "", "other"]
    assert live.chunks(lines.limit(0)).count() == 0


def test_the_stream_holds_a_round_of_lines(spark, tmp_path, monkeypatch):
    """Lines lie in the folder compressed, a round at a time, and go when the stream has taken them in."""
    from turnloom.plans import catalog

    said = ["".join(chr(97 + (i * j) % 26) for j in range(400)) for i in range(40)]
    spark.createDataFrame([(i // 2, i % 2, "assistant", t) for i, t in enumerate(said)], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(catalog, "_AT_ONCE", 3000)
    monkeypatch.setattr(catalog, "scratch", lambda _, name: str(tmp_path / name))
    held, take = [], live.run_available

    def watched(lines, out):
        held.append(sum(f.stat().st_size for f in (tmp_path / "stream" / "lines").rglob("*") if f.is_file()))
        take(lines, out)

    monkeypatch.setattr(live, "run_available", watched)
    got = {r["reply_id"]: (r["done"], r["content"]) for r in catalog.stream_replies(spark, str(tmp_path)).collect()}
    assert got == {f"{i // 2}-{i % 2}": (True, hashlib.md5(t.encode()).hexdigest()) for i, t in enumerate(said)}
    assert len(held) == 6 and max(held) < 20 * 16_000 / 3  # before: once, 250 bytes for each of 16,000 characters
    assert [p.name for p in (tmp_path / "stream").iterdir()] == ["replies"]


def test_plans_and_rates(spark):
    rows = spark.createDataFrame([(1490, 3), (4598, 2), (7141, 3)], "n long, e int").select(G.total_steps(F.col("n"), F.col("e")).alias("s"))
    rows = rows.select("s", G.warmup_steps(F.col("s")).alias("w")).collect()
    assert [tuple(r) for r in rows] == [(282, 9), (576, 18), (1341, 41)]
    rates = {r["step"]: r["learning_rate"] for r in G.learning_rates(spark, 282).collect()}
    # as logged at steps 10, 20 and 30 of a run of 282
    assert rates[10] == 1e-4 and math.isclose(rates[20], 9.966929928028133e-05) and math.isclose(rates[30], 9.868157163976622e-05)


def test_log_reader(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("Map: 100%|##| 9/9\n{'loss': 2.5, 'num_tokens': 10.0}\r 4%|#| 1/9\n{'loss': 2.0, 'num_tokens': 25.0}\n{'train_runtime': 2.0, 'num_tokens': 25.0}\n")
    lines = read_log(spark, str(log), "r")
    steps = G.token_steps(G.parse_log(lines)).orderBy("step").collect()
    assert [(r["step"], r["loss"], r["new_tokens"]) for r in steps] == [(10, 2.5, 10.0), (20, 2.0, 15.0)]
    assert G.run_summaries(lines).first()["tokens_per_second"] == 12.5
