"""Fixed cases of each rule: small inputs with the results written beside them."""

import pytest
from pyspark.sql import functions as F

from turnloom.config import DEFAULT_SYSTEM, DEFAULTS
from turnloom.functions import text as X
from turnloom.functions import tokens as K
from turnloom.operators import conversations as C
from turnloom.operators import requests as R
from turnloom.operators import streams as S
from turnloom.operators import template as M
from turnloom.operators import training as G

#: Lines of JSON that show each rule of validation.
LINES = (
    (1, '{"messages":[{"role":"user","content":"a"}]}'),
    (2, '{"messages":[]}'),
    (3, '{"messages":"x"}'),
    (4, '{"x":1}'),
    (5, "not json"),
    (6, '{"messages":[{"role":"user"}]}'),
    (7, '{"messages":[{"role":"user","content":null}]}'),
    (8, '{"messages":[{"role":"user","content":"a"},{"content":"b"}]}'),
    (9, '{"messages":["a"]}'),
    (10, '{"messages":[{"role":"odd","content":5,"more":1}]}'),
)


def test_validation(spark):
    got = {r["line_no"]: r["problem"] for r in C.quarantine(spark.createDataFrame(LINES, "line_no long, line string")).collect()}
    none, short = "no list of messages", "message without role or content"
    assert got == {1: None, 2: none, 3: none, 4: none, 5: "not json", 6: short, 7: None, 8: short, 9: short, 10: None}


_CALL = '<tool_call>\n{"name": "f", "arguments": {"x": 1}}\n</tool_call>'
_CALL2 = '<tool_call>\n{"name": "g", "arguments": {}}\n</tool_call>'
#: Messages (role, content, reasoning, calls), and their prompt: one case for each branch of the template.
EDGES = (
    ("plain", [("system", "S", None, None), ("user", "q", None, None)], "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"),
    ("late system", [("user", "q", None, None), ("system", "S", None, None)], "<|im_start|>user\nq<|im_end|>\n<|im_start|>system\nS<|im_end|>\n"),
    ("answer last", [("user", "q", None, None), ("assistant", "a", None, None)], "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\na<|im_end|>\n"),
    ("thinking kept", [("user", "q", None, None), ("assistant", "<think>\nt\n</think>\n\na", None, None)], "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<think>\nt\n</think>\n\na<|im_end|>\n"),
    ("thinking given", [("user", "q", None, None), ("assistant", "a", "\nt\n", None)], "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<think>\nt\n</think>\n\na<|im_end|>\n"),
    ("thinking dropped", [("user", "q", None, None), ("assistant", "<think>\nt\n</think>\n\na", None, None), ("user", "r", None, None)], "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\nr<|im_end|>\n"),
    ("no question", [("assistant", "a", None, None)], "<|im_start|>assistant\na<|im_end|>\n"),
    ("unknown role", [("user", "q", None, None), ("critic", "x", None, None)], "<|im_start|>user\nq<|im_end|>\n"),
    ("null content", [("user", None, None, None)], "<|im_start|>user\n<|im_end|>\n"),
    ("calls", [("user", "q", None, None), ("assistant", "a", None, [("f", '{"x": 1}'), ("g", "{}")]), ("tool", "1", None, None), ("tool", "2", None, None)],
     f"<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na\n{_CALL}\n{_CALL2}<|im_end|>\n<|im_start|>user\n<tool_response>\n1\n</tool_response>\n<tool_response>\n2\n</tool_response><|im_end|>\n"),
    ("call alone", [("user", "q", None, None), ("assistant", "", None, [("f", '{"x": 1}')])], f"<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n{_CALL}<|im_end|>\n"),
    ("wrapped response", [("user", "q", None, None), ("assistant", "a", "t", None), ("user", "<tool_response>r</tool_response>", None, None)], "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<think>\nt\n</think>\n\na<|im_end|>\n<|im_start|>user\n<tool_response>r</tool_response><|im_end|>\n"),
)


def test_template(spark):
    rows = spark.createDataFrame([(n, m) for n, m, _ in EDGES], f"name string, messages {M.RICH}")
    assert {r["name"]: r["p"] for r in rows.select("name", M.render(F.col("messages")).alias("p")).collect()} == {n: p for n, _, p in EDGES}


_TOOL = '{"type": "function", "function": {"name": "f"}}'
#: Written apart from the template's own strings.
_TOOLS_PROMPT = """<|im_start|>system
S

# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>
{"type": "function", "function": {"name": "f"}}
</tools>

For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:
<tool_call>
{"name": <function-name>, "arguments": <args-json-object>}
</tool_call><|im_end|>
<|im_start|>user
q<|im_end|>
"""


def test_tools(spark):
    rows = spark.createDataFrame([("tools", EDGES[0][1], [_TOOL]), ("no tools", EDGES[0][1], [])], f"name string, messages {M.RICH}, tools array<string>")
    got = {r["name"]: r["p"] for r in rows.select("name", M.render(F.col("messages"), F.col("tools")).alias("p")).collect()}
    assert got == {"tools": _TOOLS_PROMPT, "no tools": EDGES[0][2]}


#: Written apart from the list under test (fixed values): names in order of ids, and which of them are left out on decoding.
_ADDED = "<|endoftext|> <|im_start|> <|im_end|> <|object_ref_start|> <|object_ref_end|> <|box_start|> <|box_end|> <|quad_start|> <|quad_end|> <|vision_start|> <|vision_end|> <|vision_pad|> <|image_pad|> <|video_pad|> <tool_call> </tool_call> <|fim_prefix|> <|fim_middle|> <|fim_suffix|> <|fim_pad|> <|repo_name|> <|file_sep|> <tool_response> </tool_response> <think> </think>"


def test_special_tokens(spark):
    got = [tuple(r) for r in K.special_tokens(spark).orderBy("id").collect()]
    assert got == [(t, 151643 + i, i < 14) for i, t in enumerate(_ADDED.split(" "))]


#: Replies and what is left of them: (name, text, cleaned).
REPLIES = (
    ("plain", "a", "a"),
    ("closed", "<think>x</think>a", "a"),
    ("lines", "<think>\nx\ny\n</think>\n\na\n \n\nb ", "a\nb"),
    ("twice", "<think>x</think>a<think>y</think>b", "ab"),
    ("unclosed", "<think>x", "<think>x"),
    ("nested", "x<think>a<think>b</think>c</think>d", "xc</think>d"),
    ("wide space", "　a　", "a"),
    ("empty", "", ""),
)


def test_clean_replies(spark):
    rows = spark.createDataFrame([r[:2] for r in REPLIES], "name string, reply string").select("name", X.clean_reply(F.col("reply")).alias("c"))
    assert {r["name"]: r["c"] for r in rows.collect()} == {n: c for n, _, c in REPLIES}


_IDS = (("none", [1, 2]), ("once", [1, 151668, 2]), ("twice", [1, 151668, 2, 151668, 3]), ("first", [151668, 4]), ("empty", []))


def test_split_ids(spark):
    rows = spark.createDataFrame(_IDS, "name string, ids array<int>")
    thinking, answer = K.split_thinking_ids(F.col("ids"), DEFAULTS.think_end_id)
    got = {r["name"]: (r["t"], r["a"], r["r"]) for r in rows.select("name", thinking.alias("t"), answer.alias("a"), K.without_prompt(F.col("ids"), F.lit(1)).alias("r")).collect()}
    end = 151668
    assert got == {"none": ([], [1, 2], [2]), "once": ([1, end], [2], [end, 2]), "twice": ([1, end, 2, end], [3], [end, 2, end, 3]), "first": ([end], [4], [4]), "empty": ([], [], [])}


_CUT = ("lossy", 1, 'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: {"choi'), ("lossy", 2, 'ces":[{"delta":{"content":"b"}}]}\n\ndata: {"choices":[{"delta":{}}]}\n\ndata: [DONE]\n\n')


@pytest.mark.parametrize("mode,content", [("lossy", "a"), ("buffered", "ab")])
def test_events_cut_by_reads(spark, mode, content):
    assert [r["content"] for r in S.decode(spark.createDataFrame(_CUT, "mode string, seq int, data string"), "mode", mode=mode).collect()] == [content]


def test_model_listing(spark):
    assert [tuple(r) for r in R.model_listing(spark, 1700000000).collect()] == [("list", "chat-model", "model", 1700000000, "local")]


_SAVED = ((1, None, None, None, None, None, None, None), (2, "", 0.0, 0.0, False, "0", "x", ""), (3, "u", 0.5, 0.9, True, "12px", " 5", "p"))


def test_settings_defaults(spark):
    saved = spark.createDataFrame(_SAVED, "id int, api_url string, temperature double, top_p double, stream_mode boolean, history_length string, max_tokens string, system_prompt string")
    got = [tuple(r) for r in R.load_settings(saved).orderBy("id").collect()]
    url = "http://127.0.0.1:8000/v1"
    assert got == [(1, url, 0.7, 0.7, True, 20, 4096, DEFAULT_SYSTEM), (2, url, 0.0, 0.0, False, 20, 4096, DEFAULT_SYSTEM), (3, "u", 0.5, 0.9, True, 12, 5, "p")]


_SUMMARY = "{'train_runtime': 2222.5196, 'train_samples_per_second': 2.011, 'train_steps_per_second': 0.127, 'train_loss': 2.5, 'entropy': 2.5, 'num_tokens': 464922.0, 'mean_token_accuracy': 0.5, 'epoch': 3.0}"


def test_log_summary(spark):
    s = G.run_summaries(spark.createDataFrame([("S", 0, "100%|###| 282/282"), ("S", 1, _SUMMARY)], "run string, pos int, value string")).first()
    assert (s["run"], s["train_runtime"], s["num_tokens"], round(s["tokens_per_second"] * 10)) == ("S", 2222.5196, 464922.0, 2092)
