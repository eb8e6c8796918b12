"""Registered queries that take the tables' texts through every branch of the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.config import DEFAULT_SYSTEM, DEFAULTS
from turnloom.functions import text as X
from turnloom.functions import tokens as K
from turnloom.operators import conversations as C
from turnloom.operators import requests as R
from turnloom.operators import streams as S
from turnloom.operators import template as M
from turnloom.operators import training as G
from turnloom.plans.registry import long, query, turns_of

# ---------------------------------------------------------------- validation


@query("""
SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 0 THEN 'not json' WHEN 1 THEN 'no list of messages' WHEN 2 THEN 'no list of messages' WHEN 3 THEN 'message without role or content'
  WHEN 4 THEN 'message without role or content' END AS problem FROM conversations""")
def validate_messages(spark, sf_dir):
    """Lines with a turn's text that are whole, broken, or lack what a conversation needs."""
    said = F.to_json(F.struct("role", F.col("text").alias("content")))
    kind = (F.col("conv_id") + F.col("turn")) % 7
    line = (
        F.when(kind == 0, F.concat(F.lit('{"messages": ['), said))
        .when(kind == 1, '{"messages": []}')
        .when(kind == 2, F.concat(F.lit('{"messages": '), F.to_json(F.struct("text")), F.lit("}")))
        .when(kind == 3, F.concat(F.lit('{"messages": ['), said, F.lit(', {"role": "user"}]}')))
        .when(kind == 4, F.concat(F.lit('{"messages": ['), said, F.lit(', "text"]}')))
        .when(kind == 5, F.concat(F.lit('{"more": 1, "messages": [{"role": null, "content": 5, "x": []}, '), said, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"messages": ['), said, F.lit("]}")))
    )
    return C.quarantine(turns_of(spark, sf_dir).withColumn("line", line)).select("conv_id", "turn", "problem")


# ---------------------------------------------------------------- template

#: Pieces of prompts (fixed values); {q} and {a} stand for texts of a conversation.
_USER, _SYSTEM, _ANSWER, _END = "<|im_start|>user\n", "<|im_start|>system\n", "<|im_start|>assistant\n", "<|im_end|>\n"
_CALL = '<tool_call>\n{"name": "f", "arguments": {"x": 1}}\n</tool_call>'
_CALL2 = '<tool_call>\n{"name": "g", "arguments": {}}\n</tool_call>'
_NOTHING = "<think>\n\n</think>\n\n"
#: One case for each branch of the template: messages (role, content, reasoning, calls), and their prompt.
_CASES = (
    ([("system", "{q}", None, None), ("user", "{a}", None, None)], f"{_SYSTEM}{{q}}{_END}{_USER}{{a}}{_END}"),
    ([("user", "{q}", None, None), ("system", "{a}", None, None)], f"{_USER}{{q}}{_END}{_SYSTEM}{{a}}{_END}"),
    ([("user", "{q}", None, None), ("assistant", "{a}", None, None)], f"{_USER}{{q}}{_END}{_ANSWER}{_NOTHING}{{a}}{_END}"),
    ([("user", "{q}", None, None), ("assistant", "<think>\n{q}\n</think>\n\n{a}", None, None)], f"{_USER}{{q}}{_END}{_ANSWER}<think>\n{{q}}\n</think>\n\n{{a}}{_END}"),
    ([("user", "{q}", None, None), ("assistant", "{a}", "\n{q}\n", None)], f"{_USER}{{q}}{_END}{_ANSWER}<think>\n{{q}}\n</think>\n\n{{a}}{_END}"),
    ([("user", "{q}", None, None), ("assistant", "<think>\n{q}\n</think>\n\n{a}", None, None), ("user", "{a}", None, None)], f"{_USER}{{q}}{_END}{_ANSWER}{{a}}{_END}{_USER}{{a}}{_END}"),
    ([("assistant", "{a}", None, None)], f"{_ANSWER}{{a}}{_END}"),
    ([("user", "{q}", None, None), ("critic", "{a}", None, None)], f"{_USER}{{q}}{_END}"),
    ([("user", None, None, None), ("user", "{q}", None, None)], f"{_USER}{_END}{_USER}{{q}}{_END}"),
    ([("user", "{q}", None, None), ("assistant", "{a}", None, [("f", '{"x": 1}'), ("g", "{}")]), ("tool", "{q}", None, None), ("tool", "{a}", None, None)],
     f"{_USER}{{q}}{_END}{_ANSWER}{{a}}\n{_CALL}\n{_CALL2}{_END}{_USER}<tool_response>\n{{q}}\n</tool_response>\n<tool_response>\n{{a}}\n</tool_response>{_END}".replace(f"{_USER}<tool", "<|im_start|>user\n<tool")),
    ([("user", "{q}", None, None), ("assistant", "", None, [("f", '{"x": 1}')])], f"{_USER}{{q}}{_END}{_ANSWER}{_NOTHING}{_CALL}{_END}"),
    ([("user", "{q}", None, None), ("assistant", "{a}", "{q}", None), ("user", "<tool_response>{a}</tool_response>", None, None)], f"{_USER}{{q}}{_END}{_ANSWER}<think>\n{{q}}\n</think>\n\n{{a}}{_END}{_USER}<tool_response>{{a}}</tool_response>{_END}"),
)


def _pieces(pattern: str) -> list[tuple[str, bool]]:
    """A pattern's texts in order, and whether each is the name of a column."""
    import re

    return [(p[1:-1], True) if p in ("{q}", "{a}") else (p, False) for p in re.split(r"(\{q\}|\{a\})", pattern) if p]


def _filled(pattern: str | None):
    if pattern is None:
        return F.lit(None).cast("string")
    return F.concat(F.lit(""), *(F.col(p) if named else F.lit(p) for p, named in _pieces(pattern)))


def _filled_sql(pattern: str) -> str:
    text = lambda p: "'" + p.replace("'", "''") + "'"
    return " || ".join(p if named else text(p) for p, named in _pieces(pattern))


#: Of each conversation the first two texts, without what the template would take for its own.
_TWO = "SELECT conv_id, arg_min(text, turn) AS q, coalesce(arg_min(text, turn) FILTER (WHERE turn > 0), '') AS a FROM conversations GROUP BY conv_id"


def _two(spark, sf_dir):
    return turns_of(spark, sf_dir).groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"), F.coalesce(F.min_by("text", F.when(F.col("turn") > 0, F.col("turn"))), F.lit("")).alias("a"))


@query("SELECT conv_id, md5(CASE conv_id % 12 " + " ".join(f"WHEN {i} THEN {_filled_sql(p)}" for i, (_, p) in enumerate(_CASES)) + f" END) AS prompt FROM ({_TWO})")
def render_edge_cases(spark, sf_dir):
    """Texts of each conversation in one of twelve shapes, one for each branch of the template."""
    calls = lambda c: F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("arguments")) for n, a in c)) if c else F.lit(None).cast("array<struct<name:string,arguments:string>>")
    message = lambda r, c, t, k: F.struct(F.lit(r).alias("role"), _filled(c).alias("content"), _filled(t).alias("reasoning_content"), calls(k).alias("tool_calls"))
    shapes = F.array(*(F.array(*(message(*m) for m in messages)).cast(M.RICH) for messages, _ in _CASES))
    rows = _two(spark, sf_dir).select("conv_id", F.get(shapes, (F.col("conv_id") % len(_CASES)).cast("int")).alias("messages"))
    return rows.select("conv_id", F.md5(M.render(F.col("messages"))).alias("prompt"))


#: What stands around a list of tools (fixed values, written apart from the template's own).
_TOOLS_BEFORE = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>\n"
_TOOLS_AFTER = '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call><|im_end|>\n'
_TOOL = ("'{\"type\": \"function\", \"function\": {\"name\": \"f'", "'\"}}'")


@query(f"""
SELECT conv_id, md5(CASE WHEN conv_id % 3 = 0 THEN '{_SYSTEM}' || q || '{_END}' ELSE '{_SYSTEM}' || CASE WHEN conv_id % 3 = 1 THEN q || chr(10) || chr(10) ELSE '' END || '{_TOOLS_BEFORE}' || {_TOOL[0]} || conv_id || {_TOOL[1]}
  || chr(10) || {_TOOL[0]} || '_' || {_TOOL[1]} || '{_TOOLS_AFTER}' END || CASE WHEN conv_id % 3 = 2 THEN '{_USER}' || q || '{_END}' ELSE '' END || '{_USER}' || a || '{_END}') AS prompt FROM ({_TWO})""")
def render_tools(spark, sf_dir):
    """Prompts with two tools, with and without a system message, and with an empty list of tools."""
    first = F.when(F.col("conv_id") % 3 == 2, "user").otherwise("system")
    said = F.array(F.struct(first.alias("role"), F.col("q").alias("content")), F.struct(F.lit("user").alias("role"), F.col("a").alias("content")))
    named = lambda n: F.concat(F.lit(_TOOL[0][1:-1]), n, F.lit(_TOOL[1][1:-1]))
    tools = F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(named(F.col("conv_id").cast("string")), named(F.lit("_"))))
    rows = _two(spark, sf_dir).select("conv_id", M.rich(said).alias("messages"), tools.alias("tools"))
    return rows.select("conv_id", F.md5(M.render(F.col("messages"), F.col("tools"))).alias("prompt"))


# ---------------------------------------------------------------- tokens

#: Names of added tokens in order of ids (fixed values, written apart from the list under test); the first 14 are left out on decoding.
_ADDED = "<|endoftext|> <|im_start|> <|im_end|> <|object_ref_start|> <|object_ref_end|> <|box_start|> <|box_end|> <|quad_start|> <|quad_end|> <|vision_start|> <|vision_end|> <|vision_pad|> <|image_pad|> <|video_pad|> <tool_call> </tool_call> <|fim_prefix|> <|fim_middle|> <|fim_suffix|> <|fim_pad|> <|repo_name|> <|file_sep|> <tool_response> </tool_response> <think> </think>"
_NTH = "string_split('" + _ADDED + "', ' ')[CAST((conv_id + turn) % 26 AS INT) + 1]"


@query(f"SELECT conv_id, turn, md5(concat(text, CASE WHEN (conv_id + turn) % 26 < 14 THEN '' ELSE {_NTH} END, text)) AS shown, md5(concat(text, {_NTH}, text)) AS whole FROM conversations")
def special_tokens(spark, sf_dir):
    """Each added token between two copies of a text: decoding leaves fourteen of them out, and all stand where none is skipped."""
    ids = F.concat(K.code_points(F.col("text")), F.array((F.lit(151643) + (F.col("conv_id") + F.col("turn")) % 26).cast("int")), K.code_points(F.col("text")))
    rows = turns_of(spark, sf_dir).select("conv_id", "turn", ids.alias("ids"))
    return rows.select("conv_id", "turn", F.md5(K.from_code_points(F.col("ids"))).alias("shown"), F.md5(K.from_code_points(F.col("ids"), skip_special=False)).alias("whole"))


@query("""
SELECT conv_id, turn, CAST(CASE WHEN contains(text, ' ') THEN length(text) - strpos(reverse(text), ' ') + 1 ELSE 0 END AS BIGINT) AS n_thinking,
  md5(CASE WHEN contains(text, ' ') THEN right(text, strpos(reverse(text), ' ') - 1) ELSE text END) AS answer, CAST(greatest(length(text) - turn, 0) AS BIGINT) AS n_reply FROM conversations""")
def split_ids(spark, sf_dir):
    """Ids of texts whose spaces stand for the end of reasoning: what lies before and after the last one, and without a prompt's ids."""
    ids = F.transform(K.code_points(F.col("text")), lambda i: F.when(i == 32, DEFAULTS.think_end_id).otherwise(i))
    thinking, answer = K.split_thinking_ids(F.col("ids"), DEFAULTS.think_end_id)
    rows = turns_of(spark, sf_dir).select("conv_id", "turn", ids.alias("ids"))
    return rows.select("conv_id", "turn", long(F.size(thinking), "n_thinking"), F.md5(K.from_code_points(answer)).alias("answer"), long(F.size(K.without_prompt(F.col("ids"), F.col("turn"))), "n_reply"))


# ---------------------------------------------------------------- replies

#: Replies around a text {q}, and what is left of them.
_REPLIES = (
    ("{q}", "{q}"), ("<think>x</think>{q}", "{q}"), ("<think>\nx\ny\n</think>\n\n{q}\n \n\n{q} ", "{q}\n{q}"), ("<think>x</think>{q}<think>{q}</think>b", "{q}b"),
    ("<think>{q}", "<think>{q}"), ("x<think>a<think>{q}</think>c</think>{q}", "xc</think>{q}"), ("　{q}　", "{q}"), ("{q}</think>", "{q}</think>"),
)
#: The text without outer white space and blank lines, which cleaning takes from it too.
_LEAN = r"trim(regexp_replace(regexp_replace(text, '\n\s*\n', chr(10), 'g'), '^\s+|\s+$', '', 'g'))"


@query(f"SELECT conv_id, turn, md5(CASE turn % 8 " + " ".join(f"WHEN {i} THEN {_filled_sql(c)}" for i, (_, c) in enumerate(_REPLIES)) + f" END) AS cleaned FROM (SELECT *, {_LEAN} AS q FROM conversations)")  # noqa: F541
def think_filter(spark, sf_dir):
    """Replies with closed, open, nested and no reasoning around each text, as they are shown."""
    lean = X.strip(X.collapse_blank_lines(F.col("text")))
    shapes = F.array(*(_filled(p) for p, _ in _REPLIES))
    rows = turns_of(spark, sf_dir).withColumn("q", lean)
    return rows.select("conv_id", "turn", F.md5(X.clean_reply(F.get(shapes, (F.col("turn") % 8).cast("int")))).alias("cleaned"))


@query("""
WITH w AS (SELECT concat_ws('-', conv_id, turn) AS reply_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w, turn FROM conversations WHERE role = 'assistant')
SELECT reply_id, md5(array_to_string(w, '')) AS buffered, md5(array_to_string(list_concat(w[:CAST(len(w) // 2 AS BIGINT)], w[CAST(len(w) // 2 AS BIGINT) + 2:]), '')) AS lossy FROM w WHERE len(w) > 0""")
def sse_decode_cut(spark, sf_dir):
    """Replies in two reads that cut the event in their middle: it is lost where each read is taken by itself, and whole where they are joined."""
    said = turns_of(spark, sf_dir).where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("reply_id"), F.filter(F.split("text", " "), lambda x: x != "").alias("w")).where("size(w) > 0")
    events = F.transform("w", lambda p: S.chunk(p, F.lit("m"), F.col("reply_id"), F.lit(1700000000), F.lit(None)))
    sent = said.select("reply_id", events.alias("e"), F.floor(F.size("w") / 2).cast("int").alias("half"))
    joined = lambda first, n: F.array_join(F.slice("e", first, n), "")
    middle, cut = F.get("e", F.col("half")), 20
    before = F.concat(joined(F.lit(1), F.col("half")), F.substring(middle, 1, cut))
    after = F.concat(F.substring(middle, cut + 1, 2**31 - 1), joined(F.col("half") + 2, F.size("e")))
    reads = sent.select("reply_id", F.posexplode(F.array(before, after)).alias("seq", "data"))
    read = lambda mode: S.decode(reads, "reply_id", mode=mode).select("reply_id", F.md5("content").alias(mode))
    return read("lossy").join(read("buffered"), "reply_id")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n, TRUE AS valid, TRUE AS all_different FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def reply_ids(spark, sf_dir):
    """New ids of replies: their form, and that no two are the same."""
    rows = turns_of(spark, sf_dir).where("role = 'assistant'").select("conv_id", S.new_id().alias("id"))
    good = F.bool_and(F.col("id").rlike("^chatcmpl-[0-9a-f]{32}$"))
    return rows.groupBy("conv_id").agg(long(F.count("*"), "n"), good.alias("valid"), (F.count_distinct("id") == F.count("*")).alias("all_different"))


# ---------------------------------------------------------------- listings, settings, training


@query("SELECT 'list' AS list_object, 'model-' || (conv_id % 7) AS id, 'model' AS object, CAST(min(1700000000 + conv_id) AS BIGINT) AS created, 'local' AS owned_by FROM conversations GROUP BY conv_id % 7")
def model_listing(spark, sf_dir):
    """The models that conversations were held with, each since its first one."""
    seen = turns_of(spark, sf_dir).select(F.concat(F.lit("model-"), (F.col("conv_id") % 7).cast("string")).alias("model"), (F.col("conv_id") + 1700000000).alias("created"))
    return R.models_of(seen)


@query(f"""
SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'u' || conv_id ELSE 'http://127.0.0.1:8000/v1' END AS api_url, CASE turn % 3 WHEN 0 THEN 0.7 WHEN 1 THEN 0.0 ELSE length(text) / 8.0 END::DOUBLE AS temperature,
  turn % 3 <> 1 AS stream_mode, CAST(CASE WHEN turn % 3 = 2 AND conv_id % 9 <> 0 THEN conv_id % 9 ELSE 20 END AS BIGINT) AS history_length, md5(CASE WHEN turn % 3 = 2 AND text <> '' THEN text ELSE '{DEFAULT_SYSTEM}' END) AS system_prompt
FROM conversations""")
def settings_defaults(spark, sf_dir):
    """Settings that lack fields, hold empty ones or are whole, read with their defaults."""
    by = lambda empty, own: F.when(F.col("turn") % 3 == 1, empty).when(F.col("turn") % 3 == 2, own)
    saved = turns_of(spark, sf_dir).select(
        "conv_id", "turn", by("", F.concat(F.lit("u"), F.col("conv_id").cast("string"))).alias("api_url"), by(0.0, F.length("text") / 8).alias("temperature"), by(0.0, 0.5).alias("top_p"), by(False, True).alias("stream_mode"),
        by("0", F.concat((F.col("conv_id") % 9).cast("string"), F.lit("px"))).alias("history_length"), by("x", " 5").alias("max_tokens"), by("", F.col("text")).alias("system_prompt"),
    )
    return R.load_settings(saved).select("conv_id", "turn", "api_url", "temperature", "stream_mode", "history_length", F.md5("system_prompt").alias("system_prompt"))


@query("""
WITH p AS (SELECT CAST(3 * ceil(count(DISTINCT conv_id) / 16.0) AS BIGINT) AS n FROM conversations), w AS (SELECT n, CAST(ceil(0.03::DOUBLE * n) AS BIGINT) AS w FROM p),
s AS (SELECT n, w, unnest(range(1, n + 1)) AS s FROM w)
SELECT CAST(s AS BIGINT) AS step, CAST(round(1e12 * CASE WHEN s - 1 < w THEN 1e-4 * (s - 1) / greatest(w, 1) ELSE 1e-4 * 0.5 * (1 + cos(pi() * (s - 1 - w) / greatest(n - w, 1))) END) AS BIGINT) AS rate_e12 FROM s""")
def lr_schedule(spark, sf_dir):
    """Learning rates of a training on all conversations, three times over."""
    n = turns_of(spark, sf_dir).agg(F.count_distinct("conv_id").alias("n")).select(G.total_steps(F.col("n"), F.lit(3)).alias("s")).first()["s"]
    return G.learning_rates(spark, n).select("step", long(F.round(F.col("learning_rate") * 1e12), "rate_e12"))


@query("""
SELECT conv_id AS run, count(*) / 8.0::DOUBLE AS train_runtime, CAST(sum(length(text)) AS DOUBLE) AS num_tokens, CAST(sum(length(text)) AS DOUBLE) / (count(*) / 8.0::DOUBLE) AS tokens_per_second FROM conversations GROUP BY conv_id""")
def log_summary(spark, sf_dir):
    """A log of each conversation that ends with its summary, between progress bars."""
    sums = turns_of(spark, sf_dir).groupBy("conv_id").agg((F.count("*") / 8).alias("t"), F.sum(F.length("text")).cast("double").alias("n"))
    row = F.concat(F.lit("{'train_runtime': "), F.col("t").cast("string"), F.lit(", 'train_samples_per_second': 2.0, 'train_steps_per_second': 0.1, 'train_loss': 2.5, 'entropy': 2.5, 'num_tokens': "), F.col("n").cast("string"), F.lit(", 'mean_token_accuracy': 0.5, 'epoch': 3.0}"))
    lines = sums.select(F.col("conv_id").alias("run"), F.posexplode(F.array(F.lit("100%|###| 282/282"), row, F.lit(""))).alias("pos", "value"))
    return G.run_summaries(lines).select("run", "train_runtime", "num_tokens", "tokens_per_second")
