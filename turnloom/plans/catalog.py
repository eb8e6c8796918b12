"""Registered queries over the tables, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.config import DEFAULT_SYSTEM, DEFAULTS
from turnloom.functions import text as X
from turnloom.functions import tokens as K
from turnloom.operators import conversations as C
from turnloom.operators import labels as L
from turnloom.operators import requests as R
from turnloom.operators import streams as S
from turnloom.operators import template as M
from turnloom.operators import training as G
from turnloom.plans.registry import DIGEST, NEST, ORACLES, QUERIES, digest, long, nested, query, turns_of
from turnloom.sources.shared import delete, scratch
from turnloom.sources.tables import read_table
from turnloom.streaming import replies as live

# ---------------------------------------------------------------- conversations


@query("SELECT count(*) AS n_turns, count(DISTINCT conv_id) AS n_conversations FROM conversations")
def row_count(spark, sf_dir):
    return turns_of(spark, sf_dir).agg(long(F.count("*"), "n_turns"), long(F.count_distinct("conv_id"), "n_conversations"))


@query(f"""
SELECT conv_id, CAST(len(m) AS BIGINT) AS n_messages, CAST(list_sum(list_transform(m, lambda x: length(x.content))) AS BIGINT) AS n_chars,
  array_to_string(list_transform(m, lambda x: x.role), ',') AS roles, {DIGEST.format(m='m')} AS digest
FROM ({NEST})""")
def conversations_nested_stats(spark, sf_dir):
    m = F.col("messages")
    return nested(spark, sf_dir).select(
        "conv_id", long(F.size(m), "n_messages"), long(F.aggregate(m, F.lit(0), lambda t, x: t + F.length(x["content"])), "n_chars"), F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"), digest(m)
    )


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn, role, text FROM conversations")
def flatten_conversations(spark, sf_dir):
    return C.flatten(nested(spark, sf_dir)).select("conv_id", long(F.col("turn"), "turn"), "role", "text")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages, bool_and(role IS NOT NULL) AS valid FROM conversations GROUP BY conv_id")
def validate_conversations(spark, sf_dir):
    lines = nested(spark, sf_dir).select("conv_id", "messages", F.to_json(F.struct("messages")).alias("line"))
    return C.quarantine(lines).select("conv_id", long(F.size("messages"), "n_messages"), F.col("problem").isNull().alias("valid"))


_SYS = f"{{'role': 'system', 'content': '{DEFAULT_SYSTEM}'}}"
_ENSURED = f"SELECT conv_id, CASE WHEN len(m) = 0 OR m[1].role <> 'system' THEN list_concat([{_SYS}], m) ELSE m END AS m FROM ({NEST})"


@query(f"SELECT conv_id, CAST(len(m) AS BIGINT) AS n_messages, {DIGEST.format(m='m')} AS digest FROM ({_ENSURED})")
def ensure_system(spark, sf_dir):
    m = C.ensure_system(F.col("messages"), DEFAULT_SYSTEM)
    return nested(spark, sf_dir).select("conv_id", long(F.size(m), "n_messages"), digest(m))


@query(f"""
SELECT conv_id, CAST(len(w) AS BIGINT) AS n_messages, {DIGEST.format(m='w')} AS digest
FROM (SELECT conv_id, CASE WHEN len(m) - 1 > 4 THEN list_concat(m[1:1], m[len(m) - 3:]) ELSE m END AS w FROM ({_ENSURED}))""")
def history_window(spark, sf_dir):
    m = C.history_window(F.col("m"), 4)
    return nested(spark, sf_dir).select("conv_id", C.ensure_system(F.col("messages"), DEFAULT_SYSTEM).alias("m")).select("conv_id", long(F.size(m), "n_messages"), digest(m))


@query("SELECT conv_id, count(*) FILTER (WHERE role <> 'system') AS n_history FROM conversations GROUP BY conv_id")
def history_count(spark, sf_dir):
    return nested(spark, sf_dir).select("conv_id", long(C.history_count(F.col("messages")), "n_history"))


@query(f"""
SELECT conv_id, {DIGEST.format(m="list_append(m, {'role': 'user', 'content': 'And then?'})")} AS appended,
  {DIGEST.format(m="list_concat([{'role': 'system', 'content': 'Be brief.'}], m[2:])")} AS replaced,
  {DIGEST.format(m='m')} AS kept, {DIGEST.format(m='m[1:1]')} AS cleared
FROM ({_ENSURED})""")
def edit_history(spark, sf_dir):
    ensured = nested(spark, sf_dir).select("conv_id", C.ensure_system(F.col("messages"), DEFAULT_SYSTEM).alias("m"))
    return ensured.select(
        "conv_id", digest(C.append_message(F.col("m"), "user", "And then?"), "appended"), digest(C.replace_system(F.col("m"), F.lit(" Be brief.\n")), "replaced"),
        digest(C.replace_system(F.col("m"), F.lit(" \n")), "kept"), digest(C.clear_history(F.col("m")), "cleared"),
    )


@query("""
SELECT conv_id, CAST(row_number() OVER w AS BIGINT) AS k, CAST(sum(length(text)) OVER w AS BIGINT) AS n_chars
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def prefix_growth(spark, sf_dir):
    grown = nested(spark, sf_dir).select("conv_id", F.posexplode(C.prefixes(F.col("messages"))).alias("k", "p"))
    return grown.select("conv_id", long(F.col("k") + 1, "k"), long(F.aggregate("p", F.lit(0), lambda t, x: t + F.length(x["content"])), "n_chars"))


# ---------------------------------------------------------------- template

#: Turns with what the template adds, for plain conversations.
_FLAT = """
SELECT *, coalesce(max(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS asked,
  lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS is_last FROM conversations"""
_BLOCK = "'<|im_start|>' || role || chr(10) || {think} || text || '<|im_end|>' || chr(10)"
_NO_THINK = "'<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)"
_FINAL = _BLOCK.format(think=f"CASE WHEN role = 'assistant' AND asked AND is_last THEN {_NO_THINK} ELSE '' END")
_STEP = _BLOCK.format(think=f"CASE WHEN role = 'assistant' AND asked THEN {_NO_THINK} ELSE '' END")


@query(f"""
SELECT conv_id, CAST(length(p) AS BIGINT) AS n_chars, md5(p) AS rendered, md5(p || '<|im_start|>assistant' || chr(10)) AS prompt,
  md5(p || '<|im_start|>assistant' || chr(10) || {_NO_THINK}) AS prompt_no_thinking
FROM (SELECT conv_id, string_agg({_FINAL}, '' ORDER BY turn) AS p FROM ({_FLAT}) GROUP BY conv_id)""")
def render_chat(spark, sf_dir):
    m = M.rich(F.col("messages"))
    p = M.render(m)
    return nested(spark, sf_dir).select("conv_id", long(F.length(p), "n_chars"), F.md5(p).alias("rendered"), F.md5(M.render(m, generation_prompt=True)).alias("prompt"), F.md5(M.render(m, generation_prompt=True, enable_thinking=False)).alias("prompt_no_thinking"))


# ---------------------------------------------------------------- tokens and labels


@query("""
SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n_tokens,
  CAST(coalesce(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))), 0) AS BIGINT) AS id_sum FROM conversations""")
def token_lengths(spark, sf_dir):
    ids = turns_of(spark, sf_dir).select("conv_id", "turn", K.code_points(F.col("text")).alias("ids"))
    return ids.select("conv_id", "turn", long(F.size("ids"), "n_tokens"), F.aggregate("ids", F.lit(0).cast("long"), lambda t, i: t + i).alias("id_sum"))


@query("SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def decode_tokens(spark, sf_dir):
    ids = turns_of(spark, sf_dir).select("conv_id", "turn", F.concat(F.array(F.lit(DEFAULTS.end_id)), K.code_points(F.col("text"))).alias("ids"))
    return ids.select("conv_id", "turn", F.md5(K.from_code_points(F.col("ids"))).alias("digest"))


_DELTAS = f"""
SELECT conv_id, turn, role, CASE WHEN coalesce(lag(role = 'assistant' AND asked) OVER (PARTITION BY conv_id ORDER BY turn), FALSE)
  THEN substr({_STEP}, 20) ELSE {_STEP} END AS delta FROM ({_FLAT})"""
_ALIGNED = f"SELECT conv_id, turn, role, {_FINAL} AS delta FROM ({_FLAT})"
_LABELS = "SELECT conv_id, turn, CAST(length(delta) AS BIGINT) AS n_tokens, role = 'assistant' AS supervised, md5(delta) AS digest FROM ({})"


def _delta_rows(spark, sf_dir, mode):
    return L.flat_deltas(turns_of(spark, sf_dir), mode=mode).select("conv_id", "turn", long(F.length("delta"), "n_tokens"), "supervised", F.md5("delta").alias("digest"))


@query(_LABELS.format(_DELTAS))
def response_labels_reference(spark, sf_dir):
    return _delta_rows(spark, sf_dir, "reference")


@query(_LABELS.format(_ALIGNED))
def response_labels_aligned(spark, sf_dir):
    return _delta_rows(spark, sf_dir, "aligned")


@query(_LABELS.format(_DELTAS))
def response_labels_by_prefix(spark, sf_dir):
    rows = nested(spark, sf_dir).select("conv_id", "messages", F.posexplode(L.nested_deltas(M.rich(F.col("messages")))).alias("turn", "delta"))
    return rows.select("conv_id", long(F.col("turn"), "turn"), long(F.length("delta"), "n_tokens"), (F.get("messages", F.col("turn"))["role"] == "assistant").alias("supervised"), F.md5("delta").alias("digest"))


def _report_sql(most: int, deltas: str = _DELTAS) -> str:
    return f"""
WITH s AS (SELECT conv_id, role, length(delta) AS n, sum(length(delta)) OVER (PARTITION BY conv_id ORDER BY turn) AS until FROM ({deltas})),
k AS (SELECT *, greatest(0, least(n, {most} - until + n)) AS kept FROM s)
SELECT conv_id, CAST(sum(kept) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN kept ELSE 0 END) AS BIGINT) AS n_supervised,
  CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE kept END) AS BIGINT) AS n_masked, CAST(sum(n) AS BIGINT) AS n_before, sum(n) > {most} AS truncated FROM k GROUP BY conv_id"""


@query(_report_sql(DEFAULTS.max_seq_len))
def response_labels_report(spark, sf_dir):
    return L.label_report(L.flat_deltas(turns_of(spark, sf_dir)), DEFAULTS.max_seq_len)


@query(_report_sql(DEFAULTS.max_seq_len_gpu, _ALIGNED))
def truncate_report(spark, sf_dir):
    return L.label_report(L.flat_deltas(turns_of(spark, sf_dir), mode="aligned"), DEFAULTS.max_seq_len_gpu)


_FEATURES = f"""
SELECT conv_id, list_transform(string_split(string_agg(delta, '' ORDER BY turn), ''), lambda c: unicode(c))[1:{DEFAULTS.max_seq_len}] AS ids,
  flatten(list(CASE WHEN role = 'assistant' THEN list_transform(string_split(delta, ''), lambda c: unicode(c)) ELSE list_transform(string_split(delta, ''), lambda c: -100) END ORDER BY turn))[1:{DEFAULTS.max_seq_len}] AS labels
FROM ({_DELTAS}) GROUP BY conv_id"""


def _features(spark, sf_dir):
    return L.features(L.flat_deltas(turns_of(spark, sf_dir)), DEFAULTS.max_seq_len)


def _total(c):
    return F.aggregate(c, F.lit(0).cast("long"), lambda t, i: t + i)


@query(f"""
SELECT conv_id, CAST(len(ids) AS BIGINT) AS n_ids, CAST(len(ids) AS BIGINT) AS n_attended, CAST(list_sum(ids) AS BIGINT) AS id_sum, CAST(list_sum(labels) AS BIGINT) AS label_sum,
  CAST(len(list_filter(labels, lambda x: x <> -100)) AS BIGINT) AS n_labels FROM ({_FEATURES})""")
def label_features(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select("conv_id", long(F.size("input_ids"), "n_ids"), _total("attention_mask").alias("n_attended"), _total("input_ids").alias("id_sum"), _total("labels").alias("label_sum"), long(F.size(F.filter("labels", lambda x: x != DEFAULTS.ignore_label)), "n_labels"))


@query(f"""
WITH f AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY conv_id) - 1) / 16) AS BIGINT) AS batch_id FROM ({_FEATURES})),
p AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS n FROM f)
SELECT batch_id, conv_id, CAST(n AS BIGINT) AS n_ids, CAST(len(ids) AS BIGINT) AS n_attended, CAST(list_sum(ids) + (n - len(ids)) * 151643 AS BIGINT) AS id_sum,
  CAST(list_sum(labels) - (n - len(ids)) * 100 AS BIGINT) AS label_sum FROM p""")
def pad_batches(spark, sf_dir):
    b = L.pad_batches(_features(spark, sf_dir))
    return b.select("batch_id", "conv_id", long(F.size("input_ids"), "n_ids"), _total("attention_mask").alias("n_attended"), _total("input_ids").alias("id_sum"), _total("labels").alias("label_sum"))


# ---------------------------------------------------------------- text

@query(r"""
WITH t AS (SELECT conv_id, turn, text, '<think>' || role || chr(10) || '</think>' || chr(10) || chr(10) || text || ' ' AS x FROM conversations)
SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(x, '<think>(.|\n)*?</think>', '', 'g'), '\n\s*\n', chr(10), 'g'), ' ' || chr(10))) AS cleaned,
  regexp_extract(x, '<think>((?:.|\n)*?)\n*</think>', 1) AS thinking, md5(text || ' ') AS answer FROM t""")
def think_split(spark, sf_dir):
    x = F.concat(F.lit("<think>"), "role", F.lit("\n</think>\n\n"), "text", F.lit(" "))
    return turns_of(spark, sf_dir).select("conv_id", "turn", F.md5(X.clean_reply(x)).alias("cleaned"), X.reasoning_of(x).alias("thinking"), F.md5(X.answer_of(x)).alias("answer"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def escape_html(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", F.md5(X.escape_html(F.col("html"))).alias("escaped"))


#: Texts by the rest of a turn's number.
_BLANKS = ("", " \n\t", "　", " a ", None)


@query("SELECT conv_id, turn, turn % 5 <> 3 AS blank FROM conversations")
def blank_input(spark, sf_dir):
    text = F.get(F.array(*map(F.lit, _BLANKS)), (F.col("turn") % 5).cast("int"))
    return turns_of(spark, sf_dir).select("conv_id", "turn", X.is_blank(text).alias("blank"))


# ---------------------------------------------------------------- envelopes and streams


def _answers(spark, sf_dir):
    return turns_of(spark, sf_dir).where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("reply_id"), F.col("text").alias("content"))


def _events(answers):
    return S.encode_characters(answers, "reply_id", F.lit("m"), F.lit(1700000000), F.concat(F.lit("chatcmpl-"), "reply_id"))


_REPLY = "SELECT concat_ws('-', conv_id, turn) AS reply_id, text FROM conversations WHERE role = 'assistant'"


@query(f"SELECT reply_id, CAST(length(text) + 2 AS BIGINT) AS n_events, CAST(length(text) AS BIGINT) AS n_pieces, CAST(1 AS BIGINT) AS n_stops, CAST(1 AS BIGINT) AS n_done FROM ({_REPLY})")
def sse_encode(spark, sf_dir):
    finish = F.get_json_object(F.substring("event", 7, 2**31 - 1), "$.choices[0].finish_reason")
    return _events(_answers(spark, sf_dir)).groupBy("reply_id").agg(long(F.count("*"), "n_events"), long(F.count_if(F.col("part") == 0), "n_pieces"), long(F.count_if(finish == "stop"), "n_stops"), long(F.count_if(F.col("event") == "data: [DONE]\n\n"), "n_done"))


@query(f"SELECT reply_id, md5(text) AS content FROM ({_REPLY})")
def sse_decode(spark, sf_dir):
    reads = _events(_answers(spark, sf_dir)).select("reply_id", (F.col("part") * 1_000_000_000 + F.col("seq")).alias("seq"), F.col("event").alias("data"))
    return S.decode(reads, "reply_id").select("reply_id", F.md5("content").alias("content"))


#: Characters whose events lie in the stream's folder at once, at least, and the most rounds that replies are dealt to.
_AT_ONCE, _ROUNDS = 4_000_000, 8


@query(f"SELECT reply_id, TRUE AS done, md5(text) AS content FROM ({_REPLY})")
def stream_replies(spark, sf_dir):
    """Replies as event lines in files, put together by the stream.

    A line is some 250 bytes for each character, so the files are compressed, and the
    replies arrive in rounds: what the stream has taken in is deleted before the next are written.
    """
    place = scratch(spark, "stream")
    # lines of a reply lie on both sides of an hour, and so in two windows of any clock
    at = F.when(F.col("position") % 2 == 0, "2024-01-01 00:59:59").otherwise("2024-01-01 01:00:01").cast("timestamp")
    answers = _answers(spark, sf_dir)
    characters = answers.agg(F.sum(F.length("content"))).first()[0] or 0
    rounds = min(_ROUNDS, characters // _AT_ONCE + 1)
    for i in range(rounds):
        lines = _events(answers.where(F.pmod(F.xxhash64("reply_id"), F.lit(rounds)) == i)).select("reply_id", F.col("position").alias("seq"), F.rtrim(F.regexp_replace("event", "\n", "")).alias("line"), at.alias("at"))
        lines.write.json(f"{place}/lines", compression="gzip")
        live.run_available(live.read_lines(spark, f"{place}/lines"), f"{place}/replies")
        delete(spark, f"{place}/lines")
    delete(spark, f"{place}/replies-state")
    return spark.read.schema(live.REPLIES).parquet(f"{place}/replies").select("reply_id", "done", F.md5("content").alias("content"))


@query(f"SELECT reply_id, 'stop' AS finish, 'chat.completion' AS kind, '0' AS usage, md5(text) AS content FROM ({_REPLY})")
def completion_envelope(spark, sf_dir):
    body = S.completion(F.col("content"), F.lit("m"), F.concat(F.lit("chatcmpl-"), "reply_id"), F.lit(1700000000))
    j = lambda p: F.get_json_object("body", p)
    return _answers(spark, sf_dir).select("reply_id", body.alias("body")).select("reply_id", j("$.choices[0].finish_reason").alias("finish"), j("$.object").alias("kind"), j("$.usage.total_tokens").alias("usage"), F.md5(S.completion_content(F.col("body"))).alias("content"))


@query("""
SELECT conv_id, turn, CAST(198 + 51 * (turn % 3) + conv_id % 4 AS INT) AS status, 198 + 51 * (turn % 3) + conv_id % 4 BETWEEN 200 AND 299 AS stored,
  md5(CASE WHEN 198 + 51 * (turn % 3) + conv_id % 4 BETWEEN 200 AND 299 THEN text ELSE 'HTTP ' || (198 + 51 * (turn % 3) + conv_id % 4) END) AS content FROM conversations""")
def error_rows(spark, sf_dir):
    answered = turns_of(spark, sf_dir).select("conv_id", "turn", (198 + 51 * (F.col("turn") % 3) + F.col("conv_id") % 4).cast("int").alias("status"), F.col("text").alias("content"))
    return R.with_status(answered, F.col("status")).select("conv_id", "turn", "status", "stored", F.md5("content").alias("content"))


# ---------------------------------------------------------------- parameters

#: Request bodies by the rest of a conversation's id.
_BODIES = (
    '{"messages":[]}',
    '{"messages":[],"temperature":null,"max_tokens":null}',
    '{"messages":[],"temperature":0,"top_p":0,"max_tokens":0}',
    '{"messages":[],"temperature":-1,"top_p":0.5,"extra":1}',
    '{"messages":[],"temperature":0.3,"max_tokens":7,"stream":true,"model":"m"}',
)


@query("""SELECT conv_id, model, temperature, top_p, max_tokens, stream, greedy FROM (SELECT DISTINCT conv_id FROM conversations) JOIN (VALUES
  (0, 'chat-model', 0.7::DOUBLE, 0.7::DOUBLE, 4096, FALSE, FALSE), (1, 'chat-model', 0.7, 0.7, 1024, FALSE, FALSE), (2, 'chat-model', 0.7, 0.7, 1024, FALSE, FALSE),
  (3, 'chat-model', NULL, NULL, 4096, FALSE, TRUE), (4, 'm', 0.3, 0.7, 7, TRUE, FALSE)) v(id, model, temperature, top_p, max_tokens, stream, greedy) ON id = conv_id % 5""")
def param_defaults(spark, sf_dir):
    bodies = turns_of(spark, sf_dir).select("conv_id").distinct().withColumn("body", F.get(F.array(*map(F.lit, _BODIES)), (F.col("conv_id") % 5).cast("int")))
    return R.generation_params(R.parse_requests(bodies, gpu=True)).select("conv_id", "model", "temperature", "top_p", "max_tokens", "stream", "greedy")


# ---------------------------------------------------------------- training plans and logs


@query("SELECT CAST(n AS BIGINT) AS n_rows, CAST(3 * ceil(n / 16.0) AS BIGINT) AS steps, CAST(ceil(0.03::DOUBLE * CAST(3 * ceil(n / 16.0) AS BIGINT)) AS BIGINT) AS warmup FROM (SELECT count(DISTINCT conv_id) AS n FROM conversations)")
def train_step_plan(spark, sf_dir):
    n = turns_of(spark, sf_dir).agg(F.count_distinct("conv_id").alias("n_rows"))
    steps = G.total_steps(F.col("n_rows"), F.lit(3))
    return n.select("n_rows", steps.alias("steps"), G.warmup_steps(steps).alias("warmup"))


def _log_lines(spark, sf_dir):
    """A log with a row of each kind per conversation turn."""
    by_conversation = Window.partitionBy("conv_id").orderBy("turn")
    line = F.format_string("{'loss': %s, 'grad_norm': 1.5, 'learning_rate': 0.0001, 'entropy': 2.5, 'num_tokens': %s, 'mean_token_accuracy': 0.5, 'epoch': 0.1}", (F.length("text") / 8).cast("string"), F.sum(F.length("text").cast("double")).over(by_conversation).cast("string"))
    rows = turns_of(spark, sf_dir).select(F.col("conv_id").alias("run"), F.col("turn").alias("pos"), line.alias("value"))
    noise = rows.select("run", (F.col("pos") * 2 + 1).alias("pos"), F.lit(" 10%|##  | 1/9").alias("value"))
    return rows.select("run", (F.col("pos") * 2).alias("pos"), "value").unionAll(noise)


@query("""
SELECT conv_id AS run, CAST(10 * row_number() OVER w AS BIGINT) AS step, length(text) / 8.0::DOUBLE AS loss, CAST(sum(length(text)) OVER w AS DOUBLE) AS num_tokens,
  CAST(length(text) AS DOUBLE) AS new_tokens, CAST(sum(length(text)) OVER w AS DOUBLE) AS total_tokens FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def cumulative_tokens(spark, sf_dir):
    log = G.running_tokens(G.token_steps(G.parse_log(_log_lines(spark, sf_dir))))
    return log.select("run", "step", "loss", "num_tokens", "new_tokens", "total_tokens")


import turnloom.plans.cases  # noqa: E402, F401  registers those over every branch of the rules
import turnloom.plans.files  # noqa: E402, F401  registers the queries over generated files
import turnloom.plans.live  # noqa: E402, F401  those over streams
import turnloom.plans.vocab  # noqa: E402, F401  those over ids of a vocabulary
