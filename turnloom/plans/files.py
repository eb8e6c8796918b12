"""Registered queries that write files from the tables and read them back, and those over tool calls and reasoning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.config import DEFAULT_SYSTEM, DEFAULTS
from turnloom.functions import tokens as K
from turnloom.operators import conversations as C
from turnloom.operators import labels as L
from turnloom.operators import requests as R
from turnloom.operators import streams as S
from turnloom.operators import template as M
from turnloom.operators import training as G
from turnloom.plans.registry import QUERIES, digest, long, query, turns_of
from turnloom.sources import tables
from turnloom.sources.logs import read_log
from turnloom.sources.schema import read_json_lines
from turnloom.sources.settings import SettingsStore
from turnloom.sources.shared import scratch
from turnloom.sources.sink import FeatureSink

# ---------------------------------------------------------------- JSON lines


def _lines(turns, message):
    """One line of JSON per conversation, from an expression for each message's JSON."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("ms"))
    return rows.select(F.concat(F.lit('{"id": '), F.col("conv_id").cast("string"), F.lit(', "messages": ['), F.array_join(F.transform("ms", lambda x: x["m"]), ", "), F.lit("]}")).alias("value"))


def _json(**fields):
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


#: Turns whose content is a number or an object in the file; the template takes it as empty.
_ODD = "conv_id % 3 = 0 AND turn % 2 = 1"
_SEEN = f"SELECT conv_id, turn, role, CASE WHEN {_ODD} THEN '' ELSE text END AS text, NOT ({_ODD}) AS is_text FROM conversations"


@query(f"""
WITH t AS ({_SEEN}),
f AS (SELECT *, coalesce(max(CAST(role = 'user' AND is_text AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS asked,
  lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS is_last FROM t),
b AS (SELECT *, '<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' AND asked AND is_last THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || text || '<|im_end|>' || chr(10) AS block FROM f)
SELECT CAST(count(*) AS BIGINT) AS n_messages, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest, md5(string_agg(block, '' ORDER BY turn)) AS prompt
FROM b GROUP BY conv_id""")
def jsonl_scan(spark, sf_dir):
    odd = F.expr(_ODD)
    value = F.when(F.col("turn") % 4 == 1, F.lit("5")).otherwise(F.lit('{"a": [1]}'))
    message = F.when(odd, F.concat(F.lit('{"role": "'), F.col("role"), F.lit('", "content": '), value, F.lit("}"))).otherwise(_json(role=F.col("role"), content=F.col("text")))
    place = scratch(spark, "lines")
    _lines(turns_of(spark, sf_dir), message).write.text(place)
    read = tables.read_conversations(spark, place, calls=True)
    return read.select(long(F.size("messages"), "n_messages"), digest(F.col("messages")), F.md5(M.render(F.col("messages"))).alias("prompt"))


@query("""
WITH f AS (SELECT *, coalesce(max(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS asked,
  max(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS query_at FROM conversations),
b AS (SELECT *, '<|im_start|>' || role || chr(10) || CASE WHEN role <> 'assistant' THEN text
    ELSE CASE WHEN asked AND turn > query_at THEN '<think>' || chr(10) || 'I see: ' || turn || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || text || chr(10)
      || '<tool_call>' || chr(10) || '{"name": "f' || turn || '", "arguments": {"x": 1, "y": ["a,b:c", "d\\"e,f"], "z": {}}}' || chr(10) || '</tool_call>'
      || chr(10) || '<tool_call>' || chr(10) || '{"name": "g", "arguments": {"as":"given"}}' || chr(10) || '</tool_call>' END || '<|im_end|>' || chr(10) AS block FROM f)
SELECT CAST(sum(length(block)) AS BIGINT) AS n_chars, md5(string_agg(block, '' ORDER BY turn)) AS prompt FROM b GROUP BY conv_id""")
def render_calls(spark, sf_dir):
    calls = F.concat(
        F.lit(', "reasoning_content": "I see: '), F.col("turn").cast("string"), F.lit('", "tool_calls": [{"type": "function", "function": {"name": "f'), F.col("turn").cast("string"),
        F.lit('", "arguments": {"x":1,"y":["a,b:c", "d\\"e,f"],"z":{}}}}, {"name": "g", "arguments": "{\\"as\\":\\"given\\"}"}]}'),
    )
    plain = _json(role=F.col("role"), content=F.col("text"))
    message = F.when(F.col("role") == "assistant", F.concat(F.rtrim(plain, F.lit("}")), calls)).otherwise(plain)
    place = scratch(spark, "lines")
    _lines(turns_of(spark, sf_dir), message).write.text(place)
    prompt = M.render(F.col("messages"))
    return tables.read_conversations(spark, place, calls=True).select(long(F.length(prompt), "n_chars"), F.md5(prompt).alias("prompt"))


# ---------------------------------------------------------------- labels of reasoning and tool responses

#: Turns with reasoning, leading line feeds, wrapped responses and tool turns, by conversation.
_THOUGHTFUL = """
SELECT conv_id, turn, CASE WHEN conv_id % 5 = 3 AND turn % 3 <> 0 THEN 'tool' WHEN conv_id % 5 = 4 AND turn % 4 = 3 THEN 'critic' ELSE role END AS role,
  CASE WHEN role = 'assistant' AND conv_id % 2 = 0 AND turn % 4 <> 3 THEN concat('<think>', chr(10), 'I see ', turn, chr(10), '</think>', chr(10), chr(10), text)
    WHEN role = 'assistant' AND conv_id % 2 = 1 THEN concat(repeat(chr(10), 25), text)
    WHEN role = 'user' AND conv_id % 5 = 2 AND turn > 3 THEN concat('<tool_response>', text, '</tool_response>') ELSE text END AS text
FROM conversations"""

_PARTS = f"""
WITH t AS ({_THOUGHTFUL}),
p AS (SELECT *, role = 'user' AND NOT (starts_with(text, '<tool_response>') AND ends_with(text, '</tool_response>')) AS question,
  CASE WHEN role = 'assistant' AND contains(text, '</think>') THEN trim(regexp_extract(text, '<think>([^<]*)</think>', 1), chr(10)) ELSE '' END AS reasoning,
  CASE WHEN role = 'assistant' AND contains(text, '</think>') THEN ltrim(regexp_extract(text, '(?s)</think>(.*)', 1), chr(10)) ELSE text END AS said,
  lag(role) OVER w AS before, lead(role) OVER w AS after FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT a.conv_id, a.turn AS k, b.*, max(CASE WHEN b.question THEN b.turn END) OVER (PARTITION BY a.conv_id, a.turn) AS query_at, b.turn = a.turn AS is_last
  FROM p a JOIN (SELECT conv_id AS c, * EXCLUDE conv_id FROM p) b ON b.c = a.conv_id AND b.turn <= a.turn),
x AS (SELECT *, CASE WHEN role = 'tool' THEN CASE WHEN before = 'tool' THEN '' ELSE '<|im_start|>user' END || chr(10) || '<tool_response>' || chr(10) || said || chr(10) || '</tool_response>'
    || CASE WHEN is_last OR after <> 'tool' THEN '<|im_end|>' || chr(10) ELSE '' END
  WHEN role = 'critic' THEN ''
  WHEN role = 'assistant' AND turn > query_at AND (is_last OR reasoning <> '') THEN '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || reasoning || chr(10) || '</think>' || chr(10) || chr(10) || ltrim(said, chr(10)) || '<|im_end|>' || chr(10)
  ELSE '<|im_start|>' || role || chr(10) || said || '<|im_end|>' || chr(10) END AS block FROM k),
r AS (SELECT conv_id, k AS turn, string_agg(block, '' ORDER BY x.turn) AS prefix FROM x GROUP BY conv_id, k)"""
#: By rendering each prefix and cutting off as many characters as the one before has.
_BY_PREFIX = f"""{_PARTS}
SELECT r.conv_id, r.turn, CAST(length(delta) AS BIGINT) AS n_tokens, t.role = 'assistant' AS supervised, md5(delta) AS digest
FROM (SELECT conv_id, turn, substr(prefix, 1 + coalesce(length(lag(prefix) OVER (PARTITION BY conv_id ORDER BY turn)), 0)) AS delta FROM r) r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn"""
_IN_FINAL = f"""{_PARTS}
SELECT conv_id, turn, CAST(length(block) AS BIGINT) AS n_tokens, role = 'assistant' AS supervised, md5(block) AS digest
FROM x WHERE k = (SELECT max(turn) FROM t WHERE t.conv_id = x.conv_id)"""


def thoughtful(spark, sf_dir):
    c, t, role, text = (F.col(n) for n in ("conv_id", "turn", "role", "text"))
    new_role = F.when((c % 5 == 3) & (t % 3 != 0), "tool").when((c % 5 == 4) & (t % 4 == 3), "critic").otherwise(role)
    thought = F.concat(F.lit("<think>\nI see "), t.cast("string"), F.lit("\n</think>\n\n"), text)
    new_text = (
        F.when((role == "assistant") & (c % 2 == 0) & (t % 4 != 3), thought)
        .when((role == "assistant") & (c % 2 == 1), F.concat(F.lit(25 * "\n"), text))
        .when((role == "user") & (c % 5 == 2) & (t > 3), F.concat(F.lit("<tool_response>"), text, F.lit("</tool_response>")))
        .otherwise(text)
    )
    return turns_of(spark, sf_dir).select("conv_id", "turn", new_role.alias("role"), new_text.alias("text"))


def _delta_rows(rows):
    return rows.select("conv_id", long(F.col("turn"), "turn"), long(F.length("delta"), "n_tokens"), "supervised", F.md5("delta").alias("digest"))


@query(_BY_PREFIX)
def thinking_labels_reference(spark, sf_dir):
    return _delta_rows(L.flat_deltas(thoughtful(spark, sf_dir)))


@query(_IN_FINAL)
def thinking_labels_aligned(spark, sf_dir):
    return _delta_rows(L.flat_deltas(thoughtful(spark, sf_dir), mode="aligned"))


@query(_BY_PREFIX)
def thinking_labels_by_prefix(spark, sf_dir):
    rows = C.nest(thoughtful(spark, sf_dir)).select("conv_id", "messages", F.posexplode(L.nested_deltas(M.rich(F.col("messages")))).alias("turn", "delta"))
    return _delta_rows(rows.withColumn("supervised", F.get("messages", F.col("turn"))["role"] == "assistant"))


# ---------------------------------------------------------------- tokens


def _byte_pairs():
    import public_tokenizers

    return K.tokenizer_file(public_tokenizers.path("byte_bpe_50k.json"))


@query("SELECT conv_id, turn, md5(text) AS digest, TRUE AS shorter FROM conversations")
def token_round_trip(spark, sf_dir):
    """Ids of a byte-level vocabulary and back: no more ids than bytes, and the same text."""
    encoder, decoder = _byte_pairs()
    ids = turns_of(spark, sf_dir).select("conv_id", "turn", "text", K.plug_in_tokenizer(encoder)("text").alias("ids"))
    return ids.select("conv_id", "turn", F.md5(K.plug_in_decoder(decoder)("ids")).alias("digest"), (F.size("ids") <= F.octet_length("text")).alias("shorter"))


@query("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 151645 ELSE CAST(conv_id AS INT) END AS pad FROM (SELECT DISTINCT conv_id FROM conversations)")
def pad_fallback(spark, sf_dir):
    own = F.when(F.col("conv_id") % 3 != 0, F.col("conv_id").cast("int"))
    return turns_of(spark, sf_dir).select("conv_id").distinct().select("conv_id", K.pad_token(own, F.lit(DEFAULTS.end_id)).alias("pad"))


@query("""
SELECT reply_id, CAST(len(p) + 2 AS BIGINT) AS n_events, md5(array_to_string(p, '')) AS content
FROM (SELECT concat_ws('-', conv_id, turn) AS reply_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS p FROM conversations WHERE role = 'assistant')""")
def sse_pieces(spark, sf_dir):
    """Replies streamed by piece, empty pieces left out, and put together again."""
    said = turns_of(spark, sf_dir).where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("reply_id"), "text")
    pieces = said.select("reply_id", F.posexplode(F.split("text", " ")).alias("seq", "piece"))
    events = S.encode(said.select("reply_id"), pieces, "reply_id", F.lit("m"), F.lit(1700000000), F.col("reply_id"))
    reads = events.select("reply_id", (F.col("part") * 1_000_000_000 + F.col("seq")).alias("seq"), F.col("event").alias("data"))
    counts = reads.groupBy("reply_id").agg(long(F.count("*"), "n_events"))
    return S.decode(reads, "reply_id").join(counts, "reply_id").select("reply_id", "n_events", F.md5("content").alias("content"))


# ---------------------------------------------------------------- settings and logs


@query(f"""
SELECT conv_id, CASE WHEN conv_id % 3 = 2 THEN 'u' || conv_id ELSE 'http://127.0.0.1:8000/v1' END AS api_url, CASE conv_id % 3 WHEN 0 THEN 0.7 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS temperature,
  CASE conv_id % 3 WHEN 0 THEN 0.7 WHEN 1 THEN 0.0 ELSE 0.9 END::DOUBLE AS top_p, conv_id % 3 <> 1 AS stream_mode,
  CAST(CASE WHEN conv_id % 3 = 2 AND conv_id % 7 <> 0 THEN conv_id % 7 ELSE 20 END AS BIGINT) AS history_length, CAST(CASE WHEN conv_id % 3 = 2 THEN 5 ELSE 4096 END AS BIGINT) AS max_tokens,
  CASE WHEN conv_id % 3 = 2 THEN 'p' ELSE '{DEFAULT_SYSTEM}' END AS system_prompt
FROM (SELECT DISTINCT conv_id FROM conversations)""")
def settings_store(spark, sf_dir):
    """Settings that lack fields, hold empty ones or are whole: set key by key, removed, set again, compacted, and read with their defaults."""
    by = lambda empty, own: F.when(F.col("conv_id") % 3 == 1, empty).when(F.col("conv_id") % 3 == 2, own)
    number = F.col("conv_id").cast("string")
    saved = turns_of(spark, sf_dir).select("conv_id").distinct().select(
        "conv_id", by("", F.concat(F.lit("u"), number)).alias("api_url"), by(0.0, 0.5).alias("temperature"), by(0.0, 0.9).alias("top_p"), by(False, True).alias("stream_mode"),
        by("0", F.concat((F.col("conv_id") % 7).cast("string"), F.lit("px"))).alias("history_length"), by("x", " 5").alias("max_tokens"), by("", "p").alias("system_prompt"),
    )
    store = SettingsStore(spark, scratch(spark, "settings"), "conv_id")
    store.set(saved.withColumn("api_url", F.lit("older")))
    store.remove(saved.where("conv_id % 2 = 0"))
    store.set(saved.where("conv_id % 4 <> 1"))
    store.compact()
    store.set(saved.where("conv_id % 4 = 1"))
    return R.load_settings(store.get())


_LOG_TOTALS = "SELECT CAST(conv_id % 16 AS VARCHAR) AS run, row_number() OVER w AS nth, length(text) AS n, sum(length(text)) OVER w AS total FROM conversations WINDOW w AS (PARTITION BY conv_id % 16 ORDER BY conv_id, turn)"


@query(f"SELECT run, CAST(10 * nth AS BIGINT) AS step, n / 8.0::DOUBLE AS loss, CAST(n AS DOUBLE) AS new_tokens, CAST(total AS DOUBLE) AS total_tokens FROM ({_LOG_TOTALS})")
def log_file(spark, sf_dir):
    """A log file of each of 16 runs, with a row per turn between progress bars, read by byte ranges and summed up."""
    run = (F.col("conv_id") % 16).alias("run")
    totals = tables.read_table(spark, sf_dir, "conversations").select(run, "conv_id", "turn", F.length("text").cast("double").alias("n"))
    totals = totals.withColumn("total", F.sum("n").over(Window.partitionBy("run").orderBy("conv_id", "turn")))
    place = scratch(spark, "log")
    row = F.concat(F.lit("\r 10%|##  | 1/9\n{'loss': "), (F.col("n") / 8).cast("string"), F.lit(", 'num_tokens': "), F.col("total").cast("string"), F.lit("}"))
    totals.repartition("run").sortWithinPartitions("run", "conv_id", "turn").select("run", row.alias("value")).write.partitionBy("run").text(place)
    lines = read_log(spark, place).withColumn("run", F.col("run").cast("string"))
    log = G.running_tokens(G.token_steps(G.parse_log(lines)))
    return log.select("run", "step", "loss", "new_tokens", "total_tokens")


@query("""
SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE conv_id % 3 WHEN 0 THEN CAST(turn AS VARCHAR) WHEN 1 THEN 't' || turn END AS mixed,
  CASE WHEN turn % 2 = 0 THEN CAST(turn AS DOUBLE) ELSE turn + 0.5 END::DOUBLE AS score, CASE WHEN conv_id > 50 THEN 'tag' || conv_id END AS late, CASE WHEN conv_id > 50 THEN CAST(turn AS BIGINT) END AS late_n
FROM conversations""")
def inferred_schema(spark, sf_dir):
    """Lines of JSON whose keys come late and whose types differ from line to line, read by the schema of all lines."""
    turn = F.col("turn").cast("string")
    mixed = F.when(F.col("conv_id") % 3 == 0, turn).when(F.col("conv_id") % 3 == 1, F.concat(F.lit('"t'), turn, F.lit('"'))).otherwise("null")
    score = F.when(F.col("turn") % 2 == 0, turn).otherwise(F.concat(turn, F.lit(".5")))
    late = F.when(F.col("conv_id") > 50, F.concat(F.lit(', "late": {"tag": "tag'), F.col("conv_id").cast("string"), F.lit('", "n": '), turn, F.lit("}"))).otherwise("")
    line = F.concat(F.lit('{"turn": '), turn, F.lit(', "id": '), F.col("conv_id").cast("string"), F.lit(', "mixed": '), mixed, F.lit(', "score": '), score, late, F.lit("}"))
    place = scratch(spark, "json")
    turns_of(spark, sf_dir).select(line.alias("value")).write.text(place)
    rows = read_json_lines(spark, place)
    return rows.select(F.col("id").alias("conv_id"), "turn", "mixed", "score", F.col("late.tag").alias("late"), F.col("late.n").alias("late_n"))


@query("""
SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(count(*) AS BIGINT) AS n_turns FROM conversations GROUP BY conv_id""")
def feature_sink(spark, sf_dir):
    """Features of many files, of a run that was stopped and gone on with."""
    place = scratch(spark, "inputs")
    turns_of(spark, sf_dir).repartition(8, "conv_id").write.option("maxRecordsPerFile", 500).parquet(place)
    inputs = [r["f"] for r in spark.read.parquet(place).select(F.input_file_name().alias("f")).distinct().collect()]
    build = lambda some: spark.read.parquet(*some).groupBy("conv_id").agg(F.sum(F.length("text")).alias("c"), F.count("*").alias("t"))
    sink = FeatureSink(spark, scratch(spark, "sink"))
    sink.run(inputs[: len(inputs) // 2], build, group=2)
    sink.run(inputs, build, group=3)
    return sink.features().groupBy("conv_id").agg(long(F.sum("c"), "n_chars"), long(F.sum("t"), "n_turns"))


@query("SELECT concat_ws('-', conv_id, turn) AS reply_id, md5(text) AS content FROM conversations WHERE role = 'assistant'")
def sse_decode_bytes(spark, sf_dir):
    """Replies read as bytes that are cut every 61 of them, inside of characters too."""
    said = turns_of(spark, sf_dir).where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("reply_id"), "text")
    event = S.chunk(F.col("piece"), F.lit("m"), F.col("reply_id"), F.lit(1700000000), F.lit(None))
    pieces = said.select("reply_id", F.posexplode(F.split("text", " ")).alias("at", "word")).withColumn("piece", F.concat(F.when(F.col("at") > 0, " ").otherwise(""), "word"))
    sent = pieces.groupBy("reply_id").agg(F.array_sort(F.collect_list(F.struct("at", event.alias("e")))).alias("es"))
    whole = sent.select("reply_id", F.encode(F.array_join(F.transform("es", lambda x: x["e"]), ""), "UTF-8").alias("b"))
    cuts = F.sequence(F.lit(0), F.greatest(F.octet_length("b") - 1, F.lit(0)), F.lit(61))
    reads = whole.select("reply_id", "b", F.explode(cuts).alias("seq")).select("reply_id", "seq", F.substring("b", F.col("seq") + 1, F.lit(61)).alias("data"))
    return S.decode_bytes(reads, "reply_id", mode="buffered").select("reply_id", F.md5("content").alias("content"))


_SETTINGS = ("max_seq_len", "stream", "peak_rate", "model_name")


@query("SELECT CAST(n AS BIGINT) AS max_seq_len, TRUE AS stream, 0.5::DOUBLE AS peak_rate, 'chat-model' AS model_name FROM (SELECT count(*) AS n FROM conversations)")
def settings_from_environment(spark, sf_dir):
    """Typed settings from variables, of which one holds the number of turns."""
    from turnloom.config import Settings

    found = Settings.from_env({"MAX_SEQ_LEN": str(turns_of(spark, sf_dir).count()), "STREAM": "TRUE", "PEAK_RATE": "0.5"})
    return spark.createDataFrame([tuple(getattr(found, n) for n in _SETTINGS)], "max_seq_len long, stream boolean, peak_rate double, model_name string")

