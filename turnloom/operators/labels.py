"""Training features with labels for responses only.

A turn's tokens are what the rendering of the conversation up to it has beyond
the length of the rendering up to the turn before. As an answer's reasoning
block is rendered only while the answer is last, a turn after an answer loses
as many leading tokens as that block had. `reference` keeps this; `aligned`
takes each turn's place in the one final rendering.

Flat functions work on turns with window functions, one shuffle and one sort by
conversation for texts of any kind: reasoning tags, tool responses, unknown
roles. Nested ones render each prefix; they also take given reasoning and tool
calls, which turns of plain text do not have.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.config import DEFAULTS
from turnloom.functions.text import answer_of, lstrip_newlines, reasoning_of, rstrip_newlines
from turnloom.functions.tokens import code_points
from turnloom.functions.vocabulary import Vocabulary, guarded
from turnloom.operators.template import END, START, THINK_CLOSE, THINK_OPEN, render

ANSWER = "assistant"


def _blocks(turns: DataFrame, key: str, order: str, role: str, text: str, aligned: bool, guard=lambda c: c) -> DataFrame:
    """The turns with what they are, and their blocks: as the last turn, and as an earlier one.

    guard is applied to what was said and thought, not to what the template adds.
    """
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    has = lambda *names: F.coalesce(F.col(role).isin(*names), F.lit(False))
    content = F.coalesce(text, F.lit(""))
    wrapped = F.startswith(content, F.lit("<tool_response>")) & F.endswith(content, F.lit("</tool_response>"))
    question = has("user") & F.col(text).isNotNull() & ~wrapped
    answer, tool = has(ANSWER), has("tool")
    reasoning = F.when(answer, reasoning_of(content)).otherwise("")
    said = F.when(answer, answer_of(content)).otherwise(content)
    asked = F.max(question).over(upto)
    after_tool = F.coalesce(F.lag(tool).over(w), F.lit(False))
    facts = turns.withColumns({"tl_question": question, "tl_tool": tool, "tl_thinks": answer & asked, "tl_reasoning": guard(reasoning), "tl_said": guard(said), "tl_follows": after_tool})
    if aligned:
        later = w.rowsBetween(1, Window.unboundedFollowing)
        facts = facts.withColumns({"tl_asked_later": F.coalesce(F.max(question).over(later), F.lit(False)), "tl_last": F.lead(F.lit(1)).over(w).isNull(), "tl_tool_next": F.coalesce(F.lead(tool).over(w), F.lit(False))})
    around = lambda body: F.concat(F.lit(START), F.col(role), F.lit("\n"), body, F.lit(END))
    response = F.concat(F.when(F.col("tl_follows"), "").otherwise(f"{START}user"), F.lit("\n<tool_response>\n"), F.col("tl_said"), F.lit("\n</tool_response>"))
    plain = F.when(has("user", ANSWER, "system"), around(F.col("tl_said"))).when(F.col("tl_tool"), F.concat(response, F.lit(END))).otherwise("")
    thinking = around(F.concat(F.lit(THINK_OPEN), lstrip_newlines(rstrip_newlines(F.col("tl_reasoning"))), F.lit(THINK_CLOSE), lstrip_newlines(F.col("tl_said"))))
    if aligned:
        thinks = F.col("tl_thinks") & ~F.col("tl_asked_later") & (F.col("tl_last") | (F.col("tl_reasoning") != ""))
        return facts.withColumn("delta", F.when(thinks, thinking).when(F.col("tl_tool") & F.col("tl_tool_next"), response).otherwise(plain))
    return facts.withColumns({"tl_plain": plain, "tl_block": F.when(F.col("tl_thinks"), thinking).otherwise(plain)})


def _cut_blocks(shown: DataFrame, key: str, order: str, size, drop, end, end_size: int) -> Column:
    """Each turn's delta from its blocks; size, drop (the first n) and end (the last n) work on texts or on ids.

    What a turn changes before itself follows from sums over the turns: the turn
    before loses its place as the last one (an answer without reasoning its
    empty block, a tool response the end mark if another follows), and a
    question takes the reasoning from all answers since the question before.
    """
    w = Window.partitionBy(key).orderBy(order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    gained = size("tl_block") - size("tl_plain")
    keeps = F.col("tl_reasoning") != ""
    shown = shown.withColumns({"tl_empty": F.when(keeps, 0).otherwise(gained), "tl_kept": F.sum(F.when(keeps, gained).otherwise(0)).over(upto)})
    taken = F.coalesce(F.lag("tl_kept").over(w), F.lit(0)) - F.coalesce(F.last(F.when(F.col("tl_question"), F.col("tl_kept")), ignorenulls=True).over(before), F.lit(0))
    lost = F.coalesce(F.lag("tl_empty").over(w), F.lit(0)) + F.when(F.col("tl_tool") & F.col("tl_follows"), end_size).otherwise(0) + F.when(F.col("tl_question"), taken).otherwise(0)
    # an answer that begins with many newlines gains by losing its empty block: its end is told again
    again = F.lag(F.when(F.col("tl_empty") < 0, F.col("tl_plain"))).over(w)
    shown = shown.withColumns({"tl_lost": lost.cast("int"), "tl_again": again})
    told = F.concat(end("tl_again", -F.col("tl_lost")), F.col("tl_block"))
    return shown.withColumn("delta", F.when(F.col("tl_lost") >= 0, drop("tl_block", F.col("tl_lost"))).otherwise(told))


def flat_deltas(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", mode: str = "reference") -> DataFrame:
    """The turns with `delta` (text) and `supervised`."""
    shown = _blocks(turns, key, order, role, text, mode == "aligned")
    if mode != "aligned":
        last = F.lit(2**31 - 1)
        shown = _cut_blocks(shown, key, order, F.length, lambda c, n: F.substring(c, n + 1, last), lambda c, n: F.substring(c, -n, n), len(END))
    return shown.withColumn("supervised", F.coalesce(F.col(role) == ANSWER, F.lit(False))).drop(*_FACTS)


def token_deltas(turns: DataFrame, vocabulary: Vocabulary, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", mode: str = "reference", guard: bool = True) -> DataFrame:
    """The turns with `ids`, what each adds to the ids of the conversation, and `supervised`.

    `reference`: the ids of the rendering up to the turn without as many as the
    rendering before it has; counted in ids, from the sums that flat_deltas takes
    in characters. `aligned`: the turn's own ids in the final rendering. guard:
    control strings inside texts are ordinary text; else they count as control
    tokens, as a tokenizer that is given the whole prompt takes them.

    Blocks meet at control tokens, so their ids are those of the whole prompt;
    the vocabulary must have the template's control strings among its controls.
    """
    missing = {START, END.rstrip("\n"), "<tool_response>", "</tool_response>"} - {c for c, _ in vocabulary.controls}
    if missing:
        raise ValueError(f"the vocabulary has no control tokens {sorted(missing)}")
    shown = _blocks(turns, key, order, role, text, mode == "aligned", guarded if guard else lambda c: c)
    encode = vocabulary.ids()
    if mode == "aligned":
        shown = shown.withColumn("ids", encode("delta")).drop("delta")
    else:
        none = F.array().cast("array<int>")
        shown = shown.withColumns({"tl_plain": encode("tl_plain"), "tl_other": encode(F.when(F.col("tl_thinks"), F.col("tl_block")))})
        shown = shown.withColumn("tl_block", F.coalesce("tl_other", "tl_plain"))
        rest = lambda c, n: F.when(n < F.size(c), F.slice(c, n + 1, F.size(c))).otherwise(none)
        shown = _cut_blocks(shown, key, order, F.size, rest, lambda c, n: F.slice(c, -n, n), len(vocabulary.encode([END])[0]))
        shown = shown.withColumnRenamed("delta", "ids")
    return shown.withColumn("supervised", F.coalesce(F.col(role) == ANSWER, F.lit(False))).drop(*_FACTS)


_FACTS = tuple(f"tl_{n}" for n in ("question", "tool", "thinks", "reasoning", "said", "follows", "asked_later", "last", "tool_next", "plain", "block", "empty", "kept", "lost", "again", "other"))


def nested_deltas(messages: Column) -> Column:
    """Array of deltas of rich messages, by rendering each prefix."""
    upto = lambda k: render(F.slice(messages, F.lit(1), k))
    one = lambda k: F.when(k == 1, upto(k)).otherwise(F.substring(upto(k), F.length(upto(F.greatest(k - 1, F.lit(1)))) + 1, F.lit(2**31 - 1)))
    return F.when(F.size(messages) > 0, F.transform(F.sequence(F.lit(1), F.size(messages)), one)).otherwise(F.array().cast("array<string>"))


def label_report(deltas: DataFrame, max_length: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Per conversation: tokens kept, supervised and masked ones among them, and whether it was cut."""
    size = F.length("delta").cast("long")
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sized = deltas.select(key, order, "supervised", size.alias("size")).withColumn("until", F.sum("size").over(w))
    kept = F.greatest(F.lit(0), F.least(F.col("size"), max_length - F.col("until") + F.col("size")))
    return sized.withColumn("kept", kept).groupBy(key).agg(
        F.sum("kept").alias("n_tokens"),
        F.sum(F.when(F.col("supervised"), F.col("kept")).otherwise(0)).alias("n_supervised"),
        F.sum(F.when(F.col("supervised"), 0).otherwise(F.col("kept"))).alias("n_masked"),
        F.sum("size").alias("n_before"),
        (F.sum("size") > max_length).alias("truncated"),
    )


def features(deltas: DataFrame, max_length: int, tokenize=None, key: str = "conv_id", order: str = "turn", ignore: int = DEFAULTS.ignore_label) -> DataFrame:
    """Per conversation the arrays input_ids, attention_mask and labels, cut on the right.

    Without a tokenizer the ids are code points, and what is cut is never taken apart.
    """
    text = F.col("delta")
    if tokenize is None:
        until = F.sum(F.length("delta")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        deltas = deltas.withColumn("room", F.greatest(F.lit(0), F.lit(max_length) - until + F.length("delta")).cast("int"))
        tokenize, text = code_points, F.substring("delta", F.lit(1), F.col("room"))
    return token_features(deltas.select(key, order, "supervised", tokenize(text).alias("ids")), max_length, key, order, ignore)


def token_features(ids: DataFrame, max_length: int, key: str = "conv_id", order: str = "turn", ignore: int = DEFAULTS.ignore_label) -> DataFrame:
    """features() of turns that have their ids already (token_deltas)."""
    rows = ids.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "ids", "supervised"))).alias("turns"))
    input_ids = F.flatten(F.transform("turns", lambda t: t["ids"]))
    labels = F.flatten(F.transform("turns", lambda t: F.when(t["supervised"], t["ids"]).otherwise(F.array_repeat(F.lit(ignore), F.size(t["ids"])))))
    cut = rows.select(key, F.slice(input_ids, 1, max_length).alias("input_ids"), F.slice(labels, 1, max_length).alias("labels"))
    return cut.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


#: Ranges that numbered() cuts keys into at most, and keys that one range should hold at least.
RANGES, RANGE_KEYS = 1024, 4096


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds `rank` from 0 in order of a whole-number key that is unique.

    Keys are cut into ranges of about equal counts at approximate percentiles,
    whatever their distance. Ranks inside a range are local, so a task sorts a
    range, and only the counts of at most RANGES ranges are ordered globally.
    One aggregation over the keys runs when this is called.
    """
    # count and percentiles of one pass; of many percentiles only as many are used as the count asks for
    shares = F.expr(f"array({', '.join(f'{i / RANGES!r}D' for i in range(1, RANGES))})")
    found = df.agg(F.count(key).alias("n"), F.percentile_approx(key, shares, 10 * RANGES).alias("b")).first()
    parts = max(1, min(RANGES, -(-found["n"] // RANGE_KEYS)))
    bounds = sorted({found["b"][i * RANGES // parts - 1] for i in range(1, parts)}) if parts > 1 else []
    width = math.isqrt(parts) + 1
    # bounds in blocks, so that a key is compared with the blocks' firsts and then inside one block
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    whole = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    of_range = F.lit(0)
    if blocks:
        at = F.size(F.filter(whole([b[0] for b in blocks]), lambda b: b <= F.col(key)))
        inside = F.size(F.filter(F.get(F.array(*map(whole, blocks)), at - 1), lambda b: b <= F.col(key)))
        of_range = F.when(at == 0, 0).otherwise((at - 1) * width + inside)
    ranged = df.withColumn("tl_range", of_range)
    counts = ranged.groupBy("tl_range").agg(F.count("*").alias("tl_n"))
    starts = counts.select("tl_range", (F.sum("tl_n").over(Window.orderBy("tl_range")) - F.col("tl_n")).alias("tl_first"))
    placed = ranged.join(F.broadcast(starts), "tl_range")  # at most RANGES rows
    return placed.withColumn("rank", F.col("tl_first") + F.row_number().over(Window.partitionBy("tl_range").orderBy(key)) - 1).drop("tl_range", "tl_first")


def pad_batches(rows: DataFrame, key: str = "conv_id", batch_size: int = DEFAULTS.batch_size, pad_id: int = DEFAULTS.pad_id, ignore: int = DEFAULTS.ignore_label) -> DataFrame:
    """Batches in order of key, padded on the right to the longest of the batch; long integers."""
    batched = numbered(rows, key).withColumn("batch_id", F.floor(F.col("rank") / batch_size)).drop("rank")
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch_id"))
    padded = batched.withColumn("padded", longest)
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("padded") - F.size(c))).cast("array<bigint>").alias(c)
    return padded.select("batch_id", key, fill("input_ids", pad_id), fill("attention_mask", 0), fill("labels", ignore))
