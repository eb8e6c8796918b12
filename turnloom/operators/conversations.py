"""Operators on whole conversations: nested messages, validation, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"


def nest(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """One row per conversation with its messages in order."""
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return turns.groupBy(key).agg(F.transform(sorted_, lambda m: F.struct(m["role"], m["content"])).alias("messages"))


def flatten(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per message, numbered from 0."""
    return conversations.select(key, F.posexplode("messages").alias("turn", "m")).select(key, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def message(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), (content if isinstance(content, Column) else F.lit(content)).alias("content"))


def ensure_system(messages: Column, default: str) -> Column:
    """With a system message in front where the first message is none."""
    missing = (F.size(messages) == 0) | ~F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    return F.when(missing, F.concat(F.array(message("system", default)), messages)).otherwise(messages)


def history_window(messages: Column, length: int) -> Column:
    """The first message and the last `length` others."""
    rest = F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))
    last = F.slice(rest, F.greatest(F.size(rest) - length + 1, F.lit(1)), F.lit(length))
    return F.when(F.size(rest) > length, F.concat(F.slice(messages, 1, 1), last)).otherwise(messages)


def append_message(messages: Column, role: str, content) -> Column:
    return F.concat(messages, F.array(message(role, content)))


def replace_system(messages: Column, prompt: Column) -> Column:
    """The first message overwritten by the trimmed prompt; unchanged if that is empty."""
    from turnloom.functions.text import strip

    new = strip(prompt)
    rest = F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))
    return F.when(F.coalesce(new, F.lit("")) == "", messages).otherwise(F.concat(F.array(message("system", new)), rest))


def clear_history(messages: Column) -> Column:
    return F.slice(messages, 1, 1)


def history_count(messages: Column) -> Column:
    return F.size(F.filter(messages, lambda m: m["role"] != "system"))


def prefixes(messages: Column) -> Column:
    """All non-empty prefixes, shortest first."""
    grown = F.transform(F.sequence(F.lit(1), F.size(messages)), lambda k: F.slice(messages, F.lit(1), k))
    return F.when(F.size(messages) > 0, grown).otherwise(F.array().cast(f"array<{MESSAGES}>"))


#: Why a line of JSON is no training conversation.
PROBLEMS = ("not json", "no list of messages", "message without role or content")


def problem_of(line: Column) -> Column:
    """Null for a valid conversation line, else one of PROBLEMS.

    A conversation is an object whose `messages` is a non-empty list of objects
    that all have the keys `role` and `content`, whatever their values.
    """
    parsed = F.try_parse_json(line)
    return problem_of_variant(parsed, F.try_variant_get(parsed, "$.messages", "array<variant>"))


def problem_of_variant(parsed: Column, listed: Column) -> Column:
    """problem_of() of a line that has been parsed, and of its list of messages."""
    keys = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    has = lambda v: F.coalesce(F.map_contains_key(keys(v), "role") & F.map_contains_key(keys(v), "content"), F.lit(False))
    return (
        F.when(parsed.isNull(), PROBLEMS[0])
        .when(F.coalesce(F.size(listed), F.lit(0)) <= 0, PROBLEMS[1])
        .when(~F.forall(listed, has), PROBLEMS[2])
    )


def require_valid(lines: DataFrame, column: str = "line") -> DataFrame:
    """The lines; a query over them fails at the first bad one."""
    bad = problem_of(F.col(column))
    return lines.withColumn(column, F.when(bad.isNull(), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("invalid conversation: "), bad))))


def quarantine(lines: DataFrame, column: str = "line") -> DataFrame:
    """The lines with a column `problem`, null where they are valid."""
    return lines.withColumn("problem", problem_of(F.col(column)))
