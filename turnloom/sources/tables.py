"""Sources and sinks: conversations in JSON lines, Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.conversations import MESSAGES, problem_of_variant


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per non-empty line of JSON."""
    return spark.read.text(path).withColumnRenamed("value", "line").where(F.trim("line") != "")


def _message_type(value: str) -> str:
    call = f"name:string,arguments:{value}"
    return f"struct<messages:array<struct<role:string,content:{value},reasoning_content:{value},tool_calls:array<struct<{call},function:struct<{call}>>>>>>"


#: A JSON text up to its next comma or colon outside of strings.
_SEPARATED = r'((?:[^",:]|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)([,:])'


def spaced(json: Column) -> Column:
    """Compact JSON with a space after each comma and colon, as prompts show it."""
    return F.regexp_replace(json, _SEPARATED, "$1$2 ")


def messages_of(line: Column) -> Column:
    """Messages of a JSON line, in the type that the template takes.

    Content and reasoning count only where they are strings; others become
    null, which renders as the empty text. A tool call may be wrapped in
    `function`; arguments that are no string are kept as JSON text.
    """
    texts, typed = (F.from_json(line, _message_type(t))["messages"] for t in ("string", "variant"))
    is_text = lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))

    def call(t: Column, v: Column) -> Column:
        wrapped = t["function"]["name"].isNotNull()
        name = F.when(wrapped, t["function"]["name"]).otherwise(t["name"])
        given = F.when(wrapped, t["function"]["arguments"]).otherwise(t["arguments"])
        plain = F.when(wrapped, is_text(v["function"]["arguments"])).otherwise(is_text(v["arguments"]))
        return F.struct(name.alias("name"), F.coalesce(F.when(plain, given).otherwise(spaced(given)), F.lit("null")).alias("arguments"))

    def message(t: Column, v: Column) -> Column:
        return F.struct(
            t["role"].alias("role"),
            F.when(is_text(v["content"]), t["content"]).alias("content"),
            F.when(is_text(v["reasoning_content"]), t["reasoning_content"]).alias("reasoning_content"),
            F.zip_with(t["tool_calls"], v["tool_calls"], call).alias("tool_calls"),
        )

    return F.zip_with(texts, typed, message)


def parsed_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """The lines with `problem` (null where valid) and `messages` (the type template.RICH), from one parse of each.

    Only lines with tool calls are parsed again, for the text of arguments as it was written.
    """
    parsed = lines.withColumn("tl_parsed", F.try_parse_json(column))
    listed = parsed.withColumn("tl_listed", F.try_variant_get("tl_parsed", "$.messages", "array<variant>"))
    field = lambda m, name: F.try_variant_get(m, f"$.{name}", "variant")
    is_text = lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    text = lambda m, name: F.when(is_text(field(m, name)), F.try_variant_get(m, f"$.{name}", "string"))
    plain = F.transform(
        "tl_listed",
        lambda m: F.struct(
            F.try_variant_get(m, "$.role", "string").alias("role"),
            text(m, "content").alias("content"),
            text(m, "reasoning_content").alias("reasoning_content"),
            F.lit(None).cast("array<struct<name:string,arguments:string>>").alias("tool_calls"),
        ),
    )
    messages = F.when(F.contains(column, F.lit('"tool_calls"')), messages_of(F.col(column))).otherwise(plain)
    return listed.withColumns({"problem": problem_of_variant(F.col("tl_parsed"), F.col("tl_listed")), "messages": messages}).drop("tl_parsed", "tl_listed")


def read_conversations(spark: SparkSession, path: str, strict: bool = True, calls: bool = False) -> DataFrame:
    """Conversations from JSON lines with a list `messages`.

    strict: the job fails at an invalid line. calls: messages keep reasoning
    and tool calls (the type template.RICH), else role and content only.
    """
    rows = parsed_lines(read_lines(spark, path))
    messages = F.col("messages")
    if not calls:
        messages = F.transform(messages, lambda m: F.struct(m["role"], m["content"])).cast(MESSAGES)
    if strict:
        wrong = F.raise_error(F.concat(F.lit("invalid conversation: "), F.col("problem")))
        messages = F.when(F.col("problem").isNull(), messages).otherwise(wrong)
    return rows.select(messages.alias("messages"))


def write_conversations(conversations: DataFrame, path: str) -> None:
    conversations.select("messages").write.json(path, ignoreNullFields=False)


def write_features(features: DataFrame, path: str) -> None:
    features.write.parquet(path)
