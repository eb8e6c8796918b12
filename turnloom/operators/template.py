"""The chat template as column expressions: messages to prompt text.

Messages are structs of role and content, and optionally reasoning_content and
tool_calls (an array of name and arguments, the latter JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.text import answer_of, lstrip_newlines, reasoning_of, rstrip_newlines

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
THINK_OPEN, THINK_CLOSE = "<think>\n", "\n</think>\n\n"
NO_THINKING = "<think>\n\n</think>\n\n"
TOOLS_HEAD = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_TAIL = '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'

RICH = "array<struct<role:string,content:string,reasoning_content:string,tool_calls:array<struct<name:string,arguments:string>>>>"


def rich(messages: Column) -> Column:
    """Plain messages with the optional fields as nulls."""
    return F.transform(
        messages,
        lambda m: F.struct(
            m["role"].alias("role"), m["content"].alias("content"), F.lit(None).cast("string").alias("reasoning_content"), F.lit(None).cast("array<struct<name:string,arguments:string>>").alias("tool_calls")
        ),
    )


def _content(m: Column) -> Column:
    return F.coalesce(m["content"], F.lit(""))


def last_query_index(messages: Column) -> Column:
    """Of the last user message that is no wrapped tool response; the last index without one."""
    is_query = lambda m: (m["role"] == "user") & m["content"].isNotNull() & ~(F.startswith(m["content"], F.lit("<tool_response>")) & F.endswith(m["content"], F.lit("</tool_response>")))
    return F.coalesce(F.array_max(F.transform(messages, lambda m, i: F.when(is_query(m), i))), F.size(messages) - 1)


def _tool_calls(m: Column, content: Column) -> Column:
    one = lambda c, i: F.concat(
        F.when((i > 0) | (content != ""), "\n").otherwise(""), F.lit('<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"], F.lit("}\n</tool_call>")
    )
    return F.coalesce(F.array_join(F.transform(m["tool_calls"], one), ""), F.lit(""))


def _assistant(m: Column, i: Column, n: Column, last_query: Column) -> Column:
    given = m["reasoning_content"].isNotNull()
    reasoning = F.when(given, m["reasoning_content"]).otherwise(reasoning_of(_content(m)))
    content = F.when(given, _content(m)).otherwise(answer_of(_content(m)))
    thinks = (i > last_query) & ((i == n - 1) | (reasoning != ""))
    body = F.when(thinks, F.concat(F.lit(THINK_OPEN), lstrip_newlines(rstrip_newlines(reasoning)), F.lit(THINK_CLOSE), lstrip_newlines(content))).otherwise(content)
    return F.concat(F.lit(f"{START}assistant\n"), body, _tool_calls(m, content), F.lit(END))


def _tool(m: Column, i: Column, messages: Column) -> Column:
    differs = lambda j: ~F.coalesce(F.get(messages, j)["role"] == "tool", F.lit(False))
    return F.concat(
        F.when((i == 0) | differs(i - 1), f"{START}user").otherwise(""), F.lit("\n<tool_response>\n"), _content(m), F.lit("\n</tool_response>"), F.when(differs(i + 1), END).otherwise("")
    )


def render(messages: Column, tools: Column | None = None, generation_prompt: bool = False, enable_thinking: bool = True) -> Column:
    """Prompt text of rich messages; tools: array of JSON texts."""
    n, last_query = F.size(messages), last_query_index(messages)
    leading = (n > 0) & F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    first = _content(F.get(messages, F.lit(0)))
    head = F.when(leading, F.concat(F.lit(f"{START}system\n"), first, F.lit(END))).otherwise("")
    if tools is not None:
        listed = F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n"), t)), "")
        told = F.concat(F.lit(f"{START}system\n"), F.when(leading, F.concat(first, F.lit("\n\n"))).otherwise(""), F.lit(TOOLS_HEAD), listed, F.lit(TOOLS_TAIL + END))
        head = F.when(F.coalesce(F.size(tools), F.lit(0)) > 0, told).otherwise(head)

    def block(m: Column, i: Column) -> Column:
        plain = F.concat(F.lit(START), m["role"], F.lit("\n"), _content(m), F.lit(END))
        return (
            F.when((m["role"] == "user") | ((m["role"] == "system") & (i > 0)), plain)
            .when(m["role"] == "assistant", _assistant(m, i, n, last_query))
            .when(m["role"] == "tool", _tool(m, i, messages))
            .otherwise("")
        )

    tail = F.lit(f"{START}assistant\n" + ("" if enable_thinking else NO_THINKING)) if generation_prompt else F.lit("")
    return F.concat(head, F.array_join(F.transform(messages, block), ""), tail)
