"""Text expressions on columns: reasoning tags, white space, escaping, parameter rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and regular expressions see it (fixed values).
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_THINK = r"(?s)<think>.*?</think>"


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode included."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def drop_thinking(text: Column) -> Column:
    """Without closed reasoning tags and their contents; not greedy, so nested tags leave a tail."""
    return F.regexp_replace(text, _THINK, "")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, rf"\n[{SPACE}]*\n", "\n")


def clean_reply(text: Column) -> Column:
    """A reply as it is shown: no reasoning, no blank lines, stripped."""
    return strip(collapse_blank_lines(drop_thinking(text)))


def lstrip_newlines(text: Column) -> Column:
    return F.ltrim(text, F.lit("\n"))


def rstrip_newlines(text: Column) -> Column:
    return F.rtrim(text, F.lit("\n"))


def reasoning_of(content: Column) -> Column:
    """Before the first closing tag and after the last opening one; empty without a closing tag."""
    before = rstrip_newlines(F.substring_index(content, "</think>", 1))
    found = lstrip_newlines(F.substring_index(before, "<think>", -1))
    return F.when(F.contains(content, F.lit("</think>")), found).otherwise("")


def answer_of(content: Column) -> Column:
    """After the last closing tag; all of it without one."""
    return F.when(F.contains(content, F.lit("</think>")), lstrip_newlines(F.substring_index(content, "</think>", -1))).otherwise(content)


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def or_default(value: Column, default) -> Column:
    """Null and 0 give the default."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def if_null(value: Column, default) -> Column:
    """Only null gives the default."""
    return F.coalesce(value, F.lit(default))


def if_absent(value: Column, present: Column, default) -> Column:
    """Only a missing key gives the default; a null that is there stays null."""
    return F.when(present, value).otherwise(F.lit(default))


def text_or_default(value: Column, default: str) -> Column:
    """Null and the empty string give the default."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def leading_int(text: Column) -> Column:
    """The whole number that a text begins with, white space skipped; null without one."""
    return F.regexp_extract(text, rf"\A[{SPACE}]*([+-]?[0-9]+)", 1).try_cast("bigint")


def int_or_default(text: Column, default: int) -> Column:
    """leading_int, where null and 0 give the default."""
    return F.coalesce(F.nullif(leading_int(text), F.lit(0).cast("bigint")), F.lit(default).cast("bigint"))


def is_greedy(temperature: Column) -> Column:
    return temperature.isNull() | (temperature <= 0)
