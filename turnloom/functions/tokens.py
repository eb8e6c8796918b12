"""Token ids: a native tokenizer with one id per code point, and a plug-in one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Added tokens with their ids, in order of ids (fixed values). The flag: left out when ids are decoded.
SPECIAL_TOKENS = (
    ("<|endoftext|>", 151643, True),
    ("<|im_start|>", 151644, True),
    ("<|im_end|>", 151645, True),
    ("<|object_ref_start|>", 151646, True),
    ("<|object_ref_end|>", 151647, True),
    ("<|box_start|>", 151648, True),
    ("<|box_end|>", 151649, True),
    ("<|quad_start|>", 151650, True),
    ("<|quad_end|>", 151651, True),
    ("<|vision_start|>", 151652, True),
    ("<|vision_end|>", 151653, True),
    ("<|vision_pad|>", 151654, True),
    ("<|image_pad|>", 151655, True),
    ("<|video_pad|>", 151656, True),
    ("<tool_call>", 151657, False),
    ("</tool_call>", 151658, False),
    ("<|fim_prefix|>", 151659, False),
    ("<|fim_middle|>", 151660, False),
    ("<|fim_suffix|>", 151661, False),
    ("<|fim_pad|>", 151662, False),
    ("<|repo_name|>", 151663, False),
    ("<|file_sep|>", 151664, False),
    ("<tool_response>", 151665, False),
    ("</tool_response>", 151666, False),
    ("<think>", 151667, False),
    ("</think>", 151668, False),
)


def special_tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPECIAL_TOKENS, "token string, id int, special boolean")


def code_points(text: Column) -> Column:
    """One id per code point; no id for the empty text."""
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c)))


def from_code_points(ids: Column, skip_special: bool = True) -> Column:
    """The text of code-point ids; added tokens come back as their strings unless they are skipped."""
    chosen = {i: t for t, i, special in SPECIAL_TOKENS if not (special and skip_special)}
    skipped = [i for _, i, special in SPECIAL_TOKENS if special and skip_special]
    names = F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair])
    kept = F.filter(ids, lambda i: ~i.isin(skipped)) if skipped else ids
    # a code point becomes UTF-8 by way of its UTF-32 bytes
    one = lambda i: F.coalesce(F.element_at(names, i), F.decode(F.unhex(F.lpad(F.hex(i), 8, "0")), "UTF-32"))
    return F.array_join(F.transform(kept, one), "")


def split_thinking_ids(ids: Column, end: int) -> tuple[Column, Column]:
    """Ids up to and with the last `end`, and those after it; nothing and all where it is absent."""
    from_right = F.array_position(F.reverse(ids), end)
    cut = F.when(from_right == 0, 0).otherwise(F.size(ids) - from_right + 1).cast("int")
    return F.slice(ids, F.lit(1), cut), F.slice(ids, cut + 1, F.size(ids))


def without_prompt(ids: Column, prompt_length: Column) -> Column:
    return F.slice(ids, prompt_length.cast("int") + 1, F.size(ids))


def plug_in_tokenizer(load: Callable[[], Callable[[list[str]], list[list[int]]]]):
    """A column function from a loader of an encoder, which each worker calls once.

    The encoder takes a list of texts and returns a list of id lists. Null gives null.
    """

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            ids = encoder(texts.fillna("").tolist())
            yield pd.Series([None if missing else list(map(int, x)) for x, missing in zip(ids, texts.isna(), strict=True)])

    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(encode, T.ArrayType(T.IntegerType()))


def plug_in_decoder(load: Callable[[], Callable[[list[list[int]]], list[str]]]):
    """A column function from ids to text, from a loader of a decoder; null gives null."""

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = load()
        for ids in batches:
            missing = ids.isna()
            texts = decoder([[] if gone else list(map(int, x)) for x, gone in zip(ids, missing, strict=True)])
            yield pd.Series([None if gone else t for t, gone in zip(texts, missing, strict=True)])

    decode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(decode, T.StringType())


def tokenizer_file(path: str):
    """Loaders of an encoder and a decoder for a tokenizer file; strings of special tokens in a text are ordinary text."""

    def load():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already fill the cores
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def encoder():
        tokenizer = load()
        return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decoder():
        tokenizer = load()
        return lambda ids: tokenizer.decode_batch(ids, skip_special_tokens=False)

    return encoder, decoder


def pad_token(pad: Column, end: Column) -> Column:
    """The id to pad with: the end token where a vocabulary has none of its own."""
    return F.coalesce(pad, end)
