"""Vocabularies with control tokens: ids of rendered prompts, their text, and the text piece by piece.

A rendered prompt holds control strings (turn marks, tool and reasoning tags).
Those that the template wrote are one id each. Where the same strings stand in
what somebody said, `guarded` marks them before rendering, and they become
ordinary pieces; without it every control string counts, wherever it stands.
Ordinary text is encoded between control strings, so a prompt's ids are those of
its blocks one after the other.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions.tokens import SPECIAL_TOKENS

#: Put behind the first character of a control string that is only text; doubled where it stands itself.
GUARD = "\x1a"
IDS = T.ArrayType(T.IntegerType())
#: Characters or ids that a column function works on at once; a longer value is worked on by itself.
AT_ONCE = 50_000


def guarded(text: Column, controls=tuple(t for t, _, _ in SPECIAL_TOKENS)) -> Column:
    """The text with all control strings in it marked as ordinary text."""
    rest = "|".join(sorted({rf"\Q{c[1:]}\E" for c in controls}))
    first = "".join(sorted({re.escape(c[0]) for c in controls}))
    return F.regexp_replace(F.replace(text, F.lit(GUARD), F.lit(2 * GUARD)), f"([{first}])(?=(?:{rest}))", f"$1{GUARD}")


def unguarded(text: str) -> str:
    return re.sub(f"{GUARD}({GUARD}?)", r"\1", text) if GUARD in text else text


def _portions(values: pd.Series) -> Iterator[pd.Series]:
    """A batch in its order, AT_ONCE characters or ids at a time: a batch has thousands of rows of any length."""
    sizes = np.cumsum([1 if gone else 1 + len(v) for v, gone in zip(values, values.isna(), strict=True)], dtype=np.int64)
    cuts = np.flatnonzero(np.diff(sizes // AT_ONCE)) + 1
    for start, stop in zip((0, *cuts), (*cuts, len(values)), strict=True):
        yield values.iloc[start:stop]


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file and control tokens: (string, left out when ids are decoded).

    A control string that the file knows keeps its id there; the others get the
    ids after the file's last one, in order. The file is read by each worker at
    the first use, from the same path everywhere.
    """

    path: str
    controls: tuple[tuple[str, bool], ...] = tuple((t, special) for t, _, special in SPECIAL_TOKENS)
    _loaded: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {"path": self.path, "controls": self.controls, "_loaded": {}}

    def _tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already fill the cores
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _whole(self):
        """The tokenizer with the control tokens, for decoding."""
        from tokenizers import AddedToken

        whole = self._tokenizer()
        for string, special in self.controls:
            token = AddedToken(string, normalized=False, special=special)
            whole.add_special_tokens([token]) if special else whole.add_tokens([token])
        return whole

    def _parts(self):
        """What encoding needs; a worker that only encodes keeps one tokenizer, and so does one that only decodes."""
        if "plain" not in self._loaded:
            whole = self._loaded.get("whole") or self._whole()
            ids = {string: whole.token_to_id(string) for string, _ in self.controls}
            del whole
            plain = self._tokenizer()
            plain.encode_special_tokens = True
            found = re.compile("(" + "|".join(re.escape(c) for c in sorted(ids, key=len, reverse=True)) + ")")
            self._loaded.update(plain=plain, ids=ids, found=found)
        return self._loaded

    def control_ids(self) -> dict[str, int]:
        return dict(self._parts()["ids"])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; unguarded control strings are one id."""
        parts = self._parts()
        ids, cut = parts["ids"], [parts["found"].split(t) for t in texts]
        # split() puts control strings at the odd places
        plain = [unguarded(s) for pieces in cut for s in pieces[::2]]
        encoded = iter(parts["plain"].encode_batch_fast(plain, add_special_tokens=False))
        return [[i for at, s in enumerate(pieces) for i in ([ids[s]] if at % 2 else next(encoded).ids)] for pieces in cut]

    def decode(self, rows: list[list[int]], skip_special: bool = True) -> list[str]:
        if "whole" not in self._loaded:
            self._loaded["whole"] = self._whole()
        return self._loaded["whole"].decode_batch(rows, skip_special_tokens=skip_special)

    # ------------------------------------------------------------ column functions

    def _column(self, work: Callable[[list], list], kind: T.DataType, empty):
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for values in (part for batch in batches for part in _portions(batch)):
                missing = values.isna()
                given = [empty if gone else v for v, gone in zip(values, missing, strict=True)]
                yield pd.Series([None if gone else x for x, gone in zip(work(given), missing, strict=True)], dtype=object)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, kind)

    def ids(self):
        """A column function from text to ids; null gives null."""
        return self._column(lambda texts: self.encode(list(texts)), IDS, "")

    def text(self, skip_special: bool = True):
        """A column function from ids to text; tokens that are marked so are left out."""
        return self._column(lambda rows: self.decode([list(map(int, r)) for r in rows], skip_special), T.StringType(), [])

    def pieces(self, skip_special: bool = True):
        """A column function from ids to the pieces that a stream shows: one for each id, and one for the end."""
        return self._column(lambda rows: [list(stream_pieces(self, list(map(int, r)), skip_special)) for r in rows], T.ArrayType(T.StringType()), [])


def _wide(char: str) -> bool:
    """Characters of scripts that put no spaces between words, as one may be shown before the next has come."""
    code = ord(char)
    return 0x2E80 <= code <= 0x9FFF or 0xAC00 <= code <= 0xD7A3 or 0xF900 <= code <= 0xFAFF or 0x20000 <= code <= 0x3FFFF


def _settled(text: str) -> int:
    """How much of a text no later id can change or lengthen: up to its last space, line end or wide character."""
    for at in range(len(text), 0, -1):
        if text[at - 1].isspace() or _wide(text[at - 1]):
            return at
    return 0


def stream_pieces(vocabulary: Vocabulary, ids: list[int], skip_special: bool = True) -> Iterator[str]:
    """What each id adds to the shown text, and at last the rest; often nothing, never half a character.

    A word waits for its end, and a replacement character at the end too, as it
    may stand for the first bytes of a character. Ids are decoded together with those
    just before them, back to a place where text ended whole, so the work grows
    with the ids.
    """
    decode = lambda part: vocabulary.decode([part], skip_special)[0]
    start, clean, taken, waiting = 0, 0, 0, ""
    for end in range(1, len(ids) + 1):
        text = decode(ids[start:end])
        sure = len(text) - text.endswith("\ufffd")
        waiting, taken = waiting + text[taken:sure], max(taken, sure)
        if sure == len(text):
            start, clean = clean, end
            taken = len(decode(ids[start:end]))
        at = _settled(waiting)
        yield waiting[:at]
        waiting = waiting[at:]
    yield waiting + decode(ids[start:])[taken:]
