"""License scan: notice phrases, identifier tags and their expressions.

Method: texts are reduced to lower-case words joined by one space (words are
runs of ASCII letters and digits and of all characters from 0x80 on). One
Aho-Corasick automaton finds phrases and tag names there. Where a tag name
occurs, the expression after it in the raw text, up to the end of the line or to the next tag
(or on the next line, where nothing follows on its own), is brought into postfix order
by a shunting-yard parser and evaluated: `or` and `/` hold if one side is permitted,
`and` and `,` if both are, `with` keeps the licence and drops the exception.

Only known identifiers and LicenseRef- ones are operands and labels. A plain word in
an operand's place is prose and ends the expression before it; a name with
digits or hyphens, or one after an operator in capitals, is an identifier
that is not known, and an expression with such a one is never permitted.

Scale: one pass over the texts, no shuffle; time is linear in a text's length,
memory a small multiple of it.

Defined cases: null counts as the empty text: no words, no places, empty label
strings, score 0. Malformed expressions (unbalanced, missing operands) are
listed as found and give all their known identifiers as labels, but are never
permitted; what follows an operand without an operator is prose and ends the
expression. A tag after which nothing can be read counts for nothing; with one whose
expression cannot be read in full the text is not permitted. Very long texts are scanned from end to end. Ties do not occur, as
rows are judged one by one; repeated rows give repeated results.
"""

from __future__ import annotations

import itertools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from turnloom.llm import textops
from turnloom.llm.columns import text_of, with_fields, without
from turnloom.llm.workspace import ship

#: Phrases whose places are reported, with their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases and how much each says by itself.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "gnu free documentation license": ("gfdl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.8),
    "bsd 2 clause": ("bsd", 0.8),
    "bsd 3 clause": ("bsd", 0.8),
    "isc license": ("isc", 0.8),
    "boost software license": ("bsl", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons zero": ("cc0", 0.8),
    "cc0 1 0": ("cc0", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by nc sa": ("cc-by-nc-sa", 0.8),
    "cc by nc nd": ("cc-by-nc-nd", 0.8),
    "released into the public domain": ("public-domain", 0.8),
    "all rights reserved": ("proprietary", 0.5),
}
TAGS = ("spdx license identifier", "license expression")
BASE_WEIGHT = 0.7
TAG_WEIGHT = 0.95
#: Families that a permissive corpus may hold.
PERMITTED = frozenset({"apache", "mit", "bsd", "isc", "bsl", "cc-by", "cc0", "unlicense", "zlib", "public-domain"})

_WORDS = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))
_GAP = rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
_TAG = re.compile(rb"(?i)(?:spdx" + _GAP + rb"license" + _GAP + rb"identifier|license" + _GAP + rb"expression)[ \t]*[:=]")
_TOKEN = re.compile(r"[(),/]|[A-Za-z0-9][A-Za-z0-9.+:_-]*")
_VERSION = re.compile(r"(-only|-or-later|\+)$|-v?[0-9][0-9.]*.*$")
_RANK = {"or": 1, "and": 2, "with": 3}
_SIGNS = {",": "and", "/": "or"}
#: Families of identifiers (fixed values), besides LicenseRef- and DocumentRef- ones.
KNOWN = frozenset(
    "0bsd aal afl agpl apache apsl artistic beerware blueoak boost bsd bsl bzip2 cal cc-by cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd cc-by-sa cc0 cddl cecill clartistic cpal cpl curl ecl ecos efl epl eupl fair ftl "
    "gfdl gpl hpnd icu ijg ipl isc json libpng lgpl lppl mit mit-0 mpl ms-pl ms-rl mulanpsl ncsa nist-pd npl odbl odc-by ofl oldap openssl osl php pddl postgresql psf python qpl ruby sissl sleepycat sspl "
    "tcl unicode unicode-dfs unlicense upl vim w3c wtfpl x11 zend zlib zpl".split()
)


def family(identifier: str) -> str:
    """An identifier without its version: Apache-2.0 is apache, GPL-3.0-or-later and GPLv3 gpl."""
    name = identifier.lower()
    while name not in KNOWN:
        short = _VERSION.sub("", name, count=1)
        short = re.sub(r"v?[0-9][0-9.]*$", "", name) if short == name else short
        if short == name or not short:
            break
        name = short
    return name


def is_known(identifier: str) -> bool:
    return family(identifier) in KNOWN or bool(re.match(r"(?i)(documentref-[^:]+:)?licenseref-.", identifier))


def _is_prose(token: str, operator: str | None) -> bool:
    return token.isalpha() and not is_known(token) and not (operator or "").isupper()


def parse(expression: str) -> tuple[list[str] | None, list[str]]:
    """The expression in postfix order, None if it is malformed or holds an unknown identifier; and all its identifiers."""
    out, pending, operand, sound, identifiers = [], [], False, True, []
    tokens = _TOKEN.findall(expression)
    for at, token in enumerate(tokens):
        word = _SIGNS.get(token, token.lower())
        if word in _RANK:
            ahead = tokens[at + 1] if at + 1 < len(tokens) else None
            if operand and ahead is not None and ahead not in "(),/" and ahead.lower() not in _RANK and _is_prose(ahead, token):
                break
            sound &= operand
            while pending and pending[-1] != "(" and _RANK[pending[-1]] >= _RANK[word]:
                out.append(pending.pop())
            pending.append(word)
            operand = False
        elif token == "(":
            if operand:
                break
            pending.append(token)
        elif token == ")":
            sound &= operand
            while pending and pending[-1] != "(":
                out.append(pending.pop())
            if pending:
                pending.pop()
            else:
                sound = False
        elif operand or (not pending and _is_prose(token, None)):
            break
        else:
            exempts = bool(pending) and pending[-1] == "with"
            out.append(token)
            identifiers.append(token)
            sound &= exempts or is_known(token)
            operand = True
    return (out + pending[::-1] if sound and operand and "(" not in pending else None), identifiers


def evaluate(expression: str, permitted: frozenset[str] = PERMITTED) -> tuple[list[str], bool]:
    """Families that the expression names, and whether it can be met by permitted ones."""
    order, identifiers = parse(expression)
    if order is None:
        return sorted({family(t) for t in identifiers if is_known(t)}), False
    stack: list[tuple[frozenset[str], bool]] = []
    for token in order:
        if token not in _RANK:
            name = family(token)
            stack.append((frozenset([name]), name in permitted))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(left)
        else:
            stack.append((left[0] | right[0], (left[1] or right[1]) if token == "or" else (left[1] and right[1])))
    return sorted(stack[0][0]), stack[0][1]


def expressions_of(raw: bytes) -> list[str]:
    """What follows each tag: up to the next tag or the line's end; the next line where that is empty."""
    heads, found = list(_TAG.finditer(raw)), []
    for k, head in enumerate(heads):
        end = heads[k + 1].start() if k + 1 < len(heads) else len(raw)
        lines = re.compile(rb"[^\r\n]*").finditer(raw, head.end(), end)
        texts = (m[0].decode(errors="replace").strip(" \t\"'*/#->;") for m in lines if m[0])
        found.append(next((t for t in itertools.islice(texts, 2) if t), ""))
    return found


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS}:
        found.add_word(f" {phrase} ", (phrase, len(phrase.split())))
    found.make_automaton()
    return found


def scan(raw: bytes, machine: ahocorasick.Automaton) -> dict:
    """What one text shows; see scan_licenses for the fields."""
    parts = raw.translate(_WORDS).split()
    line = f" {b' '.join(parts).decode('latin-1')} "
    places, labels, sure, tagged, words, seen = [], set(), 1.0, False, 0, 0
    for end, (phrase, width) in machine.iter(line):
        if phrase in BASE:
            # spaces before a match's end are words begun; counted on from the match before
            words, seen = words + line.count(" ", seen, end), end
            places.append((words - width, BASE[phrase]))
        elif phrase in NOTICES:
            label, weight = NOTICES[phrase]
            labels.add(label)
            sure *= 1 - weight
        else:
            tagged = True
    expressions, permitted = [], None
    for expression in expressions_of(raw) if tagged else ():
        if not parse(expression)[1]:
            continue  # nothing that names a licence
        names, good = evaluate(expression)
        expressions.append(expression)
        labels.update(names)
        permitted = good if permitted is None else permitted and good
        sure *= 1 - TAG_WEIGHT
    sure *= (1 - BASE_WEIGHT) ** min(len(places), 16)
    base = {label for _, label in places}
    starts = [at for at, _ in places]
    return {
        "n_words": len(parts), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": 1 - sure,
        "expressions": expressions, "permitted": permitted,
    }


FIELDS = {
    "n_words": (T.LongType(), pa.int64()), "n_base": (T.LongType(), pa.int64()), "first_word": (T.LongType(), pa.int64()), "last_word": (T.LongType(), pa.int64()),
    "base_labels": (T.StringType(), pa.string()), "labels": (T.StringType(), pa.string()), "score": (T.DoubleType(), pa.float64()),
    "expressions": (T.ArrayType(T.StringType()), pa.list_(pa.string())), "permitted": (T.BooleanType(), pa.bool_()),
}


def scan_licenses(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows with n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permitted.

    permitted is null where the text has no tag that can be read.
    """
    text_of(docs, text)
    ship(docs.sparkSession)
    docs = without(docs, *FIELDS)
    schema = with_fields(T.StructType([f for f in docs.schema.fields if keep_text or f.name != text]), *((n, k[0]) for n, k in FIELDS.items()))

    def run(batches):
        machine = automaton()
        for batch in textops.slices(batches, text, 1 << 20):
            raw, at = textops.buffers(batch.column(text))
            whole = raw.tobytes()
            found = [scan(whole[a:b], machine) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {n: pa.array([f[n] for f in found], k[1]) for n, k in FIELDS.items()}
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in schema.names})

    return docs.mapInArrow(run, schema)
