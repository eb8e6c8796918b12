"""Toxicity scores: boosted trees over dense text features, calibrated.

Method: features are densities of a lexicon (a given seed list, and words and
word beginnings that labelled texts show to go with toxicity), closeness of lexicon words to
second-person words, rates of capitals, punctuation and obfuscated spellings.
Gradient-boosted trees give a raw score, isotonic regression turns it into a
probability.

All labelled rows serve every part by cross-fitting: rows are dealt into FOLDS
parts by a hash of the id; the features of a row come from the lexicon that the
other parts teach, and it is calibrated on the raw score of trees that the
other parts grew. The lexicon, trees and calibration that score texts are those
of all rows.

A lexicon entry's weight is the logarithm of how much likelier a toxic text has
it, from counts that begin with PRIOR texts at the rate of all; seeds begin with
SEED_TEXTS toxic texts more. So an entry seen once or twice weighs little, in
tables of any size. Entries count whose log ratio is at least SURE of its
standard errors; no number of entries is set.

Fitting uses a bounded sample of the labelled rows, at most about SAMPLE_ROWS, chosen
by a hash of the id. What is broadcast or sent to the driver are ids, features
and lexicon entries of these rows' texts, and the count of labels. Scoring
reads every whole text once and shuffles nothing.

Defined cases: null counts as the empty text, which gets the score of its
features (all 0); null labels and labels without a text teach nothing; labels
given twice count once, an id that several rows share is learned from one of
them, and of equal texts one is learned from; where the labels are all of one
class or there are none, nothing can be learned: the score is then 0.5 where the seed list
has no hit and 1.0 where it has; a null id is not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm import boosting, textops
from turnloom.llm.columns import text_of, with_fields, without
from turnloom.llm.workspace import Workspace

SAMPLE_ROWS = 60_000
FOLDS = 5
THRESHOLD = 0.7
#: Texts at the common rate that every entry's counts begin with, and toxic texts that a seed's begin with besides.
PRIOR, SEED_TEXTS = 3.0, 6.0
#: Standard errors that an entry's log ratio must reach.
SURE = 3.0
#: Bytes of word beginnings that are entries like words.
STEMS = (5, 6, 7, 8)
#: General insults that count before any label is seen; the rest of the lexicon is learned.
SEEDS = (
    "idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "garbage", "worthless", "pathetic", "disgusting", "filth",
    "vermin", "imbecile", "cretin", "jerk", "bastard", "clown", "freak", "parasite", "subhuman", "retard", "bitch", "asshole",
)
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "youre", "tu", "toi", "vous", "votre", "du", "dich", "dein", "ihr", "euch", "usted", "ti", "ustedes")
NEAR = 5
FEATURES = ("first", "second", "third", "seed_hits", "hits", "density", "peak", "weight", "near_you", "you_rate", "hidden", "hidden_weight", "capitals", "exclaim", "punctuation", "digits", "odd_words", "log_words")
Lexicon = tuple[np.ndarray, np.ndarray]

_NOT_WORD = np.zeros(256, bool)
_NOT_WORD[[b for b in range(128) if not chr(b).isalnum()]] = True
#: Spellings that stand for letters (fixed values).
_LEET = textops.LOWER.copy()
for _a, _b in zip(b"013457@$!|", b"oieastasil", strict=True):
    _LEET[_a] = _b
_LOOSE = np.zeros(256, bool)
_LOOSE[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_EXCLAIM = np.zeros(256, bool)
_EXCLAIM[33] = True


def hashes_of(vocabulary) -> np.ndarray:
    raw = " ".join(vocabulary).encode()
    return np.unique(textops.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])


_YOU, _SEEDS = hashes_of(SECOND_PERSON), hashes_of(SEEDS)


def _entries(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings; a beginning that is all of the word is the word's own hash."""
    lasts = [np.minimum(starts + k, ends) for k in STEMS]
    return [whole, *np.split(textops.span_hashes(raw, np.tile(starts, len(STEMS)), np.concatenate(lasts)), len(STEMS))]


def plain_words(batch: pa.RecordBatch, text: str):
    raw, at = textops.buffers(batch.column(text))
    lower = textops.LOWER[raw]
    return raw, at, lower, *textops.words(lower, at, separator=_NOT_WORD)


def _member(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    near = np.searchsorted(known, values)
    near[near == len(known)] = 0
    return known[near] == values, near


def _weights(raw: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """The greatest weight of each word's entries, 0 where the lexicon has none."""
    known, weights = lexicon
    out = np.zeros(len(words))
    for values in _entries(raw, starts, ends, words) if len(known) and len(words) else ():
        found, at = _member(values, known)
        out[found] = np.maximum(out[found], weights[at[found]])
    return out


def _sums(raw: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes of each text are marked in two tables, from one running sum."""
    both = textops.per_text((low + (high.astype(np.int64) << 32))[raw], at)
    return both & 0xFFFFFFFF, both >> 32


def _different(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One place of each different pair, in order of pairs."""
    order = np.lexsort((values, owner))
    a, b = owner[order], values[order]
    return order[np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))] if len(order) else order


def _greatest(weight: np.ndarray, words: np.ndarray, edge: np.ndarray, n: int, most: int = 3) -> np.ndarray:
    """The `most` greatest weights of different words of each text."""
    out = np.zeros((n, most))
    hit = np.flatnonzero(weight > 0)
    owner = np.searchsorted(edge, hit, "right") - 1
    first = _different(owner, words[hit])
    hit, owner = hit[first], owner[first]
    order = np.lexsort((-weight[hit], owner))
    hit, owner = hit[order], owner[order]
    place = np.arange(len(hit)) - np.searchsorted(owner, owner)
    top = place < most
    out[owner[top], place[top]] = weight[hit[top]]
    return out


def features(batch: pa.RecordBatch, text: str, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES per text."""
    raw, at, lower, h, counts, starts, ends = plain_words(batch, text)
    edge = np.concatenate(([0], np.cumsum(counts)))
    count = lambda mask: textops.per_text(mask, edge)
    # each different word is looked up once
    words, first, which = np.unique(h, return_index=True, return_inverse=True)
    weight = _weights(lower, words, starts[first], ends[first], lexicon)[which]
    hit = weight > 0
    hits = count(hit)
    total = np.concatenate(([0.0], np.cumsum(weight)))[edge]
    you = _member(words, _YOU)[0][which]
    # words at most NEAR places from a second-person word of the same text
    near_you, at_you = np.zeros(len(h), bool), np.flatnonzero(you)
    text_of_you = np.searchsorted(edge, at_you, "right") - 1
    for shift in range(-NEAR, NEAR + 1):
        other = at_you + shift
        near_you[other[(other >= edge[text_of_you]) & (other < edge[text_of_you + 1])]] = True
    running = np.concatenate(([0], np.cumsum(hit)))
    peak = np.zeros(batch.num_rows)
    places = np.flatnonzero(hit)
    if len(places):
        text_of_place = np.searchsorted(edge, places, "right") - 1
        ahead = np.minimum(places + 50, edge[text_of_place + 1])
        np.maximum.at(peak, text_of_place, running[ahead] - running[places])
    # the same words with look-alike characters replaced and punctuation inside them dropped
    solid = ~_LOOSE[raw] | (_LEET[raw] != textops.LOWER[raw])
    kept_at = np.concatenate(([0], np.cumsum(solid)))[at]
    shown = _LEET[raw[solid]]
    h2, counts2, starts2, ends2 = textops.words(shown, kept_at)
    edge2 = np.concatenate(([0], np.cumsum(counts2)))
    words2, first2, which2 = np.unique(h2, return_index=True, return_inverse=True)
    weight2 = _weights(shown, words2, starts2[first2], ends2[first2], lexicon)[which2]
    hidden = np.maximum(textops.per_text(weight2 > 0, edge2) - hits, 0)
    capitals, exclaims = _sums(raw, at, _UPPER, _EXCLAIM)
    loose, digits = _sums(raw, at, _LOOSE, _DIGIT)
    size = np.maximum(np.diff(at), 1)
    n = np.maximum(counts, 1)
    odd = np.maximum(counts - counts2, 0)
    top = _greatest(weight, h, edge, batch.num_rows)
    hidden_weight = np.maximum(_greatest(weight2, h2, edge2, batch.num_rows, 1)[:, 0] - top[:, 0], 0)
    return np.stack([
        top[:, 0], top[:, 1], top[:, 2], count(_member(words, _SEEDS)[0][which]) / n, np.minimum(hits, 50), hits / n, peak, np.diff(total) / n, count(hit & near_you) / n, count(you) / n,
        np.minimum(hidden, 50), hidden_weight, capitals / size, exclaims / n, loose / n, digits / size, odd / n, np.log1p(counts),
    ], axis=1)


def count_entries(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry) of all different entries of each text."""
    _, _, lower, h, counts, starts, ends = plain_words(batch, text)
    owner = np.repeat(np.arange(batch.num_rows), counts)
    first = _different(owner, h)
    entries = _entries(lower, starts[first], ends[first], h[first])
    owner, values = np.tile(owner[first], len(entries)), np.concatenate(entries)
    first = _different(owner, values)
    return owner[first], values[first]


def _document_entries(text: str):
    """For each partition, entry and part: how many toxic and other texts have it."""

    def run(batches):
        keys, kinds = [], []
        for batch in textops.slices(batches, text, 1 << 20):
            owner, entry = count_entries(batch, text)
            kind = 2 * batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int64) + batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            keys.append(entry)
            kinds.append(kind[owner])
        if keys:
            values, where = np.unique(np.concatenate(keys), return_inverse=True)
            table = np.bincount(where * 2 * FOLDS + np.concatenate(kinds), minlength=2 * FOLDS * len(values)).reshape(len(values), 2 * FOLDS)
            for a in range(0, len(values), 100_000):
                part = slice(a, a + 100_000)
                columns = {"entry": pa.array(values[part].view(np.int64), pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | {f"k{k}": pa.array(table[part, k], pa.int64()) for k in range(2 * FOLDS)})

    return run


def log_ratio(bad, good, all_bad: float, all_good: float):
    """How much likelier toxic texts have an entry, and the standard error; counts begin with a half."""
    ratio = np.log((bad + 0.5) / (all_bad + 1.0)) - np.log((good + 0.5) / (all_good + 1.0))
    return ratio, np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))


def lexicon_of(entries: np.ndarray, bad: np.ndarray, good: np.ndarray, all_bad: int, all_good: int) -> Lexicon:
    """Entries that go with toxic texts, sorted by hash, with their weights; and all seeds."""
    seeds = hashes_of(SEEDS)
    missing = np.setdiff1d(seeds, entries)
    entries = np.concatenate((entries, missing))
    bad, good = (np.concatenate((c, np.zeros(len(missing)))).astype(float) for c in (bad, good))
    seed = np.isin(entries, seeds)
    bad = bad + SEED_TEXTS * seed
    ratio, error = log_ratio(bad, good, all_bad, all_good)
    rate = (all_bad + 0.5) / (all_bad + all_good + 1.0)
    weight = np.log((bad + PRIOR * rate) / (good + PRIOR * (1 - rate))) - np.log(rate / (1 - rate))
    chosen = (seed | (ratio >= SURE * error)) & (weight > 0)
    order = np.argsort(entries[chosen])
    return entries[chosen][order], weight[chosen][order]


class ToxicityModel:
    """A fitted lexicon, trees and calibration; small enough to travel with tasks."""

    def __init__(self, lexicon: Lexicon, trees=None, knots=None):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def scores(self, batch: pa.RecordBatch, text: str) -> np.ndarray:
        x = features(batch, text, self.lexicon)
        if self.trees is None:
            return np.where(x[:, 0] > 0, 1.0, 0.5)
        return boosting.calibrated(self.trees.raw(x), self.knots)


def fit_rows(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[boosting.Trees, tuple[np.ndarray, np.ndarray]]:
    """Trees of all rows, and the calibration from raw scores by trees of the other parts."""
    least = max(2, min(10, int(y.sum()) // 4))
    grow = lambda rows: boosting.fit_trees(x[rows], y[rows], least=least)
    trees, raw, known = grow(np.ones(len(y), bool)), np.zeros(len(y)), np.zeros(len(y), bool)
    for k in range(FOLDS):
        own, others = fold == k, fold != k
        if own.any() and len({*y[others].tolist()}) == 2:
            raw[own], known[own] = grow(others).raw(x[own]), True
    return trees, boosting.isotonic(raw[known], y[known]) if known.any() else boosting.isotonic(trees.raw(x), y)


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, workspace: Workspace | None = None) -> ToxicityModel:
    """labels: rows to learn from, with `doc_id` and `label`; others must have been left out."""
    ws = workspace or Workspace(docs.sparkSession)
    usable = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic")).distinct()
    place = F.pmod(F.xxhash64(F.col("id"), F.lit("toxicity")), F.lit(1 << 20))
    total = usable.count()
    share = min(1.0, 0.95 * sample_rows / max(total, 1))
    picked = usable.where(place < share * (1 << 20)).withColumn("fold", F.pmod(F.xxhash64(F.col("id"), F.lit("fold")), F.lit(FOLDS)).cast("int"))

    def with_texts(rows: DataFrame) -> DataFrame:
        return docs.select(F.col(doc_id).alias("id"), text).join(F.broadcast(rows), "id")  # at most about sample_rows rows of 20 bytes

    # of equal texts one is taught, else the words of a copied toxic text would all count as toxic
    one = with_texts(picked).groupBy(F.xxhash64(text).alias("print")).agg(F.min(F.struct("id", "toxic", "fold")).alias("r")).select("r.*")
    taught = with_texts(ws.keep(one.distinct(), "sample"))
    sizes = np.zeros((FOLDS, 2))
    for r in taught.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect():
        sizes[r["fold"], r["toxic"]] = r["n"]
    names = [f"k{k}" for k in range(2 * FOLDS)]
    sums = taught.select(text, "toxic", "fold").mapInArrow(_document_entries(text), "entry long, " + ", ".join(f"{n} long" for n in names)).groupBy("entry").agg(*(F.sum(n).alias(n) for n in names))
    # what no part's lexicon can hold stays behind: the best that a part may show is all toxic texts and none of its own others
    bad, good = sum(F.col(n) for n in names[1::2]), sum(F.col(n) for n in names[::2])
    fewest = good - F.greatest(*names[::2])
    ratio = F.log((bad + 0.5) / F.lit(sizes[:, 1].sum() - sizes[:, 1].max() + 1.0)) - F.log((fewest + 0.5) / F.lit(sizes[:, 0].sum() + 1.0))
    seeds = F.col("entry").isin(hashes_of(SEEDS).view(np.int64).tolist())
    table = sums.where(seeds | ((bad > 0) & (ratio >= SURE * F.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))))).toArrow()
    entries = table.column("entry").to_numpy().view(np.uint64)
    counts = np.stack([table.column(n).to_numpy() for n in names], axis=1).reshape(-1, FOLDS, 2) if table.num_rows else np.zeros((0, FOLDS, 2))

    def taught_by(parts: np.ndarray) -> Lexicon:
        own, whole = counts[:, parts].sum(axis=1), sizes[parts].sum(axis=0)
        return lexicon_of(entries, own[:, 1], own[:, 0], int(whole[1]), int(whole[0]))

    everything = taught_by(np.ones(FOLDS, bool))
    if not sizes.sum(axis=0).all():
        return ToxicityModel(lexicon_of(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0, 0))
    sent = docs.sparkSession.sparkContext.broadcast([taught_by(np.arange(FOLDS) != k) for k in range(FOLDS)])

    def measured(batches):
        for batch in textops.slices(batches, text, 1 << 20):
            fold, x = batch.column("fold").to_numpy(), np.zeros((batch.num_rows, len(FEATURES)))
            for k in np.unique(fold).tolist():
                own = np.flatnonzero(fold == k)
                x[own] = features(batch.take(pa.array(own)), text, sent.value[k])
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "toxic": batch.column("toxic"), "fold": batch.column("fold"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    kind = T.StructType([*taught.select("id", "toxic", "fold").schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))])
    seen = taught.mapInArrow(measured, kind).dropDuplicates(["id", "toxic"]).orderBy("id", "toxic").toArrow()
    x, y = np.array(seen.column("x").to_pylist()), seen.column("toxic").to_numpy()
    return ToxicityModel(everything, *fit_rows(x, y, seen.column("fold").to_numpy()))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows with score (0 to 1) and predicted (1 where the score is at least THRESHOLD)."""
    text_of(docs, text)
    docs = without(docs, "score", "predicted")
    schema = with_fields(T.StructType([f for f in docs.schema.fields if keep_text or f.name != text]), ("score", T.DoubleType()), ("predicted", T.IntegerType()))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in textops.slices(batches, text, 1 << 20):
            score = sent.value.scores(batch, text)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {"score": pa.array(score), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))}
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in schema.names})

    return docs.mapInArrow(run, schema)
