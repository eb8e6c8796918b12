"""Quality rules: base counts, and robust multivariate outliers per language and source.

Method: each text gets a vector of transformed statistics (logarithms and square
roots of rates, so that their spread does not depend on their size). For every
(language, source) the minimum-covariance-determinant estimate is searched for
from four starts: medians with quartile scales, with the correlations of the
vectors' hyperbolic tangents, with the covariance of their directions, and the
classical estimate. From each, concentration steps go on for as long as the
determinant falls: keep the SUPPORT part of the texts with the smallest
Mahalanobis distances, take mean and covariance of these. The start that ends
with the lowest determinant gives the estimate, made consistent for normal
data.

A text is rejected where its distance is beyond what one text in 1 / LEVEL would reach. Rates
have heavier tails than normal data, so this reach is taken from the distances
themselves: their logarithms are taken as normal above the median, with the
spread that the median and the upper quartile of all texts show; outliers count
for these only by their number, not by their distance. It is never less than the
chi-square quantile.

Two things stand in for noise. What n words show of a statistic varies around the text's own by
MIN_WORDS / n times the variance that MIN_WORDS words have (NOISE), so a distance
is taken with the group's covariance plus that of n words: in the axes in which both
are diagonal, each square is divided by 1 + MIN_WORDS / n times the noise's share
of the axis. And the covariance of a group is regularised: small groups lean on
their language, and languages on the corpus, by PRIOR texts; to it is added
the noise that each statistic has in a text of MIN_WORDS words (NOISE), without
which statistics that are nearly always 0 would have no spread at all.

Estimates cover all texts that pass the base rules. Statistics are rounded to
1/SCALE, so sums are whole numbers and results do not depend on the order of
work.

Scale: texts are read once, and only numbers are kept. Each step aggregates to
(group, start, distance bin) with partial sums before the shuffle, so a group
with a third of all rows sends a few hundred rows per task. Groups whose
determinant has stopped falling are left out of further steps. Means and
matrices are per group and never collected to the driver.

Defined cases: null and wordless texts have zero counts and fail the base
rules; null language or source is a group of its own; repeated rows count as
often as they occur; very long texts are counted whole, in slices; equal
determinants give the estimate of the first of these starts; with no text that
passes the base rules nothing is kept.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from turnloom.llm import textops
from turnloom.llm.columns import boxed, text_of, unboxed, with_fields, without
from turnloom.llm.workspace import Workspace

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SUPPORT = 0.75
#: Steps after which an estimate that still improves is an error; a handful is usual.
MOST_STEPS = 100
#: By how much the logarithm of a determinant must fall for another step.
GAIN = 1e-3
SCALE = 4096
#: Products of tangents and directions are rounded to 1/FINE.
FINE = 1 << 24
#: Share of texts of the fitted distribution beyond the limit.
LEVEL = 1e-3
#: Bins of distances for their quartiles: so many for each factor of e, between these logarithms.
FINE_BIN, FINE_LOW, FINE_HIGH = 256, -12, 15
#: Characters of a word, and the deviation of their number over its mean, in most languages.
WORD_CHARS, WORD_SPREAD = 5.0, 0.5


def _noise() -> tuple[float, ...]:
    """Standard deviations in a text of MIN_WORDS words: the root of a rate over n has 1 / (2 sqrt(n)), a share over n at most that."""
    by_word, by_character = 0.5 / math.sqrt(MIN_WORDS), 0.5 / math.sqrt(MIN_WORDS * WORD_CHARS)
    return (WORD_SPREAD / math.sqrt(MIN_WORDS), by_word, by_character, by_character, by_word, by_word)


#: Of log word length, roots of symbols a word, capitals and digits a character, punctuation a word, share of repeated lines.
NOISE = _noise()
P = len(NOISE)
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Texts that a language counts for in its groups' estimates, and the corpus in its languages'.
PRIOR = 50.0
STARTS = ("quartiles", "tangents", "directions", "classical")
#: Bins of distances: so many for each factor of e, between these logarithms.
BIN, LOW, HIGH = 32, -6, 9


def chi_square_beyond(x: float, k: int) -> float:
    """The chance that a chi-square value with an even number k of degrees is above x."""
    term, total = 1.0, 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return math.exp(-x / 2) * total


def chi_square_limit(level: float, k: int) -> float:
    """The value that a chi-square value with k degrees exceeds with chance `level`."""
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_beyond(middle, k) > level else (low, middle)
    return high


#: The least squared distance at which a text is rejected.
LEAST_LIMIT = chi_square_limit(LEVEL, P)
#: By how much the covariance of the inner SUPPORT part of normal data is too small.
CONSISTENCY = SUPPORT / (1 - chi_square_beyond(chi_square_limit(1 - SUPPORT, P), P + 2))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_OTHER, _UPPER, _DIGIT, _PUNCT = range(4)
_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[48:58] = _UPPER, _DIGIT
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and not _SYMBOL[b]]] = _PUNCT


def statistics(batch: pa.RecordBatch, text: str) -> dict[str, np.ndarray]:
    """Base counts and rounded statistics of each text."""
    raw, at = textops.buffers(batch.column(text))
    n = batch.num_rows
    h, counts, _, _ = textops.words(raw, at)
    chars = textops.per_text(((raw & 0xC0) != 0x80) & ~textops.SEPARATOR[raw], at)
    symbols = textops.per_text(_SYMBOL[raw], at)
    where, per = textops.window_starts(counts, 3)
    repeats = np.zeros(n, np.int64)
    if len(where):
        key = textops.windows(h, 3)[where] ^ textops.mix(np.repeat(np.arange(1, n + 1, dtype=np.uint64), per))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.concatenate((same, [False])) | np.concatenate(([False], same))
        inside = textops.covered(where[order[again]], 3, len(h))
        repeats = textops.per_text(inside, np.concatenate(([0], np.cumsum(counts))))
    kinds = np.bincount(np.repeat(np.arange(n) * 4, np.diff(at)) + _KIND[raw], minlength=4 * n).reshape(n, 4)
    whole, lines, dups = raw.tobytes(), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        own = [x for x in whole[at[i] : at[i + 1]].split(b"\n") if x and not x.isspace()]
        lines[i], dups[i] = len(own), len(own) - len(set(own))
    words, characters = np.maximum(counts, 1), np.maximum(chars, 1)
    x = (
        np.log(characters / words),
        np.sqrt(symbols / words),
        np.sqrt(kinds[:, _UPPER] / characters),
        np.sqrt(kinds[:, _DIGIT] / characters),
        np.sqrt(kinds[:, _PUNCT] / words),
        dups / np.maximum(lines, 1),
    )
    found = dict(zip(COUNTS, (counts, chars, symbols, dups, repeats), strict=True))
    return found | {name: np.rint(v * SCALE).astype(np.int64) for name, v in zip(X, x, strict=True)}


def _measure(text: str, names: list[str]):
    def run(batches):
        for batch in textops.slices(batches, text, 1 << 20):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {k: pa.array(v, pa.int64()) for k, v in statistics(batch, text).items()}
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in names})

    return run


def _distance(means: str, whiten: str) -> Column:
    """Squared Mahalanobis distance; whiten: lower triangle of the inverse Cholesky factor."""
    total = F.lit(0.0)
    for i in range(P):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(whiten)[PAIRS.index((i, j))] * (F.col(X[j]) / SCALE - F.col(means)[j])
        total = total + z * z
    return total


def _noisy_distance() -> Column:
    """Squared distance with the noise of the text's own number of words, in the axes that _axes gives."""
    share, total = F.lit(float(MIN_WORDS)) / F.greatest(F.col("n_words"), F.lit(1)), F.lit(0.0)
    for k in range(P):
        z = F.lit(0.0)
        for j in range(P):
            z = z + F.col("axes")[k * P + j] * (F.col(X[j]) / SCALE - F.col("means")[j])
        total = total + z * z / (1 + share * F.col("noise")[k])
    return total


def _axes(batches):
    """Axes in which a group's covariance is one and the noise of MIN_WORDS words is diagonal, with its shares."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            low = np.zeros((P, P))
            for v, (i, j) in zip(row["whiten"], PAIRS, strict=True):
                low[i, j] = v
            noise = low @ np.diag(np.square(NOISE)) @ low.T
            shares, turn = np.linalg.eigh((noise + noise.T) / 2)
            rows.append((row["group"], row["means"], (turn.T @ low).ravel().tolist(), np.maximum(shares, 0).tolist()))
        names, doubles = ("group", "means", "axes", "noise"), pa.list_(pa.float64())
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.string() if n == "group" else doubles) for n, c in zip(names, columns, strict=True)})


def limit_of(distances: DataFrame) -> float:
    """The distance beyond which a text is rejected, from a column `distance` of all texts that are judged."""
    logarithm = F.greatest(F.lit(FINE_LOW), F.least(F.lit(FINE_HIGH), F.log(F.col("distance") + 1e-9)))
    counts = distances.groupBy(F.floor(logarithm * FINE_BIN).alias("bin")).agg(F.count("*").alias("n"))
    found = sorted((r["bin"], r["n"]) for r in counts.collect())  # one row per bin
    bins, upto = np.array([b for b, _ in found]), np.cumsum([n for _, n in found])
    if not len(bins):
        return LEAST_LIMIT
    middle, upper = ((bins[np.searchsorted(upto, share * upto[-1])] + 0.5) / FINE_BIN for share in (0.5, 0.75))
    normal = NormalDist()
    return max(LEAST_LIMIT, math.exp(middle + (upper - middle) * normal.inv_cdf(1 - LEVEL) / normal.inv_cdf(0.75)))


def _whitened(covariance: np.ndarray) -> tuple[list[float], float]:
    """The lower inverse Cholesky factor, and the logarithm of the determinant."""
    low = np.linalg.cholesky(covariance)
    inverse = np.linalg.inv(low)
    return [float(inverse[i, j]) for i, j in PAIRS], float(2 * np.log(np.diag(low)).sum())


def _symmetric(values: list[float]) -> np.ndarray:
    out = np.empty((P, P))
    for v, (i, j) in zip(values, PAIRS, strict=True):
        out[i, j] = out[j, i] = v
    return out


_PARAMS = T.StructType([
    T.StructField("group", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("means", T.ArrayType(T.DoubleType())), T.StructField("whiten", T.ArrayType(T.DoubleType())), T.StructField("log_det", T.DoubleType()),
])


def _params(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    doubles = pa.list_(pa.float64())
    kinds = (pa.string(), pa.int32(), doubles, doubles, pa.float64())
    return pa.RecordBatch.from_pydict({f.name: pa.array(c, k) for f, c, k in zip(_PARAMS.fields, columns, kinds, strict=True)})


def _scales(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Medians, and deviations from quartiles with the noise on top."""
    q = np.array([row[f"q{i}"] for i in range(P)]) / SCALE
    return q[:, 1], np.sqrt(np.square((q[:, 2] - q[:, 0]) / 1.349) + np.square(NOISE))


def _first(batches):
    """The start from medians and quartiles alone."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            middle, scale = _scales(row)
            rows.append((row["group"], 0, middle.tolist(), *_whitened(np.diag(scale**2))))
        yield _params(rows)


def _moments(row: dict, tail: str = "") -> tuple[float, np.ndarray, np.ndarray]:
    n = float(row[f"n{tail}"])
    mean = np.array([float(row[f"s{i}{tail}"]) for i in range(P)]) / SCALE / n
    second = _symmetric([float(row[f"t{k}{tail}"]) / SCALE / SCALE / n for k in range(len(PAIRS))])
    return n, mean, second - np.outer(mean, mean)


def _lean(n: float, mean: np.ndarray, spread: np.ndarray, other_mean: np.ndarray, other_spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = n / (n + PRIOR)
    return own * mean + (1 - own) * other_mean, own * spread + (1 - own) * other_spread


def _estimate(n: float, mean: np.ndarray, spread: np.ndarray, target: tuple[np.ndarray, np.ndarray]) -> tuple[list[float], list[float], float]:
    """Regularised: means, whitening factor, logarithm of the determinant."""
    mean, spread = _lean(n, mean, spread * CONSISTENCY, *target)
    whiten, log_det = _whitened(spread + np.diag(np.square(NOISE)))
    return mean.tolist(), whiten, log_det


def _targets(batches):
    """What each group leans on: its language's inner part, which leans on the corpus'."""
    for batch in batches:
        names, means, spreads = [], [], []
        for row in batch.to_pylist():
            _, mean, spread = _moments(row, "_all")
            mean, spread = _lean(*_moments(row, "_lang"), mean, spread)
            names.append(row["group"])
            means.append(mean.tolist())
            spreads.append([float(CONSISTENCY * spread[i, j]) for i, j in PAIRS])
        doubles = pa.list_(pa.float64())
        yield pa.RecordBatch.from_pydict({"group": pa.array(names, pa.string()), "t_mean": pa.array(means, doubles), "t_spread": pa.array(spreads, doubles)})


def _starts(batches):
    """All starts of each group, from sums over its texts; determinants count only after a step."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            middle, scale = _scales(row)
            n, mean, spread = _moments(row)
            tangents, directions = (_symmetric([float(row[f"{c}{k}"]) / FINE / n for k in range(len(PAIRS))]) for c in "uv")
            guesses = [(middle, np.diag(scale**2))]
            for inner in (tangents, directions):
                d = np.sqrt(np.maximum(np.diag(inner), 1e-4))
                correlation = 0.99 * inner / np.outer(d, d) + 0.01 * np.eye(P)
                guesses.append((middle, correlation * np.outer(scale, scale)))
            guesses.append((mean, spread + np.diag(np.square(NOISE))))
            rows += [(row["group"], k, m.tolist(), _whitened(c)[0], math.inf) for k, (m, c) in enumerate(guesses)]
        yield _params(rows)


def _concentrate(batches):
    """The next estimate of each group and start from the inner part of its texts."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            target = np.array(row["t_mean"]), _symmetric(row["t_spread"])
            rows.append((row["group"], row["start"], *_estimate(*_moments(row), target)))
        yield _params(rows)


def _inner(fit: DataFrame, params: DataFrame) -> DataFrame:
    """Of each group and start: count, sums and products over the SUPPORT part with the smallest distances."""
    sums = {"n": F.count("*")} | {f"s{i}": F.sum(x) for i, x in enumerate(X)} | {f"t{k}": F.sum(F.col(X[i]) * F.col(X[j])) for k, (i, j) in enumerate(PAIRS)}
    logarithm = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.log(_distance("means", "whiten") + 1e-9)))
    placed = fit.join(params, "group").withColumn("bin", F.floor(logarithm * BIN).cast("int"))
    binned = placed.groupBy("group", "language", "start", "bin").agg(*(v.alias(k) for k, v in sums.items()))
    w = Window.partitionBy("group", "start")
    inner = binned.withColumns({"before": F.sum("n").over(w.orderBy("bin")) - F.col("n"), "whole": F.sum("n").over(w)}).where(F.col("before") < SUPPORT * F.col("whole"))
    return inner.groupBy("group", "language", "start").agg(*(F.sum(k).cast("double").alias(k) for k in sums))


def estimates(ws: Workspace, fit: DataFrame) -> DataFrame:
    """(group, means, whiten): the minimum-covariance-determinant estimate of each group.

    fit: group, language and the statistics X as whole numbers of 1/SCALE.
    """
    quartiles = [F.percentile(x, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"q{i}") for i, x in enumerate(X)]
    quartiles = ws.keep(fit.groupBy("group").agg(*quartiles), "quartiles")
    names = ["n", *(f"s{i}" for i in range(P)), *(f"t{k}" for k in range(len(PAIRS)))]
    own = ws.keep(_inner(fit, quartiles.mapInArrow(_first, _PARAMS)), "moments")
    tongue = own.groupBy("language").agg(*(F.sum(k).alias(f"{k}_lang") for k in names))
    corpus = own.agg(*(F.sum(k).alias(f"{k}_all") for k in names)).first()
    wide = own.select("group", "language").join(tongue, "language").withColumns({f"{k}_all": F.lit(float(corpus[f"{k}_all"] or 0)) for k in names})
    target = ws.keep(wide.mapInArrow(_targets, "group string, t_mean array<double>, t_spread array<double>"), "targets")

    # sums for the starts: of statistics, of tangents and of directions, all on the quartile scale
    deviation = [F.sqrt(F.pow((F.element_at(f"q{i}", 3) - F.element_at(f"q{i}", 1)) / (SCALE * 1.349), 2) + F.lit(NOISE[i] ** 2)) for i in range(P)]
    scaled = fit.join(quartiles, "group").withColumns({f"z{i}": (F.col(x) - F.element_at(f"q{i}", 2)) / SCALE / deviation[i] for i, x in enumerate(X)})
    scaled = scaled.withColumn("length", F.greatest(F.lit(1e-9), F.sqrt(sum(F.col(f"z{i}") ** 2 for i in range(P)))))
    product = lambda f: [F.sum(F.round(f(i) * f(j) * FINE).cast("long")) for i, j in PAIRS]
    sums = {"n": F.count("*")} | {f"s{i}": F.sum(x) for i, x in enumerate(X)} | {f"t{k}": F.sum(F.col(X[i]) * F.col(X[j])) for k, (i, j) in enumerate(PAIRS)}
    sums |= {f"u{k}": c for k, c in enumerate(product(lambda i: F.tanh(f"z{i}")))} | {f"v{k}": c for k, c in enumerate(product(lambda i: F.col(f"z{i}") / F.col("length")))}
    found = scaled.groupBy("group").agg(*(v.cast("double").alias(k) for k, v in sums.items())).join(quartiles, "group")
    best = ws.keep(found.mapInArrow(_starts, _PARAMS).withColumn("active", F.lit(True)), "starts")
    for _ in range(MOST_STEPS):
        moments = _inner(fit, best.where("active").drop("log_det", "active")).join(target, "group")
        new = moments.mapInArrow(_concentrate, _PARAMS).withColumnsRenamed({"means": "m", "whiten": "w", "log_det": "d"})
        better = F.coalesce(F.col("d") < F.col("log_det") - GAIN, F.lit(False))
        choice = lambda n, o: F.when(better, F.col(n)).otherwise(F.col(o)).alias(o)
        stepped = best.join(new, ["group", "start"], "left").select("group", "start", choice("m", "means"), choice("w", "whiten"), choice("d", "log_det"), better.alias("active"))
        seen = Observation()
        was, best = best, ws.keep(stepped.observe(seen, F.count_if("active").alias("active")), "best")
        ws.drop(was)
        if not seen.get["active"]:
            break
    else:
        raise RuntimeError(f"estimates still improve after {MOST_STEPS} steps")
    least = best.groupBy("group").agg(F.min(F.struct("log_det", "start", "means", "whiten")).alias("best"))
    return ws.keep(least.select("group", "best.means", "best.whiten"), "estimates")


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", workspace: Workspace | None = None, with_text: bool = True) -> DataFrame:
    """The rows with the base counts, base_failed, distance (squared, with the noise of a text's length) and kept."""
    text_of(docs, text)
    ws = workspace or Workspace(docs.sparkSession)
    rows = without(docs, *COUNTS, "base_failed", "distance", "kept")
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    carried = [c for c in rows.columns if with_text or c != text]
    keyed = boxed(rows, carried, tl_text=F.col(text), language=named(lang), group=F.concat_ws("\x00", named(lang), named(source)))
    schema = T.StructType([f for f in keyed.schema.fields if f.name != "tl_text"])
    schema = with_fields(schema, *((n, T.LongType()) for n in (*COUNTS, *X)))
    measured = ws.keep(keyed.mapInArrow(_measure("tl_text", schema.names), schema), "measured", "zstd" if with_text else "snappy")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    params = estimates(ws, measured.where(~failed).select("group", "language", *X)).mapInArrow(_axes, "group string, means array<double>, axes array<double>, noise array<double>")
    out = measured.join(params, "group", "left").withColumns({"base_failed": failed, "distance": _noisy_distance()})
    limit = limit_of(out.where("NOT base_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(False))).select(*unboxed(carried), *COUNTS, "base_failed", "distance", "kept")
