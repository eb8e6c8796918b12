"""Registered queries on the smallest tables against plain Python, and operators on planted cases."""

import collections
import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import turnloom.llm.embedding_dedup as embedding_dedup
import turnloom.llm.minhash_dedup as minhash_dedup
from tests.llm import helpers
from turnloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def run(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


class Groups:
    def __init__(self, ids):
        self.parent = {i: i for i in ids}

    def root(self, a):
        while self.parent[a] != a:
            a = self.parent[a]
        return a

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def shingles(text):
    w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_groups(texts):
    sets, groups = {d: shingles(t) for d, t in texts.items()}, Groups(texts)
    lists = collections.defaultdict(list)
    for d, s in sorted(sets.items()):
        shared = collections.Counter()
        for g in s:
            shared.update(lists[g])
            lists[g].append(d)
        for o, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                groups.link(d, o)
    return {d: (len(sets[d]), groups.root(d)) for d in texts}


def removed(texts, k=35):
    words = {d: SPACE.findall(t or "") for d, t in texts.items()}
    seen = collections.Counter(tuple(w[i : i + k]) for w in words.values() for i in range(len(w) - k + 1))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        kept = " ".join(a for a, b in zip(w, gone) if not b)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def mutated(rng, text, share):
    return " ".join(f"m{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def planted(seed=3):
    """Copies, near copies at many distances, shared passages, and texts that share nothing."""
    rng = random.Random(seed)
    rows, n = {}, 0
    for base in range(4):
        text = helpers.prose(rng, 120)
        for i in range(60):
            rows[n] = mutated(rng, text, rng.choice((0, 0.01, 0.03, 0.06, 0.1)) if i else 0)
            n += 1
    passage = helpers.prose(rng, 40)
    for _ in range(60):
        rows[n] = f"{helpers.prose(rng, rng.randrange(5, 90))} {passage} {helpers.prose(rng, 30)}"
        n += 1
    for _ in range(60):
        rows[n] = helpers.prose(rng, rng.randrange(1, 60))
        n += 1
    return rows


def test_minhash_query(spark):
    want = near_groups({r["doc_id"]: r["text"] for r in table("documents")})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op5_minhash_dedup")}
    assert got == want


@pytest.mark.parametrize("list_size", [1, 2, 32, 1000])
def test_minhash_planted(spark, monkeypatch, list_size):
    """The same groups whether lists count as short or long."""
    monkeypatch.setattr(minhash_dedup, "LIST", list_size)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    texts = planted()
    docs = helpers.frame(spark, [(d, t, "en", "a", 1) for d, t in texts.items()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.link_near_duplicates(docs).collect()}
    assert got == near_groups(texts)


@pytest.mark.parametrize("list_size", [1, 32])
def test_minhash_families_of_shared_passages(spark, monkeypatch, list_size):
    """Texts that share most of their words without being linked, of several sizes, and links among them."""
    monkeypatch.setattr(minhash_dedup, "LIST", list_size)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rng, texts = random.Random(21), {}
    common = helpers.prose(rng, 200)
    for i in range(120):
        kept = " ".join(common.split()[: rng.choice((120, 150, 200))])
        texts[i] = f"{kept} {helpers.prose(rng, rng.choice((20, 30, 45, 60, 90)))}"
    for i in range(120, 150):
        texts[i] = mutated(rng, texts[rng.randrange(120)], 0.01)
    docs = helpers.frame(spark, [(d, t, "en", "a", 1) for d, t in texts.items()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.link_near_duplicates(docs).collect()}
    assert got == near_groups(texts)


def test_substring_query(spark):
    want = removed({r["doc_id"]: r["text"] for r in table("documents")})
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run(spark, "op8_substring_dedup")} == want


@pytest.mark.parametrize(("fan", "windows", "false_pairs"), [(10, 1 << 20, 1e-3), (2, 64, 1e-3), (3, 200, 1e-25), (10, 1 << 20, 1e-40)])
def test_substring_planted(spark, monkeypatch, fan, windows, false_pairs):
    """With one exchange and with several, with hashes of 8 to 16 bytes."""
    import turnloom.llm.substring_dedup as substring_dedup

    monkeypatch.setattr(substring_dedup, "FAN_BITS", fan)
    monkeypatch.setattr(substring_dedup, "RANGE_WINDOWS", windows)
    monkeypatch.setattr(substring_dedup, "GATHER_WINDOWS", 8 * windows)
    monkeypatch.setattr(substring_dedup, "FALSE_PAIRS", false_pairs)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 1 << 13)
    texts = planted(5)
    docs = helpers.frame(spark, [(d, t, "en", "a", 1) for d, t in texts.items()])
    out = substring_dedup.remove_repeated_windows(docs.repartition(5), digest=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == removed(texts)
    for r in out:  # the text that is left has the kept words
        assert hashlib.sha256(" ".join(r["text"].split()).encode()).hexdigest() == r["kept_sha256"]


def test_substring_hash_blocks():
    from turnloom.llm.substring_dedup import _among, decode, encode, hash_bytes

    assert [hash_bytes(n) for n in (0, 10**8, 10**10, 10**13, 10**30)] == [8, 8, 10, 12, 16]
    rng = np.random.default_rng(3)
    for n, extra in ((0, 0), (1, 0), (3, 5), (15, 8), (16, 0), (1000, 1), (1000, 8)):
        values, more = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64)), rng.integers(0, 2**63, n, dtype=np.uint64) & np.uint64(2 ** (8 * extra) - 1)
        got = decode(encode(values, more, extra), extra)
        assert got[0].tolist() == values.tolist() and got[1].tolist() == more.tolist()
    import pyarrow as pa

    # hashes that agree in 64 bits are told apart by the others
    one = lambda *pairs: tuple(np.array(x, np.uint64) for x in zip(*sorted(pairs)))
    blobs = pa.array([encode(*one((5, 1), (5, 3), (9, 0)), 1), encode(*one((5, 2)), 1)], pa.binary())
    assert _among(*one((5, 0), (5, 1), (5, 2), (5, 3), (5, 4), (9, 0), (9, 1), (10, 0)), blobs, 1).tolist() == [False, True, True, True, False, True, False, False]


def test_substring_block_cost_does_not_grow():
    """Time and bytes for each window of a chunk with as many ranges as an exchange ever has, against a few."""
    import time

    from turnloom.llm.substring_dedup import FAN_BITS, _blocks

    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 600_000, dtype=np.uint64) * np.uint64(2))
    none, cost = np.zeros(len(values), np.uint64), {}
    for bits in (6, FAN_BITS):
        began = time.process_time()
        out = _blocks(values, none, none.astype(bool), none, np.zeros(1, np.int64), bits, 0)
        cost[bits] = ((time.process_time() - began) / len(values), sum(map(len, out.column("hashes").to_pylist())) / len(values))
    assert cost[FAN_BITS][0] < 2e-6 and cost[FAN_BITS][1] < 6.5 and cost[FAN_BITS][1] < 1.1 * cost[6][1]


def test_quality_base_counts(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    for r in run(spark, "op3_quality_rules"):
        text = texts[r["doc_id"]]
        w = SPACE.findall(text)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        again = [False] * len(w)
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                again[i : i + 3] = [True] * 3
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(again))
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * sum(again) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def vector(text):
    """The statistics of a text, by plain Python, in whole numbers of 1/4096."""
    words = SPACE.findall(text)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    count = lambda pattern: len(re.findall(pattern, text))
    n, c = max(len(words), 1), max(chars, 1)
    x = (np.log(c / n), (count(r"[#*$%&|<>]") / n) ** 0.5, (count("[A-Z]") / c) ** 0.5, (count("[0-9]") / c) ** 0.5, (count(r"""[!"'()+,\-./:;=?@\[\\\]^_`{}~]""") / n) ** 0.5, (len(lines) - len(set(lines))) / max(len(lines), 1))
    return np.rint(np.array(x) * 4096)


def robust_distances(groups, sizes):
    """groups: {(language, source): matrix of statistics}, sizes: their texts' words. Squared distances from the estimate of least determinant, in numpy."""
    from turnloom.llm.quality_rules import BIN, CONSISTENCY, GAIN, HIGH, LOW, NOISE, PRIOR, SUPPORT

    noise, groups = np.array(NOISE), {g: x / 4096 for g, x in groups.items()}

    def distances(x, mean, spread):
        return np.einsum("ij,ij->i", x - mean, np.linalg.solve(spread, (x - mean).T).T)

    def inner(x, mean, spread):
        bins = np.floor(np.clip(np.log(distances(x, mean, spread) + 1e-9), LOW, HIGH) * BIN)
        return x[bins <= np.sort(bins)[int(np.ceil(SUPPORT * len(x))) - 1]]

    def lean(n, mean, spread, other):
        own = n / (n + PRIOR)
        return own * mean + (1 - own) * other[0], own * spread + (1 - own) * other[1]

    moments = lambda x: (x.mean(0), np.cov(x.T, bias=True))
    q = {g: np.percentile(x, [25, 50, 75], axis=0) for g, x in groups.items()}
    scale = {g: np.sqrt(((v[2] - v[0]) / 1.349) ** 2 + noise**2) for g, v in q.items()}
    first = {g: inner(x, q[g][1], np.diag(scale[g] ** 2)) for g, x in groups.items()}
    corpus, out = moments(np.concatenate(list(first.values()))), {}
    for g, x in groups.items():
        own = np.concatenate([v for k, v in first.items() if k[0] == g[0]])
        mean, spread = lean(len(own), *moments(own), corpus)
        target, z = (mean, CONSISTENCY * spread), (x - q[g][1]) / scale[g]
        matrices = [np.diag(scale[g] ** 2)]
        for v in (np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)):
            m = v.T @ v / len(x)
            d = np.sqrt(np.maximum(np.diag(m), 1e-4))
            matrices.append((0.99 * m / np.outer(d, d) + 0.01 * np.eye(6)) * np.outer(scale[g], scale[g]))
        starts = [(q[g][1], m) for m in matrices] + [(x.mean(0), np.cov(x.T, bias=True) + np.diag(noise**2))]
        found = []
        for start in starts:
            best, log_det = start, np.inf
            while True:
                half = inner(x, *best)
                mean, spread = lean(len(half), half.mean(0), np.cov(half.T, bias=True) * CONSISTENCY, target)
                spread = spread + np.diag(noise**2)
                if not np.linalg.slogdet(spread)[1] < log_det - GAIN:
                    break
                best, log_det = (mean, spread), np.linalg.slogdet(spread)[1]
            found.append((log_det, best))
        mean, spread = min(found, key=lambda f: f[0])[1]
        # each text by the group's covariance and the noise of as many words as it has
        out[g] = [(v - mean) @ np.linalg.solve(spread + np.diag(noise**2) * 50 / n, v - mean) for v, n in zip(x, sizes[g], strict=True)]
    return out


def expected_quality(rows):
    """{id: (base passed, squared distance)} for rows of (id, text, language, source)."""
    groups, failed = collections.defaultdict(list), set()
    for d, text, lang, source in rows:
        w = SPACE.findall(text)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        again = [False] * len(w)
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                again[i : i + 3] = [True] * 3
        if len(w) < 50 or 100 * sum(again) > 50 * len(w):
            failed.add(d)
        else:
            groups[lang, source].append((d, vector(text), len(w)))
    found = robust_distances({g: np.array([x for _, x, _ in m]) for g, m in groups.items()}, {g: [n for _, _, n in m] for g, m in groups.items()})
    out = {d: (False, None) for d in failed}
    for g, members in groups.items():
        out |= {d: (True, r) for (d, _, _), r in zip(members, found[g])}
    return out


def expected_limit(want):
    """Log-distances taken as normal from their median and upper quartile, at one text in a thousand; chi-square at least."""
    logs = np.sort(np.floor(np.log(np.array([r for passed, r in want.values() if passed]) + 1e-9) * 256)) / 256 + 1 / 512
    middle, upper = (logs[int(np.ceil(share * len(logs))) - 1] for share in (0.5, 0.75))
    return max(22.4577, float(np.exp(middle + (upper - middle) * 3.0902323 / 0.6744898)))


def test_quality_verdicts(spark):
    """Every verdict of the registered query against the estimate in numpy."""
    want = expected_quality([(r["doc_id"], r["text"] or "", r["lang"], r["source"]) for r in table("documents")])
    limit = expected_limit(want)
    assert 22 < limit < 200
    for r in run(spark, "op3_quality_rules"):
        passed, distance = want[r["doc_id"]]
        if passed:
            assert r["distance"] == pytest.approx(distance, rel=1e-6, abs=1e-9)
        assert r["kept"] == (passed and distance <= limit)


def test_quality_outliers(spark):
    """Groups with a fifth of outliers, of which the classical estimate would be drawn away."""
    from turnloom.llm.quality_rules import judge_quality

    rng = random.Random(2)
    rows = [(i, helpers.prose(rng, rng.randrange(60, 400)), "en", f"s{i % 3}", 1) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in helpers.prose(rng, 100).split()), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(2000 + i, helpers.prose(rng, 100).upper().replace(" ", " | "), "en", "s0", 1) for i in range(8)]
    got = {r["doc_id"]: r for r in judge_quality(helpers.frame(spark, rows)).collect()}
    want = expected_quality([r[:4] for r in rows])
    limit = expected_limit(want)
    for d, (passed, distance) in want.items():
        assert passed and got[d]["distance"] == pytest.approx(distance, rel=1e-6)
        assert got[d]["kept"] == (distance <= limit) == (d < 1000)


def test_limit_follows_the_tail(spark):
    from turnloom.llm.quality_rules import LEAST_LIMIT, limit_of

    frame = lambda values: spark.createDataFrame([(float(v),) for v in values], "distance double")
    rng = np.random.default_rng(3)
    assert limit_of(frame(rng.chisquare(6, 4000))) < 40  # normal data
    heavy = np.exp(rng.normal(0, 1.5, 4000))
    assert limit_of(frame(heavy)) == pytest.approx(np.exp(1.5 * 3.0902), rel=0.2)
    # of outliers only the number counts, and it is never below the chi-square quantile
    near, far = (limit_of(frame(np.concatenate((heavy, np.full(200, x))))) for x in (300.0, 1e6))
    assert near == far < 2 * limit_of(frame(heavy))
    assert limit_of(frame([0.1] * 50)) == LEAST_LIMIT == limit_of(frame([]))


def test_chi_square():
    from turnloom.llm.quality_rules import CONSISTENCY, chi_square_beyond, chi_square_limit

    assert chi_square_limit(0.001, 6) == pytest.approx(22.4577, abs=1e-3) and chi_square_limit(0.05, 8) == pytest.approx(15.5073, abs=1e-3)
    assert chi_square_beyond(0, 6) == 1 and CONSISTENCY == pytest.approx(1.3616, abs=1e-3)


def test_mixing_query(spark):
    docs = table("documents")
    size, weight, target = collections.Counter(), {}, {}
    for r in docs:
        size[r["source"]] += len(SPACE.findall(r["text"] or ""))
    names = sorted(size)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    open_, left = set(names), sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            open_.remove(s)
            left -= target[s]
    got = run(spark, "op7_mixing")
    source = {r["doc_id"]: r["source"] for r in docs}
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s]) and r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(repr, got)) == sorted(map(repr, run(spark, "op7_mixing")))


def dealt(spark, quotas, levels, seed, group=1024):
    from turnloom.llm.mixing import shard_quotas

    table_ = np.zeros((len(quotas), 1 << levels), int)
    for r in shard_quotas(spark.createDataFrame(list(enumerate(quotas)), "rank long, quota long"), levels, seed, group).collect():
        table_[r["rank"], r["shard"]] += r["quota"]
    return table_


@pytest.mark.parametrize("group", [1, 2, 1024])
def test_mixing_tree_deals_out_all_draws(spark, group):
    quotas = [100, 7, 0, 64, 1, 30]
    found = dealt(spark, quotas, 3, 7, group)
    assert (found >= 0).all() and found.sum(1).tolist() == quotas
    assert found.sum(0).max() - found.sum(0).min() <= 1


@pytest.mark.parametrize("group", [1, 1024])
def test_mixing_tree_follows_the_hypergeometric_distribution(spark, group):
    """Variances of each source's counts over the shards of a deep tree."""
    quotas, levels = [2560, 768, 256], 8
    found = dealt(spark, quotas, levels, 7, group)
    total, n = sum(quotas), sum(quotas) >> levels
    assert (found.sum(0) == n).all()
    for k, q in enumerate(quotas):
        var = n * q / total * (1 - q / total) * (total - n) / (total - 1)
        assert 0.7 * var < found[k].var() < 1.4 * var
        assert abs(np.corrcoef(found[k, 1:], found[k, :-1])[0, 1]) < 0.25


def shards_of(rows):
    return {(r["doc_id"], d["epoch"]): d["shard"] for r in rows for d in r["draws"]}


def test_mixing_tree_reaches_the_mixture(spark, monkeypatch):
    """Every draw lies in its shard, shards come shuffled, and another tree deals otherwise while totals stay."""
    import turnloom.llm.mixing as mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    two, three = mixing.mix_sources(docs, levels=2).collect(), mixing.mix_sources(docs, levels=3)
    found, rows = shards_of(three.collect()), mixing.mixture(three).collect()
    assert len(set(found.values())) == 8 and len(set(shards_of(two).values())) == 4
    assert found != shards_of(mixing.mix_sources(docs, levels=3, seed=8).collect())
    taken = lambda rs, key: collections.Counter({k: sum(r["taken"] for r in rs if r["source"] == k) for k in {r["source"] for r in rs}})
    assert taken(two, "source") == taken(three.collect(), "source")
    assert sorted((r["doc_id"], r["draw"]["epoch"], r["draw"]["shard"]) for r in rows) == sorted((d, e, s) for (d, e), s in found.items())
    in_shard, place = collections.defaultdict(list), [r["draw"]["shard"] for r in rows]
    for r in rows:
        in_shard[r["draw"]["shard"]].append(r)
    assert sum(a != b for a, b in zip(place, place[1:])) == len(in_shard) - 1  # a shard's rows stand together
    for own in in_shard.values():
        assert [r["draw"]["at"] for r in own] == sorted(r["draw"]["at"] for r in own)
    words = [sum(r["draw"]["words"] for r in own) for own in in_shard.values()]
    assert min(words) > 0
    # more shards for a larger corpus
    monkeypatch.setattr(mixing, "SHARD_WORDS", sum(r["size"] for r in two) // 30)
    assert {d["shard"] for r in mixing.mix_sources(docs, with_text=False).collect() for d in r["draws"]} == set(range(32))


def test_mixing_many_sources_and_equal_rows(spark, monkeypatch):
    import turnloom.llm.mixing as mixing

    monkeypatch.setattr(mixing, "GROUP", 4)
    rows = [(i, f"w{i} " * (1 + i % 7), "en", f"s{i % 40:02}", 1) for i in range(400)] + [(1000, "same words here", "en", "s01", 1)] * 300
    got = mixing.mix_sources(helpers.frame(spark, rows).repartition(5)).collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == sum(d["words"] for d in r["draws"])
    assert len(got) == 700 and sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)


def test_packing_query(spark):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in run(spark, "op6_packing"):
        got[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in table("documents"):
        ids, at = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], 0
        for p in sorted(got[r["doc_id"]], key=lambda p: p["start"]):
            part = np.array(ids[at : at + p["length"]], "<u4").tobytes()
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += p["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(length for parts in sequences.values() for _, length in parts)
    assert len(sequences) <= -(-total // 4096) + 1


def test_packing_is_best_fit_decreasing():
    import bisect

    from turnloom.llm.packing import place

    rng = np.random.default_rng(1)
    for _ in range(100):
        capacity = int(rng.integers(1, 60))
        lengths = sorted(rng.integers(1, capacity + 1, int(rng.integers(0, 80))).tolist(), reverse=True)
        rooms = []
        for n in lengths:
            i = bisect.bisect_left(rooms, n)
            bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - n)
        used = collections.Counter()
        for length, _, n, first, _, each in place(dict(collections.Counter(lengths)), capacity).tolist():
            for k in range(n):
                used[first + k] += length * each
        assert sorted(capacity - u for u in used.values()) == rooms


@pytest.mark.parametrize("known", [60, 10**6])
def test_word_encoder_is_the_tokenizer(monkeypatch, known):
    import turnloom.llm.packing as packing

    monkeypatch.setattr(packing, "KNOWN", known)
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from turnloom.llm.packing import WordEncoder

    encoder = WordEncoder(TOKENIZER)
    letters = st.one_of(st.sampled_from(list("abXYZ's.,!—é\u0301ßİΣ <|>\n\t\u3000\x1c中0")), st.characters(exclude_categories=["Cs"]))

    @settings(max_examples=500, deadline=None)
    @given(st.text(alphabet=letters, max_size=40))
    def same(text):
        raw = text.encode()
        ids, per = encoder.ids(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids and per.tolist() == [len(ids)]

    same()


def test_packing_with_another_tokenizer(spark):
    """A byte-level vocabulary keeps case and white space, so texts are encoded whole."""
    from turnloom.llm.packing import by_word, pack_documents

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert by_word(TOKENIZER) and not by_word(path)
    tokenizer, texts = Tokenizer.from_file(path), {1: "Hello  World\n\n it's <|endoftext|> x", 2: "", 3: None, 4: "é中😀 " * 50}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in pack_documents(docs, path, capacity=64, with_ids=True).collect():
        got[r["doc_id"]] += [(r["start"], r["ids"])]
    for d, text in texts.items():
        assert [i for _, ids in sorted(got[d]) for i in ids] == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def links_of(rows, threshold=0.98):
    spaces, groups, n = collections.defaultdict(list), Groups([r["vec_id"] for r in rows]), collections.Counter()
    for r in rows:
        spaces[r["label"]].append((r["vec_id"], np.array(r["embedding"], float)))
    for members in spaces.values():
        x = np.stack([v for _, v in members])
        norm = np.linalg.norm(x, axis=1)
        for i, j in zip(*np.nonzero((x @ x.T) / np.outer(norm, norm) >= threshold)):
            if i != j:
                n[members[i][0]] += 1
                groups.link(members[i][0], members[j][0])
    return {r["vec_id"]: (n[r["vec_id"]], groups.root(r["vec_id"])) for r in rows}


def test_embedding_query(spark):
    want = links_of(table("embeddings"))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in run(spark, "op9_embedding_dedup")} == want


@pytest.mark.parametrize(("cell", "fan", "levels"), [(20, 4, 30), (50, 12, 30), (50, 4, 0), (50, 4, 1), (4096, 64, 30)])
def test_embedding_planted(spark, monkeypatch, cell, fan, levels):
    """Deep trees, shallow ones and none; loose groups, and one in which all are links of all."""
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "FAN", fan)
    monkeypatch.setattr(embedding_dedup, "LEVELS", levels)
    rng = np.random.default_rng(4)
    rows, tight = [], rng.normal(size=8)
    for i in range(500):
        if i >= 400:
            vector = (tight + rng.normal(size=8) * 0.01) * rng.choice([0.5, 1, 7])
        else:
            base = rng.normal(size=8) if i % 4 == 0 else rows[i - i % 4]["embedding"]
            vector = np.array(base) + rng.normal(size=8) * rng.choice([0, 0.05, 0.2])
        rows.append({"vec_id": i, "embedding": vector.tolist(), "label": int(i < 300 or i >= 400)})
    table_ = spark.createDataFrame([(r["vec_id"], r["embedding"], r["label"]) for r in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link_embeddings(table_).collect()}
    assert got == links_of(rows)


def test_license_query(spark):
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    for r in run(spark, "op10_license_scan"):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]] or ""))
        places = [(i, label) for p, label in base.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        want = (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert tuple(r[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == want
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def truth(expression, permitted):
    """A licence expression by recursive descent: (families, permitted), or None if malformed."""
    tokens = re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*", expression)
    at = 0

    def peek():
        return tokens[at].lower() if at < len(tokens) else None

    def atom():
        nonlocal at
        if peek() == "(":
            at += 1
            inside = either()
            if inside is None or peek() != ")":
                return None
            at += 1
            return inside
        if peek() in (None, ")", "or", "and", "with"):
            return None
        name = tokens[at].lower()
        at += 1
        return {name}, name in permitted

    def chain(word, part, join):
        nonlocal at
        left = part()
        while left is not None and peek() == word:
            at += 1
            right = part()
            left = None if right is None else join(left, right)
        return left

    def exempt():
        return chain("with", atom, lambda x, y: x)

    def both():
        return chain("and", exempt, lambda x, y: (x[0] | y[0], x[1] and y[1]))

    def either():
        return chain("or", both, lambda x, y: (x[0] | y[0], x[1] or y[1]))

    found = either()
    return found if at == len(tokens) else None


def test_license_expressions():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from turnloom.llm.license_scan import automaton, evaluate, parse, scan

    assert parse("MIT OR Apache-2.0 AND GPL-2.0")[0] == ["MIT", "Apache-2.0", "GPL-2.0", "and", "or"]
    assert evaluate("GPL-3.0-or-later OR MIT") == (["gpl", "mit"], True)
    assert evaluate("GPL-3.0-or-later AND MIT") == (["gpl", "mit"], False)
    assert evaluate("Apache-2.0 WITH LLVM-exception") == (["apache"], True)
    assert evaluate("(LGPL-2.1+ or (BSD-3-Clause and MIT))")[1]
    assert evaluate("MIT see the file") == (["mit"], True)
    assert evaluate("MIT and the software") == (["mit"], True) and parse("we or they") == (None, [])
    assert evaluate("none of your business") == ([], False) and not parse("none of your business")[1]
    assert evaluate("MIT, Apache-2.0") == (["apache", "mit"], True) and evaluate("MIT, GPL-3.0") == (["gpl", "mit"], False) and evaluate("MIT/GPLv3") == (["gpl", "mit"], True)
    assert evaluate("MIT AND Foo-1.0") == (["mit"], False) and evaluate("MIT AND FOO") == (["mit"], False) and evaluate("Foo-1.0") == ([], False)
    assert evaluate("LicenseRef-own OR MIT") == (["licenseref-own", "mit"], True) and evaluate("GPL-2.0 WITH Classpath-exception-2.0") == (["gpl"], False)
    for bad, names in (("", []), ("(MIT OR GPL-2.0", ["gpl", "mit"]), ("MIT)", ["mit"]), ("OR MIT", ["mit"]), ("MIT AND", ["mit"]), ("MIT OR AND Apache-2.0 or ISC", ["apache", "isc", "mit"]), ("(MIT see", ["mit"])):
        assert parse(bad)[0] is None and evaluate(bad) == (names, False)
    found = scan(b"// SPDX-License-Identifier: MIT OR GPL-2.0-only\ncode under the MIT License", automaton())
    assert found["labels"] == "gpl,mit" and found["base_labels"] == "mit" and found["permitted"] and found["expressions"] == ["MIT OR GPL-2.0-only"]

    for text, labels, permitted in (
        (b"SPDX-License-Identifier: MIT  SPDX-License-Identifier: GPL-3.0-only", "gpl,mit", False),
        (b"SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-3.0-only", "gpl,mit", False),
        (b"a SPDX-License-Identifier: Apache-2.0 and more License-Expression: MIT, ISC; the end", "apache,isc,mit", True),
        (b"# SPDX-License-Identifier:\n#  ISC\nGPL-2.0", "isc", True),
        (b"license expression: we or they", "", None),
        (b"License-Expression: none of your business", "", None),
        (b"SPDX-License-Identifier: Foo-9 SPDX-License-Identifier: MIT", "mit", False),
    ):
        got = scan(text, automaton())
        assert (got["labels"], got["permitted"], got["score"] > 0.9) == (labels, permitted, permitted is not None), text

    part = st.recursive(st.sampled_from(["mit", "gpl", "isc"]), lambda x: st.one_of(st.tuples(x, st.sampled_from(["or", "and", "with"]), x).map(" ".join), x.map(lambda e: f"({e})")), max_leaves=8)

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(part, st.lists(st.sampled_from(["mit", "gpl", "or", "and", "with", "(", ")"]), max_size=7).map(" ".join)))
    def same(expression):
        want = truth(expression, {"mit", "isc"})
        if want is not None:
            assert evaluate(expression) == (sorted(want[0]), want[1])
        elif not re.search(r"[a-z)] \(|(mit|gpl|\)) (mit|gpl)", expression):  # what prose follows is cut off
            assert parse(expression)[0] is None

    same()


def test_license_labels_and_scores():
    """Against a plain search of every phrase at every word."""
    from turnloom.llm.license_scan import BASE, BASE_WEIGHT, NOTICES, TAG_WEIGHT, automaton, evaluate, scan

    rng, machine = random.Random(15), automaton()
    pool = [*BASE, *NOTICES, "license", "the", "cc", "by", "mit", "public", "gnu", "é", "spdx license identifier none"]
    for _ in range(300):
        words, tags = [], [rng.choice(["MIT", "GPL-2.0 AND ISC", "(bsd-3-clause", "Zlib OR"]) for _ in range(rng.randrange(3))]
        for _ in range(rng.randrange(12)):
            words += rng.choice(pool).split()
        text = rng.choice([" ", "-", "\n"]).join(words) + "".join(f"\nSPDX-License-Identifier: {t}\n" for t in tags)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        at = lambda phrase: [i for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]  # noqa: B023, E731
        base, labels, unsure = [i for p in BASE for i in at(p)], {BASE[p] for p in BASE if at(p)}, 1.0
        for phrase, (label, weight) in NOTICES.items():
            labels |= {label} if at(phrase) else set()
            unsure *= (1 - weight) ** len(at(phrase))
        judged = [evaluate(t) for t in tags]
        labels |= {name for names, _ in judged for name in names}
        unsure *= (1 - BASE_WEIGHT) ** min(len(base), 16) * (1 - TAG_WEIGHT) ** len(tags)
        got = scan(text.encode(), machine)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (len(w), len(base), min(base, default=None), max(base, default=None))
        assert got["labels"] == ",".join(sorted(labels)) and got["score"] == pytest.approx(1 - unsure)
        assert got["permitted"] == (all(good for _, good in judged) if judged else None)


def test_license_tags_planted_in_running_text():
    """Every tag of a text is read, whatever stands between them, with and without line ends."""
    from turnloom.llm.license_scan import PERMITTED, automaton, family, scan

    rng, machine = random.Random(16), automaton()
    for _ in range(300):
        tags = [rng.choice(["MIT", "GPL-2.0-only", "ISC", "Apache-2.0", "MPL-2.0", "Zlib"]) for _ in range(rng.randint(1, 5))]
        gap = rng.choice([" ", "  ", "\n", " some words of prose ", " // "])
        text = gap.join(f"{rng.choice(['SPDX-License-Identifier', 'License-Expression', 'license expression'])}{rng.choice([':', ' = ', ': '])}{t}" for t in tags)
        got = scan(text.encode(), machine)
        assert set(got["labels"].split(",")) == {family(t) for t in tags} and got["expressions"] and len(got["expressions"]) == len(tags)
        assert got["permitted"] == all(family(t) in PERMITTED for t in tags)


def test_license_scan_is_linear():
    import time

    from turnloom.llm.license_scan import automaton, scan

    machine, text = automaton(), b"mit license " * 1_000_000
    began = time.process_time()
    found = scan(text, machine)
    assert (found["n_words"], found["n_base"], found["last_word"]) == (2_000_000, 1_000_000, 1_999_998)
    assert time.process_time() - began < 20


def test_chat_query(spark):
    turns = collections.defaultdict(list)
    for r in table("conversations"):
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    said = "\\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    got = {r["conv_id"]: r for r in run(spark, "op2_chat_format")}
    assert set(got) == set(turns)
    for conv, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        want = (len(rows), hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[conv][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want


def test_chat_round_trip():
    import pyarrow as pa
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from turnloom.llm.chat_format import _format, masked, parse

    text = st.text(alphabet=st.one_of(st.sampled_from(list("\\#<>/:\n turn###</turn>")), st.characters(exclude_categories=["Cs"])), max_size=30)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:\n#"]), text), min_size=1, max_size=5))
    def same(turns):
        table_ = pa.table({"conv": pa.array([1] * len(turns), pa.int64()), "role": [r for r, _ in turns], "text": [t for _, t in turns]})
        row = _format(table_).to_pylist()[0]
        assert parse(row["formatted"]) == turns
        assert masked(row["formatted"], row["loss_spans"]) == "".join(t for r, t in turns if r == "assistant")

    same()


def test_url_query(spark):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/")]
    urls = {r["page_id"]: r["url"] for r in table("pages")}
    for r in run(spark, "op1_url_filters"):
        host = path = ""
        if (url := urls[r["page_id"]]) and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.DOTALL).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(x), v, x) for v, x in rules for h, p in [x.split("/", 1)] if (host == h or host.endswith(f".{h}")) and path.startswith(f"/{p}")]
        _, verdict, rule = max(fit, default=(0, r["verdict"], None))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def spread(edges, good, bad, damping=0.85):
    """Trust and distrust as the solutions of their linear equations; edges: {(from, to): n} of numbered hosts."""
    n = len(good)
    w = np.zeros((n, n))
    for (a, b), count in edges.items():
        if a != b:
            w[a, b] += count
    along, against = w / np.maximum(w.sum(1, keepdims=True), 1), w / np.maximum(w.sum(0, keepdims=True), 1)
    return np.linalg.solve(np.eye(n) - damping * along.T, good), np.linalg.solve(np.eye(n) - damping * against, bad)


@pytest.mark.parametrize(("case", "tolerance"), [("random", 1e-4), ("pair", 1e-6), ("chain", 1e-4)])
def test_trust_solves_its_equations(spark, case, tolerance):
    from turnloom.llm.url_filters import spread_trust
    from turnloom.llm.workspace import Workspace

    rng = np.random.default_rng(6)
    edges = {
        "random": {(int(a), int(b)): int(n) for a, b, n in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.integers(1, 5, 40))},
        "pair": {(0, 3): 1, (3, 0): 2},
        "chain": {(i, i + 1): 1 for i in range(11)},
    }[case]
    good, bad = np.zeros(12), np.zeros(12)
    good[0], bad[3] = 1, 0.5
    trust, distrust = spread(edges, good, bad)
    frame = spark.createDataFrame([(f"h{a}", f"h{b}", n) for (a, b), n in edges.items()], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", 1.0, 0.0), ("h3", 0.0, 0.5)], "host string, good double, bad double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in spread_trust(Workspace(spark), frame, seeds, tolerance=tolerance).collect()}
    for i in range(12):
        assert got.get(f"h{i}", (0, 0)) == pytest.approx((trust[i], distrust[i]), abs=tolerance)


def test_linked_pages(spark):
    """End to end on pages that link to each other, most of which no rule fits."""
    from turnloom.llm.url_filters import THRESHOLD, filter_urls

    rng = random.Random(12)
    hosts = ["example.com", "bad.com", "example.net", "worse.net", *(f"h{i}.io" for i in range(16))]
    paths = {"example.com": "/en/7", "bad.com": "/en/1", "example.net": "/de/8", "worse.net": "/de/1"}
    rows, edges, pages = [], collections.Counter(), collections.defaultdict(list)
    for i in range(160):
        a = rng.randrange(len(hosts))
        host, path = hosts[a], paths.get(hosts[a], "/x") if rng.random() < 0.8 else "/other"
        links = [rng.randrange(len(hosts)) for _ in range(rng.randrange(3))] if a % 5 else []
        # hosts 4 and 5 link to blocked hosts only
        links = [rng.choice((1, 3)) for _ in range(3)] if a in (4, 5) else links
        edges.update((a, b) for b in links)
        html = "<p>" + "".join(f'<A HREF="https://{hosts[b].upper()}/p?{i}">x</a> <a href=\'/local\'>y</a>' for b in links)
        rows.append((i, f"http://{host}{path}", html))
        pages[a].append(path)
    fixed = {"example.com": ("/en/7", "allow"), "bad.com": ("/en/", "block"), "example.net": ("/de/8", "allow"), "worse.net": ("/de/", "block")}
    ruled = lambda a, path: fixed[hosts[a]][1] if hosts[a] in fixed and path.startswith(fixed[hosts[a]][0]) else None
    share = lambda a, verdict: sum(ruled(a, p) == verdict for p in pages[a]) / max(len(pages[a]), 1)
    trust, distrust = spread(edges, *(np.array([share(a, v) for a in range(len(hosts))]) for v in ("allow", "block")))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in filter_urls(frame).collect()}
    unruled = collections.Counter()
    for i, url, _ in rows:
        host, path = url[7:].split("/", 1)
        a = hosts.index(host)
        want = ruled(a, f"/{path}") or ("block" if distrust[a] - trust[a] >= THRESHOLD else "allow")
        assert (got[i]["host"], got[i]["verdict"]) == (host, want)
        assert (got[i]["trust"], got[i]["distrust"]) == pytest.approx((trust[a], distrust[a]), abs=1e-4)
        if got[i]["rule"] is None:
            unruled[want] += 1
    assert min(unruled["allow"], unruled["block"]) >= 10 and len(edges) > 40


def test_very_long_urls(spark):
    """A megabyte of host labels or of path is judged like any other URL, in seconds."""
    import time

    from turnloom.llm.url_filters import filter_urls

    urls = ["http://" + "a." * 500_000 + "com/en/x", "http://" + "b." * 500_000 + "example.net/de/8", "http://example.com/en/7" + "y" * 1_000_000, "http://" + "." * 400_000, "x" * 1_000_000]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    began = time.monotonic()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_urls(pages).select("page_id", "rule", "verdict").collect()}
    assert got == {0: ("com/en/", "block"), 1: ("example.net/de/8", "allow"), 2: ("example.com/en/7", "allow"), 3: (None, "allow"), 4: (None, "allow")}
    assert time.monotonic() - began < 60


def test_odd_urls_follow_the_rules(spark):
    """Ports, user names, dots, cases, control characters and broken URLs: rule and verdict are those of plain Python."""
    from turnloom.llm.url_filters import RULES, filter_urls

    rng = random.Random(17)
    parts = [".", "/", "?", "#", ":80", "u@", "://", "com", "net", "org", "example", "en", "de", "7", "A", "\u0130", "\U0001F600", " ", "\n", "\0", "example.com/en/7", "example.net/de/8", "Org/es/", "com/en/", "net/de/"]
    urls = [None, "", *(rng.choice(["http://", "", "x://"]) + "".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(3000))]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    fitted = 0
    for r in filter_urls(pages).collect():
        host = path = ""
        if r["url"] and "://" in r["url"]:
            host, path = re.match(r"([^/?#]*)([^?#]*)", r["url"].split("://", 1)[1]).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(x), v, x) for v, x in RULES for h, p in [x.split("/", 1)] if (host == h or host.endswith(f".{h}")) and path.startswith(f"/{p}")]
        _, verdict, rule = max(fit, default=(0, r["verdict"], None))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)
        fitted += bool(fit)
    assert fitted > 100


def test_toxicity_held_out(spark):
    from turnloom.llm.toxicity import fit_toxicity, score_toxicity

    rng = random.Random(8)
    slurs = ["grobnik", "zlatso", "vermox", "idiot"]
    rows, labels = [], []
    for i in range(900):
        text, toxic = helpers.prose(rng, rng.randrange(20, 200)), int(i % 6 == 0)
        if toxic:
            words = text.split(" ")
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(slurs))
            text = " ".join(words)
        rows.append((i, text, "en", "a", 1))
        labels.append((i, toxic))
    docs = helpers.frame(spark, rows)
    taught = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int")
    scores = {r["doc_id"]: (r["score"], r["predicted"]) for r in score_toxicity(docs, fit_toxicity(docs, taught)).collect()}
    held = [(scores[i], y) for i, y in labels if i % 5 == 0]
    assert sum(p == y for (_, p), y in held) / len(held) > 0.97


def plain_features(text, known):
    """The features of a text by plain Python; known: {word or beginning of a word: weight} of the lexicon."""
    from turnloom.llm import toxicity as X

    def worth(word):
        raw = word.encode()
        return max([known.get(raw, 0.0), *(known.get(raw[:k], 0.0) for k in X.STEMS)])

    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[a-z0-9\x80-\U0010FFFF]+", lower)
    weight = [worth(w) for w in words]
    hit = [v > 0 for v in weight]
    you = [i for i, w in enumerate(words) if w in X.SECOND_PERSON]
    near = lambda i: any(abs(i - j) <= X.NEAR for j in you)
    # look-alikes as letters; other punctuation inside words dropped
    leet = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
    plain = "".join(leet.get(c, c) if c in leet or not (0x21 <= ord(c) < 0x7F and not c.isalnum()) else "" for c in lower)
    spelled = [w for w in re.split(r"[\x20\x09-\x0D]+", plain) if w]
    hits, hidden = sum(hit), max(sum(worth(w) > 0 for w in spelled) - sum(hit), 0)
    top = sorted((worth(w) for w in set(words)), reverse=True)[:3] + [0.0] * 3
    shown = max([worth(w) for w in spelled], default=0.0)
    n, size = max(len(words), 1), max(len(text.encode()), 1)
    count = lambda p: len(re.findall(p, text))
    loose = sum(0x21 <= ord(c) < 0x7F and not c.isalnum() for c in text)
    return [
        *top[:3], sum(w in X.SEEDS for w in words) / n, min(hits, 50), hits / n, max((sum(hit[i : i + 50]) for i in range(len(words)) if hit[i]), default=0), sum(weight) / n,
        sum(h and near(i) for i, h in enumerate(hit)) / n, len(you) / n, min(hidden, 50), max(shown - top[0], 0.0), count("[A-Z]") / size, count("!") / n, loose / n, count("[0-9]") / size,
        max(len(words) - len(spelled), 0) / n, np.log1p(len(words)),
    ]


def test_toxicity_features():
    import pyarrow as pa

    from turnloom.llm import toxicity as X

    rng, known = random.Random(31), {b"grob": 1.5, b"idiot": 2.0, b"zlat": 0.7, b"verme": 0.4, "é中".encode(): 1.1}
    pool = ["grob", "idiot", "zlat", "Vermenoid", "vermes", "verm", "é中x", "Idiot!", "1d10t", "gr0b", "g.rob", "z|at", "you", "your", "tu", "plain", "É", "中😀", "42", "A-B", "moron", "\n", "--", "$"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(200))) for _ in range(150)] + ["", " "]
    hashes = {int(X.hashes_of([w.decode()])[0]): v for w, v in known.items()}
    lexicon = (np.array(sorted(hashes), np.uint64), np.array([hashes[k] for k in sorted(hashes)]))
    got = X.features(pa.RecordBatch.from_pydict({"text": texts}), "text", lexicon)
    for name, column, want in zip(X.FEATURES, got.T, np.array([plain_features(t, known) for t in texts]).T, strict=True):
        assert column == pytest.approx(want), name


def test_boosted_trees():
    """Every cut has the largest gain of all cuts, and every leaf the step that belongs to its rows."""
    from turnloom.llm.boosting import fit_trees

    rng, depth, rate, smooth, least = np.random.default_rng(32), 2, 0.3, 5.0, 5
    for _ in range(4):
        x = np.round(rng.normal(size=(80, 3)), 1)
        y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=80) * 0.3 > 0).astype(float)
        trees = fit_trees(x, y, rounds=6, depth=depth, rate=rate, bins=10**6, smooth=smooth, least=least)
        score = np.full(len(y), np.log((y.sum() + 0.5) / (len(y) + 0.5 - y.sum())))
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            worth = lambda *parts: sum(g[s].sum() ** 2 / (h[s].sum() + smooth) for s in parts)  # noqa: B023, E731
            rows = {0: np.arange(len(y))}
            for node in range(2**depth - 1):
                own = rows[node]
                best = worth(own)
                for j in range(x.shape[1]):
                    for c in np.unique(x[:, j]):
                        left, right = own[x[own, j] <= c], own[x[own, j] > c]
                        if min(len(left), len(right)) >= least:
                            best = max(best, worth(left, right))
                right = x[own, feature[node]] > cut[node]
                rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
                assert worth(own[~right], own[right]) == pytest.approx(best)
                assert not right.any() or min(right.sum(), (~right).sum()) >= least
            for k, value in enumerate(leaf):
                own = rows[2**depth - 1 + k]
                assert value == pytest.approx(-rate * g[own].sum() / (h[own].sum() + smooth))
                score[own] += value
        assert trees.raw(x) == pytest.approx(score)


def test_isotonic_calibration():
    from turnloom.llm.boosting import calibrated, isotonic

    rng = np.random.default_rng(33)
    for _ in range(30):
        raw = np.round(rng.normal(size=40), 1)
        y = (rng.random(40) < 1 / (1 + np.exp(-2 * raw))).astype(int)
        at, level = isotonic(raw, y)
        # the least-squares non-decreasing fit at v: the largest over starts of the smallest mean over ends
        values = np.unique(raw)
        mean = lambda a, b: y[(raw >= a) & (raw <= b)].mean()  # noqa: B023, E731
        fit = np.array([max(min(mean(a, b) for b in values if b >= v) for a in values if a <= v) for v in values])
        assert sorted(set(np.round(level, 9))) == sorted(set(np.round(fit, 9)))
        for m, f in zip(at, level):
            assert m == pytest.approx(np.repeat(values, [sum(raw == v) for v in values])[np.repeat(np.isclose(fit, f), [sum(raw == v) for v in values])].mean())
        scores = calibrated(np.sort(rng.normal(size=50)), (at, level))
        assert (np.diff(scores) > 0).all() and scores.min() >= 0 and scores.max() <= 1


def test_toxicity_scores_are_features_trees_and_calibration(spark):
    """A fitted model's scores from plain features; the lexicon from plain counts; odd rows do not reach what they should not."""
    from turnloom.llm import boosting
    from turnloom.llm import toxicity as X

    rng, rows, labels = random.Random(34), [], []
    for i in range(1200):
        words = helpers.prose(rng, rng.randrange(5, 60)).split(" ")
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "zlatso", "vermox"]))
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, toxic))
    docs = helpers.frame(spark, rows + [(5000, None, "en", "a", 1), (5001, "", None, None, None)])
    model = X.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    # every entry's weight from plain counts of all texts
    def entries(text):
        words = {w.encode() for w in re.findall(r"[a-z0-9]+", text.lower())}
        return words | {w[:k] for w in words for k in X.STEMS}

    said = [(entries(r[1]), y) for r, (_, y) in zip(rows, labels, strict=True)]
    bad, good = (Counter(e for found, y in said for e in found if y == kind) for kind in (1, 0))
    all_bad, all_good = sum(y for _, y in said), sum(1 - y for _, y in said)
    rate, known = (all_bad + 0.5) / (all_bad + all_good + 1), {}
    for e in {*bad, *good, *(w.encode() for w in X.SEEDS)}:
        b, g, seed = bad[e] + X.SEED_TEXTS * (e.decode() in X.SEEDS), good[e], e.decode() in X.SEEDS
        ratio = np.log((b + 0.5) / (all_bad + 1)) - np.log((g + 0.5) / (all_good + 1))
        weight = np.log((b + X.PRIOR * rate) / (g + X.PRIOR * (1 - rate))) - np.log(rate / (1 - rate))
        if weight > 0 and (seed or ratio >= X.SURE * np.sqrt(1 / (b + 0.5) + 1 / (g + 0.5))):
            known[e] = weight
    fitted = {int(h): v for h, v in zip(*model.lexicon, strict=True)}
    assert model.trees is not None and {int(X.hashes_of([e.decode()])[0]): pytest.approx(v) for e, v in known.items()} == fitted
    lexicon = known
    got = {r["doc_id"]: r for r in X.score_toxicity(docs, model).collect()}
    x = np.array([plain_features(r[1] or "", lexicon) for r in rows] + [plain_features("", lexicon)])
    want = boosting.calibrated(model.trees.raw(x), model.knots)
    for r, score in zip(rows, want):
        assert got[r[0]]["score"] == pytest.approx(score) and got[r[0]]["predicted"] == int(score >= 0.7)
    assert got[5000]["score"] == got[5001]["score"] == pytest.approx(want[-1])


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_toxicity_finds_more_than_the_seed_list(spark, size):
    """Held out of training on the given tables: no fewer toxic texts than the seed list finds, and hardly a false alarm."""
    import zlib

    from turnloom.llm import toxicity as X

    data = f"/root/testdata/{size}"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    from turnloom.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op4_toxicity"](spark, data).collect()}
    held = [(r["doc_id"], r["toxic"], r["text"] or "") for r in docs.join(labels, "doc_id").collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i, _, _ in held)
    seeded = {i for i, _, text in held if set(re.findall(r"[a-z]+", text.lower())) & set(X.SEEDS)}
    found = {i for i, y, _ in held if y and got[i]["predicted"]}
    assert len(found) >= sum(y for i, y, _ in held if i in seeded) > 0
    assert sum(got[i]["predicted"] for i, y, _ in held if not y) <= 0.01 * len(held)


def test_components(spark, monkeypatch):
    import turnloom.llm.components as components
    from turnloom.llm.workspace import Workspace

    monkeypatch.setattr(components, "TASK_LINKS", 20)
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    groups = Groups(range(400))
    for a, b in links:
        groups.link(a, b)
    ws = Workspace(spark)
    table_ = ws.keep(spark.createDataFrame(links, "a long, b long").repartition(7), "links")
    got = {r["node"]: r["component"] for r in components.components(ws, table_).collect()}
    assert got == {x: groups.root(x) for pair in links for x in pair if pair[0] != pair[1]}



def test_long_conversations_take_a_few_times_their_size():
    """Pieces of any size give the same bytes; 40 MB of text need a small multiple of it."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np, pyarrow as pa
from turnloom.llm import chat_format
texts = ["a#b<é\\\\\\\\" * 1_000_000] * 5
batch = pa.RecordBatch.from_pydict({"conv": pa.array([1] * 5, pa.int64()), "role": ["assistant"] * 5, "text": texts})
size = sum(len(t.encode()) for t in texts)
del texts
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = list(chat_format._conversations(iter([batch])))
peak = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024
assert len(rows) == 1 and rows[0].num_rows == 1
print(size, peak, len(rows[0].column("formatted")[0].as_buffer()))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=ROOT)
    assert done.returncode == 0, done.stderr
    size, peak, formatted = map(int, done.stdout.split())
    assert formatted > 1.3 * size and peak < 7 * size


def test_slices_do_not_change_the_format(monkeypatch):
    import pyarrow as pa

    import turnloom.llm.chat_format as chat_format

    rng = random.Random(16)
    rows = [(i // 3, rng.choice(["user", "assistant", "a:#"]), "".join(rng.choice("a#é<\\😀\n") for _ in range(rng.randrange(40)))) for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"conv": pa.array([r[0] for r in rows], pa.int64()), "role": [r[1] for r in rows], "text": [r[2] for r in rows]})

    def formatted(parts):
        return [r for b in chat_format._conversations(iter(parts)) for r in b.to_pylist()]

    whole = formatted([batch])
    monkeypatch.setattr(chat_format, "SLICE", 7)
    assert formatted([batch.slice(i, 5) for i in range(0, 200, 5)]) == whole
    for row in whole:
        own = [(r, t) for c, r, t in rows if c == row["conv"]]
        assert chat_format.parse(row["formatted"]) == own
        assert chat_format.masked(row["formatted"], row["loss_spans"]) == "".join(t for r, t in own if r == "assistant")
    monkeypatch.setattr(chat_format, "MOST", 10)
    with pytest.raises(ValueError, match="more than 10 bytes"):
        formatted([batch])
