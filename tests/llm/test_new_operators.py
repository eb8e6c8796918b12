"""Periodic runs, importance resampling and HTML extraction against plain Python, and on odd rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers
from turnloom.llm.html_text import extract_text, read_page
from turnloom.llm.importance import Tournament, draw, merged, resample
from turnloom.llm.periodic_runs import find_runs, lags_of, repeat_tails, run_digests, runs_of
from turnloom.llm.queries import QUERIES
from turnloom.llm.workspace import Workspace

DATA = "/root/testdata/sf0.001"

# ---------------------------------------------------------------- periodic runs


def slow_runs(words):
    """Every lag and every stretch, smallest periods by trial."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q) and all(any(words[t] != words[t + d] for t in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


def planted_words(rng):
    words = []
    for _ in range(rng.randint(1, 6)):
        kinds, period = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 16, 17, 24, 31, 32, 40])
        base = [rng.randrange(kinds) for _ in range(period)]
        if rng.random() < 0.3:
            base = base * 2 + [rng.randrange(kinds)]
        words += base * rng.choice([0, 1, 2, 3, 3, 4, 7]) + base[: rng.randint(0, period)]
    return words


def test_runs_of_planted_periods():
    rng, found = random.Random(5), 0
    for _ in range(800):
        words = planted_words(rng)
        expected = slow_runs(words)
        assert runs_of(np.array(words, np.int64)) == expected
        found += len(expected)
    assert found > 800


def test_lags_stay_few_and_long_texts_end():
    a, b = [0], [0, 1]
    while len(b) < 100_000:
        a, b = b, b + a
    started = time.monotonic()
    assert len(lags_of(np.array(b))) < 60 and runs_of(np.array(b))
    assert runs_of(np.random.default_rng(1).integers(0, 30_000, 400_000)) == []
    assert runs_of(np.tile(np.arange(1000), 300)) == [(0, 300_000, 1000)]
    assert time.monotonic() - started < 60


def slow_digest(doc_id, text, tails=True):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if tails and h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    milli = None if best[0] is None else math.floor(Fraction(1000 * best[1], best[2]))
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_query_against_plain_python(spark):
    docs = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect() if len((r["text"] or "").split()) < 1200]
    rng = random.Random(8)
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(100_000 + i, "\t ".join(f"w{w}" for w in planted_words(rng))) for i in range(120)]
    frame = spark.createDataFrame(rows + rows[-2:] + [(None, "a b " * 40), (10, None), (11, "")], "doc_id long, text string")
    got = sorted((tuple(r) for r in run_digests(find_runs(repeat_tails(frame), keep_text=False)).collect()), key=repr)
    assert got == sorted((slow_digest(*r) for r in frame.collect()), key=repr)
    assert sum(r[1] > 0 for r in got) > 60
    ours = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    assert all(ours[r["doc_id"]] == slow_digest(r["doc_id"], r["text"]) for r in docs)


# ---------------------------------------------------------------- importance resampling


def test_tournament_merges_blocks_in_order():
    rng = random.Random(2)
    for _ in range(200):
        runs = [sorted((rng.randrange(30), rng.randrange(5), rng.randrange(10**6)) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 9))]
        blocks = [run[i : i + 7] for run in runs for i in range(0, len(run), 7)]
        whole = sorted(row for run in runs for row in run)
        most = rng.randint(1, len(whole) + 3)
        assert list(merged(iter(sorted(blocks, key=lambda b: b[0])), most)) == whole[:most]
    tree = Tournament()
    leaf = tree.add((3,))
    tree.add((1,))
    assert tree.winner[1] == (1,)
    tree.replace(tree.winner[0], None)
    assert tree.winner == (leaf, (3,))


def test_draw_over_many_ranges_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.choice([5, 5, 5, rng.randrange(1000)]), rng.choice([None, 7, rng.randrange(400)]), rng.random() < 0.8) for _ in range(5000)]
    ws = Workspace(spark)
    table = ws.keep(spark.createDataFrame(rows, "score long, doc_id long, tl_eligible boolean").repartition(7).withColumn("tl_uid", F.monotonically_increasing_id()), "rows")
    all_rows = [r for r in table.collect() if r["tl_eligible"]]
    order = sorted(all_rows, key=lambda r: (-r["score"], 2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["tl_uid"]))
    for take in (1, 700, 3100, len(order)):
        got = {r["tl_uid"]: r["rank"] for r in draw(table, lambda n: take, range_rows=100, block_rows=16).collect()}
        assert got == {r["tl_uid"]: i + 1 for i, r in enumerate(order[:take])}
    assert draw(table, lambda n: 0).collect() == []
    ws.close()


def slow_resample(docs, target, percent, least, runs=1, buckets=10_000):
    lower = lambda t: re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    features = lambda t: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for w in [words(t)] for k in range(1, runs + 1) for i in range(len(w) - k + 1)]
    s, t = Counter(b for _, text in docs for b in features(text)), Counter(b for text in target for b in features(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, (doc_id, text) in enumerate(docs):
        f = features(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least, i])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], 2**63 if r[0] is None else r[0], r[6]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = rank + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("runs", [1, 3])
def test_resampling_against_plain_python(spark, runs):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()] + [r[:2] for r in helpers.odd_documents()[:8]] + [(3, "x y " * 30)] * 3
    target = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()] + [None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), keep_text=False, percent=30, most_words=runs)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in out.collect()), key=repr)
    assert got == slow_resample(docs, target, 30, 20, runs)


# ---------------------------------------------------------------- html


def page(body, head="<title>T</title><script>var a='<p>no</p>';</script><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def texts(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in extract_text(frame).collect()}


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_named_parts_are_left_out(spark):
    body = (
        "<header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></ul></nav><div class='cookie-banner'>We use cookies</div><aside>Side</aside>"
        "<main class='has-sidebar'><article><header><h1>Head &amp; &eacute;&#233;&nbsp; more</h1></header><p><b>One.<br><p>Two\n\t three <a href=x>link</a>.<ul><li>first<li>second</ul>"
        "<!-- <p>hidden</p> --><div class=\"ad\">Buy</div><blockquote>quoted <em>words</em></blockquote><table><tr><td>c1<td>c2</table><form><label>Name</label><input></form>"
        "<section id=comments><p>Nice post!</p></section></article></main><div id='reader-comments'><div class=comment>Mine</div></div><footer>&copy; me</footer>"
    )
    assert texts(spark, [(1, "http://h/x", page(body))])[1] == "Head & éé more\nOne.\nTwo three link.\nfirst\nsecond\nquoted words\nc1\nc2"


def test_templates_without_names(spark):
    """A host whose elements have no telling names: menus, notices and comments go by vectors and shares of text."""
    rng, rows, expected = random.Random(4), [], {}
    for i in range(14):
        paragraphs = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 5))]
        remarks = "".join(f"<div class=q><p>{words(rng, 6)}</p></div>" for _ in range(rng.randint(0, 3)))
        main = "".join(f"<p>{p}</p>" for p in paragraphs)
        body = f"<div class=a><a href=/1>Home</a> <a href=/2>News</a></div><div class=b><h2>{paragraphs[0][:20]}</h2>{main}<p>Thank you for reading</p></div><div class=c>{remarks}</div><div class=d>Made by us</div>"
        rows.append((i, f"https://plain.example/{i}", page(body)))
        expected[i] = "\n".join([paragraphs[0][:20].strip(), *paragraphs])
    assert texts(spark, rows) == expected


def test_copies_short_hosts_and_broken_pages(spark):
    same = page("<nav>menu</nav><article><h1>Title</h1><p>Text that all pages have.</p></article>")
    rows = [(i, "http://copies.example/", same) for i in range(15)]
    rows += [(20, None, same), (21, "no host", page("<div><p>alone</p></div>")), (22, "http://x/", None), (23, "http://x/", ""), (24, "http://x/", "plain &lt;text&gt; only"), (25, "http://x/", "<p>cut <b>off <a href='")]
    got = texts(spark, rows)
    assert {got[i] for i in range(15)} == {got[20]} == {"Title\nText that all pages have."}
    assert (got[21], got[22], got[23], got[24], got[25]) == ("alone", "", "", "plain <text> only", "cut off")
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_clashing_columns_and_repeated_pages(spark):
    rows = [(1, "http://h/", page("<article>x</article>"), "mine", "mine", "mine")] * 2
    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string, tokens string"), keep_html=False)
    assert [(r["page_id"], r["host"], r["tokens"], r["text"], r["n_chars"]) for r in out.collect()] == [(1, "mine", "mine", "x", 1)] * 2


@pytest.mark.parametrize("part", ["<div>", "<a ", "<!--", "<p class='", "</div>", "&amp", "<script>", "<b \"' "])
def test_hostile_pages_end(part):
    for html in (part * 60_000, part * 60_000 + ">", "<div>" * 60_000 + part * 60_000 + "x>"):
        started = time.monotonic()
        read_page(html)
        assert time.monotonic() - started < 10
