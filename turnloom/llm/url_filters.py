"""URL filters: host and path rules, and trust spread over the link graph of hosts.

Method: a URL is judged by the longest rule that fits it. Where none does, its
host decides: personalised PageRank spreads trust from hosts with allowed pages
along links, and distrust from hosts with blocked pages against the links (a
page is answerable for what it links to). Seeds are the shares of a host's
pages that rules allow or block. A host is blocked where distrust exceeds trust
by THRESHOLD of a full seed.

Scores are worked out to TOLERANCE: what is sent in a round is at most DAMPING
times what was sent in the round before, so the sum of what is still missing is
known, and so is the number of rounds that suffices. Trust that reaches a host
without links to others ends there; giving it back to the seeds, as is usual,
would only multiply all trust by one number. The same holds for distrust at
hosts that nobody links to.

Scale: links are cut to (from, to, count) per task before the shuffle; each
round sends only the last round's changes, in one join with the links and one
sum per host, and is written to the shared folder; nothing is collected but two
numbers per round. Joins by host can be split where a host has a third of the
pages or links, sums are partial first.

Defined cases: null URLs and URLs without `://` have empty host and path, which
no rule fits; null html has no links; links of a host to itself and links
without a host say nothing; repeated pages count as often as they occur; with
no links only a host's own pages speak for it; very long pages are searched for
links from end to end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.columns import ROW, boxed, unboxed, without
from turnloom.llm.workspace import Workspace

DAMPING = 0.85
TOLERANCE = 1e-4
THRESHOLD = 0.5
#: (verdict, host and path), fixed values.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("block", "net/de/"),
    ("allow", "example.net/de/8"),
    ("block", "org/es/"),
)
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]*)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): of each host, the rules of it and its parents, longest first.

    rules: rule (host, then path from its first slash on) and verdict.
    """
    parts = rules.select("rule", "verdict", F.regexp_extract("rule", r"^([^/]*)", 1).alias("suffix"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("path"))
    # a rule's host has no more labels than the longest one, so longer ends of a host fit none
    most = rules.agg(F.max(F.size(F.split(F.regexp_extract("rule", r"^([^/]*)", 1), r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    if not most:
        suffixes = F.array().cast("array<string>")
    fits = hosts.select("host", F.explode(suffixes).alias("suffix")).join(parts, "suffix")
    ordered = F.array_sort(F.collect_list(F.struct((-F.length("rule")).alias("order"), "rule", "path", "verdict")))
    return fits.groupBy("host").agg(ordered.alias("rules"))


def spread_trust(ws: Workspace, edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) for every host of seeds, and every other that some reaches.

    edges: src, dst, n; seeds: host, good, bad. trust solves
    trust = good + damping * (what comes along links), distrust the same with
    bad and reversed links; a host without links keeps its seeds. All errors of
    trust add up to `tolerance` at most, and so do those of distrust.
    """
    seeds = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    edges = ws.keep(edges.where("src != dst"), "edges")
    if edges.isEmpty():
        return seeds
    out, into = edges.groupBy("src").agg(F.sum("n").alias("out")), edges.groupBy("dst").agg(F.sum("n").alias("into"))
    shares = edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("along"), (F.col("n") / F.col("into")).alias("against"))
    # one row for each way that something is sent: trust from src to dst, distrust from dst to src
    ways = F.array(F.struct(F.col("src").alias("sender"), F.col("dst").alias("host"), F.col("along").alias("t"), F.lit(0.0).alias("d")), F.struct(F.col("dst").alias("sender"), F.col("src").alias("host"), F.lit(0.0).alias("t"), F.col("against").alias("d")))
    was, ways = edges, ws.keep(shares.select(F.inline(ways)), "ways")
    ws.drop(was)
    scores = ws.keep(seeds.select("*", F.col("trust").alias("new_trust"), F.col("distrust").alias("new_distrust")), "scores")
    sums = [F.sum(c).alias(c) for c in scores.columns[1:]]
    sent = lambda: max(scores.agg(F.sum("new_trust").alias("t"), F.sum("new_distrust").alias("d")).first(), key=lambda x: x or 0.0) or 0.0
    mass = sent()
    # after k rounds at most mass * damping**(k+1) / (1 - damping) is missing; one round more for rounding
    rounds = max(0, math.ceil(math.log(tolerance * (1 - damping) / (mass * damping)) / math.log(damping))) + 1 if mass else 0
    for _ in range(rounds):
        if mass * damping / (1 - damping) <= tolerance:
            break
        active = scores.where("new_trust > 0 or new_distrust > 0").select(F.col("host").alias("sender"), "new_trust", "new_distrust")
        heard = ways.join(active, "sender").select("host", (damping * F.col("t") * F.col("new_trust")).alias("trust"), (damping * F.col("d") * F.col("new_distrust")).alias("distrust"))
        known = scores.select("host", "trust", "distrust", F.lit(0.0).alias("new_trust"), F.lit(0.0).alias("new_distrust"))
        new = known.unionByName(heard.select("*", F.col("trust").alias("new_trust"), F.col("distrust").alias("new_distrust")))
        was, scores = scores, ws.keep(new.groupBy("host").agg(*sums), "scores")
        ws.drop(was)
        mass = sent()
    if mass * damping / (1 - damping) > tolerance:
        raise RuntimeError(f"trust is not settled after {rounds} rounds: up to {mass * damping / (1 - damping):g} is missing")
    return scores.select("host", "trust", "distrust")


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, url: str = "url", html: str = "html", keep_html: bool = True, workspace: Workspace | None = None) -> DataFrame:
    """The rows with host, path, rule, verdict, trust and distrust."""
    spark = pages.sparkSession
    ws = workspace or Workspace(spark)
    rows = without(pages, "host", "path", "rule", "verdict", "trust", "distrust")
    if rules is None:
        rules = spark.createDataFrame(RULES, "verdict string, rule string").select("rule", "verdict")
    carried = [c for c in rows.columns if keep_html or c != html]
    parts = boxed(rows, carried, host=host_of(F.col(url)), path=path_of(F.col(url)))
    of_host = ws.keep(host_rules(parts.select("host").distinct(), rules), "rules")
    fitting = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    ruled = parts.join(of_host, "host", "left").withColumn("fit", fitting).select(ROW, "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))
    ruled = ws.keep(ruled, "ruled")
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = ruled.groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    links = rows.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src != '' and dst != ''")
    scores = spread_trust(ws, links.groupBy("src", "dst").agg(F.count("*").alias("n")), seeds)
    judged = ruled.join(scores, "host", "left")
    method = F.when(F.col("distrust") - F.col("trust") >= THRESHOLD, "block").otherwise("allow")
    return judged.select(*unboxed(carried), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
