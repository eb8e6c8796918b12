"""Mixing of sources to target weights, with DataFrame and SQL functions only.

Method: every source's documents fall, by a hash, into blocks of about equal
size. A source with target t and size s gives floor(t / s) whole passes over
its blocks and, for the rest, blocks in a permuted order until the target is
met; the last block is taken in part, and the last document of it is cut. These
block draws are exact quotas per source. A binary splitting tree deals them out
to output shards: at each node half of all draws go left, and how many of each
source do follows the multivariate hypergeometric distribution, drawn one by
one without replacement. A shard then gets the next draws of the source's
permuted list, so draws are disjoint; mixture() gathers each shard's documents
and shuffles them inside it.

All randomness is hashes of a seed with ids and texts, so reruns agree.

Targets: sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share
the total of all sizes; a target stops at three times its source's size, and
the excess goes to the others by weight. Sorted by cap per weight the stopped
sources are a prefix, so one ordered pass over the sources finds the level.

Scale: texts are read once to count words; all else works on ids and numbers.
The number of shards grows with the corpus (SHARD_WORDS words each), that of
blocks with it (SHARD_BLOCKS for a shard), so a source with a third of all rows
has a third of the blocks. Only sums per block are shuffled, pre-aggregated.
Sources are ranked and summed up in ranges, not in one task. The tree works on
totals of GROUP sources, then inside each such group, so no row holds all
sources. Rows are put in order only where a source's last block is cut: first
hashes and tasks by their sums, then the rows of one document in one task.

Defined cases: null text and texts without words have size 0 and are never
taken; null source is a source of its own, last in order; repeated rows are
taken as separate rows; very long texts are counted and cut like others; with
no words at all every target is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.llm.columns import boxed, text_of, unboxed, without
from turnloom.llm.workspace import Workspace

SEED = 7
MOST = 3
WEIGHTS = 3
#: Words that a shard should hold, levels of the tree at least, and blocks that a shard should get.
SHARD_WORDS = 1 << 26
LEAST_LEVELS = 3
SHARD_BLOCKS = 16
#: Parts of a block in which its cut is searched for.
SUBBLOCKS = 1024
#: Sources whose quotas stand in one row.
GROUP = 1024
WORD = r"[^\x20\x09-\x0D]+"


def _running(ws: Workspace, rows: DataFrame, name: str, order: list, sums: dict) -> DataFrame:
    """Adds `nth` from 0 in the given order, and for each of sums the total of the rows before.

    Rows are sorted in ranges; only one row of totals per range is ordered globally.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("tl_id", F.monotonically_increasing_id())
    placed = ws.keep(placed, name).withColumn("tl_part", F.shiftright("tl_id", 33))
    sums = {"nth": F.lit(1)} | sums
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy("tl_part").agg(*(F.sum(c).alias(f"tl_{n}") for n, c in sums.items()))
    parts = parts.select("tl_part", *(before(Window.orderBy("tl_part"), f"tl_{n}").alias(f"tl_{n}") for n in sums))
    inside = Window.partitionBy("tl_part").orderBy("tl_id")
    return placed.join(parts, "tl_part").select(*rows.columns, *((F.col(f"tl_{n}") + before(inside, c)).alias(n) for n, c in sums.items()))


def _targets(ws: Workspace, sizes: DataFrame) -> DataFrame:
    """sizes: source, source_size. Adds rank (from 0) and target."""
    ranked = _running(ws, sizes, "names", [F.col("source").asc_nulls_last()], {}).withColumnRenamed("nth", "rank").withColumn("weight", F.col("rank") % WEIGHTS + 1)
    ranked = ws.keep(ranked, "sources")
    whole = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    cap = (MOST * F.col("source_size")).cast("double")
    level = _running(ws, ranked.withColumn("fullness", cap / F.col("weight")), "fullness", ["fullness", "rank"], {"words_before": F.col("source_size"), "weights_before": F.col("weight")})
    share = (F.lit(whole["words"] or 0) - MOST * F.col("words_before")) / (F.lit(whole["weights"] or 0) - F.col("weights_before"))
    level = ws.keep(level.withColumn("share", share).withColumn("stopped", F.col("share") * F.col("weight") > cap), "levels")
    open_share = level.where("not stopped").agg(F.max("share").alias("share")).first()["share"]
    target = F.when(F.col("stopped"), cap).otherwise(F.least(cap, F.lit(open_share).cast("double") * F.col("weight")))
    return level.select("source", "rank", "source_size", target.alias("target"))


#: How many of each source's draws go left at a node, where `n` of all of them do; one draw after the other.
_SPLIT = """
aggregate(quotas,
  named_struct('n', n, 'all', aggregate(quotas, 0L, (t, q) -> t + q.quota), 'got', cast(array() as array<bigint>)),
  (s, q) -> named_struct(
    'n', s.n - {draw}.got, 'all', s.all - q.quota, 'got', concat(s.got, array({draw}.got))),
  s -> s.got)
"""
#: Draws of one source without replacement: each goes left with the chance that is left.
_DRAW = """
aggregate(if(q.quota = 0, cast(array() as array<bigint>), sequence(1L, q.quota)),
  named_struct('n', s.n, 'all', s.all, 'got', 0L),
  (d, i) -> if((pmod(xxhash64({seed}L, node, {tag}, q.rank, i), 1000000007L) + 0.5D) / 1000000007D < d.n / d.all,
    named_struct('n', d.n - 1, 'all', d.all - 1, 'got', d.got + 1),
    named_struct('n', d.n, 'all', d.all - 1, 'got', d.got)))
"""


def _level(nodes: DataFrame, seed: int, tag: str, carried: list[str], halves: tuple[str, str] | None = None) -> DataFrame:
    """Both children of each node: node, quotas and, where halves are given, what each child keeps of `leaves`."""
    split = _SPLIT.format(draw=_DRAW.format(seed=seed, tag=tag))
    side = "filter(transform(quotas, (q, i) -> named_struct('rank', q.rank, 'quota', {})), q -> q.quota > 0)"
    nodes = nodes.withColumn("to_left", F.expr(split))
    children = []
    for k, quota in enumerate(("to_left[i]", "q.quota - to_left[i]")):
        fields = [(2 * F.col("node") + k).alias("node"), F.expr(side.format(quota)).alias("quotas")]
        if halves:
            fields.append(F.expr(halves[k]).alias("leaves"))
        children.append(F.struct(*fields))
    return nodes.select(*carried, F.explode(F.array(*children)).alias("child")).select(*carried, "child.*")


def shard_quotas(quotas: DataFrame, levels: int, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(rank, shard, quota) from (rank, quota), by the splitting tree; 2**levels shards.

    First the tree splits the totals of groups of sources; inside a group it
    splits the sources' quotas, its nodes' sizes being those of the first tree.
    """
    pair = F.struct(F.col("rank").cast("long").alias("rank"), F.col("quota").cast("long").alias("quota"))
    by_group = quotas.withColumn("part", F.floor(F.col("rank") / group).cast("long"))
    inside = by_group.groupBy("part").agg(F.array_sort(F.collect_list(pair)).alias("quotas"))
    tops = by_group.groupBy("part").agg(F.sum("quota").alias("quota"))
    nodes = tops.agg(F.array_sort(F.collect_list(F.struct(F.col("part").alias("rank"), F.col("quota").cast("long").alias("quota")))).alias("quotas")).withColumn("node", F.lit(1).cast("long"))
    for _ in range(levels):
        nodes = _level(nodes.withColumn("n", F.expr("aggregate(quotas, 0L, (t, q) -> t + q.quota) div 2")), seed, "-1L", [])
    shard = (F.col("node") - (1 << levels)).cast("int")
    leaves = nodes.select(shard.alias("shard"), F.explode("quotas").alias("q")).groupBy(F.col("q.rank").alias("part"))
    # a group's draws in each shard, shards without any included
    leaves = leaves.agg(F.map_from_entries(F.collect_list(F.struct("shard", "q.quota"))).alias("m")).select("part", F.expr(f"transform(sequence(0, {(1 << levels) - 1}), i -> coalesce(m[i], 0L))").alias("leaves"))
    nodes = inside.join(leaves, "part").withColumn("node", F.lit(1).cast("long"))
    halves = ("slice(leaves, 1, size(leaves) div 2)", "slice(leaves, size(leaves) div 2 + 1, size(leaves) div 2)")
    for _ in range(levels):
        left = F.expr(f"aggregate({halves[0]}, 0L, (t, x) -> t + x)")
        nodes = _level(nodes.withColumn("n", left), seed, "part", ["part"], halves).where("size(quotas) > 0")
    return nodes.select(shard.alias("shard"), F.explode("quotas").alias("q")).select("q.rank", "shard", "q.quota")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, levels: int | None = None, with_text: bool = True, workspace: Workspace | None = None) -> DataFrame:
    """The rows with size, source_size, target, taken and draws.

    draws: array of (epoch, shard, at, words); a draw with fewer words than
    size is the text's first words. `at` is a draw's place when its shard is
    shuffled. levels: of the splitting tree; by default as many as the corpus needs.
    """
    text_of(docs, text)
    ws = workspace or Workspace(docs.sparkSession)
    rows = without(docs, "size", "source_size", "target", "taken", "draws")
    carried = [c for c in rows.columns if with_text or c != text]
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    h = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    sized = boxed(rows, carried, size=size, h=h, origin=F.col(source)).withColumn("line", F.monotonically_increasing_id())
    sized = ws.keep(sized, "sized", "zstd" if with_text else "snappy")

    sizes = ws.keep(sized.groupBy(F.col("origin").alias("source")).agg(F.sum("size").alias("source_size")), "sizes")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    if levels is None:
        levels = max(LEAST_LEVELS, math.ceil(math.log2(max(total, 1) / SHARD_WORDS)))
    block_words = max(1.0, total / (SHARD_BLOCKS << levels))
    wanted = F.least(F.round("target").cast("long"), MOST * F.col("source_size"))
    targets = _targets(ws, sizes).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("int"))
    targets = targets.withColumns({"rest": wanted - F.col("passes") * F.col("source_size"), "blocks": F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")})
    targets = ws.keep(targets, "targets")

    of_source = targets.select("source", "rank", "blocks", "source_size", "target")
    placed = sized.join(of_source, sized["origin"].eqNullSafe(of_source["source"])).drop("source")
    placed = placed.withColumns({"block": F.pmod("h", "blocks"), "sub": F.pmod(F.shiftright("h", 32), F.lit(SUBBLOCKS)).cast("int"), "task": F.shiftright("line", 33)}).drop("blocks")
    sums = ws.keep(placed.groupBy("rank", "block").agg(F.sum("size").alias("words")).where("words > 0"), "blocks")

    # one row per block: words needed of it in the last, partial pass
    by_source = Window.partitionBy("rank")
    blocks = sums.join(targets.select("rank", "passes", "rest"), "rank")
    permuted = by_source.orderBy(F.xxhash64(F.lit(seed), "rank", "block"), "block")
    blocks = blocks.withColumn("before", F.sum("words").over(permuted) - F.col("words"))
    blocks = blocks.withColumn("need", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("before")))).drop("before", "rest")
    blocks = ws.keep(blocks.withColumn("part", (F.col("need") > 0) & (F.col("need") < F.col("words"))), "needs")

    # draws of blocks in a permuted order, dealt out to shards
    epochs = F.sequence(F.lit(0), F.col("passes") - F.when(F.col("need") > 0, 0).otherwise(1))
    drawn = blocks.where("passes > 0 or need > 0").withColumn("epoch", F.explode(epochs)).select("rank", "block", "epoch")
    drawn = drawn.withColumn("turn", F.row_number().over(by_source.orderBy(F.xxhash64(F.lit(seed + 1), "rank", "block", "epoch"), "block", "epoch")).cast("long"))
    shares = ws.keep(shard_quotas(drawn.groupBy("rank").agg(F.count("*").alias("quota")), levels, seed), "shares")
    first = F.sum("quota").over(by_source.orderBy("shard")) - F.col("quota")
    turns = shares.withColumn("first", first).select("rank", "shard", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("quota"))).alias("turn"))
    dealt = drawn.join(turns, ["rank", "turn"])
    plan = dealt.groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("plan"))

    # the cut in the partial block of a source: whole parts, then equal rows of one task, then rows
    cut = placed.join(blocks.where("part").select("rank", "block", "need"), ["rank", "block"]).select("rank", "need", "sub", "h", "task", "size")

    def edge(level: DataFrame, *order: str) -> DataFrame:
        """Where, in this order of sums, the need of each source is met, and what is needed there."""
        summed = level.groupBy("rank", "need", *order).agg(F.sum("size").alias("words"))
        summed = summed.withColumn("before", F.sum("words").over(by_source.orderBy(*order)) - F.col("words"))
        return ws.keep(summed.where("before < need and before + words >= need").select("rank", *order, (F.col("need") - F.col("before")).alias("need")), "edge")

    coarse = edge(cut, "sub")
    fine = edge(cut.drop("need").join(coarse, ["rank", "sub"]), "h", "task")
    names = {"sub": "edge_sub", "h": "edge_h", "task": "edge_task", "need": "edge_need"}
    edges = coarse.drop("need").join(fine, "rank").withColumnsRenamed(names)

    facts = ws.keep(blocks.join(plan, ["rank", "block"], "left").join(edges, "rank", "left").drop("words"), "facts")
    joined = placed.join(facts, ["rank", "block"], "left")
    here, there = F.struct("sub", "h", "task"), F.struct("edge_sub", "edge_h", "edge_task")
    # rows at the edge, apart from their texts: words that the last one of them gives
    rough = joined.where(F.col("part") & (here == there)).select("rank", "line", "size", "edge_need").withColumn("until", F.sum("size").over(by_source.orderBy("line")))
    rough = rough.select("line", F.greatest(F.lit(0), F.least("size", F.col("edge_need") - F.col("until") + F.col("size"))).alias("given"))
    last = F.when(F.col("part"), F.when(here < there, F.col("size")).otherwise(F.coalesce("given", F.lit(0)))).when(F.col("need") > 0, F.col("size")).otherwise(0)
    merged = joined.join(ws.keep(rough, "rough"), "line", "left").withColumn("last", F.coalesce(last, F.lit(0)).cast("long"))
    draws = F.expr(f"""
      filter(transform(coalesce(plan, cast(array() as array<struct<epoch:int,shard:int>>)),
        p -> named_struct('epoch', p.epoch, 'shard', p.shard, 'at', xxhash64({seed}L, h, p.epoch), 'words', if(p.epoch < passes, size, last))),
        d -> d.words > 0)""")
    out = merged.withColumn("draws", draws).withColumn("taken", F.expr("aggregate(draws, 0L, (t, d) -> t + d.words)"))
    return out.select(*unboxed(carried), "size", "source_size", "target", "taken", "draws")


def mixture(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mixture's documents, one row per draw: each shard's rows in one task, shuffled inside it.

    A cut text keeps its first words, joined by one space.
    """
    drawn = mixed.select("*", F.explode("draws").alias("draw"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), F.col("draw.words").cast("int")), " ")
    whole = drawn.withColumn(text, F.when(F.col("draw.words") < F.col("size"), first).otherwise(F.col(text)))
    return whole.repartition(F.col("draw.shard")).sortWithinPartitions("draw.shard", "draw.at")
