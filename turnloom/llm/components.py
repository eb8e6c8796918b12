"""Connected components of a link table, by alternating star contraction.

Each round hangs the neighbours of a node on their smallest node (large star,
then small star), so the number of rounds grows with the logarithm of the
longest path. Between rounds every task replaces a bounded number of links by
stars of their local components, which settles small groups at once, and small
link tables in one task. Links are grouped with mergeable minima, so a node in
a third of all links is no single task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.workspace import Workspace

#: Links that one task takes in for its local components.
TASK_LINKS = 250_000


def _local_stars(batches):
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in parent]
    found = [(x, r) for x, r in found if x != r]
    for i in range(0, len(found), 100_000):
        part = found[i : i + 100_000]
        yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in part], pa.int64()), "v": pa.array([r for _, r in part], pa.int64())})


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with u > v. Hangs neighbours on the smallest node around each node."""
    pairs = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = pairs.join(least, "u").where("v > u" if large else "v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        hung = hung.union(least.select("u", F.col("m").alias("v")))
    return hung.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(ws: Workspace, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has a link; links: a written table of two long ids.

    component is the smallest node id of the group. Self links are ignored.
    """
    a, b = links.columns
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v")
    parts = -(-links.count() // TASK_LINKS)
    stars = ws.keep(links.coalesce(max(parts, 1)).mapInArrow(_local_stars, "u long, v long"), "stars")
    for _ in range(rounds):
        if parts <= 1:
            break  # one task has seen all links
        # else done when every node hangs on one node which itself hangs on none
        seen = stars.select("u", "v", F.lit(False).alias("head")).union(stars.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(True).alias("head")))
        state = seen.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("head").alias("head"))
        if state.where("lo != hi or (head and lo is not null)").isEmpty():
            break
        was, stars = stars, ws.keep(_stars(_stars(stars, True), False), "stars")
        ws.drop(was)
        parts = -(-stars.count() // TASK_LINKS)
        was, stars = stars, ws.keep(stars.coalesce(max(parts, 1)).mapInArrow(_local_stars, "u long, v long"), "stars")
        ws.drop(was)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
