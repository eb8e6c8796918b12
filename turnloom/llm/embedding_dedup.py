"""Near-duplicate vectors: exact threshold pairs by dual traversal of cover trees.

Method: the vectors of a label are the root of a tree. A node with more than
CELL vectors is split among some of them (FAN at most, about) as centers, each
vector to its nearest, with the largest distance as the child's covering radius; children are
split on, level by level, in Spark. Pairs of nodes that may hold links are
carried down the levels: of a pair's children only those remain that are not
farther apart than their radii and the threshold allow. Where radii and distance
are so small that all pairs of two leaves are links, they are counted by the
leaves' weights. The lower levels (nested nets of halving radii) are built in
tasks. Every other pair of leaves first meets with its balls of about
the threshold's width alone; only the members of balls that the same bound leaves near
another meet in one task, which walks both trees at once, pruning pairs of balls
down to pairs of vectors.

Scale: equal vectors collapse to one node with a weight before anything else.
Nothing is collected or broadcast; vectors are joined with the centers of their
own cell only. Leaves that cannot be made small are dealt out in blocks of CELL.
Between leaves a cluster of about the threshold's width travels as its few balls,
and a vector only where one of those is near.
A task returns a count per vector and the links of a spanning forest, never the
pairs, so a group of n vectors that are all alike returns n rows. In high
dimensions without clusters no metric bound prunes, and the work grows with the
square of a label's size.

Defined cases: vectors that are null, of length zero or hold null or non-finite
values, and rows without a label, link with nothing: n_links 0, component_id is
their own id, kept true. Vectors of different lengths never link. Repeated rows
link with each other. A null id counts as larger than all others. Very long
vectors are like others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm import cover_tree
from turnloom.llm.columns import boxed, unboxed, with_fields, without
from turnloom.llm.components import components
from turnloom.llm.workspace import Workspace

THRESHOLD = 0.98
#: Vectors that a leaf should hold at most, centers that a larger node is split among, and levels at most.
CELL = 4096
FAN = 64
LEVELS = 30
#: How wide, in distances at the threshold, a ball may be that stands for its members before leaves
#: meet. Members that all link with each other lie little more than one from any of them.
WIDTH = 1.5
#: Around the threshold within which a cosine is worked out again from the vectors as given.
DOUBT = 1e-9


def _rows(names: list[str]):
    def run(batches):
        for batch in batches:
            keys, vectors = [], []
            for value, label in zip(batch.column("tl_vector"), batch.column("tl_label"), strict=True):
                key = vector = None
                if value.is_valid and label.is_valid and not value.values.null_count:
                    x = value.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    if len(x) and np.isfinite(x).all() and x.any():
                        vector = x.tobytes()
                        key = hashlib.blake2b(vector, digest_size=16).digest()
                keys.append(key)
                vectors.append(vector)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {"vec_key": pa.array(keys, pa.binary()), "vector": pa.array(vectors, pa.binary())}
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in names})

    return run


def _units(column) -> np.ndarray:
    x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in column])
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def _split(members: pa.Table, centers: pa.Table) -> pa.Table:
    """Members of a cell to its nearest center; a center to itself."""
    members, centers = members.combine_chunks(), centers.combine_chunks()
    names = centers.column("node").to_numpy()
    gaps = _gaps(_units(members.column("vector")), _units(centers.column("vector")))
    own, gap = gaps.argmin(1), gaps.min(1)
    node = members.column("node").to_numpy()
    order = np.argsort(names)
    at = np.minimum(np.searchsorted(names[order], node), len(names) - 1)
    is_center = names[order][at] == node
    own[is_center], gap[is_center] = order[at[is_center]], 0.0
    return pa.table({"node": members.column("node"), "vector": members.column("vector"), "weight": members.column("weight"), "parent": members.column("cell"), "cell": pa.array(names[own]), "gap": pa.array(gap)})


def _balls(family) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Cells, radii and centers of the children of a node; a root has no center."""
    cells, radii = (np.array([b[c].as_py() for b in family]) for c in ("cell", "radius"))
    centers = [b["center"] for b in family]
    return cells, radii, _units(centers) if all(c.is_valid for c in centers) else None


def _near(threshold: float):
    """Pairs of children that may hold links, and whether all their pairs are links."""
    reach = float(np.sqrt(2 - 2 * threshold))

    def run(batches):
        for batch in batches:
            left, right, full = [], [], []
            for a, b, one, two in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("one"), batch.column("two"), strict=True):
                (ca, ra, xa), (cb, rb, xb) = _balls(one), _balls(two)
                gaps = _gaps(xa, xb) if xa is not None and xb is not None else np.zeros((len(ca), len(cb)))
                if a == b:
                    np.fill_diagonal(gaps, 0.0)  # a ball's distance to itself, without rounding
                spread = ra[:, None] + rb[None, :]
                near = gaps <= spread + reach + 1e-6
                if a == b:
                    near &= np.arange(len(ca))[:, None] <= np.arange(len(cb))
                i, j = np.nonzero(near)
                left += np.minimum(ca[i], cb[j]).tolist()
                right += np.maximum(ca[i], cb[j]).tolist()
                full += (gaps[i, j] + spread[i, j] <= reach - 1e-6).tolist()
            yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64()), "full": pa.array(full, pa.bool_())})

    return run


def _cover(threshold: float):
    """The balls of one block: each member with its ball, which bears its center's name, and the ball's radius."""
    reach = float(np.sqrt(2 - 2 * threshold))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node = table.column("node").to_numpy()
        ball, radius = np.empty(len(node), np.int64), np.empty(len(node))
        for b in cover_tree.leaves(cover_tree.build(_units(table.column("vector")), leaf=1, smallest=WIDTH * reach)):
            ball[b.members], radius[b.members] = node[b.center], b.radius
        return table.append_column("ball", pa.array(ball)).append_column("radius", pa.array(radius))

    return run


def _touch(threshold: float):
    """Of two blocks' balls, those that may hold an end of a link between the two."""
    reach = float(np.sqrt(2 - 2 * threshold))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, radius, units = table.column("side").to_numpy(), table.column("radius").to_numpy(), _units(table.column("vector"))
        near = np.zeros(len(side), bool)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for s in range(0, len(one), cover_tree.TILE):
            for t in range(0, len(two), cover_tree.TILE):
                p, q = one[s : s + cover_tree.TILE], two[t : t + cover_tree.TILE]
                close = _gaps(units[p], units[q]) <= radius[p][:, None] + radius[q] + reach + 1e-6
                near[p] |= close.any(1)
                near[q] |= close.any(0)
        return table.select(["a", "b", "i", "j", "side", "ball"]).filter(pa.array(near))

    return run


def _meet(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, side, weight = (table.column(c).to_numpy() for c in ("node", "side", "weight"))
        units, given = _units(table.column("vector")), table.column("vector")
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        # a block with itself has one side only; two blocks of which one is empty do not meet
        alone = table.column("a")[0] == table.column("b")[0] and table.column("i")[0] == table.column("j")[0]
        links, parent, a, b = np.zeros(len(node), np.int64), list(range(len(node))), [], []

        def root(i):
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        if alone or len(one) and len(two):
            tree = cover_tree.build(units[one])
            other, where = (tree, one) if alone else (cover_tree.build(units[two]), two)
            for i, j in cover_tree.close_pairs(units[one], tree, units[where], other, threshold - DOUBT):
                i, j = one[i], where[j]
                if alone:
                    low, high = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
                    i, j = np.unique(np.stack((low, high)), axis=1) if len(low) else (low, high)
                unsure = np.flatnonzero(np.abs((units[i] * units[j]).sum(1) - threshold) <= 2 * DOUBT)
                good = np.ones(len(i), bool)
                for k in unsure:
                    p, q = (np.frombuffer(given[int(v)].as_py(), np.float64) for v in (i[k], j[k]))
                    good[k] = p @ q / np.sqrt((p @ p) * (q @ q)) >= threshold
                i, j = i[good], j[good]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = root(p), root(q)
                    if x != y:
                        parent[x] = y
                        a.append(int(node[p]))
                        b.append(int(node[q]))
        some = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate((node[some], np.array(a, np.int64)))), "b": pa.array(np.concatenate((links[some], np.array(b, np.int64)))),
            "is_link": pa.array([False] * len(some) + [True] * len(a), pa.bool_()),
        })

    return run


def grow(ws: Workspace, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The upper levels: members (node, vector, weight, cell), leaves (cell, n, w, radius, center), pairs (a, b, full).

    A cell is named by the node that is its center, a root by its smallest node.
    """
    reach = float(np.sqrt(2 - 2 * threshold))
    ball = "cell long, n long, w long, radius double, center binary"
    roots = ws.keep(nodes.groupBy("space").agg(F.min("node").alias("cell"), F.count("*").alias("n"), F.sum("weight").alias("w")), "roots")
    members = ws.keep(nodes.join(roots.select("space", "cell"), "space").select("node", "vector", "weight", "cell"), "members")
    cells = ws.keep(roots.select("cell", "n", "w", F.lit(4.0).alias("radius"), F.lit(None).cast("binary").alias("center")), "cells")
    pairs = roots.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    kids_of = lambda rows, key: rows.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("cell", "radius", "center")).alias("family"))

    def carried_down(pairs: DataFrame, families: DataFrame) -> DataFrame:
        families = ws.keep(families, "families")
        for end, name in (("a", "one"), ("b", "two")):
            pairs = pairs.join(families.select(F.col("key").alias(end), F.col("family").alias(name)), end)
        return ws.keep(pairs.select("a", "b", "one", "two").mapInArrow(_near(threshold), "a long, b long, full boolean"), "pairs")

    for level in range(LEVELS):
        big = cells.where((F.col("n") > CELL) & (2 * F.col("radius") > reach - 1e-6)).select("cell", "n")
        if big.isEmpty():
            break
        # as many centers as make children of half a leaf, so that unclustered vectors are not scattered over tiny leaves
        wanted = F.greatest(F.lit(3.0), F.least(F.lit(float(FAN)), 2.0 * F.col("n") / CELL))
        share = wanted * float(1 << 30) / F.col("n")
        centers = members.join(big, "cell").where(F.pmod(F.xxhash64("vector", F.lit(level)), F.lit(1 << 30)) < share).select("cell", "node", "vector")
        centers = ws.keep(centers, "centers")
        able = ws.keep(centers.groupBy("cell").agg(F.count("*").alias("k")).where("k > 1").join(big, "cell").select("cell", F.ceil(F.col("n") / (4 * CELL)).cast("int").alias("salts")), "able")
        if able.isEmpty():
            continue  # too few centers by chance: others are drawn on the next level
        salted = members.join(able, "cell").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).drop("salts")
        spread = centers.join(able, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        moved = salted.groupBy("cell", "salt").cogroup(spread.groupBy("cell", "salt")).applyInArrow(_split, "node long, vector binary, weight long, parent long, cell long, gap double")
        moved = ws.keep(moved, "moved")
        kids = moved.groupBy("parent", "cell").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.max("gap").alias("radius"), F.max(F.when(F.col("node") == F.col("cell"), F.col("vector"))).alias("center"))
        kids = ws.keep(kids, "kids")
        rest = cells.join(able, "cell", "left_anti")
        pairs = carried_down(pairs.select("a", "b"), kids_of(kids, "parent").unionByName(kids_of(rest.withColumn("key", F.col("cell")), "key")))
        members = ws.keep(members.join(able, "cell", "left_anti").select("node", "vector", "weight", "cell").unionByName(moved.select("node", "vector", "weight", "cell")), "members")
        cells = ws.keep(rest.select(*[c.split()[0] for c in ball.split(", ")]).unionByName(kids.drop("parent")), "cells")
    if "full" not in pairs.columns:
        pairs = pairs.withColumn("full", F.lit(False))
    return members, cells, pairs


def link_embeddings(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, keep_vector: bool = True, workspace: Workspace | None = None) -> DataFrame:
    """The rows with n_links, component_id and kept."""
    spark = table.sparkSession
    ws = workspace or Workspace(spark)
    rows = without(table, "n_links", "component_id", "kept")
    carried = [c for c in rows.columns if keep_vector or c != vector]
    boxes = boxed(rows, carried, tl_id=F.col(vec_id), tl_label=F.col(label).cast("string"), tl_vector=F.col(vector))
    schema = with_fields(T.StructType([f for f in boxes.schema.fields if f.name != "tl_vector"]), ("vec_key", T.BinaryType()), ("vector", T.BinaryType()))
    signed = ws.keep(boxes.mapInArrow(_rows(schema.names), schema), "signed").withColumn("space", F.concat_ws(" ", F.length("vector"), "tl_label"))
    least = signed.where("vec_key is not null").groupBy("space", "vec_key").agg(F.min("tl_id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    nodes = ws.keep(least.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")

    members, cells, pairs = grow(ws, nodes, threshold)
    full, open_ = ws.keep(pairs.where("full"), "full"), pairs.where("not full")

    # leaves of which all pairs are links: weights are counted, and all are linked with one center
    sides = full.select(F.explode(F.array(F.struct(F.col("a").alias("cell"), F.col("b").alias("other")), F.struct(F.col("b").alias("cell"), F.col("a").alias("other")))).alias("x")).select("x.*").distinct()
    whole = sides.join(cells.select(F.col("cell").alias("other"), F.col("w")), "other").groupBy("cell").agg(F.sum("w").alias("near"), F.min("other").alias("hub"), F.max(F.col("other") == F.col("cell")).alias("itself"))
    counted = members.join(whole, "cell").select("node", "hub", (F.col("near") - F.when(F.col("itself"), F.col("weight")).otherwise(0)).alias("others"))
    counted = ws.keep(counted, "counted")

    # other pairs of leaves: every block of one with every block of the other
    blocks = cells.select("cell", F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))
    one = open_.join(blocks.select(F.col("cell").alias("b"), "blocks"), "b").select(F.col("a").alias("cell"), "a", "b", "blocks", F.lit(0).alias("side"))
    two = open_.where("a != b").join(blocks.select(F.col("cell").alias("a"), "blocks"), "a").select(F.col("b").alias("cell"), "a", "b", "blocks", F.lit(1).alias("side"))
    dealt = members.join(blocks.withColumnRenamed("blocks", "mine"), "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col("mine")).cast("int")).drop("mine")
    covered = dealt.join(open_.select(F.explode(F.array("a", "b")).alias("cell")).distinct(), "cell").groupBy("cell", "own")
    covered = ws.keep(covered.applyInArrow(_cover(threshold), "cell long, node long, vector binary, weight long, own int, ball long, radius double"), "covered")
    meeting = covered.where("node = ball").select("cell", "own", "ball", "vector", "radius").join(one.unionByName(two), "cell").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    same, first = F.col("a") == F.col("b"), F.col("side") == 0
    meeting = meeting.where(~(same & (F.col("own") == F.col("k")))).select(
        "a", "b", F.when(same, F.least("own", "k")).when(first, F.col("own")).otherwise(F.col("k")).alias("i"), F.when(same, F.greatest("own", "k")).when(first, F.col("k")).otherwise(F.col("own")).alias("j"),
        F.when(same, F.when(F.col("own") < F.col("k"), 0).otherwise(1)).otherwise(F.col("side")).alias("side"), "ball", "vector", "radius",
    )
    near = ws.keep(meeting.groupBy("a", "b", "i", "j").applyInArrow(_touch(threshold), "a long, b long, i int, j int, side int, ball long"), "near")
    facing = ["a", "b", "i", "j", "side", "node", "vector", "weight"]
    inside = covered.join(open_.where("a = b").select("a"), F.col("cell") == F.col("a")).select("a", F.col("a").alias("b"), F.col("own").alias("i"), F.col("own").alias("j"), F.lit(0).alias("side"), "node", "vector", "weight")
    met = covered.join(near, "ball").select(*facing).unionByName(inside)
    met = ws.keep(met.groupBy("a", "b", "i", "j").applyInArrow(_meet(threshold), "a long, b long, is_link boolean"), "met")
    counts = met.where("not is_link").select(F.col("a").alias("end"), F.col("b").alias("others")).unionByName(counted.select(F.col("node").alias("end"), "others")).groupBy("end").agg(F.sum("others").alias("others"))
    links = met.where("is_link").select("a", "b").union(counted.select("node", "hub")).union(full.select("a", "b"))
    links = ws.keep(links.where("a != b"), "links")
    groups = components(ws, links)

    parts = nodes.join(groups, "node", "left").join(counts, F.col("node") == F.col("end"), "left").select("space", "vec_key", "rep", F.coalesce("component", "node").alias("component"), (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    heads = parts.groupBy("component").agg(F.min("rep").alias("component_id"))
    answer = parts.join(heads, "component").select(F.col("space").alias("s"), F.col("vec_key").alias("k"), "n_links", "component_id")
    out = signed.drop("vector").join(answer, (F.col("space") == F.col("s")) & (F.col("vec_key") == F.col("k")), "left")
    component = F.when(F.col("vec_key").isNull(), F.col("tl_id")).otherwise(F.col("component_id"))
    out = out.withColumn("component_id", component).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    return out.select(*unboxed(carried), "n_links", "component_id", F.col("tl_id").eqNullSafe(F.col("component_id")).alias("kept"))
