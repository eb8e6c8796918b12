"""Near-duplicate texts by a join of MinHash signature coordinates.

Method: a text's set of word shingles gets a signature of COORDINATES minima.
Every coordinate with its value is a posting key. A pair is a candidate where
its signatures agree in at least MATCHES coordinates, and is linked where its
full sets confirm it; this rule holds for every pair, however many texts share
its keys. Keys that one text alone has cannot collide; among the others, in
order of their exact counts, a text posts all but its last MATCHES - 1. Two
texts that agree in MATCHES keys share one of these (prefix merging), and what
many texts share (a common line, a licence) falls out of the prefixes.

Pairs already in one group are skipped: lists are first merged as stars around
one member, and only lists that several groups have are looked at again. In
those of at most LIST members all pairs are counted on the signatures. Members
of longer ones are joined once more, by the rarest shingles of their full sets:
a text with n shingles posts all but the last ceil(0.75 n) - 1 of those that it
shares, by exact counts. Where even these lists are longer than LIST, their
members are compared in blocks of one size class with the same and the next
class; inverted lists of a block give exact intersections without writing out
pairs, and only links that join groups leave a block.

A pair of similarity 0.75 fails to agree in 12 of 32 coordinates with
probability 1.5e-6; any higher similarity less often. Nothing is capped, and
LIST, BLOCK and the order of work do not change the result.

Scale: equal sets collapse to one node before anything is posted (a mergeable
minimum, so thousands of copies cost one row per task). Everything is joined by
key; nothing is broadcast or collected that grows with the corpus. Texts are
read twice; only texts in candidate pairs are shuffled. Blocks remain quadratic
for texts that share three quarters of their shingles with very many others
without being linked to them.

Defined cases: null and wordless texts have n_shingles 0 and link with nothing;
repeated rows link with each other; very long texts are hashed in slices; a null
id counts as larger than all others, so a group's component_id is null only if
all its ids are.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from turnloom.llm import textops
from turnloom.llm.columns import boxed, text_of, unboxed, with_fields, without
from turnloom.llm.components import components
from turnloom.llm.workspace import Workspace

SHINGLE = 5
PERCENT = 75
COORDINATES = 32
MATCHES = 12
#: Members up to which a list is compared by itself, and texts in one block.
LIST = 32
BLOCK = 1024

_draw = np.random.default_rng(5)
_FACTORS = _draw.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _draw.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def shingle_sets(batch: pa.RecordBatch, text: str) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, sorted."""
    raw, at = textops.buffers(batch.column(text))
    h, counts, _, _ = textops.words(textops.LOWER[raw], at)
    where, per = textops.window_starts(counts, SHINGLE)
    rolled = textops.windows(h, SHINGLE)[where] if len(where) else np.zeros(0, np.uint64)
    at_window, at_word = np.concatenate(([0], np.cumsum(per))), np.concatenate(([0], np.cumsum(counts)))
    sets = []
    for i in range(batch.num_rows):
        if per[i]:
            sets.append(np.unique(rolled[at_window[i] : at_window[i + 1]]))
        elif counts[i]:
            own = textops.windows(h[at_word[i] : at_word[i + 1]], int(counts[i]))
            sets.append(textops.mix(own + np.uint64(counts[i])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of the non-empty sets, one row each."""
    sizes = np.array([len(s) for s in sets])
    values, first = np.concatenate(sets), np.cumsum(sizes) - sizes
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for begin in range(0, len(sets), 256):
        a, b = first[begin], first[begin + 256] if begin + 256 < len(sets) else len(values)
        part, cut = values[a:b], first[begin : begin + 256] - a
        for j in range(COORDINATES):
            x = (part * _FACTORS[j] + _SHIFTS[j]) >> np.uint64(32)
            out[begin : begin + 256, j] = np.minimum.reduceat(x, cut)
    return out


def _key(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _sign(text: str, names: list[str]):
    def run(batches):
        for batch in textops.slices(batches, text, 1 << 20):
            sets = shingle_sets(batch, text)
            full = [i for i, s in enumerate(sets) if len(s)]
            rows = _signatures([sets[i] for i in full]) if full else None
            keys, signatures = [None] * len(sets), [None] * len(sets)
            for j, i in enumerate(full):
                keys[i], signatures[i] = _key(sets[i]), rows[j].tobytes()
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {"n_shingles": pa.array([len(s) for s in sets], pa.int64()), "set_key": pa.array(keys, pa.binary()), "signature": pa.array(signatures, pa.binary())}
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in names})

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _keys(signatures: np.ndarray) -> np.ndarray:
    return textops.mix(signatures.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))


def _post(batches):
    """All keys of each node."""
    for batch in batches:
        if batch.num_rows:
            keys = _keys(_matrix(batch.column("signature")))
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel().view(np.int64), pa.int64()), "node": pa.array(np.repeat(batch.column("node").to_numpy(), COORDINATES), pa.int64())})


def _post_members(batches):
    """All shingles of each node, in slices."""
    for batch in batches:
        for node, value in zip(batch.column("node").to_pylist(), batch.column("members"), strict=True):
            members = np.frombuffer(value.as_buffer(), np.int64)
            for a in range(0, len(members), 100_000):
                part = members[a : a + 100_000]
                yield pa.RecordBatch.from_pydict({"key": pa.array(part, pa.int64()), "node": pa.array(np.full(len(part), node), pa.int64())})


def _agree(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        same = (_matrix(batch.column("sig_a")) == _matrix(batch.column("sig_b"))).sum(axis=1)
        low, high = np.sort(np.stack([batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()]), axis=0)
        good = (same >= MATCHES) & (100 * low >= PERCENT * high)
        yield batch.select(["a", "b"]).filter(pa.array(good))


def _sets(text: str):
    def run(batches):
        for batch in textops.slices(batches, text, 1 << 20):
            sets = shingle_sets(batch, text)
            wanted = batch.column("set_key").to_pylist()
            good = [i for i, s in enumerate(sets) if _key(s) == wanted[i]]
            yield pa.RecordBatch.from_pydict({
                "node": batch.column("node").take(pa.array(good, pa.int64())),
                "members": pa.array([sets[i].tobytes() for i in good], pa.binary()),
            })

    return run


def _confirm(batches):
    for batch in batches:
        good = []
        for x, y in zip(batch.column("m_a"), batch.column("m_b"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = np.concatenate((x, y))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            good.append(100 * shared >= PERCENT * (len(both) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _list_pairs(table: pa.Table) -> pa.Table:
    """Of one list: pairs that agree often enough and lie in different groups."""
    table = table.combine_chunks().sort_by("node")
    node, group, n = (table.column(c).to_numpy() for c in ("node", "group", "n"))
    signatures = _matrix(table.column("signature"))
    a, b = [], []
    for i in range(len(node) - 1):
        good = (signatures[i + 1 :] == signatures[i]).sum(axis=1) >= MATCHES
        good &= 100 * np.minimum(n[i + 1 :], n[i]) >= PERCENT * np.maximum(n[i + 1 :], n[i])
        other = i + 1 + np.flatnonzero(good & (group[i + 1 :] != group[i]))
        a += [node[i]] * len(other)
        b += node[other].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _merge(table: pa.Table) -> pa.Table:
    """Of two blocks: links that join groups, from merged lists of the full sets.

    Every member's shingles are looked up in the other block's inverted lists;
    the counts are exact intersections with all texts there at once. Only
    links between groups that are still apart are returned.
    """
    table = table.combine_chunks()
    node, group, side = (table.column(c).to_numpy() for c in ("node", "group", "side"))
    sets, signatures = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("members")], _matrix(table.column("signature"))
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(two):
        two = one
    sizes = np.array([len(sets[i]) for i in two])
    values, owner = np.concatenate([sets[i] for i in two]), np.repeat(np.arange(len(two)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    parent = {g: g for g in np.unique(group).tolist()}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    a, b = [], []
    for i in one:
        first, last = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        per = last - first
        total = int(per.sum())
        if not total:
            continue
        at = np.arange(total) + np.repeat(first - (np.cumsum(per) - per), per)
        shared = np.bincount(owner[at], minlength=len(two))
        for j in np.flatnonzero(100 * shared >= PERCENT * (len(sets[i]) + sizes - shared)):
            x, y = root(group[i]), root(group[two[j]])
            if x != y and (signatures[i] == signatures[two[j]]).sum() >= MATCHES:
                parent[max(x, y)] = min(x, y)
                a.append(node[i])
                b.append(node[two[j]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def link_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", workspace: Workspace | None = None, with_text: bool = False) -> DataFrame:
    """The rows of docs with n_shingles, component_id, kept and chosen; text only if asked for.

    component_id is the smallest id reachable by links, kept is whether it is
    the row's own. chosen holds for exactly one row of each group, also where
    rows repeat an id, and for texts without words.
    """
    text_of(docs, text)
    spark = docs.sparkSession
    ws = workspace or Workspace(spark)
    rows = without(docs, "n_shingles", "component_id", "kept", "chosen")
    carried = [c for c in rows.columns if with_text or c != text]
    boxes = boxed(rows, carried, tl_id=F.col(doc_id), tl_print=F.xxhash64(text), tl_text=F.col(text))
    schema = T.StructType([f for f in boxes.schema.fields if f.name != "tl_text"])
    schema = with_fields(schema, ("n_shingles", T.LongType()), ("set_key", T.BinaryType()), ("signature", T.BinaryType()))
    signed = ws.keep(boxes.mapInArrow(_sign("tl_text", schema.names), schema).withColumn("seq", F.monotonically_increasing_id()), "signed", "zstd" if with_text else "snappy")
    distinct = signed.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct(F.col("tl_id").isNull(), "tl_id", "seq", "tl_print")).alias("head"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    nodes = ws.keep(distinct.select(F.monotonically_increasing_id().alias("node"), "set_key", "head", F.col("head.tl_id").alias("rep"), F.col("head.tl_print").alias("print"), "signature", "n"), "nodes")

    def prefixes(keyed: DataFrame, least: Column, name: str) -> DataFrame:
        """Of (key, node, ...): what each node posts, all but its last least - 1 shared keys by count.

        Keys that one node alone has are dropped; nodes that share fewer than `least` post nothing.
        """
        counts = ws.keep(keyed.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "counts")
        ordered = Window.partitionBy("node").orderBy("times", "key")
        held = keyed.join(counts, "key").withColumns({"nth": F.row_number().over(ordered), "held": F.count("*").over(Window.partitionBy("node"))})
        posts = ws.keep(held.where(F.col("nth") <= F.col("held") - least + 1).select("key", "node"), name)
        ws.drop(counts)
        lists = posts.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("times")).where("times > 1")
        shared = ws.keep(posts.join(lists, "key"), "lists")
        ws.drop(posts)
        return shared

    def several_groups(shared: DataFrame, groups: DataFrame) -> DataFrame:
        """The lists whose members lie in more than one group, with `group`."""
        table = shared.join(groups.withColumnsRenamed({"component": "group"}), "node", "left").withColumn("group", F.coalesce("group", "node"))
        apart = table.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo != hi").select("key")
        return ws.keep(table.join(apart, "key", "left_semi"), "mixed")

    def pairs_of(mixed: DataFrame) -> DataFrame:
        short = mixed.where(F.col("times") <= LIST).select("key", "node", "group").join(side, "node")
        return ws.keep(short.groupBy("key").applyInArrow(_list_pairs, "a long, b long").distinct(), "pairs")

    shared = prefixes(nodes.select("node", "signature").mapInArrow(_post, "key long, node long"), F.lit(MATCHES), "posts")
    side = nodes.select("node", "signature", "n")

    def agreeing(pairs: DataFrame) -> DataFrame:
        for s in "ab":
            pairs = pairs.join(side.select(F.col("node").alias(s), F.col("signature").alias(f"sig_{s}"), F.col("n").alias(f"n_{s}")), s)
        return pairs.mapInArrow(_agree, "a long, b long")

    def sets_of(ends: DataFrame) -> DataFrame:
        # by id and a hash of the text, so that rows which share an id do not multiply
        wanted = ends.distinct().join(nodes.select("node", "set_key", "rep", "print"), "node")
        found = boxes.select("tl_id", "tl_print", "tl_text").join(wanted, F.col("tl_id").eqNullSafe(F.col("rep")) & (F.col("tl_print") == F.col("print")))
        return ws.keep(found.select("node", "set_key", "tl_text").mapInArrow(_sets("tl_text"), "node long, members binary").dropDuplicates(["node"]), "sets", "none")

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        for s in "ab":
            pairs = pairs.join(sets.select(F.col("node").alias(s), F.col("members").alias(f"m_{s}")), s)
        return pairs.mapInArrow(_confirm, "a long, b long")

    def in_blocks(mixed: DataFrame, sets: DataFrame) -> DataFrame:
        """Links among the members of long lists, in blocks of texts that are alike in size and share lists."""
        long = ws.keep(mixed.select("center", "node", "group").distinct(), "long")
        family = components(ws, long.select("center", "node"))
        size = F.floor(F.log(F.col("n")) / (1.0001 * math.log(100 / PERCENT))).cast("int")  # links lie in one class or two adjacent ones
        placed = family.join(long.select("node", "group").distinct(), "node").join(side, "node").select("component", size.alias("size"), "node", "group", "signature")
        placed = ws.keep(placed, "families")
        blocks = ws.keep(placed.groupBy("component", "size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
        for name, shift in (("here", 0), ("above", 1), ("below", -1)):
            placed = placed.join(blocks.select("component", (F.col("size") - shift).alias("size"), F.col("blocks").alias(name)), ["component", "size"], "left")
        own = F.pmod(F.xxhash64("node"), F.col("here")).cast("int")

        def meet(count: str, low: Column, i, high: Column, j, side_: Column) -> Column:
            """One struct for each block of that class."""
            each = F.filter(F.sequence(F.lit(0), F.coalesce(count, F.lit(0))), lambda k: k < F.coalesce(count, F.lit(0)))
            return F.transform(each, lambda k: F.struct(low.alias("low"), i(k).alias("i"), high.alias("high"), j(k).alias("j"), side_(k).alias("side")))

        c, me, it = F.col("size"), (lambda k: F.col("own")), (lambda k: k)
        turn = lambda v: lambda k: F.lit(v)
        met = F.concat(
            meet("here", c, lambda k: F.least("own", k), c, lambda k: F.greatest("own", k), lambda k: F.when(F.col("own") <= k, 0).otherwise(1)),
            meet("above", c, me, c + 1, it, turn(0)),
            meet("below", c - 1, it, c, me, turn(1)),
        )
        spread = placed.withColumn("own", own).withColumn("met", F.explode(met)).select("component", "met.*", "node", "group", "signature")
        return spread.join(sets, "node").groupBy("component", "low", "i", "high", "j").applyInArrow(_merge, "a long, b long")

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node"))
    stars = shared.where("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    pairs = ws.keep(agreeing(stars), "pairs")
    sets = sets_of(ends(pairs))
    links = ws.keep(confirmed(pairs, sets), "links")
    ws.drop(sets)
    groups = components(ws, links)

    # lists that more than one group has; their centers have met all members
    mixed = several_groups(shared.where("times > 2"), groups)
    ws.drop(shared, pairs)
    if not mixed.isEmpty():
        pairs = pairs_of(mixed)
        crowd = ws.keep(mixed.where(F.col("times") > LIST).select("node").distinct(), "crowd")
        sets = sets_of(ends(pairs).union(crowd))
        found = confirmed(pairs, sets)
        if not crowd.isEmpty():
            own = crowd.join(sets.select("node", "members"), "node")
            sizes = side.select("node", "n")
            keyed = own.mapInArrow(_post_members, "key long, node long").join(sizes, "node")
            shared = prefixes(keyed, F.ceil(F.col("n") * PERCENT / 100), "rare")
            mixed = several_groups(shared, groups)
            rare = pairs_of(mixed)
            found = found.union(confirmed(rare, sets)).union(in_blocks(mixed.where(F.col("times") > LIST), sets))
        links = ws.keep(links.union(found), "links")
        ws.drop(sets)
        groups = components(ws, links)

    least = nodes.join(groups, "node", "left").select("set_key", "head", F.coalesce("component", "node").alias("component"))
    heads = least.groupBy("component").agg(F.min("head").alias("first"))
    answer = least.join(heads, "component").select("set_key", F.col("first.tl_id").alias("component_id"), F.col("first.seq").alias("first_seq"))
    out = signed.drop("signature").join(answer, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("tl_id")).otherwise(F.col("component_id"))
    out = out.withColumn("component_id", component).withColumn("kept", F.col("tl_id").eqNullSafe(F.col("component_id")))
    chosen = F.col("set_key").isNull() | (F.col("seq") == F.col("first_seq"))
    return out.select(*unboxed(carried), "n_shingles", "component_id", "kept", chosen.alias("chosen"))
