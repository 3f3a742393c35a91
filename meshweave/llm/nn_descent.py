"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours.

Equal vectors count as one node with a multiplicity. The first graph joins nodes that fall
into the same cell of random sign codes, as many codes as bring two linked nodes together
with a chance of 1 - MISS. Each round brings the neighbours of every node together, both
those that it lists and those that list it, and offers each to the others; lists keep the
nearest. A list whose last entry is still a link is saturated, and doubles. Edges at the
threshold are kept as soon as they are seen. Nodes whose lists stay saturated at the
greatest length are crowded: they are compared with each other in blocks. An audit then
compares a sample of nodes with all; where its recall misses the goal, all nodes of a
label are compared in blocks instead.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, dropped, written

#: Neighbours in a list, at first and at most.
LIST, LIST_MOST = 8, 64
#: Nodes that a cell of a sign code is meant to hold and may hold, and the chance of a link to share none of the cells.
CELL, CELL_MOST, MISS = 48, 192, 1e-3
#: Rounds at most, and the share of changed entries below which a round without new links is the last.
ROUNDS, CHANGED = 8, 0.1
#: Nodes that the audit compares with all others, of those with links and of those without, and the recall it asks for.
AUDITED, GOAL = 256, 0.99
#: Least and greatest block in which nodes are compared, and copies made of a node at most in between.
BLOCK_LEAST, BLOCK_MOST, BLOCK_COPIES = 64, 2048, 8


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list array as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of sorted batches, whole."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, new]) if held is not None else new
        held = held.combine_chunks()
        at = [held.column(k).to_numpy() for k in keys]
        change = np.zeros(held.num_rows - 1, bool)
        for x in at:
            change |= x[1:] != x[:-1]
        cuts = np.r_[0, np.flatnonzero(change) + 1]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield held.slice(a, b - a)
        held = held.slice(int(cuts[-1]))
    if held is not None:
        yield held


def _edges(src: list, dst: list, sim: list) -> pa.RecordBatch:
    one = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))
    return pa.RecordBatch.from_arrays([one(src, np.int64), one(dst, np.int64), one(sim, np.float64)], ["src", "dst", "sim"])


EDGE = "src long, dst long, sim double"


def _first_graph(nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges within cells of random sign codes. A crowded cell is dealt into parts by a hash of the node: other codes and the rounds join them."""
    sizes = nodes.groupBy("part").agg(F.count("*").alias("n"))
    bits = F.greatest(F.lit(0), F.least(F.lit(30), F.ceil(F.log2(F.col("n") / F.lit(float(CELL)))))).cast("int")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = 1 - math.acos(min(threshold, 1.0)) / math.pi  # the chance of one bit to be equal
        for batch in batches:
            part, bits_, wide = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.int64), batch.column(3)
            codes = np.ceil(math.log(MISS) / np.log1p(-np.minimum(together**bits_, 1 - MISS))).astype(np.int64)
            lengths = np.diff(wide.offsets.to_numpy())
            for d in np.unique(lengths):
                for t in range(int(codes[lengths == d].max())):
                    rows = np.flatnonzero((lengths == d) & (codes > t))
                    some = wide.take(pa.array(rows))
                    planes = np.random.default_rng([t, int(d)]).normal(size=(int(d), 30))
                    found = ((_unit(some) @ planes) > 0) @ (1 << np.arange(30)) & (1 << bits_[rows]) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(part[rows]), pa.array(found << 8 | t), batch.column(1).take(pa.array(rows)), some], ["part", "cell", "node", "v"])

    coded = nodes.join(sizes.select("part", bits.alias("bits")), "part").select("part", "node", "bits", "v").mapInArrow(code, "part long, cell long, node long, v array<float>")
    coded = written(coded, "coded")
    crowd = coded.groupBy("part", "cell").agg(F.ceil(F.count("*") / CELL_MOST).alias("m")).where("m > 1")
    dealt = coded.join(crowd, ["part", "cell"], "left").withColumn("deal", F.pmod(F.xxhash64("node", "cell"), F.coalesce("m", F.lit(1))))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, sim = [], [], []
        for group in _groups(batches, ["part", "cell", "deal"]):
            n = group.num_rows
            if n < 2:
                continue
            x, ids = _unit(group.column("v").combine_chunks()), group.column("node").to_numpy()
            s = x @ x.T
            np.fill_diagonal(s, -2)
            top = np.argpartition(-s, min(LIST, n - 1) - 1, axis=1)[:, : min(LIST, n - 1)]
            src.append(np.repeat(ids, top.shape[1]))
            dst.append(ids[top].ravel())
            sim.append(np.take_along_axis(s, top, 1).ravel())
            if len(src) >= 200:
                yield _edges(src, dst, sim)
                src, dst, sim = [], [], []
        yield _edges(src, dst, sim)

    keys = ["part", "cell", "deal"]
    dealt = dealt.select(*keys, "node", "v").repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.mapInArrow(within, EDGE).withColumn("fresh", F.lit(True)).withColumn("room", F.lit(LIST))
    graph = written(_nearest(found, threshold), "graph")
    dropped(coded)
    return graph


def _nearest(edges: DataFrame, threshold: float) -> DataFrame:
    """The nearest of each list, as many as it has room for. Where all of them are links, the room doubles and all count as fresh again."""
    own = Window.partitionBy("src")
    best = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"), F.max("room").alias("room"))
    kept = best.withColumn("room", F.max("room").over(own)).withColumn("r", F.row_number().over(own.orderBy(F.col("sim").desc(), "dst"))).where("r <= room").drop("r")
    grows = (F.sum((F.col("sim") >= threshold).cast("int")).over(own) >= F.col("room")) & (F.col("room") < LIST_MOST)
    return kept.withColumn("grows", grows).select("src", "dst", "sim", (F.col("fresh") | F.col("grows")).alias("fresh"), F.when(F.col("grows"), F.least(F.col("room") * 2, F.lit(LIST_MOST))).otherwise(F.col("room")).alias("room"))


def _offers(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """Edges between members of the same neighbourhood that would enter a list.

    Only neighbourhoods with a fresh edge meet, and only pairs with a fresh member. Of the
    nodes that list a node, the nearest ``LIST`` come too.
    """
    floor = graph.groupBy("src").agg(F.when(F.count("*") >= F.max("room"), F.min("sim")).otherwise(F.lit(-2.0)).alias("floor"))
    back = graph.select(F.col("dst").alias("at"), F.col("src").alias("node"), "sim", "fresh")
    order = Window.partitionBy("at").orderBy(F.col("sim").desc(), "node")
    back = back.withColumn("r", F.row_number().over(order)).where(F.col("r") <= LIST).select("at", "node", "fresh")
    members = graph.select(F.col("src").alias("at"), F.col("dst").alias("node"), "fresh").union(back).groupBy("at", "node").agg(F.max("fresh").alias("fresh"))
    busy = members.where("fresh").select("at").distinct()
    members = members.join(busy, "at")
    known = nodes.join(floor, nodes["node"] == floor["src"], "left").select("node", "v", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    met = members.join(known, "node").select("at", "node", "fresh", "floor", "v").repartition("at").sortWithinPartitions("at")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, sim = [], [], []
        for group in _groups(batches, ["at"]):
            if group.num_rows < 2:
                continue
            x, ids = _unit(group.column("v").combine_chunks()), group.column("node").to_numpy()
            fresh, low = group.column("fresh").to_numpy(), group.column("floor").to_numpy()
            s = x @ x.T
            good = (s > low[:, None]) & (fresh[:, None] | fresh[None])
            np.fill_diagonal(good, False)
            a, b = np.nonzero(good)
            src.append(ids[a])
            dst.append(ids[b])
            sim.append(s[a, b])
            if len(src) >= 200:
                yield _edges(src, dst, sim)
                src, dst, sim = [], [], []
        yield _edges(src, dst, sim)

    return met.mapInArrow(join, EDGE)


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges enough to connect what the symmetric ``near`` connects: one less than each group's members."""
    rest, a, b = np.ones(len(near), bool), [], []
    for start in range(len(near)):
        todo = [start] if rest[start] else []
        rest[start] = False
        while todo:
            one = todo.pop()
            found = np.flatnonzero(near[one] & rest)
            rest[found] = False
            todo += found.tolist()
            a.append(np.full(len(found), one))
            b.append(found)
    return np.concatenate(a), np.concatenate(b)


def _compared(nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(node, linked, other), by comparing every two nodes of a part in blocks.

    The sums of linked are the multiplicities of the nodes linked to each; other, where
    not null, is a node of another component that links reach, enough of them to connect
    all that links connect beyond ``roots``. The nodes of a part are dealt into blocks by
    hash; every two blocks meet in a group of their own, which gives a number for each
    node, and fewer edges than it has nodes.
    """
    sizes = nodes.groupBy("part").agg(F.count("*").alias("n"))
    most = F.greatest(F.lit(BLOCK_LEAST), F.least(F.lit(BLOCK_MOST), F.ceil(F.col("n") / BLOCK_COPIES)))
    placed = nodes.join(sizes, "part").withColumn("m", F.ceil(F.col("n") / most)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("m")))
    placed = placed.join(roots, "node", "left").select("part", "node", F.coalesce("root", "node").alias("root"), "copies", "v", "m", "block")
    pairs = written(placed, "placed").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    keys = ["part", "low", "high"]
    pairs = pairs.select("part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root", "copies", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            x, node, copies = _unit(group.column("v").combine_chunks()), group.column("node").to_numpy(), group.column("copies").to_numpy()
            block, root = group.column("block").to_numpy(), group.column("root").to_numpy()
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            near = x @ x.T >= threshold
            near |= near.T
            np.fill_diagonal(near, False)
            if low != high:
                near &= block[:, None] != block[None]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array((near @ copies).astype(np.int64)), pa.nulls(len(node), pa.int64())], ["node", "linked", "other"])
            if (near & (root[:, None] != root[None])).any():
                a, b = _forest(near)
                differ = root[a] != root[b]
                a, b = a[differ], b[differ]
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(np.zeros(len(a), np.int64)), pa.array(node[b])], ["node", "linked", "other"])

    found = pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "node long, linked long, other long")
    return written(found, "compared")


def _audited(nodes: DataFrame, counted: DataFrame, threshold: float) -> float:
    """The share of its links that a node with links has on average, by comparing a sample with all nodes.

    The sample, by hash, is AUDITED nodes with links found and as many without: the only rows
    that the driver sees. ``counted(node, linked)`` holds what was found.
    """
    known = nodes.join(counted, "node", "left").select("part", "node", "v", F.coalesce("linked", F.lit(0)).alias("linked"))
    strata = [known.where("linked > 0"), known.where("linked = 0")]
    samples = [x.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(AUDITED).collect() for x in strata]
    sizes = [x.count() for x in strata]
    rows = [r for sample in samples for r in sample]
    if not rows:
        return 1.0
    by_part: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for key in {(r.part, len(r.v)) for r in rows}:
        some = [r for r in rows if (r.part, len(r.v)) == key]
        by_part[key] = np.array([r.node for r in some]), _unit(pa.array([r.v for r in some], pa.list_(pa.float32())))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, node, copies, wide = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            lengths = np.diff(wide.offsets.to_numpy())
            for (p, d), (asked, x) in by_part.items():
                at = np.flatnonzero((part == p) & (lengths == d))
                if len(at):
                    near = (_unit(wide.take(pa.array(at))) @ x.T >= threshold) & (node[at][:, None] != asked[None])
                    yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(copies[at] @ near)], ["node", "exact"])

    found = nodes.select("part", "node", "copies", "v").mapInArrow(compare, "node long, exact long").groupBy("node").agg(F.sum("exact").alias("exact"))
    exact = {r.node: r.exact for r in found.collect()}
    share = whole = 0.0
    for sample, size in zip(samples, sizes):
        for r in sample:
            if exact[r.node]:
                whole += size / len(sample)
                share += size / len(sample) * min(1.0, r.linked / exact[r.node])
    return share / whole if whole else 1.0


def link_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) for every row of ``vectors(vec_id long, embedding array<float>, label)``.

    Rows are compared by cosine in double precision when their labels are equal and not
    null, and their lengths equal. Null, empty and zero vectors, those with a null or
    non-finite component, and rows without an id link with nothing: n_links 0, component_id
    = vec_id. Rows that repeat an id are vectors of their own; ties of cosine go by id. An
    empty table gives none; other columns are not read. audited_recall is what the audit
    found; 1 where the exact search took over.
    """
    x = F.col("embedding")
    sound = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0)
        & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0),
        F.lit(False),
    )
    rows = written(
        vectors.select("vec_id", x.alias("v"), sound.alias("sound"), F.xxhash64("label", F.size(x)).alias("part"), F.xxhash64(x).alias("h1"), F.xxhash64(F.reverse(x), F.lit(1)).alias("h2")),
        "vectors",
    )
    equal = ["part", "h1", "h2"]
    nodes = written(rows.where("sound").groupBy(*equal).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v")), "nodes")
    graph = _first_graph(nodes, threshold)
    is_link = F.col("sim") >= threshold
    found = [written(graph.where(is_link).select("src", "dst"), "links")]
    for _ in range(ROUNDS):
        old = graph.withColumn("fresh", F.lit(False))
        offers = _offers(nodes, graph).withColumn("fresh", F.lit(True)).withColumn("room", F.lit(LIST))
        new = written(_nearest(old.unionByName(offers), threshold), "graph")
        dropped(graph)
        graph = new
        found.append(written(graph.where(is_link & F.col("fresh")).select("src", "dst"), "links"))
        entries = graph.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("fresh").cast("int")), F.lit(0)).alias("fresh")).first()
        if found[-1].isEmpty() and entries["fresh"] <= CHANGED * entries["n"]:
            break
    crowded = graph.groupBy("src").agg((F.sum(is_link.cast("int")) >= LIST_MOST).alias("crowded")).where("crowded").select(F.col("src").alias("node"), "crowded")
    crowded = written(crowded, "crowded")
    one = functools.reduce(DataFrame.union, found)
    links = written(one.union(one.select("dst", "src")).distinct().select(F.col("src").alias("a"), F.col("dst").alias("b")), "links")
    dropped(graph, *found)

    # Links of a crowded node to other crowded ones come from the blocks, all other links from the graph.
    by_end = nodes.select("node", "copies").join(crowded, "node", "left")
    ends = links.join(by_end.select(F.col("node").alias("a"), F.col("crowded").alias("a_crowded")), "a").join(by_end.select(F.col("node").alias("b"), "copies", F.col("crowded").alias("b_crowded")), "b")
    counted = ends.where("a_crowded is null or b_crowded is null").select(F.col("a").alias("node"), F.col("copies").alias("linked"))
    roots = components(links)
    beyond = None
    if not crowded.isEmpty():
        compared = _compared(nodes.join(crowded.select("node"), "node"), roots, threshold)
        counted = counted.union(compared.select("node", "linked"))
        beyond = compared.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    counted = written(counted.groupBy("node").agg(F.sum("linked").alias("linked")), "counted")
    recall = _audited(nodes, counted, threshold)
    if recall < GOAL:
        compared = _compared(nodes, roots, threshold)
        counted = compared.groupBy("node").agg(F.sum("linked").alias("linked"))
        beyond, recall = compared.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), 1.0
    if beyond is not None and not beyond.isEmpty():
        roots = components(beyond.union(roots.select("node", "root")))
    named = written(
        nodes.drop("v").join(roots, "node", "left").join(counted, "node", "left")
        .select(*equal, (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id")),
        "named",
    )
    out = rows.select("vec_id", *(F.when(F.col("sound"), F.col(c)).alias(c) for c in equal)).join(named, equal, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).alias("audited_recall"),
    )
