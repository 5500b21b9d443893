"""Near-duplicate embeddings by NN-descent.

A neighbour graph starts from a few random hyperplane tables: rows with equal signs are
compared in blocks of bounded size, each keeps its best neighbours. It is then refined:
at every node the neighbours, in both directions, are compared with each other, and each
keeps what improves its list. A list whose entries all reach the threshold is saturated
and enlarged. An audit compares a fixed number of rows with all rows; while too few of
their links are reached, the graph gets another table and another round.

Edges at the threshold give candidate classes. The graph and its audit decide no result,
only which rows are packed together: a large class has blocks of its own, the rest is
dealt out. Every block has a centre and the largest angle to it. All pairs of blocks
that these angles let hold a link are compared, in double precision wherever single
precision comes near the threshold. That gives the exact number of links and a spanning
forest of exact links, and from these the final classes. Equal vectors are one node with
a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermem.llm.common import cut_lineage
from tiermem.llm.components import components
from tiermem.llm.top_k import usable

LIST = 10
ENLARGED = 40
TABLES = 4
LEAF = 192
HUB = 60
PACK = 1024
CELLS = 1 << 19
SIDES = 12
AUDITED = 200
SLACK = 1e-4
NONE = np.iinfo(np.int64).min


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cells(column: pa.Array, kind) -> np.ndarray:
    """Packed vectors of one width as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _nodes(vectors: DataFrame, width: int, kind: type) -> DataFrame:
    """node, ``exact`` (components as they are, of type ``kind``, padded to ``width``) and ``unit`` (normed, single precision)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths()).astype(np.int64)
            x = np.zeros((batch.num_rows, width))
            flat = np.asarray(batch.column(1).flatten()).astype(np.float64)
            x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            unit = _unit(x).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "exact": pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()),
                                              "unit": pa.array([r.tobytes() for r in unit], pa.binary())})

    return vectors.select("node", "vector").mapInArrow(run, "node bigint, exact binary, unit binary")


def _grouped(rows: DataFrame, key: str, step, schema: str) -> DataFrame:
    """``step(columns)`` for the rows of each key; rows of a key are sorted into one task. Keys must be of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = np.asarray(held.column(0).combine_chunks())
            last = int(np.searchsorted(keys, keys[-1])) if held.num_rows else 0
            yield from emit(held.slice(0, last), keys[:last])
            held = held.slice(last)
        if held is not None and held.num_rows:
            yield from emit(held, np.asarray(held.column(0).combine_chunks()))

    def emit(table: pa.Table, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        table = table.combine_chunks()
        cuts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
        found = step(table, cuts)
        if found is not None:
            yield found

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _edges(a: list[np.ndarray], b: list[np.ndarray], s: list[np.ndarray]) -> pa.RecordBatch | None:
    if not a:
        return None
    return pa.RecordBatch.from_pydict({"node": pa.array(np.concatenate(a)), "other": pa.array(np.concatenate(b)),
                                       "sim": pa.array(np.concatenate(s).astype(np.float32))})


def _table_edges(nodes: DataFrame, count: int, width: int, first: int, tables: int) -> DataFrame:
    """Best neighbours within the leaves of some hyperplane tables; a crowded leaf is cut by a hash of the node."""
    bits = max(1, int(np.ceil(np.log2(max(2, count) / LEAF * 2))))
    planes = np.random.default_rng(first).normal(size=(tables, width, bits)).astype(np.float32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(bits)).astype(np.int64)
        for batch in batches:
            x = _cells(batch.column(1), np.float32)
            for t in range(tables):
                leaf = ((x @ planes[t]) > 0) @ weights * tables + t
                yield pa.RecordBatch.from_pydict({"leaf": pa.array(leaf), "node": batch.column(0), "unit": batch.column(1)})

    signed = nodes.select("node", "unit").mapInArrow(sign, "leaf bigint, node bigint, unit binary")
    sizes = signed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / LEAF).alias("salts"))
    cut = signed.join(sizes, "leaf").select(
        F.xxhash64("leaf", F.pmod(F.xxhash64("node", F.lit(first)), F.col("salts"))).alias("key"), "node", "unit")

    def best(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch | None:
        ids, x = np.asarray(table.column("node").combine_chunks()), _cells(table.column("unit").combine_chunks(), np.float32)
        a, b, s = [], [], []
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j - i < 2:
                continue
            sims = x[i:j] @ x[i:j].T
            np.fill_diagonal(sims, -2)
            k = min(LIST, j - i - 1)
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            a.append(np.repeat(ids[i:j], k))
            b.append(ids[i:j][near].ravel())
            s.append(np.take_along_axis(sims, near, 1).ravel())
        return _edges(a, b, s)

    return _grouped(cut, "key", best, "node bigint, other bigint, sim float")


def _lists(edges: DataFrame, threshold: float) -> DataFrame:
    """The best of each node's candidates; a list that reaches the threshold throughout is enlarged."""
    best = edges.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("sim", "other")), asc=False).alias("all"))
    full = F.coalesce(F.get("all", F.lit(LIST - 1))["sim"] >= threshold, F.lit(False))
    kept = F.slice("all", 1, F.when(full, ENLARGED).otherwise(LIST))
    return best.select("node", kept.alias("list"))


def _descend(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """New edges from comparing, at every node, the node's neighbours in both directions with each other.

    A hub is cut into parts by a hash, so no node's meeting grows with the data.
    """
    flat = graph.select("node", F.explode("list").alias("e")).select("node", F.col("e.other").alias("other"))
    meet = flat.unionByName(flat.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    sizes = meet.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / HUB).alias("salts"))
    worst = graph.select(F.col("node").alias("other"), F.when(F.size("list") < LIST, F.lit(-1.0)).otherwise(
        F.element_at("list", -1)["sim"]).cast("float").alias("worst"))
    meet = meet.join(sizes, "node").select(
        F.xxhash64("node", F.pmod(F.xxhash64("node", "other"), F.col("salts"))).alias("key"), "other")
    meet = meet.join(worst.join(nodes.select(F.col("node").alias("other"), "unit"), "other"), "other").select("key", "other", "worst", "unit")

    def join(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch | None:
        ids, floor = (np.asarray(table.column(c).combine_chunks()) for c in ("other", "worst"))
        x = _cells(table.column("unit").combine_chunks(), np.float32)
        a, b, s = [], [], []
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j - i < 2:
                continue
            sims = x[i:j] @ x[i:j].T
            np.fill_diagonal(sims, -2)
            p, q = np.nonzero(sims > floor[i:j, None])
            if len(p):
                a.append(ids[i:j][p])
                b.append(ids[i:j][q])
                s.append(sims[p, q])
        return _edges(a, b, s)

    return _grouped(meet, "key", join, "node bigint, other bigint, sim float")


def _audit(nodes: DataFrame, classes: DataFrame, count: int, threshold: float) -> float:
    """Share of the links of a fixed number of rows, found by comparing them with all rows, whose ends are in one class."""
    share = min(1.0, AUDITED / max(1, count))
    asked = nodes.filter(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 30)) < int(share * (1 << 30))).select("node", "unit").collect()
    if not asked:
        return 1.0
    ids = np.array([r[0] for r in asked])
    wanted = nodes.sparkSession.sparkContext.broadcast((ids, np.stack([np.frombuffer(r[1], np.float32) for r in asked])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = wanted.value
        for batch in batches:
            sims = _cells(batch.column(1), np.float32) @ q.T
            p, r = np.nonzero(sims >= threshold)
            found = np.asarray(batch.column(0))[p]
            keep = found != own[r]
            yield pa.RecordBatch.from_pydict({"a": pa.array(own[r][keep]), "b": pa.array(found[keep])})

    links = nodes.select("node", "unit").mapInArrow(run, "a bigint, b bigint")
    left = classes.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    right = classes.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    met = links.join(left, "a", "left").join(right, "b", "left").agg(
        F.count(F.lit(1)), F.sum(F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).cast("int"))).first()
    return met[1] / met[0] if met[0] else 1.0


def _packed(nodes: DataFrame, classes: DataFrame, count: int, width: int, kind: type) -> DataFrame:
    """All nodes in blocks with a centre and the largest angle to it.

    A class of half a block or more has blocks of its own; the other nodes are dealt out by a hash.
    """
    most = max(PACK, min(CELLS // width, -(-count // SIDES)))
    large = cut_lineage(classes.groupBy("component").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= most / 2))
    rest = count - (large.agg(F.sum("members")).first()[0] or 0)
    parts, draw = F.ceil(F.col("members") / most), F.xxhash64("node", F.lit("block"))
    placed = nodes.join(classes, "node", "left").join(F.broadcast(large), "component", "left")  # at most twice as many as blocks
    block = F.when(F.col("members").isNotNull(), F.xxhash64("component", F.pmod(draw, parts))).otherwise(
        F.pmod(draw, F.lit(max(1, -(-rest // most)))))

    def pack(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        keys, ids, weights = (np.asarray(table.column(c).combine_chunks()) for c in ("block", "node", "weight"))
        exact = _cells(table.column("exact").combine_chunks(), kind)
        centres, angles, spans = [], [], list(zip(cuts[:-1], cuts[1:]))
        for i, j in spans:
            x = _unit(exact[i:j].astype(np.float64))
            centre = x.mean(0)
            centre /= max(np.sqrt(centre @ centre), 1e-12)
            centres.append(centre.tobytes())
            angles.append(float(np.arccos(np.clip(x @ centre, -1, 1).min())))
        packs = ([x[i:j].tobytes() for i, j in spans] for x in (ids, weights, exact))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[cuts[:-1]]), *(pa.array(x, pa.binary()) for x in packs), pa.array(centres, pa.binary()), pa.array(angles)],
            names=["block", "ids", "weights", "cells", "centre", "angle"])

    return _grouped(placed.select(block.alias("block"), "node", "weight", "exact"), "block", pack,
                    "block bigint, ids binary, weights binary, cells binary, centre binary, angle double")


def _counted(packed: DataFrame, width: int, kind: type, threshold: float) -> DataFrame:
    """Links of every node (weighted, in parts) and links of a spanning forest (``other``) from all pairs of blocks.

    Only pairs whose angle, less the blocks' own, is too wide for a link are left out. A pair is the key
    of its meeting, so the pairs of one class spread over tasks.
    """
    known = packed.select("block", "centre", "angle").collect()  # a row per block
    centres = np.array([np.frombuffer(r[1]) for r in known]).reshape(-1, width)
    angles = np.array([r[2] for r in known])
    near = np.arccos(np.clip(centres @ centres.T, -1, 1)) - angles[:, None] - angles <= np.arccos(np.clip(threshold, -1, 1)) + 1e-6
    near = near | near.T | np.eye(len(known), dtype=bool)
    plan = [(r[0], [min(i, int(j)) * len(known) + max(i, int(j)) for j in np.flatnonzero(near[i])]) for i, r in enumerate(known)]
    plan = packed.sparkSession.createDataFrame(plan, "block long, pairs array<bigint>")
    sent = packed.join(F.broadcast(plan), "block").select(F.explode("pairs").alias("pair"), "ids", "weights", "cells")

    def meet(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch | None:
        ids, weights, cells = (table.column(c) for c in ("ids", "weights", "cells"))
        node, links, other = [], [], []

        def block(at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = np.frombuffer(cells[at].as_py(), kind).reshape(-1, width).astype(np.float64)
            return np.frombuffer(ids[at].as_py(), np.int64), np.frombuffer(weights[at].as_py(), np.int64), _unit(x)

        for i, j in zip(cuts[:-1], cuts[1:]):
            for n, k, o in _links(block(i), block(i + 1) if j - i > 1 else None, threshold):
                node.append(n)
                links.append(k)
                other.append(o)
        if not node:
            return None
        other = np.concatenate(other)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(node)), pa.array(np.concatenate(links)), pa.array(other, mask=other == NONE)],
                                          names=["node", "links", "other"])

    return _grouped(sent, "pair", meet, "node bigint, links bigint, other bigint")


def _links(a: tuple, b: tuple | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Node, links and forest link (or ``NONE``) of the rows of two blocks, or of one with itself, that have a link."""
    own = b is None
    (ia, wa, xa), (ib, wb, xb) = a, a if own else b
    ra, rb = xa.astype(np.float32), xb.astype(np.float32)
    links_a = np.zeros(len(ia), np.int64)
    links_b = links_a if own else np.zeros(len(ib), np.int64)
    for p in range(0, len(ia), PACK):
        for q in range(p if own else 0, len(ib), PACK):
            same, rows, cols = own and p == q, slice(p, p + PACK), slice(q, q + PACK)
            rough = ra[rows] @ rb[cols].T
            if same:
                np.fill_diagonal(rough, -2)
            if rough.max() < threshold - SLACK:
                continue
            hit = xa[rows] @ xb[cols].T >= threshold
            if same:
                np.fill_diagonal(hit, False)
            links_a[rows] += hit @ wb[cols]
            if not same:
                links_b[cols] += wa[rows] @ hit
            up, down = _spanning(hit, same)
            found = np.flatnonzero(up >= 0)
            yield ia[rows][found], np.zeros(len(found), np.int64), ib[cols][up[found]]
            if not same:
                found = np.flatnonzero(down >= 0)
                yield ib[cols][found], np.zeros(len(found), np.int64), ia[rows][down[found]]
    for ids, links in ((ia, links_a), *(() if own else ((ib, links_b),))):
        found = np.flatnonzero(links)
        yield ids[found], links[found], np.full(len(found), NONE)


def _spanning(hit: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """For every row its column, and for every column its row, in a spanning forest of the links; -1 for roots."""
    n, m = hit.shape
    parent_a, parent_b = np.full(n, -1), np.full(m, -1)
    seen_a, seen_b = np.zeros(n, bool), np.zeros(m, bool)
    for root in np.flatnonzero(hit.any(1)):
        if seen_a[root]:
            continue
        seen_a[root] = True
        if own:
            seen_b[root] = True
        front = np.array([root])
        while len(front):                       # breadth first: columns the rows reach, then rows these reach
            reach = hit[front]
            new = np.flatnonzero(reach.any(0) & ~seen_b)
            if not len(new):
                break
            parent_b[new] = front[reach[:, new].argmax(0)]
            seen_b[new] = True
            if own:
                parent_a[new] = parent_b[new]
                seen_a[new] = True
                front = new
            else:
                back = hit[:, new]
                rows = np.flatnonzero(back.any(1) & ~seen_a)
                parent_a[rows] = new[back[rows].argmax(1)]
                seen_a[rows] = True
                front = rows
    return parent_a, parent_b


def near_classes(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.99, rounds: int = 4,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links`` (other ids linked directly), ``component_id`` (smallest id reachable) and ``kept`` of every row.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing.
    Shorter vectors count as padded with zeros. Rows that share an id count as one vector,
    the least; each row gets the result. A row without an id links with nothing. Only the id and
    the vector are read. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    good = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    good = good.groupBy("id").agg(F.min("vector").alias("vector"))
    same = good.groupBy("vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight"))
    same = cut_lineage(same)
    classed = good.join(same.select("vector", "node"), "vector")
    count, width = same.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    width = width or 1
    kind = np.float32 if rows.schema["vector"].dataType.elementType.typeName() == "float" else np.float64
    nodes = cut_lineage(_nodes(same, width, kind).join(same.select("node", "weight"), "node"))

    graph = cut_lineage(_lists(_table_edges(nodes, count, width, 1, TABLES), threshold))
    loose, enough = threshold - SLACK, False
    for step in range(1, rounds + 1):
        grown = _descend(graph, nodes, threshold)
        old = graph.select("node", F.explode("list").alias("e")).select("node", F.col("e.other").alias("other"), F.col("e.sim").alias("sim"))
        edges = old.unionByName(grown)
        if step > 1:
            edges = edges.unionByName(_table_edges(nodes, count, width, step, 1))
        graph = cut_lineage(_lists(edges, threshold))
        close = graph.select(F.col("node").alias("a"), F.explode("list").alias("e")).filter(F.col("e.sim") >= loose)
        classes = cut_lineage(components(close.select("a", F.col("e.other").alias("b"))))
        if _audit(nodes, classes, count, threshold) >= recall:
            break

    packed = cut_lineage(_packed(nodes, classes, count, width, kind))
    counted = cut_lineage(_counted(packed, width, kind, threshold))
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(counted.filter(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")))
    result = nodes.select("node", "weight").join(links, "node", "left").join(found, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    by_id = classed.select(F.col("id").alias("id_"), "node").join(result, "node")
    out = rows.select("id").join(by_id, rows["id"] == by_id["id_"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
