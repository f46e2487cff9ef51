"""Embedding near-duplicates by epsilon grid order join.

Vectors of length one are sorted by their grid cells on the leading principal dimensions. Intervals of the sorted
sequence form a tree; pairs of intervals are joined recursively from the top, and a pair whose bounding boxes are further
apart than epsilon is dropped with all below it. Spark joins down to tiles of neighbouring partitions; to a pair of these go the leaf
intervals of each whose own box is near the other's, and the recursion goes on inside the task. What is left at the leaves
is compared in double precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._graph import components
from ._work import discard, settle


@dataclass(frozen=True)
class Params:
    """cosine: least of a link. grid: leading principal dimensions of the grid order. leaf: vectors of a leaf interval.
    fan: intervals under one of the next level. interval: vectors of a sorted partition."""

    cosine: float = 0.95
    grid: int = 8
    leaf: int = 1024
    fan: int = 8
    interval: int = 8192


def _matrix(column) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones filled up with zeros."""
    rows = column.to_pylist()
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / np.where(scale > 0, scale, 1)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def principal(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes (columns, the leading one first) of the unit vectors, from sums over all of them."""

    def sums(batches):
        total = None
        for batch in batches:
            if len(batch):
                x = _unit(_matrix(batch.column(0)))
                x = np.hstack([np.ones((len(x), 1)), x])
                if total is None or len(total) < x.shape[1]:
                    grown = np.zeros((x.shape[1], x.shape[1]))
                    if total is not None:
                        grown[: len(total), : len(total)] = total
                    total = grown
                total[: x.shape[1], : x.shape[1]] += x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    found = classes.select("embedding").mapInArrow(B.frugal(sums), "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    size = int(found["i"].max()) + 1 if len(found) else 1
    moments = np.zeros((size, size))
    moments[found["i"], found["j"]] = found["v"]
    n = max(moments[0, 0], 1.0)
    mean = moments[0, 1:] / n
    _, axes = np.linalg.eigh(moments[1:, 1:] / n - np.outer(mean, mean))
    return mean, axes[:, ::-1]


def _forest(left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Edges (u, v) that connect what the pairs connect, at most one per node."""
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = place[: len(left)], place[len(left) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([ids[nodes[own]], ids[nodes[label[own]]]], axis=1)


def _blocks(params: Params, mean: np.ndarray, axes: np.ndarray):
    """Leaf intervals of a sorted partition, with their bounding boxes on all principal axes."""

    def work(batches):
        part, at, held = TaskContext.get().partitionId(), 0, []
        size = 0

        def emit(table):
            nonlocal at
            vectors = _matrix(table.column("embedding"))
            full = np.zeros((len(vectors), len(mean)))
            full[:, : vectors.shape[1]] = _unit(vectors)
            turned = (full - mean) @ axes
            narrow = (vectors == vectors.astype(np.float32)).all()
            row = (part, part << 32 | at, turned.min(axis=0), turned.max(axis=0), table.column("rep").to_numpy().tobytes(), table.column("n").to_numpy().tobytes(), np.array([len(x) for x in table.column("embedding").to_pylist()], np.int32).tobytes(), vectors.astype(np.float32 if narrow else np.float64).tobytes(), len(vectors), bool(narrow))
            at += 1
            names = ["part", "leaf", "low", "high", "reps", "counts", "sizes", "vectors", "rows", "narrow"]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= params.leaf:
                table = pa.Table.from_batches(held)
                while len(table) >= params.leaf:
                    yield emit(table.slice(0, params.leaf))
                    table = table.slice(params.leaf)
                held, size = table.to_batches(), len(table)
        if size:
            yield emit(pa.Table.from_batches(held))

    return work


_BLOCK = "part bigint, leaf bigint, low array<double>, high array<double>, reps binary, counts binary, sizes binary, vectors binary, `rows` int, narrow boolean"


def _near(limit: float):
    """Whether the boxes of a and b may hold vectors within epsilon: the squared gap summed over the axes."""
    gap = "greatest(x.al - x.bh, x.bl - x.ah, 0D)"
    return F.expr(f"aggregate(arrays_zip(al, ah, bl, bh), 0D, (s, x) -> s + {gap} * {gap}) <= {limit!r}")


def limit_of(params: Params) -> float:
    """Squared distance within which vectors of length one may be linked, with a margin for rounding."""
    return (2 - 2 * params.cosine) * (1 + 1e-9) + 1e-12


def _boxes(rows: DataFrame, node, width: int) -> DataFrame:
    """(node, low, high): the boxes around the rows' boxes, by node."""
    ends = [F.min(F.col("low")[i]).alias(f"l{i}") for i in range(width)] + [F.max(F.col("high")[i]).alias(f"h{i}") for i in range(width)]
    got = rows.groupBy(node.alias("node")).agg(*ends)
    return got.select("node", F.array(*[f"l{i}" for i in range(width)]).alias("low"), F.array(*[f"h{i}" for i in range(width)]).alias("high"))


def tile_pairs(boxes: DataFrame, tiles: int, params: Params) -> DataFrame:
    """(a, b, al, ah, bl, bh) of tiles, a <= b, that may hold links, with their boxes; boxes holds (tile, low, high) of
    leaves."""
    limit = limit_of(params)
    width = len(boxes.select("low").first()["low"])
    levels, rows, span = [], _boxes(boxes, F.col("tile"), width), tiles
    while True:
        levels.append(rows.withColumn("up", F.floor(F.col("node") / params.fan)))
        if span <= 1:
            break
        rows, span = _boxes(rows, F.floor(F.col("node") / params.fan), width), -(-span // params.fan)
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("low").alias("al"), F.col("high").alias("ah"), F.col("low").alias("bl"), F.col("high").alias("bh"))
    above = None
    for level in reversed(levels[:-1]):
        left = level.select(F.col("up").alias("a"), F.col("node").alias("ca"), F.col("low").alias("al"), F.col("high").alias("ah"))
        right = level.select(F.col("up").alias("b"), F.col("node").alias("cb"), F.col("low").alias("bl"), F.col("high").alias("bh"))
        joined = pairs.select("a", "b").join(left, "a").join(right, "b").where("ca <= cb").where(_near(limit))
        pairs = settle(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "al", "ah", "bl", "bh"), "pairs")
        discard(above)
        above = pairs
    return pairs


def sent_leaves(blocks: DataFrame, tiles: int, params: Params, *columns: str) -> DataFrame:
    """(a, b, tile, leaf, columns): the leaf intervals that a pair of tiles needs. A leaf goes to a pair only if its own box
    is near the other tile's."""
    pairs, limit = tile_pairs(blocks.select("tile", "low", "high"), tiles, params), limit_of(params)
    kept = ["a", "b", "tile", "leaf", "low", "high", *columns]
    own = blocks.select("tile", "leaf", "low", "high", *columns)
    first = own.join(pairs.select("a", "b", "bl", "bh"), own["tile"] == F.col("a")).withColumns({"al": F.col("low"), "ah": F.col("high")}).where(_near(limit)).select(*kept)
    second = own.join(pairs.where("a != b").select("a", "b", "al", "ah"), own["tile"] == F.col("b")).withColumns({"bl": F.col("low"), "bh": F.col("high")}).where(_near(limit)).select(*kept)
    return first.unionByName(second)


class Leaf:
    """A leaf interval, with its vectors brought to length one."""

    def __init__(self, row: dict):
        self.low, self.high = np.array(row["low"]), np.array(row["high"])
        self.reps, self.counts, self.sizes = np.frombuffer(row["reps"], np.int64), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["sizes"], np.int32)
        self.vectors = _unit(np.frombuffer(row["vectors"], np.float32 if row["narrow"] else np.float64).reshape(row["rows"], -1).astype(np.float64))

    def near(self, other: Leaf, limit: float) -> bool:
        gap = np.maximum(np.maximum(self.low - other.high, other.low - self.high), 0)
        return float((gap * gap).sum()) <= limit

    def links(self, other: Leaf, params: Params) -> tuple[np.ndarray, np.ndarray]:
        """What each class gains in linked vectors, and edges that connect what the links connect."""
        shared = min(self.vectors.shape[1], other.vectors.shape[1])
        link = self.vectors[:, :shared] @ other.vectors[:, :shared].T >= params.cosine
        if len(np.unique(np.concatenate([self.sizes, other.sizes]))) > 1:
            link &= self.sizes[:, None] == other.sizes[None, :]
        if self is other:
            np.fill_diagonal(link, False)
        p, q = np.nonzero(link)
        if not len(p):
            return np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
        gained = np.stack([self.reps, link @ other.counts], axis=1)
        if self is other:
            edges = _forest(p, q, self.reps)
        else:
            gained = np.concatenate([gained, np.stack([other.reps, link.T @ self.counts], axis=1)])
            edges = _forest(p, q + len(self.reps), np.concatenate([self.reps, other.reps]))
        return gained[gained[:, 1] > 0], edges


def _compare(params: Params):
    """Links between two tiles, or within one: leaves whose boxes are near are compared."""

    def work(key, table):
        a, b = (x.as_py() for x in key)
        rows = table.to_pylist()
        left = [Leaf(r) for r in rows if r["tile"] == a]
        right = left if a == b else [Leaf(r) for r in rows if r["tile"] == b]
        found = [x.links(y, params) for i, x in enumerate(left) for y in (left[i:] if a == b else right) if x.near(y, limit_of(params))]
        none = np.zeros((0, 2), np.int64)
        gained, edges = (np.concatenate([none, *(f[k] for f in found)]) for k in (0, 1))
        if len(gained):
            reps, place = np.unique(gained[:, 0], return_inverse=True)
            sums = np.zeros(len(reps), np.int64)
            np.add.at(sums, place, gained[:, 1])
            gained = np.stack([reps, sums], axis=1)
        u, v = np.concatenate([gained[:, 0], edges[:, 0]]), np.concatenate([gained[:, 1], edges[:, 1]])
        return pa.table({"edge": np.repeat([False, True], [len(gained), len(edges)]), "u": u, "v": v})

    return work


def _usable(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, embedding, usable) of each row."""
    rows = embeddings.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    return rows.withColumn("usable", usable)


def _classes(rows: DataFrame) -> DataFrame:
    """(embedding, rep, n) of each distinct usable vector."""
    return rows.where("usable").groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("n"))


def leaf_intervals(classes: DataFrame, total: int, params: Params) -> tuple[DataFrame, int]:
    """The settled leaf intervals of the sorted sequence with their tiles, and how many tiles there are."""
    spark = classes.sparkSession
    mean, axes = principal(classes)
    side, grid = math.sqrt(2 - 2 * params.cosine), min(params.grid, len(mean))

    def cells(batches):
        for batch in batches:
            vectors = _matrix(batch.column(0))
            full = np.zeros((len(vectors), len(mean)))
            full[:, : vectors.shape[1]] = _unit(vectors) if len(vectors) else vectors
            cell = np.floor((full - mean) @ axes[:, :grid] / side).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cell[:, i]) for i in range(grid))], names=[*batch.schema.names, *(f"c{i}" for i in range(grid))])

    order = [f"c{i}" for i in range(grid)] + ["rep"]
    celled = classes.mapInArrow(B.frugal(cells), "embedding array<double>, rep bigint, n bigint, " + ", ".join(f"c{i} bigint" for i in range(grid)))
    parts = max(1, -(-total // params.interval))
    sequence = celled.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("embedding", "rep", "n")
    made = settle(sequence.mapInArrow(B.frugal(_blocks(params, mean, axes)), _BLOCK), "blocks")
    # neighbouring partitions make tiles of about an interval; a row for each partition comes to the driver
    tile = made.groupBy("part").agg(F.sum("rows").alias("n")).toPandas().sort_values("part")
    tile["tile"] = (tile["n"].cumsum() - tile["n"]) // params.interval
    tile["tile"] = tile["tile"].rank(method="dense").astype("int64") - 1
    blocks = made.join(F.broadcast(spark.createDataFrame(tile[["part", "tile"]].astype("int64"))), "part").drop("part")
    tiles = int(tile["tile"].max()) + 1
    blocks.tallstrip_path = made.tallstrip_path
    return blocks, tiles


def skipping(embeddings: DataFrame, params: Params = Params(), *, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(leaves, tiles, possible, sent): leaf intervals, tiles, leaves that pairs of tiles would be sent if nothing were
    skipped, and leaves that are sent. One row; nothing is compared."""
    classes = settle(_classes(_usable(embeddings, id_column, vector_column)), "classes")
    total = classes.count()
    if not total:
        return embeddings.sparkSession.createDataFrame([(0, 0, 0, 0)], "leaves bigint, tiles bigint, possible bigint, sent bigint")
    blocks, tiles = leaf_intervals(classes, total, params)
    each = sent_leaves(blocks, tiles, params).select(F.lit(1).alias("sent"), F.lit(0).alias("leaf")).unionByName(blocks.select(F.lit(0).alias("sent"), F.lit(1).alias("leaf")))
    sums = each.agg(F.sum("leaf").alias("leaves"), F.sum("sent").alias("sent"))
    return sums.select("leaves", F.lit(tiles).cast("bigint").alias("tiles"), (F.col("leaves") * tiles).alias("possible"), "sent")


def similarity_classes(embeddings: DataFrame, params: Params = Params(), *, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, n_links, component_id) per row: other vectors with cosine >= params.cosine, and the smallest id reachable.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, and neither do
    vectors of different lengths, nor rows with a null id (whose component is null). Equal vectors are one class, with
    its smallest id and its size; links are counted in vectors, so copies are never spelled out in pairs. An id that
    repeats counts once for each of its rows. No rows give no rows; other columns are not read.
    """
    rows = _usable(embeddings, id_column, vector_column)
    classes = settle(_classes(rows), "classes")
    total = classes.count()
    if not total:
        return rows.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    blocks, tiles = leaf_intervals(classes, total, params)
    sent = sent_leaves(blocks, tiles, params, "reps", "counts", "sizes", "vectors", "rows", "narrow")
    found = settle(sent.groupBy("a", "b").applyInArrow(B.frugal(_compare(params)), "edge boolean, u bigint, v bigint"), "links")
    discard(blocks)
    gained = found.where("NOT edge").groupBy("u").agg(F.sum("v").alias("gained"))
    grouped = components(found.where("edge").select("u", "v"))
    labels = classes.join(gained, F.col("rep") == F.col("u"), "left").join(grouped, F.col("rep") == F.col("node"), "left")
    labels = labels.select(F.col("embedding").alias("vector"), (F.coalesce("gained", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component_id"))
    joined = rows.join(labels, F.when(F.col("usable"), F.col("embedding")) == F.col("vector"), "left")
    return joined.select(F.col("id").alias(id_column), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
