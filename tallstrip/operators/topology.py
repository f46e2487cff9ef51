"""Connected components, islands and holes on runs.

A mask is its horizontal runs, so adjacency is an equi-join of neighbouring rows with an overlap test, and the graph has
a node per run. Runs are first joined up within bands of rows, each a task's union-find; what is left, edges between
bands, goes through star rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import touches_border
from ..sources.raster import runs as runs_of
from ..work import settle
from .components import components as connected

#: Rows of a band that one task joins up.
BAND_ROWS = 4096


def run_ids(runs: DataFrame) -> DataFrame:
    """Runs with an id that no other run of their raster has: row and first pixel in one number."""
    return runs.withColumn("id", F.shiftleft(F.col("y").cast("long"), 31) + F.col("x0"))


def adjacency(runs: DataFrame, connectivity: int = 8, keys: tuple[str, ...] = ("img",)) -> DataFrame:
    """(u, v): runs of neighbouring rows that touch, diagonally too for connectivity 8."""
    c = 1 if connectivity == 8 else 0
    upper = runs.select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.struct(*keys, "id").alias("u"))
    return upper.join(runs, [*keys, "y"]).where((F.col("x0") < F.col("a1") + c) & (F.col("x1") > F.col("a0") - c)).select("u", F.struct(*keys, "id").alias("v"))


def joined_up(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, connectivity: int) -> np.ndarray:
    """For each run, in order of rows and pixels, the place of one run of its component."""
    c = 1 if connectivity == 8 else 0
    # y and x0 as one number: a run's neighbours below are a slice
    scale = int(x1.max()) + 3
    first = np.searchsorted((y.astype(np.int64)) * scale + x1, (y.astype(np.int64) + 1) * scale + x0 - c, "right")
    last = np.searchsorted((y.astype(np.int64)) * scale + x0, (y.astype(np.int64) + 1) * scale + x1 + c, "left")
    count = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(y)), count)
    b = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
    label = np.arange(len(y))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _labels_in_band(connectivity: int):
    def work(key, table):
        table = table.sort_by([("y", "ascending"), ("x0", "ascending")])
        y, x0, x1, ids = (table.column(n).to_numpy() for n in ("y", "x0", "x1", "id"))
        return table.append_column("local", pa.array(ids[joined_up(y, x0, x1, connectivity)]))

    return work


def label(runs: DataFrame, connectivity: int = 8, band_rows: int = BAND_ROWS, keys: tuple[str, ...] = ("img",), out: str = "comp") -> DataFrame:
    """The runs (keys, y, x0, x1) with `out`, the same for runs of one component; each combination of keys is a raster of
    its own, and the result doesn't depend on the bands."""
    own = run_ids(runs.select(*keys, *[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")])).withColumn("band", F.floor(F.col("y") / band_rows))
    kinds = ", ".join(f"{k} {runs.schema[k].dataType.simpleString()}" for k in keys)
    local = settle(own.groupBy(*keys, "band").applyInArrow(_labels_in_band(connectivity), f"{kinds}, y int, x0 int, x1 int, id bigint, band bigint, local bigint"), "bands")
    seam = local.where((F.col("y") % band_rows == 0) | (F.col("y") % band_rows == band_rows - 1))
    edges = adjacency(seam.withColumn("id", F.col("local")), connectivity, keys).where("u != v").distinct()
    joined = connected(edges).select(F.col("node.id").alias("local"), F.col("component.id").alias("whole"), *[F.col(f"node.{k}").alias(k) for k in keys])
    return local.join(joined, [*keys, "local"], "left").select(*keys, "y", "x0", "x1", F.coalesce("whole", "local").alias(out))


def component_stats(labelled: DataFrame) -> DataFrame:
    """(img, comp, x, y, w, h, area, cx, cy)."""
    n = F.col("x1") - F.col("x0")
    got = labelled.groupBy("img", "comp").agg(F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y") + 1 - F.min("y")).alias("h"), F.sum(n).cast("long").alias("area"), (F.sum((F.col("x0") + F.col("x1") - 1) / 2.0 * n) / F.sum(n)).alias("cx"), (F.sum(F.col("y") * n) / F.sum(n)).alias("cy"))
    return got


def landlocked(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """The stats of components that touch no side of their image; sizes holds (img, width, height)."""
    return component_stats(labelled).join(sizes, "img").where(~touches_border(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")]))


def reclaim_islands(pixels: DataFrame, delete: Column, sizes: DataFrame, connectivity: int = 8) -> DataFrame:
    """The runs of deleted pixels that stay deleted: landlocked components are kept instead."""
    return without_islands(label(runs_of(pixels, delete), connectivity), sizes)


def without_islands(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """The labelled runs without landlocked components."""
    return labelled.join(landlocked(labelled, sizes).select("img", "comp"), ["img", "comp"], "left_anti").select("img", "y", "x0", "x1")


def low_texture(labelled: DataFrame, least_area: int = 224 * 224 // 2) -> DataFrame:
    """(img, x, y): rounded centroids of large components."""
    return component_stats(labelled).where(F.col("area") >= least_area).select("img", F.bround("cx", 0).cast("int").alias("x"), F.bround("cy", 0).cast("int").alias("y"))


def complement(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Runs of what lies inside each box (img, comp, x, y, w, h) but not in the runs of its own component."""
    rows = boxes.withColumn("row", F.explode(F.expr("sequence(y, y + h - 1)"))).select("img", "comp", F.col("row").alias("y"), F.col("x").alias("b0"), (F.col("x") + F.col("w")).alias("b1"))
    order = Window.partitionBy("img", "comp", "y").orderBy("x0")
    own = rows.join(runs, ["img", "comp", "y"])
    before = own.select("img", "comp", "y", F.coalesce(F.lag("x1").over(order), "b0").alias("x0"), F.col("x0").alias("x1"))
    after = own.groupBy("img", "comp", "y").agg(F.max("x1").alias("x0"), F.first("b1").alias("x1"))
    empty = rows.join(runs.select("img", "comp", "y").distinct(), ["img", "comp", "y"], "left_anti").select("img", "comp", "y", F.col("b0").alias("x0"), F.col("b1").alias("x1"))
    return before.unionByName(after).unionByName(empty).where("x0 < x1")


def frame_interiors(strokes: DataFrame, least: int = 10_000, band_rows: int = BAND_ROWS) -> DataFrame:
    """Runs (img, comp, y, x0, x1) of the holes of stroke components with at least `least` pixels each.

    strokes are runs of dark pixels. Components whose box can't hold themselves and such a hole go first. A hole is a
    4-connected part of a component's complement in its box that doesn't reach the box's side; other components inside
    count as complement.
    """
    labelled = label(strokes, 8, band_rows)
    boxes = component_stats(labelled).where(F.col("w").cast("long") * F.col("h") >= least + F.col("area"))
    inside = complement(labelled, boxes)
    parts = label(inside, 4, band_rows, ("img", "comp"), "hole")
    stats = parts.groupBy("img", "comp", "hole").agg(F.min("x0").alias("h0"), F.max("x1").alias("h1"), F.min("y").alias("v0"), (F.max("y") + 1).alias("v1"), F.sum(F.col("x1") - F.col("x0")).alias("area"))
    ring = boxes.select("img", "comp", "x", "y", "w", "h")
    closed = stats.join(ring, ["img", "comp"]).where((F.col("h0") > F.col("x")) & (F.col("h1") < F.col("x") + F.col("w")) & (F.col("v0") > F.col("y")) & (F.col("v1") < F.col("y") + F.col("h")) & (F.col("area") >= least))
    return parts.join(closed.select("img", "comp", "hole"), ["img", "comp", "hole"], "left_semi").select("img", "comp", "y", "x0", "x1")
