"""Kernels that windows can't express, on bands of rows with a halo: edges, distances, guidance and tiled scoring.

A band is a group of rows of one image with as many rows around it as the kernel reaches; the result of a band's own
rows doesn't depend on how the image was cut.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import settle
from .stencil import ellipse


def in_bands(pixels: DataFrame, column: str, out: str | tuple[str, ...], kernel: Callable[[np.ndarray], np.ndarray | tuple[np.ndarray, ...]], halo: int, rows: int = 1024, kind: str = "double") -> DataFrame:
    """(img, y, x, out): kernel applied to column as an array, band by band. Rows within the halo of two bands go to both.
    With several names in out, the kernel returns as many arrays."""
    outs = (out,) if isinstance(out, str) else out
    banded = pixels.select("img", "y", "x", column, F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("y") - halo) / rows)), F.floor((F.col("y") + halo) / rows))).alias("band"))
    img = pixels.schema["img"].dataType.simpleString()

    def work(key, table):
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", column))
        top, left = y.min(), x.min()
        grid = np.zeros((y.max() - top + 1, x.max() - left + 1), np.float64)
        grid[y - top, x - left] = v
        got = kernel(grid)
        values = [v[y - top, x - left] for v in ((got,) if isinstance(out, str) else got)]
        band = key[1].as_py()
        own = y // rows == band
        return pa.table({"img": table.column("img").filter(pa.array(own)), "y": y[own].astype(np.int32), "x": x[own].astype(np.int32)} | {k: v[own].astype(np.float64) for k, v in zip(outs, values, strict=True)})

    made = banded.groupBy("img", "band").applyInArrow(work, "img " + img + ", y int, x int, " + ", ".join(f"{k} double" for k in outs))
    return made.withColumns({k: F.col(k).cast(kind) for k in outs})


def _shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    return np.pad(a, ((max(-dy, 0), max(dy, 0)), (max(-dx, 0), max(dx, 0))), mode="edge")[max(dy, 0) : max(dy, 0) + a.shape[0], max(dx, 0) : max(dx, 0) + a.shape[1]]


def gradients(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives with repeated borders."""
    s = {(dy, dx): _shifted(a, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    gx = s[-1, 1] + 2 * s[0, 1] + s[1, 1] - s[-1, -1] - 2 * s[0, -1] - s[1, -1]
    gy = s[1, -1] + 2 * s[1, 0] + s[1, 1] - s[-1, -1] - 2 * s[-1, 0] - s[-1, 1]
    return gx, gy


def edge_candidates(a: np.ndarray) -> np.ndarray:
    """Gradient strength (sum of absolute derivatives) where it is a maximum across the edge, else 0."""
    gx, gy = gradients(a)
    strength = np.abs(gx) + np.abs(gy)
    angle = np.abs(gy) / np.maximum(np.abs(gx), 1e-12)
    flat, steep, same = angle < np.tan(np.pi / 8), angle > np.tan(3 * np.pi / 8), gx * gy >= 0
    out = np.zeros_like(strength)
    for where, (dy, dx) in ((flat, (0, 1)), (steep, (1, 0)), (~flat & ~steep & same, (1, 1)), (~flat & ~steep & ~same, (1, -1))):
        peak = (strength > _shifted(strength, -dy, -dx)) & (strength >= _shifted(strength, dy, dx))
        out[where & peak] = strength[where & peak]
    return out


def edges(pixels: DataFrame, column: str, low: float, high: float, rows: int = 1024) -> DataFrame:
    """(img, y, x): edge pixels. Strong candidates, and weak ones that strong ones reach: components of the candidates'
    runs, whatever bands they cross."""
    from ..sources.raster import pixels_of, runs
    from .topology import label

    found = in_bands(pixels, column, "strength", edge_candidates, 2, rows).where(F.col("strength") > low)
    measured = settle(runs(found, F.lit(True), F.max("strength").alias("most")), "edges")
    labelled = label(measured.drop("most"), 8, rows).join(measured, ["img", "y", "x0", "x1"])
    strong = labelled.groupBy("img", "comp").agg(F.max("most").alias("most")).where(F.col("most") > high)
    return pixels_of(labelled.join(strong, ["img", "comp"], "left_semi"))


def signed_distance(radius: int) -> Callable[[np.ndarray], np.ndarray]:
    """Distance to the other kind of pixel, negative where the mask is set, clamped to the radius and divided by it."""
    offsets = sorted(((dy * dy + dx * dx) ** 0.5, dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if 0 < dy * dy + dx * dx <= radius * radius)

    def kernel(mask: np.ndarray) -> np.ndarray:
        out = np.full(mask.shape, float(radius))
        for d, dy, dx in reversed(offsets):
            out[_shifted(mask, dy, dx) != mask] = d
        return np.where(mask > 0, -out, out) / radius

    return kernel


def _spread(a: np.ndarray, radius: int, pick) -> np.ndarray:
    out = a
    for dy, h in ellipse(radius).items():
        for dx in range(-h, h + 1):
            out = pick(out, _shifted(a, dy, dx))
    return out


def guidance(pixels: DataFrame, column: str, limit: float = 30.0, radius: int = 2) -> DataFrame:
    """(img, y, x, thr, closed, opened): local contrast of at least limit, that closed, and the closed one opened; the
    fourth guide is edges()."""

    def kernel(a: np.ndarray) -> tuple[np.ndarray, ...]:
        mask = ((_spread(a, 3, np.maximum) - _spread(a, 3, np.minimum)) >= limit).astype(np.float64)
        shut = _spread(_spread(mask, radius, np.maximum), radius, np.minimum)
        return mask, shut, _spread(_spread(shut, radius, np.minimum), radius, np.maximum)

    return in_bands(pixels, column, ("thr", "closed", "opened"), kernel, 3 + 4 * radius, kind="int")


def overlap_add(scored: DataFrame, tile: int) -> DataFrame:
    """(img, y, x, p): scores of overlapping tiles (img, ty, tx, y, x, s) averaged under Hann weights."""
    from .stencil import hann_weight

    w = hann_weight(F.col("y") - F.col("ty"), tile) * hann_weight(F.col("x") - F.col("tx"), tile)
    return scored.withColumn("w", w).groupBy("img", "y", "x").agg((F.sum(F.col("s") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("p"))


class Scorer:
    """What a model has to offer: a score in [0, 1] per pixel of a tile of gray values."""

    def __call__(self, tile: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class ThresholdScorer(Scorer):
    """A stand-in without weights: a logistic of the pixel's brightness."""

    def __init__(self, middle: float = 128.0, width: float = 16.0):
        self.middle, self.width = middle, width

    def __call__(self, tile: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(tile - self.middle) / self.width))


class PlacedScorer(Scorer):
    """A stand-in whose score depends on where in its tile a pixel stands, as a network's does: what overlapping tiles say
    of a pixel differs."""

    def __call__(self, tile: np.ndarray) -> np.ndarray:
        y, x = np.indices(tile.shape)
        return (tile / 255 + (y * 7 + x * 3) % 11 / 11) / 2


def predict(pixels: DataFrame, column: str, sizes: DataFrame, scorer: Scorer, tile: int = 768, overlap: int = 96) -> DataFrame:
    """(img, y, x, p): tiles (padded with white) scored one by one, and their overlaps averaged."""
    from .layout import tiles

    grid = tiles(sizes, tile, overlap, "img")
    stride = tile - overlap
    placed = pixels.select("img", "y", "x", column, F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("y") - tile + 1) / stride)), F.floor(F.col("y") / stride))).alias("j")).withColumn("i", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("x") - tile + 1) / stride)), F.floor(F.col("x") / stride))))
    placed = placed.select("img", (F.col("j") * stride).alias("ty"), (F.col("i") * stride).alias("tx"), "y", "x", column).join(grid, ["img", "ty", "tx"], "left_semi")
    img = pixels.schema["img"].dataType.simpleString()

    def work(key, table):
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", column))
        ty, tx = key[1].as_py(), key[2].as_py()
        area = np.full((tile, tile), 255.0)
        area[y - ty, x - tx] = v
        s = scorer(area)[y - ty, x - tx]
        return pa.table({"img": table.column("img"), "ty": table.column("ty"), "tx": table.column("tx"), "y": y.astype(np.int32), "x": x.astype(np.int32), "s": s})

    return overlap_add(placed.groupBy("img", "ty", "tx").applyInArrow(work, f"img {img}, ty bigint, tx bigint, y int, x int, s double"), tile)


def contours(pixels_on: DataFrame) -> DataFrame:
    """(img, y, x): pixels of the mask with a 4-neighbour outside it: what outlines run along."""
    near = None
    for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        moved = pixels_on.select("img", (F.col("y") + dy).cast("int").alias("y"), (F.col("x") + dx).cast("int").alias("x"))
        near = moved if near is None else near.unionByName(moved)
    inside = near.groupBy("img", "y", "x").agg(F.count("*").alias("n")).where("n = 4").select("img", "y", "x")
    return pixels_on.join(inside, ["img", "y", "x"], "left_anti").select("img", "y", "x")
