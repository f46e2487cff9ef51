"""Neighbourhood kernels on pixel tables: a pass along rows and one along columns, each a window.

Neighbours outside the image don't count. Kernels are given by half-widths per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ellipse(radius: int) -> dict[int, int]:
    """Row offset -> half-width."""
    return {dy: round(radius * math.sqrt((radius * radius - dy * dy) / (radius * radius))) for dy in range(-radius, radius + 1)} if radius else {0: 0}


def square(radius: int) -> dict[int, int]:
    return {dy: radius for dy in range(-radius, radius + 1)}


def _extreme(pixels: DataFrame, value: str, out: str, kernel: dict[int, int], row_agg, pick) -> DataFrame:
    along = Window.partitionBy("img", "y").orderBy("x")
    down = Window.partitionBy("img", "x").orderBy("y")
    widths = sorted(set(kernel.values()))
    step = pixels.withColumns({f"_{out}{h}": row_agg(value).over(along.rowsBetween(-h, h)) for h in widths})
    shifted = [F.lag(f"_{out}{h}", -dy).over(down) if dy else F.col(f"_{out}{h}") for dy, h in kernel.items()]
    return step.withColumn(out, pick(*shifted) if len(shifted) > 1 else shifted[0]).drop(*[f"_{out}{h}" for h in widths])


def dilate(pixels: DataFrame, value: str, out: str, kernel: dict[int, int]) -> DataFrame:
    """Adds the maximum of value under the kernel."""
    return _extreme(pixels, value, out, kernel, F.max, F.greatest)


def erode(pixels: DataFrame, value: str, out: str, kernel: dict[int, int]) -> DataFrame:
    """Adds the minimum of value under the kernel."""
    return _extreme(pixels, value, out, kernel, F.min, F.least)


def gradient(pixels: DataFrame, value: str, out: str, kernel: dict[int, int]) -> DataFrame:
    """Adds dilation less erosion: local contrast of gray, the boundary of a mask."""
    both = erode(dilate(pixels, value, "_high", kernel), value, "_low", kernel)
    return both.withColumn(out, F.col("_high") - F.col("_low")).drop("_high", "_low")


def close(pixels: DataFrame, value: str, out: str, kernel: dict[int, int]) -> DataFrame:
    return erode(dilate(pixels, value, "_wide", kernel), "_wide", out, kernel).drop("_wide")


def open_(pixels: DataFrame, value: str, out: str, kernel: dict[int, int]) -> DataFrame:
    return dilate(erode(pixels, value, "_thin", kernel), "_thin", out, kernel).drop("_thin")


def postprocess(pixels: DataFrame, mask: str, close_radius: int = 1, open_radius: int = 0) -> DataFrame:
    """The mask (0 or 1) closed, then opened; a radius of 0 leaves a step out."""
    if close_radius > 0:
        pixels = close(pixels, mask, "_m", ellipse(close_radius)).drop(mask).withColumnRenamed("_m", mask)
    if open_radius > 0:
        pixels = open_(pixels, mask, "_m", ellipse(open_radius)).drop(mask).withColumnRenamed("_m", mask)
    return pixels


def boundary_weight(pixels: DataFrame, mask: str, radius: int, weight: float) -> DataFrame:
    """Adds w: weight within radius of the mask's boundary, 1 elsewhere."""
    edge = gradient(pixels, mask, "_edge", square(1))
    near = dilate(edge, "_edge", "_near", ellipse(radius))
    return near.withColumn("w", F.when(F.col("_near") > 0, F.lit(float(weight))).otherwise(1.0)).drop("_edge", "_near")


def protect_borders(pixels: DataFrame, delete: str, gray: str, band: int = 3, darkness: int = 40) -> DataFrame:
    """Turns deleted near-black pixels within `band` of a kept one back to kept; a band of 0 changes nothing."""
    if band <= 0:
        return pixels
    kept = pixels.withColumn("_keep", 1 - F.col(delete))
    near = dilate(kept, "_keep", "_near", ellipse(band))
    back = (F.col(delete) == 1) & (F.col(gray) <= darkness) & (F.col("_near") == 1)
    return near.withColumn(delete, F.when(back, 0).otherwise(F.col(delete))).drop("_keep", "_near")


def signed_fusion(pixels: DataFrame, delete: str, distance: str, radius: int = 4) -> DataFrame:
    """Within radius of the mask's own boundary the sign of the distance decides; elsewhere the mask stays."""
    near = dilate(gradient(pixels, delete, "_edge", square(1)), "_edge", "_near", ellipse(radius))
    return near.withColumn(delete, F.when(F.col("_near") > 0, F.when(F.col(distance) < 0, 1).otherwise(0)).otherwise(F.col(delete))).drop("_edge", "_near")


def hann_weight(i: Column, size: int, least: float = 0.05) -> Column:
    """Weight of position i along a tile's side, before the outer product: a Hann window, not below `least`."""
    return F.greatest(F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * math.pi) * i / (size - 1)), F.lit(least)) if size > 1 else F.lit(1.0)


def nearest(pixels: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Nearest-neighbour resize by index arithmetic: a new place n shows the old one floor(n * size / new size), so each pixel
    goes to the places that show it, one run of them along either axis, and images neither move nor meet a grid."""
    out = pixels.where("img IS NOT NULL")
    for c, size, new in (("y", height, new_height), ("x", width, new_width)):
        first = lambda p, size=size, new=new: F.ceil(p.cast("long") * new / size)
        low, high = F.greatest(first(F.col(c)), F.lit(0)).cast("int"), (first(F.col(c) + 1) - 1).cast("int")
        shown = (F.col(c) < size) & (low <= high)
        out = out.withColumn(f"_{c}", F.explode(F.when(shown, F.sequence(low, high))))
    return out.select("img", F.col("_y").alias("y"), F.col("_x").alias("x"), *[c for c in pixels.columns if c not in ("img", "y", "x")])


def _shares(size: int, new_size: int, how: str) -> Column:
    """For each new place (0 to new_size - 1) the old places it is made of, with their weights, as rows (n, p, w)."""
    scale, n = size / new_size, F.col("n")
    if how == "area":
        low, high = n * scale, F.least((n + 1) * scale, F.lit(float(size)))
        old = F.sequence(F.floor(low).cast("int"), F.least(F.ceil(high - 1e-9), F.lit(size)).cast("int") - 1)
        return F.transform(old, lambda p: F.struct(p.alias("p"), ((F.least(high, p + 1) - F.greatest(low, p)) / (high - low)).alias("w")))
    centre = (n + 0.5) * scale - 0.5
    below, part = F.floor(centre).cast("int"), centre - F.floor(centre)
    inside = lambda p: F.least(F.greatest(p, F.lit(0)), F.lit(size - 1))
    return F.array(F.struct(inside(below).alias("p"), (1 - part).alias("w")), F.struct(inside(below + 1).alias("p"), part.alias("w")))


def resampled(pixels: DataFrame, value: str, width: int, height: int, new_width: int, new_height: int, how: str = "linear") -> DataFrame:
    """(img, y, x, value): resized along rows, then along columns. "linear" weighs the two nearest pixel centres, which
    lie at halves; "area" averages what a new pixel covers, for smaller sizes. The weights are small tables of their own
    size, whatever the images are."""
    if how not in ("linear", "area"):
        raise ValueError(how)
    out = pixels.select("img", "y", "x", F.col(value).cast("double").alias("v"))
    for axis, size, new in (("x", width, new_width), ("y", height, new_height)):
        weights = pixels.sparkSession.range(new).select(F.col("id").cast("int").alias("n")).select("n", F.explode(_shares(size, new, how)).alias("s")).select("n", F.col("s.p").alias(axis), "s.w")
        other = "y" if axis == "x" else "x"
        out = out.join(F.broadcast(weights), axis).groupBy("img", other, F.col("n").alias("_new")).agg(F.sum(F.col("v") * F.col("w")).alias("v")).withColumnRenamed("_new", axis)
    return out.select("img", "y", "x", F.col("v").alias(value))


def crossfade(a: Column, b: Column, t: Column) -> Column:
    return a * (1 - t) + b * t
