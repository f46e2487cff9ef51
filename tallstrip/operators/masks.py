"""Pixel predicates and mask algebra, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 8-bit weights of the usual luma, scaled by 2**14.
GRAY_R, GRAY_G, GRAY_B, GRAY_HALF = 4899, 9617, 1868, 8192


def gray(r="r", g="g", b="b") -> Column:
    return F.shiftright(F.col(r) * GRAY_R + F.col(g) * GRAY_G + F.col(b) * GRAY_B + GRAY_HALF, 14)


def saturation(r="r", g="g", b="b") -> Column:
    """(max - min) * 255 / max, rounded; 0 for black."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top == 0, 0).otherwise(F.floor((top - low) * 255 / top + 0.5).cast("int"))


def spread(r="r", g="g", b="b") -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def deleted_in_training(alpha: Column, limit: int = 128) -> Column:
    return alpha < limit


def deleted_in_result(alpha: Column, result_gray: Column, original_gray: Column, original_saturation: Column, alpha_limit: int = 16, white: int = 245) -> Column:
    """By alpha where there is one; else white in the result where the original was not white or was coloured."""
    return F.when(alpha.isNotNull(), alpha < alpha_limit).otherwise((result_gray >= white) & ((original_gray < white) | (original_saturation > 20)))


def damaged(deleted: Column, gray: Column, saturation: Column, edge: Column | None = None) -> Column:
    """A deleted pixel that was dark, coloured, or on an edge (edge None: that term is left out)."""
    lost = (gray < 180) | (saturation > 45)
    return deleted & (lost if edge is None else lost | edge)


def leftover_line(deleted: Column, gray: Column, saturation: Column, edge: Column | None = None) -> Column:
    """A kept pixel in the gray of thin lines; on an edge, if edges are given."""
    line = ~deleted & (gray >= 120) & (gray <= 245) & (saturation <= 35)
    return line if edge is None else line & edge


def content(pixels: DataFrame, alpha_limit: int = 10) -> DataFrame:
    """Adds content: by alpha in images that have any transparency at all, by colour in others."""
    lowest = F.min("a").over(Window.partitionBy("img"))
    coloured = (F.col("r") < 245) | (F.col("g") < 245) | (F.col("b") < 245) | (spread() > 12)
    return pixels.withColumn("content", F.when(lowest < 250, F.col("a") > alpha_limit).otherwise(coloured))


def near_black(gray: Column, darkness: int = 40) -> Column:
    return gray <= darkness


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pixels both rasters have: the crop to their smaller height and width."""
    return left.join(right, ["img", "y", "x"])


def algebra(p: Column, q: Column) -> dict[str, Column]:
    return {"both": p & q, "either": p | q, "first_only": p & ~q, "second_only": ~p & q, "flipped": p != q}


def require_one_size(images: DataFrame, *keys: str) -> DataFrame:
    """Fails where the images of a group differ in width or height; else one row (keys, width, height) a group."""
    sizes = images.groupBy(*keys).agg(F.min("width").alias("width"), F.max("width").alias("w1"), F.min("height").alias("height"), F.max("height").alias("h1"))
    same = (F.col("width") == F.col("w1")) & (F.col("height") == F.col("h1"))
    return sizes.select(*keys, F.when(same, F.col("width")).otherwise(F.raise_error(F.lit("images of different sizes")).cast("int")).alias("width"), "height")
