"""Rasters derived from tables of vectors, and conversions between pixels, row profiles and runs.

A vector is an image row: 64 rows make an image. `fine` has a pixel per component; `block` sums up four
neighbouring components and repeats the sum four times in both directions, which gives coherent areas.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _value(e: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.5) * 255))).cast("int")


def fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, y, x, r, g, b, a)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 64).alias("img"), (F.col("vec_id") % 64).cast("int").alias("y"), F.col("embedding").alias("e"))
    px = rows.select("img", "y", "e", F.posexplode("e").alias("x", "v"))
    at = lambda k: _value(F.element_at("e", ((F.col("x") + k) % 64 + 1).cast("int")))
    px = px.select("img", "y", "x", _value(F.col("v")).alias("r"), at(1).alias("g"), at(2).alias("b"))
    return px.withColumn("a", (F.col("r") * 7 + F.col("y") * 3 + F.col("x") * 5) % 256)


def block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, y, x, r): half the sum of each four components of a vector, four times in each direction."""
    part = lambda i, k: F.element_at("embedding", 4 * i + k).cast("double")
    sums = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (part(i, 1) + part(i, 2) + part(i, 3) + part(i, 4)) / 2)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 64).alias("img"), (F.col("vec_id") % 64).cast("int").alias("y"), F.posexplode(sums).alias("x", "v"))
    wide = rows.withColumn("r", _value(F.col("v"))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return wide.select("img", (F.col("y") * 4 + F.col("dy")).cast("int").alias("y"), (F.col("x") * 4 + F.col("dx")).cast("int").alias("x"), "r")


def _levels(e: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((e.astype(np.float64) + 0.5) * 255), 0, 255).astype(np.int64)


def _banded(spark: SparkSession, sf_dir: str, per_vector: int, rows: int, planes: tuple[str, ...], make):
    """Packed bands straight from vectors: those of a band meet in one task, and no pixel is a row on the way."""
    from ..operators.bands import Bands, _row, _schema

    if rows % per_vector:
        raise ValueError("a band holds whole vectors")
    found = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 64).alias("img"), ((F.col("vec_id") % 64) * per_vector).alias("y"), "embedding")

    def work(key, table):
        table = table.sort_by("y")
        e = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        y0 = key[1].as_py() * rows
        made = make(e, table.column("y").to_numpy())
        n, width = next(iter(made.values())).shape
        return _row(key[0], key[1].as_py(), y0, n, width, {p: np.ascontiguousarray(made[p], dtype=np.uint8).tobytes() for p in planes})

    grouped = found.withColumn("band", F.floor(F.col("y") / rows)).groupBy("img", "band")
    kinds = dict.fromkeys(planes, "uint8")
    return Bands(grouped.applyInArrow(work, _schema("bigint", kinds)), kinds, rows)


def fine_bands(spark: SparkSession, sf_dir: str, *planes: str, rows: int = 48):
    """fine() as packed bands."""

    def make(e, y):
        r, x = _levels(e), np.arange(e.shape[1])
        return {"r": r, "g": np.roll(r, -1, axis=1), "b": np.roll(r, -2, axis=1), "a": (r * 7 + y[:, None] * 3 + x * 5) % 256}

    return _banded(spark, sf_dir, 1, rows, planes, make)


def block_bands(spark: SparkSession, sf_dir: str, rows: int = 100):
    """block() as packed bands."""

    def make(e, y):
        q = e.astype(np.float64).reshape(len(e), -1, 4)
        r = _levels((q[:, :, 0] + q[:, :, 1] + q[:, :, 2] + q[:, :, 3]) / 2)
        return {"r": np.repeat(np.repeat(r, 4, axis=0), 4, axis=1)}

    return _banded(spark, sf_dir, 4, rows, ("r",), make)


def row_profile(pixels: DataFrame, predicate: Column) -> DataFrame:
    """(img, y, n): pixels of a row for which the predicate holds; rows without any have 0."""
    return pixels.groupBy("img", "y").agg(F.sum(F.when(predicate, 1).otherwise(0)).cast("long").alias("n"))


def runs(pixels: DataFrame, predicate: Column, *more: Column) -> DataFrame:
    """(img, y, x0, x1): maximal horizontal runs [x0, x1) of pixels for which the predicate holds, and more aggregates."""
    order = Window.partitionBy("img", "y").orderBy("x")
    on = pixels.where(predicate).withColumn("_island", F.col("x") - F.row_number().over(order))
    return on.groupBy("img", "y", "_island").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), *more).drop("_island")


def pixels_of(runs: DataFrame) -> DataFrame:
    """(img, y, x) of every pixel in the runs."""
    return runs.select("img", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
