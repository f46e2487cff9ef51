"""Strips stored for comparison: originals and results bucketed alike, so that their bands meet where they lie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics
from .bands import COUNTS, Bands, _arrays, gray_of, saturation_of


def store(b: Bands, table: str, buckets: int, path: str | None = None) -> None:
    """Write bands as a table bucketed and sorted by image and band; path: where its files go, by default the warehouse."""
    writer = b.df.write.format("parquet").bucketBy(buckets, "img", "band").sortBy("img", "band").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def stored(spark: SparkSession, table: str, planes: dict[str, str], rows: int) -> Bands:
    return Bands(spark.table(table).select("img", "band", "y0", "n", "width", *planes), dict(planes), rows)


def scored_pairs(originals: Bands, results: Bands) -> DataFrame:
    """Ranked scores of strips that both have (originals: r, g, b; results: alpha a), cropped to what both cover. Bands of
    tables that are bucketed alike are joined without an exchange; four counts leave each pair of bands."""
    left = originals.df.select("img", "band", "width", "r", "g", "b")
    right = results.df.select("img", "band", F.col("width").alias("width_a"), "a")
    names = [c.split()[0] for c in COUNTS.split(", ")]
    kind = originals.key

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for i in range(len(batch)):
                p = _arrays(batch, i, dict.fromkeys("rgb", "uint8"))
                a = np.frombuffer(column["a"][i].as_buffer(), np.uint8).reshape(-1, column["width_a"][i].as_py())
                n, width = min(len(a), len(p["r"])), min(a.shape[1], p["r"].shape[1])
                p, gone = {c: v[:n, :width] for c, v in p.items()}, a[:n, :width] < 16
                gray, sat = gray_of(p), saturation_of(p)
                lost, line = (gray < 180) | (sat > 45), (gray >= 120) & (gray <= 245) & (sat <= 35)
                counts = (gone.size, gone.sum(), (gone & lost).sum(), (~gone & line).sum())
                yield pa.RecordBatch.from_arrays([column["img"].slice(i, 1), *[pa.array([int(v)]) for v in counts]], names=["img", *names])

    parts = left.join(right, ["img", "band"]).mapInArrow(work, f"img {kind}, {COUNTS}")
    return metrics.ranked(metrics.of_counts(parts.groupBy("img").agg(*[F.sum(c).alias(c) for c in names])), "img")
