"""Pixels of long strips: pages resized and stacked, strips cut into parts, parts put back together.

Rows are dealt anew from the bands of what there is to the bands of what is made: where each row goes follows from running
offsets, so the JVM cuts exactly those rows out of a packed band that another band needs, and one exchange brings them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bands import Bands, _arrays, _piece, _row, _schema

#: The filter's half-width in source pixels, and the bits of its whole-number weights.
SUPPORT, BITS = 3, 22


def lanczos(size: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """For each new place the first old one it is made of, and its weights as whole numbers that add up to about 2**BITS:
    a windowed sinc, widened when the image gets smaller."""
    scale = size / new
    wide = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    low = np.maximum(0, np.trunc(centre - SUPPORT * wide + 0.5)).astype(np.int64)
    high = np.minimum(size, np.trunc(centre + SUPPORT * wide + 0.5)).astype(np.int64)
    at = low[:, None] + np.arange(int((high - low).max()))
    far = (at - centre[:, None] + 0.5) * (1.0 / wide)
    w = np.where((at < high[:, None]) & (far >= -SUPPORT) & (far < SUPPORT), np.sinc(far) * np.sinc(far / SUPPORT), 0.0)
    k = w * (1.0 / w.sum(axis=1))[:, None]
    return low, np.trunc(k * (1 << BITS) + np.copysign(0.5, k)).astype(np.int64)


def filtered(a: np.ndarray, low: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of a weighed and added up, rounded to a byte."""
    total = np.full((len(low), a.shape[1]), 1 << (BITS - 1), np.int64)
    for t in range(weights.shape[1]):
        total += a[np.minimum(low + t, len(a) - 1)].astype(np.int64) * weights[:, t, None]
    return np.clip(total >> BITS, 0, 255).astype(np.uint8)


def _narrowed(b: Bands, plan: DataFrame) -> DataFrame:
    """The page bands with their page's plan, every row resized to the new width by itself."""
    planes = b.planes
    met = b.df.join(plan.withColumnsRenamed({"width": "_w", "height": "_h"}).drop("_w"), "img")
    more = [c for c in met.columns if c not in ("img", "band", "y0", "n", "width", *planes)]
    kinds = {f.name: f.dataType.simpleString() for f in met.schema.fields}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(len(batch)):
                width, new = column["width"][i].as_py(), column["new_width"][i].as_py()
                made = {p: column[p][i].as_py() for p in planes}
                if width != new:
                    low, weights = lanczos(width, new)
                    made = {p: np.ascontiguousarray(filtered(a.T, low, weights).T).tobytes() for p, a in _arrays(batch, i, planes).items()}
                done = {c: column[c].slice(i, 1) for c in ("img", "band", "y0", "n", *more)}
                yield pa.RecordBatch.from_pydict(done | {"width": pa.array([new], pa.int32())} | {p: pa.array([v], pa.binary()) for p, v in made.items()})

    order = ["img", "band", "y0", "n", *more, "width", *planes]
    return met.mapInArrow(work, ", ".join(f"`{c}` {'int' if c == 'width' else kinds[c]}" for c in order))


def stacked(b: Bands, plan: DataFrame, rows: int | None = None) -> Bands:
    """Strips (img: the chapter) of pages b, whose img is named in plan (img, chapter, width, height, new_width,
    new_height, y), as layout.stack gives it. Pages of another width are resized, along rows, then along columns, each
    pass rounded to bytes."""
    rows, planes = rows or b.rows, b.planes
    if set(planes.values()) != {"uint8"}:
        raise ValueError("planes of bytes are stacked")
    total = plan.groupBy("chapter").agg(F.max(F.col("y") + F.col("new_height")).alias("_total"))
    wide = _narrowed(b, plan.select("img", "chapter", "width", "height", F.col("new_width").cast("int").alias("new_width"), "new_height", F.col("y").alias("_y")).join(total, "chapter"))
    scale = F.col("_h") / F.col("new_height")
    reach = F.when(F.col("_h") == F.col("new_height"), 0.0).otherwise(SUPPORT * F.greatest(scale, F.lit(1.0)))
    last = F.col("y0") + F.col("n")
    out0 = F.greatest(F.lit(0), F.floor((F.col("y0") - reach - 1) / scale - 0.5))
    out1 = F.least(F.col("new_height").cast("long") - 1, F.ceil((last + reach + 1) / scale - 0.5))
    sent = wide.withColumn("_to", F.explode(F.sequence(F.floor((F.col("_y") + out0) / rows), F.floor((F.col("_y") + out1) / rows))))
    a, c = F.greatest(F.lit(0).cast("long"), F.col("_to") * rows - F.col("_y")), F.least(F.col("new_height").cast("long"), (F.col("_to") + 1) * rows - F.col("_y"))
    low = F.greatest(F.col("y0"), F.floor((a + 0.5) * scale - reach - 0.5))
    high = F.least(last, F.ceil((c - 0.5) * scale + reach + 1.5))
    kind = wide.schema["chapter"].dataType.simpleString()
    held = Bands(sent.select("y0", "width", *planes), planes, rows)
    pieces = sent.select("chapter", F.col("_to").alias("band"), "_y", "_h", "new_height", "_total", *_piece(held, low, high, F.lit(False), tuple(planes))).where("count > 0")

    def work(key, table):
        band, whole = key[1].as_py(), table.column("_total")[0].as_py()
        width, top = table.column("width")[0].as_py(), band * rows
        n = min(rows, whole - top)
        out = {p: np.zeros((n, width), np.uint8) for p in planes}
        pages: dict[int, list[int]] = {}
        for i, y in enumerate(table.column("_y").to_pylist()):
            pages.setdefault(y, []).append(i)
        low = table.column("low").to_pylist()
        for y, own in pages.items():
            own.sort(key=low.__getitem__)
            height, new = (table.column(c)[own[0]].as_py() for c in ("_h", "new_height"))
            first, last = max(0, top - y), min(new, top + n - y)
            at, weights = lanczos(height, new) if height != new else (np.arange(height), None)
            for p in planes:
                source = np.concatenate([np.frombuffer(table.column(p)[i].as_buffer(), np.uint8).reshape(-1, width) for i in own])
                lines = at[first:last] - low[own[0]]
                out[p][y + first - top : y + last - top] = source[lines] if weights is None else filtered(source, lines, weights[first:last])
        return _row(pa.scalar(key[0].as_py(), table.column("chapter").type), band, top, n, width, {p: v.tobytes() for p, v in out.items()})

    return Bands(pieces.groupBy("chapter", "band").applyInArrow(work, _schema(kind, planes)), dict(planes), rows)


def moved(b: Bands, moves: DataFrame, sizes: DataFrame, fill: dict[str, int], rows: int | None = None) -> Bands:
    """Images (img: target) put together from rows of others: moves (img, target, from, to, at, x) lay the rows [from, to)
    of img at row `at` and pixel x of target, whose (target, width, height) is in sizes; what nothing covers is filled.
    Cutting a strip into parts, and centring parts of different widths in one strip, are such moves."""
    rows, planes = rows or b.rows, b.planes
    met = b.df.join(moves, "img").join(sizes.withColumnsRenamed({"width": "_w", "height": "_h"}), "target")
    a, c = F.greatest(F.col("y0"), F.col("from")), F.least(F.col("y0") + F.col("n"), F.col("to"))
    met = met.withColumns({"_a": a.cast("long"), "_c": c.cast("long")}).where("_a < _c").withColumn("_shift", F.col("at") - F.col("from"))
    sent = met.withColumn("_to", F.explode(F.sequence(F.floor((F.col("_a") + F.col("_shift")) / rows), F.floor((F.col("_c") - 1 + F.col("_shift")) / rows))))
    low = F.greatest(F.col("_a"), F.col("_to") * rows - F.col("_shift"))
    high = F.least(F.col("_c"), (F.col("_to") + 1) * rows - F.col("_shift"))
    held = Bands(sent.select("y0", "width", *planes), planes, rows)
    pieces = sent.select("target", F.col("_to").alias("band"), "_shift", F.col("x").cast("long").alias("_x"), "_w", "_h", *_piece(held, low, high, F.lit(False), tuple(planes))).where("count > 0")
    kind = sizes.schema["target"].dataType.simpleString()

    def work(key, table):
        band, width, height = key[1].as_py(), table.column("_w")[0].as_py(), table.column("_h")[0].as_py()
        top = band * rows
        n = min(rows, height - top)
        out = {p: np.full((n, width), fill[p], planes[p]) for p in planes}
        for i in range(len(table)):
            at = table.column("low")[i].as_py() + table.column("_shift")[i].as_py() - top
            x, own = table.column("_x")[i].as_py(), table.column("width")[i].as_py()
            for p in planes:
                part = np.frombuffer(table.column(p)[i].as_buffer(), planes[p]).reshape(-1, own)
                out[p][at : at + len(part), x : x + own] = part[:, : width - x]
        return _row(pa.scalar(key[0].as_py(), table.column("target").type), band, top, n, width, {p: v.tobytes() for p, v in out.items()})

    return Bands(pieces.groupBy("target", "band").applyInArrow(work, _schema(kind, planes)), dict(planes), rows)
