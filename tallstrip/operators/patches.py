"""Training patches from packed bands: numbered draws with redraws, and tensors.

How many pixels of a window are positive is asked of summed areas, four lookups in each band that the window touches, so a
draw costs the same whatever its size. All attempts of a patch are drawn at once; the first that holds enough positives
wins. Draws are digests of a seed and their numbers, so a patch is the same on every run and cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bands import Bands, _arrays, dilated, eroded, over
from .ranking import numbered
from .stencil import square

#: Draws of a band that one task looks up.
DRAWS = 200_000
UNIT = 1 << 48


def drawn(patch: Column, attempt: Column, slot: str, seed: int) -> Column:
    """A number in [0, 1): 48 bits of a digest."""
    said = F.concat_ws(":", F.lit(str(seed)), patch.cast("string"), attempt.cast("string"), F.lit(slot))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 12), 16, 10).cast("double") / UNIT


def _below(u: Column, n: Column) -> Column:
    """A whole number in [0, n)."""
    return F.floor(u * n).cast("long")


def _looked_up(asked: DataFrame, b: Bands, salts: int, work, schema: str) -> DataFrame:
    """asked (img, band, ...) met with its bands, which are sent to each salt; work(planes, first row, asked) -> columns."""
    planes, key = b.planes, b.key
    spread = b.df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = asked.withColumn("salt", F.pmod("patch", F.lit(salts)).cast("int"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key, left, right):
        if not len(left) or not len(right):
            return pa.table({"img": pa.array([], right.column("img").type)} | {n: pa.array([], k) for n, k in kinds.items()})
        got = work(_arrays(left, 0, planes), left.column("y0")[0].as_py(), right)
        return pa.table({"img": pa.array([key[0].as_py()] * len(got[names[0]]), right.column("img").type)} | {n: pa.array(got[n], kinds[n]) for n in names})

    kinds = {f.split()[0]: {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in schema.split(", ")}
    return salted.groupBy("img", "band", "salt").cogroup(spread.groupBy("img", "band", "salt")).applyInArrow(lambda k, l, r: run(k, r, l), f"img {key}, {schema}")


def summed(mask: np.ndarray) -> np.ndarray:
    """Positives above and to the left of each corner."""
    out = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), np.int64)
    out[1:, 1:] = np.cumsum(np.cumsum(mask > 0, axis=0), axis=1)
    return out


def _profiles(b: Bands, names: tuple[str, ...]) -> DataFrame:
    """(img, height, width, bands: their numbers, first rows and positives of each plane), a row per image."""
    planes, key = b.pick(*names).planes, b.key

    def work(batches):
        for batch in batches:
            for i in range(len(batch)):
                arrays = _arrays(batch, i, planes)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()], batch.schema.field(0).type), pa.array([batch.column(1)[i].as_py()], pa.int64()), pa.array([batch.column(2)[i].as_py()], pa.int64()), *[pa.array([int((a > 0).sum())], pa.int64()) for a in arrays.values()]], names=["img", "band", "y0", *names])

    counts = b.df.select("img", "band", "y0", "width", *names).mapInArrow(work, f"img {key}, band bigint, y0 bigint" + "".join(f", {n} bigint" for n in names))
    sizes = b.df.groupBy("img").agg(F.max("width").cast("long").alias("width"), F.max(F.col("y0") + F.col("n")).alias("height"))
    listed = counts.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("band", *names))).alias("bands"), *[F.sum(n).alias(n) for n in names])
    return sizes.join(listed, "img")


def sample(b: Bands, mask: str, patches: int, size: int, positive: float = 0.7, boundary: float = 0.0, least: int = 256, attempts: int = 40, seed: int = 7) -> DataFrame:
    """(patch, img, y0, x0, attempt, wanted, positives): `patches` windows of size x size from images drawn evenly.

    With probability `positive` an attempt wants positives: it puts the window around a positive pixel at random (with
    probability `boundary` one at the mask's boundary, if there is any), and is accepted if the window holds `least` of
    them; if the image has none, it looks anywhere, and is as hard to accept. Other attempts look anywhere and are
    accepted. If none of the attempts is, a last one, number `attempts`, looks anywhere. Windows lie inside the image as
    far as it is large enough. No images give no patches.
    """
    edged = over(b.pick(mask), 1, {"edge": "uint8"}, lambda p: {"edge": dilated(p[mask], square(1)) - eroded(p[mask], square(1))}, (mask,))
    images = numbered(_profiles(edged, (mask, "edge")), "number", "img", start=0)
    total = images.count()
    if not total:
        return images.select(F.lit(0).cast("long").alias("patch"), "img", F.lit(0).cast("long").alias("y0"), F.lit(0).cast("long").alias("x0"), F.lit(0).alias("attempt"), F.lit(True).alias("wanted"), F.lit(0).cast("long").alias("positives"))
    tries = b.df.sparkSession.range(patches).withColumnRenamed("id", "patch").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts))))
    u = lambda slot: drawn(F.col("patch"), F.col("attempt"), slot, seed)
    tries = tries.withColumns({"number": _below(u("image"), F.lit(total)), "wanted": (u("kind") < positive) & (F.col("attempt") < attempts)})
    met = tries.join(images, "number").withColumn("around", F.col("wanted") & (F.col(mask) > 0))
    met = met.withColumn("edges", F.col("around") & (F.col("edge") > 0) & (u("boundary") < boundary))
    room = lambda side: F.greatest(F.lit(0).cast("long"), F.col(side) - size)
    kept = ["patch", "attempt", "img", "wanted"]
    anywhere = met.where("NOT around").select(*kept, _below(u("y"), room("height") + 1).alias("y0"), _below(u("x"), room("width") + 1).alias("x0"))
    # the band that holds the drawn pixel, and which of the band's it is
    rank = _below(u("pixel"), F.when(F.col("edges"), F.col("edge")).otherwise(F.col(mask)))
    held = lambda x: F.when(F.col("edges"), x["edge"]).otherwise(x[mask])
    walked = met.where("around").withColumn("rank", rank).withColumn(
        "at", F.aggregate("bands", F.struct(F.col("rank").alias("left"), F.lit(-1).cast("long").alias("band")), lambda a, x: F.when(a["band"] >= 0, a).when(a["left"] < held(x), F.struct(a["left"].alias("left"), x["band"].alias("band"))).otherwise(F.struct((a["left"] - held(x)).alias("left"), a["band"].alias("band"))))
    )
    asked = walked.select(*kept, "edges", "height", "width", F.col("at.band").alias("band"), F.col("at.left").alias("rank"), _below(u("y"), F.lit(size)).alias("dy"), _below(u("x"), F.lit(size)).alias("dx"))
    salts = max(1, patches * attempts // DRAWS)

    def locate(planes, y0, asked):
        edges, rank = asked.column("edges").to_numpy(zero_copy_only=False), asked.column("rank").to_numpy()
        y, x = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for plane, own in ((mask, ~edges), ("edge", edges)):
            at = np.flatnonzero(planes[plane])[rank[own]] if own.any() else np.zeros(0, np.int64)
            y[own], x[own] = at // planes[plane].shape[1], at % planes[plane].shape[1]
        inside = lambda v, side: np.clip(v, 0, np.maximum(0, asked.column(side).to_numpy() - size))
        return {"patch": asked.column("patch"), "attempt": asked.column("attempt"), "y0": inside(y + y0 - asked.column("dy").to_numpy(), "height"), "x0": inside(x - asked.column("dx").to_numpy(), "width")}

    placed = _looked_up(asked, edged, salts, locate_columns(locate), "patch bigint, attempt int, y0 bigint, x0 bigint")
    around = placed.select("patch", "attempt", "img", F.lit(True).alias("wanted"), "y0", "x0")
    windows = around.unionByName(anywhere)
    rows = b.rows
    parts = windows.join(images.select("img", "height"), "img").withColumn("band", F.explode(F.sequence(F.floor(F.col("y0") / rows), F.floor((F.least(F.col("y0") + size, F.col("height")) - 1) / rows))))

    def count(planes, y0, asked):
        s = summed(planes[mask])
        top, left = asked.column("y0").to_numpy() - y0, asked.column("x0").to_numpy()
        a, c = np.clip(top, 0, s.shape[0] - 1), np.clip(top + size, 0, s.shape[0] - 1)
        d, e = np.clip(left, 0, s.shape[1] - 1), np.clip(left + size, 0, s.shape[1] - 1)
        return {"patch": asked.column("patch"), "attempt": asked.column("attempt"), "wanted": asked.column("wanted").cast(pa.int32()), "y0": asked.column("y0"), "x0": asked.column("x0"), "positives": s[c, e] - s[a, e] - s[c, d] + s[a, d]}

    counted = _looked_up(parts.select("patch", "attempt", "img", "wanted", "y0", "x0", "band"), b.pick(mask), salts, locate_columns(count), "patch bigint, attempt int, wanted int, y0 bigint, x0 bigint, positives bigint")
    sums = counted.groupBy("patch", "attempt").agg(F.first("img").alias("img"), F.first("y0").alias("y0"), F.first("x0").alias("x0"), F.first("wanted").alias("wanted"), F.sum("positives").alias("positives"))
    good = sums.where((F.col("wanted") == 0) | (F.col("positives") >= least))
    won = good.groupBy("patch").agg(F.min_by(F.struct("img", "y0", "x0", "attempt", "wanted", "positives"), "attempt").alias("w"))
    return won.select("patch", "w.img", "w.y0", "w.x0", "w.attempt", (F.col("w.wanted") == 1).alias("wanted"), "w.positives")


def locate_columns(work):
    """work's columns as Arrow arrays, whatever they came as."""

    def run(planes, y0, asked):
        return {k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for k, v in work(planes, y0, asked).items()}

    return run


def tensors(windows: DataFrame, b: Bands, size: int, fill: dict[str, float], scale: dict[str, float] | None = None, salts: int = 1) -> DataFrame:
    """(patch, img, y0, x0, channels, data): windows (patch, img, y0, x0) cut out of the planes named in fill, in its order,
    as 32-bit floats, channel after channel; what lies beyond an image is filled. scale: what planes are divided by.

    Windows meet the bands they touch by equality of image and band; pieces of a window are put together in one task."""
    planes, rows, scale = b.pick(*fill).planes, b.rows, scale or {}
    tall = b.df.groupBy("img").agg(F.max(F.col("y0") + F.col("n")).alias("height"))
    last = F.greatest(F.col("y0"), F.least(F.col("y0") + size, F.col("height")) - 1)
    parts = windows.select("patch", "img", "y0", "x0").join(tall, "img").withColumn("band", F.explode(F.sequence(F.floor(F.col("y0") / rows), F.floor(last / rows)))).drop("height")

    def cut(arrays, y0, asked):
        out = {k: [] for k in ("patch", "y0", "x0", "top", "high", "wide", "data")}
        for patch, top, left in zip(*(asked.column(c).to_pylist() for c in ("patch", "y0", "x0")), strict=True):
            a, c = max(0, top - y0), max(0, min(top + size - y0, len(next(iter(arrays.values())))))
            part = np.stack([arrays[p][a:c, left : left + size].astype(np.float32) / np.float32(scale.get(p, 1)) for p in planes])
            for k, v in zip(out, (patch, top, left, a + y0 - top, part.shape[1], part.shape[2], part.tobytes()), strict=True):
                out[k].append(v)
        return out

    pieces = _looked_up(parts, b.pick(*fill), salts, cut, "patch bigint, y0 bigint, x0 bigint, top int, high int, wide int, data binary")
    count, values = len(planes), np.array(list(fill.values()), np.float32)

    def join(key, table):
        whole = np.empty((count, size, size), np.float32)
        whole[:] = values[:, None, None]
        for i in range(len(table)):
            top, high, wide = (table.column(c)[i].as_py() for c in ("top", "high", "wide"))
            whole[:, top : top + high, :wide] = np.frombuffer(table.column("data")[i].as_buffer(), np.float32).reshape(count, high, wide)
        return pa.table({"patch": table.column("patch").slice(0, 1), "img": table.column("img").slice(0, 1), "y0": table.column("y0").slice(0, 1), "x0": table.column("x0").slice(0, 1), "channels": pa.array([count], pa.int32()), "data": pa.array([whole.tobytes()], pa.binary())})

    return pieces.groupBy("patch").applyInArrow(join, f"patch bigint, img {b.key}, y0 bigint, x0 bigint, channels int, data binary")
