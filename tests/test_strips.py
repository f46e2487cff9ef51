import numpy as np
import pytest
from pyspark.sql import functions as F

from tallstrip.operators import layout, strips
from tallstrip.operators.bands import pack, sizes

from .test_bands import plane, several


def plain_resize(a, new, axis):
    """From the definition, pixel by pixel: a sinc under a sinc three times as wide, both widened for smaller sizes."""
    a = np.moveaxis(a.astype(float), axis, 0)
    scale = len(a) / new
    wide = max(scale, 1)
    out = np.zeros((new, *a.shape[1:]))
    for o in range(new):
        centre = (o + 0.5) * scale
        w = np.array([np.sinc(x) * np.sinc(x / 3) if abs(x) < 3 else 0 for x in (np.arange(len(a)) + 0.5 - centre) / wide])
        out[o] = (a * (w / w.sum())[:, None]).sum(axis=0)
    return np.moveaxis(np.clip(np.floor(out + 0.5), 0, 255), 0, axis)


@pytest.mark.parametrize("size, new", [(10, 10), (10, 7), (10, 23), (40, 3), (1, 5), (7, 1)])
def test_resizing(size, new):
    a = np.random.default_rng(size).integers(0, 256, (size, 4)).astype(np.uint8)
    low, weights = strips.lanczos(size, new)
    assert np.abs(strips.filtered(a, low, weights) - plain_resize(a, new, 0)).max() <= 1
    assert (np.abs(weights.sum(axis=1) - (1 << strips.BITS)) < weights.shape[1]).all()


@pytest.mark.parametrize("rows, out", [(5, 9), (64, 64), (64, 3)])
def test_pages_are_stacked_whatever_the_bands(spark, rows, out):
    px, arrays = several(spark, [(31, 20), (24, 14), (9, 20), (50, 33)], 1)
    b = pack(px, {"v": "uint8"}, rows)
    pages = sizes(b).select(F.lit("c").alias("chapter"), F.col("img").alias("page"), "width", "height")
    plan = layout.stack(pages, layout.target_widths(pages)).withColumn("img", F.col("page"))
    made = strips.stacked(b, plan, out)
    parts = []
    for a in (x["v"] for x in arrays):
        a = a.astype(np.uint8)
        h, w = a.shape
        if w != 20:
            a = np.ascontiguousarray(strips.filtered(a.T, *strips.lanczos(w, 20)).T)
            new = max(1, round(h * 20 / w))
            a = strips.filtered(a, *strips.lanczos(h, new)) if new != h else a
        parts.append(a)
    want = np.concatenate(parts)
    (size,) = sizes(made).collect()
    assert (size.img, size.width, size.height) == ("c", 20, len(want))
    assert (plane(made, "v", "c", want.shape) == want).all()


def test_parts_go_out_and_come_back(spark):
    px, arrays = several(spark, [(37, 11), (20, 15)], 2)
    b = pack(px, {"v": "uint8"}, 8)
    cut = layout.chunks(sizes(b), 10, "img", "width", start=0)
    number = F.col("img") * 10 + F.col("part")
    moves = cut.select("img", number.alias("target"), F.col("y0").alias("from"), F.col("y1").alias("to"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("x"))
    parts = strips.moved(b, moves, cut.select(number.alias("target"), "width", (F.col("y1") - F.col("y0")).alias("height")), {"v": 0}, 6)
    back = cut.select(number.alias("img"), F.lit(0).alias("target"), F.lit(0).cast("long").alias("from"), (F.col("y1") - F.col("y0")).alias("to"), (F.col("y0") + F.col("img") * 37).alias("at"), (2 * (1 - F.col("img"))).alias("x"))
    whole = strips.moved(parts, back, spark.createDataFrame([(0, 15, 57)], "target int, width int, height int"), {"v": 9}, 16)
    want = np.full((57, 15), 9)
    want[:37, 2:13], want[37:] = arrays[0]["v"], arrays[1]["v"]
    assert (plane(whole, "v", 0, (57, 15)) == want).all()
