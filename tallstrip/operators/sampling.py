"""Samples that are the same on every run: a row's draw is a hash of a seed and its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A portable multiplicative hash, in 31 bits.
MULTIPLIER, MODULUS = 48271, 2147483647


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from integer arithmetic alone."""
    x = (key.cast("long") + seed) % MODULUS
    x = (x * MULTIPLIER + 11) % MODULUS
    x = (x * MULTIPLIER + 7) % MODULUS
    return x.cast("double") / MODULUS


def stratified(rows: DataFrame, stratum: str, key: str, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """The rows whose draw is below their stratum's share."""
    share = F.lit(0.0)
    for name, value in shares.items():
        share = F.when(F.col(stratum) == name, F.lit(float(value))).otherwise(share)
    return rows.where(draw(F.col(key), seed) < share)


def patch_centres(pixels: DataFrame, positive: Column, patches: int, share: float = 0.7, seed: int = 7) -> DataFrame:
    """(img, patch, y, x): for each patch of an image the pixel with the least draw, among positive ones for `share` of
    the patches and among all for the others; an image without positives has uniform ones only."""
    marked = pixels.select("img", "y", "x", positive.alias("p"), (F.col("y") * 65536 + F.col("x")).alias("key"))

    def least(patch: int) -> Column:
        wanted = draw(F.lit(patch * 1009) + F.col("img"), seed) < share
        order = F.struct(F.when(wanted & ~F.col("p"), 1).otherwise(0).alias("late"), draw(F.col("key") + patch * 7919, seed).alias("d"), "y", "x")
        return F.min(order).alias(f"m{patch}")

    picked = marked.groupBy("img").agg(*[least(i) for i in range(patches)])
    return picked.select("img", F.posexplode(F.array(*[f"m{i}" for i in range(patches)])).alias("patch", "m")).select("img", "patch", "m.y", "m.x")


def stratum_picks(rows: DataFrame, key: str, weights: dict[str, float], seed: int = 7) -> DataFrame:
    """(key, stratum): a stratum per row by cumulated weights."""
    d, at, picked = draw(F.col(key), seed), 0.0, None
    for name, weight in weights.items():
        at += weight
        picked = F.when(d < at, name) if picked is None else picked.when(d < at, name)
    return rows.select(key, picked.otherwise(list(weights)[-1]).alias("stratum"))


def augment(pixels: DataFrame, seed: int = 7, width: int = 64) -> DataFrame:
    """Mirrors half of the images; contrast .92 to 1.08 and brightness within .04 for six of ten, colours only."""
    flip, change = draw(F.col("img"), seed) < 0.5, draw(F.col("img"), seed + 1) < 0.6
    contrast, brightness = 0.92 + 0.16 * draw(F.col("img"), seed + 2), (draw(F.col("img"), seed + 3) - 0.5) * 0.08 * 255
    tone = lambda c: F.when(change, F.greatest(F.lit(0), F.least(F.lit(255), F.round((F.col(c) - 127.5) * contrast + 127.5 + brightness).cast("int")))).otherwise(F.col(c))
    return pixels.withColumns({c: tone(c) for c in ("r", "g", "b")}).withColumn("x", F.when(flip, width - 1 - F.col("x")).otherwise(F.col("x")))


def zoomed(pixels: DataFrame, width: int, height: int, most: float = 1.5, seed: int = 7) -> DataFrame:
    """Each image enlarged about its centre by a factor from 1 to `most`, to its own size, by nearest neighbours. Each pixel
    goes to the places that show it, so images neither move nor meet a grid."""
    out = pixels.where("img IS NOT NULL").withColumn("_factor", 1 + (most - 1) * draw(F.col("img"), seed))
    for c, n in (("y", height), ("x", width)):
        shown = F.floor((F.col(f"_{c}") + 0.5 - n / 2) / F.col("_factor") + n / 2)
        start = lambda p, n=n: (p - n / 2) * F.col("_factor") + n / 2 - 0.5
        low, high = F.greatest(F.lit(0), F.floor(start(F.col(c))).cast("int") - 1), F.least(F.lit(n - 1), F.ceil(start(F.col(c) + 1)).cast("int") + 1)
        out = out.withColumn(f"_{c}", F.explode(F.when(low <= high, F.sequence(low, high)))).where(shown == F.col(c))
    return out.select("img", F.col("_y").alias("y"), F.col("_x").alias("x"), *[c for c in pixels.columns if c not in ("img", "y", "x")])


def accepted(positives: Column, wanted: Column, least: int = 256) -> Column:
    """Whether a patch that is to hold positives holds enough."""
    return ~wanted | (positives >= least)
