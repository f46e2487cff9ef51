"""Scores, confusion in both directions, flips, and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import guarded_percent, percent, priority, success
from .ranking import numbered
from .masks import damaged, deleted_in_result, gray, leftover_line, saturation


def score(pixels: DataFrame, *keys: str, edge: Column | None = None) -> DataFrame:
    """One row per strip: counts of deleted, damaged and leftover pixels, percentages, and the scores made of them.

    pixels holds r, g, b of the original, and either alpha a of the result or its gray in result_gray (null a).
    """
    result = F.col("result_gray") if "result_gray" in pixels.columns else F.lit(None).cast("int")
    g, s = gray(), saturation()
    gone = deleted_in_result(F.col("a"), result, g, s)
    marked = pixels.select(*keys, gone.alias("d"), damaged(gone, g, s, edge).alias("m"), leftover_line(gone, g, s, edge).alias("l"))
    return of_counts(marked.groupBy(*keys).agg(F.count("*").alias("total_pixels"), F.count_if("d").alias("deleted_pixels"), F.count_if("m").alias("damaged_pixels"), F.count_if("l").alias("leftover_grayline_pixels")))


def of_counts(sums: DataFrame) -> DataFrame:
    """Percentages and scores of counted pixels."""
    dd, dt = guarded_percent(F.col("damaged_pixels"), F.col("deleted_pixels")), guarded_percent(F.col("damaged_pixels"), F.col("total_pixels"))
    lt, tt = guarded_percent(F.col("leftover_grayline_pixels"), F.col("total_pixels")), guarded_percent(F.col("deleted_pixels"), F.col("total_pixels"))
    named = sums.withColumns({"damage_percent_deleted": dd, "damage_percent_total": dt, "delete_percent_total": tt, "leftover_grayline_percent_total": lt})
    a, b, c = F.col("damage_percent_deleted"), F.col("damage_percent_total"), F.col("leftover_grayline_percent_total")
    return named.withColumns({"estimated_success_percent": success(a, c), "priority_score": priority(a, b, c)})


def ranked(scores: DataFrame, *ties: str) -> DataFrame:
    """Scores with their rank by priority, from 1."""
    return numbered(scores, "rank", F.desc("priority_score"), *ties)


def report(scores: DataFrame) -> DataFrame:
    """Report columns with their fixed decimals."""
    three = ["estimated_success_percent", "priority_score", "damage_percent_deleted", "damage_percent_total", "delete_percent_total"]
    return scores.withColumns({c: F.format_string("%.3f", c) for c in three} | {"leftover_grayline_percent_total": F.format_string("%.5f", "leftover_grayline_percent_total")})


def delete_ratio(pixels: DataFrame, delete: Column) -> DataFrame:
    """(ratio): deleted pixels of all targets, as one aggregate."""
    return pixels.agg((F.sum(F.when(delete, 1.0).otherwise(0.0)) / F.count("*")).alias("ratio"))


def confusion(rows: DataFrame, predicted: Column, truth: Column, *keys: str) -> DataFrame:
    """(keys, over, under, total, over_pct, under_pct): deleted but to be kept, kept but to be deleted; always both."""
    got = rows.groupBy(*keys).agg(F.count_if(predicted & ~truth).alias("over"), F.count_if(~predicted & truth).alias("under"), F.count("*").alias("total"))
    return got.withColumns({"over_pct": percent(F.col("over"), F.col("total")), "under_pct": percent(F.col("under"), F.col("total"))})


def flip_accuracy(rows: DataFrame, before: Column, after: Column, truth: Column, *keys: str) -> DataFrame:
    """(keys, direction, n, right): pixels that a step changed, by direction, and how many of them rightly."""
    direction = F.when(before & ~after, "del_to_keep").when(~before & after, "keep_to_del")
    flips = rows.select(*keys, direction.alias("direction"), (after == truth).alias("ok")).where("direction IS NOT NULL")
    return flips.groupBy(*keys, "direction").agg(F.count("*").alias("n"), F.count_if("ok").alias("right"))


def flip_overlap(rows: DataFrame, first: Column, second: Column, *keys: str) -> DataFrame:
    """(keys, first_n, both_n, ratio): how much of one set of flips another contains; null where there are none."""
    got = rows.groupBy(*keys).agg(F.count_if(first).alias("first_n"), F.count_if(first & second).alias("both_n"))
    return got.withColumn("ratio", F.round(F.col("both_n") / F.when(F.col("first_n") > 0, F.col("first_n")), 6))


def top_bands(bands: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "y0")
    return bands.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dice_bce(rows: DataFrame, p: Column, t: Column, sample: str, weight: float = 0.65) -> DataFrame:
    """(bce, dice, loss): mean cross-entropy over all rows, and one less the mean of the samples' smoothed Dice."""
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    entropy = -(t * F.log(q) + (1 - t) * F.log(1 - q))
    each = rows.groupBy(sample).agg(F.sum(p * t).alias("pt"), F.sum(p).alias("p"), F.sum(t).alias("t"), F.sum(entropy).alias("e"), F.count("*").alias("n"))
    both = each.agg((F.sum("e") / F.sum("n")).alias("bce"), (1 - F.avg((2 * F.col("pt") + 1) / (F.col("p") + F.col("t") + 1))).alias("dice"))
    return both.withColumn("loss", F.col("bce") * (1 - weight) + F.col("dice") * weight)


def smooth_l1(difference: Column) -> Column:
    size = F.abs(difference)
    return F.when(size < 1, 0.5 * difference * difference).otherwise(size - 0.5)


def best_epoch(losses: DataFrame, *keys: str) -> DataFrame:
    """(keys, epoch, loss): the least validation loss; the earlier one of equal ones."""
    return losses.groupBy(*keys).agg(F.min(F.struct("loss", "epoch")).alias("best")).select(*keys, "best.epoch", "best.loss")
