"""From rows with content to crops: runs, merged gaps, padded bounds, groups, and the folds over them.

Window functions do what compares neighbours; what depends on all that came before is one fold over an image's sorted
runs, inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    pad_top: int = 80
    pad_bottom: int = 80
    margin: int = 2
    merge_gap: int = 20
    row_pixels: int = 5
    min_height: int = 40
    target_height: int = 900
    post_gap: int = 120
    post_height: int = 1800
    standalone: int = 650
    unique_shift: int = 16


#: Reasons as reports spell them.
SAFE, OVERSIZED, MERGED, MERGED_OVERSIZED, FORCED = "safe", "oversized_content_block_kept_intact", "merged_small_or_nearby", "merged_with_oversized_neighbor", "unsafe_forced_split"


def islands(rows: DataFrame, *keys: str, at: str = "y") -> DataFrame:
    """(keys, y0, y1): maximal runs [y0, y1) of consecutive values; gaps and islands."""
    order = Window.partitionBy(*keys).orderBy(at)
    marked = rows.withColumn("_island", F.col(at) - F.row_number().over(order))
    return marked.groupBy(*keys, "_island").agg(F.min(at).alias("y0"), (F.max(at) + 1).alias("y1")).drop("_island")


def merge_gaps(runs: DataFrame, gap: int, *keys: str) -> DataFrame:
    """Successive runs no further apart than gap become one."""
    order = Window.partitionBy(*keys).orderBy("y0")
    opened = runs.withColumn("_new", F.when(F.col("y0") - F.lag("y1").over(order) <= gap, 0).otherwise(1))
    grouped = opened.withColumn("_group", F.sum("_new").over(order))
    return grouped.groupBy(*keys, "_group").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1")).drop("_group")


def flip_bands(flips: DataFrame, gap: int, *keys: str) -> DataFrame:
    """(keys, y0, y1, n): bands of rows with flips (y, n), both ends inclusive; a new one after more than gap rows."""
    order = Window.partitionBy(*keys).orderBy("y")
    opened = flips.withColumn("_new", F.when(F.col("y") - F.lag("y").over(order) <= gap, 0).otherwise(1))
    grouped = opened.withColumn("_group", F.sum("_new").over(order))
    return grouped.groupBy(*keys, "_group").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum("n").alias("n")).drop("_group")


def _bounds(raw0: Column, raw1: Column, before: Column, after: Column, height: Column, p: Params) -> tuple[Column, Column]:
    """Padding that stops short of the neighbours (null: none), never inside the content, never outside the image."""
    top = F.coalesce(F.least(height, before + p.margin), F.lit(0))
    bottom = F.coalesce(F.greatest(F.lit(0), after - p.margin), height)
    y0 = F.least(F.greatest(top, raw0 - p.pad_top), raw0)
    y1 = F.greatest(F.least(bottom, raw1 + p.pad_bottom), raw1)
    y0, y1 = F.greatest(F.lit(0), F.least(y0, height)), F.greatest(F.lit(0), F.least(y1, height))
    return F.when(y1 <= y0, raw0).otherwise(y0), F.when(y1 <= y0, raw1).otherwise(y1)


def padded_bounds(runs: DataFrame, p: Params = Params()) -> DataFrame:
    """(img, y0, y1, top, bottom) of each run by itself; runs holds (img, y0, y1, height)."""
    order = Window.partitionBy("img").orderBy("y0")
    top, bottom = _bounds(F.col("y0"), F.col("y1"), F.lag("y1").over(order), F.lead("y0").over(order), F.col("height"), p)
    return runs.select("img", "y0", "y1", top.alias("top"), bottom.alias("bottom"))


_SEGMENT = "struct<y0:int,y1:int,reason:string>"


def _sorted_list(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    return df.groupBy("img").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"), *more)


def _exploded(df: DataFrame) -> DataFrame:
    out = df.select("img", F.posexplode("rows").alias("idx", "s"))
    return out.select("img", "idx", "s.y0", "s.y1", (F.col("s.y1") - F.col("s.y0")).alias("height"), "s.reason")


def group_runs(runs: DataFrame, p: Params = Params()) -> DataFrame:
    """Segments of neighbouring runs while their padded height stays within the target; a taller run stays whole.

    Runs below min_height go first, so padding may reach over them. Each image is one fold over its runs: the state is
    the list of groups so far, of which the last is open.
    """
    useful = runs.where(F.col("y1") - F.col("y0") >= p.min_height)
    order = Window.partitionBy("img").orderBy("y0")
    useful = useful.withColumns({"before": F.lag("y1").over(order), "after": F.lead("y0").over(order)}).select("img", "height", *[F.col(c).cast("int").alias(c) for c in ("y0", "y1", "before", "after")])
    lists = _sorted_list(useful, ["y0", "y1", "before", "after"], F.first("height").cast("int").alias("height"))

    def padded(x: Column) -> tuple[Column, Column]:
        return _bounds(x["y0"], x["y1"], x["before"], x["after"], F.col("height"), p)

    def step(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["y0"].alias("y0"), run["y1"].alias("y1"), last["before"].alias("before"), run["after"].alias("after"))
        top, bottom = padded(joined)
        fits = (bottom - top <= p.target_height) if p.target_height > 0 else F.lit(True)
        return F.when(F.size(done) == 0, F.array(run)).when(fits, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(run)))

    empty = F.expr("CAST(array() AS array<struct<y0:int,y1:int,before:int,after:int>>)")
    folded = lists.select("img", "height", F.aggregate("rows", empty, step).alias("groups"))

    def segment(x: Column) -> Column:
        top, bottom = padded(x)
        over = (bottom - top > p.target_height) if p.target_height > 0 else F.lit(False)
        return F.struct(top.cast("int").alias("y0"), bottom.cast("int").alias("y1"), F.when(over, OVERSIZED).otherwise(SAFE).alias("reason"))

    return _exploded(folded.select("img", F.transform("groups", segment).alias("rows")))


def _fold(segments: DataFrame, step) -> DataFrame:
    lists = _sorted_list(segments.select("img", F.col("y0").cast("int").alias("y0"), F.col("y1").cast("int").alias("y1"), "reason"), ["y0", "y1", "reason"])
    empty = F.expr(f"CAST(array() AS array<{_SEGMENT}>)")
    return _exploded(lists.select("img", F.aggregate("rows", empty, step).alias("rows")))


def post_merge(segments: DataFrame, p: Params = Params()) -> DataFrame:
    """Near segments become one while it stays within post_height and one of them is small, or they overlap."""

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        gap = s["y0"] - last["y1"]
        low, high = F.least(last["y0"], s["y0"]), F.greatest(last["y1"], s["y1"])
        small = (last["y1"] - last["y0"] < p.standalone) | (s["y1"] - s["y0"] < p.standalone)
        merges = (gap <= p.post_gap) & (high - low <= p.post_height) & (small | (gap <= 0))
        reason = F.when((last["reason"] == OVERSIZED) | (s["reason"] == OVERSIZED), MERGED_OVERSIZED).otherwise(MERGED)
        merged = F.struct(low.alias("y0"), high.alias("y1"), reason.alias("reason"))
        return F.when(F.size(done) == 0, F.array(s)).when(merges, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(done, F.array(s)))

    return _fold(segments, step)


def forced_split(segments: DataFrame, max_height: int = 900, overlap: int = 160, min_height: int = 40) -> DataFrame:
    """Segments above max_height cut into overlapping ones; the last ends where the segment does, short tails go. A
    max_height of zero or less leaves them as they are."""
    if max_height <= 0:
        return segments
    step = max(1, max_height - overlap)
    starts = F.when(F.col("y1") - F.col("y0") <= max_height, F.array(F.col("y0"))).otherwise(F.filter(F.sequence(F.col("y0"), F.col("y1") - 1, F.lit(step)), lambda a: (a == F.col("y0")) | (a - step + max_height < F.col("y1"))))
    cut = segments.withColumn("a", F.explode(starts)).withColumn("whole", F.col("y1") - F.col("y0") <= max_height)
    cut = cut.select("img", F.col("a").alias("y0"), F.least(F.when(F.col("whole"), F.col("y1")).otherwise(F.col("a") + max_height), F.col("y1")).alias("y1"), F.when(F.col("whole"), F.col("reason")).otherwise(FORCED).alias("reason"), "whole")
    kept = cut.where(F.col("whole") | (F.col("y1") - F.col("y0") >= min_height))
    order = Window.partitionBy("img").orderBy("y0", "y1")
    return kept.select("img", (F.row_number().over(order) - 1).alias("idx"), "y0", "y1", (F.col("y1") - F.col("y0")).alias("height"), "reason")


def drop_near_duplicates(segments: DataFrame, p: Params = Params()) -> DataFrame:
    """Segments that lie within unique_shift of the last kept one on both sides go."""
    if p.unique_shift <= 0:
        return segments

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        near = (F.abs(s["y0"] - last["y0"]) < p.unique_shift) & (F.abs(s["y1"] - last["y1"]) < p.unique_shift)
        return F.when((F.size(done) > 0) & near, done).otherwise(F.concat(done, F.array(s)))

    return _fold(segments, step)


def detect(profile: DataFrame, heights: DataFrame, p: Params = Params(), unsafe: bool = False) -> DataFrame:
    """Row profiles (img, y, n) and image heights (img, height) to segments."""
    active = profile.where(F.col("n") >= p.row_pixels)
    runs = merge_gaps(islands(active, "img"), p.merge_gap, "img").join(heights, "img")
    merged = post_merge(group_runs(runs, p), p)
    return drop_near_duplicates(forced_split(merged) if unsafe else merged, p)


def reason_counts(segments: DataFrame) -> DataFrame:
    """How many segments were oversized and how many merged, by what their reasons contain."""
    return segments.agg(F.count_if(F.col("reason").contains("oversized")).alias("oversized"), F.count_if(F.col("reason").contains("merged")).alias("merged"), F.count("*").alias("total"))
