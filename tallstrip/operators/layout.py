"""Stacking pages into strips and cutting strips into parts: sizes, offsets, chunks, tiles, windows and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import scaled_height


def target_widths(pages: DataFrame, mode: str = "most-common", fixed: int | None = None) -> DataFrame:
    """(chapter, target): the width that a chapter's pages are brought to; of equally common widths the one seen first."""
    if fixed is not None:
        if fixed <= 0:
            raise ValueError("a fixed width must be above 0")
        return pages.groupBy("chapter").agg(F.lit(fixed).alias("target"))
    if mode == "most-common":
        counted = pages.groupBy("chapter", "width").agg(F.count("*").alias("n"), F.min("page").alias("first"))
        return counted.groupBy("chapter").agg(F.max_by("width", F.struct("n", -F.col("first"))).alias("target"))
    if mode == "max-width":
        return pages.groupBy("chapter").agg(F.max("width").alias("target"))
    if mode == "min-width":
        return pages.groupBy("chapter").agg(F.min("width").alias("target"))
    if mode == "none":
        ends = pages.groupBy("chapter").agg(F.min("width").alias("low"), F.max("width").alias("high"))
        return ends.select("chapter", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.lit("pages of different widths")).cast("int")).alias("target"))
    raise ValueError(f"unknown mode {mode}")


def stack(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """(chapter, page, width, height, new_width, new_height, y): pages scaled to the target, and where each begins."""
    sized = pages.join(targets, "chapter").withColumn("new_height", scaled_height(F.col("width"), F.col("height"), F.col("target")))
    before = Window.partitionBy("chapter").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return sized.select("chapter", "page", "width", "height", F.col("target").alias("new_width"), "new_height", F.coalesce(F.sum("new_height").over(before), F.lit(0)).cast("long").alias("y"))


def stack_centred(pages: DataFrame) -> DataFrame:
    """(chapter, page, x, y): pages of any width, centred in the widest."""
    before = Window.partitionBy("chapter").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    widest = F.max("width").over(Window.partitionBy("chapter"))
    return pages.select("chapter", "page", F.floor((widest - F.col("width")) / 2).cast("int").alias("x"), F.coalesce(F.sum("height").over(before), F.lit(0)).cast("long").alias("y"))


def chunks(strips: DataFrame, size: int, *keys: str, start: int = 1) -> DataFrame:
    """(keys, part, y0, y1): parts of a fixed height, the last one shorter."""
    cut = strips.where("height > 0").select(*keys, "height", F.posexplode(F.sequence(F.lit(0), F.col("height").cast("long") - 1, F.lit(size))).alias("i", "y0"))
    return cut.select(*keys, (F.col("i") + start).alias("part"), "y0", F.least(F.col("y0") + size, F.col("height").cast("long")).alias("y1"))


def padded_side(length: Column, tile: int, stride: int) -> Column:
    return F.when(length <= tile, tile).otherwise(F.ceil((length - tile) / stride) * stride + tile)


def tiles(images: DataFrame, tile: int = 768, overlap: int = 96, *keys: str) -> DataFrame:
    """(keys, ty, tx): tile origins that cover each image (width, height), padded as far as the grid needs."""
    stride = tile - overlap
    grid = images.select(*keys, padded_side(F.col("height"), tile, stride).cast("long").alias("ph"), padded_side(F.col("width"), tile, stride).cast("long").alias("pw"))
    rows = grid.select(*keys, "pw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ph") - tile, F.lit(stride).cast("long"))).alias("ty"))
    return rows.select(*keys, "ty", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pw") - tile, F.lit(stride).cast("long"))).alias("tx"))


def halo_windows(windows: DataFrame, rows: DataFrame, margin: int = 300) -> DataFrame:
    """Rows (img, y, ...) with each window (img, name, y0, h) whose surroundings they are in; centre marks its own rows.

    Rows are matched by blocks of 1024, so no window meets all rows.
    """
    wide = windows.select("img", "name", "y0", "h", F.explode(F.sequence(F.floor((F.col("y0") - margin) / 1024), F.floor((F.col("y0") + F.col("h") + margin - 1) / 1024))).alias("block"))
    found = rows.withColumn("block", F.floor(F.col("y") / 1024)).join(wide, ["img", "block"]).where((F.col("y") >= F.col("y0") - margin) & (F.col("y") < F.col("y0") + F.col("h") + margin))
    return found.withColumn("centre", (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("h"))).drop("block")


def bands(strips: DataFrame, rows: int, halo: int, *keys: str) -> DataFrame:
    """(keys, band, y0, y1, from, to): bands of a strip, and the rows each needs to be right inside."""
    cut = chunks(strips, rows, *keys, start=0)
    tall = strips.select(*keys, F.col("height").cast("long").alias("height"))
    return cut.join(tall, list(keys)).select(*keys, F.col("part").alias("band"), "y0", "y1", F.greatest(F.lit(0), F.col("y0") - halo).alias("from"), F.least(F.col("height"), F.col("y1") + halo).alias("to"))


def side_by_side(columns: DataFrame, gap: int = 12, *keys: str) -> DataFrame:
    """(keys, col, x, total): where each column of a row begins, with gaps between, and the row's width."""
    order = Window.partitionBy(*keys).orderBy("col")
    x = F.coalesce(F.sum(F.col("width") + gap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy(*keys)
    return columns.select(*keys, "col", x.cast("long").alias("x"), (F.sum("width").over(whole) + gap * (F.count("*").over(whole) - 1)).cast("long").alias("total"))


def ruler(heights: DataFrame, every: int = 100, major: int = 10, *keys: str) -> DataFrame:
    """(keys, y, major): ticks down an image, each major-th one marked."""
    ticks = heights.where("height > 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1, F.lit(every).cast("long"))).alias("y"))
    return ticks.withColumn("major", F.col("y") % (every * major) == 0)


def schedule(items: DataFrame, fps: int = 30, hold: float = 2.0, fade: float = 0.6, pause: float = 0.35, *keys: str) -> DataFrame:
    """(keys, frame, item, next, alpha): frames of a comparison. Each item (ord, item) is held, then fades into the next;
    after the last comes a pause."""
    order = Window.partitionBy(*keys).orderBy("ord")
    n_hold, n_fade, n_pause = (int(round(s * fps)) for s in (hold, fade, pause))
    rows = items.withColumn("next", F.lead("item").over(order)).withColumn("at", F.row_number().over(order) - 1)
    held = rows.select(*keys, "at", F.explode(F.sequence(F.lit(0), F.when(F.col("next").isNull(), n_hold + n_pause - 1).otherwise(n_hold - 1))).alias("i"), "item", F.lit(None).cast("string").alias("next"), F.lit(0.0).alias("alpha"))
    fading = rows.where("next IS NOT NULL").select(*keys, "at", F.explode(F.sequence(F.lit(0), F.lit(n_fade - 1))).alias("j"), "item", "next").select(*keys, "at", (F.col("j") + n_hold).alias("i"), "item", "next", ((F.col("j") + 1) / n_fade).alias("alpha"))
    both = held.unionByName(fading)
    return both.select(*keys, (F.col("at") * (n_hold + n_fade) + F.col("i")).alias("frame"), "item", "next", "alpha")


def view_geometry(width: Column, height: Column, y: Column, video_width: int, view: int, zoom: float) -> Column:
    """Where a zoomed view of an image begins and how large it is on the canvas."""
    sh, sw = round(view / zoom), round(video_width / zoom)
    top = F.when(height <= sh, 0).otherwise(F.greatest(F.lit(0), F.least(y, height - sh)))
    cw, ch = F.least(width, F.lit(sw)), F.least(height, F.lit(sh))
    new_w = F.greatest(F.lit(1), F.bround(cw * zoom, 0).cast("int"))
    return F.struct(top.alias("y"), F.when(width > sw, F.floor((width - sw) / 2)).otherwise(0).cast("int").alias("x0"), cw.alias("crop_width"), ch.alias("crop_height"), new_w.alias("new_width"), F.greatest(F.lit(1), F.bround(ch * zoom, 0).cast("int")).alias("new_height"), F.floor((F.lit(video_width) - new_w) / 2).cast("int").alias("x"))


def resampled(points: DataFrame, stride: float, *keys: str) -> DataFrame:
    """(keys, k, x, y): points of closed outlines (ord, x, y), evenly spaced along their length.

    Lengths are summed along the outline; each target goes to the first point that the sum has reached.
    """
    order = Window.partitionBy(*keys).orderBy("ord")
    first = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("x").over(order), F.first("x").over(first)), F.coalesce(F.lead("y").over(order), F.first("y").over(first))
    step = points.withColumn("d", F.sqrt(F.pow(nx - F.col("x"), 2) + F.pow(ny - F.col("y"), 2)))
    cum = F.coalesce(F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    along = step.withColumns({"cum": cum, "total": F.sum("d").over(Window.partitionBy(*keys)), "last": F.coalesce(F.lag(cum).over(order), F.lit(-1.0)), "size": F.count("*").over(Window.partitionBy(*keys))})
    along = along.where("size >= 2 AND total >= 1").withColumn("n", F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") / stride)))
    gap = F.col("total") / F.col("n")
    is_last = F.lead("ord").over(order).isNull()
    # quotients may round across a whole number, so one more target is tried at either end, and products decide
    low = F.greatest(F.lit(0).cast("long"), F.floor(F.col("last") / gap))
    high = F.when(is_last, F.col("n") - 1).otherwise(F.least(F.col("n") - 1, F.floor(F.col("cum") / gap) + 1))
    tried = along.withColumns({"gap": gap, "end": is_last, "low": low, "high": high}).where("low <= high").withColumn("k", F.explode(F.sequence("low", "high")))
    target = F.col("k") * F.col("gap")
    return tried.where((target > F.col("last")) & (F.col("end") | (target <= F.col("cum")))).select(*keys, "k", "x", "y")


def crops(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    """Pixels of each segment (img, idx, y0, y1), y counted from its top. Rows are matched by blocks of 1024."""
    wide = segments.select("img", "idx", "y0", "y1", F.explode(F.sequence(F.floor(F.col("y0") / 1024), F.floor((F.col("y1") - 1) / 1024))).alias("block"))
    found = pixels.withColumn("block", F.floor(F.col("y") / 1024)).join(wide, ["img", "block"]).where((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    return found.withColumn("y", (F.col("y") - F.col("y0")).cast("int")).drop("block", "y0", "y1")


def patches(centres: DataFrame, pixels: DataFrame, size: int, fill: dict[str, int]) -> DataFrame:
    """Square patches around centres (img, patch, y, x): (img, patch, dy, dx, inside, ...), pixels beyond the image filled."""
    half = size // 2
    grid = centres.select("img", "patch", (F.col("y") - half).alias("top"), (F.col("x") - half).alias("left"))
    grid = grid.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    grid = grid.select("img", "patch", "dy", "dx", (F.col("top") + F.col("dy")).cast("int").alias("y"), (F.col("left") + F.col("dx")).cast("int").alias("x"))
    got = grid.join(pixels.select("img", "y", "x", *fill).withColumn("inside", F.lit(True)), ["img", "y", "x"], "left")
    return got.select("img", "patch", "dy", "dx", F.coalesce("inside", F.lit(False)).alias("inside"), *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fill.items()])


def output_mode(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, mode): RGBA if any part (n_channels) has alpha."""
    return parts.groupBy(*keys).agg(F.when(F.bool_or(F.col("n_channels") == 4), "RGBA").otherwise("RGB").alias("mode"))
