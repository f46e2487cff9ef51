"""The whole ways through: evaluate strips, clean them, stack pages, cut samples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import bands, layout, metrics, segment, stencil, topology
from ..operators.bands import Bands
from ..operators.kernels import Scorer, ThresholdScorer, edges, predict
from ..operators.masks import gray
from ..sources.raster import pixels_of, row_profile, runs


@dataclass(frozen=True)
class CleanParams:
    """Steps run in the order in which they stand; a configuration's threshold gives way to one given here."""

    threshold: float | None = None
    tile: int = 768
    overlap: int = 96
    close_radius: int = 1
    open_radius: int = 0
    islands: bool = True
    border_band: int = 3
    darkness: int = 40
    frames: bool = True
    least_interior: int = 10_000
    inset: int = 2
    scorer: Scorer = field(default_factory=ThresholdScorer)


def evaluate(pixels: DataFrame, *keys: str, with_edges: bool = False) -> DataFrame:
    """Ranked scores of strips. with_edges adds the edge term to damage and leftover lines."""
    edge = None
    if with_edges:
        gray_px = pixels.withColumn("gray", gray())
        marks = edges(gray_px, "gray", 50, 150).withColumn("edge", F.lit(True))
        pixels = pixels.join(marks, ["img", "y", "x"], "left").withColumn("edge", F.coalesce("edge", F.lit(False)))
        edge = F.col("edge")
    return metrics.ranked(metrics.score(pixels, *keys, edge=edge), *keys)


def evaluate_bands(strips: Bands, with_edges: bool = False) -> DataFrame:
    """Ranked scores of strips (r, g, b of the original, a of the result) from packed bands: four counts leave a band, and
    with edges a gray plane's halo rows, the runs of edge candidates on bands' first and last rows, and the edge plane
    move."""
    if with_edges:
        marked = bands.mapped(strips, {"gray": "uint8"}, lambda p: {"gray": bands.gray_of(p)}, ("r", "g", "b"), ("r", "g", "b", "a"))
        lined = bands.edges(marked, "gray", 50, 150)
        return metrics.ranked(metrics.of_counts(bands.score_counts(lined, "edge")), "img")
    return metrics.ranked(metrics.of_counts(bands.score_counts(strips)), "img")


def clean_bands(strips: Bands, config_threshold: float = 0.5, p: CleanParams = CleanParams()) -> Bands:
    """The same steps as clean() on packed bands (r, g, b): bands with planes gray and delete.

    Bands move for tiles, for the halo of closing and opening, and for that of borders and strokes; islands and frames
    move as runs. Two tables of packed bands are written, so that runs and bands are made of the same pixels once.
    """
    threshold = config_threshold if p.threshold is None else p.threshold
    px = bands.mapped(strips, {"gray": "uint8"}, lambda q: {"gray": bands.gray_of(q)}, ("r", "g", "b"), ())
    px = bands.predict(px, "gray", p.scorer, {"delete": "uint8"}, lambda s: {"delete": s >= threshold}, p.tile, p.overlap)
    px = bands.postprocess(px, "delete", p.close_radius, p.open_radius).settled("scored")
    if p.islands:
        labelled = topology.label(bands.runs(px, lambda q: q["delete"] == 1, ("delete",)), 8, px.rows)
        px = bands.paint(px, topology.without_islands(labelled, bands.sizes(px)), "delete", keep=("gray",))
    band, darkness = max(0, p.border_band), p.darkness

    def borders(q):
        delete = bands._protected(q["delete"], q["gray"], band, darkness) if band else q["delete"]
        return {"delete": delete, "stroke": bands.closed((q["gray"] <= darkness).astype("uint8"), stencil.ellipse(2))} if p.frames else {"delete": delete}

    if not p.frames:
        return bands.over(px, band, {"delete": "uint8"}, borders, ("delete", "gray"))
    px = bands.over(px, max(band, 4), {"delete": "uint8", "stroke": "uint8"}, borders, ("delete", "gray")).settled("strokes")
    holes = topology.frame_interiors(bands.runs(px, lambda q: q["stroke"] == 1, ("stroke",)), p.least_interior, px.rows)
    inside = bands.eroded_runs(holes, stencil.ellipse(p.inset), "img", "comp") if p.inset > 0 else holes
    return bands.paint(px, inside.select("img", "y", "x0", "x1"), "delete", lambda on, q: q["delete"] * ~on, ("delete",), ("gray",))


def repair_frames(pixels: DataFrame, delete: str, p: CleanParams = CleanParams()) -> DataFrame:
    """Keeps the insides of closed dark frames: deleted pixels there turn back."""
    dark = pixels.withColumn("_dark", F.when(F.col("gray") <= p.darkness, 1).otherwise(0))
    closed = stencil.close(dark, "_dark", "_stroke", stencil.ellipse(2))
    holes = topology.frame_interiors(runs(closed, F.col("_stroke") == 1), p.least_interior)
    inside = holes.select("img", "comp", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
    if p.inset > 0:
        moved = None
        for dy, h in stencil.ellipse(p.inset).items():
            part = inside.select("img", "comp", (F.col("y") + dy).cast("int").alias("y"), F.explode(F.sequence(F.col("x") - h, F.col("x") + h)).alias("x"))
            moved = part if moved is None else moved.unionByName(part)
        size = sum(2 * h + 1 for h in stencil.ellipse(p.inset).values())
        inside = moved.groupBy("img", "comp", "y", "x").agg(F.count("*").alias("n")).where(F.col("n") == size)
    keep = inside.select("img", "y", "x").distinct().withColumn("_inside", F.lit(True))
    return pixels.join(keep, ["img", "y", "x"], "left").withColumn(delete, F.when(F.col("_inside"), 0).otherwise(F.col(delete))).drop("_inside")


def clean(pixels: DataFrame, sizes: DataFrame, config_threshold: float = 0.5, p: CleanParams = CleanParams()) -> DataFrame:
    """Pixels (img, y, x, r, g, b) with delete (0 or 1): scored by tiles, closed and opened, islands reclaimed, borders
    protected, frames repaired. After the first step pixels only ever turn from deleted to kept."""
    px = pixels.withColumn("gray", gray())
    threshold = config_threshold if p.threshold is None else p.threshold
    scored = predict(px, "gray", sizes, p.scorer, p.tile, p.overlap)
    px = px.join(scored, ["img", "y", "x"]).withColumn("delete", F.when(F.col("p") >= threshold, 1).otherwise(0)).drop("p")
    px = stencil.postprocess(px, "delete", p.close_radius, p.open_radius)
    if p.islands:
        left = pixels_of(topology.reclaim_islands(px, F.col("delete") == 1, sizes)).withColumn("_left", F.lit(1))
        px = px.join(left, ["img", "y", "x"], "left").withColumn("delete", F.coalesce("_left", F.lit(0))).drop("_left")
    px = stencil.protect_borders(px, "delete", "gray", p.border_band, p.darkness)
    return repair_frames(px, "delete", p) if p.frames else px


def cut_samples(pixels: DataFrame, p: segment.Params = segment.Params(), content: Column | None = None, unsafe: bool = False) -> DataFrame:
    """Segments of each strip; content tells which pixels count (by default what masks.content finds)."""
    from ..operators.masks import content as by_image

    marked = by_image(pixels) if content is None else pixels.withColumn("content", content)
    profile = row_profile(marked, F.col("content"))
    heights = pixels.groupBy("img").agg((F.max("y") + 1).alias("height"))
    return segment.detect(profile, heights, p, unsafe)


def long_strips(pages: DataFrame, mode: str = "most-common", fixed: int | None = None) -> DataFrame:
    """Where each page goes in its chapter's strip."""
    return layout.stack(pages, layout.target_widths(pages, mode, fixed))
