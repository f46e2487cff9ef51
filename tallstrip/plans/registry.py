"""Registered queries over the driver's tables, each with the SQL that says the same.

Rasters stand in for strips: see sources.raster. Conversations stand in for chapters, their turns for pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, ShortType

from ..functions import names, scalars
from ..operators import bands, discovery, kernels, layout, masks, metrics, sampling, segment, stencil, topology
from ..sources import raster, sinks
from . import pipelines

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _plain(df: DataFrame) -> DataFrame:
    """Integers as long, fractions rounded to six places."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, IntegerType | ShortType):
            c = c.cast("long")
        elif isinstance(f.dataType, DoubleType | FloatType):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_V = "CAST(greatest(0, least(255, floor((CAST({} AS DOUBLE) + 0.5) * 255))) AS BIGINT)"
FINE = f"""px0 AS (SELECT vec_id // 64 AS img, vec_id % 64 AS y, embedding AS e, unnest(range(0, 64)) AS x FROM embeddings),
px1 AS (SELECT img, y, x, {_V.format("e[x + 1]")} AS r, {_V.format("e[(x + 1) % 64 + 1]")} AS g, {_V.format("e[(x + 2) % 64 + 1]")} AS b FROM px0),
fine AS (SELECT img, y, x, r, g, b, (r * 7 + y * 3 + x * 5) % 256 AS a FROM px1),
feat AS (SELECT *, (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14 AS gray, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE CAST(floor((greatest(r, g, b) - least(r, g, b)) * 255.0::DOUBLE / greatest(r, g, b) + 0.5) AS BIGINT) END AS sat, greatest(r, g, b) - least(r, g, b) AS spread FROM fine)"""
BLOCK = f"""bx0 AS (SELECT vec_id // 64 AS img, vec_id % 64 AS y, embedding AS e, unnest(range(0, 16)) AS x FROM embeddings),
bx1 AS (SELECT img, y, x, {_V.format("(CAST(e[4 * x + 1] AS DOUBLE) + CAST(e[4 * x + 2] AS DOUBLE) + CAST(e[4 * x + 3] AS DOUBLE) + CAST(e[4 * x + 4] AS DOUBLE)) / 2")} AS r FROM bx0),
block AS (SELECT img, y * 4 + dy AS y, x * 4 + dx AS x, r FROM bx1, range(0, 4) AS a(dx), range(0, 4) AS b(dy))"""
RUNS = BLOCK + """,
active AS (SELECT img, y, sum(CASE WHEN r >= 160 THEN 1 ELSE 0 END)::BIGINT AS n FROM block GROUP BY img, y),
marked AS (SELECT img, y, y - row_number() OVER (PARTITION BY img ORDER BY y) AS island FROM active WHERE n >= 20),
runs AS (SELECT img, min(y) AS y0, max(y) + 1 AS y1 FROM marked GROUP BY img, island)"""
HEIGHTS = "heights AS (SELECT img, max(y) + 1 AS height FROM block GROUP BY img)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    profile = raster.row_profile(raster.block(spark, d), F.col("r") >= 160)
    return segment.islands(profile.where("n >= 20"), "img")


def _heights(spark: SparkSession, d: str) -> DataFrame:
    return raster.block(spark, d).groupBy("img").agg((F.max("y") + 1).alias("height"))


_SCORED = FINE + """,
m AS (SELECT img, a < 16 AS d, a < 16 AND (gray < 180 OR sat > 45) AS dm, NOT (a < 16) AND gray >= 120 AND gray <= 245 AND sat <= 35 AS l FROM feat),
s AS (SELECT img, count(*) AS total_pixels, count(*) FILTER (d) AS deleted_pixels, count(*) FILTER (dm) AS damaged_pixels, count(*) FILTER (l) AS leftover_grayline_pixels FROM m GROUP BY img),
p AS (SELECT *, CASE WHEN deleted_pixels > 0 THEN damaged_pixels / deleted_pixels * 100.0::DOUBLE ELSE 0 END AS dd, damaged_pixels / total_pixels * 100.0::DOUBLE AS dt, leftover_grayline_pixels / total_pixels * 100.0::DOUBLE AS lt FROM s),
q AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - (dd + lt * 5))) AS success, dd + dt * 0.5 + lt * 5 AS priority FROM p)"""


@_query(f"WITH {_SCORED} SELECT img, row_number() OVER (ORDER BY priority DESC, img) AS rank, total_pixels, deleted_pixels, damaged_pixels, leftover_grayline_pixels, round(dd, 6) AS damage_percent_deleted, round(success, 6) AS estimated_success_percent, round(priority, 6) AS priority_score FROM q")
def score_rank(spark, d):
    """Flagship: strips by review priority. F1, C12, C13, C17, C18, D2, D4 and D5 without edges, G12, H1."""
    got = pipelines.evaluate_bands(raster.fine_bands(spark, d, "r", "g", "b", "a"))
    return got.select("img", "rank", "total_pixels", "deleted_pixels", "damaged_pixels", "leftover_grayline_pixels", "damage_percent_deleted", "estimated_success_percent", "priority_score")


@_query(f"WITH {_SCORED} SELECT img, CAST(row_number() OVER (ORDER BY priority DESC, img) AS BIGINT) AS rank, format('{{:.3f}}', priority) AS priority_score, format('{{:.5f}}', lt) AS leftover FROM q ORDER BY 2 LIMIT 3")
def score_report_top(spark, d):
    """The report's first rows with fixed decimals."""
    got = metrics.report(pipelines.evaluate(raster.fine(spark, d), "img"))
    return got.orderBy("rank").limit(3).select("img", "rank", "priority_score", F.col("leftover_grayline_percent_total").alias("leftover"))


@_query(f"WITH {FINE} SELECT img, CAST(sum(gray * (x + 1)) AS BIGINT) AS gray, CAST(sum(sat * (y + 1)) AS BIGINT) AS sat, CAST(sum(spread) AS BIGINT) AS spread FROM feat GROUP BY img")
def pixel_scalars(spark, d):
    """C12, C13, C14."""
    px = raster.fine(spark, d)
    return px.groupBy("img").agg(F.sum(masks.gray() * (F.col("x") + 1)).alias("gray"), F.sum(masks.saturation() * (F.col("y") + 1)).alias("sat"), F.sum(masks.spread()).alias("spread"))


@_query(f"""WITH {FINE} SELECT img, count(*) FILTER (a < 128) AS training, count(*) FILTER (a < 16) AS result, count(*) FILTER ((b * 3 + 200) % 256 >= 245 AND (gray < 245 OR sat > 20)) AS white, count(*) FILTER (gray <= 40) AS dark, count(*) FILTER (CASE WHEN lowest < 250 THEN a > 10 ELSE r < 245 OR g < 245 OR b < 245 OR spread > 12 END) AS content FROM (SELECT *, min(a) OVER (PARTITION BY img) AS lowest FROM feat) GROUP BY img""")
def mask_predicates(spark, d):
    """D1, D2, D3, D6, D7, D8, F16, A2 to A6's branches on alpha."""
    px = masks.content(raster.fine(spark, d))
    white = masks.deleted_in_result(F.lit(None).cast("int"), (F.col("b") * 3 + 200) % 256, masks.gray(), masks.saturation())
    return px.groupBy("img").agg(F.count_if(masks.deleted_in_training(F.col("a"))).alias("training"), F.count_if(F.col("a") < 16).alias("result"), F.count_if(white).alias("white"), F.count_if(masks.near_black(masks.gray())).alias("dark"), F.count_if("content").alias("content"))


@_query(f"WITH {FINE} SELECT img, count(*) FILTER (a < 128 AND r < 100) AS both, count(*) FILTER (a < 128 OR r < 100) AS either, count(*) FILTER (a < 128 AND NOT r < 100) AS first_only, count(*) FILTER (NOT a < 128 AND r < 100) AS second_only, count(*) FILTER ((a < 128) <> (r < 100)) AS flipped FROM fine GROUP BY img")
def mask_algebra(spark, d):
    """E5, I3."""
    return raster.fine(spark, d).groupBy("img").agg(*[F.count_if(c).alias(n) for n, c in masks.algebra(F.col("a") < 128, F.col("r") < 100).items()])


@_query(f"WITH {FINE} SELECT l.img, count(*) AS n, CAST(sum(abs(l.r - m.r)) AS BIGINT) AS diff FROM fine l JOIN (SELECT img - 1 AS img, y, x, r FROM fine) m USING (img, y, x) GROUP BY l.img")
def aligned_strips(spark, d):
    """Neighbouring images cropped to what both have, pixel by pixel."""
    px = raster.fine(spark, d).select("img", "y", "x", "r")
    after = px.select((F.col("img") - 1).alias("img"), "y", "x", F.col("r").alias("r2"))
    return masks.align(px, after).groupBy("img").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("r") - F.col("r2"))).alias("diff"))


@_query(f"WITH {FINE}, t AS (SELECT sum(CASE WHEN a < 128 THEN 1.0::DOUBLE ELSE 0 END) / count(*) AS ratio FROM fine) SELECT round(ratio, 6) AS ratio, round(least(4.0::DOUBLE, greatest(0.5::DOUBLE, (1 - ratio) / greatest(ratio, 1e-6))), 6) AS weight FROM t")
def delete_ratio_posweight(spark, d):
    """F2, C21."""
    got = metrics.delete_ratio(raster.fine(spark, d), masks.deleted_in_training(F.col("a")))
    return got.withColumn("weight", scalars.positive_weight(F.col("ratio")))


@_query(f"WITH {RUNS} SELECT img, y0, y1, y1 - y0 AS n FROM runs")
def row_profile_runs(spark, d):
    """F3, D12, G1."""
    return _runs(spark, d).withColumn("n", F.col("y1") - F.col("y0"))


_MERGED = RUNS + """,
opened AS (SELECT *, CASE WHEN y0 - lag(y1) OVER (PARTITION BY img ORDER BY y0) <= 20 THEN 0 ELSE 1 END AS fresh FROM runs),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY img ORDER BY y0) AS grp FROM opened),
merged AS (SELECT img, min(y0) AS y0, max(y1) AS y1 FROM grouped GROUP BY img, grp)"""


@_query(f"WITH {_MERGED} SELECT * FROM merged")
def merge_close_runs(spark, d):
    """G2."""
    return segment.merge_gaps(_runs(spark, d), 20, "img")


@_query("""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM o) SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM g GROUP BY user_id, grp""")
def event_sessions(spark, d):
    """G2's streaming analogue, 2.P, on a table: runs of a user's events without a gap of over 30 minutes."""
    rows = _table(spark, d, "events").select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("us"))
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    opened = rows.withColumn("fresh", F.when(F.col("us") - F.lag("us").over(order) <= 30 * 60 * 1_000_000, 0).otherwise(1))
    return opened.withColumn("grp", F.sum("fresh").over(order)).groupBy("user_id", "grp").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")).drop("grp")


_BOUND = """CASE WHEN b1 <= b0 THEN y0 ELSE b0 END AS top, CASE WHEN b1 <= b0 THEN y1 ELSE b1 END AS bottom"""


def _bounds_sql(source: str, pad: int = 6, margin: int = 2) -> str:
    return f"""nb AS (SELECT r.*, height, lag(y1) OVER w AS before, lead(y0) OVER w AS after FROM {source} r JOIN heights USING (img) WINDOW w AS (PARTITION BY img ORDER BY y0)),
lim AS (SELECT *, greatest(0, least(least(greatest(coalesce(least(height, before + {margin}), 0), y0 - {pad}), y0), height)) AS b0, greatest(0, least(greatest(least(coalesce(greatest(0, after - {margin}), height), y1 + {pad}), y1), height)) AS b1 FROM nb)"""


@_query(f"WITH {RUNS}, {HEIGHTS}, {_bounds_sql('runs')} SELECT img, y0, y1, {_BOUND} FROM lim")
def padded_bounds(spark, d):
    """G3, C23's clamps."""
    runs = _runs(spark, d).join(_heights(spark, d), "img")
    return segment.padded_bounds(runs, segment.Params(pad_top=6, pad_bottom=6))


_GROUP_PARAMS = segment.Params(pad_top=6, pad_bottom=6, min_height=4, target_height=40, post_gap=6, post_height=70, standalone=30, unique_shift=5)
_GROUPED = RUNS + f""", {HEIGHTS},
u AS (SELECT r.img, y0, y1, height, lag(y1) OVER w AS before, lead(y0) OVER w AS after, row_number() OVER w AS k FROM runs r JOIN heights USING (img) WHERE y1 - y0 >= 4 WINDOW w AS (PARTITION BY img ORDER BY y0)),
f AS (SELECT img, k, y0 AS g0, y1 AS g1, before AS gb, after AS ga, height, 0 AS grp FROM u WHERE k = 1
UNION ALL SELECT img, k, CASE WHEN fits THEN g0 ELSE y0 END, y1, CASE WHEN fits THEN gb ELSE before END, after, height, CASE WHEN fits THEN grp ELSE grp + 1 END FROM (
SELECT f.img, u.k, g0, gb, u.y0, u.y1, u.before, u.after, f.height, grp, greatest(0, least(greatest(least(coalesce(greatest(0, u.after - 2), f.height), u.y1 + 6), u.y1), f.height)) - greatest(0, least(least(greatest(coalesce(least(f.height, gb + 2), 0), g0 - 6), g0), f.height)) <= 40 AS fits FROM f JOIN u ON u.img = f.img AND u.k = f.k + 1)),
gr AS (SELECT img, grp, min(g0) AS g0, max(g1) AS g1, arg_max(gb, k) AS gb, arg_max(ga, k) AS ga, max(height) AS height FROM f GROUP BY img, grp),
sg AS (SELECT img, grp AS idx, greatest(0, least(least(greatest(coalesce(least(height, gb + 2), 0), g0 - 6), g0), height)) AS y0, greatest(0, least(greatest(least(coalesce(greatest(0, ga - 2), height), g1 + 6), g1), height)) AS y1 FROM gr),
segs AS (SELECT img, idx, y0, y1, CASE WHEN y1 - y0 > 40 THEN 'oversized_content_block_kept_intact' ELSE 'safe' END AS reason FROM sg)"""


@_query(f"WITH RECURSIVE {_GROUPED} SELECT img, CAST(idx AS BIGINT) AS idx, y0, y1, y1 - y0 AS height, reason FROM segs")
def group_runs(spark, d):
    """G4, D13."""
    return segment.group_runs(_runs(spark, d).join(_heights(spark, d), "img"), _GROUP_PARAMS)


_POST = _GROUPED + """,
o AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY y0, y1) AS k FROM segs),
pm AS (SELECT img, k, y0, y1, reason, 0 AS grp FROM o WHERE k = 1
UNION ALL SELECT img, k, CASE WHEN mg THEN least(a0, y0) ELSE y0 END, CASE WHEN mg THEN greatest(a1, y1) ELSE y1 END, CASE WHEN NOT mg THEN reason WHEN 'oversized_content_block_kept_intact' IN (ar, reason) THEN 'merged_with_oversized_neighbor' ELSE 'merged_small_or_nearby' END, CASE WHEN mg THEN grp ELSE grp + 1 END FROM (
SELECT pm.img, o.k, pm.y0 AS a0, pm.y1 AS a1, pm.reason AS ar, o.y0, o.y1, o.reason, grp, o.y0 - pm.y1 <= 6 AND greatest(pm.y1, o.y1) - least(pm.y0, o.y0) <= 70 AND (pm.y1 - pm.y0 < 30 OR o.y1 - o.y0 < 30 OR o.y0 - pm.y1 <= 0) AS mg FROM pm JOIN o ON o.img = pm.img AND o.k = pm.k + 1)),
post AS (SELECT img, grp AS idx, arg_max(y0, k) AS y0, arg_max(y1, k) AS y1, arg_max(reason, k) AS reason FROM pm GROUP BY img, grp)"""


@_query(f"WITH RECURSIVE {_POST} SELECT img, CAST(idx AS BIGINT) AS idx, y0, y1, y1 - y0 AS height, reason FROM post")
def post_merge(spark, d):
    """G5, H4."""
    return segment.post_merge(group_runs(spark, d), _GROUP_PARAMS)


_FORCED = _POST + """,
cuts AS (SELECT img, s AS y0, least(s + 30, y1) AS y1 FROM (SELECT img, y0, y1, unnest(range(y0, y1, 20)) AS s FROM post WHERE y1 - y0 > 30) WHERE s = y0 OR s - 20 + 30 < y1),
forced AS (SELECT img, y0, y1, reason FROM post WHERE y1 - y0 <= 30 UNION ALL SELECT img, y0, y1, 'unsafe_forced_split' FROM cuts WHERE y1 - y0 >= 4)"""


@_query(f"WITH RECURSIVE {_FORCED} SELECT img, row_number() OVER (PARTITION BY img ORDER BY y0, y1) - 1 AS idx, y0, y1, y1 - y0 AS height, reason FROM forced")
def forced_split(spark, d):
    """G6."""
    return segment.forced_split(post_merge(spark, d), 30, 10, 4)


_UNIQUE = _FORCED + """,
fo AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY y0, y1, reason) AS k FROM forced),
nd AS (SELECT img, k, y0, y1, y0 AS l0, y1 AS l1, TRUE AS kept FROM fo WHERE k = 1
UNION ALL SELECT fo.img, fo.k, fo.y0, fo.y1, CASE WHEN abs(fo.y0 - l0) < 25 AND abs(fo.y1 - l1) < 25 THEN l0 ELSE fo.y0 END, CASE WHEN abs(fo.y0 - l0) < 25 AND abs(fo.y1 - l1) < 25 THEN l1 ELSE fo.y1 END, NOT (abs(fo.y0 - l0) < 25 AND abs(fo.y1 - l1) < 25) FROM nd JOIN fo ON fo.img = nd.img AND fo.k = nd.k + 1)"""


@_query(f"WITH RECURSIVE {_UNIQUE} SELECT img, row_number() OVER (PARTITION BY img ORDER BY k) - 1 AS idx, y0, y1, y1 - y0 AS height FROM nd WHERE kept")
def near_duplicate_segments(spark, d):
    """G7."""
    from dataclasses import replace

    return segment.drop_near_duplicates(forced_split(spark, d), replace(_GROUP_PARAMS, unique_shift=25)).drop("reason")


@_query(f"WITH RECURSIVE {_POST} SELECT count(*) FILTER (contains(reason, 'oversized')) AS oversized, count(*) FILTER (contains(reason, 'merged')) AS merged, count(*) AS total FROM post")
def segment_reasons(spark, d):
    """F18, B5's reasons."""
    return segment.reason_counts(post_merge(spark, d))


_CUT = _POST.replace(RUNS, _MERGED).replace("FROM runs r JOIN heights", "FROM merged r JOIN heights").replace("o.y0 - pm.y1 <= 6 AND", "o.y0 - pm.y1 <= 120 AND").replace("<= 70 AND", "<= 1800 AND").replace("pm.y1 - pm.y0 < 30 OR o.y1 - o.y0 < 30", "pm.y1 - pm.y0 < 650 OR o.y1 - o.y0 < 650")


@_query(f"""WITH RECURSIVE {_CUT}, po AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY y0, y1, reason) AS k FROM post),
un AS (SELECT img, k, y0, y1, reason, y0 AS l0, y1 AS l1, TRUE AS kept FROM po WHERE k = 1
UNION ALL SELECT img, k, y0, y1, reason, CASE WHEN same THEN l0 ELSE y0 END, CASE WHEN same THEN l1 ELSE y1 END, NOT same FROM (SELECT po.*, l0, l1, abs(po.y0 - l0) < 16 AND abs(po.y1 - l1) < 16 AS same FROM un JOIN po ON po.img = un.img AND po.k = un.k + 1))
SELECT img, row_number() OVER (PARTITION BY img ORDER BY k) - 1 AS idx, y0, y1, y1 - y0 AS height, reason FROM un WHERE kept""")
def cut_samples(spark, d):
    """G8, 3.3: strips to segments."""
    return pipelines.cut_samples(raster.block(spark, d), segment.Params(row_pixels=20, min_height=4, target_height=40, pad_top=6, pad_bottom=6), F.col("r") >= 160)


@_query(f"""WITH {BLOCK}, f AS (SELECT img, y, count(*) FILTER ((r >= 150) <> (r >= 140)) AS n FROM block GROUP BY img, y HAVING n > 12),
o AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY img ORDER BY y) <= 6 THEN 0 ELSE 1 END AS fresh FROM f),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY img ORDER BY y) AS grp FROM o),
b AS (SELECT img, min(y) AS y0, max(y) AS y1, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY img, grp)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, y0) AS rank FROM b) WHERE rank <= 4""")
def flip_bands_topk(spark, d):
    """G9, H3."""
    px = raster.block(spark, d)
    flips = px.groupBy("img", "y").agg(F.count_if((F.col("r") >= 150) != (F.col("r") >= 140)).alias("n")).where("n > 12")
    return metrics.top_bands(segment.flip_bands(flips, 6, "img"), 4, "img")


@_query(f"WITH {BLOCK} SELECT img, count(*) FILTER (r >= 128 AND NOT r >= 120 + y % 16) AS over, count(*) FILTER (NOT r >= 128 AND r >= 120 + y % 16) AS under, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (r >= 128 AND NOT r >= 120 + y % 16) / count(*), 4) AS over_pct, round(100.0::DOUBLE * count(*) FILTER (NOT r >= 128 AND r >= 120 + y % 16) / count(*), 4) AS under_pct FROM block GROUP BY img")
def confusion_two_way(spark, d):
    """F4, C16."""
    return metrics.confusion(raster.block(spark, d), F.col("r") >= 128, F.col("r") >= 120 + F.col("y") % 16, "img")


@_query("SELECT quality = 1 AS predicted, count(*) FILTER (toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS toxic FROM labels GROUP BY 1")
def label_confusion(spark, d):
    """F4 on labels as two masks."""
    rows = _table(spark, d, "labels")
    return rows.groupBy((F.col("quality") == 1).alias("predicted")).agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@_query(f"""WITH {BLOCK}, f AS (SELECT img, r >= 128 AS b, r >= 120 + x % 16 AS a, r >= 124 AS t FROM block) SELECT img, CASE WHEN b THEN 'del_to_keep' ELSE 'keep_to_del' END AS direction, count(*) AS n, count(*) FILTER (a = t) AS "right" FROM f WHERE a <> b GROUP BY 1, 2""")
def flip_accuracy(spark, d):
    """F5."""
    return metrics.flip_accuracy(raster.block(spark, d), F.col("r") >= 128, F.col("r") >= 120 + F.col("x") % 16, F.col("r") >= 124, "img")


@_query(f"""WITH {BLOCK}, f AS (SELECT img, (r >= 128) <> (r >= 126) AS p, (r >= 128) <> (r >= 120 + x % 16) AS q FROM block) SELECT img, count(*) FILTER (p) AS first_n, count(*) FILTER (p AND q) AS both_n, round(count(*) FILTER (p AND q) / CASE WHEN count(*) FILTER (p) > 0 THEN count(*) FILTER (p) END, 6) AS ratio FROM f GROUP BY img""")
def flip_subset(spark, d):
    """F6."""
    old = F.col("r") >= 128
    return metrics.flip_overlap(raster.block(spark, d), old != (F.col("r") >= 126), old != (F.col("r") >= 120 + F.col("x") % 16), "img")


_PAGES = "pages_ AS (SELECT conv_id AS chapter, turn AS page, 690 + 10 * ((conv_id + turn) % 3) AS width, length(text) AS height FROM conversations)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "conversations")
    return rows.select(F.col("conv_id").alias("chapter"), F.col("turn").alias("page"), (690 + 10 * ((F.col("conv_id") + F.col("turn")) % 3)).alias("width"), F.length("text").cast("long").alias("height"))


_TARGET = "target AS (SELECT chapter, width AS target FROM (SELECT chapter, width, row_number() OVER (PARTITION BY chapter ORDER BY count(*) DESC, min(page)) AS k FROM pages_ GROUP BY chapter, width) WHERE k = 1)"


@_query(f"WITH {_PAGES}, {_TARGET}, o AS (SELECT chapter, max(width) AS widest, min(width) AS narrowest, CAST(sum(height) AS BIGINT) AS total, count(DISTINCT width) AS widths FROM pages_ GROUP BY chapter) SELECT chapter, target, widest, narrowest, total, widths FROM target JOIN o USING (chapter)")
def target_width_mode(spark, d):
    """F7, F8, F9."""
    pages = _pages(spark, d)
    out = layout.target_widths(pages)
    for mode, name in (("max-width", "widest"), ("min-width", "narrowest")):
        out = out.join(layout.target_widths(pages, mode).withColumnRenamed("target", name), "chapter")
    return out.join(pages.groupBy("chapter").agg(F.sum("height").alias("total"), F.countDistinct("width").alias("widths")), "chapter")


_STACKED = f"""{_PAGES}, {_TARGET}, sized AS (SELECT chapter, page, target, CASE WHEN width = target THEN height ELSE greatest(1, CAST(round_even(height * (target / width), 0) AS BIGINT)) END AS h FROM pages_ JOIN target USING (chapter))"""


@_query(f"WITH {_STACKED} SELECT chapter, page, target AS new_width, h AS new_height, CAST(coalesce(sum(h) OVER (PARTITION BY chapter ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y FROM sized")
def strip_layout(spark, d):
    """L1, C19, G10, 3.3."""
    return pipelines.long_strips(_pages(spark, d)).select("chapter", "page", "new_width", F.col("new_height").cast("long").alias("new_height"), "y")


@_query(f"WITH {_PAGES} SELECT chapter, page, (max(width) OVER (PARTITION BY chapter) - width) // 2 AS x, CAST(coalesce(sum(height) OVER (PARTITION BY chapter ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y FROM pages_")
def centred_layout(spark, d):
    """L2."""
    return layout.stack_centred(_pages(spark, d))


@_query(f"WITH {_PAGES}, t AS (SELECT chapter, CAST(sum(height) AS BIGINT) AS height FROM pages_ GROUP BY chapter), c AS (SELECT chapter, height, unnest(range(0, height, 500)) AS y0 FROM t) SELECT chapter, y0 // 500 + 1 AS part, y0, least(y0 + 500, height) AS y1 FROM c")
def chunk_split(spark, d):
    """L3, G11."""
    return layout.chunks(_pages(spark, d).groupBy("chapter").agg(F.sum("height").alias("height")), 500, "chapter")


@_query(f"WITH {_PAGES}, t AS (SELECT chapter, CAST(sum(height) AS BIGINT) AS height FROM pages_ GROUP BY chapter), c AS (SELECT chapter, height, unnest(range(0, height, 1000)) AS y0 FROM t) SELECT chapter, y0 // 1000 AS band, y0, least(y0 + 1000, height) AS y1, greatest(0, y0 - 300) AS \"from\", least(height, least(y0 + 1000, height) + 300) AS \"to\" FROM c")
def halo_bands(spark, d):
    """G18."""
    return layout.bands(_pages(spark, d).groupBy("chapter").agg(F.sum("height").alias("height")), 1000, 300, "chapter")


@_query(f"""WITH {BLOCK}, rows_ AS (SELECT img, y, count(*) FILTER (r >= 128) AS n FROM block GROUP BY img, y), w AS (SELECT img, k AS name, k * 60 AS y0 FROM (SELECT DISTINCT img FROM block), range(0, 4) AS t(k))
SELECT w.img, name, count(*) AS rows_in, count(*) FILTER (y >= y0 AND y < y0 + 20) AS centre_rows, CAST(coalesce(sum(n) FILTER (y >= y0 AND y < y0 + 20), 0) AS BIGINT) AS n FROM w JOIN rows_ r ON r.img = w.img AND y >= y0 - 10 AND y < y0 + 30 GROUP BY 1, 2""")
def halo_windows(spark, d):
    """G17, F19, L4."""
    px = raster.block(spark, d)
    rows = raster.row_profile(px, F.col("r") >= 128)
    windows = px.select("img").distinct().withColumn("name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).select("img", "name", (F.col("name") * 60).alias("y0"), F.lit(20).alias("h"))
    got = layout.halo_windows(windows, rows, 10)
    return got.groupBy("img", "name").agg(F.count("*").alias("rows_in"), F.count_if("centre").alias("centre_rows"), F.coalesce(F.sum(F.when(F.col("centre"), F.col("n"))), F.lit(0)).alias("n"))


@_query(f"""WITH {_PAGES}, g AS (SELECT chapter, page, CASE WHEN height <= 768 THEN 768 ELSE CAST(ceil((height - 768) / 672) AS BIGINT) * 672 + 768 END AS ph, CASE WHEN width <= 768 THEN 768 ELSE CAST(ceil((width - 768) / 672) AS BIGINT) * 672 + 768 END AS pw FROM pages_), a AS (SELECT *, unnest(range(0, ph - 768 + 1, 672)) AS ty FROM g) SELECT chapter, page, ty, unnest(range(0, pw - 768 + 1, 672)) AS tx FROM a""")
def tile_grid(spark, d):
    """G16, L6."""
    return layout.tiles(_pages(spark, d), 768, 96, "chapter", "page")


@_query(f"""WITH {BLOCK}, t AS (SELECT img, y, x, r, ty, tx FROM block, (SELECT unnest(range(0, 256, 24)) AS ty) a, (SELECT unnest(range(0, 64, 24)) AS tx) b WHERE y >= ty AND y < ty + 32 AND x >= tx AND x < tx + 32),
w AS (SELECT *, greatest(0.5 - 0.5 * cos(2 * pi() * (y - ty) / 31), 0.05::DOUBLE) * greatest(0.5 - 0.5 * cos(2 * pi() * (x - tx) / 31), 0.05::DOUBLE) AS w FROM t)
SELECT img, y, x, round(sum((r + ty % 7) * w) / greatest(sum(w), 1e-6), 6) AS p FROM w GROUP BY img, y, x""")
def overlap_add(spark, d):
    """Overlapping scores under Hann weights."""
    px = raster.block(spark, d)
    tiled = px.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(255), F.lit(24)))).where((F.col("y") >= F.col("ty")) & (F.col("y") < F.col("ty") + 32))
    tiled = tiled.withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(63), F.lit(24)))).where((F.col("x") >= F.col("tx")) & (F.col("x") < F.col("tx") + 32))
    return kernels.overlap_add(tiled.withColumn("s", (F.col("r") + F.col("ty") % 7).cast("double")), 32)


@_query("""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_brand || ' ' || p_name, '\\d+|\\D+'), lambda s: CASE WHEN regexp_matches(s, '^\\d') THEN lpad(CASE WHEN ltrim(s, '0') = '' THEN '0' ELSE ltrim(s, '0') END, 20, '0') ELSE lower(s) END), '') AS key FROM part""")
def natural_keys(spark, d):
    """C1, H1."""
    return _table(spark, d, "part").select("p_partkey", names.natural_key(F.concat("p_brand", F.lit(" "), "p_name")).alias("key"))


_LAST = "regexp_extract({0}, '(\\d+)\\D*$', 1)"


def _number_sql(name: str) -> str:
    digits = f"regexp_replace({_LAST.format(name)}, '^0+(\\d)', '\\1')"
    return f"CASE WHEN {_LAST.format(name)} = '' THEN NULL WHEN length({digits}) < 9 THEN lpad({digits}, 9, '0') ELSE {digits} END"


@_query(f"""WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'ch' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') WHEN 2 THEN 'extra' ELSE c_name END AS s FROM customer), k AS (SELECT *, {_number_sql('s')} AS num FROM n)
SELECT c_custkey, CAST(CASE WHEN regexp_full_match(s, '\\d+') THEN 0 WHEN num IS NOT NULL THEN 1 ELSE 2 END AS BIGINT) AS kind, CASE WHEN regexp_full_match(s, '\\d+') THEN num WHEN num IS NOT NULL THEN num || '_' || s ELSE s END AS key, CAST(CASE WHEN regexp_full_match(s, '\\d+') THEN 0 ELSE 1 END AS BIGINT) AS file_kind, CASE WHEN regexp_full_match(s, '\\d+') THEN num ELSE s END AS file_key, CAST(CASE WHEN num IS NOT NULL THEN 0 ELSE 1 END AS BIGINT) AS preview_kind, CASE WHEN num IS NOT NULL THEN num || '_' || s ELSE s END AS preview_key FROM k""")
def chapter_keys(spark, d):
    """C2, C3, C4 on bare ids, zero-padded ids, names with and without numbers, with what results and previews append."""
    key = F.col("c_custkey")
    name = F.when(key % 4 == 0, key.cast("string")).when(key % 4 == 1, F.concat(F.lit("ch"), F.lpad(key.cast("string"), 6, "0"))).when(key % 4 == 2, "extra").otherwise(F.col("c_name"))
    rows = _table(spark, d, "customer").select("c_custkey", name.alias("s"))
    a, b, c = names.chapter_key(F.col("s")), names.file_key(F.concat(F.lit("in/"), "s", F.lit("_result.png"))), names.preview_key(F.concat("s", F.lit("_result_red_preview.png")))
    return rows.select("c_custkey", a["kind"].alias("kind"), a["key"].alias("key"), b["kind"].alias("file_kind"), b["key"].alias("file_key"), c["kind"].alias("preview_kind"), c["key"].alias("preview_key"))


@_query("""SELECT p_partkey, 'v10' AS eaten, p_brand AS kept, p_brand AS plain FROM part""")
def normalized_chapters(spark, d):
    """A stem ends at the last dot, so ids with dots are eaten."""
    rows = _table(spark, d, "part")
    return rows.select("p_partkey", names.normalized_chapter(F.concat(F.lit("v10.0-"), "p_brand")).alias("eaten"), names.normalized_chapter(F.concat(F.lit("a/b/"), "p_brand", F.lit("_result.png"))).alias("kept"), names.normalized_chapter(F.col("p_brand")).alias("plain"))


@_query("""WITH t AS (SELECT o_orderkey, lpad(CAST(o_orderkey % 90 AS VARCHAR), 3, '0') AS lo, CAST(o_orderkey % 90 + o_orderkey % 7 AS VARCHAR) AS hi FROM orders),
w AS (SELECT *, CAST(greatest(length(lo), length(hi)) AS INTEGER) AS w FROM t),
e AS (SELECT o_orderkey, unnest(list_transform(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1), lambda n: CASE WHEN length(CAST(n AS VARCHAR)) < w THEN lpad(CAST(n AS VARCHAR), w, '0') ELSE CAST(n AS VARCHAR) END)) AS chapter, generate_subscripts(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1), 1) AS pos FROM w
UNION ALL SELECT o_orderkey, lo, 1000 FROM w UNION ALL SELECT o_orderkey, 'x', 1001 FROM w)
SELECT o_orderkey, chapter, row_number() OVER (PARTITION BY o_orderkey ORDER BY min(pos)) - 1 AS pos FROM e GROUP BY o_orderkey, chapter""")
def chapter_list(spark, d):
    """C7, F20, T2."""
    key = F.col("o_orderkey")
    low = F.lpad((key % 90).cast("string"), 3, "0")
    rows = _table(spark, d, "orders").select("o_orderkey", F.concat(low, F.lit("-"), (key % 90 + key % 7).cast("string"), F.lit(",, "), low, F.lit(" x.png")).alias("v"))
    return names.chapter_list(rows, "v", "o_orderkey")


@_query("""SELECT event_id, len(list_filter(list_transform(string_split(props, ','), lambda x: trim(x)), lambda x: x <> '')) AS n, CAST(list_sum(list_transform(string_split(CAST(event_id AS VARCHAR) || ', ' || CAST(user_id AS VARCHAR) || ',', ','), lambda x: CASE WHEN trim(x) = '' THEN 0 ELSE CAST(trim(x) AS BIGINT) END)) AS BIGINT) AS total FROM events""")
def csv_values(spark, d):
    """C8."""
    text = F.concat(F.col("event_id").cast("string"), F.lit(", "), F.col("user_id").cast("string"), F.lit(","))
    return _table(spark, d, "events").select("event_id", F.size(names.csv_values(F.col("props"))).alias("n"), F.aggregate(names.csv_ints(text), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@_query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(trim(translate(p_name, '_-', '  '))) WHEN 1 THEN '007' ELSE 'MARKED ' || upper(trim(translate(p_brand, '_-', '  '))) END AS title FROM part""")
def clean_labels(spark, d):
    """By name, by the stem where nothing is left, and by position."""
    rows = _table(spark, d, "part")
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x/007_"), F.translate("p_name", " ", "_"), F.lit("_result.png"))).when(F.col("p_partkey") % 3 == 1, F.lit("x/007.png")).otherwise(F.concat(F.lit("007-marked_"), "p_brand", F.lit("_cleaned_result.png")))
    return rows.select("p_partkey", names.clean_label(path, F.lit("007.png")).alias("title"))


@_query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'v' ELSE '' END || CASE s_suppkey % 2 WHEN 0 THEN s_suppkey || '.0' ELSE 'V' || s_suppkey END || CASE s_suppkey % 4 WHEN 0 THEN '-' WHEN 1 THEN '-islands-' WHEN 2 THEN '-frames-' ELSE '-islandsframes-' END AS prefix, 'out/' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || '_result.png' AS result, 'in/' || s_suppkey || '.png' AS input, CASE WHEN s_suppkey < 1000 THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0') ELSE CAST(s_suppkey AS VARCHAR) END || '.png' AS name FROM supplier""")
def output_names(spark, d):
    """C11, A19, C20."""
    k = F.col("s_suppkey")
    model = F.when(k % 2 == 0, F.concat(F.lit("m/"), k.cast("string"), F.lit(".0.pt"))).otherwise(F.concat(F.lit("V"), k.cast("string"), F.lit(".pt")))
    return _table(spark, d, "supplier").select("s_suppkey", names.version_prefix(model, (k % 4 == 1) | (k % 4 == 3), k % 4 >= 2).alias("prefix"), names.result_path(F.lpad(k.cast("string"), 3, "0"), "out").alias("result"), names.chapter_path(k.cast("string"), "in").alias("input"), names.index_name(0, k).alias("name"))


@_query("""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN n_nationkey || '_summary.csv' WHEN 1 THEN '1-2_summary.csv' WHEN 2 THEN 'selected_12_chapters_1-12_summary.csv' WHEN 3 THEN 'start-' || n_nationkey || '_summary.csv' ELSE 'all_summary.csv' END AS name FROM nation""")
def summary_names(spark, d):
    """B16."""
    k, none = F.col("n_nationkey"), F.lit(None).cast("string")
    several = F.when(k % 5 == 1, F.array(F.lit("1"), F.lit("2"))).when(k % 5 == 2, F.transform(F.sequence(F.lit(1), F.lit(12)), lambda x: x.cast("string")))
    return _table(spark, d, "nation").select("n_nationkey", names.summary_name(F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit(".png"))), several, none, F.when(k % 5 == 3, k.cast("string"))).alias("name"))


_FILES = """files AS (SELECT 'v' || (p_size % 12) || '.' || substr(p_brand, 7) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-islands' ELSE '-two-parts' END || '-' || lpad(CAST(p_partkey % 20 AS VARCHAR), 3, '0') || '_result_red_preview.png' AS name, p_partkey, p_size % 12 AS major, CAST(substr(p_brand, 7) AS BIGINT) AS minor, CASE p_partkey % 3 WHEN 0 THEN '' ELSE 'islands' END AS suffix, lpad(CAST(p_partkey % 20 AS VARCHAR), 3, '0') AS chapter FROM part),
vers AS (SELECT DISTINCT chapter, 'v' || major || '.' || minor || CASE WHEN suffix = '' THEN '' ELSE '-islands' END AS tag, name, major, minor, suffix FROM files WHERE p_partkey % 3 <> 2),
ordered AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY major, minor, suffix, name) - 1 AS ord FROM vers)"""


def _version_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    middle = F.when(k % 3 == 0, "").when(k % 3 == 1, "-islands").otherwise("-two-parts")
    return _table(spark, d, "part").select(F.concat(F.lit("v"), (F.col("p_size") % 12).cast("string"), F.lit("."), F.substring("p_brand", 7, 10), middle, F.lit("-"), F.lpad((k % 20).cast("string"), 3, "0"), F.lit("_result_red_preview.png")).alias("name")).distinct()


@_query(f"WITH {_FILES} SELECT chapter, tag, name, ord FROM ordered")
def version_keys(spark, d):
    """Names with two suffixes are no versions."""
    return discovery.versions(_version_files(spark, d))


@_query(f"WITH {_FILES}, cols AS (SELECT chapter, ord + 1 AS col, tag FROM ordered UNION ALL SELECT DISTINCT chapter, 0, 'before' FROM ordered WHERE CAST(chapter AS BIGINT) % 2 = 0) SELECT chapter, col, tag, slot, slot * 300 AS y FROM cols, range(0, 3) AS s(slot)")
def versions_grid(spark, d):
    """Versions by offsets, the untouched strip first where there is one."""
    got = discovery.versions(_version_files(spark, d))
    chapters = got.select("chapter").distinct()
    slots = chapters.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("y", F.col("slot") * 300)
    return discovery.version_grid(got, slots, chapters.where(F.col("chapter").cast("long") % 2 == 0))


@_query(f"WITH {_FILES}, asked AS (SELECT 'v' || a || '.' || b AS tag FROM range(0, 15) AS s(a), range(1, 3) AS t(b)) SELECT tag FROM asked WHERE tag NOT IN (SELECT tag FROM vers)")
def missing_versions(spark, d):
    """E10, I2."""
    asked = spark.range(0, 15).withColumn("b", F.explode(F.array(F.lit(1), F.lit(2)))).select(F.concat(F.lit("v"), F.col("id").cast("string"), F.lit("."), F.col("b").cast("string")).alias("tag"))
    return discovery.missing_versions(asked, discovery.versions(_version_files(spark, d)))


@_query("""WITH l AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT 'missing' AS kind, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT 'paired', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents WHERE doc_id IN (SELECT doc_id FROM l) UNION ALL SELECT 'unmatched', count(*), coalesce(CAST(sum(doc_id) AS BIGINT), 0) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def missing_report(spark, d):
    """Who has a result, who lacks one, and results without an original."""
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("chapter"))
    results = _table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("chapter"))
    out = None
    for kind, rows in (("missing", discovery.missing(docs, results)), ("paired", discovery.pairs(docs, results)), ("unmatched", discovery.unmatched(docs, results))):
        part = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("chapter"), F.lit(0)).alias("ids")).select(F.lit(kind).alias("kind"), "n", "ids")
        out = part if out is None else out.unionByName(part)
    return out


_PAIRS = """pg AS (SELECT source AS episode, lang AS variant, doc_id AS page, 'p' || doc_id AS src FROM documents),
tg AS (SELECT source AS episode, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN 'initial' ELSE 'external' END AS src_kind, doc_id - doc_id % 2 AS page FROM documents WHERE doc_id % 5 <> 0 GROUP BY ALL),
av AS (SELECT DISTINCT f.episode, f.variant, t.src_kind, CASE WHEN t.src_kind = f.variant THEN 0 WHEN t.src_kind = 'initial' THEN 1 WHEN t.src_kind = 'external' THEN 2 END AS k FROM (SELECT DISTINCT episode, variant FROM pg) f JOIN tg t USING (episode)),
best AS (SELECT episode, variant, arg_min(src_kind, k) AS src_kind FROM av WHERE k IS NOT NULL GROUP BY 1, 2)"""


@_query(f"WITH {_PAIRS} SELECT episode, variant, pg.page, src, src_kind || '/' || pg.page AS target FROM pg JOIN best USING (episode, variant) JOIN tg USING (episode, src_kind, page)")
def pairs_fallback(spark, d):
    """A folder's best target, without falling back page by page."""
    docs = _table(spark, d, "documents")
    pages = docs.select(F.col("source").alias("episode"), F.col("lang").alias("variant"), F.col("doc_id").alias("page"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("src"))
    kind = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, "initial").otherwise("external")
    targets = docs.where("doc_id % 5 <> 0").select(F.col("source").alias("episode"), kind.alias("source"), (F.col("doc_id") - F.col("doc_id") % 2).alias("page")).distinct()
    return discovery.training_pairs(pages, targets.withColumn("target", F.concat("source", F.lit("/"), F.col("page").cast("string"))))


@_query("SELECT lang AS variant, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS strata, round(sum(length(text)) / count(*), 6) AS per_page FROM documents WHERE lang IN ('en', 'fr') AND doc_id IN (SELECT doc_id FROM labels) GROUP BY lang")
def exported_pages(spark, d):
    """A16, E8, F12, F14, I4."""
    docs = _table(spark, d, "documents").withColumns({"split": F.lit("train"), "episode": F.col("source"), "variant": F.col("lang"), "page": F.col("doc_id")})
    right = _table(spark, d, "labels").select(F.col("doc_id").alias("page")).join(docs.select("page", "split", "episode", "variant"), "page")
    wanted = spark.range(1).select(F.explode(F.array_except(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), F.array(F.lit("de")))).alias("variant"))
    got = discovery.exported_pages(wanted, docs.select("split", "episode", "variant", "page"), right)
    sized = got.join(docs.select("page", F.length("text").alias("n")), "page")
    return sized.groupBy("variant").agg(F.count("*").alias("pages"), F.sum("n").alias("strata"), (F.sum("n") / F.count("*")).alias("per_page"))


@_query("""WITH f AS (SELECT 0 AS source, text FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT 1, text FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT 2, text FROM benchmark) SELECT CAST(source AS BIGINT) AS source, count(*) AS n FROM (SELECT text, min(source) AS source FROM f GROUP BY text) GROUP BY source""")
def first_seen_union(spark, d):
    """Several ordered sources, each item where it was first seen."""
    rows = _table(spark, d, "benchmark")
    found = rows.where("item_id % 2 = 0").select(F.lit(0).alias("source"), "text").unionByName(rows.where("item_id % 3 = 0").select(F.lit(1).alias("source"), "text")).unionByName(rows.select(F.lit(2).alias("source"), "text"))
    return discovery.ordered_distinct(found, "text", "source").groupBy("source").agg(F.count("*").alias("n"))


@_query("""SELECT item_id, lower(regexp_extract(name, '\\.([^./]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'webp') AS image FROM (SELECT item_id, 'c/' || item_id || CASE item_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.txt' ELSE '' END AS name FROM benchmark)""")
def image_names(spark, d):
    """A1, A8 to A10's filters."""
    k = F.col("item_id")
    name = F.concat(F.lit("c/"), k.cast("string"), F.when(k % 4 == 0, ".PNG").when(k % 4 == 1, ".jpeg").when(k % 4 == 2, ".txt").otherwise(""))
    return _table(spark, d, "benchmark").select("item_id", names.is_image(name).alias("image"))


def _kernel_sql(kernel: dict[int, int], agg: str, value: str, source: str) -> str:
    offsets = ", ".join(f"({dy}, {dx})" for dy, h in kernel.items() for dx in range(-h, h + 1))
    moved = f"SELECT q.img, q.y - k.dy AS y, q.x - k.dx AS x, q.{value} FROM {source} q, (VALUES {offsets}) AS k(dy, dx)"
    return f"SELECT p.img, p.y, p.x, {agg}(m.{value}) AS {value} FROM {source} p JOIN ({moved}) m ON m.img = p.img AND m.y = p.y AND m.x = p.x GROUP BY 1, 2, 3"


_SUMS = "SELECT img, CAST(sum(v * (x + 1)) AS BIGINT) AS sx, CAST(sum(v * (y + 1)) AS BIGINT) AS sy, count(*) AS n FROM ({}) GROUP BY img"


def _band_sums(b: bands.Bands, plane: str) -> DataFrame:
    """Sums of a plane's values weighed by place, three numbers a band."""

    def work(y0, p):
        import numpy as np

        v, (y, x) = p[plane].astype(np.int64), np.indices(p[plane].shape)
        return {"sx": [int((v * (x + 1)).sum())], "sy": [int((v * (y + y0 + 1)).sum())], "n": [v.size]}

    return bands.each(b.pick(plane), "sx bigint, sy bigint, n bigint", work).groupBy("img").agg(*[F.sum(c).alias(c) for c in ("sx", "sy", "n")])


def _block_mask(spark: SparkSession, d: str) -> bands.Bands:
    return bands.mapped(raster.block_bands(spark, d), {"m": "uint8"}, lambda p: {"m": p["r"] >= 150}, ("r",), ())


def _thirds(y0: int, shape: tuple[int, int]):
    """-1 at every third diagonal, 1 elsewhere."""
    import numpy as np

    y, x = np.indices(shape)
    return np.where((y + y0 + x) % 3 == 0, -1, 1)


_GRAYS = BLOCK + ", src AS (SELECT img, y, x, r AS v FROM block)"
_MASK = BLOCK + ", src AS (SELECT img, y, x, CASE WHEN r >= 150 THEN 1 ELSE 0 END AS v FROM block)"


@_query(f"WITH {_GRAYS} " + _SUMS.format(_kernel_sql(stencil.ellipse(3), "max", "v", "src")))
def dilate(spark, d):
    """J1, J13, E11."""
    return _band_sums(bands.dilate(raster.block_bands(spark, d), "r", "v", stencil.ellipse(3)), "v")


@_query(f"WITH {_GRAYS} " + _SUMS.format(_kernel_sql(stencil.ellipse(2), "min", "v", "src")))
def erode(spark, d):
    """J2."""
    return _band_sums(bands.erode(raster.block_bands(spark, d), "r", "v", stencil.ellipse(2)), "v")


@_query(f"WITH {_GRAYS}, hi AS ({_kernel_sql(stencil.ellipse(3), 'max', 'v', 'src')}), lo AS ({_kernel_sql(stencil.ellipse(3), 'min', 'v', 'src')}) SELECT img, count(*) FILTER (c >= 30) AS contrast, CAST(sum(c) AS BIGINT) AS total, count(*) FILTER (c < 30 AND r >= 128) AS flat FROM (SELECT hi.img, hi.v - lo.v AS c, s.v AS r FROM hi JOIN lo USING (img, y, x) JOIN src s USING (img, y, x)) GROUP BY img")
def gradient(spark, d):
    """J3, D9, D10."""
    got = bands.gradient(raster.block_bands(spark, d), "r", "c", stencil.ellipse(3))
    counts = bands.each(got, "contrast bigint, total bigint, flat bigint", lambda y0, p: {"contrast": [int((p["c"] >= 30).sum())], "total": [int(p["c"].sum(dtype="int64"))], "flat": [int(((p["c"] < 30) & (p["r"] >= 128)).sum())]})
    return counts.groupBy("img").agg(*[F.sum(c).alias(c) for c in ("contrast", "total", "flat")])


@_query(f"WITH {_MASK}, a AS ({_kernel_sql(stencil.ellipse(2), 'max', 'v', 'src')}), b AS ({_kernel_sql(stencil.ellipse(2), 'min', 'v', 'a')}), c AS ({_kernel_sql(stencil.ellipse(1), 'min', 'v', 'b')}), e AS ({_kernel_sql(stencil.ellipse(1), 'max', 'v', 'c')}) " + _SUMS.format("SELECT * FROM e"))
def open_close(spark, d):
    """Closed, then opened."""
    return _band_sums(bands.postprocess(_block_mask(spark, d), "m", 2, 1), "m")


@_query(f"WITH {_MASK}, hi AS ({_kernel_sql(stencil.square(1), 'max', 'v', 'src')}), lo AS ({_kernel_sql(stencil.square(1), 'min', 'v', 'src')}), edge AS (SELECT img, y, x, hi.v - lo.v AS v FROM hi JOIN lo USING (img, y, x)), near AS ({_kernel_sql(stencil.ellipse(4), 'max', 'v', 'edge')}) SELECT img, round(sum(CASE WHEN near.v > 0 THEN 4.0::DOUBLE ELSE 1 END), 6) AS w, count(*) FILTER (CASE WHEN near.v > 0 THEN (y + x) % 3 = 0 ELSE src.v = 1 END) AS fused FROM near JOIN src USING (img, y, x) GROUP BY img")
def boundary_band(spark, d):
    """J4, J9, K7."""
    weighted = bands.boundary_weight(_block_mask(spark, d), "m", 4, 4.0)
    third = bands.each(weighted.pick("w"), "w double", lambda y0, p: {"w": [float(p["w"].sum(dtype="float64"))]}).groupBy("img").agg(F.sum("w").alias("w"))
    fused = bands.signed_fusion(bands.placed(weighted.pick("m"), {"dist": "float32"}, lambda y0, p: {"dist": _thirds(y0, p["m"].shape)}), "m", "dist", 4)
    return third.join(bands.each(fused.pick("m"), "fused bigint", lambda y0, p: {"fused": [int(p["m"].sum(dtype="int64"))]}).groupBy("img").agg(F.sum("fused").alias("fused")), "img")


@_query(f"WITH {BLOCK}, src AS (SELECT img, y, x, CASE WHEN r >= 150 THEN 0 ELSE 1 END AS v FROM block), near AS ({_kernel_sql(stencil.ellipse(3), 'max', 'v', 'src')}) SELECT img, count(*) FILTER (r >= 150) AS before, count(*) FILTER (r >= 150 AND NOT (r % 50 <= 20 AND near.v = 1)) AS after FROM near JOIN block USING (img, y, x) GROUP BY img")
def protect_borders(spark, d):
    """K3."""
    b = bands.mapped(raster.block_bands(spark, d), {"d": "uint8", "gray": "uint8"}, lambda p: {"d": p["r"] >= 150, "gray": p["r"] % 50}, ("r",), ("r",))
    counts = bands.each(bands.protect_borders(b, "d", "gray", 3, 20), "before bigint, after bigint", lambda y0, p: {"before": [int((p["r"] >= 150).sum())], "after": [int(p["d"].sum(dtype="int64"))]})
    return counts.groupBy("img").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))


@_query(f"WITH {BLOCK} SELECT img, ny AS y, nx AS x, r FROM (SELECT img, ny, nx, least(ny * 256 // 100, 255) AS y, least(nx * 64 // 40, 63) AS x FROM (SELECT DISTINCT img FROM block), range(0, 100) AS a(ny), range(0, 40) AS b(nx)) JOIN block USING (img, y, x)")
def nearest_resize(spark, d):
    """J11's nearest neighbour."""
    return stencil.nearest(raster.block(spark, d), 64, 256, 40, 100)


def _resize_sql(how: str, width: int, height: int) -> str:
    """block (64 x 256) resized along rows, then along columns."""

    def axis(source: str, at: str, other: str, size: int, new: int) -> str:
        if how == "area":
            weights = f"SELECT n, p, (least((n + 1) * {size / new!r}::DOUBLE, {size}, p + 1) - greatest(n * {size / new!r}::DOUBLE, p)) / (least((n + 1) * {size / new!r}::DOUBLE, {size}) - n * {size / new!r}::DOUBLE) AS w FROM range(0, {new}) a(n), range(0, {size}) b(p) WHERE p + 1 > n * {size / new!r}::DOUBLE AND p < (n + 1) * {size / new!r}::DOUBLE - 1e-9::DOUBLE"
        else:
            centre = f"((n + 0.5::DOUBLE) * {size / new!r}::DOUBLE - 0.5::DOUBLE)"
            weights = f"SELECT n, least(greatest(CAST(floor({centre}) AS BIGINT), 0), {size - 1}) AS p, 1 - ({centre} - floor({centre})) AS w FROM range(0, {new}) a(n) UNION ALL SELECT n, least(greatest(CAST(floor({centre}) AS BIGINT) + 1, 0), {size - 1}), {centre} - floor({centre}) FROM range(0, {new}) a(n)"
        return f"SELECT s.img, s.{other}, k.n AS {at}, sum(s.v * k.w) AS v FROM {source} s JOIN ({weights}) k ON k.p = s.{at} GROUP BY 1, 2, 3"

    return f"WITH {BLOCK}, src AS (SELECT img, y, x, CAST(r AS DOUBLE) AS v FROM block), wide AS ({axis('src', 'x', 'y', 64, width)}) SELECT img, y, x, round(v + 1e-7::DOUBLE, 4) AS v FROM ({axis('wide', 'y', 'x', 256, height)})"


@_query(_resize_sql("linear", 90, 100))
def linear_resize(spark, d):
    """J11's bilinear filter, wider and lower than before."""
    got = stencil.resampled(raster.block(spark, d).withColumnRenamed("r", "v"), "v", 64, 256, 90, 100)
    return got.withColumn("v", F.round(F.col("v") + 1e-7, 4))  # values halfway between two are common here


@_query(_resize_sql("area", 40, 100))
def area_resize(spark, d):
    """J11's area filter."""
    got = stencil.resampled(raster.block(spark, d).withColumnRenamed("r", "v"), "v", 64, 256, 40, 100, "area")
    return got.withColumn("v", F.round(F.col("v") + 1e-7, 4))  # values halfway between two are common here


@_query(f"WITH {BLOCK} SELECT p.img, round(avg(p.r * 0.75::DOUBLE + q.r * 0.25::DOUBLE), 6) AS blended FROM block p JOIN block q ON q.img = p.img + 1 AND q.y = p.y AND q.x = p.x GROUP BY p.img")
def crossfaded(spark, d):
    """J12."""
    px = raster.block(spark, d)
    after = px.select((F.col("img") - 1).alias("img"), "y", "x", F.col("r").alias("r2"))
    return masks.align(px, after).groupBy("img").agg(F.avg(stencil.crossfade(F.col("r"), F.col("r2"), F.lit(0.25))).alias("blended"))


_LABELS = BLOCK + """, on_ AS (SELECT img, y, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS island, x FROM block WHERE r >= 150),
rn AS (SELECT img, y, min(x) AS x0, max(x) + 1 AS x1 FROM on_ GROUP BY img, y, island),
rid AS (SELECT *, img * 1000000 + y * 1000 + x0 AS id FROM rn),
adj AS (SELECT a.id AS u, b.id AS v FROM rid a JOIN rid b ON b.img = a.img AND b.y = a.y + 1 AND b.x0 < a.x1 + 1 AND b.x1 > a.x0 - 1),
both_ AS (SELECT u, v FROM adj UNION ALL SELECT v, u FROM adj),
reach AS (SELECT id AS root, id FROM rid UNION SELECT r.root, b.v FROM reach r JOIN both_ b ON b.u = r.id WHERE b.v > r.root),
lab AS (SELECT id, min(root) AS comp FROM reach GROUP BY id),
cc AS (SELECT img, comp, min(x0) AS x, min(y) AS y, max(x1) - min(x0) AS w, max(y) + 1 - min(y) AS h, CAST(sum(x1 - x0) AS BIGINT) AS area, sum((x0 + x1 - 1) / 2.0::DOUBLE * (x1 - x0)) / sum(x1 - x0) AS cx, sum(y * (x1 - x0)) / sum(x1 - x0) AS cy FROM rid JOIN lab USING (id) GROUP BY img, comp)"""


def _dark_runs(spark: SparkSession, d: str) -> DataFrame:
    return bands.runs(raster.block_bands(spark, d), lambda p: p["r"] >= 150, ("r",))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return topology.component_stats(topology.label(_dark_runs(spark, d), 8, 64))


@_query(f"WITH RECURSIVE {_LABELS} SELECT img, x, y, w, h, area, round(cx, 6) AS cx, round(cy, 6) AS cy FROM cc")
def components(spark, d):
    """K1, F10, E12, D15's areas."""
    return _stats(spark, d).drop("comp")


@_query(f"WITH RECURSIVE {_LABELS}, {HEIGHTS} SELECT img, count(*) FILTER (x > 0 AND y > 0 AND x + w < 64 AND y + h < height) AS islands, CAST(coalesce(sum(area) FILTER (NOT (x > 0 AND y > 0 AND x + w < 64 AND y + h < height)), 0) AS BIGINT) AS still_deleted, CAST(sum(area) AS BIGINT) AS deleted FROM cc JOIN heights USING (img) GROUP BY img")
def islands(spark, d):
    """K2, C22, E6."""
    sizes = bands.sizes(raster.block_bands(spark, d))
    labelled = topology.label(_dark_runs(spark, d), 8, 64)
    inner = topology.landlocked(labelled, sizes).groupBy("img").agg(F.count("*").alias("islands"))
    left = topology.without_islands(labelled, sizes)
    total = lambda rows, name: rows.groupBy("img").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias(name))
    got = total(labelled, "deleted").join(total(left, "still_deleted"), "img", "left").join(inner, "img", "left")
    return got.select("img", F.coalesce("islands", F.lit(0)).alias("islands"), F.coalesce("still_deleted", F.lit(0)).alias("still_deleted"), "deleted")


@_query(f"WITH RECURSIVE {_LABELS} SELECT img, CAST(round_even(cx, 0) AS BIGINT) AS x, CAST(round_even(cy, 0) AS BIGINT) AS y FROM cc WHERE area >= 100")
def low_texture_regions(spark, d):
    """K6, D15, A18's points."""
    return topology.low_texture(topology.label(_dark_runs(spark, d), 8, 64), 100)


_NEAR = ", ".join(f"({dy}, {dx})" for dy in range(-6, 7) for dx in range(-6, 7) if 0 < dy * dy + dx * dx <= 36)


@_query(f"""WITH {_MASK}, {HEIGHTS}, near_ AS MATERIALIZED (SELECT s.img, s.y, s.x, s.v, least(greatest(s.y + k.dy, 0), h.height - 1) AS ny, least(greatest(s.x + k.dx, 0), 63) AS nx, sqrt(CAST(k.dy * k.dy + k.dx * k.dx AS DOUBLE)) AS d FROM src s JOIN heights h ON h.img = s.img CROSS JOIN (VALUES {_NEAR}) AS k(dy, dx)),
o AS (SELECT n.img, n.y, n.x, n.v, min(n.d) FILTER (q.v <> n.v) AS d FROM near_ n JOIN src q ON q.img = n.img AND q.y = n.ny AND q.x = n.nx GROUP BY 1, 2, 3, 4)
SELECT img, y, x, round(CASE WHEN v = 1 THEN -1 ELSE 1 END * coalesce(d, 6.0::DOUBLE) / 6, 6) AS sdt FROM o""")
def signed_distances(spark, d):
    """J7, M8's target."""
    return bands.unpack(bands.signed_distances(_block_mask(spark, d), "m", 6.0).pick("sdt"))


@_query(f"""WITH {_GRAYS}, hi AS ({_kernel_sql(stencil.ellipse(3), "max", "v", "src")}), lo AS ({_kernel_sql(stencil.ellipse(3), "min", "v", "src")}), thr AS (SELECT img, y, x, CASE WHEN hi.v - lo.v >= 30 THEN 1 ELSE 0 END AS v FROM hi JOIN lo USING (img, y, x)),
c1 AS ({_kernel_sql(stencil.ellipse(2), "max", "v", "thr")}), c2 AS ({_kernel_sql(stencil.ellipse(2), "min", "v", "c1")}), o1 AS ({_kernel_sql(stencil.ellipse(2), "min", "v", "c2")}), o2 AS ({_kernel_sql(stencil.ellipse(2), "max", "v", "o1")})
SELECT img, y, x, CAST(thr.v AS BIGINT) AS thr, CAST(c2.v AS BIGINT) AS closed, CAST(o2.v AS BIGINT) AS opened FROM thr JOIN c2 USING (img, y, x) JOIN o2 USING (img, y, x)""")
def guidance_channels(spark, d):
    """J8, C15's guides."""
    return kernels.guidance(raster.block(spark, d), "r")


@_query(f"WITH {BLOCK}, on_ AS (SELECT img, y, x FROM block WHERE r >= 150) SELECT img, count(*) AS outline FROM on_ p WHERE NOT ((img, y - 1, x) IN (SELECT (img, y, x) FROM on_) AND (img, y + 1, x) IN (SELECT (img, y, x) FROM on_) AND (img, y, x - 1) IN (SELECT (img, y, x) FROM on_) AND (img, y, x + 1) IN (SELECT (img, y, x) FROM on_)) GROUP BY img")
def outlines(spark, d):
    """K5: pixels that outlines run along."""
    on = raster.block(spark, d).where("r >= 150").select("img", "y", "x")
    return kernels.contours(on).groupBy("img").agg(F.count("*").alias("outline"))


@_query("""WITH p AS (SELECT user_id, event_id AS ord, CAST(event_id % 100 AS DOUBLE) AS x, CAST(user_id % 50 AS DOUBLE) AS y FROM events),
n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, count(*) OVER (PARTITION BY user_id) AS size FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ord)),
s AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS d FROM n),
c AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum, sum(d) OVER (PARTITION BY user_id) AS total FROM s),
t AS (SELECT DISTINCT user_id, total, greatest(1, CAST(floor(total / 40) AS BIGINT)) AS n FROM c WHERE size >= 2 AND total >= 1),
g AS (SELECT user_id, k, k * (total / n) AS target FROM (SELECT *, unnest(range(0, n)) AS k FROM t)),
m AS (SELECT g.user_id, g.k, coalesce(min(c.ord) FILTER (c.cum >= g.target), max(c.ord)) AS ord FROM g JOIN c ON c.user_id = g.user_id GROUP BY 1, 2)
SELECT m.user_id, m.k, p.x, p.y FROM m JOIN p ON p.user_id = m.user_id AND p.ord = m.ord""")
def arc_resample(spark, d):
    """G13."""
    points = _table(spark, d, "events").select("user_id", F.col("event_id").alias("ord"), (F.col("event_id") % 100).cast("double").alias("x"), (F.col("user_id") % 50).cast("double").alias("y"))
    return layout.resampled(points, 40.0, "user_id")


@_query(f"""WITH {_PAGES}, t AS (SELECT chapter, CAST(sum(height) AS BIGINT) AS height, count(*) AS n FROM pages_ GROUP BY chapter), c AS (SELECT chapter, height, n, CASE WHEN n <= 1 THEN [height // 2] ELSE list_transform(range(0, n), lambda i: CAST(round_even(height // 12 + i * ((greatest(height // 12, height - height // 12) - height // 12) / (n - 1)), 0) AS BIGINT)) END AS centres FROM t)
SELECT chapter, array_to_string(centres, ',') AS centres, array_to_string(list_transform(centres, lambda v: greatest(0, least(CAST(trunc(v - 742.5) AS BIGINT), greatest(0, height - 1485)))), ',') AS tops FROM c""")
def view_centres(spark, d):
    """G14, G15, C23, T18."""
    pages = _pages(spark, d).groupBy("chapter").agg(F.sum("height").alias("height"), F.count("*").alias("n"))
    centred = pages.withColumn("c", scalars.auto_centers(F.col("height"), F.col("n")))
    return centred.select("chapter", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("centres"), F.array_join(F.transform(scalars.hotspot_tops(F.col("height"), F.col("c"), 1188, 0.8), lambda x: x.cast("string")), ",").alias("tops"))


@_query(f"""WITH {_PAGES} SELECT chapter, page, CASE WHEN height <= 1485 THEN 0 ELSE greatest(0, least(page * 100, height - 1485)) END AS y, CASE WHEN width > 900 THEN (width - 900) // 2 ELSE 0 END AS x0, least(width, 900) AS crop_width, least(height, 1485) AS crop_height, greatest(1, CAST(round_even(least(width, 900) * 0.8::DOUBLE, 0) AS BIGINT)) AS new_width, greatest(1, CAST(round_even(least(height, 1485) * 0.8::DOUBLE, 0) AS BIGINT)) AS new_height, CAST(floor((720 - greatest(1, CAST(round_even(least(width, 900) * 0.8::DOUBLE, 0) AS BIGINT))) / 2) AS BIGINT) AS x FROM pages_""")
def view_geometry(spark, d):
    """L7, L9."""
    rows = _pages(spark, d)
    return rows.select("chapter", "page", layout.view_geometry(F.col("width"), F.col("height"), F.col("page") * 100, 720, 1188, 0.8).alias("g")).select("chapter", "page", "g.*")


@_query(f"WITH {_PAGES} SELECT chapter, page AS col, CAST(coalesce(sum(width + 12) OVER (PARTITION BY chapter ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x, CAST(sum(width) OVER (PARTITION BY chapter) + 12 * (count(*) OVER (PARTITION BY chapter) - 1) AS BIGINT) AS total FROM pages_")
def side_by_side(spark, d):
    """L8."""
    return layout.side_by_side(_pages(spark, d).withColumnRenamed("page", "col"), 12, "chapter")


@_query(f"WITH {_PAGES} SELECT chapter, page, y, y % 1000 = 0 AS major FROM (SELECT chapter, page, unnest(range(0, height, 100)) AS y FROM pages_)")
def ruler_ticks(spark, d):
    """G19."""
    return layout.ruler(_pages(spark, d), 100, 10, "chapter", "page")


@_query("""WITH i AS (SELECT n_regionkey, n_nationkey AS ord, n_name AS item, lead(n_name) OVER w AS nxt, row_number() OVER w - 1 AS pos FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)),
h AS (SELECT n_regionkey, pos, item, NULL AS nxt, 0.0::DOUBLE AS alpha, unnest(range(0, CASE WHEN nxt IS NULL THEN 30 ELSE 20 END)) AS f FROM i),
t AS (SELECT n_regionkey, pos, item, nxt, (j + 1) / 6 AS alpha, j + 20 AS f FROM (SELECT *, unnest(range(0, 6)) AS j FROM i WHERE nxt IS NOT NULL))
SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, pos * 26 + f AS frame, item, nxt AS "next", round(alpha, 6) AS alpha FROM (SELECT * FROM h UNION ALL SELECT n_regionkey, pos, item, nxt, alpha, f FROM t)""")
def frame_schedule(spark, d):
    """G20, B12 and B13 as a plan of frames, 2.O."""
    rows = _table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("ord"), F.col("n_name").alias("item"))
    return layout.schedule(rows, 10, 2.0, 0.6, 1.0, "n_regionkey")


@_query(f"""WITH {FINE}, r AS (SELECT img, r / 255.0::DOUBLE AS p, least(greatest(r / 255.0::DOUBLE, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS q, CASE WHEN a < 128 THEN 1.0::DOUBLE ELSE 0 END AS t FROM fine),
g AS (SELECT img, sum(p * t) AS pt, sum(p) AS p, sum(t) AS t, sum(-(t * ln(q) + (1 - t) * ln(1 - q))) AS e, count(*) AS n FROM r GROUP BY img),
b AS (SELECT sum(e) / sum(n) AS bce, 1 - avg((2 * pt + 1) / (p + t + 1)) AS dice FROM g) SELECT round(bce, 6) AS bce, round(dice, 6) AS dice, round(bce * 0.35::DOUBLE + dice * 0.65::DOUBLE, 6) AS loss FROM b""")
def dice_bce(spark, d):
    """M3: every pixel's prediction against its target, by image."""
    return metrics.dice_bce(raster.fine(spark, d), F.col("r") / 255.0, F.when(F.col("a") < 128, 1.0).otherwise(0.0), "img")


@_query("SELECT CAST(label AS BIGINT) AS label, round(avg(CASE WHEN abs(v) < 1 THEN 0.5::DOUBLE * v * v ELSE abs(v) - 0.5::DOUBLE END), 6) AS loss FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) * 10 AS v FROM embeddings) GROUP BY label")
def smooth_l1(spark, d):
    """M8: over all components of all vectors."""
    rows = _table(spark, d, "embeddings").select("label", F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double") * 10)
    return rows.groupBy("label").agg(F.avg(metrics.smooth_l1(F.col("v"))).alias("loss"))


@_query("SELECT user_id, epoch, round(loss, 6) AS loss FROM (SELECT user_id, event_id AS epoch, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events) WHERE k = 1")
def best_checkpoint(spark, d):
    """F13."""
    rows = _table(spark, d, "events").select("user_id", F.col("event_id").alias("epoch"), F.col("value").alias("loss"))
    return metrics.best_epoch(rows, "user_id")


_DRAW = "((({0} + {1}) % 2147483647 * 48271 + 11) % 2147483647 * 48271 + 7) % 2147483647 / 2147483647.0::DOUBLE"


@_query(f"SELECT doc_id, lang FROM documents WHERE {_DRAW.format('doc_id', 7)} < CASE lang WHEN 'en' THEN 0.3::DOUBLE WHEN 'fr' THEN 0.4::DOUBLE WHEN 'de' THEN 0.3::DOUBLE ELSE 0 END")
def strata_sample(spark, d):
    """The same sample on every run."""
    return sampling.stratified(_table(spark, d, "documents"), "lang", "doc_id", {"en": 0.3, "fr": 0.4, "de": 0.3}).select("doc_id", "lang")


@_query(f"WITH d AS (SELECT doc_id, {_DRAW.format('doc_id', 7)} AS u FROM documents) SELECT CASE WHEN u < 0.3 THEN 'uniform' WHEN u < 0.7 THEN 'boundary' ELSE 'flat' END AS stratum, count(*) AS n FROM d GROUP BY 1")
def stratum_picks(spark, d):
    """N4, F15."""
    return sampling.stratum_picks(_table(spark, d, "documents"), "doc_id", {"uniform": 0.3, "boundary": 0.4, "flat": 0.3}).groupBy("stratum").agg(F.count("*").alias("n"))


_CENTRES = f"""m AS (SELECT img, y, x, a < 128 AS p, patch, {_DRAW.format('patch * 1009 + img', 7)} < 0.7 AS wanted, {_DRAW.format('(y * 65536 + x + patch * 7919)', 7)} AS d FROM fine, range(0, 4) AS s(patch)),
centres AS (SELECT img, patch, y, x FROM (SELECT *, row_number() OVER (PARTITION BY img, patch ORDER BY CASE WHEN wanted AND NOT p THEN 1 ELSE 0 END, d, y, x) AS k FROM m) WHERE k = 1)"""


@_query(f"WITH {FINE}, {_CENTRES} SELECT * FROM centres")
def patch_centres(spark, d):
    """N1, D17."""
    return sampling.patch_centres(raster.fine(spark, d), F.col("a") < 128, 4)


@_query(f"""WITH {FINE}, {_CENTRES}, g AS (SELECT img, patch, y - 8 + dy AS y, x - 8 + dx AS x FROM centres, range(0, 16) AS s(dy), range(0, 16) AS t(dx)), j AS (SELECT g.img, patch, coalesce(f.r, 255) AS r, coalesce(f.a, 255) AS a, f.r IS NOT NULL AS inside FROM g LEFT JOIN fine f USING (img, y, x)) SELECT img, patch, CAST(sum(r) AS BIGINT) AS total, count(*) FILTER (NOT inside) AS padded, count(*) FILTER (a < 128) AS positives, count(*) FILTER (a < 128) >= 100 OR patch % 2 = 1 AS accepted FROM j GROUP BY 1, 2""")
def patch_crops(spark, d):
    """Patches around their centres, padded beyond the image with white that is kept."""
    px = raster.fine(spark, d)
    centres = sampling.patch_centres(px, F.col("a") < 128, 4)
    got = layout.patches(centres, px, 16, {"r": 255, "a": 255}).groupBy("img", "patch").agg(F.sum("r").alias("total"), F.count_if(~F.col("inside")).alias("padded"), F.count_if(F.col("a") < 128).alias("positives"))
    return got.withColumn("accepted", sampling.accepted(F.col("positives"), F.col("patch") % 2 == 0, 100))


@_query(f"""WITH {FINE}, i AS (SELECT img, 1 + 0.5::DOUBLE * ({_DRAW.format('img', 7)}) AS factor FROM (SELECT DISTINCT img FROM fine)), g AS (SELECT img, ny, nx, CAST(floor((ny + 0.5::DOUBLE - 32) / factor + 32) AS BIGINT) AS y, CAST(floor((nx + 0.5::DOUBLE - 32) / factor + 32) AS BIGINT) AS x FROM i, range(0, 64) AS a(ny), range(0, 64) AS b(nx)) SELECT img, ny AS y, nx AS x, r FROM g JOIN fine USING (img, y, x)""")
def zoom_jitter(spark, d):
    """N3."""
    return sampling.zoomed(raster.fine(spark, d).select("img", "y", "x", "r"), 64, 64)


@_query(f"WITH RECURSIVE {_POST} SELECT p.img, CAST(p.idx AS BIGINT) AS idx, count(*) AS n, CAST(sum(b.r * (b.y - p.y0 + 1)) AS BIGINT) AS total FROM post p JOIN block b ON b.img = p.img AND b.y >= p.y0 AND b.y < p.y1 GROUP BY 1, 2")
def segment_crops(spark, d):
    """What each segment cuts out of its strip."""
    got = layout.crops(raster.block(spark, d), post_merge(spark, d).select("img", "idx", "y0", "y1"))
    return got.groupBy("img", "idx").agg(F.count("*").alias("n"), F.sum(F.col("r") * (F.col("y") + 1)).alias("total"))


@_query("SELECT conv_id, CASE WHEN bool_or(turn % 4 = 3) THEN 'RGBA' ELSE 'RGB' END AS mode FROM conversations GROUP BY conv_id")
def output_modes(spark, d):
    """F17."""
    parts = _table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 4 == 3, 4).otherwise(3).alias("n_channels"))
    return layout.output_mode(parts, "conv_id")


@_query(f"WITH {FINE} SELECT img, count(*) FILTER (r / 255.0::DOUBLE >= 0.5) AS by_threshold, count(*) FILTER (b <= 127) AS by_refinement FROM fine GROUP BY img")
def refined_masks(spark, d):
    """D11, D18."""
    return raster.fine(spark, d).groupBy("img").agg(F.count_if(F.col("r") / 255.0 >= 0.5).alias("by_threshold"), F.count_if(F.col("b") <= 127).alias("by_refinement"))


@_query(f"WITH {FINE} SELECT img, CAST(sum(CASE WHEN a < 128 THEN 0 ELSE 255 END) AS BIGINT) AS alpha, CAST(sum(CASE WHEN a < 128 THEN 255 ELSE r END * (x + 1)) AS BIGINT) AS red, CAST(sum(CASE WHEN a < 128 THEN 0 ELSE g + b END) AS BIGINT) AS rest FROM fine GROUP BY img")
def written_pixels(spark, d):
    """B1, B2, A5: alpha of the cleaned strip, and the preview in red."""
    px = raster.fine(spark, d)
    gone = F.col("a") < 128
    red = sinks.red_preview(px, gone).groupBy("img").agg(F.sum(F.col("r") * (F.col("x") + 1)).alias("red"), F.sum(F.col("g") + F.col("b")).alias("rest"))
    return sinks.cleaned(px, gone).groupBy("img").agg(F.sum("a").alias("alpha")).join(red, "img")


@_query(f"WITH {_FILES} SELECT min(chapter) AS chapter FROM ordered")
def first_chapter(spark, d):
    """H5."""
    return discovery.versions(_version_files(spark, d)).agg(F.min("chapter").alias("chapter"))


@_query("SELECT b.item_id FROM benchmark b WHERE item_id NOT IN (SELECT doc_id FROM labels)")
def outputs_to_write(spark, d):
    """What has no output yet."""
    wanted = _table(spark, d, "benchmark").select(F.col("item_id").alias("name"))
    done = _table(spark, d, "labels").select(F.col("doc_id").alias("name"))
    return sinks.missing_outputs(wanted, done).select(F.col("name").alias("item_id"))


_TONE = "CASE WHEN chg < 0.6::DOUBLE THEN CAST(greatest(0, least(255, round(({0} - 127.5::DOUBLE) * con + 127.5::DOUBLE + bri))) AS BIGINT) ELSE {0} END AS {0}"


@_query(f"""WITH {FINE}, i AS (SELECT img, {_DRAW.format("img", 7)} AS flip, {_DRAW.format("img", 8)} AS chg, 0.92::DOUBLE + 0.16::DOUBLE * ({_DRAW.format("img", 9)}) AS con, (({_DRAW.format("img", 10)}) - 0.5::DOUBLE) * 0.08::DOUBLE * 255 AS bri FROM (SELECT DISTINCT img FROM fine))
SELECT img, y, CASE WHEN flip < 0.5::DOUBLE THEN 63 - x ELSE x END AS x, {_TONE.format("r")}, {_TONE.format("g")}, {_TONE.format("b")}, a FROM fine JOIN i USING (img)""")
def augmented(spark, d):
    """Mirrored and toned images."""
    return sampling.augment(raster.fine(spark, d))


@_query("SELECT c_mktsegment AS k, 'module.' || c_mktsegment AS wrapped, c_mktsegment AS bare FROM customer GROUP BY 1")
def state_keys(spark, d):
    """C24."""
    rows = _table(spark, d, "customer").select(F.col("c_mktsegment").alias("k")).distinct()
    wrapped = rows.withColumn("m", scalars.renamed_keys(F.create_map("k", F.lit(1)), False))
    return wrapped.select("k", F.map_keys("m")[0].alias("wrapped"), F.map_keys(scalars.renamed_keys(F.col("m")))[0].alias("bare"))


@_query("SELECT chapter, width, height FROM (SELECT vec_id // 64 AS chapter, count(*) AS height, max(len(embedding)) AS width FROM embeddings GROUP BY 1)")
def same_size(spark, d):
    """D19, F17's any, T14."""
    rows = _table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 64).alias("chapter")).agg(F.count("*").alias("height"), F.max(F.size("embedding")).alias("width"))
    return masks.require_one_size(rows, "chapter")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, d, f=f: _plain(f(spark, d))) for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


from . import band_queries  # noqa: E402, F401  registers what runs on packed bands
