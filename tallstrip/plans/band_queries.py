"""Registered queries on packed bands, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bands, contours, kernels, layout, patches, stencil, stored, strips, topology
from ..operators.bands import Bands
from ..schema import MODEL_CONFIG
from ..sources import images, raster, sinks
from ..work import new_path
from . import pipelines
from .registry import _GRAYS, _MASK, _POST, _SUMS, _band_sums, _block_mask, _kernel_sql, _query, BLOCK, FINE, HEIGHTS, post_merge


def _fine(spark: SparkSession, d: str, *planes: str) -> Bands:
    return raster.fine_bands(spark, d, *planes)


def _block(spark: SparkSession, d: str) -> Bands:
    return raster.block_bands(spark, d)


def edges_sql(source: str, low: float, high: float) -> str:
    """CTEs up to edge (img, y, x): Sobel derivatives with repeated borders, maxima across the edge, and from the strong
    ones on all that touch."""
    near = lambda f, c, by, at: f"coalesce({f}({c}) OVER (PARTITION BY img, {by} ORDER BY {at}), {c})"
    row = lambda f, c: near(f, c, "y", "x")
    down = lambda f, c: near(f, c, "x", "y")
    return f"""g1 AS (SELECT img, y, x, {row("lead", "v")} - {row("lag", "v")} AS h, {row("lead", "v")} + 2 * v + {row("lag", "v")} AS s FROM {source}),
g2 AS (SELECT img, y, x, {down("lag", "h")} + 2 * h + {down("lead", "h")} AS gx, {down("lead", "s")} - {down("lag", "s")} AS gy FROM g1),
g3 AS (SELECT *, abs(gx) + abs(gy) AS st, abs(gy) / greatest(CAST(abs(gx) AS DOUBLE), 1e-12::DOUBLE) AS angle FROM g2),
g4 AS (SELECT *, {down("lag", "st")} AS up, {down("lead", "st")} AS dn, {row("lag", "st")} AS lf, {row("lead", "st")} AS rt FROM g3),
g5 AS (SELECT *, {row("lag", "up")} AS upl, {row("lead", "up")} AS upr, {row("lag", "dn")} AS dnl, {row("lead", "dn")} AS dnr FROM g4),
candidate AS (SELECT img, y, x, st FROM g5 WHERE st > {low} AND CASE WHEN angle < tan(pi() / 8) THEN st > lf AND st >= rt WHEN angle > tan(3 * pi() / 8) THEN st > up AND st >= dn WHEN gx * gy >= 0 THEN st > upl AND st >= dnr ELSE st > upr AND st >= dnl END),
edge AS (SELECT img, y, x FROM candidate WHERE st > {high} UNION SELECT c.img, c.y, c.x FROM edge e JOIN candidate c ON c.img = e.img AND abs(c.y - e.y) <= 1 AND abs(c.x - e.x) <= 1)"""


def runs_sql(p: str, source: str, where: str) -> str:
    """{p}rn: (img, y, x0, x1, id)."""
    return f"""{p}on AS (SELECT img, y, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS island, x FROM {source} WHERE {where}),
{p}rn AS (SELECT img, y, min(x) AS x0, max(x) + 1 AS x1, y * 2147483648 + min(x) AS id FROM {p}on GROUP BY img, y, island)"""


def labels_sql(p: str, runs: str, keys: str = "img", corner: int = 1) -> str:
    """{p}lab: (keys, id, comp), the least id that a run is connected to."""
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    return f"""{p}adj AS (SELECT {of("a")}, a.id AS u, b.id AS v FROM {runs} a JOIN {runs} b ON {same("a", "b")} AND b.y = a.y + 1 AND b.x0 < a.x1 + {corner} AND b.x1 > a.x0 - {corner}),
{p}both AS (SELECT {keys}, u, v FROM {p}adj UNION ALL SELECT {keys}, v, u FROM {p}adj),
{p}reach AS (SELECT {keys}, id AS root, id FROM {runs} UNION SELECT {of("r")}, r.root, b.v FROM {p}reach r JOIN {p}both b ON {same("b", "r")} AND b.u = r.id WHERE b.v > r.root),
{p}lab AS (SELECT {keys}, id, min(root) AS comp FROM {p}reach GROUP BY {keys}, id)"""


def holes_sql(p: str, source: str, where: str, least: int) -> str:
    """{p}hole: (img, comp, y, x0, x1), what closed outlines enclose. A component's rows are all in a row, so the gaps
    between its runs and its box's sides are the complement."""
    return f"""{runs_sql(p, source, where)}, {labels_sql(p, p + "rn")},
{p}c AS (SELECT r.*, l.comp FROM {p}rn r JOIN {p}lab l USING (img, id)),
{p}box AS (SELECT img, comp, min(x0) AS bx0, max(x1) AS bx1, min(y) AS by0, max(y) + 1 AS by1 FROM {p}c GROUP BY img, comp HAVING (max(x1) - min(x0)) * (max(y) + 1 - min(y)) >= {least} + sum(x1 - x0)),
{p}g AS (SELECT img, comp, y, bx0, bx1, by0, by1, coalesce(lag(x1) OVER w, bx0) AS x0, x0 AS x1, lead(x0) OVER w IS NULL AS last, x1 AS ended FROM {p}c JOIN {p}box USING (img, comp) WINDOW w AS (PARTITION BY img, comp, y ORDER BY x0)),
{p}gap AS (SELECT img, comp, y, x0, x1, bx0, bx1, by0, by1, y * 2147483648 + x0 AS id FROM {p}g WHERE x0 < x1 UNION ALL SELECT img, comp, y, ended, bx1, bx0, bx1, by0, by1, y * 2147483648 + ended FROM {p}g WHERE last AND ended < bx1),
{p}outer AS (SELECT img, comp, id FROM {p}gap WHERE x0 = bx0 OR x1 = bx1 OR y = by0 OR y = by1 - 1 UNION SELECT n.img, n.comp, n.id FROM {p}outer o JOIN {p}gap a USING (img, comp, id) JOIN {p}gap n ON n.img = a.img AND n.comp = a.comp AND abs(n.y - a.y) = 1 AND n.x0 < a.x1 AND n.x1 > a.x0),
{p}inner AS (SELECT g.img, g.comp AS ring, g.y, g.x0, g.x1, g.id FROM {p}gap g ANTI JOIN {p}outer o USING (img, comp, id)),
{labels_sql(p + "i", p + "inner", "img, ring", 0)},
{p}hole AS (SELECT i.img, i.ring AS comp, i.y, i.x0, i.x1 FROM {p}inner i JOIN {p}ilab l USING (img, ring, id) JOIN (SELECT img, ring, comp FROM {p}inner JOIN {p}ilab USING (img, ring, id) GROUP BY 1, 2, 3 HAVING sum(x1 - x0) >= {least}) USING (img, ring, comp))"""


_EDGED = f"{FINE}, gray_ AS (SELECT img, y, x, gray AS v FROM feat), {edges_sql('gray_', 50, 150)}"


@_query(f"""WITH RECURSIVE {_EDGED},
m AS (SELECT f.img, f.a < 16 AS d, f.a < 16 AND (f.gray < 180 OR f.sat > 45 OR e.x IS NOT NULL) AS dm, NOT (f.a < 16) AND f.gray >= 120 AND f.gray <= 245 AND f.sat <= 35 AND e.x IS NOT NULL AS l FROM feat f LEFT JOIN edge e USING (img, y, x)),
s AS (SELECT img, count(*) AS total_pixels, count(*) FILTER (d) AS deleted_pixels, count(*) FILTER (dm) AS damaged_pixels, count(*) FILTER (l) AS leftover_grayline_pixels FROM m GROUP BY img),
p AS (SELECT *, CASE WHEN deleted_pixels > 0 THEN damaged_pixels / deleted_pixels * 100.0::DOUBLE ELSE 0 END AS dd, damaged_pixels / total_pixels * 100.0::DOUBLE AS dt, leftover_grayline_pixels / total_pixels * 100.0::DOUBLE AS lt FROM s),
q AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - (dd + lt * 5))) AS success, dd + dt * 0.5 + lt * 5 AS priority FROM p)
SELECT img, row_number() OVER (ORDER BY priority DESC, img) AS rank, total_pixels, deleted_pixels, damaged_pixels, leftover_grayline_pixels, round(dd, 6) AS damage_percent_deleted, round(success, 6) AS estimated_success_percent, round(priority, 6) AS priority_score FROM q""")
def score_with_edges(spark, d):
    """The flagship with its edge term, on packed bands. F1, D4, D5, J6, G12, H1."""
    got = pipelines.evaluate_bands(_fine(spark, d, "r", "g", "b", "a"), True)
    return got.select("img", "rank", "total_pixels", "deleted_pixels", "damaged_pixels", "leftover_grayline_pixels", "damage_percent_deleted", "estimated_success_percent", "priority_score")


@_query(f"WITH RECURSIVE {_GRAYS}, {edges_sql('src', 120, 240)} SELECT img, y, x FROM edge")
def edge_pixels(spark, d):
    """J6, J8's edges."""
    marked = bands.edge_plane(_block(spark, d), "r", 120, 240)
    return raster.pixels_of(bands.runs(marked, lambda p: p["edge"] > 0, ("edge",)))


@_query(f"WITH RECURSIVE {BLOCK}, {holes_sql('h', 'block', 'r <= 110', 16)} SELECT img, comp, y, x0, x1 FROM hhole")
def hole_repair(spark, d):
    """Insides of closed outlines."""
    dark = bands.runs(_block(spark, d), lambda p: p["r"] <= 110, ("r",))
    return topology.frame_interiors(dark, 16, 64)


_TILE = f"""{BLOCK}, {HEIGHTS}, tile AS (SELECT img, unnest(range(0, CASE WHEN height <= 40 THEN 1 ELSE CAST(ceil((height - 40) / 30) AS BIGINT) * 30 + 1 END, 30)) AS ty FROM heights),
t AS (SELECT b.img, b.y, b.x, (b.r / 255.0::DOUBLE + ((b.y - ty) * 7 + (b.x - tx) * 3) % 11 / 11.0::DOUBLE) / 2 AS s, greatest(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (b.y - ty) / 39), 0.05::DOUBLE) * greatest(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (b.x - tx) / 39), 0.05::DOUBLE) AS w FROM block b JOIN tile ON tile.img = b.img AND b.y >= ty AND b.y < ty + 40 JOIN (VALUES (0), (30)) AS c(tx) ON b.x >= tx AND b.x < tx + 40),
score AS (SELECT img, y, x, sum(s * w) / greatest(sum(w), 1e-6::DOUBLE) AS p FROM t GROUP BY img, y, x)"""


@_query(f"WITH {_TILE} SELECT img, y, x, round(p, 6) AS p FROM score")
def tiled_scores(spark, d):
    """M1 and M2 with a stand-in scorer whose overlapping tiles differ: scores weighed by place, on packed bands."""
    scored = bands.predict(_block(spark, d), "r", kernels.PlacedScorer(), {"p": "float64"}, lambda s: {"p": s}, 40, 10)
    return bands.unpack(scored.pick("p"))


_CLEANED = f"""{FINE}, {HEIGHTS.replace("block", "fine")},
tile AS (SELECT img, unnest(range(0, CASE WHEN height <= 48 THEN 1 ELSE CAST(ceil((height - 48) / 32) AS BIGINT) * 32 + 1 END, 32)) AS ty FROM heights),
t AS (SELECT b.img, b.y, b.x, (b.gray / 255.0::DOUBLE + ((b.y - ty) * 7 + (b.x - tx) * 3) % 11 / 11.0::DOUBLE) / 2 AS s, greatest(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (b.y - ty) / 47), 0.05::DOUBLE) * greatest(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (b.x - tx) / 47), 0.05::DOUBLE) AS w FROM feat b JOIN tile ON tile.img = b.img AND b.y >= ty AND b.y < ty + 48 JOIN (VALUES (0), (32)) AS c(tx) ON b.x >= tx AND b.x < tx + 48),
d0 AS (SELECT img, y, x, CASE WHEN sum(s * w) / greatest(sum(w), 1e-6::DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS v FROM t GROUP BY img, y, x),
d1 AS ({_kernel_sql(stencil.ellipse(1), "max", "v", "d0")}), d2 AS ({_kernel_sql(stencil.ellipse(1), "min", "v", "d1")}),
{runs_sql("a", "d2", "v = 1")}, {labels_sql("a", "arn")},
left_ AS (SELECT r.img, r.y, r.x0, r.x1 FROM arn r JOIN alab l USING (img, id) JOIN (SELECT img, comp FROM arn JOIN alab USING (img, id) JOIN heights USING (img) GROUP BY img, comp, height HAVING NOT (min(x0) > 0 AND min(y) > 0 AND max(x1) < 64 AND max(y) + 1 < height)) USING (img, comp)),
d3 AS (SELECT f.img, f.y, f.x, f.gray, CASE WHEN l.x0 IS NULL THEN 0 ELSE 1 END AS v FROM feat f LEFT JOIN left_ l ON l.img = f.img AND l.y = f.y AND f.x >= l.x0 AND f.x < l.x1),
k0 AS (SELECT img, y, x, 1 - v AS v FROM d3), k1 AS ({_kernel_sql(stencil.ellipse(3), "max", "v", "k0")}),
d4 AS (SELECT d3.img, d3.y, d3.x, CASE WHEN d3.v = 1 AND d3.gray <= 60 AND k1.v = 1 THEN 0 ELSE d3.v END AS v FROM d3 JOIN k1 USING (img, y, x)),
s0 AS (SELECT img, y, x, CASE WHEN gray <= 60 THEN 1 ELSE 0 END AS v FROM feat), s1 AS ({_kernel_sql(stencil.ellipse(2), "max", "v", "s0")}), s2 AS ({_kernel_sql(stencil.ellipse(2), "min", "v", "s1")}),
{holes_sql("h", "s2", "v = 1", 16)},
ins AS (SELECT img, comp, y, unnest(range(x0, x1)) AS x FROM hhole),
inset AS (SELECT q.img, q.comp, q.y - k.dy AS y, q.x - k.dx AS x FROM ins q, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS k(dy, dx) GROUP BY 1, 2, 3, 4 HAVING count(*) = 5)
SELECT d.img, CAST(sum(d.v) AS BIGINT) AS scored, CAST(sum(CASE WHEN i.x IS NOT NULL THEN 0 ELSE e.v END) AS BIGINT) AS deleted, count(*) AS total FROM d0 d JOIN d4 e USING (img, y, x) LEFT JOIN (SELECT DISTINCT img, y, x FROM inset) i USING (img, y, x) GROUP BY d.img"""


@_query(f"WITH RECURSIVE {_CLEANED}")
def cleaned_strips(spark, d):
    """3.1: strips scored by tiles, closed, islands reclaimed, borders protected and frames repaired, on packed bands."""
    b = _fine(spark, d, "r", "g", "b")
    p = pipelines.CleanParams(tile=48, overlap=16, darkness=60, least_interior=16, inset=1, scorer=kernels.PlacedScorer())
    first = pipelines.CleanParams(tile=48, overlap=16, close_radius=0, islands=False, border_band=0, frames=False, scorer=kernels.PlacedScorer())
    count = lambda params, out: bands.each(pipelines.clean_bands(b, 0.5, params).pick("delete"), f"{out} bigint, n bigint", lambda y0, q: {out: [int(q["delete"].sum())], "n": [q["delete"].size]})
    scored = count(first, "s").groupBy("img").agg(F.sum("s").alias("scored"))
    return count(p, "s").groupBy("img").agg(F.sum("s").alias("deleted"), F.sum("n").alias("total")).join(scored, "img")


@_query(f"WITH {_MASK}, a AS ({_kernel_sql(stencil.ellipse(5), 'max', 'v', 'src')}), b AS ({_kernel_sql(stencil.ellipse(5), 'min', 'v', 'a')}), c AS ({_kernel_sql(stencil.square(4), 'min', 'v', 'b')}), e AS ({_kernel_sql(stencil.square(4), 'max', 'v', 'c')}) " + _SUMS.format("SELECT * FROM e"))
def banded_open_close(spark, d):
    """J1, J2, J5, J13 on packed bands: one pass for four kernels of larger radius."""
    made = bands.over(_block_mask(spark, d), 18, {"v": "uint8"}, lambda p: {"v": bands.opened(bands.closed(p["m"], stencil.ellipse(5)), stencil.square(4))}, ("m",), ())
    return _band_sums(made, "v")


@_query(f"WITH {_MASK}, hi AS ({_kernel_sql(stencil.square(1), 'max', 'v', 'src')}), lo AS ({_kernel_sql(stencil.square(1), 'min', 'v', 'src')}), edge AS (SELECT img, y, x, hi.v - lo.v AS v FROM hi JOIN lo USING (img, y, x)), near AS ({_kernel_sql(stencil.ellipse(4), 'max', 'v', 'edge')}), keep AS (SELECT img, y, x, 1 - v AS v FROM src), by_ AS ({_kernel_sql(stencil.ellipse(3), 'max', 'v', 'keep')}) SELECT img, round(sum(CASE WHEN near.v > 0 THEN 4.0::DOUBLE ELSE 1 END), 6) AS w, count(*) FILTER (CASE WHEN near.v > 0 THEN (y + x) % 3 = 0 ELSE src.v = 1 END) AS fused, count(*) FILTER (src.v = 1 AND NOT (r % 50 <= 20 AND by_.v = 1)) AS guarded FROM near JOIN src USING (img, y, x) JOIN by_ USING (img, y, x) JOIN block USING (img, y, x) GROUP BY img")
def banded_boundaries(spark, d):
    """J4, J9, K3, K7 on packed bands."""
    px = raster.block(spark, d).withColumn("m", F.when(F.col("r") >= 150, 1).otherwise(0)).withColumn("dist", F.when((F.col("y") + F.col("x")) % 3 == 0, -1).otherwise(1)).withColumn("gray", F.col("r") % 50)
    b = bands.pack(px, {"m": "uint8", "dist": "float32", "gray": "uint8"}, 100)
    made = bands.signed_fusion(bands.boundary_weight(b, "m", 4, 4.0).pick("m", "dist", "w"), "m", "dist", 4)
    guarded = bands.protect_borders(b.pick("m", "gray"), "m", "gray", 3, 20)
    total = lambda x, out, p, kind: bands.each(x.pick(p), f"{out} {kind}", lambda y0, q: {out: [float(q[p].sum()) if kind == "double" else int(q[p].sum())]}).groupBy("img").agg(F.sum(out).alias(out))
    return total(made, "w", "w", "double").join(total(made, "fused", "m", "bigint"), "img").join(total(guarded, "guarded", "m", "bigint"), "img")


_LOOPS = f"""{BLOCK}, on_ AS (SELECT img, y, x FROM block WHERE r >= 150),
side AS (SELECT o.img, o.y, o.x, k.side, k.dy, k.dx, k.ty, k.tx FROM on_ o, (VALUES (0, -1, 0, 0, 1), (1, 0, 1, 1, 0), (2, 1, 0, 0, -1), (3, 0, -1, -1, 0)) AS k(side, dy, dx, ty, tx) WHERE (o.img, o.y + k.dy, o.x + k.dx) NOT IN (SELECT (img, y, x) FROM on_)),
ahead AS (SELECT s.*, q.x IS NOT NULL AS q, r.x IS NOT NULL AS r FROM side s LEFT JOIN on_ q ON q.img = s.img AND q.y = s.y + s.dy + s.ty AND q.x = s.x + s.dx + s.tx LEFT JOIN on_ r ON r.img = s.img AND r.y = s.y + s.ty AND r.x = s.x + s.tx),
link AS (SELECT img, y, x, side, (y * 2147483648 + x) * 4 + side AS id, side % 2 = 1 AS up, y * 100000 + x + CASE WHEN side = 1 THEN 1 ELSE 0 END AS place, q OR r AS turns,
  CASE WHEN q THEN ((y + dy + ty) * 2147483648 + x + dx + tx) * 4 + (side + 3) % 4 WHEN r THEN ((y + ty) * 2147483648 + x + tx) * 4 + side ELSE (y * 2147483648 + x) * 4 + (side + 1) % 4 END AS nxt FROM ahead),
walk AS (SELECT img, id AS root, place AS start, y AS sy, x AS sx, id, nxt, y, x, turns, 0 AS step FROM link WHERE up UNION ALL SELECT w.img, w.root, w.start, w.sy, w.sx, l.id, l.nxt, l.y, l.x, l.turns, w.step + 1 FROM walk w JOIN link l ON l.img = w.img AND l.id = w.nxt WHERE l.id <> w.root AND NOT (l.up AND l.place < w.start)),
loop_ AS (SELECT w.*, n.n, CASE WHEN step = 0 THEN 0 ELSE n.n - step END AS r FROM walk w JOIN (SELECT img, root, max(step) + 1 AS n FROM walk GROUP BY img, root HAVING bool_or(nxt = root)) n USING (img, root)),
kept AS (SELECT img, root, sy, sx, y, x, r FROM loop_ WHERE r = 0 OR turns),
outline AS (SELECT img, root, r, y, x FROM (SELECT *, lead(r) OVER (PARTITION BY img, root ORDER BY r) AS after FROM kept) WHERE r = 0 OR after IS NOT NULL OR y <> sy OR x <> sx)"""


@_query(f"WITH RECURSIVE {_LOOPS} SELECT img, root % 4 = 1 AS hole, root AS outline, row_number() OVER (PARTITION BY img, root ORDER BY r) - 1 AS ord, y, x FROM outline")
def traced_outlines(spark, d):
    """K5: outlines as closed chains of points, in order, around parts and inside holes."""
    from pyspark.sql import Window

    b = bands.mapped(_block(spark, d), {"m": "uint8"}, lambda p: {"m": p["r"] >= 150}, ("r",), ())
    points = contours.outlines(b, "m")
    return points.withColumn("ord", F.row_number().over(Window.partitionBy("img", "outline").orderBy("ord")) - 1)


_POINTS = f"""{_LOOPS}, p AS (SELECT *, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx FROM outline WINDOW w AS (PARTITION BY img, root ORDER BY r)),
st AS (SELECT *, CASE WHEN ny <> y AND nx <> x THEN 1 ELSE 0 END AS slant, CASE WHEN (ny <> y) <> (nx <> x) THEN 1 ELSE 0 END AS straight FROM p),
cm AS (SELECT *, coalesce(sum(straight) OVER u, 0) + coalesce(sum(slant) OVER u, 0) * sqrt(2.0::DOUBLE) AS cum, sum(straight) OVER a + sum(slant) OVER a * sqrt(2.0::DOUBLE) AS total, count(*) OVER a AS size FROM st WINDOW a AS (PARTITION BY img, root), u AS (PARTITION BY img, root ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tg AS (SELECT DISTINCT img, root, total, greatest(1, CAST(floor(total / 40.0::DOUBLE) AS BIGINT)) AS n FROM cm WHERE size >= 2 AND total >= 1),
tk AS (SELECT img, root, k, k * (total / n) AS target FROM (SELECT *, unnest(range(0, n)) AS k FROM tg)),
pk AS (SELECT t.img, t.root, t.k, coalesce(min(c.r) FILTER (c.cum >= t.target), max(c.r)) AS r FROM tk t JOIN cm c USING (img, root) GROUP BY 1, 2, 3),
boundary AS (SELECT k.img, k.root AS outline, k.k, c.y, c.x FROM pk k JOIN cm c USING (img, root, r))"""


def _boundary(spark: SparkSession, d: str) -> DataFrame:
    b = bands.mapped(_block(spark, d), {"m": "uint8"}, lambda p: {"m": p["r"] >= 150}, ("r",), ())
    return contours.resampled(contours.outlines(b, "m"), 40.0)


@_query(f"WITH RECURSIVE {_POINTS} SELECT * FROM boundary")
def boundary_points(spark, d):
    """Points 40 pixels of length apart on every outline."""
    return _boundary(spark, d)


_SIDECAR = f"""{_POINTS}, {runs_sql("t", "block", "r >= 150")}, {labels_sql("t", "trn")},
flat AS (SELECT img, CAST(round_even(cx, 0) AS BIGINT) AS x, CAST(round_even(cy, 0) AS BIGINT) AS y FROM (SELECT img, comp, sum((x0 + x1 - 1) / 2.0::DOUBLE * (x1 - x0)) / sum(x1 - x0) AS cx, sum(y * (x1 - x0)) / sum(x1 - x0) AS cy FROM trn JOIN tlab USING (img, id) GROUP BY img, comp HAVING sum(x1 - x0) >= 100))"""


@_query(f"""WITH RECURSIVE {_SIDECAR} SELECT b.img, max(b.x) + 1 AS w, max(b.y) + 1 AS h, coalesce(any_value(f.points), '') AS low_texture, coalesce(any_value(o.points), '') AS boundary FROM block b
LEFT JOIN (SELECT img, string_agg('[' || x || ',' || y || ']', ',' ORDER BY x, y) AS points FROM flat GROUP BY img) f ON f.img = b.img
LEFT JOIN (SELECT img, string_agg('[' || x || ',' || y || ']', ',' ORDER BY outline, k) AS points FROM boundary GROUP BY img) o ON o.img = b.img GROUP BY b.img""")
def strata_sidecar(spark, d):
    """The strata of an image as its sidecar lists them, flat regions and boundaries."""
    b = _block(spark, d)
    labelled = topology.label(bands.runs(b, lambda p: p["r"] >= 150, ("r",)), 8, 64)
    shown = lambda c: F.array_join(F.transform(c, lambda q: F.concat(F.lit("["), q["x"].cast("string"), F.lit(","), q["y"].cast("string"), F.lit("]"))), ",")
    low = topology.low_texture(labelled, 100).groupBy("img").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    edge = _boundary(spark, d).groupBy("img").agg(F.array_sort(F.collect_list(F.struct("outline", "k", "x", "y"))).alias("q"))
    got = bands.sizes(b).join(low, "img", "left").join(edge, "img", "left")
    return got.select("img", F.col("width").alias("w"), F.col("height").alias("h"), F.coalesce(shown("p"), F.lit("")).alias("low_texture"), F.coalesce(shown("q"), F.lit("")).alias("boundary"))


_U = "(CAST('0x' || substr(md5('7:' || patch || ':' || attempt || ':{}'), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE)"
_SAMPLE = f"""{FINE}, {HEIGHTS.replace("block", "fine")}, mk AS (SELECT img, y, x, CASE WHEN a < 100 AND x < 40 THEN 1 ELSE 0 END AS v FROM fine),
hi AS ({_kernel_sql(stencil.square(1), "max", "v", "mk")}), lo AS ({_kernel_sql(stencil.square(1), "min", "v", "mk")}),
pos AS (SELECT img, y, x, row_number() OVER (PARTITION BY img ORDER BY y, x) - 1 AS k FROM mk WHERE v = 1),
bnd AS (SELECT img, y, x, row_number() OVER (PARTITION BY img ORDER BY y, x) - 1 AS k FROM hi JOIN lo USING (img, y, x) WHERE hi.v > lo.v),
im AS (SELECT img, height, row_number() OVER (ORDER BY img) - 1 AS number, (SELECT count(*) FROM pos p WHERE p.img = h.img) AS np, (SELECT count(*) FROM bnd b WHERE b.img = h.img) AS nb FROM heights h),
tr AS (SELECT patch, attempt, CAST(floor({_U.format("image")} * (SELECT count(*) FROM im)) AS BIGINT) AS number, {_U.format("kind")} < 0.7 AND attempt < 12 AS wanted FROM range(0, 60) AS s(patch), range(0, 13) AS t(attempt)),
mt AS (SELECT tr.*, im.img, height, np, nb, wanted AND np > 0 AS around FROM tr JOIN im USING (number)),
me AS (SELECT *, around AND nb > 0 AND {_U.format("boundary")} < 0.5 AS edges FROM mt),
mr AS (SELECT *, CAST(floor({_U.format("pixel")} * CASE WHEN edges THEN nb ELSE np END) AS BIGINT) AS k, CAST(floor({_U.format("y")} * CASE WHEN around THEN 20 ELSE greatest(0, height - 20) + 1 END) AS BIGINT) AS dy, CAST(floor({_U.format("x")} * CASE WHEN around THEN 20 ELSE 45 END) AS BIGINT) AS dx FROM me),
pl AS (SELECT m.patch, m.attempt, m.wanted, m.img, CASE WHEN around THEN greatest(0, least(coalesce(b.y, p.y) - dy, greatest(0, height - 20))) ELSE dy END AS y0, CASE WHEN around THEN greatest(0, least(coalesce(b.x, p.x) - dx, 44)) ELSE dx END AS x0 FROM mr m LEFT JOIN pos p ON NOT edges AND around AND p.img = m.img AND p.k = m.k LEFT JOIN bnd b ON edges AND b.img = m.img AND b.k = m.k),
ct AS (SELECT l.*, coalesce((SELECT CAST(sum(v) AS BIGINT) FROM mk WHERE mk.img = l.img AND mk.y >= l.y0 AND mk.y < l.y0 + 20 AND mk.x >= l.x0 AND mk.x < l.x0 + 20), 0) AS positives FROM pl l),
picked AS (SELECT patch, img, y0, x0, CAST(attempt AS BIGINT) AS attempt, wanted, positives FROM (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY attempt) AS first FROM ct WHERE NOT wanted OR positives >= 160) WHERE first = 1)"""


def _positive(p):
    import numpy as np

    return {"m": (p["a"] < 100) & (np.arange(p["a"].shape[1]) < 40)}


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    b = bands.mapped(raster.fine_bands(spark, d, "a", rows=24), {"m": "uint8"}, _positive, ("a",), ())
    return patches.sample(b, "m", 60, 20, 0.7, 0.5, 160, 12)


@_query(f"WITH {_SAMPLE} SELECT * FROM picked")
def sampled_patches(spark, d):
    """Windows around positives and boundaries with random offsets, redrawn until they hold enough."""
    return _sampled(spark, d)


@_query(f"""WITH RECURSIVE {_SAMPLE}, gray_ AS (SELECT img, y, x, gray AS v FROM feat), {edges_sql("gray_", 40, 120)},
ch AS ({_kernel_sql(stencil.ellipse(3), "max", "v", "gray_")}), cl AS ({_kernel_sql(stencil.ellipse(3), "min", "v", "gray_")}), thr AS (SELECT img, y, x, CASE WHEN ch.v - cl.v >= 200 THEN 1 ELSE 0 END AS v FROM ch JOIN cl USING (img, y, x)),
c1 AS ({_kernel_sql(stencil.ellipse(1), "max", "v", "thr")}), c2 AS ({_kernel_sql(stencil.ellipse(1), "min", "v", "c1")}), o1 AS ({_kernel_sql(stencil.ellipse(1), "min", "v", "c2")}), o2 AS ({_kernel_sql(stencil.ellipse(1), "max", "v", "o1")}),
chan AS (SELECT f.img, f.y, f.x, f.r, f.g, f.b, thr.v AS t, c2.v AS c, o2.v AS o, CASE WHEN e.x IS NULL THEN 0 ELSE 1 END AS e, mk.v AS m FROM feat f JOIN thr USING (img, y, x) JOIN c2 USING (img, y, x) JOIN o2 USING (img, y, x) JOIN mk USING (img, y, x) LEFT JOIN edge e USING (img, y, x)),
grid AS (SELECT patch, img, y0 + 8 + dy AS y, x0 + 8 + dx AS x, (dy * 3 + dx) % 5 + 1 AS k FROM picked, range(0, 24) AS a(dy), range(0, 24) AS c(dx))
SELECT patch, g.img, CAST(sum(k * coalesce(r, 255)) AS BIGINT) AS red, CAST(sum(k * coalesce(g, 255)) AS BIGINT) AS green, CAST(sum(k * coalesce(b, 255)) AS BIGINT) AS blue, CAST(sum(k * coalesce(t, 0)) AS BIGINT) AS thr, CAST(sum(k * coalesce(c, 0)) AS BIGINT) AS closed, CAST(sum(k * coalesce(o, 0)) AS BIGINT) AS opened, CAST(sum(k * coalesce(e, 0)) AS BIGINT) AS edge, CAST(sum(k * coalesce(m, 0)) AS BIGINT) AS mask FROM grid g LEFT JOIN chan USING (img, y, x) GROUP BY 1, 2""")
def patch_tensors(spark, d):
    """Seven input channels and the mask of sampled patches as packed rows; beyond the image white, no guides,
    kept."""
    import numpy as np
    import pyarrow as pa

    b = bands.mapped(raster.fine_bands(spark, d, "r", "g", "b", "a", rows=24), {"m": "uint8"}, _positive, ("a",), ("r", "g", "b"))
    guided = bands.guided(b.pick("r", "g", "b"), 200, 1)
    whole = Bands(guided.df.join(b.df.select("img", "band", "m"), ["img", "band"]).select("img", "band", "y0", "n", "width", *guided.planes, "m"), guided.planes | {"m": "uint8"}, b.rows)
    windows = _sampled(spark, d).select("patch", "img", (F.col("y0") + 8).alias("y0"), (F.col("x0") + 8).alias("x0"))
    fill = {"r": 1.0, "g": 1.0, "b": 1.0, "thr": 0.0, "closed": 0.0, "opened": 0.0, "edge": 0.0, "m": 0.0}
    made = patches.tensors(windows, whole, 24, fill, {"r": 255.0, "g": 255.0, "b": 255.0})
    names, dy, dx = ["red", "green", "blue", "thr", "closed", "opened", "edge", "mask"], *np.indices((24, 24))
    weight = ((dy * 3 + dx) % 5 + 1).astype(np.float64)

    def sums(batches):
        for batch in batches:
            data = [np.frombuffer(x.as_buffer(), np.float32).reshape(8, 24, 24) for x in batch.column(2)]
            total = np.array([(x * weight).sum(axis=(1, 2)) for x in data]).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.rint(total[:, k] * (255 if k < 3 else 1)).astype(np.int64)) for k in range(8)]], names=["patch", "img", *names])

    return made.select("patch", "img", "data").mapInArrow(sums, "patch bigint, img bigint, " + ", ".join(f"{n} bigint" for n in names))


_PAGED = f"""{BLOCK}, page AS (SELECT img, img // 3 AS chapter, img % 3 AS page, y, x, r FROM block WHERE x < 64 - 8 * (img % 3 % 2) AND y < 200 - 30 * (img % 4)),
psize AS (SELECT img, chapter, page, max(x) + 1 AS width, max(y) + 1 AS height FROM page GROUP BY 1, 2, 3),
goal AS (SELECT chapter, width AS target FROM (SELECT chapter, width, row_number() OVER (PARTITION BY chapter ORDER BY count(*) DESC, min(page)) AS k FROM psize GROUP BY 1, 2) WHERE k = 1),
plan AS (SELECT p.*, target, CASE WHEN width = target THEN height ELSE greatest(1, CAST(round_even(height * (target / width), 0) AS BIGINT)) END AS nh FROM psize p JOIN goal USING (chapter)),
laid AS (SELECT *, coalesce(sum(nh) OVER (PARTITION BY chapter ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM plan)"""


def _weights_sql(name: str, size: str, new: str) -> str:
    """CTEs up to {name} (img, o, p, k): whole-number weights of old places p for new places o."""
    return f"""{name}0 AS (SELECT img, {size} AS s, {new} AS n, {size} / CAST({new} AS DOUBLE) AS scale, greatest({size} / CAST({new} AS DOUBLE), 1.0::DOUBLE) AS wide, unnest(range(0, {new})) AS o FROM laid),
{name}1 AS (SELECT *, (o + 0.5::DOUBLE) * scale AS c FROM {name}0),
{name}2 AS (SELECT *, unnest(range(greatest(0, CAST(trunc(c - 3 * wide + 0.5::DOUBLE) AS BIGINT)), least(s, CAST(trunc(c + 3 * wide + 0.5::DOUBLE) AS BIGINT)))) AS p FROM {name}1),
{name}3 AS (SELECT *, (p - c + 0.5::DOUBLE) * (1 / wide) AS f FROM {name}2),
{name}4 AS (SELECT *, CASE WHEN f >= -3 AND f < 3 THEN CASE WHEN f = 0 THEN 1 ELSE sin(pi() * f) / (pi() * f) * sin(pi() * f / 3) / (pi() * f / 3) END ELSE 0 END AS w FROM {name}3),
{name} AS (SELECT img, o, p, CASE WHEN s = n THEN CASE WHEN o = p THEN 4194304 ELSE 0 END ELSE CAST(trunc(w / sum(w) OVER (PARTITION BY img, o) * 4194304 + CASE WHEN w < 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END) AS BIGINT) END AS k FROM {name}4)"""


_STRIP = f"""{_PAGED}, {_weights_sql("wx", "width", "target")}, {_weights_sql("wy", "height", "nh")},
hz AS (SELECT p.img, p.y, w.o AS x, greatest(0, least(255, CAST(floor((2097152 + sum(p.r * w.k)) / 4194304.0::DOUBLE) AS BIGINT))) AS v FROM page p JOIN wx w ON w.img = p.img AND w.p = p.x GROUP BY 1, 2, 3),
vt AS (SELECT h.img, w.o AS y, h.x, greatest(0, least(255, CAST(floor((2097152 + sum(h.v * w.k)) / 4194304.0::DOUBLE) AS BIGINT))) AS v FROM hz h JOIN wy w ON w.img = h.img AND w.p = h.y GROUP BY 1, 2, 3),
strip AS (SELECT l.chapter, CAST(l.top + v.y AS BIGINT) AS y, v.x, v.v FROM vt v JOIN laid l USING (img))"""


def _strips(spark: SparkSession, d: str) -> Bands:
    px = raster.block(spark, d).where((F.col("x") < 64 - 8 * (F.col("img") % 3 % 2)) & (F.col("y") < 200 - 30 * (F.col("img") % 4)))
    b = bands.pack(px, {"r": "uint8"}, 48)
    pages = bands.sizes(b).select("img", F.floor(F.col("img") / 3).alias("chapter"), (F.col("img") % 3).alias("page"), "width", "height")
    plan = layout.stack(pages.drop("img"), layout.target_widths(pages)).withColumn("img", F.col("chapter") * 3 + F.col("page"))
    return strips.stacked(b, plan, 100)


def _row_sums(b: Bands, plane: str, name: str) -> DataFrame:
    import numpy as np

    got = bands.each(b.pick(plane), "y bigint, w bigint, total bigint", lambda y0, p: {"y": y0 + np.arange(len(p[plane])), "w": np.full(len(p[plane]), p[plane].shape[1]), "total": (p[plane].astype(np.int64) * (np.arange(p[plane].shape[1]) + 1)).sum(axis=1)})
    return got.withColumnRenamed("img", name)


@_query(f"WITH {_STRIP} SELECT chapter, y, count(*) AS w, CAST(sum(v * (x + 1)) AS BIGINT) AS total FROM strip GROUP BY 1, 2")
def stacked_strips(spark, d):
    """L1, J11's LANCZOS, 3.3: pages resized and stacked, row by row of the strips."""
    return _row_sums(_strips(spark, d), "r", "chapter")


@_query(f"WITH {_STRIP}, part AS (SELECT chapter, CAST(y // 130 AS BIGINT) AS part, y % 130 AS y, x, v FROM strip) SELECT chapter, part, count(*) AS pixels, CAST(sum(v * (x + 1) * (y + 1)) AS BIGINT) AS total FROM part GROUP BY 1, 2")
def strip_parts(spark, d):
    """Strips cut into parts of a fixed height, with their pixels."""
    import numpy as np

    b = _strips(spark, d)
    tall = bands.sizes(b)
    cut = layout.chunks(tall, 130, "img", "width", start=0)
    number = F.col("img") * 1000 + F.col("part")
    moves = cut.select("img", number.alias("target"), F.col("y0").alias("from"), F.col("y1").alias("to"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("x"))
    parts = strips.moved(b, moves, cut.select(number.alias("target"), "width", (F.col("y1") - F.col("y0")).alias("height")), {"r": 0}, 64)

    def work(y0, p):
        y, x = np.indices(p["r"].shape)
        return {"n": [p["r"].size], "t": [int((p["r"].astype(np.int64) * (x + 1) * (y + y0 + 1)).sum())]}

    got = bands.each(parts, "n bigint, t bigint", work).groupBy("img").agg(F.sum("n").alias("pixels"), F.sum("t").alias("total"))
    return got.select(F.floor(F.col("img") / 1000).alias("chapter"), (F.col("img") % 1000).alias("part"), "pixels", "total")


@_query(f"WITH {_PAGED}, t AS (SELECT *, coalesce(sum(height) OVER (PARTITION BY chapter ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at, max(width) OVER (PARTITION BY chapter) AS widest FROM psize) SELECT t.chapter, CAST(t.at + p.y AS BIGINT) AS y, any_value(widest) AS w, CAST(sum((p.r - 255) * (p.x + 1 + (widest - width) // 2)) + any_value(255 * widest * (widest + 1) // 2) AS BIGINT) AS total FROM page p JOIN t USING (img) GROUP BY 1, 2")
def merged_parts(spark, d):
    """Parts of different widths centred in one strip, white beside them."""
    px = raster.block(spark, d).where((F.col("x") < 64 - 8 * (F.col("img") % 3 % 2)) & (F.col("y") < 200 - 30 * (F.col("img") % 4)))
    b = bands.pack(px, {"r": "uint8"}, 48)
    pages = bands.sizes(b).select(F.floor(F.col("img") / 3).alias("chapter"), (F.col("img") % 3).alias("page"), "width", "height")
    placed = layout.stack_centred(pages).join(pages, ["chapter", "page"])
    moves = placed.select((F.col("chapter") * 3 + F.col("page")).alias("img"), F.col("chapter").alias("target"), F.lit(0).cast("long").alias("from"), F.col("height").cast("long").alias("to"), F.col("y").alias("at"), "x")
    whole = pages.groupBy(F.col("chapter").alias("target")).agg(F.max("width").alias("width"), F.sum("height").alias("height"))
    return _row_sums(strips.moved(b, moves, whole, {"r": 255}, 90), "r", "chapter")


@_query(f"""WITH {FINE}, mk AS (SELECT img, y, x, CASE WHEN a < 8 THEN 1 ELSE 0 END AS v FROM fine),
col AS (SELECT p.img, p.y, p.x, q.v AS kind, min(abs(p.y - q.y)) AS g FROM mk p JOIN mk q ON q.img = p.img AND q.x = p.x GROUP BY 1, 2, 3, 4),
d2 AS (SELECT p.img, p.y, p.x, p.v, min((p.x - c.x) * (p.x - c.x) + c.g * c.g) AS d FROM mk p JOIN col c ON c.img = p.img AND c.y = p.y AND c.kind <> p.v GROUP BY 1, 2, 3, 4)
SELECT img, v, count(*) AS n, CAST(sum(d * (x + y + 1)) AS BIGINT) AS total, CAST(max(d) AS BIGINT) AS farthest FROM d2 GROUP BY 1, 2""")
def far_distances(spark, d):
    """J7 without a radius: squared distances to the other kind, however far it is."""
    import numpy as np

    b = bands.mapped(raster.fine_bands(spark, d, "a", rows=24), {"m": "uint8"}, lambda p: {"m": p["a"] < 8}, ("a",), ())

    def work(y0, p):
        square, (y, x) = np.rint(p["sdt"].astype(np.float64) ** 2).astype(np.int64), np.indices(p["m"].shape)
        sums = [(v, square[p["m"] == v], (x + y + y0 + 1)[p["m"] == v]) for v in (0, 1)]
        sums = [s for s in sums if len(s[1])]
        return {"v": np.array([v for v, _, _ in sums]), "n": np.array([len(q) for _, q, _ in sums]), "t": np.array([int((q * w).sum()) for _, q, w in sums]), "m": np.array([int(q.max()) for _, q, _ in sums])}

    parts = bands.each(bands.signed_distances(b, "m").pick("m", "sdt"), "v bigint, n bigint, t bigint, m bigint", work)
    return parts.groupBy("img", "v").agg(F.sum("n").alias("n"), F.sum("t").alias("total"), F.max("m").alias("farthest"))


@_query(f"""WITH {FINE} SELECT img, max(x) + 1 AS width, max(y) + 1 AS height, CASE WHEN img % 2 = 0 THEN 4 ELSE 3 END AS channels, CAST(sum(CASE WHEN img % 2 = 0 AND a < 128 THEN 255 ELSE r END * (x + 1)) AS BIGINT) AS red, CAST(sum(CASE WHEN img % 2 = 0 AND a < 128 THEN 0 ELSE g + 2 * b END * (y + 1)) AS BIGINT) AS rest, CAST(sum(CASE WHEN img % 2 = 0 THEN a ELSE 255 END) AS BIGINT) AS alpha FROM fine GROUP BY img""")
def stored_pictures(spark, d):
    """Rasters written as PNG files, with alpha and without, found again by name, sized
    by their heads, and decoded band by band; deleted pixels red."""
    import numpy as np

    b, folder = _fine(spark, d, "r", "g", "b", "a"), new_path(spark, "pictures")
    folder = folder if "://" in folder else f"file://{folder}"
    tall = bands.sizes(b)
    for left, planes in ((0, "rgba"), (1, "rgb")):
        some = Bands(b.df.where(F.col("img") % 2 == left), b.planes, b.rows)
        sinks.write_png(sinks.interleaved(some, tall, *planes), f"{folder}/{left}").collect()
    number = F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("long")
    sized = images.sizes(spark, folder).select(number.alias("img"), "width", "height", "channels")

    def work(y0, p):
        gone, (y, x) = p["a"] < 128, np.indices(p["a"].shape)
        red, rest = np.where(gone, 255, p["r"]).astype(np.int64), np.where(gone, 0, p["g"].astype(np.int64) + 2 * p["b"].astype(np.int64))
        return {"red": [int((red * (x + 1)).sum())], "rest": [int((rest * (y + y0 + 1)).sum())], "alpha": [int(p["a"].astype(np.int64).sum())]}

    sums = bands.each(images.png_bands(spark, folder, 20), "red bigint, rest bigint, alpha bigint", work).withColumnRenamed("img", "path")
    sums = sums.groupBy(number.alias("img")).agg(*[F.sum(c).alias(c) for c in ("red", "rest", "alpha")])
    return sized.join(sums, "img")


@_query("SELECT label, 'unet' AS model_type, count(*) / 1000.0::DOUBLE AS threshold, CASE WHEN label % 2 = 0 THEN 4 ELSE 0 END AS sdt_clamp_radius, label % 2 = 0 AS sdt_head FROM embeddings GROUP BY label")
def model_configs(spark, d):
    """A configuration file for each label, read back with defaults for what the older form lacks."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").groupBy("label").agg((F.count("*") / 1000).alias("threshold"))
    new = F.col("label") % 2 == 0
    said = F.to_json(F.struct(F.col("label").alias("patch_size"), F.lit("unet").alias("model_type"), "threshold", F.when(new, True).alias("sdt_head"), F.when(new, 4).alias("sdt_clamp_radius")))
    folder = new_path(spark, "configs")
    rows.select(said.alias("value")).repartition("value").write.text(folder)
    return images.model_configs(spark, folder, MODEL_CONFIG, False).select(F.col("patch_size").alias("label"), "model_type", "threshold", "sdt_clamp_radius", "sdt_head")


@_query(f"""WITH {FINE}, m AS (SELECT img, a < 16 AS d, a < 16 AND (gray < 180 OR sat > 45) AS dm, NOT (a < 16) AND gray >= 120 AND gray <= 245 AND sat <= 35 AS l FROM feat WHERE x < 61 AND y < 57),
s AS (SELECT img, count(*) AS total_pixels, count(*) FILTER (d) AS deleted_pixels, count(*) FILTER (dm) AS damaged_pixels, count(*) FILTER (l) AS leftover_grayline_pixels FROM m GROUP BY img),
p AS (SELECT *, CASE WHEN deleted_pixels > 0 THEN damaged_pixels / deleted_pixels * 100.0::DOUBLE ELSE 0 END AS dd, damaged_pixels / total_pixels * 100.0::DOUBLE AS dt, leftover_grayline_pixels / total_pixels * 100.0::DOUBLE AS lt FROM s)
SELECT img, row_number() OVER (ORDER BY dd + dt * 0.5 + lt * 5 DESC, img) AS rank, total_pixels, deleted_pixels, damaged_pixels, leftover_grayline_pixels, round(dd + dt * 0.5 + lt * 5, 6) AS priority_score FROM p""")
def stored_pairs(spark, d):
    """Originals and smaller results stored bucketed by image and band, met without an exchange and scored."""
    px, name = raster.fine(spark, d), new_path(spark, "pairs")
    tag = "t" + name.rsplit("-", 1)[1]
    stored.store(raster.fine_bands(spark, d, "r", "g", "b", rows=24), f"{tag}_originals", 8, f"{name}/originals")
    stored.store(bands.pack(px.where("x < 61 AND y < 57"), {"a": "uint8"}, 24), f"{tag}_results", 8, f"{name}/results")
    got = stored.scored_pairs(stored.stored(spark, f"{tag}_originals", dict.fromkeys("rgb", "uint8"), 24), stored.stored(spark, f"{tag}_results", {"a": "uint8"}, 24))
    return got.select("img", "rank", "total_pixels", "deleted_pixels", "damaged_pixels", "leftover_grayline_pixels", "priority_score")


@_query(f"""WITH RECURSIVE {_POST}, c AS (SELECT p.img, p.idx, b.x, b.y - p.y0 AS y, b.r FROM post p JOIN block b ON b.img = p.img AND b.y >= p.y0 AND b.y < p.y1)
SELECT img || '-' || lpad(CAST(idx AS VARCHAR), 3, '0') || CASE WHEN cleaned THEN '_cleaned' ELSE '' END AS name, max(x) + 1 AS width, max(y) + 1 AS height, CASE WHEN cleaned THEN 4 ELSE 3 END AS channels, CAST(sum(r * (x + 1) + r // 2 * (y + 1)) AS BIGINT) AS total, CAST(sum(CASE WHEN NOT cleaned OR r >= 150 THEN 255 ELSE 0 END) AS BIGINT) AS alpha FROM c, (VALUES (false), (true)) AS k(cleaned) GROUP BY img, idx, cleaned""")
def written_crops(spark, d):
    """What each segment cuts out of a strip and of its cleaned form, written as pairs of pictures and
    found again by name."""
    import numpy as np

    folder = new_path(spark, "crops")
    folder = folder if "://" in folder else f"file://{folder}"
    b = bands.mapped(_block(spark, d), dict.fromkeys("gba", "uint8"), lambda p: {"g": p["r"] // 2, "b": p["r"], "a": np.where(p["r"] >= 150, 255, 0)}, ("r",), ("r",))
    found = post_merge(spark, d).select("img", "y0", "y1", F.concat(F.col("img").cast("string"), F.lit("-"), F.lpad(F.col("idx").cast("string"), 3, "0")).alias("target"))
    moves = found.select("img", "target", F.col("y0").alias("from"), F.col("y1").alias("to"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("x"))
    sized = found.join(bands.sizes(b).select("img", "width"), "img").select("target", "width", (F.col("y1") - F.col("y0")).alias("height"))
    crops = strips.moved(b, moves, sized, dict.fromkeys("rgba", 0), 48).settled("crops")
    tall = bands.sizes(crops)
    sinks.write_png(sinks.interleaved(crops, tall, *"rgb"), folder).collect()
    cleaned = sinks.interleaved(crops, tall, *"rgba").withColumn("name", F.concat("name", F.lit("_cleaned")))
    sinks.write_png(cleaned, folder).collect()

    def work(y0, p):
        y, x = np.indices(p["r"].shape)
        r, g = p["r"].astype(np.int64), p["g"].astype(np.int64)
        return {"total": [int((r * (x + 1) + g * (y + y0 + 1)).sum())], "alpha": [int(p["a"].astype(np.int64).sum())]}

    name = F.regexp_extract("path", r"([^/]*)\.png$", 1).alias("name")
    sums = bands.each(images.png_bands(spark, folder, 40), "total bigint, alpha bigint", work).withColumnRenamed("img", "path").groupBy(name).agg(F.sum("total").alias("total"), F.sum("alpha").alias("alpha"))
    return images.sizes(spark, folder).select(name, "width", "height", "channels").join(sums, "name")
