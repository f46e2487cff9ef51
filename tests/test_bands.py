import numpy as np
import pytest
from pyspark.sql import functions as F

from tallstrip.operators import bands, kernels, stencil, topology
from tallstrip.operators.bands import pack, running, spread, unpack
from tallstrip.plans import pipelines
from tallstrip.sources import raster
from tallstrip.work import settle

from .test_operators import array, brute_spread, frames, table


def several(spark, shapes, seed=0, planes=("v",), most=256):
    rng, rows, out = np.random.default_rng(seed), [], []
    for img, shape in enumerate(shapes):
        a = {p: rng.integers(0, most, shape) for p in planes}
        out.append(a)
        rows += [(img, y, x, *[int(a[p][y, x]) for p in planes]) for y in range(shape[0]) for x in range(shape[1])]
    return spark.createDataFrame(rows, "img bigint, y int, x int, " + ", ".join(f"{p} int" for p in planes)), out


def plane(b, name, img, shape):
    return array(unpack(b.pick(name)).where(F.col("img") == img), name, shape)


@pytest.mark.parametrize("half", [0, 1, 2, 5, 40])
def test_running_extremes(half):
    a = np.random.default_rng(half).integers(0, 256, (6, 23)).astype(np.uint8)
    for axis, size in ((0, 6), (1, 23)):
        for pick in (np.maximum, np.minimum):
            got = np.moveaxis(running(a, half, pick, axis), axis, 0)
            for i in range(size):
                assert (got[i] == pick.reduce(np.moveaxis(a, axis, 0)[max(0, i - half) : i + half + 1], axis=0)).all()


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 7, 12])
def test_kernels_of_rectangles(radius):
    a = np.random.default_rng(radius).integers(0, 256, (17, 19)).astype(np.uint8)
    for kernel in (stencil.ellipse(radius), stencil.square(radius)):
        assert (spread(a, kernel, np.maximum) == brute_spread(a, kernel, max)).all()
        assert (spread(a, kernel, np.minimum) == brute_spread(a, kernel, min)).all()


@pytest.mark.parametrize("rows", [2, 5, 64])
def test_bands_and_windows_agree(spark, rows):
    """Bands lower than the halo, too: rows then come from several bands away."""
    shapes = [(31, 13), (1, 7), (12, 1)]
    px, _ = several(spark, shapes)
    mask = px.withColumn("v", F.when(F.col("v") >= 128, 1).otherwise(0))
    b, m = pack(px, {"v": "uint8"}, rows), pack(mask, {"v": "uint8"}, rows)
    pairs = [
        (bands.dilate(b, "v", "o", stencil.ellipse(3)), stencil.dilate(px, "v", "o", stencil.ellipse(3))),
        (bands.erode(b, "v", "o", stencil.ellipse(3)), stencil.erode(px, "v", "o", stencil.ellipse(3))),
        (bands.gradient(b, "v", "o", stencil.square(2)), stencil.gradient(px, "v", "o", stencil.square(2))),
        (bands.postprocess(m, "v", 2, 1), stencil.postprocess(mask, "v", 2, 1)),
        (bands.boundary_weight(m, "v", 3, 4.0), stencil.boundary_weight(mask, "v", 3, 4.0)),
    ]
    for got, want in pairs:
        name = got.df.columns[-1]
        for img, shape in enumerate(shapes):
            assert (plane(got, name, img, shape) == array(want.where(F.col("img") == img), name, shape)).all()
    gray = px.withColumn("d", F.col("v") % 2)
    got = bands.protect_borders(pack(gray, {"v": "uint8", "d": "uint8"}, rows), "d", "v", 3, 60)
    want = stencil.protect_borders(gray, "d", "v", 3, 60)
    for img, shape in enumerate(shapes):
        assert (plane(got, "d", img, shape) == array(want.where(F.col("img") == img), "d", shape)).all()


def test_runs_and_paint(spark):
    px, arrays = several(spark, [(23, 9), (4, 30)], 3)
    b = pack(px, {"v": "uint8"}, 5)
    found = bands.runs(b, lambda p: p["v"] >= 128, ("v",))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, raster.runs(px, F.col("v") >= 128).collect()))
    painted = bands.paint(b, found.where("img = 0"), "on")
    assert (plane(painted, "on", 0, (23, 9)) == (arrays[0]["v"] >= 128)).all() and not plane(painted, "on", 1, (4, 30)).any()
    kernel = stencil.ellipse(2)
    small = bands.eroded_runs(bands.runs(b, lambda p: p["v"] >= 40, ("v",)), kernel, "img")
    inside = np.pad((arrays[0]["v"] >= 40).astype(int), 2)
    want = brute_spread(inside, kernel, min)[2:-2, 2:-2]
    assert {(r.y, r.x) for r in raster.pixels_of(small.where("img = 0")).collect()} == {(int(y), int(x)) for y, x in np.argwhere(want == 1)}


@pytest.mark.parametrize("rows", [4, 7, 64])
def test_edges_and_scores_do_not_depend_on_bands(spark, rows):
    px, _ = several(spark, [(30, 17), (9, 40)], 4, ("r", "g", "b", "a"))
    px = px.withColumn("g", (F.col("r") + F.col("g") % 20) % 256).withColumn("b", F.col("r"))
    b = pack(px, {p: "uint8" for p in "rgba"}, rows)
    for with_edges in (False, True):
        got = pipelines.evaluate_bands(b, with_edges).orderBy("img").collect()
        want = pipelines.evaluate(px, "img", with_edges=with_edges).orderBy("img").collect()
        assert [r.asDict() for r in got] == [r.asDict() for r in want]


@pytest.mark.parametrize("rows, tile, overlap", [(5, 8, 2), (16, 8, 6), (64, 16, 4), (3, 40, 10)])
def test_overlapping_tiles_are_weighed(spark, rows, tile, overlap):
    shapes = [(37, 21), (8, 8), (9, 3)]
    px, _ = several(spark, shapes, 5)
    sizes = spark.createDataFrame([(i, w, h) for i, (h, w) in enumerate(shapes)], "img bigint, width int, height int")
    want = kernels.predict(px, "v", sizes, kernels.PlacedScorer(), tile, overlap)
    got = bands.predict(pack(px, {"v": "uint8"}, rows), "v", kernels.PlacedScorer(), {"p": "float64"}, lambda s: {"p": s}, tile, overlap)
    for img, shape in enumerate(shapes):
        assert np.allclose(plane(got, "p", img, shape), array(want.where(F.col("img") == img), "p", shape), rtol=1e-12)


def test_strips_are_cleaned_alike(spark):
    dark, delete, _, _ = frames()
    gray = np.where(delete == 1, np.where(dark == 0, 0, 200), dark)[:200]
    noise = np.random.default_rng(7).integers(0, 50, gray.shape)
    px = table(spark, np.clip(gray - noise, 0, 255), "r").withColumn("g", F.col("r")).withColumn("b", F.col("r"))
    sizes = px.groupBy("img").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    for p in (pipelines.CleanParams(tile=48, overlap=16, least_interior=900, scorer=kernels.PlacedScorer(), open_radius=1), pipelines.CleanParams(tile=64, overlap=8, frames=False, border_band=0, close_radius=0)):
        want = pipelines.clean(px, sizes, 0.5, p)
        got = pipelines.clean_bands(pack(px, {c: "uint8" for c in "rgb"}, 32), 0.5, p)
        assert (plane(got, "delete", 0, gray.shape) == array(want, "delete", gray.shape)).all()


def test_no_pixel_moves(spark):
    """Between the stored bands and the scores only bands, runs and counts are exchanged."""
    px, _ = several(spark, [(30, 17)], 6, ("r", "g", "b", "a"))
    stored = pack(px, {p: "uint8" for p in "rgba"}, 8).settled("bands")
    plan = bands.score_counts(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
    closed = bands.postprocess(bands.mapped(stored, {"m": "uint8"}, lambda p: {"m": p["r"] > 99}, ("r",), ()), "m", 3, 2)
    assert closed.df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert topology.label(bands.runs(stored, lambda p: p["r"] > 99, ("r",)), 8, 8).count() > 0


def test_envelopes_are_least_parabolas():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 400, (30, 25)).astype(float)
    a[rng.random(a.shape) < 0.6] = np.inf
    a[4] = np.inf
    x = np.arange(25)
    want = np.min((x[None, :, None] - x[None, None, :]) ** 2 + a[:, None, :], axis=2)
    assert (bands.envelopes(a) == want).all()


@pytest.mark.parametrize("rows", [1, 4, 9, 64])
def test_distances_at_any_radius(spark, rows):
    shapes = [(33, 12), (6, 20), (8, 8)]
    px, arrays = several(spark, shapes, 8, ("v",), 100)
    masks = [(a["v"] < 3).astype(int) for a in arrays]
    masks[2][:] = 1
    data = [(k, y, x, int(m[y, x])) for k, m in enumerate(masks) for y in range(m.shape[0]) for x in range(m.shape[1])]
    b = pack(spark.createDataFrame(data, "img bigint, y int, x int, m int"), {"m": "uint8"}, rows)
    whole, clamped = bands.signed_distances(b, "m"), bands.signed_distances(b, "m", 3.0)
    for k, m in enumerate(masks):
        want = np.full(m.shape, np.inf)
        for y, x in np.ndindex(m.shape):
            other = np.argwhere(m != m[y, x])
            if len(other):
                want[y, x] = np.hypot(*(other - (y, x)).T).min()
        want = np.where(m > 0, -want, want)
        assert np.allclose(plane(whole, "sdt", k, m.shape), want)
        assert np.allclose(plane(clamped, "sdt", k, m.shape), np.clip(want, -3, 3) / 3)


def test_stored_pairs_meet_where_they_lie(spark, tmp_path):
    from tallstrip.operators import stored

    px, _ = several(spark, [(30, 17), (9, 40)], 9, ("r", "g", "b", "a"))
    kinds = {"o": dict.fromkeys("rgb", "uint8"), "r": {"a": "uint8"}}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, rows in (("o", px), ("r", px.where("y < 25 AND x < 33"))):
            stored.store(pack(rows, kinds[name], 8), f"pairs_{name}", 4, f"file://{tmp_path}/{name}")
        originals, results = (stored.stored(spark, f"pairs_{n}", kinds[n], 8) for n in "or")
        joined = originals.df.join(results.df.select("img", "band", "a"), ["img", "band"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        got = stored.scored_pairs(originals, results).orderBy("img").collect()
        want = pipelines.evaluate(px.where("y < 25 AND x < 33"), "img").orderBy("img").collect()
        assert [r.asDict() for r in got] == [r.asDict() for r in want]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for n in "or":
            spark.sql(f"DROP TABLE IF EXISTS pairs_{n}")


def flooded(a, low, high):
    """Edge pixels of a picture by walking from the strong candidates."""
    strength = kernels.edge_candidates(a.astype(np.float64))
    seen = {(int(y), int(x)) for y, x in np.argwhere(strength > high)}
    todo = list(seen)
    while todo:
        y, x = todo.pop()
        near = {(v, u) for v in range(max(0, y - 1), min(len(a), y + 2)) for u in range(max(0, x - 1), min(a.shape[1], x + 2)) if strength[v, u] > low}
        todo += near - seen
        seen |= near
    return seen


@pytest.mark.parametrize("rows", [1, 2, 7, 64])
def test_edges_leave_bands_by_their_rims_only(spark, monkeypatch, rows):
    shapes, low, high = [(31, 23), (1, 9), (14, 1), (28, 17)], 250, 760
    px, images = several(spark, shapes, 3)
    px = px.unionByName(spark.createDataFrame([(9, y, x, 5) for y in range(9) for x in range(4)], px.schema))  # no edges at all
    written = []

    def kept(df, tag="step"):
        out = settle(df, tag)
        written.extend(out.select("img", "y", "x0", "x1").distinct().collect() if "x0" in out.columns else [])
        return out

    for module in (bands, topology):
        monkeypatch.setattr(module, "settle", kept)
    b = pack(px, {"v": "uint8"}, rows)
    marked = unpack(bands.edges(b, "v", low, high)).where("edge = 1").select("img", "y", "x").collect()
    want = {(i, y, x) for i, a in enumerate(images) for y, x in flooded(a["v"], low, high)}
    strong = {(i, int(y), int(x)) for i, a in enumerate(images) for y, x in np.argwhere(kernels.edge_candidates(a["v"].astype(np.float64)) > high)}
    assert sorted((r.img, r.y, r.x) for r in marked) == sorted(want) and strong < want
    heights = [shape[0] for shape in shapes]
    assert written and all(r.y % rows in (0, rows - 1) or r.y == heights[r.img] - 1 for r in written)
    alone = bands.edge_plane(b, "v", low, high)
    assert list(alone.planes) == ["edge"] and {(r.img, r.y, r.x) for r in raster.pixels_of(bands.runs(alone, lambda p: p["edge"] > 0, ("edge",))).collect()} == want
