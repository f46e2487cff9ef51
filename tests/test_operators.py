import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallstrip.functions import names, scalars
from tallstrip.operators import kernels, layout, masks, metrics, sampling, segment, stencil, topology
from tallstrip.plans import pipelines
from tallstrip.sources import raster


def table(spark, a, name="v"):
    y, x = np.indices(a.shape)
    return spark.createDataFrame([(0, int(i), int(j), int(v)) for i, j, v in zip(y.ravel(), x.ravel(), a.ravel(), strict=True)], f"img bigint, y int, x int, {name} int")


def array(df, name, shape):
    out = np.zeros(shape)
    for r in df.select("y", "x", name).collect():
        out[r[0], r[1]] = r[2]
    return out


def frames():
    """Half-size frames: a closed one, a filled block, one with a gap, and a closed one that touches a block."""
    dark, delete = np.full((450, 300), 255), np.zeros((450, 300), int)

    def outline(x0, y0, x1, y1, t=2):
        dark[y0 : y0 + t, x0:x1] = dark[y1 - t : y1, x0:x1] = 0
        dark[y0:y1, x0 : x0 + t] = dark[y0:y1, x1 - t : x1] = 0

    outline(25, 25, 275, 125)
    dark[150:225, 25:275] = 0
    outline(25, 250, 275, 320)
    dark[250:253, 125:145] = 255
    outline(25, 340, 175, 425)
    dark[380:400, 170:220] = 0
    inside = [(50, 70, 50, 100), (90, 110, 200, 250), (360, 400, 50, 150)]
    outside = [(160, 215, 40, 260), (270, 295, 50, 100), (435, 447, 25, 275)]
    for a, b, c, d in inside + outside:
        delete[a:b, c:d] = 1
    return dark, delete, inside, outside


def test_frames_are_repaired_and_nothing_else(spark):
    dark, delete, inside, outside = frames()
    px = table(spark, dark, "gray").join(table(spark, delete, "delete"), ["img", "y", "x"])
    p = pipelines.CleanParams(darkness=40, least_interior=2500, inset=1)
    after = array(pipelines.repair_frames(px, "delete", p), "delete", dark.shape)
    assert (after <= delete).all()
    for a, b, c, d in inside:
        assert not after[a:b, c:d].any()
    for a, b, c, d in outside:
        assert after[a:b, c:d].all()


@pytest.mark.parametrize("band", [3, 7, 64])
def test_components_do_not_depend_on_bands(spark, band):
    rng = np.random.default_rng(1)
    a = (rng.random((40, 23)) < 0.55).astype(int)
    runs = raster.runs(table(spark, a), F.col("v") == 1)
    for connectivity in (4, 8):
        label = -np.ones(a.shape, int)
        count = 0
        for sy, sx in np.argwhere(a == 1):
            if label[sy, sx] < 0:
                label[sy, sx], todo = count, [(sy, sx)]
                while todo:
                    y, x = todo.pop()
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            v, u = y + dy, x + dx
                            if (connectivity == 8 or not dy or not dx) and 0 <= v < 40 and 0 <= u < 23 and a[v, u] and label[v, u] < 0:
                                label[v, u] = count
                                todo.append((v, u))
                count += 1
        found = topology.component_stats(topology.label(runs, connectivity, band)).collect()
        assert sorted(r.area for r in found) == sorted(np.bincount(label[label >= 0]).tolist())


def test_islands_only_turn_back_what_is_landlocked(spark):
    a = np.zeros((12, 12), int)
    a[0:3, 0:3] = a[5:8, 5:8] = a[11, 4:9] = 1
    px = table(spark, a)
    sizes = spark.createDataFrame([(0, 12, 12)], "img bigint, width int, height int")
    left = raster.pixels_of(topology.reclaim_islands(px, F.col("v") == 1, sizes)).collect()
    assert {(r.y, r.x) for r in left} == {(int(y), int(x)) for y, x in np.argwhere(a == 1) if not (5 <= y < 8 and 5 <= x < 8)}


def brute_spread(a, kernel, pick):
    out = a.copy()
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            out[y, x] = pick(a[y + dy, x + dx] for dy, h in kernel.items() for dx in range(-h, h + 1) if 0 <= y + dy < a.shape[0] and 0 <= x + dx < a.shape[1])
    return out


def test_stencils(spark):
    a = np.random.default_rng(0).integers(0, 255, (14, 11))
    for radius in (1, 2, 3):
        k = stencil.ellipse(radius)
        assert (array(stencil.dilate(table(spark, a), "v", "o", k), "o", a.shape) == brute_spread(a, k, max)).all()
        assert (array(stencil.erode(table(spark, a), "v", "o", k), "o", a.shape) == brute_spread(a, k, min)).all()
    assert stencil.ellipse(2) == {-2: 0, -1: 2, 0: 2, 1: 2, 2: 0} and list(stencil.ellipse(3).values()) == [0, 2, 3, 3, 3, 2, 0]


def test_kernels_do_not_depend_on_bands(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 255, (30, 17))
    mask = (a > 180).astype(int)
    want = np.full(a.shape, 4.0)
    for y, x in np.ndindex(a.shape):
        for v, u in np.ndindex(a.shape):
            if mask[v, u] != mask[y, x]:
                want[y, x] = min(want[y, x], np.hypot(v - y, u - x))
    want = np.where(mask > 0, -want, want) / 4
    for rows in (5, 64):
        got = array(kernels.in_bands(table(spark, mask), "v", "o", kernels.signed_distance(4), 4, rows), "o", a.shape)
        assert np.allclose(got, want)
    step = np.repeat([[20], [220]], [15, 15], axis=0) * np.ones((1, 17), int)
    marks = [{(r.y, r.x) for r in kernels.edges(table(spark, step), "v", 50, 150, rows).collect()} for rows in (4, 64)]
    assert marks[0] == marks[1] and len({y for y, _ in marks[0]}) == 1 and len(marks[0]) == 17
    guide = kernels.guidance(table(spark, a), "v", 30, 1)
    mask3 = (brute_spread(a, stencil.ellipse(3), max) - brute_spread(a, stencil.ellipse(3), min) >= 30).astype(int)
    assert (array(guide, "thr", a.shape) == mask3).all()


def test_scores_of_tiles_are_the_scorer_s(spark):
    a = np.random.default_rng(2).integers(0, 255, (40, 30))
    sizes = spark.createDataFrame([(0, 30, 40)], "img bigint, width int, height int")
    got = array(kernels.predict(table(spark, a), "v", sizes, kernels.ThresholdScorer(), 16, 4), "p", a.shape)
    assert np.allclose(got, kernels.ThresholdScorer()(a.astype(float)))


def test_cleaning_only_keeps_more_after_scoring(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 255, (32, 32))
    px = table(spark, a, "r").withColumn("g", F.col("r")).withColumn("b", F.col("r"))
    sizes = spark.createDataFrame([(0, 32, 32)], "img bigint, width int, height int")
    first = pipelines.CleanParams(tile=16, overlap=4, close_radius=0, islands=False, border_band=0, frames=False)
    every = pipelines.CleanParams(tile=16, overlap=4, close_radius=0, least_interior=4)
    before, after = (array(pipelines.clean(px, sizes, 0.5, p), "delete", a.shape) for p in (first, every))
    assert (after <= before).all()
    assert (before == (a >= 128)).all()


def test_chapter_lists(spark):
    rows = spark.createDataFrame([(1, "3-12, 3"), (2, "3 - 5"), (3, "005-003,a.b.png"), (4, ""), (5, "7-7 7")], "k int, v string")
    got = {}
    for r in names.chapter_list(rows, "v", "k").orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append(r.chapter)
    assert got == {1: [f"{i:02d}" for i in range(3, 13)] + ["3"], 2: ["3", "-", "5"], 3: ["005", "004", "003", "a.b"], 5: ["7"]}


def test_geometry_rounds_halves_to_even(spark):
    row = spark.range(1).select(scalars.scaled_height(F.lit(100), F.lit(5), F.lit(50)).alias("a"), scalars.scaled_height(F.lit(100), F.lit(7), F.lit(50)).alias("b"), scalars.auto_centers(F.lit(120), F.lit(3)).alias("c"), scalars.auto_centers(F.lit(7), F.lit(1)).alias("d"), scalars.positive_weight(F.lit(0.0)).alias("e")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (2, 4, [10, 60, 110], [3], 4.0)


def test_sizes_must_agree(spark):
    rows = spark.createDataFrame([("a", 3, 4), ("a", 3, 5)], "k string, width int, height int")
    with pytest.raises(Exception, match="different sizes"):
        masks.require_one_size(rows, "k").collect()
    with pytest.raises(ValueError):
        layout.target_widths(rows, fixed=0)


def test_draws_spread_evenly(spark):
    d = [r.d for r in spark.range(5000).select(sampling.draw(F.col("id"), 7).alias("d")).collect()]
    assert 0.45 < np.mean(d) < 0.55 and min(d) >= 0 and max(d) < 1
    px = table(spark, np.full((4, 4), 100), "r").withColumn("g", F.col("r")).withColumn("b", F.col("r"))
    assert sampling.augment(px, width=4).count() == 16


def test_reasons_degrade_on_a_second_merge(spark):
    rows = spark.createDataFrame([(0, 0, 950, segment.OVERSIZED), (0, 960, 1000, "safe"), (0, 1010, 1050, "safe")], "img bigint, y0 int, y1 int, reason string")
    got = segment.post_merge(rows).collect()
    assert [(r.y0, r.y1, r.reason) for r in got] == [(0, 1050, segment.MERGED)]


def test_no_deletion_is_no_damage(spark):
    px = table(spark, np.full((2, 2), 250), "r").withColumns({"g": F.col("r"), "b": F.col("r"), "a": F.lit(255)})
    row = metrics.ranked(metrics.score(px, "img"), "img").first()
    assert (row.damage_percent_deleted, row.estimated_success_percent, row["rank"]) == (0.0, 100.0, 1)


def test_numbers_follow_the_order_over_partitions(spark):
    from pyspark.sql import functions as F

    from tallstrip.operators.ranking import numbered

    for size in (5000, 12_000):
        rows = spark.range(size).select(((F.col("id") * 7919) % 1000).alias("v"), "id")
        got = numbered(rows, "rank", F.desc("v"), "id").orderBy("rank").collect()
        assert [r["rank"] for r in got] == list(range(1, size + 1))
        assert [(r.v, r.id) for r in got] == sorted(((r.v, r.id) for r in got), key=lambda x: (-x[0], x[1]))
    assert numbered(rows.where("id < 0"), "rank", "v").count() == 0


def test_numbers_of_any_length_in_names(spark):
    from pyspark.sql import functions as F

    from tallstrip.functions.names import natural_key

    names = ["p2", "p10", "p" + "9" * 20, "p1" + "0" * 20, "p2" + "0" * 20, "p1" + "0" * 40, "p007"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n"))).collect()
    assert [r.n for r in got] == sorted(names, key=lambda n: int(n[1:]))


def test_no_forced_split_without_a_height(spark):
    from tallstrip.operators import segment

    rows = spark.createDataFrame([(1, 0, 0, 5000, 5000, "safe")], "img bigint, idx int, y0 int, y1 int, height int, reason string")
    assert segment.forced_split(rows, 0).collect() == rows.collect()


def test_the_work_folder_is_shared_or_local():
    from types import SimpleNamespace

    import pytest

    from tallstrip.work import work_folder

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError):
        work_folder(cluster)


def test_targets_on_a_point_belong_to_it(spark):
    """Seven strides of 562 / 14 are 281, but 281 / (562 / 14) is below 7."""
    points = spark.createDataFrame([(1, i, float(x), 0.0) for i, x in enumerate((0, 281, 100))], "id bigint, ord bigint, x double, y double")
    got = {r.k: r.x for r in layout.resampled(points, 40.0, "id").collect()}
    assert got == {0: 0.0} | dict.fromkeys(range(1, 8), 281.0) | dict.fromkeys(range(8, 14), 100.0)


def stays(frame):
    """Whether nothing moves or is looked up."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return "Exchange" not in plan and "Join" not in plan


def holed(images, height, width):
    """Pixels (img, y, x, r), every seventh missing."""
    return [(i, y, x, (i * 31 + y * width + x) % 251) for i in range(images) for y in range(height) for x in range(width) if (i + y * width + x) % 7]


@pytest.mark.parametrize("most", [1.0, 1.5, 4.0])
def test_images_are_enlarged_where_they_are(spark, most):
    rows = holed(6, 9, 14)
    got = sampling.zoomed(spark.createDataFrame([*rows, (None, 0, 0, 1)], "img bigint, y int, x int, r int"), 14, 9, most)
    want, old = [], {r[:3]: r[3] for r in rows}
    for img in range(6):
        d = (((img + 7) % 2147483647 * 48271 + 11) % 2147483647 * 48271 + 7) % 2147483647 / 2147483647
        back = lambda n, size, factor=1 + (most - 1) * d: math.floor((n + 0.5 - size / 2) / factor + size / 2)
        want += [(img, y, x, old[img, back(y, 9), back(x, 14)]) for y in range(9) for x in range(14) if (img, back(y, 9), back(x, 14)) in old]
    assert sorted(tuple(r) for r in got.select("img", "y", "x", "r").collect()) == want
    assert stays(got)


@pytest.mark.parametrize("height, width", [(9, 14), (4, 3), (1, 1), (23, 40), (18, 14)])
def test_images_are_resized_where_they_are(spark, height, width):
    rows = holed(3, 9, 14)
    got = stencil.nearest(spark.createDataFrame([*rows, (None, 0, 0, 1), (0, 9, 0, 1), (0, 0, 14, 1)], "img bigint, y int, x int, r int"), 14, 9, width, height)
    old = {r[:3]: r[3] for r in rows}
    want = [(i, y, x, old[i, y * 9 // height, x * 14 // width]) for i in range(3) for y in range(height) for x in range(width) if (i, y * 9 // height, x * 14 // width) in old]
    assert sorted(tuple(r) for r in got.select("img", "y", "x", "r").collect()) == want
    assert stays(got)
