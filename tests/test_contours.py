import numpy as np
import pytest
from pyspark.sql import functions as F

from tallstrip.operators import contours
from tallstrip.operators.bands import pack

#: Neighbours against the clock, as seen on the screen, from the east.
AROUND = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]


def followed(a):
    """Borders followed one after another in reading order: pixels that begin an outer border or a hole's, then neighbours
    against the clock."""
    f = np.pad(a.astype(int), 1)
    number, out = 1, []
    for i in range(1, f.shape[0] - 1):
        for j in range(1, f.shape[1] - 1):
            if f[i, j] == 1 and f[i, j - 1] == 0:
                start, hole = (i, j - 1), False
            elif f[i, j] >= 1 and f[i, j + 1] == 0:
                start, hole = (i, j + 1), True
            else:
                continue
            number += 1
            k = AROUND.index((start[0] - i, start[1] - j))
            for s in range(8):
                dy, dx = AROUND[(k - s) % 8]
                if f[i + dy, j + dx]:
                    last = (i + dy, j + dx)
                    break
            else:
                f[i, j] = -number
                out.append((hole, [(i - 1, j - 1)]))
                continue
            points, before, at = [], last, (i, j)
            while True:
                points.append((at[0] - 1, at[1] - 1))
                k, east = AROUND.index((before[0] - at[0], before[1] - at[1])), False
                for s in range(1, 9):
                    dy, dx = AROUND[(k + s) % 8]
                    if f[at[0] + dy, at[1] + dx]:
                        following = (at[0] + dy, at[1] + dx)
                        break
                    east |= (dy, dx) == (0, 1)
                if east:
                    f[at] = -number
                elif f[at] == 1:
                    f[at] = number
                if following == (i, j) and at == last:
                    break
                before, at = at, following
            out.append((hole, points))
    return out


def sampled(points, stride):
    """Evenly spaced along the length; lengths to ten places, so that equal ones are equal however they are added."""
    p = np.array(points)
    if len(p) < 2:
        return []
    step = np.linalg.norm(np.diff(p, axis=0, append=p[:1]), axis=1)
    cum = np.concatenate([[0.0], np.cumsum(step)])
    n = max(1, int(cum[-1] // stride))
    at = np.clip(np.searchsorted(np.round(cum, 9), np.round(np.linspace(0, cum[-1], n, endpoint=False), 9)), 0, len(p) - 1)
    return [tuple(p[i].tolist()) for i in at]


def pictures():
    rng = np.random.default_rng(3)
    ring = np.zeros((40, 30), int)
    ring[2:38, 2:28] = 1
    ring[5:35, 5:25] = 0
    ring[10:20, 10:20] = 1
    ring[12, 12] = 0
    thin = np.zeros((25, 12), int)
    thin[1:24, 5] = thin[12, 1:11] = thin[3, 9] = 1
    spiral = np.zeros((33, 33), int)
    y = x = 16
    for k in range(15):
        dy, dx = ((0, 1), (1, 0), (0, -1), (-1, 0))[k % 4]
        for _ in range(2 * (k // 2 + 1)):
            spiral[y, x] = 1
            y, x = y + dy, x + dx
    return [(rng.random((37, 23)) < p).astype(int) for p in (0.2, 0.5, 0.75)] + [ring, thin, spiral, np.ones((9, 9), int), np.eye(12, dtype=int)]


@pytest.mark.parametrize("rows", [1, 4, 64])
def test_outlines_are_those_of_border_following(spark, rows):
    shapes = pictures()
    data = [(k, y, x, int(a[y, x])) for k, a in enumerate(shapes) for y in range(a.shape[0]) for x in range(a.shape[1])]
    b = pack(spark.createDataFrame(data, "img bigint, y int, x int, m int"), {"m": "uint8"}, rows)
    points = contours.outlines(b, "m").cache()
    got = {}
    for r in points.orderBy("img", "outline", "ord").collect():
        got.setdefault((r.img, r.outline), (r.hole, []))[1].append((r.y, r.x))
    for k, a in enumerate(shapes):
        assert sorted(v for (img, _), v in got.items() if img == k) == sorted(followed(a))
    picked = {}
    for r in contours.resampled(points, 4.0).orderBy("img", "outline", "k").collect():
        picked.setdefault((r.img, r.outline), []).append((r.y, r.x))
    assert picked == {key: sampled(p, 4.0) for key, (_, p) in got.items() if len(p) > 1}
    points.unpersist()


def test_no_pixels_no_outlines(spark):
    px = spark.range(20).select(F.lit(0).cast("bigint").alias("img"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x"), F.lit(0).alias("m"))
    assert contours.outlines(pack(px, {"m": "uint8"}, 8), "m").count() == 0


def test_chains_and_loops_are_ranked():
    rng = np.random.default_rng(0)
    order = rng.permutation(50)
    following = np.full(50, -1)
    for a, b in ((0, 1), (1, 8), (8, 30)):
        part = order[a:b]
        following[part[:-1]] = part[1:]
    loop = order[30:]
    following[loop] = np.roll(loop, -1)
    head, off, inside = contours.ranked(following)
    for a, b in ((0, 1), (1, 8), (8, 30)):
        assert head[order[a:b]].tolist() == [order[a]] * (b - a) and off[order[a:b]].tolist() == list(range(b - a)) and not inside[order[a:b]].any()
    turned = np.roll(loop, -int(np.argmin(loop)))
    assert head[turned].tolist() == [loop.min()] * 20 and off[turned].tolist() == list(range(20)) and inside[turned].all()
