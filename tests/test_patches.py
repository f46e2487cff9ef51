import numpy as np
import pytest
from pyspark.sql import functions as F

from tallstrip.operators import patches
from tallstrip.operators.bands import pack

from .test_bands import several


def test_summed_areas():
    a = np.random.default_rng(0).integers(0, 2, (9, 7))
    s = patches.summed(a)
    assert all(s[c, e] - s[b, e] - s[c, d] + s[b, d] == a[b:c, d:e].sum() for b in range(9) for c in range(b, 10) for d in range(7) for e in range(d, 8))


@pytest.mark.parametrize("rows, boundary", [(3, 0.0), (64, 1.0)])
def test_windows_hold_what_they_were_drawn_for(spark, rows, boundary, monkeypatch):
    monkeypatch.setattr(patches, "DRAWS", 2000)
    px, arrays = several(spark, [(50, 21), (9, 30), (40, 40)], 1, ("m",), 10)
    px = px.withColumn("m", F.when((F.col("img") < 2) & (F.col("m") == 0), 1).otherwise(0))
    masks = [(a["m"] == 0).astype(int) * (k < 2) for k, a in enumerate(arrays)]
    got = patches.sample(pack(px, {"m": "uint8"}, rows), "m", 300, 12, 0.8, boundary, 12, 20).collect()
    assert sorted(r.patch for r in got) == list(range(300))
    for r in got:
        m = masks[r.img]
        assert 0 <= r.y0 <= max(0, m.shape[0] - 12) and 0 <= r.x0 <= max(0, m.shape[1] - 12)
        assert r.positives == m[r.y0 : r.y0 + 12, r.x0 : r.x0 + 12].sum()
        assert r.positives >= 12 if r.wanted else True
        assert not (r.wanted and r.img == 2)
    assert 0.5 < np.mean([r.wanted for r in got]) < 0.9 and max(r.attempt for r in got) > 0
    assert len({(r.img, r.y0, r.x0) for r in got}) > 120


def test_nothing_is_ever_enough(spark):
    px, _ = several(spark, [(20, 20)], 2, ("m",), 2)
    got = patches.sample(pack(px, {"m": "uint8"}, 8), "m", 20, 8, 1.0, 0.0, 65, 5).collect()
    assert len(got) == 20 and {r.attempt for r in got} == {5} and not any(r.wanted for r in got)
    assert patches.sample(pack(px.where("img < 0"), {"m": "uint8"}, 8), "m", 20, 8).count() == 0


def test_tensors_are_filled_beyond_the_image(spark):
    px, arrays = several(spark, [(23, 11), (5, 30)], 3, ("r", "m"))
    windows = spark.createDataFrame([(0, 0, 2, 3), (1, 0, 18, 6), (2, 1, 0, 25), (3, 1, 4, 0), (4, 0, 22, 10)], "patch bigint, img bigint, y0 bigint, x0 bigint")
    for rows in (2, 7, 64):
        for r in patches.tensors(windows, pack(px, {"r": "uint8", "m": "uint8"}, rows), 8, {"r": 1.0, "m": 0.0}, {"r": 255.0}, 3).collect():
            got = np.frombuffer(r.data, np.float32).reshape(2, 8, 8)
            want = np.stack([np.ones((8, 8)), np.zeros((8, 8))])
            for k, (p, by) in enumerate((("r", 255), ("m", 1))):
                part = arrays[r.img][p][r.y0 : r.y0 + 8, r.x0 : r.x0 + 8] / by
                want[k, : part.shape[0], : part.shape[1]] = part
            assert np.allclose(got, want)
