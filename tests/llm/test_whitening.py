import math

import numpy as np
import pytest

from tallstrip.llm.whitening import Params, fit_components, whiten, whole_numbers

SCHEMA = "vec_id bigint, embedding array<float>, x string, n int, component int, e double"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3.0) for i, v in vectors], SCHEMA)


def plain(vectors, count):
    """By the whole covariance: id -> (n, deviation, whitened), and the explained shares."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    pick = np.argsort(values)[::-1][:count]
    pick = pick[values[pick] > 1e-12 * values.sum()]
    z = ((n * x - sums) / n) @ turn[:, pick] / np.sqrt(values[pick])
    return n, ((n * x - sums) ** 2).sum(axis=1), z, values[pick] / values.sum()


def check(spark, vectors, params=Params()):
    rows = whiten(frame(spark, vectors), params).collect()
    n, deviation, z, explained = plain(vectors, params.components)
    assert len(rows) == len(vectors) * z.shape[1]
    assert {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    got = np.array([[by[i][k + 1]["whitened"] for k in range(z.shape[1])] for i, _ in vectors])
    sign = np.sign((got * z).sum(axis=0))
    assert np.abs(got * sign - z).max() < 1e-7
    assert [by[i][1]["deviation"] for i, _ in vectors] == deviation.tolist()
    assert np.allclose([by[vectors[0][0]][k + 1]["explained"] for k in range(z.shape[1])], explained, rtol=1e-9)


def test_flat_spectrum_needs_the_full_dimension(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.standard_normal(48).tolist()) for i in range(300)]
    check(spark, vectors)
    fit = whole_numbers(frame(spark, vectors), Params(), "vec_id", "embedding").select("x").distinct()
    assert fit_components(fit).widened


def test_steep_spectrum_is_found_in_the_sketch(spark):
    rng = np.random.default_rng(2)
    scale = 100.0 * 0.3 ** np.arange(60)
    vectors = [(i, (rng.standard_normal(60) * scale + 5).tolist()) for i in range(300)]
    params = Params(components=3, oversampling=8, tolerance=1e-13)
    check(spark, vectors, params)
    fit = whole_numbers(frame(spark, vectors), params, "vec_id", "embedding").select("x").distinct()
    found = fit_components(fit, params)
    assert not found.widened and found.passes > 1


def test_copies_count_once_and_fewer_dimensions_give_fewer_components(spark):
    rng = np.random.default_rng(3)
    base = [rng.standard_normal(5).tolist() for _ in range(30)]
    check(spark, [(i, base[i % 30] if i % 3 else base[0]) for i in range(90)])


def test_odd_rows(spark):
    good = [(1, [1.0, 2.0]), (2, [2.0, 1.5]), (None, [0.0, 1.0]), (4, [1.0, 2.0])]
    bad = [(5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (10, [1.0]), (11, [3e38, 1.0])]
    rows = whiten(frame(spark, good + bad)).collect()
    assert sorted(((r["vec_id"] or 0), r["component"]) for r in rows) == [(i, k) for i in (0, 1, 2, 4) for k in (1, 2)]
    assert {r["n"] for r in rows} == {3}


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, []), (2, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_varies(spark, vectors):
    assert whiten(frame(spark, vectors)).collect() == []
