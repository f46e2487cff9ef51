import numpy as np

from tallstrip.llm.ego import Params, similarity_classes, skipping


def plain(rows, limit=0.95):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    unit = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    near = {i: [j for j in ids if j != i and len(ok[i]) == len(ok[j]) and unit[i] @ unit[j] >= limit] for i in ids}
    label, changed = {i: i for i, _ in rows}, True
    while changed:
        changed = False
        for i in ids:
            least = min([label[i], *(label[j] for j in near[i])])
            changed, label[i] = changed or least < label[i], least
    return {i: (len(near.get(i, [])), label[i]) for i, _ in rows}


def made(seed, n=300, d=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(30, d))
    rows = [(int(i), (base[rng.integers(30)] + rng.normal(size=d) * rng.choice([0, 0.05, 0.15, 1.0])).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(1000, None), (1001, [0.0] * d), (1002, [float("nan")] * d), (1003, [None] * d), (1004, rows[0][1]), (1005, [2 * x for x in rows[0][1]]), (1006, rows[0][1][:8]), (1007, [float("inf")] + [1.0] * (d - 1)), (1008, [])]


def test_matches_brute_force_whatever_the_tree(spark):
    for seed, p in ((0, Params()), (1, Params(leaf=16, interval=40, fan=2)), (2, Params(leaf=7, interval=64, fan=3, grid=2))):
        rows = made(seed)
        table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, rep bigint, n bigint")
        got = {r.vec_id: (r.n_links, r.component_id) for r in similarity_classes(table, p).collect()}
        assert got == plain(rows)


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert similarity_classes(table).count() == 0
    assert similarity_classes(spark.createDataFrame([(3, None)], "vec_id bigint, embedding array<float>")).collect()[0][1:] == (0, 3)


def test_leaves_that_are_far_are_not_sent(spark):
    """Of clustered vectors few leaves go to a pair of tiles; of vectors without any directions nearly all do."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(24, 16))
    p = Params(leaf=16, interval=64, fan=2)
    close = [(i, (centres[i % 24] + rng.normal(size=16) * 0.01).tolist()) for i in range(960)]
    loose = [(i, rng.normal(size=16).tolist()) for i in range(960)]
    share = {}
    for name, rows in (("close", close), ("loose", loose)):
        (r,) = skipping(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), p).collect()
        assert r.leaves >= 60 and r.tiles >= 8 and r.sent <= r.possible
        share[name] = r.sent / r.possible
    assert share["close"] < 0.35 and share["close"] < share["loose"]
    table = spark.createDataFrame(close, "vec_id bigint, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in similarity_classes(table, p).collect()} == plain(close)
    assert skipping(table.where("vec_id < 0")).collect()[0].sent == 0
