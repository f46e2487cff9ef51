import hashlib
import zlib

import pytest

from tallstrip.llm.sharding import Params, histogram_shards

from .conftest import frame


def middle_rule(docs, shards):
    """Rows laid end to end in order of the key; a row's shard is where its middle lies."""
    rows = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), d is not None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    total, before, out = sum(r[3] for r in rows), 0, []
    for k, there, d, size, crc in rows:
        out.append((d if there else None, size, crc, (2 * before + size) * shards // (2 * total)))
        before += size
    return out


def check(spark, docs, params):
    got = [tuple(r) for r in histogram_shards(frame(spark, docs), params).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((r[:4] for r in got), key=key) == sorted(middle_rule(docs, params.shards), key=key)
    slots = {}
    for *_, shard, slot in got:
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_rows_lie_where_their_middle_does(spark, docs, shards):
    check(spark, docs, Params(shards=shards, probes=4, few=2))


def test_probes_go_on_to_ids_and_rows(spark):
    """A third of the rows share a text, and of these some an id as well: splitters lie inside the group."""
    docs = [(i, f"text {i}") for i in range(120)] + [(i, "the same") for i in range(40)] + [(7, "the same")] * 40
    got = check(spark, docs, Params(shards=7, probes=2, few=1))
    sizes = [sum(r[1] for r in got if r[3] == k) for k in range(7)]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in got)


def test_a_tolerance_ends_the_search_early(spark):
    docs = [(i, "x" * (i % 50)) for i in range(2000)]
    total = sum(len(t) + 16 for _, t in docs)
    got = histogram_shards(frame(spark, docs), Params(shards=8, tolerance=0.1, few=2)).collect()
    for k in range(8):
        assert abs(sum(r["size"] for r in got if r["shard"] == k) - total / 8) <= 0.2 * total / 8 + 66


def test_odd_rows(spark):
    docs = [(None, None), (None, None), (1, ""), (1, ""), (2, "é" * 100_000), (3, "a"), (3, "b")]
    check(spark, docs, Params(shards=3))
    assert histogram_shards(frame(spark, [])).collect() == []
