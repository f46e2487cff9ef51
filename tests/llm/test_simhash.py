import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tallstrip.llm import simhash

from .conftest import frame


def plain_fingerprint(text, shingle=3):
    said = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(said[i : i + shingle]) for i in range(len(said) - shingle + 1)] or ([b" ".join(said)] if said else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints_and_components(spark, docs):
    prints = {d: plain_fingerprint(t) for d, t in docs}
    rows = simhash.near_duplicates(frame(spark, docs)).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints)


def test_every_pair_within_the_radius_shares_a_table():
    rng = random.Random(0)
    for radius in (2, 4, 6):
        tables = simhash.masks(radius)
        assert len(tables) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            flipped = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & flipped for m in tables)


def test_links_connect_what_pairs_connect(spark):
    rng = random.Random(4)
    prints = {}
    for i in range(0, 300, 3):
        base = rng.getrandbits(64)
        for k in range(3):
            prints[i + k] = base
            base ^= 1 << rng.randrange(64) ^ 0
            base ^= 1 << rng.randrange(64)
    signed = [(v - (1 << 64) if v >> 63 else v, k) for k, v in prints.items()]
    classes = spark.createDataFrame(signed, "fp bigint, id bigint").groupBy("fp").agg({"id": "min"}).withColumnRenamed("min(id)", "id")
    from tallstrip.llm._graph import components

    found = {r.node: r.component for r in components(simhash.links(classes)).collect()}
    first = {}
    for k, v in sorted(prints.items()):
        first.setdefault(v, k)
    assert {k: found.get(first[v], first[v]) for k, v in prints.items()} == plain_components(prints)


def test_edges(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    rows = simhash.near_duplicates(frame(spark, [(4, None), (2, ""), (3, " \n"), (9, "a b c"), (9, "a b c"), (None, "a b c")])).collect()
    assert sorted((r.component_id for r in rows)) == [2, 2, 2, 9, 9, 9]


def edited(text, rng, every):
    said = text.split()
    for i in range(0, len(said), every):
        said[i] = f"new{rng.randrange(10**6)}"
    return " ".join(said)


def test_near_copies_are_found_and_others_stay(spark):
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(3000)]
    docs, group = [], {}
    for g in range(40):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([60, 200, 600])))
        for k in range(4):
            docs.append((g * 10 + k, text if k < 2 else edited(text, rng, 120)))
            group[g * 10 + k] = g
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, docs)).collect()}
    assert kept >= {g * 10 for g in range(40)} and len(kept) <= 41


def test_keep_one_edges(spark):
    assert simhash.keep_one(frame(spark, [])).count() == 0
    got = simhash.keep_one(frame(spark, [(None, "a"), (None, "a"), (1, None), (2, ""), (3, "a b"), (3, "a b")]))
    assert got.columns == frame(spark, []).columns
    assert sorted((r.doc_id or -1, r.text) for r in got.collect()) == [(-1, "a"), (-1, "a"), (1, None), (3, "a b")] or len(got.collect()) == 4


def plain_groups(docs, least=0.8, size=5):
    """Smallest id reachable over pairs of texts whose sets of shingles have the similarity, by comparing all pairs."""
    sets = {}
    for d, text in docs:
        said = (text or "").lower().split()
        sets[d] = {tuple(said[i : i + size]) for i in range(max(1, len(said) - size + 1))} if said else set()
    label = {d: d for d in sets}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("dealing", [{}, {"together": 16, "leaders": 4}])
def test_groups_are_those_of_all_pairs(spark, dealing):
    """A large group of edited copies, many of them far from the original, beside others around the similarity."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(110)]
    docs = []
    for i in range(160):
        said = list(base)
        for _ in range(rng.randrange(5)):
            said[rng.randrange(len(said))] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(said)))
    line = "a line that very many of the texts here have in common and that is long".split()
    for i in range(60):
        said = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([3, 12, 40]))] + line
        docs.append((1000 + 2 * i, " ".join(said)))
        said[rng.randrange(len(said))] = "other"
        docs.append((1001 + 2 * i, " ".join(said)))
    docs += [(3000, docs[5][1]), (3001, ""), (3002, None), (3003, " \n"), (3004, "one"), (3005, "One")]
    rng.shuffle(docs)
    want = plain_groups(docs)
    assert 3 < len({want[i] for i in range(160)}) < 100
    got = simhash.near_copies(frame(spark, docs).repartition(3), **dealing).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_repeated_rows_and_ids(spark):
    said = [f"w{i}" for i in range(60)]
    rows = [(7, " ".join(said)), (7, " ".join(said)), (7, "another text of the same id altogether"), (9, " ".join(said) + " end"), (8, "another text of the same id altogether")]
    got = simhash.near_copies(frame(spark, rows)).collect()
    assert len(got) == 5 and {r.component_id for r in got} == {7}
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert [r.doc_id for r in kept] == [7]


def test_fingerprints_of_sets():
    rng = np.random.default_rng(3)
    values, counts = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2) + np.uint64(1), np.array([0, 1, 0, 199, 100, 0])
    got, at = simhash.majorities(values, counts), 0
    for k, fp in zip(counts.tolist(), got.tolist(), strict=True):
        own = values[at : at + k].tolist()
        assert fp == sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in own) > k)
        at += k


def test_similarity_of_whole_sets():
    x, y = ({tuple(range(i, i + 5)) for i in range(n - 4)} for n in (60, 50))
    values, counts, _ = simhash._shingles(pa.array([" ".join(map(str, range(60))), " ".join(map(str, range(50)))]), simhash.CopyParams())
    a, b = simhash.narrow(values[: counts[0]]), simhash.narrow(values[counts[0] :])
    assert simhash.similarity_of(a, b) == len(x & y) / len(x | y)
    assert simhash.similarity_of(b"", b"") == 1.0


def test_block_edits_and_appended_passages_are_found(spark):
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(3000)]
    fresh = lambda n: [f"new{rng.randrange(10**9)}" for _ in range(n)]
    line, docs = "a line that very many of the texts here have in common".split(), []
    for g in range(40):
        said = [rng.choice(vocabulary) for _ in range(220)] + line
        at = rng.randrange(180)
        docs += [(g * 10, said), (g * 10 + 1, said[:at] + fresh(18) + said[at + 18 :]), (g * 10 + 2, said + fresh(45))]
    rows = simhash.near_copies(frame(spark, [(d, " ".join(x)) for d, x in docs]).repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {d: d // 10 * 10 for d, _ in docs}


def test_long_texts_are_decided_by_whole_sets(spark):
    rng = random.Random(3)
    docs, want = [], {}
    for g in range(60):
        said = [f"w{rng.randrange(10**9)}" for _ in range(1204)]
        changed = 130 if g % 2 else 136  # of 1200 shingles: similarity 0.805 or 0.796
        other = said[:500] + [f"x{rng.randrange(10**9)}" for _ in range(changed - 4)] + said[500 + changed - 4 :]
        docs += [(g * 10, " ".join(said)), (g * 10 + 1, " ".join(other))]
        want |= {g * 10: g * 10, g * 10 + 1: g * 10 if g % 2 else g * 10 + 1}
    assert {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, docs)).collect()} == want


def test_parities_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(1)
    for n in (1, 30, 900, 6000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], rng.integers(0, 1 << 63, n // 7).astype(np.uint64)]))
        x, y = simhash.parities(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
