import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallstrip.llm.resampling import LONG_WORD, Params, crc_on, resample

from .conftest import corpus, frame

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return WORD.findall((text or "").encode().translate(UPPER))


def features(text):
    w = words(text)
    return [b" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(docs, target, p):
    hashed = lambda texts: Counter(zlib.crc32(f) % p.buckets for t in texts for f in features(t))
    s, t = hashed(x for _, x in docs), hashed(target)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.total() + p.buckets) / ((s[k] + 1) * (t.total() + p.buckets)))) for k in range(p.buckets)]
    rows = []
    for d, text in docs:
        weight = sum(gain[zlib.crc32(f) % p.buckets] for f in features(text))
        h = int(hashlib.sha256(f"{p.seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    eligible = sorted((r for r in rows if r[5] >= p.least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(eligible[: p.share * len(eligible) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def check(spark, docs, target, params):
    got = resample(frame(spark, docs), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string"), params)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:4], r[4] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, target, params), key=key)


@pytest.mark.parametrize("params", [Params(), Params(buckets=7, share=60, least=3, block=5), Params(block=1, share=100, least=0)])
def test_scores_and_ranks_are_those_of_single_features(spark, docs, params):
    check(spark, docs, [t for _, t in corpus(9, 10)] + [None, ""], params)


def test_odd_rows(spark):
    docs = [(None, None), (None, "A b é C" * 30), (1, ""), (1, "x" * 100_000), (2, "word " * 50_000), (2, "word " * 50_000), (3, "!?" * 1000)]
    check(spark, docs, ["word word"], Params(share=50))
    check(spark, docs, [], Params(share=100, least=1))
    check(spark, [], ["a b"], Params())


@given(st.lists(st.tuples(st.binary(max_size=20), st.binary(max_size=LONG_WORD * 2)), max_size=20), st.booleans())
@settings(max_examples=50, deadline=None)
def test_states_go_on(pairs, space):
    raw = np.frombuffer(b"".join(b for _, b in pairs), np.uint8)
    ends = np.cumsum([len(b) for _, b in pairs]).astype(np.int64)
    starts = ends - np.array([len(b) for _, b in pairs], np.int64)
    states = np.array([zlib.crc32(a) for a, _ in pairs], np.uint32)
    want = [zlib.crc32(a + b" " * space + b) for a, b in pairs]
    assert crc_on(states, raw, starts, ends, space).tolist() == want
