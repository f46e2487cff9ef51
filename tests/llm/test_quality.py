import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallstrip.llm._work import steady
from tallstrip.llm.quality import Params, classify, keep_accepted, score

from .conftest import frame

DATA = "/root/testdata/sf0.01"


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney over the bytes of running text, straight from its definition."""
    counts = [None] + [Counter() for _ in range(order)]
    grams = [None] + [set() for _ in range(order)]
    for s in map(stream, texts):
        for i in range(1, len(s)):
            top = min(i + 1, order)
            counts[top][s[i + 1 - top : i + 1]] += 1
            for n in range(1, top + 1):
                grams[n].add(s[i + 1 - n : i + 1])
    for n in range(1, order):
        for g in grams[n + 1]:
            counts[n][g[1:]] += 1
    p, keep = {bytes([b]): 1 / 256 for b in range(256)}, {}
    for n in range(1, order + 1):
        of = Counter(counts[n].values())
        y = of[1] / max(of[1] + 2 * of[2], 1)
        d = [max(0.05, min(float(i), i - (i + 1) * y * of[i + 1] / of[i] if of[i] else 0.5 * i)) for i in (1, 2, 3)]
        less = {g: min(d[min(c, 3) - 1], c) for g, c in counts[n].items()}
        total, free = defaultdict(int), defaultdict(float)
        for g, c in counts[n].items():
            total[g[:-1]] += c
            free[g[:-1]] += less[g]
        for h in total:
            keep[h] = free[h] / total[h]
        for g in [bytes([b]) for b in range(256)] if n == 1 and counts[1] else counts[n]:
            below = 1 / 256 if n == 1 else p[g[1:]]
            p[g] = (counts[n][g] - less.get(g, 0)) / total[g[:-1]] + keep[g[:-1]] * below

    def log_p(g):
        return math.log(p[g]) if g in p else math.log(keep.get(g[:-1], 1.0)) + log_p(g[1:])

    def text(t):
        s = stream(t)
        return sum(log_p(s[max(0, i + 1 - order) : i + 1]) for i in range(1, len(s)))

    return text


def stream(t):
    said = t.encode().split()
    return b"\x02" + b" ".join(said) + b"\x03" if said else b""


def fold_of(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.pmod(F.xxhash64(F.coalesce("t", F.lit(""))), F.lit(2)).alias("f")).collect()
    return [r.f for r in rows]


GOOD = ["the cat sat on the mat", "a cat and a dog sat there", "the dogs ran", "to be or not to be that is it", "the\n cat  was not there", "a dog is a dog", "there was a cat on it", "mats are on the floor", "that it is", "ran to the cats"]


@pytest.mark.parametrize("order", [3, 4, 5])
def test_scores_are_the_model_s(spark, order):
    docs = [(i, t) for i, t in enumerate(GOOD)] + [(10, "the zebra"), (11, "qqq xyz"), (12, ""), (13, None), (14, "cat cat éé"), (15, " \t"), (16, "the the the the")]
    folds = fold_of(spark, [t for _, t in docs])
    assert set(folds[: len(GOOD)]) == {0, 1}
    trusted = spark.createDataFrame([(i,) for i in range(len(GOOD))], "doc_id bigint")
    got = {r.doc: r for r in score(frame(spark, docs).repartition(3), trusted, Params(order=order)).collect()}
    models = [plain_model([t for t, f in zip(GOOD, folds, strict=False) if f != own], order) for own in (0, 1)]
    for (i, t), f in zip(docs, folds, strict=True):
        assert got[i].n_bytes == max(0, len(stream(t or "")) - 1)
        assert got[i].log_p == pytest.approx(models[f](t or ""), rel=1e-4, abs=1e-6)


def test_the_quantile_decides(spark):
    """classify against a plain version: quantiles of the trusted documents by language, of all where there are none."""
    texts = GOOD + [f"{a} {b}" for a in GOOD for b in ("is here", "was a cat", "xq zz")] + ["zzz qqq jjj", "the cat", "", None, "the cat"]
    rows = [(i, t, ("en", "de", None)[i % 3] if i < len(texts) - 3 else "fr") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string, lang string")
    trusted = [i for i in range(len(GOOD) * 3) if i % 3 < 2]
    labels = spark.createDataFrame([(i, 1, None) for i in trusted] + [(len(texts) - 2, 0, 1)], "doc_id bigint, quality int, toxic int")
    params = Params(quantile=0.8)
    folds = fold_of(spark, texts)
    models = [plain_model([texts[i] for i in [*trusted, *(j for j in (0, 1) if j in trusted)] if folds[i] != own], params.order) for own in (0, 1)]
    mean = [-models[f](t or "") / (len(stream(t or "")) - 1) if stream(t or "") else None for t, f in zip(texts, folds, strict=True)]
    every = [i for i, _, _ in rows + rows[:2]]

    def limit(lang):
        own = sorted(mean[i] for i in every if i in trusted and (lang is None or (rows[i][2] or "") == lang))
        return own[math.ceil(params.quantile * len(own)) - 1] if own else limit(None)

    got = classify(docs, labels, params).collect()
    assert sorted(r.doc_id for r in got) == sorted(every)
    assert {r.accepted for r in got} == {True, False}
    for r in got:
        assert r.threshold == pytest.approx(limit(r.lang), rel=1e-4)
        assert r.accepted == (mean[r.doc_id] is None or mean[r.doc_id] <= limit(r.lang) * (1 + 1e-6))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r.accepted for r in classify(docs, half).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect()]
    clean = [a for q, a in held if q == 1]
    junk = [a for q, a in held if q == 0]
    assert sum(clean) >= 0.985 * len(clean)
    assert sum(junk) <= 0.2 * len(junk)


def test_edges(spark):
    labels = spark.createDataFrame([(i, 1, None) for i in range(100, 100 + len(GOOD))] + [(2, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, [(1, "the cat sat"), (2, "### $$$ %%%" * 100), (3, None), (None, "the cat"), (4, "the dog ran"), (4, "### $$$ %%%" * 90), (5, ""), (6, "%%%"), (1, "the cat sat")] + [(100 + i, t) for i, t in enumerate(GOOD)])
    assert classify(frame(spark, []), labels).count() == 0
    assert all(r.accepted for r in classify(docs, labels.where("doc_id < 0")).collect())
    got = keep_accepted(docs, labels, Params(quantile=1.0))
    ids = [r.doc_id for r in got.collect()]
    assert got.columns == docs.columns and {i for i in ids if i is None or i < 100} == {1, 3, 5, None} and ids.count(1) == 2
    empty = [r for r in classify(docs, labels).collect() if r.doc_id in (3, 5)]
    assert all(r.accepted and r.log_perplexity is None and r.n_bytes == 0 for r in empty)


def test_a_very_long_text(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(GOOD))], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, [*enumerate(GOOD), (50, " ".join(GOOD) * 80_000), (51, "x" * 3_000_000)]).withColumn("lang", F.lit(None).cast("string"))
    got = {r.doc_id: r for r in classify(docs, labels, Params(quantile=1.0)).collect()}
    assert got[50].accepted and not got[51].accepted and got[50].lang == ""


@pytest.mark.parametrize("text", ["a", "ab", " a ", "a b"])
def test_texts_shorter_than_a_gram_alone(spark, text):
    docs = spark.createDataFrame([(1, "en", text)], "doc_id long, lang string, text string")
    trusted = spark.createDataFrame([(1,)], "doc_id long")
    (got,) = score(docs, trusted).collect()
    assert got.n_bytes == len(stream(text)) - 1 and got.log_p < 0


def test_documents_out_of_an_exchange_are_dealt_once(spark):
    rows = spark.createDataFrame([(i, "en", f"word {i} and {i * i} more") for i in range(60)], "doc_id long, lang string, text string")
    trusted, moved = rows.select("doc_id"), rows.repartition(5)
    assert steady(rows) is rows
    assert "Exchange" not in steady(moved)._jdf.queryExecution().executedPlan().toString()
    want = {r.doc: r.log_p for r in score(rows, trusted).collect()}
    assert {r.doc: pytest.approx(r.log_p, rel=1e-5) for r in score(moved, trusted).collect()} == want
