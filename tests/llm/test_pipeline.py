import pytest

DATA = "/root/testdata/sf0.001"


def test_stages_keep_their_columns(spark):
    import corpus_pipeline
    from tallstrip.llm._work import settle

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = settle(stage(spark, docs, DATA), name)
        assert after.columns == docs.columns
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(set(ids)) == len(ids) and set(ids) <= seen
        docs, seen = after, set(ids)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in rows} == seen


def test_registered():
    import __spark_entry__

    pytest.importorskip("corpus_pipeline")
    assert "pipeline" in __spark_entry__.queries()
    assert {f"op{i}_" for i in range(1, 11)} == {n[: n.index("_") + 1] for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()}


def test_stages_do_what_plain_versions_do(spark, tmp_path):
    """Near duplicates, repeated strings and decontamination one after another, against brute force on each one's input."""
    import corpus_pipeline
    from tallstrip.llm._work import settle

    from . import brute
    from .conftest import corpus
    from .test_decontaminate import ITEMS, plain
    from .test_simhash import plain_groups

    passage = "The quick brown fox jumps over the lazy dog and runs away from it, all day"
    texts = [(d + 1000, t) for d, t in corpus(5, 60)] + [(1, passage), (2, f"{passage} {passage}"), (3, "w1 w2 " * 3), (4, "clean words of its own that nobody else has")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def run(name, rows):
        out = settle(stages[name](spark, rows, str(tmp_path)), name)
        return out, {r.doc_id: r.text for r in out.collect()}

    groups = plain_groups(texts)
    docs, got = run("near_duplicates", docs)
    assert got == {d: t for d, t in texts if groups[d] == d}
    want = {d: kept.decode("utf-8", "ignore") for d, (_, _, _, kept) in brute.suffix(list(got.items())).items()}
    docs, got = run("repeated_strings", docs)
    assert got == want and all(r.n_chars == len(r.text) for r in docs.collect())
    judged = plain(list(got.items()), ITEMS)
    docs, got = run("decontaminate", docs)
    assert got == {d: t for d, t in want.items() if not judged[d][3]}
    assert 1 not in got and 4 in got
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(got)
    for sequence in {r.sequence_id for r in packed}:
        own = sorted((r.offset, r.length) for r in packed if r.sequence_id == sequence)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048
