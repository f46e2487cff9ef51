import re

from tallstrip.llm.decontaminate import Rule, decontaminate, keep_clean

from .conftest import corpus, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size=13):
    out = {}
    for doc, text in docs:
        said, hit, found = words(text), set(), set()
        for item, other in items:
            asked = words(other)
            n = min(size, len(asked))
            for i in range(len(asked) - n + 1) if n else ():
                for j in range(len(said) - n + 1):
                    if said[j : j + n] == asked[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(item))
        out[doc] = (len(said), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(said))
    return out


ITEMS = [(10, "The quick BROWN fox jumps over the lazy dog and runs away from it, all day"), (2, "short one"), (3, None), (4, ""), (5, "..."), (10, "w1 w2"), (11, "w1 w2")]


def texts():
    docs = corpus(3)
    return [(d, (t or "") + (" the quick brown fox--jumps over the lazy dog and runs away from it" if i % 5 == 0 else "") + (" short One" if i % 7 == 0 else "")) for i, (d, t) in enumerate(docs)] + [(1000, None)]


def test_matches_brute_force_in_one_block_and_in_many(spark):
    docs = texts()
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = plain(docs, [x for x in ITEMS if x[1]])
    for block in (1 << 20, 10):
        rows = decontaminate(frame(spark, docs), bench, block_bytes=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in rows} == want


def test_removal_and_edges(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    docs = [(1, "Zero, one two THREE four"), (2, "clean"), (3, None)]
    spans = {r.doc_id: r.kept_text for r in decontaminate(frame(spark, docs), bench, remove="spans").collect()}
    assert spans == {1: "Zero,  four", 2: "clean", 3: None}
    whole = {r.doc_id: r.kept_text for r in decontaminate(frame(spark, docs), bench, remove="documents").collect()}
    assert whole == {1: None, 2: "clean", 3: None}
    assert sorted(r.doc_id for r in keep_clean(frame(spark, docs), bench).collect()) == [2, 3]
    assert decontaminate(frame(spark, []), bench).count() == 0
    none = decontaminate(frame(spark, docs), bench.where("item_id < 0"), Rule()).collect()
    assert [r.n_hit for r in none] == [0, 0, 0]


def test_rows_and_removal_do_not_depend_on_the_benchmark_s_size(spark):
    docs = texts() + [(1001, "say short one twice"), (1001, "say short one twice")]
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for remove in ("none", "spans", "documents"):
        small, large = (sorted(map(repr, decontaminate(frame(spark, docs), bench, remove=remove, block_bytes=n).collect())) for n in (1 << 20, 10))
        assert small == large and len(small) == len(docs)


def test_a_prompt_that_many_items_share_and_a_very_long_text(spark):
    prompt = "answer the following question with one word only please and give no reason for it"
    items = [(i, f"{prompt} number {i}") for i in range(300)]
    docs = [(1, f"{prompt} number 7"), (2, "x " + prompt), (3, "filler " * 200_000 + prompt + " number 9"), (4, "y" * 1_000_000)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1 << 20, 10):
        got = {r.doc_id: r for r in decontaminate(frame(spark, docs), bench, block_bytes=block).collect()}
        every = sorted(str(i) for i in range(300))
        assert got[1].item_ids == got[2].item_ids == got[3].item_ids == every and got[4].item_ids == []
        assert (got[1].n_words, got[1].n_hit, got[3].n_words, got[3].n_hit, got[3].contaminated) == (17, 17, 200_017, 17, False)
