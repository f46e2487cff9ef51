import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tallstrip.llm import chat

nasty = st.lists(st.one_of(st.text(max_size=5), st.sampled_from([*chat.CONTROL, "\\", "<", "[", "[/", "</s", "<\\", "[\\INST]"])), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), nasty), nasty), max_size=5))
def test_what_is_formatted_reads_back(turns):
    formatted = [chat.format_turn(role, [{"type": "text", "text": text}], chat.Params()) for role, text in turns]
    assert list(chat.read_back("".join(f[0] for f in formatted))) == turns
    for (text, a, b, _), (role, said) in zip(formatted, turns, strict=True):
        assert chat.unescape(text[a:b]) == (said if role == "assistant" else "")


def test_parts_become_placeholders_in_order(spark):
    parts = [{"type": "text", "text": "look <image>"}, {"type": "image", "ref": "i.png", "width": 1000, "height": 513}, {"type": "audio", "ref": "a.wav", "seconds": 2.5}, {"type": "document", "ref": "d.pdf", "pages": 3}, {"type": "text", "text": "end"}]
    rows = spark.createDataFrame([(1, 0, "user", json.dumps(parts)), (1, 1, "assistant", None)], "conv_id bigint, turn bigint, role string, text string")
    first, second = sorted(chat.format_turns(rows, parts=True).collect(), key=lambda r: r.turn)
    assert first.formatted == "[INST]look <\\image><image><audio><document>end[/INST]"
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in first.attachments] == [(0, "image", "i.png", 340), (1, "audio", "a.wav", 75), (2, "document", "d.pdf", 1800)]
    assert first.expanded_tokens == 2215 and second.formatted == "<s></s>"


def test_query_matches_plain_digests(spark, tmp_path):
    import hashlib

    from tallstrip.llm.queries import op7_chat

    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "system", None), (2, 1, "assistant", "x</s>\\y"), (2, 2, "assistant", ""), (3, 0, "user", "hi")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op7_chat(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == conv)
        loss = "".join(t or "" for _, _, role, t in own if role == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t or ''}\n" for _, _, role, t in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_nulls(spark):
    rows = spark.createDataFrame([(None, None, None, None)], "conv_id bigint, turn bigint, role string, text string")
    (row,) = chat.format_turns(rows).collect()
    assert (row.conv_id, row.turn, row.formatted) == (None, None, "[ROLE][/ROLE][/TURN]")
    assert chat.format_turns(rows.where("conv_id = 1")).count() == 0
