import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallstrip.llm.packing import Params, pack

from .conftest import corpus, frame


def test_pieces_and_sequences(spark):
    docs = corpus(2, 60) + [(5000, "many words " * 3000), (5001, "a <|endoftext|> b  \n\n c's 123é"), (5002, None), (None, "x"), (5003, "dup"), (5003, "dup")]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pack(frame(spark, docs).repartition(5)).collect()
    ids = {d: [*coder.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, n in ((d, len(x)) for d, x in ids.items()):
        own = sorted(set(pieces[d]))
        assert [p[0] for p in own] == list(range(len(own))) and sum(p[2] for p in own) == n
        assert all(p[2] == 2048 for p in own[1:]) and (len(own) == 1 or n > 2048)
    assert len(pieces[5003]) == 2
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 2048) + 1


def test_very_long_runs_and_words(spark):
    docs = [(1, " " * 3_000_000), (2, "a b" + "\t" * 1_000_000 + "x <|endoftext|> y" + "\n\t " * 300_000), (3, "a" * 1_000_000), (4, "\u3000" * 500_000)]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*coder.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in docs}
    rows = pack(frame(spark, docs)).collect()
    assert {d: sum(r.length for r in rows if r.doc_id == d) for d in ids} == {d: len(x) for d, x in ids.items()}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)


def test_rounds_join_what_tasks_leave(spark):
    rows = pack(frame(spark, [(i, "word " * 300) for i in range(96)]).repartition(24), Params(fan=2)).collect()
    assert len({r.sequence_id for r in rows}) == -(-96 // (2048 // rows[0].length))


def test_no_documents(spark):
    assert pack(frame(spark, [])).count() == 0


def test_lengths_that_differ_by_task_are_joined(spark):
    docs = [(i, "word " * (1100 if i < 300 else 700)) for i in range(600)]
    for params in (Params(), Params(dealt=250)):
        rows = pack(frame(spark, docs).repartitionByRange(2, "doc_id"), params).collect()
        assert sorted(r.doc_id for r in rows) == list(range(600))
        assert len({r.sequence_id for r in rows}) == 300
