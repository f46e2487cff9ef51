import numpy as np
import pyarrow as pa
import pytest

from tallstrip.llm import _bytes as B
from tallstrip.llm import _repeats
from tallstrip.llm._repeats import remove_repeats
from tallstrip.llm.recompression import WordWindows, recompression_dedup, word_numbers
from tallstrip.llm.suffix_dedup import ByteWindows, suffix_dedup

from . import brute
from .conftest import frame


def test_suffix_dedup_is_exact(spark, docs):
    got = suffix_dedup(frame(spark, docs)).collect()
    assert {r.doc_id: (r.units, r.removed, len(r.spans), bytes(r.kept)) for r in got} == brute.suffix(docs)


def test_recompression_is_exact(spark, docs):
    got = recompression_dedup(frame(spark, docs)).collect()
    assert {r.doc_id: (r.units, r.removed, bytes(r.kept)) for r in got} == brute.repeats(docs)


@pytest.mark.parametrize("dealing", [{"group_bytes": 2000}, {"group_bytes": 2000, "hot": 0}, {"group_bytes": 1000, "hot": 2, "fan": 3}, {"group_bytes": 700, "fan": 1}, {"group_bytes": 900, "hot": 0, "fan": 1}])
@pytest.mark.parametrize("operator, kernel", [(suffix_dedup, "bytes"), (recompression_dedup, "words")])
def test_dealing_changes_nothing(spark, docs, operator, kernel, dealing):
    made = ByteWindows(100) if kernel == "bytes" else WordWindows(50)
    many = remove_repeats(frame(spark, docs), made, within=kernel == "bytes", **dealing)
    assert sorted(map(str, many.collect())) == sorted(map(str, operator(frame(spark, docs)).collect()))


def morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


@pytest.mark.parametrize("letters", [1024, 2048])
def test_words_that_polynomials_confuse(spark, letters):
    """Thue-Morse words and their complements have equal polynomial hashes modulo a power of two, for any odd base."""
    around = [f"w{i}" for i in range(35)]
    docs = [(i, " ".join([*around, said, *around])) for i, said in enumerate([morse(letters), morse(letters, "b", "a"), morse(letters)])]
    got = recompression_dedup(frame(spark, docs)).collect()
    assert {r.doc_id: (r.units, r.removed, bytes(r.kept)) for r in got} == brute.repeats(docs)
    said = [" ".join(morse(128, "x ", "y ").split()), " ".join(morse(128, "y ", "x ").split())]
    docs = list(enumerate([said[0], said[1], said[0] + " z"]))
    got = recompression_dedup(frame(spark, docs)).collect()
    assert {r.doc_id: (r.units, r.removed, bytes(r.kept)) for r in got} == brute.repeats(docs)


def test_bytes_that_polynomials_confuse(spark):
    docs = [(1, "0" * 20 + morse(256)), (2, morse(256, "b", "a") + "1" * 20), (3, morse(130, "c", "d")), (4, "e" + morse(130, "d", "c"))]
    got = suffix_dedup(frame(spark, docs)).collect()
    assert {r.doc_id: (r.units, r.removed, len(r.spans), bytes(r.kept)) for r in got} == brute.suffix(docs)


INVERSE = pow(int(B._STEP), -1, 1 << 64)


def unmixed(h):
    """The number that mix() makes h of."""
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, 1)):
        x = h
        for _ in range(3):
            x = h ^ (x >> shift)
        h = x * pow(factor, -1, 1 << 64) % (1 << 64)
    return h


def twin(word, seed, alphabet):
    """Another word of 16 bytes with the same chain of blocks: any first block has one second block that ends alike."""
    chain = lambda b, s: int(B.chain_bytes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), s)[0])
    start = int(B.mix(np.array([16], np.uint64) * B._LEFT + np.uint64(seed))[0])
    before_last = unmixed(chain(word, seed)) * INVERSE % (1 << 64)
    rng = np.random.default_rng(4)
    while True:
        first = bytes(rng.choice(alphabet, 8).tolist())
        held = int(B.mix((np.array([start], np.uint64) ^ np.frombuffer(first, np.uint64)) * B._STEP)[0])
        second = (held ^ before_last).to_bytes(8, "little")
        if first != word[:8] and all(33 <= c < 127 for c in second):
            assert chain(first + second, seed) == chain(word, seed)
            return first + second


def test_words_made_to_collide(spark):
    """Words whose hashes are equal under the very seed in use, alone and inside whole stretches."""
    kernel, word = WordWindows(50), b"abcdefghijklmnop"
    other = twin(word, kernel.seed, np.arange(33, 127, dtype=np.uint8))
    assert len(set(B.word_hashes(np.frombuffer(word + other, np.uint8), np.array([0, 16]), np.array([16, 32]), kernel.seed).tolist())) == 1
    around = [f"w{i}" for i in range(35)]
    docs = [(i, " ".join([*around, said.decode(), *around])) for i, said in enumerate([word, other, word, other])]
    docs += [(9, " ".join([other.decode()] * 60)), (10, " ".join([word.decode()] * 60)), (11, " ".join([word.decode()] * 55))]
    for dealing in ({}, {"group_bytes": 200}, {"group_bytes": 200, "hot": 0, "fan": 2}):
        got = remove_repeats(frame(spark, docs), kernel, within=False, **dealing).collect()
        assert {r.doc_id: (r.units, r.removed, bytes(r.kept)) for r in got} == brute.repeats(docs)


@pytest.mark.parametrize("fan", [256, 1])
@pytest.mark.parametrize("operator, kernel", [("bytes", ByteWindows(100)), ("words", WordWindows(50))])
def test_hashes_without_any_use(spark, docs, monkeypatch, operator, kernel, fan):
    """All chains of a task's own digests the same: what brings together decides nothing."""
    kernel = type("Same", (type(kernel),), {"look": lambda self, raw, offsets: same(super(type(self), self).look(raw, offsets))})(*(kernel.window,))

    def same(look):
        look.sym = look.sym & np.uint64(0x300000003)
        return look

    got = remove_repeats(frame(spark, docs), kernel, within=operator == "bytes", group_bytes=3000, hot=10**9, fan=fan).collect()
    if operator == "bytes":
        assert {r.doc_id: (r.units, r.removed, len(r.spans), bytes(r.kept)) for r in got} == brute.suffix(docs)
    else:
        assert {r.doc_id: (r.units, r.removed, bytes(r.kept)) for r in got} == brute.repeats(docs)


def test_bytes_made_to_collide(spark):
    """Blocks of a stretch whose chains are equal under the seeds that are known."""
    word = b"abcdefghijklmnop"
    docs = []
    for k, seed in enumerate((0, 1, 2, 3)):
        other = twin(word, seed, np.arange(33, 127, dtype=np.uint8))
        docs += [(10 * k, "x" * 90 + word.decode() + "y" * 90), (10 * k + 1, "x" * 90 + other.decode() + "y" * 90)]
    got = suffix_dedup(frame(spark, docs)).collect()
    assert {r.doc_id: (r.units, r.removed, len(r.spans), bytes(r.kept)) for r in got} == brute.suffix(docs)


def test_a_frequent_phrase_with_many_surroundings(spark):
    """Its windows are named by their content; nothing but real repeats goes."""
    phrase = "the licence under which this text may be given away in any form and at any price is"
    docs = [(i, f"{i * 7919} {phrase} {i * 104729 % 9973} " + " ".join(f"{i}.{k}" for k in range(20))) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " tail") for i in range(0, 60, 9)]
    for hot in (0, 8, 10**6):
        got = remove_repeats(frame(spark, docs), ByteWindows(100), within=True, group_bytes=3000, hot=hot).collect()
        assert {r.doc_id: (r.units, r.removed, len(r.spans), bytes(r.kept)) for r in got} == brute.suffix(docs)


def test_texts_under_one_id(spark):
    """Different texts of one id are told apart: for bytes a window counts wherever it starts, for words one id is one place."""
    long, other = " ".join(f"word{i}" for i in range(80)), " ".join(f"term{i}" for i in range(80))
    rows = [(3, long), (3, other), (4, other + " end"), (4, "start " + long)]
    for operator in (suffix_dedup, recompression_dedup):
        got = operator(frame(spark, rows)).collect()
        assert sorted(r.removed > 0 for r in got) == [False, False, True, True]
        assert sorted(bytes(r.kept) for r in got if r.removed) == [b" end" if operator is suffix_dedup else b"end", b"start " if operator is suffix_dedup else b"start"]


@pytest.mark.parametrize("operator", [suffix_dedup, recompression_dedup])
def test_rows_that_repeat_are_one_text(spark, operator):
    """A row that is there many times, with an id and without, has the result that it has alone, each time."""
    long, other = " ".join(f"word{i}" for i in range(80)), " ".join(f"term{i}" for i in range(80))
    rows = [(None, long)] + [(4, long + " end")] + [(5, other)] * 2 + [(6, "x " + other)]
    many = rows + [(None, long)] * 40 + [(5, other)] * 40
    alone = {r.doc_id: (r.units, r.removed, bytes(r.kept)) for r in operator(frame(spark, list(dict.fromkeys(rows)))).collect()}
    got = [(r.doc_id, (r.units, r.removed, bytes(r.kept))) for r in operator(frame(spark, many)).collect()]
    assert len(got) == len(many) and all(v == alone[d] for d, v in got)
    assert alone[4][1] > 0 and alone[6][1] > 0 and not alone[5][1] and not alone[None][1]


@pytest.mark.parametrize("kernel", [ByteWindows(100), WordWindows(50)])
def test_pieces_of_long_texts_have_the_same_names(monkeypatch, kernel):
    rng = np.random.default_rng(5)
    text = " ".join(f"w{i}" for i in rng.integers(0, 500, 30_000))
    table = pa.table({"doc": [1], "tie": [1], "text": [text]})
    whole = _repeats._names(kernel, table)[0]
    monkeypatch.setattr(_repeats, "PIECE_BYTES", 10_000)
    assert sum(1 for _ in _repeats._looks(kernel, table)) > 10
    assert np.array_equal(whole, _repeats._names(kernel, table)[0])


def test_numbers_of_words():
    raw = np.frombuffer(b"ab abc ab abcdefgh abcdefghi abcdefgh ab", np.uint8)
    starts, ends, _ = B.words(raw, np.array([0, len(raw)]), B.SPACED)
    number = word_numbers(raw, starts, ends)
    said = raw.tobytes().split()
    assert all((number[i] == number[j]) == (said[i] == said[j]) for i in range(7) for j in range(7))


@pytest.mark.parametrize("operator", [suffix_dedup, recompression_dedup])
def test_edges(spark, operator):
    assert operator(frame(spark, [])).count() == 0
    long = " ".join(f"word{i}" for i in range(80))
    rows = operator(frame(spark, [(None, long), (5, long), (5, long), (6, None), (7, "")])).collect()
    assert len(rows) == 5
    by_id = {r.doc_id: r for r in rows}
    assert by_id[None].removed == 0
    assert by_id[5].removed == by_id[5].units and by_id[5].kept == b""
    assert by_id[6].units == by_id[7].units == 0


def test_a_long_text_repeats_itself(spark):
    part = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(5000))
    text = part + "#" + part
    (row,) = suffix_dedup(frame(spark, [(1, text)])).collect()
    assert (row.units, row.removed, len(row.spans)) == (10001, brute.suffix([(1, text)])[1][1], brute.suffix([(1, text)])[1][2])


def test_cut_characters_go(spark):
    same = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(150))
    docs = [(1, "\u00e9" + same), (2, "\u00a9" + same), (3, None), (4, "\u00a8" + same + "\u65e5"), (5, "\u0fa9" + same)]  # 2 and 5 end their first character like 1
    got = suffix_dedup(frame(spark, docs), characters=True, carry=("lang",)).collect()
    assert {r.doc_id: (r.characters, r.lang) for r in got} == {d: (k.decode("utf-8", "ignore"), "en") for d, (*_, k) in brute.suffix(docs).items()}
    assert any(r.characters.encode() != bytes(r.kept) for r in got)


def test_groups_send_to_shelves_and_stations_to_buckets():
    """With 10,000 groups a group has no more rows than there are shelves, and a station no more than a shelf has buckets."""
    said = " ".join(f"word{i}" for i in range(20_000)).encode()
    table = pa.table({"doc": pa.array([1], pa.int64()), "tie": pa.array([1], pa.int64()), "text": pa.array([said.decode()])})
    kernel, groups, span = ByteWindows(100), 10_000, 100
    sent = [_repeats._send_names(kernel, groups, span)((pa.scalar(p),), table) for p in (0, 1)]
    assert all(len(x) <= groups // span for x in sent)
    shelf = sent[0].column("bucket")[0].as_py()
    station = pa.concat_tables([x.slice(0, 1) for x in sent])
    met = _repeats._meet_names(groups)((pa.scalar(shelf), pa.scalar(0)), station)
    assert len(met) <= span and all(b // span == shelf for b in met.column("bucket").to_pylist())
    told = _repeats._answer_names(4096, _repeats.MET, "block")
    answers = pa.concat_tables([told((b,), met.slice(i, 1)) for i, b in enumerate(met.column("bucket"))])
    for row in _repeats._hand_answers(groups)((pa.scalar(shelf), pa.scalar(0)), station, answers).column("data").to_pylist():
        names = _repeats.unpacked(station.column("data")[0].as_py(), _repeats.NAME)
        bits = np.frombuffer(row, np.uint8)
        assert np.unpackbits(bits[: len(bits) // 2], count=len(names)).all()
        assert not np.unpackbits(bits[len(bits) // 2 :], count=len(names)).any()
