"""Exact removal of repeated windows over a whole corpus; the two substring operators share this frame.

Texts are dealt to groups by a hash of their identity. A kernel gives each window (so many bytes, or so many words) an
anchor: a feature inside it that depends on the window's content alone, so equal windows have equal anchors at equal
distances. A window holds half of what an anchor leaves free before the anchor or behind it; anchor and half together are
its name. Neighbouring windows with one anchor and half form a stretch. Then

1. groups send their names with how many different stretches each has, by buckets of names; buckets answer which names
   occur more than once, and which have very many different stretches (hot names);
2. groups send the first of each kind of stretch under a repeated name, what repeats it in the group being decided
   there; stretches of hot names are sent as single windows that are named by their whole content, so no bucket grows
   with the surroundings of a frequent phrase;
3. buckets keep the first of equal stretches and ask for the content of firsts whose name has several different ones;
4. groups send that content, and the kernel finds in each bucket the windows that occur earlier elsewhere, comparing it
   byte by byte or word by word;
5. groups apply what was found to their texts.

Whole stretches are equal if 128 bits of BLAKE2b of their bytes are, salted anew in each run, so nobody can write texts
that differ and agree there. All other hashes only bring together what is then compared. What moves is packed into
arrays, one row per group and bucket. The texts' exchange is the same in all steps, so Spark runs it once.

Of more than FAN groups each message passes a station: as many neighbouring groups form a block, and buckets a shelf, as
there are blocks and shelves. A group sends a row to each shelf; a station, which is a shelf as one block sees it, merges
what its block says and sends a row to each bucket; answers come back the same way. So rows are groups to the power of
one and a half instead of two, and a station holds as much as a group.
"""

from __future__ import annotations

import copy
import math
import secrets
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._work import bytes_of, settle

#: Bytes of text in a group, and of text whose names meet in a bucket.
GROUP_BYTES = 12 << 20
#: Bytes of text a kernel looks at together; longer texts are looked at piece by piece.
LOOK_BYTES, PIECE_BYTES = 1 << 20, 4 << 20
#: Different stretches of a name from which its windows are named by their whole content. Results don't depend on it.
HOT = 4096
#: Groups up to which groups and buckets send to each other directly.
FAN = 256
LEAST = -(1 << 63)

NAME = np.dtype([("sym", "u8"), ("kinds", "u1")])
STRETCH = np.dtype([("sym", "u8"), ("seg", "u8"), ("seg2", "u8"), ("doc", "i8"), ("tie", "i8"), ("group", "i4"), ("w0", "i8"), ("n", "i4"), ("rel", "i4")])
FOUND = np.dtype([("doc", "i8"), ("tie", "i8"), ("n", "i8"), ("w0", "i8")])
#: A block's names: stretches of all its groups, and whether several of these have the name.
MET = np.dtype([("sym", "u8"), ("kinds", "u4"), ("many", "u1")])
#: Finds of several groups.
SPREAD = np.dtype([*FOUND.descr, ("group", "i4")])
#: In place of a group's number: stretches that are asked for, and finds of several groups.
ASKED, GONE = -1, -2


@dataclass
class Look:
    """Some texts, and the stretches of their windows: text number, first window (in the text), windows, anchor's
    distance from the first window, and name. digest(text, w0, n) hashes all that n windows from w0 on cover; contents(...)
    has it in bytes: a buffer, and where in it each begins and ends."""

    text: np.ndarray
    w0: np.ndarray
    n: np.ndarray
    rel: np.ndarray
    sym: np.ndarray
    digest: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    contents: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def stretches(first: np.ndarray, start: np.ndarray, anchor: np.ndarray, size: np.ndarray | int, window: int, digest: Callable[[np.ndarray, np.ndarray, int], np.ndarray], contents: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Look:
    """Stretches of the windows that begin at the units `start` (in order), whose anchors begin at `anchor` and have
    `size` units; an anchor below zero stands for none. first: units before each text. digest and contents: of runs of
    units."""
    whole = lambda text, w0, n: digest(first[text] + w0, n + (window - 1), 2)
    said = lambda text, w0, n: contents(first[text] + w0, n + (window - 1))
    if not len(start):
        none = np.zeros(0, np.int64)
        return Look(none, none, none, none, none.astype(np.uint64), whole, said)
    half = (window - size) // 2
    left = anchor - start >= half
    new = anchor < 0
    new[0] = True
    new[1:] |= (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | (start[1:] != start[:-1] + 1)
    text = np.searchsorted(first, start, "right") - 1
    new[1:] |= text[1:] != text[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(start)))
    start, anchor, left, text = start[at], anchor[at], left[at], text[at]
    size, half = (x[at] if isinstance(x, np.ndarray) else np.full(len(at), x) for x in (size, half))
    held = anchor >= 0
    begin = np.where(held, np.where(left, anchor - half, anchor), start)
    extent = np.where(held, np.where(left, size + half, window - half + 1), window)
    sym = B.mix(digest(begin, np.minimum(extent, window), 1) ^ np.where(held, left.astype(np.uint64), np.uint64(2)))
    return Look(text, start - first[text], n.astype(np.int64), np.where(held, anchor - start, 0), sym, whole, said)


def _looks(kernel, table: pa.Table):
    """(doc, tie, units before the look, Look) over a group's texts in order of identity; equal rows are looked at once."""
    doc, tie = table.column("doc").to_numpy(), table.column("tie").to_numpy()
    table = table.filter(pa.array(_starts(doc, tie)))
    for piece in B.slices(iter(table.combine_chunks().to_batches()), "text", LOOK_BYTES):
        doc, tie = (piece.column(piece.schema.get_field_index(c)).to_numpy() for c in ("doc", "tie"))
        raw, offsets = B.buffers(piece.column(piece.schema.get_field_index("text")))
        for part, at, before in kernel.pieces(raw, PIECE_BYTES) if len(piece) == 1 and len(raw) > PIECE_BYTES else [(raw, offsets, 0)]:
            yield doc, tie, before, kernel.look(part, at)


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc", "ascending"), ("tie", "ascending")])


def _names(kernel, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group's names, sorted, how often each occurs, and how many different stretches it has."""
    syms, pairs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for _, _, _, look in _looks(kernel, table):
        syms.append(look.sym)
        pairs.append(B.mix(look.sym ^ B.mix(look.digest(look.text, look.w0, look.n))))
    sym, pair = np.concatenate(syms), np.concatenate(pairs)
    names, counts = np.unique(sym, return_counts=True)
    _, at = np.unique(pair, return_index=True)
    return names, counts, np.unique(sym[at], return_counts=True)[1]


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def packed(rows: np.ndarray) -> bytes:
    """Rows column after column: equal and neighbouring values lie together, which compresses."""
    return b"".join(np.ascontiguousarray(rows[name]).tobytes() for name in rows.dtype.names)


def unpacked(data: bytes, dtype: np.dtype) -> np.ndarray:
    rows, at = np.empty(len(data) // dtype.itemsize, dtype), 0
    for name in dtype.names:
        rows[name] = np.frombuffer(data, dtype[name], len(rows), at)
        at += len(rows) * dtype[name].itemsize
    return rows


def _rows(group_name: str, groups: np.ndarray, data: np.ndarray, **more) -> pa.Table:
    """One row per value of groups, with its part of data as bytes."""
    order = np.argsort(groups, kind="stable")
    groups, data = groups[order], data[order]
    values, at = np.unique(groups, return_index=True)
    parts = np.split(data, at[1:]) if len(values) else []
    columns = {group_name: pa.array(values, pa.int64()), "data": pa.array([packed(x) for x in parts], pa.binary())}
    return pa.table(columns | {k: pa.array([v] * len(values), pa.int64()) for k, v in more.items()})


def _joined(column, dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(unpacked(x, dtype) for x in column.to_pylist())])


def _send_names(kernel, buckets, span):
    def work(key, table):
        names, _, kinds = _names(kernel, _ordered(table))
        rows = np.empty(len(names), NAME)
        rows["sym"], rows["kinds"] = names, np.minimum(kinds, 255)
        return _rows("bucket", _bucket(names, buckets) // span, rows, p=key[0].as_py())

    return work


def _gathered(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The names that each group of a block sent to a station, all of them once, and where each group's are."""
    parts = [unpacked(x, NAME) for x in table.column("data").to_pylist()]
    rows = np.concatenate([np.zeros(0, NAME), *parts])
    names, place = np.unique(rows["sym"], return_inverse=True)
    met = np.zeros(len(names), MET)
    met["sym"] = names
    met["kinds"] = np.minimum(np.bincount(place, weights=rows["kinds"], minlength=len(names)), 1 << 31)
    met["many"] = np.bincount(place, minlength=len(names)) > 1
    return parts, met, place


def _meet_names(buckets: int):
    def work(key, table):
        met = _gathered(table)[1]
        return _rows("bucket", _bucket(met["sym"], buckets), met, block=key[1].as_py())

    return work


def _bits(often: np.ndarray, hot: np.ndarray) -> bytes:
    return np.packbits(often).tobytes() + np.packbits(hot).tobytes()


def _told(answers: pa.Table, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of names that were sent to `bucket` in this order: which occur in several groups, and which are hot."""
    often, hot = np.zeros(len(bucket), bool), np.zeros(len(bucket), bool)
    order = np.argsort(bucket, kind="stable")
    values, at = np.unique(bucket[order], return_index=True)
    sent = dict(zip(values.tolist(), np.split(order, at[1:]), strict=True)) if len(values) else {}
    for b, data in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True):
        own, bits = sent[b], np.frombuffer(data, np.uint8)
        often[own] = np.unpackbits(bits[: len(bits) // 2], count=len(own)).astype(bool)
        hot[own] = np.unpackbits(bits[len(bits) // 2 :], count=len(own)).astype(bool)
    return often, hot


def _answer_names(hot: int, kind: np.dtype, sender: str):
    """For each sender's names: bits whether another group has the name, then bits whether it is hot."""

    def work(key, table):
        parts = [unpacked(x, kind) for x in table.column("data").to_pylist()]
        every = np.concatenate(parts)
        names, place, counts = np.unique(every["sym"], return_inverse=True, return_counts=True)
        often = counts > 1
        if kind is MET:
            often |= np.bincount(place, weights=every["many"], minlength=len(names)) > 0
        many = np.bincount(place, weights=every["kinds"], minlength=len(names)) > hot
        out, at = [], 0
        for x in parts:
            own = place[at : at + len(x)]
            out.append(_bits(often[own], many[own]))
            at += len(x)
        return pa.table({sender: table.column(sender), "bucket": pa.array([key[0].as_py()] * len(parts), pa.int64()), "data": pa.array(out, pa.binary())})

    return work


def _hand_answers(buckets: int):
    """A station tells each group of its block what the buckets of its shelf say."""

    def work(key, table, answers):
        parts, met, place = _gathered(table)
        often, hot = _told(answers, _bucket(met["sym"], buckets))
        ends = np.cumsum([len(x) for x in parts])
        out = [_bits(often[own], hot[own]) for own in np.split(place, ends[:-1])] if parts else []
        return pa.table({"p": table.column("p"), "bucket": table.column("bucket"), "data": pa.array(out, pa.binary())})

    return work


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _runs(rows: np.ndarray, kind: np.dtype = FOUND) -> np.ndarray:
    """Windows of the stretches, neighbouring ones of a text together."""
    rows = rows[np.lexsort((rows["w0"], rows["tie"], rows["doc"]))]
    ends = rows["w0"] + rows["n"]
    new = _starts(rows["doc"], rows["tie"])
    new[1:] |= rows["w0"][1:] != ends[:-1]
    at = np.flatnonzero(new)
    out = np.empty(len(at), kind)
    for name in kind.names:
        out[name] = rows[name][at]
    out["n"] = ends[np.append(at[1:], len(rows)) - 1] - out["w0"] if len(at) else 0
    return out


def _firsts(rows: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of equal stretches those that nothing here repeats, in order of names, and those that go."""
    rows = rows[np.lexsort((rows["w0"] + rows["rel"], rows["tie"], rows["doc"], rows["seg2"], rows["seg"], rows["sym"]))]
    new = _starts(rows["sym"], rows["seg"], rows["seg2"])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(rows) else np.zeros(0, np.int64)
    gone = ~new if within else rows["doc"] > rows["doc"][first]
    return rows[~gone], rows[gone]


def _send_stretches(kernel, buckets, within: bool, span: int):
    """Rows with p < 0 hold stretches; the group's own finds go to the bucket of its number as p."""

    def work(key, table, answers):
        group, table = key[0].as_py(), _ordered(table)
        names, counts, _ = _names(kernel, table)
        often, hot = _told(answers, _bucket(names, buckets) // span)
        often |= counts > 1
        hot &= often
        wanted, heated, out = names[often & ~hot], names[hot], [np.zeros(0, STRETCH)]
        for doc, tie, before, look in _looks(kernel, table):
            pick, split = np.flatnonzero(np.isin(look.sym, wanted)), np.flatnonzero(np.isin(look.sym, heated))
            text = np.concatenate([look.text[pick], np.repeat(look.text[split], look.n[split])])
            w0 = np.concatenate([look.w0[pick], B.expand(look.w0[split], look.n[split])])
            n = np.concatenate([look.n[pick], np.ones(len(w0) - len(pick), np.int64)])
            rows = np.zeros(len(text), STRETCH)
            rows["doc"], rows["tie"], rows["group"], rows["w0"], rows["n"] = doc[text], tie[text], group, w0 + before, n
            rows["seg"], rows["seg2"] = B.identities(*look.contents(text, w0, n), kernel.salt)
            rows["sym"], rows["rel"] = rows["seg"], 0
            rows["sym"][: len(pick)], rows["rel"][: len(pick)] = look.sym[pick], look.rel[pick]
            out.append(rows)
        firsts, gone = _firsts(np.concatenate(out), within)
        sent = _rows("bucket", _bucket(firsts["sym"], buckets) // span, firsts, p=-1, block=group // span)
        own = pa.table({"bucket": pa.array([group // span], pa.int64()), "data": pa.array([packed(_runs(gone))], pa.binary()), "p": pa.array([group], pa.int64()), "block": pa.array([group // span], pa.int64())})
        return pa.concat_tables([sent, own] if len(gone) else [sent])

    return work


def _parted(table: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """The stretches of a bucket, and the rows with finds that pass through."""
    found = pa.array([x >= 0 for x in table.column("p").to_pylist()], pa.bool_())
    rows = [unpacked(x, STRETCH) for p, x in zip(table.column("p").to_pylist(), table.column("data").to_pylist(), strict=True) if p < 0]
    return np.concatenate([np.zeros(0, STRETCH), *rows]), table.filter(found).select(["bucket", "data", "p"])


def _meet_early(within: bool, buckets: int):
    """Equal stretches of a block meet at a station on their way to the buckets of its shelf."""

    def work(key, table):
        rows, through = _parted(table)
        firsts, gone = _firsts(rows, within)
        finds = _finds(gone)
        finds = pa.table({"bucket": finds.column("p"), "data": finds.column("data"), "p": finds.column("p")})
        through = pa.table({"bucket": through.column("p"), "data": through.column("data"), "p": through.column("p")})
        return pa.concat_tables([_rows("bucket", _bucket(firsts["sym"], buckets), firsts, p=-1), finds, through])

    return work


def _finds(gone: np.ndarray) -> pa.Table:
    """What goes, a row for each group, with bucket -1."""
    parts = [gone[own] for own in _by(gone["group"])]
    return pa.table({"p": pa.array([int(x["group"][0]) for x in parts], pa.int64()), "data": pa.array([packed(_runs(x)) for x in parts], pa.binary()), "bucket": pa.array([-1] * len(parts), pa.int64())})


def _spread(gone: np.ndarray, span: int, bucket: int) -> pa.Table:
    """What goes, a row for each block, by way of the bucket's shelf."""
    runs = _runs(gone, SPREAD)
    return _rows("block", runs["group"].astype(np.int64) // span, runs, p=GONE, bucket=bucket // span)


def _hand_on():
    """A station gives each group of its block what buckets found and ask for."""

    def work(key, table):
        whose = np.array(table.column("p").to_pylist())
        asked, gone = (_joined(table.column("data").filter(pa.array(whose == p)), kind) for p, kind in ((ASKED, STRETCH), (GONE, SPREAD)))
        return pa.concat_tables([_finds(gone), _rows("p", asked["group"].astype(np.int64), asked, bucket=key[1].as_py())])

    return work


def _by(values: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(values, kind="stable")
    return [x for x in np.split(order, np.flatnonzero(np.diff(values[order])) + 1) if len(x)]


def _sort_stretches(within: bool, span: int):
    """within: an earlier place in the same text counts too. With blocks, rows for a station have its block."""

    def work(key, table):
        rows, through = _parted(table)
        left, gone = _firsts(rows, within)
        sym = _starts(left["sym"])
        ids = np.cumsum(sym) - 1
        several = np.bincount(ids, weights=_starts(left["sym"], left["seg"], left["seg2"]), minlength=1)[ids] > 1 if len(left) else np.zeros(0, bool)
        if not within and len(left):
            at = np.flatnonzero(sym)
            several &= (np.minimum.reduceat(left["doc"], at) != np.maximum.reduceat(left["doc"], at))[ids]
        asked = left[several]
        asked = asked[np.lexsort((asked["w0"], asked["tie"], asked["doc"]))]
        through = pa.table({"p": through.column("p"), "data": through.column("data"), "bucket": pa.array([-1] * len(through), pa.int64())})
        if span == 1:
            return pa.concat_tables([_finds(gone), through, _rows("p", asked["group"].astype(np.int64), asked, bucket=key[0].as_py())])
        ask = _rows("block", asked["group"].astype(np.int64) // span, asked, p=ASKED, bucket=key[0].as_py() // span)
        parts = [x.select(["p", "data", "bucket", "block"]) for x in (_spread(gone, span, key[0].as_py()), ask)]
        return pa.concat_tables([*parts, through.append_column("block", pa.array([-1] * len(through), pa.int64()))])

    return work


def _send_content(kernel, buckets: int, span: int):
    """sizes: bytes of content for each bucket of the shelf, in order."""

    def work(key, table, asked):
        wanted = [unpacked(x, STRETCH) for b, x in zip(asked.column("bucket").to_pylist(), asked.column("data").to_pylist(), strict=True) if b >= 0]
        out = {"bucket": [], "data": [], "content": [], "sizes": []}
        if wanted:
            rows = np.concatenate(wanted)
            rows = rows[np.lexsort((rows["w0"], rows["tie"], rows["doc"]))]
            bucket = _bucket(rows["sym"], buckets)
            table = _ordered(table)
            table = table.filter(pa.array(_starts(table.column("doc").to_numpy(), table.column("tie").to_numpy())))
            identity = np.zeros(len(table), [("doc", "i8"), ("tie", "i8")])
            identity["doc"], identity["tie"] = table.column("doc").to_numpy(), table.column("tie").to_numpy()
            place, row = np.searchsorted(identity, rows[["doc", "tie"]].astype(identity.dtype)), 0
            for piece in B.slices(iter(table.combine_chunks().to_batches()), "text", LOOK_BYTES):
                a, b = np.searchsorted(place, [row, row + len(piece)])
                if b > a:
                    content = kernel.content(*B.buffers(piece.column(piece.schema.get_field_index("text"))), place[a:b] - row, rows[a:b])
                    for shelf in _by(bucket[a:b] // span):
                        parts = [shelf[x] for x in _by(bucket[a:b][shelf])]
                        said = [content(own) for own in parts]
                        out["bucket"].append(int(bucket[a + shelf[0]] // span))
                        out["data"].append(packed(rows[a:b][np.concatenate(parts)]))
                        out["content"].append(b"".join(said))
                        out["sizes"].append(np.array([len(x) for x in said], np.int64).tobytes())
                row += len(piece)
        table = {"bucket": pa.array(out["bucket"], pa.int64())} | {k: pa.array(out[k], pa.binary()) for k in ("data", "content", "sizes")}
        return pa.table(table | {"block": pa.array([key[0].as_py() // span] * len(out["bucket"]), pa.int64())})

    return work


def _meet_content(buckets: int):
    """A station puts together what its block says to each bucket."""

    def work(key, table):
        held: dict[int, tuple[list, list]] = {}
        for data, content, sizes in zip(*(table.column(c).to_pylist() for c in ("data", "content", "sizes")), strict=True):
            rows, ends = unpacked(data, STRETCH), np.cumsum(np.frombuffer(sizes, np.int64))
            bucket = _bucket(rows["sym"], buckets)
            for own, a, b in zip(_by(bucket), [0, *ends[:-1]], ends, strict=True):
                stretches, said = held.setdefault(int(bucket[own[0]]), ([], []))
                stretches.append(rows[own])
                said.append(content[a:b])
        data, content = [packed(np.concatenate(x)) for x, _ in held.values()], [b"".join(x) for _, x in held.values()]
        return pa.table({"bucket": pa.array(list(held), pa.int64()), "data": pa.array(data, pa.binary()), "content": pa.array(content, pa.binary())})

    return work


def _match_content(kernel, span: int):
    def work(key, table):
        rows = _joined(table.column("data"), STRETCH)
        piece, window = kernel.match(rows, b"".join(table.column("content").to_pylist()))
        gone = rows[piece]
        gone["w0"] += window
        gone["n"] = 1
        return _finds(gone) if span == 1 else _spread(gone, span, key[0].as_py())

    return work


def _apply(kernel, carry: tuple[str, ...], characters: bool):
    def work(key, table, found):
        rows = np.concatenate([np.zeros(0, FOUND), *(unpacked(x, FOUND) for b, x in zip(found.column("bucket").to_pylist(), found.column("data").to_pylist(), strict=True) if b < 0)])
        rows = rows[np.lexsort((rows["w0"], rows["tie"], rows["doc"]))]
        new = _starts(rows["doc"], rows["tie"])
        at = np.append(np.flatnonzero(new), len(rows))
        spans = {(int(rows["doc"][a]), int(rows["tie"][a])): rows[a:b] for a, b in zip(at, at[1:], strict=False)}
        out = {k: [] for k in ("units", "removed", "spans", "kept")}
        empty = rows[:0]
        for doc, tie, text in zip(table.column("doc").to_pylist(), table.column("tie").to_pylist(), table.column("text").to_pylist(), strict=True):
            own = spans.get((doc, tie), empty)
            units, cuts, kept = kernel.cut((text or "").encode(), own["w0"], own["w0"] + own["n"] - 1 + kernel.window)
            out["units"].append(units)
            out["removed"].append(int((cuts[:, 1] - cuts[:, 0]).sum()))
            out["spans"].append(cuts.tolist())
            out["kept"].append(kept)
        more = {c: table.column(f"carry_{c}") for c in carry}
        if characters:
            more = {"characters": pa.array([x.decode("utf-8", "ignore") for x in out["kept"]], pa.string())} | more
        ids = [None if d == LEAST else d for d in table.column("doc").to_pylist()]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "units": pa.array(out["units"], pa.int64()), "removed": pa.array(out["removed"], pa.int64()), "spans": pa.array(out["spans"], pa.list_(pa.list_(pa.int64()))), "kept": pa.array(out["kept"], pa.binary())} | more)

    return work


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maximal runs (start, end) covered by the given ones, which are sorted by start."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return np.stack([starts[at], reach[np.append(at[1:], len(starts)) - 1]], axis=1)


def remove_repeats(documents: DataFrame, kernel, *, within: bool, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = (), characters: bool = False, group_bytes: int = GROUP_BYTES, hot: int = HOT, fan: int = FAN) -> DataFrame:
    """(doc_id, units, removed, spans, kept) per row: how many units (bytes or words) the text has and loses, the
    removed runs as [start, end) of units, and the UTF-8 bytes that stay. carry: columns of the input to return too.
    characters: a column of that name has what stays as text, without the rest of a character that was cut in two.
    group_bytes, hot and fan change how work is dealt, never results. Rows that repeat id and text are worked on once, so
    however many there are, they are no group of their own."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = documents.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    if rows.groupBy("doc", "tie").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _removed(documents, kernel, within=within, id_column=id_column, text_column=text_column, carry=carry, characters=characters, group_bytes=group_bytes, hot=hot, fan=fan)
    once = settle(rows.groupBy("doc", "tie").agg(F.first("text").alias("text")), "once")
    found = _removed(once, kernel, within=within, id_column="doc", text_column="text", carry=("tie",), characters=characters, group_bytes=group_bytes, hot=hot, fan=fan)
    back = rows.select(F.when(F.col("doc") != LEAST, F.col("doc")).alias("_doc"), F.col("tie").alias("_tie"), *[F.col(f"carry_{c}").alias(c) for c in carry])
    found = found.withColumnRenamed("tie", "_found")
    return back.join(found, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("_found"))).select("doc_id", "units", "removed", "spans", "kept", *["characters"] * characters, *carry)


def _removed(documents: DataFrame, kernel, *, within: bool, id_column: str, text_column: str, carry: tuple[str, ...], characters: bool, group_bytes: int, hot: int, fan: int) -> DataFrame:
    """What remove_repeats gives, for documents that each have an id and text of their own."""
    kernel = copy.copy(kernel)
    kernel.salt = secrets.token_bytes(16)
    groups = max(1, -(-bytes_of(documents, text_column) // group_bytes))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = documents.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    base = base.withColumn("p", F.pmod(F.xxhash64("doc", "tie"), F.lit(groups)))
    span = 1 if groups <= fan else math.isqrt(groups - 1) + 1
    over = lambda c: F.floor(F.col(c) / span).cast("long")
    answer, row = "p bigint, bucket bigint, data binary", "bucket bigint, data binary, p bigint"
    names = base.groupBy("p").applyInArrow(B.frugal(_send_names(kernel, groups, span)), row)
    if span == 1:
        answers = names.groupBy("bucket").applyInArrow(B.frugal(_answer_names(hot, NAME, "p")), answer)
    else:
        station = names.withColumn("block", over("p")).groupBy("bucket", "block")
        met = station.applyInArrow(B.frugal(_meet_names(groups)), "bucket bigint, data binary, block bigint")
        said = met.groupBy("bucket").applyInArrow(B.frugal(_answer_names(hot, MET, "block")), "block bigint, bucket bigint, data binary")
        answers = station.cogroup(said.groupBy(over("bucket"), "block")).applyInArrow(B.frugal(_hand_answers(groups)), answer)
    sent = base.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(B.frugal(_send_stretches(kernel, groups, within, span)), f"{row}, block bigint")
    sent = sent.drop("block") if span == 1 else sent.groupBy("bucket", "block").applyInArrow(B.frugal(_meet_early(within, groups)), row)
    ruled = "p bigint, data binary, bucket bigint"
    sorted_out = sent.groupBy("bucket").applyInArrow(B.frugal(_sort_stretches(within, span)), ruled if span == 1 else f"{ruled}, block bigint")
    if span > 1:
        handed = sorted_out.where("block >= 0").groupBy("block", "bucket").applyInArrow(B.frugal(_hand_on()), ruled)
        sorted_out = sorted_out.where("block < 0").drop("block").unionByName(handed)
    content = base.groupBy("p").cogroup(sorted_out.groupBy("p")).applyInArrow(B.frugal(_send_content(kernel, groups, span)), "bucket bigint, data binary, content binary, sizes binary, block bigint")
    if span > 1:
        content = content.groupBy("bucket", "block").applyInArrow(B.frugal(_meet_content(groups)), "bucket bigint, data binary, content binary")
    matched = content.groupBy("bucket").applyInArrow(B.frugal(_match_content(kernel, span)), ruled if span == 1 else "block bigint, data binary, p bigint, bucket bigint")
    if span > 1:
        matched = matched.groupBy("block", "bucket").applyInArrow(B.frugal(_hand_on()), ruled)
    found = sorted_out.unionByName(matched)
    return base.groupBy("p").cogroup(found.groupBy("p")).applyInArrow(B.frugal(_apply(kernel, carry, characters)), ", ".join(["doc_id bigint, units bigint, removed bigint, spans array<array<bigint>>, kept binary", *["characters string"] * characters, *[f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in carry]]))
