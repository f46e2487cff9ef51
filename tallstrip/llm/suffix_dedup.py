"""Suffix-array deduplication of long byte strings, by column-wise construction over many texts at once.

Stretches of text are aligned at their anchors, so equal windows stand in the same columns. The columns are gone through
from the last to the first. Each round puts one symbol in front of every stretch's suffix and brings the order of the
suffixes (the collection's suffix array, whose symbols in that order are its Burrows-Wheeler transform for the column)
and the common prefixes of neighbours up to date from those of the round before. Neighbours with a common prefix of a
whole window are repeats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import _bytes as B
from ._repeats import Look, merged, remove_repeats, stretches


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, from prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def range_minimum(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last] (inclusive) for many ranges, from minima of runs of powers of two."""
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out, rows = np.empty(len(first), values.dtype), values
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            rows = np.minimum(rows[: -(1 << k - 1)], rows[1 << k - 1 :])
        own = level == k
        if own.any():
            out[own] = np.minimum(rows[first[own]], rows[last[own] - (1 << k) + 1])
    return out


class ByteWindows:
    """Windows of so many bytes; the anchor is the least hash of the grams in a window, the first of equal ones."""

    def __init__(self, window: int = 100, gram: int = 24):
        self.window, self.gram = window, min(gram, window)

    def pieces(self, raw: np.ndarray, size: int):
        """A long text in pieces (bytes, offsets, bytes before); every window is whole in one piece."""
        for a in range(0, len(raw), size):
            part = raw[a : a + size + self.window - 1]
            yield part, np.array([0, len(part)]), a

    def look(self, raw: np.ndarray, offsets: np.ndarray) -> Look:
        size, none = len(raw), np.zeros(0, np.int64)
        digest = lambda start, length, seed: B.chain_bytes(raw, start, start + length, seed)
        contents = lambda start, length: (raw, start, start + length)
        if size < self.window:
            return stretches(offsets, none, none, self.gram, self.window, digest, contents)
        eight, at, grams = B.eights(raw), np.arange(size - self.gram + 1), None
        for i in range(0, self.gram, 8):
            block = eight[i : i + len(at)] if i + 8 <= self.gram else eight[i : i + len(at)] & np.uint64((1 << 8 * (self.gram - i)) - 1)
            grams = B.mix(block + np.uint64(1)) if grams is None else B.mix(grams ^ block)
        bits = np.uint64(size.bit_length())
        packed = (grams >> bits << bits) | at.astype(np.uint64)
        anchor = (sliding_minimum(packed, self.window - self.gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        inside = np.zeros(len(anchor) + 1, np.int8)  # +1 where a text's windows start, -1 where they end
        long = np.flatnonzero(np.diff(offsets) >= self.window)
        np.add.at(inside, offsets[long], 1)
        np.add.at(inside, offsets[long + 1] - self.window + 1, -1)
        start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        return stretches(offsets, start, anchor[start], self.gram, self.window, digest, contents)

    def content(self, raw: np.ndarray, offsets: np.ndarray, text: np.ndarray, rows: np.ndarray):
        """The bytes of the stretches."""
        start, length = offsets[text] + rows["w0"], rows["n"].astype(np.int64) + self.window - 1
        return lambda own: raw[B.expand(start[own], length[own])].tobytes()

    def match(self, rows: np.ndarray, content: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(stretch, window in it) of windows that occur earlier in another stretch, column by column."""
        raw = np.frombuffer(content, np.uint8)
        rel, n = rows["rel"].astype(np.int64), rows["n"].astype(np.int64)
        length = n + self.window - 1
        origin = np.cumsum(length) - length + rel  # where a stretch has column 0
        rank = np.empty(len(rows), np.int64)
        rank[np.lexsort((rows["w0"] + rows["rel"], rows["tie"], rows["doc"]))] = np.arange(len(rows))
        last, first = length - rel - 1, -rel
        by_last, by_first = np.argsort(-last, kind="stable"), np.argsort(-first, kind="stable")
        entering = np.searchsorted(-last[by_last], -np.arange(last.max(initial=0), first.min(initial=0) - 1, -1), "right") if len(rows) else []
        order, common, entered, left = np.zeros(0, np.int64), np.zeros(0, np.int32), 0, 0
        out_piece, out_window = [], []
        for column, until in zip(range(int(last.max(initial=0)), int(first.min(initial=0)) - 1, -1), entering, strict=True) if len(rows) else []:
            if until > entered:  # stretches that end here have an empty suffix, before all others
                fresh = by_last[entered:until]
                order, common = np.concatenate([fresh, order]), np.concatenate([np.zeros(len(fresh), np.int32), common])
                entered = until
            symbol = raw[origin[order] + column]
            into = np.argsort(symbol, kind="stable")
            ordered, following = symbol[into], np.zeros(len(order), np.int32)
            same = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
            following[same] = np.minimum(range_minimum(common, into[same - 1] + 1, into[same]) + 1, self.window)
            order, common = order[into], following
            head = common < self.window
            if not head.all():
                at = np.flatnonzero(head)
                least = np.minimum.reduceat(rank[order], at)
                gone = np.flatnonzero(rank[order] > least[np.cumsum(head) - 1])
                out_piece.append(order[gone])
                out_window.append(column + rel[order[gone]])
            stay = first[order] < column
            if not stay.all():
                keep = np.flatnonzero(stay)
                if len(keep):
                    at = np.concatenate([[0], keep[:-1] + 1])
                    common = np.minimum.reduceat(common[: keep[-1] + 1], at)
                    common[0] = 0
                else:
                    common = common[:0]
                order = order[keep]
        if not out_piece:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_piece), np.concatenate(out_window)

    def cut(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, np.ndarray, bytes]:
        cuts = merged(starts, ends)
        at = [0, *cuts.ravel().tolist(), len(text)]
        return len(text), cuts, b"".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def suffix_dedup(documents: DataFrame, window: int = 100, *, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """(doc_id, units, removed, spans, kept) per row: bytes, removed bytes, removed runs [start, end) and what stays.

    A byte goes if a string of `window` bytes that covers it also starts earlier, in a text with a smaller id or further
    up in the same text. Strings are judged on the input and never cross texts. A null text is an empty one; a null id
    comes before all others. Different texts under one id are ordered by a hash of the text; identical rows are one text
    and have one result each. Texts shorter than the window lose nothing; no documents give no rows; other columns are not
    read, except that those in carry are returned as they are. characters: adds a column of that name, what stays as text;
    of a character that a removed run cut in two, the remaining bytes go as well.
    """
    return remove_repeats(documents, ByteWindows(window), within=True, id_column=id_column, text_column=text_column, carry=carry, characters=characters)
