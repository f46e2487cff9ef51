"""Removal of repeated word sequences by recompression.

Rounds of naming shorten all texts at once: runs of one token get a name by token and length, then pairs of a token of
the left and one of the right class (a bit of the token's hash, anew in each round) get a name by both. Names are hashes
of what they stand for, so every task gives equal parts equal names without asking another. Each symbol carries the
words that its making depended on; where those lie inside a window, any equal window has the same symbol at the same
place. Texts that share such a symbol are compared there, window by window and word by word.
"""

from __future__ import annotations

import secrets

import numpy as np
from pyspark.sql import DataFrame

from . import _bytes as B
from ._repeats import Look, merged, remove_repeats, stretches
from .suffix_dedup import range_minimum

_RUN, _LEFT, _RIGHT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def recompress(names: np.ndarray, first: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after the rounds, and the words [low, high) that each depended on; first: where texts begin and end.

    A wall stands before and behind each text; what depends on a wall reaches over the text's end, so no window of the
    text holds it.
    """
    walls = np.unique(first)
    symbol = np.insert(names, walls, 0)
    place = np.insert(np.arange(len(names)), walls, -1)
    wall = place < 0
    low, high = place.copy(), place + 1
    low[wall], high[wall] = walls - 1, walls + 1
    for r in range(rounds):
        # runs
        new = np.ones(len(symbol), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | wall[1:] | wall[:-1]
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(symbol)))
        end = at + count - 1
        symbol = np.where(count > 1, B.mix(symbol[at] * _RUN + count.astype(np.uint64)), symbol[at])
        wall_, before, after = wall[at], low[np.maximum(at - 1, 0)], high[np.minimum(end + 1, len(low) - 1)]
        low, high, wall = np.where(wall_, low[at], before), np.where(wall_, high[at], after), wall_
        # pairs
        right = (B.mix(symbol + np.uint64((r + 1) * int(_LEFT) % (1 << 64))) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(symbol), bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~wall[:-1] & ~wall[1:]
        second = np.zeros(len(symbol), bool)
        second[1:] = pair[:-1]
        following, preceding = np.append(np.arange(1, len(symbol)), len(symbol) - 1), np.maximum(np.arange(len(symbol)) - 1, 0)
        named = np.where(pair, B.mix(symbol * _LEFT ^ B.mix(symbol[following] * _RIGHT + np.uint64(r))), symbol)
        new_low = np.where(right & ~second & ~wall, low[preceding], low)
        new_high = np.where((~right | pair) & ~wall, high[following], high)
        keep = ~second
        symbol, low, high, wall = named[keep], new_low[keep], new_high[keep], wall[keep]
    keep = ~wall
    return symbol[keep], low[keep], high[keep]


def word_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words, found by hashes and then compared block by block."""
    length = ends - starts
    _, at, number = np.unique(B.word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    same = length == length[at[number]]
    eight, done = B.eights(raw), 0
    left = np.flatnonzero(same)
    while len(left):
        keep = np.uint64((1 << 64) - 1) >> (np.uint64(8) * (np.uint64(8) - np.minimum(length[left] - done, 8).astype(np.uint64)))
        same[left] &= (eight[starts[left] + done] ^ eight[starts[at[number[left]]] + done]) & keep == 0
        done += 8
        left = left[same[left] & (length[left] > done)]
    if not same.all():  # different words with one hash
        found: dict[bytes, int] = {}
        number = np.array([found.setdefault(raw[a:b].tobytes(), len(found)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return number.astype(np.int64)


def spaced(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space behind each, and where in that the runs of `count` words from `first` on begin and end."""
    length = ends - starts
    at = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(at[-1], 0x20, np.uint8)
    out[B.expand(at[:-1], length)] = raw[B.expand(starts, length)]
    return out, at[first], at[first + count]


class WordWindows:
    """Windows of so many words; the anchor is the symbol with the least hash among those that depend on the window
    alone, or where there is none, the window itself. Words are hashed under a seed of each instance's own."""

    def __init__(self, window: int = 50, rounds: int = 3):
        self.window, self.rounds, self.seed = window, rounds, secrets.randbits(63)

    def pieces(self, raw: np.ndarray, size: int):
        """A long text in pieces (bytes, offsets, words before); every window is whole in one piece."""
        starts, ends, _ = B.words(raw, np.array([0, len(raw)]), B.SPACED)
        step = max(1, len(starts) * size // max(1, len(raw)))
        for a in range(0, len(starts), step):
            part = raw[starts[a] : ends[min(a + step + self.window - 1, len(ends)) - 1]]
            yield part, np.array([0, len(part)]), a

    def look(self, raw: np.ndarray, offsets: np.ndarray) -> Look:
        starts, ends, first = B.words(raw, offsets, B.SPACED)
        names = B.word_hashes(raw, starts, ends, self.seed)
        digest = lambda start, length, seed: B.chain_values(names, start, length, seed)
        contents = lambda start, length: spaced(raw, starts, ends, start, length)
        long = np.flatnonzero(np.diff(first) >= self.window)
        if not len(long):
            none = np.zeros(0, np.int64)
            return stretches(first, none, none, 0, self.window, digest, contents)
        symbol, low, high = recompress(names, first, self.rounds)
        window = B.expand(first[long], np.diff(first)[long] - self.window + 1)
        lo, hi = np.searchsorted(low, window), np.searchsorted(high, window + self.window, "right") - 1
        bits = np.uint64(len(symbol).bit_length())
        packed = (B.mix(symbol) >> bits << bits) | np.arange(len(symbol)).astype(np.uint64)
        some = hi >= lo
        chosen = np.zeros(len(window), np.int64)
        chosen[some] = (range_minimum(packed, lo[some], hi[some]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        return stretches(first, window, np.where(some, low[chosen], -1), np.where(some, (high - low)[chosen], 0), self.window, digest, contents)

    def content(self, raw: np.ndarray, offsets: np.ndarray, text: np.ndarray, rows: np.ndarray):
        """The words of the stretches."""
        starts, ends, first = B.words(raw, offsets, B.SPACED)
        at, n = first[text] + rows["w0"], rows["n"].astype(np.int64) + self.window - 1

        def said(own):
            begin, length = starts[at[own]], ends[at[own] + n[own] - 1] - starts[at[own]]
            out = np.full(int((length + 1).sum()), 0x20, np.uint8)
            out[B.expand(np.cumsum(length + 1) - length - 1, length)] = raw[B.expand(begin, length)]
            return out.tobytes()

        return said

    def match(self, rows: np.ndarray, content: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(stretch, window in it) of windows under the same name that a text with a smaller id has too. Words are
        compared by their bytes, and windows by their words: runs of twice as many words are named by pairs of names."""
        raw, n = np.frombuffer(content, np.uint8), rows["n"].astype(np.int64)
        starts, ends, _ = B.words(raw, np.array([0, len(raw)]), B.SPACED)
        held, reach = word_numbers(raw, starts, ends), 1
        pairs = lambda a, b: np.unique(a * np.int64(len(starts)) + b, return_inverse=True)[1].astype(np.int64)
        while 2 * reach <= self.window:
            held, reach = pairs(held[:-reach], held[reach:]), 2 * reach
        if reach < self.window:
            held = pairs(held[: reach - self.window], held[self.window - reach :])
        piece, window = np.repeat(np.arange(len(rows)), n), B.expand(np.zeros(len(rows), np.int64), n)
        number = held[B.expand(np.cumsum(n + self.window - 1) - (n + self.window - 1), n)]
        order = np.lexsort((rows["doc"][piece], number))
        doc, number = rows["doc"][piece[order]], number[order]
        new = np.ones(len(order), bool)
        new[1:] = number[1:] != number[:-1]
        least = doc[new][np.cumsum(new) - 1]
        gone = order[doc > least]
        return piece[gone], window[gone]

    def cut(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, np.ndarray, bytes]:
        words = text.split()
        cuts = merged(starts, ends)
        at = [0, *cuts.ravel().tolist(), len(words)]
        kept = [w for a, b in zip(at[::2], at[1::2], strict=True) for w in words[a:b]]
        return len(words), cuts, b" ".join(kept)


def recompression_dedup(documents: DataFrame, window: int = 50, rounds: int = 3, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, units, removed, spans, kept) per row: words, removed words, removed runs [start, end) and what stays,
    its words joined by one space.

    A word (bytes between ASCII white space, unchanged) goes if a window of `window` words that covers it also starts in
    a text with a smaller id. Windows are judged on the input. A null text has no words; a null id comes before all
    others; rows under one id are no smaller than each other, so repeated rows lose nothing to each other. Texts of
    fewer words lose nothing; no documents give no rows; other columns are not read.
    """
    return remove_repeats(documents, WordWindows(window, rounds), within=False, id_column=id_column, text_column=text_column)
