"""Importance resampling towards a target: hashed runs of words, weighed by how much more frequent the target has them.

Each task builds word tries over blocks of its texts: a node is a run of one to three words, and holds how often the run
occurs and the CRC state after it, from which its children's go on. Tries give their counts to buckets, tasks their
buckets to one sum. For scoring, nodes get their bucket's gain, and a document's weight is the sum along its paths.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from . import _bytes as B
from ._work import settle
from .recompression import word_numbers


@dataclass(frozen=True)
class Params:
    """depth: words in the longest feature. buckets: that features are hashed to. share: percent of the eligible
    documents that are drawn. least: words of an eligible document. seed: of the draw. block: words in a trie."""

    depth: int = 3
    buckets: int = 10_000
    share: int = 5
    least: int = 20
    seed: int = 42
    block: int = 200_000


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


CRC = _crc_table()
SPACE = np.uint32(0x20)
#: Words of more bytes are hashed one at a time.
LONG_WORD = 256


def crc_on(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, space: bool) -> np.ndarray:
    """CRC-32 of what each state stands for, then (a space and) a span of bytes."""
    reg = ~state.astype(np.uint32)
    if space:
        reg = CRC[(reg ^ SPACE) & np.uint32(0xFF)] ^ (reg >> np.uint32(8))
    length = ends - starts
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        reg[i] = ~np.uint32(zlib.crc32(raw[starts[i] : ends[i]].tobytes(), int(~reg[i])))
    order = np.argsort(np.where(length > LONG_WORD, 0, -length), kind="stable")  # the longest first, so those that go on are a slice
    at, rest = starts[order], np.where(length > LONG_WORD, 0, length)[order]
    held = reg[order]
    for k in range(int(rest.max(initial=0))):
        m = int(np.searchsorted(-rest, -k, "left"))
        held[:m] = CRC[(held[:m] ^ raw[at[:m] + k]) & np.uint32(0xFF)] ^ (held[:m] >> np.uint32(8))
    reg[order] = held
    return ~reg


class Trie:
    """The runs of words that begin at the words a to b of some texts. By level: the node at which the path from each
    word arrives (-1: the text ends before), and each node's CRC state. stop: the word behind each word's text."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, stop: np.ndarray, a: int, b: int, depth: int):
        last = min(b + depth - 1, len(starts))
        number = word_numbers(raw, starts[a:last], ends[a:last])
        words, at = np.unique(number, return_index=True)
        self.nodes, self.states = [], []
        node, state = number[: b - a], np.zeros(len(words), np.uint32)
        state[words] = crc_on(np.zeros(len(words), np.uint32), raw, starts[a + at], ends[a + at], False)
        first = np.zeros(len(words), np.int64)
        first[words] = a + at
        for level in range(depth):
            self.nodes.append(node)
            self.states.append(state)
            if level + 1 == depth:
                break
            on = np.flatnonzero((node >= 0) & (np.arange(a, b) + level + 1 < stop[a:b]))
            child, place = np.unique(node[on] * len(words) + number[on + level + 1], return_inverse=True)
            word = first[child % max(1, len(words))]
            state = crc_on(state[child // max(1, len(words))], raw, starts[word], ends[word], True)
            node = np.full(b - a, -1, np.int64)
            node[on] = place

    def counts(self, buckets: int) -> np.ndarray:
        total = np.zeros(buckets, np.int64)
        for node, state in zip(self.nodes, self.states, strict=True):
            np.add.at(total, (state % np.uint32(buckets)).astype(np.int64), np.bincount(node[node >= 0], minlength=len(state)))
        return total

    def along(self, gains: np.ndarray) -> np.ndarray:
        """For each word, the gains on its path added up."""
        total = np.zeros(len(self.nodes[0]), np.int64)
        for node, state in zip(self.nodes, self.states, strict=True):
            of_node = gains[state % np.uint32(len(gains))]
            on = node >= 0
            total[on] += of_node[node[on]]
        return total


def _tries(piece: pa.RecordBatch, column: str, params: Params) -> tuple[np.ndarray, Iterator[tuple[int, int, Trie]]]:
    """The words before each text of the piece (one more than texts), and tries over blocks of words [a, b)."""
    raw, offsets = B.buffers(piece.column(piece.schema.get_field_index(column)))
    raw = B.LOWER[raw]
    starts, ends, first = B.words(raw, offsets, B.ALPHANUMERIC)
    stop = np.repeat(first[1:], np.diff(first))

    def blocks():
        for a in range(0, len(starts), params.block):
            b = min(a + params.block, len(starts))
            yield a, b, Trie(raw, starts, ends, stop, a, b, params.depth)

    return first, blocks()


def bucket_counts(texts: DataFrame, text_column: str = "text", params: Params = Params()) -> np.ndarray:
    """How many features of the texts each bucket holds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(params.buckets, np.int64)
        for piece in B.slices(batches):
            for _, _, trie in _tries(piece, "text", params)[1]:
                total += trie.counts(params.buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    parts = texts.select(F.col(text_column).cast("string").alias("text")).mapInArrow(B.frugal(work), "bucket bigint, n bigint")
    out = np.zeros(params.buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: how much more frequent its features are in the target, in thousandths of the natural logarithm."""
    s, t, buckets = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(documents: DataFrame, gain: np.ndarray, params: Params = Params(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) per row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in B.slices(batches):
            first, tries = _tries(piece, "text", params)
            total = np.zeros(len(piece), np.int64)
            for a, b, trie in tries:
                up_to = np.concatenate([[0], np.cumsum(trie.along(gain))])
                inside = np.clip(first, a, b) - a
                total += up_to[inside[1:]] - up_to[inside[:-1]]
            words = np.diff(first)
            features = sum(np.maximum(words - k, 0) for k in range(params.depth))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(words), pa.array(features), pa.array(total)], names=["doc_id", "n_words", "n_features", "weight"])

    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return docs.mapInArrow(B.frugal(work), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(id_: Column, seed: int) -> Column:
    """A draw from the Gumbel distribution, in thousandths: taking the highest sums of it and the logarithms of weights
    samples without replacement."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resample(documents: DataFrame, target: DataFrame, params: Params = Params(), *, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row; rank is null where the document is not drawn.

    Words are runs of digits, lower-cased letters and anything beyond ASCII in the whole text; a null or empty text has
    none, hence weight 0. A null id draws like the text "null" and comes first among equal scores. Repeated rows count and
    are drawn as often as they come. An empty target leaves gains that only tell frequent from rare; no documents give no
    rows; other columns are not read. Tasks hold one trie of `block` words at a time, and one number per bucket.
    """
    gain = gains(bucket_counts(documents, text_column, params), bucket_counts(target, target_column, params))
    scored = settle(weights(documents, gain, params, id_column=id_column, text_column=text_column).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), params.seed)), "scored")
    eligible = scored.where(F.col("n_words") >= params.least)
    drawn = params.share * eligible.count() // 100
    ranked = numbered(eligible, "rank", F.desc("score"), F.asc_nulls_first("doc_id")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < params.least).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
