"""Best-fit packing by hierarchical residual packing.

Each task tokenises its documents, cuts what is too long, packs its pieces best-fit and closes the nearly full
sequences. All underfull ones become items of the next rounds, where they are dealt at random to as many groups as they
fill, so that each group has all lengths; this goes on while a round saves a sequence a group. What few sequences that
could still be joined meet up a tree until one group is left. One that is less than three quarters full is taken apart
first.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._work import settle


@dataclass(frozen=True)
class Params:
    """capacity: tokens in a sequence. vocabulary: file of the byte-level BPE in ranks form, whole: the same as a
    tokeniser's file, special: its text of a
    special token and that token's id; end: id put after each document. fan: groups that meet in a round of the tree.
    open_bins: emptiest sequences a group hands on there, after rounds of all underfull ones have stopped saving any.
    dealt: pieces of a group in those rounds."""

    capacity: int = 2048
    vocabulary: str | None = None
    whole: str | None = None
    special: tuple[str, int] = ("<|endoftext|>", 50256)
    end: int = 0
    fan: int = 8
    open_bins: int = 64
    dealt: int = 50_000


def _encoder(params: Params):
    """Ids of a text. The vocabulary has the same ids in both forms; the ranks form is several times faster to apply, but
    its expressions give up on very long runs of white space, which the other form then takes."""
    import public_tokenizers
    import tiktoken

    with open(params.vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict([params.special]))
    whole: list = []

    def encode(text: str) -> list[int]:
        try:
            return coder.encode(text, allowed_special="all")
        except ValueError:
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(params.whole or public_tokenizers.path("byte_bpe_50k.json")))
            return whole[0].encode(text, add_special_tokens=False).ids

    return encode


class BestFit:
    """Bins of one capacity; an item goes to the fullest bin that still takes it."""

    def __init__(self, capacity: int):
        self.capacity, self.room, self.of_room, self.bins = capacity, [], {}, []

    def add(self, size: int, members: list) -> None:
        at = bisect_left(self.room, size)
        if at < len(self.room):
            left = self.room[at]
            stack = self.of_room[left]
            bin_ = stack.pop()
            if not stack:
                del self.of_room[left]
                self.room.pop(at)
        else:
            left, bin_ = self.capacity, []
            self.bins.append(bin_)
        bin_ += members
        left -= size
        if left:
            if left not in self.of_room:
                self.of_room[left] = []
                self.room.insert(bisect_left(self.room, left), left)
            self.of_room[left].append(bin_)

    def emptiest(self, count: int) -> list[list]:
        """The bins with most room, at most `count` of them."""
        out = []
        for room in reversed(self.room):
            out += self.of_room[room]
            if len(out) >= count:
                break
        return out[:count]


ITEM = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


#: A sequence with less room than this share of it is closed.
SLACK = 1 / 64


def _rows(packer: BestFit, count: int | None, group: int, level: int):
    """Per bin: sequence_id, whether it is closed, and its members. All underfull ones stay open, or the `count` emptiest."""
    full = packer.capacity * (1 - SLACK)
    going = {id(b) for b in packer.bins if sum(x["length"] for x in b) <= full} if count is None else {id(b) for b in packer.emptiest(count)}
    for i, members in enumerate(packer.bins):
        yield (level << 58) | (group << 30) | i, id(members) not in going, members


def _batch(rows) -> pa.RecordBatch:
    item = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    sequence, closed, group, members = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(sequence, pa.int64()), pa.array(closed, pa.bool_()), pa.array(group, pa.int64()), pa.array(members, pa.list_(item))], names=["sequence_id", "closed", "group", "members"])


_NAMES = ("doc_id", "piece", "start", "length", "ids_crc32")
_SCHEMA = f"sequence_id bigint, closed boolean, `group` bigint, members array<struct<{ITEM.replace(' bigint', ': bigint').replace(' int,', ': int,')}>>"


def _first_round(params: Params):
    def work(batches):
        encode, items = _encoder(params), []
        for piece in B.slices(batches):
            for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), params.end], "<u4")
                odd = len(ids) % params.capacity
                cuts = [0, *range(odd or params.capacity, len(ids), params.capacity), len(ids)]
                items += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        items.sort(key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1], x[4]))
        packer, group = BestFit(params.capacity), TaskContext.get().partitionId()
        for item in items:
            packer.add(item[3], [dict(zip(_NAMES, item, strict=True))])
        rows = [(sequence, closed, group, members) for sequence, closed, members in _rows(packer, None, group, 0)]
        for i in range(0, len(rows), 5000):
            yield _batch(rows[i : i + 5000])

    return work


def _merge(params: Params, level: int, count: int | None):
    def work(key, table):
        bins = sorted(table.column("members").to_pylist(), key=lambda m: (-sum(x["length"] for x in m), m[0]["doc_id"] is not None, m[0]["doc_id"] or 0, m[0]["piece"]))
        packer, group = BestFit(params.capacity), key[0].as_py()
        items = []
        for members in bins:
            whole = 4 * sum(x["length"] for x in members) >= 3 * params.capacity
            items += [members] if whole else [[x] for x in members]
        for members in sorted(items, key=lambda m: -sum(x["length"] for x in m)):
            packer.add(sum(x["length"] for x in members), members)
        return pa.Table.from_batches([_batch([(s, closed, group, m) for s, closed, m in _rows(packer, count, group, level)])])

    return work


def pack(documents: DataFrame, params: Params = Params(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then `params.end`; a null or empty text is that end alone. One longer than the capacity
    is cut into full pieces, the first one shorter. Repeated documents and repeated ids are packed as often as they
    come, a null id stays null; no documents give no rows; other columns are not read. A task holds five numbers per
    piece, never the ids. Groups have about `dealt` pieces in rounds of all underfull sequences, and `open_bins` sequences
    from each of `fan` groups in the tree above, so no group grows with the input.
    """
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    level, bins = 0, settle(docs.mapInArrow(B.frugal(_first_round(params)), _SCHEMA), "bins")
    done, groups = [], 1
    n = bins.agg(F.count(F.when(~F.col("closed"), 1)).alias("open"), F.sum(F.when(~F.col("closed"), F.size("members"))).alias("pieces"), F.countDistinct("group").alias("groups")).first()
    while n["groups"] > 1 and n["open"]:
        level, groups, before = level + 1, -(-n["pieces"] // params.dealt), n["open"]
        done.append(bins.where("closed"))
        dealt = bins.where("not closed").select(F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(groups)).alias("group"), "members")
        bins = settle(dealt.groupBy("group").applyInArrow(B.frugal(_merge(params, level, None)), _SCHEMA), "bins")
        n = bins.agg(F.count("*").alias("bins"), F.count(F.when(~F.col("closed"), 1)).alias("open"), F.sum(F.when(~F.col("closed"), F.size("members"))).alias("pieces"), F.lit(groups).alias("groups")).first()
        if before - n["bins"] < groups:
            break
    while groups > 1:
        level, groups = level + 1, -(-groups // params.fan)
        done.append(bins.where("closed"))
        upper = bins.where("not closed").select((F.col("group") / params.fan).cast("bigint").alias("group"), "members")
        bins = settle(upper.groupBy("group").applyInArrow(B.frugal(_merge(params, level, params.open_bins)), _SCHEMA), "bins")
    for part in done:
        bins = bins.unionByName(part)
    placed = bins.select("sequence_id", "members", F.expr("transform(members, (m, i) -> aggregate(slice(members, 1, i), 0L, (a, x) -> a + x.length))").alias("offsets"))
    rows = placed.select("sequence_id", F.explode(F.arrays_zip("members", "offsets")).alias("x"))
    return rows.select("x.members.doc_id", "x.members.piece", "x.members.start", "x.members.length", "x.members.ids_crc32", "sequence_id", F.col("x.offsets").alias("offset"))
