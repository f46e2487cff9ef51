"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a non-zero vector of radius + 1 bits. For each non-zero vector v there is one table, whose mask
keeps the positions with odd inner product with v. Two fingerprints that differ at up to `radius` positions are equal
under at least one mask, because `radius` vectors of radius + 1 bits leave some v orthogonal to all of them: no pair
within the radius is missed, whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._graph import components
from ._repeats import packed, unpacked
from ._work import discard, settle, slim

SEED = 42


@dataclass(frozen=True)
class Params:
    """shingle: words in a shingle. radius: differing bits of a link."""

    shingle: int = 3
    radius: int = 2


def fingerprint_array(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half of the shingles' XXH64; no words give zero."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    raw, offsets = B.buffers(texts)
    raw = raw.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        said = raw[a:b].lower().split()
        if len(said) <= shingle:
            counts.append(1 if said else 0)
            if said:
                hashes.append(digest(b" ".join(said), SEED))
            continue
        joined = b" ".join(said)
        ends = np.cumsum([len(w) + 1 for w in said])
        starts = [0, *ends[: len(said) - shingle].tolist()]
        hashes += [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        counts.append(len(starts))
    count = np.array(counts, np.int64)
    out = np.zeros(len(count), np.uint64)
    some = count > 0
    if some.any():
        values = np.array(hashes, np.uint64)
        place = np.concatenate([[0], np.cumsum(count[some])[:-1]])
        ones = np.empty((int(some.sum()), 64), np.int64)
        for bit in range(64):
            ones[:, bit] = np.add.reduceat((values >> np.uint64(bit)) & np.uint64(1), place).astype(np.int64)
        set_bits = (2 * ones > count[some][:, None]).astype(np.uint64)
        out[some] = (set_bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp bigint) per row. Words are lower-cased (A-Z) and split at ASCII white space; null texts have none."""
    kind = documents.schema[id_column].dataType.simpleString()

    def work(batches):
        for piece in B.slices(batches, text_column, 1 << 20):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fingerprint_array(piece.column(1), shingle).view(np.int64))], names=[id_column, "fp"])

    return documents.select(id_column, text_column).mapInArrow(B.frugal(work), f"`{id_column}` {kind}, fp bigint")


def masks(radius: int) -> list[int]:
    """One mask per table: 2**(radius+1) - 1 of them over 64 bits.

    While all non-zero vectors can be used evenly, they are; for more tables than bits the vectors with the top bit set
    are taken, so that no mask has fewer than 32 bits.
    """
    width = radius + 1
    every = (1 << width) - 1
    vectors = [1 + i % every if every <= 64 else 1 << radius | i % (1 << radius) for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 1 << width)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(fp: Column, radius: int, free: int) -> Column:
    """fp, and fp with one of the mask's free bits flipped: two values share one of these iff they differ at <= 2 free bits."""
    bits = [F.lit(_signed(1 << i)) for i in range(64) if free >> i & 1]
    near = F.array(F.lit(0).cast("long"), *bits)
    out = near
    for _ in range(radius // 2 - 1):
        out = F.array_distinct(F.flatten(F.transform(out, lambda x: F.transform(near, lambda y: x.bitwiseXOR(y)))))
    return F.transform(out, lambda x: x.bitwiseXOR(fp))


def links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) of row ids that connect exactly what the pairs of fingerprints within the radius connect.

    classes holds (fp, id), each fingerprint once. In each table only keys with two fingerprints or more go on. There,
    each fingerprint is listed under itself and under its neighbours at half the radius, within the bits its mask
    leaves free: those listed under one neighbour are all within the radius of each other, so each is linked to the
    smallest id there. No bucket is enumerated in pairs and none is capped; lists have at most 1 + free bits members
    at radius 2. The radius must be even.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    every = (1 << 64) - 1
    tables = [classes.select("fp", "id", F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(radius))]
    rows = tables[0]
    for other in tables[1:]:
        rows = rows.union(other)
    shared = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    rows = rows.join(shared, ["t", "key"])
    near = F.expr("array()").cast("array<bigint>")
    for t, m in enumerate(masks(radius)):
        near = F.when(F.col("t") == t, _flips(F.col("fp"), radius, every & ~m)).otherwise(near)
    listed = rows.select("id", F.explode(near).alias("z"))
    heads = listed.groupBy("z").agg(F.min("id").alias("v"), F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    return heads.select(F.explode("ids").alias("u"), "v").where("u != v").distinct()


def near_duplicates(documents: DataFrame, params: Params = Params(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp, component_id) per row: component_id is the smallest id reachable over links, the row's own included.

    Fingerprints link at `params.radius` or fewer differing bits. Equal fingerprints are one class with its smallest id
    before any search, so copies cost one row. Texts without words share fingerprint zero and link like any other.
    Repeated rows keep one result row each; a null id is kept with a null component unless its fingerprint class has an
    id; no documents give no rows; other columns are not read.
    """
    prints = settle(fingerprints(documents, id_column, text_column, params.shingle), "prints")
    classes = prints.groupBy("fp").agg(F.min(id_column).alias("id"))
    found = components(links(classes.where("id is not null"), params.radius))
    labels = classes.join(found, classes["id"] == found["node"], "left").select(F.col("fp").alias("class_fp"), F.coalesce("component", "id").alias("component_id"))
    return prints.join(labels, prints["fp"] == labels["class_fp"], "left").select(id_column, "fp", "component_id")


#: Bits within which the covering tables find pairs of near copies.
RADIUS = 2


def majorities(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of sets: a bit is set if it is set in over half of the set's hashes; empty sets have none."""
    out, at = np.zeros(len(counts), np.uint64), np.concatenate([[0], np.cumsum(counts)])
    some = np.flatnonzero(counts)
    for i in range(0, len(some), 64):
        own = some[i : i + 64]
        bits = np.unpackbits(values[at[own[0]] : at[own[-1] + 1]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[own] - at[own[0]], axis=0, dtype=np.int32)
        out[own] = np.packbits(2 * ones > counts[own][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


@dataclass(frozen=True)
class CopyParams:
    """shingle: words in a shingle. similarity: least Jaccard similarity of shingle sets."""

    shingle: int = 5
    similarity: float = 0.8


def _ragged_unique(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each run, sorted within it, and the runs' new lengths."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(counts))


def _shingles(texts: pa.Array, params: CopyParams) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of each text's set of shingles, sorted within it, how many they are, and a digest of its words."""
    raw, offsets = B.buffers(texts)
    raw = B.LOWER[raw]
    starts, ends, first = B.words(raw, offsets, B.SPACED)
    names, n = B.word_hashes(raw, starts, ends), np.diff(first)
    size = np.minimum(n, params.shingle)
    spans = np.where(n > 0, n - size + 1, 0)
    at = B.expand(first[:-1], spans)
    values, counts = _ragged_unique(B.chain_values(names, at, np.repeat(size, spans)), spans)
    return values, counts, [xxhash.xxh3_128_digest(names[a:b].tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


#: Bytes of a shingle's hash by which whole sets are compared.
NARROW = 5


def narrow(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NARROW].tobytes()


def similarity_of(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two whole sets of narrow hashes. Two empty sets are equal."""
    x, y = (np.frombuffer(d, np.uint8).reshape(-1, NARROW) for d in (a, b))
    wide = np.zeros((len(x) + len(y), 8), np.uint8)
    wide[: len(x), :NARROW], wide[len(x) :, :NARROW] = x, y
    every = len(np.unique(wide.view("<u8")))
    return (len(x) + len(y) - every) / every if every else 1.0


#: Bits of a set's parities.
PARITIES = 2048


def parities(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per set and slot, whether an odd number of its elements falls into the slot, as packed bits. Two sets differ by
    at least as many elements as their parities differ by bits."""
    out, at = np.zeros((len(counts), PARITIES // 8), np.uint8), np.concatenate([[0], np.cumsum(counts)])
    slot = (values & np.uint64(PARITIES - 1)).astype(np.int64)
    for i in range(0, len(counts), 500):
        n = counts[i : i + 500]
        owner = np.repeat(np.arange(len(n)), n)
        odd = np.bincount(owner * PARITIES + slot[at[i] : at[i + len(n)]], minlength=len(n) * PARITIES).reshape(len(n), PARITIES) & 1
        out[i : i + 500] = np.packbits(odd.astype(np.uint8), axis=1)
    return out


def _most_apart(similarity: float, sizes):
    """Sets that reach the similarity differ by at most this share of their sizes' sum."""
    return (1 - similarity) / (1 + similarity) * sizes + 1e-6


def _may_be_like(similarity: float):
    """Of pairs (a, b, their parities, their sizes) those whose parities don't rule the similarity out."""

    def work(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(batch), PARITIES // 64) for i in (2, 3))
            fits = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= _most_apart(similarity, batch.column(4).to_numpy() + batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(fits))

    return work


PAIR = np.dtype([("key", "u8"), ("rep", "i8")])
#: Bytes of packed keys that meet in a bucket.
BUCKET_BYTES = 12 << 20
#: Shingles that stand last in the order of keys: those in so many texts at least, and the most frequent of them.
#: Any order finds the same pairs; one with frequent shingles last makes small buckets.
OFTEN, LAST = 16, 100_000
#: Shingles of a task that are counted at a time.
COUNTED = 4 << 20
#: Texts that share a key are compared in one task up to so many, in blocks of so many beyond.
TOGETHER = 4096
#: Nearest candidates of a text in each other group that are compared by whole sets before all others.
NEAREST = 8
#: Texts that many others of a large bucket are compared with first, so that few are left for the blocks.
LEADERS = 256
#: Rows that meet in a task of comparisons, with their parities.
MET = 40_000


def _repeated(params: CopyParams):
    """Shingles that several texts of a task have, with how many."""

    def work(batches):
        held, n = [], 0

        def summed():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            values, counts = values[counts > 1], counts[counts > 1]
            for i in range(0, len(values), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(values[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000], pa.int64())], names=["shingle", "n"])

        for piece in B.slices(batches, "text"):
            values, _, _ = _shingles(piece.column(1), params)
            held.append(values)
            n += len(values)
            if n >= COUNTED:
                yield from summed()
                held, n = [], 0
        if n:
            yield from summed()

    return work


def prefix_sizes(counts: np.ndarray, similarity: float) -> np.ndarray:
    """How many first elements, in one order of all elements, sets must show for any two of the similarity to have one
    of these in common: |a & b| >= similarity * |a|, so not all the shared ones can stand behind them."""
    return counts - np.ceil(similarity * counts - 1e-9).astype(np.int64) + (counts > 0)


def _send_keys(params: CopyParams, frequent: np.ndarray, classes: np.ndarray, buckets: int):
    """From each text the first shingles of its set, packed by buckets; frequent ones (sorted, with classes of their
    frequency) come last."""

    def work(batches):
        for piece in B.slices(batches, "text"):
            values, counts, _ = _shingles(piece.column(1), params)
            if not len(values):
                continue
            often = np.zeros(len(values), np.int8)
            if len(frequent):
                place = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
                known = frequent[place] == values
                often[known] = classes[place[known]]
            owner = np.repeat(np.arange(len(counts)), counts)
            values = values[np.lexsort((values, often, owner))]
            shown = prefix_sizes(counts, params.similarity)
            rows = np.empty(int(shown.sum()), PAIR)
            rows["key"] = values[B.expand(np.cumsum(counts) - counts, shown)]
            rows["rep"] = np.repeat(piece.column(0).to_numpy(), shown)
            bucket = ((rows["key"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            found, starts = np.unique(bucket[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([packed(x) for x in np.split(rows[order], starts[1:])], pa.binary())], names=["bucket", "data"])

    return work


def _shared(key, table):
    """Keys that several texts have: (key, rep)."""
    rows = np.concatenate([unpacked(x, PAIR) for x in table.column("data").to_pylist()])
    rows = rows[np.lexsort((rows["rep"], rows["key"]))]
    rows = rows[np.append(True, (rows["key"][1:] != rows["key"][:-1]) | (rows["rep"][1:] != rows["rep"][:-1]))]
    at = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1]))
    n = np.repeat(np.diff(np.append(at, len(rows))), np.diff(np.append(at, len(rows))))
    rows = rows[n > 1]
    return pa.table({"key": rows["key"].view(np.int64), "rep": rows["rep"]})


def _compare(similarity: float):
    """Within each key and block: pairs (a, b) of different parts that sizes and parities leave open, where one of them
    asks; first: it is among the nearest of the other's part for one of them."""

    def work(key, table):
        key, block, rep, part, size = (table.column(c).to_numpy() for c in ("key", "block", "rep", "part", "size"))
        asks, odd = table.column("asks").to_numpy(zero_copy_only=False), np.frombuffer(b"".join(table.column("odd").to_pylist()), np.uint64).reshape(len(table), PARITIES // 64)
        order = np.lexsort((rep, block, key))
        edges = np.flatnonzero(np.append(True, (key[order][1:] != key[order][:-1]) | (block[order][1:] != block[order][:-1])))
        left, right, apart = [], [], []
        for own in np.split(order, edges[1:]):
            asking = own[asks[own]]
            step = max(1, 65_536 // len(own))
            for i in range(0, len(asking), step):
                some = asking[i : i + step]
                open_ = (part[some][:, None] != part[own]) & (np.minimum(size[some][:, None], size[own]) >= similarity * np.maximum(size[some][:, None], size[own]) - 1e-9)
                x, y = np.nonzero(open_)
                for j in range(0, len(x), 1 << 16):
                    p, q = some[x[j : j + (1 << 16)]], own[y[j : j + (1 << 16)]]
                    d = np.bitwise_count(odd[p] ^ odd[q]).sum(axis=1, dtype=np.int64)
                    ok = d <= _most_apart(similarity, size[p] + size[q])
                    left.append(p[ok])
                    right.append(q[ok])
                    apart.append(d[ok] / np.maximum(1, size[p] + size[q])[ok])
        none = np.zeros(0, np.int64)
        left, right, apart = (np.concatenate([none, *x]) for x in (left, right, apart))
        ids = np.stack([rep[left], rep[right]])
        _, at = np.unique(np.sort(ids, axis=0), axis=1, return_index=True)
        left, right, apart = left[at], right[at], apart[at]
        first = np.zeros(len(left), bool)
        for x, y in ((left, right), (right, left)):
            order = np.lexsort((apart, part[y], rep[x]))
            new = np.append(True, (rep[x[order]][1:] != rep[x[order]][:-1]) | (part[y[order]][1:] != part[y[order]][:-1]))[: len(order)]
            rank = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else none
            first[order[rank < NEAREST]] = True
        return pa.table({"a": np.minimum(rep[left], rep[right]), "b": np.maximum(rep[left], rep[right]), "first": first})

    return work


def _like(similarity: float):
    def work(batches):
        for batch in batches:
            got = [similarity_of(x, y) >= similarity for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(got, pa.bool_()))

    return work


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole sets reach the similarity. pairs: (a, b), a settled table."""
    ends = slim(settle(pairs.select("b").distinct(), "ends"))
    left = sets.join(slim(pairs), sets["rep"] == pairs["a"]).select("a", "b", F.col("whole").alias("x"))
    right = sets.join(ends, sets["rep"] == ends["b"], "left_semi").select(F.col("rep").alias("b"), F.col("whole").alias("y"))
    return left.join(right, "b").select("a", "b", "x", "y").mapInArrow(B.frugal(_like(similarity)), "a bigint, b bigint").distinct()


def _grouped(edges: DataFrame) -> DataFrame:
    return settle(components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "groups")


def _dealt(rows: DataFrame, together: int, leaders: int | None) -> DataFrame:
    """Rows (key, rep, part, odd, size) of keys with texts of several parts, dealt to blocks for `_compare`. All that a
    key's most frequent part does not hold ask. Keys with more than `together` texts are dealt to blocks, and those that
    ask go to each of them; with `leaders`, only such keys are taken, and each block gets so many texts of the frequent
    part and others that ask, instead of all."""
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    keys = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("part", F.struct("n", "part")).alias("major"), F.count("*").alias("parts")).where("parts > 1")
    met = rows.join(keys.select("key", "n", "major"), "key").withColumn("asks", F.col("part") != F.col("major"))
    blocks = F.ceil(F.col("n") / together).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    if leaders is None:
        to = F.when((blocks == 1) | ~F.col("asks"), F.array(own)).otherwise(F.sequence(F.lit(0), blocks - 1))
    else:
        met = met.where(blocks > 1)
        leads = F.pmod(F.xxhash64("rep", F.lit(1)), F.ceil(F.col("n") / leaders)) == 0
        to = F.when(leads, F.sequence(F.lit(0), blocks - 1)).when(F.col("asks"), F.array(own)).otherwise(F.expr("CAST(array() AS array<int>)"))
    return met.select("key", "rep", "part", "odd", "size", "asks", F.explode(to).alias("block"))


def near_copies(documents: DataFrame, params: CopyParams = CopyParams(), *, id_column: str = "doc_id", text_column: str = "text", together: int = TOGETHER, leaders: int = LEADERS) -> DataFrame:
    """(id, component_id) per row with a non-null id: groups of texts whose shingle sets have the given similarity.

    Covering tables over 64-bit fingerprints of the shingles find pairs within the radius, but no radius covers all pairs
    of a Jaccard similarity. So texts that share one of the first shingles of their sets (`prefix_sizes`), in an order
    that has frequent ones last, are candidates too: no pair of the similarity lacks one, wherever and however the texts
    differ. Keys that the same texts have count as one. In the first round each text is compared with one of those it shares most keys with (edited copies have their
    original in common) and with its neighbours in the covering tables. Texts joined by that need no comparison with each
    other. In the second round, under each key, those outside the key's most frequent group are compared with all of
    other groups: pairs whose sizes or parities prove that they are less similar go at once, of the others the nearest
    come first, and then all that are still apart. So every pair that shares a key has been compared or joined. A key of
    very many texts is dealt to blocks, after its texts were compared with some leaders.

    Whole shingle sets decide, however long the texts are. Texts of equal words are one class throughout.
    Texts without words are copies of each other. Rows with equal ids are one text: what is similar to one of them is
    similar to it.
    """
    docs = documents.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    held: list[DataFrame] = []

    def held_back(rows: DataFrame, tag: str) -> DataFrame:
        """A table that goes when the groups are known."""
        held.append(settle(rows, tag))
        return held[-1]

    def digesting(batches):
        for piece in B.slices(batches, "text"):
            values, counts, digests = _shingles(piece.column(1), params)
            odd = [x.tobytes() for x in parities(values, counts)]
            arrays = [piece.column(0), pa.array(digests, pa.binary()), pa.array(odd, pa.binary()), pa.array(counts, pa.int64()), pa.array(majorities(values, counts).view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "digest", "odd", "size", "fp"])

    made = settle(docs.mapInArrow(B.frugal(digesting), "id bigint, digest binary, odd binary, size bigint, fp bigint"), "digests")
    classes = settle(made.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    reps = slim(classes.select("rep"))
    prints = held_back(made.join(reps, made["id"] == reps["rep"], "left_semi").select(F.col("id").alias("rep"), "odd", "size", "fp").distinct(), "prints")
    texts = docs.join(reps, docs["id"] == reps["rep"], "left_semi").select(F.col("id").alias("rep"), "text")

    def listing(batches):
        for piece in B.slices(batches, "text"):
            values, counts, _ = _shingles(piece.column(1), params)
            end = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([narrow(values[b - k : b]) for b, k in zip(end.tolist(), counts.tolist(), strict=True)], pa.binary())], names=["rep", "whole"])

    counted = texts.mapInArrow(B.frugal(_repeated(params)), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    last = counted.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(LAST).toPandas().sort_values("shingle", key=lambda x: x.to_numpy(np.int64).view(np.uint64))
    frequent, often = last["shingle"].to_numpy(np.int64).view(np.uint64), np.log2(last["n"].to_numpy(np.float64)).astype(np.int8)
    sizes = prints.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-int(sizes * (1 - params.similarity)) * PAIR.itemsize // BUCKET_BYTES))
    sent = texts.mapInArrow(B.frugal(_send_keys(params, frequent, often, buckets)), "bucket bigint, data binary")
    shared = settle(sent.groupBy("bucket").applyInArrow(B.frugal(_shared), "key bigint, rep bigint"), "shared")
    # of the keys that the same texts have, one is enough: they would all ask for the same comparisons
    marks = [F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x")]
    once = shared.groupBy("key").agg(*marks).groupBy("n", "s", "x").agg(F.min("key").alias("key"), F.count("*").alias("times"))
    keys = held_back(shared.join(once.select("key", "n", "times"), "key"), "keys")
    discard(shared)

    # first round: one text of those it shares keys with, and the covering tables
    central = keys.groupBy("rep").agg(F.sum(F.col("n") * F.col("times")).alias("central"))
    lead = keys.join(central, "rep").groupBy("key").agg(F.max_by("rep", F.struct("central", -F.col("rep"))).alias("leader"))
    met = keys.join(lead, "key").where("rep != leader").groupBy("rep", "leader").agg(F.sum("times").alias("n"))
    stars = met.groupBy("rep").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("leader"))
    alike = prints.groupBy("fp").agg(F.min("rep").alias("id"))
    covered = links(alike, RADIUS).select(F.col("u").alias("rep"), F.col("v").alias("leader"))
    same = prints.join(alike, "fp").where("rep != id").select("rep", F.col("id").alias("leader"))
    pairs = held_back(stars.union(covered).union(same).select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct(), "pairs")
    fits = F.least("m", "n") >= params.similarity * F.greatest("m", "n") - 1e-9
    told = prints.select(F.col("rep").alias("a"), F.col("odd").alias("x"), F.col("size").alias("m")).join(slim(pairs), "a").join(prints.select(F.col("rep").alias("b"), F.col("odd").alias("y"), F.col("size").alias("n")), "b").where(fits)
    told = told.select("a", "b", "x", "y", "m", "n").mapInArrow(B.frugal(_may_be_like(params.similarity)), "a bigint, b bigint")
    pairs = held_back(told.distinct(), "pairs")
    needed = slim(held_back(keys.select("rep").union(pairs.select("a")).union(pairs.select("b")).distinct(), "needed"))
    sets = held_back(texts.join(needed, "rep", "left_semi").mapInArrow(B.frugal(listing), "rep bigint, whole binary"), "sets")
    edges = held_back(_links(pairs, sets, params.similarity), "links")
    grouped = _grouped(edges)

    # second round: what shares a key and is still apart
    def apart(grouped: DataFrame) -> DataFrame:
        rows = keys.select("key", "rep").join(grouped, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("part"))
        mixed = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("key")
        return rows.join(mixed, "key", "left_semi").join(prints.select("rep", "odd", "size"), "rep").select("key", "rep", "part", "odd", "size")

    def candidates(dealt: DataFrame) -> DataFrame:
        dealt = held_back(dealt, "dealt")
        tasks = max(1, dealt.count() // MET)
        by = dealt.withColumn("task", F.pmod(F.xxhash64("key", "block"), F.lit(tasks)))
        found = by.groupBy("task").applyInArrow(B.frugal(_compare(params.similarity)), "a bigint, b bigint, first boolean")
        return held_back(found.groupBy("a", "b").agg(F.max("first").alias("first")), "candidates")

    def joined(pairs: DataFrame, edges: DataFrame, grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
        ends = grouped.select(F.col("node").alias("a"), F.col("component").alias("ca")), grouped.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        still = held_back(pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b"), "pairs")
        if still.isEmpty():
            return edges, grouped
        edges = edges.unionByName(held_back(_links(still, sets, params.similarity), "links"))
        return edges, _grouped(edges)

    if not keys.where(F.col("n") > together).isEmpty():
        edges, grouped = joined(candidates(_dealt(apart(grouped), together, leaders)), edges, grouped)
    found = candidates(_dealt(apart(grouped), together, None))
    for some in (found.where("first"), found.where("NOT first")):
        edges, grouped = joined(some, edges, grouped)
    for done in held:
        discard(done)
    members = made.select("id", "digest").join(classes, "digest").select(F.col("id").alias(id_column), "rep")
    return members.join(grouped, F.col("rep") == F.col("node"), "left").select(id_column, F.coalesce("component", "rep").alias("component_id"))


def keep_one(documents: DataFrame, params: CopyParams = CopyParams(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without near copies: of each group the smallest id stays, once if that id repeats; the rest of the
    columns stay as they are. Rows with a null id are all kept: they can't be told apart."""
    found = near_copies(documents, params, id_column=id_column, text_column=text_column)
    lost = found.where(F.col(id_column) != F.col("component_id")).select(id_column).distinct()
    twice = documents.groupBy(id_column).agg(F.count("*").alias("n")).where(f"n > 1 AND `{id_column}` IS NOT NULL").select(id_column)
    kept = documents.join(lost, id_column, "left_anti").select(*documents.columns)
    once = kept.join(twice, id_column, "left_anti").select(*documents.columns)
    order = Window.partitionBy(id_column).orderBy(F.xxhash64(text_column))
    repeated = kept.join(twice, id_column, "left_semi").select(*documents.columns).withColumn("tallstrip_row", F.row_number().over(order)).where("tallstrip_row = 1").drop("tallstrip_row")
    return once.unionByName(repeated)
