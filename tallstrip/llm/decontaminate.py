"""Benchmark decontamination: normalised test n-grams, token windows of the documents looked up in them, hits verified.

A small benchmark is broadcast as a set. A larger one stays in Spark: its windows are joined with those of the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._work import settle

#: Bytes of benchmark text up to which its set is broadcast.
BLOCK_BYTES = 2 << 20
#: Bits, as a power of two, of the sieve that says which windows of documents are worth a join; a fuller one lets more through.
LEAST_BITS, MOST_BITS = 20, 29
#: The sieve is put together in pieces of so many bits, as a power of two.
PIECE_BITS = 16


@dataclass(frozen=True)
class Rule:
    """words: window length. share: a document is contaminated if hits * share >= words."""

    words: int = 13
    share: int = 20


class NgramSet:
    """Windows of one block of benchmark items: sorted hashes by window length, with the items and words behind each."""

    def __init__(self, ids: list[str], texts: list[str], rule: Rule):
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, list[list[tuple[str, bytes]]]]] = {}
        raw, offsets = B.buffers(pa.array(texts, pa.string()))
        raw = B.LOWER[raw]
        starts, ends, first = B.words(raw, offsets, B.ALPHANUMERIC)
        names = B.word_hashes(raw, starts, ends)
        found: dict[int, dict[int, dict[tuple[str, bytes], None]]] = {}
        for i, item in enumerate(ids):
            n = int(first[i + 1] - first[i])
            size = min(n, rule.words)
            if not size:
                continue
            at = np.arange(first[i], first[i + 1] - size + 1)
            for j, h in zip(at, B.run_hashes(names[first[i] : first[i + 1]], int(size)), strict=True):
                said = b" ".join(raw[s:e].tobytes() for s, e in zip(starts[j : j + size], ends[j : j + size], strict=True))
                found.setdefault(size, {}).setdefault(int(h), {})[(item, said)] = None
        for size, windows in found.items():
            hashes = np.array(sorted(windows), np.uint64)
            sieve = np.zeros(1 << 20, bool)
            sieve[hashes >> np.uint64(44)] = True
            self.lengths[size] = (hashes, sieve, [list(windows[int(h)]) for h in hashes])

    def scan(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """Words of each text, which of all words are hit, and the items that occur in each text."""
        raw, offsets = B.buffers(array)
        raw = B.LOWER[raw]
        starts, ends, first = B.words(raw, offsets, B.ALPHANUMERIC)
        names = B.word_hashes(raw, starts, ends)
        hit, items = np.zeros(len(starts) + 1, np.int32), [set() for _ in range(len(array))]
        for size, (hashes, sieve, behind) in self.lengths.items():
            h = B.run_hashes(names, size)
            maybe = np.flatnonzero(sieve[h >> np.uint64(44)])
            place = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
            ok = hashes[place] == h[maybe]
            maybe, place = maybe[ok], place[ok]
            text = np.searchsorted(first, maybe, "right") - 1
            whole = maybe + size <= first[text + 1]
            for j, p, t in zip(maybe[whole], place[whole], text[whole], strict=True):
                said = b" ".join(raw[s:e].tobytes() for s, e in zip(starts[j : j + size], ends[j : j + size], strict=True))
                if real := [item for item, words in behind[p] if words == said]:
                    items[t].update(real)
                    hit[j] += 1
                    hit[j + size] -= 1
        return first, np.cumsum(hit[:-1]) > 0, items


def _kept(text, raw, span, starts, ends, own: np.ndarray, n: int, rule: Rule, remove: str):
    """What removal leaves of a text whose words `own` are hit; raw, span, starts and ends are its bytes and its words'."""
    if remove == "documents":
        return None if len(own) and rule.share * len(own) >= n else text.as_py()
    if remove != "spans" or not len(own):
        return text.as_py() if remove == "spans" else None
    cut = np.ones(span[1] - span[0], bool)
    for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
        cut[starts[run[0]] - span[0] : ends[run[-1]] - span[0]] = False
    return raw[span[0] : span[1]][cut].tobytes().decode()


def _item_windows(rule: Rule):
    """(size, said, item) of each window of the benchmark's items; said is its words."""

    def work(batches):
        for piece in B.slices(batches, "text"):
            raw, offsets = B.buffers(piece.column(1))
            raw = B.LOWER[raw]
            starts, ends, first = B.words(raw, offsets, B.ALPHANUMERIC)
            n = np.diff(first)
            size = np.minimum(n, rule.words)
            spans = np.where(n > 0, n - size + 1, 0)
            at, sizes, owner = B.expand(first[:-1], spans), np.repeat(size, spans), np.repeat(np.arange(len(n)), spans)
            h, names = np.empty(len(at), np.uint64), B.word_hashes(raw, starts, ends)
            for k in np.unique(sizes).tolist():
                h[sizes == k] = B.run_hashes(names, k)[at[sizes == k]]
            h = h.view(np.int64)
            for i in range(0, len(at), 10_000):
                own = slice(i, i + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(sizes[own], pa.int32()), pa.array(h[own]), pa.array(_said(raw, starts, ends, at[own], sizes[own]), pa.binary()), piece.column(0).take(pa.array(owner[own]))], names=["size", "h", "said", "item"])

    return work


def _said(raw, starts, ends, at, sizes) -> list[bytes]:
    return [b" ".join(raw[s:e].tobytes() for s, e in zip(starts[j : j + k], ends[j : j + k], strict=True)) for j, k in zip(at.tolist(), sizes.tolist(), strict=True)]


def _sieve_piece(key, table):
    bits = np.zeros(1 << PIECE_BITS, bool)
    bits[table.column("slot").to_numpy() & ((1 << PIECE_BITS) - 1)] = True
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _document_windows(rule: Rule, sizes: list[int], shared, bits: int):
    """(row, at, size, said) of the windows that pass the sieve."""

    def work(batches):
        for piece in B.slices(batches, "text"):
            raw, offsets = B.buffers(piece.column(1))
            raw = B.LOWER[raw]
            starts, ends, first = B.words(raw, offsets, B.ALPHANUMERIC)
            names = B.word_hashes(raw, starts, ends)
            for size in sizes:
                n = np.diff(first)
                spans = np.maximum(n - size + 1, 0)
                at, owner = B.expand(first[:-1], spans), np.repeat(np.arange(len(n)), spans)
                h = B.run_hashes(names, size)[at]
                slot = (h >> np.uint64(64 - bits)).astype(np.int64)
                maybe = np.flatnonzero(shared.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
                for i in range(0, len(maybe), 10_000):
                    own = maybe[i : i + 10_000]
                    said = _said(raw, starts, ends, at[own], np.full(len(own), size))
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(owner[own])), pa.array(at[own] - first[owner[own]], pa.int64()), pa.array([size] * len(own), pa.int32()), pa.array(h[own].view(np.int64)), pa.array(said, pa.binary())], names=["row", "at", "size", "h", "said"])

    return work


def _joined(docs: DataFrame, items: DataFrame, rule: Rule, remove: str) -> DataFrame:
    """What scanning gives, for items (item, text) of any size; docs has an id and a text."""
    spark, (id_column, text_column) = docs.sparkSession, docs.columns
    kind = docs.schema[id_column].dataType.simpleString()
    keyed = settle(docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_column).alias("text"), F.col(id_column).alias("id")), "rows")
    windows = settle(items.mapInArrow(B.frugal(_item_windows(rule)), "size int, h bigint, said binary, item string").groupBy("size", "h", "said").agg(F.array_sort(F.collect_set("item")).alias("items")), "windows")
    sizes = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * sum(sizes.values())).bit_length()))
    slots = windows.select(F.shiftrightunsigned("h", 64 - bits).alias("slot")).distinct().withColumn("piece", F.shiftright("slot", PIECE_BITS))
    sieve = np.zeros(1 << bits - 3, np.uint8)
    for r in slots.groupBy("piece").applyInArrow(B.frugal(_sieve_piece), "piece bigint, bits binary").toLocalIterator():
        sieve[r["piece"] << PIECE_BITS - 3 : r["piece"] + 1 << PIECE_BITS - 3] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(sieve)
    asked = keyed.select("row", "text").mapInArrow(B.frugal(_document_windows(rule, sorted(sizes), shared, bits)), "row bigint, at bigint, size int, h bigint, said binary")
    # windows that the same items share go by one number: a prompt of very many items costs a number an occurrence
    shared_by = settle(windows.select("items").distinct().withColumn("set", F.monotonically_increasing_id()), "sets")
    numbered = windows.join(shared_by, "items").select("size", "h", "said", "set")
    hits = settle(asked.join(numbered, ["size", "h", "said"]).groupBy("row").agg(F.collect_list("at").alias("at"), F.collect_list("size").alias("size"), F.collect_set("set").alias("sets")), "hits")
    named = hits.select("row", F.explode("sets").alias("set")).join(shared_by, "set").select("row", F.explode("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))

    def judge(batches):
        for piece in B.slices(batches, "text"):
            text = piece.column(1)
            raw, offsets = B.buffers(text)
            starts, ends, first = B.words(B.LOWER[raw], offsets, B.ALPHANUMERIC)
            n, kept, hit = np.diff(first), [], []
            for i, (at, size) in enumerate(zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True)):
                own = np.unique(B.expand(np.array(at, np.int64), np.array(size, np.int64))) if at else np.zeros(0, np.int64)
                hit.append(own)
                kept.append(_kept(text[i], raw, offsets[i : i + 2], starts[first[i] :], ends[first[i] :], own, n[i], rule, remove))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array([len(x) for x in hit], pa.int64()), piece.column(4), pa.array(kept, pa.string())], names=[id_column, "n_words", "n_hit", "item_ids", "kept_text"])

    met = keyed.join(hits, "row", "left").join(named, "row", "left").select("id", "text", "at", "size", F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"))
    return met.mapInArrow(B.frugal(judge), f"`{id_column}` {kind}, n_words bigint, n_hit bigint, item_ids array<string>, kept_text string")


def decontaminate(documents: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", remove: str = "none", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, item_ids (sorted as strings), contaminated, and kept_text.

    Words are lower-cased runs of digits, letters a-z and characters beyond ASCII. A window is `rule.words`
    consecutive words of an item, or all words of a shorter item. A document word inside an occurrence of a window is
    hit. remove: "none" leaves kept_text null; "spans" returns the text without the bytes from the first to the last
    word of each hit run; "documents" returns the text of clean documents and null for contaminated ones.

    Up to `block_bytes` of benchmark text are broadcast as a set. Windows of a larger benchmark are joined with those
    windows of the documents that pass a sieve of bounded size, with the same results. Null and empty texts have no
    words; repeated documents and items are judged row by row; an empty benchmark hits nothing; ids pass through as
    they are; other columns are not read.
    """
    spark = documents.sparkSession
    kind = documents.schema[id_column].dataType.simpleString()
    docs = documents.select(id_column, text_column)
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    contaminated = ((F.col("n_hit") > 0) & (F.col("n_hit") * rule.share >= F.col("n_words"))).alias("contaminated")
    if items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"] > block_bytes:
        return _joined(docs, items, rule, remove).select(id_column, "n_words", "n_hit", "item_ids", contaminated, "kept_text")
    rows = items.orderBy("item", "text").collect()

    def scanning(block):
        shared = spark.sparkContext.broadcast(NgramSet(*block, rule))

        def scan(batches):
            for piece in B.slices(batches, text_column):
                text = piece.column(1)
                first, hit, items = shared.value.scan(text)
                rows = {"ids": piece.column(0), "n": np.diff(first), "hits": [], "items": [sorted(x) for x in items], "kept": []}
                raw, offsets = B.buffers(text)
                starts, ends, _ = B.words(B.LOWER[raw], offsets, B.ALPHANUMERIC)
                for i in range(len(piece)):
                    own = np.flatnonzero(hit[first[i] : first[i + 1]])
                    rows["hits"].append(own)
                    kept = _kept(text[i], raw, offsets[i : i + 2], starts[first[i] :], ends[first[i] :], own, rows["n"][i], rule, remove)
                    rows["kept"].append(kept)
                arrays = [rows["ids"], pa.array(rows["n"], pa.int64()), pa.array(rows["hits"], pa.list_(pa.int32())), pa.array(rows["items"], pa.list_(pa.string())), pa.array(rows["kept"], pa.string())]
                names = [id_column, "n_words", "hits", "item_ids", "kept_text"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        schema = f"`{id_column}` {kind}, n_words bigint, hits array<int>, item_ids array<string>, kept_text string"
        return docs.mapInArrow(B.frugal(scan), schema)

    found = scanning(([r["item"] for r in rows], [r["text"] for r in rows])).withColumn("n_hit", F.size("hits").cast("long"))
    return found.select(id_column, "n_words", "n_hit", F.array_sort(F.array_distinct("item_ids")).alias("item_ids"), contaminated, "kept_text")


def keep_clean(documents: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), *, id_column: str = "doc_id") -> DataFrame:
    """The documents that aren't contaminated; a row with a null id stays."""
    found = decontaminate(documents, benchmark, rule, id_column=id_column).where("contaminated").select(id_column).distinct()
    return documents.join(found, id_column, "left_anti").select(*documents.columns)
