"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, over the bytes of running text.

Words are joined by one space, and grams run across it. Trusted documents are dealt to two folds by a hash of their text,
and each fold has a model of its own; every document is scored by the model of the other fold, so no document and no
exact copy of it is judged by counts it is part of. Counts are sharded by the two bytes before the predicted one: all
shorter forms of a gram that have such a context lie in its shard, and those below are a table of a few thousand rows.
Chunks of documents ask the shards for the grams they need. A document is rejected if its perplexity is above a quantile
of the trusted documents' in its language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._work import bytes_of, settle, steady

#: Bytes that stand before and behind each text.
BEFORE, BEHIND, SPACE = 0x02, 0x03, 0x20
#: Bytes of text that are cut into chunks together, one of each fold.
CHUNK_BYTES = 8 << 20
#: Ids of trusted documents up to which they are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of text for a shard, and the least and most shards.
SHARD_BYTES, LEAST_SHARDS, MOST_SHARDS = 4 << 20, 16, 4096
#: Different grams that a task gathers before it sends them, and messages of a shard that are summed together.
GATHERED, FAN = 2_000_000, 256
#: Bytes of needs that meet in one task.
NEED_BYTES = 16 << 20


@dataclass(frozen=True)
class Params:
    """order: bytes in a gram, from 3 to 7. quantile: of the trusted documents' log-perplexity in a language."""

    order: int = 5
    quantile: float = 0.99


def suffix(keys: np.ndarray) -> np.ndarray:
    """Each gram without its first byte."""
    order = keys >> np.int64(56)
    return keys & ((np.int64(1) << np.int64(8) * (order - 1)) - 1) | (order - 1) << np.int64(56)


def prefix(keys: np.ndarray) -> np.ndarray:
    """Each gram without its last byte: its context."""
    order = keys >> np.int64(56)
    return (keys & ((np.int64(1) << np.int64(8) * order) - 1)) >> np.int64(8) | (order - 1) << np.int64(56)


class Grams:
    """The gram that predicts each byte of some texts, the longest there is: keys (its length, then its bytes), and
    where each text's begin. A text without words has none."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, order: int):
        starts, ends, first = B.words(raw, offsets, B.SPACED)
        length, n = ends - starts, np.diff(first)
        some = np.flatnonzero(n)
        stream = np.full(int((length + 1).sum()) + len(some), SPACE, np.uint8)
        owner = np.searchsorted(first, np.arange(len(starts)), "right") - 1
        place = np.cumsum(length + 1) - length + np.searchsorted(some, owner)  # a text's first byte stands before its words
        begin = place[first[some]] - 1
        inside = np.ones(len(stream), bool)
        inside[place + length] = inside[begin] = False
        stream[inside] = raw[B.SPACED[raw]]
        stream[begin], stream[(place + length)[first[some + 1] - 1]] = BEFORE, BEHIND
        held = np.diff(np.append(begin, len(stream))) - 1
        sizes = np.zeros(len(n), np.int64)
        sizes[some] = held
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        packed, short = stream.astype(np.int64), []
        for n in range(2, order + 1):
            shifted = stream[: max(0, len(stream) - n + 1)].astype(np.int64)
            shifted <<= np.int64(8 * (n - 1))
            packed[n - 1 :] |= shifted
            del shifted
            if n < order:
                own = begin[held >= n - 1] + n - 1
                short.append((own, packed[own] & np.int64((1 << 8 * n) - 1) | np.int64(n << 56)))
        packed &= np.int64((1 << 8 * order) - 1)
        packed |= np.int64(order << 56)
        for own, grams in short:
            packed[own] = grams
        inside[:] = True
        inside[begin] = False
        self.top = packed[inside]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the two bytes before the predicted one; shorter grams are in every shard's reach."""
    context = ((keys >> np.int64(8)) & np.int64(0xFFFF)).astype(np.uint64)
    return np.where(keys >> np.int64(56) > 2, (B.mix(context + np.uint64(1)) % np.uint64(shards)).astype(np.int64), 0)


def _by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    values, at = np.unique(shard[order], return_index=True)
    return list(zip(values.tolist(), np.split(order, at[1:]), strict=True)) if len(values) else []


_COUNTS = "fold int, shard int, keys binary, counts binary"


def _count(order: int, shards: int):
    """From trusted texts (text, fold): the grams that predict their bytes, with counts, by folds and shards."""

    def work(batches):
        held = {0: [], 1: []}

        def summed(fold):
            keys, inverse = np.unique(np.concatenate([k for k, _ in held[fold]]), return_inverse=True)
            return keys, np.bincount(inverse, weights=np.concatenate([c for _, c in held[fold]]), minlength=len(keys)).astype(np.int64)

        def sent(fold):
            keys, counts = summed(fold)
            held[fold] = []
            rows = [(fold, shard, keys[own].tobytes(), counts[own].tobytes()) for shard, own in _by_shard(keys, shards)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["fold", "shard", "keys", "counts"])

        for piece in B.slices(batches, "text", CHUNK_BYTES):
            for fold in held:
                own = piece.filter(pa.array(piece.column(1).to_numpy() == fold))
                top = Grams(*B.buffers(own.column(0)), order).top
                if not len(top):
                    continue
                codes, keys = pd.factorize(top)
                held[fold].append((keys, np.bincount(codes, minlength=len(keys))))
                if sum(len(k) for k, _ in held[fold]) > GATHERED:
                    held[fold] = [summed(fold)]
                    if len(held[fold][0][0]) > GATHERED // 2:
                        yield sent(fold)
        for fold in held:
            if held[fold]:
                yield sent(fold)

    return work


def _added(table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.int64)


def _add(key, table):
    keys, counts = _added(table)
    return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})


def _kinds(longer: np.ndarray, starting: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Grams one byte shorter: how many different ones they end, and for those at a text's start how often they occur."""
    keys, counts = np.unique(suffix(longer), return_counts=True)
    keys, counts = np.concatenate([keys, starting[0]]), np.concatenate([counts, starting[1]])
    into = np.argsort(keys)
    return keys[into], counts[into].astype(np.int64)


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.array([(counts == i).sum() for i in (1, 2, 3, 4)], np.int64)


def _build(order: int):
    """A shard's grams of three bytes and more with their Kneser-Ney counts, counts of these by length, and its part of
    the grams of two bytes. Grams of the full length and at a text's start have their counts, others the number of
    different bytes seen before them."""

    def work(key, table):
        keys, counts = _added(table)
        length, levels, cc, longer = keys >> np.int64(56), [], [], np.zeros(0, np.int64)
        for n in range(order, 1, -1):
            own = length == n
            level = _kinds(longer, (keys[own], counts[own])) if n < order else (keys[own], counts[own])
            longer = level[0]
            levels.append(level)
            cc.append(counts_of_counts(level[1]))
        low = levels.pop()
        row = {"fold": key[0].as_py(), "shard": key[1].as_py()}
        data = {"keys": np.concatenate([k for k, _ in levels[::-1]]), "counts": np.concatenate([c for _, c in levels[::-1]]), "low": low[0], "low_counts": low[1], "cc": np.concatenate(cc[:-1])}
        return pa.table({k: pa.array([v], pa.int32()) for k, v in row.items()} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in data.items()} | {"grams": pa.array([len(data["keys"])], pa.int64())})

    return work


_MODEL = "fold int, shard int, keys binary, counts binary, low binary, low_counts binary, cc binary, grams bigint"


def discounts(cc: np.ndarray) -> np.ndarray:
    """What is taken off counts of one, two and more, from counts of counts one to four."""
    n = cc.astype(np.float64)
    y = n[0] / max(n[0] + 2 * n[1], 1.0)
    return np.array([0.0, *(max(0.05, min(float(i), i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i)) for i in (1, 2, 3))])


def _less(counts: np.ndarray, taken: np.ndarray) -> np.ndarray:
    return np.minimum(taken[np.minimum(counts, 3)], counts)


def _low_order(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability of each byte after each byte, from the grams of two bytes; unseen bytes share what is left evenly."""
    table = np.zeros((256, 256), np.int64)
    table[(keys >> np.int64(8)) & np.int64(0xFF), keys & np.int64(0xFF)] = counts
    single = (table > 0).sum(axis=0)
    p1 = np.full(256, 1 / 256)
    if single.sum():
        off = _less(single, discounts(counts_of_counts(single)))
        p1 = (single - off) / single.sum() + off.sum() / single.sum() / 256
    off = _less(table, discounts(counts_of_counts(table[table > 0])))
    total = table.sum(axis=1, keepdims=True)
    return np.where(total > 0, (table - off + off.sum(axis=1, keepdims=True) * p1) / np.maximum(total, 1), p1)


def _bounded(rows: DataFrame, order: int) -> dict[int, tuple[np.ndarray, dict[int, np.ndarray]]]:
    """By fold: the table of two bytes and the discounts by length. At most 65,536 grams and a few sums of a fold come to
    the driver, whatever the corpus."""

    def opened(batches):
        for batch in batches:
            for fold, low, counts, cc in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                low, counts, cc = (np.frombuffer(x, np.int64) for x in (low, counts, cc))
                lengths = np.repeat(np.arange(order, 2, -1), 4) * 4 + np.tile(np.arange(4), order - 2)
                key, value = np.concatenate([low, -1 - lengths]), np.concatenate([counts, cc])
                yield pa.RecordBatch.from_arrays([pa.array([fold] * len(key), pa.int32()), pa.array(key), pa.array(value)], names=["fold", "key", "n"])

    got = rows.select("fold", "low", "low_counts", "cc").mapInArrow(B.frugal(opened), "fold int, key bigint, n bigint").groupBy("fold", "key").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for fold in (0, 1):
        own = got[got["fold"] == fold]
        key, n = own["key"].to_numpy(np.int64), own["n"].to_numpy(np.int64)
        cc = np.zeros((order + 1, 4), np.int64)
        slot = -1 - key[key < 0]
        cc[slot // 4, slot % 4] = n[key < 0]
        out[fold] = _low_order(key[key >= 0], n[key >= 0]), {k: discounts(cc[k]) for k in range(3, order + 1)}
    return out


class Shard:
    """Probabilities of a shard's grams, from the shortest up."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: np.ndarray, taken: dict[int, np.ndarray], order: int):
        self.low, self.levels = low, {}
        for n in range(3, order + 1):
            a, b = np.searchsorted(keys, [n << 56, (n + 1) << 56])
            own, c = keys[a:b], counts[a:b]
            context, of = np.unique(prefix(own), return_inverse=True)
            off = _less(c, taken[n])
            total, free = np.bincount(of, weights=c, minlength=len(context)), np.bincount(of, weights=off, minlength=len(context))
            below = low[(own >> np.int64(8)) & np.int64(0xFF), own & np.int64(0xFF)] if n == 3 else self.levels[n - 1][1][np.searchsorted(self.levels[n - 1][0], suffix(own))]
            keep = free / total if len(total) else free
            self.levels[n] = own, (c - off) / total[of] + keep[of] * below, context, keep

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Log-probability of each gram's last byte after the others."""
        length = wanted >> np.int64(56)
        p = self.low[(wanted >> np.int64(8)) & np.int64(0xFF), wanted & np.int64(0xFF)]
        for n, (keys, probability, context, keep) in self.levels.items():
            own = np.flatnonzero(length >= n)
            if not len(keys) or not len(own):
                continue
            gram = wanted[own] & np.int64((1 << 8 * n) - 1) | np.int64(n << 56)
            before = prefix(gram)
            at, c = np.minimum(np.searchsorted(keys, gram), len(keys) - 1), np.minimum(np.searchsorted(context, before), len(context) - 1)
            p[own] = np.where(keys[at] == gram, probability[at], np.where(context[c] == before, keep[c], 1.0) * p[own])
        return np.log(p)


def _chunks(batches):
    """Texts (doc, lang, text, fold) packed and compressed in chunks of one fold; a chunk is what is scored at once."""
    import zstandard

    pack, part, at = zstandard.ZstdCompressor(3).compress, TaskContext.get().partitionId(), 0
    for piece in B.slices(batches, "text", CHUNK_BYTES):
        for fold in (0, 1):
            own = piece.filter(pa.array(piece.column(3).to_numpy() == fold))
            if not len(own):
                continue
            raw, offsets = B.buffers(own.column(2))
            row = (part << 24 | at, fold, pack(own.select([0, 1]).serialize().to_pybytes()), offsets.tobytes(), pack(raw.tobytes()))
            at += 1
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "fold", "ids", "offsets", "text"])


def _texts(table, row: int):
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(table.column("text")[row].as_py())
    return np.frombuffer(raw, np.uint8), np.frombuffer(table.column("offsets")[row].as_py(), np.int64)


def _need(order: int, shards: int, salts: np.ndarray):
    """The grams that scoring a chunk asks for, by shards; a chunk asks the model of the other fold."""

    def work(key, table):
        chunk, fold = key[0].as_py(), 1 - table.column("fold")[0].as_py()
        keys = pd.factorize(Grams(*_texts(table, 0), order).top)[1]
        rows = [(fold, shard, (chunk ^ chunk >> 24) % int(salts[fold, shard]), chunk, keys[own].tobytes()) for shard, own in _by_shard(keys, shards)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.table({k: pa.array(x, t) for k, x, t in zip(("fold", "shard", "salt", "chunk", "keys"), columns, kinds, strict=True)})

    return work


def _answer(order: int, shared):
    def work(key, needs, rows):
        low, taken = shared.value[key[0].as_py()]
        model = [np.frombuffer(rows.column(c)[0].as_py(), np.int64) for c in ("keys", "counts")] if len(rows) else [np.zeros(0, np.int64)] * 2
        shard = Shard(*model, low, taken, order)
        out = [shard(np.frombuffer(data, np.int64)).astype(np.float32).tobytes() for data in needs.column("keys").to_pylist()]
        return pa.table({"chunk": needs.column("chunk"), "shard": needs.column("shard"), "answers": pa.array(out, pa.binary())})

    return work


def _score(order: int, shards: int):
    def work(key, table, answers):
        grams = Grams(*_texts(table, 0), order)
        codes, keys = pd.factorize(grams.top)
        told = dict(zip(answers.column("shard").to_pylist(), answers.column("answers").to_pylist(), strict=True))
        values = np.zeros(len(keys))
        for shard, own in _by_shard(keys, shards):
            values[own] = np.frombuffer(told[shard], np.float32)
        sums = np.concatenate([[0.0], np.cumsum(values[codes])])
        ids = _ids(table, 0)
        return pa.table({"doc": ids.column(0), "lang": ids.column(1), "n_bytes": pa.array(np.diff(grams.bounds), pa.int64()), "log_p": pa.array(np.diff(sums[grams.bounds]), pa.float64())})

    return work


def _ids(table, row: int) -> pa.RecordBatch:
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress(table.column("ids")[row].as_py())
    return pa.ipc.read_record_batch(plain, pa.schema([("doc", pa.int64()), ("lang", pa.string())]))


def score(documents: DataFrame, trusted: DataFrame, params: Params = Params(), *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(doc, lang, n_bytes, log_p) per document; trusted holds the ids (id_column) of documents to learn from. Chunks are
    numbered by where their texts lie, so documents that come out of an exchange are settled first."""
    docs = documents.select(F.col(id_column).cast("long").alias("doc"), F.coalesce(F.col(lang_column).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    docs = steady(docs.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")), "texts")
    size, order = bytes_of(docs, "text"), params.order
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, size // SHARD_BYTES))
    ids = trusted.select(F.col(id_column).cast("long").alias("doc")).where("doc is not null").distinct()
    learned = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc", "left_semi").select("text", "fold")
    counts = learned.mapInArrow(B.frugal(_count(order, shards)), _COUNTS)
    if size > FAN * GATHERED * 8:  # very many messages of a shard are summed in parts first
        salted = counts.withColumn("salt", F.pmod(F.xxhash64("keys"), F.lit(size // (FAN * GATHERED * 8))))
        counts = salted.groupBy("fold", "shard", "salt").applyInArrow(B.frugal(_add), _COUNTS)
    model = settle(counts.groupBy("fold", "shard").applyInArrow(B.frugal(_build(order)), _MODEL), "model")
    shared = documents.sparkSession.sparkContext.broadcast(_bounded(model, order))
    share, grams = np.zeros((2, shards)), model.select("fold", "shard", "grams").toPandas()
    share[grams["fold"], grams["shard"]] = grams["grams"] / max(1, grams["grams"].sum())
    salts = np.maximum(1, np.ceil(share * size / NEED_BYTES)).astype(np.int64)
    dealt = documents.sparkSession.createDataFrame([(f, s, int(salts[f, s])) for f in (0, 1) for s in range(shards)], "fold int, shard int, n int")
    dealt = dealt.select("fold", "shard", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"))
    chunks = docs.mapInArrow(B.frugal(_chunks), "chunk bigint, fold int, ids binary, offsets binary, text binary")
    needs = chunks.groupBy("chunk").applyInArrow(B.frugal(_need(order, shards, salts)), "fold int, shard int, salt int, chunk bigint, keys binary")
    met = dealt.join(model.select("fold", "shard", "keys", "counts"), ["fold", "shard"])
    answers = needs.groupBy("fold", "shard", "salt").cogroup(met.groupBy("fold", "shard", "salt")).applyInArrow(B.frugal(_answer(order, shared)), "chunk bigint, shard int, answers binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(B.frugal(_score(order, shards)), "doc bigint, lang string, n_bytes bigint, log_p double")


def classify(documents: DataFrame, labels: DataFrame, params: Params = Params(), *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(id, lang, n_bytes, log_perplexity, threshold, accepted) per document.

    labels has id_column, quality and toxic; documents labelled quality 1 and toxic 0 (or null) are trusted, all of
    them. log_perplexity is in nats per byte, spaces and the text's end counting as bytes. threshold is the quantile of the
    trusted documents of the language, which are scored like all others by a model that has not seen them. A language
    without trusted documents has the threshold of all; without any at all, everything is accepted. Texts without words
    (null and empty ones) have no bytes, no log-perplexity, and are accepted: there is nothing against them. A null
    language is "". Repeated rows stay and count as often as they come; extra columns are not read.
    """
    trusted = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(id_column).distinct()
    scores = settle(score(documents, trusted, params, id_column=id_column, text_column=text_column, lang_column=lang_column), "scores")
    mean = F.when(F.col("n_bytes") > 0, -F.col("log_p") / F.col("n_bytes"))
    known = scores.join(trusted.withColumnRenamed(id_column, "doc"), "doc", "left_semi").where("n_bytes > 0").select("lang", mean.alias("m"))
    limit = F.percentile_approx("m", params.quantile, 10000).alias("threshold")
    by_lang = known.groupBy("lang").agg(limit)
    overall = known.agg(limit).first()["threshold"]
    joined = scores.join(F.broadcast(by_lang) if by_lang.count() <= 10_000 else by_lang, "lang", "left")
    threshold = F.coalesce("threshold", F.lit(None if overall is None else float(overall)).cast("double"))
    return joined.select(F.col("doc").alias(id_column), "lang", "n_bytes", mean.alias("log_perplexity"), threshold.alias("threshold"), F.coalesce(mean <= threshold, F.lit(True)).alias("accepted"))


def keep_accepted(documents: DataFrame, labels: DataFrame, params: Params = Params(), *, id_column: str = "doc_id") -> DataFrame:
    """The documents without those rejected; a row with a null id stays. Rows that share an id go together if one of
    them is rejected."""
    rejected = classify(documents, labels, params, id_column=id_column).where("NOT accepted").select(id_column).distinct()
    return documents.join(rejected, id_column, "left_anti").select(*documents.columns)
