"""The subpackage's registered queries: operators applied to their whole tables, with the columns that are compared."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, ego, html, packing, quality, recompression, resampling, sharding, simhash, suffix_dedup, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op5_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ego.similarity_classes(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = chat.format_turns(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))

    def digest(frames):
        at, n, turns_hash, loss, loss_hash, formatted = object(), 0, None, 0, None, 0
        def row():
            return (None if at is None else str(at), n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), formatted)

        for frame in frames:
            done = []
            for conv, text, a, b in frame.itertuples(index=False):
                conv = None if conv is None or conv != conv else conv
                if turns_hash is None or conv != at:
                    if turns_hash is not None:
                        done.append(row())
                    at, n, turns_hash, loss, loss_hash, formatted = conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, said in chat.read_back(text):
                    turns_hash.update(f"{role}\n{said}\n".encode())
                    n += 1
                under = chat.unescape(text[a:b])
                loss_hash.update(under.encode())
                loss += len(under)
                formatted += len(text)
            yield pd.DataFrame(done, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        if turns_hash is not None:
            yield pd.DataFrame([row()], columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ordered = chat.in_order(turns).select(F.col("conv_id").cast("string"), "formatted", "loss_from", "loss_to")
    out = ordered.mapInPandas(digest, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return out.withColumn("conv_id", F.col("conv_id").cast("long"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("units").alias("n_bytes"), F.col("removed").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.recompression_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("units").alias("n_words"), F.col("removed").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.histogram_shards(_table(spark, sf_dir, "documents"), sharding.Params(shards=40))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_simhash, op3_packing, op4_decontaminate, op5_ego, op6_warc, op7_chat, op8_suffix_dedup, op9_html, op10_recompression, op11_histogram_sort, op12_whitening, op13_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op11_histogram_sort": sharding.SQL}
