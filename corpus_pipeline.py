"""A training corpus from documents, in stages that each work on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallstrip.llm._work import discard, settle
from tallstrip.llm.decontaminate import keep_clean
from tallstrip.llm.packing import pack
from tallstrip.llm.quality import keep_accepted
from tallstrip.llm.simhash import keep_one
from tallstrip.llm.suffix_dedup import suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under a model of trusted text is not out of bounds for their language. Rows without
    words and rows with a null id stay; rows that share an id go together."""
    return keep_accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: five-word shingles, similarity 0.8. Texts without words (null
    ones too) are copies of each other; rows with a null id stay."""
    return keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that start earlier in the corpus; characters cut in two go. No row goes;
    a null text becomes an empty one."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    found = suffix_dedup(docs, carry=rest, characters=True)
    return found.withColumnRenamed("characters", "text").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in the benchmark's windows; rows with a null id stay."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("decontaminate", decontaminate), ("packing", packing)]

#: The first three stages rest on a trained model, fingerprints and window matches that SQL can't express; they are
#: tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again; it goes when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            after = settle(after, name)
            discard(docs)
        docs = after
    return docs
