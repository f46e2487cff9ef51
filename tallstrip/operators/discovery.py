"""Which files belong together: pairs, fallbacks, versions, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .ranking import numbered


def selected(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Requested chapters (pos, chapter) with their files (chapter, path), in the order asked for; a missing one fails."""
    joined = requested.join(files, "chapter", "left")
    return joined.withColumn("path", F.coalesce("path", F.raise_error(F.concat(F.lit("no file for chapter "), "chapter")).cast("string")))


def missing(requested: DataFrame, files: DataFrame) -> DataFrame:
    return requested.join(files, "chapter", "left_anti")


def in_range(files: DataFrame, low: str | None, high: str | None) -> DataFrame:
    """Input files (name) that are no results, previews or cleaned ones, between two ids inclusive by their keys."""
    stem = names.stem(F.col("name"))
    rows = files.where(~stem.endswith("_cleaned") & ~stem.endswith("_result") & ~stem.endswith("_red_preview")).withColumn("key", names.file_key(F.col("name")))
    if low is not None:
        rows = rows.where(F.col("key") >= names.file_key(F.lit(low)))
    return rows if high is None else rows.where(F.col("key") <= names.file_key(F.lit(high)))


def pairs(originals: DataFrame, results: DataFrame) -> DataFrame:
    return originals.join(results, "chapter")


def unmatched(originals: DataFrame, results: DataFrame) -> DataFrame:
    """Results without an original; originals without a result don't count."""
    return results.join(originals, "chapter", "left_anti")


def training_pairs(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """(episode, variant, page, src, target): pages with the target of their folder's best source.

    targets holds (episode, source, page, target), source being the variant itself, "initial" or "external" in falling
    priority. The source is chosen per folder, so a page that the chosen one lacks is dropped.
    """
    have = targets.select("episode", "source").distinct()
    folders = pages.select("episode", "variant").distinct()
    rank = F.when(F.col("source") == F.col("variant"), 0).when(F.col("source") == "initial", 1).when(F.col("source") == "external", 2)
    best = folders.join(have, "episode").withColumn("rank", rank).where("rank IS NOT NULL").groupBy("episode", "variant").agg(F.min_by("source", "rank").alias("source"))
    return pages.join(best, ["episode", "variant"]).join(targets, ["episode", "source", "page"]).select("episode", "variant", "page", "src", "target")


def exported_pages(variants: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(split, episode, variant, page) present on both sides, for the variants asked for; no fallback."""
    keys = ["split", "episode", "variant", "page"]
    return left.join(variants, "variant", "left_semi").join(right, keys, "left_semi").select(*keys)


def compare_images(found: DataFrame) -> DataFrame:
    """(path, ord): files of several ordered patterns (source, path), each once where it was first seen."""
    first = found.groupBy("path").agg(F.min("source").alias("source"))
    return numbered(first, "ord", "source", names.preview_key(F.col("path")), "path", start=0).select("path", "ord")


def labelled(items: DataFrame, labels: DataFrame, chapter: str) -> DataFrame:
    """(ord, path, title): titles from file names, or by position from labels (ord, label)."""
    own = names.clean_label(F.col("path"), F.lit(chapter))
    return items.join(labels, "ord", "left").select("ord", "path", F.coalesce("label", own).alias("title"))


def versions(files: DataFrame) -> DataFrame:
    """(chapter, tag, name, ord): previews by chapter in the order of their versions."""
    name = F.col("name")
    rows = files.select(names.version_chapter(name).alias("chapter"), names.version_tag(name).alias("tag"), "name").where("tag IS NOT NULL")
    order = Window.partitionBy("chapter").orderBy(names.version_key(F.col("tag")), "name")
    return rows.withColumn("ord", F.row_number().over(order) - 1)


def version_grid(versions: DataFrame, slots: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(chapter, col, tag, slot, y): each version's column at each offset of its chapter (chapter, slot, y), with the
    untouched strip (chapter) as the first column where there is one."""
    columns = versions.select("chapter", (F.col("ord") + 1).alias("col"), "tag")
    if before is not None:
        columns = columns.unionByName(before.select("chapter").distinct().select("chapter", F.lit(0).alias("col"), F.lit("before").alias("tag")))
    return columns.join(slots, "chapter")


def missing_versions(requested: DataFrame, versions: DataFrame) -> DataFrame:
    return requested.join(versions, "tag", "left_anti")


def ordered_distinct(rows: DataFrame, value: str, pos: str) -> DataFrame:
    return rows.groupBy(value).agg(F.min(pos).alias(pos))
