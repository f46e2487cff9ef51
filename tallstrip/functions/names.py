"""Names and keys: what file and chapter names say, as column expressions. Ids stay strings: "003" is not "3"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_image(path: Column) -> Column:
    return suffix(path).isin(*IMAGE_SUFFIXES)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The base name without its last suffix; a name that begins with its only dot stays."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def natural_key(name: Column) -> Column:
    """A string whose order is the natural one: digit runs padded, the rest in lower case. A number of over twenty digits
    follows all shorter ones: it is led by a colon, which comes after the digits, and by its length."""
    digits = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    number = lambda p: F.when(F.length(digits(p)) <= 20, F.lpad(digits(p), 20, "0")).otherwise(F.concat(F.lit(":"), F.lpad(F.length(digits(p)).cast("string"), 9, "0"), digits(p)))
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(F.lower(p))), "")


def _last_number(name: Column) -> Column:
    """Nine digits of the last number, wider if it is; null without one."""
    digits = F.regexp_replace(F.regexp_extract(name, r"(\d+)\D*$", 1), r"^0+(?=\d)", "")
    return F.when(digits != "", F.when(F.length(digits) < 9, F.lpad(digits, 9, "0")).otherwise(digits))


def without_result(name: Column) -> Column:
    return F.regexp_replace(name, r"_result$", "")


def file_key(path: Column) -> Column:
    """(0, padded) for a number, else (1, name); for ordering input files."""
    name = without_result(stem(path))
    return F.when(name.rlike(r"^\d+$"), F.struct(F.lit(0).alias("kind"), _last_number(name).alias("key"))).otherwise(F.struct(F.lit(1).alias("kind"), name.alias("key")))


def chapter_key(chapter: Column) -> Column:
    """(0, padded) for a number, (1, last number and name) for a name with one, else (2, name)."""
    number = _last_number(chapter)
    kind = F.when(chapter.rlike(r"^\d+$"), 0).when(number.isNotNull(), 1).otherwise(2)
    key = F.when(kind == 0, number).when(kind == 1, F.concat(number, F.lit("_"), chapter)).otherwise(chapter)
    return F.struct(kind.alias("kind"), key.alias("key"))


def preview_key(path: Column) -> Column:
    """(0, last number and name) or (1, name), without what marks results and previews."""
    name = F.regexp_replace(stem(path), r"(_result_red_preview|_red_preview|_result)$", "")
    number = _last_number(name)
    return F.struct(F.when(number.isNotNull(), 0).otherwise(1).alias("kind"), F.coalesce(F.concat(number, F.lit("_"), name), name).alias("key"))


def normalized_chapter(value: Column) -> Column:
    return without_result(stem(value))


def version_tag(file_name: Column) -> Column:
    """The version and its one optional suffix in a preview's name; null if the name is no preview's."""
    tag = F.regexp_extract(file_name, r"^(v\d+(?:\.\d+)*(?:-[a-zA-Z][a-zA-Z0-9]*)?)-\d+_result_red_preview\.png$", 1)
    return F.nullif(tag, F.lit(""))


def version_chapter(file_name: Column) -> Column:
    return F.nullif(F.regexp_extract(file_name, r"^v\d+(?:\.\d+)*(?:-[a-zA-Z][a-zA-Z0-9]*)?-(\d+)_result_red_preview\.png$", 1), F.lit(""))


def version_key(tag: Column) -> Column:
    """(numbers, suffix): 5.0 before 5.0-islands before 10.0."""
    numbers = F.transform(F.split(F.regexp_replace(F.regexp_extract(tag, r"^([^-]*)", 1), "^v+", ""), r"\."), lambda x: x.cast("int"))
    return F.struct(numbers.alias("numbers"), F.regexp_extract(tag, r"^[^-]*-(.*)$", 1).alias("suffix"))


def version_prefix(model_path: Column, islands: Column, frames: Column) -> Column:
    name = stem(model_path)
    version = F.when(F.lower(name).startswith("v"), name).otherwise(F.concat(F.lit("v"), name))
    more = F.concat(F.when(islands, "islands").otherwise(""), F.when(frames, "frames").otherwise(""))
    return F.concat(version, F.lit("-"), F.when(more != "", F.concat(more, F.lit("-"))).otherwise(""))


def chapter_list(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, pos, chapter) from lists such as "003-005, 12": ranges are written as wide as their wider end, in the
    direction given; items keep their order, each once."""
    items = df.select(*keys, F.posexplode(F.filter(F.split(F.trim(F.col(value)), r"[,\s]+"), lambda x: x != "")).alias("at", "item"))
    low, high = F.regexp_extract("item", r"^(\d+)-(\d+)$", 1), F.regexp_extract("item", r"^(\d+)-(\d+)$", 2)
    wide = F.greatest(F.length(low), F.length(high))
    numbers = F.transform(F.sequence(low.cast("long"), high.cast("long")), lambda n: F.when(F.length(n.cast("string")) < wide, F.lpad(n.cast("string"), wide, F.lit("0"))).otherwise(n.cast("string")))
    spread = items.select(*keys, "at", F.posexplode(F.when(F.col("item").rlike(r"^\d+-\d+$"), numbers).otherwise(F.array(normalized_chapter(F.col("item"))))).alias("inner", "chapter"))
    first = spread.groupBy(*keys, "chapter").agg(F.min(F.struct("at", "inner")).alias("place"))
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("place")
    return first.select(*keys, (F.row_number().over(order) - 1).alias("pos"), "chapter")


def csv_values(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def csv_ints(value: Column) -> Column:
    return F.transform(csv_values(value), lambda x: x.cast("int"))


def clean_label(path: Column, chapter: Column) -> Column:
    """What tells a compared image apart: its stem less the chapter in front and the known endings, one after another."""
    whole, own = stem(path), stem(chapter)
    front = F.when(whole.startswith(F.concat(own, F.lit("_"))) | whole.startswith(F.concat(own, F.lit("-"))), F.substr(whole, F.length(own) + 2)).otherwise(whole)
    for ending in ("_result_red_preview", "_red_preview", "_result", "_cleaned"):
        front = F.regexp_replace(front, f"{ending}$", "")
    label = F.trim(F.translate(front, "_-", "  "))
    return F.when(label == "", whole).otherwise(F.upper(label))


def chapter_path(chapter: Column, folder: str, ending: str = ".png") -> Column:
    """A bare id is a file of the folder; anything with a folder or suffix is a path already."""
    bare = ~chapter.contains("/") & (stem(chapter) == chapter)
    return F.when(bare, F.concat(F.lit(folder + "/"), chapter, F.lit(ending))).otherwise(chapter)


def result_path(chapter: Column, folder: str, prefix: Column | str = "") -> Column:
    return F.concat(F.lit(folder + "/"), F.lit(prefix) if isinstance(prefix, str) else prefix, stem(chapter), F.lit("_result.png"))


def index_name(start: int, index: Column) -> Column:
    """Three digits, more where needed."""
    n = (index + start).cast("string")
    return F.concat(F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n), F.lit(".png"))


def summary_name(chapter: Column, chapters: Column, low: Column, high: Column) -> Column:
    """A report's file name; chapters is an array of ids, the others are null where not asked for."""
    n = F.size(chapters)
    several = F.when(n == 0, "selected_empty").when(n <= 10, F.array_join(chapters, "-")).otherwise(F.concat(F.lit("selected_"), n.cast("string"), F.lit("_chapters_"), F.try_element_at(chapters, F.lit(1)), F.lit("-"), F.try_element_at(chapters, F.lit(-1))))
    ends = F.concat(F.coalesce(normalized_chapter(low), F.lit("start")), F.lit("-"), F.coalesce(normalized_chapter(high), F.lit("end")))
    name = F.when(chapter.isNotNull(), normalized_chapter(chapter)).when(chapters.isNotNull(), several).when(low.isNotNull() | high.isNotNull(), ends).otherwise("all")
    return F.concat(name, F.lit("_summary.csv"))
