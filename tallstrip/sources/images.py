"""Image files as tables: discovery by name, sizes from headers, pixels in bands."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names


#: Bytes of a file's head, in which its size is looked for first.
HEAD = 65_536


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of image files under a folder, whatever the case of their suffixes; nothing is decoded."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified")).where(names.is_image(F.col("path")))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def chapter_pages(found: DataFrame, output: str = "output") -> DataFrame:
    """(chapter, page_no, path): files by folder in natural order; the output folder is left out."""
    rows = found.withColumn("chapter", folder_of(F.col("path"))).where((F.col("chapter") != output) & (F.col("chapter") != ""))
    order = Window.partitionBy("chapter").orderBy(names.natural_key(names.base_name(F.col("path"))), "path")
    return rows.select("chapter", (F.row_number().over(order) - 1).alias("page_no"), "path")


def chapter_folders(found: DataFrame, output: str = "output") -> DataFrame:
    """(chapter, pages, key): folders with at least one image, and what orders them naturally."""
    return chapter_pages(found, output).groupBy("chapter").agg(F.count("*").alias("pages")).withColumn("key", names.natural_key(F.col("chapter")))


def cleaned_parts(found: DataFrame, prefix: str) -> DataFrame:
    """(path, ord): `<prefix>-*_cleaned.png` in natural order of names."""
    name = names.base_name(F.col("path"))
    rows = found.where(name.startswith(f"{prefix}-") & name.endswith("_cleaned.png"))
    return rows.select("path", names.natural_key(name).alias("ord"))


def image_size(data: bytes) -> tuple[int, int, int] | None:
    """Width, height and channels from the first bytes of a PNG, JPEG or WebP file; None for others, and for a JPEG whose
    frame header lies further on."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 26:
        width, height, _, colour = struct.unpack(">IIBB", data[16:26])
        return width, height, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 3)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                return None
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width, channels = struct.unpack(">HHB", data[at + 5 : at + 10])
                return width, height, channels
            at += 2 + size
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8 ":
            width, height = struct.unpack("<HH", data[26:30])
            return width & 0x3FFF, height & 0x3FFF, 3
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 4 if bits >> 28 & 1 else 3
        if data[12:16] == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1, 4 if data[20] & 0x10 else 3
    return None


def read_size(file) -> tuple[int, int, int] | None:
    """Width, height and channels of an open file, from ranges of its head: a JPEG's segments are jumped over."""
    head = file.read(HEAD)
    found = image_size(head)
    if found or head[:2] != b"\xff\xd8":
        return found
    at = 2
    while True:
        file.seek(at)
        part = file.read(10)
        if len(part) < 10 or part[0] != 0xFF:
            return None
        if (found := image_size(b"\xff\xd8" + part)) is not None:
            return found
        at += 2 + struct.unpack(">H", part[2:4])[0]


def _opened(path: str):
    """The file system and path for what Spark calls a file."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels) from headers; no file is read beyond its head, nor decoded. Sizes of files that are
    no images in spite of their names are null."""

    def work(frames):
        for frame in frames:
            got = []
            for path in frame["path"]:
                system, place = _opened(path)
                with system.open_input_file(place) as file:
                    got.append(read_size(file) or (None, None, None))
            yield pd.DataFrame({"path": frame["path"], "width": [x[0] for x in got], "height": [x[1] for x in got], "channels": [x[2] for x in got]}).astype({"width": "Int32", "height": "Int32", "channels": "Int32"})

    return files(spark, folder).select("path").mapInPandas(work, "path string, width int, height int, channels int")


def _unfiltered(lines: np.ndarray, before: np.ndarray, step: int) -> np.ndarray:
    """Pixels of filtered rows (a byte that tells how, then the row); before: the row above, step: bytes of a pixel."""
    out, above = np.empty((len(lines), lines.shape[1] - 1), np.uint8), before
    for k, (how, line) in enumerate(zip(lines[:, 0].tolist(), lines[:, 1:], strict=True)):
        if how == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif how == 2:
            line = line + above
        elif how in (3, 4):
            own, up = line.tolist(), above.tolist()
            for i in range(len(own)):
                a, b, c = (own[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
                if how == 3:
                    near = (a + b) >> 1
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    near = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                own[i] = (own[i] + near) & 255
            line = np.array(own, np.uint8)
        out[k] = above = line
    return out


def png_rows(file, rows: int):
    """(width, height, channels, first row, pixels) of a PNG file with 8 bits a channel, `rows` rows at a time: the file is
    read, inflated and unfiltered as a stream."""
    import zlib

    head = file.read(33)
    width, height, bits, colour, _, _, laced = struct.unpack(">IIBBBBB", head[16:29])
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if head[:8] != b"\x89PNG\r\n\x1a\n" or bits != 8 or laced or channels is None:
        raise ValueError("no plain PNG of 8 bits a channel")
    size, inflate, held, y = 1 + width * channels, zlib.decompressobj(), bytearray(), 0
    above = np.zeros(width * channels, np.uint8)
    while y < height:
        while len(held) < min(rows, height - y) * size:
            if inflate.unconsumed_tail:
                held += inflate.decompress(inflate.unconsumed_tail, rows * size)
                continue
            length, kind = struct.unpack(">I4s", file.read(8))
            data = file.read(length)
            file.read(4)
            if kind == b"IDAT":
                held += inflate.decompress(data, rows * size)
            elif kind == b"IEND":
                raise ValueError("the file ends before its rows do")
        n = min(rows, height - y)
        lines = np.frombuffer(bytes(held[: n * size]), np.uint8).reshape(n, size)
        del held[: n * size]
        pixels = _unfiltered(lines, above, channels)
        above = pixels[-1]
        yield width, height, channels, y, pixels.reshape(n, width, channels)
        y += n


def png_bands(spark: SparkSession, folder: str, rows: int = 1024):
    """Packed bands (img: the path) of the PNG files under a folder, planes r, g, b and a (255 where there is none). A task
    holds one band of one file at a time, whatever the file's height; files that aren't plain PNGs fail."""
    from ..operators.bands import Bands

    def work(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _opened(path)
                with system.open_input_stream(place) as file:
                    for width, _, channels, y, px in png_rows(file, rows):
                        shown = px if channels >= 3 else np.repeat(px[:, :, :1], 3, axis=2)
                        alpha = px[:, :, -1] if channels in (2, 4) else np.full(px.shape[:2], 255, np.uint8)
                        planes = [*(np.ascontiguousarray(shown[:, :, k]).tobytes() for k in range(3)), alpha.tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([y // rows]), pa.array([y]), pa.array([len(px)], pa.int32()), pa.array([width], pa.int32()), *[pa.array([p], pa.binary()) for p in planes]], names=["img", "band", "y0", "n", "width", *"rgba"])

    found = files(spark, folder).where(F.lower("path").endswith(".png")).select("path")
    return Bands(found.mapInArrow(work, "img string, band bigint, y0 bigint, n int, width int, r binary, g binary, b binary, a binary"), dict.fromkeys("rgba", "uint8"), rows)


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, n_channels, data): rows top down, channels as blue, green, red and, if there is one, alpha.
    Files that can't be decoded (WebP ones can't) are those of `undecodable`."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").load(folder).where("image.height > 0")
    return rows.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("n_channels"), "image.data")


def undecodable(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of files with an image's name that Spark's image source can't decode."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").load(folder).where("image.height <= 0")
    return rows.select(F.col("image.origin").alias("path")).where(names.is_image(F.col("path")))


def bands(images: DataFrame, rows: int = 1024) -> DataFrame:
    """(path, band, y0, width, n_channels, data): decoded images cut into bands of rows, inside the JVM."""
    cut = images.withColumn("band", F.explode(F.expr(f"sequence(0, CAST((height - 1) / {rows} AS INT))")))
    size = F.col("width") * F.col("n_channels")
    return cut.select("path", "band", (F.col("band") * rows).alias("y0"), "width", "n_channels", F.substring(F.col("data"), F.col("band") * rows * size + 1, F.lit(rows) * size).alias("data"))


def pixels(banded: DataFrame) -> DataFrame:
    """(path, y, x, r, g, b, a): pixels of bands; a is null without alpha. For small images and checks only."""

    def work(batches):
        for batch in batches:
            for path, y0, width, n, data in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "y0", "width", "n_channels", "data")), strict=True):
                a = np.frombuffer(data, np.uint8).reshape(-1, width, n)
                y, x = np.indices(a.shape[:2])
                plane = lambda k: pa.array(a[:, :, k].ravel().astype(np.int32))  # noqa: E731, B023
                b, g, r = (plane(0), plane(1), plane(2)) if n >= 3 else (plane(0),) * 3
                alpha = plane(3) if n == 4 else pa.nulls(a.shape[0] * width, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([path] * (a.shape[0] * width)), pa.array((y.ravel() + y0).astype(np.int32)), pa.array(x.ravel().astype(np.int32)), r, g, b, alpha], names=["path", "y", "x", "r", "g", "b", "a"])

    return banded.mapInArrow(work, "path string, y int, x int, r int, g int, b int, a int")


def with_opaque_alpha(px: DataFrame) -> DataFrame:
    return px.withColumn("a", F.coalesce("a", F.lit(255)))


def with_red_overlay(px: DataFrame, limit: int = 128) -> DataFrame:
    """Transparent pixels red."""
    gone = F.coalesce(F.col("a") < limit, F.lit(False))
    return px.withColumns({"r": F.when(gone, 255).otherwise(F.col("r")), "g": F.when(gone, 0).otherwise(F.col("g")), "b": F.when(gone, 0).otherwise(F.col("b"))})


def model_configs(spark: SparkSession, folder: str, schema: str, one_a_file: bool = True) -> DataFrame:
    """Model configurations, one JSON file each (or one a line), with defaults for what older ones lack."""
    rows = spark.read.schema(schema).option("multiLine", str(one_a_file).lower()).json(folder)
    return rows.withColumns({"sdt_head": F.coalesce("sdt_head", F.lit(False)), "sdt_clamp_radius": F.coalesce("sdt_clamp_radius", F.lit(0))})
