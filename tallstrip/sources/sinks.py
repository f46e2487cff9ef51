"""Writers: PNG files from bands, report and segment tables, strata."""

from __future__ import annotations

import struct
import zlib
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import report

#: Columns of the two report tables, in order.
SCORE_COLUMNS = ["rank", "chapter", "estimated_success_percent", "priority_score", "damage_percent_deleted", "damage_percent_total", "delete_percent_total", "leftover_grayline_percent_total", "total_pixels", "deleted_pixels", "damaged_pixels", "leftover_grayline_pixels", "width", "height", "original_path", "result_path"]
SEGMENT_COLUMNS = ["index", "y0", "y1", "height", "reason", "original", "cleaned"]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_head(width: int, height: int, channels: int) -> bytes:
    """A PNG file up to where its bands begin: sizes, and the two bytes before compressed data."""
    header = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + header + _chunk(b"IDAT", b"\x78\x9c")


def png_band(data: bytes, width: int, channels: int) -> tuple[bytes, int, int]:
    """A band's rows compressed by themselves as one chunk, the checksum of what was compressed, and its length. The
    stream is flushed so that nothing in it refers to another band: bands are compressed in any order and put together."""
    part = np.frombuffer(data, np.uint8).reshape(-1, width * channels)
    lines = np.zeros((len(part), 1 + part.shape[1]), np.uint8)
    lines[:, 1:] = part
    raw, packer = lines.tobytes(), zlib.compressobj(6, zlib.DEFLATED, -15)
    return _chunk(b"IDAT", packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH)), zlib.adler32(raw), len(raw)


def joined_checksum(first: int, second: int, length: int) -> int:
    """The checksum of two parts put together, of each one's and the second's length: both halves are sums, and the lower
    half's start at one is counted once for each byte behind it in the upper half."""
    a, b = (first & 0xFFFF) + (second & 0xFFFF) - 1, (first >> 16) + (second >> 16) + length * ((first & 0xFFFF) - 1)
    return b % 65521 << 16 | a % 65521


def png_tail(checksum: int) -> bytes:
    return _chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", checksum)) + _chunk(b"IEND", b"")


def write_png(bands: DataFrame, folder: str, *, overwrite: bool = True) -> DataFrame:
    """Write an image per name from bands (name, y0, width, height, n_channels, data), data in red, green, blue[, alpha].

    Bands are compressed where they are; what one task does for an image is to write compressed bands one behind the
    other, under a name of its own that becomes the file's at the end, so a task that is lost leaves no part of a file.
    Without overwrite an existing file fails. Returns (name, path) as the files are written.
    """

    def compress(frames):
        for frame in frames:
            made = [png_band(*x) for x in zip(frame["data"], frame["width"], frame["n_channels"], strict=True)]
            frame["data"], frame["sum"], frame["length"] = ([x[k] for x in made] for k in range(3))
            yield frame

    def work(frames):
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        name, out, part, total = None, None, "", 1

        def close():
            out.write(png_tail(total))
            out.close()
            system.move(part, f"{base}/{name}.png")
            return pd.DataFrame({"name": [name], "path": [f"{folder}/{name}.png"]})

        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.name != name:
                    if out is not None:
                        yield close()
                    name, total, part = row.name, 1, f"{base}/.{row.name}-{uuid.uuid4().hex}"
                    if not overwrite and system.get_file_info(f"{base}/{name}.png").type != fs.FileType.NotFound:
                        raise FileExistsError(f"{base}/{name}.png")
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(part)
                    out.write(png_head(row.width, row.height, row.n_channels))
                out.write(row.data)
                total = joined_checksum(total, row.sum, row.length)
        if out is not None:
            yield close()

    rows = bands.select("name", "y0", "width", "height", "n_channels", "data")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    packed = rows.mapInPandas(compress, f"{kinds}, sum bigint, length bigint")
    ordered = packed.repartition("name").sortWithinPartitions("name", "y0")
    return ordered.mapInPandas(work, "name string, path string")


def interleaved(b, sizes: DataFrame, *planes: str) -> DataFrame:
    """Packed bands as bands that write_png takes, named by img."""
    names, key = list(planes), b.key

    def work(batches):
        import pyarrow as pa

        from ..operators.bands import _arrays

        for batch in batches:
            for i in range(len(batch)):
                arrays = _arrays(batch, i, dict.fromkeys(names, "uint8"))
                data = np.stack([arrays[p] for p in names], axis=2).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), batch.column(2).slice(i, 1), pa.array([len(names)], pa.int32()), pa.array([data], pa.binary())], names=["img", "y0", "width", "n_channels", "data"])

    made = b.df.select("img", "y0", "width", *names).mapInArrow(work, f"img {key}, y0 bigint, width int, n_channels int, data binary")
    return made.join(sizes.select("img", "height"), "img").select(F.col("img").cast("string").alias("name"), "y0", "width", "height", "n_channels", "data")


def cleaned(px: DataFrame, delete) -> DataFrame:
    """Alpha 0 where deleted, else 255."""
    return px.withColumn("a", F.when(delete, 0).otherwise(255))


def red_preview(px: DataFrame, delete) -> DataFrame:
    """Deleted pixels red."""
    return px.withColumns({"r": F.when(delete, 255).otherwise(F.col("r")), "g": F.when(delete, 0).otherwise(F.col("g")), "b": F.when(delete, 0).otherwise(F.col("b"))})


def bands_of(px: DataFrame, rows: int = 1024, alpha: bool = True) -> DataFrame:
    """Pixels (name, y, x, r, g, b[, a]) packed into bands that write_png takes."""
    planes = ["r", "g", "b", "a"][: 4 if alpha else 3]
    sizes = px.groupBy("name").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))

    def work(key, table):
        import pyarrow as pa

        name, y0, y, x = key[0].as_py(), key[1].as_py() * rows, table.column("y").to_numpy(), table.column("x").to_numpy()
        area = np.zeros((y.max() - y0 + 1, x.max() + 1, len(planes)), np.uint8)
        for k, plane in enumerate(planes):
            area[y - y0, x, k] = table.column(plane).to_numpy()
        return pa.table({"name": [name], "y0": pa.array([y0], pa.int64()), "n_channels": pa.array([len(planes)], pa.int32()), "data": [area.tobytes()]})

    packed = px.withColumn("band", F.floor(F.col("y") / rows)).groupBy("name", "band").applyInArrow(work, "name string, y0 bigint, n_channels int, data binary")
    return packed.join(sizes, "name")


def write_scores(ranked: DataFrame, path: str) -> None:
    """The score report as one CSV file in rank order: a row per strip."""
    report(ranked).select(*SCORE_COLUMNS).orderBy("rank").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_segments(segments: DataFrame, path: str) -> None:
    segments.select(*SEGMENT_COLUMNS).orderBy("index").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_strata(strata: DataFrame, path: str) -> None:
    """(w, h, low_texture, boundary) as JSON lines."""
    strata.write.mode("overwrite").json(path)


def missing_outputs(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """What is still to be written: names without a file."""
    return wanted.join(existing.select("name"), "name", "left_anti")
