import numpy as np
from pyspark.sql import functions as F

from tallstrip.schema import MODEL_CONFIG
from tallstrip.sources import images, sinks
from tallstrip.streaming import chapters


def picture(spark, name, a, alpha=None):
    y, x = np.indices(a.shape[:2])
    rows = [(name, int(i), int(j), *map(int, a[i, j]), int(alpha[i, j]) if alpha is not None else 255) for i, j in zip(y.ravel(), x.ravel(), strict=True)]
    return spark.createDataFrame(rows, "name string, y int, x int, r int, g int, b int, a int")


def test_pictures_come_back(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, alpha = rng.integers(0, 256, (23, 9, 3)), rng.integers(0, 256, (23, 9))
    folder = f"file://{tmp_path}/ch1"
    written = sinks.write_png(sinks.bands_of(picture(spark, "p10", a, alpha), 5), folder).collect()
    sinks.write_png(sinks.bands_of(picture(spark, "p2", a[:4]), 5, alpha=False), folder).collect()
    assert written[0].path.endswith("p10.png")
    sizes = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.channels) for r in images.sizes(spark, folder).collect()}
    assert sizes == {"p10.png": (9, 23, 4), "p2.png": (9, 4, 3)}
    px = images.pixels(images.bands(images.decoded(spark, folder), 7))
    for r in px.where(F.col("path").contains("p10")).collect():
        assert [r.r, r.g, r.b, r.a] == [*a[r.y, r.x], alpha[r.y, r.x]]
    assert px.where(F.col("path").contains("p2")).where("a IS NOT NULL").count() == 0
    assert images.with_opaque_alpha(px).where("a IS NULL").count() == 0
    red = images.with_red_overlay(px).where("a < 128").select("r", "g", "b").distinct().collect()
    assert [tuple(r) for r in red] == [(255, 0, 0)]
    found = images.files(spark, folder)
    assert [r.path.rsplit("/", 1)[1] for r in images.chapter_pages(found).orderBy("page_no").collect()] == ["p2.png", "p10.png"]
    assert [(r.chapter, r.pages) for r in images.chapter_folders(found).collect()] == [("ch1", 2)]
    named = spark.createDataFrame([(f"/x/{n}",) for n in ("7-10_cleaned.png", "7-2_cleaned.png", "7-3.png", "77-1_cleaned.png", "7-1_cleaned.jpg")], "path string")
    assert [r.path[3:] for r in images.cleaned_parts(named, "7").orderBy("ord").collect()] == ["7-2_cleaned.png", "7-10_cleaned.png"]
    done = spark.createDataFrame([("p2",)], "name string")
    assert sinks.missing_outputs(done.union(spark.createDataFrame([("p3",)], "name string")), done).collect()[0].name == "p3"


def test_an_existing_file_is_kept(spark, tmp_path):
    folder, bands = f"file://{tmp_path}/x", sinks.bands_of(picture(spark, "p", np.zeros((2, 2, 3), int)))
    sinks.write_png(bands, folder).collect()
    try:
        sinks.write_png(bands, folder, overwrite=False).collect()
    except Exception as error:
        assert "FileExistsError" in str(error)
    else:
        raise AssertionError


def test_configs_and_reports(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text('{\n"model_type": "unet", "threshold": 0.5}')
    (row,) = images.model_configs(spark, f"{tmp_path}/m", MODEL_CONFIG).collect()
    assert (row.threshold, row.sdt_head, row.sdt_clamp_radius) == (0.5, False, 0)
    segments = spark.createDataFrame([(0, 1, 5, 4, "safe", "a", "b")], ", ".join(f"{c} {'string' if c in ('reason', 'original', 'cleaned') else 'int'}" for c in sinks.SEGMENT_COLUMNS))
    sinks.write_segments(segments, f"{tmp_path}/s")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/s").columns == sinks.SEGMENT_COLUMNS


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "u int, t string").select("u", F.to_timestamp("t").alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = chapters.arriving(spark, f"{tmp_path}/in", rows.schema)
    chapters.run_batches(stream, lambda df: chapters.sessions(df, "30 minutes", "1 hour", "u"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_sizes_of_webp_and_of_long_heads(spark, tmp_path):
    from tallstrip.sources.images import image_size, sizes, undecodable

    riff = lambda kind, data: b"RIFF" + (len(data) + 12).to_bytes(4, "little") + b"WEBP" + kind + len(data).to_bytes(4, "little") + data
    lossy = riff(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + (640).to_bytes(2, "little") + (480).to_bytes(2, "little") + b"\0" * 8)
    lossless = riff(b"VP8L", b"\x2f" + ((300 - 1) | (200 - 1) << 14 | 1 << 28).to_bytes(4, "little") + b"\0" * 12)
    extended = riff(b"VP8X", b"\x10\0\0\0" + (1000 - 1).to_bytes(3, "little") + (70_000 - 1).to_bytes(3, "little"))
    assert [image_size(x) for x in (lossy, lossless, extended, b"RIFF")] == [(640, 480, 3), (300, 200, 4), (1000, 70_000, 4), None]
    meta = b"".join(b"\xff\xe1" + (60_000).to_bytes(2, "big") + b"m" * 59_998 for _ in range(3))
    frame = b"\xff\xc0" + (17).to_bytes(2, "big") + b"\x08" + (33).to_bytes(2, "big") + (44).to_bytes(2, "big") + b"\x03" + b"\0" * 20
    for name, data in (("a.webp", lossy), ("b.JPG", b"\xff\xd8" + meta + frame), ("c.png", b"no image"), ("d.jpeg", b"\xff\xd8" + frame)):
        (tmp_path / name).write_bytes(data)
    got = {r.path[-6:].strip("/"): (r.width, r.height, r.channels) for r in sizes(spark, str(tmp_path)).collect()}
    assert got == {"a.webp": (640, 480, 3), "b.JPG": (44, 33, 3), "c.png": (None, None, None), "d.jpeg": (44, 33, 3)}
    assert undecodable(spark, str(tmp_path)).count() == 4


def filtered(px, kinds):
    """Rows of a PNG with the given filters, from their definitions."""
    h, w, n = px.shape
    flat, out = px.reshape(h, -1).astype(int), []
    for y in range(h):
        up = flat[y - 1] if y else np.zeros(w * n, int)
        left = np.concatenate([np.zeros(n, int), flat[y][:-n]])
        corner = np.concatenate([np.zeros(n, int), up[:-n]])
        guess = left + up - corner
        d = np.abs(np.stack([guess - left, guess - up, guess - corner]))
        best = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        near = (0, left, up, (left + up) // 2, best)[kinds[y]]
        out.append(bytes([kinds[y]]) + ((flat[y] - near) % 256).astype(np.uint8).tobytes())
    return b"".join(out)


def test_png_files_of_others_are_read_as_streams(spark, tmp_path):
    import zlib

    from tallstrip.operators.bands import unpack
    from tallstrip.sources.sinks import _chunk

    rng, want = np.random.default_rng(4), {}
    for name, n, colour in (("rgb", 3, 2), ("rgba", 4, 6), ("gray", 1, 0), ("soft", 2, 4)):
        px = rng.integers(0, 256, (29, 7, n)).astype(np.uint8)
        want[name] = px
        data = zlib.compress(filtered(px, rng.integers(0, 5, 29).tolist()))
        head = (7).to_bytes(4, "big") + (29).to_bytes(4, "big") + bytes([8, colour, 0, 0, 0])
        parts = b"".join(_chunk(b"IDAT", data[k : k + 50]) for k in range(0, len(data), 50))
        (tmp_path / f"{name}.png").write_bytes(b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"k\0v") + parts + _chunk(b"IEND", b""))
    for rows in (4, 64):
        got = {k: np.zeros((29, 7, 4), int) for k in want}
        for r in unpack(images.png_bands(spark, f"file://{tmp_path}", rows)).collect():
            got[r.img.rsplit("/", 1)[1][:-4]][r.y, r.x] = r.r, r.g, r.b, r.a
        for k, px in want.items():
            colours = px[:, :, :3] if px.shape[2] >= 3 else np.repeat(px[:, :, :1], 3, axis=2)
            assert (got[k][:, :, :3] == colours).all() and (got[k][:, :, 3] == (px[:, :, -1] if px.shape[2] in (2, 4) else 255)).all()


def test_checksums_of_parts_join():
    import zlib

    data, at, total = bytes(range(256)) * 900, 0, 1
    for size in (0, 1, 5000, 70_000, 155_399):
        total = sinks.joined_checksum(total, zlib.adler32(data[at : at + size]), size)
        at += size
    assert total == zlib.adler32(data[:at]) and at == len(data)


def test_a_tall_strip_is_compressed_in_many_tasks(spark, tmp_path):
    px = np.random.default_rng(5).integers(0, 256, (200, 6, 3)).astype(np.uint8)
    rows = [("tall", y, 6, 200, 3, px[y : y + 10].tobytes()) for y in range(0, 200, 10)]
    bands = spark.createDataFrame(rows, "name string, y0 bigint, width int, height int, n_channels int, data binary").repartition(8)
    sinks.write_png(bands, f"file://{tmp_path}/t").collect()
    assert [p.name for p in (tmp_path / "t").iterdir() if not p.name.endswith(".crc")] == ["tall.png"]
    (row,) = images.decoded(spark, f"file://{tmp_path}/t").collect()
    assert (np.frombuffer(row.data, np.uint8).reshape(200, 6, 3)[:, :, ::-1] == px).all()
