import hashlib
import io
import zipfile

from tallstrip.llm import warc


def test_round_trip(spark):
    big, other = "é" * 600, "x" * 1000
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "u\r\nX: y", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", other[:-1]), (10, "u", other[:-1])]
    rows = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id bigint, url string, html string, payload string, digest string")
    got = {r.page_id: r for r in warc.round_trip(spark, rows.repartition(3)).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {1: 3, 2: 3}
    assert warc.round_trip(spark, rows.where("page_id < 0")).count() == 0


def test_repeated_and_null_ids(spark):
    big = "z" * 2000
    rows = spark.createDataFrame([(1, "u", big), (7, "u", big), (7, "u", big), (None, "u", big)], "page_id bigint, url string, html string")
    got = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in warc.round_trip(spark, rows).collect())
    assert got == [(-1, "response", None), (1, "revisit", 7), (7, "response", None), (7, "response", None)]


def test_zip64_directories():
    for limit in (zipfile.ZIP64_LIMIT, 10):
        saved, zipfile.ZIP64_LIMIT = zipfile.ZIP64_LIMIT, limit
        try:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.comment = b"PK is here"
                for i in range(5):
                    with z.open(zipfile.ZipInfo(f"m/{i}"), "w", force_zip64=True) as f:
                        f.write(bytes([65 + i]) * (100 + i))
        finally:
            zipfile.ZIP64_LIMIT = saved
        data = out.getvalue()
        read = lambda at, n, d=data: d[at : at + n]
        members = warc.directory(read, len(data))
        assert set(members) == {f"m/{i}" for i in range(5)}
        for i in range(5):
            at, n = warc.stored(read, members[f"m/{i}"])
            assert data[at : at + n] == bytes([65 + i]) * (100 + i)


def test_more_members_than_sixteen_bits_count():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66000):
            z.writestr(str(i), b"")
    data = out.getvalue()
    assert len(warc.directory(lambda at, n: data[at : at + n], len(data))) == 66000
