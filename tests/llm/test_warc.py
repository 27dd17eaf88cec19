import base64
import gzip
import hashlib
import io

import pytest

from tablesync.llm import warc
from tablesync.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, digest string, size int, record int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2) for r in rows], SCHEMA)


def expected(rows, least=0):
    groups = {}
    for page, _, html in rows:
        groups.setdefault(html or "", []).append(page)
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        best = max((p for p in groups[html or ""] if p is not None), default=None)
        first = page == best or len(data) < least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "response" if first else "revisit", None if first else best))
    return sorted(out, key=str)


def read(df):
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to_page")
    return sorted((tuple(r[f] for f in fields) for r in df.collect()), key=str)


ROWS = [
    (1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "u\r\nX: y%", ""),
    (None, "n", "<p>x</p>"), (None, "n", "alone"), (7, "é", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
    (8, "l", "ü" * 700_000), (9, "t", "twice"), (9, "t", "twice"),
]


@pytest.mark.parametrize("least", [0, 6])
def test_archives_of_odd_rows(spark, least):
    rows = ROWS + [(100 + i, f"c{i}", "copy " * 50) for i in range(300)]
    archives = warc.write_archives(frame(spark, rows).repartition(3), least)
    back = warc.read_archives(archives)
    assert read(back) == expected(rows, least)
    html = {r.page_id: r.payload for r in back.collect()}
    assert bytes(html[8]).decode() == "ü" * 700_000 and bytes(html[7]).decode() == ROWS[6][2]
    urls = {r.page_id: r.url for r in back.collect()}
    assert urls[4] == "u%0D%0AX:%20y%25" and urls[3] == ""


def test_members_and_index_of_a_whole_file(spark):
    rows = [(i, f"u{i}", f"page {i} " * 20) for i in range(40)]
    for r in warc.write_archives(frame(spark, rows).coalesce(1)).collect():
        with open(r["archive"], "rb") as archive, open(r["index"], encoding="utf-8") as index:
            data, places = archive.read(), list(warc._lines(io.BytesIO(index.read().encode())))
        assert len(places) == r["records"] and sum(p["length"] for p in places) == len(data)
        for p in places:
            record = warc.read_member(io.BytesIO(data), p["offset"], p["length"])
            assert record.headers["WARC-Record-ID"] == p["id"]
            assert gzip.decompress(data[p["offset"] :][: p["length"]]) == record.raw()


def test_damage_is_reported():
    record = warc.Record({"WARC-Type": "response", "Content-Length": "5"}, b"12345")
    raw = record.raw() * 3
    assert list(warc.read_records(iter([raw[:7], raw[7:9], raw[9:]]))) == [record] * 3
    whole = gzip.compress(raw[:60]) + gzip.compress(raw[60:])
    assert b"".join(warc.inflate(iter([whole[:11], whole[11:]]))) == raw
    for broken in (raw[:-9], raw + b"tail", b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.read_records(iter([broken])))


def test_no_pages(spark):
    assert warc.read_archives(warc.write_archives(frame(spark, []))).count() == 0


def test_query_against_counting(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op7_warc"](spark, FOLDER).collect()]
    assert sorted(got, key=str) == expected(rows)
