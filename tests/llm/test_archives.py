import hashlib

import pytest
from pyspark.sql import functions as F

from lakeaccord.llm import warc
from lakeaccord.llm.queries import web_archives
from lakeaccord.session import fresh_path

PAGES = "page_id bigint, url string, html string"
RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:fake>\r\nContent-Type: text/html\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages(spark):
    html = [None, "", "tiny", "tiny", "ä" * 600, "ä" * 600, "b" * 999, "b" * 999, "c" * 1000, "c" * 1000, "c" * 1000, "x\r\n\r\nWARC/1.1\r\ny", "WARC/1.1\r\n" * 400, RECORD * 30, "line\r\n" * 3000 + RECORD + "tail", "WARC/1.1\r\nContent-Length: 99999999\r\nWARC-Type: x\r\n\r\n" + "q" * 2000]
    return spark.createDataFrame([(i, None if i % 5 == 4 else f"http://a.example/{i}\r\nx", h) for i, h in enumerate(html)], PAGES)


def expected(rows):
    texts = {i: h or "" for i, _, h in rows}
    out = set()
    for i, text in texts.items():
        data = text.encode()
        last = max(j for j, other in texts.items() if other == text)
        revisit = len(data) >= 1000 and i != last
        out.add((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return out


@pytest.mark.parametrize("bytes_", [700, 5000, 128 << 20])
def test_round_trip_with_the_magic_inside_payloads(spark, tmp_path, bytes_):
    frame = pages(spark)
    frame.withColumn("digest", F.lit("x")).withColumn("bytes", F.lit("y")).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_))
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = [tuple(r) for r in web_archives(spark, str(tmp_path)).collect()]
        path = fresh_path(spark, "archives")
        warc.write_archives(frame.coalesce(1), path)
        found = warc.read_archives(spark, path, payloads=True).where("type = 'response'").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    rows = [tuple(r) for r in frame.collect()]
    assert len(got) == len(rows) and set(got) == expected(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r["payload"]) == html[r["page_id"]] and r["declared"] == "sha1:" + r["sha1"] for r in found)


def test_a_damaged_record_ends_its_file(spark, tmp_path):
    good = RECORD.replace("fake", "one")
    (tmp_path / "a.warc").write_bytes((good + RECORD.replace("Content-Length: 5", "Content-Length: 7") + good).encode())
    (tmp_path / "b.warc").write_bytes((good + good).encode())
    (tmp_path / "c.warc").write_bytes(b"no archive at all")
    found = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r["path"][-6:], r["at"]) for r in found) == [("a.warc", 0), ("b.warc", 0), ("b.warc", len(good))]


def test_rows_without_id_repeats_and_empty_tables(spark, tmp_path):
    rows = [(None, None, "z" * 1200), (3, "u", "z" * 1200), (3, "u", "z" * 1200), (2, None, None)]
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r[0], r[1], r[3], r[4]) for r in web_archives(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, 1200, "revisit", 3), (3, 1200, "response", None), (3, 1200, "response", None), (2, 0, "response", None)], key=str)
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "none/pages.parquet"))
    assert web_archives(spark, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("bytes_", [5000, 100_000, 128 << 20])
def test_urls_of_any_length_and_records_after_them(spark, tmp_path, bytes_):
    urls = ["http://a.example/0", "http://a.example/" + "u" * 70_000, "http://a.example/2", "\n" * 30_000, "http://a.example/WARC/1.1", "ä" * 300_000 + "WARC/1.1", "http://a.example/6", None]
    html = ["first", "line\r\n" * 30 + RECORD, "c" * 1500, "d" * 1500, "c" * 1500, "", RECORD * 3, "last"]
    frame = spark.createDataFrame(list(zip(range(len(urls)), urls, html, strict=True)), PAGES)
    frame.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    old, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_))
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = [tuple(r) for r in web_archives(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    rows = [tuple(r) for r in frame.collect()]
    assert len(got) == len(rows) and set(got) == expected(rows)
