"""WARC archives: written as text, read back along verified record boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import stored

MAGIC = "WARC/1.1\r\n"
DATE = "1970-01-01T00:00:00Z"
#: Equal payloads of at least so many bytes are written once.
REVISIT_BYTES = 1000
SEGMENT = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "path string, block bigint, rel bigint, after bigint, leaves bigint, type string, record_id string, page_id bigint, refers_to string, "
    "declared string, header_bytes bigint, length bigint, payload_bytes bigint, sha1 string, payload binary"
)


def write_archives(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Writes one record per row of page_id, url, html below `path`, as uncompressed archives.

    A payload is the html in UTF-8; a null one is empty. Of equal payloads of
    at least REVISIT_BYTES bytes the row with the largest page_id is a response
    and the others revisit it; rows that repeat this page_id are responses too,
    and a null page_id counts as the smallest. A url of any length is written
    whole; one that ends like the magic has its last character percent-encoded,
    since line ends of a header follow it. Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select("page_id", "url", "html", F.octet_length("html").alias("bytes"), F.unhex(F.sha1("html")).alias("digest"))
    largest = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first_id is not null")
    # Written first, so that Spark knows its size: below the broadcast threshold no payload is shuffled.
    largest = stored(pages.sparkSession, largest.drop("copies"), "copies")
    rows = rows.join(largest, ["digest", "bytes"], "left").withColumn("digest", F.lower(F.hex("digest")))
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first_id")))
    identity = lambda page: F.regexp_replace(F.md5(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("none")), "digest")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    named = lambda name, page: line(name, F.concat(F.lit("<urn:uuid:"), identity(page), F.lit(">")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    rows = rows.select("*", revisit.alias("revisit"), http.alias("http"))
    header = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))), named("WARC-Record-ID", F.col("page_id")), line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), r"WARC/1\.1\z", "WARC/1.%31"))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(F.col("page_id").isNull(), F.lit("")).otherwise(line("WARC-Page-ID", F.col("page_id").cast("string"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), named("WARC-Refers-To", F.col("first_id")))).otherwise(F.lit("")),
        line("Content-Length", (F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))).cast("string")), F.lit("\r\n"),
    )
    body = F.concat("http", F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    rows.select(F.concat(header, body, F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").text(path)


def _header(line: bytes) -> tuple[dict[str, str], int, int] | None:
    """Fields, where the block starts, and its declared length; None where no record can start."""
    end = line.find(b"\r\n\r\n")  # headers are as long as their url
    if end < 0:
        return None
    fields = {}
    for field in line[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = field.partition(":")
        if not colon or not name.strip():
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in fields:
        return None
    return fields, end + 4, int(length)


def _payload(block: bytes, fields: dict[str, str]) -> bytes:
    if fields.get("content-type", "").startswith("application/http"):
        end = block.find(b"\r\n\r\n")
        return block[end + 4 :] if end >= 0 else b""
    return block


def _row(split: tuple, rel: int, fields: dict, begin: int, length: int) -> dict:
    page = fields.get("warc-page-id", "")
    return dict(
        path=split[0], block=split[1], rel=rel, after=rel + len(MAGIC) + begin + length + 4, leaves=None, type=fields["warc-type"], record_id=fields.get("warc-record-id"),
        page_id=int(page) if page.removeprefix("-").isdigit() else None, refers_to=fields.get("warc-refers-to"), declared=fields.get("warc-payload-digest"),
        header_bytes=len(MAGIC) + begin, length=length, payload_bytes=None, sha1=None, payload=None,
    )


def _settled(row: dict, fields: dict, data: bytes, payloads: bool) -> None:
    """What a whole record says; one that does not end as its header declares has no successor."""
    begin = row["header_bytes"] - len(MAGIC)
    if data[begin + row["length"] : begin + row["length"] + 4] != b"\r\n\r\n":
        row["after"] = None
        return
    payload = _payload(data[begin : begin + row["length"]], fields)
    row["payload_bytes"], row["sha1"] = len(payload), hashlib.sha1(payload).hexdigest()
    if payloads:
        row["payload"] = payload


def _scan(payloads: bool):
    """Candidates of each split with their successors, relative to the split's first line, and the split's bytes.

    A payload that holds the magic is cut there; the parts up to the declared
    end are put together as long as the split goes on.
    """
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("after", pa.int64()), ("leaves", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()),
                        ("refers_to", pa.string()), ("declared", pa.string()), ("header_bytes", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("sha1", pa.string()), ("payload", pa.binary())])

    def ended(split: tuple, rows: list[dict], at: int) -> pa.RecordBatch:
        leaves: dict[int, int | None] = {}
        for row in reversed(rows):  # where the chain from a candidate leaves the split
            after = row["after"]
            row["leaves"] = leaves[row["rel"]] = None if after is None else leaves[after] if after in leaves else after if after >= at - len(MAGIC) else None
        sized = dict.fromkeys(schema.names) | {"path": split[0], "block": split[1], "length": at}
        return pa.RecordBatch.from_pylist([*rows, sized], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, rows, open_, at = None, [], [], 0
        for batch in batches:
            for path, block, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (path, block) != split:
                    if split:
                        yield ended(split, rows, at)
                    split, rows, open_, at = (path, block), [], [], 0
                line = line.as_py()
                size = len(line)
                for parts in open_:  # of a payload with the magic inside
                    parts[2].append(MAGIC.encode())
                    parts[2].append(line)
                    parts[3] -= len(MAGIC) + size
                for parts in open_:
                    if parts[3] <= 0:
                        _settled(parts[0], parts[1], b"".join(parts[2]), payloads)
                open_ = [parts for parts in open_ if parts[3] > 0]
                if (block or at) and (found := _header(line)):
                    fields, begin, length = found
                    rows.append(row := _row(split, at - len(MAGIC), fields, begin, length))
                    missing = begin + length + 4 - size
                    if missing <= 0:
                        _settled(row, fields, line, payloads)
                    else:
                        open_.append([row, fields, [line], missing])
                at += size + len(MAGIC)
        if split:
            yield ended(split, rows, at)

    return run


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _followed(pairs) -> object:
    """The records of one split that its entry reaches."""
    after = dict(zip(pairs["at"], pairs["after"], strict=True))
    at, kept = pairs["entry"].iloc[0], set()
    while at in after and at not in kept:
        kept.add(at)
        at = after[at]
    return pairs[pairs["at"].isin(kept)][["path", "at"]]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, at = None, 0
    for batch in batches:
        out = []
        for path, block, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (path, block) != split:
                split, at = (path, block), 0
            line = line.as_py()
            out.append((path, block, at, line))
            at += len(line) + len(MAGIC)
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["path", "block", "rel", "line"])


def _assembled(payloads: bool):
    def run(frame):
        frame = frame.sort_values("line_at")
        data = MAGIC.encode().join(frame["line"])
        fields, begin, length = _header(data)
        row = {"after": 0, "header_bytes": len(MAGIC) + begin, "length": length, "payload_bytes": None, "sha1": None, "payload": None}
        _settled(row, fields, data, payloads)
        import pandas as pd

        return pd.DataFrame({"path": frame["path"].iloc[:1], "at": frame["at"].iloc[:1], "bytes_": [row["payload_bytes"]], "sha1_": [row["sha1"]], "payload_": [row["payload"]]})

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records below `path`: path, at, type, record_id, page_id, refers_to, declared, payload_bytes, sha1, payload.

    Each task splits its part of a file at the magic and gives every candidate
    the offset where the next record must start by the declared length, and
    where the chain of such offsets leaves the task's part. From the start of
    each file pointers jump along these exits, by twice as many parts each
    round, and mark the entry of every part; only records on the chain from an
    entry are kept, so the magic inside a payload starts none. A record that
    does not end as declared ends its file's chain. Payloads are given if asked
    for; sizes and digests are always those of the bytes that were read.
    """
    lines = _lines(spark, path)
    found = stored(spark, lines.mapInArrow(_scan(payloads), RECORD), "candidates")
    sizes = found.where("type is null").select("path", "block", "length")
    before = F.sum("length").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("path", "block", F.coalesce(before, F.lit(0)).alias("base"))
    base = stored(spark, base, "parts")
    placed = found.where("type is not null").join(base.select("path", "block", "base"), ["path", "block"])
    shift = lambda c: (F.col(c) + F.col("base")).alias(c)
    placed = placed.select(*(c for c in found.columns if c not in ("rel", "after", "leaves")), (F.col("rel") + F.col("base")).alias("at"), shift("after"), shift("leaves"))

    jump = placed.select("path", "at", F.col("leaves").alias("to")).where("to is not null")
    entries = base.where("block = 0").select("path", F.lit(0).cast("bigint").alias("at"))
    parts = base.groupBy("path").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < parts:  # jump reaches over `reach` parts
        jump = stored(spark, jump, "jumps")
        entries = stored(spark, entries.union(entries.join(jump, ["path", "at"]).select("path", F.col("to").alias("at"))).distinct(), "entries")
        jump = jump.join(jump.select("path", F.col("at").alias("to"), F.col("to").alias("further")), ["path", "to"]).select("path", "at", F.col("further").alias("to"))
        reach *= 2
    starts = placed.select("path", "block", "at").join(entries, ["path", "at"]).groupBy("path", "block").agg(F.min("at").alias("entry"))
    chain = placed.select("path", "block", "at", "after").join(starts, ["path", "block"]).groupBy("path", "block").applyInPandas(_followed, "path string, at bigint")
    kept = placed.join(chain, ["path", "at"])

    open_ = stored(spark, kept.where("sha1 is null and after is not null").select("path", "at", "after"), "open")
    names = ["path", "at", "type", "record_id", "page_id", "refers_to", "declared", "payload_bytes", "sha1", "payload"]
    if not open_.isEmpty():  # payloads with the magic inside that go on in another task's part
        segments = F.explode(F.sequence(F.floor(F.col("at") / SEGMENT), F.floor(F.col("after") / SEGMENT)))
        wanted = open_.select("*", segments.alias("segment"))
        parts = lines.mapInArrow(_placed, "path string, block bigint, rel bigint, line binary").join(base.select("path", "block", "base"), ["path", "block"])
        parts = parts.select("path", "line", (F.col("rel") + F.col("base") - len(MAGIC)).alias("line_at")).withColumn("segment", F.floor(F.col("line_at") / SEGMENT))
        parts = parts.join(wanted, ["path", "segment"]).where("line_at >= at and line_at < after")
        whole = parts.groupBy("path", "at").applyInPandas(_assembled(payloads), "path string, at bigint, bytes_ bigint, sha1_ string, payload_ binary")
        kept = kept.join(whole, ["path", "at"], "left")
        for name, other in (("payload_bytes", "bytes_"), ("sha1", "sha1_"), ("payload", "payload_")):
            kept = kept.withColumn(name, F.coalesce(name, other))
    return kept.where("sha1 is not null").select(*names)
