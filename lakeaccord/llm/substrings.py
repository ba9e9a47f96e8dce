"""Repeated passages: texts parsed against an index of reference blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .components import stored

#: Words of a window, and of the piece of a window that names the block it lies in.
WINDOW, PIECE = 20, 5


def _windows(data: np.ndarray, offsets: np.ndarray):
    """Words of a block of rows; windows of WINDOW words with their hash and the name of their block."""
    starts, ends, rows = ta.words(data, offsets, ta.NOT_SPACE)
    hashes = ta.word_hashes(data, starts, ends)
    full, at = ta.window_hashes(hashes, rows, WINDOW)
    least = np.zeros(0, np.uint64)
    if len(at):
        pieces = np.zeros(len(hashes), np.uint64)  # of pieces across rows too; windows in one row don't reach those
        every, _ = ta.window_hashes(hashes, np.zeros(len(hashes), np.int8), PIECE)
        pieces[: len(every)] = every
        count, done, least = WINDOW - PIECE + 1, 1, pieces
        while done < count:  # the smallest of `count` pieces from each place on, by doubling
            step = min(done, count - done)
            shifted = np.full(len(least), np.iinfo(np.uint64).max, np.uint64)
            shifted[: len(least) - step] = least[step:]
            least, done = np.minimum(least, shifted), done + step
        least = least[at]
    return starts, ends, rows, hashes, full, at, least


def _rows_of_first(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which entries are the first with their key in their row."""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    first = np.ones(len(keys), bool)
    same = (keys[order][1:] == keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    first[order[1:][same]] = False
    return first


def _joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> list[str]:
    """SHA-256 of each row's given words joined by one space."""
    n = len(offsets) - 1
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    keep = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    inner = ends[:-1][rows[:-1] == rows[1:]]  # behind a word that another of its row follows is white space
    keep[inner] = True
    text = data.copy()
    text[inner] = 0x20
    places = np.concatenate([[0], np.cumsum(keep)])[offsets]
    text = text[keep].tobytes()
    return [hashlib.sha256(text[places[i] : places[i + 1]]).hexdigest() for i in range(n)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in ta.blocks(batch.column(1)):
            n = len(offsets) - 1
            starts, ends, rows, hashes, full, at, least = _windows(data, offsets)
            counts = np.bincount(rows, minlength=n)
            digest = np.zeros(n, np.uint64)
            if len(rows):
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                present = np.flatnonzero(counts)
                digest[present] = np.add.reduceat(ta.mix(hashes + ta.mix(place.astype(np.uint64))), np.searchsorted(rows, present))
            new = _rows_of_first(least, rows[at])
            again = ~_rows_of_first(full, rows[at])
            repeats = np.bincount(rows[at][again], minlength=n) > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), pa.array(counts, pa.int64()), pa.array(digest.view(np.int64)), pa.array(_joined(data, offsets, starts, ends, rows)),
                 pa.array(repeats), ta.row_lists(least[new].view(np.int64), rows[at][new], n, pa.int64())],
                names=["doc_id", "n_words", "digest", "sha256", "repeats", "blocks"],
            )


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in blocks that other texts have too, and later places of windows that a text repeats itself."""
    for batch in batches:
        lists = batch.column(3)
        for first, data, offsets in ta.blocks(batch.column(2)):
            n = len(offsets) - 1
            *_, rows, _, full, at, least = _windows(data, offsets)
            of = rows[at]
            new = _rows_of_first(full, of)
            wanted = np.zeros(len(at), bool)
            bounds = np.searchsorted(of, np.arange(n + 1))
            for i in range(n):
                names = lists[first + i].values
                if names is not None and len(names):
                    wanted[bounds[i] : bounds[i + 1]] = np.isin(least[bounds[i] : bounds[i + 1]], names.to_numpy(zero_copy_only=False).view(np.uint64))
            place = at - np.searchsorted(rows, of)
            wanted &= new
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), batch.column(1).slice(first, n), ta.row_lists(full[wanted].view(np.int64), of[wanted], n, pa.int64()),
                 ta.row_lists(place[wanted], of[wanted], n, pa.int32()), ta.row_lists(place[~new], of[~new], n, pa.int32())],
                names=["doc_id", "digest", "windows", "starts", "own"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(3)
        for first, data, offsets in ta.blocks(batch.column(2)):
            n = len(offsets) - 1
            starts, ends, rows = ta.words(data, offsets, ta.NOT_SPACE)
            bounds = np.searchsorted(rows, np.arange(n + 1))
            change = np.zeros(len(rows) + WINDOW + 1, np.int64)
            for i in range(n):
                at = spans[first + i].values
                if at is not None and len(at):
                    at = np.unique(at.to_numpy(zero_copy_only=False)) + bounds[i]
                    np.add.at(change, at, 1)
                    np.add.at(change, at + WINDOW, -1)
            gone = np.cumsum(change)[: len(rows)] > 0
            removed = np.bincount(rows[gone], minlength=n)
            kept = ~gone
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(removed, pa.int64()), pa.array(_joined(data, offsets, starts[kept], ends[kept], rows[kept]))],
                names=["doc_id", "digest", "n_removed", "kept_sha256"],
            )


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def repeated_passages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: words of passages that occur earlier are removed.

    A passage is WINDOW consecutive words; earlier is a smaller doc_id, or the
    same document at an earlier start. Texts are parsed relative to each other:
    a window lies in the block named by the smallest hash of its PIECE-word
    pieces, so equal windows lie in blocks of one name. Equal texts are one
    factor and are settled first. The index of block names then tells which
    blocks of a text occur in another one. Only there the factors' boundaries
    are checked, window by window, against each window's first document. Names
    and windows that are frequent are aggregated before they are shuffled.

    A null or wordless text has no words. A row without doc_id is neither cut
    nor a reference. Rows that share a doc_id precede each other in no way.
    An empty table gives no rows. Other columns of `docs` are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parsed = stored(spark, docs.mapInArrow(_parse, "doc_id bigint, n_words bigint, digest bigint, sha256 string, repeats boolean, blocks array<bigint>"), "parsed")
    known = parsed.where(f"doc_id is not null and n_words >= {WINDOW}")
    first = stored(spark, known.groupBy("n_words", "digest").agg(F.min("doc_id").alias("first_id")), "first")

    names = known.select("digest", F.explode("blocks").alias("name"))
    shared = names.groupBy("name").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("name")
    found = names.join(shared, "name").groupBy("digest").agg(F.collect_set("name").alias("names"))
    found = stored(spark, found, "names")
    chosen = known.select("doc_id", "n_words", "digest", "repeats").join(first, ["n_words", "digest"]).where("doc_id = first_id")
    chosen = chosen.join(found, "digest", "left").where("repeats or names is not null").select("doc_id", "digest", "names")
    texts = docs.join(chosen.dropDuplicates(["doc_id", "digest"]), "doc_id").select("doc_id", "digest", "text", "names")
    at_edges = stored(spark, texts.mapInArrow(_boundaries, "doc_id bigint, digest bigint, windows array<bigint>, starts array<int>, own array<int>"), "windows")

    windows = at_edges.select("doc_id", "digest", F.explode(F.arrays_zip("windows", "starts")).alias("w")).select("doc_id", "digest", F.col("w.windows").alias("window"), F.col("w.starts").alias("start"))
    earliest = windows.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("window", "low")
    late = windows.join(earliest, "window").where("doc_id > low").groupBy("doc_id", "digest").agg(F.collect_set("start").alias("late"))
    spans = at_edges.select("doc_id", "digest", "own").join(late, ["doc_id", "digest"], "left")
    spans = spans.select("doc_id", "digest", F.when(F.col("late").isNull(), F.col("own")).otherwise(F.concat("own", "late")).alias("spans")).where("size(spans) > 0")
    spans = stored(spark, spans, "spans").dropDuplicates(["doc_id", "digest"])
    edits = docs.join(spans, "doc_id").select("doc_id", "digest", "text", "spans").mapInArrow(_cut, "doc_id bigint, digest bigint, n_removed bigint, kept_sha256 string")
    edits = stored(spark, edits, "edits").dropDuplicates(["doc_id", "digest"])

    rows = parsed.drop("blocks", "repeats").join(first, ["n_words", "digest"], "left").join(edits, ["doc_id", "digest"], "left")
    copy = F.col("doc_id") > F.col("first_id")
    return rows.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
