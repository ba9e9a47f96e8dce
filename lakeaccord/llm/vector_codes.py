"""Vectors compressed to codes: a codebook per part, its nearest entries found by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are held within these bounds, so that no distance leaves 64 bits.
LARGEST = 1 << 26
#: Vectors of neighbouring sums that search together, and entries that a step outward takes.
BLOCK, REACH = 256, 32
#: A label with more than this share of the rows is hot: there are at most 1 / HOT of them.
HOT = 1 / 64


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label, vector: integer components floor(1024 * x) of the vectors without null or non-finite ones."""
    finite = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(F.col(column), lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    return vectors.where(F.col(column).isNotNull() & finite).select("vec_id", "label", whole.alias("vector"))


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry; ties go to the lower index.

    Entries are sorted by component sum. From a row's own sum the search goes
    outward on both sides, until the squared gap of the sums over the dimension
    strictly exceeds the best distance: by Cauchy's inequality no entry beyond
    can be as near. Rows of neighbouring sums walk together in blocks, and a
    block goes on as long as one of its rows must.
    """
    n, width = points.shape
    span = int(max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * span * span * max(width, 1) < 1 << 53 else np.int64  # either way exact
    points, book = points.astype(kind), book.astype(kind)
    sums, own = book.sum(1), points.sum(1)
    order = np.argsort(sums, kind="stable")
    sums, entries = sums[order], book[order]
    squares = (entries * entries).sum(1)
    where, far = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows = np.argsort(own, kind="stable")
    for first in range(0, n, BLOCK):
        block = rows[first : first + BLOCK]
        p, s = points[block], own[block]
        norm = (p * p).sum(1)
        best, index = np.full(len(block), np.inf if kind is np.float64 else np.iinfo(np.int64).max, kind), np.full(len(block), len(book))

        def look(a: int, b: int, p=p, norm=norm, best=best, index=index) -> None:
            d = norm[:, None] + squares[a:b] - 2 * (p @ entries[a:b].T)
            least = d.min(1)
            at = np.where(d == least[:, None], order[a:b], len(book)).min(1)
            better = (least < best) | ((least == best) & (at < index))
            best[better], index[better] = least[better], at[better]

        def open_at(e: int, side: int, s=s, best=best) -> bool:
            gap = np.maximum(side * (sums[e] - s), 0).astype(np.float64)
            return bool((gap * gap * (1 - 1e-12) <= best.astype(np.float64) * width).any())

        right = left = int(np.searchsorted(sums, s[len(s) // 2]))
        go_right, go_left = right < len(book), left > 0
        while go_right or go_left:
            if go_right:
                look(right, right := min(len(book), right + REACH))
                go_right = right < len(book) and open_at(right, 1)
            if go_left:
                upper, left = left, max(0, left - REACH)
                look(left, upper)
                go_left = left > 0 and open_at(left - 1, -1)
        where[block], far[block] = index, best.astype(np.int64)
    return where, far


def _matrix(column, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), length)


def _parts(vectors: np.ndarray, books: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The consecutive parts; where the length is no multiple, zeros stand behind the last one."""
    width = books[0].shape[1]
    padded = np.zeros((len(vectors), width * len(books)), np.int64)
    padded[:, : vectors.shape[1]] = vectors
    return (padded[:, k * width : (k + 1) * width] for k in range(len(books)))


def _summed(books: list[np.ndarray], length: int) -> Callable:
    """Count and component sums of each entry's parts, one row per entry and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for k, part in enumerate(_parts(_matrix(batch.column(0), length), books)):
                at, _ = nearest(part, books[k])
                counts[k] += np.bincount(at, minlength=len(books[k]))
                np.add.at(sums[k], at, part)
        for k, book in enumerate(books):
            used = np.flatnonzero(counts[k])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * book.shape[1], pa.int32()), pa.array(sums[k][used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[k][used]), lists], names=["part", "entry", "n", "sums"])

    return run


def _coded(books: list[np.ndarray], length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(part, books[k]) for k, part in enumerate(_parts(_matrix(batch.column(2), length), books))]
            code = np.stack([at for at, _ in found], 1).astype(np.uint8)
            error = np.sum([d for _, d in found], 0, dtype=np.int64)
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(books)), len(code), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """The entries of each part after `rounds` rounds, and the length of a vector.

    `vectors` is what :func:`kept` gives. The driver sees the first 256 vectors
    and, per round, at most 256 sums a part, whatever the number of rows; each
    task adds up its rows before anything is dealt out.
    """
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    first = [r["vector"] for r in vectors.select("vec_id", "vector").orderBy(*order).limit(ENTRIES).collect()]
    length = len(first[0]) if first else 0
    if any(len(v) != length for v in first):
        first = [r["vector"] for r in vectors.where(F.size("vector") == length).select("vec_id", "vector").orderBy(*order).limit(ENTRIES).collect()]
    width = -(-length // PARTS)
    books = list(_parts(np.array(first, np.int64).reshape(len(first), length), [np.zeros((0, width))] * PARTS))
    vectors = vectors.where(F.size("vector") == length).select("vector")
    for _ in range(rounds if first else 0):
        found = vectors.mapInArrow(_summed(books, length), "part int, entry int, n bigint, sums array<bigint>")
        total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
        books = [b.copy() for b in books]
        for r in total.collect():
            books[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
    return books, length


def encode(vectors: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """vec_id, label, code (one byte a part), error: the kept vectors of this length by their nearest entries."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.where(F.size("vector") == length).select("vec_id", "label", "vector").mapInArrow(_coded(books, length), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error bigint")


def decode(codes: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """vec_id, vector: the entries that the codes name, put together again as integer components."""
    table = F.array(*(F.array(*(F.array(*(F.lit(int(x)) for x in entry)) for entry in b)) for b in books))
    digit = lambda k: F.conv(F.hex(F.substring("code", k + 1, 1)), 16, 10).cast("int")
    return codes.select("vec_id", F.slice(F.concat(*(table[k][digit(k)] for k in range(len(books)))), 1, length).alias("vector"))


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimals, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(spark: SparkSession, coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels; null labels are one.

    Labels are added up before they meet rows. Those that hold more than one
    row in 64 are looked up in a map of at most 64 entries; only rows of the
    others are dealt out by label.
    """
    totals = stored(spark, coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")), "label-errors")
    rows = totals.agg(F.sum("n")).first()[0] or 0
    hot = totals.where(F.col("n") > rows * HOT).collect()
    is_hot, value = F.lit(False), F.lit(None).cast("bigint")
    for r in hot:
        same = F.col("label").eqNullSafe(F.lit(r["label"]))
        is_hot, value = is_hot | same, F.when(same, r["label_error"]).otherwise(value)
    rest = totals.where(F.col("n") <= rows * HOT).select(F.col("label").alias("of"), "label_error")
    cold = coded.where(~is_hot).join(rest, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    return coded.where(is_hot).withColumn("label_error", value).unionByName(cold)


def compress(spark: SparkSession, vectors: DataFrame, column: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], int]:
    """Codes of all kept vectors (vec_id, label, code, error, label_error), the codebooks and the vectors' length.

    A row whose vector is null or holds null or non-finite components is
    dropped, as is one of another length than the kept vector of the smallest
    vec_id; components beyond +-65,536 are held there. A length that four does
    not divide ends in zeros. Null ids come last where the smallest are taken,
    and equal ids stand in the order of their vectors; repeated rows count each.
    With fewer than 256 vectors there are as many entries. Other columns are
    not read; an empty table gives no rows.
    """
    whole = stored(spark, kept(vectors, column), "vectors")
    books, length = codebooks(whole, rounds)
    coded = stored(spark, encode(whole, books, length), "codes")
    return with_label_error(spark, coded), books, length
