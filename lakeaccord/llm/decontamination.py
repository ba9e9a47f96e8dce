"""Benchmark passages in texts: exact pieces find them, bit-parallel edit distance confirms them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .toxicity import _folded

#: Errors allowed, as a share of an item's characters.
ERRORS = 0.08
#: Bytes of benchmark text that are searched for at a time.
BLOCK_BYTES = 4 << 20

LEAK = "doc_id bigint, item_id bigint, start bigint, end bigint, distance int"


def normalized(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Lower-cased words of each row joined by one space, and where each row begins."""
    data = _folded(data)
    starts, ends, rows = ta.words(data, offsets, ta.ALNUM)
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    keep = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    inner = ends[:-1][rows[:-1] == rows[1:]]
    data[inner] = 0x20
    keep[inner] = True
    return data[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[offsets]


def normalized_text(text: str) -> str:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return normalized(data, np.array([0, len(data)]))[0].decode("utf-8", "replace")


def budget(length: int, errors: float = ERRORS) -> int:
    return int(length * errors)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length: that many edits leave one of them whole."""
    bounds = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:], strict=False) if b > a]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def closest(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of text closest to the pattern; the first end of the smallest distance.

    Myers' bit-parallel columns: one word of m bits holds the differences down a
    column of the dynamic programming matrix.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(xv | up) & full, up & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _searcher(items: list[tuple[int | None, str]], errors: float) -> Callable:
    """(row, item, start, end, distance) of a text column, for benchmark items of bounded size."""

    def machine_of():
        import ahocorasick

        found_at: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(items):
            for place, piece in pieces(item, budget(len(item), errors)):
                found_at.setdefault(piece, []).append((k, place))
        machine = ahocorasick.Automaton()
        for piece, places in found_at.items():
            machine.add_word(piece, (len(piece), places))
        machine.make_automaton()
        return machine

    kept: list = []  # the automaton, made once a task
    tables: dict[int, tuple] = {}

    def verified(text: str, k: int, cell: int) -> tuple[int, int, int] | None:
        item = items[k][1]
        most = budget(len(item), errors)
        if k not in tables:
            tables[k] = masks(item), masks(item[::-1])
        low = max(0, cell * max(1, most) - most)
        high = (cell + 1) * max(1, most) + len(item) + most
        distance, stop = closest(tables[k][0], len(item), text[low:high])
        if distance > most:
            return None
        if not most and (text[low + stop - len(item) - 1 : low + stop - len(item)] not in ("", " ") or text[low + stop : low + stop + 1] not in ("", " ")):
            return None  # an item without error budget is whole words
        _, length = closest(tables[k][1], len(item), text[max(0, low + stop - len(item) - most) : low + stop][::-1])
        return low + stop - length, low + stop, distance

    def search(column) -> Iterator[tuple[int, int, int, int, int]]:
        machine = kept[0] if kept else kept.append(machine_of()) or kept[0]
        for first, data, offsets in ta.blocks(column):
            flat, begins = normalized(data, offsets)
            for i in range(len(offsets) - 1):
                text = flat[begins[i] : begins[i + 1]].decode("utf-8", "replace")
                tried: dict[tuple[int, int], None] = {}
                for end, (size, places) in machine.iter(text):
                    for k, place in places:
                        tried[k, (end + 1 - size - place) // max(1, budget(len(items[k][1]), errors))] = None
                places_of: dict[int, set] = {}
                for k, cell in tried:
                    if found := verified(text, k, cell):
                        places_of.setdefault(k, set()).add(found)
                for k in sorted(places_of):
                    done = -1
                    for start, stop, distance in sorted(places_of[k], key=lambda x: (x[0], x[2], x[1])):
                        if start >= done:  # cells beside each other find the same place
                            done = stop
                            yield first + i, k, start, stop, distance

    return search


def _listed(items: list[tuple[int | None, str]], errors: float) -> Callable:
    search = _searcher(items, errors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[row], items[k][0], start, end, distance) for row, k, start, end, distance in search(batch.column(1))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "start", "end", "distance"])

    return run


def _without(items: list[tuple[int | None, str]], errors: float) -> Callable:
    search = _searcher(items, errors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, *_ in search(batch.column(batch.schema.get_field_index("text")))]] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items with their normalized texts, in blocks of bounded size; the driver holds one partition at a time."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null and text <> ''")
    block, size = [], 0
    for row in items.toLocalIterator():
        text = normalized_text(row["text"])
        if text:
            block.append((row["item_id"], text))
            size += len(text)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, start, end, distance: places of `docs` within the error budget of a benchmark item.

    Texts and items are lower-cased words joined by one space; places are
    characters of that form. An item with a budget of k errors is cut into k+1
    pieces, one of which must occur exactly. Around each exact piece Myers'
    algorithm finds the closest stretch. Places of an item that overlap are
    given once. An item too short for any error is found as whole words only.
    The benchmark is taken in blocks of bounded size, each of which
    goes to all tasks in one pass over the texts; the texts are never shuffled.

    Null or empty texts and items have no places. Items that repeat, and rows of
    `docs` that repeat, are found each; a null id stays null. Empty tables give
    no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and text <> ''")
    found = None
    for block in _blocks(benchmark, block_bytes):
        one = docs.mapInArrow(_listed(block, errors), LEAK)
        found = one if found is None else found.union(one)
    return found if found is not None else spark.createDataFrame([], LEAK)


def clean(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no item of the benchmark."""
    schema = docs.schema
    for block in _blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(_without(block, errors), schema)
    return docs
