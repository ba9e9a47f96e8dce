"""Token sequences of fixed capacity, packed by linear grouping and best fit."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .components import stored

CAPACITY, END = 2048, 0
#: Groups of equal cardinality among the large pieces; a piece of at most this share of the capacity is small.
GROUPS, SMALL_SHARE = 1024, 16
#: Encoded words that a task keeps before it starts anew.
CACHE = 400_000

# Fixed values of the public vocabulary: its splitting pattern and its one special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"

#: A space before one of these bytes starts a token: visible ASCII and lead bytes under which no white space lies.
_OPENS = np.zeros(256, bool)
_OPENS[0x21:0x7F] = True
_OPENS[0xC3:0xF5] = True
_OPENS[[0xE1, 0xE2, 0xE3]] = False


def encoder(path: str):
    """The byte-level BPE of a tokenizer file: equal ids, by a faster public library."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


class _Words:
    """Ids of words seen, found by hash; only new words are encoded."""

    def __init__(self, path: str):
        self.encode = encoder(path).encode
        self.clear()

    def clear(self) -> None:
        self.keys, self.begins, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of rows, and where each row's ids begin and the last end."""
        space = np.flatnonzero((data[:-1] == 0x20) & _OPENS[data[1:]]) if len(data) > 1 else np.zeros(0, np.int64)
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts = np.union1d(space, heads)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes = ta.word_hashes(data, starts, ends)
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        new = np.flatnonzero(~(np.append(self.keys, np.uint64(0))[at] == distinct) | (at == len(self.keys)))
        if len(new):
            text = data.tobytes()
            found = [self.encode(text[starts[i] : ends[i]].decode("utf-8", "replace"), allowed_special="all") for i in example[new]]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((x for ids in found for x in ids), np.uint32, int(sizes.sum()))
            begins = len(self.ids) + np.cumsum(sizes) - sizes
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.begins, self.sizes = keys[order], np.concatenate([self.begins, begins])[order], np.concatenate([self.sizes, sizes])[order]
            self.ids = np.concatenate([self.ids, flat])
            at = np.searchsorted(self.keys, distinct)
        word = at[which]
        sizes = self.sizes[word]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.begins[word] - total[:-1], sizes) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]


def _cut(path: str, capacity: int, end: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, seen = _Words(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, data, offsets in ta.blocks(batch.column(1)):
                ids, begins = known.ids_of(data, offsets)
                n = len(offsets) - 1
                totals = np.diff(begins) + 1
                pieces = -(-totals // capacity)
                of = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                short = totals - (pieces - 1) * capacity  # the first piece
                start = np.where(piece == 0, 0, short[of] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[of], capacity)
                sums, lists = np.zeros(len(of), np.int64), []
                for i, (row, s, size) in enumerate(zip(of.tolist(), start.tolist(), length.tolist(), strict=True)):
                    at = begins[row] + s
                    last = s + size == totals[row]
                    own = ids[at : at + size - last]
                    if last:
                        own = np.append(own, np.uint32(end))
                    sums[i] = zlib.crc32(own.astype("<u4").tobytes())
                    if with_ids:
                        lists.append(own)
                order = np.argsort(length, kind="stable")
                sizes = length[order]
                rank = np.empty(len(of), np.int64)
                rank[order] = seen[sizes] + np.arange(len(of)) - np.searchsorted(sizes, sizes)
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [batch.column(0).slice(first, n).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                           pa.array(sums), pa.array(np.full(len(of), task), pa.int64()), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                if with_ids:
                    columns, names = [*columns, pa.array(lists, pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _numbered(key: str) -> Callable:
    """Adds the task and the rank among the task's rows of the same key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            distinct, begins, counts = np.unique(keys[order], return_index=True, return_counts=True)
            rank = np.empty(len(keys), np.int64)
            rank[order] = np.arange(len(keys)) + np.repeat([seen.get(k, 0) for k in distinct.tolist()] - begins, counts)
            for k, n in zip(distinct.tolist(), counts.tolist(), strict=True):
                seen[k] = seen.get(k, 0) + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), task), pa.int64()), pa.array(rank)], names=[*batch.schema.names, "task", "rank"])

    return run


def _ranked(frame: DataFrame, key: str) -> tuple[DataFrame, dict[int, int]]:
    """The rank of each row among all rows of its key, from its task and its rank there, and the rows per key.

    Only the counts per task are put in order, never the rows of a key.
    """
    counts = frame.groupBy(key, "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select(key, "task", F.coalesce(before, F.lit(0)).alias("before"))
    totals = {row[0]: row[1] for row in counts.groupBy(key).agg(F.sum("n")).collect()}  # at most one row for each length up to the capacity
    return frame.join(places, [key, "task"]).withColumn("rank", F.col("rank") + F.col("before")).drop("task", "before"), totals


def grouped(sizes: list[int], counts: list[int], groups: int) -> tuple[list[tuple[int, int, int]], int]:
    """(rounded size, first rank, rows) of groups of equal cardinality over rows by falling size."""
    total = sum(counts)
    each = max(1, -(-total // groups))
    bounds, out, at = np.cumsum(counts), [], 0
    while at < total:
        out.append((sizes[int(np.searchsorted(bounds, at, "right"))], at, min(each, total - at)))
        at += each
    return out, each


def configurations(groups: list[tuple[int, int, int]], capacity: int) -> tuple[list[tuple[int, int]], int]:
    """((first rank, first bin) of runs of rows that go to successive bins, bins).

    The largest size left is completed to the fullest reachable sum by the
    sizes left, and this configuration is used as often as the counts allow.
    Each one exhausts a size, so there are few, however many rows there are.
    """
    left = [n for _, _, n in groups]
    next_rank = [first for _, first, _ in groups]
    runs, bins, largest = [], 0, 0
    while largest < len(groups):
        if not left[largest]:
            largest += 1
            continue
        room = capacity - groups[largest][0]
        reach, trail = 1, []
        for g in range(largest, len(groups)):
            size, n = groups[g][0], left[g] - (g == largest)
            if n <= 0 or size > room:
                continue
            trail.append((g, size, min(n, room // size), reach))
            for _ in range(trail[-1][2]):
                reach |= (reach << size) & ((2 << room) - 1)
            if reach >> room & 1:
                break
        best, uses = reach.bit_length() - 1, {largest: 1}
        for g, size, most, before in reversed(trail):
            used = next(u for u in range(most + 1) if best >= u * size and before >> (best - u * size) & 1)
            if used:
                uses[g] = uses.get(g, 0) + used
                best -= used * size
        times = min(left[g] // u for g, u in uses.items())
        for g, u in uses.items():
            for _ in range(u):
                runs.append((next_rank[g], bins))
                next_rank[g] += times
                left[g] -= times
        bins += times
    return sorted(runs), bins


def best_fit(sizes: list[int], counts: list[int], rooms: dict[int, int], capacity: int) -> list[tuple[int, int, int]]:
    """(first rank, room, first number) of runs of small rows by falling size; room 0 is a new bin.

    All rows of a size are placed as runs: one into each bin with the least
    room that holds it, which leaves these bins with less room.
    """
    free = {room: [(room, 0, n)] for room, n in rooms.items() if n and room}
    runs, rank, opened = [], 0, 0
    for size, n in zip(sizes, counts, strict=True):
        while n:
            fits = [room for room in free if room >= size]
            if not fits:
                more = -(-n // (capacity // size))
                free[capacity] = [(0, opened, more)]
                opened += more
                continue
            room = min(fits)
            home, first, have = free[room].pop()
            used = min(n, have)
            if used < have:
                free[room].append((home, first + used, have - used))
            if not free[room]:
                del free[room]
            runs.append((rank, home, first))
            if room > size:
                free.setdefault(room - size, []).append((home, first, used))
            rank, n = rank + used, n - used
    return runs


def _looked_up(runs: list[tuple], lengths: list[int], counts: list[int], columns: list[str]) -> Callable:
    """Replaces a row's length and rank by what its run says; the runs are as few as the lengths allow."""
    before = dict(zip(lengths, (np.cumsum(counts) - counts).tolist(), strict=True))
    table = np.array(runs, np.int64).reshape(len(runs), len(columns) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            place = np.array([before[x] for x in length.tolist()], np.int64) + rank
            at = np.searchsorted(table[:, 0], place, "right") - 1
            found = [*(table[at, k] for k in range(1, table.shape[1] - 1)), table[at, -1] + place - table[at, 0]]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, found)], names=[*kept, *columns])

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds the piece's ids.

    A document is its ids by the tokenizer file, then `end`. One longer than the
    capacity is cut, its first piece the shorter one. Lengths of large pieces
    are rounded up to the largest of their group; groups have equal
    cardinality. Configurations of the few rounded sizes give the bins, actual
    pieces take the places by rank, and small pieces go by best fit into the
    room that the actual lengths leave. The driver sees counts per length only,
    at most `capacity` of them.

    A null or empty text is `end` alone. Every row is packed, rows that repeat
    or have no doc_id too. An empty table gives no rows. Other columns of `docs`
    are not read.
    """
    base = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = f"{base}, task bigint, rank bigint" + ", ids array<int>" * with_ids
    pieces, totals = _ranked(stored(spark, docs.mapInArrow(_cut(tokenizer, capacity, end, with_ids), schema), "pieces"), "length")
    more = ", ids array<int>" * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    pieces = pieces.select(*names, "rank")
    limit = max(1, capacity // SMALL_SHARE)
    lengths = sorted(totals, reverse=True)
    large, small = [x for x in lengths if x > limit], [x for x in lengths if x <= limit]
    numbers = lambda part: [totals[x] for x in part]

    runs, bins = configurations(grouped(large, numbers(large), GROUPS)[0], capacity)
    placed = pieces.where(F.col("length") > limit).mapInArrow(_looked_up(runs, large, numbers(large), ["sequence_id"]), f"{base}{more}, sequence_id bigint")
    placed = stored(spark, placed, "large")
    rooms = placed.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).cast("bigint").alias("room")).where("room > 0").select("room", "sequence_id")
    rooms, room_counts = _ranked(stored(spark, rooms.mapInArrow(_numbered("room"), "room bigint, sequence_id bigint, task bigint, rank bigint"), "rooms"), "room")
    runs = best_fit(small, numbers(small), room_counts, capacity)
    rest = pieces.where(F.col("length") <= limit).mapInArrow(_looked_up(runs, small, numbers(small), ["room", "number"]), f"{base}{more}, room bigint, number bigint")
    rooms = rooms.select("room", F.col("rank").alias("number"), F.col("sequence_id").alias("found"))
    rest = rest.join(rooms, ["room", "number"], "left").withColumn("sequence_id", F.coalesce("found", F.col("number") + F.lit(bins)))
    every = placed.select(*names, "sequence_id").union(rest.select(*names, "sequence_id"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
