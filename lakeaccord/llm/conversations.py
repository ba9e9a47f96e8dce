"""Conversations brought back to alternating roles by alignment with the grammar's strings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of edits; a kept or re-roled turn that is cut short costs CUT_SHORT more.
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: Faults of a turn; a blank or repeated one must be deleted.
SOUND, BLANK, REPEATED, TRUNCATED = 0, 1, 2, 3
#: Rows of the alignment table that are held at once; others are computed anew from every such row.
STEP = 512

_WHITE = " \t\n\x0b\x0c\r"
_FAR = 1 << 40
_ROLES = {"u": "user", "a": "assistant"}


def damage(rows: DataFrame) -> DataFrame:
    """The rows of the test design: by crc32 of `conv_id:turn` modulo 20 some are dropped (0), emptied (1), lose their ends (2), are repeated (3) or become the user's (4).

    A null, be it an id, a role or a text, counts as one space; turn and conv_id
    themselves stay null. Other columns are left out.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    laid = rows.select("conv_id", "turn", "role", "text", kind.alias("kind"))
    laid = laid.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(0), times)).alias("copy"))
    return laid.where("copy > 0").drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the digest that tells turns of one number apart and repeats from others."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _first(role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    return F.when(initial.isin("s", "u", "a"), initial).otherwise(".")


def _greedy(initials: str, faults: bytes) -> int:
    """The cost of one way to the grammar: the first incumbent."""
    cost, last, kept = 0, "", False
    for role, fault in zip(initials, faults, strict=True):
        if fault in (BLANK, REPEATED):
            cost += DELETE
            continue
        want = "a" if last == "u" else "u"
        cost += CUT_SHORT * (fault == TRUNCATED)
        if role == "s" and not kept:
            last = "s"
        elif role == want:
            last = want
        elif role in "ua":  # the missing turn before it
            cost, last = cost + INSERT, role
        else:
            cost, last = cost + REROLE, want
        kept = True
    return cost + {"u": INSERT, "s": 2 * INSERT}.get(last, 0)


class _Table:
    """Wagner-Fischer costs of turns i.. against the last r symbols of `uaua...`, and of these with an `s` before them.

    Targets of all lengths end alike, so one table from the end serves them
    all. A cell is kept where the incumbent leaves it possible: r may exceed
    the free turns from i on by as many insertions, or fall short by as many
    deletions, as the incumbent's cost above the unavoidable one pays for.
    """

    def __init__(self, initials: str, faults: bytes):
        self.initials, self.faults, self.n = initials, faults, len(initials)
        self.forced = [f in (BLANK, REPEATED) for f in faults]
        left = np.zeros(self.n + 1, np.int64)
        left[:-1] = np.cumsum(~np.array(self.forced, bool)[::-1])[::-1] if self.n else 0
        self.left = left.tolist()
        cut = faults.count(TRUNCATED)
        unavoidable = DELETE * (self.n - self.left[0]) + CUT_SHORT * cut
        everything = DELETE * self.n
        spare = min(_greedy(initials, faults), everything) - unavoidable
        fewer = spare if spare <= cut else cut + (spare - cut) // DELETE  # deleting a cut turn costs one more than keeping it
        self.down = min(fewer, self.left[0]) + 1
        self.up = spare // INSERT + 1
        self.width = self.down + self.up + 1
        self.climb = INSERT * np.arange(self.width)
        base = np.arange(self.width) - self.down
        self.marks = {self.n: (np.where(base >= 0, INSERT * base, _FAR), np.full(self.width, _FAR))}
        rows = self.marks[self.n]
        for i in range(self.n - 1, -1, -1):
            rows = self._row(i, rows)
            if i % STEP == 0:
                self.marks[i] = rows
        self.held = {}

    def _row(self, i: int, below: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if self.forced[i]:
            return below[0] + DELETE, below[1] + DELETE
        r = np.arange(self.width) - self.down + self.left[i]
        cut = CUT_SHORT * (self.faults[i] == TRUNCATED)
        shorter = np.append(below[0][1:], _FAR)
        fits = np.where(r % 2 == 0, cut + REROLE * (self.initials[i] != "u"), cut + REROLE * (self.initials[i] != "a"))
        best = np.minimum(DELETE + shorter, np.where(r >= 1, fits + below[0], _FAR))
        best[r < 0] = _FAR
        best = np.minimum.accumulate(best - self.climb) + self.climb
        headed = DELETE + np.append(below[1][1:], _FAR)
        if self.initials[i] == "s":
            headed = np.minimum(headed, cut + shorter)
        return best, headed

    def at(self, i: int, r: int, headed: bool) -> int:
        k = r - self.left[i] + self.down
        if not 0 <= k < self.width or r < 0:
            return _FAR
        rows = self.marks.get(i) or self.held.get(i)
        if rows is None:
            top = min(self.n, (i // STEP + 1) * STEP)
            self.held, rows = {}, self.marks[top]
            for j in range(top - 1, i // STEP * STEP, -1):
                rows = self.held[j] = self._row(j, rows)
            rows = self.held[i]
        return int(rows[headed][k])

    def targets(self) -> Iterator[tuple[int, bool, int]]:
        """(symbols, with an s before them, cost) of every target length the band leaves feasible."""
        for r in range(0, self.left[0] + self.up + 2, 2):
            for headed in (False, True)[: 1 + (r > 0)]:
                yield r, headed, self.at(0, r, headed)

    def audit(self, r: int, headed: bool) -> str:
        """The ASCII-least of the cheapest edits, walked back through the table: D before I before K before R."""
        i, out = 0, []
        while i < self.n or r or headed:
            here = self.at(i, r, headed)
            if i < self.n and here == DELETE + self.at(i + 1, r, headed):
                out.append("D")
                i += 1
            elif not headed and r and here == INSERT + self.at(i, r - 1, False):
                out.append("I")
                r -= 1
            elif headed:
                out.append("K")
                i, headed = i + 1, False
            else:
                out.append("K" if self.initials[i] == ("a" if r % 2 else "u") else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def align(initials: str, faults: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits that make the roles `(s?(ua)+)?`; of equal costs the ASCII-least audit.

    `initials` holds s, u, a or any other sign per turn, `faults` its fault.
    Every target length the incumbent leaves feasible is aligned, and the
    audits of the cheapest ones are compared.
    """
    table = _Table(initials, faults)
    found = list(table.targets())
    least = min(cost for *_, cost in found)
    return least, min(table.audit(r, headed) for r, headed, cost in found if cost == least)


FIGURES = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


class _Conversation:
    """What one conversation's narrow rows add up to: a few bytes a turn."""

    def __init__(self):
        self.initials, self.faults, self.seen = [], bytearray(), set()
        self.first = self.last = None
        self.turns = self.illegal = 0

    def add(self, turn, initial: str, blank: bool, cut: bool, digest: bytes) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.initials and self.initials[-1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initials.append(initial)
        self.faults.append(BLANK if blank else REPEATED if digest in self.seen else TRUNCATED if cut else SOUND)
        self.seen.add(digest)

    def figures(self) -> tuple:
        cost, audit = align("".join(self.initials), bytes(self.faults))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, *(self.faults.count(f) for f in (BLANK, REPEATED, TRUNCATED)), self.illegal, cost, audit


def _audited(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, out = None, None, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != key:
                    if now is not None:
                        out.append((key, *now.figures()))
                    key, now = conv, _Conversation()
                now.add(*row)
            if out:
                yield flush()
                out = []
        if now is not None:
            out.append((key, *now.figures()))
            yield flush()

    return run


def _arrow(frame: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(frame.schema)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per conversation of `conv_id turn role text`.

    Only initials, faults and digests of turns are dealt by conversation and
    sorted by turn, nulls first; turns of one number stand in the order of
    their digests. A task holds a few bytes per turn of one conversation at a
    time, so a conversation of a third of all rows is no more than that.

    A null role or text is one space. A text without other than white space is
    blank; a role and text seen earlier in the conversation is a duplicate; a
    text whose last such character is none of `.!?` is truncated; the first of
    these counts. Rows with a null conv_id are one conversation. Repeated rows
    are duplicates. Other columns are not read; an empty table gives no rows.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(_WHITE))
    laid = _ordered(rows).select("conv_id", "turn", _first(F.col("role")).alias("initial"), (F.length(trimmed) == 0).alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"), "digest")
    kind = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {FIGURES}"
    sorted_rows = laid.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")
    return sorted_rows.mapInArrow(_audited(_arrow(rows.sparkSession.createDataFrame([], kind))), kind)


class _Repaired:
    """Follows an audit over the turns of its conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def _new(self) -> str:
        self.last = "a" if self.last == "u" else "u"
        return _ROLES[self.last]

    def inserted(self) -> Iterator[tuple]:
        """Edit, role and text of the insertions up to the next turn."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._new(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield edit, self._new(), text
        elif edit == "K":
            self.last = role[0]
            yield edit, role, text


def _walk(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(conversation's own columns, None) where one begins and (the same, edit role text) for each repaired turn."""
    own = now = None
    for batch in batches:
        for *head, is_turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not is_turn:
                if now is not None:
                    yield from ((own, x) for x in now.inserted())
                own, now = head[:width], _Repaired(head[width - 1])
                yield own, None
            elif now is not None and head[0] == own[0]:
                yield from ((own, x) for x in now.turn(role, text))
    if now is not None:
        yield from ((own, x) for x in now.inserted())


def _written(schema: pa.Schema, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, size = [], 0, 0
        for own, turn in _walk(batches, width):
            place = 0 if turn is None else place + 1
            if turn is not None:
                out.append((own[0], place - 1, *turn))
                size += len(turn[2]) + 64
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _digested(schema: pa.Schema, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own, digest, empty = [], None, None, True

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        for own_now, turn in _walk(batches, width):
            if turn is None:
                if own is not None:
                    out.append((*own, digest.hexdigest()))
                own, digest, empty = own_now, hashlib.sha256(), True
                if len(out) >= 4096:
                    yield flush()
                    out = []
            else:
                digest.update(f"{'' if empty else chr(10)}{turn[1]}:{turn[2]}".encode())
                empty = False
        if own is not None:
            out.append((*own, digest.hexdigest()))
            yield flush()

    return run


def _beside(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """Each conversation's audit row, then its turns in order, in one partition."""
    names = found.columns
    turns = _ordered(rows)
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in names[1:]]
    laid = found.select(*names, F.lit(False).alias("is_turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("binary").alias("digest"))
    laid = laid.union(turns.select("conv_id", *none, F.lit(True), "role", "text", "turn", "digest"))
    laid = laid.repartition("conv_id").sortWithinPartitions("conv_id", "is_turn", F.col("turn").asc_nulls_first(), "digest")
    return laid.select(*names, "is_turn", "role", "text"), len(names)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the turns that the audits in `found` leave, place counted from 0.

    `found` is what :func:`audits` gives for the same rows, with the audit as
    last column. Turns and audits meet in one partition per conversation and
    pass through it one at a time; no conversation's texts are held.
    """
    laid, width = _beside(rows, found)
    kind = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place bigint, edit string, role string, text string"
    return laid.mapInArrow(_written(_arrow(rows.sparkSession.createDataFrame([], kind)), width), kind)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`found` with repaired_sha256, the SHA-256 of the repaired `role:text` joined by newlines; texts stream through it."""
    laid, width = _beside(rows, found)
    kind = found.limit(0).withColumn("repaired_sha256", F.lit("")).schema
    return laid.mapInArrow(_digested(_arrow(found.sparkSession.createDataFrame([], kind)), width), kind)
