"""Secrets in texts: fixed patterns, and literals assigned to sensitive names."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

KINDS = ("assign", "access", "hex", "literal")
SPANS = "array<struct<kind:string,start:bigint,end:bigint,hide:bigint,score:double>>"
LEAST_SCORE = 0.5

# The base patterns; a match that is too short is dropped after matching.
ASSIGN = re.compile(rb"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32

# How much a part of a name says that its value is secret, and values that stand for none.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api": 0.4, "key": 0.5, "credential": 0.9, "credentials": 0.9,
    "private": 0.6, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "signature": 0.5, "salt": 0.5, "access": 0.4, "client": 0.2, "session": 0.4, "cookie": 0.4, "dsn": 0.6, "connection": 0.4,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(?\w+\)?s?|change_?me|your[-_].*|example.*|placeholder|dummy|none|null|true|false|todo|undefined|string|test)$")

#: name, operator, value: a quoted literal of one line, or a bare one. A bare value ends where the next
#: operator stands, but for `://`, what an address has before its `@`, and padding at its end.
_STOP = rb"""\s"'`,;{}()\[\]<>&"""
PAIR = re.compile(
    rb"""(?<![\w.$-])["']?\$?(?P<name>[A-Za-z_][\w.-]*+)["']?[\x20\t]*+(?::[\x20\t]*+[A-Za-z_][\w\[\]]*+[\x20\t]*+(?==))?(?:=>|:=|==?|:)(?![=:/])[\x20\t]*+"""
    rb"""(?:(?P<prefix>[rRbBuUfF]{0,2})(?:"(?P<double>(?:[^"\\\r\n]|\\.)*+)"|'(?P<single>(?:[^'\\\r\n]|\\.)*+)')|(?P<bare>(?:[^=:""" + _STOP + rb"""]|://(?:[^/@""" + _STOP + rb"""]*+@)?|=++(?![^=""" + _STOP + rb"""]))++))"""
)
#: A further literal joined to one before it.
JOINED = re.compile(rb"""[\x20\t]*+[+.]\s{0,80}+(?:"(?P<double>(?:[^"\\\r\n]|\\.)*+)"|'(?P<single>(?:[^'\\\r\n]|\\.)*+)')""")
NAME = re.compile(rb"\$?([A-Za-z_][\w.-]*)")
_PARTS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")


def name_score(name: str) -> float:
    """How sensitive a name is: its most telling part, raised by the others; compounds count as one word too."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    parts += [a + b for a, b in zip(parts, parts[1:], strict=False)]
    rest = 1.0
    for part in set(parts):
        rest *= 1 - min(SENSITIVE.get(part, 0.0), 0.99)
    return 1 - rest


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: long, of many different characters, and no placeholder or plain word."""
    if len(value) < 6 or PLACEHOLDER.match(value) or " " in value.strip():
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 3.5) * (0.4 + 0.2 * min(kinds, 3)) * min(1.0, len(value) / 8)


def assignments(text: bytes) -> list[tuple[str, bytes, int, int, bool]]:
    """(name, value, start, end, quoted) of the assignments in source or configuration text, in order.

    Literals that `+` or `.` joins are one value, from the first one's start to
    the last one's end. The search goes on where a bare value begins, for it may
    be the next name; as it ends at the next operator, no part of a text is
    read more than a few times.
    """
    out, at = [], 0
    while found := PAIR.search(text, at):
        name, end = found["name"].decode("ascii"), found.end()
        kind = next(k for k in ("double", "single", "bare") if found[k] is not None)
        if kind == "bare":
            out.append((name, found[kind], *found.span(kind), False))
            at = found.start("bare")
        else:
            parts, (start, last) = [found[kind]], found.span(kind)
            while more := JOINED.match(text, end):
                kind = "double" if more["double"] is not None else "single"
                parts.append(more[kind])
                last, end = more.end(kind), more.end()
            out.append((name, b"".join(parts), start, last, True))
            at = end
        at = max(at, found.end("name"))
    return out


def literals(text: bytes) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals whose targets are sensitive.

    A bare value that is the name of a constant stands for its literal: the
    nearest one before it, or else the last one behind it, so a literal is
    scored by every name that it reaches. A `$` before a name is no part of it.
    """
    bound: dict[str, tuple[bytes, int, int]] = {}
    best: dict[tuple[int, int], float] = {}
    later: list[tuple[str, str, tuple]] = []

    def reach(name: str, literal: tuple[bytes, int, int]) -> None:
        sensitive = name_score(name)
        if sensitive >= LEAST_SCORE:
            score = sensitive * literal_score(literal[0].decode("utf-8", "replace"))
            if score >= LEAST_SCORE:
                best[literal[1:]] = max(score, best.get(literal[1:], 0.0))

    references: dict[str, str] = {}
    for name, value, start, end, quoted in assignments(text):
        literal = (value, start, end)
        other = None if quoted else NAME.fullmatch(value)
        if other:
            known = other[1].decode("ascii")
            if known in bound:
                bound[name] = bound[known]
                reach(name, bound[name])
            else:
                references[name] = known
                later.append((name, known, literal))
            continue
        if not quoted and value.endswith((b".", b":")):
            literal = (value[:-1], start, end - 1)
        if quoted or not value.startswith(b"$"):
            bound[name] = literal
            reach(name, literal)
    for name, known, literal in later:
        seen = {name}
        while known not in bound and known in references and known not in seen:
            seen.add(known)
            known = references[known]
        if known in bound:
            reach(name, bound[known])
        elif not literal[0].startswith(b"$"):
            reach(name, literal)
    return [(start, end, score) for (start, end), score in best.items()]


def find(text: bytes, hexes: list[tuple[int, int]] = ()) -> list[tuple[int, int, int, float, int]]:
    """(start, kind, end, score, where the value starts), sorted, in bytes; hexes: the runs of hex digits that are long enough."""
    found = [(a, 2, b, 0.6, a) for a, b in hexes]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end(), 1.0, m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    if b"=" in text or b":" in text:
        found += [(m.start(), 0, m.end(), 1.0, m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
        found += [(a, 3, b, score, a) for a, b, score in literals(text)]
    return sorted(found)


_HEX = np.zeros(256, bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


def _found(column) -> Iterator[tuple[int, bytes, list]]:
    """(row, text, spans) of each row with spans."""
    for first, data, offsets in ta.blocks(column):
        starts, ends, rows = ta.words(data, offsets, _HEX)
        long = ends - starts >= HEX_LENGTH
        starts, ends, rows = starts[long], ends[long], rows[long]
        runs: dict[int, list] = {}
        for a, b, row in zip(starts.tolist(), ends.tolist(), rows.tolist(), strict=True):
            runs.setdefault(row, []).append((a - int(offsets[row]), b - int(offsets[row])))
        text = data.tobytes()
        places = offsets.tolist()
        for i in range(len(places) - 1):
            own = text[places[i] : places[i + 1]]
            if spans := find(own, runs.get(i, [])):
                yield first + i, own, spans


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hide", pa.int64()), ("score", pa.float64())]))
    for batch in batches:
        out: list[list] = [[] for _ in range(batch.num_rows)]
        for row, text, spans in _found(batch.column(1)):
            points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            out[row] = [{"kind": KINDS[k], "start": int(points[a]), "end": int(points[b]), "hide": int(points[v]), "score": score} for a, k, b, score, v in spans]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of secrets: kind, start, end (code points, end exclusive), hide (where the value starts), score.

    Base kinds are matches of fixed patterns. Kind literal comes from a lexer
    for assignments of source and configuration text: names and literals are
    paired, constants are followed to the names they are assigned to, and a
    literal counts if a sensitive name gets it and it is no placeholder.

    Spans are sorted by start, then by kind as listed in KINDS. A null or empty
    text has none. Rows that repeat, or have no doc_id, are scanned each. An
    empty table gives no rows. Other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scan, f"doc_id bigint, spans {SPANS}")


def _hide(mark: bytes, length: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = {}
            for row, text, spans in _found(batch.column(at)):
                parts, done = [], 0
                for start, end in sorted((v, b) for _, _, b, _, v in spans):
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                texts[row] = b"".join([*parts, text[done:]]).decode("utf-8", "replace")
            columns = list(batch.columns)
            if texts:
                columns[at] = pa.array([texts.get(i, x) for i, x in enumerate(columns[at].to_pylist())], batch.schema.field(at).type)
                size = batch.schema.get_field_index(length)
                if size >= 0:
                    columns[size] = pa.array([len(texts[i]) if i in texts else x for i, x in enumerate(columns[size].to_pylist())], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def redact(docs: DataFrame, mark: str = "[SECRET]", length: str = "n_chars") -> DataFrame:
    """All rows and columns, with the values of secrets in `text` replaced by the mark; a null text stays null.

    A column named by `length` gets the new number of characters of changed texts.
    """
    return docs.mapInArrow(_hide(mark.encode(), length), docs.schema)
