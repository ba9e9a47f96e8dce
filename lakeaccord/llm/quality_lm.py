"""Text quality by interpolated modified Kneser-Ney models of trusted text: symbols in an array, words in sharded counts."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaccord.session import bucketed, fresh_path, remove

from . import textarrays as ta
from .components import stored
from .language_model import MOST_TASKS, _planes, _runs, _shuffles_removed, _values

#: n-grams of ORDER symbols of an alphabet of 32: at most 32 ** ORDER rows, which bounds the model whatever the corpus.
ORDER, BITS = 4, 5
#: Trusted texts of a language that lie below its threshold, and how many it needs for a threshold of its own.
QUANTILE, LEAST = 0.995, 50

_START, _DIGIT, _SPACE, _LINE, _POINT, _SYMBOL, _OTHER = 0, 27, 28, 29, 30, 31, 0


def _alphabet() -> np.ndarray:
    """Symbol of each code point below 0x250: letters without accents, digits, space, line, punctuation, symbols."""
    import unicodedata

    table = np.full(0x250, _SYMBOL, np.uint8)
    for cp in range(0x250):
        c = unicodedata.normalize("NFKD", chr(cp))[0].lower()
        if "a" <= c <= "z":
            table[cp] = ord(c) - 96
        elif unicodedata.category(chr(cp)).startswith("L"):
            table[cp] = _OTHER
        elif chr(cp).isdigit():
            table[cp] = _DIGIT
        elif chr(cp) == "\n":
            table[cp] = _LINE
        elif chr(cp).isspace():
            table[cp] = _SPACE
        elif chr(cp) in ".,;:!?'\"()-":
            table[cp] = _POINT
    return table


_TABLE = _alphabet()


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram code that ends at each character, and where each row's codes begin; texts start after ORDER - 1 start symbols."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    first = np.minimum(first, len(points))
    symbols = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], np.where((points >= 0x2000) & (points < 0x2C00), _SYMBOL, _OTHER)).astype(np.int32)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    padded = np.full(len(symbols) + (ORDER - 1) * (len(offsets) - 1), _START, np.int32)
    at = np.arange(len(symbols)) + (ORDER - 1) * (rows + 1)
    padded[at] = symbols
    codes = symbols
    for k in range(1, ORDER):
        codes = codes | padded[at - k] << BITS * k
    return codes, first


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS * ORDER, np.int64)
    for batch in batches:
        for _, data, offsets in ta.blocks(batch.column(0)):
            total += np.bincount(_codes(data, offsets)[0], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["gram", "n"])


def train(spark: SparkSession, trusted: DataFrame) -> list[tuple[int, DataFrame, DataFrame]]:
    """(order, grams with their discounted share, contexts with the weight of the next lower order) from the highest order down.

    The highest order counts occurrences, each lower one the different symbols
    before an n-gram. Discounts are those of modified Kneser-Ney smoothing,
    from how many n-grams occur once to four times. Counts are sharded by
    n-gram and joined with the totals of their contexts.
    """
    counts = stored(spark, trusted.select("text").mapInArrow(_counted, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    levels = []
    for order in range(ORDER, 0, -1):
        n1, n2, n3, n4 = (x or 0 for x in counts.agg(*(F.sum((F.col("n") == k).cast("bigint")) for k in range(1, 5))).first())
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        d1, d2, d3 = (min(max(0.0, k - (k + 1) * y * more / less), k * 0.99) if less else 0.5 for k, more, less in ((1, n2, n1), (2, n3, n2), (3, n4, n3)))
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        contexts = counts.groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum("n").alias("total"), F.sum(discount).alias("saved"))
        grams = counts.withColumn("context", F.shiftright("gram", BITS)).join(contexts, "context").select("gram", ((F.col("n") - discount) / F.col("total")).alias("share"))
        levels.append((order, grams, contexts.select("context", (F.col("saved") / F.col("total")).alias("rest"))))
        counts = counts.groupBy(F.col("gram").bitwiseAND((1 << BITS * (order - 1)) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        if order > 1:
            counts = stored(spark, counts, "grams")
    return levels


def table(levels: list[tuple[int, DataFrame, DataFrame]]) -> np.ndarray:
    """Log probability of every n-gram of the highest order, seen or not: 32 ** ORDER numbers."""
    lower = np.full(1, 1.0 / (1 << BITS))
    for order, grams, contexts in reversed(levels):
        rest = np.ones(1 << BITS * (order - 1))
        found = contexts.toArrow()  # at most 32 ** (order - 1) rows
        rest[found["context"].to_numpy()] = found["rest"].to_numpy()
        share = np.zeros(1 << BITS * order)
        found = grams.toArrow()  # at most 32 ** order rows
        share[found["gram"].to_numpy()] = found["share"].to_numpy()
        suffix = np.arange(len(share)) & ((1 << BITS * (order - 1)) - 1) if order > 1 else np.zeros(len(share), np.int64)
        lower = share + np.repeat(rest, 1 << BITS) * lower[suffix]
    return np.log(np.maximum(lower, 1e-12)).astype(np.float32)


#: Word models: of all trusted texts, of those with an odd and of those with an even key.
VIEWS = 3
WORD_ROWS = "key bigint, w1 bigint, w2 bigint, n bigint"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word: ASCII letters and digits (case folded) and code points below U+0800 in runs, later code points alone."""
    data = ta.LOWER[data]
    starts, ends, _ = ta.words(data, offsets, ta.ALNUM)
    lead = np.flatnonzero(data >= 0xE0)
    behind = lead + 3 + (data[lead] >= 0xF0)
    starts = np.unique(np.concatenate([starts, lead, behind]))
    starts = starts[starts < len(data)]
    starts = starts[ta.ALNUM[data[starts]]]
    ends = np.unique(np.concatenate([ends, lead, behind]))
    ends = ends[np.searchsorted(ends, starts, "right")]
    return ta.word_hashes(data, starts, ends).view(np.int64), np.searchsorted(offsets, starts, "right") - 1


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of neighbouring words of each text with their counts; 0 stands before the first word."""
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for first, data, offsets in ta.blocks(batch.column(1)):
            w2, rows = _words(data, offsets)
            if not len(w2):
                continue
            w1 = np.concatenate([[0], w2[:-1]])
            w1[np.concatenate([[True], rows[1:] != rows[:-1]])] = 0
            order = np.lexsort((w2, w1, rows))
            w1, w2, rows = w1[order], w2[order], rows[order]
            new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]))
            n = np.diff(np.concatenate([new, [len(rows)]]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[first + rows[new]]), pa.array(w1[new]), pa.array(w2[new]), pa.array(n)], names=["key", "w1", "w2", "n"])


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Those of counts of 1, 2, and 3 or more, from how many n-grams occur once to four times."""
    n = [0, n1, n2, n3, n4]
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    return [min(max(0.0, k - (k + 1) * y * n[k + 1] / n[k]), k * 0.99) if n[k] else 0.5 for k in (1, 2, 3)]


def _discounted(counts: DataFrame) -> tuple[Column, dict[int, int]]:
    """The discount of a row of (view, n), and the rows of each view; five numbers a view come to the driver."""
    seen = counts.groupBy("view").agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5))).collect()
    out = F.lit(0.0)
    for r in seen:
        d = _discounts(r["n1"], r["n2"], r["n3"], r["n4"])
        out = F.when(F.col("view") == r["view"], F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])).otherwise(out)
    return out, {r["view"]: r["rows"] for r in seen}


def train_words(spark: SparkSession, own: DataFrame) -> tuple[DataFrame, DataFrame, list[float]]:
    """The word model as tables: (view, w1, w2, share), (view, w, p, rest) and the chance of an unseen word by view, from rows of trusted texts.

    :func:`quality` counts the same in shards and writes no such tables. View 0 counts all trusted texts, views 1 and 2 leave out those with an even
    or odd key. Nothing but a few numbers a view comes to the driver.
    """
    even = F.col("key").bitwiseAND(1) == 0
    halves = own.groupBy("w1", "w2").agg(F.sum("n").alias("n0"), F.sum(F.when(even, 0).otherwise(F.col("n"))).alias("n1"), F.sum(F.when(even, F.col("n")).otherwise(0)).alias("n2"))
    counts = halves.select("w1", "w2", F.posexplode(F.array("n0", "n1", "n2")).alias("view", "n")).where("n > 0")
    counts = stored(spark, counts, "word-pairs")
    discount, _ = _discounted(counts)
    contexts = stored(spark, counts.groupBy("view", "w1").agg(F.sum("n").alias("total"), F.sum(discount).alias("saved")), "word-contexts")
    pairs = counts.join(contexts.hint("merge"), ["view", "w1"]).select("view", "w1", "w2", ((F.col("n") - discount) / F.col("total")).alias("share"))
    single = stored(spark, counts.groupBy("view", F.col("w2").alias("w")).agg(F.count(F.lit(1)).alias("n")), "words")
    discount, kinds = _discounted(single)
    sums = {r["view"]: r for r in single.groupBy("view").agg(F.sum("n").alias("total"), F.sum(discount).alias("saved")).collect()}
    # One unknown word beside the known ones.
    unseen = [sums[v]["saved"] / sums[v]["total"] / (kinds[v] + 1) if v in sums else 1.0 for v in range(VIEWS)]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("view") + 1)
    total = of([sums[v]["total"] if v in sums else 1 for v in range(VIEWS)])
    chances = single.select("view", "w", ((F.col("n") - discount) / total + of(unseen)).alias("p"))
    rests = contexts.select("view", F.col("w1").alias("w"), (F.col("saved") / F.col("total")).alias("rest"))
    return stored(spark, pairs, "word-shares"), stored(spark, chances.join(rests.hint("merge"), ["view", "w"], "full"), "word-chances"), unseen


# --- blocks of texts ask shards for counts --------------------------------------

#: Text bytes of a block, pairs asked for of a shard, and parts of the pairs, then of the blocks, that are worked on one after the other.
BLOCK_BYTES, SHARD_PAIRS, ROUNDS = 14 << 20, 2 << 20, 3

_JOIN = np.uint64(0xA0761D6478BD642F)
BLOCKS = "block bigint, doc_id array<bigint>, lang array<string>, key array<bigint>, n_chars array<bigint>, perplexity array<double>, n_words array<bigint>, known binary, ids binary"
#: To a block: places of trusted texts, counts of pairs, figures of words. Without block: sums of a shard.
MESSAGES = "block bigint, kind int, part int, payload array<binary>, sums array<bigint>"
ASKED = "block bigint, shard int, hashes binary, counts array<binary>"
_TRUSTED, _PAIRS, _WORDS = range(3)
#: Of a word and view: how often it stands before a word, and the pairs it begins that occur once, twice, more often; the pairs it ends.
FIGURES = 5
#: Bytes of an Arrow batch between Spark and a Python worker, where the session allows more.
BATCH_BYTES = 4 << 20


def _packed(values: np.ndarray) -> bytes:
    planes = _planes(values)
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _unpacked(packed: bytes, kind) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    return _values(pa.decompress(packed[8:], size, "zstd", asbytes=True), kind) if size else np.zeros(0, kind)


def _packed_counts(counts: np.ndarray) -> list[bytes]:
    """Two rows of counts and one of flags: a byte for each pair, and the counts of 7 and more in full."""
    odd, even, flag = counts
    large = (odd > 6) | (even > 6)
    small = np.minimum(odd, 7) | np.minimum(even, 7) << np.uint64(3) | flag << np.uint64(6)
    return [_packed(small.astype(np.uint8)), _packed(counts[:2, large].ravel())]


def _unpacked_counts(packed: list[bytes]) -> np.ndarray:
    small = _unpacked(packed[0], np.uint8).astype(np.uint64)
    counts = np.stack([small & np.uint64(7), small >> np.uint64(3) & np.uint64(7), small >> np.uint64(6)])
    counts[:2, (counts[:2] == 7).any(axis=0)] = _unpacked(packed[1], np.uint64).reshape(2, -1)
    return counts


def _packed_figures(figures: np.ndarray) -> list[bytes]:
    """The figures of words, word by word, as what they differ by from those that rare words have: small numbers, mostly 0."""
    left = figures.view(np.int64).reshape(VIEWS, FIGURES, -1).copy()
    left[0] = left[1] + left[2] - left[0]
    left[1:, 0] -= left[1:, 1] + 2 * left[1:, 2] + 3 * left[1:, 3]
    return [_packed((left << 1 ^ left >> 63).reshape(VIEWS * FIGURES, -1).T.ravel())]


def _unpacked_figures(packed: list[bytes]) -> np.ndarray:
    left = _unpacked(packed[0], np.int64).reshape(-1, VIEWS * FIGURES).T.copy().reshape(VIEWS, FIGURES, -1)
    left = (left >> 1) ^ -(left & 1)
    left[1:, 0] += left[1:, 1] + 2 * left[1:, 2] + 3 * left[1:, 3]
    left[0] = left[1] + left[2] - left[0]
    return left.reshape(VIEWS * FIGURES, -1).view(np.uint64)


def _asked_rows(block: int, hashes: np.ndarray, counts: np.ndarray, shards: int, packed: Callable) -> pa.Table:
    """A row per shard: its part of sorted hashes as differences, and their counts."""
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    found, edges = np.unique(shard, return_index=True)
    edges = np.append(edges, len(hashes)).tolist()
    parts = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.table({
        "block": pa.array([block] * len(parts), pa.int64()), "shard": pa.array(found, pa.int32()),
        "hashes": pa.array([_packed(np.diff(hashes[a:b], prepend=np.uint64(0))) for a, b in parts], pa.binary()),
        "counts": pa.array([packed(counts[:, a:b]) for a, b in parts], pa.list_(pa.binary())),
    })


def _block(number: int, held: list) -> pa.RecordBatch:
    """Texts as one row: words by numbers, the frequent ones first, and what is known of each text without the word model."""
    lists = [[x for part in held for x in part[k]] for k in range(3)]
    n_chars, perplexity, n_words, words = (np.concatenate([part[k] for part in held]) for k in range(3, 7))
    known, ids, n = np.unique(words, return_inverse=True, return_counts=True)
    order = np.lexsort((known, -n))
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return pa.RecordBatch.from_arrays([
        pa.array([number]), pa.array([lists[0]], pa.list_(pa.int64())), pa.array([lists[1]], pa.list_(pa.string())), pa.array([lists[2]], pa.list_(pa.int64())), pa.array([n_chars]),
        pa.ListArray.from_arrays(pa.array([0, len(n_chars)], pa.int32()), pa.array(perplexity, mask=n_chars == 0)), pa.array([n_words]),
        pa.array([_packed(np.diff(known[order], prepend=np.uint64(0)))]), pa.array([_packed(place[ids])]),
    ], names=["block", "doc_id", "lang", "key", "n_chars", "perplexity", "n_words", "known", "ids"])


def _blocks(model, limit: int) -> Callable:
    """Rows of texts to blocks of about `limit` bytes; perplexities by symbols come with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, number = model.value, TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for first, data, offsets in ta.blocks(batch.column(3)):
                codes, begins = _codes(data, offsets)
                total = np.concatenate([[0.0], np.cumsum(logs[codes], dtype=np.float64)])
                n_chars = np.diff(begins)
                words, rows = _words(data, offsets)
                lists = [batch.column(k).slice(first, len(n_chars)).to_pylist() for k in range(3)]
                held.append((*lists, n_chars, np.exp(-(total[begins[1:]] - total[begins[:-1]]) / np.maximum(n_chars, 1)), np.bincount(rows, minlength=len(n_chars)), words.view(np.uint64)))
                size += len(data)
                if size >= limit:
                    yield _block(number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield _block(number, held)

    return run


class _Pairs:
    """The words of a block again: for each its text, its number, the one before it, and the hash of both; number `size` stands before a text."""

    def __init__(self, block: pa.Table):
        self.block = block.column("block")[0].as_py()
        self.n_words, self.key = (block.column(c).combine_chunks().flatten().to_numpy() for c in ("n_words", "key"))
        words = np.cumsum(_unpacked(block.column("known")[0].as_py(), np.uint64), dtype=np.uint64)
        self.hashes, self.size = np.append(words, np.uint64(0)), len(words)
        self.word = _unpacked(block.column("ids")[0].as_py(), np.uint32).view(np.int32)
        self.row = np.repeat(np.arange(len(self.n_words), dtype=np.int32), self.n_words)
        self.before = np.full(len(self.word), self.size, np.int32)
        self.before[1:] = self.word[:-1]
        self.before[(np.cumsum(self.n_words) - self.n_words)[self.n_words > 0]] = self.size
        self.pair = ta.mix(self.hashes[self.before] * _JOIN ^ self.hashes[self.word])


def _answers(messages: pa.Table, kind: int, unpacked: Callable, columns: int) -> np.ndarray:
    """What shards answered a block, in the order of its hashes."""
    kinds, parts = messages.column("kind").to_numpy(), messages.column("part").to_numpy()
    payload = messages.column("payload")
    own = np.flatnonzero(kinds == kind)
    found = [unpacked(payload[int(i)].as_py()) for i in own[np.argsort(parts[own])]]
    return np.concatenate(found, axis=1) if found else np.zeros((columns, 0), np.uint64)


def _pairs_asked(shards: int, first: int, last: int) -> Callable:
    """A block's distinct pairs of some shards, and how often its trusted texts of odd and of even key hold each."""

    def run(block: pa.Table, messages: pa.Table) -> pa.Table:
        words = _Pairs(block)
        shard = ((words.pair >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        here = np.flatnonzero((shard >= first) & (shard < last))
        distinct, at = np.unique(words.pair[here], return_inverse=True)
        trusted = np.zeros(len(words.n_words), bool)
        trusted[messages.column("part").to_numpy()] = True
        odd = words.key & 1 == 1
        counts = [np.bincount(at[of[words.row[here]]], minlength=len(distinct)) for of in (trusted & odd, trusted & ~odd)]
        return _asked_rows(words.block, distinct, np.stack([*counts, np.zeros_like(counts[0])]).astype(np.uint64), shards, _packed_counts)

    return run


def _answered(kind: int, table: pa.Table, parts: list[np.ndarray], answers: np.ndarray, packed: Callable, sums: list[int]) -> pa.RecordBatch:
    """A row to each block that asked, and one without block that has the sums of the shard."""
    edges = np.cumsum([0, *map(len, parts)]).tolist()
    n, shard = len(parts), table.column("shard")[0].as_py()
    payload = [packed(answers[:, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    columns = [[*table.column("block").to_pylist(), None], [kind] * (n + 1), [shard] * (n + 1), [*payload, None], [None] * n + [sums]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _schema(MESSAGES), strict=True)], schema=_schema(MESSAGES))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "array<binary>": pa.list_(pa.binary()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _gathered(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of each block that asked, all distinct ones, and for each asked one its place there and where it stands first."""
    parts = [np.cumsum(_unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("hashes")]
    return parts, *np.unique(np.concatenate(parts), return_inverse=True)


def _once_to_four(n: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(n == k)) for k in range(1, 5)]


def _pairs_answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each block that asked, the counts of its pairs in trusted texts of odd and even key, and whether it is the one to report them."""
    for table in _runs(batches, ["shard"]):
        parts, distinct, at = _gathered(table)
        asked = np.concatenate([_unpacked_counts(x.as_py()) for x in table.column("counts")], axis=1)[:2]
        n = np.stack([np.bincount(at, c, len(distinct)).astype(np.uint64) for c in asked])
        seen = np.flatnonzero(asked.any(axis=0))
        reports = np.zeros(len(at), np.uint64)
        reports[seen[np.unique(at[seen], return_index=True)[1]]] = 1
        sums = [x for view in (n[0] + n[1], n[0], n[1]) for x in _once_to_four(view)]
        yield _answered(_PAIRS, table, parts, np.concatenate([n[:, at], reports[None]]), _packed_counts, sums)


def _by_view(odd: np.ndarray, even: np.ndarray) -> tuple[np.ndarray, ...]:
    return odd + even, odd, even


def _words_asked(shards: int) -> Callable:
    """A block's words, and the figures of those pairs that it reports."""

    def run(block: pa.Table, messages: pa.Table) -> pa.Table:
        words = _Pairs(block)
        odd, even, reports = _answers(messages, _PAIRS, _unpacked_counts, 3)
        example = np.unique(words.pair, return_index=True)[1][reports > 0]
        first, second = words.before[example], words.word[example]
        figures = []
        for n in _by_view(odd[reports > 0], even[reports > 0]):
            figures.append(np.bincount(first, n, words.size + 1))
            figures += [np.bincount(first[of], minlength=words.size + 1) for of in (n == 1, n == 2, n > 2)]
            figures.append(np.bincount(second[n > 0], minlength=words.size + 1))
        order = np.argsort(words.hashes)
        return _asked_rows(words.block, words.hashes[order], np.stack(figures).astype(np.uint64)[:, order], shards, _packed_figures)

    return run


def _words_answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each block that asked, the figures of its words; the sums are of the pairs that words end."""
    for table in _runs(batches, ["shard"]):
        parts, distinct, at = _gathered(table)
        asked = np.concatenate([_unpacked_figures(x.as_py()) for x in table.column("counts")], axis=1)
        total = np.stack([np.bincount(at, c, len(distinct)).astype(np.uint64) for c in asked])
        ends = total[FIGURES - 1 :: FIGURES]
        sums = [x for n in ends for x in (*_once_to_four(n), int(n.sum()), int(np.count_nonzero(n)))]
        yield _answered(_WORDS, table, parts, total[:, at], _packed_figures, sums)


def _sums(answers: DataFrame, kind: int, size: int) -> list[list[int]]:
    """The sums of all shards, a list per view."""
    row = answers.where(f"block is null and kind = {kind}").agg(*(F.sum(F.col("sums")[k]) for k in range(VIEWS * size))).first()
    return [[x or 0 for x in row[v * size : (v + 1) * size]] for v in range(VIEWS)]


def _less(n: np.ndarray, discounts: list[float]) -> np.ndarray:
    return np.where(n > 0, n - np.array([0.0, *discounts])[np.minimum(n, 3).astype(np.int64)], 0.0)


SCORED = "doc_id bigint, lang string, n_chars bigint, perplexity double, n_words bigint, word_perplexity double, apart_perplexity double"


def _scored(of_pairs: list[list[int]], of_words: list[list[int]]) -> Callable:
    """The texts of a block with their perplexities: the counts of its pairs meet the figures of their words."""

    def run(block: pa.Table, messages: pa.Table) -> pa.Table:
        words = _Pairs(block)
        odd, even, _ = _answers(messages, _PAIRS, _unpacked_counts, 3)
        order = np.argsort(words.hashes)
        figures = np.empty((VIEWS * FIGURES, words.size + 1), np.uint64)
        figures[:, order] = _answers(messages, _WORDS, _unpacked_figures, VIEWS * FIGURES)
        _, example, at = np.unique(words.pair, return_index=True, return_inverse=True)
        first, second, total = words.before[example], words.word[example], []
        for v, n in enumerate(_by_view(odd, even)):
            d2, (*seen, ends, kinds) = _discounts(*of_pairs[v]), of_words[v]
            d1 = _discounts(*seen)
            before, one, two, more, after = figures[v * FIGURES : (v + 1) * FIGURES].astype(float)
            known = np.maximum(before, 1)
            rest = np.where(before > 0, (d2[0] * one + d2[1] * two + d2[2] * more) / known, 1.0)
            # One unknown word beside the known ones.
            unseen = sum(d * k for d, k in zip(d1, (seen[0], seen[1], kinds - seen[0] - seen[1]), strict=True)) / ends / (kinds + 1) if ends else 1.0
            log = np.log(_less(n, d2) / known[first] + rest[first] * (_less(after, d1) / max(ends, 1) + unseen)[second])
            total.append(np.bincount(words.row, log[at], len(words.n_words)))
        some = words.n_words == 0
        perplexity = lambda x: pa.array(np.exp(-x / np.maximum(words.n_words, 1)), mask=some)
        kept = [block.column(c).combine_chunks().flatten() for c in ("doc_id", "lang", "n_chars", "perplexity", "n_words")]
        return pa.table([*kept, perplexity(total[0]), perplexity(np.where(words.key & 1 == 0, total[1], total[2]))], names=[x.split()[0] for x in SCORED.split(", ")])

    return run


@contextmanager
def _small_batches(spark: SparkSession):
    """Within it, a Python worker holds a few batches of BATCH_BYTES."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    spark.conf.set(name, str(min(before, BATCH_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def _perplexities(spark: SparkSession, docs: DataFrame, good: DataFrame, model, block_bytes: int, shard_pairs: int, rounds: int) -> DataFrame:
    """The rows of `docs` with their perplexities by symbols and by words, written once; what leads there is removed.

    Texts become blocks of word numbers where they are read, and stay there.
    A block asks shards for its distinct pairs, part by part, and gives what its
    own trusted texts count; then for the figures of its words, and gives those
    of the pairs it is the one to report. Answers come in the order asked.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    rounds = min(rounds, max(1, -(-size // block_bytes)))
    shards = max(rounds, -(-size // (6 * shard_pairs)))  # a word and its blank are about six bytes
    buckets = min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * math.ceil(size / block_bytes)))
    tasks = lambda n: min(n, MOST_TASKS)
    by_shard = lambda asked, n: asked.repartitionById(tasks(n), F.col("shard") % tasks(n)).sortWithinPartitions("shard")
    made = []

    def keep(frame, name):
        made.append(fresh_path(spark, name))
        frame.write.parquet(made[-1])
        return spark.read.schema(frame.schema).parquet(made[-1])

    with bucketed(spark, docs.select("doc_id", "lang", "key", "text").mapInArrow(_blocks(model, block_bytes), BLOCKS), "block", buckets, "word-blocks") as blocks:
        met = lambda messages, run, out, blocks=blocks: blocks.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(run, out)
        none = lambda kind: F.lit(None).cast(kind)
        places = blocks.select("block", F.posexplode("doc_id").alias("part", "doc_id")).join(good.hint("merge"), "doc_id", "left_semi")
        trusted = keep(places.select("block", F.lit(_TRUSTED).alias("kind"), "part", none("array<binary>").alias("payload"), none("array<bigint>").alias("sums")), "trusted")
        pairs = None
        for k in range(rounds):
            first, last = shards * k // rounds, shards * (k + 1) // rounds
            asked = by_shard(met(trusted, _pairs_asked(shards, first, last), ASKED), last - first)
            answers = keep(asked.mapInArrow(_pairs_answered, MESSAGES), "pair-counts")
            pairs = answers if pairs is None else pairs.union(answers)
        of_pairs = _sums(pairs, _PAIRS, 4)
        pairs = pairs.where("block is not null")
        asked = by_shard(met(pairs, _words_asked(shards), ASKED), shards)
        words = keep(asked.mapInArrow(_words_answered, MESSAGES), "word-figures")
        of_words = _sums(words, _WORDS, 6)
        answers = pairs.union(words.where("block is not null"))
        part = F.pmod(F.xxhash64("block"), F.lit(rounds))
        out = [stored(spark, met(answers.where(part == k), _scored(of_pairs, of_words), SCORED, blocks.where(part == k)), "perplexities") for k in range(rounds)]
    for path in made:
        remove(spark, path)
    return functools.reduce(DataFrame.union, out)


def _limits(trusted: DataFrame, quantile: float, name: str) -> tuple[DataFrame, Column]:
    """(of, name) of the languages with enough trusted texts, and the quantile of all."""
    limits = trusted.groupBy("lang").agg(F.percentile_approx("p", quantile, 10000).alias(name), F.count("p").alias("n"))
    general = trusted.agg(F.percentile_approx("p", quantile, 10000)).first()[0]
    return limits.where(F.col("n") >= LEAST).select(F.col("lang").alias("of"), name), F.lit(float("inf") if general is None else general)


def quality(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, block_bytes: int = BLOCK_BYTES, shard_pairs: int = SHARD_PAIRS, rounds: int = ROUNDS
) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, n_words, word_perplexity, apart_perplexity, word_threshold, kept.

    Two models are trained on all texts that `labels` calls good (quality 1):
    one of symbols, of bounded size, and one of neighbouring words in whole code
    points. That one is never whole in one place: texts stand as blocks of word
    numbers, about `block_bytes` of text each, and ask shards of about
    `shard_pairs` pairs for the counts that they need; that goes in `rounds` parts
    one after the other (as many as blocks, if these are fewer), which bounds
    what is on disk at a time.

    A document is kept if its perplexity per character and that per word are
    each at most the given quantile of the trusted texts of its language; a
    language with few of them uses the quantile of all. A text of n characters or words may be above by the share 2 / sqrt(n) for its
    spread. `word_perplexity` is that of the whole model. A trusted text would
    know its own words there, so the decision compares `apart_perplexity`, of
    trusted and other texts alike: by the trusted texts in the half, by parity
    of the text's hash, that the text does not belong to.

    A null or empty text has a null perplexity and is not kept; one without
    words is judged by its symbols. A null language is one of its own. Labels
    that contradict each other do not make a text trusted. Without trusted texts
    everything with text is kept. Repeated rows, and rows without doc_id, are
    scored each. Texts and words are known by 64-bit hashes. A block holds at
    least one text, so memory follows the longest one. An empty table
    gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("key"), "text")
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    with _shuffles_removed(spark), _small_batches(spark):
        # Trusted ids grow with the corpus and are no broadcast side, so the plan is the same at every size.
        texts = docs.join(good.hint("merge"), "doc_id", "left_semi")
        model = spark.sparkContext.broadcast(table(train(spark, texts)))
        scored = _perplexities(spark, docs, good, model, block_bytes, shard_pairs, rounds)
    share = lambda c, n: F.col(c) / (1 + F.try_divide(F.lit(2.0), F.sqrt(n)))
    by_symbol, by_word = F.when(F.col("n_chars") > 0, share("perplexity", "n_chars")), share("apart_perplexity", "n_words")
    trusted = scored.join(good.hint("merge"), "doc_id", "left_semi")
    limits, general = _limits(trusted.where("perplexity is not null").select("lang", by_symbol.alias("p")), quantile, "limit")
    word_limits, word_general = _limits(trusted.where("n_words > 0").select("lang", F.col("apart_perplexity").alias("p")), quantile, "word_limit")
    same = lambda: F.col("lang").eqNullSafe(F.col("of"))
    joined = scored.join(limits, same(), "left").drop("of").join(word_limits, same(), "left")
    joined = joined.withColumn("threshold", F.coalesce("limit", general)).withColumn("word_threshold", F.coalesce("word_limit", word_general))
    kept = F.coalesce(by_symbol <= F.col("threshold"), F.lit(False)) & F.coalesce(by_word <= F.col("word_threshold"), F.lit(True))
    return joined.select("doc_id", "lang", "n_chars", "perplexity", "threshold", "n_words", "word_perplexity", "apart_perplexity", "word_threshold", kept.alias("kept"))
