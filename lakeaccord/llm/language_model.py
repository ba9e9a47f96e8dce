"""Log probabilities of texts by a weighted backoff automaton over smoothed n-grams."""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .components import stored

#: Words of an n-gram, and the weight of the shorter context against the counts of the longer one.
ORDER, STRENGTH = 2, 200.0
#: Held out: texts whose crc32 of the id as text leaves HELD_OUT modulo FOLDS.
FOLDS, HELD_OUT = 7, 2
#: Text bytes of a block of documents, n-grams asked for of a shard, and tasks of a stage at most.
BLOCK_BYTES, SHARD_GRAMS, MOST_TASKS = 4 << 20, 2 << 20, 20_000

_END_HASH = np.uint64(0x5851F42D4C957F2D)
_JOIN = np.uint64(0xA0761D6478BD642F)


def held_out(column: str = "doc_id") -> Column:
    """Whether a document is held out; one without id is not."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


# --- n-grams of a block of texts ------------------------------------------------


class _Level:
    """The distinct n-grams of one length: parent (the n-gram without its last word), last word, hash, and where they stand."""

    def __init__(self, parent, word, hashes, at, example):
        self.parent, self.word, self.hashes, self.at, self.example = parent, word, hashes, at, example
        self.by_hash = np.argsort(hashes, kind="stable")


class Grams:
    """Words and n-grams of some texts. Each text ends in the end mark, which also stands before its first word."""

    def __init__(self, texts, order: int = ORDER):
        texts = ta.strings(texts)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        pieces, offsets = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        filled = np.asarray(pc.greater(pc.binary_length(pieces), 0))
        n_words = np.diff(np.concatenate([[0], np.cumsum(filled)])[offsets])
        coded = pieces.filter(pa.array(filled)).dictionary_encode()
        known = coded.dictionary
        self.end = len(known)
        self.words = self.end + 1
        self.sizes = n_words + 1
        self.begins = np.cumsum(self.sizes) - self.sizes
        total = int(self.sizes.sum())
        is_word = np.ones(total, bool)
        is_word[self.begins + n_words] = False
        self.ids = np.full(total, self.end, np.int64)
        self.ids[is_word] = np.asarray(coded.indices)
        _, places, content = known.buffers()
        where = np.frombuffer(places, np.int64)[known.offset : known.offset + len(known) + 1] if len(known) else np.zeros(1, np.int64)
        data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
        hashes = np.append(ta.word_hashes(data, where[:-1], where[1:]), _END_HASH)
        example = np.zeros(self.words, np.int64)
        example[self.ids] = np.arange(total)
        self.levels = [_Level(None, np.arange(self.words), hashes, self.ids, example)]
        for _ in range(1, order):
            low = self.levels[-1]
            before = np.empty(total, np.int64)
            before[1:] = low.at[:-1]
            before[self.begins] = self.end if len(self.levels) == 1 else -1
            valid = np.flatnonzero(before >= 0)
            codes, example, inverse = np.unique(before[valid] * self.words + self.ids[valid], return_index=True, return_inverse=True)
            parent, word = np.divmod(codes, self.words)
            at = np.full(total, -1, np.int64)
            at[valid] = inverse
            self.levels.append(_Level(parent, word, ta.mix(low.hashes[parent] * _JOIN ^ hashes[word]), at, valid[example]))

    def counts(self, level: int, rows: np.ndarray) -> np.ndarray:
        """How often each n-gram of a level stands in the chosen texts."""
        at = self.levels[level].at[np.repeat(rows, self.sizes)]
        return np.bincount(at[at >= 0], minlength=len(self.levels[level].hashes))


# --- the automaton --------------------------------------------------------------


class Automaton:
    """States are contexts that the training texts hold, arcs their next words, weights log10.

    State 0 is the empty context. A context of m words has arcs for the words
    seen behind it and one failure arc to the context without its first word;
    that arc costs the weight which smoothing leaves to shorter contexts. State
    0 has an arc for every word, an unknown one leads back to it.

    Smoothing is hierarchical: p(w | h) = (c(hw) + s p(w | h')) / (c(h) + s),
    h' being h without its first word, and p(w) = (c(w) + 1) / (N + V + 1).
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], n: int, v: int, strength: float = STRENGTH):
        order, words = len(grams.levels), grams.words
        first = np.concatenate([[1], 1 + np.cumsum([len(x.hashes) for x in grams.levels])])  # state of a level's first n-gram
        self.words, self.start = words, int(first[0] + grams.end) if order > 1 and totals[0][grams.end] else 0
        self.fail, self.back = np.zeros(first[-1], np.int64), np.zeros(first[-1])
        keys, weights, targets = [], [], []
        chance = (totals[0] + 1) / (n + v + 1)
        for k, (level, count) in enumerate(zip(grams.levels, totals, strict=True)):
            shorter = grams.levels[k - 1].at[level.example] if k else None
            if k:
                chance = (count + strength * chance[shorter]) / (totals[k - 1][level.parent] + strength)
                source = first[k - 1] + level.parent
                seen = np.flatnonzero(count)
            else:
                source, seen = np.zeros(words, np.int64), np.arange(words)
            into = first[k] + np.arange(len(count)) if k < order - 1 else first[k - 1] + shorter if k else np.zeros(words, np.int64)
            into = np.where(count > 0, into, 0)
            keys.append((source * words + level.word)[seen])
            weights.append(np.log10(chance)[seen])
            targets.append(into[seen])
            if k < order - 1:
                states = slice(first[k], first[k + 1])
                self.fail[states] = first[k - 1] + shorter if k else 0
                self.back[states] = np.log10(strength / (count + strength))
        # Plain arrays of eight bytes an arc: a list would hold an object for each.
        self.weights, self.targets = array("d", np.concatenate(weights).tobytes()), array("q", np.concatenate(targets).tobytes())
        self.arcs = dict(zip(array("q", np.concatenate(keys).tobytes()), range(len(self.weights)), strict=True))
        self.fail, self.back = array("q", self.fail.tobytes()), array("d", self.back.tobytes())

    def score(self, ids: list[int]) -> float:
        """The log10 probability of the words: one walk from left to right that carries the state."""
        arcs, weights, targets, fail, back, words = self.arcs, self.weights, self.targets, self.fail, self.back, self.words
        state, total = self.start, 0.0
        for w in ids:
            arc = arcs.get(state * words + w)
            while arc is None:
                total += back[state]
                state = fail[state]
                arc = arcs.get(state * words + w)
            total += weights[arc]
            state = targets[arc]
        return total


# --- blocks ask shards for totals, texts walk their block's part of the automaton ---


def _planes(values: np.ndarray) -> bytes:
    """Fixed-width integers byte plane by byte plane, so that planes of zeros cost nothing in a shuffle."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(planes: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(planes, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal values, which may span batches."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
        edges = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [batch.num_rows]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if held and tuple(keys[:, a]) != key:
                yield pa.Table.from_batches(held)
                held = []
            key = tuple(keys[:, a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _asked(shards: int, order: int) -> Callable:
    """A block's distinct n-grams as sorted differences of their hashes, with their counts in training texts, cut by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["block"]):
            block = table.column("block")[0].as_py()
            grams = Grams(table.column("text"), order)
            train = ~np.asarray(table.column("held_out").combine_chunks())
            out = []
            for k, level in enumerate(grams.levels):
                hashes, counts = level.hashes[level.by_hash], grams.counts(k, train)[level.by_hash].astype(np.uint32)
                shard = ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
                edges = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
                for s in np.flatnonzero(np.diff(edges)).tolist():
                    a, b = edges[s], edges[s + 1]
                    out.append((block, s, k, _planes(np.diff(hashes[a:b], prepend=np.uint64(0))), _planes(counts[a:b])))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "shard", "level", "grams", "counts"])

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The totals of a shard's n-grams for each block that asked, in the order asked; a row without block has their sum and number."""
    for table in _runs(batches, ["shard", "level"]):
        shard, level = table.column("shard")[0].as_py(), table.column("level")[0].as_py()
        parts = [np.cumsum(_values(g, np.uint64)) for g in table.column("grams").to_pylist()]
        counts = np.concatenate([_values(c, np.uint32) for c in table.column("counts").to_pylist()])
        distinct, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, inverse, counts.astype(np.int64))
        asked = total[inverse]
        edges = np.cumsum([0, *map(len, parts)])
        blocks = [*table.column("block").to_pylist(), None]
        planes = [*(_planes(asked[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)), None]
        n, known = int(total.sum()), int(np.count_nonzero(total))
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int64()), pa.array([shard] * len(blocks), pa.int32()), pa.array([level] * len(blocks), pa.int32()), pa.array(planes, pa.binary()),
             pa.array([None] * (len(blocks) - 1) + [n], pa.int64()), pa.array([None] * (len(blocks) - 1) + [known], pa.int64())],
            names=["block", "shard", "level", "totals", "n", "known"],
        )


SCORES = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scored(n: int, v: int, order: int, strength: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["block"]):
            is_text = table.column("is_text").combine_chunks()
            answers, texts = table.filter(pc.invert(is_text)), table.filter(is_text)
            grams = Grams(texts.column("text"), order)
            levels, planes = answers.column("level").to_pylist(), answers.column("totals").to_pylist()
            totals = []
            for k, level in enumerate(grams.levels):
                found = [_values(p, np.int64) for p, of in zip(planes, levels, strict=True) if of == k]
                total = np.zeros(len(level.hashes), np.int64)
                total[level.by_hash] = np.concatenate(found) if found else []
                totals.append(total)
            automaton = Automaton(grams, totals, n, v, strength)
            known, base = totals[0][grams.ids] > 0, np.log10((totals[0] + 1) / (n + v + 1))[grams.ids]
            scores = [automaton.score(grams.ids[a : a + size].tolist()) for a, size in zip(grams.begins.tolist(), grams.sizes.tolist(), strict=True)]
            columns = [texts.column("doc_id").combine_chunks(), texts.column("held_out").combine_chunks(), pa.array(grams.sizes), pa.array(np.add.reduceat(known.astype(np.int64), grams.begins)),
                       pa.array(np.full(len(scores), n, np.int64)), pa.array(np.add.reduceat(base, grams.begins)), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Within it, a query's shuffle files go when the query ends: what it wrote stands on its own."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score(spark: SparkSession, docs: DataFrame, order: int = ORDER, strength: float = STRENGTH, block_bytes: int = BLOCK_BYTES, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: the log10 probability of every text.

    The model counts the n-grams of all texts that are not held out. Documents
    are dealt into blocks of about `block_bytes` by a hash of id and text; a
    block asks for each of its distinct n-grams once and gives what its own
    training texts count. Asked n-grams are dealt by hash to shards, which add
    up; the totals go back to the blocks. There they make the part of the
    automaton that the block's texts can reach, and each text walks it once
    from left to right. No table of words or n-grams is broadcast, pruned or
    brought to the driver, which sees N and V; blocks and shards grow in number
    with the input, not in size. Words are known by 64-bit hashes.

    A null text is empty: it has its end mark only, which counts as a token.
    A-Z become a-z; words are runs of other signs than ASCII white space. Rows
    with equal ids or texts count and are scored each; a row without doc_id
    trains. Without training texts every token has probability 1. A block holds
    at least one text, so memory follows the longest one. Other columns are not
    read; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    shards = max(1, -(-size * order // (6 * shard_grams)))  # a word and its blank are about six bytes
    tasks = lambda n: min(n, MOST_TASKS)
    texts = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    dealt = texts.repartitionById(tasks(blocks), (F.col("block") % tasks(blocks)).cast("int")).sortWithinPartitions("block")
    asked = dealt.mapInArrow(_asked(shards, order), "block bigint, shard int, level int, grams binary, counts binary")
    asked = asked.repartitionById(tasks(shards), F.col("shard") % tasks(shards)).sortWithinPartitions("shard", "level")
    with _shuffles_removed(spark):
        answers = stored(spark, asked.mapInArrow(_answered, "block bigint, shard int, level int, totals binary, n bigint, known bigint"), "totals")
    n, v = (x or 0 for x in answers.where("block is null and level = 0").agg(F.sum("n"), F.sum("known")).first())
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = answers.where("block is not null").select("block", F.lit(False).alias("is_text"), "level", "shard", "totals", none(kind, "doc_id"), none("boolean", "held_out"), none("string", "text"))
    rows = rows.union(texts.select("block", F.lit(True), none("int", "level"), none("int", "shard"), none("binary", "totals"), "doc_id", "held_out", "text"))
    rows = rows.repartitionById(tasks(blocks), (F.col("block") % tasks(blocks)).cast("int")).sortWithinPartitions("block", "is_text", "level", "shard")
    return rows.mapInArrow(_scored(n, v, order, strength), f"doc_id {kind}, {SCORES}")


def bits_per_token(scored: DataFrame) -> DataFrame:
    """held_out, n_tokens, bits, base_bits: the mean cost of a token in the texts that trained and in the others."""
    bits = lambda c: -F.sum(c) * math.log2(10) / F.sum("n_tokens")
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), bits("score").alias("bits"), bits("base_score").alias("base_bits"))
