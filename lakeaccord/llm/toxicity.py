"""Toxic texts by a weighted finite-state grammar over clauses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

#: Bound on the labelled rows that weights are learned from; they are drawn by a hash of doc_id.
FIT_ROWS = 24_000
HELD_OUT, FOLDS = 2, 4
#: Bytes of word beginnings that are arcs of the insult transducer, besides whole words.
BEGINNINGS = range(4, 9)
#: A learned arc needs so many toxic documents, and so much evidence (documents times log odds).
SUPPORT, EVIDENCE = 8, 30.0
#: Words that a transducer sees before and after a hit, in its clause.
REACH = 8
THRESHOLD = 0.3

# Plain word lists of the grammar, in English, German, French and Spanish.
INSULT = "idiot moron stupid worthless trash disgusting loser clown scum pathetic dumb fool imbecile jerk dummkopf abschaum versager idiota imbécil estúpido estúpida basura idiote imbécile stupide ordure"
THREAT = "kill hurt destroy beat shoot stab burn crush töten umbringen schlagen tuer frapper détruire matar golpear destruir"
TARGET = "you your yours u they them he she him her du dich dir ihr euch sie tu te toi vous ils usted ustedes tú ti ellos"
NEGATION = "not no never nobody isn't aren't don't cannot without nicht kein keine nie niemals pas jamais aucun sin nunca ningún"
REPORT = "said says saying called calls quoted wrote claimed told alleged sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió"
FUTURE = "will shall gonna going must should werde wird werden vais va allons voy vamos"

CLASS = {w: k for k, words in (("target", TARGET), ("negation", NEGATION), ("report", REPORT), ("future", FUTURE), ("threat", THREAT)) for w in words.split()}
SEED_WEIGHT, THREAT_WEIGHT = 2.0, 1.0
CLAUSE_END = np.zeros(256, bool)
CLAUSE_END[[ord(c) for c in ".!?;:\n|"]] = True
DEFAULT = (-3.5, 2.5)
FLAGS = 1 << 18

_POWERS = np.cumprod(np.full(max(BEGINNINGS) + 1, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the accented capitals of Latin-1."""
    data = ta.LOWER[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][capital] += 0x20
    return data


def _arcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, arc keys): beginnings from short to long, then whole words."""
    lengths = ends - starts
    total = np.zeros(len(starts), np.uint64)
    for j in range(max(BEGINNINGS)):
        if j in BEGINNINGS:
            at = np.flatnonzero(lengths >= j)
            yield at, ta.mix(total[at] ^ np.uint64(j))
        at = lengths > j
        total[at] += ta._BYTE_VALUES[data[starts[at] + j]] * _POWERS[j]
    at = np.flatnonzero(lengths >= max(BEGINNINGS))
    yield at, ta.mix(total[at] ^ np.uint64(max(BEGINNINGS)))
    yield np.arange(len(starts)), ta.word_hashes(data, starts, ends) ^ np.uint64(1)


def _words(column):
    for first, data, offsets in ta.blocks(column):
        data = _folded(data)
        yield first, data, offsets, *ta.words(data, offsets, ta.ALNUM)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four minwise hashes of each text's word triples: near copies mostly share them."""
    for batch in batches:
        for first, data, offsets, starts, ends, rows in _words(batch.column(1)):
            n = len(offsets) - 1
            triples, at = ta.window_hashes(ta.word_hashes(data, starts, ends), rows, 3)
            out = ta.mix(np.arange(4 * n, dtype=np.uint64) + triples.sum(dtype=np.uint64)).reshape(4, n)
            full, begins = np.unique(rows[at], return_index=True)
            for k in range(4 if len(full) else 0):
                out[k, full] = np.minimum.reduceat(ta.mix(triples + np.uint64(k)), begins)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *(pa.array(x.view(np.int64)) for x in out)], names=["doc_id", "k0", "k1", "k2", "k3"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by arc and label in each block of texts; an arc counts once a document."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, data, offsets, starts, ends, rows in _words(batch.column(1)):
            shorter = np.zeros(len(starts), np.uint64)
            keys, of, above = [], [], []
            for step, (at, key) in enumerate(_arcs(data, starts, ends)):
                keys.append(key)
                of.append(rows[at])
                above.append(shorter[at].copy() if step else np.zeros(len(at), np.uint64))
                if step < len(BEGINNINGS):
                    shorter[at] = key
            keys, of, above = np.concatenate(keys), np.concatenate(of), np.concatenate(above)
            order = np.lexsort((keys, of))
            keys, of, above = keys[order], of[order], above[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
            keys, label, above = keys[new], toxic[first + of[new]], above[new]
            distinct, example, which = np.unique(keys, return_index=True, return_inverse=True)
            bad = np.bincount(which, weights=label, minlength=len(distinct)).astype(np.int64)
            every = np.bincount(which, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(above[example].view(np.int64)), pa.array(bad), pa.array(every - bad)], names=["arc", "shorter", "toxic", "clean"])


class Transducer(NamedTuple):
    """Tables [state, symbol]: the state after, the symbol said, the weight of a hit, and what a pending hit is paid again."""

    after: np.ndarray
    says: np.ndarray
    own: np.ndarray
    again: np.ndarray


#: Symbols read and said. A hit has a weight; a struck target stands shortly behind a threat.
OTHER, INSULTING, TARGETED, DENYING, REPORTING, ANNOUNCING, THREATENING, HIT, STRUCK = SYMBOLS = range(9)
READ = {"target": TARGETED, "negation": DENYING, "report": REPORTING, "future": ANNOUNCING, "threat": THREATENING}


def transducer(states: int, rule: Callable[[int, int], tuple[int, int, float, float]]) -> Transducer:
    """The tables of a rule (state, symbol) -> (state after, symbol said, weight of a hit, pay again)."""
    cells = [[rule(s, x) for x in SYMBOLS] for s in range(states)]
    kinds = (np.int64, np.int64, float, float)
    return Transducer(*(np.array([[cell[k] for cell in row] for row in cells], kind) for k, kind in enumerate(kinds)))


def composed(first: Transducer, second: Transducer) -> Transducer:
    """The transducer whose second part reads what the first one says; weights of hits multiply."""
    i, j = np.divmod(np.arange(len(first.after) * len(second.after)), len(second.after))
    said = first.says[i]
    then = j[:, None]
    return Transducer(
        first.after[i] * len(second.after) + second.after[then, said], second.says[then, said],
        first.own[i] * second.own[then, said], first.again[i] + second.again[then, said],
    )


def _insult(_: int, x: int) -> tuple[int, int, float, float]:
    return 0, HIT if x == INSULTING else x, 1.0, 0.0


def _threat(state: int, x: int) -> tuple[int, int, float, float]:
    """A threat is a hit, a heavy one within four words of an announcement; a target within three words behind it is struck."""
    announced, struck = divmod(state, 5)
    said = HIT if x == THREATENING else STRUCK if x == TARGETED and struck else x
    weight = (3.0 if announced else 0.3) if x == THREATENING else 1.0
    after = 4 if x == ANNOUNCING else max(0, announced - 1)
    return after * 5 + (3 if x == THREATENING else max(0, struck - 1)), said, weight, 0.0


def _target(state: int, x: int) -> tuple[int, int, float, float]:
    """A hit within five words of a target weighs more; a target behind a hit pays it again, in full if it was struck."""
    aimed = x in (TARGETED, STRUCK)
    return 5 if aimed else max(0, state - 1), x, 1.5 if state else 1.0, (1.0 if x == STRUCK else 0.25) if aimed else 0.0


def _negation(state: int, x: int) -> tuple[int, int, float, float]:
    return 4 if x == DENYING else max(0, state - 1), x, 0.25 if state else 1.0, 0.0


def _report(state: int, x: int) -> tuple[int, int, float, float]:
    return int(state or x == REPORTING), x, 0.5 if state else 1.0, 0.0


PARTS = ((1, _insult), (25, _threat), (6, _target), (5, _negation), (2, _report))
#: 1,500 states, made once.
GRAMMAR = reduce(composed, (transducer(*part) for part in PARTS))


def clause_weights(symbols: np.ndarray, weights: np.ndarray, begins: np.ndarray, ends: np.ndarray, grammar: Transducer = GRAMMAR) -> np.ndarray:
    """What the grammar gives each stretch of words begins[i]:ends[i]: its hits, and those that a later target pays again.

    All stretches go through the table side by side, one word of each at a step.
    """
    order = np.argsort(begins - ends, kind="stable")
    at, lengths = begins[order], (ends - begins)[order]
    hit_weights = np.where(grammar.says == HIT, grammar.own, 0.0)
    state = np.zeros(len(at), np.int64)
    pending, total = np.zeros(len(at)), np.zeros(len(at))
    for step in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-lengths, -step))  # the longer ones come first
        x, s = symbols[at[:n] + step], state[:n]
        hit, again = hit_weights[s, x] * weights[at[:n] + step], grammar.again[s, x]
        total[:n] += hit + again * pending[:n]
        pending[:n] = np.where(hit > 0, hit, np.where(again > 0, 0.0, pending[:n]))
        state[:n] = grammar.after[s, x]
    out = np.zeros(len(at))
    out[order] = total
    return out


def _word_keys(words: Iterable[str]) -> np.ndarray:
    """Arc keys of whole words."""
    parts = [np.frombuffer(word.encode(), np.uint8) for word in words]
    ends = np.cumsum([len(p) for p in parts])
    return ta.word_hashes(np.concatenate(parts), ends - [len(p) for p in parts], ends) ^ np.uint64(1)


def _scanner(arcs: dict[int, float]) -> Callable:
    """(documents' weight, matched clauses) of a text column, for arc keys with weights."""
    keys = np.array(sorted(k & 0xFFFFFFFFFFFFFFFF for k in arcs), np.uint64)
    values = np.array([arcs[k if k < 1 << 63 else k - (1 << 64)] for k in keys.tolist()], float)
    flags = np.zeros(FLAGS, bool)
    flags[(keys % np.uint64(FLAGS)).astype(np.int64)] = True
    class_keys = _word_keys(CLASS)
    class_symbols = np.array([READ[kind] for kind in CLASS.values()])[np.argsort(class_keys)]
    class_keys = np.sort(class_keys)

    def scan(column) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = np.zeros(len(column)), np.zeros(len(column), np.int64)
        for first, data, offsets, starts, ends, rows in _words(column):
            weight = np.zeros(len(starts))
            for at, key in _arcs(data, starts, ends):
                near = np.flatnonzero(flags[(key % np.uint64(FLAGS)).astype(np.int64)])
                place = np.minimum(np.searchsorted(keys, key[near]), len(keys) - 1)
                same = keys[place] == key[near]
                np.maximum.at(weight, at[near[same]], values[place[same]])
            hits = np.flatnonzero(weight)
            if not len(hits):
                continue
            clause = np.cumsum(CLAUSE_END[data])[starts]
            edge = (rows[hits[1:]] != rows[hits[:-1]]) | (clause[hits[1:]] != clause[hits[:-1]]) | (np.diff(hits) > REACH)
            cut = np.flatnonzero(edge)
            low, high = hits[np.concatenate([[0], cut + 1])], hits[np.concatenate([cut, [len(hits) - 1]])]
            begin = np.maximum.reduce([low - REACH, np.searchsorted(clause, clause[low]), np.searchsorted(rows, rows[low])])
            end = np.minimum.reduce([high + REACH + 1, np.searchsorted(clause, clause[low], "right"), np.searchsorted(rows, rows[low], "right")])
            size = end - begin
            stop = np.cumsum(size)
            near = np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1]))
            place = np.minimum(np.searchsorted(class_keys, key[near]), len(class_keys) - 1)  # the last arcs are whole words
            symbols = np.where(class_keys[place] == key[near], class_symbols[place], np.where(weight[near] > 0, INSULTING, OTHER))
            found = clause_weights(symbols, np.where(symbols == THREATENING, THREAT_WEIGHT, weight[near]), stop - size, stop)
            np.add.at(sums, first + rows[low], found)
            np.add.at(counts, first + rows[low], found > 0)
        return sums, counts

    return scan


def _base_arcs() -> dict[int, float]:
    """The word lists as arcs; threats are arcs too, so that their clauses are read."""
    return {
        int(key): weight for words, weight in ((INSULT, SEED_WEIGHT), (THREAT, 0.01))
        for key in _word_keys(words.split()).view(np.int64)
    }


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a weak prior."""
    design, beta = np.stack([np.ones(len(x)), x], 1), np.array(DEFAULT)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 0.05 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - 0.05 * (beta - np.array(DEFAULT)))
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def _features(scan: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, counts = scan(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums), pa.array(counts)], names=[*batch.schema.names[:-1], "weight", "clauses"])

    return run


def fold_of(column: str):
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[dict[int, float], tuple[float, float]]:
    """Arc weights and the curve from weight to score, from at most about `rows` labelled texts outside the held-out fold.

    Arcs are word beginnings and words, with the log odds of being in a toxic
    document. Near copies count once: of texts that share a minwise hash one is
    taken. A longer arc that adds little to a shorter one is left out.
    """
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    labels = labels.where(fold_of("doc_id") != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = labels.count()
    share = lambda frame: frame.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, rows / max(labelled, 1)) * (1 << 30)))
    docs = share(docs.where("doc_id is not null"))
    sample = docs.join(share(labels), "doc_id").select("doc_id", "toxic", "text")
    chosen = sample.select("doc_id", "text").mapInArrow(_sketched, "doc_id bigint, k0 bigint, k1 bigint, k2 bigint, k3 bigint")
    for k in range(4):
        chosen = chosen.groupBy(f"k{k}").agg(F.min_by(F.struct("doc_id", "k0", "k1", "k2", "k3"), "doc_id").alias("one")).select("one.*")
    sample = sample.join(chosen.select("doc_id"), "doc_id", "left_semi").persist()
    total = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    arcs = _base_arcs()
    if not bad or not good:
        sample.unpersist()
        return arcs, DEFAULT
    counts = sample.select("toxic", "text").mapInArrow(_counted, "arc bigint, shorter bigint, toxic bigint, clean bigint")
    counts = counts.groupBy("arc", "shorter").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= SUPPORT)
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    # as many rows as the bounded sample has arcs with enough evidence
    found = counts.withColumn("odds", odds).where((F.col("odds") > 2) & (F.col("odds") * F.col("toxic") >= EVIDENCE)).select("arc", "shorter", "odds").collect()
    learned = {r["arc"]: r["odds"] for r in found}
    for r in found:
        if learned.get(r["shorter"], -1.0) < r["odds"] - 0.5:
            arcs[r["arc"]] = max(arcs.get(r["arc"], 0.0), r["odds"])
    points = sample.select("toxic", "text").mapInArrow(_features(_scanner(arcs)), "toxic int, weight double, clauses bigint")
    points = np.array([(r["toxic"], r["weight"]) for r in points.collect()], float)  # two numbers for each of the bounded rows
    sample.unpersist()
    return arcs, _logistic(np.log1p(points[:, 1]), points[:, 0])


def score(docs: DataFrame, arcs: dict[int, float], curve: tuple[float, float]) -> DataFrame:
    """doc_id, score, weight, clauses of every text: whole texts, one pass, nothing but the text is read."""
    intercept, slope = curve
    found = docs.select("doc_id", "text").mapInArrow(_features(_scanner(arcs)), "doc_id bigint, weight double, clauses bigint")
    return found.withColumn("score", 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.log1p("weight"))))).select("doc_id", "score", "weight", "clauses")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, that score below the threshold; empty texts stay."""
    arcs, (intercept, slope) = fit(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), labels)

    def run(batches: Iterator[pa.RecordBatch], scan: Callable = _scanner(arcs)) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, _ = scan(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(1 / (1 + np.exp(-(intercept + slope * np.log1p(sums)))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, weight, clauses.

    Clauses with an insult or a threat go through one table of states, composed
    of transducers for insult, threat, target, negation and reported speech,
    each of which reads what the one before it says: a negated or reported
    insult weighs less, one with a target more, and a threat needs an
    announcement and a target for its full weight. The insult arcs are a
    plain word list and learned word beginnings; scores follow the summed
    weight of the matched clauses.

    A null or empty text matches nothing and gets the score of weight 0.
    Without labels of both kinds the word list and a fixed curve are used.
    Labels with a null id or value are left out, of several the larger one
    counts. A row without doc_id is scored and not held out. Repeated rows are
    scored each. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = score(docs, *fit(docs, labels))
    held = F.coalesce(fold_of("doc_id") == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "weight", "clauses")
