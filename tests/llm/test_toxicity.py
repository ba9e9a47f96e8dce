import zlib

import numpy as np
import pytest

from lakeaccord.llm import toxicity as t

from .helpers import LABELS, documents, odd_texts, prose, rows

import duckdb

FOLDER = "/root/testdata/sf0.01"


def weight(spark, *texts):
    return [w for _, w in sorted(rows(t.score(documents(spark, texts), t._base_arcs(), t.DEFAULT), "doc_id", "weight"))]


def test_grammar(spark):
    plain, denied, said, aimed, far, threat, loose, none, split = weight(
        spark, "what an idiot here", "that is not an idiot here", "someone said what an idiot here", "you are an idiot here", "you wrote nothing. an idiot here", "I will kill you", "they beat the eggs", "nothing of the kind", "not this. an idiot here"
    )
    assert plain > denied > 0 and plain > said > 0 and aimed > plain and far == plain and split == plain
    assert threat > 3 * loose and none == 0


def plain(symbols, weights):
    """A plain interpreter of the grammar: one word after the other, with counters."""
    denied = reported = aimed = announced = struck = 0
    last = total = 0.0
    for x, weight in zip(symbols, weights, strict=True):
        if x == t.THREATENING:
            weight *= 3.0 if announced else 0.3
            struck = 4
        if x in (t.INSULTING, t.THREATENING):
            last = weight * (0.25 if denied else 1.0) * (0.5 if reported else 1.0) * (1.5 if aimed else 1.0)
            total += last
        elif x == t.TARGETED:
            total += last * (1.0 if struck else 0.25)
            last = 0.0
        denied = 4 if x == t.DENYING else max(0, denied - 1)
        aimed = 5 if x == t.TARGETED else max(0, aimed - 1)
        announced = 4 if x == t.ANNOUNCING else max(0, announced - 1)
        struck = max(0, struck - 1)
        reported = reported or x == t.REPORTING
    return total


@pytest.mark.parametrize("seed", range(4))
def test_composed_table_is_the_plain_interpreter(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(0, 40, 300), [0, 5000]])
    ends = np.cumsum(lengths)
    symbols = rng.choice(7, ends[-1], p=[0.4, 0.1, 0.12, 0.1, 0.03, 0.1, 0.15])
    weights = np.where(symbols == t.THREATENING, t.THREAT_WEIGHT, rng.uniform(2, 9, len(symbols)))
    found = t.clause_weights(symbols, weights, ends - lengths, ends)
    want = [plain(symbols[a:b], weights[a:b]) for a, b in zip(ends - lengths, ends, strict=True)]
    assert np.allclose(found, want, rtol=1e-12) and found.max() > 100 and found[300] == 0


def test_composition_reads_what_the_first_part_says():
    parts = [t.transducer(*part) for part in t.PARTS]
    assert len(t.GRAMMAR.after) == np.prod([states for states, _ in t.PARTS])
    rng, states, state = np.random.default_rng(1), [0] * len(parts), 0
    for x in rng.integers(0, 7, 2000).tolist():
        said, own, again = x, 1.0, 0.0
        for k, part in enumerate(parts):
            here = states[k], said
            own, again = own * part.own[here], again + part.again[here]
            states[k], said = int(part.after[here]), int(part.says[here])
        assert (said, own, again) == (t.GRAMMAR.says[state, x], t.GRAMMAR.own[state, x], t.GRAMMAR.again[state, x])
        state = t.GRAMMAR.after[state, x]


def test_a_long_text_of_hits_and_stretches_at_its_edges(spark):
    first, last, long = weight(spark, "idiot", "well well idiot", "you idiot " * 50_000)
    assert first == last == t.SEED_WEIGHT and long > 100_000


def test_capitals_and_accents(spark):
    a, b, c = weight(spark, "IDIOT", "Estúpido ESTÚPIDO", "idiotic-idiots")
    assert a > 0 and b > a and c == 0


def corpus(spark, n=900):
    texts = [prose(i, 60) for i in range(n)]
    toxic = {i for i in range(n) if i % 7 == 0}
    for i in toxic:
        words = texts[i].split()
        for k in range(5, 60, 20):
            words[k] = f"grunz{'abcdef'[(i + k) % 6]}el"
        texts[i] = " ".join(words)
    return texts, toxic, spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(n)], LABELS)


def test_learned_beginnings_and_held_out_accuracy(spark):
    texts, toxic, labels = corpus(spark)
    found = t.toxicity(documents(spark, texts, extra=["score", "weight", "toxic", "k0"]), labels).collect()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3) == int(r["doc_id"] in toxic)


def test_held_out_labels_are_not_learned(spark):
    texts, toxic, labels = corpus(spark, 400)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    only = spark.createDataFrame([(i, 1, int(i in toxic)) for i in held], LABELS)
    assert t.fit(documents(spark, texts), only) == (t._base_arcs(), t.DEFAULT)


def test_held_out_accuracy_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{FOLDER}/labels.parquet'").fetchall())
    found = [r for r in t.toxicity(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    hits = sum(r["predicted"] == truth[r["doc_id"]] for r in found)
    assert len(found) > 50 and hits / len(found) > 0.9


def test_nulls_repeats_and_empty_tables(spark):
    docs = documents(spark, [*odd_texts(), "an idiot", "an idiot"])
    more = docs.union(docs).union(spark.createDataFrame([(None, "an idiot", None, None, None)], docs.schema))
    labels = spark.createDataFrame([(0, 1, None), (None, 1, 1), (1, 1, 0), (1, 1, 1), (77, 0, 1)], LABELS)
    found = t.toxicity(more, labels)
    assert found.count() == 2 * docs.count() + 1
    low = {s for _, s, w in rows(found, "doc_id", "score", "weight") if w == 0}
    assert len(low) == 1 and max(low) < 0.3
    assert t.toxicity(docs.limit(0), labels).collect() == [] and t.toxicity(docs, labels.limit(0)).count() == docs.count()
    kept = t.clean(more, labels)
    assert kept.columns == docs.columns and kept.count() == found.where("predicted = 0").count()
