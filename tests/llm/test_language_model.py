import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lakeaccord.llm import language_model as lm
from lakeaccord.llm.queries import QUERIES
from tests.llm.helpers import DOCUMENTS, documents, odd_texts, prose, rows

END = object()
FOLDER = "/root/testdata/sf0.001"
NAMES = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), END]


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Plain:
    """The smoothing formula as it stands, over dictionaries of whole n-grams."""

    def __init__(self, texts, order, strength):
        self.order, self.strength, self.counts = order, strength, Counter()
        for text in texts:
            words = [END, *tokens(text)]
            for i in range(1, len(words)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        self.counts[tuple(words[i - k + 1 : i + 1])] += 1
        self.single = {g: c for g, c in self.counts.items() if len(g) == 1}
        self.n, self.v = sum(self.single.values()), len(self.single)

    def p(self, history, w):
        if not history:
            return (self.single.get((w,), 0) + 1) / (self.n + self.v + 1)
        context = self.counts.get(tuple(history), 0)
        return (self.counts.get((*history, w), 0) + self.strength * self.p(history[1:], w)) / (context + self.strength)

    def row(self, doc_id, text):
        words = [END, *tokens(text)]
        own = words[1:]
        score = sum(math.log10(self.p(words[max(0, i - self.order + 1) : i] if self.order > 1 else [], w)) for i, w in enumerate(words) if i)
        base = sum(math.log10(self.p([], w)) for w in own)
        return is_held_out(doc_id), len(own), sum((w,) in self.single for w in own), self.n, base, score


def agree(found, wanted):
    assert len(found) == len(wanted)
    for a, b in zip(sorted(found, key=repr), sorted(wanted, key=repr), strict=True):
        assert a[:-2] == b[:-2]
        assert a[-2:] == pytest.approx(b[-2:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("order", "block_bytes", "shard_grams"), [(1, 1 << 20, 1 << 20), (2, 3000, 700), (2, 1 << 23, 1 << 21), (3, 2000, 300)])
def test_scores_agree_with_the_formula(spark, order, block_bytes, shard_grams):
    rng = random.Random(order)
    texts = [*odd_texts(), "İstanbul ſtraße ÀÉ", "a\x1cb\x1fc\x85d e", *(prose(i, rng.randrange(1, 90), 40) for i in range(60)), *["a copy of a text that stands often"] * 70]
    frame = documents(spark, texts, extra=("block", "held_out", "level", "score"))
    data = [(i, t) for i, t in enumerate(texts)] + [(None, "an id is missing here"), (None, None), (3, "one"), (3, "one")]
    frame = frame.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data[len(texts) :]], DOCUMENTS), allowMissingColumns=True).repartition(4)
    plain = Plain([t for i, t in data if not is_held_out(i)], order, 20.0)
    found = rows(lm.score(spark, frame, order, 20.0, block_bytes, shard_grams), "doc_id", *NAMES)
    agree(found, [(i, *plain.row(i, t)) for i, t in data])


def test_chances_of_all_words_add_up_to_one():
    texts = [prose(i, 30, 25) for i in range(40)] + ["q r s"]
    grams = lm.Grams(pa.array(texts), 3)
    train = np.array([i < 40 for i in range(41)])
    totals = [grams.counts(k, train) for k in range(3)]
    n, v = int(totals[0].sum()), int(np.count_nonzero(totals[0]))
    automaton = lm.Automaton(grams, totals, n, v, 5.0)
    known = np.flatnonzero(totals[0]).tolist()
    unknown = next(w for w in range(grams.words) if w not in set(known))
    text = grams.ids[grams.begins[7] : grams.begins[7] + 12].tolist()
    for cut in range(len(text)):
        before = automaton.score(text[:cut])
        total = sum(10 ** (automaton.score([*text[:cut], w]) - before) for w in [*known, unknown])
        assert total == pytest.approx(1, abs=1e-9)


def test_without_training_texts_and_without_rows(spark):
    ids = [i for i in range(300) if is_held_out(i)][:5]
    frame = spark.createDataFrame([(i, "some words", "en", "s", 1) for i in ids], DOCUMENTS)
    for r in lm.score(spark, frame).collect():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (True, 3, 0, 0, 0.0, 0.0)
    assert lm.score(spark, frame.limit(0)).count() == 0


def test_hashes_of_grams_travel_whole():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (np.cumsum(lm._values(lm._planes(np.diff(values, prepend=np.uint64(0))), np.uint64)) == values).all()


def test_query_scores_held_out_texts_better_than_single_words(spark):
    found = QUERIES["op12_text_scores"][0](spark, FOLDER)
    assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in lm.bits_per_token(found).collect():
        assert r["bits"] < r["base_bits"] - 0.5


def test_the_session_keeps_its_setting(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    lm.score(spark, documents(spark, ["a b", "c"]))
    assert spark.conf.get(name) == before
