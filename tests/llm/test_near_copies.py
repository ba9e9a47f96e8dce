import random
import re

import pytest

from lakeaccord.llm import neardup
from lakeaccord.llm.components import components

from .helpers import documents, odd_texts, prose, rows


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(items):
    sets = [(i, shingles(t)) for i, t in items if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {(i, len(s), root(i)) for i, s in sets}


def mutated(text, rng, share):
    return " ".join(f"z{rng.randrange(99999)}" if rng.random() < share else w for w in text.split())


def test_equals_brute_force(spark):
    rng = random.Random(5)
    texts = odd_texts()
    for seed in range(25):
        base = prose(seed, words=rng.randrange(6, 200))
        texts += [base, base.upper(), *(mutated(base, rng, rng.choice([0.005, 0.02, 0.03, 0.06, 0.3])) for _ in range(4))]
    shared = prose(99, 40)
    texts += [shared + " " + prose(1000 + i, rng.randrange(1, 60)) for i in range(40)]
    rng.shuffle(texts)
    docs = documents(spark, texts, extra=["n_shingles", "tokens", "component_id", "node"])
    found = neardup.near_duplicates(spark, docs)
    assert set(rows(found, "doc_id", "n_shingles", "component_id")) == brute(list(enumerate(texts)))


def test_a_large_group_of_near_copies_and_strangers_in_its_nodes(spark):
    rng = random.Random(8)
    base = prose(1, 150)
    texts = [mutated(base, rng, 0.01) for _ in range(250)] + [" ".join(base.split()[:60]) + " " + prose(50 + i, 90) for i in range(120)]
    found = neardup.near_duplicates(spark, documents(spark, texts))
    assert set(rows(found, "doc_id", "n_shingles", "component_id")) == brute(list(enumerate(texts)))


def test_nulls_repeats_and_empty_tables(spark):
    docs = documents(spark, [prose(1), prose(1), "", None])
    lost = spark.createDataFrame([(None, prose(1), None, None, None), (0, prose(1), None, None, None), (7, None, "en", None, 3)], docs.schema)
    found = neardup.near_duplicates(spark, docs.union(lost))
    got = sorted(rows(found, "doc_id", "component_id"), key=str)
    assert got == sorted([(0, 0), (0, 0), (1, 0), (2, 2), (3, 3), (7, 7), (None, None)], key=str)
    assert neardup.near_duplicates(spark, docs.limit(0)).collect() == []
    kept = neardup.one_of_each(spark, docs.union(lost))
    assert sorted(rows(kept, "doc_id"), key=str) == sorted([(0,), (2,), (3,), (7,), (None,)], key=str)
    assert kept.columns == docs.columns


@pytest.mark.parametrize("n", [2, 17])
def test_components_of_chains(spark, n):
    links = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(100, 101), (101, 100), (5000, 5000), (None, 3)], "a bigint, b bigint")
    found = dict(rows(components(spark, links), "node", "component"))
    assert found == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}
