import random

import pytest

from lakeaccord.llm import decontamination as d

from .helpers import documents, odd_texts, prose, rows

ITEMS = "item_id bigint, text string"


def distance(pattern, text):
    """Smallest edit distance of the pattern to a substring, by the whole matrix."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        above, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (p != c)))
    return min(row)


@pytest.mark.parametrize("seed", range(40))
def test_bit_parallel_distance(seed):
    rng = random.Random(seed)
    pattern = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 90)))
    text = "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 120)))
    best, end = d.closest(d.masks(pattern), len(pattern), text)
    assert best == distance(pattern, text)
    assert best == len(pattern) or distance(pattern, text[:end]) == best


def edited(text, n, rng):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        text[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice("abcdefgh")]
    return "".join(text)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    items = [prose(i, rng.randrange(8, 40)) for i in range(12)] + ["short one", "É a"]
    texts = odd_texts()
    for _ in range(60):
        item = rng.choice(items[:12])
        texts.append(prose(rng.randrange(10**6), rng.randrange(0, 60)) + "\n" + edited(item, rng.randrange(0, 2 + int(len(item) * 0.1)), rng).upper() + " " + prose(rng.randrange(10**6), rng.randrange(0, 60)))
    texts += ["a short  ONE, here", "é A", prose(4, 30)]
    docs = documents(spark, texts, extra=["item_id", "start", "distance"])
    benchmark = spark.createDataFrame([*enumerate(items), (None, None), (50, "")], ITEMS)
    want = set()
    for i, text in enumerate(texts):
        plain = d.normalized_text(text)
        for k, item in enumerate(items):
            item = d.normalized_text(item)
            if len(plain) < 3000 and distance(item, plain) <= d.budget(len(item)) or item in plain:
                want.add((i, k))
    found = d.leaks(spark, docs, benchmark)
    assert set(rows(found, "doc_id", "item_id")) == want
    for i, k, start, end, far in rows(found, "doc_id", "item_id", "start", "end", "distance"):
        item = d.normalized_text(items[k])
        assert distance(item, d.normalized_text(texts[i])[start:end]) == far <= d.budget(len(item))
    blocked = d.leaks(spark, docs, benchmark, block_bytes=200)
    assert sorted(map(tuple, blocked.collect())) == sorted(map(tuple, found.collect()))
    kept = d.clean(docs, benchmark, block_bytes=200)
    assert {i for (i,) in rows(kept, "doc_id")} == set(range(len(texts))) - {i for i, _ in want} and kept.columns == docs.columns


def test_nulls_repeats_and_empty_tables(spark):
    docs = documents(spark, [prose(1, 30), None])
    more = docs.union(docs).union(spark.createDataFrame([(None, prose(1, 30), None, None, None)], docs.schema))
    benchmark = spark.createDataFrame([(1, prose(1, 30)), (1, prose(1, 30)), (None, prose(1, 30))], ITEMS)
    assert d.leaks(spark, more, benchmark).count() == 9
    assert d.leaks(spark, more, benchmark.limit(0)).collect() == [] and d.leaks(spark, docs.limit(0), benchmark).collect() == []
    assert d.clean(more, benchmark.limit(0)).count() == 5 and d.clean(more, benchmark).count() == 2


def test_short_items_are_whole_words(spark):
    docs = documents(spark, ["see you yesterday", "Yes", "he said yes to it", "a", "banana", "it is a yes"])
    benchmark = spark.createDataFrame([(0, "Yes"), (1, "a")], ITEMS)
    assert set(rows(d.leaks(spark, docs, benchmark), "doc_id", "item_id")) == {(1, 0), (2, 0), (3, 1), (5, 0), (5, 1)}
    assert sorted(rows(d.clean(docs, benchmark), "doc_id")) == [(0,), (4,)]
