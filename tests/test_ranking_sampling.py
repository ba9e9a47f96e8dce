import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeaccord.functions.hashing import order_hash
from lakeaccord.operators.ranking import keep_smallest, rank_by_hash, rank_with_ties, row_numbers, running_total
from lakeaccord.operators.sampling import (
    pick_from_pool, sample_values, stratified_folds, stratified_sample,
)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def labelled(spark, n=900):
    """A third of the rows carry one label, one label has a single row."""
    rows = [(i, "hot" if i % 3 == 0 else f"l{i % 7}") for i in range(n)] + [(n, "single"), (n + 1, None)]
    return spark.createDataFrame(rows, "id bigint, label string"), rows


def test_rank_by_hash_is_a_row_number(spark):
    df, rows = labelled(spark)
    ranked = rank_by_hash(df.withColumn("h", order_hash(1, F.col("id"))), ["label"], "h", "r", group_rows="g")
    groups = defaultdict(list)
    for i, label in rows:
        groups[label].append((md5(f"1|{i}"), i))
    expected = {i: (r, len(g)) for g in groups.values() for r, (_, i) in enumerate(sorted(g), 1)}
    assert {r["id"]: (r["r"], r["g"]) for r in ranked.collect()} == expected
    assert set(ranked.columns) == {"id", "label", "h", "r", "g"}


@pytest.mark.parametrize("quota", [0, 1, 17, 10_000])
def test_keep_smallest(spark, quota):
    df, rows = labelled(spark)
    kept = keep_smallest(df.withColumn("h", order_hash(1, F.col("id"))), [], "h", F.lit(quota).cast("bigint"))
    expected = sorted(rows, key=lambda r: md5(f"1|{r[0]}"))[:quota]
    assert {r["id"] for r in kept.collect()} == {i for i, _ in expected}


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_row_numbers_follow_the_key(spark, kind):
    keys = random.Random(3).sample(range(-10**9, 10**9), 3000)
    df = spark.createDataFrame([(k if kind == "bigint" else float(k),) for k in keys], f"k {kind}")
    numbered = {int(r["k"]): r["row_number"] for r in row_numbers(df.repartition(7), "k", rows_per_bucket=50).collect()}
    assert numbered == {k: i for i, k in enumerate(sorted(keys), 1)}


def test_row_numbers_with_extreme_and_clustered_keys(spark):
    keys = [float("-inf"), float("inf"), None] + [1e300, -1e300] + [i / 1000 for i in range(500)] + [1e6 + i for i in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k double")
    numbered = {r["k"]: r["row_number"] for r in row_numbers(df.repartition(3), "k", rows_per_bucket=10).collect()}
    ordered = [None] + sorted(k for k in keys if k is not None)
    assert numbered == {k: i for i, k in enumerate(ordered, 1)}


def test_row_numbers_of_an_empty_table(spark):
    assert row_numbers(spark.createDataFrame([], "k bigint"), "k").collect() == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-5, 5), min_size=1, max_size=40))
def test_rank_with_ties(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    ranked = rank_with_ties(df, "v", "r", rows_per_bucket=4)
    assert {r["i"]: r["r"] for r in ranked.collect()} == {
        i: 1 + sum(w > v for w in values) for i, v in enumerate(values)
    }


def test_ranks_of_nan_infinity_and_null(spark):
    values = [float("nan"), float("inf"), 3.0, None, float("-inf"), float("nan"), 3.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    for rows in (1, 1000):
        ranked = {r["i"]: r["r"] for r in rank_with_ties(df, "v", "r", rows_per_bucket=rows).collect()}
        assert ranked == {0: 1, 5: 1, 1: 3, 2: 4, 6: 4, 4: 6, 3: None}


def test_hot_value_is_one_row_of_the_ranking(spark):
    df = spark.createDataFrame([(i, 5.0 if i % 3 == 0 else float(i)) for i in range(3000)], "i int, v double")
    ranked = {r["i"]: r["r"] for r in rank_with_ties(df, "v", "r").collect()}
    assert len(ranked) == 3000 and len({ranked[i] for i in range(0, 3000, 3)}) == 1


def test_sampled_values_are_the_first_in_hash_order(spark):
    rows = [(i, float(i % 50), None if i % 2 else f"t{i}", None) for i in range(500)] + [(500, 1e8, "x", "only")]
    df = spark.createDataFrame(rows, "id bigint, n double, s string, rare string")
    got = {r["col_name"]: r["sample_values"] for r in sample_values(df, ["n", "s", "rare"], ["id"], n=10, table="t").collect()}
    ordered = sorted(rows, key=lambda r: md5(f"42|{r[0]}"))
    assert got["n"] == [str(r[1]) for r in ordered][:10]
    assert got["s"] == [r[2] for r in ordered if r[2] is not None][:10]
    assert got["rare"] == ["only"]


def test_sample_of_many_tables_equals_samples_of_each(spark):
    rows = [(f"t{i % 3}", i, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "t string, id bigint, v double")
    together = {r["table_name"]: r["sample_values"] for r in sample_values(df, ["v"], ["id"], n=5, table=F.col("t")).collect()}
    for name in ("t0", "t1", "t2"):
        alone = sample_values(df.filter(F.col("t") == name), ["v"], ["id"], n=5, table=name).first()["sample_values"]
        assert together[name] == alone


@pytest.mark.parametrize("n", [1, 5, 70, 119, 902, 5000])
def test_stratified_sample_sizes(spark, n):
    df, rows = labelled(spark)
    sampled = [(r["id"], r["label"]) for r in stratified_sample(df, "label", ["id"], n).collect()]
    counts = Counter(label for _, label in rows)
    wanted = {label: min(c, max(1, round(c * n / len(rows)))) for label, c in counts.items()}
    assert len(sampled) == min(n, sum(wanted.values())) and len(set(sampled)) == len(sampled)
    if sum(wanted.values()) <= n:
        assert Counter(label for _, label in sampled) == Counter(wanted)


def test_folds_are_disjoint_complete_and_even(spark):
    df, rows = labelled(spark)
    folds = stratified_folds(df, "label", ["id"], k=5).collect()
    assert sorted(r["id"] for r in folds) == [i for i, _ in rows]
    per_label = defaultdict(Counter)
    for r in folds:
        per_label[r["label"]][r["fold"]] += 1
    for counts in per_label.values():
        sizes = [counts.get(f, 0) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_picks_differ_and_respect_the_limits(spark):
    groups = spark.range(200).withColumnRenamed("id", "g")
    pool = spark.createDataFrame([(f"a{i}",) for i in range(80)], "actor string")
    picks = defaultdict(list)
    for r in pick_from_pool(groups, "g", pool, "actor", 2, 5).collect():
        picks[r["g"]].append(r["picked"])
    assert len(picks) == 200
    assert all(2 <= len(p) <= 5 and len(set(p)) == len(p) for p in picks.values())
    assert len({len(p) for p in picks.values()}) == 4
    counts = Counter(v for p in picks.values() for v in p)
    assert len(counts) == 80 and max(counts.values()) < 30


def test_picks_from_a_pool_that_is_too_short(spark):
    groups = spark.range(20).withColumnRenamed("id", "g")
    pool = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string")
    picks = defaultdict(set)
    for r in pick_from_pool(groups, "g", pool, "v", 2, 5).collect():
        picks[r["g"]].add(r["picked"])
    assert len(picks) == 20 and all(p == {"a", "b"} for p in picks.values())
    assert pick_from_pool(groups, "g", pool.limit(0), "v", 2, 5).count() == 0


def test_rows_without_a_value_keep_a_null_rank(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0), (4, 5.0)], "k int, v double")
    assert {r["k"]: r["rank"] for r in rank_with_ties(df, "v").collect()} == {1: 2, 2: None, 3: 1, 4: 2}


def test_running_total(spark):
    df = spark.createDataFrame([(i * 3 - 50, i % 4) for i in range(200)], "k bigint, n int")
    want, total = {}, 0
    for i in range(200):
        want[i * 3 - 50] = total
        total += i % 4
    for rows in (7, 10**6):
        assert {r["k"]: r["before"] for r in running_total(df, "k", "n", rows_per_bucket=rows).collect()} == want


def test_nan_is_no_sample_value(spark):
    df = spark.createDataFrame([(i, float("nan") if i % 2 else float(i)) for i in range(40)], "k int, v double")
    got = sample_values(df, ["v"], ["k"], n=30, table="t").first()["sample_values"]
    assert len(got) == 20 and "NaN" not in got
