import math
import statistics

import pytest
from pyspark.sql import functions as F

from lakeaccord.operators.profile import manifests, numeric_columns, profile, profile_lake
from lakeaccord.operators.sampling import sample_values

SCHEMA = "k bigint, n double, s string, flag boolean, empty double, list array<int>"
ROWS = [
    (1, 1.5, "a", True, None, [1, 2]),
    (2, float("nan"), "b", False, None, [1, 2]),
    (3, 2.5, None, True, None, None),
    (4, 1.5, "a", None, None, [3]),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def by_column(df):
    return {r["col_name"]: r for r in df.collect()}


def test_exact_means_do_not_depend_on_the_order_of_rows(spark):
    # 600 prices whose mean is a tie at four digits; the sum of doubles lands on either side of it.
    cents = [(i * 7919 % 9_999_991, 1) for i in range(1, 600)]
    cents.append((3_146_789_301 - sum(c for c, _ in cents), 1))
    rows = sorted(cents)
    for order in (rows, rows[::-1], cents):
        df = spark.createDataFrame([(c / 100, None if i % 2 else float("nan")) for i, (c, _) in enumerate(order)], "v double, none double").coalesce(1)
        got = by_column(profile(df, "t", exact={"v": "decimal(18,2)", "none": "decimal(18,2)"}))
        assert got["v"]["mean"] == 52446.4884 and got["none"]["mean"] is None


def test_counts_and_moments(rows):
    got = by_column(profile(rows, "t"))
    assert {r["table_name"] for r in got.values()} == {"t"}
    assert [got["k"][c] for c in ("row_count", "null_count", "distinct_count", "min", "max", "mean")] == [4, 0, 4, 1.0, 4.0, 2.5]
    assert got["k"]["std"] == round(statistics.stdev([1, 2, 3, 4]), 4)
    # NaN is missing
    assert [got["n"][c] for c in ("null_count", "distinct_count", "min", "max", "mean")] == [1, 2, 1.5, 2.5, round(5.5 / 3, 4)]
    assert [got["s"][c] for c in ("null_count", "distinct_count", "min", "std")] == [1, 2, None, None]
    assert [got["flag"][c] for c in ("null_count", "distinct_count", "min", "max")] == [1, 2, 0.0, 1.0]
    assert [got["empty"][c] for c in ("null_count", "distinct_count", "min", "mean")] == [4, 0, None, None]
    assert [got["list"][c] for c in ("null_count", "distinct_count", "min")] == [1, 2, None]


def test_empty_and_single_row_tables(spark, rows):
    empty = by_column(profile(rows.limit(0), "t"))
    assert all(r["row_count"] == r["null_count"] == r["distinct_count"] == 0 for r in empty.values())
    single = by_column(profile(rows.filter("k = 1"), "t"))
    assert single["n"]["std"] is None and single["n"]["mean"] == 1.5
    constant = by_column(profile(spark.createDataFrame([(2.0,)] * 5, "c double"), "t"))
    assert constant["c"]["std"] == 0.0 and constant["c"]["distinct_count"] == 1


def test_infinity_stays_a_number(spark):
    got = by_column(profile(spark.createDataFrame([(1.0,), (math.inf,)], "x double"), "t"))
    assert got["x"]["max"] == math.inf and got["x"]["null_count"] == 0


def test_repartitioning_changes_nothing(rows):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(profile(rows, "t")) == key(profile(rows.repartition(5, "s"), "t"))


def test_group_profile_equals_profiles_of_the_parts(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i % 5, f"s{i % 4}") for i in range(60)], "t string, x int, s string")
    together = {(r["table_name"], r["col_name"]): r for r in profile(df, group="t").collect()}
    for name in ("a", "b"):
        for r in profile(df.filter(F.col("t") == name).drop("t"), name).collect():
            assert together[(name, r["col_name"])] == r


def test_approximate_counts_are_near(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("m"))
    exact, approx = by_column(profile(df, "t")), by_column(profile(df, "t", approx_distinct=True))
    for name in ("id", "m"):
        assert abs(approx[name]["distinct_count"] / exact[name]["distinct_count"] - 1) < 0.1
        assert approx[name]["mean"] == exact[name]["mean"]
    assert "Exchange hashpartitioning" not in profile(df, "t", approx_distinct=True)._jdf.queryExecution().toString()


def test_lake_profile_and_manifests(rows):
    lake = profile_lake({"one": rows, "two": rows.select("k", "s")})
    assert lake.count() == 8
    samples = sample_values(rows, ["k", "s"], ["k"], n=6, table="one")
    found = manifests(lake.filter("table_name = 'one'"), samples).first()
    assert found["table"] == "one" and set(found["columns"]) == set(rows.columns)
    assert sorted(found["columns"]["k"]["sample_values"]) == ["1", "2", "3", "4"]
    assert found["columns"]["empty"]["sample_values"] == []


def test_numeric_columns(rows):
    assert numeric_columns(rows) == ["k", "n", "flag", "empty"]


def test_instants_are_counted_not_their_local_text(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(1699162200,), (1699165800,), (1699165800,), (None,)], "s bigint").selectExpr("timestamp_seconds(s) AS t")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert profile(df, "x").first()["distinct_count"] == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
