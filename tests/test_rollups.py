import datetime

from pyspark.sql import functions as F

from lakeaccord.operators import rollups as ru


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_group_summary_truncates_the_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", -3.5), ("b", -4.0)], "k string, v double")
    assert rows(ru.group_summary(df, ["k"], "v", "n", "total", "mean"), "k", "n", "total", "mean") == [
        ("a", 2, 3.0, 1), ("b", 2, -7.5, -3),
    ]


def test_amounts_keep_their_digits(spark):
    df = spark.createDataFrame([("a", 0.125), ("a", 0.375)], "k string, v double")
    assert ru.group_summary(df, ["k"], "v", "n", "total", "mean").first()["total"] == 0.5
    whole = spark.createDataFrame([("a", 2**60), ("a", 1)], "k string, v bigint")
    entities = spark.createDataFrame([("a", 10.0), ("b", 10.0)], "k string, capacity double")
    got = ru.summary_with_fallback(entities, "k", "capacity", whole.withColumn("v", F.lit(3)), "k", "v")
    assert rows(got, "k", "fact_count", "avg_amount") == [("a", 2, 3), ("b", 0, 7)]


def test_summary_through_key_counts_every_fact_once(spark):
    facts = spark.createDataFrame([(1 if i % 3 == 0 else i % 10, 1.0) for i in range(300)], "k bigint, v double")
    dim = spark.createDataFrame([(i, "odd" if i % 2 else "even") for i in range(10)], "id bigint, kind string")
    got = ru.summary_through_key(facts, "k", "v", dim, "id", "kind")
    assert got.agg(F.sum("total_count"), F.sum("total_amount")).first()[:] == (300, 300.0)


def test_count_and_distinct(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("a", None), ("b", "x")], "k string, v string")
    assert rows(ru.count_and_distinct(df, "k", "v", "n", "d"), "k", "n", "d") == [("a", 3, 2), ("b", 1, 1)]


def test_fallback_for_entities_without_facts(spark):
    venues = spark.createDataFrame([(1, 1000.0), (2, 999.0)], "v bigint, capacity double")
    matches = spark.createDataFrame([(1, 100.0), (1, 201.0)], "venue bigint, attendance double")
    got = ru.summary_with_fallback(venues, "v", "capacity", matches, "venue", "attendance")
    assert rows(got, "v", "avg_amount", "fact_count", "total_amount") == [(1, 150, 2, 300), (2, 779, 0, 0)]


def test_period_labels(spark):
    days = [datetime.date(2023, 1, 1), datetime.date(2024, 12, 30)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select(*[ru.period_label(F.col("d"), p) for p in ("month", "quarter", "week", "year")]).collect()
    assert [tuple(r) for r in got] == [("2023-01", "Q1-2023", "2022-W52", "2023"), ("2024-12", "Q4-2024", "2025-W01", "2024")]


def test_average_per_group_rounds_ties_of_inexact_quotients_to_even(spark):
    # 4.95 / 3 is 1.6500000000000001, 11.85 / 3 is 3.9499999999999997: ties of the amounts.
    df = spark.createDataFrame([(k, v) for k, v in (("a", 1.65), ("b", 3.95), ("c", -1.65)) for _ in range(3)], "k string, v double")
    assert rows(ru.average_per_group(df, ["k"], "v", as_type="decimal(18,4)"), "k", "average") == [("a", 1.6), ("b", 4.0), ("c", -1.6)]


def test_average_per_group_rounds_half_even(spark):
    df = spark.createDataFrame([("a", 12.2), ("a", 12.3), ("b", 0.1), ("b", 0.4)], "k string, v double")
    assert rows(ru.average_per_group(df, ["k"], "v", as_type="decimal(18,4)"), "k", "average") == [("a", 12.2), ("b", 0.2)]


def test_bins_keep_their_total(spark):
    ages = spark.createDataFrame([(i % 100,) for i in range(1000)], "age int")
    fine = ru.fine_bins(ages, "age", 5, 17)
    coarse = ru.coarsen_bins(fine, 2)
    assert fine.count() == 18 and coarse.count() == 9
    assert coarse.agg(F.sum("population_count")).first()[0] == 1000
    labels = [r[0] for r in coarse.orderBy("bin_index").select(ru.bin_label(F.col("bin_index"), 10, 8)).collect()]
    assert labels == ["0-9", "10-19", "20-29", "30-39", "40-49", "50-59", "60-69", "70-79", "80+"]


def test_shares(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, v bigint")
    assert rows(ru.share_of_total(df, "v"), "k", "pct_total") == [("a", 33.33), ("a", 33.33), ("b", 33.33)]
    assert rows(ru.share_of_total(df, "v", "p", ["k"]), "k", "p") == [("a", 50.0), ("a", 50.0), ("b", 100.0)]


def test_unique_names_with_a_hot_name(spark):
    data = [(i, "Ann Lee" if i % 3 else f"n{i}") for i in range(1, 31)] + [(31, None)]
    got = {r["id"]: r["u"] for r in ru.unique_names(spark.createDataFrame(data, "id bigint, name string"), "name", "id", "u", " ").collect()}
    assert got[1] == "Ann Lee" and got[2] == "Ann Lee 2" and got[3] == "n3" and got[31] is None
    assert len({v for v in got.values() if v}) == 30


def test_code_join_and_variants(spark):
    df = spark.createDataFrame([("fr", 1), ("xx", 2)], "c string, id int")
    codes = spark.createDataFrame([("fr", "France"), ("fr", "France")], "code string, name string")
    assert rows(ru.join_codes(df, "c", codes, "code", "name", "country").fillna("-"), "id", "country") == [(1, "France"), (2, "-")]
    split = ru.variants(df, {"a": ["id"], "b": ["id", "c"]}, {"b": {"c": "code"}})
    assert split["a"].columns == ["id"] and split["b"].columns == ["id", "code"]


def test_share_within_a_null_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 2), (None, 6)], "g string, v int")
    got = sorted(((r["g"], r["v"], r["pct_total"]) for r in ru.share_of_total(df, "v", within=["g"]).collect()), key=str)
    assert got == [("a", 1, 25.0), ("a", 3, 75.0), (None, 2, 25.0), (None, 6, 75.0)]
