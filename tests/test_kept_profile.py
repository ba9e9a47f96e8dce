import hashlib
import random
import statistics

from pyspark.sql import functions as F

from lakeaccord.operators import kept_profile as kp
from lakeaccord.operators.ranking import keep_smallest
from lakeaccord.operators.sampling import sample_values, stratified_sample
from lakeaccord.sources.catalog import read_manifests, write_many_manifests

SCHEMA = "k bigint, v double, who string, nothing int"


def rows_of(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice([None, float("nan"), rng.gauss(1e6, 3.0)]) if i % 5 == 0 else rng.gauss(1e6, 3.0), rng.choice([None, "a", "b" * 90]), None) for i in range(n)]


def test_merged_parts_are_the_profile_of_all_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    every = []
    for part, n in (("a", 3000), ("b", 1), ("c", 0), ("d", 700)):
        rows = rows_of(n, len(every))
        every += rows
        kp.keep_summary(spark.createDataFrame(rows, SCHEMA), "t", part, path)
    found = {r["col_name"]: r for r in kp.merged_profile(kp.read_summaries(spark, path)).collect()}
    values = [v for _, v, *_ in every if v is not None and v == v]
    assert found["v"]["row_count"] == len(every) and found["v"]["null_count"] == len(every) - len(values)
    assert abs(found["v"]["mean"] / statistics.fmean(values) - 1) < 1e-12 and abs(found["v"]["std"] / statistics.stdev(values) - 1) < 1e-3
    assert abs(found["v"]["distinct_count"] / len(set(values)) - 1) < kp.DISTINCT_ERROR and (found["v"]["min"], found["v"]["max"]) == (min(values), max(values))
    ordered = sorted(values)
    for q, x in zip((0.25, 0.5, 0.75), found["v"]["quantiles"], strict=True):
        assert abs(sum(o <= x for o in ordered) / len(ordered) - q) < kp.RANK_ERROR
    assert found["who"]["distinct_count"] == 2 and found["who"]["mean"] is None and found["who"]["quantiles"] is None
    assert found["nothing"]["null_count"] == len(every) and found["nothing"]["distinct_count"] == 0


def test_a_part_written_again_takes_its_place_and_only_new_parts_are_read(spark, tmp_path):
    path = str(tmp_path / "s")
    kp.keep_summary(spark.range(100).select("id"), "t", "old", path)
    kp.keep_summary(spark.range(100, 150).select("id"), "t", "new", path)
    kp.keep_summary(spark.range(100, 160).select("id"), "t", "new", path)
    kp.keep_summary(spark.range(100).select((F.col("id") + 80).alias("other")), "u", "new", path)
    kept = kp.read_summaries(spark, path)
    assert {(r["table_name"], r["part"]): r["row_count"] for r in kept.collect()} == {("t", "old"): 100, ("t", "new"): 60, ("u", "new"): 100}
    assert kp.merged_profile(kept).where("table_name = 't'").first()["distinct_count"] == 160
    pairs = spark.createDataFrame([("t", "id", "u", "other"), ("t", "id", "t", "id"), ("t", "id", "gone", "x")], "table_a string, col_a string, table_b string, col_b string")
    shared = {(r["table_b"]): (r["distinct_a"], r["distinct_b"], r["both"], r["jaccard"]) for r in kp.shared_values(kept, pairs).collect()}
    assert shared == {"u": (160, 100, 80, 80 / 180), "t": (160, 160, 160, 1.0)}


def test_no_summaries(spark, tmp_path):
    assert kp.merged_profile(kp.read_summaries(spark, str(tmp_path / "none"))).count() == 0


def jobs_of(spark, tag, run):
    spark.sparkContext.setJobGroup(tag, tag)
    run()
    found = spark.sparkContext.statusTracker().getJobIdsForGroup(tag)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(found)


def test_manifests_of_many_tables_are_a_fixed_number_of_jobs(spark, tmp_path):
    def frame(tables):
        return spark.range(tables * 7).select(F.concat(F.lit("t"), F.col("id") % tables).alias("name"), "id", (F.col("id") % 3).alias("v"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("half"))

    few = jobs_of(spark, "few", lambda: write_many_manifests(frame(5), "name", ["v", "half"], ["id"], str(tmp_path / "few")))
    many = jobs_of(spark, "many", lambda: write_many_manifests(frame(1000), "name", ["v", "half"], ["id"], str(tmp_path / "many")))
    assert abs(many - few) <= 2
    found = read_manifests(spark, str(tmp_path / "many"))
    assert found.count() == 2000 and found.select("table_name").distinct().count() == 1000
    one = {r["col_name"]: r for r in found.where("table_name = 't8'").collect()}
    assert one["v"]["row_count"] == 7 and one["v"]["null_count"] == 0 and len(one["half"]["sample_values"]) == 6


def test_samples_by_label_deal_no_row_out_by_its_label(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("l"), F.col("id") % 5)).alias("label"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        picked = stratified_sample(rows, "label", ["id"], 200)
        plan = picked._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
        counts = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    whole = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    assert set(counts) == set(whole) and all(abs(counts[k] - whole[k] * 200 / 3000) <= 1 for k in whole)
    digest = rows.withColumn("h", F.md5(F.col("id").cast("string")))
    same = [sorted(r["id"] for r in keep_smallest(digest, ["label"], "h", F.lit(9).cast("bigint"), few).collect()) for few in (True, False)]
    assert same[0] == same[1]


def test_many_manifests_share_files(spark, tmp_path):
    frame = spark.range(8400).select(F.concat(F.lit("t"), F.col("id") % 1200).alias("name"), "id", (F.col("id") % 3 / 7).alias("v"))
    write_many_manifests(frame, "name", ["v"], ["id"], str(tmp_path / "m"))
    assert 1 < len(list((tmp_path / "m").rglob("part-*"))) <= 3
    found = {r["table_name"]: r for r in read_manifests(spark, str(tmp_path / "m")).collect()}
    assert len(found) == 1200 and all(r["row_count"] == 7 and len(r["sample_values"]) == 6 for r in found.values())
    assert abs(found["t5"]["mean"] - round(sum((5 + 1200 * i) % 3 / 7 for i in range(7)) / 7, 4)) < 1e-9


def test_samples_of_many_tables_with_gaps_and_repeated_keys(spark):
    rows = [(f"t{i % 3}", i // 4, float(i) if i % 5 else None, None if i % 7 < 3 else i % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, key bigint, v double, w int")
    found = sample_values(df, ["v", "w"], ["key"], table=F.col("name"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(_h" in plan  # rows are cut before their cells are laid out
    got = {(r["table_name"], r["col_name"]): r["sample_values"] for r in found.collect()}
    digest = lambda key: hashlib.md5(f"42|{key}".encode()).hexdigest()
    for t in ("t0", "t1", "t2"):
        for column, place in (("v", 2), ("w", 3)):
            cells = sorted((digest(r[1]), str(r[place])) for r in rows if r[0] == t and r[place] is not None)
            assert got[t, column] == [v for _, v in cells[:10]]
