import pytest
from pyspark.sql import functions as F

from lakeaccord.sources.results import append_predictions, read_predictions, settled_predictions
from lakeaccord.streaming.incremental import chunk_of, finished_runs, label_unseen, open_runs, run_factorial


def labeller(answer):
    return lambda pairs: pairs.select("pair_id", F.lit(answer).alias("pred"))


def test_only_unseen_pairs_are_labelled(spark, tmp_path):
    path = str(tmp_path / "p")
    pairs = spark.range(10).select(F.col("id").alias("pair_id"))
    assert label_unseen(pairs.limit(4), labeller("first"), path, "m", "D", 1) == 4
    assert finished_runs(spark, pairs, path).count() == 0
    assert label_unseen(pairs, labeller("second"), path, "m", "D", 1) == 6
    assert label_unseen(pairs, labeller("third"), path, "m", "D", 1) == 0
    counts = {r["pred"]: r["count"] for r in read_predictions(spark, path).groupBy("pred").count().collect()}
    assert counts == {"first": 4, "second": 6}
    assert finished_runs(spark, pairs, path).count() == 1


def test_a_failed_append_leaves_nothing_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "p")
    pairs = spark.range(10).select(F.col("id").alias("pair_id"))

    def broken(todo):
        fails = F.when(F.col("pair_id") == 7, F.raise_error(F.lit("down"))).otherwise(F.lit("x"))
        return todo.select("pair_id", fails.cast("string").alias("pred"))

    label_unseen(pairs.filter("pair_id < 3"), labeller("a"), path, "m", "D", 1)
    with pytest.raises(Exception, match="down"):
        label_unseen(pairs, broken, path, "m", "D", 1)
    assert read_predictions(spark, path).count() == 3
    assert label_unseen(pairs, labeller("b"), path, "m", "D", 1) == 7
    assert read_predictions(spark, path).select("pair_id").distinct().count() == 10


def test_factorial_skips_finished_runs(spark, tmp_path):
    path = str(tmp_path / "p")
    pairs = spark.range(5).select(F.col("id").alias("pair_id"))
    label_for = lambda model, combo, run: labeller(f"{model}-{combo}-{run}")
    assert run_factorial(pairs, label_for, path, ["m"], ["D", "L"], runs=2) == 20
    assert run_factorial(pairs, label_for, path, ["m", "n"], ["D", "L"], runs=2) == 20
    wanted = spark.createDataFrame([("m", "D", 1), ("n", "L", 2), ("n", "S", 1)], "model string, combo string, run int")
    assert [tuple(r) for r in open_runs(spark, wanted, pairs, path).collect()] == [("n", "S", 1)]


def test_a_run_that_fails_in_its_third_chunk_keeps_the_first_two(spark, tmp_path):
    path = str(tmp_path / "p")
    pairs = spark.range(200).select(F.col("id").alias("pair_id"), F.lit("x").alias("_id"), F.lit(7).alias("chunk"))
    asked = []

    def broken(todo):
        asked.append(todo.count())
        if len(asked) == 3:
            return todo.select("pair_id", F.raise_error(F.lit("down")).cast("string").alias("pred"))
        return labeller("early")(todo)

    with pytest.raises(Exception, match="down"):
        label_unseen(pairs, broken, path, "m", "D", 1, chunk_rows=40)
    kept = {r["pair_id"] for r in read_predictions(spark, path).collect()}
    assert len(asked) == 3 and 0 < len(kept) == asked[0] + asked[1] < 200
    assert kept == {str(r["pair_id"]) for r in pairs.where(chunk_of(F.col("pair_id"), 5) < 2).collect()}
    again = []
    counting = lambda todo: again.append(todo.count()) or labeller("late")(todo)
    assert label_unseen(pairs, counting, path, "m", "D", 1, chunk_rows=40) == 200 - len(kept)
    assert len(again) == 3 and again[0] == asked[2]
    assert label_unseen(pairs, counting, path, "m", "D", 1, chunk_rows=40) == 0 and len(again) == 3
    counts = {r["pred"]: r["count"] for r in read_predictions(spark, path).groupBy("pred").count().collect()}
    assert counts == {"early": len(kept), "late": 200 - len(kept)}


def test_two_writers_leave_one_prediction_per_pair(spark, tmp_path):
    path = str(tmp_path / "p")
    pairs = spark.range(20).select(F.col("id").alias("pair_id"))
    for answer in ("b", "a", "a"):
        rows = pairs.select("pair_id", F.lit(answer).alias("pred"), F.lit("m").alias("model"), F.lit("D").alias("combo"), F.lit(1).alias("run"))
        append_predictions(rows, path)
    assert read_predictions(spark, path).count() == 60
    assert [(r["pred"], r["count"]) for r in settled_predictions(spark, path).groupBy("pred").count().collect()] == [("a", 20)]
    assert label_unseen(pairs, labeller("c"), path, "m", "D", 1, chunk_rows=5) == 0


def test_a_finished_run_does_not_read_the_labellers_input(spark, tmp_path):
    path = str(tmp_path / "p")
    pairs = spark.range(10).select(F.col("id").alias("pair_id"))
    assert label_unseen(pairs, labeller("a"), path, "m", "D", 1) == 10
    calls = []
    assert label_unseen(pairs, lambda todo: calls.append(1) or labeller("b")(todo), path, "m", "D", 1) == 0
    assert label_unseen(pairs, lambda todo: calls.append(1) or labeller("b")(todo), path, "m", "D", 1, chunk_rows=3) == 0 and not calls
