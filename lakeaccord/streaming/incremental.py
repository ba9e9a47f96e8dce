"""Labelling runs that continue where an earlier run stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import order_hash
from ..operators.evaluate import todo_pairs
from ..session import fresh_path
from ..sources.results import append_predictions, read_predictions

LabelFn = Callable[[DataFrame], DataFrame]


def chunk_of(pair_id: Column, chunks: int) -> Column:
    """The number of a pair's chunk: by a digest of its id, so it is the same in every run."""
    return F.conv(F.substring(order_hash("chunk", pair_id), 1, 8), 16, 10).cast("bigint") % chunks


def _append(todo: DataFrame, label: LabelFn, path: str, model: str, combo: str, run: int) -> int:
    labelled = label(todo).select(
        "pair_id", "pred", F.lit(model).alias("model"), F.lit(combo).alias("combo"), F.lit(run).alias("run")
    )
    written = Observation()
    append_predictions(labelled.observe(written, F.count(F.lit(1)).alias("rows")), path)
    return written.get["rows"]


def label_unseen(
    pairs: DataFrame, label: LabelFn, path: str, model: str, combo: str, run: int, chunk_rows: int | None = None
) -> int:
    """Labels the pairs this (model, combo, run) has not labelled yet and appends them.

    ``label`` maps pairs to (pair_id, pred). Files of an append show up only
    when its job commits, so a lost executor or an aborted job leaves whole
    earlier appends and no partial one; running again labels the rest. The
    number of pairs labelled now is returned; at zero no file is written.

    With ``chunk_rows`` the todo list is cut into numbered chunks of about so
    many pairs, and each is an append of its own: an abort costs one chunk, not
    the run. The list is written once, by chunk, below the shared folder, so a
    chunk reads nothing but its own pairs. A pair's chunk depends on its id and
    the number of all pairs, so a chunk that is there is never labelled again.
    """
    spark = pairs.sparkSession
    done = read_predictions(spark, path).filter(
        (F.col("model") == model) & (F.col("combo") == combo) & (F.col("run") == run)
    )
    known = pairs.withColumn("_id", F.col("pair_id").cast("string"))
    todo = todo_pairs(known, done.withColumnRenamed("pair_id", "_id"), ["_id"])
    if todo.isEmpty():  # known from ids alone: the labeller's input is not read
        return 0
    if chunk_rows is None:
        return _append(todo.drop("_id"), label, path, model, combo, run)
    chunks = max(1, -(-pairs.count() // chunk_rows))
    listed = fresh_path(spark, "todo")
    todo.withColumn("_chunk", chunk_of(F.col("pair_id"), chunks)).drop("_id").write.partitionBy("_chunk").parquet(listed)
    laid = spark.read.schema(T.StructType([*pairs.schema.fields, T.StructField("_chunk", T.LongType())])).parquet(listed)
    left = sorted(r["_chunk"] for r in laid.select("_chunk").distinct().collect())  # one number per chunk
    return sum(_append(laid.filter(F.col("_chunk") == c).drop("_chunk"), label, path, model, combo, run) for c in left)


def finished_runs(spark: SparkSession, pairs: DataFrame, path: str) -> DataFrame:
    """(model, combo, run) triples in which every pair has a prediction."""
    done = read_predictions(spark, path).select("pair_id", "model", "combo", "run")
    wanted = pairs.select(F.col("pair_id").cast("string").alias("pair_id"))
    counted = done.join(wanted, "pair_id", "left_semi").distinct().groupBy("model", "combo", "run").agg(
        F.count(F.lit(1)).alias("n")
    )
    total = wanted.distinct().agg(F.count(F.lit(1))).scalar()
    return counted.filter(F.col("n") == total).drop("n")


def open_runs(spark: SparkSession, wanted: DataFrame, pairs: DataFrame, path: str) -> DataFrame:
    """The wanted (model, combo, run) triples that are not finished."""
    return wanted.join(finished_runs(spark, pairs, path), ["model", "combo", "run"], "left_anti")


def run_factorial(
    pairs: DataFrame, label_for: Callable[[str, str, int], LabelFn], path: str,
    models: list[str], combos: list[str], runs: int = 1, chunk_rows: int | None = None,
) -> int:
    """Every model on every combination and run; finished ones cost one count each."""
    return sum(
        label_unseen(pairs, label_for(model, combo, run), path, model, combo, run, chunk_rows)
        for model in models for combo in combos for run in range(1, runs + 1)
    )
