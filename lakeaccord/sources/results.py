"""Result tables: predictions per (model, combo, run) and metric summaries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_KEYS = ["model", "combo", "run"]
PREDICTION_SCHEMA = "pair_id string, pred string, model string, combo string, run int"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions written so far; none when nothing has been written.

    Filters on model, combo or run read only those folders.
    """
    try:
        return spark.read.schema(PREDICTION_SCHEMA).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], PREDICTION_SCHEMA)


def settled_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One prediction per pair, model, combo and run.

    Two writers that label the same chunk at once leave two appends; the
    prediction that comes first in text order counts, whoever wrote it.
    """
    return read_predictions(spark, path).groupBy("pair_id", *RUN_KEYS).agg(F.min("pred").alias("pred")).select("pair_id", "pred", *RUN_KEYS)


def append_predictions(predictions: DataFrame, path: str) -> None:
    """Adds predictions; pair ids are kept as text."""
    rows = predictions.select(F.col("pair_id").cast("string").alias("pair_id"), "pred", *RUN_KEYS)
    rows.write.mode("append").partitionBy(*RUN_KEYS).parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def row_of_combo(summary: DataFrame, combo: str) -> DataFrame:
    """The first summary row of one source combination."""
    return summary.filter(F.col("combo") == combo).limit(1)
