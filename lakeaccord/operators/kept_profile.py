"""Column profiles that are kept as sketches per part of a table and merged when they are read.

A part is whatever arrives at once: a day's files, a batch. Its summary holds
exact counts and moments and three mergeable sketches; a table's profile is
the merge of its parts' summaries, so an append reads the new part only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import compact
from .profile import is_numeric

#: Sizes of the sketches: distinct counts are within 1 % in two of three cases, ranks within 1 %.
HLL, KLL, THETA = 13, 400, 12
DISTINCT_ERROR, RANK_ERROR = 0.03, 0.02

SUMMARY = (
    "table_name string, part string, col_name string, row_count bigint, value_count bigint, low double, high double, "
    "mean double, squares double, distinct_sketch binary, rank_sketch binary, value_sketch binary"
)


def summarize(df: DataFrame, table: str, part: str) -> DataFrame:
    """One row of :data:`SUMMARY` per column, in one scan with map-side merging. NaN and null are missing values."""
    columns = []
    for name in df.columns:
        quoted = F.col(f"`{name}`")
        if is_numeric(df.schema[name].dataType):
            number = F.when(~F.isnan(quoted.cast("double")), quoted.cast("double"))
            value = number.cast("string")
        else:
            number, value = F.lit(None).cast("double"), F.expr(compact(f"CAST(`{name}` AS STRING)"))
        columns.append(F.struct(F.lit(name).alias("col_name"), number.alias("number"), value.alias("value")))
    found = df.select(F.inline(F.array(*columns))).groupBy("col_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("value").alias("value_count"), F.min("number").alias("low"), F.max("number").alias("high"),
        F.avg("number").alias("mean"), (F.var_pop("number") * F.count("number")).alias("squares"),
        F.hll_sketch_agg("value", F.lit(HLL)).alias("distinct_sketch"), F.kll_sketch_agg_double("number", F.lit(KLL)).alias("rank_sketch"),
        F.theta_sketch_agg("value", F.lit(THETA)).alias("value_sketch"),
    )
    return found.select(F.lit(table).alias("table_name"), F.lit(part).alias("part"), "*")


def keep_summary(df: DataFrame, table: str, part: str, path: str) -> None:
    """Writes the summary of one part; a part that is written again takes the place of its former summary."""
    rows = summarize(df, table, part)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_name", "part").parquet(path)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """All kept summaries; none when nothing has been written."""
    try:
        return spark.read.schema(SUMMARY).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], SUMMARY)


def merged_profile(summaries: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(table_name, col_name, row_count, null_count, distinct_count, min, max, mean, std, quantiles) from the summaries alone.

    Counts, extremes, mean and deviation are those of all rows; the distinct
    count and the quantiles have the errors of their sketches. A table of a
    million parts is merged on the map side first.
    """
    n, known = F.col("value_count"), F.col("mean").isNotNull()
    weight = F.when(known, n).otherwise(0)
    total = F.sum(weight)
    mean = F.try_divide(F.sum(F.col("mean") * weight), total)
    merged = summaries.groupBy("table_name", "col_name").agg(
        F.sum("row_count").alias("row_count"), F.sum(F.col("row_count") - n).alias("null_count"), F.min("low").alias("min"), F.max("high").alias("max"),
        mean.alias("mean"), F.sum("squares").alias("_within"), total.alias("_n"), F.sum(F.col("mean") * F.col("mean") * weight).alias("_raw"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_count"), F.kll_merge_agg_double("rank_sketch").alias("_ranks"),
    )
    between = F.greatest(F.lit(0.0), F.col("_raw") - F.col("_n") * F.col("mean") * F.col("mean"))
    std = F.when(F.col("_n") > 1, F.sqrt((F.col("_within") + between) / (F.col("_n") - 1)))
    at = F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_ranks", F.array(*[F.lit(q) for q in quantiles])))
    return merged.select("table_name", "col_name", "row_count", "null_count", "distinct_count", "min", "max", "mean", std.alias("std"), at.alias("quantiles"))


def shared_values(summaries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(table_a, col_a, table_b, col_b, distinct_a, distinct_b, both, jaccard) of column pairs, from kept sketches without reading a table."""
    merged = summaries.groupBy("table_name", "col_name").agg(F.theta_union_agg("value_sketch").alias("s"))
    side = lambda k: merged.select(F.col("table_name").alias(f"table_{k}"), F.col("col_name").alias(f"col_{k}"), F.col("s").alias(f"s_{k}"))
    met = reduce(lambda df, k: df.join(side(k), [f"table_{k}", f"col_{k}"]), "ab", pairs.select("table_a", "col_a", "table_b", "col_b"))
    count = F.theta_sketch_estimate
    return met.select(
        "table_a", "col_a", "table_b", "col_b", count("s_a").alias("distinct_a"), count("s_b").alias("distinct_b"), count(F.theta_intersection("s_a", "s_b")).alias("both"),
        F.try_divide(count(F.theta_intersection("s_a", "s_b")).cast("double"), count(F.theta_union("s_a", "s_b")).cast("double")).alias("jaccard"),
    )
