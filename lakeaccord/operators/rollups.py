"""Roll-ups to a coarser grain, shares, first-occurrence names and code lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_even, truncate_to_long

MONEY = "decimal(18,2)"  # for amounts that are whole cents


def _amount(name: str, as_type: str | None) -> Column:
    """The amount to add up.

    A decimal type that holds every digit of the amounts makes sums exact, and
    so independent of the order of rows; without one, numbers are added as they are.
    """
    return F.col(name).cast(as_type) if as_type else F.col(name)


def group_summary(
    df: DataFrame, keys: list[str], amount: str, count: str, total: str, average: str, as_type: str | None = None,
) -> DataFrame:
    """Rows, sum and truncated mean of an amount per group."""
    summed = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(count), F.sum(_amount(amount, as_type)).cast("double").alias(total)
    )
    return summed.withColumn(average, truncate_to_long(F.col(total) / F.col(count)))


def summary_through_key(
    facts: DataFrame, fact_key: str, amount: str, dimension: DataFrame, dimension_key: str, by: str,
    as_type: str | None = None,
) -> DataFrame:
    """Rows, sum and truncated mean per dimension attribute.

    Facts are added up per key before they are joined, so a key that holds a
    third of the facts is one row of the join.
    """
    per_key = facts.groupBy(F.col(fact_key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(_amount(amount, as_type)).alias("_sum")
    )
    joined = per_key.join(dimension.select(F.col(dimension_key).alias("_key"), by), "_key")
    summed = joined.groupBy(by).agg(
        F.sum("_n").alias("total_count"), F.sum("_sum").cast("double").alias("total_amount")
    )
    return summed.withColumn("avg_amount", truncate_to_long(F.col("total_amount") / F.col("total_count")))


def count_and_distinct(df: DataFrame, key: str, value: str, count: str, distinct: str) -> DataFrame:
    """Non-null values and different values per key; equal values meet first."""
    pairs = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy(key).agg(F.sum("_n").alias(count), F.count(F.lit(1)).alias(distinct))


def summary_with_fallback(
    entities: DataFrame, entity_key: str, capacity: str, facts: DataFrame, fact_key: str, amount: str,
    share: float = 0.78, as_type: str | None = None,
) -> DataFrame:
    """Truncated mean and count of facts per entity, and their product as the total.

    An entity without facts gets ``share`` of its capacity as mean and a zero count.
    """
    per_key = facts.groupBy(F.col(fact_key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.try_divide(F.sum(_amount(amount, as_type)).cast("double"), F.count(amount).cast("double")).alias("_mean"),
    )
    joined = entities.join(per_key, entities[entity_key] == per_key["_key"], "left")
    fallback = truncate_to_long(F.col(capacity).cast("double") * F.lit(share))
    return (
        joined.withColumn("avg_amount", F.coalesce(truncate_to_long(F.col("_mean")), fallback))
        .withColumn("fact_count", F.coalesce("_n", F.lit(0).cast("bigint")))
        .withColumn("total_amount", F.col("avg_amount") * F.col("fact_count"))
        .drop("_n", "_mean", "_key")
    )


def period_label(ts: Column, period: str) -> Column:
    """``2023-01``, ``Q1-2023``, ``2023-W01`` (ISO week) or ``2023``."""
    if period == "month":
        return F.date_format(ts, "yyyy-MM")
    if period == "quarter":
        return F.concat(F.lit("Q"), F.quarter(ts).cast("string"), F.lit("-"), F.year(ts).cast("string"))
    if period == "week":
        return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))
    if period == "year":
        return F.year(ts).cast("string")
    raise ValueError(f"no such period: {period}")


def temporal_rollup(
    df: DataFrame, keys: list[str], ts: str, amount: str, periods: list[str], as_type: str | None = None,
) -> DataFrame:
    """Sum, mean and rows per key and period, for several periods from one pass.

    Rows are added up per day first; only the daily sums are copied per period.
    """
    day = F.to_date(F.col(ts)).alias("_day")
    daily = df.groupBy(*keys, day).agg(
        F.sum(_amount(amount, as_type)).alias("_sum"), F.count(amount).alias("_n")
    )
    labels = F.array(*[
        F.struct(F.lit(p).alias("grain"), period_label(F.col("_day"), p).alias("period")) for p in periods
    ])
    return (
        daily.select(*keys, "_sum", "_n", F.inline(labels))
        .groupBy(*keys, "grain", "period")
        .agg(F.sum("_sum").cast("double").alias("sum_amount"), F.sum("_n").alias("row_count"))
        .withColumn("avg_amount", F.try_divide(F.col("sum_amount"), F.col("row_count").cast("double")))
    )


def average_per_group(
    df: DataFrame, keys: list[str], value: str, digits: int = 1, out: str = "average", as_type: str | None = None,
) -> DataFrame:
    """Mean rounded half-even on the scaled value; with an exact type, ties do not depend on row order.

    The quotient of a tie may be the double next to it, which scaling makes the tie again.
    """
    mean = F.try_divide(F.sum(_amount(value, as_type)).cast("double"), F.count(value).cast("double"))
    return df.groupBy(*keys).agg(round_half_even(mean, digits).alias(out))


def bin_label(index: Column, width: int, last: int) -> Column:
    """``0-4``, ``5-9``, ...; the last bin is open: ``85+``."""
    low = index * width
    closed = F.format_string("%d-%d", low, low + width - 1)
    return F.when(index >= last, F.format_string("%d+", low)).otherwise(closed)


def fine_bins(df: DataFrame, value: str, width: int, last: int) -> DataFrame:
    """Rows per bin of ``width``; values beyond the last bin fall into it."""
    index = F.least(F.floor(F.col(value) / width), F.lit(last)).cast("bigint")
    return df.groupBy(index.alias("bin_index")).agg(F.count(F.lit(1)).alias("population_count"))


def coarsen_bins(bins: DataFrame, factor: int = 2) -> DataFrame:
    """Adds up ``factor`` neighbouring bins; an open tail joins the last one."""
    return bins.groupBy(F.floor(F.col("bin_index") / factor).alias("bin_index")).agg(
        F.sum("population_count").alias("population_count")
    )


def percent(part: Column, whole: Column) -> Column:
    return round_half_even(F.try_divide(part, whole) * F.lit(100.0), 2)


def share_of_total(df: DataFrame, amount: str, out: str = "pct_total", within: list[str] | None = None) -> DataFrame:
    """Percent of the total, of the whole frame or of the groups ``within``."""
    if not within:
        total = df.agg(F.sum(amount)).scalar()
        return df.withColumn(out, percent(F.col(amount), total))
    # As a struct the group is never null, so that rows without a group form one too.
    rows = df.withColumn("_group", F.struct(*within))
    totals = rows.groupBy("_group").agg(F.sum(amount).alias("_total"))
    return rows.join(totals, "_group").withColumn(out, percent(F.col(amount), F.col("_total"))).drop("_total", "_group")


def unique_names(df: DataFrame, name: str, number: str, out: str, separator: str = "") -> DataFrame:
    """The second and later rows of a name get their number appended.

    The first row of each name is found by a minimum per name and matched on
    (name, number), a unique key: a name that fills the table is no hot join key.
    """
    firsts = df.groupBy(F.col(name).alias("_name")).agg(F.min(number).alias("_first")).withColumn("_is_first", F.lit(True))
    matched = df.join(
        firsts, (df[name] == firsts["_name"]) & (df[number] == firsts["_first"]), "left"
    )
    renamed = F.concat(F.col(name), F.lit(separator), F.col(number).cast("string"))
    return matched.withColumn(out, F.when(F.col("_is_first") | F.col(name).isNull(), F.col(name)).otherwise(renamed)).drop(
        "_name", "_first", "_is_first"
    )


def join_codes(df: DataFrame, column: str, codes: DataFrame, code_key: str, code: str, out: str) -> DataFrame:
    """Left join to a code table; an unmapped value gets null.

    No broadcast is forced: Spark broadcasts the code table when its size is
    below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    side = codes.select(F.col(code_key).alias("_code_key"), F.col(code).alias(out)).dropDuplicates(["_code_key"])
    return df.join(side, df[column] == side["_code_key"], "left").drop("_code_key")


def variants(df: DataFrame, columns: dict[str, list[str]], renames: dict[str, dict[str, str]] | None = None) -> dict[str, DataFrame]:
    """Several narrow tables from one wide one, with columns renamed per table."""
    renames = renames or {}
    return {
        name: df.select(*picked).withColumnsRenamed(renames.get(name, {})) for name, picked in columns.items()
    }
