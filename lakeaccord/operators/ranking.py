"""Exact ranks without one-task windows.

A window over a whole table, or over a label that a third of all rows carry,
would sort that group in one task. Here the order is cut into buckets first:
rows are counted per bucket (a map-side aggregate), the counts are summed up
over the few buckets, and only rows of one bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket

RANGE_BUCKETS = 1024       # quantiles fetched to the driver
CELL_PARTS = 64            # equal widths between two quantiles
ROWS_PER_BUCKET = 1_000_000


def _with_group(df: DataFrame, group: list[str]) -> DataFrame:
    """Adds the group as one struct: never null, so a null label is a group too.

    Joins and windows then name the same two keys, and share one shuffle.
    """
    return df.withColumn("_group", F.struct(*group) if group else F.struct(F.lit(0).alias("all")))


def _bucket_starts(rows: DataFrame, weight: Column) -> DataFrame:
    """Per group and bucket the rows before it, and the rows of the group.

    The windows run over at most one row per bucket of a group.
    """
    sizes = rows.groupBy("_group", "_bucket").agg(weight.cast("bigint").alias("_in"))
    whole = W.partitionBy("_group")
    before = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(
        "_group", "_bucket", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"),
        F.sum("_in").over(whole).alias("_group_rows"),
    )


def _ranked(rows: DataFrame, starts: DataFrame, order: str, out: str) -> DataFrame:
    """Row number within the group: rows of earlier buckets plus the place in the own one."""
    inside = W.partitionBy("_group", "_bucket").orderBy(order)
    return rows.join(starts, ["_group", "_bucket"]).withColumn(out, F.col("_before") + F.row_number().over(inside))


_HELPERS = ["_group", "_bucket", "_before", "_group_rows"]


def rank_by_hash(
    df: DataFrame, group: list[str], digest: str, out: str = "rank", group_rows: str | None = None
) -> DataFrame:
    """``row_number() over (partition by group order by digest)``, exactly.

    ``digest`` is a unique :func:`order_hash` column: its leading digits split
    every group, hot or not, into equal buckets. ``group_rows`` names a column
    for the size of the group.
    """
    rows = _with_group(df, group).withColumn("_bucket", hash_bucket(F.col(digest)))
    ranked = _ranked(rows, _bucket_starts(rows, F.count(F.lit(1))), digest, out)
    if group_rows:
        ranked = ranked.withColumn(group_rows, F.col("_group_rows"))
    return ranked.drop(*_HELPERS)


def keep_smallest(df: DataFrame, group: list[str], digest: str, quota: Column, few_groups: bool = False) -> DataFrame:
    """The ``quota`` rows of each group that come first in digest order.

    ``quota`` may use ``_group_rows``, the size of the group. Per group one row
    says in which bucket the quota is reached; rows of later buckets go no
    further, and only the kept ones are shuffled and, in that bucket, ranked.
    With ``few_groups``, as labels are, these rows of groups are one scalar map
    that every task looks its rows up in: no row is dealt out by its group, so
    a group of a third of all rows is no large key. Otherwise they are joined.
    """
    rows = _with_group(df, group).withColumn("_bucket", hash_bucket(F.col(digest)))
    filled = _bucket_starts(rows, F.count(F.lit(1))).withColumn("_left", quota - F.col("_before")).filter(F.col("_left") > 0)
    edge = F.max(F.struct("_bucket", "_left")).alias("_edge")
    if group and few_groups:
        edges = filled.groupBy("_group").agg(edge).agg(F.map_from_entries(F.collect_list(F.struct("_group", "_edge")))).scalar()
        limited = rows.withColumn("_edge", F.element_at(edges, F.col("_group")))
    elif group:
        limited = rows.join(filled.groupBy("_group").agg(edge), "_group")
    else:
        limited = rows.withColumn("_edge", filled.agg(edge).scalar())
    inside = W.partitionBy("_group", "_bucket").orderBy(digest)
    kept = (
        limited.filter(F.col("_bucket") <= F.col("_edge._bucket"))
        .withColumn("_rank", F.row_number().over(inside))
        .filter((F.col("_bucket") < F.col("_edge._bucket")) | (F.col("_rank") <= F.col("_edge._left")))
    )
    return kept.drop("_edge", "_rank", *_HELPERS)


def _range_bounds(df: DataFrame, key: str, rows_per_bucket: int) -> list[float]:
    """At most ``RANGE_BUCKETS`` + 1 quantiles of the key, lowest to highest.

    They are fetched once, so that every use of a bucket in a plan, and every
    repetition of a lost task, sees the same ones. They come from a sketch:
    ranks are exact for any bounds, only the sizes of the buckets depend on it.
    """
    rows = df.select(F.col(key).cast("double").alias("k")).filter(F.abs("k") < float("inf"))
    buckets = min(RANGE_BUCKETS, 1 + rows.count() // rows_per_bucket)
    shares = [i / buckets for i in range(buckets + 1)]
    found = rows.approxQuantile("k", shares, 0.1 / buckets)
    # Any bounds do; with two of them no bucket is a constant, and joins keep their keys.
    bounds = sorted(set(found)) or [0.0]
    return bounds if len(bounds) > 1 else bounds * 2


def _with_range_bucket(rows: DataFrame, key: str, bounds: list[float]) -> DataFrame:
    """Adds the place of the key among the bounds, and within them.

    The place is found by binary search; the cell between two bounds is cut
    into ``CELL_PARTS`` equal widths. Equal keys share a bucket and buckets are
    in key order.
    """
    literal = "array(" + ", ".join(f"{b!r}D" for b in bounds) + ")"
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    value = f"CAST(`{key}` AS DOUBLE)"
    found = rows.withColumn("_cell", F.expr(
        f"aggregate(array({', '.join(map(str, steps))}), 0, (at, step) -> "
        f"IF(at + step <= {len(bounds)} AND get({literal}, at + step - 1) <= {value}, at + step, at))"
    ))
    low, high = f"get({literal}, _cell - 1)", f"get({literal}, _cell)"
    part = f"coalesce(least({CELL_PARTS - 1}, CAST(({value} - {low}) / ({high} - {low}) * {CELL_PARTS} AS INT)), 0)"
    return _with_group(found, []).withColumn("_bucket", F.expr(f"_cell * {CELL_PARTS} + {part}")).drop("_cell")


def row_numbers(df: DataFrame, key: str, out: str = "row_number", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``row_number() over (order by key)`` for a unique numeric key.

    A first small job finds the bounds of the key ranges. Rows are then counted
    per range from the key column alone and shuffled once, by range.
    """
    rows = _with_range_bucket(df, key, _range_bounds(df, key, rows_per_bucket))
    return _ranked(rows, _bucket_starts(rows, F.count(F.lit(1))), key, out).drop(*_HELPERS)


def rank_with_ties(df: DataFrame, value: str, out: str = "rank", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``rank() over (order by value desc)`` for a numeric value.

    Equal values are counted before anything is sorted, so a value that fills a
    third of the table is one row of the ranking. NaN ranks above all numbers.
    Rows without a value stay, with a null rank.
    """
    # NaN shares the range of the highest values; inside a range the value itself decides.
    key = F.when(F.isnan(value), float("-inf")).otherwise(-F.col(value))
    present = df.filter(F.col(value).isNotNull())
    counted = present.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    bounds = _range_bounds(present.select(key.alias("_key")), "_key", rows_per_bucket)
    falling = _with_range_bucket(counted.withColumn("_key", key), "_key", bounds)
    starts = _bucket_starts(falling, F.sum("_n"))
    inside = W.partitionBy("_group", "_bucket").orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, -1)
    ranked = falling.join(starts, ["_group", "_bucket"]).select(
        F.col(value).alias("_value"),
        (F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + 1).alias(out),
    )
    return df.join(ranked, df[value] == ranked["_value"], "left").drop("_value")


def running_total(df: DataFrame, key: str, amount: str, out: str = "before", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``coalesce(sum(amount) over (order by key rows before this one), 0)`` for a unique numeric key."""
    rows = _with_range_bucket(df, key, _range_bounds(df, key, rows_per_bucket))
    inside = W.partitionBy("_group", "_bucket").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(_bucket_starts(rows, F.sum(amount)), ["_group", "_bucket"])
    return placed.withColumn(out, F.col("_before") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop(*_HELPERS)
