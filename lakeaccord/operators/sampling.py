"""Exact-size samples, strata, folds and group-wise picks, all in seeded hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import BUCKET_DIGITS, LAST_BUCKET, order_hash
from ..functions.text import as_text
from .profile import present
from .ranking import keep_smallest, rank_by_hash

SEED = 42
EVIDENCE_SAMPLE = 10
MANIFEST_SAMPLE = 6


def _cells(df: DataFrame, columns: list[str], keep: dict[str, Column]) -> Column:
    """One (column, text value) struct per column; a cell outside ``keep`` is null."""
    return F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("col_name"),
            F.when(keep[name], as_text(F.col(name), df.schema[name].dataType)).alias("value"),
        )
        for name in columns
    ]))


def _cutoffs(hashed: DataFrame, columns: list[str], n: int) -> DataFrame:
    """For each column the digest prefix in which its n-th value lies.

    A column with fewer than ``n`` values keeps all its rows. The window runs
    over at most one row per prefix.
    """
    counts = hashed.groupBy("_bucket").agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)])
    upto = W.partitionBy().orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = counts.select("_bucket", *[F.sum(f"_n{i}").over(upto).alias(f"_n{i}") for i in range(len(columns))])
    firsts = [
        F.coalesce(F.min(F.when(F.col(f"_n{i}") >= n, F.col("_bucket"))), F.lit(LAST_BUCKET)) for i in range(len(columns))
    ]
    return summed.agg(F.array(*firsts).alias("_cut"))


def sample_values(
    df: DataFrame,
    columns: list[str],
    key: list[str],
    n: int = EVIDENCE_SAMPLE,
    seed: int = SEED,
    table: Column | str | None = None,
) -> DataFrame:
    """Up to ``n`` values per (table, column) that are neither null nor NaN, without replacement.

    ``table`` is a name, or a column when one frame holds many tables. Of one
    table a first pass counts values per digest prefix, so that the second only
    writes out and sorts the cells that can be among the first ``n``. Of many
    tables rows are cut first: rows with values in the same columns have their
    cells in the same order, so only the first ``n`` of them are written out.
    Ranking to a constant is cut to ``n`` rows on the map side of the shuffle.
    """
    df = df.withColumns({c: F.expr(present(df, c)) for c in columns})
    many = not isinstance(table, str)
    name = table if many else F.lit(table)
    digest = order_hash(seed, *[F.col(k) for k in key])
    hashed = df.select(*columns, name.alias("table_name"), digest.alias("_h")).withColumn(
        "_bucket", F.substring("_h", 1, BUCKET_DIGITS)
    )
    if many:  # no row is shuffled by its table: the window's limit already cuts on the map side
        # The number before the name tells rows of different tables apart in their first eight bytes when they are sorted.
        alike = F.concat(*[F.when(F.col(c).isNotNull(), "1").otherwise("0") for c in columns])
        first = W.partitionBy(F.xxhash64("table_name"), "table_name", alike).orderBy("_h")
        limited = hashed.withColumn("_place", F.rank().over(first)).filter(F.col("_place") <= n).drop("_place")
        keep = {c: F.lit(True) for c in columns}
    else:
        cut = _cutoffs(hashed, columns, n)
        limited = hashed.withColumn("_cut", cut.scalar()).filter(F.col("_bucket") <= F.array_max("_cut"))
        keep = {c: F.col("_bucket") <= F.get("_cut", i) for i, c in enumerate(columns)}
    ordered = W.partitionBy("table_name", "col_name").orderBy("_h", "value")
    picked = (
        limited.select("table_name", "_h", _cells(df, columns, keep))
        .filter(F.col("value").isNotNull())
        .withColumn("_rank", F.row_number().over(ordered))
        .filter(F.col("_rank") <= n)
    )
    return picked.groupBy("table_name", "col_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_rank", "value"))), lambda cell: cell["value"]
        ).alias("sample_values")
    )


def stratified_sample(df: DataFrame, label: str, key: list[str], n: int, seed: int = SEED) -> DataFrame:
    """About ``n`` rows with the label shares of the whole; never more than ``n``.

    Each label gives ``max(1, round(rows * n / total))`` rows, half-even.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    share = F.bround(F.col("_group_rows") * F.lit(float(n)) / total, 0).cast("bigint")
    keys = [F.col(k) for k in key]
    hashed = df.withColumn("_pick", order_hash(seed, *keys))
    picked = keep_smallest(hashed, [label], "_pick", F.greatest(F.lit(1).cast("bigint"), share), few_groups=True)
    mixed = picked.withColumn("_mix", order_hash(f"{seed}-mix", *keys))
    return keep_smallest(mixed, [], "_mix", F.lit(n).cast("bigint")).drop("_pick", "_mix")


def stratified_folds(df: DataFrame, label: str, key: list[str], k: int = 5, seed: int = SEED) -> DataFrame:
    """Adds ``fold`` 0..k-1; fold sizes differ by at most one within a label."""
    hashed = df.withColumn("_pick", order_hash(seed, *[F.col(c) for c in key]))
    ranked = rank_by_hash(hashed, [label], "_pick", "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_pick", "_rank")


def pick_from_pool(
    df: DataFrame, key: str, pool: DataFrame, value: str, low: int, high: int, seed: int = SEED,
) -> DataFrame:
    """``low``..``high`` different pool values per row, one output row per value.

    Each row draws distinct places in the pool from hashes of its key: the k-th
    draw is among the places up to ``size - wanted + k``, and a place that is
    already taken is replaced by the last of them, which cannot be taken yet.
    The places, not the pool, are then joined, evenly over the pool.
    """
    named = pool.select(F.col(value).alias("picked")).filter(F.col("picked").isNotNull()).distinct()
    numbered = rank_by_hash(named.withColumn("_h", order_hash("pool", F.col("picked"))), [], "_h", "_place").drop("_h")
    size = named.agg(F.count(F.lit(1))).scalar()
    text = f"concat_ws('|', '{seed}', CAST(`{key}` AS STRING)"
    number = lambda digest: f"CAST(conv(substring({digest}, 1, 8), 16, 10) AS BIGINT)"
    drawn = df.withColumn("_size", size).withColumn("_wanted", F.expr(
        f"least(_size, {low} + {number(f'md5({text}))')} % {high - low + 1})"
    ))
    last = "(_size - _wanted + k)"
    draw = f"({number(f'md5({text}, CAST(k AS STRING)))')} % {last} + 1)"
    places = F.expr(
        f"aggregate(sequence(1L, _wanted), CAST(array() AS ARRAY<BIGINT>), (taken, k) -> "
        f"array_append(taken, IF(array_contains(taken, {draw}), {last}, {draw})))"
    )
    exploded = drawn.filter(F.col("_wanted") > 0).select(*df.columns, F.explode(places).alias("_place"))
    return exploded.join(numbered, "_place").select(*df.columns, "picked")
