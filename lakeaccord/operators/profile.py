"""Column profiles: counts, distinct counts and moments of every column of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import compact

PROFILE_COLUMNS = [
    "table_name", "col_name", "row_count", "null_count", "distinct_count", "min", "max", "mean", "std",
]


def is_numeric(data_type: T.DataType) -> bool:
    """Booleans count as numbers, as in the profiles this library reproduces."""
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def present(df: DataFrame, name: str) -> str:
    """The column as SQL, with NaN read as missing."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return f"nanvl(`{name}`, NULL)"
    return f"`{name}`"


def _as_double(df: DataFrame, name: str) -> str:
    value = present(df, name)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        value = f"CAST({value} AS INT)"
    return f"CAST({value} AS DOUBLE)"


def _moments(df: DataFrame, columns: list[str], group: list[str], approx: bool, exact: dict[str, str] | None = None) -> DataFrame:
    """One aggregate over all columns, no rows multiplied; then one row per column."""
    exact = exact or {}
    aggregates = ["count(1) AS _rows"]
    cells = []
    for i, name in enumerate(columns):
        data_type = df.schema[name].dataType
        aggregates.append(f"count({present(df, name)}) AS _n{i}")
        cell = [f"'{name}' AS col_name", "_rows AS row_count", f"_rows - _n{i} AS null_count"]
        if approx:
            nested = isinstance(data_type, (T.ArrayType, T.StructType))
            shown = f"CAST(`{name}` AS STRING)" if nested else present(df, name)
            aggregates.append(f"approx_count_distinct({shown}) AS _d{i}")
            cell.append(f"_d{i} AS distinct_count")
        functions = {"min": "min", "max": "max", "mean": "avg", "std": "stddev_samp"}
        for part, function in functions.items():
            if is_numeric(data_type):
                figure = f"{function}({_as_double(df, name)})"
                if part == "mean" and name in exact:
                    figure = f"try_divide(CAST(sum(CAST({present(df, name)} AS {exact[name]})) AS DOUBLE), count({present(df, name)}))"
                aggregates.append(f"{figure} AS _{part}{i}")
                cell.append(f"round(_{part}{i}, 4) AS {part}")
            else:
                cell.append(f"CAST(NULL AS DOUBLE) AS {part}")
        cells.append(f"struct({', '.join(cell)})")
    one_row = df.groupBy(*group).agg(*[F.expr(a) for a in aggregates])
    return one_row.selectExpr(*group, f"inline(array({', '.join(cells)}))")


def _type_classes(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    classes: dict[str, list[str]] = {}
    for name in columns:
        data_type = df.schema[name].dataType
        if isinstance(data_type, (T.IntegralType, T.BooleanType)):
            as_type = "bigint"
        elif isinstance(data_type, (T.DoubleType, T.FloatType)):
            as_type = "double"
        elif isinstance(data_type, T.TimestampType):
            as_type = "timestamp"
        else:
            as_type = "string"
        classes.setdefault(as_type, []).append(name)
    return classes


def _values(df: DataFrame, columns: list[str], keep: list[str]) -> dict[str, DataFrame]:
    """Columns of one type laid under each other as (col_name, value), per type."""
    out = {}
    for as_type, names in _type_classes(df, columns).items():
        cast = {n: f"CAST({present(df, n)} AS {as_type})" for n in names}
        if as_type == "timestamp":  # instants, not their text in the session's zone
            cast = {n: f"unix_micros(`{n}`)" for n in names}
        shown = {n: compact(v) if as_type == "string" else v for n, v in cast.items()}
        cells = ", ".join(f"struct('{n}' AS col_name, {v} AS value)" for n, v in shown.items())
        out[as_type] = df.selectExpr(*keep, f"inline(array({cells}))")
    return out


def _count_distinct(values: list[dict[str, DataFrame]], key: list[str]) -> DataFrame:
    """Exact distinct counts: equal values meet before they are counted.

    A scan reads only the columns of its type, and the shuffle holds narrow
    (column, value) rows that each task has already made distinct, so a value
    that fills a column arrives once per task; a long text is a digest there.
    All tables share one shuffle.
    """
    parts = []
    for as_type in sorted({t for per_type in values for t in per_type}):
        laid = reduce(DataFrame.unionByName, [per_type[as_type] for per_type in values if as_type in per_type])
        parts.append(laid.distinct().groupBy(*key).agg(F.expr("count(value) AS distinct_count")))
    return reduce(DataFrame.unionByName, parts)


def _with_distincts(stats: DataFrame, exact: DataFrame, key: list[str]) -> DataFrame:
    """Rows per column only: an empty table has no distinct rows and counts zero."""
    return stats.join(exact, key, "left").withColumn("distinct_count", F.expr("coalesce(distinct_count, 0L)"))


def profile(
    df: DataFrame,
    table: str | None = None,
    columns: list[str] | None = None,
    group: str | None = None,
    approx_distinct: bool = False,
    exact: dict[str, str] | None = None,
) -> DataFrame:
    """Profile rows of one table, or of each table named in the ``group`` column.

    ``approx_distinct`` answers in a single scan without a shuffle of values.
    ``exact`` names columns whose values a decimal type holds in every digit:
    their means are of exact sums, and so do not depend on the order of rows.
    """
    columns = columns or [c for c in df.columns if c != group]
    keys = [group] if group else []
    stats = _moments(df, columns, keys, approx_distinct, exact)
    if not approx_distinct:
        key = [*keys, "col_name"]
        stats = _with_distincts(stats, _count_distinct([_values(df, columns, keys)], key), key)
    name = F.col(group) if group else F.lit(table)
    return stats.withColumn("table_name", name).select(*PROFILE_COLUMNS)


def profile_lake(tables: dict[str, DataFrame], approx_distinct: bool = False) -> DataFrame:
    """Profiles of many tables under each other, distinct counts joined once for all."""
    if approx_distinct:
        parts = [profile(df, name, approx_distinct=True) for name, df in tables.items()]
        return reduce(DataFrame.unionByName, parts)
    key = ["table_name", "col_name"]
    stats, values = [], []
    for name, df in tables.items():
        stats.append(_moments(df, df.columns, [], False).select(F.lit(name).alias("table_name"), "*"))
        values.append(_values(df, df.columns, [f"'{name}' AS table_name"]))
    exact = _count_distinct(values, key)
    return _with_distincts(reduce(DataFrame.unionByName, stats), exact, key).select(*PROFILE_COLUMNS)


def manifests(stats: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per table: its name and a map from column to statistics with samples.

    A map holds the columns of one table, so its size is that of the schema.
    """
    cell = F.struct(
        "row_count", "null_count", "distinct_count",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        "min", "max", "mean", "std",
    )
    joined = stats.join(samples, ["table_name", "col_name"], "left")
    return joined.groupBy(F.col("table_name").alias("table")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("col_name"), cell)))).alias("columns")
    )
