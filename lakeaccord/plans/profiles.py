"""Column profiles of the lake tables."""

from pyspark.sql import functions as F

from ..functions.text import quoted_list
from ..operators import kept_profile as kp
from ..operators.profile import manifests, profile, profile_lake
from ..operators.sampling import MANIFEST_SAMPLE, sample_values
from ..session import fresh_path
from ..sources.catalog import read_manifests, write_many_manifests
from ..sources.lake import table, tables
from . import shards
from .schemas import NUMERIC, SCHEMAS


def _column_sql(name: str, column: str, kind: str) -> str:
    if kind in NUMERIC:
        numbers = (
            f"round(min({column})::DOUBLE, 4) AS min, round(max({column})::DOUBLE, 4) AS max, "
            f"round(avg({column}), 4) AS mean, round(stddev_samp({column}), 4) AS std"
        )
    else:
        numbers = "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std"
    return (
        f"SELECT '{name}' AS table_name, '{column}' AS col_name, count(*) AS row_count, "
        f"count(*) - count({column}) AS null_count, count(DISTINCT {column}) AS distinct_count, {numbers} FROM {name}"
    )


def _profile_sql(names) -> str:
    return "\nUNION ALL\n".join(
        _column_sql(name, column, kind) for name in names for column, kind in SCHEMAS[name].items()
    )


def profile_lineitem(spark, folder):
    return profile(table(spark, folder, "lineitem"), "lineitem")


def profile_all(spark, folder):
    return profile_lake(tables(spark, folder))


def manifest_part(spark, folder):
    part = table(spark, folder, "part")
    samples = sample_values(part, part.columns, ["p_partkey"], n=MANIFEST_SAMPLE, table="part")
    one = manifests(profile(part, "part"), samples)
    return one.select("table", F.explode("columns").alias("col_name", "s")).select(
        "table", "col_name", "s.row_count", "s.null_count", "s.distinct_count",
        quoted_list(F.col("s.sample_values")).alias("sample_values"), "s.min", "s.max", "s.mean", "s.std",
    )


def _manifest_sql() -> str:
    samples = "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS col_name, {c}::VARCHAR AS v,
        row_number() OVER (ORDER BY md5('42|' || p_partkey), {c}::VARCHAR) AS rn FROM part WHERE {c} IS NOT NULL"""
        for c in SCHEMAS["part"]
    )
    return f"""WITH p AS ({_profile_sql(["part"])}),
s AS (SELECT col_name, string_agg('"' || v || '"', ', ' ORDER BY rn) AS sample_values
      FROM ({samples}) WHERE rn <= {MANIFEST_SAMPLE} GROUP BY col_name)
SELECT p.table_name AS "table", p.col_name, row_count, null_count, distinct_count, sample_values, min, max, mean, std
FROM p JOIN s USING (col_name)"""


def shard_manifests(spark, folder):
    """Manifests of all supplier tables, written in one job and read back."""
    path = fresh_path(spark, "manifests")
    write_many_manifests(shards.shard_rows(spark, folder), "table_name", shards.COLUMNS, shards.KEY, path)
    return read_manifests(spark, path).withColumn("sampled", F.size("sample_values")).drop("sample_values")


SHARD_MANIFESTS_SQL = f"""WITH {shards.SHARD}, {shards.STATS}
SELECT *, least({MANIFEST_SAMPLE}, row_count - null_count)::INTEGER AS sampled FROM stats"""

PARTS = 3


def kept_profile(spark, folder):
    """The order lines' profile merged from the sketches of three parts, one of them written twice, beside the exact one."""
    lines = table(spark, folder, "lineitem")
    path = fresh_path(spark, "summaries")
    for part in [*range(PARTS), 0]:
        kp.keep_summary(lines.where(F.col("l_orderkey") % PARTS == part), "lineitem", f"part-{part}", path)
    merged = kp.merged_profile(kp.read_summaries(spark, path))
    exact = profile(lines, "lineitem").select("col_name", F.col("distinct_count").alias("exact"))
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * kp.DISTINCT_ERROR)
    figures = [F.round(c, 4).alias(c) for c in ("min", "max", "mean", "std")]
    inside = (F.col("quantiles")[1] >= F.col("min")) & (F.col("quantiles")[1] <= F.col("max"))
    return merged.join(exact, "col_name").select("table_name", "col_name", "row_count", "null_count", *figures, near.alias("distinct_within_error"), inside.alias("median_inside"))


KEPT_PROFILE_SQL = f"""SELECT table_name, col_name, row_count, null_count, min, max, mean, std, true AS distinct_within_error,
  CASE WHEN mean IS NOT NULL THEN true END AS median_inside FROM ({_profile_sql(["lineitem"])})"""


QUERIES = {
    "shard_manifests": (shard_manifests, SHARD_MANIFESTS_SQL),
    "kept_profile": (kept_profile, KEPT_PROFILE_SQL),
    "profile_lineitem": (profile_lineitem, _profile_sql(["lineitem"])),
    "profile_lake": (profile_all, _profile_sql(SCHEMAS)),
    "manifest_part": (manifest_part, _manifest_sql()),
}
