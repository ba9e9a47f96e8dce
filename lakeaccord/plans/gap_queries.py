"""Profiles, samples, shares and ranks of a table with missing values, not-a-numbers and an empty column."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quoted_list, round_half_even
from ..operators.evidence import DASH, NO_DATA, values_block
from ..operators.profile import profile
from ..operators.ranking import rank_with_ties
from ..operators.rollups import share_of_total
from ..operators.sampling import EVIDENCE_SAMPLE, sample_values
from ..sources.lake import table
from .profiles import _column_sql

COLUMNS = {"balance": "double", "segment": "string", "nation": "int", "never": "double"}


def gapped(spark, folder) -> DataFrame:
    """Customers: every seventh lacks its balance, every eleventh has none that is a number, every fifth no segment."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, folder, "customer").select(
        key.alias("key"),
        F.when(key % 7 == 0, None).when(key % 11 == 0, float("nan")).otherwise(balance).alias("balance"),
        F.when(key % 5 != 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"),
        F.lit(None).cast("double").alias("never"),
    )


GAPPED = """gapped AS (SELECT c_custkey AS key,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'nan'::DOUBLE ELSE c_acctbal END AS balance,
  CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment, c_nationkey AS nation, NULL::DOUBLE AS never FROM customer)"""
#: A value that is no number counts as missing in profiles and samples.
PRESENT = "present AS (SELECT key, CASE WHEN NOT isnan(balance) THEN balance END AS balance, segment, nation, never FROM gapped)"


def profile_with_gaps(spark, folder):
    return profile(gapped(spark, folder).select(*COLUMNS), "present")


PROFILE_SQL = f"WITH {GAPPED}, {PRESENT}\n" + "\nUNION ALL\n".join(_column_sql("present", c, kind) for c, kind in COLUMNS.items())


def sample_with_gaps(spark, folder):
    """Samples of every column in the wording of the evidence; a column without values says so."""
    sampled = sample_values(gapped(spark, folder), list(COLUMNS), ["key"], table="gapped")
    every = spark.range(1).select(F.lit("gapped").alias("table_name"), F.explode(F.array(*[F.lit(c) for c in COLUMNS])).alias("col_name"))
    block = values_block(F.col("table_name"), F.col("col_name"), F.col("sample_values"))
    return every.join(sampled, ["table_name", "col_name"], "left").select("col_name", F.size("sample_values").alias("sampled"), block.alias("block"))


def _sample_sql() -> str:
    cells = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS col_name, {c}::VARCHAR AS v, row_number() OVER (ORDER BY md5('42|' || key), {c}::VARCHAR) AS rn FROM present WHERE {c} IS NOT NULL"
        for c in COLUMNS
    )
    names = ", ".join(f"'{c}'" for c in COLUMNS)
    return f"""WITH {GAPPED}, {PRESENT}, cells AS ({cells}),
texts AS (SELECT col_name, count(*) AS n, string_agg('"' || v || '"', ', ' ORDER BY rn) AS shown FROM cells WHERE rn <= {EVIDENCE_SAMPLE} GROUP BY col_name)
SELECT col_name, n::INTEGER AS sampled, '  gapped.' || col_name || ' {DASH} sample values: [' || coalesce(shown, '{NO_DATA}') || ']' AS block
FROM (SELECT unnest([{names}]) AS col_name) LEFT JOIN texts USING (col_name)"""


def shares_with_gaps(spark, folder):
    """Shares of customers by nation within segments; the missing segment is one too, and every sixth nation has no count."""
    counted = gapped(spark, folder).groupBy("segment", "nation").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("n", F.when(F.col("nation") % 6 != 0, F.col("n")))
    return share_of_total(share_of_total(counted, "n"), "n", "pct_segment", ["segment"])


SHARES_SQL = f"""WITH {GAPPED}, counted AS (
  SELECT segment, nation, CASE WHEN nation % 6 <> 0 THEN count(*) END AS n FROM gapped GROUP BY segment, nation)
SELECT *, round_even(n::DOUBLE / sum(n) OVER () * 100.0::DOUBLE, 2) AS pct_total,
  round_even(n::DOUBLE / sum(n) OVER (PARTITION BY segment) * 100.0::DOUBLE, 2) AS pct_segment FROM counted"""


def rank_with_gaps(spark, folder):
    """Ranks by falling balance: what is no number comes first, what is missing has no rank."""
    rows = gapped(spark, folder).select("key", "balance")
    n = rows.agg(F.count("balance")).scalar()
    ranked = rank_with_ties(rows, "balance", "balance_rank")
    share = round_half_even((n + 1 - F.col("balance_rank")) / n, 2)
    return ranked.select("key", F.isnan("balance").alias("no_number"), "balance_rank", share.alias("rank_percentile"))


RANK_SQL = f"""WITH {GAPPED}, ranked AS (SELECT key, balance, count(balance) OVER () AS n,
  CASE WHEN balance IS NOT NULL THEN rank() OVER (ORDER BY balance DESC NULLS LAST) END AS balance_rank FROM gapped)
SELECT key, coalesce(isnan(balance), false) AS no_number, balance_rank,
  round_even((n + 1 - balance_rank)::DOUBLE / n, 2) AS rank_percentile FROM ranked"""


QUERIES = {
    "profile_with_gaps": (profile_with_gaps, PROFILE_SQL),
    "sample_with_gaps": (sample_with_gaps, _sample_sql()),
    "shares_with_gaps": (shares_with_gaps, SHARES_SQL),
    "rank_with_gaps": (rank_with_gaps, RANK_SQL),
}
