"""Samples, strata, folds, picks and ranks over the lake tables."""

from pyspark.sql import functions as F

from ..functions import fixed_width_id, quoted_list, round_half_even
from ..operators.ranking import rank_with_ties, row_numbers
from ..operators.sampling import (
    EVIDENCE_SAMPLE, pick_from_pool, sample_values, stratified_folds, stratified_sample,
)
from ..sources.lake import table

_SAMPLED = {
    "orders": (["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], "o_orderkey"),
    "part": (["p_name", "p_brand", "p_size", "p_retailprice"], "p_partkey"),
}


def value_sample(spark, folder):
    parts = []
    for name, (columns, key) in _SAMPLED.items():
        sampled = sample_values(table(spark, folder, name), columns, [key], table=name)
        parts.append(sampled.withColumn("sample_values", quoted_list(F.col("sample_values"))))
    return parts[0].unionByName(parts[1])


def _value_sample_sql() -> str:
    cells = "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS table_name, '{c}' AS col_name, {c}::VARCHAR AS v,
        row_number() OVER (ORDER BY md5('42|' || {key}), {c}::VARCHAR) AS rn FROM {name} WHERE {c} IS NOT NULL"""
        for name, (columns, key) in _SAMPLED.items() for c in columns
    )
    return f"""SELECT table_name, col_name, string_agg('"' || v || '"', ', ' ORDER BY rn) AS sample_values
FROM ({cells}) WHERE rn <= {EVIDENCE_SAMPLE} GROUP BY table_name, col_name"""


SAMPLE_ROWS = 300


def stratified_documents(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "lang")
    return stratified_sample(documents, "lang", ["doc_id"], SAMPLE_ROWS)


STRATIFIED_SQL = f"""WITH sized AS (
  SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER () AS total,
         row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id)) AS rn FROM documents),
picked AS (
  SELECT doc_id, lang FROM sized
  WHERE rn <= greatest(1, round_even(n * {SAMPLE_ROWS}.0::DOUBLE / total, 0)))
SELECT doc_id, lang FROM picked ORDER BY md5('42-mix|' || doc_id) LIMIT {SAMPLE_ROWS}"""


def label_folds(spark, folder):
    labels = table(spark, folder, "labels")
    return stratified_folds(labels, "quality", ["doc_id"], k=5)


FOLDS_SQL = """SELECT doc_id, quality, toxic,
  ((row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id)) - 1) % 5)::INTEGER AS fold FROM labels"""


def cast_picks(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    nations = table(spark, folder, "nation")
    return pick_from_pool(orders, "o_orderkey", nations, "n_name", 2, 5)


def _picks_sql(low: int, high: int) -> str:
    """The draws one after another: place k, or the last possible place when it is taken."""
    number = lambda text: f"('0x' || substr(md5({text}), 1, 8))::BIGINT"
    steps = [f"""d0 AS (SELECT o_orderkey, (SELECT count(DISTINCT n_name) FROM nation) AS size,
  {low} + {number("'42|' || o_orderkey")} % {high - low + 1} AS wanted FROM orders)"""]
    for k in range(1, high + 1):
        taken = " OR ".join(f"t = p{i}" for i in range(1, k)) or "false"
        steps.append(f"""d{k} AS (SELECT * EXCLUDE (t), CASE WHEN {taken} THEN size - wanted + {k} ELSE t END AS p{k} FROM (
  SELECT * FROM (SELECT *, {number(f"'42|' || o_orderkey || '|{k}'")} % (size - wanted + {k}) + 1 AS t FROM d{k - 1})))""")
    chosen = "\nUNION ALL\n".join(f"SELECT o_orderkey, p{k} AS place FROM d{high} WHERE wanted >= {k}" for k in range(1, high + 1))
    return f"""WITH {", ".join(steps)},
pool AS (SELECT n_name AS picked, row_number() OVER (ORDER BY md5('pool|' || n_name)) AS place FROM (SELECT DISTINCT n_name FROM nation))
SELECT o_orderkey, picked FROM ({chosen}) JOIN pool USING (place)"""


PICKS_SQL = _picks_sql(2, 5)


def sequential_ids(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    numbered = row_numbers(orders, "o_orderkey")
    return numbered.withColumn("order_id", fixed_width_id("M", F.col("row_number"), 5)).drop("row_number")


SEQUENTIAL_SQL = """SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice,
  printf('M%05d', row_number() OVER (ORDER BY o_orderkey)) AS order_id FROM orders"""


def rank_percentile(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    n = customer.agg(F.count("c_acctbal")).scalar()
    ranked = rank_with_ties(customer, "c_acctbal", "world_rank")
    return ranked.withColumn("rank_percentile", round_half_even((n + 1 - F.col("world_rank")) / n, 2))


RANK_SQL = """WITH r AS (SELECT c_custkey, c_acctbal, rank() OVER (ORDER BY c_acctbal DESC) AS world_rank,
  count(*) OVER () AS n FROM customer)
SELECT c_custkey, c_acctbal, world_rank,
  round_even((n + 1 - world_rank)::DOUBLE / n, 2) AS rank_percentile FROM r"""


QUERIES = {
    "value_sample": (value_sample, _value_sample_sql()),
    "stratified_sample": (stratified_documents, STRATIFIED_SQL),
    "stratified_folds": (label_folds, FOLDS_SQL),
    "pick_from_pool": (cast_picks, PICKS_SQL),
    "sequential_ids": (sequential_ids, SEQUENTIAL_SQL),
    "rank_percentile": (rank_percentile, RANK_SQL),
}
