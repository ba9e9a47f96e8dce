"""Catalogues, lineage, evidence texts and round trips through the sinks."""

from pyspark.sql import functions as F

from ..operators.evidence import (
    REQUEST_CLASSES, REQUEST_HEAD, REQUEST_LINEAGE, REQUEST_OTHER_TABLE, REQUEST_PAIR, REQUEST_SCHEMA,
    REQUEST_STATISTICS, REQUEST_VALUES, evidence_text, pair_blocks, request_text, with_subsets,
)
from ..session import fresh_path
from ..sources.catalog import (
    ddl_blocks, declared_columns, declared_properties, missing_tables, read_ddl_texts, read_manifests, read_pairs,
    write_ddl_texts, write_manifests, write_pairs,
)
from ..sources.csv_tables import read_csv_table, scan_column, write_csv_table
from ..sources.lake import table
from ..sources.lineage import lineage_by_table, lineage_events, read_lineage, table_graph, write_lineage
from . import shards
from .profiles import _profile_sql

# --- catalogues ------------------------------------------------------------


def ddl_catalog(spark, folder):
    """Declaration texts written to files, read back whole and split into statements."""
    path = fresh_path(spark, "ddl")
    write_ddl_texts(shards.shard_ddl_texts(spark, folder), path)
    blocks = ddl_blocks(read_ddl_texts(spark, path))
    found = blocks.join(declared_properties(blocks), "table_name")
    return found.select(
        "table_name", "ddl", *[F.col("properties")[k].alias(k) for k in ("source", "currency", "grain")]
    )


DDL_CATALOG_SQL = f"""WITH {shards.DDL}
SELECT table_name, ddl, 'nation_' || s_nationkey AS source, 'USD' AS currency, 'per-line' AS grain FROM ddl"""


def ddl_columns(spark, folder):
    return declared_columns(shards.shard_ddl(spark, folder))


DDL_COLUMNS_SQL = """SELECT 'supplier_' || s_suppkey AS table_name, pos, col_name, col_type, comment FROM supplier,
(VALUES (0, 'quantity', 'DOUBLE', 'Quantity'), (1, 'price_usd', 'DOUBLE', 'Price in US dollars'),
 (2, 'price_eur', 'BIGINT', 'Price in euros'), (3, 'price_month', 'BIGINT', 'Monthly price in US dollars'))
AS c(pos, col_name, col_type, comment)"""


def lineage_last_event(spark, folder):
    return shards.shard_lineage(spark, folder).withColumn("inputs", F.array_join("inputs", ", "))


LINEAGE_SQL = f"WITH {shards.LINEAGE} SELECT table_name, job, inputs, sql FROM lineage"


def lineage_graph(spark, folder):
    return table_graph(shards.shard_lineage(spark, folder))


GRAPH_SQL = f"""WITH {shards.LINEAGE}
SELECT unnest(string_split(inputs, ', ')) AS input, table_name AS output, job FROM lineage"""


def lineage_round_trip(spark, folder):
    """Jobs per order with two outputs each, written as events and read back by output."""
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey").cast("string")
    jobs = orders.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("job"),
        F.array(F.concat(F.lit("source/customer_"), F.col("o_custkey").cast("string")), F.lit("customer")).alias("inputs"),
        F.array(F.concat(F.lit("order_"), key), F.concat(F.lit("day_"), F.date_format("o_orderdate", "yyyyMMdd"))).alias("outputs"),
        F.concat(F.lit("SELECT * FROM orders WHERE key = "), key).alias("sql"),
    )
    path = fresh_path(spark, "lineage")
    write_lineage(lineage_events(jobs), path)
    events = read_lineage(spark, path, one_array=False)
    first = events.select(F.explode("inputs").alias("i")).groupBy("i.namespace").agg(F.count(F.lit(1)).alias("n"))
    found = lineage_by_table(events, read_once=True).select("table_name", "job", F.array_join("inputs", ", ").alias("inputs"), "sql")
    counts = first.select(
        F.col("namespace").alias("table_name"), F.lit("inputs").alias("job"), F.col("n").cast("string").alias("inputs"),
        F.lit("").alias("sql"),
    )
    return found.unionByName(counts)


LINEAGE_TRIP_SQL = """WITH e AS (
  SELECT 2 * row_number() OVER (ORDER BY o_orderkey) - 1 AS run, 'order_' || o_orderkey AS table_name, * FROM orders
  UNION ALL
  SELECT 2 * row_number() OVER (ORDER BY o_orderkey), 'day_' || strftime(o_orderdate, '%Y%m%d'), * FROM orders)
SELECT table_name, o_orderpriority AS job, 'source/customer_' || o_custkey || ', customer' AS inputs,
  'SELECT * FROM orders WHERE key = ' || o_orderkey AS sql
FROM e QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY run DESC) = 1
UNION ALL SELECT 'source', 'inputs', count(*)::VARCHAR, '' FROM e
UNION ALL SELECT 'lakehouse', 'inputs', count(*)::VARCHAR, '' FROM e"""


def pair_catalog(spark, folder):
    """Pairs with minted ids, written as JSON and read back."""
    path = fresh_path(spark, "pairs")
    write_pairs(shards.shard_pairs(spark, folder), path)
    return read_pairs(spark, path, one_array=False)


PAIRS_SQL = f"WITH {shards.PAIRS_CTE} SELECT * FROM pairs"


def absent_tables(spark, folder):
    present = shards.shard_rows(spark, folder).select("table_name")
    return missing_tables(shards.shard_pairs(spark, folder), present)


ABSENT_SQL = f"""WITH {shards.PAIRS_CTE}
SELECT DISTINCT table_name FROM (SELECT table_a AS table_name FROM pairs UNION ALL SELECT table_b FROM pairs)
WHERE table_name NOT IN (SELECT 'supplier_' || l_suppkey FROM lineitem) ORDER BY 1"""


def csv_round_trip(spark, folder):
    """A table written as CSV, read back by declared schema, with one column scanned alone."""
    customer = table(spark, folder, "customer")
    path = fresh_path(spark, "csv")
    write_csv_table(customer, path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    whole = read_csv_table(spark, path, schema)
    names = scan_column(spark, path, schema, "c_name")
    absent = scan_column(spark, path + "-absent", schema, "c_name")
    counted = names.unionByName(absent).groupBy("c_name").agg(F.count(F.lit(1)).alias("scanned"))
    return whole.join(counted, "c_name")


CSV_SQL = "SELECT *, count(*) OVER (PARTITION BY c_name) AS scanned FROM customer"


def manifest_round_trip(spark, folder):
    """Profiles of the order tables written as JSON manifests and read back as rows."""
    names = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"]}
    path = fresh_path(spark, "manifests")
    write_manifests({n: table(spark, folder, n) for n in names}, names, path)
    return read_manifests(spark, path).withColumn("sampled", F.size("sample_values")).drop("sample_values")


MANIFEST_SQL = f"""SELECT *, least(6, row_count - null_count)::INTEGER AS sampled
FROM ({_profile_sql(["orders", "customer", "supplier"])})"""

# --- evidence --------------------------------------------------------------


def blocks(spark, folder):
    return pair_blocks(
        shards.shard_pairs(spark, folder), shards.shard_stats(spark, folder), shards.shard_samples(spark, folder),
        shards.shard_ddl(spark, folder), shards.shard_lineage(spark, folder),
    )


#: Tasks per core that write texts.
TEXT_TASKS = 4


def subset_blocks(spark, folder):
    """Every pair's blocks once per source subset, dealt out evenly: the joins end in few tasks, and fifteen texts a pair are much longer than its blocks."""
    return with_subsets(blocks(spark, folder).repartition(TEXT_TASKS * spark.sparkContext.defaultParallelism, "id"))


def evidence_blocks(spark, folder):
    return blocks(spark, folder)


BLOCKS_SQL = f"WITH {shards.BLOCKS} SELECT * FROM blocks"


def evidence_texts(spark, folder):
    texts = subset_blocks(spark, folder)
    return texts.select("id", "combo", F.size("sources").alias("n_sources"), evidence_text().alias("evidence"))


_COMBOS = "combos AS (SELECT " + " || ".join(
    f"CASE WHEN (b >> {i}) & 1 = 1 THEN '{letter}' ELSE '' END" for i, letter in enumerate("DLSV")
) + " AS combo FROM range(1, 16) t(b))"


def _gate(letter: str, text: str) -> str:
    return f"CASE WHEN contains(combo, '{letter}') THEN {text} ELSE '' END"


_EVIDENCE = " || ".join(
    ["'A: ' || table_a || '.' || col_a || chr(10) || 'B: ' || table_b || '.' || col_b"]
    + [_gate(s, f"chr(10) || {s.lower()}_a || chr(10) || {s.lower()}_b") for s in "VSDL"]
)
EVIDENCE_SQL = f"""WITH {shards.BLOCKS}, {_COMBOS}
SELECT id, combo, length(combo)::INTEGER AS n_sources, {_EVIDENCE} AS evidence FROM blocks CROSS JOIN combos"""


def request_texts(spark, folder):
    texts = subset_blocks(spark, folder).withColumn("request", request_text())
    return texts.select("id", "combo", F.md5("request").alias("digest"), F.length("request").alias("n_chars"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_REQUEST = " || ".join(
    [f"{_q(REQUEST_HEAD)} || {_q(chr(10) * 2)} || {_q(REQUEST_PAIR)} || table_a || '.' || col_a || {_q(chr(10) + '  B: ')} || table_b || '.' || col_b || chr(10)"]
    + [
        _gate(s, f"{_q(chr(10) * 2 + head)} || {s.lower()}_a || {_q(between)} || {s.lower()}_b")
        for s, head, between in (
            ("V", REQUEST_VALUES, "\n"), ("S", REQUEST_STATISTICS, "\n"),
            ("D", REQUEST_SCHEMA, REQUEST_OTHER_TABLE), ("L", REQUEST_LINEAGE, REQUEST_OTHER_TABLE),
        )
    ]
    + [_q("\n\n" + REQUEST_CLASSES)]
)
REQUEST_SQL = f"""WITH {shards.BLOCKS}, {_COMBOS}, r AS (SELECT id, combo, {_REQUEST} AS request FROM blocks CROSS JOIN combos)
SELECT id, combo, md5(request) AS digest, length(request)::INTEGER AS n_chars FROM r"""


def shard_profile(spark, folder):
    return shards.shard_stats(spark, folder)


SHARD_PROFILE_SQL = f"WITH {shards.SHARD}, {shards.STATS} SELECT * FROM stats"


QUERIES = {
    "shard_profile": (shard_profile, SHARD_PROFILE_SQL),
    "ddl_catalog": (ddl_catalog, DDL_CATALOG_SQL),
    "ddl_columns": (ddl_columns, DDL_COLUMNS_SQL),
    "lineage_last_event": (lineage_last_event, LINEAGE_SQL),
    "lineage_graph": (lineage_graph, GRAPH_SQL),
    "lineage_round_trip": (lineage_round_trip, LINEAGE_TRIP_SQL),
    "pair_catalog": (pair_catalog, PAIRS_SQL),
    "missing_tables": (absent_tables, ABSENT_SQL),
    "csv_round_trip": (csv_round_trip, CSV_SQL),
    "manifest_round_trip": (manifest_round_trip, MANIFEST_SQL),
    "evidence_blocks": (evidence_blocks, BLOCKS_SQL),
    "evidence_text": (evidence_texts, EVIDENCE_SQL),
    "request_text": (request_texts, REQUEST_SQL),
}
