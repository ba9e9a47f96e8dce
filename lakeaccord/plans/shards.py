"""A lake of many small tables derived from the order lines.

Every supplier is one lake table ``supplier_N`` with the columns quantity,
price_usd, price_eur and price_month; its declaration comes from the supplier
row and its lineage from its order lines. Pairs, statistics, samples,
declarations and lineage grow with the tables they are derived from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import floor_divide, scale_truncated, truncate_to_long
from ..labels import DIFF_ENTITY, DUPLICATE, TYPE1, TYPE2
from ..operators.profile import profile
from ..operators.rollups import MONEY
from ..operators.sampling import sample_values
from ..sources.catalog import ddl_blocks, declaration, mint_pair_ids
from ..sources.lake import table
from ..sources.lineage import lineage_by_table

COLUMNS = ["quantity", "price_usd", "price_eur", "price_month"]
KEY = ["l_orderkey", "l_partkey", "l_linenumber"]
EUR_RATE = 0.91

# The pairs built for every table; the last one names the next table.
PAIRS = [
    ("price_usd", 0, "price_eur", TYPE1),
    ("price_usd", 0, "price_month", TYPE2),
    ("price_usd", 0, "price_usd", DUPLICATE),
    ("price_usd", 0, "quantity", DIFF_ENTITY),
    ("quantity", 1, "price_eur", DIFF_ENTITY),
]


def shard_rows(spark, folder) -> DataFrame:
    li = table(spark, folder, "lineitem")
    price = F.col("l_extendedprice")
    return li.select(
        F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("table_name"), *KEY,
        F.col("l_quantity").alias("quantity"), price.alias("price_usd"),
        scale_truncated(price, EUR_RATE).alias("price_eur"),
        floor_divide(truncate_to_long(price), 12).alias("price_month"),
    )


def shard_stats(spark, folder) -> DataFrame:
    rows = shard_rows(spark, folder).select("table_name", *COLUMNS)
    return profile(rows, group="table_name", exact={"price_usd": MONEY})


def shard_samples(spark, folder) -> DataFrame:
    return sample_values(shard_rows(spark, folder), COLUMNS, KEY, table=F.col("table_name"))


def shard_pairs(spark, folder) -> DataFrame:
    supplier = table(spark, folder, "supplier").select("s_suppkey")
    templates = F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.lit(a).alias("col_a"), F.lit(step).alias("step"),
            F.lit(b).alias("col_b"), F.lit(label).alias("label"),
        )
        for i, (a, step, b, label) in enumerate(PAIRS)
    ])
    pairs = supplier.select("s_suppkey", F.inline(templates)).select(
        (F.col("s_suppkey") * len(PAIRS) + F.col("i")).alias("_order"),
        F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("table_a"), "col_a",
        F.concat(F.lit("supplier_"), (F.col("s_suppkey") + F.col("step")).cast("string")).alias("table_b"),
        "col_b", "label",
    )
    return mint_pair_ids(pairs, "_order").select("id", "table_a", "col_a", "table_b", "col_b", "label")


NAMESPACE = 20  # statements per declaration text


def shard_ddl_texts(spark, folder) -> DataFrame:
    """Declaration texts of ``NAMESPACE`` tables each; every table is declared twice."""
    supplier = table(spark, folder, "supplier")
    name = F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string"))

    def statement(comment):
        return declaration(
            name,
            [("quantity", "DOUBLE", F.lit("Quantity")), ("price_usd", "DOUBLE", F.lit("Price in US dollars")),
             ("price_eur", "BIGINT", F.lit("Price in euros")), ("price_month", "BIGINT", F.lit("Monthly price in US dollars"))],
            comment,
            {"source": F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")), "currency": F.lit("USD"), "grain": F.lit("per-line")},
        )

    both = F.concat(statement(F.lit("Outdated")), F.lit("\n\n"), statement(F.col("s_name")), F.lit("\n\n"))
    parts = supplier.select(floor_divide(F.col("s_suppkey"), NAMESPACE).alias("seq"), F.struct("s_suppkey", both.alias("t")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["t"]), "")
    return parts.groupBy("seq").agg(joined.alias("text"))


def shard_ddl(spark, folder) -> DataFrame:
    return ddl_blocks(shard_ddl_texts(spark, folder))


def shard_events(spark, folder) -> DataFrame:
    """One lineage event per order line; the second output has no name."""
    li = table(spark, folder, "lineitem")
    text = lambda c: F.col(c).cast("string")
    namespace = lambda n: F.lit(n).alias("namespace")
    query = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("SELECT * FROM lines WHERE part = "), text("l_partkey")))
    facets = lambda q: F.struct(F.struct(q.alias("query")).alias("sql")).alias("facets")
    return li.select(
        F.lit("COMPLETE").alias("eventType"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("eventTime"),
        F.struct(F.concat_ws("-", F.lit("run"), *[text(k) for k in KEY]).alias("runId")).alias("run"),
        F.struct(namespace("lakehouse"), F.concat(F.lit("load_"), F.col("l_returnflag")).alias("name")).alias("job"),
        F.array(
            F.struct(namespace("source"), F.concat(F.lit("source/part_"), text("l_partkey")).alias("name")),
            F.struct(namespace("lakehouse"), F.concat(F.lit("order_"), text("l_orderkey")).alias("name")),
        ).alias("inputs"),
        F.array(
            F.struct(namespace("lakehouse"), F.concat(F.lit("supplier_"), text("l_suppkey")).alias("name"), facets(query)),
            F.struct(namespace("lakehouse"), F.lit(None).cast("string").alias("name"), facets(F.lit("none"))),
        ).alias("outputs"),
    )


def shard_lineage(spark, folder) -> DataFrame:
    return lineage_by_table(shard_events(spark, folder))


# --- the same lake in SQL --------------------------------------------------

SHARD = f"""shard AS (
  SELECT 'supplier_' || l_suppkey AS table_name, l_orderkey, l_partkey, l_linenumber,
    l_quantity AS quantity, l_extendedprice AS price_usd,
    trunc(l_extendedprice * {EUR_RATE}::DOUBLE)::BIGINT AS price_eur,
    trunc(l_extendedprice)::BIGINT // 12 AS price_month FROM lineitem)"""

STATS = "stats AS (" + "\nUNION ALL\n".join(
    f"""SELECT table_name, '{c}' AS col_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
  count(DISTINCT {c}) AS distinct_count, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max,
  round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM shard GROUP BY table_name"""
    for c in COLUMNS
) + ")"

SAMPLES = "samples AS (SELECT table_name, col_name, string_agg('\"' || v || '\"', ', ' ORDER BY rn) AS quoted FROM (" + "\nUNION ALL\n".join(
    f"""SELECT table_name, '{c}' AS col_name, {c}::VARCHAR AS v, row_number() OVER (PARTITION BY table_name
  ORDER BY md5('42|' || l_orderkey || '|' || l_partkey || '|' || l_linenumber), {c}::VARCHAR) AS rn FROM shard"""
    for c in COLUMNS
) + ") WHERE rn <= 10 GROUP BY ALL)"

PAIRS_CTE = "pairs AS (SELECT printf('P%04d', row_number() OVER (ORDER BY o)) AS id, table_a, col_a, table_b, col_b, label FROM (" + "\nUNION ALL\n".join(
    f"""SELECT s_suppkey * {len(PAIRS)} + {i} AS o, 'supplier_' || s_suppkey AS table_a, '{a}' AS col_a,
  'supplier_' || (s_suppkey + {step}) AS table_b, '{b}' AS col_b, '{label}' AS label FROM supplier"""
    for i, (a, step, b, label) in enumerate(PAIRS)
) + "))"

DDL = r"""ddl AS (SELECT 'supplier_' || s_suppkey AS table_name, replace('CREATE TABLE supplier_' || s_suppkey || ' (\n' ||
  '    quantity DOUBLE COMMENT ''Quantity'',\n    price_usd DOUBLE COMMENT ''Price in US dollars'',\n' ||
  '    price_eur BIGINT COMMENT ''Price in euros'',\n    price_month BIGINT COMMENT ''Monthly price in US dollars''\n)\n' ||
  'COMMENT ''' || s_name || '''\nSTORED AS PARQUET\nTBLPROPERTIES (source=''nation_' || s_nationkey ||
  ''' currency=''USD'' grain=''per-line'');', '\n', chr(10)) AS ddl, s_nationkey FROM supplier)"""

LINEAGE = """lineage AS (SELECT 'supplier_' || l_suppkey AS table_name, 'load_' || l_returnflag AS job,
    'source/part_' || l_partkey || ', order_' || l_orderkey AS inputs,
    CASE WHEN l_linestatus = 'O' THEN 'SELECT * FROM lines WHERE part = ' || l_partkey ELSE '' END AS sql
  FROM (SELECT *, 'run-' || l_orderkey || '-' || l_partkey || '-' || l_linenumber AS run FROM lineitem)
  QUALIFY row_number() OVER (PARTITION BY l_suppkey
    ORDER BY strftime(l_shipdate, '%Y-%m-%d') DESC, length(run) DESC, run DESC) = 1)"""

_DASH = "—"


def _blocks_sql() -> str:
    columns = []
    for s in ("a", "b"):
        t, c = f"table_{s}", f"col_{s}"
        columns += [
            f"'  ' || {t} || '.' || {c} || ' {_DASH} sample values: [' || coalesce(v{s}.quoted, '(no data)') || ']' AS v_{s}",
            f"""'  ' || {t} || '.' || {c} || ' {_DASH} ' || CASE WHEN s{s}.row_count IS NULL THEN 'no statistics available' ELSE
  'rows=' || s{s}.row_count || ', nulls=' || s{s}.null_count || ', distinct=' || s{s}.distinct_count ||
  ', min=' || s{s}.min || ', max=' || s{s}.max || ', mean=' || s{s}.mean || ', std=' || coalesce(s{s}.std::VARCHAR, 'nan') END AS s_{s}""",
            f"coalesce(d{s}.ddl, '(DDL not available for ' || {t} || ')') AS d_{s}",
            f"""CASE WHEN l{s}.job IS NULL THEN '  ' || {t} || ' {_DASH} no lineage available' ELSE
  '  table: ' || {t} || chr(10) || '  job: ' || l{s}.job || chr(10) || '  inputs: ' || l{s}.inputs || chr(10) || '  sql: ' || l{s}.sql END AS l_{s}""",
        ]
    joins = " ".join(
        f"""LEFT JOIN samples v{s} ON v{s}.table_name = table_{s} AND v{s}.col_name = col_{s}
LEFT JOIN stats s{s} ON s{s}.table_name = table_{s} AND s{s}.col_name = col_{s}
LEFT JOIN ddl d{s} ON d{s}.table_name = table_{s} LEFT JOIN lineage l{s} ON l{s}.table_name = table_{s}"""
        for s in ("a", "b")
    )
    return f"blocks AS (SELECT pairs.*, {', '.join(columns)} FROM pairs {joins})"


BLOCKS = ",\n".join([SHARD, STATS, SAMPLES, PAIRS_CTE, DDL, LINEAGE, _blocks_sql()])
