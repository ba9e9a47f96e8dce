"""Roll-ups, shares, lookups and scalar conversions over the lake tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    abbreviate_name, affine, allocate_period, celsius_to_fahrenheit, clip, fixed_width_id, floor_divide,
    json_or_default, last_first, lookup_code, midpoint, or_unknown_mark, parse_label, quoted_list, relabel,
    rescale_rounded, scale_truncated, truncate_to_long,
)
from ..labels import LABELS
from ..operators.rollups import (
    MONEY,
    average_per_group, bin_label, coarsen_bins, count_and_distinct, fine_bins, group_summary, join_codes,
    period_label, share_of_total, summary_through_key, summary_with_fallback, temporal_rollup, unique_names,
    variants,
)
from ..sources.lake import table

# --- group summaries -------------------------------------------------------


def brand_summary(spark, folder):
    return summary_through_key(
        table(spark, folder, "lineitem"), "l_partkey", "l_extendedprice",
        table(spark, folder, "part"), "p_partkey", "p_brand", MONEY,
    )


BRAND_SQL = """SELECT p_brand, count(*) AS total_count,
  sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total_amount,
  trunc(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(*))::BIGINT AS avg_amount
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"""


def status_summary(spark, folder):
    orders = table(spark, folder, "orders")
    return group_summary(orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice", "total_orders", "total_sales", "avg_sales", MONEY)


STATUS_SQL = """SELECT o_orderstatus, o_orderpriority, count(*) AS total_orders,
  sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total_sales,
  trunc(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*))::BIGINT AS avg_sales
FROM orders GROUP BY ALL"""


def actor_summary(spark, folder):
    return count_and_distinct(table(spark, folder, "events"), "user_id", "event_type", "total_rows", "distinct_types")


ACTOR_SQL = """SELECT user_id, count(event_type) AS total_rows, count(DISTINCT event_type) AS distinct_types
FROM events GROUP BY user_id"""


def rollup_fallback(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return summary_with_fallback(
        customer, "c_custkey", "c_acctbal", table(spark, folder, "events"), "user_id", "value", as_type=MONEY
    )


FALLBACK_SQL = """WITH m AS (SELECT user_id, count(*) AS n,
    (sum(value::DECIMAL(18,2))::DOUBLE / count(*)) AS mean FROM events GROUP BY user_id)
SELECT c_custkey, c_name, c_acctbal,
  coalesce(trunc(mean)::BIGINT, trunc(c_acctbal * 0.78::DOUBLE)::BIGINT) AS avg_amount,
  coalesce(n, 0) AS fact_count,
  coalesce(trunc(mean)::BIGINT, trunc(c_acctbal * 0.78::DOUBLE)::BIGINT) * coalesce(n, 0) AS total_amount
FROM customer LEFT JOIN m ON c_custkey = user_id"""


_PERIODS = ["week", "month", "quarter", "year"]


def temporal(spark, folder):
    orders = table(spark, folder, "orders")
    return temporal_rollup(orders, ["o_orderstatus"], "o_orderdate", "o_totalprice", _PERIODS, MONEY)


_PERIOD_SQL = {
    "week": "printf('%d-W%02d', isoyear(o_orderdate), weekofyear(o_orderdate))",
    "month": "strftime(o_orderdate, '%Y-%m')",
    "quarter": "'Q' || quarter(o_orderdate) || '-' || year(o_orderdate)",
    "year": "year(o_orderdate)::VARCHAR",
}
TEMPORAL_SQL = "\nUNION ALL\n".join(
    f"""SELECT o_orderstatus, '{p}' AS grain, {_PERIOD_SQL[p]} AS period,
  sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS sum_amount, count(*) AS row_count,
  sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS avg_amount
FROM orders GROUP BY ALL""" for p in _PERIODS
)


def annual_average(spark, folder):
    events = table(spark, folder, "events").withColumn("year", F.year("ts"))
    return average_per_group(events, ["user_id", "year"], "value", 1, "annual_avg", "decimal(18,4)")


ANNUAL_SQL = """SELECT user_id, year(ts)::INTEGER AS year,
  round_even((sum(value::DECIMAL(18,4))::DOUBLE / count(*)), 1) AS annual_avg FROM events GROUP BY ALL"""


def bin_coarsen(spark, folder):
    fine = fine_bins(table(spark, folder, "part"), "p_size", 5, 9)
    coarse = coarsen_bins(fine, 2)
    parts = []
    for grain, bins, width, last in (("5", fine, 5, 9), ("10", coarse, 10, 4)):
        shared = share_of_total(bins, "population_count")
        parts.append(shared.select(
            F.lit(grain).alias("grain"), bin_label(F.col("bin_index"), width, last).alias("size_range"),
            "population_count", "pct_total",
        ))
    return parts[0].unionByName(parts[1])


def _bin_sql(grain: int, last: int) -> str:
    return f"""SELECT '{grain}' AS grain,
  CASE WHEN b >= {last} THEN (b * {grain}) || '+' ELSE (b * {grain}) || '-' || (b * {grain} + {grain - 1}) END AS size_range,
  count(*) AS population_count,
  round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100.0::DOUBLE, 2) AS pct_total
FROM (SELECT least(p_size // {grain}, {last}) AS b FROM part) GROUP BY b"""


BIN_SQL = _bin_sql(5, 9) + "\nUNION ALL\n" + _bin_sql(10, 4)


def shares(spark, folder):
    counted = table(spark, folder, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("parts"))
    return share_of_total(share_of_total(counted, "parts"), "parts", "pct_brand", ["p_brand"])


SHARES_SQL = """SELECT p_brand, p_type, count(*) AS parts,
  round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100.0::DOUBLE, 2) AS pct_total,
  round_even(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY p_brand) * 100.0::DOUBLE, 2) AS pct_brand
FROM part GROUP BY p_brand, p_type"""


def unique_part_names(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    return unique_names(part, "p_name", "p_partkey", "unique_name", " ")


UNIQUE_SQL = """SELECT p_partkey, p_name,
  CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1
       THEN p_name || ' ' || p_partkey ELSE p_name END AS unique_name FROM part"""


def code_join(spark, folder):
    """Customers with the region of their nation; every seventh one has a nation code that no region knows."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    mapped = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    code = F.col("c_nationkey") + F.when(F.col("c_custkey") % 7 == 0, 1000).otherwise(0)
    customer = table(spark, folder, "customer").select("c_custkey", code.alias("nation_code"))
    return join_codes(customer, "nation_code", mapped, "n_nationkey", "r_name", "region_name")


CODE_JOIN_SQL = """SELECT c_custkey, nation_code, r_name AS region_name
FROM (SELECT c_custkey, (c_nationkey + CASE WHEN c_custkey % 7 = 0 THEN 1000 ELSE 0 END)::INTEGER AS nation_code FROM customer)
LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) ON nation_code = n_nationkey"""

# --- scalar conversions ----------------------------------------------------

# Exchange rates from US dollars.
USD_RATES = {"eur": 0.91, "gbp": 0.79, "jpy": 149.5, "chf": 0.88}


def currency_scale(spark, folder):
    li = table(spark, folder, "lineitem")
    price = F.col("l_extendedprice")
    scaled = {f"price_{c}": scale_truncated(price, r) for c, r in USD_RATES.items()}
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[v.alias(k) for k, v in scaled.items()])


CURRENCY_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"trunc(l_extendedprice * {r}::DOUBLE)::BIGINT AS price_{c}" for c, r in USD_RATES.items()
) + " FROM lineitem"


def rescale(spark, folder):
    orders = table(spark, folder, "orders")
    price = F.col("o_totalprice")
    return orders.select(
        "o_orderkey",
        rescale_rounded(price, 1000.0, 1).alias("price_thousands"),
        rescale_rounded(price, 5000.0, 1).alias("price_score"),
        clip(price, 10000.0, 400000.0).alias("price_clipped"),
        affine(price, 0.45, 1200.0).alias("price_rating"),
        truncate_to_long(affine(price, 0.45, 1200.0)).alias("price_rating_int"),
    )


RESCALE_SQL = """SELECT o_orderkey, round_even(o_totalprice / 1000.0::DOUBLE, 1) AS price_thousands,
  round_even(o_totalprice / 5000.0::DOUBLE, 1) AS price_score,
  least(greatest(o_totalprice, 10000.0::DOUBLE), 400000.0::DOUBLE) AS price_clipped,
  o_totalprice * 0.45::DOUBLE + 1200.0::DOUBLE AS price_rating,
  trunc(o_totalprice * 0.45::DOUBLE + 1200.0::DOUBLE)::BIGINT AS price_rating_int FROM orders"""


def affine_units(spark, folder):
    events = table(spark, folder, "events")
    return events.select("event_id", F.col("value").alias("celsius"), celsius_to_fahrenheit(F.col("value")).alias("fahrenheit"))


AFFINE_SQL = """SELECT event_id, value AS celsius,
  round_even(value * 9.0::DOUBLE / 5.0::DOUBLE + 32.0::DOUBLE, 1) AS fahrenheit FROM events"""


def temporal_allocation(spark, folder):
    orders = table(spark, folder, "orders")
    yearly = F.col("o_totalprice")
    noise = F.lit(0.92) + (F.pmod(F.col("o_custkey"), F.lit(17)) / F.lit(100.0))
    return orders.select(
        "o_orderkey",
        allocate_period(yearly, "month", noise).alias("monthly"),
        allocate_period(yearly, "quarter", noise).alias("quarterly"),
        allocate_period(yearly, "week", noise).alias("weekly"),
        F.round(yearly / 12.0, 0).alias("monthly_rounded"),
        floor_divide(truncate_to_long(yearly), 12).alias("monthly_whole"),
        midpoint(truncate_to_long(yearly), F.col("o_custkey")).alias("midpoint"),
        period_label(F.col("o_orderdate"), "month").alias("report_month"),
        period_label(F.col("o_orderdate"), "quarter").alias("report_quarter"),
        period_label(F.col("o_orderdate"), "week").alias("report_week"),
    )


_NOISE = "(0.92::DOUBLE + (o_custkey % 17) / 100.0::DOUBLE)"
ALLOCATION_SQL = f"""SELECT o_orderkey,
  trunc(o_totalprice / 12.0::DOUBLE * 0.9::DOUBLE * {_NOISE})::BIGINT AS monthly,
  trunc(o_totalprice / 4.0::DOUBLE * 0.88::DOUBLE * {_NOISE})::BIGINT AS quarterly,
  trunc(o_totalprice * (0.9::DOUBLE / 4.33::DOUBLE) * {_NOISE})::BIGINT AS weekly,
  round(o_totalprice / 12.0::DOUBLE, 0) AS monthly_rounded,
  trunc(o_totalprice)::BIGINT // 12 AS monthly_whole,
  (trunc(o_totalprice)::BIGINT + o_custkey) // 2 AS midpoint,
  {_PERIOD_SQL["month"]} AS report_month, {_PERIOD_SQL["quarter"]} AS report_quarter, {_PERIOD_SQL["week"]} AS report_week
FROM orders"""


def name_formats(spark, folder):
    part = table(spark, folder, "part")
    return part.select(
        "p_partkey", "p_name", abbreviate_name(F.col("p_name")).alias("abbreviated"),
        last_first(F.col("p_name")).alias("last_first"),
        abbreviate_name(F.col("p_brand")).alias("one_word"),
    )


NAMES_SQL = r"""WITH w AS (SELECT p_partkey, p_name, p_brand, regexp_split_to_array(trim(p_name), '\s+') AS a FROM part)
SELECT p_partkey, p_name,
  CASE WHEN len(a) >= 2 THEN a[1][1] || '. ' || array_to_string(a[2:], ' ') ELSE p_name END AS abbreviated,
  CASE WHEN len(a) >= 2 THEN a[-1] || ', ' || array_to_string(a[:-2], ' ') ELSE p_name END AS last_first,
  p_brand AS one_word FROM w"""

# Short codes of order priorities; the lowest one has none.
PRIORITY_CODES = {"1-URGENT": "U", "2-HIGH": "H", "3-MEDIUM": "M", "4-NOT SPECIFIED": "N"}
PRIORITY_NUMBERS = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 0}


def value_relabel(spark, folder):
    priority = F.col("o_orderpriority")
    return table(spark, folder, "orders").select(
        fixed_width_id("ORD", F.col("o_orderkey"), 4).alias("order_id"),
        lookup_code(priority, PRIORITY_CODES).alias("priority_code"),
        lookup_code(priority, PRIORITY_NUMBERS).alias("priority_number"),
        relabel(priority, PRIORITY_CODES).alias("priority_label"),
    )


def _case(codes: dict, column: str, otherwise: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in codes.items())
    return f"CASE {column} {arms} ELSE {otherwise} END"


RELABEL_SQL = f"""SELECT printf('ORD%04d', o_orderkey) AS order_id,
  {_case(PRIORITY_CODES, 'o_orderpriority', 'NULL')} AS priority_code,
  ({_case(PRIORITY_NUMBERS, 'o_orderpriority', 'NULL')})::INTEGER AS priority_number,
  {_case(PRIORITY_CODES, 'o_orderpriority', 'o_orderpriority')} AS priority_label FROM orders"""


def label_parse(spark, folder):
    """Replies of a labeller, worded from order attributes, read back as labels."""
    orders = table(spark, folder, "orders")
    reply = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("  TYPE1_MEASURE\n"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("It is type2 granularity, I think."))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("no conflict "), F.when(
            F.col("o_orderstatus") == "F", F.lit("duplicate")).otherwise(F.lit("diff entity"))))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("NO_CONFLICT_DIFF_ENTITY or TYPE2_GRANULARITY"))
        .otherwise(F.col("o_orderpriority"))
    )
    return orders.select("o_orderkey", reply.alias("reply")).withColumn("pred", parse_label(F.col("reply")))


_CONTAINS = " ".join(f"WHEN contains(reply, '{l}') THEN '{l}'" for l in LABELS) + " " + " ".join(
    f"WHEN contains(replace(upper(reply), ' ', '_'), '{l}') THEN '{l}'" for l in LABELS
)
PARSE_SQL = f"""WITH r AS (SELECT o_orderkey, CASE
    WHEN o_orderpriority = '1-URGENT' THEN '  TYPE1_MEASURE' || chr(10)
    WHEN o_orderpriority = '2-HIGH' THEN 'It is type2 granularity, I think.'
    WHEN o_orderpriority = '3-MEDIUM' THEN 'no conflict ' || CASE WHEN o_orderstatus = 'F' THEN 'duplicate' ELSE 'diff entity' END
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'NO_CONFLICT_DIFF_ENTITY or TYPE2_GRANULARITY'
    ELSE o_orderpriority END AS reply FROM orders)
SELECT o_orderkey, reply, CASE {_CONTAINS} ELSE 'UNKNOWN' END AS pred FROM r"""


def json_get(spark, folder):
    events = table(spark, folder, "events")
    return events.select(
        "event_id",
        json_or_default(F.col("props"), "$.k").alias("k"),
        json_or_default(F.col("props"), "$.sql.query", "none").alias("query"),
        or_unknown_mark(F.get_json_object("props", "$.k").cast("int")).alias("k_mark"),
        or_unknown_mark(F.get_json_object("props", "$.missing")).alias("missing_mark"),
        quoted_list(F.array("event_type", F.get_json_object("props", "$.k"))).alias("quoted"),
    )


JSON_SQL = """SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k,
  coalesce(json_extract_string(props, '$.sql.query'), 'none') AS query,
  coalesce(json_extract_string(props, '$.k'), '?') AS k_mark, '?' AS missing_mark,
  '"' || event_type || '", "' || json_extract_string(props, '$.k') || '"' AS quoted FROM events"""


def table_variants(spark, folder):
    """One wide table split into narrow ones, and their union with gaps as null."""
    customer = table(spark, folder, "customer").withColumns({
        "region_code": F.lit("ALL"), "balance_eur": scale_truncated(F.col("c_acctbal"), USD_RATES["eur"]),
    })
    split = variants(
        customer,
        {"usd": ["c_custkey", "c_name", "c_acctbal"], "eur": ["c_custkey", "balance_eur", "region_code"]},
        {"usd": {"c_acctbal": "balance_usd"}},
    )
    named = [df.withColumn("variant", F.lit(name)) for name, df in split.items()]
    return reduce(lambda a, b: DataFrame.unionByName(a, b, allowMissingColumns=True), named)


VARIANTS_SQL = """SELECT c_custkey, c_name, c_acctbal AS balance_usd, 'usd' AS variant,
  NULL::BIGINT AS balance_eur, NULL::VARCHAR AS region_code FROM customer
UNION ALL SELECT c_custkey, NULL, NULL, 'eur', trunc(c_acctbal * 0.91::DOUBLE)::BIGINT, 'ALL' FROM customer"""


QUERIES = {
    "brand_rollup": (brand_summary, BRAND_SQL),
    "status_rollup": (status_summary, STATUS_SQL),
    "actor_rollup": (actor_summary, ACTOR_SQL),
    "rollup_fallback": (rollup_fallback, FALLBACK_SQL),
    "temporal_rollup": (temporal, TEMPORAL_SQL),
    "annual_average": (annual_average, ANNUAL_SQL),
    "bin_coarsen": (bin_coarsen, BIN_SQL),
    "share_of_total": (shares, SHARES_SQL),
    "unique_names": (unique_part_names, UNIQUE_SQL),
    "code_join": (code_join, CODE_JOIN_SQL),
    "currency_scale": (currency_scale, CURRENCY_SQL),
    "rescale": (rescale, RESCALE_SQL),
    "affine_units": (affine_units, AFFINE_SQL),
    "temporal_allocation": (temporal_allocation, ALLOCATION_SQL),
    "name_formats": (name_formats, NAMES_SQL),
    "value_relabel": (value_relabel, RELABEL_SQL),
    "label_parse": (label_parse, PARSE_SQL),
    "json_get": (json_get, JSON_SQL),
    "table_variants": (table_variants, VARIANTS_SQL),
}
