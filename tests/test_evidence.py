import pytest
from pyspark.sql import functions as F

from lakeaccord.operators import evidence as ev

DASH = "—"


@pytest.fixture(scope="module")
def blocks(spark):
    pairs = spark.createDataFrame(
        [("P1", "sales", "usd", "people", "name", "X"), ("P2", "sales", "usd", "gone", "c", "X"), ("P3", "sales", "usd", "sales", "usd", "X")],
        "id string, table_a string, col_a string, table_b string, col_b string, label string",
    )
    stats = spark.createDataFrame(
        [("sales", "usd", 3, 0, 3, 1.0, 20000000.0, 2.5, 0.125), ("people", "name", 4, 1, None, None, None, None, None)],
        "table_name string, col_name string, row_count bigint, null_count bigint, distinct_count bigint, min double, max double, mean double, std double",
    )
    samples = spark.createDataFrame([("sales", "usd", ["1", "2"]), ("people", "name", [])], "table_name string, col_name string, sample_values array<string>")
    ddl = spark.createDataFrame([("sales", "CREATE TABLE sales (..);")], "table_name string, ddl string")
    lineage = spark.createDataFrame(
        [("sales", "load", ["a", "b"], "SELECT 1"), ("people", "load", [], "")],
        "table_name string, job string, inputs array<string>, sql string",
    )
    return ev.pair_blocks(pairs, stats, samples, ddl, lineage)


def test_blocks(blocks):
    got = {r["id"]: r for r in blocks.collect()}
    p = got["P1"]
    assert p["v_a"] == f'  sales.usd {DASH} sample values: ["1", "2"]'
    assert p["v_b"] == f"  people.name {DASH} sample values: [(no data)]"
    assert p["s_a"] == f"  sales.usd {DASH} rows=3, nulls=0, distinct=3, min=1.0, max=20000000.0, mean=2.5, std=0.125"
    assert p["s_b"] == f"  people.name {DASH} rows=4, nulls=1, distinct=?"
    assert p["d_a"] == "CREATE TABLE sales (..);" and p["d_b"] == "(DDL not available for people)"
    assert p["l_a"] == "  table: sales\n  job: load\n  inputs: a, b\n  sql: SELECT 1"
    assert p["l_b"] == "  table: people\n  job: load\n  inputs: none\n  sql: "
    q = got["P2"]
    assert q["v_b"] == f"  gone.c {DASH} sample values: [(no data)]"
    assert q["s_b"] == f"  gone.c {DASH} no statistics available"
    assert q["l_b"] == f"  gone {DASH} no lineage available"
    assert got["P3"]["s_a"] == got["P3"]["s_b"]


def test_absent_inputs_count_as_unknown(spark):
    pairs = spark.createDataFrame([("P1", "t", "c", "u", "d")], "id string, table_a string, col_a string, table_b string, col_b string")
    r = ev.pair_blocks(pairs).first()
    assert r["s_a"].endswith("no statistics available") and r["d_b"] == "(DDL not available for u)"


def test_subsets(spark):
    got = spark.range(1).select(F.inline(ev.source_subsets())).collect()
    combos = {r["combo"] for r in got}
    assert len(got) == len(combos) == 15 and {"D", "LV", "DLS", "DLSV"} <= combos
    assert all(r["combo"] == "".join(r["sources"]) for r in got)


def test_evidence_text_order_and_gates(blocks):
    texts = {(r["id"], r["combo"]): r["t"] for r in ev.with_subsets(blocks).select("id", "combo", ev.evidence_text().alias("t")).collect()}
    assert len(texts) == 45
    lines = texts[("P1", "SV")].split("\n")
    assert lines[:2] == ["A: sales.usd", "B: people.name"]
    assert "sample values" in lines[2] and "rows=" in lines[4] and len(lines) == 6
    assert texts[("P1", "D")].endswith("CREATE TABLE sales (..);\n(DDL not available for people)")
    full = texts[("P1", "DLSV")]
    order = [full.index(part) for part in ("sample values", "rows=3", "CREATE TABLE", "job: load")]
    assert order == sorted(order)


def test_request_text(blocks):
    texts = {(r["id"], r["combo"]): r["t"] for r in ev.with_subsets(blocks).select("id", "combo", ev.request_text().alias("t")).collect()}
    text = texts[("P1", "DL")]
    assert text.startswith(
        "You are classifying a column pair from a data lakehouse.\n\n\nColumn pair:\n  A: sales.usd\n  B: people.name\n\n\nSchema (DDL):\n--- Table A ---\n"
    )
    assert "\n--- Table B ---\n(DDL not available for people)\n\nLineage:\n--- Table A ---\n  table: sales" in text
    assert "Sample values" not in text and "Column statistics" not in text
    assert text.endswith("TYPE1_MEASURE | TYPE2_GRANULARITY | NO_CONFLICT_DUPLICATE | NO_CONFLICT_DIFF_ENTITY")


def test_factorial_is_no_join(blocks):
    plan = ev.with_subsets(blocks)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_texts_of_all_subsets_are_dealt_out_evenly(spark):
    from lakeaccord.plans.evidence_queries import TEXT_TASKS, subset_blocks

    found = subset_blocks(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [id" in plan and f", {TEXT_TASKS * spark.sparkContext.defaultParallelism}" in plan and plan.index("Generate") < plan.index("RepartitionByExpression")
