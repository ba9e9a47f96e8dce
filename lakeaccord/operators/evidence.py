"""Evidence about column pairs: four kinds of blocks, gated by a source subset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_text, or_unknown_mark, quoted_list
from ..labels import LABELS, SOURCES

# Wording of the evidence blocks and of a labelling request.
DASH = "—"
NO_DATA = "(no data)"
NO_STATISTICS = "no statistics available"
NO_LINEAGE = "no lineage available"
REQUEST_HEAD = "You are classifying a column pair from a data lakehouse.\n"
REQUEST_PAIR = "Column pair:\n  A: "
REQUEST_VALUES = "Sample values:\n"
REQUEST_STATISTICS = "Column statistics:\n"
REQUEST_SCHEMA = "Schema (DDL):\n--- Table A ---\n"
REQUEST_LINEAGE = "Lineage:\n--- Table A ---\n"
REQUEST_OTHER_TABLE = "\n--- Table B ---\n"
LABEL_MEANINGS = (
    "  TYPE1_MEASURE - same semantic concept, different measurement unit "
    "(e.g. USD vs EUR, seats vs thousands, raw pts vs normalised)\n"
    "  TYPE2_GRANULARITY - same semantic concept, different aggregation level "
    "(e.g. daily vs monthly, per-row vs per-group aggregate)\n"
    f"  NO_CONFLICT_DUPLICATE {DASH} same data, no semantic conflict\n"
    f"  NO_CONFLICT_DIFF_ENTITY {DASH} different real-world concepts, no conflict"
)
REQUEST_CLASSES = (
    "Classes:\n" + LABEL_MEANINGS + "\n\nRespond with exactly one label (no explanation):\n" + " | ".join(LABELS)
)


def source_subsets() -> Column:
    """All non-empty subsets of the four sources: array of (sources, combo).

    A subset is named by its letters in alphabetical order.
    """
    letters = F.array_sort(F.array(*[F.lit(s) for s in SOURCES]))
    chosen = F.transform(
        F.sequence(F.lit(1), F.lit(2 ** len(SOURCES) - 1)),
        lambda bits: F.filter(letters, lambda s, i: F.call_function("bit_get", bits, i) == 1),
    )
    return F.transform(chosen, lambda s: F.struct(s.alias("sources"), F.array_join(s, "").alias("combo")))


def with_subsets(df: DataFrame) -> DataFrame:
    """Every row once per source subset: the full factorial, without a join."""
    return df.select("*", F.inline(source_subsets()))


# --- blocks ----------------------------------------------------------------


def values_block(table: Column, column: Column, samples: Column) -> Column:
    shown = F.when(F.size(samples) > 0, quoted_list(samples)).otherwise(F.lit(NO_DATA))
    shown = F.coalesce(shown, F.lit(NO_DATA))
    return F.concat(F.lit("  "), table, F.lit("."), column, F.lit(f" {DASH} sample values: ["), shown, F.lit("]"))


def statistics_block(table: Column, column: Column, stats: Column) -> Column:
    """``stats`` is a struct of profile figures, null for an unknown column."""
    counts = [
        F.concat(F.lit(f"{name}="), or_unknown_mark(stats[field]))
        for name, field in (("rows", "row_count"), ("nulls", "null_count"), ("distinct", "distinct_count"))
    ]
    numbers = [
        F.when(stats["min"].isNotNull(), F.concat(F.lit(f"{name}="), F.coalesce(as_text(stats[name], T.DoubleType()), F.lit("nan"))))
        for name in ("min", "max", "mean", "std")
    ]
    shown = F.when(stats.isNotNull(), F.concat_ws(", ", *counts, *numbers)).otherwise(F.lit(NO_STATISTICS))
    return F.concat(F.lit("  "), table, F.lit("."), column, F.lit(f" {DASH} "), shown)


def declaration_block(table: Column, ddl: Column) -> Column:
    return F.coalesce(ddl, F.concat(F.lit("(DDL not available for "), table, F.lit(")")))


def lineage_block(table: Column, entry: Column) -> Column:
    """``entry`` is a struct (job, inputs, sql), null for a table without lineage."""
    inputs = F.when(F.size(entry["inputs"]) > 0, F.array_join(entry["inputs"], ", ")).otherwise(F.lit("none"))
    lines = F.concat(
        F.lit("  table: "), table, F.lit("\n  job: "), entry["job"], F.lit("\n  inputs: "), inputs,
        F.lit("\n  sql: "), entry["sql"],
    )
    return F.when(entry.isNotNull(), lines).otherwise(F.concat(F.lit("  "), table, F.lit(f" {DASH} {NO_LINEAGE}")))


# --- joins -----------------------------------------------------------------


def _look_up(pairs: DataFrame, side: str, found: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Left join of one side of the pairs; a hot table is split by adaptive execution."""
    renamed = found.withColumnsRenamed({c: f"{c}_{side}" for c in found.columns if c not in keys})
    renamed = renamed.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = F.lit(True)
    for key, pair_column in keys.items():
        condition = condition & (pairs[f"{pair_column}_{side}"] == renamed[f"_{key}"])
    return pairs.join(renamed, condition, "left").drop(*[f"_{k}" for k in keys])


def pair_blocks(
    pairs: DataFrame,
    stats: DataFrame | None = None,
    samples: DataFrame | None = None,
    ddl: DataFrame | None = None,
    lineage: DataFrame | None = None,
) -> DataFrame:
    """Pairs with ``v_a v_b s_a s_b d_a d_b l_a l_b``; absent inputs count as unknown.

    Statistics and samples are made once per column and joined, not read again
    for every pair, side and subset.
    """
    figures = "struct<row_count bigint, null_count bigint, distinct_count bigint, min double, max double, mean double, std double>"
    columns = tables = None
    if stats is not None:
        columns = stats.select("table_name", "col_name", F.struct(
            "row_count", "null_count", "distinct_count", "min", "max", "mean", "std").alias("stats"))
    if samples is not None:
        picked = samples.select("table_name", "col_name", "sample_values")
        columns = picked if columns is None else columns.join(picked, ["table_name", "col_name"], "full")
    if ddl is not None:
        tables = ddl.select("table_name", "ddl")
    if lineage is not None:
        entries = lineage.select("table_name", F.struct("job", "inputs", "sql").alias("entry"))
        tables = entries if tables is None else tables.join(entries, "table_name", "full")
    out = pairs
    for side in ("a", "b"):
        if columns is not None:
            out = _look_up(out, side, columns, {"table_name": "table", "col_name": "col"})
        if tables is not None:
            out = _look_up(out, side, tables, {"table_name": "table"})
    unknown = {
        "stats": figures, "sample_values": "array<string>", "ddl": "string",
        "entry": "struct<job string, inputs array<string>, sql string>",
    }
    blocks = {}
    for side in ("a", "b"):
        table, column = F.col(f"table_{side}"), F.col(f"col_{side}")
        part = {
            name: F.col(f"{name}_{side}") if f"{name}_{side}" in out.columns else F.lit(None).cast(kind)
            for name, kind in unknown.items()
        }
        blocks[f"v_{side}"] = values_block(table, column, part["sample_values"])
        blocks[f"s_{side}"] = statistics_block(table, column, part["stats"])
        blocks[f"d_{side}"] = declaration_block(table, part["ddl"])
        blocks[f"l_{side}"] = lineage_block(table, part["entry"])
    return out.select(*pairs.columns, *[c.alias(n) for n, c in blocks.items()])


# --- texts -----------------------------------------------------------------


def _gated(source: str, text: Column) -> Column:
    return F.when(F.array_contains("sources", source), text)


def _pair_name(side: str) -> Column:
    return F.concat(F.col(f"table_{side}"), F.lit("."), F.col(f"col_{side}"))


def evidence_text() -> Column:
    """The plain evidence text of a row with blocks and a source subset."""
    blocks = [
        _gated(source, F.col(f"{source.lower()}_{side}")) for source in SOURCES for side in ("a", "b")
    ]
    return F.concat_ws(
        "\n", F.concat(F.lit("A: "), _pair_name("a")), F.concat(F.lit("B: "), _pair_name("b")), *blocks
    )


def request_text() -> Column:
    """The text that asks any labeller for the class of a pair."""
    both = lambda head, letter, between: F.concat(F.lit(head), F.col(f"{letter}_a"), F.lit(between), F.col(f"{letter}_b"))
    return F.concat_ws(
        "\n\n",
        F.lit(REQUEST_HEAD),
        F.concat(F.lit(REQUEST_PAIR), _pair_name("a"), F.lit("\n  B: "), _pair_name("b"), F.lit("\n")),
        _gated("V", both(REQUEST_VALUES, "v", "\n")),
        _gated("S", both(REQUEST_STATISTICS, "s", "\n")),
        _gated("D", both(REQUEST_SCHEMA, "d", REQUEST_OTHER_TABLE)),
        _gated("L", both(REQUEST_LINEAGE, "l", REQUEST_OTHER_TABLE)),
        F.lit(REQUEST_CLASSES),
    )
