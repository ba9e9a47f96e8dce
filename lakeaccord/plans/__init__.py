"""Ready-made queries over a lake folder, each with the SQL it must agree with."""

from . import catalog_queries, conflict_queries, evaluation_queries, evidence_queries, gap_queries, profiles, rollup_queries, samples, text_queries

MODULES = [profiles, samples, rollup_queries, evidence_queries, conflict_queries, catalog_queries, evaluation_queries, text_queries, gap_queries]


def registry() -> dict:
    """name -> (callable(spark, folder) -> DataFrame, SQL text or None)."""
    found = {}
    for module in MODULES:
        for name, entry in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = entry
    return found
