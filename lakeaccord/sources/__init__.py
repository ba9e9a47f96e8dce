"""Scans and sinks: tables, catalogues, lineage events, results."""
