"""The four pair labels and the four evidence sources."""

# Label names in the order that decides ties in parsing and reports.
LABELS = [
    "TYPE1_MEASURE",
    "TYPE2_GRANULARITY",
    "NO_CONFLICT_DUPLICATE",
    "NO_CONFLICT_DIFF_ENTITY",
]
TYPE1, TYPE2, DUPLICATE, DIFF_ENTITY = LABELS
UNKNOWN = "UNKNOWN"

# Evidence sources - V values, S statistics, D declarations, L lineage.
SOURCES = ["V", "S", "D", "L"]
