"""Code maps and identifiers."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gender encodings.
GENDER_SHORT = {"Male": "M", "Female": "F", "Non-binary": "NB"}
GENDER_CODE = {"Male": 1, "Female": 0, "Non-binary": 2}

# The same price tiers in two currencies.
PRICE_TIER_EUR = {
    "Budget (0-50)": "Budget (0-45)",
    "Economy (50-100)": "Economy (45-91)",
    "Mid-range (100-250)": "Mid-range (91-228)",
    "Premium (250-500)": "Premium (228-455)",
    "Luxury (500+)": "Luxury (455+)",
}


def _literal_map(codes: dict) -> Column:
    return F.create_map(*[F.lit(item) for item in chain.from_iterable(codes.items())])


def lookup_code(value: Column, codes: dict) -> Column:
    """The code of a value; null when the map does not hold it."""
    return F.when(value.isNotNull(), F.try_element_at(_literal_map(codes), value))


def lookup_code_strict(value: Column, codes: dict) -> Column:
    """The code of a value; the job fails when the map does not hold it."""
    found = lookup_code(value, codes)
    complaint = F.raise_error(F.concat(F.lit("no code for "), F.coalesce(value.cast("string"), F.lit("null"))))
    return F.when(found.isNotNull(), found).otherwise(complaint)


def relabel(value: Column, codes: dict) -> Column:
    """Replace mapped values, keep the others."""
    return F.coalesce(lookup_code(value, codes), value)


def fixed_width_id(prefix: str, number: Column, width: int) -> Column:
    """``P`` and 7 -> ``P0007``; a longer number is never cut."""
    return F.format_string(f"{prefix}%0{width}d", number)
