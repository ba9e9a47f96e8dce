"""Column functions: every one takes and returns a Column and stays in the JVM."""

from .codes import fixed_width_id, lookup_code, lookup_code_strict, relabel
from .names import abbreviate_name, last_first
from .numeric import (
    affine,
    allocate_period,
    celsius_to_fahrenheit,
    clip,
    floor_divide,
    midpoint,
    round_half_even,
    scale_truncated,
    rescale_rounded,
    truncate_to_long,
)
from .text import (
    as_text,
    json_or_default,
    or_unknown_mark,
    parse_label,
    quoted_list,
)

__all__ = [
    "abbreviate_name", "affine", "allocate_period", "as_text", "celsius_to_fahrenheit",
    "clip", "fixed_width_id", "floor_divide", "json_or_default", "last_first",
    "lookup_code", "lookup_code_strict", "midpoint", "or_unknown_mark", "parse_label",
    "quoted_list", "relabel", "rescale_rounded", "round_half_even", "scale_truncated",
    "truncate_to_long",
]
