"""Text helpers of the evidence blocks and the label parser."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..labels import LABELS, UNKNOWN


def parse_label(reply: Column) -> Column:
    """The first label, in list order, that a reply names; else UNKNOWN.

    The reply is searched as it is, then upper-cased with blanks as underscores.
    """
    as_is = F.trim(reply)
    loose = F.replace(F.upper(as_is), F.lit(" "), F.lit("_"))
    hits = [F.when(text.contains(label), F.lit(label)) for text in (as_is, loose) for label in LABELS]
    return F.coalesce(*hits, F.lit(UNKNOWN))


def as_text(value: Column, data_type: T.DataType) -> Column:
    """A value as people write it: no exponent for doubles of everyday size.

    Other doubles get a two-digit exponent with its sign and no needless ``.0``:
    ``1e-05``, ``2.5e+16``.
    """
    if not isinstance(data_type, (T.DoubleType, T.FloatType)):
        return value.cast("string")
    plain = F.rtrim(value.cast("decimal(38,18)").cast("string"), F.lit("0"))
    size = F.abs(value)
    spelled_out = ((size >= 1e7) & (size < 1e16)) | ((size < 1e-3) & (size >= 1e-4))
    shown = value.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(shown, r"^(.*)E", 1), r"\.0$", "")
    power = F.regexp_extract(shown, r"E-?(\d+)$", 1)
    sign = F.when(shown.contains("E-"), F.lit("-")).otherwise(F.lit("+"))
    digits = F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power)
    scientific = F.concat(mantissa, F.lit("e"), sign, digits)
    everyday = F.when(spelled_out, F.regexp_replace(plain, r"\.$", ".0"))
    return F.when(shown.rlike(r"\dE-?\d"), F.coalesce(everyday, scientific)).otherwise(F.coalesce(everyday, shown))


def quoted_list(values: Column) -> Column:
    """``["a", "b"]`` -> ``"a", "b"``."""
    quoted = F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"')))
    return F.array_join(quoted, ", ")


def json_or_default(document: Column, path: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(document, path), F.lit(default))


def or_unknown_mark(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("?"))
