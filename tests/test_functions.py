import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeaccord import functions as fn
from lakeaccord.functions.codes import GENDER_CODE, GENDER_SHORT, PRICE_TIER_EUR
from lakeaccord.functions.names import canonical_name
from lakeaccord.functions.text import as_text


def column(spark, values, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_names(spark):
    names = ["Ada King Lovelace", "Plato", "  Bo  Li ", "Ann Lee 17", None]
    assert column(spark, names, "string", fn.abbreviate_name) == ["A. King Lovelace", "Plato", "B. Li", "A. Lee 17", None]
    assert column(spark, names, "string", fn.last_first) == ["Lovelace, Ada King", "Plato", "Li, Bo", "17, Ann Lee", None]


def test_canonical_name_joins_all_formats(spark):
    forms = ["Ada Lovelace", "Lovelace, Ada", "A. Lovelace"]
    assert set(column(spark, forms, "string", canonical_name)) == {"A. Lovelace"}


def test_rounding_follows_numpy(spark):
    values = [2.5, 0.125, 9.915, 0.25, -1.25, 1.005, 72.05]
    for digits in (0, 1, 2):
        expected = [float(np.round(v, digits)) for v in values]
        assert column(spark, values, "double", lambda c: fn.round_half_even(c, digits)) == expected


def test_scale_truncates_toward_zero(spark):
    assert column(spark, [10.99, -10.99, 0.0, None], "double", lambda c: fn.scale_truncated(c, 1.0)) == [10, -10, 0, None]


def test_floor_divide_matches_python(spark):
    values = [7, -7, 0, 144, 2**61 + 1]
    assert column(spark, values, "bigint", lambda c: fn.floor_divide(c, 12)) == [v // 12 for v in values]


def test_midpoint_and_clip(spark):
    assert column(spark, [5, -5], "bigint", lambda c: fn.midpoint(c, F.lit(2))) == [3, -2]
    assert column(spark, [-1.0, 3.0, 9.0, None], "double", lambda c: fn.clip(c, 0.0, 5.0)) == [0.0, 3.0, 5.0, None]


def test_period_parts(spark):
    assert column(spark, [1200.0], "double", lambda c: fn.allocate_period(c, "month")) == [int(1200 / 12 * 0.9)]
    assert column(spark, [1200.0], "double", lambda c: fn.allocate_period(c, "quarter")) == [int(1200 / 4 * 0.88)]
    assert column(spark, [1200.0], "double", lambda c: fn.allocate_period(c, "week")) == [int(1200 * (0.9 / 4.33))]


def test_celsius(spark):
    assert column(spark, [0.0, 100.0, -40.0, 12.3], "double", fn.celsius_to_fahrenheit) == [32.0, 212.0, -40.0, 54.1]


def test_codes(spark):
    genders = ["Male", "Non-binary", "other", None]
    assert column(spark, genders, "string", lambda c: fn.lookup_code(c, GENDER_SHORT)) == ["M", "NB", None, None]
    assert column(spark, genders, "string", lambda c: fn.lookup_code(c, GENDER_CODE)) == [1, 2, None, None]
    assert column(spark, ["Luxury (500+)", "x"], "string", lambda c: fn.relabel(c, PRICE_TIER_EUR)) == ["Luxury (455+)", "x"]
    assert column(spark, ["Male"], "string", lambda c: fn.lookup_code_strict(c, GENDER_SHORT)) == ["M"]
    with pytest.raises(Exception, match="no code for other"):
        column(spark, genders, "string", lambda c: fn.lookup_code_strict(c, GENDER_SHORT))


def test_ids_are_padded_but_never_cut(spark):
    assert column(spark, [7, 123456], "bigint", lambda c: fn.fixed_width_id("P", c, 4)) == ["P0007", "P123456"]


def test_label_parsing(spark):
    replies = [
        " TYPE1_MEASURE \n", "it is type2 granularity.", "NO_CONFLICT_DUPLICATE or TYPE1_MEASURE", "", "none",
        "No conflict diff entity", None,
    ]
    assert column(spark, replies, "string", fn.parse_label) == [
        "TYPE1_MEASURE", "TYPE2_GRANULARITY", "TYPE1_MEASURE", "UNKNOWN", "UNKNOWN", "NO_CONFLICT_DIFF_ENTITY", "UNKNOWN",
    ]


def test_numbers_as_people_write_them(spark):
    values = [1.0, 12345678.5, 1e15, 0.00025, 0.1, 123456789012.0]
    assert column(spark, values, "double", lambda c: fn.as_text(c, T.DoubleType())) == [str(v) for v in values]
    assert column(spark, [5], "int", lambda c: fn.as_text(c, T.IntegerType())) == ["5"]


def test_text_helpers(spark):
    assert column(spark, [["a", "b"], []], "array<string>", fn.quoted_list) == ['"a", "b"', ""]
    assert column(spark, ['{"a": {"b": 1}}', "{}", None], "string", lambda c: fn.json_or_default(c, "$.a.b", "-")) == ["1", "-", "-"]
    assert column(spark, [3, None], "int", fn.or_unknown_mark) == ["3", "?"]


def test_doubles_with_an_exponent_read_as_printed(spark):
    values = [1e-5, 1e16, 2.5e16, -1e-7, 1.5e300, 1e-300, 0.0001, 123456789.0, 1e15, 0.5, 0.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(as_text(F.col("v"), df.schema["v"].dataType)).collect()] == [repr(v) for v in values]
