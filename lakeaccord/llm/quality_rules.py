"""Quality rules whose thresholds come from quantile sketches. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Size of a sketch; rows that a group needs for thresholds of its own; quartile distances beyond the quartiles.
SKETCH, GROUP_ROWS, FENCE = 1024, 30, 3.0

WHITE = r"[\x20\x09-\x0D]"
#: Measure -> (what it may be beyond the fence, whether small values are bad too).
MEASURES = {"symbol_share": (0.02, False), "line_share": (0.10, False), "repeat_share": (0.02, False), "word_length": (0.5, True)}


def _repeated(hashes: str, size: Column) -> Column:
    """Words in windows whose hash another window of the array has.

    Sorted by hash and place, such windows stand beside each other; their places
    in order then say how many words they cover together.
    """
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = size - WINDOW + 1
    nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    beside = F.zip_with(F.concat(nothing, F.slice(placed, F.lit(1), n - 1)), F.concat(F.slice(placed, F.lit(2), n - 1), nothing), lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b")))
    marked = F.zip_with(placed, beside, lambda x, y: F.when((x["h"] == y["a"]) | (x["h"] == y["b"]), x["i"]))
    places = F.array_sort(F.filter(marked, lambda p: p.isNotNull()))
    return F.aggregate(
        places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("words")),
        lambda s, p: F.struct(p.alias("last"), (s["words"] + F.least(F.lit(WINDOW), p - s["last"])).alias("words")), lambda s: s["words"],
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    words = F.filter(F.split("text", WHITE + "+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", "lang", "source", words.alias("words"), lines.alias("lines"),
        F.length(F.regexp_replace("text", WHITE + "+", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )
    rows = rows.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", F.size("words").cast("bigint").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    # windows by doubling: hashes of 1, 2 and 4 words, then of 4 and 1
    size = F.col("n_words").cast("int")
    for name, of, step in (("h2", "h", 1), ("h4", "h2", 2)):
        rows = rows.withColumn(name, F.zip_with(F.slice(of, F.lit(1), F.greatest(F.size(of) - step, F.lit(0))), F.slice(of, F.lit(step + 1), F.greatest(F.size(of) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("w", F.zip_with(F.slice("h4", F.lit(1), F.greatest(size - 4, F.lit(0))), F.slice("h", F.lit(5), F.greatest(size - 4, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    rows = rows.drop("h", "h2", "h4").withColumn("repeats", F.size(F.array_distinct("w")) < F.size("w"))
    repeated = F.when(F.col("repeats"), _repeated("w", size)).otherwise(F.lit(0).cast("bigint"))
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"))


def shares(measured: DataFrame) -> DataFrame:
    """The measures as figures that do not depend on a text's length; null without words."""
    some = lambda x: F.when(F.col("n_words") > 0, x)
    return measured.withColumns({
        "symbol_share": some(F.col("n_symbols") / F.col("word_chars")), "line_share": some(F.col("n_dup_lines") * 10.0 / (F.col("n_words") + 10)),
        "repeat_share": some(F.col("n_repeat_words") / F.col("n_words")), "word_length": some(F.col("word_chars") / F.col("n_words")),
    })


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source, and the lowest and highest allowed value of each measure.

    A sketch per measure and (language, source) is merged to one per language
    and one of all; each group uses the narrowest with GROUP_ROWS rows.
    """
    names = list(MEASURES)
    own = rows.where("n_words > 0").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(m, SKETCH).alias(m) for m in names))
    merged = lambda frame, level: [F.sum("n").alias(f"n_{level}"), *(F.kll_merge_agg_double(m, SKETCH).alias(f"{m}_{level}") for m in names)]
    by_lang = own.groupBy("lang").agg(*merged(own, "lang")).withColumnRenamed("lang", "of")
    every = own.agg(*merged(own, "all")).first()  # four sketches of bounded size
    groups = own.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left")
    out = []
    for m, (slack, both) in MEASURES.items():
        sketch = F.when(F.col("n") >= GROUP_ROWS, F.col(m)).when(F.col("n_lang") >= GROUP_ROWS, F.col(f"{m}_lang")).otherwise(F.lit(every[f"{m}_all"]))
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        out.append((high + FENCE * (high - low) + slack).alias(f"high_{m}"))
        out.append((low - FENCE * (high - low) - slack if both else F.lit(float("-inf"))).alias(f"low_{m}"))
    return groups.select(F.col("lang").alias("in_lang"), F.col("source").alias("in_source"), *out)


def apply(measured: DataFrame) -> DataFrame:
    """The measured rows with base_failed and kept.

    A text fails with fewer than LEAST_WORDS words, or more than MOST_REPEATED
    per cent of them in repeated windows. Others are kept if each measure lies
    within the fences of their language and source.

    A null or empty text has no words and fails. A null language or source is a
    group of its own. Repeated rows, and rows without doc_id, are judged each.
    An empty table gives no rows. Other columns are not read.
    """
    rows = shares(measured)
    limits = thresholds(rows)
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("in_lang")) & F.col("source").eqNullSafe(F.col("in_source")), "left")
    within = reduce(Column.__and__, ((F.col(m) <= F.col(f"high_{m}")) & (F.col(m) >= F.col(f"low_{m}")) for m in MEASURES))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return joined.select(*measured.columns, failed.alias("base_failed"), (~failed & F.coalesce(within, F.lit(True))).alias("kept"))
