"""Evaluation of predicted labels: every report is made from confusion counts.

Predictions are reduced to (run, true label, predicted label) counts in one
map-side aggregate; all later steps work on a handful of rows per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import order_hash
from ..labels import LABELS, UNKNOWN
from .ranking import keep_smallest, rank_by_hash
from .sampling import SEED

MACRO = ["accuracy", "macro_precision", "macro_recall", "macro_f1"]
DIGITS = 4


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percent (one digit) per label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("pairs"))
    total = counts.agg(F.sum("pairs")).scalar()
    return counts.withColumn("percent", F.bround(F.col("pairs") / total * F.lit(100.0), 1))


def with_predictions(truth: DataFrame, predictions: DataFrame, key: str = "pair_id") -> DataFrame:
    """Every pair with its prediction; UNKNOWN where there is none."""
    preds = predictions.select(F.col(key).alias("_key"), "pred")
    joined = truth.join(preds, truth[key] == preds["_key"], "left").drop("_key")
    return joined.withColumn("pred", F.coalesce("pred", F.lit(UNKNOWN)))


def todo_pairs(pairs: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that have no prediction yet."""
    return pairs.join(predictions.select(*keys), keys, "left_anti")


def _counts(truth: DataFrame, predictions: DataFrame, run: list[str], key: str, more: list[str]) -> DataFrame:
    """Rows per (run, label, pred); predictions for other pairs have a null label.

    They are kept so that a run of which no pair is in the truth is still a run.
    """
    known = truth.select(F.col(key).alias("_key"), "label", *more)
    joined = predictions.join(known, predictions[key] == known["_key"], "left")
    return joined.groupBy(*run, *more, "label", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_counts(truth: DataFrame, predictions: DataFrame, run: list[str], key: str = "pair_id") -> DataFrame:
    """Rows per (run, label, pred), without the pairs a run has no prediction for."""
    return _counts(truth, predictions, run, key, []).filter(F.col("label").isNotNull())


def _supports(truth: DataFrame) -> dict[str, Column]:
    """Pairs per label and in all: one aggregate over the truth, read as one scalar struct."""
    counts = [F.count_if(F.col("label") == label).alias(label) for label in LABELS]
    found = truth.agg(F.struct(*counts, F.count(F.lit(1)).alias("all")).alias("s")).scalar()
    return {name: found[name] for name in [*LABELS, "all"]}


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def run_scores(counts: DataFrame, run: list[str], supports: dict[str, Column] | None = None) -> DataFrame:
    """One row per run with unrounded scores per label, macro means and accuracy.

    ``supports`` counts the pairs of each label; pairs without a prediction are
    in it and lower recall and accuracy. Without it ``counts`` must hold all pairs.
    """
    hits = F.col("label") == F.col("pred")
    sums = [F.sum(F.when(hits, F.col("n")).otherwise(0)).alias("_correct"), F.sum("n").alias("_all")]
    for i, label in enumerate(LABELS):
        sums += [
            F.sum(F.when(hits & (F.col("label") == label), F.col("n")).otherwise(0)).alias(f"_tp{i}"),
            F.sum(F.when(F.col("pred") == label, F.col("n")).otherwise(0)).alias(f"_pred{i}"),
            F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)).alias(f"_true{i}"),
        ]
    wide = counts.withColumn("n", F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0)).groupBy(*run).agg(*sums)
    if supports:
        wide = wide.withColumns({f"_true{i}": supports[label] for i, label in enumerate(LABELS)} | {"_all": supports["all"]})
    scores = {}
    for i, label in enumerate(LABELS):
        tp, predicted, true = F.col(f"_tp{i}"), F.col(f"_pred{i}"), F.col(f"_true{i}")
        scores[f"{label}_p"] = _ratio(tp, predicted)
        scores[f"{label}_r"] = _ratio(tp, true)
        scores[f"{label}_f1"] = _ratio(tp * 2, predicted + true)
        scores[f"{label}_support"] = true
    wide = wide.withColumns(scores)
    for short, name in (("p", "precision"), ("r", "recall"), ("f1", "f1")):
        total = sum((F.col(f"{label}_{short}") for label in LABELS[1:]), F.col(f"{LABELS[0]}_{short}"))
        wide = wide.withColumn(f"macro_{name}", total / F.lit(float(len(LABELS))))
    kept = [f"{label}_{part}" for label in LABELS for part in ("p", "r", "f1", "support")]
    return wide.withColumn("accuracy", _ratio(F.col("_correct"), F.col("_all"))).withColumn("n_pairs", F.col("_all")).select(
        *run, "n_pairs", *MACRO, *kept
    )


def scores_of(truth: DataFrame, predictions: DataFrame, run: list[str], key: str = "pair_id") -> DataFrame:
    return run_scores(_counts(truth, predictions, run, key, []), run, _supports(truth))


def _rounded(name: str) -> Column:
    return F.bround(F.col(name), DIGITS).alias(name)


def class_report(scores: DataFrame, run: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per run and label."""
    cells = F.array(*[
        F.struct(
            F.lit(label).alias("label"), F.bround(f"{label}_p", DIGITS).alias("precision"),
            F.bround(f"{label}_r", DIGITS).alias("recall"), F.bround(f"{label}_f1", DIGITS).alias("f1"),
            F.col(f"{label}_support").alias("support"),
        )
        for label in LABELS
    ])
    return scores.select(*run, F.inline(cells))


def macro_report(scores: DataFrame, run: list[str]) -> DataFrame:
    """Accuracy and macro means per run, rounded."""
    return scores.select(*run, "n_pairs", *[_rounded(m) for m in MACRO])


def summary_rows(scores: DataFrame, run: list[str]) -> DataFrame:
    """One wide row per run: macro figures and all class figures, rounded."""
    classes = [f"{label}_{part}" for label in LABELS for part in ("p", "r", "f1")]
    return scores.select(*run, "n_pairs", *[_rounded(m) for m in MACRO + classes])


def with_sources(summary: DataFrame) -> DataFrame:
    """Adds ``sources``, the letters of the combination as an array."""
    return summary.withColumn("sources", F.split("combo", ""))


def in_combo_order(summary: DataFrame, *first: str) -> DataFrame:
    """Short combinations first, then by name."""
    return summary.orderBy(*first, F.length("combo"), "combo")


def mean_and_std(rounded: DataFrame, group: list[str], count: str) -> DataFrame:
    """Mean and population deviation over runs or folds, from rounded scores."""
    parts = [F.count(F.lit(1)).alias(count)]
    for name in MACRO:
        parts += [
            F.bround(F.avg(name), DIGITS).alias(f"{name}_mean"),
            F.bround(F.stddev_pop(name), DIGITS).alias(f"{name}_std"),
        ]
    return rounded.groupBy(*group).agg(*parts)


def with_earlier_run(runs: DataFrame, summary: DataFrame, combo: str, run: int = 1) -> DataFrame:
    """Fresh runs of one combination plus its row of an earlier summary as one more run."""
    earlier = summary.filter(F.col("combo") == combo)
    parts = [
        df.select("model", "combo", F.lit(number).cast("int").alias("run") if number else "run", F.lit(source).alias("source"), *MACRO)
        for df, number, source in ((earlier, run, "earlier summary"), (runs.filter(F.col("combo") == combo), None, "fresh run"))
    ]
    return parts[0].unionByName(parts[1])


def compare_models(summary: DataFrame, models: list[str]) -> DataFrame:
    """Models side by side per combination."""
    wide = summary.groupBy("combo").pivot("model", models).agg(
        F.first("accuracy").alias("accuracy"), F.first("macro_f1").alias("macro_f1")
    )
    return wide.select("combo", *[c for m in models for c in (f"{m}_accuracy", f"{m}_macro_f1")])


def best_combo(summary: DataFrame) -> DataFrame:
    """Per model the combination with the highest macro F1; the first in combo order on a tie."""
    order = F.struct(F.col("macro_f1"), -F.length("combo"), F.struct(*[-F.ascii(F.substring("combo", i, 1)) for i in range(1, 5)]))
    best = F.max_by(F.struct("combo", "macro_f1", "accuracy"), order).alias("b")
    return summary.groupBy("model").agg(best).select("model", "b.*")


def fold_scores(labelled: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions (label, pred, fold) -> rounded scores per fold, pooled scores."""
    counts = labelled.groupBy(*group, "fold", "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    per_fold = macro_report(run_scores(counts, [*group, "fold"]), [*group, "fold"])
    pooled = run_scores(counts.groupBy(*group, "label", "pred").agg(F.sum("n").alias("n")), group)
    return per_fold, pooled


def size_members(truth: DataFrame, sizes: list[int], key: str = "pair_id", seed: int = SEED) -> DataFrame:
    """The stratified sample of every size, each row marked with its ``size``.

    The same rows as one :func:`stratified_sample` per size, from one ranking.
    """
    total = truth.agg(F.count(F.lit(1))).scalar()
    keyed = truth.withColumn("_pick", order_hash(seed, F.col(key)))
    ranked = rank_by_hash(keyed, ["label"], "_pick", "_rank", group_rows="_of")
    wanted = F.bround(F.col("_of") * F.col("size").cast("double") / total, 0).cast("bigint")
    picked = (
        ranked.select("*", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("size"))
        .filter(F.col("_rank") <= F.greatest(F.lit(1).cast("bigint"), wanted))
        .withColumn("_mix", order_hash(f"{seed}-mix", F.col(key)))
    )
    cut = keep_smallest(picked, ["size"], "_mix", F.col("_group.size").cast("bigint"))
    return cut.drop("_pick", "_rank", "_of", "_mix")


def size_summary(truth: DataFrame, predictions: DataFrame, sizes: list[int], run: list[str]) -> DataFrame:
    """Summary rows per run and sample size; predictions are joined once for all sizes."""
    members = size_members(truth, sizes)
    keys = [*run, "size"]
    counts = _counts(members, predictions, run, "pair_id", ["size"])
    every_size = F.explode(F.array(*[F.lit(n) for n in sizes])).alias("size")
    empty = counts.select(*run).distinct().select(
        *run, every_size, F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("pred"),
        F.lit(0).cast("bigint").alias("n"),
    )
    per_size = members.groupBy("size").agg(
        F.struct(*[F.count_if(F.col("label") == label).alias(label) for label in LABELS], F.count(F.lit(1)).alias("all")).alias("s")
    )
    # One entry per sample size: the map is as long as the list of sizes.
    by_size = per_size.agg(F.map_from_entries(F.collect_list(F.struct("size", "s"))).alias("m")).scalar()
    filled = counts.filter(F.col("size").isNotNull()).unionByName(empty)
    supports = {name: F.element_at(by_size, F.col("size"))[name] for name in [*LABELS, "all"]}
    return summary_rows(run_scores(filled, keys, supports), keys)
