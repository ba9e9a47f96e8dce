import statistics

import pytest
from pyspark.sql import functions as F

from lakeaccord.labels import LABELS, UNKNOWN
from lakeaccord.operators import evaluate as ev

A, B, C, D = LABELS


def expected_scores(pairs):
    """Plain restatement of the definitions."""
    out = {}
    for label in LABELS:
        tp = sum(t == p == label for t, p in pairs)
        predicted, true = sum(p == label for _, p in pairs), sum(t == label for t, _ in pairs)
        precision = tp / predicted if predicted else 0.0
        recall = tp / true if true else 0.0
        f1 = 2 * tp / (predicted + true) if predicted + true else 0.0
        out[label] = (precision, recall, f1, true)
    macro = [sum(out[label][i] for label in LABELS) / 4 for i in range(3)]
    return out, macro, sum(t == p for t, p in pairs) / len(pairs)


TRUE = [A, A, A, B, B, C, C, C, C, A]
PRED = {1: A, 2: A, 3: B, 4: B, 5: UNKNOWN, 6: C, 7: A, 8: "other", 99: A}  # 9 and 10 have none, 99 is no pair


@pytest.fixture(scope="module")
def frames(spark):
    truth = spark.createDataFrame(list(enumerate(TRUE, 1)), "pair_id int, label string")
    preds = [(i, p, "m", "D", 1) for i, p in PRED.items()] + [(99, A, "m", "L", 1)]
    return truth, spark.createDataFrame(preds, "pair_id int, pred string, model string, combo string, run int")


RUN = ["model", "combo", "run"]


def test_scores_count_missing_predictions_as_wrong(frames):
    truth, preds = frames
    pairs = [(t, PRED.get(i, UNKNOWN)) for i, t in enumerate(TRUE, 1)]
    classes, macro, accuracy = expected_scores(pairs)
    scores = ev.scores_of(truth, preds, RUN)
    report = {r["label"]: r for r in ev.class_report(scores, RUN).filter("combo = 'D'").collect()}
    for label in LABELS:
        precision, recall, f1, support = classes[label]
        r = report[label]
        assert (r["precision"], r["recall"], r["f1"], r["support"]) == (round(precision, 4), round(recall, 4), round(f1, 4), support)
    assert report[D]["f1"] == 0.0  # no true and no predicted rows, still in the macro mean
    m = ev.macro_report(scores, RUN).filter("combo = 'D'").first()
    assert m["n_pairs"] == 10 and m["accuracy"] == accuracy
    assert [m["macro_precision"], m["macro_recall"], m["macro_f1"]] == [round(x, 4) for x in macro]
    lost = ev.macro_report(scores, RUN).filter("combo = 'L'").first()
    assert lost["n_pairs"] == 10 and lost["accuracy"] == lost["macro_f1"] == 0.0


def test_joined_predictions_and_todo(frames):
    truth, preds = frames
    one = preds.filter("combo = 'D'")
    got = {r["pair_id"]: r["pred"] for r in ev.with_predictions(truth, one).collect()}
    assert got[9] == got[10] == UNKNOWN and got[8] == "other" and len(got) == 10
    assert {r["pair_id"] for r in ev.todo_pairs(truth, one, ["pair_id"]).collect()} == {9, 10}
    counts = {(r["label"], r["pred"]): r["n"] for r in ev.confusion_counts(truth, one, RUN).collect()}
    assert counts[(A, A)] == 2 and sum(counts.values()) == 8


def test_distribution(frames):
    got = {r["label"]: (r["pairs"], r["percent"]) for r in ev.label_distribution(frames[0]).collect()}
    assert got == {A: (4, 40.0), B: (2, 20.0), C: (4, 40.0)}


def test_summary_order_and_best(spark):
    rows = [("m", "DLSV", 0.5), ("m", "V", 0.7), ("m", "DL", 0.7), ("m", "D", 0.6), ("n", "DS", 0.4), ("n", "DL", 0.4)]
    summary = spark.createDataFrame(rows, "model string, combo string, macro_f1 double").withColumn("accuracy", F.col("macro_f1"))
    assert [r["combo"] for r in ev.in_combo_order(summary.filter("model = 'm'")).collect()] == ["D", "V", "DL", "DLSV"]
    assert {r["model"]: r["combo"] for r in ev.best_combo(summary).collect()} == {"m": "V", "n": "DL"}
    wide = {r["combo"]: r for r in ev.compare_models(summary, ["m", "n"]).collect()}
    assert wide["DL"]["m_macro_f1"] == 0.7 and wide["DL"]["n_accuracy"] == 0.4 and wide["V"]["n_accuracy"] is None


def test_mean_and_population_deviation(spark):
    values = [0.8463, 0.8421, 0.8579, 0.8368]
    runs = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "run int, accuracy double")
    for name in ev.MACRO[1:]:
        runs = runs.withColumn(name, F.col("accuracy"))
    r = ev.mean_and_std(runs.withColumn("model", F.lit("m")), ["model"], "n_runs").first()
    assert r["n_runs"] == 4
    assert r["accuracy_mean"] == round(statistics.fmean(values), 4) and r["accuracy_std"] == round(statistics.pstdev(values), 4)


def test_sizes_keep_every_run(spark):
    truth = spark.createDataFrame([(i, LABELS[i % 3]) for i in range(90)], "pair_id int, label string")
    preds = spark.createDataFrame([(i, LABELS[i % 3], "m", "D") for i in range(90)] + [(0, A, "m", "V")], "pair_id int, pred string, model string, combo string")
    got = {(r["combo"], r["size"]): r for r in ev.size_summary(truth, preds, [9, 30, 90], ["model", "combo"]).collect()}
    assert len(got) == 6
    assert [got[("D", n)]["n_pairs"] for n in (9, 30, 90)] == [9, 30, 90] == [got[("V", n)]["n_pairs"] for n in (9, 30, 90)]
    assert all(got[("D", n)]["accuracy"] == 1.0 and got[("D", n)]["macro_f1"] == 0.75 for n in (9, 30, 90))
    assert got[("V", 90)]["accuracy"] == round(1 / 90, 4)


def test_folds_and_pooled(spark):
    rows = [(A, A, 0), (A, B, 0), (B, B, 1), (B, B, 1)]
    per_fold, pooled = ev.fold_scores(spark.createDataFrame(rows, "label string, pred string, fold int"), [])
    assert {r["fold"]: r["accuracy"] for r in per_fold.collect()} == {0: 0.5, 1: 1.0}
    assert pooled.first()["accuracy"] == 0.75 and pooled.first()["n_pairs"] == 4
