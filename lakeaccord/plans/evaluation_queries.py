"""Reports on predictions derived from the documents and their labels.

The truth of a document is its (quality, toxic) pair read as one of the four
labels. Predictions come from a rule that may look at four sources: V the text,
S its length, D its language, L its origin. A subset of the sources is a combo;
a model is an order in which the sources are asked; a run moves the length limit.
"""

from pyspark.sql import functions as F

from ..functions.text import parse_label
from ..labels import DIFF_ENTITY, DUPLICATE, LABELS, TYPE1, TYPE2
from ..operators import evaluate as ev
from ..operators.evidence import evidence_text, with_subsets
from ..operators.sampling import stratified_folds
from ..session import fresh_path
from ..sources.lake import table
from ..sources.results import read_predictions, read_summary, row_of_combo, settled_predictions, write_summary
from ..streaming.incremental import label_unseen, open_runs, run_factorial
from . import shards
from .evidence_queries import _EVIDENCE, subset_blocks

# The order in which each model asks the sources, and the rule of each source.
MODELS = {"long_first": "SVLD", "lang_first": "DLVS", "text_first": "VDSL"}
LENGTH_STEP = 1500
REPLY = {
    "S": "TYPE1_MEASURE",
    "V": "no conflict diff entity",
    "L": "I say type2 granularity",
    "D": "Label: NO_CONFLICT_DUPLICATE.",
}


def truth(spark, folder):
    quality, toxic = F.col("quality") == 1, F.col("toxic") == 1
    label = (
        F.when(quality & ~toxic, F.lit(DUPLICATE)).when(quality & toxic, F.lit(TYPE1))
        .when(~quality & ~toxic, F.lit(TYPE2)).otherwise(F.lit(DIFF_ENTITY))
    )
    return table(spark, folder, "labels").select("doc_id", label.alias("label")).withColumnRenamed("doc_id", "pair_id")


def _fires(letter, limit=None):
    """Whether the rule of one source has an answer for a document."""
    return {
        "S": F.col("n_chars") > limit,
        "V": F.col("text").contains("@"),
        "L": F.col("source").isin("src0", "src1", "src2", "src3"),
        "D": F.col("lang") == "en",
    }[letter]


def predictions(spark, folder, runs=1):
    """(pair_id, combo, model, run, pred); a silent model gives no row."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("pair_id"), "text", "lang", "source", "n_chars")
    signals = documents.select("pair_id", "n_chars", *[_fires(letter).alias(letter) for letter in "VLD"])
    cells = F.array(*[
        F.struct(F.lit(model).alias("model"), F.lit(run).alias("run")) for model in MODELS for run in range(1, runs + 1)
    ])
    factorial = with_subsets(signals).select("*", F.inline(cells))
    fires = {"V": F.col("V"), "L": F.col("L"), "D": F.col("D"), "S": F.col("n_chars") > F.col("run") * LENGTH_STEP}
    answer = None
    for model, order in MODELS.items():
        said = F.coalesce(*[F.when(F.contains("combo", F.lit(c)) & fires[c], F.lit(REPLY[c])) for c in order])
        answer = F.when(F.col("model") == model, said) if answer is None else answer.when(F.col("model") == model, said)
    return (
        factorial.withColumn("reply", answer).filter(F.col("reply").isNotNull())
        .select("pair_id", "combo", "model", "run", parse_label(F.col("reply")).alias("pred"))
    )


RUN = ["model", "combo", "run"]

# --- the same in SQL -------------------------------------------------------

_COMBO_CTE = "combos AS (SELECT " + " || ".join(
    f"CASE WHEN (b >> {i}) & 1 = 1 THEN '{letter}' ELSE '' END" for i, letter in enumerate("DLSV")
) + " AS combo FROM range(1, 16) t(b))"
_PARSED = {"S": TYPE1, "V": DIFF_ENTITY, "L": TYPE2, "D": DUPLICATE}
_FIRES = {
    "S": f"n_chars > run * {LENGTH_STEP}", "V": "contains(text, '@')",
    "L": "source IN ('src0', 'src1', 'src2', 'src3')", "D": "lang = 'en'",
}


def _cte(runs: int = 1) -> str:
    arms = " ".join(
        f"WHEN '{model}' THEN CASE " + " ".join(
            f"WHEN contains(combo, '{c}') AND {_FIRES[c]} THEN '{_PARSED[c]}'" for c in order
        ) + " END"
        for model, order in MODELS.items()
    )
    models = ", ".join(f"('{m}')" for m in MODELS)
    return f"""truth AS (SELECT doc_id AS pair_id, CASE WHEN quality = 1 AND toxic = 0 THEN '{DUPLICATE}'
    WHEN quality = 1 THEN '{TYPE1}' WHEN toxic = 0 THEN '{TYPE2}' ELSE '{DIFF_ENTITY}' END AS label FROM labels),
{_COMBO_CTE}, models AS (SELECT * FROM (VALUES {models}) m(model)), runs AS (SELECT r::INTEGER AS run FROM range(1, {runs + 1}) t(r)),
raw AS (SELECT doc_id AS pair_id, combo, model, run, CASE model {arms} END AS pred
  FROM documents CROSS JOIN combos CROSS JOIN models CROSS JOIN runs),
predictions AS (SELECT * FROM raw WHERE pred IS NOT NULL)"""


def _scores_sql(members: str = "truth", keys: str = "model, combo, run") -> str:
    """Class and macro scores from pairs joined to predictions, missing ones UNKNOWN."""
    size_column = ", size" if members != "truth" else ""
    classes, macro = [], []
    for i, label in enumerate(LABELS):
        tp = f"count(*) FILTER (label = '{label}' AND pred = '{label}')"
        predicted = f"count(*) FILTER (pred = '{label}')"
        true = f"count(*) FILTER (label = '{label}')"
        classes += [
            f"coalesce({tp}::DOUBLE / nullif({predicted}, 0), 0) AS {label}_p",
            f"coalesce({tp}::DOUBLE / nullif({true}, 0), 0) AS {label}_r",
            f"coalesce(({tp} * 2)::DOUBLE / nullif({predicted} + {true}, 0), 0) AS {label}_f1",
            f"{true} AS {label}_support",
        ]
    for short, name in (("p", "precision"), ("r", "recall"), ("f1", "f1")):
        macro.append("(" + " + ".join(f"{label}_{short}" for label in LABELS) + f") / 4.0::DOUBLE AS macro_{name}")
    return f"""joined AS (SELECT f.model, f.combo, f.run{size_column}, t.pair_id, t.label, coalesce(p.pred, 'UNKNOWN') AS pred
  FROM {members} t CROSS JOIN (SELECT DISTINCT model, combo, run FROM predictions) f
  LEFT JOIN predictions p ON p.pair_id = t.pair_id AND p.model = f.model AND p.combo = f.combo AND p.run = f.run),
classes AS (SELECT {keys}, count(*) AS n_pairs, count(*) FILTER (label = pred)::DOUBLE / count(*) AS accuracy, {', '.join(classes)}
  FROM joined GROUP BY {keys}),
scores AS (SELECT *, {', '.join(macro)} FROM classes)"""


def _r(name: str) -> str:
    return f"round_even({name}, 4) AS {name}"


_MACRO = ", ".join(_r(m) for m in ev.MACRO)
_CLASS = ", ".join(_r(f"{label}_{part}") for label in LABELS for part in ("p", "r", "f1"))

# --- queries ---------------------------------------------------------------


def label_distribution(spark, folder):
    return ev.label_distribution(truth(spark, folder))


DISTRIBUTION_SQL = f"""WITH {_cte()} SELECT label, count(*) AS pairs,
  round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100.0::DOUBLE, 1) AS percent FROM truth GROUP BY label"""


def truth_with_predictions(spark, folder):
    one = predictions(spark, folder).filter((F.col("model") == "long_first") & (F.col("combo") == "LV"))
    return ev.with_predictions(truth(spark, folder), one)


JOINED_SQL = f"""WITH {_cte()} SELECT t.pair_id, t.label, coalesce(pred, 'UNKNOWN') AS pred FROM truth t
LEFT JOIN (SELECT * FROM predictions WHERE model = 'long_first' AND combo = 'LV') p ON p.pair_id = t.pair_id"""


def todo(spark, folder):
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("pair_id"), "lang", "source")
    done = predictions(spark, folder).filter((F.col("model") == "lang_first") & (F.col("combo") == "DL"))
    return ev.todo_pairs(documents, done, ["pair_id"])


TODO_SQL = f"""WITH {_cte()} SELECT doc_id AS pair_id, lang, source FROM documents WHERE doc_id NOT IN
(SELECT pair_id FROM predictions WHERE model = 'lang_first' AND combo = 'DL')"""


def confusion(spark, folder):
    return ev.confusion_counts(truth(spark, folder), predictions(spark, folder), RUN)


CONFUSION_SQL = f"""WITH {_cte()} SELECT model, combo, run, label, pred, count(*) AS n
FROM predictions JOIN truth USING (pair_id) GROUP BY ALL"""


def _scores(spark, folder, runs=1):
    return ev.scores_of(truth(spark, folder), predictions(spark, folder, runs), RUN)


def class_report(spark, folder):
    return ev.class_report(_scores(spark, folder), RUN)


CLASS_SQL = f"WITH {_cte()}, {_scores_sql()}\n" + "\nUNION ALL\n".join(
    f"""SELECT model, combo, run, '{label}' AS label, round_even({label}_p, 4) AS precision,
  round_even({label}_r, 4) AS recall, round_even({label}_f1, 4) AS f1, {label}_support AS support FROM scores"""
    for label in LABELS
)


def macro_report(spark, folder):
    return ev.macro_report(_scores(spark, folder), RUN)


MACRO_SQL = f"WITH {_cte()}, {_scores_sql()} SELECT model, combo, run, n_pairs, {_MACRO} FROM scores"


def summary(spark, folder):
    rows = ev.with_sources(ev.summary_rows(_scores(spark, folder), RUN))
    return ev.in_combo_order(rows.withColumn("sources", F.array_join("sources", "+")), "model")


SUMMARY_SQL = f"WITH {_cte()}, {_scores_sql()} SELECT model, combo, array_to_string(regexp_extract_all(combo, '.'), '+') AS sources, run, n_pairs, {_MACRO}, {_CLASS} FROM scores ORDER BY model, length(combo), combo"


def summary_round_trip(spark, folder):
    """Summary rows written as JSON, one combination of each model read back."""
    path = fresh_path(spark, "summary")
    rows = ev.macro_report(_scores(spark, folder), RUN)
    write_summary(rows, path)
    back = read_summary(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))
    parts = [row_of_combo(back.filter(F.col("model") == model), "DLS") for model in MODELS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


TRIP_SQL = f"WITH {_cte()}, {_scores_sql()} SELECT model, combo, run, n_pairs, {_MACRO} FROM scores WHERE combo = 'DLS'"


def model_comparison(spark, folder):
    rows = ev.macro_report(_scores(spark, folder), RUN)
    return ev.compare_models(rows, list(MODELS))


_SIDE = ", ".join(
    f"max(round_even({v}, 4)) FILTER (model = '{m}') AS {m}_{v}" for m in MODELS for v in ("accuracy", "macro_f1")
)
COMPARISON_SQL = f"WITH {_cte()}, {_scores_sql()} SELECT combo, {_SIDE} FROM scores GROUP BY combo"


def best_combo(spark, folder):
    return ev.best_combo(ev.macro_report(_scores(spark, folder), RUN))


BEST_SQL = f"""WITH {_cte()}, {_scores_sql()}, r AS (SELECT model, combo, {_MACRO} FROM scores)
SELECT model, combo, macro_f1, accuracy FROM r
QUALIFY row_number() OVER (PARTITION BY model ORDER BY macro_f1 DESC, length(combo), combo) = 1"""


# Sample sizes; the smallest lake has fewer labels than the largest size.
SIZES = [60, 150, 390]


def size_robustness(spark, folder):
    out = ev.size_summary(truth(spark, folder), predictions(spark, folder), SIZES, RUN)
    return ev.in_combo_order(out, "model", "size")


_STRATA = "strata AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || pair_id)) AS rn FROM truth)"
_MEMBERS = "members AS (" + "\nUNION ALL\n".join(
    f"""(SELECT pair_id, label, {size} AS size FROM strata WHERE rn <= greatest(1, round_even(n * {size}.0::DOUBLE / total, 0))
  ORDER BY md5('42-mix|' || pair_id) LIMIT {size})"""
    for size in SIZES
) + ")"
SIZE_SQL = f"""WITH {_cte()}, {_STRATA}, {_MEMBERS}, {_scores_sql("members", "model, combo, run, size")}
SELECT model, combo, run, size, n_pairs, {_MACRO}, {_CLASS} FROM scores"""

RUNS = 5


def repeat_summary(spark, folder):
    """Five runs per model and combination: mean and deviation of the rounded scores."""
    rows = ev.macro_report(_scores(spark, folder, RUNS), RUN)
    return ev.mean_and_std(rows, ["model", "combo"], "n_runs")


_MEANS = ", ".join(
    f"round_even(avg({m}), 4) AS {m}_mean, round_even(stddev_pop({m}), 4) AS {m}_std" for m in ev.MACRO
)
REPEAT_SQL = f"""WITH {_cte(RUNS)}, {_scores_sql()}, r AS (SELECT model, combo, run, {_MACRO} FROM scores)
SELECT model, combo, count(*) AS n_runs, {_MEANS} FROM r GROUP BY model, combo"""


def repeat_with_history(spark, folder):
    """Run one of each model taken from a stored summary, runs two to five evaluated anew."""
    path = fresh_path(spark, "history")
    first = ev.macro_report(_scores(spark, folder), RUN)
    write_summary(first, path)
    earlier = read_summary(spark, path, first.schema.simpleString()[7:-1].replace(":", " "))
    fresh = ev.macro_report(_scores(spark, folder, RUNS), RUN).filter(F.col("run") > 1)
    runs = ev.with_earlier_run(fresh, earlier, "DLS")
    sources = runs.groupBy("model").agg(F.count_if(F.col("source") == "earlier summary").alias("earlier_runs"))
    return ev.mean_and_std(runs, ["model", "combo"], "n_runs").join(sources, "model")


HISTORY_SQL = f"""WITH {_cte(RUNS)}, {_scores_sql()}, r AS (SELECT model, combo, run, {_MACRO} FROM scores WHERE combo = 'DLS')
SELECT model, combo, count(*) AS n_runs, {_MEANS}, count(*) FILTER (run = 1) AS earlier_runs FROM r GROUP BY model, combo"""


def _folded(spark, folder):
    preds = predictions(spark, folder).filter(F.col("combo") == "DLSV")
    folds = stratified_folds(truth(spark, folder), "label", ["pair_id"])
    labelled = folds.select("*", F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"))
    joined = labelled.join(preds.select("pair_id", "model", "pred"), ["pair_id", "model"], "left")
    return joined.withColumn("pred", F.coalesce("pred", F.lit("UNKNOWN")))


def fold_summary(spark, folder):
    per_fold, _ = ev.fold_scores(_folded(spark, folder), ["model"])
    return ev.mean_and_std(per_fold, ["model"], "n_folds")


def pooled_report(spark, folder):
    _, pooled = ev.fold_scores(_folded(spark, folder), ["model"])
    return ev.class_report(pooled, ["model"])


_FOLD_TRUTH = "folds AS (SELECT pair_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('42|' || pair_id)) - 1) % 5) AS size FROM truth)"
FOLD_SQL = f"""WITH {_cte()}, {_FOLD_TRUTH}, {_scores_sql("folds", "model, combo, run, size")},
r AS (SELECT model, size, {_MACRO} FROM scores WHERE combo = 'DLSV')
SELECT model, count(*) AS n_folds, {_MEANS} FROM r GROUP BY model"""
POOLED_SQL = f"WITH {_cte()}, {_scores_sql()}\n" + "\nUNION ALL\n".join(
    f"""SELECT model, '{label}' AS label, round_even({label}_p, 4) AS precision, round_even({label}_r, 4) AS recall,
  round_even({label}_f1, 4) AS f1, {label}_support AS support FROM scores WHERE combo = 'DLSV'""" for label in LABELS
)


def _rule(order, combo, run):
    limit = F.lit(run * LENGTH_STEP)

    def label(pairs):
        answers = [F.when(_fires(letter, limit), F.lit(REPLY[letter])) for letter in order if letter in combo]
        said = F.coalesce(*answers, F.lit("cannot tell"))
        return pairs.select("pair_id", parse_label(said).alias("pred"))

    return label


class _Down(Exception):
    """The labeller of a test run has stopped."""


CHUNKS, STOPPED_AFTER = 5, 2


def _stops(label, after: int):
    """The labeller, but it fails when it is asked for one more chunk than ``after``."""
    calls = []

    def run(todo):
        calls.append(1)
        if len(calls) > after:
            raise _Down
        return label(todo)

    return run


def resume_run(spark, folder):
    """A run that stops in its third chunk is continued over all pairs; finished runs cost nothing."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("pair_id"), "text", "lang", "source", "n_chars")
    path = fresh_path(spark, "predictions")
    rule = lambda model, combo, run: _rule(MODELS[model], combo, run)
    chunk = -(-documents.count() // CHUNKS)
    try:
        label_unseen(documents, _stops(rule("long_first", "DS", 1), STOPPED_AFTER), path, "long_first", "DS", 1, chunk)
    except _Down:
        pass
    kept = read_predictions(spark, path).count()
    run_factorial(documents, rule, path, ["long_first", "text_first"], ["DS"], chunk_rows=chunk)
    again = run_factorial(documents, rule, path, ["long_first", "text_first"], ["DS"], chunk_rows=chunk)
    wanted = documents.select(
        F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"), F.lit("DS").alias("combo"), F.lit(1).alias("run")
    ).distinct()
    left = open_runs(spark, wanted, documents, path).withColumn("pair_id", F.lit(None).cast("bigint")).withColumn(
        "pred", F.concat(F.lit(f"open, {kept} kept by the stopped run, relabelled "), F.lit(str(again)))
    )
    done = settled_predictions(spark, path).withColumn("pair_id", F.col("pair_id").cast("bigint"))
    return done.unionByName(left.select(done.columns))


RESUME_SQL = f"""WITH {_cte()}
SELECT pair_id, coalesce(pred, 'UNKNOWN') AS pred, model, combo, run FROM raw WHERE combo = 'DS' AND model <> 'lang_first'
UNION ALL SELECT NULL, 'open, ' || count(*) || ' kept by the stopped run, relabelled 0', 'lang_first', 'DS', 1
FROM documents, (SELECT (count(*) + ceil(count(*) / {CHUNKS}) - 1)::BIGINT // ceil(count(*) / {CHUNKS})::BIGINT AS k FROM documents)
WHERE ('0x' || md5('chunk|' || doc_id)[1:8])::BIGINT % k < {STOPPED_AFTER}"""


# --- a whole run: evidence, labeller, append, resumption, summary ----------


def _read_evidence(texts):
    """A labeller that reads nothing but evidence texts."""
    text = F.col("text")
    name = lambda side: F.regexp_extract(text, rf"(?m)^{side}: [^.]+\.(\S+)$", 1)
    said = (
        F.when(name("A") == name("B"), F.lit("Label: NO_CONFLICT_DUPLICATE."))
        .when((name("B") == "price_month") & text.contains("Monthly price"), F.lit("I say type2 granularity"))
        .when((name("A") == "price_usd") & (name("B") == "price_eur") & text.contains(", mean="), F.lit("TYPE1_MEASURE"))
        .when(((name("A") == "quantity") | (name("B") == "quantity")) & text.contains("sample values: ["), F.lit("no conflict diff entity"))
        .otherwise(F.lit("cannot tell"))
    )
    return texts.select("pair_id", parse_label(said).alias("pred"))


def labelling_run(spark, folder):
    """Evidence texts of all pairs and combinations, labelled, stopped, resumed and summed up."""
    path = fresh_path(spark, "labelling")
    subsets = subset_blocks(spark, folder)
    subsets.select("combo", F.col("id").alias("pair_id"), "label", evidence_text().alias("text")).write.partitionBy("combo").parquet(f"{path}/texts")
    texts = spark.read.schema("pair_id string, label string, text string, combo string").parquet(f"{path}/texts")
    pairs = texts.filter(F.col("combo") == "S").select("pair_id", "label")
    # The rule reads each text where it lies; labels, not texts, are dealt out to meet the open pairs.
    rule = lambda model, combo, run: lambda todo: _read_evidence(texts.filter(F.col("combo") == combo)).join(todo.select("pair_id"), "pair_id")
    label_unseen(pairs.filter(F.col("label") == TYPE1), rule("reader", "DS", 1), f"{path}/predictions", "reader", "DS", 1)
    combos = sorted("".join(c for i, c in enumerate("DLSV") if bits >> i & 1) for bits in range(1, 16))
    run_factorial(pairs, rule, f"{path}/predictions", ["reader"], combos)
    again = run_factorial(pairs, rule, f"{path}/predictions", ["reader"], combos)
    done = read_predictions(spark, f"{path}/predictions")
    rows = ev.with_sources(ev.summary_rows(ev.scores_of(pairs, done, RUN), RUN)).withColumn("sources", F.array_join("sources", "+"))
    return ev.in_combo_order(rows.withColumn("relabelled", F.lit(again)))


_NAMES = "CASE WHEN col_a = col_b THEN '{dup}' WHEN col_b = 'price_month' AND contains(text, 'Monthly price') THEN '{t2}' WHEN col_a = 'price_usd' AND col_b = 'price_eur' AND contains(text, ', mean=') THEN '{t1}' WHEN (col_a = 'quantity' OR col_b = 'quantity') AND contains(text, 'sample values: [') THEN '{diff}' END"
LABELLING_SQL = f"""WITH {shards.BLOCKS}, {_COMBO_CTE}, truth AS (SELECT id AS pair_id, label FROM pairs),
texts AS (SELECT id AS pair_id, combo, col_a, col_b, {_EVIDENCE} AS text FROM blocks CROSS JOIN combos),
predictions AS (SELECT pair_id, combo, 'reader' AS model, 1 AS run, {_NAMES.format(dup=DUPLICATE, t2=TYPE2, t1=TYPE1, diff=DIFF_ENTITY)} AS pred FROM texts),
{_scores_sql()}
SELECT model, combo, array_to_string(regexp_extract_all(combo, '.'), '+') AS sources, run, n_pairs, {_MACRO}, {_CLASS}, 0::INTEGER AS relabelled FROM scores"""


QUERIES = {
    "labelling_run": (labelling_run, LABELLING_SQL),
    "label_distribution": (label_distribution, DISTRIBUTION_SQL),
    "truth_with_predictions": (truth_with_predictions, JOINED_SQL),
    "todo_pairs": (todo, TODO_SQL),
    "confusion_counts": (confusion, CONFUSION_SQL),
    "class_report": (class_report, CLASS_SQL),
    "macro_report": (macro_report, MACRO_SQL),
    "summary_by_combo": (summary, SUMMARY_SQL),
    "summary_round_trip": (summary_round_trip, TRIP_SQL),
    "model_comparison": (model_comparison, COMPARISON_SQL),
    "best_combo": (best_combo, BEST_SQL),
    "size_robustness": (size_robustness, SIZE_SQL),
    "repeat_summary": (repeat_summary, REPEAT_SQL),
    "repeat_with_history": (repeat_with_history, HISTORY_SQL),
    "fold_summary": (fold_summary, FOLD_SQL),
    "pooled_report": (pooled_report, POOLED_SQL),
    "resume_run": (resume_run, RESUME_SQL),
}
