import duckdb

import corpus_pipeline
from lakeaccord.llm import decontamination, neardup, toxicity
from lakeaccord.llm.queries import QUERIES

from .helpers import LABELS, documents, odd_texts, prose, rows
from .test_decontamination import distance
from .test_near_copies import brute as components

TOXIC = "You are an idiot and a moron. What pathetic scum! "


def folder(spark, path):
    item = prose(500, 30)
    texts = odd_texts() + [prose(i, 80) for i in range(60)]
    base = len(texts)
    texts += [texts[20], texts[20] + " end", TOXIC + texts[25], "Look: " + item.upper() + " " + prose(600, 20), texts[30] + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']
    documents(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return texts, item, base


def test_equals_brute_force(spark, tmp_path):
    texts, item, base = folder(spark, str(tmp_path))
    kept = {i: t for i, t in enumerate(texts) if i != base + 2}  # the toxic one
    group = {i: c for i, _, c in components(sorted(kept.items()))}
    kept = {i: t for i, t in kept.items() if group[i] == i}
    leaks = {i for i, t in kept.items() if t and len(t) < 3000 and distance(item, decontamination.normalized_text(t)) <= decontamination.budget(len(item))}
    assert leaks == {base + 3}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in found} == set(kept) - leaks
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString()


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    folder(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    few = docs.where("doc_id < 12")
    odd = few.union(few).union(spark.createDataFrame([(None, None, None, None, None), (None, "text", None, None, 4)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        found = stage(spark, odd, str(tmp_path)).count()
        assert found == {"near_duplicates": 13}.get(name, found) and found >= 13


def test_every_dealt_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
