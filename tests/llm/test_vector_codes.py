import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeaccord.llm import vector_codes as vc
from lakeaccord.llm.queries import QUERIES
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


@pytest.mark.parametrize(("largest", "width", "entries"), [(300, 16, 256), (3, 4, 256), (1, 2, 40), (1 << 26, 16, 100), (5, 0, 7), (9, 3, 1)])
def test_search_agrees_with_every_distance(largest, width, entries):
    rng = np.random.default_rng(largest)
    points, book = rng.integers(-largest, largest + 1, (700, width)), rng.integers(-largest, largest + 1, (entries, width))
    book[entries // 2 :] = np.where(rng.random((entries - entries // 2, 1)) < 0.3, book[: entries - entries // 2], book[entries // 2 :])  # ties
    at, distance = vc.nearest(points, book)
    for p, i, d in zip(points.tolist(), at.tolist(), distance.tolist(), strict=True):
        every = [sum((a - b) ** 2 for a, b in zip(p, e, strict=True)) for e in book.tolist()]
        assert (d, i) == min((x, k) for k, x in enumerate(every))


def test_search_stops_before_far_sums(monkeypatch):
    looked = []
    real = np.where
    monkeypatch.setattr(vc, "BLOCK", 8)
    book = np.arange(256)[:, None] * np.full((1, 4), 100)
    points = book[:64] + 1
    monkeypatch.setattr(vc.np, "where", lambda *a: looked.append(a[0].shape) or real(*a))
    at, _ = vc.nearest(points, book)
    assert at.tolist() == list(range(64)) and sum(s[1] for s in looked if len(s) == 2) <= 64 / 8 * 3 * vc.REACH


def plain(rows):
    """The contract with Python integers."""
    kept = [(i, [math.floor(x * 1024) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 4
    parts = [[v[k * width : (k + 1) * width] for _, v, _ in kept] for k in range(4)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), j) for j, e in enumerate(book))
    codes, errors, numbers = [""] * len(kept), [0] * len(kept), []
    for own in parts:
        book = own[:256]
        for _ in range(4):
            members = {}
            for p in own:
                members.setdefault(near(p, book)[1], []).append(p)
            book = [[sum(c) // len(members[j]) for c in zip(*members[j], strict=True)] if j in members else e for j, e in enumerate(book)]
        for k, p in enumerate(own):
            d, j = near(p, book)
            codes[k] += f"{j:02x}"
            errors[k] += d
        numbers += [str(x) for e in book for x in e]
    by = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] = by.get(label, 0) + e
    sha = hashlib.sha256(",".join(numbers).encode()).hexdigest()
    return [(i, c, e, by[label], sha) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)]


def odd_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.2, (n, 8)).astype(np.float32)
    rows = [(int(i) * 3 % n, v.tolist(), None if i % 11 == 0 else int(i % 7 if i % 3 else 99)) for i, v in enumerate(vectors)]
    rows += [(None, vectors[0].tolist(), 5), (n + 1, None, 5), (n + 2, [*vectors[1].tolist()[:7], None], 1), (n + 3, [*vectors[1].tolist()[:7], float("nan")], None), (n + 4, [*vectors[1].tolist()[:7], float("-inf")], None)]
    return rows + [(5, vectors[3].tolist(), 2)] * 3 + [(n + 10 + i, vectors[2].tolist(), 99) for i in range(n // 2)]  # one vector is a third of all rows


@pytest.mark.parametrize("n", [5, 40, 600])
def test_codes_agree_with_the_contract(spark, tmp_path, n):
    rows = odd_rows(n)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"code": F.lit("x"), "error": F.lit(1), "vector": F.lit("y")})
    frame.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = [tuple(r) for r in QUERIES["op13_vector_codes"][0](spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted(plain(rows), key=repr)


def test_decoded_vectors_have_the_stated_error(spark):
    rows = odd_rows(301)
    frame = spark.createDataFrame(rows, SCHEMA)
    found, books, length = vc.compress(spark, frame)
    whole = {r["vec_id"]: r["vector"] for r in vc.kept(frame).where("vec_id is not null and vec_id > 5").collect()}
    errors = {r["vec_id"]: r["error"] for r in found.collect()}
    for r in vc.decode(found, books, length).where("vec_id > 5").collect():
        assert sum((a - b) ** 2 for a, b in zip(whole[r["vec_id"]], r["vector"], strict=True)) == errors[r["vec_id"]]


def test_other_lengths_large_components_and_no_rows(spark):
    frame = spark.createDataFrame([(1, [0.5] * 6, 1), (2, [1.0] * 8, 1), (3, [1e30] * 6, None), (4, [], 2)], SCHEMA)
    found, books, length = vc.compress(spark, frame)
    assert length == 6 and books[0].shape == (2, 2) and sorted(r["vec_id"] for r in found.collect()) == [1, 3]
    assert max(int(b.max()) for b in books) == vc.LARGEST
    found, books, length = vc.compress(spark, frame.limit(0))
    assert found.count() == 0 and vc.books_digest(books) == hashlib.sha256(b"").hexdigest()
    found, _, length = vc.compress(spark, frame.where("vec_id = 4"))
    assert [(r["code"], r["error"]) for r in found.collect()] == [(bytearray(4), 0)]


def test_many_labels_hot_and_cold(spark):
    rows = [(i, [float(i % 13), 1.0, 0.0, float(i % 5)], None if i % 2 else i) for i in range(900)]
    found, _, _ = vc.compress(spark, spark.createDataFrame(rows, SCHEMA))
    found = found.collect()
    by = {}
    for r in found:
        by[r["label"]] = by.get(r["label"], 0) + r["error"]
    assert len(found) == 900 and all(r["label_error"] == by[r["label"]] for r in found)


def test_query_agrees_with_sql(spark):
    run, sql = QUERIES["op13_vector_codes"]
    assert compare(spark, FOLDER, run, sql)["problem"] == ""
