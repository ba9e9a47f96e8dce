import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lakeaccord.llm import quality_lm as q

from .helpers import LABELS, documents, odd_texts, prose, rows


def symbols(text):
    out = []
    for c in text:
        cp = ord(c)
        out.append(int(q._TABLE[cp]) if cp < len(q._TABLE) else q._SYMBOL if 0x2000 <= cp < 0x2C00 else q._OTHER)
    return out


def brute(texts):
    """p(w | context) by the textbook recursion over dictionaries."""
    grams = [Counter() for _ in range(q.ORDER + 1)]
    for text in texts:
        s = [0] * (q.ORDER - 1) + symbols(text)
        grams[q.ORDER].update(tuple(s[i - q.ORDER + 1 : i + 1]) for i in range(q.ORDER - 1, len(s)))
    for k in range(q.ORDER - 1, 0, -1):
        grams[k].update(g[1:] for g in grams[k + 1])
    discounts, totals, saved = {}, {}, {}
    for k in range(1, q.ORDER + 1):
        n = Counter(grams[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        discounts[k] = [min(max(0.0, i - (i + 1) * y * n[i + 1] / n[i]), i * 0.99) if n[i] else 0.5 for i in (1, 2, 3)]
        totals[k], saved[k] = defaultdict(int), defaultdict(float)
        for g, c in grams[k].items():
            totals[k][g[:-1]] += c
            saved[k][g[:-1]] += discounts[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 32
        context = g[:-1]
        if context not in totals[k]:
            return p(g[1:])
        c = grams[k][g]
        share = (c - discounts[k][min(c, 3) - 1]) / totals[k][context] if c else 0.0
        return share + saved[k][context] / totals[k][context] * p(g[1:])

    return p


def test_model_equals_the_recursion_and_sums_to_one(spark):
    texts = [prose(i, 40) + ". Ähnlich, été!\n<b>" for i in range(12)] + ["", "ab", "中文 ok"]
    logs = q.table(q.train(spark, documents(spark, texts).repartition(3)))
    assert np.allclose(np.exp(logs.astype(float)).reshape(-1, 32).sum(1), 1, atol=1e-4)
    p = brute(texts)
    rng = np.random.default_rng(1)
    seen = [symbols(t) for t in texts]
    checks = [tuple(rng.integers(0, 32, q.ORDER)) for _ in range(300)] + [tuple(s[i : i + 4]) for s in seen for i in range(0, max(0, len(s) - 4), 7)]
    for g in checks:
        code = sum(int(x) << 5 * (q.ORDER - 1 - i) for i, x in enumerate(g))
        assert abs(np.exp(float(logs[code])) - p(tuple(int(x) for x in g))) < 1e-5


def test_perplexity_and_thresholds(spark):
    good = [prose(i, 60) for i in range(80)]
    bad = ["#$% &*| <<>> " * 30, "zqxj vkwq " * 40]
    texts = good + bad + odd_texts()
    docs = documents(spark, texts, extra=["perplexity", "threshold", "limit", "of"])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(3, 0, 0), (None, 1, 1), (4, None, None), (500, 1, 0)], LABELS)
    found = {r["doc_id"]: r for r in q.quality(spark, docs, labels).collect()}
    p = brute([t for i, t in enumerate(texts) if i < 60 and i != 3])
    for i in (0, 70, 80, 84, 85, 86):
        s = [0] * (q.ORDER - 1) + symbols(texts[i])
        if len(s) >= q.ORDER:
            nll = [-np.log(p(tuple(s[k - q.ORDER + 1 : k + 1]))) for k in range(q.ORDER - 1, len(s))]
            assert abs(found[i]["perplexity"] / np.exp(np.mean(nll)) - 1) < 1e-3
    assert all(found[i]["kept"] for i in range(80)) and not found[80]["kept"] and not found[81]["kept"]
    assert found[82]["perplexity"] is None and not found[82]["kept"] and not found[83]["kept"]
    assert all(r["doc_id"] in range(len(texts)) for r in found.values()) and len(found) == len(texts)


def test_nulls_repeats_and_empty_tables(spark):
    docs = documents(spark, [prose(1), None])
    none = spark.createDataFrame([], LABELS)
    more = docs.union(docs).union(spark.createDataFrame([(None, prose(2), None, None, None)], docs.schema))
    assert sorted((str(i), k) for i, k in rows(q.quality(spark, more, none), "doc_id", "kept")) == [("0", True), ("0", True), ("1", False), ("1", False), ("None", True)]
    assert q.quality(spark, docs.limit(0), none).collect() == []


GREEK = ["η γάτα κοιμάται στο σπίτι", "ο σκύλος τρέχει στον κήπο", "το παιδί διαβάζει ένα βιβλίο"]


def words_of(text):
    """Runs of ASCII letters, digits and code points of U+0080 to U+07FF; each later code point alone."""
    return re.findall("[0-9a-z\u0080-\u07ff]+|[\u0800-\U0010ffff]", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def word_brute(texts):
    """p(w2 | w1) by the textbook recursion over dictionaries, with one unknown word."""
    pairs = Counter()
    for text in texts:
        s = ["", *words_of(text)]
        pairs.update(zip(s, s[1:], strict=False))
    single = Counter(b for _, b in pairs)

    def discounts(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        return [min(max(0.0, i - (i + 1) * y * n[i + 1] / n[i]), i * 0.99) if n[i] else 0.5 for i in (1, 2, 3)]

    d2, d1, total, saved = discounts(pairs), discounts(single), Counter(), Counter()
    for (a, _), n in pairs.items():
        total[a] += n
        saved[a] += d2[min(n, 3) - 1]
    unseen = sum(d1[min(n, 3) - 1] for n in single.values()) / single.total() / (len(single) + 1)

    def p(a, b):
        n, m = pairs[a, b], single[b]
        low = unseen + ((m - d1[min(m, 3) - 1]) / single.total() if m else 0.0)
        return low if a not in total else ((n - d2[min(n, 3) - 1]) / total[a] if n else 0.0) + saved[a] / total[a] * low

    assert abs(sum(p("", w) for w in single) + p("", "no such word") - 1) < 1e-9
    return p


def test_word_perplexity_of_every_script_equals_the_recursion(spark):
    good = [" ".join(GREEK[(i + j) % 3] for j in range(i % 4 + 2)) + f" {i % 7}" for i in range(60)] + ["中文很好 ok 中文", "Да, это ДА"]
    other = ["γη τάκα μάσιοται κτο στίπι " * 4, "文中好很 ok", "да это ДА", "#$% &*", "", None, "😀 x😀y"]
    texts = good + other
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(good))], LABELS)
    docs = documents(spark, texts, langs=("el",)).withColumn("lang", F.when(F.col("doc_id").isin(60, 61), "other").otherwise(F.col("lang")))
    found = {r["doc_id"]: r for r in q.quality(spark, docs.repartition(4), labels).collect()}
    p = word_brute(good)
    for i, text in enumerate(texts):
        s = words_of(text)
        assert found[i]["n_words"] == len(s)
        want = np.exp(-np.mean([np.log(p(a, b)) for a, b in zip(["", *s], s, strict=False)])) if s else None
        assert found[i]["word_perplexity"] is None if want is None else abs(found[i]["word_perplexity"] / want - 1) < 1e-9
    # Same lengths and blanks: only the letters tell these from the trusted texts.
    assert all(found[i]["kept"] for i in range(60)) and not found[len(good)]["kept"]


def test_the_word_model_grows_with_the_trusted_texts(spark):
    sizes = []
    for n in (20, 200):
        own = documents(spark, [prose(i, 60, 100_000) for i in range(n)]).select(F.xxhash64("text").alias("key"), "text").mapInArrow(q._word_rows, q.WORD_ROWS)
        pairs, words, _ = q.train_words(spark, own)
        sizes.append((pairs.where("view = 0").count(), words.where("view = 0").count()))
    assert all(b > 8 * a for a, b in zip(*sizes, strict=True))


def test_copies_of_a_text_change_nothing_about_it(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    good = [prose(i, 40) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], LABELS)
    one, many = documents(spark, [*good, text]), documents(spark, [*good, *[text] * 50])
    single = next(r for r in q.quality(spark, one, labels).collect() if r["doc_id"] == 60)
    copies = [r for r in q.quality(spark, many, labels).collect() if r["doc_id"] >= 60]
    assert single["n_words"] == 13 and len(copies) == 50
    for r in copies:
        assert r["n_words"] == 13 and r["kept"] == single["kept"] and abs(r["word_perplexity"] / single["word_perplexity"] - 1) < 1e-9


def test_blocks_shards_and_parts_change_nothing(spark):
    texts = [prose(i, 80, 600) for i in range(120)] + odd_texts() + GREEK
    docs = documents(spark, texts).repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(70)], LABELS)
    one, many = ({r["doc_id"]: r for r in q.quality(spark, docs, labels, **sizes).collect()} for sizes in ({}, {"block_bytes": 3000, "shard_pairs": 500, "rounds": 4}))
    assert len(one) == len(many) == len(texts)
    for i, a in one.items():
        b = many[i]
        assert all(a[c] == b[c] for c in ("lang", "n_chars", "n_words", "kept"))
        for c in ("perplexity", "word_perplexity", "apart_perplexity", "threshold", "word_threshold"):
            assert a[c] is b[c] is None or abs(a[c] / b[c] - 1) < 1e-9


def test_neither_texts_nor_pairs_stay_on_disk(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("lakeaccord.session.shared_folder", lambda spark: str(tmp_path))
    texts = [prose(i, 400, 100_000) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], LABELS)
    tables = len(spark.catalog.listTables())
    found = q.quality(spark, documents(spark, texts), labels)
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 0.5 * sum(map(len, texts))
    assert found.count() == 400 and len(spark.catalog.listTables()) == tables


def test_packed_numbers_come_back(spark):
    rng = np.random.default_rng(3)
    counts = np.stack([rng.geometric(0.4, 500) - 1, rng.geometric(0.2, 500) - 1, rng.integers(0, 2, 500)]).astype(np.uint64)
    counts[:2, :3] = [[7, 1 << 40, 0], [6, 0, 1 << 33]]
    figures = rng.integers(0, 1 << 45, (q.VIEWS * q.FIGURES, 300)).astype(np.uint64)
    figures[:, :200] //= np.uint64(1 << 43)
    for n in (0, 1, 300):
        assert (q._unpacked_counts(q._packed_counts(counts[:, :n])) == counts[:, :n]).all()
        assert (q._unpacked_figures(q._packed_figures(figures[:, :n])) == figures[:, :n]).all()
