import math
import random
import re

from lakeaccord.llm import quality_rules as r

from .helpers import documents, odd_texts, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for k in range(len(words) - 4):
        seen.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {k + j for places in seen.values() if len(places) > 1 for k in places for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark):
    rng = random.Random(4)
    bits = ["a", "b", "c d", "\n", " ", "#", "é|", "a b c d e", "line\nline\n", "\x0b", "$%&<>*"]
    texts = odd_texts() + ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 120))) for _ in range(300)]
    found = r.measure(documents(spark, texts, extra=["words", "w", "repeats", "n_words"]).drop("n_words"))
    got = {x[0]: x[1:] for x in rows(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_outliers_of_their_language_and_source_go(spark):
    texts = [prose(i, 100) for i in range(300)]
    for i in range(0, 300, 50):
        texts[i] = " ".join(f"{w}##$" for w in texts[i].split())
    texts[7], texts[13] = "too short", "again and again and " * 40
    measured = r.measure(documents(spark, texts))
    found = dict((i, (f, k)) for i, f, k in rows(r.apply(measured), "doc_id", "base_failed", "kept"))
    assert {i for i, (f, _) in found.items() if f} == {7, 13}
    assert {i for i, (_, k) in found.items() if not k} == {7, 13, *range(0, 300, 50)}


def test_a_source_full_of_symbols_has_its_own_threshold(spark):
    texts = [" ".join(f"|{w}" for w in prose(i, 80).split()) if i % 3 == 0 else prose(i, 80) for i in range(300)]
    texts[1] = " ".join(f"|{w}" for w in texts[1].split())
    found = dict(rows(r.apply(r.measure(documents(spark, texts))), "doc_id", "kept"))
    assert {i for i, k in found.items() if not k} == {1}


def test_native_plan(spark):
    plan = r.apply(r.measure(documents(spark, [prose(i) for i in range(40)])))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


def test_nulls_repeats_and_empty_tables(spark):
    docs = documents(spark, [prose(1), None, ""])
    more = docs.union(docs).union(spark.createDataFrame([(None, prose(2), None, None, None), (9, prose(3), "en", None, None)], docs.schema))
    got = sorted((str(i), k) for i, k in rows(r.apply(r.measure(more)), "doc_id", "kept"))
    assert got == [("0", True), ("0", True), ("1", False), ("1", False), ("2", False), ("2", False), ("9", True), ("None", True)]
    assert r.apply(r.measure(docs.limit(0))).collect() == []
    assert r.apply(r.measure(docs.where("doc_id > 0"))).count() == 2


def plain_verdicts(texts, groups):
    """kept by exact quartiles: of the language and source, of the language, or of all rows, whichever is the narrowest with enough rows."""

    def figures(text):
        n, chars, symbols, lines, repeats = brute(text)
        return (symbols / chars, lines * 10 / (n + 10), repeats / n, chars / n) if n else None

    found = [figures(t) for t in texts]
    have = [i for i, f in enumerate(found) if f]
    kept = []
    for i, text in enumerate(texts):
        n, _, _, _, repeats = brute(text)
        good = n >= 10 and 100 * repeats <= 20 * n
        levels = [[j for j in have if groups[j] == groups[i]], [j for j in have if groups[j][0] == groups[i][0]], have]
        level = next((x for x in levels if len(x) >= r.GROUP_ROWS), have)
        for k, (slack, both) in enumerate(r.MEASURES.values()):
            values = sorted(found[j][k] for j in level)
            low, high = (values[math.ceil(q * len(values)) - 1] for q in (0.25, 0.75))
            good = good and found[i][k] <= high + r.FENCE * (high - low) + slack and (not both or found[i][k] >= low - r.FENCE * (high - low) - slack)
        kept.append(good)
    return kept


def test_verdicts_equal_exact_quartiles(spark):
    rng = random.Random(8)
    langs = ["en"] * 34 + ["de"] * 4 + ["fr", None]
    texts = []
    for i in range(600):
        words = prose(i, rng.choice([5, 12, 60, 150]), rng.choice([30, 4000])).split()
        for _ in range(rng.choice([0, 0, 0, 3, 40])):
            words.insert(rng.randrange(len(words)), rng.choice(["#", "$$", "x" * 60, "\nsame line\n", "a", "one two one two"]))
        texts.append(" ".join(words))
    texts += [None, "", " \n "]
    docs = documents(spark, texts, langs=langs)
    found = dict(rows(r.apply(r.measure(docs.repartition(7))), "doc_id", "kept"))
    want = plain_verdicts(texts, [(langs[i % len(langs)], i % 3) for i in range(len(texts))])
    assert [found[i] for i in range(len(texts))] == want and 100 < sum(want) < 590
