import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lakeaccord.llm import licenses

from .helpers import documents, odd_texts, prose, rows

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), sorted({x for _, x in found})


def test_base_places_equal_brute_force(spark):
    rng = random.Random(3)
    bits = ["under", "the", "MIT", "License", "Apache", "license,", "version", "2", "2.0", "CC", "BY-NC", "by", "nc", "cc-by-nc", "x", "é", "Under the MIT license."]
    texts = odd_texts() + [rng.choice([" ", "-", "\n"]).join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    found = licenses.scan(documents(spark, texts, extra=["labels", "n_base", "score"]))
    got = {r["doc_id"]: r for r in found.collect()}
    for i, text in enumerate(texts):
        r, want = got[i], brute(text)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert set(r["base_labels"]) <= set(r["labels"]) and r["labels"] == sorted(set(r["labels"])) and 0 <= r["score"] <= 1


def test_templates_are_found_in_prose_and_with_changes(spark):
    names = {label: text for label, (text, _) in licenses.TEMPLATES.items()}
    texts, wanted = [], []
    for i, (label, text) in enumerate(names.items()):
        words = text.split()
        if len(words) > 15:
            words.insert(len(words) - 2, "hereby")
        texts.append(prose(i, 80) + ".\n" + " ".join(words).capitalize() + ",\n" + prose(i + 100, 80))
        wanted.append(licenses.SHORT.get(label, label))
    texts += [prose(900 + i, 200) for i in range(40)] + ["the license of this software and the copyright of any person", "mit der und von " * 50]
    got = dict(rows(licenses.scan(documents(spark, texts)), "doc_id", "labels"))
    assert all(w in got[i] for i, w in enumerate(wanted)), [(w, got[i]) for i, w in enumerate(wanted)]
    assert all(not got[i] for i in range(len(wanted), len(texts)))


def test_nulls_repeats_and_empty_tables(spark):
    docs = documents(spark, ["under the MIT license", None])
    more = docs.union(docs).union(spark.createDataFrame([(None, "cc by nc", None, None, None)], docs.schema))
    got = sorted(((str(i), n, s) for i, n, s in rows(licenses.scan(more), "doc_id", "n_base", "labels")))
    assert got == [("0", 1, ["mit"]), ("0", 1, ["mit"]), ("1", 0, []), ("1", 0, []), ("None", 1, ["cc-by-nc"])]
    assert licenses.scan(docs.limit(0)).collect() == []


def test_notices_beside_others_and_very_frequent_ones_are_found(spark):
    names = {label: text for label, (text, _) in licenses.TEMPLATES.items()}
    everything = [names["bsd"] + ". " + names["mit"], f" {prose(5, 40)} ".join(names.values()), " ".join(reversed(names.values())), " ".join(licenses.WORDS) + f" {prose(6, 30)} " + names["mit"]]
    frequent = [names["mit"] + " " + prose(i, 20) for i in range(200)]
    got = dict(rows(licenses.scan(documents(spark, everything + frequent + [prose(900 + i, 50) for i in range(10)])), "doc_id", "labels"))
    whole = sorted({licenses.SHORT.get(label, label) for label in names})
    assert got[0] == ["bsd", "mit"] and got[1] == whole and got[2] == whole and "mit" in got[3]
    assert all(got[len(everything) + i] == ["mit"] for i in range(200)) and all(not got[len(everything) + 200 + i] for i in range(10))


def test_votes_lose_no_alignment_of_enough_weight():
    rng = np.random.default_rng(4)
    weights = rng.uniform(0.01, 5, len(licenses.WORDS))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    texts = []
    for _ in range(150):
        bits = []
        for label in rng.choice(list(licenses.TEMPLATES), 3):
            bits += [w for w in licenses.TEMPLATES[label][0].split() if rng.random() > 0.2] + rng.choice(licenses.TEMPLATES[label][1]).split() + ["x"] * int(rng.integers(0, 9))
        texts.append(" ".join(bits))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], schema=schema)
    got = [r for out in licenses._matcher(weights)([batch]) for r in out.column("labels").to_pylist()]
    for text, labels in zip(texts, got, strict=True):
        words = text.split()
        wanted = {label for phrase, label in PHRASES.items() if f" {phrase} " in f" {text} "}
        for label, (template, phrases) in licenses.TEMPLATES.items():
            numbers = template.split()
            hits = [i for p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
            total = sum(weights[licenses.NUMBER[w]] for w in numbers)
            for cell in range(-20, len(words) // 4 + 2):
                low, high = 4 * cell - 3, 4 * cell + 7
                if any(low <= p <= high + len(numbers) for p in hits):
                    share = sum(weights[licenses.NUMBER[w]] for k, w in enumerate(numbers) if w in words[max(0, low + k) : max(0, high + k + 1)]) / total
                    if share >= licenses.COVERED:
                        wanted.add(licenses.SHORT.get(label, label))
        assert labels == sorted(wanted)


def test_templates_from_a_table(spark):
    text = "This Program may be copied under version 7 of the Harbour Licence, provided that the notice of its keeper stays"
    table = spark.createDataFrame(
        [("harbour-7", text, ["Harbour Licence"]), ("harbour-7", "harbour licence seven applies", ["licence seven"]), ("none", "no phrase", []), (None, "x", ["x"]), ("empty", None, None), ("empty", "...", ["!"])],
        "label string, text string, phrases array<string>",
    )
    docs = documents(spark, [prose(1, 30) + " " + text.upper(), "HARBOUR LICENCE seven applies", "the harbour licence", "under the mit license", licenses.TEMPLATES["bsd"][0]])
    got = dict(rows(licenses.scan(docs, table), "doc_id", "labels"))
    assert got == {0: ["harbour-7"], 1: ["harbour-7"], 2: [], 3: ["mit"], 4: []}
    with pytest.raises(ValueError):
        licenses.read_notices(table, 3)
    assert dict(rows(licenses.scan(docs, table.limit(0)), "doc_id", "labels")) == {0: [], 1: [], 2: [], 3: ["mit"], 4: []}
