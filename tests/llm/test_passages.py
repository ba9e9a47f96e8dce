import hashlib
import random
import re

from lakeaccord.llm import substrings

from .helpers import documents, odd_texts, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(items):
    seen, out = {}, []
    for i, text in sorted(items):
        words = WORD.findall(text or "")
        gone = set()
        for k in range(len(words) - 19):
            key = tuple(words[k : k + 20])
            if key in seen:
                gone |= set(range(k, k + 20))
            seen[key] = True
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return set(out)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    texts = odd_texts()
    shared = [prose(500 + i, n) for i, n in enumerate((19, 20, 21, 25, 60, 200))]
    for seed in range(60):
        parts = [prose(seed, rng.randrange(1, 60))]
        for _ in range(rng.randrange(0, 4)):
            part = rng.choice(shared).split()
            low = rng.randrange(0, max(1, len(part) - 20))
            parts += [" ".join(part[low:]), prose(rng.randrange(10**6), rng.randrange(0, 30))]
        texts.append("\n".join(parts))
    texts += [texts[-1], "  " + texts[-2] + "\t", "a b " * 40]
    rng.shuffle(texts)
    docs = documents(spark, texts, extra=["digest", "blocks", "windows", "late"])
    found = substrings.repeated_passages(spark, docs)
    assert set(rows(found, "doc_id", "n_words", "n_removed", "kept_sha256")) == brute(list(enumerate(texts)))


def test_nulls_repeats_and_empty_tables(spark):
    docs = documents(spark, [prose(1, 30), prose(1, 30)])
    more = spark.createDataFrame([(None, prose(1, 30), None, None, None), (0, prose(1, 30), None, None, None), (0, prose(2, 25), None, None, None), (9, None, None, None, None)], docs.schema)
    found = substrings.repeated_passages(spark, docs.union(more))
    got = sorted(rows(found, "doc_id", "n_words", "n_removed"), key=str)
    assert got == sorted([(0, 30, 0), (0, 30, 0), (0, 25, 0), (1, 30, 30), (None, 30, 0), (9, 0, 0)], key=str)
    assert substrings.repeated_passages(spark, docs.limit(0)).collect() == []
