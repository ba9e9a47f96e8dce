"""Small frames of documents for the tests."""

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = "doc_id bigint, quality int, toxic int"


def documents(spark, texts, first=0, langs=("en", "de"), extra=()):
    """Rows with ids from `first` on; extra names become string columns with odd values."""
    rows = [(first + i, t, langs[i % len(langs)], f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCUMENTS)
    return with_extra(frame, extra)


def with_extra(frame, names):
    from pyspark.sql import functions as F

    for name in names:
        frame = frame.withColumn(name, F.lit("other"))
    return frame


def odd_texts():
    """Null, empty, blank, short, very long and repeated texts, white space and letters beyond ASCII."""
    return [None, "", " \n\t ", "one", "Öl über ALLES ß ſ K", "a\x0bb\x0cc d e  f\r\ng", "word " * 30, "x" * 50_000, " ".join(f"w{i}" for i in range(20_000)), "same text here with some words in it", "same text here with some words in it"]


def prose(seed, words=120, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def rows(frame, *names):
    return [tuple(r[n] for n in names) for r in frame.select(*names).collect()]
