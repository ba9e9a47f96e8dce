"""Near copies by a chosen-path join of shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .components import components, stored

SHINGLE = 5
SIMILARITY = 75  # per cent
#: Minwise tokens of a set; trees; positions that a tree branches on at its root. A pair at the
#: threshold has no node in common with (1/4)^12, less than one in ten million.
TOKENS, TREES, BRANCHES = 40, 6, 2
#: A pair at the threshold agrees on 30 of 40 tokens; 18 is four and a half deviations less.
AGREE = 18
#: A node is small when at most so many of its documents are outside its largest known component.
SMALL = 12
#: Ratio of neighbouring size classes.
CLASS = 1.02


def _shingles(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, sorted distinct hashes, their rows) of each block of texts."""
    for first, data, offsets in ta.blocks(column):
        n = len(offsets) - 1
        data = ta.LOWER[data]
        starts, ends, rows = ta.words(data, offsets, ta.NOT_SPACE)
        hashes = ta.word_hashes(data, starts, ends)
        sets, at = ta.window_hashes(hashes, rows, SHINGLE)
        sets, of = [sets], [rows[at]]
        counts = np.bincount(rows, minlength=n)
        for size in range(1, SHINGLE):  # a short text is one shingle
            short, at = ta.window_hashes(hashes, rows, size)
            whole = counts[rows[at]] == size
            sets.append(short[whole])
            of.append(rows[at][whole])
        sets, of = np.concatenate(sets), np.concatenate(of)
        order = np.lexsort((sets, of))
        sets, of = sets[order], of[order]
        fresh = np.ones(len(sets), bool)
        fresh[1:] = (sets[1:] != sets[:-1]) | (of[1:] != of[:-1])
        yield first, n, sets[fresh], of[fresh]


_FACTORS = ta.mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, sets, rows in _shingles(batch.column(1)):
            counts = np.bincount(rows, minlength=n)
            full = np.flatnonzero(counts)
            begins = np.searchsorted(rows, full)
            tokens = np.zeros((n, TOKENS), np.int32)
            digests = np.zeros((2, n), np.uint64)
            if len(full):
                for k, factor in enumerate(_FACTORS):
                    tokens[full, k] = (np.minimum.reduceat(sets * factor, begins) >> np.uint64(20)).astype(np.uint32).view(np.int32)
                for k in range(2):
                    digests[k, full] = np.add.reduceat(ta.mix(sets ^ np.uint64(k + 1)), begins)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), pa.array(counts, pa.int64()), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * TOKENS, pa.int32()), pa.array(tokens.ravel()))],
                names=["doc_id", "n_shingles", "digest_a", "digest_b", "tokens"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, sets, rows in _shingles(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), ta.row_lists(sets.view(np.int64), rows, n, pa.int64())], names=["doc_id", "shingles"])


def _agreement(x: str, y: str) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same))


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs whose sizes and minwise tokens leave the similarity possible."""
    side = lambda k: classes.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("tokens").alias(f"t_{k}"))
    return (
        pairs.distinct().join(side("a"), "a").join(side("b"), "b")
        .where((100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")) & (_agreement("t_a", "t_b") >= AGREE))
        .select("a", "b").distinct()
    )


def _confirmed(spark: SparkSession, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough; sets are made for their documents only."""
    pairs = stored(spark, pairs, "pairs")
    ids = stored(spark, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")  # of a known size
    sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "doc_id bigint, shingles array<bigint>")
    sets = stored(spark, sets, "sets")
    side = lambda k: sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"s_{k}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return stored(
        spark,
        pairs.join(side("a"), "a").join(side("b"), "b").where(100 * both >= SIMILARITY * (F.size("s_a") + F.size("s_b") - both)).select("a", "b").distinct(),
        "confirmed",
    )


def _branched(spark: SparkSession, docs: DataFrame, rows: DataFrame, few: DataFrame, classes: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs of documents of large nodes that one of `few` is in, by children that lose no similar pair.

    Two similar sets share at least 75/175 of the sum of their sizes. A document
    with fewer shingles that any other of these documents has can have no
    partner: passages that many documents share stop here, and copies that
    differ too much. Of c such shingles a partner that must have T of them has one
    of any c - T + 1, and the rarest in common is among the rarest so many of both:
    a document branches on these, for each size class.
    """
    ids = rows.select("doc_id").distinct()
    tokens = classes.join(ids, "doc_id", "left_semi").select("doc_id", "n_shingles", F.posexplode("tokens").alias("place", "token"))
    common = tokens.groupBy("place", "token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("place", "token")
    ids = tokens.join(common, ["place", "token"]).groupBy("doc_id", "n_shingles").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= AGREE).select("doc_id", "n_shingles")
    ids = stored(spark, ids.dropDuplicates(["doc_id"]), "likely")
    held = docs.join(ids.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sets, "doc_id bigint, shingles array<bigint>").select("doc_id", F.explode("shingles").alias("shingle"))
    held = stored(spark, held, "held")
    common = held.groupBy("shingle").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("documents")).where("low < high").select("shingle", "documents")
    held = held.join(common, "shingle")
    shared = held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared"))
    size = lambda n: F.floor(F.log(n) / F.log(F.lit(CLASS)) + 1e-9)
    sized = stored(spark, ids.join(shared, "doc_id").where(100 * F.col("shared") >= SIMILARITY * F.col("n_shingles")).withColumn("own", size(F.col("n_shingles"))), "sized")
    held = stored(spark, held.join(sized.select("doc_id"), "doc_id"), "shared")

    other = F.explode(F.sequence(size(F.col("n_shingles") * 0.75) - 1, size(F.col("n_shingles") / 0.75) + 1))
    needed = F.ceil(SIMILARITY * (F.col("n_shingles") + F.floor(F.pow(F.lit(CLASS), "other") - 1e-6)) / 175.0 - 1e-9)
    present = sized.select(F.col("own").alias("other")).distinct()
    wanted = sized.select("doc_id", "n_shingles", "shared", "own", other.alias("other")).join(present, "other").where(F.col("shared") >= needed)
    wanted = wanted.select("doc_id", "own", "other", (F.col("shared") - needed + 1).alias("branches"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("documents", "shingle"))  # a window is one document
    most = wanted.groupBy("doc_id").agg(F.max("branches").alias("most"))
    rarest = held.select("doc_id", "shingle", "documents").withColumn("rank", rank).join(most, "doc_id").where("rank <= most").select("doc_id", "shingle", "rank")
    rarest = stored(spark, rarest.join(wanted, "doc_id").where("rank <= branches").drop("rank", "branches"), "children")
    asked = few.withColumn("asks", F.lit(True))
    rarest = rarest.join(component, "doc_id").join(asked, "doc_id", "left").select("doc_id", "component", F.coalesce("asks", F.lit(False)).alias("asks"), "shingle", "own", "other")
    x = rarest.where("asks").drop("asks").toDF("x", "cx", "shingle", "own", "other")
    y = rarest.toDF("y", "cy", "asks", "shingle", "other", "own")
    return x.join(y, ["shingle", "own", "other"]).where("cx <> cy and (not asks or x < y)").select("x", "y").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: links are pairs with a Jaccard similarity of 0.75 or more.

    Documents are sets of distinct five-word shingles (lower-cased A-Z); a text
    of fewer words is one shingle. Equal sets become one class first. In each
    of six independent trees a class goes from the root to the nodes named by
    its minwise tokens at two positions. Every node links its members with its
    smallest one first; components of these confirmed links leave few pairs to
    compare. A node with few members outside its largest component is compared
    exhaustively, but for pairs known to be connected. In a larger one members
    that can have no partner are left out, and the others branch once more, on
    their rarest shingles. All links are confirmed on full sets.

    A null or wordless text has no shingles and stays alone. A row without
    doc_id gets a null component. Rows that share a doc_id are one node: links
    of any of them count. An empty table gives no rows. Other columns of `docs`
    are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = stored(spark, docs.mapInArrow(_sign, "doc_id bigint, n_shingles bigint, digest_a bigint, digest_b bigint, tokens array<int>"), "signed")
    key = ["n_shingles", "digest_a", "digest_b"]
    first = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("first_id"))
    classes = signed.join(first, key).where("doc_id = first_id").select("doc_id", "n_shingles", "tokens")
    classes = stored(spark, classes, "classes").dropDuplicates(["doc_id", "n_shingles", "tokens"])
    roots = [F.xxhash64(F.lit(t), F.lit(j), F.element_at("tokens", t * BRANCHES + j + 1)) for t in range(TREES) for j in range(BRANCHES)]
    nodes = classes.select(F.explode(F.array(*roots)).alias("node"), "doc_id")
    shared = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    nodes = stored(spark, nodes.join(shared, "node").select("node", "doc_id", "least"), "nodes")

    star = nodes.where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    links = _confirmed(spark, docs, _promising(star, classes))
    known = components(spark, links)

    rows = nodes.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("node", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    rows = stored(spark, rows, "rows")
    sizes = rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("node").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main")).where("n > most")
    sizes = stored(spark, sizes.withColumn("small", F.col("n") - F.col("most") <= SMALL), "sizes")
    small = rows.join(sizes.where("small").select("node", "main"), "node")
    few = small.where("component <> main").select("node", F.col("doc_id").alias("a"), F.col("component").alias("ca"))
    every = small.select("node", F.col("doc_id").alias("b"), F.col("component").alias("cb"), "main")
    pairs = few.join(every, "node").where("ca <> cb and (cb = main or a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = _promising(pairs, classes)
    large = stored(spark, rows.join(sizes.where("not small").select("node", "main"), "node"), "large")
    if not large.isEmpty():
        few = stored(spark, large.where("component <> main").select("doc_id").distinct(), "few")
        of = stored(spark, rows.select("doc_id", "component").distinct(), "components")
        found = _branched(spark, docs, large, few, classes, of).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        pairs = pairs.union(_promising(found, classes))
    links = links.union(_confirmed(spark, docs, pairs.distinct()))
    joined = components(spark, links).withColumnRenamed("node", "first_id")
    result = signed.select("doc_id", *key).join(first, key, "left").join(joined, "first_id", "left")
    return result.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first_id", "doc_id")).alias("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, but of each group of near copies only that with the smallest doc_id.

    Of rows that share a doc_id one stays; rows without doc_id all stay.
    """
    found = near_duplicates(spark, docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    again = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("again_id")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("again_id")
    again = stored(spark, again, "again")
    kept = docs.join(stored(spark, gone, "gone"), docs["doc_id"] == F.col("gone_id"), "left_anti")
    if again.isEmpty():
        return kept
    several = kept.join(again, kept["doc_id"] == F.col("again_id"), "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, kept["doc_id"] == F.col("again_id"), "left_anti").union(several)
