"""Connected components of links, as joins and aggregates over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaccord.session import fresh_path


def stored(spark: SparkSession, frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written below the shared folder and read again: it cuts the lineage."""
    path = fresh_path(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of a link: the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours, then
    the label of that label, so that chains shorten by halves. The labels are
    written after each round. Links with a null end are left out; no links give
    no rows; repeated links and links of a node with itself change nothing.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = stored(spark, links.union(links.select("v", "u")).distinct(), "links")
    labels = stored(spark, both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("m"))
        least = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        new = stored(spark, least.join(jump, "c", "left").select("node", "old", F.least("c", "further").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels
