"""Connected components of an edge table by alternating large and small stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.helpers import stored

MAX_ROUNDS = 60


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """Hang every neighbour of a node on the smallest of them: larger ones (large star), or smaller ones and itself (small star).

    The minimum per node is a partial aggregate joined back, so a node with many links is never gathered in one task.
    """
    if small:
        own = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        own = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = own.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = own.join(least, "u")
    if small:
        moved = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        moved = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link: root is the smallest node that can be reached.

    Rounds end when a round leaves the links unchanged; each is written to the shared folder.
    """
    links = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        links = stored(_stars(_stars(links, small=False), small=True), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
        before = now
    raise RuntimeError("the components did not settle")
