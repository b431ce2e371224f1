"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its neighbours on one side to the smallest of all.

    large: the neighbours above the node go to the smallest of the node and
    all its neighbours.  small: the neighbours below the node, and the node
    itself, go to the smallest of them."""
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written, so that the join below deals both sides out itself and a node with very many links can be split
    least = stored(sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
    to = sides.join(least, "a")
    if large:
        out = to.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = to.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; component is its smallest reachable node.

    ``links`` has long columns a, b.  Rounds go on until the link table no
    longer changes; each round's table is written to the shared folder and
    only its count and checksum come to the driver.  Null ends and loops are
    no links; no links give an empty table."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a is not null and b is not null and a <> b").distinct(), "links")
    seen = None
    while True:
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        edges = stored(_star(_star(edges, True), False), "links")
    # At the fixpoint every edge runs from a node to the smallest node of its component.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
