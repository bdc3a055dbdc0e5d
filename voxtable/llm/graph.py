"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import settle, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over ``u > v`` edges: neighbours are hung on the least one of their hub."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(turned) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = around.join(least, "u")
    if large:
        found = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return found.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) of every node in ``links(a, b)``.

    Every step only re-hangs links on smaller nodes, so the links become stars on the least nodes; a hub of any
    degree is a min aggregate and a join that skew handling can split, never a gathered group.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter("u > v").distinct(), "edges")
    mark = None
    while True:
        edges = stored(_star(stored(_star(edges, large=True), "edges"), large=False), "edges")
        settle(links.sparkSession)
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
