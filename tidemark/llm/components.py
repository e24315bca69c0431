"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import write_clean


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Link neighbours to the least one; ``both``: of either direction, else only the smaller ones."""
    around = edges.select("u", "v")
    if both:
        around = around.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = around.join(least, "u")
    kept = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if both else (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    )
    return kept.where("u != v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; ``links`` has columns u and v.

    The least node of a component names it. Each round writes its links to the
    shared folder, so lineage stays short; rounds grow with the logarithm of the
    longest path. Hubs are combined before they are shuffled.
    """
    greater, lesser = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    links = write_clean(links.select(greater, lesser).where("u != v").distinct(), "links")
    state = None
    while True:
        links = write_clean(_star(_star(links, both=True), both=False), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres)
