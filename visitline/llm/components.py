"""Connected components of a link table, by alternating star contractions.

The links stay in Spark; every round is written to the shared folder, so that a lost executor repeats
one round only. A round keeps, for each vertex, links to the smallest vertex it sees, so the number of
links never grows, and a hub's links meet in one aggregate with map-side combining, not in one list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from visitline.session import materialize, release


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Every vertex connects its (larger, or not larger) neighbours to the smallest vertex it sees."""
    if larger_only:
        arcs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    moved = arcs.join(lowest, "u")
    if larger_only:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("low").alias("v")).union(
            lowest.select("u", F.col("low").alias("v"))
        )
    return moved.where("u <> v").distinct()


def component_labels(links: DataFrame, left: str, right: str) -> DataFrame:
    """``(vertex, component)`` of every vertex that has a link; the component is its smallest vertex."""
    edges = materialize(links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        after = materialize(_star(_star(edges, True), False), "links")
        release(edges)
        seen = after.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        edges = after
        if seen == before:
            break
        before = seen
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )
