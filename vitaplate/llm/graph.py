"""Connected components by alternating star contraction, with hubs split over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaplate.llm import common as C

#: A node with more than the HUBS-th part of all edges is a hub, so there are fewer than HUBS.
HUBS = 1000
#: So few edges stay in one task (a few MB), where rounds need no shuffle.
FEW = 100_000


def join_split(rows: DataFrame, counted: DataFrame, on: str, many: str, limit) -> DataFrame:
    """``rows`` joined with ``counted``, one row for each ``on``; where ``many`` passes ``limit`` by broadcast, so that rows of hot keys stay where they are.

    The caller's limit bounds the broadcast: it is a share of the sum of ``many``.
    """
    hot = F.broadcast(counted.where(F.col(many) > limit))
    others = counted.where(F.col(many) <= limit)
    return rows.join(hot, on).union(rows.join(hot.select(on), on, "left_anti").join(others, on))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected ``edges`` (u, v); root is the component's least node.

    Every node hands its larger, then its smaller neighbours to the least one,
    until all components are stars.  Least neighbours are partial aggregates, and the edges
    of a hub meet its least neighbour by broadcast.  Every round is written to
    the shared folder.  Loops are left out; without edges there are no rows.
    """
    now = C.materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        edges_now = now.count()
        few = edges_now <= FEW
        together = (lambda df: df.coalesce(1)) if few else (lambda df: df)
        met = (lambda e, least: e.join(least, "u")) if few else (lambda e, least: join_split(e, least, "u", "many", max(1, edges_now // HUBS)))
        now = together(now)
        # done when every node with a smaller neighbour has one, and that is a root: then all components are stars
        ends = together(now.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(now.select("v", F.lit(0))))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("many"))
        if nodes.where((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("many") > 1))).isEmpty():
            break
        ups = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        around = together(now.union(ups)).groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("many"))
        large = met(ups, around.select("u", F.least("u", "v").alias("m"), "many")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = together(C.materialise(large.where("u <> v").distinct(), "large-star"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many"))
        small = met(large, least).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = C.materialise(small.where("u <> v").distinct(), "small-star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
