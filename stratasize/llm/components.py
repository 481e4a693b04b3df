"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasize.llm.common import written


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: (a, b) longs, in either order. Returns (node, component): the smallest node reachable, for each node in a link.

    Alternates the large-star and small-star steps, each one a grouped minimum and a join, until no link changes;
    each round's links are a written table. No step gathers a component or a node's neighbours: the smallest
    neighbour is a grouped minimum, and rows are rehung one by one.
    Null ends and self links are ignored; repeated links count once. No links: empty result.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    before = None
    for _ in range(rounds):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.where("a <> b").distinct(), "links")
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    stars = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots)
