"""Connected components of one large edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweft.operators.tables import cut, drop, new_path


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of an undirected edge list; component is the smallest id.

    Alternating large-star and small-star rounds: each round is two aggregations and joins over the edges, and their number
    grows with the logarithm of the longest path. A vertex with very many edges is met by aggregation and by joins that
    adaptive execution can split. Self-loops give a component of their own; null ends are ignored.
    """
    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = given.where("u = v").select(F.col("u").alias("id")).distinct()
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    now = cut(given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", path)
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, path = path, new_path(spark, "edges")
        now = cut(small, "edges", path)
        drop(spark, before)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).unionByName(loops.select("id", F.col("id").alias("component")))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))
