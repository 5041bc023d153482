"""Edge lists: overlay, support, cliques, degrees, recurrence and density of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweft.operators.tables import cut, dealt


def canonical(edges: DataFrame, a: str = "g1", b: str = "g2") -> DataFrame:
    """Ends in ascending order."""
    return edges.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def overlay(edges: DataFrame, min_support: int = 1, max_support: int | None = None) -> DataFrame:
    """g1, g2, recurrence: datasets that contain the edge, within a support window."""
    out = edges.groupBy("g1", "g2").agg(F.count("*").alias("recurrence")).where(F.col("recurrence") >= min_support)
    return out if max_support is None else out.where(F.col("recurrence") <= max_support)


def edge_vectors(edges: DataFrame, datasets: int) -> DataFrame:
    """g1, g2, occ (sorted datasets) and sig (0/1 vector over datasets 1..n)."""
    occ = edges.groupBy("g1", "g2").agg(F.array_sort(F.collect_set("dataset_no")).alias("occ"))
    return occ.withColumn("sig", F.transform(F.sequence(F.lit(1), F.lit(datasets)), lambda i: F.array_contains("occ", i).cast("int")))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("g1").alias("gene")).unionByName(edges.select(F.col("g2").alias("gene")))


def degree_distribution(edges: DataFrame) -> DataFrame:
    """degree, vertices, share."""
    degrees = endpoints(edges).groupBy("gene").agg(F.count("*").alias("degree"))
    total = degrees.agg(F.count("*").alias("total"))
    return degrees.groupBy("degree").agg(F.count("*").alias("vertices")).crossJoin(F.broadcast(total)).select("degree", "vertices", (F.col("vertices") / F.col("total")).alias("share"))


def triangles(edges: DataFrame, by: list[str]) -> DataFrame:
    """a < b < c of each dataset: two edges that start alike and the edge that closes them.

    Edges run from the vertex of the smaller degree (ties: the smaller name) to the other, so that a hub starts few of them and
    the pairs formed stay near the number of edges times its square root.
    """
    e = edges.select(*by, F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2")).where("g1 < g2").distinct()
    degree = e.select(*by, F.explode(F.array("g1", "g2")).alias("g")).groupBy(*by, "g").agg(F.count("*").alias("d"))
    ranked = lambda g, d: degree.select(*by, F.col("g").alias(g), F.col("d").alias(d))
    e = e.join(ranked("g1", "d1"), [*by, "g1"]).join(ranked("g2", "d2"), [*by, "g2"])
    p, q = F.struct(F.col("d1").alias("d"), F.col("g1").alias("g")), F.struct(F.col("d2").alias("d"), F.col("g2").alias("g"))
    e = e.select(*by, F.least(p, q).alias("u"), F.greatest(p, q).alias("v"))
    one = lambda u, v: e.select(*by, F.col("u").alias(u), F.col("v").alias(v))
    met = one("u", "v").join(one("u", "w"), [*by, "u"]).where("v < w").join(one("v", "w"), [*by, "v", "w"])
    names = F.array_sort(F.array("u.g", "v.g", "w.g"))
    return met.select(*by, names.alias("n")).select(*by, *[F.col("n")[i].alias(k) for i, k in enumerate("abc")])


def in_blocks(rows: DataFrame, key: str, within: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """The rows twice, with columns __i and __j: joined on the key and these, all rows of a key meet each other, but no task
    holds more than some ``within`` of a key on either side, however many it has."""
    many = rows.groupBy(key).agg(F.ceil(F.count("*") / within).cast("int").alias("__n"))
    own = rows.join(many, key).withColumn("__b", F.pmod(F.xxhash64(*rows.columns), F.col("__n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    left = own.withColumn("__i", F.col("__b")).withColumn("__j", every).drop("__b", "__n")
    return left, own.withColumn("__i", every).withColumn("__j", F.col("__b")).drop("__b", "__n")


def four_cliques(edges: DataFrame, by: list[str]) -> DataFrame:
    t = triangles(edges, by)
    e = lambda p, q: edges.select(*by, F.col("g1").alias(p), F.col("g2").alias(q))
    return t.join(e("c", "d"), [*by, "c"]).join(e("a", "d"), [*by, "a", "d"], "left_semi").join(e("b", "d"), [*by, "b", "d"], "left_semi").select(*by, "a", "b", "c", "d")


def cluster_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """mcl_id, g1, g2 (and what else edges carry): edges with both ends in the cluster. ``edges`` has a row for each pair."""
    a = members.select("mcl_id", F.col("gene_no").alias("g1"))
    b = members.select("mcl_id", F.col("gene_no").alias("g2"))
    return edges.join(a, "g1").join(b, ["mcl_id", "g2"])


def shared_pairs(groups: DataFrame, classes: DataFrame, by: str, label: str, rows: int) -> DataFrame:
    """``label``, g1 < g2, n: pairs of genes that meet in a group (``by``, gene_no) and are of one class (gene_no, ``label``), once
    each, with n the product of the times that the class lists either.

    Classes are joined to the genes of a group before pairs are formed, so that a pair without a common class is never made, let
    alone shuffled. ``rows`` is about the number of rows of groups with a class, by which they are dealt to tasks.
    """
    times = classes.groupBy("gene_no", label).agg(F.count("*").alias("n"))
    own = groups.join(times, "gene_no").where(F.col(by).isNotNull() & F.col(label).isNotNull())
    own = dealt(own, by, label, rows=rows)
    end = lambda i: own.select(by, label, F.col("gene_no").alias(f"g{i}"), F.col("n").alias(f"n{i}"))
    pairs = end(1).join(end(2), [by, label]).where("g1 < g2")
    return pairs.groupBy(label, "g1", "g2").agg(F.max(F.col("n1") * F.col("n2")).alias("n"))


def connectivity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """mcl_id, vertices, edges, connectivity of the sub-graph that the members induce."""
    inside = cluster_edges(members, edges).groupBy("mcl_id").agg(F.count("*").alias("edges"))
    size = members.groupBy("mcl_id").agg(F.count("*").alias("vertices"))
    v, e = F.col("vertices"), F.coalesce(F.col("edges"), F.lit(0))
    return size.join(inside, "mcl_id", "left").select("mcl_id", "vertices", e.alias("edges"), F.when(v < 2, 0.0).otherwise(2.0 * e / (v * (v - 1))).alias("connectivity"))


def signature_edges(signatures: DataFrame, edges: DataFrame) -> DataFrame:
    """sig_id, g1, g2: edges whose datasets contain all datasets of the signature.

    Bit containment as an equi-join: one row for each (edge, dataset) of an edge list meets the signatures' items, and a
    pair stays when all items were met.
    """
    items = signatures.select("sig_id", F.size("items").alias("need"), F.explode("items").alias("dataset_no"))
    met = edges.select("dataset_no", "g1", "g2").distinct().join(items, "dataset_no").groupBy("sig_id", "need", "g1", "g2").agg(F.count("*").alias("met"))
    return met.where("met = need").select("sig_id", "g1", "g2")


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of an undirected edge list: u, v."""
    return edges.select(F.col("g1").alias("u"), F.col("g2").alias("v")).unionByName(edges.select(F.col("g2").alias("u"), F.col("g1").alias("v")))


def shortest_paths(edges: DataFrame, starts: DataFrame, max_length: int | None = None) -> DataFrame:
    """u, v, distance (up to ``max_length``, if given): breadth-first frontiers as joins, one step a round, cut after each, until
    nothing new is met."""
    both = cut(neighbours(edges).distinct(), "paths").select(F.col("u").alias("w"), "v")
    front = cut(starts.select(F.col("u"), F.col("u").alias("v"), F.lit(0).alias("distance")), "paths")
    seen, step = [front], 0
    while (max_length is None or step < max_length) and not front.isEmpty():
        step += 1
        nxt = front.select("u", F.col("v").alias("w")).join(both, "w").select("u", "v").distinct()
        # what lies one step on was met in this, the last or the last but one step, or is new
        for earlier in seen[-2:]:
            nxt = nxt.join(earlier.select("u", "v"), ["u", "v"], "left_anti")
        front = cut(nxt.select("u", "v", F.lit(step).alias("distance")), "paths")
        seen.append(front)
    out = seen[0]
    for x in seen[1:]:
        out = out.unionByName(x)
    return out
