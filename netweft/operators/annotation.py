"""Genes, functions, clusters and predictions: counting, judging, selecting, comparing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweft.operators.ranking import numbered


def accuracy(correct: Column) -> Column:
    """Correct share of the predictions that can be judged (flag 0 or 1; -1 is unknown); 0 if there are none."""
    return F.coalesce(F.count_if(correct == 1) / F.nullif(F.count_if(correct >= 0), F.lit(0)), F.lit(0.0))


def edge_classes(edges: DataFrame, associations: DataFrame, known: DataFrame) -> DataFrame:
    """go_no and the edges of six classes by their ends: 0 has the function, 1 has another one, 2 is unknown.

    Only ends that have the function are exploded, from the functions of both ends in one row of the edge, so that nothing but
    counts is shuffled by function; the classes without one follow from totals.
    """
    own = associations.groupBy("gene_no").agg(F.collect_set("go_no").alias("f"))
    k = known.select("gene_no", F.col("known").cast("int").alias("k")).join(own, "gene_no", "left")
    none = F.array().cast(own.schema["f"].dataType)
    k = k.withColumn("f", F.coalesce("f", none))
    end = lambda i: k.select(F.col("gene_no").alias(f"g{i}"), F.col("k").alias(f"k{i}"), F.col("f").alias(f"f{i}"))
    ends = edges.select("g1", "g2").join(end(1), "g1").join(end(2), "g2").select("k1", "k2", "f1", "f2")
    has = lambda found, h, ok: F.transform(found, lambda g: F.struct(g.alias("go_no"), F.lit(h).alias("h"), ok.alias("ok")))
    each = F.concat(has(F.array_intersect("f1", "f2"), 2, F.lit(1)), has(F.array_except("f1", "f2"), 1, F.col("k2")), has(F.array_except("f2", "f1"), 1, F.col("k1")))
    counts = ends.select(F.explode(each).alias("e")).select("e.*").groupBy("go_no").agg(
        F.count_if(F.col("h") == 2).alias("c00"),
        F.count_if((F.col("h") == 1) & (F.col("ok") == 1)).alias("c01"),
        F.count_if((F.col("h") == 1) & (F.col("ok") == 0)).alias("c02"),
    )
    total = ends.agg(F.count_if((F.col("k1") == 1) & (F.col("k2") == 1)).alias("kk"), F.count_if(F.col("k1") + F.col("k2") == 1).alias("ku"), F.count_if(F.col("k1") + F.col("k2") == 0).alias("uu"))
    return counts.crossJoin(total).select(
        "go_no", "c00", "c01", "c02", (F.col("kk") - F.col("c00") - F.col("c01")).alias("c11"), (F.col("ku") - F.col("c02")).alias("c12"), F.col("uu").alias("c22")
    )


def number_genes(found: DataFrame, existing: DataFrame) -> DataFrame:
    """gene_id, gene_no: numbers kept where they exist; new ids are numbered on from the largest, in the order of the id."""
    new = found.select("gene_id").distinct().join(existing, "gene_id", "left_anti")
    top = existing.agg(F.coalesce(F.max("gene_no"), F.lit(0)).alias("top"))
    named = numbered(new, ["gene_id"], "r").crossJoin(top).select("gene_id", (F.col("top") + F.col("r")).alias("gene_no"))
    return existing.select("gene_id", "gene_no").unionByName(named)


def category_split(a: DataFrame, b: DataFrame, keys: list[str], a_ok: str, b_ok: str) -> DataFrame:
    """keys and category: 'both', 'first', 'second' or 'neither' accepts the prediction."""
    x = a.select(*keys, F.col(a_ok).alias("__a"))
    y = b.select(*keys, F.col(b_ok).alias("__b"))
    p, q = F.coalesce(F.col("__a"), F.lit(False)), F.coalesce(F.col("__b"), F.lit(False))
    return x.join(y, keys, "full").select(*keys, F.when(p & q, "both").when(p, "first").when(q, "second").otherwise("neither").alias("category"))


def prune_clusters(clusters: DataFrame, mode: int) -> DataFrame:
    """Clusters without doubles: mcl_id (the smallest), vertex_set, recurrence, connectivity.

    Mode 0: same vertices and same edges, recurrence sets are united. Mode 1: same vertices and recurrence, the highest
    connectivity stays. Mode 2: same vertices, the highest connectivity stays, recurrence sets are united.
    """
    keys = {0: ["vertex_set", "edge_set"], 1: ["vertex_set", "recurrence"], 2: ["vertex_set"]}[mode]
    united = F.array_sort(F.array_distinct(F.flatten(F.collect_list("recurrence"))))
    first = F.min("recurrence") if mode == 1 else united
    keep = F.min("mcl_id") if mode == 0 else F.min_by("mcl_id", F.struct(-F.col("connectivity"), "mcl_id"))
    out = clusters.groupBy(*keys).agg(keep.alias("mcl_id"), first.alias("__rec"), F.max("connectivity").alias("connectivity"))
    return out.select("mcl_id", "vertex_set", F.col("__rec").alias("recurrence"), "connectivity")


def unknown_ratio(members: DataFrame, genes: DataFrame) -> DataFrame:
    """mcl_id, unknown: share of a cluster's genes that have no known function."""
    return members.join(genes, "gene_no", "left").groupBy("mcl_id").agg((1 - F.avg(F.coalesce(F.col("known"), F.lit(False)).cast("int"))).alias("unknown"))


def systematic(df: DataFrame, order: list, limit: int) -> DataFrame:
    """All rows up to ``limit``; beyond it every step-th one, step = rows // limit + 1."""
    total = df.agg(F.floor(F.count("*") / limit).alias("__s"))
    ranked = numbered(df, order, "__r").crossJoin(total)
    return ranked.where((F.col("__r") - 1) % (F.col("__s") + 1) == 0).drop("__r", "__s")


def permuted_genes(members: DataFrame, seed: int) -> DataFrame:
    """The same clusters with gene ids exchanged by a seeded permutation (a null model)."""
    genes = members.select("gene_no").distinct()
    here = numbered(genes, ["gene_no"], "r")
    there = numbered(genes.select(F.col("gene_no").alias("other"), F.xxhash64(F.lit(seed), "gene_no").alias("h")), ["h", "other"], "r").drop("h")
    return members.join(here.join(there, "r").select("gene_no", "other"), "gene_no").select("mcl_id", F.col("other").alias("gene_no"))


def organism_of(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``rows`` (with tax_id) with their organism, null where the taxonomy (tax_id, organism) has none; of several the first
    in alphabetical order (F26)."""
    one = taxonomy.groupBy("tax_id").agg(F.min("organism").alias("organism"))
    return rows.join(one, "tax_id", "left")


def tax_id_of(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``rows`` (with organism) with their tax_id, null where there is none; of several the smallest."""
    one = taxonomy.groupBy("organism").agg(F.min("tax_id").alias("tax_id"))
    return rows.join(one, "organism", "left")
