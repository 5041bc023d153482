"""A term DAG: paths, depths, closures, distances, informative nodes, and judging predictions against it.

Paths start at the root and end at the term. Loops run until a round adds nothing; the number of rounds is the depth of
the DAG. A cycle would repeat a term on a path and is not followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweft.operators.tables import cut


def all_paths(edges: DataFrame, root: int) -> DataFrame:
    """term, path: every root-to-term path."""
    e = cut(edges.select("parent", "child"), "terms")
    front = cut(e.sparkSession.createDataFrame([(root, [root])], "term int, path array<int>"), "paths")
    out = [front]
    while True:  # ends by itself: no path holds a term twice
        step = front.join(e, F.col("term") == F.col("parent")).where(~F.array_contains("path", F.col("child"))).select(F.col("child").alias("term"), F.array_append("path", F.col("child")).alias("path"))
        front = cut(step, "paths")
        if front.isEmpty():
            break
        out.append(front)
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def depths(paths: DataFrame) -> DataFrame:
    """term, depth: shortest path in terms; the root has depth 1."""
    return paths.groupBy("term").agg(F.min(F.size("path")).alias("depth"))


def closure(paths: DataFrame) -> DataFrame:
    """ancestor, term: every term with itself and all terms above it."""
    return paths.select(F.explode("path").alias("ancestor"), "term").distinct()


def pair_distances(paths: DataFrame, pairs: DataFrame | None = None, blocks: int = 8) -> DataFrame:
    """t1 < t2, steps, depth_gap, shorter_leg, ancestors: each measure minimised by itself over all pairs of paths.

    For two paths the lowest common ancestor is the last term of the shorter one that lies on the longer one. ``steps`` are
    those from both terms to it, ``shorter_leg`` those from the nearer term, ``depth_gap`` is 15 less its depth. Only the
    given ``pairs`` (t1, t2) are looked at; without them all pairs of terms, dealt by blocks of terms.
    """
    a = paths.select(F.col("term").alias("t1"), F.col("path").alias("p1"))
    b = paths.select(F.col("term").alias("t2"), F.col("path").alias("p2"))
    if pairs is None:
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        block = lambda t: F.pmod(F.xxhash64(t), F.lit(blocks)).cast("int")
        met = a.select("*", block("t1").alias("i"), every.alias("j")).join(b.select("*", every.alias("i"), block("t2").alias("j")), ["i", "j"]).where("t1 < t2")
    else:
        met = pairs.select("t1", "t2").distinct().join(a, "t1").join(b, "t2")
    short = F.when(F.size("p1") <= F.size("p2"), F.col("p1")).otherwise(F.col("p2"))
    long = F.when(F.size("p1") <= F.size("p2"), F.col("p2")).otherwise(F.col("p1"))
    lca = F.element_at(F.filter(short, lambda x: F.array_contains(long, x)), -1)
    m = met.withColumn("lca", lca).withColumns({"i1": F.array_position("p1", F.col("lca")), "i2": F.array_position("p2", F.col("lca"))})
    m = m.withColumns({"d1": F.size("p1") - F.col("i1"), "d2": F.size("p2") - F.col("i2")})
    return m.groupBy("t1", "t2").agg(
        F.min(F.col("d1") + F.col("d2")).alias("steps"), F.min(15 - F.least("i1", "i2")).alias("depth_gap"), F.min(F.least("d1", "d2")).alias("shorter_leg"), F.array_sort(F.collect_set("lca")).alias("ancestors")
    )


def distance_of(pairs: DataFrame, paths: DataFrame, measure: str = "shorter_leg") -> DataFrame:
    """``pairs`` (a, b in any order) with their distance: 0 for a term with itself, null where a term has no path."""
    keyed = pairs.withColumns({"t1": F.least("a", "b"), "t2": F.greatest("a", "b")})
    found = pair_distances(paths, keyed.where("t1 <> t2")).select("t1", "t2", F.col(measure).alias("distance"))
    return keyed.join(found, ["t1", "t2"], "left").withColumn("distance", F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("distance"))).drop("t1", "t2")


def closed_genes(closed: DataFrame, associations: DataFrame) -> DataFrame:
    """go_no, gene_no: genes of a term or of any term below it."""
    return associations.join(closed.withColumnRenamed("term", "go_no"), "go_no").select(F.col("ancestor").alias("go_no"), "gene_no").distinct()


def informative(edges: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """go_no of the minimal terms of at least ``least`` genes: no child is that large."""
    big = sizes.where(F.col("size") >= least).select("go_no")
    with_big_child = edges.join(big.select(F.col("go_no").alias("child")), "child", "left_semi").select(F.col("parent").alias("go_no")).distinct()
    return big.join(with_big_child, "go_no", "left_anti")


def size_window(edges: DataFrame, sizes: DataFrame, low: int, high: int, closed: DataFrame) -> DataFrame:
    """go_no of terms whose size lies in a window and that have no such term above them."""
    hit = sizes.where(F.col("size").between(low, high)).select("go_no")
    below = closed.where("ancestor <> term").join(hit.select(F.col("go_no").alias("ancestor")), "ancestor", "left_semi").select(F.col("term").alias("go_no")).distinct()
    return hit.join(below, "go_no", "left_anti")


def sources_only(candidates: DataFrame, closed: DataFrame) -> DataFrame:
    """Candidates (go_no) that lie below no other candidate."""
    below = closed.where("ancestor <> term").join(candidates.select(F.col("go_no").alias("ancestor")), "ancestor", "left_semi").select(F.col("term").alias("go_no")).distinct()
    return candidates.join(below, "go_no", "left_anti")


def without_parents(annotations: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Annotations (key, go_no), once each, without those that have a child in the same record.

    A term and its parents are rows of the record side by side, and one grouping tells which terms are nobody's parent: where
    the annotations are dealt by key, nothing more is shuffled.
    """
    above = edges.groupBy(F.col("child").alias("go_no")).agg(F.collect_set("parent").alias("above"))
    none = F.array().cast(above.schema["above"].dataType)
    row = lambda t, own: F.struct(t.alias("go_no"), F.lit(own).alias("own"))
    parents = F.transform(F.when(F.col(key).isNotNull(), F.coalesce("above", none)).otherwise(none), lambda t: row(t, False))
    rows = annotations.join(above, "go_no", "left").select(key, F.explode(F.concat(F.array(row(F.col("go_no"), True)), parents)).alias("r")).select(key, "r.*")
    return rows.groupBy(key, "go_no").agg(F.bool_and("own").alias("free")).where("free").select(key, "go_no")


def judge(predictions: DataFrame, known: DataFrame, paths: DataFrame, depth_cut: int) -> DataFrame:
    """Distinct (gene_no, go_no) with is_correct (exact, deep enough), is_correct_l1 (equal or with a shorter leg of 1),
    is_correct_lca (a common ancestor of depth >= cut) and lca (deepest such ancestors); -1 where the gene has no function.

    Distances are computed for the pairs of a predicted and a known function that occur, not for all terms.
    """
    depth = cut(depths(paths), "depths")
    pairs = predictions.select("gene_no", "go_no").distinct()
    k = known.select("gene_no", F.col("go_no").alias("own"))
    met = pairs.join(k, "gene_no", "left")
    # all that is to be known of a pair of functions, once for each pair that occurs
    kinds = cut(met.where("go_no IS NOT NULL AND own IS NOT NULL").select("go_no", "own").distinct(), "kinds")
    kinds = kinds.withColumns({"t1": F.least("go_no", "own"), "t2": F.greatest("go_no", "own")})
    distances = cut(pair_distances(paths, kinds.where("t1 < t2")), "distances")
    same = F.col("go_no") == F.col("own")
    anc = F.explode_outer(F.when(same, F.array("own")).otherwise(F.col("ancestors")))
    kinds = kinds.join(distances, ["t1", "t2"], "left").join(depth.select(F.col("term").alias("go_no"), "depth"), "go_no", "left")
    kinds = kinds.select("go_no", "own", same.alias("same"), "shorter_leg", "depth", anc.alias("a")).join(depth.select(F.col("term").alias("a"), F.col("depth").alias("a_depth")), "a", "left")
    kinds = kinds.groupBy("go_no", "own").agg(
        F.bool_or(F.col("same") & (F.col("depth") >= depth_cut)).alias("l0"),
        F.bool_or(F.col("same") | (F.col("shorter_leg") == 1)).alias("l1"),
        F.max("a_depth").alias("deepest"),
        F.collect_set(F.when(F.col("a_depth") >= depth_cut, F.struct("a_depth", "a"))).alias("lcas"),
    )
    out = met.join(cut(kinds, "kinds"), ["go_no", "own"], "left").groupBy("gene_no", "go_no").agg(
        F.count("own").alias("n"), F.bool_or("l0").alias("l0"), F.bool_or("l1").alias("l1"), F.max("deepest").alias("deepest"), F.array_distinct(F.flatten(F.collect_list("lcas"))).alias("lcas")
    )
    flag = lambda c: F.when(F.col("n") == 0, -1).otherwise(F.coalesce(c, F.lit(False)).cast("int"))
    lca = F.array_sort(F.transform(F.filter("lcas", lambda x: x["a_depth"] == F.col("deepest")), lambda x: x["a"]))
    return out.select("gene_no", "go_no", flag(F.col("l0")).alias("is_correct"), flag(F.col("l1")).alias("is_correct_l1"), flag(F.col("deepest") >= depth_cut).alias("is_correct_lca"), lca.alias("lca"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the beginning that two path arrays share."""
    n = F.least(F.size(a), F.size(b))
    differ = F.array_min(F.filter(F.transform(F.zip_with(a, b, lambda x, y: x == y), lambda same, i: F.when(same, F.lit(None)).otherwise(i)), lambda i: i.isNotNull()))
    return F.coalesce(F.least(differ, n), n)


def with_root(shared: DataFrame, paths: DataFrame) -> DataFrame:
    """``shared`` (t1 < t2, shared) and, with 1, all other pairs of terms: every path begins with the root. Terms are dealt to
    blocks, so that no task holds all pairs."""
    n = F.lit(64)
    terms = paths.select("term").distinct().withColumn("b", F.pmod(F.xxhash64("term"), n))
    every = F.explode(F.sequence(F.lit(0), n - 1))
    a, b = terms.select(F.col("term").alias("t1"), F.col("b").alias("i"), every.alias("j")), terms.select(F.col("term").alias("t2"), every.alias("i"), F.col("b").alias("j"))
    pairs = a.join(b, ["i", "j"]).where("t1 < t2").select("t1", "t2")
    return pairs.join(shared, ["t1", "t2"], "left").select("t1", "t2", F.coalesce("shared", F.lit(1)).cast("long").alias("shared"))


def index_strings(paths: DataFrame) -> DataFrame:
    """term, index: every path as the string of its terms."""
    return paths.select("term", F.array_join(F.transform("path", lambda t: t.cast("string")), ",").alias("index"))


def _beginnings(index: Column) -> Column:
    """All proper beginnings of an index string that end before a comma."""
    parts = F.split(index, ",")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, 1, n), ",")))


def informative_indexes(indexes: DataFrame, associations: DataFrame, least: int) -> DataFrame:
    """go_no, index, genes: index strings with at least ``least`` genes at or below them and none such below.

    Genes move to all beginnings of their index, which an equi-join on the beginnings finds; an index that has a beginning of
    enough genes strikes it out. A term with several such indexes has several rows.
    """
    own = indexes.join(associations.withColumnRenamed("go_no", "term"), "term").select("index", "gene_no").distinct()
    up = own.unionByName(own.select(F.explode(_beginnings(F.col("index"))).alias("index"), "gene_no").where("index IS NOT NULL"))
    sizes = up.distinct().groupBy("index").agg(F.count("*").alias("genes")).where(F.col("genes") >= least)
    struck = sizes.select(F.explode(_beginnings(F.col("index"))).alias("index")).where("index IS NOT NULL").distinct()
    return sizes.join(struck, "index", "left_anti").join(indexes, "index").select(F.col("term").alias("go_no"), "index", "genes")
