"""Scores of functions for a gene from the genes around it in a pattern, the leave-one-out scan of clusters, factors of a
cluster, and the collapse of redundant predictions.

A pattern's vertex has a layer: its distance from the gene that is predicted. For a function a vertex has it, has others only,
or is of unknown function; these three cases have scores. Sums of scores follow from counts of the vertices (or of the edges'
ends) that have the function and of those that are known, so no vertex is paired with every function.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweft.operators import graphs
from netweft.operators.ranking import first_ties, top_ranked
from netweft.operators.statistics import with_tail

HAS, OTHER = 3.0, -1.0  # fixed values: scores of a vertex with the function and of one with others only; unknown ones score 0


def layers(pattern_edges: DataFrame, max_layer: int) -> DataFrame:
    """mcl_id, gene_no, v, layer: vertices of a pattern up to ``max_layer`` steps from a gene of it, itself at 0.

    One breadth-first search over all patterns, whose vertices are packed as (pattern, gene).
    """
    packed = pattern_edges.select(*[(F.col("mcl_id").cast("long") * F.lit(2**32) + F.col(g)).alias(g) for g in ("g1", "g2")])
    found = graphs.shortest_paths(packed, graphs.endpoints(packed).distinct().withColumnRenamed("gene", "u"), max_layer)
    low = lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1)).cast("int")
    return found.select(F.shiftright("u", 32).alias("mcl_id"), low("u").alias("gene_no"), low("v").alias("v"), F.col("distance").alias("layer"))


def candidates(around: DataFrame, functions: DataFrame, least1: int, ratio1: float, least2: int, ratio2: float) -> DataFrame:
    """mcl_id, gene_no, go_no: functions with enough genes, as number and as share, on the first and on the second layer."""
    on = lambda i: F.count_if(F.col("layer") == i)
    near = around.where("layer in (1, 2)")
    sizes = near.groupBy("mcl_id", "gene_no").agg(on(1).alias("n1"), on(2).alias("n2"))
    found = near.join(functions.withColumnRenamed("gene_no", "v"), "v").groupBy("mcl_id", "gene_no", "go_no").agg(on(1).alias("c1"), on(2).alias("c2"))
    enough = f"c1 >= {least1} AND c1 >= {ratio1} * n1 AND c2 >= {least2} AND c2 >= {ratio2} * n2"
    return found.join(sizes, ["mcl_id", "gene_no"]).where(enough).select("mcl_id", "gene_no", "go_no")


def _summed(chosen: DataFrame, ends: DataFrame, functions: DataFrame, weights: DataFrame) -> DataFrame:
    """mcl_id, gene_no, go_no, key, total: sum of the scores of ``ends`` (mcl_id, gene_no, key, v, and w, a score's factor, if they
    differ) for each function chosen."""
    each = F.col("w") if "w" in ends.columns else F.lit(1)
    keys = ["mcl_id", "gene_no"]
    known = functions.select(F.col("gene_no").alias("v"), F.lit(1).alias("known")).distinct()
    all_known = ends.join(known, "v", "left").groupBy(*keys, "key").agg(F.coalesce(F.sum(each * F.col("known")), F.lit(0)).alias("k"))
    has = ends.join(functions.withColumnRenamed("gene_no", "v"), "v").groupBy(*keys, "key", "go_no").agg(F.sum(each).alias("h"))
    h = F.coalesce(F.col("h"), F.lit(0))
    every = chosen.join(all_known, keys).join(has, [*keys, "key", "go_no"], "left")
    return every.select(*keys, "go_no", "key", (HAS * h + OTHER * (F.col("k") - h)).alias("total")).join(weights, [*keys, "key"])


def vertex_gradient(around: DataFrame, chosen: DataFrame, functions: DataFrame, exponent: float = 2.0) -> DataFrame:
    """mcl_id, gene_no, go_no, score: scores of the vertices over the squared power of their layer."""
    ends = around.where("layer >= 1").select("mcl_id", "gene_no", F.col("layer").alias("key"), "v")
    weights = ends.select("mcl_id", "gene_no", "key").distinct().withColumn("weight", F.pow(F.col("key").cast("double"), -2.0 * exponent))
    summed = _summed(chosen, ends, functions, weights)
    return summed.groupBy("mcl_id", "gene_no", "go_no").agg(F.sum(F.col("total") * F.col("weight")).alias("score"))


def layer_gradient(around: DataFrame, chosen: DataFrame, functions: DataFrame, exponent: float = 2.0, norm: float = 0.8) -> DataFrame:
    """The same by vertices, key 2 * layer, over n^norm * key^exponent with n vertices on the layer (T11, by vertices)."""
    ends = around.where("layer >= 1").select("mcl_id", "gene_no", (2 * F.col("layer")).alias("key"), "v")
    weights = ends.groupBy("mcl_id", "gene_no", "key").agg((1 / (F.pow(F.count("*").cast("double"), norm) * F.pow(F.first("key").cast("double"), exponent))).alias("weight"))
    summed = _summed(chosen, ends, functions, weights)
    return summed.groupBy("mcl_id", "gene_no", "go_no").agg(F.sum(F.col("total") * F.col("weight")).alias("score"))


def edge_gradient(pattern_edges: DataFrame, around: DataFrame, chosen: DataFrame, functions: DataFrame, exponent: float = 2.0, norm: float = 0.8, skip_mixed: bool = False, p_value: str | None = None) -> DataFrame:
    """mcl_id, gene_no, go_no, score by edges (T11, T12): an edge's key is the sum of its ends' layers; it adds the scores of its
    ends, but for the gene itself. A key's sum is divided by a power of the number of edges that could have it and by
    key^exponent. ``skip_mixed`` leaves out edges whose first end has the function and whose second one has others only.
    With ``p_value``, a column of the edges, an edge's scores count -log10 of it times (a null or no positive one: not at all).
    """
    keys = ["mcl_id", "gene_no"]
    p = F.lit(1.0) if p_value is None else F.coalesce(F.when(F.col(p_value) > 0, -F.log10(p_value)), F.lit(0.0))
    at = lambda g, n: around.select(*keys, F.col("v").alias(g), F.col("layer").alias(n))
    placed = pattern_edges.select("mcl_id", "g1", "g2", p.alias("w")).join(at("g1", "l1"), ["mcl_id", "g1"]).join(at("g2", "l2"), [*keys, "g2"])
    placed = placed.withColumn("key", F.when(F.least("l1", "l2") == 0, 2 * F.greatest("l1", "l2") - 1).otherwise(F.col("l1") + F.col("l2")))
    ends = placed.where("l1 > 0").select(*keys, "key", "w", F.col("g1").alias("v")).unionByName(placed.where("l2 > 0").select(*keys, "key", "w", F.col("g2").alias("v")))
    n = around.groupBy(*keys, "layer").agg(F.count("*").cast("double").alias("n"))
    odd = n.where("layer >= 1").join(n.select(*keys, (F.col("layer") + 1).alias("layer"), F.col("n").alias("inner")), [*keys, "layer"])
    power = F.when(F.col("layer") == 1, norm - 0.2).otherwise(norm)
    key = lambda k: F.pow(k.cast("double"), exponent)
    across, inside = 2 * F.col("layer") - 1, 2 * F.col("layer")
    weights = odd.select(*keys, across.alias("key"), (1 / (F.pow(F.col("inner") * F.col("n"), power) * key(across))).alias("weight"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    weights = weights.unionByName(n.where("layer >= 1 AND n > 1").select(*keys, inside.alias("key"), (1 / (F.pow(pairs, norm) * key(inside))).alias("weight")))
    summed = _summed(chosen, ends, functions, weights)
    if skip_mixed:
        f1, f2 = functions.withColumnRenamed("gene_no", "g1"), functions.withColumnRenamed("gene_no", "g2")
        mixed = placed.where("l1 > 0 AND l2 > 0").join(f1, "g1").join(f2.select("g2").distinct(), "g2", "left_semi").join(f2, ["g2", "go_no"], "left_anti")
        mixed = mixed.groupBy(*keys, "go_no", "key").agg(F.sum("w").alias("mixed"))
        summed = summed.join(mixed, [*keys, "go_no", "key"], "left").withColumn("total", F.col("total") - (HAS + OTHER) * F.coalesce(F.col("mixed"), F.lit(0)))
    return summed.groupBy(*keys, "go_no").agg(F.sum(F.col("total") * F.col("weight")).alias("score"))


def best_functions(scores: DataFrame) -> DataFrame:
    """All functions of a (pattern, gene) with the highest score, rounded to twelve places so that equal sums tie."""
    return first_ties(scores.withColumn("score", F.round("score", 12)), ["mcl_id", "gene_no"], [F.desc("score")])


def cluster_scan(members: DataFrame, associations: DataFrame, depth: DataFrame, total: int, least: int = 3, min_size: int = 5, min_depth: int = 2, uniformity: float = 0.05, bonferroni: bool = False, move_left_out: bool = False) -> DataFrame:
    """mcl_id, gene_no, go_no, p, unknown: of each gene of a cluster the functions with the least tail when it is left out.

    A function must have ``least`` genes in the cluster before the gene is left out, ``min_size`` genes in all, depth
    ``min_depth``, and ``uniformity`` as share of the known genes that are left. The gene leaves the counts x and m where it has
    the function, the cluster and the total; with ``move_left_out`` it stays in these two and becomes unknown. ``bonferroni``
    multiplies by the number of functions left in the cluster, the unknown ones as one.
    """
    one = F.lit(1)
    known = associations.select("gene_no", one.alias("known")).distinct()
    own = members.join(known, "gene_no", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    sizes = own.groupBy("mcl_id").agg(F.count("*").alias("k0"), F.sum("known").alias("known0"))
    local = members.join(associations, "gene_no").groupBy("mcl_id", "go_no").agg(F.count("*").alias("x0"))
    counted = local.groupBy("mcl_id").agg(F.count("*").alias("functions"))
    alone = members.join(associations, "gene_no").join(local.where("x0 = 1"), ["mcl_id", "go_no"]).groupBy("mcl_id", "gene_no").agg(F.count("*").alias("gone"))
    m = associations.groupBy("go_no").agg(F.countDistinct("gene_no").alias("m0"))
    fit = local.where(F.col("x0") >= least).join(m.where(F.col("m0") >= min_size), "go_no").join(depth.where(F.col("depth") >= min_depth).select(F.col("term").alias("go_no")), "go_no", "left_semi")
    has = associations.select("gene_no", "go_no", one.alias("has"))
    each = fit.join(own, "mcl_id").join(sizes, "mcl_id").join(counted, "mcl_id").join(alone, ["mcl_id", "gene_no"], "left").join(has, ["gene_no", "go_no"], "left")
    h = F.coalesce(F.col("has"), F.lit(0))
    less = 0 if move_left_out else 1
    unknown = F.col("k0") - F.col("known0") + (F.col("known") if move_left_out else F.col("known") - 1)
    each = each.select("mcl_id", "gene_no", "go_no", (F.col("x0") - h).alias("x"), (F.col("m0") - h).alias("m"), (F.col("k0") - less).alias("k"), (F.col("known0") - F.col("known")).alias("left"), unknown.alias("unknown"), (F.col("functions") - F.coalesce(F.col("gone"), F.lit(0))).alias("functions"))
    each = each.where(F.col("x") >= uniformity * F.col("left"))
    p = F.col("p") * (F.col("functions") + (F.col("unknown") > 0).cast("int")) if bonferroni else F.col("p")
    scored = with_tail(each, total - less).select("mcl_id", "gene_no", "go_no", F.round(p, 9).alias("p"), F.when(F.col("k") > 0, F.col("unknown") / F.col("k")).otherwise(0.0).alias("unknown"))
    return first_ties(scored, ["mcl_id", "gene_no"], ["p"])


def factor_hits(members: DataFrame, sites: DataFrame, ratio: float = 1 / 3, p_cut: float = 0.001, top: int = 5) -> DataFrame:
    """mcl_id, b1, b2 (null for a single factor), x, p: factors, and pairs of them, that the genes of a cluster bind more often
    than all genes do; of each kind the ``top`` with the least p (P13, W8). Both factors must bind ``ratio`` of the cluster."""
    k = members.groupBy("mcl_id").agg(F.count("*").alias("k"))
    total = sites.select("gene_no").distinct().count()
    bound = members.join(sites, "gene_no")
    local = bound.groupBy("mcl_id", "b").agg(F.count("*").alias("x")).join(k, "mcl_id").where(F.col("x") >= ratio * F.col("k"))
    single = local.join(sites.groupBy("b").agg(F.count("*").alias("m")), "b").select("mcl_id", F.col("b").alias("b1"), F.lit(None).cast("int").alias("b2"), "x", "m", "k")
    enough = bound.join(local.select("mcl_id", "b"), ["mcl_id", "b"], "left_semi")
    twice = lambda df, keys: df.withColumnRenamed("b", "b1").join(df.withColumnRenamed("b", "b2"), keys).where("b1 < b2")
    overall = twice(sites, ["gene_no"]).groupBy("b1", "b2").agg(F.count("*").alias("m"))
    pair = twice(enough, ["mcl_id", "gene_no"]).groupBy("mcl_id", "b1", "b2").agg(F.count("*").alias("x")).join(overall, ["b1", "b2"]).join(k, "mcl_id").select("mcl_id", "b1", "b2", "x", "m", "k")
    scored = with_tail(single.unionByName(pair), total).withColumn("p", F.round("p", 9)).where(F.col("p") <= p_cut)
    best = top_ranked(scored.withColumn("pair", F.col("b2").isNotNull()), ["mcl_id", "pair"], ["p", "b1", "b2"], top)
    return best.select("mcl_id", "b1", "b2", "x", "p")


def greedy(items: Column, similar: Callable, merge: Callable) -> Column:
    """Groups of an array, first come first: an item joins the first group it is similar to (``merge``), or opens one."""

    def add(groups: Column, x: Column) -> Column:
        hit = F.array_position(F.transform(groups, lambda g: similar(g, x)), F.lit(True))
        joined = F.transform(groups, lambda g, i: F.when(i + 1 == hit, merge(g, x)).otherwise(g))
        return F.when(hit == 0, F.concat(groups, F.array(x))).otherwise(joined)

    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 1, 1), add)


def collapse_related(predictions: DataFrame, closed: DataFrame, key: str, order: str) -> DataFrame:
    """key, go_no, source: of a key's functions, in the order given, one that lies above or below an earlier source goes to the
    first such source (O14; O17 with one key for all). A key has no more functions than the ontology has terms."""
    above = closed.where("ancestor <> term").groupBy(F.col("term").alias("go_no")).agg(F.collect_set("ancestor").alias("above"))
    one = predictions.groupBy(key, "go_no").agg(F.min(order).alias("at")).join(above, "go_no", "left")
    one = one.withColumn("above", F.coalesce("above", F.array().cast("array<int>")))
    item = F.struct("at", "go_no", "above", F.array("go_no").alias("members"))
    listed = one.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    related = lambda g, x: F.array_contains(g["above"], x["go_no"]) | F.array_contains(x["above"], g["go_no"])
    merge = lambda g, x: F.struct(g["at"].alias("at"), g["go_no"].alias("go_no"), g["above"].alias("above"), F.concat(g["members"], x["members"]).alias("members"))
    groups = listed.select(key, F.explode(greedy(F.col("items"), related, merge)).alias("g"))
    return groups.select(key, F.explode("g.members").alias("go_no"), F.col("g.go_no").alias("source"))


def merge_contexts(predictions: DataFrame, contrast: float, key: str = "gene_no") -> DataFrame:
    """key, go_no (the first of its group), members, context, is_correct: functions of a key in the order of go_no, merged where
    the share of genes that aren't common is below ``contrast`` on either side; contexts unite, flags are multiplied (O18).

    ``predictions``: key, go_no, context (array), is_correct, one row for each (key, go_no). A key's functions are folded by one
    kernel call over a byte for each group and gene: a context is compared with all groups in the time of its own length.
    """
    types = {c: predictions.schema[c].dataType.simpleString() for c in (key, "go_no", "context", "is_correct")}

    def plain(x):  # pandas makes floats of integers beside nulls
        return None if pd.isna(x) else int(x) if isinstance(x, float) else x

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("go_no", na_position="first")
        ids, at = np.unique(np.concatenate(list(rows["context"])), return_inverse=True)
        held = np.zeros((len(rows), len(ids)), bool)  # a row for each group: the genes of its context
        sizes, groups = np.zeros(len(rows), int), []  # groups: members, is_correct
        ends = np.cumsum([len(c) for c in rows["context"]])[:-1]
        for go, each, ok in zip(map(plain, rows["go_no"]), np.split(at, ends), map(plain, rows["is_correct"])):
            own, n = np.unique(each), len(groups)
            common = held[:n, own].sum(1)
            near = np.flatnonzero((1 - common / np.maximum(sizes[:n], 1) < contrast) | (1 - common / max(len(own), 1) < contrast))
            if len(near):
                g = groups[near[0]]
                g[0].append(go)
                g[1] = None if g[1] is None or ok is None else g[1] * ok
            else:
                groups.append([[go], ok])
            k = near[0] if len(near) else n
            held[k, own] = True
            sizes[k] = held[k].sum()
        return pd.DataFrame({key: [rows[key].iloc[0]] * len(groups), "go_no": [g[0][0] for g in groups], "members": [g[0] for g in groups], "context": [ids[held[k]] for k in range(len(groups))], "is_correct": [g[1] for g in groups]})

    out = f"{key} {types[key]}, go_no {types['go_no']}, members array<{types['go_no']}>, context {types['context']}, is_correct {types['is_correct']}"
    return predictions.select(*types).groupBy(key).applyInPandas(fold, out)


def topologies(around: DataFrame, distance: int, similarity: float) -> DataFrame:
    """gene_no, mcl_id, topology: patterns of a gene whose vertices within ``distance`` of it are alike (common ones reach
    ``similarity`` of either side), joined to components named by their smallest pattern (O15, O16)."""
    from netweft.operators.components import connected_components

    near = around.where((F.col("layer") >= 1) & (F.col("layer") <= distance)).select("gene_no", "mcl_id", "v")
    n = near.groupBy("gene_no", "mcl_id").agg(F.count("*").alias("n"))
    a, b = near.withColumnRenamed("mcl_id", "m1"), near.withColumnRenamed("mcl_id", "m2")
    common = a.join(b, ["gene_no", "v"]).where("m1 < m2").groupBy("gene_no", "m1", "m2").agg(F.count("*").alias("i"))
    size = lambda m, name: n.select("gene_no", F.col("mcl_id").alias(m), F.col("n").alias(name))
    alike = common.join(size("m1", "n1"), ["gene_no", "m1"]).join(size("m2", "n2"), ["gene_no", "m2"]).where(F.col("i") >= similarity * F.least("n1", "n2"))
    packed = lambda m: F.col("gene_no").cast("long") * F.lit(2**32) + F.col(m)
    found = connected_components(alike.select(packed("m1").alias("a"), packed("m2").alias("b")))
    low = lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1))
    named = found.select(F.shiftright("id", 32).cast("int").alias("gene_no"), low("id").alias("mcl_id"), low("component").alias("topology"))
    return n.select("gene_no", "mcl_id").join(named, ["gene_no", "mcl_id"], "left").withColumn("topology", F.coalesce("topology", "mcl_id"))
