"""Queries on datasets x edges: overlays, support, cliques, recurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.functions import arrays
from netweft.operators import graphs, ranking
from netweft.operators.components import connected_components
from netweft.plans import adapters as A
from netweft.plans.registry import query

SUPPORT = 2
DATASETS = 28  # quarters that the order dates span


@query("a1_graph_overlay", f"WITH {A.EDGES} SELECT g1, g2, count(*) AS recurrence FROM edge GROUP BY g1, g2 HAVING count(*) >= {SUPPORT}")
def overlay(spark: SparkSession, d: str) -> DataFrame:
    return graphs.overlay(A.edges(spark, d), SUPPORT)


@query("p1_support_window", f"WITH {A.EDGES} SELECT g1, g2, count(*) AS recurrence FROM edge GROUP BY g1, g2 HAVING count(*) BETWEEN 2 AND 4")
def support_window(spark: SparkSession, d: str) -> DataFrame:
    return graphs.overlay(A.edges(spark, d), 2, 4)


@query("w1_top_edges", f"WITH {A.EDGES}, o AS (SELECT g1, g2, count(*) AS recurrence FROM edge GROUP BY g1, g2) SELECT g1, g2, recurrence FROM o ORDER BY recurrence DESC, g1, g2 LIMIT 40")
def top_edges(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_edges(graphs.overlay(A.edges(spark, d)), 40, "recurrence")


@query("w2_top_edges_per_dataset", f"WITH {A.EDGE_COUNTS} SELECT dataset_no, g1, g2, n FROM (SELECT *, row_number() OVER (PARTITION BY dataset_no ORDER BY n DESC, g1, g2) AS r FROM ec) WHERE r <= 10")
def top_edges_per_dataset(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_ranked(A.edge_counts(spark, d), ["dataset_no"], [F.desc("n"), "g1", "g2"], 10)


@query("w3_lowest_weight_of_graph", f"WITH {A.EDGES} SELECT dataset_no, min(n) AS cut_off FROM edge GROUP BY dataset_no")
def lowest_weight(spark: SparkSession, d: str) -> DataFrame:
    return A.edges(spark, d).groupBy("dataset_no").agg(F.min("n").alias("cut_off"))


@query("s4_edge_vectors", f"WITH {A.EDGES} SELECT g1, g2, array_to_string(list_sort(list(dataset_no)), ' ') AS occ, CAST(count(*) AS BIGINT) AS support FROM edge GROUP BY g1, g2")
def edge_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = graphs.edge_vectors(A.edges(spark, d), DATASETS)
    return v.select("g1", "g2", F.array_join(F.transform("occ", lambda x: x.cast("string")), " ").alias("occ"), F.aggregate("sig", F.lit(0).cast("long"), lambda a, x: a + x).alias("support"))


@query("f4_mask_encode", f"WITH {A.EDGES} SELECT g1, g2, CAST(sum(1::BIGINT << (dataset_no - 1)) AS BIGINT) AS mask FROM edge GROUP BY g1, g2")
def mask(spark: SparkSession, d: str) -> DataFrame:
    return graphs.edge_vectors(A.edges(spark, d), DATASETS).select("g1", "g2", arrays.encode_mask(F.col("occ")).alias("mask"))


@query("f5_mask_decode", f"WITH {A.EDGES} SELECT g1, g2, array_to_string(list_sort(list(dataset_no)), ',') AS positions FROM edge GROUP BY g1, g2")
def unmask(spark: SparkSession, d: str) -> DataFrame:
    m = graphs.edge_vectors(A.edges(spark, d), DATASETS).select("g1", "g2", arrays.encode_mask(F.col("occ")).alias("mask"))
    return m.select("g1", "g2", F.array_join(F.transform(arrays.decode_mask(F.col("mask"), DATASETS), lambda x: x.cast("string")), ",").alias("positions"))


SIGNATURES = "sg AS (SELECT row_number() OVER (ORDER BY a, b) AS sig_id, a, b FROM (SELECT a.dataset_no AS a, b.dataset_no AS b FROM edge a JOIN edge b ON a.g1 = b.g1 AND a.g2 = b.g2 AND a.dataset_no < b.dataset_no GROUP BY ALL HAVING count(*) >= 4))"


def pair_signatures(edges: DataFrame) -> DataFrame:
    """Dataset pairs that at least four edges share, numbered in order."""
    from pyspark.sql import Window

    other = edges.select("g1", "g2", F.col("dataset_no").alias("b"))
    pairs = edges.join(other, ["g1", "g2"]).where("dataset_no < b").groupBy(F.col("dataset_no").alias("a"), "b").count().where("count >= 4")
    return pairs.select(F.row_number().over(Window.orderBy("a", "b")).cast("long").alias("sig_id"), F.array("a", "b").alias("items"))


@query("j13_signature_containment", f"WITH {A.EDGES}, {SIGNATURES} SELECT sig_id, x.g1, x.g2 FROM sg JOIN edge x ON x.dataset_no = a JOIN edge y ON y.dataset_no = b AND x.g1 = y.g1 AND x.g2 = y.g2")
def signature_containment(spark: SparkSession, d: str) -> DataFrame:
    e = A.edges(spark, d)
    return graphs.signature_edges(pair_signatures(e), e)


@query(
    "i2_signature_patterns",
    f"""WITH RECURSIVE {A.EDGES}, {SIGNATURES},
se AS (SELECT sig_id, x.g1, x.g2 FROM sg JOIN edge x ON x.dataset_no = a JOIN edge y ON y.dataset_no = b AND x.g1 = y.g1 AND x.g2 = y.g2),
bo AS (SELECT sig_id, g1 AS u, g2 AS v FROM se UNION ALL SELECT sig_id, g2, g1 FROM se),
re AS (SELECT sig_id, u AS s, u AS v FROM bo UNION SELECT re.sig_id, s, bo.v FROM re JOIN bo ON re.sig_id = bo.sig_id AND re.v = bo.u)
SELECT sig_id, comp AS component, count(*) AS vertices, string_agg(s::VARCHAR, ' ' ORDER BY s) AS vertex_set FROM (SELECT sig_id, s, min(v) AS comp FROM re GROUP BY sig_id, s) GROUP BY sig_id, comp HAVING count(*) >= 3""",
)
def signature_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each signature, cut into connected components: one component run over (signature, vertex) ids."""
    e = A.edges(spark, d)
    se = graphs.signature_edges(pair_signatures(e), e)
    packed = lambda g: F.col("sig_id") * F.lit(2**32) + F.col(g)
    comp = connected_components(se.select(packed("g1").alias("a"), packed("g2").alias("b")))
    low = lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1)).cast("int")
    flat = comp.select(F.shiftright("id", 32).alias("sig_id"), low("id").alias("g"), low("component").alias("component"))
    out = flat.groupBy("sig_id", "component").agg(F.count("*").alias("vertices"), F.array_join(F.transform(F.array_sort(F.collect_list("g")), lambda x: x.cast("string")), " ").alias("vertex_set"))
    return out.where("vertices >= 3")


@query("a21_degree_distribution", f"WITH {A.EDGES}, o AS (SELECT g1, g2 FROM edge GROUP BY g1, g2 HAVING count(*) >= 2), dg AS (SELECT g, count(*) AS degree FROM (SELECT g1 AS g FROM o UNION ALL SELECT g2 FROM o) GROUP BY g) SELECT degree, count(*) AS vertices, count(*) / (SELECT count(*) FROM dg) AS share FROM dg GROUP BY degree")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graphs.degree_distribution(graphs.overlay(A.edges(spark, d), 2))


TRIANGLES = "tri AS (SELECT x.dataset_no, x.g1 AS a, x.g2 AS b, y.g2 AS c FROM edge x JOIN edge y ON x.dataset_no = y.dataset_no AND x.g1 = y.g1 AND x.g2 < y.g2 JOIN edge z ON z.dataset_no = x.dataset_no AND z.g1 = x.g2 AND z.g2 = y.g2)"


@query("g12_triangles", f"WITH {A.EDGES}, {TRIANGLES} SELECT dataset_no, a, b, c FROM tri")
def triangles(spark: SparkSession, d: str) -> DataFrame:
    return graphs.triangles(A.edges(spark, d), ["dataset_no"])


@query("g13_triangle_counts", f"WITH {A.EDGES}, {TRIANGLES} SELECT freq, count(*) AS cliques FROM (SELECT a, b, c, count(*) AS freq FROM tri GROUP BY a, b, c) GROUP BY freq")
def triangle_counts(spark: SparkSession, d: str) -> DataFrame:
    return graphs.triangles(A.edges(spark, d), ["dataset_no"]).groupBy("a", "b", "c").agg(F.count("*").alias("freq")).groupBy("freq").agg(F.count("*").alias("cliques"))


@query("g14_triangle_filter", f"WITH {A.EDGES}, {TRIANGLES} SELECT dataset_no, a, b, c FROM tri WHERE a % 2 = 1 AND b % 2 = 1 AND c % 2 = 1")
def triangle_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = spark.range(1, 100, 2).select(F.col("id").cast("int").alias("gene"))
    out = graphs.triangles(A.edges(spark, d), ["dataset_no"])
    for v in ("a", "b", "c"):
        out = out.join(kept.withColumnRenamed("gene", v), v, "left_semi")
    return out.select("dataset_no", "a", "b", "c")


@query("g12_four_cliques", f"WITH {A.EDGES}, o AS (SELECT g1, g2 FROM edge GROUP BY g1, g2 HAVING count(*) >= 2) SELECT p.g1 AS a, p.g2 AS b, q.g2 AS c, r.g2 AS d FROM o p JOIN o q ON q.g1 = p.g1 AND q.g2 > p.g2 JOIN o r ON r.g1 = p.g1 AND r.g2 > q.g2 JOIN o s ON s.g1 = p.g2 AND s.g2 = q.g2 JOIN o t ON t.g1 = p.g2 AND t.g2 = r.g2 JOIN o u ON u.g1 = q.g2 AND u.g2 = r.g2")
def four_cliques(spark: SparkSession, d: str) -> DataFrame:
    return graphs.four_cliques(graphs.overlay(A.edges(spark, d), 2).select("g1", "g2"), [])


@query(
    "g1_connected_components",
    f"""WITH RECURSIVE {A.EDGES}, o AS (SELECT g1, g2 FROM edge GROUP BY g1, g2 HAVING count(*) >= 3), bo AS (SELECT g1 AS u, g2 AS v FROM o UNION ALL SELECT g2, g1 FROM o),
re AS (SELECT u AS s, u AS v FROM bo UNION SELECT s, bo.v FROM re JOIN bo ON re.v = bo.u) SELECT s AS id, min(v) AS component FROM re GROUP BY s""",
)
def components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(graphs.overlay(A.edges(spark, d), 3), "g1", "g2")


@query(
    "g2_shortest_paths",
    f"""WITH RECURSIVE {A.EDGES}, o AS (SELECT g1, g2 FROM edge GROUP BY g1, g2 HAVING count(*) >= 3), bo AS (SELECT g1 AS u, g2 AS v FROM o UNION ALL SELECT g2, g1 FROM o),
re AS (SELECT u, u AS v, 0 AS distance FROM bo UNION SELECT re.u, bo.v, distance + 1 FROM re JOIN bo ON re.v = bo.u WHERE distance < (SELECT count(DISTINCT u) FROM bo)) SELECT u, v, min(distance) AS distance FROM re GROUP BY u, v""",
)
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    e = graphs.overlay(A.edges(spark, d), 3)
    return graphs.shortest_paths(e, graphs.endpoints(e).distinct().withColumnRenamed("gene", "u"))


@query("a7_presence_matrix", f"WITH {A.BRANDS} SELECT gene, count(DISTINCT dataset_no) AS frequency, string_agg(DISTINCT dataset_no::VARCHAR, ' ' ORDER BY dataset_no::VARCHAR) AS datasets FROM lq GROUP BY gene")
def presence(spark: SparkSession, d: str) -> DataFrame:
    g = A.brand_datasets(spark, d).groupBy("gene").agg(F.collect_set(F.col("dataset_no").cast("string")).alias("s"))
    return g.select("gene", F.size("s").cast("long").alias("frequency"), F.array_join(F.array_sort("s"), " ").alias("datasets"))


@query("p5_frequent_genes", f"WITH {A.BRANDS} SELECT gene, count(*) AS n FROM (SELECT DISTINCT gene, dataset_no FROM lq) GROUP BY gene HAVING count(*) >= 20")
def frequent_genes(spark: SparkSession, d: str) -> DataFrame:
    return A.brand_datasets(spark, d).select("gene", "dataset_no").distinct().groupBy("gene").agg(F.count("*").alias("n")).where("n >= 20")


@query("p6_both_known_edges", f"WITH {A.EDGES}, k AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS gene FROM part WHERE p_type = 'SMALL' AND p_size <= 10) SELECT dataset_no, g1, g2, n FROM edge WHERE g1 IN (FROM k) AND g2 IN (FROM k)")
def both_known(spark: SparkSession, d: str) -> DataFrame:
    known = A.table(spark, d, "part").where("p_type = 'SMALL' AND p_size <= 10").select(F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("gene")).distinct()
    return A.edges(spark, d).join(known.withColumnRenamed("gene", "g1"), "g1", "left_semi").join(known.withColumnRenamed("gene", "g2"), "g2", "left_semi").select("dataset_no", "g1", "g2", "n")


@query("p7_any_known_edges", f"WITH {A.EDGES}, k AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS gene FROM part WHERE p_size = 1) SELECT dataset_no, g1, g2, g1 IN (FROM k) AND g2 IN (FROM k) AS both FROM edge WHERE g1 IN (FROM k) OR g2 IN (FROM k)")
def any_known(spark: SparkSession, d: str) -> DataFrame:
    known = A.table(spark, d, "part").where("p_size = 1").select(F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("gene")).distinct().withColumn("k", F.lit(True))
    e = A.edges(spark, d).join(known.select(F.col("gene").alias("g1"), F.col("k").alias("k1")), "g1", "left").join(known.select(F.col("gene").alias("g2"), F.col("k").alias("k2")), "g2", "left")
    return e.where("k1 OR k2").select("dataset_no", "g1", "g2", F.coalesce(F.col("k1") & F.col("k2"), F.lit(False)).alias("both"))


CLUSTERS = "cl AS (SELECT DISTINCT l_suppkey % 20 AS mcl_id, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS gene_no FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49 AND p_size <= 6)"


def brand_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part").where("p_size <= 6").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("gene_no"))
    return A.table(spark, d, "lineitem").where("l_quantity >= 49").join(p, "l_partkey").select((F.col("l_suppkey") % 20).alias("mcl_id"), "gene_no").distinct()


@query(
    "f21_cluster_density",
    f"""WITH {A.EDGES}, o AS (SELECT g1, g2 FROM edge GROUP BY g1, g2), {CLUSTERS},
ce AS (SELECT a.mcl_id, count(*) AS e FROM o JOIN cl a ON a.gene_no = g1 JOIN cl b ON b.gene_no = g2 AND a.mcl_id = b.mcl_id GROUP BY a.mcl_id), v AS (SELECT mcl_id, count(*) AS v FROM cl GROUP BY mcl_id)
SELECT mcl_id, v AS vertices, coalesce(e, 0) AS edges, round(CASE WHEN v < 2 THEN 0 ELSE 2.0 * coalesce(e, 0) / (v * (v - 1)) END, 6) AS connectivity FROM v LEFT JOIN ce USING (mcl_id)""",
)
def cluster_density(spark: SparkSession, d: str) -> DataFrame:
    c = graphs.connectivity(brand_clusters(spark, d), graphs.overlay(A.edges(spark, d)).select("g1", "g2"))
    return c.withColumn("connectivity", F.round("connectivity", 6))


RECURRENCE = f"""{A.EDGES}, o AS (SELECT g1, g2 FROM edge GROUP BY g1, g2), {CLUSTERS},
ce AS (SELECT a.mcl_id, g1, g2 FROM o JOIN cl a ON a.gene_no = g1 JOIN cl b ON b.gene_no = g2 AND a.mcl_id = b.mcl_id), ne AS (SELECT mcl_id, count(*) AS e FROM ce GROUP BY mcl_id),
rec AS (SELECT mcl_id, dataset_no, count(*) / max(e) AS r, count(*) AS hits, max(e) AS e FROM ce JOIN edge USING (g1, g2) JOIN ne USING (mcl_id) GROUP BY mcl_id, dataset_no)"""


def recurrences(spark: SparkSession, d: str) -> DataFrame:
    """mcl_id, dataset_no, r, hits, e: share of the cluster's edges that are significant in the dataset."""
    e = A.edges(spark, d)
    inside = graphs.cluster_edges(brand_clusters(spark, d), graphs.overlay(e).select("g1", "g2"))
    sizes = inside.groupBy("mcl_id").agg(F.count("*").alias("e"))
    return inside.join(e, ["g1", "g2"]).groupBy("mcl_id", "dataset_no").agg(F.count("*").alias("hits")).join(sizes, "mcl_id").withColumn("r", F.col("hits") / F.col("e"))


@query("a3_recurrence_array", f"WITH {RECURRENCE} SELECT mcl_id, dataset_no, round(r, 6) AS recurrence FROM rec")
def recurrence_array(spark: SparkSession, d: str) -> DataFrame:
    return recurrences(spark, d).select("mcl_id", "dataset_no", F.round("r", 6).alias("recurrence"))


@query("a4_connectivity_by_dataset", f"WITH {RECURRENCE}, v AS (SELECT mcl_id, count(*) AS v FROM cl GROUP BY mcl_id) SELECT mcl_id, round(sum(hits) / 28 * 2 / any_value(v * (v - 1)), 6) AS connectivity FROM rec JOIN v USING (mcl_id) WHERE v > 1 GROUP BY mcl_id")
def connectivity_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    v = brand_clusters(spark, d).groupBy("mcl_id").agg(F.count("*").alias("v")).where("v > 1")
    return recurrences(spark, d).groupBy("mcl_id").agg(F.sum("hits").alias("h")).join(v, "mcl_id").select("mcl_id", F.round(F.col("h") / DATASETS * 2 / (F.col("v") * (F.col("v") - 1)), 6).alias("connectivity"))


@query("f9_recurrence_functor", f"WITH {RECURRENCE} SELECT mcl_id, round(sum(r), 5) AS plain, CAST(sum(CASE WHEN r >= 0.1 THEN 1 ELSE 0 END) AS DOUBLE) AS counted, round(sum(power(r, 2)), 7) AS powered FROM rec GROUP BY mcl_id")
def recurrence_functor(spark: SparkSession, d: str) -> DataFrame:
    a = recurrences(spark, d).groupBy("mcl_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dataset_no", "r"))), lambda x: x["r"]).alias("r"))
    r = F.col("r")
    return a.select("mcl_id", F.round(arrays.recurrence(r), 5).alias("plain"), arrays.recurrence(r, 1, 0.1).alias("counted"), F.round(arrays.recurrence(r, 2, 2.0), 7).alias("powered"))


@query("f10_recurrence_binary", f"WITH {RECURRENCE} SELECT mcl_id, string_agg(CASE WHEN r >= 0.1 THEN '1' ELSE '0' END, '' ORDER BY dataset_no) AS bits FROM rec GROUP BY mcl_id")
def recurrence_binary(spark: SparkSession, d: str) -> DataFrame:
    a = recurrences(spark, d).groupBy("mcl_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dataset_no", "r"))), lambda x: x["r"]).alias("r"))
    return a.select("mcl_id", F.array_join(F.transform(arrays.binarise(F.col("r"), 0.1), lambda x: x.cast("string")), "").alias("bits"))


@query(
    "a9_effective_recurrence",
    f"""WITH {RECURRENCE}, pres AS (SELECT DISTINCT gene, dataset_no FROM lq), pos AS (SELECT ce.mcl_id, a.dataset_no, count(*) AS possible FROM ce JOIN pres a ON a.gene = g1 JOIN pres b ON b.gene = g2 AND a.dataset_no = b.dataset_no GROUP BY ALL)
SELECT mcl_id, dataset_no, round(coalesce(hits, 0) / possible, 6) AS effective FROM pos LEFT JOIN rec USING (mcl_id, dataset_no)""",
)
def effective_recurrence(spark: SparkSession, d: str) -> DataFrame:
    present = A.brand_datasets(spark, d).select("gene", "dataset_no").distinct()
    inside = graphs.cluster_edges(brand_clusters(spark, d), graphs.overlay(A.edges(spark, d)).select("g1", "g2"))
    possible = inside.join(present.withColumnRenamed("gene", "g1"), "g1").join(present.withColumnRenamed("gene", "g2"), ["g2", "dataset_no"]).groupBy("mcl_id", "dataset_no").agg(F.count("*").alias("possible"))
    return possible.join(recurrences(spark, d), ["mcl_id", "dataset_no"], "left").select("mcl_id", "dataset_no", F.round(F.coalesce(F.col("hits"), F.lit(0)) / F.col("possible"), 6).alias("effective"))


@query("a8_gene_incidence", f"WITH {A.BRANDS}, {CLUSTERS}, pres AS (SELECT DISTINCT gene, dataset_no FROM lq), v AS (SELECT mcl_id, count(*) AS v FROM cl GROUP BY mcl_id) SELECT mcl_id, dataset_no, round(count(*) / any_value(v), 6) AS present FROM cl JOIN pres ON gene = gene_no JOIN v USING (mcl_id) GROUP BY mcl_id, dataset_no")
def gene_incidence(spark: SparkSession, d: str) -> DataFrame:
    c = brand_clusters(spark, d)
    present = A.brand_datasets(spark, d).select(F.col("gene").alias("gene_no"), "dataset_no").distinct()
    v = c.groupBy("mcl_id").agg(F.count("*").alias("v"))
    return c.join(present, "gene_no").groupBy("mcl_id", "dataset_no").agg(F.count("*").alias("n")).join(v, "mcl_id").select("mcl_id", "dataset_no", F.round(F.col("n") / F.col("v"), 6).alias("present"))


@query("j15_second_order_pairs", f"WITH {A.EDGES}, {CLUSTERS}, o AS (SELECT g1, g2, list_sort(list(dataset_no)) AS s FROM edge GROUP BY g1, g2 HAVING count(*) >= 3), ce AS (SELECT a.mcl_id, g1, g2, s FROM o JOIN cl a ON a.gene_no = g1 JOIN cl b ON b.gene_no = g2 AND a.mcl_id = b.mcl_id) SELECT x.mcl_id, x.g1 AS a1, x.g2 AS a2, y.g1 AS b1, y.g2 AS b2, len(list_intersect(x.s, y.s)) AS shared FROM ce x JOIN ce y ON x.mcl_id = y.mcl_id AND (x.g1, x.g2) < (y.g1, y.g2)")
def second_order(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a cluster's edges, with the datasets in which both are significant."""
    o = graphs.edge_vectors(A.edges(spark, d), DATASETS).where("size(occ) >= 3").select("g1", "g2", "occ")
    inside = graphs.cluster_edges(brand_clusters(spark, d), o)
    x, y = (side.select("mcl_id", "__i", "__j", F.col("g1").alias(f"{k}1"), F.col("g2").alias(f"{k}2"), F.col("occ").alias(f"s{k}")) for k, side in zip("ab", graphs.in_blocks(inside, "mcl_id")))
    pairs = x.join(y, ["mcl_id", "__i", "__j"]).where("a1 < b1 OR (a1 = b1 AND a2 < b2)")
    return pairs.select("mcl_id", "a1", "a2", "b1", "b2", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"))


@query("f7_vertex_set", f"WITH {A.EDGES} SELECT dataset_no, string_agg(g::VARCHAR, ' ' ORDER BY g) AS vertices FROM (SELECT dataset_no, g1 AS g FROM edge UNION SELECT dataset_no, g2 FROM edge) GROUP BY dataset_no")
def vertex_set(spark: SparkSession, d: str) -> DataFrame:
    sets = A.edges(spark, d).groupBy("dataset_no").agg(F.collect_list(F.struct("g1", "g2")).alias("e"))
    return sets.select("dataset_no", F.array_join(F.transform(arrays.vertex_set(F.col("e")), lambda x: x.cast("string")), " ").alias("vertices"))


@query("w14_unique_patterns", f"WITH {A.EDGES} SELECT DISTINCT g1, g2 FROM edge")
def unique_patterns(spark: SparkSession, d: str) -> DataFrame:
    return A.edges(spark, d).select("g1", "g2").dropDuplicates()
