"""Queries on genes, functions, clusters and predictions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netweft.functions import arrays
from netweft.operators import annotation as N
from netweft.operators import ranking
from netweft.operators.graphs import shared_pairs
from netweft.operators.tables import dealt
from netweft.plans import adapters as A
from netweft.plans.registry import query


def text(column, between: str = " "):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), between)


@query("a10_function_genes", f"WITH {A.ASSOC} SELECT go_no, count(*) AS genes, string_agg(gene_no::VARCHAR, ' ' ORDER BY gene_no) AS gene_array FROM assoc GROUP BY go_no")
def function_genes(spark: SparkSession, d: str) -> DataFrame:
    g = A.associations(spark, d).groupBy("go_no").agg(F.array_sort(F.collect_set("gene_no")).alias("g"))
    return g.select("go_no", F.size("g").cast("long").alias("genes"), text("g").alias("gene_array"))


@query("a11_function_sizes", f"WITH {A.ASSOC} SELECT go_no, count(DISTINCT gene_no) AS size FROM assoc GROUP BY go_no")
def function_sizes(spark: SparkSession, d: str) -> DataFrame:
    return A.associations(spark, d).groupBy("go_no").agg(F.countDistinct("gene_no").alias("size"))


LINKS = "lk AS (SELECT DISTINCT a.l_partkey AS g1, b.l_partkey AS g2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"


def part_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """g1 < g2 for each order that has both parts, and how many there are at most."""
    x = A.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("g1")).where("l_orderkey IS NOT NULL")
    sizes = x.groupBy("l_orderkey").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2))
    lines, pairs = (int(n or 0) for n in sizes.first())
    x = dealt(x, "l_orderkey", rows=lines)
    return x.join(x.withColumnRenamed("g1", "g2"), "l_orderkey").where("g1 < g2").select("g1", "g2"), pairs


def part_links(spark: SparkSession, d: str) -> DataFrame:
    """Parts bought in one order."""
    pairs, most = part_pairs(spark, d)
    return dealt(pairs, "g1", "g2", rows=most).distinct()


@query(
    "a12_edge_classes",
    f"""WITH {A.ASSOC}, {A.GENES}, {LINKS}, e AS (SELECT g1, g2, x.known AS k1, y.known AS k2 FROM lk JOIN gene x ON x.gene_no = g1 JOIN gene y ON y.gene_no = g2),
f AS (SELECT DISTINCT go_no FROM assoc JOIN (SELECT g1 AS g FROM e UNION SELECT g2 FROM e) ON g = gene_no),
c AS (SELECT go_no, CASE WHEN a.gene_no IS NOT NULL THEN 0 WHEN k1 THEN 1 ELSE 2 END AS x, CASE WHEN b.gene_no IS NOT NULL THEN 0 WHEN k2 THEN 1 ELSE 2 END AS y
      FROM e CROSS JOIN f LEFT JOIN assoc a ON a.gene_no = g1 AND a.go_no = f.go_no LEFT JOIN assoc b ON b.gene_no = g2 AND b.go_no = f.go_no)
SELECT go_no, count(*) FILTER (x + y = 0) AS c00, count(*) FILTER (least(x, y) = 0 AND greatest(x, y) = 1) AS c01, count(*) FILTER (least(x, y) = 0 AND greatest(x, y) = 2) AS c02,
count(*) FILTER (x = 1 AND y = 1) AS c11, count(*) FILTER (least(x, y) = 1 AND greatest(x, y) = 2) AS c12, count(*) FILTER (x = 2 AND y = 2) AS c22 FROM (SELECT f.go_no, x, y FROM c f) GROUP BY go_no""".replace("SELECT go_no, CASE", "SELECT f.go_no, CASE"),
)
def edge_classes(spark: SparkSession, d: str) -> DataFrame:
    return N.edge_classes(part_links(spark, d), A.associations(spark, d), A.genes(spark, d))


@query("a13_cluster_accuracy", f"WITH {A.PREDICTIONS} SELECT mcl_id, round(coalesce(count(*) FILTER (is_correct = 1) / nullif(count(*) FILTER (is_correct >= 0), 0), 0), 6) AS accuracy FROM pred GROUP BY mcl_id")
def cluster_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return A.predictions(spark, d).groupBy("mcl_id").agg(F.round(N.accuracy(F.col("is_correct")), 6).alias("accuracy"))


@query("a14_function_accuracy", f"WITH {A.PREDICTIONS} SELECT go_no, count(*) AS predictions, count(DISTINCT gene_no) AS genes, round(coalesce(count(*) FILTER (is_correct = 1) / nullif(count(*) FILTER (is_correct >= 0), 0), -1), 6) AS accuracy FROM pred GROUP BY go_no")
def function_accuracy(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.coalesce(F.count_if(F.col("is_correct") == 1) / F.nullif(F.count_if(F.col("is_correct") >= 0), F.lit(0)), F.lit(-1.0))
    return A.predictions(spark, d).groupBy("go_no").agg(F.count("*").alias("predictions"), F.countDistinct("gene_no").alias("genes"), F.round(ratio, 6).alias("accuracy"))


CELLS = "cell AS (SELECT cluster_size AS x, CAST(floor(connectivity * 100 / 2) AS INT) AS y, count(*) FILTER (is_correct = 1) AS c, count(*) FILTER (is_correct >= 0) AS k, count(*) FILTER (is_correct = -1) AS u FROM pred GROUP BY ALL)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    p, c = A.predictions(spark, d), F.col("is_correct")
    return p.groupBy(F.col("cluster_size").alias("x"), F.floor(F.col("connectivity") * 100 / 2).cast("int").alias("y")).agg(F.count_if(c == 1).alias("c"), F.count_if(c >= 0).alias("k"), F.count_if(c == -1).alias("u"))


@query("a15_cells", f"WITH {A.PREDICTIONS}, {CELLS} SELECT x, y, c, k, u FROM cell")
def cell_counts(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d)


@query("a14_cumulative_cells", f"WITH {A.PREDICTIONS}, {CELLS} SELECT a.x, a.y, CAST(sum(b.c) AS BIGINT) AS c, CAST(sum(b.k) AS BIGINT) AS k, CAST(sum(b.u) AS BIGINT) AS u FROM cell a JOIN cell b ON b.x >= a.x AND b.y >= a.y GROUP BY a.x, a.y")
def cumulative_cells(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all cells at or above a cell in both axes: two running sums over the dense grid of cells."""
    c = cells(spark, d)
    grid = c.select("x").distinct().crossJoin(c.select("y").distinct()).join(c.withColumn("own", F.lit(1)), ["x", "y"], "left")
    down = Window.partitionBy("x").orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("y").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    for n in "cku":
        grid = grid.withColumn(n, F.sum(F.coalesce(F.col(n), F.lit(0))).over(down))
    for n in "cku":
        grid = grid.withColumn(n, F.sum(n).over(over))
    return grid.where("own = 1").select("x", "y", "c", "k", "u")


@query("a16_equal_groups", f"WITH {A.PREDICTIONS}, s AS (SELECT score, count(DISTINCT mcl_id) AS n FROM pred GROUP BY score), r AS (SELECT score, n, sum(n) OVER (ORDER BY score) AS cum FROM s) SELECT CAST((cum - 1) // 1000 AS BIGINT) AS bin, min(score) AS low, max(score) AS high, CAST(sum(n) AS BIGINT) AS clusters FROM r GROUP BY 1")
def equal_groups(spark: SparkSession, d: str) -> DataFrame:
    """Bins of scores in order, each about 1000 (score, cluster) pairs: running sums over the distinct scores."""
    s = A.predictions(spark, d).groupBy("score").agg(F.countDistinct("mcl_id").alias("n"))
    r = ranking.running_sums(s.withColumn("cum", F.col("n")), ["score"], ["cum"])
    return r.groupBy(F.floor((F.col("cum") - 1) / 1000).alias("bin")).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("n").alias("clusters"))


@query("a18_distinct_pairs", f"WITH {A.PREDICTIONS} SELECT DISTINCT gene_no, go_no FROM pred WHERE is_correct = 1")
def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    return A.predictions(spark, d).where("is_correct = 1").select("gene_no", "go_no").distinct()


@query("a19_composition", f"WITH {A.PREDICTIONS} SELECT cluster_size, count(*) AS n, count(DISTINCT gene_no) AS genes, round(avg(p_value), 5) AS p, round(avg(connectivity), 5) AS connectivity, round(count(*) FILTER (p_value <= 0.05) / count(*), 6) AS good FROM pred GROUP BY cluster_size")
def composition(spark: SparkSession, d: str) -> DataFrame:
    return A.predictions(spark, d).groupBy("cluster_size").agg(
        F.count("*").alias("n"), F.countDistinct("gene_no").alias("genes"), F.round(F.avg("p_value"), 5).alias("p"), F.round(F.avg("connectivity"), 5).alias("connectivity"), F.round(F.count_if(F.col("p_value") <= 0.05) / F.count("*"), 6).alias("good")
    )


@query("a20_dominant_function", f"WITH {A.PREDICTIONS}, v AS (SELECT gene_no, go_no, count(*) AS votes FROM pred GROUP BY ALL) SELECT gene_no, go_no, votes FROM (SELECT *, rank() OVER (PARTITION BY gene_no ORDER BY votes DESC) AS r FROM v) WHERE r = 1")
def dominant_function(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_ties(A.predictions(spark, d).groupBy("gene_no", "go_no").agg(F.count("*").alias("votes")), ["gene_no"], [F.desc("votes")])


@query("a22_homogeneity", f"WITH {A.ASSOC}, {A.MEMBERS}, s AS (SELECT mcl_id, count(*) AS v, count(a.gene_no) AS k FROM mem LEFT JOIN assoc a USING (gene_no) GROUP BY mcl_id), c AS (SELECT mcl_id, go_no, count(*) AS n FROM mem JOIN assoc USING (gene_no) GROUP BY ALL), b AS (SELECT mcl_id, go_no, n FROM (SELECT *, row_number() OVER (PARTITION BY mcl_id ORDER BY n DESC, go_no DESC) AS r FROM c) WHERE r = 1) SELECT mcl_id, go_no, round(n / v, 6) AS of_all, round(n / k, 6) AS of_known FROM b JOIN s USING (mcl_id)")
def homogeneity(spark: SparkSession, d: str) -> DataFrame:
    m, a = A.members(spark, d), A.associations(spark, d)
    s = m.join(a, "gene_no", "left").groupBy("mcl_id").agg(F.count("*").alias("v"), F.count("go_no").alias("k"))
    c = m.join(a, "gene_no").groupBy("mcl_id", "go_no").agg(F.count("*").alias("n")).groupBy("mcl_id").agg(F.max(F.struct("n", "go_no")).alias("b"))
    return c.join(s, "mcl_id").select("mcl_id", "b.go_no", F.round(F.col("b.n") / F.col("v"), 6).alias("of_all"), F.round(F.col("b.n") / F.col("k"), 6).alias("of_known"))


@query("a24_dataset_overlap", f"WITH {A.BRANDS}, r AS (SELECT DISTINCT gene FROM lq WHERE dataset_no = 5) SELECT dataset_no, count(*) FILTER (gene NOT IN (FROM r)) AS more, (SELECT count(*) FROM r) - count(*) FILTER (gene IN (FROM r)) AS less FROM (SELECT DISTINCT dataset_no, gene FROM lq) GROUP BY dataset_no")
def dataset_overlap(spark: SparkSession, d: str) -> DataFrame:
    g = A.brand_datasets(spark, d).select("dataset_no", "gene").distinct()
    r = g.where("dataset_no = 5").select("gene", F.lit(1).alias("in_r"))
    both = g.join(r, "gene", "left").groupBy("dataset_no").agg(F.count_if(F.col("in_r").isNull()).alias("more"), F.count("in_r").alias("shared"))
    return both.crossJoin(r.agg(F.count("*").alias("n"))).select("dataset_no", "more", (F.col("n") - F.col("shared")).alias("less"))


@query("a25_binding_sites_per_gene", "SELECT l_partkey AS gene_no, count(DISTINCT l_suppkey) AS factors, string_agg(DISTINCT l_suppkey::VARCHAR, ' ' ORDER BY l_suppkey::VARCHAR) AS names FROM lineitem GROUP BY l_partkey")
def binding_sites(spark: SparkSession, d: str) -> DataFrame:
    g = A.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene_no")).agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("s"))
    return g.select("gene_no", F.size("s").cast("long").alias("factors"), F.array_join("s", " ").alias("names"))


@query("a26_pleiotropy", f"WITH {A.PREDICTIONS} SELECT functions, count(*) AS genes FROM (SELECT gene_no, count(DISTINCT go_no) AS functions FROM pred WHERE is_correct = 1 GROUP BY gene_no) GROUP BY functions")
def pleiotropy(spark: SparkSession, d: str) -> DataFrame:
    return A.predictions(spark, d).where("is_correct = 1").groupBy("gene_no").agg(F.countDistinct("go_no").alias("functions")).groupBy("functions").agg(F.count("*").alias("genes"))


@query("a28_setting_agreement", f"WITH {A.PREDICTIONS} SELECT gene_no, go_no, count(DISTINCT cluster_size) AS support FROM pred WHERE is_correct = 1 GROUP BY gene_no, go_no HAVING count(DISTINCT cluster_size) >= 3")
def setting_agreement(spark: SparkSession, d: str) -> DataFrame:
    return A.predictions(spark, d).where("is_correct = 1").groupBy("gene_no", "go_no").agg(F.countDistinct("cluster_size").alias("support")).where("support >= 3")


@query("a29_function_sharing", f"WITH {A.PREDICTIONS}, g AS (SELECT DISTINCT gene_no, go_no FROM pred WHERE is_correct = 1) SELECT a.go_no AS f1, b.go_no AS f2, count(*) AS shared FROM g a JOIN g b ON a.gene_no = b.gene_no AND a.go_no < b.go_no GROUP BY ALL HAVING count(*) >= 30")
def function_sharing(spark: SparkSession, d: str) -> DataFrame:
    g = A.predictions(spark, d).where("is_correct = 1").select("gene_no", F.col("go_no").alias("f1")).distinct()
    return g.join(g.withColumnRenamed("f1", "f2"), "gene_no").where("f1 < f2").groupBy("f1", "f2").agg(F.count("*").alias("shared")).where("shared >= 30")


@query("a30_parameter_grid", f"WITH {A.PREDICTIONS} SELECT cluster_size, p_value, count(*) FILTER (is_correct = 1) AS tp, count(*) FILTER (is_correct = 0) AS fp, round(count(*) FILTER (is_correct = 1) / nullif(count(*) FILTER (is_correct >= 0), 0), 6) AS accuracy FROM pred GROUP BY ALL")
def parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("is_correct")
    return A.predictions(spark, d).groupBy("cluster_size", "p_value").agg(F.count_if(c == 1).alias("tp"), F.count_if(c == 0).alias("fp"), F.round(F.count_if(c == 1) / F.nullif(F.count_if(c >= 0), F.lit(0)), 6).alias("accuracy"))


@query("a31_concatenated_clusters", "SELECT n_regionkey AS cooc_id, count(*) AS n, string_agg(s_suppkey::VARCHAR, ' ' ORDER BY n_nationkey, s_suppkey) AS vertices FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey")
def concatenated(spark: SparkSession, d: str) -> DataFrame:
    s = A.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("v"))
    j = A.table(spark, d, "nation").join(s, "n_nationkey").groupBy(F.col("n_regionkey").alias("cooc_id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "v"))), lambda x: x["v"])).alias("v"))
    return j.select("cooc_id", F.size("v").cast("long").alias("n"), text("v").alias("vertices"))


@query("a34_context_genes", f"WITH {A.PREDICTIONS}, {A.MEMBERS} SELECT go_no, m.gene_no AS context, count(*) AS times FROM (SELECT DISTINCT mcl_id % 100 AS mcl_id, go_no FROM pred WHERE is_correct = 1) JOIN mem m USING (mcl_id) GROUP BY ALL HAVING count(*) >= 3")
def context_genes(spark: SparkSession, d: str) -> DataFrame:
    p = A.predictions(spark, d).where("is_correct = 1").select((F.col("mcl_id") % 100).alias("mcl_id"), "go_no").distinct()
    return p.join(A.members(spark, d), "mcl_id").groupBy("go_no", F.col("gene_no").alias("context")).agg(F.count("*").alias("times")).where("times >= 3")


@query("f22_unknown_ratio", f"WITH {A.GENES}, {A.MEMBERS} SELECT mcl_id, round(1 - avg(CASE WHEN known THEN 1 ELSE 0 END), 6) AS unknown FROM mem JOIN gene USING (gene_no) GROUP BY mcl_id")
def unknown_ratio(spark: SparkSession, d: str) -> DataFrame:
    return N.unknown_ratio(A.members(spark, d), A.genes(spark, d)).withColumn("unknown", F.round("unknown", 6))


@query("p9_good_predictions", f"WITH {A.PREDICTIONS}, acc AS (SELECT mcl_id, coalesce(count(*) FILTER (is_correct = 1) / nullif(count(*) FILTER (is_correct >= 0), 0), 0) AS a FROM pred GROUP BY mcl_id) SELECT p.mcl_id, count(*) AS good FROM pred p JOIN acc USING (mcl_id) WHERE a >= 0.5 AND p_value <= 0.05 AND cluster_size <= 5 GROUP BY p.mcl_id")
def good_predictions(spark: SparkSession, d: str) -> DataFrame:
    p = A.predictions(spark, d)
    ok = p.groupBy("mcl_id").agg(N.accuracy(F.col("is_correct")).alias("a")).where("a >= 0.5").select("mcl_id")
    return p.where("p_value <= 0.05 AND cluster_size <= 5").join(ok, "mcl_id", "left_semi").groupBy("mcl_id").agg(F.count("*").alias("good"))


@query("p10_candidate_functions", f"WITH {A.ASSOC}, l AS (SELECT DISTINCT l_suppkey AS center, l_partkey AS gene_no, CASE WHEN l_linenumber <= 2 THEN 1 ELSE 2 END AS layer FROM lineitem WHERE l_quantity >= 40), n AS (SELECT center, count(*) FILTER (layer = 1) AS n1, count(*) FILTER (layer = 2) AS n2 FROM l GROUP BY center), c AS (SELECT center, go_no, count(*) FILTER (layer = 1) AS c1, count(*) FILTER (layer = 2) AS c2 FROM l JOIN assoc USING (gene_no) GROUP BY ALL) SELECT center, go_no, c1, c2 FROM c JOIN n USING (center) WHERE c1 >= 2 AND c1 >= 0.05 * n1 AND c2 >= 2 AND c2 >= 0.04 * n2")
def candidate_functions(spark: SparkSession, d: str) -> DataFrame:
    l = A.table(spark, d, "lineitem").where("l_quantity >= 40").select(F.col("l_suppkey").alias("center"), F.col("l_partkey").alias("gene_no"), F.when(F.col("l_linenumber") <= 2, 1).otherwise(2).alias("layer")).distinct()
    by_layer = [F.count_if(F.col("layer") == i) for i in (1, 2)]
    n = l.groupBy("center").agg(by_layer[0].alias("n1"), by_layer[1].alias("n2"))
    c = l.join(A.associations(spark, d), "gene_no").groupBy("center", "go_no").agg(by_layer[0].alias("c1"), by_layer[1].alias("c2"))
    return c.join(n, "center").where("c1 >= 2 AND c1 >= 0.05 * n1 AND c2 >= 2 AND c2 >= 0.04 * n2").select("center", "go_no", "c1", "c2")


@query("p11_minimum_size", f"WITH {A.MEMBERS} SELECT mcl_id, count(*) AS size FROM mem GROUP BY mcl_id HAVING count(*) >= 30")
def minimum_size(spark: SparkSession, d: str) -> DataFrame:
    return A.members(spark, d).groupBy("mcl_id").agg(F.count("*").alias("size")).where("size >= 30")


@query("p8_smallest_target", "SELECT l_suppkey AS probe, min(l_partkey) AS gene FROM lineitem GROUP BY l_suppkey")
def smallest_target(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("probe")).agg(F.min("l_partkey").alias("gene"))


@query("p17_systematic_sample", f"WITH {A.PREDICTIONS}, p AS (SELECT mcl_id, go_no, count(*) AS n FROM pred GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY mcl_id, go_no) AS r, count(*) OVER () AS c FROM p) SELECT mcl_id, go_no, n FROM r WHERE (r - 1) % (c // 2000 + 1) = 0")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return N.systematic(A.predictions(spark, d).groupBy("mcl_id", "go_no").agg(F.count("*").alias("n")), ["mcl_id", "go_no"], 2000)


@query("j8_three_levels", "SELECT r_name, n_name, count(*) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name, n_name")
def three_levels(spark: SparkSession, d: str) -> DataFrame:
    r, n, s = (A.table(spark, d, t) for t in ("region", "nation", "supplier"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"))


@query("j10_semi_join", f"WITH {A.PREDICTIONS} SELECT go_no, count(*) AS n FROM pred WHERE gene_no IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY go_no")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    rich = A.table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("gene_no"))
    return A.predictions(spark, d).join(rich, "gene_no", "left_semi").groupBy("go_no").agg(F.count("*").alias("n"))


@query("j11_unlisted_genes", "SELECT p_partkey AS gene_no FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def unlisted(spark: SparkSession, d: str) -> DataFrame:
    listed = A.table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("gene_no"))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("gene_no")).join(listed, "gene_no", "left_anti")


@query("j12_setting_categories", f"WITH {A.PREDICTIONS}, x AS (SELECT gene_no, go_no, bool_or(is_correct = 1) AS ok FROM pred WHERE cluster_size <= 3 GROUP BY ALL), y AS (SELECT gene_no, go_no, bool_or(is_correct = 1) AS ok FROM pred WHERE cluster_size > 3 GROUP BY ALL), c AS (SELECT CASE WHEN coalesce(x.ok, false) AND coalesce(y.ok, false) THEN 'both' WHEN coalesce(x.ok, false) THEN 'first' WHEN coalesce(y.ok, false) THEN 'second' ELSE 'neither' END AS category FROM x FULL JOIN y USING (gene_no, go_no)) SELECT category, count(*) AS n FROM c GROUP BY category")
def setting_categories(spark: SparkSession, d: str) -> DataFrame:
    p = A.predictions(spark, d)
    ok = lambda where: p.where(where).groupBy("gene_no", "go_no").agg(F.bool_or(F.col("is_correct") == 1).alias("ok"))
    return N.category_split(ok("cluster_size <= 3"), ok("cluster_size > 3"), ["gene_no", "go_no"], "ok", "ok").groupBy("category").agg(F.count("*").alias("n"))


def linked_pairs(spark: SparkSession, d: str, classes: DataFrame, label: str, each: float = 1.0) -> DataFrame:
    """Links of parts (bought in one order) that are of one class (gene_no, ``label``); a part has some ``each`` classes."""
    lines = A.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("gene_no"))
    return shared_pairs(lines, classes, "l_orderkey", label, math.ceil(lines.count() * max(each, 1.0)))


@query("j16_pairs_inside_cluster", f"WITH {A.MEMBERS}, {LINKS} SELECT a.mcl_id, count(*) AS edges FROM lk JOIN mem a ON a.gene_no = g1 JOIN mem b ON b.gene_no = g2 AND a.mcl_id = b.mcl_id GROUP BY a.mcl_id")
def pairs_inside(spark: SparkSession, d: str) -> DataFrame:
    """Links of parts are the pairs of an order; of these only those inside a cluster are formed."""
    m = A.members(spark, d)
    each = m.count() / max(A.table(spark, d, "part").count(), 1)  # clusters of a part
    return linked_pairs(spark, d, m, "mcl_id", each).groupBy("mcl_id").agg(F.sum("n").alias("edges"))


@query("j18_common_functions", f"WITH {A.ASSOC}, {LINKS} SELECT a.go_no, count(*) AS edges FROM lk JOIN assoc a ON a.gene_no = g1 JOIN assoc b ON b.gene_no = g2 AND a.go_no = b.go_no GROUP BY a.go_no")
def common_functions(spark: SparkSession, d: str) -> DataFrame:
    return linked_pairs(spark, d, A.associations(spark, d), "go_no").groupBy("go_no").agg(F.sum("n").alias("edges"))


@query("j19_probe_lists", "SELECT l_suppkey AS probe, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_partkey) AS genes FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity = 1) GROUP BY l_suppkey")
def probe_lists(spark: SparkSession, d: str) -> DataFrame:
    g = A.table(spark, d, "lineitem").where("l_quantity = 1").groupBy(F.col("l_suppkey").alias("probe")).agg(F.array_sort(F.collect_set("l_partkey")).alias("g"))
    return g.select("probe", text("g").alias("genes"))


@query("j20_ortholog_pairs", "SELECT n_nationkey AS hid, min(c_custkey) AS first, min(s_suppkey) AS second, count(DISTINCT c_custkey) = 1 AND count(DISTINCT s_suppkey) = 1 AS one_to_one FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def ortholog_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("hid")).agg(F.min("c_custkey").alias("first"), F.countDistinct("c_custkey").alias("nc"))
    s = A.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("hid")).agg(F.min("s_suppkey").alias("second"), F.countDistinct("s_suppkey").alias("ns"))
    return c.join(s, "hid").select(F.col("hid"), "first", "second", ((F.col("nc") == 1) & (F.col("ns") == 1)).alias("one_to_one"))


@query("s25_gene_numbers", "WITH e AS (SELECT s_name AS gene_id, s_suppkey AS gene_no FROM supplier), n AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) + (SELECT max(gene_no) FROM e) AS gene_no FROM (SELECT DISTINCT c_name AS gene_id FROM customer) WHERE gene_id NOT IN (SELECT gene_id FROM e)) FROM e UNION ALL FROM n")
def gene_numbers(spark: SparkSession, d: str) -> DataFrame:
    return N.number_genes(A.table(spark, d, "customer").select(F.col("c_name").alias("gene_id")), A.table(spark, d, "supplier").select(F.col("s_name").alias("gene_id"), F.col("s_suppkey").alias("gene_no")))


@query("w4_best_prediction", f"WITH {A.PREDICTIONS} SELECT gene_no, go_no, max(score) AS score FROM pred GROUP BY gene_no, go_no")
def best_prediction(spark: SparkSession, d: str) -> DataFrame:
    best = ranking.best_per_key(A.predictions(spark, d), ["gene_no", "go_no"], [F.desc("score"), "p_gene_id"])
    return best.select("gene_no", "go_no", "score")


@query("w5_least_p_functions", f"WITH {A.PREDICTIONS} SELECT mcl_id, gene_no, count(DISTINCT go_no) AS functions, min(p_value) AS p FROM (SELECT *, rank() OVER (PARTITION BY mcl_id, gene_no ORDER BY p_value) AS r FROM pred) WHERE r = 1 GROUP BY ALL")
def least_p(spark: SparkSession, d: str) -> DataFrame:
    """The least p of each function of a gene, then the functions that have the least of all: one shuffle, and no window."""
    p = A.predictions(spark, d)
    one = dealt(p.select("mcl_id", "gene_no", "go_no", "p_value"), "mcl_id", "gene_no", rows=p.count())
    best = one.groupBy("mcl_id", "gene_no", "p_value").agg(F.collect_set("go_no").alias("f"))
    return best.groupBy("mcl_id", "gene_no").agg(F.min_by(F.size("f").cast("long"), F.struct(F.col("p_value").isNull(), "p_value")).alias("functions"), F.min("p_value").alias("p"))


@query("w6_highest_score_functions", f"WITH {A.PREDICTIONS} SELECT mcl_id, gene_no, go_no, score FROM (SELECT *, rank() OVER (PARTITION BY mcl_id, gene_no ORDER BY score DESC) AS r FROM pred) WHERE r = 1")
def highest_score(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_ties(A.predictions(spark, d), ["mcl_id", "gene_no"], [F.desc("score")]).select("mcl_id", "gene_no", "go_no", "score")


@query("w7_top_hits", "SELECT l_suppkey AS mt_id, l_partkey AS gene_no, l_extendedprice AS score FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) WHERE r <= 20")
def top_hits(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_ranked(A.table(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice")], 20).select(F.col("l_suppkey").alias("mt_id"), F.col("l_partkey").alias("gene_no"), F.col("l_extendedprice").alias("score"))


@query("p15_imperfect_matrices", "SELECT mt_id FROM (SELECT l_suppkey AS mt_id, l_extendedprice AS s FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) WHERE r <= 20) GROUP BY mt_id HAVING min(s) < 101500")
def imperfect(spark: SparkSession, d: str) -> DataFrame:
    return top_hits(spark, d).groupBy("mt_id").agg(F.min("score").alias("m")).where("m < 101500").select("mt_id")


CURVE = "b AS (SELECT gene_no, go_no, max(score) AS v FROM pred GROUP BY ALL), q AS (SELECT b.gene_no, b.go_no, v, max(is_correct) AS c FROM pred p JOIN b ON p.gene_no = b.gene_no AND p.go_no = b.go_no AND score = v WHERE is_correct >= 0 GROUP BY ALL), cv AS (SELECT v, sum(sum(c)) OVER (ORDER BY v DESC) AS correct, sum(count(*)) OVER (ORDER BY v DESC) AS known FROM q GROUP BY v)"


@query("w9_accuracy_curve", f"WITH {A.PREDICTIONS}, {CURVE} SELECT v, CAST(correct AS BIGINT) AS correct, CAST(known AS BIGINT) AS known, round(correct / known, 6) AS accuracy FROM cv")
def accuracy_curve(spark: SparkSession, d: str) -> DataFrame:
    return ranking.accuracy_curve(A.predictions(spark, d), "score").withColumn("accuracy", F.round("accuracy", 6))


@query("w9_cut_off", f"WITH {A.PREDICTIONS}, {CURVE} SELECT min(v) AS cut_off FROM cv WHERE correct / known >= 0.45")
def cut_off(spark: SparkSession, d: str) -> DataFrame:
    return ranking.cut_off(ranking.accuracy_curve(A.predictions(spark, d), "score"), 0.45)


@query("w12_p_value_cut_off", f"WITH {A.PREDICTIONS}, {CURVE.replace('max(score) AS v', 'min(p_value) AS v').replace('score = v', 'p_value = v').replace('v DESC', 'v')} SELECT max(v) AS cut_off FROM cv WHERE correct / known >= 0.4")
def p_cut_off(spark: SparkSession, d: str) -> DataFrame:
    return ranking.cut_off(ranking.accuracy_curve(A.predictions(spark, d), "p_value", descending=False), 0.4, descending=False)


@query("w11_score_cut_by_share", f"WITH {A.PREDICTIONS}, r AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM pred) SELECT score AS cut_off FROM r WHERE r = CAST(floor(n * 0.1) AS INT)")
def cut_by_share(spark: SparkSession, d: str) -> DataFrame:
    """Score at place floor(0.1 n) from above: counts of the distinct scores are summed, not the rows ranked."""
    s = A.predictions(spark, d).groupBy("score").agg(F.count("*").alias("n"))
    run = ranking.running_sums(s.withColumn("cum", F.col("n")), [F.desc("score")], ["cum"]).crossJoin(s.agg(F.floor(F.sum("n") * 0.1).alias("place")))
    return run.where("cum >= place").agg(F.max("score").alias("cut_off"))


@query("w13_offset_limit", f"WITH {A.MEMBERS} SELECT mcl_id, gene_no FROM mem ORDER BY mcl_id, gene_no LIMIT 50 OFFSET 100")
def offset_limit(spark: SparkSession, d: str) -> DataFrame:
    return A.members(spark, d).orderBy("mcl_id", "gene_no").offset(100).limit(50)


@query("w15_running_minimum", "SELECT c_custkey, min(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS least FROM customer")
def running_minimum(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "customer").select("c_custkey", F.min("c_acctbal").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("least"))


@query("w16_every_kth", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE r % 7 = 0")
def every_kth(spark: SparkSession, d: str) -> DataFrame:
    return ranking.every_kth(A.table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 7)


@query("w17_permuted_clusters")
def permuted(spark: SparkSession, d: str) -> DataFrame:
    return N.permuted_genes(A.members(spark, d), 17)


@query("u1_set_operations", f"WITH {A.MEMBERS}, {A.ASSOC}, a AS (SELECT gene_no FROM mem), b AS (SELECT gene_no FROM assoc) SELECT 'union' AS op, count(*) AS n FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersect', count(*) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'except', count(*) FROM (FROM a EXCEPT FROM b)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Genes in clusters and genes of known function."""
    a, b = A.members(spark, d).select("gene_no"), A.associations(spark, d).select("gene_no")
    count = lambda name, x: x.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return count("union", a.union(b).distinct()).unionByName(count("intersect", a.intersect(b))).unionByName(count("except", a.subtract(b)))


PRUNE = "pc AS (SELECT l_orderkey AS mcl_id, list_sort(list(DISTINCT p_type)) AS vertex_set, list_sort(list(DISTINCT quarter(l_shipdate)::INT)) AS recurrence, max(l_discount) AS connectivity FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)"


def typed_orders(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return A.table(spark, d, "lineitem").join(p, "l_partkey").groupBy(F.col("l_orderkey").alias("mcl_id")).agg(
        F.array_sort(F.collect_set("p_type")).alias("vertex_set"), F.array_sort(F.collect_set(F.quarter("l_shipdate").cast("int"))).alias("recurrence"), F.max("l_discount").alias("connectivity")
    )


@query("u2_prune_united", f"WITH {PRUNE}, x AS (SELECT vertex_set, mcl_id, connectivity, row_number() OVER (PARTITION BY vertex_set ORDER BY connectivity DESC, mcl_id) AS r FROM pc), u AS (SELECT vertex_set, string_agg(DISTINCT q::VARCHAR, ' ' ORDER BY q::VARCHAR) AS recurrence FROM (SELECT vertex_set, unnest(recurrence) AS q FROM pc) GROUP BY vertex_set) SELECT mcl_id, array_to_string(vertex_set, ' ') AS vertices, recurrence, connectivity FROM x JOIN u USING (vertex_set) WHERE r = 1")
def prune_united(spark: SparkSession, d: str) -> DataFrame:
    return N.prune_clusters(typed_orders(spark, d), 2).select("mcl_id", F.array_join("vertex_set", " ").alias("vertices"), text("recurrence").alias("recurrence"), "connectivity")


@query("u2_prune_same_recurrence", f"WITH {PRUNE} SELECT mcl_id, array_to_string(vertex_set, ' ') AS vertices, array_to_string(recurrence, ' ') AS recurrence, connectivity FROM (SELECT *, row_number() OVER (PARTITION BY vertex_set, recurrence ORDER BY connectivity DESC, mcl_id) AS r FROM pc) WHERE r = 1")
def prune_same(spark: SparkSession, d: str) -> DataFrame:
    return N.prune_clusters(typed_orders(spark, d), 1).select("mcl_id", F.array_join("vertex_set", " ").alias("vertices"), text("recurrence").alias("recurrence"), "connectivity")


@query("f19_jaccard", f"WITH {A.MEMBERS}, n AS (SELECT mcl_id, count(*) AS n FROM mem GROUP BY mcl_id), i AS (SELECT x.mcl_id AS a, y.mcl_id AS b, count(*) AS i FROM mem x JOIN mem y ON x.gene_no = y.gene_no AND x.mcl_id < y.mcl_id GROUP BY ALL) SELECT a, b, round(i / (na.n + nb.n - i), 6) AS similarity FROM i JOIN n na ON na.mcl_id = a JOIN n nb ON nb.mcl_id = b")
def jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the cluster pairs that share a gene (all others have 0), counted by a join on the gene."""
    m = A.members(spark, d)
    n = m.groupBy("mcl_id").agg(F.count("*").alias("n"))
    i = m.select("gene_no", F.col("mcl_id").alias("a")).join(m.select("gene_no", F.col("mcl_id").alias("b")), "gene_no").where("a < b").groupBy("a", "b").agg(F.count("*").alias("i"))
    sized = i.join(n.select(F.col("mcl_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("mcl_id").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", F.round(F.col("i") / (F.col("na") + F.col("nb") - F.col("i")), 6).alias("similarity"))


@query("f3_ratio_of_maps", f"WITH {A.PREDICTIONS}, num AS (SELECT go_no, count(*) AS n FROM pred WHERE is_correct = 1 AND cluster_size = 1 GROUP BY go_no), den AS (SELECT go_no, count(*) AS n FROM pred GROUP BY go_no) SELECT den.go_no, round(coalesce(num.n / den.n, 0), 6) AS ratio FROM den LEFT JOIN num USING (go_no)")
def ratio_of_maps(spark: SparkSession, d: str) -> DataFrame:
    p = A.predictions(spark, d)
    num = p.where("is_correct = 1 AND cluster_size = 1").groupBy("go_no").agg(F.count("*").alias("a"))
    return p.groupBy("go_no").agg(F.count("*").alias("b")).join(num, "go_no", "left").select("go_no", F.round(F.coalesce(F.col("a") / F.col("b"), F.lit(0.0)), 6).alias("ratio"))


@query("t13_linear_score", f"WITH {A.PREDICTIONS} SELECT go_no, count(*) FILTER (0.5 - ln(greatest(p_value, 0.00000001)) * 0.2 + connectivity * 3 + cluster_size * 0.1 >= 1.5) AS accepted FROM pred GROUP BY go_no")
def linear_score(spark: SparkSession, d: str) -> DataFrame:
    s = 0.5 - F.log(F.greatest(F.col("p_value"), F.lit(1e-8))) * 0.2 + F.col("connectivity") * 3 + F.col("cluster_size") * 0.1
    return A.predictions(spark, d).groupBy("go_no").agg(F.count_if(s >= 1.5).alias("accepted"))


@query("a17_family_size", "WITH f AS (SELECT p_brand AS fam, count(*) AS n FROM part GROUP BY p_brand), g AS (SELECT DISTINCT l_suppkey AS gene_no, p_brand AS fam FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity = 50) SELECT gene_no, max(n) AS family_size FROM g JOIN f USING (fam) GROUP BY gene_no")
def family_size(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("fam"))
    f = p.groupBy("fam").agg(F.count("*").alias("n"))
    g = A.table(spark, d, "lineitem").where("l_quantity = 50").join(p, "l_partkey").select(F.col("l_suppkey").alias("gene_no"), "fam").distinct()
    return g.join(f, "fam").groupBy("gene_no").agg(F.max("n").alias("family_size"))


@query("j5_average_events", "SELECT event_type, user_id % 10 AS family, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY ALL")
def average_events(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("family")).agg(F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))
