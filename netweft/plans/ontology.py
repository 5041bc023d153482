"""Queries on the term DAG, enrichment and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.operators import ontology as O
from netweft.operators import statistics as T
from netweft.operators.tables import dealt
from netweft.plans import adapters as A
from netweft.plans.annotation import text
from netweft.plans.registry import query

PATHS = f"{A.TERMS}, pth AS (SELECT 1 AS term, [1] AS path UNION ALL SELECT child, list_append(path, child) FROM pth JOIN t2t ON term = parent)"
CLOSED = "clo AS (SELECT DISTINCT unnest(path) AS ancestor, term FROM pth), dep AS (SELECT term, CAST(min(len(path)) AS INT) AS depth FROM pth GROUP BY term)"
SIZES = f"{A.ASSOC}, cg AS (SELECT DISTINCT ancestor AS go_no, gene_no FROM clo JOIN assoc ON term = go_no), sz AS (SELECT go_no, count(*) AS size FROM cg GROUP BY go_no)"
HEAD = f"WITH RECURSIVE {PATHS}, {CLOSED}"


def paths(spark: SparkSession, d: str) -> DataFrame:
    return O.all_paths(A.term_edges(spark, d), 1)


@query("o1_all_paths", f"{HEAD} SELECT term, array_to_string(path, ' ') AS path FROM pth")
def all_paths(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).select("term", text("path").alias("path"))


@query("o2_depth", f"{HEAD} SELECT term, depth FROM dep")
def depth(spark: SparkSession, d: str) -> DataFrame:
    return O.depths(paths(spark, d))


DISTANCES = """pp AS (SELECT a.term AS t1, b.term AS t2, a.path AS p1, b.path AS p2, CASE WHEN len(a.path) <= len(b.path) THEN list_filter(a.path, lambda x: list_contains(b.path, x))[-1] ELSE list_filter(b.path, lambda x: list_contains(a.path, x))[-1] END AS lca FROM pth a JOIN pth b ON a.term < b.term),
ds AS (SELECT t1, t2, CAST(min(len(p1) - list_position(p1, lca) + len(p2) - list_position(p2, lca)) AS BIGINT) AS steps, CAST(min(15 - least(list_position(p1, lca), list_position(p2, lca))) AS BIGINT) AS depth_gap,
CAST(min(least(len(p1) - list_position(p1, lca), len(p2) - list_position(p2, lca))) AS BIGINT) AS shorter_leg, list_sort(list(DISTINCT lca)) AS ancestors FROM pp GROUP BY t1, t2)"""


@query("o3_pair_distances", f"{HEAD}, {DISTANCES} SELECT t1, t2, steps, depth_gap, shorter_leg, array_to_string(ancestors, ' ') AS ancestors FROM ds")
def pair_distances(spark: SparkSession, d: str) -> DataFrame:
    return O.pair_distances(paths(spark, d)).select("t1", "t2", *[F.col(c).cast("long").alias(c) for c in ("steps", "depth_gap", "shorter_leg")], text("ancestors").alias("ancestors"))


@query("o5_closed_genes", f"{HEAD}, {SIZES} SELECT go_no, size FROM sz")
def closed_genes(spark: SparkSession, d: str) -> DataFrame:
    return term_sizes(spark, d)


def term_sizes(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    closed = O.closure(p if p is not None else paths(spark, d))
    return O.closed_genes(closed, A.associations(spark, d)).groupBy("go_no").agg(F.count("*").alias("size"))


@query("o6_informative_nodes", f"{HEAD}, {SIZES} SELECT go_no FROM sz WHERE size >= 100 AND NOT EXISTS (SELECT 1 FROM t2t JOIN sz c ON c.go_no = child WHERE parent = sz.go_no AND c.size >= 100)")
def informative(spark: SparkSession, d: str) -> DataFrame:
    return O.informative(A.term_edges(spark, d), term_sizes(spark, d), 100)


@query("o6_fixed_level", f"{HEAD} SELECT term AS go_no FROM dep WHERE depth = 3")
def fixed_level(spark: SparkSession, d: str) -> DataFrame:
    return O.depths(paths(spark, d)).where("depth = 3").select(F.col("term").alias("go_no"))


@query("o6_size_window", f"{HEAD}, {SIZES}, h AS (SELECT go_no FROM sz WHERE size BETWEEN 60 AND 400) SELECT go_no FROM h WHERE NOT EXISTS (SELECT 1 FROM clo JOIN h x ON x.go_no = ancestor WHERE term = h.go_no AND ancestor <> term)")
def size_window(spark: SparkSession, d: str) -> DataFrame:
    p = paths(spark, d)
    return O.size_window(A.term_edges(spark, d), term_sizes(spark, d, p), 60, 400, O.closure(p))


@query("o8_sources_only", f"{HEAD}, c AS (SELECT p_size AS go_no FROM part GROUP BY p_size HAVING 50 * count(*) >= (SELECT count(*) FROM part)) SELECT go_no FROM c WHERE NOT EXISTS (SELECT 1 FROM clo JOIN c x ON x.go_no = ancestor WHERE term = c.go_no AND ancestor <> term)")
def sources_only(spark: SparkSession, d: str) -> DataFrame:
    """Of the terms with at least a fiftieth of the genes, those that lie below no other."""
    part = A.table(spark, d, "part")
    c = part.groupBy(F.col("p_size").alias("go_no")).agg(F.count("*").alias("n")).where(F.col("n") * 50 >= part.count()).select("go_no")
    return O.sources_only(c, O.closure(paths(spark, d)))


OWN_TERMS = "an AS (SELECT DISTINCT l_orderkey AS probe, p_size AS go_no FROM lineitem JOIN part ON p_partkey = l_partkey)"


def annotations(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("go_no"))
    li = A.table(spark, d, "lineitem")
    return dealt(li.join(p, "l_partkey").select(F.col("l_orderkey").alias("probe"), "go_no"), "probe", rows=li.count()).distinct()


def predicted_functions(spark: SparkSession, d: str) -> DataFrame:
    """gene_no, go_no, once each: dealt by gene like the annotations, so that they meet without another shuffle."""
    li = A.table(spark, d, "lineitem")
    return dealt(li.select(F.col("l_orderkey").alias("gene_no"), F.col("l_quantity").cast("int").alias("go_no")), "gene_no", rows=li.count()).distinct()


@query("p14_without_parents", f"WITH {A.TERMS}, {OWN_TERMS} SELECT probe, go_no FROM an WHERE NOT EXISTS (SELECT 1 FROM t2t JOIN an x ON x.go_no = child WHERE parent = an.go_no AND x.probe = an.probe)")
def without_parents(spark: SparkSession, d: str) -> DataFrame:
    return O.without_parents(annotations(spark, d), A.term_edges(spark, d), "probe")


JUDGE = f"""{OWN_TERMS}, kn AS (SELECT probe AS gene_no, go_no AS own FROM an WHERE probe % 4 <> 0), pd AS (SELECT DISTINCT l_orderkey AS gene_no, CAST(l_quantity AS INT) AS go_no FROM lineitem),
j AS (SELECT p.gene_no, p.go_no, own, shorter_leg, depth, CASE WHEN p.go_no = own THEN [own] ELSE ancestors END AS anc FROM pd p LEFT JOIN kn USING (gene_no) LEFT JOIN ds ON t1 = least(p.go_no, own) AND t2 = greatest(p.go_no, own) LEFT JOIN dep ON term = p.go_no),
ja AS (SELECT gene_no, go_no, depth AS d FROM (SELECT gene_no, go_no, unnest(anc) AS a FROM j) JOIN dep ON term = a), jd AS (SELECT gene_no, go_no, max(d) AS deepest FROM ja GROUP BY ALL)
SELECT gene_no, go_no, CASE WHEN count(own) = 0 THEN -1 ELSE CAST(coalesce(bool_or(go_no = own AND depth >= 3), false) AS INT) END AS is_correct,
CASE WHEN count(own) = 0 THEN -1 ELSE CAST(coalesce(bool_or(go_no = own OR shorter_leg = 1), false) AS INT) END AS is_correct_l1,
CASE WHEN count(own) = 0 THEN -1 ELSE CAST(coalesce(max(deepest) >= 3, false) AS INT) END AS is_correct_lca FROM j LEFT JOIN jd USING (gene_no, go_no) GROUP BY gene_no, go_no"""


@query("o12_judge", f"{HEAD}, {DISTANCES}, {JUDGE}")
def judge(spark: SparkSession, d: str) -> DataFrame:
    p = paths(spark, d)
    known = annotations(spark, d).where("probe % 4 <> 0").withColumnRenamed("probe", "gene_no")
    return O.judge(predicted_functions(spark, d), known, p, 3).drop("lca")


@query("o19_common_ancestors", f"{HEAD} SELECT ancestor AS go_no, count(*) AS terms FROM clo WHERE term IN (12, 18, 30, 50) GROUP BY ancestor")
def common_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return O.closure(paths(spark, d)).where("term in (12, 18, 30, 50)").groupBy(F.col("ancestor").alias("go_no")).agg(F.count("*").alias("terms"))


@query("o20_subgraph", f"{HEAD} SELECT parent, child FROM t2t WHERE parent IN (SELECT term FROM clo WHERE ancestor = 2)")
def subgraph(spark: SparkSession, d: str) -> DataFrame:
    below = O.closure(paths(spark, d)).where("ancestor = 2").select(F.col("term").alias("parent"))
    return A.term_edges(spark, d).join(below, "parent", "left_semi").select("parent", "child")


@query("o21_common_prefix", f"{HEAD} SELECT a.term AS t1, b.term AS t2, max(CAST(coalesce(list_position(list_transform(list_zip(a.path, b.path), lambda p: coalesce(p[1] = p[2], false)), false) - 1, len(a.path)) AS BIGINT)) AS shared FROM pth a JOIN pth b ON a.term < b.term GROUP BY ALL")
def common_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The longest beginning that any paths of two terms share: each beginning of a path is met by those of other paths that
    are equal to it, so that deep pairs come from small groups; the root, which all share, is left to the last line."""
    p = paths(spark, d)
    heads = p.select("term", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size("path"), F.lit(2))), lambda n: F.slice("path", 1, n))).alias("head")).where("size(head) >= 2").distinct()
    met = heads.withColumnRenamed("term", "t1").join(heads.withColumnRenamed("term", "t2"), "head").where("t1 < t2").groupBy("t1", "t2").agg(F.max(F.size("head")).cast("long").alias("shared"))
    return O.with_root(met, p)


GENES = "(SELECT count(*) FROM part)"
TAIL = "least(1.0, CASE WHEN x <= 0 THEN 1.0 WHEN x > least(k, m) THEN 0.0 ELSE list_sum(list_transform(range(x, least(k, m) + 1), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(n - m + 1) - lgamma(k - i + 1) - lgamma(n - m - k + i + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)))) END)"
ENRICH = f"WITH {A.ASSOC}, {A.MEMBERS}, s AS (SELECT go_no, count(DISTINCT gene_no) AS m FROM assoc GROUP BY go_no HAVING count(DISTINCT gene_no) > 1), k AS (SELECT mcl_id, count(*) AS k FROM mem GROUP BY mcl_id), l AS (SELECT mcl_id, go_no, count(*) AS x FROM mem JOIN assoc USING (gene_no) GROUP BY ALL), c AS (SELECT mcl_id, go_no, x, m, k, {GENES} AS n FROM l JOIN s USING (go_no) JOIN k USING (mcl_id))"


@query("t3_cluster_enrichment", f"{ENRICH} SELECT mcl_id, go_no, x, m, k, round({TAIL}, 6) AS p FROM c")
def cluster_enrichment(spark: SparkSession, d: str) -> DataFrame:
    e = T.enrichment(A.members(spark, d), A.associations(spark, d), A.table(spark, d, "part").count(), leave_one_out=False)
    return e.select("mcl_id", "go_no", "x", "m", "k", F.round("p", 6).alias("p"))


@query("t1_leave_one_out_enrichment", f"{ENRICH}, e AS (SELECT c.mcl_id, c.go_no, gene_no, x - (a.gene_no IS NOT NULL)::INT AS x, m - (a.gene_no IS NOT NULL)::INT AS m, k, n FROM c JOIN mem USING (mcl_id) LEFT JOIN assoc a USING (gene_no, go_no)) SELECT mcl_id, go_no, gene_no, round({TAIL}, 6) AS p FROM e")
def loo_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return T.enrichment(A.members(spark, d), A.associations(spark, d), A.table(spark, d, "part").count()).select("mcl_id", "go_no", "gene_no", F.round("p", 6).alias("p"))


@query("t4_interaction_enrichment", f"{ENRICH.replace('count(*) AS x FROM', 'count(*) + 1 AS x FROM')} SELECT mcl_id, go_no, round(CASE WHEN {TAIL} < 1e-9 THEN -99 ELSE ln({TAIL}) END, 5) AS log_p FROM c")
def interaction_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Tail above x: the same sum from x + 1 on, as a logarithm (-99 where it is below 1e-9)."""
    n = A.table(spark, d, "part").count()
    e = T.enrichment(A.members(spark, d), A.associations(spark, d), n, leave_one_out=False).drop("p").withColumn("x", F.col("x") + 1)
    return T.with_tail(e, n).select("mcl_id", "go_no", F.round(F.when(F.col("p") < 1e-9, -99.0).otherwise(F.log("p")), 5).alias("log_p"))


@query("t7_binomial_tail", f"WITH {A.PREDICTIONS}, c AS (SELECT go_no, count(*) FILTER (is_correct = 1) AS x, count(*) AS n FROM pred GROUP BY go_no) SELECT go_no, x, n, round(ln(least(1.0, CASE WHEN x = 0 THEN 1.0 ELSE list_sum(list_transform(range(x, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.3) + (n - i) * ln(0.7)))) END)), 5) AS log_p FROM c")
def binomial_tail(spark: SparkSession, d: str) -> DataFrame:
    c = A.predictions(spark, d).groupBy("go_no").agg(F.count_if(F.col("is_correct") == 1).alias("x"), F.count("*").alias("n"))
    return c.select("go_no", "x", "n", F.round(T.binomial_log_tail(F.col("x"), F.col("n"), F.lit(0.3)), 5).alias("log_p"))


@query("t6_binomial_ratio", f"WITH {A.PREDICTIONS}, c AS (SELECT go_no, count(*) FILTER (is_correct = 1) AS x, count(*) AS n FROM pred GROUP BY go_no) SELECT go_no, round(x * ln(0.4) + (n - x) * ln(0.6) - x * ln(0.3) - (n - x) * ln(0.7), 5) AS ratio, round(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(0.4) + (n - x) * ln(0.6), 4) AS log_density FROM c")
def binomial_ratio(spark: SparkSession, d: str) -> DataFrame:
    c = A.predictions(spark, d).groupBy("go_no").agg(F.count_if(F.col("is_correct") == 1).alias("x"), F.count("*").alias("n"))
    return c.select("go_no", F.round(T.binomial_log_density(F.col("x"), F.col("n"), F.lit(0.4)) - T.binomial_log_density(F.col("x"), F.col("n"), F.lit(0.3)), 5).alias("ratio"), F.round(T.binomial_log_density(F.col("x"), F.col("n"), F.lit(0.4)), 4).alias("log_density"))


@query("t9_fisher_exact", f"WITH {A.PREDICTIONS}, c AS (SELECT go_no, count(*) FILTER (is_correct = 1 AND p_value <= 0.05) AS a, count(*) FILTER (is_correct = 1 AND p_value > 0.05) AS b, count(*) FILTER (is_correct = 0 AND p_value <= 0.05) AS c, count(*) FILTER (is_correct = 0 AND p_value > 0.05) AS d FROM pred GROUP BY go_no), q AS (SELECT go_no, a, a + b AS r, a + c AS k, a + b + c + d AS n FROM c), l AS (SELECT *, list_transform(range(greatest(0, k - (n - r)), least(r, k) + 1), lambda i: lgamma(r + 1) - lgamma(i + 1) - lgamma(r - i + 1) + lgamma(n - r + 1) - lgamma(k - i + 1) - lgamma(n - r - k + i + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)) AS lp FROM q) SELECT go_no, round(least(1.0, list_sum(list_transform(list_filter(lp, lambda v: v <= lp[a - greatest(0, k - (n - r)) + 1] + ln(1.0000001)), lambda v: exp(v)))), 6) AS p FROM l")
def fisher(spark: SparkSession, d: str) -> DataFrame:
    ok, low = F.col("is_correct") == 1, F.col("p_value") <= 0.05
    no = F.col("is_correct") == 0
    c = A.predictions(spark, d).groupBy("go_no").agg(F.count_if(ok & low).alias("a"), F.count_if(ok & ~low).alias("b"), F.count_if(no & low).alias("c"), F.count_if(no & ~low).alias("d"))
    return T.fisher_two_sided(c, ["go_no"]).select("go_no", F.round("p", 6).alias("p"))


@query("t8_welch", "SELECT p_brand, round((avg(y) - avg(x)) / sqrt(var_samp(x) / count(x) + var_samp(y) / count(y)), 5) AS t FROM (SELECT p_brand, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS x, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS y FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY p_brand")
def welch(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = A.table(spark, d, "lineitem").join(p, "l_partkey").select("p_brand", (F.col("l_returnflag") == "R").cast("int").alias("g"), "l_extendedprice")
    return T.welch(rows, ["p_brand"], "g", "l_extendedprice").select("p_brand", F.round("t", 5).alias("t"))


@query("t10_kolmogorov_smirnov", "WITH b AS (SELECT c_acctbal AS v, 1 AS x, 0 AS y FROM customer UNION ALL SELECT s_acctbal, 0, 1 FROM supplier), s AS (SELECT v, sum(x) AS x, sum(y) AS y FROM b GROUP BY v), r AS (SELECT sum(x) OVER (ORDER BY v) AS cx, sum(y) OVER (ORDER BY v) AS cy FROM s) SELECT round(max(abs(cx / (SELECT count(*) FROM customer) - cy / (SELECT count(*) FROM supplier))), 6) AS d FROM r")
def kolmogorov_smirnov(spark: SparkSession, d: str) -> DataFrame:
    a, b = A.table(spark, d, "customer").select(F.col("c_acctbal").alias("v")), A.table(spark, d, "supplier").select(F.col("s_acctbal").alias("v"))
    return T.two_sample_ks(a, b, "v").select(F.round("d", 6).alias("d"))


@query("t5_factor_pairs", f"WITH {A.MEMBERS}, bs AS (SELECT DISTINCT l_partkey AS gene_no, l_linenumber AS bs_no FROM lineitem WHERE l_discount >= 0.08), g AS (SELECT a.bs_no AS b1, b.bs_no AS b2, count(*) AS m FROM bs a JOIN bs b ON a.gene_no = b.gene_no AND a.bs_no < b.bs_no GROUP BY ALL), l AS (SELECT mcl_id, a.bs_no AS b1, b.bs_no AS b2, count(*) AS x FROM mem JOIN bs a USING (gene_no) JOIN bs b ON b.gene_no = mem.gene_no AND a.bs_no < b.bs_no GROUP BY ALL), k AS (SELECT mcl_id, count(*) AS k FROM mem GROUP BY mcl_id), c AS (SELECT mcl_id, b1, b2, x, m, k, {GENES} AS n FROM l JOIN g USING (b1, b2) JOIN k USING (mcl_id)) SELECT mcl_id, b1, b2, x, round({TAIL}, 6) AS p FROM c")
def factor_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of factors: genes that both bind, in the cluster and overall."""
    bs = A.table(spark, d, "lineitem").where("l_discount >= 0.08").select(F.col("l_partkey").alias("gene_no"), F.col("l_linenumber").alias("b1")).distinct()
    both = bs.join(bs.withColumnRenamed("b1", "b2"), "gene_no").where("b1 < b2")
    m = A.members(spark, d)
    overall = both.groupBy("b1", "b2").agg(F.count("*").alias("m"))
    local = m.join(both, "gene_no").groupBy("mcl_id", "b1", "b2").agg(F.count("*").alias("x")).join(overall, ["b1", "b2"]).join(m.groupBy("mcl_id").agg(F.count("*").alias("k")), "mcl_id")
    return T.with_tail(local, A.table(spark, d, "part").count()).select("mcl_id", "b1", "b2", "x", F.round("p", 6).alias("p"))
