"""Queries on expression vectors, correlations and edge vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.functions import arrays
from netweft.operators import correlation as C
from netweft.operators import ranking
from netweft.plans import adapters as A
from netweft.plans.registry import query

PAIR = f"{A.EXPRESSION}, pr AS (SELECT a.dataset_no, a.gene_no AS g1, b.gene_no AS g2, a.v AS v1, b.v AS v2 FROM expr a JOIN expr b ON a.dataset_no = b.dataset_no AND a.gene_no < b.gene_no)"


@query("c1_pearson", f"WITH {PAIR}, l AS (SELECT dataset_no, g1, g2, unnest(v1) AS x, unnest(v2) AS y FROM pr) SELECT dataset_no, g1, g2, round(corr(x, y), 6) AS cor FROM l GROUP BY dataset_no, g1, g2 HAVING abs(round(corr(x, y), 6)) >= 0.9")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    pairs = C.gene_pairs(A.expression(spark, d), ("cor",), lambda found, _: np.abs(found["cor"]) >= 0.9 - 1e-6)
    return pairs.select("dataset_no", "g1", "g2", F.round("cor", 6).alias("cor")).where("abs(cor) >= 0.9")


LOO = f"""{PAIR}, k AS (SELECT dataset_no, g1, g2, v1, v2, unnest(range(1, 9)) AS k FROM pr), l AS (SELECT dataset_no, g1, g2, k, unnest(v1) AS x, unnest(v2) AS y, unnest(range(1, 9)) AS i FROM k),
c AS (SELECT dataset_no, g1, g2, k, corr(x, y) AS r FROM l WHERE i <> k GROUP BY ALL), m AS (SELECT dataset_no, g1, g2, arg_min(r, struct_pack(s := round(abs(r), 12), k := k)) AS r FROM c GROUP BY ALL)"""


@query("c2_leave_one_out", f"WITH {LOO} SELECT dataset_no, g1, g2, round(r, 6) AS min_cor, 5 AS df FROM m WHERE round(r, 6) >= 0.8")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    pairs = C.gene_pairs(A.expression(spark, d), ("min_cor", "df"), lambda found, _: found["min_cor"] >= 0.8 - 1e-6)
    return pairs.select("dataset_no", "g1", "g2", F.round("min_cor", 6).alias("min_cor"), "df").where("min_cor >= 0.8")


@query("c6_correlation_graph", f"WITH {LOO} SELECT dataset_no, g1, g2, round(round(r, 9), 6) AS cor FROM (SELECT *, row_number() OVER (PARTITION BY dataset_no ORDER BY round(r, 9) DESC, g1, g2) AS q FROM m) WHERE q <= (SELECT CAST(floor(count(*) * count(*) * 0.01) AS INT) FROM embeddings)")
def correlation_graph(spark: SparkSession, d: str) -> DataFrame:
    return C.top_correlations(A.expression(spark, d), 0.01).withColumn("cor", F.round("cor", 6))


@query("c6_recurrent_correlations", f"WITH {LOO}, t AS (SELECT dataset_no, g1, g2 FROM (SELECT *, row_number() OVER (PARTITION BY dataset_no ORDER BY round(r, 9) DESC, g1, g2) AS q FROM m) WHERE q <= (SELECT CAST(floor(count(*) * count(*) * 0.01) AS INT) FROM embeddings)) SELECT g1, g2, count(*) AS recurrence FROM t GROUP BY g1, g2 HAVING count(*) >= 2")
def recurrent_correlations(spark: SparkSession, d: str) -> DataFrame:
    from netweft.operators.graphs import overlay

    return overlay(C.top_correlations(A.expression(spark, d), 0.01), 2)


CUT5 = C.correlation_cut_off(0.01, 5)


@query("c8_edge_significance", f"WITH {LOO} SELECT dataset_no, count(*) FILTER (r >= {CUT5!r} AND r <= 1) AS significant, count(*) AS pairs FROM m GROUP BY dataset_no")
def edge_significance(spark: SparkSession, d: str) -> DataFrame:
    """Pairs below and from the cut-off of five degrees of freedom on (all vectors are complete), counted in the kernel."""
    counts = C.pair_counts(A.expression(spark, d), "min_cor", lambda r: np.where(np.isnan(r), np.nan, (r >= CUT5) & (r <= 1)))
    return counts.groupBy("dataset_no").agg(F.coalesce(F.sum(F.when(F.col("bin") == 1, F.col("pairs"))), F.lit(0)).alias("significant"), F.sum("pairs").alias("pairs"))


@query("c8_complete_vectors", f"WITH {A.EXPRESSION}, e AS (SELECT vec_id AS g1 FROM embeddings), p AS (SELECT e.g1, e.g1 + 1 AS g2, a.dataset_no, unnest(a.v) AS x, unnest(b.v) AS y FROM e JOIN expr a ON a.gene_no = e.g1 JOIN expr b ON b.gene_no = e.g1 + 1 AND a.dataset_no = b.dataset_no) SELECT g1, g2, string_agg(CAST(trunc(c * 1000) AS INT)::VARCHAR, ' ' ORDER BY dataset_no) AS cor_milli FROM (SELECT g1, g2, dataset_no, round(corr(x, y), 9) AS c FROM p GROUP BY ALL) GROUP BY g1, g2")
def complete_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of given edges in every dataset, as one vector of thousandths (truncated) an edge."""
    x = A.expression(spark, d)
    edges = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("g1"), (F.col("vec_id") + 1).alias("g2"))
    both = edges.join(x.select(F.col("gene_no").alias("g1"), "dataset_no", F.col("v").alias("v1")), "g1").join(x.select(F.col("gene_no").alias("g2"), "dataset_no", F.col("v").alias("v2")), ["g2", "dataset_no"])
    milli = (F.round(C.pearson(F.col("v1"), F.col("v2")), 9) * 1000).cast("int").cast("string")
    return both.groupBy("g1", "g2").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dataset_no", milli.alias("m")))), lambda e: e["m"]), " ").alias("cor_milli"))


@query("c4_euclidean", f"WITH {PAIR}, x AS (SELECT dataset_no, list_distance(v1, v2) AS d FROM pr) SELECT dataset_no, count(*) AS pairs, round(avg(d), 6) AS mean, round(max(d), 6) AS largest FROM x GROUP BY dataset_no")
def euclidean(spark: SparkSession, d: str) -> DataFrame:
    s = C.pair_summary(A.expression(spark, d), ("distance",))
    return s.select("dataset_no", "pairs", F.round(F.col("distance_sum") / F.col("pairs"), 6).alias("mean"), F.round("distance_max", 6).alias("largest"))


@query("c5_difference_spread", f"WITH {PAIR}, l AS (SELECT dataset_no, g1, g2, unnest(v1) - unnest(v2) AS x FROM pr), s AS (SELECT dataset_no, var_samp(x) AS v, avg(x) AS m FROM l GROUP BY dataset_no, g1, g2) SELECT dataset_no, round(avg(v), 6) AS variance, round(max(m), 6) AS largest_mean FROM s GROUP BY dataset_no")
def difference_spread(spark: SparkSession, d: str) -> DataFrame:
    s = C.spread_of_differences(A.expression(spark, d))
    return s.select("dataset_no", F.round(F.col("variance_sum") / F.col("pairs"), 6).alias("variance"), F.round("mean_max", 6).alias("largest_mean"))


@query("p2_variance_filter", f"WITH {A.EXPRESSION}, s AS (SELECT dataset_no, gene_no, round(stddev_samp(x), 9) AS spread FROM (SELECT dataset_no, gene_no, unnest(v) AS x FROM expr) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dataset_no ORDER BY spread DESC, gene_no DESC) AS r, count(*) OVER (PARTITION BY dataset_no) AS n FROM s) SELECT dataset_no, count(*) AS genes, CAST(sum(gene_no) AS BIGINT) AS ids FROM r WHERE r <= CAST(floor(n * 0.9) AS INT) GROUP BY dataset_no")
def variance_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.variance_filter(A.expression(spark, d)).groupBy("dataset_no").agg(F.count("*").alias("genes"), F.sum("gene_no").alias("ids"))


@query("p3_spread_threshold", f"WITH {A.EXPRESSION} SELECT dataset_no, gene_no FROM (SELECT dataset_no, gene_no, unnest(v) AS x FROM expr) GROUP BY ALL HAVING round(stddev_samp(x) / nullif(avg(x), 0), 9) >= 20")
def spread_threshold(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return A.expression(spark, d).where(F.round(arrays.std(v) / F.nullif(arrays.mean(v), F.lit(0.0)), 9) >= 20).select("dataset_no", "gene_no")


@query("p4_top_spread_edges", f"WITH {A.EXPRESSION}, s AS (SELECT dataset_no, gene_no, round(stddev_samp(x), 9) AS s FROM (SELECT dataset_no, gene_no, unnest(v) AS x FROM expr) GROUP BY ALL) SELECT dataset_no, gene_no FROM (SELECT *, row_number() OVER (PARTITION BY dataset_no ORDER BY s DESC, gene_no) AS r, count(*) OVER (PARTITION BY dataset_no) AS n FROM s) WHERE r <= greatest(CAST(floor(n * 0.1) AS INT), 200)")
def top_spread(spark: SparkSession, d: str) -> DataFrame:
    s = A.expression(spark, d).withColumn("s", F.round(arrays.std(F.col("v")), 9))
    return ranking.top_share(s, ["dataset_no"], "s", ["gene_no"], 0.1, 200).select("dataset_no", "gene_no")


@query("a2_merge_duplicate_genes", f"WITH {A.EXPRESSION}, p AS (SELECT dataset_no, gene_no % 50 AS gene_no, unnest(v) AS x, unnest(range(0, 8)) AS pos FROM expr) SELECT dataset_no, gene_no, pos, round(avg(x), 6) AS x FROM p GROUP BY ALL")
def merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    m = C.merge_duplicates(A.expression(spark, d).withColumn("gene_no", F.col("gene_no") % 50))
    return m.select("dataset_no", "gene_no", F.posexplode("v").alias("pos", "x")).select("dataset_no", "gene_no", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("f14_log_floor", f"WITH {A.EXPRESSION} SELECT dataset_no, round(sum(ln(greatest(x * 100, 10))), 4) AS total FROM (SELECT dataset_no, unnest(v) AS x FROM expr) GROUP BY dataset_no")
def log_floor(spark: SparkSession, d: str) -> DataFrame:
    x = A.expression(spark, d).select("dataset_no", F.explode(arrays.log_floor(F.transform("v", lambda x: x * 100))).alias("x"))
    return x.groupBy("dataset_no").agg(F.round(F.sum("x"), 4).alias("total"))


@query("f15_fill_missing", f"WITH {A.EXPRESSION} SELECT dataset_no, count(*) AS n, count(*) FILTER (x > 0) AS present, count(*) FILTER (x <= 0) AS inside, round(sum(x) FILTER (x > 0), 4) AS total FROM (SELECT dataset_no, unnest(v) AS x FROM expr) GROUP BY dataset_no")
def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    """Values above 0 stay; the others are taken for missing and drawn from [-1, 1): how many lie in that range, and the rest."""
    holes = F.transform("v", lambda x: F.when(x > 0, x))
    filled = A.expression(spark, d).select("dataset_no", F.explode(F.arrays_zip(holes.alias("h"), arrays.fill_missing(holes, F.col("gene_no"), 3).alias("x"))).alias("p"))
    h, x = F.col("p.h"), F.col("p.x")
    return filled.groupBy("dataset_no").agg(F.count(x).alias("n"), F.count_if(h == x).alias("present"), F.count_if(h.isNull() & x.between(-1, 1)).alias("inside"), F.round(F.sum(F.when(h == x, x)), 4).alias("total"))


# The tail of Student's t has a closed form for whole degrees of freedom, with the correlation as the sine of the angle.
INSIDE = """CASE WHEN df % 2 = 0 THEN mid * list_sum(list_transform(range(0, df // 2), lambda k: exp(coalesce(list_sum(list_transform(range(1, k + 1), lambda j: ln((2 * j - 1) / (2 * j)))), 0)) * pow(1 - mid * mid, k)))
ELSE 2 / pi() * (asin(mid) + mid * coalesce(list_sum(list_transform(range(0, (df - 1) // 2), lambda k: exp(coalesce(list_sum(list_transform(range(1, k + 1), lambda j: ln((2 * j) / (2 * j + 1)))), 0)) * pow(1 - mid * mid, k + 0.5))), 0)) END"""


@query("f23_cut_off_table", f"WITH RECURSIVE g AS (SELECT CAST(len(list_filter(embedding, lambda x: x > 0)) - 2 AS INT) AS df, count(*) AS genes FROM embeddings GROUP BY 1), b AS (SELECT df, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, 0 AS i FROM g WHERE df >= 1 UNION ALL SELECT df, CASE WHEN tail > 0.01 THEN mid ELSE lo END, CASE WHEN tail > 0.01 THEN hi ELSE mid END, i + 1 FROM (SELECT *, (1 - {INSIDE}) / 2 AS tail FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE i < 50))) SELECT df, genes, round(lo, 7) AS cut FROM b JOIN g USING (df) WHERE i = 50")
def cut_off_table(spark: SparkSession, d: str) -> DataFrame:
    """How many genes have so many positive values, and the correlation that is significant with as many."""
    n = A.table(spark, d, "embeddings").select((F.size(F.filter("embedding", lambda x: x > 0)) - 2).alias("df"))
    genes = n.groupBy("df").agg(F.count("*").alias("genes"))
    return genes.join(C.cut_off_table(n, 0.01), "df").select("df", "genes", F.round("cut", 7).alias("cut"))


@query("t21_spread_histogram", f"WITH {A.EXPRESSION}, s AS (SELECT round(stddev_samp(x), 9) AS s FROM (SELECT dataset_no, gene_no, unnest(v) AS x FROM expr) GROUP BY dataset_no, gene_no) SELECT CAST(floor(s * 20) AS INT) AS bin, count(*) AS genes FROM s GROUP BY 1")
def spread_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.expression(spark, d).select(F.floor(F.round(arrays.std(F.col("v")), 9) * 20).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("genes"))


@query("t21_correlation_histogram", f"WITH {PAIR}, l AS (SELECT dataset_no, g1, g2, unnest(v1) AS x, unnest(v2) AS y FROM pr), c AS (SELECT round(corr(x, y), 9) AS r FROM l GROUP BY dataset_no, g1, g2) SELECT CAST(floor(r * 10) AS INT) AS bin, count(*) AS pairs FROM c GROUP BY 1")
def correlation_histogram(spark: SparkSession, d: str) -> DataFrame:
    counts = C.pair_counts(A.expression(spark, d), "cor", lambda r: np.floor(np.round(r, 9) * 10))
    return counts.groupBy("bin").agg(F.sum("pairs").alias("pairs"))
