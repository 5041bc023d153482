"""The given tables seen as the domain's objects, as DataFrames and as the same SQL.

datasets x edges: brands bought together in an order and quarter, significant where they are in a quarter's top fifth;
expression matrices: embeddings cut into 8 datasets of 8 conditions; genes: parts, whose function is p_size (promo parts
are of unknown function); ontology: divisibility among the sizes of parts; clusters: parts that a supplier sold in lots of 46 or more;
predictions: line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netweft.operators.tables import cut, dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o, dataset_no, gene: the brands of an order in a quarter, once each."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("gene"))
    quarter = ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate")).cast("int")
    li = table(spark, sf_dir, "lineitem")
    b = li.select(F.col("l_orderkey").alias("o"), quarter.alias("dataset_no"), "l_partkey").join(part, "l_partkey").select("o", "dataset_no", "gene")
    return dealt(b, "o", "dataset_no", rows=li.count()).distinct()


def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset_no, g1 < g2, n."""
    b = brand_datasets(spark, sf_dir)
    other = b.select("o", "dataset_no", F.col("gene").alias("g2"))
    return b.withColumnRenamed("gene", "g1").join(other, ["o", "dataset_no"]).where("g1 < g2").groupBy("dataset_no", "g1", "g2").agg(F.count("*").alias("n"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant edges of each dataset: dataset_no, g1 < g2, n."""
    from netweft.operators.ranking import top_share

    counts = cut(edge_counts(spark, sf_dir), "edge-counts")  # a row for each pair of brands, but read several times
    return top_share(counts, ["dataset_no"], "n", ["g1", "g2"], 0.2)


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset_no, gene_no, v: eight conditions a dataset."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gene_no"), F.col("embedding").cast("array<double>").alias("e"))
    return e.select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("dataset_no"), "gene_no", "e").select("dataset_no", "gene_no", F.slice("e", F.col("dataset_no") * 8 + 1, 8).alias("v"))


def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_no, go_no of parts of known function."""
    return table(spark, sf_dir, "part").where("p_type <> 'PROMO'").select(F.col("p_partkey").alias("gene_no"), F.col("p_size").alias("go_no"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_no, known."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_no"), (F.col("p_type") != "PROMO").alias("known"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mcl_id, gene_no: clusters."""
    return table(spark, sf_dir, "lineitem").where("l_quantity >= 46").select(F.col("l_suppkey").alias("mcl_id"), F.col("l_partkey").alias("gene_no")).distinct()


def term_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, child of the divisibility DAG on the sizes that parts have, and 1, its root: a child is its parent times a prime."""
    terms = table(spark, sf_dir, "part").where("p_size is not null").select(F.col("p_size").alias("child")).union(spark.range(1, 2).select(F.col("id").cast("int"))).distinct()
    primes = F.filter(F.sequence(F.lit(2), F.greatest("child", F.lit(2))), lambda p: (F.col("child") % p == 0) & ~F.exists(F.sequence(F.lit(2), F.greatest(p - 1, F.lit(2))), lambda q: (q < p) & (p % q == 0)))
    found = terms.select("child", F.explode(primes).alias("p")).select((F.col("child") / F.col("p")).cast("int").alias("parent"), "child")
    return found.join(terms.withColumnRenamed("child", "parent"), "parent", "left_semi").select("parent", "child")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS p_gene_id", "l_suppkey AS gene_no", "cast(l_quantity AS int) AS go_no", "l_orderkey % 500 AS mcl_id", "l_discount AS p_value",
        "round(l_extendedprice / 1000) AS score", "l_tax AS connectivity", "l_linenumber AS cluster_size",
        "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE -1 END AS is_correct",
    )


BRANDS = """lq AS (SELECT DISTINCT l_orderkey AS o, CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) AS INT) AS dataset_no,
  CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS gene FROM lineitem JOIN part ON l_partkey = p_partkey)"""
EDGE_COUNTS = BRANDS + """, ec AS (SELECT a.dataset_no, a.gene AS g1, b.gene AS g2, count(*) AS n FROM lq a JOIN lq b ON a.o = b.o AND a.dataset_no = b.dataset_no AND a.gene < b.gene GROUP BY ALL)"""
EDGES = EDGE_COUNTS + """, edge AS (SELECT dataset_no, g1, g2, n FROM (SELECT *, row_number() OVER (PARTITION BY dataset_no ORDER BY n DESC, g1, g2) AS r, count(*) OVER (PARTITION BY dataset_no) AS c FROM ec)
  WHERE r <= CAST(floor(c * 0.2) AS INT))"""
EXPRESSION = """expr AS (SELECT d AS dataset_no, vec_id AS gene_no, list_transform(embedding[d * 8 + 1:d * 8 + 8], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings, (SELECT unnest(range(0, 8)) AS d))"""
ASSOC = """assoc AS (SELECT p_partkey AS gene_no, p_size AS go_no FROM part WHERE p_type <> 'PROMO')"""
GENES = """gene AS (SELECT p_partkey AS gene_no, p_type <> 'PROMO' AS known FROM part)"""
MEMBERS = """mem AS (SELECT DISTINCT l_suppkey AS mcl_id, l_partkey AS gene_no FROM lineitem WHERE l_quantity >= 46)"""
TERMS = """tm AS (SELECT DISTINCT p_size AS term FROM part WHERE p_size IS NOT NULL UNION SELECT 1), nn AS (SELECT unnest(range(2, (SELECT max(term) FROM tm) + 1)) AS x),
pr AS (SELECT x AS p FROM nn a WHERE NOT EXISTS (SELECT 1 FROM nn b WHERE b.x < a.x AND a.x % b.x = 0)),
t2t AS (SELECT CAST(term // p AS INT) AS parent, term AS child FROM tm, pr WHERE term % p = 0 AND term // p IN (SELECT term FROM tm))"""
PREDICTIONS = """pred AS (SELECT l_orderkey * 8 + l_linenumber AS p_gene_id, l_suppkey AS gene_no, CAST(l_quantity AS INT) AS go_no, l_orderkey % 500 AS mcl_id, l_discount AS p_value,
  round(l_extendedprice / 1000) AS score, l_tax AS connectivity, l_linenumber AS cluster_size, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE -1 END AS is_correct FROM lineitem)"""
