"""Queries on the scalar, string and array functions, over names, brands and texts of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.functions import arrays
from netweft.functions import text as X
from netweft.operators import sequences
from netweft.plans import adapters as A
from netweft.plans.annotation import text
from netweft.plans.network import CLUSTERS, DATASETS, brand_clusters
from netweft.plans.registry import query

# Sequences: the letters a, c, g and t of a whole text, as upper case.
BASES = "sq AS (SELECT doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS s FROM documents)"


def sequences_of(spark: SparkSession, d: str) -> DataFrame:
    s = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "")
    return A.table(spark, d, "documents").select("doc_id", s.alias("s"))


@query("f16_reverse_complement", f"WITH {BASES} SELECT doc_id, reverse(translate(s, 'ACGT', 'TGCA')) AS r FROM sq")
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return sequences_of(spark, d).select("doc_id", X.reverse_complement(F.col("s")).alias("r"))


@query("f16_mismatches", f"WITH {BASES}, p AS (SELECT doc_id, string_split(s, '') AS x, string_split(reverse(translate(s, 'ACGT', 'TGCA')), '') AS y, regexp_extract_all(s, '.{{8}}') AS w FROM sq) SELECT doc_id, CAST(len(list_filter(list_zip(x, y), lambda z: z[1] <> z[2])) AS INT) AS n, CAST(coalesce(list_sum(list_transform(w, lambda v: len(list_filter(range(1, 9), lambda i: NOT contains(['AG', 'ACGT', 'CT', 'A', 'ACGT', 'CG', 'GT', 'ACT'][i], v[i]))))), 0) AS BIGINT) AS c FROM p")
def mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Places where a sequence differs from its reverse complement, and where its pieces of eight bases, side by side, differ from
    the consensus RNYANSKH."""
    s = sequences_of(spark, d)
    pieces = sequences.chunked(s, "doc_id", "s", 8).where("length(piece) = 8")
    found = pieces.groupBy("doc_id").agg(F.sum(X.consensus_mismatches(F.lit("RNYANSKH"), F.col("piece"))).alias("c"))
    return s.join(found, "doc_id", "left").select("doc_id", X.mismatches(F.col("s"), X.reverse_complement(F.col("s"))).alias("n"), F.coalesce("c", F.lit(0)).cast("long").alias("c"))


@query("f17_allowed_mismatches", f"WITH {BASES} SELECT doc_id, CASE WHEN length(s) <= 5 THEN 0 ELSE greatest(1, floor(length(s) * 0.1))::INT END AS n FROM sq")
def allowed_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return sequences_of(spark, d).select("doc_id", X.allowed_mismatches(F.col("s"), 0.1, 1, 5).alias("n"))


@query("f18_sequence_segments", "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN substr(text, 150, 301) ELSE reverse(substr(text, 150, 301)) END) AS segment FROM documents WHERE length(text) >= 150")
def sequence_segments(spark: SparkSession, d: str) -> DataFrame:
    """Characters 150 to 450 of every text, put together from chunks of 100; odd texts ask from 450 back to 150."""
    docs = A.table(spark, d, "documents").where(F.length("text") >= 150)
    chunks = sequences.chunked(docs.select("doc_id", "text"), "doc_id", "text", 100)
    odd = F.col("doc_id") % 2 == 1
    asked = docs.select("doc_id", F.when(odd, 450).otherwise(150).alias("start"), F.when(odd, 150).otherwise(450).alias("stop"))
    return sequences.segments(chunks, asked, "doc_id", 100).select("doc_id", F.md5("segment").alias("segment"))


@query("f11_roman_numerals", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 19 WHEN 1 THEN 4 WHEN 2 THEN 9 WHEN 3 THEN 16 ELSE 8 END AS value FROM nation")
def roman_numerals(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey") % 5
    numeral = F.when(n == 0, "XIX").when(n == 1, "IV").when(n == 2, "ix").when(n == 3, "XVI").otherwise("VIII")
    return A.table(spark, d, "nation").select("n_nationkey", X.roman(numeral).alias("value"))


@query("f12_organisms", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 9606 WHEN 1 THEN 4932 END AS tax_id, CASE n_nationkey % 3 WHEN 0 THEN 'Hs' WHEN 1 THEN 'Sc' ELSE 'Nx' END AS short FROM nation")
def organisms(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey") % 3
    name = F.when(n == 0, "Homo sapiens").when(n == 1, "Saccharomyces cerevisiae").otherwise("No xone")
    return A.table(spark, d, "nation").select("n_nationkey", X.tax_id(name).alias("tax_id"), X.short_name(name).alias("short"))


@query("f20_trailing_number", "SELECT c_name, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS INT) AS number FROM customer")
def trailing_number(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "customer").select("c_name", X.trailing_number(F.col("c_name")).alias("number"))


@query("f27_safe_names", "SELECT o_orderkey, regexp_replace(regexp_replace(x, '(^|\\s)-+', '\\1', 'g'), '[-.,\\s]', '_', 'g') AS name FROM (SELECT o_orderkey, '-k ' || o_orderpriority || ',' || floor(o_totalprice)::INT || ' --x-y' AS x FROM orders)")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit("-k "), F.col("o_orderpriority"), F.lit(","), F.floor("o_totalprice").cast("int").cast("string"), F.lit(" --x-y"))
    return A.table(spark, d, "orders").select("o_orderkey", X.safe_name(x).alias("name"))


@query("f1_mapped_lists", f"WITH {A.MEMBERS}, m AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_type <> 'PROMO') SELECT mcl_id, string_agg(v::VARCHAR, ' ' ORDER BY gene_no) AS found, string_agg(coalesce(v, gene_no)::VARCHAR, ' ' ORDER BY gene_no) AS kept FROM mem LEFT JOIN m ON k = gene_no GROUP BY mcl_id")
def mapped_lists(spark: SparkSession, d: str) -> DataFrame:
    """Gene lists of clusters through the part of a map that they need: misses go, or stay as they are."""
    m = A.table(spark, d, "part").where("p_type <> 'PROMO'").select(F.col("p_partkey").alias("gene_no"), F.col("p_size").cast("long").alias("v"))
    own = A.members(spark, d).join(m, "gene_no", "left").groupBy("mcl_id").agg(
        F.array_sort(F.collect_list(F.col("gene_no").cast("long"))).alias("genes"), F.map_from_entries(F.filter(F.collect_list(F.struct(F.col("gene_no").cast("long"), "v")), lambda e: e["v"].isNotNull())).alias("map")
    )
    return own.select("mcl_id", F.nullif(text(arrays.map_list(F.col("genes"), F.col("map"))), F.lit("")).alias("found"), text(arrays.map_list(F.col("genes"), F.col("map"), True)).alias("kept"))


@query("f6_contained_masks", f"WITH {A.EDGES}, k AS (SELECT g1, g2, CAST(sum(1::BIGINT << (dataset_no - 1)) AS BIGINT) AS m FROM edge GROUP BY g1, g2) SELECT s AS dataset_no, count(*) AS edges FROM k, (SELECT unnest(range(1, {DATASETS})) AS s) WHERE (m & (3::BIGINT << (s - 1))) = 3::BIGINT << (s - 1) GROUP BY s")
def contained_masks(spark: SparkSession, d: str) -> DataFrame:
    """Edges that two datasets in a row have, by the first of them."""
    from netweft.operators import graphs

    k = graphs.edge_vectors(A.edges(spark, d), DATASETS).select(arrays.encode_mask(F.col("occ")).alias("m"))
    signature = F.call_function("shiftleft", F.lit(3).cast("long"), F.col("s") - 1)
    return k.select("m", F.explode(F.sequence(F.lit(1), F.lit(DATASETS - 1))).alias("s")).where(arrays.contains_mask(F.col("m"), signature)).groupBy(F.col("s").cast("long").alias("dataset_no")).agg(F.count("*").alias("edges"))


@query("f8_canonical_edges", "SELECT least(l_partkey, l_suppkey) AS g1, greatest(l_partkey, l_suppkey) AS g2, count(*) AS n FROM lineitem GROUP BY ALL")
def canonical_edges(spark: SparkSession, d: str) -> DataFrame:
    from netweft.operators import graphs

    e = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("g1"), F.col("l_suppkey").alias("g2"))
    return graphs.canonical(e).groupBy("g1", "g2").agg(F.count("*").alias("n"))


@query("k12_array_literals", f"WITH {CLUSTERS} SELECT mcl_id, '{{' || string_agg(gene_no::VARCHAR, ',' ORDER BY gene_no) || '}}' AS literal, count(*) AS size FROM cl GROUP BY mcl_id")
def array_literals(spark: SparkSession, d: str) -> DataFrame:
    """Gene arrays as literals in braces, read back to count their elements."""
    c = brand_clusters(spark, d).groupBy("mcl_id").agg(F.array_sort(F.collect_set("gene_no")).alias("g"))
    literal = c.select("mcl_id", arrays.array_text(F.col("g"), "{", "}", ",").alias("literal"))
    return literal.select("mcl_id", "literal", F.size(arrays.braces_to_array(F.col("literal"))).cast("long").alias("size"))


@query("k16_numbered_ids", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS position, p_partkey AS gene_no FROM part")
def numbered_ids(spark: SparkSession, d: str) -> DataFrame:
    """Genes in order with their place from 0: the index that outside tools use."""
    from netweft.operators.ranking import numbered

    return numbered(A.table(spark, d, "part").select(F.col("p_partkey").alias("gene_no")), ["gene_no"], "r").select((F.col("r") - 1).alias("position"), "gene_no")
