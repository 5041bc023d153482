"""Queries on text formats: lines made of the given tables are written to the shared folder, read back and compared with the
tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.operators import graphs
from netweft.operators.tables import new_path
from netweft.plans import adapters as A
from netweft.plans.ontology import HEAD, paths
from netweft.plans.registry import query
from netweft.sources import formats, writers


LINES_A_FILE = 500_000  # fixed value: line items whose entries one file that can't be split holds, some 40 MB


def put(lines: DataFrame, name: str) -> str:
    """The folder that the lines (column ``value``) are written to."""
    path = new_path(lines.sparkSession, f"lines-{name}")
    lines.select("value").write.text(path)
    return path


def words(*columns, by: str = "\t") -> Column:
    """Columns, given by name or as expressions, as one line."""
    return F.concat_ws(by, *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])


def joined(array: Column, by: str = " ") -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), by, "NA")


@query("s1_expression_matrix", "SELECT 1 AS dataset_no, 'g' || vec_id AS gene_id, len(v) AS conditions, len(list_filter(v, lambda x: x >= 0)) AS present, round(list_sum(list_filter(v, lambda x: x >= 0)), 5) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) WHERE len(list_filter(v, lambda x: x >= 0)) >= 30")
def expression_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Negative values are written as NA; genes with fewer than 30 values are dropped by the reader."""
    e = A.table(spark, d, "embeddings").select(F.concat(F.lit("g"), F.col("vec_id").cast("string")).alias("gene_id"), F.transform("embedding", lambda x: F.when(x >= 0, x.cast("double"))).alias("v"))
    m = formats.expression_matrix(spark, put(e.select(words("gene_id", joined(F.col("v"), "\t")).alias("value")), "matrix"), 1, 30)
    has = F.filter("v", lambda x: x.isNotNull())
    return m.select("dataset_no", "gene_id", F.size("v").cast("long").alias("conditions"), F.size(has).cast("long").alias("present"), F.round(F.aggregate(has, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


WEIGHTED = f"WITH {A.EDGE_COUNTS}, w AS (SELECT g1, g2, CAST(sum(n) AS DOUBLE) AS weight FROM ec GROUP BY g1, g2)"


def weighted_edges(spark: SparkSession, d: str) -> DataFrame:
    return A.edge_counts(spark, d).groupBy("g1", "g2").agg(F.sum("n").cast("double").alias("weight"))


def graph_file(spark: SparkSession, d: str) -> str:
    """Head, vertex lines and the edge lines of the writer (K1)."""
    e = weighted_edges(spark, d)
    head = spark.range(1).select(F.lit("t # brands").alias("value"))
    vertices = graphs.endpoints(e).distinct().select(F.concat(F.lit("v "), F.col("gene").cast("string"), F.lit(" b"), F.col("gene").cast("string")).alias("value"))
    return put(head.unionByName(vertices).unionByName(writers.edge_lines(e)), "graph")


@query("s2_graph_scan", f"{WEIGHTED} SELECT g1, g2, weight FROM w")
def graph_scan(spark: SparkSession, d: str) -> DataFrame:
    return formats.graph_edges(spark, graph_file(spark, d))


@query("s3_weighted_scan", f"{WEIGHTED} SELECT g1, g2, weight FROM w WHERE weight >= (SELECT avg(weight) FROM w)")
def weighted_scan(spark: SparkSession, d: str) -> DataFrame:
    least = weighted_edges(spark, d).agg(F.avg("weight")).first()[0]
    return formats.graph_edges(spark, graph_file(spark, d), least)


@query("s3_matrix_scan", f"{WEIGHTED}, x AS (SELECT g1 AS a, g2 AS b, weight FROM w UNION ALL SELECT g2, g1, weight FROM w), r AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS i FROM (SELECT DISTINCT a FROM x)) SELECT CAST(p.i AS INT) AS g1, CAST(q.i AS INT) AS g2, weight FROM x JOIN r p ON p.a = x.a JOIN r q ON q.a = x.b WHERE p.i < q.i AND weight >= (SELECT avg(weight) FROM w)")
def matrix_scan(spark: SparkSession, d: str) -> DataFrame:
    """An adjacency matrix, a row for each vertex in ascending order behind the row's number; only the upper half is read."""
    e = weighted_edges(spark, d)
    both = e.unionByName(e.select(F.col("g2").alias("g1"), F.col("g1").alias("g2"), "weight"))
    names = sorted(r["gene"] for r in graphs.endpoints(e).distinct().collect())  # brands: a matrix has as many columns
    row = F.array(*[F.coalesce(F.max(F.when(F.col("g2") == g, F.col("weight"))), F.lit(0.0)) for g in names])
    number = F.array_position(F.array(*[F.lit(g) for g in names]), F.col("g1")) - 1
    lines = both.groupBy("g1").agg(row.alias("row")).select(words(number.cast("string"), joined(F.col("row")), by=" ").alias("value"))
    return formats.adjacency_matrix(spark, put(lines, "adjacency"), e.agg(F.avg("weight")).first()[0])


ORDER_SETS = "WITH os AS (SELECT l_orderkey AS o, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS s, count(*) AS n FROM lineitem GROUP BY l_orderkey)"


def order_sets(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("vertex_set"), F.count("*").alias("n"))


def itemset_file(spark: SparkSession, d: str) -> str:
    return put(order_sets(spark, d).select(F.concat(joined(F.col("vertex_set")), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("value")), "itemsets")


@query("s5_itemset_scan", f"{ORDER_SETS} SELECT array_to_string(s, ' ') AS signature, CAST(n AS INT) AS freq FROM os")
def itemset_scan(spark: SparkSession, d: str) -> DataFrame:
    return formats.itemsets(spark, itemset_file(spark, d)).select(joined(F.col("signature")).alias("signature"), "freq")


@query("s6_itemset_filter", f"{ORDER_SETS} SELECT array_to_string(s, ' ') AS value FROM os WHERE len(s) >= 4")
def itemset_filter(spark: SparkSession, d: str) -> DataFrame:
    """Sets of at least four items, written in the other format (K11), and its lines."""
    kept = formats.itemsets(spark, itemset_file(spark, d), 4).withColumnRenamed("signature", "vertex_set")
    return spark.read.text(put(writers.itemset_lines(kept), "reformatted"))


@query("s12_itemset_loader", f"{ORDER_SETS} SELECT len(s) AS items, count(*) AS sets, CAST(sum(n) AS BIGINT) AS freq FROM os WHERE len(s) >= 3 GROUP BY len(s)")
def itemset_loader(spark: SparkSession, d: str) -> DataFrame:
    s = formats.itemsets(spark, itemset_file(spark, d), 3)
    return s.groupBy(F.size("signature").cast("long").alias("items")).agg(F.count("*").alias("sets"), F.sum("freq").alias("freq"))


SIGS = f"WITH {A.EDGES}, sg AS (SELECT g1, g2, list_transform(range(1, 29), lambda i: list_contains(list(dataset_no), i)::INT) AS sig FROM edge GROUP BY g1, g2)"


def edge_vectors(spark: SparkSession, d: str) -> DataFrame:
    return graphs.edge_vectors(A.edges(spark, d), 28).select("g1", "g2", "sig")


@query("s4_vector_scan", f"{SIGS} SELECT g1, g2, array_to_string(sig, ' ') AS sig FROM sg WHERE list_sum(sig) BETWEEN 2 AND 20")
def vector_scan(spark: SparkSession, d: str) -> DataFrame:
    lines = edge_vectors(spark, d).select(words("g2", "g1", joined(F.col("sig")), by=" ").alias("value"))  # ends in either order
    return formats.edge_vectors(spark, put(lines, "vectors"), 2, 20).select("g1", "g2", joined(F.col("sig")).alias("sig"))


@query("k2_transactions", f"{SIGS} SELECT CAST(len(list_filter(sig, lambda x: x = 1)) AS VARCHAR) || ' ' || array_to_string(list_filter(range(1, 29), lambda i: sig[i] = 1), ' ') AS value FROM sg")
def transactions(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.text(put(writers.transaction_lines(edge_vectors(spark, d), True), "transactions"))


BLOCKS = f"WITH {A.EDGES}"


@query("s9_block_records", f"{BLOCKS} SELECT CAST(count(*) AS INT) AS no_of_edges, CASE WHEN dataset_no % 2 = 0 THEN '11' ELSE '10' END AS recurrence_pattern, string_agg('(' || g1 || ' ' || g2 || ')', ' ' ORDER BY g1, g2) AS edges FROM edge GROUP BY dataset_no")
def block_records(spark: SparkSession, d: str) -> DataFrame:
    """A record for each dataset: the number of edges, a bit string, the edges."""
    own = A.edges(spark, d).groupBy("dataset_no").agg(F.array_sort(F.collect_list(F.struct("g1", "g2"))).alias("e"))
    bits = F.concat(F.lit("1"), (F.col("dataset_no") % 2 == 0).cast("int").cast("string"))
    body = F.array_join(F.transform("e", lambda x: F.format_string("(%d %d )", x["g1"], x["g2"])), "")
    path = put(own.select(F.concat(F.size("e").cast("string"), F.lit("\n"), bits, F.lit("\n"), body, F.lit("\n")).alias("value")), "blocks")
    shown = F.array_join(F.transform("edge_set", lambda x: F.format_string("(%d %d)", x["g1"], x["g2"])), " ")
    return formats.block_patterns(spark, path).select("no_of_edges", "recurrence_pattern", shown.alias("edges"))


def dense_file(spark: SparkSession, d: str) -> str:
    own = A.edges(spark, d).groupBy("dataset_no").agg(F.collect_list(F.struct("g1", "g2")).alias("e"))
    body = F.array_join(F.transform("e", lambda x: F.format_string("e %d %d", x["g1"], x["g2"])), "\n")
    return put(own.select(F.concat(F.lit("t # "), F.col("dataset_no").cast("string"), F.lit("\nsize\n"), body, F.lit("\n>")).alias("value")), "dense")


@query("s10_dense_graph_report", f"{BLOCKS} SELECT dataset_no AS graph, g1, g2 FROM edge WHERE dataset_no > 0")
def dense_graph_report(spark: SparkSession, d: str) -> DataFrame:
    return formats.dense_graph_report(spark, dense_file(spark, d))


@query("a35_vertices_of_reports", f"{BLOCKS} SELECT graph, count(*) AS vertices, CAST(sum(g) AS BIGINT) AS ids FROM (SELECT dataset_no AS graph, g1 AS g FROM edge UNION SELECT dataset_no, g2 FROM edge) WHERE graph > 0 GROUP BY graph")
def vertices_of_reports(spark: SparkSession, d: str) -> DataFrame:
    """The vertex set of each graph that a report lists by its edges."""
    e = formats.dense_graph_report(spark, dense_file(spark, d))
    v = e.select("graph", F.explode(F.array("g1", "g2")).alias("g")).distinct()
    return v.groupBy("graph").agg(F.count("*").alias("vertices"), F.sum("g").alias("ids"))


NEAR = f"{BLOCKS}, nr AS (SELECT dataset_no, g1, string_agg(g2, ' ' ORDER BY g2) AS v, count(*) AS n FROM edge GROUP BY dataset_no, g1)"


def near_lists(spark: SparkSession, d: str) -> DataFrame:
    return A.edges(spark, d).groupBy("dataset_no", "g1").agg(F.array_sort(F.collect_list("g2")).alias("v"))


@query("s10_flow_clusters", f"{NEAR} SELECT dataset_no AS splat_id, v AS vertex_set FROM nr WHERE n >= 3")
def flow_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of each graph, a line each; those of one or two vertices are left out."""
    own = near_lists(spark, d).groupBy("dataset_no").agg(F.array_join(F.collect_list(joined(F.col("v"), "\t")), "\n").alias("body"))
    path = put(own.select(F.concat(F.lit("(mclheader\n)\n(splat_id "), F.col("dataset_no").cast("string"), F.lit(" )\n"), "body", F.lit("\n")).alias("value")), "flow")
    return formats.flow_clusters(spark, path).select("splat_id", joined(F.col("vertex_set")).alias("vertex_set"))


@query("s10_complex_report", f"{BLOCKS} SELECT dataset_no AS splat_id, string_agg(g, ' ' ORDER BY g) AS vertex_set FROM (SELECT dataset_no, g1 AS g FROM edge UNION SELECT dataset_no, g2 FROM edge) WHERE dataset_no > 0 GROUP BY dataset_no")
def complex_report(spark: SparkSession, d: str) -> DataFrame:
    e = A.edges(spark, d).where("dataset_no > 0").groupBy("dataset_no").agg(F.array_join(F.collect_list(F.format_string("%d (pp) %d", "g1", "g2")), "\n").alias("body"))
    path = put(e.select(F.concat(F.lit("splat_id: "), F.col("dataset_no").cast("string"), F.lit("\n"), "body", F.lit("\n")).alias("value")), "complexes")
    return formats.complex_report(spark, path).select("splat_id", joined(F.col("vertex_set")).alias("vertex_set"))


@query("s11_cluster_table", f"{NEAR} SELECT CAST(g1 * 100 + dataset_no AS INT) AS cluster_id, CAST(3 * n AS INT) AS no_of_edges, round(6.0 * n / (n * (n - 1)), 6) AS connectivity, v AS vertex_set FROM nr WHERE n > 1")
def cluster_table(spark: SparkSession, d: str) -> DataFrame:
    own = near_lists(spark, d).where("size(v) > 1").withColumns({"id": F.col("g1") * 100 + F.col("dataset_no"), "n": F.size("v")})
    path = put(own.select(words("id", "n", (F.col("n") * 3).cast("string"), joined(F.col("v"), "\t"), F.lit("")).alias("value")), "clusters")
    return formats.cluster_table(spark, path).select("cluster_id", "no_of_edges", F.round("connectivity", 6).alias("connectivity"), joined(F.col("vertex_set")).alias("vertex_set"))


@query("s11_pattern_lines", f"{NEAR} SELECT v AS vertex_set, CAST(n AS INT) AS edges, round(n / 4.0, 6) AS first_recurrence FROM nr WHERE n >= 2")
def pattern_lines(spark: SparkSession, d: str) -> DataFrame:
    """Patterns with bracketed lists of vertices, edges and recurrences; vertices in falling order are sorted by the reader."""
    bracket = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    own = near_lists(spark, d).withColumn("n", F.size("v"))
    edges = F.array_join(F.transform("v", lambda x: F.format_string("[%d, %d]", x, F.col("g1"))), ", ")
    lines = own.select(words(bracket(joined(F.reverse("v"), ", ")), bracket(edges), bracket((F.col("n") / 4.0).cast("string"))).alias("value"))
    p = formats.pattern_lines(spark, put(lines, "patterns"), 2)
    return p.select(joined(F.col("vertex_set")).alias("vertex_set"), F.size("edge_set").alias("edges"), F.round(F.col("recurrence_array")[0], 6).alias("first_recurrence"))


@query("s13_site_report", "SELECT 'P' || l_orderkey AS prom_id, 'V$M_' || l_suppkey AS mt_id, CAST(l_linenumber AS INT) AS position, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, l_discount AS core, l_tax AS matrix, 'acGT' || l_linenumber AS site FROM lineitem")
def site_report(spark: SparkSession, d: str) -> DataFrame:
    li = A.table(spark, d, "lineitem")
    line = F.concat(F.lit(" V$M_"), F.col("l_suppkey").cast("string"), F.lit(" |  "), F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "R", " (-)").otherwise(" (+)"), F.lit(" | "), F.col("l_discount").cast("string"), F.lit(" | "), F.col("l_tax").cast("string"), F.lit(" | acGT"), F.col("l_linenumber").cast("string"))
    own = li.groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("body"))  # the lines of an order
    path = put(own.select(F.concat(F.lit("Inspecting sequence ID   P"), F.col("l_orderkey").cast("string"), F.lit("\n\n"), "body", F.lit("\n")).alias("value")), "sites")
    return formats.site_report(spark, path)


@query("s14_profile", "SELECT 'V$S_' || s_suppkey AS mt_id, round(s_acctbal / 1000, 3) AS core, round(s_acctbal / 2000, 3) AS matrix FROM supplier")
def profile(spark: SparkSession, d: str) -> DataFrame:
    s = A.table(spark, d, "supplier")
    lines = s.select(words(F.lit("1.000"), F.round(F.col("s_acctbal") / 1000, 3).cast("string"), F.round(F.col("s_acctbal") / 2000, 3).cast("string"), F.lit("AC0"), F.concat(F.lit("V$S_"), F.col("s_suppkey").cast("string")), by=" ").alias("value"))
    head = spark.createDataFrame([("profile of all matrices",), ("all.prf",), (" MIN_LENGTH 300",), ("0.0",)], "value string")
    return formats.profile(spark, put(head.unionByName(lines), "profile"))


@query("s15_interaction_entries", "WITH p AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS g FROM lineitem), s AS (SELECT s_suppkey AS g FROM supplier WHERE s_suppkey % 7 <> 0) SELECT 'e' || a.o % 50 AS experiment, a.g AS g1, b.g AS g2 FROM p a JOIN p b ON a.o = b.o AND a.g < b.g WHERE a.g IN (FROM s) AND b.g IN (FROM s) GROUP BY ALL")
def interaction_entries(spark: SparkSession, d: str) -> DataFrame:
    """An entry for each order, an interaction of its suppliers; every seventh supplier has two genes and is left out."""
    member = F.concat(F.lit("<participant><protein>P"), F.col("l_suppkey").cast("string"), F.lit("</protein></participant>"))
    own = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(member), "").alias("body"))
    o = F.col("l_orderkey")
    lines = own.select(F.concat(F.lit("<entry><interactionList><interaction id='i"), o.cast("string"), F.lit("'><experimentRef>e"), (o % 50).cast("string"), F.lit("</experimentRef><participantList>"), "body", F.lit("</participantList></interaction></interactionList></entry>")).alias("value"))
    s = A.table(spark, d, "supplier").select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("protein"), F.col("s_suppkey").alias("gene_no"))
    twice = s.where("gene_no % 7 = 0").withColumn("gene_no", F.col("gene_no") + 100_000)
    files = max(8, -(-A.table(spark, d, "lineitem").count() // LINES_A_FILE))  # a document is read by one task
    return formats.interactions(spark, put(writers.whole_documents(lines, "<entrySet>", "</entrySet>", files), "entries"), s.unionByName(twice))


@query("s16_term_blocks", f"WITH {A.TERMS} SELECT 'T:' || term AS id, 'term ' || term AS name, coalesce(string_agg('T:' || parent, ' ' ORDER BY parent), '') AS parents FROM tm LEFT JOIN t2t ON child = term GROUP BY term")
def term_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = A.term_edges(spark, d)
    terms = e.select(F.col("child").alias("term")).unionByName(e.select(F.col("parent").alias("term"))).distinct().join(e.withColumnRenamed("child", "term"), "term", "left")
    own = terms.groupBy("term").agg(F.array_sort(F.collect_list("parent")).alias("p"))
    t = F.col("term").cast("string")
    isa = F.array_join(F.transform("p", lambda x: F.concat(F.lit("is_a: T:"), x.cast("string"), F.lit(" ! a parent\n"))), "")
    path = put(own.select(F.concat(F.lit("[Term]\nid: T:"), t, F.lit("\nname: term "), t, F.lit("\n"), isa).alias("value")), "terms")
    return formats.ontology_terms(spark, path).select("id", "name", F.array_join("parents", " ").alias("parents"))


@query("s17_transcripts", "SELECT 'ENSG' || l_partkey AS gene_id, round(avg(l_linenumber), 6) AS isoforms FROM lineitem GROUP BY l_partkey")
def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Counts up to four are written as words."""
    spelt = F.element_at(F.array(*[F.lit(x) for x in (" One", "two ", "third", "four")]), F.least("l_linenumber", F.lit(4)).cast("int"))
    n = F.when(F.col("l_linenumber") <= 4, spelt).otherwise(F.col("l_linenumber").cast("string"))
    lines = A.table(spark, d, "lineitem").select(F.concat(F.lit("ENSG"), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit("|"), n, F.lit("|x")).alias("value"))
    return formats.transcript_table(spark, put(lines, "transcripts")).select("gene_id", F.round("isoforms", 6).alias("isoforms"))


@query("s18_interacting_genes", "SELECT DISTINCT g AS gene_no FROM (SELECT CAST(c_custkey AS INT) AS g FROM customer WHERE c_nationkey = 7 UNION ALL SELECT CAST(o_orderkey AS INT) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7)")
def interacting_genes(spark: SparkSession, d: str) -> DataFrame:
    """The genes of one tax id of an interaction table."""
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    lines = A.table(spark, d, "orders").join(c, "o_custkey", "right").select(words("c_nationkey", "o_custkey", F.coalesce(F.col("o_orderkey").cast("string"), F.lit("-")), F.lit("12345")).alias("value"))
    return formats.interacting_genes(spark, put(lines, "interacting"), 7)


@query("s19_incidence_matrix", f"WITH {A.EDGES}, g AS (SELECT g1 AS g, dataset_no FROM edge UNION SELECT g2, dataset_no FROM edge) SELECT 'b' || g AS gene_id, array_to_string(list_transform(range(1, 29), lambda i: list_contains(list(dataset_no), i)::INT), ' ') AS incidence FROM g GROUP BY g")
def incidence_matrix(spark: SparkSession, d: str) -> DataFrame:
    e = A.edges(spark, d).select("dataset_no", F.explode(F.array("g1", "g2")).alias("g")).distinct()
    own = e.groupBy("g").agg(F.collect_set("dataset_no").alias("s")).withColumn("v", F.transform(F.sequence(F.lit(1), F.lit(28)), lambda i: F.array_contains("s", i).cast("int")))
    lines = own.select(words(F.size("s").cast("string"), joined(F.col("v"), "\t"), F.concat(F.lit("b"), F.col("g").cast("string"))).alias("value"))
    return formats.incidence_matrix(spark, put(lines, "incidence")).select("gene_id", joined(F.col("incidence")).alias("incidence"))


FUNCTIONS = f"WITH {A.ASSOC}, f AS (SELECT go_no AS g, list(DISTINCT gene_no) AS genes FROM assoc GROUP BY go_no) SELECT 'F' || lpad(CAST(g AS VARCHAR), 4, '0') AS go_id, 'n' || g AS name, row_number() OVER (ORDER BY g) AS go_no, len(genes) AS genes, CAST(list_sum(genes) AS BIGINT) AS ids FROM f"


def functions_read(a: DataFrame) -> DataFrame:
    n = F.transform("genes", lambda g: F.substring(g, 2, 20).cast("long"))
    return a.select("go_id", "name", F.col("go_no").cast("long").alias("go_no"), F.size("genes").cast("long").alias("genes"), F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s + x).alias("ids"))


def function_rows(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("go_no").cast("string")
    return A.associations(spark, d).select(F.concat(F.lit("F"), F.lpad(g, 4, "0")).alias("go_id"), F.concat(F.lit("n"), g).alias("name"), F.concat(F.lit("g"), F.col("gene_no").cast("string")).alias("gene"))


@query("s20_function_lists", FUNCTIONS)
def function_lists(spark: SparkSession, d: str) -> DataFrame:
    lines = function_rows(spark, d).select(words("go_id", "name", "gene").alias("value"))
    return functions_read(formats.function_associations(spark, put(lines, "functions")))


@query("s20_joined_function_lists", FUNCTIONS)
def joined_function_lists(spark: SparkSession, d: str) -> DataFrame:
    """Genes joined by bars, several lines a function."""
    own = function_rows(spark, d).withColumn("b", F.pmod(F.xxhash64("gene"), F.lit(3))).groupBy("go_id", "name", "b").agg(F.array_join(F.collect_list("gene"), "|").alias("genes"))
    return functions_read(formats.function_associations(spark, put(own.select(words("go_id", "name", "genes").alias("value")), "functions"), True))


def term_file(spark: SparkSession, d: str) -> str:
    e = A.term_edges(spark, d)
    own = A.associations(spark, d).groupBy("go_no").agg(F.array_sort(F.collect_set(F.concat(F.lit("Y"), F.col("gene_no").cast("string")))).alias("genes"))
    up = e.groupBy(F.col("child").alias("go_no")).agg(F.array_sort(F.collect_list(F.concat(F.lit("T:"), F.col("parent").cast("string")))).alias("parents"))
    t = F.col("go_no").cast("string")
    whole = own.join(up, "go_no", "left").select(F.lit("P").alias("term_type"), F.concat(F.lit("T:"), t).alias("id"), F.concat(F.lit("term "), t).alias("name"), F.lit("process").alias("namespace"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), "genes")
    return put(writers.term_lines(whole), "flat-file")


@query("s21_term_records", f"WITH {A.ASSOC}, {A.TERMS}, u AS (SELECT child, count(*) AS n FROM t2t GROUP BY child) SELECT 'T:' || go_no AS id, 'term ' || go_no AS name, coalesce(u.n, 0) AS parents, CAST(count(DISTINCT gene_no) AS INT) AS no_of_genes, CAST(sum(DISTINCT gene_no) AS BIGINT) AS ids FROM assoc LEFT JOIN u ON child = go_no GROUP BY go_no, u.n")
def term_records(spark: SparkSession, d: str) -> DataFrame:
    r = formats.term_records(spark, term_file(spark, d))
    ids = F.aggregate(F.transform("genes", lambda g: F.substring(g, 2, 20).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return r.select("id", "name", F.size("parents").cast("long").alias("parents"), "no_of_genes", ids.alias("ids"))


@query("s21_known_functions", f"WITH {A.ASSOC} SELECT 'Y' || gene_no AS gene, string_agg(DISTINCT 'T:' || go_no, ' ' ORDER BY 'T:' || go_no) AS go_ids FROM assoc GROUP BY gene_no")
def known_functions(spark: SparkSession, d: str) -> DataFrame:
    return formats.known_functions(formats.term_records(spark, term_file(spark, d))).select("gene", F.array_join("go_ids", " ").alias("go_ids"))


@query("s22_cluster_genes", "SELECT 'Hs.' || l_suppkey AS unigene, count(DISTINCT l_partkey) AS genes, CAST(sum(DISTINCT l_partkey) AS BIGINT) AS ids FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY l_suppkey")
def cluster_genes(spark: SparkSession, d: str) -> DataFrame:
    species = F.when(F.col("l_suppkey") % 2 == 0, "Hs.").otherwise("Mm.")
    lines = A.table(spark, d, "lineitem").select(words("l_partkey", F.concat(species, F.col("l_suppkey").cast("string"))).alias("value"))
    c = formats.cluster_genes(spark, put(lines, "unigene"), "Hs.")
    return c.select("unigene", F.size("genes").cast("long").alias("genes"), F.aggregate("genes", F.lit(0).cast("long"), lambda s, x: s + x).alias("ids"))


@query("s23_mapped_expression", "SELECT p_name AS gene_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings JOIN part ON p_partkey = vec_id")
def mapped_expression(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "embeddings").select(words(F.concat(F.lit("Y"), F.col("vec_id").cast("string")), joined(F.transform("embedding", lambda x: x.cast("double")), "\t")).alias("value"))
    m = formats.expression_matrix(spark, put(e, "orf"), 1, 1).select("gene_id", "v")
    names = A.table(spark, d, "part").select(F.concat(F.lit("Y"), F.col("p_partkey").cast("string")).alias("gene_id"), F.col("p_name").alias("target"))
    out = formats.mapped_expression(m, names)
    return out.select("gene_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("s26_index_arrays", f"{HEAD} SELECT 'T:' || term AS go_id, string_agg(i, ' ' ORDER BY i) AS indexes FROM (SELECT term, array_to_string(path, ',') AS i FROM pth) GROUP BY term")
def index_arrays(spark: SparkSession, d: str) -> DataFrame:
    p = paths(spark, d).select(words(F.concat(F.lit("T:"), F.col("term").cast("string")), joined(F.col("path"), ",")).alias("value"))
    return formats.index_arrays(spark, put(p, "indexes")).select("go_id", F.array_join("indexes", " ").alias("indexes"))


@query("s26_cluster_statistics", f"WITH {A.PREDICTIONS} SELECT mcl_id, gene_no AS leave_one_out, 2 AS n, p_value, score FROM pred WHERE mcl_id < 250")
def cluster_statistics(spark: SparkSession, d: str) -> DataFrame:
    lines = A.predictions(spark, d).select(words("mcl_id", "gene_no", "p_value", "score").alias("value"))
    s = formats.cluster_statistics(spark, put(lines, "statistics"), 250)
    return s.select("mcl_id", "leave_one_out", F.size("p_values").alias("n"), F.col("p_values")[0].alias("p_value"), F.col("p_values")[1].alias("score"))


@query("s26_dataset_ids", "SELECT CAST(c_custkey AS INT) AS dataset_no, 'gds_' || c_nationkey || '_' || c_custkey AS dataset_id FROM customer")
def dataset_ids(spark: SparkSession, d: str) -> DataFrame:
    lines = A.table(spark, d, "customer").select(words(F.lit("gds"), "c_nationkey", "c_custkey", by="_").alias("value"))
    return formats.dataset_ids(spark, put(lines, "datasets")).select(F.col("dataset_no").cast("int").alias("dataset_no"), "dataset_id")


@query("s27_without_overhead", "SELECT c_custkey || ' ' || c_nationkey AS value FROM customer")
def without_overhead(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "customer")
    lines = c.select(words("c_custkey", "c_nationkey", by=" ").alias("value"))
    noise = c.select(F.explode(F.array(F.lit("cluster of"), F.lit("(a,b);"), F.lit("***"))).alias("value"))
    return formats.without_overhead(spark, put(lines.unionByName(noise), "overhead"))


@query("k8_list_lines", "SELECT '[' || c_custkey || ', ''' || replace(c_mktsegment, '''', '\\''') || ''', [' || c_nationkey || ', ' || c_custkey || ']],' AS value FROM customer")
def list_lines(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.array(F.col("c_nationkey").cast("long"), "c_custkey").alias("genes"))
    return spark.read.text(put(writers.list_lines(c), "lists"))


@query("k9_prediction_csv", f"WITH {A.PREDICTIONS} SELECT p_gene_id, gene_no, go_no, mcl_id, p_value, score, CAST(cluster_size AS INT) AS cluster_size, gene_no || ' ' || go_no AS genes FROM pred")
def prediction_csv(spark: SparkSession, d: str) -> DataFrame:
    p = A.predictions(spark, d).select("p_gene_id", "gene_no", "go_no", "mcl_id", "p_value", "score", F.col("cluster_size").cast("int").alias("cluster_size"), F.array(F.col("gene_no"), F.col("go_no").cast("long")).alias("genes"))
    path = new_path(spark, "csv")
    writers.write_predictions(p, path)
    kinds = ", ".join(f"{n} {'string' if n == 'genes' else k}" for n, k in p.dtypes)
    return spark.read.option("header", True).schema(kinds).csv(path)


@query("k10_cluster_lines", f"{NEAR} SELECT '(' || replace(v, ' ', ';') || ';)' || chr(9) || '{{' || (SELECT string_agg('(' || e.g1 || ',' || e.g2 || ' );', '' ORDER BY e.g2) FROM edge e WHERE e.dataset_no = nr.dataset_no AND e.g1 = nr.g1) || '}}' AS value FROM nr")
def cluster_lines(spark: SparkSession, d: str) -> DataFrame:
    own = near_lists(spark, d).select(F.col("v").alias("vertex_set"), F.transform("v", lambda x: F.struct(F.col("g1").alias("g1"), x.alias("g2"))).alias("edge_set"))
    return spark.read.text(put(writers.cluster_lines(own), "patterns"))


@query("k11_matrix_lines", f"{WEIGHTED}, x AS (SELECT g1 AS a, g2 AS b, weight FROM w UNION ALL SELECT g2, g1, weight FROM w) SELECT a || '  ' || string_agg(b || ':' || weight, ' ' ORDER BY b) || ' $' AS value FROM x GROUP BY a")
def matrix_lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.text(put(writers.matrix_lines(weighted_edges(spark, d)), "flow-input"))
