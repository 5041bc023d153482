"""Lines of the domain's text formats, one column ``value``; write them with ``.write.text(path)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_lines(edges: DataFrame) -> DataFrame:
    """``e``, g1, g2, weight, by tabs (K1)."""
    return edges.select(F.concat_ws("\t", F.lit("e"), F.col("g1").cast("string"), F.col("g2").cast("string"), F.col("weight").cast("string")).alias("value"))


def transaction_lines(vectors: DataFrame, with_length: bool = False) -> DataFrame:
    """The 1-based datasets in which an edge is significant, by tabs, or by blanks behind their number (K2)."""
    on = F.filter(F.sequence(F.lit(1), F.size("sig")), lambda i: F.element_at("sig", i) == 1)
    items = F.transform(on, lambda i: i.cast("string"))
    if with_length:
        return vectors.select(F.concat_ws(" ", F.size(on).cast("string"), F.array_join(items, " ")).alias("value"))
    return vectors.select(F.array_join(items, "\t").alias("value"))


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """``(v;v;)``, a tab, and ``{(a,b );(a,b );}`` of vertex_set and edge_set, whose edges have g1 and g2."""
    v = F.concat(F.lit("("), F.array_join(F.transform("vertex_set", lambda x: F.concat(x.cast("string"), F.lit(";"))), ""), F.lit(")"))
    e = F.array_join(F.transform("edge_set", lambda x: F.format_string("(%d,%d );", x["g1"], x["g2"])), "")
    return clusters.select(F.concat(v, F.lit("\t{"), e, F.lit("}")).alias("value"))


def list_lines(rows: DataFrame) -> DataFrame:
    """Every row as a bracketed list that other programs read: texts in quotes, arrays as inner lists, nulls as [] (K8)."""
    def one(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind.startswith("array"):
            shown = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))
        else:
            shown = F.concat(F.lit("'"), F.regexp_replace(c, "'", "\\\\'"), F.lit("'")) if kind == "string" else c.cast("string")
        return F.coalesce(shown, F.lit("[]"))

    return rows.select(F.concat(F.lit("["), F.concat_ws(", ", *[one(n, k) for n, k in rows.dtypes]), F.lit("],")).alias("value"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions as CSV with a head line in each part; arrays are joined by blanks (K9)."""
    flat = predictions.select(*[F.array_join(F.transform(n, lambda x: x.cast("string")), " ").alias(n) if k.startswith("array") else F.col(n) for n, k in predictions.dtypes])
    flat.write.option("header", True).csv(path)


def matrix_lines(edges: DataFrame) -> DataFrame:
    """Adjacency lines ``v  n1:w n2:w ... $`` of every vertex, the input of flow clustering."""
    both = edges.select(F.col("g1").alias("u"), F.col("g2").alias("v"), "weight").unionByName(edges.select(F.col("g2").alias("u"), F.col("g1").alias("v"), "weight"))
    rows = both.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("v", "weight"))).alias("n"))
    shown = F.array_join(F.transform("n", lambda x: F.concat(x["v"].cast("string"), F.lit(":"), x["weight"].cast("string"))), " ")
    return rows.select(F.concat(F.col("u").cast("string"), F.lit("  "), shown, F.lit(" $")).alias("value"))


def itemset_lines(clusters: DataFrame) -> DataFrame:
    """Sorted vertex sets, one a line, by blanks: the input of frequent itemset programs."""
    return clusters.select(F.array_join(F.transform(F.array_sort("vertex_set"), lambda x: x.cast("string")), " ").alias("value"))


def term_lines(terms: DataFrame) -> DataFrame:
    """Records of a flat file of terms, of term_type, id, name, namespace, parents and genes (S21); each ends in a blank line."""
    parents = F.array_join(F.transform("parents", lambda p: F.concat(F.lit("is_a: "), p, F.lit("\n"))), "")
    genes = F.concat(F.size("genes").cast("string"), F.lit(";"), F.array_join("genes", ";"))
    head = F.concat(F.lit("TERMTYPE:["), "term_type", F.lit("]\nid: "), "id", F.lit("\nname: "), "name", F.lit("\nnamespace: "), "namespace", F.lit("\n"))
    return terms.select(F.concat(head, parents, genes, F.lit("\n")).alias("value"))


def whole_documents(lines: DataFrame, head: str, foot: str, files: int = 8) -> DataFrame:
    """The lines in ``files`` partitions, each between a head and a foot, so that every file written is a document."""
    place = lines.select(F.pmod(F.xxhash64("value"), F.lit(files)).cast("int").alias("p"), F.lit(1).alias("o"), "value")
    ends = lines.sparkSession.range(files).select(F.col("id").cast("int").alias("p"), F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit(head).alias("value")), F.struct(F.lit(2).alias("o"), F.lit(foot).alias("value")))).alias("e"))
    return place.unionByName(ends.select("p", "e.o", "e.value")).repartitionById(files, "p").sortWithinPartitions("o").select("value")
