"""Text formats of the domain, read as DataFrames; every file is split and parsed by the tasks that read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _words(between: str = r"[ \t\r]+") -> Column:
    return F.split(F.trim("value"), between)


def _rest(words: Column, start: int, kind: str) -> Column:
    """Words from position ``start`` on as numbers; NA and what isn't a number are null."""
    return F.transform(F.slice(words, start, F.greatest(F.size(words) - start + 1, F.lit(0))), lambda x: F.nullif(x, F.lit("NA")).try_cast(kind))


def expression_matrix(spark: SparkSession, path: str, dataset_no: int, min_valid: int = 8) -> DataFrame:
    """dataset_no, gene_id, v of genes with at least ``min_valid`` values."""
    w = spark.read.text(path).select(_words().alias("w"))
    v = w.select(F.lit(dataset_no).alias("dataset_no"), F.col("w")[0].alias("gene_id"), _rest(F.col("w"), 2, "double").alias("v"))
    return v.where(F.size(F.filter("v", lambda x: x.isNotNull())) >= min_valid)


def graph_edges(spark: SparkSession, path: str, min_weight: float | None = None) -> DataFrame:
    """g1, g2, weight of the lines ``e g1 g2 weight``, those of ``min_weight`` at least."""
    w = spark.read.text(path).select(_words().alias("w")).where("w[0] = 'e' AND size(w) >= 4")
    e = w.select(F.col("w")[1].cast("int").alias("g1"), F.col("w")[2].cast("int").alias("g2"), F.col("w")[3].cast("double").alias("weight"))
    return e if min_weight is None else e.where(F.col("weight") >= min_weight)


def adjacency_matrix(spark: SparkSession, path: str, min_weight: float) -> DataFrame:
    """g1 < g2 (row and column from 0), weight of the upper half of a matrix of ``min_weight`` at least; a line is the row's number
    and its values (S3)."""
    w = spark.read.text(path).select(_words().alias("w")).where("size(w) >= 2")
    cell = w.select(F.col("w")[0].cast("int").alias("g1"), F.posexplode(_rest(F.col("w"), 2, "double")).alias("g2", "weight"))
    return cell.where((F.col("g1") < F.col("g2")) & (F.col("weight") >= min_weight))


def edge_vectors(spark: SparkSession, path: str, min_support: int = 0, max_support: int = 200) -> DataFrame:
    """g1 <= g2 and the 0/1 vector of the lines ``g1 g2 0 1 ...`` with a sum inside the window."""
    w = spark.read.text(path).select(_words().alias("w")).where("size(w) >= 3")
    a, b = F.col("w")[0].cast("int"), F.col("w")[1].cast("int")
    v = w.select(F.least(a, b).alias("g1"), F.greatest(a, b).alias("g2"), _rest(F.col("w"), 3, "int").alias("sig"))
    return v.where(F.aggregate("sig", F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))).between(min_support, max_support))


def itemsets(spark: SparkSession, path: str, min_length: int = 1) -> DataFrame:
    """signature, freq of the lines ``1 4 5 (3)`` with ``min_length`` items at least."""
    n = spark.read.text(path).select(F.transform(F.regexp_extract_all("value", F.lit(r"(\d+)"), 1), lambda x: x.cast("int")).alias("n")).where("size(n) >= 2")
    return n.select(F.slice("n", 1, F.size("n") - 1).alias("signature"), F.element_at("n", -1).alias("freq")).where(F.size("signature") >= min_length)


def block_patterns(spark: SparkSession, path: str) -> DataFrame:
    """no_of_edges, recurrence_pattern, edge_set of records parted by blank lines: a count, a bit string, edges ``(a b)``."""
    r = spark.read.option("lineSep", "\n\n").text(path).where(F.length(F.trim("value")) > 0)
    pairs = F.regexp_extract_all("value", F.lit(r"(\(\d+ +\d+ *\))"), 1)
    number = lambda x, i: F.regexp_extract(x, r"\((\d+) +(\d+)", i).cast("int")
    words = F.regexp_extract_all(F.regexp_replace("value", r"\([^)]*\)", " "), F.lit(r"(\d+)"), 1)
    return r.select(
        words[0].cast("int").alias("no_of_edges"), F.try_element_at(words, F.lit(2)).alias("recurrence_pattern"),
        F.transform(pairs, lambda x: F.struct(number(x, 1).alias("g1"), number(x, 2).alias("g2"))).alias("edge_set"),
    )


def site_report(spark: SparkSession, path: str) -> DataFrame:
    """prom_id, mt_id, position, strand, core, matrix, site of a report of binding sites.

    A record begins at the word Inspecting, so that no state is carried from line to line between tasks.
    """
    r = spark.read.option("lineSep", "Inspecting ").text(path).select(F.split("value", r"\r?\n").alias("l"))
    prom = F.regexp_extract(F.col("l")[0], r"(\S+)\s*$", 1)
    line = r.select(prom.alias("prom_id"), F.explode("l").alias("line")).select("prom_id", F.split("line", r"\|").alias("p")).where("size(p) = 5")
    field = lambda i: F.trim(F.col("p")[i])
    return line.select(
        "prom_id", field(0).alias("mt_id"), F.regexp_extract(field(1), r"^(\d+)", 1).cast("int").alias("position"), F.regexp_extract(field(1), r"\(([+-])\)", 1).alias("strand"),
        field(2).cast("double").alias("core"), field(3).cast("double").alias("matrix"), field(4).alias("site"),
    )


def without_overhead(spark: SparkSession, path: str) -> DataFrame:
    """Lines that don't begin with c, ( or *."""
    return spark.read.text(path).where(~F.col("value").rlike(r"^[c(*]"))


def cluster_table(spark: SparkSession, path: str) -> DataFrame:
    """cluster_id, no_of_edges, connectivity, vertex_set of tab-separated lines ``id nodes edges v1 v2 ...``."""
    w = spark.read.text(path).select(F.split("value", "\t").alias("w")).where("size(w) > 3")
    n, e = F.col("w")[1].cast("int"), F.col("w")[2].cast("int")
    vertices = F.transform(F.filter(F.slice("w", 4, F.size("w")), lambda x: x != ""), lambda x: x.cast("int"))
    return w.select(F.col("w")[0].cast("int").alias("cluster_id"), e.alias("no_of_edges"), (2.0 * e / (n * (n - 1))).alias("connectivity"), vertices.alias("vertex_set"))


def pattern_lines(spark: SparkSession, path: str, min_size: int = 1, ordered: bool = True) -> DataFrame:
    """vertex_set, edge_set, recurrence_array, d_matrix (each null where its column is missing) of lines with bracketed lists by
    tabs, of patterns with ``min_size`` vertices at least (S11: itemset patterns, with or without distances; S12)."""
    w = spark.read.text(path).select(F.split("value", "\t").alias("w"))
    read = lambda i, kind: F.from_json(F.try_element_at("w", F.lit(i)), kind)
    out = w.select(read(1, "array<int>").alias("vertex_set"), read(2, "array<array<int>>").alias("edge_set"), read(3, "array<double>").alias("recurrence_array"), read(4, "array<array<int>>").alias("d_matrix"))
    out = out.where(F.size("vertex_set") >= min_size)
    if ordered:
        out = out.withColumns({"vertex_set": F.array_sort("vertex_set"), "edge_set": F.array_sort(F.transform("edge_set", lambda e: F.array_sort(e)))})
    return out


def dense_graph_report(spark: SparkSession, path: str) -> DataFrame:
    """graph, g1, g2: edge lines of each block ``t # graph ... >`` of a report on maximal dense graphs (S10); its vertex set is
    that of its edges (A35)."""
    r = spark.read.option("lineSep", ">\n").text(path).where(F.col("value").rlike(r"(?m)^t"))
    block = r.select(F.regexp_extract("value", r"(?m)^t\D*(\d+)", 1).cast("int").alias("graph"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^(e\s+\d+\s+\d+)"), 1)).alias("e"))
    w = F.split("e", r"\s+")
    return block.select("graph", w[1].cast("int").alias("g1"), w[2].cast("int").alias("g2"))


def flow_clusters(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """splat_id, vertex_set of a report of flow clustering: after a line ``(splat_id n )`` every line of tab-separated vertices is
    a cluster; those with fewer than ``least`` vertices are left out (S10)."""
    r = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").contains("(splat_id"))
    head = F.regexp_extract("value", r"\(splat_id\s+(\d+)", 1).cast("int")
    body = F.regexp_replace("value", r"(?s)^.*?\(splat_id[^\n]*\n?", "")
    line = r.select(head.alias("splat_id"), F.explode(F.split(body, "\n")).alias("line")).where("line <> '' AND line NOT LIKE '(%'")
    return line.select("splat_id", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("int")).alias("vertex_set")).where(F.size("vertex_set") >= least)


def complex_report(spark: SparkSession, path: str) -> DataFrame:
    """splat_id, vertex_set of blocks parted by blank lines whose first line has the id and whose others list vertices."""
    r = spark.read.option("lineSep", "\n\n").text(path).where(F.length(F.trim("value")) > 0).select(F.split(F.trim("value"), "\n", 2).alias("l")).where("size(l) = 2")
    numbers = F.transform(F.regexp_extract_all(F.col("l")[1], F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))
    return r.select(F.regexp_extract(F.col("l")[0], r"(\d+)", 1).cast("int").alias("splat_id"), F.array_sort(F.array_distinct(numbers)).alias("vertex_set"))


def profile(spark: SparkSession, path: str) -> DataFrame:
    """mt_id, core, matrix: cut-offs of the lines of five words of a matrix profile; its head has fewer or more."""
    w = spark.read.text(path).select(_words().alias("w")).where("size(w) = 5")
    number = lambda i: F.col("w")[i].try_cast("double")
    return w.select(F.col("w")[4].alias("mt_id"), number(1).alias("core"), number(2).alias("matrix")).where("core IS NOT NULL AND matrix IS NOT NULL")


def interactions(spark: SparkSession, path: str, gene_of: DataFrame) -> DataFrame:
    """experiment, g1 < g2: pairs of participants of each interaction of an XML file of entries.

    ``gene_of``: protein, gene_no; a protein with several genes is left out. An interaction has at most some dozen
    participants, so its pairs are few.
    """
    schema = "interactionList struct<interaction: array<struct<_id: string, experimentRef: string, participantList: struct<participant: array<struct<protein: string>>>>>>"
    entry = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    each = entry.select(F.explode("interactionList.interaction").alias("i")).select(F.col("i._id").alias("id"), F.col("i.experimentRef").alias("experiment"), F.explode("i.participantList.participant.protein").alias("protein"))
    single = gene_of.groupBy("protein").agg(F.min("gene_no").alias("gene_no"), F.countDistinct("gene_no").alias("n")).where("n = 1").drop("n")
    own = each.join(single, "protein").select("id", "experiment", "gene_no").distinct()
    pairs = own.withColumnRenamed("gene_no", "g1").join(own.withColumnRenamed("gene_no", "g2"), ["id", "experiment"]).where("g1 < g2")
    return pairs.select("experiment", "g1", "g2").distinct()


def ontology_terms(spark: SparkSession, path: str) -> DataFrame:
    """id, name, parents of the ``[Term]`` blocks of an OBO file."""
    r = spark.read.option("lineSep", "[Term]").text(path).where(F.col("value").rlike(r"(?m)^id:"))
    one = lambda tag: F.trim(F.regexp_extract("value", rf"(?m)^{tag}:\s*([^\n!]+)", 1))
    return r.select(one("id").alias("id"), one("name").alias("name"), F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^is_a:\s*(\S+)"), 1), lambda x: x).alias("parents"))


# Numbers that a text spells out.
NUMBERS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten".split(), 1)} | {w: i for i, w in enumerate("first second third fourth".split(), 1)}


def transcript_table(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, isoforms of lines ``id.version|count|...``: versions go, counts may be words, several lines of a gene give their
    mean (S17)."""
    w = spark.read.text(path).select(F.split("value", r"\|").alias("w")).where("size(w) >= 2")
    said = F.lower(F.trim(F.col("w")[1]))
    spelt = F.try_element_at(F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv]), said)
    each = w.select(F.substring_index(F.trim(F.col("w")[0]), ".", 1).alias("gene_id"), F.coalesce(spelt, said.try_cast("int")).alias("n"))
    return each.groupBy("gene_id").agg(F.avg("n").alias("isoforms"))


def interacting_genes(spark: SparkSession, path: str, tax_id: int, columns: tuple[int, int] = (1, 2)) -> DataFrame:
    """gene_no: all genes that a tab-separated interaction table names in its two columns for a tax id in its first."""
    w = spark.read.text(path).select(F.split("value", "\t").alias("w")).where(F.col("w")[0].try_cast("int") == tax_id)
    one = [w.select(F.col("w")[i].try_cast("int").alias("gene_no")) for i in columns]
    return one[0].unionByName(one[1]).where("gene_no IS NOT NULL").distinct()


def incidence_matrix(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, incidence: lines ``count v1 ... vn gene_id``."""
    w = spark.read.text(path).select(_words().alias("w")).where("size(w) >= 3")
    return w.select(F.element_at("w", -1).alias("gene_id"), F.transform(F.slice("w", 2, F.size("w") - 2), lambda x: x.try_cast("int")).alias("incidence"))


def function_associations(spark: SparkSession, path: str, joined: bool = False) -> DataFrame:
    """go_id, name, go_no, genes of lines ``go_id name gene ...``, or with genes joined by bars in the third column and several
    lines a function; functions are numbered from 1 in the order of their ids (S20)."""
    from netweft.operators.ranking import numbered

    w = spark.read.text(path).select(F.split("value", "\t").alias("w")).where("size(w) >= 3")
    genes = F.split(F.col("w")[2], r"\|") if joined else F.slice("w", 3, F.size("w"))
    each = w.select(F.col("w")[0].alias("go_id"), F.col("w")[1].alias("name"), F.explode(genes).alias("gene")).where("gene <> ''")
    own = each.groupBy("go_id").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("gene")).alias("genes"))
    return numbered(own, ["go_id"], "go_no").select("go_id", "name", "go_no", "genes")


def cluster_genes(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """unigene, genes of lines ``gene unigene`` whose unigene id begins with a species prefix."""
    w = spark.read.text(path).select(_words().alias("w")).where(F.col("w")[1].startswith(prefix))
    return w.groupBy(F.col("w")[1].alias("unigene")).agg(F.array_sort(F.collect_set(F.col("w")[0].try_cast("long"))).alias("genes"))


def mapped_expression(expression: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of an expression table under other ids: ``mapping`` has gene_id and target; ids without one are left out."""
    return expression.join(mapping, "gene_id").drop("gene_id").withColumnRenamed("target", "gene_id")


def dataset_ids(spark: SparkSession, path: str) -> DataFrame:
    """dataset_no, dataset_id: file names numbered by the digits at their end."""
    from netweft.functions.text import trailing_number

    return spark.read.text(path).where("value <> ''").select(trailing_number(F.trim("value")).alias("dataset_no"), F.trim("value").alias("dataset_id"))


def index_arrays(spark: SparkSession, path: str) -> DataFrame:
    """go_id, indexes: all index strings of a term, sorted, of tab-separated lines ``term index``."""
    w = spark.read.text(path).select(F.split("value", "\t").alias("w")).where("size(w) >= 2 AND w[0] <> ''")
    return w.groupBy(F.col("w")[0].alias("go_id")).agg(F.array_sort(F.collect_set(F.trim(F.col("w")[1]))).alias("indexes"))


def cluster_statistics(spark: SparkSession, path: str, limit_id: int | None = None) -> DataFrame:
    """mcl_id, leave_one_out, p_values of tab-separated lines ``mcl_id gene p1 p2 ...``; of clusters below ``limit_id``."""
    w = spark.read.text(path).select(F.split("value", "\t").alias("w")).where("size(w) >= 2")
    out = w.select(F.col("w")[0].try_cast("long").alias("mcl_id"), F.col("w")[1].try_cast("long").alias("leave_one_out"), _rest(F.col("w"), 3, "double").alias("p_values")).where("mcl_id IS NOT NULL")
    return out if limit_id is None else out.where(F.col("mcl_id") < limit_id)


#: The heads of a record's lines.
TERM_TYPE, TERM_HEADS = "TERMTYPE:[", ("id:", "name:", "alt_id:", "namespace:", "def:", "comment:", "is_a:")


def term_records(spark: SparkSession, path: str) -> DataFrame:
    """term_type, id, name, alt_ids, namespace, parents, no_of_genes, genes of a flat file of terms.

    A record is some lines ``def:`` and ``is_a:``, a line ``TERMTYPE:[...]``, ``id:``, ``name:`` and ``namespace:`` lines with
    other heads among them, and a line ``n;gene;gene...``. Blank lines may follow, none stand inside, so that tasks split the
    file at them; records without one between them are parted behind the data line, which alone begins with digits and a
    semicolon. A line that has no head continues the line before. Records without a type, an id or a data line are left out;
    so is what follows the last data line. Lines end in a newline.
    """
    r = spark.read.option("lineSep", "\n\n").text(path)
    ended = F.regexp_replace(F.concat(F.lit("\n"), "value", F.lit("\n")), r"(?m)^(\d+;[^\n]*)\n", "$1\n\u0001")
    record = r.select(F.explode(F.split(ended, "\u0001")).alias("t"))
    heads = "|".join([*(h.replace(":", "") for h in TERM_HEADS), "TERMTYPE"])
    joined = F.regexp_replace("t", rf"\n+[ \t]*+(?!(?:{heads}):|\d+;)(?=\S)", " ").alias("t")
    record = record.select(joined)
    every = lambda head: F.transform(F.regexp_extract_all("t", F.lit(rf"(?m)^{head}[ \t]*([^\n]*?)[ \t]*$"), 1), lambda x: x)
    one = lambda head: F.try_element_at(every(head), F.lit(1))
    kind = F.try_element_at(F.regexp_extract_all("t", F.lit(r"(?m)^TERMTYPE:\[([^\]\n]*)\]"), 1), F.lit(1))
    data = F.try_element_at(F.regexp_extract_all("t", F.lit(r"(?m)^(\d+;[^\n]*)$"), 1), F.lit(1))
    parts = F.split(data, ";")
    genes = F.filter(F.slice(parts, 2, F.size(parts) - 1), lambda g: F.trim(g) != "")
    return record.select(
        kind.alias("term_type"), one("id:").alias("id"), one("name:").alias("name"), every("alt_id:").alias("alt_ids"), one("namespace:").alias("namespace"), every("is_a:").alias("parents"),
        parts[0].cast("int").alias("no_of_genes"), F.transform(genes, lambda g: F.trim(g)).alias("genes"),
    ).where("term_type IS NOT NULL AND id IS NOT NULL AND genes IS NOT NULL")


def known_functions(records: DataFrame) -> DataFrame:
    """gene, go_ids (sorted): what ``term_records`` says of each gene."""
    return records.select("id", F.explode("genes").alias("gene")).groupBy("gene").agg(F.array_sort(F.collect_set("id")).alias("go_ids"))
