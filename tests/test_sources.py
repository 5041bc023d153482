"""Readers and writers of text formats, on small files of invented records."""

import pytest

from netweft.sources import formats, writers


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    return write


def rows(df):
    plain = lambda v: [plain(x) for x in v] if isinstance(v, (list, tuple)) else v
    return sorted([plain(list(r)) for r in df.collect()], key=str)


def test_cluster_formats(spark, put):
    c = formats.cluster_table(spark, put("c", "7\t3\t2\t11\t12\t13\t\n"))
    assert rows(c) == [[7, 2, 2 / 3, [11, 12, 13]]]
    p = formats.pattern_lines(spark, put("p", "[3, 1, 2]\t[[3, 1], [2, 1]]\t[0.5, 1]\n[1, 2]\t[[1, 2]]\n"), 3)
    assert rows(p) == [[[1, 2, 3], [[1, 2], [1, 3]], [0.5, 1.0], None]]
    d = formats.pattern_lines(spark, put("d", "[2, 1]\t[[2, 1]]\t[1]\t[[0, 1], [1, 0]]\n"), ordered=False)
    assert rows(d) == [[[2, 1], [[2, 1]], [1.0], [[0, 1], [1, 0]]]]
    k = formats.dense_graph_report(spark, put("k", "head\nt # 3\nv 0 x\ne 1 2 1\ne 2 5 1\n>\nt # 4\ne 8 9 1\n>\n"))
    assert rows(k) == [[3, 1, 2], [3, 2, 5], [4, 8, 9]]
    f = formats.flow_clusters(spark, put("f", "(splat_id 4 )\n1\t2\t3\n5\t6\n\n(splat_id 6 )\n7\t8\t9\t10\n\n"))
    assert rows(f) == [[4, [1, 2, 3]], [6, [7, 8, 9, 10]]]
    m = formats.complex_report(spark, put("m", "pattern 12\n3 1 2\n4\n\npattern 13\n9\n"))
    assert rows(m) == [[12, [1, 2, 3, 4]], [13, [9]]]


def test_annotation_formats(spark, put):
    assert rows(formats.profile(spark, put("p", "a profile\nset\n\nMIN_LENGTH 300\n0.0\n 1.000 0.75 0.85 M001 V$XX_01\n//\n"))) == [["V$XX_01", 0.75, 0.85]]
    t = formats.ontology_terms(spark, put("t", "format: 1\n\n[Term]\nid: X:1\nname: root\n\n[Term]\nid: X:2\nname: leaf\nis_a: X:1 ! root\n"))
    assert rows(t) == [["X:1", "root", []], ["X:2", "leaf", ["X:1"]]]
    assert rows(formats.transcript_table(spark, put("l", "G1.2|Two|x\nG1.3|4\nG2|first\nG3|many\n"))) == [["G1", 3.0], ["G2", 1.0], ["G3", None]]
    assert rows(formats.interacting_genes(spark, put("i", "9606\t5\t7\n9606\t5\t-\n10090\t1\t2\n"), 9606)) == [[5], [7]]
    assert rows(formats.incidence_matrix(spark, put("g", "2 1 0 1 geneA\n"))) == [["geneA", [1, 0, 1]]]
    one = formats.function_associations(spark, put("a", "F2\tb\tg3\tg1\t\nF1\ta\tg2\n"))
    two = formats.function_associations(spark, put("b", "F2\tb\tg3\nF1\ta\tg2\nF2\tb\tg1|g3\n"), joined=True)
    assert rows(one) == rows(two) == [["F1", "a", 1, ["g2"]], ["F2", "b", 2, ["g1", "g3"]]]
    assert rows(formats.cluster_genes(spark, put("u", "5 Hs.1\n3 Hs.1\n4 Mm.1\n"), "Hs.")) == [["Hs.1", [3, 5]]]
    assert rows(formats.dataset_ids(spark, put("n", "set_12\nset_3\n"))) == [[12, "set_12"], [3, "set_3"]]
    x = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "gene_id string, v double")
    assert rows(formats.mapped_expression(x, spark.createDataFrame([("a", "A")], "gene_id string, target string"))) == [[1.0, "A"]]


def test_interaction_entries(spark, put):
    person = lambda p: f"<participant><protein>{p}</protein></participant>"
    entry = f"<set><entry><interactionList><interaction id='i1'><experimentRef>e1</experimentRef><participantList>{person('P1')}{person('P2')}{person('P3')}</participantList></interaction><interaction id='i2'><experimentRef>e2</experimentRef><participantList>{person('P2')}{person('P4')}</participantList></interaction></interactionList></entry></set>"
    gene_of = spark.createDataFrame([("P1", 5), ("P2", 3), ("P3", 8), ("P3", 9), ("P4", 1)], "protein string, gene_no int")
    assert rows(formats.interactions(spark, put("x.xml", entry), gene_of)) == [["e1", 3, 5], ["e2", 1, 3]]


def test_writers(spark, tmp_path):
    c = spark.createDataFrame([([2, 1], [(1, 2)])], "vertex_set array<int>, edge_set array<struct<a: int, b: int>>")
    named = c.selectExpr("vertex_set", "transform(edge_set, e -> named_struct('g1', e.a, 'g2', e.b)) AS edge_set")
    assert rows(writers.itemset_lines(c)) == [["1 2"]]
    assert rows(writers.cluster_lines(named)) == [["(2;1;)\t{(1,2 );}"]]
    e = spark.createDataFrame([(1, 2, 0.5), (1, 3, 1.0)], "g1 int, g2 int, weight double")
    assert rows(writers.matrix_lines(e)) == [["1  2:0.5 3:1.0 $"], ["2  1:0.5 $"], ["3  1:1.0 $"]]
    p = spark.createDataFrame([(1, "it's", [1, 2], None)], "id int, name string, genes array<int>, p double")
    assert rows(writers.list_lines(p)) == [["[1, 'it\\'s', [1, 2], []],"]]
    writers.write_predictions(p, f"file://{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/csv").collect()
    assert [tuple(r) for r in back] == [("1", "it's", "1 2", None)]


FLAT = """def: opens a record
is_a: T:9
TERMTYPE:[P]
id: T:1
name: first
 and more of it
alt_id: T:01
alt_id: T:02
namespace: process
comment: none
is_a: T:0
2;Y1;Y2

TERMTYPE:[P]
id: T:2
name: second
namespace: process
1;Y2
TERMTYPE:[F]
id: T:3
name: without genes
namespace: function
0;

TERMTYPE:[P]
id: T:4
name: without a data line
namespace: process

TERMTYPE:[P]
name: without an id
namespace: process
1;Y9

id: T:5
name: without a type
namespace: process
1;Y8


TERMTYPE:[P]
id: T:6
name: last
namespace: process
3;Y1; Y3 ;
"""


def test_term_records(spark, put):
    got = {r["id"]: r for r in formats.term_records(spark, put("terms", FLAT)).collect()}
    assert set(got) == {"T:1", "T:2", "T:3", "T:6"}
    first = got["T:1"]
    assert (first["term_type"], first["name"], first["namespace"], first["no_of_genes"]) == ("P", "first and more of it", "process", 2)
    assert first["alt_ids"] == ["T:01", "T:02"] and first["parents"] == ["T:9", "T:0"] and first["genes"] == ["Y1", "Y2"]
    assert got["T:3"]["genes"] == [] and got["T:3"]["term_type"] == "F" and got["T:6"]["genes"] == ["Y1", "Y3"]
    known = {r["gene"]: r["go_ids"] for r in formats.known_functions(formats.term_records(spark, put("terms", FLAT))).collect()}
    assert known == {"Y1": ["T:1", "T:6"], "Y2": ["T:1", "T:2"], "Y3": ["T:6"]}
    assert formats.term_records(spark, put("nothing", "")).count() == 0


def test_small_loaders(spark, put):
    assert rows(formats.index_arrays(spark, put("ix", "T:1\t1,2\nT:1\t1,1\n\nT:2\t1\n"))) == [["T:1", ["1,1", "1,2"]], ["T:2", ["1"]]]
    s = formats.cluster_statistics(spark, put("cs", "1\t5\t0.5\tNA\nx\t1\t2\n7\t6\n9\t1\t1\n"), 9)
    assert rows(s) == [[1, 5, [0.5, None]], [7, 6, []]]
    m = formats.adjacency_matrix(spark, put("am", "0 0 5 1\n1 5 0 7\n2 1 7 0\n"), 5)
    assert rows(m) == [[0, 1, 5.0], [1, 2, 7.0]]


def test_term_lines_are_read_back(spark, put, tmp_path):
    rec = formats.term_records(spark, put("terms", FLAT)).where("id <> 'T:3'")
    path = f"file://{tmp_path}/flat"
    writers.term_lines(rec).write.text(path)
    cols = ["term_type", "id", "name", "namespace", "parents", "genes"]
    assert sorted(map(tuple, formats.term_records(spark, path).select(*cols).collect())) == sorted(map(tuple, rec.select(*cols).collect()))


ROUND_TRIPS = ["s1_expression_matrix", "s3_matrix_scan", "s9_block_records", "s13_site_report", "s15_interaction_entries", "s21_term_records", "k10_cluster_lines"]


@pytest.mark.parametrize("name", ROUND_TRIPS)
def test_round_trip_query_matches_sql(spark, sf, name):
    from tests.test_library import test_query_matches_sql

    test_query_matches_sql(spark, sf, name)
