"""Cuts, closed itemsets, models and text formats."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from netweft.operators import kernels, models
from netweft.plans import catalogue
from netweft.sources import formats, writers

#: Two 5-cliques joined by the edge (5, 11).
BRIDGED = [*combinations(range(1, 6), 2), *combinations(range(11, 16), 2), (5, 11)]
HALVES = [[1, 2, 3, 4, 5], [11, 12, 13, 14, 15]]


def test_edge_betweenness_of_a_path():
    assert kernels.edge_betweenness([(1, 2), (2, 3), (3, 4)]) == {(1, 2): 3.0, (2, 3): 4.0, (3, 4): 3.0}


@pytest.mark.parametrize("cut", [lambda e: kernels.betweenness_cut(e, "p", 0.9), lambda e: kernels.normalized_cut(e, "p", 6)])
def test_cut_at_the_bridge(spark, cut):
    rows = [(1, a, b) for a, b in BRIDGED] + [(1, 2, 1), (1, 3, 3), (1, None, 4)]
    got = cut(spark.createDataFrame(rows, "p int, g1 int, g2 int")).collect()
    assert sorted((r.part, r.vertex_set, r.edges) for r in got) == [(0, HALVES[0], 10), (1, HALVES[1], 10)]
    assert cut(spark.createDataFrame([], "p int, g1 int, g2 int")).count() == 0


def test_closed_itemsets(spark):
    rows = [["a", "b", "c"], ["a", "b"], ["a", "b", "d"], ["c"], ["c", "d"]]
    got = kernels.closed_itemsets(spark.createDataFrame([(r,) for r in rows], "x array<string>"), "x", 0.2).collect()
    want = set()
    for n in range(1, 5):
        for s in combinations("abcd", n):
            having = [set(r) for r in rows if set(s) <= set(r)]
            if having and set.intersection(*having) == set(s):
                want.add((s, len(having)))
    assert {(tuple(r["items"]), r["freq"]) for r in got} == want


def test_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = 2 + x @ [1.5, -0.5] + rng.normal(size=60) / 10
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    got = {r.term: r.coefficient for r in models.least_squares(df, ["a", "b"], "y").collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(60), x]), y, rcond=None)[0]
    assert np.allclose([got["intercept"], got["a"], got["b"]], want, atol=1e-8)
    fitted = {r.term: (r.coefficient, r.p_value) for r in models.generalised(df, ["a", "b"], "y", "gaussian").collect()}
    assert np.allclose([fitted["intercept"][0], fitted["a"][0], fitted["b"][0]], want, atol=1e-6) and fitted["a"][1] < 1e-6
    assert models.generalised(df.limit(20), ["a", "b"], "y", "gaussian").count() == 0


def test_formats(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    m = formats.expression_matrix(spark, put("m", "g1\t1\t2\tNA\t4\ng2 1 NA NA NA\n"), 3, 2).collect()
    assert [(r.dataset_no, r.gene_id, r.v) for r in m] == [(3, "g1", [1.0, 2.0, None, 4.0])]
    e = formats.graph_edges(spark, put("e", "t # 0\nv 1 a\ne 1 2 0.5\ne 2 3 0.9\n"), 0.6)
    assert [tuple(r) for r in e.collect()] == [(2, 3, 0.9)]
    assert [r.value for r in writers.edge_lines(e).collect()] == ["e\t2\t3\t0.9"]
    v = formats.edge_vectors(spark, put("v", "3 2 0 1 1\n1 2 0 0 1\n"), 2)
    assert [tuple(r) for r in v.collect()] == [(2, 3, [0, 1, 1])]
    assert [r.value for r in writers.transaction_lines(v).collect()] == ["2\t3"]
    assert [r.value for r in writers.transaction_lines(v, True).collect()] == ["2 2 3"]
    assert [tuple(r) for r in formats.itemsets(spark, put("i", "1 4 5 (3)\n7 (9)\n"), 2).collect()] == [([1, 4, 5], 3)]
    b = formats.block_patterns(spark, put("b", "2\n0101\n(1 2 )(2 3 )\n\n1\n1100\n(4 5)\n")).collect()
    assert [(r.no_of_edges, r.recurrence_pattern, [tuple(x) for x in r.edge_set]) for r in b] == [(2, "0101", [(1, 2), (2, 3)]), (1, "1100", [(4, 5)])]
    s = formats.site_report(spark, put("s", "head\nInspecting sequence ID   P1\n\n V$XX_01 |   7 (-) | 0.9 | 0.8 | acGTac\nInspecting sequence ID P2\n")).collect()
    assert [tuple(r) for r in s] == [("P1", "V$XX_01", 7, "-", 0.9, 0.8, "acGTac")]
    assert [r.value for r in formats.without_overhead(spark, put("o", "c x\n(1\n*\n1 2\n")).collect()] == ["1 2"]


@pytest.mark.parametrize("name", ["i1_closed_itemsets", "t15_least_squares"])
def test_mining_matches_sql(spark, sf, name):
    from tests.test_library import test_query_matches_sql

    test_query_matches_sql(spark, sf, name)


@pytest.mark.parametrize("name", ["t14_logistic_model"])
def test_mining_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["g4_normalized_cut", "g9_fuzzy_cores"])
def test_pattern_query_runs(spark, sf, name):
    """The smallest tables hold no pattern; the next size does."""
    assert catalogue.QUERIES[name](spark, sf.replace("sf0.001", "sf0.01")).count() > 0


def test_betweenness_query(spark, sf):
    assert catalogue.QUERIES["g3_betweenness_cut"](spark, sf.replace("sf0.001", "sf0.01")).where("size(vertex_set) >= 5").count() > 0
