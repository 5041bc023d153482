"""Tables many times larger are dealt to more tasks, and no step makes rows that nobody wants."""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from netweft.operators import graphs, models, statistics
from netweft.operators import ontology as O
from netweft.plans import annotation, formats, ontology, scoring


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_grow_in_number(spark, sf, monkeypatch):
    """A document is read by one task, so more entries make more documents, not larger ones."""
    found, read = [], formats.formats.interactions
    monkeypatch.setattr(formats.formats, "interactions", lambda s, path, genes: found.append(path) or read(s, path, genes))
    monkeypatch.setattr(formats, "LINES_A_FILE", 300)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert formats.interaction_entries(spark, sf).count() > 0
    assert len(spark.read.text(found[0]).inputFiles()) == -(-lines // 300) > 8


def test_judging_makes_no_row_for_each_ancestor(spark):
    """What two functions have in common is found once for the pair, not for each prediction and each ancestor."""
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 8), (3, 9)], "parent int, child int")
    predicted = spark.createDataFrame([(g, t) for g in range(6) for t in (4, 8, 9)] + [(7, None), (9, 4)], "gene_no int, go_no int")
    known = spark.createDataFrame([(g, t) for g in range(6) for t in (8, 9)] + [(7, 2)], "gene_no int, go_no int")
    got = O.judge(predicted, known, O.all_paths(edges, 1), 3)
    assert "Generate" not in plan_of(got)
    rows = {(r.gene_no, r.go_no): (r.is_correct, r.is_correct_l1, r.is_correct_lca, r.lca) for r in got.collect()}
    assert len(rows) == 20 and rows[9, 4] == (-1, -1, -1, []) and rows[7, None] == (0, 0, 0, [])
    assert rows[0, 8] == (1, 1, 1, [8]) and rows[0, 4] == (0, 1, 1, [4]) and rows[0, 9] == (1, 1, 1, [9])


@pytest.mark.parametrize("twice", [False, True])
def test_pairs_of_one_class(spark, twice):
    """Links of a class against brute force; a pair is linked once however often it meets, and counts as often as it is listed."""
    groups = [(o, (o * 7 + i * i) % 11) for o in range(12) for i in range(4)] + [(3, 5), (3, 5), (None, 2), (None, 4)]
    classes = [(g, g % 3) for g in range(11)] + [(g, 9) for g in range(0, 11, 2)] + [(1, None)] + ([(4, 9)] if twice else [])
    got = graphs.shared_pairs(spark.createDataFrame(groups, "o int, gene_no int"), spark.createDataFrame(classes, "gene_no int, c int"), "o", "c", 100)
    links = {p for o in range(12) for p in combinations(sorted({g for k, g in groups if k == o}), 2)}
    n = Counter(classes)
    want = {(c, a, b): n[a, c] * n[b, c] for a, b in links for c in (0, 1, 2, 9) if n[a, c] and n[b, c]}
    assert {(r.c, r.g1, r.g2): r.n for r in got.collect()} == want and len(want) > 20


def test_links_are_made_inside_a_function_only(spark, sf):
    """The pairs of an order are joined by function too, so that links without a common one are never made."""
    joins = [line for line in plan_of(annotation.common_functions(spark, sf)).splitlines() if "Join Inner" in line and "l_orderkey" in line]
    assert len(joins) == 1 and "go_no" in joins[0]


def test_relations_are_joined_once(spark, sf):
    """Predictions meet one table of related terms; both sides are dealt by gene."""
    plan = plan_of(scoring.judged_by_relation(spark, sf))
    assert plan.count("LeftOuter") == 2 and plan.count("RepartitionByExpression [gene_no") + plan.count("RepartitionByExpression [probe") >= 2


def test_least_p_needs_no_window(spark, sf):
    plan = plan_of(annotation.least_p(spark, sf))
    assert "Window" not in plan and "RepartitionByExpression [mcl_id" in plan


def test_patterns_are_made_once(spark, sf):
    """The edges of the patterns, made of all line items, are written once and read by the steps that follow."""
    edges, _, functions, _ = scoring.around(spark, sf)
    assert edges.inputFiles() and all("pattern-edges-" in f for f in edges.inputFiles())
    assert functions.inputFiles() and all("functions-" in f for f in functions.inputFiles())


def test_parents_are_dropped_by_one_grouping(spark):
    edges = [(1, 2), (2, 4), (2, 6), (3, 6), (5, 10)]
    own = [(1, 2), (1, 4), (1, 3), (2, 6), (2, 3), (2, 5), (3, None), (3, 2), (None, 2), (None, 4), (4, 10), (4, 1)]
    got = O.without_parents(spark.createDataFrame(own, "probe int, go_no int"), spark.createDataFrame(edges, "parent int, child int"), "probe")
    want = [(p, t) for p, t in own if p is None or not any(a == t and (p, c) in own for a, c in edges)]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert "LeftAnti" not in plan_of(got)


def test_training_rows_are_dealt_when_there_are_many(spark, monkeypatch):
    """Each row is cached with a count for every tree, so a partition holds a bounded number of them; few rows stay as they are."""
    df = spark.range(0, 4_000, 1, 2).selectExpr("id", "id % 7 AS x", "id % 5 AS z", "CAST(id % 7 > 3 AS int) AS y")
    said, deal = [], models.dealt
    monkeypatch.setattr(models, "dealt", lambda d, *k, **how: said.append(how) or deal(d, *k, **how))
    few = models.forest_accuracy(df, "id", ["x", "z"], "y").collect()
    assert not said
    monkeypatch.setattr(models, "BAGGED_ROWS", 100)
    many = models.forest_accuracy(df, "id", ["x", "z"], "y").collect()
    assert said[0]["rows"] > 3_000 and said[0]["within"] == 100
    assert sorted(map(tuple, few)) == sorted(map(tuple, many))


def test_terms_of_a_fisher_test_are_dealt(spark):
    """Against sums of whole numbers; a table with large counts is the work of several tasks, not of one expression."""
    tables = {1: (8, 2, 1, 5), 2: (0, 0, 0, 0), 3: (3, 0, 4, 0), 4: (90, 130, 160, 95), 5: (40, 40, 40, 40), 6: (0, 7, 9, 0)}
    df = spark.createDataFrame([(k, *t) for k, t in tables.items()], "k int, a long, b long, c long, d long")
    got = {r.k: r.p for r in statistics.fisher_two_sided(df, ["k"], within=3).collect()}
    assert got.keys() == tables.keys()
    for k, (a, b, c, d) in tables.items():
        n, row, col = a + b + c + d, a + b, a + c
        ways = [math.comb(row, i) * math.comb(n - row, col - i) for i in range(max(0, col - (n - row)), min(row, col) + 1)]
        own = math.comb(row, a) * math.comb(n - row, col - a)
        assert abs(got[k] - sum(w for w in ways if w <= own) / math.comb(n, col)) < 1e-9
    many = statistics.fisher_two_sided(spark.createDataFrame([(1, 50_000, 70_000, 60_000, 80_000)], "k int, a long, b long, c long, d long"), ["k"])
    assert "RepartitionByExpression [k" in plan_of(many) and 0 < many.first()["p"] < 1e-9
