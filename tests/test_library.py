"""Operators on golden cases, and a choice of queries against their SQL."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from netweft.functions import arrays
from netweft.operators import correlation
from netweft.operators.components import connected_components
from netweft.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_leave_one_out_golden():
    a = np.array([[0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9]])
    b = np.array([[0.2, 0.3, 0.35, 0.4, 0.6, 0.7, 0.8, 0.9]])
    s = correlation.pair_statistics(a, b)
    assert abs(s["min_cor"][0, 0] - 0.9944725852522) < 1e-9
    assert s["df"][0, 0] == 5
    assert 0 < correlation.correlation_cut_off(0.01, 5) < s["min_cor"][0, 0]


def test_pair_statistics_against_brute_force():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(5, 12)), rng.normal(size=(4, 12))
    x[0, 3] = y[1, 5] = np.nan
    y[3] = 2.0  # no variance
    s = correlation.pair_statistics(x, y)
    for i in range(5):
        for j in range(4):
            both = ~np.isnan(x[i]) & ~np.isnan(y[j])
            a, b = x[i][both], y[j][both]
            assert s["n"][i, j] == both.sum()
            assert math.isclose(s["distance"][i, j], np.linalg.norm(a - b), rel_tol=1e-9)
            assert math.isclose(s["variance"][i, j], np.var(a - b, ddof=1), rel_tol=1e-9)
            if j == 3:
                assert s["cor"][i, j] == correlation.UNDEFINED
                continue
            assert math.isclose(s["cor"][i, j], np.corrcoef(a, b)[0, 1], rel_tol=1e-9)
            whole = [np.corrcoef(np.delete(x[i], k)[np.delete(both, k)], np.delete(y[j], k)[np.delete(both, k)])[0, 1] for k in range(12)]
            assert math.isclose(s["min_cor"][i, j], min(whole, key=abs), rel_tol=1e-9)


def test_gene_pairs_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(d, g, [float(v) for v in rng.normal(size=9)]) for d in range(2) for g in range(20)]
    df = spark.createDataFrame(rows, "dataset_no int, gene_no long, v array<double>")
    one, many = (sorted((r["dataset_no"], r["g1"], r["g2"], round(r["min_cor"], 9), round(r["mean"], 9)) for r in correlation.gene_pairs(df, blocks=k).collect()) for k in (1, 3))
    assert one == many
    assert len(one) == 2 * 190


def test_components_golden(spark):
    edges = [(1, 2), (2, 3), (2, 4), (3, 4), (5, 6), (7, 6), (5, 7), (8, 9), (10, 10), (None, 3)]
    found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 8, 9: 8, 10: 10}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recurrence_kinds(spark):
    """Sums of a recurrence array as it is, counted by a threshold, and powered; its 0/1 form."""
    df = spark.createDataFrame([([0.5, 0.9, 0.8, 0.0],)], "r array<double>")
    r = F.col("r")
    got = df.select(arrays.recurrence(r), arrays.recurrence(r, 1, 0.8), arrays.recurrence(r, 2, 2.0), arrays.binarise(r, 0.8)).first()
    assert math.isclose(got[0], 2.2) and got[1] == 2.0 and math.isclose(got[2], 0.25 + 0.81 + 0.64) and got[3] == [0, 1, 1, 0]


def same(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(same(x) for x in v)
    if v is None or v is pd.NA or v != v:
        return None
    return float(f"{float(v):.6g}") if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)


CHOSEN = [
    "a1_graph_overlay", "a10_function_genes", "a14_cumulative_cells", "c1_pearson", "c6_correlation_graph", "f4_mask_encode", "g1_connected_components", "g12_triangles", "i2_signature_patterns",
    "j13_signature_containment", "j15_second_order_pairs", "o2_depth", "o3_pair_distances", "o12_judge", "o14_related_predictions", "p13_factor_hits", "p17_systematic_sample", "s25_gene_numbers",
    "t2_cluster_scan", "t7_binomial_tail", "t11_edge_gradient", "t12_vertex_gradient", "w10_bisected_cut_off", "f16_mismatches", "f18_sequence_segments", "o6_informative_nodes", "o19_common_ancestors", "t3_cluster_enrichment", "t9_fisher_exact", "u2_prune_united", "w4_best_prediction", "w9_cut_off",
]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    key = lambda r: str(r)
    rows = [sorted((tuple(same(v) for v in r) for r in df[order].itertuples(index=False, name=None)), key=key) for df in (got, want)]
    assert rows[0] == rows[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def _some_expression(spark, genes, holes):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2, genes, 8)).round(3)
    v[0, 5] = v[0, 2]
    v[0, 7] = 1.0
    rows = [(d, g, [None if d in holes and g % 9 == 0 and i == g % 8 else float(x) for i, x in enumerate(v[d, g])]) for d in (0, 1) for g in range(genes)]
    return rows, spark.createDataFrame(rows, "dataset_no int, gene_no long, v array<double>")


def test_complete_rows_have_the_same_statistics():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 8)), rng.normal(size=(30, 8))
    x[3], x[4], y[5, 1:], y[6] = y[2], 1.0, 2.0, -x[7]
    want = correlation.pair_statistics(x, y)
    got = correlation.complete_statistics(x, y, correlation.STATISTICS)
    for k in correlation.STATISTICS:
        assert np.allclose(want[k], got[k], atol=1e-7, equal_nan=True), k


def test_large_blocks_keep_the_shuffle_small():
    assert correlation.blocks_of(100_000, correlation.BLOCK) <= 50  # 391 copies of every vector with blocks of 256
    assert correlation.blocks_of(615_000, correlation.BLOCK) <= 20  # 301 copies with blocks of 2,048
    assert correlation.blocks_of(2_000, correlation.BLOCK) == 8 and correlation.blocks_of(0, correlation.BLOCK) == 1


def test_tiles_of_a_block(spark):
    """Blocks of several tiles, with complete and incomplete rows: every pair once, with its own statistics."""
    rows, df = _some_expression(spark, 300, {1})
    got = {(r.dataset_no, r.g1, r.g2): (r.cor, r.n) for r in correlation.gene_pairs(df, ("cor", "n"), lambda found, _: found["cor"] >= 0.7, blocks=1).collect()}
    want = {}
    for d in (0, 1):
        x = np.array([[np.nan if y is None else y for y in v] for k, _, v in rows if k == d])
        s = correlation.pair_statistics(x, x, ("cor",))
        want |= {(d, i, j): (s["cor"][i, j], s["n"][i, j]) for i, j in zip(*np.nonzero(s["cor"] >= 0.7)) if i < j}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


@pytest.mark.parametrize("holes", [set(), {1}])
def test_differences_without_pairs(spark, monkeypatch, holes):
    """As over all pairs; only a dataset with missing values may form them."""
    rows, df = _some_expression(spark, 120, holes)
    want = {r.dataset_no: (r.pairs, r.variance_sum, r.mean_max) for r in correlation.pair_summary(df, ("variance", "mean")).collect()}
    met, by_blocks = [], correlation._by_blocks
    monkeypatch.setattr(correlation, "_by_blocks", lambda e, *rest: met.append({r[0] for r in e.select("dataset_no").distinct().collect()}) or by_blocks(e, *rest))
    got = {r.dataset_no: (r.pairs, r.variance_sum, r.mean_max) for r in correlation.spread_of_differences(df).collect()}
    assert met == ([holes] if holes else []) and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_results_of_a_block_leave_in_batches(spark, monkeypatch):
    """A large block's pairs are returned some at a time, and are the same whatever the size of a batch."""
    monkeypatch.setattr(correlation, "BATCH", 50)
    parts = [{"a": np.arange(k), "v": np.arange(k) / 2} for k in (30, 0, 30, 200, 7)]
    got = list(correlation._batches(iter(parts), {"a": "long", "v": "double"}))
    assert [b.num_rows for b in got] == [60, 200, 7] and sum(b.column(0).to_pylist()[-1] for b in got) == 29 + 199 + 6


def test_floors_lose_no_correlation(spark, monkeypatch):
    """The kernel that drops pairs early agrees with the whole one from the floor on; also with outliers and flat remainders."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 8))
    x[::9, 3] += 40
    x[5::30] = 0.0
    x[5::30, 6] = 1.0
    want = correlation.complete_statistics(x, x, ("min_cor",))["min_cor"]
    for floor in (0.2, 0.5, 0.9):
        got = correlation.at_least(x, x, floor)
        on = np.abs(want) >= floor
        assert on.sum() > 100 and np.abs(got[on] - want[on]).max() < 1e-9 and (np.abs(got[~on & ~np.isnan(got)]) >= floor - 1e-8).all()


def test_top_correlations_are_not_written(spark, sf, monkeypatch):
    from netweft.plans import expression

    monkeypatch.setattr(correlation, "cut", None)
    assert expression.correlation_graph(spark, sf).count() == 8 * (500 * 500 // 100)
