"""Function matrices, tight clusters and what is made of them."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweft.operators import biclusters, correlation, graphs, kernels, matrices, tight


def test_function_matrices(spark):
    edges = [(1, 2, [1.0, None, 3.0]), (1, 3, [None, None, 1.0]), (2, 3, [2.0, 2.0, 2.0]), (3, 4, [1.0, 1.0, 1.0]), (None, 2, [1.0, 1.0, 1.0])]
    e = spark.createDataFrame(edges, "g1 int, g2 int, v array<double>")
    f = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (3, 8), (4, 8), (2, 7), (None, 7)], "gene_no int, go_no int")
    got = {(r["go_no"], r["g1"], r["g2"]) for r in matrices.function_matrices(e, f, max_missing=1, min_edges=2).collect()}
    assert got == {(7, 1, 2), (7, 2, 3)}
    assert {(r["go_no"], r["g1"], r["g2"]) for r in matrices.function_matrices(e, f, max_missing=2, min_edges=1).collect()} == {(7, 1, 2), (7, 1, 3), (7, 2, 3), (8, 3, 4)}
    top = matrices.most_spread(matrices.function_matrices(e, f, 2, 1), 0.4, 1).collect()
    assert sorted((r["go_no"], r["g1"], r["g2"], r["spread"]) for r in top) == [(7, 1, 2, round(2**0.5, 6)), (8, 3, 4, 0.0)]
    unknown = matrices.unknown_edges(e.dropna(), f.where("gene_no > 1"))
    assert sorted((r["g1"], r["g2"]) for r in unknown.collect()) == [(1, 2), (1, 3)]
    assert matrices.function_matrices(e.limit(0), f, 1, 1).count() == 0
    wide = matrices.side_by_side(spark.createDataFrame([("a", 1, 5), ("a", 3, 7), ("b", 2, 1)], "k string, c int, x int"), ["k"], "c", "x", [1, 2, 3])
    assert {r["k"]: r["v"] for r in wide.collect()} == {"a": [5, None, 7], "b": [None, 1, None]}


def planted(noise: int = 60):
    rng = np.random.default_rng(1)
    centres, rows = rng.normal(size=(3, 6)) * 6, []
    for c in range(3):
        rows += [(1, c * 100 + i, [float(x) for x in centres[c] + rng.normal(size=6) * 0.15]) for i in range(40)]
    return rows + [(1, 1000 + i, [float(x) for x in rng.normal(size=6) * 6]) for i in range(noise)]


def test_planted_clusters_are_found(spark):
    rows = planted()
    rows[3][2][2] = rows[50][2][5] = None
    rows += [(2, i, [float(i), 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(3)] + [(1, 5_000, [None] * 6), (None, 5_001, [1.0] * 6), (1, 5_002, None)]
    df = spark.createDataFrame(rows, "go long, id long, v array<double>")
    found = defaultdict(set)
    for r in tight.tight_clusters(df.repartition(5), "go", "id", "v", clusters=3, ks=(6, 8)).collect():
        assert r["go"] == 1
        found[r["cluster"]].add(r["id"])
    assert len(found) == 3
    for c in range(3):
        own = {c * 100 + i for i in range(40)}
        best = max(found.values(), key=lambda x: len(x & own))
        assert len(best & own) >= 38 and len(best - own) <= 6


def test_tight_clusters_of_nothing(spark):
    df = spark.createDataFrame([], "go long, id long, v array<double>")
    assert tight.tight_clusters(df, "go", "id", "v").count() == 0
    with pytest.raises(Exception, match="have to be below"):
        tight.tight_clusters(spark.createDataFrame([(1, 1, [1e9])], "go long, id long, v array<double>"), "go", "id", "v")


def test_signatures_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(planted(20), "go long, id long, v array<double>")
    out = []
    for n in (1, 7):
        rows = tight.rows_of(df.repartition(n), "go", "id", "v", 1000.0, 4, 0.6, 9)
        out.append(sorted(map(tuple, tight.signatures(rows, [3, 5], 4, 3, 9).select("k", "id", F.concat_ws("-", F.transform("sig", lambda x: x.cast("string")))).collect())))
    assert out[0] == out[1] and len(out[0]) == 2 * 140


def near_brute(sigs, wrong):
    return {(c, s) for c, n, _ in sigs if n > 1 for s, _, _ in sigs if sum(a != b for a, b in zip(c, s)) <= wrong}


@pytest.mark.parametrize("alpha", [0.0, 0.2, 0.34])
def test_candidates_against_brute_force(spark, alpha):
    """Bounds, the pool that grows, and the greedy choice against all pairs of rows."""
    rng = np.random.default_rng(int(alpha * 100))
    base = rng.integers(0, 3, (6, 6))
    signed = [tuple(int(x) for x in np.where(rng.random(6) < 0.12, rng.integers(0, 3, 6), base[rng.integers(0, 6)])) for _ in range(150)]
    df = spark.createDataFrame([(1, 3, i, list(s)) for i, s in enumerate(signed)], "group long, k int, id long, sig array<int>")
    rows = defaultdict(list)
    for i, s in enumerate(signed):
        rows[s].append(i)
    sigs = [(s, len(v), min(v)) for s, v in rows.items()]
    wrong = int(alpha * 6 + 1e-9)
    near = near_brute(sigs, wrong)
    found = tight.near_cores(tight.cores(df), 6, alpha)
    assert {(tuple(r["core"]), tuple(r["sig"])) for r in found.collect()} == near
    bound = {c: sum(n for s, n, _ in sigs if (c, s) in near) for c, n, _ in sigs if n > 1}
    taken, want = set(), []
    for c, _ in sorted(bound.items(), key=lambda x: (-x[1], min(rows[x[0]]))):
        if c in taken:
            continue
        live = {s for s, _, _ in sigs if (c, s) in near and s not in taken}
        while True:
            bad = {s: sum(len(rows[t]) for t in live if sum(a == b for a, b in zip(s, t)) < (1 - alpha) * 6 - 1e-9) for s in live}
            worst = max(live, key=lambda s: (bad[s], min(rows[s])))
            if not bad[worst]:
                break
            live.remove(worst)
        taken |= live
        want.append(sum(len(rows[s]) for s in live))
    for pool in (1, 40):
        got = tight.candidates(tight.cores(df), 6, alpha, 4, pool).select("cand", "size").distinct().orderBy("cand").collect()
        assert [r["size"] for r in got] == sorted(want, reverse=True)[:4]


def test_stable_matches():
    sizes = {(4, 0): 10, (4, 1): 8, (5, 0): 9, (5, 1): 8, (6, 0): 8}
    common = {(4, 0, 0): 9, (4, 1, 1): 3, (5, 1, 0): 8}
    assert tight.stable(sizes, common, [4, 5, 6], 0.6, 2) == (4, 0)
    assert tight.stable(sizes, common, [4, 5, 6], 0.95, 2) == (5, 1)
    assert tight.stable(sizes, common, [4, 5, 6], 0.6, 3) is None
    assert tight.stable(sizes, common | {(5, 0, 0): 8, (5, 1, 0): 0}, [4, 5, 6], 0.6, 3) == (5, 0)


def sql_of(spark, sf, name):
    from tests.test_library import test_query_matches_sql

    test_query_matches_sql(spark, sf, name)


@pytest.mark.parametrize("name", ["g17_spread_columns", "g7_core_sets"])
def test_cluster_query_matches_sql(spark, sf, name):
    sql_of(spark, sf, name)


def test_bicluster_of_a_tall_matrix(spark):
    """Rounds over 20,000 rows end where deleting on the whole matrix does."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(20_000, 8))
    m[5_000:5_160] = rng.normal(size=(160, 1)) + rng.normal(size=8) + rng.normal(size=(160, 8)) * 0.01
    df = spark.createDataFrame([(1, i, [float(x) for x in r]) for i, r in enumerate(m)], "g int, id long, v array<double>")
    for most in (0.3, 0.01):
        rows, columns, score = kernels.find_bicluster(m, most, 100, 5, 4)
        got = biclusters.biclusters(df.repartition(6), "g", "id", "v", most, tries=1).collect()
        assert sorted(r["key"] for r in got) == rows.tolist()
        assert all(r["columns"] == columns.tolist() and abs(r["score"] - score) < 1e-9 for r in got)


def test_biclusters_of_several_groups(spark):
    """Planted blocks are found one after another; odd rows are left out; a group without a bicluster has no row."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        v = rng.normal(size=6) * 3
        if i < 40:
            v = np.arange(6) + i / 10
        elif i < 70:
            v = np.array([5.0, 1, 4, 2, 8, 0]) - i / 7
        rows.append((1, i, [float(x) for x in v]))
    rows += [(2, i, [float(x) for x in rng.normal(size=6) * 9]) for i in range(20)]
    rows += [(1, 900, [None] + [1.0] * 5), (1, None, [1.0] * 6), (None, 901, [1.0] * 6), (1, 902, None)]
    df = spark.createDataFrame(rows, "g int, id long, v array<double>")
    got = biclusters.biclusters(df, "g", "id", "v", 1e-6, tries=3, batch=50).collect()
    found = defaultdict(set)
    for r in got:
        found[r["g"], r["no"]].add(r["key"])
    assert {frozenset(x) for (g, _), x in found.items() if g == 1} == {frozenset(range(40)), frozenset(range(40, 70))}
    assert not any(g == 2 for g, _ in found)
    assert biclusters.biclusters(df.limit(0), "g", "id", "v", 0.1).count() == 0


def test_components_of_groups(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 7, 8), (2, 1, 9), (2, 3, 2)], "p int, g1 long, g2 long")
    got = {(r["p"], tuple(r["vertices"])) for r in biclusters.components(e, ["p"]).collect()}
    assert got == {(1, (1, 2, 3)), (1, (7, 8)), (2, (1, 9)), (2, (2, 3))}


def test_pairs_in_blocks_meet_once(spark):
    """However many blocks a key is dealt to, every two of its rows meet in both orders, once each."""
    rows = [("a", i) for i in range(40)] + [("b", i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, x int")
    x, y = graphs.in_blocks(df, "k", 7)
    met = x.join(y.withColumnRenamed("x", "y"), ["k", "__i", "__j"]).select("k", "x", "y").collect()
    assert sorted(map(tuple, met)) == sorted((k, a, b) for k, n in (("a", 40), ("b", 3)) for a in range(n) for b in range(n))
    assert x.groupBy("k", "__i", "__j").count().agg(F.max("count")).first()[0] < 20


def test_triangles_of_a_hub(spark):
    """A hub with the smallest name, doubled and turned edges, several datasets."""
    rng = np.random.default_rng(9)
    edges = {(0, i) for i in range(1, 40)} | {tuple(sorted(map(int, rng.choice(np.arange(1, 40), 2, replace=False)))) for _ in range(90)}
    rows = [(d, a, b) for d in (1, 2) for a, b in edges if (a + b + d) % 5] + [(1, 7, 7)]
    df = spark.createDataFrame(rows + [(d, b, a) for d, a, b in rows[:9]], "dataset_no int, g1 int, g2 int")
    want = set()
    for d in (1, 2):
        own = {(a, b) for x, a, b in rows if x == d and a != b}
        want |= {(d, a, b, c) for a, b in own for b2, c in own if b2 == b and (a, c) in own}
    got = graphs.triangles(df, ["dataset_no"]).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_cut_offs_of_the_degrees_that_occur(spark):
    """Known upper 1 percent points of Student's t: 31.821 (1), 6.965 (2), 2.764 (10), 2.326 (very many)."""
    df = spark.createDataFrame([(1,), (2,), (10,), (10,), (100_000,), (0,), (None,)], "n int")
    got = {r["df"]: r["cut"] for r in correlation.cut_off_table(df, 0.01).collect()}
    for n, t in ((1, 31.8205), (2, 6.9646), (10, 2.7638), (100_000, 2.3264)):
        assert abs(got.pop(n) - t / np.sqrt(t * t + n)) < 1e-5
    assert not got
    pairs = spark.createDataFrame([(0.9, 10), (0.5, 10), (1.1, 10), (0.9, None), (0.02, 100_000)], "min_cor double, df int")
    assert [r["sig"] for r in correlation.significant(pairs, 0.01).orderBy(F.desc("df"), F.desc("min_cor")).collect()] == [1, 0, 1, 0, 0]


def test_candidates_join_biclusters(spark):
    """Against brute force: correlation and distance to the column means over the bicluster's columns."""
    rng = np.random.default_rng(12)
    m = {(g, i): rng.normal(size=6) for g in (1, 2) for i in range(8)}
    found = [(g, no, i, [0, 2, 3, 5] if no else [1, 2, 4, 5]) for g in (1, 2) for no in (0, 1) for i in range(no, 6)]
    others = {100 + i: rng.normal(size=6) for i in range(200)} | {3: m[1, 3]}
    for i in range(40):
        g, no = 1 + i % 2, i // 2 % 2
        others[400 + i] = np.mean([m[g, k] for k in range(no, 6)], axis=0) + rng.normal(size=6) * 0.05
    schema = "go long, id long, v array<double>"
    mats = spark.createDataFrame([(g, i, [float(x) for x in v]) for (g, i), v in m.items()], schema)
    cands = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in others.items()] + [(900, [None] * 6), (901, [1.0] * 6), (902, None)], "id long, v array<double>")
    f = spark.createDataFrame(found, "go long, no int, key long, columns array<int>")
    want = set()
    for g in (1, 2):
        for no in (0, 1):
            cols = [0, 2, 3, 5] if no else [1, 2, 4, 5]
            mean = np.mean([m[g, k][cols] for k in range(no, 6)], axis=0)
            for i, v in others.items():
                if (g, i) not in m and np.corrcoef(v[cols], mean)[0, 1] >= 0.8 and np.linalg.norm(v[cols] - mean) / 4 <= 0.2:
                    want.add((g, no, i))
    got = biclusters.grown(f, mats, cands.repartition(3), "go", "id", "v", 0.8, 0.2).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 10
    assert biclusters.grown(f.limit(0), mats, cands, "go", "id", "v").count() == 0


def test_matrices_form_only_pairs_of_a_function(spark, sf, monkeypatch):
    """As from the edges of the whole graph, which are no longer written for it; also with missing values."""
    from netweft.plans import adapters, clusters

    whole = adapters.expression(spark, sf)
    holes = whole.withColumn("v", F.transform("v", lambda x: F.when((F.col("gene_no") % 7 > 0) | (x > 0), x)))
    functions = clusters.deep_functions(spark, sf)
    for x in (whole, holes):
        monkeypatch.setattr(adapters, "expression", lambda *_: x)
        want = matrices.function_matrices(clusters.edge_vectors(spark, sf), functions, clusters.MISSING, clusters.EDGES)
        with monkeypatch.context() as m:
            m.setattr(clusters, "edge_vectors", None)
            got = clusters.function_matrices(spark, sf)
        rows = [sorted((r["go_no"], r["g1"], r["g2"], r["v"]) for r in df.collect()) for df in (want, got)]
        assert rows[0] and [r[:3] for r in rows[0]] == [r[:3] for r in rows[1]]
        assert [r[3] for r in rows[0]] == [r[3] for r in rows[1]]


def test_edge_classes_shuffle_no_edge_by_function(spark):
    """By hand, and without grouping edges by (function, edge)."""
    import re

    from netweft.operators import annotation

    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "g1 int, g2 int")
    known = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, False)], "gene_no int, known boolean")
    functions = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, 9)], "gene_no int, go_no int")
    found = annotation.edge_classes(edges, functions, known)
    assert sorted(map(tuple, found.collect())) == [(7, 1, 1, 1, 0, 1, 1), (8, 0, 2, 0, 0, 2, 1), (9, 0, 1, 1, 1, 1, 1)]
    assert not re.search(r"keys=\[go_no#\d+L?, g1", found._jdf.queryExecution().executedPlan().toString())


def test_function_matrices_are_not_written(spark, sf, monkeypatch):
    """Their pairs are formed again by each step; only genes, counts and the most spread edges are written."""
    from netweft.plans import clusters

    names = []
    for module in (clusters, tight):
        monkeypatch.setattr(module, "cut", lambda df, name, *how, write=module.cut: names.append(name) or write(df, name, *how))
    assert clusters.core_sets(spark, sf).count() and clusters.spread_columns(spark, sf).count()
    assert set(names) == {"function-genes"}
    assert clusters.described_datasets(spark, sf).count() and set(names) == {"function-genes", "most-spread"}
    got, want = (sorted((r["go_no"], r["g1"], r["g2"], r["v"]) for r in df.collect()) for df in (clusters.most_spread(spark, sf), matrices.most_spread(clusters.function_matrices(spark, sf), at_least=40).drop("spread")))
    assert got == want and got


def test_signatures_of_few_wide_rows(spark):
    """As those of the transpose, of which no row is held whole."""
    rng = np.random.default_rng(6)
    x = rng.integers(400, 1000, (3, 60, 8))
    holes = rng.random(x.shape) < 0.3
    holes[2, :, 5] = True
    v = [[[None if h else int(e) for e, h in zip(*r)] for r in zip(*g)] for g in zip(x, holes)]
    tall = spark.createDataFrame([(g, r) for g in range(3) for r in v[g]], "g int, v array<int>")
    wide = spark.createDataFrame([(g, i, [r[i] for r in v[g]]) for g in range(3) for i in range(8)], "g int, id long, v array<int>")
    want = tight.signatures(tight.rows_of(wide, "g", "id", "v", 1.0, 2, 0.7, 5), [2, 3, 4], 2, 3, 5).collect()
    got = tight.wide_signatures(tall.repartition(4), "g", [2, 3, 4], 2, 3, 0.7, 5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 30
