"""Scores, tails, orders and collapses against brute force on small cases."""

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netweft.operators import annotation, biclusters, kernels, ranking, scoring
from netweft.operators import ontology as O
from netweft.operators import statistics as T


def test_hypergeometric_and_binomial_tails(spark):
    rng = np.random.default_rng(1)
    rows = [(int(x), int(m), int(k), int(n)) for n in (7, 40, 300) for m, k in rng.integers(0, n + 1, (8, 2)) for x in rng.integers(-1, min(m, k) + 3, 6)]
    df = spark.createDataFrame(rows, "x long, m long, k long, n long")
    got = df.select("*", T.hypergeometric_tail(F.col("x"), F.col("m"), F.col("k"), F.col("n")).alias("p"), T.binomial_log_tail(F.col("x"), F.col("n"), F.lit(0.3)).alias("b")).collect()
    for r in got:
        want = Fraction(sum(math.comb(r.m, i) * math.comb(r.n - r.m, r.k - i) for i in range(max(r.x, 0), min(r.m, r.k) + 1) if r.k - i >= 0), math.comb(r.n, r.k))
        assert math.isclose(r.p, float(want), rel_tol=1e-8, abs_tol=1e-12), r
        tail = sum(math.comb(r.n, i) * 0.3**i * 0.7 ** (r.n - i) for i in range(max(r.x, 0), r.n + 1))
        assert r.b == -math.inf if r.x > r.n else math.isclose(r.b, math.log(tail), rel_tol=1e-8, abs_tol=1e-10), r


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(g), int(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500)))]
    return spark.createDataFrame(rows, "id long, g int, v int").repartition(7).cache(), pd.DataFrame(rows, columns=["id", "g", "v"])


def test_orders_by_ranges(values):
    df, want = values
    order = want.sort_values(["v", "id"], ascending=[False, True]).reset_index(drop=True)
    got = ranking.numbered(df, [F.desc("v"), "id"], "r").toPandas().sort_values("r")
    assert got["id"].tolist() == order["id"].tolist() and got["r"].tolist() == list(range(1, 501))
    sums = ranking.running_sums(df.select("id", "v", F.lit(1).alias("n"), F.col("v").alias("s")), [F.desc("v"), "id"], ["n", "s"]).toPandas().sort_values("n")
    assert sums["id"].tolist() == order["id"].tolist() and sums["s"].tolist() == order["v"].cumsum().tolist()
    assert ranking.every_kth(df, ["id"], 7).count() == 500 // 7


@pytest.mark.parametrize("scale", [None, 0.1])
def test_top_by_bins(values, scale):
    df, want = values
    got = ranking.top_by_bins(df, ["g"], F.col("v"), ["id"], F.floor(F.col("__n") * 0.3), scale).toPandas()
    for g, rows in want.groupby("g"):
        best = rows.sort_values(["v", "id"], ascending=[False, True]).head(int(len(rows) * 0.3))
        assert sorted(got[got["g"] == g]["id"]) == sorted(best["id"])


def test_bisected_cut_off(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 31):
        rows = [(float(s), int(c), i) for i, (s, c) in enumerate(zip(rng.integers(0, 9, n), rng.integers(0, 2, n)))]
        order = sorted(rows)
        low, high, at, found = 0, n, n // 2, None
        while True:
            found = order[at][0]
            a = np.mean([c for _, c, _ in order[at:]])
            low, high, nxt = (low, at, (at + low) // 2) if a >= 0.6 else (at, high, (high + at) // 2)
            if abs(a - 0.6) <= 0.001 or nxt == at:
                break
            at = nxt
        assert ranking.bisected_cut_off(spark.createDataFrame(rows, "s double, c int, id long"), "s", "c", "id", 0.6) == found
    assert ranking.bisected_cut_off(spark.createDataFrame([], "s double, c int, id long"), "s", "c", "id", 0.6) is None


def test_permuted_genes_are_a_bijection(spark):
    members = spark.createDataFrame([(c, g) for c in range(6) for g in range(c, 3 * c + 2)], "mcl_id int, gene_no int")
    got = annotation.permuted_genes(members, 4)
    size = lambda df: sorted((r["mcl_id"], r["count"]) for r in df.groupBy("mcl_id").count().collect())
    degree = lambda df: sorted(r["count"] for r in df.groupBy("gene_no").count().collect())
    assert size(got) == size(members) and degree(got) == degree(members)
    assert sorted(map(tuple, got.collect())) != sorted(map(tuple, members.collect()))


def test_distances_of_a_chain(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (1, 5)], "parent int, child int")
    paths = O.all_paths(edges, 1)
    pairs = spark.createDataFrame([(3, 2), (4, 3), (3, 5), (2, 2), (3, 9)], "a int, b int")
    assert {(r.a, r.b): r.distance for r in O.distance_of(pairs, paths).collect()} == {(3, 2): 0, (4, 3): 1, (3, 5): 1, (2, 2): 0, (3, 9): None}
    steps = {(r.t1, r.t2): (r.steps, r.ancestors) for r in O.pair_distances(paths).collect()}
    assert steps[3, 4] == (2, [2]) and steps[3, 5] == (3, [1]) and len(steps) == 10


def test_merged_contexts(spark):
    rng = np.random.default_rng(9)
    rows = [(g, go, sorted({int(x) for x in rng.integers(0, 12, rng.integers(1, 9))}), int(rng.integers(0, 2))) for g in range(8) for go in range(int(rng.integers(1, 9)))]
    got = {(r.gene_no, r.go_no): (r.members, r.context, r.is_correct) for r in scoring.merge_contexts(spark.createDataFrame(rows, "gene_no int, go_no int, context array<int>, is_correct int"), 0.4).collect()}
    want = {}
    for g in range(8):
        left = [[go, [go], set(c), ok] for own, go, c, ok in rows if own == g]
        while left:
            first, *others = left
            left = []
            for x in others:
                i = len(first[2] & x[2])
                if 1 - i / len(first[2]) < 0.4 or 1 - i / len(x[2]) < 0.4:
                    first = [first[0], first[1] + x[1], first[2] | x[2], first[3] * x[3]]
                else:
                    left.append(x)
            want[g, first[0]] = (first[1], sorted(first[2]), first[3])
    assert got == want


def test_merged_contexts_of_all_predictions(spark, sf):
    """Predictions of unknown correctness and those of every cluster count; against brute force over the tables."""
    from netweft.plans import adapters as A
    from netweft.plans.scoring import merged_contexts

    clusters, own = {}, {}
    for r in A.members(spark, sf).collect():
        clusters.setdefault(r.mcl_id, set()).add(r.gene_no)
    for r in A.predictions(spark, sf).collect():
        if r.mcl_id in clusters:
            c, ok = own.get((r.gene_no, r.go_no), (set(), 1))
            own[r.gene_no, r.go_no] = c | clusters[r.mcl_id], min(ok, r.is_correct)
    want = {}
    for g in {g for g, _ in own}:
        groups = []
        for go in sorted(t for x, t in own if x == g):
            c, ok = own[g, go]
            hit = next((x for x in groups if 1 - len(c & x[1]) / len(x[1]) < 0.5 or 1 - len(c & x[1]) / len(c) < 0.5), None)
            if hit:
                hit[0].append(go)
                hit[1], hit[2] = hit[1] | c, hit[2] * ok
            else:
                groups.append([[go], c, ok])
        want |= {(g, m[0]): (m, len(c), ok) for m, c, ok in groups}
    got = {(r.gene_no, r.go_no): ([int(x) for x in r.members.split()], r.genes, r.is_correct) for r in merged_contexts(spark, sf).collect()}
    assert got == want and any(ok == -1 for _, _, ok in want.values())


def test_gradients_by_hand(spark):
    """A star with one edge between its leaves: gene 1 in the middle, 2 and 3 have function 7, 4 has another one, 5 is unknown."""
    edges = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 3), (0, 4, 5)], "mcl_id int, g1 int, g2 int")
    f = spark.createDataFrame([(2, 7), (3, 7), (4, 8)], "gene_no int, go_no int")
    around = scoring.layers(edges, 5)
    assert {(r.v, r.layer) for r in around.where("gene_no = 1").collect()} == {(1, 0), (2, 1), (3, 1), (4, 1), (5, 2)}
    chosen = spark.createDataFrame([(0, 1, 7)], "mcl_id long, gene_no int, go_no int")
    one = lambda df: df.where("gene_no = 1 AND go_no = 7").first()["score"]
    assert math.isclose(one(scoring.vertex_gradient(around, chosen, f)), 3 + 3 - 1 + 0 / 16)
    assert math.isclose(one(scoring.layer_gradient(around, chosen, f)), 5 / (3**0.8 * 4) + 0 / 16)
    # key 1: three edges to the middle, 3 + 3 - 1; key 2: the edge 2-3, 6; key 3: the edge 4-5, -1
    want = 5 / 3**0.6 + 6 / (3**0.8 * 4) - 1 / (3**0.8 * 9)
    assert math.isclose(one(scoring.edge_gradient(edges, around, chosen, f)), want)
    for p, factor in ((0.1, 1), (0.01, 2), (None, 0), (0.0, 0)):
        weighted = edges.withColumn("p", F.lit(p).cast("double"))
        assert math.isclose(one(scoring.edge_gradient(weighted, around, chosen, f, p_value="p")), factor * want, abs_tol=1e-12)
    mixed = edges.unionByName(spark.createDataFrame([(0, 2, 4)], "mcl_id int, g1 int, g2 int"))
    near = scoring.layers(mixed, 5)
    plain, skipped = (one(scoring.edge_gradient(mixed, near, chosen, f, skip_mixed=s)) for s in (False, True))
    assert math.isclose(plain - skipped, 2 / (3**0.8 * 4))


def test_planted_bicluster(spark):
    rng = np.random.default_rng(6)
    m = rng.uniform(-5, 5, (60, 12))
    m[10:30, 2:9] = rng.normal(size=(20, 1)) + rng.normal(size=(1, 7)) + rng.normal(0, 0.01, (20, 7))
    df = spark.createDataFrame([(1, i, [float(x) for x in r]) for i, r in enumerate(m)], "f int, k int, v array<double>")
    first = biclusters.biclusters(df, "f", "k", "v", 0.05, batch=1_000).where("no = 0").collect()
    assert {r["key"] for r in first} >= set(range(12, 28)) and all(set(r["columns"]) <= set(range(2, 9)) and r["score"] <= 0.05 for r in first)
    rows, columns, score = kernels.find_bicluster(m, 0.05, 1_000, 5, 4)
    r = m[np.ix_(rows, columns)]
    assert math.isclose(score, np.mean([(r[i, j] - r[i].mean() - r[:, j].mean() + r.mean()) ** 2 for i in range(len(rows)) for j in range(len(columns))]), rel_tol=1e-9)


def test_fuzzy_cores(spark):
    clique = [(a, b) for a in range(1, 6) for b in range(a + 1, 6)]
    rows = [(0, d, a, b) for d in (1, 2, 3) for a, b in clique] + [(0, 1, 5, 9), (0, 2, 8, 9), (0, 4, 1, 2), (0, 4, 2, 3)]
    rows = [r for r in rows if not (r[1] == 2 and 5 in r[2:])]
    edges = spark.createDataFrame(rows, "mcl_id int, dataset_no int, g1 int, g2 int")
    recurrent = spark.createDataFrame([(0, 1), (0, 2), (0, 4)], "mcl_id int, dataset_no int")
    assert [tuple(r) for r in kernels.fuzzy_cores(edges, recurrent).collect()] == [(0, [1, 2, 3, 4], [1, 2, 3])]


def test_many_contexts_of_a_gene(spark):
    """300 functions with 1,000 genes each: folded without rewriting the groups at every item."""
    rows = spark.range(300).selectExpr("1 AS gene_no", "cast(id AS int) AS go_no", "sequence(cast(id * 400 AS int), cast(id * 400 + 999 AS int)) AS context", "1 AS is_correct")
    plan = scoring.merge_contexts(rows, 0.3)
    assert "aggregate(" not in plan._jdf.queryExecution().toString()
    got = plan.selectExpr("go_no", "size(members) AS n", "size(context) AS c").collect()
    assert sorted(map(tuple, got)) == [(i, 1, 1000) for i in range(300)]


def test_tails_are_computed_after_the_grouping(spark):
    """A filter on the tails isn't moved below the grouping, where it would compute one for each row."""
    rows = spark.range(50).selectExpr("id AS c", "id % 3 AS x", "5L AS m", "4L AS k")
    found = T.with_tail(rows, 20).where("p <= 0.9")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Aggregate [x", 1)  # below: what the grouping reads
    assert "greatest(" in above and "greatest(" not in below
    got, x1 = found.collect(), 1 - math.comb(15, 4) / math.comb(20, 4)
    assert len(got) == 33 and all(math.isclose(r.p, x1 if r.x == 1 else x1 - 5 * math.comb(15, 3) / math.comb(20, 4)) for r in got)
