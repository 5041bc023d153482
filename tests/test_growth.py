"""Patterns that grow, draws, index strings and look-ups against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweft.operators import annotation, growth, sampling, tables
from netweft.operators import ontology as O


def random_graph(seed, n, m):
    rng = np.random.default_rng(seed)
    return {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(m)}


def near_of(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return near


def smallest_path(near, s, t):
    """Edges of the path that steps back from t to the smallest vertex nearer to s; none if there is no path."""
    far, queue = {s: 0}, deque([s])
    while queue:
        a = queue.popleft()
        for b in near[a]:
            if b not in far:
                far[b] = far[a] + 1
                queue.append(b)
    out = set()
    while t in far and t != s:
        before = min(b for b in near[t] if far.get(b) == far[t] - 1)
        out.add((min(t, before), max(t, before)))
        t = before
    return out


def test_augmented_patterns(spark):
    edges = random_graph(3, 40, 45)
    near = near_of(edges)
    rng = np.random.default_rng(4)
    patterns = {p: sorted({int(x) for x in rng.choice(50, 5)}) for p in range(12)}
    rows = [(p, g) for p, gs in patterns.items() for g in gs] + [(0, patterns[0][0]), (99, None), (98, 1)]
    e = spark.createDataFrame([(b, a) if (a + b) % 2 else (a, b) for a, b in edges] + [(7, 7), (None, 3)], "g1 long, g2 long")
    got = defaultdict(set)
    for r in growth.augmented(spark.createDataFrame(rows, "p int, g long"), e, "p", "g").collect():
        assert (r["g1"], r["g2"]) not in got[r["p"]]
        got[r["p"]].add((r["g1"], r["g2"]))
    for p, genes in patterns.items():
        inside = [g for g in genes if g in near]
        want = set().union(*(smallest_path(near, a, b) for i, a in enumerate(inside) for b in inside[i + 1 :]), set())
        assert got[p] == want
    assert any(len(x) > 6 for x in got.values()) and not got[98]
    assert growth.augmented(spark.createDataFrame([], "p int, g long"), e, "p", "g").count() == 0


def test_star_seeds(spark):
    edges, rng = random_graph(5, 30, 70), np.random.default_rng(6)
    members = {f: sorted({int(x) for x in rng.choice(30, 18)}) for f in range(3)}
    want = {}
    for f, genes in members.items():
        near, left = near_of([e for e in edges if set(e) <= set(genes)]), set(genes)
        for g in genes:
            if g in left:
                star = ({g} | near[g]) & left
                left -= star
                if len(star) >= 3:
                    want[f, g] = star
    e = spark.createDataFrame(sorted(edges), "g1 long, g2 long")
    m = spark.createDataFrame([(f, g) for f, gs in members.items() for g in gs] + [(0, None), (1, members[1][0])], "go_no int, gene_no long")
    got = defaultdict(set)
    for r in growth.star_seeds(e, m, "go_no", 3).collect():
        got[r["go_no"], r["centre"]].add(r["gene"])
    assert dict(got) == want
    assert growth.star_seeds(e, m.limit(0), "go_no", 3).count() == 0


@pytest.mark.parametrize("rounds", [1, None])
def test_seeds_grow_to_the_fixed_point(spark, rounds):
    edges = random_graph(7, 60, 240)
    near = near_of(edges)
    seeds = {s: {int(x) for x in list(near[s])[:4]} | {s} for s in (1, 5, 9, 13)}
    want = {}
    for s, genes in seeds.items():
        now, no = {g: 0 for g in genes}, 0
        while rounds is None or no < rounds:
            no += 1
            held = set(now)
            new = [v for v in near if v not in held and (x := len(near[v] & held)) >= 2 and x >= 0.25 * len(held) and x >= 0.2 * len(near[v])]
            if not new:
                break
            now |= dict.fromkeys(new, no)
        want[s] = now
    df = spark.createDataFrame([(s, g) for s, gs in seeds.items() for g in gs] + [(1, None)], "s int, gene long")
    got = defaultdict(dict)
    for r in growth.grown(df, spark.createDataFrame(sorted(edges), "g1 long, g2 long"), ["s"], 2, 0.25, 0.2, rounds).collect():
        got[r["s"]][r["gene"]] = r["round"]
    assert dict(got) == want and any(max(x.values()) >= 1 for x in want.values())


def test_index_strings_agree_with_terms_on_a_tree(spark):
    """Where every term has one path, the lowest indexes of enough genes are the informative terms."""
    edges = [(n // 2, n) for n in range(2, 40)]
    e = spark.createDataFrame(edges, "parent int, child int")
    genes = [(g, 1 + (g * 7) % 39) for g in range(400)] + [(5, 7), (5, 7)]
    a = spark.createDataFrame(genes, "gene_no int, go_no int")
    p = O.all_paths(e, 1)
    sizes = O.closed_genes(O.closure(p), a).groupBy("go_no").agg(F.count("*").alias("size"))
    want = {r["go_no"] for r in O.informative(e, sizes, 25).collect()}
    got = O.informative_indexes(O.index_strings(p), a, 25).collect()
    assert {r["go_no"] for r in got} == want and len(got) == len(want)
    size = {r["go_no"]: r["size"] for r in sizes.collect()}
    assert all(size[r["go_no"]] == r["genes"] for r in got)


def test_draws_are_without_replacement(spark):
    rows = spark.createDataFrame([("a", i, i % 2) for i in range(2_000)] + [("b", i, 1) for i in range(30)] + [("c", i, 0) for i in range(9)], "k string, i int, x int")
    got = Counter((r["k"], r["draw"]) for r in sampling.repeated_draws(rows, "k", ["i"], 5, 20, 1).collect())
    assert got == {(k, d): 20 for k in "ab" for d in range(5)}
    pairs = sampling.repeated_draws(rows.repartition(7), "k", ["i"], 5, 20, 1)
    assert pairs.select("k", "draw", "i").distinct().count() == 200
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, sampling.repeated_draws(rows, "k", ["i"], 5, 20, 1).collect()))
    every = Counter(r["i"] for r in sampling.repeated_draws(rows.where("k = 'b'"), "k", ["i"], 300, 10, 2).collect())
    assert len(every) == 30 and all(60 < n < 145 for n in every.values())
    shares = {(r["k"], r["draw"]): r["x"] for r in sampling.shares_of_draws(rows, "k", ["i"], ["x"], 5, 20, 1).collect()}
    assert shares["c", None] is None and shares["b", 3] == 1.0 and len(shares) == 11
    b = {r["k"]: r for r in sampling.band(sampling.shares_of_draws(rows, "k", ["i"], ["x"], 5, 20, 1), "k", "x").collect()}
    assert b["a"]["low"] < b["a"]["mean"] < b["a"]["high"] and "c" not in b


def test_organisms(spark):
    taxonomy = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (3, None)], "tax_id int, organism string")
    rows = spark.createDataFrame([(1,), (2,), (9,), (None,)], "tax_id int")
    assert Counter(map(tuple, annotation.organism_of(rows, taxonomy).collect())) == Counter([(1, "a"), (2, "a"), (9, None), (None, None)])
    back = annotation.tax_id_of(spark.createDataFrame([("a",), ("z",), (None,)], "organism string"), taxonomy).collect()
    assert Counter(map(tuple, back)) == Counter([("a", 1), ("z", None), (None, None)])


@pytest.mark.parametrize("name", ["g10_first_growth", "g15_augmented_patterns", "o7_index_strings", "f26_organisms"])
def test_growth_query_matches_sql(spark, sf, name):
    from tests.test_library import test_query_matches_sql

    test_query_matches_sql(spark, sf, name)


def test_cliques_from_vectors(spark):
    """As by joins of edges, in one block and in several, with missing values; counted and listed."""
    import numpy as np

    from netweft.operators import cliques, correlation, graphs

    rng = np.random.default_rng(6)
    rows = [(d, g, [None if g % 11 == 0 and i == 2 else float(x) for i, x in enumerate(rng.normal(size=8))]) for d in range(3) for g in range(60)]
    x = spark.createDataFrame(rows, "dataset_no int, gene_no long, v array<double>")
    edges = correlation.gene_pairs(x, ("cor",), lambda found, _: (found["cor"].round(9) >= 0.3) & (found["cor"] <= 1)).select("dataset_no", "g1", "g2")
    want = Counter((r.a, r.b, r.c) for r in graphs.triangles(edges, ["dataset_no"]).collect())
    for blocks in (1, 3):
        got = cliques.cliques(x, [0, 1, 2], 0.3, blocks).collect()
        assert len(got) == len(want) > 100 and {(r.a, r.b, r.c): r.freq for r in got} == want
        assert {r.freq: r["rows"] for r in cliques.clique_counts(x, [0, 1, 2], 0.3, blocks).collect()} == Counter(want.values())


def test_tasks_grow_with_the_table(spark):
    """A table of ten times the rows is dealt to more tasks, not to larger ones; equal keys stay together."""
    df = spark.range(10_000).select((F.col("id") % 500).alias("k"), "id")
    dealt = tables.dealt(df, "k", rows=10_000, within=250)
    assert dealt.rdd.getNumPartitions() == 40
    assert tables.dealt(df, "k", rows=0).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert dealt.select("k", F.spark_partition_id().alias("p")).distinct().count() == 500


def test_growth_deals_the_links_that_it_meets(spark, monkeypatch):
    """Repeated and turned edges count once, and the links met are dealt by their exact number before they are counted."""
    edges = random_graph(5, 30, 120)
    rows = [e for e in sorted(edges) for _ in range(2)] + [(b, a) for a, b in edges] + [(4, 4), (None, 1)]
    seeds = spark.createDataFrame([(s, g) for s in range(3) for g in range(s, 30, 3)], "s int, gene long")
    met, deal = [], growth.dealt
    monkeypatch.setattr(growth, "dealt", lambda df, *keys, **how: met.append((keys, how.get("rows"))) or deal(df, *keys, **how))
    got = growth.grown(seeds, spark.createDataFrame(rows, "g1 long, g2 long"), ["s"], 2, 0.1, 0.3, 1, pairs=len(rows))
    want = growth.grown(seeds, spark.createDataFrame(sorted(edges), "g1 long, g2 long"), ["s"], 2, 0.1, 0.3, 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert (("s", "gene"), 2 * len(edges)) in met and (("g1", "g2"), len(rows)) in met


def test_digests_of_many_texts():
    """Against hashlib: draws of one and two digits, numbers of all lengths."""
    import hashlib

    from netweft.functions import digest

    rng = np.random.default_rng(5)
    ids = np.unique(10 ** rng.integers(0, 9, 60) + rng.integers(0, 9, 60))
    names = np.sort(rng.integers(0, len(ids), (300, 3)), axis=1)
    text, sizes = digest.digits_of(ids)
    bounds = rng.integers(0, 2**32, len(names)).astype(np.uint32)
    got = {(d, i) for d, at in digest.near(names, text, sizes, bounds, 11, 12, 40) for i in at.tolist()}
    head = lambda d, i: int(hashlib.md5(f"11:{d}:{':'.join(str(x) for x in ids[names[i]])}".encode()).hexdigest()[:8], 16)
    assert got == {(d, i) for d in range(12) for i in range(300) if head(d, i) <= bounds[i]} and len(got) > 1_000


def test_triangles_near_a_draw(spark, sf, monkeypatch):
    """The same draws whether the kernel or Spark looks at the triangles; few leave the kernel."""
    from netweft.operators import cliques
    from netweft.plans import adapters

    x = adapters.expression(spark, sf).where("gene_no < 130")
    rows, counts = cliques.cliques(x, list(range(8)), 0.55), cliques.clique_counts(x, list(range(8)), 0.55)
    near = lambda bounds, draws, seed: cliques.near_cliques(x, list(range(8)), 0.55, bounds, draws, seed)
    want, got = (sampling.repeated_draws(rows, "freq", ["a", "b", "c"], 12, 40, 11, counts, n) for n in (None, lambda b: near(b, 12, 11)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert near({1: 2**28}, 12, 11).count() < rows.count()
