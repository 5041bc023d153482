"""Tails of discrete distributions as column expressions over a table of log factorials, and tests built on them.

The session's SQL has no log-gamma function. ln n! is taken from Stirling's series with terms up to n^-9, shifted so that it
is exact to 1e-12 for every n >= 0: a plain expression inside whole-stage code, without a table to broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweft.operators.ranking import running_sums
from netweft.operators.tables import dealt

HALF_LOG_TAU = 0.9189385332046727


def log_factorial(n: Column) -> Column:
    """ln n! for n >= 0: Stirling's series at n + 9, less the logarithms of the factors in between."""
    x = n.cast("double") + 9.0
    x2 = x * x
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / x2) / x2) / x2) / x2) / x
    top = (x + 0.5) * F.log(x) - x + HALF_LOG_TAU + series
    m = n.cast("double")
    between = F.log((m + 1) * (m + 2) * (m + 3)) + F.log((m + 4) * (m + 5) * (m + 6)) + F.log((m + 7) * (m + 8) * (m + 9))
    return top - between


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def _ratios(first: Column, last: Column, step: int, ratio) -> Column:
    """1 + r(first) + r(first) r(first + step) + ... up to the term before ``last``: terms of a tail relative to its first one.
    ``ratio(i)`` leads from term i to term i + step."""
    more = F.when((last - first) * step >= 1, F.sequence(first.cast("int"), (last - step).cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))

    def add(s: Column, i: Column) -> Column:
        t = s["t"] * ratio(i.cast("double"))
        return F.struct(t.alias("t"), (s["sum"] + t).alias("sum"))

    return F.aggregate(more, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("sum")), add, lambda s: s["sum"])


def hypergeometric_tail(x: Column, marked: Column, drawn: Column, total: Column) -> Column:
    """P(X >= x) where ``drawn`` of ``total`` are taken and ``marked`` of the total carry the mark.

    The tail away from the mean is summed, each term from the one before.
    """
    m, k, n = (c.cast("double") for c in (marked, drawn, total))
    low, high = F.greatest(F.lit(0), drawn - (total - marked)), F.least(drawn, marked)
    log_p = lambda i: log_choose(marked, i) + log_choose(total - marked, drawn - i) - log_choose(total, drawn)
    up = F.exp(log_p(x)) * _ratios(x, high, 1, lambda i: (m - i) * (k - i) / ((i + 1) * (n - m - k + i + 1)))
    down = F.exp(log_p(x - 1)) * _ratios(x - 1, low, -1, lambda i: i * (n - m - k + i) / ((m - i + 1) * (k - i + 1)))
    return F.when(x <= low, 1.0).when(x > high, 0.0).when(x * n > m * k, F.least(up, F.lit(1.0))).otherwise(F.greatest(1 - down, F.lit(0.0)))


def binomial_log_tail(x: Column, n: Column, p: Column) -> Column:
    """ln P(X >= x) of a binomial, from the tail away from the mean."""
    size, odds = n.cast("double"), p / (1 - p)
    up = binomial_log_density(x, n, p) + F.log(_ratios(x, n, 1, lambda i: (size - i) / (i + 1) * odds))
    down = F.exp(binomial_log_density(x - 1, n, p)) * _ratios(x - 1, F.lit(0), -1, lambda i: i / ((size - i + 1) * odds))
    inside = F.when(x > size * p, F.least(up, F.lit(0.0))).otherwise(F.log1p(-F.least(down, F.lit(1.0))))
    return F.when(x <= 0, 0.0).when((x > n) | (p <= 0), F.lit(float("-inf"))).when(p >= 1, 0.0).otherwise(inside)


def with_tail(rows: DataFrame, total: int, x: str = "x", m: str = "m", k: str = "k") -> DataFrame:
    """``rows`` with p, the hypergeometric tail: computed once for each of the few distinct (x, m, k).

    It reads aggregated copies of the three: a filter on p that read the keys themselves would be moved below the grouping by the
    optimiser and compute a tail for each row. They are few bytes but dear, so they are dealt to all cores.
    """
    distinct = dealt(rows.select(x, m, k).distinct(), x, m, k, rows=0).groupBy(x, m, k).agg(*[F.max(c).alias(f"__{i}") for i, c in enumerate((x, m, k))])
    tail = hypergeometric_tail(*[F.col(f"__{i}") for i in range(3)], F.lit(total).cast("long"))
    return rows.join(distinct.select(x, m, k, tail.alias("p")), [x, m, k])


def binomial_log_density(x: Column, n: Column, p: Column) -> Column:
    return log_choose(n, x) + x * F.log(p) + (n - x) * F.log(1 - p)


def fisher_two_sided(tables: DataFrame, keys: list[str], within: int = 5_000) -> DataFrame:
    """``keys``, p: two-sided exact p-values of 2x2 tables (a, b, c, d; one a key): probabilities not above that of the table are added.

    A table has as many terms as its counts are large, so they are cut into pieces of ``within`` terms, which are dealt to tasks.
    """
    a, n, row, col = F.col("a"), F.col("a") + F.col("b") + F.col("c") + F.col("d"), F.col("a") + F.col("b"), F.col("a") + F.col("c")
    # what all terms of a table have in common is found once, which keeps the expression of a term small enough to be compiled
    same = log_factorial(row) + log_factorial(n - row) + log_factorial(col) + log_factorial(n - col) - log_factorial(n)
    sides = tables.select(*keys, a.alias("__a"), n.alias("__n"), row.alias("__row"), col.alias("__col"), same.alias("__same"))
    n, row, col = (F.col(f"__{k}") for k in ("n", "row", "col"))
    p = lambda i: F.col("__same") - log_factorial(i) - log_factorial(row - i) - log_factorial(col - i) - log_factorial(n - row - col + i)
    own = (p(F.col("__a")) + math.log(1 + 1e-7)).alias("__own")
    starts = F.explode(F.sequence(F.greatest(F.lit(0), col - (n - row)), F.least(row, col), F.lit(within).cast("long"))).alias("__from")
    pieces = dealt(sides.select(*keys, "__n", "__row", "__col", "__same", own, starts), *keys, "__from", rows=0)
    terms = pieces.select("*", F.explode(F.sequence("__from", F.least(F.col("__from") + (within - 1), row, col))).alias("__i"))
    added = F.sum(F.when(p(F.col("__i")) <= F.col("__own"), F.exp(p(F.col("__i")))).otherwise(0.0))
    return terms.groupBy(*keys).agg(F.least(added, F.lit(1.0)).alias("p"))


def enrichment(members: DataFrame, associations: DataFrame, total: int, leave_one_out: bool = True) -> DataFrame:
    """mcl_id, go_no, gene_no (null without leave-one-out), x, m, k and p of every function in every cluster.

    With ``leave_one_out`` the gene itself is taken out of x and m where it has the function; k (cluster size) and the
    number of genes stay. Functions of one gene only are left out.
    """
    sizes = associations.groupBy("go_no").agg(F.countDistinct("gene_no").alias("m")).where("m > 1")
    k = members.groupBy("mcl_id").agg(F.count("*").alias("k"))
    local = members.join(associations, "gene_no").groupBy("mcl_id", "go_no").agg(F.count("*").alias("x"))
    scored = local.join(sizes, "go_no").join(k, "mcl_id")
    if not leave_one_out:
        return with_tail(scored, total).select("mcl_id", "go_no", F.lit(None).cast("long").alias("gene_no"), "x", "m", "k", "p")
    has = associations.select("gene_no", "go_no", F.lit(1).alias("own"))
    each = scored.join(members, "mcl_id").join(has, ["gene_no", "go_no"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    each = each.withColumns({"x": F.col("x") - F.col("own"), "m": F.col("m") - F.col("own")})
    return with_tail(each, total).select("mcl_id", "go_no", "gene_no", "x", "m", "k", "p")


def two_sample_ks(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """d: largest distance of the two empirical distribution functions, by running sums over the distinct values."""
    both = a.select(F.col(value).alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(F.col(value).alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    s = both.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    n = s.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    run = running_sums(s, ["v"], ["x", "y"]).select(F.col("x").alias("cx"), F.col("y").alias("cy")).crossJoin(n)
    return run.agg(F.max(F.abs(F.col("cx") / F.col("nx") - F.col("cy") / F.col("ny"))).alias("d"))


def welch(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """by, t and df of Welch's test between rows of group 1 and group 0."""
    g = lambda i, f: f(F.when(F.col(group) == i, F.col(value)))
    s = df.groupBy(*by).agg(*[g(i, f).alias(f"{n}{i}") for i in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    e0, e1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    t = (F.col("m1") - F.col("m0")) / F.sqrt(e0 + e1)
    freedom = (e0 + e1) * (e0 + e1) / (e0 * e0 / (F.col("n0") - 1) + e1 * e1 / (F.col("n1") - 1))
    return s.where("n0 > 1 AND n1 > 1 AND v0 + v1 > 0").select(*by, t.alias("t"), freedom.alias("df"))
