"""Top-k, best-of-group, cut-offs by accuracy and systematic samples, by windows and ordered limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweft.operators.tables import cut


def top_by_bins(df: DataFrame, by: list[str], value: Column, order: list, limit: Column, scale: float | None = None) -> DataFrame:
    """The first ``limit`` rows of each group by descending ``value``, then ``order``.

    Counts of the values (of their bins of width 1 / ``scale``, if given) tell which bins belong to the top as a whole; only
    rows of the bin where the limit falls are ranked. ``limit`` is an expression over the group's row count ``__n``.
    """
    binned = df.withColumn("__b", value if scale is None else F.floor(value * scale))
    bins = binned.groupBy(*by, "__b").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by)
    down = w.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("__before", F.coalesce(F.sum("__c").over(down), F.lit(0))).withColumn("__n", F.sum("__c").over(w))
    bins = bins.withColumn("__left", limit - F.col("__before")).where("__left > 0").drop("__n", "__before")
    held = binned.join(bins, [*by, "__b"])
    whole = held.where("__left >= __c")
    part = held.where("__left < __c").withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(value.desc(), *order))).where("__r <= __left").drop("__r")
    return whole.unionByName(part).drop("__b", "__c", "__left")


def top_share(df: DataFrame, by: list[str], value: str, order: list, share: float, at_least: int = 0) -> DataFrame:
    """The ``share`` of each group's rows with the largest value (then in an order), but at least ``at_least`` rows."""
    return top_by_bins(df, by, F.col(value), order, F.greatest(F.floor(F.col("__n") * share), F.lit(at_least)))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 1 in a total order: ranges of the order are numbered side by side, and counts of the ranges before are
    added. No task holds more than a range."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    offsets = ranged.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn(name, own).join(offsets, "__p").withColumn(name, F.col(name) + F.col("__o")).drop("__p", "__o")


def running_sums(df: DataFrame, order: list, columns: list[str]) -> DataFrame:
    """``columns`` replaced by their sums up to each row in a total order, range by range as in ``numbered``."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__p").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    totals = totals.select("__p", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns])
    within = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select(*[c for c in ranged.columns if c not in columns], *[F.sum(c).over(within).alias(c) for c in columns])
    return summed.join(totals, "__p").select(*[c for c in df.columns if c not in columns], *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in columns])


def top_edges(edges: DataFrame, n: int, weight: str = "n") -> DataFrame:
    """The n heaviest edges of one graph; ties go to the smaller edge."""
    return edges.orderBy(F.desc(weight), "g1", "g2").limit(n)


def best_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in the order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def first_ties(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """All rows of each key that tie for the first place."""
    return df.withColumn("__r", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def top_ranked(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """Rows of rank k or better in each key (ties at the bound stay)."""
    return df.withColumn("__r", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def accuracy_curve(predictions: DataFrame, value: str, descending: bool = True) -> DataFrame:
    """v, correct, known, accuracy: of the predictions at v or better, each (gene, function) counted at its best value only.

    The running sums go over distinct values, summed up first.
    """
    best = predictions.groupBy("gene_no", "go_no").agg((F.max if descending else F.min)(value).alias("v"))
    at_best = predictions.where("is_correct >= 0").join(best, ["gene_no", "go_no"]).where(F.col(value) == F.col("v"))
    pairs = at_best.groupBy("gene_no", "go_no", "v").agg(F.max("is_correct").alias("c"))
    values = pairs.groupBy("v").agg(F.sum("c").alias("c"), F.count("*").alias("n"))
    run = running_sums(values, [F.desc("v") if descending else F.asc("v")], ["c", "n"])
    return run.select("v", F.col("c").alias("correct"), F.col("n").alias("known")).withColumn("accuracy", F.col("correct") / F.col("known"))


def cut_off(curve: DataFrame, accuracy: float, descending: bool = True) -> DataFrame:
    """The loosest value whose accuracy reaches the target (null if none): lowest of a descending curve, else highest."""
    return curve.where(F.col("accuracy") >= accuracy).agg((F.min if descending else F.max)("v").alias("cut_off"))


def bisected_cut_off(df: DataFrame, value: str, correct: str, key: str, accuracy: float, close: float = 0.001) -> float | None:
    """A value found by halving: rows in the order of (value, correct), the accuracy of those from a place on is compared with
    the target, and the place moves down where it is reached, else up, until it is close or the place stays.

    The last value probed is returned, also if its accuracy is below the target (``cut_off`` gives the exact one). Rows are
    numbered and summed range by range; each of the at most 2 log n probes looks up one row. None without rows.
    """
    named = df.select(F.col(value).alias("v"), F.col(correct).cast("long").alias("hit"), F.col(key).alias("id"))
    named = named.select("*", F.lit(1).cast("long").alias("n"), F.col("hit").alias("c"))
    rows = cut(running_sums(named, [F.desc("v"), F.desc("hit"), F.desc("id")], ["n", "c"]).select("v", "n", "c"), "bisection")
    size = rows.count()
    low, high, place, found = 0, size, size // 2, None
    while size:
        r = rows.where(F.col("n") == size - place).first()
        found, now = r["v"], r["c"] / r["n"]
        low, high = (low, place) if now >= accuracy else (place, high)
        after = (place + low) // 2 if now >= accuracy else (high + place) // 2
        if abs(now - accuracy) <= close or after == place:
            break
        place = after
    return found


def every_kth(df: DataFrame, order: list, k: int) -> DataFrame:
    """Rows k, 2k, 3k ... in an order (a systematic sample)."""
    return numbered(df, order, "__r").where(F.col("__r") % k == 0).drop("__r")


def seeded_order(column: Column | str, seed: int) -> Column:
    """A random-looking order that depends on the value and the seed only."""
    return F.xxhash64(F.lit(seed), F.col(column) if isinstance(column, str) else column)
