"""Long sequences kept as chunks of equal length, and segments cut out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunked(sequences: DataFrame, key: str, sequence: str, size: int) -> DataFrame:
    """key, chunk (from 0) and piece of every sequence."""
    last = F.greatest(F.ceil(F.length(sequence) / size) - 1, F.lit(0)).cast("int")
    each = sequences.select(key, sequence, F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return each.select(key, "chunk", F.substring(F.col(sequence), F.col("chunk") * size + 1, F.lit(size)).alias("piece"))


def segments(chunks: DataFrame, asked: DataFrame, key: str, size: int) -> DataFrame:
    """key, start, stop and segment (positions from 1, both ends included); reversed where start lies behind stop.

    Only the chunks that a segment touches are joined; what lies past the end of a sequence is left out.
    """
    low, high = F.least("start", "stop"), F.greatest("start", "stop")
    needed = asked.select(key, "start", "stop", F.explode(F.sequence(F.floor((low - 1) / size).cast("int"), F.floor((high - 1) / size).cast("int"))).alias("chunk"))
    met = needed.join(chunks, [key, "chunk"]).groupBy(key, "start", "stop").agg(F.array_sort(F.collect_list(F.struct("chunk", "piece"))).alias("c"))
    whole = F.array_join(F.transform("c", lambda x: x["piece"]), "")
    cut = F.substring(whole, low - F.get("c", F.lit(0))["chunk"] * size, high - low + 1)
    return met.select(key, "start", "stop", F.when(F.col("start") > F.col("stop"), F.reverse(cut)).otherwise(cut).alias("segment"))
