"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Every row gets its physical partition and place once (written to the shared folder, so that a lost executor can't deal
   them anew).
2. The driver draws, from the partitions' row counts alone, how many rows each partition sends to each shard: partition
   after partition a multivariate hypergeometric draw from the places that the shards have left. Row and column sums are
   exact, so shard sizes differ by one row at most (law ``rows``).
3. Each partition is permuted (random keys, seeded), and its first rows go to shard 0, the next to shard 1, and so on.
4. After the exchange each shard is permuted again: rows get fresh random keys, are dealt to blocks by the key's high bits
   and ranked inside a block; a block's offset is the sum of the counts before it, so slots are gapless.

Only counts reach the driver: partitions x shards numbers, and blocks x shards numbers. No task holds a shard: windows run
inside a partition or a block. Equal texts and hot sources don't matter, as no key of the data deals rows.

Defined results: null text has size 1 and CRC 0; repeated rows are separate rows; an empty table gives no rows; extra
columns are ignored; fewer rows than shards leaves some shards empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweft.llm.common import materialise


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[p, s]: rows that partition p sends to shard s; columns sum to shard sizes that differ by one at most."""
    total = int(sum(rows))
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(rows), shards), dtype=np.int64)
    for p, n in enumerate(rows):
        remaining = n
        pool = int(left.sum())
        for s in range(shards - 1):  # one hypergeometric draw per shard, given the draws before
            out[p, s] = rng.hypergeometric(left[s], pool - left[s], remaining) if remaining and pool else 0
            pool -= int(left[s])
            remaining -= int(out[p, s])
        out[p, shards - 1] = remaining
        left -= out[p]
    return out


def shuffle_to_shards(docs: DataFrame, shards: int = 8, seed: int = 20_11, rows_per_block: int = 65_536) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("at"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = materialise(rows, "shard-rows").withColumn("part", F.shiftrightunsigned("at", 33).cast("int"))
    counts = rows.groupBy("part").count().orderBy("part").collect()
    matrix = communication_matrix([r["count"] for r in counts], shards, seed)
    ends = np.cumsum(matrix, axis=1)
    dealt = spark.createDataFrame([(int(r["part"]), [int(x) for x in e]) for r, e in zip(counts, ends)], "part int, ends array<long>")

    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "at"), "at")
    placed = rows.withColumn("rank", F.row_number().over(local)).join(dealt, "part")
    placed = placed.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))

    total = int(matrix.sum())
    bits = max(0, int(np.ceil(np.log2(max(1, total / shards / rows_per_block)))))
    key = F.xxhash64(F.lit(seed + 1), "at")
    block = F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)
    keyed = placed.select("doc_id", "size", "text_crc32", "shard", "at", key.alias("key"), block.alias("block"))
    # Which blocks a row falls into follows from (at, shard) alone, so the counts can be had from a second pass.
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("shard", "block").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("shard", "block").orderBy("key", "at")
    return (
        keyed.withColumn("place", F.row_number().over(inside))
        .join(offsets, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"))
    )


def digest(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
