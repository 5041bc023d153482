"""Labelled rows to learn from: a bounded sample by class, the same on every run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int) -> DataFrame:
    """text and label (0 or 1) of at most ``per_class`` rows a class outside the held-out remainder.

    Rows are taken in the order of a hash of the id, so the choice doesn't depend on partitions. The ids chosen are at most
    2 * ``per_class``, which bounds the broadcast.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(remainder(F.col("doc_id"), modulus) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    # labels may cover ids that the table doesn't have
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # of rows that repeat an id one text counts, so that the bound holds
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def add_score(docs: DataFrame, scored, modulus: int, held_out: int, threshold: float = 0.7, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns to ``carry``, from a mapper that turns the text, the last of its
    columns, into a score."""
    given = docs.select(*carry, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = T.StructType([*given.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    return given.mapInArrow(scored, kind).select(
        *carry,
        "doc_id",
        (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def with_scores(batch: pa.RecordBatch, z: np.ndarray) -> pa.RecordBatch:
    """The batch with the logistic function of ``z`` instead of its last column."""
    score = pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))), pa.float64())
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), score], [*batch.schema.names[:-1], "score"])
