"""Compression of vectors to short codes: a codebook for each of 16 parts, learned by rounds over columnar blocks.

1. Vectors become integers, floor(256 * x), and are laid down as blocks: a row of the written table holds some thousand
   vectors as one NumPy array with a line for each dimension, beside their ids and labels.
2. A round is one ``treeAggregate`` over the RDD of blocks. For each part a task accumulates the squared distances to all
   entries dimension by dimension, takes the nearest entry (ties: the lower index), and adds the components to int64 tensors
   of sums and counts with ``np.add.at``. Tensors, whose size doesn't depend on the input, are merged through a reduction tree.
3. The driver divides: entries become componentwise floor(sum / count); those that nothing chose stay.
4. A last pass assigns all parts and emits codes and errors; errors are summed by label into a small written table.

Integers make every figure exact: no result depends on partitions, on the order of merging or on retried tasks. Blocks live
in the shared folder, so a lost executor costs its tasks alone. A hot label meets its sum by a join with a table of one row a
label, whose other side adaptive execution can split.

Defined results: rows whose vector is null, or has a null, NaN or infinite component, are dropped; so are vectors of another
length than the table's most frequent (ties: the longer), which can't be cut alike; that length has to be a multiple of the
parts, and the integers below 2^27, else a ValueError says so. Null ids come last when the first entries are chosen, and
rows of one id in the order of their vectors; fewer vectors than entries give a smaller codebook; null labels are equal;
rows that repeat are separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweft.llm.common import materialise

LIMIT = 1 << 27  # squared distances of 2^9 dimensions stay within 64 bits


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (doubles): rows with a whole, finite vector of the table's length."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.select("vec_id", "label", v.alias("v")).where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    length = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    return whole.join(F.broadcast(length.select("d")), F.size("v") == F.col("d")).drop("d")  # one row


def _integers(v: np.ndarray) -> np.ndarray:
    out = np.floor(256 * v)
    if len(out) and np.abs(out).max() >= LIMIT:
        raise ValueError(f"components have to be below {LIMIT >> 8}")
    return out.astype(np.int32)


def _lay_down(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                v = part.column(2)
                block = _integers(v.flatten().to_numpy(zero_copy_only=False)).reshape(len(part), -1).T
                one = pa.array([0, len(part)], pa.int32())
                lists = [pa.ListArray.from_arrays(one, part.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([np.ascontiguousarray(block).tobytes()], pa.binary())], ["ids", "labels", "block"])

    return run


def columns(block: bytes, n: int) -> np.ndarray:
    """The block as an array with a line for each dimension."""
    return np.frombuffer(block, np.int32).reshape(-1, n) if n else np.zeros((0, 0), np.int32)


def assign(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry for every (part, vector). ``books``: part, entry, position."""
    parts, entries, width = books.shape
    at, far = np.empty((parts, block.shape[1]), np.int64), np.empty((parts, block.shape[1]), np.int64)
    for p in range(parts):
        distance = np.zeros((block.shape[1], entries), np.int64)
        for j in range(width):
            distance += (block[p * width + j].astype(np.int64)[:, None] - books[p, :, j]) ** 2
        at[p] = distance.argmin(axis=1)
        far[p] = np.take_along_axis(distance, at[p][:, None], 1)[:, 0]
    return at, far


def _add(books: np.ndarray):
    """Adds a block to the tensors (sums, counts); None stands for zeros."""

    def run(held, block):
        parts, entries, width = books.shape
        sums, counts = held or (np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64))
        at, _ = assign(block, books)
        for p in range(parts):
            np.add.at(counts[p], at[p], 1)
            np.add.at(sums[p], at[p], block[p * width : (p + 1) * width].T.astype(np.int64))
        return sums, counts

    return run


def _merge(a, b):
    return a if b is None else b if a is None else (a[0] + b[0], a[1] + b[1])


def train(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after ``rounds`` rounds over all blocks."""
    rdd = blocks.rdd.map(lambda r: columns(r["block"], len(r["ids"])))
    for _ in range(rounds):
        found = rdd.treeAggregate(None, _add(books), _merge, depth=2)
        if found:
            sums, counts = found
            books = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
    return books


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                at, far = assign(columns(batch.column(2)[i].as_py(), len(ids)), books)
                text = [bytes(x).hex() for x in at.T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(far.sum(axis=0))], ["vec_id", "label", "code", "error"])

    return run


def first_books(spark: SparkSession, rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Part, entry, position: the parts of the ``entries`` vectors with the smallest ids."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    v = _integers(np.array([r["v"] for r in first])).astype(np.int64)
    if v.shape[1] % parts or not v.shape[1]:
        raise ValueError(f"vectors of {v.shape[1]} components can't be cut into {parts} equal parts")
    return v.reshape(len(v), parts, -1).transpose(1, 0, 2)


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, block_rows: int = 4_096) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every kept row, a written table; the codebooks). At most 256 ``entries``, as an index
    takes two hex digits."""
    spark, rows = vectors.sparkSession, kept(vectors)
    types = {f.name: f.dataType for f in rows.schema.fields}
    kind = T.StructType([T.StructField("vec_id", types["vec_id"]), T.StructField("label", types["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if rows.isEmpty():
        return spark.createDataFrame([], kind), np.zeros((parts, 0, 0), np.int64)
    books = first_books(spark, rows, parts, entries)
    laid = T.StructType([T.StructField("ids", T.ArrayType(types["vec_id"])), T.StructField("labels", T.ArrayType(types["label"])), T.StructField("block", T.BinaryType())])
    blocks = materialise(rows.mapInArrow(_lay_down(block_rows), laid), "vector-blocks")
    books = train(blocks, books, rounds)
    return materialise(blocks.mapInArrow(_codes(books), kind), "vector-codes"), books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def digest(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code, error, label_error and the hash of the codebooks."""
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "l")
    met = coded.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Nearest entries and the codebooks of the next round, as SQL."""
    return f"""
a{k} AS (SELECT row, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (
  SELECT row, x.part, entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM x JOIN b{k} b USING (part)) GROUP BY row, part),
s{k} AS (SELECT part, a{k}.entry, i, sum(x.v[i]) AS s, count(*) AS n FROM a{k} JOIN x USING (row, part), (SELECT unnest(range(1, (SELECT max(len(v)) FROM x) + 1)) AS i) GROUP BY ALL),
b{k + 1} AS (SELECT part, entry, coalesce(any_value(n.v), any_value(b.v)) AS v FROM b{k} b LEFT JOIN
  (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{k} GROUP BY part, entry) n USING (part, entry) GROUP BY part, entry)"""


ORACLE = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS (SELECT row, p AS part, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM k, (SELECT unnest(range(0, 16)) AS p)),
b0 AS (SELECT part, row - 1 AS entry, v FROM x WHERE row <= 64),{_round(0)},{_round(1)},{_round(2).split("s2 AS")[0].rstrip().rstrip(",")},
h AS (SELECT sha256(string_agg(c, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM (SELECT part, entry, array_to_string(v, ',') AS c FROM b2)),
e AS (SELECT row, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN e USING (row), h"""
