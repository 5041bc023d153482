"""A corpus pipeline: toxicity, exact duplicates, near duplicates, decontamination, then encoding.

Every stage takes the documents that the stage before kept and returns documents; the last returns their encodings.

A stage decides by row, not by doc_id: rows have a key that passes through the operator, and its verdict is joined on it.
Where documents are read from Parquet, as between the stages, the key is the row's place in its file, which needs no second
copy of the texts; other DataFrames are written with keys first.

Defined results: rows with a null doc_id or a repeated one are documents like any others; null texts are empty; all empty
texts are one group of exact duplicates, of which one stays, and have no shingles, so no near duplicates; of rows equal in
text and id one stays; columns of documents may have any names besides doc_id and text and come out as they were; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.llm import decontaminate, exact, ngram_join, pieces, toxicity
from netweft.llm.common import materialise, table
from netweft.operators.tables import cut, discard

KEY, DOC = "row_key", "document"


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row as one column that no operator touches."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(DOC))


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """The packed row and its KEY: number of the file (names are as many as files, and on the driver anyway) and row in it."""
    files = [] if "_metadata" in docs.columns else sorted(set(docs.inputFiles()))
    try:
        placed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(DOC), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:  # no Parquet
        files = []
    if not files:
        return materialise(_packed(docs).withColumn(KEY, F.monotonically_increasing_id()), name)
    # file:/x and file:///x are one file
    numbers = docs.sparkSession.createDataFrame([(re.sub("^([^/:]+):/+", r"\1:/", f), i) for i, f in enumerate(files)], "path string, file long")
    placed = placed.withColumn("path", F.regexp_replace("path", "^([^/:]+):/+", "$1:/"))
    number = F.coalesce("file", F.raise_error(F.concat(F.lit("no such input file: "), "path")))
    key = F.shiftleft(number, 40) + F.col("at")
    return placed.join(F.broadcast(numbers), "path", "left").select("doc_id", "text", DOC, key.alias(KEY))


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(f"`{DOC}`.*"))


def _kept(keyed: DataFrame, verdicts: DataFrame, name: str, own: bool = True) -> DataFrame:
    """Documents that the verdicts keep. Their keys are written as bitmaps, a bit a row, and the join sends bitmaps to the
    documents as long as Spark finds them small enough. Tables that the verdicts read are deleted if they are the operator's
    ``own``."""
    bits = verdicts.where("kept").groupBy(F.bitmap_bucket_number(KEY).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(KEY)).alias("bits"))
    kept = cut(bits, name, compression="zstd")
    if own:
        discard(verdicts)
    at = F.bitmap_bit_position(KEY)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.getbit(byte, (at % 8).cast("int")) == 1
    return _unpacked(keyed.withColumn("bucket", F.bitmap_bucket_number(KEY)).join(kept, "bucket").where(on))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; only texts and keys pass through it."""
    keyed, labels = _keyed(docs, "toxicity-keyed"), table(spark, sf_dir, "labels")
    scored = toxicity.score(keyed, labels, carry=(KEY,), model=toxicity.fit(docs, labels))
    return _kept(keyed, scored.select(KEY, (F.col("predicted") == 0).alias("kept")), "toxicity-kept", own=False)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    keyed = _keyed(docs, "exact-keyed")
    return _kept(keyed, exact.exact_groups(keyed, key=KEY), "exact-kept")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class of near duplicates: five words, similarity 0.8 or more."""
    keyed = _keyed(docs, "near-keyed")
    return _kept(keyed, ngram_join.classes(keyed, size=5, percent=80, key=KEY), "near-kept")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    keyed = _keyed(docs, "benchmark-keyed")
    found = decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark"), carry=[KEY])
    return _kept(keyed, found.select(KEY, (~decontaminate.contaminated()).alias("kept")), "benchmark-kept", own=False)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, digests of the ids and of the sampled segmentations, and whether they decode to the text."""
    return pieces.digest(docs, characters=500_000)  # workers still hold memory of the stages before


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact duplicates", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: A fitted classifier and sampled segmentations aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read back by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
