"""Language of a text by prediction by partial matching: code lengths under byte context trees, one tree a language.

* **Learning.** A sample of labelled rows, bounded per language (``per_language``), is counted by Spark: how often each byte
  follows each context of 0 to ``order`` bytes. A language's tree holds its ``contexts`` most frequent contexts; a context
  never comes without its shorter suffixes, as these are at least as frequent. Depth therefore varies with frequency.
* **Coding.** With frozen counts a byte is coded in the longest context of the tree that fits what went before. There a byte
  seen n times costs -log2(n / (total + distinct)); one never seen costs the escape, -log2(distinct / (total + distinct)),
  and is coded in the next shorter context; below the empty context every byte costs 8 bits. Bytes seen in a longer context
  are not excluded from the shorter ones, so a code length is a plain sum of table entries.
* **Scoring.** All trees are merged into two tables with a column for each language: costs of (context, byte), escapes of
  contexts. What a tree lacks is filled in by its escapes, so a hit at the longest context serves all languages at once, and
  the tables are looked up for all bytes of a batch side by side. Lengths are exact up to float64.

The language of the shortest code wins (ties: the smaller name); the score is its share of 2^-length over all languages.

The tables are the only thing that leaves Spark: ``contexts`` contexts a language with the bytes after them, whatever the
input. Scoring is a map over rows; long texts are scored piece by piece, each with the bytes before it as context.

Defined results: null texts, and texts without a letter, are ``und`` with score 0; so is every row when nothing can be learned
(empty table, no lang outside the held-out remainder); rows that repeat an id are separate rows, but rows equal in id and text
are learned once; texts of any length are read as a whole; other columns are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweft.llm.common import materialise
from netweft.llm.labelled import remainder

ORDER = 4
PIECE = 1 << 20  # bytes of a text that are scored at once
UNKNOWN = "und"


def sample(docs: DataFrame, per_language: int, modulus: int, held_out: int) -> DataFrame:
    """lang, text of at most ``per_language`` rows a language: the smallest hashes of id and text.

    Counts by language tell which part of the hash range to look at, so the ranking sees some hundred rows more than it keeps.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = docs.select(F.col("lang").cast("string").alias("lang"), "doc_id", text.alias("text")).where("lang is not null").where(remainder(F.col("doc_id"), modulus) != held_out)
    # as many as languages; a join would deal all texts by language
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    limits = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (2.0 * per_language + 200) / n) * 2.0**63)]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    near = known.withColumn("h", F.xxhash64("doc_id", "text")).where(F.shiftrightunsigned("h", 1) <= limits[F.col("lang")])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return near.select("lang", "h", "text").distinct().withColumn("r", first).where(F.col("r") <= per_language).select("lang", "text")


def pieces(text: bytes, order: int, piece: int = PIECE) -> Iterator[bytes]:
    """The text in pieces, each behind the ``order`` bytes before it (zeros before the text)."""
    padded = bytes(order) + text
    for at in range(0, len(text), piece):
        yield padded[at : at + piece + order]


def codes(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte the number that it and the ``order`` bytes before it make; bytes before the data are zeros."""
    out = data.astype(np.int64)
    for back in range(1, order + 1):
        out[back:] |= data[:-back].astype(np.int64) << (8 * back)
    return out


def _counts(order: int):
    """Counts of (lang, byte behind ``order`` bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().encode()
                for piece in pieces(text, order):
                    found, n = np.unique(codes(np.frombuffer(piece, np.uint8), order)[order:], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n, pa.int64())], ["lang", "code", "n"])

    return run


class Table:
    """Numbers by int64 key, looked up for whole arrays: open addressing at a load of a quarter at most."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.keys, self.at = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            _, first = np.unique(slot[free], return_index=True)  # one key for a slot and round
            taken = free[first]
            self.keys[slot[taken]], self.at[slot[taken]] = keys[taken], taken
            left = np.setdiff1d(left, taken, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it isn't there."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.at[slot], -1)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


def _key(order: int | np.ndarray, code: np.ndarray) -> np.ndarray:
    """A context or a (context, byte) with its number of bytes, so that leading zero bytes count."""
    return code | (np.int64(order) << 56 if np.isscalar(order) else order.astype(np.int64) << 56)


class Trees:
    """The merged trees: bits of every (context, byte) and escape bits of every context, a column for each language."""

    def __init__(self, langs: list[str], order: int, lang: np.ndarray, k: np.ndarray, code: np.ndarray, n: np.ndarray):
        """``code``: a context of ``k`` bytes and the byte after it, seen ``n`` times in language number ``lang``."""
        self.langs, self.order = langs, order
        pairs, at = np.unique(_key(k, code), return_inverse=True)
        contexts, of = np.unique(_key(k, code >> 8), return_inverse=True)
        total, distinct = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(total, (of, lang), n)
        np.add.at(distinct, (of, lang), 1)
        has = total > 0
        whole = np.where(has, total + distinct, 1.0)
        self.escape = np.where(has, -np.log2(np.where(has, distinct, 1.0) / whole), 0.0)
        self.bits = np.full((len(pairs), len(langs)), np.nan)
        self.bits[at, lang] = -np.log2(n / whole[of, lang])
        self.pairs, self.contexts = Table(pairs), Table(contexts)
        level, low = pairs >> 56, pairs & ((1 << 56) - 1)
        for x in range(order + 1):  # from the empty context on: what a tree lacks is an escape and the shorter context's bits
            own = np.flatnonzero(level == x)
            shorter = self.bits[self.pairs.find(_key(x - 1, low[own] & ((1 << 8 * x) - 1)))] if x else np.full((len(own), len(langs)), 8.0)
            self.bits[own] = np.where(np.isnan(self.bits[own]), self.escape[self.contexts.find(_key(x, low[own] >> 8))] + shorter, self.bits[own])

    def lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each piece in each language; ``starts``: where pieces begin, each with ``order`` bytes that aren't counted."""
        code = codes(data, self.order)
        out = np.zeros((len(data), len(self.langs)))
        left = np.delete(np.arange(len(data)), (starts[:, None] + np.arange(self.order)).ravel())
        for k in range(self.order, -1, -1):
            own = code[left] & ((1 << 8 * (k + 1)) - 1)
            at = self.pairs.find(_key(k, own))
            hit = at >= 0
            out[left[hit]] += self.bits[at[hit]]
            left, own = left[~hit], own[~hit]
            at = self.contexts.find(_key(k, own >> 8))
            known = at >= 0
            out[left[known]] += self.escape[at[known]]
        out[left] += 8.0
        return np.add.reduceat(out, starts, axis=0) if len(starts) else np.zeros((0, len(self.langs)))


def fit(docs: DataFrame, per_language: int = 1_000, contexts: int = 30_000, order: int = ORDER, modulus: int = 4, held_out: int = 2) -> Trees | None:
    """The trees of all languages in ``docs`` outside the held-out remainder; none if there is no language."""
    counted = sample(docs, per_language, modulus, held_out).mapInArrow(_counts(order), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    k = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")
    low = F.when(F.col("k") == 7, F.col("code")).otherwise(F.col("code").bitwiseAND(F.expr("shiftleft(1L, 8 * (k + 1)) - 1")))
    pairs = counted.select("lang", "code", "n", k).groupBy("lang", "k", low.alias("code")).agg(F.sum("n").alias("n")).withColumn("context", F.shiftright("code", 8))
    pairs = materialise(pairs, "language-pairs")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("total"), "k", "context"))
    kept = pairs.groupBy("lang", "k", "context").agg(F.sum("n").alias("total")).withColumn("r", first).where(F.col("r") <= contexts)
    found = pairs.join(kept.select("lang", "k", "context"), ["lang", "k", "context"], "left_semi").select("lang", F.col("k").cast("long").alias("k"), "code", "n").toArrow()
    if not found.num_rows:
        return None
    names = found["lang"].combine_chunks().dictionary_encode()
    langs = names.dictionary.to_pylist()
    rank = np.argsort(np.argsort(np.array(langs, dtype=object)))
    return Trees(sorted(langs), order, rank[names.indices.to_numpy()], *(found[c].to_numpy() for c in ("k", "code", "n")))


def code_lengths(trees: Trees, texts: list[bytes], batch: int = PIECE) -> np.ndarray:
    """Bits of each text in each language, some ``batch`` bytes at a time."""
    out, held, owners, size = np.zeros((len(texts), len(trees.langs))), [], [], 0

    def flush() -> None:
        starts = np.cumsum([0, *map(len, held)])[:-1].astype(np.int64)
        bits = trees.lengths(np.frombuffer(b"".join(held), np.uint8), starts)
        for i, row in zip(owners, bits):  # pieces of a text in their order, so that batches don't change its sum
            out[i] += row
        held.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for piece in pieces(text, trees.order):
            held.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= batch:
                flush()
                size = 0
    if held:
        flush()
    return out


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                bits = code_lengths(trees, [(t.as_py() or "").encode() for t in part.column(part.num_columns - 1)])
                best = bits.argmin(axis=1)
                score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1_000)).sum(axis=1)
                columns = [*(part.column(i) for i in range(part.num_columns - 1)), pa.array([trees.langs[b] for b in best], pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, trees: Trees | None, modulus: int = 4, held_out: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, with the columns to ``carry``."""
    text = F.col("text").cast("string")
    rows = docs.select(*carry, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letter"), text.alias("__text"))
    if trees is None:
        found = rows.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    else:
        kind = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
        found = rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(trees)), kind)
    return found.select(
        *carry,
        "doc_id",
        (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"),
        F.when(F.col("__letter"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("__letter"), F.col("score")).otherwise(0.0).alias("score"),
    )
