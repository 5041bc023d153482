"""Toxicity: a linear classifier over character n-grams, its features scaled by naive Bayes log-count ratios.

A text is lower-cased, every ASCII character that is no letter becomes a space, and its n-grams of 3 to 6 characters (one
space at word bounds) are hashed. A text's features are the distinct n-grams it holds.

Fit, on a bounded sample of labelled rows (``per_class`` rows a class): document frequencies of the n-grams by class are
summed by Spark; r = log of the smoothed ratio of their shares in the classes; the ``features`` n-grams whose frequency
in toxic texts departs most from the expected one are kept; a logistic regression with ridge penalty is fitted to r times
presence. Scoring is a narrow map with one small table of weights.

Defined results: null and empty texts have no feature, so their score is that of the intercept; without labelled rows of
both classes every score is 0; repeated rows are scored as they come; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweft.llm.common import giving_back
from netweft.llm.labelled import add_score, sample, with_scores

SIZES = (3, 4, 5, 6)
BITS = 20
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(1_000_003)
FOLD = {c: 32 if not chr(c).isalpha() else c for c in range(128)}


def ngram_slots(text: str) -> Iterator[np.ndarray]:
    """Slots of the hashed n-grams, one array for each size; repeats stay."""
    words = text.lower().translate(FOLD).split()
    if not words:
        return
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = points
    for n in range(2, SIZES[-1] + 1):
        if len(points) < n:
            return
        h = h[:-1] * STEP + points[n - 1 :]
        if n in SIZES:
            yield ((h + np.uint64(n)) * MULTIPLY >> np.uint64(64 - BITS)).astype(np.int64)


def present(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct slots of the text, of those with wanted[slot] only."""
    parts = [s if wanted is None else s[wanted[s]] for s in ngram_slots(text)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        texts, labels = batch.column(0), batch.column(1).to_pylist()
        for k in range(batch.num_rows):
            totals[labels[k], present(texts[k].as_py())] += 1
    found = np.flatnonzero(totals.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (found, totals[0, found], totals[1, found])], ["slot", "n0", "n1"])


def _features(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(1 << BITS, bool)
        keep[wanted.value] = True
        for batch in batches:
            slots = [present(batch.column(0)[k].as_py(), keep).astype(np.int32).tolist() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.list_(pa.int32())), batch.column(1)], ["slots", "label"])

    return run


def _logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, ridge: float, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights of scale * presence and the intercept; full gradient, Adam."""
    n = len(rows)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.concatenate(rows) if n else np.zeros(0, np.int64)
    value = scale[col]
    w, b = np.zeros(len(scale)), 0.0
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, value * w[col], n)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(col, g[row] * value, len(scale)) + ridge * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w * scale, float(b)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4_000, features: int = 2_000, ridge: float = 2e-3, smooth: float = 1.0) -> tuple[np.ndarray, float]:
    """(weight by slot, intercept). At most 2 * ``per_class`` labelled rows and ``features`` n-grams reach the driver."""
    spark = docs.sparkSession
    empty = np.zeros(1 << BITS, np.float32), -50.0
    rows = sample(docs, labels, "toxic", 3, 1, per_class)
    counts = rows.mapInArrow(_counts, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return empty
    ratio = F.log((F.col("n1") + smooth) / (sizes[1] + 2 * smooth)) - F.log((F.col("n0") + smooth) / (sizes[0] + 2 * smooth))
    expected = (F.col("n0") + F.col("n1")) * (sizes[1] / (sizes[0] + sizes[1]))
    ranked = counts.where("n0 + n1 >= 2").withColumn("r", ratio).orderBy(F.desc(F.pow(F.col("n1") - expected, 2) / (expected + 1)), "slot").limit(features)
    best = ranked.select("slot", "r").toPandas()
    if best.empty:
        return empty
    order = best.sort_values("slot")
    slots, r = order["slot"].to_numpy(), order["r"].to_numpy()
    found = rows.mapInArrow(_features(spark.sparkContext.broadcast(slots)), "slots array<int>, label int").collect()
    found.sort(key=lambda x: (x["label"], x["slots"]))
    w, b = _logistic([np.searchsorted(slots, x["slots"]) for x in found], np.array([x["label"] for x in found]), r, ridge)
    out = np.zeros(1 << BITS, np.float32)
    out[slots] = w
    return out, b


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = model.value
        wanted = weights != 0
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            yield with_scores(batch, np.array([intercept + float(weights[present(texts[k].as_py() or "", wanted)].sum()) for k in range(batch.num_rows)]))

    return run


def score(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), model: tuple[np.ndarray, float] | None = None, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, with the columns to ``carry``, by the ``model`` of ``fit`` (null: one
    fitted to these rows)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, **how))
    return add_score(docs, giving_back(_score(shared)), 3, 1, carry=carry)
