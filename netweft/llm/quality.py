"""Quality by a factorisation machine: hashed words, structure statistics and length metadata with low-rank interactions.

A text's features are its distinct words, hashed (each with weight 1/sqrt of their number), and one indicator for each
structure statistic: the bucket it falls into (bounds are quantiles of the sample). The machine scores

    w0 + sum w_i x_i + 1/2 * sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

that is, all pairwise interactions, in time linear in the number of features (sum-of-squares identity).

It is fitted on a bounded sample of labelled rows (``per_class`` rows a class) by Adam on the logistic loss with ridge
penalties; scoring is a narrow map with the parameters broadcast (2^16 words x 9 numbers, whatever the input).

Defined results: null and empty texts have structure statistics of zero and are scored from these; without labelled rows
of both classes every score is 0; repeated rows are scored as they come; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netweft.llm.labelled import add_score, sample, with_scores

BITS = 16
BUCKETS = 10
#: Class of each byte: 0 lower case, 1 upper case, 2 digit, 3 space, 4 line end, 5 sentence marks, 6 other marks, 7 non-ASCII.
CLASS = bytes(
    7 if c >= 128 else 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 4 if c in b"\r\n" else 3 if c <= 32 else 5 if c in b".,;:?'\"()-" else 6
    for c in range(256)
)
STATISTICS = ("words", "distinct", "upper", "digit", "sentence", "marks", "nonascii", "word_length", "line_length", "line_repeats", "words_per_line", "longest", "bars", "exclaims", "chars")


def statistics(text: str, words: list[str], distinct: int) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    c = np.bincount(np.frombuffer(raw.translate(CLASS), np.uint8), minlength=8)
    lines = text.split("\n") if text else []
    w, k = max(1, len(words)), max(1, len(lines))
    return [
        np.log2(len(words) + 1),
        distinct / w,
        c[1] / n,
        c[2] / n,
        c[5] / n,
        c[6] / n,
        c[7] / n,
        len(raw) / w,
        np.log2(len(raw) / k + 1),
        1 - len(set(lines)) / k,
        len(words) / k,
        np.log2(max(map(len, words), default=0) + 1),
        raw.count(b"|") / w,
        raw.count(b"!") / w,
        np.log2(len(text) + 1),
    ]


def describe(text: str) -> tuple[np.ndarray, list[float]]:
    """Distinct slots of the hashed words, and the statistics."""
    words = text.split()
    distinct = set(words)
    slots = np.fromiter({crc32(w.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for w in distinct}, np.int64)
    return slots, statistics(text, words, len(distinct))


def features(slots: np.ndarray, stats, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a row: words first, then one bucket for each statistic."""
    buckets = (1 << BITS) + np.arange(len(STATISTICS)) * BUCKETS + (np.asarray(stats)[:, None] > bounds).sum(axis=1)
    values = np.full(len(slots) + len(STATISTICS), 1 / np.sqrt(max(1, len(slots))))
    values[len(slots) :] = 1
    return np.concatenate([slots, buckets]), values


class Machine:
    """Parameters of the factorisation machine, and its scoring."""

    def __init__(self, rank: int, seed: int) -> None:
        size = (1 << BITS) + len(STATISTICS) * BUCKETS
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, rank))
        self.bounds = np.zeros((len(STATISTICS), BUCKETS - 1))

    def raw(self, columns: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score before the logistic function for each row, and the sums of v x that the gradient needs too."""
        vx = self.v[columns] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx**2, starts, axis=0)
        return self.w0 + np.add.reduceat(self.w[columns] * values, starts) + 0.5 * (sums**2 - squares).sum(axis=1), sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, ridge_w: float, ridge_v: float, rate: float, batch: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        moments = [np.zeros_like(x) for x in (self.w, self.w, self.v, self.v)]
        t = 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                t += 1
                columns, values = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
                sizes = np.array([len(rows[i][0]) for i in part])
                starts = np.cumsum(sizes) - sizes
                z, sums = self.raw(columns, values, starts)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
                each = np.repeat(np.arange(len(part)), sizes)
                gx = g[each] * values
                gw = np.bincount(columns, gx, len(self.w)) + ridge_w * self.w
                inner = gx[:, None] * (sums[each] - self.v[columns] * values[:, None])
                gv = np.stack([np.bincount(columns, inner[:, f], len(self.w)) for f in range(self.v.shape[1])], axis=1) + ridge_v * self.v
                self.w0 -= rate * g.sum()
                for x, grad, m, s in ((self.w, gw, *moments[:2]), (self.v, gv, *moments[2:])):
                    m += 0.1 * (grad - m)
                    s += 0.001 * (grad**2 - s)
                    x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [describe(batch.column(0)[k].as_py()) for k in range(batch.num_rows)]
        arrays = [pa.array([s.astype(np.int32) for s, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float64())), batch.column(1)]
        yield pa.RecordBatch.from_arrays(arrays, ["slots", "stats", "label"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2_000, rank: int = 8, epochs: int = 8, ridge_w: float = 1e-3, ridge_v: float = 1e-2, rate: float = 0.01, batch: int = 128, seed: int = 11) -> Machine | None:
    """At most 2 * ``per_class`` labelled rows reach the driver, as hashed words and statistics."""
    found = sample(docs, labels, "quality", 4, 2, per_class).mapInArrow(_describe, "slots array<int>, stats array<double>, label int").collect()
    if len({r["label"] for r in found}) < 2:
        return None
    found.sort(key=lambda r: (r["label"], r["stats"], r["slots"]))
    stats, y = np.array([r["stats"] for r in found]), np.array([r["label"] for r in found])
    machine = Machine(rank, seed)
    machine.bounds = np.quantile(stats, np.linspace(0, 1, BUCKETS + 1)[1:-1], axis=0).T
    rows = [features(np.array(r["slots"], np.int64), r["stats"], machine.bounds) for r in found]
    machine.fit(rows, y, epochs, ridge_w, ridge_v, rate, batch, seed)
    return machine


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value
        for batch in batches:
            texts, z = batch.column(batch.num_columns - 1), np.full(batch.num_rows, -50.0)
            for begin in range(0, batch.num_rows if machine is not None else 0, 256):
                rows = [features(*describe(texts[k].as_py() or ""), machine.bounds) for k in range(begin, min(begin + 256, batch.num_rows))]
                sizes = np.array([len(columns) for columns, _ in rows])
                columns, values = np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows])
                z[begin : begin + len(rows)] = machine.raw(columns, values, np.cumsum(sizes) - sizes)[0]
            yield with_scores(batch, z)

    return run


def score(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), **how) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, with the columns to ``carry``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))
    return add_score(docs, _score(model), 4, 2, carry=carry)
