"""Benchmark decontamination with one Aho-Corasick automaton.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Each benchmark item gives its windows of
``window`` consecutive words (an item with fewer words, but at least one, gives one window of all its words). The
windows, as words between single spaces, are the patterns of the automaton; every text is normalised to the same form
and scanned once, left to right. A word inside any occurrence of a window is hit. Offsets of hit runs are mapped back to
code points of the original text.

The work is a narrow map over the documents: no shuffle, no key, so hot sources and copies cost nothing extra. The
automaton is broadcast only while its patterns stay below ``max_chars`` characters (checked by a Spark aggregate); a larger
benchmark is cut into blocks of that size by item row, and the documents pass through one automaton after the other, written
to the shared folder in between, so that a task never holds two of them; the result is the same.

Defined results: null or wordless text has n_words 0, n_hit 0 and no items; null item text and items with a null id give no
window; repeated rows are scanned as they come; very long texts are scanned whole; item ids are distinct in ``item_ids``; other
columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweft.llm.common import giving_back, materialise

#: Lower-cases A-Z and turns every ASCII byte that is no word character into a space; bytes of other code points stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.LongType())),
        T.StructField("hit_spans", SPANS),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def windows_of(words: list[bytes], window: int) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def patterns(rows: list[tuple[int, str | None]], window: int) -> list[tuple[str, int, tuple[int, ...]]]:
    """(pattern, its number of words, items) for the items given; bytes stand as Latin-1 characters."""
    owners: dict[bytes, set[int]] = {}
    for item, text in rows:
        for w in windows_of(words_of(text), window):
            owners.setdefault(w, set()).add(item)
    return [(f" {w.decode('latin-1')} ", w.count(b" ") + 1, tuple(sorted(ids))) for w, ids in owners.items()]


def automaton(found: list[tuple[str, int, tuple[int, ...]]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for text, n, ids in found:
        a.add_word(text, (n, ids))
    if found:
        a.make_automaton()
    return a


def scan(a, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, runs of hit words (first, past the last) and the items that occur."""
    words = words_of(text)
    if not words or not len(a):
        return len(words), [], set()
    norm = f" {b' '.join(words).decode('latin-1')} "
    ends, items = {}, set()
    for at, (n, ids) in a.iter(norm):
        ends[at] = max(n, ends.get(at, 0))
        items.update(ids)
    if not ends:
        return len(words), [], items
    spaces = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)
    runs: list[tuple[int, int]] = []
    for at in sorted(ends):
        last = int(np.searchsorted(spaces, at))
        first = last - ends[at]
        while runs and runs[-1][1] >= first:
            start, end = runs.pop()
            first, last = min(start, first), max(end, last)
        runs.append((first, last))
    return len(words), runs, items


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and out[-1][1] >= first:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _scanner(shared, text: str, last: bool):
    """A mapper over record batches; all but the first block find earlier runs and items in their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(shared.value)
        for batch in batches:
            names = batch.schema.names
            earlier = "__runs" in names
            n_words, n_hit, all_items, spans = [], [], [], []
            column = batch.column(names.index(text))
            for k in range(batch.num_rows):
                value = column[k].as_py()
                n, runs, items = scan(a, value)
                if earlier:
                    runs = _union(runs + [(r["start"], r["end"]) for r in batch.column(names.index("__runs"))[k].as_py()])
                    items |= set(batch.column(names.index("__items"))[k].as_py())
                if last and runs:
                    at = [m.span() for m in WORD.finditer(value)]
                    spans.append([{"start": at[f][0], "end": at[e - 1][1]} for f, e in runs])
                else:
                    spans.append([{"start": f, "end": e} for f, e in runs])
                n_words.append(n)
                n_hit.append(sum(e - f for f, e in runs))
                all_items.append(sorted(items))
            kept = [(n, batch.column(i)) for i, n in enumerate(names) if n not in ("__runs", "__items")]
            pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            ids = pa.array(all_items, pa.list_(pa.int64()))
            if last:
                kept += [("n_words", pa.array(n_words, pa.int64())), ("n_hit", pa.array(n_hit, pa.int64())), ("item_ids", ids), ("hit_spans", pa.array(spans, pairs))]
            else:
                kept += [("__items", ids), ("__runs", pa.array(spans, pairs))]
            yield pa.RecordBatch.from_arrays([c for _, c in kept], [n for n, _ in kept])

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    max_chars: int = 4_000_000,
    carry: list[str] | None = None,
) -> DataFrame:
    """``carry`` columns of ``docs`` (all by default) with n_words, n_hit, item_ids and hit_spans.

    Columns of ``docs`` that have one of the added names are replaced. ``carry`` keeps unneeded columns out of the map.
    """
    spark = docs.sparkSession
    added = [f.name for f in ADDED]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    # A window has at most 13 words, so an item's patterns hold at most `window` times its characters.
    total = items.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total * window // max_chars))
    out = docs.select(*[c for c in carry if c != text], text)
    for b in range(blocks):
        rows = [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()]
        shared = spark.sparkContext.broadcast(patterns(rows, window))
        last = b == blocks - 1
        fields = [f for f in out.schema if f.name not in ("__runs", "__items")]
        more = list(ADDED) if last else [T.StructField("__items", T.ArrayType(T.LongType())), T.StructField("__runs", SPANS)]
        out = out.mapInArrow(giving_back(_scanner(shared, text, last)), T.StructType(fields + more))
        if not last:
            out = materialise(out, "decontaminate")
    return out.select(*carry, *added)


def contaminated() -> "F.Column":
    """The contract's rule: at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
