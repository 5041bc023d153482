"""Sets, bit masks and vectors as column expressions. All stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_mask(positions: Column) -> Column:
    """Bit i-1 for each (distinct) position i, as a LONG; up to 63 datasets."""
    return F.aggregate(positions, F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int") - 1)))


def decode_mask(mask: Column, n: int) -> Column:
    """Positions of the bits of a mask; [0] where there is none."""
    found = F.filter(F.sequence(F.lit(1), F.lit(n)), lambda i: mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)) != 0)
    return F.when(mask <= 0, F.array(F.lit(0))).otherwise(found)


def mask_bits(mask: Column, n: int) -> Column:
    """The mask as 0/1 vector of length n."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)) != 0, 1).otherwise(0))


def contains_mask(occurrence: Column, signature: Column) -> Column:
    return occurrence.bitwiseAND(signature) == signature


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def vertex_set(edge_set: Column) -> Column:
    """Sorted distinct ends of an array of (g1, g2)."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(edge_set, lambda e: F.array(e["g1"], e["g2"])))))


def density(vertices: Column, edges: Column) -> Column:
    """2E / (V (V - 1)); 0 below two vertices."""
    return F.when(vertices < 2, 0.0).otherwise(2.0 * edges / (vertices * (vertices - 1)))


def recurrence(values: Column, kind: int = 0, parameter: float = 0.8) -> Column:
    """Sum of a recurrence array: as it is (0), as 0/1 by a threshold (1), or raised to a power (2)."""
    f = {0: lambda x: x, 1: lambda x: F.when(x >= parameter, 1.0).otherwise(0.0), 2: lambda x: F.pow(x, F.lit(parameter))}[kind]
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x.cast("double")))


def binarise(values: Column, threshold: float = 0.8) -> Column:
    return F.transform(values, lambda x: (x >= threshold).cast("int"))


def std(values: Column) -> Column:
    """Population-free sample standard deviation of the non-null elements."""
    v = F.filter(values, lambda x: x.isNotNull())
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n >= 2, F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(x - mean, 2)) / (n - 1)))


def mean(values: Column) -> Column:
    v = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))


def euclid(a: Column, b: Column) -> Column:
    """Distance over positions where both have a value; -1 if there is none."""
    both = F.filter(F.zip_with(a, b, lambda x, y: F.pow(x - y, 2)), lambda d: d.isNotNull())
    return F.when(F.size(both) == 0, -1.0).otherwise(F.sqrt(F.aggregate(both, F.lit(0.0), lambda s, d: s + d)))


def log_floor(values: Column, floor: float = 10.0) -> Column:
    """Natural logarithm, values below the floor count as the floor."""
    return F.transform(values, lambda x: F.log(F.greatest(x, F.lit(floor))))


def fill_missing(values: Column, key: Column, seed: int, low: float = -1.0, high: float = 1.0) -> Column:
    """Nulls become draws from [low, high) that depend on key, position and seed only."""
    return F.transform(values, lambda x, i: F.coalesce(x, low + (high - low) * F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(1_000_000)) / 1_000_000))


def array_text(values: Column, opening: str = "[", closing: str = "]", between: str = ", ") -> Column:
    return F.concat(F.lit(opening), F.array_join(F.transform(values, lambda x: x.cast("string")), between), F.lit(closing))


def braces_to_array(text: Column, kind: str = "int") -> Column:
    """'{1,2,3}' as an array."""
    return F.from_json(F.translate(text, "{}", "[]"), f"array<{kind}>")


def map_list(values: Column, mapping: Column, keep_misses: bool = False) -> Column:
    """Values looked up in a map column; misses are dropped, or kept as they are."""
    got = F.transform(values, lambda x: F.coalesce(F.try_element_at(mapping, x), x if keep_misses else F.lit(None)))
    return got if keep_misses else F.filter(got, lambda x: x.isNotNull())
