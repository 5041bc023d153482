"""Strings of the domain: sequences, numerals, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases that an IUPAC letter stands for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
# Organisms by taxonomy id.
ORGANISMS = {"Homo sapiens": 9606, "Mus musculus": 10090, "Rattus norvegicus": 10116, "Saccharomyces cerevisiae": 4932, "Arabidopsis thaliana": 3702, "Caenorhabditis elegans": 6239}


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTacgt", "TGCAtgca"))


def letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def mismatches(a: Column, b: Column) -> Column:
    """Positions at which two strings of equal length differ, ignoring case; null for different lengths."""
    pairs = F.zip_with(letters(F.upper(a)), letters(F.upper(b)), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def consensus_mismatches(consensus: Column, site: Column) -> Column:
    """Positions at which a base is none of those the IUPAC letter stands for; null for different lengths."""
    stands = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    pairs = F.zip_with(letters(F.upper(consensus)), letters(F.upper(site)), lambda c, s: (~F.contains(F.coalesce(F.try_element_at(stands, c), F.lit("")), s)).cast("int"))
    return F.when(F.length(consensus) == F.length(site), F.aggregate(pairs, F.lit(0), lambda n, x: n + x))


def allowed_mismatches(sequence: Column, share: float, at_least: int, exempt: int) -> Column:
    """0 up to ``exempt`` letters, else the share of the length (rounded down), at least ``at_least``."""
    n = F.length(sequence)
    return F.when(n <= exempt, 0).otherwise(F.greatest(F.lit(at_least), F.floor(n * share).cast("int")))


def roman(text: Column) -> Column:
    """Value of a numeral of I, V and X; a smaller sign before a larger one counts negative."""
    value = F.transform(letters(F.upper(text)), lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).otherwise(0))
    return F.aggregate(F.transform(value, lambda x, i: F.when(x < F.coalesce(F.get(value, i + 1), F.lit(0)), -x).otherwise(x)), F.lit(0), lambda a, x: a + x)


def short_name(organism: Column) -> Column:
    """'Homo sapiens' as 'Hs'."""
    return F.concat(F.substring(organism, 1, 1), F.substring(F.split(organism, " ")[1], 1, 1))


def tax_id(organism: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ORGANISMS.items() for x in kv]), organism)


def trailing_number(name: Column) -> Column:
    """The digits at the end of a file name."""
    return F.nullif(F.regexp_extract(name, r"(\d+)$", 1), F.lit("")).cast("int")


def safe_name(arguments: Column) -> Column:
    """Command arguments as part of a file name: leading dashes go, marks become underscores."""
    return F.regexp_replace(F.regexp_replace(arguments, r"(^|\s)-+", "$1"), r"[-.,\s]", "_")
