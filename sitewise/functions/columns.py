"""Scalar functions over sequences, intervals, coordinates and mutation strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = "-"
PROTEIN = "-ACDEFGHIKLMNPQRSTVWY"
DNA = "-ACGT"
RNA = "-ACGU"


def symbols(sequence: Column, alphabet: str = PROTEIN) -> Column:
    """Index of each character in the alphabet; unknown and lower-case characters count as the gap, symbol 0."""
    return F.transform(F.split(sequence, ""), lambda c: F.greatest(F.instr(F.lit(alphabet), c) - 1, F.lit(0)))


def strict_symbols(sequence: Column, alphabet: str = PROTEIN) -> Column:
    """As ``symbols``, but an unknown character raises."""
    return F.transform(
        F.split(sequence, ""),
        lambda c: F.when(F.instr(F.lit(alphabet), c) > 0, F.instr(F.lit(alphabet), c) - 1).otherwise(F.raise_error(F.concat(F.lit("not in the alphabet: "), c)).cast("int")),
    )


def range_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two half-open intervals share; an empty or reversed interval raises."""
    bad = (a1 <= a0) | (b1 <= b0)
    return F.when(bad, F.raise_error(F.lit("interval ends before it begins")).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(a1, b1) - F.greatest(a0, b0)))


def gene_distance(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Gap between two intervals of any direction; 0 if they touch or overlap."""
    low1, high1, low2, high2 = F.least(start1, end1), F.greatest(start1, end1), F.least(start2, end2), F.greatest(start2, end2)
    return F.greatest(F.lit(0).cast("long"), low2 - high1, low1 - high2)


def entropy_term(p: Column) -> Column:
    """Term of the base-2 entropy; 0 contributes nothing."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def header_parts(header: Column) -> tuple[Column, Column, Column]:
    """Name, first and last position of ``name/first-last``; null where there is no range."""
    pattern = r"^(.+)/(\d+)-(\d+)"
    part = lambda k: F.nullif(F.regexp_extract(header, pattern, k), F.lit(""))
    return F.coalesce(part(1), header), part(2).cast("long"), part(3).cast("long")


def first_match(text: Column, patterns: list[str]) -> Column:
    """First group of the first pattern that matches; null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def annotation(header: Column, key: str, keys: list[str]) -> Column:
    """Value after ``key=``, up to the next of ``keys`` or the end; null if absent."""
    ahead = "|".join(f" {k}=" for k in keys)
    return F.nullif(F.regexp_extract(header, rf"(?:^| ){key}=(.*?)(?:(?={ahead})|$)", 1), F.lit(""))


def mutations(text: Column, offset: int = 0, sep: str = ",") -> Column:
    """``A10K,L22P`` as an array of struct<pos, wt, subs>; wild type (``wt``, ``wild`` or empty) has none."""
    one = lambda m: F.struct((F.expr("0") + F.substring(m, F.lit(2), F.length(m) - 2).cast("int") + offset).alias("pos"), F.left(m, F.lit(1)).alias("wt"), F.right(m, F.lit(1)).alias("subs"))
    wild = F.lower(F.trim(text)).isin("", "wt", "wild")
    return F.when(wild, F.expr("array()").cast("array<struct<pos:int,wt:string,subs:string>>")).otherwise(F.transform(F.split(text, sep), lambda m: one(F.trim(m))))


def dihedral(p: list[tuple[Column, Column, Column]]) -> Column:
    """Signed torsion, in radians, of four points."""
    sub = lambda a, b: tuple(x - y for x, y in zip(a, b))
    dot = lambda a, b: sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    b0, b1, b2 = sub(p[1], p[0]), sub(p[2], p[1]), sub(p[3], p[2])
    n1, n2 = cross(b0, b1), cross(b1, b2)
    return F.atan2(F.sqrt(dot(b1, b1)) * dot(b0, n2), dot(n1, n2))


def wrap(text: Column, width: int = 80) -> Column:
    """Lines of at most ``width`` characters."""
    return F.regexp_replace(text, rf"(.{{{width}}})(?=.)", "$1\n")
