"""Column expressions on sequences. Coordinates are 1-based and inclusive; end < start wraps the origin."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean_sequence(text: Column) -> Column:
    """Lower case, letters other than a, c, g, t dropped."""
    return F.regexp_replace(F.lower(text), "[^acgt]", "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "acgt", "tgca"))


def circular_substring(seq: Column, start: Column, length: Column) -> Column:
    """``length`` bases from ``start``, going on at the origin."""
    return F.substring(F.concat(seq, seq), start, length)


def span_length(start: Column, end: Column, n: Column) -> Column:
    """Bases of an interval; one that ends before it starts wraps."""
    return F.when(end >= start, end - start + 1).otherwise(n - start + 1 + end)


def span_sequence(seq: Column, start: Column, end: Column) -> Column:
    return circular_substring(seq, start, span_length(start, end, F.length(seq)))


def wrap(position: Column, n: Column) -> Column:
    """A position brought back to 1 .. n."""
    return F.pmod(position - 1, n) + 1


def linear_map(value: Column, lo: float | Column, hi: float | Column, to_lo: float, to_hi: float) -> Column:
    return F.lit(to_lo) + (value - lo) / (F.lit(hi) - F.lit(lo) if not isinstance(hi, Column) else hi - lo) * (to_hi - to_lo)


def windows(seq: Column, size: int, overlap: int) -> Column:
    """The sequence in pieces of ``size`` bases, each with the ``overlap`` bases after it, in one pass."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{1,{size + overlap}}})).{{1,{size}}}"), F.lit(1))


def overlapping(seq: Column, k: int) -> Column:
    """The k-mers at all positions of a sequence, in one pass."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))
