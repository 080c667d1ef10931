"""Scalar formulas shared by batch and streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def text_entropy(text: Column) -> Column:
    """Shannon entropy, in bits, of the characters of a string; 0 for the empty string.

    With c the count of each distinct character and n the length: log2(n) - sum(c*log2(c))/n.
    """
    n = F.char_length(text)
    chars = F.array_distinct(F.split(text, ""))
    weighted = F.aggregate(
        F.transform(chars, lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))).cast("double")),
        F.lit(0.0),
        lambda total, c: total + c * F.log2(c),
    )
    return F.when(n > 0, F.greatest(F.log2(n) - weighted / n, F.lit(0.0))).otherwise(F.lit(0.0))


def entropy_from_counts(total: Column, sum_c_log_c: Column) -> Column:
    """Entropy of a histogram given its total and the sum of c*log2(c)."""
    return F.when(total > 0, F.greatest(F.log2(total) - sum_c_log_c / total, F.lit(0.0))).otherwise(
        F.lit(0.0)
    )


def population_std(n: Column, total: Column, squares: Column) -> Column:
    """Population deviation from exact sums; 0 below two values."""
    n, total = n.cast("decimal(10,0)"), total.cast("decimal(20,0)")
    spread = (n * squares - (total * total).cast("decimal(38,0)")).cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0))) / n.cast("double")).otherwise(F.lit(0.0))


def periodicity(mean: Column, std: Column) -> Column:
    return F.when(mean > 0, 1.0 / (1.0 + std / mean)).otherwise(F.lit(0.0))


def periodicity_exponential(mean: Column, std: Column) -> Column:
    return F.exp(-std / (mean + F.lit(1e-9)))


def first_argmax(values: Column) -> Column:
    """0-based position of the first maximum of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
