"""Decimal rounding that agrees with C and Python on the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x, decimals: int) -> Column:
    """Number text, half-even on the exact value."""
    x = F.col(x) if isinstance(x, str) else x
    pattern = "0" + ("." + "0" * decimals if decimals else "")
    return F.call_function("format_number", x, F.lit(pattern))


def exact_round(x, decimals: int) -> Column:
    """Nearest value with the given decimals.

    Plain arithmetic unless the value lies next to a tie, where the decimal text
    of a double (which ``round`` looks at) and its exact value can disagree.
    """
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    scaled = x * float(10**decimals)
    near_tie = F.abs(F.abs(scaled - F.floor(scaled)) - 0.5) < 1e-6
    return F.when(near_tie, fixed(x, decimals).cast("double")).otherwise(F.rint(scaled) / float(10**decimals))


def stored(x, decimals: int) -> Column:
    """The same value by way of its text. Names its input once, so it suits long
    expressions, which ``exact_round`` would repeat."""
    return fixed(x, decimals).cast("double")
