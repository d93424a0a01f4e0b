"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mod_m61(c: Column) -> Column:
    """A non-negative bigint modulo 2**61 - 1, without division: fold once, subtract once."""
    m = F.lit((1 << 61) - 1)
    folded = F.bitwiseAND(c, m) if hasattr(F, "bitwiseAND") else c.bitwiseAND(m)
    folded = folded + F.shiftright(c, 61)
    return F.when(folded >= m, folded - m).otherwise(folded)


def commit_date(seconds: Column) -> Column:
    """Epoch seconds as a day; 'recent' where there is none."""
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"), F.lit("recent"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def percent(part: Column, whole: Column) -> Column:
    """part of whole in per cent, 0 if whole is 0 or null."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)) * 100, F.lit(0.0))


def author_text(name: Column, line: Column, date: Column) -> Column:
    return F.format_string("%s (line %d, %s)", name, line, date)


def one_decimal(c: Column) -> Column:
    """A non-negative double with one decimal, rounded by its exact binary value as C and Rust do (Java's formats round its shortest decimal).

    20 c is computed without error as a sum of two doubles, so ties are known for what they are.
    """
    big, small = c * 16, c * 4
    s = big + small
    rest = small - (s - big)
    half = s / 2
    n = F.floor(half)
    over = half - n
    up = (over > 0.5) | ((over == 0.5) & ((rest > 0) | ((rest == 0) & (n % 2 == 1))))
    m = n + up.cast("bigint")
    return F.concat(F.floor(m / 10).cast("string"), F.lit("."), (m % 10).cast("string"))
