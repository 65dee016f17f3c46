"""Numeric shaping of scores, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def tanh_scale(x: Column, scale: float = 10.0, centre: float = 0.5) -> Column:
    return centre + (1 - centre) * F.tanh(scale * (x - centre))


def floored(x: Column, least: float = 1e-3) -> Column:
    """Not below ``least``; NaN and null count as below."""
    return F.greatest(F.coalesce(F.nanvl(x, F.lit(None)), F.lit(least)), F.lit(least))


def guarded(x: Column, below: float = 0.0) -> Column:
    """A divisor: 1 where it is zero or, with ``below``, under that."""
    return F.when(x <= 0 if not below else x < below, F.lit(1.0)).otherwise(x)


def neg_log10(p: Column) -> Column:
    return -F.log10(p)


def ln_factorial(n: Column) -> Column:
    """ln(n!) for n >= 0: sums of logarithms below 20, Stirling's series from there (within 1e-12)."""
    small = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(20)])
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 20, F.get(small, n.cast("int"))).otherwise(series)


@F.pandas_udf(DoubleType())
def normal_tail_two_sided(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """P(|Z| >= |z|); Spark has no erfc."""
    for z in batches:
        yield z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else float("nan"))


def hex_to_rgb(colour: str) -> tuple[float, float, float]:
    """``#rrggbb`` to three shares."""
    digits = colour.lstrip("#")
    return tuple(int(digits[i : i + 2], 16) / 255 for i in (0, 2, 4))
