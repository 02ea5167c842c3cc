"""Special functions as expressions, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftmark.functions.unicode import let

#: From here on the continued fraction is used; terms of it and of the series, enough for full precision on their sides.
_SPLIT, _TERMS = 2.0, 80


def erfc(z: Column) -> Column:
    """The complementary error function of a double >= 0: a series of positive terms below 2, a continued fraction beyond.

    Null and NaN stay what they are; negative values give null.
    """

    def series(x):
        # erf(x) = 2 / sqrt(pi) * exp(-x^2) * sum of 2^n x^(2n+1) / (1 * 3 * ... * (2n+1))
        start = F.struct(x.alias("term"), x.alias("sum"))
        step = lambda a, n: let(a["term"] * 2 * x * x / (2 * n + 1), lambda t: F.struct(t.alias("term"), (a["sum"] + t).alias("sum")))
        total = F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), start, step, lambda a: a["sum"])
        return 1 - F.lit(2 / math.sqrt(math.pi)) * F.exp(-x * x) * total

    def fraction(x):
        # erfc(x) = exp(-x^2) / sqrt(pi) / (x + (1/2) / (x + (2/2) / (x + (3/2) / ...)))
        below = F.aggregate(F.sequence(F.lit(_TERMS), F.lit(1), F.lit(-1)), x, lambda a, n: x + n / F.lit(2.0) / a)
        return F.exp(-x * x) / F.lit(math.sqrt(math.pi)) / below

    value = z.cast("double")
    return let(value, lambda x: F.when(F.isnan(x), x).when((x >= 0) & (x < _SPLIT), series(x)).when(x >= _SPLIT, fraction(x)))


def chi_square_tail(x: Column) -> Column:
    """The chance of a chi-square value of one degree of freedom above x >= 0."""
    return erfc(F.sqrt(x / 2))
