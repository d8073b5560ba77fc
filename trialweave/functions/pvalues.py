"""Tail probabilities as Columns: the incomplete gamma function by series and continued fraction."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _log_gamma(halves: Column) -> Column:
    """The logarithm of gamma(halves / 2) for a whole number of halves, by its recurrence."""
    a = halves / 2
    below = F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(a).cast("int") - 1, F.lit(1))),
                        lambda j: F.when(a - j > 0, F.ln(F.greatest(a - j, F.lit(1e-300)))).otherwise(0.0))
    rest = F.when(halves % 2 == 1, F.lit(math.log(math.pi) / 2)).otherwise(0.0)
    return F.aggregate(below, F.lit(0.0), lambda x, y: x + y) + rest


def gamma_tail(halves: Column, x: Column) -> Column:
    """Q(halves / 2, x), the upper tail of the regularised incomplete gamma function.

    Below a + 1 it is one minus the power series, above the continued fraction (its forward form by
    Lentz). Both take a few hundred terms, more with the root of a. Null for null or fewer than one half; 1 for
    x of 0 or less.
    """
    halves, x = halves.cast("int"), x.cast("double")
    a = halves / 2
    terms = F.sequence(F.lit(1), (F.lit(200) + 12 * F.sqrt(a)).cast("int"))
    front = F.exp(-x + a * F.ln(x) - _log_gamma(halves))
    series = F.aggregate(terms, F.struct((1 / a).alias("term"), (1 / a).alias("total")), lambda s, n: F.struct(
        (s["term"] * x / (a + n)).alias("term"), (s["total"] + s["term"] * x / (a + n)).alias("total")),
        lambda s: s["total"])
    start = x + 1 - a

    def step(s: Column, n: Column) -> Column:
        an, b = n * (a - n), s["b"] + 2
        d = 1 / (an * s["d"] + b)
        c = b + an / s["c"]
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))
    fraction = F.aggregate(terms, F.struct(start.alias("b"), F.lit(1e300).alias("c"), (1 / start).alias("d"),
                                           (1 / start).alias("h")), step, lambda s: s["h"])
    return (F.when(halves < 1, None).when(x <= 0, 1.0)
            .when(x < a + 1, F.greatest(1 - front * series, F.lit(0.0))).otherwise(front * fraction))


def chi_square_p(statistic: Column, dof: Column) -> Column:
    """How likely a statistic as large is under independence."""
    return gamma_tail(dof, statistic / 2)


def normal_p(z: Column) -> Column:
    """The two-sided tail of the normal distribution."""
    return F.when(z.isNotNull(), gamma_tail(F.lit(1), z * z / 2))
