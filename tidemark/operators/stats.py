"""Tests of fits as column expressions: the logarithm of gamma, the incomplete beta function, Student's p-values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """ln of gamma for x > 0: Stirling's series eight steps on, where it is exact to a double, less the steps."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7)) + 1 / (1188 * F.pow(z, 9)) - 691 / (360360 * F.pow(z, 11))
    steps = sum((F.log(x + k) for k in range(1, 8)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - steps


def beta_share(x: Column, a: Column, b: Column, terms: int = 400) -> Column:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction.

    The fraction converges fast below (a + 1) / (a + b + 2); beyond, the share is what the mirrored one leaves.  As many
    terms as the root of the larger parameter are enough, so 400 are for parameters up to about 1e5.
    """
    mirrored = x > (a + 1) / (a + b + 2)
    u, p, q = F.when(mirrored, 1 - x).otherwise(x), F.when(mirrored, b).otherwise(a), F.when(mirrored, a).otherwise(b)
    u, p, q = (c.cast("double") for c in (u, p, q))
    given = F.struct(u.alias("u"), p.alias("p"), q.alias("q"))
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def fraction(g: Column) -> Column:
        """Lentz's evaluation, two terms a step; g holds the arguments once."""
        u, p, q = g["u"], g["p"], g["q"]
        start = 1 / (1 - (p + q) * u / (p + 1))

        def step(s: Column, m: Column) -> Column:
            even = m * (q - m) * u / ((p - 1 + 2 * m) * (p + 2 * m))
            d1, c1 = 1 / (1 + even * s["d"]), 1 + even / s["c"]
            odd = -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 1 + 2 * m))
            d2, c2 = 1 / (1 + odd * d1), 1 + odd / c1
            return state(c2, d2, s["h"] * d1 * c1 * d2 * c2)

        numbers = F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda m: m.cast("double"))
        return F.aggregate(numbers, state(F.lit(1.0), start, start), step, lambda s: s["h"])

    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(u) + q * F.log(1 - u)) / p
    # Arguments go through a list of one, so that they are worked out once and not in every term.
    share = front * F.element_at(F.transform(F.array(given), fraction), 1)
    share = F.when(u <= 0, 0.0).when(u >= 1, 1.0).otherwise(share)
    return F.when(x.isNull() | a.isNull() | b.isNull(), None).when(mirrored, 1 - share).otherwise(share)


def t_p_value(t: Column, freedom: Column) -> Column:
    """The two-sided p-value of Student's t."""
    n = freedom.cast("double")
    return F.when(n > 0, beta_share(n / (n + t * t), n / 2, F.lit(0.5)))
