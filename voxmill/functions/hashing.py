"""Integer hashes and the Poisson row weights drawn from them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# A linear congruential step and the tree seed's stride.
MULTIPLIER = 1103515245
INCREMENT = 12345
MODULUS = 2147483648
STRIDE = 40503
GRAIN = 1000000


def lcg_sql(number: str, seed: str) -> str:
    """Deterministic draw in [0, GRAIN) from a row number and a seed.

    The second step spreads the low bits of neighbouring numbers.
    """
    first = f"pmod(pmod(CAST({number} AS BIGINT), {MODULUS}) * {MULTIPLIER} + {INCREMENT} + CAST({seed} AS BIGINT) * {STRIDE}, {MODULUS})"
    return f"pmod(CAST(floor(pmod({first} * {MULTIPLIER} + {INCREMENT}, {MODULUS}) / 64) AS BIGINT), {GRAIN})"


def poisson_cuts(rate: float, top: int = 24) -> list[float]:
    """Cumulative Poisson probabilities P(X <= k) for k = 0 .. top-1."""
    total, cuts = 0.0, []
    for k in range(top):
        total += math.exp(-rate) * rate**k / math.factorial(k)
        cuts.append(round(total, 12))
    return cuts


def poisson_weight(number: str, seed: str, rate: float = 6.0) -> Column:
    """Poisson draw by inverse distribution function."""
    u = f"(({lcg_sql(number, seed)} + 0.5D) / {float(GRAIN)}D)"
    cuts = ", ".join(f"{c!r}D" for c in poisson_cuts(rate))
    return F.expr(f"aggregate(array({cuts}), named_struct('u', {u}, 'n', 0), (s, c) -> named_struct('u', s.u, 'n', s.n + int(s.u > c)), s -> s.n)")
