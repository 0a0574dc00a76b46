"""The normal distribution and its quantile as column expressions, and the same formulas as SQL text.

The distribution function is a ratio of polynomials up to 5 * sqrt(2) and a continued fraction beyond; the quantile is Acklam's rational
approximation with one step of Halley's method. Both are within 1e-14 of the exact values, and in the tails within 1e-8 as a share of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The coefficients of Hart's algorithm 5666 for the upper tail, numerator and denominator.
UPPER = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
LOWER = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
# The coefficients of Acklam's quantile, of the centre and of the tails.
CENTRE_UPPER = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
CENTRE_LOWER = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_UPPER = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_LOWER = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
EDGE, TURN, FAR = 0.02425, 7.07106781186547, 38.5
ROOT = math.sqrt(2 * math.pi)


def _sql(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _bound_sql(x: str, name: str, body: str) -> str:
    """``body`` with ``x`` as ``name``, so that a long expression stands there once."""
    return f"list_transform([{x}], lambda {name}: {body})[1]"


def cdf_sql(x: str) -> str:
    """The distribution function of a DuckDB expression."""
    poly = lambda cs: reduce(lambda s, c: f"({s} * y + {_sql(c)})", cs[1:], _sql(cs[0]))
    far = reduce(lambda s, k: f"(y + {k} / {s})", range(20, 0, -1), f"(y + {_sql(0.65)})")
    tail = f"CASE WHEN y > {FAR} THEN {_sql(0.0)} WHEN y < {_sql(TURN)} THEN exp(-y * y / 2) * {poly(UPPER)} / {poly(LOWER)} ELSE exp(-y * y / 2) / ({_sql(ROOT)} * {far}) END"
    return _bound_sql(x, "z", f"CASE WHEN z > 0 THEN 1 - {_bound_sql('abs(z)', 'y', tail)} ELSE {_bound_sql('abs(z)', 'y', tail)} END")


def ppf_sql(p: str) -> str:
    """The quantile of a DuckDB expression, strictly between 0 and 1."""
    poly = lambda cs: reduce(lambda s, c: f"({s} * r + {_sql(c)})", cs[1:], _sql(cs[0]))
    tail = lambda q: _bound_sql(f"sqrt(-2 * ln({q}))", "r", f"{poly(TAIL_UPPER)} / {poly(TAIL_LOWER)}")
    middle = _bound_sql("(q - 0.5) * (q - 0.5)", "r", f"(q - 0.5) * {poly(CENTRE_UPPER)} / {poly(CENTRE_LOWER)}")
    first = f"CASE WHEN q < {EDGE} THEN {tail('q')} WHEN q > 1 - {EDGE} THEN -({tail('1 - q')}) ELSE {middle} END"
    step = f"(({cdf_sql('f')}) - q) * {_sql(ROOT)} * exp(f * f / 2)"
    return _bound_sql(f"CAST({p} AS DOUBLE)", "q", _bound_sql(first, "f", _bound_sql(step, "s", "f - s / (1 + f * s / 2)")))


def _bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, which is computed once."""
    return F.transform(F.array(x), body)[0]


def _horner(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda s, c: s * x + c, coefficients[1:], F.lit(coefficients[0]))


def norm_cdf(x: Column) -> Column:
    def tail(y: Column) -> Column:
        far = reduce(lambda s, k: y + k / s, range(20, 0, -1), y + 0.65)
        bell = F.exp(-y * y / 2)
        return F.when(y > FAR, 0.0).when(y < TURN, bell * _horner(UPPER, y) / _horner(LOWER, y)).otherwise(bell / (ROOT * far))

    return _bound(x, lambda z: _bound(_bound(F.abs(z), tail), lambda t: F.when(z > 0, 1 - t).otherwise(t)))


def norm_ppf(p: Column) -> Column:
    """Infinite at 0 and 1."""
    tail = lambda q: _bound(F.sqrt(-2 * F.log(q)), lambda r: _horner(TAIL_UPPER, r) / _horner(TAIL_LOWER, r))

    def inside(q: Column) -> Column:
        middle = _bound((q - 0.5) * (q - 0.5), lambda r: (q - 0.5) * _horner(CENTRE_UPPER, r) / _horner(CENTRE_LOWER, r))
        first = F.when(q < EDGE, tail(q)).when(q > 1 - EDGE, -tail(1 - q)).otherwise(middle)
        step = lambda f: (norm_cdf(f) - q) * ROOT * F.exp(f * f / 2)
        return _bound(first, lambda f: _bound(step(f), lambda s: f - s / (1 + f * s / 2)))

    return _bound(p, lambda q: F.when(q <= 0, float("-inf")).when(q >= 1, float("inf")).otherwise(inside(F.when((q > 0) & (q < 1), q))))
