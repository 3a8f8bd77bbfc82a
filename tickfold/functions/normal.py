"""The normal distribution as plain SQL expressions, so that it stays in generated code.

Each function takes and gives SQL text, which Spark and DuckDB read alike; ``column`` makes a Column of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the upper tail (about 1e-15), and Acklam's of the inverse (1e-9).
_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BOTTOM = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
EULER = 0.5772156649015329


def number(x: float) -> str:
    return f"cast('{x!r}' as double)"


def polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    out = number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {number(c)})"
    return out


def cdf(x: str) -> str:
    """Probability of a standard normal variable below ``x``."""
    a = f"abs({x})"
    near = f"exp(-0.5 * {a} * {a}) * {polynomial(a, _TOP)} / {polynomial(a, _BOTTOM)}"
    far = f"exp(-0.5 * {a} * {a}) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / {number(2.5066282746310002)}"
    tail = f"(case when {a} < 7.07 then {near} when {a} < 37 then {far} else 0e0 end)"
    return f"(case when {x} > 0 then 1 - {tail} else {tail} end)"


def inverse(p: str) -> str:
    """The quantile of ``p`` in (0, 1); null outside."""
    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return (
        f"(case when {p} <= 0 or {p} >= 1 then null "
        f"when {p} < 0.02425 then {polynomial(low, _C)} / {polynomial(low, _D)} "
        f"when {p} > 0.97575 then -{polynomial(high, _C)} / {polynomial(high, _D)} "
        f"else {q} * {polynomial(r, _A)} / {polynomial(r, _B)} end)"
    )


def expected_max(variance: str, n: str) -> str:
    """Expected best of ``n`` independent Sharpe ratios of mean 0 and this variance; 0 below two trials."""
    first, second = inverse(f"(1 - 1e0 / {n})"), inverse(f"(1 - {number(0.36787944117144233)} / {n})")
    return f"(case when {n} < 2 or {variance} <= 0 then 0e0 else sqrt({variance}) * ({number(1 - EULER)} * {first} + {number(EULER)} * {second}) end)"


def probabilistic_sharpe(sr: str, benchmark: str, n: str, skew: str, kurtosis: str) -> str:
    """Probability that the true ratio exceeds the benchmark; kurtosis is 3 for a normal series."""
    square = f"(1 - {skew} * {sr} + ({kurtosis} - 1) / 4 * {sr} * {sr})"
    return f"(case when {n} > 1 and {square} > 0 then {cdf(f'(({sr} - {benchmark}) * sqrt({n} - 1e0) / sqrt({square}))')} end)"


def column(sql: str) -> Column:
    return F.expr(sql)
