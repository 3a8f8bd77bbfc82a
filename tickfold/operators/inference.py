"""Tests of results: exact sign tests, equivalence, acceptance bars, interactions, permutations, resampled blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal
from .bars import by_symbol, fold, threshold_ids
from .events import trend_scan
from .pairs import squared_correlations
from .panel import slopes
from .studies import hac


def counting(first: int, last: Column) -> Column:
    """The integers from ``first`` to ``last``; an empty array where there are none."""
    return F.when(last >= first, F.sequence(F.lit(first).cast("bigint"), last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def binomial_tail(wins: Column, n: Column) -> Column:
    """Chance of at least so many heads in n throws of a fair coin, by the exact sum in logarithms."""
    zero = -n * math.log(2.0)
    start = F.struct(zero.alias("log"), F.when(wins <= 0, F.exp(zero)).otherwise(0.0).alias("sum"))

    def step(s, k):
        log = s["log"] + F.log((n - k + 1) / k)
        return F.struct(log.alias("log"), (s["sum"] + F.when(k >= wins, F.exp(log)).otherwise(0.0)).alias("sum"))

    return F.least(F.aggregate(counting(1, n), start, step)["sum"], F.lit(1.0))


def sign_test(rows: DataFrame, keys: list[str], a: str, b: str, least: int = 4) -> DataFrame:
    """Per key: how often a is above b, how often below, of n pairs, and the exact chances of as many (p_greater) and of
    as far from half (p_two_sided) under a fair coin; null below ``least`` pairs."""
    d = F.col(a) - F.col(b)
    by = rows.where(d.isNotNull() & ~F.isnan(d)).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(d > 0).alias("above"), F.count_if(d < 0).alias("below"))
    enough, far = F.col("n") >= least, F.greatest(F.col("above"), F.col("n") - F.col("above"))
    return by.withColumns({
        "p_greater": F.when(enough, binomial_tail(F.col("above"), F.col("n"))),
        "p_two_sided": F.when(enough, F.least(2 * binomial_tail(far, F.col("n")), F.lit(1.0))),
    })


def student_cdf(t: Column, df: Column) -> Column:
    """Probability of Student's t with a whole number of degrees of freedom, by its finite series."""
    angle, odd = F.atan(t / F.sqrt(df)), df % 2
    cos, sin = F.cos(angle), F.sin(angle)
    first = F.when(odd == 1, cos).otherwise(1.0)
    start = F.struct(first.alias("term"), first.alias("sum"))

    def step(s, j):
        term = s["term"] * (2 * j - 1 + odd) / (2 * j + odd) * cos * cos
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    total = sin * F.aggregate(counting(1, F.floor((df - 2 - odd) / 2)), start, step)["sum"]
    area = F.when(df == 1, 2 * angle / math.pi).when(odd == 1, 2 / math.pi * (angle + total)).otherwise(total)
    return (1 + area) / 2


def equivalence(rows: DataFrame, keys: list[str], order: str, a: str, b: str, margin: float, lags: int = 5) -> DataFrame:
    """Two one-sided tests that the mean of b less a lies within the margin, with Newey-West errors over row order:
    n, mean, p_lower, p_upper, p (the larger) and equivalent (p below 5 %); null p below three rows."""
    both = rows.withColumn("_d", F.col(b) - F.col(a)).where("_d is not null")
    m = hac(both, keys, order, "_d", lags)
    p = lambda t: F.when(F.col("n") >= 3, student_cdf(t, F.col("n") - 1))
    m = m.withColumns({"p_lower": 1 - p((F.col("mean") + margin) / F.col("se")), "p_upper": p((F.col("mean") - margin) / F.col("se"))}).drop("se")
    worse = F.greatest("p_lower", "p_upper")
    return m.withColumns({"p": worse, "equivalent": F.coalesce(worse < 0.05, F.lit(False))})


def acceptance(series: DataFrame, keys: list[str], order: str, y: str, window: int, benchmark: str = "0e0") -> DataFrame:
    """Per key, whether a series of results passes every bar: sr above 0; dsr, the probability that it exceeds the SQL
    expression ``benchmark``, above 95 %; tail: the windows without the worst make more than its loss; at least 60 % of
    windows (of ``window`` rows, the last with the rest) gain; and both halves have a ratio above 0."""
    w = Window.partitionBy(*keys)
    rows = series.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    rows = rows.withColumn("_w", F.least(F.expr(f"_i div {window}"), F.greatest(F.expr(f"_n div {window}"), F.lit(2)) - 1))
    early, x = F.col("_i") < F.expr("_n div 2"), F.col(y)
    ratio = lambda c: F.coalesce(F.try_divide(F.avg(c), F.stddev_samp(c)), F.lit(0.0))
    whole = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), ratio(x).alias("sr"), F.coalesce(F.skewness(x), F.lit(0.0)).alias("_skew"), (F.coalesce(F.kurtosis(x), F.lit(0.0)) + 3).alias("_kurt"),
        ratio(F.when(early, x)).alias("early"), ratio(F.when(~early, x)).alias("late"),
    )
    parts = rows.groupBy(*keys, "_w").agg(F.sum(x).alias("_s")).groupBy(*keys).agg(F.min("_s").alias("worst"), F.sum("_s").alias("_t"), F.count_if(F.col("_s") > 0).alias("gains"))
    out = whole.join(parts, keys).withColumns({
        "windows": F.greatest(F.expr(f"n div {window}"), F.lit(2)),
        "dsr": F.expr(normal.probabilistic_sharpe("sr", benchmark, "n", "_skew", "_kurt")),
        "without_worst": F.when(F.col("worst") < 0, (F.col("_t") - F.col("worst")) / -F.col("worst")),
    })
    tail, sign = F.coalesce(F.col("without_worst") > 1, F.lit(True)), F.col("gains") >= 0.6 * F.col("windows")
    ok = (F.col("sr") > 0) & F.coalesce(F.col("dsr") > 0.95, F.lit(False)) & tail & sign & (F.col("early") > 0) & (F.col("late") > 0)
    return out.select(*keys, "n", "sr", "dsr", "windows", "worst", "without_worst", "gains", "early", "late", ok.alias("accepted"))


def interactions(panel: DataFrame, keys: list[str], y: str, x: str, z: str) -> DataFrame:
    """Per key: n, the slope of y on x z beside x, z and a constant, and its t (n - 4 degrees of freedom), from one
    pass of sums: x and then z are swept out of the covariances."""
    rows = panel.where(f"{y} is not null and {x} is not null and {z} is not null").withColumns({"_y": F.col(y), "_x": F.col(x), "_z": F.col(z), "_w": F.col(x) * F.col(z)})
    cov = lambda v: {(a, b): v(*sorted((a, b))) for a in "xzwy" for b in "xzwy"}
    m = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.covar_pop(f"_{a}", f"_{b}").alias(a + b) for a in "xzwy" for b in "xzwy" if a <= b))
    s = cov(lambda a, b: F.col(a + b))
    for p, names in (("x", "wyz"), ("z", "wy")):
        s = {(a, b): s[a, b] - s[a, p] * F.try_divide(s[b, p], s[p, p]) for a in names for b in names}
    n, rest = F.col("n"), s["y", "y"] - s["w", "y"] * F.try_divide(s["w", "y"], s["w", "w"])
    slope = F.try_divide(s["w", "y"], s["w", "w"])
    return m.select(*keys, "n", slope.alias("slope"), F.when((n > 4) & (rest > 1e-18), slope / F.sqrt(rest / s["w", "w"] / (n - 4))).alias("t"))


def subperiods(panel: DataFrame, span: int, step: int, y: str, x: str, control: str) -> DataFrame:
    """The slopes of each window of ``span`` dates, a new one every ``step`` dates, full windows only."""
    dates = panel.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")).cast("bigint") - 1)  # one row a date
    dates = dates.withColumn("_n", F.count("*").over(Window.partitionBy()))
    first = F.greatest(F.ceil((F.col("_i") - span + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("_i") / step), F.floor((F.col("_n") - span) / step))
    dates = dates.where((last >= first) & (F.col("_n") >= span)).select("date", F.explode(F.sequence(first, last)).alias("window"))
    return slopes(panel.join(dates, "date"), ["window"], y, x, control)


def effective_names(panel: DataFrame, least: int, column: str = "x") -> DataFrame:
    """One row: names, and how many independent ones they amount to, n^2 / (n + 2 sum r^2) over pairs' correlations on
    their common dates; pairs with fewer than ``least`` count as uncorrelated."""
    total = squared_correlations(panel, least, column).agg(F.coalesce(F.sum("r2"), F.lit(0.0)).alias("_r"))
    names = panel.where(F.col(column).isNotNull()).agg(F.count_distinct("name").alias("names"))
    n = F.col("names")
    return names.join(F.broadcast(total)).select("names", F.try_divide((n * n).cast("double"), n + 2 * F.col("_r")).alias("effective"))  # one row each


#: Dealt values that a task holds at once; draws come in turn, so they don't depend on it.
DEALT = 1 << 20


def permutation_null(panel: DataFrame, x: str, y: str, draws: int, seed: int) -> DataFrame:
    """One row: the mean over dates of the correlation of x and y among names, and how it lies among ``draws`` means
    after x was dealt anew among the names of each date; a date's names are a group."""

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("name", kind="stable")
        a, b = p[x].to_numpy(float), p[y].to_numpy(float)
        ok = np.isfinite(a) & np.isfinite(b)
        a, b = a[ok], b[ok]
        if len(a) < 3 or a.std() == 0 or b.std() == 0:
            return pd.DataFrame({"draw": [], "ic": []}).astype({"draw": "int64", "ic": float})
        rng = np.random.default_rng([seed, *str(p["date"].iloc[0]).encode()])
        a, b = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
        some = max(1, DEALT // len(a))
        dealt = [rng.permuted(np.tile(a, (min(some, draws - i), 1)), axis=1) @ b for i in range(0, draws, some)]
        return pd.DataFrame({"draw": np.arange(-1, draws), "ic": np.concatenate([[a @ b], *dealt]) / len(a)})

    each = panel.select("date", "name", x, y).groupBy("date").applyInPandas(kernel, "draw bigint, ic double")
    means = each.groupBy("draw").agg(F.avg("ic").alias("m"))
    seen = means.where("draw < 0").select(F.col("m").alias("observed"))  # one row
    null = means.where("draw >= 0").join(F.broadcast(seen))
    far = F.count_if(F.abs("m") >= F.abs("observed"))
    return null.groupBy("observed").agg(F.count("*").alias("draws"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), ((far + 1) / (F.count("*") + 1)).alias("p"))


def automatic_block(x: np.ndarray) -> int:
    """Mean length of blocks from the flat-top autocovariances of a series: at least 1, at most a quarter of it."""
    n = len(x)
    most = max(1, math.ceil(math.sqrt(n)))
    d = x - x.mean()
    lags = np.arange(min(most, n - 1) + 1)
    own = np.array([d[: n - k] @ d[k:] for k in lags]) / n * np.clip(np.where(lags <= most // 2, 1.0, 2 * (most - lags) / most), 0, 1)
    if own[0] <= 0:
        return max(1, int(n ** (1 / 3)))
    return max(1, min(round((2 * (lags @ own) ** 2 / (own @ own)) ** (1 / 3) * n ** (1 / 3)), n // 4))


#: Resampled values that a task holds at once.
TOGETHER = 200_000


def stationary_bootstrap(series: DataFrame, keys: list[str], order: str, y: str, draws: int, seed: int, block: int | None = None) -> DataFrame:
    """Per key: the 2.5 % and 97.5 % points of the mean of y over resamples in circular blocks of geometric length, with
    mean ``block`` or one found from the series; a key's series is a group."""

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values(order, kind="stable")[y].dropna().to_numpy(float)
        own, n = tuple(p[k].iloc[0] for k in keys), len(x)
        if n == 0:
            return pd.DataFrame([[*own, 0, None, None, None, None]], columns=[*keys, "n", "block", "mean", "low", "high"])
        rng = np.random.default_rng([seed, *str(own).encode()])
        size = block or automatic_block(x)
        means, some, place = np.empty(draws), max(1, TOGETHER // n), np.arange(n)
        for low in range(0, draws, some):
            new, first = np.empty((min(some, draws - low), n), bool), []
            for row in new:
                np.less(rng.random(n), 1 / size, out=row)  # a block starts here
                row[0] = True
                first.append(rng.integers(0, n, np.count_nonzero(row)))
            # A draw's first place starts a block, so blocks of all draws are one run of lengths.
            starts = np.flatnonzero(new)
            from_ = np.repeat(np.concatenate(first) - starts % n, np.diff(starts, append=new.size)).reshape(new.shape) + place
            from_[from_ < 0] += n
            from_[from_ >= n] -= n
            means[low : low + some] = x[from_].mean(axis=1)
        lo, hi = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame([[*own, n, size, x.mean(), lo, hi]], columns=[*keys, "n", "block", "mean", "low", "high"])

    types = dict(series.dtypes)
    return series.select(*keys, order, y).groupBy(*keys).applyInPandas(kernel, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n bigint, block bigint, mean double, low double, high double")


def annual_bars(bars: DataFrame) -> DataFrame:
    """Per symbol: n, the years from its first bar's end to its last's (of 365.25 days, at least 1e-6), and bars a year."""
    years = F.greatest((F.max("t_close") - F.min("t_close")) / 1e6 / (365.25 * 86400), F.lit(1e-6))
    return bars.groupBy("symbol").agg(F.count("*").alias("n"), years.alias("years")).withColumn("a_year", F.col("n") / F.col("years"))


def next_trend(bars: DataFrame, most: int) -> DataFrame:
    """label: the sign of the trend of largest |t| over the 3..most bars after this one; bars that have ``most`` after them."""
    found = trend_scan(bars, 3, most).select("symbol", "bar_idx", F.col("label").alias("_l"))
    at = by_symbol()
    rows = bars.select("symbol", "bar_idx", F.lead("bar_idx").over(at).alias("_next"), (F.lead("bar_idx", most).over(at)).alias("_far")).where("_far is not null")
    found = found.withColumnRenamed("bar_idx", "_next")
    return rows.join(found, ["symbol", "_next"], "left").select("symbol", "bar_idx", F.coalesce("_l", F.lit(0)).alias("label"))


def market_bars(ticks: DataFrame, market: Column, target: int) -> DataFrame:
    """Bars as suits the market of each symbol: equal dollar value, or in fx, whose volumes only count, equal ticks."""
    fx = threshold_ids(ticks.where(market == "fx"), "tick", target)
    return fold(threshold_ids(ticks.where(market != "fx"), "dollar", target).unionByName(fx))
