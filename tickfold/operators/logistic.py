"""Logistic regressions of all keys and expanding folds at once: each Newton step is one pass that sums per (key, fold)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bars import by_symbol
from .lineage import cut
from .studies import area_under_curve


def expanding_folds(rows: DataFrame, h: int, folds: int, least_fold: int = 50) -> DataFrame:
    """``rows`` (symbol, bar_idx) with arrays trains and tests of fold numbers. A symbol's rows are cut in folds + 1 parts;
    fold f learns from the first f + 1 and is tested on every h-th row of the two parts after a gap of h rows.
    Symbols with parts of fewer than ``least_fold`` rows have none."""
    at = by_symbol()
    rows = rows.withColumns({"_i": F.row_number().over(at) - 1, "_size": F.expr(f"count(*) over (partition by symbol) div {folds + 1}")})
    size, i = F.when(F.col("_size") >= least_fold, F.col("_size")).otherwise(0), F.col("_i")
    every = F.sequence(F.lit(0), F.lit(folds - 1))
    start = lambda f: (f + 1) * size + h
    tests = F.filter(every, lambda f: (size > 0) & (i >= start(f)) & (i < (f + 3) * size) & ((i - start(f)) % h == 0))
    return rows.withColumns({"trains": F.filter(every, lambda f: i < (f + 1) * size), "tests": tests}).drop("_i", "_size")


def _linear(beta: Column, features: Sequence[str]) -> Column:
    return sum((beta[i + 1] * F.col(c) for i, c in enumerate(features)), beta[0])


def logistic_fits(rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, penalty: float = 1.0, rounds: int = 8) -> DataFrame:
    """(keys, fold, beta): intercept and slopes that minimise the log loss plus penalty / 2 times the slopes' squares,
    for every fold in ``trains`` (an array of rows' folds), from ``rounds`` Newton steps.

    A step joins the few coefficients to the rows and sums gradients and curvatures per (key, fold), combined before
    the shuffle. Rows with a null feature or label are left out.
    """
    d, by = len(features) + 1, [*keys, "fold"]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    known = rows.dropna(subset=[*features, label]).select(*keys, *features, F.col(label).cast("double").alias("_y"), F.explode("trains").alias("fold"))
    x = [F.lit(1.0), *(F.col(c) for c in features)]
    shape = ", ".join(f"`{n}` {t}" for n, t in known.select(*by).dtypes) + ", beta array<double>"

    def newton(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ridge = penalty * np.diag([0.0] + [1.0] * (d - 1))
        for p in batches:
            betas = []
            for r in p.to_dict("records"):
                curve, now = np.zeros((d, d)), np.array(r["beta"], float)
                for i, j in pairs:
                    curve[i, j] = curve[j, i] = r[f"h{i}_{j}"]
                slope = np.array([r[f"g{i}"] for i in range(d)]) - ridge @ now
                betas.append((now + np.linalg.lstsq(curve + ridge, slope, rcond=None)[0]).tolist())
            yield p[by].assign(beta=betas)

    known, betas = cut(known), None
    for _ in range(rounds):
        start = F.array(*([F.lit(0.0)] * d))
        at = known.withColumn("beta", start) if betas is None else known.join(betas, by)
        p = 1 / (1 + F.exp(-F.greatest(F.least(_linear(F.col("beta"), features), F.lit(30.0)), F.lit(-30.0))))
        at = at.withColumn("_p", p)
        w = F.col("_p") * (1 - F.col("_p"))
        sums = [F.sum((F.col("_y") - F.col("_p")) * x[i]).alias(f"g{i}") for i in range(d)] + [F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs]
        betas = cut(at.groupBy(*by).agg(F.first("beta").alias("beta"), *sums).mapInPandas(newton, shape))
    return betas


def logistic_walk(rows: DataFrame, features: Sequence[str], label: str, h: int, folds: int = 5, least_fold: int = 50, penalty: float = 1.0, rounds: int = 8) -> DataFrame:
    """(symbol, fold, bar_idx, score, label) of every fold's test rows, by the fit on its training rows."""
    dealt = expanding_folds(rows.dropna(subset=[*features, label]), h, folds, least_fold)
    fits = logistic_fits(dealt, ["symbol"], features, label, penalty, rounds)
    tested = dealt.withColumn("fold", F.explode("tests")).join(fits, ["symbol", "fold"])
    return tested.select("symbol", "fold", "bar_idx", (1 / (1 + F.exp(-_linear(F.col("beta"), features)))).alias("score"), F.col(label).alias("label"))


def walk_auc(scored: DataFrame, least: int = 10, digits: int = 9) -> DataFrame:
    """Per symbol: folds, median, lower and upper quartile of the folds' AUC, and n_test, over folds with ``least`` test
    rows and both labels. Scores tie at ``digits`` digits."""
    each = area_under_curve(scored.withColumn("score", F.round("score", digits)), ["symbol", "fold"], "score", "label")
    each = each.where((F.col("positives") + F.col("negatives") >= least) & F.col("auc").isNotNull())
    cuts = [F.percentile("auc", F.lit(q)).alias(n) for n, q in (("auc", 0.5), ("auc_low", 0.25), ("auc_high", 0.75))]
    return each.groupBy("symbol").agg(F.count("*").alias("folds"), *cuts, F.sum(F.col("positives") + F.col("negatives")).alias("n_test"))


def trailing_volatility(bars: DataFrame, h: int) -> DataFrame:
    """rv: the sum of the sizes of the last h log returns, the bar's own included; null before h bars."""
    at = by_symbol()
    rows = bars.withColumn("_r", F.abs(F.log("close") - F.lag(F.log("close")).over(at)))
    w = at.rowsBetween(1 - h, 0)
    return rows.withColumn("rv", F.when(F.count("_r").over(w) == h, F.sum("_r").over(w))).drop("_r")
