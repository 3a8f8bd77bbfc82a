"""Statistics of many strategies' results: Sharpe ratios, their deflation, and the odds of overfitting.

A corpus is long: (asset, strategy, date, pnl); a day without a row is a result of 0. Nothing is pivoted.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normal
from .lineage import cut
from .pairs import pair_products


def corpus_moments(corpus: DataFrame) -> DataFrame:
    """Per (asset, strategy): days (of the asset), mean, sd (sample), sr, skew and kurtosis (population, not
    excess), with zeros for days without a row."""
    daily = corpus.groupBy("asset", "strategy", "date").agg(F.sum("pnl").cast("double").alias("x"))
    days = corpus.groupBy("asset").agg(F.count_distinct("date").cast("double").alias("t"))
    x = F.col("x")
    sums = daily.groupBy("asset", "strategy").agg(*(F.sum(F.pow(x, i)).alias(f"s{i}") for i in range(1, 5)), F.count("*").alias("active"))
    rows = sums.join(days, "asset")
    t = F.col("t")
    rows = rows.withColumns({"m": F.col("s1") / t, "m2": F.col("s2") / t, "m3": F.col("s3") / t, "m4": F.col("s4") / t})
    m = F.col("m")
    var = F.col("m2") - m * m
    third = F.col("m3") - 3 * m * F.col("m2") + 2 * F.pow(m, 3)
    fourth = F.col("m4") - 4 * m * F.col("m3") + 6 * m * m * F.col("m2") - 3 * F.pow(m, 4)
    sd = F.sqrt(var * t / (t - 1))
    safe = lambda c: F.when(var > 0, c).otherwise(0.0)
    return rows.select(
        "asset", "strategy", "active", t.cast("bigint").alias("days"), m.alias("mean"), sd.alias("sd"), safe(m / sd).alias("sr"),
        safe(third / F.pow(var, 1.5)).alias("skew"), safe(fourth / (var * var)).alias("kurtosis"),
    )


def deflated(moments: DataFrame) -> DataFrame:
    """Adds psr (against 0), trials, best_by_chance (expected best of that many) and dsr (psr against it)."""
    trials = moments.groupBy("asset").agg(F.count("*").cast("double").alias("trials"), F.var_samp("sr").alias("sr_variance"))
    rows = moments.join(trials, "asset")
    rows = rows.withColumn("best_by_chance", F.expr(normal.expected_max("sr_variance", "trials")))
    ratio = lambda benchmark: F.expr(normal.probabilistic_sharpe("sr", benchmark, "days", "skew", "kurtosis"))
    return rows.withColumns({"psr": ratio("0e0"), "dsr": ratio("best_by_chance")})


def track_lengths(moments: DataFrame, benchmark: float = 0.0, confidence: float = 0.95) -> DataFrame:
    """min_trl: days for the ratio to exceed the benchmark with this confidence; infinite where it isn't above."""
    z = F.expr(normal.inverse(normal.number(confidence)))
    over = F.col("sr") - benchmark
    days = 1 + (1 - F.col("skew") * F.col("sr") + (F.col("kurtosis") - 1) / 4 * F.col("sr") * F.col("sr")) * F.pow(z / over, 2)
    return moments.withColumn("min_trl", F.when(over > 0, days).otherwise(float("inf")))


def block_sums(corpus: DataFrame, blocks: int) -> DataFrame:
    """(asset, strategy, block, s1, s2, n): sums of each even block of days; days beyond the last whole block are left out."""
    days = corpus.select("asset", "date").distinct()
    place = F.row_number().over(Window.partitionBy("asset").orderBy("date")) - 1
    days = days.withColumns({"_i": place, "_k": F.expr(f"count(*) over (partition by asset) div {blocks}")})
    days = days.where(F.col("_i") < F.col("_k") * blocks).select("asset", "date", F.expr("_i div _k").alias("block"), F.col("_k").alias("n"))
    daily = corpus.groupBy("asset", "strategy", "date").agg(F.sum("pnl").cast("double").alias("x"))
    sums = daily.join(days, ["asset", "date"]).groupBy("asset", "strategy", "block", "n").agg(F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"))
    return sums


def splits(spark: SparkSession, blocks: int) -> DataFrame:
    """(split, block, inside): every choice of half of the blocks; at most a few thousand rows of parameters."""
    rows = [(i, b, b in chosen) for i, chosen in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    return spark.createDataFrame(rows, "split int, block int, inside boolean")


def overfitting(corpus: DataFrame, blocks: int = 6) -> DataFrame:
    """Per (asset, split): the strategy of the best ratio inside (the smallest of equal ones), its average rank
    outside over (strategies + 1), and the logit of that."""
    parts = block_sums(corpus, blocks).join(F.broadcast(splits(corpus.sparkSession, blocks)), "block")
    sides = parts.groupBy("asset", "split", "strategy", "inside").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.max("n").alias("n"))
    t = F.col("n") * (blocks // 2)
    var = (F.col("s2") - F.col("s1") * F.col("s1") / t) / (t - 1)
    # A strategy without a row on a side has a ratio of 0 there.
    ratio = F.when(var > 0, F.col("s1") / t / F.sqrt(var)).otherwise(0.0)
    sr = sides.select("asset", "split", "strategy", "inside", F.round(ratio, 12).alias("sr"))
    wide = sr.groupBy("asset", "split", "strategy").agg(
        F.coalesce(F.max(F.when(F.col("inside"), F.col("sr"))), F.lit(0.0)).alias("sr_in"),
        F.coalesce(F.max(F.when(~F.col("inside"), F.col("sr"))), F.lit(0.0)).alias("sr_out"),
    )
    best = wide.groupBy("asset", "split").agg(
        F.max_by("strategy", F.struct("sr_in", -F.col("strategy"))).alias("best"), F.max_by("sr_out", F.struct("sr_in", -F.col("strategy"))).alias("out"), F.count("*").alias("n"),
    )
    ranks = wide.join(best, ["asset", "split"]).groupBy("asset", "split", "best", "n").agg(
        (F.sum((F.col("sr_out") < F.col("out")).cast("int")) + (F.sum((F.col("sr_out") == F.col("out")).cast("int")) + 1) / 2).alias("rank")
    )
    share = F.col("rank") / (F.col("n") + 1)
    return ranks.select("asset", "split", "best", share.alias("rank"), F.log(share / (1 - share)).alias("logit"))


def pbo(corpus: DataFrame, blocks: int = 6) -> DataFrame:
    """Share of splits whose inside winner is at or below the median outside, per asset."""
    return overfitting(corpus, blocks).groupBy("asset").agg(F.count("*").alias("splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"))


#: Strategies whose histories one task holds, how many of them are dense at once, and days of one block.
TOGETHER, DENSE, DAYS = 8_192, 512, 4_096


def _day_products(p: pd.DataFrame) -> pd.DataFrame:
    """(i, g, n): a day i of block a and its products with block b's days over the group's strategies, standardised with
    zeros for missing days; n, the strategies that have a deviation, is in the group's first row."""
    t, a, b = int(p["days"].iloc[0]), int(p["a"].iloc[0]), int(p["b"].iloc[0])
    left, right = (slice(k * DAYS, min((k + 1) * DAYS, t)) for k in (a, b))
    names, at = np.unique(p["strategy"].to_numpy(), return_inverse=True)
    day, x, order = p["day"].to_numpy(), p["x"].to_numpy(float), np.argsort(at, kind="stable")
    g, kept = np.zeros((left.stop - left.start, right.stop - right.start)), 0
    for low in range(0, len(names), DENSE):
        i = order[slice(*np.searchsorted(at[order], [low, low + DENSE]))]
        z = np.zeros((t, min(DENSE, len(names) - low)))
        np.add.at(z, (day[i], at[i] - low), x[i])
        z = z[:, z.max(0) > z.min(0)]
        z -= z.mean(0)
        z /= np.sqrt((z * z).sum(0) / (t - 1))
        g += z[left] @ z[right].T
        kept += z.shape[1]
    n = np.zeros(len(g), "int64")
    n[0] = kept if a == b == 0 else 0
    return pd.DataFrame({"asset": p["asset"].iloc[0], "a": a, "b": b, "i": np.arange(left.start, left.stop), "n": n, "days": t, "g": list(g)})


def effective_strategies(corpus: DataFrame) -> DataFrame:
    """Participation ratio of the correlation matrix, trace^2 / sum of squared entries: no eigenvalues needed.

    The strategies' squared correlations sum to the squared products of days over standardised strategies, so work and
    shuffles grow with the rows, not with pairs of strategies. A task holds the histories of about ``TOGETHER``
    strategies and adds up the products of two blocks of ``DAYS`` days.
    """
    kind = dict(corpus.dtypes)["asset"]
    days = corpus.select("asset", "date").distinct()  # one row for an asset's day
    place = F.row_number().over(Window.partitionBy("asset").orderBy("date")) - 1
    days = days.select("asset", "date", place.alias("day"), F.count("*").over(Window.partitionBy("asset")).cast("int").alias("days"))
    names = corpus.groupBy("asset").agg(F.count_distinct("strategy").alias("n")).agg(F.max("n")).first()[0] or 1
    parts, blocks = -(-names // TOGETHER), -(-(days.agg(F.max("days")).first()[0] or 1) // DAYS)
    met = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(blocks) for b in range(a, blocks)))
    rows = corpus.select("asset", "date", "strategy", F.col("pnl").cast("double").alias("x")).where("x is not null").join(days, ["asset", "date"])
    rows = rows.withColumns({"part": F.pmod(F.xxhash64("strategy"), F.lit(parts)).cast("int"), "_m": F.explode(met)}).where(F.col("_m.b") * DAYS < F.col("days"))
    rows = rows.select("asset", "part", "_m.a", "_m.b", "strategy", "day", "days", "x")
    made = rows.groupBy("asset", "part", "a", "b").applyInPandas(_day_products, f"asset {kind}, a int, b int, i int, n bigint, days int, g array<double>")

    def squares(p: pd.DataFrame) -> pd.DataFrame:
        g = np.sum(np.stack(p["g"].to_numpy()), axis=0)
        twice = 1 if p["a"].iloc[0] == p["b"].iloc[0] else 2
        return pd.DataFrame({"asset": p["asset"].iloc[:1], "n": [int(p["n"].sum())], "days": [int(p["days"].iloc[0])], "s": [twice * float(g @ g)]})

    sums = made.groupBy("asset", "a", "b", "i").applyInPandas(squares, f"asset {kind}, n bigint, days int, s double")
    sums = sums.groupBy("asset").agg(F.sum("n").alias("n"), (F.max("days").cast("double") - 1).alias("t"), F.sum("s").alias("s")).where("n > 0")
    n, t = F.col("n"), F.col("t")
    return sums.select("asset", n.alias("strategies"), F.when(n < 4, n.cast("double")).otherwise(n * n * t * t / F.col("s")).alias("effective"))


#: Days whose Gram matrix one task may hold: 4,096^2 numbers are 134 MB.
MOST_DAYS = 4_096


def gram_matrix(corpus: DataFrame) -> DataFrame:
    """(asset, i, j, g), i <= j: products of days i and j over strategies whose daily results are standardised, with
    zeros for missing days; strategies without deviation are left out.

    Its eigenvalues other than 0 are those of the strategies' correlation matrix times (days - 1), so a spectrum costs
    days squared, whatever the strategies. Results stay sparse: with a = x / sd and b = mean / sd, a product is
    sum(a a') - p - p' + sum(b b), where p are a day's sums of a b. Strategies meet in blocks, as matrix products.
    """
    daily = corpus.groupBy("asset", "date", "strategy").agg(F.sum("pnl").cast("double").alias("x"))
    m = corpus_moments(corpus).where("sd > 0").select("asset", "strategy", (F.col("mean") / F.col("sd")).alias("b"), "sd")
    days = daily.select("asset", "date").distinct().withColumn("day", (F.dense_rank().over(Window.partitionBy("asset").orderBy("date")) - 1).cast("bigint"))
    place = m.withColumn("turn", F.row_number().over(Window.partitionBy("asset").orderBy("strategy")).cast("bigint"))
    rows = cut(daily.join(place, ["asset", "strategy"]).join(days, ["asset", "date"]).select("asset", "day", "turn", (F.col("x") / F.col("sd")).alias("a"), "b"))
    met = pair_products(rows.select(F.col("asset").alias("group"), F.col("day").alias("name"), F.col("turn").alias("date"), F.col("a").alias("x")))
    own = rows.groupBy("asset", "day").agg(F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("a") * F.col("b")).alias("p"))
    every = days.select("asset", "day").join(own, ["asset", "day"], "left").na.fill(0.0, ["aa", "p"])
    constant = m.groupBy("asset").agg(F.sum(F.col("b") * F.col("b")).alias("c"))
    here = every.select("asset", F.col("day").alias("i"), F.col("p").alias("pi"))
    pairs = every.join(here, "asset").where("i < day").select("asset", "i", F.col("day").alias("j"), "pi", F.col("p").alias("pj"))
    sums = met.select(F.col("group").alias("asset"), F.col("name").alias("i"), F.col("other").alias("j"), "sxy")
    off = pairs.join(sums, ["asset", "i", "j"], "left").join(constant, "asset").select("asset", "i", "j", (F.coalesce("sxy", F.lit(0.0)) - F.col("pi") - F.col("pj") + F.col("c")).alias("g"))
    diagonal = every.join(constant, "asset").select("asset", F.col("day").alias("i"), F.col("day").alias("j"), (F.col("aa") - 2 * F.col("p") + F.col("c")).alias("g"))
    return off.unionByName(diagonal)


def spectrum(corpus: DataFrame) -> DataFrame:
    """(asset, strategies, days, participation, entropy_number, top_share): of the eigenvalues of the strategies' correlation
    matrix: (sum)^2 / sum of squares, the exponential of the entropy of their shares, and the largest one's share.
    An asset of more than ``MOST_DAYS`` days is an error."""

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        n = int(p["j"].max()) + 1
        if n > MOST_DAYS:
            raise ValueError(f"{n} days; the Gram matrix of a task is bounded by {MOST_DAYS}")
        g = np.zeros((n, n))
        g[p["i"], p["j"]] = g[p["j"], p["i"]] = p["g"]
        values = np.maximum(np.linalg.eigvalsh(g), 0)
        share = values[values > values.sum() * 1e-12] / values.sum()
        row = (p["asset"].iloc[0], n, 1 / (share**2).sum(), float(np.exp(-(share * np.log(share)).sum())), share.max())
        return pd.DataFrame([row], columns=["asset", "days", "participation", "entropy_number", "top_share"])

    kind = dict(corpus.dtypes)["asset"]
    found = gram_matrix(corpus).groupBy("asset").applyInPandas(kernel, f"asset {kind}, days long, participation double, entropy_number double, top_share double")
    counted = corpus_moments(corpus).where("sd > 0").groupBy("asset").agg(F.count("*").alias("strategies"))
    return counted.join(found, "asset").select("asset", "strategies", "days", "participation", "entropy_number", "top_share")


def profit_factor(corpus: DataFrame) -> DataFrame:
    """Per (asset, strategy): gains over losses (infinite without losses, 0 without either), active days, Gini of |pnl|."""
    daily = corpus.groupBy("asset", "strategy", "date").agg(F.sum("pnl").cast("double").alias("x"))
    gain, loss = F.sum(F.greatest(F.col("x"), F.lit(0.0))), F.sum(F.greatest(-F.col("x"), F.lit(0.0)))
    factor = F.when(loss > 0, gain / loss).when(gain > 0, float("inf")).otherwise(0.0)
    return daily.groupBy("asset", "strategy").agg(F.count("*").alias("active"), gain.alias("gains"), loss.alias("losses"), factor.alias("profit_factor"))


def concentration(corpus: DataFrame) -> DataFrame:
    """Per asset, over strategies' total gains: Gini coefficient, Herfindahl index and its inverse."""
    totals = corpus.groupBy("asset", "strategy").agg(F.sum(F.abs("pnl")).cast("double").alias("x"))
    rows = totals.withColumn("_i", F.row_number().over(Window.partitionBy("asset").orderBy("x", "strategy")))
    n, s = F.count("*"), F.sum("x")
    herf = F.sum(F.col("x") * F.col("x")) / (s * s)
    return rows.groupBy("asset").agg((2 * F.sum(F.col("_i") * F.col("x")) / (n * s) - (n + 1) / n).alias("gini"), herf.alias("herfindahl"), (1 / herf).alias("effective"))
