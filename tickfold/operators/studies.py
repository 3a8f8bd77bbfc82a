"""Further measures of studies: labels, ledgers, books, pairs, validation and simulations."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..functions.ieee import ln
from .bars import by_symbol
from .lineage import cut
from .pairs import leading_pairs
from .rolling import full, trailing


def bulk_buy_fraction(bars: DataFrame, n: int = 50) -> DataFrame:
    """bvc: normal probability of the log price change over its deviation of the last n changes; a half where
    that deviation isn't there yet or is 0."""
    rows = bars.withColumn("_d", F.log("close") - F.lag(F.log("close")).over(by_symbol()))
    w = trailing(n)
    sd = full(F.stddev_samp("_d").over(w), F.col("_d"), w, n)
    rows = rows.withColumn("_z", F.coalesce(F.when(sd > 0, F.col("_d") / sd), F.lit(0.0)))
    return rows.withColumn("bvc", F.expr(normal.cdf("_z"))).drop("_d", "_z")


def next_labels(bars: DataFrame, h: int, span: int = 12) -> DataFrame:
    """up: whether the next return is above 0; large: whether its size exceeds the mean size of the last ``span``
    returns (the first bar's counts as 0); fwd_vol: sum of the sizes of the next h returns; null where rows lack."""
    at = by_symbol()
    rows = bars.withColumn("_r", F.coalesce(F.log("close") - F.lag(F.log("close")).over(at), F.lit(0.0)))
    past = at.rowsBetween(1 - span, 0)
    ahead = at.rowsBetween(1, h)
    usual = full(F.avg(F.abs("_r")).over(past), F.col("_r"), past, span)
    after = F.lead("_r").over(at)
    vol = F.when(F.count("_r").over(ahead) == h, F.sum(F.abs("_r")).over(ahead))
    return rows.withColumns({"up": (after > 0).cast("int"), "large": (F.abs(after) > usual).cast("int"), "fwd_vol": vol}).drop("_r")


def factor_series(bars: DataFrame, k: int) -> DataFrame:
    """compounded: return over the last k bars; deviation of those returns; both of the bar before."""
    at, w = by_symbol(), trailing(k)
    rows = bars.withColumn("_r", F.col("close") / F.lag("close").over(at) - 1)
    total = full(F.exp(F.sum(F.log(1 + F.col("_r"))).over(w)) - 1, F.col("_r"), w, k)
    rows = rows.withColumns({"_t": total, "_s": full(F.stddev_samp("_r").over(w), F.col("_r"), w, k)})
    return rows.withColumns({"compounded": F.lag("_t").over(at), "deviation": F.lag("_s").over(at)}).drop("_r", "_t", "_s")


def cells(ledger: DataFrame, keys: list[str], pnl: str) -> DataFrame:
    """Per key: rows, sum, sum of gains and sum of losses (as a positive number)."""
    x = F.col(pnl)
    return ledger.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.sum(F.greatest(x, F.lit(0))).alias("gains"), F.sum(F.greatest(-x, F.lit(0))).alias("losses"))


def write_ledger(ledger: DataFrame, path: str) -> None:
    """A ledger as zstd parquet, by combo and window in each file."""
    ledger.sortWithinPartitions("combo_id", "window_id").write.option("compression", "zstd").parquet(path)


def spread_over_bars(trades: DataFrame) -> DataFrame:
    """pnl of trades (symbol, start_idx, hold, pnl) in equal parts on the bars [start, start + max(1, hold))."""
    n = F.greatest(F.col("hold"), F.lit(1))
    each = trades.select("symbol", (F.col("pnl") / n).alias("part"), F.explode(F.sequence("start_idx", F.col("start_idx") + n - 1)).alias("bar_idx"))
    return each.groupBy("symbol", "bar_idx").agg(F.sum("part").alias("pnl"))


def volatility_target(bars: DataFrame, n: int, target: float, most: float = 5.0) -> DataFrame:
    """leverage: target over the deviation of the last n returns, of the bar before, at most ``most``; 0 before it is known."""
    at, w = by_symbol(), trailing(n)
    rows = bars.withColumn("_r", F.log("close") - F.lag(F.log("close")).over(at))
    rows = rows.withColumn("_s", full(F.stddev_samp("_r").over(w), F.col("_r"), w, n))
    sd = F.lag("_s").over(at)
    return rows.withColumn("leverage", F.when(sd > 0, F.least(target / sd, F.lit(most))).otherwise(0.0)).drop("_r", "_s")


def closest_pairs(panel: DataFrame, least_days: int, top: int) -> DataFrame:
    """The ``top`` most correlated pairs of names (name < other) with so many dates in common; a report."""
    pairs = leading_pairs(panel, top, least_days).withColumn("corr", F.round("corr", 9))
    return pairs.where(F.col("n") >= least_days).orderBy(F.desc(F.abs("corr")), "name", "other").limit(top)


def combinatorial_folds(events: DataFrame, k: int, test: int = 2, embargo: int = 0) -> DataFrame:
    """(split, symbol, ev_idx, part) for every choice of ``test`` of k contiguous folds; training rows stay clear
    of each test fold's span and the embargo after it."""
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("ev_idx")) - 1
    n = F.count("*").over(Window.partitionBy("symbol"))
    rows = events.select("symbol", "ev_idx", "end_idx", i.alias("_i"), n.alias("_n"))
    rows = rows.withColumn("_own", F.least(F.expr(f"_i div greatest(_n div {k}, 1)"), F.lit(k - 1)))
    spans = rows.groupBy("symbol", F.col("_own").alias("fold")).agg(F.min("ev_idx").alias("lo"), F.max("end_idx").alias("hi"))
    clash = (F.col("end_idx") >= F.col("lo")) & (F.col("ev_idx") <= F.col("hi") + embargo)
    met = rows.join(spans, "symbol").groupBy("symbol", "ev_idx", "_own").agg(F.collect_set(F.when(clash, F.col("fold"))).alias("_near"))
    chosen = F.array(*(F.array(*map(F.lit, c)) for c in combinations(range(k), test)))
    each = met.select("symbol", "ev_idx", "_own", "_near", F.posexplode(chosen).alias("split", "_test"))
    part = F.when(F.array_contains("_test", F.col("_own").cast("int")), "test").when(~F.arrays_overlap(F.transform("_near", lambda f: f.cast("int")), "_test"), "train")
    return each.select("split", "symbol", "ev_idx", part.alias("part")).where("part is not null")


def average_rank(x: Column, *keys: str) -> Column:
    """Rank from 1, ties at their mean."""
    w = Window.partitionBy(*keys).orderBy(x)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def rank_persistence(rows: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Spearman correlation of two columns per key, ties at their mean."""
    ranked = rows.withColumns({"_a": average_rank(F.col(before), *keys), "_b": average_rank(F.col(after), *keys)})
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("spearman"))


def area_under_curve(rows: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """AUC per key from the rank sum of label 1, ties at their mean; null with one label only."""
    ranked = rows.withColumn("_r", average_rank(F.col(score), *keys))
    p, n = F.sum(F.col(label)), F.sum(1 - F.col(label))
    return ranked.groupBy(*keys).agg(p.cast("bigint").alias("positives"), n.cast("bigint").alias("negatives"), F.try_divide(F.sum(F.when(F.col(label) == 1, F.col("_r"))) - p * (p + 1) / 2, p * n).alias("auc"))


def sign_rule(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per key: side of a feature split at its training median, the sign of y above minus below in training, and
    the mean of side times y in test. rows has part (train or test)."""
    median = rows.where("part = 'train'").groupBy(*keys).agg(F.percentile(x, F.lit(0.5)).alias("_m"))
    split = rows.join(median, keys).withColumn("_s", F.when(F.col(x) > F.col("_m"), 1).otherwise(-1))
    train = F.col("part") == "train"
    mean = lambda s: F.coalesce(F.avg(F.when(train & (F.col("_s") == s), F.col(y))), F.lit(0.0))
    gain = F.avg(F.when(~train, F.col("_s") * F.col(y)))
    out = split.groupBy(*keys).agg((mean(1) - mean(-1)).alias("_d"), gain.alias("_g"), F.sum((~train).cast("int")).alias("n_test"))
    return out.select(*keys, F.signum("_d").cast("int").alias("orientation"), (F.signum("_d") * F.col("_g")).alias("mean_pnl"), "n_test")


def penance(returns: DataFrame, z: float = 1.645) -> DataFrame:
    """Per symbol, from the first autocorrelation phi: k = (1 + phi) / (1 - phi), and the drawdown (z sd)^2 / 4 mean
    and time under water (z sd / mean)^2 that follow at this confidence, null for a mean that isn't above 0."""
    rows = returns.withColumn("_l", F.lag("ret").over(by_symbol()))
    m = rows.groupBy("symbol").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.corr("ret", "_l").alias("phi"))
    up = F.col("mean") > 0
    return m.select("symbol", "phi", F.try_divide(1 + F.col("phi"), 1 - F.col("phi")).alias("k"), F.when(up, F.pow(z * F.col("sd"), 2) / 4 / F.col("mean")).alias("drawdown"), F.when(up, F.pow(z * F.col("sd") / F.col("mean"), 2)).alias("under_water"))


def leak_screen(panel: DataFrame, x: str, least: int = 8) -> DataFrame:
    """Mean per-date correlation of a feature with the return of the date before, the same and the next one."""
    w = Window.partitionBy("name").orderBy("date")
    rows = panel.withColumns({"_b": F.lag("ret").over(w), "_a": F.lead("ret").over(w)})
    by = rows.groupBy("date").agg(F.count("*").alias("n"), *(F.corr(x, c).alias(c) for c in ("_b", "ret", "_a"))).where(F.col("n") >= least)
    return by.agg(F.count("*").alias("dates"), F.avg("_b").alias("before"), F.avg("ret").alias("same"), F.avg("_a").alias("after"))


def reversal(panel: DataFrame, names: int, flat: float, per_turn: float) -> DataFrame:
    """Per date: mean return of the ``names`` lowest x less that of the highest, gross, less a flat cost, and less a
    cost by turnover against the date before."""
    n = F.count("*").over(Window.partitionBy("date"))
    low = F.row_number().over(Window.partitionBy("date").orderBy("x", "name"))
    rows = panel.withColumns({"_n": n, "_lo": low})
    rows = rows.withColumn("w", F.when(F.col("_n") >= 2 * names, F.when(F.col("_lo") <= names, 1 / names).when(F.col("_lo") > F.col("_n") - names, -1 / names)).cast("double"))
    held = rows.where("w is not null").select("date", "name", "w", "ret")
    days = held.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))
    old = held.join(days, "date").where("next is not null").select(F.col("next").alias("date"), "name", F.col("w").alias("was"))
    both = held.join(old, ["date", "name"], "full").withColumn("t", F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))
    by = both.groupBy("date").agg(F.sum(F.coalesce(F.col("w") * F.col("ret"), F.lit(0.0))).alias("gross"), F.sum("t").alias("turnover"))
    return by.withColumns({"net_flat": F.col("gross") - flat, "net_turnover": F.col("gross") - per_turn * F.col("turnover")})


def spread_bars(a: DataFrame, b: DataFrame, beta: float) -> DataFrame:
    """Bars of ln A - beta ln B where both have the bar; high and low are the worst cases of the two legs."""
    other = b.select("bar_idx", *(F.col(c).alias(f"_{c}") for c in ("open", "high", "low", "close")))
    rows = a.join(other, "bar_idx")
    leg = lambda x, y: ln(x) - beta * ln(y)
    up, down = ("_low", "_high") if beta > 0 else ("_high", "_low")
    return rows.select("bar_idx", leg("open", "_open").alias("open"), leg("high", up).alias("high"), leg("low", down).alias("low"), leg("close", "_close").alias("close"))


def hac(series: DataFrame, keys: list[str], order: str, y: str, lags: int = 5) -> DataFrame:
    """n and mean of y per key and se, the mean's Newey-West error over row order; null for one of 0."""
    m = series.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(y).alias("mean"))
    w = Window.partitionBy(*keys).orderBy(order)
    rows = series.join(m, keys).withColumn("_e", F.col(y) - F.col("mean"))
    rows = rows.withColumns({f"_l{k}": F.col("_e") * F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    total = F.sum(F.col("_e") * F.col("_e"))
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_l{k}"), F.lit(0.0))
    out = rows.groupBy(*keys, "n", "mean").agg(total.alias("v"))
    return out.select(*keys, "n", "mean", F.when(F.col("v") > 0, F.sqrt("v") / F.col("n")).alias("se"))


def hac_t(series: DataFrame, keys: list[str], order: str, y: str, lags: int = 5) -> DataFrame:
    """Mean of y per key and its t with Newey-West errors over row order."""
    return hac(series, keys, order, y, lags).select(*keys, "n", "mean", (F.col("mean") / F.col("se")).alias("t"))


def block_bootstrap(series: DataFrame, keys: list[str], order: str, y: str, draws: int, block: int, seed: int) -> DataFrame:
    """Per key: the 2.5 % and 97.5 % points of the mean of y over resamples of circular blocks; a key's series is a group."""

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values(order, kind="stable")[y].to_numpy(float)
        rng = np.random.default_rng([seed, *str(tuple(p[k].iloc[0] for k in keys)).encode()])
        n = len(x)
        starts = rng.integers(0, n, (draws, -(-n // block)))
        means = [x[(s[:, None] + np.arange(block)).ravel()[:n] % n].mean() for s in starts]
        lo, hi = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame([[*(p[k].iloc[0] for k in keys), n, x.mean(), lo, hi]], columns=[*keys, "n", "mean", "low", "high"])

    types = dict(series.dtypes)
    return series.groupBy(*keys).applyInPandas(kernel, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n bigint, mean double, low double, high double")


def causal_structures(spark: SparkSession, sims: int, rows: int, seed: int) -> DataFrame:
    """Per structure: how often a regression of y on x is significant at 5 % without and with the third variable,
    where x doesn't cause y: fork (z causes both), chain (x causes z causes y) and collider (both cause z)."""

    def kernel(parts):
        for p in parts:
            out = []
            for i in p["id"]:
                rng = np.random.default_rng([seed, int(i)])
                e = rng.normal(size=(3, rows))
                for name in ("fork", "chain", "collider"):
                    if name == "fork":
                        z = e[0]
                        x, y = z + e[1], z + e[2]
                    elif name == "chain":
                        x = e[0]
                        z = x + e[1]
                        y = z + e[2]
                    else:
                        x, y = e[0], e[1]
                        z = x + y + e[2]
                    hits = []
                    for controls in ((), (z,)):
                        a = np.column_stack([x, np.ones(rows), *controls])
                        inv = np.linalg.inv(a.T @ a)
                        b = inv @ (a.T @ y)
                        r = y - a @ b
                        hits.append(abs(b[0] / np.sqrt(r @ r / (rows - a.shape[1]) * inv[0, 0])) > 1.96)
                    out.append((name, *map(int, hits)))
            yield pd.DataFrame(out, columns=["structure", "naive", "adjusted"])

    each = spark.range(sims).mapInPandas(kernel, "structure string, naive int, adjusted int")
    return each.groupBy("structure").agg(F.count("*").alias("sims"), F.avg("naive").alias("naive"), F.avg("adjusted").alias("adjusted"))


def ou_mesh(spark: SparkSession, phi: float, sigma: float, start: float, takes: list[float], stops: list[float], paths: int, horizon: int, seed: int) -> DataFrame:
    """Per (take, stop), in units of sigma: mean, deviation and ratio of results of paths of a mean-reverting
    process that leave at either barrier or at the horizon. All barriers see the same paths; chunks of paths run
    apart and give sums."""
    grid = [(t, s) for t in takes for s in stops]

    def kernel(parts):
        for p in parts:
            for chunk in p["id"]:
                rng = np.random.default_rng([seed, int(chunk)])
                x = np.full(100, start)
                done = np.zeros((len(grid), 100), bool)
                gain = np.zeros((len(grid), 100))
                for _ in range(horizon):
                    x = phi * x + sigma * rng.normal(size=100)
                    move = x - start
                    for g, (take, stop) in enumerate(grid):
                        out = ~done[g] & ((move >= take * sigma) | (move <= -stop * sigma))
                        gain[g][out] = move[out]
                        done[g] |= out
                gain = np.where(done, gain, x - start)
                yield pd.DataFrame({"take": [g[0] for g in grid], "stop": [g[1] for g in grid], "n": 100, "s1": gain.sum(1), "s2": (gain**2).sum(1)})

    sums = spark.range(-(-paths // 100)).mapInPandas(kernel, "take double, stop double, n bigint, s1 double, s2 double")
    t = sums.groupBy("take", "stop").agg(*(F.sum(c).alias(c) for c in ("n", "s1", "s2")))
    mean = F.col("s1") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    return t.select("take", "stop", "n", mean.alias("mean"), sd.alias("sd"), F.when(sd > 0, mean / sd).otherwise(0.0).alias("ratio"))


def forest_scores(rows: DataFrame, features: list[str], label: str, k: int, weight: str | None = None, trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """Out-of-fold probabilities of a random forest on purged folds: rows has fold (of its own) and, per fold f, an
    array ``trains`` of the folds whose training set has it. Spark trains each fold's forest over all its rows, which
    are written once, as a forest reads them many times."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = cut(rows)
    table = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(rows)
    out = None
    for f in range(k):  # k models; the rows stay where they are
        forest = RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, **({"weightCol": weight} if weight else {}))
        model = forest.fit(table.where(F.array_contains("trains", f)))
        part = model.transform(table.where(F.col("fold") == f)).withColumn("p", vector_to_array("probability")[1])
        part = part.select(*rows.columns, "p")
        out = part if out is None else out.unionByName(part)
    return out


def market_of(name: Column, skip_legacy: bool = True) -> Column:
    """crypto, equity or fx from an asset's name; a name with ``forex`` is legacy and skipped (null), or fx."""
    low = F.lower(name)
    return (
        F.when(low.contains("forex"), F.lit(None).cast("string") if skip_legacy else F.lit("fx"))
        .when(low.rlike("(usdt|usdc|busd|perp)$"), "crypto").when(low.rlike("^[a-z]{6}$"), "fx").otherwise("equity")
    )


def walk_windows(n: Column, inside: int, step: int) -> Column:
    """Array of structs (fold, from, split, to) of windows whose out-of-sample steps don't overlap."""
    last = F.floor((n - inside) / step).cast("int") - 1
    make = lambda f: F.struct(f.alias("fold"), (f * step).alias("from"), (f * step + inside).alias("split"), (f * step + inside + step).alias("to"))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), make))
