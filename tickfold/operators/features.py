"""Feature tables of event studies, z-score entries, regimes, and what a forest makes of features."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ieee import ln, over
from .bars import by_symbol
from .lineage import cut
from .returns import flow_imbalance
from .rolling import with_ewm
from .sequential import along


def price_z(bars: DataFrame, span: float) -> DataFrame:
    """z: log price less its exponentially weighted mean, over its weighted deviation; 0 where that is 0."""
    rows = with_ewm(bars.withColumn("_c", F.log("close")), {"_m": ("_c", span, "mean"), "_s": ("_c", span, "std")})
    return rows.withColumn("z", F.when(F.col("_s") > 0, (F.col("_c") - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_c", "_m", "_s")


def fresh_extremes(bars: DataFrame, span: float, limit: float, warmup: int = 0) -> DataFrame:
    """Bars whose |z| reaches the limit while that of the bar before did not; side against the move. A symbol's
    first ``warmup`` bars are none."""
    at = by_symbol()
    before = F.coalesce(F.abs(F.lag("z").over(at)), F.lit(0.0))
    rows = price_z(bars, span).withColumns({"_b": before, "_n": F.row_number().over(at)})
    fresh = (F.abs("z") >= limit) & (F.col("_b") < limit) & (F.col("_n") > warmup)
    return rows.where(fresh).withColumn("side", -F.signum("z").cast("int")).drop("_b", "_n")


def event_features(bars: DataFrame, fast: float = 10, slow: float = 50, lags: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """Causal features of each bar: side and gap of two means, weighted deviation and its ratio to a longer one,
    log momenta, Wilder's relative strength scaled to [-1, 1], flow imbalance and weighted range."""
    at = by_symbol()
    rows = bars.withColumn("_r", F.coalesce(ln("close") - F.lag(ln("close")).over(at), F.lit(0.0)))
    rows = rows.withColumns({"_up": F.greatest("_r", F.lit(0.0)), "_dn": F.greatest(-F.col("_r"), F.lit(0.0)), "_hl": ln("high") - ln("low")})
    rows = rows.withColumn("ofi", flow_imbalance(F.col("buy_dollar"), F.col("sell_dollar")))
    wilder = 27  # a span of 27 has the weight 1/14
    rows = with_ewm(rows, {
        "_f": ("close", fast, "mean"), "_s": ("close", slow, "mean"), "vol": ("_r", slow, "std"), "_v2": ("_r", 4 * slow, "std"),
        "_u": ("_up", wilder, "mean"), "_d": ("_dn", wilder, "mean"), "range": ("_hl", slow, "mean"),
    }, infinite=True)
    strength = F.coalesce(F.try_divide(F.col("_u") - F.col("_d"), F.col("_u") + F.col("_d")), F.lit(0.0))
    momenta = {f"momentum_{k}": ln("close") - F.lag(ln("close"), k).over(at) for k in lags}
    rows = rows.withColumns({
        "side": F.signum(F.col("_f") - F.col("_s")).cast("int"), "gap": ln(over(F.col("_f"), F.col("_s"))), "strength": strength,
        "vol_ratio": F.when(F.col("_v2") > 0, F.col("vol") / F.col("_v2")).otherwise(1.0), **momenta,
    })
    return rows.select("symbol", "bar_idx", "side", "gap", "vol", "vol_ratio", *momenta, "strength", "ofi", "range")


def regimes(returns: DataFrame, rounds: int = 50) -> DataFrame:
    """Per symbol and bar: filtered probability of the state of the higher variance in a Gaussian model of two
    hidden states, fitted by expectation-maximisation to the symbol's returns (a symbol is a group)."""

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        x = p["ret"].to_numpy(float)
        if len(x) < 20 or x.std() == 0:
            return pd.DataFrame({"symbol": p["symbol"], "bar_idx": p["bar_idx"], "turbulent": 0.0})
        mean, sd = np.array([x.mean()] * 2), x.std() * np.array([0.5, 1.5])
        move, start = np.array([[0.95, 0.05], [0.05, 0.95]]), np.array([0.5, 0.5])
        for _ in range(rounds):
            like = np.exp(-0.5 * ((x[:, None] - mean) / sd) ** 2) / sd + 1e-300
            ahead, back, scale = np.empty_like(like), np.ones_like(like), np.empty(len(x))
            now = start * like[0]
            for i in range(len(x)):
                now = now if i == 0 else (ahead[i - 1] @ move) * like[i]
                scale[i] = now.sum()
                ahead[i] = now / scale[i]
            for i in range(len(x) - 2, -1, -1):
                back[i] = move @ (like[i + 1] * back[i + 1]) / scale[i + 1]
            post = ahead * back
            post /= post.sum(1, keepdims=True)
            pairs = ahead[:-1, :, None] * move * (like[1:] * back[1:] / scale[1:, None])[:, None, :]
            move = pairs.sum(0) / pairs.sum((0, 2))[:, None]
            start = post[0]
            mean = (post * x[:, None]).sum(0) / post.sum(0)
            sd = np.sqrt(np.maximum((post * (x[:, None] - mean) ** 2).sum(0) / post.sum(0), 1e-12))
        return pd.DataFrame({"symbol": p["symbol"], "bar_idx": p["bar_idx"], "turbulent": ahead[:, int(np.argmax(sd))]})

    return along(returns.select("symbol", "bar_idx", "ret"), ["bar_idx"], "symbol string, bar_idx bigint, turbulent double", kernel)


#: Rows of a bucket within which a feature is shuffled.
SHUFFLED = 50_000

#: The largest double, which stands for an infinite one where numbers must be finite; trees only ask for the order.
LARGEST = sys.float_info.max


def forest_importance(rows: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """Per feature: mdi, its share of impurity decrease in a forest of all rows, and mda, the accuracy lost when the
    feature alone is shuffled across the rows that the forest didn't train on (every fourth by a hash). Infinite values
    are above or below all others; rows without a feature are left out."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = rows.sparkSession
    held = (F.greatest(F.least(F.col(c).cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)).alias(c) for c in features)
    marked = rows.select(*features, F.col(label).cast("double").alias("_y")).dropna().select(*held, "_y").withColumn("_h", F.pmod(F.xxhash64(*features), F.lit(4)))
    marked = cut(marked)  # the forest and each feature's test read it again
    vectors = VectorAssembler(inputCols=features, outputCol="_x")
    model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).fit(vectors.transform(marked.where("_h > 0")))
    test = marked.where("_h = 0")

    def accuracy(df: DataFrame) -> float:
        return float(model.transform(vectors.transform(df)).agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0] or 0.0)

    base, out = accuracy(test), []
    # Rows are shuffled within buckets by hash of about so many rows each, so that no task orders the whole part.
    buckets = F.lit(max(1, test.count() // SHUFFLED))
    test = test.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed + 1), *features), buckets))
    by, to = (Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(k), *features), "_y") for k in (0, seed))
    places = test.withColumns({"_i": F.row_number().over(by), "_j": F.row_number().over(to)})
    for i, name in enumerate(features):
        other = places.select("_b", F.col("_j").alias("_i"), F.col(name).alias("_other"))
        mixed = places.join(other, ["_b", "_i"]).withColumn(name, F.col("_other"))
        out.append((name, float(model.featureImportances[i]), base - accuracy(mixed)))
    return spark.createDataFrame(out, "feature string, mdi double, mda double")
