"""Entries, barriers, labels, overlap and uniqueness of labelled spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import by_symbol
from .rolling import full


def triple_barrier(events: DataFrame, bars: DataFrame, take: float, stop: float, hold: int) -> DataFrame:
    """First touch after each event (symbol, ev_idx, side, entry, sigma) on its bars, up to ``hold`` of them.

    Barriers are entry * exp(+-multiple * sigma) in the direction of side. Of one bar that reaches both, the
    stop counts. Exit at the barrier's price, else at the last bar's close: label 1, -1 or 0, touch_idx, hold
    bars and ret (gross, of the side). An event on the last bar has hold 0 and return 0.
    """
    up, down = F.exp(take * F.col("sigma")), F.exp(-stop * F.col("sigma"))
    ev = events.select(
        "symbol", "ev_idx", "side", "entry",
        (F.col("entry") * F.when(F.col("side") > 0, up).otherwise(F.exp(-take * F.col("sigma")))).alias("goal"),
        (F.col("entry") * F.when(F.col("side") > 0, down).otherwise(F.exp(stop * F.col("sigma")))).alias("halt"),
    )
    # An equi join on the bar index of each span: no range join, whatever a symbol's length.
    spans = ev.select("*", F.explode(F.sequence(F.col("ev_idx") + 1, F.col("ev_idx") + hold)).alias("bar_idx"))
    met = spans.join(bars.select("symbol", "bar_idx", "high", "low", "close"), ["symbol", "bar_idx"])
    is_long = F.col("side") > 0
    stopped = F.when(is_long, F.col("low") <= F.col("halt")).otherwise(F.col("high") >= F.col("halt"))
    gained = F.when(is_long, F.col("high") >= F.col("goal")).otherwise(F.col("low") <= F.col("goal"))
    met = met.withColumn("_hit", F.when(stopped, -1).when(gained, 1))
    first = F.min(F.when(F.col("_hit").isNotNull(), F.struct("bar_idx", "_hit")))
    found = met.groupBy("symbol", "ev_idx").agg(first.alias("first"), F.max(F.struct("bar_idx", "close")).alias("end"))
    out = ev.join(found, ["symbol", "ev_idx"], "left")
    label = F.coalesce(F.col("first._hit"), F.lit(0))
    touch = F.coalesce(F.col("first.bar_idx"), F.col("end.bar_idx"), F.col("ev_idx"))
    exit_price = F.when(label == 1, F.col("goal")).when(label == -1, F.col("halt")).otherwise(F.coalesce(F.col("end.close"), F.col("entry")))
    return out.select(
        "symbol", "ev_idx", "side", label.alias("label"), touch.alias("touch_idx"), (touch - F.col("ev_idx")).alias("hold"),
        (F.col("side") * (exit_price / F.col("entry") - 1)).alias("ret"),
    )


def forward_returns(bars: DataFrame, h: int) -> DataFrame:
    """fwd: the log change over the next h bars (null at the end); hold_ret: the same, held at the last bar."""
    at = by_symbol()
    last = F.last("_c").over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = bars.withColumn("_c", F.log("close"))
    ahead = F.lead("_c", h).over(at)
    return rows.withColumns({"fwd": ahead - F.col("_c"), "hold_ret": F.coalesce(ahead, last) - F.col("_c")}).drop("_c")


def slope_t(y: Column, x: Column, window: Window, n: int) -> Column:
    """t statistic of the slope of y on x over a full window of n rows; null for a perfect or empty fit."""
    sxx, syy, sxy = F.var_pop(x).over(window), F.var_pop(y).over(window), F.covar_pop(x, y).over(window)
    rest = syy - sxy * sxy / sxx
    value = F.when((sxx > 0) & (rest > 1e-18), sxy / sxx / F.sqrt(rest / sxx / (n - 2)))
    return full(value, y, window, n)


def horizon_label(bars: DataFrame, length: int) -> DataFrame:
    """t_val: of the trend of the log close over this bar and the length - 1 after it, full windows only; label: its sign."""
    w = by_symbol().rowsBetween(0, length - 1)
    rows = bars.withColumns({"_y": F.log("close"), "_x": F.col("bar_idx").cast("double")})
    rows = rows.withColumn("t_val", slope_t(F.col("_y"), F.col("_x"), w, length))
    return rows.withColumn("label", F.signum("t_val").cast("int")).drop("_x", "_y")


def trend_scan(bars: DataFrame, least: int, most: int, step: int = 1) -> DataFrame:
    """Of the windows from this bar with length least..most, the one of the largest |t| (the shortest of equal
    ones): t_val, length, label (its sign) and ret, the log return over it. x is the place in the window. One ordered
    window gathers at most ``most`` closes; sums along them give all lengths at once."""
    lengths = np.arange(least, most + 1, step)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                held = batch.column(2).to_pylist()
                n = np.array([len(y) for y in held])
                y = np.full((len(held), most), np.nan)
                for i, own in enumerate(held):
                    y[i, : len(own)] = own
                d = y - y[:, :1]
                x = np.arange(most, dtype=float)
                sums = [np.cumsum(v, axis=1)[:, lengths - 1] for v in (d, d * d, d * x)]
                mx, vx = (lengths - 1) / 2, (lengths * lengths - 1) / 12
                my = sums[0] / lengths
                cov, vy = sums[2] / lengths - my * mx, sums[1] / lengths - my * my
                rest = vy - cov * cov / vx
                with np.errstate(invalid="ignore", divide="ignore"):
                    t = cov / vx / np.sqrt(rest / vx / (lengths - 2))
                t[~((n[:, None] >= lengths) & (rest > 1e-18))] = np.nan
                some = np.flatnonzero(np.isfinite(t).any(axis=1))
                best = np.nanargmax(np.abs(t[some]), axis=1)
                own, size = t[some, best], lengths[best]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(pa.array(some)) for i in (0, 1)), pa.array(own), pa.array(size, pa.int32()), pa.array(np.sign(own), pa.int32()), pa.array(d[some, size - 1])],
                    ["symbol", "bar_idx", "t_val", "length", "label", "ret"],
                )

    ahead = F.collect_list(F.log("close")).over(by_symbol().rowsBetween(0, most - 1))
    return bars.select("symbol", "bar_idx", ahead.alias("y")).mapInArrow(kernel, "symbol string, bar_idx bigint, t_val double, length int, label int, ret double")


def _swept(turns: DataFrame, bars: DataFrame, names: list[str]) -> DataFrame:
    """Running sums of the turns' columns at each bar, turns between bars included."""
    rows = bars.select("symbol", "bar_idx", *(F.lit(None).cast(dict(turns.dtypes)[c]).alias(c) for c in names), F.lit(1).alias("_bar"))
    both = rows.unionByName(turns.withColumn("_bar", F.lit(0))).groupBy("symbol", "bar_idx").agg(*(F.sum(c).alias(c) for c in names), F.max("_bar").alias("_bar"))
    upto = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumns({c: F.coalesce(F.sum(c).over(upto), F.lit(0).cast(dict(both.dtypes)[c])) for c in names})
    return run.where("_bar = 1").drop("_bar")


def concurrency(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """How many spans (symbol, start_idx, end_idx, ends included) cover each bar: running sum of starts and ends."""
    turns = spans.select("symbol", F.col("start_idx").alias("bar_idx"), F.lit(1).alias("d")).unionByName(
        spans.select("symbol", (F.col("end_idx") + 1).alias("bar_idx"), F.lit(-1).alias("d"))
    )
    return _swept(turns, bars, ["d"]).withColumnRenamed("d", "concurrent")


def uniqueness(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """Mean of 1 / concurrency over each span, from running sums at its two ends. Keeps the span's columns."""
    upto = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    share = F.when(F.col("concurrent") > 0, 1 / F.col("concurrent")).otherwise(0.0)
    run = concurrency(spans, bars).withColumn("share", share).withColumn("run", F.sum("share").over(upto))
    ends = run.select("symbol", F.col("bar_idx").alias("end_idx"), F.col("run").alias("upto"))
    starts = run.select("symbol", F.col("bar_idx").alias("start_idx"), (F.col("run") - F.col("share")).alias("before"))
    out = spans.join(ends, ["symbol", "end_idx"]).join(starts, ["symbol", "start_idx"])
    n = F.col("end_idx") - F.col("start_idx") + 1
    return out.withColumn("uniqueness", (F.col("upto") - F.col("before")) / n).drop("upto", "before")


def attribution_weights(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """weight: |sum of log return / concurrency over the span|, scaled to a mean of 1 in each symbol."""
    upto = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    r = bars.select("symbol", "bar_idx", F.coalesce(F.log("close") - F.lag(F.log("close")).over(by_symbol()), F.lit(0.0)).alias("r"))
    run = concurrency(spans, bars).join(r, ["symbol", "bar_idx"])
    run = run.withColumn("share", F.when(F.col("concurrent") > 0, F.col("r") / F.col("concurrent")).otherwise(0.0)).withColumn("run", F.sum("share").over(upto))
    ends = run.select("symbol", F.col("bar_idx").alias("end_idx"), F.col("run").alias("upto"))
    starts = run.select("symbol", F.col("bar_idx").alias("start_idx"), (F.col("run") - F.col("share")).alias("before"))
    out = spans.join(ends, ["symbol", "end_idx"]).join(starts, ["symbol", "start_idx"])
    out = out.withColumn("_w", F.abs(F.col("upto") - F.col("before")))
    mean = F.avg("_w").over(Window.partitionBy("symbol"))
    return out.withColumn("weight", F.when(mean > 0, F.col("_w") / mean).otherwise(1.0)).drop("_w", "upto", "before")


def active_bets(bets: DataFrame, bars: DataFrame) -> DataFrame:
    """Mean size of the bets (symbol, start_idx, hold, size) that are open on each bar, [start, start + max(1, hold))."""
    ends = F.col("start_idx") + F.greatest(F.col("hold"), F.lit(1))
    turns = bets.select("symbol", F.col("start_idx").alias("bar_idx"), F.col("size").alias("d"), F.lit(1).alias("n")).unionByName(
        bets.select("symbol", ends.alias("bar_idx"), (-F.col("size")).alias("d"), F.lit(-1).alias("n"))
    )
    rows = _swept(turns, bars, ["d", "n"])
    return rows.select("symbol", "bar_idx", F.col("n").alias("open"), F.when(F.col("n") > 0, F.col("d") / F.col("n")).otherwise(0.0).alias("position"))


def costed_book(positions: DataFrame, bars: DataFrame, cost: float) -> DataFrame:
    """pnl of each bar: position times the next bar's log return, minus cost times the change of position."""
    at = by_symbol()
    rows = positions.join(bars.select("symbol", "bar_idx", "close"), ["symbol", "bar_idx"])
    rows = rows.withColumns({"_next": F.lead(F.log("close")).over(at) - F.log("close"), "turnover": F.abs(F.col("position") - F.coalesce(F.lag("position").over(at), F.lit(0.0)))})
    return rows.withColumn("pnl", F.col("position") * F.coalesce("_next", F.lit(0.0)) - cost * F.col("turnover")).drop("_next", "close")


def purged_folds(events: DataFrame, k: int, embargo: int = 0) -> DataFrame:
    """(fold, symbol, ev_idx, part) of contiguous folds in the order of ev_idx: ``test`` rows, and ``train``
    rows whose span [ev_idx, end_idx] stays clear of the test span and the embargo after it."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    at = F.row_number().over(Window.partitionBy("symbol").orderBy("ev_idx")) - 1
    rows = events.select("symbol", "ev_idx", "end_idx", n.alias("_n"), at.alias("_i"))
    rows = rows.withColumn("_own", F.least(F.expr(f"_i div greatest(_n div {k}, 1)"), F.lit(k - 1)))
    tests = rows.groupBy("symbol", F.col("_own").alias("fold")).agg(F.min("ev_idx").alias("lo"), F.max("end_idx").alias("hi"))
    each = rows.join(tests, "symbol")  # k rows for each event
    clear = (F.col("end_idx") < F.col("lo")) | (F.col("ev_idx") > F.col("hi") + embargo)
    part = F.when(F.col("_own") == F.col("fold"), "test").when(clear, "train")
    return each.withColumn("part", part).where("part is not null").select("fold", "symbol", "ev_idx", "part")
