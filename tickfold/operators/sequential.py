"""Operators whose state runs along a symbol; Spark deals the symbols, and a small kernel walks one in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import adf, adf_critical, fractional_weights
from .bars import by_symbol
from .streamed import streamed


def along(df: DataFrame, order: list[str], shape: str, kernel: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``kernel`` of each symbol's rows in order."""
    return df.groupBy("symbol").applyInPandas(lambda p: kernel(p.sort_values(order, kind="stable").reset_index(drop=True)), shape)


def cusum_events(bars: DataFrame, limit: float, strict: bool = True, column: str = "log_close") -> DataFrame:
    """(symbol, bar_idx, side) where the upward or downward sum of changes passes ``limit``; only the side that
    fired starts again. strict: changes of the level ``column``, over the limit; else ``column`` are returns, and
    reaching the limit is enough: the two conventions in use."""

    def start() -> Callable[..., tuple]:
        up, down, was = 0.0, 0.0, None

        def step(x: float | None) -> tuple:
            nonlocal up, down, was
            x = float("nan") if x is None else x
            change = x if not strict else x - was if was is not None else 0.0
            was = x
            up, down = max(0.0, up + change), min(0.0, down + change)  # a change that isn't known starts both sums again
            if up > limit or not strict and up >= limit:
                up = 0.0
                return (1,)
            if down < -limit or not strict and down <= -limit:
                down = 0.0
                return (-1,)
            return (None,)

        return step

    rows = bars.select("symbol", "bar_idx", F.col(column).cast("double").alias("_x"))
    return streamed(rows, ["bar_idx"], ["_x"], start, {"side": "int"}).where("side is not null").select("symbol", "bar_idx", "side")


def with_state(rows: DataFrame, order: list[str], columns: list[str], start: Callable[[], Callable[..., int]]) -> DataFrame:
    """``rows`` with bar_idx: a symbol's step takes a row's ``columns`` and returns its bar."""

    def one() -> Callable[..., tuple]:
        step = start()
        return lambda *values: (step(*values),)

    return streamed(rows, order, columns, one, {"bar_idx": "bigint"})


#: Weight of a closed bar in the running expectations, and the longest imbalance bar in expected sizes.
ALPHA, LONGEST = 2 / 201, 50.0


def _imbalance(warmup: int) -> Callable[..., int]:
    bar, theta, size, mean = 0, 0.0, 0.0, None

    def step(flow: float, weight: float, expected: float) -> int:
        nonlocal bar, theta, size, mean
        theta, size, own = theta + flow, size + weight, bar
        if mean is None or bar < warmup:
            close = size >= expected
        else:
            limit = expected * abs(mean)
            close = limit > 0 and abs(theta) >= limit or size >= LONGEST * expected
        if close and size > 0:
            mean = theta / size if mean is None else ALPHA * (theta / size) + (1 - ALPHA) * mean
            bar, theta, size = bar + 1, 0.0, 0.0
        return own

    return step


def _runs(warmup: int) -> Callable[..., int]:
    bar, buys, sells, size, mean, share = 0, 0.0, 0.0, 0.0, None, None

    def step(flow: float, weight: float, expected: float) -> int:
        nonlocal bar, buys, sells, size, mean, share
        mean = expected if mean is None else mean
        buys, sells, size, own = buys + (weight if flow > 0 else 0.0), sells + (weight if flow < 0 else 0.0), size + weight, bar
        larger = 0.5 if share is None or bar < warmup else max(share, 1 - share)
        if max(buys, sells) >= mean * larger and size > 0:
            mean = ALPHA * size + (1 - ALPHA) * mean
            share = buys / size if share is None else ALPHA * (buys / size) + (1 - ALPHA) * share
            bar, buys, sells, size = bar + 1, 0.0, 0.0, 0.0
        return own

    return step


def imbalance_ids(ticks: DataFrame, n_target: int, kind: str = "imbalance", weight: str | None = None) -> DataFrame:
    """``ticks`` with bar_idx of imbalance or run bars; the crossing row belongs to the bar it closes.

    Without ``weight``, each row weighs 1 and flows by the tick rule's sign; else it weighs that column, and flows
    by its net taker side. The expected size is T = sum of weights / n_target. The first ``max(20, n_target // 20)``
    imbalance bars close at size T; later ones where |sum of flows| >= T |E[flow / size]|, or at 50 T. A run bar closes
    where the larger side's weight is T times its expected share, at first a half. Expectations follow closed bars
    exponentially; T stays for imbalance bars and follows the size of run bars.
    """
    first = Window.partitionBy("symbol").orderBy("us", "id")
    if weight is None:
        change = F.signum(F.col("price") - F.lag("price").over(first))
        rows = ticks.withColumns({"_c": change, "_w": F.lit(1.0)})
        flow = F.coalesce(F.last(F.when(F.col("_c") != 0, F.col("_c")), True).over(first), F.lit(1.0))
    else:
        rows = ticks.withColumns({"_c": F.lit(0.0), "_w": F.col(weight).cast("double")})
        flow = F.when(F.col("dollar") > 0, F.when(F.col("buy"), F.col("_w")).otherwise(-F.col("_w"))).otherwise(0.0)
    total = rows.groupBy("symbol").agg((F.sum("_w") / n_target).alias("_t"))
    least = 1.0 if weight is None else 1e-9
    rows = rows.withColumn("_f", flow).join(total, "symbol").withColumn("_t", F.greatest("_t", F.lit(least)))
    warmup, each = max(20, n_target // 20), _imbalance if kind == "imbalance" else _runs
    return with_state(rows, ["us", "id"], ["_f", "_w", "_t"], lambda: each(warmup)).select(*ticks.columns, "bar_idx")


def hybrid_ids(ticks: DataFrame, n_target: int, cap_us: int, column: str = "dollar") -> DataFrame:
    """``ticks`` with bar_idx: a row opens a new bar where the activity reaches total / n_target or ``cap_us``
    has gone by; both start again there."""

    def start() -> Callable[..., int]:
        bar, total, since = 0, 0, None

        def step(us: int, activity: int, limit: int) -> int:
            nonlocal bar, total, since
            total += activity
            if since is not None and (total * n_target >= limit or us - since >= cap_us):
                bar, total, since = bar + 1, 0, us
            since = us if since is None else since
            return bar

        return step

    total = ticks.groupBy("symbol").agg(F.sum(column).cast("decimal(38,0)").alias("_t"))
    rows = ticks.withColumn("_x", F.col(column).cast("bigint")).join(total, "symbol").withColumn("_t", F.col("_t").cast("bigint"))
    return with_state(rows, ["us", "id"], ["us", "_x", "_t"], start).select(*ticks.columns, "bar_idx")


def fractional_difference(bars: DataFrame, d: float, tau: float, column: str = "log_close") -> DataFrame:
    """Column ffd: the level's fractional difference of order d with weights down to ``tau``, as one ordered
    window per row; null on a symbol's first rows."""
    weights = fractional_weights(d, tau)
    w = by_symbol().rowsBetween(1 - len(weights), 0)
    # Weights run from the oldest row to the newest, as the collected window does.
    held = F.array(*(F.lit(float(x)) for x in weights[::-1]))
    window = F.collect_list(column).over(w)
    value = F.aggregate(F.zip_with(window, held, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return bars.withColumn("ffd", F.when(F.count(column).over(w) == len(weights), value))


def least_order(bars: DataFrame, tau: float = 1e-3, step: float = 0.05, column: str = "log_close") -> DataFrame:
    """Per symbol: the least order d of 0, step .. 1 whose difference passes the Dickey-Fuller test at 5 %, its
    statistic, the correlation with the level that is left, and the rows; null d where none passes."""

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        y, found = p[column].to_numpy(float), (np.nan, np.nan, np.nan, 0)
        for d in np.arange(0, 1 + step / 2, step):
            w = fractional_weights(float(d), tau)
            if len(y) - len(w) + 1 <= 50:
                continue
            x = np.convolve(y, w, "valid")
            stat, n = adf(x)
            if n > 50 and stat < adf_critical(n):
                found = (round(float(d), 10), stat, float(np.corrcoef(x, y[len(w) - 1 :])[0, 1]) if d else 1.0, n)
                break
        return pd.DataFrame([(p["symbol"][0], *found)], columns=["symbol", "d", "statistic", "memory", "n"])

    return along(bars.select("symbol", "bar_idx", column), ["bar_idx"], "symbol string, d double, statistic double, memory double, n bigint", kernel)


def explosiveness(bars: DataFrame, least: int = 60, most: int | None = 250, column: str = "log_close") -> DataFrame:
    """sadf: for each bar the largest Dickey-Fuller statistic (constant, one lag) of the windows of least..most
    rows that end there, of any longer ones too where most is None. Sums of products over starts make each window's regression from differences of sums."""

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        y = p[column].to_numpy(float)
        dy = np.diff(y)
        rows = np.column_stack([y[1:-1], np.ones(max(len(y) - 2, 0)), dy[:-1], dy[1:]]) if len(y) > 2 else np.empty((0, 4))
        run = np.concatenate([np.zeros((1, 4, 4)), np.cumsum(rows[:, :, None] * rows[:, None, :], axis=0)])
        out = np.full(len(y), np.nan)
        for end in range(least, len(y) + 1):
            starts = np.arange(max(0, end - most) if most else 0, end - least + 1)
            m = run[end - 2] - run[starts]
            n = end - 2 - starts
            xtx, xty, yy = m[:, :3, :3], m[:, :3, 3], m[:, 3, 3]
            good = (np.linalg.det(xtx) > 1e-12) & (n > 3)
            if not good.any():
                continue
            inv = np.linalg.inv(xtx[good])
            b = np.einsum("kij,kj->ki", inv, xty[good])
            rest = yy[good] - np.einsum("ki,ki->k", b, xty[good])
            v = rest / (n[good] - 3) * inv[:, 0, 0]
            t = b[:, 0] / np.sqrt(np.where(v > 0, v, np.nan))
            if np.isfinite(t).any():
                out[end - 1] = np.nanmax(t)
        return pd.DataFrame({"symbol": p["symbol"], "bar_idx": p["bar_idx"], "sadf": out})

    return along(bars.select("symbol", "bar_idx", column), ["bar_idx"], "symbol string, bar_idx bigint, sadf double", kernel)


class SpanDraws:
    """Draws of spans in proportion to their average uniqueness given those drawn before: the mean over a span's bars
    of 1 / (draws on the bar + 1).

    Spans are in the order of their starts, so that those a draw touches are a run of them: it ends before the first
    that starts behind the draw, and begins where some end first reaches it. Only their odds change, and the sums
    of their blocks; a draw finds its block first. Nothing is as large as spans times bars.
    """

    def __init__(self, start: np.ndarray, end: np.ndarray):
        self.start, self.end, self.length = start - start.min(), end - start.min(), (end - start + 1).astype(float)
        self.reach = np.maximum.accumulate(self.end)
        self.counts = np.zeros(int(self.end.max()) + 1, np.int64)
        self.block = max(1, int(len(start) ** 0.5))
        self.odds = np.ones(len(start))
        self.sums = np.add.reduceat(self.odds, np.arange(0, len(start), self.block))

    def draw(self, u: float) -> int:
        """The span at share ``u`` of the running sum of odds."""
        ahead = np.cumsum(self.sums)
        target = u * ahead[-1]
        b = min(int(np.searchsorted(ahead, target)), len(ahead) - 1)
        low = b * self.block
        inner = np.cumsum(self.odds[low : low + self.block]) + (ahead[b - 1] if b else 0.0)
        i = min(low + int(np.searchsorted(inner, target)), min(low + self.block, len(self.odds)) - 1)
        self.counts[self.start[i] : self.end[i] + 1] += 1
        first = int(np.searchsorted(self.reach, self.start[i]))
        stop = int(np.searchsorted(self.start, self.end[i], side="right"))
        origin = self.start[first]
        run = np.concatenate(([0.0], np.cumsum(1.0 / (self.counts[origin : self.reach[stop - 1] + 1] + 1))))
        part = slice(first, stop)
        self.odds[part] = (run[self.end[part] + 1 - origin] - run[self.start[part] - origin]) / self.length[part]
        b0, b1 = first // self.block, (stop - 1) // self.block
        whole = self.odds[b0 * self.block : (b1 + 1) * self.block]
        self.sums[b0 : b1 + 1] = np.add.reduceat(whole, np.arange(0, len(whole), self.block))
        return i

    def uniqueness(self, drawn: np.ndarray) -> float:
        """Mean over draws of the mean of 1 / (draws on the bar)."""
        steps = np.zeros(len(self.counts) + 1, np.int64)
        np.add.at(steps, self.start[drawn], 1)
        np.add.at(steps, self.end[drawn] + 1, -1)
        held = np.cumsum(steps)[:-1]
        run = np.concatenate(([0.0], np.cumsum(np.where(held > 0, 1.0 / np.maximum(held, 1), 0.0))))
        return float(((run[self.end[drawn] + 1] - run[self.start[drawn]]) / self.length[drawn]).mean())


def sequential_bootstrap(spans: DataFrame, bags: int, seed: int) -> DataFrame:
    """(symbol, bag, uniqueness, standard): mean uniqueness of as many draws as a symbol has spans, each drawn in
    proportion to its average uniqueness given those before, and of plain draws with replacement. A task holds the
    spans of one symbol's bag, and counts on its bars."""

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("start_idx", kind="stable").reset_index(drop=True)
        start, end, bag = p["start_idx"].to_numpy(), p["end_idx"].to_numpy(), int(p["bag"].iloc[0])
        rng = np.random.default_rng([seed, bag, *p["symbol"].iloc[0].encode()])
        draws = SpanDraws(start, end)
        drawn = np.array([draws.draw(u) for u in rng.random(len(p))])
        plain = rng.integers(0, len(p), len(p))
        return pd.DataFrame([(p["symbol"].iloc[0], bag, draws.uniqueness(drawn), draws.uniqueness(plain))], columns=["symbol", "bag", "uniqueness", "standard"])

    each = spans.select("symbol", "start_idx", "end_idx", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag"))
    return each.groupBy("symbol", "bag").applyInPandas(kernel, "symbol string, bag int, uniqueness double, standard double")


def log_close(bars: DataFrame) -> DataFrame:
    return bars.withColumn("log_close", F.log("close"))


def ou_fit(bars: DataFrame, column: str | Column = "log_close") -> DataFrame:
    """Per symbol: AR(1) of the level (phi, mean, sigma of residuals with n - 2), half_life, and ok for 0 < phi < 1
    and at least 50 pairs."""
    rows = bars.withColumn("_x", F.lag(column).over(by_symbol())).where("_x is not null").withColumn("_y", F.col(column))
    m = rows.groupBy("symbol").agg(
        F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("phi"), F.regr_intercept("_y", "_x").alias("a"), F.var_pop("_y").alias("vy"), F.covar_pop("_y", "_x").alias("c")
    )
    ok = (F.col("n") >= 50) & (F.col("phi") > 0) & (F.col("phi") < 1)
    sigma = F.sqrt((F.col("vy") - F.col("phi") * F.col("c")) * F.col("n") / (F.col("n") - 2))
    return m.select("symbol", "n", "phi", F.when(ok, F.col("a") / (1 - F.col("phi"))).alias("mean"), sigma.alias("sigma"), F.when(ok, -F.log(F.lit(2.0)) / F.log("phi")).alias("half_life"), ok.alias("ok"))
