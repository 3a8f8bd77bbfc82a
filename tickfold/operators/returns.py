"""Returns and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bars import DAY, by_symbol


def with_log_return(bars: DataFrame, *more: str) -> DataFrame:
    """Column ret: change of the log close; the first row of a symbol (and of each ``more``) has none."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", *more).orderBy("bar_idx")
    return bars.withColumn("ret", F.log("close") - F.lag(F.log("close")).over(w)).where("ret is not null")


def session_returns(bars: DataFrame) -> DataFrame:
    """Log returns within a day: a day's first bar has none."""
    return with_log_return(bars.withColumn("session", F.floor(F.col("t_open") / DAY)), "session")


def gap_filtered_returns(bars: DataFrame, most_hours: float = 2) -> DataFrame:
    """Log returns of bars that open within so many hours of the last close."""
    gap = F.col("t_open") - F.lag("t_close").over(by_symbol())
    rows = bars.withColumn("_gap", gap).withColumn("ret", F.log("close") - F.lag(F.log("close")).over(by_symbol()))
    return rows.where((F.col("_gap") <= int(most_hours * 3_600_000_000)) & F.col("ret").isNotNull()).drop("_gap")


def flow_imbalance(buy: Column, sell: Column) -> Column:
    """(buy - sell) / (buy + sell); 0 without either."""
    return F.coalesce(F.try_divide((buy - sell).cast("double"), buy + sell), F.lit(0.0))


def return_diagnostics(returns: DataFrame, least: int = 50) -> DataFrame:
    """Per symbol: n, population skewness and excess kurtosis, Jarque-Bera statistic, first autocorrelation.

    Null statistics for fewer than ``least`` returns.
    """
    rows = returns.withColumn("_last", F.lag("ret").over(by_symbol()))
    n = F.count("*")
    skew, excess = F.skewness("ret"), F.kurtosis("ret")
    enough = lambda c: F.when(n >= least, c)
    return rows.groupBy("symbol").agg(
        n.alias("n"), enough(skew).alias("skew"), enough(excess).alias("excess_kurtosis"),
        enough(n / 6 * (skew * skew + excess * excess / 4)).alias("jarque_bera"), enough(F.corr("ret", "_last")).alias("autocorrelation"),
    )


def running_drawdown(pnl: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Running sum of pnl, its peak from 0, drawdown below the peak, and time_under_water: rows in a row of a
    drawdown over 1e-12 up to each row."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = pnl.withColumn("equity", F.sum("pnl").over(upto))
    rows = rows.withColumn("drawdown", F.greatest(F.max("equity").over(upto), F.lit(0)) - F.col("equity"))
    rows = rows.withColumn("_i", F.row_number().over(w))
    dry = F.coalesce(F.max(F.when(F.col("drawdown") <= 1e-12, F.col("_i"))).over(upto), F.lit(0))
    return rows.withColumn("time_under_water", F.col("_i") - dry).drop("_i")
