"""Bars from base rows: an id per row by exact integer arithmetic, and a fold of equal ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def cumulative(df: DataFrame, keys: list[str], order: list[str], chunk: Column, values: dict[str, Column]) -> DataFrame:
    """``df`` with running totals (own row included) of ``values`` within ``keys``, in two levels.

    chunk: a part of the order that never falls along it, such as the day. Totals run within a chunk, and the
    small table of chunk totals gives each its start, so that no task sorts all rows of a key.
    """
    names = list(values)
    parts = df.withColumns({"_chunk": chunk, **{f"_v{i}": F.coalesce(values[n], F.lit(0)) for i, n in enumerate(names)}})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*keys, "_chunk").agg(*(F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(names))))
    starts = totals.select(*keys, "_chunk", *(F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in range(len(names))))
    local = parts.withColumns({f"_r{i}": F.sum(f"_v{i}").over(inside) for i in range(len(names))})
    joined = local.join(starts, [*keys, "_chunk"])
    return joined.select(*df.columns, *((F.col(f"_s{i}") + F.col(f"_r{i}")).alias(n) for i, n in enumerate(names)))


def _ids(ticks: DataFrame, running: Column, n_target: int) -> DataFrame:
    total = ticks.groupBy("symbol").agg(F.sum(running).alias("_total"))
    run = cumulative(ticks, ["symbol"], ["us", "id"], F.floor(F.col("us") / DAY), {"_run": running})
    return run.join(total, "symbol").where("_total > 0").withColumn("bar_idx", F.expr(f"({n_target} * _run) div _total")).drop("_run", "_total")


def threshold_ids(ticks: DataFrame, kind: str, n_target: int) -> DataFrame:
    """``ticks`` with bar_idx = floor(running activity / threshold), threshold = total / n_target, exactly.

    kind: tick, volume or dollar. The row that crosses a threshold opens the next bar, and the last row of
    all can be a bar of its own.
    """
    return _ids(ticks, {"tick": F.lit(1), "volume": F.col("volume"), "dollar": F.col("dollar")}[kind], n_target)


def count_ids(ticks: DataFrame, per_bar: int) -> DataFrame:
    """Time bars of base rows: bar_idx = row number div ``per_bar``, from 0."""
    run = cumulative(ticks, ["symbol"], ["us", "id"], F.floor(F.col("us") / DAY), {"_n": F.lit(1)})
    return run.withColumn("bar_idx", F.expr(f"(_n - 1) div {per_bar}")).drop("_n")


def matched_count_ids(ticks: DataFrame, n_target: int) -> DataFrame:
    """Time bars, about ``n_target`` a symbol: rows per bar = n / n_target, halves to even, at least 1."""
    size = ticks.groupBy("symbol").agg(F.greatest(F.lit(1), F.bround(F.count("*") / n_target)).cast("bigint").alias("_k"))
    run = cumulative(ticks, ["symbol"], ["us", "id"], F.floor(F.col("us") / DAY), {"_n": F.lit(1)})
    return run.join(size, "symbol").withColumn("bar_idx", F.expr("(_n - 1) div _k")).drop("_n", "_k")


def right_closed_ids(ticks: DataFrame, minutes: int) -> DataFrame:
    """Clock bins (t - k, t] by their right end; empty bins don't occur."""
    return ticks.withColumn("bar_idx", F.ceil(F.col("us") / (minutes * 60_000_000)).cast("bigint"))


def fold(rows: DataFrame) -> DataFrame:
    """One bar per (symbol, bar_idx): first, highest, lowest and last price, sums, and the rows it has."""
    at = F.struct("us", "id")
    return rows.groupBy("symbol", "bar_idx").agg(
        F.min("us").alias("t_open"), F.max("us").alias("t_close"), F.min_by("price", at).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.sum("dollar").alias("dollar"),
        F.sum(F.when(F.col("buy"), F.col("dollar")).otherwise(0)).alias("buy_dollar"),
        F.sum(F.when(F.col("buy"), 0).otherwise(F.col("dollar"))).alias("sell_dollar"), F.count("*").alias("n_base"),
    )


def dense(bars: DataFrame) -> DataFrame:
    """Bars numbered 0, 1, .. in each symbol: a large row can pass several thresholds, which leaves gaps, and
    barriers, spans and trends count bars."""
    return bars.withColumn("bar_idx", F.row_number().over(by_symbol()).cast("bigint") - 1)


def daily_close(ticks: DataFrame) -> DataFrame:
    """The last price of each UTC day."""
    return ticks.groupBy("symbol", F.floor(F.col("us") / DAY).alias("day")).agg(F.max_by("price", F.struct("us", "id")).alias("close"))


def hourly_close(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol", F.floor(F.col("us") / (DAY // 24)).alias("hour")).agg(F.max_by("price", F.struct("us", "id")).alias("close"))


def by_symbol(*order: str) -> Window:
    return Window.partitionBy("symbol").orderBy(*(order or ("bar_idx",)))


def clean_log_close(bars: DataFrame) -> DataFrame:
    """log_close of positive closes, without the run of equal closes at a symbol's end (over 10 rows only)."""
    w = by_symbol()
    rows = bars.where("close > 0").withColumn("_changed", F.coalesce(F.col("close") != F.lag("close").over(w), F.lit(True)))
    ends = rows.groupBy("symbol").agg(F.max(F.when(F.col("_changed"), F.col("bar_idx"))).alias("_end"), F.count("*").alias("_n"))
    kept = rows.join(ends, "symbol").where((F.col("bar_idx") <= F.col("_end")) | (F.col("_n") <= 10))
    return kept.withColumn("log_close", F.log("close")).drop("_changed", "_end", "_n")


def with_tick_sign(bars: DataFrame, first_row: int = 1) -> DataFrame:
    """Column sign: of the close's change; a zero change carries the one before, +1 where there is none, and
    the first row has ``first_row`` (two conventions: 1 and 0)."""
    w = by_symbol()
    step = bars.withColumn("_s", F.signum(F.col("close") - F.lag("close").over(w)))
    carried = F.coalesce(F.last(F.when(F.col("_s") != 0, F.col("_s")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    return step.withColumn("sign", F.when(F.col("_s").isNull(), first_row).otherwise(carried).cast("int")).drop("_s")


def count_stability(bars: DataFrame) -> DataFrame:
    """Standard deviation over mean of a symbol's bars per week (from Monday); null for under five weeks."""
    week = F.floor((F.floor(F.col("t_close") / DAY) + 3) / 7)
    weeks = bars.groupBy("symbol", week.alias("week")).agg(F.count("*").alias("n"))
    value = F.when(F.count("*") >= 5, F.stddev_samp("n") / F.avg("n"))
    return weeks.groupBy("symbol").agg(F.count("*").alias("weeks"), value.alias("variation"))
