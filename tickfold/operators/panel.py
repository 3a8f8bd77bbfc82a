"""Cross-sections: ranks and weights per date, rotation with holding periods, regressions by moment sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_date(*order: Column | str) -> Window:
    w = Window.partitionBy("date")
    return w.orderBy(*order) if order else w


def normalised(panel: DataFrame, x: str = "x", clip: float = 5.0) -> DataFrame:
    """rank in [-1, 1] (ties by name) and z (population, held within +-clip) per date; 0 for a missing value."""
    present = F.col(x).isNotNull()
    n = F.count(x).over(per_date())
    place = F.row_number().over(per_date(F.asc_nulls_last(x), "name")) - 1
    sd = F.stddev_pop(x).over(per_date())
    z = F.when(sd > 0, (F.col(x) - F.avg(x).over(per_date())) / sd)
    return panel.withColumns({
        "rank": F.when(present & (n > 1), 2 * place / (n - 1) - 1).otherwise(0.0),
        "z": F.coalesce(F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)), F.lit(0.0)),
    })


def by_name(*order: str) -> Window:
    return Window.partitionBy("name").orderBy(*(order or ("date",)))


def forward_rank(panel: DataFrame, h: int) -> DataFrame:
    """label: rank in [-1, 1] per date of the sum of the next h returns, of names that have all of them; null
    below four names."""
    ahead = by_name().rowsBetween(1, h)
    total = F.when(F.count("ret").over(ahead) == h, F.sum("ret").over(ahead))
    rows = panel.withColumn("_s", F.when(F.col("ret").isNotNull(), total)).where("_s is not null")
    n = F.count("*").over(per_date())
    place = F.row_number().over(per_date("_s", "name")) - 1
    return rows.withColumn("label", F.when(n >= 4, 2 * place / (n - 1) - 1)).drop("_s")


def long_short(panel: DataFrame, q: float, score: str = "score", tilt: float = 0.0, long_only: bool = False) -> DataFrame:
    """weight: shares of sum 1 of the k highest scores and of sum -1 of the k lowest of a date, k = min(floor(q n),
    n div 2), at least 1 (long_only: up to n, and no lowest); 0 for others, missing scores and dates of fewer than four.
    A share goes by max(0.1, 1 + tilt times the score's distance from its leg's mean, outwards); without tilt all are 1 / k."""
    n = F.count(score).over(per_date())
    k = F.greatest(F.least(F.floor(q * n), n if long_only else F.floor(n / 2)), F.lit(1))
    low = F.row_number().over(per_date(F.asc_nulls_last(score), "name"))
    high = n - low + 1
    usable = F.col(score).isNotNull() & (n >= 4)
    leg = F.when(usable & (high <= k), 1) if long_only else F.when(usable & (high <= k), 1).when(usable & (low <= k), -1)
    if not tilt:
        return panel.withColumn("weight", F.coalesce(leg / k, F.lit(0.0)))
    side = Window.partitionBy("date", "_leg")
    rows = panel.withColumn("_leg", leg)
    rows = rows.withColumn("_u", F.greatest(1 + tilt * F.col("_leg") * (F.col(score) - F.avg(score).over(side)), F.lit(0.1)))
    return rows.withColumn("weight", F.coalesce(F.col("_leg") * F.col("_u") / F.sum("_u").over(side), F.lit(0.0))).drop("_leg", "_u")


def rotation(weights: DataFrame, rebalance: int, cost: float) -> DataFrame:
    """Per date: turnover and pnl of a book that takes new weights on every ``rebalance``-th date and holds them
    between. pnl: weights of the date before times returns, minus cost times the sum of weight changes."""
    dates = weights.select("date").distinct()
    dates = dates.withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1)  # one row a date
    rows = weights.join(dates, "date").withColumn("_w", F.when(F.col("_i") % rebalance == 0, F.col("weight")))
    held = F.coalesce(F.last("_w", True).over(by_name().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    rows = rows.withColumn("_h", held)
    before = F.coalesce(F.lag("_h").over(by_name()), F.lit(0.0))
    rows = rows.withColumns({"_t": F.abs(F.col("_h") - before), "_g": before * F.coalesce("ret", F.lit(0.0))})
    return rows.groupBy("date").agg(F.sum("_t").alias("turnover"), (F.sum("_g") - cost * F.sum("_t")).alias("pnl"))


def mean_of_others(panel: DataFrame, x: str) -> DataFrame:
    """others: the mean of the other names of the date; null where there are none."""
    n = F.count(x).over(per_date())
    return panel.withColumn("others", F.try_divide(F.sum(x).over(per_date()) - F.col(x), n - 1))


def within_date(panel: DataFrame, *names: str) -> DataFrame:
    """``names`` less their mean of the date."""
    return panel.withColumns({c: F.col(c) - F.avg(c).over(per_date()) for c in names})


def slopes(panel: DataFrame, keys: list[str], y: str, x: str, control: str) -> DataFrame:
    """Per key: n; slope and t of y on x; partial slope and t of y on x and a control (n - 3 degrees of freedom);
    from sums of products, so one pass with partial aggregation."""
    cov = lambda a, b: F.covar_pop(a, b)
    rows = panel.where(f"{y} is not null and {x} is not null and {control} is not null")
    m = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), cov(x, x).alias("xx"), cov(y, y).alias("yy"), cov(x, y).alias("xy"), cov(x, control).alias("xc"), cov(y, control).alias("yc"), cov(control, control).alias("cc"),
    )
    n, xx, yy, xy, xc, yc, cc = (F.col(c) for c in ("n", "xx", "yy", "xy", "xc", "yc", "cc"))
    rxx, ryy, rxy = xx - xc * xc / cc, yy - yc * yc / cc, xy - xc * yc / cc  # after the control (Frisch-Waugh-Lovell)
    t = lambda a, b, c, df: F.when((a > 0) & (b - c * c / a > 1e-18) & (df > 0), c / a / F.sqrt((b - c * c / a) / a / df))
    return m.select(
        *keys, "n", F.try_divide(xy, xx).alias("slope"), t(xx, yy, xy, n - 2).alias("t"), F.try_divide(rxy, rxx).alias("partial_slope"), t(rxx, ryy, rxy, n - 3).alias("partial_t"),
        F.try_divide(xy * xy, xx * yy).alias("r2"),
    )


def clustered_t(panel: DataFrame, y: str, x: str, cluster: str) -> DataFrame:
    """One row: slope of y on x with a constant, and its t with errors clustered by ``cluster`` (CR1)."""
    rows = panel.where(f"{y} is not null and {x} is not null")
    m = rows.agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("xx"), F.covar_pop(x, y).alias("xy"))
    rows = rows.join(F.broadcast(m))  # m is one row
    b = F.col("xy") / F.col("xx")
    e = F.col(y) - F.col("my") - b * (F.col(x) - F.col("mx"))
    scores = rows.groupBy(cluster).agg(F.sum((F.col(x) - F.col("mx")) * e).alias("s"), F.first("n").alias("n"), F.first("xx").alias("xx"), F.first("xy").alias("xy"))
    g, n = F.count("*"), F.first("n")
    meat = F.sum(F.col("s") * F.col("s")) * (g / (g - 1)) * ((n - 1) / (n - 2))
    slope = F.first("xy") / F.first("xx")
    return scores.agg(n.alias("n"), g.alias("clusters"), slope.alias("slope"), (slope / (F.sqrt(meat) / (n * F.first("xx")))).alias("t"))


def benjamini_hochberg(tests: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """p_adjusted: the false discovery rate at which each test is rejected. The least over later tests runs from the last
    one backwards: a frame that shrinks from its start would be summed up anew for each row."""
    order = Window.partitionBy(*keys).orderBy(p, "name")
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = tests.withColumn("_a", F.col(p) * n / F.row_number().over(order))
    later = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(p), F.desc_nulls_last("name")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("p_adjusted", F.least(F.min("_a").over(later), F.lit(1.0))).drop("_a")


def event_study(events: DataFrame, daily: DataFrame, before: int, after: int) -> DataFrame:
    """Per day around the events (name, event_day): mean of ret less the mean of the other names, how many, and
    the running sum. daily has name, day and ret."""
    others = daily.withColumn("date", F.col("day"))
    rows = mean_of_others(others, "ret").select("name", "day", (F.col("ret") - F.col("others")).alias("abnormal"))
    around = events.select("name", "event_day", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("at"))
    met = around.withColumn("day", F.col("event_day") + F.col("at")).join(rows, ["name", "day"])
    by = met.where("abnormal is not null").groupBy("at").agg(F.count("*").alias("n"), F.avg("abnormal").alias("mean"))
    return by.withColumn("car", F.sum("mean").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, available: str, values: list[str]) -> DataFrame:
    """``left`` with the values of the last right row whose availability isn't after ``at``: a union and a
    running last, so one shuffle by key and no range join."""
    shape = [*left.columns, *values]
    a = left.select(*left.columns, *(F.lit(None).cast(dict(right.dtypes)[v]).alias(v) for v in values), F.col(at).alias("_t"), F.lit(1).alias("_left"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in keys]
    b = right.select(*keys, *nothing, *values, F.col(available).alias("_t"), F.lit(0).alias("_left")).select(*a.columns)
    w = Window.partitionBy(*keys).orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, 0)
    whole = a.unionByName(b).withColumns({v: F.last(F.when(F.col("_left") == 0, F.struct(v)), True).over(w)[v] for v in values})
    return whole.where("_left = 1").select(*shape)


def interval_gate(rows: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """valid: whether a row lies in one of its key's spans (an open end counts as never); keys without a span
    are valid. Rows stay as many as they are: a key's spans are one array."""
    own = spans.groupBy(*keys).agg(F.collect_list(F.struct(F.col(start).alias("a"), F.col(end).alias("b"))).alias("_spans"))
    out, t = rows.join(own, keys, "left"), F.col(at)
    inside = F.exists("_spans", lambda s: (s["a"].isNull() | (t >= s["a"])) & (s["b"].isNull() | (t <= s["b"])))
    return out.withColumn("valid", F.col("_spans").isNull() | inside).drop("_spans")
