"""Walk-forward learning on panels, with model selection as data: folds, settings and knobs are rows, fitted, scored and
simulated together. A panel is read once for all folds; what a fit needs are sums of products per date."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .panel import by_name, per_date

#: (share of names in a leg, long only, tilt by score, dates between rebalances) of a book.
Knob = tuple[float, bool, float, int]


def with_steps(panel: DataFrame) -> DataFrame:
    """step: the number of a row's date among all dates, from 0."""
    dates = panel.select("date").distinct()
    return panel.join(dates.withColumn("step", F.row_number().over(Window.orderBy("date")) - 1), "date")  # one row a date


def with_forward_rank(panel: DataFrame, h: int) -> DataFrame:
    """label: rank in [-1, 1] per date of the sum of a name's next h returns, among names that have them, null below
    four names; label_end: the step of the last of them. All rows stay."""
    ahead = by_name("step").rowsBetween(1, h)
    total = F.when((F.count("ret").over(ahead) == h) & F.col("ret").isNotNull(), F.sum("ret").over(ahead))
    rows = panel.withColumns({"_s": total, "label_end": F.lead("step", h).over(by_name("step"))})
    n, place = F.count("_s").over(per_date()), F.row_number().over(per_date(F.asc_nulls_last("_s"), "name")) - 1
    return rows.withColumn("label", F.when(F.col("_s").isNotNull() & (n >= 4), 2 * place / (n - 1) - 1)).drop("_s")


def _folds(step: Column, first: int, stop: int, by: int, last: int) -> Column:
    """The folds f up to ``last`` in which a step is in [f by + first, f by + stop)."""
    low = F.greatest(F.ceil((step - stop + 1) / by), F.lit(0)).cast("int")
    high = F.least(F.floor((step - first) / by), F.lit(last)).cast("int")
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def ridge_fits(rows: DataFrame, features: Sequence[str], settings: Sequence[float], inside: int, by: int, last: int, select: int) -> DataFrame:
    """(fold, part, setting, beta): ridge regressions of label on features without intercept, for every fold, twice (part
    fit: of the steps before the last ``select`` of the fold; part refit: of all), and every penalty (times the rows).

    Rows whose label ends at or after the part's last step are purged. A row is read once: its products are summed
    per (step, label_end), and those few rows are dealt to the folds that hold them.
    """
    d = len(features)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"s{i}_{j}") for i, j in pairs] + [F.sum(F.col(c) * F.col("label")).alias(f"b{i}") for i, c in enumerate(features)]
    daily = rows.where("label is not null").groupBy("step", "label_end").agg(F.count("*").alias("n"), *sums)
    bounds = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(stop).alias("stop")) for p, stop in (("fit", inside - select), ("refit", inside))))
    dealt = daily.withColumn("fold", F.explode(_folds(F.col("step"), 0, inside, by, last))).withColumn("_p", F.explode(bounds))
    edge = F.col("fold") * by + F.col("_p.stop")
    names = ["n", *(f"s{i}_{j}" for i, j in pairs), *(f"b{i}" for i in range(d))]
    total = dealt.where((F.col("step") < edge) & (F.col("label_end") < edge)).groupBy("fold", "_p.part").agg(*(F.sum(c).alias(c) for c in names))
    each = total.withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1))))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            s, b = np.zeros((len(p), d, d)), p[[f"b{i}" for i in range(d)]].to_numpy(float)
            for i, j in pairs:
                s[:, i, j] = s[:, j, i] = p[f"s{i}_{j}"]
            penalty = p["n"].to_numpy(float) * np.take(settings, p["setting"].to_numpy(int))
            s += penalty[:, None, None] * np.eye(d)
            beta = [np.linalg.lstsq(m, v, rcond=None)[0].tolist() for m, v in zip(s, b)]
            yield pd.DataFrame({"fold": p["fold"], "part": p["part"], "setting": p["setting"], "beta": beta})

    return each.mapInPandas(solve, "fold int, part string, setting int, beta array<double>")


def book_pnl(scored: DataFrame, returns: DataFrame, knobs: Sequence[Knob], cost: float, keys: Sequence[str]) -> DataFrame:
    """(keys, knob, step, turnover, pnl) of every knob's book along each key's slice of steps.

    scored: keys, start and stop (of the slice), step, name, score, and optionally knob (then only that one).
    returns: name, step, ret, funding. On every reb-th step of its slice a book takes the k highest scores, and
    unless long only the k lowest, in shares of sum 1 by max(0.1, 1 + tilt x distance from the leg's mean score); on
    dates of fewer than four scores it is empty. It earns the returns of the steps after that less funding, and
    pays ``cost`` for each change of a weight. Only weights other than 0 are rows; nothing is filled.
    """
    at = Window.partitionBy(*keys, "step")
    rows = scored.where("score is not null").withColumns({"n": F.count("*").over(at), "low": F.row_number().over(at.orderBy("score", "name"))})
    shape = F.array(*(F.struct(F.lit(i).alias("knob"), F.lit(float(q)).alias("q"), F.lit(long).alias("long"), F.lit(float(t)).alias("tilt"), F.lit(reb).alias("reb")) for i, (q, long, t, reb) in enumerate(knobs)))
    one = F.filter(shape, lambda k: k["knob"] == F.col("knob")) if "knob" in scored.columns else shape
    rows = rows.where("n >= 4").withColumn("k", F.explode(one)).drop("knob").where((F.col("step") - F.col("start")) % F.col("k.reb") == 0)
    size = F.greatest(F.least(F.floor(F.col("k.q") * F.col("n")), F.when(F.col("k.long"), F.col("n")).otherwise(F.floor(F.col("n") / 2))), F.lit(1))
    leg = F.when(F.col("low") > F.col("n") - size, 1).when(~F.col("k.long") & (F.col("low") <= size), -1)
    rows = rows.select(*keys, "start", "stop", "step", "name", "score", F.col("k.knob").alias("knob"), F.col("k.tilt").alias("tilt"), F.col("k.reb").alias("reb"), leg.alias("leg")).where("leg is not null")
    side = Window.partitionBy(*keys, "knob", "step", "leg")
    rows = rows.withColumn("u", F.greatest(1 + F.col("tilt") * F.col("leg") * (F.col("score") - F.avg("score").over(side)), F.lit(0.1)))
    rows = rows.withColumn("weight", F.col("leg") * F.col("u") / F.sum("u").over(side))
    ends = F.least(F.col("step") + F.col("reb"), F.col("stop") - 1)
    held = rows.where(ends > F.col("step")).select(*keys, "knob", "name", "weight", F.explode(F.sequence(F.col("step") + 1, ends)).alias("step"))
    earned = held.join(returns.select("name", "step", "ret", "funding"), ["name", "step"])
    by = [*keys, "knob", "step"]
    gains = earned.groupBy(*by).agg(F.sum(F.col("weight") * (F.coalesce("ret", F.lit(0.0)) - F.coalesce("funding", F.lit(0.0)))).alias("_g"))
    # A weight is taken at its step and given back ``reb`` steps later. Both come from one row, not from a union: Spark 4.1
    # sums a union of equally dealt parts without a shuffle, though its adaptive planner merges each part's partitions by itself.
    back = F.col("step") + F.col("reb")
    moves = F.array(F.struct("step", "weight"), F.when(back < F.col("stop"), F.struct(back.alias("step"), (-F.col("weight")).alias("weight"))))
    moved = rows.select(*keys, "knob", "name", F.explode(moves).alias("_m")).where("_m is not null").select(*keys, "knob", "name", "_m.step", "_m.weight")
    changed = moved.groupBy(*by, "name").agg(F.abs(F.sum("weight")).alias("_t")).groupBy(*by).agg(F.sum("_t").alias("_t"))
    g, t = (F.coalesce(c, F.lit(0.0)) for c in ("_g", "_t"))
    return gains.join(changed, by, "full").select(*by, t.alias("turnover"), (g - cost * t).alias("pnl"))


def _scores(rows: DataFrame, betas: DataFrame, features: Sequence[str], first: int, stop: int, by: int, last: int, keep: Sequence[str]) -> DataFrame:
    """Rows of each fold's slice [fold by + first, fold by + stop) with the scores of its fits."""
    each = rows.withColumn("fold", F.explode(_folds(F.col("step"), first, stop, by, last))).join(betas, "fold")
    score = sum((F.col("beta")[i] * F.col(c) for i, c in enumerate(features)), F.lit(0.0))
    edges = [(F.col("fold") * by + e).alias(n) for e, n in ((first, "start"), (stop, "stop"))]
    return each.select("fold", *keep, *edges, "step", "name", F.round(score, 10).alias("score"))


def walk_forward_books(
    panel: DataFrame, features: Sequence[str], settings: Sequence[float], knobs: Sequence[Knob],
    h: int, inside: int, select: int, by: int, cost: float, periods: float = 252.0,
) -> tuple[DataFrame, DataFrame]:
    """(choices, ledger) of a cross-sectional model walked forward: each fold learns from ``inside`` dates and trades
    the next ``by``; folds' traded dates don't overlap.

    panel: name, date, ret, funding and features (null: 0). A model is fitted before the last ``select`` dates inside,
    and every (setting, knob) trades those; the best annualised Sharpe ratio (rounded to 9 digits; ties: the smaller
    numbers) is refitted on all dates inside and trades. choices: fold, setting, knob, sharpe. ledger: fold, phase (0
    inside, 1 after), step, pnl, without dates of no gain and no loss. Nothing of a fold depends on later dates than
    it has: features must not, labels that end later are purged, and choices only see dates inside.
    """
    rows = with_forward_rank(with_steps(panel), h).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in features})
    rows = cut(rows.select("name", "date", "step", "ret", "funding", *features, "label", "label_end"))
    n = (rows.agg(F.max("step")).first()[0] or 0) + 1
    last = (n - inside) // by - 1
    fits = cut(ridge_fits(rows, features, settings, inside, by, last, select))
    trial = _scores(rows, fits.where("part = 'fit'"), features, inside - select, inside, by, last, ["setting"])
    tried = book_pnl(trial, rows, knobs, cost, ["fold", "setting"])
    mean = F.sum("pnl") / select
    sd = F.sqrt(F.greatest(F.sum(F.col("pnl") * F.col("pnl")) / select - mean * mean, F.lit(0.0)))
    ratio = F.when(sd > 1e-12, mean / sd * float(np.sqrt(periods))).otherwise(0.0)
    ranked = tried.groupBy("fold", "setting", "knob").agg(F.round(ratio, 9).alias("sharpe"))
    best = F.min(F.struct((-F.col("sharpe")).alias("less"), "setting", "knob"))
    choices = cut(ranked.groupBy("fold").agg(best.alias("b")).select("fold", "b.setting", "b.knob", (-F.col("b.less")).alias("sharpe")))
    chosen = fits.where("part = 'refit'").join(choices, ["fold", "setting"]).select("fold", "knob", "beta")
    parts = []
    for phase, (first, stop) in enumerate(((0, inside), (inside, inside + by))):
        scored = _scores(rows, chosen, features, first, stop, by, last, ["knob"])
        parts.append(book_pnl(scored, rows, knobs, cost, ["fold"]).select("fold", F.lit(phase).alias("phase"), "step", "pnl"))
    return choices, parts[0].unionByName(parts[1]).where("pnl <> 0")
