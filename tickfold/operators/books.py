"""Panels on one clock and the books traded on them: carry, a grid of settings walked forward, sleeves, signals."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import by_symbol
from .costs import EQUITY_DEFAULT_BP, EQUITY_HALF_SPREAD_BP, equity_commission, looked_up
from .lineage import cut, shared_path
from .panel import by_name, interval_gate
from .rolling import full, rolling_z, trailing
from .sequential import fractional_difference


def grid_panel(prices: DataFrame, feeds: dict[str, tuple[DataFrame, float | None]], spans: DataFrame | None = None, spot: DataFrame | None = None) -> DataFrame:
    """Every name of ``prices`` (name, step, close, volume) on every step from the first to the last.

    A feed is (name, step, value) and its value where none is known yet: the last value of a step before this one. ret:
    log change of the close from the step before, where both are above 0. basis, with ``spot`` (name, step, close): close
    over spot less 1, of the step before. valid: close and volume above 0, within the name's ``spans`` (name, start, end).
    """
    ends = prices.agg(F.min("step").alias("_a"), F.max("step").alias("_b"))  # one row
    names = prices.select("name").distinct().join(F.broadcast(ends))
    rows = names.select("name", F.explode(F.sequence("_a", "_b")).alias("step")).join(prices, ["name", "step"], "left")
    w = by_name("step")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    for name, (feed, unknown) in feeds.items():
        rows = rows.join(feed.select("name", "step", F.col("value").alias(name)), ["name", "step"], "left")
        known = F.last(name, True).over(before)
        rows = rows.withColumn(name, known if unknown is None else F.coalesce(known, F.lit(unknown)))
    if spot is not None:
        rows = rows.join(spot.select("name", "step", F.col("close").alias("_s")), ["name", "step"], "left")
        rows = rows.withColumn("basis", F.lag(F.when(F.col("_s") > 0, F.col("close") / F.col("_s") - 1)).over(w)).drop("_s")
    log = F.when(F.col("close") > 0, F.log("close"))
    rows = rows.withColumn("_l", log).withColumn("ret", F.col("_l") - F.lag("_l").over(w)).drop("_l")
    alive = F.coalesce((F.col("close") > 0) & (F.col("volume") > 0), F.lit(False))
    if spans is None:
        return rows.withColumn("valid", alive)
    return interval_gate(rows, spans, ["name"], "step", "start", "end").withColumn("valid", F.col("valid") & alive)


def daily_panel(rows: DataFrame, least: int) -> DataFrame:
    """Names of ``rows`` (name, date, close) with at least ``least`` days with a price: ret is the log change from the
    panel's last date, 0 where the name has no price then, and per_side the name's median cost of a side at midday."""
    priced = rows.where("close > 0").withColumn("_n", F.count("*").over(Window.partitionBy("name"))).where(F.col("_n") >= least)
    dates = priced.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")))  # one row a date
    at = priced.join(dates, "date")
    last = F.lag("_i").over(by_name()) == F.col("_i") - 1
    side = looked_up(F.col("name").cast("string"), EQUITY_HALF_SPREAD_BP, EQUITY_DEFAULT_BP) * 1e-4 + equity_commission(F.col("close"))
    at = at.withColumns({"ret": F.coalesce(F.when(last, F.log("close") - F.lag(F.log("close")).over(by_name())), F.lit(0.0)), "_c": side})
    return at.withColumn("per_side", F.percentile("_c", F.lit(0.5)).over(Window.partitionBy("name"))).drop("_n", "_i", "_c")


def dated(panel: DataFrame) -> DataFrame:
    """(date, i): the panel's dates in order, i from 0; one row a date."""
    return panel.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")).cast("bigint") - 1)


def by_setting(days: DataFrame, settings: dict[str, tuple[float, int]]) -> DataFrame:
    """Each date once per setting, with its _q and _every; as many rows as dates times settings."""
    each = F.array(*(F.struct(F.lit(s).alias("setting"), F.lit(float(q)).alias("_q"), F.lit(r).alias("_every")) for s, (q, r) in settings.items()))
    return days.select("i", "date", F.explode(each).alias("_s")).select("i", "date", "_s.*")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what several steps read is computed once, and each reads its own columns."""
    path = shared_path(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def carry_picks(panel: DataFrame, days: DataFrame, settings: dict[str, tuple[float, int]], least: int, start: int = 0, risk: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(setting, i, name, weight): the new weights of ``carry_weights``, on the dates that have some, and those (setting, i).

    A date's names are ranked once, whatever the settings; those at the ends are written, as sums come before weights."""
    usable = F.col("valid") & (F.col("funding") != 0)
    usable = usable & (F.col(risk) > 1e-9) if risk else usable
    turn = F.col("i") >= start
    some = reduce(or_, (F.col("i") % every == 0 for every in {every for _, every in settings.values()}))
    w = Window.partitionBy("i")
    ranked = panel.join(F.broadcast(days.where(turn & some)), "date").where(usable).select("i", "name", "funding", (1 / F.col(risk) if risk else F.lit(1.0)).alias("_u"))
    ranked = ranked.withColumns({"_n": F.count("*").over(w), "_lo": F.row_number().over(w.orderBy("funding", "name"))}).where(F.col("_n") >= least)
    widest = F.greatest(F.floor(max(q for q, _ in settings.values()) * F.col("_n")), F.lit(1))
    ends = written(ranked.where((F.col("_lo") <= widest) | (F.col("_lo") > F.col("_n") - widest)).drop("funding"), "carry-ends")
    turns = ends.join(F.broadcast(by_setting(days, settings).where(turn & (F.col("i") % F.col("_every") == 0)).drop("date")), "i")
    k = F.greatest(F.floor(F.col("_q") * F.col("_n")), F.lit(1))
    turns = turns.withColumn("_s", F.when(F.col("_lo") > F.col("_n") - k, -1).when(F.col("_lo") <= k, 1)).where("_s is not null")
    sums = cut(turns.groupBy("setting", "i", "_s").agg(F.sum("_u").alias("_t")))  # two rows a date and setting
    picks = turns.join(F.broadcast(sums), ["setting", "i", "_s"]).select("setting", "i", "name", (F.col("_s") * F.col("_u") / F.col("_t")).alias("weight"))
    return picks, sums.select("setting", "i").distinct()


def held_turns(days: DataFrame, settings: dict[str, tuple[float, int]], turns: DataFrame) -> DataFrame:
    """(setting, i, date, _r): the turn whose weights are held on a date; none on the last date."""
    own = Window.partitionBy("setting")
    before = own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = by_setting(days, settings).join(turns.withColumn("_r", F.col("i")), ["setting", "i"], "left")
    return each.withColumn("_r", F.last("_r", True).over(before)).withColumn("_m", F.max("i").over(own)).where("i < _m and _r is not null").select("setting", "i", "date", "_r")


def carry_weights(panel: DataFrame, settings: dict[str, tuple[float, int]], least: int, start: int = 0, risk: str | None = None) -> DataFrame:
    """(setting, i, date, name, weight) of books that are long the fraction q of names of lowest ``funding`` and short
    those of highest, sum 1 a side, ties by name. settings: name -> (q, rebalance): new weights on each ``rebalance``-th
    date from ``start`` with ``least`` usable names (valid, funding not 0), held until the next; none on the last date.
    risk: weights go by 1 over that column. All settings are one pass."""
    days = cut(dated(panel))
    picks, turns = carry_picks(panel, days, settings, least, start, risk)
    return held_turns(days, settings, turns).join(picks.withColumnRenamed("i", "_r"), ["setting", "_r"]).select("setting", "i", "date", "name", "weight")


#: Numbers of one matrix of a task: settings times names times dates.
HELD = 1 << 21


def _entries(column: pa.Array, fields: int) -> tuple[np.ndarray, ...]:
    """Of a column of lists of structs: the row of each entry, and the entries' fields."""
    flat = column.flatten()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), *(v.to_numpy(zero_copy_only=False) for v in flat.flatten()[:fields])


def _held(batches: Iterator[pa.RecordBatch], held: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some names at a time: their rows, weights and whether they are held, by setting, name and date."""
    settings, dates = held.shape
    step = max(1, HELD // max(1, settings * dates))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            p = batch.slice(start, step)
            at, s, i, w = _entries(p.column("picks"), 3)
            new, there = np.zeros((settings, p.num_rows, dates)), np.zeros((settings, p.num_rows, dates), bool)
            new[s, at, i], there[s, at, i] = w, True
            turn = np.maximum(held, 0)
            on = np.stack([there[k][:, turn[k]] & (held[k] >= 0) for k in range(settings)])
            yield p, np.where(on, np.stack([new[k][:, turn[k]] for k in range(settings)]), 0.0), on


def _results(held: np.ndarray):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        price, paid = np.zeros(held.shape), np.zeros(held.shape)
        for p, w, on in _held(batches, held):
            ret, funding = np.zeros(w.shape[1:]), np.zeros(w.shape[1:])
            at, i, r, f = _entries(p.column("days"), 3)
            ret[at, i], funding[at, i] = r, f
            # A date's weights meet the next date's returns.
            price[:, :-1] += np.where(on[:, :, :-1], w[:, :, :-1] * ret[:, 1:], 0.0).sum(1)
            paid += np.where(on, w * funding, 0.0).sum(1)
        s, i = np.indices(held.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (s.astype("int32"), i, price, paid)], ["s", "i", "_p", "_f"])

    return kernel


def _turnover(held: np.ndarray, leverage: np.ndarray):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = np.zeros(held.shape)
        for _, w, on in _held(batches, held):
            now = np.where(on, w * leverage[:, None, :], 0.0)
            moved += np.abs(np.diff(now, axis=2, prepend=0.0)).sum(1)
        s, i = np.indices(held.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (s.astype("int32"), i, moved)], ["s", "i", "_t"])

    return kernel


def carry_books(
    panel: DataFrame, settings: dict[str, tuple[float, int]], least: int, target: float, span: int, cost: float, scale: float = 1.0, most: float = 5.0, risk: str | None = None
) -> DataFrame:
    """Per setting and date, from date ``span`` on: leverage, price (weights times the next date's ret), funding (paid by
    the long side), cost by turnover, and pnl.

    A book is scaled by target over the deviation of its unscaled result over the last ``span`` dates (half of them at
    least), of the date before, at most ``most``; 0 before it is known. A name's days and new weights are one row, so that
    weights aren't repeated for each date that holds them; the driver holds a number per setting and date."""
    panel = written(panel.select("name", "date", "ret", "funding", "valid", *([risk] if risk else [])), "carry-panel")
    days = cut(dated(panel))
    picks, turns = carry_picks(panel, days, settings, least, span, risk)
    place, dates = {s: k for k, s in enumerate(settings)}, days.count()
    held = np.full((len(settings), dates), -1)
    for r in held_turns(days, settings, turns).collect():
        held[place[r["setting"]], r["i"]] = r["_r"]
    number = F.array_position(F.array(*map(F.lit, settings)), F.col("setting")).cast("int") - 1
    chosen = picks.groupBy("name").agg(F.collect_list(F.struct(number.alias("s"), F.col("i").cast("int").alias("i"), "weight")).alias("picks"))
    chosen = written(chosen, "carry-picks")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    own = panel.join(F.broadcast(days), "date").groupBy("name").agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), zero("ret"), zero("funding"))).alias("days"))
    keys, name = ["setting", "i"], F.element_at(F.array(*map(F.lit, settings)), F.col("s") + 1).alias("setting")
    parts = chosen.join(own, "name").select("picks", "days").mapInArrow(_results(held), "s int, i bigint, _p double, _f double")
    by = parts.groupBy(name, "i").agg(F.sum("_p").alias("_p"), (-scale * F.sum("_f")).alias("_f"))
    by = by_setting(days, settings).drop("_q", "_every").join(by, keys, "left").fillna(0.0, ["_p", "_f"])
    past = Window.partitionBy("setting").orderBy("i").rowsBetween(-span, -1)
    sd = F.when(F.count("*").over(past) >= span // 2, F.stddev_samp(F.col("_p") + F.col("_f")).over(past))
    by = cut(by.withColumn("leverage", F.when(sd > 1e-9, F.least(target / sd, F.lit(most))).otherwise(0.0)))
    leverage = np.zeros(held.shape)
    for r in by.select(*keys, "leverage").collect():
        leverage[place[r["setting"]], r["i"]] = r["leverage"]
    moves = chosen.select("picks").mapInArrow(_turnover(held, leverage), "s int, i bigint, _t double")
    out = by.join(moves.groupBy(name, "i").agg(F.sum("_t").alias("_t")), keys, "left").fillna(0.0, ["_t"])
    price, paid, spent = F.col("leverage") * F.col("_p"), F.col("leverage") * F.col("_f"), cost * F.col("_t")
    return out.select(*keys, "date", "leverage", price.alias("price"), paid.alias("funding"), spent.alias("cost"), (price + paid - spent).alias("pnl"))


def chosen_forward(results: DataFrame, inside: int, walk: int, start: int = 0) -> DataFrame:
    """(fold, setting, i, pnl): ``results`` (setting, i, pnl) of the setting with the best mean over deviation in the
    ``inside`` dates before each out-of-sample step of ``walk`` dates; full windows only, ties by setting."""
    ends = results.agg(F.max("i").alias("_m"))  # one row
    rows = results.join(F.broadcast(ends)).where(F.col("i") >= start)
    last = F.floor((F.col("_m") + 1 - start - inside - walk) / walk)
    k = F.col("i") - start
    folds = F.sequence(F.greatest(F.ceil((k - inside - walk + 1) / walk), F.lit(0)), F.least(F.floor(k / walk), last))
    each = rows.where(last >= 0).where(F.greatest(F.ceil((k - inside - walk + 1) / walk), F.lit(0)) <= F.least(F.floor(k / walk), last))
    each = each.withColumn("fold", F.explode(folds)).withColumn("_in", F.col("i") - start - F.col("fold") * walk < inside)
    score = F.try_divide(F.avg("pnl"), F.stddev_samp("pnl"))
    best = each.where("_in").groupBy("fold", "setting").agg(F.round(score, 12).alias("_s")).where("_s is not null")
    best = best.withColumn("_n", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("_s"), "setting"))).where("_n = 1")
    return each.where("not _in").join(best.select("fold", "setting"), ["fold", "setting"]).select("fold", "setting", "i", "pnl")


def regime_sleeves(rows: DataFrame, cost: float, a_year: float) -> DataFrame:
    """Per symbol and arm: n, share of bars in the market, and the annual Sharpe ratio of ``signal`` times the next
    ``ret``: always (base), only where ``state`` isn't above 0 (calm), only where it is (explosive). ``state`` is carried
    forward over nulls. Each bar pays ``cost`` times the arm's share; null for a deviation of 0."""
    at = by_symbol()
    state = F.last("state", True).over(at.rowsBetween(Window.unboundedPreceding, 0))
    own = rows.select("symbol", (F.col("signal") * F.lead("ret").over(at)).alias("_r"), F.coalesce(state > 0, F.lit(False)).alias("_e"))
    own = own.where("_r is not null")
    arms = F.array(*(F.struct(F.lit(a).alias("arm"), on.alias("on")) for a, on in (("base", F.lit(True)), ("calm", ~F.col("_e")), ("explosive", F.col("_e")))))
    each = own.select("symbol", "_r", F.explode(arms).alias("_a")).select("symbol", "_a.arm", F.when(F.col("_a.on"), F.col("_r")).otherwise(0.0).alias("_x"), F.col("_a.on").cast("double").alias("_on"))
    by = each.groupBy("symbol", "arm").agg(F.count("*").alias("n"), F.avg("_on").alias("share"), F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_s"))
    held = F.when(F.col("arm") == "base", F.lit(1.0)).otherwise(F.col("share"))
    return by.select("symbol", "arm", "n", "share", F.when(F.col("_s") >= 1e-15, (F.col("_m") - cost * held) / F.col("_s") * F.sqrt(F.lit(float(a_year)))).alias("sharpe"))


def extreme_side(x: Column, n: int, limit: float, fade: bool = True, valid: Column | None = None) -> Column:
    """-1 where the rolling z of ``x`` over n rows is above ``limit`` and 1 below -limit (signs swapped unless fade),
    else 0; 0 where it isn't known or not valid. Fits funding, taker share, venue gaps and residuals."""
    z = F.coalesce(rolling_z(x, n), F.lit(0.0))
    on = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    sign = 1 if fade else -1
    return F.when(on & (z > limit), -sign).when(on & (z < -limit), sign).otherwise(0)


def squeeze_side(interest: Column, funding: Column, n: int, limit: float, valid: Column | None = None) -> Column:
    """Against the funding's sign where the rolling z of open interest is above ``limit``, else 0."""
    z = F.coalesce(rolling_z(interest, n), F.lit(0.0))
    on = (z > limit) if valid is None else (z > limit) & F.coalesce(valid, F.lit(False))
    return F.when(on, -F.coalesce(F.signum(funding), F.lit(0.0))).otherwise(0.0).cast("int")


def leader_residual(rows: DataFrame, own: str, leader: str, n: int) -> DataFrame:
    """residual: ``own`` less its line on ``leader``, fitted on the n rows before this one; null before there are n
    and where the leader doesn't vary."""
    past = by_symbol().rowsBetween(-n, -1)
    a, b = F.col(own), F.col(leader)
    both = F.when(a.isNotNull() & b.isNotNull(), a)
    var = F.var_samp(b).over(past)
    beta = F.covar_samp(a, b).over(past) / var
    fit = F.avg(a).over(past) + beta * (b - F.avg(b).over(past))
    return rows.withColumn("residual", F.when((F.count(both).over(past) >= n) & (var > 0), a - fit))


def validation_features(
    bars: DataFrame, sums: tuple[int, ...] = (1, 3, 6, 12, 24), deviations: tuple[int, ...] = (6, 24, 48), volume: int = 48, order: tuple[float, float] = (0.4, 1e-4)
) -> DataFrame:
    """mom{n}: sum of the last n log returns; vol{n}: their deviation (the first bar's return is 0); vol_z: the rolling
    z of log(1 + volume); ffd: the log close's fractional difference of ``order`` (d, least weight). Null before n rows,
    and before as many as there are weights."""
    at = by_symbol()
    rows = bars.withColumn("_r", F.coalesce(F.log("close") - F.lag(F.log("close")).over(at), F.lit(0.0)))
    r = F.col("_r")
    new = {f"mom{n}": full(F.sum(r).over(trailing(n)), r, trailing(n), n) for n in sums}
    new |= {f"vol{n}": full(F.stddev_samp(r).over(trailing(n)), r, trailing(n), n) for n in deviations}
    rows = rows.withColumns(new | {"vol_z": rolling_z(F.log1p("volume"), volume), "_c": F.log("close")})
    return fractional_difference(rows, *order, column="_c").drop("_r", "_c")


def forward_volatility(bars: DataFrame, h: int, span: int) -> DataFrame:
    """fwd_vol: sum of the sizes of the next h log returns; usual: the median of it over the ``span`` bars before (half
    of them at least), and large: whether it is above; null where either lacks."""
    at = by_symbol()
    rows = bars.withColumn("_r", F.coalesce(F.abs(F.log("close") - F.lag(F.log("close")).over(at)), F.lit(0.0)))
    ahead, past = at.rowsBetween(1, h), at.rowsBetween(-span, -1)
    rows = rows.withColumn("fwd_vol", full(F.sum("_r").over(ahead), F.col("_r"), ahead, h)).drop("_r")
    usual = full(F.percentile("fwd_vol", F.lit(0.5)).over(past), F.col("fwd_vol"), past, max(1, span // 2))
    return rows.withColumn("usual", usual).withColumn("large", (F.col("fwd_vol") > F.col("usual")).cast("int"))
