"""Queries of panels, carry books, sleeves and signals, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequences import fractional_weights
from ..operators import books as K
from ..operators import returns as R
from .corpus import PANEL, panel
from .market import DOLLAR, TICKS, dollar_bars, rounded, ticks
from .registry import query

HOUR = 3_600_000_000

GRID = f"""with {TICKS}, p as (select symbol as name, us // {HOUR} as step, arg_max(price, us) as close, cast(sum(volume) as bigint) as volume, arg_min(price, us) as spot from ticks group by 1, 2),
g as (select name, unnest(range(a, b + 1)) as step from (select distinct name from p), (select min(step) as a, max(step) as b from p)),
f as (select name, step, close, volume, spot, case when step % 8 = 0 then (volume % 100 - 50) / 1e4 end as fed from g left join p using (name, step)),
s as (select name, min(step) + 24 as a, max(step) - 24 as b from p where name < 'd' group by 1),
v as (select name, step, close, volume, coalesce(last_value(fed ignore nulls) over (partition by name order by step rows between unbounded preceding and 1 preceding), 0) as funding,
  lag(close / nullif(spot, 0) - 1) over w as basis, case when close > 0 then ln(close) end - lag(case when close > 0 then ln(close) end) over w as ret from f window w as (partition by name order by step)),
panel as (select v.*, coalesce(close > 0 and volume > 0, false) and coalesce(step >= a and step <= b, true) as valid from v left join s using (name))"""


def hourly(spark, sf_dir):
    """Hours of every symbol of events on one clock; funding comes every eighth hour, spot is the hour's first price."""
    w = F.struct("us", "id")
    rows = ticks(spark, sf_dir).groupBy(F.col("symbol").alias("name"), F.expr(f"us div {HOUR}").alias("step")).agg(
        F.max_by("price", w).alias("close"), F.sum("volume").cast("bigint").alias("volume"), F.min_by("price", w).alias("spot")
    )
    fed = rows.where("step % 8 = 0").select("name", "step", ((F.col("volume") % 100 - 50) / 1e4).alias("value"))
    spans = rows.where("name < 'd'").groupBy("name").agg((F.min("step") + 24).alias("start"), (F.max("step") - 24).alias("end"))
    return K.grid_panel(rows.drop("spot"), {"funding": (fed, 0.0)}, spans, rows.select("name", "step", F.col("spot").alias("close")))


@query("grid_panel", f"{GRID} select name, step, close, volume, round(funding, 8) as funding, round(basis, 9) as basis, round(ret, 9) as ret, valid from panel")
def grid_panel(spark, sf_dir):
    return rounded(hourly(spark, sf_dir).select("name", "step", "close", "volume", "funding", "basis", "ret", "valid"), funding=8, basis=9, ret=9)


DAILY = f"""with {PANEL}, r as (select name, date, x as close, count(*) over (partition by name) as n from panel where x > 0),
d as (select date, row_number() over (order by date) as i from (select distinct date from r where n >= 20)),
c as (select name, date, close, coalesce(case when lag(i) over w = i - 1 then ln(close) - lag(ln(close)) over w end, 0) as ret, 3e-4 + greatest(0.0035 / close, 0.35 / 25000) as c
  from r join d using (date) where n >= 20 window w as (partition by name order by date))"""


@query("daily_panel", f"{DAILY} select name, date, close, round(ret, 9) as ret, round(quantile_cont(c, 0.5) over (partition by name), 9) as per_side from c")
def daily_panel(spark, sf_dir):
    rows = panel(spark, sf_dir).select("name", "date", F.col("x").alias("close"))
    return rounded(K.daily_panel(rows, 20).select("name", "date", "close", "ret", "per_side"), ret=9, per_side=9)


# Weekly results and quantities as a panel with funding: 0 for a few rows, which a book leaves out.
FUNDED = f"""{PANEL}, funded as (select name, date, ret, (x % 41 - 20) / 1e3 as funding, ret > -1e9 as valid, case when count(*) over w >= 8 then stddev_samp(ret) over w end as risk
  from panel window w as (partition by name order by date rows between 16 preceding and 1 preceding)),
days as (select date, row_number() over (order by date) - 1 as i from (select distinct date from funded))"""
TARGET, SPAN, COST = 0.5, 24, 1e-3


def funded(spark, sf_dir):
    past = K.by_name().rowsBetween(-16, -1)
    rows = panel(spark, sf_dir).withColumns({"funding": (F.col("x") % 41 - 20) / 1e3, "valid": F.col("ret") > -1e9})
    return rows.withColumn("risk", F.when(F.count("*").over(past) >= 8, F.stddev_samp("ret").over(past)))


def carry_sql(tag: str, q: float, rebalance: int, risk: bool) -> str:
    """CTEs of one book; the last is b{tag} (i, date, leverage, price, funding, cost, pnl)."""
    t, u = tag, "1 / risk" if risk else "1.0"
    return f"""u{t} as (select i, name, {u} as u, count(*) over (partition by i) as n, row_number() over (partition by i order by funding, name) as lo from funded join days using (date)
  where i % {rebalance} = 0 and i >= {SPAN} and valid and funding <> 0 {"and risk > 1e-9" if risk else ""}),
s{t} as (select i as r, name, u, case when lo > n - greatest(floor({q} * n), 1) then -1 when lo <= greatest(floor({q} * n), 1) then 1 end as s from u{t} where n >= 4),
c{t} as (select r, name, s * u / sum(u) over (partition by r, s) as weight from s{t} where s is not null),
h{t} as (select i, date, last_value(r ignore nulls) over (order by i) as r, max(i) over () as m from days left join (select distinct r from c{t}) k on k.r = days.i),
w{t} as (select i, date, name, weight from h{t} join c{t} using (r) where i < m),
o{t} as (select i, name, coalesce(ret, 0) as ret, coalesce(funding, 0) as funding from funded join days using (date)),
y{t} as (select w.i, sum(weight * coalesce(a.ret, 0)) as p, -sum(weight * coalesce(n.funding, 0)) as f from w{t} w left join o{t} n on n.i = w.i and n.name = w.name left join o{t} a on a.i = w.i + 1 and a.name = w.name group by 1),
z{t} as (select days.i, date, coalesce(p, 0) as p, coalesce(f, 0) as f from days left join y{t} using (i)),
l{t} as (select *, case when count(*) over v >= {SPAN // 2} then stddev_samp(p + f) over v end as sd from z{t} window v as (order by i rows between {SPAN} preceding and 1 preceding)),
k{t} as (select *, case when sd > 1e-9 then least({TARGET} / sd, 5) else 0 end as leverage from l{t}),
x{t} as (select i, name, weight * leverage as w from w{t} join k{t} using (i)),
e{t} as (select i, sum(abs(w)) as turnover from (select i, name, sum(w) as w from (select * from x{t} union all select i + 1, name, -w from x{t}) group by 1, 2) group by 1),
b{t} as (select i, date, leverage, leverage * p as price, leverage * f as funding, {COST} * coalesce(turnover, 0) as cost, leverage * p + leverage * f - {COST} * coalesce(turnover, 0) as pnl from k{t} left join e{t} using (i))"""


def books(rows, settings, risk):
    return K.carry_books(rows, settings, 4, TARGET, SPAN, COST, risk="risk" if risk else None)


OUT = "i, date, round(leverage, 7) as leverage, round(price, 14) as price, round(funding, 14) as funding, round(cost, 14) as cost, round(pnl, 14) as pnl"


@query("funding_carry", f"with {FUNDED}, {carry_sql('', 0.2, 8, False)} select {OUT} from b")
def funding_carry(spark, sf_dir):
    return rounded(books(funded(spark, sf_dir), {"one": (0.2, 8)}, False).drop("setting"), leverage=7, price=14, funding=14, cost=14, pnl=14)


@query("risk_weighted_carry", f"with {FUNDED}, {carry_sql('', 0.3, 4, True)} select {OUT} from b")
def risk_weighted_carry(spark, sf_dir):
    return rounded(books(funded(spark, sf_dir), {"one": (0.3, 4)}, True).drop("setting"), leverage=7, price=14, funding=14, cost=14, pnl=14)


SETTINGS = {f"{r}_{q}": (q, r) for r in (2, 4) for q in (0.1, 0.2, 0.3)}


def grid_sql() -> str:
    inside, walk = 100, 50
    parts = ", ".join(carry_sql(f"_{j}", q, r, True) for j, (q, r) in enumerate(SETTINGS.values()))
    union = " union all ".join(f"select '{s}' as setting, i, pnl from b_{j}" for j, s in enumerate(SETTINGS))
    return f"""with {FUNDED}, {parts}, res as ({union}), m as (select max(i) as m from res),
fl as (select unnest(range(0, (m + 1 - {SPAN} - {inside + walk}) // {walk} + 1)) as fold from m where m + 1 - {SPAN} >= {inside + walk}),
sc as (select fold, setting, round(avg(pnl) / nullif(stddev_samp(pnl), 0), 14) as s from res, fl where i >= {SPAN} + fold * {walk} and i < {SPAN + inside} + fold * {walk} group by 1, 2),
bs as (select fold, setting from (select *, row_number() over (partition by fold order by s desc, setting) as r from sc where s is not null) where r = 1)
select fold, setting, i, round(pnl, 14) as pnl from res join bs using (setting) where i >= {SPAN + inside} + fold * {walk} and i < {SPAN + inside + walk} + fold * {walk}"""


@query("carry_walk_forward", grid_sql())
def carry_walk_forward(spark, sf_dir):
    return rounded(K.chosen_forward(books(funded(spark, sf_dir), SETTINGS, True), 100, 50, SPAN), pnl=14)


RET = "r as (select *, ln(close) - lag(ln(close)) over w as ret from bars window w as (partition by symbol order by bar_idx) qualify lag(close) over w is not null)"


@query(
    "regime_sleeves",
    f"""{DOLLAR}, {RET}, s as (select symbol, coalesce(sign(ret), 0) * lead(ret) over w as r, coalesce(last_value(case when bar_idx % 5 = 0 then ret end ignore nulls) over w > 0, false) as e from r window w as (partition by symbol order by bar_idx)),
a as (select symbol, unnest([{{'arm': 'base', 'x': r, 'b': 1.0}}, {{'arm': 'calm', 'x': case when e then 0 else r end, 'b': case when e then 0.0 else 1.0 end}}, {{'arm': 'explosive', 'x': case when e then r else 0 end, 'b': case when e then 1.0 else 0.0 end}}], recursive := true) from s where r is not null),
g as (select symbol, arm, count(*) as n, avg(b) as share, avg(x) as m, stddev_samp(x) as s from a group by 1, 2)
select symbol, arm, n, round(share, 9) as share, round(case when s >= 1e-15 then (m - 1e-4 * share) / s * sqrt(252.0) end, 6) as sharpe from g""",
)
def regime_sleeves(spark, sf_dir):
    rows = R.with_log_return(dollar_bars(spark, sf_dir))
    rows = rows.withColumns({"signal": F.coalesce(F.signum("ret"), F.lit(0.0)), "state": F.when(F.col("bar_idx") % 5 == 0, F.col("ret"))})
    return rounded(K.regime_sleeves(rows, 1e-4, 252), share=9, sharpe=6)


def z_sql(x: str, n: int) -> str:
    return f"coalesce(case when count({x}) over w{n} >= {n} and stddev_samp({x}) over w{n} > 0 then ({x} - avg({x}) over w{n}) / stddev_samp({x}) over w{n} end, 0)"


@query(
    "edge_signals",
    f"""{DOLLAR}, {RET}, lead_ret as (select bar_idx, ret as leader from r where symbol = 'click'),
j as (select r.*, leader, (buy_dollar - sell_dollar) * 1.0::double / nullif(dollar, 0) as share from r left join lead_ret on lead_ret.bar_idx = r.bar_idx and r.symbol <> 'click'),
q as (select *, case when count(case when ret is not null and leader is not null then 1 end) over p >= 40 and var_samp(leader) over p > 0
  then ret - (avg(ret) over p + covar_samp(ret, leader) over p / var_samp(leader) over p * (leader - avg(leader) over p)) end as residual from j window p as (partition by symbol order by bar_idx rows between 40 preceding and 1 preceding)),
z as (select symbol, bar_idx, share, residual, round({z_sql("share", 40)}, 9) as zs, round({z_sql("volume", 20)}, 9) as zv, round({z_sql("residual", 20)}, 9) as zr from q
  window w20 as (partition by symbol order by bar_idx rows 19 preceding), w40 as (partition by symbol order by bar_idx rows 39 preceding))
select symbol, bar_idx, round(residual, 8) as residual, case when zs > 1 then -1 when zs < -1 then 1 else 0 end as flow, case when zs > 1 then 1 when zs < -1 then -1 else 0 end as follow,
cast(case when zv > 1 then -coalesce(sign(share), 0) else 0 end as integer) as squeeze, case when zr > 1 then -1 when zr < -1 then 1 else 0 end as reverting from z""",
)
def edge_signals(spark, sf_dir):
    bars = R.with_log_return(dollar_bars(spark, sf_dir))
    leader = bars.where("symbol = 'click'").select("bar_idx", F.col("ret").alias("leader"))
    rows = bars.join(leader, "bar_idx", "left").withColumn("leader", F.when(F.col("symbol") != "click", F.col("leader")))
    rows = rows.withColumn("share", F.try_divide((F.col("buy_dollar") - F.col("sell_dollar")).cast("double"), F.col("dollar")))
    rows = K.leader_residual(rows, "ret", "leader", 40)
    share = F.col("share")
    sides = {
        "flow": K.extreme_side(share, 40, 1.0), "follow": K.extreme_side(share, 40, 1.0, fade=False), "squeeze": K.squeeze_side(F.col("volume"), share, 20, 1.0),
        "reverting": K.extreme_side(F.col("residual"), 20, 1.0),
    }
    return rounded(rows.withColumns(sides).select("symbol", "bar_idx", "residual", *sides), residual=8)


SUMS, DEVIATIONS = (1, 3, 6, 12, 24), (6, 24, 48)
#: Order and least weight of the fractional difference; the operator's own 1e-4 takes 282 bars, more than small tables have.
ORDER = (0.4, 1e-3)


def features_sql() -> str:
    mom = ", ".join(f"round(case when count(r) over w{n} >= {n} then sum(r) over w{n} end, 8) as mom{n}" for n in SUMS)
    vol = ", ".join(f"round(case when count(r) over w{n} >= {n} then stddev_samp(r) over w{n} end, 8) as vol{n}" for n in DEVIATIONS)
    spans = ", ".join(f"w{n} as (partition by symbol order by bar_idx rows {n - 1} preceding)" for n in sorted({*SUMS, *DEVIATIONS}))
    v = "ln(1.0::double + volume)"
    ffd = " + ".join(f"{float(w)!r}::double * lag(ln(close), {k}) over w1" for k, w in enumerate(fractional_weights(*ORDER)))
    return f"""{DOLLAR}, f as (select *, coalesce(ln(close) - lag(ln(close)) over (partition by symbol order by bar_idx), 0) as r from bars)
select symbol, bar_idx, {mom}, {vol}, round(case when count(*) over w48 >= 48 and stddev_samp({v}) over w48 > 0 then ({v} - avg({v}) over w48) / stddev_samp({v}) over w48 end, 6) as vol_z, round({ffd}, 7) as ffd from f window {spans}"""


@query("validation_features", features_sql())
def validation_features(spark, sf_dir):
    rows = K.validation_features(dollar_bars(spark, sf_dir), SUMS, DEVIATIONS, order=ORDER)
    names = [f"mom{n}" for n in SUMS] + [f"vol{n}" for n in DEVIATIONS]
    return rounded(rows.select("symbol", "bar_idx", *names, "vol_z", "ffd"), **dict.fromkeys(names, 8), vol_z=6, ffd=7)


@query(
    "forward_volatility",
    f"""{DOLLAR}, r as (select symbol, bar_idx, coalesce(abs(ln(close) - lag(ln(close)) over (partition by symbol order by bar_idx)), 0) as r from bars),
v as (select symbol, bar_idx, case when count(r) over a >= 5 then sum(r) over a end as v from r window a as (partition by symbol order by bar_idx rows between 1 following and 5 following)),
u as (select *, case when count(v) over p >= 15 then quantile_cont(v, 0.5) over p end as u from v window p as (partition by symbol order by bar_idx rows between 30 preceding and 1 preceding))
select symbol, bar_idx, round(v, 8) as fwd_vol, round(u, 8) as usual, cast(v > u as integer) as large from u""",
)
def forward_volatility(spark, sf_dir):
    rows = K.forward_volatility(dollar_bars(spark, sf_dir), 5, 30)
    return rounded(rows.select("symbol", "bar_idx", "fwd_vol", "usual", "large"), fwd_vol=8, usual=8)
