"""Queries over bars of the events table, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import costs as C
from ..operators import events as E
from ..operators import returns as R
from ..operators import rolling as W
from ..sources.ticks import event_ticks
from .registry import query, table

N_TARGET = 200

TICKS = """ticks as (select event_type as symbol, epoch_us(ts) as us, event_id as id, value as price,
  cast(regexp_extract(props, '[0-9]+') as bigint) as volume, cast(round(value * 100) as bigint) as cents,
  cast(round(value * 100) as bigint) * cast(regexp_extract(props, '[0-9]+') as bigint) as dollar,
  cast(regexp_extract(props, '[0-9]+') as bigint) % 2 = 0 as buy from events)"""


def with_ids(running: str, target: int = N_TARGET) -> str:
    return f"""{TICKS}, ids as (select *, cast(({target} * cast(sum({running}) over (partition by symbol order by us, id) as hugeint))
  // sum({running}) over (partition by symbol) as bigint) as bar_idx from ticks)"""


FOLD = """bars as (select symbol, bar_idx, min(us) as t_open, max(us) as t_close, arg_min(price, us) as open, max(price) as high, min(price) as low,
  arg_max(price, us) as close, cast(sum(volume) as bigint) as volume, cast(sum(dollar) as bigint) as dollar,
  cast(sum(case when buy then dollar else 0 end) as bigint) as buy_dollar, cast(sum(case when buy then 0 else dollar end) as bigint) as sell_dollar,
  count(*) as n_base from ids group by all)"""
DENSE = "bars as (select * replace (row_number() over (partition by symbol order by bar_idx) - 1 as bar_idx) from gaps)"
DOLLAR = f"with {with_ids('dollar')}, {FOLD.replace('bars as', 'gaps as', 1)}, {DENSE}"
BARS = f"{DOLLAR} select * from bars"


def ticks(spark, sf_dir) -> DataFrame:
    return event_ticks(table(spark, sf_dir, "events"))


def dollar_bars(spark, sf_dir, n_target: int = N_TARGET) -> DataFrame:
    return B.dense(B.fold(B.threshold_ids(ticks(spark, sf_dir), "dollar", n_target)))


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("bars_dollar", BARS)
def bars_dollar(spark, sf_dir):
    return dollar_bars(spark, sf_dir)


@query("bars_volume", f"with {with_ids('volume')}, {FOLD} select * from bars")
def bars_volume(spark, sf_dir):
    return B.fold(B.threshold_ids(ticks(spark, sf_dir), "volume", N_TARGET))


@query("bars_tick", f"with {with_ids('1')}, {FOLD} select * from bars")
def bars_tick(spark, sf_dir):
    return B.fold(B.threshold_ids(ticks(spark, sf_dir), "tick", N_TARGET))


@query("bars_count", f"with {TICKS}, ids as (select *, (row_number() over (partition by symbol order by us, id) - 1) // 10 as bar_idx from ticks), {FOLD} select * from bars")
def bars_count(spark, sf_dir):
    return B.fold(B.count_ids(ticks(spark, sf_dir), 10))


@query(
    "bars_matched_count",
    f"""with {TICKS}, k as (select symbol, greatest(1, cast(round_even(count(*) / 300.0, 0) as bigint)) as k from ticks group by 1),
ids as (select ticks.*, (row_number() over (partition by symbol order by us, id) - 1) // k as bar_idx from ticks join k using (symbol)), {FOLD} select * from bars""",
)
def bars_matched_count(spark, sf_dir):
    return B.fold(B.matched_count_ids(ticks(spark, sf_dir), 300))


@query("bars_right_closed", f"with {TICKS}, ids as (select *, cast(ceil(us / 3600000000.0) as bigint) as bar_idx from ticks), {FOLD} select * from bars")
def bars_right_closed(spark, sf_dir):
    return B.fold(B.right_closed_ids(ticks(spark, sf_dir), 60))


@query("close_daily", f"with {TICKS} select symbol, us // 86400000000 as day, arg_max(price, us) as close from ticks group by 1, 2")
def close_daily(spark, sf_dir):
    return B.daily_close(ticks(spark, sf_dir))


@query("close_hourly", f"with {TICKS} select symbol, us // 3600000000 as hour, arg_max(price, us) as close from ticks group by 1, 2")
def close_hourly(spark, sf_dir):
    return B.hourly_close(ticks(spark, sf_dir))


@query(
    "clean_log_close",
    f"""{DOLLAR}, c as (select *, coalesce(close <> lag(close) over w, true) as ch from bars where close > 0 window w as (partition by symbol order by bar_idx)),
e as (select symbol, max(case when ch then bar_idx end) as e, count(*) as n from c group by 1)
select symbol, bar_idx, round(ln(close), 9) as log_close from c join e using (symbol) where bar_idx <= e.e or n <= 10""",
)
def clean_log_close(spark, sf_dir):
    return B.clean_log_close(dollar_bars(spark, sf_dir)).select("symbol", "bar_idx", F.round("log_close", 9).alias("log_close"))


SIGNED = """signed as (select *, cast(coalesce(last_value(nullif(s, 0) ignore nulls) over (partition by symbol order by bar_idx), 1) as integer) as carried
  from (select *, sign(close - lag(close) over (partition by symbol order by bar_idx)) as s from bars))"""


@query("tick_sign", f"{DOLLAR}, {SIGNED} select symbol, bar_idx, case when s is null then 1 else carried end as sign from signed")
def tick_sign(spark, sf_dir):
    return B.with_tick_sign(dollar_bars(spark, sf_dir)).select("symbol", "bar_idx", "sign")


@query("tick_sign_micro", f"{DOLLAR}, {SIGNED} select symbol, bar_idx, case when s is null then 0 else carried end as sign from signed")
def tick_sign_micro(spark, sf_dir):
    return B.with_tick_sign(dollar_bars(spark, sf_dir), 0).select("symbol", "bar_idx", "sign")


@query(
    "count_stability",
    f"""{DOLLAR}, w as (select symbol, (t_close // 86400000000 + 3) // 7 as week, count(*) as n from bars group by 1, 2)
select symbol, count(*) as weeks, round(case when count(*) >= 5 then stddev_samp(n) / avg(n) end, 9) as variation from w group by 1""",
)
def count_stability(spark, sf_dir):
    return rounded(B.count_stability(dollar_bars(spark, sf_dir)), variation=9)


RETURNS = "rets as (select * from (select *, ln(close) - lag(ln(close)) over (partition by symbol order by bar_idx) as ret from bars) where ret is not null)"


@query("log_returns", f"{DOLLAR}, {RETURNS} select symbol, bar_idx, round(ret, 9) as ret from rets")
def log_returns(spark, sf_dir):
    return R.with_log_return(dollar_bars(spark, sf_dir)).select("symbol", "bar_idx", F.round("ret", 9).alias("ret"))


@query(
    "session_returns",
    f"""{DOLLAR}, r as (select symbol, bar_idx, ln(close) - lag(ln(close)) over (partition by symbol, t_open // 86400000000 order by bar_idx) as ret from bars)
select symbol, bar_idx, round(ret, 9) as ret from r where ret is not null""",
)
def session_returns(spark, sf_dir):
    return R.session_returns(dollar_bars(spark, sf_dir)).select("symbol", "bar_idx", F.round("ret", 9).alias("ret"))


@query(
    "gap_filtered_returns",
    f"""{DOLLAR}, r as (select symbol, bar_idx, t_open - lag(t_close) over w as gap, ln(close) - lag(ln(close)) over w as ret from bars
window w as (partition by symbol order by bar_idx)) select symbol, bar_idx, round(ret, 9) as ret from r where gap <= 1800000000 and ret is not null""",
)
def gap_filtered_returns(spark, sf_dir):
    return R.gap_filtered_returns(dollar_bars(spark, sf_dir), 0.5).select("symbol", "bar_idx", F.round("ret", 9).alias("ret"))


@query(
    "flow_imbalance",
    f"""{DOLLAR} select symbol, bar_idx, round(case when buy_dollar + sell_dollar = 0 then 0 else cast(buy_dollar - sell_dollar as double) / (buy_dollar + sell_dollar) end, 9) as ofi from bars""",
)
def flow_imbalance(spark, sf_dir):
    ofi = R.flow_imbalance(F.col("buy_dollar"), F.col("sell_dollar"))
    return dollar_bars(spark, sf_dir).select("symbol", "bar_idx", F.round(ofi, 9).alias("ofi"))


@query(
    "bar_return_stats",
    f"""{DOLLAR}, {RETURNS}, l as (select *, lag(ret) over (partition by symbol order by bar_idx) as prev from rets),
m as (select symbol, count(*) as n, avg(ret) as a, var_pop(ret) as v, kurtosis_pop(ret) as k, corr(ret, prev) as ac from l group by 1),
s as (select symbol, avg(pow(ret - a, 3)) / pow(any_value(v), 1.5) as skew from l join m using (symbol) group by 1)
select symbol, n, round(case when n >= 50 then skew end, 6) as skew, round(case when n >= 50 then k end, 6) as excess_kurtosis,
round(case when n >= 50 then n / 6.0 * (skew * skew + k * k / 4) end, 4) as jarque_bera, round(case when n >= 50 then ac end, 6) as autocorrelation from m join s using (symbol)""",
)
def bar_return_stats(spark, sf_dir):
    stats = R.return_diagnostics(R.with_log_return(dollar_bars(spark, sf_dir)))
    return rounded(stats, skew=6, excess_kurtosis=6, jarque_bera=4, autocorrelation=6)


@query(
    "roll_spread",
    f"""{DOLLAR}, d as (select symbol, bar_idx, close - lag(close) over w as d, row_number() over w as n from bars window w as (partition by symbol order by bar_idx)),
l as (select *, lag(d) over (partition by symbol order by bar_idx) as l from d)
select symbol, bar_idx, round(case when n > 20 then 2 * sqrt(greatest(-covar_pop(d, l) over (partition by symbol order by bar_idx rows 19 preceding), 0)) end, 6) as roll from l""",
)
def roll_spread(spark, sf_dir):
    return rounded(W.roll_spread(dollar_bars(spark, sf_dir), 20).select("symbol", "bar_idx", "roll"), roll=6)


@query(
    "corwin_schultz",
    f"""{DOLLAR}, p as (select symbol, bar_idx, high, low, lag(high) over w as ph, lag(low) over w as pl from bars window w as (partition by symbol order by bar_idx)),
b as (select symbol, bar_idx, pow(ln(high / low), 2) + pow(ln(ph / pl), 2) as b, pow(ln(greatest(high, ph) / least(low, pl)), 2) as g, ph from p),
a as (select symbol, bar_idx, ph, (sqrt(2 * b) - sqrt(b)) / (3 - 2 * sqrt(2)) - sqrt(g / (3 - 2 * sqrt(2))) as a from b)
select symbol, bar_idx, round(case when ph is not null then greatest(2 * (exp(a) - 1) / (1 + exp(a)), 0) end, 8) as cs_spread from a""",
)
def corwin_schultz(spark, sf_dir):
    return rounded(W.corwin_schultz(dollar_bars(spark, sf_dir)).select("symbol", "bar_idx", "cs_spread"), cs_spread=8)


@query(
    "kyle_lambda",
    f"""{DOLLAR}, {SIGNED}, r as (select symbol, bar_idx, ln(close) - lag(ln(close)) over (partition by symbol order by bar_idx) as r,
case when s is null then 0 else carried end as sg, volume, dollar from signed),
x as (select symbol, bar_idx, r, case when r is not null then sg * cast(volume as double) end as x, case when r is not null then sg * sqrt(dollar) end as y from r)
select symbol, bar_idx, round(case when count(r) over w >= 50 and var_pop(x) over w > 0 then 1e6 * covar_pop(r, x) over w / var_pop(x) over w end, 5) as kyle,
round(case when count(r) over w >= 50 and var_pop(y) over w > 0 then 1e6 * covar_pop(r, y) over w / var_pop(y) over w end, 5) as hasbrouck
from x window w as (partition by symbol order by bar_idx rows 49 preceding)""",
)
def kyle_lambda(spark, sf_dir):
    rows = W.price_impact(B.with_tick_sign(dollar_bars(spark, sf_dir), 0), 50)
    return rows.select("symbol", "bar_idx", F.round(1e6 * F.col("kyle"), 5).alias("kyle"), F.round(1e6 * F.col("hasbrouck"), 5).alias("hasbrouck"))


@query(
    "amihud_vpin",
    f"""{DOLLAR}, a as (select symbol, bar_idx, row_number() over w as n, 1e9 * abs(ln(close) - lag(ln(close)) over w) / nullif(dollar, 0) as a,
cast(abs(buy_dollar - sell_dollar) as double) / nullif(buy_dollar + sell_dollar, 0) as f from bars window w as (partition by symbol order by bar_idx))
select symbol, bar_idx, round(case when n >= 20 then avg(a) over w end, 6) as amihud, round(case when n >= 20 then avg(f) over w end, 6) as vpin
from a window w as (partition by symbol order by bar_idx rows 19 preceding)""",
)
def amihud_vpin(spark, sf_dir):
    rows = W.illiquidity(dollar_bars(spark, sf_dir), 20)
    return rows.select("symbol", "bar_idx", F.round(1e9 * F.col("amihud"), 6).alias("amihud"), F.round("vpin", 6).alias("vpin"))


@query(
    "rolling_z",
    f"""{DOLLAR} select symbol, bar_idx, round(case when count(*) over w >= 20 and stddev_samp(ln(close)) over w > 0
then (ln(close) - avg(ln(close)) over w) / stddev_samp(ln(close)) over w end, 6) as z from bars window w as (partition by symbol order by bar_idx rows 19 preceding)""",
)
def rolling_z(spark, sf_dir):
    return dollar_bars(spark, sf_dir).select("symbol", "bar_idx", F.round(W.rolling_z(F.log("close"), 20), 6).alias("z"))


@query(
    "momentum_vol",
    f"""{DOLLAR}, r as (select symbol, bar_idx, ln(close) as c, ln(close) - lag(ln(close)) over w as r from bars window w as (partition by symbol order by bar_idx)),
v as (select symbol, bar_idx, c - lag(c, 24) over (partition by symbol order by bar_idx) as m,
case when count(r) over w >= 6 then stddev_samp(r) over w end as v from r window w as (partition by symbol order by bar_idx rows 23 preceding))
select symbol, bar_idx, round(lag(m) over w, 8) as momentum, round(lag(v) over w, 8) as vol from v window w as (partition by symbol order by bar_idx)""",
)
def momentum_vol(spark, sf_dir):
    return rounded(W.momentum_and_vol(dollar_bars(spark, sf_dir), 24).select("symbol", "bar_idx", "momentum", "vol"), momentum=8, vol=8)


@query(
    "flow_level",
    f"""{DOLLAR}, n as (select symbol, bar_idx, cast(buy_dollar - sell_dollar as double) as n from bars)
select symbol, bar_idx, round(case when count(*) over w >= 20 and stddev_samp(n) over w > 0 then sum(n) over w / stddev_samp(n) over w end, 6) as flow_level
from n window w as (partition by symbol order by bar_idx rows unbounded preceding)""",
)
def flow_level(spark, sf_dir):
    return rounded(W.flow_level(dollar_bars(spark, sf_dir)).select("symbol", "bar_idx", "flow_level"), flow_level=6)


def weighted(rows: str, x: str, span: float, tag: str) -> str:
    """A CTE e{tag} (symbol, bar_idx, m, s): exponentially weighted mean and bias-corrected deviation of ``x`` by their sums
    over all rows so far; s is 0 where there is none."""
    sums = "sum(w) as w, sum(w * w) as ww, sum(w * x) / sum(w) as m, sum(w * x * x) / sum(w) as q"
    return f"""p{tag} as (select a.symbol, a.bar_idx, pow(1 - 2 / ({span} + 1.0::double), a.bar_idx - b.bar_idx) as w, b.{x} as x from {rows} a join {rows} b on a.symbol = b.symbol and b.bar_idx <= a.bar_idx),
e{tag} as (select symbol, bar_idx, m, coalesce(case when w * w - ww > 1e-12 then sqrt(greatest(q - m * m, 0) * w * w / (w * w - ww)) end, 0) as s from (select symbol, bar_idx, {sums} from p{tag} group by 1, 2))"""


RET_ROWS = "rets as (select symbol, bar_idx, ln(close) - lag(ln(close)) over w as ret from bars window w as (partition by symbol order by bar_idx) qualify lag(close) over w is not null)"


@query("ewm_vol", f"{DOLLAR}, {RET_ROWS}, {weighted('rets', 'ret', 50, '')} select symbol, bar_idx, round(ret, 8) as ret, round(s, 8) as vol, round(m, 8) as mean from rets join e using (symbol, bar_idx)")
def ewm_vol(spark, sf_dir):
    rets = R.with_log_return(dollar_bars(spark, sf_dir)).select("symbol", "bar_idx", "ret")
    return rounded(W.with_ewm(rets, {"vol": ("ret", 50, "std"), "mean": ("ret", 50, "mean")}), ret=8, vol=8, mean=8)


@query(
    "crossover_events",
    f"""{DOLLAR}, {weighted("bars", "close", 10, "_f")}, {weighted("bars", "close", 50, "_s")},
c as (select symbol, bar_idx, cast(sign(e_f.m - e_s.m) as integer) as side from e_f join e_s using (symbol, bar_idx)),
l as (select *, lag(side) over (partition by symbol order by bar_idx) as was from c) select symbol, bar_idx, side from l where side <> 0 and side <> was""",
)
def crossover_events(spark, sf_dir):
    return W.crossover_events(dollar_bars(spark, sf_dir), 10, 50).select("symbol", "bar_idx", "side")


@query("rolling_entropy")
def rolling_entropy(spark, sf_dir):
    return W.rolling_entropy(dollar_bars(spark, sf_dir), 50)


EVENTS = """ev as (select symbol, bar_idx as ev_idx, case when bar_idx % 2 = 0 then 1 else -1 end as side, close as entry, 0.5 as sigma from bars)"""


def sample_events(bars: DataFrame) -> DataFrame:
    side = F.when(F.col("bar_idx") % 2 == 0, 1).otherwise(-1)
    return bars.select("symbol", F.col("bar_idx").alias("ev_idx"), side.alias("side"), F.col("close").alias("entry"), F.lit(0.5).alias("sigma"))


@query(
    "triple_barrier",
    f"""{DOLLAR}, {EVENTS}, b as (select *, entry * exp(side * 1.5 * sigma) as goal, entry * exp(-side * 1.0 * sigma) as halt from ev),
m as (select b.symbol, ev_idx, bars.bar_idx, close, case when (side > 0 and low <= halt) or (side < 0 and high >= halt) then -1
when (side > 0 and high >= goal) or (side < 0 and low <= goal) then 1 end as hit from b join bars on b.symbol = bars.symbol and bars.bar_idx between ev_idx + 1 and ev_idx + 10),
f as (select symbol, ev_idx, min(case when hit is not null then bar_idx end) as fi, arg_min(hit, bar_idx) filter (hit is not null) as fh, max(bar_idx) as ei, arg_max(close, bar_idx) as ec from m group by 1, 2)
select b.symbol, b.ev_idx, side, coalesce(fh, 0) as label, coalesce(fi, ei, b.ev_idx) as touch_idx, coalesce(fi, ei, b.ev_idx) - b.ev_idx as hold,
round(side * (case fh when 1 then goal when -1 then halt else coalesce(ec, entry) end / entry - 1), 8) as ret from b left join f on b.symbol = f.symbol and b.ev_idx = f.ev_idx""",
)
def triple_barrier(spark, sf_dir):
    bars = dollar_bars(spark, sf_dir)
    return rounded(E.triple_barrier(sample_events(bars), bars, 1.5, 1.0, 10), ret=8)


@query(
    "forward_returns",
    f"""{DOLLAR} select symbol, bar_idx, round(lead(ln(close), 5) over w - ln(close), 8) as fwd,
round(coalesce(lead(ln(close), 5) over w, last_value(ln(close)) over (partition by symbol order by bar_idx rows between unbounded preceding and unbounded following)) - ln(close), 8) as hold_ret
from bars window w as (partition by symbol order by bar_idx)""",
)
def forward_returns(spark, sf_dir):
    return rounded(E.forward_returns(dollar_bars(spark, sf_dir), 5).select("symbol", "bar_idx", "fwd", "hold_ret"), fwd=8, hold_ret=8)


def slope_sql(n: int) -> str:
    w = f"(partition by symbol order by bar_idx rows between current row and {n - 1} following)"
    x, y = "cast(bar_idx as double)", "ln(close)"
    rest = f"(var_pop({y}) over {w} - pow(covar_pop({x}, {y}) over {w}, 2) / var_pop({x}) over {w})"
    slope = f"covar_pop({x}, {y}) over {w} / var_pop({x}) over {w}"
    return f"case when count(*) over {w} >= {n} and {rest} > 1e-18 then {slope} / sqrt({rest} / var_pop({x}) over {w} / ({n} - 2)) end"


@query("horizon_label", f"{DOLLAR}, t as (select symbol, bar_idx, {slope_sql(20)} as t from bars) select symbol, bar_idx, round(t, 5) as t_val, cast(sign(t) as integer) as label from t")
def horizon_label(spark, sf_dir):
    return rounded(E.horizon_label(dollar_bars(spark, sf_dir), 20).select("symbol", "bar_idx", "t_val", "label"), t_val=5)


LENGTHS = range(20, 121)


@query(
    "trend_scan",
    f"""{DOLLAR}, t as ({" union all ".join(f"select symbol, bar_idx, {n} as length, {slope_sql(n)} as t, lead(ln(close), {n - 1}) over (partition by symbol order by bar_idx) - ln(close) as ret from bars" for n in LENGTHS)}),
r as (select *, row_number() over (partition by symbol, bar_idx order by abs(t) desc, length) as k from t where t is not null)
select symbol, bar_idx, round(t, 5) as t_val, length, cast(sign(t) as integer) as label, round(ret, 8) as ret from r where k = 1""",
)
def trend_scan(spark, sf_dir):
    return rounded(E.trend_scan(dollar_bars(spark, sf_dir), LENGTHS[0], LENGTHS[-1]), t_val=5, ret=8)


SPANS = f"{DOLLAR}, sp as (select symbol, bar_idx as start_idx, bar_idx + 5 + bar_idx % 9 as end_idx from bars)"
CONC = """conc as (select b.symbol, b.bar_idx, count(sp.symbol) as concurrent from bars b left join sp on sp.symbol = b.symbol and b.bar_idx between start_idx and end_idx group by 1, 2)"""


def sample_spans(bars: DataFrame) -> DataFrame:
    i = F.col("bar_idx")
    return bars.select("symbol", i.alias("start_idx"), (i + 5 + i % 9).alias("end_idx"))


@query("concurrency", f"{SPANS}, {CONC} select * from conc")
def concurrency(spark, sf_dir):
    bars = dollar_bars(spark, sf_dir)
    return E.concurrency(sample_spans(bars), bars)


@query(
    "uniqueness",
    f"""{SPANS}, {CONC} select sp.symbol, start_idx, end_idx, round(sum(1.0 / concurrent) / (end_idx - start_idx + 1), 8) as uniqueness
from sp join conc on sp.symbol = conc.symbol and bar_idx between start_idx and end_idx
where exists (select 1 from bars b where b.symbol = sp.symbol and b.bar_idx = end_idx) group by 1, 2, 3""",
)
def uniqueness(spark, sf_dir):
    bars = dollar_bars(spark, sf_dir)
    return rounded(E.uniqueness(sample_spans(bars), bars).select("symbol", "start_idx", "end_idx", "uniqueness"), uniqueness=8)


@query(
    "attribution_weights",
    f"""{SPANS}, {CONC}, r as (select symbol, bar_idx, coalesce(ln(close) - lag(ln(close)) over (partition by symbol order by bar_idx), 0) as r from bars),
a as (select sp.symbol, start_idx, end_idx, abs(sum(r / concurrent)) as w from sp join conc on sp.symbol = conc.symbol and conc.bar_idx between start_idx and end_idx
join r on r.symbol = conc.symbol and r.bar_idx = conc.bar_idx where exists (select 1 from bars b where b.symbol = sp.symbol and b.bar_idx = end_idx) group by 1, 2, 3)
select symbol, start_idx, end_idx, round(w / avg(w) over (partition by symbol), 6) as weight from a""",
)
def attribution_weights(spark, sf_dir):
    bars = dollar_bars(spark, sf_dir)
    return rounded(E.attribution_weights(sample_spans(bars), bars).select("symbol", "start_idx", "end_idx", "weight"), weight=6)


BETS = f"{DOLLAR}, bets as (select symbol, bar_idx as start_idx, bar_idx % 6 as hold, cast(bar_idx % 5 - 2 as double) / 2 as size from bars)"


def sample_bets(bars: DataFrame) -> DataFrame:
    i = F.col("bar_idx")
    return bars.select("symbol", i.alias("start_idx"), (i % 6).alias("hold"), ((i % 5 - 2).cast("double") / 2).alias("size"))


@query(
    "active_bets",
    f"""{BETS} select b.symbol, b.bar_idx, count(bets.symbol) as open, round(coalesce(avg(size), 0), 8) as position from bars b
left join bets on bets.symbol = b.symbol and b.bar_idx >= start_idx and b.bar_idx < start_idx + greatest(hold, 1) group by 1, 2""",
)
def active_bets(spark, sf_dir):
    bars = dollar_bars(spark, sf_dir)
    return rounded(E.active_bets(sample_bets(bars), bars), position=8)


@query(
    "costed_book",
    f"""{BETS}, p as (select b.symbol, b.bar_idx, b.close, coalesce(avg(size), 0) as position from bars b
left join bets on bets.symbol = b.symbol and b.bar_idx >= start_idx and b.bar_idx < start_idx + greatest(hold, 1) group by 1, 2, 3),
t as (select *, abs(position - coalesce(lag(position) over w, 0)) as turnover, lead(ln(close)) over w - ln(close) as nx from p window w as (partition by symbol order by bar_idx))
select symbol, bar_idx, round(position, 8) as position, round(turnover, 8) as turnover, round(position * coalesce(nx, 0) - 0.001 * turnover, 8) as pnl from t""",
)
def costed_book(spark, sf_dir):
    bars = dollar_bars(spark, sf_dir)
    book = E.costed_book(E.active_bets(sample_bets(bars), bars), bars, 0.001)
    return rounded(book.select("symbol", "bar_idx", "position", "turnover", "pnl"), position=8, turnover=8, pnl=8)


@query(
    "purged_folds",
    f"""{DOLLAR}, e as (select symbol, bar_idx as ev_idx, bar_idx + 6 as end_idx, row_number() over (partition by symbol order by bar_idx) - 1 as i,
count(*) over (partition by symbol) as n from bars), o as (select *, least(i // greatest(n // 5, 1), 4) as own from e),
t as (select symbol, own as fold, min(ev_idx) as lo, max(end_idx) as hi from o group by 1, 2)
select * from (select fold, o.symbol, ev_idx, case when own = fold then 'test' when end_idx < lo or ev_idx > hi + 2 then 'train' end as part from o join t on o.symbol = t.symbol) where part is not null""",
)
def purged_folds(spark, sf_dir):
    i = F.col("bar_idx")
    spans = dollar_bars(spark, sf_dir).select("symbol", i.alias("ev_idx"), (i + 6).alias("end_idx"))
    return E.purged_folds(spans, 5, 2)


@query(
    "fx_calendar",
    """with t as (select event_type as symbol, event_id, ts, isodow(ts) - 1 as d, hour(ts) as h from events),
o as (select *, not (d = 5 or (d = 6 and h < 22) or (d = 4 and h >= 22)) as is_open from t),
r as (select *, h >= 21 and row_number() over (partition by symbol, ts::date, h >= 21 order by ts) = 1 as rollover,
is_open and not coalesce(lead(is_open) over (partition by symbol order by ts), false) as force_flat from o)
select event_id, symbol, is_open, force_flat, rollover, case when rollover then case when d = 2 then 3.0::double else 1.0::double end else 0.0::double end as swap,
round(0.4 * case when h >= 7 and h < 12 then 1.3 when h >= 12 and h < 16 then 1.0 when h >= 16 and h < 21 then 1.6 when h >= 21 and h < 23 then 3.0 else 2.2 end::double, 6) as half_spread_pips from r""",
)
def fx_calendar(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), "ts")
    rows = C.with_rollover(C.with_force_flat(rows))
    pips = C.fx_half_spread(F.col("symbol"), F.col("ts")) / C.fx_pip(F.col("symbol"))
    return rows.select("event_id", "symbol", C.fx_open(F.col("ts")).alias("is_open"), "force_flat", "rollover", "swap", F.round(pips, 6).alias("half_spread_pips"))


NAMES = {"click": ("fx", "EURUSD"), "view": ("fx", "usdjpy"), "error": ("equity", "SPY"), "purchase": ("equity", "VXX"), "signup": ("crypto", "BTC")}


def cases(column: str, i: int) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v[i]}'" for k, v in NAMES.items()) + f" else '{('fx', 'EURSEK')[i]}' end"


def table_sql(key: str, values: dict[str, float], default: float) -> str:
    return f"cast(case upper({key}) " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + f" else {default} end as double)"


@query(
    "trade_costs",
    f"""with m as (select event_id, value, hour(ts) as h, hour(ts) * 60 + minute(ts) as m, {cases("event_type", 0)} as market, {cases("event_type", 1)} as name from events),
b as (select *, case when upper(name) like '%JPY' then 0.01::double else 0.0001::double end as pip, case when h >= 7 and h < 12 then 1.3 when h >= 12 and h < 16 then 1.0 when h >= 16 and h < 21 then 1.6 when h >= 21 and h < 23 then 3.0 else 2.2 end::double as band,
{table_sql("name", C.FX_HALF_SPREAD_PIPS, C.FX_DEFAULT_PIPS)} as fx, {table_sql("name", C.EQUITY_HALF_SPREAD_BP, C.EQUITY_DEFAULT_BP)} as eq, {table_sql("name", C.BORROW_A_YEAR, C.BORROW_DEFAULT)} as borrow,
case when m >= 570 and m < 600 then 2.5 when m >= 945 and m < 960 then 1.8 else 1 end::double as wide, greatest(0.0035 / value, 0.35 / 25000) as commission from m)
select event_id, market, name, round(1e6 * fx * band * pip, 6) as fx_spread, round(1e6 * 0.3 * pip, 6) as night, round(eq * wide, 6) as spread_bp, round(1e6 * borrow / 365, 6) as borrow,
round(1e6 * case market when 'crypto' then 0.0005 when 'fx' then fx * band * pip / value else eq * wide * 1e-4 + commission end, 6) as side_cost from b""",
)
def trade_costs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumns({"market": F.expr(cases("event_type", 0)), "name": F.expr(cases("event_type", 1))})
    ts, name, mills = F.col("ts"), F.col("name"), lambda c: F.round(1e6 * c, 6)
    return rows.select(
        "event_id", "market", "name", mills(C.fx_half_spread(name, ts)).alias("fx_spread"), mills(C.night_cost(name)).alias("night"),
        F.round(C.equity_half_spread_bp(ts, name), 6).alias("spread_bp"), mills(C.borrow_per_day(name)).alias("borrow"),
        mills(C.per_side_cost(F.col("market"), F.col("value"), ts, name, 0.0005)).alias("side_cost"),
    )


@query(
    "equity_costs",
    """with m as (select event_id, value, hour(ts) * 60 + minute(ts) as m from events)
select event_id, round(3.0::double * case when m >= 570 and m < 600 then 2.5 when m >= 945 and m < 960 then 1.8 else 1 end, 6) as spread_bp,
round(greatest(0.0035 / value, 0.35 / 25000), 10) as commission from m""",
)
def equity_costs(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.round(C.equity_half_spread_bp(F.col("ts")), 6).alias("spread_bp"), F.round(C.equity_commission(F.col("value")), 10).alias("commission"))


@query(
    "bet_sizes",
    """with p as (select event_id, (event_id % 99 + 1) / 100.0::double as p from events), """
    + f"""s as (select event_id, {C.bet_size("p")} as s from p) select event_id, round(s, 8) as size, round(least(greatest(round_even(s / 0.1, 0) * 0.1, -1), 1), 8) as stepped from s""",
)
def bet_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 99 + 1) / 100.0).alias("p")).withColumn("s", F.expr(C.bet_size("p")))
    return rows.select("event_id", F.round("s", 8).alias("size"), F.round(C.discretised(F.col("s"), 0.1), 8).alias("stepped"))


@query(
    "return_symbols",
    f"""{DOLLAR}, {RETURNS} select symbol, bar_idx, cast(ret > 0 as integer) as binary_code, cast(sign(ret) as integer) as ternary,
cast(ret >= -0.5 as integer) + cast(ret >= 0 as integer) + cast(ret >= 0.5 as integer) as binned from rets""",
)
def return_symbols(spark, sf_dir):
    code = C.encoded(F.col("ret"), [-0.5, 0.0, 0.5])
    rows = R.with_log_return(dollar_bars(spark, sf_dir))
    return rows.select("symbol", "bar_idx", code["binary"].alias("binary_code"), code["ternary"].alias("ternary"), code["binned"].alias("binned"))


@query(
    "running_drawdown",
    f"""{DOLLAR}, {RETURNS}, e as (select symbol, bar_idx, sum(ret) over w as equity, row_number() over w as i from rets window w as (partition by symbol order by bar_idx)),
d as (select *, greatest(max(equity) over (partition by symbol order by bar_idx), 0) - equity as dd from e)
select symbol, bar_idx, round(dd, 7) as drawdown, i - coalesce(max(case when dd <= 1e-12 then i end) over (partition by symbol order by bar_idx), 0) as time_under_water from d""",
)
def running_drawdown(spark, sf_dir):
    rows = R.with_log_return(dollar_bars(spark, sf_dir)).withColumnRenamed("ret", "pnl")
    out = R.running_drawdown(rows, ["symbol"], "bar_idx")
    return out.select("symbol", "bar_idx", F.round("drawdown", 7).alias("drawdown"), F.col("time_under_water").cast("bigint").alias("time_under_water"))


