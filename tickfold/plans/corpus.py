"""Queries over a corpus of strategies' results and over panels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal
from ..operators import overfit as O
from ..operators import panel as P
from ..sources.ticks import pnl_corpus
from .market import rounded
from .registry import query, table

CORPUS = """corpus as (select l_returnflag as asset, l_suppkey as strategy, cast(l_shipdate as date) as date,
  cast(round(l_extendedprice * 100) as bigint) * (cast(round(l_discount * 100) as bigint) - 5) as pnl from lineitem)"""
MOMENTS = f"""with {CORPUS}, daily as (select asset, strategy, date, cast(sum(pnl) as double) as x from corpus group by 1, 2, 3),
days as (select asset, cast(count(distinct date) as double) as t from corpus group by 1),
s as (select asset, strategy, count(*) as active, sum(x) as s1, sum(x*x) as s2, sum(x*x*x) as s3, sum(x*x*x*x) as s4 from daily group by 1, 2),
u as (select asset, strategy, active, t, s1/t as m, s2/t - pow(s1/t, 2) as v, s3/t - 3*(s1/t)*(s2/t) + 2*pow(s1/t, 3) as c3,
  s4/t - 4*(s1/t)*(s3/t) + 6*pow(s1/t, 2)*(s2/t) - 3*pow(s1/t, 4) as c4 from s join days using (asset)),
mom as (select asset, strategy, active, cast(t as bigint) as days, m as mean, sqrt(v*t/(t-1)) as sd, m / sqrt(v*t/(t-1)) as sr, c3 / pow(v, 1.5) as skew, c4 / (v*v) as kurtosis from u)"""
DEFLATED = f"""{MOMENTS}, tr as (select asset, cast(count(*) as double) as trials, var_samp(sr) as sr_variance from mom group by 1),
d as (select *, {normal.expected_max("sr_variance", "trials")} as best_by_chance from mom join tr using (asset)),
e as (select *, {normal.probabilistic_sharpe("sr", "0e0", "days", "skew", "kurtosis")} as psr, {normal.probabilistic_sharpe("sr", "best_by_chance", "days", "skew", "kurtosis")} as dsr from d)"""


def corpus(spark, sf_dir):
    return pnl_corpus(table(spark, sf_dir, "lineitem"))


@query("corpus_sharpe", f"{MOMENTS} select asset, strategy, active, days, round(mean, 2) as mean, round(sr, 8) as sr, round(skew, 5) as skew, round(kurtosis, 4) as kurtosis from mom")
def corpus_sharpe(spark, sf_dir):
    rows = O.corpus_moments(corpus(spark, sf_dir)).drop("sd")
    return rounded(rows, mean=2, sr=8, skew=5, kurtosis=4)


@query(
    "deflated_sharpe",
    f"{DEFLATED} select asset, strategy, cast(trials as bigint) as trials, round(best_by_chance, 7) as best_by_chance, round(psr, 6) as psr, round(dsr, 6) as dsr from e",
)
def deflated_sharpe(spark, sf_dir):
    rows = O.deflated(O.corpus_moments(corpus(spark, sf_dir)))
    return rows.select(
        "asset", "strategy", F.col("trials").cast("bigint").alias("trials"), F.round("best_by_chance", 7).alias("best_by_chance"), F.round("psr", 6).alias("psr"), F.round("dsr", 6).alias("dsr")
    )


@query(
    "track_lengths",
    f"""{MOMENTS} select asset, strategy, round(case when sr > 0 then 1 + (1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) * pow({normal.inverse(normal.number(0.95))} / sr, 2) end, 2) as min_trl from mom""",
)
def track_lengths(spark, sf_dir):
    rows = O.track_lengths(O.corpus_moments(corpus(spark, sf_dir)))
    return rows.select("asset", "strategy", F.round(F.when(F.col("min_trl") < float("inf"), F.col("min_trl")), 2).alias("min_trl"))


BLOCKS = 6
BLOCK_SUMS = f"""with {CORPUS}, dd as (select asset, date, row_number() over (partition by asset order by date) - 1 as i, count(*) over (partition by asset) // {BLOCKS} as k
  from (select distinct asset, date from corpus)),
b as (select asset, date, i // k as block, k as n from dd where i < k * {BLOCKS}),
daily as (select asset, strategy, date, cast(sum(pnl) as double) as x from corpus group by 1, 2, 3),
bs as (select asset, strategy, block, n, sum(x) as s1, sum(x*x) as s2 from daily join b using (asset, date) group by 1, 2, 3, 4)"""
MASKS = f"masks as (select m from range(0, {1 << BLOCKS}) t(m) where bit_count(m) = {BLOCKS // 2})"
OVERFIT = f"""{BLOCK_SUMS}, {MASKS}, si as (select asset, m, strategy, (m >> cast(block as integer)) & 1 as inside, sum(s1) as s1, sum(s2) as s2, max(n) * {BLOCKS // 2} as t from bs, masks group by 1, 2, 3, 4),
sr as (select asset, m, strategy, inside, round(case when (s2 - s1*s1/t)/(t-1) > 0 then s1/t/sqrt((s2 - s1*s1/t)/(t-1)) else 0 end, 12) as sr from si),
wide as (select asset, m, strategy, coalesce(max(case when inside = 1 then sr end), 0) as i, coalesce(max(case when inside = 0 then sr end), 0) as o from sr group by 1, 2, 3),
best as (select asset, m, strategy as best, o as bo, n from (select *, row_number() over (partition by asset, m order by i desc, strategy) as r, count(*) over (partition by asset, m) as n from wide) where r = 1),
rk as (select asset, m, best, n, sum(case when o < bo then 1 else 0 end) + (sum(case when o = bo then 1 else 0 end) + 1) / 2.0 as rank from wide join best using (asset, m) group by 1, 2, 3, 4),
lg as (select asset, best, rank / (n + 1) as rank, ln(rank / (n + 1) / (1 - rank / (n + 1))) as logit from rk)"""


@query("block_sums", f"{BLOCK_SUMS} select asset, strategy, block, n, cast(s1 as bigint) as s1 from bs")
def block_sums(spark, sf_dir):
    return O.block_sums(corpus(spark, sf_dir), BLOCKS).select("asset", "strategy", "block", "n", F.col("s1").cast("bigint").alias("s1"))


@query("overfit_splits", f"{OVERFIT} select asset, best, round(rank, 8) as rank, round(logit, 6) as logit from lg")
def overfit_splits(spark, sf_dir):
    return rounded(O.overfitting(corpus(spark, sf_dir), BLOCKS).select("asset", "best", "rank", "logit"), rank=8, logit=6)


@query("pbo", f"{OVERFIT} select asset, count(*) as splits, round(avg(case when logit <= 0 then 1.0 else 0.0 end), 8) as pbo from lg group by 1")
def pbo(spark, sf_dir):
    return rounded(O.pbo(corpus(spark, sf_dir), BLOCKS), pbo=8)


@query(
    "effective_strategies",
    f"""{MOMENTS}, g as (select a.asset, date, strategy from (select distinct asset, date from corpus) a join (select distinct asset, strategy from corpus) b using (asset)),
f as (select g.asset, g.date, g.strategy, coalesce(x, 0) as x from g left join daily using (asset, date, strategy)),
p as (select a.asset, a.strategy as i, b.strategy as j, corr(a.x, b.x) as r from f a join f b on a.asset = b.asset and a.date = b.date and a.strategy < b.strategy group by 1, 2, 3),
n as (select asset, count(*) as n from mom group by 1)
select asset, n as strategies, round(n * n / (n + 2 * sum(r * r)), 5) as effective from p join n using (asset) group by 1, 2""",
)
def effective_strategies(spark, sf_dir):
    return rounded(O.effective_strategies(corpus(spark, sf_dir)), effective=5)


def weekly_corpus(spark, sf_dir):
    return corpus(spark, sf_dir).withColumn("date", F.expr("datediff(date, date'1990-01-01') div 7"))


WEEKLY = MOMENTS.replace("cast(l_shipdate as date) as date", "(cast(l_shipdate as date) - date '1990-01-01') // 7 as date")


@query(
    "strategy_gram",
    f"""{WEEKLY}, dy as (select asset, date, row_number() over (partition by asset order by date) - 1 as i from (select distinct asset, date from corpus)),
z as (select dy.asset, dy.i, mom.strategy, (coalesce(x, 0) - mean) / sd as z from dy join mom using (asset) left join daily d on d.asset = dy.asset and d.date = dy.date and d.strategy = mom.strategy where sd > 0)
select a.asset, a.i, b.i as j, round(sum(a.z * b.z), 6) as g from z a join z b on a.asset = b.asset and a.strategy = b.strategy and a.i <= b.i group by 1, 2, 3""",
)
def strategy_gram(spark, sf_dir):
    """Products of weeks over standardised strategies."""
    return rounded(O.gram_matrix(weekly_corpus(spark, sf_dir)), g=6)


@query("strategy_spectrum")
def strategy_spectrum(spark, sf_dir):
    """Independent strategies by the spectrum of weekly results."""
    return rounded(O.spectrum(weekly_corpus(spark, sf_dir)), participation=6, entropy_number=6, top_share=8)


@query(
    "profit_factor",
    f"""with {CORPUS}, daily as (select asset, strategy, date, cast(sum(pnl) as double) as x from corpus group by 1, 2, 3)
select asset, strategy, count(*) as active, cast(sum(greatest(x, 0)) as bigint) as gains, cast(sum(greatest(-x, 0)) as bigint) as losses,
round(sum(greatest(x, 0)) / nullif(sum(greatest(-x, 0)), 0), 8) as profit_factor from daily group by 1, 2""",
)
def profit_factor(spark, sf_dir):
    rows = O.profit_factor(corpus(spark, sf_dir))
    return rows.select("asset", "strategy", "active", F.col("gains").cast("bigint").alias("gains"), F.col("losses").cast("bigint").alias("losses"), F.round(F.when(F.col("losses") > 0, F.col("profit_factor")), 8).alias("profit_factor"))


@query(
    "concentration",
    f"""with {CORPUS}, t as (select asset, strategy, cast(sum(abs(pnl)) as double) as x from corpus group by 1, 2), r as (select *, row_number() over (partition by asset order by x, strategy) as i from t)
select asset, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 8) as gini, round(sum(x*x) / pow(sum(x), 2), 8) as herfindahl, round(pow(sum(x), 2) / sum(x*x), 5) as effective from r group by 1""",
)
def concentration(spark, sf_dir):
    return rounded(O.concentration(corpus(spark, sf_dir)), gini=8, herfindahl=8, effective=5)


PANEL = """panel as (select cast(l_suppkey as bigint) as name, epoch_us(l_shipdate) // 604800000000 as date,
  cast(sum(cast(round(l_extendedprice * 100) as bigint) * (cast(round(l_discount * 100) as bigint) - 5)) as double) / 1e9 as ret,
  cast(sum(l_quantity) as double) as x from lineitem group by 1, 2)"""


def panel(spark, sf_dir):
    """Weekly results and quantities of each supplier."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint") * (F.round(F.col("l_discount") * 100).cast("bigint") - 5)
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate)")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("name"), F.floor(us / 604_800_000_000).alias("date"), cents.alias("c"), "l_quantity")
    return rows.groupBy("name", "date").agg((F.sum("c").cast("double") / 1e9).alias("ret"), F.sum("l_quantity").alias("x"))


@query(
    "cross_section",
    f"""with {PANEL} select name, date, round(case when count(*) over d > 1 then 2.0 * (row_number() over (partition by date order by x, name) - 1) / (count(*) over d - 1) - 1 else 0 end, 8) as rank,
round(coalesce(greatest(least(case when stddev_pop(x) over d > 0 then (x - avg(x) over d) / stddev_pop(x) over d end, 5), -5), 0), 6) as z from panel window d as (partition by date)""",
)
def cross_section(spark, sf_dir):
    return rounded(P.normalised(panel(spark, sf_dir)).select("name", "date", "rank", "z"), rank=8, z=6)


@query(
    "forward_rank",
    f"""with {PANEL}, s as (select name, date, case when count(ret) over w = 4 then round(sum(ret) over w, 9) end as s from panel window w as (partition by name order by date rows between 1 following and 4 following))
select name, date, round(case when count(*) over (partition by date) >= 4 then 2.0 * (row_number() over (partition by date order by s, name) - 1) / (count(*) over (partition by date) - 1) - 1 end, 8) as label from s where s is not null""",
)
def forward_rank(spark, sf_dir):
    return rounded(P.forward_rank(panel(spark, sf_dir), 4).select("name", "date", "label"), label=8)


LONG_SHORT = f"""with {PANEL}, r as (select *, count(*) over (partition by date) as n, row_number() over (partition by date order by x, name) as low from panel),
k as (select *, greatest(least(floor(0.2 * n), floor(n / 2)), 1) as k, n - low + 1 as high from r),
w as (select name, date, ret, case when n >= 4 and high <= k then 1 / k when n >= 4 and low <= k then -1 / k else 0 end as weight from k)"""


@query("long_short", f"{LONG_SHORT} select name, date, round(weight, 8) as weight from w")
def long_short(spark, sf_dir):
    return rounded(P.long_short(panel(spark, sf_dir), 0.2, "x").select("name", "date", "weight"), weight=8)


@query(
    "rotation",
    f"""{LONG_SHORT}, i as (select date, row_number() over (order by date) - 1 as i from (select distinct date from w)),
h as (select name, date, ret, coalesce(last_value(case when i % 4 = 0 then weight end ignore nulls) over (partition by name order by date), 0) as h from w join i using (date)),
b as (select *, coalesce(lag(h) over (partition by name order by date), 0) as b from h)
select date, round(sum(abs(h - b)), 6) as turnover, round(sum(b * ret) - 0.0007 * sum(abs(h - b)), 14) as pnl from b group by 1""",
)
def rotation(spark, sf_dir):
    return rounded(P.rotation(P.long_short(panel(spark, sf_dir), 0.2, "x"), 4, 0.0007), turnover=6, pnl=14)


@query("mean_of_others", f"with {PANEL} select name, date, round((sum(x) over d - x) / nullif(count(*) over d - 1, 0), 9) as others from panel window d as (partition by date)")
def mean_of_others(spark, sf_dir):
    return rounded(P.mean_of_others(panel(spark, sf_dir), "x").select("name", "date", "others"), others=9)


@query(
    "factor_slopes",
    f"""with {PANEL}, c as (select *, (sum(ret) over d - ret) / nullif(count(*) over d - 1, 0) as c from panel window d as (partition by date)),
m as (select name, count(*) as n, var_pop(x) as xx, var_pop(ret) as yy, covar_pop(x, ret) as xy, covar_pop(x, c) as xc, covar_pop(ret, c) as yc, var_pop(c) as cc from c where c is not null group by 1),
r as (select *, xx - xc*xc/cc as rxx, yy - yc*yc/cc as ryy, xy - xc*yc/cc as rxy from m)
select name, n, round(1e3 * xy / xx, 7) as slope, round(xy / xx / sqrt((yy - xy*xy/xx) / xx / (n - 2)), 5) as t, round(1e3 * rxy / rxx, 7) as partial_slope,
round(rxy / rxx / sqrt((ryy - rxy*rxy/rxx) / rxx / (n - 3)), 5) as partial_t, round(xy*xy/(xx*yy), 7) as r2 from r""",
)
def factor_slopes(spark, sf_dir):
    rows = P.slopes(P.mean_of_others(panel(spark, sf_dir), "ret"), ["name"], "ret", "x", "others")
    rows = rows.withColumns({"slope": 1e3 * F.col("slope"), "partial_slope": 1e3 * F.col("partial_slope")})
    return rounded(rows, slope=7, t=5, partial_slope=7, partial_t=5, r2=7)


@query(
    "clustered_t",
    f"""with {PANEL}, m as (select count(*) as n, avg(x) as mx, avg(ret) as my, var_pop(x) as xx, covar_pop(x, ret) as xy from panel),
s as (select date, sum((x - mx) * (ret - my - xy / xx * (x - mx))) as s from panel, m group by 1),
g as (select count(*) as g, sum(s * s) as q from s)
select n, g as clusters, round(1e3 * xy / xx, 8) as slope, round(xy / xx / (sqrt(q * (g / (g - 1.0)) * ((n - 1.0) / (n - 2))) / (n * xx)), 6) as t from m, g""",
)
def clustered_t(spark, sf_dir):
    rows = P.clustered_t(panel(spark, sf_dir), "ret", "x", "date").withColumn("slope", 1e3 * F.col("slope"))
    return rounded(rows, slope=8, t=6)


@query(
    "fixed_effect_slopes",
    f"""with {PANEL}, d as (select name, x - avg(x) over (partition by date) as x, ret - avg(ret) over (partition by date) as y from panel)
select name, count(*) as n, round(1e3 * covar_pop(x, y) / var_pop(x), 7) as slope from d group by 1""",
)
def fixed_effect_slopes(spark, sf_dir):
    rows = P.within_date(panel(spark, sf_dir), "x", "ret")
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.round(1e3 * F.covar_pop("x", "ret") / F.var_pop("x"), 7).alias("slope"))


@query(
    "false_discovery",
    f"""{DEFLATED}, p as (select asset, strategy, 1 - psr as p from e), r as (select *, round(p, 9) * count(*) over (partition by asset) / row_number() over (partition by asset order by round(p, 9), strategy) as a,
round(p, 9) as q from p) select asset, strategy as name, round(least(min(a) over (partition by asset order by q, strategy rows between current row and unbounded following), 1), 6) as p_adjusted from r""",
)
def false_discovery(spark, sf_dir):
    rows = O.deflated(O.corpus_moments(corpus(spark, sf_dir))).select("asset", F.col("strategy").alias("name"), F.round(1 - F.col("psr"), 9).alias("p"))
    return rounded(P.benjamini_hochberg(rows, ["asset"]).select("asset", "name", "p_adjusted"), p_adjusted=6)


@query(
    "event_study",
    f"""with {CORPUS}, daily as (select cast(strategy as bigint) as name, date_diff('day', date '1970-01-01', date) as day, cast(sum(pnl) as double) / 1e9 as ret from corpus group by 1, 2),
o as (select name, day, ret - (sum(ret) over d - ret) / nullif(count(*) over d - 1, 0) as ab from daily window d as (partition by day)),
ev as (select name, min(day) + 100 as event_day from daily group by 1),
m as (select day - event_day as "at", count(*) as n, avg(ab) as mean from ev join o using (name) where day - event_day between -30 and 30 and ab is not null group by 1)
select cast("at" as integer) as "at", n, round(mean, 11) as mean, round(sum(mean) over (order by "at"), 11) as car from m""",
)
def event_study(spark, sf_dir):
    days = corpus(spark, sf_dir).select(F.col("strategy").alias("name"), F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"), "pnl")
    daily = days.groupBy("name", "day").agg((F.sum("pnl").cast("double") / 1e9).alias("ret"))
    events = daily.groupBy("name").agg((F.min("day") + 100).alias("event_day"))
    return rounded(P.event_study(events, daily, 30, 30), mean=11, car=11)


@query(
    "as_of_price",
    """with l as (select user_id, ts, event_id from events where event_type = 'click'), r as (select user_id, ts, value as price from events where event_type = 'view')
select event_id, price from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts""",
)
def as_of_price(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'click'").select("user_id", "event_id", "ts")
    right = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("since"), F.col("value").alias("price"))
    return P.as_of(left, right, ["user_id"], "ts", "since", ["price"]).select("event_id", "price")


@query(
    "interval_gate",
    """with s as (select o_custkey, min(o_orderdate) as a, max(o_orderdate) as b from orders where o_orderstatus = 'F' group by 1)
select o_orderkey, (a is null or o_orderdate >= a) and (b is null or o_orderdate <= b) as valid from orders left join s using (o_custkey)""",
)
def interval_gate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    spans = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return P.interval_gate(orders, spans, ["o_custkey"], "o_orderdate", "a", "b").select("o_orderkey", "valid")
