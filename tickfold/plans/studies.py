"""Queries of further studies, with their SQL where there is one."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import normal
from ..operators import events as E
from ..operators import features as X
from ..operators import overfit as O
from ..operators import returns as R
from ..operators import rolling as W
from ..operators import studies as T
from .corpus import BLOCK_SUMS, CORPUS, MOMENTS, PANEL, corpus, panel
from .market import BETS, DOLLAR, RETURNS, dollar_bars, rounded, sample_bets, weighted
from .registry import query, table

AT = "window w as (partition by symbol order by bar_idx)"


@query(
    "bulk_buy_fraction",
    f"""{DOLLAR}, d as (select symbol, bar_idx, ln(close) - lag(ln(close)) over w as d from bars {AT}),
z as (select symbol, bar_idx, coalesce(d / nullif(case when count(d) over w >= 50 then stddev_samp(d) over w end, 0), 0) as z from d window w as (partition by symbol order by bar_idx rows 49 preceding))
select symbol, bar_idx, round({normal.cdf("z")}, 8) as bvc from z""",
)
def bulk_buy_fraction(spark, sf_dir):
    return rounded(T.bulk_buy_fraction(dollar_bars(spark, sf_dir)).select("symbol", "bar_idx", "bvc"), bvc=8)


@query(
    "next_labels",
    f"""{DOLLAR}, r as (select symbol, bar_idx, coalesce(ln(close) - lag(ln(close)) over w, 0) as r from bars {AT})
select symbol, bar_idx, cast(lead(r) over w > 0 as integer) as up, cast(abs(lead(r) over w) > case when count(r) over p >= 12 then avg(abs(r)) over p end as integer) as large,
round(case when count(r) over a = 5 then sum(abs(r)) over a end, 8) as fwd_vol from r
window w as (partition by symbol order by bar_idx), p as (partition by symbol order by bar_idx rows 11 preceding), a as (partition by symbol order by bar_idx rows between 1 following and 5 following)""",
)
def next_labels(spark, sf_dir):
    return rounded(T.next_labels(dollar_bars(spark, sf_dir), 5).select("symbol", "bar_idx", "up", "large", "fwd_vol"), fwd_vol=8)


@query(
    "factor_series",
    f"""{DOLLAR}, r as (select symbol, bar_idx, close / lag(close) over w - 1 as r from bars {AT}),
t as (select symbol, bar_idx, case when count(r) over w >= 21 then exp(sum(ln(1 + r)) over w) - 1 end as t, case when count(r) over w >= 21 then stddev_samp(r) over w end as s from r window w as (partition by symbol order by bar_idx rows 20 preceding))
select symbol, bar_idx, round(lag(t) over w, 7) as compounded, round(lag(s) over w, 7) as deviation from t {AT}""",
)
def factor_series(spark, sf_dir):
    return rounded(T.factor_series(dollar_bars(spark, sf_dir), 21).select("symbol", "bar_idx", "compounded", "deviation"), compounded=7, deviation=7)


@query(
    "ledger_cells",
    f"""with {CORPUS} select asset, strategy, count(*) as n, cast(sum(pnl) as bigint) as total, cast(sum(greatest(pnl, 0)) as bigint) as gains, cast(sum(greatest(-pnl, 0)) as bigint) as losses from corpus group by 1, 2""",
)
def ledger_cells(spark, sf_dir):
    return T.cells(corpus(spark, sf_dir), ["asset", "strategy"], "pnl")


@query(
    "spread_over_bars",
    f"""{BETS}, e as (select symbol, size / greatest(hold, 1) as part, unnest(range(start_idx, start_idx + greatest(hold, 1))) as bar_idx from bets) select symbol, bar_idx, round(sum(part), 8) as pnl from e group by 1, 2""",
)
def spread_over_bars(spark, sf_dir):
    trades = sample_bets(dollar_bars(spark, sf_dir)).withColumnRenamed("size", "pnl")
    return rounded(T.spread_over_bars(trades), pnl=8)


@query(
    "volatility_target",
    f"""{DOLLAR}, r as (select symbol, bar_idx, ln(close) - lag(ln(close)) over w as r from bars {AT}),
s as (select symbol, bar_idx, case when count(r) over w >= 30 then stddev_samp(r) over w end as s from r window w as (partition by symbol order by bar_idx rows 29 preceding)),
l as (select symbol, bar_idx, lag(s) over w as s from s {AT}) select symbol, bar_idx, round(case when s > 0 then least(0.5 / s, 5) else 0 end, 7) as leverage from l""",
)
def volatility_target(spark, sf_dir):
    return rounded(T.volatility_target(dollar_bars(spark, sf_dir), 30, 0.5).select("symbol", "bar_idx", "leverage"), leverage=7)


@query(
    "closest_pairs",
    f"""with {PANEL} select a.name, b.name as other, count(*) as n, round(corr(a.x, b.x), 9) as corr from panel a join panel b on a.date = b.date and a.name < b.name
group by 1, 2 having count(*) >= 100 order by abs(round(corr(a.x, b.x), 9)) desc, 1, 2 limit 20""",
)
def closest_pairs(spark, sf_dir):
    return T.closest_pairs(panel(spark, sf_dir), 100, 20)


K = 6
CHOSEN = ", ".join(f"({i}, [{', '.join(map(str, c))}])" for i, c in enumerate(combinations(range(K), 2)))


@query(
    "combinatorial_folds",
    f"""{DOLLAR}, e as (select symbol, bar_idx as ev_idx, bar_idx + 6 as end_idx, row_number() over (partition by symbol order by bar_idx) - 1 as i, count(*) over (partition by symbol) as n from bars),
o as (select *, least(i // greatest(n // {K}, 1), {K - 1}) as own from e), t as (select symbol, own as fold, min(ev_idx) as lo, max(end_idx) as hi from o group by 1, 2),
c as (select * from (values {CHOSEN}) v(split, folds)),
p as (select split, o.symbol, o.ev_idx, list_contains(folds, own) as is_test, exists (select 1 from t where t.symbol = o.symbol and list_contains(folds, fold) and end_idx >= lo and ev_idx <= hi + 1) as near from o, c)
select split, symbol, ev_idx, case when is_test then 'test' else 'train' end as part from p where is_test or not near""",
)
def combinatorial_folds(spark, sf_dir):
    i = F.col("bar_idx")
    spans = dollar_bars(spark, sf_dir).select("symbol", i.alias("ev_idx"), (i + 6).alias("end_idx"))
    return T.combinatorial_folds(spans, K, 2, 1)


@query(
    "rank_persistence",
    f"""{BLOCK_SUMS}, h as (select asset, strategy, cast(sum(case when block < 3 then s1 else 0 end) as double) as a, cast(sum(case when block >= 3 then s1 else 0 end) as double) as b from bs group by 1, 2),
r as (select asset, rank() over (partition by asset order by a) + (count(*) over (partition by asset, a) - 1) / 2.0 as ra, rank() over (partition by asset order by b) + (count(*) over (partition by asset, b) - 1) / 2.0 as rb from h)
select asset, count(*) as n, round(corr(ra, rb), 8) as spearman from r group by 1""",
)
def rank_persistence(spark, sf_dir):
    sums = O.block_sums(corpus(spark, sf_dir), 6)
    half = sums.groupBy("asset", "strategy").agg(F.sum(F.when(F.col("block") < 3, F.col("s1")).otherwise(0)).alias("a"), F.sum(F.when(F.col("block") >= 3, F.col("s1")).otherwise(0)).alias("b"))
    return rounded(T.rank_persistence(half, ["asset"], "a", "b"), spearman=8)


@query(
    "area_under_curve",
    f"""{DOLLAR}, l as (select symbol, bar_idx, volume as score, cast(lead(close) over w > close as integer) as y from bars {AT}),
r as (select symbol, y, rank() over (partition by symbol order by score) + (count(*) over (partition by symbol, score) - 1) / 2.0 as r from l where y is not null)
select symbol, cast(sum(y) as bigint) as positives, cast(sum(1 - y) as bigint) as negatives, round((sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 8) as auc from r group by 1""",
)
def area_under_curve(spark, sf_dir):
    bars = dollar_bars(spark, sf_dir)
    y = (F.lead("close").over(W.by_symbol()) > F.col("close")).cast("int")
    rows = bars.select("symbol", "bar_idx", F.col("volume").alias("score"), y.alias("y")).where("y is not null")
    return rounded(T.area_under_curve(rows, ["symbol"], "score", "y"), auc=8)


@query(
    "sign_rule",
    f"""{DOLLAR}, l as (select symbol, bar_idx, cast(volume as double) as x, lead(ln(close)) over w - ln(close) as y, case when bar_idx < 120 then 'train' else 'test' end as part from bars {AT}),
m as (select symbol, median(x) as m from l where part = 'train' and y is not null group by 1),
s as (select l.*, case when x > m then 1 else -1 end as s from l join m using (symbol) where y is not null),
a as (select symbol, coalesce(avg(case when part = 'train' and s = 1 then y end), 0) - coalesce(avg(case when part = 'train' and s = -1 then y end), 0) as d, avg(case when part = 'test' then s * y end) as g,
cast(sum(case when part = 'test' then 1 else 0 end) as bigint) as n_test from s group by 1) select symbol, cast(sign(d) as integer) as orientation, round(sign(d) * g, 7) as mean_pnl, n_test from a""",
)
def sign_rule(spark, sf_dir):
    y = F.lead(F.log("close")).over(W.by_symbol()) - F.log("close")
    part = F.when(F.col("bar_idx") < 120, "train").otherwise("test")
    rows = dollar_bars(spark, sf_dir).select("symbol", F.col("volume").cast("double").alias("x"), y.alias("y"), part.alias("part")).where("y is not null")
    return rounded(T.sign_rule(rows, ["symbol"], "x", "y"), mean_pnl=7)


@query(
    "penance",
    f"""{DOLLAR}, {RETURNS}, l as (select *, lag(ret) over (partition by symbol order by bar_idx) as l from rets), m as (select symbol, avg(ret) as mean, stddev_samp(ret) as sd, corr(ret, l) as phi from l group by 1)
select symbol, round(phi, 7) as phi, round((1 + phi) / (1 - phi), 7) as k, round(case when mean > 0 then pow(1.645 * sd, 2) / 4 / mean end, 3) as drawdown, round(case when mean > 0 then pow(1.645 * sd / mean, 2) end, 1) as under_water from m""",
)
def penance(spark, sf_dir):
    return rounded(T.penance(R.with_log_return(dollar_bars(spark, sf_dir))), phi=7, k=7, drawdown=3, under_water=1)


@query(
    "leak_screen",
    f"""with {PANEL}, l as (select *, lag(ret) over w as b, lead(ret) over w as a from panel window w as (partition by name order by date)),
d as (select date, count(*) as n, corr(x, b) as b, corr(x, ret) as s, corr(x, a) as a from l group by 1 having count(*) >= 8)
select count(*) as dates, round(avg(b), 8) as before, round(avg(s), 8) as same, round(avg(a), 8) as after from d""",
)
def leak_screen(spark, sf_dir):
    return rounded(T.leak_screen(panel(spark, sf_dir), "x"), before=8, same=8, after=8)


@query(
    "reversal",
    f"""with {PANEL}, r as (select *, count(*) over (partition by date) as n, row_number() over (partition by date order by x, name) as lo from panel),
h as (select date, name, ret, case when lo <= 2 then 0.5 when lo > n - 2 then -0.5 end as w from r where n >= 4 and (lo <= 2 or lo > n - 2)),
d as (select date, lead(date) over (order by date) as nx from (select distinct date from h)), o as (select nx as date, name, w as was from h join d using (date) where nx is not null),
b as (select coalesce(h.date, o.date) as date, coalesce(w * ret, 0) as g, abs(coalesce(w, 0) - coalesce(was, 0)) as t from h full join o on h.date = o.date and h.name = o.name)
select date, round(sum(g), 12) as gross, round(cast(sum(t) as double), 6) as turnover, round(sum(g) - 0.0012, 12) as net_flat, round(sum(g) - 0.0003 * sum(t), 12) as net_turnover from b group by 1""",
)
def reversal(spark, sf_dir):
    return rounded(T.reversal(panel(spark, sf_dir), 2, 0.0012, 0.0003), gross=12, turnover=6, net_flat=12, net_turnover=12)


@query(
    "spread_bars",
    f"""{DOLLAR}, a as (select * from bars where symbol = 'click'), b as (select * from bars where symbol = 'view')
select bar_idx, round(ln(a.open) - 0.7 * ln(b.open), 8) as open, round(ln(a.high) - 0.7 * ln(b.low), 8) as high, round(ln(a.low) - 0.7 * ln(b.high), 8) as low, round(ln(a.close) - 0.7 * ln(b.close), 8) as close from a join b using (bar_idx)""",
)
def spread_bars(spark, sf_dir):
    bars = dollar_bars(spark, sf_dir)
    rows = T.spread_bars(bars.where("symbol = 'click'"), bars.where("symbol = 'view'"), 0.7)
    return rounded(rows, open=8, high=8, low=8, close=8)


LAGS = range(1, 6)


@query(
    "hac_t",
    f"""{DOLLAR}, {RETURNS}, m as (select symbol, count(*) as n, avg(ret) as mean from rets group by 1), e as (select symbol, bar_idx, n, mean, ret - mean as e from rets join m using (symbol)),
l as (select *, {", ".join(f"e * lag(e, {k}) over w as l{k}" for k in LAGS)} from e {AT}),
v as (select symbol, n, mean, sum(e * e) + {" + ".join(f"2 * (1 - {k} / 6.0::double) * coalesce(sum(l{k}), 0)" for k in LAGS)} as v from l group by 1, 2, 3)
select symbol, n, round(mean, 9) as mean, round(case when v > 0 then mean * n / sqrt(v) end, 5) as t from v""",
)
def hac_t(spark, sf_dir):
    return rounded(T.hac_t(R.with_log_return(dollar_bars(spark, sf_dir)), ["symbol"], "bar_idx", "ret"), mean=9, t=5)


@query(
    "walk_windows",
    """with n as (select l_returnflag as asset, count(distinct cast(l_shipdate as date)) as n from lineitem group by 1), f as (select asset, unnest(range(0, (n - 252) // 126)) as fold from n)
select asset, cast(fold as integer) as fold, cast(fold * 126 as integer) as "from", cast(fold * 126 + 252 as integer) as split, cast(fold * 126 + 378 as integer) as "to" from f""",
)
def walk_windows(spark, sf_dir):
    days = corpus(spark, sf_dir).groupBy("asset").agg(F.count_distinct("date").alias("n"))
    return days.select("asset", F.explode(T.walk_windows(F.col("n"), 252, 126)).alias("w")).select("asset", "w.*")


@query(
    "market_of",
    "select s_suppkey, s_name, case when lower(s_name) like '%forex%' then null when regexp_matches(lower(s_name), '(usdt|usdc|busd|perp)$') then 'crypto' when regexp_matches(lower(s_name), '^[a-z]{6}$') then 'fx' else 'equity' end as market from supplier",
)
def market_of(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", T.market_of(F.col("s_name")).alias("market"))


@query("block_bootstrap")
def block_bootstrap(spark, sf_dir):
    return T.block_bootstrap(R.with_log_return(dollar_bars(spark, sf_dir)).select("symbol", "bar_idx", "ret"), ["symbol"], "bar_idx", "ret", 200, 10, 7)


@query("causal_structures")
def causal_structures(spark, sf_dir):
    return T.causal_structures(spark, 200, 500, 7)


@query("ou_mesh")
def ou_mesh(spark, sf_dir):
    return T.ou_mesh(spark, 0.9, 1.0, -1.0, [0.5, 1.0, 2.0, 4.0], [0.5, 1.0, 2.0, 4.0], 2000, 100, 7)


@query("forest_scores")
def forest_scores(spark, sf_dir):
    bars = dollar_bars(spark, sf_dir)
    at = W.by_symbol()
    i = F.col("bar_idx")
    rows = bars.select(
        "symbol", i.alias("ev_idx"), (i + 1).alias("end_idx"), F.col("volume").cast("double").alias("volume"), R.flow_imbalance(F.col("buy_dollar"), F.col("sell_dollar")).alias("ofi"),
        (F.log("close") - F.lag(F.log("close")).over(at)).alias("ret"), (F.lead("close").over(at) > F.col("close")).cast("double").alias("y"),
    ).dropna()
    folds = E.purged_folds(rows, 4, 2)
    own = folds.groupBy("symbol", "ev_idx").agg(F.max(F.when(F.col("part") == "test", F.col("fold"))).alias("fold"), F.collect_list(F.when(F.col("part") == "train", F.col("fold").cast("int"))).alias("trains"))
    scored = T.forest_scores(rows.join(own, ["symbol", "ev_idx"]), ["volume", "ofi", "ret"], "y", 4)
    return scored.select("symbol", "ev_idx", "fold", F.col("p").alias("score"), F.col("y").alias("label"))


@query(
    "price_z_entries",
    f"""{DOLLAR}, l as (select symbol, bar_idx, ln(close) as c from bars), {weighted("l", "c", 50, "")},
z as (select symbol, bar_idx, case when s > 0 then (c - m) / s else 0 end as z from l join e using (symbol, bar_idx)), b as (select *, coalesce(abs(lag(z) over (partition by symbol order by bar_idx)), 0) as b from z)
select symbol, bar_idx, round(z, 6) as z, cast(-sign(z) as integer) as side from b where abs(z) >= 1.5 and b < 1.5""",
)
def price_z_entries(spark, sf_dir):
    return rounded(X.fresh_extremes(dollar_bars(spark, sf_dir), 50, 1.5).select("symbol", "bar_idx", "z", "side"), z=6)


FEATURE_LAGS = (3, 5, 6, 10, 12, 20)
FEATURES_SQL = f"""{DOLLAR}, a as (select *, coalesce(ln(close) - lag(ln(close)) over (partition by symbol order by bar_idx), 0) as r from bars),
x as (select *, greatest(r, 0) as up, greatest(-r, 0) as dn, ln(high) - ln(low) as hl from a),
{", ".join(weighted("x", column, span, tag) for column, span, tag in (("close", 10, "_f"), ("close", 50, "_s"), ("r", 50, "_v"), ("r", 200, "_l"), ("up", 27, "_u"), ("dn", 27, "_d"), ("hl", 50, "_h")))}
select x.symbol, x.bar_idx, cast(sign(e_f.m - e_s.m) as integer) as side, round(ln(e_f.m / e_s.m), 7) as gap, round(e_v.s, 7) as vol,
round(case when e_l.s > 0 then e_v.s / e_l.s else 1 end, 6) as vol_ratio,
{", ".join(f"round(ln(close) - lag(ln(close), {k}) over w, 7) as momentum_{k}" for k in FEATURE_LAGS)},
round(case when e_u.m + e_d.m > 0 then (e_u.m - e_d.m) / (e_u.m + e_d.m) else 0 end, 6) as strength,
round(case when buy_dollar + sell_dollar > 0 then (buy_dollar - sell_dollar) / (buy_dollar + sell_dollar)::double else 0 end, 7) as ofi, round(e_h.m, 7) as "range"
from x {" ".join(f"join e{t} on e{t}.symbol = x.symbol and e{t}.bar_idx = x.bar_idx" for t in ("_f", "_s", "_v", "_l", "_u", "_d", "_h"))} window w as (partition by x.symbol order by x.bar_idx)"""


@query("event_features", FEATURES_SQL)
def event_features(spark, sf_dir):
    found = X.event_features(dollar_bars(spark, sf_dir), lags=FEATURE_LAGS)
    places = {"vol_ratio": 6, "strength": 6}
    return rounded(found, **{c: places.get(c, 7) for c in found.columns if c not in ("symbol", "bar_idx", "side")})


@query("regimes")
def regimes(spark, sf_dir):
    return X.regimes(R.with_log_return(dollar_bars(spark, sf_dir)), 20)


@query("forest_importance")
def forest_importance(spark, sf_dir):
    rows = X.event_features(dollar_bars(spark, sf_dir))
    label = (F.lead("gap").over(W.by_symbol()) > F.col("gap")).cast("double")
    return X.forest_importance(rows.withColumn("y", label), ["gap", "vol", "vol_ratio", "momentum_3", "strength", "ofi", "range"], "y")


@query(
    "backtest_lengths",
    f"""{MOMENTS} select asset, count(*) as trials, round(pow({normal.expected_max("1e0", "cast(count(*) as double)")} / 0.05, 2), 2) as min_days from mom group by 1""",
)
def backtest_lengths(spark, sf_dir):
    """Days below which the best of so many worthless strategies is expected to show a daily ratio of 0.05."""
    trials = corpus(spark, sf_dir).groupBy("asset").agg(F.count_distinct("strategy").alias("trials"))
    days = F.pow(F.expr(normal.expected_max("1e0", "cast(trials as double)")) / 0.05, 2)
    return trials.withColumn("min_days", F.round(days, 2))
