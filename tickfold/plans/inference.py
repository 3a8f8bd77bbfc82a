"""Queries of tests of results, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal
from ..operators import inference as I
from ..operators import panel as P
from .corpus import CORPUS, PANEL, corpus, panel
from .market import DOLLAR, FOLD, TICKS, dollar_bars, rounded, ticks
from .registry import query

AHEAD = f"""{PANEL}, a as (select name, date, ret, x, lead(ret) over (partition by name order by date) as after from panel)"""


def ahead(spark, sf_dir):
    return panel(spark, sf_dir).withColumn("after", F.lead("ret").over(P.by_name()))


@query(
    "sign_test",
    f"""with {AHEAD}, n as (select name, count(*) as n, count(*) filter (ret > after) as above, count(*) filter (ret < after) as below from a where after is not null group by 1),
t as (select *, list_sum(list_transform(range(above, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2.0)))) as g,
  list_sum(list_transform(range(greatest(above, n - above), n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2.0)))) as f from n)
select name, n, above, below, round(case when n >= 4 then least(g, 1) end, 8) as p_greater, round(case when n >= 4 then least(2 * f, 1) end, 8) as p_two_sided from t""",
)
def sign_test(spark, sf_dir):
    return rounded(I.sign_test(ahead(spark, sf_dir), ["name"], "ret", "after"), p_greater=8, p_two_sided=8)


def student_sql(t: str) -> str:
    """Student's distribution by its series with gamma functions, for n - 1 degrees of freedom."""
    angle = f"atan({t} / sqrt(n - 1))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, (n - 1) // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos({angle}), 2 * j)))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, (n - 2) // 2), lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * pow(cos({angle}), 2 * j + 1))), 0))"
    return f"(case when n >= 3 then (1 + case when n % 2 = 1 then {even} else {odd} end) / 2 end)"


MARGIN = 0.01
LAGGED = " + ".join(f"2 * {1 - k / 4} * coalesce(sum(e * l{k}), 0)" for k in (1, 2, 3))


@query(
    "equivalence",
    f"""with {AHEAD}, d as (select name, date, after - ret as d from a where after is not null), m as (select *, d - avg(d) over (partition by name) as e from d),
l as (select *, {", ".join(f"lag(e, {k}) over (partition by name order by date) as l{k}" for k in (1, 2, 3))} from m),
s as (select name, count(*) as n, avg(d) as mean, sum(e * e) + {LAGGED} as v from l group by 1), t as (select name, n, mean, case when v > 0 then sqrt(v) / n end as se from s),
p as (select name, n, mean, 1 - {student_sql(f"((mean + {MARGIN}) / se)")} as lo, {student_sql(f"((mean - {MARGIN}) / se)")} as hi from t)
select name, n, round(mean, 9) as mean, round(lo, 7) as p_lower, round(hi, 7) as p_upper, round(greatest(lo, hi), 7) as p, coalesce(greatest(lo, hi) < 0.05, false) as equivalent from p""",
)
def equivalence(spark, sf_dir):
    return rounded(I.equivalence(ahead(spark, sf_dir), ["name"], "date", "ret", "after", MARGIN, 3), mean=9, p_lower=7, p_upper=7, p=7)


@query(
    "acceptance",
    f"""with {CORPUS}, daily as (select asset, strategy, date, cast(sum(pnl) as double) as x from corpus group by 1, 2, 3),
i as (select *, row_number() over (partition by asset, strategy order by date) - 1 as i, count(*) over (partition by asset, strategy) as k from daily),
c as (select *, x - avg(x) over (partition by asset, strategy) as d, least(i // 20, greatest(k // 20, 2) - 1) as w from i),
g as (select asset, strategy, count(*) as n, coalesce(avg(x) / nullif(stddev_samp(x), 0), 0) as sr, coalesce(avg(d*d*d) / nullif(pow(avg(d*d), 1.5), 0), 0) as skew, coalesce(avg(d*d*d*d) / nullif(pow(avg(d*d), 2), 0), 3) as kurt,
  coalesce(avg(x) filter (i < k // 2) / nullif(stddev_samp(x) filter (i < k // 2), 0), 0) as early, coalesce(avg(x) filter (i >= k // 2) / nullif(stddev_samp(x) filter (i >= k // 2), 0), 0) as late from c group by 1, 2),
p as (select asset, strategy, min(s) as worst, sum(s) as t, count(*) filter (s > 0) as gains from (select asset, strategy, w, sum(x) as s from c group by 1, 2, 3) group by 1, 2),
o as (select *, greatest(n // 20, 2) as windows, {normal.probabilistic_sharpe("sr", "0.02e0", "n", "skew", "kurt")} as dsr, case when worst < 0 then (t - worst) / -worst end as without_worst from g join p using (asset, strategy))
select asset, strategy, n, round(sr, 8) as sr, round(dsr, 7) as dsr, windows, cast(worst as bigint) as worst, round(without_worst, 7) as without_worst, gains, round(early, 8) as early, round(late, 8) as late,
sr > 0 and coalesce(dsr > 0.95, false) and coalesce(without_worst > 1, true) and gains >= 0.6 * windows and early > 0 and late > 0 as accepted from o""",
)
def acceptance(spark, sf_dir):
    daily = corpus(spark, sf_dir).groupBy("asset", "strategy", "date").agg(F.sum("pnl").cast("double").alias("x"))
    out = I.acceptance(daily, ["asset", "strategy"], "date", "x", 20, "0.02e0")
    return rounded(out.withColumn("worst", F.col("worst").cast("bigint")), sr=8, dsr=7, without_worst=7, early=8, late=8)


def swept(p: str, names: str, source: str) -> str:
    return ", ".join(f"{a}{b} - {''.join(sorted(a + p))} * {''.join(sorted(b + p))} / nullif({p}{p}, 0) as {a}{b}" for i, a in enumerate(names) for b in names[i:]) + f" from {source}"


@query(
    "interactions",
    f"""with {AHEAD}, r as (select name, after as y, x, ret as z, x * ret as w from a where after is not null),
m as (select name, count(*) as n, {", ".join(f"covar_pop({a}, {b}) as {a}{b}" for i, a in enumerate("wxyz") for b in "wxyz"[i:])} from r group by 1),
f as (select name, n, {swept("x", "wyz", "m")}), g as (select name, n, {swept("z", "wy", "f")})
select name, n, round(wy / nullif(ww, 0), 7) as slope, round(case when n > 4 and yy - wy * wy / nullif(ww, 0) > 1e-18 then wy / ww / sqrt((yy - wy * wy / ww) / ww / (n - 4)) end, 6) as t from g""",
)
def interactions(spark, sf_dir):
    return rounded(I.interactions(ahead(spark, sf_dir), ["name"], "after", "x", "ret"), slope=7, t=6)


@query(
    "subperiods",
    f"""with {AHEAD}, d as (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from (select distinct date from a)),
w as (select i as b, i // 26 as win from d where i % 26 = 0 and i + 52 <= n), r as (select win, after as y, x, ret as c from a join d using (date) join w on i >= b and i < b + 52 where after is not null),
m as (select win, count(*) as n, var_pop(x) as xx, var_pop(y) as yy, covar_pop(x, y) as xy, covar_pop(x, c) as xc, covar_pop(y, c) as yc, var_pop(c) as cc from r group by 1),
o as (select *, xx - xc * xc / cc as rx, yy - yc * yc / cc as ry, xy - xc * yc / cc as rxy from m)
select win as "window", n, round(1e3 * xy / xx, 8) as slope, round(xy / xx / sqrt((yy - xy * xy / xx) / xx / (n - 2)), 6) as t, round(rxy / rx / sqrt((ry - rxy * rxy / rx) / rx / (n - 3)), 6) as partial_t from o""",
)
def subperiods(spark, sf_dir):
    rows = I.subperiods(ahead(spark, sf_dir), 52, 26, "after", "x", "ret")
    return rows.select("window", "n", F.round(1e3 * F.col("slope"), 8).alias("slope"), F.round("t", 6).alias("t"), F.round("partial_t", 6).alias("partial_t"))


@query(
    "effective_names",
    f"""with {PANEL}, c as (select a.name, b.name, count(*) as n, corr(a.x, b.x) as r from panel a join panel b on a.date = b.date and a.name < b.name group by 1, 2),
n as (select count(distinct name) as n from panel) select n as names, round(n * n / (n + 2 * (select coalesce(sum(r * r), 0) from c where c.n >= 20 and isfinite(r))), 6) as effective from n""",
)
def effective_names(spark, sf_dir):
    return rounded(I.effective_names(panel(spark, sf_dir), 20), effective=6)


@query(
    "annual_bars",
    f"""{DOLLAR}, y as (select symbol, count(*) as n, greatest((max(t_close) - min(t_close)) / 1e6 / (365.25 * 86400), 1e-6) as years from bars group by 1)
select symbol, n, round(years, 9) as years, round(n / years, 4) as a_year from y""",
)
def annual_bars(spark, sf_dir):
    return rounded(I.annual_bars(dollar_bars(spark, sf_dir)), years=9, a_year=4)


def running(x: str) -> str:
    return f"cast((200 * cast(sum({x}) over (partition by symbol order by us, id) as hugeint)) // sum({x}) over (partition by symbol) as bigint)"


@query("bars_by_market", f"with {TICKS}, ids as (select *, case when symbol = 'click' then {running('1')} else {running('dollar')} end as bar_idx from ticks), {FOLD} select * from bars")
def bars_by_market(spark, sf_dir):
    return I.market_bars(ticks(spark, sf_dir), F.when(F.col("symbol") == "click", "fx").otherwise("crypto"), 200)


@query(
    "tilted_weights",
    f"""with {PANEL}, r as (select *, count(*) over (partition by date) as n, row_number() over (partition by date order by x, name) as low from panel),
k as (select *, greatest(least(floor(0.2 * n), floor(n / 2)), 1) as k from r), l as (select *, case when n >= 4 and n - low + 1 <= k then 1 when n >= 4 and low <= k then -1 end as leg from k),
u as (select *, greatest(1 + 0.0370370371::double * leg * (x - avg(x) over (partition by date, leg)), 0.1) as u from l)
select name, date, round(coalesce(leg * u / sum(u) over (partition by date, leg), 0), 8) as weight from u""",
)
def tilted_weights(spark, sf_dir):
    return rounded(P.long_short(panel(spark, sf_dir), 0.2, "x", 0.0370370371).select("name", "date", "weight"), weight=8)


@query("next_trend")
def next_trend(spark, sf_dir):
    return I.next_trend(dollar_bars(spark, sf_dir), 20)


@query("permutation_null")
def permutation_null(spark, sf_dir):
    return I.permutation_null(ahead(spark, sf_dir), "x", "after", 500, 7)


@query("stationary_bootstrap")
def stationary_bootstrap(spark, sf_dir):
    return I.stationary_bootstrap(panel(spark, sf_dir), ["name"], "date", "ret", 500, 7)
