"""Queries of factors beside confounders, event windows, corpora by asset and runs' ledgers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal as A
from ..operators.lineage import shared_path
from ..operators.studies import write_ledger
from ..sources import ledgers as G
from .corpus import CORPUS, PANEL, corpus, panel
from .market import rounded
from .registry import query, table

MARKETS, LONG, SHORT, SPAN, LEAST = 3, 8, 3, 6, 40

FACTORS = f"""{PANEL}, p as (select name, date, ret, name % {MARKETS} as market from panel), dy as (select market, date, avg(ret) as c, stddev_samp(ret) as sd from p group by 1, 2),
dd as (select *, case when count(sd) over w = {SPAN} then avg(sd) over w end as d from dy window w as (partition by market order by date rows between {SPAN} preceding and 1 preceding)),
f as (select p.*, c, d, case when count(*) over lw = {LONG} then exp(sum(ln(1 + ret)) over lw) - 1 end as momentum, case when count(*) over lw = {LONG} then stddev_samp(ret) over lw end as vol,
  case when count(*) over sw = {SHORT} then exp(sum(ln(1 + ret)) over sw) - 1 end as reversal from p join dd using (market, date)
  window lw as (partition by name order by date rows between {LONG} preceding and 1 preceding), sw as (partition by name order by date rows between {SHORT} preceding and 1 preceding)),
r as (select market, factor, name, date, ret as y, x, c, d from f unpivot (x for factor in (momentum, vol, reversal)) where d is not null and c is not null),
k as (select *, count(*) over (partition by market, factor, name) as own from r)"""


def factor_rows(spark, sf_dir):
    rows = A.with_confounders(panel(spark, sf_dir).withColumn("market", F.col("name") % MARKETS), ["market"], SPAN)
    made = {"momentum": A.compounded(LONG), "vol": A.deviation(LONG), "reversal": A.compounded(SHORT)}
    each = rows.withColumns({f"_{k}": v for k, v in made.items()})
    each = each.withColumn("_f", F.explode(F.array(*(F.struct(F.lit(k).alias("factor"), F.col(f"_{k}").alias("x")) for k in made))))
    return each.select("market", "_f.factor", "name", "date", F.col("ret").alias("y"), "_f.x", F.col("driver").alias("c"), F.col("regime").alias("d"))


def factor_sql() -> str:
    sums = ", ".join(f"covar_pop({a}, {b}) * count(*) as {a}{b}" for i, a in enumerate("cdxy") for b in "cdxy"[i:])
    sweep = lambda by, names: ", ".join(f"{a}{b} - {''.join(sorted(a + by))} * {''.join(sorted(b + by))} / {by}{by} as {a}{b}" for i, a in enumerate(names) for b in names[i:])
    fit = lambda table, used: f"select market, factor, xy / xx * s as slope, xy / xx / sqrt((yy - xy * xy / xx) / xx / (n - {used})) as t from {table}"
    return f"""with {FACTORS}, kk as (select * from k where own >= {LEAST}), m as (select market, factor, count(*) as n, count(distinct name) as names, stddev_samp(x) as s, {sums} from kk group by 1, 2),
mc as (select market, factor, n, s, {sweep("c", "dxy")} from m), md as (select market, factor, n, s, {sweep("d", "xy")} from m), mb as (select market, factor, n, s, {sweep("d", "xy")} from mc),
a as ({fit("m", 2)}), b as ({fit("mc", 3)}), g as ({fit("md", 3)}), h as ({fit("mb", 4)}),
o as (select market, factor, name, covar_pop(x, y) as v from kk group by 1, 2, 3), sg as (select market, factor, avg(cast(sign(o.v) = case when m.xy >= 0 then 1 else -1 end as integer)) as sc from o join m using (market, factor) group by 1, 2),
l as (select market, factor, date, avg(sign(x) * y) as r from kk group by 1, 2, 3), ls as (select market, factor, avg(r) / stddev_samp(r) as ratio, count(*) as dates from l group by 1, 2)
select market, factor, n, names, round(a.slope, 10) as naive_slope, round(a.t, 6) as naive_t, round(b.slope, 10) as driver_slope, round(b.t, 6) as driver_t, round(g.slope, 10) as regime_slope, round(g.t, 6) as regime_t,
round(h.slope, 10) as both_slope, round(h.t, 6) as both_t, round(sc, 8) as sign_consistency,
case when abs(a.t) > 1.96 and abs(b.t) <= 1.96 then 'spurious_killed' when abs(b.t) > 1.96 and abs(a.t) <= 1.96 then 'suppression_revealed' else 'none' end as flip,
round((abs(a.t) - abs(b.t)) / (abs(a.t) + 1e-12), 5) as attenuation, round(ratio, 7) as ratio, dates
from m join a using (market, factor) join b using (market, factor) join g using (market, factor) join h using (market, factor) join sg using (market, factor) join ls using (market, factor)"""


@query("factor_panel_test", factor_sql())
def factor_panel_test(spark, sf_dir):
    """Whether three factors' slopes outlive the common driver and the volatility regime."""
    found = A.factor_panel_test(factor_rows(spark, sf_dir), ["market", "factor"], LEAST)
    slopes = {f"{k}_slope": 10 for k in ("naive", "driver", "regime", "both")} | {f"{k}_t": 6 for k in ("naive", "driver", "regime", "both")}
    return rounded(found, **slopes, sign_consistency=8, attenuation=5, ratio=7)


# Every tenth name is a control; the others have an event in a week of their own.
WIDTH, LEAST_SIDE, LAG, SEED = 60, 20, 5, 5

WINDOWS = f"""{PANEL}, d as (select name, date as day, ret, row_number() over (partition by name order by date) as i, count(*) over (partition by name) as n from panel),
ev as (select name as event, name, min(date) + 120 + name % 50 as day from panel where name % 10 <> 0 group by name),
ct as (select distinct name from panel where name % 10 = 0), pk as (select event, ct.name, day from ev, ct qualify row_number() over (partition by event order by md5('{SEED}:' || event || ':' || ct.name), ct.name) = 1),
al as (select 'treated' as grp, * from ev union all select 'control', * from pk),
ax as (select grp, event, al.name, al.day, count(*) filter (d.day < al.day) as b, any_value(n) as n from al join d using (name) group by all),
w as (select grp, event, case when d.i <= b then 'pre' else 'post' end as side, d.name, d.day, d.ret from ax join d using (name) where b >= {LEAST_SIDE} and ax.n - b >= {LEAST_SIDE} and d.i > b - {WIDTH} and d.i <= b + {WIDTH})"""


def windows(spark, sf_dir):
    daily = panel(spark, sf_dir).select("name", F.col("date").alias("day"), "ret")
    events = daily.where("name % 10 <> 0").groupBy("name").agg((F.min("day") + 120 + F.col("name") % 50).alias("day"))
    events = events.select(F.col("name").alias("event"), "name", "day")
    controls = A.matched_controls(events, daily.where("name % 10 = 0").select("name").distinct(), SEED)
    parts = [A.event_windows(e, daily, WIDTH, LEAST_SIDE).withColumn("grp", F.lit(g)) for g, e in (("treated", events), ("control", controls))]
    return parts[0].unionByName(parts[1])


@query("event_windows", f"with {WINDOWS} select grp, event, side, name, day, round(ret, 10) as ret from w")
def event_windows(spark, sf_dir):
    """Rows around events and around the same dates of matched controls."""
    return rounded(windows(spark, sf_dir).select("grp", "event", "side", "name", "day", "ret"), ret=10)


@query(
    "event_discontinuity",
    f"""with {WINDOWS}, x as (select *, case when count(*) over q = {LAG} then exp(sum(ln(1 + ret)) over q) - 1 end as f from w window q as (partition by grp, event, side order by day rows between {LAG} preceding and 1 preceding)),
z as (select grp, event, side, ret as y, (f - avg(f) over e) / stddev_samp(f) over e as x, count(*) over e as n, stddev_samp(f) over e as s from x where f is not null window e as (partition by grp, event, side)),
m as (select grp, side, count(*) as n, regr_slope(y, x) as b, regr_sxx(y, x) as xx, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) as rest from z where n >= 8 and s > 0 group by 1, 2)
select a.grp, a.n as n_pre, o.n as n_post, round(a.b, 9) as b_pre, round(a.b / sqrt(a.rest / a.xx / (a.n - 2)), 6) as t_pre, round(o.b, 9) as b_post, round(o.b / sqrt(o.rest / o.xx / (o.n - 2)), 6) as t_post,
round(o.b - a.b, 9) as b_gap, round((o.b - a.b) / sqrt((a.rest + o.rest) / (a.n + o.n - 4) * (1 / a.xx + 1 / o.xx)), 6) as t_gap from m a join m o on a.grp = o.grp and a.side = 'pre' and o.side = 'post'""",
)
def event_discontinuity(spark, sf_dir):
    """Whether reversal changes at the events, and at the controls."""
    found = A.discontinuity(windows(spark, sf_dir), ["grp"], LAG)
    return rounded(found, b_pre=9, t_pre=6, b_post=9, t_post=6, b_gap=9, t_gap=6)


@query(
    "sampled_corpus",
    f"""with {CORPUS}, s as (select distinct asset, strategy from corpus where asset in ('A', 'R')), t as (select * from s qualify row_number() over (partition by asset order by md5('7:' || strategy), strategy) <= 20)
select asset, strategy, count(*) as n, cast(sum(pnl) as bigint) as total from corpus join t using (asset, strategy) group by 1, 2""",
)
def sampled_corpus(spark, sf_dir):
    """Two assets' folders of a corpus that is written by asset, and 20 strategies of each."""
    path = shared_path(spark, "corpus")
    G.write_corpus(corpus(spark, sf_dir), path)
    rows = G.read_corpus(spark, path, ["A", "R"], most=20)
    return rows.groupBy("asset", "strategy").agg(F.count("*").alias("n"), F.sum("pnl").cast("bigint").alias("total"))


@query(
    "ledger_records",
    """with g as (select l_suppkey % 7 as combo_id, l_linenumber as window_id, l_orderkey % 2 as phase, cast(round(l_extendedprice * 100) as bigint) * (cast(round(l_discount * 100) as bigint) - 5) as x from lineitem)
select 'ridge_books_H8' as run, combo_id, 'ridge_books_H8::ridge::H8' as key, 'ridge' as family, 8 as h, count(*) filter (phase = 1) as bars, cast(coalesce(sum(greatest(x, 0)) filter (phase = 1), 0) as bigint) as gains,
cast(coalesce(sum(greatest(-x, 0)) filter (phase = 1), 0) as bigint) as losses, cast(sum(x) filter (phase = 0) as bigint) as inside, cast(sum(x) filter (phase = 1) as bigint) as outside from g group by combo_id""",
)
def ledger_records(spark, sf_dir):
    """Records of a run whose ledger is written and read again."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint") * (F.round(F.col("l_discount") * 100).cast("bigint") - 5)
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 7).cast("long").alias("combo_id"), F.col("l_linenumber").cast("long").alias("window_id"), (F.col("l_orderkey") % 2).cast("int").alias("phase"),
        F.col("l_orderkey").cast("long").alias("bar_idx"), cents.cast("double").alias("pnl_bp"),
    )
    path = f"{shared_path(spark, 'runs')}/ridge_books_H8"
    write_ledger(rows, f"{path}/trades.parquet")
    whole = {c: F.col(c).cast("bigint") for c in ("gains", "losses", "inside", "outside")}
    return G.combo_records(spark, [path]).withColumns(whole).drop("rebalances")
