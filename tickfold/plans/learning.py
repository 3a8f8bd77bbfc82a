"""Queries of learners walked forward, tuned and tested, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import books as K
from ..operators import ferns as N
from ..operators import logistic as L
from ..operators import nulls as Z
from ..operators import panel as P
from ..operators import returns as R
from ..operators import walkforward as W
from ..operators.bars import by_symbol
from ..operators.lineage import cut
from .corpus import PANEL, panel
from .inference import AHEAD, ahead
from .market import DOLLAR, dollar_bars, rounded
from .registry import query

#: The books of every fold: their knobs, penalties and windows of weeks.
KNOBS = ((0.1, False, 0.0, 1), (0.2, False, 0.5, 4), (0.3, True, 0.0, 2), (0.2, False, 1.0, 8))
PENALTIES, HORIZON, INSIDE, SELECT, STEP, FEE = (0.01, 1.0), 4, 104, 26, 26, 5e-4


def learned_panel(spark, sf_dir):
    """Weekly results with two features that end with the week: momentum and deviation, ranked by week."""
    past = lambda k: P.by_name().rowsBetween(1 - k, 0)
    full = lambda f, k: F.when(F.count("ret").over(past(k)) == k, f("ret").over(past(k)))
    rows = panel(spark, sf_dir).withColumns({"_m": full(F.sum, 4), "_v": full(F.stddev_samp, 8), "funding": (F.col("x") % 41 - 20) / 1e6})
    for raw, name in (("_m", "momentum"), ("_v", "deviation")):
        rows = P.normalised(rows.withColumn(raw, F.round(raw, 12)), raw).withColumnRenamed("rank", name).drop("z")
    return rows.select("name", "date", "ret", "funding", "momentum", "deviation")


def walked_sql(result: str) -> str:
    rank = lambda x: f"case when {x} is not null and count({x}) over d > 1 then 2.0::double * (row_number() over (partition by date order by {x} nulls last, name) - 1) / (count({x}) over d - 1) - 1 else 0 end"
    knobs = ", ".join(f"({i}, {q}::double, {str(long).lower()}, {t}::double, {reb})" for i, (q, long, t, reb) in enumerate(KNOBS))

    def books(scored: str, keys: str, out: str) -> str:
        """CTEs of the books of a table of scores with start, stop and, if chosen, a knob."""
        only = f"and {scored}.knob = kn.k" if scored == "sc2" else ""
        return f"""
{out}_r as (select *, count(*) over (partition by {keys}, step) as n, row_number() over (partition by {keys}, step order by score, name) as low from {scored}),
{out}_l as (select {keys}, start, stop, step, name, score, kn.*, case when low > n - z then 1 when not long and low <= z then -1 end as leg
  from (select {scored}.*, kn.*, greatest(least(floor(q * n), case when long then n else floor(n / 2) end), 1) as z
    from {out}_r as {scored} join kn on (step - start) % reb = 0 {only} where n >= 4) as kn),
{out}_u as (select *, greatest(1 + tilt * leg * (score - avg(score) over (partition by {keys}, k, step, leg)), 0.1) as u from {out}_l where leg is not null),
{out}_w as (select *, leg * u / sum(u) over (partition by {keys}, k, step, leg) as w from {out}_u),
{out}_e as (select {keys}, k, f.step, w * (f.ret - f.funding) as gain, 0 as turn from {out}_w b join f on f.name = b.name and f.step > b.step and f.step <= least(b.step + reb, stop - 1)),
{out}_t as (select {keys}, k, name, step, abs(sum(w)) as turn from (select {keys}, k, name, step, w from {out}_w union all select {keys}, k, name, step + reb, -w from {out}_w where step + reb < stop) group by all),
{out} as (select {keys}, k, step, sum(turn) as turnover, sum(gain) - {FEE} * sum(turn) as pnl from (select {keys}, k, step, gain, turn from {out}_e union all select {keys}, k, step, 0, turn from {out}_t) group by all)"""

    return f"""with {PANEL}, days as (select date, row_number() over (order by date) - 1 as step from (select distinct date from panel)),
a as (select *, (x % 41 - 20) / 1e6 as funding, round(case when count(ret) over w4 = 4 then sum(ret) over w4 end, 12) as m, round(case when count(ret) over w8 = 8 then stddev_samp(ret) over w8 end, 12) as v,
  case when count(ret) over ah = {HORIZON} then sum(ret) over ah end as s, lead(step, {HORIZON}) over w as label_end from panel join days using (date)
  window w as (partition by name order by date), w4 as (partition by name order by date rows 3 preceding), w8 as (partition by name order by date rows 7 preceding), ah as (partition by name order by date rows between 1 following and {HORIZON} following)),
f as (select *, {rank("m")} as momentum, {rank("v")} as deviation, case when s is not null and count(s) over d >= 4 then 2.0::double * (row_number() over (partition by date order by s nulls last, name) - 1) / (count(s) over d - 1) - 1 end as y
  from a window d as (partition by date)),
folds as (select unnest(range((select count(*) from days)::int)) as fold), fo as (select fold, fold * {STEP} as a, fold * {STEP} + {INSIDE} as b from folds where fold * {STEP} + {INSIDE + STEP} <= (select count(*) from days)),
parts as (select fold, a, p as part, case when p = 'fit' then b - {SELECT} else b end as e from fo, (values ('fit'), ('refit')) t(p)),
mo as (select fold, part, count(*) as n, sum(momentum * momentum) as p, sum(momentum * deviation) as q, sum(deviation * deviation) as r, sum(momentum * y) as g, sum(deviation * y) as h
  from parts join f on step >= a and step < e and label_end < e where y is not null group by 1, 2),
be as (select fold, part, setting, ((r + n * l) * g - q * h) / ((p + n * l) * (r + n * l) - q * q) as b1, ((p + n * l) * h - q * g) / ((p + n * l) * (r + n * l) - q * q) as b2
  from mo, (values {", ".join(f"({i}, {p}::double)" for i, p in enumerate(PENALTIES))}) t(setting, l)),
kn(k, q, long, tilt, reb) as (values {knobs}),
sc1 as (select fold, setting, b - {SELECT} as start, b as stop, step, name, round(b1 * momentum + b2 * deviation, 10) as score from fo join be using (fold) join f on step >= b - {SELECT} and step < b where part = 'fit'),
{books("sc1", "fold, setting", "tried")},
sh as (select fold, setting, k, sum(pnl) / {SELECT} as m, sqrt(greatest(sum(pnl * pnl) / {SELECT} - (sum(pnl) / {SELECT}) ** 2, 0)) as sd from tried group by 1, 2, 3),
ra as (select fold, setting, k, round(case when sd > 1e-12 then m / sd * sqrt(52.0::double) else 0 end, 9) as sharpe from sh),
choices as (select fold, setting, k as knob, sharpe from ra qualify row_number() over (partition by fold order by sharpe desc, setting, k) = 1),
sc2 as (select fold, phase, knob, case when phase = 0 then a else b end as start, case when phase = 0 then b else b + {STEP} end as stop, step, name, round(b1 * momentum + b2 * deviation, 10) as score
  from fo join choices using (fold) join be using (fold, setting) join (values (0), (1)) t(phase) on true join f on step >= case when phase = 0 then a else b end and step < case when phase = 0 then b else b + {STEP} end where part = 'refit'),
{books("sc2", "fold, phase", "done")}
{result}"""


def walked(spark, sf_dir):
    return W.walk_forward_books(learned_panel(spark, sf_dir), ["momentum", "deviation"], PENALTIES, KNOBS, HORIZON, INSIDE, SELECT, STEP, FEE, 52.0)


@query("walk_forward_choices", walked_sql("select fold, setting, knob, round(sharpe, 6) as sharpe from choices"))
def walk_forward_choices(spark, sf_dir):
    """Penalty and knob that each fold trades with, and their ratio on the dates that chose them."""
    return rounded(walked(spark, sf_dir)[0], sharpe=6)


@query("walk_forward_ledger", walked_sql("select fold, phase, step, round(pnl, 7) as pnl from done where pnl <> 0"))
def walk_forward_ledger(spark, sf_dir):
    """Results of every fold's chosen book, inside (phase 0) and after (1)."""
    return rounded(walked(spark, sf_dir)[1], pnl=7)


# Whether the next VOL_H bars move more than usual, from the bars before.
VOL_H, VOL_SPAN, VOL_FOLDS, VOL_PART, NEWTON = 3, 30, 3, 15, 6


def auc_sql() -> str:
    steps = ["n0 as (select distinct symbol, fold, 0::double as b0, 0::double as b1 from tr)"]
    for k in range(NEWTON):
        steps.append(
            f"""p{k} as (select symbol, fold, b0, b1, y, rv, 1 / (1 + exp(-greatest(least(b0 + b1 * rv, 30), -30))) as p from tr join n{k} using (symbol, fold)),
s{k} as (select symbol, fold, b0, b1, sum(y - p) as g0, sum((y - p) * rv) - b1 as g1, sum(p * (1 - p)) as a, sum(p * (1 - p) * rv) as b, sum(p * (1 - p) * rv * rv) + 1 as c from p{k} group by symbol, fold, b0, b1),
n{k + 1} as (select symbol, fold, b0 + (c * g0 - b * g1) / (a * c - b * b) as b0, b1 + (a * g1 - b * g0) / (a * c - b * b) as b1 from s{k})"""
        )
    newton = ",\n".join(steps)
    return f"""{DOLLAR}, r as (select symbol, bar_idx, abs(ln(close) - lag(ln(close)) over (partition by symbol order by bar_idx)) as r from bars),
v as (select symbol, bar_idx, case when count(coalesce(r, 0)) over a >= {VOL_H} then sum(coalesce(r, 0)) over a end as v, case when count(r) over b = {VOL_H} then sum(r) over b end as rv from r
  window a as (partition by symbol order by bar_idx rows between 1 following and {VOL_H} following), b as (partition by symbol order by bar_idx rows {VOL_H - 1} preceding)),
u as (select *, case when count(v) over p >= {VOL_SPAN // 2} then quantile_cont(v, 0.5) over p end as u from v window p as (partition by symbol order by bar_idx rows between {VOL_SPAN} preceding and 1 preceding)),
l as (select symbol, rv, cast(v > u as integer) as y, row_number() over (partition by symbol order by bar_idx) - 1 as i, count(*) over (partition by symbol) // {VOL_FOLDS + 1} as z from u where rv is not null and v > u is not null),
fo as (select unnest(range({VOL_FOLDS})) as fold), tr as (select symbol, fold, rv, y from l, fo where z >= {VOL_PART} and i < (fold + 1) * z),
{newton},
sc as (select symbol, fold, y, round(1 / (1 + exp(-(b0 + b1 * rv))), 9) as s from l, fo join n{NEWTON} using (fold) where l.symbol = n{NEWTON}.symbol and z >= {VOL_PART} and i >= (fold + 1) * z + {VOL_H} and i < (fold + 3) * z and (i - (fold + 1) * z - {VOL_H}) % {VOL_H} = 0),
rk as (select symbol, fold, y, rank() over (partition by symbol, fold order by s) + (count(*) over (partition by symbol, fold, s) - 1) / 2 as r from sc),
au as (select symbol, fold, sum(y) as p, count(*) as n, (sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) as auc from rk group by 1, 2)
select symbol, count(*) as folds, round(quantile_cont(auc, 0.5), 8) as auc, round(quantile_cont(auc, 0.25), 8) as auc_low, round(quantile_cont(auc, 0.75), 8) as auc_high, cast(sum(n) as bigint) as n_test
from au where n >= 8 and auc is not null group by 1"""


def volatile_bars(spark, sf_dir):
    bars = K.forward_volatility(dollar_bars(spark, sf_dir), VOL_H, VOL_SPAN)
    return L.trailing_volatility(bars, VOL_H)


def volatility_aucs(rows, features):
    scored = L.logistic_walk(rows, features, "large", VOL_H, VOL_FOLDS, VOL_PART, rounds=NEWTON)
    return rounded(L.walk_auc(scored, 8), auc=8, auc_low=8, auc_high=8)


@query("volatility_auc", auc_sql().replace("sc as (select symbol, fold, y,", "sc as (select l.symbol, fold, y,"))
def volatility_auc(spark, sf_dir):
    """How well the volatility so far foretells a volatile stretch: the fair baseline, on expanding folds."""
    return volatility_aucs(volatile_bars(spark, sf_dir), ["rv"])


@query("volatility_auc_features")
def volatility_auc_features(spark, sf_dir):
    """The same with features of the tape beside it."""
    rows = K.validation_features(volatile_bars(spark, sf_dir), (3, 6), (6,), 24)
    rows = rows.withColumn("ofi", R.flow_imbalance(F.col("buy_dollar"), F.col("sell_dollar")))
    return volatility_aucs(rows, ["rv", "mom3", "mom6", "vol6", "vol_z", "ofi"])


# Overlapping labels: whether the close is higher after SPAN_H bars, from scaled momenta and volume.
SPAN_H, EMBARGO, FOLDS, GROUPS, FERNS, DEPTH = 6, 2, 5, 4, 12, 3
FEATURES = ("z1", "z3", "z6", "z12", "vol_z")
SETTINGS = tuple((depth, prior) for depth in (1, 2, 4) for prior in (0.5, 4.0))

EVENTS = f"""{DOLLAR}, rr as (select *, coalesce(ln(close) - lag(ln(close)) over (partition by symbol order by bar_idx), 0) as r, lead(close, {SPAN_H}) over (partition by symbol order by bar_idx) as later from bars),
vv as (select symbol, bar_idx, close, later, {", ".join(f"case when count(r) over w{n} >= {n} then sum(r) over w{n} end as m{n}" for n in (1, 3, 6, 12))}, case when count(r) over w24 >= 24 then stddev_samp(r) over w24 end as s,
  case when count(*) over w24 >= 24 and stddev_samp(ln(1.0::double + volume)) over w24 > 0 then (ln(1.0::double + volume) - avg(ln(1.0::double + volume)) over w24) / stddev_samp(ln(1.0::double + volume)) over w24 end as vol_z
  from rr window {", ".join(f"w{n} as (partition by symbol order by bar_idx rows {n - 1} preceding)" for n in (1, 3, 6, 12, 24))}),
ev as (select symbol, bar_idx as ev_idx, bar_idx + {SPAN_H} as end_idx, cast(later > close as integer) as y, {", ".join(f"round(m{n} / nullif(s * sqrt({n}.0::double), 0), 9) as z{n}" for n in (1, 3, 6, 12))}, round(vol_z, 9) as vol_z
  from vv where s is not null and later is not null)"""


def overlapping_events(spark, sf_dir):
    bars = dollar_bars(spark, sf_dir)
    rows = K.validation_features(bars, (1, 3, 6, 12), (24,), 24).withColumn("later", F.lead("close", SPAN_H).over(by_symbol()))
    scaled = {f"z{n}": F.round(F.try_divide(F.col(f"mom{n}"), F.col("vol24") * F.sqrt(F.lit(float(n)))), 9) for n in (1, 3, 6, 12)}
    i = F.col("bar_idx")
    rows = rows.where("vol24 is not null and later is not null").withColumns(scaled | {"vol_z": F.round("vol_z", 9), "y": (F.col("later") > F.col("close")).cast("int")})
    return rows.select("symbol", i.alias("ev_idx"), (i + SPAN_H).alias("end_idx"), "y", *FEATURES)


def ferns_sql(splits: str, drawn, prior: float) -> str:
    """Scores of a table of splits (fit, symbol, ev_idx, part): counts of the training rows of each fern's cell."""
    cell = lambda fern: " + ".join(f"case when {f} > {c} then {1 << k} else 0 end" for k, (f, c) in enumerate(fern))
    return f"""ce as (select symbol, ev_idx, y, unnest(range({len(drawn)})) as fern, unnest([{", ".join(map(cell, drawn))}]) as cell from ev),
ct as (select fit, symbol, fern, cell, count(*) as n, sum(y) as s from {splits} join ce using (symbol, ev_idx) where part = 'train' group by all),
ps as (select fit, symbol, ev_idx, part, y, avg((coalesce(s, 0) + {prior}) / (coalesce(n, 0) + 2 * {prior})) as p from {splits} join ce using (symbol, ev_idx) left join ct using (fit, symbol, fern, cell) group by all),
pj as (select *, rank() over (partition by fit, symbol, part order by round(p, 9)) + (count(*) over (partition by fit, symbol, part, round(p, 9)) - 1) / 2 as rk, greatest(least(p, 1 - 1e-6), 1e-6) as pc from ps),
ju as (select fit, symbol, part, avg(cast((round(p, 9) >= 0.5) = (y = 1) as integer)) as accuracy, avg(y * ln(pc) + (1 - y) * ln(1 - pc)) as neg_log_loss,
  (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) as auc from pj group by 1, 2, 3)"""


OWN = """ow as (select *, least(i // greatest(n // {k}, 1), {k} - 1) as own from (select *, row_number() over (partition by symbol order by ev_idx) - 1 as i, count(*) over (partition by symbol) as n from ev))"""
PURGED = f"""{OWN.format(k=FOLDS)}, te as (select symbol, own as fold, min(ev_idx) as lo, max(end_idx) as hi from ow group by 1, 2),
pu as (select fold, symbol, ev_idx, part from (select fold, o.symbol, ev_idx, case when own = fold then 'test' when end_idx < lo or ev_idx > hi + {EMBARGO} then 'train' end as part from ow o join te using (symbol)) where part is not null)"""


def leak_sql() -> str:
    from itertools import combinations

    combos = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(combinations(range(GROUPS), 2)))
    clash = lambda t: f"(e{t}.end_idx >= {t}.lo and e{t}.ev_idx <= {t}.hi + {EMBARGO})".replace(f"e{t}.", "e.")
    return f"""{EVENTS}, {PURGED},
og as ({OWN.format(k=GROUPS).removeprefix("ow as (").removesuffix(")")}), tg as (select symbol, own as fold, min(ev_idx) as lo, max(end_idx) as hi from og group by 1, 2),
cp as (select i as split, symbol, ev_idx, part from (select c.i, e.symbol, e.ev_idx, case when own in (c.a, c.b) then 'test' when not {clash("ta")} and not {clash("tb")} then 'train' end as part
  from og e, (values {combos}) c(i, a, b), tg ta, tg tb where ta.symbol = e.symbol and ta.fold = c.a and tb.symbol = e.symbol and tb.fold = c.b) where part is not null),
sp as (select 'purged:' || fold as fit, symbol, ev_idx, part from pu union all select 'combinatorial:' || split, symbol, ev_idx, part from cp
  union all select 'standard:' || fold, symbol, ev_idx, case when own = fold then 'test' else 'train' end from ow, range({FOLDS}) t(fold)),
{ferns_sql("sp", F_DRAWN, 1.0)}
select symbol, split_part(fit, ':', 1) as scheme, count(*) as splits, round(avg(accuracy), 8) as accuracy, round(avg(neg_log_loss), 8) as neg_log_loss, round(avg(auc), 8) as auc
from ju where part = 'test' and auc is not null group by 1, 2"""


F_DRAWN = N.draw_ferns(FEATURES, FERNS, DEPTH)


@query("fold_leak_study", leak_sql())
def fold_leak_study(spark, sf_dir):
    """One learner under leaky, purged and combinatorial folds."""
    found = N.fold_leak_study(overlapping_events(spark, sf_dir), FEATURES, "y", FOLDS, GROUPS, 2, EMBARGO, FERNS, DEPTH)
    return rounded(found, accuracy=8, neg_log_loss=8, auc=8)


def tuning_sql() -> str:
    parts = []
    for i, (depth, prior) in enumerate(SETTINGS):
        judge = ferns_sql("fi", N.draw_ferns(FEATURES, FERNS, depth), prior)
        parts.append(
            f"""select * from (with {judge} select {i} as turn, symbol, {depth} as depth, {prior}::double as prior, avg(accuracy) filter (part = 'test') as accuracy, avg(neg_log_loss) filter (part = 'test') as neg_log_loss,
avg(neg_log_loss) filter (part = 'train') - avg(neg_log_loss) filter (part = 'test') as gap from ju where auc is not null group by symbol)"""
        )
    best = lambda c: f"row_number() over (partition by symbol order by round({c}, 9) desc, turn) = 1"
    return f"""{EVENTS}, {PURGED}, fi as (select 'p' || fold as fit, symbol, ev_idx, part from pu), al as ({" union all ".join(parts)})
select symbol, depth, prior, round(accuracy, 8) as accuracy, round(neg_log_loss, 8) as neg_log_loss, round(gap, 8) as gap, {best("neg_log_loss")} as best_by_loss, {best("accuracy")} as best_by_accuracy from al"""


@query("purged_tuning", tuning_sql())
def purged_tuning(spark, sf_dir):
    """Ferns of one to four features and two priors on purged folds: the sweep of features a learner may look at."""
    return rounded(N.tune_ferns(overlapping_events(spark, sf_dir), FEATURES, "y", SETTINGS, FOLDS, EMBARGO, FERNS), accuracy=8, neg_log_loss=8, gap=8)


@query("group_importance")
def group_importance(spark, sf_dir):
    """Losses when clusters of features are dealt anew; clusters come from the table itself."""
    rows = cut(overlapping_events(spark, sf_dir))
    groups = N.linked_features(rows, FEATURES)
    return rounded(N.group_importance(rows, FEATURES, "y", groups, FOLDS, EMBARGO), loss_gain=8, accuracy_gain=8)


# Books of ten names by their results so far, against random books from all names; and blocks of quantities dealt anew.
CUT_WEEK, BOOK, DRAWS, NULL_SEED, BLOCK_LEN, BLOCK_DRAWS = 1480, 10, 200, 11, 10, 40


def null_sql() -> str:
    ratio = lambda key, source: f"select {key}, case when q / n - (s / n) ** 2 > 1e-24 then s / n / sqrt(q / n - (s / n) ** 2) else 0 end as ratio from (select {key}, max(bar) - min(bar) + 1 as n, sum(pnl) as s, sum(pnl * pnl) as q from {source} where round(pnl, 12) <> 0 group by 1)"
    return f"""with {PANEL}, bp as (select name, bar, sum(part) as part from (select name, ret / greatest(date % 4, 1) as part, unnest(range(date, date + greatest(date % 4, 1))) as bar from panel where date >= {CUT_WEEK}) group by 1, 2),
best as (select name from panel where date < {CUT_WEEK} group by 1 order by sum(ret) desc, name limit {BOOK}),
ob as (select 0 as k, bar, sum(part) as pnl from bp join best using (name) group by 2), o as ({ratio("k", "ob")}),
dr as (select draw, name from (select distinct name from bp), range({DRAWS}) t(draw) qualify row_number() over (partition by draw order by md5('{NULL_SEED}:' || draw || ':' || name), name) <= (select count(distinct name) from bp join best using (name))),
bk as (select draw, bar, sum(part) as pnl from dr join bp using (name) group by 1, 2), nu as ({ratio("draw", "bk")})
select round(o.ratio, 8) as observed, count(*) as draws, round(avg(nu.ratio), 8) as mean, round(stddev_samp(nu.ratio), 8) as sd, (count(*) filter (round(nu.ratio, 9) >= round(o.ratio, 9)) + 1) / (count(*) + 1) as p from nu, o group by o.ratio"""


@query("random_book_null", null_sql())
def random_book_null(spark, sf_dir):
    rows = panel(spark, sf_dir)
    early = rows.where(F.col("date") < CUT_WEEK).groupBy("name").agg(F.sum("ret").alias("_s"))
    best = early.orderBy(F.desc("_s"), "name").limit(BOOK).select("name")
    trades = rows.where(F.col("date") >= CUT_WEEK).select("name", F.col("date").alias("start_idx"), (F.col("date") % 4).alias("hold"), F.col("ret").alias("pnl"))
    return rounded(Z.random_book_null(trades.join(best, "name"), trades, DRAWS, NULL_SEED), observed=8, mean=8, sd=8)


def block_sql() -> str:
    fit = """m_{0} as (select draw, count(*) as n, covar_pop(x, x) as xx, covar_pop(x, c) as xc, covar_pop(c, c) as cc, covar_pop(x, y) as xy, covar_pop(c, y) as cy, avg(x) as mx, avg(c) as mc, avg(y) as my from {1} group by 1),
s_{0} as (select draw, date, any_value(n) as n, any_value(xx - xc * xc / cc) as rx, any_value((xy * cc - cy * xc) / (xx * cc - xc * xc)) as b,
  sum((x - mx - xc / cc * (c - mc)) * (y - my - (xy * cc - cy * xc) / (xx * cc - xc * xc) * (x - mx) - (cy * xx - xy * xc) / (xx * cc - xc * xc) * (c - mc))) as s from {1} join m_{0} using (draw) group by 1, 2),
t_{0} as (select draw, any_value(b) / (sqrt(sum(s * s) * (count(*) / (count(*) - 1)) * ((any_value(n) - 1) / (any_value(n) - 3))) / (any_value(n) * any_value(rx))) as t from s_{0} group by 1)"""
    return f"""with {AHEAD}, u as (select name, date, after as y, x, ret as c from a where after is not null and x is not null and ret is not null),
i as (select *, row_number() over (partition by name order by date) - 1 as i, count(*) over (partition by name) as k from u), b as (select name, i // {BLOCK_LEN} as b, count(*) as len from i where k >= {BLOCK_LEN} group by 1, 2),
d as (select draw, name, b, coalesce(sum(len) over (partition by draw, name order by md5('{NULL_SEED}:' || draw || ':' || name || ':' || b), b rows between unbounded preceding and 1 preceding), 0) as dest from b, range({BLOCK_DRAWS}) t(draw)),
p as (select d.draw, o.name, o.date, o.y, o.c, i.x from i join d on d.name = i.name and d.b = i.i // {BLOCK_LEN} join i o on o.name = i.name and o.i = dest + i.i % {BLOCK_LEN}),
z as (select -1 as draw, name, date, y, x, c from u), {fit.format("p", "p")}, {fit.format("z", "z")}
select round(t_z.t, 6) as observed, count(*) as draws, round(avg(t_p.t), 6) as mean, round(stddev_samp(t_p.t), 6) as sd, (count(*) filter (round(abs(t_p.t), 9) >= round(abs(t_z.t), 9)) + 1) / (count(*) + 1) as p from t_p, t_z group by t_z.t"""


@query("block_permutation_null", block_sql())
def block_permutation_null(spark, sf_dir):
    rows = ahead(spark, sf_dir)
    return rounded(Z.block_permutation_null(rows, "after", "x", ["ret"], BLOCK_LEN, BLOCK_DRAWS, NULL_SEED), observed=6, mean=6, sd=6)
