"""Queries whose results have no form in SQL, or only in part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequences import fractional_weights
from ..operators import bars as B
from ..operators import portfolio as P
from ..operators import returns as R
from ..operators import sequential as S
from .corpus import corpus
from .market import DOLLAR, FOLD, TICKS, dollar_bars, rounded, sample_spans, ticks
from .registry import query, table


def cusum_sql(change: str, over: str) -> str:
    """Running sums of ``change`` by recursion over a symbol's bars; the side that fires starts again. over: > or >=."""
    return f"""{DOLLAR.replace("with ", "with recursive ", 1)}, r as (select symbol, bar_idx, {change} as x from bars window w as (partition by symbol order by bar_idx)),
n as (select *, row_number() over (partition by symbol order by bar_idx) as i from r where x is not null),
h as (select distinct symbol, cast(0 as bigint) as i, cast(0 as bigint) as bar_idx, 0.0::double as up, 0.0::double as down, 0 as side from n union all
select symbol, i, bar_idx, case when u {over} 1 then 0.0 else u end, case when not u {over} 1 and -d {over} 1 then 0.0 else d end, case when u {over} 1 then 1 when -d {over} 1 then -1 else 0 end
from (select n.symbol, n.i, n.bar_idx, greatest(0.0, h.up + n.x) as u, least(0.0, h.down + n.x) as d from h join n on n.symbol = h.symbol and n.i = h.i + 1))
select symbol, bar_idx, side from h where side <> 0"""


@query("cusum_price", cusum_sql("coalesce(ln(close) - lag(ln(close)) over w, 0)", ">"))
def cusum_price(spark, sf_dir):
    return S.cusum_events(S.log_close(dollar_bars(spark, sf_dir)), 1.0)


@query("cusum_returns", cusum_sql("ln(close) - lag(ln(close)) over w", ">="))
def cusum_returns(spark, sf_dir):
    return S.cusum_events(R.with_log_return(dollar_bars(spark, sf_dir)), 1.0, strict=False, column="ret")


def state_sql(kind: str, weight: str | None) -> str:
    """Imbalance or run bars by recursion over a symbol's rows; mean, share and size as the operator has them."""
    a = "cast(2 / 201.0::double as double)"
    w = "1.0::double" if weight is None else f"cast({weight} as double)"
    flow = "coalesce(last_value(c ignore nulls) over (partition by symbol order by us, id), 1.0::double)" if weight is None else "case when dollar > 0 then case when buy then w else -w end else 0.0::double end"
    rows = f"""c as (select *, {w} as w, nullif(sign(price - lag(price) over (partition by symbol order by us, id)), 0)::double as c from ticks),
n as (select *, {flow} as f, row_number() over (partition by symbol order by us, id) as i, greatest(sum(w) over (partition by symbol) / 200, {"1.0" if weight is None else "1e-9"}) as t from c)"""
    if kind == "imbalance":
        close = "z > 0 and case when mean is null or bar < 20 then z >= t else (t * abs(mean) > 0 and abs(x) >= t * abs(mean)) or z >= 50.0 * t end"
        loop = f"""h as (select symbol, cast(0 as bigint) as i, 0.0::double as x, 0.0::double as z, null::double as mean, cast(0 as bigint) as bar, cast(0 as bigint) as bar_idx from n where i = 1 union all
select symbol, i, case when e then 0.0 else x end, case when e then 0.0 else z end, case when not e then mean when mean is null then x / z else {a} * (x / z) + (1 - {a}) * mean end, case when e then bar + 1 else bar end, bar
from (select *, {close} as e from (select n.symbol, n.i, n.t, h.x + n.f as x, h.z + n.w as z, h.mean, h.bar from h join n on n.symbol = h.symbol and n.i = h.i + 1)))"""
    else:
        close = "z > 0 and greatest(p, s) >= mean * case when share is null or bar < 20 then 0.5 else greatest(share, 1 - share) end"
        loop = f"""h as (select symbol, cast(0 as bigint) as i, 0.0::double as p, 0.0::double as s, 0.0::double as z, t as mean, null::double as share, cast(0 as bigint) as bar, cast(0 as bigint) as bar_idx from n where i = 1 union all
select symbol, i, case when e then 0.0 else p end, case when e then 0.0 else s end, case when e then 0.0 else z end, case when e then {a} * z + (1 - {a}) * mean else mean end,
case when not e then share when share is null then p / z else {a} * (p / z) + (1 - {a}) * share end, case when e then bar + 1 else bar end, bar
from (select *, {close} as e from (select n.symbol, n.i, h.p + case when n.f > 0 then n.w else 0.0 end as p, h.s + case when n.f < 0 then n.w else 0.0 end as s, h.z + n.w as z, h.mean, h.share, h.bar from h join n on n.symbol = h.symbol and n.i = h.i + 1)))"""
    return f"with recursive {TICKS}, {rows}, {loop}, ids as (select n.*, h.bar_idx from n join h using (symbol, i)), {FOLD} select * from bars"


@query("bars_imbalance", state_sql("imbalance", None))
def bars_imbalance(spark, sf_dir):
    return B.fold(S.imbalance_ids(ticks(spark, sf_dir), 200))


@query("bars_volume_imbalance", state_sql("imbalance", "volume"))
def bars_volume_imbalance(spark, sf_dir):
    return B.fold(S.imbalance_ids(ticks(spark, sf_dir), 200, weight="volume"))


@query("bars_run", state_sql("run", None))
def bars_run(spark, sf_dir):
    return B.fold(S.imbalance_ids(ticks(spark, sf_dir), 200, kind="run"))


@query("bars_volume_run", state_sql("run", "volume"))
def bars_volume_run(spark, sf_dir):
    return B.fold(S.imbalance_ids(ticks(spark, sf_dir), 200, kind="run", weight="volume"))


HYBRID = f"""with recursive {TICKS}, n as (select *, row_number() over (partition by symbol order by us, id) as i, cast(sum(dollar) over (partition by symbol) as hugeint) as lim from ticks),
h as (select symbol, i, us as since, cast(dollar as hugeint) as total, cast(0 as bigint) as bar_idx from n where i = 1
union all select n.symbol, n.i, case when (h.total + n.dollar) * 200 >= lim or n.us - since >= 7200000000 then n.us else since end,
case when (h.total + n.dollar) * 200 >= lim or n.us - since >= 7200000000 then 0 else h.total + n.dollar end,
case when (h.total + n.dollar) * 200 >= lim or n.us - since >= 7200000000 then bar_idx + 1 else bar_idx end from h join n on n.symbol = h.symbol and n.i = h.i + 1),
ids as (select n.*, h.bar_idx from n join h using (symbol, i)), {FOLD} select * from bars"""


@query("bars_hybrid", HYBRID)
def bars_hybrid(spark, sf_dir):
    return B.fold(S.hybrid_ids(ticks(spark, sf_dir), 200, 7_200_000_000))


D, TAU = 0.4, 1e-2


def ffd_sql() -> str:
    weights = fractional_weights(D, TAU)
    total = " + ".join(f"{float(w)!r}::double * lag(ln(close), {k}) over w" for k, w in enumerate(weights))
    return f"{DOLLAR} select symbol, bar_idx, round({total}, 7) as ffd from bars window w as (partition by symbol order by bar_idx)"


@query("fractional_difference", ffd_sql())
def fractional_difference(spark, sf_dir):
    rows = S.fractional_difference(S.log_close(dollar_bars(spark, sf_dir)), D, TAU)
    return rounded(rows.select("symbol", "bar_idx", "ffd"), ffd=7)


@query("least_order")
def least_order(spark, sf_dir):
    return S.least_order(S.log_close(dollar_bars(spark, sf_dir)), 1e-2)


@query("explosiveness")
def explosiveness(spark, sf_dir):
    return S.explosiveness(S.log_close(dollar_bars(spark, sf_dir)))


@query("explosiveness_of_all_windows")
def explosiveness_of_all_windows(spark, sf_dir):
    return S.explosiveness(S.log_close(dollar_bars(spark, sf_dir)), 60, None)


@query("sequential_bootstrap")
def sequential_bootstrap(spark, sf_dir):
    return S.sequential_bootstrap(sample_spans(dollar_bars(spark, sf_dir)), 4, 7)


@query(
    "ou_fit",
    f"""{DOLLAR}, l as (select symbol, ln(close) as y, lag(ln(close)) over (partition by symbol order by bar_idx) as x from bars),
m as (select symbol, count(*) as n, regr_slope(y, x) as phi, regr_intercept(y, x) as a, var_pop(y) as vy, covar_pop(y, x) as c from l where x is not null group by 1),
o as (select *, n >= 50 and phi > 0 and phi < 1 as ok from m)
select symbol, n, round(phi, 8) as phi, round(case when ok then a / (1 - phi) end, 6) as mean, round(sqrt((vy - phi * c) * n / (n - 2)), 7) as sigma,
round(case when ok then -ln(2.0) / ln(phi) end, 5) as half_life, ok from o""",
)
def ou_fit(spark, sf_dir):
    return rounded(S.ou_fit(S.log_close(dollar_bars(spark, sf_dir))), phi=8, mean=6, sigma=7, half_life=5)


@query(
    "vector_covariance",
    """with e as (select vec_id, unnest(range(0, 64)) as i, unnest(embedding) as x from embeddings)
select cast(a.i as integer) as i, cast(b.i as integer) as j, round(1e3 * covar_samp(cast(a.x as double), cast(b.x as double)), 7) as cov from e a join e b on a.vec_id = b.vec_id and a.i <= b.i group by 1, 2""",
)
def vector_covariance(spark, sf_dir):
    rows = P.vector_covariance(table(spark, sf_dir, "embeddings"), "embedding")
    return rows.select("i", "j", F.round(1e3 * F.col("cov"), 7).alias("cov"))


COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "covariance",
    " union all ".join(
        f"select l_returnflag as asset, '{a}' as i, '{b}' as j, round(covar_samp({a}, {b}), 4) as cov, round(corr({a}, {b}), 8) as corr from lineitem group by 1"
        for k, a in enumerate(COLUMNS) for b in COLUMNS[k:]
    ),
)
def covariance(spark, sf_dir):
    rows = P.covariance(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "asset"), ["asset"], COLUMNS)
    return rounded(rows, cov=4, corr=8)


@query("walk_forward")
def walk_forward(spark, sf_dir):
    return P.walk_forward(corpus(spark, sf_dir), 252, 126, 5)
