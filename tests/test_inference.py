"""Known answers of panels, books and tests of results."""

import math
import os
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickfold.operators import books as K
from tickfold.operators import costs
from tickfold.operators import inference as I
from tickfold.operators import rolling
from tickfold.sources import ticks as S


def test_grid_panel(spark):
    """A missing hour is a row without a close; a feed's value counts from the next hour on."""
    prices = spark.createDataFrame([("a", 0, 1.0, 5.0), ("a", 1, 2.0, 5.0), ("a", 3, 4.0, 0.0), ("b", 1, 8.0, 1.0)], "name string, step bigint, close double, volume double")
    feed = spark.createDataFrame([("a", 1, 0.5)], "name string, step bigint, value double")
    spans = spark.createDataFrame([("b", 2, None)], "name string, start bigint, end bigint")
    got = {(r["name"], r["step"]): r for r in K.grid_panel(prices, {"funding": (feed, 0.0)}, spans).collect()}
    assert len(got) == 8
    assert [got["a", i]["funding"] for i in range(4)] == [0.0, 0.0, 0.5, 0.5]
    assert [got["a", i]["valid"] for i in range(4)] == [True, True, False, False]
    assert not got["b", 1]["valid"]
    assert got["a", 1]["ret"] == pytest.approx(math.log(2)) and got["a", 3]["ret"] is None


def test_daily_panel(spark):
    rows = [("SPY", d, 100.0 * 2 ** i) for i, d in enumerate((1, 2, 4))] + [("zzz", d, 10.0) for d in (1, 2, 3, 4)] + [("few", 1, 5.0)]
    got = K.daily_panel(spark.createDataFrame(rows, "name string, date bigint, close double"), 3).orderBy("name", "date").collect()
    assert [r["name"] for r in got] == ["SPY"] * 3 + ["zzz"] * 4
    assert [round(r["ret"], 6) for r in got[:3]] == [0.0, round(math.log(2), 6), 0.0]  # SPY has no price on day 3
    assert got[0]["per_side"] == pytest.approx(0.5e-4 + max(0.0035 / 200, 0.35 / 25000))


def carried(ret, funding, every, q, least, span, target, cost):
    """The book by a plain loop over a dense matrix."""
    T, N = ret.shape
    w, was = np.zeros((T, N)), np.zeros(N)
    for t in range(span, T - 1):
        if t % every == 0:
            use = [j for j in range(N) if funding[t, j] != 0]
            if len(use) >= least:
                use.sort(key=lambda j: (funding[t, j], j))
                k = max(1, int(q * len(use)))
                was = np.zeros(N)
                was[use[:k]], was[use[-k:]] = 1 / k, -1 / k
        w[t] = was
    raw = np.append((w[:-1] * ret[1:]).sum(1), 0.0) - (w * funding).sum(1)
    lev = np.zeros(T)
    for t in range(T):
        past = raw[max(0, t - span) : t]
        if len(past) >= span // 2 and past.std(ddof=1) > 1e-9:
            lev[t] = min(target / past.std(ddof=1), 5)
    held = w * lev[:, None]
    turn = np.abs(np.diff(held, axis=0, prepend=np.zeros((1, N)))).sum(1)
    return lev * raw - cost * turn


def test_carry_like_a_loop(spark):
    rng = np.random.default_rng(1)
    ret, funding = rng.normal(0, 0.01, (60, 7)), rng.integers(-3, 4, (60, 7)) / 1e3
    rows = [(f"n{j}", t, float(ret[t, j]), float(funding[t, j]), True) for t in range(60) for j in range(7)]
    panel = spark.createDataFrame(rows, "name string, date int, ret double, funding double, valid boolean")
    got = K.carry_books(panel, {"a": (0.3, 5), "b": (0.2, 3)}, 4, 0.05, 10, 1e-3).orderBy("i").collect()
    for s, every, q in (("a", 5, 0.3), ("b", 3, 0.2)):
        want = carried(ret, funding, every, q, 4, 10, 0.05, 1e-3)
        assert np.allclose([r["pnl"] for r in got if r["setting"] == s], want, atol=1e-12)


def test_carry_does_not_repeat_weights_for_each_date(spark, monkeypatch):
    """Names come and go, one that is never held has no number as a return, and blocks hold two names; the rows of
    weights by date, which once were joined and shuffled, aren't made."""
    rng = np.random.default_rng(2)
    ret, funding = rng.normal(0, 0.01, (60, 8)), rng.integers(-3, 4, (60, 8)) / 1e3
    funding[:, 7] = 0.0
    there = rng.random((60, 8)) < 0.8
    there[:, 7] = there[np.arange(60), rng.integers(0, 7, 60)] = True
    rows = [(f"n{j}", t, float("nan") if j == 7 else float(ret[t, j]), float(funding[t, j]), True) for t in range(60) for j in range(8) if there[t, j]]
    panel = spark.createDataFrame(rows, "name string, date int, ret double, funding double, valid boolean")
    monkeypatch.setattr(K, "carry_weights", lambda *_: pytest.fail("weights by date"))
    monkeypatch.setattr(K, "HELD", 2 * 2 * 60)
    got = K.carry_books(panel, {"a": (0.3, 5), "b": (0.2, 3)}, 4, 0.05, 10, 1e-3).orderBy("i").collect()
    for s, every, q in (("a", 5, 0.3), ("b", 3, 0.2)):
        want = carried(np.where(there, ret, 0.0), np.where(there, funding, 0.0), every, q, 4, 10, 0.05, 1e-3)
        assert np.allclose([r["pnl"] for r in got if r["setting"] == s], want, atol=1e-12)
    assert K.carry_books(panel.where("funding = 0"), {"a": (0.3, 5)}, 4, 0.05, 10, 1e-3).where("pnl <> 0").count() == 0


def test_choice_walks_forward(spark):
    rows = [(s, i, v) for s, f in (("a", 1), ("b", -1)) for i, v in enumerate(f * x + 0.1 * (i % 2) for i, x in enumerate([1.0] * 6 + [-1.0] * 6))]
    got = K.chosen_forward(spark.createDataFrame(rows, "setting string, i bigint, pnl double"), 4, 2).orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(4, 12))
    assert [r["setting"] for r in got][:4] == ["a"] * 4 and got[-1]["setting"] == "b"


def test_binomial_and_student(spark):
    for n in (1, 7, 40, 1500):
        for wins in {0, 1, n // 2, n}:
            want = sum(math.comb(n, k) for k in range(wins, n + 1)) / 2**n
            got = spark.range(1).select(I.binomial_tail(F.lit(wins), F.lit(n))).first()[0]
            assert got == pytest.approx(want, rel=1e-9)
    # Quantiles of Student's t, from tables: (degrees of freedom, t, probability below).
    table = [(1, 6.313752, 0.95), (2, 2.919986, 0.95), (5, 2.570582, 0.975), (10, 1.812461, 0.95), (29, 2.462021, 0.99), (30, -1.697261, 0.05)]
    for df, t, p in table:
        assert spark.range(1).select(I.student_cdf(F.lit(t), F.lit(df))).first()[0] == pytest.approx(p, abs=1e-6)


def test_permutations(spark):
    rng = np.random.default_rng(5)
    rows = [(d, n, float(x), float(0.5 * x + e), float(e)) for d in range(40) for n in range(12) for x, e in [rng.normal(size=2)]]
    panel = spark.createDataFrame(rows, "date int, name int, x double, y double, z double")
    found, none = I.permutation_null(panel, "x", "y", 200, 3).first(), I.permutation_null(panel, "x", "z", 200, 3).first()
    assert found["p"] == pytest.approx(1 / 201) and none["p"] > 0.01
    assert abs(found["mean"]) < 0.02 and found["sd"] == pytest.approx(1 / math.sqrt(40 * 11), rel=0.25)
    assert found["observed"] == pytest.approx(np.mean([np.corrcoef([r[2] for r in rows if r[0] == d], [r[3] for r in rows if r[0] == d])[0, 1] for d in range(40)]))


def test_stationary_bootstrap(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1.0, 1.0, 400)
    series = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, None)], "name string, t int, y double")
    got = {r["name"]: r for r in I.stationary_bootstrap(series, ["name"], "t", "y", 400, 1, block=2).collect()}
    a = got["a"]
    assert a["low"] < x.mean() < a["high"] and (a["high"] - a["low"]) == pytest.approx(2 * 1.96 * x.std() / 20, rel=0.25)
    assert got["b"]["n"] == 0 and got["b"]["mean"] is None
    assert I.automatic_block(np.ones(100)) == 4
    slow = np.convolve(rng.normal(size=900), np.ones(20), "valid")
    assert I.automatic_block(slow) > I.automatic_block(rng.normal(size=900))


def test_next_trend(spark):
    closes = np.exp(np.r_[np.arange(15), 14 - np.arange(15)] * 0.01 + np.random.default_rng(0).normal(0, 1e-3, 30))
    bars = spark.createDataFrame([("a", i, float(c)) for i, c in enumerate(closes)], "symbol string, bar_idx bigint, close double")
    got = {r["bar_idx"]: r["label"] for r in I.next_trend(bars, 6).collect()}
    assert sorted(got) == list(range(24))
    for t in got:
        best = (0.0, 0)
        for h in range(3, 7):
            y = np.log(closes[t + 1 : t + 1 + h])
            d = np.arange(h) - (h - 1) / 2
            slope = d @ y / (d @ d)
            tv = slope / math.sqrt(((y - y.mean() - slope * d) ** 2).sum() / (h - 2) / (d @ d))
            best = (tv, int(np.sign(slope))) if abs(tv) > abs(best[0]) else best
        assert got[t] == best[1]


def test_klines_and_fx(spark, tmp_path):
    """Epochs in milliseconds, rows without trades, and repeated minutes."""
    kind = "open_time bigint, open double, high double, low double, close double, volume double, quote_volume double, count bigint, taker_buy_volume double, taker_buy_quote_volume double"
    row = lambda t, close, n: (t, 1.0, 1.0, 1.0, close, 2.0, 3.0, n, 1.0, 1.5)
    path = os.path.join(tmp_path, "k.parquet")
    spark.createDataFrame([row(60_000, 5.0, 1), row(60_000, 6.0, 1), row(120_000, 7.0, 0), row(1_700_000_000_000, 8.0, 2)], kind).coalesce(1).write.parquet(path)
    got = S.read_klines(spark, path, "X").orderBy("ts").collect()
    assert [r["close"] for r in got][-1] == 8.0 and {r["symbol"] for r in got} == {"X"}
    assert S.read_klines(spark, path, "X", keep_last=True).where("close = 6").count() == 1
    assert S.read_klines(spark, path, "X").where("close = 5").count() == 1 and S.read_klines(spark, path, "X").where("close = 7").count() == 0
    fx = os.path.join(tmp_path, "f.parquet")
    spark.createDataFrame([(1_700_000_000, 1.0, 1.0, 1.0, 1.5, 4), (1_700_000_060, 1.0, 1.0, 1.0, 1.5, 0)], "time bigint, open double, high double, low double, close double, count bigint").write.parquet(fx)
    one = S.read_fx(spark, fx, "EURUSD", quote_by_price=True).collect()
    assert len(one) == 1 and one[0]["quote_volume"] == 6.0 and one[0]["taker_buy_volume"] == 2.0


@pytest.mark.parametrize("session", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_etf_hours(spark, tmp_path, session):
    """Regular hours only, New York's clock to UTC in summer and winter; no rows without volume, trades or a time."""
    path = os.path.join(tmp_path, "e.csv")
    with open(path, "w") as f:
        f.write("Ticker,BarDateTime,FirstTradePrice,HighTradePrice,LowTradePrice,LastTradePrice,VolumeWeightPrice,Volume,TotalTrades\n")
        for at, volume, trades in (
            ("2024-07-01 09:29:00", 5, 1), ("2024-07-01 09:30:00", 5, 1), ("2024-01-02 15:59:00", 5, 1), ("2024-01-02 16:00:00", 5, 1),
            ("2024-01-02 12:00:00", 0, 1), ("2024-01-02 12:01:00", 5, 0), ("soon", 5, 1),
        ):
            f.write(f"SPY,{at},1,1,1,2,0,{volume},{trades}\n")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        at = lambda df: [tuple(r) for r in df.select(F.unix_seconds("ts").alias("t"), "quote_volume").orderBy("t").collect()]
        seconds = lambda *t: int(datetime(*t, tzinfo=timezone.utc).timestamp())
        assert at(S.read_etf(spark, path, "SPY")) == [(seconds(2024, 1, 2, 20, 59), 10.0), (seconds(2024, 7, 1, 13, 30), 10.0)]
        assert (seconds(2024, 7, 1, 9, 29), 10.0) in at(S.read_etf(spark, path, "SPY", regular_hours=False))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_local_clocks_that_a_change_skips_or_repeats(spark):
    times = ["2024-03-10 01:59:00", "2024-03-10 02:30:00", "2024-03-10 03:00:00", "2024-11-03 00:59:00", "2024-11-03 01:30:00", "2024-11-03 02:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select("t", S.local_to_utc(F.col("t").cast("timestamp_ntz"), "America/New_York").cast("string").alias("u"))
    got = dict(map(tuple, df.collect()))
    assert [got[t] for t in times] == ["2024-03-10 06:59:00", None, "2024-03-10 07:00:00", "2024-11-03 04:59:00", None, "2024-11-03 07:00:00"]


@pytest.mark.parametrize("session", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_fx_calendar_is_utc_in_any_session(spark, session):
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        hours = spark.range(0, 24 * 14).select(F.timestamp_seconds(F.lit(1_714_521_600) + F.col("id") * 3600).alias("ts"), "id")
        rows = hours.select("id", costs.weekday(F.col("ts")).alias("d"), costs.utc_hour(F.col("ts")).alias("h"), costs.utc_date(F.col("ts")).cast("string").alias("on"), costs.fx_open(F.col("ts")).alias("o"))
        for r in rows.collect():
            t = datetime.fromtimestamp(1_714_521_600 + r["id"] * 3600, timezone.utc)
            closed = t.weekday() == 5 or t.weekday() == 6 and t.hour < 22 or t.weekday() == 4 and t.hour >= 22
            assert (r["d"], r["h"], r["on"], r["o"]) == (t.weekday(), t.hour, t.date().isoformat(), not closed)
        clock = spark.sql("select timestamp_ntz'2024-05-03 21:30:00' ts")
        assert clock.select(costs.weekday(F.col("ts")), costs.utc_hour(F.col("ts"))).first() == (4, 21)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_streamed_weights_equal_pandas(spark):
    """Means and deviations of any input, gaps and infinities included, are those of pandas."""
    rng = np.random.default_rng(3)
    rows = []
    for s, n in (("a", 3000), ("b", 40), ("c", 1)):
        x = rng.normal(size=n).cumsum() + 1000
        x[rng.random(n) < 0.1] = np.nan
        rows += [(s, i, float(v) if i % 7 else float("inf")) for i, v in enumerate(x)]
    rows += [("d", i, None) for i in range(3)] + [("e", i, 0.1) for i in range(50)]
    df = spark.createDataFrame(rows, "symbol string, bar_idx bigint, x double").repartition(3)
    got = rolling.with_ewm(df, {"m": ("x", 20, "mean"), "s": ("x", 20, "std"), "f": ("x", 5, "mean")}).toPandas().sort_values(["symbol", "bar_idx"])
    for _, p in got.groupby("symbol"):
        x = p["x"].astype(float).replace([np.inf, -np.inf], np.nan)
        for name, want in (("m", x.ewm(span=20).mean()), ("s", x.ewm(span=20).std()), ("f", x.ewm(span=5).mean())):
            assert np.allclose(p[name], want.fillna(0.0), rtol=1e-9, atol=1e-7)


def test_listing(spark):
    live, gone = spark.createDataFrame([("a", 1)], "symbol string, x int"), spark.createDataFrame([("a", 2), ("b", 3)], "symbol string, x int")
    assert sorted(map(tuple, S.live_and_delisted(live, gone).collect())) == [("a", 1), ("b", 3)]


def test_stationary_bootstrap_resamples_draws_together(spark, monkeypatch):
    x = [math.sin(i * i) for i in range(37)]
    monkeypatch.setattr(I, "TOGETHER", 37 * 4)
    rng, means = np.random.default_rng([3, *str((np.int32(5),)).encode()]), []
    for _ in range(10):  # one draw at a time
        new = rng.random(37) < 1 / 3
        new[0] = True
        starts = np.flatnonzero(new)
        at = np.repeat(rng.integers(0, 37, len(starts)) - starts, np.diff(np.append(starts, 37)))
        means.append(np.array(x)[(at + np.arange(37)) % 37].mean())
    series = spark.createDataFrame([(5, i, v) for i, v in enumerate(x)], "name int, t int, y double")
    got = I.stationary_bootstrap(series, ["name"], "t", "y", 10, 3, block=3).first()
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-14)
