"""Known answers of single operators."""

import tracemalloc
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickfold.functions import normal
from tickfold.functions.sequences import adf, fractional_weights, kontoyiannis, lempel_ziv
from tickfold.operators import bars as B
from tickfold.operators import events as E
from tickfold.operators import overfit as O
from tickfold.operators import panel as P
from tickfold.operators import portfolio as Q
from tickfold.operators import rolling as W
from tickfold.operators import sequential as S


def test_normal(spark):
    xs = [-40.0, -8.0, -3.3, -0.1, 0.0, 0.7, 2.5, 7.5]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", F.expr(normal.cdf("x"))).collect()
    assert all(abs(p - NormalDist().cdf(x)) < 1e-14 for x, p in rows)
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", F.expr(normal.inverse("p"))).collect()
    assert all(abs(z - NormalDist().inv_cdf(p)) < 1e-7 for p, z in rows)


def ticks(spark, dollars):
    rows = [("a", i * 1_000_000, i, 10.0 + i % 3, 1, 1000, d, i % 2 == 0) for i, d in enumerate(dollars)]
    return spark.createDataFrame(rows, "symbol string, us bigint, id bigint, price double, volume bigint, cents bigint, dollar bigint, buy boolean")


def test_constant_activity_bars(spark):
    """The crossing row opens the next bar, so the first is one row short and the last a single row."""
    n = [r["n_base"] for r in B.fold(B.threshold_ids(ticks(spark, [5] * 12), "dollar", 3)).orderBy("bar_idx").collect()]
    assert n == [3, 4, 4, 1]


def test_large_rows_leave_no_gaps(spark):
    """One row that passes three thresholds; bars are numbered without gaps, so that spans and barriers count bars."""
    ids = B.threshold_ids(ticks(spark, [1, 1, 30, 1, 1, 1, 1, 1, 1, 1]), "dollar", 10)
    got = B.fold(ids)
    assert sorted(r["bar_idx"] for r in got.collect()) != list(range(got.count()))
    assert sorted(r["bar_idx"] for r in B.dense(got).collect()) == list(range(got.count()))


def test_trend_scan_against_least_squares(spark):
    rng = np.random.default_rng(3)
    closes = np.exp(np.cumsum(rng.normal(0, 0.01, 60))).tolist()
    got = {r["bar_idx"]: r for r in E.trend_scan(flat_bars(spark, closes), 5, 20).collect()}
    y = np.log(closes)
    for i in range(60):
        best = None
        for n in range(5, min(20, 60 - i) + 1):
            x = np.column_stack([np.ones(n), np.arange(n)])
            c, rest, _, _ = np.linalg.lstsq(x, y[i : i + n], rcond=None)
            t = c[1] / np.sqrt(rest[0] / (n - 2) / (n * (n * n - 1) / 12))
            if best is None or abs(t) > abs(best[0]):
                best = (t, n, y[i + n - 1] - y[i])
        assert (i in got) == (best is not None)
        if best:
            assert np.allclose([got[i]["t_val"], got[i]["ret"]], [best[0], best[2]]) and (got[i]["length"], got[i]["label"]) == (best[1], int(np.sign(best[0])))


def test_kontoyiannis_reads_the_whole_word():
    word, terms = "0110100110010110", []
    for i in range(1, len(word)):
        longest = max((n for n in range(1, len(word) - i + 1) for j in range(i - n + 1) if word[j : j + n] == word[i : i + n]), default=0)
        terms.append(np.log2(i + 1) / (longest + 1))
    assert np.isclose(kontoyiannis(word), np.mean(terms))


def test_fresh_extremes_reach_the_limit_after_the_warmup(spark):
    from tickfold.operators import features as X

    bars = flat_bars(spark, [100.0 * 1.01 ** (i % 7) for i in range(40)])
    z = {r["bar_idx"]: r["z"] for r in X.price_z(bars, 5).collect()}
    for limit, warmup in ((abs(z[12]), 0), (abs(z[12]), 13), (0.7, 5)):
        want = {i for i in z if i >= warmup and abs(z[i]) >= limit and abs(z.get(i - 1, 0.0)) < limit}
        assert {r["bar_idx"] for r in X.fresh_extremes(bars, 5, limit, warmup).collect()} == want


def test_gate_keeps_rows_of_keys_with_two_spans(spark):
    rows = spark.createDataFrame([("a", t) for t in range(6)] + [("b", 3)], "k string, t int")
    spans = spark.createDataFrame([("a", 1, 2), ("a", 4, None)], "k string, s int, e int")
    got = P.interval_gate(rows, spans, ["k"], "t", "s", "e")
    assert got.columns == ["k", "t", "valid"]
    assert sorted(map(tuple, got.collect())) == [("a", 0, False), ("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 4, True), ("a", 5, True), ("b", 3, True)]


def test_zero_activity_gives_no_bars(spark):
    assert B.threshold_ids(ticks(spark, [0] * 4), "dollar", 3).count() == 0


def test_cumulative_over_chunks(spark):
    df = spark.createDataFrame([("a", i, i % 7) for i in range(100)], "k string, i int, v int")
    got = B.cumulative(df, ["k"], ["i"], F.floor(F.col("i") / 9), {"run": F.col("v")}).orderBy("i").collect()
    assert [r["run"] for r in got] == np.cumsum([i % 7 for i in range(100)]).tolist()


def flat_bars(spark, closes, highs=None, lows=None):
    rows = [("a", i, float(c), float((highs or closes)[i]), float((lows or closes)[i])) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, bar_idx bigint, close double, high double, low double")


@pytest.mark.parametrize("side", [1, -1])
def test_both_barriers_stop_wins(spark, side):
    bars = flat_bars(spark, [100, 100], [100, 200], [100, 50])
    ev = spark.createDataFrame([("a", 0, side, 100.0, 0.1), ("a", 1, side, 100.0, 0.1)], "symbol string, ev_idx bigint, side int, entry double, sigma double")
    first, last = E.triple_barrier(ev, bars, 1, 1, 5).orderBy("ev_idx").collect()
    assert first["label"] == -1 and first["hold"] == 1
    assert last["hold"] == 0 and last["ret"] == 0


def test_disjoint_and_identical_spans(spark):
    bars = flat_bars(spark, [1] * 10)
    apart = spark.createDataFrame([("a", i, i) for i in range(10)], "symbol string, start_idx bigint, end_idx bigint")
    assert {r["uniqueness"] for r in E.uniqueness(apart, bars).collect()} == {1.0}
    same = spark.createDataFrame([("a", 2, 5)] * 4, "symbol string, start_idx bigint, end_idx bigint")
    assert all(abs(r["uniqueness"] - 0.25) < 1e-12 for r in E.uniqueness(same, bars).collect())


def corpus(spark, x):
    import datetime as dt

    rows = [("a", j, dt.date(2020, 1, 1) + dt.timedelta(i), int(v * 1e6)) for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "asset string, strategy bigint, date date, pnl bigint")


def test_effective_strategies_meet_by_days_not_in_pairs(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("pairs of strategies")

    x = np.random.default_rng(4).normal(size=(30, 9)).round(6)
    x[x < -0.5] = 0
    x[:, 8] = 0.25  # no deviation
    r = np.corrcoef(x[:, :8].T)
    monkeypatch.setattr(O, "pair_products", refuse)
    monkeypatch.setattr(O, "TOGETHER", 2)
    got = O.effective_strategies(corpus(spark, x)).first()
    assert got["strategies"] == 8 and abs(got["effective"] - 64 / (r**2).sum()) < 1e-6
    # Blocks of days make the same sum of squares.
    monkeypatch.setattr(O, "DAYS", 7)
    monkeypatch.setattr(O, "DENSE", 3)
    day, name = np.nonzero(x)
    rows = pd.DataFrame({"asset": "a", "strategy": name, "day": day, "days": 30, "x": x[day, name]})
    parts = [(a, b, O._day_products(rows.assign(a=a, b=b))) for a in range(5) for b in range(a, 5)]
    squares = sum((1 if a == b else 2) * sum(float(g @ g) for g in p["g"]) for a, b, p in parts)
    assert sum(p["n"].sum() for *_, p in parts) == 8 and abs(squares / 29**2 - (r**2).sum()) < 1e-9


def test_effective_strategies(spark):
    rng = np.random.default_rng(1)
    one = rng.normal(size=(60, 1))
    assert abs(O.effective_strategies(corpus(spark, np.repeat(one, 5, 1))).first()["effective"] - 1) < 1e-6
    q, _ = np.linalg.qr(rng.normal(size=(60, 6)) - 0)
    x = rng.normal(size=(60, 6))
    r = np.corrcoef(x.round(6).T)
    assert abs(O.effective_strategies(corpus(spark, x)).first()["effective"] - 36 / (r**2).sum()) < 1e-3


def test_pbo_of_stable_ranks(spark):
    x = np.random.default_rng(2).normal(size=(120, 8)) + np.arange(8) * 3
    assert O.pbo(corpus(spark, x), 6).first()["pbo"] == 0


def test_expected_max_of_one_trial(spark):
    assert spark.range(1).select(F.expr(normal.expected_max("1e0", "1e0"))).first()[0] == 0


def test_fractional_weights():
    assert fractional_weights(0, 1e-5).tolist() == [1.0]
    assert fractional_weights(1, 1e-5).tolist() == [1.0, -1.0]


def test_sequence_measures():
    assert lempel_ziv("0" * 64) < lempel_ziv("0110100110010110" * 4)
    assert kontoyiannis("01" * 20) < kontoyiannis("0110100010110111001010001110010110101100")
    walk = np.cumsum(np.random.default_rng(3).normal(size=400))
    assert adf(walk)[0] > -3 > adf(np.random.default_rng(3).normal(size=400))[0]


def test_sadf_against_plain_regressions(spark):
    y = np.cumsum(np.random.default_rng(4).normal(size=45))
    bars = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "symbol string, bar_idx bigint, log_close double")
    got = [r["sadf"] for r in S.explosiveness(bars, 20, 30).orderBy("bar_idx").collect()]
    for end in range(20, 46):
        want = max(adf(y[s:end])[0] for s in range(max(0, end - 30), end - 20 + 1))
        assert abs(got[end - 1] - want) < 1e-6
    assert got[:19] == [None] * 19


def test_as_of(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, None), ("a", 6, 3.0)], "k string, s int, v double")
    assert sorted(P.as_of(left, right, ["k"], "t", "s", ["v"]).collect()) == [("a", 1, None), ("a", 5, None), ("b", 9, None)]


def test_weights_of_allocators():
    x = np.random.default_rng(5).normal(size=(200, 6)) * np.arange(1, 7)
    for name, weigh in Q.ALLOCATORS.items():
        w = weigh(x)
        assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all(), name
    assert Q.ALLOCATORS["hrp"](x)[0] > Q.ALLOCATORS["hrp"](x)[5]


@pytest.mark.parametrize("days, names", [(80, 30), (40, 90)])
def test_weights_by_products_of_days_are_those_of_the_covariance(days, names):
    rng = np.random.default_rng(names)
    x = rng.normal(size=(days, names)) @ np.diag(rng.uniform(1, 9, names)) + rng.normal(size=(days, 1))
    for cov, made in ((np.cov(x, rowvar=False), Q.Shrunk.sample(x)), (Q.ledoit_wolf(x), Q.Shrunk.ledoit_wolf(x))):
        d = np.sqrt(np.diag(cov))
        assert np.allclose(made.corr(), cov / np.outer(d, d)) and np.allclose(made.variances(), np.diag(cov))
        assert np.allclose(Q.risk_parity(made), Q.hierarchical_risk_parity(cov))
        assert np.allclose(made.only([3, 1, 7]).minimum_variance(), Q.minimum_variance(cov[np.ix_([3, 1, 7], [3, 1, 7])]))
    assert np.allclose(made.minimum_variance(), Q.minimum_variance(Q.ledoit_wolf(x)))


def test_k_means_by_products_is_that_of_the_rows():
    """Sums that follow only the rows that move give the centres' plain means."""
    rows = np.repeat(np.random.default_rng(4).normal(size=(30, 5)), 2, 0)
    for k in (2, 5, 9):
        for seed, got in zip(range(3), Q._k_means(rows @ rows.T, k, [[seed] for seed in range(3)])):
            draw = np.random.default_rng([seed])
            first = [int(draw.integers(60))]
            gaps = lambda c: np.round(((rows[:, None] - c) ** 2).sum(2), 9)
            while len(first) < k:
                first.append(int(gaps(rows[first]).min(1).argmax()))
            centers, label = rows[first], None
            for _ in range(30):
                before, label = label, gaps(centers).argmin(1)
                if before is not None and (label == before).all() and len(np.unique(label)) == k:
                    break
                centers = np.array([rows[label == c].mean(0) if (label == c).any() else rows[draw.integers(60)] for c in range(k)])
            assert (got == label).all()


def test_a_fold_of_many_names_holds_few_matrices_of_them():
    """1,500 names once took several matrices of 18 MB and a pseudoinverse of each kind."""
    x = np.random.default_rng(3).normal(size=(60, 1_500))
    for name, most in (("minimum_variance", 12), ("hrp", 60), ("nested_clusters", 140)):
        tracemalloc.start()
        w = Q.ALLOCATORS[name](x)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert abs(w.sum() - 1) < 1e-9 and peak < most, (name, peak)


def test_weights_do_not_depend_on_what_is_held(monkeypatch):
    """Without a matrix of names by names, weights are the same and memory grows with names times days."""
    x = np.random.default_rng(12).normal(size=(50, 700)) + 2 * np.repeat(np.random.default_rng(13).normal(size=(50, 7)), 100, 1)
    names = ("hrp", "hrp_denoised", "nested_clusters")
    want = {name: Q.ALLOCATORS[name](x[:, ::5]) for name in names}
    monkeypatch.setattr(Q, "HELD", 10)
    for name in names:
        assert np.allclose(Q.ALLOCATORS[name](x[:, ::5]), want[name]), name
    tracemalloc.start()
    Q.ALLOCATORS["hrp"](np.tile(x, 3))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 12, peak  # one matrix of them takes 35


def test_denoise_keeps_a_correlation():
    c = np.corrcoef(np.random.default_rng(6).normal(size=(300, 20)).T)
    d = Q.denoised(c, 15)
    assert np.allclose(np.diag(d), 1) and np.linalg.cond(d) <= np.linalg.cond(c) + 1e-9


@pytest.mark.parametrize("days, names", [(200, 6), (90, 89), (60, 60), (40, 90)])
def test_denoising_does_not_ask_which_is_more(days, names):
    """Without more days than names nothing was denoised; the law's edge and its zeros hold there too."""
    rng = np.random.default_rng(days)
    x = rng.normal(size=(days, names)) @ np.diag(rng.uniform(1, 9, names)) + 3 * rng.normal(size=(days, 1))
    cov = np.cov(x, rowvar=False)
    d = np.sqrt(np.diag(cov))
    want, made = Q.denoised(cov / np.outer(d, d), days / names), Q.Shrunk.denoised(x)
    assert np.allclose(made.corr(), want) and np.allclose(made.variances(), d * d) and 0 < len(made.z) < min(days, names) - 1
    w = rng.random(3)
    assert made.variance([4, 0, 2], w) == pytest.approx(w @ (want * np.outer(d, d))[np.ix_([4, 0, 2], [4, 0, 2])] @ w)
    assert np.allclose(Q.ALLOCATORS["hrp_denoised"](x), Q.hierarchical_risk_parity(want * np.outer(d, d)))
    assert not np.allclose(Q.ALLOCATORS["hrp_denoised"](x), Q.ALLOCATORS["hrp"](x))


def test_quasi_diagonal_groups_blocks():
    c = np.eye(6)
    for a, b in ((0, 3), (1, 4), (2, 5)):
        c[a, b] = c[b, a] = 0.9
    order = Q.quasi_diagonal(c)
    assert all(abs(order.index(a) - order.index(b)) == 1 for a, b in ((0, 3), (1, 4), (2, 5)))


def test_clusters_find_blocks():
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(300, 3)), 4, 1) + 0.3 * rng.normal(size=(300, 12))
    label = Q.clusters(np.corrcoef(x.T))
    assert all(len(set(label[i : i + 4])) == 1 for i in (0, 4, 8)) and len(set(label)) == 3
    assert sorted(i // 4 for i in Q.decorrelated(np.corrcoef(x.T), rng.random(12), 3)) == [0, 1, 2]


def test_regimes_follow_variance(spark):
    from tickfold.operators.features import regimes

    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=150), 5 * rng.normal(size=150)])
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "symbol string, bar_idx bigint, ret double")
    p = np.array([r["turbulent"] for r in regimes(rows, 20).orderBy("bar_idx").collect()])
    assert p[20:140].mean() < 0.3 and p[170:].mean() > 0.7


def test_corwin_schultz_of_a_low_of_zero(spark):
    """A bar that fell to 0 gives NaN to the spreads of its pairs, and the rest stays."""
    bars = spark.createDataFrame([("a", i, 2.0 + i % 2, 0.0 if i == 2 else 1.0) for i in range(6)], "symbol string, bar_idx bigint, high double, low double")
    got = {r["bar_idx"]: r["cs_spread"] for r in W.corwin_schultz(bars).collect()}
    assert got[0] is None and np.isnan(got[2]) and np.isnan(got[3]) and got[1] >= 0 and got[4] >= 0 and got[5] >= 0


def test_no_frame_shrinks_from_its_start(spark):
    tests = spark.createDataFrame([("a", i, p) for i, p in enumerate([0.04, 0.01, 0.04, 0.5, 0.03])], "asset string, name int, p double")
    got = P.benjamini_hochberg(tests, ["asset"])
    assert [round(r["p_adjusted"], 6) for r in got.orderBy("name").collect()] == [0.05, 0.05, 0.05, 0.5, 0.05]
    bars = spark.createDataFrame([("a", i, 1.0 + i) for i in range(4)], "symbol string, bar_idx bigint, close double")
    for df in (got, E.forward_returns(bars, 2)):
        assert "currentrow$(), unboundedfollowing$()" not in df._jdf.queryExecution().executedPlan().toString()
