"""Nulls, factors beside confounders, event windows, and readers of corpora and runs."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickfold.operators import causal as A
from tickfold.operators import nulls as Z
from tickfold.operators.studies import write_ledger
from tickfold.sources import ledgers as G

TRADES = "name string, start_idx int, hold int, pnl double"


def trades(seed, names=30, edge=0.0, prefix="p"):
    rng = random.Random(seed)
    return [(f"{prefix}{i}", rng.randrange(200), rng.randrange(5), rng.gauss(edge, 1)) for i in range(names) for _ in range(20)]


def plain_ratio(rows):
    book = {}
    for _, start, hold, pnl in rows:
        for b in range(start, start + max(1, hold)):
            book[b] = book.get(b, 0.0) + pnl / max(1, hold)
    used = [b for b, v in book.items() if v]
    x = np.array([book.get(b, 0.0) for b in range(min(used), max(used) + 1)])
    return x.mean() / x.std()


def test_a_planted_edge_is_rejected_and_the_book_is_a_plain_one(spark):
    pool, best = trades(1), trades(2, 8, 1.0, "best")
    got = Z.random_book_null(spark.createDataFrame(best, TRADES), spark.createDataFrame(pool + best, TRADES), 99, 3).first()
    assert got["observed"] == pytest.approx(plain_ratio(best)) and got["draws"] == 99 and got["p"] <= 0.02


def test_without_an_edge_p_is_spread(spark):
    pool = trades(4, 24)
    df = spark.createDataFrame(pool, TRADES)
    ps = []
    for k in range(6):
        own = [r for r in pool if int(r[0][1:]) % 6 == k]
        ps.append(Z.random_book_null(spark.createDataFrame(own, TRADES), df, 60, k).first()["p"])
    assert 0.2 < sum(ps) / 6 < 0.8 and min(ps) > 0.02
    assert Z.random_book_null(df.limit(0), df, 5, 1).count() == 0


def test_blocks_stay_whole_and_the_short_one_moves(spark):
    rows = [("a", t, float(t), 0.0) for t in range(23)] + [("b", t, float(t), 0.0) for t in range(4)]
    df = spark.createDataFrame(rows, "name string, date int, x double, y double")
    starts = set()
    for draw, own in {r["draw"]: r["x"] for r in Z.block_permuted(df, "x", 5, 20, 1).groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("date", "x"))).alias("x")).collect()}.items():
        x = [v["x"] for v in own]
        assert sorted(x) == list(map(float, range(23))) and [v["date"] for v in own] == list(range(23))
        at = x.index(20.0)
        assert x[at : at + 3] == [20.0, 21.0, 22.0]
        starts.add(at)
    assert len(starts) > 2


def test_draws_of_blocks_are_not_shuffled(spark):
    df = spark.createDataFrame([("a", t, float(t), 0.0) for t in range(23)], "name string, date int, x double, y double")
    plan = Z.block_permuted(df, "x", 5, 20, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def test_block_null_rejects_a_planted_slope_only(spark):
    rng = random.Random(6)
    rows = []
    for name in "abcdef":
        for t in range(80):
            x, c = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((name, t, 0.5 * x + c + rng.gauss(0, 1), x, c, rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "name string, date int, y double, x double, c double, noise double")
    hit = Z.block_permutation_null(df, "y", "x", ["c"], 10, 49, 2).first()
    miss = Z.block_permutation_null(df, "y", "noise", ["c"], 10, 49, 2).first()
    assert hit["p"] == pytest.approx(1 / 50) and hit["observed"] > 4 and miss["p"] > 0.05
    data = np.array([r[2:5] for r in rows])
    m = np.column_stack([np.ones(len(rows)), data[:, 1], data[:, 2]])
    beta = np.linalg.lstsq(m, data[:, 0], rcond=None)[0]
    e, dates, inverse = data[:, 0] - m @ beta, np.array([r[1] for r in rows]), np.linalg.inv(m.T @ m)
    meat = sum(np.outer(s, s) for s in (m[dates == d].T @ e[dates == d] for d in range(80)))
    v = inverse @ meat @ inverse * (80 / 79) * ((len(rows) - 1) / (len(rows) - 3))
    assert hit["observed"] == pytest.approx(beta[1] / math.sqrt(v[1, 1]))


def test_verdicts_of_planted_factors(spark):
    """x follows the driver, which moves y: adjusted, it dies. z moves y against the driver: adjusted, it shows."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(8):
        for t in range(200):
            c, d = rng.normal(), rng.normal()
            x, z = c + 0.3 * rng.normal(), rng.normal()
            rows += [("spurious", f"n{i}", t, c + 0.5 * rng.normal(), x, c, d), ("hidden", f"n{i}", t, z - c + 0.3 * rng.normal(), c + 0.9 * z, c, d)]
    rows += [("spurious", "short", t, 9.0, float(t), 1.0, 2.0) for t in range(10)]
    df = spark.createDataFrame(rows, "factor string, name string, date int, y double, x double, c double, d double")
    got = {r["factor"]: r for r in A.factor_panel_test(df, ["factor"], 60).collect()}
    assert got["spurious"]["flip"] == "spurious_killed" and got["spurious"]["names"] == 8 and got["spurious"]["attenuation"] > 0.9
    assert abs(got["hidden"]["driver_t"]) > abs(got["hidden"]["naive_t"]) and got["hidden"]["sign_consistency"] <= 1
    own = np.array([r[3:] for r in rows if r[0] == "spurious" and r[1] != "short"])
    for names, key in (((1,), "naive"), ((1, 2), "driver"), ((1, 3), "regime"), ((1, 2, 3), "both")):
        m = np.column_stack([np.ones(len(own)), *(own[:, k] for k in names)])
        beta = np.linalg.lstsq(m, own[:, 0], rcond=None)[0]
        e = own[:, 0] - m @ beta
        t = beta[1] / math.sqrt(np.linalg.inv(m.T @ m)[1, 1] * (e @ e) / (len(own) - m.shape[1]))
        assert got["spurious"][f"{key}_t"] == pytest.approx(t) and got["spurious"][f"{key}_slope"] == pytest.approx(beta[1] * own[:, 1].std(ddof=1))


def test_windows_are_the_nearest_rows(spark):
    rng = random.Random(3)
    daily = [(n, d, float(d)) for n in "abc" for d in sorted(rng.sample(range(300), 120))] + [("a", 500, None)]
    events = [(1, "a", 150), (2, "a", 150), (3, "b", 10), (4, "c", 140), (5, "b", 400), (6, "x", 5)]
    got = {}
    frames = spark.createDataFrame(events, "event int, name string, day int"), spark.createDataFrame(daily, "name string, day int, ret double")
    for r in A.event_windows(*frames, width=30, least=8).collect():
        got.setdefault((r["event"], r["side"]), []).append(r["day"])
    want = {}
    for e, n, at in events:
        days = [d for m, d, v in daily if m == n and v is not None]
        pre, post = [d for d in days if d < at], [d for d in days if d >= at]
        if len(pre) >= 8 and len(post) >= 8:
            want |= {(e, "pre"): pre[-30:], (e, "post"): post[:30]}
    assert {k: sorted(v) for k, v in got.items()} == want and {k[0] for k in want} >= {1, 2, 4}


def test_a_slope_that_changes_at_the_event(spark):
    rng = random.Random(9)
    rows = []
    for e in range(30):
        past = []
        for t in range(-50, 50):
            past5 = sum(past[-5:]) if len(past) >= 5 else 0.0
            past.append(rng.gauss(0, 0.01) - (0.2 * past5 if t >= 0 else 0.0))
            rows.append(("g", e, "post" if t >= 0 else "pre", t, past[-1]))
    got = A.discontinuity(spark.createDataFrame(rows, "grp string, event int, side string, day int, ret double"), ["grp"]).first()
    assert got["t_gap"] < -4 and abs(got["t_pre"]) < 3 and got["n_pre"] == got["n_post"] == 30 * 45


def test_controls_are_seeded(spark):
    events = spark.createDataFrame([(i, f"e{i}", i) for i in range(50)], "event int, name string, day int")
    controls = spark.createDataFrame([("u",), ("v",), ("w",), ("v",)], "name string")
    pick = lambda seed: {r["event"]: (r["name"], r["day"]) for r in A.matched_controls(events, controls, seed).collect()}
    one = pick(1)
    assert one == pick(1) != pick(2) and len({n for n, _ in one.values()}) == 3 and all(d == e for e, (_, d) in one.items())


def test_corpus_by_asset_is_pruned_and_sampled(spark, tmp_path):
    rows = [(a, f"s{i}", d, float(i * d)) for a in ("btcusdt", "spy_equity", "eurusd_fx", "eur_forex") for i in range(12) for d in range(5)]
    corpus = spark.createDataFrame(rows, "asset string, strategy string, date int, pnl double")
    path = str(tmp_path / "corpus")
    G.write_corpus(corpus, path)
    assert sorted(map(tuple, G.read_corpus(spark, path).collect())) == sorted(rows)
    one = G.read_corpus(spark, path, market="fx")
    assert {r["asset"] for r in one.collect()} == {"eurusd_fx"}
    assert len(one.inputFiles()) >= 1 and "PartitionFilters: []" not in one._jdf.queryExecution().toString()
    few = G.read_corpus(spark, path, ["btcusdt", "spy_equity"], most=5, seed=3)
    names = {(r["asset"], r["strategy"]) for r in few.collect()}
    assert len(names) == 10 and few.count() == 50 and names == {(r["asset"], r["strategy"]) for r in G.read_corpus(spark, path, ["btcusdt", "spy_equity"], most=5, seed=3).collect()}
    assert names != {(r["asset"], r["strategy"]) for r in G.read_corpus(spark, path, ["btcusdt", "spy_equity"], most=5, seed=4).collect()}


def test_runs_with_and_without_combos_and_cells(spark, tmp_path):
    rows = [(c, w, p, 10 * w + b, float((c + 1) * (b - 1))) for c in range(2) for w in range(3) for p in range(2) for b in range(4)]
    ledger = spark.createDataFrame(rows, G.LEDGER)
    bare, full = str(tmp_path / "mlp_panel_H12"), str(tmp_path / "trees")
    for path in (bare, full):
        write_ledger(ledger, f"{path}/trades.parquet")
    spark.createDataFrame([(0, "gbm", 4)], "combo_id long, family string, H int").write.parquet(f"{full}/combos.parquet")
    spark.createDataFrame([(0, 1, 50.0, 7.0, 3), (0, 0, 1.0, 1.0, 1)], "combo_id long, phase int, pos_bp double, neg_bp double, n_reb int").write.parquet(f"{full}/cells.parquet")
    got = {r["key"]: r for r in G.combo_records(spark, [bare, full]).collect()}
    assert set(got) == {"mlp_panel_H12::mlp::H12", "trees::gbm::H4", "trees::?::c1"}
    first = got["trees::gbm::H4"]
    assert (first["gains"], first["losses"], first["rebalances"], first["bars"]) == (50.0, 7.0, 3, 12)
    assert (got["trees::?::c1"]["gains"], got["trees::?::c1"]["rebalances"]) == (0.0, 0)
    assert got["mlp_panel_H12::mlp::H12"]["rebalances"] is None and got["mlp_panel_H12::mlp::H12"]["family"] == "mlp"
    net = {(r["combo_id"], r["window_id"]): (r["inside"], r["outside"]) for r in G.phase_windows(G.read_run(spark, bare)).collect()}
    assert net[1, 2] == (4.0, 4.0) and len(net) == 6
    assert sorted(tuple(r) for r in G.read_run(spark, bare).select("combo_id", "window_id", "phase", "bar_idx", "pnl_bp").collect()) == sorted(rows)


def test_events_are_dealt_among_tasks_by_their_digests(spark, monkeypatch):
    monkeypatch.setattr(A, "HASHES", 10)
    events = spark.range(20).selectExpr("id as event", "id as name", "id + 100 as day").coalesce(1)
    got = A.matched_controls(events, spark.range(50, 55).selectExpr("id as name"), 3)
    assert "RoundRobinPartitioning(10)" in got._jdf.queryExecution().executedPlan().toString()
    digest = lambda e, c: hashlib.md5(f"3:{e}:{c}".encode()).hexdigest()
    want = {e: min(range(50, 55), key=lambda c, e=e: digest(e, c)) for e in range(20)}
    assert {r["event"]: r["name"] for r in got.collect()} == want
