"""Learners walked forward, tuned and tested against plain loops, other libraries and planted answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickfold.operators import ferns as N
from tickfold.operators import logistic as L
from tickfold.operators import overfit as O
from tickfold.operators import sequential as S
from tickfold.operators import walkforward as W

PANEL = "name string, date int, ret double, funding double, f double, g double"
KNOBS = ((0.2, False, 0.5, 1), (0.4, True, 0.0, 3))
H, INSIDE, SELECT, STEP, COST, PENALTIES = 2, 30, 10, 8, 1e-3, (0.1, 5.0)


def made_panel(seed=0, dates=60, names=12):
    rng = random.Random(seed)
    rows = []
    for t in range(dates):
        for i in range(names):
            if rng.random() < 0.9:
                f, g = rng.uniform(-1, 1), rng.uniform(-1, 1)
                rows.append((f"n{i:02}", 3 * t, 0.01 * f + rng.gauss(0, 0.02), rng.gauss(0, 1e-3), f, g))
    return rows


def plain_books(score, ret, fund, start, stop, knob):
    q, long, tilt, reb = knob
    pnl, turnover, held = {}, {}, {}
    for t in range(start, stop):
        gain = sum(w * (ret.get((n, t), 0.0) - fund.get((n, t), 0.0)) for n, w in held.items())
        change = 0.0
        if (t - start) % reb == 0:
            new, s = {}, sorted((v, n) for (n, u), v in score.items() if u == t)
            if len(s) >= 4:
                k = max(min(math.floor(q * len(s)), len(s) if long else len(s) // 2), 1)
                for leg, part in ((1, s[-k:]), (-1, [] if long else s[:k])):
                    mean = sum(v for v, _ in part) / k if part else 0
                    u = {n: max(1 + tilt * leg * (v - mean), 0.1) for v, n in part}
                    new |= {n: leg * x / sum(u.values()) for n, x in u.items()}
            change = sum(abs(new.get(n, 0) - held.get(n, 0)) for n in {*new, *held})
            held = new
        pnl[t] = gain - COST * change
    return pnl


def plain_walk(rows):
    dates = sorted({r[1] for r in rows})
    step = {d: i for i, d in enumerate(dates)}
    ret, fund = {(r[0], step[r[1]]): r[2] for r in rows}, {(r[0], step[r[1]]): r[3] for r in rows}
    x = {(r[0], step[r[1]]): np.array(r[4:6]) for r in rows}
    own, label, end = {}, {}, {}
    for n, t in sorted(x, key=lambda k: (k[0], k[1])):
        own.setdefault(n, []).append(t)
    ahead = {}
    for n, ts in own.items():
        for i, t in enumerate(ts):
            if i + H < len(ts):
                ahead[n, t] = sum(ret[n, u] for u in ts[i + 1 : i + H + 1])
                end[n, t] = ts[i + H]
    for t in range(len(dates)):
        s = sorted((v, n) for (n, u), v in ahead.items() if u == t)
        if len(s) >= 4:
            label |= {(n, t): 2 * k / (len(s) - 1) - 1 for k, (_, n) in enumerate(s)}
    ledger, choices = {}, {}
    for fold in range((len(dates) - INSIDE) // STEP):
        a, b = fold * STEP, fold * STEP + INSIDE

        def fit(edge, penalty, a=a):
            use = [k for k in label if a <= k[1] < edge and end[k] < edge]
            m, y = np.array([x[k] for k in use]), np.array([label[k] for k in use])
            return np.linalg.solve(m.T @ m + penalty * len(use) * np.eye(2), m.T @ y)

        tried = []
        for s, penalty in enumerate(PENALTIES):
            beta = fit(b - SELECT, penalty)
            score = {k: round(float(v @ beta), 10) for k, v in x.items()}
            for i, knob in enumerate(KNOBS):
                p = np.array(list(plain_books(score, ret, fund, b - SELECT, b, knob).values()))
                tried.append((-round(p.mean() / p.std() * math.sqrt(252), 9), s, i))
        choices[fold] = min(tried)
        _, s, i = min(tried)
        beta = fit(b, PENALTIES[s])
        score = {k: round(float(v @ beta), 10) for k, v in x.items()}
        for phase, (start, stop) in enumerate(((a, b), (b, b + STEP))):
            ledger |= {(fold, phase, t): p for t, p in plain_books(score, ret, fund, start, stop, KNOBS[i]).items() if p}
    return choices, ledger


def walk(spark, rows):
    choices, ledger = W.walk_forward_books(spark.createDataFrame(rows, PANEL), ["f", "g"], PENALTIES, KNOBS, H, INSIDE, SELECT, STEP, COST)
    return {r["fold"]: (-r["sharpe"], r["setting"], r["knob"]) for r in choices.collect()}, {(r["fold"], r["phase"], r["step"]): r["pnl"] for r in ledger.collect()}


@pytest.fixture(scope="module")
def walked(spark):
    return walk(spark, made_panel())


def test_ledger_of_a_plain_loop(walked):
    choices, ledger = plain_walk(made_panel())
    assert {f: c[1:] for f, c in walked[0].items()} == {f: c[1:] for f, c in choices.items()} and len(choices) == 3
    assert walked[1].keys() == ledger.keys()
    assert all(abs(walked[1][k] - v) < 1e-9 for k, v in ledger.items())


def test_a_poisoned_future_changes_nothing_before(spark, walked):
    edge = INSIDE + STEP  # the end of fold 0, and of fold 1's dates inside
    rows = [(n, d, *((99.0, 5.0, -9.0, 9.0) if d >= 3 * edge else rest)) for n, d, *rest in made_panel()]
    choices, ledger = walk(spark, rows)
    assert [choices[f] for f in (0, 1)] == [walked[0][f] for f in (0, 1)] and choices[2] != walked[0][2]
    before = lambda x: {k: v for k, v in x.items() if k[0] == 0}
    assert before(ledger) == pytest.approx(before(walked[1]), abs=1e-12)


def test_too_few_dates(spark):
    choices, ledger = walk(spark, [r for r in made_panel() if r[1] < 3 * INSIDE])
    assert not choices and not ledger


def test_logistic_folds_are_those_of_spark_ml(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(2)
    rows = []
    for s in ("a", "b"):
        for i in range(200):
            x, z = rng.gauss(0, 1), rng.gauss(0, 2)
            rows.append((s, i, x, z, int(rng.random() < 1 / (1 + math.exp(-(x - 0.5 * z + (s == "b")))))))
    df = spark.createDataFrame([*rows, ("a", 900, None, 1.0, 1), ("c", 0, 1.0, 1.0, 1)], "symbol string, bar_idx int, x double, z double, y int")
    dealt = L.expanding_folds(df.dropna(), 3, 4, 20)
    kept = {(r["symbol"], r["bar_idx"]): (r["trains"], r["tests"]) for r in dealt.collect()}
    for s in ("a", "b"):
        for i in range(200):
            trains, tests = kept[s, i]
            assert trains == [f for f in range(4) if i < (f + 1) * 40]
            assert tests == [f for f in range(4) if (f + 1) * 40 + 3 <= i < (f + 3) * 40 and (i - (f + 1) * 40 - 3) % 3 == 0]
    assert kept["c", 0] == ([], [])
    got = {(r["symbol"], r["fold"]): r["beta"] for r in L.logistic_fits(dealt, ["symbol"], ["x", "z"], "y").collect()}
    assert len(got) == 8
    for s, f in (("a", 0), ("b", 3)):
        part = VectorAssembler(inputCols=["x", "z"], outputCol="v").transform(df.where((F.col("symbol") == s) & (F.col("bar_idx") < (f + 1) * 40)))
        model = LogisticRegression(featuresCol="v", labelCol="y", regParam=1 / ((f + 1) * 40), standardization=False, tol=1e-12, maxIter=200).fit(part)
        assert got[s, f] == pytest.approx([model.intercept, *model.coefficients], abs=1e-6)


def leaky_events(spark, h):
    """Labels of the next h steps of a random walk, and a feature that is one draw for each stretch of 12 rows."""
    rng = random.Random(5)
    walk = [0.0]
    for _ in range(700):
        walk.append(walk[-1] + rng.gauss(0, 1))
    rows = [("a", i, i + h, int(walk[i + h] > walk[i]), *(random.Random(f"{k}:{i // 12}").gauss(0, 1) for k in range(6))) for i in range(600)]
    return spark.createDataFrame(rows, "symbol string, ev_idx int, end_idx int, y int, " + ", ".join(f"x{k} double" for k in range(6)))


def test_a_leak_shows_under_standard_folds_only(spark):
    names = [f"x{k}" for k in range(6)]
    found = {r["scheme"]: r for r in N.fold_leak_study(leaky_events(spark, 20), names, "y", k=40, groups=6, embargo=12, ferns=30, depth=5).collect()}
    assert found["standard"]["auc"] > found["purged"]["auc"] + 0.1 and found["standard"]["accuracy"] > found["purged"]["accuracy"]
    assert abs(found["combinatorial"]["auc"] - 0.5) < 0.15 and found["combinatorial"]["splits"] == 15


def test_tuning_goes_on_where_it_stopped(spark, tmp_path):
    events = leaky_events(spark, 2)
    names, settings = [f"x{k}" for k in range(6)], [(1, 1.0), (3, 1.0), (3, 9.0)]
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    whole = rows(N.tune_ferns(events, names, "y", settings, path=None))
    N.tune_ferns(events, names, "y", settings[:2], path=str(tmp_path / "grid")).count()
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "grid").rglob("*.parquet")}
    assert rows(N.tune_ferns(events, names, "y", settings, path=str(tmp_path / "grid"))) == whole
    assert all(p.stat().st_mtime_ns == t for p, t in stamps.items())
    assert sum(r[-2] for r in whole) == sum(r[-1] for r in whole) == 1 and len(whole) == 3


def test_groups_of_planted_copies_and_their_importance(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append(("s", i, i + 1, int(a + 0.3 * rng.gauss(0, 1) > 0), a, a + 0.1 * rng.gauss(0, 1), b, b + 0.1 * rng.gauss(0, 1), rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "symbol string, ev_idx int, end_idx int, y int, a double, a2 double, b double, b2 double, c double")
    names = ["a", "a2", "b", "b2", "c"]
    groups = N.linked_features(df, names)
    assert groups == [["a", "a2"], ["b", "b2"], ["c"]]
    got = {r["feature_group"]: r for r in N.group_importance(df, names, "y", groups, 5, 1).collect()}
    assert got["a,a2"]["accuracy_gain"] > 0.2 and got["a,a2"]["loss_gain"] > 0.1
    assert all(abs(got[g]["accuracy_gain"]) < 0.03 and got[g]["n"] == 1500 for g in ("b,b2", "c"))


def test_scores_of_ferns_are_those_of_a_plain_count(spark):
    events = leaky_events(spark, 3).limit(120)
    names, drawn = ["x0", "x1", "x2"], N.draw_ferns(["x0", "x1", "x2"], 4, 2)
    rows = events.withColumns({"trains": F.when(F.col("ev_idx") < 80, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>")), "tests": F.array(F.lit("f")), "cells": N.cells(drawn)})
    got = {(r["ev_idx"], r["prior"]): r["p"] for r in N.fern_scores(rows, N.fern_fits(rows, ["symbol"], "y"), ["symbol"], "ev_idx", "y", [1.0, 3.0]).collect()}
    data = [(r["ev_idx"], r["y"], [sum((r[f] > c) << k for k, (f, c) in enumerate(fern)) for fern in drawn]) for r in events.select("ev_idx", "y", *names).collect()]
    for i, _, cell in data:
        for p, prior in enumerate((1.0, 3.0)):
            means = []
            for j, c in enumerate(cell):
                hits = [y for t, y, other in data if t < 80 and other[j] == c]
                means.append((sum(hits) + prior) / (len(hits) + 2 * prior))
            assert got[i, p] == pytest.approx(sum(means) / len(means))


def test_spectrum_of_a_small_corpus(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 9)) @ rng.normal(size=(9, 9)) * 100
    x[rng.random(x.shape) < 0.3] = 0
    x = np.rint(x)
    rows = [("a", f"s{j}", int(i), int(x[i, j])) for i in range(40) for j in range(9) if x[i, j]] + [("a", "flat", i, 0) for i in range(40)]
    corpus = spark.createDataFrame(rows, "asset string, strategy string, date int, pnl long")
    values = np.linalg.eigvalsh(np.corrcoef(x.T))
    share = values / values.sum()
    got = O.spectrum(corpus).first()
    assert (got["asset"], got["strategies"], got["days"]) == ("a", 9, 40)
    assert got["participation"] == pytest.approx(1 / (share**2).sum()) and got["entropy_number"] == pytest.approx(np.exp(-(share * np.log(share)).sum()))
    assert got["top_share"] == pytest.approx(share.max())
    assert O.effective_strategies(corpus).first()["effective"] == pytest.approx(got["participation"])


def dense_draws(start, end, uniforms):
    cover = np.zeros((len(start), end.max() + 1))
    for i, (a, b) in enumerate(zip(start, end)):
        cover[i, a : b + 1] = 1
    held, drawn = np.zeros(cover.shape[1]), []
    for u in uniforms:
        odds = (cover / (held + 1)).sum(1) / cover.sum(1)
        drawn.append(min(int(np.searchsorted(np.cumsum(odds), u * odds.sum())), len(start) - 1))
        held += cover[drawn[-1]]
    chosen = cover[drawn]
    return drawn, float(((chosen / np.maximum(chosen.sum(0), 1)).sum(1) / chosen.sum(1)).mean())


@pytest.mark.parametrize("seed", range(4))
def test_draws_of_the_dense_form(seed):
    rng = np.random.default_rng(seed)
    n = (1, 7, 60, 200)[seed]
    start = np.sort(rng.integers(0, 3 * n, n))
    end = start + rng.integers(0, 25, n)
    uniforms = rng.random(n)
    draws = S.SpanDraws(start, end)
    drawn = [draws.draw(u) for u in uniforms]
    want, uniqueness = dense_draws(start - start.min(), end - start.min(), uniforms)
    assert drawn == want and draws.uniqueness(np.array(drawn)) == pytest.approx(uniqueness)


def test_a_hundred_thousand_spans():
    import resource

    rng = np.random.default_rng(9)
    start = np.sort(rng.integers(0, 400_000, 100_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    draws = S.SpanDraws(start, start + rng.integers(0, 40, 100_000))
    drawn = np.array([draws.draw(u) for u in rng.random(20_000)])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB
    assert draws.uniqueness(drawn) > draws.uniqueness(rng.integers(0, 100_000, 20_000))


def test_importance_in_buckets_finds_what_the_label_follows(spark, monkeypatch):
    """Shuffling within buckets, with many repeated rows, costs accuracy only for the feature that the label follows."""
    from tickfold.operators import features

    monkeypatch.setattr(features, "SHUFFLED", 100)
    rows = spark.range(2000).select((F.abs(F.hash("id")) % 20).cast("double").alias("a"), (F.abs(F.xxhash64("id")) % 20).cast("double").alias("b"))
    rows = rows.withColumn("y", (F.col("a") >= 10).cast("double"))
    got = {r["feature"]: r for r in features.forest_importance(rows, ["a", "b"], "y").collect()}
    assert got["a"]["mda"] > 0.3 and abs(got["b"]["mda"]) < 0.05 and got["a"]["mdi"] > 0.8


def test_importance_of_infinite_features(spark):
    """Logarithms of a price of 0 are infinite: such rows count, above or below all others, and don't end the query."""
    from tickfold.operators import features

    inf = float("inf")
    rows = spark.range(2000).select((F.abs(F.hash("id")) % 20).cast("double").alias("a"), (F.abs(F.xxhash64("id")) % 20).cast("double").alias("b"))
    rows = rows.withColumn("a", F.when(F.col("a") >= 10, inf).when(F.col("a") < 3, -inf).when(F.col("a") == 5, float("nan")).otherwise(F.col("a")))
    rows = rows.withColumn("y", (F.col("a") == inf).cast("double"))
    got = {r["feature"]: r for r in features.forest_importance(rows, ["a", "b"], "y").collect()}
    assert got["a"]["mda"] > 0.3 and abs(got["b"]["mda"]) < 0.05 and got["a"]["mdi"] > 0.8


def test_forest_scores_writes_its_rows_once(spark, monkeypatch):
    from tickfold.operators import studies as T

    calls, keep = [], T.cut
    monkeypatch.setattr(T, "cut", lambda df: calls.append(1) or keep(df))
    rows = [(i, float(i % 7), float(i % 7 > 3), i % 2, [1 - i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v double, y double, fold int, trains array<int>")
    got = T.forest_scores(df, ["v"], "y", 2, trees=2, depth=2).collect()
    assert len(calls) == 1 and len(got) == 60 and all((r["p"] > 0.5) == (r["y"] == 1) for r in got)
