"""Prices of 0 and tables that the adaptive planner splits."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tickfold.operators import costs as C
from tickfold.operators import features as X
from tickfold.operators import inference as I
from tickfold.operators import sequential as S
from tickfold.operators import studies as T
from tickfold.operators import walkforward as W
from tickfold.plans.all_queries import ORACLES, QUERIES


def ohlc(spark, symbol, closes):
    rows = [(symbol, i, c, c + 1.0, c, c, 5, 3) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, bar_idx bigint, open double, high double, low double, close double, buy_dollar bigint, sell_dollar bigint")


def test_spread_of_a_zero_leg(spark):
    got = T.spread_bars(ohlc(spark, "a", [0.0, 2.0]), ohlc(spark, "b", [1.0, 0.0]), 0.5).orderBy("bar_idx").collect()
    assert got[0]["low"] == -math.inf and got[1]["high"] == math.inf and got[1]["open"] == math.inf


def test_costs_of_a_zero_price(spark):
    df = spark.createDataFrame([(0.0,), (200.0,)], "price double").withColumn("ts", F.expr("timestamp_ntz'2024-01-02 10:00:00'"))
    cost = lambda m: C.per_side_cost(F.lit(m), F.col("price"), F.col("ts"), F.lit("EURUSD"), 5e-4)
    got = df.select("price", C.equity_commission(F.col("price")).alias("c"), cost("fx").alias("fx"), cost("equity").alias("eq")).orderBy("price").collect()
    assert got[0]["c"] == got[0]["fx"] == got[0]["eq"] == math.inf
    assert got[1]["c"] == pytest.approx(0.0035 / 200) and math.isfinite(got[1]["fx"])


@pytest.mark.parametrize("name", ["trade_costs", "equity_costs"])
def test_costs_of_odd_prices_are_those_of_sql(spark, tmp_path, name):
    """A price of -0, which rounding makes of a small negative one, once cost as much as one of 0."""
    prices = [-0.0, 0.0, -0.004, 1e-5, 5.12, 200.0, math.inf, -math.inf, math.nan, None]
    rows = [(i, ts, kind, v) for i, (v, ts, kind) in enumerate((v, ts, kind) for v in prices for ts in ("09:45", "15:50", "22:10") for kind in ("click", "view", "error", "signup", None))]
    events = spark.createDataFrame(rows, "event_id bigint, t string, event_type string, value double")
    events.select("event_id", F.expr("cast('2024-01-02 ' || t || ':00' as timestamp_ntz)").alias("ts"), "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    plain = lambda rows: sorted(repr([v + 0.0 if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(QUERIES[name](spark, str(tmp_path)).select(*columns).collect()) == plain(want.fetchall())


def test_features_after_a_zero_close(spark):
    got = X.event_features(ohlc(spark, "a", [4.0, 2.0, 0.0, 3.0]), lags=(1,)).orderBy("bar_idx").collect()
    assert [r["momentum_1"] for r in got[1:]] == [pytest.approx(-math.log(2)), -math.inf, math.inf]
    assert math.isfinite(got[1]["vol"]) and math.isnan(got[2]["vol"]) and got[2]["range"] == got[3]["range"] == math.inf


@pytest.fixture
def splitting(spark):
    """Joins are planned by shuffle and become broadcast joins with local reads at run time."""
    confs = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "10m"}
    old = {k: spark.conf.get(f"spark.sql.{k}", None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(f"spark.sql.{k}", v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)


@pytest.mark.parametrize("kind", ["hybrid", "imbalance", "run"])
def test_a_symbol_stays_in_one_stream(splitting, kind):
    spark = splitting
    i = F.col("id")
    ticks = spark.range(40_000, numPartitions=8).select(
        (i % 3).cast("string").alias("symbol"), (i * 1000).alias("us"), "id", (i % 7 + 1.0).alias("price"), (i % 5 + 1).alias("volume"), (i % 11 + 1).alias("dollar"), (i % 3 == 0).alias("buy")
    )
    bars = S.hybrid_ids(ticks, 200, 10**9) if kind == "hybrid" else S.imbalance_ids(ticks, 200, kind=kind, weight="volume")
    starts = bars.groupBy("symbol", "bar_idx").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
    assert starts.where("(b - a) div 3 + 1 <> n").count() == 0
    # The stream has a shuffle of its own, which the adaptive planner never reads in parts.
    assert "REPARTITION_BY_COL" in bars._jdf.queryExecution().executedPlan().toString()


def test_books_are_summed_without_a_union(splitting):
    """Turnover is that of the plain loop where scores come from a join by fold, as they do in a walk."""
    spark = splitting
    scored = spark.range(8 * 30 * 12).select((F.col("id") % 8).cast("int").alias("fold"), (F.expr("id div 8") % 30).cast("int").alias("step"), F.expr("id div 240").alias("name"))
    scored = scored.join(spark.range(8).select(F.col("id").cast("int").alias("fold"), F.lit(0).alias("start"), F.lit(30).alias("stop")), "fold")
    scored = scored.withColumn("score", (F.col("name") * 7 + F.col("step") * F.col("fold") * 5) % 12 + F.col("name") / 100)
    returns = scored.where("fold = 0").select("name", "step", F.lit(0.0).alias("ret"), F.lit(0.0).alias("funding"))
    books = W.book_pnl(scored, returns, [(0.25, False, 0.0, 2)], 1.0, ["fold"])
    got = {(r["fold"], r["step"]): (r["turnover"], r["pnl"]) for r in books.collect()}
    want = {}
    for fold in range(8):
        was = {}
        for step in range(0, 30, 2):
            order = sorted(range(12), key=lambda n: ((n * 7 + step * fold * 5) % 12 + n / 100, n))
            now = {n: 1 / 3 for n in order[-3:]} | {n: -1 / 3 for n in order[:3]}
            want[fold, step] = sum(abs(now.get(n, 0) - was.get(n, 0)) for n in range(12))
            was = now
    assert all(got[k][0] == pytest.approx(v) and got[k][1] == pytest.approx(-v) for k, v in want.items())
    assert all(abs(got[k][0]) < 1e-12 for k in got if k not in want)
    assert "Union" not in books._jdf.queryExecution().executedPlan().toString()


def test_permutations_in_parts_are_those_of_one(spark, monkeypatch):
    i = F.col("id")
    panel = spark.range(300).select((i % 3).alias("date"), i.alias("name"), (i * 37 % 101 + 0.0).alias("x"), (i * 53 % 97 + 0.0).alias("y"))
    whole = I.permutation_null(panel, "x", "y", 50, 7).first()
    monkeypatch.setattr(I, "DEALT", 700)
    assert tuple(I.permutation_null(panel, "x", "y", 50, 7).first()) == pytest.approx(tuple(whole), abs=1e-12)
