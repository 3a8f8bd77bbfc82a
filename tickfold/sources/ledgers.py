"""Readers of runs and corpora as studies leave them: ledgers with their combos and cells, and corpora by asset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEDGER = "combo_id long, window_id long, phase int, bar_idx long, pnl_bp double"


def write_corpus(corpus: DataFrame, path: str) -> None:
    """A corpus (asset, strategy, date, pnl) as a folder for each asset, with the columns strategy_name, date and pnl_sum."""
    rows = corpus.select("asset", F.col("strategy").alias("strategy_name"), "date", F.col("pnl").alias("pnl_sum"))
    rows.repartition("asset", F.pmod(F.xxhash64("strategy_name"), F.lit(8))).write.partitionBy("asset").parquet(path)


def market_of_folder(name: Column) -> Column:
    """equity and fx by the ending of an asset's name, null for the legacy bundles (forex), else crypto."""
    low = F.lower(name)
    return F.when(low.endswith("_equity"), "equity").when(low.endswith("_fx"), "fx").when(low.contains("forex"), F.lit(None)).otherwise("crypto")


def read_corpus(spark: SparkSession, path: str, assets: Sequence[str] | None = None, market: str | None = None, most: int | None = None, seed: int = 7) -> DataFrame:
    """(asset, strategy, date, pnl) of the folders of ``assets`` or of a market (None: all); with ``most``, of that many
    strategies of an asset, the first by MD5 of (seed, strategy): as good as random, and the same each time.

    Assets are partitions: filters on them and on the market never open the other folders. A sample reads the
    names first and then joins: the results of strategies outside it are not shuffled.
    """
    rows = spark.read.parquet(path).withColumn("asset", F.col("asset").cast("string"))
    if assets is not None:
        rows = rows.where(F.col("asset").isin(list(assets)))
    if market is not None:
        rows = rows.where(market_of_folder(F.col("asset")) == market)
    rows = rows.select("asset", F.col("strategy_name").alias("strategy"), "date", F.col("pnl_sum").alias("pnl"))
    if most is None:
        return rows
    names = rows.select("asset", "strategy").distinct()
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("strategy").cast("string")).cast("binary"))
    place = F.row_number().over(Window.partitionBy("asset").orderBy(order, "strategy"))
    return rows.join(names.withColumn("_r", place).where(F.col("_r") <= most).drop("_r"), ["asset", "strategy"])


def _optional(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A run's ledger (run, combo_id, family, h, key, window_id, phase, bar_idx, pnl_bp): trades.parquet of a folder, with the
    combos' families and horizons from combos.parquet, or else from the folder's name (family_..._H8)."""
    run = path.rstrip("/").rpartition("/")[2]
    rows = spark.read.parquet(f"{path}/trades.parquet").select("combo_id", "window_id", "phase", "bar_idx", "pnl_bp")
    combos = _optional(spark, f"{path}/combos.parquet")
    if combos is None:
        end = run.rpartition("_H")[2] if "_H" in run else ""
        h = F.lit(int(end)) if end.isdigit() else F.lit(None).cast("int")
        rows = rows.withColumns({"family": F.lit(run.partition("_")[0]), "h": h})
    else:
        known = combos.select("combo_id", F.col("family").cast("string").alias("family"), F.col("H").cast("int").alias("h")).dropDuplicates(["combo_id"])
        rows = rows.join(known, "combo_id", "left").withColumn("family", F.coalesce("family", F.lit("?")))
    key = F.concat_ws("::", F.lit(run), "family", F.coalesce(F.concat(F.lit("H"), F.col("h")), F.concat(F.lit("c"), F.col("combo_id"))))
    return rows.select(F.lit(run).alias("run"), "combo_id", "family", "h", key.alias("key"), "window_id", "phase", "bar_idx", "pnl_bp")


def phase_windows(ledger: DataFrame) -> DataFrame:
    """(run, combo_id, window_id, inside, outside): net results of each window's phases; null where one has no rows."""
    of = lambda p: F.sum(F.when(F.col("phase") == p, F.col("pnl_bp")))
    return ledger.groupBy("run", "combo_id", "window_id").agg(of(0).alias("inside"), of(1).alias("outside"))


def combo_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row for each combo of the runs: run, combo_id, key, family, h, bars (out of sample), gains and losses there (of
    cells.parquet where a run has it, else of the bars), rebalances (null without cells) and net inside and outside."""
    out = None
    for path in paths:
        ledger, cells = read_run(spark, path), _optional(spark, f"{path}/cells.parquet")
        x, after = F.col("pnl_bp"), F.col("phase") == 1
        rows = ledger.groupBy("run", "combo_id", "key", "family", "h").agg(
            F.count_if(after).alias("bars"), F.sum(F.when(after, F.greatest(x, F.lit(0.0))).otherwise(0.0)).alias("gains"), F.sum(F.when(after, F.greatest(-x, F.lit(0.0))).otherwise(0.0)).alias("losses"),
            F.sum(F.when(~after, x)).alias("inside"), F.sum(F.when(after, x)).alias("outside"),
        )
        turns = F.lit(None).cast("long")
        if cells is not None:
            n = F.sum("n_reb") if "n_reb" in cells.columns else F.lit(0)
            known = cells.where("phase = 1").groupBy("combo_id").agg(F.sum("pos_bp").alias("_g"), F.sum("neg_bp").alias("_l"), n.cast("long").alias("_n"))
            rows = rows.join(known, "combo_id", "left").withColumns({"gains": F.coalesce("_g", F.lit(0.0)), "losses": F.coalesce("_l", F.lit(0.0))})
            turns = F.coalesce("_n", F.lit(0).cast("long"))
        rows = rows.select("run", "combo_id", "key", "family", "h", "bars", "gains", "losses", turns.alias("rebalances"), "inside", "outside")
        out = rows if out is None else out.unionByName(rows)
    return out
