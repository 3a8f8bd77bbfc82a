"""Readers that bring price sources to one shape of base rows.

A base row has symbol, us (microseconds since 1970, UTC) and id (which breaks ties), price, volume, cents
(the price as an integer, for exact thresholds), dollar (cents times volume) and buy (true for a buyer's trade).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType


def micros(name: str) -> Column:
    """Microseconds since 1970 of a clock column without a time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")


def event_ticks(events: DataFrame) -> DataFrame:
    """The events table as trades: type is the symbol, value the price, ``k`` of props the volume; even k buys."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return events.select(
        F.col("event_type").alias("symbol"), micros("ts").alias("us"), F.col("event_id").alias("id"), F.col("value").alias("price"),
        k.alias("volume"), cents.alias("cents"), (cents * k).alias("dollar"), (k % 2 == 0).alias("buy"),
    )


def instant(at: Column) -> Column:
    """The instant that a clock without a zone shows in UTC, whatever the session's zone is."""
    return F.make_timestamp(F.year(at), F.month(at), F.day(at), F.hour(at), F.minute(at), F.date_part(F.lit("SECOND"), at), F.lit("UTC"))


def local_to_utc(at: Column, zone: str) -> Column:
    """UTC's clock for a local one (both without a zone). Local times that a change of the clock skips or repeats are null."""
    day, none = F.expr("interval '1' day"), F.lit(None)
    # The offsets before and after a change: what UTC's clock shows a day earlier and later, seen from the zone.
    tries = [at - (F.convert_timezone(F.lit("UTC"), F.lit(zone), u) - u) for u in (at - day, at + day)]
    before, after = (F.when(F.convert_timezone(F.lit("UTC"), F.lit(zone), t) == at, t) for t in tries)
    return F.when(before != after, none).otherwise(F.coalesce(before, after))


def clock(df: DataFrame, name: str) -> Column:
    """A timestamp from a column of timestamps, or of epoch numbers in seconds, milliseconds or microseconds."""
    kind = df.schema[name].dataType
    if isinstance(kind, TimestampNTZType):
        return instant(F.col(name))
    if isinstance(kind, TimestampType):
        return F.col(name)
    n = F.col(name).cast("bigint")
    return F.when(F.abs(n) < 100_000_000_000, F.timestamp_seconds(n)).when(F.abs(n) < 100_000_000_000_000, F.timestamp_millis(n)).otherwise(F.timestamp_micros(n))


def _once(df: DataFrame, keys: list[str], order: Column, last: bool = False) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order.desc() if last else order.asc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_klines(spark: SparkSession, path: str, symbol: str | None = None, keep_last: bool = False) -> DataFrame:
    """Crypto minute bars from parquet; the open time is a timestamp or epoch milliseconds.

    Rows need a positive close, volume and count. Of rows with one time, the first in the file stays (or the
    last). symbol: the name, or None where the table has a symbol column.
    """
    raw = spark.read.parquet(path)
    raw = raw.withColumn("symbol", F.lit(symbol)) if symbol else raw
    raw = raw.withColumn("_row", F.monotonically_increasing_id())
    bars = raw.select(
        "symbol", clock(raw, "open_time").alias("ts"), "_row",
        *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume", "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume")),
    )
    return _once(bars.where("close > 0 and volume > 0 and count > 0"), ["symbol", "ts"], F.col("_row"), keep_last).drop("_row")


def read_fx(spark: SparkSession, path: str, symbol: str, quote_by_price: bool = False) -> DataFrame:
    """FX minute bars; the clock is the first of key, open_time, time and datetime. Volumes are tick counts."""
    raw = spark.read.parquet(path)
    name = next(c for c in ("key", "open_time", "time", "datetime") if c in raw.columns)
    count = F.col("count").cast("double")
    raw = raw.withColumn("_row", F.monotonically_increasing_id())
    bars = raw.select(
        F.lit(symbol).alias("symbol"), clock(raw, name).alias("ts"), "_row", *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")),
        count.alias("volume"), (count * F.col("close") if quote_by_price else count).alias("quote_volume"), count.alias("count"),
        (count / 2).alias("taker_buy_volume"), (count / 2).alias("taker_buy_quote_volume"),
    )
    return _once(bars.where("close > 0 and count > 0"), ["symbol", "ts"], F.col("_row")).drop("_row")


def read_etf(spark: SparkSession, path: str, symbol: str, regular_hours: bool = True, zone: str = "America/New_York") -> DataFrame:
    """Equity minute bars from csv(.gz), whose columns are found by name. Regular hours: the naive clock is the zone's,
    09:30 up to 16:00, without times that a change of the clock skips or repeats; else it is taken as UTC.
    Rows without a readable time, a price, a volume or trades go; the session's zone plays no part."""
    numbers = "FirstTradePrice HighTradePrice LowTradePrice LastTradePrice VolumeWeightPrice Volume TotalTrades".split()
    raw = spark.read.csv(path, header=True, enforceSchema=False)
    raw = raw.select(F.col("BarDateTime").try_cast("timestamp_ntz").alias("_at"), *(F.col(c).try_cast("double").alias(c) for c in numbers))
    minute = F.hour("_at") * 60 + F.minute("_at")
    raw = raw.where((minute >= 570) & (minute < 960)).withColumn("_at", local_to_utc(F.col("_at"), zone)) if regular_hours else raw
    vwap = F.col("VolumeWeightPrice")
    quote = F.col("Volume") * F.when((vwap > 0) & (vwap < float("inf")), vwap).otherwise(F.col("LastTradePrice"))
    bars = raw.select(
        F.lit(symbol).alias("symbol"), instant(F.col("_at")).alias("ts"), F.col("FirstTradePrice").alias("open"), F.col("HighTradePrice").alias("high"),
        F.col("LowTradePrice").alias("low"), F.col("LastTradePrice").alias("close"), F.col("Volume").alias("volume"), quote.alias("quote_volume"),
        F.col("TotalTrades").alias("count"), (F.col("Volume") / 2).alias("taker_buy_volume"), (quote / 2).alias("taker_buy_quote_volume"),
    )
    return bars.where("ts is not null and close > 0 and volume > 0 and count > 0 and not (isnan(close) or isnan(volume) or isnan(count))")


def pnl_corpus(lineitem: DataFrame) -> DataFrame:
    """Strategy results as the long corpus (asset, strategy, date, pnl) with pnl in integer ten-thousandths."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    tilt = F.round(F.col("l_discount") * 100).cast("bigint") - 5
    return lineitem.select(
        F.col("l_returnflag").alias("asset"), F.col("l_suppkey").alias("strategy"), F.to_date("l_shipdate").alias("date"), (cents * tilt).alias("pnl")
    )


def live_and_delisted(live: DataFrame, delisted: DataFrame, key: str = "symbol") -> DataFrame:
    """Both listings; a live row wins over the delisted one of its symbol."""
    return live.unionByName(delisted.join(live.select(key), key, "left_anti"))
