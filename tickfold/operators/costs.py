"""Trading calendars and costs of crypto, FX and equity as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ieee import over

# Half-spreads and their hour bands.
FX_HALF_SPREAD_PIPS = {
    "EURUSD": 0.10, "GBPUSD": 0.25, "USDJPY": 0.15, "USDCHF": 0.30, "USDCAD": 0.30, "AUDUSD": 0.20, "NZDUSD": 0.35, "EURGBP": 0.30,
}
FX_DEFAULT_PIPS = 0.40
FX_HOUR_BANDS = ((7, 12, 1.3), (12, 16, 1.0), (16, 21, 1.6), (21, 23, 3.0))
FX_OTHER_HOURS = 2.2
EQUITY_HALF_SPREAD_BP = {"SPY": 0.5, "QQQ": 0.5, "IWM": 1.0, "XLK": 1.5, "XLF": 1.5, "XLE": 2.0, "XLV": 2.0, "UVXY": 12.0, "VXX": 8.0}
EQUITY_DEFAULT_BP = 3.0
BORROW_A_YEAR = {"SPY": 0.005, "QQQ": 0.005, "IWM": 0.007, "XLK": 0.005, "XLF": 0.005, "XLE": 0.005, "XLV": 0.005, "UVXY": 0.05, "VXX": 0.05}
BORROW_DEFAULT = 0.01
EQUITY_MINUTE_BANDS = ((570, 600, 2.5), (945, 960, 1.8))
NIGHT_PIPS = 0.30


def _days(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 86400)


def _utc(ts: Column, of_instant: Column, of_clock: Column) -> Column:
    """``of_instant`` for instants, whose parts would follow the session's zone, and ``of_clock`` for clocks without a
    zone, which are UTC; the type is known when the query is planned."""
    return F.when(F.typeof(ts) == "timestamp", of_instant).otherwise(of_clock)


def weekday(ts: Column) -> Column:
    """0 for Monday to 6, in UTC."""
    return _utc(ts, F.pmod(_days(ts) + 3, F.lit(7)).cast("int"), F.weekday(ts))


def utc_hour(ts: Column) -> Column:
    return _utc(ts, F.pmod(F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600), F.lit(24)).cast("int"), F.hour(ts))


def utc_date(ts: Column) -> Column:
    return _utc(ts, F.date_from_unix_date(_days(ts).cast("int")), F.to_date(ts))


def fx_pip(pair: Column) -> Column:
    return F.when(F.upper(pair).endswith("JPY"), 0.01).otherwise(0.0001)


def fx_open(ts: Column) -> Column:
    """The FX week: closed on Saturday, before 22 h on Sunday and from 22 h on Friday (UTC)."""
    day, hour = weekday(ts), utc_hour(ts)
    return ~((day == 5) | ((day == 6) & (hour < 22)) | ((day == 4) & (hour >= 22)))


def with_force_flat(bars: DataFrame, most_gap_hours: float | None = None) -> DataFrame:
    """force_flat: an open bar whose next row isn't open, and the last. most_gap_hours: also one whose next
    row comes later than that, so that input without closed bars works too."""
    w = Window.partitionBy("symbol").orderBy("ts")
    is_open = fx_open(F.col("ts"))
    after = F.coalesce(F.lead(is_open).over(w), F.lit(False))
    if most_gap_hours is not None:
        seconds = F.unix_timestamp(F.lead("ts").over(w)) - F.unix_timestamp("ts")
        after = after & F.coalesce(seconds <= most_gap_hours * 3600, F.lit(False))
    return bars.withColumn("force_flat", is_open & ~after)


def with_rollover(bars: DataFrame) -> DataFrame:
    """rollover: the first bar of a UTC date from 21 h on. swap: its nights, three on a Wednesday, else 0."""
    ts = F.col("ts")
    late = utc_hour(ts) >= 21
    first = F.row_number().over(Window.partitionBy("symbol", utc_date(ts), late).orderBy("ts")) == 1
    rows = bars.withColumn("rollover", late & first)
    return rows.withColumn("swap", F.when(F.col("rollover"), F.when(weekday(ts) == 2, 3.0).otherwise(1.0)).otherwise(0.0))


def looked_up(key: Column, values: dict[str, float], default: float) -> Column:
    """The value of a name, in any case of letters."""
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(F.upper(key) == name, value).otherwise(out)
    return out


def night_cost(pair: Column) -> Column:
    """Cost of one night in price units, before the swap multiplier."""
    return F.lit(NIGHT_PIPS) * fx_pip(pair)


def fx_half_spread(pair: Column, ts: Column) -> Column:
    """Half the spread in price units."""
    base = looked_up(pair, FX_HALF_SPREAD_PIPS, FX_DEFAULT_PIPS)
    hour, band = utc_hour(ts), F.lit(FX_OTHER_HOURS)
    for lo, hi, times in FX_HOUR_BANDS:
        band = F.when((hour >= lo) & (hour < hi), times).otherwise(band)
    return base * band * fx_pip(pair)


def equity_half_spread_bp(ts_local: Column, ticker: Column | None = None) -> Column:
    """Half the spread in basis points; without a ticker, that of other tickers."""
    minute, band = F.hour(ts_local) * 60 + F.minute(ts_local), F.lit(1.0)
    for lo, hi, times in EQUITY_MINUTE_BANDS:
        band = F.when((minute >= lo) & (minute < hi), times).otherwise(band)
    return (F.lit(EQUITY_DEFAULT_BP) if ticker is None else looked_up(ticker, EQUITY_HALF_SPREAD_BP, EQUITY_DEFAULT_BP)) * band


def equity_commission(price: Column) -> Column:
    """Commission as a fraction of the traded value; infinite at a price of 0."""
    return F.greatest(over(F.lit(0.0035), price), F.lit(0.35 / 25000))


def borrow_per_day(ticker: Column) -> Column:
    """A short position's cost of a calendar day as a fraction."""
    return looked_up(ticker, BORROW_A_YEAR, BORROW_DEFAULT) / 365


def per_side_cost(market: Column, price: Column, ts: Column, name: Column, flat: float) -> Column:
    """Cost of one side as a fraction of the price: crypto ``flat``; FX half-spread; equity half-spread and commission."""
    equity = equity_half_spread_bp(ts, name) * 1e-4 + equity_commission(price)
    return F.when(market == "crypto", flat).when(market == "fx", over(fx_half_spread(name, ts), price)).otherwise(equity)


def discretised(size: Column, step: float) -> Column:
    """Bet size in steps, halves to even, within -1 and 1."""
    return F.greatest(F.least(F.rint(size / step) * step, F.lit(1.0)), F.lit(-1.0))


def bet_size(p: str, base: float = 0.5) -> str:
    """SQL: size of a bet of probability ``p`` (held within 1e-6 of 0 and 1) against ``base``."""
    from ..functions.normal import cdf

    held = f"least(greatest({p}, 1e-6), 1 - 1e-6)"
    return f"(2 * {cdf(f'(({held} - {base}) / sqrt({held} * (1 - {held})))')} - 1)"


def encoded(r: Column, edges: list[float] | None = None) -> dict[str, Column]:
    """Symbols of a return: binary (above 0), ternary (its sign) and, by edges, how many it reaches."""
    out = {"binary": (r > 0).cast("int"), "ternary": F.signum(r).cast("int")}
    if edges is not None:
        out["binned"] = sum((r >= e).cast("int") for e in edges)
    return out
