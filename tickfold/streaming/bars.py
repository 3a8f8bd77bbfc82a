"""Bars of a stream of ticks with bounded state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BAR = "symbol string, bar_idx bigint, t_open bigint, t_close bigint, open double, high double, low double, close double, volume bigint, dollar bigint, n_base bigint"
_STATE = "bar_idx bigint, total bigint, t_open bigint, t_close bigint, open double, high double, low double, close double, volume bigint, dollar bigint, n_base bigint"


def windowed_bars(ticks: DataFrame, clock: str, width: str, late: str) -> DataFrame:
    """Clock bars of a stream with a timestamp column; ticks later than ``late`` behind are dropped."""
    at = F.struct("us", "id")
    return (
        ticks.withWatermark(clock, late)
        .groupBy(F.window(clock, width), "symbol")
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
            F.sum("volume").alias("volume"), F.sum("dollar").alias("dollar"), F.count("*").alias("n_base"),
        )
    )


def _threshold(limit: int):
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["us", "id"], kind="stable")
        bar: list[Any] | None = list(state.get) if state.exists else None
        out = []
        for r in rows.itertuples():
            total = (bar[1] if bar else 0) + int(r.dollar)
            idx = total // limit
            if bar is None or idx != bar[0]:
                if bar is not None:
                    out.append((key[0], bar[0], *bar[2:]))
                bar = [idx, total, int(r.us), int(r.us), r.price, r.price, r.price, r.price, int(r.volume), int(r.dollar), 1]
            else:
                bar = [idx, total, bar[2], int(r.us), bar[4], max(bar[5], r.price), min(bar[6], r.price), r.price, bar[8] + int(r.volume), bar[9] + int(r.dollar), bar[10] + 1]
        state.update(tuple(bar))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BAR.split(", ")])

    return step


def threshold_bars(ticks: DataFrame, limit: int) -> DataFrame:
    """Dollar bars of a stream: bar_idx = running dollars div ``limit``; a bar comes out when the next one opens.

    State is one open bar a symbol. Ticks of one batch are ordered; a tick that comes in a later batch than its
    successors counts where it comes.
    """
    return ticks.groupBy("symbol").applyInPandasWithState(_threshold(limit), BAR, _STATE, "append", GroupStateTimeout.NoTimeout)
