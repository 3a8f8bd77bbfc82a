"""Factors beside their confounders: pooled regressions by sweeping one moment matrix, and event windows with controls."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .panel import by_name

#: |t| from which a slope counts.
SIGNIFICANT = 1.96

#: Digests of events and controls that one task makes.
HASHES = 4_000_000


def compounded(k: int, ret: str = "ret") -> Column:
    """The return over a name's k rows before this one; null where one lacks, or lost everything."""
    w = by_name().rowsBetween(-k, -1)
    logs = F.when(F.col(ret) > -1, F.log1p(ret))
    return F.when(F.count(logs).over(w) == k, F.exp(F.sum(logs).over(w)) - 1)


def deviation(k: int, ret: str = "ret") -> Column:
    """The sample deviation of a name's k rows before this one; null where one lacks."""
    w = by_name().rowsBetween(-k, -1)
    return F.when(F.count(ret).over(w) == k, F.stddev_samp(ret).over(w))


def with_confounders(panel: DataFrame, keys: Sequence[str], span: int = 21) -> DataFrame:
    """driver: the mean return of the keys' names on the date; regime: the mean over the ``span`` dates before of the names'
    deviation on a date, null where one lacks. The dates of a key are a small table with a row each."""
    days = panel.groupBy(*keys, "date").agg(F.avg("ret").alias("driver"), F.stddev_samp("ret").alias("_sd"))
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-span, -1)
    days = days.withColumn("regime", F.when(F.count("_sd").over(w) == span, F.avg("_sd").over(w))).drop("_sd")
    return panel.join(days, [*keys, "date"])


def _swept(m: dict[tuple[str, str], Column], names: Sequence[str], by: str) -> dict[tuple[str, str], Column]:
    """Products of what is left of ``names`` after a regression on ``by``, from products of them all."""
    at = lambda a, b: m[tuple(sorted((a, b)))]
    return {(a, b): at(a, b) - F.try_divide(at(a, by) * at(b, by), at(by, by)) for i, a in enumerate(sorted(names)) for b in sorted(names)[i:]}


def _slope_t(m: dict[tuple[str, str], Column], n: Column, used: int) -> tuple[Column, Column]:
    xx, xy, yy = m["x", "x"], m["x", "y"], m["y", "y"]
    rest = yy - F.try_divide(xy * xy, xx)
    return F.try_divide(xy, xx), F.when((xx > 1e-18) & (rest > 1e-18) & (n > used), xy / xx / F.sqrt(rest / xx / (n - used)))


def factor_panel_test(rows: DataFrame, keys: Sequence[str], least: int = 60) -> DataFrame:
    """Per key, of y on a factor x with confounders c and d: naive slope and t, those beside c, beside d and beside both,
    and what c does to the verdict (|t| above 1.96): spurious_killed, suppression_revealed or none; attenuation, the share
    of |t| that c takes; sign_consistency, the share of names whose own slope has the pooled sign; and ratio, mean over
    deviation of the dates' means of sign(x) y. rows: keys, name, date, x, y, c, d; slopes are per deviation of x.

    Names of fewer than ``least`` complete rows are left out. One aggregation by (key, name) is all that reads the
    rows for the slopes: covariances of names are joined to pooled ones, and controls are swept from the matrix.
    """
    at = ["x", "y", "c", "d"]
    pairs = [(a, b) for i, a in enumerate(sorted(at)) for b in sorted(at)[i:]]
    rows = rows.dropna(subset=at)
    own = rows.groupBy(*keys, "name").agg(
        F.count("*").alias("n"), *(F.avg(a).alias(f"m{a}") for a in at), *(F.covar_pop(a, b).alias(f"v{a}{b}") for a, b in pairs)
    ).where(F.col("n") >= least)
    n = F.sum("n")
    mean = {a: F.sum(F.col("n") * F.col(f"m{a}")) / n for a in at}
    shared = own.groupBy(*keys).agg(n.alias("_n"), *(mean[a].alias(f"_m{a}") for a in at))
    met = own.join(shared, list(keys))
    # Pooled: within names, plus between their means around the pooled mean.
    between = lambda a, b: (F.col(f"m{a}") - F.col(f"_m{a}")) * (F.col(f"m{b}") - F.col(f"_m{b}"))
    pooled = met.groupBy(*keys).agg(
        n.alias("n"), F.count("*").alias("names"), *(F.sum(F.col("n") * (F.col(f"v{a}{b}") + between(a, b))).alias(f"s{a}{b}") for a, b in pairs),
        F.count_if(F.col("vxy") > 0).alias("_up"), F.count_if(F.col("vxy") < 0).alias("_down"), F.count_if(F.col("vxy") == 0).alias("_flat"),
    )
    m, size = {p: F.col(f"s{p[0]}{p[1]}") for p in pairs}, F.col("n")
    by_c, by_d = _swept(m, ["x", "y", "d"], "c"), _swept(m, ["x", "y"], "d")
    both = _swept(by_c, ["x", "y"], "d")
    scale = F.sqrt(F.col("sxx") / (size - 1))
    out = [F.col("n"), F.col("names")]
    for name, table, used in (("naive", m, 2), ("driver", by_c, 3), ("regime", by_d, 3), ("both", both, 4)):
        b, t = _slope_t(table, size, used)
        out += [(b * scale).alias(f"{name}_slope"), t.alias(f"{name}_t")]
    sign = F.signum("sxy")
    agree = F.when(sign >= 0, F.col("_up")).otherwise(F.col("_down"))
    found = pooled.select(*keys, *out, (agree / F.col("names")).alias("sign_consistency"))
    naive, left = F.coalesce(F.abs("naive_t") > SIGNIFICANT, F.lit(False)), F.coalesce(F.abs("driver_t") > SIGNIFICANT, F.lit(False))
    kind = F.when(naive & ~left, "spurious_killed").when(left & ~naive, "suppression_revealed").otherwise("none")
    found = found.withColumns({"flip": kind, "attenuation": (F.abs("naive_t") - F.abs("driver_t")) / (F.abs("naive_t") + 1e-12)})
    kept = rows.join(own.select(*keys, "name"), [*keys, "name"])
    days = kept.groupBy(*keys, "date").agg(F.avg(F.signum("x") * F.col("y")).alias("_r"))
    return found.join(days.groupBy(*keys).agg(F.try_divide(F.avg("_r"), F.stddev_samp("_r")).alias("ratio"), F.count("*").alias("dates")), list(keys))


def matched_controls(events: DataFrame, controls: DataFrame, seed: int) -> DataFrame:
    """(event, name, day): each event's day with the control that comes first by MD5 of (seed, event, control).

    Every event is hashed with every control, as nothing less tells the first; a task takes about ``HASHES`` of them, of
    some events and some controls, and sends on one control an event."""
    events = cut(events)
    kinds = dict(events.dtypes)["event"], dict(controls.dtypes)["name"]

    def dealt(rows: DataFrame, of: str, tag: str, size: int) -> DataFrame:
        rows = rows.select(of).where(F.col(of).isNotNull()).distinct()
        part = F.pmod(F.xxhash64(of), F.lit(max(1, -(-rows.count() // size))))
        lists = rows.groupBy(part.alias("_p")).agg(F.collect_list(F.struct(F.col(of).cast("string").alias("t"), F.col(of).alias("v"))).alias("_l"))
        return lists.select(F.col("_l.t").alias(f"{tag}t"), F.col("_l.v").alias(f"{tag}v"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for et, ev, ct, cv in p[["et", "ev", "ct", "cv"]].itertuples(index=False):
                texts, found = [t.encode() for t in ct], []
                for t in et:
                    start, digests = hashlib.md5(f"{seed}:{t}:".encode()), []
                    for c in texts:
                        h = start.copy()
                        h.update(c)
                        digests.append(h.digest())
                    i = min(range(len(digests)), key=digests.__getitem__)
                    found.append((digests[i].hex(), cv[i]))
                yield pd.DataFrame({"event": list(ev), "_k": [k for k, _ in found], "name": [v for _, v in found]})

    side = math.isqrt(HASHES)
    met = dealt(events, "event", "e", side).crossJoin(dealt(controls, "name", "c", side))
    tasks = max(1, -(-events.count() * controls.count() // HASHES))
    best = met.repartition(tasks).mapInPandas(kernel, f"event {kinds[0]}, _k string, name {kinds[1]}")
    best = best.groupBy("event").agg(F.min_by("name", F.struct("_k", "name")).alias("name"))
    return events.select("event", "day").join(best, "event").select("event", "name", "day")


def event_windows(events: DataFrame, daily: DataFrame, width: int = 60, least: int = 20) -> DataFrame:
    """(event, side, name, day, ret): the last ``width`` rows of an event's name before its day (side pre), and the first
    from that day on (post); events with fewer than ``least`` rows on a side have none.

    Rows are numbered along their name and events placed among them by one running count, so an event is joined to
    the numbers that it wants: no row is compared with an event whose window it isn't in, however long a name's
    history and however many events share a name. events: event, name, day; daily: name, day, ret.
    """
    rows = daily.where("ret is not null").select("name", "day", "ret", F.row_number().over(Window.partitionBy("name").orderBy("day")).alias("_i"))
    marks = rows.select("name", "day", F.lit(None).cast(dict(events.dtypes)["event"]).alias("event"), F.lit(1).alias("_row"))
    both = marks.unionByName(events.select("name", "day", "event", F.lit(0).alias("_row")))
    before = F.sum("_row").over(Window.partitionBy("name").orderBy("day", "_row").rowsBetween(Window.unboundedPreceding, 0))
    total = rows.groupBy("name").agg(F.max("_i").alias("_n"))
    placed = both.withColumn("_b", before).where("_row = 0").join(total, "name").where((F.col("_b") >= least) & (F.col("_n") - F.col("_b") >= least))
    low, high = F.greatest(F.col("_b") - width + 1, F.lit(1)), F.least(F.col("_b") + width, F.col("_n"))
    wanted = placed.select("event", "name", "_b", F.explode(F.sequence(low, high)).alias("_i"))
    return wanted.join(rows, ["name", "_i"]).select("event", F.when(F.col("_i") <= F.col("_b"), "pre").otherwise("post").alias("side"), "name", "day", "ret")


def discontinuity(windows: DataFrame, keys: Sequence[str], k: int = 5, least: int = 8) -> DataFrame:
    """Per key: n, slope and t of ret on the return over the k rows before, pooled over events before (pre) and after
    (post), and of their difference: the factor is standardised and lagged within each event's side; sides with fewer
    than ``least`` rows, or no deviation, are left out."""
    part = [*keys, "event", "side"]
    w = Window.partitionBy(*part).orderBy("day").rowsBetween(-k, -1)
    logs = F.when(F.col("ret") > -1, F.log1p("ret"))
    rows = windows.withColumn("_x", F.when(F.count(logs).over(w) == k, F.exp(F.sum(logs).over(w)) - 1)).where("_x is not null")
    one = rows.groupBy(*part).agg(F.count("*").alias("n"), F.stddev_samp("_x").alias("sd"), F.covar_pop("_x", "ret").alias("xy"), F.avg("ret").alias("my"), F.avg(F.col("ret") * F.col("ret")).alias("yy"))
    one = one.where((F.col("n") >= least) & (F.col("sd") > 0))
    # A standardised factor has mean 0 on each side of an event, so products add up.
    n = F.col("n")
    sums = one.groupBy(*keys, "side").agg(
        F.sum(n).alias("n"), F.sum(n - 1).cast("double").alias("xx"), F.sum(n * F.col("xy") / F.col("sd")).alias("xy"), F.sum(n * F.col("my")).alias("y"), F.sum(n * F.col("yy")).alias("yy")
    )
    rest = F.col("yy") - F.col("y") * F.col("y") / n - F.col("xy") * F.col("xy") / F.col("xx")
    sides = sums.select(*keys, "side", "n", "xx", (F.col("xy") / F.col("xx")).alias("b"), rest.alias("rest"))
    of = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = sides.groupBy(*keys).agg(*(of(c, s).alias(f"{c}_{s}") for s in ("pre", "post") for c in ("n", "xx", "b", "rest")))
    t = lambda s: F.when(F.col(f"n_{s}") > 2, F.col(f"b_{s}") / F.sqrt(F.col(f"rest_{s}") / F.col(f"xx_{s}") / (F.col(f"n_{s}") - 2)))
    whole = (F.col("rest_pre") + F.col("rest_post")) / (F.col("n_pre") + F.col("n_post") - 4)
    gap = F.col("b_post") - F.col("b_pre")
    return wide.select(
        *keys, "n_pre", "n_post", "b_pre", t("pre").alias("t_pre"), "b_post", t("post").alias("t_post"), gap.alias("b_gap"), (gap / F.sqrt(whole * (1 / F.col("xx_pre") + 1 / F.col("xx_post")))).alias("t_gap")
    )
