"""What chance alone would give: random books from a pool, and factors whose blocks are dealt anew. Draws are rows, drawn by
the order of MD5 digests of (seed, draw, name), so they are the same wherever and however often they run."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def _order(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))


def bar_parts(trades: DataFrame) -> DataFrame:
    """(name, bar_idx, part): the results of a name's trades (name, start_idx, hold, pnl) in equal parts on their bars."""
    n = F.greatest(F.col("hold"), F.lit(1))
    each = trades.select("name", (F.col("pnl") / n).alias("part"), F.explode(F.sequence("start_idx", F.col("start_idx") + n - 1)).alias("bar_idx"))
    return each.groupBy("name", "bar_idx").agg(F.sum("part").alias("part"))


def book_ratios(books: DataFrame, key: str, digits: int = 12) -> DataFrame:
    """(key, ratio): mean over deviation (population) per bar of each book (key, bar_idx, pnl), from its first bar with a
    result to its last; bars between without one count as 0. 0 without deviation."""
    pnl = F.round("pnl", digits)
    m = books.where(pnl != 0).groupBy(key).agg((F.max("bar_idx") - F.min("bar_idx") + 1).alias("n"), F.sum("pnl").alias("s"), F.sum(F.col("pnl") * F.col("pnl")).alias("q"))
    mean = F.col("s") / F.col("n")
    var = F.col("q") / F.col("n") - mean * mean
    return m.select(key, F.when(var > 1e-24, mean / F.sqrt(var)).otherwise(0.0).alias("ratio"))


def random_book_null(chosen: DataFrame, pool: DataFrame, draws: int, seed: int) -> DataFrame:
    """One row: ratio of the book of all trades of the chosen names, how it lies among books of as many names drawn from
    the pool without replacement, and p = (draws at or above + 1) / (draws + 1).

    chosen, pool: trades (name, start_idx, hold, pnl). The pool's trades become results per bar once; a draw is a few
    (draw, name) rows joined to them. Ratios are compared at 9 digits. A pool of fewer names than chosen draws
    all of it; without trades there are no rows.
    """
    parts = cut(bar_parts(pool))
    names = parts.select("name").distinct()
    n = chosen.select("name").distinct().count()
    every = names.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    place = F.row_number().over(Window.partitionBy("draw").orderBy(_order(F.lit(seed), F.col("draw"), F.col("name")), "name"))
    drawn = every.withColumn("_r", place).where(F.col("_r") <= n).select("draw", "name")
    books = drawn.join(parts, "name").groupBy("draw", "bar_idx").agg(F.sum("part").alias("pnl"))
    null = book_ratios(books, "draw")
    seen = bar_parts(chosen).groupBy("bar_idx").agg(F.sum("part").alias("pnl")).withColumn("book", F.lit(0))
    seen = book_ratios(seen, "book").select(F.col("ratio").alias("observed"))
    r = F.round("ratio", 9)
    above = F.count_if(r >= F.round("observed", 9))
    both = null.join(F.broadcast(seen))  # one row
    return both.groupBy("observed").agg(F.count("*").alias("draws"), F.avg("ratio").alias("mean"), F.stddev_samp("ratio").alias("sd"), ((above + 1) / (F.count("*") + 1)).alias("p"))


def partial_clustered_t(rows: DataFrame, keys: Sequence[str], y: str, x: str, controls: Sequence[str], cluster: str) -> DataFrame:
    """(keys, n, clusters, slope, t) of y on x with a constant and controls, with errors clustered by ``cluster`` (CR1).

    One pass for all keys: sums of products by key and cluster. Their totals give the coefficients, and those of x on the
    controls; a cluster's sum of what is left of x times the residual is a form of its own sums, so rows aren't read
    again. Rows with a null are left out.
    """
    names = [x, *controls]
    d, used = len(names) + 1, [*names, y]
    rows = rows.dropna(subset=used)
    values = [F.lit(1.0), *(F.col(c).cast("double") for c in used)]
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    parts = cut(rows.groupBy(*keys, cluster).agg(F.count("*").alias("n"), *(F.sum(values[i] * values[j]).alias(f"m{i}_{j}") for i, j in pairs)))
    sums = parts.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(f"m{i}_{j}").alias(f"m{i}_{j}") for i, j in pairs))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            beta, gamma, left = [], [], []
            for r in p.to_dict("records"):
                m = np.zeros((d + 1, d + 1))
                for i, j in pairs:
                    m[i, j] = m[j, i] = r[f"m{i}_{j}"]
                others = [0, *range(2, d)]
                beta.append(np.linalg.lstsq(m[:d, :d], m[:d, d], rcond=None)[0].tolist())
                g = np.linalg.lstsq(m[np.ix_(others, others)], m[others, 1], rcond=None)[0]
                gamma.append(g.tolist())
                left.append(float(m[1, 1] - g @ m[others, 1]))
            yield p[[*keys, "n"]].assign(beta=beta, gamma=gamma, left=left)

    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)
    fits = sums.mapInPandas(solve, f"{kinds}, n long, beta array<double>, gamma array<double>, left double")
    met = parts.drop("n").join(fits, list(keys))
    # Both factors of a score are combinations of (1, x, controls, y): the residual, and what the controls leave of x.
    e = [*(-F.col("beta")[i] for i in range(d)), F.lit(1.0)]
    rest = [-F.col("gamma")[0], F.lit(1.0), *(-F.col("gamma")[i] for i in range(1, d - 1)), None]
    score = sum((e[i] * rest[j] * F.col(f"m{min(i, j)}_{max(i, j)}") for i in range(d + 1) for j in range(d)), F.lit(0.0))
    scores = met.select(*keys, score.alias("s"), "n", "left", F.col("beta")[1].alias("slope"))
    g, n = F.count("*"), F.first("n")
    meat = F.sum(F.col("s") * F.col("s")) * (g / (g - 1)) * ((n - 1) / (n - d))
    t = F.when((g > 1) & (n > d) & (F.first("left") > 1e-18) & (meat > 0), F.first("slope") / (F.sqrt(meat) / F.first("left")))
    return scores.groupBy(*keys).agg(n.alias("n"), g.alias("clusters"), F.first("slope").alias("slope"), t.alias("t"))


def block_permuted(panel: DataFrame, x: str, block: int, draws: int, seed: int) -> DataFrame:
    """``panel`` (name, date, ...) once for each draw, with x moved in blocks of ``block`` rows along its name: all blocks,
    the short last one too, stand in a new order. Names of fewer rows than a block are left out.

    A name's history is one row, and a draw reorders the blocks of its array of x: the panel is shuffled once, and
    nothing that a draw makes is.
    """
    others = [c for c in panel.columns if c not in ("name", x)]
    whole = panel.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("date", F.struct(*others).alias("_own"), F.col(x).alias("_x")))).alias("_h"))
    whole = whole.where(F.size("_h") >= block).select("name", F.col("_h._own").alias("_own"), F.col("_h._x").alias("_x"))
    each = whole.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    last = F.expr(f"cast((size(_x) - 1) div {block} as int)")
    dealt = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(_order(F.lit(seed), F.col("draw"), F.col("name"), b).alias("_k"), b.alias("_b")))
    moved = F.flatten(F.transform(F.array_sort(dealt), lambda b: F.slice("_x", b["_b"] * block + 1, F.lit(block))))
    rows = each.select("draw", "name", F.explode(F.arrays_zip(F.col("_own"), moved.alias("_to"))).alias("_r"))
    return rows.select("draw", "name", *(F.col(f"_r._own.{c}").alias(c) for c in others), F.col("_r._to").alias(x))


def block_permutation_null(panel: DataFrame, y: str, x: str, controls: Sequence[str], block: int, draws: int, seed: int, cluster: str = "date") -> DataFrame:
    """One row: the clustered t of x beside the controls, and how it lies among draws in which blocks of x stand in
    another order along each name while all else stays: draws, mean, sd, p (two-sided, (beyond + 1) / (draws + 1))."""
    used = panel.select("name", "date", y, x, *controls).dropna()
    seen = partial_clustered_t(used.withColumn("draw", F.lit(-1)), ["draw"], y, x, controls, cluster).select(F.col("t").alias("observed"))
    null = partial_clustered_t(block_permuted(used, x, block, draws, seed), ["draw"], y, x, controls, cluster)
    both = null.join(F.broadcast(seen))  # one row
    beyond = F.count_if(F.round(F.abs("t"), 9) >= F.round(F.abs("observed"), 9))
    return both.groupBy("observed").agg(F.count("*").alias("draws"), F.avg("t").alias("mean"), F.stddev_samp("t").alias("sd"), ((beyond + 1) / (F.count("*") + 1)).alias("p"))
