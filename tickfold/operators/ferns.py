"""Random ferns for many fits at once: tuning on purged grids, fold schemes side by side, and importance by groups.

A fern looks at a few features and sorts a row into one of 2^depth cells by fixed cuts; a fit is the label's mean in
each cell, and a score the mean over ferns. So a fit is counts: rows are counted once per cell and per set of fits
they train, and those few counts are dealt to all fits. No fit is a job of its own.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import purged_folds
from .lineage import cut
from .studies import area_under_curve, combinatorial_folds

#: A test of a fern: (feature, cut); its bit is whether the feature is above.
Test = tuple[str, float]
#: (features of a fern, prior rows that a cell has of each label)
Setting = tuple[int, float]


def draw_ferns(features: Sequence[str], count: int, depth: int, cuts: Sequence[float] = (-0.67, 0.0, 0.67), seed: int = 7) -> list[list[Test]]:
    """``count`` ferns of ``depth`` tests with different features, from seeded draws; features should be scaled so that
    the cuts mean something (these are a normal's quartiles), as no cut is learned and so none leaks."""
    rng = random.Random(f"{seed}:{count}:{depth}")
    return [[(f, rng.choice(list(cuts))) for f in rng.sample(list(features), min(depth, len(features)))] for _ in range(count)]


def cells(ferns: Sequence[Sequence[Test]], at=F.col) -> Column:
    """Array of each fern's cell; a missing feature counts as below."""
    bit = lambda k, t: F.when(at(t[0]) > t[1], 1 << k).otherwise(0)
    return F.array(*(sum((bit(k, t) for k, t in enumerate(fern)), F.lit(0)) for fern in ferns))


def fern_fits(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """(keys, fit, fern, cell, n, s): the rows and labels that each fit learned from in a cell. rows: keys, label, trains
    (array of the fits that learn from it) and cells."""
    each = rows.where(F.col(label).isNotNull()).select(*keys, "trains", F.col(label).cast("double").alias("_y"), F.posexplode("cells").alias("fern", "cell"))
    few = each.groupBy(*keys, "trains", "fern", "cell").agg(F.count("*").alias("n"), F.sum("_y").alias("s"))
    return few.withColumn("fit", F.explode("trains")).groupBy(*keys, "fit", "fern", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def fern_scores(rows: DataFrame, fits: DataFrame, keys: Sequence[str], row: str, label: str, priors: Sequence[float], tests: str = "tests") -> DataFrame:
    """(keys, fit, prior, row, label, p) for every fit in the array ``tests`` of a row and every prior; a cell
    without rows says 1/2."""
    each = rows.where(F.col(label).isNotNull()).select(*keys, row, label, F.explode(tests).alias("fit"), "cells")
    each = each.select(*keys, "fit", row, label, F.posexplode("cells").alias("fern", "cell"))
    met = each.join(fits, [*keys, "fit", "fern", "cell"], "left")
    n, s = F.coalesce("n", F.lit(0)), F.coalesce("s", F.lit(0.0))
    shares = [F.avg((s + a) / (n + 2 * a)).alias(f"p{i}") for i, a in enumerate(priors)]
    wide = met.groupBy(*keys, "fit", row, label).agg(*shares)
    long = F.array(*(F.struct(F.lit(i).alias("prior"), F.col(f"p{i}").alias("p")) for i in range(len(priors))))
    return wide.withColumn("_x", F.explode(long)).select(*keys, "fit", "_x.prior", row, label, "_x.p")


def judged(scored: DataFrame, keys: Sequence[str], label: str, digits: int = 9) -> DataFrame:
    """Per key: n, accuracy at 1/2, neg_log_loss (held within 1e-6 of 0 and 1) and auc; only keys with both labels."""
    y, p = F.col(label), F.greatest(F.least(F.col("p"), F.lit(1 - 1e-6)), F.lit(1e-6))
    rows = scored.withColumns({"_a": ((F.round("p", digits) >= 0.5).cast("int") == y).cast("double"), "_l": y * F.log(p) + (1 - y) * F.log(1 - p), "_p": F.round("p", digits)})
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_a").alias("accuracy"), F.avg("_l").alias("neg_log_loss"))
    return sums.join(area_under_curve(rows, list(keys), "_p", label).where("auc is not null").select(*keys, "auc"), list(keys))


def tagged(events: DataFrame, schemes: dict[str, DataFrame]) -> DataFrame:
    """``events`` with arrays trains and tests of 'scheme:split' names, from (split or fold, symbol, ev_idx, part) rows."""
    tags = None
    for name, splits in schemes.items():
        number = F.col("split" if "split" in splits.columns else "fold").cast("string")
        rows = splits.select("symbol", "ev_idx", F.concat(F.lit(f"{name}:"), number).alias("_t"), "part")
        tags = rows if tags is None else tags.unionByName(rows)
    of = lambda part: F.sort_array(F.collect_list(F.when(F.col("part") == part, F.col("_t"))))
    return events.join(tags.groupBy("symbol", "ev_idx").agg(of("train").alias("trains"), of("test").alias("tests")), ["symbol", "ev_idx"])


def standard_folds(events: DataFrame, k: int) -> DataFrame:
    """Contiguous folds with nothing purged: the leaky scheme."""
    at, whole = Window.partitionBy("symbol").orderBy("ev_idx"), Window.partitionBy("symbol")
    own = F.least(F.expr(f"_i div greatest(_n div {k}, 1)"), F.lit(k - 1))
    rows = events.select("symbol", "ev_idx", (F.row_number().over(at) - 1).alias("_i"), F.count("*").over(whole).alias("_n")).withColumn("_own", own)
    each = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return each.select("fold", "symbol", "ev_idx", F.when(F.col("_own") == F.col("fold"), "test").otherwise("train").alias("part"))


def fold_leak_study(events: DataFrame, features: Sequence[str], label: str, k: int = 5, groups: int = 6, test: int = 2, embargo: int = 0, ferns: int = 12, depth: int = 3, seed: int = 7) -> DataFrame:
    """(symbol, scheme, splits, accuracy, neg_log_loss, auc): one learner under three schemes at once: standard
    contiguous folds, purged folds with an embargo, and combinatorial purged folds; means over splits that have both
    labels. What the first has above the others is leaked by spans [ev_idx, end_idx] that overlap."""
    spans = events.select("symbol", "ev_idx", "end_idx")
    schemes = {"standard": standard_folds(spans, k), "purged": purged_folds(spans, k, embargo), "combinatorial": combinatorial_folds(spans, groups, test, embargo)}
    rows = cut(tagged(events, schemes).withColumn("cells", cells(draw_ferns(features, ferns, depth, seed=seed))).select("symbol", "ev_idx", label, "trains", "tests", "cells"))
    scored = fern_scores(rows, fern_fits(rows, ["symbol"], label), ["symbol"], "ev_idx", label, [1.0])
    each = judged(scored, ["symbol", "fit"], label).withColumn("scheme", F.substring_index("fit", ":", 1))
    return each.groupBy("symbol", "scheme").agg(F.count("*").alias("splits"), *(F.avg(c).alias(c) for c in ("accuracy", "neg_log_loss", "auc")))


def tune_ferns(events: DataFrame, features: Sequence[str], label: str, settings: Sequence[Setting], k: int = 5, embargo: int = 0, ferns: int = 12, seed: int = 7, path: str | None = None) -> DataFrame:
    """(symbol, depth, prior, accuracy, neg_log_loss, gap, best_by_loss, best_by_accuracy): every setting on the same
    purged folds; gap is the loss inside less that outside, and the best has the highest mean (ties: the earlier).

    All folds and priors of a depth are one pass. With ``path``, the rows of each (depth, prior) are kept there and
    taken from there when the study runs again, so that a stopped grid goes on where it was and a wider one costs
    what is new; they are those of the same events, features and folds."""
    spark = events.sparkSession
    base = cut(tagged(events, {"purged": purged_folds(events.select("symbol", "ev_idx", "end_idx"), k, embargo)}).select("symbol", "ev_idx", label, "trains", "tests", *features))
    out = None
    for depth in sorted({d for d, _ in settings}):
        priors = [a for d, a in settings if d == depth]
        kept, old = None, set()
        if path:
            from py4j.protocol import Py4JJavaError
            from pyspark.errors import AnalysisException

            try:
                kept = spark.read.parquet(f"{path}/depth={depth}")
                old = {r[0] for r in kept.select("prior").distinct().collect()}
            except (AnalysisException, Py4JJavaError):
                kept = None
        if new := [a for a in priors if a not in old]:
            rows = base.withColumn("cells", cells(draw_ferns(features, ferns, depth, seed=seed)))
            fits = cut(fern_fits(rows, ["symbol"], label))
            parts = []
            for part in ("tests", "trains"):
                one = judged(fern_scores(rows, fits, ["symbol"], "ev_idx", label, new, part), ["symbol", "fit", "prior"], label)
                means = [F.avg("accuracy").alias("accuracy"), F.avg("neg_log_loss").alias("neg_log_loss")] if part == "tests" else [F.avg("neg_log_loss").alias("inside")]
                parts.append(one.groupBy("symbol", "prior").agg(*means))
            values = F.element_at(F.array(*map(F.lit, new)), F.col("prior") + 1)
            found = parts[0].join(parts[1], ["symbol", "prior"]).select("symbol", values.alias("prior"), "accuracy", "neg_log_loss", (F.col("inside") - F.col("neg_log_loss")).alias("gap"))
            if path:
                found.write.mode("append").parquet(f"{path}/depth={depth}")
                kept = spark.read.schema(found.schema).parquet(f"{path}/depth={depth}")
            else:
                kept = found
        one = kept.where(F.col("prior").isin(priors)).withColumn("depth", F.lit(depth)).select("symbol", "depth", "prior", "accuracy", "neg_log_loss", "gap")
        out = one if out is None else out.unionByName(one)
    turn = F.coalesce(*(F.when((F.col("depth") == d) & (F.col("prior") == a), i) for i, (d, a) in enumerate(settings)))
    first = lambda c: (F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(F.round(c, 9)), turn)) == 1)
    return out.withColumns({"best_by_loss": first("neg_log_loss"), "best_by_accuracy": first("accuracy")})


def linked_features(rows: DataFrame, features: Sequence[str], most: float = 0.5) -> list[list[str]]:
    """Clusters of features by average linkage of distances sqrt((1 - correlation) / 2), merged while the least mean
    distance is below that of correlation ``most``. One aggregation gives all correlations; the table of features is
    bounded by their number, whatever the rows."""
    pairs = list(combinations(features, 2))
    found = rows.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).first() if pairs else ()
    gap = {frozenset(p): ((1 - (c if c is not None else 0.0)) / 2) ** 0.5 for p, c in zip(pairs, found)}
    groups = [[f] for f in features]
    limit = ((1 - most) / 2) ** 0.5
    mean = lambda a, b: sum(gap[frozenset((x, y))] for x in a for y in b) / (len(a) * len(b))
    while len(groups) > 1:
        least, i, j = min((mean(groups[i], groups[j]), i, j) for i, j in combinations(range(len(groups)), 2))
        if least >= limit:
            break
        groups[i] += groups.pop(j)
    return [sorted(g, key=list(features).index) for g in groups]


def group_importance(events: DataFrame, features: Sequence[str], label: str, groups: Sequence[Sequence[str]], k: int = 5, embargo: int = 0, ferns: int = 24, depth: int = 3, seed: int = 7, buckets: int = 16) -> DataFrame:
    """(feature_group, loss_gain, accuracy_gain, n): what purged folds lose in log loss and accuracy when a whole group of
    features is dealt anew among test rows, so that features that stand for one another go together.

    Rows change places within hash buckets: one order by hash of the row, another by a salted one, matched by rank.
    So no order of all rows is made; ``buckets`` should grow with the rows. Fits are counted once for all groups.
    """
    drawn = draw_ferns(features, ferns, depth, seed=seed)
    spans = events.select("symbol", "ev_idx", "end_idx")
    rows = cut(tagged(events, {"purged": purged_folds(spans, k, embargo)}).where(F.col(label).isNotNull()).select("symbol", "ev_idx", label, "trains", "tests", *features))
    fits = cut(fern_fits(rows.withColumn("cells", cells(drawn)), [], label))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "symbol", "ev_idx"), F.lit(buckets)).alias("_bucket")
    rank = lambda salt: F.row_number().over(Window.partitionBy("_bucket").orderBy(F.xxhash64(F.lit(salt), "symbol", "ev_idx"), "symbol", "ev_idx"))
    placed = rows.select("*", bucket).withColumns({"_i": rank(seed + 1), "_j": rank(seed + 2)})
    other = placed.select("_bucket", F.col("_j").alias("_i"), *(F.col(f).alias(f"_dealt_{f}") for f in features))
    mixed = cut(placed.join(other, ["_bucket", "_i"]))
    variants = [F.struct(F.lit(-1).alias("_g"), cells(drawn).alias("cells"))]
    for g, names in enumerate(groups):
        variants.append(F.struct(F.lit(g).alias("_g"), cells(drawn, lambda f, names=names: F.col(f"_dealt_{f}" if f in names else f)).alias("cells")))
    each = mixed.withColumn("_v", F.explode(F.array(*variants))).select("symbol", "ev_idx", label, "tests", "_v._g", "_v.cells")
    each = each.withColumn("_row", F.struct("symbol", "ev_idx", "_g"))
    scored = fern_scores(each, fits, [], "_row", label, [1.0]).withColumn("_g", F.col("_row._g"))
    y, p = F.col(label), F.greatest(F.least(F.col("p"), F.lit(1 - 1e-6)), F.lit(1e-6))
    sums = scored.groupBy("_g").agg(F.count("*").alias("n"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("loss"), F.avg(((F.round("p", 9) >= 0.5).cast("int") == y).cast("double")).alias("accuracy"))
    names = F.element_at(F.array(*(F.lit(",".join(g)) for g in groups)), F.col("a._g") + 1)
    base = sums.where("_g = -1").alias("b")
    return sums.where("_g >= 0").alias("a").join(F.broadcast(base), F.col("b._g") == -1).select(
        names.alias("feature_group"), (F.col("a.loss") - F.col("b.loss")).alias("loss_gain"), (F.col("b.accuracy") - F.col("a.accuracy")).alias("accuracy_gain"), F.col("a.n").alias("n")
    )
