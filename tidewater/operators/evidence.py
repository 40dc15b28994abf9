"""Evidence that one forecast beats another: block bootstraps, HAC statistics, false discoveries, drift.

Bootstrap starts are hashes of seed, resample and block, so every run and every engine draws the same blocks. A block's
sum is a difference of two prefix sums, which makes a resample an equi-join and a sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def losses(scored: DataFrame, candidate: str, baseline: str = "persistence") -> DataFrame:
    """series, s, candidate and baseline absolute error per origin, averaged over horizons."""
    e = F.abs(F.col("actual") - F.col("predicted"))
    pick = lambda m: F.avg(F.when(F.col("model") == m, e))
    return scored.groupBy("series", "s").agg(pick(candidate).alias("candidate"), pick(baseline).alias("baseline"))


def model_losses(scored: DataFrame, baseline: str = "persistence") -> DataFrame:
    """model, series, s, candidate and baseline absolute error per origin, averaged over horizons, of every other model."""
    by = scored.groupBy("model", "series", "s").agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("candidate"))
    base = by.where(F.col("model") == baseline).select("series", "s", F.col("candidate").alias("baseline"))
    return by.where(F.col("model") != baseline).join(base, ["series", "s"]).select("model", "series", "s", "candidate", "baseline")


def prefix_sums(rows: DataFrame, keys: tuple[str, ...], order: str, values: tuple[str, ...]) -> DataFrame:
    """i = 0..n per key with the sums of the first i values."""
    w = W.partitionBy(*keys).orderBy(order)
    sums = rows.select(*keys, F.row_number().over(w).alias("i"), *(F.sum(v).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(v) for v in values))
    zero = rows.select(*keys).distinct().select(*keys, F.lit(0).alias("i"), *(F.lit(0.0).alias(v) for v in values))
    return sums.unionByName(zero)


def block_starts(counts: DataFrame, resamples: int, block: Column, seed: int) -> DataFrame:
    """counts (keys, n) with one row per resample and block: resample, lo, hi of a block's rows."""
    rows = counts.withColumn("b", F.greatest(F.lit(1), F.least(block, F.col("n"))).cast("long"))
    rows = rows.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("b")) - 1)))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("resample").cast("string"), F.col("_k").cast("string"))), 1, 8), 16, 10).cast("long")
    start = drawn % (F.col("n") - F.col("b") + 1)
    return rows.withColumn("lo", start).withColumn("hi", start + F.least(F.col("b"), F.col("n") - F.col("_k") * F.col("b"))).drop("_k", "b")


def resampled_means(rows: DataFrame, keys: tuple[str, ...], order: str, values: tuple[str, ...], resamples: int, block: Column, seed: int = 0) -> DataFrame:
    """Mean of each value per key and resample."""
    prefix = prefix_sums(rows, keys, order, values)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    blocks = block_starts(counts, resamples, block, seed)
    at = lambda end: prefix.select(*keys, F.col("i").cast("long").alias(end), *(F.col(v).alias(f"_{end}_{v}") for v in values))
    joined = blocks.join(at("hi"), [*keys, "hi"]).join(at("lo"), [*keys, "lo"])
    return joined.groupBy(*keys, "resample", "n").agg(*(F.sum(F.col(f"_hi_{v}") - F.col(f"_lo_{v}")).alias(v) for v in values)).select(*keys, "resample", *((F.col(v) / F.col("n")).alias(v) for v in values))


def bootstrap_mean(rows: DataFrame, keys: tuple[str, ...], order: str, value: str, resamples: int, block: Column, seed: int = 0) -> DataFrame:
    means = resampled_means(rows, keys, order, (value,), resamples, block, seed)
    interval = means.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    point = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return point.join(interval, list(keys)).select(*keys, "n", "mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def bootstrap_ratio(rows: DataFrame, keys: tuple[str, ...], order: str, top: str, bottom: str, resamples: int, block: Column, seed: int = 0) -> DataFrame:
    """Interval of mean(top) / mean(bottom); resamples with a zero below are left out."""
    means = resampled_means(rows, keys, order, (top, bottom), resamples, block, seed).withColumn("_r", F.try_divide(top, bottom)).where("_r is not null")
    interval = means.groupBy(*keys).agg(F.percentile("_r", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"), F.count(F.lit(1)).alias("resamples"))
    point = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.avg(top), F.avg(bottom)).alias("ratio"))
    return point.join(interval, list(keys)).select(*keys, "n", "resamples", "ratio", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def two_sided_normal(z: Column) -> Column:
    """Two-sided normal p-value by a rational approximation of the error function (absolute error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def hac(rows: DataFrame, keys: tuple[str, ...], order: str, value: str) -> DataFrame:
    """Mean, Newey-West standard error, statistic and p-value of a series of loss differences per key."""
    longest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    most = int(4 * (longest / 100) ** (2 / 9))
    w = W.partitionBy(*keys).orderBy(order)
    centred = rows.withColumn("_c", F.col(value) - F.avg(value).over(W.partitionBy(*keys)))
    products = centred.withColumns({f"_g{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(1, most + 1)})
    sums = products.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg(F.col("_c") * F.col("_c")).alias("_g0"), *(F.avg(f"_g{k}").alias(f"_g{k}") for k in range(1, most + 1)))
    lags = F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9)))
    var = F.col("_g0")
    for k in range(1, most + 1):
        var = var + F.when(F.lit(k) <= lags, 2 * (1 - k / (lags + 1)) * F.col(f"_g{k}")).otherwise(F.lit(0.0))
    z = F.try_divide(F.col("mean"), F.sqrt(F.when(var > 0, var / F.col("n"))))
    return sums.select(*keys, "n", "mean", lags.alias("lags"), z.alias("statistic")).withColumn("p_value", two_sided_normal(F.col("statistic")))


def false_discoveries(tests: DataFrame, p: str, family: tuple[str, ...], q: float) -> DataFrame:
    """Benjamini-Hochberg: whether each test of its family is a discovery at rate q."""
    w = W.partitionBy(*family) if family else W.partitionBy(F.lit(0))
    ranked = tests.withColumn("_r", F.row_number().over(w.orderBy(p))).withColumn("_m", F.count(F.lit(1)).over(w))
    cut = F.max(F.when(F.col(p) <= q * F.col("_r") / F.col("_m"), F.col(p))).over(w)
    return ranked.withColumn("discovery", F.coalesce(F.col(p) <= cut, F.lit(False))).drop("_r", "_m")


def psi(rows: DataFrame, feature: str, value: str, is_reference: Column, bins: int = 10, epsilon: float = 1e-4, weight: Column | None = None) -> DataFrame:
    """Population stability index per feature over the reference's quantile bins; null where the reference is constant.

    Each bin counts epsilon more than it holds. weight: how often a row counts, a whole number; once where not given.
    """
    times = F.lit(1) if weight is None else weight
    marked = rows.withColumns({"_ref": is_reference, "_w": times.cast("long")}).where("_w > 0")
    at = F.array(*(F.lit(k / bins) for k in range(bins + 1)))
    edges = marked.where("_ref").groupBy(feature).agg(F.array_distinct(F.percentile(F.col(value), at, F.col("_w"))).alias("_edges"))
    binned = marked.join(edges, feature).withColumn("_b", F.least(F.greatest(F.size(F.filter("_edges", lambda e: e <= F.col(value))) - 1, F.lit(0)), F.size("_edges") - 2))
    counts = binned.groupBy(feature, "_b").agg(F.sum(F.when(F.col("_ref"), F.col("_w")).otherwise(0)).alias("_r"), F.sum(F.when(F.col("_ref"), 0).otherwise(F.col("_w"))).alias("_c"))
    every = edges.where(F.size("_edges") > 1).select(feature, F.explode(F.sequence(F.lit(0), F.size("_edges") - 2)).alias("_b"))
    whole = every.join(counts, [feature, "_b"], "left").fillna(0, ["_r", "_c"])
    w = W.partitionBy(feature)
    share = lambda c: (F.col(c) + epsilon) / (F.sum(c).over(w) + epsilon * F.count(F.lit(1)).over(w))
    shares = whole.withColumns({"_a": share("_r"), "_s": share("_c")})
    found = shares.groupBy(feature).agg(F.sum((F.col("_s") - F.col("_a")) * F.log(F.col("_s") / F.col("_a"))).alias("psi"), F.count(F.lit(1)).alias("bins"))
    return edges.select(feature).join(found, feature, "left")


def divergence(rows: DataFrame, features: tuple[str, ...], is_reference: Column, keys: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """keys, max_psi and mean_psi over the features, and the names of those whose reference is constant; all features in one pass.

    weight: how often a row counts, as windows of several rows hold it more than once.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features)))
    long = rows.withColumns({"_reference": is_reference, "_times": F.lit(1) if weight is None else weight}).select(*keys, "_reference", "_times", each.alias("_f"))
    long = long.select(F.struct(*keys, F.col("_f.feature").alias("feature")).alias("of"), "_reference", "_times", F.col("_f.value").alias("value"))
    found = psi(long, "of", "value", F.col("_reference"), weight=F.col("_times")).select(*(F.col(f"of.{k}").alias(k) for k in (*keys, "feature")), "psi")
    degenerate = F.array_sort(F.collect_list(F.when(F.col("psi").isNull(), F.col("feature"))))
    return found.groupBy(*keys).agg(F.max("psi").alias("max_psi"), F.avg("psi").alias("mean_psi"), F.concat_ws(",", degenerate).alias("degenerate"))


def residual_drift(rows: DataFrame, keys: tuple[str, ...], order: str, value: str, resamples: int, seed: int = 0) -> DataFrame:
    """Bootstrap intervals of the mean error magnitude of both halves; drift if they are disjoint.

    The blocks of both halves are a quarter of the shorter one, 20 at most. Keys of under ten rows have no result.
    """
    w = W.partitionBy(*keys)
    rows = rows.withColumn("_all", F.count(F.lit(1)).over(w)).where("_all >= 10")
    half = F.when(F.row_number().over(w.orderBy(order)) <= F.floor(F.col("_all") / 2), 1).otherwise(2)
    # The halves' sizes differ by one at most, so the shorter one has the floor of half of all rows.
    halves = rows.withColumn("half", half).withColumn("_block", F.greatest(F.lit(1), F.least(F.lit(20), F.floor(F.floor(F.col("_all") / 2) / 4))))
    found = bootstrap_mean(halves, (*keys, "half", "_block"), order, value, resamples, F.col("_block"), seed)
    pick = lambda name, h: F.max(F.when(F.col("half") == h, F.col(name))).alias(f"{name}_{h}")
    wide = found.groupBy(*keys).agg(*(pick(n, h) for h in (1, 2) for n in ("mean", "low", "high")))
    return wide.withColumn("drift", (F.col("low_1") > F.col("high_2")) | (F.col("low_2") > F.col("high_1")))


def constrained_blend(scored: DataFrame, members: tuple[str, ...]) -> dict[str, float]:
    """Non-negative weights of the members' moves away from the origin, with sum at most 1, by least squares.

    Only the members' products are summed over the rows; the few subsets of members are solved from these.
    """
    from itertools import combinations

    import numpy as np

    move = F.col("predicted") - F.col("origin")
    wide = scored.where(F.col("model").isin(*members)).groupBy("series", "s", "horizon").agg(F.first(F.col("actual") - F.col("origin")).alias("_y"), *(F.max(F.when(F.col("model") == m, move)).alias(f"_m{k}") for k, m in enumerate(members)))
    names = [f"_m{k}" for k in range(len(members))]
    pairs = [(a, b) for a in range(len(names)) for b in range(a, len(names))]
    sums = wide.agg(*(F.sum(F.col(names[a]) * F.col(names[b])).alias(f"g{a}_{b}") for a, b in pairs), *(F.sum(F.col(n) * F.col("_y")).alias(f"y{k}") for k, n in enumerate(names))).first()
    gram = np.zeros((len(names), len(names)))
    for a, b in pairs:
        gram[a, b] = gram[b, a] = sums[f"g{a}_{b}"] or 0.0
    right = np.array([sums[f"y{k}"] or 0.0 for k in range(len(names))])
    best, least = np.zeros(len(names)), 0.0
    for n in range(1, len(names) + 1):
        for chosen in map(list, combinations(range(len(names)), n)):
            part = gram[np.ix_(chosen, chosen)]
            if np.linalg.matrix_rank(part) < n:
                continue
            w = np.zeros(len(names))
            w[chosen] = np.linalg.solve(part, right[chosen])
            cost = w @ gram @ w - 2 * w @ right
            if (w >= 0).all() and cost < least:
                best, least = w, cost
    if best.sum() > 1:
        best = best / best.sum()
    return dict(zip(members, best.tolist(), strict=True))


def relative_bounds(difference: Column, baseline: Column, squared: bool = False) -> Column:
    """A loss difference (candidate minus baseline) as a relative error; of squared losses as a root, floored at 0."""
    ratio = 1 + F.try_divide(difference, baseline)
    return F.sqrt(F.greatest(F.lit(0.0), ratio)) if squared else ratio


def fold_evidence(fold_scores: DataFrame, keys: tuple[str, ...], order: str, value: str, resamples: int, least: int = 5) -> DataFrame:
    """Mean of a score over folds; an interval, and reliable = true, only from ``least`` folds on."""
    found = bootstrap_mean(fold_scores.where(F.col(value).isNotNull()), keys, order, value, resamples, F.lit(1))
    enough = F.col("n") >= least
    return found.select(*keys, "n", "mean", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"), enough.alias("reliable"))
