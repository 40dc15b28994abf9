"""Forecast scores as aggregates; detail and pooled rows come from grouping sets in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def regression(actual: Column, predicted: Column) -> dict[str, Column]:
    e = actual - predicted
    size = F.abs(actual) + F.abs(predicted)
    return {
        "n": F.count(F.lit(1)),
        "mae": F.avg(F.abs(e)),
        "median_ae": F.percentile(F.abs(e), F.lit(0.5)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "mape": F.avg(F.when(actual != 0, 100 * F.abs(e / F.when(actual != 0, actual)))),
        "smape": F.avg(F.when(size == 0, F.lit(0.0)).otherwise(200 * F.abs(e) / F.when(size != 0, size))),
        "bias": F.avg(e),
        "r2": 1 - F.try_divide(F.sum(e * e), F.var_pop(actual) * F.count(F.lit(1))),
    }


def direction(actual: Column, predicted: Column, origin: Column) -> Column:
    """Share of equal signs against the origin; ties of either side are left out, null if all are."""
    a, p = F.signum(actual - origin), F.signum(predicted - origin)
    return F.avg(F.when((a != 0) & (p != 0), (a == p).cast("double")))


def direction_agreeing(actual: Column, predicted: Column, origin: Column) -> Column:
    """The other rule: two ties agree."""
    return F.avg((F.signum(actual - origin) == F.signum(predicted - origin)).cast("double"))


def report(scored: DataFrame, keys: tuple[str, ...] = ("model",), detail: str = "horizon") -> DataFrame:
    """Scores per key and detail value, and pooled rows where detail is null."""
    a, p, o = F.col("actual"), F.col("predicted"), F.col("origin")
    scores = regression(a, p) | {"direction": direction(a, p, o), "direction_agreeing": direction_agreeing(a, p, o)}
    sets = [[F.col(k) for k in (*keys, detail)], [F.col(k) for k in keys]]
    return scored.groupingSets(sets, *keys, detail).agg(*(c.alias(n) for n, c in scores.items()))


def relative(reported: DataFrame, baseline: str = "persistence", keys: tuple[str, ...] = ("horizon",)) -> DataFrame:
    """Errors over the baseline's of the same keys; null where the baseline has none."""
    base = reported.where(F.col("model") == baseline).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("mae").alias("_mae"), F.col("rmse").alias("_rmse"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = reported.join(base, same)
    return joined.withColumn("relative_mae", F.try_divide("mae", "_mae")).withColumn("relative_rmse", F.try_divide("rmse", "_rmse")).drop("_mae", "_rmse", *(f"_{k}" for k in keys))


def scaled_errors(scored: DataFrame, bars: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """MASE and RMSSE per model, series and fold, over the training prefix up to the last training target."""
    moves = bars.withColumn("_d", F.col("close") - F.lag("close").over(W.partitionBy("series").orderBy("session"))).withColumn("t", F.row_number().over(W.partitionBy("series").orderBy("session")) - 1)
    bounds = scored.select("series", "fold", "train_hi").distinct()
    prefix = moves.join(bounds, "series").where(F.col("t") <= F.col("train_hi") - 1 + lookback - 1 + horizon)
    scale = prefix.groupBy("series", "fold").agg(F.avg(F.abs("_d")).alias("_ad"), F.avg(F.col("_d") * F.col("_d")).alias("_sd"))
    e = F.col("actual") - F.col("predicted")
    errors = scored.groupBy("model", "series", "fold").agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))
    return errors.join(scale, ["series", "fold"]).select("model", "series", "fold", F.try_divide("mae", "_ad").alias("mase"), F.sqrt(F.try_divide("mse", "_sd")).alias("rmsse"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_probability, observed of the bins that have rows; rows: actual 0/1 and probability."""
    b = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_probability"), F.avg("actual").alias("observed"))


def probability_report(rows: DataFrame, training: Column) -> DataFrame:
    """One row: accuracy, balanced accuracy, training-majority accuracy, Brier, log loss and expected calibration error.

    training: the training labels, 0 or 1, of the same rows (null where a row has none); where they are even, the majority is 0.
    """
    y, p = F.col("actual"), F.col("probability")
    said = (p >= 0.5).cast("int")
    clipped = F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))
    scores = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((said == y).cast("double")).alias("accuracy"),
        ((F.coalesce(F.avg(F.when(y == 1, (said == 1).cast("double"))), F.lit(0.0)) + F.coalesce(F.avg(F.when(y == 0, (said == 0).cast("double"))), F.lit(0.0))) / 2).alias("balanced_accuracy"),
        F.avg(y.cast("double")).alias("_rate"),
        F.coalesce(2 * F.sum(training) > F.count(training), F.lit(False)).alias("_up"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-F.when(y == 1, F.log(clipped)).otherwise(F.log(1 - clipped))).alias("log_loss"),
    )
    gap = F.col("n") * F.abs(F.col("mean_probability") - F.col("observed"))
    ece = reliability(rows).agg((F.sum(gap) / F.sum("n")).alias("ece"))
    majority = F.when(F.col("_up"), F.col("_rate")).otherwise(1 - F.col("_rate"))
    return scores.withColumn("majority_accuracy", majority).drop("_rate", "_up").join(ece)  # one row each


def classification(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Confusion counts and what follows from them, per key and pooled; rows: actual 0/1, said 0/1, probability.

    A ratio without a denominator is 0, so a class that does not occur has recall 0.
    """
    y, said = F.col("actual"), F.col("said")
    counts = {"tp": (y == 1) & (said == 1), "fp": (y == 0) & (said == 1), "fn": (y == 1) & (said == 0), "tn": (y == 0) & (said == 0)}
    grouped = rows.groupingSets([[F.col(k) for k in keys], []], *keys).agg(*(F.count_if(c).alias(n) for n, c in counts.items()), F.avg((F.col("probability") - y) * (F.col("probability") - y)).alias("brier"))
    tp, fp, fn, tn = map(F.col, counts)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return grouped.withColumns({"precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall), "balanced_accuracy": (recall + specificity) / 2, "naive": F.greatest(tp + fn, fp + tn) / (tp + fp + fn + tn)})


def quantile_scores(rows: DataFrame) -> DataFrame:
    """Pinball loss and coverage below each tau; rows: tau, actual, predicted."""
    e = F.col("actual") - F.col("predicted")
    return rows.groupBy("tau").agg(F.avg(F.greatest(F.col("tau") * e, (F.col("tau") - 1) * e)).alias("pinball"), F.avg((F.col("actual") <= F.col("predicted")).cast("double")).alias("below"), F.count(F.lit(1)).alias("n"))


def crossing_rate(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Share of keys in which a quantile lies under the one before."""
    before = F.lag("predicted").over(W.partitionBy(*keys).orderBy("tau"))
    crossed = rows.withColumn("_x", F.col("predicted") < before).groupBy(*keys).agg(F.coalesce(F.bool_or("_x"), F.lit(False)).alias("crossed"))
    return crossed.agg(F.avg(F.col("crossed").cast("double")).alias("crossing_rate"), F.count(F.lit(1)).alias("n"))


def conformal_radius(scored: DataFrame, coverage: float, keys: tuple[str, ...] = ("model", "horizon")) -> DataFrame:
    """Absolute residual of rank min(ceil((n + 1) coverage), n) per key."""
    w = W.partitionBy(*keys)
    ranked = scored.withColumn("_e", F.abs(F.col("actual") - F.col("predicted"))).withColumn("_r", F.row_number().over(w.orderBy("_e"))).withColumn("_n", F.count(F.lit(1)).over(w))
    rank = F.least(F.ceil((F.col("_n") + 1) * coverage), F.col("_n"))
    return ranked.where(F.col("_r") == rank).select(*keys, F.col("_n").alias("n"), F.col("_e").alias("radius"))


def interval_scores(scored: DataFrame, radius: DataFrame, keys: tuple[str, ...] = ("model", "horizon")) -> DataFrame:
    """Coverage and width of the intervals on the rows that gave the radius (calibration, not held out)."""
    joined = scored.join(radius, list(keys))
    inside = (F.abs(F.col("actual") - F.col("predicted")) <= F.col("radius")).cast("double")
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("radius").alias("radius"), F.avg(inside).alias("coverage"), F.avg(2 * F.col("radius")).alias("width"))


def residual_diagnostics(scored: DataFrame, keys: tuple[str, ...], order: str, lags: int = 10) -> DataFrame:
    """Moments, Durbin-Watson and Ljung-Box of residuals in order; the chi-square tail of an even number of lags is a sum."""
    w = W.partitionBy(*keys).orderBy(order)
    rows = scored.withColumn("_e", F.col("actual") - F.col("predicted")).withColumn("_c", F.col("_e") - F.avg("_e").over(W.partitionBy(*keys)))
    rows = rows.withColumn("_d", F.col("_e") - F.lag("_e").over(w)).withColumns({f"_l{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(1, lags + 1)})
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("mean"), F.stddev_pop("_e").alias("sd"), F.sum(F.col("_d") * F.col("_d")).alias("_dd"), F.sum(F.col("_e") * F.col("_e")).alias("_ee"), F.sum(F.col("_c") * F.col("_c")).alias("_cc"), F.avg(F.pow("_c", F.lit(3.0))).alias("_m3"), F.avg(F.pow("_c", F.lit(4.0))).alias("_m4"), *(F.sum(f"_l{k}").alias(f"_l{k}") for k in range(1, lags + 1)))
    n = F.col("n")
    q = n * (n + 2) * sum((F.pow(F.try_divide(F.col(f"_l{k}"), F.col("_cc")), F.lit(2.0)) / (n - k) for k in range(1, lags + 1)), F.lit(0.0))
    half = F.col("ljung_box") / 2
    tail, term = F.lit(0.0), F.lit(1.0)
    for k in range(lags // 2):
        tail = tail + term
        term = term * half / (k + 1)
    out = sums.withColumn("durbin_watson", F.try_divide("_dd", "_ee")).withColumn("skew", F.try_divide(F.col("_m3"), F.pow("sd", F.lit(3.0)))).withColumn("excess_kurtosis", F.try_divide(F.col("_m4"), F.pow("sd", F.lit(4.0))) - 3).withColumn("ljung_box", q)
    out = out.withColumn("ljung_box_p", F.exp(-half) * tail)
    return out.select(*keys, "n", "mean", "sd", "durbin_watson", "skew", "excess_kurtosis", "ljung_box", "ljung_box_p", (F.col("ljung_box_p") < 0.05).alias("autocorrelated"))


def volatility(df: DataFrame, n: int = 60, horizon: int = 5) -> DataFrame:
    """Deviation of the last n returns, annual and per horizon, and the 99.5 % quantile of absolute horizon returns."""
    by = W.partitionBy("series").orderBy("session")
    rows = df.withColumn("_r", F.log(F.col("close") / F.lag("close").over(by))).withColumn("_h", F.abs(F.log(F.col("close") / F.lag("close", horizon).over(by)))).withColumn("_k", F.row_number().over(W.partitionBy("series").orderBy(F.desc("session"))))
    recent = F.stddev_samp(F.when(F.col("_k") <= n, F.col("_r")))
    return rows.groupBy("series").agg(recent.alias("daily"), (recent * F.sqrt(F.lit(252.0))).alias("annual"), (recent * F.sqrt(F.lit(float(horizon)))).alias("per_horizon"), F.percentile("_h", F.lit(0.995)).alias("extreme"))


def cross_fold(fold_scores: DataFrame, keys: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """Mean and population deviation of each score over folds, nulls left out."""
    long = fold_scores.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("x")) for n in names))).alias("_p")).select(*keys, "_p.*")
    return long.groupBy(*keys, "metric").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.count("x").alias("n"))


def fold_summary(fold_scores: DataFrame, keys: tuple[str, ...], limit: float = 0.98, worst: float = 1.25) -> DataFrame:
    """Medians of both relative errors over folds, worst squared one, folds that it beats the baseline in, and whether that would promote.

    Both medians have to be below the limit, and all folds but one at most have to be won.
    """
    out = fold_scores.groupBy(*keys).agg(
        F.percentile("relative_mae", F.lit(0.5)).alias("median_relative_mae"), F.percentile("relative_rmse", F.lit(0.5)).alias("median_relative_rmse"),
        F.max("relative_rmse").alias("worst_relative_rmse"), F.count_if(F.col("relative_rmse") < 1).alias("wins"), F.count(F.lit(1)).alias("folds"),
    )
    medians = (F.col("median_relative_mae") < limit) & (F.col("median_relative_rmse") < limit)
    return out.withColumn("promotable", medians & (F.col("worst_relative_rmse") <= worst) & (F.col("wins") >= F.greatest(F.lit(1), F.col("folds") - 1)))


def seed_summary(rows: DataFrame, keys: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """Per key and metric: mean, median, population deviation, best (least), worst, and the key's failures; rows: keys and a column per metric, a row per seed.

    A seed of which any metric is null, NaN or infinite failed and counts in none; where all did, figures are null.
    """
    sound = F.lit(True)
    for name in names:
        x = F.col(name).cast("double")
        sound = sound & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.when(sound, F.col(n).cast("double")).alias("x")) for n in names)))
    long = rows.select(*keys, values.alias("_v")).select(*keys, "_v.*")
    return long.groupBy(*keys, "metric").agg(
        F.avg("x").alias("mean"), F.percentile("x", F.lit(0.5)).alias("median"), F.stddev_pop("x").alias("sd"), F.min("x").alias("best"), F.max("x").alias("worst"), F.count_if(F.col("x").isNull()).alias("failures"),
    )


def browser_regression(df: DataFrame, keys: tuple[str, ...], least: float = 1e-4) -> DataFrame:
    """The browser's figures: actuals near 0 are left out of the percentage, r2 is 0 where actuals are all alike, and errors are also given over those of ``baseline``."""
    e, a, base = F.col("actual") - F.col("predicted"), F.col("actual"), F.col("actual") - F.col("baseline")
    rmse = lambda x: F.sqrt(F.avg(x * x))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), rmse(e).alias("rmse"),
        (100 * F.avg(F.when(F.abs(a) >= least, F.abs(F.try_divide(e, a))))).alias("mape"),
        F.when(F.var_pop(a) == 0, F.lit(0.0)).otherwise(1 - F.try_divide(F.avg(e * e), F.var_pop(a))).alias("r2"),
        F.try_divide(F.avg(F.abs(e)), F.avg(F.abs(base))).alias("relative_mae"), F.try_divide(rmse(e), rmse(base)).alias("relative_rmse"),
    )


def band_coverage(quantiles: DataFrame, keys: tuple[str, ...], low: float, high: float) -> DataFrame:
    """Share of actuals inside the band from quantile ``low`` to ``high``, its mean width, and the share asked for."""
    side = lambda tau: F.max(F.when(F.col("tau") == tau, F.col("predicted")))
    bands = quantiles.groupBy(*keys, "s").agg(F.max("actual").alias("actual"), side(low).alias("low"), side(high).alias("high"))
    inside = F.col("actual").between(F.col("low"), F.col("high"))
    return bands.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("width"), F.lit(high - low).alias("nominal"))


def seed_spread(runs: DataFrame, keys: tuple[str, ...], metrics: tuple[str, ...], higher: tuple[str, ...]) -> DataFrame:
    """Per metric over the seeds that ran: mean, median, population deviation, best and worst; with the run's status and failures.

    runs: keys, seed, error (null where the seed ran) and a column per metric; values that are null, NaN or infinite are left
    out. Best and worst change places for metrics of which more is better. status is that of all seeds together.
    """
    failed, seeds = F.count("error"), F.count(F.lit(1))
    status = F.when(failed == 0, "success").when(failed == seeds, "crash").otherwise("partial")
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("seed", "error")))), lambda x: F.concat(F.lit("seed "), x["seed"].cast("string"), F.lit(": "), x["error"]))
    whole = runs.groupBy(*keys).agg(seeds.alias("seeds"), failed.alias("failed"), status.alias("status"), F.concat_ws("; ", said).alias("failures"))
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    sound = F.col("_v.value").isNotNull() & ~F.isnan("_v.value") & (F.abs("_v.value") != float("inf")) & F.col("error").isNull()
    value, up = F.when(sound, F.col("_v.value")), F.col("metric").isin(*higher)
    out = runs.select(*keys, "error", values.alias("_v")).groupBy(*keys, F.col("_v.metric").alias("metric")).agg(
        F.count(value).alias("used"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_pop(value).alias("spread"), F.min(value).alias("_low"), F.max(value).alias("_high")
    )
    ends = [F.when(up, F.col("_high")).otherwise(F.col("_low")).alias("best"), F.when(up, F.col("_low")).otherwise(F.col("_high")).alias("worst")]
    return out.join(whole, list(keys)).select(*keys, "metric", "seeds", "failed", "used", "mean", "median", "spread", *ends, "status", "failures")


def legacy_holdout(scored: DataFrame, keys: tuple[str, ...], first: int, last: int) -> DataFrame:
    """Errors on the first horizon; direction from the last horizon against the first, actual against predicted.

    With one horizon, direction compares the signs of differences between neighbouring rows. Percentages leave zero actuals
    out and are null without others.
    """
    at = lambda c, h: F.max(F.when(F.col("horizon") == h, F.col(c)))
    wide = scored.groupBy(*keys, "s").agg(*(at(c, h).alias(f"{c}_{name}") for c in ("actual", "predicted") for h, name in ((first, "first"), (last, "last"))))
    a, p = F.col("actual_first"), F.col("predicted_first")
    if first == last:
        w = W.partitionBy(*keys).orderBy("s")
        wide = wide.withColumns({"_a": F.signum(a - F.lag(a).over(w)), "_p": F.signum(p - F.lag(p).over(w))})
    else:
        wide = wide.withColumns({"_a": F.signum(F.col("actual_last") - a), "_p": F.signum(F.col("predicted_last") - p)})
    e = a - p
    return wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.when(a != 0, F.abs(F.try_divide(e, a))))).alias("mape"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(a))).alias("r2"), F.avg((F.col("_a") == F.col("_p")).cast("double")).alias("direction"),
    )


def comparison_series(scored: DataFrame, sessions: DataFrame, keys: tuple[str, ...], points: int = 240) -> DataFrame:
    """Forecasts of one horizon on the date they are for, the last ``points`` of each key, and how many were left out.

    sessions: series, t, session; a target beyond the data has no date and is left out.
    """
    dated = scored.withColumn("t", F.col("t") + F.col("horizon")).drop("session").join(sessions.select("series", "t", "session"), ["series", "t"])
    newest = W.partitionBy(*keys).orderBy(F.desc("t"))
    ranked = dated.withColumn("_r", F.row_number().over(newest)).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    return ranked.where(F.col("_r") <= points).select(*keys, "session", "actual", "predicted", F.greatest(F.lit(0), F.col("_n") - points).alias("truncated"))
