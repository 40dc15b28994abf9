"""Walk-forward validation in which every fold scales features by its own extremes, with scores, residuals and a summary.

A target is known by its first row: its window is the ``lookback`` rows before, its origin the row just before, and its
``horizon`` rows lie wholly in its part of the fold. Rows are read once however many folds there are: extremes, moves and
labels are taken per segment, a segment being the rows between the ends of any two parts, and folds add up segments.
Series too short for all folds have none; folds without a training target are left out; so are null and NaN in extremes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import by_session
from . import linear, metrics
from .samples import numbered, research_folds

#: Scores of a fold that the summary averages.
PRICE_SCORES = ("rmse", "mae", "mape", "r2", "direction", "mase", "rmsse", "relative_mae", "relative_rmse")
DIRECTION_SCORES = ("accuracy", "precision", "recall", "f1", "naive", "balanced_accuracy", "brier", "log_loss")


@dataclass(frozen=True)
class Validation:
    """``size`` rows validate in each fold; ``rolling`` scales by the last ``min_train`` rows before it, not by all."""

    lookback: int = 60
    horizon: int = 5
    folds: int = 5
    min_train: int = 300
    size: int = 60
    gap: int = 0
    rolling: bool = False


def fold_plan(counts: DataFrame, v: Validation) -> DataFrame:
    """counts (series, n rows) -> series, fold from 1, train_lo, train_hi, val_lo, val_hi in rows and first_target, train_targets, val_targets.

    Training targets start at row ``lookback`` also where scaling rolls.
    """
    plan = research_folds(counts, v.size, v.min_train, v.gap, v.folds)
    first = F.greatest(F.col("val_lo"), F.lit(v.lookback))
    out = plan.select(
        "series", "fold", (F.col("train_hi") - v.min_train if v.rolling else F.lit(0)).cast("long").alias("train_lo"), "train_hi", "val_lo", "val_hi",
        (F.col("train_hi") - v.horizon + 1 - v.lookback).cast("long").alias("train_targets"), first.cast("long").alias("first_target"), (F.col("val_hi") - v.horizon + 1 - first).cast("long").alias("val_targets"),
    )
    return out.where("train_targets > 0 and val_targets > 0")


def _segmented(rows: DataFrame, folds: DataFrame, ends: Column) -> DataFrame:
    """rows (series, t) with the number of ends of their series' folds at or before t."""
    cuts = folds.groupBy("series").agg(F.array_distinct(F.flatten(F.collect_list(ends))).alias("_cuts"))
    return rows.join(cuts, "series").withColumn("segment", F.size(F.filter("_cuts", lambda c: c <= F.col("t")))).drop("_cuts")


def _spans(folds: DataFrame, ends: Column, low: Column, high: Column) -> DataFrame:
    """folds with the first and last segment of rows [low, high)."""
    cuts = folds.groupBy("series").agg(F.array_distinct(F.flatten(F.collect_list(ends))).alias("_cuts"))
    count = lambda test: F.size(F.filter("_cuts", test))
    return folds.join(cuts, "series").withColumns({"_from": count(lambda c: c <= low), "_to": count(lambda c: c < high)}).drop("_cuts")


def extremes(df: DataFrame, folds: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """series, fold, center (least value of each feature in the fold's training rows) and scale (its range; 1 where that is 0)."""
    ends = F.array("train_lo", "train_hi")
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    seen = _segmented(numbered(df), folds, ends).groupBy("series", "segment").agg(
        *(f(value(c)).alias(f"_{name}{k}") for k, c in enumerate(features) for name, f in (("min", F.min), ("max", F.max))))
    inside = _spans(folds, ends, F.col("train_lo"), F.col("train_hi")).join(seen, "series").where("segment between _from and _to")
    found = inside.groupBy("series", "fold").agg(*(f(f"_{name}{k}").alias(f"_{name}{k}") for k in range(len(features)) for name, f in (("min", F.min), ("max", F.max))))
    spread = [F.col(f"_max{k}") - F.col(f"_min{k}") for k in range(len(features))]
    return found.select("series", "fold", F.array(*(F.col(f"_min{k}") for k in range(len(features)))).alias("center"), F.array(*(F.when(x == 0, F.lit(1.0)).otherwise(x) for x in spread)).alias("scale"))


def training_moves(df: DataFrame, folds: DataFrame) -> DataFrame:
    """series, fold, _ad and _sd: mean absolute and mean squared change of closes between the fold's training rows; null where 0."""
    ends = F.array(F.col("train_lo") + 1, "train_hi")
    rows = numbered(df).withColumn("_d", F.col("close").cast("double") - F.lag("close").over(by_session()))
    seen = _segmented(rows, folds, ends).groupBy("series", "segment").agg(F.sum(F.abs("_d")).alias("_a"), F.sum(F.col("_d") * F.col("_d")).alias("_s"), F.count("_d").alias("_n"))
    inside = _spans(folds, ends, F.col("train_lo") + 1, F.col("train_hi")).join(seen, "series").where("segment between _from and _to")
    found = inside.groupBy("series", "fold").agg(F.try_divide(F.sum("_a"), F.sum("_n")).alias("_ad"), F.try_divide(F.sum("_s"), F.sum("_n")).alias("_sd"))
    return found.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in ("_ad", "_sd")})


def targets(df: DataFrame, features: tuple[str, ...], v: Validation) -> DataFrame:
    """series, session and t (of the origin), s (target's first row less the lookback), origin, first_close, x (origin's features) and actual (prices)."""
    ahead = F.array(*(F.lead("close", k).over(by_session()).cast("double") for k in range(1, v.horizon + 1)))
    rows = numbered(df).select(
        "series", "session", "t", F.col("close").cast("double").alias("origin"), F.lag("close", v.lookback - 1).over(by_session()).cast("double").alias("first_close"),
        F.array(*(F.col(c).cast("double") for c in features)).alias("x"), ahead.alias("actual"),
    )
    return rows.where((F.col("t") >= v.lookback - 1) & ~F.exists("actual", lambda a: a.isNull())).withColumn("s", F.col("t") - (v.lookback - 1))


def price_forecasts(df: DataFrame, rows: DataFrame, folds: DataFrame, features: tuple[str, ...], v: Validation, penalty: linear.Penalty = linear.RIDGE) -> DataFrame:
    """model, series, fold, horizon, s, t, session, origin, actual, predicted of persistence, drift and a ridge on scaled features.

    The ridge foretells scaled closes; as it is linear in them, fitting prices gives the same prices as scaling and unscaling.
    """
    horizons = tuple(range(1, v.horizon + 1))
    scalers = extremes(df, folds, features).join(folds.select("series", "fold", F.col("train_targets").alias("train_hi")), ["series", "fold"])
    models = linear.fitted(rows.withColumn("y", F.col("actual")), scalers, horizons, (penalty,))
    packed = models.groupBy("series", "fold").agg(F.map_from_entries(F.collect_list(F.struct("horizon", F.struct("intercept", "weights")))).alias("_fit"))
    inside = rows.join(folds.select("series", "fold", "first_target", "val_targets"), "series").where(F.expr(f"s >= first_target - {v.lookback} and s < first_target - {v.lookback} + val_targets"))
    long = inside.join(packed, ["series", "fold"]).withColumn("horizon", F.explode(F.array(*(F.lit(h).cast("long") for h in horizons))))
    slope, fit = (F.col("origin") - F.col("first_close")) / (v.lookback - 1), F.element_at("_fit", F.col("horizon"))
    value = {"persistence": F.col("origin"), "drift": F.col("origin") + F.col("horizon") * slope, penalty.name: linear.linear_value(F.col("x"), fit["weights"], fit["intercept"])}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), p.alias("predicted")) for m, p in value.items())))
    out = long.select("series", "fold", "horizon", "s", "t", "session", "origin", F.element_at("actual", F.col("horizon").cast("int")).alias("actual"), each.alias("_m"))
    return out.select("_m.model", "series", "fold", "horizon", "s", "t", "session", "origin", "actual", "_m.predicted")


def price_folds(scored: DataFrame, moves: DataFrame) -> DataFrame:
    """One row per model, series and fold: scores over all origins and horizons, ``horizons`` (the same of each) and ``residuals`` of the first.

    Both arrays are bounded by the horizon and by a fold's rows. Residual columns are rounded to 4 digits.
    """
    a, p, o = F.col("actual"), F.col("predicted"), F.col("origin")
    base = a - o
    own = metrics.regression(a, p)
    sums = {k: own[k] for k in ("n", "mae", "rmse", "mape", "r2")} | {"direction": metrics.direction(a, p, o), "_bm": F.avg(F.abs(base)), "_br": F.sqrt(F.avg(base * base))}
    sets = [[F.col(k) for k in ("model", "series", "fold", "horizon")], [F.col(k) for k in ("model", "series", "fold")]]
    found = scored.groupingSets(sets, "model", "series", "fold", "horizon").agg(*(c.alias(k) for k, c in sums.items())).join(moves, ["series", "fold"])
    found = found.withColumns({
        "mase": F.try_divide("mae", "_ad"), "rmsse": F.col("rmse") / F.sqrt("_sd"), "relative_mae": F.try_divide("mae", "_bm"), "relative_rmse": F.try_divide("rmse", "_br"),
    })
    names = ("n", *PRICE_SCORES)
    pooled = [F.max(F.when(F.col("horizon").isNull(), F.col(k))).alias(k) for k in names]
    detail = F.array_sort(F.collect_list(F.when(F.col("horizon").isNotNull(), F.struct("horizon", *names)))).alias("horizons")
    act, pred = F.round(a, 4), F.round(p, 4)
    gap = F.round(act - pred, 4)
    row = F.struct("session", "t", act.alias("actual"), pred.alias("predicted"), gap.alias("residual"), F.abs(gap).alias("absolute_error"), F.round(100 * F.abs(F.try_divide(gap, act)), 4).alias("percentage_error"))
    residuals = scored.where("horizon = 1").groupBy("model", "series", "fold").agg(F.array_sort(F.collect_list(row)).alias("residuals"))
    return found.groupBy("model", "series", "fold").agg(*pooled, detail).join(residuals, ["model", "series", "fold"])


def summary(fold_rows: DataFrame, keys: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """keys, metric, mean, sd and n (folds that have it) over the folds, and folds_completed."""
    done = fold_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds_completed"))
    return metrics.cross_fold(fold_rows, keys, names).join(done, list(keys))


def pooled_diagnostics(fold_rows: DataFrame, keys: tuple[str, ...], least: int = 8) -> DataFrame:
    """Diagnostics of the residuals of all folds in order; keys with fewer than ``least`` have no row."""
    rows = fold_rows.select(*keys, F.explode("residuals").alias("_r")).select(*keys, F.col("_r.t").alias("t"), F.col("_r.residual").alias("actual"), F.lit(0.0).alias("predicted"))
    return metrics.residual_diagnostics(rows, keys, "t").where(F.col("n") >= least)


def direction_forecasts(df: DataFrame, v: Validation) -> tuple[DataFrame, DataFrame]:
    """Rises of the days ahead, and their folds: series, fold, horizon, s, t, session, actual 0/1, probability, majority.

    The first row has no return, so rows are numbered without it. The probability is the smoothed share of rises among the
    fold's training targets of the horizon, majority the label most training targets of all horizons have (0 where even).
    """
    moved = numbered(df).withColumn("_up", (F.col("close") > F.lag("close").over(by_session())).cast("int"))
    moved = moved.where("t > 0").withColumn("t", F.col("t") - 1)
    ahead = F.array(*(F.lead("_up", k).over(by_session()) for k in range(1, v.horizon + 1)))
    rows = moved.select("series", "session", "t", ahead.alias("_ahead")).where((F.col("t") >= v.lookback - 1) & ~F.exists("_ahead", lambda a: a.isNull()))
    rows = rows.withColumn("s", F.col("t") - (v.lookback - 1))
    folds = fold_plan(moved.groupBy("series").agg(F.count(F.lit(1)).alias("n")), v)
    # Segments end where training targets do, so they are numbered as these are.
    ends = F.array("train_targets")
    seen = _segmented(rows.withColumn("t", F.col("s")), folds, ends).groupBy("series", "segment").agg(
        F.count(F.lit(1)).alias("_n"), *(F.sum(F.get("_ahead", F.lit(k))).alias(f"_u{k}") for k in range(v.horizon)))
    inside = _spans(folds, ends, F.lit(-1), F.col("train_targets")).join(seen, "series").where("segment between _from and _to")
    ups = inside.groupBy("series", "fold").agg(F.sum("_n").alias("_n"), F.array(*(F.sum(f"_u{k}") for k in range(v.horizon))).alias("_u"))
    total = F.aggregate("_u", F.lit(0).cast("long"), lambda a, x: a + x)
    rates = ups.select("series", "fold", F.transform("_u", lambda u: (u + 1) / (F.col("_n") + 2)).alias("_p"), (2 * total > v.horizon * F.col("_n")).cast("int").alias("majority"))
    tested = rows.join(folds.select("series", "fold", "first_target", "val_targets"), "series").where(F.expr(f"s >= first_target - {v.lookback} and s < first_target - {v.lookback} + val_targets"))
    pairs = F.posexplode(F.arrays_zip(F.col("_ahead").alias("a"), F.col("_p").alias("p"))).alias("_k", "_v")
    long = tested.join(rates, ["series", "fold"]).select("series", "fold", "s", "t", "session", "majority", pairs)
    scored = long.select("series", "fold", (F.col("_k") + 1).cast("long").alias("horizon"), "s", "t", "session", F.col("_v.a").alias("actual"), F.col("_v.p").alias("probability"), "majority")
    return scored, folds


def direction_folds(scored: DataFrame) -> DataFrame:
    """One row per series and fold: scores of probabilities over all horizons, and ``residuals`` of the first; bounded as those of prices."""
    y, p = F.col("actual"), F.col("probability")
    clipped = F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))
    keys = ("series", "fold")
    counts = metrics.classification(scored.withColumn("said", (p >= 0.5).cast("int")), keys).where("series is not null").drop("naive")
    more = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((y == F.col("majority")).cast("double")).alias("naive"), F.avg(-F.when(y == 1, F.log(clipped)).otherwise(F.log(1 - clipped))).alias("log_loss"))
    said = (p > 0.5).cast("int")
    row = F.struct("session", "t", y.alias("actual"), F.round(p, 4).alias("predicted_prob"), said.alias("predicted_direction"), (y - said).alias("residual"), F.abs(y - said).alias("absolute_error"))
    residuals = scored.where("horizon = 1").groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("residuals"))
    return counts.join(more, list(keys)).join(residuals, list(keys)).withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.col("n"))
