"""Simple forecasters as columns and small fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .samples import Study, assigned, samples, tail_folds


def baseline_forecasts(df: DataFrame, study: Study) -> DataFrame:
    """model, series, fold, horizon, s, session, origin, actual, predicted of persistence and drift on validation samples.

    Both models and all horizons come from one pass over the windows.
    """
    by = W.partitionBy("series").orderBy("session")
    ahead = F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), F.lead("close", h).over(by).alias("actual")) for h in study.horizons))
    rows = samples(df.withColumn("_ahead", ahead), study)
    folds = tail_folds(rows.groupBy("series").agg(F.count(F.lit(1)).alias("n")), study)
    long = assigned(rows, folds).select("series", "fold", "train_hi", "s", "t", "session", F.col("close").alias("origin"), "first_close", F.explode("_ahead").alias("_a")).select("*", "_a.*").drop("_a")
    slope = (F.col("origin") - F.col("first_close")) / (study.lookback - 1)
    models = F.explode(F.array(F.struct(F.lit("persistence").alias("model"), F.col("origin").alias("predicted")), F.struct(F.lit("drift").alias("model"), (F.col("origin") + F.col("horizon") * slope).alias("predicted"))))
    out = long.select("series", "fold", "train_hi", "s", "t", "session", "horizon", "origin", "actual", models.alias("_m"))
    return out.select("_m.model", "series", "fold", "horizon", "train_hi", "s", "t", "session", "origin", "actual", "_m.predicted")


def base_rate(df: DataFrame, n: int = 252) -> DataFrame:
    """Smoothed share of rises among each series' last n changes, Beta(1, 1)."""
    by = W.partitionBy("series").orderBy("session")
    changes = df.withColumn("_c", F.col("close") - F.lag("close").over(by)).where("_c is not null")
    last = changes.withColumn("_r", F.row_number().over(W.partitionBy("series").orderBy(F.desc("session")))).where(F.col("_r") <= n)
    ups, total = F.count_if(F.col("_c") > 0), F.count(F.lit(1))
    p = (ups + 1) / (total + 2)
    return last.groupBy("series").agg(total.alias("n"), p.alias("probability"), F.when(p >= 0.5, "Up").otherwise("Down").alias("label"))


def train_mean(bars: DataFrame, folds: DataFrame, lookback: int, horizons: tuple[int, ...]) -> DataFrame:
    """Mean training log return per fold and horizon: what a linear model predicts once its penalty removes all weights."""
    by = W.partitionBy("series").orderBy("session")
    rows = bars.withColumn("s", F.row_number().over(by) - lookback)
    ahead = F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), F.log(F.lead("close", h).over(by) / F.col("close")).alias("y")) for h in horizons))
    long = rows.withColumn("_ahead", ahead).select("series", "s", F.explode("_ahead").alias("_a")).select("series", "s", "_a.*")
    return long.join(folds, "series").where("s >= train_lo and s < train_hi and y is not null").groupBy("series", "fold", "horizon").agg(F.avg("y").alias("mean_return"), F.count("y").alias("n"))


def shrinkage(scored: DataFrame, steps: int = 20) -> DataFrame:
    """Weight toward persistence with the least mean absolute error on a grid of steps + 1; ties to the smallest.

    scored: keys model, horizon; origin, actual, predicted.
    """
    grid = scored.withColumn("alpha", F.explode(F.array(*(F.lit(k / steps) for k in range(steps + 1)))))
    error = F.abs(F.col("actual") - (F.col("origin") + F.col("alpha") * (F.col("predicted") - F.col("origin"))))
    mae = grid.groupBy("model", "horizon", "alpha").agg(F.avg(error).alias("mae"))
    rounded = F.round("mae", 6)
    return mae.groupBy("model", "horizon").agg(F.min_by("alpha", F.struct(rounded, F.col("alpha"))).alias("alpha"), F.min(rounded).alias("mae"))


def ridge_one(df: DataFrame, x: str, y: str, keys: tuple[str, ...], alpha: float) -> DataFrame:
    """Closed-form ridge on one centred feature per key: slope and intercept from sums."""
    sums = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("vx"))
    slope = F.try_divide(F.col("n") * F.col("cxy"), F.col("n") * F.col("vx") + alpha)
    return sums.select(*keys, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))
