"""Samples and folds: direct-horizon targets, windows, walk-forward plans and scalers.

A sample's origin is the last row of its window (``origin_in_window``); its number counts origins of its series from 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.series import by_session, position


@dataclass(frozen=True)
class Study:
    """Shape of a walk-forward study; folds take 1/``share`` of the samples each."""

    lookback: int = 60
    horizons: tuple[int, ...] = (1, 5, 20)
    folds: int = 5
    share: int = 12

    @property
    def gap(self) -> int:
        return max(self.horizons)


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("t", position())


def direct_targets(df: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """One row per origin and horizon with the price ahead and its forms as return, log return and residual."""
    rows = numbered(df)
    ahead = F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), F.lead("close", h).over(by_session()).alias("price_level")) for h in horizons))
    rows = rows.withColumn("_ahead", ahead)
    long = rows.select("series", "session", "t", F.col("close").alias("origin"), F.explode("_ahead").alias("_a")).select("series", "session", "t", "origin", "_a.*").where("price_level is not null")
    return long.withColumns({
        "simple_return": F.try_divide(F.col("price_level"), F.col("origin")) - 1,
        "log_return": F.log(F.try_divide(F.col("price_level"), F.col("origin"))),
        "persistence_residual": F.col("price_level") - F.col("origin"),
    })


def rebuilt_price(origin: Column, value: Column, target: str) -> Column:
    """The exact inverse of a target's form."""
    forms = {"price_level": value, "simple_return": origin * (1 + value), "log_return": origin * F.exp(value), "persistence_residual": origin + value}
    return forms[target]


def samples(df: DataFrame, study: Study) -> DataFrame:
    """Every origin that has a whole window behind it and all horizons ahead: sample number s, origin and first close."""
    rows = numbered(df).withColumn("first_close", F.lag("close", study.lookback - 1).over(by_session())).withColumn("_far", F.lead("close", study.gap).over(by_session()))
    kept = rows.where("first_close is not null and _far is not null")
    return kept.withColumn("s", F.col("t") - (study.lookback - 1)).drop("_far")


def window_digest(df: DataFrame, lookback: int, origin_in_window: bool = True) -> DataFrame:
    """Each origin's window as an array, reduced to its size, sum and first and last close."""
    end = 0 if origin_in_window else -1
    frame = by_session().rowsBetween(end - lookback + 1, end)
    rows = df.withColumn("window", F.collect_list("close").over(frame)).where(F.size("window") == lookback)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return rows.select("series", "session", F.size("window").cast("long").alias("n"), total.alias("total"), F.element_at("window", 1).alias("first"), F.element_at("window", -1).alias("last"))


def tail_folds(counts: DataFrame, study: Study) -> DataFrame:
    """Folds anchored at the tail: counts (series, n) -> series, fold, train_lo, train_hi, val_lo, val_hi, both [lo, hi)."""
    size = F.floor(F.col("n") / study.share).cast("long")
    folds = counts.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(study.folds - 1)))).withColumn("_v", size)
    low = F.col("n") - (study.folds - F.col("fold")) * F.col("_v")
    out = folds.select("series", F.col("fold").cast("long").alias("fold"), F.lit(0).cast("long").alias("train_lo"), (low - study.gap).alias("train_hi"), low.alias("val_lo"), (low + F.col("_v")).alias("val_hi"))
    return out.where("train_hi > train_lo and val_hi > val_lo")


def front_folds(counts: DataFrame, min_train: int, purge: int, validation: int, folds: int) -> DataFrame:
    """Expanding folds anchored at the front; folds that don't fit are left out."""
    many = counts.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))))
    low = F.lit(min_train + purge) + F.col("fold") * validation
    out = many.select("series", "fold", "n", F.lit(0).cast("long").alias("train_lo"), (low - purge).cast("long").alias("train_hi"), low.cast("long").alias("val_lo"), (low + validation).cast("long").alias("val_hi"))
    return out.where("val_hi <= n").drop("n")


def research_folds(counts: DataFrame, validation: int = 60, min_train: int = 300, purge: int = 29, folds: int = 5) -> DataFrame:
    """Folds of equal validation at the tail, numbered from 1, a purge before each; series too short for the first one are left out."""
    first = F.col("n") - folds * validation
    many = counts.where(first - purge >= min_train).withColumn("fold", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(folds).cast("long"))))
    low = first + (F.col("fold") - 1) * validation
    return many.select("series", "fold", (low - purge).alias("train_hi"), low.alias("val_lo"), (low + validation).alias("val_hi"))


def holdout_windows(counts: DataFrame, windows: int, rows: int, min_train: int, first_origin: int, horizon: int) -> DataFrame:
    """The region of origins cut into equal blocks, the last with the remainder; a block's last rows are its test."""
    start = F.greatest(F.lit(min_train), F.lit(first_origin))
    size = F.floor((F.col("n") - start) / windows)
    many = counts.where(F.col("n") - start >= windows * rows).withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(windows - 1).cast("long"))))
    end = F.when(F.col("window") == windows - 1, F.col("n")).otherwise(start + (F.col("window") + 1) * size)
    return many.select("series", "window", (end - rows - horizon).cast("long").alias("train_hi"), (end - rows).cast("long").alias("test_lo"), end.cast("long").alias("test_hi"))


def assigned(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Validation samples of every fold (rows joined by series, so a fold table of few rows per series)."""
    return rows.join(folds, "series").where("s >= val_lo and s < val_hi").drop("train_lo", "val_lo", "val_hi")


def multiplicity(t: Column, windows: Column, lookback: int) -> Column:
    """In how many of the first ``windows`` windows of ``lookback`` rows row t lies."""
    return F.least(windows - 1, t) - F.greatest(F.lit(0), t - lookback + 1) + 1


def robust_scaler(rows: DataFrame, folds: DataFrame, feature: str, lookback: int) -> DataFrame:
    """Median and interquartile range of a feature over the training windows of each fold; a constant has scale 1.

    A raw row counts as often as windows hold it, through its frequency.
    """
    joined = rows.join(folds.select("series", "fold", "train_hi"), "series").where(F.col("t") < F.col("train_hi") + lookback - 1)
    weighted = joined.withColumn("_m", multiplicity(F.col("t"), F.col("train_hi"), lookback).cast("long"))
    points = weighted.groupBy("series", "fold").agg(F.percentile(F.col(feature), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("_m")).alias("_q"))
    spread = F.col("_q")[2] - F.col("_q")[0]
    return points.select("series", "fold", F.col("_q")[1].alias("center"), F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("scale"))


def minmax_scaler(rows: DataFrame, folds: DataFrame, feature: str, lookback: int) -> DataFrame:
    joined = rows.join(folds.select("series", "fold", "train_hi"), "series").where(F.col("t") < F.col("train_hi") + lookback - 1)
    return joined.groupBy("series", "fold").agg(F.min(feature).alias("data_min"), F.max(feature).alias("data_max"))


def latest_window(df: DataFrame, n: int) -> DataFrame:
    """The last window of each series as an array."""
    newest = W.partitionBy("series").orderBy(F.desc("session"))
    last = df.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n)
    return last.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("session", "close"))), lambda x: x["close"]).alias("window"), F.max("session").alias("session"))


def tail_split(counts: DataFrame, fraction: float, purge: int) -> DataFrame:
    """Early-stopping split: the last fraction validates, a purge of rows lies between."""
    low = F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") * fraction))
    return counts.select("series", F.lit(0).cast("long").alias("train_lo"), (low - purge).cast("long").alias("train_hi"), low.cast("long").alias("val_lo"), F.col("n").cast("long").alias("val_hi")).where("train_hi > 0")


def share_split(counts: DataFrame, share: float, horizon: int) -> DataFrame:
    """Split at a share of the rows with a purge of horizon - 1; the direction split is one row earlier."""
    at = F.floor(F.col("n") * share)
    return counts.select("series", (at - (horizon - 1)).cast("long").alias("train_hi"), at.cast("long").alias("val_lo"), (at - 1).cast("long").alias("direction_lo"), F.col("n").cast("long").alias("val_hi"))


def single_holdout(counts: DataFrame, rows: int, horizon: int, min_train: int = 1) -> DataFrame:
    """The last rows of origins as test, horizon of them purged before."""
    low = F.col("n") - rows
    return counts.select("series", (low - horizon).cast("long").alias("train_hi"), low.cast("long").alias("test_lo"), F.col("n").cast("long").alias("test_hi")).where(F.col("train_hi") >= min_train)


def overlapping(folds: DataFrame, gap: int) -> DataFrame:
    """Folds whose training targets reach into their validation; a sound plan has none."""
    return folds.where(F.col("train_hi") - 1 + gap >= F.col("val_lo"))


def supervised_windows(df: DataFrame, features: tuple[str, ...], lookback: int, horizon: int, origin_in_window: bool) -> DataFrame:
    """series, as_of (last row of the window), x (array of feature structs) and y (closes of the horizon's rows after it).

    With the origin in the window, x ends at the origin's row; else at the row before, and y starts at the origin's row.
    Only whole windows and horizons are kept.
    """
    end = 0 if origin_in_window else -1
    behind, ahead = by_session().rowsBetween(end - lookback + 1, end), by_session().rowsBetween(end + 1, end + horizon)
    rows = df.withColumns({
        "x": F.collect_list(F.struct(*features)).over(behind),
        "y": F.collect_list("close").over(ahead),
        "as_of": F.col("session") if origin_in_window else F.lag("session").over(by_session()),
    })
    return rows.where((F.size("x") == lookback) & (F.size("y") == horizon)).select("series", "session", "as_of", "x", "y")


def floored_returns(df: DataFrame, least: float = 1e-8) -> DataFrame:
    """df with log_return of closes that are at least ``least``."""
    close = F.greatest(F.col("close"), F.lit(least))
    return df.withColumn("_floored", close).withColumn("log_return", F.log(F.col("_floored") / F.lag("_floored").over(by_session()))).drop("_floored")


def contiguous_losses(df: DataFrame, study: Study, windows: DataFrame) -> DataFrame:
    """series, window, s, candidate and baseline (mean absolute errors of drift and persistence over the horizons) of the windows' test origins."""
    ahead = F.array(*(F.struct(F.lit(h).alias("h"), F.lead("close", h).over(by_session()).alias("y")) for h in study.horizons))
    rows = samples(df.withColumn("_ahead", ahead), study)
    slope = (F.col("close") - F.col("first_close")) / (study.lookback - 1)
    mean = lambda error: F.aggregate("_ahead", F.lit(0.0), lambda a, x: a + error(x)) / len(study.horizons)
    scored = rows.select("series", "s", mean(lambda x: F.abs(x["y"] - F.col("close") - x["h"] * slope)).alias("candidate"), mean(lambda x: F.abs(x["y"] - F.col("close"))).alias("baseline"))
    return scored.join(windows, "series").where("s >= test_lo and s < test_hi").select("series", "window", "s", "candidate", "baseline")
