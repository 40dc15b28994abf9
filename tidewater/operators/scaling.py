"""Scalers applied to rows and their inverse. A scaler table holds center and scale, or data_min and data_max, per series and fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least interquartile range of the browser's scaler, and of a min-max range that is still divided by.
LEAST_SPREAD = 1e-12


def browser_scaler(rows: DataFrame, folds: DataFrame, feature: str, lookback: int) -> DataFrame:
    """Median and interquartile range, at least ``LEAST_SPREAD``, of the raw rows up to the last training window's end."""
    joined = rows.join(folds.select("series", "fold", "train_hi"), "series").where(F.col("t") < F.col("train_hi") + lookback - 1)
    points = joined.groupBy("series", "fold").agg(F.percentile(F.col(feature), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    return points.select("series", "fold", F.col("_q")[1].alias("center"), F.greatest(F.col("_q")[2] - F.col("_q")[0], F.lit(LEAST_SPREAD)).alias("scale"))


def transformed(value: Column) -> Column:
    return (value - F.col("center")) / F.col("scale")


def restored(value: Column) -> Column:
    return value * F.col("scale") + F.col("center")


def min_max(value: Column) -> Column:
    """0 to 1 over the training rows; 0 where they are constant."""
    spread = F.col("data_max") - F.col("data_min")
    return F.when(spread > LEAST_SPREAD, F.try_divide(value - F.col("data_min"), spread)).otherwise(F.lit(0.0))


def min_max_restored(value: Column) -> Column:
    return value * (F.col("data_max") - F.col("data_min")) + F.col("data_min")


def validation_rows(rows: DataFrame, folds: DataFrame, scalers: DataFrame, lookback: int) -> DataFrame:
    """Rows that are origins of a fold's validation samples, with the fold's scaler."""
    origins = rows.join(folds.select("series", "fold", "val_lo", "val_hi"), "series").where(F.col("t").between(F.col("val_lo") + lookback - 1, F.col("val_hi") + lookback - 2))
    return origins.drop("val_lo", "val_hi").join(scalers, ["series", "fold"])
