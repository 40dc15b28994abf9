"""Checks of snapshots, payloads, forecasts, target domains and schemas: counts of what is wrong, and the first reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_reason(**failing: Column) -> Column:
    """The name of the first condition that holds, null if none does."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in failing.items()))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def snapshot(rows: DataFrame, order: str, features: tuple[str, ...]) -> DataFrame:
    """Per series: rows, rows out of order (not later than the one before in ``order``), rows with a feature missing or
    not finite, rows whose close isn't positive; and the first reason against the snapshot."""
    before = F.lag("session").over(W.partitionBy("series").orderBy(order))
    marked = rows.withColumn("_late", before >= F.col("session"))
    broken = ~F.forall(F.array(*(finite(F.col(f).cast("double")) for f in features)), lambda x: x)
    out = marked.groupBy("series").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("_late").alias("disordered"), F.count_if(broken).alias("unfit"), F.count_if(F.coalesce(F.col("close") <= 0, F.lit(True))).alias("nonpositive")
    )
    return out.withColumn("reason", first_reason(empty=F.col("rows") == 0, order=F.col("disordered") > 0, features=F.col("unfit") > 0, close=F.col("nonpositive") > 0))


def payload(arrays: DataFrame, least: int) -> DataFrame:
    """series and the first reason against a payload of dates, closes, opens and future dates (arrays in their order)."""
    rising = F.forall(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("dates"))), lambda k: (F.size("dates") < 2) | (F.get("dates", k - 1) > F.get("dates", k - 2)))
    fits = F.forall(F.concat("closes", "opens"), lambda x: finite(x) & (x > 0))
    ahead = F.forall("future", lambda d: d > F.array_max("dates"))
    return arrays.select(
        "series",
        F.size("dates").cast("long").alias("rows"),
        first_reason(lengths=(F.size("dates") != F.size("closes")) | (F.size("dates") != F.size("opens")), rows=F.size("dates") < least, values=~fits, order=~rising, future=~ahead).alias("reason"),
    )


def identity(served: DataFrame, asked: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Whether a served forecast is the one asked for: ticker, days and lengths of its vectors agree; the first reason if not.

    served: keys, ticker, days, prices, dates (arrays); asked: keys, asked_ticker, asked_days.
    """
    return served.join(asked, list(keys), "left").select(*keys, first_reason(
        missing=F.col("asked_ticker").isNull(), ticker=F.col("ticker") != F.col("asked_ticker"), days=F.col("days") != F.col("asked_days"),
        prices=F.size("prices") != F.col("asked_days"), dates=F.size("dates") != F.size("prices"),
    ).alias("reason"))


def in_domain(origin: Column, value: Column, target: str) -> Column:
    """Whether a target value can be turned into a price: finite, and positive once rebuilt on a positive origin."""
    usable = {"price_level": value > 0, "simple_return": value > -1, "log_return": F.lit(True), "persistence_residual": origin + value > 0}[target]
    return F.coalesce(finite(origin) & (origin > 0) & finite(value) & usable, F.lit(False))


def schema_gaps(present: Column, required: tuple[str, ...], reserved: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """Names required but missing, names present but unknown, and names that clash with reserved ones; sorted."""
    wanted, taken = (F.array(*map(F.lit, x)) for x in (required, reserved))
    return F.array_sort(F.array_except(wanted, present)), F.array_sort(F.array_except(present, F.array_union(wanted, taken))), F.array_sort(F.array_intersect(present, taken))
