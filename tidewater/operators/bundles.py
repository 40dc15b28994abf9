"""Forecast bundles and what is checked before one is served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import gates

#: Horizons that models exist for (fixed values).
BUCKETS = (1, 3, 5, 7, 14, 30)


def horizon_bucket(days: Column) -> Column:
    """The first bucket that is at least the wanted days, clamped to 1..30."""
    wanted = F.greatest(F.lit(BUCKETS[0]), F.least(F.lit(BUCKETS[-1]), days))
    return F.element_at(F.filter(F.array(*map(F.lit, BUCKETS)), lambda b: b >= wanted), 1)


def bundle_problems(days: int, history: int) -> Column:
    """What is wrong with a row of future_dates, prices, returns, history_dates, history_prices, origin and origin_price."""
    rising = lambda a: F.forall(F.sequence(F.lit(2), F.greatest(F.size(a), F.lit(2))), lambda k: F.coalesce(F.try_element_at(a, k) > F.try_element_at(a, k - 1), F.lit(True)))
    sound = lambda a: F.forall(a, lambda x: F.coalesce((x > 0) & (x < float("inf")), F.lit(False)))
    future, past = F.col("future_dates"), F.col("history_dates")
    return gates.reasons(
        lengths=(F.size(future) != days) | (F.size("prices") != days) | (F.size("returns") != days), history=(F.size(past) != history) | (F.size("history_prices") != history),
        prices=~(sound(F.col("prices")) & sound(F.col("history_prices"))), dates=~(rising(future) & rising(past)),
        order=F.try_element_at(future, F.lit(1)) <= F.col("origin"), origin=(F.try_element_at(past, F.lit(-1)) != F.col("origin")) | (F.try_element_at(F.col("history_prices"), F.lit(-1)) != F.col("origin_price")),
    )


def compatibility(version: int, features: tuple[str, ...], target: str, window: int) -> Column:
    """The first thing in which an artifact differs from what is served, or null."""
    return (
        F.when(~F.col("schema_version").eqNullSafe(F.lit(version)), "schema_version")
        .when(~F.col("features").eqNullSafe(F.array(*map(F.lit, features))), "features")
        .when(~F.col("target").eqNullSafe(F.lit(target)), "target")
        .when(~F.col("window").eqNullSafe(F.lit(window)), "window")
    )


def served(wanted: DataFrame, bundles: DataFrame, as_of: Column, hours: int = 36) -> DataFrame:
    """First days of each wanted ticker's vector, or why there are none: missing, stale or incompatible.

    wanted: ticker, days; bundles: ticker, created_at, problem (null if compatible), prices.
    """
    age = (F.unix_micros(as_of) - F.unix_micros("created_at")) / F.lit(3_600_000_000.0)
    why = F.when(F.col("created_at").isNull(), "missing").when(age > hours, "stale").when(F.col("problem").isNotNull(), "incompatible")
    joined = wanted.join(bundles, "ticker", "left").withColumn("absent", why)
    return joined.select("ticker", "days", "absent", F.when(F.col("absent").isNull(), F.slice("prices", F.lit(1), F.col("days"))).alias("prices"))


def history_entry(predicted: Column, last: Column, probabilities: Column) -> dict[str, Column]:
    """Numbers of a history entry; what can't be read as a number is null."""
    p, q = predicted.try_cast("double"), last.try_cast("double")
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x)
    return {"predicted_value": p, "last_close": q, "change_percent": (F.try_divide(p, q) - 1) * 100, "trend_value": F.try_divide(total, F.size(probabilities))}


def flat_metrics(rows: DataFrame, key: str, per_horizon: str, pooled: str) -> DataFrame:
    """A map of horizon -> {mae, rmse, n} and a pooled one as rows, the pooled row with a null horizon."""
    each = rows.select(key, F.explode(per_horizon).alias("horizon", "_m"))
    both = each.unionByName(rows.select(key, F.lit(None).cast(each.schema["horizon"].dataType).alias("horizon"), F.col(pooled).alias("_m")))
    return both.select(key, "horizon", "_m.mae", "_m.rmse", "_m.n")


def latest_paths(bars: DataFrame, sessions: DataFrame, passed: DataFrame, lookback: int) -> DataFrame:
    """series, step, session, price, model: each series' drift path over its next sessions if it passed, else its last price.

    sessions: series, session, step; passed: series, passed.
    """
    w = W.partitionBy("series").orderBy(F.desc("session"))
    last = bars.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= lookback)
    ends = last.groupBy("series").agg(F.max_by("close", "session").alias("_last"), F.min_by("close", "session").alias("_first"), F.count(F.lit(1)).alias("_n"))
    slope = F.try_divide(F.col("_last") - F.col("_first"), F.col("_n") - 1)
    joined = sessions.join(ends, "series").join(passed.select("series", "passed"), "series", "left")
    learned = F.coalesce("passed", F.lit(False))
    return joined.select("series", "step", "session", F.when(learned, F.col("_last") + F.col("step") * slope).otherwise(F.col("_last")).alias("price"), F.when(learned, "drift").otherwise("persistence").alias("model"))
