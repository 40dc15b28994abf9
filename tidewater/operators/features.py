"""Causal features of bars: technical indicators, stationary ratios, market context and calendar.

Rolling values are null until their window is full, with three exceptions that keep their series whole: RSI is 50 in
warm-up, the first true range is high minus low and the first on-balance volume is 0; beta is 0 where it is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.series import by_session, emas, full, last

TWO_PI = 6.283185307179586


def previous(name: str = "close", n: int = 1) -> Column:
    return F.lag(name, n).over(by_session())


def sma_bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    close = F.col("close")
    mean, sd = full(F.avg(close), close, n), full(F.stddev_samp(close), close, n)
    return df.withColumn("sma_20", mean).withColumn("bb_upper", mean + width * sd).withColumn("bb_lower", mean - width * sd)


def ema_macd(df: DataFrame) -> DataFrame:
    df = emas(df, {"ema_20": ("close", 20), "_fast": ("close", 12), "_slow": ("close", 26)})
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return emas(df, {"macd_signal": ("macd", 9)})


def rsi(n: int = 14) -> Column:
    change = F.coalesce(F.col("close") - previous(), F.lit(0.0))
    gain, loss = (full(F.avg(x), x, n) for x in (F.greatest(change, F.lit(0.0)), F.greatest(-change, F.lit(0.0))))
    both = F.when((gain == 0) & (loss == 0), F.lit(50.0)).when(loss == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    return F.coalesce(F.when(gain.isNotNull(), both), F.lit(50.0))


def rsi_atr_obv(df: DataFrame, n: int = 14) -> DataFrame:
    before = previous()
    df = df.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    signed = F.coalesce(F.signum(F.col("close") - before), F.lit(0.0)) * F.col("volume")
    df = df.withColumn("_signed", signed).withColumn("rsi_14", rsi(n)).withColumn("atr_14", full(F.avg("_tr"), F.col("_tr"), n))
    return df.withColumn("obv", F.sum("_signed").over(by_session().rowsBetween(W.unboundedPreceding, 0))).drop("_tr", "_signed")


def technical(df: DataFrame) -> DataFrame:
    return rsi_atr_obv(sma_bollinger(ema_macd(df)))


def price_returns(df: DataFrame) -> DataFrame:
    before = previous()
    names = {"log_open": "open", "log_high": "high", "log_low": "low", "return_1d": "close"}
    df = df.withColumns({out: F.log(F.try_divide(F.col(x), before)) for out, x in names.items()})
    return df.withColumn("volume_change", F.log1p("volume") - F.lag(F.log1p("volume")).over(by_session()))


def stationary(df: DataFrame) -> DataFrame:
    """28-column family without its market part; df needs the technical columns."""
    df = price_returns(df)
    close = F.col("close")
    df = df.withColumn("_obv_change", F.col("obv") - F.lag("obv").over(by_session()))
    change = F.col("_obv_change")
    spread = full(F.stddev_samp(change), change, 20)
    return df.withColumns({
        "close_sma_20": F.try_divide(close, F.col("sma_20")) - 1,
        "close_ema_20": F.try_divide(close, F.col("ema_20")) - 1,
        "rsi_centered": (F.col("rsi_14") - 50) / 50,
        "macd_close": F.try_divide(F.col("macd"), close),
        "macd_signal_close": F.try_divide(F.col("macd_signal"), close),
        "bb_upper_rel": F.try_divide(F.col("bb_upper"), close) - 1,
        "bb_lower_rel": F.try_divide(close, F.col("bb_lower")) - 1,
        "atr_14_rel": F.try_divide(F.col("atr_14"), close),
        "obv_change_z": F.try_divide(change - full(F.avg(change), change, 20), spread),
        "return_5d": F.log(F.try_divide(close, previous(n=5))),
        "return_20d": F.log(F.try_divide(close, previous(n=20))),
        "realized_vol_5d": full(F.stddev_samp("return_1d"), F.col("return_1d"), 5),
        "realized_vol_20d": full(F.stddev_samp("return_1d"), F.col("return_1d"), 20),
    }).drop("_obv_change")


def calendar(df: DataFrame) -> DataFrame:
    month, day = F.month("session") * TWO_PI / 12, F.weekday("session") * TWO_PI / 7
    return df.withColumns({"month_sin": F.sin(month), "month_cos": F.cos(month), "weekday_sin": F.sin(day), "weekday_cos": F.cos(day)})


def market_returns(sessions: DataFrame, benchmarks: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """series, session and <name>_return_1d of each benchmark: its last known close against the row before on the union of both calendars.

    sessions: series, session; benchmarks: benchmark, session, close. Sessions before a benchmark's start get null.
    """
    # One row per series, benchmark and session of either calendar; the number of benchmarks is fixed.
    each = F.explode(F.array(*map(F.lit, names))).alias("benchmark")
    own = sessions.select("series", "session", each, F.lit(True).alias("own"), F.lit(None).cast("double").alias("_close"))
    theirs = sessions.select("series").distinct().select("series", each).join(benchmarks, "benchmark")
    theirs = theirs.select("series", "session", "benchmark", F.lit(False).alias("own"), F.col("close").cast("double").alias("_close"))
    slots = own.unionByName(theirs).groupBy("series", "benchmark", "session").agg(F.bool_or("own").alias("own"), F.max("_close").alias("_close"))
    w = W.partitionBy("series", "benchmark").orderBy("session")
    filled = slots.withColumn("_filled", F.last("_close", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    moved = filled.withColumn("_r", F.log(F.try_divide(F.col("_filled"), F.lag("_filled").over(w)))).where("own")
    return moved.groupBy("series", "session").agg(*(F.max(F.when(F.col("benchmark") == n, F.col("_r"))).alias(f"{n.lower()}_return_1d") for n in names))


def relative_and_beta(df: DataFrame, benchmark: str, n: int = 20) -> DataFrame:
    """Return relative to the benchmark and rolling beta, 0 where it can't be told."""
    own, other = F.col("return_1d"), F.col(benchmark)
    both = F.when(own.isNotNull() & other.isNotNull(), F.lit(1))
    beta = F.when(F.count(both).over(last(n)) == n, F.covar_samp(own, other).over(last(n)) / F.greatest(F.var_samp(other).over(last(n)), F.lit(1e-12)))
    return df.withColumn("relative_return", own - other).withColumn("beta_20", F.coalesce(beta, F.lit(0.0)))


#: Order of the stationary schema (a fixed contract).
STATIONARY = (
    "log_open", "log_high", "log_low", "return_1d", "volume_change", "close_sma_20", "close_ema_20", "rsi_centered", "macd_close", "macd_signal_close",
    "bb_upper_rel", "bb_lower_rel", "atr_14_rel", "obv_change_z", "return_5d", "return_20d", "realized_vol_5d", "realized_vol_20d",
    "spy_return_1d", "qqq_return_1d", "vix_return_1d", "tnx_return_1d", "relative_return", "beta_20", "month_sin", "month_cos", "weekday_sin", "weekday_cos",
)


def stationary_features(df: DataFrame, benchmarks: DataFrame, names: tuple[str, ...]) -> DataFrame:
    market = market_returns(df.select("series", "session"), benchmarks, names)
    built = relative_and_beta(stationary(technical(df)).join(market, ["series", "session"], "left"), "spy_return_1d")
    return calendar(built).select("series", "session", "close", *STATIONARY).dropna(subset=list(STATIONARY))
