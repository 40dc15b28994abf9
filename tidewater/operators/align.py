"""Alignment of calendars and rows: last rows, future sessions, calendars by suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Suffixes and their calendars (fixed values).
ALWAYS_OPEN = ("-USD", "-GBP", "-EUR", "-USDT")
SUFFIXES = {".L": "LSE", ".SW": "SIX", ".TO": "TSX", ".AX": "ASX", ".HK": "HKEX"}


def calendar_of(symbol: Column) -> Column:
    """The calendar's public name, by the upper-cased symbol's ending; null for a null or blank symbol."""
    upper = F.upper(symbol)
    out = F.when(upper.isNull() | (F.trim(upper) == ""), F.lit(None).cast("string"))
    for suffix in ALWAYS_OPEN:
        out = out.when(upper.endswith(suffix), "CRYPTO_24_7")
    for suffix, name in SUFFIXES.items():
        out = out.when(upper.endswith(suffix), name)
    return out.when(upper.contains("."), "NYSE_FALLBACK").otherwise("NYSE")


def last_rows(df: DataFrame, n: int) -> DataFrame:
    newest = W.partitionBy("series").orderBy(F.desc("session"))
    return df.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def future_sessions(lasts: DataFrame, holidays: DataFrame, n: int) -> DataFrame:
    """series, session, step: exactly n sessions after each series' last one; holidays and weekends count for always-open ones.

    The days looked through hold n weekdays and one more for every holiday, so there are always enough.
    """
    closed = holidays.select("session").where("session is not null").distinct()
    reach = (F.ceil((F.col("_closed") + n) * 7 / 5) + 7).cast("int")
    days = lasts.join(closed.agg(F.count(F.lit(1)).alias("_closed")))  # one row
    days = days.withColumn("session", F.explode(F.sequence(F.date_add("last_session", 1), F.date_add("last_session", reach), F.expr("interval 1 day"))))
    days = days.join(closed.withColumn("_holiday", F.lit(True)), "session", "left")
    kept = days.where(F.col("always") | ((F.weekday("session") < 5) & F.col("_holiday").isNull()))
    step = F.row_number().over(W.partitionBy("series").orderBy("session")).cast("long")
    return kept.withColumn("step", step).where(F.col("step") <= n).select("series", "session", "step")


def training_snapshot(rows: DataFrame, columns: tuple[str, ...], future: DataFrame, most: int = 2000, window: int = 60, ahead: int = 30) -> DataFrame:
    """What a client trains on, one row per series: its last ``most`` rows as arrays, coming sessions, and what they allow.

    rows: series, session, close and columns; future: series, session, step. raw_rows counts all rows of the series;
    problem is ``short`` below one window with its targets and one more row, ``features`` or ``prices`` where a value is
    missing, not finite or a price isn't positive. Arrays hold ``most`` rows at most.
    """
    counts = rows.groupBy("series").agg(F.count(F.lit(1)).alias("raw_rows"))
    cells = F.array(*(F.col(c).cast("double") for c in columns))
    made = last_rows(rows.select("series", "session", F.col("close").cast("double").alias("close"), cells.alias("x")), most)
    made = made.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("session", "close", "x"))).alias("_r"))
    days = future.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("step", "session")))["session"].alias("future_dates"))
    n = F.size("_r").cast("long")
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    sound = F.forall("_r.x", lambda row: F.forall(row, finite))
    priced = F.forall("_r.close", lambda x: finite(x) & F.coalesce(x > 0, F.lit(False)))
    return made.join(counts, "series").join(days, "series", "left").select(
        "series", F.col("_r.session").alias("dates"), F.col("_r.x").alias("features"), F.col("_r.close").alias("prices"), "future_dates", "raw_rows",
        F.element_at("_r.session", 1).alias("start_date"), F.element_at("_r.session", -1).alias("end_date"), F.greatest(n - (window + ahead - 1), F.lit(0)).alias("usable_sequences"),
        F.when(n < window + ahead + 1, "short").when(~sound, "features").when(~priced, "prices").alias("problem"),
    )


def instrument_summary(df: DataFrame, n: int = 252) -> DataFrame:
    marked = df.withColumn("_prev", F.lag("close").over(W.partitionBy("series").orderBy("session")))
    return last_rows(marked, n).groupBy("series").agg(
        F.round(F.max("high"), 2).alias("year_high"),
        F.round(F.min("low"), 2).alias("year_low"),
        F.round(F.avg("volume"), 6).alias("average_volume"),
        F.round(F.max_by("high", "session"), 2).alias("day_high"),
        F.round(F.max_by("low", "session"), 2).alias("day_low"),
        F.round(F.max_by("_prev", "session"), 2).alias("previous_close"),
    )
