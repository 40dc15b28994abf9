"""Cleaning and validation of bars and feature frames; violations are rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.series import by_session

PRICES = ("open", "high", "low", "close")
BAR = (*PRICES, "volume")
JUMP, GAP_DAYS, STALE_DAYS = 0.20, 7, 15


def clean_bars(df: DataFrame, least_rows: int, order: str | None = None) -> DataFrame:
    """The last of duplicate sessions, without incomplete, non-finite, non-positive rows and without short series.

    order: a column that tells which duplicate is the last one.
    """
    newest = W.partitionBy("series", "session").orderBy(F.desc(order) if order else F.lit(1))
    once = df.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r") if order else df.dropDuplicates(["series", "session"])
    good = F.lit(True)
    for name in PRICES:
        good = good & F.col(name).isNotNull() & ~F.isnan(name) & (F.col(name) > 0) & (F.col(name) < float("inf"))
    good = good & F.col("volume").isNotNull() & (F.col("volume") >= 0) & (F.col("volume") < float("inf"))
    counted = once.where(good).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("series")))
    return counted.where(F.col("_n") >= least_rows).drop("_n")


def violations(df: DataFrame) -> DataFrame:
    """series, session, violation, rows_found: duplicates and prices that a strict reader refuses."""
    bad = F.col("close").isNull() | F.isnan("close") | (F.abs("close") == float("inf")) | (F.col("close") <= 0)
    counted = df.groupBy("series", "session").agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"))
    found = F.filter(F.array(F.when(F.col("rows") > 1, F.struct(F.lit("duplicate_session").alias("violation"), F.col("rows").alias("rows_found"))), F.when(F.col("bad") > 0, F.struct(F.lit("bad_price").alias("violation"), F.col("bad").alias("rows_found")))), lambda x: x.isNotNull())
    return counted.select("series", "session", F.explode(found).alias("_v")).select("series", "session", "_v.*")


def strict_violations(df: DataFrame, order: str) -> DataFrame:
    """series, session, violation, rows_found: all that a strict reader refuses in whole bars, in the order that ``order`` tells.

    duplicate_session; bad_price (an open, high, low or close that is null, not finite or not positive); bad_volume (null,
    not finite or negative); disorder (a row that lies before the one read before it).
    """
    unsound = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    price = F.lit(False)
    for name in PRICES:
        price = price | unsound(name) | (F.col(name) <= 0)
    before = F.lag("session").over(W.partitionBy("series").orderBy(order))
    rows = df.withColumns({"_price": price, "_volume": unsound("volume") | (F.col("volume") < 0), "_back": F.coalesce(F.col("session") < before, F.lit(False))})
    counts = {"duplicate_session": F.when(F.count(F.lit(1)) > 1, F.count(F.lit(1))), "bad_price": F.count_if("_price"), "bad_volume": F.count_if("_volume"), "disorder": F.count_if("_back")}
    found = rows.groupBy("series", "session").agg(F.array(*(F.struct(F.lit(n).alias("violation"), c.alias("rows_found")) for n, c in counts.items())).alias("_v"))
    return found.select("series", "session", F.explode("_v").alias("_v")).select("series", "session", "_v.*").where("rows_found > 0")


def symbol(raw: Column) -> Column:
    """Trimmed and upper-cased; null unless it is one to twelve of A-Z, 0-9, dot and dash after an optional caret."""
    text = F.upper(F.trim(raw))
    return F.when(text.rlike(r"^\^?[A-Z0-9.-]{1,12}$"), text)


def quality(df: DataFrame, as_of: Column) -> DataFrame:
    """Diagnostics per series: duplicates, prices, jumps, gaps, staleness, and a status."""
    move = F.abs(F.log(F.try_divide(F.col("close"), F.lag("close").over(by_session()))))
    gap = F.datediff("session", F.lag("session").over(by_session()))
    marked = df.withColumn("_move", move).withColumn("_gap", gap)
    out = marked.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col("_gap") == 0, 1).otherwise(0)).cast("long").alias("duplicate_dates"),
        F.count_if(F.col("close") <= 0).alias("non_positive"),
        F.count_if(F.col("_move") > JUMP).alias("large_moves"),
        F.count_if(F.col("_gap") > GAP_DAYS).alias("long_gaps"),
        F.datediff(as_of, F.max("session")).cast("long").alias("stale_days"),
    )
    issue = (F.col("duplicate_dates") > 0) | (F.col("non_positive") > 0) | (F.col("large_moves") > 0) | (F.col("long_gaps") > 0) | (F.col("stale_days") > STALE_DAYS)
    return out.withColumn("status", F.when(issue, "annotated").otherwise("clean"))


def quality_details(df: DataFrame, as_of: Column, benchmarks: DataFrame) -> DataFrame:
    """series, code, severity, detail of every issue of a series; a series without issues has no row.

    benchmarks: benchmark, session. The series ends before one of them says nothing; one that ends before the series does.
    """
    ends = benchmarks.groupBy("benchmark").agg(F.max("session").alias("_e")).agg(F.min("_e").alias("_ends"))
    found = quality(df, as_of).join(ends)  # one row
    told = lambda n, code, severity, detail: F.when(n, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail")))
    text = lambda name, rest: F.concat(F.col(name).cast("string"), F.lit(rest))
    issues = F.array(
        told(F.col("duplicate_dates") > 0, "duplicate_dates", "error", text("duplicate_dates", " duplicate rows.")),
        told(F.col("non_positive") > 0, "non_positive_values", "error", F.lit("Non-positive prices found.")),
        told(F.col("large_moves") > 0, "large_single_day_move", "warning", F.lit("A single-day move exceeds 20%, which is inconsistent with adjusted data.")),
        told(F.col("long_gaps") > 0, "missing_sessions", "warning", text("long_gaps", " session gaps longer than 7 calendar days.")),
        told(F.col("stale_days") > STALE_DAYS, "stale_latest_observation", "warning", F.concat(F.lit("Latest observation is "), text("stale_days", " days old."))),
        told(F.col("_ends") < F.date_sub(as_of, F.col("stale_days").cast("int")), "benchmark_series_end_earlier", "warning", F.lit("One or more market benchmark series end before the stock series.")),
    )
    return found.select("series", F.explode(F.array_compact(issues)).alias("_i")).select("series", "_i.*")


def _exact(name: str) -> Column:
    """A number as text, to its last bit: its whole part and two runs of 53 binary places, or a mark for null and for what is not finite."""
    x = F.col(name).cast("double")
    places = (x - F.floor(x)) * 2.0**53
    rest = (places - F.floor(places)) * 2.0**53
    text = F.concat_ws(":", *(F.floor(p).cast("string") for p in (x, places, rest)))
    return F.when(x.isNull(), "null").when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(text)


def fingerprint(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Content hash of each series, in any order of its rows: of the sums of four pieces of its rows' hashes.

    Values count exactly, nulls too. Sums add up on the map side, so no task holds a series.
    """
    row = F.sha2(F.concat_ws("|", F.coalesce(F.col("session").cast("string"), F.lit("null")), *map(_exact, columns)), 256)
    pieces = [F.sum(F.conv(F.substring("_h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    rows = df.select("series", "session", row.alias("_h"))
    return rows.groupBy("series").agg(F.count(F.lit(1)).alias("n_rows"), F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.sha2(F.concat_ws(",", *pieces), 256).alias("content_hash"))


def validate(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """feature, n_rows, missing, infinite of every column, in one pass."""
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns)))
    long = df.select(parts.alias("_p")).select("_p.*")
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("x").isNull() | F.isnan("x")).alias("missing"), F.count_if(F.abs("x") == float("inf")).alias("infinite"))


def contract_problems(df: DataFrame, expected: tuple[str, ...], keys: tuple[str, ...] = ("series", "session")) -> DataFrame:
    """problem, feature, rows_found: where df breaks the contract of its features; no rows where it keeps it.

    From names alone: duplicate_column, missing_column, column_order (those there are in another order). From one pass over
    the rows: missing (null or NaN) and infinite values of the features that are there once. duplicate_key: keys that more than one row has.
    """
    names = df.columns
    there = [c for c in names if c in expected]
    single = [c for c in expected if names.count(c) == 1]
    known = [("duplicate_column", c) for c in sorted(set(names)) if names.count(c) > 1] + [("missing_column", c) for c in expected if c not in names]
    known += [("column_order", None)] if [c for c in expected if c in names] != list(dict.fromkeys(there)) else []
    schema = "problem string, feature string, rows_found long"
    out = df.sparkSession.createDataFrame([(p, c, None) for p, c in known], schema)
    keyed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.count(F.lit(1)).alias("rows_found"))
    out = out.union(keyed.where("rows_found > 0").select(F.lit("duplicate_key"), F.lit(None).cast("string"), "rows_found"))
    if single:
        bad = F.explode(F.array(F.struct(F.lit("missing").alias("problem"), F.col("missing").alias("rows_found")), F.struct(F.lit("infinite").alias("problem"), F.col("infinite").alias("rows_found"))))
        found = validate(df.select(*single), tuple(single)).select("feature", bad.alias("_b")).select("_b.problem", "feature", "_b.rows_found")
        out = out.union(found.where("rows_found > 0"))
    return out
