"""Features of very long series by ranges of rows against those of whole series."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewater.functions.ranges import by_ranges, lead_in, placed
from tidewater.operators import features


@pytest.fixture(scope="module")
def long_bars(spark):
    n = F.col("id")
    close = 100 + 20 * F.sin(n / 37.0) + F.pmod(F.xxhash64(n), F.lit(1000)) / 250.0
    one = spark.range(9000).select(F.lit("long").alias("series"), F.date_add(F.lit(dt.date(1900, 1, 1)), n.cast("int")).alias("session"), close.alias("close"))
    few = spark.range(5).select(F.lit("few").alias("series"), F.date_add(F.lit(dt.date(1950, 1, 1)), n.cast("int")).alias("session"), (n + 1.0).alias("close"))
    both = one.unionByName(few)
    return both.withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 2, "volume": F.pmod(F.xxhash64("session"), F.lit(90)).cast("double")}).cache()


def rows(df, columns):
    return sorted(tuple(r) for r in df.select("series", "session", *columns).collect())


@pytest.mark.parametrize("size", [1, 700, 1 << 16])
def test_ranges_give_what_whole_series_give(spark, long_bars, size):
    columns = ("sma_20", "bb_lower", "ema_20", "macd", "macd_signal", "rsi_14", "atr_14", "obv")
    ranged = by_ranges(long_bars.repartition(7), features.technical, lead_in(20, 26), ("obv",), size)
    found, want = rows(ranged, columns), rows(features.technical(long_bars), columns)
    assert len(found) == len(want) == 9005
    for a, b in zip(found, want, strict=True):
        assert a[:2] == b[:2]
        assert all((x is None and y is None) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[2:], b[2:], strict=True))


def test_no_window_holds_more_than_a_range_and_its_lead_in(spark, long_bars):
    seen = []

    def build(df):
        seen.append(df.groupBy("series").count().agg(F.max("count"), F.count(F.lit(1))).first())
        return df.withColumn("total", F.sum("close").over(features.by_session()))

    out = by_ranges(long_bars, build, 50, ("total",), 500).cache()
    assert seen[0][0] == 550 and seen[0][1] >= 19
    last = out.where("series = 'long'").orderBy(F.desc("session")).first()["total"]
    assert last == pytest.approx(long_bars.where("series = 'long'").agg(F.sum("close")).first()[0])
    assert set(out.columns) == {*long_bars.columns, "total"}
    assert by_ranges(long_bars.limit(0), features.technical, 50, ("obv",)).count() == 0


def test_places_follow_sessions_over_partitions(spark, long_bars):
    found = placed(long_bars.repartition(5)).where("series = 'long'").select("pos", F.datediff("session", F.lit(dt.date(1900, 1, 1))).alias("d")).collect()
    assert len(found) == 9000 and all(r["pos"] == r["d"] for r in found)
