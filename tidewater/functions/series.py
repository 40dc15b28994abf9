"""Window helpers for series ordered by session."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

def by_session() -> WindowSpec:
    return W.partitionBy("series").orderBy("session")


def last(n: int, end: int = 0) -> WindowSpec:
    """The n rows up to ``end`` rows from the current one."""
    return by_session().rowsBetween(end - n + 1, end)


def full(aggregate: Column, x: Column, n: int) -> Column:
    """A rolling value, null until n values are there."""
    return F.when(F.count(x).over(last(n)) == n, aggregate.over(last(n)))


def position() -> Column:
    return (F.row_number().over(by_session()) - 1).cast("long")


def _decay(span: float) -> float:
    return 1 - 2.0 / (span + 1)


def block_rows(span: float) -> int:
    """Rows over which the decay stays within 10 ** -250, so that scaled sums don't leave the range of doubles."""
    return max(1, int(250 * math.log(10) / -math.log(_decay(span))))


def emas(df: DataFrame, wanted: dict[str, tuple[str, float]], order: str = "session") -> DataFrame:
    """Exponential means out: (x, span), y = a x + (1 - a) y' from y0 = x0, a = 2 / (span + 1), by windows alone.

    Within a block of rows the recurrence is a scaled running sum. A block's end is carried into the next one; what came
    before it has a weight below 1e-17, so blocks suit spans that are not too far apart and others get passes of their own.
    """
    plain = {out: x for out, (x, span) in wanted.items() if span <= 1}
    spans = sorted({span for _, span in wanted.values() if span > 1})
    df = df.withColumns({out: F.col(x).cast("double") for out, x in plain.items()})
    while spans:
        size = block_rows(spans[0])
        here = [span for span in spans if _decay(span) ** size < 1e-17]
        spans = spans[len(here) :]
        df = _block_means(df, {out: v for out, v in wanted.items() if v[1] in here}, size, order)
    return df


def _block_means(df: DataFrame, wanted: dict[str, tuple[str, float]], size: int, order: str) -> DataFrame:
    rows = W.partitionBy("series").orderBy(order)
    inside = W.partitionBy("series", "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    earlier = rows.rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_t", F.row_number().over(rows) - 1)
    df = df.withColumns({"_b": F.floor(F.col("_t") / size), "_k": F.col("_t") % size})
    local, carried = {}, {}
    for out, (x, span) in wanted.items():
        d = F.lit(_decay(span))
        weight = F.when(F.col("_t") == 0, F.lit(1.0)).otherwise(F.lit(1 - _decay(span)))
        local[f"_local_{out}"] = F.pow(d, F.col("_k")) * F.sum(weight * F.col(x) * F.pow(d, -F.col("_k"))).over(inside)
        end = F.last(F.when(F.col("_k") == size - 1, F.col(f"_local_{out}")), ignorenulls=True).over(earlier)
        carried[out] = F.col(f"_local_{out}") + F.pow(d, F.col("_k") + 1) * F.coalesce(end, F.lit(0.0))
    return df.withColumns(local).withColumns(carried).drop("_t", "_b", "_k", *local)


def ema(df: DataFrame, x: str, span: float, out: str, order: str = "session") -> DataFrame:
    return emas(df, {out: (x, span)}, order)
