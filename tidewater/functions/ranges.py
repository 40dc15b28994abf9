"""Very long series: windows over ranges of rows instead of whole series.

A series is cut into ranges of equally many rows, each led in by the last rows of the range before. What looks back at most
as far as the lead-in is computed within its range; exponential means count as such once the weight of what came before is
below the last bit of a double. Running sums are taken within ranges and raised by the sums of the ranges before, of which
a series has few. Places come from one sort by ranges of (series, session) and the numbers of rows before each, so no task
holds a whole series however long it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import written

#: Rows of a range.
ROWS = 1 << 16


def lead_in(frame: int, span: float = 1.0) -> int:
    """Rows that a range needs before it: for frames of so many rows, and for exponential means of this span."""
    decay = 1 - 2.0 / (span + 1)
    return max(frame, math.ceil(40 / -math.log(decay)) if decay > 0 else 1) + 1


def placed(df: DataFrame) -> DataFrame:
    """df with the place ``pos`` of each row in its series by session, from 0; rows of one session stand in any order."""
    rows = df.repartitionByRange("series", "session").sortWithinPartitions("series", "session").withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows, "ranges").withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("series", "_part").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("series").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = parts.select("series", "_part", (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_shift"))
    return rows.join(starts, ["series", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def by_ranges(df: DataFrame, build: Callable[[DataFrame], DataFrame], lead: int, sums: tuple[str, ...] = (), size: int = ROWS) -> DataFrame:
    """``build(df)`` for a function that looks back at most ``lead`` rows of a series, computed range by range.

    sums: columns of its result that are running sums over a series from its start. The result has the same rows and
    columns; df must not have columns ``pos``, ``_range`` and ``_series``. size is raised to the lead-in where it is less.
    """
    size = max(size, lead)
    own = F.col("pos") - F.col("pos") % size
    ranges = F.array_compact(F.array(own, F.when(F.col("pos") % size >= size - lead, own + size)))
    cut = placed(df).withColumn("_range", F.explode(ranges))
    # The key of a range takes the series' place, so every window of ``build`` stays within it.
    keyed = cut.withColumn("_series", F.col("series")).withColumn("series", F.concat_ws("\0", "series", "_range"))
    built = build(keyed)
    inside = F.col("pos") >= F.col("_range")
    if sums:
        w = W.partitionBy("series")
        # What a sum had reached in the lead-in is no part of its range.
        led = {f"_led_{c}": F.coalesce(F.max_by(F.when(~inside, F.col(c)), F.when(~inside, F.col("pos"))).over(w), F.lit(0.0)) for c in sums}
        built = built.withColumns(led).withColumns({c: F.col(c) - F.col(f"_led_{c}") for c in sums}).drop(*led)
    kept = built.where(inside)
    if sums:
        kept = written(kept, "ranges-built")
        ends = kept.groupBy("_series", "_range").agg(*(F.max_by(c, "pos").alias(c) for c in sums))
        earlier = W.partitionBy("_series").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        carry = ends.select("_series", "_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"_before_{c}") for c in sums))
        kept = kept.join(carry, ["_series", "_range"]).withColumns({c: F.col(c) + F.col(f"_before_{c}") for c in sums}).drop(*(f"_before_{c}" for c in sums))
    return kept.withColumn("series", F.col("_series")).drop("_series", "_range", "pos")
