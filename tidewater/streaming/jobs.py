"""Late-data rules as structured streams; each has a batch twin that tests compare it with."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

LATE = "2 days"


def deduplicated(articles: DataFrame, keys: tuple[str, ...], late: str = LATE) -> DataFrame:
    """The first of rows with equal keys within the watermark; articles need available_at."""
    return articles.withWatermark("available_at", late).dropDuplicatesWithinWatermark(list(keys))


def windowed_scores(articles: DataFrame, width: str = "1 day", late: str = LATE) -> DataFrame:
    """Count and mean score per key and window of the time at which articles are available."""
    windows = articles.withWatermark("available_at", late).groupBy("ticker", F.window("available_at", width))
    return windows.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score")).select("ticker", F.col("window.start").alias("start"), "n", "score")


def pointers(events: DataFrame) -> DataFrame:
    """Current and previous version per ticker, updated with every batch of promotion events (ticker, seq, action, version)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, previous, barred = state.get if state.exists else (None, None, "")
        rejected = set(filter(None, barred.split("\n")))
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            if row.action == "promote" and row.version not in rejected and row.version != current:
                current, previous = row.version, current
            elif row.action == "reject":
                rejected.add(row.version)
            elif row.action == "rollback" and previous is not None:
                current, previous = previous, None
        state.update((current, previous, "\n".join(sorted(rejected))))
        yield pd.DataFrame({"ticker": [key[0]], "current": [current], "previous": [previous]})

    return events.groupBy("ticker").applyInPandasWithState(update, "ticker long, current string, previous string", "current string, previous string, rejected string", "update", "NoTimeout")
