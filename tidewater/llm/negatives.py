"""Hard negatives by slot-decomposed selection.

Every positive of an anchor asks for the best negatives whose score lies between two shares of its own. These windows
overlap; their upper limits alone, in descending order, split all scores into disjoint slots, and a negative belongs to
one slot. Each block of rows keeps the best k of each anchor and slot, and so does every task before it sends them on: k
rows a slot are all that a window can need. From the lowest slot upwards, merging a slot's best with the best of all
slots under it gives the k best under each limit; what falls below a window's lower limit is dropped at the end.

Anchors meet rows in blocks of bounded size: for the positives those of their own label only, for the negatives those of
every label. Each anchor is compared with every row that may count: no index, no sample, no cap.

Rows take no part whose id, label or vector is null or whose vector holds a null or non-finite component; only vectors of
equal length meet, and empty ones score 0. Rows with the anchor's id are its own and neither positive nor negative to it.
Rows of one id ask once, with the least length, label and vector. Higher scores come first, ties by smaller id; repeated
rows of another id each count, as positives with an answer of their own. A positive of negative score has no window and no
rows. Components times 256 are assumed to stay below 2**31 in size and scores below 2**63. Other columns are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import written

POSITIVES, NEGATIVES = 5, 3
ANCHOR_EVERY, RELABELLED_EVERY, LABELS = 50, 7, 10
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 50, 95
ROW_BLOCK, ANCHOR_BLOCK = 8192, 4096
#: Scores held at a time.
CELLS = 1 << 21


def usable(vectors: DataFrame, relabelled: int = RELABELLED_EVERY, labels: int = LABELS) -> DataFrame:
    """vec_id, label, dim and whole components of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    label = F.when(F.col("vec_id") % relabelled == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("long")
    whole = F.transform(x, lambda c: F.floor(256.0 * c))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.size("embedding").alias("dim"), whole.alias("v"))


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["v"].to_numpy()).astype(np.int64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0), np.int64)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while these hold every sum, else in whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 1 << 53 else a @ b.T


def first_k(keys: list[np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each combination of keys: higher scores first, then smaller ids."""
    by = np.lexsort((ids, -scores, *keys[::-1]))
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.any([key[by][1:] != key[by][:-1] for key in keys], axis=0)
    start = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    return by[np.arange(len(by)) - start < k]


def _positives(k: int):
    def block(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        """The first k rows of this block for each of its anchors, all of one label."""
        best = np.zeros((3, 0), np.int64)
        if len(rows) and len(anchors):
            a, v, ids, asked = _matrix(anchors), _matrix(rows), rows["vec_id"].to_numpy(), anchors["vec_id"].to_numpy()
            step = max(1, CELLS // len(asked))
            for low in range(0, len(ids), step):
                part, mine = _scores(a, v[low : low + step]), ids[low : low + step]
                at, col = np.nonzero(asked[:, None] != mine[None, :])
                best = np.concatenate((best, np.stack((asked[at], mine[col], part[at, col]))), axis=1)
                best = best[:, first_k([best[0]], best[2], best[1], k)]
        return pd.DataFrame({"anchor_id": best[0], "positive_id": best[1], "positive_score": best[2]})

    return block


def _negatives(k: int):
    def block(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        """The first k rows of this block for each anchor and slot, of labels other than the anchor's."""
        best = np.zeros((4, 0), np.int64)
        if len(rows) and len(anchors):
            a, v, ids, asked = _matrix(anchors), _matrix(rows), rows["vec_id"].to_numpy(), anchors["vec_id"].to_numpy()
            label, labels = anchors["label"].to_numpy(), rows["label"].to_numpy()
            many = max(map(len, anchors["limits"]))
            limits = np.full((len(asked), many), np.iinfo(np.int64).min)
            for j, own in enumerate(anchors["limits"]):
                limits[j, : len(own)] = own
            floor = anchors["least"].to_numpy()
            worst = np.full((len(asked), many), np.iinfo(np.int64).min)  # the k-th best of each slot so far
            step = max(1, CELLS // len(asked))
            for low in range(0, len(ids), step):
                part, mine = _scores(a, v[low : low + step]), ids[low : low + step]
                open_ = (part >= floor[:, None]) & (part <= limits[:, :1]) & (label[:, None] != labels[None, low : low + step]) & (asked[:, None] != mine[None, :])
                at, col = np.nonzero(open_)
                score = part[at, col]
                slot = (limits[at] >= score[:, None]).sum(axis=1) - 1
                top = score >= worst[at, slot]
                new = np.stack((at[top], slot[top], mine[col[top]], score[top]))
                best = np.concatenate((best, new), axis=1)
                best = best[:, first_k([best[0], best[1]], best[3], best[2], k)]
                cell = best[0] * many + best[1]
                full = np.flatnonzero(np.bincount(cell, minlength=worst.size) >= k)
                least = np.full(worst.size, np.iinfo(np.int64).max)
                np.minimum.at(least, cell, best[3])
                worst.ravel()[full] = least[full]
            best[0] = asked[best[0]]
        return pd.DataFrame({"anchor_id": best[0], "slot": best[1], "negative_id": best[2], "negative_score": best[3]})

    return block


def _share(hundredths: int, up: bool) -> Column:
    """So many hundredths of positive_score (at least 0), rounded up or down, without a product that could overflow."""
    return F.expr(f"positive_score div 100 * {hundredths} + (positive_score % 100 * {hundredths} + {99 if up else 0}) div 100")


def _hashed(seed: int, many: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(many))


def _every(many: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(many - 1)).cast("array<long>"))


def _top(rows: DataFrame, keys: tuple[str, ...], score: str, vec_id: str, k: int) -> DataFrame:
    """rows with place, the k first per key; Spark keeps k a key in each task before the shuffle."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), vec_id))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def positives_of(rows: DataFrame, anchors: DataFrame, blocks: int, anchor_blocks: int, k: int = POSITIVES) -> DataFrame:
    """anchor_id, positive_id, positive_score and place (from 1) of each anchor's first rows of its label."""
    left = rows.select("*", _hashed(1, blocks).alias("block"), _every(anchor_blocks).alias("anchor_block"))
    right = anchors.select("*", _hashed(2, anchor_blocks).alias("anchor_block"), _every(blocks).alias("block"))
    keys = ("label", "dim", "block", "anchor_block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_positives(k), "anchor_id long, positive_id long, positive_score long")
    return _top(found, ("anchor_id",), "positive_score", "positive_id", k)


def merged_slots(best: DataFrame, many: int, k: int = NEGATIVES) -> DataFrame:
    """anchor_id, slot and ``first``: the k best of this slot and all under it, from the lowest slot upwards. best: at most k rows a slot."""
    row = F.struct((-F.col("negative_score")).alias("order"), F.col("negative_id").alias("id"))
    slots = best.groupBy("anchor_id").agg(*(F.collect_list(F.when(F.col("slot") == s, row)).alias(f"_{s}") for s in range(many)))
    out = []
    for s in range(many - 1, -1, -1):
        under = F.col(f"_{s}") if s == many - 1 else F.concat(f"_{s}", f"_first_{s + 1}")
        slots = slots.withColumn(f"_first_{s}", F.slice(F.array_sort(under), 1, k))
        out.append(F.struct(F.lit(s).alias("slot"), F.col(f"_first_{s}").alias("first")))
    return slots.select("anchor_id", F.explode(F.array(*out)).alias("_s")).select("anchor_id", "_s.*")


def hard_negatives(vectors: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = written(usable(vectors), "negatives-rows")
    asks = F.col("vec_id") % every == 0
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if(asks)).first()
    blocks, anchor_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-n_anchors // ANCHOR_BLOCK))
    anchors = rows.where(asks).groupBy("vec_id").agg(F.min(F.struct("dim", "label", "v")).alias("_a")).select("vec_id", "_a.*")
    found = positives_of(rows, anchors, blocks, anchor_blocks, positives).where("positive_score >= 0")
    found = written(found.withColumn("slot", F.col("place") - 1), "negatives-positives")
    # Scores come in descending order, so the limits do as well, and the last positive's lower limit is the least.
    limits = found.groupBy("anchor_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", _share(high, up=False).alias("limit")))), lambda x: x["limit"]).alias("limits"),
        F.min(_share(low, up=True)).alias("least"),
    )
    asked = written(anchors.join(limits.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "negatives-anchors")
    left = rows.select("*", _hashed(1, blocks).alias("block"), _every(anchor_blocks).alias("anchor_block"))
    right = asked.select("*", _hashed(2, anchor_blocks).alias("anchor_block"), _every(blocks).alias("block"))
    keys = ("dim", "block", "anchor_block")
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_negatives(negatives), "anchor_id long, slot long, negative_id long, negative_score long")
    best = _top(best, ("anchor_id", "slot"), "negative_score", "negative_id", negatives)
    merged = merged_slots(best, positives, negatives)
    answers = found.join(merged, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("first").alias("_k", "_n"))
    score = -F.col("_n.order")
    kept = answers.where(score >= _share(low, up=True))
    return kept.select("anchor_id", "positive_id", (F.col("_k") + 1).cast("int").alias("rank"), F.col("_n.id").alias("negative_id"), "positive_score", score.alias("negative_score"))
