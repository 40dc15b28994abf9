"""Exact top-k inner products by no-random-access aggregation.

Each component has a list of candidates sorted by its contribution to a query's score. The lists are read downwards
together, for all queries of a block at once. A candidate's components read so far bound its score: from above with the
value at the reading front for those unread, from below with the last value of their lists. Reading goes on until no
unread candidate can reach a query's k-th best score and few of those read still can; these get their final scores.

Queries and candidates meet in blocks of bounded size. A block of candidates is read in portions, longest vectors
first; each query carries its k-th best final score from portion to portion, so later ones are judged against it from
the start, and a portion none of whose lists reaches it is not read at all. Each block keeps its k best per query, and
the best of these are the answer. Every query is scored against all rows this way: no index, no sample, no cap.

Vectors that are null or hold null or non-finite components take no part; only vectors of equal length meet, and empty
ones score 0. Rows with the query's id are its own. Rows of one id and length ask once, with the least vector. Ties go
to the smaller id; repeated rows of another id each count. Components times 256 are assumed to stay below 2**31 in size
and scores below 2**63. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K = 5
QUERY_EVERY = 50
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 1024
PORTION = 2048
#: Shares of the lists at which reading may pause, and the share of pairs whose scores may then be resolved.
DEPTHS = (0.25, 0.5, 0.625, 0.75, 0.875, 1.0)
RESOLVED = 0.08


def whole_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dim and floor(256 x) of all components x as 64-bit numbers, for usable rows of vec_id and embedding."""
    for batch in batches:
        ids, vectors = batch
        present = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False))
        ids, vectors = ids.take(pa.array(present)), vectors.take(pa.array(present))
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
        good = np.flatnonzero(bad[ends] == bad[ends - lengths])
        whole = np.floor(256.0 * np.where(np.isfinite(values), values, 0.0)).astype(np.int64)
        packed = [whole[a:b].tobytes() for a, b in zip((ends - lengths)[good].tolist(), ends[good].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(good)).cast(pa.int64()), pa.array(lengths[good].astype(np.int32)), pa.array(packed, pa.binary())], ["vec_id", "dim", "v"])


class Lists:
    """Candidates' components as sorted lists: the lists, largest value first, and each value's place in its list."""

    def __init__(self, values: np.ndarray):
        self.values = values
        order = np.argsort(-values, axis=0, kind="stable")
        self.places = np.empty(order.shape, np.int32)
        np.put_along_axis(self.places, order, np.arange(len(values), dtype=np.int32)[:, None], axis=0)
        self.sorted = np.take_along_axis(values, order, axis=0)

    def front(self, pos: np.ndarray, neg: np.ndarray, depth: int) -> np.ndarray:
        """The most that a candidate unread at this depth can score; negative weights read their lists from the end."""
        return pos @ self.sorted[depth - 1] - neg @ self.sorted[len(self.values) - depth]

    def bounds(self, pos: np.ndarray, neg: np.ndarray, depth: int, upper: bool) -> np.ndarray:
        """Upper or lower bounds of all scores, a row per query."""
        n = len(self.values)
        above, below = (depth - 1, n - depth) if upper else (n - 1, 0)
        down = np.where(self.places < depth, self.values, self.sorted[above])
        up = np.where(self.places >= n - depth, self.values, self.sorted[below])
        return pos @ down.T - neg @ up.T


def contenders(lists: Lists, queries: np.ndarray, own: tuple[np.ndarray, np.ndarray], least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that may be among the k best of their query; own pairs are left out.

    least: each query's k-th best score so far, -inf where there are fewer.
    """
    n = len(lists.values)
    pos, neg = np.maximum(queries, 0), np.maximum(-queries, 0)
    asking = np.flatnonzero(lists.front(pos, neg, 1) >= least)
    if not len(asking):
        return asking, asking
    pos, neg, least = pos[asking], neg[asking], least[asking]
    place = np.full(len(queries), -1)
    place[asking] = np.arange(len(asking))
    row = place[own[0]]
    row, column = row[row >= 0], own[1][row >= 0]
    for share in DEPTHS:
        depth = max(1, min(n, int(np.ceil(n * share))))
        # Lower bounds say little before the end of the lists; a score carried here says more.
        if depth < n and (lists.front(pos, neg, depth) >= least).any():
            continue
        upper = lists.bounds(pos, neg, depth, True)
        upper[row, column] = -np.inf
        if depth == n and n > k:
            least = np.maximum(least, np.partition(upper, n - k, axis=1)[:, n - k])
        alive = (upper >= least[:, None]) & (upper > -np.inf)
        if depth == n or np.count_nonzero(alive) <= RESOLVED * alive.size:
            break
    at, candidate = np.nonzero(alive)
    return asking[at], candidate


def _stacked(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["v"]), np.int64).reshape(len(rows), -1) if rows["dim"].iloc[0] else np.zeros((len(rows), 0), np.int64)


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row's scores, ties to smaller ids."""
    by = np.lexsort((ids, -scores, rows))
    rank = np.arange(len(by)) - np.searchsorted(rows[by], rows[by])
    return by[rank < k]


def _block(k: int, portion: int):
    def block(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The k best candidates of this block for each of its queries."""
        found = [np.zeros((3, 0), np.int64)]
        if len(candidates) and len(queries):
            weights, values = _stacked(queries), _stacked(candidates)
            ids, asked = candidates["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            # Sums of whole numbers are exact in single precision below 2**24; below 2**53 in double, else bounds get a margin.
            most = float(np.abs(values).max(initial=0)) * float(np.abs(weights).max(initial=0)) * max(1, values.shape[1])
            kind, margin = np.float32 if most < 1 << 24 else np.float64, most * 2.0**-40 if most >= 1 << 53 else 0.0
            by = np.argsort(-(values.astype(np.float64) ** 2).sum(axis=1), kind="stable")
            least = np.full(len(asked), -np.inf)
            for low in range(0, len(by), portion):
                here = by[low : low + portion]
                order = np.argsort(ids[here], kind="stable")
                bounds = [np.searchsorted(ids[here][order], asked, side) for side in ("left", "right")]
                own = np.repeat(np.arange(len(asked)), bounds[1] - bounds[0])
                mine = order[np.concatenate([np.arange(a, b) for a, b in zip(*bounds, strict=True)]).astype(np.int64)]
                row, candidate = contenders(Lists(values[here].astype(kind)), weights.astype(kind), (own, mine), least - margin, k)
                scores = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", weights[row[j : j + 65536]], values[here[candidate[j : j + 65536]]]) for j in range(0, len(row), 65536))])
                merged = np.concatenate((found[-1], np.stack((row, ids[here[candidate]], scores))), axis=1)
                merged = merged[:, _best(merged[0], merged[2], merged[1], k)]
                found = [merged]
                many = np.bincount(merged[0], minlength=len(asked)) >= k
                worst = np.full(len(asked), np.inf)
                np.minimum.at(worst, merged[0], merged[2].astype(np.float64))
                least = np.where(many, worst, -np.inf)
            return pd.DataFrame({"query_id": asked[found[0][0]], "vec_id": found[0][1], "score": found[0][2]})
        return pd.DataFrame({"query_id": found[0][0], "vec_id": found[0][1], "score": found[0][2]})

    return block


def top_inner_products(vectors: DataFrame, every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best."""
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(whole_vectors, "vec_id long, dim int, v binary")
    query = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    n, n_queries = vectors.agg(F.count("vec_id"), F.count_if(query)).first()
    blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    hashed = lambda seed, many: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(many))
    every_block = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)).cast("array<long>"))
    left = rows.select("vec_id", "dim", "v", hashed(1, blocks).alias("block"), every_block(query_blocks).alias("query_block"))
    asked = rows.where(query).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    right = asked.select("vec_id", "dim", "v", hashed(2, query_blocks).alias("query_block"), every_block(blocks).alias("block"))
    keys = ("dim", "block", "query_block")
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_block(k, PORTION), "query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
