"""Toxicity by a classifier chain.

Categories are predicted in order. Each is a logistic model over hashed words and the log odds of the categories
before it; for training these odds come out of fold, so a later model learns from predictions of the quality it will
get. The models are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, chosen by hash of the id), one task
per fold and with texts of the same features counted once, and applied to every whole text. Every combination of labels has its part
in the sample, however rare it is, and rows weigh what they stand for. A document is rejected if a rejecting category reaches ``THRESHOLD``.

Null texts are empty. Labels that are null are left out; several labels of one id count once, as positive if any is.
Labels of ids without a document are left out too. If the other labels lack a kind, nothing is known: probabilities
are null and nothing is rejected. Repeated rows are scored alike. Columns of the input that clash with a produced one
(``p_<category>``, ``rejected``) are replaced by it in ``judged`` and kept as they are by ``without_toxic``. A very long
text is scored whole. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .store import quoted, sliced, written

#: (category, label column, value that means positive), in the order of the chain.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
REJECTING = ("toxic",)
THRESHOLD = 0.5
SAMPLE_ROWS = 8_000
#: A combination of labels has at least this part of the sample's rows, or all it has.
LEAST_PART = 1 / 8
FOLDS = 3
FEATURES = 1 << 18
RIDGE = 0.5
TELLING = 5.0
LEAST_SEEN = 3
SEED = 4_001
KNOWN_WORDS = 150_000
#: Bytes of text that a worker scores and hands back at once.
SCORED_BYTES = 2 << 20
PREFIXES = (4, 5, 6)

_LETTERS = re.compile(r"[^\W\d_]+")


class Words:
    """Sorted distinct feature numbers of a text's lower-case words and of their beginnings, which inflections share."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = set(_LETTERS.findall((text or "").lower()))
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for word in words:
            if word not in known:
                parts = [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]
                known[word] = tuple(xxhash.xxh32_intdigest(x, SEED) % FEATURES for x in parts)
        return np.array(sorted(set(chain.from_iterable(map(known.__getitem__, words)))), np.int64)


class Logistic:
    """Weights of the words, of earlier categories' log odds, and the intercept, in one vector."""

    def __init__(self, weights: np.ndarray, earlier: int):
        self.words, self.odds, self.intercept = weights[:FEATURES], weights[FEATURES : FEATURES + earlier], float(weights[-1])

    def log_odds(self, features: np.ndarray, odds: list[float]) -> float:
        return float(self.words[features].sum() + sum(w * x for w, x in zip(self.odds, odds, strict=True)) + self.intercept)


def telling(features: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Numbers of the features whose share of positive rows is more than ``TELLING`` deviations from the overall one."""
    n, rate = len(labels), labels.mean()
    lengths = [len(f) for f in features]
    columns = np.concatenate(features)
    seen = np.bincount(columns, minlength=FEATURES)
    positive = np.bincount(columns, np.repeat(labels, lengths), FEATURES)
    spread = np.sqrt(np.maximum(seen * rate * (1 - rate) * (1 - seen / n), 1e-9))
    return np.flatnonzero((np.abs(positive - rate * seen) / spread >= TELLING) & (seen >= LEAST_SEEN))


def fit_logistic(
    features: list[np.ndarray], odds: np.ndarray, labels: np.ndarray, ridge: float = RIDGE, steps: int = 25, inner: int = 25, weights: np.ndarray | None = None
) -> np.ndarray:
    """Ridge-penalised logistic regression on the telling features, by Newton steps of preconditioned conjugate gradients."""
    n, earlier = odds.shape
    weights = np.ones(n) if weights is None else weights
    kept = telling(features, labels)
    place = np.full(FEATURES, -1, np.int32)
    place[kept] = np.arange(len(kept))
    columns = place[np.concatenate(features)]
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in features])[columns >= 0]
    columns = columns[columns >= 0]
    words, size = len(kept), len(kept) + earlier + 1
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, w[columns], n) + odds @ w[words:-1] + w[-1]

    def back(u: np.ndarray, square: bool = False) -> np.ndarray:
        return np.concatenate([np.bincount(columns, u[rows], words), (odds**2 if square else odds).T @ u, [u.sum()]])

    def loss(w: np.ndarray) -> float:
        z = forward(w)
        return float(weights @ (np.logaddexp(0, z) - labels * z) + penalty @ w**2 / 2)

    w = np.zeros(size)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        gradient = back(weights * (p - labels)) + penalty * w
        curve = weights * np.maximum(p * (1 - p), 1e-6)
        scale = 1 / (back(curve, square=True) + penalty)
        step, residual = np.zeros(size), -gradient
        z = scale * residual
        direction, rz = z, residual @ z
        for _ in range(inner if rz > 0 else 0):
            bent = back(curve * forward(direction)) + penalty * direction
            alpha = rz / (direction @ bent)
            step, residual = step + alpha * direction, residual - alpha * bent
            z = scale * residual
            rz, before = residual @ z, rz
            if rz <= 1e-10:
                break
            direction = z + rz / before * direction
        # Unequal weights may make a whole step too long.
        now = loss(w)
        while loss(w + step) > now and np.abs(step).max() >= 1e-3:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-3:
            break
    whole = np.zeros(FEATURES + earlier + 1)
    whole[kept], whole[FEATURES:] = w[:words], w[words:]
    return whole


def drawn_shares(counts: list[int], rows: int) -> list[float]:
    """Shares to draw of groups of these sizes, for about ``rows`` in all: one share, raised where it gives less than ``LEAST_PART``."""
    if sum(counts) <= rows:
        return [1.0] * len(counts)
    least = [min(n, max(1, rows * LEAST_PART)) for n in counts]
    raised: set[int] = set()
    while True:
        others = [k for k in range(len(counts)) if k not in raised]
        share = max(0.0, rows - sum(least[k] for k in raised)) / max(1, sum(counts[k] for k in others))
        more = {k for k in others if share * counts[k] < least[k]}
        if not more:
            return [least[k] / n if k in raised else share for k, n in enumerate(counts)]
        raised |= more


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame | None:
    """Features, 0/1 labels, fold and share drawn of about ``rows`` labelled documents; None if the labels lack either kind of a category.

    Of several rows of an id the least text stands for it, so that no id brings more than one row.
    """
    known = reduce(Column.__and__, (F.col(c).isNotNull() for _, c, _ in CATEGORIES)) & F.col("doc_id").isNotNull()
    kinds = [f"is_{name}" for name, _, _ in CATEGORIES]
    named = [F.max((F.col(c) == v).cast("int")).alias(kind) for kind, (_, c, v) in zip(kinds, CATEGORIES, strict=True)]
    once = labels.where(known).groupBy("doc_id").agg(*named).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    once = written(once, "toxic-known")
    groups = once.groupBy(*kinds).count().orderBy(*kinds).collect()  # 2 ** categories at most
    if any({r[kind] for r in groups} != {0, 1} for kind in kinds):
        return None
    shares = F.lit(None).cast("double")
    for r, share in zip(groups, drawn_shares([r["count"] for r in groups], rows), strict=True):
        shares = F.when(reduce(Column.__and__, (F.col(kind) == r[kind] for kind in kinds)), F.lit(share)).otherwise(shares)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 1).cast("double") / F.lit(2.0**63)
    chosen = once.withColumn("share", shares).where(draw <= F.col("share")).withColumn("fold", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(FOLDS)).cast("int"))
    # The sample has a bounded number of rows, so it may be broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(written(chosen, "toxic-labels")), "doc_id")
    texts = texts.groupBy("doc_id", *kinds, "fold", "share").agg(F.min("text").alias("text"))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            yield batch.assign(features=[words(x).astype("<i4").tobytes() for x in batch.pop("text")])

    schema = ", ".join(["doc_id long", *(f"{kind} int" for kind in kinds), "fold int", "share double", "features binary"])
    sample = texts.select("doc_id", *kinds, "fold", "share", "text").mapInPandas(numbered, schema)
    # Texts of the same features are copies; one of each combination of labels is enough, or a label's error would count many times.
    first = F.row_number().over(W.partitionBy(*kinds, "features").orderBy("doc_id"))
    return written(sample.withColumn("_first", first).where("_first = 1").drop("_first"), "toxic-sample")


def row_weights(labels: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """What rows drawn at these shares stand for, in units in which the rarer kind of label weighs its number of rows."""
    stands = 1 / shares
    rarer = labels == (stands @ labels < stands.sum() / 2)
    return stands / (stands[rarer] if rarer.any() else stands).mean()


def _fitter(label: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        features = [np.frombuffer(x, "<i4") for x in rows["features"]]
        earlier = np.stack(rows["odds"].to_numpy()).astype(float).reshape(len(rows), -1)
        labels = rows[label].to_numpy(float)
        w = fit_logistic(features, earlier, labels, weights=row_weights(labels, rows["share"].to_numpy(float)))
        return pd.DataFrame({"model": [int(rows["model"].iloc[0])], "weights": [w.astype("<f4").tobytes()]})

    return fit


def fit_chain(sample: DataFrame) -> list[Logistic]:
    """One model per category; every fold of a category is fitted in a task of its own."""
    odds = sample.withColumn("odds", F.array().cast("array<double>"))
    models_by_place: list[Logistic] = []
    for place, (name, _, _) in enumerate(CATEGORIES):
        last = place == len(CATEGORIES) - 1
        models = [-1] if last else [-1, *range(FOLDS)]

        asked = odds.withColumn("model", F.explode(F.array(*map(F.lit, models)))).where(F.col("model") != F.col("fold"))
        rows = asked.groupBy("model").applyInPandas(_fitter(f"is_{name}"), "model int, weights binary").collect()  # FOLDS + 1 vectors of fixed size
        found = {r["model"]: Logistic(np.frombuffer(bytes(r["weights"]), "<f4"), place) for r in rows}
        models_by_place.append(found[-1])
        if not last:
            odds = written(_out_of_fold(odds, found), "toxic-odds")
    return models_by_place


def _out_of_fold(odds: DataFrame, models: dict[int, Logistic]) -> DataFrame:
    """Append to each row's odds those of the model that has not seen its fold."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = zip(batch["fold"], batch["features"], batch["odds"], strict=True)
            yield batch.assign(odds=[[*o, models.get(k, models[-1]).log_odds(np.frombuffer(f, "<i4"), list(o))] for k, f, o in seen])

    return odds.mapInPandas(add, odds.schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with p_<category> of every category and ``rejected``; docs needs a column ``text``."""
    sample = labelled_sample(docs, labels)
    names = [f"p_{n}" for n, _, _ in CATEGORIES]
    docs = docs.drop(*names, "rejected")
    if sample is None:
        return docs.withColumns({n: F.lit(None).cast("double") for n in names} | {"rejected": F.lit(False)})
    fitted = docs.sparkSession.sparkContext.broadcast(fit_chain(sample))  # FEATURES numbers per category
    stops = [k for k, (n, _, _) in enumerate(CATEGORIES) if n in REJECTING]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in sliced(batches, "text", SCORED_BYTES):
            probabilities = np.empty((len(names), batch.num_rows))
            for j, text in enumerate(batch["text"]):
                features, odds = words(text.as_py()), []
                for model in fitted.value:
                    odds.append(model.log_odds(features, odds))
                probabilities[:, j] = odds
            probabilities = 1 / (1 + np.exp(-np.clip(probabilities, -30, 30)))
            rejected = (probabilities[stops] >= THRESHOLD).any(axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, probabilities), pa.array(rejected)], [*batch.schema.names, *names, "rejected"])

    found = [T.StructField(n, T.DoubleType()) for n in names] + [T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(score, T.StructType(docs.schema.fields + found))


def judged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = judged(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", *(f"p_{n}" for n, _, _ in CATEGORIES), "rejected")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with their own columns, each of which is sent to the classifier once."""
    needed = ("doc_id", "text")
    sent = [c.lower() if c.lower() in needed else f"_{k}" for k, c in enumerate(docs.columns)]
    own = docs.select(*(F.col(q).alias(s) for q, s in zip(quoted(docs), sent, strict=True)))
    kept = judged(own, labels).where(~F.col("rejected"))
    return kept.select(*(F.col(s).alias(c) for s, c in zip(sent, docs.columns, strict=True)))
