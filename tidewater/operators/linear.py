"""Linear candidates over all folds, horizons and penalties from one pass over the rows.

All that a linear fit needs of its rows are the sums of products of their columns (1, features, targets). Tasks take these
sums per batch of rows, series and segment, a segment being the rows between the ends of two folds' training parts; the
sums are added up per segment, and expanding folds are running sums over a series' few segments. So rows are read once
however many folds and candidates there are, no rows of a series are gathered, and what is shuffled are matrices of a size
that depends on the number of columns alone. Features are shifted and scaled by the first fold's scaler before products
are taken, which keeps the sums well conditioned; another fold's scaler only rescales the matrices.

Rows with a null, NaN or infinite feature or target are left out of fits; series without a fold have no rows in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.series import by_session
from .samples import Study, multiplicity, numbered, tail_folds


@dataclass(frozen=True)
class Penalty:
    """Least squares with a penalty on the weights of scaled features; ``l1`` None is a ridge of n-free alpha, else an elastic net."""

    name: str
    alpha: float
    l1: float | None = None


RIDGE = Penalty("ridge", 1.0)
ELASTIC_NET = Penalty("elastic_net", 1.0, 0.5)
#: Penalty and lasso share of the grid of elastic nets.
GRID_POINTS = ((0.01, 0.01), (0.01, 0.05), (0.01, 0.15), (0.1, 0.01), (0.3, 0.01), (1.0, 0.01), (3.0, 0.01), (10.0, 0.01))
GRID = tuple(Penalty(f"elastic_net_a{a:g}_l{r:g}", a, r) for a, r in GRID_POINTS)


def sample_rows(df: DataFrame, features: tuple[str, ...], study: Study, lags: int = 1, first: int | None = None, before: bool = False) -> DataFrame:
    """series, s, t, session, origin, x (features of the last ``lags`` rows, oldest first), y (log returns per horizon) and actual (prices).

    first: row of a series' first origin; the first one with whole features where not given. before: x ends at the row
    before the origin, not at the origin's.
    """
    rows, end = numbered(df), -1 if before else 0
    first = lags - 1 - end if first is None else first
    ahead = [F.lead("close", h).over(by_session()).cast("double") for h in study.horizons]
    own = F.array(*(F.col(c).cast("double") for c in features))
    x = own if lags == 1 and not before else F.flatten(F.collect_list(own).over(by_session().rowsBetween(end + 1 - lags, end)))
    rows = rows.select("series", "session", "t", F.col("close").cast("double").alias("origin"), x.alias("x"), F.array(*ahead).alias("actual"))
    rows = rows.where((F.col("t") >= first) & ~F.exists("actual", lambda a: a.isNull()))
    return rows.withColumn("s", F.col("t") - first).withColumn("y", F.transform("actual", lambda a: F.log(F.try_divide(a, F.col("origin")))))


def fold_plan(rows: DataFrame, study: Study) -> DataFrame:
    return tail_folds(rows.groupBy("series").agg(F.count(F.lit(1)).alias("n")), study)


def robust_scalers(df: DataFrame, folds: DataFrame, features: tuple[str, ...], lags: int = 1) -> DataFrame:
    """series, fold, train_hi, center and scale (arrays over features) of each fold's training windows, all features in one pass."""
    joined = numbered(df).join(folds.select("series", "fold", "train_hi"), "series").where(F.col("t") < F.col("train_hi") + lags - 1)
    times = multiplicity(F.col("t"), F.col("train_hi"), lags).cast("long")
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    points = joined.withColumn("_m", times).groupBy("series", "fold", "train_hi").agg(*(F.percentile(F.col(c), quarters, F.col("_m")).alias(f"_{k}") for k, c in enumerate(features)))
    spread = [F.col(f"_{k}")[2] - F.col(f"_{k}")[0] for k in range(len(features))]
    scale = F.array(*(F.when(x == 0, F.lit(1.0)).otherwise(x) for x in spread))
    return points.select("series", "fold", "train_hi", F.array(*(F.col(f"_{k}")[1] for k in range(len(features)))).alias("center"), scale.alias("scale"))


def sample_scalers(rows: DataFrame, folds: DataFrame, width: int) -> DataFrame:
    """The same from the samples' own x, each sample once; for samples of one row of features."""
    joined = rows.join(folds.select("series", "fold", "train_hi"), "series").where("s < train_hi")
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    points = joined.groupBy("series", "fold", "train_hi").agg(*(F.percentile(F.get("x", F.lit(k)), quarters).alias(f"_{k}") for k in range(width)))
    spread = [F.col(f"_{k}")[2] - F.col(f"_{k}")[0] for k in range(width)]
    scale = F.array(*(F.when(x == 0, F.lit(1.0)).otherwise(x) for x in spread))
    return points.select("series", "fold", "train_hi", F.array(*(F.col(f"_{k}")[1] for k in range(width))).alias("center"), scale.alias("scale"))


def _products(lags: int):
    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (series, segment), rows in batch.groupby(["series", "segment"], sort=False):
                x, y = np.stack(rows["x"].to_numpy()), np.stack(rows["y"].to_numpy())
                x = (x - np.tile(rows["center"].iloc[0], lags)) / np.tile(rows["scale"].iloc[0], lags)
                z = np.concatenate((np.ones((len(x), 1)), x, y), axis=1)
                z = z[np.isfinite(z).all(axis=1)]
                out.append((series, segment, (z.T @ z).ravel()))
            yield pd.DataFrame(out, columns=["series", "segment", "m"])

    return products


def segment_products(rows: DataFrame, scalers: DataFrame, lags: int = 1) -> DataFrame:
    """series, segment and m: sums of products of (1, shifted features, targets), row by row of the matrix."""
    ends = scalers.groupBy("series").agg(F.sort_array(F.collect_list("train_hi")).alias("ends"), F.min_by(F.struct("center", "scale"), "fold").alias("_s"))
    parts = rows.join(ends, "series").where(F.col("s") < F.array_max("ends"))
    parts = parts.select("series", F.size(F.filter("ends", lambda e: e <= F.col("s"))).alias("segment"), "x", "y", "_s.center", "_s.scale")
    sums = parts.mapInPandas(_products(lags), "series string, segment int, m array<double>")
    cells = sums.select("series", "segment", F.posexplode("m").alias("pos", "v")).groupBy("series", "segment", "pos").agg(F.sum("v").alias("v"))
    return cells.groupBy("series", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda c: c["v"]).alias("m"))


def ridge_weights(gram: np.ndarray, right: np.ndarray, alpha: float) -> np.ndarray:
    return np.linalg.solve(gram + alpha * np.eye(len(gram)), right)


def elastic_net_weights(gram: np.ndarray, right: np.ndarray, lasso: np.ndarray, ridge: np.ndarray, rounds: int = 2000, least: float = 1e-12) -> np.ndarray:
    """Coordinate descent for many penalties at once: a column of ``right`` and an entry of ``lasso`` and ``ridge`` for each."""
    w = np.zeros(right.shape)
    diagonal = np.diag(gram)[:, None] + ridge[None, :]
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(gram)):
            rest = right[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rest) * np.maximum(np.abs(rest) - lasso, 0.0) / np.where(diagonal[j] > 0, diagonal[j], 1.0)
            moved = max(moved, float(np.abs(new - w[j]).max(initial=0)))
            w[j] = new
        if moved <= least * max(1.0, float(np.abs(w).max(initial=0))):
            break
    return w


def _solved(horizons: tuple[int, ...], penalties: tuple[Penalty, ...], lags: int):
    def solve(sums: pd.DataFrame, scalers: pd.DataFrame) -> pd.DataFrame:
        """Weights of every fold, horizon and penalty of a series, for features as they are."""
        out = []
        if not len(sums) or not len(scalers):
            return pd.DataFrame(out, columns=["series", "fold", "model", "horizon", "n", "intercept", "weights"])
        h, scalers = len(horizons), scalers.sort_values("fold")
        size = round(np.sqrt(len(sums["m"].iloc[0])))
        p = size - 1 - h
        ends = np.sort(scalers["train_hi"].to_numpy())
        shift, unit = (np.tile(scalers[c].iloc[0], lags) for c in ("center", "scale"))
        for fold in scalers.itertuples():
            inside = sums["segment"] <= np.searchsorted(ends, fold.train_hi)
            m = np.sum(np.stack(sums["m"][inside].to_numpy()), axis=0).reshape(size, size) if inside.any() else np.zeros((size, size))
            n = m[0, 0]
            if n < 1:
                continue
            mean = m[0, 1:] / n
            centred = m[1:, 1:] - n * np.outer(mean, mean)
            scale = np.tile(fold.scale, lags)
            factor = unit / scale
            gram, right = centred[:p, :p] * np.outer(factor, factor), centred[:p, p:] * factor[:, None]
            nets = [x for x in penalties if x.l1 is not None]
            found = {x.name: ridge_weights(gram, right, x.alpha) for x in penalties if x.l1 is None}
            if nets:
                lasso, squared = (np.repeat([n * x.alpha * s(x.l1) for x in nets], h) for s in (lambda r: r, lambda r: 1 - r))
                w = elastic_net_weights(gram, np.tile(right, len(nets)), lasso, squared)
                found |= {x.name: w[:, k * h : (k + 1) * h] for k, x in enumerate(nets)}
            for name, w in found.items():
                raw = w / scale[:, None]
                intercept = mean[p:] - (shift + unit * mean[:p]) @ raw
                out += [(fold.series, fold.fold, name, horizon, int(n), float(intercept[k]), raw[:, k]) for k, horizon in enumerate(horizons)]
        return pd.DataFrame(out, columns=["series", "fold", "model", "horizon", "n", "intercept", "weights"])

    return solve


def fitted(rows: DataFrame, scalers: DataFrame, horizons: tuple[int, ...], penalties: tuple[Penalty, ...] = (RIDGE, ELASTIC_NET), lags: int = 1) -> DataFrame:
    """series, fold, model, horizon, n (training rows), intercept, weights (for unscaled x) of every linear candidate."""
    sums = segment_products(rows, scalers, lags)
    schema = "series string, fold long, model string, horizon long, n long, intercept double, weights array<double>"
    return sums.groupBy("series").cogroup(scalers.groupBy("series")).applyInPandas(_solved(horizons, penalties, lags), schema)


def linear_value(x: Column, weights: Column, intercept: Column) -> Column:
    return F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), intercept, lambda total, v: total + v)


def fitted_forecasts(rows: DataFrame, folds: DataFrame, models: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Forecast prices of validation rows by fitted models, with persistence, in the columns of the baselines' forecasts."""
    places = {h: k for k, h in enumerate(horizons)}
    place = F.element_at(F.create_map(*(F.lit(v) for pair in places.items() for v in pair)), F.col("_m.horizon").cast("int"))
    inside = rows.join(folds.select("series", "fold", "train_hi", "val_lo", "val_hi"), "series").where("s >= val_lo and s < val_hi")
    packed = models.groupBy("series", "fold").agg(F.collect_list(F.struct("model", "horizon", "intercept", "weights")).alias("_models"))
    none = F.array(*(F.struct(F.lit("persistence").alias("model"), F.lit(h).cast("long").alias("horizon"), F.lit(0.0).alias("intercept"), F.lit(None).cast("array<double>").alias("weights")) for h in horizons))
    long = inside.join(packed, ["series", "fold"]).withColumn("_m", F.explode(F.concat("_models", none)))
    value = F.when(F.col("_m.weights").isNull(), F.lit(0.0)).otherwise(linear_value(F.col("x"), F.col("_m.weights"), F.col("_m.intercept")))
    actual = F.get("actual", place)
    return long.select("_m.model", "series", "fold", "_m.horizon", "train_hi", "s", "t", "session", "origin", actual.alias("actual"), (F.col("origin") * F.exp(value)).alias("predicted"))


def nonnegative_weights(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least squares without negative weights from products alone, by an active set: members come in while the error falls with them."""
    n = len(right)
    w, free = np.zeros(n), np.zeros(n, bool)
    tiny = 1e-10 * max(1e-300, float(np.abs(right).max(initial=0)))
    for _ in range(3 * n * n + 3):
        slope = right - gram @ w
        if free.all() or slope[~free].max() <= tiny:
            break
        free[np.flatnonzero(~free)[np.argmax(slope[~free])]] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(gram[np.ix_(free, free)], right[free], rcond=None)[0]
            if (trial[free] > 0).all():
                w = trial
                break
            down = free & (trial <= 0)
            step = np.min(w[down] / np.maximum(w[down] - trial[down], 1e-300))
            w = w + step * (trial - w)
            free &= w > 1e-14
            w[~free] = 0.0
            if not free.any():
                break
    return w


def _moves(scored: DataFrame, members: tuple[str, ...]) -> DataFrame:
    """series, fold, s, horizon, _y and a column per member: log returns from the origin, of the rows where all have one."""
    move = lambda c: F.log(F.try_divide(F.col(c), F.col("origin")))
    return scored.where(F.col("model").isin(*members)).groupBy("series", "fold", "s", "horizon").agg(
        F.first(move("actual")).alias("_y"), F.first("origin").alias("origin"), F.first("actual").alias("actual"), *(F.max(F.when(F.col("model") == m, move("predicted"))).alias(f"_m{k}") for k, m in enumerate(members)),
    ).dropna(subset=["_y", *(f"_m{k}" for k in range(len(members)))])


def blend_weights(scored: DataFrame, members: tuple[str, ...]) -> DataFrame:
    """series and weights (array over members): non-negative, of sum at most 1, fitted on the log returns of all folds but each series' last.

    Only sums of products leave the rows; all horizons count alike. A series with one fold has no rows.
    """
    names = [f"_m{k}" for k in range(len(members))]
    last = scored.groupBy("series").agg(F.max("fold").alias("_last"))
    rows = _moves(scored.join(last, "series").where(F.col("fold") < F.col("_last")), members)
    sums = rows.groupBy("series").agg(F.array(*(F.sum(F.col(a) * F.col(b)) for a in names for b in names)).alias("g"), F.array(*(F.sum(F.col(a) * F.col("_y")) for a in names)).alias("r"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for g, r in zip(batch["g"], batch["r"], strict=True):
                w = nonnegative_weights(np.reshape(g, (len(r), len(r))), np.asarray(r, float))
                found.append(w / max(1.0, w.sum()))
            yield pd.DataFrame({"series": batch["series"], "weights": found})

    return sums.where(~F.exists("g", lambda v: v.isNull())).mapInPandas(solve, "series string, weights array<double>")


def blended(scored: DataFrame, members: tuple[str, ...], weights: DataFrame) -> DataFrame:
    """Forecasts of the blend on each series' last fold, which had no part in its weights; model is ``blend``."""
    last = scored.groupBy("series").agg(F.max("fold").alias("fold"))
    rows = _moves(scored.join(last, ["series", "fold"]), members).join(weights, "series")
    move = linear_value(F.array(*(F.col(f"_m{k}") for k in range(len(members)))), F.col("weights"), F.lit(0.0))
    return rows.select(F.lit("blend").alias("model"), "series", "fold", "s", "horizon", "origin", "actual", (F.col("origin") * F.exp(move)).alias("predicted"))


def shrunk(scored: DataFrame, steps: int = 20) -> DataFrame:
    """model, series, horizon and alpha: the share of each model's log return that had the least mean absolute error on all folds but the last."""
    keys = W.partitionBy("series")
    rows = scored.withColumn("_last", F.max("fold").over(keys)).where("fold < _last")
    p, a = (F.log(F.try_divide(F.col(c), F.col("origin"))) for c in ("predicted", "actual"))
    errors = rows.groupBy("model", "series", "horizon").agg(*(F.avg(F.abs(F.lit(k / steps) * p - a)).alias(f"_{k}") for k in range(steps + 1)))
    grid = F.array(*(F.struct(F.col(f"_{k}").alias("e"), F.lit(k / steps).alias("alpha")) for k in range(steps + 1)))
    return errors.select("model", "series", "horizon", F.array_min(grid)["alpha"].alias("alpha"), F.array_min(grid)["e"].alias("mae"))
