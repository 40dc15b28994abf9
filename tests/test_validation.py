"""Fold validation by extremes: against plain numpy fits on scaled windows, hand-worked folds, edge cases."""

import datetime as dt

import numpy as np
import pytest

from tidewater.operators import clean, metrics
from tidewater.operators import validation as V

SETUP = V.Validation(lookback=4, horizon=2, folds=2, min_train=12, size=6)


def frame(spark, closes, volumes, series="a"):
    day = dt.date(2020, 1, 1)
    rows = [(series, day + dt.timedelta(days=k), float(c), None if v is None else float(v)) for k, (c, v) in enumerate(zip(closes, volumes, strict=True))]
    return spark.createDataFrame(rows, "series string, session date, close double, volume double")


def walk(n, seed=3):
    rng = np.random.default_rng(seed)
    return 100 + np.cumsum(rng.normal(size=n)), rng.uniform(1, 9, n)


def folds_of(df, v):
    return V.fold_plan(df.groupBy("series").count().withColumnRenamed("count", "n"), v)


def test_folds_by_hand(spark):
    """26 rows: validation in [14, 20) and [20, 26); targets of 2 rows within, training ones from row 4."""
    df = frame(spark, *walk(26))
    found = [tuple(r) for r in folds_of(df, SETUP).orderBy("fold").select("fold", "train_lo", "train_hi", "val_lo", "val_hi", "train_targets", "val_targets").collect()]
    assert found == [(1, 0, 14, 14, 20, 9, 5), (2, 0, 20, 20, 26, 15, 5)]
    rolling = V.Validation(**(SETUP.__dict__ | {"rolling": True}))
    assert [r.train_lo for r in folds_of(df, rolling).orderBy("fold").collect()] == [2, 8]
    assert folds_of(frame(spark, *walk(23)), SETUP).count() == 0


@pytest.mark.parametrize("rolling", [False, True])
def test_ridge_on_scaled_windows(spark, rolling):
    v = V.Validation(**(SETUP.__dict__ | {"rolling": rolling}))
    close, volume = walk(40)
    df = frame(spark, close, volume)
    folds = folds_of(df, v)
    scored = V.price_forecasts(df, V.targets(df, ("close", "volume"), v), folds, ("close", "volume"), v)
    got = {(r.fold, r.t, r.horizon): r.predicted for r in scored.where("model = 'ridge'").collect()}
    raw, expected = np.stack([close, volume], 1), {}
    for f in folds.collect():
        part = raw[f.train_lo : f.train_hi]
        low, span = part.min(0), np.ptp(part, 0)
        scaled = (raw - low) / span
        starts = range(v.lookback, f.train_hi - v.horizon + 1)
        x = np.stack([scaled[s - 1] for s in starts])
        for h in range(v.horizon):
            y = np.array([scaled[s + h, 0] for s in starts])
            w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + np.eye(2), (x - x.mean(0)).T @ (y - y.mean()))
            for s in range(f.val_lo, f.val_hi - v.horizon + 1):
                expected[f.fold, s - 1, h + 1] = (y.mean() + (scaled[s - 1] - x.mean(0)) @ w) * span[0] + low[0]
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-8 for k in got)


@pytest.mark.parametrize("rolling", [False, True])
def test_moves_and_scores(spark, rolling):
    """Moves only between training rows; pooled scores and residuals of the first horizon as plain sums."""
    v = V.Validation(**(SETUP.__dict__ | {"rolling": rolling}))
    close, volume = walk(40)
    df = frame(spark, close, volume)
    folds = folds_of(df, v)
    moves = {r.fold: (r._ad, r._sd) for r in V.training_moves(df, folds).collect()}
    for f in folds.collect():
        d = np.diff(close[f.train_lo : f.train_hi])
        assert moves[f.fold] == pytest.approx((np.abs(d).mean(), (d**2).mean()))
    scored = V.price_forecasts(df, V.targets(df, ("close", "volume"), v), folds, ("close", "volume"), v)
    found = {(r.model, r.fold): r for r in V.price_folds(scored, V.training_moves(df, folds)).collect()}
    f = folds.where("fold = 1").collect()[0]
    starts = range(f.val_lo, f.val_hi - v.horizon + 1)
    actual = np.array([[close[s + h] for h in range(v.horizon)] for s in starts])
    origin = np.array([close[s - 1] for s in starts])
    e = actual - origin[:, None]
    got = found["persistence", 1]
    assert (got.mae, got.rmse, got.mase, got.relative_mae) == pytest.approx((np.abs(e).mean(), np.sqrt((e**2).mean()), np.abs(e).mean() / moves[1][0], 1.0))
    assert got.direction is None and [h.horizon for h in got.horizons] == [1, 2]
    assert [r.residual for r in got.residuals] == pytest.approx([round(round(a, 4) - round(o, 4), 4) for a, o in zip(actual[:, 0], origin, strict=True)], abs=1e-4)


def test_summary_and_diagnostics(spark):
    rows = spark.createDataFrame([("a", 1, 2.0, None), ("a", 2, 4.0, 1.0)], "series string, fold long, mae double, r2 double")
    found = {r.metric: (r.mean, r.sd, r.n, r.folds_completed) for r in V.summary(rows, ("series",), ("mae", "r2")).collect()}
    assert found == {"mae": (3.0, 1.0, 2, 2), "r2": (1.0, 0.0, 1, 2)}
    few = spark.createDataFrame([("a", [(k, 1.0 * k) for k in range(7)])], "series string, residuals array<struct<t:long,residual:double>>")
    assert V.pooled_diagnostics(few, ("series",)).count() == 0


def test_direction_by_hand(spark):
    """Closes rise on every third row only: training shares decide, 0 where even."""
    close = [100.0]
    for k in range(39):
        close.append(close[-1] + (2.0 if k % 3 == 0 else -1.0))
    v = V.Validation(**(SETUP.__dict__ | {"horizon": 1}))
    scored, folds = V.direction_forecasts(frame(spark, close, [1.0] * 40), v)
    ups = np.array([1 if k % 3 == 0 else 0 for k in range(39)])
    for f in folds.collect():
        train = ups[v.lookback : f.train_hi]
        rows = scored.where(f"fold = {f.fold}").orderBy("t").collect()
        assert [r.actual for r in rows] == ups[f.val_lo : f.val_hi].tolist()
        assert {round(r.probability, 12) for r in rows} == {round((train.sum() + 1) / (len(train) + 2), 12)} and {r.majority for r in rows} == {0}
    got = V.direction_folds(scored).orderBy("fold").collect()[0]
    assert (got.tp, got.fp, got.fn, got.tn) == (0, 0, 2, 4) and (got.precision, got.recall, got.f1, got.balanced_accuracy) == (0.0, 0.0, 0.0, 0.5)
    assert (got.naive, len(got.residuals), sum(r.absolute_error for r in got.residuals)) == (pytest.approx(4 / 6), 6, 2)


def test_edges(spark):
    """A constant feature has scale 1; null and NaN volumes don't count in extremes; flat closes have no scaled errors; no rows, no folds."""
    volumes = [None, float("nan")] + [5.0] * 38
    df = frame(spark, [7.0] * 40, volumes)
    folds = folds_of(df, SETUP)
    assert {(tuple(r.center), tuple(r.scale)) for r in V.extremes(df, folds, ("close", "volume")).collect()} == {((7.0, 5.0), (1.0, 1.0))}
    scored = V.price_forecasts(df, V.targets(df, ("close", "volume"), SETUP), folds, ("close", "volume"), SETUP)
    found = V.price_folds(scored, V.training_moves(df, folds)).collect()
    assert len(found) == 6 and all(r.mase is None and r.relative_mae is None and r.r2 is None and r.mae == pytest.approx(0) for r in found)
    none = df.where("false")
    assert V.price_folds(V.price_forecasts(none, V.targets(none, ("close",), SETUP), folds_of(none, SETUP), ("close",), SETUP), V.training_moves(none, folds_of(none, SETUP))).count() == 0


def test_training_majority_and_empty_classes(spark):
    rows = spark.createDataFrame([(1, 0.2, 0), (1, 0.4, 0), (1, 0.9, 1)], "actual int, probability double, training int")
    got = metrics.probability_report(rows, rows.training).collect()[0]
    assert (got.majority_accuracy, got.balanced_accuracy) == (0.0, pytest.approx(1 / 6))
    found = metrics.classification(rows.selectExpr("'x' AS k", "actual", "probability", "0 AS said"), ("k",)).where("k = 'x'").collect()[0]
    assert (found.precision, found.recall, found.f1, found.balanced_accuracy) == (0.0, 0.0, 0.0, 0.0)


def test_seeds_with_any_gap_are_dropped(spark):
    """Seeds 2 and 3 lack one metric each, so only seeds 1 and 4 count in both."""
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 9.0), ("a", 9.0, float("inf")), ("a", 3.0, 4.0), ("b", float("nan"), 1.0)], "model string, mae double, rmse double")
    found = {(r.model, r.metric): (r.mean, r.median, r.sd, r.best, r.worst, r.failures) for r in metrics.seed_summary(rows, ("model",), ("mae", "rmse")).collect()}
    assert found["a", "mae"] == (2.0, 2.0, 1.0, 1.0, 3.0, 2) and found["a", "rmse"] == (3.0, 3.0, 1.0, 2.0, 4.0, 2)
    assert found["b", "rmse"] == (None, None, None, None, None, 1)


def test_strict_readers(spark):
    bars = spark.createDataFrame([("a", "2020-01-02", 0, 1.0, 1.0), ("a", "2020-01-01", 1, float("nan"), 1.0), ("a", "2020-01-01", 2, 1.0, None), ("b", "2020-01-01", 0, 1.0, 0.0)], "series string, session string, at int, open double, volume double")
    whole = bars.selectExpr("series", "to_date(session) AS session", "at", "open", "1.0D AS high", "1.0D AS low", "1.0D AS close", "volume")
    assert {(r.violation, str(r.session), r.rows_found) for r in clean.strict_violations(whole, "at").collect()} == {("duplicate_session", "2020-01-01", 2), ("bad_price", "2020-01-01", 1), ("bad_volume", "2020-01-01", 1), ("disorder", "2020-01-01", 1)}
    rows = spark.createDataFrame([("a", 1, 1.0, float("inf"))], "series string, session int, x double, y double")
    assert [tuple(r) for r in clean.contract_problems(rows, ("x", "y")).collect()] == [("infinite", "y", 1)]
    twice = rows.selectExpr("series", "session", "y", "x", "x")
    assert {(r.problem, r.feature) for r in clean.contract_problems(twice, ("x", "y", "z")).collect()} == {("duplicate_column", "x"), ("missing_column", "z"), ("column_order", None), ("infinite", "y")}
    assert clean.contract_problems(rows.where("false"), ("x", "y")).count() == 0
