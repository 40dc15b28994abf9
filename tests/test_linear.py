"""Linear candidates from products against plain fits on the rows themselves."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import linear as L
from tidewater.operators.samples import Study

STUDY = Study(lookback=1, horizons=(1, 3), folds=3, share=8)
FEATURES = ("a", "b", "flat", "wide")


def panel(n=180, seed=3):
    rng = np.random.default_rng(seed)
    frames = []
    for name, size in (("x", n), ("y", n - 40), ("short", 6)):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, size)))
        frames.append(pd.DataFrame({"series": name, "session": pd.date_range("2020-01-01", periods=size), "close": close, "a": rng.normal(size=size), "b": rng.normal(3, 0.1, size), "flat": 7.0, "wide": 1e7 + 1e5 * rng.normal(size=size)}))
    return pd.concat(frames)


@pytest.fixture(scope="module")
def frame():
    return panel()


@pytest.fixture(scope="module")
def given(spark, frame):
    return spark.createDataFrame(frame).withColumn("session", F.to_date("session"))


def plain(frame, lags, penalties, descent=4000):
    """{(series, fold, model, horizon): (intercept, weights, predictions by s)} by fits on the stacked windows."""
    out, ahead = {}, max(STUDY.horizons)
    for name, own in frame.groupby("series"):
        close, raw = own["close"].to_numpy(), own[list(FEATURES)].to_numpy()
        n = len(own) - lags + 1 - ahead
        if n <= 0:
            continue
        x = np.stack([raw[s : s + lags].ravel() for s in range(n)])
        origin = np.array([close[s + lags - 1] for s in range(n)])
        y = np.stack([[math.log(close[s + lags - 1 + h] / origin[s]) for h in STUDY.horizons] for s in range(n)])
        size = n // STUDY.share
        for fold in range(STUDY.folds):
            low = n - (STUDY.folds - fold) * size
            train = low - ahead
            if train <= 0 or not size:
                continue
            stacked = np.concatenate([raw[s : s + lags] for s in range(train)])
            q = np.quantile(stacked, [0.25, 0.5, 0.75], axis=0)
            scale = np.where(q[2] == q[0], 1.0, q[2] - q[0])
            z = (x - np.tile(q[1], lags)) / np.tile(scale, lags)
            zc, yc = z[:train] - z[:train].mean(axis=0), y[:train] - y[:train].mean(axis=0)
            for penalty in penalties:
                for k, h in enumerate(STUDY.horizons):
                    if penalty.l1 is None:
                        w = np.linalg.solve(zc.T @ zc + penalty.alpha * np.eye(z.shape[1]), zc.T @ yc[:, k])
                    else:
                        w = np.zeros(z.shape[1])
                        step = train / (np.linalg.norm(zc, 2) ** 2 + train * penalty.alpha * (1 - penalty.l1))
                        for _ in range(descent):  # proximal gradient, another algorithm for the same objective
                            slope = zc.T @ (zc @ w - yc[:, k]) / train + penalty.alpha * (1 - penalty.l1) * w
                            w = w - step * slope
                            w = np.sign(w) * np.maximum(np.abs(w) - step * penalty.alpha * penalty.l1, 0)
                    intercept = y[:train, k].mean() - z[:train].mean(axis=0) @ w
                    raw_w = w / np.tile(scale, lags)
                    value = {s: origin[s] * math.exp(intercept + z[s] @ w) for s in range(low, low + size)}
                    out[name, fold, penalty.name, h] = (intercept - np.tile(q[1] / scale, lags) @ w, raw_w, value, train)
    return out


@pytest.mark.parametrize("lags", [1, 3])
def test_fits_match_plain_ones_on_all_folds(spark, given, frame, lags):
    penalties = (L.RIDGE, L.Penalty("net", 0.001, 0.5), L.Penalty("strong", 1.0, 0.5))
    rows = L.sample_rows(given, FEATURES, STUDY, lags)
    folds = L.fold_plan(rows, STUDY)
    scalers = L.robust_scalers(given, folds, FEATURES, lags)
    models = L.fitted(rows, scalers, STUDY.horizons, penalties, lags).cache()
    want = plain(frame, lags, penalties)
    found = {(r["series"], r["fold"], r["model"], r["horizon"]): r for r in models.collect()}
    assert found.keys() == want.keys() and len(want) >= 2 * 3 * 3 * 2
    for key, (intercept, weights, _, n) in want.items():
        r = found[key]
        least = 1e-8 if key[2] == "ridge" else 1e-6
        scale = max(1e-12, float(np.abs(weights).max()))
        assert r["n"] == n and np.allclose(r["weights"], weights, rtol=1e-6, atol=least * scale)
        assert r["intercept"] == pytest.approx(intercept, abs=1e-8)
    scored = L.fitted_forecasts(rows, folds, models, STUDY.horizons).collect()
    assert len([r for r in scored if r["model"] != "persistence"]) == sum(len(v[2]) for v in want.values())
    for r in scored:
        if r["model"] == "persistence":
            assert r["predicted"] == r["origin"]
        else:
            assert r["predicted"] == pytest.approx(want[r["series"], r["fold"], r["model"], r["horizon"]][2][r["s"]], rel=1e-7)


def test_a_strong_penalty_leaves_the_mean(spark, given):
    rows = L.sample_rows(given, FEATURES, STUDY)
    folds = L.fold_plan(rows, STUDY)
    models = L.fitted(rows, L.robust_scalers(given, folds, FEATURES), STUDY.horizons, (L.ELASTIC_NET,)).where("series = 'x' and fold = 2 and horizon = 3").first()
    assert not any(models["weights"])
    train = folds.where("series = 'x' and fold = 2").first()["train_hi"]
    assert models["intercept"] == pytest.approx(rows.where(f"series = 'x' and s < {train}").agg(F.avg(F.col("y")[1])).first()[0], abs=1e-12)


def test_bad_rows_are_left_out_of_fits(spark, given):
    rows = L.sample_rows(given, FEATURES, STUDY)
    folds = L.fold_plan(rows, STUDY)
    scalers = L.robust_scalers(given, folds, FEATURES).cache()
    broken = rows.withColumn("x", F.when(F.col("s") == 5, F.array(*(F.lit(float("nan")) for _ in FEATURES))).otherwise(F.col("x")))
    n = {r["fold"]: r["n"] for r in L.fitted(rows, scalers, STUDY.horizons, (L.RIDGE,)).where("series = 'x' and horizon = 1").collect()}
    less = {r["fold"]: r["n"] for r in L.fitted(broken, scalers, STUDY.horizons, (L.RIDGE,)).where("series = 'x' and horizon = 1").collect()}
    assert {k: v - 1 for k, v in n.items()} == less
    assert L.fitted(rows.limit(0), scalers.limit(0), STUDY.horizons).count() == 0


def test_rows_are_read_once_and_only_products_are_shuffled(spark, given):
    rows = L.sample_rows(given, FEATURES, STUDY)
    scalers = L.robust_scalers(given, L.fold_plan(rows, STUDY), FEATURES)
    plan = L.segment_products(rows, scalers)._jdf.queryExecution().executedPlan().toString()
    below = plan[: plan.index("MapInPandas")]
    assert below.count("Exchange") == 2 and "partial_sum" in below


@pytest.mark.parametrize("seed", range(6))
def test_nonnegative_weights_are_the_best_of_all_subsets(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 6))
    x, y = rng.normal(size=(40, n)), rng.normal(size=40)
    if seed == 5:
        x[:, -1] = x[:, 0]
    gram, right = x.T @ x, x.T @ y
    cost = lambda w: w @ gram @ w - 2 * w @ right
    best = 0.0
    for bits in range(1, 1 << n):
        chosen = [k for k in range(n) if bits >> k & 1]
        w = np.zeros(n)
        w[chosen] = np.linalg.lstsq(gram[np.ix_(chosen, chosen)], right[chosen], rcond=None)[0]
        best = min(best, cost(w)) if (w >= 0).all() else best
    found = L.nonnegative_weights(gram, right)
    assert (found >= 0).all() and cost(found) == pytest.approx(best, abs=1e-9)


def test_blend_is_fitted_before_and_scored_on_the_last_fold(spark):
    rng = np.random.default_rng(0)
    rows = []
    for fold in range(3):
        for s in range(30):
            for h in (1, 3):
                y, noise = rng.normal(0, 0.02), rng.normal(0, 0.01, 2)
                lie = 5.0 if fold == 2 else 1.0  # the last fold must not teach
                for m, v in (("a", 0.5 * y + noise[0]), ("b", 0.4 * y * lie + noise[1]), ("c", -y), ("persistence", 0.0)):
                    rows.append((m, "x", fold, h, s, 100.0, 100 * math.exp(y), 100 * math.exp(v)))
    scored = spark.createDataFrame(rows, "model string, series string, fold long, horizon long, s long, origin double, actual double, predicted double")
    members = ("a", "b", "c")
    w = L.blend_weights(scored, members).first()["weights"]
    early = [r for r in rows if r[2] < 2]
    x = np.array([[math.log(r[7] / 100) for r in early if r[0] == m] for m in members]).T
    y = np.array([math.log(r[6] / 100) for r in early if r[0] == "a"])
    plain_w = L.nonnegative_weights(x.T @ x, x.T @ y)
    plain_w = plain_w / max(1.0, plain_w.sum())
    assert np.allclose(w, plain_w) and w[2] == 0 and sum(w) <= 1 + 1e-12
    out = L.blended(scored, members, L.blend_weights(scored, members)).collect()
    assert {r["fold"] for r in out} == {2} and len(out) == 60
    r = out[0]
    own = {x[0]: math.log(x[7] / 100) for x in rows if x[2] == 2 and x[3] == r["horizon"] and x[4] == r["s"]}
    assert math.log(r["predicted"] / 100) == pytest.approx(sum(a * own[m] for a, m in zip(w, members, strict=True)))
    # Opposite forecasts keep nothing, and ties go to the smallest share.
    alphas = {(r["model"], r["horizon"]): r["alpha"] for r in L.shrunk(scored).collect()}
    assert alphas["c", 1] == 0 and alphas["persistence", 3] == 0 and alphas["a", 1] > 0.5
