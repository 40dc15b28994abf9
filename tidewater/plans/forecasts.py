"""Queries on samples, folds, forecasts and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forecast, metrics
from ..operators import samples as S
from ..sources.tables import BARS_SQL, bars, table
from .features import rounded

STUDY = S.Study()


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.baseline_forecasts(bars(spark, sf), STUDY)


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """actual, probability and a training target of every labelled document."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    return table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", "source", F.col("quality").alias("actual"), F.col("toxic").alias("training_target"), ((F.col("n_chars") % 997 + 1) / F.lit(1000.0)).alias("probability"))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.samples(bars(spark, sf), STUDY).groupBy("series").agg(F.count(F.lit(1)).alias("n"))


def direct_targets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.direct_targets(bars(spark, sf), STUDY.horizons), ("series", "session", "horizon"), {"price_level": 2, "simple_return": 6, "log_return": 8, "persistence_residual": 2})


def sample_windows_digest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.window_digest(bars(spark, sf), 60), ("series", "session", "n"), {"total": 2, "first": 2, "last": 2})


def sample_windows_before(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that leave their origin out."""
    return rounded(S.window_digest(bars(spark, sf), 60, origin_in_window=False), ("series", "session", "n"), {"total": 2, "first": 2, "last": 2})


def fold_plan_tail(spark: SparkSession, sf: str) -> DataFrame:
    return S.tail_folds(_counts(spark, sf), STUDY)


def fold_plan_front(spark: SparkSession, sf: str) -> DataFrame:
    return S.front_folds(_counts(spark, sf), 60, 20, 25, 5)


def holdout_windows(spark: SparkSession, sf: str) -> DataFrame:
    return S.holdout_windows(_counts(spark, sf), 4, 12, 80, 60, 5)


def robust_scaler_fold(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.numbered(bars(spark, sf))
    return rounded(S.robust_scaler(rows, S.tail_folds(_counts(spark, sf), STUDY), "close", STUDY.lookback), ("series", "fold"), {"center": 3, "scale": 3})


def minmax_scaler_fold(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.numbered(bars(spark, sf))
    return rounded(S.minmax_scaler(rows, S.tail_folds(_counts(spark, sf), STUDY), "close", STUDY.lookback), ("series", "fold"), {"data_min": 2, "data_max": 2})


def latest_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.latest_window(bars(spark, sf), 60)
    return rows.select("series", "session", F.size("window").cast("long").alias("n"), F.round(F.element_at("window", 1), 2).alias("first"), F.round(F.element_at("window", -1), 2).alias("last"))


_SCORES = {"mae": 3, "median_ae": 3, "rmse": 3, "mape": 6, "smape": 6, "bias": 3, "r2": 6, "direction": 6, "direction_agreeing": 6}


def persistence_drift_report(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.relative(metrics.report(scored(spark, sf)))
    return rounded(found, ("model", "horizon", "n"), _SCORES | {"relative_mae": 8, "relative_rmse": 8})


def series_report(spark: SparkSession, sf: str) -> DataFrame:
    """The same per series."""
    found = metrics.relative(metrics.report(scored(spark, sf), ("model", "series")), keys=("series", "horizon"))
    return rounded(found, ("model", "series", "horizon", "n"), {"mae": 3, "rmse": 3, "direction": 6, "relative_mae": 8, "relative_rmse": 8})


def _fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.relative(metrics.report(scored(spark, sf), ("model", "series"), "fold"), keys=("series", "fold")).where("fold is not null")


def scaled_errors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.scaled_errors(scored(spark, sf), bars(spark, sf), STUDY.lookback, STUDY.gap), ("model", "series", "fold"), {"mase": 8, "rmsse": 8})


def cross_fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.cross_fold(_fold_scores(spark, sf), ("model", "series"), ("relative_mae", "relative_rmse", "direction")), ("model", "series", "metric", "n"), {"mean": 8, "sd": 8})


def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.fold_summary(_fold_scores(spark, sf), ("model", "series")), ("model", "series", "wins", "folds", "promotable"), dict.fromkeys(("median_relative_mae", "median_relative_rmse", "worst_relative_rmse"), 8))


def direction_base_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(forecast.base_rate(bars(spark, sf)), ("series", "n", "label"), {"probability": 8})


def train_mean_return(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(forecast.train_mean(bars(spark, sf), S.tail_folds(_counts(spark, sf), STUDY), STUDY.lookback, STUDY.horizons), ("series", "fold", "horizon", "n"), {"mean_return": 8})


def probability_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = probabilities(spark, sf)
    names = dict.fromkeys(("accuracy", "balanced_accuracy", "majority_accuracy", "brier", "log_loss", "ece"), 8)
    return rounded(metrics.probability_report(rows, F.col("training_target")), ("n",), names)


def reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.reliability(probabilities(spark, sf)), ("bin", "n"), {"mean_probability": 8, "observed": 8})


def classification_by_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = probabilities(spark, sf).withColumn("said", (F.col("probability") >= 0.5).cast("int"))
    return rounded(metrics.classification(rows, ("source",)), ("source", "tp", "fp", "fn", "tn"), dict.fromkeys(("precision", "recall", "f1", "balanced_accuracy", "brier", "naive"), 8))


def _quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles around the origin, spread by a share of it that depends on the sample."""
    rows = scored(spark, sf).where("model = 'persistence'")
    taus = F.explode(F.array(*map(F.lit, (0.1, 0.5, 0.9))))
    wide = F.when(F.col("s") % 11 == 0, -0.05).otherwise(0.4)
    return rows.withColumn("tau", taus).withColumn("predicted", F.col("origin") * (1 + (F.col("tau") - 0.5) * wide))


def pinball(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.quantile_scores(_quantiles(spark, sf)), ("tau", "n"), {"pinball": 3, "below": 8})


def quantile_crossing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.crossing_rate(_quantiles(spark, sf), ("series", "fold", "s", "horizon")), ("n",), {"crossing_rate": 8})


def conformal_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    return rounded(metrics.interval_scores(rows, metrics.conformal_radius(rows, 0.9).drop("n")), ("model", "horizon", "n"), {"radius": 3, "coverage": 8, "width": 3})


def residual_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).where("horizon = 1")
    names = {"mean": 3, "sd": 3, "durbin_watson": 6, "skew": 6, "excess_kurtosis": 6, "ljung_box": 5, "ljung_box_p": 6}
    return rounded(metrics.residual_diagnostics(rows, ("model", "series"), "s"), ("model", "series", "n", "autocorrelated"), names)


def residual_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("actual") - F.col("predicted")
    return scored(spark, sf).where("horizon = 1").select("model", "series", "fold", "s", F.round(e, 3).alias("residual"), F.round(F.abs(e), 3).alias("absolute"), F.round(100 * e / F.col("actual"), 6).alias("percent"))


def volatility_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.volatility(bars(spark, sf)), ("series",), dict.fromkeys(("daily", "annual", "per_horizon", "extreme"), 8))


def shrinkage_alpha(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(forecast.shrinkage(scored(spark, sf).where("model = 'drift'")), ("model", "horizon"), {"alpha": 2, "mae": 3})


def ridge_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Ridge of the next log return on the last one, per series."""
    from pyspark.sql import Window as W

    by = W.partitionBy("series").orderBy("session")
    rows = bars(spark, sf).withColumn("x", F.log(F.col("close") / F.lag("close").over(by))).withColumn("y", F.log(F.lead("close").over(by) / F.col("close")))
    return rounded(forecast.ridge_one(rows, "x", "y", ("series",), 10.0), ("series", "n"), {"slope": 8, "intercept": 8})


def seed_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Folds stand for seeds."""
    return rounded(metrics.seed_summary(_fold_scores(spark, sf), ("model",), ("relative_mae", "relative_rmse")), ("model", "metric", "failures"), dict.fromkeys(("mean", "median", "sd", "best", "worst"), 8))


QUERIES = {f.__name__: f for f in (
    persistence_drift_report, direct_targets, sample_windows_digest, sample_windows_before, fold_plan_tail, fold_plan_front, holdout_windows, robust_scaler_fold, minmax_scaler_fold, latest_windows,
    series_report, scaled_errors, cross_fold_scores, fold_summary, direction_base_rate, train_mean_return, probability_report, reliability_bins, classification_by_source, pinball,
    quantile_crossing, conformal_intervals, residual_diagnostics, residual_rows, volatility_stats, shrinkage_alpha, ridge_fit, seed_summary,
)}

SAMPLES_SQL = f"""{BARS_SQL},
sm AS (SELECT series, session, t, t - 59 AS s, close AS origin, lag(close, 59) OVER w AS fc, lead(close, 1) OVER w AS y1, lead(close, 5) OVER w AS y5, lead(close, 20) OVER w AS y20
  FROM b WINDOW w AS (PARTITION BY series ORDER BY session) QUALIFY fc IS NOT NULL AND y20 IS NOT NULL),
n AS (SELECT series, count(*) AS n FROM sm GROUP BY 1),
f0 AS (SELECT series, n, unnest(generate_series(0, 4)) AS fold FROM n),
folds AS (SELECT series, fold, CAST(0 AS BIGINT) AS train_lo, n - (5 - fold) * (n // 12) - 20 AS train_hi, n - (5 - fold) * (n // 12) AS val_lo, n - (5 - fold) * (n // 12) + n // 12 AS val_hi FROM f0
  WHERE n - (5 - fold) * (n // 12) - 20 > 0 AND n // 12 > 0)"""

SCORED_SQL = f"""{SAMPLES_SQL},
lg AS (SELECT sm.series, fold, train_hi, s, t, session, origin, fc, unnest([1, 5, 20]) AS horizon, unnest([y1, y5, y20]) AS actual FROM sm JOIN folds ON sm.series = folds.series AND s >= val_lo AND s < val_hi),
sc AS (SELECT 'persistence' AS model, lg.*, origin AS predicted FROM lg UNION ALL SELECT 'drift', lg.*, origin + horizon * (origin - fc) / 59 FROM lg)"""

_REPORT = """count(*) AS n, avg(abs(actual - predicted)) AS mae, quantile_cont(abs(actual - predicted), 0.5) AS median_ae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
  avg(CASE WHEN actual <> 0 THEN 100 * abs((actual - predicted) / actual) END) AS mape,
  avg(CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0 ELSE 200 * abs(actual - predicted) / (abs(actual) + abs(predicted)) END) AS smape, avg(actual - predicted) AS bias,
  1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) AS r2,
  avg(CASE WHEN actual <> origin AND predicted <> origin THEN CASE WHEN sign(actual - origin) = sign(predicted - origin) THEN 1.0 ELSE 0.0 END END) AS direction,
  avg(CASE WHEN sign(actual - origin) = sign(predicted - origin) THEN 1.0 ELSE 0.0 END) AS direction_agreeing"""


def _r(names: dict[str, int]) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c, d in names.items())


def fold_sql(base: str) -> str:
    """CTE fs, the scores of each fold over persistence's, from CTE sc in ``base``."""
    return f"""{base}, fs0 AS (SELECT model, series, fold, {_REPORT} FROM sc GROUP BY 1, 2, 3),
fs AS (SELECT a.*, a.mae / nullif(p.mae, 0) AS relative_mae, a.rmse / nullif(p.rmse, 0) AS relative_rmse FROM fs0 a JOIN fs0 p ON p.model = 'persistence' AND a.series = p.series AND a.fold = p.fold)"""


_FOLD_SQL = fold_sql(SCORED_SQL)

_PROB_SQL = """pr AS (SELECT doc_id, source, quality AS actual, toxic AS training_target, (n_chars % 997 + 1) / 1000.0::DOUBLE AS probability FROM labels JOIN documents USING (doc_id)),
bins AS (SELECT least(CAST(floor(probability * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(probability) AS mean_probability, avg(actual) AS observed FROM pr GROUP BY 1)"""

_QUANT_SQL = f"""{SCORED_SQL}, q AS (SELECT series, fold, s, horizon, tau, actual, origin * (1 + (tau - 0.5) * CASE WHEN s % 11 = 0 THEN -0.05 ELSE 0.4 END) AS predicted
  FROM sc, (SELECT unnest([0.1::DOUBLE, 0.5, 0.9]) AS tau) WHERE model = 'persistence')"""

_DIAG_LAGS = ", ".join(f"sum(c * l{k}) AS l{k}" for k in range(1, 11))
_DIAG_Q = " + ".join(f"pow(l{k} / cc, 2) / (n - {k})" for k in range(1, 11))

SQL = {
    "persistence_drift_report": f"""WITH {SCORED_SQL}, rp AS (SELECT model, horizon, {_REPORT} FROM sc GROUP BY GROUPING SETS ((model, horizon), (model)))
      SELECT a.model, CAST(a.horizon AS BIGINT) AS horizon, a.n, {", ".join(f"round(a.{c}, {d}) AS {c}" for c, d in _SCORES.items())}, round(a.mae / nullif(p.mae, 0), 8) AS relative_mae, round(a.rmse / nullif(p.rmse, 0), 8) AS relative_rmse
      FROM rp a JOIN rp p ON p.model = 'persistence' AND a.horizon IS NOT DISTINCT FROM p.horizon""",
    "direct_targets": f"""WITH {BARS_SQL}, l AS (SELECT series, session, close AS origin, unnest([1, 5, 20]) AS horizon, unnest([lead(close, 1) OVER w, lead(close, 5) OVER w, lead(close, 20) OVER w]) AS y FROM b WINDOW w AS (PARTITION BY series ORDER BY session))
      SELECT series, session, CAST(horizon AS BIGINT) AS horizon, round(y, 2) AS price_level, round(y / origin - 1, 6) AS simple_return, round(ln(y / origin), 8) AS log_return, round(y - origin, 2) AS persistence_residual FROM l WHERE y IS NOT NULL""",
    "sample_windows_digest": f"""WITH {BARS_SQL} SELECT series, session, CAST(60 AS BIGINT) AS n, round(sum(close) OVER w, 2) AS total, round(first_value(close) OVER w, 2) AS first, round(close, 2) AS last
      FROM b WINDOW w AS (PARTITION BY series ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 60""",
    "sample_windows_before": f"""WITH {BARS_SQL} SELECT series, session, CAST(60 AS BIGINT) AS n, round(sum(close) OVER w, 2) AS total, round(first_value(close) OVER w, 2) AS first, round(prev, 2) AS last
      FROM b WINDOW w AS (PARTITION BY series ORDER BY session ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER w = 60""",
    "fold_plan_tail": f"WITH {SAMPLES_SQL} SELECT series, CAST(fold AS BIGINT) AS fold, train_lo, train_hi, val_lo, val_hi FROM folds",
    "fold_plan_front": f"""WITH {SAMPLES_SQL} SELECT series, CAST(fold AS BIGINT) AS fold, CAST(0 AS BIGINT) AS train_lo, 60 + fold * 25 AS train_hi, 80 + fold * 25 AS val_lo, 105 + fold * 25 AS val_hi FROM f0 WHERE 105 + fold * 25 <= n""",
    "holdout_windows": f"""WITH {SAMPLES_SQL}, w AS (SELECT series, n, unnest(generate_series(0, 3)) AS win FROM n WHERE n - 80 >= 48), e AS (SELECT series, win, CASE WHEN win = 3 THEN n ELSE 80 + (win + 1) * ((n - 80) // 4) END AS test_hi FROM w)
      SELECT series, CAST(win AS BIGINT) AS "window", test_hi - 17 AS train_hi, test_hi - 12 AS test_lo, test_hi FROM e""",
    "robust_scaler_fold": f"""WITH {SAMPLES_SQL}, m AS (SELECT b.series, fold, close, least(train_hi - 1, t) - greatest(0, t - 59) + 1 AS k FROM b JOIN folds ON b.series = folds.series AND t < train_hi + 59),
      r AS (SELECT series, fold, close, unnest(generate_series(1, k)) AS i FROM m), q AS (SELECT series, fold, quantile_cont(close, 0.25) AS a, quantile_cont(close, 0.5) AS c, quantile_cont(close, 0.75) AS z FROM r GROUP BY 1, 2)
      SELECT series, CAST(fold AS BIGINT) AS fold, round(c, 3) AS center, round(CASE WHEN z = a THEN 1 ELSE z - a END, 3) AS scale FROM q""",
    "minmax_scaler_fold": f"""WITH {SAMPLES_SQL} SELECT b.series, CAST(fold AS BIGINT) AS fold, round(min(close), 2) AS data_min, round(max(close), 2) AS data_max FROM b JOIN folds ON b.series = folds.series AND t < train_hi + 59 GROUP BY 1, 2""",
    "latest_windows": f"""WITH {BARS_SQL}, l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY series ORDER BY session DESC) <= 60)
      SELECT series, max(session) AS session, count(*) AS n, round(arg_min(close, session), 2) AS first, round(arg_max(close, session), 2) AS last FROM l GROUP BY 1""",
    "series_report": f"""WITH {SCORED_SQL}, rp AS (SELECT model, series, horizon, {_REPORT} FROM sc GROUP BY GROUPING SETS ((model, series, horizon), (model, series)))
      SELECT a.model, a.series, CAST(a.horizon AS BIGINT) AS horizon, a.n, round(a.mae, 3) AS mae, round(a.rmse, 3) AS rmse, round(a.direction, 6) AS direction, round(a.mae / nullif(p.mae, 0), 8) AS relative_mae, round(a.rmse / nullif(p.rmse, 0), 8) AS relative_rmse
      FROM rp a JOIN rp p ON p.model = 'persistence' AND a.series = p.series AND a.horizon IS NOT DISTINCT FROM p.horizon""",
    "scaled_errors": f"""WITH {SCORED_SQL}, sl AS (SELECT b.series, fold, avg(abs(close - prev)) AS ad, avg((close - prev) * (close - prev)) AS sd FROM b JOIN folds ON b.series = folds.series AND t <= train_hi - 1 + 59 + 20 GROUP BY 1, 2),
      er AS (SELECT model, series, fold, avg(abs(actual - predicted)) AS mae, avg((actual - predicted) * (actual - predicted)) AS mse FROM sc GROUP BY 1, 2, 3)
      SELECT model, series, CAST(fold AS BIGINT) AS fold, round(mae / ad, 8) AS mase, round(sqrt(mse / sd), 8) AS rmsse FROM er JOIN sl USING (series, fold)""",
    "cross_fold_scores": f"""WITH {_FOLD_SQL}, u AS (SELECT model, series, unnest(['relative_mae', 'relative_rmse', 'direction']) AS metric, unnest([relative_mae, relative_rmse, direction]) AS x FROM fs)
      SELECT model, series, metric, count(x) AS n, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS sd FROM u GROUP BY 1, 2, 3""",
    "fold_summary": f"""WITH {_FOLD_SQL}, g AS (SELECT model, series, count(CASE WHEN relative_rmse < 1 THEN 1 END) AS wins, count(*) AS folds, quantile_cont(relative_mae, 0.5) AS m, quantile_cont(relative_rmse, 0.5) AS r, max(relative_rmse) AS w FROM fs GROUP BY 1, 2)
      SELECT model, series, wins, folds, m < 0.98 AND r < 0.98 AND w <= 1.25 AND wins >= greatest(1, folds - 1) AS promotable, round(m, 8) AS median_relative_mae, round(r, 8) AS median_relative_rmse, round(w, 8) AS worst_relative_rmse FROM g""",
    "direction_base_rate": f"""WITH {BARS_SQL}, c AS (SELECT series, close - prev AS c FROM b WHERE prev IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series ORDER BY session DESC) <= 252),
      p AS (SELECT series, count(*) AS n, (count(CASE WHEN c > 0 THEN 1 END) + 1) / (count(*) + 2) AS p FROM c GROUP BY 1) SELECT series, n, CASE WHEN p >= 0.5 THEN 'Up' ELSE 'Down' END AS label, round(p, 8) AS probability FROM p""",
    "train_mean_return": f"""WITH {SAMPLES_SQL}, l AS (SELECT series, s, unnest([1, 5, 20]) AS horizon, unnest([ln(y1 / origin), ln(y5 / origin), ln(y20 / origin)]) AS y FROM sm)
      SELECT l.series, CAST(fold AS BIGINT) AS fold, CAST(horizon AS BIGINT) AS horizon, count(*) AS n, round(avg(y), 8) AS mean_return FROM l JOIN folds ON l.series = folds.series AND s < train_hi GROUP BY 1, 2, 3""",
    "probability_report": f"""WITH {_PROB_SQL}, p AS (SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS said, greatest(least(probability, 1 - 1e-7), 1e-7) AS cp FROM pr)
      SELECT count(*) AS n, round(avg(CASE WHEN said = actual THEN 1.0 ELSE 0.0 END), 8) AS accuracy,
        round((coalesce(avg(CASE WHEN actual = 1 THEN CASE WHEN said = 1 THEN 1.0 ELSE 0.0 END END), 0) + coalesce(avg(CASE WHEN actual = 0 THEN CASE WHEN said = 0 THEN 1.0 ELSE 0.0 END END), 0)) / 2, 8) AS balanced_accuracy,
        round(CASE WHEN 2 * sum(training_target) > count(training_target) THEN avg(actual) ELSE 1 - avg(actual) END, 8) AS majority_accuracy, round(avg((probability - actual) * (probability - actual)), 8) AS brier,
        round(avg(-CASE WHEN actual = 1 THEN ln(cp) ELSE ln(1 - cp) END), 8) AS log_loss, round((SELECT sum(n * abs(mean_probability - observed)) / sum(n) FROM bins), 8) AS ece FROM p""",
    "reliability_bins": f"WITH {_PROB_SQL} SELECT bin, n, round(mean_probability, 8) AS mean_probability, round(observed, 8) AS observed FROM bins",
    "classification_by_source": f"""WITH {_PROB_SQL}, p AS (SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS said FROM pr),
      c AS (SELECT source, count(CASE WHEN actual = 1 AND said = 1 THEN 1 END)::DOUBLE AS tp, count(CASE WHEN actual = 0 AND said = 1 THEN 1 END)::DOUBLE AS fp, count(CASE WHEN actual = 1 AND said = 0 THEN 1 END)::DOUBLE AS fn,
        count(CASE WHEN actual = 0 AND said = 0 THEN 1 END)::DOUBLE AS tn, avg((probability - actual) * (probability - actual)) AS brier FROM p GROUP BY GROUPING SETS ((source), ())),
      d AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pc, coalesce(tp / nullif(tp + fn, 0), 0) AS rc, coalesce(tn / nullif(tn + fp, 0), 0) AS sp FROM c)
      SELECT source, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(pc, 8) AS "precision", round(rc, 8) AS recall, round(coalesce(2 * pc * rc / nullif(pc + rc, 0), 0), 8) AS f1,
        round((rc + sp) / 2, 8) AS balanced_accuracy, round(brier, 8) AS brier, round(greatest(tp + fn, fp + tn) / (tp + fp + fn + tn), 8) AS naive FROM d""",
    "pinball": f"""WITH {_QUANT_SQL} SELECT tau, count(*) AS n, round(avg(greatest(tau * (actual - predicted), (tau - 1) * (actual - predicted))), 3) AS pinball, round(avg(CASE WHEN actual <= predicted THEN 1.0 ELSE 0.0 END), 8) AS below FROM q GROUP BY 1""",
    "quantile_crossing": f"""WITH {_QUANT_SQL}, x AS (SELECT *, predicted < lag(predicted) OVER (PARTITION BY series, fold, s, horizon ORDER BY tau) AS x FROM q), c AS (SELECT series, fold, s, horizon, coalesce(bool_or(x), false) AS c FROM x GROUP BY 1, 2, 3, 4)
      SELECT count(*) AS n, round(avg(CASE WHEN c THEN 1.0 ELSE 0.0 END), 8) AS crossing_rate FROM c""",
    "conformal_intervals": f"""WITH {SCORED_SQL}, r AS (SELECT model, horizon, abs(actual - predicted) AS e, row_number() OVER (PARTITION BY model, horizon ORDER BY abs(actual - predicted)) AS k, count(*) OVER (PARTITION BY model, horizon) AS n FROM sc),
      q AS (SELECT model, horizon, e AS radius FROM r WHERE k = least(CAST(ceil((n + 1) * 0.9::DOUBLE) AS BIGINT), n))
      SELECT model, CAST(horizon AS BIGINT) AS horizon, count(*) AS n, round(any_value(radius), 3) AS radius, round(avg(CASE WHEN e <= radius THEN 1.0 ELSE 0.0 END), 8) AS coverage, round(avg(2 * radius), 3) AS width FROM r JOIN q USING (model, horizon) GROUP BY 1, 2""",
    "residual_diagnostics": f"""WITH {SCORED_SQL}, e AS (SELECT model, series, s, actual - predicted AS e, actual - predicted - avg(actual - predicted) OVER (PARTITION BY model, series) AS c FROM sc WHERE horizon = 1),
      l AS (SELECT *, e - lag(e) OVER w AS d, {", ".join(f"lag(c, {k}) OVER w AS l{k}" for k in range(1, 11))} FROM e WINDOW w AS (PARTITION BY model, series ORDER BY s)),
      g AS (SELECT model, series, count(*) AS n, avg(e) AS mean, stddev_pop(e) AS sd, sum(d * d) / sum(e * e) AS dw, sum(c * c) AS cc, avg(pow(c, 3)) AS m3, avg(pow(c, 4)) AS m4, {_DIAG_LAGS} FROM l GROUP BY 1, 2),
      h AS (SELECT *, n * (n + 2) * ({_DIAG_Q}) AS q FROM g), p AS (SELECT *, exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24) AS pv FROM h)
      SELECT model, series, n, pv < 0.05 AS autocorrelated, round(mean, 3) AS mean, round(sd, 3) AS sd, round(dw, 6) AS durbin_watson, round(m3 / pow(sd, 3), 6) AS skew, round(m4 / pow(sd, 4) - 3, 6) AS excess_kurtosis,
        round(q, 5) AS ljung_box, round(pv, 6) AS ljung_box_p FROM p""",
    "residual_rows": f"""WITH {SCORED_SQL} SELECT model, series, CAST(fold AS BIGINT) AS fold, s, round(actual - predicted, 3) AS residual, round(abs(actual - predicted), 3) AS absolute, round(100 * (actual - predicted) / actual, 6) AS percent FROM sc WHERE horizon = 1""",
    "volatility_stats": f"""WITH {BARS_SQL}, r AS (SELECT series, ln(close / prev) AS r, abs(ln(close / lag(close, 5) OVER (PARTITION BY series ORDER BY session))) AS h, row_number() OVER (PARTITION BY series ORDER BY session DESC) AS k FROM b),
      g AS (SELECT series, stddev_samp(CASE WHEN k <= 60 THEN r END) AS d, quantile_cont(h, 0.995) AS x FROM r GROUP BY 1) SELECT series, round(d, 8) AS daily, round(d * sqrt(252), 8) AS annual, round(d * sqrt(5), 8) AS per_horizon, round(x, 8) AS extreme FROM g""",
    "shrinkage_alpha": f"""WITH {SCORED_SQL}, g AS (SELECT model, horizon, k / 20.0::DOUBLE AS alpha, round(avg(abs(actual - (origin + k / 20.0::DOUBLE * (predicted - origin)))), 6) AS mae FROM sc, (SELECT unnest(generate_series(0, 20)) AS k) WHERE model = 'drift' GROUP BY 1, 2, 3)
      SELECT model, CAST(horizon AS BIGINT) AS horizon, round(alpha, 2) AS alpha, round(mae, 3) AS mae FROM g QUALIFY row_number() OVER (PARTITION BY model, horizon ORDER BY mae, alpha) = 1""",
    "ridge_fit": f"""WITH {BARS_SQL}, r AS (SELECT series, ln(close / prev) AS x, ln(lead(close) OVER (PARTITION BY series ORDER BY session) / close) AS y FROM b),
      g AS (SELECT series, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v FROM r WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)
      SELECT series, n, round(n * c / (n * v + 10), 8) AS slope, round(my - n * c / (n * v + 10) * mx, 8) AS intercept FROM g""",
    "seed_summary": f"""WITH {_FOLD_SQL}, v AS (SELECT model, unnest(['relative_mae', 'relative_rmse']) AS metric, unnest(CASE WHEN relative_mae + relative_rmse IS NULL THEN [NULL, NULL] ELSE [relative_mae, relative_rmse] END) AS x FROM fs)
      SELECT model, metric, count(*) - count(x) AS failures, round(avg(x), 8) AS mean, round(quantile_cont(x, 0.5), 8) AS median, round(stddev_pop(x), 8) AS sd, round(min(x), 8) AS best, round(max(x), 8) AS worst FROM v GROUP BY 1, 2""",
}
