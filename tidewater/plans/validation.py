"""Queries on walk-forward validation with folds that scale by their own extremes, and on strict readers of bars and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, features
from ..operators import validation as V
from ..sources.shared import written
from ..sources.tables import BARS_SQL, bars, table
from .features import rounded
from .forecasts import _DIAG_LAGS, _DIAG_Q

#: Features of the ridge that SQL can follow.
PAIR = ("close", "volume")
#: The least sizes that the rules allow, so that short series have folds too.
SETUP = V.Validation(lookback=60, horizon=5, folds=5, min_train=100, size=30)
_DIGITS = {k: 3 if k in ("rmse", "mae") else 6 for k in V.PRICE_SCORES}


def _price_folds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The fold table, and one row per model, series and fold from forecasts computed once."""
    source = written(bars(spark, sf), "bars")
    folds = V.fold_plan(source.groupBy("series").agg(F.count(F.lit(1)).alias("n")), SETUP)
    scored = written(V.price_forecasts(source, V.targets(source, PAIR, SETUP), folds, PAIR, SETUP), "scored")
    return folds, V.price_folds(scored, V.training_moves(source, folds))


def minmax_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Each fold's rows, numbers of targets and scores over all horizons, with the last horizon's own."""
    folds, found = _price_folds(spark, sf)
    rows = found.join(folds, ["series", "fold"]).withColumn("last_relative_rmse", F.element_at("horizons", -1)["relative_rmse"])
    return rounded(rows, ("model", "series", "fold", "train_hi", "val_lo", "val_hi", "train_targets", "val_targets", "n"), _DIGITS | {"last_relative_rmse": 6})


def minmax_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """The residual tables of all folds as rows."""
    _, found = _price_folds(spark, sf)
    return found.select("model", "series", "fold", F.explode("residuals").alias("_r")).select("model", "series", "fold", "_r.*")


def minmax_summary(spark: SparkSession, sf: str) -> DataFrame:
    _, found = _price_folds(spark, sf)
    return rounded(V.summary(found, ("model", "series"), V.PRICE_SCORES), ("model", "series", "metric", "n", "folds_completed"), {"mean": 3, "sd": 3})


def minmax_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Diagnostics of the residuals of all folds together."""
    _, found = _price_folds(spark, sf)
    return rounded(V.pooled_diagnostics(found, ("model", "series")), ("model", "series", "n", "autocorrelated"), {"mean": 2, "sd": 2, "durbin_watson": 5, "skew": 5, "excess_kurtosis": 5, "ljung_box": 4, "ljung_box_p": 5})


def _direction_folds(spark: SparkSession, sf: str) -> DataFrame:
    scored, _ = V.direction_forecasts(bars(spark, sf), SETUP)
    return V.direction_folds(written(scored, "directions"))


def direction_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of each fold's directions, with how many first days were called wrongly."""
    wrong = F.aggregate("residuals", F.lit(0), lambda a, r: a + r["absolute_error"]).cast("long").alias("wrong")
    found = _direction_folds(spark, sf).select("*", F.size("residuals").cast("long").alias("days"), wrong)
    return rounded(found, ("series", "fold", "tp", "fp", "fn", "tn", "n", "days", "wrong"), dict.fromkeys(V.DIRECTION_SCORES, 8))


def direction_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.summary(_direction_folds(spark, sf), ("series",), V.DIRECTION_SCORES), ("series", "metric", "n", "folds_completed"), {"mean": 6, "sd": 6})


def strict_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as bars in the order of their keys: many a day, out of order, volumes with gaps and below 0."""
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("series"), F.to_date("o_orderdate").alias("session"), key.alias("at"), price.alias("open"), price.alias("high"), (price - 2000).alias("low"), price.alias("close"),
        F.when(key % 53 != 0, key % 41 - 1).alias("volume"))
    return clean.strict_violations(raw, "at")


def feature_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Returns and volume changes with some sessions twice and one feature absent, against what models ask for."""
    rows = features.price_returns(bars(spark, sf)).select("series", "session", "return_1d", "volume_change")
    again = rows.where("dayofmonth(session) = 1")
    return clean.contract_problems(rows.union(again), ("volume_change", "return_1d", "beta_20"))


QUERIES = {f.__name__: f for f in (minmax_folds, minmax_residuals, minmax_summary, minmax_diagnostics, direction_folds, direction_summary, strict_bars, feature_contract)}


def _plan_sql(rows: str) -> str:
    """CTE vf: folds of five times 30 rows after at least 100, of the numbers of rows in ``rows``."""
    return f"""cnt AS (SELECT series, count(*) AS n FROM {rows} GROUP BY 1),
vf0 AS (SELECT series, n, unnest(generate_series(1, 5)) AS fold FROM cnt WHERE n >= 100 + 5 * 30),
vf AS (SELECT series, fold, n - 150 + (fold - 1) * 30 AS train_hi, n - 150 + (fold - 1) * 30 AS val_lo, n - 150 + fold * 30 AS val_hi, n - 150 + (fold - 1) * 30 - 64 AS train_targets, 26 AS val_targets FROM vf0
  WHERE n - 150 + (fold - 1) * 30 - 64 > 0)"""


_LEADS = ", ".join(f"lead(close, {k}) OVER w AS y{k}" for k in range(1, 6))
_YS = ", ".join(f"y{k}" for k in range(1, 6))

_PRICE_SQL = f"""{BARS_SQL}, {_plan_sql("b")},
tg0 AS (SELECT series, session, t, t - 59 AS s, close AS origin, lag(close, 59) OVER w AS fc, close AS x1, volume AS x2, {_LEADS} FROM b WINDOW w AS (PARTITION BY series ORDER BY session) QUALIFY t >= 59 AND y5 IS NOT NULL),
tg AS (SELECT * EXCLUDE ({_YS}), unnest([1, 2, 3, 4, 5]) AS horizon, unnest([{_YS}]) AS actual FROM tg0),
ex AS (SELECT b.series, fold, CASE WHEN max(close) = min(close) THEN 1 ELSE max(close) - min(close) END AS k1, CASE WHEN max(volume) = min(volume) THEN 1 ELSE max(volume) - min(volume) END AS k2,
  avg(abs(close - prev)) AS ad, avg((close - prev) * (close - prev)) AS sd FROM b JOIN vf ON b.series = vf.series AND t < train_hi GROUP BY 1, 2),
g0 AS (SELECT tg.series, fold, horizon, avg(x1) AS m1, avg(x2) AS m2, avg(actual) AS my, count(*) * var_pop(x1) AS v1, count(*) * var_pop(x2) AS v2, count(*) * covar_pop(x1, x2) AS v12,
  count(*) * covar_pop(x1, actual) AS r1, count(*) * covar_pop(x2, actual) AS r2 FROM tg JOIN vf ON tg.series = vf.series AND s < train_targets GROUP BY 1, 2, 3),
g1 AS (SELECT series, fold, horizon, m1, m2, my, k1, k2, v1 / k1 / k1 + 1 AS a, v2 / k2 / k2 + 1 AS d, v12 / k1 / k2 AS b, r1 / k1 AS p, r2 / k2 AS q FROM g0 JOIN ex USING (series, fold)),
g2 AS (SELECT *, (d * p - b * q) / (a * d - b * b) / k1 AS c1, (a * q - b * p) / (a * d - b * b) / k2 AS c2 FROM g1),
vs AS (SELECT tg.*, vf.fold, my + c1 * (x1 - m1) + c2 * (x2 - m2) AS ridge FROM tg JOIN vf ON tg.series = vf.series AND s >= val_lo - 60 AND s < val_lo - 60 + val_targets
  JOIN g2 ON g2.series = tg.series AND g2.fold = vf.fold AND g2.horizon = tg.horizon),
sc AS (SELECT series, fold, horizon, s, t, session, origin, actual, unnest(['persistence', 'drift', 'ridge']) AS model, unnest([origin, origin + horizon * (origin - fc) / 59, ridge]) AS predicted FROM vs),
m0 AS (SELECT model, series, fold, horizon, count(*) AS n, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, 100 * avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) AS mape,
  1 - avg((actual - predicted) * (actual - predicted)) / nullif(var_pop(actual), 0) AS r2, avg(abs(actual - origin)) AS bm, sqrt(avg((actual - origin) * (actual - origin))) AS br,
  avg(CASE WHEN actual <> origin AND predicted <> origin THEN CASE WHEN sign(actual - origin) = sign(predicted - origin) THEN 1.0 ELSE 0.0 END END) AS direction
  FROM sc GROUP BY GROUPING SETS ((model, series, fold, horizon), (model, series, fold))),
m AS (SELECT m0.*, mae / nullif(ad, 0) AS mase, rmse / sqrt(nullif(sd, 0)) AS rmsse, mae / nullif(bm, 0) AS relative_mae, rmse / nullif(br, 0) AS relative_rmse FROM m0 JOIN ex USING (series, fold)),
rr AS (SELECT model, series, fold, session, t, round(actual, 4) AS actual, round(predicted, 4) AS predicted, round(round(actual, 4) - round(predicted, 4), 4) AS residual FROM sc WHERE horizon = 1)"""

_UPS = ", ".join(f"lead(up, {k}) OVER w AS y{k}" for k in range(1, 6))

_DIRECTION_SQL = f"""{BARS_SQL}, dm AS (SELECT series, session, t - 1 AS t, CASE WHEN close > prev THEN 1 ELSE 0 END AS up FROM b WHERE t > 0), {_plan_sql("dm")},
tg0 AS (SELECT series, t - 59 AS s, {_UPS} FROM dm WINDOW w AS (PARTITION BY series ORDER BY session) QUALIFY t >= 59 AND y5 IS NOT NULL),
tg AS (SELECT series, s, unnest([1, 2, 3, 4, 5]) AS horizon, unnest([{_YS}]) AS y FROM tg0),
tr AS (SELECT tg.series, fold, horizon, sum(y) AS ups, count(*) AS n FROM tg JOIN vf ON tg.series = vf.series AND s < train_targets GROUP BY 1, 2, 3),
mj AS (SELECT series, fold, CASE WHEN 2 * sum(ups) > sum(n) THEN 1 ELSE 0 END AS majority FROM tr GROUP BY 1, 2),
sc AS (SELECT tg.series, vf.fold, tg.horizon, y, (ups + 1) / (tr.n + 2)::DOUBLE AS p, majority FROM tg JOIN vf ON tg.series = vf.series AND s >= val_lo - 60 AND s < val_lo - 60 + val_targets
  JOIN tr ON tr.series = tg.series AND tr.fold = vf.fold AND tr.horizon = tg.horizon JOIN mj ON mj.series = tg.series AND mj.fold = vf.fold),
c AS (SELECT series, fold, count(*) AS n, count_if(y = 1 AND p >= 0.5)::DOUBLE AS tp, count_if(y = 0 AND p >= 0.5)::DOUBLE AS fp, count_if(y = 1 AND p < 0.5)::DOUBLE AS fn, count_if(y = 0 AND p < 0.5)::DOUBLE AS tn,
  avg((p - y) * (p - y)) AS brier, avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss, avg(CASE WHEN y = majority THEN 1.0 ELSE 0.0 END) AS naive,
  count_if(horizon = 1) AS days, count_if(horizon = 1 AND y <> CASE WHEN p > 0.5 THEN 1 ELSE 0 END) AS wrong FROM sc GROUP BY 1, 2),
d AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pc, coalesce(tp / nullif(tp + fn, 0), 0) AS rc, coalesce(tn / nullif(tn + fp, 0), 0) AS sp FROM c),
m AS (SELECT *, (tp + tn) / n AS accuracy, pc AS "precision", rc AS recall, coalesce(2 * pc * rc / nullif(pc + rc, 0), 0) AS f1, (rc + sp) / 2 AS balanced_accuracy FROM d)"""


def _summary_sql(keys: str, names: tuple[str, ...], digits: int, where: str = "TRUE") -> str:
    quoted = ", ".join(f"'{n}'" for n in names)
    values = ", ".join(f'CAST("{n}" AS DOUBLE)' for n in names)
    return f"""l AS (SELECT {keys}, unnest([{quoted}]) AS metric, unnest([{values}]) AS x FROM m WHERE {where})
  SELECT {keys}, metric, count(x) AS n, count(*) AS folds_completed, round(avg(x), {digits}) AS mean, round(stddev_pop(x), {digits}) AS sd FROM l GROUP BY ALL"""


SQL = {
    "minmax_folds": f"""WITH {_PRICE_SQL} SELECT p.model, p.series, p.fold, train_hi, val_lo, val_hi, train_targets, val_targets, p.n, {", ".join(f'round(p."{k}", {n}) AS "{k}"' for k, n in _DIGITS.items())}, round(q.relative_rmse, 6) AS last_relative_rmse
      FROM m p JOIN m q ON p.model = q.model AND p.series = q.series AND p.fold = q.fold AND p.horizon IS NULL AND q.horizon = 5 JOIN vf ON vf.series = p.series AND vf.fold = p.fold""",
    "minmax_residuals": f"""WITH {_PRICE_SQL} SELECT model, series, fold, session, t, actual, predicted, residual, abs(residual) AS absolute_error,
      round(100 * abs(residual / nullif(actual, 0)), 4) AS percentage_error FROM rr""",
    "minmax_summary": f"WITH {_PRICE_SQL}, {_summary_sql('model, series', V.PRICE_SCORES, 3, 'horizon IS NULL')}",
    "minmax_diagnostics": f"""WITH {_PRICE_SQL}, e AS (SELECT model, series, t, residual AS e, residual - avg(residual) OVER (PARTITION BY model, series) AS c FROM rr),
      l AS (SELECT *, e - lag(e) OVER w AS d, {", ".join(f"lag(c, {k}) OVER w AS l{k}" for k in range(1, 11))} FROM e WINDOW w AS (PARTITION BY model, series ORDER BY t)),
      g AS (SELECT model, series, count(*) AS n, avg(e) AS mean, stddev_pop(e) AS sd, sum(d * d) / sum(e * e) AS dw, sum(c * c) AS cc, avg(pow(c, 3)) AS m3, avg(pow(c, 4)) AS m4, {_DIAG_LAGS} FROM l GROUP BY 1, 2),
      h AS (SELECT *, n * (n + 2) * ({_DIAG_Q}) AS q FROM g), p AS (SELECT *, exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24) AS pv FROM h)
      SELECT model, series, n, pv < 0.05 AS autocorrelated, round(mean, 2) AS mean, round(sd, 2) AS sd, round(dw, 5) AS durbin_watson, round(m3 / pow(sd, 3), 5) AS skew, round(m4 / pow(sd, 4) - 3, 5) AS excess_kurtosis,
        round(q, 4) AS ljung_box, round(pv, 5) AS ljung_box_p FROM p""",
    "direction_folds": f"""WITH {_DIRECTION_SQL} SELECT series, fold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, n, days, wrong,
      {", ".join(f'round("{k}", 8) AS "{k}"' for k in V.DIRECTION_SCORES)} FROM m""",
    "direction_summary": f"WITH {_DIRECTION_SQL}, {_summary_sql('series', V.DIRECTION_SCORES, 6)}",
    "strict_bars": """WITH r AS (SELECT o_orderstatus AS series, CAST(o_orderdate AS DATE) AS session, o_orderkey AS k, o_totalprice AS p, CASE WHEN o_orderkey % 53 <> 0 THEN o_orderkey % 41 - 1 END AS volume FROM orders),
      b AS (SELECT *, lag(session) OVER (PARTITION BY series ORDER BY k) AS earlier FROM r),
      c AS (SELECT series, session, count(*) AS n, count_if(p IS NULL OR NOT isfinite(p) OR p <= 0 OR p - 2000 <= 0) AS price, count_if(volume IS NULL OR volume < 0) AS volume, count_if(session < earlier) AS back FROM b GROUP BY 1, 2)
      SELECT series, session, 'duplicate_session' AS violation, n AS rows_found FROM c WHERE n > 1 UNION ALL SELECT series, session, 'bad_price', price FROM c WHERE price > 0
      UNION ALL SELECT series, session, 'bad_volume', volume FROM c WHERE volume > 0 UNION ALL SELECT series, session, 'disorder', back FROM c WHERE back > 0""",
    "feature_contract": f"""WITH {BARS_SQL}, f AS (SELECT series, session, ln(close / prev) AS r, ln(1 + volume) - ln(1 + lag(volume) OVER (PARTITION BY series ORDER BY session)) AS v FROM b),
      u AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE day(session) = 1)
      SELECT 'missing_column' AS problem, 'beta_20' AS feature, CAST(NULL AS BIGINT) AS rows_found UNION ALL SELECT 'column_order', NULL, NULL
      UNION ALL SELECT 'duplicate_key', NULL, n FROM (SELECT count(*) AS n FROM (SELECT 1 FROM u GROUP BY series, session HAVING count(*) > 1)) WHERE n > 0
      UNION ALL SELECT 'missing', 'return_1d', n FROM (SELECT count(*) - count(r) AS n FROM u) WHERE n > 0 UNION ALL SELECT 'missing', 'volume_change', n FROM (SELECT count(*) - count(v) AS n FROM u) WHERE n > 0""",
}
