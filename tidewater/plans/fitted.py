"""Queries on candidates fitted per fold: weights, walk-forward evidence, blends, research folds, locked holdouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import clean, features, gates, metrics
from ..operators import linear as L
from ..operators import samples as S
from ..sources.shared import new_path, written
from ..sources.tables import BENCHMARKS, bars, benchmarks
from .evidence import _FOLD_WHY, BLOCK, RESAMPLES, _boot, fold_gate_rows, gate_sql, hac_sql, psi_sql
from .features import rounded
from .forecasts import SAMPLES_SQL, SCORED_SQL, STUDY, scored

#: Features of the candidates that SQL can follow.
PAIR = ("return_1d", "volume_change")
#: Features whose spread over windows is compared.
PRICES = ("return_1d", "log_open")
#: Studies outside walk-forward look at one horizon; features end a row before the origin.
RESEARCH = S.Study(lookback=60, horizons=(5,))
RESEARCH_RIDGE = L.Penalty("ridge", 10.0)


def _pair_rows(spark: SparkSession, sf: str) -> DataFrame:
    return L.sample_rows(features.price_returns(bars(spark, sf)), PAIR, STUDY, first=STUDY.lookback - 1)


def _pair_models(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folds of the study and the ridge on two features, fitted on each."""
    folds = L.fold_plan(rows, STUDY)
    return folds, L.fitted(rows, L.sample_scalers(rows, folds, len(PAIR)), STUDY.horizons, (L.RIDGE,))


def fitted_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of persistence, drift and the ridge on all folds, computed once."""
    rows = written(_pair_rows(spark, sf), "samples")
    folds, models = _pair_models(rows)
    own = L.fitted_forecasts(rows, folds, models, STUDY.horizons).where("model <> 'persistence'")
    return written(scored(spark, sf).unionByName(own), "scored")


def fitted_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the ridge per series, fold and horizon, for features as they are."""
    _, models = _pair_models(_pair_rows(spark, sf))
    found = models.withColumns({"weight_1": F.col("weights")[0], "weight_2": F.col("weights")[1]})
    return rounded(found, ("series", "fold", "horizon", "n"), dict.fromkeys(("intercept", "weight_1", "weight_2"), 8))


def fitted_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Ridge, elastic net and the grid of elastic nets on all 28 columns and all folds: pooled errors over persistence's per series."""
    built = written(features.stationary_features(bars(spark, sf), benchmarks(spark, sf), BENCHMARKS), "features")
    rows = L.sample_rows(built, features.STATIONARY, STUDY)
    folds = L.fold_plan(rows, STUDY)
    models = written(L.fitted(rows, L.robust_scalers(built, folds, features.STATIONARY), STUDY.horizons, (L.RIDGE, L.ELASTIC_NET, *L.GRID)), "models")
    found = metrics.relative(metrics.report(L.fitted_forecasts(rows, folds, models, STUDY.horizons), ("model", "series")), keys=("series", "horizon"))
    return rounded(found.where("horizon is null"), ("model", "series", "n"), {"relative_mae": 6, "relative_rmse": 6})


def walk_forward_experiment(spark: SparkSession, sf: str) -> DataFrame:
    """Drift and a fitted ridge over all folds with evidence, discoveries and gate, a row per model and series; all from rows written once."""
    rows = fitted_scored(spark, sf)
    gate = gates.fold_gate(fold_gate_rows(rows, bars(spark, sf), STUDY)).select("model", "series", "relative_mae", "relative_rmse", "wins", "passed", "reasons")
    losses = written(E.model_losses(rows), "losses").withColumn("improvement", F.col("baseline") - F.col("candidate"))
    keys = ("model", "series")
    tests = E.false_discoveries(E.hac(losses, keys, "s", "improvement"), "p_value", (), 0.10)
    ratio = E.bootstrap_ratio(losses, keys, "s", "candidate", "baseline", RESAMPLES, F.lit(BLOCK)).select(*keys, "low", "high")
    out = gate.join(tests, list(keys)).join(ratio, list(keys))
    return rounded(out, ("model", "series", "n", "wins", "passed", "reasons", "discovery"), {"relative_mae": 6, "relative_rmse": 6, "p_value": 6, "low": 6, "high": 6})


def fitted_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of drift and ridge from all folds but the last, and what their blend does on the last one."""
    rows, members = fitted_scored(spark, sf), ("drift", "ridge")
    weights = written(L.blend_weights(rows, members), "weights")
    judged = L.blended(rows, members, weights).groupBy("series").agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.avg(F.abs(F.col("actual") - F.col("predicted"))), F.avg(F.abs(F.col("actual") - F.col("origin")))).alias("relative_mae"),
        F.sqrt(F.try_divide(F.avg(F.pow(F.col("actual") - F.col("predicted"), F.lit(2.0))), F.avg(F.pow(F.col("actual") - F.col("origin"), F.lit(2.0))))).alias("relative_rmse"),
    )
    out = judged.join(weights, "series").withColumns({"drift": F.col("weights")[0], "ridge": F.col("weights")[1]})
    return rounded(out, ("series", "n"), {"drift": 6, "ridge": 6, "relative_mae": 6, "relative_rmse": 6})


def shrunk_models(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each model's log return that would have served best on all folds but the last."""
    return rounded(L.shrunk(fitted_scored(spark, sf).where("model <> 'persistence'")), ("model", "series", "horizon"), {"alpha": 2, "mae": 8})


def window_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Features over the training windows of each series' first fold against those over the validation windows of all folds."""
    raw = bars(spark, sf)
    rows = S.numbered(features.price_returns(raw)).dropna(subset=list(PRICES)).withColumn("always", F.lit(1.0))
    folds = S.tail_folds(_sample_counts(S.samples(raw, STUDY)), STUDY)
    ends = folds.groupBy("series").agg(F.min("train_hi").alias("train_hi"), F.min("val_lo").alias("lo"), F.max("val_hi").alias("hi"))
    t, last = F.col("t"), STUDY.lookback - 1
    validated = F.least(F.col("hi") - 1, t) - F.greatest(F.col("lo"), t - last) + 1
    both = F.explode(F.array(F.struct(F.lit(True).alias("ref"), S.multiplicity(t, F.col("train_hi"), STUDY.lookback).alias("times")), F.struct(F.lit(False).alias("ref"), validated.alias("times"))))
    counted = rows.join(ends, "series").withColumn("_c", both).select("series", *PRICES, "always", "_c.ref", "_c.times").where("times > 0")
    return rounded(E.divergence(counted, (*PRICES, "always"), F.col("ref"), ("series",), F.col("times")), ("series", "degenerate"), {"max_psi": 6, "mean_psi": 6})


def _research_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = features.price_returns(bars(spark, sf))
    return written(L.sample_rows(df, PAIR, RESEARCH, first=RESEARCH.lookback, before=True), "examples")


def _research_losses(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """series, fold, s and absolute and squared errors of the ridge and of no change, on log returns. plan: series, fold, train_hi, val_lo, val_hi."""
    models = L.fitted(rows, L.sample_scalers(rows, plan, len(PAIR)), RESEARCH.horizons, (RESEARCH_RIDGE,)).select("series", "fold", "intercept", "weights", F.col("n").alias("train_n"))
    inside = rows.join(plan.select("series", "fold", "val_lo", "val_hi"), "series").where("s >= val_lo and s < val_hi").join(models, ["series", "fold"])
    y, p = F.col("y")[0], L.linear_value(F.col("x"), F.col("weights"), F.col("intercept"))
    e = y - p
    return inside.select("series", "fold", "s", "train_n", F.abs(e).alias("candidate"), F.abs(y).alias("baseline"), (e * e).alias("candidate_2"), (y * y).alias("baseline_2"))


def _errors() -> list[Column]:
    return [F.try_divide(F.avg("candidate"), F.avg("baseline")).alias("relative_mae"), F.sqrt(F.try_divide(F.avg("candidate_2"), F.avg("baseline_2"))).alias("relative_rmse")]


def _sample_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"))


def research_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """A fitted ridge on expanding folds with a purge, and whether its folds would promote it."""
    rows = _research_rows(spark, sf)
    plan = S.front_folds(_sample_counts(rows), 60, RESEARCH.gap - 1, 40, 5)
    by = _research_losses(rows, plan).groupBy("series", "fold").agg(*_errors())
    return rounded(metrics.fold_summary(by, ("series",)), ("series", "folds", "wins", "promotable"), dict.fromkeys(("median_relative_mae", "median_relative_rmse", "worst_relative_rmse"), 6))


def _with_bounds(losses: DataFrame) -> DataFrame:
    """Pooled relative errors per series with upper bounds mapped from intervals of the loss differences."""
    rows = losses.withColumns({"d": F.col("candidate") - F.col("baseline"), "d_2": F.col("candidate_2") - F.col("baseline_2")})
    means = E.resampled_means(rows, ("series",), "s", ("d", "d_2"), RESAMPLES, F.lit(RESEARCH.gap))
    high = means.groupBy("series").agg(*(F.percentile(c, F.lit(0.975)).alias(f"_{c}") for c in ("d", "d_2")))
    pooled = rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), *_errors(), F.avg("baseline").alias("_b"), F.avg("baseline_2").alias("_b_2"))
    bounds = {"mae_high": E.relative_bounds(F.col("_d"), F.col("_b")), "rmse_high": E.relative_bounds(F.col("_d_2"), F.col("_b_2"), squared=True)}
    return pooled.join(high, "series").withColumns(bounds)


def holdout_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The last 60 origins of each series, locked: a ridge fitted on all before them but a purge."""
    rows = _research_rows(spark, sf)
    plan = S.single_holdout(_sample_counts(rows), 60, RESEARCH.gap).select("series", F.lit(0).cast("long").alias("fold"), "train_hi", F.col("test_lo").alias("val_lo"), F.col("test_hi").alias("val_hi"))
    losses = written(_research_losses(rows, plan), "losses")
    trained = losses.groupBy("series").agg(F.max("train_n").alias("train_n"))
    found = _with_bounds(losses).withColumn("verdict", gates.holdout_verdict(*map(F.col, ("relative_mae", "relative_rmse", "mae_high", "rmse_high"))))
    return rounded(found.join(trained, "series"), ("series", "n", "train_n", "verdict"), dict.fromkeys(("relative_mae", "relative_rmse", "mae_high", "rmse_high"), 6))


def _window_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Four contiguous blocks of origins, the last 60 of each tested by a ridge fitted on all before them but a purge; intervals are pooled."""
    rows = _research_rows(spark, sf)
    # Blocks are laid out in rows of the series, samples are numbered from the first origin.
    at = F.lit(RESEARCH.lookback)
    blocks = S.holdout_windows(_sample_counts(rows).withColumn("n", F.col("n") + at), 4, 60, 80, RESEARCH.lookback, RESEARCH.gap)
    plan = blocks.select("series", F.col("window").alias("fold"), (F.col("train_hi") - at).alias("train_hi"), (F.col("test_lo") - at).alias("val_lo"), (F.col("test_hi") - at).alias("val_hi")).where("train_hi >= 1")
    return written(_research_losses(rows, plan), "losses")


def multi_window_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each series' ridge survives the majority of its windows and the pooled intervals."""
    losses = _window_losses(spark, sf)
    by = losses.groupBy("series", "fold").agg(*_errors())
    pooled = _with_bounds(losses).select("series", "mae_high", "rmse_high")
    return rounded(gates.windows_verdict(by.join(pooled, "series"), ("series",)), ("series", "windows", "passing", "verdict"), {"mae_high": 6, "rmse_high": 6})


def holdout_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The records that the multi-window holdouts put into a ledger, as read back from it."""
    losses = _window_losses(spark, sf)
    by = losses.groupBy("series", "fold").agg(*_errors())
    bounds = _with_bounds(losses).select("series", "relative_mae", "relative_rmse", "mae_high", "rmse_high")
    judged = gates.windows_verdict(by.join(bounds.select("series", "mae_high", "rmse_high"), "series"), ("series",)).join(bounds.select("series", "relative_mae", "relative_rmse"), "series")
    snapshots = clean.fingerprint(bars(spark, sf), clean.BAR).select("series", F.concat(F.lit("sha256:"), "content_hash").alias("snapshot_id"))
    path = new_path(spark, "ledger")
    gates.holdout_records(judged, by, "series", "ridge", RESEARCH.horizons[0], snapshots).write.json(path)
    found = spark.read.schema("series string, median_relative_mae double, median_relative_rmse double, worst_fold_relative_rmse double, folds_beating_persistence string, decision string, snapshot_id string, per_window array<struct<passes_gate:boolean>>").json(path)
    out = found.withColumns({"has_snapshot": F.col("snapshot_id").startswith("sha256:"), "shown": F.size("per_window").cast("long"), "shown_passing": F.size(F.filter("per_window", lambda w: w["passes_gate"])).cast("long")})
    return rounded(out, ("series", "folds_beating_persistence", "decision", "has_snapshot", "shown", "shown_passing"), dict.fromkeys(("median_relative_mae", "median_relative_rmse", "worst_fold_relative_rmse"), 6))


QUERIES = {f.__name__: f for f in (
    fitted_ridge, fitted_candidates, walk_forward_experiment, fitted_blend, shrunk_models, window_divergence, research_evaluation, holdout_verdicts, multi_window_verdict, holdout_evidence,
)}

_FEATURES_SQL = """fx AS (SELECT series, t, ln(close / prev) AS x1, ln(1 + volume) - ln(1 + lag(volume) OVER (PARTITION BY series ORDER BY session)) AS x2 FROM b)"""


def _ridge_sql(rows: str, folds: str, alpha: float) -> str:
    """CTE rw (series, fold, horizon, n, c0, c1, c2) from rows (series, s, horizon, x1, x2, y) and folds (series, fold, train_hi)."""
    k = "CASE WHEN quantile_cont({0}, 0.75) = quantile_cont({0}, 0.25) THEN 1 ELSE quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25) END"
    return f"""rs0 AS (SELECT r.series, fold, horizon, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, {k.format("x1")} AS k1, {k.format("x2")} AS k2, count(*) * var_pop(x1) AS v1, count(*) * var_pop(x2) AS v2,
  count(*) * covar_pop(x1, x2) AS v12, count(*) * covar_pop(x1, y) AS r1, count(*) * covar_pop(x2, y) AS r2 FROM {rows} r JOIN {folds} f ON r.series = f.series AND s < train_hi GROUP BY 1, 2, 3),
rs1 AS (SELECT *, v1 / k1 / k1 + {alpha} AS a, v2 / k2 / k2 + {alpha} AS d, v12 / k1 / k2 AS b, r1 / k1 AS p, r2 / k2 AS q FROM rs0),
rs2 AS (SELECT *, (d * p - b * q) / (a * d - b * b) / k1 AS c1, (a * q - b * p) / (a * d - b * b) / k2 AS c2 FROM rs1),
rw AS (SELECT series, fold, horizon, n, my - c1 * m1 - c2 * m2 AS c0, c1, c2 FROM rs2)"""


_PAIR_SQL = f"""{SAMPLES_SQL}, {_FEATURES_SQL},
fr AS (SELECT sm.series, s, x1, x2, unnest([1, 5, 20]) AS horizon, unnest([ln(y1 / origin), ln(y5 / origin), ln(y20 / origin)]) AS y FROM sm JOIN fx ON sm.series = fx.series AND sm.t = fx.t),
{_ridge_sql("fr", "folds", 1.0)}"""

#: The scored rows with those of the ridge.
_FITTED_SQL = f"""{SCORED_SQL.replace("sc AS (", "sc_ AS (")}, {_PAIR_SQL.removeprefix(SAMPLES_SQL + ", ")},
sc AS (SELECT * FROM sc_ UNION ALL SELECT 'ridge', lg.*, origin * exp(c0 + c1 * x1 + c2 * x2) FROM lg JOIN fx ON lg.series = fx.series AND lg.t = fx.t JOIN rw ON rw.series = lg.series AND rw.fold = lg.fold AND rw.horizon = lg.horizon)"""

_MODEL_LOSS_SQL = """ml AS (SELECT model, series, s, avg(abs(actual - predicted)) AS e FROM sc GROUP BY 1, 2, 3),
li AS (SELECT a.model, a.series, a.s, a.e AS candidate, p.e AS baseline, p.e - a.e AS improvement, row_number() OVER (PARTITION BY a.model, a.series ORDER BY a.s) AS i FROM ml a JOIN ml p ON p.model = 'persistence' AND a.model <> 'persistence' AND a.series = p.series AND a.s = p.s)"""

_RESEARCH_SQL = f"""{SAMPLES_SQL.split("sm AS")[0]}{_FEATURES_SQL},
ex AS (SELECT b.series, b.t - 60 AS s, 5 AS horizon, x1, x2, ln(lead(close, 5) OVER (PARTITION BY b.series ORDER BY session) / close) AS y FROM b JOIN fx ON b.series = fx.series AND fx.t = b.t - 1),
fr AS (SELECT * FROM ex WHERE s >= 0 AND y IS NOT NULL), nn AS (SELECT series, count(*) AS n FROM fr GROUP BY 1)"""


def _research_loss_sql(plan: str) -> str:
    return f"""pl AS ({plan}), {_ridge_sql("fr", "pl", 10.0)},
ls AS (SELECT fr.series, pl.fold, s, rw.n AS train_n, abs(y - (c0 + c1 * x1 + c2 * x2)) AS candidate, abs(y) AS baseline FROM fr JOIN pl ON fr.series = pl.series AND s >= val_lo AND s < val_hi JOIN rw ON rw.series = pl.series AND rw.fold = pl.fold),
li AS (SELECT *, candidate * candidate AS candidate_2, baseline * baseline AS baseline_2, candidate - baseline AS d, candidate * candidate - baseline * baseline AS d_2, row_number() OVER (PARTITION BY series ORDER BY s) AS i FROM ls)"""


_ERROR_SQL = "avg(candidate) / nullif(avg(baseline), 0) AS a, sqrt(avg(candidate_2) / nullif(avg(baseline_2), 0)) AS r"
_BOUND_SQL = f"""{_boot("li", "series", ("d", "d_2"), "5")}, q AS (SELECT series, quantile_cont(d, 0.975) AS h, quantile_cont(d_2, 0.975) AS h_2 FROM rm GROUP BY 1),
g AS (SELECT series, count(*) AS n, max(train_n) AS train_n, {_ERROR_SQL}, avg(baseline) AS b, avg(baseline_2) AS b_2 FROM li GROUP BY 1),
bd AS (SELECT g.*, 1 + h / b AS mh, sqrt(greatest(0, 1 + h_2 / b_2)) AS rh FROM g JOIN q USING (series))"""

SQL = {
    "fitted_ridge": f"WITH {_PAIR_SQL} SELECT series, CAST(fold AS BIGINT) AS fold, CAST(horizon AS BIGINT) AS horizon, n, round(c0, 8) AS intercept, round(c1, 8) AS weight_1, round(c2, 8) AS weight_2 FROM rw",
    "walk_forward_experiment": f"""WITH {gate_sql(_FITTED_SQL)}, {_MODEL_LOSS_SQL}, {hac_sql("model, series")}, {_boot("li", "model, series", ("candidate", "baseline"), str(BLOCK))},
      q AS (SELECT model, series, quantile_cont(candidate / nullif(baseline, 0), 0.025) AS low, quantile_cont(candidate / nullif(baseline, 0), 0.975) AS high FROM rm GROUP BY 1, 2), w AS (SELECT *, {_FOLD_WHY} AS reasons FROM gt)
      SELECT w.model, w.series, fd.n, wins, reasons = '' AS passed, reasons, discovery, round(relative_mae, 6) AS relative_mae, round(relative_rmse, 6) AS relative_rmse, round(p_value, 6) AS p_value, round(low, 6) AS low, round(high, 6) AS high
      FROM w JOIN fd USING (model, series) JOIN q USING (model, series)""",
    "fitted_blend": f"""WITH {_FITTED_SQL}, mv0 AS (SELECT series, fold, s, horizon, any_value(origin) AS origin, any_value(actual) AS actual, any_value(ln(actual / origin)) AS y, max(CASE WHEN model = 'drift' THEN ln(predicted / origin) END) AS a, max(CASE WHEN model = 'ridge' THEN ln(predicted / origin) END) AS b,
        max(fold) OVER (PARTITION BY series) AS last FROM sc WHERE predicted > 0 OR model <> 'drift' GROUP BY 1, 2, 3, 4), mv AS (SELECT * FROM mv0 WHERE a IS NOT NULL),
      g AS (SELECT series, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS y_b FROM mv WHERE fold < last GROUP BY 1),
      h AS (SELECT *, (bb * ay - ab * y_b) / (aa * bb - ab * ab) AS wa, (aa * y_b - ab * ay) / (aa * bb - ab * ab) AS wb, greatest(0, ay / aa) AS oa, greatest(0, y_b / bb) AS ob FROM g),
      k AS (SELECT series, CASE WHEN wa > 0 AND wb > 0 THEN wa WHEN oa * ay >= ob * y_b THEN oa ELSE 0 END AS da, CASE WHEN wa > 0 AND wb > 0 THEN wb WHEN oa * ay >= ob * y_b THEN 0 ELSE ob END AS db FROM h),
      w AS (SELECT series, da / greatest(1, da + db) AS da, db / greatest(1, da + db) AS db FROM k), z AS (SELECT mv.*, da, db, origin * exp(da * a + db * b) AS p FROM mv JOIN w USING (series) WHERE fold = last)
      SELECT series, count(*) AS n, round(any_value(da), 6) AS drift, round(any_value(db), 6) AS ridge, round(avg(abs(actual - p)) / avg(abs(actual - origin)), 6) AS relative_mae, round(sqrt(avg((actual - p) * (actual - p)) / avg((actual - origin) * (actual - origin))), 6) AS relative_rmse FROM z GROUP BY 1""",
    "shrunk_models": f"""WITH {_FITTED_SQL}, r AS (SELECT model, series, horizon, fold, max(fold) OVER (PARTITION BY series) AS last, CASE WHEN predicted > 0 THEN ln(predicted / origin) END AS p, ln(actual / origin) AS y FROM sc WHERE model <> 'persistence'),
      g AS (SELECT model, series, horizon, k / 20.0::DOUBLE AS alpha, avg(abs(k / 20.0::DOUBLE * p - y)) AS mae FROM r, (SELECT unnest(generate_series(0, 20)) AS k) WHERE fold < last GROUP BY 1, 2, 3, 4)
      SELECT model, series, CAST(horizon AS BIGINT) AS horizon, round(alpha, 2) AS alpha, round(mae, 8) AS mae FROM g QUALIFY row_number() OVER (PARTITION BY model, series, horizon ORDER BY mae, alpha) = 1""",
    "window_divergence": f"""WITH {SAMPLES_SQL}, fx AS (SELECT series, t, ln(close / prev) AS x1, ln(open / prev) AS x2 FROM b), e AS (SELECT series, min(train_hi) AS th, min(val_lo) AS lo, max(val_hi) AS hi FROM folds GROUP BY 1),
      w AS (SELECT fx.series, x1, x2, unnest([true, false]) AS ref, unnest([least(th - 1, t) - greatest(0, t - 59) + 1, least(hi - 1, t) - greatest(lo, t - 59) + 1]) AS k FROM fx JOIN e ON fx.series = e.series WHERE x2 IS NOT NULL),
      m AS (SELECT series, ref, x1, x2, unnest(generate_series(1, k)) AS i FROM w WHERE k > 0), p AS (SELECT series, ref, unnest(['return_1d', 'log_open', 'always']) AS feature, unnest([x1, x2, 1.0]) AS v FROM m), {psi_sql("series, feature")}
      SELECT series, coalesce(string_agg(CASE WHEN psi IS NULL THEN feature END, ',' ORDER BY feature), '') AS degenerate, round(max(psi), 6) AS max_psi, round(avg(psi), 6) AS mean_psi FROM ps GROUP BY 1""",
    "research_evaluation": f"""WITH {_RESEARCH_SQL}, {_research_loss_sql("SELECT series, fold, 60 + fold * 40 AS train_hi, 64 + fold * 40 AS val_lo, 104 + fold * 40 AS val_hi FROM (SELECT series, n, unnest(generate_series(0, 4)) AS fold FROM nn) WHERE 104 + fold * 40 <= n")},
      f AS (SELECT series, fold, {_ERROR_SQL} FROM li GROUP BY 1, 2), g AS (SELECT series, count(*) AS folds, count(CASE WHEN r < 1 THEN 1 END) AS wins, quantile_cont(a, 0.5) AS ma, quantile_cont(r, 0.5) AS mr, max(r) AS wr FROM f GROUP BY 1)
      SELECT series, folds, wins, ma < 0.98 AND mr < 0.98 AND wr <= 1.25 AND wins >= greatest(1, folds - 1) AS promotable, round(ma, 6) AS median_relative_mae, round(mr, 6) AS median_relative_rmse, round(wr, 6) AS worst_relative_rmse FROM g""",
    "holdout_verdicts": f"""WITH {_RESEARCH_SQL}, {_research_loss_sql("SELECT series, 0 AS fold, n - 65 AS train_hi, n - 60 AS val_lo, n AS val_hi FROM nn WHERE n - 65 >= 1")}, {_BOUND_SQL}
      SELECT series, n, train_n, CASE WHEN a < 0.98 AND r < 0.98 AND mh < 1 AND rh < 1 THEN 'survives' ELSE 'fails' END AS verdict, round(a, 6) AS relative_mae, round(r, 6) AS relative_rmse, round(mh, 6) AS mae_high, round(rh, 6) AS rmse_high FROM bd""",
    "multi_window_verdict": f"""WITH {_RESEARCH_SQL}, {_research_loss_sql("SELECT series, fold, hi - 125 AS train_hi, hi - 120 AS val_lo, hi - 60 AS val_hi FROM (SELECT series, fold, CASE WHEN fold = 3 THEN n + 60 ELSE 80 + (fold + 1) * ((n - 20) // 4) END AS hi FROM (SELECT series, n, unnest(generate_series(0, 3)) AS fold FROM nn WHERE n - 20 >= 240)) WHERE hi - 125 >= 1")}, {_BOUND_SQL},
      f AS (SELECT series, fold, {_ERROR_SQL} FROM li GROUP BY 1, 2), w AS (SELECT series, count(*) AS windows, count(CASE WHEN a < 0.98 AND r < 0.98 THEN 1 END) AS passing FROM f GROUP BY 1)
      SELECT series, windows, passing, CASE WHEN passing * 2 > windows AND mh < 1 AND rh < 1 THEN 'survives' ELSE 'fails' END AS verdict, round(mh, 6) AS mae_high, round(rh, 6) AS rmse_high FROM w JOIN bd USING (series)""",
}
_WINDOW_CTES = SQL["multi_window_verdict"].split("SELECT series, windows, passing, CASE")[0].rstrip()
SQL["holdout_evidence"] = f"""{_WINDOW_CTES}, ws AS (SELECT series, max(r) AS worst FROM f GROUP BY 1)
      SELECT series, passing || '/' || windows AS folds_beating_persistence, CASE WHEN passing * 2 > windows AND mh < 1 AND rh < 1 THEN 'keep' ELSE 'discard' END AS decision, true AS has_snapshot, windows AS shown, passing AS shown_passing,
        round(a, 6) AS median_relative_mae, round(r, 6) AS median_relative_rmse, round(worst, 6) AS worst_fold_relative_rmse FROM w JOIN bd USING (series) JOIN ws USING (series)"""
