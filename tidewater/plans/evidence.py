"""Queries on evidence, drift, gates and whole studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import forecast, gates, metrics
from ..operators import samples as S
from ..sources.shared import written
from ..sources.tables import bars, bars_wide, table
from .features import rounded
from .forecasts import _PROB_SQL, _REPORT, SCORED_SQL, STUDY, fold_sql, probabilities, scored

RESAMPLES = 500
BLOCK = 20


def _losses(spark: SparkSession, sf: str) -> DataFrame:
    return E.losses(scored(spark, sf), "drift").withColumn("improvement", F.col("baseline") - F.col("candidate"))


def bootstrap_mean_ci(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.bootstrap_mean(_losses(spark, sf), ("series",), "s", "improvement", RESAMPLES, F.lit(BLOCK)), ("series", "n"), dict.fromkeys(("mean", "low", "high"), 3))


def bootstrap_ratio_ci(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.bootstrap_ratio(_losses(spark, sf), ("series",), "s", "candidate", "baseline", RESAMPLES, F.lit(BLOCK)), ("series", "n", "resamples"), dict.fromkeys(("ratio", "low", "high"), 8))


def dm_hac(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.hac(_losses(spark, sf), ("series",), "s", "improvement"), ("series", "n", "lags"), {"mean": 3, "statistic": 6, "p_value": 6})


def fdr_decisions(spark: SparkSession, sf: str) -> DataFrame:
    tests = E.hac(_losses(spark, sf), ("series",), "s", "improvement")
    return rounded(E.false_discoveries(tests, "p_value", (), 0.10), ("series", "discovery"), {"p_value": 6})


def psi_by_feature(spark: SparkSession, sf: str) -> DataFrame:
    panel = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))
    return rounded(E.psi(panel.where("value is not null"), "dim", "value", F.col("label") % 2 == 0), ("dim", "bins"), {"psi": 6})


def residual_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Error magnitudes averaged over horizons, first half against second."""
    rows = E.model_losses(scored(spark, sf)).where("model = 'drift'")
    return rounded(E.residual_drift(rows, ("series",), "s", "candidate", 250), ("series", "drift"), dict.fromkeys(("mean_1", "low_1", "high_1", "mean_2", "low_2", "high_2"), 3))


def constrained_blend(spark: SparkSession, sf: str) -> DataFrame:
    weights = E.constrained_blend(scored(spark, sf), ("drift",))
    return scored(spark, sf).where("model = 'drift'").groupBy("horizon").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.round(F.lit(weights["drift"]), 6))


def fold_gate_rows(rows: DataFrame, source: DataFrame, study: S.Study) -> DataFrame:
    """What the gates look at, per model other than persistence and series; rows: scored forecasts.

    A fold is won on both errors, and its worst is the largest squared one; ``wins_rmse`` looks at squared errors alone.
    """
    keys, near, far = ("model", "series"), min(study.horizons), max(study.horizons)
    pooled = metrics.relative(metrics.report(rows, keys), keys=("series", "horizon"))
    folds = metrics.relative(metrics.report(rows, keys, "fold"), keys=("series", "fold")).where("fold is not null")
    mae, rmse = F.col("relative_mae") < 1, F.col("relative_rmse") < 1
    summary = folds.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), F.count_if(mae & rmse).alias("wins"), F.count_if(rmse).alias("wins_rmse"), F.max("relative_rmse").alias("worst_fold"))
    scaled = metrics.scaled_errors(rows, source, study.lookback, study.gap).groupBy(*keys).agg(F.avg("mase").alias("mase"), F.avg("rmsse").alias("rmsse"))
    of = lambda h, c, name: F.max(F.when(F.col("horizon").isNull() if h is None else F.col("horizon") == h, F.col(c))).alias(name)
    by = pooled.groupBy(*keys).agg(
        of(None, "relative_mae", "relative_mae"), of(None, "relative_rmse", "relative_rmse"), of(None, "n", "n"), of(near, "relative_mae", "first_mae"), of(near, "relative_rmse", "first_rmse"),
        of(far, "relative_mae", "selected_mae"), of(far, "relative_rmse", "selected_rmse"), of(far, "n", "rows"),
    )
    return by.join(summary, list(keys)).join(scaled, list(keys)).where("model <> 'persistence'")


#: The study of one series per nation.
WIDE = S.Study(lookback=20, horizons=(1, 3))


def _gate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return fold_gate_rows(written(scored(spark, sf), "scored"), bars(spark, sf), STUDY)


_GATE = ("model", "series", "passed", "reasons", "wins")


def gate_fold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gates.fold_gate(_gate_rows(spark, sf)), _GATE, {"relative_mae": 6, "relative_rmse": 6, "mase": 6, "rmsse": 6, "worst_fold": 6})


def gate_universe(spark: SparkSession, sf: str) -> DataFrame:
    """One series per nation is an asset; one of seven lacks its squared error."""
    source = bars_wide(spark, sf)
    rows = fold_gate_rows(written(forecast.baseline_forecasts(source, WIDE), "scored"), source, WIDE)
    judged = gates.fold_gate(rows).withColumn("relative_rmse", F.when(F.col("series").cast("int") % 7 != 3, F.col("relative_rmse")))
    found = gates.universe_gate(judged.select("model", "series", "relative_mae", "relative_rmse", "passed"))
    return rounded(found, ("model", "assets", "complete", "qualifying", "catastrophic", "passed", "reasons"), {"median_mae": 6, "median_rmse": 6})


def gate_direction(spark: SparkSession, sf: str) -> DataFrame:
    rows = probabilities(spark, sf)
    found = metrics.probability_report(rows, F.lit(1))
    rate = rows.agg(F.avg("actual").alias("rate")).withColumn("base_brier", F.col("rate") * (1 - F.col("rate"))).withColumn("base_log_loss", -(F.col("rate") * F.log("rate") + (1 - F.col("rate")) * F.log(1 - F.col("rate"))))
    # Sources stand for folds.
    y, p = F.col("actual"), F.col("probability")
    sides = [F.avg(F.when(y == k, ((p >= 0.5).cast("int") == k).cast("double"))) for k in (0, 1)]
    by = rows.groupBy("source").agg(((sides[0] + sides[1]) / 2).alias("a"), F.avg((p - y) * (p - y)).alias("b"), (F.avg(y) * (1 - F.avg(y))).alias("c"))
    folds = by.agg(F.count(F.lit(1)).alias("folds"), F.count_if(F.coalesce((F.col("a") > 0.5) & (F.col("b") < F.col("c")), F.lit(False))).alias("wins"))
    return rounded(gates.direction_gate(found.join(rate).join(folds)), ("n", "folds", "wins", "passed", "reasons"), {"balanced_accuracy": 6, "brier": 6, "base_brier": 6})


def _serving(spark: SparkSession, sf: str) -> DataFrame:
    source, far, policy = written(bars(spark, sf), "bars"), max(STUDY.horizons), gates.ServingPolicy()
    rows = written(forecast.baseline_forecasts(source, STUDY), "scored")
    vol = metrics.volatility(source, horizon=far)
    move = rows.where(f"model = 'drift' and horizon = {far}").groupBy("series").agg(F.abs(F.log(F.try_divide(F.max_by("predicted", "s"), F.max_by("origin", "s")))).alias("move"))
    known = source.groupBy("series").agg(F.least(F.count(F.lit(1)) - 1, F.lit(60)).alias("recent_n"), F.greatest(F.count(F.lit(1)) - far, F.lit(0)).alias("horizon_n"))
    limits = vol.select("series", (policy.deviations * F.col("per_horizon")).alias("limit_sd"), F.col("extreme").alias("limit_extreme"))
    return fold_gate_rows(rows, source, STUDY).join(move, "series").join(limits, "series").join(known, "series")


_SERVED = {"first_mae": 6, "first_rmse": 6, "selected_mae": 6, "selected_rmse": 6, "move": 6}


def gate_browser_price(spark: SparkSession, sf: str) -> DataFrame:
    rows = _serving(spark, sf).drop("wins").withColumnRenamed("wins_rmse", "wins")
    return rounded(gates.browser_gate(rows), _GATE, _SERVED)


def gate_server(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gates.server_gate(_serving(spark, sf)), _GATE, _SERVED)


QUERIES = {f.__name__: f for f in (
    bootstrap_mean_ci, bootstrap_ratio_ci, dm_hac, fdr_decisions, psi_by_feature, residual_drift, constrained_blend, gate_fold, gate_universe, gate_direction,
    gate_browser_price, gate_server,
)}

_LOSS = """ls AS (SELECT series, s, avg(CASE WHEN model = 'drift' THEN abs(actual - predicted) END) AS candidate, avg(CASE WHEN model = 'persistence' THEN abs(actual - predicted) END) AS baseline FROM sc GROUP BY 1, 2),
li AS (SELECT *, baseline - candidate AS improvement, row_number() OVER (PARTITION BY series ORDER BY s) AS i FROM ls)"""


def _boot(source: str, keys: str, values: tuple[str, ...], block: str, resamples: int = RESAMPLES) -> str:
    """CTEs up to ``rm`` (keys, resample, values): source has keys, i from 1 and the values."""
    sums = ", ".join(f"sum({v}) OVER (PARTITION BY {keys} ORDER BY i) AS {v}" for v in values)
    zero = ", ".join("0.0" for _ in values)
    diff = ", ".join(f"sum(h.{v} - l.{v}) / max(n) AS {v}" for v in values)
    ks = keys.split(", ")
    return f"""pf AS (SELECT {keys}, i, {sums} FROM {source} UNION ALL SELECT DISTINCT {keys}, 0, {zero} FROM {source}),
cn AS (SELECT {keys}, n, greatest(1, least({block}, n)) AS bl FROM (SELECT {keys}, count(*) AS n FROM {source} GROUP BY ALL)),
rs AS (SELECT {keys}, n, bl, unnest(generate_series(0, {resamples - 1})) AS resample FROM cn),
bk AS (SELECT *, unnest(generate_series(0, CAST(ceil(n / bl) AS BIGINT) - 1)) AS k FROM rs),
st AS (SELECT *, ('0x' || substr(md5('0:' || resample || ':' || k), 1, 8))::BIGINT % (n - bl + 1) AS lo FROM bk),
rm AS (SELECT {", ".join("st." + k for k in ks)}, resample, {diff} FROM st JOIN pf l ON {" AND ".join(f"l.{k} = st.{k}" for k in ks)} AND l.i = st.lo
  JOIN pf h ON {" AND ".join(f"h.{k} = st.{k}" for k in ks)} AND h.i = st.lo + least(bl, n - k * bl) GROUP BY ALL)"""


def psi_sql(keys: str) -> str:
    """CTE ps (keys, bins, psi) from p (keys, ref, v)."""
    return f"""pe AS (SELECT {keys}, list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM p WHERE ref GROUP BY ALL),
pb AS (SELECT {keys}, ref, least(greatest(len(list_filter(e, lambda x: x <= v)) - 1, 0), len(e) - 2) AS b FROM p JOIN pe USING ({keys})),
pc AS (SELECT {keys}, unnest(generate_series(0, len(e) - 2)) AS b FROM pe WHERE len(e) > 1), pk AS (SELECT {keys}, b, count(CASE WHEN ref THEN 1 END) AS r, count(CASE WHEN NOT ref THEN 1 END) AS o FROM pc LEFT JOIN pb USING ({keys}, b) GROUP BY ALL),
px AS (SELECT {keys}, (r + 1e-4) / (sum(r) OVER w + 1e-4 * count(*) OVER w) AS x, (o + 1e-4) / (sum(o) OVER w + 1e-4 * count(*) OVER w) AS y FROM pk WINDOW w AS (PARTITION BY {keys})),
pz AS (SELECT {keys}, count(*) AS bins, sum((y - x) * ln(y / x)) AS psi FROM px GROUP BY ALL), ps AS (SELECT {keys}, bins, psi FROM pe LEFT JOIN pz USING ({keys}))"""


def hac_sql(keys: str) -> str:
    """CTE fd with statistic, p_value and discovery per key, from li (keys, i, improvement)."""
    return f"""hc AS (SELECT *, improvement - avg(improvement) OVER (PARTITION BY {keys}) AS c FROM li),
hp AS (SELECT {", ".join("a." + k.strip() for k in keys.split(","))}, b.i - a.i AS l, avg(a.c * b.c) AS g FROM hc a JOIN hc b ON {" AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))} AND b.i - a.i BETWEEN 0 AND 40 GROUP BY ALL),
hn AS (SELECT {keys}, count(*) AS n, avg(improvement) AS mean, CAST(floor(4 * pow(count(*) / 100, 2.0::DOUBLE / 9)) AS BIGINT) AS lags FROM li GROUP BY ALL),
hv AS (SELECT {keys}, any_value(n) AS n, any_value(mean) AS mean, any_value(lags) AS lags, sum(CASE WHEN l = 0 THEN g WHEN l <= lags THEN 2 * (1 - l / (lags + 1)) * g ELSE 0 END) AS var FROM hn JOIN hp USING ({keys}) GROUP BY {keys}),
hz AS (SELECT *, mean / sqrt(CASE WHEN var > 0 THEN var / n END) AS z, 1 / (1 + 0.3275911::DOUBLE * abs(mean / sqrt(CASE WHEN var > 0 THEN var / n END)) / sqrt(2)) AS tt FROM hv),
ht AS (SELECT *, tt * (0.254829592::DOUBLE + tt * (-0.284496736::DOUBLE + tt * (1.421413741::DOUBLE + tt * (-1.453152027::DOUBLE + tt * 1.061405429::DOUBLE)))) * exp(-z * z / 2) AS p_value FROM hz),
fd AS (SELECT *, coalesce(p_value <= max(CASE WHEN p_value <= 0.10 * r / m THEN p_value END) OVER (), false) AS discovery FROM (SELECT *, row_number() OVER (ORDER BY p_value) AS r, count(*) OVER () AS m FROM ht))"""


_HAC = hac_sql("series")


def gate_sql(base: str = SCORED_SQL, source: str = "b", lookback: int = 60, near: int = 1, far: int = 20) -> str:
    """CTE gt, what the gates look at, from the CTEs in ``base`` (sc, folds, source)."""
    return f"""{fold_sql(base)}, po0 AS (SELECT model, series, horizon, {_REPORT} FROM sc GROUP BY GROUPING SETS ((model, series, horizon), (model, series))),
po AS (SELECT a.*, a.mae / nullif(p.mae, 0) AS relative_mae, a.rmse / nullif(p.rmse, 0) AS relative_rmse FROM po0 a JOIN po0 p ON p.model = 'persistence' AND a.series = p.series AND a.horizon IS NOT DISTINCT FROM p.horizon),
sl AS (SELECT b.series, fold, avg(abs(close - prev)) AS ad, avg((close - prev) * (close - prev)) AS sd FROM {source} b JOIN folds ON b.series = folds.series AND t <= train_hi - 1 + {lookback - 1} + {far} GROUP BY 1, 2),
ms AS (SELECT model, series, avg(mae / ad) AS mase, avg(sqrt(mse / sd)) AS rmsse FROM (SELECT model, series, fold, avg(abs(actual - predicted)) AS mae, avg((actual - predicted) * (actual - predicted)) AS mse FROM sc GROUP BY 1, 2, 3) JOIN sl USING (series, fold) GROUP BY 1, 2),
su AS (SELECT model, series, count(*) AS folds, count(CASE WHEN relative_mae < 1 AND relative_rmse < 1 THEN 1 END) AS wins, count(CASE WHEN relative_rmse < 1 THEN 1 END) AS wins_rmse, max(relative_rmse) AS worst_fold FROM fs GROUP BY 1, 2),
gr AS (SELECT model, series, max(CASE WHEN horizon IS NULL THEN relative_mae END) AS relative_mae, max(CASE WHEN horizon IS NULL THEN relative_rmse END) AS relative_rmse, max(CASE WHEN horizon IS NULL THEN n END) AS n,
  max(CASE WHEN horizon = {near} THEN relative_mae END) AS first_mae, max(CASE WHEN horizon = {near} THEN relative_rmse END) AS first_rmse, max(CASE WHEN horizon = {far} THEN relative_mae END) AS selected_mae,
  max(CASE WHEN horizon = {far} THEN relative_rmse END) AS selected_rmse, max(CASE WHEN horizon = {far} THEN n END) AS rows FROM po WHERE model <> 'persistence' GROUP BY 1, 2),
gt AS (SELECT * FROM gr JOIN su USING (model, series) JOIN ms USING (model, series))"""


_GATE_SQL = gate_sql()


def _why(**failing: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN coalesce({c}, true) THEN '{n}' END" for n, c in failing.items()) + "], lambda x: x IS NOT NULL), ',')"


_FOLD_WHY = _why(relative_mae="relative_mae > 0.95", relative_rmse="relative_rmse > 0.95", mase="mase >= 1", rmsse="rmsse >= 1", wins="wins < 4", worst_fold="worst_fold > 1.25")
_SERVE = f"""{_GATE_SQL}, vl AS (SELECT series, stddev_samp(CASE WHEN k <= 60 THEN r END) * sqrt(20) AS ph, quantile_cont(h, 0.995) AS x, least(count(r), 60) AS nr, count(h) AS nh FROM (
  SELECT series, ln(close / prev) AS r, abs(ln(close / lag(close, 20) OVER (PARTITION BY series ORDER BY session))) AS h, row_number() OVER (PARTITION BY series ORDER BY session DESC) AS k FROM b) GROUP BY 1),
mv AS (SELECT series, CASE WHEN arg_max(predicted, s) > 0 THEN abs(ln(CASE WHEN arg_max(predicted, s) > 0 THEN arg_max(predicted, s) / arg_max(origin, s) ELSE 1 END)) END AS move FROM sc WHERE model = 'drift' AND horizon = 20 GROUP BY 1),
sv AS (SELECT gt.*, move, 4 * ph AS l1, x AS l2, nr, nh FROM gt JOIN mv USING (series) JOIN vl USING (series))"""
_BROWSER_WHY = _why(
    relative_mae="relative_mae >= 0.98", relative_rmse="relative_rmse >= 0.98", wins="folds > 1 AND wins_rmse < 4", worst_fold="folds > 1 AND worst_fold > 1.25", rows="rows < 60",
    first_day="coalesce(first_mae >= 1 OR first_rmse >= 1, false)", selected="coalesce(selected_mae >= 1 OR selected_rmse >= 1, false)", implausible="coalesce(nr >= 30 AND nh >= 30 AND move > l1 AND move > l2, false)",
)
_SERVER_WHY = _why(
    serving_mae="relative_mae >= 0.98", serving_rmse="relative_rmse >= 0.98", first_day="first_mae >= 1 OR first_rmse >= 1", selected="selected_mae >= 1 OR selected_rmse >= 1", rows="rows < 60",
    implausible="coalesce(nr >= 30 AND (move > l1 OR (nh >= 30 AND move > l2)), false)",
)


def _serve(why: str, wins: str) -> str:
    served = ", ".join(f"round({c}, 6) AS {c}" for c in _SERVED)
    return f"WITH {_SERVE}, w AS (SELECT *, {why} AS reasons FROM sv) SELECT model, series, reasons = '' AS passed, reasons, {wins} AS wins, {served} FROM w"


#: Samples, folds and forecasts of the study of one series per nation.
_WIDE_SQL = """bars AS (SELECT CAST(c_nationkey AS VARCHAR) AS series, CAST(o_orderdate AS DATE) AS session, arg_max(o_totalprice, o_orderkey) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY session) - 1 AS t, lag(close) OVER (PARTITION BY series ORDER BY session) AS prev FROM bars),
sm AS (SELECT series, session, t, t - 19 AS s, close AS origin, lag(close, 19) OVER w AS fc, lead(close, 1) OVER w AS y1, lead(close, 3) OVER w AS y3 FROM b WINDOW w AS (PARTITION BY series ORDER BY session) QUALIFY fc IS NOT NULL AND y3 IS NOT NULL),
n AS (SELECT series, count(*) AS n FROM sm GROUP BY 1), f0 AS (SELECT series, n, unnest(generate_series(0, 4)) AS fold FROM n),
folds AS (SELECT series, fold, n - (5 - fold) * (n // 12) - 3 AS train_hi, n - (5 - fold) * (n // 12) AS val_lo, n - (5 - fold) * (n // 12) + n // 12 AS val_hi FROM f0 WHERE n - (5 - fold) * (n // 12) - 3 > 0 AND n // 12 > 0),
lg AS (SELECT sm.series, fold, train_hi, s, t, session, origin, fc, unnest([1, 3]) AS horizon, unnest([y1, y3]) AS actual FROM sm JOIN folds ON sm.series = folds.series AND s >= val_lo AND s < val_hi),
sc AS (SELECT 'persistence' AS model, lg.*, origin AS predicted FROM lg UNION ALL SELECT 'drift', lg.*, origin + horizon * (origin - fc) / 19 FROM lg)"""
_UNIVERSE_WHY = _why(assets="assets < 12", incomplete="complete < assets", qualifying="qualifying < 8", median_mae="coalesce(ma > 0.95, false)", median_rmse="coalesce(mr > 0.95, false)", catastrophic="catastrophic > 1")


SQL = {
    "bootstrap_mean_ci": f"""WITH {SCORED_SQL}, {_LOSS}, {_boot("li", "series", ("improvement",), str(BLOCK))}, q AS (SELECT series, quantile_cont(improvement, 0.025) AS low, quantile_cont(improvement, 0.975) AS high FROM rm GROUP BY 1)
      SELECT li.series, count(*) AS n, round(avg(improvement), 3) AS mean, round(any_value(low), 3) AS low, round(any_value(high), 3) AS high FROM li JOIN q USING (series) GROUP BY 1""",
    "bootstrap_ratio_ci": f"""WITH {SCORED_SQL}, {_LOSS}, {_boot("li", "series", ("candidate", "baseline"), str(BLOCK))}, r AS (SELECT series, candidate / nullif(baseline, 0) AS r FROM rm),
      q AS (SELECT series, count(r) AS resamples, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM r GROUP BY 1)
      SELECT li.series, count(*) AS n, any_value(resamples) AS resamples, round(avg(candidate) / avg(baseline), 8) AS ratio, round(any_value(low), 8) AS low, round(any_value(high), 8) AS high FROM li JOIN q USING (series) GROUP BY 1""",
    "dm_hac": f"WITH {SCORED_SQL}, {_LOSS}, {_HAC} SELECT series, n, lags, round(mean, 3) AS mean, round(z, 6) AS statistic, round(p_value, 6) AS p_value FROM ht",
    "fdr_decisions": f"WITH {SCORED_SQL}, {_LOSS}, {_HAC} SELECT series, discovery, round(p_value, 6) AS p_value FROM fd",
    "psi_by_feature": f"""WITH p AS (SELECT label % 2 = 0 AS ref, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), {psi_sql("dim")}
      SELECT CAST(dim AS INTEGER) AS dim, bins, round(psi, 6) AS psi FROM ps""",
    "residual_drift": f"""WITH {SCORED_SQL}, e AS (SELECT series, s, avg(abs(actual - predicted)) AS e, row_number() OVER (PARTITION BY series ORDER BY s) AS r, count(*) OVER (PARTITION BY series) AS n FROM sc WHERE model = 'drift' GROUP BY 1, 2),
      hs AS (SELECT series, CASE WHEN r <= n // 2 THEN 1 ELSE 2 END AS half, e, n AS whole, row_number() OVER (PARTITION BY series, r <= n // 2 ORDER BY s) AS i FROM e WHERE n >= 10),
      {_boot("hs", "series, half, whole", ("e",), "least(20, whole // 2 // 4)", 250)}, q AS (SELECT series, half, quantile_cont(e, 0.025) AS low, quantile_cont(e, 0.975) AS high FROM rm GROUP BY 1, 2),
      m AS (SELECT series, half, avg(e) AS mean FROM hs GROUP BY 1, 2), w AS (SELECT a.series, a.mean AS mean_1, qa.low AS low_1, qa.high AS high_1, z.mean AS mean_2, qz.low AS low_2, qz.high AS high_2
        FROM m a JOIN m z ON a.series = z.series AND a.half = 1 AND z.half = 2 JOIN q qa ON qa.series = a.series AND qa.half = 1 JOIN q qz ON qz.series = a.series AND qz.half = 2)
      SELECT series, low_1 > high_2 OR low_2 > high_1 AS drift, round(mean_1, 3) AS mean_1, round(low_1, 3) AS low_1, round(high_1, 3) AS high_1, round(mean_2, 3) AS mean_2, round(low_2, 3) AS low_2, round(high_2, 3) AS high_2 FROM w""",
    "constrained_blend": f"""WITH {SCORED_SQL}, g AS (SELECT sum((predicted - origin) * (actual - origin)) / sum((predicted - origin) * (predicted - origin)) AS w FROM sc WHERE model = 'drift')
      SELECT CAST(horizon AS BIGINT) AS horizon, count(*) AS n, round(least(1, greatest(0, any_value(w))), 6) AS weight FROM sc, g WHERE model = 'drift' GROUP BY 1""",
    "gate_fold": f"""WITH {_GATE_SQL}, w AS (SELECT *, {_FOLD_WHY} AS reasons FROM gt) SELECT model, series, reasons = '' AS passed, reasons, wins, round(relative_mae, 6) AS relative_mae, round(relative_rmse, 6) AS relative_rmse,
      round(mase, 6) AS mase, round(rmsse, 6) AS rmsse, round(worst_fold, 6) AS worst_fold FROM w""",
    "gate_direction": f"""WITH {_PROB_SQL}, p AS (SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS said, greatest(least(probability, 1 - 1e-7), 1e-7) AS cp FROM pr),
      g AS (SELECT count(*) AS n, (avg(CASE WHEN actual = 1 THEN said END) + avg(CASE WHEN actual = 0 THEN 1 - said END)) / 2 AS ba, avg((probability - actual) * (probability - actual)) AS brier, avg(-CASE WHEN actual = 1 THEN ln(cp) ELSE ln(1 - cp) END) AS ll,
        avg(actual) AS rate, (SELECT sum(n * abs(mean_probability - observed)) / sum(n) FROM bins) AS ece FROM p),
      f AS (SELECT count(*) AS folds, count(CASE WHEN a > 0.5 AND b < c THEN 1 END) AS wins FROM (SELECT (avg(CASE WHEN actual = 1 THEN said END) + avg(CASE WHEN actual = 0 THEN 1 - said END)) / 2 AS a, avg((probability - actual) * (probability - actual)) AS b, avg(actual) * (1 - avg(actual)) AS c FROM p GROUP BY source)),
      w AS (SELECT *, rate * (1 - rate) AS bb, {_why(balanced="ba < 0.53", brier="brier > 0.98 * rate * (1 - rate)", log_loss="ll > 0.98 * -(rate * ln(rate) + (1 - rate) * ln(1 - rate))", ece="ece > 0.1", wins="folds = 0 OR wins < least(folds, 4)")} AS reasons FROM g, f)
      SELECT n, folds, wins, reasons = '' AS passed, reasons, round(ba, 6) AS balanced_accuracy, round(brier, 6) AS brier, round(bb, 6) AS base_brier FROM w""",
    "gate_universe": f"""WITH {gate_sql(_WIDE_SQL, lookback=20, far=3)}, v AS (SELECT model, series, relative_mae AS a, CASE WHEN CAST(series AS INTEGER) % 7 <> 3 THEN relative_rmse END AS r, {_FOLD_WHY} = '' AS passed FROM gt),
      g AS (SELECT model, count(*) AS assets, count(CASE WHEN a IS NOT NULL AND r IS NOT NULL THEN 1 END) AS complete, count(CASE WHEN passed THEN 1 END) AS qualifying, quantile_cont(CASE WHEN r IS NOT NULL THEN a END, 0.5) AS ma,
        quantile_cont(CASE WHEN a IS NOT NULL THEN r END, 0.5) AS mr, count(CASE WHEN a IS NOT NULL AND r > 1.25 THEN 1 END) AS catastrophic FROM v GROUP BY 1), w AS (SELECT *, {_UNIVERSE_WHY} AS reasons FROM g)
      SELECT model, assets, complete, qualifying, catastrophic, reasons = '' AS passed, reasons, round(ma, 6) AS median_mae, round(mr, 6) AS median_rmse FROM w""",
    "gate_browser_price": _serve(_BROWSER_WHY, "wins_rmse"),
    "gate_server": _serve(f"array_to_string(list_filter([{_FOLD_WHY}, {_SERVER_WHY}], lambda x: x <> ''), ',')", "wins"),
}
