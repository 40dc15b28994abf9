"""Queries on scaled rows, supervised windows, checks, browser variants of scores, and holdout comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import checks, gates, metrics, scaling
from ..operators import features as X
from ..operators import samples as S
from ..sources.tables import BARS_SQL, bars, bars_wide, table
from .features import rounded
from .forecasts import _PROB_SQL, _QUANT_SQL, SAMPLES_SQL, SCORED_SQL, STUDY, _counts, _quantiles, probabilities, scored

HORIZON = max(STUDY.horizons)


def _scaled(spark: SparkSession, sf: str, scaler) -> DataFrame:
    rows = S.numbered(bars(spark, sf))
    folds = S.tail_folds(_counts(spark, sf), STUDY)
    return scaling.validation_rows(rows, folds, scaler(rows, folds, "close", STUDY.lookback), STUDY.lookback)


def robust_scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Validation origins' closes scaled by their fold's training windows, and brought back."""
    value = scaling.transformed(F.col("close"))
    return rounded(_scaled(spark, sf, S.robust_scaler).withColumns({"scaled": value, "restored": scaling.restored(value)}), ("series", "fold", "t"), {"scaled": 6, "restored": 2})


def browser_scaled(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the browser's scaler, which takes raw rows."""
    value = scaling.transformed(F.col("close"))
    return rounded(_scaled(spark, sf, scaling.browser_scaler).withColumns({"scaled": value, "restored": scaling.restored(value)}), ("series", "fold", "t"), {"scaled": 6, "restored": 2})


def minmax_scaled(spark: SparkSession, sf: str) -> DataFrame:
    value = scaling.min_max(F.col("close"))
    return rounded(_scaled(spark, sf, S.minmax_scaler).withColumns({"scaled": value, "restored": scaling.min_max_restored(value)}), ("series", "fold", "t"), {"scaled": 8, "restored": 2})


def _sum(array: str, pick: Callable[[Column], Column]) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + pick(x))


def price_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that end before their origin, with the closes from the origin on."""
    rows = S.supervised_windows(bars(spark, sf), ("close", "volume"), STUDY.lookback, HORIZON, origin_in_window=False)
    x = _sum("x", lambda v: v["close"])
    return rounded(rows.withColumns({"x_total": x, "x_last": F.element_at("x", -1)["close"], "y_total": _sum("y", lambda v: v), "y_first": F.element_at("y", 1)}), ("series", "session", "as_of"), dict.fromkeys(("x_total", "x_last", "y_total", "y_first"), 2))


def direction_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of floored log returns, one row shorter than the closes, with the rises of the rows from the origin on."""
    returns = S.floored_returns(bars(spark, sf)).where("log_return is not null").withColumn("close", (F.col("log_return") > 0).cast("double"))
    rows = S.supervised_windows(returns, ("log_return",), STUDY.lookback, HORIZON, origin_in_window=False)
    ups = _sum("y", lambda v: v)
    return rounded(rows.withColumns({"x_total": _sum("x", lambda v: v["log_return"]), "ups": ups, "first_up": F.element_at("y", 1)}), ("series", "session", "as_of", "ups", "first_up"), {"x_total": 6})


def browser_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Log returns of the rows from the origin on against the window's last close."""
    rows = S.supervised_windows(bars(spark, sf), ("close",), STUDY.lookback, HORIZON, origin_in_window=False)
    base = F.element_at("x", -1)["close"]
    y = F.transform("y", lambda v: F.log(v / base))
    return rounded(rows.withColumns({"first": F.element_at(y, 1), "final": F.element_at(y, -1), "_y": y}).withColumn("total", _sum("_y", lambda v: v)), ("series", "session"), {"first": 8, "final": 8, "total": 6})


_FEATURES = ("log_open", "log_high", "log_low", "return_1d", "volume_change")


def feature_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of all price features with the origin in the window, and the closes after it."""
    rows = S.supervised_windows(X.price_returns(bars(spark, sf)).dropna(subset=list(_FEATURES)), _FEATURES, 30, 5, origin_in_window=True)
    sums = {f: _sum("x", lambda v, f=f: v[f]) for f in _FEATURES}
    return rounded(rows.withColumns(sums | {"y_last": F.element_at("y", -1)}), ("series", "session"), dict.fromkeys(_FEATURES, 6) | {"y_last": 2})


def floored_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Log returns of closes of which every ninth is 0."""
    rows = S.numbered(bars(spark, sf)).withColumn("close", F.when(F.col("t") % 9 == 4, F.lit(0.0)).otherwise(F.col("close")))
    return rounded(S.floored_returns(rows), ("series", "session"), {"log_return": 8})


def snapshot_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as snapshots by status, in the order of their keys, with some closes that are no numbers or not positive."""
    close = F.when(F.col("o_orderkey") % 101 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 103 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice"))
    raw = table(spark, sf, "orders").select(F.concat("o_orderstatus", (F.col("o_orderkey") % 3).cast("string")).alias("series"), F.to_date("o_orderdate").alias("session"), "o_orderkey", close.alias("close"), F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey").cast("double")).alias("priority"))
    return checks.snapshot(raw, "o_orderkey", ("close", "priority"))


def payload_checks(spark: SparkSession, sf: str) -> DataFrame:
    """One payload per nation, each with the fault that its number gives it."""
    rows = S.numbered(bars_wide(spark, sf)).withColumn("k", F.col("series").cast("int") % 6)
    close = F.when((F.col("k") == 1) & (F.col("t") == 5), F.lit(-1.0)).otherwise(F.col("close"))
    date = F.when((F.col("k") == 2) & (F.col("t") == 7), F.date_sub("session", 400)).otherwise(F.col("session"))
    packed = rows.groupBy("series", "k").agg(F.array_sort(F.collect_list(F.struct("t", date.alias("d"), close.alias("c"), F.col("open").alias("o")))).alias("_r"), F.max("session").alias("last"))
    arrays = packed.select(
        "series",
        F.transform("_r", lambda r: r["d"]).alias("dates"),
        F.transform("_r", lambda r: r["c"]).alias("closes"),
        F.when(F.col("k") == 3, F.slice(F.transform("_r", lambda r: r["o"]), 2, 100_000)).otherwise(F.transform("_r", lambda r: r["o"])).alias("opens"),
        F.when(F.col("k") == 4, F.array(F.col("last"))).otherwise(F.array(F.date_add("last", 1), F.date_add("last", 2))).alias("future"),
    )
    return checks.payload(arrays, 91)


def forecast_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Drift forecasts as served vectors, against what was asked; some of them of another ticker, length or not asked at all."""
    rows = scored(spark, sf).where("model = 'drift'").groupBy("series", "s").agg(F.collect_list("predicted").alias("prices"), F.collect_list("horizon").alias("dates"))
    served = rows.select("series", "s", F.when(F.col("s") % 7 == 0, F.lower("series")).otherwise(F.col("series")).alias("ticker"), F.lit(len(STUDY.horizons)).alias("days"), "prices", F.when(F.col("s") % 11 == 0, F.slice("dates", 1, 2)).otherwise(F.col("dates")).alias("dates"))
    asked = rows.where("s % 13 <> 0").select("series", "s", F.col("series").alias("asked_ticker"), F.when(F.col("s") % 5 == 0, F.lit(2)).otherwise(F.lit(len(STUDY.horizons))).alias("asked_days"))
    return checks.identity(served, asked, ("series", "s"))


def domain_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Targets, some of them spoilt, that can't be turned into prices, by series, horizon and form."""
    rows = S.direct_targets(bars(spark, sf), STUDY.horizons)
    spoilt = {"price_level": -F.col("price_level"), "simple_return": F.lit(-1.0), "log_return": F.lit(float("nan")), "persistence_residual": -F.col("origin")}
    bad = {f"bad_{f}": F.count_if(~checks.in_domain(F.col("origin"), F.when(F.col("t") % 17 == k, v).otherwise(F.col(f)), f)) for k, (f, v) in enumerate(spoilt.items())}
    return rows.groupBy("series", "horizon").agg(F.count(F.lit(1)).alias("n"), *(c.alias(n) for n, c in bad.items()))


def schema_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of each source as its columns, against those required and those reserved."""
    present = table(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("present"))
    missing, unknown, clash = checks.schema_gaps(F.col("present"), ("de", "en", "zz"), ("fr",))
    return present.select("source", *(F.concat_ws(",", c).alias(n) for n, c in (("missing", missing), ("unknown", unknown), ("clash", clash))))


def browser_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth actual is 0; those of the shortest horizon and one source's models are all alike."""
    actual = F.when(F.col("s") % 10 == 0, F.lit(0.0)).when(F.col("horizon") == 1, F.lit(0.0)).otherwise(F.col("actual"))
    rows = scored(spark, sf).withColumns({"actual": actual, "baseline": F.col("origin")})
    return rounded(metrics.browser_regression(rows, ("model", "horizon")), ("model", "horizon", "n"), {"mae": 3, "rmse": 3, "mape": 6, "r2": 6, "relative_mae": 8, "relative_rmse": 8})


def band_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.band_coverage(_quantiles(spark, sf), ("series", "horizon"), 0.1, 0.9), ("series", "horizon", "n"), {"coverage": 8, "width": 3, "nominal": 6})


def seed_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Folds as seeds; the ones of some series fail, all of them in one."""
    e = F.abs(F.col("actual") - F.col("predicted"))
    agrees = (F.signum(F.col("actual") - F.col("origin")) == F.signum(F.col("predicted") - F.col("origin"))).cast("double")
    rows = scored(spark, sf).groupBy("model", "series", F.col("fold").alias("seed")).agg(F.avg(e).alias("mae"), F.max(e).alias("worst_error"), F.avg(agrees).alias("direction"))
    failed = (F.col("series") == "BUILDING") | ((F.col("series") == "FURNITURE") & (F.col("seed") % 2 == 1))
    runs = rows.withColumn("error", F.when(failed, F.lit("ValueError: no rows"))).withColumn("mae", F.when(F.col("seed") == 2, F.lit(float("nan"))).otherwise(F.col("mae")))
    found = metrics.seed_spread(runs, ("model", "series"), ("mae", "worst_error", "direction"), ("direction",))
    return rounded(found, ("model", "series", "metric", "seeds", "failed", "used", "status", "failures"), dict.fromkeys(("mean", "median", "spread", "best", "worst"), 4))


def legacy_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Over all horizons, and over the shortest one alone."""
    rows, near = scored(spark, sf), min(STUDY.horizons)
    both = [metrics.legacy_holdout(rows.where(F.col("horizon") <= last), ("model", "series"), near, last).withColumn("last", F.lit(last).cast("long")) for last in (max(STUDY.horizons), near)]
    return rounded(both[0].unionByName(both[1]), ("model", "series", "last", "n"), {"mae": 3, "rmse": 3, "mape": 6, "r2": 6, "direction": 8})


def comparison_series(spark: SparkSession, sf: str) -> DataFrame:
    """The longest horizon's forecasts on the dates they are for, the last 240 of each series."""
    rows = scored(spark, sf).where(f"model = 'drift' and horizon = {HORIZON}")
    return rounded(metrics.comparison_series(rows, S.numbered(bars(spark, sf)), ("series",), 240), ("series", "session", "truncated"), {"actual": 2, "predicted": 2})


def gate_browser_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities of labelled documents against the share of the larger class; sources stand for folds."""
    rows = probabilities(spark, sf)
    y, said = F.col("actual"), (F.col("probability") >= 0.5).cast("double")
    balanced = (F.avg(F.when(y == 1, said)) + F.avg(F.when(y == 0, 1 - said))) / 2
    folds = rows.groupBy("source").agg(balanced.alias("b")).agg(F.count(F.lit(1)).alias("folds"), F.count_if(F.col("b") > gates.BrowserDirectionPolicy().fold_accuracy).alias("wins"))
    error = (F.col("probability") - y) * (F.col("probability") - y)
    report = rows.agg(F.count(F.lit(1)).alias("n"), balanced.alias("balanced_accuracy"), F.avg(error).alias("brier"), F.greatest(F.avg(y), 1 - F.avg(y)).alias("majority"))
    return rounded(gates.browser_direction_gate(report.join(folds)), ("n", "folds", "wins", "passed", "reasons"), {"balanced_accuracy": 6, "brier": 6, "majority": 6})  # one row each


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts (orders) per customer segment and status."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("ticker")), "o_custkey")
    return orders.groupBy("ticker", F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max(F.to_date("o_orderdate")).alias("newest"))


def newest_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """The ten newest artifacts of each ticker, newest first, ties to the larger id."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("ticker")), "o_custkey")
    place = F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return orders.withColumn("place", place).where("place <= 10").select("ticker", "place", F.col("o_orderkey").alias("artifact"), F.to_date("o_orderdate").alias("created"))


QUERIES = {f.__name__: f for f in (
    robust_scaled, browser_scaled, minmax_scaled, price_windows, direction_windows, browser_windows, feature_windows, floored_returns, snapshot_checks, payload_checks,
    forecast_identity, domain_checks, schema_checks, browser_regression, band_coverage, seed_spread, legacy_holdout, comparison_series, gate_browser_direction, status_counts, newest_artifacts,
)}

_VAL = "JOIN folds f ON f.series = b.series AND b.t >= f.val_lo + 59 AND b.t <= f.val_hi + 58"
_W = "WINDOW w AS (PARTITION BY series ORDER BY session), x60 AS (PARTITION BY series ORDER BY session ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), y20 AS (PARTITION BY series ORDER BY session ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)"


def _center(source: str, floor: str) -> str:
    return f"q AS (SELECT series, fold, quantile_cont(close, 0.25) AS a, quantile_cont(close, 0.5) AS c, quantile_cont(close, 0.75) AS z FROM {source} GROUP BY 1, 2), sc1 AS (SELECT series, fold, c, {floor} AS k FROM q)"


_SCALED = f"""SELECT b.series, CAST(f.fold AS BIGINT) AS fold, b.t, round((b.close - c) / k, 6) AS scaled, round(b.close, 2) AS restored FROM b {_VAL} JOIN sc1 ON sc1.series = f.series AND sc1.fold = f.fold"""

SQL = {
    "robust_scaled": f"""WITH {SAMPLES_SQL}, m AS (SELECT b.series, fold, close, least(train_hi - 1, t) - greatest(0, t - 59) + 1 AS k FROM b JOIN folds ON b.series = folds.series AND t < train_hi + 59),
      r AS (SELECT series, fold, close, unnest(generate_series(1, k)) AS i FROM m), {_center("r", "CASE WHEN z = a THEN 1 ELSE z - a END")} {_SCALED}""",
    "browser_scaled": f"""WITH {SAMPLES_SQL}, r AS (SELECT b.series, fold, close FROM b JOIN folds ON b.series = folds.series AND t < train_hi + 59), {_center("r", "greatest(z - a, 1e-12)")} {_SCALED}""",
    "minmax_scaled": f"""WITH {SAMPLES_SQL}, r AS (SELECT b.series, fold, min(close) AS lo, max(close) AS hi FROM b JOIN folds ON b.series = folds.series AND t < train_hi + 59 GROUP BY 1, 2)
      SELECT b.series, CAST(f.fold AS BIGINT) AS fold, b.t, round(CASE WHEN hi - lo > 1e-12 THEN (b.close - lo) / (hi - lo) ELSE 0 END, 8) AS scaled, round(CASE WHEN hi - lo > 1e-12 THEN b.close ELSE lo END, 2) AS restored
      FROM b {_VAL} JOIN r ON r.series = f.series AND r.fold = f.fold""",
    "price_windows": f"""WITH {BARS_SQL} SELECT series, session, lag(session) OVER w AS as_of, round(sum(close) OVER x60, 2) AS x_total, round(lag(close) OVER w, 2) AS x_last, round(sum(close) OVER y20, 2) AS y_total, round(close, 2) AS y_first
      FROM b {_W} QUALIFY count(*) OVER x60 = 60 AND count(*) OVER y20 = 20""",
    "direction_windows": f"""WITH {BARS_SQL}, r AS (SELECT series, session, ln(greatest(close, 1e-8) / greatest(prev, 1e-8)) AS r FROM b WHERE prev IS NOT NULL)
      SELECT series, session, lag(session) OVER w AS as_of, sum(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) OVER y20 AS ups, CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END AS first_up, round(sum(r) OVER x60, 6) AS x_total
      FROM r {_W} QUALIFY count(*) OVER x60 = 60 AND count(*) OVER y20 = 20""",
    "browser_windows": f"""WITH {BARS_SQL}, l AS (SELECT series, session, prev, close, lead(close, 19) OVER w AS fin, sum(ln(close)) OVER y20 AS total, count(*) OVER x60 AS nx, count(*) OVER y20 AS ny FROM b {_W})
      SELECT series, session, round(ln(close / prev), 8) AS first, round(ln(fin / prev), 8) AS final, round(total - 20 * ln(prev), 6) AS total FROM l WHERE nx = 60 AND ny = 20""",
    "feature_windows": f"""WITH {BARS_SQL}, f AS (SELECT series, session, close, ln(open / prev) AS log_open, ln(high / prev) AS log_high, ln(low / prev) AS log_low, ln(close / prev) AS return_1d,
        ln(1 + volume) - ln(1 + lag(volume) OVER (PARTITION BY series ORDER BY session)) AS volume_change FROM b QUALIFY volume_change IS NOT NULL)
      SELECT series, session, {", ".join(f"round(sum({x}) OVER x30, 6) AS {x}" for x in _FEATURES)}, round(lead(close, 5) OVER w, 2) AS y_last
      FROM f WINDOW w AS (PARTITION BY series ORDER BY session), x30 AS (PARTITION BY series ORDER BY session ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER x30 = 30 AND y_last IS NOT NULL""",
    "floored_returns": f"""WITH {BARS_SQL}, z AS (SELECT series, session, t, greatest(CASE WHEN t % 9 = 4 THEN 0 ELSE close END, 1e-8) AS c FROM b)
      SELECT series, session, round(ln(c / lag(c) OVER (PARTITION BY series ORDER BY session)), 8) AS log_return FROM z""",
    "snapshot_checks": """WITH r AS (SELECT o_orderstatus || CAST(o_orderkey % 3 AS VARCHAR) AS series, CAST(o_orderdate AS DATE) AS d, o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 103 = 0 THEN 0 ELSE o_totalprice END AS c,
        o_orderkey % 97 <> 0 AND o_custkey IS NOT NULL AS has FROM orders),
      m AS (SELECT *, lag(d) OVER (PARTITION BY series ORDER BY o_orderkey) >= d AS late FROM r),
      g AS (SELECT series, count(*) AS rows, count(CASE WHEN late THEN 1 END) AS disordered, count(CASE WHEN NOT (isfinite(c) AND has) THEN 1 END) AS unfit, count(CASE WHEN c <= 0 THEN 1 END) AS nonpositive FROM m GROUP BY 1)
      SELECT *, CASE WHEN disordered > 0 THEN 'order' WHEN unfit > 0 THEN 'features' WHEN nonpositive > 0 THEN 'close' END AS reason FROM g""",
    "payload_checks": """WITH o AS (SELECT CAST(c_nationkey AS VARCHAR) AS series, CAST(o_orderdate AS DATE) AS session, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey), d AS (SELECT series, session FROM o GROUP BY 1, 2),
      g AS (SELECT series, count(*) AS rows, CAST(series AS INTEGER) % 6 AS k FROM d GROUP BY 1)
      SELECT series, rows, CASE WHEN k = 3 THEN 'lengths' WHEN rows < 91 THEN 'rows' WHEN k = 1 AND rows > 5 THEN 'values' WHEN k = 2 AND rows > 7 THEN 'order' WHEN k = 4 THEN 'future' END AS reason FROM g""",
    "forecast_identity": f"""WITH {SCORED_SQL}, v AS (SELECT DISTINCT series, s FROM sc)
      SELECT series, s, CASE WHEN s % 13 = 0 THEN 'missing' WHEN s % 7 = 0 THEN 'ticker' WHEN s % 5 = 0 THEN 'days' WHEN s % 11 = 0 THEN 'dates' END AS reason FROM v""",
    "domain_checks": f"""WITH {BARS_SQL}, l AS (SELECT series, t, close, unnest([1, 5, 20]) AS horizon, unnest([lead(close, 1) OVER w, lead(close, 5) OVER w, lead(close, 20) OVER w]) AS y FROM b WINDOW w AS (PARTITION BY series ORDER BY session))
      SELECT series, horizon, count(*) AS n, count(CASE WHEN t % 17 = 0 THEN 1 END) AS bad_price_level, count(CASE WHEN t % 17 = 1 THEN 1 END) AS bad_simple_return, count(CASE WHEN t % 17 = 2 THEN 1 END) AS bad_log_return,
        count(CASE WHEN t % 17 = 3 THEN 1 END) AS bad_persistence_residual FROM l WHERE y IS NOT NULL GROUP BY 1, 2""",
    "schema_checks": """WITH p AS (SELECT source, list_sort(list_distinct(list(lang))) AS l FROM documents GROUP BY 1)
      SELECT source, array_to_string(list_filter(['de', 'en', 'zz'], lambda x: NOT list_contains(l, x)), ',') AS missing, array_to_string(list_filter(l, lambda x: x NOT IN ('de', 'en', 'zz', 'fr')), ',') AS unknown,
        array_to_string(list_filter(l, lambda x: x = 'fr'), ',') AS clash FROM p""",
    "browser_regression": f"""WITH {SCORED_SQL}, z AS (SELECT model, horizon, origin AS o, CASE WHEN s % 10 = 0 OR horizon = 1 THEN 0 ELSE actual END AS a, predicted AS p FROM sc)
      SELECT model, CAST(horizon AS BIGINT) AS horizon, count(*) AS n, round(avg(abs(a - p)), 3) AS mae, round(sqrt(avg((a - p) * (a - p))), 3) AS rmse, round(100 * avg(CASE WHEN abs(a) >= 1e-4 THEN abs((a - p) / a) END), 6) AS mape,
        round(CASE WHEN var_pop(a) = 0 THEN 0 ELSE 1 - avg((a - p) * (a - p)) / nullif(var_pop(a), 0) END, 6) AS r2, round(avg(abs(a - p)) / nullif(avg(abs(a - o)), 0), 8) AS relative_mae,
        round(sqrt(avg((a - p) * (a - p))) / nullif(sqrt(avg((a - o) * (a - o))), 0), 8) AS relative_rmse FROM z GROUP BY 1, 2""",
    "band_coverage": f"""WITH {_QUANT_SQL}, w AS (SELECT series, horizon, s, max(actual) AS a, max(CASE WHEN tau = 0.1 THEN predicted END) AS lo, max(CASE WHEN tau = 0.9 THEN predicted END) AS hi FROM q GROUP BY 1, 2, 3)
      SELECT series, horizon, count(*) AS n, round(avg(CASE WHEN a BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 8) AS coverage, round(avg(hi - lo), 3) AS width, 0.8::DOUBLE AS nominal FROM w GROUP BY 1, 2""",
    "seed_spread": f"""WITH {SCORED_SQL}, f AS (SELECT model, series, fold, avg(abs(actual - predicted)) AS mae, max(abs(actual - predicted)) AS worst_error, avg(CASE WHEN sign(actual - origin) = sign(predicted - origin) THEN 1.0 ELSE 0.0 END) AS direction,
        series = 'BUILDING' OR (series = 'FURNITURE' AND fold % 2 = 1) AS bad FROM sc GROUP BY 1, 2, 3),
      r AS (SELECT model, series, count(*) AS seeds, count(CASE WHEN bad THEN 1 END) AS failed, coalesce(string_agg(CASE WHEN bad THEN 'seed ' || fold || ': ValueError: no rows' END, '; ' ORDER BY fold), '') AS failures FROM f GROUP BY 1, 2),
      l AS (SELECT model, series, bad, fold, unnest(['mae', 'worst_error', 'direction']) AS metric, unnest([CASE WHEN fold <> 2 THEN mae END, worst_error, direction]) AS v FROM f),
      g AS (SELECT model, series, metric, count(CASE WHEN NOT bad THEN v END) AS used, avg(CASE WHEN NOT bad THEN v END) AS mean, quantile_cont(CASE WHEN NOT bad THEN v END, 0.5) AS median, stddev_pop(CASE WHEN NOT bad THEN v END) AS spread,
        min(CASE WHEN NOT bad THEN v END) AS lo, max(CASE WHEN NOT bad THEN v END) AS hi FROM l GROUP BY 1, 2, 3)
      SELECT model, series, metric, seeds, failed, used, round(mean, 4) AS mean, round(median, 4) AS median, round(spread, 4) AS spread, round(CASE WHEN metric = 'direction' THEN hi ELSE lo END, 4) AS best, round(CASE WHEN metric = 'direction' THEN lo ELSE hi END, 4) AS worst,
        CASE WHEN failed = 0 THEN 'success' WHEN failed = seeds THEN 'crash' ELSE 'partial' END AS status, failures FROM g JOIN r USING (model, series)""",
    "legacy_holdout": f"""WITH {SCORED_SQL}, w AS (SELECT model, series, s, max(CASE WHEN horizon = 1 THEN actual END) AS a1, max(CASE WHEN horizon = 20 THEN actual END) AS a2, max(CASE WHEN horizon = 1 THEN predicted END) AS p1, max(CASE WHEN horizon = 20 THEN predicted END) AS p2 FROM sc GROUP BY 1, 2, 3),
      d AS (SELECT *, a1 - lag(a1) OVER v AS da, p1 - lag(p1) OVER v AS dp FROM w WINDOW v AS (PARTITION BY model, series ORDER BY s)), u AS (SELECT *, unnest([1, 20]) AS last FROM d),
      e AS (SELECT *, CASE WHEN last = 1 THEN sign(da) ELSE sign(a2 - a1) END AS ua, CASE WHEN last = 1 THEN sign(dp) ELSE sign(p2 - p1) END AS up FROM u)
      SELECT model, series, CAST(last AS BIGINT) AS last, count(*) AS n, round(avg(abs(a1 - p1)), 3) AS mae, round(sqrt(avg((a1 - p1) * (a1 - p1))), 3) AS rmse, round(100 * avg(CASE WHEN a1 <> 0 THEN abs((a1 - p1) / a1) END), 6) AS mape,
        round(1 - avg((a1 - p1) * (a1 - p1)) / nullif(var_pop(a1), 0), 6) AS r2, round(avg(CASE WHEN ua = up THEN 1.0 WHEN ua <> up THEN 0.0 END), 8) AS direction FROM e GROUP BY 1, 2, 3""",
    "comparison_series": f"""WITH {SCORED_SQL}, d AS (SELECT sc.series, b.session, actual, predicted, row_number() OVER (PARTITION BY sc.series ORDER BY b.t DESC) AS r, count(*) OVER (PARTITION BY sc.series) AS n
        FROM sc JOIN b ON b.series = sc.series AND b.t = sc.t + 20 WHERE model = 'drift' AND horizon = 20)
      SELECT series, session, greatest(0, n - 240) AS truncated, round(actual, 2) AS actual, round(predicted, 2) AS predicted FROM d WHERE r <= 240""",
    "gate_browser_direction": f"""WITH {_PROB_SQL}, v AS (SELECT *, CASE WHEN (actual = 1) = (probability >= 0.5) THEN 1.0 ELSE 0.0 END AS ok FROM pr),
      f AS (SELECT source, (avg(CASE WHEN actual = 1 THEN ok END) + avg(CASE WHEN actual = 0 THEN ok END)) / 2 AS b FROM v GROUP BY 1), wn AS (SELECT count(*) AS folds, count(CASE WHEN b > 0.5 THEN 1 END) AS wins FROM f),
      g AS (SELECT count(*) AS n, (avg(CASE WHEN actual = 1 THEN ok END) + avg(CASE WHEN actual = 0 THEN ok END)) / 2 AS ba, avg((probability - actual) * (probability - actual)) AS brier, greatest(avg(actual), 1 - avg(actual)) AS majority FROM v),
      w AS (SELECT *, list_filter([CASE WHEN ba < 0.55 THEN 'balanced' END, CASE WHEN coalesce(brier / CASE WHEN 1 - majority > 1e-9 THEN 1 - majority END >= 0.98, true) THEN 'brier' END, CASE WHEN folds > 1 AND wins < 4 THEN 'wins' END, CASE WHEN n < 60 THEN 'rows' END], lambda x: x IS NOT NULL) AS why FROM g, wn)
      SELECT n, folds, wins, len(why) = 0 AS passed, array_to_string(why, ',') AS reasons, round(ba, 6) AS balanced_accuracy, round(brier, 6) AS brier, round(majority, 6) AS majority FROM w""",
    "status_counts": "SELECT c_mktsegment AS ticker, o_orderstatus AS status, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS newest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "newest_artifacts": """SELECT c_mktsegment AS ticker, CAST(row_number() OVER w AS INTEGER) AS place, o_orderkey AS artifact, CAST(o_orderdate AS DATE) AS created FROM orders JOIN customer ON o_custkey = c_custkey
      WINDOW w AS (PARTITION BY c_mktsegment ORDER BY o_orderdate DESC, o_orderkey DESC) QUALIFY row_number() OVER w <= 10""",
}
