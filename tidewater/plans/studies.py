"""Queries on fitted candidates, bundles, streams and other variants of scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import align, bundles, features, gates, metrics
from ..operators.forecasters import CANDIDATES
from ..sources import commits
from ..sources.shared import new_path, written
from ..sources.tables import BARS_SQL, BENCHMARKS, bars, benchmarks, table
from ..streaming import jobs
from .evidence import _FOLD_WHY, _GATE_SQL, _gate_rows
from .features import rounded
from .forecasts import SCORED_SQL, scored

#: Feature sets of the ablation.
SETS = {
    "returns": ("log_open", "log_high", "log_low", "return_1d", "volume_change"),
    "technical": ("close_sma_20", "close_ema_20", "rsi_centered", "macd_close", "atr_14_rel"),
    "market": ("spy_return_1d", "qqq_return_1d", "relative_return", "beta_20"),
    "calendar": ("month_sin", "month_cos", "weekday_sin", "weekday_cos"),
}


def _dataset(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Feature rows with the next log return, cut in time: the last fifth of each series is held out, one row left between."""
    built = features.stationary_features(bars(spark, sf), benchmarks(spark, sf), BENCHMARKS)
    w = W.partitionBy("series").orderBy("session")
    rows = built.withColumn("y", F.log(F.lead("close").over(w) / F.col("close"))).withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("series")))
    rows = written(rows.where("y is not null"), "dataset")
    return rows.where("_r < 0.8 * _n - 1"), rows.where("_r >= 0.8 * _n")


def _judged(test: DataFrame, name: str) -> DataFrame:
    e = F.col("y") - F.col("predicted")
    return test.agg(F.lit(name).alias("candidate"), F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.avg(F.abs("y")), 6).alias("persistence_mae"))


def candidate_report(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out error of each family of candidates next to persistence's."""
    train, test = _dataset(spark, sf)
    names = tuple(x for s in SETS.values() for x in s)
    return reduce(DataFrame.unionByName, (_judged(CANDIDATES[c](names, "y", seed=0).fit(train).predict(test), c) for c in ("ridge", "elastic_net", "boosted_trees", "random_features")))


def feature_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out error of a ridge on each feature set and on all, with the same cut."""
    train, test = _dataset(spark, sf)
    sets = SETS | {"all": tuple(x for s in SETS.values() for x in s)}
    return reduce(DataFrame.unionByName, (_judged(CANDIDATES["ridge"](names, "y", seed=0).fit(train).predict(test), name) for name, names in sets.items()))


def published_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Paths over the next 30 weekdays: the learned one where its gate passed, else persistence."""
    source = bars(spark, sf)
    lasts = source.groupBy("series").agg(F.max("session").alias("last_session")).withColumn("always", F.lit(False))
    holidays = lasts.select("last_session").where("false").withColumnRenamed("last_session", "session")
    passed = gates.fold_gate(_gate_rows(spark, sf)).select("series", "passed")
    return rounded(bundles.latest_paths(source, align.future_sessions(lasts, holidays, 30), passed, 60), ("series", "step", "session", "model"), {"price": 2})


def publication(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts published twice as bundles: what the pointers lead to, and how many there are of each series."""
    paths, root = written(published_forecasts(spark, sf), "paths"), new_path(spark, "published")
    steps = F.array_sort(F.collect_list(F.struct("step", "session", "price")))
    bundle = paths.groupBy(F.col("series").alias("ticker"), "model").agg(steps.alias("steps"))
    version = {commits.publish(bundle, root, "price") for _ in range(2)}
    found = commits.read_stored(spark, root, "price", *version)
    told = commits.pointers(spark, root).groupBy("ticker").agg(F.count(F.lit(1)).alias("pointers"))
    return found.join(told, "ticker").select("ticker", "model", "pointers", F.size("steps").cast("long").alias("n"), F.round(F.element_at("steps", -1)["price"], 2).alias("last_price"))


def bundle_check(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles built from bars; of some series something is wrong."""
    rows = bars(spark, sf).withColumn("_k", F.row_number().over(W.partitionBy("series").orderBy(F.desc("session"))))
    past = rows.where("_k > 5 and _k <= 25").groupBy("series").agg(F.array_sort(F.collect_list(F.struct("session", "close"))).alias("_p"))
    future = rows.where("_k <= 5").groupBy("series").agg(F.array_sort(F.collect_list(F.struct("session", "close"))).alias("_f"))
    both = past.join(future, "series")
    names = {"history_dates": F.col("_p.session"), "history_prices": F.col("_p.close"), "future_dates": F.col("_f.session"), "prices": F.when(F.col("series") == "BUILDING", F.transform("_f.close", lambda x: -x)).otherwise(F.col("_f.close")), "returns": F.when(F.col("series") == "MACHINERY", F.slice("_f.close", 1, 4)).otherwise(F.col("_f.close"))}
    made = both.withColumns(names).withColumn("origin", F.element_at("history_dates", -1)).withColumn("origin_price", F.element_at("history_prices", -1) + F.when(F.col("series") == "FURNITURE", 1.0).otherwise(0.0))
    return made.select("series", F.array_join(bundles.bundle_problems(5, 20), ",").alias("problems"))


def horizon_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", bundles.horizon_bucket((F.col("p_partkey") % 45 - 3).cast("int")).cast("long").alias("bucket"))


def served_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """What is served per nation of a bundle made from its last order."""
    orders = table(spark, sf, "orders").withColumn("ticker", F.col("o_custkey") % 30)
    made = orders.groupBy("ticker").agg(F.max("o_orderdate").cast("timestamp").alias("created_at"), F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("_p"))
    made = made.withColumn("problem", F.when(F.col("ticker") % 4 == 0, "features")).withColumn("prices", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.round(F.col("_p") + k, 2)))
    wanted = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("ticker"), (F.col("n_nationkey") % 7 + 1).cast("int").alias("days")).union(spark.sql("select 99L, 3"))
    found = bundles.served(wanted, made, F.lit("2001-08-01 12:00:00").cast("timestamp"))
    return found.select("ticker", "absent", F.size("prices").cast("long").alias("n"), F.round(F.element_at("prices", -1), 2).alias("last"))


def research_report(spark: SparkSession, sf: str) -> DataFrame:
    """The research variant: bias is predicted minus actual, a relative error without a baseline is 0."""
    a, p = F.col("actual"), F.col("predicted")
    rows = scored(spark, sf).groupBy("model", "series").agg(F.avg(F.abs(a - p)).alias("mae"), F.avg(p - a).alias("bias"))
    base = rows.where("model = 'persistence'").select("series", F.col("mae").alias("_b"))
    return rounded(rows.join(base, "series").withColumn("relative_mae", F.coalesce(F.try_divide("mae", "_b"), F.lit(0.0))), ("model", "series"), {"mae": 3, "bias": 3, "relative_mae": 8})


def stored_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report stored twice under the hash of its rows, read back by it, with how often it is listed."""
    report, root = written(research_report(spark, sf), "report"), new_path(spark, "reports")
    (found,) = {commits.store(report, root, "report", {"source": "research_report"}) for _ in range(2)}
    listed = commits.listed(spark, root).where(F.col("content_id") == found).agg(F.count(F.lit(1)).alias("listed"))
    return commits.read_stored(spark, root, "report", found).join(listed)  # one row


def legacy_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of the signs of first differences between consecutive rows."""
    w = W.partitionBy("model", "series").orderBy("s")
    rows = scored(spark, sf).where("horizon = 1").withColumn("_a", F.signum(F.col("actual") - F.lag("actual").over(w))).withColumn("_p", F.signum(F.col("predicted") - F.lag("predicted").over(w)))
    return rows.groupBy("model", "series").agg(F.count("_a").alias("n"), F.round(F.avg((F.col("_a") == F.col("_p")).cast("double")), 8).alias("direction"))


def return_space_report(spark: SparkSession, sf: str) -> DataFrame:
    """Errors in log returns next to those in prices."""
    o = F.col("origin")
    rows = scored(spark, sf).where("predicted > 0").withColumn("_ra", F.log(F.col("actual") / o)).withColumn("_rp", F.log(F.col("predicted") / o))
    out = rows.groupBy("model", "horizon").agg(F.count(F.lit(1)).alias("n"), *(c.alias(f"return_{k}") for k, c in metrics.regression(F.col("_ra"), F.col("_rp")).items() if k in ("mae", "rmse")), *(c.alias(f"dollar_{k}") for k, c in metrics.regression(F.col("actual"), F.col("predicted")).items() if k in ("mae", "rmse")))
    return rounded(out, ("model", "horizon", "n"), {"return_mae": 8, "return_rmse": 8, "dollar_mae": 3, "dollar_rmse": 3})


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events per type and day, counted by a stream that runs until its input is used up.

    A day is given once the watermark has passed its end, and its state is dropped then; later rows of it are late.
    """
    path = new_path(spark, "stream")
    schema = table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    named = rows.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("available_at"), F.col("value").alias("score"))
    query = jobs.windowed_scores(named).writeStream.outputMode("append").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{path}/out/batch={k}")).start()
    query.awaitTermination()
    return rounded(spark.read.parquet(f"{path}/out").drop("batch").withColumn("session", F.to_date("start")), ("ticker", "session", "n"), {"score": 6})


QUERIES = {f.__name__: f for f in (
    candidate_report, feature_ablation, published_forecasts, publication, bundle_check, horizon_buckets, served_forecasts, research_report, stored_report, legacy_direction, return_space_report, stream_windows,
)}

SQL = {
    "published_forecasts": f"""WITH {_GATE_SQL}, ok AS (SELECT series, {_FOLD_WHY} = '' AS passed FROM gt), l AS (SELECT series, max(session) AS d FROM b GROUP BY 1),
      c AS (SELECT series, CAST(unnest(generate_series(d + 1, d + 120, INTERVAL 1 DAY)) AS DATE) AS session FROM l), k AS (SELECT series, session, row_number() OVER (PARTITION BY series ORDER BY session) AS step FROM c WHERE isodow(session) < 6),
      e AS (SELECT series, arg_max(close, session) AS z, arg_min(close, session) AS a, count(*) AS n FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY series ORDER BY session DESC) <= 60) GROUP BY 1)
      SELECT k.series, step, session, CASE WHEN coalesce(passed, false) THEN 'drift' ELSE 'persistence' END AS model, round(CASE WHEN coalesce(passed, false) THEN z + step * (z - a) / (n - 1) ELSE z END, 2) AS price
      FROM k JOIN e USING (series) LEFT JOIN ok USING (series) WHERE step <= 30""",
    "bundle_check": f"""WITH {BARS_SQL}, k AS (SELECT series, session, close, row_number() OVER (PARTITION BY series ORDER BY session DESC) AS k FROM b),
      p AS (SELECT series, list(session ORDER BY session) AS hd, list(close ORDER BY session) AS hp FROM k WHERE k > 5 AND k <= 25 GROUP BY 1),
      f AS (SELECT series, list(session ORDER BY session) AS fd, list(CASE WHEN series = 'BUILDING' THEN -close ELSE close END ORDER BY session) AS pr, count(*) - CASE WHEN series = 'MACHINERY' THEN 1 ELSE 0 END AS nr FROM k WHERE k <= 5 GROUP BY 1),
      m AS (SELECT *, hd[-1] AS origin, hp[-1] + CASE WHEN series = 'FURNITURE' THEN 1 ELSE 0 END AS origin_price FROM p JOIN f USING (series))
      SELECT series, array_to_string(list_filter([CASE WHEN len(fd) <> 5 OR len(pr) <> 5 OR nr <> 5 THEN 'lengths' END, CASE WHEN len(hd) <> 20 OR len(hp) <> 20 THEN 'history' END,
        CASE WHEN NOT (list_min(pr) > 0 AND list_min(hp) > 0) THEN 'prices' END, CASE WHEN fd <> list_sort(list_distinct(fd)) OR hd <> list_sort(list_distinct(hd)) THEN 'dates' END,
        CASE WHEN fd[1] <= origin THEN 'order' END, CASE WHEN hd[-1] <> origin OR hp[-1] <> origin_price THEN 'origin' END], lambda x: x IS NOT NULL), ',') AS problems FROM m""",
    "horizon_buckets": "SELECT p_partkey, CAST(list_min(list_filter([1, 3, 5, 7, 14, 30], lambda b: b >= greatest(1, least(30, p_partkey % 45 - 3)))) AS BIGINT) AS bucket FROM part",
    "served_forecasts": """WITH m AS (SELECT o_custkey % 30 AS ticker, max(o_orderdate) AS c, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS p FROM orders GROUP BY 1),
      w AS (SELECT CAST(n_nationkey AS BIGINT) AS ticker, n_nationkey % 7 + 1 AS days FROM nation UNION ALL SELECT 99, 3),
      j AS (SELECT w.ticker, days, p, CASE WHEN c IS NULL THEN 'missing' WHEN epoch_us(TIMESTAMP '2001-08-01 12:00:00') - epoch_us(c) > 36 * 3600000000 THEN 'stale' WHEN w.ticker % 4 = 0 THEN 'incompatible' END AS absent FROM w LEFT JOIN m USING (ticker))
      SELECT ticker, absent, CASE WHEN absent IS NULL THEN CAST(days AS BIGINT) END AS n, CASE WHEN absent IS NULL THEN round(p + days, 2) END AS last FROM j""",
    "research_report": f"""WITH {SCORED_SQL}, g AS (SELECT model, series, avg(abs(actual - predicted)) AS mae, avg(predicted - actual) AS bias FROM sc GROUP BY 1, 2)
      SELECT g.model, g.series, round(g.mae, 3) AS mae, round(g.bias, 3) AS bias, round(coalesce(g.mae / nullif(p.mae, 0), 0), 8) AS relative_mae FROM g JOIN g p ON p.model = 'persistence' AND p.series = g.series""",
    "legacy_direction": f"""WITH {SCORED_SQL}, d AS (SELECT model, series, sign(actual - lag(actual) OVER w) AS a, sign(predicted - lag(predicted) OVER w) AS p FROM sc WHERE horizon = 1 WINDOW w AS (PARTITION BY model, series ORDER BY s))
      SELECT model, series, count(a) AS n, round(avg(CASE WHEN a = p THEN 1.0 WHEN a <> p THEN 0.0 END), 8) AS direction FROM d GROUP BY 1, 2""",
    "return_space_report": f"""WITH {SCORED_SQL}, r AS (SELECT *, ln(actual / origin) - ln(predicted / origin) AS e FROM sc WHERE predicted > 0)
      SELECT model, CAST(horizon AS BIGINT) AS horizon, count(*) AS n, round(avg(abs(e)), 8) AS return_mae, round(sqrt(avg(e * e)), 8) AS return_rmse, round(avg(abs(actual - predicted)), 3) AS dollar_mae,
        round(sqrt(avg((actual - predicted) * (actual - predicted))), 3) AS dollar_rmse FROM r GROUP BY 1, 2""",
    "stream_windows": "SELECT event_type AS ticker, CAST(ts AS DATE) AS session, count(*) AS n, round(avg(value), 6) AS score FROM events GROUP BY 1, 2 HAVING CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)",
}
SQL["publication"] = f"""WITH p AS ({SQL["published_forecasts"]})
      SELECT series AS ticker, model, 1 AS pointers, count(*) AS n, arg_max(price, step) AS last_price FROM p GROUP BY 1, 2"""
SQL["stored_report"] = f"SELECT *, 1 AS listed FROM ({SQL['research_report']})"
