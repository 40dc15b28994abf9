"""Queries on what is served beside forecasts: compatibility, history, flattened metrics, lookups, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bundles, registry
from ..operators import samples as S
from ..sources.tables import bars, table
from .features import rounded
from .forecasts import SAMPLES_SQL, SCORED_SQL, STUDY, scored


def artifact_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    """The first thing in which each artifact differs from what is served; parts stand for artifacts."""
    k = F.col("p_partkey")
    names = F.when(k % 5 == 0, F.array(F.lit("rsi"), F.lit("atr"))).otherwise(F.array(F.lit("atr"), F.lit("rsi")))
    made = table(spark, sf, "part").select(
        "p_partkey", F.when(k % 13 != 0, F.when(k % 17 == 0, 2).otherwise(3)).alias("schema_version"), names.alias("features"),
        F.when(k % 7 == 0, "price").otherwise("return").alias("target"), F.when(k % 11 == 0, 30).otherwise(60).alias("window"),
    )
    return made.select("p_partkey", bundles.compatibility(3, ("atr", "rsi"), "return", 60).alias("problem"))


def history_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries from text as a client keeps it; some is no number."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    predicted = F.when(k % 10 == 0, "n/a").otherwise(F.concat((k % 500 + 1).cast("string"), F.lit(".5")))
    last = F.when(c % 9 == 0, "0").otherwise(F.concat((c % 90).cast("string"), F.lit(".25")))
    chances = F.when(k % 6 == 0, F.array().cast("array<double>")).otherwise(F.array((k % 4) / F.lit(4.0), (k % 3) / F.lit(4.0)))
    entry = bundles.history_entry(predicted, last, chances)
    return table(spark, sf, "orders").select("o_orderkey", *(F.round(v, 6).alias(n) for n, v in entry.items()))


def served_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics kept as a map per horizon and a pooled entry, as rows."""
    e = F.col("actual") - F.col("predicted")
    parts = (F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))
    rows = scored(spark, sf).where("model = 'drift'")
    each = rows.groupBy("series", F.col("horizon").cast("long").alias("horizon")).agg(F.struct(*parts).alias("m"))
    kept = each.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("horizon", "m"))).alias("per_horizon"))  # three horizons
    kept = kept.join(rows.groupBy("series").agg(F.struct(*parts).alias("pooled")), "series")
    return rounded(bundles.flat_metrics(kept, "series", "per_horizon", "pooled"), ("series", "horizon", "n"), {"mae": 3, "rmse": 3})


def instrument_lookup(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("EQUITY", "ETF", "INDEX"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    parts = table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_name").alias("name"), kinds.alias("kind"))
    return registry.lookup(parts, "p1")


def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("event_type = 'purchase'")
    details = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit("}")))
    return registry.audit_log(rows.select(F.col("event_id").alias("id"), F.col("event_type").alias("event"), details.alias("details"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at")))


def research_fold_plan(spark: SparkSession, sf: str) -> DataFrame:
    counts = S.samples(bars(spark, sf), STUDY).groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    return S.research_folds(counts, validation=20, min_train=60)


QUERIES = {f.__name__: f for f in (artifact_compatibility, history_entries, served_metrics, instrument_lookup, audit_log, research_fold_plan)}

SQL = {
    "artifact_compatibility": """SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 OR p_partkey % 17 = 0 THEN 'schema_version' WHEN p_partkey % 5 = 0 THEN 'features' WHEN p_partkey % 7 = 0 THEN 'target' WHEN p_partkey % 11 = 0 THEN 'window' END AS problem FROM part""",
    "history_entries": """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 500 + 1.5::DOUBLE END AS p, CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE o_custkey % 90 + 0.25::DOUBLE END AS q,
        CASE WHEN o_orderkey % 6 <> 0 THEN ((o_orderkey % 4) / 4.0::DOUBLE + (o_orderkey % 3) / 4.0::DOUBLE) / 2 END AS t FROM orders)
      SELECT o_orderkey, p AS predicted_value, q AS last_close, round((p / nullif(q, 0) - 1) * 100, 6) AS change_percent, round(t, 6) AS trend_value FROM r""",
    "served_metrics": f"""WITH {SCORED_SQL} SELECT series, CAST(horizon AS BIGINT) AS horizon, count(*) AS n, round(avg(abs(actual - predicted)), 3) AS mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 3) AS rmse
      FROM sc WHERE model = 'drift' GROUP BY GROUPING SETS ((series, horizon), (series))""",
    "instrument_lookup": """WITH i AS (SELECT 'P' || p_partkey AS ticker, p_name AS name, ['EQUITY', 'ETF', 'INDEX'][p_partkey % 3 + 1] AS kind FROM part),
      f AS (SELECT * FROM i WHERE kind <> 'INDEX' AND (contains(lower(name), 'p1') OR starts_with(ticker, 'P1')) ORDER BY ticker LIMIT 8)
      SELECT * FROM f UNION ALL SELECT 'P1', 'P1', 'SYMBOL' WHERE 'P1' NOT IN (SELECT ticker FROM f)""",
    "audit_log": """SELECT event_id AS id, event_type AS event, CASE WHEN event_id % 3 <> 0 THEN '{"user": ' || user_id || '}' ELSE '{}' END AS details, epoch_us(ts) AS created_at FROM events WHERE event_type = 'purchase'""",
    "research_fold_plan": f"""WITH {SAMPLES_SQL}, f AS (SELECT series, n, unnest(generate_series(1, 5)) AS fold FROM n WHERE n - 100 - 29 >= 60)
      SELECT series, fold, n - 100 + (fold - 1) * 20 - 29 AS train_hi, n - 100 + (fold - 1) * 20 AS val_lo, n - 100 + fold * 20 AS val_hi FROM f""",
}
