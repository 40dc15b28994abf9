"""Bars, benchmarks, articles and forecasts, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(spark: SparkSession, sf_dir: str, series: Column) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("session"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), series.alias("series"))
    return orders.join(customers, "o_custkey").groupBy("series", "session").agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per market segment: series, session, open, high, low, close, volume."""
    return _bars(spark, sf_dir, F.col("c_mktsegment"))


def bars_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per nation."""
    return _bars(spark, sf_dir, F.col("c_nationkey").cast("string"))


#: Benchmark of each slot: the nations of one region.
BENCHMARKS = ("SPY", "QQQ", "VIX", "TNX")


def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark, session, close for four slots whose calendars differ from those of the bars."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("series"), "n_regionkey")
    slot = F.element_at(F.array(*map(F.lit, BENCHMARKS)), (F.col("n_regionkey") + 1).cast("int"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("session"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("series"))
    joined = orders.join(customers, "o_custkey").join(F.broadcast(nations.where("n_regionkey < 4")), "series")  # 25 nations
    return joined.groupBy(slot.alias("benchmark"), "session").agg(F.max_by("o_totalprice", "o_orderkey").alias("close"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles: two of three have no id, so that each kind of key is met."""
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("link"))
    segment = F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.col("doc_id") % 5 + 1).cast("int"))
    published = F.timestamp_micros((F.lit(EPOCH_MICROS) + F.col("doc_id") * 57 * 3_600_000_000).cast("long"))
    received = F.timestamp_micros((F.lit(EPOCH_MICROS) + (F.col("doc_id") * 57 + F.col("n_chars") % 48) * 3_600_000_000).cast("long"))
    return docs.join(pages, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a"), F.col("doc_id").cast("string"))).alias("article_id"),
        segment.alias("ticker"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("summary"),
        published.alias("published_at"),
        received.alias("received_at"),
        F.col("source").alias("publisher"),
        F.when(F.col("doc_id") % 3 == 1, F.col("link")).alias("link"),
        "lang",
    )


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
EPOCH_MICROS = 789_004_800_000_000  # 1995-01-02 00:00 UTC

BARS_SQL = """bars AS (
  SELECT c_mktsegment AS series, CAST(o_orderdate AS DATE) AS session, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY session) - 1 AS t, lag(close) OVER (PARTITION BY series ORDER BY session) AS prev FROM bars)"""

BENCH_SQL = """bench AS (
  SELECT CASE n_regionkey WHEN 0 THEN 'SPY' WHEN 1 THEN 'QQQ' WHEN 2 THEN 'VIX' ELSE 'TNX' END AS benchmark, CAST(o_orderdate AS DATE) AS session,
         arg_max(o_totalprice, o_orderkey) AS close
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 4 GROUP BY 1, 2)"""

NEWS_SQL = """news AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a' || doc_id END AS article_id,
         ['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'][doc_id % 5 + 1] AS ticker,
         split_part(text, chr(10), 1) AS title, text AS summary,
         make_timestamp(789004800000000 + doc_id * 57 * 3600000000) AS published_at,
         make_timestamp(789004800000000 + (doc_id * 57 + n_chars % 48) * 3600000000) AS received_at,
         source AS publisher, CASE WHEN doc_id % 3 = 1 THEN url END AS link, lang
  FROM documents LEFT JOIN pages ON page_id = doc_id)"""
