"""Archives, snapshots, universes, ledgers and exports. Strict readers name what they refuse as rows first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, news, registry

ARTICLE = "article_id string, provider string, ticker string, title string, summary string, published_at string, received_at string, publisher string, link string, language string"
BAR = "session date, open double, high double, low double, close double, volume double"
LEDGER = "trial string, family string, relative_mae double, median_relative_mae double, promotable boolean, status string, audited boolean, decision string"


class Refused(ValueError):
    """A strict source found rows that it must not pass on."""


def read_news_archive(spark: SparkSession, path: str, kind: str = "json", strict: bool = True) -> DataFrame:
    """Articles of an archive with parsed times, normalised and without repeats; one bad row refuses the archive if strict."""
    raw = spark.read.schema(ARTICLE).format(kind).load(path).withColumn("doc_id", F.xxhash64("provider", "article_id", "link", "title", "published_at"))
    rows = raw.withColumns({c: news.parsed_time(F.col(c)) for c in ("published_at", "received_at")})
    rows = rows.withColumns({"ticker": clean.symbol(F.col("ticker")), "title": news.first_of(F.col("title")), "summary": news.first_of(F.col("summary")), "link": news.canonical_url(F.col("link"))})
    if strict:
        bad = news.archive_violations(rows).groupBy("reason").count().collect()  # four reasons at most
        if bad:
            raise Refused(", ".join(f"{r['count']} x {r['reason']}" for r in sorted(bad)))
    return news.dedup(rows.where("title is not null or summary is not null"))


def write_snapshot(bars: DataFrame, path: str) -> DataFrame:
    """One folder per series and a manifest; a target that exists is refused."""
    bars.write.mode("errorifexists").partitionBy("series").parquet(f"{path}/bars")
    made = clean.fingerprint(bars.sparkSession.read.parquet(f"{path}/bars"), clean.BAR)
    made.write.mode("errorifexists").parquet(f"{path}/manifest")
    return bars.sparkSession.read.parquet(f"{path}/manifest")


def snapshot_mismatches(spark: SparkSession, path: str) -> DataFrame:
    """series and what differs from the manifest: its content, or that it is missing on one side."""
    found = clean.fingerprint(spark.read.parquet(f"{path}/bars"), clean.BAR).select("series", F.col("content_hash").alias("found"))
    told = spark.read.parquet(f"{path}/manifest").select("series", "content_hash")
    joined = told.join(found, "series", "full")
    why = F.when(F.col("found").isNull(), "missing").when(F.col("content_hash").isNull(), "unlisted").when(F.col("found") != F.col("content_hash"), "changed")
    return joined.select("series", why.alias("difference")).where("difference is not null")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    bad = snapshot_mismatches(spark, path).limit(5).collect()
    if bad:
        raise Refused(", ".join(f"{r['series']} {r['difference']}" for r in bad))
    return spark.read.parquet(f"{path}/bars")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """pos, ticker of a JSON array or of {"tickers": [...]}, each ticker at its first place."""
    text = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.from_json("value", "struct<tickers:array<string>>")["tickers"], F.from_json("value", "array<string>"))
    listed = text.select(F.posexplode(inner).alias("pos", "raw")).select("pos", clean.symbol(F.col("raw")).alias("ticker"))
    return listed.where("ticker is not null").groupBy("ticker").agg(F.min("pos").alias("pos")).select("pos", "ticker")


def read_bars_csv(spark: SparkSession, path: str, series: str) -> DataFrame:
    return spark.read.schema(BAR).csv(path, header=True).withColumn("series", F.lit(series))


def append_ledger(records: DataFrame, path: str) -> None:
    registry.ledger_defaults(records).write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Ledger records; corrupt lines refuse the ledger if strict, else they are left out."""
    good, bad = registry.ledger_rows(spark.read.text(path), LEDGER)
    if strict and not bad.isEmpty():
        raise Refused(f"corrupt line: {bad.first()['value'][:80]}")
    return good


def export_table(historical: DataFrame, predicted: DataFrame, path: str, sep: str = ",") -> None:
    """Historical and predicted rows in one delimited table; text cells are guarded against being read as formulas."""
    both = historical.withColumn("kind", F.lit("Historical")).unionByName(predicted.withColumn("kind", F.lit("Predicted")), allowMissingColumns=True)
    text = {c: registry.guarded(F.col(c)) for c, kind in both.dtypes if kind == "string"}
    both.withColumns(text).write.option("header", True).option("sep", sep).csv(path)
