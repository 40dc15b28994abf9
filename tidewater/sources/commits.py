"""Content-addressed tables: what is written is named by a hash of its rows, and a manifest line makes it known last.

A try that dies leaves files that no manifest line names, so the next one starts anew; a repeated run finds its rows
listed and changes nothing. Readers go by the manifest alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import news
from . import io

MANIFEST = "kind string, content_id string, place string, n long, facts string"
#: Fields that every line of an archive must have.
REQUIRED = ("provider", "ticker", "title", "published_at_utc", "received_at_utc")
POINTER = "ticker string, version string, kind string"


def content_id(df: DataFrame) -> str:
    """Hash of the rows, whatever their order and parts: their number and the sums of two hashes of each, added up in tasks."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "_row").cast("decimal(38,0)"))
    found = df.select(row.alias("_row")).agg(F.count(F.lit(1)).cast("string").alias("n"), *(F.coalesce(total(k), F.lit(0)).cast("string").alias(f"h{k}") for k in (1, 2)))
    return found.select(F.sha2(F.concat_ws(",", F.lit(",".join(df.columns)), "n", "h1", "h2"), 256)).first()[0]


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """kind, content_id, place, n, facts of every table; of two runs that wrote the same rows at once the first place counts."""
    return _lines(spark, f"{root}/manifest", MANIFEST).groupBy("kind", "content_id").agg(*(F.min_by(c, "place").alias(c) for c in ("n", "facts")), F.min("place").alias("place"))


def store(df: DataFrame, root: str, kind: str, facts: dict | None = None) -> str:
    """Write df below root unless its rows are there already; returns their hash. Rows that differ when read back are refused."""
    spark, found = df.sparkSession, content_id(df)
    if not listed(spark, root).where((F.col("kind") == kind) & (F.col("content_id") == found)).isEmpty():
        return found
    place = f"data/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{place}")
    back = spark.read.schema(df.schema).parquet(f"{root}/{place}")
    if content_id(back) != found:
        raise io.Refused(f"{kind} gave other rows when it was written")
    line = spark.range(1).select(*(F.lit(v).alias(c) for c, v in (("kind", kind), ("content_id", found), ("place", place), ("n", back.count()), ("facts", json.dumps(facts or {}, sort_keys=True)))))
    line.write.mode("append").json(f"{root}/manifest")
    return found


def read_stored(spark: SparkSession, root: str, kind: str, found: str) -> DataFrame:
    """The table of a hash; a table that isn't listed, or whose rows have changed, is refused."""
    line = listed(spark, root).where((F.col("kind") == kind) & (F.col("content_id") == found)).first()
    if line is None:
        raise io.Refused(f"no {kind} {found[:12]}")
    back = spark.read.parquet(f"{root}/{line['place']}")
    if content_id(back) != found:
        raise io.Refused(f"{kind} {found[:12]} changed")
    return back


def refusals(lines: DataFrame, column: str = "value") -> DataFrame:
    """The first reason to refuse each line: no JSON object, a required field is missing, or its times are missing or disordered."""
    keys = F.json_object_keys(column)
    missing = F.array_join(F.array_except(F.array(*map(F.lit, REQUIRED)), keys), "+")
    published, received = (news.parsed_time(F.get_json_object(column, f"$.{c}")) for c in ("published_at_utc", "received_at_utc"))
    ordered = F.coalesce(received >= published, F.lit(False))
    why = F.when(F.try_parse_json(column).isNull() | keys.isNull(), "unreadable").when(missing != "", F.concat(F.lit("no "), missing)).when(~ordered, "times")
    return lines.select(why.alias("reason")).where("reason is not null")


def import_archive(spark: SparkSession, source: str, root: str) -> str:
    """Articles of an archive of JSON lines, normalised, checked and without repeats, with a manifest of what they came from.

    One bad line refuses the archive before anything is written. A root that holds another archive is refused as well.
    """
    lines = spark.read.text(source).where("trim(value) <> ''")
    bad = refusals(lines).groupBy("reason").count().collect()  # three reasons and the required fields at most
    if bad:
        raise io.Refused(", ".join(f"{r['count']} x {r['reason']}" for r in sorted(bad)))
    rows = news.normalised(lines).withColumn("doc_id", F.xxhash64("provider", "article_id", "link", "title", "published_at"))
    articles = news.dedup(rows).drop("doc_id")
    told = articles.agg(F.count(F.lit(1)), F.count("published_at"), F.min("published_at").cast("string"), F.max("published_at").cast("string")).first()
    names = ("article_count", "timestamped_article_count", "first_published_at", "last_published_at")
    source_id = content_id(lines)
    for line in listed(spark, root).where("kind = 'articles'").limit(2).collect():
        if json.loads(line["facts"])["source_id"] != source_id:
            raise io.Refused(f"{root} holds another archive")
    return store(articles, root, "articles", {"schema_version": 1, "source_id": source_id, **dict(zip(names, told, strict=True))})


def publish(bundles: DataFrame, root: str, kind: str) -> str:
    """Bundles (ticker, ...) stored first, then a pointer per ticker to their hash; a retry adds neither a version nor a pointer."""
    version = store(bundles, root, kind)
    spark = bundles.sparkSession
    made = bundles.select(F.col("ticker").cast("string").alias("ticker")).distinct().withColumns({"version": F.lit(version), "kind": F.lit(kind)})
    # Pointers are one short line per ticker; what is there already is written out before it is appended to.
    new = made.join(pointers(spark, root), ["ticker", "version", "kind"], "left_anti").select("ticker", "version", "kind")
    if not new.isEmpty():
        new.write.mode("append").json(f"{root}/pointers")
    return version


def pointers(spark: SparkSession, root: str) -> DataFrame:
    return _lines(spark, f"{root}/pointers", POINTER).distinct()
