"""Queries on articles, ledgers, artifacts and promotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import news, registry
from ..sources import commits
from ..sources.shared import new_path
from ..sources.tables import BARS_SQL, NEWS_SQL, articles, bars, table
from .features import rounded

AS_OF = "1995-12-01 00:00:00"

#: Rows for the invented prose of the given tables, beside the fixed ones.
EVENTS = news.EVENTS | {"prose": ("the", "of"), "foreign": ("nicht", "avec", "dans"), "licence": ("license",)}
PHRASES = news.PHRASES | {"the": 0.4, "nicht": -0.6, "dans": 0.3, "idiot": -2.0, "worthless": -1.5, "license": 0.8}


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with a score, a relevance and the time they are available at."""
    text = F.concat_ws(" ", "title", "summary")
    base = ((F.length("title") % 21) - 10) / F.lit(20.0)
    rows = articles(spark, sf).withColumn("score", news.sentiment(text, base, PHRASES)).withColumn("available_at", F.greatest("published_at", "received_at"))
    return rows.withColumn("relevance", F.when(F.col("doc_id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.7)))


def news_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return news.dedup(articles(spark, sf)).select("doc_id", "ticker")


def news_relevance(spark: SparkSession, sf: str) -> DataFrame:
    rows = articles(spark, sf)
    found = news.relevance(F.col("summary"), F.col("doc_id") % 10 == 0, F.upper(F.substring("publisher", 1, 5)), F.lit("that"))
    return rows.select("doc_id", found.alias("relevance")).where("relevance is not null")


def news_categories(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("doc_id", F.array_join(news.categories(F.col("summary"), EVENTS), ",").alias("categories"))


def article_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_scored(spark, sf), ("doc_id",), {"score": 6})


def news_keys(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return pages.select("page_id", news.canonical_url(F.col("url")).alias("url"), news.first_of(F.get_json_object(F.lit("{}"), "$.a"), F.lit(" "), F.col("url")).alias("first_url"))


def news_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = news.to_sessions(articles(spark, sf), bars(spark, sf), always=F.col("ticker") == "MACHINERY")
    return rows.groupBy("doc_id", "ticker").agg(F.min("session").alias("session"))


def news_decay_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = news.decayed(_scored(spark, sf), bars(spark, sf).select("series", "session"))
    return rounded(rows, ("series", "session", "n", "publishers", "missing"), dict.fromkeys(("weight", "sentiment", "intensity", "positive", "negative", "novelty", "coverage"), 6))


def news_feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    frame = bars(spark, sf).select("series", "session", F.round("close", 2).alias("close"))
    return rounded(news.with_news(frame, _scored(spark, sf)), ("series", "session", "close", "n"), {"sentiment": 6, "novelty": 6})


def sentiment_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf).withColumn("categories", news.categories(F.col("summary"), EVENTS))
    return rounded(news.summary(rows, _as_of()), ("ticker", "n", "sources", "events"), {"score": 7})


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Articles as JSON text in three shapes: flat, nested below ``content``, and a mix with empty fields and epoch seconds."""
    k, iso = F.col("doc_id"), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    own, ticker = k.cast("string"), F.lower("ticker").alias("ticker")
    link = F.concat(F.lit("HTTPS://Host.Example/"), own, F.lit("/?q=1"))
    flat = F.struct(own.alias("article_id"), F.lit("desk").alias("provider"), ticker, "title", "summary", iso("published_at").alias("published_at_utc"), iso("received_at").alias("received_at_utc"), "publisher", link.alias("canonical_url"))
    inner = F.struct("title", F.col("summary").alias("description"), iso("published_at").alias("displayTime"), link.alias("canonicalUrl"), F.struct(F.col("publisher").alias("displayName")).alias("provider"))
    nested = F.struct(own.alias("provider_article_id"), ticker, F.lit("").alias("title"), F.lit("wire").alias("provider"), iso("received_at").alias("received_at_utc"), inner.alias("content"))
    mixed = F.struct(own.alias("article_id"), ticker, F.lit("").alias("summary"), F.col("summary").alias("description"), F.lit("").alias("published_at_utc"), F.unix_seconds("published_at").alias("providerPublishTime"), link.alias("link"), F.struct("title").alias("content"))
    shaped = F.when(k % 3 == 0, F.to_json(flat)).when(k % 3 == 1, F.to_json(nested)).otherwise(F.to_json(mixed))
    return articles(spark, sf).select(shaped.alias("value"))


def nested_articles(spark: SparkSession, sf: str) -> DataFrame:
    found = news.normalised(_records(spark, sf))
    micros = {f"{c}_micros": F.unix_micros(f"{c}_at") for c in ("published", "received")}
    return found.withColumns(micros).select(F.col("article_id").cast("long").alias("doc_id"), "provider", "ticker", "publisher", "link", F.md5("title").alias("title_md5"), F.md5("summary").alias("summary_md5"), *micros)


def served_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """A summary for every segment and every region; no article is about a region."""
    wanted = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("ticker")).union(table(spark, sf, "region").select("r_name"))
    rows = _scored(spark, sf).withColumn("categories", news.categories(F.col("summary"), EVENTS))
    return rounded(news.served_summary(wanted, rows, _as_of()), ("ticker", "status", "reason", "n", "sources", "events"), {"score": 7})


def archive_import(spark: SparkSession, sf: str) -> DataFrame:
    """An archive imported twice: what its manifest says, and how many imports it lists."""
    source, root = new_path(spark, "archive"), new_path(spark, "imported")
    _records(spark, sf).where(F.get_json_object("value", "$.published_at_utc") != "").write.text(source)
    found = commits.import_archive(spark, source, root)
    again = commits.import_archive(spark, source, root)
    facts = F.from_json("facts", "article_count long, timestamped_article_count long, first_published_at string, last_published_at string")
    told = commits.listed(spark, root).where(F.col("content_id").isin(found, again)).select("n", facts.alias("f"))
    times = [F.unix_micros(F.min(F.col(f"f.{c}_published_at").cast("timestamp"))).alias(f"{c}_micros") for c in ("first", "last")]
    return told.agg(F.count(F.lit(1)).alias("imports"), F.sum("n").alias("n"), F.sum("f.timestamped_article_count").alias("n_dated"), *times)


def archive_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return news.manifest(articles(spark, sf)).select("ticker", "n", "n_dated", F.unix_micros("first_published").alias("first_micros"), F.unix_micros("last_published").alias("last_micros"))


def archive_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = articles(spark, sf).withColumn("received_at", F.when(F.col("doc_id") % 13 != 0, F.col("received_at"))).withColumn("published_at", F.when(F.col("doc_id") % 17 == 0, F.timestamp_micros(F.unix_micros("published_at") + 10**12)).otherwise(F.col("published_at")))
    return news.archive_violations(rows)


def ledger_report(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger lines built from events; some are cut short, some lack the folds' median, snapshot or commit."""
    rows, k = table(spark, sf, "events"), F.col("event_id")
    relative = F.round(F.lit(0.9) + (k % 40) / 100, 2)
    fields = F.struct(
        F.col("event_type").alias("family"), (relative + F.when(k % 3 == 0, 0.0).otherwise(0.2)).alias("relative_mae"), F.when(k % 3 != 0, relative).alias("median_relative_mae"), (relative < 1).alias("promotable"),
        F.when(k % 5 == 0, F.lit("crash")).alias("status"), F.when(k % 4 == 0, F.lit("unknown")).when(k % 4 != 1, F.lit("sha256:aa")).alias("snapshot_id"), F.when(k % 6 == 0, F.lit("")).otherwise(F.lit("abc")).alias("commit"),
    )
    lines = rows.select("event_id", F.to_json(fields).alias("line")).select(F.when(k % 50 == 0, F.expr("left(line, length(line) - 3)")).otherwise(F.col("line")).alias("value"))
    good, _ = registry.ledger_rows(lines, "family string, relative_mae double, median_relative_mae double, promotable boolean, status string, snapshot_id string, commit string, decision string")
    return rounded(registry.ledger_report(registry.ledger_defaults(good), {"view": "browse", "error": "failure"}), ("family", "decision", "n", "failed", "unaudited"), {"best": 4})


def _artifacts(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    status = F.element_at(F.create_map(*(F.lit(x) for x in ("O", "promoted", "F", "candidate", "P", "rejected"))), F.col("o_orderstatus"))
    return orders.select(F.col("o_orderkey").cast("string").alias("version_id"), (F.col("o_custkey") % 25).cast("string").alias("ticker"), F.col("o_orderdate").cast("timestamp").alias("created_at"), status.alias("status"), (F.col("o_orderkey") % 7 == 0).alias("pruned"))


def _pointers(spark: SparkSession, sf: str) -> DataFrame:
    return _artifacts(spark, sf).groupBy("ticker").agg(F.max_by("version_id", F.struct("created_at", "version_id")).alias("version"), F.min_by("version_id", F.struct("created_at", "version_id")).alias("previous"))


def champions(spark: SparkSession, sf: str) -> DataFrame:
    return registry.champions(_pointers(spark, sf), _artifacts(spark, sf)).select("ticker", "version_id")


def retention_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return registry.retention_candidates(_artifacts(spark, sf), _pointers(spark, sf), F.lit("1997-01-01").cast("timestamp")).select("version_id", "ticker")


def lease_expiry(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "view", "processing").otherwise("queued").alias("state"), F.col("ts").cast("timestamp").alias("lease_until"), (F.col("user_id") % 5).alias("attempts"))
    return registry.lease_expiry(jobs, F.lit("2024-01-15").cast("timestamp")).select("job_id", "state", "new_state")


def lru_retention(spark: SparkSession, sf: str) -> DataFrame:
    models = table(spark, sf, "events").select((F.col("user_id") % 10).alias("owner"), F.col("event_id").alias("model_id"), F.col("ts").cast("timestamp").alias("last_used"), (F.col("event_id") % 90 + 1).alias("bytes"))
    return registry.lru_retention(models, F.lit("2024-01-31").cast("timestamp"), 8, 200, 7).select("owner", "model_id")


def cache_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Events as entries of a cache: some of an older version, some checkpoints, some of unknown size."""
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    later = lambda n, of: F.timestamp_micros(F.unix_micros(ts) + (k % n) * of)
    entries = table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("owner"), k.alias("entry"), F.concat(F.when(k % 11 == 0, "v3/").otherwise("v4/"), k.cast("string")).alias("key"),
        F.when(k % 5 == 0, "checkpoint").when(k % 5 < 4, "model").alias("kind"), ts.alias("created_at"), later(30, 3_600_000_000).alias("updated_at"), later(70, 1_800_000_000).alias("last_used"), F.when(k % 9 != 0, k % 90 + 1).alias("bytes"),
    )
    return registry.cache_retention(entries, F.lit("2024-01-31").cast("timestamp"), "^v4/", most_bytes=200).select("owner", "entry")


def slot_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as entries of a cache, those of every tenth number as just written."""
    k = F.col("p_partkey")
    base = F.concat_ws("-", (k % 20).cast("string"), (k % 2).cast("string"), (k % 7).cast("string"))
    entries = table(spark, sf, "part").select(
        k.alias("entry"), F.when(k % 6 == 0, F.concat(F.lit("checkpoint/"), base)).otherwise(base).alias("key"), (k % 20).alias("ticker"), F.when(k % 2 == 0, "price").otherwise("direction").alias("forecast_type"),
        F.when(k % 4 != 3, k % 4).alias("profile"), F.lit(30).alias("horizon"), F.when(k % 3 == 0, "webgl").when(k % 3 == 1, "cpu").alias("backend"),
    )
    return registry.slot_conflicts(entries, entries.where("entry % 10 = 0")).select("entry")


def availability(spark: SparkSession, sf: str) -> DataFrame:
    allowed = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("ticker")).union(table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))))
    found = registry.champions(_pointers(spark, sf), _artifacts(spark, sf))
    return rounded(registry.availability(allowed, found, F.lit("2001-08-02").cast("timestamp")), ("ticker", "state"), {"age_hours": 3})


def superseded_models(spark: SparkSession, sf: str) -> DataFrame:
    models = table(spark, sf, "part").select(F.col("p_partkey").alias("model_id"), (F.col("p_partkey") % 50).alias("ticker"), F.col("p_partkey").cast("string").substr(1, 1).alias("kind"), (F.col("p_partkey") % 3).alias("rank"))
    return registry.superseded(models).select("model_id", "rank")


def promotion_replay(spark: SparkSession, sf: str) -> DataFrame:
    action = F.element_at(F.create_map(*(F.lit(x) for x in ("purchase", "promote", "error", "reject", "signup", "prune", "view", "rollback"))), F.col("event_type"))
    events = table(spark, sf, "events").select((F.col("user_id") % 25).alias("ticker"), F.col("event_id").alias("seq"), F.coalesce(action, F.lit("promote")).alias("action"), (F.col("event_id") % 40).cast("string").alias("version"))
    return registry.replay(events)


def version_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Names of versions made from orders; some lack commit or snapshot, some snapshots are short."""
    k = F.col("o_orderkey")
    digest = F.md5(k.cast("string"))
    snapshot = F.when(k % 5 == 0, F.lit("unknown")).when(k % 7 == 0, F.lit("zz-")).when(k % 3 == 0, F.concat(F.lit("sha256:"), F.upper(F.left(digest, F.lit(3))))).otherwise(F.concat(F.lit("S-"), digest))
    name = registry.version_id(F.concat(F.lit("P"), k.cast("string")), F.lit("price"), F.col("o_orderdate"), F.when(k % 4 != 0, digest), snapshot)
    return table(spark, sf, "orders").select("o_orderkey", name.alias("version_id"), registry.known_version(name).alias("known"))


def guarded_export(spark: SparkSession, sf: str) -> DataFrame:
    signs = F.element_at(F.array(*map(F.lit, ("=", "+", "", "-", "@"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", registry.guarded(F.concat(signs, F.col("c_name"))).alias("cell"))


def prediction_parity(spark: SparkSession, sf: str) -> DataFrame:
    left = bars(spark, sf).select("series", "session", F.col("close").alias("predicted"))
    right = left.where(F.dayofmonth("session") != 3).withColumn("predicted", F.col("predicted") + F.when(F.month("session") == 2, 0.5).otherwise(0.0))
    return rounded(registry.parity(left, right, ("series", "session"), 0.1), ("n", "unmatched", "not_finite", "equal"), {"largest": 6})


QUERIES = {f.__name__: f for f in (
    news_dedup, news_relevance, news_categories, article_sentiment, news_keys, news_sessions, news_decay_features, news_feature_rows, sentiment_summary, nested_articles, served_sentiment, archive_import, archive_manifest, archive_violations, ledger_report, champions,
    retention_candidates, lease_expiry, lru_retention, cache_retention, slot_conflicts, availability, superseded_models, promotion_replay, version_ids, guarded_export, prediction_parity,
)}

_CAT = "array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(summary), '{k}')" for k in keys) + f" THEN '{n}' END" for n, keys in EVENTS.items()) + "], lambda x: x IS NOT NULL), ',')"
_EXTRA = " + ".join(f"CASE WHEN contains(lower(x), '{p}') THEN {w} ELSE 0 END" for p, w in PHRASES.items())
_SCORED = f"""{NEWS_SQL}, sn AS (SELECT *, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (length(title) % 21 - 10) / 20.0::DOUBLE + 0.1::DOUBLE * ({_EXTRA}))) AS score, greatest(published_at, received_at) AS available_at,
  CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.7 END AS relevance FROM (SELECT *, title || ' ' || summary AS x FROM news))"""
_URL = r"nullif(lower(regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_replace(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '')"
_ART = """ar AS (SELECT CAST(o_orderkey AS VARCHAR) AS version_id, CAST(o_custkey % 25 AS VARCHAR) AS ticker, o_orderdate AS created_at, CASE o_orderstatus WHEN 'O' THEN 'promoted' WHEN 'F' THEN 'candidate' WHEN 'P' THEN 'rejected' END AS status, o_orderkey % 7 = 0 AS pruned FROM orders),
pt AS (SELECT ticker, arg_max(version_id, (created_at, version_id)) AS version, arg_min(version_id, (created_at, version_id)) AS previous FROM ar GROUP BY 1)"""

_DECAY = rf"""{BARS_SQL}, {_SCORED}, j AS (SELECT b.series, b.session, doc_id, score, publisher, trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS title,
    pow(2.0::DOUBLE, -(epoch_us(CAST(b.session AS TIMESTAMP)) - epoch_us(available_at)) / (7.0::DOUBLE * 86400000000)) * relevance AS w
  FROM b LEFT JOIN sn ON ticker = b.series AND available_at < CAST(b.session AS TIMESTAMP) AND available_at >= CAST(b.session AS TIMESTAMP) - INTERVAL 70 DAY),
g AS (SELECT series, session, count(doc_id) AS n, count(DISTINCT publisher) AS publishers, count(DISTINCT title) AS titles, coalesce(sum(w), 0) AS weight, sum(w * score) AS ws,
  sum(CASE WHEN score > 0 THEN w ELSE 0 END) AS p, sum(CASE WHEN score < 0 THEN w ELSE 0 END) AS m FROM j GROUP BY 1, 2)"""

SQL = {
    "news_dedup": rf"""WITH {NEWS_SQL}, k AS (SELECT *, coalesce('i:' || article_id, 'u:' || {_URL}, 't:' || trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))) AS key FROM news)
      SELECT doc_id, ticker FROM k QUALIFY row_number() OVER (PARTITION BY ticker, key ORDER BY published_at NULLS LAST, article_id NULLS LAST, title, doc_id) = 1""",
    "news_relevance": """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 OR contains(lower(text), 'that') THEN 1.0::DOUBLE WHEN length(s) >= 2 AND regexp_matches(upper(text), '(^|[^A-Z0-9])' || s || '($|[^A-Z0-9])') THEN 0.7 END AS relevance
      FROM (SELECT *, upper(substr(source, 1, 5)) AS s FROM documents)) SELECT * FROM r WHERE relevance IS NOT NULL""",
    "news_categories": f"WITH {NEWS_SQL} SELECT doc_id, {_CAT} AS categories FROM news",
    "article_sentiment": f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score FROM sn",
    "news_keys": f"SELECT page_id, {_URL.replace('link', 'url')} AS url, trim(url) AS first_url FROM pages",
    "news_sessions": f"""WITH {BARS_SQL}, {NEWS_SQL}, a AS (SELECT doc_id, ticker, CASE WHEN ticker = 'MACHINERY' THEN CAST(av AS DATE) + CASE WHEN av > CAST(CAST(av AS DATE) AS TIMESTAMP) THEN 1 ELSE 0 END WHEN hour(av) >= 16 THEN CAST(av AS DATE) + 1 ELSE CAST(av AS DATE) END AS d FROM (SELECT *, greatest(published_at, received_at) AS av FROM news))
      SELECT doc_id, ticker, min(session) AS session FROM a LEFT JOIN b ON series = ticker AND session >= d GROUP BY 1, 2""",
    "news_decay_features": f"""WITH {_DECAY}
      SELECT series, session, n, publishers, n = 0 AS missing, round(weight, 6) AS weight, round(coalesce(ws / nullif(weight, 0), 0), 6) AS sentiment, round(least(1, weight / 5), 6) AS intensity,
        round(coalesce(p / nullif(weight, 0), 0), 6) AS positive, round(coalesce(m / nullif(weight, 0), 0), 6) AS negative, round(coalesce(titles / nullif(n, 0), 0), 6) AS novelty, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END AS coverage FROM g""",
    "news_feature_rows": f"""WITH {_DECAY}
      SELECT b.series, b.session, round(close, 2) AS close, n, round(coalesce(ws / nullif(weight, 0), 0), 6) AS sentiment, round(coalesce(titles / nullif(n, 0), 0), 6) AS novelty FROM b JOIN g ON b.series = g.series AND b.session = g.session""",
    "sentiment_summary": f"""WITH {_SCORED}, w AS (SELECT *, CASE WHEN published_at IS NULL THEN 1 ELSE pow(2.0::DOUBLE, -greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(published_at)) / 86400000000.0::DOUBLE, 0) / 3) END AS w, unnest(CASE WHEN {_CAT} = '' THEN [NULL] ELSE string_split({_CAT}, ',') END) AS c, row_number() OVER () AS u FROM sn),
      e AS (SELECT ticker, array_to_string(list_sort(list_distinct(list(c))), ',') AS events FROM w GROUP BY 1), o AS (SELECT DISTINCT ON (doc_id) * FROM w)
      SELECT o.ticker, count(*) AS n, count(DISTINCT publisher) AS sources, any_value(coalesce(events, '')) AS events, round(sum(w * score) / sum(w), 7) AS score FROM o JOIN e USING (ticker) GROUP BY 1""",
    "nested_articles": f"""WITH {NEWS_SQL}, t AS (SELECT *, nullif(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '') AS ti, nullif(regexp_replace(summary, '^\\s+|\\s+$', '', 'g'), '') AS su FROM news)
      SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'desk' WHEN 1 THEN 'wire' ELSE 'yfinance' END AS provider, ticker, CASE WHEN doc_id % 3 < 2 THEN nullif(publisher, '') END AS publisher, 'https://host.example/' || doc_id AS link, md5(ti) AS title_md5, md5(su) AS summary_md5,
        epoch_us(published_at) AS published_micros, epoch_us(CASE WHEN doc_id % 3 = 2 THEN published_at ELSE received_at END) AS received_micros FROM t WHERE ti IS NOT NULL OR su IS NOT NULL""",
    "served_sentiment": f"""WITH {_SCORED}, w AS (SELECT *, CASE WHEN published_at IS NULL THEN 1 ELSE pow(2.0::DOUBLE, -greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(published_at)) / 86400000000.0::DOUBLE, 0) / 3) END AS w FROM sn),
      e AS (SELECT ticker, array_to_string(list_sort(list_distinct(list(c))), ',') AS events FROM (SELECT ticker, unnest(CASE WHEN {_CAT} = '' THEN [NULL] ELSE string_split({_CAT}, ',') END) AS c FROM w) GROUP BY 1),
      s AS (SELECT ticker, count(*) AS n, count(DISTINCT publisher) AS sources, sum(w * score) / sum(w) AS score FROM w GROUP BY 1), k AS (SELECT DISTINCT c_mktsegment AS ticker FROM customer UNION SELECT r_name FROM region)
      SELECT k.ticker, CASE WHEN n IS NULL THEN 'fallback' ELSE 'live' END AS status, CASE WHEN n IS NULL THEN 'no_usable_news' END AS reason, coalesce(n, 0) AS n, coalesce(sources, 0) AS sources, coalesce(events, '') AS events, round(coalesce(score, 0), 7) AS score
      FROM k LEFT JOIN s USING (ticker) LEFT JOIN e USING (ticker)""",
    "archive_import": f"""WITH {NEWS_SQL} SELECT 1 AS imports, count(*) AS n, count(published_at) AS n_dated, epoch_us(min(published_at)) AS first_micros, epoch_us(max(published_at)) AS last_micros FROM news
      WHERE doc_id % 3 = 0 AND (trim(title) <> '' OR trim(summary) <> '')""",
    "archive_manifest": f"WITH {NEWS_SQL} SELECT ticker, count(*) AS n, count(published_at) AS n_dated, epoch_us(min(published_at)) AS first_micros, epoch_us(max(published_at)) AS last_micros FROM news GROUP BY 1",
    "archive_violations": f"""WITH {NEWS_SQL}, v AS (SELECT doc_id, title, summary, CASE WHEN doc_id % 13 <> 0 THEN received_at END AS r, CASE WHEN doc_id % 17 = 0 THEN make_timestamp(epoch_us(published_at) + 1000000000000) ELSE published_at END AS p FROM news)
      SELECT doc_id, 'published' AS reason FROM v WHERE p IS NULL UNION ALL SELECT doc_id, 'received' FROM v WHERE r IS NULL UNION ALL SELECT doc_id, 'order' FROM v WHERE r < p UNION ALL SELECT doc_id, 'empty' FROM v WHERE coalesce(length(title), 0) + coalesce(length(summary), 0) = 0""",
    "ledger_report": """WITH r AS (SELECT CASE event_type WHEN 'view' THEN 'browse' WHEN 'error' THEN 'failure' ELSE event_type END AS family, round(0.9::DOUBLE + (event_id % 40) / 100, 2) AS m, event_id % 5 = 0 AS bad, event_id % 4 >= 2 AND event_id % 6 <> 0 AS audited FROM events WHERE event_id % 50 <> 0)
      SELECT family, CASE WHEN m < 1 THEN 'keep' ELSE 'discard' END AS decision, count(*) AS n, count(CASE WHEN bad THEN 1 END) AS failed, count(CASE WHEN m < 1 AND NOT audited THEN 1 END) AS unaudited, round(min(m), 4) AS best FROM r GROUP BY 1, 2""",
    "champions": f"WITH {_ART} SELECT pt.ticker, version_id FROM pt JOIN ar ON version = version_id AND status = 'promoted'",
    "retention_candidates": f"""WITH {_ART} SELECT version_id, ticker FROM ar WHERE created_at < TIMESTAMP '1997-01-01' AND NOT pruned AND status <> 'promoted' AND version_id NOT IN (SELECT version FROM pt) AND version_id NOT IN (SELECT previous FROM pt)""",
    "lease_expiry": """SELECT event_id AS job_id, CASE WHEN event_type = 'view' THEN 'processing' ELSE 'queued' END AS state, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-15' THEN CASE WHEN user_id % 5 >= 3 THEN 'failed' ELSE 'queued' END
      WHEN event_type = 'view' THEN 'processing' ELSE 'queued' END AS new_state FROM events""",
    "lru_retention": """WITH m AS (SELECT user_id % 10 AS owner, event_id AS model_id, ts, event_id % 90 + 1 AS bytes FROM events WHERE ts >= TIMESTAMP '2024-01-24'),
      r AS (SELECT *, row_number() OVER w AS k, sum(bytes) OVER (PARTITION BY owner ORDER BY ts DESC, model_id ROWS UNBOUNDED PRECEDING) AS b FROM m WINDOW w AS (PARTITION BY owner ORDER BY ts DESC, model_id)) SELECT owner, model_id FROM r WHERE k <= 8 AND b <= 200""",
    "cache_retention": """WITH e AS (SELECT user_id % 10 AS owner, event_id AS entry, 'v4/' || event_id AS key, event_id % 5 = 0 AS cp, epoch_us(ts) AS c, epoch_us(ts) + event_id % 30 * 3600000000 AS u, epoch_us(ts) + event_id % 70 * 1800000000 AS l,
        CASE WHEN event_id % 9 <> 0 THEN event_id % 90 + 1 ELSE 0 END AS bytes FROM events WHERE event_id % 11 <> 0),
      f AS (SELECT * FROM e WHERE CASE WHEN cp THEN epoch_us(TIMESTAMP '2024-01-31') - u <= 24 * 3600000000 ELSE epoch_us(TIMESTAMP '2024-01-31') - c <= 168 * 3600000000 END),
      r AS (SELECT *, row_number() OVER w AS k, sum(bytes) OVER (PARTITION BY owner ORDER BY l DESC, key ROWS UNBOUNDED PRECEDING) AS b FROM f WHERE NOT cp WINDOW w AS (PARTITION BY owner ORDER BY l DESC, key))
      SELECT owner, entry FROM f WHERE cp UNION ALL SELECT owner, entry FROM r WHERE k <= 8 AND b <= 200""",
    "slot_conflicts": """WITH e AS (SELECT p_partkey AS entry, CASE WHEN p_partkey % 6 = 0 THEN 'checkpoint/' ELSE '' END || p_partkey % 20 || '-' || p_partkey % 2 || '-' || p_partkey % 7 AS key, p_partkey % 20 AS ticker, CASE WHEN p_partkey % 4 <> 3 THEN p_partkey % 4 END AS profile,
        p_partkey % 2 AS kind, CASE p_partkey % 3 WHEN 0 THEN 'webgl' WHEN 1 THEN 'cpu' END AS backend FROM part)
      SELECT entry FROM e WHERE EXISTS (SELECT 1 FROM e n WHERE n.entry % 10 = 0 AND n.ticker = e.ticker AND n.kind = e.kind AND n.profile IS NOT DISTINCT FROM e.profile AND (e.backend IS NULL OR e.backend = n.backend) AND e.key <> n.key AND e.key <> 'checkpoint/' || n.key)""",
    "availability": f"""WITH {_ART}, c AS (SELECT pt.ticker, created_at FROM pt JOIN ar ON version = version_id AND status = 'promoted'), a AS (SELECT CAST(n_nationkey AS VARCHAR) AS ticker FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region),
      j AS (SELECT a.ticker, (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(created_at)) / 3600000000.0::DOUBLE AS h FROM a LEFT JOIN c USING (ticker)) SELECT ticker, CASE WHEN h IS NULL THEN 'missing' WHEN h <= 36 THEN 'fresh' ELSE 'stale' END AS state, round(h, 3) AS age_hours FROM j""",
    "superseded_models": """WITH m AS (SELECT p_partkey AS model_id, p_partkey % 50 AS ticker, substr(CAST(p_partkey AS VARCHAR), 1, 1) AS kind, p_partkey % 3 AS rank FROM part) SELECT model_id, rank FROM m QUALIFY rank < max(rank) OVER (PARTITION BY ticker, kind)""",
    "promotion_replay": """WITH RECURSIVE ev AS (SELECT user_id % 25 AS ticker, row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) AS k, CASE event_type WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'prune' WHEN 'view' THEN 'rollback' ELSE 'promote' END AS a, CAST(event_id % 40 AS VARCHAR) AS v FROM events),
      st AS (SELECT DISTINCT ticker, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS cur, CAST(NULL AS VARCHAR) AS prev, CAST([] AS VARCHAR[]) AS rej, CAST([] AS VARCHAR[]) AS pru FROM ev
        UNION ALL SELECT ev.ticker, ev.k, CASE WHEN ok THEN v WHEN back THEN prev ELSE cur END, CASE WHEN ok THEN cur WHEN back THEN NULL ELSE prev END,
          CASE WHEN a = 'reject' AND cur IS DISTINCT FROM v THEN list_append(rej, v) WHEN back THEN list_filter(rej, lambda x: x <> prev) ELSE rej END, CASE WHEN a = 'prune' AND cur IS DISTINCT FROM v AND prev IS DISTINCT FROM v THEN list_append(pru, v) ELSE pru END
        FROM (SELECT ev.*, cur, prev, rej, pru, a = 'promote' AND cur IS DISTINCT FROM v AND NOT list_contains(rej, v) AND NOT list_contains(pru, v) AS ok, a = 'rollback' AND prev IS NOT NULL AS back FROM st JOIN ev ON ev.ticker = st.ticker AND ev.k = st.k + 1) ev)
      SELECT ticker, k AS n, cur AS current, prev AS previous FROM st QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY k DESC) = 1""",
    "version_ids": r"""WITH v AS (SELECT o_orderkey, o_orderdate, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders),
      w AS (SELECT o_orderkey, 'P' || o_orderkey || '-price-' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '-' || CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE left(h, 12) END || '-'
        || CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 0 THEN '0a256' || left(h, 3) ELSE right(h, 8) END AS version_id FROM v) SELECT *, true AS known FROM w""",
    "guarded_export": r"""SELECT c_custkey, regexp_replace(['=', '+', '', '-', '@'][c_custkey % 5 + 1] || c_name, '^([=+\-@])', '''\1') AS cell FROM customer""",
    "prediction_parity": f"""WITH {BARS_SQL} SELECT count(*) AS n, count(CASE WHEN day(session) = 3 THEN 1 END) AS unmatched, CAST(0 AS BIGINT) AS not_finite, false AS equal, round(max(CASE WHEN day(session) <> 3 THEN CASE WHEN month(session) = 2 THEN 0.5::DOUBLE ELSE 0 END END), 6) AS largest FROM b""",
}
