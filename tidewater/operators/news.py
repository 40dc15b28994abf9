"""Point-in-time text features of articles: keys, relevance, sessions, decayed sentiment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Event groups with their keywords, and phrases with weights. Callers may pass tables of their own.
EVENTS = {
    "earnings": ("earnings", "beat estimates", "missed estimates"),
    "guidance": ("guidance", "outlook"),
    "analyst_rating": ("upgrade", "downgrade"),
    "dividend": ("dividend",),
    "merger_acquisition": ("merger", "acquisition", "buyout"),
    "legal_regulatory": ("lawsuit", "investigation", "regulatory"),
    "product": ("launch", "product announcement"),
    "management_change": ("ceo", "resigns"),
    "financing": ("offering", "financing"),
    "restructuring": ("layoffs", "restructuring"),
}
PHRASES = {
    "guidance cut": -2.0,
    "missed estimates": -1.5,
    "beat expectations": 2.0,
    "upgrade": 1.5,
    "downgrade": -1.5,
    "bullish": 2.0,
    "bearish": -2.0,
    "profit warning": -2.0,
    "dividend hike": 1.5,
    "dividend cut": -1.5,
    "record high": 1.5,
    "record low": -1.5,
    "layoffs": -1.5,
    "bankruptcy": -3.0,
    "lawsuit": -1.5,
    "merger": 1.0,
    "acquisition": 1.0,
}
CLOSE_HOUR = 16


def first_of(*paths: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(p), F.lit("")) for p in paths))


def parsed_time(raw: Column) -> Column:
    """Epoch seconds or ISO text as a timestamp, UTC if it has no zone; null if it is neither."""
    seconds = raw.try_cast("double")
    return F.coalesce(F.timestamp_micros(F.when(seconds.isNotNull(), F.floor(seconds * 1_000_000).cast("long"))), F.try_to_timestamp(raw))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, path without its last slashes, no query and fragment."""
    head = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.nullif(F.concat(head, F.regexp_replace(path, "/+$", "")), F.lit(""))


# Where the known shapes of a record keep each field, in the order in which they are tried.
PATHS = {
    "article_id": ("article_id", "provider_article_id"),
    "provider": ("provider",),
    "ticker": ("ticker",),
    "company_name": ("company_name",),
    "title": ("title", "content.title"),
    "summary": ("summary", "description", "content.summary", "content.description"),
    "published_at": ("published_at_utc", "providerPublishTime", "pubDate", "content.pubDate", "content.displayTime"),
    "received_at": ("received_at_utc",),
    "publisher": ("publisher", "content.provider.displayName"),
    "link": ("canonical_url", "link", "content.canonicalUrl", "content.url"),
    "language": ("language",),
}


def normalised(records: DataFrame, column: str = "value", provider: str = "yfinance") -> DataFrame:
    """Articles of JSON records of any of the known shapes, each parsed once; other columns stay.

    A field is the first of its paths that is neither missing, null nor empty. Records without title and summary, and
    texts that are no JSON object, are left out; an article that wasn't received later was received when published.
    """
    parsed = records.withColumn("_record", F.try_parse_json(column)).drop(column)
    raw = {name: F.coalesce(*(F.nullif(F.try_variant_get("_record", f"$.{p}", "string"), F.lit("")) for p in paths)) for name, paths in PATHS.items()}
    rows = parsed.withColumns(raw).drop("_record")
    bare = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    rows = rows.withColumns({"title": bare("title"), "summary": bare("summary"), "provider": F.coalesce("provider", F.lit(provider)), "ticker": F.upper("ticker"), "link": canonical_url(F.trim("link")), "published_at": parsed_time(F.col("published_at")), "received_at": parsed_time(F.col("received_at"))})
    return rows.withColumn("received_at", F.coalesce("received_at", "published_at")).where("title is not null or summary is not null")


def title_key(title: Column) -> Column:
    """Letters, digits and underscores of the lower-cased title, other runs as one blank."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_]+", " "))


def dedup(articles: DataFrame) -> DataFrame:
    """The first article by (published, id, title) of each key: its id, else its url, else its title key."""
    key = F.coalesce(F.concat(F.lit("i:"), F.col("article_id")), F.concat(F.lit("u:"), canonical_url(F.col("link"))), F.concat(F.lit("t:"), title_key(F.col("title"))))
    w = W.partitionBy("ticker", "_key").orderBy(F.col("published_at").asc_nulls_last(), F.col("article_id").asc_nulls_last(), "title", "doc_id")
    return articles.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_key", "_r")


def relevance(text: Column, tagged: Column, symbol: Column, alias: Column) -> Column:
    """1.0 if tagged or named by an alias of more than two letters, 0.7 if the symbol stands alone in the text, else null."""
    named = (F.length(alias) > 2) & F.lower(text).contains(F.lower(alias))
    alone = (F.length(symbol) >= 2) & F.regexp_like(F.upper(text), F.concat(F.lit("(?<![A-Z0-9])"), symbol, F.lit("(?![A-Z0-9])")))
    return F.when(tagged | named, F.lit(1.0)).when(alone, F.lit(0.7))


def categories(text: Column, groups: dict[str, tuple[str, ...]] = EVENTS) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*(F.when(reduce(Column.__or__, (low.contains(k) for k in keys)), F.lit(name)) for name, keys in groups.items())), lambda x: x.isNotNull())


def sentiment(text: Column, compound: Column, phrases: dict[str, float] = PHRASES) -> Column:
    """A given compound score and a tenth of the weights of contained phrases, clipped to [-1, 1]."""
    low = F.lower(text)
    extra = reduce(Column.__add__, (F.when(low.contains(p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in phrases.items()))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), compound + 0.1 * extra))


def to_sessions(articles: DataFrame, sessions: DataFrame, close_hour: int = CLOSE_HOUR, always: Column | None = None) -> DataFrame:
    """Each article's session: the first one on or after the day it is available, or after it from the close on.

    always: whether the article's ticker trades around the clock; then a session starts at midnight, and an article
    that came later than that waits for the next one. Every day up to a session has its row in a calendar, so articles
    find theirs by an equi-join, whatever their number. Null if no session follows or the article has no date.
    """
    available = F.greatest("published_at", "received_at")
    day = F.when(F.hour(available) >= close_hour, F.date_add(F.to_date(available), 1)).otherwise(F.to_date(available))
    if always is not None:
        midnight = F.date_trunc("day", available)
        day = F.when(always, F.date_add(F.to_date(available), F.when(available > midnight, 1).otherwise(0))).otherwise(day)
    names = list(dict.fromkeys((*articles.columns, "available_at", "session")))
    dates = sessions.where("series is not null and session is not null").select(F.col("series").alias("ticker"), F.col("session").alias("_session")).distinct()
    # A ticker's first session also has the days before it; those count as its own day.
    per = W.partitionBy("ticker")
    spans = dates.select("ticker", "_session", F.coalesce(F.date_add(F.lag("_session").over(per.orderBy("_session")), 1), "_session").alias("_from"))
    calendar = spans.select("ticker", "_session", F.explode(F.sequence("_from", "_session")).alias("_day"))
    first = dates.groupBy("ticker").agg(F.min("_session").alias("_first"))
    rows = articles.drop("session").withColumn("_day", day).withColumn("available_at", available).join(first, "ticker", "left")
    rows = rows.withColumn("_day", F.when(F.col("_day") < F.col("_first"), F.col("_first")).otherwise(F.col("_day")))
    return rows.join(calendar, ["ticker", "_day"], "left").withColumnRenamed("_session", "session").select(*names)


#: Half-lives per block of the scaled weights; frames are shorter than a block.
BLOCK = 64


def _repeats(articles: DataFrame, name: str, span: int) -> DataFrame:
    """A row of -1 for each article whose name was met at most a look-back before, and one of 1 when that earlier one leaves it."""
    w = W.partitionBy("series", name).orderBy("_t")
    pairs = articles.select("series", "_t", F.lag("_t").over(w).alias("_before")).where(F.col("_t") - F.col("_before") <= span)
    steps = F.explode(F.array(F.struct(F.col("_t"), F.lit(-1).alias(f"_d{name}")), F.struct((F.col("_before") + span).alias("_t"), F.lit(1).alias(f"_d{name}"))))
    return pairs.select("series", steps.alias("_p")).select("series", "_p.*")


def decayed(articles: DataFrame, sessions: DataFrame, half_life_days: float = 7.0, reach: float = 10.0) -> DataFrame:
    """Features of each session from articles strictly before it and at most reach half-lives old.

    articles: ticker, available_at, title, score, relevance, publisher. Weights are 2 ** (-age / half-life) * relevance.
    They are summed inside the look-back on one timeline in microseconds, scaled to the start of blocks of time that are
    longer than the look-back, odd and even blocks apart; nothing is gathered. Distinct names in the look-back are its
    articles but for those whose name came before in it. Without articles a session has zeros and is marked missing.
    """
    if not 0 < reach < BLOCK or half_life_days <= 0:
        raise ValueError("half_life_days must be positive and reach below the block of scaled weights")
    unit = half_life_days * 86_400_000_000
    span, block = int(unit * reach), int(unit * BLOCK)
    dated = articles.where("available_at is not null").select(
        F.col("ticker").alias("series"), F.unix_micros("available_at").alias("_t"), F.col("score").cast("double").alias("_score"), F.col("relevance").cast("double").alias("_relevance"),
        F.col("publisher").alias("_publisher"), title_key(F.col("title")).alias("_title"),
    )
    points = sessions.select("series", F.unix_micros(F.col("session").cast("timestamp")).alias("_t"), "session")
    rows = dated
    for other in (_repeats(dated, "_publisher", span), _repeats(dated, "_title", span), points):
        rows = rows.unionByName(other, allowMissingColumns=True)
    number = F.floor(F.col("_t") / block)
    rows = rows.withColumns({"_b": number, "_scaled": F.col("_relevance") * F.pow(F.lit(2.0), (F.col("_t") - number * block) / F.lit(unit))})
    order = W.partitionBy("series").orderBy("_t")
    near, before = order.rangeBetween(-span, -1), order.rangeBetween(W.unboundedPreceding, -1)

    def total(value: Column) -> Column:
        """Sum of weighted values in the look-back, from the sums of even and of odd blocks."""
        out = F.lit(0.0)
        for parity in (0, 1):
            part = F.sum(F.when(F.pmod("_b", F.lit(2)) == parity, F.col("_scaled") * value)).over(near)
            start = (F.col("_b") - F.pmod(F.col("_b") - parity, F.lit(2))) * block
            out = out + F.coalesce(part * F.pow(F.lit(2.0), (start - F.col("_t")) / F.lit(unit)), F.lit(0.0))
        return out

    score = F.col("_score")
    rows = rows.select(
        "series", "session", F.count("_relevance").over(near).alias("n"), total(F.lit(1.0)).alias("weight"), total(score).alias("_sum"),
        total(F.when(score > 0, 1.0)).alias("_up"), total(F.when(score < 0, 1.0)).alias("_down"),
        *(F.coalesce(F.sum(f"_d_{name}").over(before), F.lit(0)).alias(f"_{name}s") for name in ("publisher", "title")),
    ).where("session is not null")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("weight")), F.lit(0.0))
    return rows.select(
        "series", "session", "n", "weight", share("_sum").alias("sentiment"), F.least(F.lit(1.0), F.col("weight") / 5).alias("intensity"),
        share("_up").alias("positive"), share("_down").alias("negative"), (F.col("n") + F.col("_publishers")).alias("publishers"),
        F.coalesce(F.try_divide(F.col("n") + F.col("_titles"), F.col("n")), F.lit(0.0)).alias("novelty"),
        F.when(F.col("n") > 0, 1.0).otherwise(0.0).alias("coverage"), (F.col("n") == 0).alias("missing"),
    )


def with_news(frame: DataFrame, articles: DataFrame, half_life_days: float = 7.0) -> DataFrame:
    """Feature rows (series, session, ...) with the articles' features beside them; a column that both have is refused."""
    made = decayed(articles, frame.select("series", "session").distinct(), half_life_days)
    clash = sorted(set(made.columns) & set(frame.columns) - {"series", "session"})
    if clash:
        raise ValueError(f"columns of both: {', '.join(clash)}")
    return frame.join(made, ["series", "session"], "left")


def summary(articles: DataFrame, as_of: Column, half_life_days: float = 3.0) -> DataFrame:
    """Current weighted score per ticker with counts, sources, the freshest article and all categories; undated weigh 1."""
    age = (F.unix_micros(as_of) - F.unix_micros("published_at")) / F.lit(86_400_000_000.0)
    weight = F.when(F.col("published_at").isNull(), F.lit(1.0)).otherwise(F.pow(F.lit(2.0), -F.greatest(age, F.lit(0.0)) / half_life_days))
    rows = articles.withColumn("_w", weight)
    return rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.try_divide(F.sum(F.col("_w") * F.col("score")), F.sum("_w")), F.lit(0.0)).alias("score"),
        F.count_distinct("publisher").alias("sources"),
        F.max("published_at").alias("freshest"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))), ",").alias("events"),
    )


def served_summary(wanted: DataFrame, articles: DataFrame, as_of: Column, half_life_days: float = 3.0) -> DataFrame:
    """A summary for every wanted ticker; those without articles get a neutral row that says why. wanted: ticker."""
    made = summary(articles.join(wanted.select("ticker").distinct(), "ticker", "left_semi"), as_of, half_life_days)
    live = F.col("n").isNotNull()
    joined = wanted.select("ticker").distinct().join(made, "ticker", "left")
    return joined.select(
        "ticker", F.when(live, "live").otherwise("fallback").alias("status"), F.when(~live, "no_usable_news").alias("reason"), F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("sources", F.lit(0)).alias("sources"), "freshest", F.coalesce("events", F.lit("")).alias("events"),
    )


def manifest(articles: DataFrame) -> DataFrame:
    return articles.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count("published_at").alias("n_dated"), F.min("published_at").alias("first_published"), F.max("published_at").alias("last_published"))


def archive_violations(articles: DataFrame) -> DataFrame:
    """Rows that a strict archive refuses, by reason; received before published counts as one."""
    why = F.filter(F.array(F.when(F.col("published_at").isNull(), F.lit("published")), F.when(F.col("received_at").isNull(), F.lit("received")), F.when(F.col("received_at") < F.col("published_at"), F.lit("order")), F.when(F.coalesce(F.length("title"), F.lit(0)) + F.coalesce(F.length("summary"), F.lit(0)) == 0, F.lit("empty"))), lambda x: x.isNotNull())
    return articles.select("doc_id", F.explode(why).alias("reason"))
