"""Ledger, artifact and promotion tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LEASE_ATTEMPTS = 3
FRESH_HOURS = 36


def ledger_rows(lines: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, corrupt) rows of JSON lines; corrupt ones keep their text."""
    parsed = lines.withColumn("_p", F.from_json(F.col(column), schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()
    return parsed.where(~bad).select(*(c for c in lines.columns if c != column), "_p.*").drop("_corrupt"), parsed.where(bad).drop("_p")


def ledger_defaults(records: DataFrame) -> DataFrame:
    """Defaults and fallbacks of a record: the folds' median before the plain error, decision from promotable, audited from where it comes.

    A record is audited if both its snapshot and its commit are known: neither missing, empty nor ``unknown``.
    """
    known = lambda c: F.coalesce(~F.col(c).isin("", "unknown"), F.lit(False)) if c in records.columns else F.lit(False)
    return records.withColumns({
        "relative_mae": F.coalesce("median_relative_mae", "relative_mae"),
        "decision": F.coalesce("decision", F.when(F.col("promotable"), "keep").otherwise("discard")),
        "status": F.coalesce("status", F.lit("success")),
        "audited": known("snapshot_id") & known("commit"),
    })


def ledger_report(records: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Totals by family and decision with failures and unaudited keeps; families by their canonical names."""
    names = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    family = F.coalesce(names[F.col("family")], F.col("family"))
    kept = F.col("decision") == "keep"
    return records.groupBy(family.alias("family"), "decision").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "success").alias("failed"), F.count_if(kept & ~F.col("audited")).alias("unaudited"), F.min("relative_mae").alias("best"))


def guarded(cell: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading quote."""
    return F.regexp_replace(cell, r"^([=+\-@])", "'$1")


def champions(pointers: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Current version of each ticker, if it is still promoted. pointers: ticker, version; artifacts: version_id, status."""
    promoted = artifacts.where("status = 'promoted'").select("version_id", "created_at")
    return pointers.select("ticker", F.col("version").alias("version_id")).join(promoted, "version_id").select("ticker", "version_id", "created_at")


def retention_candidates(artifacts: DataFrame, pointers: DataFrame, cutoff: Column) -> DataFrame:
    """Old, unpruned, unpromoted artifacts that no pointer names as current or previous."""
    old = artifacts.where((F.col("created_at") < cutoff) & ~F.col("pruned") & (F.col("status") != "promoted"))
    for name in ("version", "previous"):
        old = old.join(pointers.select(F.col(name).alias("version_id")), "version_id", "left_anti")
    return old.select("version_id", "ticker", "created_at")


def lease_expiry(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Expired leases go back to the queue, or fail after the last attempt."""
    expired = (F.col("state") == "processing") & (F.col("lease_until") < as_of)
    return jobs.withColumn("new_state", F.when(expired & (F.col("attempts") >= LEASE_ATTEMPTS), "failed").when(expired, "queued").otherwise(F.col("state")))


def lru_retention(models: DataFrame, as_of: Column, most_rows: int, most_bytes: int, ttl_days: int) -> DataFrame:
    """Per owner: which models stay after expiry and eviction of the least recently used beyond rows and bytes."""
    fresh = models.where(F.col("last_used") >= as_of - F.make_interval(days=F.lit(ttl_days)))
    w = W.partitionBy("owner").orderBy(F.desc("last_used"), "model_id")
    ranked = fresh.withColumn("_r", F.row_number().over(w)).withColumn("_b", F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return ranked.where((F.col("_r") <= most_rows) & (F.col("_b") <= most_bytes)).drop("_r", "_b")


def cache_retention(entries: DataFrame, as_of: Column, version: str, most_rows: int = 8, most_bytes: int = 200 << 20, model_hours: int = 168, checkpoint_hours: int = 24) -> DataFrame:
    """Which entries of a cache stay, per owner.

    Keys that don't match ``version`` go, then checkpoints by their last update and models by their making; of the models
    left, the least recently used go beyond rows and bytes. Checkpoints aren't evicted. entries: owner, key, kind,
    created_at, updated_at, last_used, bytes; missing bytes count as none, ties stay by key.
    """
    checkpoint = F.coalesce(F.col("kind") == "checkpoint", F.lit(False))
    age = lambda c: (F.unix_micros(as_of) - F.unix_micros(c)) / F.lit(3_600_000_000.0)
    old = F.when(checkpoint, age("updated_at") > checkpoint_hours).otherwise(age("created_at") > model_hours)
    fresh = entries.where(F.col("key").rlike(version) & ~F.coalesce(old, F.lit(False)))
    w = W.partitionBy("owner", checkpoint).orderBy(F.desc("last_used"), "key")
    ranked = fresh.withColumn("_r", F.row_number().over(w)).withColumn("_b", F.sum(F.coalesce("bytes", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return ranked.where(checkpoint | ((F.col("_r") <= most_rows) & (F.col("_b") <= most_bytes))).drop("_r", "_b")


SLOT = ("ticker", "forecast_type", "profile", "horizon")


def slot_conflicts(entries: DataFrame, made: DataFrame) -> DataFrame:
    """Entries in the slot of a new one, of its backend or of none known, but with another key than it and its checkpoint.

    Both: key, ticker, forecast_type, profile, horizon, backend; a missing part of a slot matches a missing one.
    """
    new = made.select(*(F.col(c).alias(f"_{c}") for c in (*SLOT, "backend", "key")))
    same = [entries[c].eqNullSafe(new[f"_{c}"]) for c in SLOT]
    other = (F.col("key") != F.col("_key")) & (F.col("key") != F.concat(F.lit("checkpoint/"), F.col("_key")))
    fits = F.col("backend").isNull() | (F.col("backend") == F.col("_backend"))
    return entries.join(new, [*same, fits & other], "left_semi")


def superseded(models: DataFrame) -> DataFrame:
    """Variants of a slot with a lower rank than its best."""
    best = F.max("rank").over(W.partitionBy("ticker", "kind"))
    return models.withColumn("_best", best).where(F.col("rank") < F.col("_best")).drop("_best")


def availability(allowed: DataFrame, found: DataFrame, as_of: Column, hours: int = FRESH_HOURS) -> DataFrame:
    """State of every allowed ticker: missing, fresh or stale, with its age in hours."""
    age = (F.unix_micros(as_of) - F.unix_micros("created_at")) / F.lit(3_600_000_000.0)
    joined = allowed.join(found.select("ticker", "created_at"), "ticker", "left").withColumn("age_hours", age)
    return joined.select("ticker", F.when(F.col("created_at").isNull(), "missing").when(F.col("age_hours") <= hours, "fresh").otherwise("stale").alias("state"), "age_hours")


def replay(events: DataFrame) -> DataFrame:
    """Current and previous version per ticker after its log of insert, promote, reject, rollback and prune in order.

    Promotion moves the current version to previous; rollback restores the previous one, whatever was said of it, and clears
    it. Rejected and pruned versions can't be promoted, the current one can't be rejected, current and previous ones can't
    be pruned, and promoting the current one changes nothing. events: ticker, seq, action, version.
    """
    empty = F.array().cast("array<string>")
    state = F.struct(F.lit(None).cast("string").alias("current"), F.lit(None).cast("string").alias("previous"), empty.alias("rejected"), empty.alias("pruned"))

    def step(s: Column, e: Column) -> Column:
        def kept(**new: Column) -> Column:
            return F.struct(*(new.get(c, s[c]).alias(c) for c in ("current", "previous", "rejected", "pruned")))

        version, action = e["version"], e["action"]
        is_current, is_previous = (F.coalesce(s[c] == version, F.lit(False)) for c in ("current", "previous"))
        barred = F.array_contains(s["rejected"], version) | F.array_contains(s["pruned"], version) | is_current
        return (
            F.when((action == "promote") & ~barred, kept(current=version, previous=s["current"]))
            .when((action == "reject") & ~is_current, kept(rejected=F.array_union(s["rejected"], F.array(version))))
            .when((action == "prune") & ~is_current & ~is_previous, kept(pruned=F.array_union(s["pruned"], F.array(version))))
            .when((action == "rollback") & s["previous"].isNotNull(), kept(current=s["previous"], previous=F.lit(None).cast("string"), rejected=F.array_remove(s["rejected"], s["previous"])))
            .otherwise(s)
        )

    logs = events.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "version"))).alias("_log"))
    return logs.withColumn("_s", F.aggregate("_log", state, step)).select("ticker", F.size("_log").cast("long").alias("n"), F.col("_s.current").alias("current"), F.col("_s.previous").alias("previous"))


#: What a version's name looks like (a fixed contract).
VERSION = r"^[A-Z0-9.-]+-(price|direction)-\d{8}T\d{6}Z-([0-9a-f]{12}|unknown)-([0-9a-f]{8}|unknown)$"


def version_id(ticker: Column, kind: Column, created: Column, commit: Column, snapshot: Column) -> Column:
    """Name of a version: ticker, kind, time in UTC, 12 letters of the commit, and the last 8 hex digits of the snapshot, filled up with zeros.

    created is a timestamp, formatted in UTC whatever the session's zone. A commit that is missing is ``unknown``, and so
    is a snapshot that is missing, called so or without hex digits.
    """
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), created.cast("timestamp").cast("timestamp_ntz"))
    hexes = F.regexp_replace(F.coalesce(snapshot, F.lit("")), "[^0-9a-fA-F]", "")
    short = F.when((F.coalesce(snapshot, F.lit("unknown")) == "unknown") | (hexes == ""), "unknown").otherwise(F.lpad(F.lower(F.right(hexes, F.lit(8))), 8, "0"))
    sha = F.when(F.coalesce(commit, F.lit("")) == "", "unknown").otherwise(F.left(commit, F.lit(12)))
    return F.concat_ws("-", ticker, kind, F.date_format(utc, "yyyyMMdd'T'HHmmss'Z'"), sha, short)


def known_version(version: Column) -> Column:
    return version.rlike(VERSION)


def parity(left: DataFrame, right: DataFrame, keys: tuple[str, ...], tolerance: float) -> DataFrame:
    """Whether two prediction tables agree: rows on one side only, non-finite values, largest difference."""
    joined = left.select(*keys, F.col("predicted").alias("_a"), F.lit(1).alias("_l")).join(right.select(*keys, F.col("predicted").alias("_b"), F.lit(1).alias("_r")), list(keys), "full")
    one = F.col("_l").isNull() | F.col("_r").isNull()
    found = joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(one).alias("unmatched"), F.count_if(~one & (F.isnan("_a") | F.isnan("_b"))).alias("not_finite"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("largest"))
    return found.withColumn("equal", (F.col("unmatched") == 0) & (F.col("not_finite") == 0) & (F.coalesce("largest", F.lit(0.0)) <= tolerance))


def lookup(instruments: DataFrame, text: str, most: int = 8) -> DataFrame:
    """ticker, name, kind of what a search text may mean; instruments: ticker, name, kind.

    A text that is a symbol as it stands means itself alone. Other texts find shares and funds by their name or the start
    of their symbol, the first ones by symbol, and the symbol they spell if it isn't among these.
    """
    symbol = text.strip().upper()
    spark = instruments.sparkSession
    spelt = re.fullmatch(r"[A-Z0-9.\-]{1,12}", symbol) is not None
    exact = spark.range(1 if spelt else 0).select(F.lit(symbol).alias("ticker"), F.lit(symbol).alias("name"), F.lit("SYMBOL").alias("kind"))
    if spelt and text.strip() == symbol:
        return exact
    named = F.lower("name").contains(text.strip().lower()) | F.col("ticker").startswith(symbol)
    found = instruments.where(F.col("kind").isin("EQUITY", "ETF") & named).orderBy("ticker").limit(most).select("ticker", "name", "kind")
    return found.unionByName(exact.join(found, "ticker", "left_anti"))


def audit_log(rows: DataFrame) -> DataFrame:
    """Entries in the order they were made; missing details are an empty object."""
    return rows.orderBy("id").select("id", "event", F.coalesce("details", F.lit("{}")).alias("details"), "created_at")
