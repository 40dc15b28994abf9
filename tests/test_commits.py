"""Content-addressed tables, imports, publication, records and snapshots."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewater.operators import align, clean, gates, news, registry
from tidewater.sources import commits, io

GOOD = {"provider": "p", "ticker": "spy", "title": "t", "published_at_utc": "2024-01-01T00:00:00Z", "received_at_utc": "2024-01-01T01:00:00Z"}


def test_rows_and_not_their_order_make_the_hash(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("b", None)], "k string, x double")
    same = commits.content_id(df)
    assert same == commits.content_id(df.orderBy(F.desc("k")).repartition(3))
    others = (df.distinct(), df.withColumnRenamed("x", "y"), df.fillna(0.0), df.limit(0))
    assert len({same, *map(commits.content_id, others)}) == 5


def test_a_table_is_stored_once_and_changes_are_noticed(spark, tmp_path):
    root = f"{tmp_path}/root"
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    found = commits.store(df, root, "report", {"made": "here"})
    assert commits.store(df.repartition(2), root, "report") == found and commits.listed(spark, root).count() == 1
    line = commits.listed(spark, root).first()
    assert (line["n"], json.loads(line["facts"])) == (2, {"made": "here"})
    assert sorted(map(tuple, commits.read_stored(spark, root, "report", found).collect())) == [("a", 1.0), ("b", 2.0)]
    # Of a try that died before its manifest line nothing is known, and the next one is whole.
    other = df.where("k = 'a'")
    other.write.parquet(f"{root}/data/report-dead")
    with pytest.raises(io.Refused, match="no report"):
        commits.read_stored(spark, root, "report", commits.content_id(other))
    assert commits.read_stored(spark, root, "report", commits.store(other, root, "report")).count() == 1
    df.write.mode("append").parquet(f"{root}/{line['place']}")
    with pytest.raises(io.Refused, match="changed"):
        commits.read_stored(spark, root, "report", found)
    assert commits.store(df.limit(0), root, "empty") and commits.listed(spark, root).count() == 3


@pytest.mark.parametrize(
    ("line", "why"),
    [
        (json.dumps({k: v for k, v in GOOD.items() if k not in ("ticker", "title")}), r"no ticker\+title"),
        (json.dumps(GOOD | {"received_at_utc": "2023-12-31T00:00:00Z"}), "times"),
        (json.dumps(GOOD | {"received_at_utc": None}), "times"),
        (json.dumps(GOOD | {"published_at_utc": "soon"}), "times"),
        ('{"provider": "p", "tick', "unreadable"),
        ("[1]", "unreadable"),
    ],
)
def test_one_bad_line_refuses_an_archive(spark, tmp_path, line, why):
    (tmp_path / "a.jsonl").write_text(json.dumps(GOOD) + "\n\n" + line + "\n")
    with pytest.raises(io.Refused, match=why):
        commits.import_archive(spark, f"{tmp_path}/a.jsonl", f"{tmp_path}/out")
    assert not (tmp_path / "out").exists()


def test_an_import_repeats_without_change_and_refuses_another_archive(spark, tmp_path):
    lines = [GOOD, GOOD, GOOD | {"title": "u", "published_at_utc": "2024-01-01T00:30:00Z"}, GOOD | {"title": " ", "summary": ""}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    (tmp_path / "b.jsonl").write_text(json.dumps(GOOD) + "\n")
    root = f"{tmp_path}/out"
    found = {commits.import_archive(spark, f"{tmp_path}/a.jsonl", root) for _ in range(2)}
    facts = json.loads(commits.listed(spark, root).first()["facts"])
    assert len(found) == 1 and commits.listed(spark, root).count() == 1
    assert (facts["article_count"], facts["first_published_at"], facts["last_published_at"]) == (2, "2024-01-01 00:00:00", "2024-01-01 00:30:00")
    assert {r["title"] for r in commits.read_stored(spark, root, "articles", *found).collect()} == {"t", "u"}
    with pytest.raises(io.Refused, match="another archive"):
        commits.import_archive(spark, f"{tmp_path}/b.jsonl", root)


def test_publication_survives_a_retry(spark, tmp_path):
    root = f"{tmp_path}/out"
    bundles = spark.createDataFrame([("A", [1.0]), ("B", [2.0])], "ticker string, prices array<double>")
    version = commits.store(bundles, root, "price")  # a first try that died before its pointers
    assert commits.pointers(spark, root).isEmpty()
    assert commits.publish(bundles, root, "price") == commits.publish(bundles, root, "price") == version
    assert sorted(map(tuple, commits.pointers(spark, root).collect())) == [("A", version, "price"), ("B", version, "price")]
    assert commits.publish(bundles.where("ticker = 'A'"), root, "price") != version and commits.pointers(spark, root).count() == 3


def test_records_of_all_shapes(spark):
    records = [
        {"title": "", "content": {"title": " Deep ", "summary": "", "description": "d", "pubDate": "2024-01-02T00:00:00Z", "canonicalUrl": "HTTP://A.com/X/?q", "provider": {"displayName": "Pub"}}},
        {"title": "flat", "providerPublishTime": 1704067200, "link": "", "canonical_url": None, "content": {"url": "http://b.com/"}, "ticker": "qqq"},
        {"title": None, "summary": " "}, {"content": "text"}, 7,
    ]
    lines = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(8, "{"), (9, None)], "k int, value string")
    found = {r["k"]: r for r in news.normalised(lines).collect()}
    assert sorted(found) == [0, 1]
    a, b = found[0], found[1]
    assert (a["title"], a["summary"], a["link"], a["publisher"], a["provider"], a["ticker"]) == ("Deep", "d", "http://a.com/X", "Pub", "yfinance", None)
    assert a["published_at"] == a["received_at"] == dt.datetime(2024, 1, 2)
    assert (b["title"], b["summary"], b["link"], b["ticker"], b["published_at"]) == ("flat", None, "http://b.com", "QQQ", dt.datetime(2024, 1, 1))


def test_snapshots_name_what_they_lack(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    rows = [(s, day(k), 0.0 if (s, k) == ("priced", 95) else 5.0, float("nan") if (s, k) == ("gaps", 99) else float(k)) for s in ("good", "gaps", "priced") for k in range(100)] + [("few", day(k), 5.0, 1.0) for k in range(90)]
    future = spark.createDataFrame([("good", day(101), 2), ("good", day(100), 1)], "series string, session date, step int")
    made = align.training_snapshot(spark.createDataFrame(rows, "series string, session date, close double, x double"), ("x",), future, most=95)
    found = {r["series"]: r for r in made.collect()}
    assert {s: r["problem"] for s, r in found.items()} == {"good": None, "gaps": "features", "priced": "prices", "few": "short"}
    good = found["good"]
    assert (good["raw_rows"], len(good["dates"]), good["features"][0], good["usable_sequences"], good["start_date"], good["future_dates"]) == (100, 95, [5.0], 6, day(5), [day(100), day(101)])
    assert found["few"]["future_dates"] is None and found["few"]["usable_sequences"] == 1


def test_evidence_records_tell_windows_and_majority(spark):
    judged = spark.createDataFrame([("s", 3, 2, "survives", 0.91234, 0.95, 0.9, 0.93)], "series string, windows long, passing long, verdict string, mae_high double, rmse_high double, relative_mae double, relative_rmse double")
    windows = spark.createDataFrame([("s", 2, 1.1, 1.2), ("s", 0, 0.9, 0.9), ("s", 1, 0.8, 0.97)], "series string, fold int, relative_mae double, relative_rmse double")
    snapshots = spark.createDataFrame([("s", "sha256:x")], "series string, snapshot_id string")
    row = gates.holdout_records(judged, windows, "series", "ridge", 5, snapshots).first()
    assert (row["folds_beating_persistence"], row["decision"], row["promotable"], row["worst_fold_relative_rmse"], row["run_tag"]) == ("2/3", "keep", True, 1.2, "holdout-ridge")
    assert row["decision_reason"] == "2/3 windows pass the 0.98 gate (majority required 2); pooled CI upper bounds mae=0.9123 rmse=0.9500 vs gate <1.0"
    assert [(w["window_index"], w["passes_gate"]) for w in row["per_window"]] == [(0, True), (1, True), (2, False)]


def test_cache_keeps_what_the_rules_leave(spark):
    at = lambda h: dt.datetime(2024, 1, 31) - dt.timedelta(hours=h)
    entries = [
        ("v4/a", "model", at(100), at(1), at(1), 5), ("v4/b", None, at(10), at(1), at(2), None), ("v4/c", "model", at(10), at(1), at(3), 6), ("v4/d", "model", at(169), at(1), at(0), 1),
        ("v3/e", "model", at(1), at(1), at(0), 1), ("v4/f", "checkpoint", at(500), at(23), at(99), 900), ("v4/g", "checkpoint", at(1), at(25), at(1), 1),
    ]
    df = spark.createDataFrame([("o", *e) for e in entries], "owner string, key string, kind string, created_at timestamp, updated_at timestamp, last_used timestamp, bytes long")
    kept = lambda **limits: {r["key"] for r in registry.cache_retention(df, F.lit(at(0)), "^v4/", **limits).collect()}
    assert kept() == {"v4/a", "v4/b", "v4/c", "v4/f"}
    assert kept(most_rows=2) == {"v4/a", "v4/b", "v4/f"} and kept(most_bytes=10) == {"v4/a", "v4/b", "v4/f"} and kept(most_bytes=4) == {"v4/f"}


def test_quality_names_every_issue(spark):
    day = dt.date(2024, 1, 1)
    rows = [("bad", day, 5.0), ("bad", day, 5.0), ("bad", day + dt.timedelta(9), 8.0), ("bad", day + dt.timedelta(10), -1.0), ("good", day, 5.0), ("good", day + dt.timedelta(1), 5.1)]
    bench = spark.createDataFrame([("B", day + dt.timedelta(5))], "benchmark string, session date")
    found = clean.quality_details(spark.createDataFrame(rows, "series string, session date, close double"), F.lit(day + dt.timedelta(15)), bench).collect()
    assert {r["series"] for r in found} == {"bad"} and [r["severity"] for r in found] == ["error"] * 2 + ["warning"] * 3
    assert [r["code"] for r in found] == ["duplicate_dates", "non_positive_values", "large_single_day_move", "missing_sessions", "benchmark_series_end_earlier"]
    assert (found[0]["detail"], found[3]["detail"]) == ("1 duplicate rows.", "1 session gaps longer than 7 calendar days.")
