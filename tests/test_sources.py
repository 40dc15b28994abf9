"""Sources, sinks and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewater.operators import forecasters, registry
from tidewater.sources import io
from tidewater.streaming import jobs

from .test_operators import bars


def test_snapshot_detects_tampering(spark, tmp_path):
    path = f"{tmp_path}/snap"
    both = bars(spark, [1.0, 2.0], "a").unionByName(bars(spark, [3.0], "b"))
    assert io.write_snapshot(both, path).count() == 2
    assert io.read_snapshot(spark, path).count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_snapshot(both, path)
    bars(spark, [4.0], "b", dt.date(2021, 1, 1)).write.mode("append").partitionBy("series").parquet(f"{path}/bars")
    with pytest.raises(io.Refused, match="b changed"):
        io.read_snapshot(spark, path)


def test_universe_keeps_first_places(spark, tmp_path):
    for name, value in (("list", ["spy", " QQQ", "SPY", "bad symbol!"]), ("map", {"tickers": ["a", "b", "A"]})):
        (tmp_path / name).write_text(json.dumps(value))
    assert [tuple(r) for r in io.read_universe(spark, f"{tmp_path}/list").orderBy("pos").collect()] == [(0, "SPY"), (1, "QQQ")]
    assert [r["ticker"] for r in io.read_universe(spark, f"{tmp_path}/map").orderBy("pos").collect()] == ["A", "B"]


def test_ledger_keeps_corrupt_lines_apart(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    schema = "trial string, family string, relative_mae double, median_relative_mae double, promotable boolean, status string, snapshot_id string, commit string, decision string"
    io.append_ledger(spark.createDataFrame([("t1", "ridge", 0.7, 0.9, True, None, "unknown", "c", None)], schema), path)
    row = io.read_ledger(spark, path).first()
    assert (row["relative_mae"], row["decision"], row["status"], row["audited"]) == (0.9, "keep", "success", False)
    (tmp_path / "ledger" / "part-bad.json").write_text('{"trial": "t2", "fam\n')
    with pytest.raises(io.Refused):
        io.read_ledger(spark, path)
    assert io.read_ledger(spark, path, strict=False).count() == 1


def test_news_archive_refuses_disorder(spark, tmp_path):
    good = {"article_id": "1", "ticker": "spy", "title": "t", "published_at": "2024-01-01T00:00:00Z", "received_at": "2024-01-01T01:00:00Z"}
    (tmp_path / "a.json").write_text(json.dumps(good) + "\n" + json.dumps(good) + "\n")
    assert io.read_news_archive(spark, f"{tmp_path}/a.json").count() == 1
    (tmp_path / "b.json").write_text(json.dumps(good | {"received_at": "2023-01-01"}) + "\n")
    with pytest.raises(io.Refused, match="order"):
        io.read_news_archive(spark, f"{tmp_path}/b.json")


def test_export_guards_formulas(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 2.0)], "note string, price double")
    io.export_table(rows, rows.select("price"), f"{tmp_path}/out", "\t")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "'=1+1" in text and "Predicted" in text


def run(stream, mode, name, spark):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_streams_agree_with_their_batch_twins(spark, tmp_path):
    events = [(1, k, ["promote", "reject", "rollback", "insert"][k * k % 4 if k % 5 else 0], str(k % 7)) for k in range(40)]
    df = spark.createDataFrame(events, "ticker long, seq long, action string, version string")
    df.coalesce(1).write.parquet(f"{tmp_path}/events")
    live = run(jobs.pointers(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/events")), "update", "live_pointers", spark)
    assert [tuple(r) for r in live.collect()] == [(r["ticker"], r["current"], r["previous"]) for r in registry.replay(df).collect()]
    rows = spark.createDataFrame([("a", k % 3, dt.datetime(2024, 1, 1 + k // 4, k % 4), float(k)) for k in range(12)], "ticker string, id long, available_at timestamp, score double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/rows")
    windows = run(jobs.windowed_scores(stream), "complete", "live_windows", spark)
    batch = rows.groupBy("ticker", F.window("available_at", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score")).select("ticker", F.col("window.start").alias("start"), "n", "score")
    assert sorted(map(tuple, windows.collect())) == sorted(map(tuple, batch.collect()))
    assert run(jobs.deduplicated(stream, ("id",)), "append", "live_unique", spark).count() == 3


def test_forecasters_fit_and_predict(spark):
    rows = spark.createDataFrame([("s", float(k), float(k % 5), 2.0 * k + 3.0 * (k % 5) + 1.0) for k in range(60)], "series string, a double, b double, y double")
    for name, make in forecasters.CANDIDATES.items():
        model = make(("a", "b"), "y", seed=1)
        out = model.fit(rows.where("a < 50")).predict(rows.where("a >= 50"))
        assert out.count() == 10 and out.where("predicted is null").count() == 0, name
    ridge = forecasters.CANDIDATES["ridge"](("a", "b"), "y", seed=1).fit(rows).predict(rows)
    assert ridge.agg(F.max(F.abs(F.col("predicted") - F.col("y")))).first()[0] < 2.0
    assert forecasters.windows_to_columns(spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "window array<double>"), 5, 3).first()["trend_2"] == 3.0
