"""Gates, summaries and names against values worked out by hand."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tidewater.operators import evidence as E
from tidewater.operators import gates, metrics, registry
from tidewater.plans.evidence import fold_gate_rows
from tidewater.operators.samples import Study


def reasons(df):
    return [r["reasons"] for r in df.orderBy("k").collect()]


SERVED = "k int, relative_mae double, relative_rmse double, folds long, wins long, worst_fold double, first_mae double, first_rmse double, selected_mae double, selected_rmse double, rows long, move double, limit_sd double, limit_extreme double, recent_n long, horizon_n long"
GOOD = (0.9, 0.9, 5, 4, 1.2, 0.9, 0.9, 0.9, 0.9, 60, 0.1, 0.2, 0.2, 60, 60)


def changed(k, **new):
    names = [x.split()[0] for x in SERVED.split(", ")][1:]
    return (k, *(new.get(n, v) for n, v in zip(names, GOOD, strict=True)))


def test_browser_gate(spark):
    cases = [
        ({}, ""), ({"relative_mae": 0.98}, "relative_mae"), ({"first_rmse": 1.0}, "first_day"), ({"selected_mae": 1.0}, "selected"), ({"first_mae": None}, ""),
        ({"wins": 3}, "wins"), ({"wins": 0, "folds": 1, "worst_fold": 9.0}, ""), ({"worst_fold": 1.26}, "worst_fold"), ({"rows": 59}, "rows"),
        ({"move": 0.3}, "implausible"), ({"move": 0.3, "limit_extreme": 0.4}, ""), ({"move": 0.3, "horizon_n": 29}, ""), ({"move": None}, ""), ({"relative_rmse": None}, "relative_rmse"),
    ]
    df = spark.createDataFrame([changed(k, **new) for k, (new, _) in enumerate(cases)], SERVED)
    assert reasons(gates.browser_gate(df)) == [why for _, why in cases]


def test_server_gate(spark):
    cases = [
        ({}, ""), ({"wins": 0}, "wins"), ({"first_mae": None}, "first_day"), ({"selected_rmse": 1.0}, "selected"), ({"relative_mae": 0.96}, "relative_mae"), ({"relative_mae": 0.98}, "relative_mae,serving_mae"),
        ({"move": 0.3, "limit_extreme": 0.4}, "implausible"), ({"move": 0.3, "limit_sd": 0.4}, "implausible"), ({"move": 0.3, "limit_sd": 0.4, "horizon_n": 29}, ""), ({"move": 0.3, "recent_n": 29}, ""),
    ]
    df = spark.createDataFrame([changed(k, **new) for k, (new, _) in enumerate(cases)], SERVED).withColumns({"mase": F.lit(0.5), "rmsse": F.lit(0.5)})
    assert reasons(gates.server_gate(df)) == [why for _, why in cases]


def test_universe_gate_counts_squared_errors_and_gaps(spark):
    rows = [("m", 0.9, 0.9, True)] * 8 + [("m", 0.9, 0.9, False)] * 2 + [("m", 9.0, 1.25, False), ("m", 0.9, 1.3, False)]
    schema = "model string, relative_mae double, relative_rmse double, passed boolean"
    one = lambda rows: gates.universe_gate(spark.createDataFrame(rows, schema)).first()
    good = one(rows)
    assert (good["passed"], good["catastrophic"], good["median_mae"]) == (True, 1, 0.9)
    assert one([*rows, ("m", 0.9, 1.3, False)])["reasons"] == "catastrophic"
    assert one([*rows, ("m", 0.9, None, False)])["reasons"] == "incomplete"
    assert one(rows[1:])["reasons"] == "assets,qualifying"


def test_folds_are_won_on_both_errors(spark):
    # Persistence errs by 10 and 10; the model by 1 and 17: better on average (9), worse squared.
    rows = [(m, "s", 0, 1, s, 100.0, 110.0, p, 5) for s, (a, b) in enumerate(((100.0, 109.0), (100.0, 93.0))) for m, p in (("persistence", a), ("drift", b))]
    scored = spark.createDataFrame(rows, "model string, series string, fold long, horizon long, s long, origin double, actual double, predicted double, train_hi long")
    source = spark.createDataFrame([("s", dt.date(2020, 1, k + 1), 100.0 + k % 2) for k in range(9)], "series string, session date, close double")
    found = fold_gate_rows(scored, source, Study(lookback=2, horizons=(1,), folds=1)).first()
    assert (found["folds"], found["wins"], found["wins_rmse"]) == (1, 0, 0)
    assert round(found["worst_fold"], 6) == round(((1 + 289) / 2) ** 0.5 / 10, 6) and found["relative_mae"] == 0.9 and found["rows"] == 2


def test_browser_direction_gate(spark):
    schema = "k int, balanced_accuracy double, brier double, majority double, n long, folds long, wins long"
    rows = [(0, 0.55, 0.29, 0.7, 60, 5, 4), (1, 0.5499, 0.29, 0.7, 60, 5, 4), (2, 0.6, 0.295, 0.7, 59, 5, 4), (3, 0.6, 0.29, 0.7, 60, 5, 3), (4, 0.6, 0.29, 0.7, 60, 1, 0), (5, 0.6, 0.0, 1.0, 60, 5, 4)]
    assert reasons(gates.browser_direction_gate(spark.createDataFrame(rows, schema))) == ["", "balanced", "brier,rows", "wins", "", "brier"]


def test_fold_summary_needs_both_medians_and_all_folds_but_one(spark):
    rows = [(k, *r) for k, folds in enumerate((
        [(0.9, 0.9)] * 3 + [(1.2, 1.25), (0.9, 0.9)], [(0.9, 0.9)] * 3 + [(0.9, 1.0)] * 2, [(0.98, 0.9)] * 5, [(0.5, 0.98)] * 5, [(0.9, 0.9)] * 4 + [(0.1, 1.26)], [(0.9, 0.9)], [(0.9, 1.1)],
    )) for r in folds]
    df = spark.createDataFrame(rows, "k int, relative_mae double, relative_rmse double")
    found = metrics.fold_summary(df, ("k",)).orderBy("k").collect()
    assert [r["promotable"] for r in found] == [True, False, False, False, False, True, False]
    assert [r["wins"] for r in found] == [4, 3, 5, 5, 4, 1, 0] and found[0]["worst_relative_rmse"] == 1.25


def test_seeds_have_one_status_and_keep_equal_failures(spark):
    rows = [("a", 0, None, 1.0, 0.2), ("a", 1, None, 3.0, 0.6), ("a", 2, "E: x", 9.0, None), ("a", 3, "E: x", None, None), ("a", 4, None, float("nan"), 0.4), ("b", 0, "E: y", None, None)]
    df = spark.createDataFrame(rows, "m string, seed int, error string, mae double, direction double")
    found = {(r["m"], r["metric"]): r for r in metrics.seed_spread(df, ("m",), ("mae", "direction"), ("direction",)).collect()}
    mae, direction = found["a", "mae"], found["a", "direction"]
    assert (mae["seeds"], mae["failed"], mae["used"], mae["mean"], mae["median"], mae["spread"], mae["best"], mae["worst"]) == (5, 2, 2, 2.0, 2.0, 1.0, 1.0, 3.0)
    assert (direction["used"], direction["best"], direction["worst"]) == (3, 0.6, 0.2)
    assert mae["status"] == "partial" and mae["failures"] == "seed 2: E: x; seed 3: E: x"
    assert found["b", "mae"]["status"] == "crash" and found["b", "mae"]["mean"] is None


def test_browser_figures_at_their_edges(spark):
    rows = [("near", 20_000 + 0.4 * (k % 2), 20_000.4 - 0.4 * (k % 2), 1.0) for k in range(200)] + [("flat", 5.0, 4.0, 5.0)] * 3 + [("zero", 0.0, 1.0, 2.0)] * 2
    df = spark.createDataFrame(rows, "k string, actual double, predicted double, baseline double")
    found = {r["k"]: r for r in metrics.browser_regression(df, ("k",)).collect()}
    assert round(found["near"]["r2"], 6) == -3.0 and found["flat"]["r2"] == 0.0
    assert found["flat"]["relative_mae"] is None and found["zero"]["mape"] is None and found["zero"]["relative_rmse"] == 0.5


def test_legacy_direction_with_one_horizon(spark):
    rows = [("m", s, 1, a, p) for s, (a, p) in enumerate(((1.0, 1.0), (2.0, 3.0), (1.0, 4.0), (1.0, 4.0)))]
    df = spark.createDataFrame(rows, "model string, s long, horizon long, actual double, predicted double")
    assert round(metrics.legacy_holdout(df, ("model",), 1, 1).first()["direction"], 6) == round(2 / 3, 6)


def test_residual_drift_takes_its_block_from_the_shorter_half(spark):
    rows = [("s", k, 1.0 if k < 9 else 2.0) for k in range(19)] + [("few", k, 1.0) for k in range(9)]
    found = E.residual_drift(spark.createDataFrame(rows, "series string, s long, e double"), ("series",), "s", "e", 50).collect()
    assert [(r["series"], r["mean_1"], r["mean_2"], r["drift"]) for r in found] == [("s", 1.0, 2.0, True)]


def test_version_names(spark):
    one = lambda *c: spark.range(1).select(registry.version_id(*c).alias("v")).select("v", registry.known_version(F.col("v"))).first()
    when = F.lit("2024-03-01 12:30:45").cast("timestamp")
    assert tuple(one(F.lit("BRK.B"), F.lit("price"), when, F.lit("0123456789abcdef"), F.lit("sha256:00FFAB1234567Ab"))) == ("BRK.B-price-20240301T123045Z-0123456789ab-234567ab", True)
    assert one(F.lit("SPY"), F.lit("direction"), when, F.lit(None).cast("string"), F.lit("xyz-12"))[0] == "SPY-direction-20240301T123045Z-unknown-00000012"
    assert one(F.lit("SPY"), F.lit("price"), when, F.lit(""), F.lit("unknown"))[0].endswith("Z-unknown-unknown")
    assert one(F.lit("spy"), F.lit("price"), when, F.lit(""), F.lit(None).cast("string"))[1] is False
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(F.lit("SPY"), F.lit("price"), F.lit("2024-03-01 12:30:45Z").cast("timestamp"), F.lit(""), F.lit(""))[0].startswith("SPY-price-20240301T123045Z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ledger_prefers_medians_and_known_provenance(spark):
    rows = [(0.5, 0.9, "sha", "c"), (0.5, None, "", "c"), (None, 0.8, None, "c"), (0.5, 0.6, "sha", "unknown")]
    df = spark.createDataFrame(rows, "relative_mae double, median_relative_mae double, snapshot_id string, commit string").withColumns({"promotable": F.lit(True), "decision": F.lit(None).cast("string"), "status": F.lit(None).cast("string")})
    assert [(r["relative_mae"], r["audited"]) for r in registry.ledger_defaults(df).collect()] == [(0.9, True), (0.5, False), (0.8, False), (0.6, False)]


def test_replay_refuses_what_pointers_forbid(spark):
    log = [("t", k, *e) for k, e in enumerate((
        ("promote", "a"), ("reject", "a"), ("promote", "b"), ("prune", "a"), ("prune", "c"), ("promote", "c"), ("reject", "a"), ("promote", "a"), ("rollback", "x"), ("promote", "b"), ("rollback", "x"), ("promote", "d"), ("promote", "a"),
    ))]
    found = registry.replay(spark.createDataFrame(log, "ticker string, seq int, action string, version string")).first()
    # a can't be rejected as current nor pruned as previous; c is pruned; a is rejected as previous, restored by rollback, and so free again.
    assert (found["current"], found["previous"]) == ("a", "d")


def test_divergence_weighs_rows_and_names_constants(spark):
    rows = [(float(k), 7.0, k % 2 == 0, 1 + k % 3) for k in range(60)] + [(30.0, 9.0, False, 0)]
    df = spark.createDataFrame(rows, "a double, flat double, ref boolean, times int")
    found = E.divergence(df, ("a", "flat"), F.col("ref"), (), F.col("times")).first()
    spread = [(float(k), k % 2 == 0) for k in range(60) for _ in range(1 + k % 3)]
    plain = E.psi(spark.createDataFrame([("a", v, r) for v, r in spread], "f string, v double, r boolean"), "f", "v", F.col("r")).first()
    assert found["degenerate"] == "flat" and abs(found["max_psi"] - plain["psi"]) < 1e-12 and found["mean_psi"] == found["max_psi"]
    # Two bins, half and half against one and three quarters of four.
    half = spark.createDataFrame([("f", v, True) for v in (0.0, 1.0, 2.0)] + [("f", v, False) for v in (0.0, 1.5, 1.6, 1.7)], "f string, v double, r boolean")
    a = [(1 + 1e-4) / (3 + 2e-4), (2 + 1e-4) / (3 + 2e-4)]
    b = [(1 + 1e-4) / (4 + 2e-4), (3 + 1e-4) / (4 + 2e-4)]
    assert abs(E.psi(half, "f", "v", F.col("r"), bins=2).first()["psi"] - sum((y - x) * math.log(y / x) for x, y in zip(a, b, strict=True))) < 1e-12
