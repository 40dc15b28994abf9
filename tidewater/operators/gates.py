"""Promotion gates: predicates over score tables that say why something fails."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FoldPolicy:
    relative: float = 0.95
    scaled: float = 1.0
    wins: int = 4
    worst_fold: float = 1.25


@dataclass(frozen=True)
class UniversePolicy:
    assets: int = 12
    qualifying: int = 8
    median: float = 0.95
    catastrophic: float = 1.25
    most_catastrophic: int = 1


@dataclass(frozen=True)
class DirectionPolicy:
    balanced: float = 0.53
    better: float = 0.98
    calibration: float = 0.10
    wins: int = 4


@dataclass(frozen=True)
class ServingPolicy:
    relative: float = 0.98
    first_day: float = 1.0
    rows: int = 60
    wins: int = 4
    worst_fold: float = 1.25
    deviations: float = 4.0
    history: int = 30


def reasons(**failing: Column) -> Column:
    """Names of the conditions that hold, or whose inputs are missing, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in failing.items())), lambda x: x.isNotNull())


def decided(df: DataFrame, failing: Column) -> DataFrame:
    return df.withColumn("_why", failing).withColumn("passed", F.size("_why") == 0).withColumn("reasons", F.concat_ws(",", "_why")).drop("_why")


def _fold_reasons(policy: FoldPolicy) -> Column:
    return reasons(
        relative_mae=F.col("relative_mae") > policy.relative, relative_rmse=F.col("relative_rmse") > policy.relative,
        mase=F.col("mase") >= policy.scaled, rmsse=F.col("rmsse") >= policy.scaled,
        wins=F.col("wins") < policy.wins, worst_fold=F.col("worst_fold") > policy.worst_fold,
    )


def fold_gate(df: DataFrame, policy: FoldPolicy = FoldPolicy()) -> DataFrame:  # noqa: B008
    """df: relative_mae, relative_rmse, mase, rmsse, wins, worst_fold."""
    return decided(df, _fold_reasons(policy))


def universe_gate(df: DataFrame, policy: UniversePolicy = UniversePolicy()) -> DataFrame:  # noqa: B008
    """One row per model from rows of relative_mae, relative_rmse and passed per asset; assets without both errors are a reason of their own."""
    whole = F.col("relative_mae").isNotNull() & F.col("relative_rmse").isNotNull()
    middle = lambda c: F.percentile(F.when(whole, F.col(c)), F.lit(0.5))
    out = df.groupBy("model").agg(
        F.count(F.lit(1)).alias("assets"), F.count_if(whole).alias("complete"), F.count_if("passed").alias("qualifying"), middle("relative_mae").alias("median_mae"),
        middle("relative_rmse").alias("median_rmse"), F.count_if(whole & (F.col("relative_rmse") > policy.catastrophic)).alias("catastrophic"),
    ).withColumnRenamed("passed", "_p")
    over = lambda c: F.coalesce(F.col(c) > policy.median, F.lit(False))
    return decided(out, reasons(
        assets=F.col("assets") < policy.assets, incomplete=F.col("complete") < F.col("assets"), qualifying=F.col("qualifying") < policy.qualifying,
        median_mae=over("median_mae"), median_rmse=over("median_rmse"), catastrophic=F.col("catastrophic") > policy.most_catastrophic,
    ))


def direction_gate(df: DataFrame, policy: DirectionPolicy = DirectionPolicy()) -> DataFrame:  # noqa: B008
    """df: balanced_accuracy, brier, log_loss, base_brier, base_log_loss, ece, folds, wins (folds better than chance and than the base rate).

    With fewer folds than wins are wanted, all of them have to be won; no folds at all fail.
    """
    return decided(df, reasons(
        balanced=F.col("balanced_accuracy") < policy.balanced, brier=F.col("brier") > policy.better * F.col("base_brier"),
        log_loss=F.col("log_loss") > policy.better * F.col("base_log_loss"), ece=F.col("ece") > policy.calibration,
        wins=(F.col("folds") == 0) | (F.col("wins") < F.least(F.col("folds"), F.lit(policy.wins))),
    ))


def browser_gate(df: DataFrame, policy: ServingPolicy = ServingPolicy()) -> DataFrame:  # noqa: B008
    """df: relative_mae, relative_rmse, folds, wins and worst_fold (squared errors), first_mae, first_rmse, selected_mae, selected_rmse, rows (of the selected horizon), move, limits.

    Folds count where there are several. A horizon without errors is no reason. A move is implausible if it is beyond both
    limits, and never where history is short.
    """
    several = F.col("folds") > 1
    beaten = lambda name: F.coalesce((F.col(f"{name}_mae") >= policy.first_day) | (F.col(f"{name}_rmse") >= policy.first_day), F.lit(False))
    short = (F.col("recent_n") < policy.history) | (F.col("horizon_n") < policy.history)
    beyond = F.coalesce((F.col("move") > F.col("limit_sd")) & (F.col("move") > F.col("limit_extreme")), F.lit(False))
    return decided(df, reasons(
        relative_mae=F.col("relative_mae") >= policy.relative, relative_rmse=F.col("relative_rmse") >= policy.relative,
        wins=several & (F.col("wins") < policy.wins), worst_fold=several & (F.col("worst_fold") > policy.worst_fold), rows=F.col("rows") < policy.rows,
        first_day=beaten("first"), selected=beaten("selected"), implausible=~short & beyond,
    ))


def server_gate(df: DataFrame, folds: FoldPolicy = FoldPolicy(), policy: ServingPolicy = ServingPolicy()) -> DataFrame:  # noqa: B008
    """The fold gate's reasons first, then those for serving, which has no fold rules of its own.

    A missing horizon is a reason. A move is implausible beyond either limit; short recent history excuses both, a short
    history of the horizon the second one.
    """
    missed = lambda name: (F.col(f"{name}_mae") >= policy.first_day) | (F.col(f"{name}_rmse") >= policy.first_day)
    beyond = lambda limit, n: F.coalesce((F.col("move") > F.col(limit)) & (F.col(n) >= policy.history), F.lit(False))
    implausible = (F.col("recent_n") >= policy.history) & (F.coalesce(F.col("move") > F.col("limit_sd"), F.lit(False)) | beyond("limit_extreme", "horizon_n"))
    own = reasons(
        serving_mae=F.col("relative_mae") >= policy.relative, serving_rmse=F.col("relative_rmse") >= policy.relative, first_day=missed("first"), selected=missed("selected"),
        rows=F.col("rows") < policy.rows, implausible=F.coalesce(implausible, F.lit(False)),
    )
    return decided(df, F.concat(_fold_reasons(folds), own))


def holdout_verdict(mae: Column, rmse: Column, mae_high: Column, rmse_high: Column, limit: float = 0.98) -> Column:
    return F.when((mae < limit) & (rmse < limit) & (mae_high < 1) & (rmse_high < 1), "survives").otherwise("fails")


def windows_verdict(windows: DataFrame, keys: tuple[str, ...], limit: float = 0.98) -> DataFrame:
    """Strict majority of windows under the limit on both errors, and both pooled intervals below 1.

    windows: keys, relative_mae, relative_rmse per window and the pooled mae_high and rmse_high.
    """
    ok = (F.col("relative_mae") < limit) & (F.col("relative_rmse") < limit)
    out = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), F.count_if(ok).alias("passing"), F.max("mae_high").alias("mae_high"), F.max("rmse_high").alias("rmse_high"))
    sound = (F.col("passing") * 2 > F.col("windows")) & (F.col("mae_high") < 1) & (F.col("rmse_high") < 1)
    return out.withColumn("verdict", F.when(sound, "survives").otherwise("fails"))


def holdout_records(judged: DataFrame, windows: DataFrame, key: str, family: str, horizon: int, snapshots: DataFrame, limit: float = 0.98) -> DataFrame:
    """Ledger records of multi-window holdouts, one per key, with their windows as evidence.

    judged: key, windows, passing, verdict, mae_high, rmse_high and the pooled relative_mae and relative_rmse; windows: key,
    fold, relative_mae, relative_rmse per window; snapshots: key, snapshot_id.
    """
    ok = (F.col("relative_mae") < limit) & (F.col("relative_rmse") < limit)
    each = windows.groupBy(key).agg(
        F.max("relative_rmse").alias("worst_fold_relative_rmse"),
        F.array_sort(F.collect_list(F.struct(F.col("fold").alias("window_index"), "relative_mae", "relative_rmse", ok.alias("passes_gate")))).alias("per_window"),
    )
    survives = F.col("verdict") == "survives"
    reason = F.format_string(
        f"%d/%d windows pass the {limit} gate (majority required %d); pooled CI upper bounds mae=%.4f rmse=%.4f vs gate <1.0",
        "passing", "windows", F.floor(F.col("windows") / 2) + 1, "mae_high", "rmse_high",
    )
    return judged.join(each, key).join(snapshots.select(key, "snapshot_id"), key, "left").select(
        key, F.lit(f"holdout-{family}").alias("run_tag"), F.lit(family).alias("family"), F.lit(horizon).alias("horizon"), "snapshot_id", F.lit("success").alias("status"),
        F.col("relative_mae").alias("median_relative_mae"), F.col("relative_rmse").alias("median_relative_rmse"), "worst_fold_relative_rmse",
        F.format_string("%d/%d", "passing", "windows").alias("folds_beating_persistence"), survives.alias("promotable"), F.when(survives, "keep").otherwise("discard").alias("decision"), reason.alias("decision_reason"), "per_window",
    )


@dataclass(frozen=True)
class BrowserDirectionPolicy:
    balanced: float = 0.55
    better: float = 0.98
    rows: int = 60
    wins: int = 4
    fold_accuracy: float = 0.5


def browser_direction_gate(df: DataFrame, policy: BrowserDirectionPolicy = BrowserDirectionPolicy()) -> DataFrame:  # noqa: B008
    """df: balanced_accuracy, brier, majority (share of the larger class), n, folds, wins (folds whose balanced accuracy is above ``fold_accuracy``).

    The Brier score is measured against 1 - majority; folds count where there are several.
    """
    base = 1 - F.col("majority")
    return decided(df, reasons(
        balanced=F.col("balanced_accuracy") < policy.balanced, brier=F.when(base > 1e-9, F.col("brier") / base) >= policy.better,
        wins=(F.col("folds") > 1) & (F.col("wins") < policy.wins), rows=F.col("n") < policy.rows,
    ))
