"""Backtests of position series: costs, risk gate, simulation, walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.stats import clip, over_series, rolling, running, sharpe


def position_cost(position, w, bps: float):
    """|change of position| in basis points; nothing at the first row."""
    return F.coalesce(F.abs(position - F.lag(position).over(w)), F.lit(0.0)) * (bps * 1e-4)


def risk_gate(series: DataFrame, margin: float = 0.02, short: int = 5, long: int = 60, spike: float = 2.5, liquidity: int = 3, derate: float | None = None) -> DataFrame:
    """position and gate, the first that fires: crisis, margin, spike, liquidity. Where one fires the position is 0, or ``derate`` times itself."""
    w = over_series("series_id")
    sv, lv = rolling(F.stddev_samp, F.col("ret"), w, short), rolling(F.stddev_samp, F.col("ret"), w, long)
    illiquid = F.coalesce(F.col("low_liquidity"), F.lit(False)) if "low_liquidity" in series.columns else F.lit(False)
    rows = series.withColumn("_sv", sv).withColumn("_lv", lv).withColumn("_ill", illiquid)
    rows = rows.withColumn("_island", F.sum((~F.col("_ill")).cast("int")).over(running(w)))
    run = F.sum(F.col("_ill").cast("int")).over(running(over_series(["series_id", "_island"])))
    gate = (
        F.when(F.col("crisis"), "CRISIS_REGIME")
        .when(F.coalesce(F.col("_sv"), F.lit(0.0)) > margin * 0.7, "MARGIN_M2")
        .when((F.col("_lv") > 0) & (F.col("_sv") > spike * F.col("_lv")), "VOL_SPIKE")
        .when(run >= liquidity, "LIQUIDITY")
    )
    rows = rows.withColumn("gate", gate)
    full = clip(F.col("signal"), -1.0, 1.0)
    return rows.withColumn("position", F.when(F.col("gate").isNotNull(), F.lit(0.0) if derate is None else full * derate).otherwise(full)).drop("_sv", "_lv", "_ill", "_island")


def simulate(series: DataFrame, cost_bps: float = 2.0, slippage_bps: float = 2.0, most: float = 1.0) -> DataFrame:
    """position (clipped), gross, cost and net return of each row with a signal and a return."""
    w = over_series("series_id")
    rows = series.where("signal is not null and ret is not null").withColumn("position", clip(F.col("signal"), -most, most))
    rows = rows.withColumn("gross", F.col("position") * F.col("ret"))
    rows = rows.withColumn("cost", position_cost(F.col("position"), w, cost_bps) + position_cost(F.col("position"), w, slippage_bps))
    return rows.withColumn("net", F.col("gross") - F.col("cost"))


def walk_forward(series: DataFrame, train: int = 750, step: int = 5, window: int | None = None) -> DataFrame:
    """Rows after the first ``train`` of a series with their fold; a shorter series is fold 0. State restarts in each fold.

    train_from and train_to are the rows that a fold is fitted on: all before it, or the last ``window`` of them.
    """
    n = F.max("t").over(Window.partitionBy("series_id"))
    rows = series.withColumn("_n", n)
    fold = F.when(F.col("_n") > train, F.floor((F.col("t") - 1 - train) / step)).otherwise(0)
    rows = rows.withColumn("fold", fold.cast("int")).where("fold >= 0")
    last = F.when(F.col("_n") > train, train + F.col("fold") * step).otherwise(0)
    first = F.lit(1) if window is None else F.greatest(F.lit(1), last - window + 1)
    return rows.withColumn("train_from", first.cast("int")).withColumn("train_to", last.cast("int")).drop("_n")


def fold_summary(folds: DataFrame) -> DataFrame:
    """sharpe, total_return and win_rate of each fold's simulated net returns."""
    w = over_series(["series_id", "fold"])
    rows = folds.where("signal is not null").withColumn("position", clip(F.col("signal"), -1.0, 1.0))
    rows = rows.withColumn("net", F.col("position") * F.col("ret") - position_cost(F.col("position"), w, 4.0))
    return rows.groupBy("series_id", "fold").agg(
        sharpe(F.col("net")).alias("sharpe"),
        F.sum("net").alias("total_return"),
        F.avg((F.col("net") > 0).cast("double")).alias("win_rate"),
        F.min("t").alias("test_from"),
        F.max("t").alias("test_to"),
    )
