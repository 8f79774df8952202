"""Metric groups of series (series_id, t, ret, signal, target), one row for each series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.stats import YEAR, average_rank, correlation, over_series, ratio, running, sharpe


def predictive(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ic, rank_ic (average ranks), t, hit rate and out-of-sample R2 of the signal against the target."""
    keys = keys or ["series_id"]
    pairs = series.where("signal is not null and target is not null")
    rows = pairs.withColumn("rs", average_rank(F.col("signal"), keys)).withColumn("rt", average_rank(F.col("target"), keys))
    rows = rows.withColumn("m", F.avg("target").over(Window.partitionBy(*keys)))
    s, t = F.col("signal"), F.col("target")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.coalesce(correlation(s, t), F.lit(0.0)).alias("ic"),
        F.when(F.count("*") >= 5, F.coalesce(correlation(F.col("rs"), F.col("rt")), F.lit(0.0))).otherwise(0.0).alias("rank_ic"),
        F.avg(((s > 0) == (t > 0)).cast("double")).alias("hit_rate"),
        (1 - F.sum((t - s) * (t - s)) / F.greatest(F.sum((t - F.col("m")) * (t - F.col("m"))), F.lit(1e-12))).alias("r2_oos"),
    )
    return out.withColumn("ic_t_stat", F.col("ic") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0))) / F.sqrt(F.greatest(1 - F.col("ic") * F.col("ic"), F.lit(1e-9))))


def equity(series: DataFrame, value: str = "ret") -> DataFrame:
    """The series with equity, peak and drawdown of its compounded values."""
    w = over_series("series_id")
    rows = series.withColumn("equity", F.exp(F.sum(F.log1p(value)).over(running(w))))
    rows = rows.withColumn("peak", F.max("equity").over(running(w)))
    return rows.withColumn("drawdown", ratio(F.col("equity") - F.col("peak"), F.col("peak")))


def longest_underwater(series: DataFrame) -> DataFrame:
    """series_id, recovery_period: the longest run of rows below an earlier peak (gaps and islands)."""
    w = over_series("series_id")
    under = F.col("equity") < F.col("peak")
    rows = equity(series).withColumn("under", under).withColumn("island", F.sum((~under).cast("int")).over(running(w)))
    runs = rows.groupBy("series_id", "island").agg(F.sum(F.col("under").cast("int")).alias("n"))
    return runs.groupBy("series_id").agg(F.max("n").cast("long").alias("recovery_period"))


def portfolio(series: DataFrame) -> DataFrame:
    r = F.col("ret")
    base = series.groupBy("series_id").agg(
        F.count(r).alias("n"),
        sharpe(r).alias("sharpe"),
        F.avg(r).alias("mu"),
        F.stddev_samp(F.when(r < 0, r)).alias("down"),
        F.percentile("ret", 0.95).alias("q95"),
        F.percentile("ret", 0.05).alias("q05"),
    )
    tail = series.join(base.select("series_id", "q05"), "series_id").where("ret <= q05").groupBy("series_id").agg(F.avg("ret").alias("cvar_5"))
    low = equity(series).groupBy("series_id").agg(F.min("drawdown").alias("max_drawdown"))
    out = base.join(tail, "series_id", "left").join(low, "series_id").join(longest_underwater(series), "series_id")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "series_id",
        "sharpe",
        zero(ratio(F.col("mu") * YEAR, F.col("down") * F.sqrt(F.lit(float(YEAR))))).alias("sortino"),
        zero(ratio(F.pow(1 + F.col("mu"), F.lit(float(YEAR))) - 1, F.abs("max_drawdown"))).alias("calmar"),
        "max_drawdown",
        "recovery_period",
        zero(F.when(F.abs("q05") > 0, F.col("q95") / F.abs("q05"))).alias("tail_ratio"),
        "cvar_5",
    )


def risk(series: DataFrame) -> DataFrame:
    r = F.col("ret")
    down = F.stddev_samp(F.when(r < 0, r)) * F.sqrt(F.lit(float(YEAR)))
    return series.groupBy("series_id").agg(
        F.percentile("ret", 0.05).alias("var_5"),
        F.coalesce(down, F.lit(0.0)).alias("downside_vol"),
        F.coalesce(ratio(F.avg(r) * YEAR, down), F.lit(0.0)).alias("risk_adjusted_return"),
        F.coalesce(ratio(F.avg(r), F.var_samp(r)), F.lit(0.0)).alias("kelly_fraction"),
        F.avg(F.abs("position")).alias("position_concentration"),
    )


def trading(series: DataFrame, cost_bps: float = 2.0, slippage_bps: float = 2.0) -> DataFrame:
    """Turnover, costs, trades and win ratios of a position series."""
    w = over_series("series_id")
    rows = series.where("position is not null and ret is not null").withColumn("d", F.abs(F.col("position") - F.lag("position").over(w)))
    cost = F.col("d") * ((cost_bps + slippage_bps) * 1e-4)
    rows = rows.withColumn("cost", cost).withColumn("net", F.col("position") * F.col("ret") - F.col("cost"))
    net, d = F.col("net"), F.col("d")
    return rows.groupBy("series_id").agg(
        F.avg(d).alias("turnover"),
        F.avg("cost").alias("cost_drag"),
        F.count(F.when(d > 0.05, 1)).alias("trade_count"),
        (1.0 / F.greatest(F.avg(d), F.lit(1e-6))).alias("avg_hold_days"),
        F.coalesce(ratio(F.avg(F.when(net > 0, net)), F.abs(F.avg(F.when(net < 0, net)))), F.lit(0.0)).alias("win_loss_ratio"),
        F.avg(net).alias("expectancy"),
    )


def by_regime(series: DataFrame) -> DataFrame:
    """Sharpe of the target in and out of crises, and the lesser of the two rank ICs."""
    parts = predictive(series, ["series_id", "crisis"]).groupBy("series_id").agg(F.min("rank_ic").alias("regime_consistency"))
    r = F.col("ret")
    out = series.groupBy("series_id").agg(
        sharpe(F.when(F.col("crisis"), r)).alias("crisis_sharpe"),
        sharpe(F.when(~F.col("crisis"), r)).alias("normal_sharpe"),
        sharpe(F.when(F.col("high_vol"), r)).alias("high_vol_sharpe"),
        F.count(F.when(F.col("crisis"), 1)).alias("n_crisis"),
    )
    return out.join(parts, "series_id", "left")
