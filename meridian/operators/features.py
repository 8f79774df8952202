"""Rolling features and masks of return series (series_id, t, ret)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.stats import YEAR, average_rank, over_series, ratio, rolling, running

TERMINALS = ("r1", "r5", "r20", "gap", "range_norm", "atr_norm", "realized_vol_20", "vol_surprise", "bb_width", "squeeze_flag", "trend_slope_20", "event_pre_drift_20", "event_surprise", "market_beta", "sector_residual")


def terminal_features(series: DataFrame) -> DataFrame:
    """The rolling terminals of series without price columns; all that has no value is 0."""
    w = over_series("series_id")
    r = F.col("ret")
    one = series.select(
        "series_id",
        "t",
        r.alias("r1"),
        rolling(F.sum, r, w, 5).alias("r5"),
        rolling(F.sum, r, w, 20).alias("r20"),
        F.lag("ret").over(w).alias("gap"),
        F.abs(r).alias("range_norm"),
        rolling(F.avg, F.abs(r), w, 14).alias("atr_norm"),
        rolling(F.stddev_samp, r, w, 20).alias("realized_vol_20"),
        rolling(F.stddev_samp, r, w, 60).alias("_vol60"),
        rolling(F.avg, r, w, 5).alias("_m5"),
        rolling(F.avg, r, w, 20).alias("_m20"),
        rolling(F.avg, r, w, 60).alias("_m60"),
        F.when(F.count(r).over(w.rowsBetween(-19, 0)) == 20, F.regr_slope(r, F.col("t").cast("double")).over(w.rowsBetween(-19, 0))).alias("trend_slope_20"),
    )
    two = one.withColumn("bb_width", ratio(2 * F.col("realized_vol_20"), F.abs("_m20"))).withColumn("_r20", F.lag("r20").over(w))
    frame = w.rowsBetween(-59, 0)
    both = (F.count("_m60").over(frame) == 60) & (F.stddev_pop("r1").over(frame) * F.stddev_pop("_m60").over(frame) > 0)
    beta = F.when(both, F.try_divide(F.covar_pop("r1", "_m60").over(frame), F.stddev_pop("r1").over(frame) * F.stddev_pop("_m60").over(frame)))
    three = (
        two.withColumn("vol_surprise", ratio(F.col("realized_vol_20"), F.col("_vol60")) - 1)
        .withColumn("squeeze_flag", F.coalesce((F.col("bb_width") < rolling(F.avg, F.col("bb_width"), w, 50)).cast("double"), F.lit(0.0)))
        .withColumn("event_pre_drift_20", F.col("_r20"))
        .withColumn("event_surprise", F.col("r1") - F.col("_m60"))
        .withColumn("market_beta", F.coalesce(beta, F.lit(1.0)))
        .withColumn("sector_residual", F.col("r1") - F.col("market_beta") * F.col("_m5"))
    )
    return three.select("series_id", "t", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in TERMINALS])


def price_oscillator(series: DataFrame, value: str = "close", fast: int = 12, slow: int = 26) -> DataFrame:
    """series_id, t, ppo = (fast - slow) / |slow| of exponential means; the recursion runs in one pass for each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        a, b = (pdf[value].ewm(span=n, adjust=False).mean() for n in (fast, slow))
        return pd.DataFrame({"series_id": pdf["series_id"], "t": pdf["t"], "ppo": ((a - b) / b.abs().where(b != 0)).fillna(0.0)})

    return series.select("series_id", "t", value).groupBy("series_id").applyInPandas(run, "series_id string, t int, ppo double")


def regime_masks(series: DataFrame, vol: float = 0.30, drawdown: float = -0.15, window: int = 20, quantile: float = 0.75) -> DataFrame:
    """crisis (annualised rolling volatility or drawdown) and high_vol (above the series' own quantile)."""
    w = over_series("series_id")
    v = rolling(F.stddev_samp, F.col("ret"), w, window)
    rows = series.withColumn("vol", v * F.sqrt(F.lit(float(YEAR)))).withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(running(w))))
    rows = rows.withColumn("dd", ratio(F.col("equity"), F.max("equity").over(running(w))) - 1)
    top = rows.groupBy("series_id").agg(F.percentile("vol", quantile).alias("_q"))
    rows = rows.join(top, "series_id")
    crisis = F.coalesce(F.col("vol") >= vol, F.lit(False)) | F.coalesce(F.col("dd") <= drawdown, F.lit(False))
    return rows.select("series_id", "t", "ret", "signal", "target", crisis.alias("crisis"), F.coalesce(F.col("vol") >= F.col("_q"), F.lit(False)).alias("high_vol"))


def low_liquidity(series: DataFrame, volume: str, share: float = 0.5, window: int = 20) -> DataFrame:
    w = over_series("series_id")
    return series.withColumn("low_liquidity", F.coalesce(F.col(volume) < share * rolling(F.avg, F.col(volume), w, window), F.lit(False)))


def event_window_mask(series: DataFrame, flag: str = "is_event", before: int = 5, after: int = 20) -> DataFrame:
    """event_mask: within ``before`` rows before or ``after`` rows after a flagged row."""
    w = over_series("series_id").rowsBetween(-after, before)
    return series.withColumn("event_mask", F.coalesce(F.max(F.col(flag).cast("int")).over(w) == 1, F.lit(False)))


def pre_event_drift(series: DataFrame, window: int = 20) -> DataFrame:
    s = rolling(F.sum, F.col("ret"), over_series("series_id"), window)
    return series.withColumn("pre_event_drift", F.when(F.col("event_mask"), s).otherwise(0.0))


def rank_normalize(df: DataFrame, value: str, key: str) -> DataFrame:
    """``value`` as its average rank among its key's values, on [-0.5, 0.5]; 0 for a single one."""
    n = F.count(value).over(Window.partitionBy(key))
    r = average_rank(F.col(value), [key])
    out = F.when(F.col(value).isNotNull(), F.when(n > 1, (r - 1) / (n - 1) - 0.5).otherwise(0.0))
    return df.withColumn("normalized", out)


def select_terminals(df: DataFrame, names: list[str], keep: tuple[str, ...] = ("series_id", "t")) -> DataFrame:
    """The named terminals; one that is missing is 0."""
    return df.select(*keep, *[F.col(n) if n in df.columns else F.lit(0.0).alias(n) for n in names])
