"""Scans: the tables of a folder, and the relations that the research operators start from."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from meridian.functions.stats import exact_sum, over_series, plain_correlation, ratio, rolling, rounded_half, total


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def price_panel(orders: DataFrame) -> DataFrame:
    """ticker, price_date, close, benchmark: daily mean order totals, by priority and of all orders."""
    day = orders.select(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("price_date"), "o_totalprice")
    sums = day.groupBy("ticker", "price_date").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    all_ = Window.partitionBy("price_date")
    return sums.select("ticker", "price_date", (F.col("s") / F.col("n")).alias("close"), (F.sum("s").over(all_) / F.sum("n").over(all_)).alias("benchmark"))


def return_series(prices: DataFrame) -> DataFrame:
    """series_id, t (from 1), price_date, ret, signal (mean of the last 5), target (the next return)."""
    w = over_series("series_id", "price_date")
    rows = prices.select(F.col("ticker").alias("series_id"), "price_date", "close")
    rows = rows.withColumn("ret", ratio(F.col("close"), F.lag("close").over(w)) - 1).where("ret is not null")
    return rows.select(
        "series_id",
        F.row_number().over(w).alias("t"),
        "price_date",
        "ret",
        rolling(F.avg, F.col("ret"), w, 5).alias("signal"),
        F.lead("ret").over(w).alias("target"),
    )


def sample_panel(spark: SparkSession) -> DataFrame:
    """A fixed panel of 48 rows for trials without data: three tickers, offsets -5 to 10."""
    import numpy as np

    rng, rows = np.random.default_rng(42), []
    for ticker in ("7203.T", "9984.T", "MOMO_FACTOR"):  # fixed values
        for offset in range(-5, 11):
            ar = float(rng.normal(0.001, 0.01))
            rows.append((ticker, "2026-01-10", offset, ar, ar * (offset + 6), float(rng.normal(0.0005, 0.008)), float(rng.normal(0.001, 0.012)), 1))
    out = spark.createDataFrame(rows, "benchmark_id string, event_date string, event_offset int, abnormal_return double, car_from_t0 double, normal_return double, actual_return double, n_events long")
    return out.withColumn("event_date", F.to_date("event_date"))


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    """The panel at ``path``, or the sample where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else sample_panel(spark)


def newest_rows(panel: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of the panels of known runs: of the newest run first, then by benchmark, date and offset."""
    rows = panel.join(runs.select("run_id", "created_at"), "run_id")
    return rows.orderBy(F.desc("created_at"), "benchmark_id", "event_date", "event_offset").limit(n)


def _binary(lineitem: DataFrame) -> bool:
    return isinstance(lineitem.schema["l_discount"].dataType, (DoubleType, FloatType))


def usual_discount(lineitem: DataFrame) -> Column:
    """0.05 as SQL has it beside the discounts: of their type beside doubles and floats, a decimal number beside decimal and whole numbers."""
    return F.lit(0.05).cast(lineitem.schema["l_discount"].dataType) if _binary(lineitem) else F.lit(Decimal("0.05"))


def candidates(lineitem: DataFrame) -> DataFrame:
    """A candidate for each supplier: ord, candidate_id, source_id, folds (its yearly values), by year, rows without a date last.

    The sums do not depend on the order of the rows: many are near zero, and their signs and halves decide what follows.
    """
    over = F.col("l_discount") - usual_discount(lineitem)
    sums = exact_sum(over) if _binary(lineitem) else F.sum(over).cast("double")
    yearly = lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(sums.alias("s"), F.count("*").alias("n"))
    value = (F.col("s") / F.col("n") * 200).alias("v")
    folds = F.transform(F.array_sort(F.collect_list(F.struct(F.col("y").isNull().alias("undated"), "y", value))), lambda x: x["v"])
    return yearly.groupBy("l_suppkey").agg(folds.alias("folds"), F.sum("n").alias("n_rows")).select(
        F.col("l_suppkey").alias("ord"),
        F.concat(F.lit("C"), F.col("l_suppkey").cast("string")).alias("candidate_id"),
        F.concat(F.lit("family"), (F.col("l_suppkey") % 7).cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("source_id"),
        "folds",
        "n_rows",
    )


def featured_candidates(lineitem: DataFrame, formula) -> DataFrame:
    """``candidates`` with run_id, formula (of the column ``ord``) and the features of a selection, to 4 places."""
    rows = lineitem.groupBy("l_suppkey").agg(plain_correlation(F.col("l_discount"), F.col("l_tax")).alias("ic"), F.avg(F.when(F.col("l_discount") > usual_discount(lineitem), 1.0).otherwise(0.0)).alias("hit"))
    out = candidates(lineitem).join(rows, F.col("ord") == F.col("l_suppkey")).drop("l_suppkey")
    f = F.col("folds")
    steps = F.transform(F.sequence(F.lit(1), F.size(f) - 1), lambda i: F.abs(F.get(f, i) - F.get(f, i - 1)))
    steps = F.array_compact(steps)
    moves = F.coalesce(F.try_divide(total(steps), F.size(steps)), F.lit(0.0))
    four = lambda c: rounded_half(F.col(c) if isinstance(c, str) else c, 4)
    return out.select(
        "*",
        F.concat(F.lit("R"), (F.col("ord") % 5).cast("string")).alias("run_id"),
        formula.alias("formula"),
        four(F.array_max(f)).alias("oos_sharpe"),
        four("ic").alias("rank_ic"),
        four(F.col("ic") * F.sqrt(F.col("n_rows").cast("double"))).alias("ic_t"),
        four("hit").alias("hit_rate"),
        four(F.when(F.size(f) > 1, moves).otherwise(0.0)).alias("turnover"),
        four((F.array_min(f) - F.array_max(f)) / 10).alias("max_drawdown"),
        four(F.least(F.lit(1.0), F.length(formula) / 40)).alias("complexity"),
        four(F.size(F.filter(f, lambda x: x > 0)) / F.size(f)).alias("regime_pass_ratio"),
    )


def export_first_keys(df: DataFrame, key: str, k: int, path: str) -> None:
    """CSV of the rows of the first k distinct keys."""
    first = df.select(key).distinct().orderBy(key).limit(k)
    df.join(first, key, "left_semi").select(*df.columns).write.mode("errorifexists").option("header", True).csv(path)


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
