"""Upkeep of tables: quality checks, sizes, and which tables to write in partitions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANY_ROWS, MANY_BYTES = 1_000_000, 10**9  # above either, a table should be partitioned


def quality_checks(df: DataFrame, name: str, filled: list[str], present: list[str]) -> DataFrame:
    """table_name, check_name, n_rows, n_bad, passed: rows whose ``filled`` strings are null or empty, and whose ``present`` columns are null.

    One pass over the columns named; an empty table passes.
    """
    bad = {f"missing_{c}": F.col(c).isNull() | (F.col(c) == "") for c in filled} | {f"null_{c}": F.col(c).isNull() for c in present}
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count_if(x).alias(k) for k, x in bad.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).alias("n_bad")) for k in bad])).alias("c")
    return counts.select(F.lit(name).alias("table_name"), "n_rows", each).select("table_name", "c.check_name", "n_rows", "c.n_bad", (F.col("c.n_bad") == 0).alias("passed"))


def table_sizes(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """table_name, row_count, size_bytes of Parquet tables in any store that Spark reads; a missing table is left out."""
    rows = []
    for name, path in paths.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            rows.append((name, spark.read.parquet(path).count(), fs.getContentSummary(at).getLength()))
    return spark.createDataFrame(rows, "table_name string, row_count long, size_bytes long")


def partition_plan(registry: DataFrame, sizes: DataFrame) -> DataFrame:
    """The registry's open tables (status pending or migrating) with their sizes, whether to partition them now, and how to write them.

    registry(table_name, partition_key, partition_interval in months, status). A table without a size is not due.
    """
    due = F.coalesce((F.col("row_count") > MANY_ROWS) | (F.col("size_bytes") > MANY_BYTES), F.lit(False))
    hint = F.format_string("partitionBy: months since 1970 of %s, %d to a folder", "partition_key", "partition_interval")
    out = registry.where(F.col("status").isin("pending", "migrating")).join(sizes, "table_name", "left")
    return out.select("table_name", "partition_key", "row_count", "size_bytes", due.alias("due"), hint.alias("hint"))


def write_by_period(df: DataFrame, key: str, months: int, path: str) -> None:
    """``df`` in one folder for each ``months`` months of the date or time ``key``; rows without it have a folder of their own.

    No shuffle: each task writes the periods that it holds. Readers prune by ``period``, its first month.
    """
    month = (F.year(key) - 1970) * 12 + F.month(key) - 1
    start = F.add_months(F.lit("1970-01-01").cast("date"), (F.floor(month / months) * months).cast("int"))
    df.withColumn("period", F.date_format(start, "yyyy-MM")).write.partitionBy("period").parquet(path)
