"""Sinks: staged upserts into Parquet tables, with a dry run, and canonical hashes of configurations."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.operators.governance import latest, upsert


@dataclass(frozen=True)
class Table:
    """A table in versions: each write makes a new folder, and the pointer table names the current one."""

    path: str
    keys: tuple[str, ...]
    immutable: tuple[str, ...] = ()

    def read(self, spark) -> DataFrame | None:
        try:
            pointer = spark.read.parquet(f"{self.path}/_pointer").orderBy(F.desc("n")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return spark.read.parquet(f"{self.path}/{pointer.version}")

    def write(self, rows: DataFrame, dry_run: bool = False) -> DataFrame:
        """Upserts ``rows`` (of equal keys, the last by ``ord`` if there is one); unknown columns go to JSON ``extra_metrics``."""
        spark = rows.sparkSession
        old = self.read(spark)
        rows = latest(rows, list(self.keys), F.desc("ord")) if "ord" in rows.columns else rows.dropDuplicates(list(self.keys))
        if old is not None:
            extra = [c for c in rows.columns if c not in old.columns]
            if extra and "extra_metrics" in old.columns:
                rows = rows.withColumn("extra_metrics", F.to_json(F.struct(*extra)))
            for f in old.schema:
                if f.name not in rows.columns:
                    rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
            keep = {*self.keys, *self.immutable}
            rows = upsert(old, rows.select(*old.columns), list(self.keys), [c for c in old.columns if c not in keep])
        if dry_run:
            return rows
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{version}")
        n = 0 if old is None else spark.read.parquet(f"{self.path}/_pointer").count()
        spark.createDataFrame([(n, version)], "n int, version string").coalesce(1).write.mode("append").parquet(f"{self.path}/_pointer")
        return spark.read.parquet(f"{self.path}/{version}")


def config_hash(config: dict, without: tuple[str, ...] = ("description", "env")) -> str:
    """SHA-256 of the canonical JSON of a configuration."""
    kept = {k: v for k, v in config.items() if k not in without}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def run_id(source: str, batch: str) -> str:
    return f"{source}__{batch}"


def trace_id(namespace: str, run: str) -> str:
    return str(uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_URL, namespace), run))
