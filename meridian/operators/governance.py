"""Governance: upserts, rule-based resolution, latest rows, audits, snapshot comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key, the first by ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """``target`` after INSERT ... ON CONFLICT (keys) DO UPDATE SET update: other columns of a known row stay.

    ``source`` must have one row for each key. The result is for a staged write: never onto what is being read.
    """
    s = source.select(*[F.col(c).alias(f"_s_{c}") for c in target.columns], F.lit(True).alias("_new"))
    t = target.withColumn("_old", F.lit(True))
    on = [F.col(k) == F.col(f"_s_{k}") for k in keys]
    both = t.join(s, on, "full_outer")
    pick = lambda c: F.when(F.col("_new") & (F.col("_old").isNull() | F.lit(c in update)), F.col(f"_s_{c}")).otherwise(F.col(c))
    return both.select(*[pick(c).alias(c) for c in target.columns])


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` and the rows of ``source`` whose keys it lacks."""
    return target.unionByName(source.select(*target.columns).join(target.select(*keys), keys, "left_anti"))


def resolve(artifacts: DataFrame, rules: DataFrame, targets: DataFrame) -> DataFrame:
    """artifact_id, status, rule_name, target_id: the first rule by priority with a match decides.

    artifacts(artifact_id, fields map), rules(rule_name, priority, source_field, pattern, target_table, is_active),
    targets(target_table, target_id, code). One match resolves, several are ambiguous, none goes on to the next rule.
    """
    r = rules.where("is_active").select("rule_name", "priority", "source_field", "pattern", "target_table")
    fields = artifacts.select("artifact_id", F.explode_outer("fields").alias("source_field", "value"))
    tried = fields.join(r, "source_field")  # a rule meets the artifacts that have its field
    tried = tried.withColumn("code", F.nullif(F.expr("regexp_extract(value, pattern, 1)"), F.lit("")))
    found = tried.join(targets, ["target_table", "code"], "left").groupBy("artifact_id", "priority", "rule_name").agg(F.count("target_id").alias("n"), F.min("target_id").alias("target_id"))
    best = latest(found, ["artifact_id"], F.when(F.col("n") > 0, F.col("priority")).asc_nulls_last(), F.desc("priority"))
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    out = best.select("artifact_id", status.alias("status"), "rule_name", F.when(F.col("n") == 1, F.col("target_id")).alias("target_id"))
    return artifacts.select("artifact_id").join(out, "artifact_id", "left").fillna("unresolved", ["status"])


def snapshot(df: DataFrame, volatile: str = r"(_at|_ts|_id)$") -> DataFrame:
    """The columns that do not match ``volatile``, doubles rounded to 10 places."""
    import re

    keep = [f for f in df.schema if not re.search(volatile, f.name)]
    return df.select(*[F.round(f.name, 10).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in keep])


def snapshot_diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """side ('removed' or 'added') and the rows that only one snapshot has, repeats counted."""
    return base.exceptAll(current).withColumn("side", F.lit("removed")).unionByName(current.exceptAll(base).withColumn("side", F.lit("added")))


def audit_rows(decided: DataFrame) -> DataFrame:
    """object_id, event_type, decision: an event for each decision, and one more for a selected one."""
    events = F.array_compact(F.array(F.concat(F.lit("decision_"), F.lower("decision")), F.when(F.col("decision") == "SELECTED", "promotion_candidate")))
    return decided.select(F.col("candidate_id").alias("object_id"), F.explode(events).alias("event_type"), "decision")
