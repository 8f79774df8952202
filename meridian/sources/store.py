"""The engine's tables in one folder: their columns and keys, typed upserts, whole-run writes, JSON columns, policies.

A table is a ``sinks.Table``: each write makes a new version, and readers see it when the pointer names it. A run's tables
are all written before any pointer moves, so a failure leaves every table as it was and the run marked as failed.
"""

from __future__ import annotations

import dataclasses
import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from meridian.functions.stats import finite
from meridian.operators.selection import Config
from meridian.operators.workflow import synced_statuses
from meridian.sources.sinks import Table, config_hash, run_id, trace_id

#: Columns, keys and the columns that an update leaves alone, of each table.
TABLES: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "summary_runs": ("run_id string, trace_id string, source_name string, batch_label string, status string, total_events long, run_metadata string", ("run_id",), ()),
    "summaries": ("run_id string, benchmark_id string, event_date date, event_offset int, abnormal_return double, car_from_t0 double, normal_return double, actual_return double, n_events long, extra_metrics string", ("run_id", "benchmark_id", "event_date", "event_offset"), ()),
    "discovery_runs": ("run_id string, trace_id string, status string, n_candidates long, run_metadata string", ("run_id",), ()),
    "discovery_candidates": ("candidate_id string, run_id string, tree string, expression string, fitness double, status string, run_metadata string", ("candidate_id",), ("run_id",)),
    "discovery_evaluations": ("candidate_id string, fold_id string, rank_ic double, sharpe double, cost_adj_sharpe double, score double, regime_tag string, metadata string", ("candidate_id", "fold_id"), ("regime_tag",)),
    "backtest_runs": ("run_id string, candidate_id string, sharpe double, total_return double, status string, run_metadata string", ("run_id",), ()),
    "backtest_folds": ("run_id string, candidate_id string, fold int, sharpe double, total_return double, win_rate double", ("run_id", "candidate_id", "fold"), ()),
    "runs": ("run_id string, trace_id string, batch_label string, status string, dry_run boolean, policy_hash string, error_message string, run_metadata string", ("run_id",), ()),
    "candidates": ("run_id string, candidate_id string, source_id string, formula string, status string", ("run_id", "candidate_id"), ()),
    "evaluations": ("run_id string, candidate_id string, score double, gate_passed boolean, oos_sharpe double, rank_ic double, pbo double, extra_metrics string", ("run_id", "candidate_id"), ()),
    "decisions": ("run_id string, candidate_id string, decision string, decision_rank int, promotion_eligible boolean, near_duplicate_of string, review_status string", ("run_id", "candidate_id"), ()),
    "promotions": ("run_id string, candidate_id string, target_entity_type string, target_entity_id string, promotion_status string, payload string, error_message string", ("run_id", "candidate_id"), ()),
    "rules": ("rule_name string, priority int, match_strategy string, source_field string, target_table string, target_id_col string, target_code_col string, pattern string, is_active boolean", ("rule_name",), ()),
    "resolutions": ("artifact_id string, status string, rule_name string, target_id string", ("artifact_id",), ()),
    "links": ("artifact_id string, target_id string, resolution_method string, link_status string", ("artifact_id", "target_id"), ()),
    "audit_events": ("object_type string, object_id string, phase string, event_type string, decision string, reason string, sink string", ("object_type", "object_id", "phase", "event_type", "sink"), ()),
    "causal_results": ("run_id string, candidate_id string, result string", ("run_id", "candidate_id"), ()),
    "policies": ("policy_hash string, spec_json string, engine_version string, phase_tag string, description string, first_seen_at timestamp, used_at timestamp", ("policy_hash",), ("spec_json", "engine_version", "phase_tag", "description", "first_seen_at")),
}
RUN_STATES = ("running", "completed", "failed", "dry_run")


def json_safe(x):
    """``x`` as plain JSON values: numbers that are not finite are None, keys are text, sets are sorted lists, other objects their text."""
    if hasattr(x, "item") and not isinstance(x, (list, dict, str)):
        x = x.item()
    if x is None or isinstance(x, (bool, int, str)):
        return x
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, Mapping):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (set, frozenset)):
        return sorted((json_safe(v) for v in x), key=str)
    if isinstance(x, (list, tuple)):
        return [json_safe(v) for v in x]
    return str(x)


def merged(json_col: str, patch: Column) -> Column:
    """A JSON object column with the entries of a JSON object column ``patch`` added; those of ``patch`` win."""
    kind = "map<string,string>"
    raw = lambda c: F.coalesce(F.from_json(c, kind), F.create_map().cast(kind))
    old, new = raw(F.col(json_col)), raw(patch)
    both = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    # values that are JSON objects, arrays, numbers or truth values stay so; others are text
    plain = F.transform(F.map_entries(both), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), _literal(e["value"])))
    return F.concat(F.lit("{"), F.array_join(plain, ","), F.lit("}"))


def _literal(v: Column) -> Column:
    quoted = F.to_json(F.array(v))
    quoted = quoted.substr(F.lit(2), F.length(quoted) - 2)
    bare = v.rlike(r"^(?:[\[{].*[\]}]|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$")
    return F.when(v.isNull(), "null").when(bare, v).otherwise(quoted)


@dataclasses.dataclass(frozen=True)
class Store:
    """The tables of a folder."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> Table:
        _, keys, immutable = TABLES[name]
        return Table(f"{self.folder}/{name}", keys, immutable)

    def exists(self, name: str) -> bool:
        return self.table(name).read(self.spark) is not None

    def columns(self, name: str) -> DataFrame:
        """column_name, data_type, position of a table's columns."""
        df = self.read(name)
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema, 1)], "column_name string, data_type string, position int")

    def read(self, name: str) -> DataFrame:
        """The current rows; none before the first write."""
        found = self.table(name).read(self.spark)
        return self.spark.createDataFrame([], TABLES[name][0]) if found is None else found

    def conform(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` in the table's columns: numbers that are not finite and missing columns are NULL, unknown columns go to JSON ``extra_metrics`` where the table has it."""
        schema = StructType.fromDDL(TABLES[name][0])
        extra = [c for c in rows.columns if c not in schema.names]
        out = []
        for f in schema:
            if f.name == "extra_metrics" and extra and f.name not in rows.columns:
                c = F.to_json(F.struct(*extra))
            elif f.name not in rows.columns:
                c = F.lit(None).cast(f.dataType)
            elif isinstance(f.dataType, (DoubleType, FloatType)):
                c = finite(F.col(f.name)).cast(f.dataType)
            else:
                c = F.col(f.name).cast(f.dataType)
            out.append(c.alias(f.name))
        return rows.select(*out)

    def write(self, name: str, rows: DataFrame, dry_run: bool = False) -> DataFrame:
        """Upserts ``rows``; in a dry run nothing is written and the result is what would be."""
        return self.table(name).write(self.conform(name, rows), dry_run)

    def mark_run(self, name: str, run: str, status: str, reason: str | None = None) -> None:
        """Sets a run's status; a failure's reason joins its metadata."""
        if status not in RUN_STATES:
            raise ValueError(f"unknown status {status!r}")
        rows = self.read(name).where(F.col("run_id") == run).withColumn("status", F.lit(status))
        if reason is not None:
            rows = rows.withColumn("run_metadata", merged("run_metadata", F.lit(json.dumps({"failure_reason": reason}))))
            if "error_message" in rows.columns:
                rows = rows.withColumn("error_message", F.lit(reason))
        self.write(name, rows)

    def write_run(self, run: DataFrame, candidates: DataFrame, evaluations: DataFrame, decisions: DataFrame, dry_run: bool = False) -> None:
        """A whole run in the order of its dependencies, candidates with the status of their decisions; ``run`` is one row.

        A failure marks the run as failed with its reason and is raised again; what was written by then stays, and a rerun upserts it.
        """
        one = run.first()
        if dry_run:
            for name, rows in (("runs", run), ("candidates", candidates), ("evaluations", evaluations), ("decisions", decisions)):
                self.conform(name, rows).head(1)
            return
        self.write("runs", run.withColumn("status", F.lit("running")))
        try:
            have = candidates if "status" in candidates.columns else candidates.withColumn("status", F.lit(None).cast("string"))
            self.write("candidates", synced_statuses(have, decisions))
            self.write("evaluations", evaluations)
            self.write("decisions", decisions)
        except Exception as e:
            self.mark_run("runs", one.run_id, "failed", type(e).__name__)
            raise
        self.mark_run("runs", one.run_id, "completed")

    def merge_json(self, name: str, column: str, patches: DataFrame) -> None:
        """Merges ``patch`` (a JSON object) into a JSON column of the rows with the same keys; rows that are not there stay away."""
        keys = [k for k in TABLES[name][1] if k in patches.columns]
        rows = self.read(name).join(patches.select(*keys, "patch"), keys)
        self.write(name, rows.withColumn(column, merged(column, F.col("patch"))).drop("patch"))

    def save_proofs(self, proofs: DataFrame) -> None:
        """proofs(candidate_id, is_safe, looks_ahead, violation_terminals, ...): into the candidates' metadata under safety_proof, is_safe and so on."""
        patch = F.to_json(F.struct(F.struct(*[c for c in proofs.columns if c != "candidate_id"]).alias("safety_proof"), F.col("is_safe"), F.col("looks_ahead").alias("future_dependency_flag"), F.col("violation_terminals")))
        self.merge_json("discovery_candidates", "run_metadata", proofs.select("candidate_id", patch.alias("patch")))

    def proofs(self) -> DataFrame:
        """candidate_id, run_id, safety_proof (JSON, NULL where none is saved)."""
        return self.read("discovery_candidates").select("candidate_id", "run_id", F.get_json_object("run_metadata", "$.safety_proof").alias("safety_proof"))

    def save_causal(self, rows: DataFrame) -> None:
        """rows(run_id, candidate_id, ...): the rest of each row as one JSON result."""
        rest = [c for c in rows.columns if c not in ("run_id", "candidate_id")]
        self.write("causal_results", rows.select("run_id", "candidate_id", F.to_json(F.struct(*rest)).alias("result")))

    def causal(self, schema: str) -> DataFrame:
        """run_id, candidate_id and the fields of ``schema`` of the saved results."""
        return self.read("causal_results").select("run_id", "candidate_id", F.from_json("result", schema).alias("r")).select("run_id", "candidate_id", "r.*")

    # --- policies ---

    def save_policy(self, policy: dict, engine_version: str = "", phase_tag: str = "", description: str = "", dry_run: bool = False) -> str:
        """Saves a policy and returns its hash. One that is known keeps its row; only ``used_at`` is touched."""
        validate(policy)
        name = config_hash(json_safe(policy))
        if not dry_run:
            row = [(name, json.dumps(json_safe(policy), sort_keys=True), engine_version, phase_tag, description)]
            rows = self.spark.createDataFrame(row, "policy_hash string, spec_json string, engine_version string, phase_tag string, description string")
            self.write("policies", rows.withColumn("first_seen_at", F.current_timestamp()).withColumn("used_at", F.current_timestamp()))
        return name

    def policy(self, policy_hash: str) -> dict | None:
        row = self.read("policies").where(F.col("policy_hash") == policy_hash).select("spec_json").first()
        return None if row is None else json.loads(row[0])

    def policy_of_run(self, run: str) -> dict | None:
        """The policy that a run names."""
        rows = self.read("runs").where(F.col("run_id") == run).join(self.read("policies"), "policy_hash").select("spec_json").first()
        return None if rows is None else json.loads(rows[0])

    def policies(self, phase_tag: str | None = None, engine_version: str | None = None, limit: int = 20) -> DataFrame:
        """The latest used policies, filtered."""
        rows = self.read("policies")
        for c, v in (("phase_tag", phase_tag), ("engine_version", engine_version)):
            rows = rows if v is None else rows.where(F.col(c) == v)
        return rows.orderBy(F.desc("used_at"), "policy_hash").limit(limit)


#: The parts of a policy and the fields of a configuration that they hold.
SELECTION = ("top_k", "promotion_top_k", "max_same_family", "review_margin")


def to_policy(config: Config) -> dict:
    """A configuration as a policy of three parts: weights, hard_gates, selection."""
    x = dataclasses.asdict(config)
    return {"weights": {k: v for k, v in x.items() if k.startswith("w_")}, "hard_gates": {k: v for k, v in x.items() if not k.startswith("w_") and k not in SELECTION}, "selection": {k: x[k] for k in SELECTION}}


def from_policy(policy: dict) -> Config:
    """The configuration of a policy; fields that it lacks keep their defaults, unknown ones are an error."""
    flat = {k: v for part in ("weights", "hard_gates", "selection") for k, v in policy.get(part, {}).items()}
    return Config(**flat)


def validate(policy: dict) -> None:
    """Raises ValueError with all that is wrong: weights below zero, shares outside of 0..1, limits below one, more promotions than selections."""
    c = from_policy(policy)
    wrong = [f"{k}={v} is below 0" for k, v in dataclasses.asdict(c).items() if k.startswith("w_") and v < 0]
    wrong += [f"{k}={getattr(c, k)} is outside of 0..1" for k in ("pbo_threshold", "max_drawdown", "min_regime_pass_ratio", "max_complexity_score", "min_selection_stability") if not 0 <= getattr(c, k) <= 1]
    wrong += [f"{k}={getattr(c, k)} is below 1" for k in ("top_k", "promotion_top_k") if getattr(c, k) < 1]
    if c.promotion_top_k > c.top_k:
        wrong.append(f"promotion_top_k={c.promotion_top_k} is above top_k={c.top_k}")
    if wrong:
        raise ValueError("policy: " + "; ".join(wrong))


@dataclasses.dataclass(frozen=True)
class RunContext:
    """Who a run is: its ids and the policy that it follows."""

    run_id: str
    trace_id: str
    policy_hash: str
    batch_label: str
    dry_run: bool = False

    @classmethod
    def of(cls, source: str, batch: str, config: Config, namespace: str = "selection", dry_run: bool = False) -> RunContext:
        run = run_id(source, batch)
        return cls(run, trace_id(namespace, run), config_hash(json_safe(to_policy(config))), batch, dry_run)

    def row(self, spark: SparkSession) -> DataFrame:
        rows = [(self.run_id, self.trace_id, self.batch_label, self.dry_run, self.policy_hash)]
        return spark.createDataFrame(rows, "run_id string, trace_id string, batch_label string, dry_run boolean, policy_hash string")
