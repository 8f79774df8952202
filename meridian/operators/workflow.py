"""Governance flows over whole tables: resolution, links, reports, artifacts, promotions and their audit events.

Each step takes and returns DataFrames, so a step handles all rows of a batch at once; ``sources.store`` writes the results.
Every step that may refuse a row gives an event for each, refused ones included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The decisions that an audit event may carry, and the states of a promotion.
DECISIONS = ("APPLIED", "REJECTED", "CONFLICTED", "DRY_RUN")
PROMOTION_STATES = ("pending", "applied", "dry_run", "rejected", "conflicted", "error")
#: A candidate's status by its decision.
STATUSES = {"SELECTED": "selected", "HOLD": "hold", "REJECTED": "rejected", "REVIEW_REQUIRED": "review_required"}
#: The rules that targets are resolved by at first: name, priority, strategy, field, table, id and code columns.
RULES = [
    ("candidate_code_direct", 10, "candidate_code", "candidate_code", "factor_candidates", "id", "name"),
    ("hypothesis_code_direct", 20, "hypothesis_code", "hypothesis_code", "hypotheses", "id", "title"),
    ("tag_candidate", 30, "tag_candidate", "artifact_tag", "factor_candidates", "id", "name"),
    ("tag_hypothesis", 40, "tag_hypothesis", "artifact_tag", "hypotheses", "id", "title"),
]
RULE_COLUMNS = "rule_name string, priority int, match_strategy string, source_field string, target_table string, target_id_col string, target_code_col string"
#: How a strategy reads the code out of its field.
PATTERNS = {"candidate_code": "^(.+)$", "hypothesis_code": "^(.+)$", "tag_candidate": "^candidate:(.+)$", "tag_hypothesis": "^hypothesis:(.+)$"}


def rule_seed(spark) -> DataFrame:
    """The first rules, active, with the pattern that ``governance.resolve`` takes."""
    rows = spark.createDataFrame(RULES, RULE_COLUMNS)
    pattern = reduce(lambda c, kv: c.when(F.col("match_strategy") == kv[0], kv[1]), PATTERNS.items(), F.when(F.lit(False), ""))
    return rows.withColumn("pattern", pattern).withColumn("is_active", F.lit(True))


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of each name in a namespace (a UUID)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def event(object_type: str, object_id: Column, phase: str, decision: Column, reason: Column, dry_run: bool = False) -> list[Column]:
    """The columns of an audit event. Its type follows from its decision; a dry run decides nothing."""
    kind = F.lit("DRY_RUN") if dry_run else decision
    return [F.lit(object_type).alias("object_type"), object_id.cast("string").alias("object_id"), F.lit(phase).alias("phase"), F.concat(F.lit("TRANSITION_"), kind).alias("event_type"), kind.alias("decision"), F.lit("DRY_RUN_MODE").alias("reason") if dry_run else reason.alias("reason")]


def to_sinks(events: DataFrame, sinks: tuple[str, ...] = ("audit_events", "run_audit")) -> DataFrame:
    """Each event once for each sink."""
    return events.withColumn("sink", F.explode(F.array(*[F.lit(s) for s in sinks])))


def checked_audit(rows: DataFrame, dry_run: bool = False) -> DataFrame:
    """``rows`` with their decision, DRY_RUN in a dry run; a decision that is not allowed ends the job with an error."""
    said = F.concat(F.lit("audit decision not allowed: "), F.coalesce("decision", F.lit("null")))
    decision = F.when(F.col("decision").isin(*DECISIONS), F.col("decision")).otherwise(F.raise_error(said))
    return rows.withColumn("decision", F.lit("DRY_RUN") if dry_run else decision)


def resolution_events(resolved: DataFrame, dry_run: bool = False) -> DataFrame:
    """An event for each artifact that ``governance.resolve`` tried."""
    decision = F.when(F.col("status") == "resolved", "APPLIED").otherwise("REJECTED")
    return resolved.select(*event("knowledge_artifacts", F.col("artifact_id"), "target_resolution", decision, F.concat(F.lit("TARGET_"), F.upper("status")), dry_run))


def links(resolved: DataFrame) -> DataFrame:
    """artifact_id, target_id, resolution_method, link_status of the resolved artifacts; others get no link."""
    return resolved.where("status = 'resolved'").select("artifact_id", "target_id", F.col("rule_name").alias("resolution_method"), F.lit("active").alias("link_status"))


def link_events(resolved: DataFrame, dry_run: bool = False) -> DataFrame:
    decision = F.when(F.col("status") == "resolved", "APPLIED").otherwise("REJECTED")
    return resolved.select(*event("artifact_links", F.col("artifact_id"), "artifact_link", decision, F.when(F.col("status") == "resolved", "LINK_CREATED").otherwise("TARGET_NOT_RESOLVED"), dry_run))


def get_or_create(parents: DataFrame, wanted: DataFrame, keys: list[str], id_col: str, namespace: str) -> DataFrame:
    """``parents`` and a row for each wanted key that they lack; its id is a UUID of the key, so that a rerun makes the same."""
    new = wanted.select(*keys).distinct().join(parents.select(*keys), keys, "left_anti")
    new = new.withColumn(id_col, uuid5(namespace, F.concat_ws("|", *keys)))
    return parents.unionByName(new, allowMissingColumns=True)


def report_markdown(title: Column, lines: list[tuple[str, Column]]) -> Column:
    """A heading and a list of names and values."""
    return F.concat(F.lit("# "), title, F.lit("\n"), *[F.concat(F.lit(f"\n- {name}: "), F.coalesce(value, F.lit("-"))) for name, value in lines])


def promote_reports(runs: DataFrame, panel: DataFrame) -> DataFrame:
    """A report for each run, from its panel: run_id, trace_id, report_title, n_events, avg_car, avg_ar, min_offset, max_offset, report_markdown, promotion_status.

    A run that is not completed is reported, and its report stays pending.
    """
    stats = panel.groupBy("run_id").agg(F.count("*").alias("n_events"), F.avg("car_from_t0").alias("avg_car"), F.avg("abnormal_return").alias("avg_ar"), F.min("event_offset").alias("min_offset"), F.max("event_offset").alias("max_offset"))
    rows = runs.join(stats, "run_id", "left").fillna(0, ["n_events"])
    title = F.concat_ws(" ", F.lit("Event study"), "run_id")
    four = lambda c: F.format_string("%.4f", F.round(c, 4))
    text = report_markdown(title, [("events", F.col("n_events").cast("string")), ("mean CAR", four(F.col("avg_car"))), ("mean AR", four(F.col("avg_ar"))), ("offsets", F.concat_ws("..", F.col("min_offset").cast("string"), F.col("max_offset").cast("string")))])
    status = F.when(F.col("status") == "completed", "applied").otherwise("pending")
    return rows.select("run_id", "trace_id", title.alias("report_title"), "n_events", "avg_car", "avg_ar", "min_offset", "max_offset", text.alias("report_markdown"), status.alias("promotion_status"))


def promote_artifacts(reports: DataFrame, namespace: str) -> DataFrame:
    """artifact_id (a UUID of trace and run), run_id, trace_id, artifact_tag, title of the applied reports; others give none."""
    name = F.concat_ws(":", "trace_id", "run_id")
    return reports.where("promotion_status = 'applied'").select(uuid5(namespace, name).alias("artifact_id"), "run_id", "trace_id", F.concat(F.lit("event_study:"), "run_id").alias("artifact_tag"), F.col("report_title").alias("title"))


def artifact_events(reports: DataFrame, dry_run: bool = False) -> DataFrame:
    ok = F.col("promotion_status") == "applied"
    return reports.select(*event("knowledge_artifacts", F.col("run_id"), "knowledge_artifact", F.when(ok, "APPLIED").otherwise("REJECTED"), F.when(ok, "REPORT_APPLIED").otherwise("REPORT_NOT_APPLIED"), dry_run))


def synced_statuses(candidates: DataFrame, decided: DataFrame) -> DataFrame:
    """``candidates`` with the status that their decision gives them; one without a decision keeps its own."""
    status = reduce(lambda c, kv: c.when(F.col("decision") == kv[0], kv[1]), STATUSES.items(), F.when(F.lit(False), ""))
    keys = [c for c in ("run_id", "candidate_id") if c in candidates.columns]
    new = decided.select(*keys, status.alias("_s")).where("_s is not null")
    return candidates.join(new, keys, "left").withColumn("status", F.coalesce("_s", "status")).drop("_s").select(*candidates.columns)


def promote_decisions(decided: DataFrame, dry_run: bool = False, target_type: str = "candidate") -> DataFrame:
    """A promotion for each eligible decision, with its payload; in a dry run it is only noted."""
    have = [c for c in ("decision", "score", "decision_rank", "review_status", "oos_sharpe", "rank_ic", "pbo") if c in decided.columns]
    return decided.where("promotion_eligible").select("run_id", "candidate_id", F.lit(target_type).alias("target_entity_type"), F.col("candidate_id").alias("target_entity_id"), F.lit("dry_run" if dry_run else "applied").alias("promotion_status"), F.to_json(F.struct(*have)).alias("payload"), F.lit(None).cast("string").alias("error_message"))


def set_promotion_status(bridges: DataFrame, changes: DataFrame) -> DataFrame:
    """``bridges`` after ``changes`` (run_id, candidate_id, new_status, error); an unknown status ends the job with an error."""
    state = F.when(F.col("new_status").isin(*PROMOTION_STATES), F.col("new_status")).otherwise(F.raise_error(F.concat(F.lit("unknown promotion status: "), F.coalesce("new_status", F.lit("null")))))
    new = changes.select("run_id", "candidate_id", state.alias("_s"), F.col("error").alias("_e"))
    rows = bridges.join(new, ["run_id", "candidate_id"], "left")
    known = F.col("_s").isNotNull()
    return rows.withColumn("promotion_status", F.coalesce("_s", "promotion_status")).withColumn("error_message", F.when(known, F.col("_e")).otherwise(F.col("error_message"))).select(*bridges.columns)


def derived_evaluations(rows: DataFrame) -> DataFrame:
    """``rows`` with cost_adj_sharpe (less a year's cost drag), score (the rank IC) and regime_tag."""
    tag = F.when(F.col("crisis_period_sharpe") < -0.5, "crisis").when(F.col("high_vol_sharpe") < 0, "high_vol").otherwise("normal")
    return rows.select("*", (F.col("sharpe") - F.abs("cost_drag") * 252).alias("cost_adj_sharpe"), F.col("rank_ic").alias("score"), tag.alias("regime_tag"))


def elapsed_seconds(start: Column, end: Column, now: Column | None = None) -> Column:
    """Seconds from ``start`` to ``end``, rounded, or to now where a run is still open."""
    last = F.coalesce(end, now if now is not None else F.current_timestamp())
    return F.round(last.cast("timestamp").cast("double") - start.cast("timestamp").cast("double")).cast("int")


def proof_summary(proofs: DataFrame) -> DataFrame:
    """total, safe_count, unsafe_count, leakage_rate, violations (their terminals), min_lag_min (of those above zero), max_lag_max."""
    safe = F.col("is_safe").cast("int")
    return proofs.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(safe), F.lit(0)).alias("safe_count"),
        F.coalesce(F.sum(1 - safe), F.lit(0)).alias("unsafe_count"),
        F.coalesce(F.avg(1 - safe), F.lit(0.0)).alias("leakage_rate"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("violation_terminals")))), ",").alias("violations"),
        F.min(F.when(F.col("min_lag") > 0, F.col("min_lag"))).alias("min_lag_min"),
        F.max("max_lag").alias("max_lag_max"),
    )
