"""Governance flows, stores and deduplication against plain Python."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from meridian.operators import dedup, governance, selection, workflow
from meridian.sources import store as stores
from meridian.sources.store import Store


def greedy_list(rows, alike):
    """rows (id, ...) in list order: who is suppressed by whom."""
    gone = {}
    for i, x in enumerate(rows):
        if x[0] in gone:
            continue
        for y in rows[i + 1 :]:
            if y[0] not in gone and alike(x, y):
                gone[y[0]] = x[0]
    return gone


def prefix(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n / max(len(a), len(b))


def jaccard(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = (set(t.replace("(", " ").replace(")", " ").split()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_structural_dedup(spark, least):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(9)]
    rows = []
    for k in range(60):
        text = rnd.choice([None, "", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))), "f(" + " ".join(rnd.choice(words) for _ in range(3)) + ")"])
        rows.append((f"c{k:02}", k, text, rnd.choice([None, "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 8))), "abababababababababab" + rnd.choice("ab"), f"{k:08}"])))
    df = spark.createDataFrame(rows, "candidate_id string, ord int, formula string, candidate_hash string")
    got = {r.id: r.suppressed_by for r in dedup.structural(df, [], "formula", "candidate_hash", least).collect()}
    want = greedy_list([(r[0], r[2], r[3]) for r in rows], lambda x, y: max(prefix(x[2] or "", y[2] or "") if x[2] and y[2] else 0.0, jaccard(x[1], y[1])) >= least)
    assert got == want


def test_preferred_signals(spark):
    rnd = random.Random(8)
    ids = [f"s{k}" for k in range(14)]
    taste = {i: (rnd.choice([0.1, 0.2]), rnd.choice([0.0, 0.3]), rnd.choice([0.5, 0.6])) for i in ids[:11]}
    pairs = [(a, b, round(rnd.uniform(-1, 1), 2)) for k, a in enumerate(ids) for b in ids[k + 1 :]]
    gone = {}
    for a, b, _ in sorted((p for p in pairs if abs(p[2]) > 0.4), key=lambda p: (-abs(p[2]), p[0], p[1])):
        if a in gone or b in gone:
            continue
        x, y = ((t[0], t[1], -t[2]) if (t := taste.get(i)) else (1.0, 1.0, 0.0) for i in (a, b))
        if x <= y:
            gone[b] = a
        else:
            gone[a] = b
    p = spark.createDataFrame(pairs, "a string, b string, corr double")
    e = spark.createDataFrame([(i, *t) for i, t in taste.items()], "candidate_id string, complexity_penalty double, crowding_penalty double, regime_entropy_score double")
    assert {r.id: r.suppressed_by for r in dedup.by_preference(p, e, 0.4).collect()} == gone
    assert dedup.by_preference(p.where("false"), e).count() == 0


def test_assign(spark):
    rows = [("r1", f"c{k}", k, f"family{k % 2}-{k}", 1.0 - k / 10, True, "c0" if k == 3 else None) for k in range(8)] + [("r1", "c9", 9, "x", 2.0, False, None), ("r2", "d0", 0, "", 0.1, True, None)]
    df = spark.createDataFrame(rows, "run_id string, candidate_id string, ord int, source_id string, score double, gate_passed boolean, near_duplicate_of string")
    c = selection.Config(top_k=3, max_same_family=1, promotion_top_k=1, review_margin=0.25)
    got = {r.candidate_id: (r.decision, r.decision_rank, r.promotion_eligible) for r in selection.assign(selection.rank(df), c).collect()}
    # c0 and c1 are the best of their families; c2 keeps its rank 3 and is selected with it, c3 is a duplicate
    assert got["c0"] == ("SELECTED", 1, True) and got["c1"] == ("SELECTED", 2, False) and got["c2"][:2] == ("SELECTED", 3)
    assert got["c3"][0] == "REJECTED" and got["c4"][0] == "REVIEW_REQUIRED" and got["c6"][0] == "HOLD" and got["c9"][0] == "REJECTED" and got["d0"] == ("SELECTED", 1, True)
    bad = spark.createDataFrame([("c0", 1, 0.5, "SELECTED", True, 0.1, "x", 0), ("c1", 2, 0.9, "HOLD", True, 0.1, None, 1), ("c2", 3, -0.1, "SELECTED", False, 0.9, None, 2)], "candidate_id string, decision_rank int, score double, decision string, gate_passed boolean, pbo double, near_duplicate_of string, ord int")
    assert sorted((r.candidate_id, r.rule, r.severity) for r in selection.violations(bad).collect()) == [("c0", "R03", "ERROR"), ("c1", "R02", "ERROR"), ("c2", "R01", "ERROR"), ("c2", "R04", "WARNING"), ("c2", "R05", "ERROR")]


def test_top_k_overlap(spark):
    rank = {"r": [list("abcdef"), list("bacxyz"), list("mnopqa")], "one": [list("ab")]}
    rows = [(run, f, i + 1, c) for run, folds in rank.items() for f, ids in enumerate(folds) for i, c in enumerate(ids)]
    got = {r.run_id: r.overlap for r in selection.top_k_overlap(spark.createDataFrame(rows, "run_id string, fold int, place int, candidate_id string"), 3).collect()}
    sets = [set(x[:3]) for x in rank["r"]]
    pairs = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :]]
    assert got == {"r": pytest.approx(sum(pairs) / 3), "one": 1.0}


def test_uuid5(spark):
    ns = str(uuid.NAMESPACE_URL)
    names = ["a:b", "", "é", "trace:run-7"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(workflow.uuid5(ns, F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_audit(spark):
    rows = spark.createDataFrame([("r1", "APPLIED"), ("r2", "CONFLICTED")], "object_id string, decision string")
    assert {r.decision for r in workflow.checked_audit(rows).collect()} == {"APPLIED", "CONFLICTED"}
    assert {r.decision for r in workflow.checked_audit(rows, dry_run=True).select("decision").collect()} == {"DRY_RUN"}
    with pytest.raises(Exception, match="not allowed"):
        workflow.checked_audit(rows.withColumn("decision", F.lit("DONE"))).collect()
    with pytest.raises(Exception, match="unknown promotion status"):
        b = spark.createDataFrame([("r", "c", "applied", None)], "run_id string, candidate_id string, promotion_status string, error_message string")
        workflow.set_promotion_status(b, spark.createDataFrame([("r", "c", "gone", None)], "run_id string, candidate_id string, new_status string, error string")).collect()


def test_rules_and_parents(spark):
    rules = workflow.rule_seed(spark)
    artifacts = spark.createDataFrame([(1, {"artifact_tag": "candidate:A"}), (2, {"candidate_code": "B"}), (3, {"artifact_tag": "hypothesis:H"}), (4, {"artifact_tag": "other"})], "artifact_id int, fields map<string,string>")
    targets = spark.createDataFrame([("factor_candidates", "10", "A"), ("factor_candidates", "11", "B"), ("hypotheses", "12", "H")], "target_table string, target_id string, code string")
    got = {r.artifact_id: (r.status, r.rule_name, r.target_id) for r in governance.resolve(artifacts, rules, targets).collect()}
    assert got[1] == ("resolved", "tag_candidate", "10") and got[2] == ("resolved", "candidate_code_direct", "11") and got[3][2] == "12" and got[4][0] == "unresolved"
    parents = spark.createDataFrame([("p", "x")], "name string, id string")
    wanted = spark.createDataFrame([("p",), ("q",), ("q",)], "name string")
    out = {r.name: r.id for r in workflow.get_or_create(parents, wanted, ["name"], "id", str(uuid.NAMESPACE_URL)).collect()}
    assert out == {"p": "x", "q": str(uuid.uuid5(uuid.NAMESPACE_URL, "q"))}


def test_proof_summary(spark):
    rows = spark.createDataFrame([(True, [], 1, 5), (False, ["z", "a"], 0, 7), (False, ["a"], -2, 1)], "is_safe boolean, violation_terminals array<string>, min_lag int, max_lag int")
    r = workflow.proof_summary(rows).first()
    assert (r.total, r.safe_count, r.unsafe_count, r.violations, r.min_lag_min, r.max_lag_max) == (3, 1, 2, "a,z", 1, 7) and r.leakage_rate == pytest.approx(2 / 3)
    assert workflow.proof_summary(rows.where("false")).first().total == 0


def test_json_safe():
    import numpy as np

    assert stores.json_safe({1: float("nan"), "b": [np.float64(2.5), float("inf"), {"c"}], "d": np.int64(3), "e": None}) == {"1": None, "b": [2.5, None, ["c"]], "d": 3, "e": None}


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert not s.exists("runs") and s.read("runs").count() == 0
    context = stores.RunContext.of("desk", "b1", selection.Config())
    rows = lambda data, names: spark.createDataFrame(data, names)
    cands = rows([(context.run_id, "c1", "f"), (context.run_id, "c2", "g")], "run_id string, candidate_id string, formula string")
    evals = rows([(context.run_id, "c1", 0.5, True, float("nan"), 7), (context.run_id, "c2", 0.1, False, 1.0, 8)], "run_id string, candidate_id string, score double, gate_passed boolean, pbo double, note int")
    decs = rows([(context.run_id, "c1", "SELECTED", 1), (context.run_id, "c2", "REVIEW_REQUIRED", 2)], "run_id string, candidate_id string, decision string, decision_rank int")
    s.write_run(context.row(spark), cands, evals, decs, dry_run=True)
    assert not s.exists("runs")
    s.write_run(context.row(spark), cands, evals, decs)
    assert s.read("runs").first().status == "completed"
    assert {r.candidate_id: r.status for r in s.read("candidates").collect()} == {"c1": "selected", "c2": "review_required"}
    e = {r.candidate_id: r for r in s.read("evaluations").collect()}
    assert e["c1"].pbo is None and json.loads(e["c1"].extra_metrics) == {"note": 7}
    with pytest.raises(Exception):  # noqa: B017
        s.write_run(context.row(spark), cands, evals.withColumn("score", F.raise_error(F.lit("no"))), decs)
    r = s.read("runs").first()
    assert r.status == "failed" and "failure_reason" in json.loads(r.run_metadata) and r.error_message and s.read("evaluations").count() == 2
    assert [r.column_name for r in s.columns("decisions").orderBy("position").collect()][:2] == ["run_id", "candidate_id"]
    with pytest.raises(ValueError):
        s.mark_run("runs", context.run_id, "odd")


def test_proofs_and_causal_results(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write("discovery_candidates", spark.createDataFrame([("c1", "r", '{"a": 1, "is_safe": "old", "t": "x\\"y"}'), ("c2", "r", None)], "candidate_id string, run_id string, run_metadata string"))
    s.save_proofs(spark.createDataFrame([("c1", True, False, ["q"], 3), ("zz", True, False, [], 1)], "candidate_id string, is_safe boolean, looks_ahead boolean, violation_terminals array<string>, max_lag int"))
    got = {r.candidate_id: r for r in s.read("discovery_candidates").collect()}
    assert set(got) == {"c1", "c2"}
    meta = json.loads(got["c1"].run_metadata)
    assert meta["a"] == 1 and meta["is_safe"] is True and meta["t"] == 'x"y' and meta["violation_terminals"] == ["q"] and meta["safety_proof"]["max_lag"] == 3
    proofs = {r.candidate_id: r.safety_proof for r in s.proofs().collect()}
    assert json.loads(proofs["c1"])["max_lag"] == 3 and proofs["c2"] is None
    s.save_causal(spark.createDataFrame([("r", "c1", 0.5, "ok")], "run_id string, candidate_id string, score double, note string"))
    row = s.causal("score double, note string").first()
    assert (row.candidate_id, row.score, row.note) == ("c1", 0.5, "ok")


def test_policies(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    c = selection.Config(top_k=7)
    policy = stores.to_policy(c)
    assert stores.from_policy(policy) == c
    assert s.save_policy(policy, dry_run=True) and not s.exists("policies")
    name = s.save_policy(policy, "v1", "p1", "first")
    first = s.read("policies").first()
    assert s.save_policy(policy, "v2", "p2", "again") == name
    again = s.read("policies").first()
    assert again.engine_version == "v1" and again.first_seen_at == first.first_seen_at and again.used_at > first.used_at
    assert s.policy(name) == json.loads(json.dumps(policy)) and s.policy("none") is None
    s.write("runs", spark.createDataFrame([("r", name)], "run_id string, policy_hash string"))
    assert s.policy_of_run("r")["selection"]["top_k"] == 7 and s.policy_of_run("q") is None
    s.save_policy(stores.to_policy(selection.Config(top_k=9)), "v2")
    assert s.policies().count() == 2 and s.policies(engine_version="v2").count() == 1 and s.policies(limit=1).count() == 1
    for wrong in ({"top_k": 0}, {"promotion_top_k": 99}, {"w_capacity": -1.0}, {"pbo_threshold": 2.0}):
        with pytest.raises(ValueError):
            s.save_policy(stores.to_policy(selection.Config(**wrong)))
