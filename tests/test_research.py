"""Queries against DuckDB on small tables, and operators against pandas or plain Python."""

import decimal
import math
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meridian import queries, queries_evidence, queries_flow  # noqa: F401  (the others add their queries)
from meridian.functions import stats
from meridian.operators import backtest, evidence, features, governance, metrics, selection
from meridian.plans import search
from meridian.sources import catalog, tables

NAMES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return round(float(v), 6) + 0.0 if isinstance(v, decimal.Decimal) else v if isinstance(v, (int, type(None), str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in queries.SQL:
        assert len(df.columns) and rows
        return
    cur = duck.execute(queries.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    got = Counter(tuple(plain(r[c]) for c in order) for r in rows)
    want = Counter(tuple(plain(r[cols.index(c)]) for c in order) for r in cur.fetchall())
    assert got == want


def series(spark, values, extra=None):
    return spark.createDataFrame([("a", i + 1, v, *(e[i] for e in (extra or {}).values())) for i, v in enumerate(values)], "series_id string, t int, ret double" + "".join(f", {k} double" for k in (extra or {})))


def test_rolling_has_no_value_until_full(spark):
    x = [1.0, None, 3.0, 4.0, 5.0, 6.0]
    w = stats.over_series("series_id")
    got = [r[0] for r in series(spark, x).select(stats.rolling(F.avg, F.col("ret"), w, 3), "t").orderBy("t").collect()]
    want = pd.Series(x).rolling(3).mean()
    assert got == [None if math.isnan(v) else v for v in want]


def test_average_rank(spark):
    x = [3.0, 1.0, 3.0, None, 2.0, 1.0, 1.0]
    got = [r[0] for r in series(spark, x).select(stats.average_rank(F.col("ret"), ["series_id"]), "t").orderBy("t").collect()]
    assert got == [None if math.isnan(v) else v for v in pd.Series(x).rank()]


def test_terminals_against_pandas(spark):
    r = pd.Series(np.random.default_rng(42).normal(0, 0.02, 200))
    got = features.terminal_features(series(spark, r.tolist())).orderBy("t").toPandas()
    want = {"r5": r.rolling(5).sum(), "realized_vol_20": r.rolling(20).std(), "vol_surprise": r.rolling(20).std() / r.rolling(60).std() - 1, "event_surprise": r - r.rolling(60).mean()}
    want["market_beta"] = r.rolling(60).corr(r.rolling(60).mean()).fillna(1.0)
    want["trend_slope_20"] = r.rolling(20).apply(lambda y: np.polyfit(range(20), y, 1)[0])
    for k, v in want.items():
        assert np.allclose(got[k], v.fillna(0), atol=1e-9), k


def test_oscillator(spark):
    x = np.random.default_rng(1).uniform(50, 60, 40)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, t int, close double")
    got = features.price_oscillator(df).orderBy("t").toPandas()["ppo"]
    a, b = (pd.Series(x).ewm(span=n, adjust=False).mean() for n in (12, 26))
    assert np.allclose(got, (a - b) / b)


def test_event_mask(spark):
    df = series(spark, [0.0] * 12).withColumn("is_event", F.col("t") == 5)
    got = [r.t for r in features.event_window_mask(df, before=2, after=3).where("event_mask").collect()]
    assert sorted(got) == [3, 4, 5, 6, 7, 8]


def test_constant_series_has_no_correlation(spark):
    df = series(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], {"signal": [1.0] * 6, "target": [0.1, 0.3, 0.2, 0.4, 0.5, 0.1]})
    r = metrics.predictive(df).first()
    assert r.ic == 0 and r.rank_ic == 0


def test_risk_gate_priority(spark):
    ret = [0.0, 0.1, -0.1, 0.1, -0.1, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    df = series(spark, ret).withColumn("signal", F.lit(2.0)).withColumn("crisis", F.col("t") == 6).withColumn("low_liquidity", F.col("t") >= 10)
    got = {r.t: (r.gate, r.position) for r in backtest.risk_gate(df).collect()}
    assert got[6] == ("CRISIS_REGIME", 0.0) and got[5][0] == "MARGIN_M2" and got[1] == (None, 1.0)
    assert got[12][0] == "LIQUIDITY" and got[11][0] is None


def brute_pbo(folds):
    splits = selection.fold_splits(len(folds))
    lose = 0
    for s in splits:
        rest = [folds[i] for i in range(len(folds)) if i not in s]
        lose += max(folds[i] for i in s) < float(np.median(rest))
    return lose / len(splits)


def test_pbo(spark):
    rng = np.random.default_rng(0)
    lists = [rng.normal(size=n).tolist() for n in (2, 4, 5, 6, 7, 11) for _ in range(3)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, folds array<double>")
    got = {r.i: r.pbo_raw for r in selection.pbo_fold_split(df, "folds").collect()}
    for i, x in enumerate(lists):
        assert abs(got[i] - (0.5 if len(x) < 4 else brute_pbo(x))) < 1e-12


def test_gates_and_decisions(spark):
    rows = [("a", 1, 0.1, 0.05, 1.0, 1.0, -0.1, 1.0, 0.2, 0.9, 0.8), ("b", 2, 0.3, 0.01, 0.1, 5.0, -0.5, 0.5, 0.9, 0.1, 0.7), ("c", 3, 0.1, None, None, None, None, None, 0.2, 0.9, 0.77)]
    df = spark.createDataFrame(rows, "candidate_id string, ord int, pbo double, rank_ic double, oos_sharpe double, turnover double, max_drawdown double, regime_pass_ratio double, complexity double, selection_consistency_score double, score double")
    got = {r.candidate_id: r for r in selection.gates(df).collect()}
    assert got["a"].gate_passed and got["c"].gate_passed and len(got["b"].gate_failures) == 8
    assert got["b"].gate_failures[0] == "pbo=0.3000 > threshold=0.2000" and got["b"].gate_failures[3] == "turnover=5.00 > max=4.00"
    out = {r.candidate_id: r.decision for r in selection.decide(selection.rank(selection.gates(df)), selection.Config(top_k=1)).collect()}
    assert out == {"a": "SELECTED", "b": "REJECTED", "c": "REVIEW_REQUIRED"}


def test_correlations_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9, 40)).round(2)
    x[3] = 1.0
    rows = [(f"s{i}", t, float(v)) for i, r in enumerate(x) for t, v in enumerate(r) if (i + t) % 5 or i == 3] + [("late", 900, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, t int, x double")
    by = {i: {t: v for s, t, v in rows if s == i} for i in {r[0] for r in rows}}
    want = {}
    for a in by:
        for b in by:
            both = sorted(by[a].keys() & by[b].keys())
            if a < b and both:
                u, v = (np.array([by[k][t] for t in both]) for k in (a, b))
                want[a, b] = (len(both), np.corrcoef(u, v)[0, 1] if len(both) >= 3 and u.std() * v.std() > 1e-15 else 0.0)
    for chunk, block in ((4096, 512), (7, 3)):
        got = {(r.a, r.b): (r.n, r.corr) for r in evidence.pairwise_correlation(df, "x", chunk, block).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


@pytest.mark.parametrize("block", [4096, 7])
def test_novelty_in_blocks(spark, block):
    rng = np.random.default_rng(9)
    x = [rng.normal(size=6).round(1).tolist() for _ in range(40)] + [[0.0] * 6, None, [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(x)), "id int, v array<double>")
    got = {r.id: (r.nearest, r.similarity) for r in evidence.novelty(df, df, "id", "v", block).collect()}

    def cos(a, b):
        if a is None or b is None or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)

    for i, v in enumerate(x):
        s = [(-cos(v, w), j) for j, w in enumerate(x) if j != i]
        assert got[i] == (min(s)[1], pytest.approx(-min(s)[0]))


def test_token_jaccard_loses_no_pair(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"t{x}" for x in rng.integers(0, 12, rng.integers(1, 8)))) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {(r.a, r.b) for r in evidence.token_jaccard(df, "id", "text", 0.6).collect()}
    s = {i: set(t.split()) for i, t in rows}
    assert got == {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])}


def test_upsert_and_resolution(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, fixed string, v double")
    s = spark.createDataFrame([(2, "z", 9.0), (3, "c", 3.0)], "k int, fixed string, v double")
    assert sorted(map(tuple, governance.upsert(t, s, ["k"], ["v"]).collect())) == [(1, "a", 1.0), (2, "b", 9.0), (3, "c", 3.0)]
    assert sorted(r.v for r in governance.insert_absent(t, s, ["k"]).collect()) == [1.0, 2.0, 3.0]
    rules = spark.createDataFrame([("r1", 1, "x", "^c:(.+)$", "t", True), ("r2", 2, "y", "^c:(.+)$", "t", True)], "rule_name string, priority int, source_field string, pattern string, target_table string, is_active boolean")
    targets = spark.createDataFrame([("t", 10, "one"), ("t", 11, "two"), ("t", 12, "two")], "target_table string, target_id long, code string")
    art = spark.createDataFrame([(1, {"x": "c:one"}), (2, {"x": "c:two", "y": "c:one"}), (3, {"x": "none", "y": "c:one"}), (4, {"x": "none"}), (5, {})], "artifact_id int, fields map<string,string>")
    got = {r.artifact_id: (r.status, r.target_id) for r in governance.resolve(art, rules, targets).collect()}
    assert got == {1: ("resolved", 10), 2: ("ambiguous", None), 3: ("resolved", 10), 4: ("unresolved", None), 5: ("unresolved", None)}


def test_trees():
    found = search.trees(["r1", "r5"])
    leaves = 3
    assert len(found) == (leaves + leaves**2) ** 2 - leaves**2
    assert search.is_safe("r1", ["r1"]) and search.is_safe("-1.5", []) and not search.is_safe("__import__('os')", ["r1"])
    n = search.Node(None, search.Node("r1"), search.Node("future_x"))
    assert search.lags(n, {"r1": 2}) == (0, 2, True) and n.leaf == "r1" and n.depth == 1


def test_grid(spark):
    full = evidence.parameter_grid(spark, {"a": [1, 2, 3], "b": [10, 20]}, 100).collect()
    assert {(r.a, r.b) for r in full} == {(a, b) for a in (1, 2, 3) for b in (10, 20)} and full[0].a == 1 and full[0].b == 10
    assert evidence.parameter_grid(spark, {"a": [1, 2, 3], "b": [10, 20]}, 4).count() == 4


def test_csv_round_trip(spark, sf_dir, tmp_path):
    nation = tables.table(spark, sf_dir, "nation")
    tables.export_first_keys(nation, "n_regionkey", 2, str(tmp_path / "out"))
    back = tables.load_csv(spark, str(tmp_path / "out"), "n_nationkey int, n_name string, n_regionkey int")
    assert back.select("n_regionkey").distinct().count() == 2


def test_stream(spark, sf_dir, tmp_path):
    from meridian.streaming.events import start, windowed

    batch = windowed(tables.table(spark, sf_dir, "events"))
    stream = spark.readStream.schema(tables.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    got = []
    q = start(stream, lambda df, _: got.extend(df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    all_ = {(r.window_start, r.event_type): r.n for r in batch.collect()}
    assert all(all_[r.window_start, r.event_type] == r.n for r in got)


def test_entry_without_the_other_operators(spark):
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "benchmark_id"


def test_genome(spark):
    from meridian.operators import genome

    df = spark.createDataFrame([(1, "ts_delta(volume) momentum"), (2, "qqq"), (3, ""), (4, None)], "id int, text string")
    got = {r.id: r for r in genome.encode(df, "text").collect()}
    assert got[1].dominant_axis == "momentum" and abs(sum(got[1].genome) - 1) < 1e-12
    assert got[2].genome == [0.1] * 10 and got[2].dominant_axis == "momentum" and got[2].confidence == 0


def test_evidence_gates(spark):
    df = spark.createDataFrame([("a", [], True, 0.5, None), ("b", ["x=1"], False, 0.9, 0.1), ("c", [], True, 0.9, 0.1)], "id string, gate_failures array<string>, gate_passed boolean, causal_direction_score double, fsi double")
    got = {r.id: r for r in selection.evidence_gates(df).collect()}
    assert got["a"].gate_failures == ["causal_direction_score=0.5000 < min=0.6000"] and not got["b"].gate_passed and got["c"].gate_passed


def test_table_upserts(spark, tmp_path):
    from meridian.sources.sinks import Table, config_hash

    t = Table(str(tmp_path / "t"), ("k",), immutable=("made",))
    assert t.read(spark) is None
    t.write(spark.createDataFrame([(1, "a", 1.0, None), (2, "b", 2.0, None)], "k int, made string, v double, extra_metrics string"))
    assert t.write(spark.createDataFrame([(9, 1.0)], "k int, v double"), dry_run=True).count() == 3 and t.read(spark).count() == 2
    t.write(spark.createDataFrame([(2, "z", 5.0, 7), (3, "c", 3.0, 8)], "k int, made string, v double, note int"))
    assert sorted((r.k, r.made, r.v, r.extra_metrics) for r in t.read(spark).collect()) == [(1, "a", 1.0, None), (2, "b", 5.0, '{"note":7}'), (3, "c", 3.0, '{"note":8}')]
    assert config_hash({"a": 1, "description": "x"}) == config_hash({"description": "y", "a": 1}) != config_hash({"a": 2})


def test_training_finds_the_best_leaf():
    import random

    scores = {"a": 0.1, "b": 0.9, "1.0": 0.0}
    for seed in range(10):
        n = search.random_tree(["a", "b"], 3, random.Random(seed))
        if "b" in n.leaves:
            assert search.train(n, scores, steps=200).leaf == "b"


def test_soft_gradient():
    import random

    n = search.random_tree(["a", "b"], 3, random.Random(1))
    scores = {"a": 0.3, "b": -0.4, "1.0": 0.1}
    value, g = search._soft(n, scores, 1.3)
    w = search._weights(n)
    for i in range(len(w)):
        up = [x + 1e-6 * (k == i) for k, x in enumerate(w)]
        assert abs((search._soft(search._with(n, up), scores, 1.3)[0] - value) / 1e-6 - g[i]) < 1e-5


def test_perturbed():
    assert search.perturbed(20, 5, 252, 0.3, 5, integer=True) == [14.0, 17.0, 20.0, 23.0, 26.0]
    out = search.perturbed(1.0, 0.5, 2.0, 0.25, 3, log=True)
    assert abs(out[1] ** 2 - out[0] * out[2]) < 1e-12 and out[0] == pytest.approx(0.75)


def test_report(spark, sf_dir):
    from meridian.plans.report import selection_report

    text = selection_report(selection.decide(selection.rank(queries.evaluated(spark, sf_dir, queries.WIDE)), queries.WIDE), "r1")
    assert text.startswith("# Selection r1") and "## Failed gates" in text and "| decision_rank |" in text


def test_quality_checks_of_an_empty_table(spark):
    out = catalog.quality_checks(spark.createDataFrame([], "a string, b double"), "t", ["a"], ["b"]).collect()
    assert [(r.check_name, r.n_rows, r.n_bad, r.passed) for r in out] == [("missing_a", 0, 0, True), ("null_b", 0, 0, True)]


def test_sizes_and_partition_plan(spark, tmp_path):
    import datetime as dt

    rows = spark.createDataFrame([(1, dt.date(2024, 1, 5)), (2, dt.date(2024, 3, 31)), (3, dt.date(2024, 4, 1)), (4, None)], "i int, d date")
    catalog.write_by_period(rows, "d", 3, str(tmp_path / "t"))
    back = {r.i: r.period for r in spark.read.option("basePath", str(tmp_path / "t")).parquet(str(tmp_path / "t")).select("i", F.col("period").cast("string")).collect()}
    assert back == {1: "2024-01", 2: "2024-01", 3: "2024-04", 4: None}
    sizes = catalog.table_sizes(spark, {"t": str(tmp_path / "t"), "gone": str(tmp_path / "gone")})
    (r,) = sizes.collect()
    assert (r.table_name, r.row_count) == ("t", 4) and r.size_bytes > 0
    registry = spark.createDataFrame([("t", "d", 3, "pending"), ("big", "d", 1, "migrating"), ("x", "d", 1, "done"), ("gone", "d", 6, "pending")], "table_name string, partition_key string, partition_interval int, status string")
    plan = catalog.partition_plan(registry, sizes.unionByName(spark.createDataFrame([("big", 1_000_001, 5)], sizes.schema)))
    assert {r.table_name: r.due for r in plan.collect()} == {"t": False, "big": True, "gone": False}


def test_proxy_series_follow_the_generator(spark):
    from meridian.operators import genome

    def draws(state, n):
        for _ in range(n):
            state = (1664525 * state + 1013904223) % 2**32
            yield state / 2**32 * 2 - 1

    texts = {1: "", 2: "close + r5", 3: "x" * 80, 4: None, 5: "\u4fa1\U0001f600 * vol"}
    got = genome.candidate_proxies(spark.createDataFrame(list(texts.items()), "i int, f string"), "i", "f").orderBy("series_id", "t").collect()
    want = [(i, t, u) for i, x in texts.items() for t, u in enumerate(draws(99_999 + sum(map(ord, (x or "")[:50])), 60), 1)]
    assert [(r.series_id, r.t) for r in got] == [w[:2] for w in want]
    assert [r.signal for r in got] == pytest.approx([w[2] for w in want], abs=1e-12)
    x = {(r.factor, r.t): r.x for r in genome.factor_proxies(spark, 7).collect()}
    assert len(x) == 7 * len(genome.FACTORS)
    assert x["MOM_12M", 7] == pytest.approx(list(draws(12_345 + sum(map(ord, "MOM_12M")), 7))[-1] * 0.8 + 0.1)


@pytest.mark.parametrize("block", [1024, 5])
def test_near_genomes_against_all_pairs(spark, monkeypatch, block):
    from meridian.operators import genome

    monkeypatch.setattr(genome, "BLOCK", block)
    rng = np.random.default_rng(3)
    words = [k for a in genome.AXES for k, _ in genome.KEYWORDS[a]]
    texts = [" + ".join(rng.choice(words, rng.integers(1, 5))) for _ in range(60)]
    texts += texts[:20] + ["vol + volume + zscore", "zscore * zscore + vol + volume", "qqq", "zzz", None]
    rows = genome.encode(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text").cache()
    g = {r.id: (r.genome, r.dominant_axis) for r in rows.collect()}

    def cos(x, y):  # the reference's
        d, nx, ny = (sum(a * b for a, b in zip(u, v, strict=True)) for u, v in ((x, y), (x, x), (y, y)))
        return min(1.0, d / (math.sqrt(nx) * math.sqrt(ny)))

    want = {(a, b): cos(g[a][0], g[b][0]) for a in g for b in g if a < b}
    want = {k: v for k, v in want.items() if v >= 0.9}
    assert any(g[a][1] != g[b][1] for a, b in want)
    out = genome.near_duplicates(rows, "id").collect()
    first = {i: i for i in g} | {r.b: r.a for r in out if r.equal}
    assert first == {r.id: r.representative for r in genome.members(rows, "id").collect()}
    near = {(r.a, r.b): r.similarity for r in out if not r.equal}
    assert len(near) + sum(r.equal for r in out) == len(out)
    got = {}
    for a in g:
        for b in g:
            x, y = sorted((first[a], first[b]))
            if a < b and (x == y or (x, y) in near):
                got[a, b] = near.get((x, y), 1.0)
    assert got == pytest.approx(want, abs=1e-12)


def test_novelty_finds_a_copy_of_any_id(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(120, 8)).round(3)
    x[57] = x[50]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.id: r for r in queries.QUERIES["novelty_among_all"](spark, str(tmp_path)).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    assert set(got) == {0, 50, 100} and (got[50].nearest, got[50].novelty) == (57, 0)
    assert all(got[i].nearest == s[i].argmax() and abs(got[i].similarity - s[i].max()) < 1e-5 for i in got)


@pytest.fixture(scope="module")
def two_orders(spark, tmp_path_factory):
    """Two folders with the same lineitem rows in opposite orders: years of 40 suppliers whose discounts cancel, or nearly."""
    rng, rows = np.random.default_rng(5), []
    for supplier in range(40):
        for year in range(1992, 1999):
            half = rng.integers(0, 11, 12).tolist()
            extra = [] if rng.random() < 0.7 else [int(rng.integers(0, 11))]
            rows += [(supplier, d / 100, float(rng.integers(0, 9)) / 100, pd.Timestamp(year, 3, 1)) for h in half for d in (h, 10 - h)]
            rows += [(supplier, d / 100, 0.01, pd.Timestamp(year, 3, 1)) for d in extra]
    lines = pd.DataFrame(rows, columns=["l_suppkey", "l_discount", "l_tax", "l_shipdate"]).sort_values(["l_discount", "l_tax"], kind="stable")
    out = []
    for part in (lines, lines[::-1]):
        out.append(str(tmp_path_factory.mktemp("order")))
        part.astype({"l_shipdate": "datetime64[us]"}).to_parquet(f"{out[-1]}/lineitem.parquet", index=False)
    return out


ORDERLESS = ["decision_summary", "evidence_scores", "overfit_pairs", "overfit_probability", "regime_entropy", "regime_entropy_summary", "regime_records", "fold_stability", "gate_histogram", "latest_run_scores", "score_components", "selection_decisions"]


@pytest.mark.parametrize("name", ORDERLESS)
def test_rows_in_any_order_give_one_result(spark, two_orders, name):
    a, b = (Counter(tuple(plain(x) for x in r) for r in queries.QUERIES[name](spark, d).collect()) for d in two_orders)
    assert a == b


def test_exact_sum(spark):
    x = [d / 100 - 0.05 for d in np.random.default_rng(2).integers(0, 11, 3000).tolist()]
    want = {g: float(sum(Fraction(v) for v in x[g::30])) for g in range(30)}
    rows = spark.createDataFrame([(i % 30, v) for i, v in enumerate(x)], "g int, x double").repartition(5)
    assert dict(rows.groupBy("g").agg(stats.exact_sum(F.col("x"))).collect()) == want
    odd = spark.createDataFrame([(1, None), (2, math.inf), (2, 1.0), (3, 1e300), (3, 1.0), (4, None), (4, -3.25)], "g int, x double")
    assert dict(odd.groupBy("g").agg(stats.exact_sum(F.col("x"))).collect()) == {1: None, 2: math.inf, 3: 1e300, 4: -3.25}


def test_rounding_is_that_of_sql(spark, duck):
    x = [*((np.random.default_rng(3).integers(-99999, 99999, 3000) * 10 + 5) / 1e5).tolist(), -1e-16, -0.0, 0.0, 1e300, math.inf]
    duck.register("numbers", pd.DataFrame({"i": range(len(x)), "x": x}))
    got = [r[0] for r in spark.createDataFrame(list(enumerate(x)), "i int, x double").select(stats.rounded_half(F.col("x"), 4), "i").orderBy("i").collect()]
    want = [r[0] for r in duck.execute("SELECT ROUND(x, 4) FROM numbers ORDER BY i").fetchall()]
    assert [(v, math.copysign(1, v)) for v in got] == [(v, math.copysign(1, v)) for v in want]


@pytest.fixture(scope="module")
def odd_lines(tmp_path_factory):
    """Folders of lineitem rows of 150 suppliers whose years never cancel: all, and with few years, or with suppliers, dates or discounts that are NULL."""
    rng, rows = np.random.default_rng(12), []
    for supplier in range(150):
        for year in range(1995, 2002):
            up = rng.random() < 0.4
            for _ in range(int(rng.integers(6, 15))):
                d = int(rng.integers(50, 101)) if up else int(rng.integers(0, 50))
                rows.append((supplier, float(d) / 1000, float(rng.integers(0, 9)) / 100, pd.Timestamp(year, 3, 1)))
    lines = pd.DataFrame(rows, columns=["l_suppkey", "l_discount", "l_tax", "l_shipdate"]).astype({"l_suppkey": "Int64", "l_shipdate": "datetime64[us]"})
    key, year, i = lines.l_suppkey.astype(int), lines.l_shipdate.dt.year, np.arange(len(lines))
    kinds = {
        "few_years": lines[year < 1996 + key % 8],
        "no_supplier": lines.assign(l_suppkey=lines.l_suppkey.mask((i % 9 == 0) & (lines.l_discount > 0.04))),
        "no_date": lines.assign(l_shipdate=lines.l_shipdate.mask((i % 9 == 0) | (year == 1995) & (key % 2 == 0))),
        "no_discount": lines.assign(l_discount=lines.l_discount.mask((i % 9 == 0) | (year == 1995 + key % 7) & (key % 3 == 0))),
    }
    out = {}
    for kind, part in kinds.items():
        out[kind] = str(tmp_path_factory.mktemp(kind))
        part.to_parquet(f"{out[kind]}/lineitem.parquet", index=False)
    return out


def same_as_sql(spark, folder, name):
    """Compares the rows of a query on the lineitem of a folder with those of its SQL."""
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet')")
        cur = c.execute(queries.SQL[name])
        order = sorted(d[0] for d in cur.description)
        at = [[d[0] for d in cur.description].index(k) for k in order]
        want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    got = Counter(tuple(plain(r[k]) for k in order) for r in queries.QUERIES[name](spark, folder).collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3], (got - want).total())


def test_evidence_scores_add_to_the_rounded_score(spark, odd_lines):
    same_as_sql(spark, odd_lines["few_years"], "evidence_scores")
    rows = spark.createDataFrame([(0.4372925, 0.0)], "score double, regime_entropy_score double")
    assert selection.score_with_evidence(rows).first().score_v2 == 0.4372925 + 0.025 + 0.025


@pytest.mark.parametrize("kind", ["no_supplier", "no_discount"])
def test_overfit_probability_with_nulls(spark, odd_lines, kind):
    same_as_sql(spark, odd_lines[kind], "overfit_probability")


def test_regime_entropy_without_a_supplier(spark, odd_lines):
    same_as_sql(spark, odd_lines["no_supplier"], "regime_entropy")


def test_regime_entropy_summary_without_a_supplier(spark, odd_lines):
    same_as_sql(spark, odd_lines["no_supplier"], "regime_entropy_summary")


@pytest.mark.parametrize("kind", ["no_supplier", "no_date"])
def test_regime_records_with_nulls(spark, odd_lines, kind):
    same_as_sql(spark, odd_lines[kind], "regime_records")


@pytest.mark.parametrize("kind", ["no_discount", "no_date"])
def test_overfit_pairs_with_nulls(spark, odd_lines, kind):
    same_as_sql(spark, odd_lines[kind], "overfit_pairs")


def test_fold_stability_without_discounts(spark, odd_lines):
    same_as_sql(spark, odd_lines["no_discount"], "fold_stability")


@pytest.mark.parametrize("kind", ["no_discount", "no_date"])
def test_score_components_with_nulls(spark, odd_lines, kind):
    same_as_sql(spark, odd_lines[kind], "score_components")


@pytest.mark.parametrize("name", ["gate_histogram", "latest_run_scores", "evidence_scores"])
@pytest.mark.parametrize("kind", ["no_discount", "no_date"])
def test_selection_with_nulls(spark, odd_lines, kind, name):
    same_as_sql(spark, odd_lines[kind], name)


def test_gate_messages_round_as_printf(spark, odd_lines):
    same_as_sql(spark, odd_lines["no_date"], "selection_decisions")
    x = [4.765, 4.125, 4.135, 0.005, 1234567.005, -0.0, -1e-9]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(x)), "i int, x double").select(stats.fixed(F.col("x"), 2), "i").orderBy("i").collect()]
    assert got == [f"{v:.2f}" for v in x]


@pytest.fixture(scope="module")
def odd_keys(odd_lines, tmp_path_factory):
    """Folders of the rows with few years: a tax that never varies for every fifth supplier, and suppliers whose keys are all below zero."""
    lines = pd.read_parquet(f"{odd_lines['few_years']}/lineitem.parquet")
    kinds = {"same_tax": lines.assign(l_tax=lines.l_tax.mask(lines.l_suppkey % 5 == 0, 0.03)), "negative": lines.assign(l_suppkey=lines.l_suppkey - 150)}
    out = {}
    for kind, part in kinds.items():
        out[kind] = str(tmp_path_factory.mktemp(kind))
        part.to_parquet(f"{out[kind]}/lineitem.parquet", index=False)
    return out


def test_score_components_where_a_tax_never_varies(spark, odd_keys):
    same_as_sql(spark, odd_keys["same_tax"], "score_components")
    rows = spark.createDataFrame([(1, 0.1, 0.3), (1, 0.2, 0.3), (2, 0.1, 0.2), (3, None, 0.1), (4, 0.1, 0.3), (4, 0.2, 0.1), (4, 0.3, None)], "g int, x double, y double")
    got = dict(rows.groupBy("g").agg(stats.plain_correlation(F.col("x"), F.col("y"))).collect())
    assert math.isnan(got[1]) and math.isnan(got[2]) and got[3] is None and got[4] == pytest.approx(-1.0)


def test_latest_run_scores_with_negative_suppliers(spark, odd_keys):
    same_as_sql(spark, odd_keys["negative"], "latest_run_scores")


@pytest.mark.parametrize("kind", ["same_tax", "negative"])
def test_gate_histogram_with_odd_keys_and_taxes(spark, odd_keys, kind):
    same_as_sql(spark, odd_keys[kind], "gate_histogram")


@pytest.fixture(scope="module")
def odd_values(odd_lines, tmp_path_factory):
    """Folders of the rows with few years: no rows, discounts that are NaN or infinite in one year of a supplier at most, and every third supplier without a known discount."""
    lines = pd.read_parquet(f"{odd_lines['few_years']}/lineitem.parquet")
    odd = (np.arange(len(lines)) % 5 == 0) & (lines.l_suppkey % 3 == 0) & (lines.l_shipdate.dt.year == 1996)
    kinds = {"no_rows": lines[:0], "infinite": lines.assign(l_discount=lines.l_discount.mask(odd, math.inf)), "unknown": lines.assign(l_discount=lines.l_discount.mask(lines.l_suppkey % 3 == 0)), "nan": lines}
    out = {}
    for kind, part in kinds.items():
        out[kind] = str(tmp_path_factory.mktemp(kind))
        rows = pa.Table.from_pandas(part, preserve_index=False)
        if kind == "nan":
            rows = rows.set_column(rows.column_names.index("l_discount"), "l_discount", pa.array(lines.l_discount.mask(odd).to_numpy(), from_pandas=False))
        pq.write_table(rows, f"{out[kind]}/lineitem.parquet")
    return out


@pytest.mark.parametrize("name", ["decision_summary", "evidence_scores", "latest_run_scores", "selection_decisions", "score_components"])
def test_scores_without_a_known_discount(spark, odd_values, name):
    same_as_sql(spark, odd_values["unknown"], name)


@pytest.mark.parametrize("kind", ["nan", "infinite"])
def test_regime_records_of_years_that_are_not_finite(spark, odd_values, kind):
    same_as_sql(spark, odd_values[kind], "regime_records")


@pytest.mark.parametrize("kind", ["no_rows", "nan", "infinite"])
def test_regime_entropy_summary_of_odd_rows(spark, odd_values, kind):
    same_as_sql(spark, odd_values[kind], "regime_entropy_summary")


@pytest.mark.parametrize("kind", ["nan", "infinite"])
def test_regime_entropy_of_years_that_are_not_finite(spark, odd_values, kind):
    same_as_sql(spark, odd_values[kind], "regime_entropy")
    odd = [r.entropy for r in queries.QUERIES["regime_entropy"](spark, odd_values[kind]).collect() if r.entropy is None or math.isnan(r.entropy)]
    assert odd and None not in odd  # NaN as in the SQL, not NULL


@pytest.mark.parametrize("kind", ["nan", "infinite"])
def test_overfit_pairs_of_years_that_are_not_finite(spark, odd_values, kind):
    same_as_sql(spark, odd_values[kind], "overfit_pairs")


@pytest.mark.parametrize("kind", ["nan", "infinite"])
def test_gate_messages_of_numbers_that_are_not_finite(spark, odd_values, kind):
    same_as_sql(spark, odd_values[kind], "selection_decisions")


def test_score_components_have_the_zeros_of_sql(spark, tmp_path):
    rows = [(s, 0.05 - (s + 1) * 1e-9, t / 100, pd.Timestamp(1995 + y, 3, 1)) for s in range(5) for y in range(s + 1) for t in range(3)]
    pd.DataFrame(rows, columns=["l_suppkey", "l_discount", "l_tax", "l_shipdate"]).astype({"l_shipdate": "datetime64[us]"}).to_parquet(f"{tmp_path}/lineitem.parquet", index=False)
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
        want = {(r[0], r[1]): repr(r[2]) for r in c.execute(f"SELECT candidate_id, component, value FROM ({queries.SQL['score_components']}) WHERE component = 'oos_sharpe_score'").fetchall()}
    got = {(r.candidate_id, r.component): repr(r.value) for r in queries.QUERIES["score_components"](spark, str(tmp_path)).where("component = 'oos_sharpe_score'").collect()}
    assert got == want and set(want.values()) == {"0.0"}  # a best year just below zero is rounded to -0.0


@pytest.fixture(scope="module")
def typed_lines(two_orders, tmp_path_factory):
    """Folders of the rows whose years cancel, or nearly, with discounts and taxes of other types."""
    out = {}
    for kind, t in (("decimal", pa.decimal128(15, 2)), ("float", pa.float32())):
        rows = pq.read_table(f"{two_orders[0]}/lineitem.parquet")
        for c in ("l_discount", "l_tax"):
            values = [decimal.Decimal(f"{x:.2f}") if kind == "decimal" else x for x in rows[c].to_pylist()]
            rows = rows.set_column(rows.column_names.index(c), c, pa.array(values, t))
        out[kind] = str(tmp_path_factory.mktemp(kind))
        pq.write_table(rows, f"{out[kind]}/lineitem.parquet")
    return out


@pytest.mark.parametrize("name", ["overfit_probability", "score_components"])
def test_decimal_discounts_are_added_as_decimals(spark, typed_lines, name):
    same_as_sql(spark, typed_lines["decimal"], name)


@pytest.mark.parametrize("name", ["fold_stability", "overfit_probability", "score_components"])
def test_float_discounts_are_compared_as_floats(spark, typed_lines, name):
    same_as_sql(spark, typed_lines["float"], name)


@pytest.mark.parametrize("column", ["l_discount", "l_tax"])
def test_score_components_where_a_variance_overflows(spark, odd_lines, tmp_path, column):
    lines = pd.read_parquet(f"{odd_lines['few_years']}/lineitem.parquet")
    lines.assign(**{column: lines[column].mask(np.arange(len(lines)) % 101 == 0, 1e160)}).to_parquet(f"{tmp_path}/lineitem.parquet", index=False)
    same_as_sql(spark, str(tmp_path), "score_components")


def test_correlation_of_large_numbers_is_that_of_sql(spark, duck):
    x = {1: [1e160, 0.2, 0.3], 2: [1e200, 1e200, 1e200], 3: [1e200, -1e200, 1e300], 4: [1e155, 2e155, 1e155 / 3], 5: [1e150, 3e150, 2e150], 7: [math.inf, 1.0, 2.0], 8: [1e160]}
    rows = [(g, v, y) for g, a in x.items() for v, y in zip(a, (0.1, 0.4, 0.2))] + [(9, v, w) for v, w in ((1e160, -1e160), (1e159, 2e160), (3e158, 0.1))]
    duck.register("large", pd.DataFrame(rows, columns=["g", "x", "y"]))
    want = {g: repr(round(v, 9) + 0.0) for g, v in duck.execute("SELECT g, CORR(x, y) FROM large GROUP BY 1").fetchall()}
    got = spark.createDataFrame(rows, "g int, x double, y double").repartition(4).groupBy("g").agg(stats.plain_correlation(F.col("x"), F.col("y"))).collect()
    assert {g: repr(round(v, 9) + 0.0) for g, v in got} == want
