"""Queries of the governance flows and small functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.functions.stats import finite
from meridian.operators import backtest, discovery, features, governance, selection, workflow
from meridian.queries import MASKS, PANEL, PRICES, RETURNS, SQL, WIDE, decided, positions, query, ranked_sql, rounded, series, table
from meridian.queries import event_study_panel as panel_rows
from meridian.sources.tables import newest_rows, price_panel

RESOLVED = "res AS (SELECT s_suppkey AS artifact_id, CASE WHEN s_nationkey % 4 = 0 THEN 'unresolved' ELSE 'resolved' END AS status, 'by_nation' AS rule_name, CAST(s_nationkey AS BIGINT) AS target_id FROM supplier)"


def resolved(spark, sf_dir):
    """Suppliers resolved to their nations; every fourth nation is not among the targets."""
    rules = spark.createDataFrame([("by_nation", 1, "tag", "^nation:(.+)$", "nation", True)], "rule_name string, priority int, source_field string, pattern string, target_table string, is_active boolean")
    artifacts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artifact_id"), F.create_map(F.lit("tag"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string"))).alias("fields"))
    targets = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").select(F.lit("nation").alias("target_table"), F.col("n_nationkey").cast("long").alias("target_id"), F.col("n_nationkey").cast("string").alias("code"))
    return governance.resolve(artifacts, rules, targets)


@query(f"WITH {RESOLVED} SELECT 'knowledge_artifacts' AS object_type, CAST(artifact_id AS VARCHAR) AS object_id, 'target_resolution' AS phase, CASE WHEN status = 'resolved' THEN 'TRANSITION_APPLIED' ELSE 'TRANSITION_REJECTED' END AS event_type, CASE WHEN status = 'resolved' THEN 'APPLIED' ELSE 'REJECTED' END AS decision, 'TARGET_' || UPPER(status) AS reason, sink FROM res, (SELECT UNNEST(['audit_events', 'run_audit']) AS sink)")
def resolution_audit(spark, sf_dir):
    return workflow.to_sinks(workflow.resolution_events(resolved(spark, sf_dir)))


@query(f"WITH {RESOLVED} SELECT artifact_id, target_id, rule_name AS resolution_method, 'active' AS link_status FROM res WHERE status = 'resolved'")
def artifact_links(spark, sf_dir):
    return workflow.links(resolved(spark, sf_dir))


@query(f"WITH {RESOLVED} SELECT decision, reason, COUNT(*) AS n FROM (SELECT CASE WHEN status = 'resolved' THEN 'APPLIED' ELSE 'REJECTED' END AS decision, CASE WHEN status = 'resolved' THEN 'LINK_CREATED' ELSE 'TARGET_NOT_RESOLVED' END AS reason FROM res) GROUP BY 1, 2")
def link_audit(spark, sf_dir):
    return workflow.link_events(resolved(spark, sf_dir)).groupBy("decision", "reason").agg(F.count("*").alias("n"))


REPORTS = f"""{PANEL}, rn AS (SELECT DISTINCT benchmark_id AS run_id, 'trace-' || benchmark_id AS trace_id, CASE WHEN benchmark_id LIKE '1%' THEN 'failed' ELSE 'completed' END AS status FROM panel),
st AS (SELECT benchmark_id AS run_id, COUNT(*) AS n_events, AVG(ROUND(car_from_t0, 6)) AS avg_car, AVG(ROUND(abnormal_return, 6)) AS avg_ar, CAST(MIN(event_offset) AS INTEGER) AS min_offset, CAST(MAX(event_offset) AS INTEGER) AS max_offset FROM panel GROUP BY 1),
rep AS (SELECT run_id, trace_id, 'Event study ' || run_id AS report_title, n_events, ROUND(avg_car, 6) AS avg_car, ROUND(avg_ar, 6) AS avg_ar, min_offset, max_offset,
  '# Event study ' || run_id || chr(10) || chr(10) || '- events: ' || n_events || chr(10) || '- mean CAR: ' || printf('%.4f', ROUND(avg_car, 4)) || chr(10) || '- mean AR: ' || printf('%.4f', ROUND(avg_ar, 4)) || chr(10) || '- offsets: ' || min_offset || '..' || max_offset AS report_markdown,
  CASE WHEN status = 'completed' THEN 'applied' ELSE 'pending' END AS promotion_status FROM rn JOIN st USING (run_id))"""


def reports(spark, sf_dir):
    p = panel_rows(spark, sf_dir).withColumnRenamed("benchmark_id", "run_id")
    runs = p.select("run_id").distinct().select("run_id", F.concat(F.lit("trace-"), "run_id").alias("trace_id"), F.when(F.col("run_id").startswith("1"), "failed").otherwise("completed").alias("status"))
    return workflow.promote_reports(runs, p)


@query(f"WITH {REPORTS} SELECT * FROM rep")
def report_promotion(spark, sf_dir):
    return rounded(reports(spark, sf_dir))


@query(f"WITH {REPORTS} SELECT run_id, trace_id, 'event_study:' || run_id AS artifact_tag, report_title AS title FROM rep WHERE promotion_status = 'applied'")
def artifact_promotion(spark, sf_dir):
    return workflow.promote_artifacts(reports(spark, sf_dir), "6ba7b811-9dad-11d1-80b4-00c04fd430c8").drop("artifact_id")


@query(f"WITH {REPORTS} SELECT run_id AS object_id, CASE WHEN promotion_status = 'applied' THEN 'TRANSITION_APPLIED' ELSE 'TRANSITION_REJECTED' END AS event_type, CASE WHEN promotion_status = 'applied' THEN 'REPORT_APPLIED' ELSE 'REPORT_NOT_APPLIED' END AS reason FROM rep")
def artifact_audit(spark, sf_dir):
    return workflow.artifact_events(reports(spark, sf_dir)).select("object_id", "event_type", "reason")


@query(f"WITH {ranked_sql(WIDE)} SELECT run_id, candidate_id, CASE decision WHEN 'SELECTED' THEN 'selected' WHEN 'HOLD' THEN 'hold' WHEN 'REJECTED' THEN 'rejected' ELSE 'review_required' END AS status FROM decided")
def candidate_statuses(spark, sf_dir):
    rows = decided(spark, sf_dir)
    return workflow.synced_statuses(rows.select("run_id", "candidate_id", F.lit("new").alias("status")), rows)


@query(
    f"""WITH {ranked_sql(WIDE)}, br AS (SELECT run_id, candidate_id, ord, decision_rank FROM decided WHERE promotion_eligible)
SELECT run_id, candidate_id, 'candidate' AS target_entity_type, candidate_id AS target_entity_id, CASE WHEN decision_rank = 1 THEN 'error' ELSE 'applied' END AS promotion_status, CASE WHEN decision_rank = 1 THEN 'sink down' END AS error_message FROM br"""
)
def promotions(spark, sf_dir):
    rows = decided(spark, sf_dir)
    bridges = workflow.promote_decisions(rows)
    changes = rows.where("promotion_eligible and decision_rank = 1").select("run_id", "candidate_id", F.lit("error").alias("new_status"), F.lit("sink down").alias("error"))
    return workflow.set_promotion_status(bridges, changes).drop("payload")


@query(f"WITH {ranked_sql(WIDE)} SELECT run_id, CAST(json_extract(payload, '$.decision_rank') AS INTEGER) AS decision_rank, json_extract_string(payload, '$.decision') AS decision FROM (SELECT run_id, json_object('decision', decision, 'decision_rank', decision_rank) AS payload FROM decided WHERE promotion_eligible)")
def promotion_payloads(spark, sf_dir):
    p = workflow.promote_decisions(decided(spark, sf_dir), dry_run=True)
    return p.select("run_id", F.get_json_object("payload", "$.decision_rank").cast("int").alias("decision_rank"), F.get_json_object("payload", "$.decision").alias("decision"))


@query(
    f"""WITH {MASKS}, e AS (SELECT series_id, {"AVG(ret) / STDDEV_SAMP(ret) * SQRT(252.0)"} AS sharpe, STDDEV_SAMP(ret) / 1000 AS drag, CORR(signal, target) AS ic, SUM(CASE WHEN crisis THEN ret END) AS crisis_sum, SUM(CASE WHEN high_vol THEN ret END) AS high_sum FROM masks GROUP BY 1)
SELECT series_id, ROUND(sharpe - ABS(drag) * 252, 6) AS cost_adj_sharpe, ROUND(ic, 6) AS score, CASE WHEN crisis_sum < -0.5 THEN 'crisis' WHEN high_sum < 0 THEN 'high_vol' ELSE 'normal' END AS regime_tag FROM e"""
)
def derived_evaluations(spark, sf_dir):
    m = features.regime_masks(series(spark, sf_dir))
    rows = m.groupBy("series_id").agg(
        (F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("sharpe"),
        (F.stddev_samp("ret") / 1000).alias("cost_drag"),
        F.corr("signal", "target").alias("rank_ic"),
        F.sum(F.when(F.col("crisis"), F.col("ret"))).alias("crisis_period_sharpe"),
        F.sum(F.when(F.col("high_vol"), F.col("ret"))).alias("high_vol_sharpe"),
    )
    return rounded(workflow.derived_evaluations(rows).select("series_id", "cost_adj_sharpe", "score", "regime_tag"))


@query("SELECT event_id, CAST(ROUND(epoch(COALESCE(CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 90 MINUTE END, TIMESTAMP '2030-01-01')) - epoch(ts)) AS BIGINT) AS seconds FROM events")
def elapsed(spark, sf_dir):
    end = F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("interval 90 minutes"))
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", workflow.elapsed_seconds(F.col("ts"), end, now).cast("long").alias("seconds"))


@query("SELECT o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS place, COUNT(*) AS n FROM orders GROUP BY 1")
def case_sort_key(spark, sf_dir):
    place = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3)
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).select("o_orderstatus", place.alias("place"), "n").orderBy("place")


@query("WITH j AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '[]' ELSE to_json([c_mktsegment, c_name]) END AS js FROM customer) SELECT c_custkey, CAST(json_array_length(js) AS INTEGER) AS n, js ->> 0 AS first FROM j")
def json_arrays(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 3 == 0, "[]").otherwise(F.to_json(F.array("c_mktsegment", "c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.json_array_length(text).alias("n"), F.get_json_object(text, "$[0]").alias("first"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN NULL ELSE ROUND(c_acctbal, 6) END AS x FROM customer")
def finite_numbers(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 4 == 0, "no number").when(F.col("c_custkey") % 4 == 1, "Infinity").otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(finite(raw), 6).alias("x"))


@query("SELECT c_custkey, c_name, ROUND(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' AS c_name, ROUND(c_acctbal + 1, 2) AS c_acctbal FROM customer WHERE c_custkey % 2 <> 0")
def insert_absent(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.select("c_custkey", F.lit("new").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return governance.insert_absent(c.where("c_custkey % 2 = 0"), new, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(
    f"""WITH RECURSIVE {PRICES}, n AS (SELECT ticker, close, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY price_date) AS t FROM prices),
e AS (SELECT ticker, t, close AS a, close AS b FROM n WHERE t = 1 UNION ALL SELECT n.ticker, n.t, e.a + (n.close - e.a) * 2 / 13.0 AS a, e.b + (n.close - e.b) * 2 / 27.0 AS b FROM e JOIN n ON n.ticker = e.ticker AND n.t = e.t + 1)
SELECT ticker AS series_id, CAST(t AS INTEGER) AS t, ROUND(COALESCE((a - b) / NULLIF(ABS(b), 0), 0), 6) AS ppo FROM e"""
)
def price_oscillator(spark, sf_dir):
    from meridian.functions.stats import over_series

    prices = price_panel(table(spark, sf_dir, "orders"))
    rows = prices.select(F.col("ticker").alias("series_id"), F.row_number().over(over_series("ticker", "price_date")).alias("t"), "close")
    return rounded(features.price_oscillator(rows))


VOLUME = f"""{RETURNS}, vol AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS price_date, COUNT(*) AS volume FROM orders GROUP BY 1, 2),
sv AS (SELECT s.*, volume FROM series s JOIN vol v ON v.ticker = s.series_id AND v.price_date = s.price_date)"""


def with_volume(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = o.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("price_date")).agg(F.count("*").alias("volume"))
    return series(spark, sf_dir).join(v, ["series_id", "price_date"])


@query(f"WITH {VOLUME} SELECT series_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE low) AS n_low FROM (SELECT series_id, COALESCE(volume < 0.5 * CASE WHEN COUNT(volume) OVER (w ROWS 19 PRECEDING) = 20 THEN AVG(volume) OVER (w ROWS 19 PRECEDING) END, false) AS low FROM sv WINDOW w AS (PARTITION BY series_id ORDER BY t)) GROUP BY 1")
def low_liquidity(spark, sf_dir):
    rows = features.low_liquidity(with_volume(spark, sf_dir), "volume")
    return rows.groupBy("series_id").agg(F.count("*").alias("n"), F.count_if("low_liquidity").alias("n_low"))


@query(
    f"""WITH {RETURNS}, m AS (SELECT *, MAX(CASE WHEN t % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 20 PRECEDING AND 5 FOLLOWING) = 1 AS event_mask FROM series)
SELECT series_id, CAST(t AS INTEGER) AS t, event_mask, ROUND(CASE WHEN event_mask THEN CASE WHEN COUNT(ret) OVER (w ROWS 19 PRECEDING) = 20 THEN SUM(ret) OVER (w ROWS 19 PRECEDING) END ELSE 0 END, 6) AS pre_event_drift FROM m WINDOW w AS (PARTITION BY series_id ORDER BY t)"""
)
def event_drift(spark, sf_dir):
    rows = features.event_window_mask(series(spark, sf_dir).withColumn("is_event", F.col("t") % 97 == 0))
    return rounded(features.pre_event_drift(rows).select("series_id", "t", "event_mask", "pre_event_drift"))


_rank = lambda x, part: f"RANK() OVER (PARTITION BY {part} ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0"
FITNESS = f"""{MASKS}, s0 AS (SELECT *, COUNT(*) OVER (PARTITION BY series_id) AS n, {_rank("signal", "series_id")} AS r FROM masks WHERE signal IS NOT NULL),
s1 AS (SELECT *, CASE WHEN n > 1 THEN (r - 1) / (n - 1) - 0.5 ELSE 0 END AS position FROM s0),
s2 AS (SELECT *, ABS(position - LAG(position) OVER (PARTITION BY series_id ORDER BY t)) AS d FROM s1),
tv AS (SELECT series_id, COALESCE(AVG(d), 0) AS turnover FROM s2 GROUP BY 1),
nt AS (SELECT s2.*, turnover, position * target - turnover * 0.0002 AS net FROM s2 JOIN tv USING (series_id) WHERE target IS NOT NULL),
eq AS (SELECT *, PRODUCT(1 + net) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS e FROM nt),
dn AS (SELECT *, e / MAX(e) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq),
ag AS (SELECT series_id, turnover, CASE WHEN COUNT(net) >= 5 AND STDDEV_SAMP(net) > 0 THEN AVG(net) / STDDEV_SAMP(net) * SQRT(252.0) ELSE 0 END AS cost_sharpe, ABS(MIN(dd)) AS drawdown, COUNT(*) FILTER (WHERE crisis) AS nc FROM dn GROUP BY 1, 2),
rk AS (SELECT series_id, crisis, {_rank("position", "series_id")} AS ra, {_rank("target", "series_id")} AS rb, {_rank("position", "series_id, crisis")} AS ca, {_rank("target", "series_id, crisis")} AS cb FROM nt),
ic AS (SELECT series_id, CORR(ra, rb) AS rank_ic FROM rk GROUP BY 1), pt AS (SELECT series_id, MIN(c) AS least, COUNT(*) AS parts FROM (SELECT series_id, crisis, CASE WHEN COUNT(*) >= 5 THEN COALESCE(CORR(ca, cb), 0) ELSE 0 END AS c FROM rk GROUP BY 1, 2) GROUP BY 1),
ft AS (SELECT *, CASE WHEN nc > 5 AND parts = 2 THEN least WHEN nc > 5 THEN LEAST(least, 0) ELSE rank_ic END AS cons FROM ag JOIN ic USING (series_id) JOIN pt USING (series_id))"""


@query(
    f"""WITH {FITNESS} SELECT series_id, ROUND(rank_ic, 6) AS rank_ic, ROUND(cost_sharpe, 6) AS cost_sharpe, ROUND(cons, 6) AS regime_cons, ROUND(turnover, 6) AS turnover, ROUND(drawdown, 6) AS drawdown,
  ROUND(0.3 * rank_ic + 0.3 * LEAST(1, GREATEST(-1, cost_sharpe / 3)) + 0.2 * LEAST(1, GREATEST(-1, cons)) - 0.1 * LEAST(turnover / 2, 1) - 0.05 * 3 / 15.0 - 0.05 * drawdown, 6) AS fitness FROM ft"""
)
def full_fitness(spark, sf_dir):
    return rounded(discovery.full_fitness(features.regime_masks(series(spark, sf_dir)), 3))


@query(f"WITH p AS ({SQL['predictive_metrics']}), r AS ({SQL['risk_metrics']}), t AS ({SQL['trading_metrics']}) SELECT * FROM p JOIN r USING (series_id) JOIN t USING (series_id)")
def full_evaluation(spark, sf_dir):
    out = rounded(discovery.full_evaluation(positions(spark, sf_dir)))
    names = "series_id n ic rank_ic hit_rate r2_oos ic_t_stat var_5 downside_vol risk_adjusted_return kelly_fraction position_concentration turnover cost_drag trade_count avg_hold_days win_loss_ratio expectancy".split()
    return out.select(*names)


@query(
    f"""WITH {MASKS}, v2 AS (SELECT *, CASE WHEN COUNT(ret) OVER (w ROWS 4 PRECEDING) = 5 THEN STDDEV_SAMP(ret) OVER (w ROWS 4 PRECEDING) END AS sv, CASE WHEN COUNT(ret) OVER (w ROWS 59 PRECEDING) = 60 THEN STDDEV_SAMP(ret) OVER (w ROWS 59 PRECEDING) END AS lv FROM masks WINDOW w AS (PARTITION BY series_id ORDER BY t)),
g AS (SELECT series_id, t, LEAST(1, GREATEST(-1, signal)) AS p, high_vol OR COALESCE(sv, 0) > 0.95 * 0.7 OR COALESCE(lv > 0 AND sv > 1.2 * lv, false) AS fires FROM v2)
SELECT series_id, CAST(t AS INTEGER) AS t, ROUND(CASE WHEN fires THEN p * 0.25 ELSE p END, 6) AS position FROM g"""
)
def derated_positions(spark, sf_dir):
    rows = features.regime_masks(series(spark, sf_dir)).withColumn("crisis", F.col("high_vol"))
    return rounded(backtest.risk_gate(rows, margin=0.95, spike=1.2, derate=0.25).select("series_id", "t", "position"))


@query(f"WITH {RETURNS}, n AS (SELECT *, MAX(t) OVER (PARTITION BY series_id) AS n FROM series), f AS (SELECT series_id, CASE WHEN n > 750 THEN CAST(FLOOR((t - 751) / 5.0) AS INTEGER) ELSE 0 END AS fold, n FROM n) SELECT series_id, fold, CAST(MIN(GREATEST(1, 750 + fold * 5 - 299)) AS INTEGER) AS train_from, CAST(MIN(750 + fold * 5) AS INTEGER) AS train_to, COUNT(*) AS n FROM f WHERE fold >= 0 GROUP BY 1, 2")
def rolling_folds(spark, sf_dir):
    rows = backtest.walk_forward(series(spark, sf_dir), window=300)
    return rows.groupBy("series_id", "fold").agg(F.min("train_from").alias("train_from"), F.min("train_to").alias("train_to"), F.count("*").alias("n"))


@query(
    """WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.0 WHEN c_custkey % 4 = 1 THEN c_acctbal / 3 END AS bt, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 5 END AS alias_, c_acctbal / 7 AS hit FROM customer)
SELECT c_custkey, ROUND(COALESCE(NULLIF(bt, 0), alias_), 6) AS rank_ic, ROUND(hit, 6) AS hit_rate, 2 AS n_folds, ROUND(c_custkey / 2.0, 6) AS fold_mean FROM m"""
)
def metric_features(spark, sf_dir):
    k, x = F.col("c_custkey"), F.col("c_acctbal")
    bt = F.when(k % 4 == 0, 0.0).when(k % 4 == 1, x / 3)
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.create_map(F.lit("rank_ic"), bt).alias("bt"),
        F.create_map(F.lit("rank_information_coefficient"), F.when(k % 3 != 0, x / 5), F.lit("direction_accuracy"), x / 7).alias("metrics"),
        F.create_map(F.lit("crisis"), x).alias("regimes"),
        F.array(k.cast("double"), F.lit(0.0)).alias("folds"),
    )
    return rounded(selection.all_features(rows, "bt", "metrics", "regimes", "folds").select("c_custkey", "rank_ic", "hit_rate", "n_folds", "fold_mean"))


@query(f"WITH {PANEL}, rn AS (SELECT DISTINCT benchmark_id AS run_id, LENGTH(benchmark_id) AS created_at FROM panel WHERE benchmark_id NOT LIKE '2%') SELECT run_id, event_date, CAST(event_offset AS INTEGER) AS event_offset, ROUND(car_from_t0, 6) AS car_from_t0 FROM panel p JOIN rn ON rn.run_id = p.benchmark_id ORDER BY created_at DESC, benchmark_id, event_date, event_offset LIMIT 70")
def newest_panel_rows(spark, sf_dir):
    p = panel_rows(spark, sf_dir).withColumn("run_id", F.col("benchmark_id"))
    runs = p.where("not benchmark_id like '2%'").select("run_id", F.length("run_id").alias("created_at")).distinct()
    return newest_rows(p, runs, 70).select("run_id", "event_date", "event_offset", "car_from_t0")


@query()
def discovery_run(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("r1", F.col("ret")).withColumn("r5", F.col("signal") * 5)
    return discovery.discover(spark, s, ["r1", "r5"], {"r1": 1, "r5": 5}, 5, -1.0)
