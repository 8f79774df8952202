"""More queries of the research operators: evidence, genomes, deduplication, stability, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import dedup, evidence, genome, selection
from meridian.queries import (
    AXIS_ROWS,
    CANDIDATES,
    FACTOR_ROWS,
    FORMULAS,
    RETURNS,
    SHARPE,
    SQL,
    WIDE,
    evaluated,
    evaluated_sql,
    factors,
    formulas,
    joined_folds,
    query,
    ranked_sql,
    rounded,
    series,
    supplier_formulas,
)
from meridian.queries import causal_direction as direction_rows
from meridian.queries import causal_invariance as invariance_rows
from meridian.sources.tables import candidates, table

# --- crowding ---

RAMP = "CASE WHEN {x} <= {most} THEN 0 ELSE LEAST({scale}, ({x} - {most}) / (1 - {most}) * {scale}) END"
CROWD = f"""reg AS ({SQL["factor_regressions"]}),
crowd AS (SELECT series_id, arg_max(factor, (r2, factor)) AS top_factor, MAX(r2) AS max_r2, SUM(ABS(beta)) AS b, list_reverse_sort(LIST(ABS(beta))) AS bs FROM reg GROUP BY 1),
scores AS (SELECT series_id, top_factor, max_r2, CASE WHEN b > 1e-10 AND LEN(bs) >= 2 THEN list_sum(bs[1:3]) / b ELSE 1 END AS top3_share, {RAMP.format(x="max_r2", most=0.8, scale=0.3)} AS crowding_penalty, max_r2 <= 0.8 AS crowding_passed FROM crowd)"""


def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.factor_regressions(series(spark, sf_dir), factors(spark, sf_dir))
    return rounded(out.withColumn("resid_std", F.round("resid_std", 5)))


@query(f"WITH {CROWD} SELECT series_id, top_factor, ROUND(max_r2, 6) AS max_r2, ROUND(top3_share, 6) AS top3_share, ROUND(crowding_penalty, 6) AS crowding_penalty, crowding_passed FROM scores")
def crowding(spark, sf_dir):
    return rounded(evidence.crowding(regressions(spark, sf_dir)))


@query(
    f"""WITH {CROWD} SELECT COUNT(*) AS n, ROUND(AVG(max_r2), 6) AS mean_r2, ROUND(MAX(max_r2), 6) AS max_r2, CAST(SUM(CAST(crowding_passed AS INTEGER)) AS BIGINT) AS n_passed, CAST(SUM(1 - CAST(crowding_passed AS INTEGER)) AS BIGINT) AS n_failed, ROUND(AVG(CAST(crowding_passed AS INTEGER)), 6) AS pass_ratio,
  (SELECT string_agg(series_id || ':' || top_factor, ',' ORDER BY max_r2 DESC, series_id) FROM (SELECT * FROM scores ORDER BY max_r2 DESC, series_id LIMIT 5)) AS top_crowded FROM scores"""
)
def crowding_summary(spark, sf_dir):
    return rounded(evidence.crowding_summary(evidence.crowding(regressions(spark, sf_dir))))


FACTOR_VALUES = ", ".join(f"('{f}', {genome.TILT.get(fam, (1.0, 0.0))[0]}, {genome.TILT.get(fam, (1.0, 0.0))[1]}, {12_345 + sum(map(ord, f))})" for f, fam, _, _ in genome.FACTORS)
STATE = "CAST((CAST(1664525 AS BIGINT) * {s} + 1013904223) % 4294967296 AS BIGINT)"


@query(
    f"""WITH RECURSIVE {FORMULAS}, fv(factor, scale, shift, seed) AS (VALUES {FACTOR_VALUES}),
fr AS (SELECT factor, scale, shift, 1 AS t, {STATE.format(s="seed")} AS state FROM fv UNION ALL SELECT factor, scale, shift, t + 1 AS t, {STATE.format(s="state")} AS state FROM fr WHERE t < 60),
fx AS (SELECT factor, t, (state / 4294967296.0 * 2 - 1) * scale + shift AS x FROM fr),
seeds AS (SELECT s_suppkey, 99999 + SUM(unicode(substr(formula, i, 1))) AS seed FROM (SELECT s_suppkey, formula, UNNEST(range(1, LEAST(50, LENGTH(formula)) + 1)) AS i FROM f) GROUP BY 1),
r AS (SELECT s_suppkey, 1 AS t, {STATE.format(s="seed")} AS state FROM seeds UNION ALL SELECT s_suppkey, t + 1 AS t, {STATE.format(s="state")} AS state FROM r WHERE t < 60),
y AS (SELECT s_suppkey, t, state / 4294967296.0 * 2 - 1 AS y FROM r),
g AS (SELECT s_suppkey, factor, ROUND(COVAR_POP(x, y) / VAR_POP(x), 9) AS beta, ROUND(LEAST(1, COVAR_POP(x, y) * COVAR_POP(x, y) / (VAR_POP(x) * VAR_POP(y))), 9) AS r2 FROM y JOIN fx USING (t) GROUP BY 1, 2),
c AS (SELECT s_suppkey, arg_max(factor, (r2, factor)) AS top_factor, MAX(r2) AS max_r2, SUM(ABS(beta)) AS b, list_reverse_sort(LIST(ABS(beta))) AS bs FROM g GROUP BY 1),
k(factor_id, kw) AS (VALUES {FACTOR_ROWS}), o AS (SELECT s_suppkey, LEAST(1, SUM(CASE WHEN contains(LOWER(formula), kw) THEN 1 ELSE 0 END) / 16.0) AS overlap FROM f CROSS JOIN k GROUP BY 1)
SELECT s_suppkey AS series_id, top_factor, ROUND(max_r2, 6) AS max_r2, ROUND(list_sum(bs[1:3]) / b, 6) AS top3_share, ROUND({RAMP.format(x="max_r2", most=0.8, scale=0.3)}, 6) AS crowding_penalty, max_r2 <= 0.8 AS crowding_passed, ROUND(overlap, 6) AS factor_overlap FROM c JOIN o USING (s_suppkey)"""
)
def formula_crowding(spark, sf_dir):
    f = supplier_formulas(spark, sf_dir)
    proxies = genome.candidate_proxies(f, "s_suppkey", "formula")
    out = evidence.factor_regressions(proxies, F.broadcast(genome.factor_proxies(spark)), "signal")  # 16 factors, 60 steps
    out = out.withColumn("beta", F.round("beta", 9)).withColumn("r2", F.round("r2", 9))
    matches = genome.factor_matches(f, "formula").select(F.col("s_suppkey").alias("series_id"), "score")
    return rounded(evidence.crowding(out, matches=matches))


# --- fragility surface ---

LOOKBACKS, SCALES, COSTS, BASE = [5, 10, 20], [5.0, 10.0, 20.0], [1.0, 2.0, 4.0], (10, 10.0, 2.0)
_mean = lambda n: f"(SELECT series_id, t, target, {n} AS lookback, CASE WHEN COUNT(ret) OVER (w ROWS {n - 1} PRECEDING) = {n} THEN AVG(ret) OVER (w ROWS {n - 1} PRECEDING) END AS mean FROM series WINDOW w AS (PARTITION BY series_id ORDER BY t))"
GRID = f"""{RETURNS}, means AS ({" UNION ALL ".join(_mean(n) for n in LOOKBACKS)}),
pos AS (SELECT *, LEAST(GREATEST(mean * scale, -1.0), 1.0) AS position FROM means, (SELECT UNNEST(CAST({SCALES} AS DOUBLE[])) AS scale) WHERE mean IS NOT NULL AND target IS NOT NULL),
mv AS (SELECT *, COALESCE(ABS(position - LAG(position) OVER (PARTITION BY series_id, lookback, scale ORDER BY t)), 0) AS move FROM pos),
tested AS (SELECT series_id, lookback, scale, cost, {SHARPE.format(x="(position * target - move * cost * 1e-4)")} AS sharpe, lookback = {BASE[0]} AND scale = {BASE[1]} AND cost = {BASE[2]} AS is_baseline FROM mv, (SELECT UNNEST(CAST({COSTS} AS DOUBLE[])) AS cost) GROUP BY 1, 2, 3, 4),
agg AS (SELECT series_id, COUNT(*) AS n, AVG(sharpe) FILTER (WHERE is_baseline) AS baseline, AVG(sharpe) FILTER (WHERE NOT is_baseline) AS mean_sharpe, STDDEV_POP(sharpe) FILTER (WHERE NOT is_baseline) AS std_sharpe, MIN(sharpe) FILTER (WHERE NOT is_baseline) AS min_sharpe FROM tested GROUP BY 1),
two AS (SELECT *, CASE WHEN ABS(mean_sharpe) > 1e-10 THEN std_sharpe / ABS(mean_sharpe) ELSE std_sharpe END AS cv, LEAST(1, CASE WHEN baseline > 1e-10 THEN GREATEST(0, baseline - min_sharpe) / baseline WHEN min_sharpe > 0 THEN 0 ELSE 1 END) AS degradation FROM agg),
surface AS (SELECT *, 0.5 * LEAST(1, cv) + 0.5 * degradation AS fsi FROM two)"""


def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.backtest_grid(series(spark, sf_dir), LOOKBACKS, SCALES, COSTS, BASE)


@query(f"WITH {GRID} SELECT series_id, lookback, scale, cost, ROUND(sharpe, 6) AS sharpe, is_baseline FROM tested")
def parameter_backtests(spark, sf_dir):
    return rounded(tested(spark, sf_dir))


@query(f"WITH {GRID} SELECT series_id, n, ROUND(baseline, 6) AS baseline, ROUND(mean_sharpe, 6) AS mean_sharpe, ROUND(std_sharpe, 6) AS std_sharpe, ROUND(min_sharpe, 6) AS min_sharpe, ROUND(cv, 4) AS cv, ROUND(degradation, 6) AS degradation, ROUND(fsi, 6) AS fsi, ROUND(1 - fsi, 6) AS local_stability, ROUND({RAMP.format(x='fsi', most=0.4, scale=0.25)}, 6) AS fsi_penalty, fsi <= 0.4 AS fsi_passed FROM surface")
def fragility_surface(spark, sf_dir):
    out = evidence.fragility_surface(tested(spark, sf_dir), keys=["series_id"])
    return rounded(out.withColumn("cv", F.round("cv", 4)))


@query(f"WITH {GRID} SELECT COUNT(*) AS n, ROUND(AVG(fsi), 6) AS mean_fsi, ROUND(MEDIAN(fsi), 6) AS median_fsi, ROUND(MAX(fsi), 6) AS max_fsi, ROUND(MIN(fsi), 6) AS min_fsi, ROUND(AVG(1 - fsi), 6) AS mean_stability, COUNT(*) FILTER (WHERE fsi <= 0.4) AS n_passed, COUNT(*) FILTER (WHERE fsi > 0.4) AS n_failed, ROUND(AVG(CASE WHEN fsi <= 0.4 THEN 1.0 ELSE 0 END), 6) AS pass_ratio FROM surface")
def fragility_summary(spark, sf_dir):
    return rounded(evidence.surface_summary(evidence.fragility_surface(tested(spark, sf_dir), keys=["series_id"])))


@query(
    f"""WITH {GRID}, p AS (SELECT series_id, 'lookback' AS parameter, lookback AS value, AVG(sharpe) AS m FROM tested GROUP BY 1, 2, 3 UNION ALL SELECT series_id, 'scale' AS parameter, scale AS value, AVG(sharpe) AS m FROM tested GROUP BY 1, 2, 3
  UNION ALL SELECT series_id, 'cost' AS parameter, cost AS value, AVG(sharpe) AS m FROM tested GROUP BY 1, 2, 3) SELECT series_id, parameter, ROUND(MAX(m) - MIN(m), 6) AS sensitivity FROM p GROUP BY 1, 2"""
)
def parameter_sensitivity(spark, sf_dir):
    return rounded(evidence.parameter_sensitivity(tested(spark, sf_dir), ["lookback", "scale", "cost"], ["series_id"]))


# --- regimes and causes ---

NAMES = list(evidence.REGIME_KEYS)[:7]
RECORDS = f"""{CANDIDATES}, e AS (SELECT candidate_id, UNNEST({list(evidence.REGIME_KEYS.values())[:7]!r}) AS regime, UNNEST([folds[1], folds[2], folds[3], folds[4], folds[5], folds[6], folds[7]]) AS x FROM cand),
up AS (SELECT *, SUM(x) OVER (PARTITION BY candidate_id) AS tot FROM e WHERE x > 0),
rec AS (SELECT candidate_id, COUNT(*) AS n, SUM(-(x / tot) * LN(x / tot)) AS h, arg_max(regime, x) AS dom, MAX(x / tot) AS w FROM up GROUP BY 1),
full_ AS (SELECT c.candidate_id, COALESCE(n, 0) AS n_regimes, CASE WHEN n >= 2 THEN h ELSE 0 END AS entropy, CASE WHEN n >= 2 THEN LEAST(1, h / LN(n)) ELSE 0 END AS ne, CASE WHEN n >= 2 THEN LN(n) ELSE 0 END AS max_entropy, dom, COALESCE(w, 0) AS w FROM cand c LEFT JOIN rec r ON c.candidate_id = r.candidate_id),
records AS (SELECT *, CASE WHEN n_regimes >= 2 THEN LEAST(1, ne * CASE WHEN n_regimes >= 3 THEN 1.0 ELSE 0.85 END) ELSE 0 END AS balance FROM full_)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's yearly values under the names of features that regimes are read from."""
    rows = joined_folds(candidates(table(spark, sf_dir, "lineitem")))
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in NAMES]), F.array(*[F.get("folds", F.lit(i)) for i in range(len(NAMES))]))
    rows = rows.select("candidate_id", evidence.regime_sharpes(pairs, finite=False).alias("sharpes"))
    return evidence.entropy_record(rows, "sharpes")


@query(f"WITH {RECORDS} SELECT candidate_id, ROUND(entropy, 6) AS entropy, ROUND(ne, 6) AS normalized_entropy, ROUND(balance, 6) AS balance, CAST(n_regimes AS INTEGER) AS n_regimes, ROUND(max_entropy, 6) AS max_entropy, dom AS dominant_regime, ROUND(w, 6) AS dominant_weight, ne >= 0.6 AS is_balanced FROM records")
def regime_records(spark, sf_dir):
    out = records(spark, sf_dir)
    return rounded(out.select("candidate_id", "entropy", "normalized_entropy", "balance", "n_regimes", "max_entropy", "dominant_regime", "dominant_weight", "is_balanced"))


@query(f"WITH {RECORDS} SELECT COUNT(*) AS n, ROUND(AVG(ne), 6) AS mean_entropy, ROUND(MEDIAN(ne), 6) AS median_entropy, COUNT(*) FILTER (WHERE ne >= 0.6) AS n_balanced, COUNT(*) FILTER (WHERE ne < 0.6) AS n_unbalanced, ROUND(AVG(CASE WHEN ne >= 0.6 THEN 1.0 ELSE 0 END), 6) AS balanced_ratio, ROUND(AVG(balance), 6) AS mean_balance FROM records")
def regime_entropy_summary(spark, sf_dir):
    return rounded(evidence.entropy_summary(records(spark, sf_dir)))


@query(
    f"""WITH d AS ({SQL["causal_direction"]}), i AS ({SQL["causal_invariance"]}),
j AS (SELECT *, LEAST(1, (CASE WHEN ABS(forward) > 1e-10 THEN LEAST(1, ABS(backward) / ABS(forward)) WHEN ABS(backward) > 0.05 THEN 1 ELSE 0 END + (1 - coefficient_stability) * 0.3) / 1.3) AS risk FROM d JOIN i USING (series_id))
SELECT series_id, causal_direction_score, invariance_pass_ratio, ROUND(SQRT(causal_direction_score * invariance_pass_ratio), 6) AS intervention_consistency_score, ROUND(risk, 6) AS confounding_risk_score, ROUND(causal_direction_score * 0.4 + invariance_pass_ratio * 0.4 + (1 - risk) * 0.2, 6) AS causal_validity_score,
  CAST((causal_direction_score < 0.6)::INT + (invariance_pass_ratio < 0.7)::INT AS INTEGER) AS n_failed FROM j"""
)
def causal_diagnostics(spark, sf_dir):
    out = evidence.causal_diagnostics(direction_rows(spark, sf_dir), invariance_rows(spark, sf_dir))
    return rounded(out.withColumn("n_failed", F.size("failures")).drop("failures"))


# --- stability ---


@query(f"WITH {CANDIDATES} SELECT candidate_id, CASE WHEN k = 7 THEN ROUND(((folds[1] > 0 AND folds[4] <= 0)::INT + (folds[2] > 0 AND folds[5] <= 0)::INT + (folds[3] > 0 AND folds[6] <= 0)::INT) / 3.0, 6) ELSE 0.5 END AS pbo_pairs FROM cand")
def overfit_pairs(spark, sf_dir):
    f = F.col("folds")
    whole = F.size(f) == 7
    out = selection.pbo_pairs(F.when(whole, F.slice(f, 1, 3)), F.when(whole, F.slice(f, 4, 3)), finite=False)
    open_ = [((F.get(f, F.lit(i)) > 0) & (F.get(f, F.lit(i + 3)) <= 0)).isNull() for i in range(3)]
    out = F.when(~(whole & (open_[0] | open_[1] | open_[2])), out)  # a pair that a NULL leaves open
    return rounded(candidates(table(spark, sf_dir, "lineitem")).select("candidate_id", out.alias("pbo_pairs")))


RANKINGS = f"""{CANDIDATES}, places AS (SELECT 'R' || CAST(l_suppkey % 5 AS VARCHAR) AS run_id, y AS fold, 'C' || CAST(l_suppkey AS VARCHAR) AS candidate_id, ROW_NUMBER() OVER (PARTITION BY l_suppkey % 5, y ORDER BY ROUND(v, 9) DESC, l_suppkey) AS place FROM yearly)"""


@query(
    f"""WITH {RANKINGS}, top AS (SELECT * FROM places WHERE place <= 5), sz AS (SELECT run_id, fold, COUNT(*) AS n FROM top GROUP BY 1, 2),
pr AS (SELECT a.run_id, a.fold AS fa, b.fold AS fb, a.n AS na, b.n AS nb FROM sz a JOIN sz b ON a.run_id = b.run_id AND a.fold < b.fold),
bo AS (SELECT a.run_id, a.fold AS fa, b.fold AS fb, COUNT(*) AS c FROM top a JOIN top b ON a.run_id = b.run_id AND a.candidate_id = b.candidate_id AND a.fold < b.fold GROUP BY 1, 2, 3)
SELECT run_id, ROUND(AVG(COALESCE(c, 0) / CAST(na + nb - COALESCE(c, 0) AS DOUBLE)), 6) AS overlap FROM pr LEFT JOIN bo USING (run_id, fa, fb) GROUP BY 1"""
)
def top_k_overlap(spark, sf_dir):
    from pyspark.sql import Window

    rows = candidates(table(spark, sf_dir, "lineitem")).select(F.concat(F.lit("R"), (F.col("ord") % 5).cast("string")).alias("run_id"), "candidate_id", "ord", F.posexplode("folds").alias("fold", "v"))
    place = F.row_number().over(Window.partitionBy("run_id", "fold").orderBy(F.round("v", 9).desc(), "ord"))
    return rounded(selection.top_k_overlap(rows.withColumn("place", place)))


@query(
    f"""WITH {evaluated_sql(WIDE)}, c AS (SELECT candidate_id, UNNEST(['predictive_score', 'oos_sharpe_score', 'regime_stability_score', 'selection_consistency_score', 'capacity_score', 'pbo_penalty', 'turnover_penalty', 'complexity_penalty', 'drawdown_penalty', 'fragility_penalty']) AS component,
  UNNEST([predictive, sharpe_score, regime, consistency, capacity, pbo, ABS(turnover) / {WIDE.max_turnover}, complexity, ABS(max_drawdown) / {WIDE.max_drawdown}, s]) AS x FROM gated) SELECT candidate_id, component, ROUND(LEAST(1, GREATEST(0, x)), 6) AS value FROM c"""
)
def score_components(spark, sf_dir):
    out = selection.components(evaluated(spark, sf_dir, WIDE))
    return rounded(out.select("candidate_id", F.explode("components").alias("component", "value")))


# --- deduplication ---

SETS = """f AS (SELECT p_name || ' ' || p_type AS f, MIN(p_partkey) AS id FROM part GROUP BY 1), s AS (SELECT id, f, [x FOR x IN LIST_DISTINCT(string_split_regex(translate(f, '()', '  '), '\\s+')) IF x <> ''] AS s FROM f),
near AS (SELECT b.id AS id, LIST(a.id ORDER BY a.id) AS before FROM s a JOIN s b ON a.id < b.id WHERE LEN(LIST_INTERSECT(a.s, b.s)) >= 0.5 * LEN(LIST_DISTINCT(LIST_CONCAT(a.s, b.s))) GROUP BY 1),
seq AS (SELECT f.id, before, ROW_NUMBER() OVER (ORDER BY f.id) AS i FROM f LEFT JOIN near ON f.id = near.id)"""


@query(
    f"""WITH RECURSIVE {SETS}, w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS by_
UNION ALL SELECT n.i AS i, CASE WHEN n.hit IS NULL THEN list_append(n.kept, n.id) ELSE n.kept END AS kept, n.id AS id, n.hit AS by_ FROM (SELECT seq.i, w.kept, CAST(seq.id AS BIGINT) AS id, CAST([x FOR x IN COALESCE(seq.before, []) IF list_contains(w.kept, x)][1] AS BIGINT) AS hit FROM w JOIN seq ON seq.i = w.i + 1) n)
SELECT id, by_ AS suppressed_by FROM w WHERE by_ IS NOT NULL"""
)
def structural_dedup(spark, sf_dir):
    f = formulas(spark, sf_dir).select(F.col("id").alias("candidate_id"), F.col("id").alias("ord"), "formula")
    return dedup.structural(f, [], "formula", least=0.5).select(F.col("id").cast("long").alias("id"), F.col("suppressed_by").cast("long").alias("suppressed_by"))


@query("SELECT p_partkey AS id, MIN(p_partkey) OVER (PARTITION BY p_name, p_type) AS first_id FROM part")
def formula_copies(spark, sf_dir):
    text = F.concat_ws(" ", "p_name", "p_type").alias("formula")
    first = formulas(spark, sf_dir).withColumnRenamed("id", "first_id")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text).join(first, "formula").select("id", "first_id")


TASTE = """taste AS (SELECT series_id AS id, ROUND(AVG(ABS(ret)), 6) AS complexity_penalty, CAST(LENGTH(series_id) % 3 AS DOUBLE) / 3 AS crowding_penalty, ROUND(MAX(ret), 6) AS regime_entropy_score FROM series GROUP BY 1)"""
WALK = f"""{RETURNS}, {TASTE}, pairs AS (SELECT a.series_id AS a, b.series_id AS b, ROUND(CORR(a.signal, b.signal), 6) AS corr FROM series a JOIN series b ON a.t = b.t AND a.series_id < b.series_id WHERE a.signal IS NOT NULL AND b.signal IS NOT NULL GROUP BY 1, 2),
turn AS (SELECT p.*, ROW_NUMBER() OVER (ORDER BY ABS(corr) DESC, a, b) AS i, CASE WHEN (ta.complexity_penalty, ta.crowding_penalty, -ta.regime_entropy_score) <= (tb.complexity_penalty, tb.crowding_penalty, -tb.regime_entropy_score) THEN b ELSE a END AS loser FROM pairs p JOIN taste ta ON ta.id = a JOIN taste tb ON tb.id = b WHERE ABS(corr) > 0.01),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS gone, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS by_ UNION ALL
  SELECT x.i AS i, CASE WHEN x.open_ THEN list_append(x.gone, x.loser) ELSE x.gone END AS gone, CASE WHEN x.open_ THEN x.loser END AS id, CASE WHEN x.open_ THEN CASE WHEN x.loser = x.a THEN x.b ELSE x.a END END AS by_
  FROM (SELECT turn.*, w.gone, NOT list_contains(w.gone, turn.a) AND NOT list_contains(w.gone, turn.b) AS open_ FROM w JOIN turn ON turn.i = w.i + 1) x)"""


def signal_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = series(spark, sf_dir)
    taste = s.groupBy(F.col("series_id").alias("candidate_id")).agg(F.round(F.avg(F.abs("ret")), 6).alias("complexity_penalty"), F.round(F.max("ret"), 6).alias("regime_entropy_score"))
    taste = taste.withColumn("crowding_penalty", (F.length("candidate_id") % 3).cast("double") / 3)
    return taste, rounded(evidence.pairwise_correlation(s, "signal"))


@query(f"WITH RECURSIVE {WALK} SELECT id, by_ AS suppressed_by FROM w WHERE id IS NOT NULL")
def signal_dedup(spark, sf_dir):
    taste, pairs = signal_inputs(spark, sf_dir)
    return dedup.by_preference(pairs, taste, 0.01)


@query(f"WITH RECURSIVE {WALK} SELECT s.candidate_id, w.by_ AS suppressed_by_signal_dedup FROM (SELECT DISTINCT series_id AS candidate_id FROM series) s LEFT JOIN w ON w.id = s.candidate_id")
def suppressed_evaluations(spark, sf_dir):
    taste, pairs = signal_inputs(spark, sf_dir)
    return dedup.mark(taste, dedup.by_preference(pairs, taste, 0.01), "suppressed_by_signal_dedup").select("candidate_id", "suppressed_by_signal_dedup")


@query(f"WITH RECURSIVE {WALK}, st AS (SELECT series_id AS id FROM (SELECT DISTINCT series_id FROM series) WHERE LENGTH(series_id) > 99) SELECT id, 'signal' AS axis, by_ AS suppressed_by FROM w WHERE id IS NOT NULL UNION ALL SELECT id, 'structural' AS axis, id AS suppressed_by FROM st")
def dedup_run(spark, sf_dir):
    taste, pairs = signal_inputs(spark, sf_dir)
    rows = taste.select("candidate_id", F.xxhash64("candidate_id").alias("ord"), F.col("candidate_id").alias("formula"))  # no two names are alike
    return dedup.run(rows, taste, pairs, most=0.01)


@query(
    """SELECT a.n_name AS a, b.n_name AS b, ROUND((SELECT COUNT(*) FROM (SELECT UNNEST(RANGE(1, LEAST(LENGTH(a.n_name), LENGTH(b.n_name)) + 1)) AS i) WHERE SUBSTR(a.n_name, 1, i) = SUBSTR(b.n_name, 1, i)) / CAST(GREATEST(LENGTH(a.n_name), LENGTH(b.n_name)) AS DOUBLE), 6) AS similarity
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"""
)
def prefix_similarity(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b"))
    return rounded(a.join(b, "n_regionkey").where("ka < kb").select("a", "b", dedup.prefix_similarity(F.col("a"), F.col("b")).alias("similarity")))


# --- genomes ---

GENOMES = f"""{FORMULAS}, k(i, axis, kw, w) AS (VALUES {AXIS_ROWS}), t AS (SELECT s_suppkey, UNNEST(REGEXP_EXTRACT_ALL(LOWER(formula), '[a-z_][a-z0-9_]*')) AS tok FROM f),
s AS (SELECT s_suppkey, i, axis, SUM(CASE WHEN contains(tok, kw) OR contains(kw, tok) THEN w ELSE 0 END) AS raw FROM t CROSS JOIN k GROUP BY 1, 2, 3),
v AS (SELECT *, SUM(raw) OVER (PARTITION BY s_suppkey) AS total FROM s), x AS (SELECT *, CASE WHEN total > 1e-10 THEN raw / total ELSE 0.1 END AS share FROM v),
g AS (SELECT s_suppkey AS id, LIST(ROUND(share, 9) ORDER BY i) AS g, arg_max(axis, (ROUND(share, 9), -i)) AS axis, arg_max(i, (ROUND(share, 9), -i)) AS place, LEAST(1.0, COUNT(CASE WHEN raw > 0 THEN 1 END) / 5.0) AS confidence FROM x GROUP BY 1),
m AS (SELECT *, MIN(id) OVER (PARTITION BY g) AS rep, COUNT(*) OVER (PARTITION BY g) AS n FROM g),
r AS (SELECT DISTINCT g, rep, n FROM m), cs AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, ROUND(list_cosine_similarity(CAST(a.g AS DOUBLE[]), CAST(b.g AS DOUBLE[])), 6) AS s FROM r a JOIN r b ON a.rep <> b.rep)"""


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genomes to 9 places, so that equal ones do not differ by the order of their sums."""
    g = genome.encode(supplier_formulas(spark, sf_dir), "formula")
    return g.withColumn("genome", F.transform("genome", lambda x: F.round(x, 9)))


@query(f"WITH {GENOMES} SELECT a, b, s AS similarity, false AS equal FROM cs WHERE a < b AND s >= 0.9 UNION ALL SELECT rep AS a, id AS b, 1.0 AS similarity, true AS equal FROM m WHERE id > rep")
def genome_near_duplicates(spark, sf_dir):
    return rounded(genome.near_duplicates(genomes(spark, sf_dir), "s_suppkey"))


@query(f"WITH {GENOMES} SELECT a, b, s AS similarity FROM cs WHERE s >= 0.9")
def genome_similarities(spark, sf_dir):
    return rounded(genome.symmetric(genome.similar(genomes(spark, sf_dir), "s_suppkey")))


@query(f"WITH {GENOMES}, b AS (SELECT id, 1 - COALESCE(GREATEST(CASE WHEN n > 1 THEN 1.0 END, (SELECT MAX(s) FROM cs WHERE cs.a = m.rep)), 0) AS novelty, n - 1 + COALESCE((SELECT SUM(nb) FROM cs WHERE cs.a = m.rep AND s >= 0.9), 0) AS near, axis, confidence FROM m) SELECT id AS s_suppkey, axis AS dominant_axis, ROUND(confidence, 6) AS confidence, ROUND(novelty, 6) AS novelty, novelty >= 0.2 AS is_novel, CAST(near AS BIGINT) AS n_near FROM b")
def genome_layer(spark, sf_dir):
    return rounded(genome.layer(supplier_formulas(spark, sf_dir), "s_suppkey", "formula"))


@query(f"WITH {GENOMES} SELECT id AS s_suppkey, CAST(place AS INTEGER) AS genome_dominant_axis, {', '.join(f'ROUND(g[{i + 1}], 6) AS genome_{a}' for i, a in enumerate(genome.AXES))} FROM g")
def genome_features(spark, sf_dir):
    return rounded(genome.axis_rows(genomes(spark, sf_dir), "s_suppkey"))


@query(f"WITH {GENOMES}, d AS (SELECT x.axis, x.i, AVG(share) AS mw, COUNT(CASE WHEN g.axis = x.axis THEN 1 END) AS nd FROM x JOIN g ON g.id = x.s_suppkey GROUP BY 1, 2) SELECT axis, ROUND(mw, 6) AS mean_weight, nd AS n_dominant, ROW_NUMBER() OVER (ORDER BY nd DESC, i) = 1 AS most_common FROM d")
def genome_report(spark, sf_dir):
    return rounded(genome.axis_report(genomes(spark, sf_dir)))


@query(f"WITH {GENOMES}, n AS (SELECT axis, COUNT(*) AS n FROM g GROUP BY 1), p AS (SELECT a.axis, AVG(list_cosine_similarity(CAST(a.g AS DOUBLE[]), CAST(b.g AS DOUBLE[]))) AS c FROM g a JOIN g b ON a.axis = b.axis AND a.id < b.id GROUP BY 1) SELECT axis AS dominant_axis, n, ROUND(COALESCE(c, 1), 6) AS cohesion FROM n LEFT JOIN p USING (axis)")
def genome_cohesion(spark, sf_dir):
    return rounded(genome.cohesion(genomes(spark, sf_dir), "dominant_axis"))


@query(f"WITH {GENOMES} SELECT a.rep AS a, b.rep AS b, ROUND(list_distance(CAST(a.g AS DOUBLE[]), CAST(b.g AS DOUBLE[])), 6) AS distance FROM r a JOIN r b ON a.rep < b.rep WHERE list_cosine_similarity(CAST(a.g AS DOUBLE[]), CAST(b.g AS DOUBLE[])) >= 0.9")
def genome_distances(spark, sf_dir):
    g = genomes(spark, sf_dir)
    one = genome.members(g, "s_suppkey").where("id = representative").select("id", "genome")
    pairs = genome.similar(g, "s_suppkey").join(one.toDF("a", "ga"), "a").join(one.toDF("b", "gb"), "b")
    return rounded(pairs.select("a", "b", genome.distance(F.col("ga"), F.col("gb")).alias("distance")))


# --- views over runs ---


@query(f"WITH {ranked_sql(WIDE)} SELECT run_id, candidate_id, ROUND(score, 6) AS score, decision, CAST(decision_rank AS INTEGER) AS decision_rank FROM decided WHERE run_id IN (SELECT run_id FROM decided GROUP BY 1 ORDER BY MAX(ord) DESC, run_id LIMIT 1)")
def latest_run_scores(spark, sf_dir):
    from meridian.queries import decided

    rows = decided(spark, sf_dir)
    last = rows.groupBy("run_id").agg(F.max("ord").alias("o")).orderBy(F.desc("o"), "run_id").limit(1).select("run_id")
    return rounded(rows.join(last, "run_id", "left_semi").select("run_id", "candidate_id", "score", "decision", "decision_rank"))


@query(f"WITH {ranked_sql(WIDE)} SELECT run_id, candidate_id, ROUND(score, 6) AS score, CAST(ROW_NUMBER() OVER (ORDER BY score DESC, ord) AS INTEGER) AS place FROM decided WHERE promotion_eligible QUALIFY place <= 100")
def pending_promotions(spark, sf_dir):
    from pyspark.sql import Window

    from meridian.queries import decided

    rows = decided(spark, sf_dir).where("promotion_eligible").orderBy(F.desc("score"), "ord").limit(100)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "ord"))  # of a hundred rows
    return rounded(rows.select("run_id", "candidate_id", "score", place.alias("place")))


@query("SELECT c_custkey, COUNT(o_orderkey) AS n_done, ROUND(COALESCE(SUM(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def residual_left_join(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = c.join(o, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "F"), "left")
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_done"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@query(f"WITH {RETURNS}, s AS (SELECT series_id, STDDEV_SAMP(ret) AS sd, AVG(ret) AS m FROM series GROUP BY 1) SELECT series_id, t, ROUND((LEAST(3, GREATEST(-3, (ret - m) / sd)) + 3) / 6, 6) AS unit FROM series JOIN s USING (series_id)")
def unit_scores(spark, sf_dir):
    from meridian.functions.stats import clip

    s = series(spark, sf_dir)
    stats = s.groupBy("series_id").agg(F.stddev_samp("ret").alias("sd"), F.avg("ret").alias("m"))
    z = clip((F.col("ret") - F.col("m")) / F.col("sd"), -3.0, 3.0)
    return rounded(s.join(stats, "series_id").select("series_id", F.col("t").cast("long").alias("t"), evidence.unit_interval(z).alias("unit")))


@query("SELECT status, COUNT(*) AS n FROM (SELECT CASE WHEN s_nationkey < 25 THEN 'resolved' ELSE 'unresolved' END AS status FROM supplier) GROUP BY 1")
def resolution_status(spark, sf_dir):
    from meridian.queries import rule_resolution

    return rule_resolution(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {ranked_sql(WIDE)}, e AS (SELECT decision, 'decision_' || LOWER(decision) AS event_type FROM decided UNION ALL SELECT decision, 'promotion_candidate' AS event_type FROM decided WHERE decision = 'SELECTED') SELECT decision, COUNT(*) AS n, COUNT(DISTINCT event_type) AS n_types FROM e GROUP BY 1")
def audit_summary(spark, sf_dir):
    from meridian.operators import governance
    from meridian.queries import decided

    return governance.audit_rows(decided(spark, sf_dir)).groupBy("decision").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("n_types"))
