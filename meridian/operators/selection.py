"""Selection of candidates: fold stability, overfit probability, scores, gates, ranking, decisions.

A candidate is a row; everything up to the ranking is a projection of that row, so it
runs without a shuffle. The ranking and the limits are windows over a run's evaluations: over those of one
``run_id`` where there is such a column, so no task holds more than a run.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.stats import clip, fixed, mean, positive_share, spread


#: The defaults of the weights, gates and limits.
@dataclass(frozen=True)
class Config:
    """Weights, gates and limits of a run."""

    w_predictive: float = 0.20
    w_oos_sharpe: float = 0.15
    w_regime_stability: float = 0.15
    w_selection_consistency: float = 0.10
    w_capacity: float = 0.10
    w_pbo_penalty: float = 0.02
    w_turnover_penalty: float = 0.10
    w_complexity_penalty: float = 0.05
    w_drawdown_penalty: float = 0.05
    w_fragility_penalty: float = 0.03
    pbo_threshold: float = 0.20
    min_oos_sharpe: float = 0.50
    min_rank_ic: float = 0.02
    max_turnover: float = 4.0
    max_drawdown: float = 0.20
    min_regime_pass_ratio: float = 0.75
    max_complexity_score: float = 0.60
    min_selection_stability: float = 0.60
    top_k: int = 25
    promotion_top_k: int = 5
    max_same_family: int = 3
    review_margin: float = 0.05


# --- stability of fold values ---


def _steadiness(values: Column, small: float, otherwise: Column, least: int) -> Column:
    m, s = mean(values), spread(values)
    return F.when(F.size(values) < least, 0.5).when(F.abs(m) < small, otherwise).otherwise(clip(1 - s / F.abs(m) / 2, 0.0, 1.0))


def sharpe_stability(folds: Column, least: int = 3) -> Column:
    return _steadiness(folds, 0.01, clip(1 - spread(folds) / 2, 0.0, 1.0), least)


def ic_stability(folds: Column, least: int = 3) -> Column:
    return _steadiness(folds, 0.001, F.greatest(1 - spread(folds), F.lit(0.0)), least)


def sign_stability(values: Column) -> Column:
    up = positive_share(values)
    return F.when(F.size(values) > 0, F.greatest(up, 1 - up)).otherwise(0.5)


def regime_deviation(values: Column) -> Column:
    m, s = mean(values), spread(values)
    loss = F.when(F.abs(m) < 0.01, s * 2).otherwise(s / F.abs(m))
    return F.when(F.size(values) < 2, 0.5).otherwise(1 - F.least(loss, F.lit(1.0)))


def selection_consistency(sharpes: Column, ics: Column, regimes: Column) -> Column:
    return clip(0.35 * sharpe_stability(sharpes) + 0.25 * ic_stability(ics) + 0.2 * sign_stability(sharpes) + 0.2 * regime_deviation(regimes), 0.0, 1.0)


def selection_fragility(folds: Column) -> Column:
    """The largest shift of the mean when one fold is left out, on a scale of 0.5."""
    m = mean(folds)
    far = F.array_max(F.transform(folds, lambda x: F.abs(x - m)))
    return F.when(F.size(folds) < 3, 0.5).otherwise(F.least(F.lit(1.0), far / (F.size(folds) - 1) / 0.5))


def fold_splits(n: int, most: int = 256) -> list[tuple[int, ...]]:
    """Halves of n folds, of many an even stride."""
    every = list(itertools.combinations(range(n), n // 2))
    return every[:: len(every) // most][:most] if len(every) > most else every


def _loses(pick):
    """1 where the best value inside is below the median of the values outside; what is NULL counts on neither side."""

    def loses(inside: Column, outside: Column) -> Column:
        others = F.array_sort(F.array_compact(pick(outside)))
        middle = (F.get(others, F.floor((F.size(others) - 1) / 2).cast("int")) + F.get(others, F.floor(F.size(others) / 2).cast("int"))) / 2
        return F.when(F.array_max(pick(inside)) < middle, 1.0).otherwise(0.0)

    return loses


def pbo_fold_split(df: DataFrame, folds: str, least: int = 4) -> DataFrame:
    """``df`` with ``pbo_raw``: the share of splits whose best in-sample fold is below the out-of-sample median.

    The splits depend on the number of folds alone; each number that occurs gets its
    table as an array literal, so a candidate's row is enough.
    """
    sizes = [r[0] for r in df.select(F.size(folds).alias("n")).where(F.col("n") >= least).distinct().collect()]  # a few fold counts
    out = F.lit(0.5)
    for n in sorted(sizes):
        splits = F.array(*[F.array(*[F.lit(i) for i in s]) for s in fold_splits(n)])
        rest = F.array(*[F.array(*[F.lit(i) for i in range(n) if i not in s]) for s in fold_splits(n)])
        pick = lambda a: F.transform(a, lambda i: F.get(F.col(folds), i))

        value = F.aggregate(F.zip_with(splits, rest, _loses(pick)), F.lit(0.0), lambda s, x: s + x) / F.size(splits)
        out = F.when(F.size(folds) == n, value).otherwise(out)
    return df.withColumn("pbo_raw", out)


def pbo_pairs(inside: Column, outside: Column, finite: bool = True) -> Column:
    """The share of pairs whose in-sample value is above zero and whose other one is not; 0.5 without pairs of equal number.

    What is NULL counts as zero, and so does what is not finite unless ``finite`` is false.
    """
    odd = lambda x: F.isnan(x) | (F.abs(x) == float("inf")) if finite else F.lit(False)
    zero = lambda x: F.when(odd(x), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))
    bad = F.filter(F.arrays_zip(inside.alias("a"), outside.alias("b")), lambda x: (zero(x["a"]) > 0) & (zero(x["b"]) <= 0))
    known = (F.size(inside) > 0) & (F.size(inside) == F.size(outside))
    return F.when(F.coalesce(known, F.lit(False)), F.size(bad) / F.size(inside)).otherwise(0.5)


def combined_pbo(pbo_raw: Column, fragility: Column) -> Column:
    return clip(0.7 * pbo_raw + 0.3 * fragility, 0.0, 1.0)


# --- scores ---


def predictive_score(rank_ic: Column, ic_t: Column, hit_rate: Column) -> Column:
    base = F.coalesce(F.least(F.abs(rank_ic) / 0.1, F.lit(1.0)), F.lit(0.0))
    t = F.coalesce(F.when(F.abs(ic_t) > 2, F.least((F.abs(ic_t) - 2) * 0.05, F.lit(0.1))), F.lit(0.0))
    hit = F.coalesce(F.when(hit_rate > 0.55, F.least((hit_rate - 0.55) * 0.5, F.lit(0.1))), F.lit(0.0))
    return F.least(F.lit(1.0), base + t + hit)


def oos_sharpe_score(x: Column) -> Column:
    return F.coalesce(clip(x / 2, 0.0, 1.0), F.lit(0.0))


def regime_stability_score(pass_ratio: Column, crisis: Column) -> Column:
    bonus = F.coalesce(F.when(crisis > 0, F.least(crisis / 4, F.lit(0.2))), F.lit(0.0))
    return F.when(pass_ratio.isNull(), 0.5).otherwise(F.least(F.lit(1.0), pass_ratio + bonus))


def capacity_score(turnover: Column, complexity: Column) -> Column:
    x = F.exp(-0.3 * F.greatest(F.lit(0.0), F.coalesce(turnover, F.lit(2.0)) - 1))
    return clip(x * F.when(complexity > 0.5, F.greatest(F.lit(0.3), 1 - (complexity - 0.5))).otherwise(1.0), 0.0, 1.0)


def penalty(x: Column, most: float) -> Column:
    return F.coalesce(clip(F.abs(x) / most, 0.0, 1.0), F.lit(0.0))


def fragility_penalty(folds: Column) -> Column:
    """The standard deviation of the folds' values, at most 1."""
    return F.least(F.lit(1.0), spread(folds))


def components(df: DataFrame, evidence: bool = False) -> DataFrame:
    """``df`` with ``components``: a map of the scores and penalties that make its score, and of the evidence axes."""
    names = [*(f"{n}_score" for n in PLUS), *(f"{n}_penalty" for n in MINUS)]
    if evidence:
        names += [*(f"{n}_score" for n in EVIDENCE_PLUS), *(f"{n}_penalty" for n in EVIDENCE_MINUS)]
    pairs = [x for n in names if n in df.columns for x in (F.lit(n), clip(F.col(n).cast("double"), 0.0, 1.0))]
    return df.withColumn("components", F.create_map(*pairs))


#: The components of the score.
PLUS = ("predictive", "oos_sharpe", "regime_stability", "selection_consistency", "capacity")
MINUS = ("pbo", "turnover", "complexity", "drawdown", "fragility")


def score(df: DataFrame, config: Config = Config()) -> DataFrame:
    """``df`` with its score, from the columns of the components."""
    add = reduce(lambda a, b: a + b, [getattr(config, f"w_{n}") * clip(F.col(f"{n}_score"), 0.0, 1.0) for n in PLUS])
    less = reduce(lambda a, b: a + b, [getattr(config, f"w_{n}_penalty") * clip(F.col(f"{n}_penalty"), 0.0, 1.0) for n in MINUS])
    return df.withColumn("score", add - less)


#: Weights of the evidence axes.
EVIDENCE_PLUS = {"genome_novelty": 0.05, "causal_validity": 0.05, "regime_entropy": 0.05}
EVIDENCE_MINUS = {"crowding": 0.05, "signal_duplication": 0.03, "fragility_surface": 0.02}


def score_with_evidence(df: DataFrame, config: Config = Config()) -> DataFrame:
    """``df`` with its score and score_v2, which adds the evidence axes; a column that is missing counts as 0.5 or no penalty. A score that is there is kept."""
    have = lambda c, d: clip(F.coalesce(F.col(c), F.lit(d)), 0.0, 1.0) if c in df.columns else F.lit(d)
    more = reduce(lambda a, b: a + b, [w * have(f"{n}_score", 0.5) for n, w in EVIDENCE_PLUS.items()], F.col("score"))
    less = reduce(lambda a, b: a + b, [w * have(f"{n}_penalty", 0.0) for n, w in EVIDENCE_MINUS.items()])
    return (df if "score" in df.columns else score(df, config)).withColumn("score_v2", more - less)


#: The evidence gates, column, sign and bound.
EVIDENCE_GATES = [("causal_direction_score", "<", 0.60), ("invariance_pass_ratio", "<", 0.70), ("genome_novelty_score", "<", 0.20), ("crowding_r2", ">", 0.80), ("fsi", ">", 0.40), ("regime_entropy", "<", 0.60), ("signal_corr", ">", 0.90)]


def evidence_gates(df: DataFrame) -> DataFrame:
    """``df``, gated before, with the failures of the evidence gates added; what is NULL or missing passes."""
    said = [F.when(F.col(c) < x if sign == "<" else F.col(c) > x, F.format_string(f"{c}=%.4f {sign} {'min' if sign == '<' else 'max'}=%.4f", F.col(c).cast("double"), F.lit(x))) for c, sign, x in EVIDENCE_GATES if c in df.columns]
    out = df.withColumn("gate_failures", F.concat("gate_failures", F.array_compact(F.array(*said)))) if said else df
    return out.withColumn("gate_passed", F.size("gate_failures") == 0)


#: A feature and the name to fall back to.
ALIASES = {"oos_sharpe": "sharpe", "oos_sortino": "sortino", "oos_calmar": "calmar", "oos_max_drawdown": "max_drawdown", "turnover": "annual_turnover", "avg_hold_days": "hold_period_days", "var_5": "var_95", "cvar_5": "cvar_95", "downside_vol": "semi_deviation", "rank_ic": "rank_information_coefficient", "ic": "information_coefficient", "ic_t_stat": "ic_t", "hit_rate": "direction_accuracy"}


def alias_features(df: DataFrame, values: str) -> DataFrame:
    """``df`` with the features of a map column; a zero falls through to the other name, as a missing value does."""
    at = lambda k: F.try_element_at(F.col(values), F.lit(k))
    return df.select("*", *[F.coalesce(F.nullif(at(k), F.lit(0.0)), at(other)).alias(k) for k, other in ALIASES.items()])


def regime_features(df: DataFrame, values: str) -> DataFrame:
    """``df`` with the sharpes of three regimes of a map column, and the share above zero of those known."""
    at = lambda k: F.try_element_at(F.col(values), F.lit(k))
    known = F.array_compact(F.array(at("crisis"), at("bull"), at("bear")))
    return df.select("*", *[at(k).alias(f"{k}_sharpe") for k in ("crisis", "bull", "bear")], F.when(F.size(known) > 0, positive_share(known)).alias("regime_pass_ratio"))


def all_features(df: DataFrame, backtest: str, metrics: str, regimes: str, folds: str) -> DataFrame:
    """``df`` with every feature of its map columns: those of the backtest, then those that only the metrics have, the regimes', and the folds' shape."""
    name = "_both"
    both = F.map_concat(F.map_filter(F.col(metrics), lambda k, v: ~F.coalesce(F.map_contains_key(F.col(backtest), k), F.lit(False))), F.col(backtest))
    rows = regime_features(alias_features(df.withColumn(name, both), name).drop(name), regimes)
    return rows.select("*", F.size(folds).alias("n_folds"), mean(F.col(folds)).alias("fold_mean"), spread(F.col(folds)).alias("fold_std"))


def gates_of(df: DataFrame, limits: dict) -> DataFrame:
    """``gates`` with the limits of a mapping; what it lacks keeps its default, an unknown limit is an error."""
    return gates(df, Config(**limits))


def decision_summary(decided: DataFrame) -> DataFrame:
    """Of each run: counts by decision, by eligibility, review and suppression, scores of the selected, and the distinct first gate failures of the rejected."""
    have = lambda c, d: F.col(c) if c in decided.columns else F.lit(d)
    n = lambda x: F.count(F.when(x, 1))
    is_ = lambda d: F.col("decision") == d
    eligible, review = have("promotion_eligible", False), have("review_status", None)
    first = F.when(is_("REJECTED"), F.split(F.get("gate_failures", F.lit(0)), "=")[0])
    chosen = lambda c: F.when(is_("SELECTED"), have(c, None))
    return decided.groupBy(*[c for c in ("run_id",) if c in decided.columns]).agg(
        F.count("*").alias("n"),
        *[n(is_(d)).alias(f"n_{d.lower()}") for d in ("SELECTED", "HOLD", "REJECTED", "REVIEW_REQUIRED")],
        n(eligible).alias("n_eligible"),
        n(eligible & (review == "pending")).alias("n_pending"),
        n(review == "approved").alias("n_approved"),
        n(have("near_duplicate_of", None).isNotNull()).alias("n_suppressed"),
        F.avg("score").alias("avg_score"),
        F.median("score").alias("median_score"),
        F.avg(chosen("score")).alias("avg_selected_score"),
        F.max(chosen("score")).alias("max_selected_score"),
        F.avg(chosen("oos_sharpe")).alias("avg_selected_sharpe"),
        F.avg(chosen("pbo")).alias("avg_selected_pbo"),
        n(~F.col("gate_passed")).alias("n_gate_failed"),
        F.array_join(F.array_sort(F.collect_set(first)), ",").alias("first_failures"),
    )


def gate_histogram(decided: DataFrame) -> DataFrame:
    """gate, n: how often each gate failed."""
    return decided.select(F.explode(F.transform("gate_failures", lambda x: F.split(x, "=")[0])).alias("gate")).groupBy("gate").agg(F.count("*").alias("n"))


def gates(df: DataFrame, config: Config = Config()) -> DataFrame:
    """``df`` with gate_failures (messages, in the order of the gates) and gate_passed."""
    c = config
    rules = [
        (F.col("pbo") > c.pbo_threshold, "pbo", F.col("pbo"), ">", "threshold", c.pbo_threshold, 4),
        (F.abs("rank_ic") < c.min_rank_ic, "rank_ic", F.col("rank_ic"), "<", "min", c.min_rank_ic, 4),
        (F.col("oos_sharpe") < c.min_oos_sharpe, "oos_sharpe", F.col("oos_sharpe"), "<", "min", c.min_oos_sharpe, 4),
        (F.col("turnover") > c.max_turnover, "turnover", F.col("turnover"), ">", "max", c.max_turnover, 2),
        (F.abs("max_drawdown") > c.max_drawdown, "max_drawdown", F.abs("max_drawdown"), ">", "max", c.max_drawdown, 4),
        (F.col("regime_pass_ratio") < c.min_regime_pass_ratio, "regime_pass_ratio", F.col("regime_pass_ratio"), "<", "min", c.min_regime_pass_ratio, 4),
        (F.col("complexity") > c.max_complexity_score, "complexity", F.col("complexity"), ">", "max", c.max_complexity_score, 4),
        (F.col("selection_consistency_score") < c.min_selection_stability, "selection_stability", F.col("selection_consistency_score"), "<", "min", c.min_selection_stability, 4),
    ]
    said = [F.when(bad, F.concat(F.lit(f"{name}="), fixed(value, d), F.lit(f" {sign} {word}={limit:.{d}f}"))) for bad, name, value, sign, word, limit, d in rules]
    return df.withColumn("gate_failures", F.array_compact(F.array(*said))).withColumn("gate_passed", F.size("gate_failures") == 0)


# --- ranking and decisions ---


def _run(df: DataFrame):
    """The window of a row's run."""
    return Window.partitionBy("run_id" if "run_id" in df.columns else F.lit(0))


def _known(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def rank(df: DataFrame) -> DataFrame:
    """``df`` with decision_rank, by run: passed first, then by score, then in the order of ``ord``."""
    return df.withColumn("decision_rank", F.row_number().over(_run(df).orderBy(F.desc("gate_passed"), F.desc("score"), "ord")))


def diverse_top_k(ranked: DataFrame, config: Config = Config()) -> DataFrame:
    """Of each run the best k that passed and are no near duplicate, at most ``max_same_family`` of a family (the first 8 letters of the source id), with new_rank."""
    ranked = _known(ranked, "near_duplicate_of", "string")
    ok = ranked.where(F.col("gate_passed") & F.col("near_duplicate_of").isNull()).withColumn("family", F.nullif(F.substring("source_id", 1, 8), F.lit("")))
    keys = [c for c in ("run_id", "family") if c in ok.columns]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("decision_rank"))
    ok = ok.withColumn("family_place", F.when(F.col("family").isNotNull(), place).otherwise(1)).where(F.col("family_place") <= config.max_same_family)
    return ok.withColumn("new_rank", F.row_number().over(_run(ok).orderBy("decision_rank"))).where(F.col("new_rank") <= config.top_k)


def assign(ranked: DataFrame, config: Config = Config()) -> DataFrame:
    """``ranked`` with the ranks of the diverse top k, its decision, promotion_eligible and review_status, by run.

    A diverse candidate takes its place among the diverse ones; others keep their rank. Gates, then score, then rank decide;
    a near duplicate is rejected. Then the limits hold in turn: the worst of too many SELECTED wait, a waiting one whose score is close to the
    least selected is for review, and the best ``promotion_top_k`` of the selected are eligible, but for those under review.
    """
    ranked = _known(_known(ranked, "near_duplicate_of", "string"), "review_status", "string")
    keys = [c for c in ("run_id", "candidate_id") if c in ranked.columns]
    best = diverse_top_k(ranked, config).select(*keys, "new_rank")
    rows = ranked.join(best, keys, "left").withColumn("decision_rank", F.coalesce("new_rank", "decision_rank")).drop("new_rank")
    fails = ~F.col("gate_passed") | (F.col("score") < 0) | F.col("near_duplicate_of").isNotNull()
    rows = rows.withColumn("_d", F.when(fails, "REJECTED").when(F.col("decision_rank") <= config.top_k, "SELECTED").otherwise("HOLD"))
    place = F.when(F.col("_d") == "SELECTED", F.row_number().over(Window.partitionBy(*[k for k in keys if k == "run_id"], "_d").orderBy("decision_rank", "ord")))
    rows = rows.withColumn("_p", place).withColumn("_d", F.when(F.col("_p") > config.top_k, "HOLD").otherwise(F.col("_d")))
    least = F.min(F.when(F.col("_d") == "SELECTED", F.col("score"))).over(_run(rows))
    close = (F.col("_d") == "HOLD") & (F.col("score") >= least - config.review_margin)
    rows = rows.withColumn("decision", F.when(F.coalesce(close, F.lit(False)), "REVIEW_REQUIRED").otherwise(F.col("_d")))
    open_ = F.coalesce(F.col("review_status") != "approved", F.lit(False))
    rows = rows.withColumn("_e", (F.col("decision") == "SELECTED") & ~open_)
    turn = F.row_number().over(Window.partitionBy(*[k for k in keys if k == "run_id"], "_e").orderBy("decision_rank", "ord"))
    return rows.withColumn("promotion_eligible", F.col("_e") & (turn <= config.promotion_top_k)).drop("_d", "_p", "_e")


def decide(ranked: DataFrame, config: Config = Config()) -> DataFrame:
    """``ranked`` with its decision by its own rank: gates, then score, then rank; a close HOLD is for review."""
    first = F.when(~F.col("gate_passed") | (F.col("score") < 0), "REJECTED").when(F.col("decision_rank") <= config.top_k, "SELECTED").otherwise("HOLD")
    rows = ranked.withColumn("_d", first)
    least = F.min(F.when(F.col("_d") == "SELECTED", F.col("score"))).over(_run(rows))
    close = (F.col("_d") == "HOLD") & (F.col("score") >= least - config.review_margin)
    return rows.withColumn("decision", F.when(close, "REVIEW_REQUIRED").otherwise(F.col("_d"))).drop("_d")


def promotable(decided: DataFrame, config: Config = Config()) -> DataFrame:
    """Of each run the approved among the best selected ones."""
    place = F.row_number().over(_run(decided).orderBy("decision_rank", "ord"))
    return decided.where("decision = 'SELECTED'").withColumn("_p", place).where(F.col("_p") <= config.promotion_top_k).drop("_p").where("approved")


def violations(decided: DataFrame, config: Config = Config()) -> DataFrame:
    """Rule, severity and candidate_id of what contradicts the decisions' invariants, by run.

    R01 selected without passing the gates, R02 a better score at a worse rank, R03 a suppressed duplicate selected, R04 (a warning)
    selected though overfit, R05 a score below zero.
    """
    decided = _known(decided, "near_duplicate_of", "string")
    before = F.lag("score").over(_run(decided).orderBy("decision_rank", "ord"))
    selected = F.col("decision") == "SELECTED"
    rules = {
        "R01": selected & ~F.col("gate_passed"),
        "R02": F.col("score") > F.col("_before") + 1e-9,
        "R03": selected & F.col("near_duplicate_of").isNotNull(),
        "R04": selected & (F.col("pbo") > config.pbo_threshold),
        "R05": F.col("score") < 0,
    }
    named = F.array_compact(F.array(*[F.when(bad, rule) for rule, bad in rules.items()]))
    out = decided.withColumn("_before", before).select(*[c for c in ("run_id",) if c in decided.columns], "candidate_id", F.explode(named).alias("rule"))
    return out.withColumn("severity", F.when(F.col("rule") == "R04", "WARNING").otherwise("ERROR"))


def top_k_overlap(rankings: DataFrame, k: int = 5) -> DataFrame:
    """run_id, overlap: the mean Jaccard similarity of the folds' top k sets, over all pairs of a run's folds; 1 with one fold.

    rankings(run_id, fold, place from 1, candidate_id). A pair's intersection is counted by candidate, so sets are never held.
    """
    top = rankings.where(F.col("place") <= k).select("run_id", "fold", "candidate_id").distinct()
    sizes = top.groupBy("run_id", "fold").agg(F.count("*").alias("n"))
    a, b = top.toDF("run_id", "fa", "candidate_id"), top.toDF("run_id", "fb", "candidate_id")
    both = a.join(b, ["run_id", "candidate_id"]).where("fa < fb").groupBy("run_id", "fa", "fb").agg(F.count("*").alias("both"))
    full = both.join(sizes.toDF("run_id", "fa", "na"), ["run_id", "fa"]).join(sizes.toDF("run_id", "fb", "nb"), ["run_id", "fb"])
    sums = full.groupBy("run_id").agg(F.sum(F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("s"))
    folds = rankings.groupBy("run_id").agg(F.count_distinct("fold").alias("f"))
    pairs = F.col("f") * (F.col("f") - 1) / 2
    return folds.join(sums, "run_id", "left").select("run_id", F.when(F.col("f") > 1, F.coalesce("s", F.lit(0.0)) / pairs).otherwise(1.0).alias("overlap"))
