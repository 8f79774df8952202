"""Discovery of formulas: full fitness, evaluation, and the way from search to promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions.stats import clip, compounded, over_series, running, sharpe
from meridian.operators.features import rank_normalize
from meridian.operators.metrics import portfolio, predictive, risk, trading
from meridian.plans import search

#: The weights of the full fitness.
WEIGHTS = {"rank_ic": 0.30, "cost_sharpe": 0.30, "regime_cons": 0.20, "turnover_pen": 0.10, "complexity_pen": 0.05, "drawdown_pen": 0.05}
NODES = 15  # at which a tree is as complex as can be


def complexity_penalty(n_nodes: int) -> float:
    return min(n_nodes / NODES, 1.0)


def full_fitness(series: DataFrame, n_nodes: int = 1, cost_bps: float = 2.0) -> DataFrame:
    """series_id, rank_ic, cost_sharpe, regime_cons, turnover, drawdown, fitness of the rank of each series' signal as its position.

    With more than 5 crisis rows (``crisis``) regime_cons is the lesser of the rank ICs in and out of crises, else the rank IC.
    """
    w = over_series("series_id")
    rows = rank_normalize(series.where("signal is not null"), "signal", "series_id").withColumn("position", clip(F.col("normalized"), -1.0, 1.0))
    rows = rows.withColumn("_d", F.abs(F.col("position") - F.lag("position").over(w)))
    turnover = rows.groupBy("series_id").agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("turnover"))
    rows = rows.join(turnover, "series_id").where("target is not null").withColumn("net", F.col("position") * F.col("target") - F.col("turnover") * (cost_bps * 1e-4))
    rows = rows.withColumn("_e", compounded(F.col("net"), w))
    rows = rows.withColumn("_dd", F.try_divide(F.col("_e"), F.max("_e").over(running(w))) - 1)
    sums = rows.groupBy("series_id", "turnover").agg(sharpe(F.col("net")).alias("cost_sharpe"), F.abs(F.min("_dd")).alias("drawdown"), F.count_if("crisis").alias("n_crisis"))
    own = rows.withColumn("signal", F.col("position"))
    ic = predictive(own).select("series_id", "rank_ic")
    parts = predictive(own, ["series_id", "crisis"]).groupBy("series_id").agg(F.min("rank_ic").alias("least"), F.count("*").alias("parts"))
    out = sums.join(ic, "series_id").join(parts, "series_id")
    cons = F.when((F.col("n_crisis") > 5) & (F.col("parts") == 2), F.col("least")).otherwise(F.when(F.col("n_crisis") > 5, F.least("least", F.lit(0.0))).otherwise(F.col("rank_ic")))
    out = out.withColumn("regime_cons", cons)
    x = WEIGHTS
    plus = x["rank_ic"] * F.col("rank_ic") + x["cost_sharpe"] * clip(F.col("cost_sharpe") / 3, -1.0, 1.0) + x["regime_cons"] * clip(F.col("regime_cons"), -1.0, 1.0)
    less = x["turnover_pen"] * F.least(F.col("turnover") / 2, F.lit(1.0)) + x["complexity_pen"] * complexity_penalty(n_nodes) + x["drawdown_pen"] * F.col("drawdown")
    return out.select("series_id", "rank_ic", "cost_sharpe", "regime_cons", "turnover", "drawdown", (plus - less).alias("fitness"))


def full_evaluation(series: DataFrame) -> DataFrame:
    """All groups of metrics of each series with a position, in one row."""
    out = predictive(series)
    for part in (portfolio(series), risk(series), trading(series)):
        new = [c for c in part.columns if c not in out.columns]
        out = out.join(part.select("series_id", *new), "series_id", "left")
    return out


def assert_no_leak(proofs: list[dict]) -> None:
    """Raises ValueError with the trees that look ahead or are not safe."""
    bad = [p["tree"] for p in proofs if not p["passed"]]
    if bad:
        raise ValueError("formulas with leaks: " + ", ".join(bad))


def discover(spark: SparkSession, series: DataFrame, terminals: list[str], lags: dict[str, int], k: int = 10, least: float = 0.0) -> DataFrame:
    """tree, expression, fitness, passed, promoted: search, the best tree of each expression, safety proofs, and which may be promoted.

    The best tree is the first of the highest fitness. Promoted are those that pass their proof with a fitness above ``least``.
    """
    found = search.search(series, terminals, k * 10)
    best: dict[str, tuple] = {}
    for tree, expression, fitness in found:
        if expression not in best or fitness > best[expression][2]:
            best[expression] = (tree, expression, fitness)
    proofs = {str(n): search.safety_proof(n, terminals, lags) for n in search.trees(terminals)}
    rows = [(t, e, f, bool(proofs[t]["passed"]), bool(proofs[t]["passed"]) and f > least) for t, e, f in sorted(best.values(), key=lambda x: (-x[2], x[0]))[:k]]
    return spark.createDataFrame(rows, "tree string, expression string, fitness double, passed boolean, promoted boolean")
