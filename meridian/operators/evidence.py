"""Evidence on candidates: entropy over regimes, causal direction and invariance, similarity, crowding, surfaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.stats import clip, correlation, cosine, over_series, ratio, rolling, sharpe, total


# --- regime entropy ---


def regime_entropy(values: Column) -> Column:
    """Shannon entropy of the positive values' shares; 0 with fewer than two."""
    up = F.filter(values, lambda x: x > 0)
    all_ = total(up)
    h = F.aggregate(F.transform(up, lambda x: -(x / all_) * F.coalesce(F.log(x / all_), F.lit(float("-inf")))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(up) >= 2, h).otherwise(0.0)


def normalized_entropy(values: Column) -> Column:
    n = F.size(F.filter(values, lambda x: x > 0))
    return F.when(n >= 2, F.least(F.lit(1.0), regime_entropy(values) / F.log(n.cast("double")))).otherwise(0.0)


def entropy_features(df: DataFrame, values: str, threshold: float = 0.60, bonus: float = 0.2, loss: float = 0.3) -> DataFrame:
    v, h = F.col(values), normalized_entropy(F.col(values))
    n = F.size(F.filter(v, lambda x: x > 0))
    return df.select(
        "*",
        regime_entropy(v).alias("entropy"),
        h.alias("normalized_entropy"),
        F.least(F.lit(1.0), h * F.when(n >= 3, 1.0).otherwise(0.85)).alias("balance"),
        F.greatest(F.lit(0.0), F.least(F.lit(bonus), (h - threshold) / (1 - threshold) * bonus)).alias("entropy_bonus"),
        F.greatest(F.lit(0.0), F.least(F.lit(loss), (threshold - h) / threshold * loss)).alias("imbalance_penalty"),
    )


# --- causality ---


def causal_direction(series: DataFrame, lag: int = 1) -> DataFrame:
    """Correlation of the signal with later returns and of returns with later signals, and the score they give."""
    w = over_series("series_id")
    rows = series.select("series_id", "signal", "ret", F.lead("ret", lag).over(w).alias("r1"), F.lead("signal", lag).over(w).alias("s1"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = rows.groupBy("series_id").agg(F.count("*").alias("n_obs"), zero(correlation(F.col("signal"), F.col("r1"))).alias("forward"), zero(correlation(F.col("ret"), F.col("s1"))).alias("backward"))
    asym = F.abs("forward") - F.abs("backward")
    proxy = clip((F.abs("forward") + asym / 2) / F.greatest(F.lit(0.01), F.abs("forward") + F.abs("backward") + 0.01), 0.0, 1.0)
    value = F.least(F.lit(1.0), F.least(F.lit(1.0), F.abs("forward") / 0.2) + F.greatest(F.lit(0.0), asym) * 0.5)
    few = F.col("n_obs") < 10
    return out.select("series_id", "n_obs", "forward", "backward", asym.alias("asymmetry"), F.when(few, 0.5).otherwise(proxy).alias("granger_proxy"), F.when(few, 0.5).otherwise(value).alias("causal_direction_score"))


def invariance(series: DataFrame, regimes: int = 4, least: float = 0.05) -> DataFrame:
    """The share of consecutive chunks of a series where the signal's slope is positive and correlated, and the slopes' steadiness."""
    w = over_series("series_id")
    rows = series.where("signal is not null and target is not null").withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("series_id")))
    k = F.when(F.floor(F.col("_n") / 5) >= regimes, F.lit(regimes)).otherwise(F.greatest(F.lit(2), F.floor(F.col("_n") / 5)))
    rows = rows.withColumn("_k", k).withColumn("regime", F.least(F.floor(F.col("_i") / F.floor(F.col("_n") / F.col("_k"))), F.col("_k") - 1))
    x, y = F.col("signal"), F.col("target")
    per = rows.groupBy("series_id", "regime").agg(F.coalesce(ratio(F.covar_pop(x, y), F.var_pop(x)), F.lit(0.0)).alias("beta"), F.coalesce(correlation(x, y), F.lit(0.0)).alias("corr"), F.count("*").alias("n")).where("n >= 3")
    good = (F.col("beta") > 0) & (F.abs("corr") >= least)
    m, s = F.avg("beta"), F.stddev_pop("beta")
    cv = F.when(F.abs(m) > 1e-10, s / F.abs(m)).otherwise(s)
    return per.groupBy("series_id").agg(
        F.count("*").alias("n_regimes"),
        F.avg(good.cast("double")).alias("invariance_pass_ratio"),
        clip(1 - cv, 0.0, 1.0).alias("coefficient_stability"),
        F.avg((F.col("beta") > 0).cast("double")).alias("regime_consistency"),
    )


# --- similarity ---


def pairwise_correlation(series: DataFrame, value: str, chunk: int = 4096, block: int = 512) -> DataFrame:
    """a < b, n, corr of all pairs of series that share times; 0 with fewer than 3 of them or where one does not vary.

    Series are dealt out in blocks and times in chunks; a task multiplies two blocks over a chunk, so a pair is emitted once
    for each chunk, with its sums, and no time step is ever expanded to pairs.
    """
    import numpy as np
    import pandas as pd

    mean = F.avg(value).over(Window.partitionBy("series_id"))  # sums of centred values keep their digits
    rows = series.where(F.col(value).isNotNull()).select("series_id", "t", (F.col(value) - mean).alias("x"))
    n_blocks = max(1, -(-rows.agg(F.approx_count_distinct("series_id")).first()[0] // block))
    dealt = rows.withColumn("c", F.floor(F.col("t") / chunk).cast("long")).withColumn("blk", F.pmod(F.xxhash64("series_id"), F.lit(n_blocks)).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("bi", F.least("blk", "o")).withColumn("bj", F.greatest("blk", "o")).drop("o")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        ts, at = np.unique(pdf["t"].to_numpy(), return_inverse=True)
        sides = []
        for k in (pdf["bi"].iloc[0], pdf["bj"].iloc[0]):
            own = (pdf["blk"] == k).to_numpy()
            ids, who = np.unique(pdf["series_id"].to_numpy()[own], return_inverse=True)
            x, m = np.zeros((len(ids), len(ts))), np.zeros((len(ids), len(ts)))
            x[who, at[own]], m[who, at[own]] = pdf["x"].to_numpy()[own], 1
            sides.append((ids, x, m))
        (ia, x, m), (ib, y, w) = sides
        n = m @ w.T
        i, j = np.nonzero(n)
        keep = ia[i] < ib[j] if pdf["bi"].iloc[0] == pdf["bj"].iloc[0] else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        flip = ia[i] > ib[j]
        sums = [n, x @ w.T, m @ y.T, (x * x) @ w.T, m @ (y * y).T, x @ y.T]
        sums = [z[i, j] for z in sums]
        sums[1], sums[2] = np.where(flip, sums[2], sums[1]), np.where(flip, sums[1], sums[2])
        sums[3], sums[4] = np.where(flip, sums[4], sums[3]), np.where(flip, sums[3], sums[4])
        return pd.DataFrame({"a": np.where(flip, ib[j], ia[i]), "b": np.where(flip, ia[i], ib[j]), **dict(zip(("n", "x", "y", "xx", "yy", "xy"), sums, strict=True))})

    kind = rows.schema["series_id"].dataType.simpleString()
    parts = dealt.groupBy("c", "bi", "bj").applyInPandas(multiply, f"a {kind}, b {kind}, n double, x double, y double, xx double, yy double, xy double")
    s = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.col("n")
    var = lambda p, q: F.greatest(F.lit(0.0), F.col(q) / n - (F.col(p) / n) * (F.col(p) / n))
    wide = F.sqrt(var("x", "xx")) * F.sqrt(var("y", "yy"))
    corr = clip((F.col("xy") / n - F.col("x") / n * F.col("y") / n) / wide, -1.0, 1.0)
    return s.select("a", "b", n.cast("long").alias("n"), F.when((n >= 3) & (wide > 1e-15), corr).otherwise(0.0).alias("corr"))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z_][a-z0-9_]*"), F.lit(0)))


def token_jaccard(df: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """a < b, similarity of the rows whose token sets reach ``least``.

    Rows meet on the rarest tokens of their set alone: a pair at the bound shares one of
    the first size - ceil(least * size) + 1 in the order of how many rows hold them.
    """
    rows = df.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("set"))
    held = rows.select("id", F.size("set").alias("n"), F.explode("set").alias("token"))
    counts = held.groupBy("token").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    rare = held.join(counts, "token").withColumn("p", place).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("id", "token", "n")
    a, b = rare.toDF("a", "token", "na"), rare.toDF("b", "token", "nb")
    pairs = a.join(b, "token").where((F.col("a") < F.col("b")) & (F.col("na") * least <= F.col("nb")) & (F.col("nb") * least <= F.col("na"))).select("a", "b").distinct()
    full = pairs.join(rows.toDF("a", "sa"), "a").join(rows.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    value = both / (F.size("sa") + F.size("sb") - both)
    return full.select("a", "b", value.alias("similarity")).where(F.col("similarity") >= least)


def novelty(targets: DataFrame, references: DataFrame, id_col: str, vector_col: str, block: int = 4096) -> DataFrame:
    """id, nearest reference (the lesser id on a tie), similarity (6 places) and novelty = 1 - similarity.

    Every target is compared with every reference but its own id. Both are dealt out in blocks, a task multiplies a block of each, and only
    the best reference of each target leaves it. Vectors of different lengths, or without length, have similarity 0.
    """
    import numpy as np
    import pandas as pd

    nt, nr = (max(1, -(-x.count() // block)) for x in (targets, references))
    kind = targets.schema[id_col].dataType.simpleString()
    vec = F.col(vector_col).cast("array<double>").alias("v")
    blk = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = targets.select(F.col(id_col).alias("id"), vec, blk(nt).alias("bt"), every(nr).alias("br"))
    r = references.select(F.col(id_col).alias("id"), vec, blk(nr).alias("br"), every(nt).alias("bt"))

    def unit(vs: list) -> np.ndarray:
        wide = max((len(v) for v in vs if v is not None), default=0)
        out = np.zeros((len(vs), wide))
        for i, v in enumerate(vs):
            if v is not None and len(v):
                out[i, : len(v)] = v
        out[~np.isfinite(out).all(axis=1)] = 0
        length = np.sqrt((out * out).sum(axis=1))
        return out / np.where(length > 1e-15, length, 1)[:, None]

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": a["id"][:0], "ref": a["id"][:0], "s": np.zeros(0)})
        b = b.sort_values("id")
        x, y = unit(a["v"].tolist()), unit(b["v"].tolist())
        wide = max(x.shape[1], y.shape[1])
        x, y = (np.pad(z, ((0, 0), (0, wide - z.shape[1]))) for z in (x, y))
        size = lambda p: np.array([-1 if v is None else len(v) for v in p["v"].tolist()])
        s = np.where(size(a)[:, None] == size(b)[None, :], np.round(np.clip(x @ y.T, -1, 1), 6) + 0.0, 0.0)
        s[a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = -2
        k = s.argmax(axis=1)
        out = pd.DataFrame({"id": a["id"].to_numpy(), "ref": b["id"].to_numpy()[k], "s": s[np.arange(len(a)), k]})
        return out[out["s"] > -2]

    cells = t.groupBy("bt", "br").cogroup(r.groupBy("bt", "br")).applyInPandas(best, f"id {kind}, ref {kind}, s double")
    out = cells.groupBy("id").agg(F.max(F.struct("s", (-F.col("ref")).alias("k"))).alias("top"))
    return out.select("id", (-F.col("top.k")).alias("nearest"), F.col("top.s").alias("similarity"), (1 - F.col("top.s")).alias("novelty"))


# --- crowding ---


def factor_regressions(series: DataFrame, factors: DataFrame, value: str = "ret") -> DataFrame:
    """series_id, factor, alpha, beta, r2, resid_std of simple regressions on factors (factor, t, x)."""
    rows = series.select("series_id", "t", F.col(value).alias("y")).join(factors, "t").where("x is not null and y is not null")
    x, y = F.col("x"), F.col("y")
    out = rows.groupBy("series_id", "factor").agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"))
    beta = F.coalesce(ratio(F.col("c"), F.col("vx")), F.lit(0.0))
    r2 = clip(F.coalesce(ratio(F.col("c") * F.col("c"), F.col("vx") * F.col("vy")), F.lit(0.0)), 0.0, 1.0)
    return out.select("series_id", "factor", (F.col("my") - beta * F.col("mx")).alias("alpha"), beta.alias("beta"), r2.alias("r2"), F.sqrt(F.col("vy") * F.col("n") * (1 - r2) / F.greatest(F.lit(1), F.col("n") - 2)).alias("resid_std"))


#: The bounds and scales of the penalty ramps.
R2_MOST, CROWDING_SCALE, FSI_MOST, FSI_SCALE = 0.80, 0.30, 0.40, 0.25


def ramp(x: Column, most: float, scale: float) -> Column:
    """0 up to ``most``, then in proportion to what is over it, ``scale`` at 1."""
    over = F.lit(scale) if 1 - most < 1e-10 else F.least(F.lit(scale), (x - most) / (1 - most) * scale)
    return F.when(x <= most, 0.0).otherwise(over)


def crowding(regressions: DataFrame, most: float = R2_MOST, matches: DataFrame | None = None, n_factors: int = 16) -> DataFrame:
    """The factor that explains a series best, the three largest |beta|'s share, the penalty and whether r2 passes.

    ``matches`` (series_id, score: keywords of a factor in the formula) adds factor_overlap, their sum as a part of ``n_factors``, at most 1.
    """
    best = F.max(F.struct("r2", "factor"))
    size = F.sort_array(F.collect_list(F.abs("beta")), asc=False)  # a value for each of the known factors
    out = regressions.groupBy("series_id").agg(best.alias("b"), size.alias("betas"))
    all_ = total(F.col("betas"))
    share = F.when((all_ > 1e-10) & (F.size("betas") >= 2), total(F.slice("betas", 1, 3)) / all_).otherwise(1.0)
    r2 = F.col("b.r2")
    out = out.select("series_id", F.col("b.factor").alias("top_factor"), r2.alias("max_r2"), share.alias("top3_share"), ramp(r2, most, CROWDING_SCALE).alias("crowding_penalty"), (r2 <= most).alias("crowding_passed"))
    if matches is None:
        return out
    overlap = matches.groupBy("series_id").agg(F.least(F.lit(1.0), F.sum("score") / n_factors).alias("factor_overlap"))
    return out.join(overlap, "series_id", "left").fillna(0.0, ["factor_overlap"])


def crowding_summary(scores: DataFrame, n: int = 5) -> DataFrame:
    """Counts, mean and largest r2, the passing share, and the ``n`` most crowded ones as text."""
    top = scores.orderBy(F.desc("max_r2"), "series_id").limit(n).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("max_r2")).alias("o"), "series_id", "top_factor"))), lambda x: F.concat_ws(":", x["series_id"].cast("string"), x["top_factor"])), ",").alias("top_crowded"))
    good = F.col("crowding_passed").cast("int")
    sums = scores.agg(F.count("*").alias("n"), F.avg("max_r2").alias("mean_r2"), F.max("max_r2").alias("max_r2"), F.sum(good).alias("n_passed"), F.sum(1 - good).alias("n_failed"), F.avg(good).alias("pass_ratio"))
    return sums.crossJoin(top)  # a row and a row


# --- robust scale, fragility surface ---


def robust_scale(df: DataFrame, value: str, key: str, lo: float = -3.0, hi: float = 3.0) -> DataFrame:
    """``df`` with z: (value - median) / (IQR / 1.35), quartiles by lower index; the standard deviation where the IQR is 0."""
    known = df.where(F.col(value).isNotNull()).select(key, value)
    place = known.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(value)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    at = lambda q: F.max(F.when(F.col("i") == F.floor(F.lit(q) * (F.col("n") - 1)), F.col(value)))
    low, high = (F.max(F.when(F.col("i") == F.floor((F.col("n") - k) / 2), F.col(value))) for k in (1, 0))
    stats = place.groupBy(key).agg(((low + high) / 2).alias("md"), (at(0.75) - at(0.25)).alias("iqr"), F.stddev_samp(value).alias("sd"))
    scale = F.when(F.col("iqr") > 1e-12, F.col("iqr") / 1.35).otherwise(F.col("sd"))
    return df.join(stats, key).withColumn("z", F.coalesce(clip(ratio(F.col(value) - F.col("md"), scale), lo, hi), F.lit(0.0))).drop("md", "iqr", "sd")


def parameter_grid(spark, values: dict[str, list[float]], most: int) -> DataFrame:
    """sample (0: the first) and a column for each parameter: the product of the values, thinned by an even stride."""
    names = list(values)
    size = reduce(lambda a, b: a * b, [len(v) for v in values.values()], 1)
    n = min(size, most)
    place = F.floor(F.col("id") * (size / n)) if size > n else F.col("id")
    out, div = spark.range(n).withColumn("_p", place.cast("long")), 1
    for name in names:
        v = values[name]
        out = out.withColumn(name, F.element_at(F.array(*[F.lit(float(x)) for x in v]), (F.floor(F.col("_p") / div) % len(v) + 1).cast("int")))
        div *= len(v)
    return out.withColumnRenamed("id", "sample").drop("_p")


def fragility_surface(evaluated: DataFrame, baseline: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """Of each group: cv and worst-case degradation of the sharpes on a grid, the index that halves both, its penalty and gate.

    The baseline is the mean sharpe of the rows with ``is_baseline``, which do not count otherwise, or a number.
    """
    keys = keys or []
    other = ~F.col("is_baseline") if "is_baseline" in evaluated.columns else F.lit(True)
    x = F.when(other, F.col("sharpe"))
    base = F.lit(baseline) if baseline is not None else F.avg(F.when(~other, F.col("sharpe")))
    out = evaluated.groupBy(*keys).agg(F.count("*").alias("n"), base.alias("baseline"), F.avg(x).alias("mean_sharpe"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("std_sharpe"), F.min(x).alias("min_sharpe"))
    cv = F.when(F.abs("mean_sharpe") > 1e-10, F.col("std_sharpe") / F.abs("mean_sharpe")).otherwise(F.col("std_sharpe"))
    loss = F.greatest(F.lit(0.0), F.col("baseline") - F.col("min_sharpe")) / F.col("baseline")
    worse = F.least(F.lit(1.0), F.when(F.col("baseline") > 1e-10, loss).otherwise(F.when(F.col("min_sharpe") > 0, 0.0).otherwise(1.0)))
    # only the baseline: nothing was perturbed
    none = F.col("mean_sharpe").isNull()
    fsi = F.when(none, 0.0).otherwise(0.5 * F.least(F.lit(1.0), cv) + 0.5 * worse)
    out = out.select("*", F.when(none, 0.0).otherwise(cv).alias("cv"), F.when(none, 0.0).otherwise(worse).alias("degradation"), fsi.alias("fsi"))
    return out.select("*", (1 - F.col("fsi")).alias("local_stability"), ramp(F.col("fsi"), FSI_MOST, FSI_SCALE).alias("fsi_penalty"), (F.col("fsi") <= FSI_MOST).alias("fsi_passed"))


def surface_summary(surfaces: DataFrame) -> DataFrame:
    good = F.col("fsi_passed").cast("int")
    f = F.col("fsi")
    return surfaces.agg(F.count("*").alias("n"), F.avg(f).alias("mean_fsi"), F.median(f).alias("median_fsi"), F.max(f).alias("max_fsi"), F.min(f).alias("min_fsi"), F.avg("local_stability").alias("mean_stability"), F.sum(good).alias("n_passed"), F.sum(1 - good).alias("n_failed"), F.avg(good).alias("pass_ratio"))


def parameter_sensitivity(evaluated: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, parameter, sensitivity: the spread of mean sharpes over its values."""
    keys = keys or []
    rows = evaluated.select(*keys, "sharpe", F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).cast("double").alias("value")) for n in names])).alias("p")).select(*keys, "sharpe", "p.*")
    means = rows.groupBy(*keys, "parameter", "value").agg(F.avg("sharpe").alias("m"))
    return means.groupBy(*keys, "parameter").agg((F.max("m") - F.min("m")).alias("sensitivity"))


def backtest_grid(series: DataFrame, lookbacks: list[int], scales: list[float], costs: list[float], base: tuple[int, float, float]) -> DataFrame:
    """series_id, lookback, scale, cost, sharpe, rows with is_baseline: a backtest of each series at each point of a grid.

    The position is the mean of the last ``lookback`` returns times ``scale``, within -1 and 1; a change costs ``cost`` basis points.
    """
    w = over_series("series_id")
    rows = series.select("series_id", "t", "target", *[rolling(F.avg, F.col("ret"), w, n).alias(f"_{n}") for n in lookbacks])
    means = F.array(*[F.struct(F.lit(n).alias("lookback"), F.col(f"_{n}").alias("mean")) for n in lookbacks])
    rows = rows.select("series_id", "t", "target", F.explode(means).alias("m")).select("series_id", "t", "target", "m.*").where("mean is not null and target is not null")
    rows = rows.withColumn("scale", F.explode(F.array(*[F.lit(float(x)) for x in scales]))).withColumn("position", clip(F.col("mean") * F.col("scale"), -1.0, 1.0))
    move = F.coalesce(F.abs(F.col("position") - F.lag("position").over(over_series(["series_id", "lookback", "scale"]))), F.lit(0.0))
    rows = rows.withColumn("move", move).withColumn("cost", F.explode(F.array(*[F.lit(float(x)) for x in costs])))
    out = rows.groupBy("series_id", "lookback", "scale", "cost").agg(sharpe(F.col("position") * F.col("target") - F.col("move") * F.col("cost") * 1e-4).alias("sharpe"))
    return out.withColumn("is_baseline", (F.col("lookback") == base[0]) & (F.col("scale") == base[1]) & (F.col("cost") == base[2]))


# --- regime records ---

#: Features and the regimes whose sharpe they are.
REGIME_KEYS = {"crisis_period_sharpe": "crisis", "low_liquidity_sharpe": "low_liquidity", "high_vol_sharpe": "high_vol", "event_window_only_sharpe": "event_window", "bull_sharpe": "bull", "bear_sharpe": "bear", "sideways_sharpe": "sideways", "rate_hike_sharpe": "rate_hike", "rate_cut_sharpe": "rate_cut", "risk_on_sharpe": "risk_on", "risk_off_sharpe": "risk_off"}


def regime_sharpes(features: Column, finite: bool = True) -> Column:
    """A map of regimes and sharpes, finite or only known, from a map of features, in the order of ``REGIME_KEYS``."""
    at = lambda k: F.try_element_at(features, F.lit(k))
    pairs = F.array(*[F.struct(F.lit(r).alias("key"), at(k).alias("value")) for k, r in REGIME_KEYS.items()])
    sound = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) if finite else v.isNotNull()
    return F.map_from_entries(F.filter(pairs, lambda x: sound(x["value"])))


def entropy_record(df: DataFrame, sharpes: str, threshold: float = 0.60) -> DataFrame:
    """``df``, with a map column of regimes' sharpes, and its entropy features, weights (of those above zero), the dominant regime and its weight, max_entropy, n_regimes and is_balanced."""
    up = F.map_filter(F.col(sharpes), lambda k, v: v > 0)
    rows = df.withColumn("_v", F.map_values(up)).withColumn("_k", F.map_keys(up)).withColumn("_t", total(F.col("_v")))
    rows = entropy_features(rows, "_v", threshold).withColumn("weights", F.map_from_arrays("_k", F.transform("_v", lambda x: x / F.col("_t"))))
    n = F.size("_v")
    place = F.array_position("_v", F.array_max("_v")).cast("int")
    some = n > 0
    return rows.select(
        *df.columns,
        "entropy",
        "normalized_entropy",
        F.when(n >= 2, F.col("balance")).otherwise(0.0).alias("balance"),
        "entropy_bonus",
        "imbalance_penalty",
        "weights",
        n.alias("n_regimes"),
        F.when(n >= 2, F.log(n.cast("double"))).otherwise(0.0).alias("max_entropy"),
        F.when(some, F.element_at("_k", F.greatest(place, F.lit(1)))).alias("dominant_regime"),
        F.when(some, F.array_max("_v") / F.col("_t")).otherwise(0.0).alias("dominant_weight"),
        (F.col("normalized_entropy") >= threshold).alias("is_balanced"),
    )


def entropy_summary(records: DataFrame) -> DataFrame:
    good, h = F.col("is_balanced").cast("int"), F.col("normalized_entropy")
    return records.agg(F.count("*").alias("n"), F.avg(h).alias("mean_entropy"), F.median(h).alias("median_entropy"), F.count_if(good == 1).alias("n_balanced"), F.count_if(good == 0).alias("n_unbalanced"), F.avg(good).alias("balanced_ratio"), F.avg("balance").alias("mean_balance"))


# --- causal diagnostics ---


def causal_diagnostics(direction: DataFrame, invariant: DataFrame, least_direction: float = 0.60, least_ratio: float = 0.70) -> DataFrame:
    """series_id and the features of both results: intervention consistency, confounding risk, composite, and the gates that fail."""
    rows = direction.join(invariant, "series_id")
    d, r = F.col("causal_direction_score"), F.col("invariance_pass_ratio")
    back, forth = F.abs("backward"), F.abs("forward")
    risk = F.when(forth > 1e-10, F.least(F.lit(1.0), back / forth)).otherwise(F.when(back > 0.05, 1.0).otherwise(0.0))
    risk = F.least(F.lit(1.0), (risk + (1 - F.col("coefficient_stability")) * 0.3) / 1.3)
    failed = F.array_compact(F.array(F.when(d < least_direction, "causal_direction_score"), F.when(r < least_ratio, "invariance_pass_ratio")))
    rows = rows.withColumn("confounding_risk_score", risk)
    return rows.select("series_id", d, r, F.sqrt(d * r).alias("intervention_consistency_score"), "confounding_risk_score", (d * 0.4 + r * 0.4 + (1 - F.col("confounding_risk_score")) * 0.2).alias("causal_validity_score"), failed.alias("failures"))


def unit_interval(z: Column, lo: float = -3.0, hi: float = 3.0) -> Column:
    """A z-score on the scale from 0 at ``lo`` to 1 at ``hi``."""
    return (z - lo) / (hi - lo)
