"""Formula genomes: axis weights from the words of a formula, their similarity, clusters and factor matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.stats import cosine, total

#: Axes, and for each its keywords and their weights.
KEYWORDS: dict[str, list[tuple[str, float]]] = {
    "momentum": [("momentum", 2.0), ("trend", 1.5), ("return_", 1.0), ("roc", 1.5), ("ts_delta", 1.5), ("ts_returns", 2.0), ("price_change", 1.5), ("breakout", 1.0), ("drift", 1.0), ("12m", 1.2), ("6m", 1.0), ("3m", 0.8), ("ret_", 1.5), ("fwd_", 0.5)],
    "mean_reversion": [("zscore", 2.0), ("mean_rev", 2.0), ("reversal", 1.5), ("reversion", 1.5), ("deviation", 1.2), ("distance", 1.0), ("spread", 1.0), ("ts_rank", 1.5), ("percentile", 1.0), ("excess", 1.0), ("relative", 0.8), ("vs_", 0.8), ("norm_", 0.8)],
    "flow": [("volume", 1.5), ("turnover", 1.5), ("flow", 2.0), ("order", 1.5), ("imbalance", 2.0), ("buy", 1.2), ("sell", 1.2), ("net_buy", 2.0), ("large_order", 1.5), ("institutional", 1.5), ("vwap", 1.5), ("amihud", 1.5), ("kyle", 1.5), ("roll", 1.0)],
    "volatility": [("vol", 2.0), ("volatility", 2.0), ("variance", 1.5), ("std", 1.5), ("atr", 2.0), ("range_", 1.5), ("garch", 2.0), ("realized", 1.5), ("implied", 1.5), ("vix", 2.0), ("highlow", 1.5), ("parkinson", 1.5), ("garman", 1.5), ("beta", 1.0), ("skew", 1.2)],
    "value": [("value", 2.0), ("pb", 2.0), ("pe", 2.0), ("pcf", 1.5), ("ps", 1.5), ("book_", 1.5), ("earnings", 1.5), ("dividend", 1.5), ("yield", 1.5), ("fcf", 1.5), ("roe", 1.5), ("roa", 1.5), ("margin", 1.0), ("ev_", 1.5), ("enterprise", 1.0), ("fundamental", 1.5)],
    "event": [("event", 2.0), ("earnings_", 2.0), ("announcement", 2.0), ("shock", 1.5), ("news", 1.5), ("surprise", 2.0), ("guidance", 1.5), ("revision", 1.5), ("tob", 2.0), ("buyback", 1.5), ("split", 1.5), ("dividend_cut", 2.0), ("downgrade", 1.5), ("upgrade", 1.5), ("analyst", 1.0)],
    "macro": [("rate", 1.5), ("yield_", 1.5), ("fx", 2.0), ("currency", 1.5), ("gdp", 1.5), ("inflation", 1.5), ("cpi", 1.5), ("employment", 1.0), ("macro", 2.0), ("global", 1.0), ("usd", 1.5), ("jpy", 1.5), ("us10y", 2.0), ("tsy", 1.5), ("credit_spread", 1.5)],
    "microstructure": [("bid_ask", 2.0), ("spread_", 1.5), ("depth", 1.5), ("quote", 1.5), ("tick", 1.5), ("microstructure", 2.0), ("vwap", 1.5), ("twap", 1.5), ("market_impact", 2.0), ("resiliency", 1.5), ("adverse", 1.5), ("price_discovery", 1.5), ("execution", 1.0)],
    "sentiment": [("sentiment", 2.0), ("fear", 1.5), ("greed", 1.5), ("survey", 1.5), ("analyst_", 1.5), ("consensus", 1.5), ("short_", 1.5), ("put_call", 2.0), ("skew_", 1.5), ("net_long", 1.5), ("positioning", 1.5), ("bullish", 1.5), ("bearish", 1.5), ("retail_", 1.0)],
    "credit_leverage": [("credit", 2.0), ("leverage", 2.0), ("debt", 1.5), ("default", 1.5), ("cds", 2.0), ("hyg", 1.5), ("hy_", 1.5), ("ig_", 1.5), ("spread_credit", 2.0), ("margin_", 1.0), ("net_debt", 1.5), ("interest_cover", 1.5), ("financial_stress", 2.0), ("z_score_altman", 2.0)],
}
AXES = tuple(KEYWORDS)
BLOCK = 1024  # distinct genomes in a block that is compared at once

#: Known factors, their families, keywords and usual crowding.
FACTORS: list[tuple[str, str, list[str], float]] = [
    ("MOM_12M", "momentum", ["momentum", "12m", "return_12", "ts_returns", "trend"], 0.75),
    ("MOM_6M", "momentum", ["momentum", "6m", "return_6", "roc6"], 0.70),
    ("STR_1M", "mean_reversion", ["reversal", "1m", "short_term", "mean_rev"], 0.55),
    ("BM_RATIO", "value", ["bm", "pb", "book_to_market", "pbr", "book_value"], 0.60),
    ("EP_RATIO", "value", ["ep", "pe", "earnings_yield", "earning", "per"], 0.60),
    ("CF_YIELD", "value", ["cf", "cashflow", "cash_flow", "fcf", "pcf"], 0.55),
    ("ROE", "quality", ["roe", "return_equity", "equity_return", "profitability"], 0.65),
    ("ROA", "quality", ["roa", "return_assets", "asset_return"], 0.60),
    ("GROSS_MARGIN", "quality", ["gross_margin", "margin", "profitability"], 0.55),
    ("SIZE_MKT_CAP", "size", ["market_cap", "size", "small_cap", "mktcap"], 0.50),
    ("LOW_VOL", "low_vol", ["low_vol", "min_vol", "volatility_inverse", "stability"], 0.70),
    ("ORDER_IMBALANCE", "flow", ["order_imbalance", "net_buy", "flow", "buy_sell"], 0.45),
    ("VOLUME_SURPRISE", "flow", ["volume_surprise", "abnormal_volume", "volume_ratio"], 0.40),
    ("EARNINGS_SURPRISE", "event", ["earnings_surprise", "sue", "forecast_error", "beat"], 0.50),
    ("ANALYST_REVISION", "event", ["revision", "upgrade", "downgrade", "forecast_change"], 0.55),
    ("SHORT_INTEREST", "sentiment", ["short_interest", "short_ratio", "put_call", "bearish"], 0.60),
]


def formula_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))


def _hits(keywords: list[tuple[str, float]]):
    """Adds a token's weights: of the keywords that it holds or that hold it."""

    def add(s: Column, token: Column) -> Column:
        return s + reduce(lambda a, b: a + b, [F.when(token.contains(k) | F.lit(k).contains(token), w).otherwise(0.0) for k, w in keywords])

    return add


def encode(df: DataFrame, text: str) -> DataFrame:
    """``df`` with genome (a weight for each axis, 1 in all), dominant_axis (the first on ties) and confidence."""
    words = formula_tokens(F.col(text))
    raw = F.array(*[F.aggregate(words, F.lit(0.0), _hits(KEYWORDS[a])) for a in AXES])
    rows = df.withColumn("_raw", raw).withColumn("_all", total(F.col("_raw")))
    even = F.array(*[F.lit(1.0 / len(AXES))] * len(AXES))
    rows = rows.withColumn("genome", F.when(F.col("_all") > 1e-10, F.transform("_raw", lambda x: x / F.col("_all"))).otherwise(even))
    first = F.element_at(F.array(*[F.lit(a) for a in AXES]), F.array_position("genome", F.array_max("genome")).cast("int"))
    matched = F.size(F.filter("_raw", lambda x: x > 0))
    return rows.withColumn("dominant_axis", first).withColumn("confidence", F.least(F.lit(1.0), matched / (len(AXES) / 2))).drop("_raw", "_all")


def factor_matches(df: DataFrame, text: str) -> DataFrame:
    """``df`` exploded to factor_id, family and score: the number of the factor's keywords in the formula."""
    low = F.lower(F.col(text))
    each = [F.struct(F.lit(f).alias("factor_id"), F.lit(fam).alias("family"), reduce(lambda a, b: a + b, [low.contains(k).cast("int") for k in ks]).cast("double").alias("score")) for f, fam, ks, _ in FACTORS]
    return df.withColumn("_f", F.explode(F.array(*each))).select(*df.columns, "_f.*")


def members(genomes: DataFrame, id_col: str) -> DataFrame:
    """id, representative (the first id of its genome), genome; rows without an id or a genome are left out."""
    known = genomes.where(F.col(id_col).isNotNull() & F.col("genome").isNotNull()).select(F.col(id_col).alias("id"), "genome").distinct()
    return known.join(known.groupBy("genome").agg(F.min("id").alias("representative")), "genome").select("id", "representative", "genome")


def similar(genomes: DataFrame, id_col: str, least: float = 0.90) -> DataFrame:
    """a < b, similarity of the distinct genomes, each by its first id, that reach ``least`` in cosine.

    All are compared: the genomes are split into blocks of about ``BLOCK`` and all pairs of blocks are
    dealt out, so a task holds two blocks. ``members`` tells which ids a first id stands for.
    """
    import numpy as np
    import pandas as pd

    one = genomes.where(F.col("genome").isNotNull()).groupBy("genome").agg(F.min(id_col).alias("id")).where("id is not null")
    blocks = one.crossJoin(F.broadcast(one.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("nb"))))
    blocks = blocks.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = blocks.select("id", "genome", "blk", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf["blk"] == pdf[k].iloc[0]] for k in ("bi", "bj"))
        gx, gy = (np.array(p["genome"].tolist(), float).reshape(len(p), -1) for p in (x, y))
        if not len(x) or not len(y):
            return pd.DataFrame({"x": x["id"][:0], "y": y["id"][:0], "similarity": np.zeros(0)})
        dot, nx, ny = np.zeros((len(x), len(y))), np.zeros(len(x)), np.zeros(len(y))
        for u, v in zip(gx.T, gy.T, strict=True):  # axis by axis, as the sums of ``cosine``
            dot += np.outer(u, v)
            nx, ny = nx + u * u, ny + v * v
        n = np.outer(np.sqrt(nx), np.sqrt(ny))
        s = np.where(n > 1e-15, np.clip(dot / np.where(n > 1e-15, n, 1), -1, 1), 0.0)
        near = s >= least
        i, j = np.nonzero(np.triu(near, 1) if pdf["bi"].iloc[0] == pdf["bj"].iloc[0] else near)
        return pd.DataFrame({"x": x["id"].to_numpy()[i], "y": y["id"].to_numpy()[j], "similarity": s[i, j]})

    kind = one.schema["id"].dataType.simpleString()
    pairs = dealt.groupBy("bi", "bj").applyInPandas(compare, f"x {kind}, y {kind}, similarity double")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity").where("a < b")


def near_duplicates(genomes: DataFrame, id_col: str, least: float = 0.90) -> DataFrame:
    """a < b, similarity, equal: the pairs of ``similar``, and where equal each other id b of the genome of a first id a.

    Two ids reach ``least`` where they have the same first id or their first ids are a pair.
    """
    same = members(genomes, id_col).where("representative < id").select(F.col("representative").alias("a"), F.col("id").alias("b"), cosine(F.col("genome"), F.col("genome")).alias("similarity"))
    return similar(genomes, id_col, least).withColumn("equal", F.lit(False)).unionByName(same.where(F.col("similarity") >= least).withColumn("equal", F.lit(True)))


def distance(a: Column, b: Column) -> Column:
    """The Euclidean distance of two vectors."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def symmetric(pairs: DataFrame) -> DataFrame:
    """a, b, similarity both ways round, for look-ups by either id."""
    return pairs.select("a", "b", "similarity").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))


def axis_rows(genomes: DataFrame, id_col: str) -> DataFrame:
    """id, genome_dominant_axis (its place among the axes) and a column for each axis."""
    place = F.array_position(F.array(*[F.lit(a) for a in AXES]), F.col("dominant_axis")) - 1
    return genomes.select(id_col, place.cast("int").alias("genome_dominant_axis"), *[F.get("genome", F.lit(i)).alias(f"genome_{a}") for i, a in enumerate(AXES)])


def cohesion(genomes: DataFrame, key: str) -> DataFrame:
    """key, n, cohesion: the mean cosine of all pairs of a group; 1 with one member.

    The sum over all pairs follows from the length of the sum of the unit vectors, so no pairs are made.
    """
    length = F.sqrt(total(F.transform("genome", lambda x: x * x)))
    unit = genomes.select(key, F.posexplode(F.transform("genome", lambda x: x / F.when(length < 1e-15, 1.0).otherwise(length))).alias("axis", "u"))
    sums = unit.groupBy(key, "axis").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("own"), F.count("*").alias("n"))
    out = sums.groupBy(key).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("own").alias("own"))
    n = F.col("n")
    return out.select(key, "n", F.when(n < 2, 1.0).otherwise((F.col("all") - F.col("own")) / (n * (n - 1))).alias("cohesion"))


def novelty(genomes: DataFrame, id_col: str, least: float = 0.20) -> DataFrame:
    """id, similarity (the largest cosine with another candidate, 0 with none), novelty and is_novel. Copies of a genome are alike, so only distinct ones are compared."""
    m = members(genomes, id_col)
    pairs = symmetric(similar(genomes, id_col, -1.0)).groupBy("a").agg(F.max("similarity").alias("other"))
    held = m.groupBy("representative").agg(F.count("*").alias("n"), F.first("genome").alias("g"))
    held = held.withColumn("own", F.when(F.col("n") > 1, cosine(F.col("g"), F.col("g"))))
    best = held.join(pairs, F.col("representative") == F.col("a"), "left").select("representative", F.coalesce(F.greatest("own", "other"), F.lit(0.0)).alias("similarity"))
    score = 1 - F.col("similarity")
    return m.join(best, "representative").select(F.col("id").alias(id_col), "similarity", score.alias("novelty"), (score >= least).alias("is_novel"))


def axis_report(genomes: DataFrame) -> DataFrame:
    """axis, mean_weight, n_dominant, most_common (the first axis of those with most candidates)."""
    each = genomes.select("dominant_axis", F.posexplode("genome").alias("i", "w"))
    name = F.element_at(F.array(*[F.lit(a) for a in AXES]), F.col("i") + 1)
    out = each.groupBy("i").agg(F.avg("w").alias("mean_weight"), F.count(F.when(F.col("dominant_axis") == name, 1)).alias("n_dominant"))
    best = out.agg(F.max(F.struct("n_dominant", (-F.col("i")).alias("k"))).alias("b"))  # a row
    return out.crossJoin(best).select(name.alias("axis"), "mean_weight", "n_dominant", (-F.col("b.k") == F.col("i")).alias("most_common"))


def layer(df: DataFrame, id_col: str, text: str, least: float = 0.20, near: float = 0.90) -> DataFrame:
    """id, dominant_axis, confidence, novelty, is_novel, n_near: encoding, novelty and near duplicates of each candidate."""
    g = encode(df, text)
    m = members(g, id_col)
    size = m.groupBy("representative").agg(F.count("*").alias("n"))
    links = symmetric(similar(g, id_col, near)).join(size.withColumnRenamed("representative", "b"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    counts = size.join(links, F.col("representative") == F.col("a"), "left").select("representative", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"))
    near_of = m.join(counts, "representative").select(F.col("id").alias(id_col), "n_near")
    return g.select(id_col, "dominant_axis", "confidence").join(novelty(g, id_col, least).drop("similarity"), id_col).join(near_of, id_col)


def cluster(genomes: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``genomes`` with cluster, by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = genomes.withColumn("_v", array_to_vector("genome"))
    model = KMeans(featuresCol="_v", predictionCol="cluster", k=k, seed=seed, tol=1e-6).fit(rows)
    return model.transform(rows).drop("_v")


# --- proxy series, where no measured ones are at hand ---

#: The generator's multiplier, increment and modulus, and the families' scale and shift.
MULTIPLIER, INCREMENT, MODULUS = 1664525, 1013904223, 2**32
TILT = {"momentum": (0.8, 0.1), "value": (0.7, 0.0), "quality": (0.6, 0.05)}


def _draws(seed: Column, n: int) -> Column:
    """Array of structs (t from 1, u in [-1, 1)): draws of a linear congruential generator, each from the seed itself.

    The t-th state is a_t * seed + c_t, so no draw waits for the one before.
    """
    a, c, steps = 1, 0, []
    for t in range(1, n + 1):
        a, c = a * MULTIPLIER % MODULUS, (c * MULTIPLIER + INCREMENT) % MODULUS
        steps.append(F.struct(F.lit(t).alias("t"), F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")))
    # a < 2^32 and the seed < 2^27, so the product stays a long
    state = lambda s: F.pmod(s["a"] * seed + s["c"], F.lit(MODULUS).cast("long"))
    return F.transform(F.array(*steps), lambda s: F.struct(s["t"].alias("t"), (state(s) / float(MODULUS) * 2 - 1).alias("u")))


def _code_sum(text: Column, most: int) -> Column:
    """The sum of the code points of the first ``most`` characters; 0 of a null or empty text."""
    text = F.coalesce(text, F.lit(""))
    n = F.least(F.length(text), F.lit(most))
    codes = F.transform(F.sequence(F.lit(1), n), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long"))
    return F.when(n > 0, F.aggregate(codes, F.lit(0).cast("long"), lambda x, y: x + y)).otherwise(F.lit(0).cast("long"))


def candidate_proxies(df: DataFrame, id_col: str, text_col: str, n: int = 60, base: int = 99_999) -> DataFrame:
    """series_id, t, signal: a stand-in series for each formula, seeded by its first 50 characters."""
    draws = _draws(_code_sum(F.col(text_col), 50) + base, n)
    return df.select(F.col(id_col).alias("series_id"), F.explode(draws).alias("d")).select("series_id", "d.t", F.col("d.u").alias("signal"))


def factor_proxies(spark, n: int = 60, base: int = 12_345) -> DataFrame:
    """factor, t, x: a stand-in series for each known factor, tilted by its family."""
    known = spark.createDataFrame([(i, *TILT.get(family, (1.0, 0.0))) for i, family, _, _ in FACTORS], "factor string, scale double, shift double")
    draws = _draws(_code_sum(F.col("factor"), 1000) + base, n)
    return known.select("factor", "scale", "shift", F.explode(draws).alias("d")).select("factor", "d.t", (F.col("d.u") * F.col("scale") + F.col("shift")).alias("x"))
