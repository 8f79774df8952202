"""Deduplication of candidates: by the structure of their formulas and by the correlation of their signals.

Both are greedy walks over pairs that are alike. A walk is sequential only along chains of such pairs, so it runs in rounds:
in each, whatever no undecided earlier pair or candidate can change is decided at once, by joins. No task holds a list of
candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.sources.lineage import cut


def prefix_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts (two empty ones too), 0 where one is empty, else the common beginning's part of the longer text."""
    n = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.when(a == b, 1.0).when(n == 0, 0.0).otherwise(same / F.greatest(F.length(a), F.length(b)))


def words(text: Column) -> Column:
    """The distinct words of a formula, brackets being spaces."""
    return F.array_distinct(F.filter(F.split(F.translate(text, "()", "  "), r"\s+"), lambda x: x != ""))


def formula_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, else the Jaccard similarity of their words; 0 where one is missing or empty."""
    both = F.size(F.array_intersect(words(a), words(b)))
    union = F.size(F.array_union(words(a), words(b)))
    return F.when((F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0), 0.0).when(a == b, 1.0).otherwise(F.coalesce(F.try_divide(both, union), F.lit(0.0)))


def alike(df: DataFrame, keys: list[str], text_col: str, hash_col: str | None = None, least: float = 0.95) -> DataFrame:
    """keys, a, b, similarity: pairs of candidates (ids a and b, ord of a before that of b) of one group whose formulas or hashes reach ``least``.

    Equal formulas meet as one row, so copies make one pair each with the first of them, and different formulas meet on the rarest words
    alone: a pair at the bound shares one of the first size - ceil(least * size) + 1 by how many formulas hold them.
    Hashes that are alike share a beginning of at least ``least`` of the longer one, so they meet on it.
    """
    rows = df.select(*keys, F.col("candidate_id").alias("id"), "ord", F.col(text_col).alias("f"), *([F.col(hash_col).alias("h")] if hash_col else []))
    held = rows.where("f is not null and f <> ''").groupBy(*keys, "f").agg(F.min(F.struct("ord", "id")).alias("one"))
    sets = held.withColumn("set", words(F.col("f"))).withColumn("n", F.size("set"))
    each = sets.select(*keys, F.col("one.id").alias("id"), F.col("one.ord").alias("ord"), "f", "n", F.explode("set").alias("word"))
    counts = each.groupBy(*keys, "word").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy(*keys, "id").orderBy("df", "word"))
    rare = each.join(counts, [*keys, "word"]).withColumn("p", place).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(*keys, "word", "id", "ord", "f")
    x, y = rare.toDF(*keys, "word", "a", "oa", "fa"), rare.toDF(*keys, "word", "b", "ob", "fb")
    near = x.join(y, [*keys, "word"]).where("oa < ob").select(*keys, "a", "oa", "fa", "b", "ob", "fb").distinct()
    near = near.withColumn("similarity", formula_similarity(F.col("fa"), F.col("fb"))).where(F.col("similarity") >= least)
    # every formula's candidates stand for it
    member = rows.select(*keys, "f", "id", "ord")
    far = near.select(*keys, "fa", "fb", "similarity").join(member.toDF(*keys, "fa", "a", "oa"), [*keys, "fa"]).join(member.toDF(*keys, "fb", "b", "ob"), [*keys, "fb"])
    copies = member.join(held.select(*keys, "f", F.col("one.id").alias("a"), F.col("one.ord").alias("oa")), [*keys, "f"]).where("ord > oa")
    pick = lambda p, q: F.when(F.col("oa") < F.col("ob"), F.col(p)).otherwise(F.col(q))
    out = far.select(*keys, pick("a", "b").alias("a"), F.least("oa", "ob").alias("oa"), pick("b", "a").alias("b"), F.greatest("oa", "ob").alias("ob"), "similarity")
    out = out.unionByName(copies.select(*keys, "a", "oa", F.col("id").alias("b"), F.col("ord").alias("ob"), F.lit(1.0).alias("similarity")))
    if hash_col and hash_col != text_col:
        known = rows.where("h is not null")
        short = F.ceil(F.length("h") * least).cast("int")
        part = known.select(*keys, "id", "ord", "h", F.explode(F.sequence(F.ceil(short * least).cast("int"), F.length("h"))).alias("n")).withColumn("start", F.col("h").substr(F.lit(1), F.col("n")))
        x, y = part.select(*keys, "start", "id", "ord", "h").toDF(*keys, "start", "a", "oa", "ha"), part.select(*keys, "start", "id", "ord", "h").toDF(*keys, "start", "b", "ob", "hb")
        hashes = x.join(y, [*keys, "start"]).where("oa < ob").select(*keys, "a", "oa", "ha", "b", "ob", "hb").distinct().withColumn("similarity", prefix_similarity(F.col("ha"), F.col("hb"))).where(F.col("similarity") >= least)
        out = out.unionByName(hashes.select(*keys, "a", "oa", "b", "ob", "similarity"))
    return out.groupBy(*keys, "a", "oa", "b", "ob").agg(F.max("similarity").alias("similarity"))


def greedy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, suppressed_by: walks the candidates in their order and drops those that an earlier kept one is like.

    pairs(keys, a, oa, b, ob), ``a`` before ``b``. In a round a candidate that no undecided one comes before stays, and those that it is like go, so
    there are as many rounds as the longest chain of candidates that wait for each other. Who never goes stays.
    """
    pairs = cut(pairs.select(*keys, "a", "oa", "b", "ob").distinct())
    left, gone = pairs, pairs.select(*keys, F.col("b").alias("id")).where("false")
    while left.head(1):
        waits = left.select(*keys, F.col("b").alias("a")).distinct()
        now = cut(left.join(waits, [*keys, "a"], "left_anti").select(*keys, F.col("b").alias("id")).distinct())
        gone = gone.unionByName(now)
        left = cut(left.join(now.withColumnRenamed("id", "a"), [*keys, "a"], "left_anti").join(now.withColumnRenamed("id", "b"), [*keys, "b"], "left_anti"))
    # a candidate is dropped by the first one before it that stays
    stays = pairs.join(gone.withColumnRenamed("id", "a"), [*keys, "a"], "left_anti")
    by = stays.join(gone.withColumnRenamed("id", "b"), [*keys, "b"], "left_semi").groupBy(*keys, "b").agg(F.min(F.struct("oa", "a")).alias("first"))
    return by.select(*keys, F.col("b").alias("id"), F.col("first.a").alias("suppressed_by"))


def structural(df: DataFrame, keys: list[str], text_col: str, hash_col: str | None = None, least: float = 0.95) -> DataFrame:
    """keys, id, suppressed_by of the candidates that an earlier kept one of the group is like in formula or hash."""
    return greedy(alike(df, keys, text_col, hash_col, least), keys)


def mark(df: DataFrame, gone: DataFrame, name: str = "near_duplicate_of") -> DataFrame:
    """``df`` with who suppressed each candidate, NULL if none did."""
    keys = [c for c in gone.columns if c not in ("id", "suppressed_by")]
    return df.join(gone.withColumnRenamed("id", "candidate_id").withColumnRenamed("suppressed_by", name), [*keys, "candidate_id"], "left")


def by_preference(pairs: DataFrame, evaluations: DataFrame, most: float = 0.90) -> DataFrame:
    """id, suppressed_by: of each pair of signals (a, b, corr) with |corr| above ``most`` the less preferred candidate goes.

    Pairs are walked from the strongest (ties: by a, then b); one with a suppressed candidate is passed over. Preferred is the lower
    complexity_penalty, then the lower crowding_penalty, then the higher regime_entropy_score, then ``a``; a candidate without an evaluation counts
    as (1, 1, 0). A pair decides in the round in which it is the first of the undecided pairs of both of its candidates.
    """
    zero = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)) if c in evaluations.columns else F.lit(0.0)
    taste = evaluations.select(F.col("candidate_id").alias("id"), F.struct(zero("complexity_penalty").alias("x"), zero("crowding_penalty").alias("y"), (-zero("regime_entropy_score")).alias("z")).alias("t"))
    none = F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(0.0).alias("z"))
    p = pairs.where(F.abs("corr") > most)
    p = p.join(taste.toDF("a", "ta"), "a", "left").join(taste.toDF("b", "tb"), "b", "left")
    stays_a = F.coalesce("ta", none) <= F.coalesce("tb", none)
    p = cut(p.select("a", "b", F.when(stays_a, F.col("b")).otherwise(F.col("a")).alias("id"), F.when(stays_a, F.col("a")).otherwise(F.col("b")).alias("suppressed_by"), F.struct((-F.abs("corr")).alias("s"), "a", "b").alias("turn")))
    done = None
    while p.head(1):
        ends = p.select(F.explode(F.array("a", "b")).alias("end"), "turn").groupBy("end").agg(F.min("turn").alias("first"))
        now = cut(p.join(ends.toDF("a", "f1"), "a").join(ends.toDF("b", "f2"), "b").where("turn = f1 and turn = f2").select("id", "suppressed_by"))
        done = now if done is None else done.unionByName(now)
        # pairs of a suppressed candidate are passed over; the deciding ones are among them
        p = cut(p.join(now.select(F.col("id").alias("a")), "a", "left_anti").join(now.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b", "id", "suppressed_by", "turn"))
    return done if done is not None else p.select("id", "suppressed_by")


def run(candidates: DataFrame, evaluations: DataFrame, pairs: DataFrame, text_col: str = "formula", hash_col: str | None = None, least: float = 0.95, most: float = 0.90) -> DataFrame:
    """id, axis ('structural' or 'signal'), suppressed_by: both kinds of suppression, as one list; an id may stand under both."""
    a = structural(candidates, [], text_col, hash_col, least).select("id", F.lit("structural").alias("axis"), "suppressed_by")
    return a.unionByName(by_preference(pairs, evaluations, most).select("id", F.lit("signal").alias("axis"), "suppressed_by"))
