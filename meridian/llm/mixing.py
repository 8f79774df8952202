"""Mixing sources to target weights by the cube method.

A document of a source whose target is r times its size is taken floor(r) times, and once
more with probability r - floor(r). The cube method draws these last copies balanced: it
moves the inclusion probabilities along vectors of the null space of two
constraints, the words and the documents taken, until each is 0 or 1 but for two at
most. Units are dealt out in blocks of a source, each of about ``BLOCK`` units; the
two that a block leaves open go on, with their probabilities as they are, to a next
round of fewer blocks, and the last block of a source lands its two by a draw that keeps both
probabilities and, of all such draws, comes closest to the words in the mean. So every document is taken with just its
probability, no task holds more than a block, and a source's words stay within a document of its target.

Randomness comes from hashes of ids and texts and from seeds of block keys, so reruns
agree on any partitioning.

Targets are found by raising one level until no source is above its bound, an aggregate each time; only
the order of the sources' names needs a sort, which is one of names.

Defined results: a null or blank text has size 0 and is taken like another, for no words; a
null source is a source, the last one; equal rows are separate documents; null ids are
allowed; documents of equal size and hash are drawn in the order of their ids, equal ones stand for each other;
a very long text is one document; a table without words takes nothing; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import by_groups, cut, shuffle_partitions, unused

WEIGHTS, SHARE, MOST, BLOCK = (5, 2, 1), 1.5, 2.0, 4000
NEAR = 1e-9


def ranked(names: DataFrame, name: str) -> DataFrame:
    """``names``, distinct, with rank (long): the place by code point from 0, null last. Sorted by ranges; a row a range is counted."""
    n = shuffle_partitions(names.sparkSession)
    key = [F.col(name).isNull(), F.col(name)]  # strings are compared by their UTF-8 bytes, which is by code point
    parts = cut(names.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id()))
    sizes = sorted(parts.groupBy("part").agg(F.count("*").alias("n"), F.min("k").alias("lo")).collect())  # a row a range
    before = list(itertools.accumulate((r.n for r in sizes), initial=0))
    shift = F.create_map(*[F.lit(x) for r, b in zip(sizes, before, strict=False) for x in (r.part, b - r.lo)]) if sizes else None
    rank = F.col("k") + F.element_at(shift, F.col("part")) if sizes else F.lit(0)
    return parts.select(*names.columns, rank.cast("long").alias("rank"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size) with target: ``share`` times all sizes by weight, none above ``most`` times its size.

    A source's weight goes by its place. The excess of the sources at their bound is shared again by weight until none is above.
    """
    place = (F.col("rank") % len(weights) + 1).cast("int")
    rows = cut(ranked(sources, "source").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place)))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, n = 0.0, -1
    while True:
        part = F.lit(level) * F.col("weight")
        over = (F.col("source_size") > 0) & (part > most * F.col("source_size"))
        some = F.col("source_size") > 0
        got = rows.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("source_size"))).alias("full"), F.sum(F.when(some & ~over, F.col("weight"))).alias("weight")).first()
        if got.n == n:
            break
        n = got.n
        level = (share * total - most * (got.full or 0)) / got.weight if got.weight else level
    bound = most * F.col("source_size")
    return rows.select("source", "source_size", F.when(F.col("source_size") <= 0, 0.0).when(over, bound).otherwise(part).alias("target"))


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities to 0 and 1, keeping their sum and the sum of p * x, until at most two lie between."""
    p = p.copy()
    live = [i for i in range(len(p)) if NEAR < p[i] < 1 - NEAR]
    draws = rng.random(len(live) + 8).tolist()
    pv, xv = p.tolist(), x.tolist()
    wait, at, hand, k = live, 0, [], 0
    while True:
        while len(hand) < 3 and at < len(wait):
            hand.append(wait[at])
            at += 1
        if len(hand) == 3:
            a, b, c = (xv[i] for i in hand)
            u = (c - b, a - c, b - a)
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
        elif len(hand) == 2 and xv[hand[0]] == xv[hand[1]]:
            u = (1.0, -1.0)
        else:
            break
        up = min(((1 - pv[i]) / d if d > 0 else -pv[i] / d) for i, d in zip(hand, u, strict=True) if d)
        down = min((pv[i] / d if d > 0 else (pv[i] - 1) / d) for i, d in zip(hand, u, strict=True) if d)
        step = up if draws[k % len(draws)] * (up + down) < down else -down
        k += 1
        stay = []
        for i, d in zip(hand, u, strict=True):
            v = pv[i] + step * d
            pv[i] = v = 0.0 if v < NEAR else 1.0 if v > 1 - NEAR else v
            if 0 < v < 1:
                stay.append(i)
        hand = stay
    return np.array(pv)


def land(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds the two open probabilities at most by one draw that keeps each.

    With open p1 and p2 a draw is fixed by the chance that both are taken. The mean distance from the words that were
    open is linear in it and grows, so the least chance is the closest: never both where p1 + p2 <= 1, never none else.
    """
    p = p.copy()
    live = np.flatnonzero((p > NEAR) & (p < 1 - NEAR))
    u = rng.random()
    if len(live) == 1:
        p[live] = u < p[live]
    elif len(live) == 2:
        a, b = p[live]
        p[live] = (u < a, a <= u < a + b) if a + b <= 1 else (u < a, u >= 1 - b)
    elif len(live):
        raise ValueError("more than two units are open")
    return p.round()


def _round(schema: pa.Schema):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("size", "ascending"), ("doc", "ascending")])
        p, x = t.column("p").to_numpy(), t.column("size").to_numpy().astype(np.float64)
        last = t.column("nb")[0].as_py() == 1
        rng = np.random.default_rng([7, key[1], t.num_rows, int(t.column("h")[0].as_py()) & 0xFFFFFFFF])
        p = flight(p, x, rng)
        if last:
            p = land(p, x, rng)
        return t.select(schema.names).set_column(schema.get_field_index("p"), "p", pa.array(p))

    return run


def row_hash(id_col: str = "doc_id", text_col: str = "text"):
    return F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col).cast("string"))


def repeat_taken(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, each as often as the mix takes it; rows equal in id and text stand for each other."""
    i, h, k, n, c = unused(df, "_i", "_h", "_k", "_n", "_c")
    copies = mixed.groupBy(F.col(id_col).alias(i), F.col("h").alias(h)).agg(F.sum("copies").alias(n)).where(F.col(n) > 0)
    rows = df.withColumn(k, row_hash(id_col, text_col)).dropDuplicates([id_col, k])
    rows = rows.join(copies, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(k) == F.col(h)))
    return rows.withColumn(c, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*df.columns)


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id_col, source_col, size, source_size, target, h (a hash of the row), copies, taken of each row."""
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    units = cut(df.select(F.col(id_col).alias("doc"), F.col(source_col).cast("string").alias("source"), size.alias("size"), row_hash(id_col, text_col).alias("h")))
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    other = cut(targets(sums)).withColumnRenamed("source", "s")
    rows = units.join(other, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("full", F.floor(r).cast("long")).withColumn("p", r - F.floor(r))
    done = []
    names = [*rows.columns]
    open_ = (F.col("p") > NEAR) & (F.col("p") < 1 - NEAR)
    done.append(rows.where(~open_))
    left = cut(rows.where(open_))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema)
    fields = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[f.dataType.simpleString()]) for f in left.schema])
    level = 0
    while left.head(1):
        nb = cut(left.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))).withColumnRenamed("source", "s")
        dealt = left.join(nb, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        dealt = dealt.withColumn("blk", F.pmod(F.xxhash64(F.lit(level), "h", "doc"), F.col("nb")).cast("int"))
        moved = cut(by_groups(dealt, ["source", "blk"], _round(fields), kinds, fields))
        done.append(moved.where(~open_))
        left = moved.where(open_).select(*names)
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = F.col("full") + F.round("p").cast("long")
    return out.select(F.col("doc").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "h", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
