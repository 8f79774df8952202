"""Quality classifier by importance resampling.

A text's n-grams are its words and its pairs of neighbours, hashed to ``BUCKETS`` each; a word after itself is one n-gram
whatever the word. Generative models of n-grams are counted for the kinds of labelled rows: the target (good quality, not
toxic), toxic, and low quality. The model of raw text is the mixture of these kinds by their shares of
the labelled rows. The importance weight of a text x is p_target(x) / p_raw(x), so its logarithm is

    -log(share_target + sum over the other kinds of share * exp(log p_kind(x) - log p_target(x)))

and log p_kind(x) - log p_target(x) is a sum over the n-grams of x of the log ratio of their probabilities. That ratio is
(count + ``ADD``) / (what the target's count lets expect + ``ADD``), drawn to zero by ``EFFECT`` and ``SURE`` standard errors (of n-grams that the kinds hold alike),
so that an n-gram whose counts could differ by chance, or with the lengths of the texts, says nothing. The ratios are not
normalised again: a mass of texts of one kind that share a passage would shift all others. A text counts once for each kind, so copies
count as one.

The sample is drawn by Gumbel top-k: the k largest sums of log weight and a standard Gumbel draw, which is a draw of k rows
without replacement with chances in proportion to the weights. The draw comes from a hash of the row, so reruns
agree. k is the number of rows that are of the target with a probability of ``LEAST`` or more.

The labelled rows (at most ``LABELLED``, those with the least hashes of their ids) fit the kinds' models; a labelled row is
weighed without its own n-grams in its kind's counts, so it is like others. Weights, k and the sample are of all rows.
The k-th largest key is found by counting keys in ranges that narrow, so no task sorts all rows. Counts and models, mostly
zeros, go to the driver and from it compressed.

Defined results: a text without n-grams, or a null one, has log weight 0; a very long text is weighed whole; with no good
labelled rows all rows are kept; equal rows have equal weights and draws; rows whose keys tie at the k-th place are all
kept; a row with a null id is weighed like another; other columns are ignored (``keep_sampled`` passes them on); an empty
table gives no rows. An id with several labels is of low quality if any of them says so, else toxic if any does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import Words, cut, keep_rows, mix, planes, shuffle_partitions, trim, trimmed, unplanes

BUCKETS, LABELLED, CHUNK, ADD, SURE, EFFECT, LEAST = 1 << 20, 20_000, 1 << 14, 0.5, 3.0, 1.0, 0.1
KINDS = 3  # target, toxic, low quality
COUNTERS = 32  # tasks that count the labelled rows
COUNTS = pa.schema([("kind", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary())])


def features(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of the pairs of neighbours; bucket 0 of the pairs is a word after itself."""
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]
    pairs = np.where(h[:-1] == h[1:], np.uint64(0), pairs % np.uint64(BUCKETS - 1) + np.uint64(1)) if len(h) > 1 else pairs
    return (h % np.uint64(BUCKETS)).astype(np.int64), pairs.astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """A chunk of counts, compressed."""
    return pa.compress(planes(x), codec="zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    return unplanes(pa.decompress(raw, 8 * CHUNK, codec="zstd", asbytes=True), "<i8")


def _counted(rows: list, kind: int) -> np.ndarray:
    """One kind's and order's counts, from the rows of all chunks."""
    out = np.zeros(BUCKETS, np.int64)
    for k, chunk, raw in rows:
        if k == kind:
            out[chunk * CHUNK : (chunk + 1) * CHUNK] = _unpack(bytes(raw))
    return out


def _batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for big in batches:
        yield from (big.slice(i, n) for i in range(0, big.num_rows, n))


@trimmed
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's counts, in chunks of buckets: kind and order make one number."""
    known = Words(seed=8)
    total: dict[int, np.ndarray] = {}
    for b in _batches(batches, 1024):
        parts: dict[int, list[np.ndarray]] = {}
        for text, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for order, x in enumerate(features(known.of(text))):
                parts.setdefault(2 * kind + order, []).append(x)
        for k, x in parts.items():
            total[k] = total.get(k, 0) + np.bincount(np.concatenate(x), minlength=BUCKETS)
    for k, x in total.items():
        rows = [(k, c, _pack(x[c * CHUNK : (c + 1) * CHUNK])) for c in range(-(-BUCKETS // CHUNK))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COUNTS, strict=True)], schema=COUNTS)


@trimmed
def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for kind, chunk, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            total[kind, chunk] = total.get((kind, chunk), 0) + _unpack(x)
    rows = [(k, c, _pack(x)) for (k, c), x in total.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COUNTS, strict=True)], schema=COUNTS)


class Ratios:
    """The log ratios of the n-grams' probabilities, of each other kind to the target, for one order."""

    def __init__(self, counts: list[np.ndarray]):
        self.counts = [c.astype(np.int32) for c in counts]
        target = max(1, int(counts[0].sum()))
        self.share = [int(c.sum()) / target for c in counts]
        self.table = [np.zeros(0, np.float32), *(np.zeros(len(counts[0]), np.float32) for _ in range(1, KINDS))]
        for at in (slice(i, i + CHUNK) for i in range(0, len(counts[0]), CHUNK)):
            for k in range(1, KINDS):
                self.table[k][at] = self.raw(k, self.counts[k][at], self.counts[0][at])

    def __getstate__(self) -> tuple:
        return self.share, *([(len(x), pa.compress(x.tobytes(), codec="zstd", asbytes=True)) for x in have] for have in (self.counts, self.table))

    def __setstate__(self, state: tuple) -> None:
        self.share = state[0]
        self.counts, self.table = ([np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd"), kind) for n, raw in have] for have, kind in zip(state[1:], (np.int32, np.float32), strict=True))

    def raw(self, k: int, count: np.ndarray, target: np.ndarray) -> np.ndarray:
        share = self.share[k]
        if not share:
            return np.zeros(len(count))
        ratio = np.log((count + ADD) / (target * share + ADD))
        both = np.maximum(count + target, 0) + ADD  # were the kinds alike, they would hold it by their sizes
        error = np.sqrt((1 + share) / both * (1 / share + 1))
        return np.sign(ratio) * np.maximum(0, np.abs(ratio) - EFFECT - SURE * error)

    def of(self, x: np.ndarray, k: int, own: int | None) -> float:
        """The sum over a text's n-grams ``x``, without the text itself where it is a labelled row of kind ``own``."""
        if not len(x):
            return 0.0
        if own not in (0, k):
            return float(self.table[k][x].sum(dtype=np.float64))
        u, c = np.unique(x, return_counts=True)
        raw = self.raw(k, self.counts[k][u] - c * (own == k), self.counts[0][u] - c * (own == 0))
        return float((raw * c).sum())


def _weigh(orders: list[Ratios]):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(seed=8)
        for b in _batches(batches, 1024):
            out = []
            for text, kind in zip(b.column("text").to_pylist(), b.column("kind").to_pylist(), strict=True):
                parts = features(known.of(text))
                out.append([sum(r.of(x, k, kind) for r, x in zip(orders, parts, strict=True)) for k in range(1, KINDS)])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), *(pa.array(c, pa.float64()) for c in zip(*out, strict=True))], ["id", "h", "r1", "r2"])

    return run


def kth_largest(df: DataFrame, col: str, k: int) -> float:
    """The k-th largest value of a column of finite doubles, by counts in ranges that narrow."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if k <= 0 or lo is None:
        return np.inf
    above, n = 0, 4096
    while True:
        inside = df.where((F.col(col) >= lo) & (F.col(col) <= hi))
        width = (hi - lo) / n
        if width <= 0 or lo + width == lo or hi - width == hi:
            return lo if width <= 0 else float(inside.agg(F.min(col)).first()[0])
        bins = {r[0]: r[1:] for r in inside.groupBy(F.least(F.floor((F.col(col) - lo) / width), F.lit(n - 1)).alias("b")).agg(F.count("*"), F.min(col), F.max(col)).collect()}  # n rows at most
        for b in sorted(bins, reverse=True):
            count, low, high = bins[b]
            if above + count >= k:
                break
            above += count
        if low == high:
            return low
        lo, hi = low, high


def log_weight(shares: list[float]) -> Column:
    """The log importance weight, from the log ratios r1 and r2 of a text under the other kinds and the target."""
    logs = [F.lit(float(np.log(max(s, 1e-300)))) + r for s, r in zip(shares, (F.lit(0.0), F.col("r1"), F.col("r2")), strict=True)]
    top = F.greatest(*logs)
    return -(top + F.log(sum((F.exp(x - top) for x in logs[1:]), F.exp(logs[0] - top))))


def resample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are sampled: id_col, h (a hash of the row), log_weight, target_share (the probability of the target), key."""
    spark = df.sparkSession
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) != 0
    kind = F.max(F.when(F.col("quality") != 1, 2).when(toxic, 1).otherwise(0))
    fit = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_l")).agg(kind.alias("kind"))
    fit = cut(fit.orderBy(F.xxhash64(F.lit(8), "_l"), "_l").limit(LABELLED))
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(9), F.col(id_col), text).alias("h"), text.alias("text"))
    docs = docs.join(F.broadcast(fit), F.col("id") == F.col("_l"), "left").select("id", "h", "text", "kind")  # LABELLED rows at most
    kinds = "kind int, chunk int, counts binary"
    parts = docs.where("kind is not null").select("text", "kind").dropDuplicates().coalesce(COUNTERS).mapInArrow(_count, kinds)
    rows = parts.repartition(shuffle_partitions(spark), "kind", "chunk").mapInArrow(_sum, kinds).collect()  # a row for each of the fixed chunks
    orders = [Ratios([_counted(rows, 2 * k + o) for k in range(KINDS)]) for o in (0, 1)]
    good = bool(orders[0].counts[0].any())
    scored = cut(docs.mapInArrow(_weigh(orders), f"id {docs.schema['id'].dataType.simpleString()}, h long, r1 double, r2 double"))
    del rows, orders
    trim()
    n = {r.kind: r.n for r in fit.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # a row a kind
    shares = [n.get(k, 0) / sum(n.values()) for k in range(KINDS)] if good else [1.0, 0.0, 0.0]
    w = log_weight(shares)
    # a uniform draw from the row's hash, strictly between 0 and 1
    u = (F.shiftrightunsigned("h", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    scored = scored.select("id", "h", w.alias("log_weight"), (F.lit(shares[0]) * F.exp(w)).alias("target_share"), (w - F.log(-F.log(u))).alias("key"))
    k = scored.where(F.col("target_share") >= LEAST).count()
    return scored.where(F.col("key") >= float(kth_largest(scored, "key", k))).withColumnRenamed("id", id_col)


def keep_sampled(df: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``sample`` holds, all columns."""
    return keep_rows(df, sample, id_col, F.xxhash64(F.lit(9), F.col(id_col), F.col(text_col).cast("string")), "left_semi")
