"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-grams.

The incidence matrix has a row for each distinct shingle set and a column for
each shingle. Its product with its own transpose holds the overlap counts; a pair
of rows links where 100 * overlap >= percent * union.

Rows that can reach the bound are brought together first: min-hash bands whose
number makes the chance that a pair at the threshold shares none smaller than
1e-15 (of the order of a 64-bit hash collision) give star edges from each row to
the smallest row of its bucket, and the connected components of these edges are the
diagonal blocks of the matrix outside of which no link lies. Each block, split into
pairs of sub-blocks of at most ``BLOCK`` rows, is multiplied in one task, column
chunk by column chunk; pairs whose sizes alone exclude a link are discarded before, those whose overlap is under the
bound that their sizes give after, and only a spanning forest of the links leaves the task.

Equal sets (copies) are one row from the start, so copies are never expanded.

Defined results: a null, empty or blank text has no shingles and links with
nothing; a text of fewer words than a shingle has one shingle, all its words; equal
rows and rows with equal ids are all returned; a row with a null id is returned with
a null component and links with nothing; a very long text is taken whole; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import Forest, Words, by_groups, components, cut, in_blocks, mix, release, shingles, trimmed

BLOCK = 512  # rows of a sub-block
MISS = 1e-15  # chance that the bands miss a pair at the threshold
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def bands(percent: int) -> tuple[int, int]:
    """Rows of a band and number of bands for a threshold in percent."""
    t = percent / 100
    rows = max(1, math.floor(math.log(0.4) / math.log(t))) if t < 1 else 8
    n = math.ceil(math.log(MISS) / math.log1p(-(t**rows))) if t < 1 else 1
    return rows, n


def _signatures(n: int, rows: int, number: int):
    odd = mix(np.arange(1, rows * number + 1, dtype=np.uint64)) | np.uint64(1)
    xor = mix(odd)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for big in batches:
            for b in (big.slice(i, 256) for i in range(0, big.num_rows, 256)):
                sets = [shingles(known.of(t), n) for t in b.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                keys = np.zeros((len(sets), number), np.uint64)
                fp = np.zeros((2, len(sets)), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    fp[0, full] = np.add.reduceat(flat, at)
                    fp[1, full] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
                    low = np.full((rows * number, len(full)), np.uint64(2**64 - 1))
                    # cache-sized pieces that end at a row's end
                    for lo, hi in _pieces(at, len(flat), 1 << 15):
                        part = flat[at[lo] : at[hi] if hi < len(at) else len(flat)]
                        cuts = at[lo:hi] - at[lo]
                        buf = np.empty_like(part)
                        for p in range(rows * number):
                            np.bitwise_xor(part, xor[p], out=buf)
                            np.multiply(buf, odd[p], out=buf)
                            low[p, lo:hi] = np.minimum.reduceat(buf, cuts)
                    low = low.reshape(number, rows, len(full))
                    k = np.arange(1, number + 1, dtype=np.uint64)[:, None] * np.ones(len(full), np.uint64)
                    for r in range(rows):
                        k = mix(k * np.uint64(0x9E3779B97F4A7C15) + low[:, r])
                    keys[full] = k.T
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(sizes),
                        pa.array(fp[0].view(np.int64)),
                        pa.array(fp[1].view(np.int64)),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), number).cast(pa.list_(pa.int64())),
                    ],
                    ["id", "n", "f1", "f2", "bands"],
                )

    return run


def _pieces(at: np.ndarray, total: int, most: int) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "left")))
        yield lo, hi
        lo = hi


def _sets(n: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for big in batches:
            for b in (big.slice(i, 256) for i in range(0, big.num_rows, 256)):
                sets = [shingles(known.of(t), n).tobytes() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["rep", "set"])

    return run


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between rows ``left`` and ``right`` of the incidence matrix, given as sorted sets.

    The product is accumulated over chunks of columns that two rows share at least.
    """
    rows = np.union1d(left, right)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([sets[i] for i in rows])
    who = np.repeat(rows, sizes[rows])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    start = np.flatnonzero(new)
    count = np.diff(np.concatenate([start, [len(flat)]]))
    keep = np.repeat(count > 1, count)
    col = np.cumsum(new[keep]) - 1 if keep.any() else np.zeros(0, np.int64)
    who = who[keep]
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    # a pair whose sizes are too far apart cannot link, whatever it shares
    close = (100 * sizes[left][:, None] >= percent * sizes[right][None, :]) & (100 * sizes[right][None, :] >= percent * sizes[left][:, None])
    if not close.any():
        return
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64  # counts stay exact
    total = np.zeros((len(left), len(right)), kind)
    step = 4096
    n_cols = int(col[-1]) + 1 if len(col) else 0
    edges = np.searchsorted(col, np.arange(0, n_cols + step, step))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi > lo:
            c, w = col[lo:hi] - col[lo], who[lo:hi]
            a = np.zeros((len(left), c[-1] + 1), kind)
            b = a if left is right else np.zeros((len(right), c[-1] + 1), kind)
            m = place_l[w] >= 0
            a[place_l[w[m]], c[m]] = 1
            if b is not a:
                m = place_r[w] >= 0
                b[place_r[w[m]], c[m]] = 1
            total += a @ b.T
    both = total.astype(np.int64)
    for i in range(len(left)):
        union = sizes[left[i]] + sizes[right] - both[i]
        hit = np.flatnonzero(close[i] & (100 * both[i] >= percent * union) & (union > 0))
        if len(hit):
            yield left[i], right[hit]


def _multiply(percent: int):
    def run(key: tuple, t: pa.Table) -> pa.Table | None:
        reps = t.column("rep").to_numpy()
        order = np.argsort(reps, kind="stable")
        reps, blk = reps[order], t.column("blk").to_numpy()[order]
        raw = t.column("set")
        sets = [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in order]
        left, right = np.flatnonzero(blk == key[1]), np.flatnonzero(blk == key[2])
        if not len(left) or not len(right) or len(reps) < 2:
            return None
        forest = Forest(len(reps))
        for i, hits in overlaps(sets, left, left if key[1] == key[2] else right, percent):
            for j in hits:
                forest.join(int(i), int(j))
        root = np.array([forest.find(i) for i in range(len(reps))])
        m = np.flatnonzero(root != np.arange(len(reps)))
        return pa.Table.from_arrays([pa.array(reps[m]), pa.array(reps[root[m]])], schema=EDGES) if len(m) else None

    return run


def ngram_jaccard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable by links) of each row of ``df``."""
    rows, number = bands(percent)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = cut(docs.mapInArrow(_signatures(n, rows, number), "id long, n long, f1 long, f2 long, bands array<long>"))
    reps = cut(sig.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")))
    # a bucket's rows go to its smallest row; no task holds a bucket: its least row comes from partial minima, and the join's parts may be split
    held = reps.select("rep", F.explode("bands").alias("key"))
    low = held.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b <> top").select("key", "b")
    blocks = components(held.join(low, "key").where("rep <> b").select(F.col("rep").alias("a"), "b"))
    members = cut(blocks.select(F.col("node").alias("rep"), F.col("component").alias("block")).union(blocks.select(F.col("component").alias("rep"), F.col("component").alias("block")).distinct()))
    release(df.sparkSession)
    dealt = in_blocks(members, "block", "rep", BLOCK)
    sets = docs.join(members.select(F.col("rep").alias("id")).hint("shuffle_hash"), "id", "left_semi")
    sets = sets.mapInArrow(_sets(n), "rep long, set binary")
    joined = sets.join(dealt.hint("shuffle_hash"), "rep").select("block", "bi", "bj", "blk", "rep", "set")
    edges = by_groups(joined, ["block", "bi", "bj"], _multiply(percent), "a long, b long", EDGES)
    found = components(edges)
    classes = cut(reps.select("n", "f1", "f2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component")))
    out = sig.drop("bands").join(classes, ["n", "f1", "f2"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    )
