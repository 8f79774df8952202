"""Helpers that the operators of this package share.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]`` of a text whose A-Z are
lower-cased.  On UTF-8 bytes that is exactly ``bytes.lower().split()``.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import sys
import tempfile
import time
import zipfile
from collections import defaultdict
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Lets the executors import this package where their path lacks it."""
    sc = spark.sparkContext
    on_path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT) in on_path or os.path.realpath(os.getcwd()) == str(ROOT) or getattr(sc, "_meridian_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(), "meridian.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in (ROOT / "meridian").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(out)
    sc._meridian_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set, a local session gets one of its own; a cluster must name one."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if not at.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        at = sc._jsc.sc().getCheckpointDir()
    return at.get()


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop URI, and the path in it. Hadoop's names of the S3 connector are those of ``s3:``."""
    scheme, sep, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if sep and scheme in ("s3a", "s3n") else uri)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark writes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and keeps it in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """``df``, written first if its rows come from a shuffle and so in any order whenever they are read again."""
    return cut(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


@contextlib.contextmanager
def steady_partitions(spark: SparkSession) -> Iterator[None]:
    """Holds the numbers from which scans are cut into partitions, which else follow the executors that are there."""
    names = ("spark.sql.files.minPartitionNum", "spark.sql.leafNodeDefaultParallelism")
    unset = [k for k in names if spark.conf.get(k, None) is None]
    now = str(spark.sparkContext.defaultParallelism)
    try:
        for k in unset:
            spark.conf.set(k, now)
        yield
    finally:
        for k in unset:
            spark.conf.unset(k)


def trimmed(fn):
    """``fn``, a function of batches, that gives a worker's freed memory back when a task is over."""

    @functools.wraps(fn)
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            trim()

    return run


def trim() -> None:
    """Gives this process's freed memory back."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def keep_rows(df: DataFrame, found: DataFrame, id_col: str, row_hash, how: str) -> DataFrame:
    """The rows of ``df`` that (left_semi) or not (left_anti) stand in ``found`` (id_col, h), by id and the hash of the row."""
    i, h, k = unused(df, "_i", "_h", "_k")
    known = found.select(F.col(id_col).alias(i), F.col("h").alias(h)).distinct()
    return df.withColumn(k, row_hash).join(known, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(k) == F.col(h)), how).drop(k)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that are no longer referred to, before more are written."""
    for _ in range(3):  # the first round frees what the next one finds
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Words:
    """Numbers the words of a batch and keeps one 64-bit hash of each."""

    def __init__(self, seed: int = 0, limit: int = 250_000):
        self.seed, self.limit = seed, limit
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.hashes = np.zeros(0, np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        """The hashes of the words of ``text``, in order."""
        w = words(text)
        if not w:
            return np.zeros(0, np.uint64)
        if len(self.ids) > self.limit:
            self._clear()
        ids = np.fromiter(map(self.ids.__getitem__, w), np.int64, len(w))
        if (n := len(self.ids)) > (have := len(self.hashes)):
            new = list(self.ids)[have:] if have * 4 < n else tail(self.ids, n - have)
            self.hashes = np.concatenate([self.hashes, np.fromiter((xxhash.xxh3_64_intdigest(x, self.seed) for x in new), np.uint64, n - have)])
        return self.hashes[ids]


def tail(d: dict, k: int) -> list:
    """The last ``k`` keys of a dict, in order."""
    it = reversed(d)
    out = [next(it) for _ in range(k)]
    out.reverse()
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; the whole sequence is one where there are fewer words."""
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of rows with equal ``keys`` of a partition that is sorted by them; one group at a time is held."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        start = 0
        for i in range(len(rows) + 1):
            if i < len(rows) and rows[i] == rows[start]:
                continue
            if held and rows[start] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = rows[start]
            held.append(b.slice(start, i - start))
            start = i
            if i == len(rows):
                break
    if held:
        yield key, pa.Table.from_batches(held)


def by_groups(df: DataFrame, keys: list[str], fn: Callable[[tuple, pa.Table], pa.Table | None], schema: str, fields: pa.Schema) -> DataFrame:
    """``fn`` of each group of rows with equal keys. Small groups cost little, as many pass in one batch."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for key, t in groups(batches, keys):
            out = fn(key, t)
            if out is not None and out.num_rows:
                held.append(out)
                n += out.num_rows
            if n >= 20_000:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, n = [], 0
        yield from (pa.concat_tables(held).combine_chunks() if held else fields.empty_table()).to_batches()

    n = shuffle_partitions(df.sparkSession)
    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def planes(x: np.ndarray) -> bytes:
    """The bytes of ``x``, the lowest of all numbers first and so on; the high ones, mostly zero, compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def in_blocks(members: DataFrame, key: str, unit: str, size: int) -> DataFrame:
    """Splits each group ``key`` into blocks of about ``size`` units and deals out all pairs of blocks.

    Adds ``bi`` and ``bj`` (the pair, bi <= bj) and ``blk`` (the unit's own block).
    A group of at most ``size`` units is one block. ``members`` must be cheap to
    read twice (a checkpoint).
    """
    sizes = cut(members.groupBy(key).count().where("count > 1").select(key, F.ceil(F.col("count") / size).cast("int").alias("nb")))
    b = members.join(sizes, key).withColumn("blk", F.pmod(F.xxhash64(F.lit(17), unit), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    return b.withColumn("o", other).withColumn("bi", F.least("blk", "o")).withColumn("bj", F.greatest("blk", "o")).drop("o", "nb")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b long): node, component (its smallest node).

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the
    edges stay as they are; the edges then are stars. Each step's minima and edges
    are checkpointed, so the joins' both sides are plain shuffles, which adaptive
    execution splits where one node has many of the edges.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        near = large.join(low, "a")
        e = cut(near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def say(*x: object) -> None:
    print(*x, file=sys.stderr, flush=True)
