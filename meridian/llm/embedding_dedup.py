"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

Each table turns a unit vector by three rounds of random signs and a fast Hadamard
transform and names the closest vertex of the cross-polytope; ``PARTS`` such names
make a bucket. A vector goes to its own bucket and, by multiprobe, to the next best
ones. Vectors of one label that meet in a bucket are compared by cosine in double
precision. A bucket of many vectors is split into pairs of blocks; a pair that meets
in several buckets is counted in the first of them alone, so a task sends back sums
and a spanning forest, never pairs. Equal vectors of one label are one row from the
start, with a weight. Vectors travel in the width of their table's numbers and codes in 32 bits
where they fit, and the pairs of many small buckets are compared in one step.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and vectors with a null label, link with nothing and keep
themselves; vectors of different lengths never link; rows with equal ids are each returned;
a row with a null id is returned with a null component; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import Forest, components, cut, in_blocks, shuffle_partitions, trimmed

TABLES, PARTS, PROBES, BLOCK, PORTION = 10, 2, 2, 256, 200_000
OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows of ``x``, whose length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def codes(unit: np.ndarray, tables: int = TABLES, parts: int = PARTS, probes: int = PROBES) -> np.ndarray:
    """Buckets of unit vectors: [row, table, own bucket and then the probed ones]."""
    dim = 1 << max(1, (unit.shape[1] - 1).bit_length())
    base = np.zeros((len(unit), dim))
    base[:, : unit.shape[1]] = unit
    out = np.zeros((len(unit), tables, 1 + probes), np.int64)
    rows = np.arange(len(unit))
    for t in range(tables):
        own = np.zeros(len(unit), np.int64)
        moves = []
        for p in range(parts):
            rng = np.random.default_rng([dim, t, p])
            x = base
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], dim))
            size = np.abs(x)
            best = np.argsort(-size, axis=1, kind="stable")[:, : probes + 1]
            name = 2 * best + (x[rows[:, None], best] < 0)
            gap = size[rows, best[:, 0]][:, None] - size[rows[:, None], best[:, 1:]]
            scale = (2 * dim) ** p
            own += name[:, 0] * scale
            moves.append((gap, (name[:, 1:] - name[:, :1]) * scale))
        gaps = np.concatenate([g for g, _ in moves], axis=1)
        steps = np.concatenate([s for _, s in moves], axis=1)
        nearest = np.argsort(gaps, axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = own
        out[:, t, 1:] = own[:, None] + steps[rows[:, None], nearest]
    return out


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of id, label, values (list of numbers, maybe null)."""
    for big in batches:
        for b in (big.slice(i, 4096) for i in range(0, big.num_rows, 4096)):
            col = b.column(2)
            n = b.num_rows
            sizes = np.array(col.value_lengths().fill_null(0))
            keys, raw = [None] * n, [None] * n
            for size in np.unique(sizes):
                if not size:
                    continue
                at = np.flatnonzero(sizes == size)
                part = col.take(pa.array(at))
                kind = "<f4" if pa.types.is_float32(col.type.value_type) else "<f8"
                x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
                with np.errstate(all="ignore"):
                    top = np.abs(x).max(axis=1)
                    good = np.isfinite(x).all(axis=1) & (top > 0)
                at, x, top = at[good], x[good], top[good]
                if not len(at):
                    continue
                unit = x / top[:, None]
                unit = unit / np.sqrt((unit * unit).sum(axis=1))[:, None]
                made = codes(unit)
                table = np.arange(TABLES, dtype=np.int64)[None, :, None]
                made = (made * TABLES + table).reshape(len(at), -1)
                for k, i in enumerate(at):
                    keys[i], raw[i] = made[k], x[k].astype(kind).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "label", "raw", "codes"])


def _pack_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The codes of each row as bytes, of 4 to a code where all of a row's fit."""
    for b in batches:
        codes = [np.array(x, np.int64) for x in b.column(4).to_pylist()]
        packed = [x.astype("<i4" if x.max(initial=0) < 1 << 31 else "<i8").tobytes() for x in codes]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(packed, pa.binary())], ["rep", "label", "raw", "weight", "codes"])


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a partition that is sorted by ``keys``, and the number of each row's group."""
    held: pa.Table | None = None
    for b in itertools.chain(batches, [None]):
        t = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if t is None or not t.num_rows:
            continue
        x = np.stack([t.column(k).to_numpy().astype(np.int64) for k in keys])
        group = np.concatenate([[0], np.cumsum((x[:, 1:] != x[:, :-1]).any(axis=0))])
        whole = t.num_rows if b is None else int(np.searchsorted(group, group[-1]))
        if whole:
            yield t.slice(0, whole).combine_chunks(), group[:whole]
        held = t.slice(whole) if b is not None else None


def _pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group, in portions."""
    end = np.searchsorted(group, group, "right")
    n = end - np.arange(len(group)) - 1
    lo = 0
    while lo < len(group):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(n[lo:]), PORTION, "right")) + lo)
        i = np.repeat(np.arange(lo, hi), n[lo:hi])
        first = np.cumsum(n[lo:hi]) - n[lo:hi]
        yield i, i + 1 + np.arange(len(i)) - np.repeat(first, n[lo:hi])
        lo = hi


def _compare(threshold: float, size: int, n_codes: int):
    kind = f"<f{size}"

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _whole_groups(batches, ["bucket", "bi", "bj"]):
            out = _links(t, group)
            if out is not None:
                yield out

    def _links(t: pa.Table, group: np.ndarray) -> pa.RecordBatch | None:
        rep, blk, bi, bj, weight, code = (t.column(c).to_numpy() for c in ("rep", "blk", "bi", "bj", "weight", "code"))
        label = t.column("label").combine_chunks().dictionary_encode()
        label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
        raw = [np.frombuffer(v, kind) for v in t.column("raw").to_pylist()]
        length = np.array([len(v) for v in raw])
        start = np.cumsum(length) - length
        flat = np.concatenate(raw).astype(np.float64)
        flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), start), length)
        flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, start)), length)
        keys = [np.frombuffer(v, f"<i{len(v) // n_codes}") for v in t.column("codes").to_pylist()]
        keys = np.stack(keys).astype(np.int64).reshape(len(rep), TABLES, -1)
        n, forest = np.zeros(len(rep), np.int64), Forest(len(rep))
        for i, j in _pairs(group):
            # in a pair of different blocks only rows of different blocks meet
            ok = (label[i] == label[j]) & (length[i] == length[j]) & ((blk[i] != blk[j]) | (bi[i] == bj[i]))
            i, j = i[ok], j[ok]
            for dim in np.unique(length[i]):
                same = np.flatnonzero(length[i] == dim)
                for lo in range(0, len(same), PORTION // 4):
                    a, b = i[same[lo : lo + PORTION // 4]], j[same[lo : lo + PORTION // 4]]
                    x, y = (flat[start[r][:, None] + np.arange(dim)] for r in (a, b))
                    near = np.einsum("ij,ij->i", x, y) >= threshold
                    a, b = a[near], b[near]
                    mine = np.zeros(len(a), bool)
                    for k in range(0, len(a), 50_000):
                        p, q = keys[a[k : k + 50_000]], keys[b[k : k + 50_000]]
                        meets = (p[:, :, :, None] == q[:, :, None, :]).any(axis=3)  # [pair, table, code of p]
                        table = meets.any(axis=2).argmax(axis=1)
                        r = np.arange(len(p))
                        met = np.where(meets[r, table], p[r, table], np.int64(2**62)).min(axis=1)
                        mine[k : k + 50_000] = met == code[a[k : k + 50_000]]
                    a, b = a[mine], b[mine]
                    np.add.at(n, a, weight[b])
                    np.add.at(n, b, weight[a])
                    for u, v in zip(a.tolist(), b.tolist(), strict=True):
                        forest.join(u, v)
        m = np.flatnonzero(n)
        if not len(m):
            return None
        root = np.array([forest.find(int(k)) for k in m])
        return pa.RecordBatch.from_arrays([pa.array(rep[m]), pa.array(rep[root]), pa.array(n[m])], schema=OUT)

    return run


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """id_col, n_links, component_id, kept of each row of ``df``."""
    single = df.schema[vector_col].dataType.simpleString() == "array<float>"
    vectors = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vectors.alias("v"))
    hashed = cut(rows.mapInArrow(_hash, f"id long, label {rows.schema['label'].dataType.simpleString()}, raw binary, codes array<long>"))
    reps = cut(hashed.where("id is not null and label is not null and raw is not null").groupBy("label", "raw").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("codes").alias("codes")))
    slim = cut(reps.select("rep", F.explode("codes").alias("code"), "label").withColumn("bucket", F.xxhash64("label", "code")))
    dealt = cut(in_blocks(slim, "bucket", "rep", BLOCK).select("rep", "code", "bucket", "bi", "bj", "blk"))
    small = reps.select("rep", "label", "raw", "weight", "codes").mapInArrow(_pack_codes, f"rep long, label {rows.schema['label'].dataType.simpleString()}, raw binary, weight long, codes binary")
    full = dealt.join(small, "rep").select("bucket", "bi", "bj", "blk", "code", "rep", "label", "raw", "weight", "codes")
    n = shuffle_partitions(df.sparkSession)
    cells = full.repartition(n, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    met = cut(cells.mapInArrow(_compare(threshold, 4 if single else 8, TABLES * (1 + PROBES)), "a long, b long, n long"))
    links = met.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    found = components(met.select("a", "b"))
    classes = cut(
        reps.drop("codes")
        .join(links, "rep", "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select("label", "raw", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    out = hashed.drop("codes").join(classes, ["label", "raw"], "left")
    own = F.col("id").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(own, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(own, F.coalesce("component", "id")).alias("component_id"),
        F.when(own, F.coalesce("component", "id") == F.col("id")).otherwise(F.lit(True)).alias("kept"),
    )
