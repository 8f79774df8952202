"""Token-ID output: fixed-width bit packing with block offsets.

Documents are dealt out by ranges of their id, so each task writes one file of its
own and files follow each other in ascending id order. A file holds, little-endian:

    "MTOK0001"  magic
    u32 bits, u32 ids of a block, u64 documents, u64 ids, u64 blocks
    u64[blocks + 1]      byte offsets of the blocks, from the start of the packed part
    i64[documents]       document ids (a null id is the least 64-bit number)
    u64[documents + 1]   first id of each document, within the file
    the packed part: each block holds its ids in ``bits`` bits each, the first id in
    the lowest bits, padded to whole bytes and at its end by 8 zero bytes

``bits`` is the least width that holds every id of the vocabulary. A block is
unpacked by a few vectorised numpy steps, and any range of ids touches the blocks
that hold it alone.

A file's name holds a random part, so a task that runs twice writes two files, and only
the one that the successful task reports is in the manifest. Files go through
pyarrow's file systems to the session's checkpoint folder or any other shared one.

Defined results: a null or empty text is the end id alone; equal ids stand in the
order of the lengths and then the hashes of their texts, a null first; equal rows may lie
in several files; null ids come first; other columns are ignored; an empty table gives no
file and no rows.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import cut, file_system, mix, shared_dir, shuffle_partitions, trimmed

MAGIC, HEAD, BLOCK_IDS = b"MTOK0001", struct.Struct("<8sIIQQQ"), 1 << 14
NULL_ID = -(2**63)
TASK_CHARS = 16_000_000  # text of one file, about
FILES = 16  # that one task reads, about
GROUP = 1024  # files whose lengths one task adds up
#: Pieces across which byte-level BPE never merges, for texts that are cut by no other rule: a word of letters before
#: white space, one of .,!|? or the end; another run without white space; white space but its last character; that
#: character. A word takes a space before it along.
PIECES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[\s.,!|?]|\Z)| ?\S+|\s+\Z|\s+(?=\s)|\s")
#: Characters that are white space here and not in the tokenizer, or may be; their texts are encoded whole.
ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
BYTES = 1 << 20  # of text whose pieces are told apart at once, about
CACHE = 1_000_000  # pieces that a worker keeps, the first ones it meets
RADIX = 0x9E3779B97F4A7C15  # odd, so it has an inverse among 64-bit numbers
LEAD = 0xC3  # the first byte of the characters from U+00C0 to U+00FF


def _classes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


BLANK, SPACE, STOP = _classes(b" \n"), _classes(b"\t\n\v\f\r \x1c\x1d\x1e\x1f"), _classes(b",.")
ALNUM = _classes(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


class Coder:
    """A tokenizer, and the ids of the pieces that a worker has met.

    With a byte-level tokenizer each distinct piece is encoded once. A text is cut before each space, comma and full stop
    and on both sides of a line end. Such a cut lies between two pre-tokens of the tokenizer where what is before it is no
    white space (before a space or line end) or is a letter of Latin-1 or a digit (before a comma or stop), and no white space
    follows a line end. Where a text has another cut, ``PIECES`` cuts it; a text with a special token's string or
    a character of ``ODD`` is encoded as it is. Pieces are found by a 64-bit hash, for all texts of a batch at once, and
    each is compared byte by byte with the kept piece of that hash, so a collision costs time and changes nothing.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = t = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if t.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        before = json.loads(t.to_str()).get("pre_tokenizer") or {}
        self.by_piece = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and t.normalizer is None
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.letters = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}  # byte-level BPE's letters for bytes
        self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes of the kept pieces
        # of each piece: where its bytes and its ids begin, and the end
        self.raw, self.raw_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ids_at = np.zeros(0, self.kind), np.zeros(1, np.int64)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _one(self, x: str) -> list[int]:
        if LETTERS.fullmatch(x, x[:1] == " "):  # one pre-token
            own = x.replace(" ", self.letters[32]) if x.isascii() else x.encode().decode("latin-1").translate(self.letters)
            return [y.id for y in self.t.model.tokenize(own)]
        return self.t.encode(x, add_special_tokens=False).ids

    def _whole(self, x: str) -> np.ndarray:
        return np.array(self.t.encode(x, add_special_tokens=False).ids, self.kind)

    def _cuts(self, texts: list[str], b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Where the pieces of the bytes ``b`` begin, and the texts that must be encoded whole."""
        cut = BLANK[b] | STOP[b]
        cut[1:] |= b[:-1] == 10
        cut[0] = False
        i = np.flatnonzero(cut)
        now, last, lead = b[i], b[i - 1], b[np.maximum(i - 2, 0)]
        latin = (last >= 128) & (lead == LEAD)
        bad = BLANK[now] & (SPACE[last] | (last >= 128) & ~latin)
        bad |= STOP[now] & ~(ALNUM[last] | latin & (last != 0x97) & (last != 0xB7))  # the signs of multiplication and division
        bad |= (last == 10) & (SPACE[now] | (now >= 128) & (now != LEAD))
        bad &= ~np.isin(i, first)
        exotic = np.flatnonzero((b >= 0xC2) & (b != LEAD) | (b >= 0x1C) & (b <= 0x1F))
        text_of = lambda at: set((np.searchsorted(first, at, "right") - 1).tolist())
        whole = {k for k in text_of(exotic) if ODD.search(texts[k])}
        whole |= {k for k, x in enumerate(texts) if any(s in x for s in self.special)}
        for k in text_of(i[bad]) - whole:
            cut[first[k] : first[k + 1]] = False
            cut[first[k] + np.cumsum([0, *(len(p.encode()) for p in PIECES.findall(texts[k]))][:-1])] = True
        cut[first[:-1][first[:-1] < len(b)]] = True
        return np.flatnonzero(cut), whole

    def _hashes(self, b: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        if len(self.power) < len(b):
            n = max(len(b), BYTES + BYTES // 2)
            for name, x in (("power", RADIX), ("inverse", pow(RADIX, -1, 1 << 64))):
                steps = np.full(n, np.uint64(x))
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(b.astype(np.uint64) + np.uint64(1)) * self.power[: len(b)])])
        return mix((total[at + size] - total[at]) * self.inverse[at] + size.astype(np.uint64))

    def _learn(self, pieces: list[bytes]) -> None:
        ids = [self._one(x.decode()) for x in pieces]
        grow = lambda at, new: np.concatenate([at, at[-1] + np.cumsum([len(x) for x in new])])
        self.raw, self.raw_at = np.concatenate([self.raw, np.frombuffer(b"".join(pieces), np.uint8)]), grow(self.raw_at, pieces)
        self.ids, self.ids_at = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), self.kind)]), grow(self.ids_at, ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the tokenizer alone gives them."""
        if not self.by_piece:
            return [self._whole(x) for x in texts]
        out: list[np.ndarray] = []
        held, n = [], 0
        for x in texts:
            held.append(x)
            n += len(x)
            if n >= BYTES:
                out += self._encode(held)
                held, n = [], 0
        return out + self._encode(held)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [x.encode() for x in texts]
        data = b"".join(raw)
        if not data:
            return [np.zeros(0, self.kind) for _ in texts]
        b = np.frombuffer(data, np.uint8)
        first = np.cumsum([0, *map(len, raw)])
        at, whole = self._cuts(texts, b, first)
        size = np.diff(at, append=len(b))
        uniq, place, which = np.unique(self._hashes(b, at, size), return_index=True, return_inverse=True)
        k = np.minimum(np.searchsorted(self.hash, uniq), len(self.hash) - 1) if len(self.hash) else np.zeros(len(uniq), np.int64)
        known = self.hash[k] == uniq if len(self.hash) else np.zeros(len(uniq), bool)
        kept = len(self.ids_at) - 1
        number = np.empty(len(uniq), np.int64)
        number[known] = self.number[k[known]]
        number[~known] = kept + np.arange(len(uniq) - known.sum())
        if len(new := place[~known]):
            self._learn([data[i : i + n] for i, n in zip(at[new].tolist(), size[new].tolist(), strict=True)])
        number = number[which]
        # each piece against the kept one of its hash
        same = self.raw_at[number + 1] - self.raw_at[number] == size
        own = np.repeat(self.raw_at[number] - at, size) + np.arange(len(b))
        differ = np.flatnonzero(self.raw[np.minimum(own, len(self.raw) - 1)] != b)
        if len(differ) or not same.all():
            whole |= set((np.searchsorted(first, np.concatenate([differ, at[~same]]), "right") - 1).tolist())
        n = self.ids_at[number + 1] - self.ids_at[number]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.ids_at[number] - ends[:-1], n)]
        out = np.split(ids, ends[np.searchsorted(at, first[1:-1])])
        for i in whole:
            out[i] = self._whole(texts[i])
        if kept + len(new) <= CACHE:
            order = np.searchsorted(self.hash, uniq[~known])
            self.hash, self.number = np.insert(self.hash, order, uniq[~known]), np.insert(self.number, order, kept + np.arange(len(new)))
        else:
            self.raw_at, self.ids_at = self.raw_at[: kept + 1].copy(), self.ids_at[: kept + 1].copy()
            self.raw, self.ids = self.raw[: self.raw_at[-1]].copy(), self.ids[: self.ids_at[-1]].copy()
        return out


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The worker's coder of a tokenizer's file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def vocab_bits(path: str) -> int:
    """The least number of bits that holds every id of the tokenizer."""
    return max(1, (max(coder(path).t.get_vocab(with_added_tokens=True).values())).bit_length())


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    return coder(path).encode(texts)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, low bits first, padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    x = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(x.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int, first: int = 0) -> np.ndarray:
    """``n`` ids from the ``first`` one of a block on. ``raw`` has 8 bytes or more after the last id."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    at = (first + np.arange(n, dtype=np.int64)) * bits
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    b = np.frombuffer(raw, np.uint8)
    x = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        x |= b[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((x >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def build(docs: list[int], ids: list[np.ndarray], bits: int) -> bytes:
    """A file's bytes."""
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = [pack(flat[i : i + BLOCK_IDS], bits) for i in range(0, len(flat), BLOCK_IDS)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = HEAD.pack(MAGIC, bits, BLOCK_IDS, len(docs), len(flat), len(blocks))
    return b"".join([head, offsets.tobytes(), np.array(docs, "<i8").tobytes(), first.tobytes(), *blocks, bytes(8)])


class TokenFile:
    """Random access to the ids of a file (an opened seekable source, or bytes)."""

    def __init__(self, source):
        self.source = pa.BufferReader(source) if isinstance(source, bytes) else source
        magic, self.bits, self.block, self.n_docs, self.n_ids, blocks = HEAD.unpack(self._read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        self.offsets = np.frombuffer(self._read(at, 8 * (blocks + 1)), "<u8").astype(np.int64)
        at += 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(self._read(at, 8 * self.n_docs), "<i8")
        at += 8 * self.n_docs
        self.first = np.frombuffer(self._read(at, 8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        self.data = at + 8 * (self.n_docs + 1)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, exclusive, from the blocks that hold them."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, np.uint32)
        lo, hi = start // self.block, (stop - 1) // self.block
        raw = self._read(self.data + int(self.offsets[lo]), int(self.offsets[hi + 1] - self.offsets[lo])) + bytes(8)
        out = []
        for k in range(lo, hi + 1):
            a, b = max(start, k * self.block), min(stop, (k + 1) * self.block)
            part = raw[int(self.offsets[k] - self.offsets[lo]) : int(self.offsets[k + 1] - self.offsets[lo]) + 8]
            out.append(unpack(part + bytes(8), b - a, self.bits, a - k * self.block))
        return np.concatenate(out)

    def doc(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        return self.ids(int(self.first[i]), int(self.first[i + 1]))


def _writer(folder: str, path: str, end_id: int, bits: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int] = []
        ids: list[np.ndarray] = []
        kind = np.dtype("<u2") if bits <= 16 else np.dtype("<u4")
        part = None
        for big in batches:
            for b in (big.slice(i, 1024) for i in range(0, big.num_rows, 1024)):
                part = b.column(2)[0].as_py()
                docs += [NULL_ID if x is None else x for x in b.column(0).to_pylist()]
                ids += [np.append(x.astype(kind, copy=False), kind.type(end_id)) for x in encode([t or "" for t in b.column(1).to_pylist()], path)]
        if docs:
            raw = build(docs, ids, bits)
            name = f"{folder}/{uuid.uuid4().hex}.mtok"
            where, at = file_system(name)
            where.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with where.open_output_stream(at) as f:
                f.write(raw)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(docs)], pa.int64()), pa.array([sum(map(len, ids))], pa.int64())], ["part", "file", "n_docs", "n_ids"])

    return run


def starts(made: DataFrame, n: int) -> DataFrame:
    """``made`` with start, the sum of n_ids of the parts before; no task adds up more than ``GROUP`` of the ``n`` parts."""
    out, size = made.withColumn("start", F.lit(0).cast("long")), 1
    while size < n:
        # sums of groups of ``size`` parts, and of those before them in the next larger group
        g = made.groupBy(F.floor(F.col("part") / size).cast("int").alias("g")).agg(F.sum("n_ids").alias("n"))
        before = Window.partitionBy(F.floor(F.col("g") / GROUP)).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
        g = g.select("g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b"))
        out = out.join(g, F.floor(F.col("part") / size).cast("int") == F.col("g")).withColumn("start", F.col("start") + F.col("b")).drop("g", "b")
        size *= GROUP
    return out


def write_tokens(df: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Writes the files and returns their manifest: part, file, n_docs, n_ids, start. Parts ascend as the ids do."""
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-chars // TASK_CHARS))
    order = [F.col("id").asc_nulls_first(), F.length("text"), F.xxhash64("text")]
    # the draw is the last key: it only parts equal rows, which stand for each other
    rows = docs.withColumn("draw", F.rand(5)).repartitionByRange(n, *order, "draw").drop("draw").sortWithinPartitions(*order, "text")
    made = cut(rows.withColumn("part", F.spark_partition_id()).mapInArrow(_writer(folder, path, end_id, vocab_bits(path)), "part int, file string, n_docs long, n_ids long"))
    return cut(starts(made, n))


@trimmed
def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _coders.clear()  # writing is over; later stages need the memory
    for b in batches:
        for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            where, at = file_system(name)
            with where.open_input_file(at) as f:
                t = TokenFile(f)
                for lo in range(0, t.n_docs, 1024):
                    hi = min(t.n_docs, lo + 1024)
                    ids = t.ids(int(t.first[lo]), int(t.first[hi])).astype("<u4")
                    cuts = t.first[lo : hi + 1] - t.first[lo]
                    crc = [zlib.crc32(ids[cuts[i] : cuts[i + 1]]) for i in range(hi - lo)]
                    own = pa.array(t.doc_ids[lo:hi], mask=t.doc_ids[lo:hi] == NULL_ID)
                    yield pa.RecordBatch.from_arrays([own, pa.array(t.first[lo:hi] + start), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    files = manifest.count()
    n = max(1, min(files, shuffle_partitions(manifest.sparkSession)), files // FILES)
    return manifest.select("file", "start", "part").repartition(n, "part").select("file", "start").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
