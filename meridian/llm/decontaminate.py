"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The words of a benchmark item (lower case, punctuation dropped) give its seeds, the
``SEED``-word n-grams. Passages meet items by any seed, however many documents hold it: the
words around the seeds that a document shares with an item are aligned with the item, local
alignment over words with ``MATCH``, ``MISMATCH`` and ``GAP``. The score is the alignment's part of
the item's own, so copies that are edited or paraphrased in part still score high. An alignment
is left out only where it cannot reach the bound: its score is at most ``MATCH`` times the item's
words that the passage holds.

Items go in blocks of at most ``BLOCK_WORDS`` words (a longer item is a block by itself), and only such a block,
never the benchmark, is sent to the tasks; each block makes its own pass over the corpus, which is not
shuffled. Seeds go by 64-bit hashes; where two n-grams shared one, the alignment decides. Seeds that are shared by thousands of documents cost each document its own
alignment and no more.

Where several places of a text reach an item's best score, the first is given; of equal alignments in it the one that
ends first in the item and then in the text.

Defined results: a very long text is read whole, each place by itself; null, empty and wordless texts and items match nothing; an item of fewer words
than a seed is its own seed; repeated items each match; each matching row of ``df``
gives a row for an item, so equal rows repeat; other columns are ignored; an empty
table on either side gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import cut, keep_rows, mix

SEED, MATCH, MISMATCH, GAP, LEAST = 3, 2, -1, -1, 0.5
BLOCK_WORDS, MEMO = 1_000_000, 32_000_000  # words of a block; bytes of alignments that a task keeps
PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
FOUND = "doc {0}, h long, item_id long, score double, first_word long, last_word long, n_seeds long"


def plain_words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(PUNCTUATION).split() if text else []


class Block:
    """Some items, their words' numbers (from 1) and their seeds' numbers."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.ids = [i for i, _ in items]
        numbers: dict[bytes, int] = {}
        self.words = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in ws], np.int64) for _, ws in items]
        self.numbers = numbers
        at = defaultdict(list)
        for k, w in enumerate(self.words):
            for pos, code in enumerate(self.codes(w, min(SEED, len(w))).tolist()):
                at[code].append((k, pos))
        self.seeds = np.array(sorted(at), np.uint64)
        self.places = [at[c] for c in self.seeds.tolist()]
        self.own = [np.bincount(w) for w in self.words]
        self.sizes = sorted({min(SEED, len(w)) for w in self.words if len(w)})

    def codes(self, w: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n-grams; 0 where a word is in no item."""
        if n <= 0 or len(w) < n:
            return np.zeros(0, np.uint64)
        out = np.full(len(w) - n + 1, np.uint64(n))
        known = np.ones(len(out), bool)
        for i in range(n):
            part = w[i : len(w) - n + 1 + i]
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
            known &= part > 0
        return np.where(known, out | np.uint64(1), np.uint64(0))

    def hits(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A text's words as numbers (0: in no item), and the places and seeds of its seeds."""
        ws = plain_words(text)
        w = np.fromiter((self.numbers.get(x, 0) for x in ws), np.int64, len(ws))
        pos, seed = [], []
        for n in self.sizes:
            c = self.codes(w, n)
            at = np.flatnonzero(c)
            if len(at) and len(self.seeds):
                k = np.minimum(np.searchsorted(self.seeds, c[at]), len(self.seeds) - 1)
                ok = self.seeds[k] == c[at]
                pos.append(at[ok])
                seed.append(k[ok])
        if not pos:
            return w, np.zeros(0, np.int64), np.zeros(0, np.int64)
        return w, np.concatenate(pos), np.concatenate(seed)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score, and the place in ``text`` where it ends (exclusive)."""
    n = np.arange(len(text) + 1) * -GAP
    row = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item.tolist():
        t = np.zeros(len(text) + 1, np.int64)
        t[1:] = np.maximum(row[:-1] + np.where(text == w, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(t, 0, out=t)
        row = np.maximum.accumulate(t + n) - n  # gaps along the row
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def matches(block: Block, text: str | None, least: float, memo: dict) -> list[tuple]:
    """(item, score, first word, last word, seeds) of the items that a text holds."""
    w, pos, seed = block.hits(text)
    if not len(pos):
        return []
    by_item = defaultdict(list)
    for p, s in zip(pos.tolist(), seed.tolist(), strict=True):
        for k, offset in block.places[s]:
            by_item[k].append((p, offset))
    held = np.zeros(len(block.numbers) + 1, bool)
    held[w] = True
    held[0] = False
    out = []
    for k, at in by_item.items():
        item = block.words[k]
        if np.count_nonzero(held[item]) < least * len(item):
            continue
        at.sort()
        best = None
        lo = 0
        while lo < len(at):
            hi = lo + 1
            while hi < len(at) and at[hi][0] - at[hi - 1][0] <= len(item):
                hi += 1
            near = at[lo:hi]
            pad = len(item) // 2 + 2
            first = max(0, min(p - o for p, o in near) - pad)
            last = min(len(w), max(p - o for p, o in near) + len(item) + pad)
            part = w[first:last]
            key = (k, part.tobytes())
            if key not in memo:
                if memo.get("bytes", 0) > MEMO:
                    memo.clear()
                memo["bytes"] = memo.get("bytes", 0) + part.nbytes + 200
                own = block.own[k]
                both = np.minimum(own, np.bincount(part[part < len(own)], minlength=len(own)))[1:].sum()
                score, end = align(item, part) if both >= least * len(item) else (0, 0)
                begin = end - align(item[::-1], part[:end][::-1])[1] if score >= least * MATCH * len(item) else 0
                memo[key] = (score, begin, end)
            score, begin, end = memo[key]
            if best is None or score > best[0]:
                best = (score, first + begin, first + end, len(near))
            lo = hi
        if best and best[0] >= least * MATCH * len(item):
            out.append((block.ids[k], best[0] / (MATCH * len(item)), best[1], best[2], best[3]))
    return out


def _find(block: Block, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for big in batches:
            for b in (big.slice(i, 1024) for i in range(0, big.num_rows, 1024)):
                rows = [(i, *m) for i, t in enumerate(b.column("text").to_pylist()) for m in matches(block, t, least, memo)]
                at = pa.array([r[0] for r in rows], pa.int64())
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc").take(at), b.column("h").take(at), *(pa.array([r[k + 1] for r in rows], kind) for k, kind in enumerate(kinds))],
                    ["doc", "h", "item_id", "score", "first_word", "last_word", "n_seeds"],
                )

    return run


def _blocks(items: DataFrame) -> Iterator[Block]:
    held, n = [], 0
    for i, text in items.toLocalIterator():
        w = plain_words(text)
        if not w:
            continue
        if held and n + len(w) > BLOCK_WORDS:
            yield Block(held)
            held, n = [], 0
        held.append((i, w))
        n += len(w)
    if held:
        yield Block(held)


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """id_col, h (a hash of the row), item_id, score, first_word, last_word, n_seeds of each row and item that match."""
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).alias("doc"), F.xxhash64(F.lit(9), F.col(id_col), text).alias("h"), text.alias("text"))
    schema = FOUND.format(docs.schema["doc"].dataType.simpleString())
    out = df.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")):
        found = docs.mapInArrow(_find(block, least), schema)
        out = out.union(cut(found))
    return out.withColumnRenamed("doc", id_col)


def keep_clean(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without a match, all columns."""
    return keep_rows(df, found, id_col, F.xxhash64(F.lit(9), F.col(id_col), F.col(text_col).cast("string")), "left_anti")
