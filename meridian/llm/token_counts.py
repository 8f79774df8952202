"""Token counts by unigram segmentation with a trie that shares prefixes, under stand-in scores by rank.

A pre-token is a word ``[^\\x20\\x09-\\x0D]+`` behind the mark U+2581. Its tokens are the
segmentation into pieces of a public vocabulary with the largest sum of scores, with fewer tokens
on a tie. No public unigram vocabulary is at hand and none is trained, so the pieces of a public BPE vocabulary
stand in: a piece of rank r scores -ln(r + 1). A character in no chosen piece falls back to its UTF-8
bytes, each ``FALLBACK`` below the lowest piece.

The forward recurrence at a character needs the scores of the prefixes before it alone. So the
distinct pre-tokens of a task go into a trie, each node holds the best score and count of its
prefix and is computed once for all pre-tokens below it, and the counts where pre-tokens end
are kept, for the later tasks of a worker too. The trie is emptied when it reaches its bound, within a word
too, and the kept counts are the first ones, which costs time and changes nothing. No rows move between tasks.

Defined results: a null, empty or blank text has no words and no tokens; a very long word is segmented whole;
equal rows and ids each give a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, FALLBACK, NODES, KEPT = "▁", 10.0, 400_000, 400_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model, without its control and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return {p: -math.log(r + 1) for r, p in enumerate(dict.fromkeys(pieces))}


class Trie:
    """Nodes with the forward score and token count of their prefix."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.byte = min(scores.values(), default=0.0) - FALLBACK
        sizes: dict[str, set[int]] = {}
        for p in scores:
            sizes.setdefault(p[-2:], set()).add(len(p))
        # lengths of the pieces that end in two characters, or are one; ascending
        self.sizes = {k: tuple(sorted(v)) for k, v in sizes.items()}
        self.counts: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0.0], [0]

    def _step(self, word: str, d: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Score and count of the prefix of length ``d`` from those of the shorter ones."""
        c = word[d - 1]
        n = len(c.encode("utf-8", "surrogatepass"))
        top, count = best[d - 1] + n * self.byte, tokens[d - 1] + n
        scores = self.scores
        for size in (1, *self.sizes.get(word[max(0, d - 2) : d], ())) if d > 1 else (1,):
            if size > d:
                break
            s = scores.get(word[d - size : d])
            if s is not None:
                s += best[d - size]
                if s > top or (s == top and tokens[d - size] + 1 < count):
                    top, count = s, tokens[d - size] + 1
        return top, count

    def count(self, word: str) -> int:
        """Tokens of a pre-token, which has its mark."""
        found = self.counts.get(word)
        if found is not None:
            return found
        if len(self.best) > NODES:
            self._clear()
        best, tokens = [0.0], [0]
        node, follow, all_best, all_tokens = 0, self.next, self.best, self.tokens
        for d, c in enumerate(word, 1):
            to = follow.get((node, c))
            if to is None:
                b, t = self._step(word, d, best, tokens)
                if len(all_best) > NODES:  # the rest of the word hangs on a node that no other word meets
                    self._clear()
                    follow, all_best, all_tokens = self.next, self.best, self.tokens
                    node = -1
                to = follow[node, c] = len(all_best)
                all_best.append(b)
                all_tokens.append(t)
            node = to
            best.append(all_best[node])
            tokens.append(all_tokens[node])
        if len(self.counts) < KEPT:
            self.counts[word] = tokens[-1]
        return tokens[-1]


_tries: dict[str, Trie] = {}


def _trie(path: str) -> Trie:
    """The worker's trie of a vocabulary."""
    if path not in _tries:
        _tries[path] = Trie(vocabulary(path))
    return _tries[path]


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(path)
        get = trie.counts.get
        for big in batches:
            for b in (big.slice(i, 1024) for i in range(0, big.num_rows, 1024)):
                words = [WORD.findall(t) if t else [] for t in b.column(1).to_pylist()]
                new = sorted({w for x in words for w in x})
                local = {}
                for w in new:
                    m = MARK + w
                    n = get(m)
                    local[w] = trie.count(m) if n is None else n
                out = [sum(map(local.__getitem__, x)) for x in words]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array([len(x) for x in words], np.int64)), pa.array(np.array(out, np.int64))], ["id", "n_words", "n_tokens"])

    return run


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_tokens of each row."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_counter(path), f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
