"""LM scoring by a weighted backoff automaton.

The model is a trigram model, each order interpolated with the one below:

    p(w | g h) = (1 - k3(c(g h))) c(g h w) / c(g h) + k3(c(g h)) p(w | h)
    p(w | h)   = (1 - k2(c(h))) c(h w) / c(h) + k2(c(h)) p(w)
    p(w)       = (c(w) - d1) / N for a known word, d1 V / N for the one unknown word

Each order's share k(c) = d c**(b - 1) is what absolute discounting takes from a context of c occurrences and c**b
different continuations. The discount d = n1 / (n1 + 2 n2) follows from the numbers of n-grams seen once and
twice, and b is the power whose sum over all contexts gives the number of different n-grams, so all
parameters come from the counts of all training tokens. The distributions sum to one over the known words, the end
and the unknown word.

The automaton: the empty context, each word, the start and each pair of words are states. A state has an arc, with
weight log p, for each word seen after it, and a failure arc, with weight log k, to the state of its context
less the first word; the empty state has an arc for every word. A traversal reads a text from left to right; where a state
has no arc for a word it takes failure arcs until one has, and goes on from the longest context that is a
state. All parts of the texts of a block are traversed side by side, a step for all of them at a time. A long text goes
in parts: two words before a part lead to its state.

The automaton grows with the corpus, so no task holds all of it. A task reads its rows in blocks of about
``BLOCK_CHARS``. Each block asks the shards of the n-gram space, by sorted hashes, for the n-grams
that its documents hold and tells their training counts; each shard adds the counts up and answers; a block's
answers become a file in the shared folder. A second pass over the same rows reads the file of each block, builds the states
and arcs that its documents can reach, and traverses them. A block sends a row to a shard only where it has an n-gram
there, so messages number at most blocks times shards and never more than the blocks' different n-grams.

Hashes of words have 64 bits. Those of pairs and triples have ``SPARE`` bits more than it takes to number the bytes of all
texts (64 at most), so at every size an n-gram shares its hash with another with a chance below one in a million.

Both passes must cut the same blocks: rows that come from a shuffle are written first, the number of a scan's partitions does
not follow the number of executors meanwhile, and a block whose texts differ from those that asked ends the job with an error.

Defined results: a null or empty text is the end alone; a null id counts as the empty
text in the split; each row gives one row, so equal rows stay; a very long text is a block of its own and scored whole;
other columns are ignored; an empty table gives no rows; with no training tokens all probabilities are one (V is zero).
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import Words, by_groups, cut, file_system, mix, planes, remove, settled, shared_dir, steady_partitions, trimmed, unplanes

BLOCK_CHARS, SHARD_CHARS, PART, SPARE = 4_000_000, 4_000_000, 256, 20
END, START = np.uint64(0x0E4D), np.uint64(0x57A7)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.linspace(0, 1, 21)
ORDERS = ("uni", "bi", "tri")
ASK = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("mark", pa.int64()), *((f"{o}{x}", pa.binary()) for o in ORDERS for x in ("", "_n"))])
ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("mark", pa.int64()), *((f"{o}_n", pa.binary()) for o in ORDERS), ("stats", pa.list_(pa.float64()))])
STATS = pa.schema([("stats", pa.list_(pa.float64()))])
SCORED = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


@dataclass
class Block:
    """Some rows: ids, which train, and the hashes of their tokens, one text after the other."""

    number: int
    ids: list
    train: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def grams(self, bits: int) -> Iterator[np.ndarray]:
        """Hashes of the words, pairs and triples that end at each token. Before a text is its start; its first token ends no triple (0)."""
        less = lambda h: np.maximum(h >> np.uint64(64 - bits), np.uint64(1))
        before = np.concatenate([[START], self.tokens[:-1]])
        before[self.first] = START
        pairs = mix(before * FACTOR + self.tokens)
        yield self.tokens
        yield less(pairs)
        triples = less(mix(np.concatenate([[START], pairs[:-1]]) * FACTOR + self.tokens))
        triples[self.first] = 0
        yield triples

    def mark(self) -> int:
        return xxhash.xxh3_64_intdigest(self.tokens.tobytes() + self.sizes.tobytes() + self.train.tobytes()) >> 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The blocks of a task's rows (id, text, train)."""
    task, k, n = TaskContext.get().partitionId(), 0, 0
    known = Words(seed=4)
    ids, train, parts = [], [], []

    def block() -> Block:
        sizes = np.array([len(x) + 1 for x in parts], np.int64)
        return Block(task << 32 | k, ids, np.array(train, bool), np.concatenate([y for x in parts for y in (x, np.array([END]))]), sizes)

    for b in batches:
        for i, text, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ids.append(i)
            train.append(t)
            parts.append(known.of(text))
            n += len(text)
            if n >= BLOCK_CHARS:
                yield block()
                k, n, ids, train, parts = k + 1, 0, [], [], []
    if ids:
        yield block()


def _pack(x: np.ndarray) -> bytes:
    """The bytes of ``x`` by planes, compressed, behind their number; nothing for nothing."""
    return struct.pack("<q", x.nbytes) + pa.compress(planes(x), codec="lz4", asbytes=True) if len(x) else b""


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return unplanes(pa.decompress(raw[8:], struct.unpack("<q", raw[:8])[0], codec="lz4", asbytes=True) if raw else b"", kind)


def _shards(sorted_hashes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of hashes begins, and the end."""
    limits = np.array([(i << bits) // n for i in range(n)], np.uint64)
    return np.append(np.searchsorted(sorted_hashes, limits), len(sorted_hashes))


def _ask(n: int, bits: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            train, mark = np.repeat(block.train, block.sizes), block.mark()
            sides = []
            for order, h in enumerate(block.grams(bits)):
                uniq, at = np.unique(h, return_inverse=True)
                sides.append((uniq, np.bincount(at, weights=train, minlength=len(uniq)).astype(np.uint32), _shards(uniq, n, bits if order else 64)))
            del h, at, train
            for lo in range(0, n, 8):
                rows = []
                for s in range(lo, min(lo + 8, n)):
                    part = []
                    for uniq, count, cuts in sides:
                        u = uniq[cuts[s] : cuts[s + 1]]
                        part += [_pack(np.diff(u, prepend=np.uint64(0))), _pack(count[cuts[s] : cuts[s + 1]])]
                    if any(part):
                        rows.append((s, block.number, mark, *part))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ASK, strict=True)], schema=ASK)

    return run


def _answer(key: tuple, t: pa.Table) -> pa.Table:
    """The total counts that each block asks for, and a row (block below 0) of the shard's own sums."""
    found, stats, sums = [], [], []
    for what in ORDERS:
        keys = [np.cumsum(_unpack(x, "<u8")) for x in t.column(what).to_pylist()]
        counts = [_unpack(x, "<u4") for x in t.column(f"{what}_n").to_pylist()]
        uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(uniq)).astype(np.uint64)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        found.append([_pack(total[i]) for i in np.split(at, cuts)])
        seen = total[(total > 0) & (uniq > 0)]  # 0 is no triple
        stats += [float(seen.sum()), float(len(seen)), float((seen == 1).sum()), float((seen == 2).sum())]
        if what != "tri":
            sums += [float((seen.astype(np.float64) ** b).sum()) for b in POWERS]
    rows = [(b, key[0], m, *x, None) for b, m, *x in zip(t.column("block").to_pylist(), t.column("mark").to_pylist(), *found, strict=True)]
    rows.append((-1 - key[0], key[0], 0, b"", b"", b"", stats + sums))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ANSWER, strict=True)], schema=ANSWER)


def _store(folder: str):
    def run(key: tuple, t: pa.Table) -> pa.Table | None:
        """Writes a block's counts to its file. A task that runs again writes the same bytes under the same name."""
        if key[0] < 0:
            return t.select(["stats"])
        t = t.sort_by("shard")
        raw = [planes(np.concatenate([_unpack(x, "<u8") for x in t.column(f"{o}_n").to_pylist()])) for o in ORDERS]
        head = np.array([t.column("mark")[0].as_py(), *map(len, raw)], "<i8").tobytes()
        where, at = file_system(f"{folder}/{key[0]}")
        where.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with where.open_output_stream(own := f"{at}-{uuid.uuid4().hex}") as f:
            f.write(head + pa.compress(b"".join(raw), codec="zstd", asbytes=True))
        where.move(own, at)
        return None

    return run


def _counts(folder: str, block: Block) -> list[np.ndarray]:
    where, at = file_system(f"{folder}/{block.number}")
    with where.open_input_stream(at) as f:
        raw = f.read()
    mark, *sizes = np.frombuffer(raw, "<i8", 4).tolist()
    if mark != block.mark():
        raise RuntimeError("the rows of a block changed between two passes")
    raw = pa.decompress(raw[32:], sum(sizes), codec="zstd", asbytes=True)
    ends = np.cumsum([0, *sizes])
    return [unplanes(raw[a:b], "<u8").astype(np.float64) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def discount(n1: float, n2: float) -> float:
    """With no n-gram that was seen once, half."""
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


@dataclass(frozen=True)
class Model:
    """The parameters: training tokens, known words, and of each order its discount and (from the second on) its power."""

    n: int
    v: int
    d: tuple[float, float, float]
    b: tuple[float, float]

    @classmethod
    def fit(cls, stats: list[float]) -> Model:
        """From the sums of all shards: of each order its tokens, types, those seen once and twice; powers of counts of words and pairs."""
        orders = [stats[4 * i : 4 * i + 4] for i in range(3)]
        sums = [stats[12 : 12 + len(POWERS)], stats[12 + len(POWERS) :]]
        power = [float(np.interp(math.log(types), np.log(x), POWERS)) if types and min(x) > 0 else 1.0 for (_, types, _, _), x in zip(orders[1:], sums, strict=True)]
        return cls(int(orders[0][0]), int(orders[0][1]), tuple(round(discount(o[2], o[3]), 9) for o in orders), tuple(round(b, 9) for b in power))

    def word(self, c: np.ndarray) -> np.ndarray:
        if self.v <= 0 or self.n <= 0:
            return np.ones(len(c))
        return np.where(c > 0, (c - self.d[0]) / self.n, self.d[0] * self.v / self.n)

    def keep(self, c: np.ndarray, order: int) -> np.ndarray:
        """The weight of the failure arc of a context that was seen ``c`` times; one where it was not."""
        return np.where(c > 0, self.d[order - 1] * np.maximum(c, 1) ** (self.b[order - 2] - 1), 1.0)


class Automaton:
    """The states and arcs that the n-grams of some texts reach.

    States: 0 is the empty context, 1 + i the word i, 1 + W the start (W words), 2 + W + j the pair j.
    ``key`` are the arcs of all but the empty state, state * W + word, sorted.
    """

    def __init__(self, model: Model, c_word: np.ndarray, c_start: float, lead: np.ndarray, into: np.ndarray, c_pair: np.ndarray, pair: np.ndarray, last: np.ndarray, low: np.ndarray, c_triple: np.ndarray):
        """lead, into: a pair's context (a word, or W for the start) and word. pair, last, low: a triple's context, word, and the pair it ends with."""
        self.words = n = len(c_word)
        c_lead = np.append(c_word, c_start)
        k2, k3 = model.keep(c_lead, 2), model.keep(c_pair, 3)
        p1 = model.word(c_word)
        share = lambda c, of: np.divide(c, of, out=np.zeros(len(c)), where=of > 0)
        p2 = (1 - k2[lead]) * share(c_pair, c_lead[lead]) + k2[lead] * p1[into]
        two, three = np.flatnonzero(c_pair > 0), np.flatnonzero(c_triple > 0)
        of = pair[three]
        p3 = (1 - k3[of]) * share(c_triple[three], c_pair[of]) + k3[of] * p2[low[three]]
        with np.errstate(divide="ignore"):
            self.first = np.log10(p1)
            self.fail = np.log10(np.concatenate([[1.0], k2, k3]))
            weight = np.log10(np.concatenate([p2[two], p3]))
        self.back = np.concatenate([np.zeros(n + 2, np.int64), 1 + into])  # where the failure arcs go
        self.known = np.where(c_word > 0, 1 + np.arange(n), 0)  # the state behind an arc of the empty one
        key = np.concatenate([(1 + lead[two]) * n + into[two], (2 + n + of) * n + last[three]])
        order = np.argsort(key, kind="stable")
        self.key, self.weight = key[order], weight[order]
        self.to = np.concatenate([2 + n + two, 2 + n + low[three]])[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads one word in each state: the next states, and the weights of the arcs taken."""
        total, out = np.zeros(len(state)), np.empty(len(state), np.int64)
        lane = np.arange(len(state))
        while len(lane):
            root = state == 0
            if root.any():
                at = lane[root]
                w = word[root]
                total[at] += self.first[w]
                out[at] = self.known[w]
                lane, state, word = lane[~root], state[~root], word[~root]
            if not len(lane) or not len(self.key):
                if len(lane):
                    total[lane] += self.fail[state]
                    state = self.back[state]
                    continue
                break
            key = state * self.words + word
            i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            has = self.key[i] == key
            total[lane[has]] += self.weight[i[has]]
            out[lane[has]] = self.to[i[has]]
            lane, state, word = lane[~has], state[~has], word[~has]
            total[lane] += self.fail[state]
            state = self.back[state]
        return out, total

    def score(self, word: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sum of weights of each text, ``sizes`` words from ``first`` on."""
        n_parts = -(-sizes // PART)
        text = np.repeat(np.arange(len(sizes)), n_parts)
        k = np.arange(len(text)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        begin = first[text] + k * PART
        end = np.minimum(begin + PART, (first + sizes)[text])
        lead = np.where(k > 0, 2, 0)  # words that only lead to the part's state
        order = np.argsort(-(end - begin + lead), kind="stable")
        text, begin, end, lead = text[order], begin[order], end[order], lead[order]
        state = np.where(lead > 0, 0, 1 + self.words)
        total, at, length = np.zeros(len(text)), begin - lead, end - begin + lead
        for t in range(int(length[0]) if len(length) else 0):
            live = np.searchsorted(-length, -t, "left")  # longer than t
            state[:live], weight = self.step(state[:live], word[at[:live] + t])
            total[:live] += np.where(t >= lead[:live], weight, 0.0)
        return np.bincount(text, weights=total, minlength=len(sizes))


def _score(model: Model, folder: str, bits: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            c_word, c_pair, c_triple = _counts(folder, block)
            (words, word), (pairs, pair), (_, triple) = (np.unique(h, return_inverse=True) for h in block.grams(bits))
            first, end = block.first, int(np.searchsorted(words, END))
            if len(c_triple) and c_triple.size != triple.max() + 1:
                raise RuntimeError("a block's answers do not fit it")
            # the parts of each n-gram, from any place where it stands
            lead, into = np.empty(len(pairs), np.int64), np.empty(len(pairs), np.int64)
            before = np.concatenate([[len(words)], word[:-1]])
            before[first] = len(words)
            lead[pair], into[pair] = before, word
            inner = np.ones(len(word), bool)
            inner[first] = False
            of, last, low = (np.zeros(len(c_triple), np.int64) for _ in range(3))
            at = np.flatnonzero(inner)
            of[triple[at]], last[triple[at]], low[triple[at]] = pair[at - 1], word[at], pair[at]
            c_triple[triple[first]] = 0  # what stands for no triple
            auto = Automaton(model, c_word, c_word[end], lead, into, c_pair, of, last, low, c_triple)
            base = np.log10((c_word + 1) / (model.n + model.v + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.ids, pa.int64()),
                    pa.array(~block.train),
                    pa.array(block.sizes),
                    pa.array(np.add.reduceat((c_word > 0)[word].astype(np.int64), first)),
                    pa.array(np.add.reduceat(base[word], first)),
                    pa.array(auto.score(word, first, block.sizes)),
                ],
                schema=SCORED,
            )

    return run


def lm_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """Scores of all rows under a model of the rows outside of the held-out fold.

    id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, and mean_score, the score by token.
    """
    spark = df.sparkSession
    train = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % folds != fold
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = settled(docs.withColumn("train", train))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards, bits = max(1, math.ceil(size / SHARD_CHARS)), min(64, size.bit_length() + SPARE)
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    binary = lambda names: ", ".join(f"{x} binary" for x in names)
    with steady_partitions(spark):
        asked = docs.mapInArrow(_ask(n_shards, bits), f"shard int, block long, mark long, {binary(x for o in ORDERS for x in (o, o + '_n'))}")
        answers = by_groups(asked, ["shard"], _answer, f"block long, shard int, mark long, {binary(o + '_n' for o in ORDERS)}, stats array<double>", ANSWER)
        shards = cut(by_groups(answers, ["block"], _store(folder), "stats array<double>", STATS))
        sums = {r.pos: r.x for r in shards.select(F.posexplode("stats").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).collect()}  # a row for each sum
        model = Model.fit([sums.get(i, 0.0) for i in range(12 + 2 * len(POWERS))])
        out = cut(docs.mapInArrow(_score(model, folder, bits), "id long, held_out boolean, n_tokens long, n_known long, base double, score double"))
    remove(spark, folder)
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        (F.col("score") / F.col("n_tokens")).alias("mean_score"),
    )
