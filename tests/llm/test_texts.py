import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from meridian.llm import lm_score, mixing, pii, token_counts, token_file
from meridian.llm.common import words

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts(docs, corpus):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.vocabulary(path)
    low = min(scores.values()) - token_counts.FALLBACK

    def brute(w):
        best = [(0.0, 0)]
        for d in range(1, len(w) + 1):
            n = len(w[d - 1].encode())
            ways = [(best[d - 1][0] + n * low, best[d - 1][1] - n)]
            ways += [(best[k][0] + scores[w[k:d]], best[k][1] - 1) for k in range(max(0, d - 40), d) if w[k:d] in scores]
            best.append(max(ways))
        return -best[-1][1]

    got = token_counts.token_counts(docs(corpus), path).collect()
    assert len(got) == len(corpus)
    memo = {}
    want = Counter()
    for i, t in corpus:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want[i, len(ws), sum(memo.setdefault(w, brute("▁" + w)) for w in ws)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_tokens) for r in got) == want


def test_trie_bounds(monkeypatch):
    scores = {"▁a": -1.0, "b": -2.0, "ab": -2.5, "▁ab": -2.9, "abab": -3.0}
    free = token_counts.Trie(scores)
    monkeypatch.setattr(token_counts, "NODES", 4)
    monkeypatch.setattr(token_counts, "KEPT", 2)
    tight = token_counts.Trie(scores)
    for w in ["▁abab", "▁ab", "▁bb", "▁ababab", "▁", "▁é"] * 2:
        assert free.count(w) == tight.count(w)


class PlainModel:
    """The trigram model in dictionaries, scored by recursion, without states."""

    def __init__(self, texts):
        self.c = [Counter(), Counter(), Counter()]
        for w in texts:
            seq = ["<s>", *w, None]
            self.c[0].update(seq[1:])
            self.c[1].update(zip(seq, seq[1:]))
            self.c[2].update(zip(seq, seq[1:], seq[2:]))
        self.n, self.v = sum(self.c[0].values()), len(self.c[0])
        n = [[sum(x == k for x in c.values()) for k in (1, 2)] for c in self.c]
        self.d = [min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5 for a, b in n]
        self.context = Counter({("<s>",): self.c[0][None]}) + Counter({(w,): k for w, k in self.c[0].items()})
        self.b = []
        for k in (0, 1):
            sums = [math.log(sum(x**g for x in self.c[k].values())) for g in np.linspace(0, 1, 21)]
            self.b.append(float(np.interp(math.log(len(self.c[k + 1])), sums, np.linspace(0, 1, 21))))

    def p(self, w, h):
        if not h:
            return (self.c[0][w] - self.d[0]) / self.n if w in self.c[0] else self.d[0] * self.v / self.n
        c = self.c[1][h] if len(h) == 2 else self.context[h]
        if not c:
            return self.p(w, h[1:])
        k = self.d[len(h)] * c ** (self.b[len(h) - 1] - 1)
        return (1 - k) * self.c[len(h)][(*h, w)] / c + k * self.p(w, h[1:])

    def score(self, words):
        seq = ["<s>", *words, None]
        return sum(math.log10(self.p(w, tuple(seq[max(0, i - 2) : i]))) for i, w in enumerate(seq) if i)


@pytest.mark.parametrize("part", [256, 5])
def test_lm_score(docs, corpus, monkeypatch, part):
    monkeypatch.setattr(lm_score, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(lm_score, "SHARD_CHARS", 50_000)
    monkeypatch.setattr(lm_score, "PART", part)
    ids = lambda i: "" if i is None else str(i)
    held = [zlib.crc32(ids(i).encode()) % 7 == 2 for i, _ in corpus]
    train = [words(t) for (_, t), h in zip(corpus, held, strict=True) if not h]
    count = Counter(w for t in train for w in [*t, None])
    n, v = sum(count.values()), len(count)
    model = PlainModel(train)
    want = Counter()
    for (i, t), h in zip(corpus, held, strict=True):
        seq = [*words(t), None]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in seq)
        want[i, h, len(seq), sum(count[w] > 0 for w in seq), n, round(base, 5), round(model.score(words(t)), 4)] += 1
    df = docs(corpus)
    for df in (df, df.repartition(5)):
        got = lm_score.lm_score(df).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 4)) for r in got) == want


def test_lm_automaton():
    texts = [b"a b a c".split(), b"a b".split(), b"d".split(), b"a b a c".split()]
    model = PlainModel(texts)
    for h in ((), ("<s>",), (b"a",), (b"a", b"b"), (b"b", b"a"), ("<s>", b"a")):
        assert abs(sum(model.p(w, h) for w in [b"a", b"b", b"c", b"d", None, b"new"]) - 1) < 1e-9


def test_lm_changed_rows(spark, tmp_path, monkeypatch):
    block = lm_score.Block(0, [1], np.array([True]), np.array([5, lm_score.END], np.uint64), np.array([2]))
    other = lm_score.Block(0, [1], np.array([True]), np.array([6, lm_score.END], np.uint64), np.array([2]))
    empty = lm_score._pack(np.ones(2, np.uint64))
    t = lm_score.pa.table({"block": [0], "shard": [0], "mark": [block.mark()], "uni_n": [empty], "bi_n": [empty], "tri_n": [empty]})
    lm_score._store(str(tmp_path))((0,), t)
    assert [len(x) for x in lm_score._counts(str(tmp_path), block)] == [2, 2, 2]
    with pytest.raises(RuntimeError):
        lm_score._counts(str(tmp_path), other)


def test_lm_empty(docs):
    assert lm_score.lm_score(docs([])).count() == 0


def test_encode_pieces():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rnd = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "foo", "'s", "it's", ".", ",", "!", "é", " é", " ", "1", "23", " <|endoftext|>", "\x1c", "\x85", "ß?", "中文", "🙂", "*", "**,", "x,y", "\n\n", "\n ", ".\n", "...", ".,", "_", "a.b", "\0", "\r\n", "\u3000"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(4000)]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in token_file.encode(texts, BPE)] == want


def test_starts(spark, monkeypatch):
    monkeypatch.setattr(token_file, "GROUP", 3)
    made = spark.createDataFrame([(p, p * p) for p in range(40) if p % 7], "part int, n_ids long")
    got = {r.part: r.start for r in token_file.starts(made, 40).collect()}
    assert got == {p: sum(q * q for q in range(p) if q % 7) for p in range(40) if p % 7}


def test_cache_bound(monkeypatch):
    monkeypatch.setattr(token_file, "CACHE", 50)
    c = token_file.Coder(BPE)
    rnd = random.Random(3)
    for _ in range(20):
        texts = [" ".join(f"w{rnd.randint(0, 60)}" for _ in range(9)) for _ in range(5)]
        assert [x.tolist() for x in c.encode(texts)] == [x.ids for x in c.t.encode_batch(texts, add_special_tokens=False)]
        assert len(c.hash) == len(c.number) == len(c.ids_at) - 1 == len(c.raw_at) - 1 <= 50 and (len(c.ids), len(c.raw)) == (c.ids_at[-1], c.raw_at[-1])


def test_hash_collisions(monkeypatch):
    c = token_file.Coder(BPE)
    monkeypatch.setattr(c, "_hashes", lambda b, at, size: size.astype(np.uint64) % np.uint64(3))
    texts = ["some words, of many. lengths", "", "and others that meet them", "some words"]
    for _ in range(2):
        assert [x.tolist() for x in c.encode(texts)] == [x.ids for x in c.t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 7, 8, 11, 16, 17, 24, 31, 32])
def test_packing(bits):
    x = np.random.default_rng(bits).integers(0, 2**bits, 40_000).astype(np.uint32)
    parts = np.split(x, [0, 5, 5, 17_000, 39_999])
    f = token_file.TokenFile(token_file.build(list(range(len(parts))), parts, bits))
    assert all((f.doc(i) == p).all() and len(f.doc(i)) == len(p) for i, p in enumerate(parts))
    for a, b in ((0, 40_000), (16_383, 16_385), (100, 100), (39_990, 50_000)):
        assert (f.ids(a, b) == x[a:b]).all()


def test_token_file(docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    got = token_file.read_tokens(token_file.write_tokens(docs(corpus), BPE)).orderBy("start").collect()
    order = sorted(corpus, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1] or "")))
    at = 0
    assert len(got) == len(order)
    for r, (i, text) in zip(got, order, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_file.read_tokens(token_file.write_tokens(docs([]), BPE)).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_against_expressions():
    rnd = random.Random(1)
    parts = ["0", "1", "25", "44", "@", "a", "b.c", ".", "-", "+", " ", "(", ")", "é", "\n", "http://", "token=", "4111111111111111", "_", "%", "12.3.4.5", "x@y.z", "password: "]
    cues = pii.automaton()
    for _ in range(8000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 18)))
        assert [x for x in pii.find(t, cues) if x[1] < 4] == base_spans(t), t


@pytest.mark.parametrize("text", ["0" * 5000 + "1.1.1.1", "1.1.1.1 " + "9" * 1_000_000, "1." * 500_000, "+1" + " (" * 500_000, "1 " * 500_000, "a@" * 500_000, "@" + "a." * 400_000, "token=" * 150_000, "password: " + "a" * 1_000_000, "account 1" + "A" * 1_000_000, "iban " * 200_000, "http://" * 150_000, "AKIA" * 250_000, "-----BEGIN " * 90_000, "." * 1_000_000 + "1"])
def test_pii_takes_linear_time(text):
    cues = pii.automaton()
    start = time.process_time()
    spans = pii.find(text, cues)
    assert time.process_time() - start < 8
    if len(text) < 10_000:
        assert [(s, pii.KINDS[k], e) for s, k, e in spans] == [(0, "ip", len(text))]


def test_pii_cues():
    cues = pii.automaton()
    kinds = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.find(t, cues)]
    assert kinds("my Api_Key = a1b2c3 x") == [("secret", "a1b2c3")]
    assert kinds("İ TOKEN: 9z") == [("secret", "9z")]
    assert kinds("AKIA" + "Q" * 16 + " xAKIA" + "Q" * 16 + " AKIAQ") == [("key", "AKIA" + "Q" * 16)]
    assert kinds("-----BEGIN RSA PRIVATE KEY----- -----BEGIN CERTIFICATE-----") == [("key", "-----BEGIN RSA PRIVATE KEY-----")]


def test_pii(docs, corpus):
    got = pii.digest(pii.find_pii(docs(corpus))).collect()
    want = Counter()
    for i, t in corpus:
        s = base_spans(t)
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in s)
        want[(i, *(sum(x[1] == k for x in s) for k in range(4)), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert pii.redact("to a@b.cd now", [("email", 3, 9)]) == "to [email] now"
    assert pii.digest(pii.find_pii(docs([]))).count() == 0


def brute_targets(sizes, weights):
    """Shares by weight of one and a half times all words; the excess over twice a source's words is dealt out again."""
    out, left, free = [0.0] * len(sizes), 1.5 * sum(sizes), [k for k, s in enumerate(sizes) if s]
    while free:
        w = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / w > 2 * sizes[k]]
        for k in over or free:
            out[k] = 2.0 * sizes[k] if over else left * weights[k] / w
        if not over:
            break
        left -= sum(out[k] for k in over)
        free = [k for k in free if k not in over]
    return out


def test_targets(spark):
    rnd = random.Random(6)
    for n in (0, 1, 4, 40):
        names = sorted({chr(rnd.choice([65, 97, 233, 20013, 65536]) + rnd.randint(0, 9)) + str(k) for k in range(n)}) + [None] * (n > 3)
        sizes = [rnd.choice([0, 1, 10, 100, 1000, 10_000]) for _ in names]
        want = dict(zip(names, brute_targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
        rows = list(zip(names, sizes, strict=True))
        rnd.shuffle(rows)
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * (1 + want[k]) for k in want)


@pytest.mark.parametrize("p", [[0.3] * 6, [0.5, 0.9, 0.2, 0.7, 0.4, 0.6], [0.05, 0.95, 0.5, 0.5, 0.5, 0.1]])
def test_documents_are_taken_with_their_probability(p):
    p, x = np.array(p), np.array([3.0, 7, 11, 20, 41, 90])
    taken = np.zeros(6)
    for seed in range(4000):
        rng = np.random.default_rng([1, seed])
        q = mixing.land(mixing.flight(p, x, rng), x, rng)
        assert set(q) <= {0, 1} and abs((q * x).sum() - (p * x).sum()) <= 90
        taken += q
    assert (abs(taken / 4000 - p) < 0.035).all(), taken / 4000


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    p, x = rng.random(500), rng.integers(1, 50, 500).astype(float)
    q = mixing.flight(p, x, rng)
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * x).sum() - (p * x).sum()) < 1e-4
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2


def test_mixing(docs, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 9)
    many = corpus + [(500 + k, "w " * (1 + k % 30)) for k in range(300)]
    df = docs(many, ["b", None, "a", "c"])
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(many)
    again = mixing.mix_sources(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken, str(r.source))
    assert sorted(got, key=key) == sorted(again, key=key)
    for s in ("a", "b", "c", None):
        part = [r for r in got if r.source == s]
        assert sum(r.size for r in part) == part[0].source_size
        assert all(0 <= r.taken <= 2 * r.size for r in part)
        assert abs(sum(r.taken for r in part) - part[0].target) <= max(r.size for r in part)  # one document may decide
    repeated = mixing.repeat_taken(df, mixing.mix_sources(df))
    assert repeated.columns == df.columns and repeated.count() == sum(r.copies for r in got)
    assert mixing.mix_sources(docs([])).count() == 0
