import html
import math
import pickle
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from meridian.llm import decontaminate, quality, warc


def passages(rnd, n, vocab, size):
    return [" ".join(rnd.choice(vocab) for _ in range(size)) for _ in range(n)]


def labelled(spark, docs, extra=()):
    rnd = random.Random(4)
    good, bad = [f"good{i}" for i in range(60)], [f"junk{i}" for i in range(60)]
    texts = [(i, t) for i, t in enumerate(passages(rnd, 240, good, 60) + passages(rnd, 60, bad, 60))]
    labels = [(i, int(i < 240), 0) for i in range(0, 300, 3)] + [(None, 1, 0), (5, None, 1)]
    return docs(texts + list(extra)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def brute_sample(rows, labels, hashes):
    """Rows' keys and the sample, by plain loops over the whole formula. ``hashes``: of each row, as the query has them."""
    feats = []
    for _, t in rows:
        w = quality.Words(seed=8).of(t)
        feats.append([Counter(x.tolist()) for x in quality.features(w)])
    kinds = {}
    for i, q, t in labels:
        if i is not None and q is not None:
            kinds[i] = max(kinds.get(i, 0), 2 if q != 1 else int(bool(t)))
    counts = [[Counter(), Counter()] for _ in range(3)]
    for t, k in {(t, kinds[i]) for i, t in rows if i in kinds}:
        f = next(f for (_, u), f in zip(rows, feats, strict=True) if u == t)
        for o in (0, 1):
            counts[k][o].update(f[o])
    total = [[sum(c.values()) for c in k] for k in counts]

    def ratio(k, o, n, g):
        share = total[k][o] / total[0][o]
        r = math.log((n + quality.ADD) / (g * share + quality.ADD))
        error = math.sqrt((1 + share) / (n + g + quality.ADD) * (1 / share + 1))
        return math.copysign(max(0, abs(r) - quality.EFFECT - quality.SURE * error), r)

    logs = []
    for (i, _), f in zip(rows, feats, strict=True):
        own = kinds.get(i)
        less = lambda k, o, b: counts[k][o][b] - (f[o][b] if own == k else 0)  # noqa: B023, E731
        logs.append([sum(c * ratio(k, o, less(k, o, b), less(0, o, b)) for o in (0, 1) for b, c in f[o].items()) for k in (1, 2)])
    shares = [sum(k == x for k in kinds.values()) / len(kinds) for x in range(3)]
    weight = [-math.log(sum(s * math.exp(min(600, x)) for s, x in zip(shares, [0, *r], strict=True))) for r in logs]
    noise = [-math.log(-math.log(((h % 2**64 >> 11) + 0.5) / 2**53)) for h in hashes]
    k = sum(shares[0] * math.exp(w) >= quality.LEAST for w in weight)
    key = [w + g for w, g in zip(weight, noise, strict=True)]
    return weight, key, sorted(range(len(rows)), key=lambda i: -key[i])[:k], sorted(range(len(rows)), key=lambda i: -weight[i])[:k]


def test_quality_against_loops(spark, docs):
    from pyspark.sql import functions as F

    rnd = random.Random(12)
    vocab = [f"v{i}" for i in range(50)]
    rows = []
    for i in range(400):
        w = rnd.choices(vocab, k=rnd.randint(1, 40))
        if i % 4 == 1:  # toxic words, few in some rows
            w = [x if rnd.random() > (0.02 if i % 8 == 1 else 0.3) else "insult" for x in w]
        elif i % 4 == 2:
            w = [x for x in w[:8] for _ in range(3)]
        rows.append((i, " ".join(w)))
    rows[7] = (7, rows[4][1])  # a copy
    labels = [(i, int(i % 4 != 2), int(i % 4 == 1)) for i in range(0, 400) if i % 3]
    df = docs(rows)
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(9), "doc_id", "text").alias("h")).collect()}
    weight, key, sample, top = brute_sample(rows, labels, [hashes[i] for i, _ in rows])
    got = {r.doc_id: r for r in quality.resample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert set(got) == set(sample)
    assert all(abs(got[i].log_weight - weight[i]) < 1e-3 * (1 + abs(weight[i])) and abs(got[i].key - key[i]) < 1e-3 * (1 + abs(key[i])) for i in got)
    assert set(sample) != set(top)  # the draws decide among close weights
    clean = [i for i in range(400) if i % 4 in (0, 3)]
    assert len(set(clean) & set(got)) > 0.9 * len(clean) and not {i for i in got if i % 4 == 2 and len(rows[i][1].split()) > 8}


def test_quality(spark, docs):
    df, labels = labelled(spark, docs, [(1000, None), (1001, ""), (None, "good1 good2"), (7, "junk1 " * 20), (1002, "good3 good4 " * 50_000), (1003, "same words"), (1003, "same words")])
    out = quality.resample(df, labels)
    kept = {r.doc_id for r in out.collect()}
    assert len(kept & set(range(240))) >= 230 and not kept & set(range(240, 300))
    assert {1000, 1001, 1002} <= kept and out.where("doc_id = 1003").count() in (0, 2)
    rows = quality.keep_sampled(df, out)
    assert rows.columns == df.columns and rows.where("text like 'junk%'").count() == 0
    same = lambda x: sorted((r.doc_id or -1, r.h, round(r.key, 9)) for r in x.collect())
    assert same(out) == same(quality.resample(df.repartition(3), labels))
    assert quality.resample(docs([]), labels).count() == 0
    assert quality.resample(df, labels.where("false")).count() == df.count()
    assert quality.resample(df, labels.where("quality = 1")).count() == df.count()
    assert quality.resample(df, labels.where("quality = 0")).count() == df.count()


def test_what_quality_sends_through_the_driver_is_small():
    texts = pa.RecordBatch.from_arrays([pa.array(["a b c a", "d e", None] * 50), pa.array([0, 1, 2] * 50, pa.int32())], ["text", "kind"])
    rows = list(quality._sum(quality._count([texts])))
    assert sum(b.nbytes for b in rows) < 1 << 20
    rng = np.random.default_rng(8)
    counts = [np.zeros(quality.BUCKETS, np.int64) for _ in range(quality.KINDS)]
    for c in counts:
        c[rng.integers(0, quality.BUCKETS, 3000)] = rng.integers(1, 500, 3000)
    r = quality.Ratios(counts)
    raw = pickle.dumps(r)
    assert len(raw) < 1 << 20
    got = pickle.loads(raw)
    assert got.share == r.share and all(np.array_equal(a, b) for have in ("counts", "table") for a, b in zip(getattr(got, have), getattr(r, have), strict=True))
    for k in range(1, quality.KINDS):
        assert np.array_equal(r.table[k], r.raw(k, counts[k], counts[0]).astype(np.float32))


def test_kth_largest(spark):
    rnd = random.Random(0)
    x = [rnd.gauss(0, 1) for _ in range(3000)] + [0.5] * 100
    df = spark.createDataFrame([(v,) for v in x], "v double")
    for k in (1, 2, 500, 1000, 3100):
        assert quality.kth_largest(df, "v", k) == sorted(x, reverse=True)[k - 1]


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    import numpy as np

    rnd = random.Random(9)
    for _ in range(60):
        a, b = ([rnd.randint(1, 4) for _ in range(rnd.randint(1, 15))] for _ in range(2))
        assert decontaminate.align(np.array(a), np.array(b))[0] == brute_align(a, b)


@pytest.mark.parametrize("block", [300_000, 30])
def test_decontaminate(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rnd = random.Random(2)
    vocab = [f"v{i}" for i in range(400)]
    items = passages(rnd, 6, vocab, 24)
    edited = items[1].split()
    for k in (4, 13, 20):
        edited[k] = "other"
    del edited[9]
    texts = [(k, t) for k, t in enumerate(passages(rnd, 40, vocab, 80))]
    texts += [(100, "x y " + items[0].upper().replace(" ", ", ") + " z"), (101, "q " * 50 + " ".join(edited) + " r s"), (102, None), (103, ""), (104, " ".join(items[2].split()[:6]))]
    texts += [(200 + k, f"common {items[3]} tail{k}") for k in range(30)] + [(None, items[4])]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(90, None), (91, " "), (92, "solo")], "item_id long, text string")
    df = docs(texts)
    found = decontaminate.contaminated(df, bench)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == {(100, 0), (101, 1), (None, 4)} | {(200 + k, 3) for k in range(30)}
    clean = decontaminate.keep_clean(df, found)
    assert clean.columns == df.columns and clean.count() == len(texts) - 33
    assert decontaminate.contaminated(docs([]), bench).count() == 0
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0


def test_decontaminate_against_all_alignments(spark, docs, monkeypatch):
    """Every text against every item by the plain alignment, over texts that are all near the item."""
    rnd = random.Random(21)
    vocab = [f"v{i}" for i in range(25)]
    items = passages(rnd, 8, vocab, 12) + ["v1 v2", "v1 v2", "solo"]
    texts = []
    for k in range(120):
        w = items[k % 8].split()
        for _ in range(k % 7):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        texts.append((k, " ".join(rnd.choices(vocab, k=3) + w + rnd.choices(vocab, k=3))))
    texts += [(500, " ".join(["v24 v23"] * 100_000 + [items[0]] + ["x"] * 50_000 + [items[0]])), (501, "v1 v2 x v1 v2"), (501, "v1 v2 x v1 v2")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated(docs(texts), bench).collect()
    score = {(r.doc_id, r.item_id): r.score for r in got}
    for i, t in texts:
        if i == 500:
            continue
        for j, item in enumerate(items):
            a, b = item.split(), t.split()
            n = min(3, len(a))
            seeds = {tuple(a[x : x + n]) for x in range(len(a) - n + 1)} & {tuple(b[x : x + n]) for x in range(len(b) - n + 1)}
            want = brute_align(a, b) / (2 * len(a)) if seeds else 0
            assert score.get((i, j), 0) == (want if want >= 0.5 else 0), (i, j)
    assert [(r.first_word, r.last_word) for r in got if (r.doc_id, r.item_id) == (500, 0)] == [(200_000, 200_012)]
    assert [(r.first_word, r.last_word) for r in got if r.doc_id == 501 and r.item_id in (8, 9)] == [(0, 2)] * 4


@pytest.mark.parametrize("copies", [5, 1000])
@pytest.mark.parametrize("step", [4, 5])
def test_decontaminate_edit_held_by_many(spark, docs, copies, step):
    rnd = random.Random(7)
    (item, other) = passages(rnd, 2, [f"v{i}" for i in range(400)], 40)
    edited = " ".join("other" if k % step == step - 1 else x for k, x in enumerate(item.split()))
    texts = [(k, f"a{k} b{k} {edited} c{k}") for k in range(copies)] + [(5000, item), (5001, "some " + " ".join(item.split()[:4])), (5002, "clean text")]
    bench = spark.createDataFrame([(0, item), (1, other)], "item_id long, text string")
    found = decontaminate.contaminated(docs(texts), bench)
    rows = found.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(k, 0) for k in range(copies)} | {(5000, 0)}
    want = brute_align(item.split(), edited.split()) / 80
    assert all(abs(r.score - (1 if r.doc_id == 5000 else want)) < 1e-12 for r in rows)
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs(texts), found).collect()) == [5001, 5002]


def test_warc_round_trip(spark):
    page = "<html><head><title>A &amp; B</title><script>no</script></head><body><!-- x --><p>one<br>two&lt;3</p><a href='/l?a=1&amp;b=2'>link</a></body></html>"
    rows = [(1, "http://e.org/a", page, "q"), (2, None, None, "q"), (3, "http://e.org/b\r\nX: y", "", "q"), (4, "http://e.org/c", "<p>" + "x" * 200_000, "q"), (1, "http://e.org/a", page, "q"), (None, "u", "plain", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    got = warc.derivatives(df)
    out = got.collect()
    assert len(out) == 2 * len(rows)
    by = {(r.page_id, r.record_type): r for r in out}
    meta, text = by[1, "metadata"], by[1, "conversion"]
    assert text.block == "A & B\none\ntwo<3\nlink" and text.refers_to == meta.refers_to and text.concurrent_to == meta.record_id
    headers, block = next(warc.parse(warc.response(1, "http://e.org/a", page)))
    assert text.refers_to == headers["warc-record-id"] and text.source_payload_digest == headers["warc-payload-digest"] == warc.digest(warc.split_http(block)[1])
    assert f"conversion: {text.record_id}" in meta.block and "outlink: /l?a=1&b=2" in meta.block and "title: A & B" in meta.block
    assert by[2, "conversion"].block == "" and by[2, "conversion"].target_uri is None
    manifest = warc.write_warc(got)
    assert sum(r.n_records for r in manifest.collect()) == len(out)
    read = [x for r in manifest.collect() for x in warc.parse(open(r.file.removeprefix("file:"), "rb").read())]
    assert sorted(h["warc-record-id"] for h, _ in read) == sorted(r.record_id for r in out)
    assert all(warc.digest(b) == h["warc-block-digest"] for h, b in read)
    assert warc.derivatives(df.where("false")).count() == 0


OLD_DROP = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<[!?][^>]*>", re.S | re.I)
OLD_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|title|tr|ul)\b[^>]*>", re.I)
OLD_TAG = re.compile(r"</?[a-zA-Z][^>]*>")


def expression_text(page):
    """The text of a well-formed page without ``>`` in values, by expressions."""
    lines = (" ".join(x.split()) for x in html.unescape(OLD_TAG.sub("", OLD_BREAK.sub("\n", OLD_DROP.sub("", page)))).split("\n"))
    return "\n".join(x for x in lines if x)


def test_pages_against_expressions(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        assert warc.Page(r.html or "").text == expression_text(r.html or "")
    rnd = random.Random(8)

    def element(depth):
        if not depth or rnd.random() < 0.3:
            return rnd.choice(["text ", "a &amp; b", "1 < 2 ", "<!-- no <p> -->", "<script a='b'>if (a<b) x</script>", "<STYLE>p{}</style >", "<br/>", "<?xml x?>", "\n"])
        name = rnd.choice(["p", "DIV", "span", "b", "li", "title", "section"])
        return f"<{name} class=\"x y\" id='z'>" + "".join(element(depth - 1) for _ in range(rnd.randint(0, 3))) + f"</{name}>"

    for _ in range(500):
        page = "".join(element(4) for _ in range(3))
        assert warc.Page(page).text == expression_text(page), page


def test_odd_pages():
    page = warc.Page("<title>A > B &lt; <b>C</b></title><a title=\"x>y\" href='/1>2'>one</a><A HREF=/two>2</A><a data-href=no>n</a><p title=\"no end>text</p> <script>kept <!-- kept too <i")
    assert page.title == "A > B < C" and page.links == ["/1>2", "/two"]
    assert page.text.split("\n") == ["A > B < C", "one2n", "text", "kept kept too <i"]
    assert warc.Page("<a x=\"> <b> <i>\" tail").text == "\" tail"
    assert warc.Page("").text == "" and warc.Page("<").text == "<" and warc.Page("a <b").text == "a <b"


@pytest.mark.parametrize("part", ["<script>", "<!--", "<a ", "<a href=\"", "<a x=\">", "<a x='\">", "<title>", "</title", "<style ", "<", "<!", "<p a='b' ", "<a href=\"'>\" ", "=\"<a>"])
def test_pages_take_linear_time(part):
    start = time.process_time()
    warc.Page(part * (1_000_000 // len(part)))
    warc.Page("<p " + part[1:].replace(">", "") * (1_000_000 // len(part)) + ">")
    assert time.process_time() - start < 8


def test_derive_files(spark, tmp_path):
    import gzip

    raw = b"".join(gzip.compress(warc.response(k, f"http://e.org/{k}", f"<p>{k}")) for k in range(5))
    (tmp_path / "a.warc.gz").write_bytes(raw)
    got = warc.derive_files(spark, str(tmp_path)).where("record_type = 'conversion'").collect()
    assert sorted(r.block for r in got) == [str(k) for k in range(5)]
