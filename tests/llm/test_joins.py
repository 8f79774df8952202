import numpy as np

from meridian.llm import embedding_dedup, ngram_join
from meridian.llm.common import Forest, components, words


def brute_components(ids, linked):
    f = Forest(len(ids))
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    for a in range(len(order)):
        for b in range(a):
            if linked(order[a], order[b]):
                f.join(a, b)
    return {ids[order[a]]: ids[order[f.find(a)]] for a in range(len(order))}


def sets(corpus, n):
    out = {}
    for i, t in corpus:
        w = words(t)
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


def near(x, y, percent):
    both = len(x & y)
    return bool(x and y) and 100 * both >= percent * (len(x) + len(y) - both)


def check_join(df, corpus, n, percent):
    s = sets([x for x in corpus if x[0] is not None], n)
    want = brute_components(list(s), lambda a, b: near(s[list(s)[a]], s[list(s)[b]], percent))
    got = ngram_join.ngram_jaccard(df, n=n, percent=percent).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(s[r.doc_id]), want[r.doc_id]), r


def test_ngram_jaccard(docs, corpus):
    check_join(docs(corpus), corpus, 3, 90)
    check_join(docs(corpus), corpus, 5, 80)


def test_ngram_jaccard_blocks(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rnd = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    many = []
    for k in range(24):
        t = list(base)
        for j in rnd.integers(0, 60, k % 4):
            t[j] = f"x{k}"
        many.append((k, " ".join(t)))
    check_join(docs(many), many, 3, 80)


def test_empty_tables(docs, spark):
    assert ngram_join.ngram_jaccard(docs([])).count() == 0
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 51)} | {101: 100, 102: 100}


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 32))
    vecs = [(k, (base[k % 12] + rng.normal(size=32) * 0.05 * (k % 5)).tolist(), k % 2) for k in range(240)]
    vecs += [(1000 + k, vecs[0][1], 0) for k in range(40)]  # copies
    odd = [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 32, 0), (2003, [float("nan")] * 32, 0), (2004, [None] * 32, 0), (2005, vecs[0][1], None), (2006, [1.0, 2.0], 0), (None, vecs[0][1], 0), (2007, [float("inf")] + [1.0] * 31, 1)]
    df = spark.createDataFrame([(*v, "t", 5) for v in vecs + odd], "vec_id long, embedding array<float>, label int, code string, rep int")
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(df).collect()}
    ids = [v[0] for v in vecs]
    x = np.array([v[1] for v in vecs], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([v[2] for v in vecs])
    hit = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    want = brute_components(ids, lambda a, b: hit[a, b])
    links = sum(got[i].n_links for i in ids)
    assert links >= 0.99 * (hit.sum() - len(ids)) and all(got[i].n_links <= hit[k].sum() - 1 for k, i in enumerate(ids))
    assert sum(got[i].component_id == want[i] for i in ids) >= 0.98 * len(ids)
    for v in odd:
        if v[0] is not None:
            assert got[v[0]].n_links == 0 and got[v[0]].component_id == v[0] and got[v[0]].kept


def test_embeddings_at_the_threshold(spark):
    vecs = [(1, [3.0, 4.0], "x"), (2, [5.0, 0.0], "x"), (3, [3.0, 4.000001], "x"), (4, [3.0, 4.0], "y"), (5, [3.0, 4.0], "x")]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(df, threshold=0.6).collect()}
    # 3 and 2 are just below 0.6
    assert got == {1: (3, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), 5: (3, 1, False)}
