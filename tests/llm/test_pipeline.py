import importlib.util

import pytest


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    from meridian.llm.common import read, words

    docs = read(spark, sf_dir, "documents").cache()
    sizes, at = [], docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, at, sf_dir).cache()
        assert out.columns == docs.columns, name
        sizes.append(out.count())
        at = out
    n = docs.count()
    assert n > sizes[0] > sizes[1] >= sizes[2] > 0
    rows = at.collect()
    s = {}
    for r in rows:
        w = words(r.text)
        s[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(s)
    for a in range(len(ids)):
        for b in range(a):
            x, y = s[ids[a]], s[ids[b]]
            both = len(x & y)
            assert not (x and y) or both < 0.8 * (len(x) + len(y) - both)
    last = p.STAGES[-1][1](spark, at, sf_dir)
    assert last.count() == len(rows)
    assert p.run(spark, sf_dir).count() > 0


def test_texts_decide_which_near_copies_stay(spark, docs):
    import corpus_pipeline as p

    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [(5, text("a")), (7, text("a") + " x"), (7, text("b")), (None, text("a") + " y"), (None, text("c")), (None, text("c") + " z"), (None, text("d"))]
    rows += [(9, text("e")), (9, text("e")), (9, text("f")), (11, text("f") + " w"), (12, None), (None, None), (None, None), (13, text("g")), (14, text("g") + " v")]
    for n in (1, 3):
        out = [(r.doc_id, r.text) for r in p.near_copies_stage(spark, docs(rows).repartition(n), None).collect()]
        c = [t for i, t in out if i is None and t and t.startswith("c0 ")]
        assert len(c) == 1
        want = [(5, text("a")), (7, text("b")), (None, c[0]), (None, text("d")), (9, text("e")), (9, text("f")), (12, None), (None, None), (13, text("g"))]
        assert sorted(out, key=str) == sorted(want, key=str)
    plain = [r for r in rows if r[0] in (5, 11, 12, 13, 14)]
    assert {r.doc_id for r in p.near_copies_stage(spark, docs(plain), None).collect()} == {5, 11, 12, 13}


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_odd_rows_pass_every_stage(spark, docs, tmp_path):
    import corpus_pipeline as p

    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [(1, text("a")), (2, None), (3, ""), (4, "long word " * 60_000), (5, text("item", 30)), (6, text("a") + " x"), (None, text("n")), (7, text("t")), (7, text("t"))]
    spark.createDataFrame([(k, 1, 0) for k in (1, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, text("item", 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs(rows).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    at, seen = docs(rows), []
    for name, stage in p.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path)).cache()
        assert at.columns == docs(rows).columns, name
        seen.append(sorted({(r.doc_id or -1, r.text or "") for r in at.collect()}))
    ids = [{i for i, _ in x} for x in seen]
    assert ids[0] == {1, 2, 3, 4, 5, 6, -1, 7} and ids[1] == ids[0] - {6} and ids[2] == ids[1] - {5}
    out = p.run(spark, str(tmp_path)).collect()
    assert len(out) == at.count() and {r.doc_id for r in out if r.n_tokens == 1} <= {2, 3}
    docs([]).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
