import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, key int, _i int, _k string, component_id string, block int"


def rows(texts, sources=None):
    """Documents with extra columns whose names the operators use inside."""
    return [(i, t, "en", (sources or ["s"])[k % len(sources or ["s"])], 0, "x", "y", 1, 2, "z", "c", 3) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    return lambda texts, sources=None: spark.createDataFrame(rows(texts, sources), SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Ids and texts: nulls, blanks, copies, near copies, one very long text, one very long word, repeated rows."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "é É ß 中文 🙂")]
    base = text(120).split()
    out += [(10, " ".join(base)), (11, " ".join(base)), (12, " ".join(base).upper())]
    for k in range(8):
        near = list(base)
        near[10 * k + 3] = f"n{k}"
        out.append((20 + k, " ".join(near)))
    out += [(40 + k, text(rnd.randint(1, 60))) for k in range(25)]
    out += [(80, text(30_000)), (81, "a" * 50_000), (82, "mail x.y@ex-a.example.com, 10.0.0.1 or 4111 1111 1111 1111 and +1 (555) 010-9999 x")]
    out += [out[9], out[9], (-5, text(20)), (None, text(20)), (None, None)]
    return out
