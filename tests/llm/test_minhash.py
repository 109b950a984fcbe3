import random

import numpy as np
import pytest

from docweft.llm import minhash as A
from tests.llm.common import LONG, empty_documents, odd_documents


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def plain_set(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(docs, percent=A.PERCENT):
    """doc_id, size, smallest id reachable, by all pairs of rows."""
    docs = [(i, t) for i, t in docs if i is not None]
    held = [plain_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(held[a] & held[b])
            if both and 100 * both >= percent * (len(held[a]) + len(held[b]) - both):
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[top(k)] = min(i, least.get(top(k), i))
    return sorted((i, len(held[k]), least[top(k)]) for k, (i, _) in enumerate(docs))


def found(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


@pytest.fixture(scope="module")
def docs():
    """Groups around a text, from exact copies to edits that fall on either side of the threshold, chains, short texts."""
    rng = random.Random(3)
    words = [f"w{n}" for n in range(900)]
    out = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([8, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text))
    chain = [rng.choice(words) for _ in range(200)]
    for k in range(20):  # each close to the next, the ends far apart
        chain[9 * k] = f"new{k}"
        out.append(" ".join(chain).upper())
    out += ["a b", "A  B", "a b c", None, "", " \n", "x", "x"]
    rng.shuffle(out)
    return list(enumerate(out, 10))


@pytest.mark.parametrize("limits", [{}, {"group": 4, "most": 4000}])
def test_against_all_pairs(spark, docs, limits):
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, n int, component_id int, hub int")
    assert found(A.near_duplicates(df.repartition(4), **limits)) == plain(docs)


def test_other_threshold(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(A.near_duplicates(df, percent=95)) == plain(docs, 95)


def test_odd_rows(spark):
    rows = odd_documents(spark)
    assert found(A.near_duplicates(rows)) == plain([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert A.near_duplicates(empty_documents(spark)).collect() == []


def test_repeated_ids(spark):
    """An id with two texts has two rows, each in the component of its own text."""
    one, two = " ".join(f"a{n}" for n in range(50)), " ".join(f"b{n}" for n in range(50))
    data = [(5, one), (5, two), (3, one), (4, two), (4, two), (9, None), (9, None)]
    assert found(A.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))) == plain(data)


def test_hot_group(spark):
    """A large group with its own edits each: no more candidate rows than members, one component."""
    rng = random.Random(8)
    base = [f"w{n}" for n in range(120)]
    docs = []
    for n in range(600):
        text = list(base)
        text[rng.randrange(120)] = f"x{n}"
        docs.append((n, " ".join(text)))
    got = found(A.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), group=64))
    assert {c for _, _, c in got} == {0}


def test_long_text():
    held = A.shingles(LONG * 20 + " tail of its own")
    whole = (held >> np.uint64(32)).astype("u4")
    assert np.array_equal(A.signature(held), ((whole ^ A.MIXED) * A.TIMES).min(1))
    many = np.arange(1, 3 * A.PIECE, dtype="u8") << np.uint64(32)
    short = (many >> np.uint64(32)).astype("u4")
    assert np.array_equal(A.signature(many)[:5], ((short ^ A.MIXED[:5]) * A.TIMES[:5]).min(1))


def test_posterior():
    """The bound is that of a beta posterior, integrated numerically."""
    needed = A.least_matches(85, 1e-3)
    s = np.linspace(0, 1, 200_001)
    for k, m in enumerate(needed):
        n = A.BANDS * (k + 1)
        for matches, kept in ((m, True), (m - 1, False)):
            density = s**matches * (1 - s) ** (n - matches)
            assert (density[s >= 0.85].sum() / density.sum() >= 1e-3) == kept


def test_miss_rate():
    """Pairs at the threshold are pruned as rarely as stated."""
    rng = np.random.default_rng(1)
    rule = A.Rule(85, A.MISS)
    one = np.zeros(A.BANDS * A.WIDTH, "u4")
    others = (rng.random((20_000, len(one))) >= 0.85).astype("u4")
    assert len(rule.plausible(one, others)) >= 20_000 * (1 - 20 * A.MISS)
    far = (rng.random((2_000, len(one))) >= 0.5).astype("u4")
    assert len(rule.plausible(one, far)) == 0
