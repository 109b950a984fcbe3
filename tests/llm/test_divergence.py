import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from docweft.llm import divergence as A
from tests.llm.common import empty_documents, odd_documents

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(docs, holders, most):
    """All rows of the audit by dense sums over every kept term."""
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source, text = lang or "", source or "", text or ""
        groups.add((lang, source))
        found = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        counts[lang, source].update(found)
        held[lang].update(set(found))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= holders]
        others = sorted(s for g, s in groups if g == lang)

        def shares(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + A.UNITS * (counter[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = shares(counts[lang, source]), shares(sum((counts[lang, s] for s in others), Counter()))
        pairs = []
        for other in others:
            if other != source:
                r = shares(counts[lang, other])
                pairs.append((other, sum((p[t] - r[t]) ** 2 // (p[t] + r[t]) for t in kept)))
        terms = [(t, (p[t] - q[t]) ** 2 // (p[t] + q[t])) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, listed, top in (("pair", pairs, None), ("term", terms, most)):
            listed.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, n) for n, (item, value) in enumerate(listed[:top], 1)}
    return out


def frame(spark, docs):
    rows = [(lang, source, text, 1, 2, 3, "x", 4) for lang, source, text in docs]
    return spark.createDataFrame(rows, "lang string, source string, text string, rank int, value int, own int, cells string, kept int")


def seen(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    words = [f"{rng.choice('abcdeéñ日')}{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(120)]
    out = []
    for n in range(400):
        source = "s0" if rng.random() < 0.35 else f"s{rng.randrange(9)}"  # a third of all rows in one source
        out.append((rng.choice(["en", "fr"]), source, " ".join(rng.choice(words[: rng.choice([10, 60, 120])]) for _ in range(rng.randrange(40)))))
    return [*out, ("de", "s1", "only Once"), ("de", "s2", "never twice"), ("en", "empty", None), ("en", "blank", " 12 !"), (None, None, "a b"), (None, "s1", "")]


@pytest.mark.parametrize(("block", "slices"), [(A.BLOCK, A.SLICE), (7, 3), (1, 1)])
def test_against_dense_sums(spark, docs, block, slices):
    got = seen(A.audit(frame(spark, docs).repartition(6), holders=4, terms=5, block=block, slice_size=slices))
    assert got == plain(docs, 4, 5)


def test_odd_rows(spark):
    rows = odd_documents(spark)
    assert seen(A.audit(rows, holders=1)) == plain([(r["lang"], r["source"], r["text"]) for r in rows.collect()], 1, A.TERMS)
    assert A.audit(empty_documents(spark)).collect() == []


def test_ties(spark):
    """Equal sources and equal terms are ranked by their bytes."""
    text = " ".join(["zz", "é", "aa", "Ab"])
    docs = [("en", s, text) for s in ("b", "a", "é", "Z")] + [("en", "c", "other words")]
    assert seen(A.audit(frame(spark, docs), holders=1)) == plain(docs, 1, A.TERMS)


def test_parts(monkeypatch):
    """Counts that a task passes on early are added up again."""
    assert [x.decode() for x in A.terms_of("Don't\x00STOP À7B")] == ["don", "t", "stop", "À", "b"]
    monkeypatch.setattr(A, "HELD", 3)
    frames = [pd.DataFrame({"lang": ["en"] * 3, "source": ["s"] * 3, "text": ["a b c a", None, "a d"]})]
    tables = list(A.counted(iter(frames)))
    assert len(tables) == 2
    total = Counter()
    for t in tables:
        for r in t.itertuples():
            total[r.term] += r.n
    assert total == {"a": 3, "b": 1, "c": 1, "d": 1}


def test_runs():
    counts = np.array([0, 0, 2, 2, 2, 0, 5], "i8")
    starts = A.run_starts(counts)
    assert starts.tolist() == [0, 2, 5, 6]
    a, b = np.array([5, 5, 9, 9, 9, 5, 20]), np.array([3, 8, 8, 8, 1, 1, 1])
    other = A.run_starts(b)
    assert A.apart(starts, a[starts], other, b[other], 7) == int(((a - b) ** 2 // (a + b)).sum())


def test_large_counts(spark):
    """Shares stay exact where the product exceeds 64 bits."""
    n = 123_456_789_012_345
    df = spark.createDataFrame([(n, 2 * n, 3)], "n long, size long, kept long")
    from pyspark.sql import functions as F

    assert df.select(A.share(F.col("n"), "size").alias("p")).first()[0] == 1 + A.UNITS * (n + 2) // (2 * n + 6)
