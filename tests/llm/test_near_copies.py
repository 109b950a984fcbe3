import random

import numpy as np
import pandas as pd

import corpus_pipeline
from docweft.llm import near_copies as N
from tests.llm.common import odd_documents


def plain_sets(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    held = [(d, plain_sets(t)) for d, t in sorted(rows)]
    group, linked = list(range(len(held))), 0
    for i in range(len(held)):
        for j in range(i + 1, len(held)):
            both = len(held[i][1] & held[j][1])
            if 5 * both >= 4 * (len(held[i][1]) + len(held[j][1]) - both):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
                linked += 1
    return {held[g][0] for g in set(group)}, linked


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()}


def test_stage_against_all_pairs(spark):
    """Copies with up to a tenth of the words changed: most differ in more than three bits of a fingerprint."""
    rng = random.Random(3)
    rows = []
    for k in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 300))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(8)):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randrange(0, 1 + len(copy) // 25)):
                copy[at] = f"w{rng.randrange(5000)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want, linked = plain_kept(rows)
    assert linked > 100 and len(want) > 25
    assert kept(spark, rows) == want


def test_one_large_band(spark):
    """A chain within one band: the ends are not similar, so stars alone would leave pieces; slices lose nothing."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 100] if k < 60 else words[:3])) for k in range(62)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = plain_kept(rows)
    for group in (4, N.GROUP):
        found = N.near_copies(docs, group=group)
        assert found.select("component").distinct().count() == len(want)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want, _ = plain_kept(rows)
    assert {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()} == want


def test_odd_rows(spark):
    docs = odd_documents(spark).select("doc_id", "text")
    given = [r["doc_id"] for r in docs.collect() if r["doc_id"] is not None]
    out = N.near_copies(docs).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(given)
    by = {r["doc_id"]: r["component"] for r in out}
    assert by[6] == by[7] and by[1] == by[2] and by[3] != by[4]
    assert N.near_copies(docs.limit(0)).collect() == []


def test_repeated_ids(spark):
    """Rows are judged by their own text: a near copy does not take other texts of its id with it."""
    base, other, third = (" ".join(f"{c}{k}" for k in range(80)) for c in "abc")
    rows = [(0, base), (1, other), (1, base + " more"), (1, third), (1, third), (2, third), (None, base), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.dedup_stage(spark, docs, "").collect())
    assert got == sorted([("0", base), ("1", other), ("1", third), ("None", base), ("None", base)])


def joined(links, label):
    label = dict(label)
    for a, b in links:
        old, new = label[b], label[a]
        label = {k: new if v == old else v for k, v in label.items()}
    return sorted(sorted(k for k in label if label[k] == v) for v in set(label.values()))


def test_search_within_slices():
    """The links of one slice or two join what all pairs join, and are fewer than the members."""
    rng = np.random.default_rng(5)
    for across in (False, True):
        for _ in range(30):
            bases = [rng.integers(0, 60, rng.integers(8, 40)) for _ in range(4)]
            held = []
            for base in (bases[i] for i in rng.integers(0, 4, 40)):
                copy = np.where(rng.random(len(base)) < 0.06, rng.integers(0, 60, len(base)), base)
                held.append(np.unique(copy).astype("u8"))
            ids = rng.permutation(1000)[:40]
            own = rng.integers(0, 2, 40) if across else np.zeros(40, int)
            label = dict(zip(ids.tolist(), np.minimum(ids, rng.choice(ids, 40)).tolist()))
            frame = pd.DataFrame({
                "class": ids, "own": own, "component": [label[i] for i in ids.tolist()], "held": [x.tobytes() for x in held],
                "s": 0, "t": int(across),
            })
            pairs = []
            for i in range(40):
                for j in range(i):
                    a, b = set(held[i].tolist()), set(held[j].tolist())
                    if (not across or own[i] != own[j]) and 5 * len(a & b) >= 4 * len(a | b):
                        pairs.append((ids[i], ids[j]))
            got = N.search_maker(0.8)(frame)
            assert joined(got.itertuples(index=False), label) == joined(pairs, label)
            assert len(got) < len(set(label.values()))


def test_slices_bounded_by_bytes(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 100])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert N.near_copies(docs, most=4000).select("component").distinct().count() == len(plain_kept(rows)[0])
