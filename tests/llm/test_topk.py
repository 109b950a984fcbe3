import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, id int, v int, block int"


def plain(data, k=5):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in good if i % 50 == 0}:
        mine = min(v for i, v in good if i == q)
        hits = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in good if i != q and len(v) == len(mine))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(hits[:k])}
    return out


@pytest.mark.parametrize("block", [T.BLOCK, 40])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "QUERIES", 3)
    monkeypatch.setattr(T, "SLICE", 16)
    rng = random.Random(4)
    data = [(n, [rng.gauss(0, 1) * rng.choice([0.1, 1, 5]) for _ in range(8)]) for n in range(0, 400, 2)]
    data += [(n, data[3][1]) for n in range(1, 160, 2)] + [(1001, None), (1003, []), (1050, [None] * 8), (1100, [math.inf] * 8), (1150, [math.nan] + [0.0] * 7)]
    data += [(2000, [0.0] * 8), (2050, [1.0, 2.0]), (2051, [3.0, -1.0]), (None, [1.0] * 8), (100, [9.0] * 8), (100, [-9.0] * 8)]
    rows = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in data], SCHEMA)
    got = {tuple(r) for r in T.top_k(rows, F.col("vec_id") % 50 == 0).collect()}
    assert got == plain(data)


def test_few_and_none(spark):
    rows = spark.createDataFrame([(0, [1.0], 1, 1, 1), (1, [2.0], 1, 1, 1)], SCHEMA)
    assert [tuple(r) for r in T.top_k(rows, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert T.top_k(rows.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert T.top_k(rows, F.lit(None).cast("boolean")).collect() == []


def test_pruning_leaves_out_most_pairs():
    rng = np.random.default_rng(1)
    c = (rng.normal(size=(20_000, 16)) * rng.exponential(1, (20_000, 1)) * 100).astype("i8")
    q = c[:20]
    scored = []
    old, T.products = T.products, lambda a, b: scored.append(len(a)) or old(a, b)
    try:
        turn = np.linalg.eigh(c.T.astype("f8") @ c)[1][:, ::-1]
        row, hit, score = T.best_of(np.arange(20), q, np.arange(20_000), c, turn, 5, np.full(20, -np.inf))
    finally:
        T.products = old
    full = q @ c.T
    full[np.arange(20), np.arange(20)] = np.iinfo("i8").min
    assert all(sorted(score[row == n], reverse=True) == sorted(full[n], reverse=True)[:5] for n in range(20))
    assert sum(scored) < 0.2 * 20 * 20_000
