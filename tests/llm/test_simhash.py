import random
import re

import numpy as np
import pytest
import xxhash

from docweft.llm import simhash as S
from docweft.session import stored
from tests.llm.common import TEXTS, empty_documents, odd_documents


def plain_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)), key=lambda x: ids[x])
                parent[b] = a
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_fingerprints():
    for text in TEXTS:
        if text is None or len(text) < 10_000:
            assert S.fingerprint(text) == plain_print(text)


@pytest.mark.parametrize("group", [4, S.GROUP])
def test_links_and_components(spark, group):
    """Clusters around centres, with chains: files larger than a group are dealt out and lose nothing."""
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(60):
        base = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            base ^= 1 << b
        prints.append(base)
    ids = rng.sample(range(10_000), len(prints))
    signed = np.array(prints, "u8").view("i8").tolist()
    table = stored(spark.createDataFrame(list(zip(ids, signed)), "doc_id long, print long"))
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(table, group=group).collect()}
    assert got == plain_components(prints, ids)
    assert len(set(got.values())) < len(ids)


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(k, k + 1) for k in random.Random(1).sample(range(n), n)], "a long, b long")
    assert {r["component"] for r in S.components(edges).collect()} == {0}
    assert S.components(edges.limit(0)).collect() == []


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = S.near_duplicates(stored(S.fingerprints(docs))).collect()
    given = [r for r in docs.collect() if r["doc_id"] is not None]
    assert len(out) == len(given)
    by = {r["doc_id"]: r["component_id"] for r in out}
    assert by[6] == by[7] == 6 and by[1] == by[2] == 1
    assert S.near_duplicates(stored(S.fingerprints(empty_documents(spark)))).collect() == []


def test_masks():
    for _ in range(300):
        a = random.getrandbits(64)
        b = a
        for k in random.sample(range(64), 3):
            b ^= 1 << k
        assert any((a & m) == (b & m) for m in (x % 2**64 for x in S.masks()))
    with pytest.raises(ValueError):
        S.masks((32, 32), 3)
