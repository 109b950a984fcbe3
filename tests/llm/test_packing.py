import numpy as np
import pytest

from docweft.llm import packing as P
from docweft.llm.encode import library
from tests.llm.common import empty_documents, odd_documents


@pytest.mark.parametrize(("tokens", "docs"), [(P.SHARD_TOKENS, P.SHARD_DOCS), (700, 3)])
def test_every_id_once(spark, tokens, docs):
    table = odd_documents(spark)
    rows = P.pack(table, window=256, shard_tokens=tokens, shard_docs=docs).collect()
    whole = {}
    for r in rows:
        whole.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    for d in {r["doc_id"] for r in table.select("doc_id").collect()}:
        texts = [r["text"] for r in table.collect() if r["doc_id"] == d]
        ids = library("word_bpe_49k.json").encode(texts[0] or "", add_special_tokens=False).ids + [1]
        places = np.zeros(len(ids), int)
        for start, part, n in whole[d]:
            assert part == ids[start : start + len(part)] and n == len(ids)
            places[start : start + len(part)] += 1
        assert (places == len(texts)).all()
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + len(r["ids"]) // 4
    assert all(n <= 256 and n & (n - 1) == 0 for n in by.values())


def test_neighbours():
    """BM25 scores are those of the formula; a window takes the closest document first."""
    rng = np.random.default_rng(2)
    topics = [rng.integers(100 * k, 100 * k + 40, 30) for k in (1, 2, 3) for _ in range(4)]
    idf = np.linspace(1, 2, 1000)
    index = P.Index(topics, idf, 30.0)
    scores = index.neighbours(0)
    heavy = sorted({int(t) for t in topics[0]}, key=lambda t: -idf[t] * (topics[0] == t).sum())[: P.TERMS]
    for d, part in enumerate(topics):
        want = 0.0
        for t in heavy:
            tf = (part == t).sum()
            want += idf[t] * tf * (P.K1 + 1) / (tf + P.K1 * (1 - P.B + P.B * len(part) / 30.0)) if tf else 0
        assert abs(scores[d] - want) < 1e-9 or len(set(topics[0])) > P.TERMS
    first, *_ = P.pack_shard(topics, idf, 30.0, 90)
    assert {p // 4 for p, _, _ in first} == {0}


def test_document_frequencies(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta"), (3, None)], "doc_id int, text string")
    size = library("word_bpe_49k.json").get_vocab_size()
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(P.tokenized("word_bpe_49k.json", 1, size), P.TOKENS)
    got = P.document_frequencies(rows, size)
    beta = library("word_bpe_49k.json").encode("beta", add_special_tokens=False).ids[0]
    assert got[1] == 3 and got[beta] == 2


def test_empty(spark):
    assert P.pack(empty_documents(spark)).collect() == []


def test_all_tokens_of_long_seeds():
    """Seeds of far more than 24 distinct tokens: scores are those of full BM25, also when used documents are dropped."""
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 900, rng.integers(200, 400)) for _ in range(30)]
    idf = np.linspace(0.1, 5, 1000)
    index = P.Index(parts, idf, 300.0)
    assert len(set(parts[0].tolist())) > 100

    def plain(seed, d):
        tf = np.array([(parts[d] == t).sum() for t in np.unique(parts[seed])])
        return (idf[np.unique(parts[seed])] * tf * (P.K1 + 1) / (tf + P.K1 * (1 - P.B + P.B * len(parts[d]) / 300.0))).sum()

    want = {seed: np.array([plain(seed, d) for d in range(30)]) for seed in (0, 7)}
    for seed in want:
        assert np.allclose(index.neighbours(seed), want[seed])
    gone = np.arange(30) % 3 == 1
    gone[7] = False
    index.drop(gone)
    for seed in want:
        assert np.allclose(index.neighbours(seed), np.where(gone, 0, want[seed]))


def test_common_rows():
    """Tokens held as rows of weights give the scores of the lists, also after documents are dropped."""
    rng = np.random.default_rng(5)
    parts = [np.concatenate([rng.integers(0, 20, 15), rng.integers(20, 5000, 15)]) for _ in range(60)]
    index = P.Index(parts, np.linspace(1, 2, 5000), 30.0)
    assert 0 < len(index.rows) < 40 and index.rows.size <= P.COMMON * len(index.docs)
    for gone in (np.zeros(60, bool), np.arange(60) % 3 == 1):
        index.drop(gone)
        for seed in np.flatnonzero(~gone):
            want = np.zeros(60)
            for t in set(parts[seed].tolist()):
                at = slice(index.lists[t], index.lists[t + 1])
                want[index.docs[at]] += index.weights[at]
            assert np.allclose(index.neighbours(seed), want, atol=1e-9) and not index.neighbours(seed)[gone].any()


def test_pieces_once():
    """A piece of many texts is looked up once for a call; words with marks are not held; ids are those of whole texts."""
    from docweft.llm.encode import WordEncoder

    asked = []

    class Counted(WordEncoder):
        def __missing__(self, key):
            asked.append(key)
            return super().__missing__(key)

    marks = ["it's.", "WORD###", "a,b", "É!?", "».", "x_", "_.", "3.", "don't&&&", "ends'", "<|endoftext|>", "<|ENDOFTEXT|>.", "H̱,", "İs.", "a\tb.", "ς.", "ſ,"]
    texts = [None, "", " ", "\n\n", *marks, " ".join(marks), *(["same words, same words.\nsame"] * 300)]
    run = Counted("word_bpe_49k.json")
    got = [np.frombuffer(x, "<u4").tolist() for x in run.ids(texts)]
    assert got == [library("word_bpe_49k.json").encode(x or "", add_special_tokens=False).ids for x in texts]
    assert asked.count("words,") == 1 and "words" in run and "words," not in run
