import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.llm import encode, token_files as T
from tests.llm.common import TEXTS, empty_documents, odd_documents


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    texts = [t for t in TEXTS if t] + [" ", "  ", "a  b", "a   b", "a \nb", "a\n b", "a\n\n b", "a \n b", "a\n \nb", "\x1c b \x1cq", "a \x85b", "<|endoftext|> a",
        "word.\nNext, one;two.. three.\n\nfour\n", "\nlead", ".", " .", "..a", "it's. 's.", "Ünïcöde, straße. İstanbul! ŉ ǆ. ﬁne", "a.\n b", "x.\r\ny", "né. né.\né", "a1. 1. 1.2",
        "end<|endoftext|>. <|endoftext|>.\n<|endoftext|>", "a\u2028b.\nc\x1c\nd"]
    run, library = encode.Encoder(name, name.startswith("word_")), encode.library(name)
    for text, got in zip(texts, run.ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(encode, "KEPT", 6)
    run = encode.Encoder("byte_bpe_50k.json", False)
    texts = ["a b c d e f g", "a h i j", "k l a b"]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(run.ids([t])[0], "<u4").tolist() == run.tokenizer.encode(t, add_special_tokens=False).ids


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    function, _ = T.PerfectHash.load(T.PerfectHash.of(keys).dump())
    assert sorted(function.slots(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        T.PerfectHash.of(np.array([7, 7], "i8"))


def test_written_and_found(spark):
    docs = odd_documents(spark)
    entries = T.write_shards(docs)
    index, buckets = T.write_index(entries, bucket_keys=4)
    rows = T.read_ids(T.lookup(entries, index, buckets), T.shard_list(entries)).collect()
    assert len(rows) == docs.count() and buckets > 1
    library, start = encode.library("byte_bpe_50k.json"), 0
    given = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    for (key, text), r in zip(given, sorted(rows, key=lambda r: r["start"]), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (key, start, len(ids), ids)
        start += len(ids)
    strange = entries.select((F.coalesce("doc_id", F.lit(0)) + 10_000).alias("doc_id"), "copy")
    assert T.lookup(strange, index, buckets).count() == 0


def test_empty(spark):
    entries = T.write_shards(empty_documents(spark))
    index, buckets = T.write_index(entries)
    assert T.read_ids(T.lookup(entries, index, buckets), T.shard_list(entries)).collect() == []
