import random

import numpy as np

from docweft.llm import bpe_lexicon as B
from docweft.llm.encode import library
from tests.llm.common import TEXTS, empty_documents, odd_documents

ODD = [
    " ", "  ", "a  b", "a   b", "a \nb", "a\n \nb", "\t x", "<|endoftext|> a <|endoftext|>b", "\x1c b \x1cq", "a \x85b", "aaaa" * 500, "ab" * 3000,
    "日本語テキスト" * 100, "՘ a࢏",
]


def test_automaton(tmp_path):
    words = [w.encode() for w in "the then there here a an and band hand lower slower thé".split()]
    vocab = B.vocabulary(B.TOKENIZER)
    compiled = {w: vocab.merged(w) for w in words}
    (tmp_path / "lex").write_bytes(B.compiled(compiled))
    lexicon = B.Lexicon(str(tmp_path / "lex"))
    assert all(lexicon.get(w) == ids for w, ids in compiled.items())
    assert not any(lexicon.get(w) for w in (b"", b"th", b"hander", b"zzz", b"sl"))
    # shared suffixes: fewer states than a prefix tree has
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(lexicon.final) < len(prefixes)


def test_encoder_equals_library(tmp_path):
    (tmp_path / "lex").write_bytes(B.compiled({b"the": B.vocabulary(B.TOKENIZER).merged(b"the")}))
    run, their = B.LexiconEncoder(str(tmp_path / "lex"), B.TOKENIZER), library(B.TOKENIZER)
    rng = random.Random(1)
    texts = [t for t in TEXTS if t] + ODD + ["".join(rng.choice("ab cdé\n  \t'sreTHE日12!") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    for text in texts:
        assert np.frombuffer(run.ids([text])[0], "<i4").tolist() == their.encode(text, add_special_tokens=False).ids, text[:40]


def test_long_words_merge_alike():
    vocab, rng = B.vocabulary(B.TOKENIZER), random.Random(2)
    for _ in range(200):
        ids = [vocab.single[b] for b in bytes(rng.choice(b"abrestion") for _ in range(rng.randint(1, 80)))]
        assert vocab.merged_long(list(ids)) == vocab.merged_short(list(ids))


def test_round_trip(spark):
    docs = odd_documents(spark)
    path = B.build_lexicon(docs, share=0.01)
    encode, decode = B.encoder(path), B.decoder()
    both = B.round_trip(docs, path).select("doc_id", "ids", "decoded")
    assert sorted(map(str, both.collect())) == sorted(map(str, docs.select("doc_id", encode("text").alias("ids")).withColumn("decoded", decode("ids")).collect()))
    out = docs.withColumn("ids", encode("text")).withColumn("back", decode("ids"))
    rows, their = out.collect(), library(B.TOKENIZER)
    assert len(rows) == docs.count()
    for r in rows:
        ids = their.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["back"] == their.decode(ids, skip_special_tokens=False) == (r["text"] or "")
    empty = empty_documents(spark)
    assert empty.withColumn("ids", B.encoder(B.build_lexicon(empty))("text")).collect() == []


def test_decoding_of_broken_bytes(spark):
    vocab = B.vocabulary(B.TOKENIZER)
    ids = [vocab.single[0xE6], vocab.single[0x97], vocab.single[0x41], vocab.single[0xFF]]
    row = spark.createDataFrame([(ids,)], "ids array<int>").select(B.decoder()("ids").alias("t")).first()
    assert row["t"] == library(B.TOKENIZER).decode(ids, skip_special_tokens=False)
    assert np.array(ids).size == 4
