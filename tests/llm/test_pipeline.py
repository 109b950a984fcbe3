import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from docweft.llm import language, quality_rules, simhash
from docweft.llm.encode import library
from docweft.session import stored
from tests.llm.common import odd_documents

FOLDER = "/root/testdata/sf0.001"


def steps(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER)))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given, spoken, good, single, packed = steps(spark, docs)
    assert [t.columns for t in (spoken, good, single)] == [docs.columns] * 3
    # language: what stays has a language
    model = language.fit(docs)
    scorer = language.Scorer(model)
    want = {r["doc_id"] for r in given.collect() if (x := scorer.predict([r["text"]])[0])[0] != language.UND and x[1] >= 0.5}
    assert {r["doc_id"] for r in spoken.collect()} == want
    # quality: the operator's verdict on what came in
    verdict = quality_rules.score_quality(stored(quality_rules.quality_facts(spoken)))
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in verdict.filter("quality.kept").collect()}
    # near-duplicates: by brute force over all pairs
    rows = good.orderBy("doc_id").collect()
    prints = np.array([simhash.fingerprint(r["text"]) for r in rows], "u8")
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= 3) + i + 1:
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    assert {r["doc_id"] for r in single.collect()} == {rows[g]["doc_id"] for g in set(group)}
    # packing: every id of every document that is left, once
    pieces = packed.orderBy("doc_id", "start").collect()
    texts, whole = {r["doc_id"]: r["text"] for r in single.collect()}, {}
    for p in pieces:
        assert p["start"] == len(whole.setdefault(p["doc_id"], []))
        whole[p["doc_id"]] += np.frombuffer(p["ids"], "<u4").tolist()
    their = library("word_bpe_49k.json")
    assert whole == {d: their.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    ran = corpus_pipeline.run(spark, FOLDER)
    assert ran.groupBy("sequence_id").agg(F.sum("length")).count() == packed.select("sequence_id").distinct().count()


def test_odd_rows(spark):
    odd = odd_documents(spark)
    clean = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 40").drop("n_chars").withColumn("doc_id", F.col("doc_id") + 1000)
    docs = odd.unionByName(clean, allowMissingColumns=True)
    _, spoken, good, single, packed = steps(spark, docs)
    assert [t.columns for t in (spoken, good, single)] == [docs.columns] * 3
    assert good.count() >= single.count() and packed.count() > 0
    ids = [r["doc_id"] for r in single.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))
    empty = steps(spark, docs.limit(0))
    assert [t.count() for t in empty] == [0] * 5


def test_dedup_by_fingerprint(spark):
    """Of each set within three bits one row stays, also where an id has several texts."""
    words = [f"w{n}" for n in range(400)]
    a, b = " ".join(words), " ".join(reversed(words))
    close = (a + "".join(f" v{n}" for n in range(m)) for m in range(1, 60))
    near = next(x for x in close if 0 < (simhash.fingerprint(a) ^ simhash.fingerprint(x)).bit_count())
    assert 0 < (simhash.fingerprint(a) ^ simhash.fingerprint(near)).bit_count() <= 3
    data = [(5, a), (5, b), (9, near), (9, b), (None, a), (7, "other words in a text"), (7, "other words in a text"), (8, None), (6, " ")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_stage(spark, docs, FOLDER).collect()}
    assert left == {(5, a), (5, b), (None, a), (7, "other words in a text"), (6, " ")}


def test_dedup_calls_the_named_method(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(simhash, "near_duplicates", lambda prints, _of=simhash.near_duplicates: asked.append(1) or _of(prints))
    docs = spark.createDataFrame([(1, "some text"), (2, "some text")], "doc_id long, text string")
    assert corpus_pipeline.dedup_stage(spark, docs, FOLDER).count() == 1 and asked
