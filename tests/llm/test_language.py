import math
import tracemalloc
from functools import cache

import pandas as pd
from pyspark.sql import functions as F

from docweft.llm import language as L
from tests.llm.common import empty_documents, odd_documents

FOLDER = "/root/testdata/sf0.01"


def test_forward_sums_all_segmentations():
    pieces = L.vocabulary().pieces
    model = L.fit_counts(pd.DataFrame([("en", L.START + "there", 5), ("en", L.START + "here", 2), ("de", L.START + "der", 4)], columns=["lang", "word", "n"]))
    for word in (L.START + "there", L.START + "de", L.START + "日x", L.START + "q" * 20):

        @cache
        def total(rest, k):
            if not rest:
                return 1.0
            out = sum(model.chances[pieces[rest[:n]], k] * total(rest[n:], k) for n in range(1, len(rest) + 1) if rest[:n] in pieces)
            return out + (0 if rest[0] in pieces else L.UNKNOWN * total(rest[1:], k))

        got = L.Arcs.of([word]).totals(model.chances)[0]
        for k in range(2):
            assert abs(got[k] - math.log(total(word, k))) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").withColumn("out", L.held_out(F.col("doc_id")))
    found = L.identify(docs.filter("out"), L.fit(docs.filter("not out"), per_language=50, types=1000)).collect()
    assert len(found) > 100 and sum(r["language"]["lang"] == r["lang"] for r in found) >= 0.99 * len(found)


def test_long_words_do_not_underflow():
    model = L.fit_counts(pd.DataFrame([("en", L.START + "a", 1), ("de", L.START + "b", 1)], columns=["lang", "word", "n"]))
    ((lang, score),) = L.Scorer(model).predict(["日" * 100_000 + " a"])
    assert lang == "en" and 0 <= score <= 1


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = L.identify(docs, L.fit(docs), into="guess")
    assert out.columns == [*docs.columns, "guess"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["guess"]["lang"] == L.UND) == (not letters) and 0 <= r["guess"]["score"] <= 1
    empty = empty_documents(spark)
    assert L.identify(empty, L.fit(empty), into="guess").collect() == []
    nothing = L.identify(docs, L.fit(empty), into="guess").collect()
    assert {(r["guess"]["lang"], r["guess"]["score"]) for r in nothing} == {(L.UND, 0.0)}


def test_forgets(monkeypatch):
    model = L.fit_counts(pd.DataFrame([("en", L.START + "the", 3), ("de", L.START + "der", 3)], columns=["lang", "word", "n"]))
    want = [L.Scorer(model).predict([t])[0] for t in ("the a b", "der c d e", "the der")]
    monkeypatch.setattr(L, "KEPT", 2)
    run = L.Scorer(model)
    assert [run.predict([t])[0] for t in ("the a b", "der c d e", "the der")] == want


def test_marks_that_are_no_letters():
    model = L.fit_counts(pd.DataFrame([("en", L.START + "the", 3), ("de", L.START + "der", 3)], columns=["lang", "word", "n"]))
    texts = ["² ½ ①", "Ⅷ 12 _", "\u0301", "", None]
    assert L.Scorer(model).predict(texts) == [(L.UND, 0.0)] * len(texts)
    assert [x[0] for x in L.Scorer(model).predict(["² the", "der½"])] == ["en", "de"]


def test_long_words_are_summed_over_all_segmentations():
    pieces = L.vocabulary().pieces
    longest = max(map(len, pieces))
    rows = [("en", L.START + "there", 5), ("en", L.START + "here", 2), ("de", L.START + "der", 4), ("de", L.START + "dort", 1)]
    model = L.fit_counts(pd.DataFrame(rows, columns=["lang", "word", "n"]))
    for run in ("there" * 5, "therederdort" * 40, "xq日here" * 7 + "d", "q" * 1000):
        word = L.START + run
        got, found = L.long_total(word, model.chances), L.Scorer(model)
        for k in range(2):
            # logarithms of the sums over all ways to cut the first e characters
            logs = [0.0]
            for e in range(1, len(word) + 1):
                ways = [
                    logs[b] + math.log(model.chances[pieces[word[b:e]], k]) for b in range(max(0, e - longest), e) if word[b:e] in pieces
                ]
                if word[e - 1] not in pieces:
                    ways.append(logs[e - 1] + math.log(L.UNKNOWN))
                top = max(ways)
                logs.append(top + math.log(sum(math.exp(w - top) for w in ways)))
            assert abs(got[k] - logs[-1]) < 1e-9 * len(word)
        ((lang, score),) = found.predict([run])
        assert abs(score - 1 / (1 + math.exp(-abs(got[0] - got[1])))) < 1e-9


def test_texts_of_a_slice_are_bounded():
    texts = ["x" * 700_000, "y" * 700_000, None, "", "z" * 3_000_000, *["short"] * 600]
    runs = list(L.slices(texts))
    assert [x for run in runs for x in run] == texts and list(L.slices([])) == []
    assert all(len(run) <= L.TEXTS for run in runs)
    assert all(len(run) == 1 or sum(len(x or "") for x in run) <= L.CHARACTERS for run in runs)


def test_known_words_move_over_and_learning_is_bounded(monkeypatch):
    model = L.fit_counts(pd.DataFrame([("en", L.START + "the", 3), ("de", L.START + "der", 3)], columns=["lang", "word", "n"]))
    monkeypatch.setattr(L, "KEPT", 3)
    found, asked, of = L.Scorer(model), [], L.Arcs.of
    monkeypatch.setattr(L.Arcs, "of", lambda words, *more: (asked.extend(words), of(words, *more))[1])
    for text in ("the a b", "the c d", "the e f", "der g h"):
        found.predict([text])
        assert len(found.seen) <= 3 and len(found.words) <= 3 and len(found.older) <= 3
        assert all(x.base is None or len(x.base) <= L.LEARN for x in found.words.values())
    assert asked.count(L.START + "the") == 1
    monkeypatch.undo()
    # what is held on the way does not grow with the words that come at once
    words = ["".join("abcdefghijklmnop"[n >> 4 * k & 15] for k in range(6)) + "und" * 4 for n in range(40_000)]
    whole = L.Scorer(model)
    tracemalloc.start()
    whole.learn(words)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak - held < 12e6
