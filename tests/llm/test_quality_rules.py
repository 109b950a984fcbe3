import math
import re
from collections import Counter

from pyspark.sql import functions as F

from docweft.llm import quality_rules as Q
from docweft.session import stored
from tests.llm.common import empty_documents, odd_documents


def plain_facts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if n[x] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def plain_model(patterns):
    """Expectation-maximisation in plain Python: {votes: count} to the posterior of each pattern."""
    rules = len(Q.RULES)
    share, chance = Q.SHARE, [[list(Q.GOOD) for _ in range(rules)], [list(Q.BAD) for _ in range(rules)]]

    def posterior(votes):
        a, b = math.log(share), math.log(1 - share)
        for j, v in enumerate(votes):
            a += math.log(chance[0][j][v + 1])
            b += math.log(chance[1][j][v + 1])
        return 1 / (1 + math.exp(b - a))

    for _ in range(Q.STEPS):
        p = {v: posterior(v) for v in patterns}
        size = [sum(n * p[v] for v, n in patterns.items()), sum(n * (1 - p[v]) for v, n in patterns.items())]
        new = [[[0.0] * 3 for _ in range(rules)] for _ in range(2)]
        for c, first in enumerate((Q.GOOD, Q.BAD)):
            for j in range(rules):
                for k in range(3):
                    hits = sum(n * (p[v] if c == 0 else 1 - p[v]) for v, n in patterns.items() if v[j] == k - 1)
                    new[c][j][k] = (hits + Q.WEIGHT * first[k]) / (size[c] + Q.WEIGHT)
        share, chance = (size[0] + Q.WEIGHT * Q.SHARE) / (sum(size) + Q.WEIGHT), new
    return {v: posterior(v) for v in patterns}


def scored(docs):
    return Q.score_quality(stored(Q.quality_facts(docs, into="made"), "facts"), "made", "verdict")


def test_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = scored(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in rows:
        assert tuple(r["made"][n] for n in names) == plain_facts(r["text"])
    want = plain_model(Counter(tuple(r["verdict"]["votes"]) for r in rows))
    for r in rows:
        assert abs(r["verdict"]["posterior"] - want[tuple(r["verdict"]["votes"])]) < 1e-9
        failed = r["made"]["n_words"] < 10 or 100 * r["made"]["n_repeat_words"] > 20 * r["made"]["n_words"]
        assert r["verdict"]["base_failed"] == failed
        assert r["verdict"]["kept"] == (not failed and r["verdict"]["posterior"] >= 0.5)


def test_labels(spark):
    """The labels are not used in fitting: they tell how good the verdict is."""
    folder = "/root/testdata/sf0.01"
    rows = scored(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = rows.join(labels, "doc_id").filter("made.n_words >= 10").groupBy("quality").agg(F.avg(F.col("verdict.kept").cast("double")).alias("k"))
    kept = {r["quality"]: r["k"] for r in found.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.05


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = scored(docs)
    assert out.columns == [*docs.columns, "made", "verdict"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r["made"][n] for n in ("n_words", "word_chars")) == plain_facts(r["text"])[:2]
        assert r["verdict"]["base_failed"] or r["made"]["n_words"] >= 10
    assert scored(empty_documents(spark)).collect() == []


def test_repeats_overlap(spark):
    """Windows that overlap and repeat: every word of a repeated window counts once."""
    texts = ["a b c d e " * 2, "a b c d e f a b c d e g", "a a a a a a a", "a b c d e x a b c d y", "p " + "q r s t u v " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["f"]["n_repeat_words"] for r in Q.quality_facts(docs, into="f").collect()}
    assert got == {n: plain_facts(t)[4] for n, t in enumerate(texts)}
