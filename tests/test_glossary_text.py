"""The glossary as one text, and what it adds to a topic, kept apart."""

from pyspark.sql import functions as F

from docweft.operators import glossary as G
from docweft.plans.catalog import load

TERMS = ["abcd", "abcde", "abc", "Abcd z", "é", "日本", "3D x", "zz", "z", "abcd", "𝒳y", "ab\tc"]


def test_lines_are_joined_in_order_of_their_keys(spark):
    rows = [(n, [t], f"A {n}" + "\nmore" * (n % 2)) for n, t in enumerate(TERMS)]
    lines = G.render_glossary(spark.createDataFrame(rows, "ord long, terms array<string>, definition string"))
    found = [(r["sort_key"], r["line"]) for r in lines.collect() if not r["line"].startswith("= ")]
    found.sort(key=lambda x: tuple((v is not None, v.encode() if isinstance(v, str) else v) for v in x[0]))
    want = "\n".join(x[1] for x in found)
    assert G.glossary_text(lines.repartition(5)).collect() == [(want,)]
    topics = spark.createDataFrame(
        [("a.adoc", "x"), ("b.adoc", "== Glossary"), ("c.md", "x"), ("d.adoc", None), ("e.adoc", "é")], "path string, text string"
    )
    whole = {r["path"]: r["text"] for r in G.attach_glossary(topics, "inline", lines).collect()}
    apart = G.attach_glossary(topics, "inline", lines, apart="added").collect()
    extra = "\n\n== Glossary\n\n" + want
    assert whole == {"a.adoc": "x" + extra, "b.adoc": "== Glossary", "c.md": "x", "d.adoc": None, "e.adoc": "é" + extra}
    assert {r["path"]: r["added"] and tuple(r["added"]) for r in apart} == {
        "a.adoc": (extra, len(extra)), "b.adoc": None, "c.md": None, "d.adoc": (extra, len(extra)), "e.adoc": (extra, len(extra)),
    }
    assert [(r["path"], r["text"]) for r in apart] == [(r["path"], r["text"]) for r in topics.collect()]
    for content in ("= T\nline", ""):
        held = G.attach_glossary(topics.filter(F.col("path") == "a.adoc"), "inline", content, apart="added").first()["added"]
        assert held["text"] == "\n\n== Glossary\n\n" + ("line" if content else "") and held["n_chars"] == len(held["text"])


def test_digests_of_pieces(spark, monkeypatch):
    """Topics are hashed with the pieces of the glossary one after the other; no task holds the whole of it."""
    monkeypatch.setattr(G, "HELD_BYTES", 40)
    terms = TERMS + [f"term {k % 7} number {k}" for k in range(300)]
    rows = [(n, [t], f"A {n}" + "\nmore" * (n % 2)) for n, t in enumerate(terms)]
    lines = G.render_glossary(spark.createDataFrame(rows, "ord long, terms array<string>, definition string")).repartition(5)
    topics = [("a.adoc", "x"), ("b.adoc", "== Glossary"), ("c.md", "x"), ("d.adoc", None), ("e.adoc", "é\0"), ("f.adoc", "")]
    topics = spark.createDataFrame(topics + [(f"t{n}.adoc", f"{n}") for n in range(200)], "path string, text string").repartition(3)
    whole = G.attach_glossary(topics, "inline", lines).select("path", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))
    got = G.inlined_digests(topics, lines)
    assert got.dtypes == whole.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    none = lines.filter("false")
    whole = G.attach_glossary(topics, "inline", none).select("path", F.length("text").cast("long"), F.md5("text"))
    assert sorted(map(tuple, G.inlined_digests(topics, none).collect())) == sorted(map(tuple, whole.collect()))
    assert G.glossary_pieces(lines).count() > 10


def test_query_makes_no_text_with_the_glossary(spark):
    plan = load()[0]["glossary_inlined"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" not in plan and "MapInArrow" in plan
