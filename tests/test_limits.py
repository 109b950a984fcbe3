"""Nothing is cut, capped or left unread by default: a row beyond each limit that a renderer may want."""

import pytest
from pyspark.sql import functions as F

from docweft import session
from docweft.functions import text as T
from docweft.operators import blocks, conditions, rules, runs, variables
from docweft.plans import derived
from docweft.plans.catalog import load
from docweft.sources import corpus


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_every_issue_counts(spark):
    text = "\n".join(["image:: []", "include:: []"] * 150)
    topics = spark.createDataFrame([("a", text)], "path string, text string")
    row = rules.validation_summary(topics, rules.validate(topics)).first()
    assert row["issue_count"] >= 300 and row["rules_applied"].count(",") == len(rules.RULES) - 1
    capped = rules.validation_summary(topics, rules.validate(topics), cap=100).first()
    assert capped["issue_count"] < row["issue_count"]


def test_long_texts(spark):
    long = "word " * 5000
    assert one(spark, T.sanitize_text(F.col("c")), c=long) == long.strip()
    assert one(spark, T.sanitize_text(F.col("c"), 10), c=long) == long[:10]
    assert len(one(spark, T.slug(F.col("c")), c=long)) == len(long.strip())
    assert len(one(spark, T.slug(F.col("c"), limit=100), c=long)) == 100


def test_whole_content_tells_binary(spark):
    text, none = F.col("c"), F.lit("")
    late = "x" * 50_000 + "data:video/mp4;base64"
    assert "multimedia" in one(spark, corpus.binary_reason(text, none, F.length(text)), c=late)
    assert one(spark, corpus.binary_reason(text, none, F.lit(10**9)), c="plain") is None
    assert "too large" in one(spark, corpus.binary_reason(text, none, F.lit(10**9), max_bytes=10), c="plain")


def test_long_numbers(spark):
    text = "\n".join(f"{10**14 + k}. item" for k in range(3)) + "\n" + "9" * 60 + ". item"
    rows = blocks.numbered_paragraphs(spark.createDataFrame([("a", text)], "path string, text string"))
    assert rows.count() == 4
    assert [r["place"] for r in blocks.numbered_runs(rows).orderBy("ord").collect()] == [1, 2, 3]


def test_deep_folders(spark):
    deep = "/".join(["Content"] + ["Resources"] * 14)
    files = spark.createDataFrame([(f"{deep}/a.png",), (f"{deep}/b.flglo",)], "path string")
    assert [r["dir"] for r in runs.image_folders(files).collect()] == [deep]
    assert runs.image_folders(files, depth=8).count() == 0
    assert [r["path"] for r in corpus.side_files(files, "glossary").collect()] == [f"{deep}/b.flglo"]


def test_all_topics_are_seen(spark):
    rows = [(f"t{k:03}", f'<p data-mc-conditions="C.{k}">x</p>') for k in range(120)]
    topics = spark.createDataFrame(rows, "path string, html string")
    assert conditions.sample_conditions(topics).count() == 120
    assert conditions.sample_conditions(topics, 50).count() == 50


def test_blank_reference(spark):
    defs = spark.createDataFrame([(k, f"Name{k}") for k in range(5)], "ord int, name string")
    missing = spark.createDataFrame([("",), ("Name3x",)], "name string")
    got = {r["name"]: r["suggestions"] for r in variables.suggest_variables(missing, defs).collect()}
    assert got == {"": ["Name0", "Name1", "Name2"], "Name3x": ["Name3"]}


def test_work_folder_must_be_named(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_folder(Elsewhere)
    assert session.work_folder(spark)


@pytest.mark.parametrize("name", ["step_durations", "recent_reports"])
def test_tasks_grow_with_step_events(spark, monkeypatch, name):
    """Rows of a task stay bounded by number, however few bytes they have."""
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(derived, "ROWS", 200)
    n = -(-spark.read.parquet(f"{folder}/lineitem.parquet").count() // 200)
    assert n > spark.sparkContext.defaultParallelism
    found = load()[0][name](spark, folder)
    sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == n and max(sizes) <= 2 * 200
