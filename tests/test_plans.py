"""Plans and skew: what must not shuffle, and hot keys that must not break anything."""

from pyspark.sql import functions as F

from docweft.operators import conditions, hierarchy, links, progress, quality, rules


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def topics(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("t"))
    rows = [(f"t{i}", f"= T{i}\nline {i}\n", f"<html><p data-mc-conditions='A'>x</p></html>", "unused") for i in range(20)]
    spark.createDataFrame(rows, "path string, text string, html string, other string").write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def test_row_local_work_does_not_shuffle(spark, tmp_path_factory):
    t = topics(spark, tmp_path_factory)
    for df in (
        quality.quality_scores(t), conditions.extract_conditions(t), conditions.elements(t), rules.auto_fix(t),
        rules.rule_orphaned_continuation(t), rules.rule_image_macro(t), links.extract_links(t, "help-center"),
    ):
        assert "Exchange" not in plan(df)


def test_columns_are_pruned(spark, tmp_path_factory):
    text = plan(quality.quality_scores(topics(spark, tmp_path_factory)))
    assert "ReadSchema: struct<path:string,text:string>" in text


def test_filters_reach_the_scan(spark, tmp_path_factory):
    text = plan(rules.rule_table_syntax(topics(spark, tmp_path_factory)))
    assert "StringContains(text,|===)" in text


def test_no_cross_joins(spark, tmp_path_factory):
    t = topics(spark, tmp_path_factory)
    found = links.validate_links(links.extract_links(t, "help-center"), t.select("path"))
    for df in (links.link_report(found), links.top_broken(found)):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_hot_target(spark):
    """A page that most links point to, and many links with no key at all."""
    rows = spark.range(30000).select(
        F.concat(F.lit("d/p"), F.col("id").cast("string"), F.lit(".htm")).alias("path"),
        F.lit(1).alias("line_no"), F.lit(0).alias("form"), F.lit(0).alias("pos"),
        F.when(F.col("id") % 3 == 0, "hub.htm").when(F.col("id") % 3 == 1, "#x").otherwise("gone.htm").alias("url"),
        F.lit("t").alias("text"),
    )
    files = spark.createDataFrame([("d/hub.htm",)], "path string")
    report = links.link_report(links.validate_links(rows, files)).first()
    assert (report["internal_valid"], report["internal_broken"], report["anchors_valid"]) == (10000, 10000, 10000)


def test_hot_session(spark):
    rows = spark.range(50000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("session_id"),
        F.lit("file_complete").alias("type"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("seq"),
        F.struct(
            F.lit(0).alias("totalFiles"), F.lit("a").alias("currentFile"), F.lit("").alias("message"), F.lit("").alias("error")
        ).alias("data"),
    )
    spans = progress.session_windows(rows).filter("session_id = 'hot'").collect()
    assert len(spans) == 1 and spans[0]["events"] == 16667
    assert progress.session_state(rows).filter("session_id = 'hot'").first()["completed_files"] == 16667


def test_deep_toc(spark):
    """A chain of 12 levels under one root, beside a root with many leaves."""
    chain = [("t", i, i - 1 if i else None, 0, i, f"n{i}", None) for i in range(12)]
    leaves = [("t", 100 + i, 0, i + 1, 1, f"l{i}", f"x/l{i}.htm") for i in range(2000)]
    toc = spark.createDataFrame(
        chain + leaves,
        "toc_path string, entry_id bigint, parent_id bigint, ordinal int, level int, title string, href string",
    )
    rows = hierarchy.with_ancestors(toc)
    assert rows.filter("entry_id = 11").select(F.size("ancestors")).first()[0] == 11
    assert rows.filter("size(ancestors) = 1").count() == 2001
    assert hierarchy.plan_toc(toc).filter("output_path = 'n0/n0/l7.adoc'").count() == 1


SMALL = "/root/testdata/sf0.001"
#: Queries whose plans once read the texts several times, ran Python over them or held a cartesian product.
WATCHED = [
    "validation_summary", "validation_lenient", "image_resolution", "variables_resolved", "snippet_resolution", "broken_targets",
    "glossary_usage", "topics_filtered", "chunks_of_blocks", "project_inventory", "toc_plan", "toc_file_map",
]


def test_watched_plans(spark):
    """At most one scan with a text column is left; no Python; no product of tables, with automatic broadcasts off."""
    from __spark_entry__ import queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in WATCHED:
            text = plan(queries()[name](spark, SMALL))
            initial = text.split("== Initial Plan ==")[-1]
            scans = [x for x in initial.split("\n") if "FileScan" in x and "/documents.parquet" in x and "text" in x.split("ReadSchema")[-1]]
            assert len(scans) <= 1, (name, len(scans))
            assert not any(x in text for x in ("CartesianProduct", "NestedLoop", "EvalPython", "InPandas")), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unmarked_topics_are_not_shuffled(spark):
    """Topics without a reference take a branch of their own, which has no exchange."""
    from docweft.operators import snippets, variables

    topics = spark.createDataFrame([(f"t{i}", "<p>x</p>") for i in range(20)], "path string, html string")
    defs = spark.createDataFrame([(1, "A.B", "v")], "ord int, name string, value string")
    files = spark.createDataFrame([("s.flsnp", "<b/>")], "path string, content string")
    for df in (snippets.inline_snippets(topics, files), variables.flatten_variables(topics, defs)):
        branch = df._jdf.queryExecution().optimizedPlan().toString().split("Union")[-1]
        assert "NOT coalesce(RLIKE(html" in branch
        last = branch.split("NOT coalesce(RLIKE(html")[0].split("\n")[-1]
        assert "Join" not in last and df.count() == 20


def test_deep_chain(spark):
    """A chain of 200 levels takes eight joins."""
    toc = spark.createDataFrame(
        [("t", i, i - 1 if i else None, 0, i, f"n{i}", None) for i in range(200)],
        "toc_path string, entry_id bigint, parent_id bigint, ordinal int, level int, title string, href string",
    )
    rows = hierarchy.with_ancestors(toc)
    assert rows.filter("entry_id = 199").select(F.col("ancestors")[0]["title"].alias("t"), F.size("ancestors").alias("n")).first() == ("n0", 199)
    assert plan(rows).count("Join") <= 2
