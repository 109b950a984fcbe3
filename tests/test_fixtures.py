"""Small exact cases worked out by hand."""

from pyspark.sql import functions as F

from docweft.functions import paths as P
from docweft.functions import text as T
from docweft.operators import (
    blocks,
    citations,
    conditions,
    glossary,
    hierarchy,
    images,
    links,
    matching,
    quality,
    rules,
    runs,
    variables,
)
from docweft.sources import corpus, project_xml


def one(spark, column, **values):
    """Evaluate a column over one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()[0]


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def topics(spark, *htmls, column="html"):
    return spark.createDataFrame([(f"t{i}.htm", h) for i, h in enumerate(htmls)], f"path string, {column} string")


def test_condition_usage(spark):
    t = topics(
        spark,
        '<html><p data-mc-conditions="Draft">a</p></html>',
        '<html><p madcap:conditions="Internal, Beta">b</p><p madcap:conditions="Beta">c</p></html>',
        "<html><p data-mc-conditions='Deprecated, Beta'>c</p></html>",
    )
    found = conditions.extract_conditions(t)
    usage = conditions.condition_usage(found)
    assert rows(usage, "condition", "usage") == [("Beta", 2), ("Deprecated", 1), ("Draft", 1), ("Internal", 1)]
    assert conditions.analyzed_files(t).first()[0] == 3
    report = conditions.condition_report(usage)
    assert rows(report.filter("recommended_exclusion"), "condition") == [("Deprecated",), ("Draft",)]
    assert [r["category"] for r in report.collect()] == ["status", "development", "development", "visibility"]


def test_condition_categories(spark):
    expected = {
        "Alpha": "development", "Beta": "development", "CustomerPortal.Advanced": "custom", "Deprecated": "status",
        "Development": "custom", "Draft": "development", "Hidden": "visibility", "Internal": "visibility",
        "Legacy": "status", "Maintenance": "custom", "Obsolete": "status", "OnlineOnly": "print",
        "Print-Only": "print", "Red": "color",
    }
    df = spark.createDataFrame([(c, 1) for c in expected], "condition string, usage bigint")
    info = conditions.condition_info(df).collect()
    assert {r["condition"]: r["category"] for r in info} == expected
    assert sorted(r["condition"] for r in info if r["is_deprecated"]) == ["Deprecated", "Legacy", "Obsolete", "Red"]


def test_condition_parse(spark):
    parse = conditions.parse_conditions(F.col("c"))
    assert one(spark, parse, c='General.A; "Default.B" ,, c d') == ["A", "B", "c d"]
    assert one(spark, parse, c="  ") == []


def test_two_attributes_glue(spark):
    t = topics(spark, '<html><p madcap:conditions="A,B" data-mc-conditions="C">x</p></html>')
    assert rows(conditions.extract_conditions(t), "condition") == [("A",), ("B C",)]
    assert rows(conditions.extract_conditions(t, "regex"), "condition") == [("A",), ("B",), ("C",)]


def test_element_filter(spark):
    t = topics(
        spark,
        '<p>plain</p><p madcap:conditions="General.Deprecated">d</p><p data-mc-conditions="Beta">b</p>'
        '<p data-mc-conditions="Internal, Draft">i</p><p data-mc-conditions="">e</p>',
    )
    e = conditions.elements(t)

    def texts(df):
        return [r["text"] for r in df.orderBy("element_no").collect()]

    assert texts(conditions.filter_elements(e, exclude=["Deprecated"])) == ["plain", "b", "i", "e"]
    assert texts(conditions.filter_elements(e, include=["Beta"])) == ["plain", "b"]
    assert texts(conditions.filter_elements(e, include=["Draft"], exclude=["Internal"])) == ["plain"]
    assert texts(conditions.apply_preset(e, "no-filter")) == ["plain", "d", "b", "i", "e"]


def test_remove_conditioned(spark):
    t = topics(
        spark,
        '<p>a</p><div data-mc-conditions="General.Old"><div>x<br>y</div><p>z</p></div><p>b</p>'
        '<img madcap:conditions="Old"/><p madcap:conditions="New">c</p><li data-mc-conditions="Old">d<p>e</p>',
        "<p>plain</p>",
    )
    got = {r["path"]: r["html"] for r in conditions.remove_conditioned(t, exclude=["Old"]).collect()}
    mark = conditions.REMOVED_MARK.format("Old")
    assert got["t0.htm"] == f'<p>a</p>{mark}<p>b</p>{mark}<p madcap:conditions="New">c</p>{mark}<p>e</p>'
    assert got["t1.htm"] == "<p>plain</p>"
    kept = conditions.remove_conditioned(t, include=["New"]).filter("path = 't0.htm'").first()["html"]
    assert ">c</p>" in kept and "<p>a</p>" in kept and "x<br>" not in kept
    assert conditions.remove_conditioned(t).count() == 2


def test_presets(spark):
    assert conditions.presets(spark).count() == 6
    raw = spark.createDataFrame(
        [('[{"id":"x","name":"X","includeConditions":["A"]},{"name":"no id"}]',), ("not json",)], "value string"
    )
    got = conditions.read_presets(raw).collect()
    assert [(r["preset_id"], r["include"], r["exclude"]) for r in got] == [("x", ["A"], [])]


def test_variable_files(spark):
    general = (
        '<?xml version="1.0"?><CatapultVariableSet><Variable Name="CompanyName" Definition="Acme"/>'
        '<Variable Name="Version" Definition="1" EvaluatedDefinition=""/><Variable Definition="none"/></CatapultVariableSet>'
    )
    test = '<CatapultVariableSet><Variable Name="CompanyName"> Test Inc \n</Variable></CatapultVariableSet>'
    files = spark.createDataFrame(
        [("Project/VariableSets/General.flvar", general), ("Project/VariableSets/test.flvar", test),
         ("x/bad.flvar", "<Other/>")],
        "path string, content string",
    )
    defs = project_xml.read_variable_defs(files)
    assert rows(defs, "set_name", "name", "value") == [
        ("General", "CompanyName", "Acme"), ("General", "Version", "1"), ("test", "CompanyName", "Test Inc"),
    ]
    merged = variables.merge_variables(defs).orderBy("position").collect()
    assert [(r["name"], r["value"]) for r in merged] == [("CompanyName", "Test Inc"), ("Version", "1")]
    assert rows(project_xml.variable_file_errors(files), "path") == [("x/bad.flvar",)]
    assert corpus.variable_files(files).count() == 2


def test_variable_lookup(spark):
    defs = spark.createDataFrame(
        [(1, "CompanyName", "Acme"), (2, "General.Full", "F"), (3, "Empty", "")], "ord int, name string, value string"
    )
    refs = spark.createDataFrame(
        [("General.CompanyName",), ("CompanyName",), ("No.Variable",), ("General.Full",), ("X.Empty",)], "ref string"
    )
    got = {r["ref"]: r["value"] for r in variables.resolve_variables(refs, defs).collect()}
    assert got == {
        "General.CompanyName": "Acme", "CompanyName": None, "No.Variable": None, "General.Full": "F", "X.Empty": None,
    }


def test_variable_text(spark):
    defs = spark.createDataFrame([(1, "ProductName", "Loom")], "ord int, name string, value string")
    t = topics(
        spark,
        'A <MadCap:variable name="General.ProductName"/> B <MadCap:variable name="General.No">shown</MadCap:variable>'
        ' C <span class="mc-variable General.ProductName variable">General.ProductName</span>'
        ' D <MadCap:variable name="General.No" /> {free} {not free}',
    )
    flat = variables.flatten_variables(t, defs).first()["html"]
    assert flat == "A Loom B shown C Loom D {General.No} {free} {not free}"
    ref = variables.reference_variables(t, defs).first()["html"]
    assert ref.startswith("A {product-name} B {no} C {product-name} D {no}")
    other = variables.reference_variables(t, defs, "writerside").first()["html"]
    assert other.startswith('A <var name="General.ProductName"/> B')
    refs = variables.variable_refs(t)
    assert rows(refs.filter("form = 'fallback'"), "ref") == [("free",)]
    assert refs.filter("form = 'madcap'").count() == 4


def test_names(spark):
    assert one(spark, T.var_name(F.col("c")), c="General.ProductName") == "general-product-name"
    for convention, shown in (("camelCase", "companyName"), ("kebab-case", "company-name"), ("snake_case", "company_name")):
        assert one(spark, T.rename(F.col("c"), convention), c="CompanyName") == shown
    assert one(spark, T.rename(F.col("c"), "camelCase"), c="version-number") == "versionNumber"
    assert one(spark, T.var_name(F.col("c"), "xml"), c="1 a") == "__a"
    assert one(spark, T.slug(F.col("c")), c="Create a New  Activity!") == "create-a-new-activity"
    assert one(spark, T.slug(F.col("c")), c="A_B") == "a-b"
    assert one(spark, T.slug(F.col("c"), "id"), c="1 x") == "id-1-x"
    assert one(spark, T.slug(F.col("c"), "folder"), c="-A: b-") == "a-b"


def test_suggestions(spark):
    defs = spark.createDataFrame(
        [(1, "CompanyName"), (2, "CompanyShort"), (3, "ProductName"), (4, "x" * 50)], "ord int, name string"
    )
    missing = spark.createDataFrame([("Company",), ("ProductNme",), ("Zzz",), ("x" * 20 + "yy" + "x" * 28,)], "name string")
    got = {r["name"]: r["suggestions"] for r in variables.suggest_variables(missing, defs).collect()}
    assert got["Company"] == ["CompanyName", "CompanyShort"]
    assert got["ProductNme"] == ["ProductName"]
    assert got["Zzz"] == []
    assert got["x" * 20 + "yy" + "x" * 28] == ["x" * 50]


def test_missing_variables(spark):
    defs = spark.createDataFrame([(1, "Known", "v")], "ord int, name string, value string")
    t = topics(spark, "ok {Known}\n a { Lost } and [%=Gone%]", column="text")
    got = variables.missing_variables(t, defs)
    assert ("Lost", 2, 0) in rows(got, "name", "line_no", "form")
    assert ("Gone", 2, 1) in rows(got, "name", "line_no", "form")


def test_link_extraction(spark):
    t = topics(spark, "link:a.adoc[A] xref:b.htm#s[B] image::p.png[] image:q.png[]\ninclude::x.adoc[]", column="text")
    strict = links.extract_links(t, "asciidoc", "text", strict_reference=True)
    assert [r["url"] for r in strict.orderBy("line_no", "form", "pos").collect()] == ["a.adoc", "b.htm#s", "p.png", "x.adoc"]
    loose = links.extract_links(t, "asciidoc", "text")
    assert "q.png" in [r["url"] for r in loose.collect()]
    m = topics(spark, "[t](u.md) ![i](p.png)\n [r]: z.md", column="text")
    assert [r["url"] for r in links.extract_links(m, "markdown", "text").orderBy("line_no", "form", "pos").collect()] == [
        "u.md", "p.png", "z.md",
    ]
    assert links.extract_links(m, "writerside", "text", strict_reference=True).count() == 0


def test_link_types(spark):
    for url, kind in {
        "#x": "anchor", "mailto:a@b": "external", "a.png#f": "image", "a": "internal", "a.htm": "internal", "a.pdf": "unknown",
    }.items():
        assert one(spark, P.link_type(F.col("u")), u=url) == kind
    assert one(spark, P.valid_external(F.col("u")), u="https://e.com/a b")
    assert not one(spark, P.valid_external(F.col("u")), u="http://")


def test_link_resolution(spark):
    files = spark.createDataFrame([("out/a.adoc",), ("out/b.adoc",)], "path string")
    found = spark.createDataFrame(
        [("out/a.adoc", 1, 0, 0, "b.htm", ""), ("out/a.adoc", 2, 0, 0, "c.htm", ""), ("out/a.adoc", 3, 0, 0, "x.pdf", "")],
        "path string, line_no int, form int, pos int, url string, text string",
    )
    results = links.validate_links(found, files, "asciidoc")
    assert {r["url"]: r["resolved"] for r in results.collect()} == {"b.htm": "out/b.adoc", "c.htm": None, "x.pdf": None}
    report = links.link_report(results).first()
    assert (report["total_links"], report["internal_valid"], report["internal_broken"]) == (3, 1, 2)
    assert rows(links.broken_targets(found, files, "asciidoc"), "target") == [("out/c.htm",)]


def test_link_rewrite(spark):
    mapping = spark.createDataFrame(
        [("x/guide.htm", "x/user-guide.adoc", 1), ("y/guide.htm", "y/other.adoc", 2)], "old_path string, new_path string, ord int"
    )
    found = spark.createDataFrame([("z.adoc", "../y/guide.htm#s"), ("q/z.adoc", "http://x")], "out_path string, url string")
    got = {r["url"]: r["new_url"] for r in links.rewrite_links(found, mapping).collect()}
    assert got == {"../y/guide.htm#s": "x/user-guide.adoc#s", "http://x": "http://x"}


def test_fuzzy(spark):
    left = spark.createDataFrame([("abc.adoc",), ("ab",), ("zzzzzzzz",), ("guide.adoc",)], "link string")
    mapping = spark.createDataFrame(
        [("abd.adoc", "one", 1), ("abd.adoc", "late", 2), ("my-guide.adoc", "two", 3), ("xy", "three", 4)],
        "mapped string, value string, ord int",
    )
    got = {r["link"]: (r["value"], round(r["score"], 4)) for r in links.fuzzy_paths(left, mapping).collect()}
    assert got["abc.adoc"] == ("one", round(6 / 7, 4))
    assert got["guide.adoc"] == ("two", 0.8)
    assert "zzzzzzzz" not in got
    half = links.fuzzy_paths(
        spark.createDataFrame([("ax",)], "link string"),
        spark.createDataFrame([("bx", "v", 1)], "mapped string, value string, ord int"),
    )
    assert half.count() == 0


def test_toc_link_rewrite(spark):
    mapping = spark.createDataFrame(
        [("Content/03-1-a b.htm", "user/x/03-1-a b.adoc", "x/03-1-a-b.adoc", 1), ("c/d.htm", "y/d.adoc", "y/d.adoc", 2)],
        "old_path string, toc_path string, actual_path string, ord int",
    )
    written = ["03-120a badoc.adoc#s", "03-1-ab.adoc", "D.adoc", "http://x", "#a", "far-away-thing.adoc"]
    found = spark.createDataFrame([("y/index.adoc", w) for w in written], "out_path string, url string")
    got = {r["url"]: r["new_url"] for r in links.rewrite_toc_links(found, mapping).collect()}
    assert got["03-120a badoc.adoc#s"] == "../x/03-1-a-b.adoc#s"
    assert got["03-1-ab.adoc"] == "../x/03-1-a-b.adoc"
    assert got["D.adoc"] == "D.adoc" and got["http://x"] == "http://x" and got["#a"] == "#a"
    near = {r["url"]: r["new_url"] for r in links.rewrite_toc_links(found, mapping, fuzzy=True).collect()}
    assert near["D.adoc"] == "d.adoc" and near["far-away-thing.adoc"] == "far-away-thing.adoc"


def test_matching_against_brute_force(spark):
    import random

    rng = random.Random(7)
    left = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    right = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    a = spark.createDataFrame([(x,) for x in left], "a string")
    b = spark.createDataFrame([(x,) for x in right], "b string")
    inside = {(r["a"], r["b"]) for r in matching.containment_pairs(a, b).collect()}
    assert inside == {(x, y) for x in left for y in right if x in y or y in x}

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, cx in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, cy in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (cx != cy))
        return row[-1]

    near = {(r["a"], r["b"]) for r in matching.within_two_edits(a, b).collect()}
    assert near == {(x, y) for x in left for y in right if distance(x, y) <= 2}

    long_left = ["".join(rng.choice("abcdef") for _ in range(rng.randint(13, 40))) for _ in range(40)]
    long_right = []
    for x in long_left:
        i, j = sorted(rng.sample(range(len(x)), 2))
        long_right += [x[:i] + x[i + 1:], x[:i] + "z" + x[i:j] + x[j + 1:], x[:i] + "zz" + x[i:], x[:i] + "zzz" + x[i:]]
    a = spark.createDataFrame([(x,) for x in long_left], "a string")
    b = spark.createDataFrame([(x,) for x in long_right], "b string")
    near = {(r["a"], r["b"]) for r in matching.within_two_edits(a, b).collect()}
    assert near == {(x, y) for x in long_left for y in long_right if distance(x, y) <= 2}

    best = {r["a"]: r["value"] for r in matching.best_similar(
        spark.createDataFrame([(x,) for x in left], "a string"),
        spark.createDataFrame([(y, i, y) for i, y in enumerate(right)], "b string, ord int, value string"),
    ).collect()}

    def score(x, y):
        if x == y:
            return 1.0
        if x in y or y in x:
            return 0.8
        n = max(len(x), len(y))
        return (n - distance(x, y)) / n

    for x in left:
        scored = [(-score(x, y), i, y) for i, y in enumerate(right) if score(x, y) > 0.5]
        assert best.get(x) == (min(scored)[2] if scored else None)


def test_contained_first(spark):
    mapping = spark.createDataFrame(
        [("Content/long-guide.htm", "one", 1), ("Content/guide.htm", "two", 2)], "old_path string, value string, ord int"
    )
    got = links.match_contains(spark.createDataFrame([("../x/guide.adoc",), ("zz",)], "link string"), mapping)
    assert rows(got, "link", "value") == [("../x/guide.adoc", "one")]


def test_quality(spark):
    t = spark.createDataFrame([("empty", ""), ("good", "= Title\n" + "word " * 50)], "path string, text string")
    got = {r["path"]: (r["score"], r["band"]) for r in quality.quality_scores(t).collect()}
    assert got == {"empty": (80, "Good"), "good": (100, "Excellent")}
    line = "a line of twenty-five chars"
    d = topics(spark, f"x\n{line}\ny\nz\n{line} \nq\nq\nq\n {line}\n{'b' * 20}\n{'b' * 20}", column="text")
    assert rows(quality.issues_duplicates(d), "message") == [("Duplicate content found on lines 2, 5, 9",)]
    e = topics(spark, "= T\nIt is â€™ here", column="text")
    assert quality.quality_issues(e).filter("rank = 11").count() == 2


def test_rules(spark):
    t = topics(spark, "|===\n|a\nb", column="text")
    got = rules.rule_table_syntax(t)
    assert rows(got, "line", "message") == [(1, rules.TEXTS["open_table"][0]), (3, rules.TEXTS["row"][0])]
    s = rules.validation_summary(t, rules.validate(t)).first()
    assert (s["error_count"], s["status"]) == (2, "errors")
    capped = rules.validation_summary(t, rules.validate(t), cap=2).first()
    assert capped["rules_applied"] == "orphaned-continuation,broken-list-structure,invalid-table-syntax"
    assert rules.select_rules(strictness="lenient") == ["broken-list-structure", "invalid-table-syntax", "invalid-image-macro"]
    fixed = rules.auto_fix(topics(spark, "a\n\n+\n\n\n\nb\n[NOTE]\n====\nx", column="text")).first()
    assert fixed["fixed"] == "a\n\nb\n\n[NOTE]\n====\n\nx"


def test_rule_plug_in(spark):
    def no_tabs(t, text="text"):
        hit = t.filter(F.col(text).contains("\t"))
        return hit.select(
            "path", F.lit("no-tabs").alias("rule_id"), F.lit("info").alias("severity"), F.lit("Tab").alias("message"),
            F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit(0).alias("check"), F.lit("").alias("suggestion"),
        )

    rules.register_rule("no-tabs", "info", no_tabs)
    try:
        t = topics(spark, "a\tb", column="text")
        assert rules.validate(t).filter("rule_id = 'no-tabs'").count() == 1
    finally:
        del rules.RULES["no-tabs"], rules.RULE_SEVERITY["no-tabs"]


def test_list_starts(spark):
    data = [("t", i, c, n) for i, (n, c) in enumerate([(3, False), (2, True), (1, True), (2, False), (4, True)])]
    df = spark.createDataFrame(data, "path string, list_no int, continues boolean, items int")
    assert [r["start"] for r in blocks.list_starts(df).orderBy("list_no").collect()] == [1, 4, 6, 1, 3]


def test_numbered_runs(spark):
    data = [("t", i, n, "x") for i, n in enumerate([1, 2, 3, 1, 2, 5, 6, 9])]
    df = spark.createDataFrame(data, "path string, ord int, number bigint, content string")
    got = blocks.numbered_runs(df).orderBy("ord").collect()
    assert [(r["number"], r["place"]) for r in got] == [(1, 1), (2, 2), (3, 3), (1, 1), (2, 2), (5, 1), (6, 2)]


def test_column_weights(spark):
    cells = spark.createDataFrame(
        [("t", 0, 0, "abcd"), ("t", 0, 1, "abc"), ("t", 0, 2, "abcdefgh"), ("t", 0, 0, "a")],
        "path string, table_no int, col_no int, content string",
    )
    assert [r["weight"] for r in blocks.column_specs(cells).orderBy("col_no").collect()] == [3, 2, 5]


def test_table_cells(spark):
    t = topics(
        spark,
        "<table><thead><tr><td>H</td></tr></thead><tbody><tr><td align='center'><b>x|y</b></td>"
        "<td style=\"text-align: right\" rowspan=\"2\">a<br/>b</td></tr></tbody></table>",
    )
    got = blocks.table_cells(t).orderBy("row_no", "col_no").collect()
    assert [(r["is_header"], r["content"]) for r in got] == [(True, "H"), (False, "*x\\|y*"), (False, "a + b")]
    assert (got[1]["alignment"], got[1]["format"], got[2]["alignment"], got[2]["rowspan"]) == ("center", "strong", "right", 2)


def toc_rows(spark):
    return spark.createDataFrame(
        [("p/Toc.fltoc", 0, None, 0, 0, "A", "a.htm"), ("p/Toc.fltoc", 1, 0, 0, 1, "A1", "a1.htm"),
         ("p/Toc.fltoc", 2, None, 1, 0, "B", None), ("p/Toc.fltoc", 3, 2, 0, 1, "B1", "b/b1.htm")],
        "toc_path string, entry_id int, parent_id int, ordinal int, level int, title string, href string",
    )


def test_toc_plan(spark):
    toc = toc_rows(spark)
    plan = hierarchy.plan_toc(toc).orderBy("sort_key").collect()
    assert [r["output_path"] for r in plan] == ["a/a.adoc", "a/a1.adoc", None, "a/b/b1.adoc"]
    assert hierarchy.toc_counts(toc).filter("toc_path is null").first()["entries"] == 4
    lines = [r["line"] for r in hierarchy.render_master(toc).orderBy("sort_key", "seq").collect()]
    assert lines[0] == "= A" and lines[-4:] == ["=== B1", "", "include::b1.adoc[]", ""] and "== B" in lines


def test_toc_file(spark):
    xml = (
        '<CatapultToc><TocEntry Title="A" Link="a.htm"><TocEntry Title="A1" Link="a1.htm"/></TocEntry>'
        '<TocEntry Title="B"><TocEntry Title="B1" Link="b/b1.htm"/></TocEntry></CatapultToc>'
    )
    files = spark.createDataFrame([("p/Toc.fltoc", xml), ("p/bad.fltoc", "<x"), ("p/none.fltoc", None)], "path string, content string")
    toc = project_xml.read_toc(files)
    assert [r["level"] for r in toc.orderBy("entry_id").collect()] == [0, 1, 0, 1]
    plan = hierarchy.plan_toc(toc).orderBy("sort_key").collect()
    assert [r["output_path"] for r in plan] == ["a/a.adoc", "a/a1.adoc", None, "a/b/b1.adoc"]


def test_toc_names(spark):
    for name, kept in {"Online.fltoc": True, "User Print.fltoc": False, "toc.fltoc": True, "other.fltoc": False}.items():
        assert one(spark, corpus.keep_toc(F.col("n")), n=name) is kept


def test_glossary(spark):
    xml = (
        '<CatapultGlossary><GlossaryEntry glossTerm="g1" conditions="General.Print"><Terms><Term>Activity</Term><Term>Task</Term></Terms>'
        '<Definition Link="x.htm">A thing</Definition></GlossaryEntry><GlossaryEntry><Terms><Term>3D</Term></Terms>'
        "<Definition><p>Deep</p><ul><li>a</li></ul></Definition></GlossaryEntry>"
        "<GlossaryEntry><Terms/><Definition>no term</Definition></GlossaryEntry></CatapultGlossary>"
    )
    files = spark.createDataFrame([("g.flglo", xml)], "path string, content string")
    g = project_xml.read_glossary(files)
    got = g.orderBy("ord").collect()
    assert [(r["id"], r["terms"], r["link"]) for r in got] == [("g1", ["Activity", "Task"], "x.htm"), ("glossary-1", ["3D"], None)]
    assert got[1]["definition"] == "<p>Deep</p><ul><li>a</li></ul>"
    groups = glossary.glossary_groups(g)
    assert rows(groups, "letter", "anchor") == [("#", "glossary-3d"), ("A", "glossary-activity")]
    assert glossary.filter_glossary(g, ["PRINT"]).count() == 1
    assert glossary.filter_glossary(g, False).count() == 2
    text = [r["line"] for r in glossary.render_glossary(g).orderBy("sort_key").collect()]
    assert text[:6] == ["= Glossary", ":toc:", ":icons: font", "", "== #", ""]
    assert "_Also: Task_" in text
    appendix = [r["line"] for r in glossary.render_glossary(g, "appendix").orderBy("sort_key").collect()]
    assert "Activity, Task::" in appendix
    used = glossary.glossary_usage(topics(spark, "<MadCap:glossaryTerm>task</MadCap:glossaryTerm> <MadCap:glossaryTerm>x</MadCap:glossaryTerm>"), g)
    assert {r["term"]: r["id"] for r in used.collect()} == {"task": "g1", "x": None}


def test_citations(spark):
    t = topics(
        spark,
        '(Smith, 2023) (Johnson and Wilson, 2022) [1] <a href="#fn1">1</a><p id="fn1">Body</p> <a href="#fn2">2</a>',
    )
    got = citations.citations(t)
    assert rows(got, "type", "content") == [("inline", "Smith, 2023"), ("reference", "[1]")]
    notes = citations.link_footnotes(t).orderBy("pos").collect()
    assert [(n["content"], n["warning"]) for n in notes] == [
        ("Body", None), (None, "Footnote reference 2 found but content missing"),
    ]
    section = [r["line"] for r in citations.reference_section(t).orderBy("ord", "seq").collect()]
    assert section == ["== References", "", "[[cite_2]]", "Smith (2023). Smith, 2023", ""]


def test_math(spark):
    assert one(spark, T.rewrite_math(F.col("c")), c="$E = mc^2$") == "latexmath:[E = mc^2]"
    assert one(spark, T.rewrite_math(F.col("c")), c="H<sub>2</sub>O") == "H~2~O"
    assert one(spark, T.rewrite_math(F.col("c")), c="3.0 × 10^8") == "3.0 × 10^8^"
    assert one(spark, T.has_math(F.col("c")), c="π") and not one(spark, T.has_math(F.col("c")), c="pi")
    assert one(spark, T.rewrite_math(F.col("c"), "markdown"), c="$ a $") == "$a$"


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("c")), c="One. Two! three? Four") == ["One.", "Two! three?", "Four"]
    assert one(spark, T.paragraphs(F.col("c")), c="a\n \nb\n\n") == ["a", "b"]
    assert one(spark, T.tokens(F.col("c")), c="users' list (a, b).") == ["users'", "list", "(", "a", ",", "b", ")", "."]
    assert one(spark, T.join_fragments(F.array(F.lit(" a "), F.lit(","), F.lit("b"))), c="") == "a, b"
    assert one(spark, T.text_chunks(F.col("c"), 2), c="abcde") == ["ab", "cd", "e"]


def test_cleaning(spark):
    assert one(spark, T.clean_text(F.col("c")), c=" “a” –  b\r\n\r\n\r\n\r\n c… ") == '"a" - b\n\nc...'
    assert one(spark, T.decode_entities(F.col("c")), c="&amp;lt;b&gt; &#x41;x &#xe9;") == "<b> Ax é"
    assert one(spark, P.decode_url(F.col("c")), c="a%20b+c") == "a b+c"
    assert one(spark, P.decode_url(F.col("c")), c="bad%zz") == "bad%zz"
    assert one(spark, T.space_sentences(F.col("c")), c="a.B?C!d") == "a. B? C!d"
    assert one(spark, T.sanitize_text(F.col("c")), c=" a..b\x08 ") == "a.b"
    assert one(spark, T.format_bytes(F.col("c")), c=1536) == "1.5 KB"
    assert one(spark, T.format_bytes(F.col("c")), c=100 * 1024 * 1024) == "100 MB"


def test_path_rules(spark):
    resolved, fired = P.apply_path_rules(P.clean_path(F.col("p")))
    assert one(spark, resolved, p=".\\Images\\a b.png") == "Images/a b.png"
    assert one(spark, fired, p=".\\Images\\a b.png") == ["remove-current-dir-prefix"]
    assert one(spark, P.relative_path(F.col("p"), F.lit("x/b.adoc"), F.lit("s")), p="x/a.adoc") == "b.adoc#s"
    assert one(spark, P.relative_path(F.col("p"), F.lit("y/b.adoc")), p="x/q/a.adoc") == "../../y/b.adoc"
    assert one(spark, P.normalize(F.col("p")), p="a/./b/../../../c") == "../c"
    assert one(spark, P.normalize(F.col("p")), p="/a/../../c") == "/c"
    assert one(spark, P.alt_text(F.col("p")), p="x/my-new_iMage.png") == "My New IMage"
    assert one(spark, P.extname(F.col("p")), p=".bashrc") == ""
    assert one(spark, P.stem(F.col("p")), p="a/b.c.htm") == "b.c"


def test_problem_inputs(spark):
    files = spark.createDataFrame(
        [("", 1, ""), ("a/../b.exe", 1, "plain"), ("x" * 4100, 200 * 1024 * 1024, "<b>")], "path string, size bigint, content string"
    )
    kinds = rows(corpus.lint_paths(files), "type")
    assert kinds.count(("error",)) == 4 and kinds.count(("warning",)) == 1
    assert rows(corpus.lint_content(files), "type") == [("error",), ("warning",)]


def test_images(spark):
    tag = F.col("t")
    assert one(spark, images.image_kind(tag), t='<img src="a/Screens/x.png" width="10" height="10">') == "block"
    assert one(spark, images.image_kind(tag), t='<img src="a.png" style="width: 20px; height: 20px">') == "inline"
    assert one(spark, images.image_class(tag), t='<img src="a/Screens/x.png" width="36">') == "icon"
    files = spark.createDataFrame([("Images/a.png",), ("deep/z/b.png",), ("deep/a/b.png",)], "path string")
    refs = spark.createDataFrame([("Content/t.htm", 0, "../Images/a.png"), ("Content/t.htm", 1, "q/b.png"), ("Content/t.htm", 2, "c.png")],
                                 "path string, pos int, src string")
    got = {r["src"]: r["found"] for r in images.resolve_images(refs, files).collect()}
    assert got == {"../Images/a.png": "Images/a.png", "q/b.png": "deep/a/b.png", "c.png": None}
    assert rows(images.missing_images(refs, files), "src") == [("c.png",)]


def test_blocks(spark):
    t = topics(spark, '<h2>T</h2><p class="mc-warning">w</p><ul><li>a <b>b</b></li></ul><pre>x</pre><p>p</p>')
    b = blocks.blocks(t)
    assert [(r["kind"], r["text"]) for r in b.orderBy("block_no").collect()] == [
        ("heading", "T"), ("admonition", "w"), ("item", "a b"), ("code", "x"), ("paragraph", "p"),
    ]
    text = blocks.assemble_topics(blocks.render_blocks(b)).first()["text"]
    assert text == "== T\n\nWARNING: w\n\n* a b\n\n----\nx\n----\n\np"
    packed = blocks.chunk_blocks(t, 40).orderBy("chunk_no").collect()
    assert [(r["chunk_no"], r["blocks"], r["chunk"]) for r in packed] == [
        (0, 2, '<h2>T</h2><p class="mc-warning">w</p>'), (1, 2, "<li>a <b>b</b></li></ul><pre>x</pre>"), (2, 1, "<p>p</p>"),
    ]


def test_outcome(spark):
    df = spark.createDataFrame([("converted",), ("error",), ("snippet",)], "status string")
    r = runs.run_outcome(df).first()
    assert (r["total"], r["converted"], r["errors"], r["skipped"]) == (3, 1, 1, 1)
    merged = runs.merge_outcomes(runs.run_outcome(df).unionByName(runs.run_outcome(df))).first()
    assert merged["total"] == 6


def test_review_and_tags(spark):
    html = F.col("h")
    assert one(spark, T.review_warnings(html), h="x MadCap:dropDown data-mc-conditions") == [T.REVIEW_CONDITIONS, T.REVIEW_DROPDOWNS]
    assert one(spark, T.review_warnings(html, F.lit("ab"), True), h="abcdef") == [T.REVIEW_LOSS]
    assert one(spark, T.suggest_tags(html, F.lit("FAQ")), h="<p>Install the user guide example</p>") == [
        "installation", "user-guide", "faq", "examples",
    ]
    assert one(spark, T.step_class(html), h="Click OK.") == "action"
    assert one(spark, T.step_class(html), h="The following items are listed here and this text is long enough to stop.") == "explanatory"
    assert one(spark, T.is_code_term(html), h="Ctrl + S") and not one(spark, T.is_code_term(html), h="hello world")
