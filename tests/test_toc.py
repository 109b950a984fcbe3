"""TOC flattening against a tree parser."""

import random
import xml.etree.ElementTree as ET
from xml.sax.saxutils import quoteattr

from pyspark.sql import functions as F

from docweft.operators import hierarchy, links
from docweft.sources import corpus, project_xml

NAMES = ["Title", "title", "Link", "href", "conditions"]
VALUES = ["", "A & B", "a<b", 'say "x"', "it's", "Überblick", "[%=System.LinkedTitle%]", "Content/a.htm", "two\nlines"]


def flattened(content):
    try:
        root = ET.fromstring(content or "")
    except ET.ParseError:
        return []
    out = []

    def walk(entry, parent, ordinal, level):
        number = len(out)
        out.append(None)
        kids = entry.findall("TocEntry")
        title = entry.get("Title") or entry.get("title") or "Untitled"
        out[number] = (number, parent, ordinal, level, title, entry.get("Link") or entry.get("href") or None, title == VALUES[6], len(kids))
        for k, kid in enumerate(kids):
            walk(kid, number, k, level + 1)

    for k, entry in enumerate(root.findall("TocEntry")):
        walk(entry, None, k, 0)
    return out


def drawn(rng, depth=0):
    name = "TocEntry" if rng.random() < 0.8 else rng.choice(["Other", "TocEntryX", "n.1"])
    some = rng.sample(NAMES, rng.randrange(4))
    attributes = "".join(f"{rng.choice([' ', chr(10)])}{n}{rng.choice(['=', ' = '])}{quoteattr(rng.choice(VALUES))}" for n in some)
    inner = "".join(drawn(rng, depth + 1) for _ in range(rng.randrange(4))) if depth < 5 else ""
    if not inner and rng.random() < 0.5:
        return f"<{name}{attributes} />"
    return f"<{name}{attributes}>{rng.choice(['', ' text &amp; ', '<!-- <TocEntry/> -->', '<![CDATA[<TocEntry>]]>'])}{inner}</{name}>"


def rows(spark, files):
    df = project_xml.read_toc(spark.createDataFrame(files, "path string, content string"))
    assert "Python" not in df._jdf.queryExecution().toString()
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    out = {}
    for r in df.collect():
        out.setdefault(r["toc_path"], []).append(tuple(r)[1:])
    return {k: sorted(v) for k, v in out.items()}


def test_against_a_tree_parser(spark):
    rng = random.Random(7)
    files = []
    for k in range(150):
        xml = f"<?xml version='1.0'?>\n<CatapultToc Version=\"1\">{''.join(drawn(rng) for _ in range(rng.randrange(5)))}</CatapultToc>"
        if k % 5 == 4:  # one character gone or doubled: mostly no longer well formed
            at = rng.randrange(len(xml))
            xml = xml[:at] + rng.choice(["", xml[at] * 2]) + xml[at + 1 :]
        files.append((f"t{k}", xml))
    want = {p: flattened(x) for p, x in files}
    got = rows(spark, files)
    assert sum(map(len, want.values())) > 1000 and [] in want.values()
    assert got == {p: w for p, w in want.items() if w}


def test_odd_files(spark):
    bodies = {
        "null": None, "empty": "", "text": "abc", "open": "<a>", "two": "<a/><a/>", "crossed": "<a><b></a></b>",
        "bare": "<a><TocEntry Title='x & y'/></a>", "stray": "<a>1 < 2</a>", "root": "<TocEntry Title='r'><TocEntry title='k'/></TocEntry>",
        "code": "<a><TocEntry Title='&#65;&#x1F600;&amp;lt;' Link='a&#38;b'/></a>", "mark": "﻿<a><TocEntry/></a>",
        "skipped": "<!-- <b> --><a><x><TocEntry Title='lost'/></x><TocEntry Title='kept'/></a>",
        "wide": "<a>" + "".join(f"<TocEntry Title='t{k}'/>" for k in range(3000)) + "</a>",
        "deep": "<a>" + "<TocEntry Title='d'>" * 300 + "</TocEntry>" * 300 + "</a>",
    }
    want = {p: flattened(x) for p, x in bodies.items()}
    assert rows(spark, list(bodies.items())) == {p: w for p, w in want.items() if w}
    assert project_xml.read_toc(spark.createDataFrame([], "path string, content string")).collect() == []


def test_path_order_reads_texts_once(spark):
    """Titles come from stored paths, so neither the filter nor the sampling of the order parses texts again."""
    topics = spark.createDataFrame([("a/x.htm", "<h1>One two</h1>"), ("b/y.htm", "<title>Three</title>")], "path string, html string")
    plan = links.plan_output_paths(topics, "markdown", rename=True)
    toc = hierarchy.toc_from_files(plan.select(F.col("path").alias("old_path"), F.col("out_path").alias("new_path")))
    assert "html" not in toc._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["old_path"], r["title"]) for r in toc.collect()] == [("a/x.htm", "One Two"), ("b/y.htm", "Three")]


def test_toc_files_are_dealt_out(spark):
    """A small file of many rows with much work each is not left to one task."""
    rows = spark.range(50_000).coalesce(1)
    dealt = corpus.dealt(rows, 20_000)
    assert dealt.rdd.getNumPartitions() == 3 and dealt.distinct().count() == 50_000
    assert corpus.dealt(rows.limit(0), 20_000).count() == 0
