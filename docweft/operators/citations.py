"""Citations, footnotes, bibliography entries, reference lists; audits of markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweft.functions.text import all_matches, any_of, first_match, nonempty, trim_ws
from docweft.operators.conditions import OPEN_TAG
from docweft.session import cut

# --- fixed values -----------------------------------------------------------
FOOTNOTE_REF = r"(?i)<a[^>]*href=[\"']#fn(\d+)[\"'][^>]*>(.*?)</a>"
FOOTNOTE_BODY = r"(?i)<(?:div|p)[^>]*id=[\"']fn(\d+)[\"'][^>]*>(.*?)</(?:div|p)>"
NUMBERED_REF = r"\[(\d+)\]"
AUTHOR_YEAR = r"\(([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),?\s+(\d{4})\)"
BIBLIOGRAPHY_ENTRY = (
    r"(?i)<(?:div|p)[^>]*class=[\"'][^\"']*(?:bibliography|reference|citation)[^\"']*[\"'][^>]*>(.*?)</(?:div|p)>"
)
DOI = r"(?i)doi:\s*(10\.\d+/[^\s<>]+)"
URL = r"(?i)(https?://[^\s<>]+)"
JOURNAL = (
    r"(?i)\"([^\"]+)\"\s+(?:in\s+)?([A-Z][^,.]+),?\s+(?:vol\.?\s*)?(\d+)?,?\s*(?:no\.?\s*(\d+))?,?\s*"
    r"(?:pp?\.?\s*([0-9\-]+))?,?\s*(\d{4})"
)
AUTHORS = (
    r"^([A-Z][a-z]+(?:,?\s+[A-Z][a-z]*\.?)*(?:\s+and\s+[A-Z][a-z]+(?:,?\s+[A-Z][a-z]*\.?)*)*)"
)
SHORTCUT_FORMS = [
    (r"\b(Ctrl|Cmd|Alt|Shift)\s*\+\s*([A-Za-z0-9]+)\b", "combination"),
    (r"\bF([1-9]|1[0-2])\b", "function"),
    (r"\b(ENTER|TAB|ESC|DELETE|SPACE)\b", "named"),
]
SAFE_TAGS = [
    "p", "br", "strong", "em", "i", "u", "ol", "ul", "li", "h1", "h2", "h3", "h4", "h5", "h6",
    "blockquote", "pre", "code", "a", "img", "table", "thead", "tbody", "tr", "th", "td",
    "div", "span", "hr", "sub", "sup", "small", "del", "ins", "kbd", "svg", "path", "g", "circle",
    "rect", "line", "polygon", "polyline", "ellipse", "defs", "use",
]
UNSAFE_PARTS = [
    "onload", "onerror", "onclick", "onmouseover", "onfocus", "onblur",
    "script", "javascript:", "vbscript:", "data:", "style",
]
# ---------------------------------------------------------------------------


def clean_inline(html: Column) -> Column:
    """Inline markup to light marks, other tags dropped, white space folded."""
    for pattern, mark in (
        (r"(?i)<(?:strong|b)\b[^>]*>(.*?)</(?:strong|b)>", "**$1**"),
        (r"(?i)<(?:em|i)\b[^>]*>(.*?)</(?:em|i)>", "*$1*"),
        (r"(?i)<code[^>]*>(.*?)</code>", "`$1`"),
        (r"<[^>]+>", ""),
    ):
        html = F.regexp_replace(html, pattern, mark)
    html = trim_ws(F.regexp_replace(html, r"\s+", " "))
    for mark, char in (
        ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
    ):
        html = F.replace(html, F.lit(mark), F.lit(char))
    return html


def link_footnotes(topics: DataFrame) -> DataFrame:
    """``path, pos, id, content, warning`` of footnote references.

    References meet the last body of their id in the same topic; only topics with
    footnotes and only their short texts are shuffled.
    """
    html = F.col("html")
    with_refs = topics.filter(F.contains("html", F.lit("#fn")))
    refs = with_refs.select(
        "path", F.posexplode(all_matches(html, FOOTNOTE_REF, 1)).alias("pos", "id")
    )
    ids, texts = all_matches(html, FOOTNOTE_BODY, 1), all_matches(html, FOOTNOTE_BODY, 2)
    bodies = (
        with_refs.select("path", F.posexplode(F.arrays_zip(ids, texts).cast("array<struct<id:string,body:string>>")))
        .groupBy("path", F.col("col.id").alias("id"))
        .agg(F.max_by("col.body", "pos").alias("body"))
    )
    joined = refs.join(bodies, ["path", "id"], "left")
    content = nonempty(clean_inline(F.col("body")))
    missing = F.concat(F.lit("Footnote reference "), F.col("id"), F.lit(" found but content missing"))
    return joined.select("path", "pos", "id", content.alias("content")).select(
        "*", F.when(F.col("content").isNull(), missing).alias("warning")
    )


def _empty(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _citation(kind, pos, key, content, authors=None, year=None, title=None, journal=None, url=None, doi=None):
    return F.struct(
        F.lit(kind).alias("type"),
        pos.alias("pos"),
        (key if key is not None else _empty("string")).alias("ref"),
        content.alias("content"),
        (authors if authors is not None else _empty("array<string>")).alias("authors"),
        (year if year is not None else _empty("string")).alias("year"),
        (title if title is not None else _empty("string")).alias("title"),
        (journal if journal is not None else _empty("string")).alias("journal"),
        (url if url is not None else _empty("string")).alias("url"),
        (doi if doi is not None else _empty("string")).alias("doi"),
    )


def citations(topics: DataFrame) -> DataFrame:
    """Author-year citations, numbered references and bibliography entries of each topic.

    All three are cut out and parsed inside the row.
    """
    html = F.col("html")
    inline = F.transform(
        all_matches(html, AUTHOR_YEAR, 0),
        lambda m, i: _citation(
            "inline", i, None,
            F.concat(F.regexp_extract(m, AUTHOR_YEAR, 1), F.lit(", "), F.regexp_extract(m, AUTHOR_YEAR, 2)),
            authors=F.array(F.regexp_extract(m, AUTHOR_YEAR, 1)),
            year=F.regexp_extract(m, AUTHOR_YEAR, 2),
        ),
    )
    numbered = F.transform(
        all_matches(html, NUMBERED_REF),
        lambda n, i: _citation("reference", i, F.concat(F.lit("ref_"), n), F.concat(F.lit("["), n, F.lit("]"))),
    )
    entries = F.transform(
        F.transform(all_matches(html, BIBLIOGRAPHY_ENTRY), clean_inline),
        lambda c, i: _citation(
            "bibliography", i, None, c,
            authors=F.when(
                c.rlike(AUTHORS), F.transform(F.split(F.regexp_extract(c, AUTHORS, 1), r"\s+and\s+"), trim_ws)
            ),
            year=first_match(c, JOURNAL, 6),
            title=first_match(c, JOURNAL, 1),
            journal=first_match(c, JOURNAL, 2),
            url=first_match(c, URL),
            doi=first_match(c, DOI),
        ),
    )
    return topics.select("path", F.inline(F.concat(inline, numbered, entries)))


def reference_section(topics: DataFrame, format: str = "asciidoc") -> DataFrame:
    """``path, ord, line``: reference list lines after each topic that cites something.

    Footnotes are inline in AsciiDoc and listed first in Markdown. Numbers follow the
    order footnotes, author-year, bibliography inside a topic.
    """
    notes = link_footnotes(topics).filter(F.col("content").isNotNull())
    nothing = {"authors": "array<string>", "year": "string", "url": "string", "doi": "string"}
    rows = notes.select(
        "path", F.lit(0).alias("grp"), "pos", "content", *[_empty(t).alias(n) for n, t in nothing.items()]
    ).unionByName(
        citations(topics)
        .filter("type <> 'reference'")
        .select("path", F.when(F.col("type") == "inline", 1).otherwise(2).alias("grp"), "pos", "content", *nothing)
    )
    rows = cut(rows)  # headings and lines both start here; texts are parsed once
    number = F.row_number().over(Window.partitionBy("path").orderBy("grp", "pos"))
    rows = rows.withColumn("cite", F.concat(F.lit("cite_"), number.cast("string"))).withColumn("ord", number)
    known = F.col("authors").isNotNull() & F.col("year").isNotNull()
    names = F.array_join("authors", ", ")
    doi = F.coalesce(F.concat(F.lit(" DOI: "), F.col("doi")), F.lit(""))
    year = F.concat(F.lit(" ("), F.col("year"), F.lit("). "))
    if format == "asciidoc":
        who = F.when(known, F.concat(names, year)).otherwise("")
        url = F.coalesce(F.concat(F.lit(" Available at: "), F.col("url")), F.lit(""))
        body = F.array(
            F.concat(F.lit("[["), F.col("cite"), F.lit("]]")), F.concat(who, F.col("content"), doi, url), F.lit("")
        )
        # the heading comes with any citation, even when all are footnotes
        body = F.when(F.col("grp") == 0, F.array().cast("array<string>")).otherwise(body)
        heading = "== References"
    else:
        who = F.when(known, F.concat(F.lit("**"), names, F.lit("**"), year)).otherwise("")
        link = F.concat(F.lit(" Available at: ["), F.col("url"), F.lit("]("), F.col("url"), F.lit(")"))
        note = F.array(F.concat(F.lit("[^"), F.col("cite"), F.lit("]: "), F.col("content")), F.lit(""))
        other = F.array(
            F.concat(F.lit('<a id="'), F.col("cite"), F.lit('"></a>')),
            F.concat(who, F.col("content"), doi, F.coalesce(link, F.lit(""))), F.lit(""),
        )
        body = F.when(F.col("grp") == 0, note).otherwise(other)
        heading = "## References"
    lines = rows.select("path", "ord", F.posexplode(body).alias("seq", "line"))
    heads = rows.select("path").distinct().select(
        "path", F.lit(0).alias("ord"), F.posexplode(F.array(F.lit(heading), F.lit(""))).alias("seq", "line")
    )
    return heads.unionByName(lines)


def shortcuts(topics: DataFrame) -> DataFrame:
    """``path, form, pos, keys`` of keyboard shortcuts in text outside kbd, code and pre."""
    text = F.regexp_replace("html", r"(?is)<(kbd|code|pre)\b[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, "<[^>]*>", "\u0001")

    def keys_of(pattern, form):
        return F.transform(
            all_matches(text, pattern, 0),
            lambda k, i: F.struct(F.lit(form).alias("form"), i.alias("pos"), k.alias("keys")),
        )

    found = [keys_of(pattern, form) for pattern, form in SHORTCUT_FORMS]
    return topics.select("path", F.inline(F.concat(*found)))


def unsafe_markup(topics: DataFrame) -> DataFrame:
    """``path, kind, name, uses``: tags outside the allow-list and unsafe attributes."""
    tags = topics.select("path", F.explode(all_matches(F.col("html"), OPEN_TAG, 0)).alias("t"))
    name = F.lower(F.regexp_extract("t", r"^<([A-Za-z][\w:.-]*)", 1))
    bad_tags = tags.select("path", F.lit("tag").alias("kind"), name.alias("name")).filter(
        ~F.col("name").isin(SAFE_TAGS)
    )
    pairs = all_matches(F.col("t"), r"\s[A-Za-z_:][\w:.-]*\s*=\s*(?:\"[^\"]*\"|'[^']*')", 0)
    attributes = tags.select("path", F.explode(pairs).alias("a"))
    low = F.lower("a")
    bad = attributes.filter(any_of(low.contains(u) for u in UNSAFE_PARTS)).select(
        "path", F.lit("attribute").alias("kind"), F.lower(F.regexp_extract("a", r"([\w:.-]+)\s*=", 1)).alias("name")
    )
    return bad_tags.unionByName(bad).groupBy("path", "kind", "name").agg(F.count("*").alias("uses"))
