"""Quality scoring of converted text.

All issues of a topic are built as one array inside its row, so scores and issue
rows need no shuffle. Only the line numbers of repeated lines are grouped, and
only for lines already known to repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweft.functions.text import all_matches, compact, round_half_up, trim_ws
from docweft.operators.lines import repeated, split_lines

# --- fixed values -----------------------------------------------------------
SCRIPT_PATTERNS = [
    r"function\s*\([^)]*\)\s*\{",
    r"var\s+\w+\s*=",
    r"\.addEventListener\(",
    r"console\.log\(",
    r"document\.createElement\(",
    r"\$\([^)]+\)\.",
    r"new\s+Date\(\)",
    r"Math\.(floor|ceil|random)",
]
ENCODING_MARKS = ["â€™", "Â", "â€", "Ã"]
ALLOWED_TAGS = r"^</?(?:sub|sup|br|hr)>"
IMAGE_FORM = {"asciidoc": r"image::?[^\[\]]+\[", "markdown": r"!\[[^\]]*\]\([^)]+\)"}
LINK_FORM = {"asciidoc": r"(?:xref:|link:)[^\[\]]+\[", "markdown": r"\[[^\]]*\]\([^)]+\)"}
IMAGE_SUFFIX = r"(?i)\.(png|jpg|jpeg|gif|svg|webp)\z"
MARKUP_CHARS = r"[=*_`\[\]]"
CONTENT_MINIMUM = 100
REPEAT_MINIMUM = 20
MARKUP_SHARE = 0.3
PENALTY = {"error": 15, "warning": 5, "info": 1}
BONUS = {"title": 5, "content": 10, "images": 2, "links": 2}
BANDS = [(90, "Excellent", ""), (75, "Good", ""), (50, "Fair", " Review recommended.")]
LAST_BAND = ("Poor", " Manual review required.")
LOW_QUALITY = 70
SCRIPT_ISSUE = (
    "JavaScript code detected in converted content",
    "Source HTML likely contained <script> tags that were not properly filtered",
)
TAG_SUGGESTION = "These HTML elements were not properly converted to the target format"
LATEX_ISSUE = ("Malformed latexmath expressions detected", "Mathematical content was not properly converted")
REFERENCE_ISSUE = ("Corrupted reference markers detected", "Cross-references were not properly processed")
TITLES_SUGGESTION = "Document structure may be duplicated or malformed"
NO_TITLE = ("No document title found", "Add a proper title to improve document structure")
LITTLE_CONTENT = (
    "Document appears to be empty or have very little content",
    "Check if source document was properly processed",
)
MUCH_MARKUP = (
    "High markup-to-content ratio detected",
    "Document may contain excessive formatting or conversion artifacts",
)
REPEAT_SUGGESTION = "Check for content duplication in source or conversion process"
ENCODING_ISSUE = ("Text encoding issues detected", "Source document may have character encoding problems")
TRAVERSAL_SUGGESTION = "Image paths may not resolve correctly"
SUFFIX_SUGGESTION = "Verify image file exists and has correct extension"
LINK_SUGGESTION = "HTML links should be converted to target format extensions"
# ---------------------------------------------------------------------------

ISSUE = "struct<rank:int,pos:int,type:string,category:string,message:string,line:int,suggestion:string>"


def _issue(rank, kind, category, message, suggestion=None, pos=None, line=None) -> Column:
    def col(x, t):
        return x.cast(t) if isinstance(x, Column) else F.lit(x).cast(t)

    return F.struct(
        F.lit(rank).alias("rank"),
        col(0 if pos is None else pos, "int").alias("pos"),
        F.lit(kind).alias("type"),
        F.lit(category).alias("category"),
        col(message, "string").alias("message"),
        col(line, "int").alias("line"),
        col(suggestion, "string").alias("suggestion"),
    )


def _none() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def _markdown(format: str) -> bool:
    return format in ("markdown", "writerside")


def has_title(text: Column, format: str) -> Column:
    if format == "asciidoc":
        return text.rlike(r"(?m)^=\s+[^\n\r]+$")
    if _markdown(format):
        return text.rlike(r"(?m)^#\s+[^\n\r]+$")
    return F.lit(True)


def fact_columns(c: Column, format: str) -> dict[str, Column]:
    form = "asciidoc" if format == "asciidoc" else "markdown"
    newlines = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return {
        "has_title": has_title(c, format),
        "has_content": F.length(trim_ws(c)) > CONTENT_MINIMUM,
        "image_count": F.regexp_count(c, F.lit(IMAGE_FORM[form])).cast("bigint"),
        "link_count": F.regexp_count(c, F.lit(LINK_FORM[form])).cast("bigint"),
        "line_count": (newlines + 1).cast("bigint"),
    }


def structure_facts(topics: DataFrame, format: str = "asciidoc", text: str = "text") -> DataFrame:
    facts = fact_columns(F.col(text), format)
    return topics.select("path", *[column.alias(name) for name, column in facts.items()])


# --- issue builders: each gives array<issue> of one row ---------------------
def script_issues(c: Column) -> Column:
    return compact(
        *[F.when(c.rlike(p), _issue(1, "error", "content", *SCRIPT_ISSUE, pos=i)) for i, p in enumerate(SCRIPT_PATTERNS)]
    )


def tag_issues(c: Column) -> Column:
    tags = F.filter(
        all_matches(c, r"</?[a-zA-Z][^>]*>", 0), lambda t: ~t.startswith("</") & ~t.rlike(ALLOWED_TAGS)
    )
    names = F.array_distinct(F.transform(tags, lambda t: F.regexp_replace(t, "</?([a-zA-Z0-9]+)[^>]*>", "$1")))
    message = F.concat(F.lit("Unconverted HTML tags found: "), F.array_join(names, ", "))
    return F.when(F.size(names) > 0, F.array(_issue(2, "warning", "formatting", message, TAG_SUGGESTION))).otherwise(
        _none()
    )


def _header_lines(c: Column) -> Column:
    lines = F.transform(split_lines(c), lambda x, i: F.struct(x.alias("key"), (i + 1).alias("n")))
    return F.filter(lines, lambda e: e["key"].rlike(r"^=+\s+"))


def markup_issues(c: Column, format: str) -> Column:
    if format != "asciidoc":
        return _none()
    again = F.transform(
        repeated(_header_lines(c)),
        lambda e: _issue(
            5, "warning", "structure",
            F.concat(F.lit("Duplicate header found: "), e["key"]),
            pos=e["n"], line=e["n"],
        ),
    )
    titles = F.regexp_count(c, F.lit(r"(?:^|\n)= "))
    many = F.concat(F.lit("Multiple document titles found ("), titles.cast("string"), F.lit(" total)"))
    return F.concat(
        compact(
            F.when(c.contains("latexmath:["), _issue(3, "error", "formatting", *LATEX_ISSUE)),
            F.when(c.rlike(r"<ref_\d+,\[\d+\]>"), _issue(4, "error", "formatting", *REFERENCE_ISSUE)),
        ).cast(f"array<{ISSUE}>"),
        again.cast(f"array<{ISSUE}>"),
        F.when(titles > 1, F.array(_issue(6, "error", "structure", many, TITLES_SUGGESTION))).otherwise(_none()),
    )


def structure_issues(c: Column, format: str) -> Column:
    share = F.try_divide(F.regexp_count(c, F.lit(MARKUP_CHARS)).cast("double"), F.length(c).cast("double"))
    return compact(
        F.when(~has_title(c, format), _issue(7, "warning", "structure", *NO_TITLE)),
        F.when(F.length(trim_ws(c)) <= CONTENT_MINIMUM, _issue(8, "error", "content", *LITTLE_CONTENT)),
        F.when(F.coalesce(share > MARKUP_SHARE, F.lit(False)), _issue(9, "warning", "formatting", *MUCH_MARKUP)),
    )


def long_lines(c: Column) -> Column:
    """``array<struct<key, n>>`` of the lines that count for repetition."""
    lines = F.transform(split_lines(c), lambda x, i: F.struct(trim_ws(x).alias("key"), (i + 1).alias("n")))
    return F.filter(lines, lambda e: F.length(e["key"]) > REPEAT_MINIMUM)


def repeated_line_count(c: Column) -> Column:
    """Distinct lines that occur more than once."""
    return F.size(F.array_distinct(F.transform(repeated(long_lines(c)), lambda e: e["key"])))


def encoding_issues(c: Column) -> Column:
    return compact(
        *[
            F.when(c.contains(m), _issue(11, "warning", "content", *ENCODING_ISSUE, pos=i))
            for i, m in enumerate(ENCODING_MARKS)
        ]
    )


def image_issues(c: Column) -> Column:
    paths = F.transform(
        all_matches(c, r"image::?([^\[\]]+)\["), lambda p, i: F.struct(p.alias("p"), i.alias("i"))
    )
    paths = F.filter(paths, lambda e: ~e["p"].contains("data:"))

    def findings(e):
        p, i = e["p"], e["i"]
        return compact(
            F.when(
                F.regexp_count(p, F.lit(r"\.\./")) > 3,
                _issue(
                    12, "warning", "images",
                    F.concat(F.lit("Suspicious image path with many directory traversals: "), p),
                    TRAVERSAL_SUGGESTION, pos=i * 2,
                ),
            ),
            F.when(
                ~p.rlike(IMAGE_SUFFIX),
                _issue(
                    12, "info", "images", F.concat(F.lit("Image without standard extension: "), p),
                    SUFFIX_SUGGESTION, pos=i * 2 + 1,
                ),
            ),
        )

    return F.flatten(F.transform(paths, findings))


def link_issues(c: Column) -> Column:
    paths = all_matches(c, r"(?:xref:|link:)([^\[\]]+)\[")
    items = F.transform(
        paths,
        lambda p, i: F.when(
            p.contains("..htm"),
            _issue(
                13, "info", "links", F.concat(F.lit("Link may need extension conversion: "), p),
                LINK_SUGGESTION, pos=i,
            ),
        ),
    )
    return F.array_compact(items)


def row_issues(c: Column, format: str) -> Column:
    """Every issue but the repeated lines, as one array."""
    parts = [
        script_issues(c), tag_issues(c), markup_issues(c, format), structure_issues(c, format),
        encoding_issues(c), image_issues(c), link_issues(c),
    ]
    return F.concat(*[p.cast(f"array<{ISSUE}>") for p in parts])


def issues_duplicates(topics: DataFrame, text: str = "text") -> DataFrame:
    """One warning per repeated line with its line numbers.

    Repeats are found inside the row; the group that collects line numbers is bounded
    by the topic's own repeats.
    """
    again = F.array_distinct(F.transform(repeated(long_lines(F.col(text))), lambda e: e["key"]))
    hits = topics.select("path", again.alias("again"), long_lines(F.col(text)).alias("long_lines"))
    hits = hits.filter(F.size("again") > 0).select("path", "again", F.inline("long_lines"))
    rows = hits.filter(F.array_contains(F.col("again"), F.col("key"))).select("path", "key", "n")
    grouped = rows.groupBy("path", "key").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    return grouped.select(
        "path",
        F.lit(10).alias("rank"),
        F.get("ns", F.lit(0)).alias("pos"),
        F.lit("warning").alias("type"),
        F.lit("content").alias("category"),
        F.concat(F.lit("Duplicate content found on lines "), F.array_join(F.col("ns").cast("array<string>"), ", ")).alias(
            "message"
        ),
        F.lit(None).cast("int").alias("line"),
        F.lit(REPEAT_SUGGESTION).alias("suggestion"),
    )


def quality_issues(topics: DataFrame, format: str = "asciidoc", text: str = "text") -> DataFrame:
    """All issue rows: ``path, rank, pos, type, category, message, line, suggestion``.

    (rank, pos) is the order in which the checks run.
    """
    rows = topics.select("path", F.inline(row_issues(F.col(text), format)))
    return rows.unionByName(issues_duplicates(topics, text))


def quality_scores(topics: DataFrame, format: str = "asciidoc", text: str = "text") -> DataFrame:
    """Facts, issue counts, score, band and summary per topic, in one pass and no shuffle."""
    c = F.col(text)
    facts = fact_columns(c, format)
    names = list(facts)
    measured = F.struct(
        *[column.alias(name) for name, column in facts.items()],
        F.transform(row_issues(c, format), lambda i: i["type"]).alias("types"),
        repeated_line_count(c).alias("repeats"),
    )
    # generating the one row keeps a later filter on the score from measuring twice
    counted = topics.select("path", F.inline(F.array(measured)))

    def number(kind):
        return F.size(F.filter("types", lambda t: t == kind))

    counts = counted.select(
        "path", *names,
        number("error").cast("bigint").alias("errors"),
        (number("warning") + F.col("repeats")).cast("bigint").alias("warnings"),
        number("info").cast("bigint").alias("infos"),
    )
    return with_score(counts)


def with_score(counts: DataFrame) -> DataFrame:
    points = F.lit(100)
    for kind, name in (("error", "errors"), ("warning", "warnings"), ("info", "infos")):
        points = points - F.col(name) * PENALTY[kind]
    for test, bonus in (
        (F.col("has_title"), BONUS["title"]),
        (F.col("has_content"), BONUS["content"]),
        (F.col("image_count") > 0, BONUS["images"]),
        (F.col("link_count") > 0, BONUS["links"]),
    ):
        points = points + F.when(test, bonus).otherwise(0)
    scored = counts.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("bigint"))
    return scored.select("*", quality_band(F.col("score")).alias("band"))


def quality_score(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """The same score from a facts table and an issue table."""
    per = issues.groupBy("path").agg(
        *[F.count_if(F.col("type") == k).alias(n) for k, n in (("error", "errors"), ("warning", "warnings"), ("info", "infos"))]
    )
    joined = facts.join(per, "path", "left").fillna(0, ["errors", "warnings", "infos"])
    return with_score(joined)


def quality_band(score: Column) -> Column:
    result = F.lit(LAST_BAND[0])
    for low, name, _ in reversed(BANDS):
        result = F.when(score >= low, F.lit(name)).otherwise(result)
    return result


def quality_text(score: Column, errors: Column, warnings: Column) -> Column:
    tail = F.lit(LAST_BAND[1])
    for low, _, text in reversed(BANDS):
        tail = F.when(score >= low, F.lit(text)).otherwise(tail)
    return F.concat(
        quality_band(score), F.lit(" conversion quality ("), score.cast("string"), F.lit("/100). "),
        errors.cast("string"), F.lit(" errors, "), warnings.cast("string"), F.lit(" warnings."), tail,
    )


def top_issues(topics: DataFrame, n: int = 3, format: str = "asciidoc", text: str = "text") -> DataFrame:
    """First ``n`` issues per topic by severity, stable in check order.

    Row-local issues and repeated lines are merged by one ranking per topic; a topic
    contributes at most ``n`` of its own row-local issues to that shuffle.
    """
    severity = {"error": 0, "warning": 1, "info": 2}

    def weight(kind):
        result = F.lit(9)
        for name, value in severity.items():
            result = F.when(kind == name, value).otherwise(result)
        return result

    def keyed(i):
        return F.struct(
            weight(i["type"]).alias("severity"), i["rank"].alias("rank"), i["pos"].alias("pos"),
            i["type"].alias("type"), i["message"].alias("message"),
        )

    own = F.slice(F.array_sort(F.transform(row_issues(F.col(text), format), keyed)), 1, n)
    rows = topics.select("path", F.inline(own))
    again = issues_duplicates(topics, text).select(
        "path", F.lit(1).alias("severity"), "rank", "pos", "type", "message"
    )
    order = Window.partitionBy("path").orderBy("severity", "rank", "pos")
    ranked = rows.unionByName(again).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    return ranked.select(
        "path", "place", F.concat(F.upper("type"), F.lit(": "), F.col("message")).alias("warning")
    )


def quality_summary(scores: DataFrame) -> DataFrame:
    """Rounded mean score, total issues, topics under the low-quality mark."""
    total = F.col("errors") + F.col("warnings") + F.col("infos")
    return scores.agg(
        F.count("*").alias("topics"),
        F.coalesce(round_half_up(F.avg("score")), F.lit(0)).alias("average_score"),
        F.coalesce(F.sum(total), F.lit(0)).alias("total_issues"),
        F.count_if(F.col("score") < LOW_QUALITY).alias("low_quality"),
    )


def low_quality(scores: DataFrame) -> DataFrame:
    total = F.col("errors") + F.col("warnings") + F.col("infos")
    return scores.filter(F.col("score") < LOW_QUALITY).select("path", "score", total.alias("issues"))

