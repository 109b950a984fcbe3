"""Blocks, lists and tables of topics as rows, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweft.functions.text import (
    CHUNK_SIZE,
    all_matches,
    contains_any,
    let,
    round_half_up,
    strip_boilerplate,
    text_chunks,
    trim_ws,
)
from docweft.operators.conditions import attribute
from docweft.operators.lines import split_lines

# --- fixed values -----------------------------------------------------------
BLOCK_TAGS = "h[1-6]|p|li|tr|pre|blockquote|ol|ul|table|div"
CALLOUTS = [
    "note", "tip", "warning", "caution", "important", "danger", "error", "info", "example", "quote", "code",
    "attention", "advisory",
]
CALLOUT_LABELS = [
    (["warning", "caution", "attention"], "WARNING"),
    (["danger", "error"], "DANGER"),
    (["important", "advisory"], "IMPORTANT"),
    (["tip"], "TIP"),
    (["info"], "INFO"),
    (["example"], "EXAMPLE"),
    (["quote"], "QUOTE"),
    (["code"], "CODE"),
]
ADMONITIONS = {
    "WARNING": "WARNING", "CAUTION": "WARNING", "ATTENTION": "WARNING",
    "DANGER": "CAUTION", "ERROR": "CAUTION",
    "IMPORTANT": "IMPORTANT", "ADVISORY": "IMPORTANT",
    "TIP": "TIP", "QUOTE": "QUOTE",
}
COLLAPSIBLE_WORDS = [
    "connecting", "configuring", "related tasks", "additional", "advanced", "optional", "details",
    "more information", "see also", "troubleshooting", "examples", "tips", "notes",
]
PROCEDURE_WORDS = ["step", "how to", "create", "setup"]
DEFAULT_DROPDOWN = "More Information"
# ---------------------------------------------------------------------------

MARK = "\u0001"


def callout_label(css: Column) -> Column:
    """Label of a callout class; null when the class is none."""
    result = F.lit("NOTE")
    for words, label in reversed(CALLOUT_LABELS):
        result = F.when(contains_any(css, words), F.lit(label)).otherwise(result)
    return F.when(contains_any(css, CALLOUTS), result)


def admonition(label: Column) -> Column:
    """Admonition kind of a callout label."""
    up = F.upper(label)
    result = F.lit("NOTE")
    for name, kind in ADMONITIONS.items():
        result = F.when(up == name, F.lit(kind)).otherwise(result)
    return result


def _pieces(html: Column) -> Column:
    """Markup cut before every block tag; what stands before the first is dropped."""
    cut = F.regexp_replace(strip_boilerplate(html), rf"(?i)<(?=(?:{BLOCK_TAGS})\b)", MARK + "<")
    return let(F.split(cut, MARK, -1), lambda p: F.slice(p, F.lit(2), F.size(p)))


def _visible(raw: Column) -> Column:
    return trim_ws(F.regexp_replace(F.regexp_replace(raw, "<[^>]*>", " "), r"\s+", " "))


def block_pieces(html: Column) -> Column:
    """The markup of all blocks with text, in order."""
    return F.filter(_pieces(html), lambda raw: _visible(raw) != "")


def blocks(topics: DataFrame) -> DataFrame:
    """``path, block_no, kind, level, text, raw``: flat blocks in document order.

    The markup is cut before every block tag; kinds are heading, paragraph, item,
    row, code and admonition. Containers carry no text of their own and are dropped.
    """
    rows = topics.select("path", F.posexplode(_pieces(F.col("html"))).alias("block_no", "raw"))
    opening = F.regexp_extract("raw", r"^<[^<>]*>", 0)
    tag = F.lower(F.regexp_extract("raw", r"^<(\w+)", 1))
    label = callout_label(attribute(opening, "class"))
    body = _visible(F.col("raw"))
    kind = (
        F.when(tag.rlike("^h[1-6]"), "heading")
        .when(label.isNotNull(), "admonition")
        .when(tag == "li", "item")
        .when(tag == "tr", "row")
        .when(tag == "pre", "code")
        .otherwise("paragraph")
    )
    level = F.when(tag.rlike("^h[1-6]"), F.substr(tag, F.lit(2), F.lit(1)).cast("int")).otherwise(0)
    shaped = rows.select("path", "block_no", kind.alias("kind"), level.alias("level"), label.alias("label"),
                         body.alias("text"), "raw")
    return shaped.filter(F.col("text") != "")


def render_blocks(block_rows: DataFrame, format: str = "asciidoc") -> DataFrame:
    """``path, block_no, line``: one template per kind. Sort by (path, block_no) to assemble."""
    text, level = F.col("text"), F.col("level")
    if format == "asciidoc":
        line = (
            F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("="), level), F.lit(" "), text))
            .when(F.col("kind") == "item", F.concat(F.lit("* "), text))
            .when(F.col("kind") == "row", F.concat(F.lit("|"), text))
            .when(F.col("kind") == "code", F.concat(F.lit("----\n"), text, F.lit("\n----")))
            .when(F.col("kind") == "admonition", F.concat(admonition(F.col("label")), F.lit(": "), text))
            .otherwise(text)
        )
    else:
        line = (
            F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
            .when(F.col("kind") == "item", F.concat(F.lit("- "), text))
            .when(F.col("kind") == "row", F.concat(F.lit("| "), text, F.lit(" |")))
            .when(F.col("kind") == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
            .when(F.col("kind") == "admonition", F.concat(F.lit("> **"), F.col("label"), F.lit("** "), text))
            .otherwise(text)
        )
    return block_rows.select("path", "block_no", line.alias("line"))


def assemble_topics(rendered: DataFrame) -> DataFrame:
    """``path, text``: the lines of one topic joined, blank line between blocks.

    The group is one topic, which came from one row.
    """
    grouped = rendered.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block_no", "line"))).alias("b"))
    return grouped.select("path", F.array_join(F.transform("b", lambda b: b["line"]), "\n\n").alias("text"))


# --- lists ------------------------------------------------------------------
def ordered_lists(topics: DataFrame) -> DataFrame:
    """``path, list_no, continues, items`` of flat ordered lists in document order."""
    found = all_matches(F.col("html"), r"(?is)<ol\b[^<>]*>.*?</ol>", 0)
    rows = topics.select("path", F.posexplode(found).alias("list_no", "raw"))
    opening = F.regexp_extract("raw", r"^<[^<>]*>", 0)
    return rows.select(
        "path", "list_no",
        (attribute(opening, "madcap:continue") == "true").alias("continues"),
        F.regexp_count("raw", F.lit(r"(?i)<li\b")).alias("items"),
    )


def list_starts(lists: DataFrame) -> DataFrame:
    """Start number: one plus the items since the last list that does not continue."""
    order = Window.partitionBy("path").orderBy("list_no")
    grouped = lists.withColumn("run", F.sum((~F.col("continues")).cast("int")).over(order))
    before = (
        Window.partitionBy("path", "run").orderBy("list_no").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(F.sum("items").over(before), F.lit(0)) + 1
    return grouped.select(
        "path", "list_no", "continues", "items",
        F.when(F.col("continues"), start).otherwise(F.lit(1)).cast("bigint").alias("start"),
    )


def numbered_paragraphs(topics: DataFrame, text: str = "text") -> DataFrame:
    """``path, ord, number, content`` of lines or paragraphs that start with ``n.``

    Numbers of more than 38 digits are null and open a run of their own.
    """
    arr = F.transform(split_lines(F.col(text)), trim_ws)
    rows = topics.select("path", F.posexplode(arr).alias("ord", "line"))
    rows = rows.filter(F.col("line").rlike(r"^\d+\.\s+."))
    return rows.select(
        "path", "ord",
        F.regexp_extract("line", r"^(\d+)\.", 1).try_cast("decimal(38,0)").alias("number"),
        F.regexp_extract("line", r"^\d+\.\s+(.+)\z", 1).alias("content"),
    )


def numbered_runs(rows: DataFrame) -> DataFrame:
    """Runs of following numbers; a run of one is no list. Adds ``run`` and ``place``."""
    order = Window.partitionBy("path").orderBy("ord")
    before = F.lag("number").over(order)
    follows = (F.col("number") != 1) & (F.col("number") - 1 == before)
    opens = ~F.coalesce(follows, F.lit(False))
    marked = rows.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(order))
    per_run = Window.partitionBy("path", "run")
    sized = marked.withColumn("size", F.count("*").over(per_run))
    place = F.row_number().over(per_run.orderBy("ord"))
    return sized.filter(F.col("size") >= 2).select("path", "ord", "number", "run", place.alias("place"), "content")


# --- tables -----------------------------------------------------------------
def table_cells(topics: DataFrame) -> DataFrame:
    """``path, table_no, row_no, col_no, is_header, colspan, rowspan, alignment, format, content``.

    Tables, rows and cells are cut inside the topic row; nested tables are not split.
    """
    tables = all_matches(F.col("html"), r"(?is)<table\b.*?</table>", 0)
    t = topics.select("path", F.posexplode(tables).alias("table_no", "t"))
    head = F.regexp_replace(F.regexp_extract("t", r"(?is)<thead\b.*?</thead>", 0), r"(?i)<tr\b", MARK + "<tr")
    marked = F.concat(head, F.regexp_replace("t", r"(?is)<thead\b.*?</thead>", ""))
    r = t.select(
        "path", "table_no",
        F.posexplode(all_matches(marked, r"(?is)(\x01?<tr\b.*?)(?=\x01?<tr\b|</thead|</tbody|</table|\z)")).alias("row_no", "r"),
    )
    cells = all_matches(F.col("r"), r"(?is)<t[dh]\b[^<>]*>.*?(?=</t[dh]>|<t[dh]\b|</tr>|\z)", 0)
    c = r.select("path", "table_no", "row_no", F.posexplode(cells).alias("col_no", "c"), F.col("r").startswith(MARK).alias("in_head"))
    opening = F.regexp_extract("c", r"^<[^<>]*>", 0)
    inner = F.regexp_extract("c", r"(?s)^<[^<>]*>(.*)", 1)
    content = inner
    for pattern, mark in (
        (r"(?is)<(strong|b)>(.*?)</\1>", "*$2*"),
        (r"(?is)<(em|i)>(.*?)</\1>", "_$2_"),
        (r"(?is)<code>(.*?)</code>", "`$1`"),
        (r"(?i)<br\s*/?>", " +\n"),
        (r"(?is)<a\s[^<>]*?href=\"([^\"]*)\"[^<>]*>(.*?)</a>", "link:$1[$2]"),
        (r"<[^>]*>", ""),
        (r"\s+", " "),
        (r"\|", r"\\|"),
    ):
        content = F.regexp_replace(content, pattern, mark)
    align = F.lower(attribute(opening, "align"))
    style = attribute(opening, "style")
    alignment = (
        F.when(align.isin("center", "right"), align)
        .when(style.contains("text-align: center"), "center")
        .when(style.contains("text-align: right"), "right")
    )
    only = F.regexp_count(inner, F.lit(r"<[A-Za-z]")) == 1
    first = F.lower(F.regexp_extract(inner, r"<([A-Za-z]+)", 1))
    fmt = F.when(
        only,
        F.when(first.isin("strong", "b"), "strong")
        .when(first.isin("em", "i"), "emphasis")
        .when(first == "code", "monospace"),
    )

    def span(name):
        n = F.nullif(F.regexp_extract(attribute(opening, name), r"^\s*(\d+)", 1), F.lit("")).cast("int")
        return F.when(n > 1, n)

    return c.select(
        "path", "table_no", "row_no", "col_no",
        (F.col("in_head") | opening.rlike("(?i)^<th")).alias("is_header"),
        span("colspan").alias("colspan"), span("rowspan").alias("rowspan"),
        alignment.alias("alignment"), fmt.alias("format"), trim_ws(content).alias("content"),
    )


def column_specs(cells: DataFrame) -> DataFrame:
    """Column weights: longest content per column as a share of ten, at least one.

    The first aggregation combines before the shuffle; the share is taken over the
    few columns of a table.
    """
    widths = cells.groupBy("path", "table_no", "col_no").agg(F.max(F.length("content")).alias("width"))
    total = F.sum("width").over(Window.partitionBy("path", "table_no"))
    share = round_half_up(F.try_divide(F.col("width").cast("double"), F.col("total").cast("double")) * 10)
    return widths.withColumn("total", total).select(
        "path", "table_no", "col_no", "width",
        F.greatest(F.coalesce(share, F.lit(1)), F.lit(1)).cast("bigint").alias("weight"),
    )


# --- sections ---------------------------------------------------------------
def dropdowns(topics: DataFrame) -> DataFrame:
    """``path, pos, title`` of collapsible sections that have a hotspot and a body."""
    found = all_matches(F.col("html"), r"(?is)<MadCap:dropDown>.*?</MadCap:dropDown>|<MadCap:dropDown\s.*?</MadCap:dropDown>", 0)
    rows = topics.select("path", F.posexplode(found).alias("pos", "d"))
    rows = rows.filter(F.col("d").rlike(r"(?is)<MadCap:dropDownHead\b.*<MadCap:dropDownHotspot\b.*<MadCap:dropDownBody\b"))
    hotspot = F.regexp_extract("d", r"(?is)<MadCap:dropDownHotspot\b[^<>]*>(.*?)</MadCap:dropDownHotspot>", 1)
    title = trim_ws(F.regexp_replace(hotspot, "<[^>]*>", ""))
    return rows.select("path", "pos", F.when(title == "", DEFAULT_DROPDOWN).otherwise(title).alias("title"))


def collapsible_sections(topics: DataFrame, text: str = "text") -> DataFrame:
    """``path, line_no, title, content_lines, collapsible`` of every section header.

    A header looks at the next 19 lines; they are a slice of the topic's own line
    array, so the look-ahead needs no window.
    """
    arr = split_lines(F.col(text))
    rows = topics.filter(F.col(text).rlike(r"(?m)^=+\s")).select("path", arr.alias("ls"))
    heads = F.filter(
        F.transform("ls", lambda x, i: F.struct(i.alias("i"), x.alias("line"))),
        lambda e: e["line"].rlike(r"^=+\s+\S"),
    )
    rows = rows.select("path", F.inline(F.transform(heads, lambda e: F.struct(
        (e["i"] + 1).alias("line_no"), e["line"].alias("line"),
        F.slice(F.col("ls"), e["i"] + 2, F.lit(19)).alias("after"),
    ))))
    title = trim_ws(F.regexp_replace("line", r"^=+\s+", ""))
    rows = rows.select("path", "line_no", title.alias("title"), "after")
    closing = F.transform(
        "after",
        lambda x: x.rlike(r"^=+\s+") & (F.length(F.regexp_extract(x, "^=+", 0)) <= F.length(F.col("title"))),
    )
    end = F.array_position(closing, F.lit(True)).cast("int")
    body = F.when(end > 0, F.slice("after", F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(F.col("after"))
    filled = F.size(F.filter(body, lambda x: trim_ws(x) != ""))
    low = F.lower("title")
    procedure = contains_any(low, PROCEDURE_WORDS) | low.rlike(r"\d")
    counted = rows.select("path", "line_no", "title", filled.alias("content_lines"))
    decision = contains_any(low, COLLAPSIBLE_WORDS) | F.col("content_lines").between(3, 9) | ~procedure
    return counted.withColumn("collapsible", decision)


# --- chunks -----------------------------------------------------------------
def chunk_text(topics: DataFrame, n: int = CHUNK_SIZE, text: str = "text") -> DataFrame:
    """``path, chunk_no, chunk``: the whole text in pieces of ``n`` characters."""
    return topics.select("path", F.posexplode(text_chunks(F.col(text), n)).alias("chunk_no", "chunk"))


def chunk_blocks(topics: DataFrame, n: int = CHUNK_SIZE) -> DataFrame:
    """``path, chunk_no, blocks, chunk``: blocks packed greedily up to ``n`` characters of markup.

    Rows of a table and items of a list are blocks of their own, so large ones are parted;
    one larger block stands alone. Packing carries a state along the blocks of a topic, inside
    the row: the start of the last chunk and the starts before it, which grow once for a chunk, not
    for a block. A chunk is then a slice between two starts, so a topic's blocks are copied once.
    """
    state = "struct<at:int,used:int,starts:array<int>>"

    def step(s, piece):
        size = F.length(piece)
        over = (s["used"] > 0) & (s["used"] + size > n)
        return F.struct(
            s["at"] + 1,
            F.when(over, size).otherwise(s["used"] + size),
            F.when(over, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]),
        ).cast(state)

    start = F.struct(F.lit(1), F.lit(0), F.array(F.lit(1))).cast(state)
    rows = topics.select("path", block_pieces(F.col("html")).alias("pieces"))
    # the places after the last chunk end it
    starts = F.aggregate("pieces", start, step, lambda s: F.concat(s["starts"], F.array(s["at"])))
    rows = rows.filter(F.size("pieces") > 0).select("path", "pieces", starts.alias("starts"))

    def chunk(number):
        first = F.get("starts", number)
        own = F.slice("pieces", first, F.get("starts", number + 1) - first)
        return F.struct(number.alias("chunk_no"), F.size(own).alias("blocks"), F.array_join(own, "").alias("chunk"))

    chunks = F.transform(F.sequence(F.lit(0), F.size("starts") - 2), chunk)
    return rows.select("path", F.inline(chunks))
