"""Snippet references and inlining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import all_matches, let
from docweft.operators.images import resolve_snippets
from docweft.session import cut

# --- fixed values -----------------------------------------------------------
# A snippet element, empty or with content; the first group tells block from text.
SNIPPET_ELEMENT = (
    r"(?is)<MadCap:snippet(Block|Text)\b[^<>]*/>|<MadCap:snippet(Block|Text)\b[^<>]*[^/<>]>.*?</MadCap:snippet\2>"
)
BLOCK_OPEN, BLOCK_CLOSE = '<div class="snippet-boundary">', "</div>"
MISSING_OPEN = '<div class="snippet-placeholder"><p><strong>🚨 SNIPPET PLACEHOLDER:</strong> '
MISSING_CLOSE = " - Check server logs for details</p></div>"
# ---------------------------------------------------------------------------

MARK = "\u0001"


def _source(piece: Column) -> Column:
    return F.regexp_extract(piece, r'(?i)^<[^<>]*\ssrc="([^"]*)"', 1)


def snippet_refs(topics: DataFrame) -> DataFrame:
    """``path, pos, src`` of snippet elements."""
    found = all_matches(F.col("html"), SNIPPET_ELEMENT, 0)
    rows = topics.select("path", F.posexplode(found).alias("pos", "piece"))
    return rows.select("path", "pos", _source(F.col("piece")).alias("src")).filter("src <> ''")


def body_of(content: Column) -> Column:
    """What stands between the body tags, or the whole text without them."""
    body = F.regexp_extract(content, r"(?is)<body\b[^>]*>(.*)</body>", 1)
    return F.when(content.rlike(r"(?is)<body\b[^>]*>.*</body>"), body).otherwise(content)


def inline_snippets(topics: DataFrame, snippets: DataFrame, root: str = "") -> DataFrame:
    """``path, html`` with snippet elements replaced by bodies, or by a placeholder.

    ``snippets`` has ``path, content``. One level, and a snippet may repeat. Only
    references travel to the lookup; bodies come back per topic, where they are part
    of the output anyway. Topics without a snippet element are passed through.
    """
    marked = F.coalesce(F.col("html").rlike(SNIPPET_ELEMENT), F.lit(False))
    rest = topics.filter(~marked).select("path", "html")
    topics = topics.filter(marked)
    refs = cut(snippet_refs(topics).select("path", "src").distinct())
    found = resolve_snippets(refs, snippets.select("path"), root)
    bodies = snippets.select(F.col("path").alias("found"), body_of(F.col("content")).alias("body"))
    per_topic = (
        found.filter(F.col("found").isNotNull())
        .join(bodies, "found")
        .groupBy("path")
        .agg(F.map_from_entries(F.collect_list(F.struct("src", "body"))).alias("bodies"))
    )
    joined = topics.select("path", "html").join(per_topic, "path", "left")
    none = F.create_map().cast("map<string,string>")

    def render(piece, i):
        src = _source(piece)
        body = F.try_element_at(F.coalesce(F.col("bodies"), none), src)
        block = piece.rlike("(?i)^<MadCap:snippetBlock")
        shown = F.when(block, F.concat(F.lit(BLOCK_OPEN), body, F.lit(BLOCK_CLOSE))).otherwise(body)
        missing = F.concat(F.lit(MISSING_OPEN), src, F.lit(MISSING_CLOSE))
        return F.when((i % 2 == 0) | (src == ""), piece).otherwise(F.coalesce(shown, missing))

    pieces = F.split(F.regexp_replace("html", SNIPPET_ELEMENT, MARK + "$0" + MARK), MARK, -1)
    shown = let(pieces, lambda ps: F.array_join(F.transform(ps, render), ""))
    return joined.select("path", shown.alias("html")).unionByName(rest)
