"""Link extraction, typing, resolution, validation and rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import paths as P
from docweft.functions.text import all_matches, contains_any, nonempty, own_key, slug, topic_title, trim_ws, zipped
from docweft.operators import matching
from docweft.operators.lines import lines
from docweft.session import cut

# --- fixed values -----------------------------------------------------------
# Link forms per format: pattern, url group, text group (0: none), fixed text.
LINK_FORMS = {
    "markdown": [
        (r"!?\[([^\]]*)\]\(([^)]+)\)", 2, 1, None),
        (r"^\s*\[([^\]]+)\]:\s*(.+)\z", 2, 1, None),
    ],
    "asciidoc": [
        (r"(link|xref|image:?):\s*([^\[\s]+)(?:\[([^\]]*)\])?", 2, 3, None),
        (r"include::([^\[\s]+)(?:\[[^\]]*\])?", 1, 0, "include"),
    ],
    "help-center": [
        (r"<a\s+(?:[^>]*\s+)?href=[\"']([^\"']+)[\"'][^>]*>([^<]*)</a>", 1, 2, None),
        (
            r"<img\s+(?:[^>]*\s+)?src=[\"']([^\"']+)[\"'](?:[^>]*\s+alt=[\"']([^\"']*)[\"'])?[^>]*>",
            1, 2, "image",
        ),
    ],
}
# What a line must hold to have a link at all.
LINK_MARKS = {"markdown": ["]"], "asciidoc": [":"], "help-center": ["href=", "src="]}
STRICT_ASCIIDOC_LINK = r"(link|xref|image::?):\s*([^\[\s]+)(?:\[([^\]]*)\])?"
# Extensions a reference may carry and the one the output uses.
CONVERTED = {
    "markdown": {".htm": ".md", ".html": ".md", ".adoc": ".md"},
    "asciidoc": {".htm": ".adoc", ".html": ".adoc", ".md": ".adoc"},
    "help-center": {".htm": ".html", ".html": ".html", ".md": ".html", ".adoc": ".html"},
}
REPORT_GROUPS = {"image": "images", "anchor": "anchors", "external": "external"}
# Written variants of a moved file's name, numbers seen after the first dash.
DASH_NUMBERS = ["1", "12", "120", "2", "20", "220", "3", "30", "320"]
DOUBLE_DASH_NUMBERS = ["0", "20", "220", "320"]
# ---------------------------------------------------------------------------

FAMILY = {"writerside": "markdown"}


def extract_links(
    topics: DataFrame, format: str = "help-center", text: str = "html", strict_reference: bool = False
) -> DataFrame:
    """``path, line_no, form, pos, url, text`` in document order.

    ``strict_reference`` keeps two quirks: the second Markdown dialect yields no
    links, and inline images of AsciiDoc are missed.
    """
    family = FAMILY.get(format, format)
    forms = LINK_FORMS[family]
    if strict_reference:
        if format == "writerside":
            forms = []
        elif family == "asciidoc":
            forms = [(STRICT_ASCIIDOC_LINK, *forms[0][1:])] + forms[1:]
    item = "struct<form:int,pos:int,url:string,text:string>"
    arrays = [F.array().cast(f"array<{item}>")]

    def shaped(numbered, number, with_text, fixed):
        def shape(z, i):
            shown = z["text"] if with_text else F.lit(fixed)
            if fixed and with_text:
                shown = F.coalesce(nonempty(shown), F.lit(fixed))
            return F.struct(F.lit(number).alias("form"), i.alias("pos"), z["url"].alias("url"), shown.alias("text"))

        return F.transform(numbered, shape).cast(f"array<{item}>")

    for number, (pattern, url_group, text_group, fixed) in enumerate(forms):
        urls = all_matches(F.col("line"), pattern, url_group)
        texts = all_matches(F.col("line"), pattern, text_group or url_group)
        numbered = zipped({"url": "string", "text": "string"}, urls, texts)

        arrays.append(shaped(numbered, number, bool(text_group), fixed))
    rows = lines(topics, text).filter(contains_any(F.col("line"), LINK_MARKS[family]))
    return rows.select("path", "line_no", F.inline(F.concat(*arrays)))


def _needs_file(kind: Column) -> Column:
    return kind.isin("internal", "image")


def first_existing(keys: DataFrame, candidates: Column, files: DataFrame, by) -> DataFrame:
    """First candidate path (array order) that exists, per key: ``*by, found``.

    Existence is an equi join with the inventory; the winner is a min_by, which
    combines before its shuffle.
    """
    rows = keys.select(*by, F.posexplode(candidates).alias("pos", "candidate"))
    known = files.select(F.col("path").alias("candidate")).distinct()
    return rows.join(known, "candidate").groupBy(*by).agg(F.min_by("candidate", "pos").alias("found"))


def link_candidates(target: Column, format: str) -> Column:
    """Places where a link target may be, in order."""
    family = FAMILY.get(format, format)
    ext, default = P.extname(target), P.OUTPUT_EXTENSION[format]
    pairs = F.create_map(*[F.lit(v) for kv in CONVERTED[family].items() for v in kv])
    swapped = F.concat(F.substr(target, F.lit(1), F.length(target) - F.length(ext)), F.try_element_at(pairs, ext))
    return F.array_distinct(
        F.array_compact(
            F.array(
                target,
                swapped,
                F.concat(target, F.lit(".md")),
                F.concat(target, F.lit(".adoc")),
                F.concat(target, F.lit(".html")),
                F.regexp_replace(target, r"\.html?\z", default),
                F.regexp_replace(target, r"\.htm?\z", default),
            )
        )
    )


def resolve_links(links: DataFrame, files: DataFrame, format: str = "help-center") -> DataFrame:
    """Add ``target`` and ``resolved`` to internal and image links.

    Distinct targets are resolved, not links: a page that a third of the corpus
    points to is looked up once.
    """
    url = trim_ws(F.col("url"))
    written = P.url_path(url)
    wanted = _needs_file(P.link_type(url)) & (written != "")
    keyed = links.withColumn("target", F.when(wanted, P.resolve_from(F.col("path"), written)))
    targets = keyed.filter(F.col("target").isNotNull()).select("target").distinct()
    found = first_existing(targets, link_candidates(F.col("target"), format), files, ["target"])
    found = found.select(F.col("target").alias("_key"), F.col("found").alias("resolved"))
    rows = keyed.withColumn("_key", own_key(F.col("target"), F.col("path")))
    return rows.join(found, "_key", "left").drop("_key")


def validate_links(links: DataFrame, files: DataFrame, format: str = "help-center") -> DataFrame:
    """Links with type, validity, resolved path and error text."""
    url = trim_ws(F.col("url"))
    kind = P.link_type(url)
    rows = resolve_links(links, files, format).withColumn("link_type", kind)
    external_ok = P.valid_external(url)
    valid = (
        F.when(kind == "anchor", F.lit(True))
        .when(kind == "external", external_ok)
        .when(_needs_file(kind), F.col("resolved").isNotNull())
        .otherwise(F.lit(False))
    )
    error = (
        F.when(kind == "anchor", None)
        .when((kind == "external") & ~external_ok, "Invalid external URL format")
        .when(_needs_file(kind) & F.col("resolved").isNull(), "Could not resolve relative path")
        .when(kind == "unknown", "Unknown link type")
    )
    return rows.select("*", valid.alias("is_valid"), error.alias("error"))


def link_report(results: DataFrame) -> DataFrame:
    """One row of totals and valid/broken counts per type; unknown counts as internal."""
    group = F.lit("internal")
    for kind, name in REPORT_GROUPS.items():
        group = F.when(F.col("link_type") == kind, name).otherwise(group)
    rows = results.select("is_valid", "link_type", group.alias("grp"))
    ok = F.col("is_valid")
    aggs = [
        F.count("*").alias("total_links"),
        F.count_if(ok).alias("valid_links"),
        F.count_if(~ok).alias("broken_links"),
        F.count_if(~ok & (F.col("link_type") == "external")).alias("warnings"),
    ]
    for name in ["internal", "external", "images", "anchors"]:
        aggs.append(F.count_if(ok & (F.col("grp") == name)).alias(f"{name}_valid"))
        aggs.append(F.count_if(~ok & (F.col("grp") == name)).alias(f"{name}_broken"))
    return rows.agg(*aggs)


def broken_links(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("is_valid"))


def broken_targets(links: DataFrame, files: DataFrame, format: str = "help-center") -> DataFrame:
    """The same question as an anti join: distinct targets with no candidate present."""
    url = trim_ws(F.col("url"))
    written = P.url_path(url)
    targets = (
        links.filter(_needs_file(P.link_type(url)) & (written != ""))
        .select(P.resolve_from(F.col("path"), written).alias("target"))
        .distinct()
    )
    targets = cut(targets)  # texts are parsed once
    found = first_existing(targets, link_candidates(F.col("target"), format), files, ["target"])
    return targets.join(found, "target", "left_anti")


def top_broken(results: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` broken links in document order."""
    return broken_links(results).orderBy("path", "line_no", "form", "pos").limit(n)


def broken_rest(results: DataFrame, n: int = 20) -> DataFrame:
    """Broken links beyond the first ``n``, as one row."""
    total = broken_links(results).agg(F.count("*").alias("broken"))
    return total.select("broken", F.greatest(F.col("broken") - n, F.lit(0)).cast("bigint").alias("rest"))


def result_label(path: Column, line_no: Column, url: Column) -> Column:
    return F.concat(path, F.lit(":"), line_no.cast("string"), F.lit(" -> "), url)


# --- output names -----------------------------------------------------------
def plan_output_paths(topics: DataFrame, format: str = "asciidoc", rename: bool = False) -> DataFrame:
    """``path, out_path``; the title slug when renaming or for the help center."""
    path, ext = F.col("path"), P.OUTPUT_EXTENSION[format]
    name = P.stem(path)
    if rename or format == "help-center":
        name = F.coalesce(nonempty(slug(topic_title(F.col("html")))), name)
    return topics.select("path", P.join_path(P.dirname(path), F.concat(name, F.lit(ext))).alias("out_path"))


def output_collisions(plan: DataFrame) -> DataFrame:
    """Output paths that several topics share: count and the first topic.

    An aggregate, not a window: one popular title may hold a third of the corpus.
    """
    return (
        plan.groupBy("out_path")
        .agg(F.count("*").alias("topics"), F.min("path").alias("first_path"))
        .filter(F.col("topics") > 1)
    )


# --- rewriting --------------------------------------------------------------
KNOWN_EXTENSION = r"(?i)\.(html?|adoc|md)\z"


def link_stem(p: Column) -> Column:
    return P.basename(F.regexp_replace(p, KNOWN_EXTENSION, ""))


def rewrite_links(links: DataFrame, rename_map: DataFrame) -> DataFrame:
    """Add ``new_url``. ``links`` has ``out_path, url``; the map ``old_path, new_path, ord``.

    Equal path, equal path without extension and equal base name all imply the
    same stem, so one equi join with the first map row per stem is exact.
    """
    firsts = (
        rename_map.withColumn("stem", link_stem(F.col("old_path")))
        .filter(F.col("stem") != "")
        .groupBy("stem")
        .agg(F.min_by("new_path", "ord").alias("new_path"))
    )
    url = F.col("url")
    bare = F.regexp_replace(P.url_path(url), r"^(\.\./)+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^\./", ""), "^user/", "")
    stem = F.when(~P.skip_rewrite(url), nonempty(link_stem(bare)))
    keyed = links.withColumn("stem", own_key(stem, F.col("out_path")))
    new_url = P.relative_path(F.col("out_path"), F.col("new_path"), P.url_anchor(url))
    return keyed.join(firsts, "stem", "left").select(
        *links.columns, F.when(F.col("new_path").isNotNull(), new_url).otherwise(url).alias("new_url")
    )


def path_variants(old: Column, toc: Column, actual: Column) -> Column:
    """Ways a moved file may be written in links, in order of writing."""
    old_stem, toc_stem = P.stem(old), P.stem(toc)

    def adoc(c):
        return F.concat(c, F.lit(".adoc"))

    def doubled(c):
        return F.concat(c, F.lit("adoc.adoc"))

    numbered = [
        F.when(
            toc_stem.rlike(r"^\d+-\d+-"),
            F.concat(
                F.regexp_extract(toc_stem, r"^(\d+-\d+)-", 1),
                F.lit(digits),
                F.regexp_extract(toc_stem, r"^\d+-\d+-(.+)\z", 1),
                F.lit("adoc.adoc"),
            ),
        )
        for digits in DOUBLE_DASH_NUMBERS
    ]
    dashed = [
        doubled(
            F.when(
                toc_stem.contains("-"),
                F.concat(
                    F.substring_index(toc_stem, "-", 1), F.lit("-" + d),
                    F.substr(toc_stem, F.locate("-", toc_stem) + 1),
                ),
            ).otherwise(toc_stem)
        )
        for d in DASH_NUMBERS
    ]
    return F.array_compact(
        F.array(
            adoc(toc_stem),
            toc,
            doubled(toc_stem),
            doubled(old_stem),
            *numbered,
            *dashed,
            F.concat(F.lit("user/"), P.dirname(actual), F.lit("/"), adoc(toc_stem)),
            adoc(old_stem),
            adoc(F.lower(old_stem)),
            adoc(F.regexp_replace(old_stem, r"\s+", "")),
            P.basename(actual),
        )
    )


def variant_map(mapping: DataFrame) -> DataFrame:
    """``written, actual_path``: every variant of ``old_path, toc_path, actual_path, ord``.

    The last write of a variant wins.
    """
    rows = mapping.select(
        "ord",
        "actual_path",
        F.posexplode(path_variants(F.col("old_path"), F.col("toc_path"), F.col("actual_path"))).alias("k", "written"),
    )
    return rows.groupBy("written").agg(
        F.max_by("actual_path", F.struct("ord", "k")).alias("actual_path"),
        F.min(F.struct("ord", "k")).alias("ord"),
    )


def rewrite_toc_links(links: DataFrame, mapping: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Add ``new_url`` by exact variant; ``fuzzy`` tries path similarity on the rest."""
    variants = cut(variant_map(mapping)) if fuzzy else variant_map(mapping)  # several joins start from it
    url = F.col("url")
    written = F.when(~P.skip_rewrite(url), P.url_path(url))
    keyed = links.withColumn("written", own_key(written, F.col("out_path")))
    # by shuffle: a map of similar paths is many times larger than its files
    hit = keyed.join(variants.select("written", "actual_path").hint("merge"), "written", "left")
    target = F.col("actual_path")
    if fuzzy:
        rest = hit.filter(F.col("actual_path").isNull() & ~F.col("written").startswith("\u0000"))
        near = fuzzy_paths(rest.select(F.col("written").alias("link")), variants.select(
            F.col("written").alias("mapped"), F.col("actual_path").alias("value"), "ord"))
        hit = hit.join(near.select(F.col("link").alias("written"), "value").hint("merge"), "written", "left")
        target = F.coalesce("actual_path", "value")
    new_url = P.relative_path(F.col("out_path"), target, P.url_anchor(url))
    return hit.select(*links.columns, F.when(target.isNotNull(), new_url).otherwise(url).alias("new_url"))


def fuzzy_key(p: Column) -> Column:
    return F.regexp_replace(F.lower(p), "[^a-z0-9]", "")


def fuzzy_paths(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """``link, value, score``: first best similar path with a score above 0.5.

    ``links`` has ``link``; ``mapping`` has ``mapped, value, ord``.
    """
    keyed = cut(links.select("link").distinct().withColumn("a", fuzzy_key(F.col("link"))))
    right = mapping.select(fuzzy_key(F.col("mapped")).alias("b"), "ord", "value")
    best = matching.best_similar(keyed.select("a"), right)
    # by shuffle: both sides are many times larger than their files
    return keyed.join(best.hint("merge"), "a").select("link", "value", "score")


def match_contains(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """``link, value``: first map row where a path variant contains a link variant or
    the other way round. ``mapping`` has ``old_path, value, ord``."""
    link = F.col("link")
    link_forms = F.array_distinct(
        F.array(
            link,
            F.regexp_replace(link, r"(?i)\.adoc\z", ""),
            F.regexp_replace(link, r"(?i)\.adoc\z", ".htm"),
            P.stem(link),
        )
    )
    old = F.col("old_path")
    old_forms = F.array_distinct(
        F.array(old, F.regexp_replace(old, r"(?i)\.htm\z", ".adoc"), F.concat(P.stem(old), F.lit(".adoc")), P.stem(old))
    )
    left = cut(links.select("link").distinct().select("link", F.explode(link_forms).alias("a")))
    right = mapping.select("value", "ord", F.explode(old_forms).alias("b"))
    firsts = cut(right.groupBy("b").agg(F.min(F.struct("ord", "value")).alias("first")))
    per_form = matching.first_containment(left.select("a").distinct(), firsts)
    return left.join(per_form, "a").groupBy("link").agg(F.min("first").alias("m")).select("link", "m.value")
