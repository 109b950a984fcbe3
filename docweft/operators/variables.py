"""Variable definitions and references: merge, rename, resolve, flatten, suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweft.functions.text import (
    all_matches,
    any_of,
    escape,
    nonempty,
    rename,
    trim_ws,
    var_name,
)
from docweft.operators import matching
from docweft.operators.lines import lines
from docweft.session import cut

# --- fixed values -----------------------------------------------------------
# A variable element, empty or with text, and a span that carries the attribute.
VARIABLE_ELEMENT = (
    r"(?i)<MadCap:variable\b[^<>]*/>"
    r"|<MadCap:variable\b[^<>]*>[^<]*</MadCap:variable>"
    r"|<(\w+)\b[^<>]*(?:\sdata-mc-variable=|\sclass=[\"'][^\"']*mc-variable)[^<>]*>[^<]*</\1>"
)
MISSING_FORMS = [r"\{([^}]+)\}", r"\[%=([^%]+)%\]", r"%([^%]+)%"]
ATTRIBUTE_FILE_HEAD = [
    "// Generated AsciiDoc variables from MadCap conversion",
    "// This file contains document attributes for variable substitution",
    "",
]
XML_FILE_HEAD = [
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<!DOCTYPE vars SYSTEM "https://resources.jetbrains.com/writerside/1.0/vars.dtd">',
    "",
    "<!-- Generated Writerside variables from MadCap conversion -->",
    "<vars>",
]
# ---------------------------------------------------------------------------

MARK = "\u0001"


def merge_variables(defs: DataFrame) -> DataFrame:
    """Last definition of a name wins; ``position`` is where the name came first.

    One aggregation that combines before the shuffle, so a name defined in every
    set is no hot spot.
    """
    rest = [c for c in defs.columns if c not in ("name", "ord")]
    merged = defs.groupBy("name").agg(
        F.max_by(F.struct(*rest), "ord").alias("last"), F.min("ord").alias("position")
    )
    return merged.select("name", *[F.col("last")[c].alias(c) for c in rest], "position")


def namespace(name: Column) -> Column:
    return F.when(name.contains("."), F.substring_index(name, ".", 1))


def to_extracted(defs: DataFrame) -> DataFrame:
    """``namespace, key`` of named variables that have a value."""
    name = F.col("name")
    kept = defs.filter((F.coalesce(name, F.lit("")) != "") & (F.coalesce("value", F.lit("")) != ""))
    key = F.when(name.contains("."), F.substr(name, F.locate(".", name) + 1)).otherwise(name)
    return kept.select("*", namespace(name).alias("namespace"), key.alias("key"), F.lit("madcap").alias("source"))


def _pattern(p: str) -> str:
    """Regular expression; a leading ``*`` makes the pattern a glob."""
    if not p.startswith("*"):
        return p
    out = "".join(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if not ch.isalnum() else ch for ch in p)
    return f"^{out}$"


def filter_variables(defs: DataFrame, include=None, exclude=None) -> DataFrame:
    keep = F.lit(True)
    if exclude:
        keep = keep & ~any_of(F.col("name").rlike(_pattern(p)) for p in exclude)
    if include:
        keep = keep & any_of(F.col("name").rlike(_pattern(p)) for p in include)
    return defs.filter(keep)


def exclude_by_word(defs: DataFrame, words) -> DataFrame:
    name, value = F.lower("name"), F.lower("value")
    return defs.filter(~any_of(c.contains(w.lower()) for w in words for c in (name, value)))


def rename_variables(defs: DataFrame, convention: str = "original", prefix: str = "") -> DataFrame:
    return defs.withColumn("new_name", F.concat(F.lit(prefix), rename(F.col("name"), convention)))


def variables_by_namespace(variables: DataFrame) -> DataFrame:
    """Variables without a namespace first, then by namespace."""
    order = "position" if "position" in variables.columns else "ord"
    return variables.orderBy(F.col("namespace").asc_nulls_first(), order)


# --- references -------------------------------------------------------------
def _pieces(html: Column) -> Column:
    """Text cut at variable elements; elements sit at the odd places."""
    return F.split(F.regexp_replace(html, VARIABLE_ELEMENT, MARK + "$0" + MARK), MARK, -1)


def _element_name(piece: Column) -> Column:
    by_name = F.regexp_extract(piece, r'(?i)^<[^<>]*\sname="([^"]*)"', 1)
    by_data = F.regexp_extract(piece, r"(?i)^<[^<>]*\sdata-mc-variable=[\"']([^\"']*)[\"']", 1)
    css = F.regexp_extract(piece, r"(?i)^<[^<>]*\sclass=[\"']([^\"']*)[\"']", 1)
    dotted = F.regexp_extract(css, r"mc-variable\.(\w+)", 1)
    spaced = F.regexp_extract(css, r"mc-variable\s+([^.\s]+\.[^.\s]+)", 1)
    return F.coalesce(nonempty(by_name), nonempty(by_data), nonempty(dotted), nonempty(spaced))


def _inner_text(piece: Column) -> Column:
    return trim_ws(F.regexp_extract(piece, r"^<[^<>]*>([^<]*)", 1))


def variable_refs(topics: DataFrame) -> DataFrame:
    """``path, pos, ref, inner_text, form``; ``fallback`` marks ``{name}`` in text."""
    kind = "array<struct<pos:int,ref:string,inner_text:string,form:string>>"
    marked = F.filter(_pieces(F.col("html")), lambda p, i: (i % 2) == 1)
    elements = F.filter(
        F.transform(
            marked, lambda p, i: F.struct(i.alias("pos"), _element_name(p).alias("ref"), _inner_text(p), F.lit("madcap"))
        ),
        lambda x: x["ref"].isNotNull(),
    )
    text = F.regexp_replace("html", "<[^<>]*>", MARK)
    placeholders = F.filter(
        F.transform(
            all_matches(text, r"\{([^}]+)\}"),
            lambda r, i: F.struct(i.alias("pos"), r.alias("ref"), F.concat(F.lit("{"), r, F.lit("}")), F.lit("fallback")),
        ),
        lambda x: ~x["ref"].contains(" "),
    )
    return topics.select("path", F.inline(F.concat(elements.cast(kind), placeholders.cast(kind))))


def _dictionary(defs: DataFrame) -> DataFrame:
    return merge_variables(defs).select("name", nonempty(F.col("value")).alias("value"))


def resolve_names(names: DataFrame, defs: DataFrame) -> DataFrame:
    """``ref, value`` for distinct references: exact dotted name, then last segment.

    Distinct names are joined, so one popular variable is one row; Spark picks a
    broadcast or a shuffle by the size of the dictionary.
    """
    words = _dictionary(defs).filter(F.col("value").isNotNull())
    dotted = names.select("ref").distinct().filter(F.contains("ref", F.lit(".")))
    dotted = dotted.withColumn("last", F.substring_index("ref", ".", -1))
    exact = words.select(F.col("name").alias("ref"), F.col("value").alias("exact"))
    by_last = words.select(F.col("name").alias("last"), F.col("value").alias("by_last"))
    return (
        dotted.join(exact, "ref", "left")
        .join(by_last, "last", "left")
        .select("ref", F.coalesce("exact", "by_last").alias("value"))
        .filter(F.col("value").isNotNull())
    )


def resolve_variables(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """References with ``value``; null when the name is not defined."""
    refs = cut(refs)  # texts are parsed once
    return refs.join(resolve_names(refs, defs), "ref", "left")


def _values_per_topic(topics: DataFrame, pairs_of) -> DataFrame:
    """Topics with ``values``: a map of the names used in that topic.

    References are cut out of the texts once and kept as a small table; only names
    travel, and the map is bounded by the topic's own references.
    """
    refs = cut(variable_refs(topics).filter("form = 'madcap'").select("path", "ref").distinct())
    per_topic = (
        refs.join(pairs_of(refs), "ref")
        .groupBy("path")
        .agg(F.map_from_entries(F.collect_list(F.struct("ref", "value"))).alias("values"))
    )
    return topics.join(per_topic, "path", "left")


def _parted(topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics with a variable element, and ``path, html`` of those without, which nothing changes."""
    marked = F.coalesce(F.col("html").rlike(VARIABLE_ELEMENT), F.lit(False))
    return topics.filter(marked), topics.filter(~marked).select("path", "html")


def flatten_variables(topics: DataFrame, defs: DataFrame) -> DataFrame:
    """``path, html`` with references replaced by values, ``{name}`` when unresolved.

    Text already inside the element wins when it has no dot.
    """
    topics, rest = _parted(topics)
    joined = _values_per_topic(topics, lambda refs: resolve_names(refs, defs))
    empty = F.create_map().cast("map<string,string>")

    def render(piece, i):
        name, inner = _element_name(piece), _inner_text(piece)
        value = F.coalesce(
            F.try_element_at(F.coalesce(F.col("values"), empty), name),
            F.concat(F.lit("{"), name, F.lit("}")),
            F.concat(F.lit("{Variable: "), piece, F.lit("}")),
        )
        keep = (inner != "") & ~inner.contains(".")
        return F.when(i % 2 == 0, piece).when(keep, inner).otherwise(value)

    shown = F.array_join(F.transform(_pieces(F.col("html")), render), "")
    return joined.select("path", shown.alias("html")).unionByName(rest)


def reference_names(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """``ref, value``: the name a reference takes in reference mode.

    The first defined variable that equals the reference or one of its dotted
    suffixes, else the last segment.
    """
    names = refs.select("ref").distinct()
    parts = F.split("ref", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    merged = merge_variables(defs).select("name", "position")
    known = (
        names.select("ref", F.explode(suffixes).alias("name"))
        .join(merged, "name")
        .groupBy("ref")
        .agg(F.min_by("name", "position").alias("name"))
    )
    return names.join(known, "ref", "left").select(
        "ref", F.coalesce("name", F.substring_index("ref", ".", -1)).alias("value")
    )


def reference_variables(topics: DataFrame, defs: DataFrame, format: str = "asciidoc") -> DataFrame:
    """``path, html`` with references written as ``{attr-name}`` or ``<var name="…"/>``."""
    empty = F.create_map().cast("map<string,string>")
    topics, rest = _parted(topics)
    if format == "asciidoc":
        topics = _values_per_topic(topics, lambda refs: reference_names(refs, defs))
    else:
        topics = topics.withColumn("values", empty)

    def render(piece, i):
        name = _element_name(piece)
        if format == "asciidoc":
            final = F.coalesce(F.try_element_at(F.coalesce(F.col("values"), empty), name), name)
            shown = F.concat(F.lit("{"), var_name(final), F.lit("}"))
        else:
            shown = F.concat(F.lit('<var name="'), name, F.lit('"/>'))
        return F.when(i % 2 == 0, piece).otherwise(F.coalesce(shown, piece))

    shown = F.array_join(F.transform(_pieces(F.col("html")), render), "")
    return topics.select("path", shown.alias("html")).unionByName(rest)


# --- missing references -----------------------------------------------------
def missing_variables(topics: DataFrame, defs: DataFrame, text: str = "text") -> DataFrame:
    """``path, line_no, form, pos, name, context`` of references with no definition."""
    def names_of(form, pattern):
        return F.transform(
            all_matches(F.col("line"), pattern),
            lambda n, i: F.struct(F.lit(form).alias("form"), i.alias("pos"), trim_ws(n).alias("name")),
        )

    found = [names_of(form, pattern) for form, pattern in enumerate(MISSING_FORMS)]
    rows = lines(topics, text).select(
        "path", "line_no", trim_ws(F.col("line")).alias("context"), F.inline(F.concat(*found))
    )
    known = defs.select("name").distinct()
    return rows.join(known, "name", "left_anti").select("path", "line_no", "form", "pos", "name", "context")


def suggest_variables(missing: DataFrame, defs: DataFrame, n: int = 3) -> DataFrame:
    """``name, suggestions``: up to ``n`` names in definition order.

    Containment either way first; only without one, names within two edits. A blank
    name is contained in every other, so it gets the first ``n``; blank names of ``defs``
    are never suggested.
    """
    wanted = missing.select("name").distinct().withColumn("a", F.lower("name"))
    known = defs.groupBy("name").agg(F.min("ord").alias("ord")).select(
        F.col("name").alias("known"), "ord", F.lower("name").alias("b")
    ).filter("b <> ''")
    known = cut(known.select("b", F.struct("ord", "known").alias("first")))
    left = cut(wanted.select("a").distinct())
    inside = cut(matching.first_containments(left.filter("a <> ''"), known, n))
    rest = left.filter("a <> ''").join(inside.select("a").distinct(), "a", "left_anti")
    near = matching.within_two_edits(rest, known.select("b").distinct()).join(known, "b").select("a", "first")
    blank = known.orderBy("first").limit(n).select(F.lit("").alias("a"), "first")
    top = (
        inside.unionByName(near).unionByName(blank)
        .select("a", "first.ord", "first.known")
        .withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("ord")))
        .filter(F.col("rank") <= n)
        .groupBy("a")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "known"))).alias("top"))
    )
    return wanted.join(top, "a", "left").select(
        "name",
        F.coalesce(F.transform("top", lambda t: t["known"]), F.array().cast("array<string>")).alias("suggestions"),
    )


# --- rendering --------------------------------------------------------------
def render_variables(variables: DataFrame, format: str = "asciidoc", grouped: bool = False) -> DataFrame:
    """``sort_key, line`` rows of a variables file; write them with ``write_outputs``.

    The file is never one value: the sink sorts by range and writes in parallel.
    """
    order = "position" if "position" in variables.columns else "ord"
    name, value = F.col("name"), F.coalesce("value", F.lit(""))
    if format == "asciidoc":
        line = F.concat(F.lit(":"), var_name(name), F.lit(": "), escape(value, "backslash"))
        head, tail, comment = ATTRIBUTE_FILE_HEAD, [], ("// ", " Variables")
    else:
        line = F.concat(
            F.lit('    <var name="'), var_name(name, "xml"), F.lit('" value="'), escape(value), F.lit('"/>')
        )
        head, tail, comment = XML_FILE_HEAD, ["</vars>"], ("    <!-- ", " Variables -->")
    space = F.coalesce("namespace", F.lit("")) if grouped else F.lit("")
    notes = F.array().cast("array<struct<seq:int,line:string>>")
    if not grouped and "comment" in variables.columns:
        note = F.concat(F.lit(comment[0]), F.col("comment"), F.lit(comment[1].replace(" Variables", "")))
        notes = F.when(
            F.col("comment").isNotNull(), F.array(F.struct(F.lit(0).alias("seq"), note.alias("line")))
        ).otherwise(notes)
    body = variables.select(
        F.lit(1).alias("part"), space.alias("space"), F.lit(1).alias("block"), F.col(order).alias("at"),
        F.inline(F.concat(notes, F.array(F.struct(F.lit(1).alias("seq"), line.alias("line"))))),
    )
    at_type = body.schema["at"].dataType
    frames = [body]
    if grouped:
        spaces = variables.select(space.alias("space")).distinct()
        title = F.when(
            F.col("space") != "", F.concat(F.lit(comment[0]), F.col("space"), F.lit(comment[1]))
        )
        edges = F.array(
            F.struct(F.lit(0).alias("block"), title.alias("line")),
            F.struct(
                F.lit(2).alias("block"),
                F.when((F.col("space") != "") | F.lit(format == "asciidoc"), F.lit("")).alias("line"),
            ),
        )
        frames.append(
            spaces.select(
                F.lit(1).alias("part"), "space", F.inline(F.filter(edges, lambda e: e["line"].isNotNull()))
            ).select("part", "space", "block", F.lit(None).cast(at_type).alias("at"), F.lit(0).alias("seq"), "line")
        )
    spark = variables.sparkSession
    fixed = [(0, i, text) for i, text in enumerate(head)] + [(2, i, text) for i, text in enumerate(tail)]
    frames.append(
        spark.createDataFrame(fixed, "part int, seq int, line string").select(
            "part", F.lit("").alias("space"), F.lit(0).alias("block"), F.lit(None).cast(at_type).alias("at"), "seq", "line"
        )
    )
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result.select(F.struct("part", "space", "block", "at", "seq").alias("sort_key"), "line")
