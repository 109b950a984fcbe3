"""Conditional-text tags: extraction, usage, categories, filtering, mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions.text import (
    WORD_END,
    WORD_START,
    all_matches,
    any_of,
    let,
    trim_ws,
)

# --- fixed values -----------------------------------------------------------
CONDITION_ATTRIBUTES = ["madcap:conditions", "data-mc-conditions"]
CATEGORY_WORDS = [
    ("status", "deprecated?|deprecation|obsolete|legacy|old|paused?|halted?|stopped?|discontinued?|retired?"),
    ("color", "black|red|gray|grey|blue|green|yellow|orange|purple|pink"),
    ("print", r"print[\s\-_]?only|printonly|online[\s\-_]?only|onlineonly"),
    ("development", "cancelled?|canceled?|abandoned|shelved|draft|beta|alpha|experimental"),
    ("visibility", "hidden|internal|private|public|external"),
]
DEPRECATED_WORDS = [
    "deprecated?|deprecation|obsolete|legacy|old",
    "cancelled?|canceled?|abandoned|shelved",
    "discontinued?|retired?|paused?|halted?|stopped?",
    "black|red|gray|grey",
]
CATEGORY_ORDER = ["status", "development", "visibility", "color", "print", "custom"]
DESCRIPTIONS = [
    ("status", "deprecated", "Deprecated content - usually excluded from output"),
    ("status", "obsolete", "Obsolete content - no longer relevant"),
    ("status", "legacy", "Legacy content - from previous versions"),
    ("color", "", "Color-based condition - often used for review status or content categorization"),
    ("print", "print", "Print-only content - not shown in online output"),
    ("print", "online", "Online-only content - not shown in print output"),
    ("development", "draft", "Draft content - work in progress"),
    ("development", "beta", "Beta content - experimental features"),
    ("visibility", "internal", "Internal content - for internal use only"),
    ("visibility", "hidden", "Hidden content - not visible to end users"),
]
PRESETS = [
    ("production", "Production Ready", [
        "Deprecated", "Draft", "Internal", "Beta", "Alpha", "Hidden", "Legacy", "Obsolete", "Red", "Gray",
        "Grey", "Black", "Print-Only", "Cancelled", "Canceled", "Abandoned", "Shelved"], []),
    ("draft-review", "Draft Review", [], ["Draft", "Beta", "Internal"]),
    ("print-output", "Print Output", ["Online-Only", "OnlineOnly", "Hidden", "Internal"],
     ["Print-Only", "PrintOnly"]),
    ("customer-portal", "Customer Portal", ["Internal", "Hidden", "Deprecated", "Draft", "Beta"], []),
    ("maintenance", "Maintenance Review", [], ["Deprecated", "Legacy", "Obsolete", "Red", "Cancelled"]),
    ("no-filter", "No Filtering", [], []),
]
OUTPUT_FILTERS = {
    "web": 'platform="web"',
    "mobile": 'platform="mobile"',
    "desktop": 'platform="desktop"',
    "api": 'platform="api"',
    "admin": 'audience="admin"',
    "user": 'audience="user"',
    "developer": 'audience="developer"',
    "public": 'audience="public"',
    "release": 'status="release"',
    "beta": 'status="beta"',
    "alpha": 'status="alpha"',
    "deprecated": 'status="deprecated"',
}
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
}
REMOVED_MARK = "<!-- Removed content with MadCap conditions: {} -->"
MAJOR_INSTANCES = ["web", "mobile", "desktop", "admin", "user"]
# ---------------------------------------------------------------------------

OPEN_TAG = r"<[A-Za-z][^<>]*>"


def parse_conditions(c: Column) -> Column:
    """Condition string to tags: ``,`` or ``;`` part them, set prefixes are dropped."""
    def clean(tag):
        tag = F.regexp_replace(trim_ws(tag), r"^[\"']|[\"']\z", "")
        tag = F.regexp_replace(tag, r"(?i)^General\.", "")
        return trim_ws(F.regexp_replace(tag, r"(?i)^Default\.", ""))

    return F.filter(F.transform(F.split(c, "[,;]"), clean), lambda t: t != "")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in an opening tag, empty when absent."""
    return F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def tag_conditions(tag: Column) -> Column:
    """Tags of one element; the two attributes are joined with a blank."""
    joined = F.concat(attribute(tag, CONDITION_ATTRIBUTES[0]), F.lit(" "), attribute(tag, CONDITION_ATTRIBUTES[1]))
    return parse_conditions(joined)


def conditioned_tags(html: Column) -> Column:
    """Opening tags that carry a condition attribute."""
    return all_matches(html, r"(?i)<[A-Za-z][^<>]*\s(?:madcap:conditions|data-mc-conditions)\s*=[^<>]*>", 0)


def conditions_of(html: Column, mode: str = "dom") -> Column:
    """Distinct tags of a topic, as an array."""
    if mode == "dom":
        return F.array_distinct(F.flatten(F.transform(conditioned_tags(html), tag_conditions)))
    values = all_matches(html, r'(?i)(?:madcap:conditions|data-mc-conditions)="([^"]+)"')
    return F.array_distinct(F.flatten(F.transform(values, parse_conditions)))


def is_html(path: Column, content: Column) -> Column:
    by_name = F.lower(path).rlike(r"\.(htm|html)\z")
    return by_name | any_of(content.contains(m) for m in ["<html", "<!DOCTYPE", "<body"])


def extract_conditions(topics: DataFrame, mode: str = "dom") -> DataFrame:
    """``path, condition``; one row per tag and topic. The set is built inside the row."""
    gated = topics.filter(is_html(F.col("path"), F.col("html")))
    return gated.select("path", F.explode(conditions_of(F.col("html"), mode)).alias("condition"))


def analyzed_files(topics: DataFrame) -> DataFrame:
    """Number of topics past the gate, with or without tags."""
    return topics.filter(is_html(F.col("path"), F.col("html"))).agg(F.count("*").alias("file_count"))


def condition_usage(conditions: DataFrame) -> DataFrame:
    """Topics per tag. Rows are unique per (path, condition), so a plain count is
    enough and combines before the shuffle whatever the hottest tag is.

    The file list per tag stays a table (:func:`condition_files`), since one tag
    can cover a third of the corpus.
    """
    return conditions.groupBy("condition").agg(F.count("*").alias("usage"))


def condition_files(conditions: DataFrame) -> DataFrame:
    """``condition, path`` in name order: the usage lists as rows."""
    return conditions.select("condition", "path").orderBy("condition", "path")


def _words(c: Column, words: str) -> Column:
    return c.rlike(f"(?i){WORD_START}(?:{words}){WORD_END}")


def category(c: Column) -> Column:
    result = F.lit("custom")
    for name, words in reversed(CATEGORY_WORDS):
        result = F.when(_words(c, words), F.lit(name)).otherwise(result)
    return result


def is_deprecated(c: Column) -> Column:
    return any_of(_words(c, w) for w in DEPRECATED_WORDS)


def description(c: Column) -> Column:
    kind, low = category(c), F.lower(c)
    result = F.concat(F.lit("Custom condition: "), c)
    for name, word, text in reversed(DESCRIPTIONS):
        result = F.when((kind == name) & low.contains(word), F.lit(text)).otherwise(result)
    return result


def condition_info(usage: DataFrame) -> DataFrame:
    c = F.col("condition")
    return usage.select(
        "*",
        category(c).alias("category"),
        is_deprecated(c).alias("is_deprecated"),
        description(c).alias("description"),
    )


def recommended(info: DataFrame) -> Column:
    draft = (F.col("category") == "development") & F.lower(F.col("condition")).contains("draft")
    return F.col("is_deprecated") | draft


def condition_report(usage: DataFrame) -> DataFrame:
    """Tags with info in fixed category order, usage descending inside."""
    info = condition_info(usage)
    rank = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), F.col("category")).cast("int")
    return (
        info.select("*", rank.alias("category_rank"), recommended(info).alias("recommended_exclusion"))
        .orderBy("category_rank", F.desc("usage"), "condition")
    )


# --- filtering --------------------------------------------------------------
def elements(topics: DataFrame) -> DataFrame:
    """Flat elements in document order: ``path, element_no, tag, conditions, text``.

    Each opening tag owns the text up to the next tag.
    """
    pieces = all_matches(F.col("html"), r"<[A-Za-z][^<>]*>[^<]*", 0)
    rows = topics.select("path", F.posexplode(pieces).alias("element_no", "piece"))
    opening = F.regexp_extract("piece", r"^<[^<>]*>", 0)
    conditioned = opening.rlike(r"(?i)\s(madcap:conditions|data-mc-conditions)\s*=")
    return rows.select(
        "path",
        "element_no",
        F.lower(F.regexp_extract("piece", r"^<([A-Za-z][\w:.-]*)", 1)).alias("tag"),
        F.when(conditioned, tag_conditions(opening))
        .otherwise(F.array().cast("array<string>"))
        .alias("conditions"),
        conditioned.alias("conditioned"),
        trim_ws(F.regexp_extract("piece", r"^<[^<>]*>([^<]*)", 1)).alias("text"),
    )


def keeps(conditions: Column, include=None, exclude=None, conditioned: Column | None = None) -> Column:
    """Unconditioned content stays; otherwise include then exclude decide."""
    conditioned = F.size(conditions) > 0 if conditioned is None else conditioned
    keep = F.lit(True)
    if include:
        keep = keep & F.arrays_overlap(conditions, F.array(*[F.lit(x) for x in include]))
    if exclude:
        keep = keep & ~F.arrays_overlap(conditions, F.array(*[F.lit(x) for x in exclude]))
    return ~conditioned | keep


def filter_elements(elems: DataFrame, include=None, exclude=None) -> DataFrame:
    if not include and not exclude:
        return elems
    return elems.filter(keeps(F.col("conditions"), include, exclude, F.col("conditioned")))


TAG = r"</?[A-Za-z][\w:.-]*(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+>"
MARK = "\u0001"
CUT = "struct<from:int,to:int,tags:array<string>,open:boolean>"
SCAN = f"struct<name:string,depth:int,from:int,tags:array<string>,cuts:array<{CUT}>>"


def _tag_facts(piece: Column, i: Column) -> Column:
    name = F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][\w:.-]*)", 1))
    named = piece.rlike(rf"(?i)\s(?:{'|'.join(CONDITION_ATTRIBUTES)})\s*=\s*[\"'][^\"']*[\"']")
    return F.struct(
        i.alias("i"),
        piece.startswith("</").alias("closing"),
        name.alias("name"),
        (piece.endswith("/>") | name.isin(*sorted(VOID_TAGS))).alias("alone"),
        F.when(named, tag_conditions(piece)).alias("tags"),
    )


def _cuts(pieces: Column, include: list[str], exclude: list[str]) -> Column:
    """Ranges of pieces that go: one pass over the tags with the open element and its depth as state."""

    def removed(tags):
        missing = ~F.arrays_overlap(tags, F.array(*map(F.lit, include))) if include else F.lit(False)
        listed = F.arrays_overlap(tags, F.array(*map(F.lit, exclude))) if exclude else F.lit(False)
        return F.coalesce(missing | listed, F.lit(False))

    def cut(first, last, tags, is_open=False):
        return F.array(F.struct(first, last, tags, F.lit(is_open)).cast(CUT))

    def step(s, t):
        inside = s["name"].isNotNull()
        hit = ~inside & ~t["closing"] & removed(t["tags"])
        opens = hit & ~t["alone"]
        change = F.when((t["name"] == s["name"]) & ~t["alone"], F.when(t["closing"], -1).otherwise(1)).otherwise(0)
        depth = F.when(inside, s["depth"] + change).when(opens, 1).otherwise(0)
        ends = inside & (depth == 0)
        return F.struct(
            F.when(inside & ~ends, s["name"]).when(opens, t["name"]).alias("name"),
            depth.alias("depth"),
            F.when(hit, t["i"]).otherwise(s["from"]).alias("from"),
            F.when(hit, t["tags"]).otherwise(s["tags"]).alias("tags"),
            F.when(ends, F.concat(s["cuts"], cut(s["from"], t["i"], s["tags"])))
            .when(hit & t["alone"], F.concat(s["cuts"], cut(t["i"], t["i"], t["tags"])))
            .otherwise(s["cuts"])
            .alias("cuts"),
        ).cast(SCAN)

    def finish(s):
        left = F.when(s["name"].isNotNull(), cut(s["from"], s["from"], s["tags"], True)).otherwise(
            F.array().cast(f"array<{CUT}>")
        )
        return F.concat(s["cuts"], left)

    facts = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, _tag_facts(p, i)))
    start = F.struct(
        F.lit(None).cast("string"), F.lit(0), F.lit(0), F.array().cast("array<string>"), F.array().cast(f"array<{CUT}>")
    ).cast(SCAN)
    return F.aggregate(F.array_compact(facts), start, step, finish)


def _without_cuts(pieces: Column, cuts: Column) -> Column:
    def between(first, n):
        return F.array_join(F.slice(pieces, first, F.greatest(n, F.lit(0))), "")

    def part(x, i):
        before = F.coalesce(F.get(cuts, i - 1)["to"], F.lit(-1))
        told = F.format_string(REMOVED_MARK.replace("{}", "%s"), F.array_join(x["tags"], ", "))
        return F.concat(between(before + 2, x["from"] - before - 1), told)

    last = F.get(cuts, F.size(cuts) - 1)
    end = F.coalesce(last["to"], F.lit(-1))
    text = F.coalesce(F.get(pieces, end + 1), F.lit(""))
    # an element that is never closed takes the text up to the next tag only
    rest = F.when(F.coalesce(last["open"], F.lit(False)), F.regexp_extract(text, "(?s)^[^<]*(.*)$", 1)).otherwise(text)
    return F.concat(F.array_join(F.transform(cuts, part), ""), rest, between(end + 3, F.size(pieces) - end - 2))


def remove_conditioned(topics: DataFrame, include=None, exclude=None) -> DataFrame:
    """Topics whose conditioned elements are taken out with all they contain.

    Run this before references are resolved. Map-only; topics without a condition
    attribute are passed through as they are.
    """
    if not include and not exclude:
        return topics
    pieces = F.split(F.regexp_replace("html", TAG, MARK + "$0" + MARK), MARK, -1)
    cleaned = let(
        pieces, lambda p: let(_cuts(p, list(include or []), list(exclude or [])), lambda cuts: _without_cuts(p, cuts))
    )
    marked = F.coalesce(any_of(F.contains("html", F.lit(a)) for a in CONDITION_ATTRIBUTES), F.lit(False))
    return topics.withColumn("html", F.when(marked, cleaned).otherwise(F.col("html")))


def presets(spark: SparkSession) -> DataFrame:
    """Built-in presets: ``preset_id, name, exclude, include, is_built_in``."""
    rows = [(i, n, x, k, True) for i, n, x, k in PRESETS]
    schema = "preset_id string, name string, exclude array<string>, include array<string>, is_built_in boolean"
    return spark.createDataFrame(rows, schema)


def read_presets(documents: DataFrame) -> DataFrame:
    """Imported presets from a JSON ``value`` column; rows without id or name are dropped."""
    schema = (
        "array<struct<id: string, name: string, description: string, icon: string, "
        "excludeConditions: array<string>, includeConditions: array<string>>>"
    )
    rows = documents.select(F.inline(F.from_json("value", schema)))
    empty = F.array().cast("array<string>")
    return rows.filter(F.col("id").isNotNull() & F.col("name").isNotNull()).select(
        F.col("id").alias("preset_id"),
        "name",
        F.coalesce("excludeConditions", empty).alias("exclude"),
        F.coalesce("includeConditions", empty).alias("include"),
        F.lit(False).alias("is_built_in"),
    )


def apply_preset(elems: DataFrame, preset_id: str) -> DataFrame:
    chosen = {i: (x, k) for i, _, x, k in PRESETS}[preset_id]
    return filter_elements(elems, include=chosen[1], exclude=chosen[0])


# --- mapping to output filters ---------------------------------------------
def _mapping(extra=None) -> Column:
    pairs = {**OUTPUT_FILTERS, **(extra or {})}
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def mapped_filters(conditions: Column, extra=None) -> Column:
    return F.array_compact(F.transform(conditions, lambda c: F.try_element_at(_mapping(extra), F.lower(c))))


def map_conditions(elems: DataFrame, mapping=None, exclude=None) -> DataFrame:
    """Add ``filter`` and ``instance``; elements with an excluded tag are dropped.

    ``exclude`` holds lower-case tags, compared with the lower-cased tag.
    """
    if exclude:
        low = F.transform("conditions", lambda c: F.lower(c))
        elems = elems.filter(~F.arrays_overlap(low, F.array(*[F.lit(x) for x in exclude])))
    mapped = mapped_filters(F.col("conditions"), mapping)
    rows = elems.withColumn("_mapped", mapped)
    n, first = F.size("_mapped"), F.get("_mapped", F.lit(0))
    return rows.select(
        "*",
        F.when((n == 1) & first.contains("="), first)
        .when(n > 1, F.array_join("_mapped", ","))
        .alias("filter"),
        F.when((n == 1) & ~first.contains("="), first).alias("instance"),
    ).drop("_mapped")


def topic_instance(conditions: Column, extra=None) -> Column:
    """First mapped tag as instance name."""
    first = F.get(mapped_filters(conditions, extra), F.lit(0))
    value = F.regexp_replace(F.regexp_extract(first, "^[^=]*=([^=]*)", 1), '"', "")
    return F.coalesce(F.nullif(value, F.lit("")), first)


def detect_instances(usage: DataFrame, base_name: str) -> DataFrame:
    """``default`` plus the major output instances found among the tags."""
    low = F.lower("condition")
    found = usage.filter(low.isin(MAJOR_INSTANCES)).select(
        low.alias("id"),
        F.concat(F.lit(f"{base_name} - "), F.col("condition")).alias("name"),
        F.concat(low, F.lit(".tree")).alias("tree_file"),
    )
    spark = usage.sparkSession
    default = spark.createDataFrame(
        [("default", f"{base_name} Documentation", "default.tree")], "id string, name string, tree_file string"
    )
    return default.unionByName(found)


def sample_conditions(topics: DataFrame, n: int | None = None) -> DataFrame:
    """Distinct tags of all topics, or of the first ``n`` in path order."""
    first = topics.select("path", "html")
    first = first if n is None else first.orderBy("path").limit(n)
    values = all_matches(F.col("html"), r'data-mc-conditions="([^"]+)"')
    tags = F.flatten(F.transform(values, lambda v: F.transform(F.split(v, ","), trim_ws)))
    return first.select(F.explode(tags).alias("condition")).distinct()
