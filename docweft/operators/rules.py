"""Markup validation rules over lines, their rollup, and the repair passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import any_of, compact, let, trim_ws, zipped
from docweft.operators.lines import split_lines

# --- fixed values -----------------------------------------------------------
CONTINUATION = "orphaned-continuation"
LIST_STRUCTURE = "broken-list-structure"
TABLE_SYNTAX = "invalid-table-syntax"
IMAGE_MACRO = "invalid-image-macro"
INCLUDE = "missing-include"
RULE_SEVERITY = {
    CONTINUATION: "warning",
    LIST_STRUCTURE: "error",
    TABLE_SYNTAX: "error",
    IMAGE_MACRO: "error",
    INCLUDE: "warning",
}
FENCE = "|==="
BLOCK_NEXT = r"^\s*\[(?:NOTE|TIP|WARNING|CAUTION|IMPORTANT)\]"
LIST_ATTRIBUTE_NEXT = r"^\s*\[(?:loweralpha|upperalpha|lowerroman|upperroman)\]"
LIST_LINE = r"^\s*[.*]+\s"
NO_CONTENT = r"^[.=*-]+\s|^={2,}\s|^\[(?:source|cols|NOTE|TIP|WARNING|CAUTION|IMPORTANT)\]|^====|^----|\|==="
EMPHASIS_LINE = r"^\s*\*[^*\s]+.*\*\s*\z"
TEXTS = {
    "continuation": (
        "Orphaned continuation marker (+) detected. This marker is not properly attached to a block.",
        "Remove the orphaned + marker or ensure it properly continues a list item with adjacent content.",
    ),
    "dots": "Use proper nesting levels: . .. ... .... .....",
    "inline_attribute": (
        "List attribute [loweralpha] should be on separate line before list items",
        "Move [loweralpha] to its own line before the list",
    ),
    "mixed": "Use consistent list markers (all * or all .) at the same nesting level",
    "row": ("Table row must start with | character", "Ensure all table content lines start with |"),
    "open_table": ("Table not properly closed with |===", "Add |=== to close the table"),
    "image_path": ("Image macro missing file path", "Provide a valid image file path: image::path/to/image.png[]"),
    "image_alt": ("Image macro missing alt text", "Add descriptive alt text: image::path[Alt text description]"),
    "image_space": (
        "Image path contains spaces", "Replace spaces with %20 or use underscores/hyphens in file names",
    ),
    "include_path": (
        "Include directive missing file path", "Provide a valid include file path: include::path/to/file.adoc[]",
    ),
    "include_suffix": (
        "Variable include file may need .adoc extension", "Consider using: include::includes/variables.adoc[]",
    ),
}
# ---------------------------------------------------------------------------

COLUMNS = ["path", "rule_id", "severity", "message", "line", "col", "check", "suggestion"]
ISSUE = "struct<rule_id:string,severity:string,message:string,line:int,col:int,check:int,suggestion:string>"


def _issue(rule, severity, message, suggestion, line, col, check=0) -> Column:
    def text(x):
        return x if isinstance(x, Column) else F.lit(x)

    parts = [text(rule), text(severity), text(message), line, text(col), text(check), text(suggestion)]
    return F.struct(*parts).cast(ISSUE)


def line_array(text: Column) -> Column:
    """The lines of a text as ``array<struct<line, prev, next1, next2, no>>``; missing neighbours are null."""
    return let(
        split_lines(text),
        lambda arr: F.transform(
            arr,
            lambda x, i: F.struct(
                x.alias("line"), F.get(arr, i - 1).alias("prev"), F.get(arr, i + 1).alias("next1"),
                F.get(arr, i + 2).alias("next2"), (i + 1).alias("no"),
            ),
        ),
    )


def _each(z: Column, issues) -> Column:
    """Issues of every line, from a function of the line to an array of issues."""
    return F.flatten(F.transform(z, issues))


# Each rule is a function of the line array of a topic to an array of issues; nothing is shuffled.
def continuation_issues(z: Column) -> Column:
    """``+`` lines that continue nothing; looks one line back and two ahead."""

    def content(c):
        return (trim_ws(c) != "") & ~c.rlike(NO_CONTENT)

    def orphan(e):
        prev, n1, n2 = (F.coalesce(e[c], F.lit("")) for c in ("prev", "next1", "next2"))
        return (
            n1.rlike(BLOCK_NEXT)
            | n1.rlike(LIST_ATTRIBUTE_NEXT)
            | (prev.rlike(LIST_LINE) & n1.rlike(LIST_LINE))
            | ~(content(n1) | content(n2))
        )

    found = F.filter(z, lambda e: (trim_ws(e["line"]) == "+") & orphan(e))
    return F.transform(
        found,
        lambda e: _issue(CONTINUATION, "warning", *TEXTS["continuation"], e["no"], F.locate("+", e["line"])),
    )


def _marker(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\s*([.*])", 1), F.lit(""))


def list_issues(z: Column) -> Column:
    """Too many dots, an inline list attribute, and mixed markers at one indent.

    For the last check the state is the marker seen last at each indent; a line outside
    a list empties it.
    """

    def local(e):
        line = e["line"]
        dots = F.regexp_extract(line, r"^\s*(\.{4,})\s+(.+)\z", 1)
        too_many = F.concat(
            F.lit("Too many dots ("), F.length(dots).cast("string"),
            F.lit(") for list nesting. AsciiDoc supports up to 5 levels (.....)}"),
        )
        return compact(
            F.when(dots != "", _issue(LIST_STRUCTURE, "error", too_many, TEXTS["dots"], e["no"], 1, 0)),
            F.when(
                line.rlike(r"^(\s*[.*]+)\s+\[loweralpha\]"),
                _issue(
                    LIST_STRUCTURE, "warning", *TEXTS["inline_attribute"], e["no"], F.locate("[loweralpha]", line), 1
                ),
            ),
        )

    def fact(e):
        line = e["line"]
        return F.struct(
            e["no"].alias("no"),
            _marker(line).alias("marker"),
            F.length(F.regexp_extract(line, r"^(\s*)", 1)).alias("indent"),
            (line.rlike(r"^\s*[.*]+\s+") & (e["no"] > 1)).alias("item"),
            ((trim_ws(line) != "") & ~line.rlike(r"^\s*[.*+]+(\s|\z)")).alias("stop"),
            ((_marker(line) == "*") & line.rlike(EMPHASIS_LINE)).alias("emphasis"),
        )

    facts = F.filter(
        F.transform(z, fact),
        lambda f: ~F.coalesce(f["emphasis"], F.lit(False)) & (f["marker"].isNotNull() | f["stop"]),
    )
    state = f"struct<seen:map<int,string>,found:array<{ISSUE}>>"
    none = F.create_map().cast("map<int,string>")

    def step(s, f):
        seen = F.when(f["stop"], none).otherwise(s["seen"])
        before = F.try_element_at(seen, f["indent"])
        message = F.concat(
            F.lit("Mixed list markers at same level: '"), before, F.lit("' and '"), f["marker"], F.lit("'")
        )
        mixed = F.coalesce(f["item"] & ~f["stop"] & (before != f["marker"]), F.lit(False))
        issue = _issue(LIST_STRUCTURE, "warning", message, TEXTS["mixed"], f["no"], f["indent"] + 1, 2)
        return F.struct(
            F.when(
                f["marker"].isNotNull(),
                F.map_concat(
                    F.map_filter(seen, lambda k, _: k != f["indent"]), F.create_map(f["indent"], f["marker"])
                ),
            ).otherwise(seen),
            F.when(mixed, F.concat(s["found"], F.array(issue))).otherwise(s["found"]),
        ).cast(state)

    start = F.struct(none, F.array().cast(f"array<{ISSUE}>")).cast(state)
    return F.concat(_each(z, local), F.aggregate(facts, start, step, lambda s: s["found"]))


def table_issues(z: Column) -> Column:
    """Rows inside a table that do not start with a pipe, and tables left open.

    Fences open and close in turn, so the inside is what follows every other one.
    """

    def bad(e):
        line = e["line"]
        return (trim_ws(line) != "") & ~line.startswith("|") & ~line.rlike(r"^\s*\[.*\]\s*\z")

    fences = F.transform(F.filter(z, lambda e: trim_ws(e["line"]) == FENCE), lambda e: e["no"])

    def rows(f):
        opening = F.filter(F.transform(f, lambda no, k: F.when(k % 2 == 0, k)), lambda k: k.isNotNull())

        def inside(k):
            end = F.coalesce(F.get(f, k + 1), F.size(z) + 1)
            lines = F.filter(F.slice(z, F.get(f, k) + 1, end - F.get(f, k) - 1), bad)
            return F.transform(lines, lambda e: _issue(TABLE_SYNTAX, "error", *TEXTS["row"], e["no"], 1, 0))

        left_open = F.when(
            F.size(f) % 2 == 1,
            F.array(_issue(TABLE_SYNTAX, "error", *TEXTS["open_table"], F.get(f, F.size(f) - 1), 1, 1)),
        ).otherwise(F.array().cast(f"array<{ISSUE}>"))
        return F.concat(F.flatten(F.transform(opening, inside)), left_open)

    return let(fences, rows)


MARK = "\u0001"


def _located(line: Column, pattern: str) -> Column:
    """Matches with their 1-based columns: ``array<struct<m, col>>``."""

    def locate(pieces):
        numbered = F.filter(
            F.transform(pieces, lambda p, i: F.struct(p.alias("m"), i.alias("i"))), lambda e: e["i"] % 2 == 1
        )
        return F.transform(
            numbered,
            lambda e: F.struct(
                e["m"].alias("m"),
                (F.length(F.array_join(F.slice(pieces, F.lit(1), e["i"]), "")) + 1).alias("col"),
            ),
        )

    return let(F.split(F.regexp_replace(line, pattern, MARK + "$0" + MARK), MARK, -1), locate)


def image_issues(z: Column) -> Column:
    pattern = r"image(::?)([^\[\]]+)(\[([^\]]*)\])?"

    def findings(e, no):
        path, alt = F.regexp_extract(e["m"], pattern, 2), F.regexp_extract(e["m"], pattern, 4)
        col = e["col"]
        return compact(
            F.when(trim_ws(path) == "", _issue(IMAGE_MACRO, "error", *TEXTS["image_path"], no, col, 0)),
            F.when(trim_ws(alt) == "", _issue(IMAGE_MACRO, "warning", *TEXTS["image_alt"], no, col, 1)),
            F.when(
                path.contains(" ") & ~path.contains("%20"),
                _issue(IMAGE_MACRO, "warning", *TEXTS["image_space"], no, col, 2),
            ),
        )

    marked = F.filter(z, lambda e: e["line"].contains("image:"))
    return _each(marked, lambda e: _each(_located(e["line"], pattern), lambda m: findings(m, e["no"])))


def include_issues(z: Column) -> Column:
    pattern = r"include::([^\[\]]+)(\[([^\]]*)\])?"

    def findings(e, no):
        path, col = F.regexp_extract(e["m"], pattern, 1), e["col"]
        return compact(
            F.when(trim_ws(path) == "", _issue(INCLUDE, "error", *TEXTS["include_path"], no, col, 0)),
            F.when(
                path.contains("variables") & ~path.contains(".adoc"),
                _issue(INCLUDE, "info", *TEXTS["include_suffix"], no, col, 1),
            ),
        )

    marked = F.filter(z, lambda e: e["line"].contains("include::"))
    return _each(marked, lambda e: _each(_located(e["line"], pattern), lambda m: findings(m, e["no"])))


#: Per rule: the issues of a line array, and which texts can have any.
ROW_RULES = {
    CONTINUATION: (continuation_issues, lambda t: t.contains("+")),
    LIST_STRUCTURE: (list_issues, lambda t: t.rlike(r"(?m)^\s*[.*]+\s")),
    TABLE_SYNTAX: (table_issues, lambda t: t.contains(FENCE)),
    IMAGE_MACRO: (image_issues, lambda t: t.contains("image:")),
    INCLUDE: (include_issues, lambda t: t.contains("include::")),
}


def _row_rules(topics: DataFrame, chosen: list[str], text: str) -> DataFrame:
    """Issue rows of rules that look at one topic: one pass over the texts, map-only."""
    t, none = F.col(text), F.array().cast(f"array<{ISSUE}>")
    able = any_of(ROW_RULES[r][1](t) for r in chosen)

    def issues(z):
        return F.concat(*(F.when(ROW_RULES[r][1](t), ROW_RULES[r][0](z)).otherwise(none) for r in chosen))

    return topics.filter(able).select("path", F.inline(let(line_array(t), issues))).select(*COLUMNS)


def rule_orphaned_continuation(topics: DataFrame, text: str = "text") -> DataFrame:
    return _row_rules(topics, [CONTINUATION], text)


def rule_list_structure(topics: DataFrame, text: str = "text") -> DataFrame:
    return _row_rules(topics, [LIST_STRUCTURE], text)


def rule_table_syntax(topics: DataFrame, text: str = "text") -> DataFrame:
    return _row_rules(topics, [TABLE_SYNTAX], text)


def rule_image_macro(topics: DataFrame, text: str = "text") -> DataFrame:
    return _row_rules(topics, [IMAGE_MACRO], text)


def rule_include(topics: DataFrame, text: str = "text") -> DataFrame:
    return _row_rules(topics, [INCLUDE], text)


# --- registry and rollup ----------------------------------------------------
RULES = {
    CONTINUATION: rule_orphaned_continuation,
    LIST_STRUCTURE: rule_list_structure,
    TABLE_SYNTAX: rule_table_syntax,
    IMAGE_MACRO: rule_image_macro,
    INCLUDE: rule_include,
}

BUILT_IN = set(RULES.values())


def register_rule(rule_id: str, severity: str, function) -> None:
    """Add a rule: a function from topics to issue rows with :data:`COLUMNS`."""
    RULES[rule_id] = function
    RULE_SEVERITY[rule_id] = severity


def select_rules(severities=("error", "warning", "info"), enabled=None, strictness: str = "normal") -> list[str]:
    """Rule ids in order. The severity filter acts on the rule, not on its issues."""
    chosen = [r for r in RULES if RULE_SEVERITY[r] in severities]
    if enabled is not None:
        chosen = [r for r in chosen if r in enabled]
    if strictness == "lenient":
        chosen = [r for r in chosen if RULE_SEVERITY[r] == "error"]
    return chosen


def validate(topics: DataFrame, rules: list[str] | None = None, text: str = "text") -> DataFrame:
    """Issue rows of the chosen rules; the built-in ones share one pass over the texts."""
    chosen = list(RULES) if rules is None else rules
    built_in = [r for r in chosen if r in ROW_RULES and RULES[r] in BUILT_IN]
    parts = [_row_rules(topics, built_in, text)] if built_in else []
    parts += [RULES[r](topics, text) for r in chosen if r not in built_in]
    return reduce(lambda a, b: a.unionByName(b), parts)


def validation_summary(
    topics: DataFrame, issues: DataFrame, rules: list[str] | None = None, cap: int | None = None
) -> DataFrame:
    """Counts, status and rules applied per topic.

    With a ``cap`` the rules run in order and stop after the one that brings the topic
    to it; without one, the default, every issue counts.
    """
    chosen = list(RULES) if rules is None else rules
    kinds = ["error", "warning", "info"]
    cell = {(r, k): f"n{i}_{k}" for i, r in enumerate(chosen) for k in kinds}
    per = issues.groupBy("path").agg(
        *[F.count_if((F.col("rule_id") == r) & (F.col("severity") == k)).alias(n) for (r, k), n in cell.items()]
    )
    rows = topics.select("path").join(per, "path", "left").fillna(0)
    so_far, totals, applied = F.lit(0), {k: F.lit(0) for k in kinds}, []
    for r in chosen:
        runs = F.lit(True) if cap is None else so_far < cap
        applied.append(F.when(runs, F.lit(r)))
        for k in kinds:
            totals[k] = totals[k] + F.when(runs, F.col(cell[r, k])).otherwise(0)
        so_far = so_far + F.when(runs, sum((F.col(cell[r, k]) for k in kinds), F.lit(0))).otherwise(0)
    counted = rows.select(
        "path",
        *[totals[k].cast("bigint").alias(f"{k}_count") for k in kinds],
        F.array_join(compact(*applied), ",").alias("rules_applied"),
    )
    status = (
        F.when(F.col("error_count") > 0, "errors").when(F.col("warning_count") > 0, "warnings").otherwise("valid")
    )
    return counted.select(
        "path", (F.col("error_count") + F.col("warning_count") + F.col("info_count")).alias("issue_count"),
        "error_count", "warning_count", "info_count", status.alias("status"), "rules_applied",
    )


# --- repair -----------------------------------------------------------------
def _neighbours(c: Column) -> Column:
    none = F.array(F.lit(None).cast("string"))

    def shifted(arr):
        before = F.concat(none, F.slice(arr, F.lit(1), F.size(arr) - 1))
        after = F.concat(F.slice(arr, F.lit(2), F.greatest(F.size(arr) - 1, F.lit(0))), none)
        return zipped({"line": "string", "prev": "string", "next": "string"}, arr, before, after)

    return let(split_lines(c), shifted)


def _is_blank(c: Column) -> Column:
    return trim_ws(F.coalesce(c, F.lit(""))) == ""


def _pattern_pass(df: DataFrame, steps) -> DataFrame:
    for pattern, replacement in steps:
        df = df.select(
            "path",
            F.regexp_replace("fixed", pattern, replacement).alias("fixed"),
            (F.col("fixes") + F.regexp_count("fixed", F.lit(pattern))).alias("fixes"),
        )
    return df


def auto_fix(topics: DataFrame, text: str = "text") -> DataFrame:
    """``path, fixed, fixes``: six repair passes, all inside the row."""
    df = topics.select("path", F.col(text).alias("fixed"), F.lit(0).alias("fixes"))

    # 1 continuation markers next to a blank line go
    rows = df.select("path", "fixes", _neighbours(F.col("fixed")).alias("z"))
    kept = F.filter(
        "z",
        lambda e: ~((trim_ws(e["line"]) == "+") & (_is_blank(e["prev"]) | _is_blank(e["next"]))),
    )
    rows = rows.select("path", "fixes", F.size("z").alias("n"), kept.alias("kept"))
    df = rows.select(
        "path",
        F.array_join(F.transform("kept", lambda e: e["line"]), "\n").alias("fixed"),
        (F.col("fixes") + F.col("n") - F.size("kept")).alias("fixes"),
    )

    # 2 blank lines around admonitions
    df = _pattern_pass(
        df,
        [
            (r"([^\n])\n(\[(?:NOTE|TIP|WARNING|CAUTION|IMPORTANT)\])", "$1\n\n$2"),
            (r"(====)\n([^\n])", "$1\n\n$2"),
        ],
    )

    # 3 continuation markers before a list item are normalized
    rows = df.select("path", "fixed", "fixes", _neighbours(F.col("fixed")).alias("z"))

    def inner(e):
        return (trim_ws(e["line"]) == "+") & e["prev"].isNotNull() & e["next"].isNotNull()

    def good(e):
        after = trim_ws(F.coalesce(e["next"], F.lit("")))
        return ~_is_blank(e["prev"]) & (after != "") & ~after.startswith(".") & ~after.startswith("*")

    changed = F.size(
        F.filter("z", lambda e: inner(e) & ~good(e) & ~_is_blank(e["prev"]) & ~_is_blank(e["next"]))
    )
    rewritten = F.array_compact(
        F.transform(
            "z",
            lambda e: F.when(~inner(e) | good(e), e["line"]).when(~_is_blank(e["prev"]), F.lit("+")),
        )
    )
    rows = rows.select("path", "fixed", "fixes", changed.alias("n"), F.array_join(rewritten, "\n").alias("new"))
    df = rows.select(
        "path", F.when(F.col("n") > 0, F.col("new")).otherwise(F.col("fixed")).alias("fixed"),
        (F.col("fixes") + F.col("n")).alias("fixes"),
    )

    # 4 to 6 block images, inline images, runs of blank lines
    df = _pattern_pass(
        df,
        [
            (r"([^\n])\n(image::)", "$1\n\n$2"),
            (r"(image::[^\n]*\n)(\S)", "$1\n$2"),
            (r"(\w)(image:[^\[]*\[[^\]]*\])(\w)", "$1 $2 $3"),
            (r"\n\s*\n\s*\n+", "\n\n"),
        ],
    )
    return df
