"""Queries over quality scoring and markup rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.operators import blocks, quality, rules
from docweft.operators.lines import lines as line_rows
from docweft.plans.derived import view
from docweft.plans.sqltext import blank, contains_any, ctes, extract, extract_all, lines, q, registry, rlike, sub, trim

QUERIES, ORACLES, query = registry()


IMG, LNK = quality.IMAGE_FORM["asciidoc"], quality.LINK_FORM["asciidoc"]


def facts_sql(text="text"):
    return f"""{rlike(text, '(?m)^=[ \t\n\f\r]+[^\n\r]+$')} as has_title, length({trim(text)}) > 100 as has_content,
 cast(len({extract_all(text, IMG, 0)}) as bigint) as image_count, cast(len({extract_all(text, LNK, 0)}) as bigint) as link_count,
 cast(len(string_split({text}, chr(10))) as bigint) as line_count"""


@query("quality_facts", ctes("drafts") + f" select path, {facts_sql()} from drafts")
def quality_facts(spark, d):
    return quality.structure_facts(view(spark, d, "drafts"))


@query("document_lines", "select lang, source, cast(sum(len(string_split(text, chr(10)))) as bigint) as line_count, count(*) as documents from documents group by all")
def document_lines(spark, d):
    docs = view(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string"))
    facts = quality.structure_facts(docs, "other").withColumnRenamed("path", "doc_id")
    keys = docs.select(F.col("path").alias("doc_id"), "lang", "source")
    return facts.join(keys, "doc_id").groupBy("lang", "source").agg(
        F.sum("line_count").alias("line_count"), F.count("*").alias("documents")
    )


LONG = f"long as (select path, line_no, {trim('line')} as key from lines where length({trim('line')}) > 20)"
DUP = "dup as (select path, key, min(line_no) as pos, string_agg(cast(line_no as varchar), ', ' order by line_no) as ns from long group by path, key having count(*) > 1)"


@query(
    "quality_duplicates",
    "with drafts as (select cast(doc_id as varchar) as path, text from documents), " + lines("drafts", "text")
    + f", {LONG}, {DUP} select path, cast(pos as integer) as pos, 'Duplicate content found on lines ' || ns as message from dup",
)
def quality_duplicates(spark, d):
    docs = view(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return quality.issues_duplicates(docs).select("path", "pos", "message")


def _row_issues():
    """Row-local issues as (rank, pos, type, message) selects."""
    out = []
    for i, p in enumerate(quality.SCRIPT_PATTERNS):
        out.append(f"select path, 1 as rank, {i} as pos, 'error' as type, {q(quality.SCRIPT_ISSUE[0])} as message from drafts where {rlike('text', p)}")
    out.append(
        "select path, 2, 0, 'warning', 'Unconverted HTML tags found: ' || string_agg(name, ', ' order by first) from ("
        f"select path, {sub('tag', '</?([a-zA-Z0-9]+)[^>]*>', chr(92) + '1')} as name, min(n) as first from ("
        f"select path, unnest({extract_all('text', '</?[a-zA-Z][^>]*>', 0)}) as tag, generate_subscripts({extract_all('text', '</?[a-zA-Z][^>]*>', 0)}, 1) as n from drafts)"
        f" where not starts_with(tag, '</') and not {rlike('tag', '^</?(?:sub|sup|br|hr)>')} group by 1, 2) group by path"
    )
    out.append(f"select path, 3, 0, 'error', {q(quality.LATEX_ISSUE[0])} from drafts where contains(text, 'latexmath:[')")
    out.append(f"select path, 4, 0, 'error', {q(quality.REFERENCE_ISSUE[0])} from drafts where {rlike('text', '<ref_[0-9]+,[[][0-9]+[]]>')}")
    out.append(
        "select path, 5, line_no, 'warning', 'Duplicate header found: ' || line from ("
        f"select *, row_number() over (partition by path, line order by line_no) as again from lines where {rlike('line', '^=+' + chr(92) + 's+')}) where again > 1"
    )
    out.append(
        "select path, 6, 0, 'error', 'Multiple document titles found (' || count(*) || ' total)' from lines where starts_with(line, '= ') group by path having count(*) > 1"
    )
    out.append(f"select path, 7, 0, 'warning', {q(quality.NO_TITLE[0])} from facts where not has_title")
    out.append(f"select path, 8, 0, 'error', {q(quality.LITTLE_CONTENT[0])} from facts where not has_content")
    out.append(
        f"select path, 9, 0, 'warning', {q(quality.MUCH_MARKUP[0])} from drafts where length(text) > 0 and "
        f"cast(len({extract_all('text', quality.MARKUP_CHARS, 0)}) as double) / length(text) > 0.3"
    )
    for i, m in enumerate(quality.ENCODING_MARKS):
        out.append(f"select path, 11, {i}, 'warning', {q(quality.ENCODING_ISSUE[0])} from drafts where contains(text, {q(m)})")
    paths = extract_all("text", r"image::?([^\[\]]+)\[")
    img = f"(select path, unnest({paths}) as p, generate_subscripts({paths}, 1) - 1 as n from drafts)"
    up = extract_all("p", "[.][.]/", 0)
    out.append(
        f"select path, 12, n * 2, 'warning', 'Suspicious image path with many directory traversals: ' || p from {img} where not contains(p, 'data:') and len({up}) > 3"
    )
    out.append(
        f"select path, 12, n * 2 + 1, 'info', 'Image without standard extension: ' || p from {img} where not contains(p, 'data:') and not {rlike('p', quality.IMAGE_SUFFIX)}"
    )
    lp = extract_all("text", r"(?:xref:|link:)([^\[\]]+)\[")
    out.append(
        f"select path, 13, n, 'info', 'Link may need extension conversion: ' || p from (select path, unnest({lp}) as p, generate_subscripts({lp}, 1) - 1 as n from drafts) where contains(p, '..htm')"
    )
    out.append("select path, 10, pos, 'warning', 'Duplicate content found on lines ' || ns from dup")
    return " union all ".join(out)


ISSUES = (
    ctes("drafts") + ", " + lines("drafts", "text")
    + f", facts as (select path, {facts_sql()} from drafts), {LONG}, {DUP}, issues as ({_row_issues()})"
)
SCORED = (
    ISSUES
    + """, per as (select path, count(*) filter (type = 'error') as errors, count(*) filter (type = 'warning') as warnings,
 count(*) filter (type = 'info') as infos from issues group by path),
 joined as (select f.*, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, coalesce(infos, 0) as infos from facts f left join per using (path)),
 scored as (select *, greatest(0, least(100, 100 - 15 * errors - 5 * warnings - infos + case when has_title then 5 else 0 end
  + case when has_content then 10 else 0 end + case when image_count > 0 then 2 else 0 end + case when link_count > 0 then 2 else 0 end)) as score from joined),
 banded as (select *, case when score >= 90 then 'Excellent' when score >= 75 then 'Good' when score >= 50 then 'Fair' else 'Poor' end as band from scored)"""
)


@query(
    "quality_issues",
    ISSUES + " select path, cast(rank as integer) as rank, cast(pos as integer) as pos, type, message from issues",
)
def quality_issues(spark, d):
    return quality.quality_issues(view(spark, d, "drafts")).select("path", "rank", "pos", "type", "message")


SCORE_COLUMNS = "path, has_title, has_content, image_count, link_count, line_count, errors, warnings, infos, score, band"


@query("quality_score", SCORED + f" select {SCORE_COLUMNS} from banded")
def quality_score(spark, d):
    return quality.quality_scores(view(spark, d, "drafts"))


@query("quality_score_from_tables", SCORED + f" select {SCORE_COLUMNS} from banded")
def quality_score_from_tables(spark, d):
    drafts = view(spark, d, "drafts")
    return quality.quality_score(quality.structure_facts(drafts), quality.quality_issues(drafts))


@query(
    "quality_bands",
    SCORED + " select band, count(*) as topics, min(score) as lowest, cast(sum(errors) as bigint) as errors from banded group by band",
)
def quality_bands(spark, d):
    return quality.quality_scores(view(spark, d, "drafts")).groupBy("band").agg(
        F.count("*").alias("topics"), F.min("score").alias("lowest"), F.sum("errors").alias("errors")
    )


@query(
    "quality_texts",
    SCORED + """ select path, band || ' conversion quality (' || score || '/100). ' || errors || ' errors, ' || warnings || ' warnings.'
 || case band when 'Fair' then ' Review recommended.' when 'Poor' then ' Manual review required.' else '' end as summary from banded""",
)
def quality_texts(spark, d):
    scores = quality.quality_scores(view(spark, d, "drafts"))
    text = quality.quality_text(F.col("score"), F.col("errors"), F.col("warnings"))
    return scores.select("path", text.alias("summary"))


@query(
    "quality_summary",
    SCORED + """ select count(*) as topics, cast(floor(avg(score) + 0.5) as bigint) as average_score,
 cast(sum(errors + warnings + infos) as bigint) as total_issues, count(*) filter (score < 70) as low_quality from banded""",
)
def quality_summary(spark, d):
    return quality.quality_summary(quality.quality_scores(view(spark, d, "drafts")))


@query("low_quality", SCORED + " select path, score, errors + warnings + infos as issues from banded where score < 70")
def low_quality(spark, d):
    return quality.low_quality(quality.quality_scores(view(spark, d, "drafts")))


@query(
    "top_issues",
    ISSUES + """, placed as (select *, row_number() over (partition by path order by case type when 'error' then 0 when 'warning' then 1 else 2 end, rank, pos) as place from issues)
 select path, cast(place as integer) as place, upper(type) || ': ' || message as warning from placed where place <= 3""",
)
def top_issues(spark, d):
    return quality.top_issues(view(spark, d, "drafts"))


# --- rules ------------------------------------------------------------------
CTX = (
    ctes("drafts") + ", " + lines("drafts", "text")
    + ", ctx as (select *, coalesce(lag(line) over w, '') as prev, coalesce(lead(line) over w, '') as n1, coalesce(lead(line, 2) over w, '') as n2 "
    "from lines window w as (partition by path order by line_no))"
)


def _content(c):
    return f"(not {blank(c)} and not {rlike(c, rules.NO_CONTENT)})"


RULE_CONTINUATION = f"""select path, line_no, 'orphaned-continuation' as rule_id, 'warning' as severity, instr(line, '+') as col, {q(rules.TEXTS['continuation'][0])} as message
 from ctx where {trim('line')} = '+' and ({rlike('n1', rules.BLOCK_NEXT)} or {rlike('n1', rules.LIST_ATTRIBUTE_NEXT)}
 or ({rlike('prev', rules.LIST_LINE)} and {rlike('n1', rules.LIST_LINE)}) or not ({_content('n1')} or {_content('n2')}))"""

DOTS = r"^\s*(\.{4,})\s+(.+)\z"
RULE_LISTS = f"""select path, line_no, 'broken-list-structure' as rule_id, 'error' as severity, 1 as col,
  'Too many dots (' || length({extract('line', DOTS)}) || ') for list nesting. AsciiDoc supports up to 5 levels (.....)}}' as message
 from lines where {rlike('line', DOTS)}
 union all select path, line_no, 'broken-list-structure', 'warning', instr(line, '[loweralpha]'), {q(rules.TEXTS['inline_attribute'][0])}
 from lines where {rlike('line', r'^(\s*[.*]+)\s+\[loweralpha\]')}
 union all select path, line_no, 'broken-list-structure', 'warning', indent + 1, 'Mixed list markers at same level: ''' || before || ''' and ''' || marker || '''' from (
  select *, lag(marker) over (partition by path, island, indent order by line_no) as before from (
   select *, sum(case when stop then 1 else 0 end) over (partition by path order by line_no) as island from (
    select path, line_no, nullif({extract('line', r'^\s*([.*])')}, '') as marker, length({extract('line', r'^(\s*)')}) as indent,
     {rlike('line', r'^\s*[.*]+\s+')} and line_no > 1 as item, not {blank('line')} and not {rlike('line', r'^\s*[.*+]+(\s|\z)')} as stop,
     {rlike('line', rules.EMPHASIS_LINE)} as emphasis from lines) where not emphasis)
   where marker is not null) where item and not stop and before <> marker"""

RULE_TABLES = f"""select path, line_no, 'invalid-table-syntax' as rule_id, 'error' as severity, 1 as col, {q(rules.TEXTS['row'][0])} as message from fences
 where n % 2 = 1 and not fence and not {blank('line')} and not starts_with(line, '|') and not {rlike('line', r'^\s*\[.*\]\s*$')}
 union all select path, max(line_no), 'invalid-table-syntax', 'error', 1, {q(rules.TEXTS['open_table'][0])} from fences where fence group by path having count(*) % 2 = 1"""
FENCES = f", fences as (select *, {trim('line')} = '|===' as fence, sum(case when {trim('line')} = '|===' then 1 else 0 end) over (partition by path order by line_no) as n from lines)"

IMAGE_PATTERN = r"image(::?)([^\[\]]+)(\[([^\]]*)\])?"
INCLUDE_PATTERN = r"include::([^\[\]]+)(\[([^\]]*)\])?"


def _located(pattern, groups):
    """Matches per line with the column of each (found by walking the line)."""
    picks = ", ".join(f"unnest({extract_all('line', pattern, g)}) as g{g}" for g in groups)
    whole = extract_all("line", pattern, 0)
    return (
        f"select path, line_no, line, {picks}, unnest({whole}) as m, unnest(list_transform(range(len({whole})), lambda i: "
        f"1 + length(array_to_string(({'string_split_regex(line, ' + q(pattern) + ')'})[1:i + 1], '')) + "
        f"length(array_to_string({whole}[1:i], '')))) as col from lines"
    )


RULE_IMAGES = f"""select path, line_no, 'invalid-image-macro' as rule_id, 'error' as severity, col, {q(rules.TEXTS['image_path'][0])} as message from macros where {blank('g2')}
 union all select path, line_no, 'invalid-image-macro', 'warning', col, {q(rules.TEXTS['image_alt'][0])} from macros where {blank("coalesce(g4, '')")}
 union all select path, line_no, 'invalid-image-macro', 'warning', col, {q(rules.TEXTS['image_space'][0])} from macros where contains(g2, ' ') and not contains(g2, '%20')"""
RULE_INCLUDES = f"""select path, line_no, 'missing-include' as rule_id, 'error' as severity, col, {q(rules.TEXTS['include_path'][0])} as message from includes where {blank('g1')}
 union all select path, line_no, 'missing-include', 'info', col, {q(rules.TEXTS['include_suffix'][0])} from includes where contains(g1, 'variables') and not contains(g1, '.adoc')"""
RULE_CTES = CTX + FENCES + f", macros as ({_located(IMAGE_PATTERN, (2, 4))}), includes as ({_located(INCLUDE_PATTERN, (1,))})"
PICK = "select path, cast(line_no as integer) as line, rule_id, severity, cast(col as integer) as col, message from"


def _rule(function):
    def run(spark, d):
        return function(view(spark, d, "drafts")).select("path", "line", "rule_id", "severity", "col", "message")

    return run


for _name, _function, _sql in (
    ("rule_continuation", rules.rule_orphaned_continuation, RULE_CONTINUATION),
    ("rule_lists", rules.rule_list_structure, RULE_LISTS),
    ("rule_tables", rules.rule_table_syntax, RULE_TABLES),
    ("rule_images", rules.rule_image_macro, RULE_IMAGES),
    ("rule_includes", rules.rule_include, RULE_INCLUDES),
):
    query(_name, f"{RULE_CTES} {PICK} ({_sql})")(_rule(_function))

ALL_RULES = f"{RULE_CTES}, issues as ({RULE_CONTINUATION} union all {RULE_LISTS} union all {RULE_TABLES} union all {RULE_IMAGES} union all {RULE_INCLUDES})"


@query(
    "validation_summary",
    ALL_RULES + """, per as (select path, count(*) as issue_count, count(*) filter (severity = 'error') as error_count,
 count(*) filter (severity = 'warning') as warning_count, count(*) filter (severity = 'info') as info_count from issues group by path)
 select path, coalesce(issue_count, 0) as issue_count, coalesce(error_count, 0) as error_count, coalesce(warning_count, 0) as warning_count,
 coalesce(info_count, 0) as info_count, case when error_count > 0 then 'errors' when warning_count > 0 then 'warnings' else 'valid' end as status,
 'orphaned-continuation,broken-list-structure,invalid-table-syntax,invalid-image-macro,missing-include' as rules_applied
 from drafts left join per using (path)""",
)
def validation_summary(spark, d):
    drafts = view(spark, d, "drafts")
    return rules.validation_summary(drafts, rules.validate(drafts))


@query(
    "validation_lenient",
    ALL_RULES + f" {PICK} (select * from issues where rule_id in ('broken-list-structure', 'invalid-table-syntax', 'invalid-image-macro'))",
)
def validation_lenient(spark, d):
    chosen = rules.select_rules(strictness="lenient")
    issues = rules.validate(view(spark, d, "drafts"), chosen)
    return issues.select("path", "line", "rule_id", "severity", "col", "message")


def _fix_sql():
    """The repair passes step by step; only the whole-text passes and counts."""
    keep = f"not ({trim('line')} = '+' and ({blank('prev')} or {blank('n1')}))"
    first = (
        f"p1 as (select path, string_agg(line, chr(10) order by line_no) filter ({keep}) as t, "
        f"count(*) filter (not {keep}) as f from ctx group by path)"
    )
    back = chr(92)

    def step(name, source, pattern, replacement):
        return (
            f"{name} as (select path, {sub('t', pattern, replacement)} as t, f + len({extract_all('t', pattern, 0)}) as f from {source})"
        )

    good = f"({blank('prev')} = false and {blank('n1')} = false and not starts_with({trim('n1')}, '.') and not starts_with({trim('n1')}, '*'))"
    inner = f"({trim('line')} = '+' and line_no > 1 and line_no < total)"
    third = (
        "c3 as (select path, t, f, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as line_no, len(string_split(t, chr(10))) as total from p2b),"
        "x3 as (select *, coalesce(lag(line) over w, '') as prev, coalesce(lead(line) over w, '') as n1 from c3 window w as (partition by path order by line_no)),"
        f"y3 as (select path, any_value(t) as t0, any_value(f) as f0, count(*) filter ({inner} and not {good} and not {blank('prev')} and not {blank('n1')}) as n, "
        f"string_agg(case when not {inner} or {good} then line when not {blank('prev')} then '+' end, chr(10) order by line_no) as t1 from x3 group by path),"
        "p3 as (select path, case when n > 0 then t1 else t0 end as t, f0 + n as f from y3)"
    )
    return ", ".join(
        [
            first,
            step("p2a", "p1", r"([^\n])\n(\[(?:NOTE|TIP|WARNING|CAUTION|IMPORTANT)\])", f"{back}1\n\n{back}2"),
            step("p2b", "p2a", r"(====)\n([^\n])", f"{back}1\n\n{back}2"),
            third,
            step("p4a", "p3", r"([^\n])\n(image::)", f"{back}1\n\n{back}2"),
            step("p4b", "p4a", r"(image::[^\n]*\n)(\S)", f"{back}1\n{back}2"),
            step("p5", "p4b", r"(\w)(image:[^\[]*\[[^\]]*\])(\w)", f"{back}1 {back}2 {back}3"),
            step("p6", "p5", r"\n\s*\n\s*\n+", "\n\n"),
        ]
    )


@query("auto_fix", f"{CTX}, {_fix_sql()} select path, t as fixed, cast(f as integer) as fixes from p6")
def auto_fix(spark, d):
    return rules.auto_fix(view(spark, d, "drafts"))


@query(
    "rule_registered",
    ctes("drafts") + ", " + lines("drafts", "text") + " select path, cast(line_no as integer) as line, 'long-line' as rule_id, 'info' as severity from lines where length(line) > 300",
)
def rule_registered(spark, d):
    """A rule of the caller beside the built-in ones, chosen by id."""

    def long_lines(topics, text="text"):
        rows = line_rows(topics, text).filter(F.length("line") > 300)
        values = {"rule_id": "long-line", "severity": "info", "message": "Long line", "suggestion": "Break it"}
        shown = rows.select("path", F.col("line_no").cast("int").alias("line"), F.lit(1).alias("col"), F.lit(0).alias("check"))
        return shown.withColumns({k: F.lit(v) for k, v in values.items()}).select(*rules.COLUMNS)

    rules.register_rule("long-line", "info", long_lines)
    try:
        chosen = rules.select_rules(severities=("info",), enabled=["long-line"])
        return rules.validate(view(spark, d, "drafts"), chosen).select("path", "line", "rule_id", "severity")
    finally:
        del rules.RULES["long-line"], rules.RULE_SEVERITY["long-line"]


# --- line windows of blocks -------------------------------------------------
NUM = r"^(\d+)\.\s+."


@query(
    "numbered_runs",
    ctes("drafts") + ", " + lines("drafts", "text")
    + f""", rows as (select path, line_no - 1 as ord, try_cast({extract('t', r'^(\d+)\.')} as decimal(38,0)) as number, {extract('t', r'^\d+\.\s+(.+)\z')} as content
  from (select path, line_no, {trim('line')} as t from lines) where {rlike('t', NUM)}),
 o as (select *, case when coalesce(number <> 1 and number - 1 = lag(number) over w, false) then 0 else 1 end as opens from rows window w as (partition by path order by ord)),
 r as (select *, sum(opens) over (partition by path order by ord) as run from o),
 s as (select *, count(*) over (partition by path, run) as size, row_number() over (partition by path, run order by ord) as place from r)
 select path, cast(ord as integer) as ord, number, cast(run as bigint) as run, cast(place as integer) as place, content from s where size >= 2""",
)
def numbered_runs(spark, d):
    return blocks.numbered_runs(blocks.numbered_paragraphs(view(spark, d, "drafts")))


HEAD = r"^=+\s+\S"


@query(
    "collapsible_sections",
    ctes("drafts") + ", " + lines("drafts", "text")
    + f""", heads as (select path, line_no, {trim(sub('line', r'^=+[\s]+'))} as title from lines where {rlike('line', HEAD)}),
 nxt as (select h.path, h.line_no, title, l.line_no as ln, l.line, {rlike('l.line', r'^=+\s+')} and length({extract('l.line', '^=+', 0)}) <= length(title) as closes
  from heads h join lines l on l.path = h.path and l.line_no between h.line_no + 1 and h.line_no + 19),
 ends as (select path, line_no, min(ln) as stop from nxt where closes group by 1, 2),
 body as (select h.path, h.line_no, h.title, count(n.ln) filter (not {blank('n.line')} and n.ln < coalesce(e.stop, 1000000000)) as content_lines
  from heads h left join nxt n on n.path = h.path and n.line_no = h.line_no left join ends e on e.path = h.path and e.line_no = h.line_no group by 1, 2, 3)
 select path, cast(line_no as integer) as line_no, title, cast(content_lines as integer) as content_lines,
  {contains_any('lower(title)', blocks.COLLAPSIBLE_WORDS)} or content_lines between 3 and 9
   or not ({contains_any('lower(title)', blocks.PROCEDURE_WORDS)} or {rlike('title', '[0-9]')}) as collapsible from body""",
)
def collapsible_sections(spark, d):
    return blocks.collapsible_sections(view(spark, d, "drafts"))


@query(
    "lines_of_drafts",
    ctes("drafts") + ", " + lines("drafts", "text") + " select path, count(*) as n, cast(sum(length(line)) as bigint) as chars from lines group by path",
)
def lines_of_drafts(spark, d):
    return line_rows(view(spark, d, "drafts")).groupBy("path").agg(
        F.count("*").alias("n"), F.sum(F.length("line")).alias("chars")
    )


