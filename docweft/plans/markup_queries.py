"""Queries over conditions, variables, glossaries, lists, tables and citations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweft.functions import text as T
from docweft.operators import blocks, citations, conditions, glossary, variables
from docweft.plans.derived import view
from docweft.plans.sqltext import contains_any, ctes, extract, extract_all, inlist, lines, q, registry, rlike, sub, trim
from docweft.session import new_path
from docweft.sources import corpus

QUERIES, ORACLES, query = registry()


def attr(tag, name):
    return extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""")


# --- conditions -------------------------------------------------------------
CTAG = r"(?i)<[A-Za-z][^<>]*\s(?:madcap:conditions|data-mc-conditions)\s*=[^<>]*>"


def parse_sql(c):
    """List of tags of a condition string."""
    item = trim(sub(trim(sub(sub(trim("x"), r"""^["']|["']$"""), r"(?i)^General\.")), r"(?i)^Default\."))
    return f"list_filter(list_transform(string_split_regex({c}, '[,;]'), lambda x: {item}), lambda x: x <> '')"


BOTH = f"{attr('tag', 'madcap:conditions')} || ' ' || {attr('tag', 'data-mc-conditions')}"
CONDITIONS = (
    ctes("topics")
    + f""", tagged as (select path, unnest({extract_all('html', CTAG, 0)}) as tag from topics),
 conds as (select distinct path, condition from (select path, unnest({parse_sql(BOTH)}) as condition from tagged)),
 usage as (select condition, count(*) as usage from conds group by condition)"""
)


@query("conditions_extracted", CONDITIONS + " select path, condition from conds")
def conditions_extracted(spark, d):
    return conditions.extract_conditions(view(spark, d, "topics"))


CREGEX = r'(?i)(?:madcap:conditions|data-mc-conditions)="([^"]+)"'


@query(
    "conditions_by_pattern",
    ctes("topics")
    + f" select distinct path, condition from (select path, unnest({parse_sql('v')}) as condition from (select path, unnest({extract_all('html', CREGEX)}) as v from topics))",
)
def conditions_by_pattern(spark, d):
    return conditions.extract_conditions(view(spark, d, "topics"), mode="regex")


@query("condition_usage", CONDITIONS + " select condition, usage from usage")
def condition_usage(spark, d):
    return conditions.condition_usage(conditions_extracted(spark, d))


@query("condition_files", CONDITIONS + " select condition, path from conds")
def condition_files(spark, d):
    return conditions.condition_files(conditions_extracted(spark, d))


@query("analyzed_files", ctes("topics") + " select count(*) as file_count from topics where regexp_matches(lower(path), '[.](htm|html)$') or contains(html, '<html') or contains(html, '<body')")
def analyzed_files(spark, d):
    return conditions.analyzed_files(view(spark, d, "topics"))


CATEGORY = "case " + " ".join(
    f"when {rlike('condition', f'(?i){chr(92)}b(?:{words}){chr(92)}b')} then '{name}'" for name, words in conditions.CATEGORY_WORDS
) + " else 'custom' end"
DEPRECATED = "(" + " or ".join(rlike("condition", f"(?i){chr(92)}b(?:{w}){chr(92)}b") for w in conditions.DEPRECATED_WORDS) + ")"
DESCRIPTION = "case " + " ".join(
    f"when category = '{c}' and contains(lower(condition), '{w}') then {q(t)}" for c, w, t in conditions.DESCRIPTIONS
) + " else 'Custom condition: ' || condition end"
INFO = f", info as (select *, {DESCRIPTION} as description from (select condition, usage, {CATEGORY} as category, {DEPRECATED} as is_deprecated from usage))"


@query(
    "condition_report",
    CONDITIONS + INFO
    + f""" select condition, usage, category, is_deprecated, description,
 cast(list_position([{', '.join(q(c) for c in conditions.CATEGORY_ORDER)}], category) as integer) as category_rank,
 is_deprecated or (category = 'development' and contains(lower(condition), 'draft')) as recommended_exclusion from info""",
)
def condition_report(spark, d):
    return conditions.condition_report(condition_usage(spark, d))


PIECE = r"<[A-Za-z][^<>]*>[^<]*"
OPENING = extract("piece", r"^<[^<>]*>", 0)
ELEMENTS = (
    ctes("topics")
    + f""", pieces as (select path, unnest({extract_all('html', PIECE, 0)}) as piece, generate_subscripts({extract_all('html', PIECE, 0)}, 1) - 1 as element_no from topics),
 opened as (select path, element_no, piece, {OPENING} as tag, {rlike(OPENING, r'(?i)\s(madcap:conditions|data-mc-conditions)\s*=')} as conditioned from pieces),
 elements as (select path, element_no, lower({extract('piece', r'^<([A-Za-z][\w:.-]*)')}) as name, conditioned,
  case when conditioned then {parse_sql(BOTH)} else [] end as conds, {trim(extract('piece', r'^<[^<>]*>([^<]*)'))} as txt from opened)"""
)
KEPT = "select path, cast(element_no as integer) as element_no, name as tag, txt as text from elements where"


def _keep(include=(), exclude=()):
    parts = []
    if include:
        parts.append(f"list_has_any(conds, [{', '.join(q(c) for c in include)}])")
    if exclude:
        parts.append(f"not list_has_any(conds, [{', '.join(q(c) for c in exclude)}])")
    return f" not conditioned or ({' and '.join(parts)})"


@query("condition_filter", f"{ELEMENTS} {KEPT} {_keep(['Beta', 'Red', 'Draft'], ['Internal'])}")
def condition_filter(spark, d):
    elems = conditions.elements(view(spark, d, "topics"))
    kept = conditions.filter_elements(elems, include=["Beta", "Red", "Draft"], exclude=["Internal"])
    return kept.select("path", "element_no", "tag", "text")


PRODUCTION = next(p for p in conditions.PRESETS if p[0] == "production")


@query("condition_preset", f"{ELEMENTS} {KEPT} {_keep(PRODUCTION[3], PRODUCTION[2])}")
def condition_preset(spark, d):
    elems = conditions.elements(view(spark, d, "topics"))
    return conditions.apply_preset(elems, "production").select("path", "element_no", "tag", "text")


def _removed(tag):
    return q(conditions.REMOVED_MARK.split("{}")[0]) + f" || array_to_string({tag}, ', ') || " + q(conditions.REMOVED_MARK.split("{}")[1])


@query(
    "topics_filtered",
    ctes("topics")
    + f""", cut as (select path, html, {extract('html', '(?s)' + '<p' + chr(92) + 's[^<>]*conditions=[^<>]*>', 0)} as tag from topics),
 parsed as (select *, case when tag <> '' then {parse_sql(BOTH)} else [] end as conds from cut),
 spans as (select *, instr(html, tag) as a from parsed)
 select path, case when tag <> '' and list_has_any(conds, ['Deprecated', 'Internal', 'Beta']) then html[1:a - 1] || {_removed('conds')} || html[a + instr(html[a:], '</p>') + 3:] else html end as html from spans""",
)
def topics_filtered(spark, d):
    rows = view(spark, d, "topics").select("path", "html")
    return conditions.remove_conditioned(rows, exclude=["Deprecated", "Internal", "Beta"])


MAPPED = "list_filter(list_transform(conds, lambda c: case lower(c) " + " ".join(
    f"when {q(k)} then {q(v)}" for k, v in {**conditions.OUTPUT_FILTERS, "red": "review"}.items()
) + " end), lambda m: m is not null)"


@query(
    "condition_map",
    ELEMENTS
    + f""" select path, cast(element_no as integer) as element_no, array_to_string(conds, ',') as conditions,
 case when len(m) = 1 and contains(m[1], '=') then m[1] when len(m) > 1 then array_to_string(m, ',') end as filter,
 case when len(m) = 1 and not contains(m[1], '=') then m[1] end as instance
 from (select *, {MAPPED} as m from elements where conditioned and not list_has_any(list_transform(conds, lambda c: lower(c)), ['internal']))""",
)
def condition_map(spark, d):
    elems = conditions.elements(view(spark, d, "topics")).filter("conditioned")
    mapped = conditions.map_conditions(elems, {"red": "review"}, exclude=["internal"])
    return mapped.select("path", "element_no", F.array_join("conditions", ",").alias("conditions"), "filter", "instance")


@query(
    "condition_instances",
    CONDITIONS
    + f""" select lower(condition) as id, 'Guide - ' || condition as name, lower(condition) || '.tree' as tree_file from usage where lower(condition) in {inlist(conditions.MAJOR_INSTANCES)}
 union all select 'default', 'Guide Documentation', 'default.tree'""",
)
def condition_instances(spark, d):
    return conditions.detect_instances(condition_usage(spark, d), "Guide")


@query(
    "condition_sample",
    ctes("topics")
    + f""" select distinct {trim('c')} as condition from (select unnest(string_split(v, ',')) as c from (
 select unnest({extract_all('html', 'data-mc-conditions="([^"]+)"')}) as v from topics))""",
)
def condition_sample(spark, d):
    return conditions.sample_conditions(view(spark, d, "topics"))


@query(
    "unsafe_markup",
    ctes("topics")
    + f""", tg as (select path, unnest({extract_all('html', '<[A-Za-z][^<>]*>', 0)}) as t from topics),
 at as (select path, unnest(regexp_extract_all(t, {q(chr(92) + 's[A-Za-z_:][' + chr(92) + 'w:.-]*' + chr(92) + 's*=' + chr(92) + 's*(?:"[^"]*"|' + "'" + "[^']*')")}, 0)) as a from tg)
 select path, 'tag' as kind, n as name, count(*) as uses from (select path, lower({extract('t', r'^<([A-Za-z][\w:.-]*)')}) as n from tg) where n not in {inlist(citations.SAFE_TAGS)} group by path, n
 union all select path, 'attribute', lower({extract('a', r'([\w:.-]+)\s*=')}), count(*) from at where {contains_any('lower(a)', citations.UNSAFE_PARTS)} group by 1, 3""".replace(" at as (", " atr as (").replace("from at where", "from atr where"),
)
def unsafe_markup(spark, d):
    return citations.unsafe_markup(view(spark, d, "topics"))


# --- variables --------------------------------------------------------------
MERGED = ctes("variables") + ", merged as (select name, arg_max(coalesce(value, ''), ord) as value, arg_max(coalesce(set_name, ''), ord) as set_name, min(ord) as position, arg_max(coalesce(comment, ''), ord) as comment from variables group by name)"


def _merged(spark, d):
    return variables.merge_variables(view(spark, d, "variables"))


@query("variables_merged", MERGED + " select name, value, set_name, comment, position from merged")
def variables_merged(spark, d):
    return _merged(spark, d).withColumn("comment", F.coalesce("comment", F.lit("")))


EXTRACTED = MERGED + ", extracted as (select *, case when contains(name, '.') then split_part(name, '.', 1) end as namespace, case when contains(name, '.') then substr(name, instr(name, '.') + 1) else name end as key from merged where name <> '' and value <> '')"


@query("variables_extracted", EXTRACTED + " select name, value, namespace, key, 'madcap' as source from extracted")
def variables_extracted(spark, d):
    rows = variables.to_extracted(_merged(spark, d))
    return variables.variables_by_namespace(rows).select("name", "value", "namespace", "key", "source")


@query(
    "variables_filtered",
    MERGED + " select name from merged where not regexp_matches(name, '^Set1') and (regexp_matches(name, 'ring') or regexp_matches(name, '^.*bolt$')) "
    "and not (contains(lower(name), 'cold') or contains(lower(value), 'economy'))",
)
def variables_filtered(spark, d):
    rows = variables.filter_variables(_merged(spark, d), include=["ring", "*bolt"], exclude=["^Set1"])
    return variables.exclude_by_word(rows, ["Cold", "ECONOMY"]).select("name")


def _attribute_name(c):
    c = f"lower({sub(c, '([A-Z])', '-' + chr(92) + '1')})"
    return sub(sub(sub(sub(c, "[^a-z0-9-]", "-"), "--+", "-"), "^-"), "-$")


def _xml_name(c):
    return sub(sub(c, "[^a-zA-Z0-9._-]", "_"), "^[^a-zA-Z_]", "_")


WORDS = f"list_filter(string_split({sub(sub('name', '([A-Z])', ' ' + chr(92) + '1'), '[ _-]+', ' ')}, ' '), lambda w: w <> '')"
CAMEL = f"array_to_string(list_transform({WORDS}, lambda w: upper(w[1]) || w[2:]), '')"


@query(
    "variables_renamed",
    MERGED + f""" select name, lower({CAMEL}[1]) || {CAMEL}[2:] as camel, lower(array_to_string({WORDS}, '_')) as snake,
 'doc-' || lower(array_to_string({WORDS}, '-')) as kebab, {_attribute_name('name')} as attribute, {_xml_name('name')} as xml_name,
 lower({sub(sub('name', '[^a-zA-Z0-9_]', '_'), '^([0-9])', '_' + chr(92) + '1')}) as plain from merged""",
)
def variables_renamed(spark, d):
    rows, name = _merged(spark, d), F.col("name")
    rows = variables.rename_variables(rows, "kebab-case", "doc-")
    return rows.select(
        "name", T.rename(name, "camelCase").alias("camel"), T.rename(name, "snake_case").alias("snake"),
        F.col("new_name").alias("kebab"), T.var_name(name).alias("attribute"), T.var_name(name, "xml").alias("xml_name"),
        T.var_name(name, "snake").alias("plain"),
    )


# The derived topics write references in three known forms.
VAR = r"""(?i)<MadCap:variable\b[^<>]*/>|<span\b[^<>]*\sdata-mc-variable=[^<>]*>[^<]*</span>"""
VNAME = f"coalesce(nullif({extract('e', '(?i)^<[^<>]*' + chr(92) + 'sname=' + chr(34) + '([^' + chr(34) + ']*)' + chr(34))}, ''), {attr('e', 'data-mc-variable')})"
REFS = (
    ctes("topics", "variables").replace("with ", "with ", 1)
    + f""", merged as (select name, arg_max(coalesce(value, ''), ord) as value, min(ord) as position from variables group by name),
 els as (select path, unnest({extract_all('html', VAR, 0)}) as e, generate_subscripts({extract_all('html', VAR, 0)}, 1) - 1 as pos from topics),
 refs as (select path, pos, {VNAME} as ref, {trim(extract('e', '^<[^<>]*>([^<]*)'))} as inner_text, e from els),
 resolved as (select r.*, case when contains(r.ref, '.') then coalesce(nullif(a.value, ''), nullif(b.value, '')) end as value
  from refs r left join merged a on a.name = r.ref left join merged b on b.name = regexp_extract(r.ref, '[^.]*$'))"""
)


@query(
    "variable_references",
    REFS
    + f""" select path, cast(pos as integer) as pos, ref, inner_text, 'madcap' as form from refs
 union all select path, cast(pos as integer), ref, '{{' || ref || '}}', 'fallback' from (
  select path, unnest({extract_all('t', r'[{]([^}]+)[}]')}) as ref, generate_subscripts({extract_all('t', r'[{]([^}]+)[}]')}, 1) - 1 as pos
  from (select path, {sub('html', '<[^<>]*>', chr(1))} as t from topics)) where not contains(ref, ' ')""",
)
def variable_references(spark, d):
    return variables.variable_refs(view(spark, d, "topics"))


@query("variables_resolved", REFS + " select path, cast(pos as integer) as pos, ref, value from resolved")
def variables_resolved(spark, d):
    refs = variables.variable_refs(view(spark, d, "topics")).filter("form = 'madcap'")
    return variables.resolve_variables(refs, view(spark, d, "variables")).select("path", "pos", "ref", "value")


def _replaced(shown):
    """Topics with the n-th element replaced, put together again in order."""
    between = f"string_split_regex(html, {q(VAR)})"
    return f"""put as (select path, list(case {shown} end order by pos) as vals from resolved group by path),
 rebuilt as (select t.path, case when vals is null then html else array_to_string(list_transform(range(1, len({between}) + 1),
  lambda i: ({between})[i] || coalesce(vals[i], '')), '') end as html from topics t left join put using (path))"""


@query(
    "variables_flattened",
    REFS + ", " + _replaced("when inner_text <> '' and not contains(inner_text, '.') then inner_text when value is not null then value else '{' || ref || '}'")
    + " select path, html from rebuilt",
)
def variables_flattened(spark, d):
    return variables.flatten_variables(view(spark, d, "topics"), view(spark, d, "variables"))


@query(
    "variables_referenced",
    REFS + f""", suffixes as (select distinct ref, array_to_string(string_split(ref, '.')[i:], '.') as name from (
  select ref, unnest(range(1, len(string_split(ref, '.')) + 1)) as i from (select distinct ref from refs))),
 named as (select s.ref, arg_min(m.name, m.position) as name from suffixes s join merged m using (name) group by s.ref),
 named_refs as (select r.path, r.pos, coalesce(n.name, regexp_extract(r.ref, '[^.]*$')) as final from refs r left join named n using (ref))
 , resolved2 as (select path, pos, '{{' || {_attribute_name('final')} || '}}' as v from named_refs), """
    + _replaced("when true then v").replace("from resolved group", "from resolved2 group")
    + " select path, html from rebuilt",
)
def variables_referenced(spark, d):
    return variables.reference_variables(view(spark, d, "topics"), view(spark, d, "variables"))


MISSING = (
    ctes("drafts", "variables") + ", " + lines("drafts", "text")
    + ", found as (" + " union all ".join(
        f"select path, line_no, {i} as form, {trim('line')} as context, unnest({extract_all('line', p)}) as raw, generate_subscripts({extract_all('line', p)}, 1) - 1 as pos from lines"
        for i, p in enumerate(variables.MISSING_FORMS)
    )
    + f"), missing as (select path, line_no, form, pos, {trim('raw')} as name, context from found where {trim('raw')} not in (select name from variables))"
)


@query(
    "variables_missing",
    MISSING + " select path, cast(line_no as integer) as line_no, form, cast(pos as integer) as pos, name, context from missing",
)
def variables_missing(spark, d):
    return variables.missing_variables(view(spark, d, "drafts"), view(spark, d, "variables"))


@query(
    "variables_suggest",
    MISSING + """, known as (select name, min(ord) as ord from variables group by name),
 m as (select distinct name from missing),
 inside as (select m.name, k.name as known, k.ord from m, known k where contains(lower(m.name), lower(k.name)) or contains(lower(k.name), lower(m.name))),
 near as (select m.name, k.name as known, k.ord from m, known k where m.name not in (select name from inside) and levenshtein(lower(m.name), lower(k.name)) <= 2),
 top as (select *, row_number() over (partition by name order by ord) as r from (select * from inside union all select * from near))
 select m.name, coalesce(string_agg(known, ',' order by r), '') as suggestions from m left join top t on t.name = m.name and r <= 3 group by m.name""",
)
def variables_suggest(spark, d):
    defs = view(spark, d, "variables")
    missing = variables.missing_variables(view(spark, d, "drafts"), defs)
    return variables.suggest_variables(missing, defs).select("name", F.array_join("suggestions", ",").alias("suggestions"))


def _xml(c):
    for mark, text in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = f"replace({c}, {q(mark)}, {q(text)})"
    return c


@query(
    "variables_rendered",
    EXTRACTED + f""" select '    <var name="' || {_xml_name('name')} || '" value="' || {_xml('value')} || '"/>' as line from extracted
 union all select '    <!-- ' || namespace || ' Variables -->' from (select distinct namespace from extracted where namespace is not null)
 union all select '' from (select distinct namespace from extracted where namespace is not null)
 union all select unnest([{', '.join(q(x) for x in variables.XML_FILE_HEAD + ['</vars>'])}])""",
)
def variables_rendered(spark, d):
    rows = variables.to_extracted(_merged(spark, d))
    return variables.render_variables(rows, "writerside", grouped=True).orderBy("sort_key").select("line")


@query("variables_written", ORACLES["variables_rendered"])
def variables_written(spark, d):
    """The rendered file through the sink and back; the lines of all parts, in any order."""
    rows = variables.render_variables(variables.to_extracted(_merged(spark, d)), "writerside", grouped=True)
    root = new_path(spark, "outputs")
    corpus.write_outputs({"variables": rows}, root)
    return spark.read.text(f"{root}/variables").select(F.col("value").alias("line"))


@query(
    "variable_attributes",
    EXTRACTED + f""" select ':' || {_attribute_name('name')} || ': ' || value as line from extracted
 union all select unnest([{', '.join(q(x) for x in variables.ATTRIBUTE_FILE_HEAD)}])""",
)
def variable_attributes(spark, d):
    rows = variables.to_extracted(_merged(spark, d)).drop("comment")
    return variables.render_variables(rows, "asciidoc").orderBy("sort_key").select("line")


# --- glossary ---------------------------------------------------------------
def _glossary(spark, d):
    g = view(spark, d, "glossary")
    return g.withColumn("terms", F.array_compact(F.array("term1", "term2"))).drop("term1", "term2")


def _anchor(c):
    return f"'glossary-' || {sub(sub('lower(' + c + ')', '[^a-z0-9]+', '-'), '^-+|-+$')}"


LETTER = "case when regexp_matches(upper(term1[1]), '^[A-Z]') then upper(term1[1]) else '#' end"


@query(
    "glossary_groups",
    ctes("glossary") + f" select {LETTER} as letter, term1 as term, {_anchor('term1')} as anchor, definition from glossary where not contains(lower(coalesce(conditions, '')), 'internal')",
)
def glossary_groups(spark, d):
    kept = glossary.filter_glossary(_glossary(spark, d), ["internal"])
    return glossary.glossary_groups(kept).select("letter", "term", "anchor", "definition")


@query(
    "glossary_united",
    ctes("glossary") + " select part, id, ord from (select 'a' as part, * from glossary union all select 'b', * from glossary) where not contains(lower(coalesce(conditions, '')), 'internal')",
)
def glossary_united(spark, d):
    parts = [_glossary(spark, d).withColumn("part", F.lit(p)) for p in ("a", "b")]
    return glossary.filter_glossary(glossary.union_glossaries(parts), ["Internal"]).select("part", "id", "ord")


@query("glossary_letters", ctes("glossary") + f" select {LETTER} as letter, count(*) as entries from glossary group by 1")
def glossary_letters(spark, d):
    return glossary.letter_counts(_glossary(spark, d))


ENTRY_LINES = f"""list_concat(['[[' || {_anchor('term1')} || ']]', term1 || '::'], case when term2 is not null then ['_Also: ' || term2 || '_', '+'] else [] end,
   list_concat(['  ' || string_split(definition, chr(10))[1]], case when contains(definition, chr(10)) then ['  +', '  ' || string_split(definition, chr(10))[2]] else [] end), [''])"""
GLOSSARY_LINES = f"""g as (select *, {LETTER} as letter, lower(term1) as st from glossary),
 body as (select letter, st, ord, unnest({ENTRY_LINES}) as line from g)"""


@query(
    "glossary_rendered",
    ctes("glossary") + f""", {GLOSSARY_LINES} select line from body
 union all select unnest(['== ' || letter, '']) from (select distinct letter from g)
 union all select unnest(['= Glossary', ':toc:', ':icons: font', ''])""",
)
def glossary_rendered(spark, d):
    return glossary.render_glossary(_glossary(spark, d)).orderBy("sort_key").select("line")


@query(
    "glossary_index",
    ctes("glossary") + f""", g as (select *, {LETTER} as letter, lower(term1) as st from glossary),
 l as (select letter, st, ord, '<<' || {_anchor('term1')} || ',' || term1 || '>>' || case when lead(1) over (partition by letter order by st, ord) is null then '' else ' |' end as line from g),
 a as (select 1 as part, letter, 1 as block, st, ord, 0 as seq, line from l
  union all select 1, letter, 1, st, ord, 1, '' from l where not ends_with(line, ' |')
  union all select 1, letter, 0, '', null, 0, '*' || letter || ':*' from (select distinct letter from g)
  union all select 0, '', 0, '', null, i, ['.Glossary Index', '****'][i + 1] from (select unnest(range(2)) as i)
  union all select 2, '', 0, '', null, 0, '****')
 select cast(row_number() over (order by part, letter, block, st, ord nulls first, seq) as integer) as line_no, line from a""",
)
def glossary_index(spark, d):
    rows = glossary.render_glossary_index(_glossary(spark, d))
    # numbering is part of the check only: the sink sorts by range
    return rows.select(F.row_number().over(Window.orderBy("sort_key")).alias("line_no"), "line")


GTERM = r"(?i)<MadCap:glossaryTerm\b[^<>]*>([^<]*)</"


@query(
    "glossary_usage",
    ctes("topics", "glossary")
    + f""", marked as (select * from (select path, {trim('raw')} as term, pos from (select path, unnest({extract_all('html', GTERM)}) as raw, generate_subscripts({extract_all('html', GTERM)}, 1) - 1 as pos from topics)) where term <> ''),
 known as (select lower(t) as key, arg_min(id, ord) as id from (select id, ord, unnest([term1, term2]) as t from glossary) where t is not null group by 1)
 select path, cast(pos as integer) as pos, term, id, '#' || {_anchor('term')} as anchor from marked left join known on key = lower(term)""",
)
def glossary_usage(spark, d):
    return glossary.glossary_usage(view(spark, d, "topics"), _glossary(spark, d))


@query(
    "glossary_attached",
    ctes("drafts") + """ select path, case when contains(text, 'include::') and contains(text, 'glossary.adoc') then text
 else text || chr(10) || chr(10) || '// Include glossary' || chr(10) || 'include::' || case when regexp_matches(path, '^out/[^/]*$') then '' else '../' end || 'glossary.adoc[]' end as text from drafts""",
)
def glossary_attached(spark, d):
    drafts = view(spark, d, "drafts").select("path", "text")
    return glossary.attach_glossary(drafts, "include", glossary_path="out/glossary.adoc")


@query(
    "glossary_inlined",
    ctes("drafts", "glossary") + f""", g as (select *, {LETTER} as letter, lower(term1) as st from glossary),
 sections as (select letter, list_concat(['== ' || letter, ''], flatten(list({ENTRY_LINES} order by st, ord))) as l from g group by letter),
 whole as (select array_to_string(list_concat([':toc:', ':icons: font', ''], flatten(list(l order by letter))), chr(10)) as t from sections),
 added as (select path, case when contains(text, '== Glossary') or contains(text, '# Glossary') or not ends_with(path, '.adoc') then text
   else text || chr(10) || chr(10) || '== Glossary' || chr(10) || chr(10) || t end as text from drafts, whole)
 select path, length(text) as n_chars, md5(text) as text_md5 from added""",
)
def glossary_inlined(spark, d):
    drafts = view(spark, d, "drafts").select("path", "text")
    return glossary.inlined_digests(drafts, glossary.render_glossary(_glossary(spark, d)))


# --- lists, tables, blocks --------------------------------------------------
OL = r"(?is)<ol\b[^<>]*>.*?</ol>"


@query(
    "list_starts",
    ctes("topics")
    + f""", l as (select path, list_no, {attr(extract('raw', '^<[^<>]*>', 0), 'madcap:continue')} = 'true' as continues, len({extract_all('raw', '(?i)<li' + chr(92) + 'b', 0)}) as items
  from (select path, unnest({extract_all('html', OL, 0)}) as raw, generate_subscripts({extract_all('html', OL, 0)}, 1) - 1 as list_no from topics)),
 r as (select *, sum(case when continues then 0 else 1 end) over (partition by path order by list_no) as run from l)
 select path, cast(list_no as integer) as list_no, continues, cast(items as integer) as items,
  cast(case when continues then 1 + coalesce(sum(items) over (partition by path, run order by list_no rows between unbounded preceding and 1 preceding), 0) else 1 end as bigint) as start from r""",
)
def list_starts(spark, d):
    return blocks.list_starts(blocks.ordered_lists(view(spark, d, "topics")))


CELL_STEPS = [
    (r"(?is)<(?:strong|b)>(.*?)</(?:strong|b)>", r"*\1*"), (r"(?is)<(?:em|i)>(.*?)</(?:em|i)>", r"_\1_"),
    (r"(?is)<code>(.*?)</code>", r"`\1`"), (r"(?i)<br\s*/?>", " +\n"), (r"<[^>]*>", ""), (r"\s+", " "), (r"[|]", r"\\|"),
]


def _cell(c):
    for pattern, mark in CELL_STEPS:
        c = sub(c, pattern, mark)
    return trim(c)


CELLS = (
    ctes("topics")
    + f""", tb as (select path, unnest({extract_all('html', '(?is)<table' + chr(92) + 'b.*?</table>', 0)}) as t, generate_subscripts({extract_all('html', '(?is)<table' + chr(92) + 'b.*?</table>', 0)}, 1) - 1 as table_no from topics),
 tr as (select path, table_no, unnest({extract_all('t', '(?is)<tr' + chr(92) + 'b.*?</tr>', 0)}) as r, generate_subscripts({extract_all('t', '(?is)<tr' + chr(92) + 'b.*?</tr>', 0)}, 1) - 1 as row_no from tb),
 td as (select path, table_no, row_no, unnest({extract_all('r', '(?is)<t[dh]' + chr(92) + 'b.*?</t[dh]>', 0)}) as c, generate_subscripts({extract_all('r', '(?is)<t[dh]' + chr(92) + 'b.*?</t[dh]>', 0)}, 1) - 1 as col_no from tr),
 cells as (select path, table_no, row_no, col_no, starts_with(c, '<th') as is_header, try_cast(nullif({attr('c', 'colspan')}, '') as integer) as colspan,
  case when try_cast(nullif({attr('c', 'rowspan')}, '') as integer) > 1 then try_cast({attr('c', 'rowspan')} as integer) end as rowspan,
  case when len(regexp_extract_all({extract('c', '(?s)^<[^<>]*>(.*)</t[dh]>$')}, '<[A-Za-z]')) = 1 then
   case lower(regexp_extract({extract('c', '(?s)^<[^<>]*>(.*)</t[dh]>$')}, '<([A-Za-z]+)', 1)) when 'strong' then 'strong' when 'b' then 'strong' when 'em' then 'emphasis'
    when 'i' then 'emphasis' when 'code' then 'monospace' end end as format,
  case when {attr('c', 'align')} in ('center', 'right') then {attr('c', 'align')} end as alignment,
  {_cell(extract('c', '(?s)^<[^<>]*>(.*)</t[dh]>$'))} as content from td)"""
)


@query(
    "table_cells",
    CELLS + " select path, cast(table_no as integer) as table_no, cast(row_no as integer) as row_no, cast(col_no as integer) as col_no, is_header, colspan, rowspan, format, alignment, content from cells",
)
def table_cells(spark, d):
    return blocks.table_cells(view(spark, d, "topics"))


@query(
    "column_specs",
    CELLS + """, w as (select path, table_no, col_no, max(length(content)) as width from cells group by all)
 select path, cast(table_no as integer) as table_no, cast(col_no as integer) as col_no, cast(width as integer) as width,
  cast(greatest(1, floor(cast(width as double) / sum(width) over (partition by path, table_no) * 10 + 0.5)) as bigint) as weight from w""",
)
def column_specs(spark, d):
    return blocks.column_specs(blocks.table_cells(view(spark, d, "topics")))


BLOCK = f"(?i)<(?:{blocks.BLOCK_TAGS})" + chr(92) + "b"
STRIPPED = "html"
for _p in [r"(?is)<head.*?</head>", r"(?i)<link[^>]*>", r"(?i)<meta[^>]*>", r"(?is)<style.*?</style>", r"(?is)<script.*?</script>"]:
    STRIPPED = sub(STRIPPED, _p)
CALLOUT = "case when not " + contains_any("css", blocks.CALLOUTS) + " then null " + " ".join(
    f"when {contains_any('css', words)} then '{label}'" for words, label in blocks.CALLOUT_LABELS
) + " else 'NOTE' end"
BLOCKS = (
    ctes("topics")
    + f""", marked as (select path, {sub(STRIPPED, '(?i)<((?:' + blocks.BLOCK_TAGS + ')' + chr(92) + 'b)', chr(1) + '<' + chr(92) + '1')} as m from topics),
 pieces as (select path, unnest(string_split(m, chr(1))[2:]) as raw, generate_subscripts(string_split(m, chr(1))[2:], 1) - 1 as block_no from marked),
 shaped as (select *, lower({extract('raw', r'^<(\w+)')}) as tag, {attr(extract('raw', '^<[^<>]*>', 0), 'class')} as css,
  {trim(sub(sub('raw', '<[^>]*>', ' '), r'\s+', ' '))} as txt from pieces),
 blocks as (select path, block_no, raw, txt, {CALLOUT} as label, tag from shaped where txt <> ''),
 kinds as (select *, case when regexp_matches(tag, '^h[1-6]') then 'heading' when label is not null then 'admonition' when tag = 'li' then 'item'
  when tag = 'tr' then 'row' when tag = 'pre' then 'code' else 'paragraph' end as kind,
  case when regexp_matches(tag, '^h[1-6]') then cast(tag[2] as integer) else 0 end as level from blocks)"""
)


@query("blocks", BLOCKS + " select path, cast(block_no as integer) as block_no, kind, level, label, txt as text from kinds")
def block_rows(spark, d):
    return blocks.blocks(view(spark, d, "topics")).drop("raw")


@query(
    "blocks_rendered",
    BLOCKS + """ select path, cast(block_no as integer) as block_no, case kind when 'heading' then repeat('=', level) || ' ' || txt when 'item' then '* ' || txt
  when 'row' then '|' || txt when 'code' then '----' || chr(10) || txt || chr(10) || '----'
  when 'admonition' then case label when 'DANGER' then 'CAUTION' when 'INFO' then 'NOTE' when 'EXAMPLE' then 'NOTE' when 'CODE' then 'NOTE' else label end || ': ' || txt
  else txt end as line from kinds""",
)
def blocks_rendered(spark, d):
    return blocks.render_blocks(blocks.blocks(view(spark, d, "topics")))


@query(
    "topics_assembled",
    BLOCKS + """ select path, string_agg(case kind when 'heading' then repeat('#', level) || ' ' || txt when 'item' then '- ' || txt when 'row' then '| ' || txt || ' |'
  when 'code' then '```' || chr(10) || txt || chr(10) || '```' when 'admonition' then '> **' || label || '** ' || txt else txt end, chr(10) || chr(10) order by block_no) as text
 from kinds group by path""",
)
def topics_assembled(spark, d):
    return blocks.assemble_topics(blocks.render_blocks(blocks.blocks(view(spark, d, "topics")), "markdown"))


@query(
    "chunks_of_blocks",
    BLOCKS.replace("with topics", "with recursive topics", 1)
    + """, numbered as (select path, raw, length(raw) as size, row_number() over (partition by path order by block_no) as n from kinds),
 packed as (select path, n, raw, size, 0 as chunk, size as used from numbered where n = 1
  union all select b.path, b.n, b.raw, b.size, case when p.used > 0 and p.used + b.size > 500 then p.chunk + 1 else p.chunk end,
   case when p.used > 0 and p.used + b.size > 500 then b.size else p.used + b.size end from packed p join numbered b on b.path = p.path and b.n = p.n + 1)
 select path, cast(chunk as integer) as chunk_no, cast(count(*) as integer) as blocks, string_agg(raw, '' order by n) as chunk from packed group by path, chunk""",
)
def chunks_of_blocks(spark, d):
    return blocks.chunk_blocks(view(spark, d, "topics"), 500)


DROP = r"(?is)<MadCap:dropDown>.*?</MadCap:dropDown>"


@query(
    "dropdowns",
    ctes("topics")
    + f""" select path, cast(pos as integer) as pos, {trim(sub(extract('dd', '(?is)<MadCap:dropDownHotspot[^<>]*>(.*?)</MadCap:dropDownHotspot>'), '<[^>]*>'))} as title
 from (select path, unnest({extract_all('html', DROP, 0)}) as dd, generate_subscripts({extract_all('html', DROP, 0)}, 1) - 1 as pos from topics)""",
)
def dropdowns(spark, d):
    return blocks.dropdowns(view(spark, d, "topics"))


# --- citations --------------------------------------------------------------
AY = citations.AUTHOR_YEAR
FOOTNOTES = f"""r as (select path, unnest({extract_all('html', citations.FOOTNOTE_REF)}) as id, generate_subscripts({extract_all('html', citations.FOOTNOTE_REF)}, 1) - 1 as pos from topics),
 b as (select path, id, arg_max(body, n) as body from (select path, unnest({extract_all('html', citations.FOOTNOTE_BODY)}) as id, unnest({extract_all('html', citations.FOOTNOTE_BODY, 2)}) as body,
  generate_subscripts({extract_all('html', citations.FOOTNOTE_BODY)}, 1) as n from topics) group by path, id)
 select path, cast(pos as integer) as pos, id, nullif({trim(sub(sub('body', '(?i)<(?:em|i)' + chr(92) + 'b[^>]*>(.*?)</(?:em|i)>', '*' + chr(92) + '1*'), '<[^>]+>'))}, '') as content,
  case when body is null then 'Footnote reference ' || id || ' found but content missing' end as warning from r left join b using (path, id)"""
CITATIONS = f""" select path, 'inline' as type, cast(pos as integer) as pos, null as ref, a || ', ' || y as content, a as authors, y as year, null as title, null as journal, null as url, null as doi
  from (select path, unnest({extract_all('html', AY)}) as a, unnest({extract_all('html', AY, 2)}) as y, generate_subscripts({extract_all('html', AY)}, 1) - 1 as pos from topics)
 union all select path, 'reference', cast(pos as integer), 'ref_' || n, '[' || n || ']', null, null, null, null, null, null
  from (select path, unnest({extract_all('html', citations.NUMBERED_REF)}) as n, generate_subscripts({extract_all('html', citations.NUMBERED_REF)}, 1) - 1 as pos from topics)
 union all select path, 'bibliography', cast(pos as integer), null, c, array_to_string(string_split(nullif({extract('c', citations.AUTHORS)}, ''), ' and '), ';'),
   nullif({extract('c', citations.JOURNAL, 6)}, ''), nullif({extract('c', citations.JOURNAL, 1)}, ''), nullif({extract('c', citations.JOURNAL, 2)}, ''), nullif({extract('c', citations.URL)}, ''), nullif({extract('c', citations.DOI)}, '')
  from (select path, {trim(sub(sub('raw', '<[^>]+>'), r'\s+', ' '))} as c, pos from (select path, unnest({extract_all('html', citations.BIBLIOGRAPHY_ENTRY)}) as raw, generate_subscripts({extract_all('html', citations.BIBLIOGRAPHY_ENTRY)}, 1) - 1 as pos from topics))"""


@query(
    "footnotes",
    ctes("topics") + ", " + FOOTNOTES,
)
def footnotes(spark, d):
    return citations.link_footnotes(view(spark, d, "topics"))


@query(
    "citations",
    ctes("topics") + CITATIONS,
)
def citation_rows(spark, d):
    rows = citations.citations(view(spark, d, "topics"))
    return rows.select("path", "type", "pos", "ref", "content", F.array_join("authors", ";").alias("authors"), "year", "title", "journal", "url", "doi")


NOTES = FOOTNOTES.replace(" select path, cast(pos", ", notes as (select path, cast(pos", 1) + ")"
REFERENCES = (
    ctes("topics") + ", " + NOTES + ", cites as (" + CITATIONS + """), listed as (
  select path, 0 as grp, pos, content, cast(null as varchar) as authors, cast(null as varchar) as year, cast(null as varchar) as url, cast(null as varchar) as doi from notes where content is not null
  union all select path, case type when 'inline' then 1 else 2 end, pos, content, authors, year, url, doi from cites where type <> 'reference'),
 numbered as (select *, row_number() over (partition by path order by grp, pos) as n from listed)
 select path, cast(n as integer) as ord, unnest(case when grp = 0 then ['[^cite_' || n || ']: ' || content, ''] else ['<a id="cite_' || n || '"></a>',
   case when authors is not null and year is not null then '**' || replace(authors, ';', ', ') || '** (' || year || '). ' else '' end || content || coalesce(' DOI: ' || doi, '')
   || coalesce(' Available at: [' || url || '](' || url || ')', ''), ''] end) as line from numbered
 union all select path, 0, unnest(['## References', '']) from (select distinct path from listed)"""
)


@query("reference_section", REFERENCES)
def reference_section(spark, d):
    return citations.reference_section(view(spark, d, "topics"), "markdown").drop("seq")


SHORTCUTS = " union all ".join(
    f"select path, '{form}' as form, cast(pos as integer) as pos, keys from (select path, unnest({extract_all('t', p, 0)}) as keys, generate_subscripts({extract_all('t', p, 0)}, 1) - 1 as pos from plain)"
    for p, form in citations.SHORTCUT_FORMS
)


@query(
    "shortcuts",
    ctes("topics") + f", plain as (select path, {sub(sub('html', '(?is)<(?:kbd|code|pre)' + chr(92) + 'b[^>]*>.*?</(?:kbd|code|pre)>', ' '), '<[^>]*>', chr(1))} as t from topics) {SHORTCUTS}",
)
def shortcuts(spark, d):
    return citations.shortcuts(view(spark, d, "topics"))
