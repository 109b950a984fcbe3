"""Queries over links, images, titles and output names."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.functions import paths as P
from docweft.functions import text as T
from docweft.operators import images, links, snippets
from docweft.plans.derived import view
from docweft.plans.sqltext import (
    registry,
    basename,
    contains_any,
    ctes,
    dirname,
    extname,
    extract,
    extract_all,
    inlist,
    lines,
    normalize,
    q,
    relative,
    rlike,
    stem,
    sub,
    trim,
)
from docweft.session import cut

QUERIES, ORACLES, query = registry()


# --- shared SQL -------------------------------------------------------------
A_TAG, IMG_TAG = links.LINK_FORMS["help-center"][0][0], links.LINK_FORMS["help-center"][1][0]
LINK_CTES = (
    ctes("topics", "files")
    + ",\n"
    + lines("topics", "html")
    + f""",
links as (
 select path, line_no, 0 as form, pos - 1 as pos, url, txt from (
  select path, line_no, unnest({extract_all('line', A_TAG, 1)}) as url, unnest({extract_all('line', A_TAG, 2)}) as txt,
   generate_subscripts({extract_all('line', A_TAG, 1)}, 1) as pos from lines)
 union all
 select path, line_no, 1, pos - 1, url, case when txt is null or txt = '' then 'image' else txt end from (
  select path, line_no, unnest({extract_all('line', IMG_TAG, 1)}) as url, unnest({extract_all('line', IMG_TAG, 2)}) as txt,
   generate_subscripts({extract_all('line', IMG_TAG, 1)}, 1) as pos from lines)),
typed as (
 select *, {extract('u', '^([^#]*)')} as written,
  case when starts_with(u, '#') then 'anchor'
   when {rlike('u', '^(http://|https://|ftp://|mailto:)')} then 'external'
   when lower({extname(extract('u', '^([^#]*)'))}) in {inlist(P.IMAGE_EXTENSIONS)} then 'image'
   when lower({extname(extract('u', '^([^#]*)'))}) in {inlist(P.DOCUMENT_EXTENSIONS + [''])} then 'internal'
   else 'unknown' end as link_type
 from (select *, {trim('url')} as u from links)),
targets as (
 select distinct target, {extname('target')} as ext from (
  select {normalize("(" + dirname('path') + ") || '/' || written")} as target from typed
  where link_type in ('internal', 'image') and written <> '')),
cand as (
 select target, unnest([target, case when ext in ('.htm', '.html', '.md', '.adoc') then target[1:len(target) - len(ext)] || '.html' end,
   target || '.md', target || '.adoc', target || '.html',
   regexp_replace(target, '[.]html?$', '.html'), regexp_replace(target, '[.]htm?$', '.html')]) as c,
  unnest(range(7)) as k from targets),
found as (select target, arg_min(c, k) as resolved from cand join (select distinct path from files) f on f.path = c group by target),
results as (
 select t.path, line_no, form, pos, url, link_type, resolved,
  case link_type when 'anchor' then true
   when 'external' then case when {rlike('u', '^(?i)(https?|ftp)://')} then {rlike('u', '^(?i)(https?|ftp)://[^ /?#<>]+')} else {rlike('u', '^[A-Za-z][A-Za-z0-9+.-]*:')} end
   when 'unknown' then false else resolved is not null end as is_valid
 from typed t left join found f
  on f.target = {normalize("(" + dirname('t.path') + ") || '/' || written")} and link_type in ('internal', 'image') and written <> '')
"""
)


def _validated(spark, d):
    topics, files = view(spark, d, "topics"), view(spark, d, "files")
    # links are a small table next to the texts: cut them out once, not once per use
    return links.validate_links(cut(links.extract_links(topics, "help-center")), files, "help-center")


def _group_counts():
    parts = []
    for kind, name in (("internal", "internal"), ("external", "external"), ("image", "images"), ("anchor", "anchors")):
        test = "link_type in ('internal', 'unknown')" if kind == "internal" else f"link_type = '{kind}'"
        parts.append(f"count(*) filter (is_valid and {test}) as {name}_valid")
        parts.append(f"count(*) filter (not is_valid and {test}) as {name}_broken")
    return ", ".join(parts)


@query(
    "link_report",
    LINK_CTES
    + f"""select count(*) as total_links, count(*) filter (is_valid) as valid_links,
 count(*) filter (not is_valid) as broken_links,
 count(*) filter (not is_valid and link_type = 'external') as warnings, {_group_counts()} from results""",
)
def link_report(spark, d):
    return links.link_report(_validated(spark, d))


@query("link_types", LINK_CTES + "select link_type, is_valid, count(*) as links from results group by all")
def link_types(spark, d):
    return _validated(spark, d).groupBy("link_type", "is_valid").agg(F.count("*").alias("links"))


@query(
    "links_extracted", LINK_CTES + "select path, cast(line_no as integer) as line_no, cast(form as integer) as form, "
    "cast(pos as integer) as pos, url, txt as text from links",
)
def links_extracted(spark, d):
    return links.extract_links(view(spark, d, "topics"), "help-center")


def _text_links(patterns):
    """Links of draft lines: (pattern, url group, text group or fixed text)."""
    parts = []
    for form, (pattern, url, text, fixed) in enumerate(patterns):
        shown = f"unnest({extract_all('line', pattern, text)})" if text else q(fixed)
        parts.append(
            f"select path, line_no, {form} as form, unnest({extract_all('line', pattern, url)}) as url, {shown} as text from lines"
        )
    return " union all ".join(parts)


@query(
    "links_in_drafts",
    ctes("drafts") + ", " + lines("drafts", "text")
    + f" select path, cast(line_no as integer) as line_no, form, url, coalesce(text, '') as text from ({_text_links(links.LINK_FORMS['asciidoc'])})",
)
def links_in_drafts(spark, d):
    rows = links.extract_links(view(spark, d, "drafts"), "asciidoc", "text")
    return rows.select("path", "line_no", "form", "url", F.coalesce("text", F.lit("")).alias("text"))


@query(
    "links_resolved",
    LINK_CTES + "select path, cast(line_no as integer) as line_no, cast(form as integer) as form, cast(pos as integer) as pos, "
    "url, link_type, resolved, is_valid from results",
)
def links_resolved(spark, d):
    return _validated(spark, d).select("path", "line_no", "form", "pos", "url", "link_type", "resolved", "is_valid")


@query(
    "broken_targets",
    LINK_CTES + "select target from targets where target not in (select target from found)",
)
def broken_targets(spark, d):
    topics, files = view(spark, d, "topics"), view(spark, d, "files")
    return links.broken_targets(links.extract_links(topics, "help-center"), files, "help-center")


@query(
    "broken_links_top20",
    LINK_CTES + "select path, cast(line_no as integer) as line_no, url from results where not is_valid "
    "order by path, line_no, form, pos limit 20",
)
def broken_links_top20(spark, d):
    return links.top_broken(_validated(spark, d), 20).select("path", "line_no", "url")


@query(
    "broken_links_rest",
    LINK_CTES + "select count(*) as broken, greatest(count(*) - 20, 0) as rest from results where not is_valid",
)
def broken_links_rest(spark, d):
    return links.broken_rest(_validated(spark, d), 20)


# --- pages ------------------------------------------------------------------
TITLE_PATTERNS = [
    r"(?i)<h1[^>]*>([^<]+)</h1>", r"(?i)<title[^>]*>([^<]+)</title>", r'(?i)data-mc-heading-level="1"[^>]*>([^<]+)<',
]


def title_sql(html):
    return "coalesce(" + ", ".join(f"nullif({trim(extract(html, p))}, '')" for p in TITLE_PATTERNS) + ")"


@query("page_titles", f"select page_id, {title_sql('html')} as title from pages")
def page_titles(spark, d):
    return view(spark, d, "pages").select("page_id", T.topic_title(F.col("html")).alias("title"))


def visible_sql(html):
    return sub(sub(html, "<[^>]*>"), "&[^;]+;", " ")


BOILERPLATE = [
    r"(?is)<head.*?</head>", r"(?i)<link[^>]*>", r"(?i)<meta[^>]*>", r"(?is)<style.*?</style>", r"(?is)<script.*?</script>",
]


def stripped_sql(html):
    for pattern in BOILERPLATE:
        html = sub(html, pattern)
    return html


@query(
    "page_word_count",
    f"""select page_id, cast(len(list_filter(string_split_regex({visible_sql(stripped_sql('html'))}, {q(T.SPACE + '+')}), lambda w: w <> '')) as bigint) as words,
 cast(len({extract_all('html', '<[^>]+>', 0)}) as bigint) as elements,
 length({stripped_sql('html')}) as kept_chars from pages""",
)
def page_word_count(spark, d):
    html = F.col("html")
    stripped = T.strip_boilerplate(html)
    return view(spark, d, "pages").select(
        "page_id", T.word_count(stripped).alias("words"), T.element_count(html).alias("elements"),
        F.length(stripped).cast("bigint").alias("kept_chars"),
    )


@query(
    "draft_titles",
    ctes("drafts")
    + f""" select path, coalesce(nullif({extract('text', '(?m)^= ([^' + chr(92) + 'n' + chr(92) + 'r]+)$')}, ''),
 nullif({extract('text', '(?m)^# ([^' + chr(92) + 'n' + chr(92) + 'r]+)$')}, ''), 'Untitled Document') as title,
 cast(len(list_filter(string_split_regex({sub('text', r'[=#+*_`\[\]()-]', ' ')}, {q(T.SPACE + '+')}), lambda w: w <> '')) as bigint) as words
 from drafts""",
)
def draft_titles(spark, d):
    c = F.col("text")
    return view(spark, d, "drafts").select(
        "path", T.markup_title(c).alias("title"), T.word_count(c, "markup").alias("words")
    )


TAG_SQL = ", ".join(
    [f"case when {contains_any('v', words)} then {q(tag)} end" for words, tag in T.TAG_WORDS]
    + ["case when contains(lower(title), 'faq') then 'faq' end", "case when contains(v, 'example') then 'examples' end"]
)


@query(
    "tags",
    f"""select page_id, array_to_string(list_filter([{TAG_SQL}], lambda t: t is not null)[1:5], ',') as tags
 from (select page_id, title, lower({visible_sql("concat_ws(' ', html, title)")}) as v from (
  select page_id, html, coalesce({title_sql('html')}, '') as title from pages))""",
)
def tags(spark, d):
    title = F.coalesce(T.topic_title(F.col("html")), F.lit(""))
    return view(spark, d, "pages").select(
        "page_id", F.array_join(T.suggest_tags(F.col("html"), title), ",").alias("tags")
    )


@query(
    "review_warnings",
    ctes("topics")
    + f""" select path, {contains_any('html', T.AUTHORING_MARKS)} as marked,
 array_to_string(list_filter([
  case when contains(html, 'data-mc-conditions') then {q(T.REVIEW_CONDITIONS)} end,
  case when {contains_any('html', ['data-mc-snippet', 'MadCap:snippetBlock'])} then {q(T.REVIEW_SNIPPETS)} end,
  case when {contains_any('html', ['mc-variable', 'MadCap:variable'])} then {q(T.REVIEW_VARIABLES)} end,
  case when contains(html, 'MadCap:dropDown') then {q(T.REVIEW_DROPDOWNS)} end], lambda w: w is not null), '|') as warnings
 from topics""",
)
def review_warnings(spark, d):
    html = F.col("html")
    return view(spark, d, "topics").select(
        "path", T.has_authoring_markup(html).alias("marked"), F.array_join(T.review_warnings(html), "|").alias("warnings")
    )


# --- output names -----------------------------------------------------------
def slug_sql(c):
    c = sub(f"lower({c})", r"[^\w\s-]")
    c = sub(sub(c, r"\s+", "-"), "_+", "-")
    return sub(sub(c, '-+', '-'), '^-+|-+$')


PLAN_SQL = f"""plan as (select path, {normalize("(" + dirname('path') + ") || '/' || coalesce(nullif(" + slug_sql(title_sql('html')) + ", ''), " + stem('path') + ") || '.adoc'")} as out_path from topics)"""


@query("output_paths", ctes("topics") + f", {PLAN_SQL} select path, out_path from plan")
def output_paths(spark, d):
    return links.plan_output_paths(view(spark, d, "topics"), "asciidoc", rename=True)


@query(
    "rename_collisions",
    ctes("topics") + f", {PLAN_SQL} select out_path, count(*) as topics, min(path) as first_path from plan group by out_path having count(*) > 1",
)
def rename_collisions(spark, d):
    return links.output_collisions(output_paths(spark, d))


# --- rewriting --------------------------------------------------------------
REWRITE = f"""{LINK_CTES}, {PLAN_SQL},
rename_map as (select path as old_path, out_path as new_path, path as ord from plan),
firsts as (select {basename(sub('old_path', '(?i)[.](html?|adoc|md)$'))} as st, arg_min(new_path, ord) as new_path from rename_map group by 1),
keyed as (select l.path, line_no, form, pos, url, p.out_path,
  case when not starts_with(url, 'http') and not starts_with(url, 'mailto:') and not starts_with(url, '#') then
   nullif({basename(sub(sub(sub(sub(extract('url', '^([^#]*)'), '^([.][.]/)+'), '^[.]/'), '^user/'), '(?i)[.](html?|adoc|md)$'))}, '') end as st
 from links l join plan p on p.path = l.path)
select path, cast(line_no as integer) as line_no, cast(form as integer) as form, cast(pos as integer) as pos, url,
 case when new_path is null then url else {relative('out_path', 'new_path')} ||
  case when {extract('url', '^[^#]*#([^#]*)')} <> '' then '#' || {extract('url', '^[^#]*#([^#]*)')} else '' end end as new_url
from keyed left join firsts using (st)"""


@query("link_rewrite", REWRITE)
def link_rewrite(spark, d):
    topics = view(spark, d, "topics")
    plan = cut(links.plan_output_paths(topics, "asciidoc", rename=True))
    found = links.extract_links(topics, "help-center").join(plan, "path")
    mapping = plan.select(F.col("path").alias("old_path"), F.col("out_path").alias("new_path"), F.col("path").alias("ord"))
    return links.rewrite_links(found, mapping).select("path", "line_no", "form", "pos", "url", "new_url")


# --- similar paths ----------------------------------------------------------
def _written(spark, d):
    """Distinct written link paths, and the map from topic paths to outputs."""
    topics = view(spark, d, "topics")
    found = links.extract_links(topics, "help-center").select(P.url_path(F.col("url")).alias("link"))
    keep = ~P.skip_rewrite(F.col("link")) & (F.col("link") != "") & ~F.col("link").startswith("data:")
    path = F.col("path")
    out = F.concat(P.dirname(path), F.lit("/"), P.stem(path), F.lit(".adoc"))
    kind = F.col("doc_id") % 3
    mapped = (
        F.when(kind == 0, F.concat(F.lit("dooc-"), F.col("doc_id").cast("string"), F.lit(".htm")))
        .when(kind == 1, F.concat(P.stem(path), F.lit(".html")))
        .otherwise(F.concat(P.stem(path), F.lit(".adoc")))
    )
    mapping = topics.select(mapped.alias("mapped"), path.alias("old_path"), out.alias("value"), path.alias("ord"))
    return found.filter(keep).distinct(), mapping


WRITTEN = f"""{LINK_CTES},
written as (select distinct link from (select {extract('url', '^([^#]*)')} as link from links)
 where not starts_with(link, 'http') and not starts_with(link, 'mailto:') and link <> '' and not starts_with(link, 'data:')),
mapping as (select ({dirname('path')}) || '/' || {stem('path')} || '.adoc' as value, path as old_path, path as ord,
 case doc_id % 3 when 0 then 'dooc-' || doc_id || '.htm' when 1 then {stem('path')} || '.html' else {stem('path')} || '.adoc' end as mapped from topics)"""


@query(
    "fuzzy_paths",
    WRITTEN
    + f""", keyed as (select link, {sub('lower(link)', '[^a-z0-9]')} as a from written),
 keyed_map as (select value, ord, {sub('lower(mapped)', '[^a-z0-9]')} as b from mapping),
 firsts as (select b, min(ord) as ord, arg_min(value, ord) as value from keyed_map group by b),
 scored as (select a, value, ord, case when a = b then 1.0 when contains(a, b) or contains(b, a) then 0.8
  else cast(greatest(length(a), length(b)) - levenshtein(a, b) as double) / greatest(length(a), length(b)) end as score
  from (select distinct a from keyed), firsts),
 best as (select a, value, score from scored where score > 0.5 qualify row_number() over (partition by a order by score desc, ord) = 1)
 select link, value, cast(round(score, 6) as double) as score from keyed join best using (a)""",
)
def fuzzy_paths(spark, d):
    found, mapping = _written(spark, d)
    return links.fuzzy_paths(found, mapping).withColumn("score", F.round("score", 6))


@query(
    "contained_paths",
    WRITTEN
    + f""", lf as (select link, unnest([link, {sub('link', '(?i)[.]adoc$')}, {sub('link', '(?i)[.]adoc$', '.htm')}, {stem('link')}]) as a from written),
 rf as (select value, ord, unnest([old_path, {sub('old_path', '(?i)[.]htm$', '.adoc')}, {stem('old_path')} || '.adoc', {stem('old_path')}]) as b from mapping)
 select link, arg_min(value, ord) as value from (select distinct * from lf), (select distinct * from rf)
 where a <> '' and b <> '' and (contains(a, b) or contains(b, a)) group by link""",
)
def contained_paths(spark, d):
    found, mapping = _written(spark, d)
    return links.match_contains(found, mapping)


# --- images -----------------------------------------------------------------
IMG_SRC = r"""(?i)<img\s+[^>]*src=["']([^"']+)["'][^>]*>"""
IMAGE_REFS = f"""refs as (select * from (select path, unnest({extract_all('html', IMG_SRC)}) as src,
 generate_subscripts({extract_all('html', IMG_SRC)}, 1) - 1 as pos from topics) where not starts_with(src, 'data:'))"""


def _image_places():
    clean = sub("src", r"^\.\./")
    name = basename("src")
    first = f"case when contains({clean}, 'Images/') then regexp_replace({clean}, 'Images/', '') else {clean} end"
    places = [
        clean, f"'Resources/' || {clean}", f"'Resources/' || {first}", f"dir || '/' || src",
        f"'Images/' || {name}", f"'Resources/Images/' || {name}", sub(clean, "^Images/", "Resources/Images/"),
    ]
    return "[" + ", ".join(normalize(p) for p in places) + "]"


@query(
    "image_resolution",
    ctes("topics", "files")
    + f""", {IMAGE_REFS},
 keys as (select distinct {dirname('path')} as dir, src from refs),
 cand as (select dir, src, unnest({_image_places()}) as c, unnest(range(7)) as k from keys),
 hit as (select dir, src, arg_min(c, k) as found from cand join (select distinct path from files) f on f.path = c group by dir, src),
 byname as (select {basename('path')} as name, min(path) as found from files where lower({extname('path')}) in {inlist(P.IMAGE_EXTENSIONS)} group by 1)
 select path, cast(pos as integer) as pos, r.src, coalesce(h.found, b.found) as found from refs r
 left join hit h on h.dir = {dirname('r.path')} and h.src = r.src left join byname b on b.name = {basename('r.src')}""",
)
def image_resolution(spark, d):
    refs = images.image_refs(view(spark, d, "topics"))
    return images.resolve_images(refs, view(spark, d, "files")).select("path", "pos", "src", "found")


SNIP = r'(?i)<MadCap:snippet(?:Block|Text)\b[^<>]*\ssrc="([^"]*)"'


@query(
    "snippet_resolution",
    ctes("topics", "files")
    + f""", refs as (select path, unnest({extract_all('html', SNIP)}) as src, generate_subscripts({extract_all('html', SNIP)}, 1) - 1 as pos from topics),
 cleaned as (select *, {sub('src', r'^(\.\./)+')} as c0 from refs),
 cand as (select path, pos, src, unnest([
   case when contains(c0, 'Resources/Snippets/') then 'Content/' || c0[instr(c0, 'Resources/Snippets/'):] end,
   'Content/Resources/Snippets/' || {sub('c0', '^(Resources/)?Snippets/')},
   case when starts_with(src, '../') then {normalize("(" + dirname('path') + ") || '/' || src")} end, src]) as c, unnest(range(4)) as k from cleaned),
 hit as (select path, pos, arg_min(c, k) as found from cand join (select distinct path as fp from files) f on fp = c group by path, pos)
 select path, cast(pos as integer) as pos, src, found from refs left join hit using (path, pos)""",
)
def snippet_resolution(spark, d):
    refs = snippets.snippet_refs(view(spark, d, "topics"))
    return images.resolve_snippets(refs, view(spark, d, "files")).select("path", "pos", "src", "found")


SNIPPET_PIECES = f"string_split({sub('html', '(?i)(<MadCap:snippet(?:Block|Text)' + chr(92) + 'b[^<>]*/>)', chr(1) + chr(92) + '1' + chr(1))}, chr(1))"


@query(
    "snippets_inlined",
    ctes("topics", "files")
    + f""", p as (select path, unnest({SNIPPET_PIECES}) as piece, generate_subscripts({SNIPPET_PIECES}, 1) as i from topics),
 c as (select *, {extract('piece', '(?i)^<[^<>]*' + chr(92) + 'ssrc=' + chr(34) + '([^' + chr(34) + ']*)' + chr(34))} as src from p),
 f as (select c.*, s.path as found from c left join files s on i % 2 = 0 and s.path = 'Content/Resources/Snippets/' || {sub(sub('src', '^([.][.]/)+'), '^(Resources/)?Snippets/')} and ends_with(s.path, '.flsnp'))
 select path, string_agg(case when i % 2 = 1 then piece when found is null then {q(snippets.MISSING_OPEN)} || src || {q(snippets.MISSING_CLOSE)}
  when contains(piece, 'snippetBlock') then {q(snippets.BLOCK_OPEN)} || '<p>Body ' || found || '</p>' || {q(snippets.BLOCK_CLOSE)} else '<p>Body ' || found || '</p>' end, '' order by i) as html from f group by path""",
)
def snippets_inlined(spark, d):
    path = F.col("path")
    bodies = view(spark, d, "files").filter(path.endswith(".flsnp")).select(
        "path",
        F.concat(F.lit("<html><head><title>s</title></head><body><p>Body "), path, F.lit("</p></body></html>")).alias("content"),
    )
    return snippets.inline_snippets(view(spark, d, "topics"), bodies)


def _target_sql():
    low = "lower(src)"
    whens = " ".join(
        f"when contains({low}, '{p}') then 'Images/' || src[instr({low}, '{p}') + {len(p)}:]" for p in images.IMAGE_FOLDERS
    )
    joined = normalize("(" + dirname("path") + ") || '/' || src")
    return f"case {whens} else {joined} end"


@query(
    "image_targets",
    ctes("topics") + f", {IMAGE_REFS} select path, cast(pos as integer) as pos, src, {_target_sql()} as target from refs",
)
def image_targets(spark, d):
    return images.image_targets(images.image_refs(view(spark, d, "topics")))


@query(
    "image_clashes",
    ctes("files")
    + f""" select {basename('path')} as name, count(*) as copies, min(path) as kept from files
 where lower({extname('path')}) in {inlist(P.IMAGE_EXTENSIONS)} group by 1 having count(*) > 1""",
)
def image_clashes(spark, d):
    return images.image_clashes(view(spark, d, "files"))


IMG_TAGS = extract_all("html", r"(?i)<img\s[^<>]*>", 0)


def attr_sql(tag, name):
    return extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""")


def _num(tag, name):
    return f"try_cast(nullif({extract(tag, rf'''(?i)\s{name}\s*=\s*[\x22']\s*(\d+)''')}, '') as integer)"


@query(
    "image_kinds",
    ctes("topics")
    + f""", t as (select path, unnest({IMG_TAGS}) as tag, generate_subscripts({IMG_TAGS}, 1) - 1 as pos from topics),
 a as (select *, {attr_sql('tag', 'src')} as src, {attr_sql('tag', 'class')} as css, {_num('tag', 'width')} as w, {_num('tag', 'height')} as h from t)
 select path, cast(pos as integer) as pos,
  case when contains(css, 'IconInline') then 'inline'
   when {rlike('src', P.SCREENSHOT_DIR)} then 'block'
   when {rlike('src', images.ICON_DIR)} or {rlike('src', '(?i)[.](ico|icon)')} or contains(src, 'GUI-Elemente')
     or coalesce(w <= 32 and h <= 32, false) then 'inline' else 'block' end as kind,
  case when contains(css, 'icon') or {contains_any('src', images.HELP_ICON_PARTS)} or coalesce(w between 1 and 36, false) or coalesce(h between 1 and 36, false) then 'icon'
   when contains(src, 'Screens/') or contains(css, 'screenshot') then 'large' else 'default' end as help_class
 from a""",
)
def image_kinds(spark, d):
    rows = view(spark, d, "topics").select("path", F.posexplode(images.image_tags(F.col("html"))).alias("pos", "tag"))
    tag = F.col("tag")
    return rows.select("path", "pos", images.image_kind(tag).alias("kind"), images.image_class(tag).alias("help_class"))


IMAGE_LINE = r"^(\s*)(image:+)([^\[]+)(\[.*\])\z"
LIST_ITEM = r"^\s*[.*]\s+"


@query(
    "image_kind_context",
    ctes("drafts") + ", " + lines("drafts", "text")
    + f""", ctx as (select *, lag(line) over w as prev, lead(line) over w as nxt from lines window w as (partition by path order by line_no)),
 m as (select path, line_no, line, coalesce(prev, '') as p0, trim(coalesce(prev, '')) as b, trim(coalesce(nxt, '')) as n,
  {extract('line', IMAGE_LINE, 3)} as src, {extract('line', IMAGE_LINE, 4)} as att from ctx where {rlike('line', IMAGE_LINE)}),
 f as (select *, lower(src) as low, coalesce(try_cast(nullif({extract('att', 'width=([0-9]+)')}, '') as integer), 0) as w,
  coalesce(try_cast(nullif({extract('att', 'height=([0-9]+)')}, '') as integer), 0) as h,
  (b = '' or ends_with(b, '+') or n = '' or starts_with(n, '=')) as alone,
  (length(b) > 20 and not ends_with(b, '+') and not starts_with(b, '.')) as follows,
  ({rlike('line', LIST_ITEM)} or {rlike('p0', LIST_ITEM)}) as in_list from m)
 select path, cast(line_no as integer) as line_no, src,
  case when contains(att, 'role=icon') then 'inline'
   when {contains_any('low', ['icon', 'button', '/gui/'])} and not contains(low, 'screen') then 'inline'
   when w between 1 and 32 and h between 1 and 32 then 'inline'
   when {contains_any('low', ['small', 'thumb', 'icon'])} and w <= 48 then 'inline'
   when contains(low, 'screen') then 'block' when w > 100 then 'block'
   when alone and not follows then 'block' when in_list and not alone then 'inline'
   when follows and w between 1 and 64 then 'inline' else 'block' end as kind from f""",
)
def image_kind_context(spark, d):
    return images.image_kind_context(view(spark, d, "drafts"))


