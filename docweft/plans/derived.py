"""Corpus views derived from the given tables.

The tables hold no authoring markup, so topics, files, definitions, TOC entries and
progress events are derived from them by SQL that means the same in Spark and in
the checking engine. Whole tables and whole texts are used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docweft.sources.corpus import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

ID = "cast(doc_id as varchar(20))"
FOLDER = "case doc_id % 3 when 0 then 'guide/' when 1 then 'admin/' else '' end"
UP = "case doc_id % 3 when 2 then '' else '../' end"

TOPICS = f"""
select doc_id,
 concat('Content/', {FOLDER}, 'doc-', {ID}, '.htm') as path,
 concat('<html><head><title>Title ', {ID}, '</title><style>p{{margin:0}}</style></head><body>', chr(10),
  case when doc_id % 50 = 3 then '' else concat('<h1>Topic ', cast(doc_id % 300 as varchar(20)), '</h1>') end, chr(10),
  '<p',
  case doc_id % 9 when 0 then ' madcap:conditions="General.Deprecated"'
                  when 1 then ' data-mc-conditions="Internal, Draft"'
                  when 2 then ' madcap:conditions="Default.Print-Only;Beta"'
                  when 3 then ' data-mc-conditions="Red"'
                  when 4 then ' madcap:conditions="CustomerPortal.Advanced"'
                  when 5 then ' madcap:conditions="Web" data-mc-conditions="Beta,Mobile"'
                  else '' end,
  '>', replace(text, chr(10), concat('</p>', chr(10), '<p>')), '</p>', chr(10),
  '<p>See <a href="',
  case doc_id % 6 when 0 then concat('gone-', {ID}, '.htm')
                  when 1 then concat({UP}, 'doc-2.htm#s')
                  when 2 then concat({UP}, 'doc-2.htm')
                  when 3 then concat({UP}, 'doc-', cast(doc_id * 3 + 2 as varchar(20)), '.htm')
                  else concat('doc-', cast(doc_id - 3 as varchar(20)), '.htm#s', cast(doc_id % 3 as varchar(20))) end,
  '">next</a> ',
  case doc_id % 7 when 0 then '<MadCap:variable name="General.small_ring"/>'
                  when 1 then '<MadCap:variable name="General.Missing" />'
                  when 2 then '<MadCap:variable name="Set0.red_widget"/> and <MadCap:variable name="red_widget"/>'
                  when 3 then '<span data-mc-variable="General.blue_bolt">Blue</span>'
                  when 4 then '<span data-mc-variable="General.hot_gear">General.hot_gear</span> {{small_ring}}'
                  else '' end,
  '</p>', chr(10),
  case doc_id % 8 when 0 then '<p><a href="https://example.com/x">site</a> <a href="#top">top</a> <a href="file.pdf">pdf</a></p>'
                  when 1 then '<p><a href="mailto:a@b.c">mail</a> <a href="http://">bad</a></p>'
                  else '' end,
  case doc_id % 4 when 0 then '<ol><li>a</li><li>b</li></ol><ol madcap:continue="true"><li>c</li></ol>'
                  when 1 then '<ol><li>a</li><li>b</li><li>c</li></ol><ol madcap:continue="true"><li>d</li><li>e</li></ol><ol><li>f</li></ol><ol madcap:continue="true"><li>g</li></ol>'
                  else '' end, chr(10),
  case doc_id % 6 when 0 then concat('<p><img src="../Images/Screens/img-', {ID}, '.png" width="640" height="480"></p>')
                  when 1 then concat('<p><img src="Images/img-', cast(doc_id % 40 as varchar(20)), '.png" width="16" height="16" class="IconInline"></p>')
                  when 2 then '<p><img src="data:image/png;base64,AAAA"><img src="nowhere.gif"></p>'
                  else '' end,
  case doc_id % 5 when 0 then '<MadCap:snippetBlock src="../Resources/Snippets/snip-2.flsnp" />'
                  when 1 then concat('<MadCap:snippetText src="Snippets/snip-', {ID}, '.flsnp" />')
                  else '' end, chr(10),
  case doc_id % 10 when 0 then '<p>Use the <MadCap:glossaryTerm>Small Ring 0</MadCap:glossaryTerm> or <MadCap:glossaryTerm>Unknown</MadCap:glossaryTerm>.</p>'
                   when 1 then concat('<p><MadCap:glossaryTerm>brand#', cast(doc_id % 30 as varchar(20)), '</MadCap:glossaryTerm></p>')
                   else '' end,
  case doc_id % 11 when 0 then concat('<table><tr><th>Key</th><th>Value | unit</th></tr><tr><td>', {ID}, '</td><td align="right"><b>bold</b></td></tr></table>')
                   when 1 then '<table><tr><td colspan="2">wide cell here</td></tr><tr><td>x</td><td>y &amp; z</td></tr></table>'
                   else '' end, chr(10),
  case doc_id % 12 when 0 then '<MadCap:dropDown><MadCap:dropDownHead><MadCap:dropDownHotspot>More <b>help</b></MadCap:dropDownHotspot></MadCap:dropDownHead><MadCap:dropDownBody><p>Body</p></MadCap:dropDownBody></MadCap:dropDown>'
                   else '' end,
  case doc_id % 13 when 0 then '<p>As shown (Smith, 2023) and (Jones Brown 2019), see [1] and [22].</p>'
                   when 1 then '<p>Note<a href="#fn1">1</a> and<a href="#fn2">2</a>.</p><p id="fn1">First <em>note</em></p>'
                   when 2 then '<p class="bibliography">Smith, J. and Jones "On Rings" in Journal of Rings, 12, 2020 doi: 10.1000/xyz https://example.org/p</p>'
                   when 3 then '<p>Press Ctrl + S, F5 or ENTER now.</p>'
                   when 4 then '<p onclick="go()">Run</p><iframe src="x"></iframe><p style="color:red">x</p>'
                   else '' end,
  '</body></html>') as html
from documents
"""

DRAFTS = f"""
select doc_id, concat('out/', {FOLDER}, 'doc-', {ID}, '.adoc') as path,
 concat(
  case when doc_id % 17 = 5 then '' else concat('= Draft ', {ID}, chr(10), chr(10)) end,
  text, chr(10),
  case doc_id % 5 when 0 then concat('== Part', chr(10), '. one', chr(10), '+', chr(10), '. two', chr(10), '* star', chr(10), '*bold*', chr(10), '. three', chr(10))
                  when 1 then concat('== Part', chr(10), 'text', chr(10), '+', chr(10), '[NOTE]', chr(10), '====', chr(10), 'inner', chr(10), '====', chr(10), 'after', chr(10))
                  when 2 then concat('+', chr(10), chr(10), '..... five deep', chr(10), '* [loweralpha] x', chr(10))
                  else '' end,
  case doc_id % 6 when 0 then concat('|===', chr(10), '|a |b', chr(10), 'loose row', chr(10), '|===', chr(10), 'outside', chr(10))
                  when 1 then concat('|===', chr(10), '|a', chr(10), '[cols="1"]', chr(10), 'b', chr(10))
                  else '' end,
  case doc_id % 7 when 0 then concat('text', chr(10), 'image::../../../../img/a b.png[]', chr(10), 'image:icon.ico[Icon] and image::x.png[ ]', chr(10))
                  when 1 then concat('image::Images/Screens/s.png[Alt,width=640,height=480]', chr(10), chr(10), 'image:GUI/icon.png[role=icon]', chr(10))
                  else '' end,
  case doc_id % 8 when 0 then concat('include::variables[]', chr(10), 'include::includes/variables.adoc[] xref:a..htm#s[A] link:b.adoc[B]', chr(10))
                  when 1 then concat('xref:doc-1.adoc[One] and link:https://example.com[Site]', chr(10))
                  else '' end,
  case doc_id % 9 when 0 then concat('Quote â€™ and Â', chr(10))
                  when 1 then concat('function (x) {{ console.log(x); }}', chr(10))
                  when 2 then concat('<div>left</div> <br> <sub>2</sub> <span class="a">x</span>', chr(10))
                  when 3 then concat('latexmath:[x] <ref_1,[1]>', chr(10))
                  else '' end,
  case doc_id % 10 when 0 then concat('= Draft ', {ID}, chr(10), '== Part', chr(10))
                   when 1 then concat('== Advanced settings', chr(10), 'a', chr(10), 'b', chr(10), chr(10), 'c', chr(10), '== Create item 1', chr(10), 'x', chr(10))
                   else '' end,
  case doc_id % 11 when 0 then concat('1. first', chr(10), '2. second', chr(10), '3. third', chr(10), '1. again', chr(10), '2. more', chr(10), '7. alone', chr(10), '9. nine', chr(10), '10. ten', chr(10))
                   else '' end,
  case doc_id % 12 when 0 then concat('Set {{small_ring}} or {{smal_ring}} and {{Hot_Ge}} with {{zzzz qq}}', chr(10))
                   when 1 then concat('See [%=red_widget%] and [%=red_wdget%]', chr(10))
                   else '' end) as text
from documents
"""

FILES = """
select path, cast(length(html) as bigint) as size from topics
union all
select concat('Content/Images/', case p_partkey % 2 when 0 then 'Screens/' else 'Icons/' end,
  'img-', cast(cast((p_partkey - p_partkey % 2) / 2 as bigint) as varchar(20)), '.png') as path,
  cast(p_size * 1000 as bigint) as size
from part
union all
select concat(
  case c_custkey % 10 when 0 then 'Output/' when 1 then '.git/' when 2 then 'Content/Resources/Snippets/snip-'
   when 3 then 'Project/VariableSets/set-' when 4 then 'Project/TOCs/Online-' when 5 then 'Project/Glossaries/gloss-'
   when 6 then 'Content/../odd/c-' when 7 then 'My-Temp-Files/c-' when 8 then 'Content/Bars/IconBar-' else 'notes/README-' end,
  cast(c_custkey as varchar(20)),
  case c_custkey % 10 when 0 then '.htm' when 1 then '' when 2 then '.flsnp' when 3 then '.flvar' when 4 then '.fltoc'
   when 5 then '.flglo' when 6 then '.txt' when 7 then '.htm' when 8 then '.PNG' else '' end) as path,
  cast(c_custkey * 100000 as bigint) as size
from customer
"""

VARIABLES = """
select concat('set-', cast(p_size % 5 as varchar(20))) as set_name, p_partkey as ord,
 concat(case when p_partkey % 3 = 0 then concat('Set', cast(p_size % 5 as varchar(20)), '.') else '' end,
  replace(p_name, ' ', '_')) as name,
 case when p_partkey % 7 = 0 then '' else concat(p_brand, ' & ', p_type) end as value,
 case when p_partkey % 4 = 0 then p_type end as comment
from part
"""

GLOSSARY = """
select concat('entry-', cast(p_partkey as varchar(20))) as id, p_partkey as ord,
 concat(case when p_partkey % 9 = 0 then '3D ' else '' end, p_name, ' ', cast(p_partkey as varchar(20))) as term1,
 case when p_partkey % 2 = 0 then p_brand end as term2,
 concat('A ', p_type, ' part', case when p_partkey % 5 = 0 then concat(chr(10), 'of size ', cast(p_size as varchar(20))) else '' end) as definition,
 case when p_partkey % 6 = 0 then 'General.Internal' when p_partkey % 6 = 1 then 'Print' end as conditions
from part
"""

TOC = f"""
select concat('Project/TOCs/', lower(r_name), '.fltoc') as toc_path, cast(n_nationkey as bigint) as entry_id,
 cast(null as bigint) as parent_id, n_nationkey as ordinal, 0 as level, replace(n_name, '_', ' ') as title,
 case when n_nationkey % 5 = 4 then 'Content/doc-2.htm' end as href
from nation join region on n_regionkey = r_regionkey
union all
select concat('Project/TOCs/', lower(r_name), '.fltoc'), 1000 + doc_id,
 case cast((doc_id - doc_id % 25) / 25 as bigint) % 2 when 0 then cast(n_nationkey as bigint) else 1000 + doc_id - 25 end,
 cast(doc_id as integer), case cast((doc_id - doc_id % 25) / 25 as bigint) % 2 when 0 then 1 else 2 end,
 case when doc_id % 10 = 0 then '[%=System.LinkedTitle%]' else concat('Doc ', {ID}) end,
 case when doc_id % 20 = 7 then concat('Content/gone-', {ID}, '.htm')
      when doc_id % 20 = 8 then null
      else concat('Content/', {FOLDER}, 'doc-', {ID}, '.htm') end
from documents
join nation on n_nationkey = doc_id % 25
join region on n_regionkey = r_regionkey
"""

PROGRESS = """
select cast(user_id as varchar(20)) as session_id, event_id as seq, ts,
 case event_type when 'signup' then 'conversion_start' when 'view' then 'file_start' when 'click' then 'file_progress'
  when 'purchase' then 'file_complete'
  else case when event_id % 40 = 0 then 'conversion_error' when event_id % 40 = 20 then 'conversion_complete' else 'file_error' end
  end as type,
 case when event_type = 'signup' then cast(1000 + event_id % 100 as integer) end as total_files,
 case when event_type = 'view' then concat('doc-', cast(event_id as varchar(20)), '.htm') end as current_file,
 case when event_type = 'purchase' and event_id % 3 = 0 then 'slow' end as message,
 case when event_type = 'error' and event_id % 5 <> 0 then 'failed' end as error
from events
"""

STEPS = """
select cast(o_custkey as varchar(20)) as report_id, o_orderkey as step_id, o_orderdate as ts,
 case o_orderkey % 5 when 0 then 'pending' when 1 then 'in_progress' when 2 then 'completed' when 3 then 'failed'
  else 'skipped' end as status,
 cast(o_orderkey % 101 as integer) as progress
from orders
"""

STEP_EVENTS = """
select cast(l_orderkey as varchar(20)) as report_id, l_linenumber as step_id, min(l_shipdate) as ts, 'in_progress' as status
from lineitem group by l_orderkey, l_linenumber
union all
select cast(l_orderkey as varchar(20)), l_linenumber,
 max(l_shipdate) + interval 1 day,
 case l_linenumber % 3 when 0 then 'completed' when 1 then 'failed' else 'skipped' end
from lineitem where l_linenumber <> 7 group by l_orderkey, l_linenumber
"""

VIEWS = {
    "topics": TOPICS,
    "drafts": DRAFTS,
    "files": FILES,
    "variables": VARIABLES,
    "glossary": GLOSSARY,
    "toc": TOC,
    "progress_events": PROGRESS,
    "steps": STEPS,
    "step_events": STEP_EVENTS,
}
NEEDS = {"files": ["topics"]}
WIDE = ["documents", "pages"]  # tables of long texts, where the work per row is large
#: Views that group a table by nearly every row: the table is dealt out by this key first, since such groups do not
#: combine, and Spark gives tasks rows by their bytes, of which these rows have few.
DEALT = {"step_events": ("lineitem", "l_orderkey")}
ROWS = 250_000  # rows of a task where rows are dealt out


def _tables(name: str) -> set[str]:
    words = set(re.findall(r"\w+", VIEWS.get(name, name)))
    found = {t for t in TABLES if t in words}
    for needed in NEEDS.get(name, []):
        found |= _tables(needed)
    return found


def tasks(spark: SparkSession, folder: str, name: str) -> int:
    """Into how many tasks the rows of a view of ``DEALT`` go; the files' own counts are read."""
    rows = spark.read.parquet(f"{folder}/{DEALT[name][0]}.parquet").count()
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived view, or one of the given tables."""
    for table in sorted(_tables(name)):
        rows = spark.read.parquet(f"{folder}/{table}.parquet")
        if name in DEALT and table == DEALT[name][0]:
            rows = rows.repartition(tasks(spark, folder, name), DEALT[name][1])
        (spread(rows) if table in WIDE else rows).createOrReplaceTempView(table)
    if name in TABLES:
        return spark.table(name)
    for needed in NEEDS.get(name, []):
        spark.sql(VIEWS[needed]).createOrReplaceTempView(needed)
    return spark.sql(VIEWS[name])


def ctes(*names: str) -> str:
    """``with`` clause that defines the views for the checking engine."""
    ordered: list[str] = []
    for name in names:
        for item in [*NEEDS.get(name, []), name]:
            if item not in ordered:
                ordered.append(item)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in ordered)
