"""Readers of the three XML side files: variable sets, glossaries, TOCs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.functions import paths as P
from docweft.functions.text import all_matches, let, nonempty, trim_ws

VARIABLE_SCHEMA = (
    "struct<Variable: array<struct<_Name: string, _Definition: string, _EvaluatedDefinition: string, "
    "_Comment: string, _Type: string, _OriginalName: string, _LastUpdated: string, _VALUE: string>>>"
)
GLOSSARY_ROOT = "<CatapultGlossary"
VARIABLE_ROOT = "<CatapultVariableSet"


def _decoded(c):
    """The five XML entities."""
    for mark, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]:
        c = F.replace(c, F.lit(mark), F.lit(char))
    return c


def _attribute(element, name):
    return nonempty(_decoded(F.regexp_extract(element, rf'^<[^>]*\s{name}="([^"]*)"', 1)))


def read_variable_defs(files: DataFrame) -> DataFrame:
    """One row per named variable element; ``ord`` is (path, position).

    The value is the evaluated definition, else the text, else the definition,
    else empty; an empty value counts as missing at each step.
    """
    schema = VARIABLE_SCHEMA[len("struct<"):-1].replace("Variable: ", "Variable ")
    parsed = files.filter(F.col("content").contains(VARIABLE_ROOT)).select(
        "path", F.from_xml("content", schema, {"attributePrefix": "_"}).alias("x")
    )
    rows = parsed.select("path", F.posexplode("x.Variable").alias("pos", "v"))
    return rows.filter(F.coalesce(F.col("v._Name"), F.lit("")) != "").select(
        P.stem(F.col("path")).alias("set_name"),
        F.col("path").alias("file_path"),
        F.struct("path", "pos").alias("ord"),
        F.col("v._Name").alias("name"),
        F.coalesce(
            nonempty(F.col("v._EvaluatedDefinition")),
            nonempty(trim_ws(F.col("v._VALUE"))),
            nonempty(F.col("v._Definition")),
            F.lit(""),
        ).alias("value"),
        nonempty(F.col("v._Definition")).alias("definition"),
        nonempty(F.col("v._Comment")).alias("comment"),
        nonempty(F.col("v._Type")).alias("type"),
        nonempty(F.col("v._OriginalName")).alias("original_name"),
        nonempty(F.col("v._LastUpdated")).alias("last_updated"),
    )


def variable_file_errors(files: DataFrame) -> DataFrame:
    """Variable-set files that cannot be read, as rows."""
    schema = "Variable array<struct<_Name: string>>, _corrupt string"
    bad = F.from_xml("content", schema, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    return (
        files.select("path", "content", bad.alias("x"))
        .select(
            "path",
            F.when(
                ~F.col("content").contains(VARIABLE_ROOT),
                F.concat(F.lit("Invalid FLVAR file: Missing CatapultVariableSet root element in "), F.col("path")),
            )
            .when(F.col("x._corrupt").isNotNull(), F.concat(F.lit("XML parsing error in "), F.col("path")))
            .alias("error"),
        )
        .filter(F.col("error").isNotNull())
    )


def read_glossary(files: DataFrame) -> DataFrame:
    """Glossary entries with at least one term and a definition.

    Entries are cut out and numbered inside their file row, so the default id needs
    no window over the corpus.
    """
    entries = F.transform(
        all_matches(F.col("content"), r"(?s)<GlossaryEntry\b[^>]*>.*?</GlossaryEntry>", 0),
        lambda e: F.struct(
            e.alias("raw"),
            F.filter(
                F.transform(
                    all_matches(e, r"(?s)<Term\b[^>]*>(.*?)</Term>"),
                    lambda t: trim_ws(_decoded(F.regexp_replace(t, "<[^>]*>", ""))),
                ),
                lambda t: t != "",
            ).alias("terms"),
            F.regexp_extract(e, r"(?s)<Definition\b[^>]*>(.*?)</Definition>", 1).alias("inner"),
        ),
    )
    shaped = F.transform(
        entries,
        lambda e: F.struct(
            e["raw"].alias("raw"),
            e["terms"].alias("terms"),
            F.when(e["inner"].rlike(r"<(p|ul|ol|li)\b"), e["inner"])
            .otherwise(trim_ws(_decoded(F.regexp_replace(e["inner"], "<[^>]*>", ""))))
            .alias("definition"),
        ),
    )
    kept = F.filter(shaped, lambda e: (F.size(e["terms"]) > 0) & (e["definition"] != ""))
    rows = files.select("path", F.posexplode(kept).alias("pos", "e"))
    raw = F.col("e.raw")
    return rows.select(
        F.col("path").alias("file_path"),
        F.struct("path", "pos").alias("ord"),
        F.coalesce(
            _attribute(raw, "glossTerm"), F.concat(F.lit("glossary-"), F.col("pos").cast("string"))
        ).alias("id"),
        F.col("e.terms").alias("terms"),
        F.col("e.definition").alias("definition"),
        _attribute(raw, "conditions").alias("conditions"),
        _attribute(raw, "TermClass").alias("term_class"),
        F.coalesce(_attribute(raw, "IgnoreCase") == "true", F.lit(False)).alias("ignore_case"),
        nonempty(_decoded(F.regexp_extract(raw, r'<Definition\b[^>]*\sLink="([^"]*)"', 1))).alias("link"),
    )


# --- fixed values: the grammar of XML tags, references and comments ----------------------------
XML_NAME = r"[A-Za-z_:][\w:.\-]*"
XML_ATTRIBUTE = rf"""\s+{XML_NAME}\s*=\s*(?:"[^"<]*"|'[^'<]*')"""
XML_SKIPPED = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^\[>]*(?:\[[^\]]*\])?[^>]*>"
XML_TAG = rf"<{XML_NAME}(?:{XML_ATTRIBUTE})*\s*/?>|</{XML_NAME}\s*>"
XML_BARE = r"&(?!(?:lt|gt|amp|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)"
# -----------------------------------------------------------------------------------------------
#: Entries that the fold appends to before it starts the next list.
LIST_PART = 256
TOC_OPEN = "array<struct<name: string, id: int, parent: int, ordinal: int, level: int, tag: string, children: int>>"
TOC_ENTRY = "struct<entry_id: int, parent_id: int, ordinal: int, level: int, tag: string, child_count: int>"


def _tag_attribute(tag, *names):
    """The first non-empty attribute of these names, with its references resolved."""
    found = []
    for name in names:
        raw = F.regexp_extract(tag, rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
        other = F.regexp_extract(tag, rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 2)
        # white space in an attribute counts as a blank
        plain = F.translate(F.concat(raw, other), "\n\r\t", "   ")
        pieces = F.split(plain, r"(?=&#(?:[0-9]+|x[0-9A-Fa-f]+);)")
        found.append(nonempty(F.array_join(F.transform(pieces, _numbered), "")))
    return F.coalesce(*found)


def _numbered(piece):
    """A text that may start with a numeric reference."""
    digits = F.regexp_extract(piece, r"^&#(x?[0-9A-Fa-f]+);", 1)
    code = F.when(digits.startswith("x"), F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits).try_cast("int")
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    rest = _decoded(F.regexp_replace(piece, r"^&#x?[0-9A-Fa-f]+;", ""))
    return F.when(digits != "", F.concat(char, rest)).otherwise(_decoded(piece))


def flatten_toc(content):
    """Nested TOC entries of one file in pre-order; null if the file is not well formed.

    A fold over the tags with a stack of the open ones. An entry counts if its parents are
    entries up to the root. It is noted when it closes, in lists of bounded length, so no
    long array is copied at each tag; sorting by number gives the order of the openings.
    """
    markup = F.regexp_replace(F.regexp_replace(F.coalesce(content, F.lit("")), "^\ufeff", ""), XML_SKIPPED, "")
    broken = markup.rlike(XML_BARE) | F.regexp_replace(markup, XML_TAG, "").contains("<")
    none = f"array<{TOC_ENTRY}>"
    start = F.struct(
        F.array().cast(TOC_OPEN).alias("open"), F.array().cast(none).alias("part"), F.array().cast(f"array<{none}>").alias("full"),
        F.lit(0).alias("next"), F.lit(0).alias("roots"), broken.alias("bad"),
    )

    def opened(s, mark, top):
        depth, name, tag = F.size(s["open"]), mark["name"], mark["tag"]
        # the root is numbered -1; what is no entry has no number
        entry = (depth > 0) & (name == "TocEntry") & top["id"].isNotNull()
        number = F.when(depth == 0, -1).when(entry, s["next"]).cast("int")
        held = F.when(
            entry,
            F.concat(
                F.slice(s["open"], F.lit(1), depth - 1),
                F.array(top.withField("children", top["children"] + 1)),
            ),
        ).otherwise(s["open"])
        new = F.struct(
            name.alias("name"), number.alias("id"), F.when(top["id"] >= 0, top["id"]).cast("int").alias("parent"),
            top["children"].alias("ordinal"), (depth - 1).cast("int").alias("level"), tag.alias("tag"), F.lit(0).alias("children"),
        )
        return F.struct(
            F.concat(held, F.array(new)).cast(TOC_OPEN).alias("open"), s["part"].alias("part"), s["full"].alias("full"),
            (s["next"] + entry.try_cast("int")).cast("int").alias("next"),
            (s["roots"] + (depth == 0).cast("int")).alias("roots"), (s["bad"] | ((depth == 0) & (s["roots"] > 0))).alias("bad"),
        )

    def closed(s, name, top):
        row = F.struct(
            top["id"].alias("entry_id"), top["parent"].alias("parent_id"), top["ordinal"].alias("ordinal"),
            top["level"].alias("level"), top["tag"].alias("tag"), top["children"].alias("child_count"),
        )
        entry = F.coalesce(top["id"] >= 0, F.lit(False))
        whole = entry & (F.size(s["part"]) >= LIST_PART)
        part = F.when(whole, F.array(row)).when(entry, F.concat(s["part"], F.array(row))).otherwise(s["part"])
        return F.struct(
            F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0))).cast(TOC_OPEN).alias("open"),
            part.cast(none).alias("part"),
            F.when(whole, F.concat(s["full"], F.array(s["part"]))).otherwise(s["full"]).cast(f"array<{none}>").alias("full"),
            s["next"].alias("next"), s["roots"].alias("roots"),
            (s["bad"] | F.coalesce(top["name"] != name, F.lit(True))).alias("bad"),
        )

    def marks_of(tag, name):
        opens, closes = (F.struct(F.lit(x).alias("closes"), name.alias("name"), tag.alias("tag")) for x in (False, True))
        # an empty tag opens and closes
        return F.when(tag.endswith("/>"), F.array(opens, closes)).when(tag.startswith("</"), F.array(closes)).otherwise(F.array(opens))

    # names are cut out before the fold, where each expression is evaluated as often as it is used
    marks = F.flatten(F.transform(
        all_matches(markup, XML_TAG, 0), lambda t: let(F.regexp_extract(t, rf"^</?({XML_NAME})", 1), lambda name: marks_of(t, name))
    ))
    step = lambda s, m: let(
        F.try_element_at(s["open"], F.lit(-1)), lambda top: F.when(m["closes"], closed(s, m["name"], top)).otherwise(opened(s, m, top))
    )
    return F.aggregate(
        marks, start, step,
        lambda s: F.when(
            ~s["bad"] & (s["roots"] == 1) & (F.size(s["open"]) == 0), F.array_sort(F.concat(F.flatten(s["full"]), s["part"]))
        ),
    )


def read_toc(files: DataFrame) -> DataFrame:
    """TOC adjacency rows of every file: ``toc_path`` plus the flattened entry.

    A file that is not well formed has no rows. Work stays within the row of a file.
    """
    rows = files.select(F.col("path").alias("toc_path"), F.explode(flatten_toc(F.col("content"))).alias("e"))
    title = F.coalesce(_tag_attribute(F.col("e.tag"), "Title", "title"), F.lit("Untitled"))
    return rows.select(
        "toc_path", "e.entry_id", "e.parent_id", "e.ordinal", "e.level", title.alias("title"),
        _tag_attribute(F.col("e.tag"), "Link", "href").alias("href"), "e.child_count",
    ).select(
        "toc_path", "entry_id", "parent_id", "ordinal", "level", "title", "href",
        (F.col("title") == "[%=System.LinkedTitle%]").alias("linked_title"), "child_count",
    )


def toc_titles(toc: DataFrame) -> DataFrame:
    """Book title per TOC: the first entry's title, else the file stem."""
    first = toc.groupBy("toc_path").agg(F.min_by("title", "entry_id").alias("title"))
    return first.select(
        "toc_path", F.coalesce(F.col("title"), P.stem(F.col("toc_path"))).alias("book_title")
    )
