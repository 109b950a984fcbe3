"""Tables of contents: counts, plans, master documents, target trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweft.functions import paths as P
from docweft.functions.text import nonempty, own_key, slug, title_case, topic_title, trim_ws
from docweft.operators import matching
from docweft.operators.conditions import topic_instance
from docweft.operators.links import first_existing
from docweft.session import cut, stored

# --- fixed values -----------------------------------------------------------
LINKED_TITLE = "[%=System.LinkedTitle%]"
TOPIC_ROOTS = ["", "Project/Content/", "Source/Content/"]
SEARCH_ROOTS = ["Content/", "Project/Content/", "Source/Content/"]
BOOK_LINES = [":toc: left"]
BOOK_TAIL = [":sectnums:", ":sectlinks:", ":icons: font", ":experimental:"]
BOOK_EXTRA = [":partnums:", ":chapter-signifier: Chapter", ":appendix-caption: Appendix"]
MASTER_HEAD = [
    "= Master Documentation", ":doctype: book", ":toc: left", ":toclevels: 3", ":sectnums:", ":sectlinks:",
    ":icons: font", "",
    "This document includes all converted documentation from the MadCap Flare project.", "",
]
# ---------------------------------------------------------------------------

ANCESTOR = "array<struct<title:string,href:string,ordinal:int>>"


def toc_counts(toc: DataFrame) -> DataFrame:
    """Entries per TOC and, with a null path, overall."""
    return toc.rollup("toc_path").agg(F.count("*").alias("entries"))


def toc_report(toc: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` top-level sections per TOC with child counts."""
    children = toc.filter(F.col("parent_id").isNotNull()).groupBy("toc_path", "parent_id").agg(
        F.count("*").alias("children")
    )
    rank = F.row_number().over(Window.partitionBy("toc_path").orderBy("ordinal"))
    top = toc.filter(F.col("parent_id").isNull()).withColumn("rank", rank).filter(F.col("rank") <= n)
    children = children.withColumnRenamed("parent_id", "entry_id")
    return top.join(children, ["toc_path", "entry_id"], "left").select(
        "toc_path", "rank", "title", F.col("href").isNotNull().alias("has_link"),
        F.coalesce("children", F.lit(0)).cast("bigint").alias("children"),
    )


def with_ancestors(toc: DataFrame, max_level: int | None = None) -> DataFrame:
    """Add ``ancestors`` (root first) and ``sort_key`` (ordinals from the root).

    Pointers are doubled: each step joins every entry with the entry that its chain has
    come to, and takes over that one's chain, so a depth of d needs log2(d) joins. Steps
    start from stored tables; the source is read once.
    """
    toc = stored(toc, "toc")
    if max_level is None:
        max_level = toc.agg(F.max("level")).first()[0] or 0
    # chain: the ancestors found so far, root side first; top: where the chain goes on, null at a root
    chains = toc.select(
        "toc_path", "entry_id", F.col("parent_id").alias("top"), F.array().cast(ANCESTOR).alias("chain"),
        F.struct("title", "href", "ordinal").alias("own"),
    )
    for _ in range(int(max_level).bit_length()):
        # what an entry hands on: its own and all that its chain holds
        given = chains.select(
            "toc_path", F.col("entry_id").alias("top"), F.col("top").alias("next"),
            F.concat("chain", F.array("own")).alias("more"),
        )
        ended = chains.filter("top is null")
        open_ = chains.filter("top is not null").join(given, ["toc_path", "top"], "left")
        chains = stored(
            ended.unionByName(
                open_.select(
                    "toc_path", "entry_id", F.col("next").alias("top"),
                    F.concat(F.coalesce("more", F.array().cast(ANCESTOR)), "chain").alias("chain"), "own",
                )
            ),
            "chains",
        )
    rows = toc.join(chains.select("toc_path", "entry_id", F.col("chain").alias("ancestors")), ["toc_path", "entry_id"])
    key = F.concat(F.transform("ancestors", lambda a: a["ordinal"]), F.array("ordinal"))
    return rows.select(*toc.columns, "ancestors", key.alias("sort_key"))


def book_titles(toc: DataFrame) -> DataFrame:
    """Title per TOC: the first top entry's, else the file stem."""
    first = toc.filter(F.col("parent_id").isNull()).groupBy("toc_path").agg(
        F.min_by("title", "ordinal").alias("title")
    )
    return first.select("toc_path", F.coalesce(nonempty(F.col("title")), P.stem(F.col("toc_path"))).alias("book_title"))


def plan_toc(toc: DataFrame, format: str = "asciidoc", max_level: int | None = None) -> DataFrame:
    """Output path of every linked entry, with the pre-order sort key.

    Entries without a link open a folder for their children; linked entries do not.
    """
    rows = with_ancestors(toc, max_level).join(book_titles(toc), "toc_path")
    folders = F.transform(
        F.filter("ancestors", lambda a: a["href"].isNull()), lambda a: slug(a["title"], "folder")
    )
    base = F.array_join(F.concat(F.array(slug(F.col("book_title"), "folder")), folders), "/")
    name = F.concat(P.stem(F.col("href")), F.lit(P.OUTPUT_EXTENSION[format]))
    return rows.select(
        "toc_path", "entry_id", "sort_key", "level", "title",
        F.col("href").alias("input_path"),
        F.when(F.col("href").isNotNull(), F.concat(base, F.lit("/"), name)).alias("output_path"),
        base.alias("base_path"),
    )


def toc_file_map(plan: DataFrame) -> DataFrame:
    """``old_path, new_path``: the last duplicate link wins."""
    return (
        plan.filter(F.col("input_path").isNotNull())
        .groupBy(F.col("input_path").alias("old_path"))
        .agg(F.max_by("output_path", F.struct("toc_path", "sort_key")).alias("new_path"))
    )


def missing_toc_targets(toc: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """Linked entries whose file does not exist."""
    linked = toc.filter(F.col("href").isNotNull())
    path = P.normalize(F.concat(F.lit(root.rstrip("/") + "/" if root else ""), F.col("href")))
    return linked.withColumn("_path", path).join(
        files.select(F.col("path").alias("_path")).distinct(), "_path", "left_anti"
    ).drop("_path")


def resolve_linked_titles(toc: DataFrame, topics: DataFrame, root: str = "") -> DataFrame:
    """Entries with the linked-title token take the title of their topic."""
    titles = topics.select(
        F.col("path").alias("_path"),
        F.coalesce(topic_title(F.col("html")), P.stem(F.col("path"))).alias("_title"),
    )
    prefix = root.rstrip("/") + "/" if root else ""
    wanted = F.when(F.col("title") == LINKED_TITLE, P.normalize(F.concat(F.lit(prefix), F.col("href"))))
    keyed = toc.withColumn("_path", own_key(wanted, F.col("entry_id")))
    joined = keyed.join(titles, "_path", "left")
    columns = [c for c in toc.columns if c not in ("title", "linked_title")]
    return joined.select(
        *columns,
        F.coalesce("_title", "title").alias("title"),
        ((F.col("title") == LINKED_TITLE) & F.col("_title").isNull()).alias("linked_title"),
    )


def find_topic(entries: DataFrame, files: DataFrame) -> DataFrame:
    """``href, found``: literal path, three roots, then a similar name.

    Similar means that one lower-cased stem contains the other; the first file of
    the first content folder wins.
    """
    keys = entries.filter(F.col("href").isNotNull()).select("href").distinct()
    places = F.array(F.col("href"), *[F.concat(F.lit(r), F.col("href")) for r in TOPIC_ROOTS[1:]])
    direct = first_existing(keys, places, files, ["href"])
    rest = cut(keys.join(direct, "href", "left_anti").withColumn("a", F.lower(P.stem(F.col("href")))))
    rank = F.lit(None).cast("int")
    for i, root in reversed(list(enumerate(SEARCH_ROOTS))):
        rank = F.when(F.col("path").startswith(root), i).otherwise(rank)
    known = cut(
        files.select("path", F.lower(P.stem(F.col("path"))).alias("b"), rank.alias("root"))
        .filter(F.col("root").isNotNull())
        .groupBy("b")
        .agg(F.min(F.struct("root", "path")).alias("first"))
    )
    near = matching.first_containment(rest.select("a").distinct(), known)
    similar = rest.join(near, "a").select("href", F.col("first.path").alias("found"))
    return direct.unionByName(similar)


# --- rendering --------------------------------------------------------------
def render_master(
    toc: DataFrame,
    format: str = "adoc",
    author: str | None = None,
    levels: int = 3,
    book: bool = True,
    chapter_breaks: bool = False,
    variables_file: bool = False,
    max_level: int | None = None,
) -> DataFrame:
    """``toc_path, sort_key, seq, line`` rows of one master document per TOC."""
    head = ([author] if author else []) + ([":doctype: book"] if book else []) + BOOK_LINES
    head += [f":toclevels: {levels}"] + BOOK_TAIL + (BOOK_EXTRA if book else []) + [""]
    if variables_file:
        head += ["include::variables.adoc[]", ""]
    titles = book_titles(toc)
    fixed = F.array(*[F.lit(h) for h in head])
    top = titles.select(
        "toc_path",
        F.array().cast("array<int>").alias("sort_key"),
        F.posexplode(F.concat(F.array(F.concat(F.lit("= "), F.col("book_title"))), fixed)).alias("seq", "line"),
    )
    rows = with_ancestors(toc, max_level)
    heading = F.concat(F.repeat(F.lit("="), F.least(F.col("level") + 2, F.lit(6))), F.lit(" "), F.col("title"))
    ext = ".adoc" if format == "adoc" else ".md"
    include = F.concat(F.lit("include::"), P.stem(F.col("href")), F.lit(ext + "[]"))
    chapter = F.when((F.col("level") == 0) & F.lit(chapter_breaks and book), F.lit("[chapter]"))
    parents = toc.select("toc_path", F.col("parent_id").alias("entry_id"), F.lit(True).alias("_parent"))
    parents = parents.filter(F.col("entry_id").isNotNull()).distinct()
    rows = rows.join(parents, ["toc_path", "entry_id"], "left")
    entry = F.when(
        F.col("href").isNotNull(),
        F.array_compact(F.array(chapter, heading, F.lit(""), include, F.lit(""))),
    ).when(F.col("_parent"), F.array(heading, F.lit("")))
    body = rows.select("toc_path", "sort_key", F.posexplode(entry).alias("seq", "line"))
    return top.unionByName(body)


def files_by_directory(outputs: DataFrame) -> DataFrame:
    """``dir, name, out_path`` sorted by folder and name; folders stay rows."""
    path = F.col("out_path")
    return outputs.select(P.dirname(path).alias("dir"), P.basename(path).alias("name"), "out_path").orderBy(
        "dir", F.lower("name"), "name"
    )


def render_fallback_master(outputs: DataFrame, format: str = "asciidoc") -> DataFrame:
    """``sort_key, line`` rows of a master built from the files present.

    ``outputs`` has ``out_path, text``; titles come from the ``=`` line.
    """
    spark = outputs.sparkSession
    path = F.col("out_path")
    if format != "asciidoc":
        head = spark.createDataFrame(
            [(i, t) for i, t in enumerate(["# Master Documentation", "", "Converted files:"])], "seq int, line string"
        ).select(F.struct(F.lit("").alias("dir"), F.lit("").alias("path"), "seq").alias("sort_key"), "line")
        body = outputs.select(
            F.struct(F.lit("~").alias("dir"), path.alias("path"), F.lit(0).alias("seq")).alias("sort_key"),
            F.concat(F.lit("- "), path).alias("line"),
        )
        return head.unionByName(body)
    top_dir = F.substring_index(P.dirname(path), "/", 1)
    title = F.coalesce(
        nonempty(trim_ws(F.regexp_extract("text", r"(?m)^=\s+([^\n\r]+)$", 1))),
        F.regexp_replace(P.stem(path), "[-_]", " "),
    )
    head = spark.createDataFrame(list(enumerate(MASTER_HEAD)), "seq int, line string").select(
        F.struct(F.lit("").alias("dir"), F.lit("").alias("path"), "seq").alias("sort_key"), "line"
    )
    rows = outputs.select(top_dir.alias("dir"), path.alias("path"), title.alias("title"))
    folders = rows.select("dir").distinct().select(
        "dir",
        F.posexplode(
            F.array(
                F.concat(F.lit("= "), F.upper(F.substring("dir", 1, 1)), F.substr("dir", F.lit(2))), F.lit("")
            )
        ).alias("seq", "line"),
    ).select(F.struct("dir", F.lit("").alias("path"), "seq").alias("sort_key"), "line")
    body = rows.select(
        "dir", "path",
        F.posexplode(
            F.array(
                F.concat(F.lit("== "), F.col("title")), F.lit(""),
                F.concat(F.lit("include::"), F.col("path"), F.lit("[]")), F.lit(""),
            )
        ).alias("seq", "line"),
    ).select(F.struct("dir", "path", "seq").alias("sort_key"), "line")
    return head.unionByName(folders).unionByName(body)


def toc_from_files(file_map: DataFrame) -> DataFrame:
    """Fallback TOC: one entry per converted topic, in path order."""
    # each use of a path, and the sampling of the order, would read its title from the text again
    file_map = stored(file_map.select("old_path", "new_path"), "file_map")
    name = P.basename(F.col("new_path"))
    stem = F.regexp_replace(name, r"\.md\z", "")
    return (
        file_map.filter(F.col("new_path").endswith(".md"))
        .select(
            "old_path",
            title_case(F.regexp_replace(stem, "[-_]", " ")).alias("title"),
            F.col("new_path").alias("topic_file"),
            F.regexp_replace(F.lower(stem), "[^a-z0-9-]", "-").alias("id"),
        )
        .orderBy("old_path", "topic_file")
    )


def topic_tree(toc: DataFrame, file_map: DataFrame, mapping=None) -> DataFrame:
    """Entries for the other target: ``.md`` link, instance, id, then the path mapping.

    ``toc`` may carry ``conditions`` (array) and ``id``.
    """
    topic_file = F.regexp_replace("href", r"(?i)\.html?\z", ".md")
    columns = [c for c in ("toc_path", "entry_id", "parent_id", "ordinal", "level") if c in toc.columns]
    conditions = F.col("conditions") if "conditions" in toc.columns else F.array().cast("array<string>")
    entry_id = slug(F.col("id"), "id") if "id" in toc.columns else F.lit(None).cast("string")
    rows = toc.select(
        *columns, "title", topic_file.alias("_file"), topic_instance(conditions, mapping).alias("instance"),
        entry_id.alias("id"),
    )
    moved = file_map.select(F.col("old_path").alias("_file"), "new_path")
    moved = moved.withColumnRenamed("_file", "_key")
    rows = rows.withColumn("_key", own_key(F.col("_file"), F.concat_ws("/", *columns) if columns else F.col("title")))
    return rows.join(moved, "_key", "left").select(
        *columns, "title", F.coalesce("new_path", "_file").alias("topic_file"), "instance", "id"
    )
