"""Corpus scan, file filters, file discovery and the sink set."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import paths as P
from docweft.functions.text import any_of, compact, contains_any, format_bytes, trim_ws

# --- fixed values -----------------------------------------------------------
SUPPORTED = [
    "html", "htm", "docx", "doc", "xml", "flsnp", "flglo", "fltoc", "flvar",
    "png", "jpg", "jpeg", "gif", "svg", "webp", "bmp",
]
IMAGES = ["png", "jpg", "jpeg", "gif", "svg", "webp", "bmp"]
EXCLUDED_DIRS = [
    "Output", "output", "TargetOutput", "Temporary", "temporary", "AutoMerge", "Backup", "backup",
    ".git", ".svn", ".hg", "node_modules", ".next", "dist", "build", ".vscode", ".idea", ".vs",
    ".DS_Store", "Thumbs.db", "$RECYCLE.BIN",
]
UPLOAD_EXCLUDED_DIRS = [
    "Output", "output", "TargetOutput", "Temporary", "temporary", "AutoMerge", "Backup", "backup",
    ".git", ".svn", "node_modules",
]
RESOURCE_DIRS = [
    ("snippets", "snippets directory - content gets converted, source files not needed"),
    ("pagelayouts", "page layouts directory - design templates not needed"),
    ("variablesets", "variable sets directory - .flvar files processed into variables.adoc"),
    ("tocs", "TOCs directory - .fltoc files processed into document structure"),
    ("stylesheets", "stylesheets directory - CSS handled separately"),
]
TOC_DENY = [
    "pdf", "print", "printable", "review", "draft", "api", "developer", "technical", "sdk",
    "reference", "internal",
]
TOC_ALLOW = [
    "online", "user", "admin", "administration", "administrator", "manual", "guide", "help",
    "documentation",
]
TOC_NAMES = ["toc.fltoc", "main.fltoc", "master.fltoc"]
TOC_DIRS = ["Project/TOCs", "TOCs", "Project/AdvancedTOCs", "AdvancedTOCs"]
VARIABLE_DIRS = [
    "Project/VariableSets", "Content/Resources/Variables", "Content/Variables", "Variables",
    "VariableSets",
]
GLOSSARY_DIRS = ["Glossaries", "Project", "Content", "input", "Resources"]
LINT_FORMATS = [
    ".htm", ".html", ".docx", ".doc", ".flsnp", ".flglo", ".fltoc", ".xml", ".png", ".jpg", ".jpeg",
    ".gif", ".svg", ".webp", ".bmp",
]
MAX_PATH = 4096
MAX_FILE = 100 * 1024 * 1024
MAX_CONTENT = 50 * 1024 * 1024
MEDIA_MARKS = ["data:video/webm", "data:video/mp4", "data:application/octet-stream", "data:audio/"]
# ---------------------------------------------------------------------------


def spread(df: DataFrame) -> DataFrame:
    """Spread a table over at least ``docweft.minPartitions`` partitions.

    That setting is for single machines whose small files have one row group each. It is
    unset elsewhere, and then the table is returned as it is and no text is moved.
    """
    least = df.sparkSession.conf.get("docweft.minPartitions", None)
    return df if least is None or df.rdd.getNumPartitions() >= int(least) else df.repartition(int(least))


def dealt(df: DataFrame, per_task: int) -> DataFrame:
    """Deal rows out to tasks of about ``per_task`` rows.

    For short rows with much work each: their file is small, so by its size Spark would read
    it in one or two tasks, however many rows it has.
    """
    return df.repartition(max(1, -(-df.count() // per_task)))


def with_file_parts(files: DataFrame) -> DataFrame:
    """Add name, ext (no dot), dir and depth to a table that has ``path``."""
    return files.select(
        "*",
        P.basename(F.col("path")).alias("name"),
        F.lower(F.substr(P.extname(F.col("path")), F.lit(2))).alias("ext"),
        P.dirname(F.col("path")).alias("dir"),
        P.path_depth(F.col("path")).alias("depth"),
    )


def excluded_dir(segment: Column) -> Column:
    """A folder name the corpus scan does not enter."""
    low = F.lower(segment)
    return (
        segment.isin(EXCLUDED_DIRS)
        | low.isin(EXCLUDED_DIRS)
        | segment.startswith(".")
        | low.contains("temp")
        | low.contains("tmp")
    )


def folder_segments(path: Column) -> Column:
    parts = P.segments(path)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def junk_name(name: Column) -> Column:
    return (
        name.startswith("._")
        | name.isin(".DS_Store", "Thumbs.db")
        | any_of(name.endswith(e) for e in [".tmp", ".temp", ".bak", ".mclog", ".mcwebhelp"])
        | name.startswith("~")
        | name.contains(".fllog")
    )


SCANNED = "path string, modificationTime timestamp, length long, content binary"


def extension_glob(extensions: list[str]) -> str:
    """A file pattern for these extensions in any case; files it leaves out are never listed as input."""
    def any_case(ext):
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)

    return "*.{" + ",".join(any_case(e.lower()) for e in extensions) + "}"


def _scanned(located: DataFrame, root: str, max_bytes: int | None) -> DataFrame:
    """Kept files of a binary read below ``root``."""
    if max_bytes is not None:
        located = located.filter(F.col("length") <= max_bytes)  # reaches the scan: larger files are not read
    base = root.rstrip("/") + "/"
    located = located.select(
        F.regexp_replace("path", r"^file:/+", "/").alias("full"), "length", "modificationTime", "content"
    )
    files = located.select(
        F.substr("full", F.locate(base, F.col("full")) + len(base)).alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        F.decode("content", "UTF-8").alias("content"),
    )
    files = with_file_parts(files)
    kept = ~F.exists(folder_segments(F.col("path")), excluded_dir)
    return files.filter(kept & F.col("ext").isin(SUPPORTED) & ~junk_name(F.col("name")))


def scan_corpus(
    spark: SparkSession, root: str, recursive: bool = True, glob: str | None = None,
    extensions: list[str] | None = None, max_bytes: int | None = None,
) -> DataFrame:
    """Files under ``root`` with kept extensions outside excluded folders.

    ``content`` is decoded lazily: a plan that does not use it never reads the bytes. Only files
    of ``extensions`` (all kept ones by default; or of ``glob``) are planned, and of these no
    bytes of a file beyond ``max_bytes`` are read. Spark splits the listing into partitions by size.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", glob or extension_glob(extensions or SUPPORTED))
    return _scanned(reader.load(root), re.sub(r"^file:/+", "/", root), max_bytes)


def stream_corpus(
    spark: SparkSession, root: str, extensions: list[str] | None = None, max_bytes: int | None = None,
    files_per_batch: int = 1000,
) -> DataFrame:
    """``scan_corpus`` as a stream: each file once, when it appears; what was read is kept in the query's checkpoint."""
    reader = spark.readStream.format("binaryFile").schema(SCANNED).option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", extension_glob(extensions or SUPPORTED)).option("maxFilesPerTrigger", files_per_batch)
    return _scanned(reader.load(root), re.sub(r"^file:/+", "/", root), max_bytes)


def _matches(name: Column, pattern: str) -> Column:
    return name.endswith(pattern[1:]) if pattern.startswith("*") else name.contains(pattern)


def filter_files(files: DataFrame, include=None, exclude=None, mode: str = "pattern") -> DataFrame:
    """Exclude first; then, when an include list is given, the file must match it."""
    name, path = P.basename(F.col("path")), F.col("path")
    if mode == "substring":
        def hit(p):
            return name.contains(p) | path.contains(p)
        keep = ~(name.startswith("._") | (name == ".DS_Store"))
    else:
        def hit(p):
            return _matches(name, p)
        keep = ~junk_name(name)
    if exclude:
        keep = keep & ~any_of(hit(p) for p in exclude)
    if include:
        keep = keep & any_of(hit(p) for p in include)
    return files.filter(keep)


def convertible(files: DataFrame) -> DataFrame:
    return files.filter(F.lower(P.extname(F.col("path"))).isin(".html", ".htm", ".xml"))


def input_kind(ext: Column) -> Column:
    return F.when(ext.isin("docx", "doc"), "word").when(ext == "xml", "madcap").otherwise("html")


def decode_upload(uploads: DataFrame) -> DataFrame:
    """``content`` decoded from base64 where ``is_base64`` is set."""
    plain = F.decode(F.try_to_binary("content", F.lit("base64")), "UTF-8")
    return uploads.withColumn("content", F.when(F.col("is_base64"), plain).otherwise(F.col("content")))


def infer_layout(name: Column) -> Column:
    """Place of a bare file name in the standard project layout."""
    low, ext = F.lower(name), F.lower(F.substring_index(name, ".", -1))

    def under(folder):
        return F.concat(F.lit(folder), name)

    def has(*words):
        return contains_any(low, words)

    image = (
        F.when(has("icon", "button"), under("Content/Images/Icons/"))
        .when(has("screen", "capture"), under("Content/Images/Screens/"))
        .when(has("logo", "header"), under("Content/Images/Branding/"))
        .otherwise(under("Content/Images/"))
    )
    topic = (
        F.when(has("admin"), under("Content/Admin/"))
        .when(has("guide", "tutorial"), under("Content/Guides/"))
        .when(has("api", "reference"), under("Content/Reference/"))
        .when(has("install", "setup"), under("Content/Installation/"))
        .otherwise(under("Content/"))
    )
    return (
        F.when(ext.isin(IMAGES), image)
        .when(ext == "flsnp", under("Content/Resources/Snippets/"))
        .when(ext == "flvar", under("Project/VariableSets/"))
        .when(ext == "fltoc", under("Project/TOCs/"))
        .when(ext == "flpgl", under("Content/Resources/PageLayouts/"))
        .when(ext == "css", under("Content/Resources/Stylesheets/"))
        .when(ext.isin("html", "htm"), topic)
        .when(ext == "xml", under("Project/"))
        .when(ext.isin("md", "txt", "json"), name)
        .otherwise(under("Content/"))
    )


# --- discovery --------------------------------------------------------------
def _first_class(files: DataFrame, rank: Column) -> DataFrame:
    """Keep the files of the best (lowest) source class found in the corpus."""
    ranked = files.withColumn("_class", rank)
    best = ranked.agg(F.min("_class").alias("_best"))
    # one row by construction, so the broadcast is bounded
    return ranked.join(F.broadcast(best), F.col("_class") == F.col("_best")).drop("_class", "_best")


def variable_files(files: DataFrame, mode: str = "project", roots: list[str] | None = None) -> DataFrame:
    """Variable-set files.

    ``project``: those of the project folder, only without any there those elsewhere, hidden
    folders left out. ``folders``: all of the corpus, each once, with ``place``: the number
    of the known folder that it is in, after these for the rest. ``nested``: those of the
    project folder of this and any nested project, and all below one of ``roots``.
    """
    path, name = F.col("path"), P.basename(F.col("path"))
    found = files.filter(F.lower(P.extname(path)).isin(".flvar") & ~name.startswith("._"))
    if mode == "project":
        hidden = F.exists(P.segments(path), lambda s: s.startswith("."))
        return _first_class(
            found.filter(~hidden), F.when(path.rlike(r"^Project/VariableSets/[^/]+\z"), 0).otherwise(1)
        )
    if mode == "folders":
        place = F.lit(len(VARIABLE_DIRS))
        for i, folder in reversed(list(enumerate(VARIABLE_DIRS))):
            place = F.when(path.startswith(folder + "/"), i).otherwise(place)
        return found.withColumn("place", place).dropDuplicates(["path"])
    if mode == "nested":
        kept = path.rlike(r"(^|/)Project/VariableSets/[^/]+\z")
        for root in roots or []:
            kept = kept | path.startswith(root.rstrip("/") + "/")
        return found.filter(kept).dropDuplicates(["path"])
    raise ValueError(f"unknown discovery mode: {mode}")


def keep_toc(name: Column) -> Column:
    """TOC name policy: deny words win, then allow words or exact names."""
    low = F.lower(name)
    return ~contains_any(low, TOC_DENY) & (contains_any(low, TOC_ALLOW) | low.isin(TOC_NAMES))


def toc_class(path: Column) -> Column:
    """0 for a TOC in a standard folder, 1 for one elsewhere, null for other files."""
    hidden = F.exists(folder_segments(path), lambda s: s.startswith(".") | s.isin("node_modules", "Temporary"))
    found = F.lower(path).endswith(".fltoc") & keep_toc(P.basename(path))
    standard = any_of(path.startswith(d + "/") for d in TOC_DIRS)
    return F.when(found & standard, 0).when(found & ~hidden, 1)


def side_files(files: DataFrame, kind: str, upload: bool = False) -> DataFrame:
    """Glossary or TOC files by folder policy."""
    path = F.col("path")
    parts = folder_segments(path)
    if kind == "glossary":
        hidden = F.exists(
            P.segments(path), lambda s: s.startswith("._") | s.startswith(".git") | (s == "node_modules")
        )
        known = F.lit(True)
        if not upload:
            # the first level is always entered, deeper levels only by name
            known = ~F.exists(F.slice(parts, F.lit(2), F.size(parts)), lambda s: ~s.isin(GLOSSARY_DIRS))
        return files.filter(path.endswith(".flglo") & ~hidden & known)
    if kind == "toc":
        return _first_class(files.filter(toc_class(path).isNotNull()), toc_class(path))
    raise ValueError(f"unknown side file kind: {kind}")


# --- file predicates --------------------------------------------------------
def binary_reason(content: Column, ext: Column, size: Column, max_bytes: int | None = None) -> Column:
    """Why a file is not text; null for text. ``ext`` has no dot.

    The whole content is looked at. ``max_bytes`` calls larger files binary unread; by
    default size says nothing.
    """
    control = F.regexp_count(content, F.lit(r"[\x00-\x08\x0b\x0e-\x1f]"))
    ratio = F.try_divide(control.cast("double"), F.length(content).cast("double"))
    too_large = F.lit(False) if max_bytes is None else size > max_bytes
    return (
        F.when(ext.isin("xml", "html", "htm", "flglo", "flvar", "fltoc", "flsnp", "svg"), None)
        .when(ext.isin("png", "jpg", "jpeg", "gif", "bmp", "webp"), "Image file - will be copied as resource")
        .when(
            too_large,
            F.concat(
                F.lit("File too large ("),
                F.format_string("%.1f", size / F.lit(1048576.0)),
                F.lit("MB) - likely contains embedded media"),
            ),
        )
        .when(contains_any(content, MEDIA_MARKS), "Contains embedded multimedia data")
        .when(
            F.coalesce(ratio > 0.1, F.lit(False)),
            F.concat(
                F.lit("Contains binary data ("),
                F.format_string("%.1f", ratio * 100),
                F.lit("% non-printable)"),
            ),
        )
    )


def excluded_dir_reason(path: Column) -> Column:
    """Reason an upload path is left out; null when it is kept."""
    hit = F.get(
        F.filter(
            P.segments(path), lambda s: s.isin(UPLOAD_EXCLUDED_DIRS) | F.lower(s).isin(UPLOAD_EXCLUDED_DIRS)
        ),
        F.lit(0),
    )
    return F.concat(
        F.lit("Contains excluded directory: "), hit, F.lit(" (MadCap output/temporary folder)")
    )


def resource_exclusion(directory: Column) -> Column:
    """Reason a resource folder is not copied; null when it is."""
    low = F.lower(directory)
    reason = F.lit(None).cast("string")
    for word, text in reversed(RESOURCE_DIRS):
        hit = low.contains("/" + word) | (P.basename(low) == word)
        reason = F.when(hit, F.lit(text)).otherwise(reason)
    return reason


def _explode_findings(df: DataFrame, keys, findings: Column) -> DataFrame:
    return df.select(*keys, F.inline(findings))


def _finding(test: Column, level: str, message) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.when(test, F.struct(F.lit(level).alias("type"), text.alias("message")))


def lint_paths(files: DataFrame) -> DataFrame:
    """Path findings, one row each: ``path, type, message``. ``size`` is optional."""
    path = F.col("path")
    shown, ext = trim_ws(path), F.lower(P.extname(trim_ws(path)))
    full = shown != ""
    items = [
        _finding(~full, "error", "File path cannot be empty"),
        _finding(
            F.length(shown) > MAX_PATH,
            "error",
            F.concat(
                F.lit("Path too long ("), F.length(shown).cast("string"),
                F.lit(f" chars). Maximum allowed: {MAX_PATH}"),
            ),
        ),
        _finding(shown.contains(".."), "error", 'Path traversal not allowed (contains "..")'),
        _finding(shown.contains("\u0000"), "error", "Path contains null bytes"),
    ]
    if "size" in files.columns:
        items.append(
            _finding(
                full & (F.col("size") > MAX_FILE),
                "error",
                F.concat(
                    F.lit("File too large ("), format_bytes(F.col("size")), F.lit("). Maximum allowed: 100 MB")
                ),
            )
        )
    items.append(
        _finding(
            full & (ext != "") & ~ext.isin(LINT_FORMATS),
            "warning",
            F.concat(
                F.lit("Unsupported file extension '"), ext,
                F.lit("'. Supported: " + ", ".join(LINT_FORMATS)),
            ),
        )
    )
    return _explode_findings(files, ["path"], compact(*items))


def lint_content(files: DataFrame, kind: str = "html") -> DataFrame:
    """Content findings, one row each: ``path, type, message``."""
    text = F.coalesce(F.col("content"), F.lit(""))
    items = [
        _finding(text == "", "error", "Input content cannot be empty"),
        _finding(F.length(text) > MAX_CONTENT, "error", "Input content too large (>50MB)"),
    ]
    if kind == "html":
        items.append(
            _finding(
                (text != "") & ~text.contains("<") & ~text.contains(">"),
                "warning",
                "Input does not appear to contain HTML tags",
            )
        )
    return _explode_findings(files, ["path"], compact(*items))


# --- sinks ------------------------------------------------------------------
def write_outputs(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Write the sink set.

    ``topics`` (with ``format``) goes to parquet partitioned by format. Tables that
    carry ``sort_key`` and ``line`` become text in sort order, range-partitioned so
    no task holds a whole document. The rest goes to parquet.
    """
    for name, df in tables.items():
        target = f"{folder.rstrip('/')}/{name}"
        if "line" in df.columns and "sort_key" in df.columns:
            df.orderBy("sort_key").select(F.col("line").alias("value")).write.mode(mode).text(target)
        elif "format" in df.columns:
            df.write.mode(mode).partitionBy("format").parquet(target)
        else:
            df.write.mode(mode).parquet(target)


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
