"""Aggregations over runs and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import paths as P
from docweft.functions.text import compact, is_blank
from docweft.operators.conditions import sample_conditions
from docweft.sources.corpus import (
    IMAGES,
    SUPPORTED,
    excluded_dir,
    folder_segments,
    junk_name,
    toc_class,
    with_file_parts,
)

# --- fixed values -----------------------------------------------------------
COMMON_DIRS = ["Content", "Content/Images", "Content/Resources", "Project", "Resources"]
CONTENT = ["html", "htm"]
NO_EXTENSION = "no-extension"
NO_GLOSSARY = (
    "No .flglo (MadCap glossary) files found in uploaded project. Glossary will be empty unless you include "
    "Project/Glossaries/*.flglo or set asciidocOptions.glossaryOptions.glossaryPath."
)
NO_VARIABLES = (
    "No .flvar (MadCap variables) files found in uploaded project. Variables file will be empty unless you include "
    "Project/VariableSets/*.flvar or set variableOptions.flvarFiles."
)
NO_CONTENT_DIR = "Content directory not found. This may indicate an incomplete MadCap project upload."
MOSTLY_OUTPUT = (
    "Upload appears to contain mostly output/temporary files. Consider uploading the source project instead."
)
NO_RESOURCES = "No Resources directories found. Snippets, variables, and multimedia may not be processed."
# ---------------------------------------------------------------------------


def kept_by_scan(path: Column) -> Column:
    """The path passes the folder and name filters of the corpus scan."""
    return ~F.exists(folder_segments(path), excluded_dir) & ~junk_name(P.basename(path))


def folder_stats(files: DataFrame) -> DataFrame:
    """Files per extension and, with a null extension, the totals with the supported count."""
    ext = F.lower(F.substr(P.extname(F.col("path")), F.lit(2)))
    rows = files.select(
        F.when(ext == "", NO_EXTENSION).otherwise(ext).alias("ext"),
        (ext.isin(SUPPORTED) & kept_by_scan(F.col("path"))).alias("supported"),
    )
    return rows.rollup("ext").agg(F.count("*").alias("files"), F.count_if("supported").alias("supported"))


def _seen(files: DataFrame) -> DataFrame:
    """Files outside hidden and excluded folders."""
    path = F.col("path")
    hidden = F.exists(P.segments(path), lambda s: s.startswith("."))
    return with_file_parts(files.filter(~F.exists(folder_segments(path), excluded_dir) & ~hidden))


def structure_analysis(files: DataFrame) -> DataFrame:
    """One row of file counts by role."""
    ext = F.col("ext")
    known = ext.isin(SUPPORTED)
    return _seen(files).agg(
        F.count("*").alias("total_files"),
        F.count_if(known).alias("supported_files"),
        F.count_if(ext == "flsnp").alias("snippet_files"),
        F.count_if(ext.isin(CONTENT)).alias("content_files"),
        F.count_if(~known & ext.isin(IMAGES)).alias("image_files"),
        F.count_if(~known & ~ext.isin(IMAGES)).alias("other_files"),
    )


def found_snippets(files: DataFrame) -> DataFrame:
    return _seen(files).filter(F.col("ext") == "flsnp").select("path")


def _prefixes(path: Column) -> Column:
    """Every folder on the way to a file, with its own name last."""
    parts = folder_segments(path)
    steps = F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)))
    return F.when(
        F.size(parts) > 0,
        F.transform(
            steps,
            lambda n: F.struct(
                F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir"), F.get(parts, n - 1).alias("name")
            ),
        ),
    ).otherwise(F.array().cast("array<struct<dir:string,name:string>>"))


def excluded_folders(files: DataFrame) -> DataFrame:
    """Folders the scan does not enter (topmost ones)."""
    hits = F.filter(_prefixes(F.col("path")), lambda d: excluded_dir(d["name"]))
    return files.select(F.get(hits, F.lit(0))["dir"].alias("dir")).filter(F.col("dir").isNotNull()).distinct()


def missing_folders(files: DataFrame) -> DataFrame:
    """Expected folders that hold no file: an anti join from five fixed names."""
    spark = files.sparkSession
    expected = spark.createDataFrame([(d,) for d in COMMON_DIRS], "dir string")
    present = (
        files.select(F.explode(_prefixes(F.col("path"))).alias("d"))
        .select(F.col("d.dir").alias("dir"))
        .filter(F.col("dir").isin(COMMON_DIRS))
        .distinct()
    )
    return expected.join(present, "dir", "left_anti")


def preflight(files: DataFrame) -> DataFrame:
    """Warnings about an incomplete project, one row each, from one pass of counts."""
    path = F.col("path")
    first_bad = F.exists(folder_segments(path), excluded_dir)

    def under(folder):
        return F.count_if(path.startswith(folder + "/"))

    ext = F.lower(P.extname(path))
    counts = files.agg(
        F.count_if(ext == ".flglo").alias("glossaries"),
        F.count_if(ext == ".flvar").alias("variables"),
        under("Content").alias("content"),
        under("Content/Images").alias("content_images"),
        under("Content/Resources").alias("content_resources"),
        under("Resources").alias("resources"),
        F.count_if(first_bad).alias("excluded"),
        F.count_if(~first_bad & ext.isin(".html", ".htm")).alias("topics"),
    )
    warnings = compact(
        F.when(F.col("glossaries") == 0, F.lit(NO_GLOSSARY)),
        F.when(F.col("variables") == 0, F.lit(NO_VARIABLES)),
        F.when(F.col("content") == 0, F.lit(NO_CONTENT_DIR)),
        F.when((F.col("excluded") > 0) & (F.col("topics") < 5), F.lit(MOSTLY_OUTPUT)),
        F.when((F.col("content_resources") == 0) & (F.col("resources") == 0), F.lit(NO_RESOURCES)),
    )
    return counts.select(F.posexplode(warnings).alias("ord", "warning"))


def run_outcome(results: DataFrame) -> DataFrame:
    """``status`` in converted, error, other: skipped is what is left of the total."""
    counts = results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "converted").alias("converted"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
    return counts.select("*", (F.col("total") - F.col("converted") - F.col("errors")).alias("skipped"))


def merge_outcomes(parts: DataFrame) -> DataFrame:
    """Outcomes of several runs added up."""
    names = ["total", "converted", "errors", "skipped"]
    return parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def image_files(files: DataFrame) -> DataFrame:
    return _seen(files).filter(F.col("ext").isin(IMAGES)).select("path", "dir", "depth")


def image_folders(files: DataFrame, depth: int | None = None) -> DataFrame:
    """Folders that hold an image; with ``depth`` only those down to it."""
    found = image_files(files)
    return (found if depth is None else found.filter(F.col("depth") <= depth)).select("dir").distinct()


def project_inventory(files: DataFrame) -> DataFrame:
    """Counts of topics, snippets, variable sets and TOCs."""
    rows = with_file_parts(files)
    ext = F.col("ext")
    counts = rows.agg(
        F.count_if(ext.isin(CONTENT) & ~F.contains("path", F.lit("/_"))).alias("topics"),
        F.count_if(ext == "flsnp").alias("snippets"),
        F.count_if(ext == "flvar").alias("variable_sets"),
        F.count_if(toc_class(F.col("path")) == 0).alias("standard"),
        F.count_if(toc_class(F.col("path")) == 1).alias("elsewhere"),
    )
    tocs = F.when(F.col("standard") > 0, F.col("standard")).otherwise(F.col("elsewhere"))
    return counts.withColumn("tocs", tocs).drop("standard", "elsewhere")


def project_conditions(topics: DataFrame, n: int | None = None) -> DataFrame:
    """Tags seen in topics whose name does not start with ``_``, in the first ``n`` of them if given."""
    kept = topics.filter(~F.contains("path", F.lit("/_")))
    return sample_conditions(kept, n).filter(~is_blank(F.col("condition")))
