"""Image references: extraction, lookup, targets, kinds; snippet lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import paths as P
from docweft.functions.text import all_matches, any_of, contains_any
from docweft.operators.conditions import attribute
from docweft.operators.lines import lines_with_context
from docweft.operators.links import first_existing
from docweft.session import cut

# --- fixed values -----------------------------------------------------------
ICON_DIR = r"(?i)/(GUI|Icon|Button)"
HELP_ICON_PARTS = ["icon", "GUI-Elemente/", "symbol_", "_XX", "XX_"]
HELP_ICON_LIMIT = 36
INLINE_LIMIT = 32
# Parts of a path that lead to the shared image folder, longest first.
IMAGE_FOLDERS = ["content/resources/images/", "resources/images/", "images/"]
# ---------------------------------------------------------------------------


def image_tags(html: Column) -> Column:
    return all_matches(html, r"(?i)<img\s[^<>]*>", 0)


def image_refs(topics: DataFrame) -> DataFrame:
    """``path, pos, src`` of every image that is not a data URI."""
    sources = all_matches(F.col("html"), r"(?i)<img\s+[^>]*src=[\"']([^\"']+)[\"'][^>]*>")
    rows = topics.select("path", F.posexplode(sources).alias("pos", "src"))
    return rows.filter(~F.col("src").startswith("data:"))


def _under(root: str, *parts) -> Column:
    pieces = [F.lit(root.rstrip("/") + "/")] if root else []
    return P.normalize(F.concat(*pieces, *parts))


def resolve_images(refs: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """Add ``found``: the first of eight places, then any file of that name.

    Distinct (folder, source) pairs are looked up, so a logo on every page costs one
    lookup per folder.
    """
    src, folder = F.col("src"), F.col("dir")
    clean = F.regexp_replace(src, r"^\.\./", "")
    name = P.basename(src)
    first_images = F.when(
        clean.contains("Images/"),
        F.concat(
            F.substr(clean, F.lit(1), F.locate("Images/", clean) - 1), F.substr(clean, F.locate("Images/", clean) + 7)
        ),
    ).otherwise(clean)
    places = F.array_distinct(
        F.array(
            _under(root, clean),
            _under(root, F.lit("Resources/"), clean),
            _under(root, F.lit("Resources/"), first_images),
            F.when(src.startswith("/"), P.normalize(src)).otherwise(P.join_path(folder, src)),
            _under(root, F.lit("Images/"), name),
            _under(root, F.lit("Resources/Images/"), name),
            _under(root, F.regexp_replace(clean, "^Images/", "Resources/Images/")),
        )
    )
    rows = cut(refs.withColumn("dir", P.dirname(F.col("path"))))  # texts are parsed once
    local = rows.filter(~src.startswith("http"))
    keys = local.select("dir", "src").distinct()
    direct = first_existing(keys, places, files, ["dir", "src"])
    by_name = (
        files.filter(F.lower(P.extname(F.col("path"))).isin(P.IMAGE_EXTENSIONS))
        .groupBy(P.basename(F.col("path")).alias("name"))
        .agg(F.min("path").alias("by_name"))
    )
    found = (
        keys.join(direct, ["dir", "src"], "left").withColumn("name", name).join(by_name, "name", "left")
        .select("dir", "src", F.coalesce("found", "by_name").alias("found"))
    )
    return rows.join(found, ["dir", "src"], "left").drop("dir")


def resolve_snippets(refs: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """Add ``found`` to snippet references ``path, src``."""
    src, folder = F.col("src"), F.col("dir")
    clean = F.regexp_replace(src, r"^(\.\./)+", "")
    slashed = F.replace(clean, F.lit("\\"), F.lit("/"))
    inside = F.substr(slashed, F.greatest(F.locate("Resources/Snippets/", slashed), F.lit(1)))
    base = F.regexp_replace(clean, r"^(Resources[/\\])?Snippets[/\\]", "")
    places = F.array_compact(
        F.array(
            F.when(slashed.contains("Resources/Snippets/"), _under(root, F.lit("Content/"), inside)),
            _under(root, F.lit("Content/Resources/Snippets/"), base),
            F.when(src.rlike(r"^\.\.[/\\]"), P.join_path(folder, src)),
            src,
        )
    )
    rows = cut(refs.withColumn("dir", P.dirname(F.col("path"))))  # texts are parsed once
    keys = rows.select("dir", "src").distinct()
    found = first_existing(keys, places, files, ["dir", "src"])
    return rows.join(found, ["dir", "src"], "left").drop("dir")


def missing_images(refs: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    return resolve_images(refs, files, root).filter(F.col("found").isNull() & ~F.col("src").startswith("http"))


# --- targets ----------------------------------------------------------------
def image_target(src: Column) -> Column:
    """Place in the shared image folder; null when the reference is kept as is."""
    path = F.replace(src, F.lit("\\"), F.lit("/"))
    low = F.lower(path)
    result = F.lit(None).cast("string")
    for part in reversed(IMAGE_FOLDERS):
        inner = F.substr(path, F.locate(part, low) + len(part))
        result = F.when(low.contains(part), F.concat(F.lit("Images/"), inner)).otherwise(result)
    return result


def image_targets(refs: DataFrame) -> DataFrame:
    kept = P.resolve_from(F.col("path"), F.col("src"))
    return refs.select("*", F.coalesce(image_target(F.col("src")), kept).alias("target"))


def image_clashes(files: DataFrame) -> DataFrame:
    """Image names found in several folders: count, and the copy that is kept."""
    images = files.filter(F.lower(P.extname(F.col("path"))).isin(P.IMAGE_EXTENSIONS))
    return (
        images.groupBy(P.basename(F.col("path")).alias("name"))
        .agg(F.count("*").alias("copies"), F.min("path").alias("kept"))
        .filter(F.col("copies") > 1)
    )


# --- kinds ------------------------------------------------------------------
def _size(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*[\"']\s*(\d+)", 1), F.lit("")).cast("int")


def _style_size(tag: Column, name: str) -> Column:
    style = attribute(tag, "style")
    return F.nullif(F.regexp_extract(style, rf"{name}:\s*(\d+)px", 1), F.lit("")).cast("int")


def _both_at_most(w: Column, h: Column, limit: int) -> Column:
    return F.coalesce((w <= limit) & (h <= limit), F.lit(False))


def image_kind(tag: Column) -> Column:
    """``inline`` or ``block`` for an image tag."""
    src, css = attribute(tag, "src"), attribute(tag, "class")
    small = _both_at_most(_size(tag, "width"), _size(tag, "height"), INLINE_LIMIT)
    small_style = _both_at_most(_style_size(tag, "width"), _style_size(tag, "height"), INLINE_LIMIT)
    icon = src.rlike(ICON_DIR) | src.rlike(r"(?i)\.(ico|icon)") | src.contains("GUI-Elemente")
    return (
        F.when(css.contains("IconInline"), "inline")
        .when(P.is_screenshot(src), "block")
        .when(icon | small | small_style, "inline")
        .otherwise("block")
    )


def image_class(tag: Column) -> Column:
    """Help-center class: icon, large or default."""
    src, css = attribute(tag, "src"), attribute(tag, "class")
    w, h = F.coalesce(_size(tag, "width"), F.lit(0)), F.coalesce(_size(tag, "height"), F.lit(0))
    small = w.between(1, HELP_ICON_LIMIT) | h.between(1, HELP_ICON_LIMIT)
    return (
        F.when(css.contains("icon") | contains_any(src, HELP_ICON_PARTS) | small, "icon")
        .when(src.contains("Screens/") | css.contains("screenshot"), "large")
        .otherwise("default")
    )


def image_kind_context(topics: DataFrame, text: str = "text") -> DataFrame:
    """``path, line_no, src, kind`` of image macros that stand on a line of their own.

    Neighbour lines come from the same row, see :func:`lines_with_context`.
    """
    rows = lines_with_context(topics, text, ahead=1)
    image = r"^(\s*)(image:+)([^\[]+)(\[.*\])\z"
    rows = rows.filter(F.col("line").rlike(image))
    src = F.regexp_extract("line", image, 3)
    attrs = F.regexp_extract("line", image, 4)
    low = F.lower(src)

    def number(name):
        return F.nullif(F.regexp_extract(attrs, rf"{name}=([0-9]+)", 1), F.lit("")).cast("int")

    before, after = F.trim(F.coalesce("prev", F.lit(""))), F.trim(F.coalesce("next1", F.lit("")))
    w, h = number("width"), number("height")
    icon = low.contains("icon") | low.contains("button") | low.contains("/gui/")
    screen = low.contains("screen")
    small = contains_any(low, ["small", "thumb", "icon"])
    in_list = any_of(c.rlike(r"^\s*[.*]\s+") for c in [F.col("line"), F.coalesce("prev", F.lit(""))])
    alone = (before == "") | before.endswith("+") | (after == "") | after.startswith("=")
    follows = (F.length(before) > 20) & ~before.endswith("+") & ~before.startswith(".")
    yes, no = F.lit("inline"), F.lit("block")

    def at_most(c, limit):
        return F.coalesce(c <= limit, F.lit(False))

    set_w, set_h = F.coalesce(w > 0, F.lit(False)), F.coalesce(h > 0, F.lit(False))
    kind = (
        F.when(attrs.contains("role=icon"), yes)
        .when(icon & ~screen, yes)
        .when(set_w & set_h & at_most(w, INLINE_LIMIT) & at_most(h, INLINE_LIMIT), yes)
        .when(small & (~set_w | at_most(w, 48)), yes)
        .when(screen, no)
        .when(F.coalesce(w > 100, F.lit(False)), no)
        .when(alone & ~follows, no)
        .when(in_list & ~alone, yes)
        .when(follows & set_w & at_most(w, 64), yes)
        .otherwise(no)
    )
    return rows.select("path", "line_no", src.alias("src"), kind.alias("kind"))
