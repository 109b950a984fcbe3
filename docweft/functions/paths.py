"""Column functions over slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweft.functions.text import any_of, compact, contains_any, decode_url, title_case, trim_ws

# --- fixed values -----------------------------------------------------------
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".bmp"]
DOCUMENT_EXTENSIONS = [".md", ".adoc", ".html", ".htm"]
EXTERNAL_SCHEMES = ["http://", "https://", "ftp://", "mailto:"]
OUTPUT_EXTENSION = {"asciidoc": ".adoc", "help-center": ".html", "markdown": ".md", "writerside": ".md"}
SCREENSHOT_DIR = r"(?i)/(Screens|Screenshots)"
# Path cleaning rules in order: pattern, replacement, name.
PATH_RULES = [
    (r"\\", "/", "normalize-path-separators"),
    (r"/+", "/", "remove-duplicate-slashes"),
    (r"^\./+", "", "remove-current-dir-prefix"),
    (r"^/Images/", "../Images/", "normalize-absolute-images-path"),
    (r"^\.\./\.\./Images/", "../Images/", "normalize-deeply-nested-images-path"),
]
# ---------------------------------------------------------------------------


def basename(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/]*)/*\z", 1)


def dirname(p: Column) -> Column:
    """Folder part; ``.`` for a bare name."""
    head = F.regexp_extract(p, r"^(.*)/[^/]*\z", 1)
    return (
        F.when(~p.contains("/"), F.lit("."))
        .when(head == "", F.lit("/"))
        .otherwise(head)
    )


def extname(p: Column) -> Column:
    """Last extension with its dot, empty when there is none."""
    return F.regexp_extract(p, r"[^/](\.[^./]*)\z", 1)


def stem(p: Column) -> Column:
    return F.regexp_replace(basename(p), r"(?<=.)\.[^./]*\z", "")


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


def path_depth(relative: Column) -> Column:
    """Folders above a relative path."""
    folder = dirname(relative)
    return F.when(folder == ".", F.lit(0)).otherwise(F.size(segments(folder)))


def normalize(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments. Segment lists are short."""
    absolute = p.startswith("/")

    def step(acc, seg):
        last = F.try_element_at(acc, F.lit(-1))
        up = (seg == "..") & F.coalesce(last != "..", F.lit(False))
        return (
            F.when((seg == "") | (seg == "."), acc)
            .when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when((seg == "..") & absolute, acc)
            .otherwise(F.concat(acc, F.array(seg)))
        )

    folded = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(folded, "/")
    return (
        F.when(absolute, F.concat(F.lit("/"), joined))
        .when(joined == "", F.lit("."))
        .otherwise(joined)
    )


def join_path(folder: Column, p: Column) -> Column:
    """Join and normalize."""
    return normalize(F.concat(folder, F.lit("/"), p))


def resolve_from(source: Column, target: Column) -> Column:
    """Target resolved against the folder of the source file."""
    return F.when(target.startswith("/"), normalize(target)).otherwise(join_path(dirname(source), target))


def relative_path(frm: Column, to: Column, anchor: Column | None = None) -> Column:
    """Path of ``to`` as written inside file ``frm``."""
    a = F.filter(F.split(dirname(frm), "/"), lambda s: (s != "") & (s != "."))
    b = F.filter(F.split(to, "/"), lambda s: (s != "") & (s != "."))
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_difference = F.array_position(same, F.lit(False)).cast("int")
    common = F.when(first_difference == 0, F.least(F.size(a), F.size(b))).otherwise(first_difference - 1)
    ups = F.array_repeat(F.lit(".."), F.size(a) - common)
    rest = F.slice(b, common + 1, F.greatest(F.size(b) - common, F.lit(0)))
    path = F.array_join(F.concat(ups, rest), "/")
    if anchor is None:
        return path
    return F.when(F.coalesce(anchor, F.lit("")) != "", F.concat(path, F.lit("#"), anchor)).otherwise(path)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^([^#]*)", 1)


def url_anchor(url: Column) -> Column:
    """Text between the first and the second ``#``; null without one."""
    return F.nullif(F.regexp_extract(url, r"^[^#]*#([^#]*)", 1), F.lit(""))


def link_type(url: Column) -> Column:
    ext = F.lower(extname(url_path(url)))
    return (
        F.when(url.startswith("#"), "anchor")
        .when(any_of(url.startswith(s) for s in EXTERNAL_SCHEMES), "external")
        .when(ext.isin(IMAGE_EXTENSIONS), "image")
        .when(ext.isin(DOCUMENT_EXTENSIONS) | (ext == ""), "internal")
        .otherwise("unknown")
    )


def valid_external(url: Column) -> Column:
    """Well-formed absolute URL: a scheme, and for web schemes a host."""
    web = url.rlike(r"^(?i)(https?|ftp)://")
    return F.when(web, url.rlike(r"^(?i)(https?|ftp)://[^\s/?#<>\[\]^|%]+")).otherwise(
        url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    )


def skip_rewrite(url: Column) -> Column:
    """Links no rewrite touches."""
    return url.startswith("http") | url.startswith("mailto:") | url.startswith("#")


def swap_ext(url: Column, ext: str = ".html") -> Column:
    """``.htm`` and ``.html`` before the anchor or the end become ``ext``."""
    return F.regexp_replace(url, r"(?i)\.html?(?=#|\z)", ext)


def alt_text(src: Column) -> Column:
    name = F.regexp_extract(src, r"([^/]*)\z", 1)
    shown = title_case(F.regexp_replace(F.regexp_replace(name, r"\.[^/.]+\z", ""), "[-_]", " "))
    return F.when(F.length(shown) > 1, shown).otherwise(name)


def is_screenshot(src: Column, words=()) -> Column:
    """Images of a screenshot folder; ``words`` are parts of names that tell one as well."""
    shown = src.rlike(SCREENSHOT_DIR)
    return shown | contains_any(src, list(words)) if words else shown


def path_type(p: Column) -> Column:
    return (
        F.when(p.startswith("http://") | p.startswith("https://"), "url")
        .when(p.startswith("/") | p.rlike("^[a-zA-Z]:"), "absolute")
        .when(p.startswith("./") | p.startswith("../") | ~p.contains("/"), "relative")
        .otherwise("unknown")
    )


def apply_path_rules(p: Column, rules=None) -> tuple[Column, Column]:
    """Fold (pattern, replacement, name) rules; gives the path and the rule names used."""
    fired = []
    for pattern, replacement, name in rules or PATH_RULES:
        after = F.regexp_replace(p, pattern, replacement)
        fired.append(F.when(after != p, F.lit(name)))
        p = after
    return p, compact(*fired)


def clean_path(p: Column) -> Column:
    return decode_url(F.replace(trim_ws(p), F.lit("\\"), F.lit("/")))


def image_path(p: Column, depth: Column | None = None, style: str = "depth") -> Column:
    """Image path as written in the output: by depth, legacy, TOC or second target."""
    if style == "depth":
        keep = p.startswith("http") | p.startswith("/") | (F.regexp_count(p, F.lit(r"\.\./")) == depth)
        bare = F.regexp_replace(p, r"^(\.\./)+", "")
        return F.when(keep, p).otherwise(F.concat(F.repeat(F.lit("../"), depth), bare))
    if style == "legacy":
        inner = F.concat(F.lit("../"), F.substr(p, F.locate("/Images/", p) + 1))
        return (
            F.when(p.contains("/Images/"), inner)
            .when(p.startswith("Images/"), F.concat(F.lit("../"), p))
            .otherwise(p)
        )
    if style == "toc":
        ups = F.regexp_count(p, F.lit(r"\.\./"))
        bare = F.regexp_replace(p, r"^(\.\./)+", "")
        return (
            F.when(p.startswith("data:") | p.startswith("http"), p)
            .when(p.startswith("../") & (ups > 1) & bare.startswith("Images/"), F.concat(F.lit("../"), bare))
            .when(p.startswith("user/Images/"), F.concat(F.lit("../"), F.substr(p, F.lit(6))))
            .otherwise(p)
        )
    if style == "writerside":
        bare = F.regexp_replace(F.regexp_replace(p, "^/+", ""), r"^(\.\./)+", "")
        bare = F.regexp_replace(bare, r"^\./", "")
        resources = r"(?i)^(Content/)?Resources/Images/"
        return (
            F.when(p.rlike(r"^(https?://|data:)"), p)
            .when(bare.startswith("images/Images/"), F.concat(F.lit("../"), bare))
            .when(
                bare.startswith("images/") & ~bare.contains("/Images/"),
                F.concat(F.lit("../images/Images/"), F.substr(bare, F.lit(8))),
            )
            .when(bare.rlike("(?i)^Images/"), F.concat(F.lit("../images/"), bare))
            .when(
                bare.rlike(resources),
                F.concat(F.lit("../images/Images/"), F.regexp_replace(bare, resources, "")),
            )
            .otherwise(F.concat(F.lit("../images/Images/"), bare))
        )
    raise ValueError(f"unknown image path style: {style}")


def writerside_link(href: Column) -> Column:
    """Topic link as the second target writes it."""
    path = url_path(href)
    suffix = F.coalesce(F.concat(F.lit("#"), url_anchor(href)), F.lit(""))
    md = F.regexp_replace(path, r"(?i)\.html?\z", ".md")
    dashed = F.regexp_replace(md, r"\s+", "-")
    local = F.regexp_replace(F.regexp_replace(md, r"^\./", ""), r"\s+", "-")
    deep = F.regexp_replace(F.regexp_replace(md, "^/+", ""), "(?i)^Content/", "")
    deep = F.regexp_replace(F.regexp_replace(deep, r"\s+", "-"), r"[^a-zA-Z0-9\-_/.]", "")
    deep = F.regexp_replace(F.regexp_replace(deep, "/-", "-"), "-/", "-")
    return (
        F.when(href.rlike(r"^(https?://|mailto:|#)"), href)
        .when(path.startswith("../"), F.concat(dashed, suffix))
        .when(~md.contains("/") | md.startswith("./"), F.concat(local, suffix))
        .otherwise(F.concat(deep, suffix))
    )
