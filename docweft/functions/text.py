"""Column functions over topic text and markup.

All of them are built-in expressions, so they stay inside the scan's stage and
need no shuffle. White space follows the ECMAScript definition, which is wider
than Java's ``\\s``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# White space as ECMAScript defines it.
SPACE = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NOT_SPACE = r"[^\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
# The same characters listed, for trimming without a pattern.
SPACE_CHARS = (
    " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Word boundary over ASCII word characters.
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"
# Substrings that mark a topic as coming from the authoring tool.
AUTHORING_MARKS = ["MadCap:", "madcap:", "xmlns:MadCap", "data-mc-", "mc-variable", "mc-"]
# Review warnings by markup presence.
REVIEW_CONDITIONS = "Original content contains conditional text that may need manual review"
REVIEW_SNIPPETS = "Original content contains snippets - verify all content was included"
REVIEW_VARIABLES = "Original content contains variables - verify proper substitution"
REVIEW_DROPDOWNS = "MadCap dropdowns converted to sections - verify structure is acceptable"
REVIEW_DROPDOWNS_HELP_CENTER = (
    "MadCap dropdowns converted to collapsible sections - verify functionality in Zendesk"
)
REVIEW_LOSS = "Some content was removed during HTML sanitization for Zendesk compatibility"
# Content tags: words in the visible text and the tag they give.
TAG_WORDS = [
    (["install", "setup"], "installation"),
    (["error", "problem"], "troubleshooting"),
    (["admin", "administrator"], "administration"),
    (["user", "guide"], "user-guide"),
    (["tutorial", "how-to"], "tutorial"),
    (["config", "setting"], "configuration"),
]
# Step-text patterns.
EXPLANATORY = [
    r"^the .+ (is|are) displayed",
    r"^a .+ (is|are) (displayed|shown)",
    r"^this (opens|displays|shows)",
    r"^the following",
    r"^you (can|will|should) now",
    r"^the system (will|displays)",
    r"^a (dialog|window|panel|popup|prompt) (is|appears)",
    r"^the (dialog|window|panel|popup|prompt) (is|appears)",
    r"^the activity's .+ (is|are) displayed",
    r"^a security .+ (is|are) displayed",
]
ACTIONS = [
    r"^(click|select|choose|press|open|close|enter|type|fill)",
    r"^(go to|navigate to|switch to)",
    r"^(add|delete|remove|create|edit|modify)",
    r"^(save|submit|cancel|confirm)",
    r"^(enable|disable|activate|deactivate)",
    r"^(drag|drop|move|copy|paste)",
    r"^(upload|download|import|export)",
    r"^(login|logout|sign in|sign out)",
    r"^(review|check|verify|validate)",
]
CONTINUATIONS = [
    r"^(Note|Tip|Warning|Caution|Important):",
    r"^(For example|Example:|e\.g\.|i\.e\.)",
    r"^(Additionally|Furthermore|Moreover|Also)",
    r"^(See also|Refer to|Reference)",
    r"^\s*\+",
    r"^(Step \d+|Phase \d+|Part \d+)",
]
CONTINUATION_CLASSES = ["note", "continuation", "example", "callout"]
CONTINUATION_STYLES = ["margin-left", "padding-left", "text-indent"]
# Inline-code candidates.
CODE_CLASSES = ["Keyboard", "Code", "Monospace", "keyboard", "code"]
CODE_PATTERNS = [
    r"^(ok|cancel|save|delete|edit|create|new|add|remove|close|open|start|stop|play|pause|next|previous|back|forward|submit|apply|reset|clear|refresh|reload|update|upgrade|download|upload|import|export|print|preview|search|find|replace|copy|paste|cut|undo|redo)\z",
    r"^(file|edit|view|tools|help|settings|preferences|options|configuration|config|admin|administrator|home|dashboard|profile|account|login|logout|sign in|sign out)\z",
    r"^(dialog|window|popup|modal|alert|confirm|prompt|notification|message|warning|error|info|success)\z",
    r"^(textbox|text box|dropdown|drop-down|checkbox|check box|radio button|button|field|input|textarea|select|option|label|placeholder)\z",
    r"^(ctrl|alt|shift|cmd|command|meta|win|windows|fn|tab|enter|return|space|spacebar|backspace|delete|del|insert|ins|home|end|pageup|pagedown|pgup|pgdn|up|down|left|right|esc|escape|f1|f2|f3|f4|f5|f6|f7|f8|f9|f10|f11|f12)\z",
    r"^(ctrl|alt|shift|cmd|command)\s*[\+\-]\s*[a-z0-9]",
    r"^[a-z0-9]\s*[\+\-]\s*(ctrl|alt|shift|cmd|command)",
    r"^(ctrl|alt|shift|cmd|command)\s*[\+\-]\s*(ctrl|alt|shift|cmd|command)\s*[\+\-]\s*[a-z0-9]",
    r"^(ctrl|alt|shift|cmd|command)\s*[\+\-]\s*f\d{1,2}\z",
    r"^(get|post|put|delete|patch|head|options|http|https|api|rest|json|xml|html|css|js|javascript|sql|url|uri|id|uuid|guid)\z",
    r"^[a-z0-9_-]+\.(exe|dll|bat|cmd|sh|ps1|py|js|css|html|htm|php|asp|aspx|jsp|xml|json|txt|log|ini|cfg|conf|config)\z",
    r"^[a-z]:\\",
    r"^/[a-z0-9_/-]+",
    r"^v?\d+\.\d+(\.\d+)?(\.\d+)?\z",
    r"^[a-f0-9]{6,}\z",
    r"^(true|false|null|undefined|none|auto|default|enabled|disabled|on|off|yes|no|0|1)\z",
]
# The same patterns sorted for the test of every word of a text: those that list whole words
# as one set, the others as one pattern. That one passes over plain words with a mark behind
# them early; of its branches only hex digits could hold one.
CODE_LISTS = [p for p in CODE_PATTERNS if re.fullmatch(r"\^\([a-z0-9 |-]+\)\\z", p)]
CODE_WORDS = sorted({word for p in CODE_LISTS for word in p[2:-3].split("|")})
CODE_SHAPES = "|".join(p.removeprefix("^").replace("(", "(?:") for p in CODE_PATTERNS if p not in CODE_LISTS)
CODE_SHAPE = (
    r"^(?:[A-Fa-f]{6,}\z|(?![A-Za-z]?[a-z]*+[.,;:!?]?\z)"
    rf"(?:\[.*\]\z|\(.*\)\z|[A-Z][A-Z0-9_]{{2,}}\z|(?i:{CODE_SHAPES})))"
)
# Entities, typographic characters and mojibake handled by text cleaning, in
# the order they are applied.
CLEAN_ENTITIES = [
    ("&nbsp;", " "),
    ("&zwj;", "‍"),
    ("&zwnj;", "‌"),
    ("&ensp;", " "),
    ("&emsp;", " "),
    ("&thinsp;", " "),
    ("&shy;", "­"),
    ("&lrm;", "‎"),
    ("&rlm;", "‏"),
]
CLEAN_PATTERNS = [
    (r"[\x{2018}\x{2019}]", "'"),
    (r"[\x{201c}\x{201d}]", '"'),
    (r"\x{2013}", "-"),
    (r"\x{2014}", "--"),
    (r"\x{2026}", "..."),
    (r"\x{a0}", " "),
    (r"[\x{2002}-\x{2009}]", " "),
    (r"[\x{200b}-\x{200d}]", ""),
    (r"[\x{2028}\x{2029}]", "\n"),
    (r"\r\n", "\n"),
    (r"\r", "\n"),
    (r"\t", " "),
    (r" +", " "),
    (r"\n +", "\n"),
    (r" +\n", "\n"),
    (r"\n\n\n+", "\n\n"),
]
CLEAN_MOJIBAKE = [
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€", '"'),
    ("Ã¡", "á"),
    ("Ã©", "é"),
    ("Ã­", "í"),
    ("Ã³", "ó"),
    ("Ãº", "ú"),
    ("Ã±", "ñ"),
    ("Ã¼", "ü"),
    ("Ã¶", "ö"),
    ("Ã¤", "ä"),
    ("ÃŸ", "ß"),
    ("â„¢", "™"),
    ("Â®", "®"),
    ("Â©", "©"),
    ("Â°", "°"),
]
MATH_SYMBOLS = "[±×÷≤≥≠≈∞αβγδπσΣΔ∑∫√²³½¼¾]"
SCIENTIFIC = r"(?i)(\d+(?:\.\d+)?)\s*[×x]\s*10\s*\^?\s*([+-]?\d+)"
# The same, started once for each run of digits and without trying a shorter run.
SCIENTIFIC_ONCE = r"(?i)(?<!\d)(\d++(?:\.\d++)?+)\s*+[×x]\s*+10\s*+(?:\^\s*+)?+([+-]?\d++)"
SENTENCE_BREAK = rf"(?<=[.!?]){SPACE}+(?=[A-Z])"
PARAGRAPH_BREAK = rf"\n{SPACE}*\n|\r\n{SPACE}*\r\n"
CHUNK_SIZE = 10000
SIZE_UNITS = ["Bytes", "KB", "MB", "GB"]
# ---------------------------------------------------------------------------


def any_of(tests) -> Column:
    """OR of a list of boolean columns."""
    result = F.lit(False)
    for test in tests:
        result = result | test
    return result


def contains_any(c: Column, words) -> Column:
    return any_of(c.contains(w) for w in words)


def matches_any(c: Column, patterns, flags: str = "(?i)") -> Column:
    return any_of(c.rlike(flags + p) for p in patterns)


def trim_ws(c: Column) -> Column:
    """Trim every white-space character, not only blanks."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def nonempty(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c, F.lit(""))


def is_blank(c: Column) -> Column:
    return ~c.rlike(NOT_SPACE)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when there is none or it is empty."""
    return nonempty(F.regexp_extract(c, pattern, group))


def all_matches(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def compact(*items: Column) -> Column:
    """Array of the items that are not null."""
    return F.array_compact(F.array(*items))


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``, so a lambda does not evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def own_key(key: Column, by: Column) -> Column:
    """Join key where a missing key becomes one of the row's own.

    Rows without a key match nothing; spread over ``by`` they do not pile up in one
    partition of an outer join.
    """
    return F.coalesce(key, F.concat(F.lit("\u0000"), by.cast("string")))


def zipped(types: dict[str, str], *arrays: Column) -> Column:
    """Arrays zipped to structs with the given field names and types."""
    fields = ",".join(f"{name}:{kind}" for name, kind in types.items())
    return F.arrays_zip(*arrays).cast(f"array<struct<{fields}>>")


def _fold(c: Column, pairs, regex: bool) -> Column:
    for old, new in pairs:
        c = F.regexp_replace(c, old, new) if regex else F.replace(c, F.lit(old), F.lit(new))
    return c


# --- markup tests and reductions -------------------------------------------
def has_authoring_markup(content: Column) -> Column:
    return contains_any(content, AUTHORING_MARKS)


def strip_boilerplate(html: Column) -> Column:
    """Drop head, link, meta, style and script blocks."""
    for pattern in (
        r"(?is)<head.*?</head>",
        r"(?i)<link[^>]*>",
        r"(?i)<meta[^>]*>",
        r"(?is)<style.*?</style>",
        r"(?is)<script.*?</script>",
    ):
        html = F.regexp_replace(html, pattern, "")
    return html


def visible_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), "&[^;]+;", " ")


def word_count(c: Column, flavour: str = "html") -> Column:
    """Words of visible text (``html``) or of light markup (``markup``)."""
    if flavour == "html":
        text = visible_text(c)
    else:
        text = F.regexp_replace(c, r"[=#+*_`\[\]()-]", " ")
    return F.regexp_count(text, F.lit(NOT_SPACE + "+")).cast("bigint")


def topic_title(html: Column) -> Column:
    """First title that is not blank: h1, title, then the heading-level attribute."""
    def pick(pattern):
        return nonempty(trim_ws(F.regexp_extract(html, pattern, 1)))

    return F.coalesce(
        pick(r"(?i)<h1[^>]*>([^<]+)</h1>"),
        pick(r"(?i)<title[^>]*>([^<]+)</title>"),
        pick(r'(?i)data-mc-heading-level="1"[^>]*>([^<]+)<'),
    )


def markup_title(text: Column) -> Column:
    return F.coalesce(
        first_match(text, r"(?m)^= ([^\n\r]+)$"),
        first_match(text, r"(?m)^# ([^\n\r]+)$"),
        F.lit("Untitled Document"),
    )


def review_warnings(html: Column, cleaned: Column | None = None, help_center: bool = False) -> Column:
    """Warnings by markup presence; ``cleaned`` adds the lost-text warning."""
    lost = F.lit(None).cast("string")
    if cleaned is not None:
        before, after = F.length(visible_text(html)), F.length(visible_text(cleaned))
        lost = F.when(before > after * 1.2, F.lit(REVIEW_LOSS))
    return compact(
        lost,
        F.when(html.contains("data-mc-conditions"), F.lit(REVIEW_CONDITIONS)),
        F.when(contains_any(html, ["data-mc-snippet", "MadCap:snippetBlock"]), F.lit(REVIEW_SNIPPETS)),
        F.when(contains_any(html, ["mc-variable", "MadCap:variable"]), F.lit(REVIEW_VARIABLES)),
        F.when(
            html.contains("MadCap:dropDown"),
            F.lit(REVIEW_DROPDOWNS_HELP_CENTER if help_center else REVIEW_DROPDOWNS),
        ),
    )


def suggest_tags(body: Column, title: Column, n: int = 5) -> Column:
    text = F.lower(visible_text(F.concat_ws(" ", body, title)))
    rules = [F.when(contains_any(text, words), F.lit(tag)) for words, tag in TAG_WORDS]
    rules.append(F.when(F.lower(title).contains("faq"), F.lit("faq")))
    rules.append(F.when(text.contains("example"), F.lit("examples")))
    return F.slice(F.array_distinct(compact(*rules)), 1, n)


def step_class(text: Column, css_class: Column | None = None, style: Column | None = None) -> Column:
    """action, explanatory, continuation or independent."""
    css_class = F.lit("") if css_class is None else F.coalesce(css_class, F.lit(""))
    style = F.lit("") if style is None else F.coalesce(style, F.lit(""))
    continuation = (
        matches_any(text, CONTINUATIONS)
        | contains_any(css_class, CONTINUATION_CLASSES)
        | contains_any(style, CONTINUATION_STYLES)
        | ((F.length(text) < 50) & ~text.rlike(r"[.!?]\z"))
    )
    return (
        F.when(matches_any(text, ACTIONS), "action")
        .when(matches_any(text, EXPLANATORY), "explanatory")
        .when(continuation, "continuation")
        .otherwise("independent")
    )


def is_code_term(text: Column, css_class: Column | None = None) -> Column:
    """Bracketed terms, constants, interface words, keys, file names, paths, numbers of versions and hex."""
    css_class = F.lit("") if css_class is None else F.coalesce(css_class, F.lit(""))
    # only A-Z fold, so words with other letters are none of the list
    listed = F.lower(text).isin(CODE_WORDS) & (F.octet_length(text) == F.length(text))
    return contains_any(css_class, CODE_CLASSES) | listed | text.rlike(CODE_SHAPE)


def element_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit("<[^>]+>")).cast("bigint")


# --- cleaning ---------------------------------------------------------------
def clean_text(c: Column) -> Column:
    c = _fold(c, CLEAN_ENTITIES, regex=False)
    c = _fold(c, CLEAN_PATTERNS, regex=True)
    c = _fold(c, CLEAN_MOJIBAKE, regex=False)
    return trim_ws(c)


def decode_entities(c: Column) -> Column:
    """Double-encoded names, the three markup entities, and hex references."""
    c = F.regexp_replace(c, r"&amp;(?=[a-zA-Z]+;)", "&")
    c = _fold(c, [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')], regex=False)
    pieces = F.split(c, r"(?=&#x[0-9A-Fa-f]+;)")

    def decode(piece):
        digits = F.regexp_extract(piece, r"^&#x([0-9A-Fa-f]+);", 1)
        code = F.conv(F.right(digits, F.lit(4)), 16, 10).cast("int")
        # two bytes big-endian give the character without a per-row function
        char = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        rest = F.regexp_replace(piece, r"^&#x[0-9A-Fa-f]+;", "")
        return F.when(digits != "", F.concat(char, rest)).otherwise(piece)

    return F.array_join(F.transform(pieces, decode), "")


def space_sentences(c: Column) -> Column:
    return F.regexp_replace(c, r"([.?!])(?=[A-Z])", "$1 ")


def decode_url(c: Column) -> Column:
    """Percent decoding; a bad escape keeps the input."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def sanitize_text(c: Column, limit: int | None = None) -> Column:
    """Control characters and double dots go; ``limit`` cuts the result, by default nothing is cut."""
    c = F.regexp_replace(trim_ws(c), r"[\x00\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = F.replace(c, F.lit(".."), F.lit("."))
    return c if limit is None else F.substring(c, 1, limit)


# --- sentences and tokens ---------------------------------------------------
def sentence_parts(c: Column, mark: str | None = None) -> Column:
    """Trimmed parts between sentence ends, blank ones too; ``mark`` is a pattern that parts sentences as well."""
    return F.transform(F.split(c, SENTENCE_BREAK if mark is None else f"{SENTENCE_BREAK}|{mark}"), trim_ws)


def sentences(c: Column) -> Column:
    return F.filter(sentence_parts(c), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, PARAGRAPH_BREAK), trim_ws), lambda s: s != "")


def is_sentence(c: Column) -> Column:
    t = trim_ws(c)
    return t.rlike(r"[.!?]\z") | ((F.length(t) > 10) & t.rlike("^[A-Z]"))


def tokens(c: Column) -> Column:
    """Words and punctuation; an apostrophe after s or x before a space stays."""
    genitive = rf"[^\s.,;:!?()\[\]{{}}\"']*[sxSX]'(?={SPACE})"
    return all_matches(c, rf"{genitive}|[.,;:!?()\[\]{{}}\"']|[^\s\x{{a0}}.,;:!?()\[\]{{}}\"']+", 0)


def join_fragments(parts: Column, kind: str = "sentence") -> Column:
    """Join trimmed fragments, with no space before closing punctuation.

    A separator stands only between neighbours that are both not empty.
    """
    def glue(trimmed):
        following = F.concat(F.slice(trimmed, F.lit(2), F.size(trimmed)), F.array(F.lit("")))

        def piece(current, after):
            gap = F.lit("\n\n") if kind == "paragraph" else F.when(after.rlike(r"^[.,;:!?)\]}]"), "").otherwise(" ")
            return F.when((current == "") | (after == ""), current).otherwise(F.concat(current, gap))

        return F.array_join(F.zip_with(trimmed, following, piece), "")

    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(let(F.transform(parts, trim_ws), glue))


def text_chunks(c: Column, n: int = CHUNK_SIZE) -> Column:
    """Array of pieces of ``n`` characters, cut in one pass; the whole text is kept."""
    return all_matches(c, rf"(?s).{{1,{n}}}", 0)


# --- math -------------------------------------------------------------------
def has_math(c: Column) -> Column:
    """Each pattern is tried only where the text holds what it cannot do without."""
    markup = any_of(c.rlike(p) for p in (r"(?is)<math[^>]*>.*?</math>", r"(?i)<sub>.*?</sub>", r"(?i)<sup>.*?</sup>"))
    return any_of(
        [
            c.contains("$") & c.rlike(r"\$[^$]+\$"),
            c.contains("<") & markup,
            c.contains("10") & c.rlike(SCIENTIFIC_ONCE),
            (F.octet_length(c) != F.length(c)) & c.rlike(rf"(?=[^\x00-\x7f]){MATH_SYMBOLS}"),
        ]
    )


def rewrite_after(c: Column, head, pairs) -> Column:
    """Pattern replacements in what follows ``head(c)``, a start of the text that no match reaches into."""
    def rewrite(whole):
        def join(start):
            return F.concat(start, _fold(F.substr(whole, F.length(start) + 1), pairs, regex=True))

        return let(head(whole), join)

    return let(c, rewrite)


def rewrite_math(c: Column, markup: str = "asciidoc") -> Column:
    edge = rf"{SPACE}*"
    close = rf"(?![!-#%-~]){edge}"  # the class of white space is slow: most characters are told by a range
    display = rf"\$\${edge}([^$]*?[^$\s]){close}\$\$"
    inline = rf"\${edge}([^$]*?[^$\s]){close}\$"

    def before(mark):
        return lambda whole: F.substring_index(whole, mark, 1)

    def before_number(whole):  # without the characters that may stand between a match's start and its 10
        return F.rtrim(F.substring_index(whole, "10", 1), F.lit("0123456789. \t\n\x0b\f\r×xX"))

    if markup == "asciidoc":
        marked = "\n[latexmath]\n++++\n\u0001$1\u0001\n++++\n"
        c = rewrite_after(c, before("$"), [(display, marked), (inline, "latexmath:[$1]")])
        c = F.replace(c, F.lit("\u0001"), F.lit("$$"))
        c = rewrite_after(c, before("<"), [(r"(?i)<sub>(.*?)</sub>", "~$1~"), (r"(?i)<sup>(.*?)</sup>", "^$1^")])
        return rewrite_after(c, before_number, [(SCIENTIFIC_ONCE, "$1 × 10^$2^")])
    c = rewrite_after(c, before("$"), [(display, "\n\u0001\n$1\n\u0001\n"), (inline, r"\$$1\$")])
    c = F.replace(c, F.lit("\u0001"), F.lit("$$"))
    return rewrite_after(c, before_number, [(SCIENTIFIC_ONCE, "$1 × 10<sup>$2</sup>")])


# --- names ------------------------------------------------------------------
def slug(c: Column, kind: str = "file", limit: int | None = None) -> Column:
    """File-name, folder or id slug; ``limit`` cuts file names for file systems that need it."""
    if kind == "file":
        c = F.regexp_replace(F.lower(c), r"[^\w\s-]", "")
        c = F.regexp_replace(F.regexp_replace(c, r"\s+", "-"), "_+", "-")
        c = F.regexp_replace(F.regexp_replace(c, "-+", "-"), r"^-+|-+\z", "")
        return c if limit is None else F.substring(c, 1, limit)
    if kind == "folder":
        c = F.regexp_replace(c, r'[<>:"/\\|?*]', "-")
        c = F.regexp_replace(F.regexp_replace(c, rf"{SPACE}+", "-"), "-+", "-")
        return F.lower(F.regexp_replace(c, r"^-|-\z", ""))
    if kind == "id":
        c = F.regexp_replace(c, "[^a-zA-Z0-9_-]", "-")
        return F.lower(F.regexp_replace(c, "^([0-9])", "id-$1"))
    raise ValueError(f"unknown slug kind: {kind}")


def anchor_slug(term: Column) -> Column:
    """Glossary anchor of a term."""
    body = F.regexp_replace(F.lower(term), "[^a-z0-9]+", "-")
    return F.concat(F.lit("glossary-"), F.regexp_replace(body, r"^-+|-+\z", ""))


def var_name(c: Column, kind: str = "attribute") -> Column:
    """Attribute name (kebab), XML name, or lower snake name of a variable."""
    if kind == "attribute":
        c = F.lower(F.regexp_replace(c, "([A-Z])", "-$1"))
        c = F.regexp_replace(F.regexp_replace(c, "[^a-z0-9-]", "-"), "--+", "-")
        return F.regexp_replace(F.regexp_replace(c, "^-", ""), r"-\z", "")
    if kind == "xml":
        return F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9._-]", "_"), "^[^a-zA-Z_]", "_")
    if kind == "snake":
        c = F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")
        return F.lower(F.regexp_replace(c, "^([0-9])", "_$1"))
    raise ValueError(f"unknown name kind: {kind}")


def rename(c: Column, convention: str = "original") -> Column:
    """Naming convention over words parted by capitals, ``_``, ``-`` and spaces."""
    if convention == "original":
        return c
    spaced = F.regexp_replace(c, "([A-Z])", " $1")
    words = F.filter(F.split(F.regexp_replace(spaced, r"[\s_-]+", " "), " "), lambda w: w != "")
    if convention == "camelCase":
        joined = F.array_join(
            F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), ""
        )
        return F.concat(F.lower(F.substring(joined, 1, 1)), F.substr(joined, F.lit(2)))
    glue = {"snake_case": "_", "kebab-case": "-"}[convention]
    return F.lower(F.array_join(words, glue))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every word and leave the rest alone."""
    pieces = F.split(c, r"(?<=[^A-Za-z0-9_])(?=[A-Za-z0-9_])")
    return F.array_join(
        F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), ""
    )


def escape(c: Column, kind: str = "xml") -> Column:
    if kind == "xml":
        marks = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
        return _fold(c, marks, regex=False)
    return F.replace(c, F.lit("\\"), F.lit("\\\\"))


# --- numbers ----------------------------------------------------------------
def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("bigint")


def format_bytes(n: Column) -> Column:
    """Bytes, KB, MB or GB with at most two decimals."""
    power = (
        F.when(n >= 1024**3, 3).when(n >= 1024**2, 2).when(n >= 1024, 1).otherwise(0)
    )
    value = F.round(n / F.pow(F.lit(1024.0), power), 2)
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), r"0+\z", ""), r"\.\z", "")
    unit = F.element_at(F.array(*[F.lit(u) for u in SIZE_UNITS]), power + 1)
    return F.when(n == 0, F.lit("0 Bytes")).otherwise(F.concat(shown, F.lit(" "), unit))


def estimate_ms(n: Column) -> Column:
    """Rough milliseconds for ``n`` items."""
    return F.when(n <= 10, n * 50).when(n <= 100, n * 30).otherwise(n * 20).cast("bigint")
