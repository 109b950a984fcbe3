"""Functions over every word or the whole of a text: cheap for plain prose, the same results as pattern by pattern."""

from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.plans.catalog import load

FOLDER = "/root/testdata/sf0.001"

TERMS = [
    "", "ok", "OK.", "Ok", "O\u212a", "o\u212a", "\u017fave", "sıgn in", "Sign In", "radio button", "drop-down", "dropdown ", "f12", "F13",
    "Ctrl + S", "ctrl-", "ctrl+\u00e9", "CTRL\t+\nalt-f1", "a+ctrlx", "é+ctrl", "alt", "alt.", "meta+a", "Shift-F12", "shift-F123", "cmd + Cmd+7",
    "facade", "Facade", "FACADE", "facadE", "facade.", "faced", "12345", "123456", "12345g", "decaf1", "Decade,", "Added;", "beefed!", "efface?",
    "run.exe", "Run.EXE", "run.exe.", "a.b.js", "a-b_c.Html", ".sh", "x.shx", "c:\\", "C:\\x", "c:", "cc:\\", "/usr", "/", "/é", "//", "/_", "x/usr",
    "1.2", "v1.2.3", "V1.2.3.4", "1.2.3.4.5", "1.", "v.1", "v1", "1", "0", "2", "ABC", "AB", "A", "Abc", "A_B", "A1", "A12", "ABC.", "ABC\n", "ÄBC", "_AB",
    "[x]", "[]", "[x\ny]", "[x\ry]", "[", "[x].", "(x)", "(x", "x)", "((", "()", "word", "word.", "Word,", "wOrd", "word..", "word's", "日本", "url", "URL:", "x\0",
]


def by_pattern(text):
    constant = text.rlike(r"^[A-Z][A-Z0-9_]*\z") & (F.length(text) > 2)
    return text.rlike(r"^\[.*\]\z") | text.rlike(r"^\(.*\)\z") | constant | T.matches_any(text, T.CODE_PATTERNS)


def test_code_terms_by_pattern(spark):
    lists = sorted({w for p in T.CODE_LISTS for w in p[2:-3].split("|")})
    words = {v for w in [*lists, *TERMS] for x in (w, w + ".", w + "1", "a" + w, w + "\n", w.replace("k", "\u212a")) for v in (x, x.upper(), x.title())}
    terms = spark.createDataFrame([(w,) for w in sorted(words)] + [(None,)], "w string")
    odd = terms.select("w", by_pattern(F.col("w")).alias("want"), T.is_code_term(F.col("w")).alias("got"))
    assert odd.filter("want").count() > 100
    assert odd.filter("not (want <=> got)").collect() == []


def test_code_terms_one_pattern(spark):
    """The planner drops words before they are counted, so each word of a text meets the whole test."""
    plan = load()[0]["code_terms"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1


PROSE = "Plain words of a text, x by x. "
MATH = [
    None, "", "$", "$$", "$$$", "$a$", "$ a $", "$$a$$", "$$ a\nb $$ c $d$", "$\u00a0$", "$a\u2003$", "$$\u00a0a \u3000$$", "$\u00a0a#$", "$a\ufeff-\u00a0 $", "$ $", "a$b", "a $b$ c$", "$a\x01b$", "\x01", "\x01$x$", "日$本$語",
    "H<sub>2</sub>O", "<SUB>2</Sub>", "<sub>2\n</sub>", "<sub>", "a<b <sup>3</sup>", "x<sup></sup>$a<sub>b</sub>$", "<math>\n</MATH>", "<math", "<math x>a</math>",
    "3.0 × 10^8", "3 x 10 8", "3X10^-8", "10 x 10 10", "1.25.5x10^3", "3x105x10^2", "3x10^85x10^2", "3x10", "3 x\n10\n^\n+8", "10. 3x10^8", "a10 b 7 × 10 ^ 2",
    "x 10 3", "12 x 10 3 10", "é5x10^2", "$3x10^8$ and 10", "2\x0b×\x0b10\x0b4", "1 x 100", ".5x10^6", "9" * 50 + "x10^1", "5x10" + " " * 40, "5x10^ 5",
    "π", "pi", "ñ", "a²", "½", "日本", "≤", "≥", "α", "Ω", "$π", "1<2", "10", "#$%&|<>",
]


def math_by_pattern(c, markup):
    edge = rf"{T.SPACE}*"
    display, inline = rf"\$\${edge}([^$]*?[^$\s]){edge}\$\$", rf"\${edge}([^$]*?[^$\s]){edge}\$"
    pairs = {
        "asciidoc": [
            (display, "\n[latexmath]\n++++\n\u0001$1\u0001\n++++\n"), (inline, "latexmath:[$1]"), ("\u0001", r"\$\$"),
            (r"(?i)<sub>(.*?)</sub>", "~$1~"), (r"(?i)<sup>(.*?)</sup>", "^$1^"), (T.SCIENTIFIC, "$1 × 10^$2^"),
        ],
        "markdown": [
            (display, "\n\u0001\n$1\n\u0001\n"), (inline, r"\$$1\$"), ("\u0001", r"\$\$"), (T.SCIENTIFIC, "$1 × 10<sup>$2</sup>"),
        ],
    }[markup]
    for pattern, mark in pairs:
        c = F.regexp_replace(c, pattern, mark)
    return c


def had_by_pattern(c):
    forms = [r"\$[^$]+\$", r"(?is)<math[^>]*>.*?</math>", T.SCIENTIFIC, "(?i)<sub>.*?</sub>", "(?i)<sup>.*?</sup>", T.MATH_SYMBOLS]
    return T.any_of(c.rlike(p) for p in forms)


def test_math_by_pattern(spark):
    symbols = [f"a{s}" for s in T.MATH_SYMBOLS[1:-1]]
    texts = [None, *{t for x in [*MATH, *symbols] if x is not None for y in ("", *MATH) if y is not None for t in (x + y, PROSE + x + " " + y, x + PROSE + y)}]
    c = F.col("c")
    rows = spark.createDataFrame([(t,) for t in texts], "c string").repartition(8)
    for want, got in [
        (had_by_pattern(c), T.has_math(c)),
        (math_by_pattern(c, "asciidoc"), T.rewrite_math(c)),
        (math_by_pattern(c, "markdown"), T.rewrite_math(c, "markdown")),
    ]:
        both = rows.select("c", want.alias("want"), got.alias("got"))
        assert both.filter("not (want <=> got)").take(3) == []


def test_math_searches_from_the_first_mark(spark):
    """No replacement runs over the prose before the first mark that one of its matches can hold."""
    plan = load()[0]["math_notation"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") > 0 and plan.count("regexp_replace(") == plan.count("regexp_replace(substr") + plan.count("regexp_replace(regexp_replace(")
