"""Text pieces for the checking SQL: the scalar definitions the queries share."""

from __future__ import annotations

from docweft.functions.text import NOT_SPACE, SPACE
from docweft.plans.derived import ctes  # noqa: F401  (re-exported for the query modules)


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sub(c: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(replacement)}, 'g')"


def trim(c: str) -> str:
    return sub(c, rf"^{SPACE}+|{SPACE}+\z")


def blank(c: str) -> str:
    return f"not regexp_matches({c}, {q(NOT_SPACE)})"


def rlike(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def extract(c: str, pattern: str, group: int = 1) -> str:
    return f"coalesce(regexp_extract({c}, {q(pattern)}, {group}), '')"


def extract_all(c: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({c}, {q(pattern)}, {group})"


def basename(p: str) -> str:
    return extract(p, r"([^/]*)/*\z")


def dirname(p: str) -> str:
    return (
        f"case when not contains({p}, '/') then '.' when {extract(p, r'^(.*)/[^/]*$')} = '' then '/' "
        f"else {extract(p, r'^(.*)/[^/]*$')} end"
    )


def extname(p: str) -> str:
    return extract(p, r"[^/](\.[^./]*)\z")


def stem(p: str) -> str:
    return f"regexp_replace({basename(p)}, {q(r'^(.+)[.][^./]*$')}, {q(chr(92) + '1')})"


def normalize(p: str) -> str:
    """Path with ``.`` and ``..`` resolved, for relative paths."""
    return (
        f"substr(list_reduce(list_prepend('', string_split({p}, '/')), lambda a, x: "
        "case when x in ('', '.') then a when x = '..' and a <> '' and not ends_with(a, '/..') "
        f"then regexp_replace(a, '/[^/]*$', '') else a || '/' || x end), 2)"
    )


def relative(frm: str, to: str) -> str:
    a = f"list_filter(string_split({dirname(frm)}, '/'), lambda s: s not in ('', '.'))"
    b = f"list_filter(string_split({to}, '/'), lambda s: s not in ('', '.'))"
    same = (
        f"coalesce(list_position(list_transform(range(1, least(len({a}), len({b})) + 1), "
        f"lambda i: ({a})[i] = ({b})[i]), false) - 1, least(len({a}), len({b})))"
    )
    return (
        f"array_to_string(list_concat(list_transform(range(len({a}) - {same}), lambda i: '..'), "
        f"({b})[cast({same} as bigint) + 1:]), '/')"
    )


def lines(view: str, text: str, name: str = "lines") -> str:
    """CTE of ``path, line_no, line``."""
    return (
        f"{name} as (select path, unnest(string_split({text}, chr(10))) as line, "
        f"generate_subscripts(string_split({text}, chr(10)), 1) as line_no from {view})"
    )


def matches(c: str, patterns, flags: str = "(?i)") -> str:
    return "(" + " or ".join(rlike(c, flags + p) for p in patterns) + ")"


def contains_any(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def registry():
    """Queries and checking SQL of a module, and the decorator that registers both."""
    queries, checks = {}, {}

    def query(name, sql=None):
        def add(function):
            queries[name] = function
            if sql is not None:
                checks[name] = sql
            return function

        return add

    return queries, checks, query
