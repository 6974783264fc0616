"""Glob dialects compiled to regular expressions, and the operators of filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.semantics import full_match

# Names of character classes inside brackets and what they stand for.
POSIX = {
    "alnum": r"\p{L}\p{Nl}\p{Nd}", "alpha": r"\p{L}\p{Nl}", "ascii": r"\x00-\x7f", "blank": r"\p{Zs}\t", "cntrl": r"\p{Cc}", "digit": r"\p{Nd}",
    "lower": r"\p{Ll}", "print": r"\P{C}", "punct": r"\p{P}", "space": r"\p{Z}\t\r\n\x0B\f", "upper": r"\p{Lu}", "word": r"\p{L}\p{Nl}\p{Nd}\p{Pc}",
    "xdigit": "A-Fa-f0-9",
}


def _escape(ch: str) -> str:
    return "\\" + ch if ch in r"\.^$|()[]{}*+?/-&~#" and ch not in "/-&~#" else ch


def glob_unanchored(glob: str) -> str:
    """Search filter dialect: found anywhere, case-sensitive; ``**`` any text, ``*`` no slash, ``?`` one, braces choose."""
    return _simple(glob, star="[^/]*", any_="[^/]")


def glob_path(glob: str) -> str:
    """Path dialect: the whole path; ``*`` no slash, ``**`` any text, ``?`` any one, ``{a,b}`` choices."""
    return f"^{_simple(glob, star='[^/]*', any_='.')}$"


def glob_field(glob: str) -> str:
    """Field dialect: the whole value, letter case ignored; ``*`` any text, ``?`` one, brackets literal."""
    out = "".join({"*": ".*", "?": "."}.get(c) or re.sub(r"([\\.^$|()\[\]{}+])", r"\\\1", c) for c in glob)
    return f"^(?:(?is){out})$"


def _simple(glob: str, star: str, any_: str) -> str:
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += star
        elif c == "?":
            out += any_
        elif c == "{" and "}" in glob[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += _escape(c)
        i += 1
    return out


def glob_names(glob: str, path: bool = False) -> str | None:
    """Name dialect: ``*`` any text, or with ``path`` no slash and ``**/`` optional folders; classes with negation and
    POSIX names; a lone ``*`` is not empty. Whole match. None for an unclosed bracket or an empty glob."""
    if not glob:
        return None
    if glob == "*":
        return "^(?s:.+)$" if not path else "^[^/]+$"
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if path and glob.startswith("**/", i):
            out, i = out + r"(?:(?!\.{1,2}(?:/|$))[^/]+/)*", i + 3
            continue
        if path and glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*?" if path else "(?s:.*)"
        elif c == "?":
            out += "[^/]" if path else "(?s:.)"
        elif c == "[":
            found = _bracket(glob, i + 1)
            if found is None:
                return None
            body, i = found
            out += body
        else:
            out += _escape(c)
        i += 1
    return f"^{out}$"


def _bracket(glob: str, at: int) -> tuple[str, int] | None:
    """The class whose text begins at ``at``, and where its closing bracket stands; None if it never closes."""
    negated = glob[at : at + 1] in ("!", "^") and glob[at + 1 : at + 2] != ""
    at += negated
    body, first = "", at
    while at < len(glob):
        m = re.match(r"\[:(\w+):\]", glob[at:])
        if m and m[1] in POSIX:
            body, at = body + POSIX[m[1]], at + m.end()
            continue
        if glob[at + 1 : at + 2] == "-" and glob[at + 2 : at + 3] not in ("", "]"):
            lo, hi = glob[at], glob[at + 2]
            # a range that runs backwards means its first character
            body, at = body + (f"{_in_class(lo)}-{_in_class(hi)}" if lo < hi else _in_class(lo)), at + 3
            continue
        if glob[at] == "]" and at > first:
            return f"[{'^' if negated else ''}{body}]", at
        body += _in_class(glob[at])
        at += 1
    return None


def _in_class(ch: str) -> str:
    return "\\" + ch if ch in "\\[]&^-" else ch


def valid_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def convert_operator(op: str, value: Any) -> tuple[str, Any]:
    """What a tool's operator means to the filter compiler: globs and text operators become full-match patterns."""
    quoted = re.escape(value) if isinstance(value, str) else value
    return {
        "GLOB": lambda: ("=~", glob_names(value)),
        "REGEX": lambda: ("=~", value),
        "CONTAINS": lambda: ("=~", f"(?s).*{quoted}.*"),
        "STARTS WITH": lambda: ("=~", f"(?s){quoted}.*"),
        "ENDS WITH": lambda: ("=~", f"(?s).*{quoted}"),
        "IN": lambda: ("IN", list(value)),
    }.get(op, lambda: (op, value))()


OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "CONTAINS": lambda c, v: c.contains(v),
    "STARTS WITH": lambda c, v: c.startswith(v),
    "ENDS WITH": lambda c, v: c.endswith(v),
    "IN": lambda c, v: c.isin(list(v)),
    "NOT IN": lambda c, v: ~c.isin(list(v)),
    "=~": lambda c, v: full_match(c, v),
    "GLOB": lambda c, v: c.rlike(glob_names(v) or "(?!)"),
    "REGEX": lambda c, v: full_match(c, v),
}
# The names of operators in object filters and search filters.
KEYED_OPERATORS = {
    "equals": "=", "eq": "=", "neq": "!=", "contains": "CONTAINS", "startsWith": "STARTS WITH", "endsWith": "ENDS WITH",
    "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "in": "IN", "notIn": "NOT IN", "pattern": "=~",
}


def predicate(field: str | Column, op: str, value: Any) -> Column:
    """One condition; an unknown operator is an error. A null field never satisfies it."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator: {op}")
    return OPERATORS[op](F.col(field) if isinstance(field, str) else field, value)


def compile_filter(where: Mapping[str, Any]) -> Column:
    """An object filter: plain value is equality, an object's operators all hold, null values are left out."""
    parts: list[Column] = []
    for field, cond in where.items():
        if cond is None:
            continue
        if isinstance(cond, Mapping):
            for name, v in cond.items():
                if name not in KEYED_OPERATORS:
                    raise ValueError(f"unknown operator: {name}")
                if v is not None:
                    parts.append(predicate(field, KEYED_OPERATORS[name], v))
        else:
            parts.append(predicate(field, "=", cond))
    return all_of(parts)


def any_label(labels: Column, allowed: Sequence[str]) -> Column:
    """Whether a row has one of the labels; a row without labels has none."""
    return F.coalesce(F.arrays_overlap(labels, F.array(*map(F.lit, allowed)).cast("array<string>")), F.lit(False))


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def url_allowed(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Exclude patterns win; without include patterns everything else is allowed."""
    out = reduce(lambda a, p: a | url.rlike(p), include, F.lit(False)) if include else F.lit(True)
    for p in exclude:
        out = out & ~url.rlike(p)
    return out


def project_scope(
    project: Column, path: Column, node_type: Column, *, include: Sequence[str] | None = None, exclude: Sequence[str] = (), base_path: str | None = None, types: Sequence[str] = ()
) -> Column:
    """Projects in or out, or below a base path; node types in lower case."""
    ok = project.isin(list(include)) if include is not None else F.lit(True)
    if exclude:
        ok = ok & ~project.isin(list(exclude))
    if base_path:
        ok = ok & ((path == base_path) | path.startswith(base_path.rstrip("/") + "/"))
    if types:
        ok = ok & F.lower(node_type).isin([t.lower() for t in types])
    return ok
