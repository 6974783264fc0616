"""Configuration formats as key paths with offsets: JSON, YAML, TOML, INI, .env and XML.

Parsers here are lenient and keep places: what they do not understand is skipped, not an error, since a file with a
fault may hold credentials all the same. Every value comes as a path of keys and the pieces of text that make it up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Value(NamedTuple):
    path: str
    pieces: tuple[tuple[int, int], ...]  # offsets in characters; several for a value that spans lines


# Extensions of configuration formats.
FORMATS = {
    "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini", "cfg": "ini", "conf": "ini", "properties": "ini",
    "xml": "xml", "plist": "xml", "config": "xml", "env": "env",
}
_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)
_COLON = re.compile(r"\s*:")
_DOUBLE = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_SINGLE = re.compile(r"'((?:[^']|'')*)'", re.S)
_YAML_KEY = re.compile(r"""(?P<k>"(?:[^"\\\n]|\\.)*"|'(?:[^'\n]|'')*'|[^\s"'\[\]{}#&*!|>%@`,][^\n:#]*?)\s*:(?=[ \t\r\n]|$)""")
_YAML_DASHES = re.compile(r"(?:-[ \t]+)*")
_YAML_TAGS = re.compile(r"[ \t]*(?:[&!][^\s]*[ \t]+)*")
_YAML_BLOCK = re.compile(r"[|>][+\-0-9]*[ \t]*(?:#[^\n]*)?\r?$")
_SECTION = re.compile(r"\s*\[{1,2}([^\[\]\n]+)\]{1,2}\s*(?:[#;][^\n]*)?$")
_PAIR = re.compile(r"""[ \t]*(?:export[ \t]+)?(?P<k>"[^"\n]*"|'[^'\n]*'|[\w.\-/]+)[ \t]*(?P<s>[=:])[ \t]*""")
_TRIPLE = {'"""': re.compile(r'"""(.*?)"""', re.S), "'''": re.compile(r"'''(.*?)'''", re.S)}
# what a line of a text in triple quotes holds besides blanks around it and a backslash that joins lines
_FILLED = re.compile(r"[^\s\\](?:[^\n]*[^\s\\])?")
_XML = re.compile(
    r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<!\w[^>]*>|</(?P<close>[\w:.\-]+)\s*>"
    r"|<(?P<open>[\w:.\-]+)(?P<attrs>(?:\s+[\w:.\-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(?P<empty>/?)>",
    re.S,
)
_ATTR = re.compile(r"([\w:.\-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
#: Attributes that name what an element or its ``value`` attribute holds.
_NAMING = ("name", "key", "id")


def config_format(path: str | None) -> str | None:
    """The configuration format of a path by its extension; names such as ``.env.local`` are .env too."""
    name = (path or "").rsplit("/", 1)[-1].lower()
    return FORMATS.get(name.rsplit(".", 1)[-1]) or ("env" if name.startswith(".env") or ".env." in name else None)


def config_values(text: str, kind: str | None) -> Iterator[Value]:
    """The values of a text in one of the known formats; none for others."""
    if kind == "json":
        for path, s, e in json_strings(text):
            yield Value(path, ((s, e),))
    elif kind == "yaml":
        yield from yaml_values(text)
    elif kind in ("toml", "ini", "env"):
        yield from pair_values(text, kind)
    elif kind == "xml":
        yield from xml_values(text)


def _joined(*parts: str) -> str:
    return ".".join(p for p in parts if p)


def json_strings(text: str) -> Iterator[tuple[str, int, int]]:
    """(key path, start, end) of every string value of a JSON text; what comes after a syntax error is not parsed."""
    path: list[str] = []
    stack: list[str] = []
    key: str | None = None
    pending: tuple[int, int] | None = None
    for m in _JSON_TOKEN.finditer(text):
        t = m[0]
        if t in "{[":
            stack.append(t)
            path.append(key if key is not None else "")
            key = None
        elif t in "}]":
            if not stack:
                return
            stack.pop()
            path.pop()
            key = None
        elif t == ":":
            if pending:
                key = text[pending[0] : pending[1]]
        elif t == ",":
            if not stack or stack[-1] == "{":
                key = None
        elif t[0] == '"':
            span = (m.start() + 1, m.end() - 1)
            if key is None and _COLON.match(text, m.end()):
                pending = span
            else:
                yield _joined(*path, key or ""), *span


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _plain(text: str, at: int, end: int, marks: str) -> tuple[int, int]:
    """An unquoted value up to a comment that follows a blank."""
    m = re.compile(rf"[ \t]+[{marks}]").search(text, at, end) if marks else None
    stop = m.start() if m else end
    while stop > at and text[stop - 1] in " \t\r":
        stop -= 1
    return at, stop


def yaml_values(text: str) -> Iterator[Value]:
    """Scalars of block YAML: plain, quoted (over several lines too) and block scalars; flow collections are skipped."""
    stack: list[tuple[int, str]] = []
    at, n = 0, len(text)
    while at < n:
        end = _line_end(text, at)
        i = at
        while i < end and text[i] == " ":
            i += 1
        if i >= end or text[i] in "#\r" or text.startswith("---", at):
            if text.startswith("---", at):
                stack = []
            at = end + 1
            continue
        i = _YAML_DASHES.match(text, i, end).end()
        indent = i - at
        m = _YAML_KEY.match(text, i, end)
        while stack and stack[-1][0] >= indent:
            stack.pop()
        if m:
            stack.append((indent, m["k"].strip("'\" ")))
            i = m.end()
        path = _joined(*(k for _, k in stack))
        i = _YAML_TAGS.match(text, i, end).end()
        next_line = end + 1
        if _YAML_BLOCK.match(text[i:end]):
            pieces = []
            while next_line < n:
                stop = _line_end(text, next_line)
                s = next_line
                while s < stop and text[s] in " \t":
                    s += 1
                if text[s:stop].strip() and s - next_line <= (indent if m else indent - 1):
                    break
                e = stop - 1 if stop > s and text[stop - 1] == "\r" else stop
                if e > s:
                    pieces.append((s, e))
                next_line = stop + 1
            if pieces:
                yield Value(path, tuple(pieces))
        elif i < end and text[i] in "\"'":
            q = (_DOUBLE if text[i] == '"' else _SINGLE).match(text, i)
            if q:
                yield Value(path, (q.span(1),))
                next_line = _line_end(text, q.end()) + 1
        elif i < end and text[i] not in "{[#&*!|>%@`\r":
            s, e = _plain(text, i, end, "#")
            if e > s:
                yield Value(path, ((s, e),))
        at = next_line


def pair_values(text: str, kind: str) -> Iterator[Value]:
    """Values of ``key = value`` lines below ``[section]`` lines; INI takes a colon too, only TOML has triple quotes."""
    section, at, n = "", 0, len(text)
    marks = {"toml": "#", "ini": "#;", "env": "#"}[kind]
    while at < n:
        end = _line_end(text, at)
        m = _SECTION.match(text, at, end) if kind != "env" else None
        if m:
            section = m[1].strip()
            at = end + 1
            continue
        m = _PAIR.match(text, at, end)
        if not m or (m["s"] == ":" and kind != "ini"):
            at = end + 1
            continue
        path, i = _joined(section, m["k"].strip("'\"")), m.end()
        triple = _TRIPLE[text[i : i + 3]].match(text, i) if kind == "toml" and text[i : i + 3] in _TRIPLE else None
        quoted = (_DOUBLE if text[i] == '"' else re.compile(r"'([^']*)'")).match(text, i) if i < end and text[i] in "\"'" else None
        q = triple or quoted
        if q and (kind != "ini" or q.end() <= end):
            pieces = tuple(x.span() for x in _FILLED.finditer(text, *q.span(1))) if triple else (q.span(1),)
            if pieces:
                yield Value(path, pieces)
            at = _line_end(text, q.end()) + 1
            continue
        if i < end and not (kind == "toml" and text[i] in "[{"):
            s, e = _plain(text, i, end, marks)
            if e > s:
                yield Value(path, ((s, e),))
        at = end + 1


def xml_values(text: str) -> Iterator[Value]:
    """Attribute values and texts of elements. An attribute ``name``, ``key`` or ``id`` names its element's text and
    ``value`` attribute. An element that never closes keeps its place in the path until one above it does."""
    stack: list[tuple[str, str]] = []
    last = 0

    def inner(at: int, end: int) -> Iterator[Value]:
        while at < end and text[at].isspace():
            at += 1
        while end > at and text[end - 1].isspace():
            end -= 1
        if end > at and stack:
            yield Value(_joined(*(t for t, _ in stack), stack[-1][1]), ((at, end),))

    for m in _XML.finditer(text):
        yield from inner(last, m.start())
        last = m.end()
        if m["cdata"] is not None:
            yield from inner(*m.span("cdata"))
        elif m["close"]:
            tags = [t for t, _ in stack]
            if m["close"] in tags:
                del stack[len(tags) - 1 - tags[::-1].index(m["close"]) :]
        elif m["open"]:
            found = [(a[1], *(a.span(2) if a[2] is not None else a.span(3))) for a in _ATTR.finditer(text, *m.span("attrs"))]
            named = next((text[s:e] for want in _NAMING for a, s, e in found if a.lower() == want), "")
            above = _joined(*(t for t, _ in stack), m["open"])
            for a, s, e in found:
                if e > s:
                    yield Value(_joined(above, named) if a.lower() == "value" and named else _joined(above, a), ((s, e),))
            if not m["empty"]:
                stack.append((m["open"], named))
