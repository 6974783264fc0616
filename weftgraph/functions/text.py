"""Text functions: chunking, preprocessing, sections, references, URLs, entity keys."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LINES, MAX_CHARS, OVERLAP, MIN_CHUNK = 30, 1500, 5, 50
CHUNK_SCHEMA = "array<struct<text:string,index:int,start_char:int,end_char:int,start_line:int,end_line:int>>"


def chunk_text(text: str, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, min_chunk: int = MIN_CHUNK) -> list[tuple]:
    """(text, index, start_char, end_char, start_line, end_line) of overlapping line chunks.

    A longer line is cut to pieces first, which then count as lines. Chunks hold as many lines as fit both limits, one
    at least; the next starts ``overlap`` lines before the end. Short chunks are dropped except the first. Characters
    count from 0 and as if each line, pieces included, were followed by one line break; lines count from 1.
    """
    if not text:
        return []
    piece = re.compile(rf"(?m)^$|[^\n]{{1,{max_chars}}}")
    lines = [m[0] for m in piece.finditer(text)]
    # places[k]: where line k starts; the text's last line has no line break to pay for
    places = np.concatenate(([0], np.cumsum([len(x) + 1 for x in lines])))
    paid = places[1:].copy()
    paid[-1] -= 1
    first = np.arange(len(lines))
    ends = np.clip(np.searchsorted(paid, places[:-1] + max_chars, side="right"), first + 1, np.minimum(first + max_lines, len(lines)))
    out: list[tuple] = []
    at = 0
    while True:
        end = int(ends[at])
        body = "\n".join(lines[at:end])
        if not out or len(body) >= min_chunk:
            out.append((body, len(out), int(places[at]), int(places[at]) + len(body), at + 1, end))
        if end == len(lines):
            return out
        at = max(at + 1, end - overlap)


def chunks(rows: DataFrame, id_col: str, text_col: str, **limits: int) -> DataFrame:
    """One row per chunk: ``id, text, index, start_char, end_char, start_line, end_line``. Nothing is shuffled."""

    @F.pandas_udf(CHUNK_SCHEMA)
    def cut(texts: pd.Series) -> pd.Series:
        keys = ("text", "index", "start_char", "end_char", "start_line", "end_line")
        return pd.Series([[dict(zip(keys, c)) for c in chunk_text(t or "", **limits)] for t in texts])

    return rows.select(F.col(id_col).alias("id"), F.explode(cut(F.col(text_col))).alias("c")).select("id", "c.*")


def needs_chunking(c: Column) -> Column:
    return (F.length(c) > MAX_CHARS) | (F.size(F.split(c, "\n", -1)) > MAX_LINES)


def estimated_chunks(c: Column) -> Column:
    n = F.greatest(F.ceil(F.length(c) / MAX_CHARS), F.ceil(F.size(F.split(c, "\n", -1)) / (MAX_LINES - OVERLAP)))
    return F.when(needs_chunking(c), n).otherwise(1).cast("long")


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def split_camel_case(c: Column) -> Column:
    return F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")


def strip_comments(c: Column) -> Column:
    """Without block comments and without line comments that begin a line or follow a blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", ""), r"(?m)(^|\s)//.*$", ""))


def preprocess(c: Column, steps: Sequence) -> Column:
    for s in steps:
        c = s(c)
    return c


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def sanitize_id(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "_")


def relation_type(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9_]", "_")


def entity_key(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.lower(F.trim(name)))


def entity_id(kind: Column, name: Column) -> Column:
    return F.concat(F.lit("entity:"), F.lower(kind), F.lit(":"), sanitize_id(F.trim(name)))


def normalize_url(c: Column) -> Column:
    """Without fragment and one trailing slash; what is no URL stays."""
    bare = F.regexp_replace(c, "#.*$", "")
    return F.when(c.rlike(r"^[a-zA-Z][\w+.\-]*://\S+$"), F.regexp_replace(bare, "/$", "")).otherwise(c)


def repository_of(c: Column) -> Column:
    """``owner, name, ref`` of a Git hosting address."""
    p = r"^(?:https?://|git@)[\w.\-]+[/:]([\w.\-]+)/([\w.\-]+?)(?:\.git)?(?:/(?:tree|blob)/([^/?#]+).*)?/?$"
    part = lambda i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    return F.struct(part(1).alias("owner"), part(2).alias("name"), part(3).alias("ref"))


def reference_kind(c: Column) -> Column:
    """What a reference points at, by its spelling."""
    return (
        F.when(c.rlike(r"^(https?:)?//"), "url")
        .when(c.rlike(r"/$"), "directory")
        .when(c.rlike(r"(?i)\.(png|jpe?g|gif|svg|webp|ico|bmp)([?#]|$)"), "image")
        .when(c.rlike(r"(?i)\.(json|ya?ml|toml|env|ini|xml)([?#]|$)"), "config")
        .when(c.rlike(r"(?i)\.(tsx?|jsx?|py|go|rs|java|rb|css|scss|vue|svelte)([?#]|$)"), "code")
        .when(~c.rlike(r"^[./]") & ~c.rlike(r"\.\w{1,5}$"), "package")
        .otherwise("file")
    )


def infer_typed(c: Column) -> Column:
    """The type that a text's value has: boolean, number or string."""
    t = F.trim(c)
    b = F.lower(t).isin("true", "false")
    return F.when(b, "boolean").when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "number").otherwise("string")


def sections(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, section_no, level, title, start_line, end_line, parent_no`` of Markdown headings outside code fences.

    Text before the first heading is no section. Everything happens inside one row's arrays, so no window or shuffle.
    """
    lines = F.split(F.regexp_replace(F.col(text_col), "\r\n", "\n"), "\n", -1)
    heads = F.aggregate(
        F.transform(lines, lambda x, i: F.struct(x.alias("t"), i.alias("i"))),
        F.struct(F.lit(False).alias("fence"), F.array().cast("array<struct<i:int,t:string>>").alias("h")),
        lambda acc, x: F.struct(
            F.when(x["t"].rlike(r"^\s*(```|~~~)"), ~acc["fence"]).otherwise(acc["fence"]).alias("fence"),
            F.when(~acc["fence"] & x["t"].rlike(r"^#{1,6}\s+\S"), F.array_append(acc["h"], F.struct(x["i"].alias("i"), x["t"].alias("t")))).otherwise(acc["h"]).alias("h"),
        ),
        lambda acc: acc["h"],
    )
    level = lambda t: F.length(F.regexp_extract(t, r"^(#{1,6})\s", 1))
    flat = rows.select(F.col(id_col).alias("id"), F.size(lines).alias("_n"), heads.alias("h")).where(F.size("h") > 0)
    flat = flat.withColumn("lv", F.transform("h", lambda x: level(x["t"])))
    out = flat.select("id", "_n", "h", "lv", F.posexplode("h").alias("p", "x"))
    mine = F.element_at("lv", F.col("p") + 1)
    later = F.filter(F.slice(F.transform(F.arrays_zip("h", "lv"), lambda z: z), F.col("p") + 2, F.size("h")), lambda z: z["lv"] <= mine)
    earlier = F.filter(F.transform("lv", lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda z: (z["i"] < F.col("p")) & (z["v"] < mine))
    return out.select(
        "id", (F.col("p") + 1).alias("section_no"), mine.alias("level"), F.trim(F.regexp_extract("x.t", r"^#{1,6}\s+(.*?)\s*#*\s*$", 1)).alias("title"),
        (F.col("x.i") + 1).alias("start_line"),
        F.when(F.size(later) > 0, F.get(later, F.lit(0))["h"]["i"]).otherwise(F.col("_n")).alias("end_line"),
        F.when(F.size(earlier) > 0, F.element_at(earlier, -1)["i"] + 1).alias("parent_no"),
    )


def code_blocks(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, block_no, lang, code`` of fenced blocks."""
    p = r"(?ms)^```([\w+\-]*)[^\n]*\n(.*?)^```"
    return rows.select(F.col(id_col).alias("id"), F.posexplode(F.arrays_zip(
        F.regexp_extract_all(text_col, F.lit(p), 1).alias("lang"), F.regexp_extract_all(text_col, F.lit(p), 2).alias("code"))).alias("p", "b")
    ).select("id", (F.col("p") + 1).alias("block_no"), F.col("b.lang").alias("lang"), F.col("b.code").alias("code"))


# How languages spell a reference; the first group is its target.
REFERENCE_PATTERNS: dict[str, dict[str, str]] = {
    "ts": {"import": r"(?m)^\s*(?:import|export)\b[^'\"\n;]*?from\s*['\"]([^'\"\n]+)['\"]", "require": r"\b(?:require|import)\(\s*['\"]([^'\"\n]+)['\"]\s*\)", "side_effect": r"(?m)^\s*import\s+['\"]([^'\"\n]+)['\"]"},
    "py": {"from": r"(?m)^\s*from\s+([\w.]+)\s+import\b", "import": r"(?m)^\s*import\s+([\w.]+)"},
    "md": {"link": r"(?<!!)\[[^\]\n]*\]\(([^)\s]+)[^)\n]*\)", "image": r"!\[[^\]\n]*\]\(([^)\s]+)[^)\n]*\)"},
    "css": {"import": r"@import\s+(?:url\()?['\"]?([^'\")\s;]+)", "url": r"url\(\s*['\"]?([^'\")\s]+)"},
    "html": {"href": r"(?i)\bhref\s*=\s*['\"]([^'\"]+)['\"]", "src": r"(?i)\bsrc\s*=\s*['\"]([^'\"]+)['\"]"},
    "any": {"url": r"\b(https?://[^\s<>\"')\]]+)"},
}


def extract_references(rows: DataFrame, lang: Column, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, kind, target``: references by the language's spellings and addresses in any text, each (kind, target) once."""
    tagged = lambda found, kind: F.transform(found, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))
    found = F.array().cast("array<struct<kind:string,target:string>>")
    for name, patterns in REFERENCE_PATTERNS.items():
        for kind, p in patterns.items():
            got = tagged(F.regexp_extract_all(text_col, F.lit(p), 1), kind)
            mine = F.lit(True) if name == "any" else lang.isin("ts", "tsx", "js", "jsx", "mjs", "cjs", "vue", "svelte") if name == "ts" else lang.isin("css", "scss") if name == "css" else lang == name
            found = F.concat(found, F.when(F.coalesce(mine, F.lit(False)), got).otherwise(F.array().cast("array<struct<kind:string,target:string>>")))
    return rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(found)).alias("r")).select("id", "r.kind", "r.target")


def page_facts(rows: DataFrame, url_col: str = "url", html_col: str = "html", max_text: int | None = None) -> DataFrame:
    """``url, title, description, text``: description from its meta tag, og tag or the first 200 characters; the whole
    text, or its first ``max_text`` characters."""
    text = collapse_blanks(F.regexp_replace(F.regexp_replace(F.col(html_col), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " "))
    meta = lambda a, n: F.nullif(F.regexp_extract(html_col, rf"(?is)<meta[^>]*{a}=[\"']{n}[\"'][^>]*content=[\"']([^\"']*)", 1), F.lit(""))
    return rows.select(
        normalize_url(F.col(url_col)).alias("url"), collapse_blanks(F.regexp_extract(html_col, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.coalesce(meta("name", "description"), meta("property", "og:description"), F.substring(text, 1, 200)).alias("description"), (text if max_text is None else F.substring(text, 1, max_text)).alias("text"),
    )


def page_links(rows: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst``: links between the given pages, absolute or from the root, without loops."""
    hrefs = F.explode(F.regexp_extract_all(html_col, F.lit(r"(?is)<a\b[^>]*href=[\"']([^\"'#]+)"), 1)).alias("h")
    src = normalize_url(F.col(url_col)).alias("src")
    host = F.regexp_extract("src", r"^(\w+://[^/]+)", 1)
    e = rows.select(src, hrefs).withColumn("dst", normalize_url(F.when(F.startswith("h", F.lit("/")), F.concat(host, F.col("h"))).otherwise(F.col("h"))))
    pages = rows.select(normalize_url(F.col(url_col)).alias("dst"))
    return e.where(F.col("src") != F.col("dst")).join(pages, "dst", "left_semi").select("src", "dst").distinct()


# Extensions by which a value of a data file is known as a reference to code, an image or configuration.
VALUE_KINDS = {
    "code": ".ts .tsx .js .jsx .py .java .go .rs .c .cpp .h .hpp .cs .rb .php .swift .kt".split(),
    "image": ".png .jpg .jpeg .gif .webp .svg .ico .bmp .tiff".split(),
    "config": ".json .yaml .yml .xml .toml .ini .conf .config".split(),
}
PACKAGE_KEYS = ("dependencies", "devDependencies", "peerDependencies")
SECTION_SCHEMA = "section string, key string, kind string, size long, depth long, parent string, start_line long, end_line long, content string"
REFERENCE_SCHEMA = "place string, kind string, target string, line long, is_relative boolean"


def value_reference(value: str, place: str) -> str | None:
    """What a text value of a data file refers to: url, package, directory, code, image, config or file; None for none."""
    v = value.strip()
    if re.match(r"(?:https?|ftp)://", v):
        return "url"
    local = v.startswith(("./", "../", "/"))
    if v and any(k in place for k in PACKAGE_KEYS) and "/" not in v and not v.startswith("."):
        return "package"
    if not local:
        return None
    if v.endswith("/") or "**/" in v or "/*" in v:
        return "directory"
    ext = re.search(r"\.[a-z0-9]+$", re.split(r"[?#]", v)[0].replace("*", "").lower())
    return next((k for k, known in VALUE_KINDS.items() if ext and ext[0] in known), "file")


def _entries(box: object) -> list[tuple[str, object]]:
    return list(box.items()) if isinstance(box, dict) else [(f"[{i}]", x) for i, x in enumerate(box)]


def _printed_lines(v: object) -> int:
    """Lines of a value printed with one entry a line."""
    if not isinstance(v, (dict, list)) or not v:
        return 1
    return 2 + sum(_printed_lines(x) for _, x in _entries(v))


def _texts(v: object, place: str) -> Iterator[tuple[str, str]]:
    if isinstance(v, str):
        yield place, v
    elif isinstance(v, dict):
        for k, x in v.items():
            yield from _texts(x, f"{place}.{k}")
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from _texts(x, f"{place}[{i}]")


def data_sections(value: object, least_keys: int = 2, least_items: int = 3, max_depth: int = 10) -> tuple[list[tuple], list[tuple]]:
    """Sections and references of a parsed data file, in the columns of ``SECTION_SCHEMA`` and ``REFERENCE_SCHEMA``.

    A section is an entry with so many keys or items; the root itself is none. Sections nest down to ``max_depth``;
    lines count as if each section were printed with one entry a line, and any other entry took one line. Text values
    in sections' entries and inside smaller values are looked at for references.
    """
    sections_, references = [], []
    boxes = [(None, value, 0, 1)]
    while boxes:
        parent, box, depth, line = boxes.pop()
        if depth > max_depth or not isinstance(box, (dict, list)):
            continue
        for name, v in _entries(box):
            place = name if parent is None else f"{parent}.{name}"
            if isinstance(v, (dict, list)) and len(v) >= (least_keys if isinstance(v, dict) else least_items):
                n = _printed_lines(v)
                key = name.removeprefix("[").removesuffix("]")
                kind = "object" if isinstance(v, dict) else "array"
                sections_.append((place, key, kind, len(v), depth, parent, line, line + n - 1, json.dumps(v, ensure_ascii=False, indent=2, default=str)))
                boxes.append((place, v, depth + 1, line + 1))
                line += n
                continue
            for p, t in _texts(v, place):
                kind = value_reference(t, p)
                if kind:
                    references.append((p, kind, t, line, t.startswith(("./", "../"))))
            line += 1
    return sections_, references


# Words by which the heuristic classifier knows a domain.
DOMAINS: dict[str, tuple[str, ...]] = {
    "ecommerce": ("price", "product", "shop", "buy", "cart", "order", "brand", "ingredient", "shampoo", "cream", "hair", "skin", "beauty"),
    "code": ("function", "class", "import", "def", "return", "const", "let", "var", "async", "await", "export", "module", "api", "endpoint"),
    "documentation": ("feature", "requirement", "specification", "user story", "use case", "milestone", "release", "version", "component"),
    "legal": ("contract", "clause", "obligation", "party", "jurisdiction", "agreement", "terms", "conditions", "liability", "warrant"),
}


def domains(rows: DataFrame, id_col: str = "id", text_col: str = "text", minimum: float = 0.3) -> DataFrame:
    """``id, domain, score, confidence``: the share of a domain's words found, above the minimum; confidence is twice that, 1 at most."""
    low = F.lower(text_col)
    parts = [F.struct(F.lit(d).alias("domain"), (sum((low.contains(w).cast("int") for w in ws), F.lit(0)) / len(ws)).alias("score")) for d, ws in DOMAINS.items()]
    flat = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*parts)).alias("d")).select("id", "d.domain", "d.score")
    return flat.where(F.col("score") > minimum).withColumn("confidence", F.least(F.col("score") * 2, F.lit(1.0)))
