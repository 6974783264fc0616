"""Files as tables: globbed trees, archives, in-memory files, structured data, spreadsheets, parser registry."""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.ids import sha256_hex
from weftgraph.functions.patterns import glob_path
from weftgraph.functions.text import REFERENCE_SCHEMA, SECTION_SCHEMA, data_sections

# What a scan leaves out unless told otherwise.
DEFAULT_EXCLUDES = ("**/node_modules/**", "**/dist/**", "**/.git/**")
# Which parser takes a file, by extension.
PARSERS: dict[str, str] = {
    **dict.fromkeys(("ts", "tsx", "js", "jsx", "py", "go", "css", "scss", "vue", "svelte"), "code"),
    **dict.fromkeys(("md", "mdx"), "markdown"), **dict.fromkeys(("json", "yaml", "yml", "xml", "toml", "env"), "data"),
    **dict.fromkeys(("csv", "tsv", "xlsx"), "spreadsheet"), **dict.fromkeys(("pdf", "docx"), "document"),
    **dict.fromkeys(("png", "jpg", "jpeg", "gif", "svg", "webp"), "media"), **dict.fromkeys(("html", "htm"), "web"),
}
_EXTRA_PARSERS: dict[str, Callable] = {}


def register_parser(extension: str, name: str, parse: Callable[[str, bytes], list[dict]] | None = None) -> None:
    """Adds a parser: its name for dispatch and, if given, the function from path and bytes to rows."""
    PARSERS[extension.lower().lstrip(".")] = name
    if parse:
        _EXTRA_PARSERS[name] = parse


def parser_name(path_col: str = "path"):
    """The parser of a path as a column; ``generic`` for unknown extensions."""
    ext = F.lower(F.regexp_extract(path_col, r"\.(\w+)$", 1))
    m = F.create_map(*(x for k, v in PARSERS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(m, ext), F.lit("generic"))


def globbed(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = DEFAULT_EXCLUDES, path_col: str = "path") -> DataFrame:
    """Files that match an include glob (any, if none is given) and no exclude glob."""
    p = F.regexp_replace(path_col, r"^\w+:/*", "/")
    ok = F.lit(not include)
    for g in include:
        ok = ok | p.rlike(glob_path(g)) | p.rlike(glob_path("**/" + g))
    for g in exclude:
        ok = ok & ~p.rlike(glob_path(g))
    return files.where(ok)


def read_tree(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = DEFAULT_EXCLUDES) -> DataFrame:
    """``path, size, modified_at, content`` of a directory tree."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return globbed(df, include, exclude).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")


def virtual_files(spark: SparkSession, files: dict[str, str | bytes]) -> DataFrame:
    """In-memory files in the shape of ``read_tree``."""
    rows = [(p, len(b), b) for p, b in ((p, c.encode() if isinstance(c, str) else c) for p, c in files.items())]
    return spark.createDataFrame(rows, "path string, size long, content binary").withColumn("modified_at", F.lit(None).cast("timestamp"))


def with_text(files: DataFrame) -> DataFrame:
    """Adds ``text`` and its hash."""
    return files.withColumn("text", F.decode("content", "UTF-8")).withColumn("content_hash", sha256_hex(F.col("text")))


def unzip(archives: DataFrame, prefix: bool = True) -> DataFrame:
    """Members of ZIP archives as files, below the archive's path; damaged archives and folders give no rows."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for i in z.infolist():
                    if not i.is_dir():
                        out.append((f"{path}!/{i.filename}" if prefix else i.filename, i.file_size, z.read(i)))
            yield pd.DataFrame(out, columns=["path", "size", "content"])

    return archives.select("path", "content").mapInPandas(members, "path string, size long, content binary").withColumn("modified_at", F.lit(None).cast("timestamp"))


def data_format(path: str | None) -> str | None:
    """json, yaml, xml, toml or env by a path's extension; anything with ``.env`` in its path is env."""
    low = (path or "").lower()
    ext = low.rsplit(".", 1)[-1]
    if ext in ("json", "xml", "toml", "env"):
        return ext
    return "yaml" if ext in ("yaml", "yml") else "env" if ".env" in low else None


def parse_data(text: str, ext: str) -> object | None:
    """JSON (comments allowed), XML, TOML, ENV, and the block subset of YAML, as Python values; None if it cannot be read."""
    try:
        if ext == "json":
            try:
                return json.loads(text)
            except ValueError:  # comments of blocks, and of whole lines, which cannot stand inside an address
                return json.loads(re.sub(r"(?m)^\s*//.*$", "", re.sub(r"(?s)/\*.*?\*/", "", text)))
        if ext == "toml":
            import tomllib

            return tomllib.loads(text)
        if ext == "xml":
            return _xml(ET.fromstring(text))
        if ext == "env":
            return dict(re.findall(r"(?m)^\s*(?:export\s+)?([\w.]+)\s*=\s*['\"]?(.*?)['\"]?\s*$", text))
        if ext in ("yaml", "yml"):
            return _yaml(text)
    except (ValueError, ET.ParseError):
        return None
    return None


def _xml(e: ET.Element) -> object:
    kids: dict[str, list] = {}
    for c in e:
        kids.setdefault(c.tag, []).append(_xml(c))
    out = {**{f"@{k}": v for k, v in e.attrib.items()}, **{k: v[0] if len(v) == 1 else v for k, v in kids.items()}}
    text = (e.text or "").strip()
    return text if not out else {**out, **({"#text": text} if text else {})}


def _yaml(text: str) -> object:
    """Maps, lists and scalars by indentation; anchors, tags and flow collections stay text."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#") and x.strip() != "---"]

    def scalar(s: str) -> object:
        s = s.strip()
        if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
            return s[1:-1]
        low = s.lower()
        if low in ("null", "~", ""):
            return None
        if low in ("true", "false"):
            return low == "true"
        return int(s) if re.fullmatch(r"[+-]?\d+", s) else float(s) if re.fullmatch(r"[+-]?\d+\.\d*", s) else s

    def block(i: int, indent: int) -> tuple[object, int]:
        if i < len(rows) and rows[i][1].startswith("- "):
            out: list = []
            while i < len(rows) and rows[i][0] == indent and rows[i][1].startswith("- "):
                out.append(scalar(rows[i][1][2:]))
                i += 1
            return out, i
        got: dict = {}
        while i < len(rows) and rows[i][0] == indent:
            m = re.match(r"([^:]+):(?:\s+(.*))?$", rows[i][1])
            if not m:
                i += 1
                continue
            if m[2]:
                got[m[1].strip("'\" ")] = scalar(m[2])
                i += 1
            elif i + 1 < len(rows) and (rows[i + 1][0] > indent or rows[i + 1][1].startswith("- ")) and rows[i + 1][0] >= indent:
                got[m[1].strip("'\" ")], i = block(i + 1, rows[i + 1][0])
            else:
                got[m[1].strip("'\" ")] = None
                i += 1
        return got, i

    out, i = {}, 0
    while i < len(rows):
        part, j = block(i, rows[i][0])
        if isinstance(part, list):
            return part
        out.update(part)
        i = max(j, i + 1)
    return out


def _data_files(files: DataFrame) -> DataFrame:
    return files.select("path", "text").where(F.lower("path").rlike(r"\.(json|ya?ml|xml|toml|env)$|\.env"))


def _outline(which: int, columns: str) -> Callable:
    names = ["path", *(c.split()[0] for c in columns.split(", "))]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"]):
                v = parse_data(text or "", data_format(path) or "")
                out += [(path, *r) for r in data_sections(v)[which]] if v is not None else []
            yield pd.DataFrame(out, columns=names)

    return parse


def data_file_sections(files: DataFrame) -> DataFrame:
    """``path`` and ``SECTION_SCHEMA`` of data files (``path, text``); what cannot be read gives no row."""
    return _data_files(files).mapInPandas(_outline(0, SECTION_SCHEMA), f"path string, {SECTION_SCHEMA}")


def data_file_references(files: DataFrame) -> DataFrame:
    """``path`` and ``REFERENCE_SCHEMA`` of data files (``path, text``): addresses, packages and paths among their values."""
    return _data_files(files).mapInPandas(_outline(1, REFERENCE_SCHEMA), f"path string, {REFERENCE_SCHEMA}")


def sheet_rows(files: DataFrame) -> DataFrame:
    """``path, sheet, row_no, cells`` of CSV, TSV and XLSX files (``path, content``); the first row is the header."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}

    def xlsx(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
        z = zipfile.ZipFile(io.BytesIO(content))
        shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        for name in sorted(n for n in z.namelist() if re.match(r"xl/worksheets/\w+\.xml$", n)):
            rows = []
            for r in ET.fromstring(z.read(name)).iter(f"{{{ns['m']}}}row"):
                cells = []
                for c in r.findall("m:c", ns):
                    v = c.find("m:v", ns)
                    t = "" if v is None else v.text or ""
                    cells.append(shared[int(t)] if c.get("t") == "s" and t else t)
                rows.append(cells)
            yield name.rsplit("/", 1)[1][:-4], rows

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    if path.lower().endswith(".xlsx"):
                        sheets = list(xlsx(content))
                    else:
                        sheets = [("csv", list(csv.reader(io.StringIO(content.decode("utf-8", "replace")), delimiter="\t" if path.lower().endswith(".tsv") else ",")))]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, csv.Error):
                    continue
                out += [(path, s, i, row) for s, rows in sheets for i, row in enumerate(rows)]
            yield pd.DataFrame(out, columns=["path", "sheet", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(parse, "path string, sheet string, row_no long, cells array<string>")


def image_facts(files: DataFrame) -> DataFrame:
    """``path, format, width, height`` read from the headers of PNG, GIF and JPEG files."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, c in zip(b["path"], b["content"]):
                c = bytes(c or b"")
                if c[:8] == b"\x89PNG\r\n\x1a\n" and len(c) >= 24:
                    out.append((path, "png", int.from_bytes(c[16:20], "big"), int.from_bytes(c[20:24], "big")))
                elif c[:3] == b"GIF" and len(c) >= 10:
                    out.append((path, "gif", int.from_bytes(c[6:8], "little"), int.from_bytes(c[8:10], "little")))
                elif c[:2] == b"\xff\xd8":
                    i = 2
                    while i + 9 < len(c) and c[i] == 0xFF:
                        if 0xC0 <= c[i + 1] <= 0xCF and c[i + 1] not in (0xC4, 0xC8, 0xCC):
                            out.append((path, "jpeg", int.from_bytes(c[i + 7 : i + 9], "big"), int.from_bytes(c[i + 5 : i + 7], "big")))
                            break
                        i += 2 + int.from_bytes(c[i + 2 : i + 4], "big")
            yield pd.DataFrame(out, columns=["path", "format", "width", "height"])

    return files.select("path", "content").mapInPandas(parse, "path string, format string, width long, height long")


def document_paragraphs(files: DataFrame) -> DataFrame:
    """``path, paragraph_no, style, text`` of DOCX files; other formats need a registered parser and give no rows."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    continue
                for i, p in enumerate(body.iter(f"{w}p")):
                    style = p.find(f"{w}pPr/{w}pStyle")
                    out.append((path, i, None if style is None else style.get(f"{w}val"), "".join(t.text or "" for t in p.iter(f"{w}t"))))
            yield pd.DataFrame(out, columns=["path", "paragraph_no", "style", "text"])

    return files.select("path", "content").mapInPandas(parse, "path string, paragraph_no long, style string, text string")


# How languages spell functions and classes; the first group is the name.
SCOPES = {
    "py": {"function": r"(?m)^\s*(?:async\s+)?def\s+(\w+)", "class": r"(?m)^\s*class\s+(\w+)"},
    "ts": {"function": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)", "class": r"(?m)^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", "arrow": r"(?m)^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"},
    "go": {"function": r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)", "class": r"(?m)^type\s+(\w+)\s+struct"},
}


def code_scopes(files: DataFrame, lang, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, kind, name``: functions and classes by their spelling; a full parser can be registered instead."""
    t = "array<struct<kind:string,name:string>>"
    tagged = lambda names, kind: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    found = F.array().cast(t)
    for name, patterns in SCOPES.items():
        mine = lang.isin("ts", "tsx", "js", "jsx") if name == "ts" else lang == name
        for kind, p in patterns.items():
            got = tagged(F.regexp_extract_all(text_col, F.lit(p), 1), kind)
            found = F.concat(found, F.when(F.coalesce(mine, F.lit(False)), got).otherwise(F.array().cast(t)))
    return files.select(F.col(id_col).alias("id"), F.explode(found).alias("s")).select("id", "s.kind", "s.name")


def read_table(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """A table of an external source by its kind: any Spark format, JDBC included."""
    r = spark.read.format(kind)
    path = options.pop("path", None)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path) if path else r.load()


def run_sql(spark: SparkSession, query: str, params: dict | None = None, **views: DataFrame) -> DataFrame:
    """A parameterised SQL query over named DataFrames; parameters are bound, never spliced."""
    return spark.sql(query, args=params or {}, **views)


def export_conversations(turns: DataFrame, path: str, kind: str = "json") -> None:
    """Turns as JSON lines, or one Markdown line per message, partitioned by conversation order."""
    df = turns.sortWithinPartitions("conversation_id", "turn_no")
    if kind == "json":
        df.write.mode("errorifexists").json(path)
    else:
        df.select(F.concat(F.lit("**"), "role", F.lit("**: "), F.coalesce("content", F.lit(""))).alias("value")).write.mode("errorifexists").text(path)
