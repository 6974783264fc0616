"""Generated, minified or vendored source files, told from hand-written ones by a random forest.

Files are labelled by marks that are hidden from the features: a notice in a comment, a tool's file name, a body that is
one literal. The forest learns what labelled files look like from the rest (compression ratio, token entropy, identifier
lengths, comment density, shapes of lines, kinds of folders) and its score decides every file without a notice. A notice
itself is a certain label, for all files with that body: files copied from a package look like hand-written ones.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.sampling import bounded_sample
from weftgraph.llm.trees import fit_forest
from weftgraph.session import Scratch

#: Most bodies that the forest is fitted on.
SAMPLE_ROWS = 20_000
#: Shorter bodies are no evidence that one file is a copy of another.
LEAST_COPY_CHARS = 80
#: A code file of at least so many characters with at most so many names outside its literals is data.
LEAST_BLOB_CHARS, FEW_NAMES = 400, 4

# Wordings by which a tool or a bundler marks a file as its own.
NOTICE = re.compile(
    r"""
    @generated\b|<auto-?generated\b|\bauto-?generated\s+(?:file|code|by|from)\b|\bautogen\s*:
    |\bcode\s+generated\s+(?:by|from)\b|\bthis\s+(?:file|code)\s+(?:was|is|has\s+been)\s+(?:automatically\s+|auto-?)?generated\b
    |^\W*(?:automatically\s+|auto-?)?generated\s+(?:by|from|with|using)\b|\bmachine[-\s](?:written|generated)\s+by\b
    |\bcodegen\s+output\b|^\W*output\s+of\s+`|\bregenerate\s+instead\b|\bedits\s+(?:are|will\s+be)\s+(?:overwritten|lost|discarded)\b
    |\bg[ée]n[ée]r[ée]e?\s+automatiquement\s+(?:par|[àa]\s+partir)\b|\bfichier\s+g[ée]n[ée]r[ée]\b|\barchivo\s+generado\s+(?:por|autom)
    |\bautomatisch\s+(?:erzeugt|generiert)\s+(?:aus|von|durch)\b
    |^/\*!\s*[\w.\-]+\s+v?\d+\.\d+(?:\.\d+)?\s*\*/
    """,
    re.I | re.X | re.M,
)
# Wordings by which a copy names the package that it comes from.
COPY_NOTICE = re.compile(
    r"""
    @license\s+[\w.\-]+\s+v?\d|\bbundled\s+copy\s+of\b|\bvendored\s+(?:copy|from)\b|\bcopie\s+locale\s+de\s+la\s+biblioth[èe]que\b
    |\bupstream:\s*\w+://|\(c\)\s+[\w.\-]+\s+contributors\s*\|\s*released\s+under\b|\blokale\s+kopie\s+der\s+bibliothek\b|\bcopia\s+local\s+de\s+la\s+biblioteca\b
    """,
    re.I | re.X | re.M,
)
# Notices that say the opposite.
BY_HAND = re.compile(r"\b(?:by\s+hand|used\s+to\s+be|no\s+code\s+was\s+copied|builds?\s+the\s+header|writes\s+the\s+header)\b", re.I)
HEAD_LINES = 12
# How comments begin, and how those end that may take several lines.
COMMENT_START = re.compile(r"\s*(//|#(?!!)|/\*|\*|--|<!--|\"\"\"|''')")
BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
DOCSTRINGS = frozenset(('"""', "'''"))
BLOCK_ENDS = re.compile(r"/\*|\*/|<!--|-->|\"\"\"|'''")
# Folders that hold other people's packages, one folder per package.
PACKAGE_FOLDERS = frozenset("node_modules bower_components vendor third_party third-party thirdparty site-packages external externals deps pods".split())
OUTPUT_FOLDERS = frozenset("dist build-output out gen generated __generated__ autogen _generated".split())
# Parts of file names that tools give their output.
OUTPUT_PARTS = frozenset("min bundle pb pb2 g gen generated designer prod".split())
LOCK_FILES = re.compile(r"^(?:package-lock\.json|npm-shrinkwrap\.json|(?:pnpm|yarn)-?lock\.(?:yaml|yml|json)|pnpm-lock\.yaml|yarn\.lock|poetry\.lock|pipfile\.lock|composer\.lock|cargo\.lock|gemfile\.lock|go\.sum|uv\.lock)$", re.I)
CODE_TYPES = frozenset("ts tsx js jsx mjs cjs py go java rb rs php c cc cpp h cs kt swift scala".split())
TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d+(?:\.\d+)?|[^\s\w]")
IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*")
WORDS = re.compile(r"\w+")
# the first number of a line; what tools write tends to count up from line to line
FIRST_NUMBER = re.compile(r"(?m)^[^\d\n]*(\d{1,9})")
COMMENT = re.compile(r"/\*.*?\*/|\"\"\".*?\"\"\"|(?m:^\s*(?://|#(?!!)|\*|--).*$)", re.S)
LITERAL = re.compile(r"'''(?s:.*?)'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|\b\d+(?:\.\d+)?\b")
BLOB = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")

FEATURES = (
    "size", "ratio", "entropy", "identifier", "short_identifiers", "comments", "longest_line", "mean_line", "digits",
    "blanks", "line_shapes", "blob", "output_folder", "is_code", "is_style", "is_config", "numbers", "counting", "package_folder",
)


# A text without any of these in lower case has no notice.
NOTICE_MARKS = ("generat", "autogen", "codegen", "machine", "output of", "edits ", "/*!", "g\u00e9n\u00e9r", "gener\u00e9", "g\u00e9ner", "erzeugt", "generiert", "generado")
COPY_MARKS = ("@license", "copy of", "vendored", "copie locale", "upstream:", "contributors", "kopie der", "copia local")


def has_notice(text: str, wording: re.Pattern = NOTICE) -> bool:
    """Whether the file's head or a comment anywhere says that a tool made it (or, with ``COPY_NOTICE``, where it was copied from)."""
    low = text.lower()
    if not any(m in low for m in (COPY_MARKS if wording is COPY_NOTICE else NOTICE_MARKS)):
        return False
    head = "\n".join(text.split("\n", HEAD_LINES)[:HEAD_LINES])[:4000]
    if any(not BY_HAND.search(_line(head, m.start())) for m in wording.finditer(head)):
        return True
    return any(_says(c, wording) for _, c in _comments(text.split("\n")))


def _says(comment: str, wording: re.Pattern) -> bool:
    return bool(wording.search(comment)) and not BY_HAND.search(comment)


def _comments(lines: list[str]) -> Iterator[tuple[int, str]]:
    """(line number from 0, comment) of comment lines, lines of block comments and of a docstring before any code, and
    comments at the end of a line; these last only without quotes, which may end a literal around them."""
    close, code = "", False
    for i, line in enumerate(lines):
        if close:
            end = line.find(close)
            yield i, line if end < 0 else line[: end + len(close)]
            if end >= 0:
                close = ""
            continue
        m = COMMENT_START.match(line)
        if m and m[1] in BLOCKS and not (code and m[1] in DOCSTRINGS):
            end = line.find(BLOCKS[m[1]], m.end())
            close = BLOCKS[m[1]] if end < 0 else ""
            yield i, line if end < 0 else line[: end + len(BLOCKS[m[1]])]
            line = "" if end < 0 else line[end + len(BLOCKS[m[1]]) :]
        elif m and m[1] not in BLOCKS:
            yield i, line
            continue
        code = code or bool(line.strip())
        at = max(line.rfind("/*"), line.rfind(" //"), line.rfind(";//"), line.rfind(" # "))
        if at >= 0 and not re.search("[\"'`]", line[at:]):
            yield i, line[at:].lstrip(" ;")


def _line(text: str, at: int) -> str:
    return text[text.rfind("\n", 0, at) + 1 : (text + "\n").index("\n", at)]


def without_notice(text: str) -> str:
    """The text without the comment lines of its head, where notices stand, and without notices further down."""
    lines = text.replace("\r\n", "\n").split("\n")
    k = 0
    while k < min(len(lines), HEAD_LINES) and re.match(r"\s*(?://|#|/?\*|--|<!--|'use strict'|\"use strict\"|$)", lines[k]):
        # a banner may share its line with code
        rest = re.sub(r"^\s*/\*.*?\*/", "", lines[k])
        if rest != lines[k] and rest.strip():
            lines[k] = rest
            break
        k += 1
    low = text.lower()
    if any(m in low for m in NOTICE_MARKS + COPY_MARKS):
        gone = [(i, c) for i, c in _comments(lines) if i >= k and (_says(c, NOTICE) or _says(c, COPY_NOTICE))]
        for i, c in gone:
            # the ends of a block of several lines stay, and so does code on the line
            ends = BLOCK_ENDS.findall(c)
            lines[i] = lines[i].replace(c, ends[0] if len(ends) == 1 else "", 1)
        blank = {i for i, _ in gone if not lines[i].strip()}
        lines = [x for i, x in enumerate(lines) if i not in blank]
    return "\n".join(lines[k:])


def path_facts(path: str | None) -> tuple[bool, float, bool, str]:
    """(in a package folder, in an output folder, named as tools name their output, extension)."""
    parts = (path or "").lower().split("/")
    folders, name = parts[:-1], parts[-1]
    package = any(f in PACKAGE_FOLDERS and i + 1 < len(folders) for i, f in enumerate(folders))
    stem, _, ext = name.rpartition(".")
    words = stem.split(".")[1:] + re.findall(r"[-_](pb2?|prod|bundle|min)$", stem)
    named = ext in CODE_TYPES | {"css", "scss"} and any(w in OUTPUT_PARTS for w in words)
    return package, float(any(f in OUTPUT_FOLDERS for f in folders)), bool(LOCK_FILES.match(name)) or named, ext


def file_features(text: str, path: str | None) -> list[float]:
    """The features in the order of ``FEATURES``; notices and names are not among what they see."""
    package, folder, _, ext = path_facts(path)
    body = without_notice(text)
    n = max(1, len(body))
    plain = COMMENT.sub("", body)
    tokens = TOKEN.findall(plain)
    count = Counter(tokens)
    total = max(1, len(tokens))
    freq = np.fromiter(count.values(), dtype=float, count=len(count)) / total
    entropy = float(-(freq * np.log2(freq)).sum()) / max(1.0, np.log2(total)) if len(count) else 0.0
    # over distinct tokens with their counts, which are far fewer than the tokens
    ids = [(len(t), c) for t, c in count.items() if t[0].isalpha() or t[0] in "_$"]
    n_ids = max(1, sum(c for _, c in ids))
    lines = body.split("\n")
    full = sum(not x.isspace() and x != "" for x in lines)
    shapes = set(map(str.strip, WORDS.sub("w", body).split("\n"))) - {""}
    firsts = [int(x) for x in FIRST_NUMBER.findall(body)]
    raw = body.encode("utf-8", "surrogatepass")
    octets = np.frombuffer(raw, dtype=np.uint8)
    return [
        float(np.log1p(n)),
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        entropy,
        sum(k * c for k, c in ids) / n_ids,
        sum(c for k, c in ids if k <= 2) / n_ids,
        1 - len(plain) / n,
        float(np.log1p(max(map(len, lines)))),
        float(np.log1p(n / max(1, full))),
        float(((octets >= 48) & (octets <= 57)).sum()) / max(1, len(raw)),
        float((octets <= 32).sum()) / max(1, len(raw)),
        len(shapes) / max(1, full),
        sum(len(x) for x in BLOB.findall(body)) / n,
        folder,
        float(ext in CODE_TYPES),
        float(ext in ("css", "scss", "less")),
        float(ext in ("json", "yaml", "yml", "toml", "env", "xml", "ini")),
        sum(c for t, c in count.items() if t[0].isdigit()) / total,
        sum(b == a + 1 for a, b in zip(firsts, firsts[1:])) / max(1, full),
        float(package),
    ]


def body_digest(text: str) -> str | None:
    """A digest of the code itself, without comments of the head and white space; null if there is too little."""
    body = "".join(without_notice(text).split())
    return hashlib.md5(body.encode("utf-8", "surrogatepass")).hexdigest() if len(body) >= LEAST_COPY_CHARS else None


def is_one_literal(text: str, path: str | None) -> bool:
    """Data saved as code: hardly any names stand outside the literals of a code file of some length."""
    body = without_notice(text)
    if path_facts(path)[3] not in CODE_TYPES or len(body) < LEAST_BLOB_CHARS:
        return False
    return len(IDENTIFIER.findall(LITERAL.sub(" ", COMMENT.sub("", body)))) <= FEW_NAMES


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for uuid, path, text in zip(b["file_uuid"], b["source_path"], b["file_content"]):
            noticed = has_notice(text) or has_notice(text, COPY_NOTICE)
            marked = noticed or path_facts(path)[2] or is_one_literal(text, path)
            out.append((uuid, body_digest(text) or f"of {uuid}", noticed, marked, file_features(text, path)))
        yield pd.DataFrame(out, columns=["file_uuid", "body", "noticed", "marked", "x"])


def labelled_bodies(feats: DataFrame) -> DataFrame:
    """``body, noticed, marked, x``: bodies with the marks of all their files, and the features of the first one."""
    first = F.min(F.struct("file_uuid", "x"))["x"]
    return feats.groupBy("body").agg(F.max("noticed").alias("noticed"), F.max("marked").alias("marked"), first.alias("x"))


def fit_origin(bodies: pd.DataFrame):
    """(forest, labelled share outside and inside package folders) from ``body, marked, x``.

    Not all foreign files bear a mark, so the forest learns from labelled and unlabelled ones: what it gives is the
    chance of a mark. The mean chance that trees give labelled files which they did not see is how often foreign files
    are marked, and divides it (Elkan and Noto); it differs inside package folders, where few copies have a notice.
    """
    sample = bodies.sort_values("body")
    x = np.array(sample["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    y = sample["marked"].to_numpy(dtype=float)
    # a body counts once, and leaves hold a dozen, so no library that was copied often is learned by heart
    forest = fit_forest(x, y, n_trees=60, max_depth=9, min_leaf=12, features=0.3)
    inside = x[:, -1] > 0
    shares = []
    for part in (~inside, inside):
        held = forest.oob[part & (y == 1) & ~np.isnan(forest.oob)] if len(y) else np.array([])
        shares.append(max(float(held.mean()), 1e-3) if len(held) else None)
    out, own = shares[0] or shares[1] or 1.0, shares[1] or shares[0] or 1.0
    return forest, (out, own)


def foreign_scores(files: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``file_uuid, noticed, score``: how likely a file was not written by hand.

    One pass over the contents makes features, marks and body; a bounded sample of bodies fits the forest; a pass over
    the features predicts. ``noticed``: a file with this body has a notice, which makes the score 1. Null contents give
    no row, rows of one uuid count once.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "origin")
    rows = files.where("file_content is not null and file_uuid is not null").select("file_uuid", "source_path", "file_content")
    feats = scratch.write(rows.mapInPandas(_rows, "file_uuid string, body string, noticed boolean, marked boolean, x array<double>"), "features")
    bodies = scratch.write(labelled_bodies(feats), "bodies")
    drawn = bounded_sample(bodies, F.col("body"), sample_rows, bodies.count()).select("body", "marked", "x").toPandas()
    forest, shares = fit_origin(drawn)
    forest.oob = None
    model = spark.sparkContext.broadcast((forest, shares))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, (outside, inside) = model.value
        for b in batches:
            m = np.array(b["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
            out = b[["file_uuid", "body"]].copy()
            out["score"] = np.minimum(1.0, f.predict(m) / np.where(m[:, -1] > 0, inside, outside))
            yield out

    scored = feats.select("file_uuid", "body", "x").mapInPandas(score, "file_uuid string, body string, score double")
    # a row per noticed body on the right, so a body that many files share lies on the side that AQE can split
    source = bodies.where("noticed").select("body", F.lit(True).alias("noticed"))
    got = scored.join(source.hint("merge"), "body", "left").withColumn("noticed", F.coalesce("noticed", F.lit(False)))
    return got.groupBy("file_uuid").agg(F.max("noticed").alias("noticed"), F.max(F.when(F.col("noticed"), 1.0).otherwise(F.col("score"))).alias("score"))


def foreign_files(files: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``file_uuid`` of the files that no one wrote by hand here: those whose score is above the threshold."""
    return foreign_scores(files).where(F.col("score") > threshold).select("file_uuid")
