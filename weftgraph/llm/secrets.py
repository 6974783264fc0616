"""Credentials in source and configuration files: where they stand, and the same bytes with them blanked.

Configuration files are parsed into key paths with offsets (``key_paths``), code by its assignments; a value is a
credential if its key name is sensitive and its shape is that of a secret. Credentials that no key names are found by
their own shape: private key blocks, user info and signed queries in addresses, Basic and Bearer headers, issuers'
tokens, split literals, command options and prose. Redactions are spliced into the original bytes, so everything else
stays as it was, line endings and escapes included.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from weftgraph.llm.key_paths import config_format, config_values


class Hit(NamedTuple):
    start: int  # offset in characters
    end: int
    key_path: str
    kind: str


# Words of key names that announce a credential, alone or as a pair of words.
SECRET_WORDS = frozenset(
    "password passwd pwd pass passphrase passcode secret token apikey bearer credential credentials kennwort passwort"
    " contrasena contraseña clave jeton authorization authheader secretkey privatekey signingkey encryptionkey clefapi motdepasse".split()
)
#: Endings that make a word of several run together, such as a name in capitals only, announce a credential.
SECRET_ENDINGS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "credential", "credentials", "kennwort", "passwort", "motdepasse")
KEY_OWNERS = frozenset("api secret signing encryption private access auth master service account shared hmac".split())
AUTH_PARTS = frozenset("header registry basic http proxy".split())
# Words of key names that make the value something about a credential instead.
ABOUT_WORDS = frozenset(
    "name ref reference from hint help label length count counts days limit max min file path id ids policy rotation"
    " type ttl expiry expires public placeholder prompt field title text description url uri bucket keyword size index"
    " format regex pattern version tokens algorithm header_name minlength".split()
)
# Beginnings that issuers give their tokens.
ISSUER = re.compile(
    r"(?:sk_live_[A-Za-z0-9]{12,}|sk_test_[A-Za-z0-9]{12,}|gh[pousr]_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{12,}"
    r"|xox[abprs]-[A-Za-z0-9\-]{12,}|AKIA[0-9A-Z]{16}\b|AIza[A-Za-z0-9_\-]{14,}|glpat-[A-Za-z0-9_\-]{12,}"
    r"|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-=]+\.[A-Za-z0-9_\-=]+|hf_[A-Za-z0-9]{16,})"
)
# a short prefix, as any issuer may use, and a long rest; ``_random`` tells it from a name
PREFIXED = re.compile(r"(?<![A-Za-z0-9_])[a-z]{2,6}_(?:[a-z]{2,8}_)?([A-Za-z0-9]{14,})(?![A-Za-z0-9_])")
KEY_MARK = re.compile(r"-----(BEGIN|END) (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
USER = re.compile(r"(?<=[a-zA-Z0-9+.\-])://[^\s:/@'\"`<>]*:")
ADDRESS_END = re.compile(r"[\s'\"`<>]")
HOST = re.compile(r"@[A-Za-z0-9\[][\w.\-\]]*(?::\d+)?(?:[/?#'\"`\s,;)]|$)")
QUERY = re.compile(
    r"[?&](?:access_token|auth_token|auth|token|api_?key|apikey|key|sig|signature|secret|client_secret|password|passwd|pwd|code)"
    r"=([^&\s'\"`<>#\\]{6,})",
    re.I,
)
HEADER = re.compile(r"\b(Basic|Bearer)\s+([A-Za-z0-9+/=_.\-:~]{8,})")
# Calls whose last literal after another one is a password.
CALL = re.compile(
    r"\b(?:log_?in|log_?on|sign_?in|connect|dial|authenticate|basic_?auth|set_?credentials|create_?connection)\s*\([^()\n]*?['\"`][^'\"`\n]*['\"`]\s*,\s*"
    r"(?:\w+\s*=\s*)?(?P<q>['\"`])(?P<v>[^'\"`\n]{6,})(?P=q)\s*,?\s*\)",
    re.I,
)
SPLIT = re.compile(
    r"(['\"])[^'\"\n]{4,}\1(?:[ \t]*(?:\+|\.)?[ \t]*\\?\r?\n[ \t]*(?:\+[ \t]*)?(['\"])[^'\"\n]{2,}\2)+"
)
PART = re.compile(r"(['\"])([^'\"\n]+)\1")
# Wordings that put a credential into prose, notes and commands.
PROSE = re.compile(
    r"(?:\b(?:login|user|account|konto|compte|cuenta|usuario|utilisateur|benutzer)\s+[\w.\-]+\s*/\s*"
    r"|\b(?:mot de passe|motdepasse|pw|pwd|passwd|pass(?:word|wort|phrase|code)?|kennwort|contraseña|contrasena|clave|jeton|secret|token"
    r"|(?:use|api|access|with|new|old|temp|la|the|der|die|clef|cl[eé])\s+(?:key|clef|clave|token|jeton))\b(?:\s+(?:for|of|pour|de|für|para)\s+[\w.\-]+)?(?:\s+(?:is|est|ist|es|was))?\s*[:=]?\s+"
    r")(?P<q>['\"`]?)(?P<v>[^\s'\"`]{6,})(?P=q)",
    re.I,
)
OPTION = re.compile(
    r"(?<!\S)(?:-p|--password[= ]|--token[= ]|--api-key[= ]|-u\s+[\w.\-]+:|PGPASSWORD=|MYSQL_PWD=|-a\s+)(?=['\"]?\S)(?P<q>['\"`]?)(?P<v>[^\s'\"`]{6,})(?P=q)",
    re.I,
)
KEYED = re.compile(
    r"(?P<k>[A-Za-z_À-ÿ][\w.\-À-ÿ]*)(?P<kq>[\"']?\]?)\s*(?::[ \t]*(?:string|str|String)\s*=|:=|=>|=|:)[ \t]*"
    r"(?:[rbfu]?(?P<q>\"\"\"|'''|[\"'`])(?P<qv>(?:(?!(?P=q))[^\r\n\\]|\\.)*)(?P=q)|(?P<uv>[^\s\"'`,;]+))"
)
DEFAULT = re.compile(
    r"(?:process\.env(?:\.(?P<a>\w+)|\[['\"](?P<a2>\w+)['\"]\])\s*(?:\|\||\?\?)\s*|(?:os\.getenv|os\.environ\.get|getenv|env)\(\s*['\"](?P<b>\w+)['\"]\s*,\s*"
    r"|\$\{(?P<c>\w+):-)(?P<q>['\"`]?)(?P<v>[^'\"`\s}]{4,})(?P=q)"
)
# What a line in lower case holds at least where the pattern of that name finds something on it.
MARKS = {
    "address": ("://",),
    "query": ("token=", "auth=", "key=", "sig=", "signature=", "secret=", "password=", "passwd=", "pwd=", "code="),
    "header": ("basic", "bearer"),
    "default": ("process.env", "getenv", "environ.get", "env(", ":-"),
    "keyed": (
        "pass", "pwd", "secret", "token", "key", "bearer", "credential", "kennwort", "contrase", "clave", "jeton", "auth", "clef", "schluessel", "cle",
    ),
    "prose": (
        "login", "user", "account", "konto", "compte", "cuenta", "usuario", "utilisateur", "benutzer", "passe", "pw", "pass", "kennwort", "contrase", "clave",
        "jeton", "secret", "token", "key", "clef",
    ),
    "option": ("-p", "--token", "--api-key", "-u", "pgpassword=", "mysql_pwd=", "-a"),
    "call": ("login", "log_in", "logon", "log_on", "signin", "sign_in", "connect", "dial", "authenticate", "basicauth", "basic_auth", "credentials"),
    "issuer": ("sk_live_", "sk_test_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_", "xox", "akia", "aiza", "glpat-", "eyj", "hf_"),
}
_OF_MARK: dict[str, list[str]] = {}
for _name, _marks in MARKS.items():
    for _mark in _marks:
        _OF_MARK.setdefault(_mark, []).append(_name)


def candidate_lines(text: str) -> dict[int, set[str]]:
    """Starts of lines with the names of the patterns whose marks stand on them; substring search is far faster than
    the patterns, and no line that a pattern finds something on lacks its mark."""
    low = text.lower()
    if len(low) != len(text):  # some letters change their length; then every pattern looks at every line
        return {i: set(MARKS) for i in [0, *(m.end() for m in re.finditer("\n", text))]}
    found: dict[int, set[str]] = {}
    for mark, names in _OF_MARK.items():
        i = low.find(mark)
        while i >= 0:
            found.setdefault(text.rfind("\n", 0, i) + 1, set()).update(names)
            i = text.find("\n", i)
            i = low.find(mark, i) if i >= 0 else -1
    return found


PLACEHOLDER = re.compile(
    r"""^(?:
      <.*>|\[.*\]|\{\{.*|\$\{?.*|%\(?\w+.*|@@.*|\#\{.*
      |(.)\1{3,}.*|[x*.•_\-]+
      |(?:your|votre|ihr|dein|tu|su|my|mein|mon)[-_ ].*
      |(?:please[-_ ]?)?(?:insert|replace|change|put|add|enter)[-_ ]?(?:me|your|secret|this|here|it|in|moi|with|with_).*
      |(?:changeme|placeholder|redacted|masked|hidden|removed|dummy|sample|example|beispiel|exemple|ejemplo)(?:[-_ ]?(?:value|key|token|password|secret))?\d*
      |(?:todo|fixme|tbd|none|null|nil|undefined|true|false|test|testing|secret|password|passwd|token|default|empty|unset|n/?a|xxx+)
      )$""",
    re.I | re.X,
)
REFERENCE = re.compile(
    r"^(?:file:|arn:|vault:|secret:|secrets?[/.]|ssm:|op://|env:|keyring:|gcp:|aws:|azure:|/run/|/etc/|/var/|\.{0,2}/|~/"
    r"|process\.|os\.|env\.|config\.|self\.|this\.|options?\.|settings\.|import\.|System\.|ENV\b|getenv|data:)"
    r"|-credentials?$|^[a-z][a-z0-9\-]*-(?:secret|token|credentials?|password|key)s?$",
    re.I,
)
CODE = frozenset("ts tsx js jsx mjs cjs py go java rb rs php c cc cpp h cs kt swift scala".split())
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ÿ]+|\d+")
COMMENT = re.compile(r"^\s*(?://|#|/?\*|--|<!--|;|\"\"\"|''')")


def key_words(key: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(key)]


def sensitive_key(key: str) -> bool:
    """Whether a key name announces a credential: a secret word that no other word turns into something about it."""
    words = key_words(key)
    if not words or any(w in ABOUT_WORDS for w in words):
        return False
    joined = "".join(words)
    pairs = {a + b for a, b in zip(words, words[1:])} | {a + b + c for a, b, c in zip(words, words[1:], words[2:])}
    if joined in SECRET_WORDS or any(w in SECRET_WORDS or w.endswith(SECRET_ENDINGS) for w in words) or pairs & SECRET_WORDS:
        return True
    if any(w == a + "auth" or w == "auth" + a for w in words for a in AUTH_PARTS):
        return True
    return any(
        (b in ("key", "clef", "schluessel") and a in KEY_OWNERS) or (a in ("clef", "cle") and b == "api") or (b == "auth" and a in AUTH_PARTS) or (a == "auth" and b in AUTH_PARTS)
        for a, b in zip(words, words[1:])
    )


def placeholder(v: str) -> bool:
    return not v.strip() or bool(PLACEHOLDER.match(v.strip())) or "${" in v or "{{" in v or v.startswith("AKIAEXAMPLE")


def _random(rest: str) -> bool:
    """Whether letters and digits look drawn, not named: both cases, several digits in several places."""
    digits = re.findall(r"\d+", rest)
    return len(digits) >= 2 and sum(map(len, digits)) >= 3 and rest.lower() != rest and rest.upper() != rest


def prefixed_token(v: str) -> bool:
    m = PREFIXED.fullmatch(v)
    return bool(m) and _random(m[1])


def secret_shape(v: str, strict: bool = False, literal: bool = False) -> bool:
    """Whether a value can be a secret: long enough, not a word, number, version, path, reference or placeholder.

    ``literal``: it comes from a format without expressions, so brackets and commas speak for none. ``strict``: nothing
    but its shape speaks for it.
    """
    if len(v) < 6 or placeholder(v) or REFERENCE.search(v) or any(c.isspace() for c in v):
        return False
    if ISSUER.match(v) or prefixed_token(v):
        return True
    if not literal and re.search(r"[()\[\]{}<>;,]", v) and not re.search(r"[!#@^&*~%$]", v):
        return False
    digits, letters = any(c.isdigit() for c in v), any(c.isalpha() for c in v)
    if re.fullmatch(r"v?\d+(?:[.\-_]\d+)*[a-z]?|[\d.,:+\-_/ ]+(?:ms|s|m|h|d|kb|mb|gb|px)?", v, re.I):
        return False
    if re.fullmatch(r"(?:[\w.\-]+/)+[\w.\-]*", v) and ("." in v.rsplit("/", 1)[1] or not digits):
        return False
    symbols = sum(not c.isalnum() for c in v)
    if not letters:
        return False
    if strict:
        return len(v) >= 8 and digits or symbols >= 2 and len(v) >= 8 and v.lower() != v
    if not digits:
        # no digit: mixed case with symbols, or long and mixed, as passwords and random tokens are
        mixed = v.lower() != v and v.upper() != v
        return len(v) >= 8 and (mixed and symbols > 0 and not re.fullmatch(r"[A-Za-z][\w.\-]*", v) or len(v) >= 24 and mixed and "_" not in v and "." not in v)
    return len(v) >= 6 and (len(v) >= 8 or symbols > 0)


def basic_secret(b64: str) -> bool:
    try:
        user, colon, word = base64.b64decode(b64 + "=" * (-len(b64) % 4), validate=True).decode("utf-8").partition(":")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    return bool(colon) and user.isprintable() and bool(word) and word.isprintable() and not placeholder(word)


def _private_keys(text: str) -> Iterator[Hit]:
    """Blocks from a BEGIN line to the next END line with enough of a body, of any length."""
    begin = None
    for m in KEY_MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin:
            body = re.sub(r"\\[a-z]|[^A-Za-z0-9+/]", "", text[begin.end() : m.start()])
            if len(body) >= 40 and len(set(body)) > 1:  # a blanked key has one letter
                yield Hit(begin.start(), m.end(), "", "private_key")
            begin = None


def name_before(text: str, at: int) -> str | None:
    """The name that the value at a place is assigned to: what stands before the nearest ``=``, ``:=`` or ``:``."""
    def blanks(i: int) -> int:
        while i and text[i - 1].isspace():
            i -= 1
        return i

    i = blanks(at)
    if not i or text[i - 1] not in "=:":
        return None
    i -= 1
    if text[i] == "=" and i and text[i - 1] == ":":
        i -= 1
    i = blanks(i)
    if i and text[i - 1] in "\"'":
        i -= 1
    end = i
    while i and (text[i - 1].isalnum() or text[i - 1] in "_.-"):
        i -= 1
    return text[i:end].lstrip("0123456789.-") or None


class _Line(NamedTuple):
    text: str
    code: bool  # a programming language, not a comment


def _address(x: _Line) -> Iterator[tuple]:
    for m in USER.finditer(x.text):
        end = ADDRESS_END.search(x.text, m.end())
        stop = end.start() if end else len(x.text)
        other = x.text.find("://", m.end(), stop)
        stop = other if other >= 0 else stop
        at = x.text.rfind("@", m.end() + 3, stop)
        while at >= 0 and not HOST.match(x.text, at):
            at = x.text.rfind("@", m.end() + 3, at)
        v = x.text[m.end() : at]
        if at >= 0 and not placeholder(v) and not re.search(r"[${<]", v[:2]):
            yield m.end(), at, ""


def _query(x: _Line) -> Iterator[tuple]:
    return ((*m.span(1), "") for m in QUERY.finditer(x.text) if secret_shape(m[1]))


def _header(x: _Line) -> Iterator[tuple]:
    for m in HEADER.finditer(x.text):
        if basic_secret(m[2]) if m[1] == "Basic" else secret_shape(m[2], strict=True):
            yield *m.span(2), ""


def _default(x: _Line) -> Iterator[tuple]:
    for m in DEFAULT.finditer(x.text):
        name = m["a"] or m["a2"] or m["b"] or m["c"]
        if sensitive_key(name) and secret_shape(m["v"]):
            yield *m.span("v"), name


def _keyed(x: _Line) -> Iterator[tuple]:
    for m in KEYED.finditer(x.text):
        # a bare word is a literal only in formats without expressions, and in comments and prose
        if not sensitive_key(m["k"].rsplit(".", 1)[-1]) or (x.code and not m["q"]):
            continue
        group = "qv" if m["q"] else "uv"
        v = m[group] if m["q"] else re.sub(r"(?:\*/|-->)$", "", m[group])
        if secret_shape(v):
            yield m.start(group), m.start(group) + len(v), m["k"]


def _prose(x: _Line) -> Iterator[tuple]:
    return _said(PROSE, x)


def _option(x: _Line) -> Iterator[tuple]:
    return _said(OPTION, x)


def _said(pattern: re.Pattern, x: _Line) -> Iterator[tuple]:
    for m in pattern.finditer(x.text):
        v = m["v"].rstrip(".,;)")
        if secret_shape(v, strict=True) and not re.match(r"https?:|\w+://", v):
            yield m.start("v"), m.start("v") + len(v), ""


def _call(x: _Line) -> Iterator[tuple]:
    return ((*m.span("v"), "") for m in CALL.finditer(x.text) if secret_shape(m["v"]))


def _issuer(x: _Line) -> Iterator[tuple]:
    for m in ISSUER.finditer(x.text):
        if not placeholder(m[0]) and (m.start() == 0 or not re.match(r"[A-Za-z0-9+/]", x.text[m.start() - 1])):
            yield *m.span(), ""


SCANS: dict[str, Callable[[_Line], Iterator[tuple]]] = {
    "address": _address, "query": _query, "header": _header, "default": _default, "keyed": _keyed, "prose": _prose, "option": _option,
    "call": _call, "issuer": _issuer,
}


def _configured(text: str, kind: str | None) -> Iterator[Hit]:
    """Values of sensitive keys of a configuration file. One over several lines counts by its first."""
    for path, pieces in config_values(text, kind):
        if sensitive_key(path.rsplit(".", 1)[-1]) and secret_shape("".join(text[s:e] for s, e in pieces), literal=True):
            for n, (s, e) in enumerate(pieces):
                yield Hit(s, e, path, "keyed-rest" if n else "keyed")


def _split(text: str) -> Iterator[Hit]:
    """Literals cut in two or more over several lines, each part a hit; the first counts."""
    for m in SPLIT.finditer(text):
        parts = list(PART.finditer(text, *m.span()))
        whole = "".join(p[2] for p in parts)
        if not (ISSUER.match(whole) or prefixed_token(whole) or re.fullmatch(r"[^\s'\"`,;(){}<>]{20,}", whole) and secret_shape(whole, strict=True)):
            continue
        name = name_before(text, m.start())
        if name:
            for n, p in enumerate(parts):
                yield Hit(*p.span(2), name, "split-rest" if n else "split")


def find_credentials(text: str, source_path: str | None) -> list[Hit]:
    """Credentials of one file, by start, without overlaps; of overlapping finds the first and longest stays."""
    if not text:
        return []
    kind = config_format(source_path)
    ext = (source_path or "").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    hits = list(_private_keys(text)) if "PRIVATE KEY" in text else []
    hits += _configured(text, kind)
    for lo, names in candidate_lines(text).items():
        hi = text.find("\n", lo)
        line = text[lo : hi if hi >= 0 else len(text)]
        x = _Line(line, ext in CODE and not COMMENT.match(line))
        for name in names:
            hits += (Hit(lo + s, lo + e, key, name) for s, e, key in SCANS[name](x))
    hits += (Hit(*m.span(), "", "issuer") for m in PREFIXED.finditer(text) if _random(m[1]))
    hits += _split(text)
    # of equal spans the one with the longest key path
    hits.sort(key=lambda h: (h.start, -h.end, -len(h.key_path), h.kind))
    out: list[Hit] = []
    for h in hits:
        if not out or h.start >= out[-1].end:
            out.append(h)
    return out


#: A letter: a value of it is plain in every format, where an asterisk would be a pattern, an alias or a pointer.
MASK = "X"
_UNIT = re.compile(
    r"\\u\{[0-9A-Fa-f]+\}|\\N\{[^}\n]*\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\[0-7]{2,3}|\\.|[\r\n]|[^\\\r\n]+|\\", re.S
)
_KEY_UNIT = re.compile(r"\\u[0-9A-Fa-f]{4}|\\.|[A-Za-z0-9+/=]+", re.S)


def _masked(unit: str) -> str:
    """One unit of a literal blanked: escapes of a character stay escapes of the same length, others stay."""
    if unit[0] in "\r\n":
        return unit
    if unit[0] != "\\":
        return MASK * len(unit.encode("utf-8", "surrogatepass"))
    code = f"{ord(MASK):x}"
    if unit[1:3] == "u{":
        digits = len(unit) - 4
        return f"\\u{{{code.rjust(digits, '0') if digits > 1 else '9'}}}"
    if unit[1:2] in ("u", "U", "x") and len(unit) > 2:
        return unit[:2] + code.rjust(len(unit) - 2, "0")
    if len(unit) > 2 and unit[1].isdigit():
        return f"\\{ord(MASK):o}" if len(unit) == 4 else "\\60"
    return unit


def _blanked(value: str, kind: str) -> str:
    if kind != "private_key":
        return _UNIT.sub(lambda m: _masked(m[0]), value)
    # the marks of the block stay, and so do quotes and signs where literals of several lines make it up
    first, last = (list(KEY_MARK.finditer(value))[i] for i in (0, -1))
    body = value[first.end() : last.start()]
    return value[: first.end()] + _KEY_UNIT.sub(lambda m: m[0] if m[0] in "+=" else _masked(m[0]), body) + value[last.start() :]


def redact(text: str, hits: list[Hit]) -> str:
    """The same text with every credential's characters replaced; length in bytes, lines and quotes stay.

    Line breaks (real ones and escaped ones) inside a value are kept, and an escape of a character becomes one of the
    mask, so line numbers and the syntax around and within the value are unharmed. ASCII only is written, one character
    per byte of the original.
    """
    parts, at = [], 0
    for h in hits:
        parts += [text[at : h.start], _blanked(text[h.start : h.end], h.kind)]
        at = h.end
    parts.append(text[at:])
    return "".join(parts)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for uuid, path, text in zip(b["file_uuid"], b["source_path"], b["file_content"]):
            if not isinstance(text, str):
                continue
            line, at, byte = 1, 0, 0
            for h in find_credentials(text, path):
                line += text.count("\n", at, h.start)
                byte += len(text[at : h.start].encode("utf-8", "surrogatepass"))
                at = h.start
                if not h.kind.endswith("-rest"):
                    size = len(text[h.start : h.end].encode("utf-8", "surrogatepass"))
                    out.append((uuid, path, line, byte, byte + size, h.key_path, h.kind))
        yield pd.DataFrame(out, columns=["file_uuid", "source_path", "line_no", "start_byte", "end_byte", "key_path", "kind"])


def credentials(files: DataFrame) -> DataFrame:
    """One row per credential: ``file_uuid, source_path, line_no, start_byte, end_byte, key_path, kind``.

    One pass over the files without a shuffle but for the last ``distinct``, which merges redelivered rows. Null
    content gives no row, a null path only means that the format is unknown. Other columns are not read.
    """
    return (
        files.where("file_content is not null")
        .select("file_uuid", "source_path", "file_content")
        .mapInPandas(_rows, "file_uuid string, source_path string, line_no bigint, start_byte bigint, end_byte bigint, key_path string, kind string")
        .distinct()
    )


def _redacted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [find_credentials(t, p) if isinstance(t, str) else [] for p, t in zip(b["source_path"], b["file_content"])]
        b["file_content"] = [redact(t, h) if h else t for t, h in zip(b["file_content"], found)]
        b["n_redacted"] = [sum(not x.kind.endswith("-rest") for x in h) for h in found]
        yield b


def redact_files(files: DataFrame) -> DataFrame:
    """Every row with its credentials blanked in ``file_content`` and their number in ``n_redacted``; no shuffle."""
    return files.select("file_uuid", "source_path", "file_content").mapInPandas(
        _redacted, "file_uuid string, source_path string, file_content string, n_redacted bigint"
    )
