from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.patterns import compile_filter, convert_operator, glob_field, glob_names, glob_path, predicate, valid_regex

CASES = [
    ("AuthService", "*Service", False, True), ("ServiceAuth", "*Service", False, False), ("file.ts", "**/*.ts", True, True),
    ("src/sub/file.ts", "**/*.ts", True, True), ("src/file.ts", "*.ts", True, False), ("src/auth/service.ts", "**/auth/*", True, True),
    ("name", "?ame", False, True), ("frame", "?ame", False, False), ("AuthService", "*service", False, False), ("", "*Service", False, False),
    ("", "?ame", False, False), ("", "[abc]", False, False), ("", "*", False, False), ("file.ts.backup", "*.ts", False, False),
    ("test", "te.t", False, False), ("test", "te+t", False, False), ("test", "t(es)t", False, False), ("a", "[abc]", False, True),
    ("d", "[!abc]", False, True), ("a", "[^abc]", False, False), ("7", "[[:digit:]]", False, True), ("x", "[[:digit:]]", False, False),
    ("é", "[[:alpha:]]", False, True), ("Ω", "[[:lower:]]", False, False), ("Ω", "[[:upper:]]", False, True), ("٣", "[[:digit:]]", False, True), ("é", "[[:ascii:]]", False, False),
    ("z", "[[:ascii:]]", False, True), ("_", "[[:word:]]", False, True), ("\u00a0", "[[:blank:]]", False, True), ("a", "[[:print:]]", False, True), ("\x01", "[[:print:]]", False, False),
    ("dame", "[g-z]ame", False, False), ("name", "[^n]ame", False, False), ("game", "[g-z]ame", False, True), ("z", "[z-a]", False, True), ("m", "[z-a]", False, False),
    ("a/../b.ts", "a/**/b.ts", True, False), ("line\nbreak", "*", False, True),
]


def test_name_globs(spark):
    for text, glob, path, expected in CASES:
        got = spark.range(1).select(F.lit(text).rlike(glob_names(glob, path))).head()[0]
        assert got is expected, (text, glob, path)


def test_invalid_globs_and_regexes():
    assert glob_names("[abc") is None and glob_names("") is None
    assert [valid_regex(p) for p in ("[", "(unclosed", "*", "a+")] == [False, False, False, True]


def test_operator_conversion():
    assert convert_operator("STARTS WITH", "a.b") == ("=~", r"(?s)a\.b.*")
    assert convert_operator("IN", (1, 2)) == ("IN", [1, 2])
    assert convert_operator(">", 3) == (">", 3)
    assert convert_operator("GLOB", "a*")[0] == "=~"


def test_other_dialects(spark):
    m = lambda s, p: spark.range(1).select(F.lit(s).rlike(p)).head()[0]
    assert m("a/b.ts", glob_path("**/*.{ts,js}")) and not m("a/b.py", glob_path("**/*.{ts,js}"))
    assert m("ABC[1]", glob_field("abc[?]")) and not m("ABCD", glob_field("abc"))


def test_filter_semantics(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 3.0)], "n string, v double")
    ids = lambda c: sorted((r["n"] or "-") for r in df.where(c).collect())
    assert ids(compile_filter({"v": {"gte": 1, "lt": 4}})) == ["-", "a"]
    assert ids(compile_filter({"n": "a", "v": None})) == ["a"]
    assert ids(predicate("n", "!=", "a")) == ["b"]  # null never satisfies a predicate
    with pytest.raises(ValueError):
        predicate("n", "~~", 1)
    with pytest.raises(ValueError):
        compile_filter({"n": {"like": "x"}})
