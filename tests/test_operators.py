"""Hand-computed cases of traversal, retrieval, ETL, turns, text, sources and streams."""

from __future__ import annotations

import io
import math
import re
import zipfile
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftgraph.functions.text import REFERENCE_PATTERNS, chunk_text, code_blocks, data_sections, extract_references, page_facts, page_links, repository_of, sections
from weftgraph.operators import etl as E
from weftgraph.operators import retrieval as V
from weftgraph.operators import traverse as T
from weftgraph.operators import turns as U
from weftgraph.operators.entities import canonical_of_members, name_members, similar_names
from weftgraph.semantics import cosine, euclidean_similarity, full_match, sum0
from weftgraph.sources.files import SCOPES, data_file_sections, document_paragraphs, image_facts, parse_data, run_sql, sheet_rows, unzip, virtual_files, with_text
from weftgraph.streaming.changes import coalesce_changes, run_available, unique_within


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("a", "b")], "src string, dst string")


def test_expand_keeps_paths_and_uses_an_edge_once(spark, edges):
    e = edges.withColumn("edge_id", F.monotonically_increasing_id()).persist()
    got = T.expand(spark.createDataFrame([("a",)], "id string"), e, 2)
    assert sorted((r["node"], r["depth"]) for r in got.collect()) == [("a", 1), ("b", 1), ("b", 1), ("b", 2), ("b", 2), ("c", 2), ("c", 2)]


def test_both_directions_count_a_loop_once(edges):
    assert T.oriented(edges, "both").count() == 9
    with pytest.raises(ValueError):
        T.oriented(edges, "sideways")


def test_rows_without_neighbours_keep_an_empty_list(spark, edges):
    rows = spark.createDataFrame([("a",), ("z",)], "id string")
    got = {r["id"]: len(r["related"]) for r in T.with_related(rows, "id", T.expand(rows, edges, 1)).collect()}
    assert got == {"a": 3, "z": 0}


def test_fuzzy_file_tiers(spark):
    files = spark.createDataFrame([(p,) for p in ("/x/src/util.ts", "/x/lib/only.ts", "/x/a/twin.ts", "/x/b/twin.ts", "/x/c/resolver.ts")], "path string")
    refs = spark.createDataFrame([(r,) for r in ("src/util.ts", "other/only.ts", "q/twin.ts", "resolvers.ts", "nothing.css")], "ref string")
    got = {r["ref"]: (r["path"], round(r["score"], 3)) for r in T.fuzzy_file_match(refs, files).collect()}
    assert got["src/util.ts"] == ("/x/src/util.ts", 1.0) and got["other/only.ts"] == ("/x/lib/only.ts", 0.95) and got["q/twin.ts"] == ("/x/a/twin.ts", 0.7)
    assert got["resolvers.ts"][0] == "/x/c/resolver.ts" and "nothing.css" not in got


def test_vector_edges(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    one = lambda c: spark.range(1).select(c).head()[0]
    assert one(cosine(v(0, 0), v(1, 0))) == 0 and one(cosine(v(1, 0), v(1, 0, 0))) == 0
    assert math.isclose(one(cosine(v(1, 2), v(1, 2))), 1) and math.isclose(one(cosine(v(1, 0), v(-1, 0))), -1)
    assert one(cosine(v(1, 0), v(-1, 0), normalized=True)) == 0 and one(euclidean_similarity(v(0), v(1))) == 0.5


def test_semantics(spark):
    assert spark.range(1).select(full_match(F.lit("abc"), "b")).head()[0] is False
    assert spark.range(0).agg(sum0("id")).head()[0] == 0


def test_hybrid_formula(spark):
    sem = spark.createDataFrame([("s", 0.9), ("b", 0.5)], "id string, score double")
    lex = spark.createDataFrame([("b", 9.0)] + [(f"l{i}", 8.0 - i) for i in range(7)], "id string, score double")
    got = {r["id"]: (round(r["score"], 6), r["source"]) for r in V.hybrid(sem, lex).collect()}
    assert got["b"] == (round(0.5 * 1.3, 6), "both") and got["s"] == (0.9, "semantic")
    assert [got[f"l{i}"][0] for i in range(5)] == [0.4, 0.35, 0.3, 0.25, 0.2] and "l5" not in got


def test_rerank_strategies_drop_what_was_not_judged(spark):
    rows = spark.createDataFrame([("a", 0.2), ("b", 0.95), ("c", 0.5)], "id string, score double")
    ev = spark.createDataFrame([("a", 0.95), ("b", 0.4)], "id string, score double")
    get = lambda s: {r["id"]: round(r["score"], 6) for r in V.merge_reranked(rows, ev, s).collect()}
    assert get("weighted") == {"a": 0.725, "b": 0.565} and get("multiplicative") == {"a": 0.19, "b": 0.38} and get("llm-override") == {"a": 0.95, "b": 0.675}
    with pytest.raises(ValueError):
        get("other")


def test_batch_topk_matches_single(spark):
    import random

    r = random.Random(3)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(100, None), (101, [1.0])], "id long, vec array<double>")
    q = rows.where("id in (0, 20, 40)").select(F.col("id").alias("query"), "vec")
    got = {(x["query"], x["id"]) for x in V.batch_vector_topk(q, rows, 3, block=2).collect()}
    for i in (0, 20, 40):
        vec = rows.where(F.col("id") == i).head()["vec"]
        one = V.vector_topk(rows.where((F.col("id") != i) & (F.size("vec") == 4)), V.literal_vector(vec), 3)
        assert {x["id"] for x in one.collect()} == {b for a, b in got if a == i}
    assert V.batch_vector_topk(q.limit(0), rows, 3).count() == 0


def test_turn_cases(spark):
    def run(*rows):
        df = spark.createDataFrame([("c", r[0], r[1], i, r[2] if len(r) > 2 else 0, r[3] if len(r) > 3 else None) for i, r in enumerate(rows)], "conversation_id string, role string, content string, place int, n_tools int, reasoning string")
        return [(r["user_text"], r["assistant_text"], r["n_tool_calls"]) for r in U.turns(df).orderBy("turn_no").collect()]

    assert run(("user", "q"), ("assistant", "a")) == [("q", "a", 0)]
    assert run(("user", "q"), ("assistant", "", 1), ("assistant", "", 1), ("assistant", "end", 1)) == [("q", "end", 3)]
    assert run(("user", "q")) == [] and run(("system", "s"), ("assistant", "x")) == []
    assert run(("user", "q"), ("assistant", " ", 2)) == [("q", "", 2)]
    assert run(("user", "q"), ("assistant", "a", 0, "why")) == [("q", "a\n\nReasoning: why", 0)]
    assert run(("user", "1"), ("assistant", "a"), ("system", "s"), ("user", "2"), ("assistant", "b")) == [("1", "a", 0), ("2", "b", 0)]


def test_token_packs(spark):
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate((10, 700, 20, 5000, 1))], "k string, place int, tokens long")
    got = [r["pack"] for r in U.pack_by_tokens(df, F.col("k"), "tokens", 1500, base=1000).orderBy("place").collect()]
    assert got == [0, 1, 2, 3, 4] or got == [0, 1, 1, 2, 3]
    assert [r["pack"] for r in U.pack_by_tokens(df.where("tokens < 30"), F.col("k"), "tokens", 1500, max_items=2).orderBy("place").collect()] == [0, 0, 1]


def test_merge_patch_and_states(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "id string, v int, w string")
    patch = spark.createDataFrame([("a", None, "y"), ("z", 9, "n")], "id string, v int, w string")
    assert {tuple(r) for r in E.merge_patch(rows, patch, "id").collect()} == {("a", 1, "y"), ("b", 2, None)}
    assert {tuple(r) for r in E.merge_patch(rows, patch, "id", insert=True).collect()} == {("a", 1, "y"), ("b", 2, None), ("z", 9, "n")}
    st_ = spark.createDataFrame([("a", "ready"), ("b", "ready")], "id string, node_state string")
    want = spark.createDataFrame([("a", "pending"), ("b", "linking")], "id string, to_state string")
    assert {tuple(r) for r in E.apply_transition(st_, "node_state", "id", want).collect()} == {("a", "pending"), ("b", "ready")}


def test_line_diff(spark):
    df = spark.createDataFrame([("n", None, "a\nb"), ("d", "a", None), ("u", "a\nb\nc", "a\nx\nc\nd"), ("s", "q", "q")], "id string, o string, n string")
    got = {r["id"]: (r["change_type"], r["lines_added"], r["lines_removed"]) for r in E.line_diff(df, "o", "n").collect()}
    assert got == {"n": ("created", 2, 0), "d": ("deleted", 0, 1), "u": ("updated", 2, 1), "s": ("unchanged", 0, 0)}


def test_chunk_boundaries():
    assert chunk_text("") == [] and len(chunk_text("\n".join("x" * 20 for _ in range(30)))) == 1
    two = chunk_text("\n".join(f"line {i} of some text" for i in range(31)))
    assert [(c[4], c[5]) for c in two] == [(1, 30), (26, 31)]
    long = chunk_text("y" * 4000)
    assert [len(c[0]) for c in long] == [1500, 1500, 1000] and [c[2] for c in long] == [0, 1501, 3002]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=400), max_size=12))
def test_chunks_cover_the_text(parts):
    text = "\n".join(parts)
    got = chunk_text(text, max_lines=4, max_chars=60, overlap=1, min_chunk=0)
    assert not text or (got[0][4] == 1 and all(b[4] <= a[5] + 1 for a, b in zip(got, got[1:])))
    assert all(len(c[0]) <= 60 for c in got)


def test_sections_and_blocks(spark):
    md = "intro\n# A\ntext\n```\n# no heading\n```\n## B ##\n### C\n# D\nend"
    df = spark.createDataFrame([("d", md), ("n", None), ("e", "")], "id string, text string")
    got = [(r["section_no"], r["level"], r["title"], r["start_line"], r["end_line"], r["parent_no"]) for r in sections(df).orderBy("section_no").collect()]
    assert got == [(1, 1, "A", 2, 8, None), (2, 2, "B", 7, 8, 1), (3, 3, "C", 8, 8, 2), (4, 1, "D", 9, 10, None)]
    assert code_blocks(df).collect()[0]["code"] == "# no heading\n"


def test_references(spark):
    df = spark.createDataFrame([("t", "ts", "import { a } from './x';\nconst b = require('y');\nimport 'z';"), ("m", "md", "[l](a.md) ![i](b.png) https://h.test/p")], "id string, lang string, text string")
    got = {(r["id"], r["kind"], r["target"]) for r in extract_references(df, F.col("lang")).collect()}
    assert got == {("t", "import", "./x"), ("t", "require", "y"), ("t", "side_effect", "z"), ("m", "link", "a.md"), ("m", "image", "b.png"), ("m", "url", "https://h.test/p")}


def test_pages(spark):
    html = '<html><head><title> T </title><meta name="description" content="about"></head><body><a href="/b#x">b</a><a href="https://h.test/a">self</a></body></html>'
    df = spark.createDataFrame([("https://h.test/a/", html), ("https://h.test/b", "<p>body text</p>")], "url string, html string")
    assert [tuple(r) for r in page_links(df).collect()] == [("https://h.test/a", "https://h.test/b")]
    assert {r["url"]: (r["title"], r["description"]) for r in page_facts(df).collect()}["https://h.test/a"] == ("T", "about")
    r = spark.range(1).select(repository_of(F.lit("https://git.test/own/name.git"))).head()[0]
    assert (r["owner"], r["name"], r["ref"]) == ("own", "name", None)


def test_data_formats(spark):
    assert parse_data('{"a": [1, 2, 3], "b": {"c": 1}}', "json") == {"a": [1, 2, 3], "b": {"c": 1}}
    assert parse_data("a: 1\nb:\n  c: x\n  d: true\ne:\n  - 1\n  - two\n", "yaml") == {"a": 1, "b": {"c": "x", "d": True}, "e": [1, "two"]}
    assert parse_data("A=1\nexport B='x'\n", "env") == {"A": "1", "B": "x"} and parse_data("<r><a>1</a><a>2</a></r>", "xml") == {"a": ["1", "2"]}
    assert parse_data("[t]\nx = 1", "toml") == {"t": {"x": 1}} and parse_data("{", "json") is None
    assert parse_data('// head\n{/* x */ "a": "http://h"}', "json") == {"a": "http://h"}
    df = with_text(virtual_files(spark, {"x.json": '{"only": {"x": 1, "y": 2}}', "y.json": "broken", "z.xml": "<r><p><a>1</a><b>2</b></p></r>", "notes.md": "{}"}))
    got = {(r["path"], r["section"], r["kind"], r["size"]) for r in data_file_sections(df).collect()}
    assert got == {("x.json", "only", "object", 2), ("z.xml", "p", "object", 2)}


def test_data_outline():
    deep = {"name": "x", "dependencies": {"zod": "^3.1", "left": "1"}, "web": {"volumes": ["./src/a.ts", "../img/x.png", {"u": "https://h/x", "d": "lib/**/x"}], "one": ["/etc/x.conf"]}, "n": {"a": 1}}
    found, refs = data_sections(deep)
    assert {(s[0], s[1], s[2], s[3], s[4], s[5], s[6], s[7]) for s in found} == {
        ("dependencies", "dependencies", "object", 2, 0, None, 2, 5), ("web", "web", "object", 2, 0, None, 6, 18),
        ("web.volumes", "volumes", "array", 3, 1, "web", 7, 14), ("web.volumes.[2]", "2", "object", 2, 2, "web.volumes", 10, 13),
    }
    assert {r[:4] for r in refs} == {
        ("dependencies.zod", "package", "^3.1", 3), ("dependencies.left", "package", "1", 4), ("web.volumes.[0]", "code", "./src/a.ts", 8), ("web.volumes.[1]", "image", "../img/x.png", 9),
        ("web.volumes.[2].u", "url", "https://h/x", 11), ("web.one[0]", "config", "/etc/x.conf", 15),
    }
    assert data_sections([{"a": 1, "b": 2}])[0][0][:2] == ("[0]", "0") and data_sections(3) == ([], []) and data_sections({"a": "./x/"})[1][0][1] == "directory"
    chain = {}
    for _ in range(14):
        chain = {"k": chain, "l": 1}
    assert max(s[4] for s in data_sections(chain)[0]) == 10

def test_archives_sheets_documents_images(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d/a.csv", "h,i\n1,2\n")
        f.writestr("w.docx", "no zip")
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:body></w:document>')
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    files = unzip(virtual_files(spark, {"z.zip": z.getvalue(), "bad.zip": b"x"}))
    assert sorted(r["path"] for r in files.collect()) == ["z.zip!/d/a.csv", "z.zip!/w.docx"]
    assert [(r["row_no"], r["cells"]) for r in sheet_rows(files.where("path like '%csv'")).orderBy("row_no").collect()] == [(0, ["h", "i"]), (1, ["1", "2"])]
    more = virtual_files(spark, {"t.docx": doc.getvalue(), "i.png": png})
    assert [r["text"] for r in document_paragraphs(more).collect()] == ["Hello"]
    assert [(r["format"], r["width"], r["height"]) for r in image_facts(more).collect()] == [("png", 7, 9)]


def test_parameterised_sql(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert [r["x"] for r in run_sql(spark, "SELECT x FROM {t} WHERE x > :low", {"low": 1}, t=df).collect()] == [2]


@pytest.mark.parametrize("kinds,expected", [
    (["created", "updated"], ("updated", 1)), (["updated", "created"], ("updated", 0)), (["created", "created"], ("created", 0)),
    (["updated", "deleted", "updated"], ("deleted", 1)), (["deleted", "created", "deleted"], ("deleted", 2)),
])
def test_coalescing(spark, kinds, expected):
    df = spark.createDataFrame([("p", k, i) for i, k in enumerate(kinds)], "path string, change_type string, seq int")
    r = coalesce_changes(df).head()
    assert (r["change_type"], r["seq"]) == expected


def test_stream_without_repeats(spark, data_dir):
    s = spark.readStream.schema(spark.read.parquet(f"{data_dir}/events.parquet").schema).parquet(data_dir, pathGlobFilter="events.parquet")
    got = run_available(unique_within(s.withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"], "1 hour"), "unique_events")
    assert got.count() == spark.read.parquet(f"{data_dir}/events.parquet").select("event_id").distinct().count()


def test_equal_names_are_deduplicated(spark):
    rows = [(1, "T", "graph tokenizer", 0.2), (2, "T", "graph tokenizer", 0.9), (3, "T", "graph tokenizer", 0.9), (4, "T", "graph tokenizers", 0.5), (5, "U", "graph tokenizer", 1.0), (6, "T", "other", None), (7, "T", "other", None), (8, "T", None, 0.1), (9, "T", None, 0.1)]
    df = spark.createDataFrame(rows, "id long, type string, name string, confidence double")
    members = {r["id"]: r["representative"] for r in name_members(df.union(df.limit(2))).collect()}
    assert members == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9}
    # pairs and members together are all pairs of entities of one type at or above the threshold
    near = {(r["a"], r["b"]) for r in similar_names(df).collect()}
    whole = {(a, b) for a in members for b in members if a < b and (members[a] == members[b] or tuple(sorted((members[a], members[b]))) in near)}
    assert whole == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7)}
    assert {r["id"]: r["canonical"] for r in canonical_of_members(df).collect()} == {1: 2, 3: 2, 4: 2, 7: 6}
    assert canonical_of_members(df.limit(0)).count() == 0


FAMILY = {**dict.fromkeys(("ts", "tsx", "js", "jsx"), "ts"), **dict.fromkeys(("css", "scss"), "css")}


def spelled(rows, patterns):
    """(id, kind, target) by Python's own search, with repeats."""
    out = Counter()
    for key, lang, text in rows:
        for name in (FAMILY.get(lang, lang), "any"):
            for kind, p in patterns.get(name, {}).items():
                out.update((key, kind, m) for m in re.findall(p, text or "", re.A))
    return out


def test_all_languages_and_kinds(spark, data_dir):
    q, read = entry.queries(), lambda name: spark.read.parquet(f"{data_dir}/{name}.parquet")
    files = {(r["file_uuid"], r["file_lang"] or (re.findall(r"\.(\w+)$", r["source_path"] or "") or [""])[0].lower(), r["file_content"]) for r in read("source_files").collect()}
    scopes = Counter(tuple(r) for r in q["code_scopes"](spark, data_dir).collect())
    assert scopes == spelled(files, SCOPES) and {lang for i, lang, _ in files if any(i == x for x, *_ in scopes)} == {"go", "py", "ts", "js"}
    refs = Counter(tuple(r) for r in q["extract_file_references"](spark, data_dir).collect())
    assert refs == Counter(set(spelled(files, REFERENCE_PATTERNS))) and {k for _, k, _ in refs} > {"from", "import"}
    docs = [(r["doc_id"], "md", r["text"]) for r in read("documents").collect()]
    got = {tuple(r) for r in q["extract_document_references"](spark, data_dir).collect()}
    assert got == set(spelled(docs, REFERENCE_PATTERNS)) and {k for _, k, _ in got} > {"link"}


def test_imports_of_all_local_references(spark, tmp_path):
    spark.createDataFrame([(f"/w/{p}",) for p in ("a/x.ts", "b/y.go", "b/index.tsx", "z.md", "b/c/v.css")], "source_path string").write.parquet(f"{tmp_path}/source_files.parquet")
    refs = [(1, "./x", True), (2, "../b/y", True), (3, "../b", True), (4, "../../w/./z.md#top", True), (5, "../b/c/../c/v.css?raw", True), (6, "x.ts", True), (7, "x.ts", False), (8, "../none", True), (9, "/w/z.md", True), (10, "#top", True)]
    spark.createDataFrame([(i, "/w/a/from.ts", s, x) for i, s, x in refs], "ref_id long, source_path string, ref_source string, is_local boolean").write.parquet(f"{tmp_path}/extracted_refs.parquet")
    got = {r["src"]: r["path"] for r in entry.queries()["resolve_imports"](spark, str(tmp_path)).collect()}
    assert got == {1: "/w/a/x.ts", 2: "/w/b/y.go", 3: "/w/b/index.tsx", 4: "/w/z.md", 5: "/w/b/c/v.css", 6: "/w/a/x.ts", 9: "/w/z.md"}


def headings(text):
    n, fence = 0, False
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            fence = not fence
        else:
            n += not fence and bool(re.match(r"#{1,6}\s+\S", line))
    return n


def test_headings_of_documents_with_fences(spark, data_dir, tmp_path):
    hand = [(1, "# a\n```py\n# no\n```\n## b"), (2, "~~~\n# no\n~~~"), (3, "# a\n```\n# no, the fence stays open"), (4, "# a"), (5, None), (6, "  ```\n# no\n  ```\n### c\r\n")]
    spark.createDataFrame(hand, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda d: {r["id"]: r["n"] for r in entry.queries()["document_headings"](spark, str(d)).collect()}
    assert run(tmp_path) == {1: 2, 3: 1, 4: 1, 6: 1}
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()
    want = Counter()
    for key, text in docs:
        want[key] += headings(text)
    assert any("```" in (text or "") and headings(text) for _, text in docs) and run(data_dir) == dict(+want)
