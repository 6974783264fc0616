"""Upserts, stored conversations, search, projects, crawls and entity relations on small cases."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.patterns import any_label
from weftgraph.model import Catalog, Entity, Relationship
from weftgraph.operators import aggregate as A
from weftgraph.operators import crawl as C
from weftgraph.operators import dialogue as D
from weftgraph.operators import entities as E
from weftgraph.operators import ownership as O
from weftgraph.operators import search as S
from weftgraph.operators import traverse as T
from weftgraph.operators import upsert as U
from weftgraph.plans.query import get
from weftgraph.streaming import changes as W

T0 = dt.datetime(2025, 1, 1)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()), key=repr)


def test_upsert_graph(spark):
    cols = "uuid string, label string, hash string, dirty boolean, extra string"
    stored = spark.createDataFrame([("f", "File", None, None, "s"), ("a", "Scope", "1", False, "s"), ("b", "Scope", "1", None, "s"), ("c", "Scope", "1", True, "s"), ("x", "Scope", "9", None, "s")], cols)
    parsed = spark.createDataFrame([("f", "File", None, None, "p"), ("a", "Scope", "1", None, "p"), ("b", "Scope", "2", None, "p"), ("c", "Scope", "1", None, "p"), ("n", "Scope", "1", None, "p")], cols)
    edges = spark.createDataFrame([("a", "b", "T"), ("b", "a", "T"), ("x", "a", "T"), ("a", "x", "T"), ("c", "a", "T")], "src string, dst string, type string")
    new = spark.createDataFrame([("n", "a", "T"), ("b", "c", "T"), ("a", "b", "T"), ("a", "a", "T")], "src string, dst string, type string")
    got = U.upsert_graph(stored, edges, parsed, new, dirty="dirty")
    assert rows(got["stats"]) == [("created", 1), ("deleted", 1), ("unchanged", 1), ("updated", 2)]
    assert rows(got["nodes"], "uuid", "extra") == [("a", "s"), ("b", "p"), ("c", "p"), ("f", "p"), ("n", "p")]
    assert rows(got["edges"]) == [("a", "b", "T"), ("b", "c", "T"), ("n", "a", "T")]
    none = U.upsert_graph(stored.limit(0), edges.limit(0), parsed.limit(0), new.limit(0))
    assert none["nodes"].count() == none["edges"].count() == none["stats"].count() == 0


def test_creating_nodes_needs_a_key(spark):
    old = spark.createDataFrame([("a", 1)], "uuid string, v int")
    assert rows(U.create_nodes(old, spark.createDataFrame([("b", "x")], "uuid string, w string"), "uuid")) == [("a", 1, None), ("b", None, "x")]
    for bad in (None, " "):
        with pytest.raises(Exception, match="lacks uuid"):
            U.create_nodes(old, spark.createDataFrame([(bad,)], "uuid string"), "uuid").collect()


def test_file_changes(spark):
    f = lambda d: spark.createDataFrame(list(d.items()), "path string, hash string")
    got = U.file_changes(f({"same": "1", "mod": "1", "gone": "1", "dirty": "1", "bad": "1", "n": None}), f({"same": "1", "mod": "2", "new": "1", "dirty": "1", "bad": None, "n": "1"}), dirty=f({"dirty": "", "gone": ""}).unionByName(f({"dirty": ""})))
    assert dict(rows(got)) == {"same": "unchanged", "mod": "modified", "gone": "deleted", "dirty": "modified", "bad": "error", "n": "modified", "new": "new"}


def test_metadata_survives_a_new_ingestion(spark):
    a = spark.createDataFrame([("1", [1.0], "x"), ("2", None, "y"), ("3", [3.0], "z")], "uuid string, vec array<double>, other string")
    got = U.capture_metadata({"A": a, "B": spark.createDataFrame([(7, "m")], "uuid int, model string"), "C": spark.range(1).select(F.col("id").alias("uuid"))}, ["vec", "model"])
    assert rows(got, "label", "uuid", "model") == [("A", "1", None), ("A", "3", None), ("B", "7", "m")]
    captured = spark.createDataFrame([("1", "h", "p", [1.0]), ("2", "h", "q", [2.0]), ("3", "old", "p", [3.0]), ("4", "h", "p", None)], "uuid string, hash string, provider string, vec array<double>")
    fresh = spark.createDataFrame([("1", "h", None), ("2", "h", None), ("3", "h", [9.0]), ("4", "h", [8.0]), ("5", "h", None)], "uuid string, hash string, vec array<double>")
    assert {r["uuid"]: r["vec"] for r in U.restore_metadata(fresh, captured, "p", ["vec"]).collect()} == {"1": [1.0], "2": None, "3": [9.0], "4": [8.0], "5": None}


def test_summaries(spark):
    s = "id string, strategy string, hash string, summary string, ts timestamp"
    old = spark.createDataFrame([("a", "x", "1", "old", T0), ("b", "x", "1", "b", T0)], s)
    stored = U.store_summaries(old, spark.createDataFrame([("a", "x", "2", "new", T0 + dt.timedelta(1)), ("a", "y", "1", "other", T0)], s))
    assert rows(stored, "id", "strategy", "summary") == [("a", "x", "new"), ("a", "y", "other"), ("b", "x", "b")]
    docs = spark.createDataFrame([("a", "2", "t" * 9), ("b", "2", "t" * 9), ("c", None, "t" * 9), ("d", "1", "t"), ("e", "1", None)], "id string, hash string, text string")
    assert rows(U.summaries_due(docs, stored, 5, "x")) == [("b", "stale"), ("c", "missing")] and rows(U.cached_summaries(docs, stored, "x")) == [("a", "new")]


def test_texts_to_embed(spark):
    n = spark.createDataFrame([("a", "A", "doc"), ("b", " ", "x"), ("c", "C", None), ("d", "D", "")], "id string, name string, doc string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("c", "d"), ("d", "a"), ("a", "d")], "src string, dst string")
    one = U.relationship_snippets(n.select("id"), edges, n.withColumn("title", F.lit("t")), "USES", limit=2)
    assert dict(rows(one)) == {"a": "[USES]\nC\nD", "c": "[USES]\nD", "d": "[USES]\nA"}
    assert dict(rows(U.relationship_snippets(n.where("id = 'c'").select("id"), edges, n, "USES", depth=2)))["c"] == "[USES]\nA\nD"
    assert dict(rows(U.embedding_texts(n, "name", ["doc"], [one], [lambda c: F.regexp_replace(c, "USES", "uses")]))) == {"a": "A\n\ndoc\n\n[uses]\nC\nD", "c": "C\n\n[uses]\nD", "d": "D\n\n[uses]\nA"}


def test_embedding_tasks(spark):
    long = "\n".join(f"line {i} with some words in it" for i in range(70))
    rs = [("new", "some text", "h", 3), ("same", "some text", "h", 1), ("changed", "some text", "h2", 1), ("model", "some text", "h", 1), ("prov", "some text", "h", 1), ("tiny", "abcd", "h", 1), ("null", None, "h", 1), ("long", long, "h", 11)]
    stored = [("same", "h", "p", "m"), ("changed", "h", "p", "m"), ("model", "h", "p", "old"), ("prov", "h", "q", "m"), ("tiny", "z", "p", "m")]
    got = U.embedding_tasks(spark.createDataFrame(rs, "id string, text string, hash string, start_line int"), spark.createDataFrame(stored, "id string, hash string, provider string, model string"), "p", "m").collect()
    assert {(r["id"], r["reason"]) for r in got} == {("new", "missing"), ("changed", "content"), ("model", "model"), ("prov", "provider"), ("long", "missing")}
    parts = sorted((r["part"], r["start_line"], r["end_line"]) for r in got if r["id"] == "long")
    assert parts[0] == (0, 11, 40) and parts[-1][2] == 80 and len(parts) > 2 and [(r["start_line"], r["end_line"]) for r in got if r["id"] == "new"] == [(3, 3)]


def test_conversation_storage(spark):
    m = spark.createDataFrame([(f"m{i}", "c" if i % 2 else "d", i) for i in range(7)] + [("z", None, 1)], "uuid string, conversation_id string, place int")
    got = D.message_ids(m)
    assert rows(got.where("conversation_id = 'c'"), "uuid", "ordinal") == [("m1", 0), ("m3", 1), ("m5", 2)] and got.select("id").distinct().count() == 8
    calls = spark.createDataFrame([("m1", "k2", "grep"), ("m1", "k1", "ls"), ("m2", None, None)], "uuid string, call_id string, tool_name string")
    res = spark.createDataFrame([("k1", "out"), ("k9", "x"), ("k1", "aaa")], "call_id string, output string")
    by = {r["uuid"]: [tuple(x) for x in r["tools"]] for r in D.messages_with_tools(m.select("uuid"), calls, res).collect()}
    assert by["m1"] == [("k1", "ls", "out"), ("k2", "grep", None)] and by["m2"] == [] and by["m0"] == []
    v = D.session_view(spark.createDataFrame([("c",), ("e",)], "conversation_id string"), m.withColumn("ts", F.lit(T0)), calls.where("call_id is not null"))
    assert rows(v, "conversation_id", "n_messages", "n_calls", "tool_names") == [("c", 3, 2, ["grep", "ls"]), ("e", 0, 0, [])]
    c = D.create_conversations(spark.createDataFrame([("c", "done", ["a"])], "conversation_id string, status string, tags array<string>"), spark.createDataFrame([("c", ["b"]), ("n", ["b"])], "conversation_id string, tags array<string>"))
    assert rows(c, "conversation_id", "status") == [("c", "done"), ("n", "active")]
    c = D.set_status(c, spark.createDataFrame([("n",), ("q",), ("n",)], "conversation_id string"), "archived")
    assert rows(D.find_conversations(c, ["b", "x"], "archived"), "conversation_id") == [("n",)] and D.find_conversations(c, ["a"], "archived").count() == 0
    s = spark.createDataFrame([("c", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0, 1.0]), ("e", None)], "conversation_id string, vec array<double>")
    q = F.array(F.lit(1.0), F.lit(0.0))
    assert [r[0] for r in D.similar_conversations(s, q, 0.5).collect()] == ["c", "d"]
    assert rows(D.similar_messages(s.withColumn("uuid", F.col("vec").cast("string")), "c", q, 0.5), "score") == [(1.0,)]
    sess = spark.createDataFrame([("s1", "x", T0), ("s2", "x", None), ("s3", "y", T0)], "session_id string, domain string, updated_at timestamp")
    assert [r[0] for r in D.sessions_of(sess, "x", 5).collect()] == ["s1", "s2"]


def test_search_modes_and_post_processing(spark):
    r = [("a", "parser of files", [1.0, 0.0], "class", "src/a.ts"), ("b", "parser", [0.9, 0.1], "function", "src/b.ts"), ("c", "parsers", [0.0, 1.0], "class", "lib/c.py"), ("d", None, None, None, None)]
    df = spark.createDataFrame(r, "id string, text string, vec array<double>, type string, path string").withColumn("score", F.lit(7.0)).withColumn("embedding_x", F.lit(1)).withColumn("a_hash", F.lit(1))
    q, f = F.array(F.lit(1.0), F.lit(0.0)), {"content": "text"}
    ids = lambda d: [x["id"] for x in d.collect()]
    assert ids(S.search(df, "parser", fields=f, fuzzy=0)) == ["b", "a"] and set(ids(S.search(df, "parser", fields=f))) == {"a", "b", "c"}
    sem = S.search(df, vector=q, fields=f, mode="semantic")
    assert [(x["id"], round(x["score"], 3)) for x in sem.collect()] == [("a", 1.1), ("b", 0.994)]
    assert ids(S.search(df, "parser", q, fields=f, mode="hybrid", glob="src/*.{ts,js}", boost_classes=False))[0] in ("a", "b")
    assert set(ids(S.search(df, "parser", fields=f, mode="semantic", where=F.col("type") == "class"))) == {"a", "c"}  # without vector: lexical
    assert ids(S.search(df, "", fields=f)) == [] and ids(S.search(df, vector=q, fields=f, mode="semantic", ids=df.where("id = 'b'").select("id"))) == ["b"]
    with pytest.raises(ValueError):
        S.search(df, "x", q, fields=f, mode="other")
    assert S.public_columns(df).columns == ["id", "text", "vec", "type", "path", "score"]
    hits = sem.select("id", "score", "path")
    edges = spark.createDataFrame([("a", "c", "T"), ("c", "d", "T"), ("b", "a", "T")], "src string, dst string, type string")
    ev = spark.createDataFrame([("a", 0.2), ("b", 1.0)], "id string, score double")
    got = S.post_process(hits, evaluations=ev, keywords=["b.ts"], fields=["path"], limit=1, edges=edges, summarise=lambda d: d.agg(F.count(F.lit(1)).alias("n")))
    assert rows(got["results"], "id") == [("b",)] and round(got["results"].head()["score"], 3) == round(0.3 * 0.9939 + 0.7 + 0.15, 3)
    assert [x["node"] for x in got["nodes"].collect()] == ["b", "a"] and got["summary"].head()["n"] == 1 and set(S.post_process(hits)) == {"results"}
    files = spark.createDataFrame([("/x/a.ts", "one\ntwo\nthree\ntwo"), ("/x/b.py", "two"), ("/x/c.ts", None)], "path string, text string")
    g = S.grep_files(files, "two", ["*.ts"], context=99).collect()
    assert [(x["id"], x["line_no"], x["before"], x["after"]) for x in g] == [("/x/a.ts", 2, ["one"], ["three", "two"]), ("/x/a.ts", 4, ["one", "two", "three"], [])]


def test_projects(spark):
    p = spark.createDataFrame([("p", "/w/p", None, T0), ("q", "/w/p/sub/", True, None), ("r", "/w", False, T0)], "project_id string, root_path string, is_excluded boolean, last_accessed timestamp")
    assert rows(O.set_excluded(p, ["p", "q", "z"], None), "project_id", "is_excluded") == [("p", True), ("q", False), ("r", False)]
    assert [r[0] for r in O.matching_projects(p, "/w/p/x/").collect()] == ["p", "r"] and [r[0] for r in O.matching_projects(p, "/w").collect()] == ["q", "p", "r"]
    n = spark.createDataFrame([("1", "o", "/w/p/a.ts", "ready"), ("2", "o", "/w/px/a.ts", None), ("3", "p", "/w/p/a.ts", "error"), ("4", None, None, "error"), ("5", "x", "b", "error")], "uuid string, project_id string, source_path string, node_state string")
    assert rows(O.rehome(n, "o", "p", "/w/p/"), "uuid", "project_id", "source_path") == [("1", "p", "a.ts"), ("2", "o", "/w/px/a.ts"), ("3", "p", "/w/p/a.ts"), ("4", None, None), ("5", "x", "b")]
    assert rows(O.merge_project(n, "x", "p", "sub"), "uuid", "project_id", "source_path")[-1] == ("5", "p", "sub/b")
    assert rows(O.pending_counts(n)) == [("o", None, 1, 1), ("p", "error", 1, 1), ("x", "error", 1, 1), (None, "error", 1, 0)]
    t = O.touch(O.touch(n, ["b"], F.lit(T0)), ["/w/p/a.ts"], F.lit(T0))
    assert [r["uuid"] for r in t.where("last_access is not null").orderBy("uuid").collect()] == ["1", "3", "5"]
    edges = spark.createDataFrame([("3", "1"), ("1", "3"), ("1", "2")], "src string, dst string")
    d = O.delete_projects(n, edges, p, ["p", "p", "nope"])
    assert rows(d["deleted"]) == [("nope", 0, False), ("p", 1, True)] and rows(d["edges"]) == [("1", "2")] and d["nodes"].count() == 4 and d["projects"].count() == 2
    g = O.garbage(n, p, spark.createDataFrame([("k1", "1"), ("k2", "gone"), ("k3", None)], "chunk_id string, parent string"), F.lit(T0 + dt.timedelta(1)))
    assert rows(g["nodes"], "uuid") == [("1",), ("2",), ("4",), ("5",)] and rows(g["chunks"], "chunk_id") == [("k2",), ("k3",)] and rows(g["projects"], "project_id") == [("p",), ("q",), ("r",)]


def test_crawls(spark):
    page = lambda u, *links: (u, f"<title>{u}</title>" + "".join(f'<a href="{x}">x</a>' for x in links))
    pages = spark.createDataFrame([page("https://h.test/", "/a", "/b#top"), page("https://h.test/a/", "https://h.test/c", "/a"), page("https://h.test/b", "https://o.test/x"), page("https://h.test/c", "/d"), page("https://h.test/d"), page("https://o.test/x"), (None, None), page("https://h.test/a", "/d")], "url string, html string")
    assert rows(C.crawl(pages, ["https://h.test/"])) == [("https://h.test", 0), ("https://h.test/a", 1), ("https://h.test/b", 1), ("https://h.test/c", 2), ("https://h.test/d", 2), ("https://o.test/x", 2)]
    assert rows(C.crawl(pages, ["https://h.test", "https://nowhere.test"], depth=1, max_pages=2, exclude=["/a$"])) == [("https://h.test", 0), ("https://h.test/b", 1)]
    assert C.crawl(pages.limit(0), ["https://h.test"]).count() == 0
    nodes, edges = C.site_graph(pages)
    assert rows(nodes.groupBy("label").count()) == [("WebPage", 6), ("Website", 2)] and rows(edges.groupBy("type").count()) == [("HAS_PAGE", 6), ("LINKS_TO", 5)]
    assert edges.join(nodes, F.col("dst") == F.col("id"), "left_anti").count() == 0 and edges.where("src = dst").count() == 0


def test_entity_relations_and_strategies(spark):
    e = spark.createDataFrame([("1", "Graph Store", "T"), ("2", "graph store", "T"), ("3", "fast graph store engine", "T"), ("4", "cache", "U"), ("5", None, "T")], "id string, name string, type string").withColumn("confidence", F.lit(0.5))
    rel = spark.createDataFrame([("GRAPH STORE ", "cache", "depends on"), ("graph store", "Cache", "depends on"), ("store engine", "the cache layer", "uses"), ("unknown", "cache", "uses"), (None, "cache", "uses")], "subject string, object string, predicate string")
    assert rows(E.entity_relations(e, rel)) == [("1", "4", "DEPENDS_ON"), ("3", "4", "USES")]
    near = spark.createDataFrame([("a", "tokenizer", "T", 0.9), ("b", "tokenizers", "T", 0.5), ("c", "tokenizer", "X", 0.5), ("d", "tokenizers", "X", 0.5)], "id string, name string, type string, confidence double")
    assert dict(rows(E.deduplicated(near))) == {"a": "a", "b": "a", "c": "d", "d": "d"}
    assert dict(rows(E.deduplicated(near, excluded=["X"]))) == {"a": "a", "b": "a", "c": "c", "d": "d"}
    embed = lambda c: F.when(c == "tokenizer", F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(1.0), F.lit(0.2)))
    for how in ("embedding", "hybrid"):
        assert dict(rows(E.deduplicated(near, how, embed=embed)))["b"] == "a"
    assert dict(rows(E.deduplicated(near, "judge", resolve=lambda p: p.where("a = 'c'")))) == {"a": "a", "b": "b", "c": "d", "d": "d"}
    for bad in ("embedding", "judge", "other"):
        with pytest.raises(ValueError):
            E.deduplicated(near, bad)


def test_plans_with_wrappers_and_clauses(spark):
    rows_ = spark.createDataFrame([("a", "A", 1), ("b", "B", 2), ("c", "C", 3)], "uuid string, name string, v int")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "c"), ("a", "b")], "src string, dst string")
    c = Catalog().add(Entity("S", rows_, display="name"), Relationship("CONSUMES", edges, "S", "S"))
    ids = lambda p: rows(p.compile(), "uuid")
    assert ids(get(c, "S").consumes("B")) == [("a",), ("c",)] and ids(get(c, "S").consumed_by("A")) == [("b",)] and ids(get(c, "S").related_to("CONSUMES", "B", "incoming")) == [("c",)]
    assert ids(get(c, "S").raw("v >= :lo and name <> :n", lo=2, n="C' or 1=1 --")) == [("b",), ("c",)] and "CONSUMES" in get(c, "S").consumes("B").explain()


def test_small_parts(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "a"), ("y", None), ("z", "c")], "g string, m string")
    assert rows(A.members_by(df, ["g"], "m", 1)) == [("x", 2, ["a"]), ("z", 1, ["c"])]
    lab = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "l array<string>")
    assert [r[0] for r in lab.select(any_label(F.col("l"), ["b"])).collect()] == [True, False, False] and lab.where(any_label(F.col("l"), [])).count() == 0
    got = T.collect_related(spark.createDataFrame([(1,), (2,)], "id int"), "id", spark.createDataFrame([(1, 5), (1, 4), (1, 5)], "src int, dst int"))
    assert rows(got) == [(1, [4, 5]), (2, [])]


def test_watched_folders_and_project_batches(spark, tmp_path):
    src = tmp_path / "tree"
    src.mkdir()
    (src / "a.txt").write_text("a")
    (src / "b.txt").write_text("b")
    none = spark.createDataFrame([], "path string, modified_at timestamp")
    first = W.watched(spark, f"file://{src}", none)
    assert {(r["path"].rsplit("/", 1)[1], r["change_type"]) for r in first.collect()} == {("a.txt", "created"), ("b.txt", "created")}
    known = spark.createDataFrame([(r["path"], r["t"]) for r in first.select("path", F.timestamp_micros("seq").alias("t")).collect()], "path string, modified_at timestamp")
    assert W.watched(spark, f"file://{src}", known).count() == 0
    (src / "a.txt").unlink()
    (src / "c.txt").write_text("c")
    assert {(r["path"].rsplit("/", 1)[1], r["change_type"]) for r in W.watched(spark, f"file://{src}", known).collect()} == {("a.txt", "deleted"), ("c.txt", "created")}
    r = random.Random(1)
    events = [(f"p{i % 3}" if i % 4 else None, f"f{r.randint(0, 3)}", "updated", i) for i in range(40)]
    spark.createDataFrame(events, "project_id string, path string, change_type string, seq long").write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema("project_id string, path string, change_type string, seq long").parquet(f"{tmp_path}/events")
    seen = {}
    W.project_batches(stream, lambda p, df, n: seen.setdefault(p, []).extend(tuple(x) for x in df.select("path", "seq").collect()), f"file://{tmp_path}/cp").awaitTermination()
    want = {}
    for p, f, _, s in events:
        if p:
            want.setdefault(p, {})[f] = s
    assert {p: dict(v) for p, v in seen.items()} == want


def test_edges_and_tools_by_name(spark, tmp_path):
    from weftgraph import tools
    from weftgraph.operators import etl
    from weftgraph.operators.turns import latest_per_level, second_level_due
    from weftgraph.plans.pipeline import Pipeline
    from weftgraph.plans.providers import EchoGenerator, PatternExtractor, extract_entities, generate, judge, with_summaries
    from weftgraph.sources.files import export_conversations, read_table, read_tree

    e = spark.createDataFrame([("a", "b", "T")], "src string, dst string, type string")
    assert etl.add_edges(e, e).count() == 2 and etl.remove_edges(etl.add_edges(e, e), e).count() == 0
    n = spark.createDataFrame([("a", "/x/a", "/x/a"), ("b", "/x/b", None), ("c", None, "/x/a")], "uuid string, file string, source_path string").withColumn("node_state", F.lit("ready"))
    assert rows(etl.delete_for_files(n, spark.createDataFrame([("/x/a",)], "path string")), "uuid") == [("b",)]
    assert rows(tools.mark_dirty(n, ["/x/a"]), "uuid", "node_state") == [("a", "pending"), ("b", "ready"), ("c", "pending")] and rows(tools.forget_path(n, "/x"), "uuid") == [("b",)]
    c = Catalog().add(Entity("N", n))
    many = [f"k{i}" for i in range(60)] + ["a"]
    assert tools.get_entities_by_ids(c, "N", many).count() == 1 and tools.get_entities_by_ids(c, "N", []).count() == 0
    wide = Catalog().add(Entity("W", spark.range(200).withColumnRenamed("id", "uuid")))
    assert tools.query_entities(wide, "W", limit=120).count() == 120 and tools.query_entities(wide, "W", limit=None).count() == 200 and tools.get_entities_by_ids(wide, "W", list(range(70))).count() == 70
    assert {"brain_search", "cleanup_brain", "describe_table"} <= tools.tool_table().keys()
    s = spark.createDataFrame([(1, "c", 1, None, 0, 4, T0), (2, "c", 1, False, 5, 9, T0), (3, "c", 1, True, 10, 12, T0), (4, "c", 2, None, 0, 4, None), (5, "d", 1, None, 0, 4, T0)], "id int, conversation_id string, level int, covered boolean, start_turn int, end_turn int, ts timestamp")
    assert rows(second_level_due(s)) == [("c", 2, 0, 9)] and rows(latest_per_level(s), "conversation_id", "level", "id") == [("c", 1, 3), ("c", 2, 4), ("d", 1, 5)]
    o, m = (spark.createDataFrame([("a", "1", f), ("b", "1", "x")], "k string, h string, f string") for f in ("x", "y"))
    assert rows(etl.classify_changes(o, m, "k", "h", "f")) == [("a", "updated"), ("b", "unchanged")] and rows(etl.classify_changes(o, m, "k", "h")) == [("a", "unchanged"), ("b", "unchanged")]
    df, counts = Pipeline(c, "N").fetch_all().where_in("uuid", ["a", "b"]).execute_with_counts()
    df.collect()
    assert [(k, w.get["rows"]) for k, w in counts] == [("fetch", 3), ("filter", 2)]
    t = spark.createDataFrame([("1", "readFile calls openNode, readFile", ["code"]), ("2", " ", ["code"]), ("3", "aB", []), ("4", None, None)], "id string, text string, d array<string>")
    assert rows(extract_entities(t, PatternExtractor()), "id", "name", "confidence") == [("1", "openNode", 0.5), ("1", "readFile", 0.5), ("3", "aB", 0.5)][:2] + rows(extract_entities(t.where("id = '3'"), PatternExtractor()), "id", "name", "confidence")
    assert extract_entities(t, PatternExtractor(), domains="d", max_chars=8).count() == 1
    assert {r["id"] for r in with_summaries(t.select("id", "text"), EchoGenerator()).collect()} == {"1", "2", "3", "4"}
    assert rows(generate(t.where("id = '1'").select("id", "text"), EchoGenerator(), {"n": "long"}, lambda r, g: {**r, "n": -g["n"]}), "n")[0][0] < 0
    assert rows(judge(t.select("id"), lambda b: b["id"].astype(float) / 10, "id"))[0] == ("1", 0.1)
    turns = spark.createDataFrame([("c", 1, "user", "q"), ("c", 0, "system", None)], "conversation_id string, turn_no int, role string, content string")
    export_conversations(turns, f"file://{tmp_path}/md", "md")
    export_conversations(turns, f"file://{tmp_path}/js")
    assert {r[0] for r in spark.read.text(f"file://{tmp_path}/md").collect()} == {"**system**: ", "**user**: q"} and read_table(spark, "json", path=f"file://{tmp_path}/js").count() == 2
    (tmp_path / "tree" / "node_modules").mkdir(parents=True)
    (tmp_path / "tree" / "a.ts").write_text("x")
    (tmp_path / "tree" / "node_modules" / "b.ts").write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in read_tree(spark, f"file://{tmp_path}/tree", ["*.ts"]).collect()] == ["a.ts"]


def test_maps_and_declared_types(spark):
    from weftgraph.functions.maps import drop_keys, keep_keys, merge_maps, to_declared

    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None}), (None, {"x": "1"}), ({"y": "1"}, None), (None, None)], "p map<string,string>, q map<string,string>")
    assert [r[0] for r in df.select(merge_maps(F.col("p"), F.col("q"))).collect()] == [{"a": "1", "b": "3", "c": None}, {"x": "1"}, {"y": "1"}, None]
    assert df.select(keep_keys(F.col("p"), ["a"]), drop_keys(F.col("p"), ["a"])).head()[:] == ({"a": "1"}, {"b": "2"})
    raw = spark.createDataFrame([("1.5", "true", "2025-01-01", '["a", "b"]', "k"), ("x", "maybe", "soon", "[", None)], "n string, b string, t string, l string, k string")
    got = to_declared(raw, {"n": "number", "b": "boolean", "t": "datetime", "l": "array<string>"}).collect()
    assert got[0][:] == (1.5, True, T0, ["a", "b"], "k") and got[1][:] == (None, None, None, None, None)
