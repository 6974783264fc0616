from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from weftgraph.llm.source_origin import COPY_NOTICE, file_features, fit_origin, foreign_files, has_notice, is_one_literal, path_facts, without_notice
from weftgraph.llm.spam_pages import FEATURES, page_facts, page_features, spam_pages, weak_label, without_links
from weftgraph.llm.trees import fit_forest

MADE = ["// Code generated by toolgen v1.2. DO NOT EDIT.", "# Archivo generado por x 1.2. No modificar.", "/* AUTOGENERATED FILE - run `make x` */", "// Automatisch erzeugt aus docs/x.ts, nicht von Hand", "# @generated by x-codegen",
        "// Fichier généré automatiquement par x - ne pas modifier.", "// autogen: a.proto -> b (do not touch)", "// Output of `x --emit 2`; regenerate instead of patching", "/*! kit 1.6.6 */"]
HAND = ["// Builds the header 'DO NOT EDIT' for the files that the exporter writes.", "// The id is generated by the server, never by the client.", "// TODO: this used to be generated automatically; it is maintained by hand since the rewrite.",
        "// Do not edit the map while iterating over it.", "// Auto-generated ids are rejected here, see the issue.", "// Vendor records come from purchasing and are edited by hand.", "// Licensed under the MIT license, see LICENSE at the repository root."]


@pytest.mark.parametrize("line", MADE)
def test_notices(line):
    assert has_notice(line + "\n\ncode()")


@pytest.mark.parametrize("line", HAND)
def test_no_notices(line):
    assert not has_notice(line + "\n\ncode()") and not has_notice(line, COPY_NOTICE)


@pytest.mark.parametrize("line", MADE)
def test_notices_anywhere(line):
    code = "".join(f"let a{i} = {i};\n" for i in range(40))
    licence = "/*\n" + "".join(f" * term {i} of the licence\n" for i in range(15)) + " */\n"
    for text in (code + "\n" + line, code + line + "\n" + code, licence + line + "\n\n" + code, code + "x" * 5000 + ";\n" + line):
        assert has_notice(text)
        assert line not in without_notice(text) and "let a39 = 39;" in without_notice(text)


@pytest.mark.parametrize("line", HAND + ["let s = '// Code generated by x';", "s = \"# @generated by x\"", "emit(`Output of y; regenerate instead`)"])
def test_no_notices_below_the_head(line):
    text = "a();\n" * 40 + line + "\n"
    assert not has_notice(text) and not has_notice(text, COPY_NOTICE) and line in without_notice(text)


def test_notices_in_blocks_and_after_code():
    code = "a();\n" * 40
    for tail in ("/*\n  terms\n  @generated by x\n*/", "b(); // @generated by x", "b(); /* @generated by x */"):
        assert has_notice(code + tail) and "@generated" not in without_notice(code + tail)
    assert without_notice(code + "/* @generated by x\n text */\nb();") == code + "/*\n text */\nb();"
    assert without_notice(code + "b(); /* @generated by x */") == code + "b(); "


def test_copy_notices_and_paths():
    assert has_notice("/*! @license abc 1.2.3, BSD-3-Clause, https://x.example */", COPY_NOTICE) and has_notice("# Copie locale de la bibliothèque x 1.2 (licence ISC)", COPY_NOTICE)
    assert path_facts("/w/p/vendor/kit/a.js")[0] and not path_facts("/w/p/external/a.js")[0] and not path_facts("/w/vendors/x/a.js")[0]
    assert path_facts("/w/a.min.js")[2] and path_facts("/w/x_pb2.py")[2] and path_facts("/w/package-lock.json")[2]
    assert not path_facts("/w/a.min-max.css")[2] and not path_facts("/w/x.bundle-notes.py")[2] and not path_facts(None)[2]
    assert without_notice("// a\n# b\n\ncode\n// c") == "code\n// c"


def test_files(spark):
    r = np.random.default_rng(1)
    hand = lambda i: "\n".join(f"function f{i}{j}(a) {{\n  // adds {j}\n  return a.value{j} + {r.integers(99)};\n}}" for j in range(6))
    mini = lambda: "".join(f"function {chr(97 + r.integers(26))}{r.integers(9)}(t,e){{return t+e*{r.integers(99)}}}" for _ in range(60))
    rows = [(f"h{i:02d}", f"/w/src/m{i}.js", hand(i)) for i in range(60)] + [(f"m{i:02d}", f"/w/src/x{i}.min.js", mini()) for i in range(20)]
    rows += [("plain", "/w/src/app.js", mini()), ("copy", "/w/src/deep/lib.js", hand(99)), ("orig", "/w/vendor/kit/lib.js", "/*! @license kit 1.0.0, MIT */\n" + hand(99))]
    rows[-2] = ("copy", "/w/src/deep/lib.js", rows[-1][2].split("\n", 1)[1])
    rows += [("data", "/w/src/t.js", "module.exports = [" + ", ".join(map(str, range(400))) + "]"), ("null", "/w/a.js", None), ("empty", "/w/b.js", ""), (None, "/w/c.js", "x"), rows[0]]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "file_uuid string, source_path string, file_content string, label string")
    got = [x["file_uuid"] for x in foreign_files(df).collect()]
    assert set(got) == {f"m{i:02d}" for i in range(20)} | {"plain", "copy", "orig", "data"} and len(got) == len(set(got))
    assert foreign_files(df.limit(0)).count() == 0


PROSE = "When a relation is incremental, the crawler slowly restores it. It took the team 37 days to explain why the bucket was stale. "


def test_spam(spark):
    spam = {
        1: "cheap edge top edge free edge best edge " * 12, 2: "\n".join(f"http://h{i}.example/x/{i}" for i in range(20)), 3: " ".join(f"#tag{i}word" for i in range(40)),
        4: "\n".join(f"SKU: code-{i}\nColor dark-{i}" for i in range(20)), 5: " | ".join(f"[cheap tool {i}](http://h{i}.test/a)" for i in range(15)),
        6: PROSE + "\n" + "Graph tool in Aldton\nGraph tool in Belburg\n" * 12,
    }
    clean = {
        11: PROSE * 4, 12: "\n".join(f"- [Item{i}](https://h.test/{i}): {PROSE}" for i in range(5)), 13: "\n".join(f"2025-01-0{i} 10:00 INFO cache: {PROSE}" for i in range(1, 9)),
        14: "```ts\nconst a = b;\nreturn a;\n```\n" + PROSE * 2, 15: "", 16: None, 17: "ok", 18: PROSE * 3 + "\nTags: a, b, c", 19: " \n ",
    }
    more = [(100 + i, PROSE.replace("37", str(i)) * (1 + i % 5), "https://good.test/p", "x") for i in range(60)] + [(200 + i, f"buy word{i} now word{i} cheap " * 15, "https://bad.test/q", "x") for i in range(30)]
    df = spark.createDataFrame([(d, t, None, "x") for d, t in {**spam, **clean}.items()] + more + [(1, spam[1], None, "x"), (None, spam[1], None, "x")], "doc_id long, text string, url string, host string")
    got = [r["doc_id"] for r in spam_pages(df).collect()]
    assert set(got) == set(spam) | {200 + i for i in range(30)} and len(got) == len(set(got))
    assert spam_pages(df.limit(0)).count() == 0
    assert len(page_features("x" * 1_000_000)) == len(FEATURES)


def test_trees_learn_and_agree():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = fit_forest(x[:1500], y[:1500], n_trees=20, max_depth=8, features=0.7)
    assert ((f.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9
    assert np.array_equal(f.predict(x[:50]), fit_forest(x[:1500], y[:1500], n_trees=20, max_depth=8, features=0.7).predict(x[:50]))
    assert (fit_forest(np.empty((0, 3)), np.empty(0)).predict(np.zeros((2, 3))) == 0).all()
    assert (fit_forest(np.ones((9, 2)), np.ones(9)).predict(np.ones((1, 2))) == 1).all()


def test_marks_stay_hidden_and_unmarked_files_are_found():
    r = np.random.default_rng(2)
    hand = lambda i: "\n".join(f"function total{i}_{j}(items) {{\n  // adds the {j}th part\n  return items.value{j} + {r.integers(99)};\n}}" for j in range(r.integers(4, 9)))
    mini = lambda: "".join(f"function {chr(97 + r.integers(26))}{r.integers(9)}(t,e){{return t+e*{r.integers(99)}}}" for _ in range(r.integers(40, 80)))
    # half of the minified files are marked, by a name or a notice; a notice or a name changes no feature
    assert file_features("/*! kit 1.6.6 */\n" + (m := mini()), "/w/a.min.js") == file_features(m, "/w/a.js")
    rows = [(f"h{i}", False, file_features(hand(i), f"/w/h{i}.js")) for i in range(300)] + [(f"m{i}", i % 2 == 0, file_features(mini(), f"/w/m{i}.js")) for i in range(120)]
    forest, (share, _) = fit_origin(pd.DataFrame(rows, columns=["body", "marked", "x"]))
    score = forest.predict(np.array([x for *_, x in rows])) / share
    assert (score[:300] < 0.5).all() and (score[300:] > 0.5).mean() > 0.95 and 0.3 < share < 0.7
    assert fit_origin(pd.DataFrame([], columns=["body", "marked", "x"]))[1] == (1.0, 1.0)
    assert is_one_literal("x = [" + "1, " * 300 + "]", "a.py") and not is_one_literal("x = [1]", "a.py") and not is_one_literal("1, " * 300, "a.md")


def test_links_of_any_length():
    long = "a" * 3000
    assert without_links(f"<a href='{long}'>{long}</a> x").split() == ["x"] and without_links(f"[{long}](http://h.test/{long}) x").split() == ["x"]
    assert without_links("see h1.example/a/b and docs/a/b.json or ./x.ts").split() == ["see", "and", "docs/a/b.json", "or", "./x.ts"]
    assert without_links("<a href=x> open") == "<a href=x> open" and without_links("a <b>c</b>") == "a <b>c</b>"
    for bad in ("<a " * 60_000, "[" * 200_000, "[x](" * 60_000, "www." * 60_000):  # linear time
        page_features(bad)


def test_what_is_listed():
    listed = ["remote (12), schema (90), chunk (68), merger (34), schema (5), chunk (16)", "* h25.example/edge/6962\n* k37.example/relation/6783", "Tools in Aldton, Graph tools Belburg, Tools - Cedarby, Tools Dorham, Tools Estmere, Tools in Foxton",
              "SKU: a-1 | Color b-2 | SKU=c-3 | Size d-4 | SKU e-5 | Size f-6", "remote placeholder recursive duplicate mention partial node stale snapshot chunker transition orphaned"]
    for text in listed:
        assert page_facts(text)[0] > 0.9, text
    for text in (PROSE, "| a | string | " + PROSE + " |", "const a = b;\nreturn a;", "", "one, two, three", "It holds nodes, edges, files, chats, spans, links, hits and more."):
        assert page_facts(text)[0] < 0.1, text
    assert weak_label(np.array([0.0, 0.5, 0.9])).tolist()[::2] == [0.0, 1.0]


def test_trees_find_what_the_labels_leave_out():
    r = np.random.default_rng(4)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]
    spam = lambda: ", ".join(r.choice(words, r.integers(20, 60)))
    clean = lambda: " ".join(PROSE.replace("relation", r.choice(words)).replace("37", str(r.integers(99))) for _ in range(r.integers(1, 5)))
    x = np.array([page_features(t) for t in [clean() for _ in range(200)] + [spam() for _ in range(60)]])
    y = np.r_[np.zeros(200), np.ones(60)]
    held = r.random(260) < 0.4
    f = fit_forest(x[~held], y[~held], n_trees=40, max_depth=8, min_leaf=5)
    assert ((f.predict(x[held]) > 0.5) == y[held]).all()
