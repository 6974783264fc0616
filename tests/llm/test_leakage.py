from __future__ import annotations

import random
import re
import unicodedata

import numpy as np
import pytest

from weftgraph.llm import leakage as L

D, I = "doc_id long, text string, item_id string", "item_id long, item_text string, text string"


def words(t):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t).lower())


def brute(docs, items, n=12):
    grams = lambda t: {tuple(words(t)[i : i + n]) for i in range(len(words(t)) - n + 1)}
    own = [(i, grams(t)) for i, t, *_ in items if i is not None and t]
    return {(d, i) for d, t, *_ in docs if d is not None and t for g in [grams(t)] for i, h in own if g & h}


def run(spark, docs, items):
    got = L.verbatim_leaks(spark.createDataFrame(docs, D), spark.createDataFrame(items, I))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(4)
    vocab = ["Under", "the", "Nar", "rule", "a", "Beacon", "unravels", "403", "lattices", "explain", "why", "Rov", "then", "12", "ms", "É", "e\u0301", "ﬁne", "STRASSE", "never"]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(5, 40))), "x") for i in range(12)] + [(None, "a " * 20, "x"), (50, None, "x"), (51, "", "x")]
    items.append((60, items[0][1], "x"))
    docs = [(900, None, "x"), (901, "", "x"), (None, items[0][1], "x"), (902, "word " * 20_000, "x")]
    for d in range(60):
        body = r.choices(vocab, k=r.randint(0, 30))
        if d % 2:
            ws = items[r.randrange(12)][1].split()
            lo = r.randrange(len(ws))
            cut = ws[lo : lo + r.randint(10, 16)]
            body[5:5] = [w.upper() if d % 3 else w for w in cut]
        docs.append((d, r.choice([" ", ", ", "\n"]).join(body), "x"))
    docs.append(docs[-1])
    want = brute(docs, items)
    assert len(want) > 5 and run(spark, docs, items) == want
    # a filter that is nearly full lets almost everything through to the join, which decides
    monkeypatch.setattr(L, "FILTER_BITS", (64, 64))
    assert run(spark, docs, items) == want
    monkeypatch.setattr(L, "VOCABULARY_CHARS", 10)
    with pytest.raises(ValueError):
        run(spark, docs, items)


def test_empty(spark):
    assert run(spark, [], []) == set() and run(spark, [(1, "a b", "x")], []) == set() and run(spark, [], [(1, "a " * 20, "x")]) == set()


def test_renamed_passages(spark):
    item = "Suppose that old Narvane writes 877 lines and then Tovpeth postpones 697 of them while the crooked furnace of Narvane annotates whatever was left in the quiet prism today."
    same = item.replace("Narvane", "Kesbex").replace("Tovpeth", "Ilora").replace("877", "12").replace("697", "99")
    torn = item.replace("Narvane", "Kesbex", 1)  # one name becomes two
    df = spark.createDataFrame([(1, same, ""), (2, torn, ""), (3, item, ""), (4, "nothing here " * 9, "")], D)
    got = {(r["doc_id"], r["item_id"]) for r in L.renamed_leaks(df, spark.createDataFrame([(7, item, "")], I)).collect()}
    assert got == {(1, 7)}


def test_renamed_passages_on_other_alignments(spark):
    item = "Suppose that old Narvane writes 877 lines and then Tovpeth postpones 697 of them while the crooked furnace of Narvane annotates whatever was left in the quiet prism today."
    same = item.replace("Narvane", "Kesbex").replace("Tovpeth", "Ilora").replace("877", "12").replace("697", "99")
    part = " ".join(same.split()[:20])
    torn = item.replace("Narvane", "Kesbex", 1)
    ws = same.split()
    split = " ".join([*ws[:12], "unheard", *ws[12:]])  # 12 words before the new one make a single window
    docs = [(1, f"{item} Unheard words. {part}", ""), (2, f"{torn} Unheard words. {part}", ""), (3, split, ""), (4, f"{item} Unheard words. {torn}", ""), (5, f"{same} Unheard words. {same}", "")]
    got = [(r["doc_id"], r["item_id"], r["n_windows"]) for r in L.renamed_leaks(spark.createDataFrame(docs, D), spark.createDataFrame([(7, item, "")], I)).collect()]
    n = len(ws)
    assert sorted(got) == [(1, 7, 9), (2, 7, 9), (3, 7, n - 12 - 11), (5, 7, n - 11)]


def test_copies_of_items_that_repeat_their_template(spark):
    half = "Suppose that old Narvane writes 877 lines and then rests a while beside the quiet river until dawn comes again. "
    item = half + half.replace("Narvane", "Tovpeth").replace("877", "697")
    docs = [(1, item, ""), (2, item.replace("697", "12").replace("Tovpeth", "Ilora"), "")]
    got = {r["doc_id"] for r in L.renamed_leaks(spark.createDataFrame(docs, D), spark.createDataFrame([(7, item + "Narvane and Tovpeth wait.", "")], I)).collect()}
    assert got == {2}


def test_names_come_from_all_items(spark):
    # alone, the first item takes Harbor for a name; the second one's spelling makes it a word
    a = "We were told that old Harbor writes every line twice and then rests beside the quiet river until the dawn comes again."
    b = "the harbor is a word like any other word and stands in this second item without a capital letter at all, as it should."
    doc = a.replace("Harbor", "Vessel")
    docs = spark.createDataFrame([(1, doc, "")], D)
    got = lambda rows: [tuple(r)[:2] for r in L.renamed_leaks(docs, spark.createDataFrame(rows, I)).collect()]
    assert got([(7, a, "")]) == [(1, 7)] and got([(7, a, ""), (8, b, "")]) == []


def test_the_filter_holds_every_window(spark):
    h = np.array([1, -5, 2**62 + 77, -(2**63), 123456789], dtype=np.int64)
    keep = L.Filter.of(spark.createDataFrame([(int(x),) for x in h], "template long"), len(h))
    assert keep.may_hold(h.view(np.uint64)).all()
    other = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 10_000).view(np.uint64)
    assert keep.may_hold(other).mean() < 0.01
