"""Evaluation texts in training text: template windows, hash join, slot check.

Numbers, names and units become typed placeholders, so a window of an item and a re-parameterised copy of it have one
template. The windows of the items are a table; those of the documents that may be in it, by a filter of fixed size, are
joined with it by template. Then the slots decide: equal slots make a verbatim leak, a one-to-one renaming of slots a
re-parameterised one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import Scratch

WINDOW = 12
#: Bits of the filter of item windows that goes to every task: 16 a window, at most 8 MB. A fuller filter lets more
#: windows through to the join, which drops them.
FILTER_BITS = (1 << 16, 1 << 26)
#: Most characters of the items' distinct words, which go to every task. More are refused, not cut.
VOCABULARY_CHARS = 64_000_000
#: A template window with fewer ordinary words says too little about an item to count as a re-parameterised leak.
MIN_FIXED = 6

#: Overlapping windows that a re-parameterised passage needs: 14 words in a row.
MIN_WINDOWS = 3

_WORD = re.compile(r"[^\W_]+")
# Unit words; in a template they stand for their kind.
UNITS = frozenset("ms s sec second seconds min minute minutes hour hours day days week weeks year years kb mb gb tb km m cm mm kg g percent seconde secondes heure heures jour jours".split())
_NUM, _NAME, _UNIT, _FIRST = 1, 2, 3, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)


_BREAK = re.compile(r"[.!?:;\n]")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits after compatibility composition, in lower case."""
    return _words(unicodedata.normalize("NFKC", text))


def _words(composed: str) -> list[str]:
    return _WORD.findall(composed.lower())


def _capitals(composed: str) -> set[str]:
    """Words in lower case that have a capital somewhere inside a sentence."""
    out, end = set(), 0
    for m in _WORD.finditer(composed):
        if composed[m.start()].isupper() and end and not _BREAK.search(composed, end, m.start()):
            out.add(m[0].lower())
        end = m.end()
    return out


def word_facts(items: DataFrame) -> DataFrame:
    """``word, is_name`` of all items: a name is a word with a capital inside a sentence, and never without one.

    Names depend on the items only, so a document's letter case cannot change the template of a verbatim copy.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[str, list[bool]] = {}
            for text in b["item_text"]:
                composed = unicodedata.normalize("NFKC", text)
                inside = _capitals(composed)
                for m in _WORD.finditer(composed):
                    w = m[0].lower()
                    s = seen.setdefault(w, [False, False])
                    s[0] |= not composed[m.start()].isupper()
                    s[1] |= w in inside
            yield pd.DataFrame([(w, *s) for w, s in seen.items()], columns=["word", "small", "inside"])

    facts = items.mapInPandas(scan, "word string, small boolean, inside boolean")
    return facts.groupBy("word").agg((F.max("inside") & ~F.max("small")).alias("is_name"))


def vocabulary(items: DataFrame, scratch: Scratch) -> tuple[dict[str, int], frozenset[str]]:
    """Codes of the ordinary words of all items, and their names; refuses more than ``VOCABULARY_CHARS``."""
    facts = scratch.write(word_facts(items), "words")
    chars = facts.agg(F.sum(F.length("word"))).head()[0] or 0
    if chars > VOCABULARY_CHARS:
        raise ValueError(f"the items have {chars} characters of distinct words; at most {VOCABULARY_CHARS} fit the tasks")
    rows = [r for r in facts.collect() if not r["word"].isdigit()]
    names = frozenset(r["word"] for r in rows if r["is_name"])
    words = sorted({r["word"] for r in rows} - names - UNITS)
    return {w: _FIRST + i for i, w in enumerate(words)}, names


def _codes(words: list[str], vocab: dict[str, int], names: frozenset[str], capital: set[str]) -> np.ndarray:
    def code(w: str) -> int:
        c = vocab.get(w)
        if c is not None:
            return c
        if w.isdigit():
            return _NUM
        if w in names:
            return _NAME
        if w in UNITS:
            return _UNIT
        return _NAME if w in capital else 0

    return np.fromiter(map(code, words), dtype=np.uint64, count=len(words))


def _hashes(codes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Rolling hashes of all windows; those that hold an unknown word (code 0) hash to 0."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(1)) * _BASE
        mixed ^= mixed >> np.uint64(29)
        h = np.zeros(n, dtype=np.uint64)
        for i in range(width):
            h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[i : i + n]
        h ^= h >> np.uint64(31)
    known = np.cumsum(np.concatenate(([0], codes == 0)))
    h[known[width:] - known[:-width] > 0] = 0
    return h


class Filter(NamedTuple):
    """Bits set at four places of each hash, so a hash without all of them is in no item."""

    words: np.ndarray

    @staticmethod
    def places(h, bits: int):
        """Four places of a hash; ``h`` is an array, or a Column of a long."""
        if isinstance(h, np.ndarray):
            h = h.view(np.int64)
            return [(h >> np.int64(s)) & np.int64(bits - 1) for s in (0, 13, 26, 37)]
        return [F.shiftright(h, s).bitwiseAND(F.lit(bits - 1)) for s in (0, 13, 26, 37)]

    @classmethod
    def of(cls, windows: DataFrame, n: int) -> Filter:
        """From a table's column ``template``, as at most ``FILTER_BITS[1] / 64`` rows of combined bits."""
        bits = min(max(1 << (16 * max(n, 1) - 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
        place = windows.select(F.explode(F.array(*cls.places(F.col("template"), bits))).alias("p"))
        word = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        got = np.zeros(bits // 64, dtype=np.int64)
        for r in word.collect():
            got[r["w"]] = r["b"]
        return cls(got.view(np.uint64))

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), dtype=bool)
        for p in self.places(h, 64 * len(self.words)):
            ok &= (self.words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
        return ok


def _windows(key, text: str, vocab, names, keep: Filter | None, cased: bool) -> Iterator[tuple]:
    composed = unicodedata.normalize("NFKC", text)
    words = _words(composed)
    if len(words) < WINDOW:
        return
    capital = _capitals(composed) if cased else set()
    codes = _codes(words, vocab, names, capital)
    h = _hashes(codes)
    at = np.arange(len(h)) if keep is None else np.flatnonzero(keep.may_hold(h) & (h != 0))
    for p in at:
        part, kinds = words[p : p + WINDOW], codes[p : p + WINDOW]
        slots = [f"{int(k)}:{w}" for w, k in zip(part, kinds) if k < _FIRST]
        yield key, int(p), int(h[p].astype(np.int64)), " ".join(part), slots


_SCHEMA = "pos long, template long, exact string, slots array<string>"


def window_tables(documents: DataFrame, items: DataFrame, scratch: Scratch, renamed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Windows of the documents that an item may have, and those of the items: ``doc_id`` or ``item_id`` and ``_SCHEMA``.

    Vocabulary and names come from all items, so a result does not depend on which items are asked for together. The
    documents are read in one pass, and no text is shuffled. Without ``renamed`` unknown capitalised words are no names,
    which is enough for verbatim leaks.
    """
    spark = documents.sparkSession
    docs = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    rows = scratch.write(items.where("item_text is not null and item_id is not null").select("item_id", "item_text").distinct(), "items")
    vocab, names = vocabulary(rows, scratch)
    words = spark.sparkContext.broadcast((vocab, names))

    def scan(kind: str, keep, cased: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            (v, n), k = words.value, keep.value if keep else None
            for b in batches:
                out = [w for key, text in zip(b.iloc[:, 0], b.iloc[:, 1]) for w in _windows(key, text, v, n, k, cased)]
                yield pd.DataFrame(out, columns=[kind, "pos", "template", "exact", "slots"])

        return run

    of_items = scratch.write(rows.mapInPandas(scan("item_id", None, False), f"item_id long, {_SCHEMA}"), "windows")
    keep = spark.sparkContext.broadcast(Filter.of(of_items, of_items.count()))
    return docs.mapInPandas(scan("doc_id", keep, renamed), f"doc_id long, {_SCHEMA}"), of_items


def template_matches(documents: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of windows with one template: ``doc_id, item_id, dpos, ipos, verbatim, dslots, islots``; equal slots make a
    pair verbatim."""
    of_docs, of_items = window_tables(documents, items, scratch)
    return of_docs.alias("d").join(of_items.alias("i"), "template").select(
        "doc_id", "item_id", F.col("d.pos").alias("dpos"), F.col("i.pos").alias("ipos"),
        (F.col("d.slots") == F.col("i.slots")).alias("verbatim"), F.col("d.slots").alias("dslots"), F.col("i.slots").alias("islots"),
    )


def verbatim_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id``: at least ``WINDOW`` consecutive words of the item stand in the document.

    Windows with one template and equal slots, so windows of other values never meet; the words are compared once
    more, since templates are hashes. Null and short texts have no window. Rows with equal ids count once; equal items
    each give a row.
    """
    of_docs, of_items = window_tables(documents, items, Scratch(documents.sparkSession, "verbatim"), renamed=False)
    own = of_items.select("item_id", "template", "slots", F.col("exact").alias("_own")).distinct()
    return of_docs.join(own, ["template", "slots"]).where(F.col("exact") == F.col("_own")).select("doc_id", "item_id").distinct()


def renamed_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_windows, n_slots``: passages that follow an item's template with other values.

    The windows of one pair are read on each of their alignments (document place minus item place). An alignment counts
    if its slots map one to one in both directions over all its windows, at least one value differs, each window keeps
    ``MIN_FIXED`` ordinary words, and there are ``MIN_WINDOWS`` of them. A window of the document that stands verbatim
    elsewhere in the item differs in nothing: items that repeat their own template would else match their copies. Of
    several alignments that count the one with the most windows, then the most slots, gives the figures.
    """
    scratch = Scratch(documents.sparkSession, "leakage")
    m = template_matches(documents, items, scratch).where(F.size("islots") <= WINDOW - MIN_FIXED)
    m = scratch.write(m.withColumn("shift", F.col("dpos") - F.col("ipos")), "matches")
    copied = m.where("verbatim").select("doc_id", "item_id", "dpos", F.lit(True).alias("copied")).distinct()
    other = ~F.col("verbatim") & F.col("copied").isNull()
    lanes = m.join(copied, ["doc_id", "item_id", "dpos"], "left").groupBy("doc_id", "item_id", "shift").agg(F.count(F.lit(1)).alias("n_windows"), F.max(other).alias("changed"))
    slots = (
        m.join(lanes.where(F.col("changed") & (F.col("n_windows") >= MIN_WINDOWS)), ["doc_id", "item_id", "shift"])
        .select("doc_id", "item_id", "shift", "n_windows", F.explode(F.arrays_zip("dslots", "islots")).alias("s"))
        .select("doc_id", "item_id", "shift", "n_windows", F.col("s.dslots").alias("a"), F.col("s.islots").alias("b"))
        .distinct()
    )
    return (
        slots.groupBy("doc_id", "item_id", "shift", "n_windows")
        .agg(F.count(F.lit(1)).alias("n_slots"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"))
        .where("n_slots = na and n_slots = nb")
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("n_windows", "n_slots")).alias("b"))
        .select("doc_id", "item_id", "b.n_windows", "b.n_slots")
    )
