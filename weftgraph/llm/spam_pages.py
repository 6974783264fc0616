"""Keyword-stuffed pages and link lists: bagged trees on content and link features, smoothed by the host's spam rate.

Pages are weakly labelled by how much of them stands in units that are lists by their form; the trees do not see those
shares, but statistics of words, marks and sentences, and their score decides. Pages between the two sure shares are
left out of the labels.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.sampling import bounded_sample
from weftgraph.llm.trees import fit_forest
from weftgraph.session import Scratch

#: Most labelled pages that the trees are fitted on.
SAMPLE_ROWS = 20_000
#: Weak labels: a page is taken for spam, or for none, if at least, or at most, this share of it is listed.
SURE_SPAM, SURE_CLEAN = 0.65, 0.35
#: A unit without the end of a sentence is a list from so many items on, of so few words each, and a run of keywords
#: from so many words on, of which at most this share are function words.
LIST_ITEMS, ITEM_WORDS, RUN_WORDS, RUN_FUNCTION = 6, 4.5, 12, 0.08
#: Fewer words, those of links included, are too few to repeat or to list anything.
LEAST_WORDS = 3
#: Pages of its host that weigh as much as the page itself, and the most that the host can weigh.
HOST_PRIOR, HOST_WEIGHT = 20.0, 0.3

# Function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "a an the of to in on at by for from with without and or but if then than that this these those it its is are was were be been"
    " has have had do does did does not no so as which who whom whose what when where why how may might can could should would will must"
    " i you he she we they them us our your their his her my me into onto over under before after while because although though"
    " once twice again both each every only other same such too very just also more most less few many one two neither nor"
    " le la les un une des du de d l et ou mais si alors que qui quoi dont où quand comment pourquoi ce cet cette ces il elle on nous"
    " vous ils elles ne pas plus rien personne sans avec pour par dans sur sous avant après pendant est sont était a ont avait être"
    " avoir car donc au aux son sa ses leur leurs en y à tout toute tous"
    " der die das den dem des ein eine einen einem einer und oder aber wenn dann dass weil damit warum wie wo wann wer was ist sind"
    " war waren wird werden hat haben hatte nicht kein keine nichts mehr ohne mit für von vom zu zum zur im am an auf aus bei nach"
    " vor über unter es er sie wir ihr sich niemand alles falls seit"
    " el los las una unos unas del al y o pero si cuando como porque para por con sin sobre entre hasta desde es son fue era ha han"
    " había ser estar no ni nada nadie que quien cual se su sus este esta estos estas ese esa lo le les ya más muy".split()
)
# none of these patterns can run over the next mark of its kind, so texts of any length take linear time
ANCHOR = re.compile(r"<a\b[^<>]*>|</a\s*>", re.I)
LINK = re.compile(
    r"!?\[[^\[\]\n]*\]\([^()\s]+\)|(?:https?:)?//[\w.\-]+\.\w+[^\s<>\"')\]]*|\bwww\.[\w.\-]+[^\s<>\"')\]]*"
    r"|(?<![\w./@\-])[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.[a-z]{2,}/[^\s<>\"')\],|]*",
    re.I,
)
ITEM = re.compile(r"[,|;•·]|\s[-–—]\s")
WORD = re.compile(r"[^\W\d_]+")
TAG = re.compile(r"(?<!\S)#\w+")
BREAK = re.compile(r"(?<=[.!?;])\s+|\n+")
PAIR = re.compile(r"\s*[\w.\-]{2,20}\s*[:=]?\s+?\S{2,40}\s*$|\s*[\w.\-]{2,20}\s*[:=]\s*\S{1,40}\s*$")
CODE = re.compile(r"[{}();=]{2,}|=>|\)\s*\{|^\s*(?:def|func|return|const|let|import|from)\b|\d{4}-\d\d-\d\d[ T]\d\d:\d\d|^\s*\|.*\|\s*$|^\s{4,}\S")

FEATURES = (
    "sentences", "function_words", "distinct", "top_words", "ratio", "digits", "n_words", "line_length", "link_marks", "separators", "bigrams",
    "capitals", "bare_units", "code", "first_words",
)


def without_links(unit: str) -> str:
    """The unit with a blank for each link: anchors with their texts, Markdown links, addresses with or without scheme."""
    if not ("/" in unit or "](" in unit or "ww." in unit):  # every form of a link has one of these
        return unit
    out, at, opened = [], 0, None
    for m in ANCHOR.finditer(unit) if "</" in unit else ():
        if m[0][1] != "/":
            opened = m.start() if opened is None else opened
        elif opened is not None:
            out += [unit[at:opened], " "]
            at, opened = m.end(), None
    return LINK.sub(" ", "".join([*out, unit[at:]]))


def page_facts(text: str) -> tuple[float, list[float]]:
    """The share of a text that is listed, and its features in the order of ``FEATURES``.

    Listed are units whose larger part is links, tags, recurring keywords, pairs of a name and a value under recurring
    names, short items between separators, or a run of keywords. Shares are of the characters that are not blank.
    """
    units = [u for u in BREAK.split(text) if u and not u.isspace()]
    total = float(sum(map(len, units))) or 1.0
    bare = [without_links(u) for u in units]
    words = [WORD.findall(b.lower()) for b in bare]
    owns = [[w for w in ws if w not in FUNCTION_WORDS] for ws in words]
    outside = Counter(chain.from_iterable(owns))
    # a keyword recurs more often than prose repeats its subject
    least = max(5, 0.04 * sum(outside.values()))
    hot = {w for w, c in outside.items() if c >= least}
    # the features count the words of links too, or a page of nothing but links would have none
    linked = [WORD.findall(u.lower()) for u, b in zip(units, bare) if b is not u]
    every = list(chain.from_iterable(linked + [ws for u, b, ws in zip(units, bare, words) if b is u]))
    n_words, n_pairs = len(every), max(0, len(every) - 1)
    pairs = set(zip(every, every[1:]))
    content = Counter(every)
    for w in content.keys() & FUNCTION_WORDS:
        del content[w]
    n_content = sum(content.values())
    heads = Counter(ws[0] for ws in words if ws)
    sentence = listed = empty = code = 0.0
    for u, b, ws, own in zip(units, bare, words, owns):
        size = len(u)
        ended = u.rstrip()[-1:] in ".!?:;…"
        prose = len(ws) >= 4 and 5 * (len(ws) - len(own)) > len(ws) and ended
        is_link = b is not u and size - len(b.replace(" ", "")) - u.count(" ") > 0.5 * size
        is_tag = "#" in u and len(TAG.findall(u)) >= 2
        is_code = not prose and bool(CODE.search(u))
        form = False
        if not prose and ws and not is_code:
            form = bool(own) and bool(hot) and sum(w in hot for w in own) >= 0.5 * len(own)
            form = form or (heads[ws[0]] >= 4 and len(u.split()) <= 4 and bool(PAIR.match(u)))
            if not form and not ended:
                items = 1 + len(ITEM.findall(b))
                form = (items >= LIST_ITEMS and len(ws) <= ITEM_WORDS * items) or (len(ws) >= RUN_WORDS and len(ws) - len(own) <= RUN_FUNCTION * len(ws))
        sentence += size * (prose and not is_link)
        empty += size * (len(ws) == len(own))
        code += size * is_code
        listed += size * (is_link or is_tag or form)
    raw = text.encode("utf-8", "surrogatepass")
    octets = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    count = lambda chars: float(octets[np.frombuffer(chars, dtype=np.uint8)].sum())
    full = max(1, n_words)
    return listed / total, [
        sentence / total,
        1 - n_content / n_words if n_words else 0.0,
        len(content) / n_content if n_content else 1.0,
        sum(sorted(content.values())[-5:]) / n_content if n_content else 0.0,
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        count(b"0123456789") / max(1, len(raw)),
        float(np.log1p(n_words)),
        float(np.log1p(total / max(1, len(units)))),
        float(np.log1p(sum(len(u) - len(b) for u, b in zip(units, bare)) / total * 10)),
        count(b"|,;#=\xc2\xb7") / full,
        len(pairs) / n_pairs if n_pairs else 1.0,
        count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / full,
        empty / total,
        code / total,
        max(heads.values()) / len(units) if heads else 0.0,
    ]


def page_features(text: str) -> list[float]:
    """The features of a text, in the order of ``FEATURES``."""
    return page_facts(text)[1]


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        facts = [page_facts(t) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"], "host": b["host"], "listed": [x for x, _ in facts], "x": [x for _, x in facts]})


def weak_label(listed: np.ndarray) -> np.ndarray:
    """1 spam, 0 none, nan undecided, by the listed share."""
    return np.where(listed >= SURE_SPAM, 1.0, np.where(listed <= SURE_CLEAN, 0.0, np.nan))


def spam_scores(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, score``: the probability that a page is spam; rows of one id count once, with their highest score.

    One pass makes the features (the only pass over the texts), a bounded sample of the weakly labelled pages fits the
    trees, and a second pass over the features predicts. The host's rate, without the page itself, then pulls the
    prediction by at most ``HOST_WEIGHT``; pages without host or alone on it keep theirs. Null texts and ids give no
    row; a text of fewer than ``LEAST_WORDS`` words, a blank one say, is no spam.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "spam")
    # an address's host; a column of this name is optional
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.\-]*://(?:[^/@\s]*@)?([^/:?#\s]+)", 1)) if "url" in documents.columns else F.lit("")
    pages = documents.where("text is not null and doc_id is not null").select("doc_id", "text", F.coalesce(host, F.lit("")).alias("host"))
    feats = scratch.write(pages.mapInPandas(_features, "doc_id long, host string, listed double, x array<double>"), "features")
    labelled = feats.where((F.col("listed") >= SURE_SPAM) | (F.col("listed") <= SURE_CLEAN))
    drawn = bounded_sample(labelled, F.col("doc_id"), sample_rows, labelled.count()).select("doc_id", "listed", "x").toPandas().sort_values("doc_id")
    x = np.array(drawn["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    model = spark.sparkContext.broadcast(fit_forest(x, weak_label(drawn["listed"].to_numpy(dtype=float)), n_trees=40, max_depth=8, min_leaf=5))

    at = FEATURES.index("n_words")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.array(b["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": b["doc_id"], "host": b["host"], "p": np.where(m[:, at] < np.log1p(LEAST_WORDS), 0.0, model.value.predict(m))})

    scored = scratch.write(feats.mapInPandas(score, "doc_id long, host string, p double"), "scored")
    rates = scored.where("host <> ''").groupBy("host").agg(F.sum("p").alias("_s"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    n = F.col("_n") - 1
    weight = F.least(F.lit(HOST_WEIGHT), n / (n + HOST_PRIOR))
    smooth = F.when(F.col("_n").isNull(), F.col("p")).otherwise((1 - weight) * F.col("p") + weight * (F.col("_s") - F.col("p")) / n)
    return scored.join(rates, "host", "left").groupBy("doc_id").agg(F.max(smooth).alias("score"))


def spam_pages(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id`` of the pages whose score is above the threshold."""
    return spam_scores(documents).where(F.col("score") > threshold).select("doc_id")
