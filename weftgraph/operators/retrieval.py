"""Retrieval: vector top-k, BM25 full text, fusion, boosts, rerank merging, grep and fuzzy word search."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.semantics import cosine, text_similarity
from weftgraph.session import Scratch

K1, B = 1.2, 0.75
# Weights of fields in full text, and of scope types in code search.
FIELD_WEIGHTS = {"name": 3.0, "description": 2.0, "content": 1.0}
TYPE_BOOSTS = {"method": 1.15, "function": 1.15, "arrow": 1.10, "class": 1.05, "variable": 0.95, "property": 0.90}
LEVEL_CONFIDENCE = {0: 1.0, 1: 0.7, 2: 0.5}


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values)).cast("array<double>")


def vector_topk(rows: DataFrame, query: Column, k: int | None = 10, minimum: float | None = None, *, id_col: str = "id", vec_col: str = "vec", where: Column | None = None) -> DataFrame:
    """``id, score`` of the k rows most similar to the query (ties by id). Filters hold before the k are taken.

    An exact scan whose partial top-k never leave their partitions in full.
    """
    df = rows if where is None else rows.where(where)
    df = df.select(F.col(id_col).alias("id"), cosine(F.col(vec_col), query).alias("score"))
    if minimum is not None:
        df = df.where(F.col("score") >= minimum)
    df = df.orderBy(F.col("score").desc(), "id")
    return df if k is None else df.limit(k)


def semantic_step(prior: DataFrame, scored: DataFrame, keep_misses: bool = False) -> DataFrame:
    """Earlier scores and semantic ones as 0.3 and 0.7 parts. Rows without a semantic score go, or keep 0.3 of theirs."""
    j = prior.select("id", F.col("score").alias("_p")).join(scored.select("id", F.col("score").alias("_s")), "id", "left" if keep_misses else "inner")
    return j.select("id", (0.3 * F.col("_p") + 0.7 * F.coalesce("_s", F.lit(0.0))).alias("score"))


def multi_embedding_scores(embeddings: DataFrame, query: Column, minimum: float = 0.0) -> DataFrame:
    """``uuid, score``: the best score over a row's several embeddings (``uuid, kind, vec``) and its chunks' (``parent``)."""
    owner = F.coalesce("parent", "uuid") if "parent" in embeddings.columns else F.col("uuid")
    return embeddings.select(owner.alias("uuid"), cosine(F.col("vec"), query).alias("score")).where(F.col("score") >= minimum).groupBy("uuid").agg(F.max("score").alias("score"))


def best_chunk(chunk_hits: DataFrame, direct: DataFrame) -> DataFrame:
    """Chunk hits folded to their parents with the place of the best chunk, merged with direct hits by the greater score."""
    best = chunk_hits.groupBy("parent").agg(F.max_by(F.struct("chunk", "score"), F.struct("score", -F.col("chunk"))).alias("c"))
    a = best.select(F.col("parent").alias("id"), F.col("c.score").alias("_c"), F.col("c.chunk").alias("chunk"))
    return a.join(direct.select("id", F.col("score").alias("_d")), "id", "full").select("id", F.greatest("_c", "_d").alias("score"), "chunk")


def terms_of(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)


def postings(rows: DataFrame, fields: Mapping[str, str], id_col: str = "id") -> DataFrame:
    """``field, term, id, tf, len``: the inverted index of several text fields, one shuffle for all of them."""
    per = F.array(*(F.struct(F.lit(f).alias("field"), terms_of(F.coalesce(F.col(c), F.lit(""))).alias("terms")) for f, c in fields.items()))
    flat = rows.select(F.col(id_col).alias("id"), F.explode(per).alias("p")).select("id", "p.field", F.size("p.terms").alias("len"), F.explode("p.terms").alias("term"))
    return flat.groupBy("field", "term", "id").agg(F.count(F.lit(1)).alias("tf"), F.max("len").alias("len"))


def bm25(rows: DataFrame, fields: Mapping[str, str], query: str, *, fuzzy: int = 0, id_col: str = "id", weights: Mapping[str, float] | None = None) -> DataFrame:
    """``id, score``: Okapi BM25 over weighted fields; every term of the query must match in some field.

    A term matches an indexed one within ``fuzzy`` edits. Statistics cover all rows. Texts are read once; only counts of
    matching terms are ever shuffled. A query without terms gives no row.
    """
    weights = weights or FIELD_WEIGHTS
    terms = [t for t in dict.fromkeys(w for w in re.split(r"[^\w]+", query.lower()) if w)]
    if not terms:
        return rows.limit(0).select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"))

    def hits(field: str) -> Column:
        words = terms_of(F.coalesce(F.col(fields[field]), F.lit("")))
        same = lambda t: (lambda x: x == t) if not fuzzy else (lambda x: F.levenshtein(x, F.lit(t), fuzzy) >= 0)
        counts = F.transform(F.array(words), lambda ws: F.struct(F.size(ws).alias("len"), F.array(*(F.size(F.filter(ws, same(t))) for t in terms)).alias("tf")))
        return F.struct(F.lit(field).alias("field"), F.lit(float(weights.get(field, 1.0))).alias("w"), counts[0].alias("c"))

    # texts are cut to words once: what is written has a length and a count per query term for each field
    flat = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*(hits(f) for f in fields))).alias("p")).select("id", "p.field", "p.w", "p.c.len", "p.c.tf")
    flat = Scratch(rows.sparkSession, "bm25").write(flat)
    stats = flat.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, terms)).alias("term"), F.col("tf")))
    tf = flat.where(F.exists("tf", lambda x: x > 0)).select("id", "field", "w", "len", each.alias("c")).select("id", "field", "w", "len", "c.term", "c.tf").where("tf > 0")
    df_ = tf.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    # statistics have a row per field and per (field, query term)
    j = tf.join(F.broadcast(df_), ["field", "term"]).join(F.broadcast(stats), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("w") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return j.groupBy("id").agg(F.sum(part).alias("score"), F.count_distinct("term").alias("_t")).where(F.col("_t") == len(terms)).drop("_t")


def ranked(df: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` rows with their place from 1 (ties by id)."""
    top = df.orderBy(F.col("score").desc(), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "id")))  # at most limit rows


def hybrid(semantic: DataFrame, lexical: DataFrame, limit: int = 20, minimum: float = 0.3) -> DataFrame:
    """``id, score, source``: semantic scores raised by ``1 + 0.3 / sqrt(lexical place)``, and at most five lexical-only rows.

    Candidates are the best ``min(3 limit, 150)`` of each list; semantic ones need half the minimum, 0.1 at least.
    Lexical-only rows get 0.4, 0.35 and so on in their order.
    """
    cand = min(3 * limit, 150)
    sem = semantic.where(F.col("score") >= max(0.5 * minimum, 0.1)).orderBy(F.col("score").desc(), "id").limit(cand)
    lex = ranked(lexical, cand)
    raised = sem.join(lex.select("id", "rank"), "id", "left").select(
        "id", (F.col("score") * F.when(F.col("rank").isNull(), 1.0).otherwise(1 + 0.3 / F.sqrt("rank"))).alias("score"),
        F.when(F.col("rank").isNull(), "semantic").otherwise("both").alias("source"),
    )
    only = lex.join(sem.select("id"), "id", "left_anti")
    fill = only.withColumn("i", F.row_number().over(W.orderBy("rank"))).where("i <= 5").select("id", (0.4 - 0.05 * (F.col("i") - 1)).alias("score"), F.lit("lexical").alias("source"))
    return raised.unionByName(fill).orderBy(F.col("score").desc(), "id").limit(limit)


def reciprocal_rank_fusion(lists: Sequence[DataFrame], k: int = 60, limit: int = 20, depth: int = 150) -> DataFrame:
    """``id, score``: the sum of 1 / (k + place) over the lists."""
    out = None
    for df in lists:
        part = ranked(df, depth).select("id", (1.0 / (k + F.col("rank"))).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("score").alias("score")).orderBy(F.col("score").desc(), "id").limit(limit)


def finish_search(rows: DataFrame, minimum: float = 0.3, type_col: str = "type") -> DataFrame:
    """Minimum score, then classes that score 0.7 or more rise by a tenth."""
    boost = (F.col(type_col) == "class") & (F.col("score") >= 0.7)
    return rows.where(F.col("score") >= minimum).withColumn("score", F.when(boost, F.col("score") * 1.1).otherwise(F.col("score")))


SPLIT = r"[\s.\-_/\\:,;()\[\]{}]+"


def keyword_boost(rows: DataFrame, keywords: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``score`` raised by 0.15 times the best field's similarity to a keyword, if that is 0.6 or more.

    A keyword inside a field counts 1; else words of three letters or more count by edit distance.
    """
    low = [k.lower() for k in keywords if k]

    def of(field: str) -> Column:
        text = F.lower(F.coalesce(F.col(field), F.lit("")))
        inside = F.lit(False)
        for k in low:
            inside = inside | text.contains(k)
        words = F.filter(F.split(text, SPLIT), lambda w: F.length(w) > 2)
        # a lambda with a second parameter would get the index, so the keyword comes from an enclosing function
        near = lambda k: F.array_max(F.transform(words, lambda w: text_similarity(w, F.lit(k))))
        best = F.greatest(F.lit(0.0), F.lit(0.0), *(F.coalesce(near(k), F.lit(0.0)) for k in low))
        return F.when(F.length(F.trim(text)) == 0, 0.0).when(inside, 1.0).otherwise(best)

    sims = [of(f) for f in fields]
    best = F.greatest(*sims) if len(sims) > 1 else sims[0]
    return rows.withColumn("_b", best).withColumn("score", F.col("score") + F.when(F.col("_b") >= 0.6, F.col("_b") * 0.15).otherwise(0.0)).drop("_b")


def merge_reranked(rows: DataFrame, evaluations: DataFrame, strategy: str = "weighted", minimum: float = 0.0, top_k: int | None = None) -> DataFrame:
    """Scores merged with a judge's (``id, score``); rows that were not judged go.

    ``weighted`` 0.3 and 0.7; ``multiplicative``; ``llm-override`` the judge's above 0.9, else the mean.
    """
    ev = evaluations.where(F.col("score") >= minimum).select("id", F.col("score").alias("judge"))
    if top_k is not None:
        ev = ev.orderBy(F.col("judge").desc(), "id").limit(top_k)
    v, j = F.col("score"), F.col("judge")
    how = {
        "weighted": 0.3 * v + 0.7 * j,
        "multiplicative": v * j,
        "llm-override": F.when(j > 0.9, j).otherwise(0.5 * v + 0.5 * j),
    }
    if strategy not in how:
        raise ValueError(f"unknown strategy: {strategy}")
    return rows.join(ev, "id").withColumn("vector_score", v).withColumn("score", how[strategy])


def type_boost(rows: DataFrame, type_col: str = "type") -> DataFrame:
    """Code scores by scope type, at most 1; rows without a line range go."""
    f = F.lit(1.0)
    for t, b in TYPE_BOOSTS.items():
        f = F.when(F.col(type_col) == t, b).otherwise(f)
    return rows.where("start_line is not null and end_line is not null").withColumn("score", F.least(F.lit(1.0), F.col("score") * f))


def rag_score(rows: DataFrame, minimum: float, level_boost: Mapping[int, float] | None = None, decay_days: float | None = None, now: Column | None = None) -> DataFrame:
    """Similarity above the minimum times the level's boost and, with ``decay_days``, ``0.5 + 0.5 exp(-age / decay)``."""
    b = F.lit(1.0)
    for level, x in (level_boost or {}).items():
        b = F.when(F.col("level") == level, x).otherwise(b)
    s = F.col("score") * b
    if decay_days:
        age = (F.unix_micros(now if now is not None else F.current_timestamp()) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(86_400e6)
        s = s * (0.5 + 0.5 * F.exp(-age / decay_days))
    return rows.where(F.col("score") > minimum).withColumn("score", s)


def history_hits(turns: DataFrame, summaries: DataFrame, needle: str) -> DataFrame:
    """``id, level, score`` of turns (level 0) and summaries (1, 2) that contain a text, by the level's confidence."""
    conf = F.lit(0.0)
    for level, c in LEVEL_CONFIDENCE.items():
        conf = F.when(F.col("level") == level, c).otherwise(conf)
    all_ = turns.select("id", F.lit(0).alias("level"), "text").unionByName(summaries.select("id", "level", "text"))
    return all_.where(F.lower("text").contains(needle.lower())).select("id", "level", conf.alias("score")).distinct()


def lines_of(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, line``: every line, numbered from 1."""
    return rows.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("_p", "line")).select("id", (F.col("_p") + 1).alias("line_no"), "line")


def grep(rows: DataFrame, pattern: str, *, ignore_case: bool = False, id_col: str = "id", text_col: str = "text", context: int = 0, limit: int | None = 100) -> DataFrame:
    """``id, line_no, line, match, before, after``: lines with the pattern and their first match.

    A document is cut to lines in place; context comes from the same array, so nothing is shuffled before the limit.
    """
    p = f"(?i){pattern}" if ignore_case else pattern
    lines = rows.where(F.col(text_col).rlike(f"(?m){p}")).select(F.col(id_col).alias("id"), F.split(text_col, "\n", -1).alias("ls"))
    hit = lines.select("id", "ls", F.posexplode("ls").alias("_p", "line")).where(F.col("line").rlike(p))
    lo = F.greatest(F.col("_p") - context, F.lit(0))
    out = hit.select(
        "id", (F.col("_p") + 1).alias("line_no"), "line", F.regexp_extract("line", f"({p})", 1).alias("match"),
        F.slice("ls", lo + 1, F.col("_p") - lo).alias("before"), F.slice("ls", F.col("_p") + 2, F.lit(context)).alias("after"),
    )
    return out if limit is None else out.orderBy("id", "line_no").limit(limit)


def fuzzy_words(rows: DataFrame, keywords: Sequence[str], threshold: float = 0.7, mode: str = "any", *, id_col: str = "id", text_col: str = "text", limit: int | None = 50) -> DataFrame:
    """``id, word, keyword, similarity``: words of three letters or more near a keyword, the best keyword per word.

    ``mode='all'`` keeps only texts that have a word for every keyword.
    """
    words = rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.filter(F.split(F.lower(text_col), r"[^\w]+"), lambda w: F.length(w) >= 3))).alias("word"))
    k = F.explode(F.array(*(F.lit(x.lower()) for x in keywords))).alias("keyword")
    # the length bound spares most distances and loses no pair
    longer = F.greatest(F.length("word"), F.length("keyword"))
    near = words.select("id", "word", k).where(F.abs(F.length("word") - F.length("keyword")) <= F.floor(longer * (1 - threshold) + 1e-9))
    sim = text_similarity(F.col("word"), F.col("keyword"))
    got = near.withColumn("s", sim).where(F.col("s") >= threshold).groupBy("id", "word").agg(F.max(F.struct("s", F.col("keyword"))).alias("b"))
    got = got.select("id", "word", F.col("b.keyword").alias("keyword"), F.round("b.s", 2).alias("similarity"))
    if mode == "all":
        full = got.groupBy("id").agg(F.count_distinct("keyword").alias("n")).where(F.col("n") == len(set(x.lower() for x in keywords)))
        got = got.join(full.select("id"), "id", "left_semi")
    return got if limit is None else got.orderBy(F.col("similarity").desc(), "id", "word").limit(limit)


def batch_vector_topk(queries: DataFrame, rows: DataFrame, k: int = 5, *, id_col: str = "id", vec_col: str = "vec", block: int = 2_048) -> DataFrame:
    """``query, id, score``: for every row of ``queries(query, vec)`` its k most similar other rows (ties by id), exactly.

    The queries come in blocks of at most ``block`` vectors, whose size is thus bounded; each block is one matrix product
    per Arrow batch over a scan of the rows, and only a batch's own best k per query leave it. The exact way beside the
    learned partitions of the training-data operators, for stated query sets.
    """
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    spark = rows.sparkSession
    data = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    asked = queries.select(F.col("query").cast("long").alias("query"), F.col("vec").cast("array<double>").alias("vec")).where("query is not null and vec is not null")
    out, last = None, None
    while True:
        part = asked if last is None else asked.where(F.col("query") > last)
        got = part.orderBy("query").limit(block).collect()
        if not got and out is not None:
            break
        last = got[-1][0] if got else None
        dim = len(got[0][1]) if got else 0
        q = np.array([r[1] for r in got if len(r[1]) == dim], dtype=float).reshape(-1, max(dim, 1))
        ids = np.array([r[0] for r in got if len(r[1]) == dim])
        n = np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids, np.divide(q, n, out=np.zeros_like(q), where=n > 0)))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own, unit = shared.value
            for b in batches:
                b = b[b["vec"].map(len) == unit.shape[1]]
                if not len(b) or not len(own):
                    continue
                x, other = np.stack(b["vec"].to_numpy()), b["id"].to_numpy()
                m = np.linalg.norm(x, axis=1)
                s = np.round(unit @ (x / np.where(m > 0, m, 1)[:, None]).T, 12)
                s[own[:, None] == other[None, :]] = -np.inf
                # the smaller id first at equal scores
                order = np.lexsort((np.broadcast_to(other, s.shape), -s), axis=1)[:, :k]
                a = np.repeat(own, order.shape[1])
                got = pd.DataFrame({"query": a, "id": other[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})
                yield got[np.isfinite(got["score"])]

        found = data.mapInPandas(scan, "query long, id long, score double")
        w = W.partitionBy("query").orderBy(F.col("score").desc(), "id")
        found = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
        out = found if out is None else out.unionByName(found)
        if len(got) < block:
            break
    return out
