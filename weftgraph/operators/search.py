"""The search that applications call: mode, filters, minimum, class boost; and what is done with its hits afterwards."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.patterns import glob_unanchored
from weftgraph.operators.retrieval import bm25, finish_search, grep, hybrid, keyword_boost, merge_reranked, vector_topk
from weftgraph.operators.traverse import explore
from weftgraph.sources.files import globbed

#: Context lines that a search in files gives at most.
MOST_CONTEXT = 5


def public_columns(rows: DataFrame) -> DataFrame:
    """Rows without vectors and digests: columns that begin with ``embedding`` or end in ``_hash``."""
    return rows.select(*(c for c in rows.columns if not c.startswith("embedding") and not c.endswith("_hash")))


def search(
    rows: DataFrame, text: str | None = None, vector: Column | None = None, *, fields: Mapping[str, str], mode: str = "lexical", where: Column | None = None, ids: DataFrame | None = None,
    glob: str | None = None, path_col: str = "path", limit: int | None = 20, minimum: float | None = None, fuzzy: int = 1, boost_classes: bool = True, id_col: str = "id", vec_col: str = "vec", type_col: str = "type",
) -> DataFrame:
    """The best rows with ``score``, by one of three modes: ``lexical`` (BM25 within ``fuzzy`` edits), ``semantic`` (cosine)
    or ``hybrid`` (both, fused).

    Conditions and ``ids`` hold before the best ``limit`` (None for all) are taken, the path's glob and the minimum afterwards; without
    vector every mode is lexical. The minimum is 0.3 unless the mode is lexical. Classes that score 0.7 or more rise by
    a tenth. Best first, ties by id.
    """
    df = rows if where is None else rows.where(where)
    if ids is not None:
        df = df.join(ids.select(F.col(id_col).alias("_i")), F.col(id_col) == F.col("_i"), "left_semi")
    if vector is None:
        mode = "lexical"
    if minimum is None and mode != "lexical":
        minimum = 0.3
    best = lambda d: d if limit is None else d.orderBy(F.col("score").desc(), "id").limit(limit)
    if mode == "lexical":
        hits = best(bm25(df, fields, text or "", fuzzy=fuzzy, id_col=id_col))
    elif mode == "semantic":
        hits = vector_topk(df, vector, limit, minimum, id_col=id_col, vec_col=vec_col)
    elif mode == "hybrid":
        if limit is None:
            raise ValueError("a fusion of two lists needs a limit")
        hits = hybrid(vector_topk(df, vector, None, id_col=id_col, vec_col=vec_col), bm25(df, fields, text or "", fuzzy=fuzzy, id_col=id_col), limit, minimum)
    else:
        raise ValueError(f"unknown mode: {mode}")
    found = df.drop("score").join(hits.select(F.col("id").alias("_i"), "score"), F.col(id_col) == F.col("_i")).drop("_i")
    if glob:
        found = found.where(F.col(path_col).rlike(glob_unanchored(glob)))
    if boost_classes and type_col in found.columns:
        found = finish_search(found, minimum if minimum is not None else float("-inf"), type_col)
    elif minimum is not None:
        found = found.where(F.col("score") >= minimum)
    return found.orderBy(F.col("score").desc(), id_col)


def post_process(
    hits: DataFrame, *, evaluations: DataFrame | None = None, strategy: str = "weighted", keywords: Sequence[str] = (), fields: Sequence[str] = (), limit: int | None = None,
    edges: DataFrame | None = None, depth: int = 1, summarise: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Steps on hits (``id, score``) in a fixed order: merge a judge's scores, raise keyword matches, take the best,
    explore around them, summarise them. Steps that nothing is given for are left out.

    ``results`` is always there; ``nodes`` and ``edges`` with an exploration, hits first and then by score; ``summary``
    is what ``summarise`` makes of the results.
    """
    df = hits
    if evaluations is not None:
        df = merge_reranked(df, evaluations, strategy)
    if keywords:
        df = keyword_boost(df, keywords, fields)
    if limit:
        df = df.orderBy(F.col("score").desc(), "id").limit(limit)
    out = {"results": df}
    if edges is not None and depth > 0:
        nodes, used = explore(df.select("id", "score"), edges, depth)
        out |= {"nodes": nodes.orderBy(F.col("is_hit").desc(), F.col("score").desc_nulls_last(), "node"), "edges": used}
    if summarise is not None:
        out["summary"] = summarise(df)
    return out


def grep_files(files: DataFrame, pattern: str, include: Sequence[str] = (), *, ignore_case: bool = False, context: int = 0, limit: int | None = 100, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Lines with a pattern in the files that a glob names, with at most ``MOST_CONTEXT`` lines around each."""
    return grep(globbed(files, include, path_col=path_col), pattern, ignore_case=ignore_case, id_col=path_col, text_col=text_col, context=min(max(context, 0), MOST_CONTEXT), limit=limit)
