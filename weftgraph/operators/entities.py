"""Entity deduplication and mention graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import entity_id, entity_key, relation_type
from weftgraph.operators.strings import similar_pairs
from weftgraph.semantics import cosine, norm
from weftgraph.session import Scratch


def similar_names(entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``a, b, similarity`` (a < b by ``id``): entities of one type whose names are at least so similar.

    Equal names are reduced to their smallest id first, so a name that many rows share is compared once; pairs of rows
    with equal names stand in ``name_members``. Names meet by equal segments (``strings``), which loses no pair.
    """
    e = entities.groupBy("type", "name").agg(F.min("id").alias("id"))
    return similar_pairs(e, threshold, text_col="name", block=F.col("type"))


def name_members(entities: DataFrame) -> DataFrame:
    """``id, representative``: every entity with the smallest id of its type and name, under which ``similar_names``
    compares it. A null type or name equals no other, so such a row represents itself."""
    rep = entities.where("type is not null and name is not null").groupBy("type", "name").agg(F.min("id").alias("_rep"))
    return entities.join(rep, ["type", "name"], "left").select("id", F.coalesce("_rep", "id").alias("representative")).distinct()


#: Vectors that the others are grouped around to find similar ones.
PIVOTS = 64


def similar_vectors_in_type(entities: DataFrame, threshold: float = 0.9, pivots: int = PIVOTS) -> DataFrame:
    """``a, b, similarity``: entities of one type by cosine, every pair at or above the threshold.

    Each vector belongs to its nearest of a few pivots, and also comes as a guest to each pivot that is nearest to some
    vector within the threshold's angle r of it: by the triangle inequality those are at most 2r further away. Within a
    pivot only vectors meet whose angles to it differ by at most r. Vectors without direction are similar to none.
    """
    spark = entities.sparkSession
    rows = entities.select("id", "type", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    rows = rows.where("id is not null and type is not null and vec is not null").withColumn("_n", norm(F.col("vec"))).where("_n > 0")
    unit = Scratch(spark, "similar-vectors").write(rows.select("id", "type", F.transform("vec", lambda x: x / F.col("_n")).alias("vec")))
    drawn = unit.select("vec").orderBy(F.xxhash64("vec")).limit(pivots)  # a bounded number of vectors
    by_dim: dict[int, list] = {}
    for r in drawn.collect():
        by_dim.setdefault(len(r["vec"]), []).append(r["vec"])
    centres = {d: np.array(v, dtype=float) for d, v in by_dim.items()}
    angle = float(np.arccos(min(1.0, max(-1.0, threshold)))) + 1e-9

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for dim, b in whole.groupby(whole["vec"].map(len)):
                x = np.stack(b["vec"].to_numpy())
                # a length that no pivot has is one cell
                far = np.arccos(np.clip(x @ centres[dim].T, -1, 1)) if dim in centres else np.zeros((len(b), 1))
                row, pivot = np.nonzero(far <= far.min(axis=1, keepdims=True) + 2 * angle)
                out = b.iloc[row].reset_index(drop=True)
                out["dim"], out["pivot"], out["far"] = np.int32(dim), pivot.astype(np.int32), far[row, pivot]
                out["band"] = (out["far"] // angle).astype(np.int32)
                out["home"] = far.argmin(axis=1)[row] == pivot
                yield out[["id", "type", "vec", "dim", "pivot", "band", "far", "home"]]

    id_type = dict(unit.dtypes)["id"]
    placed = unit.mapInPandas(place, f"id {id_type}, type string, vec array<double>, dim int, pivot int, band int, far double, home boolean")
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    host = placed.where("home").select("type", "dim", "pivot", near, F.col("id").alias("h"), F.col("vec").alias("hv"), F.col("far").alias("hf"))
    guest = placed.select("type", "dim", "pivot", "band", F.col("id").alias("g"), F.col("vec").alias("gv"), F.col("far").alias("gf"))
    j = host.join(guest, ["type", "dim", "pivot", "band"]).where((F.col("h") != F.col("g")) & (F.abs(F.col("hf") - F.col("gf")) <= angle))
    s = j.withColumn("similarity", cosine(F.col("hv"), F.col("gv"))).where(F.col("similarity") >= threshold)
    pair = s.select(F.least("h", "g").alias("a"), F.greatest("h", "g").alias("b"), "similarity")
    return pair.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def hybrid_pairs(entities: DataFrame, fuzzy: float = 0.7, threshold: float = 0.9) -> DataFrame:
    """Pairs by ``0.4 name + 0.6 vector`` similarity; only name-similar candidates are looked at."""
    cand = similar_names(entities, fuzzy)
    v = entities.select("id", "vec")
    j = cand.join(v.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a").join(v.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b")
    s = 0.4 * F.col("similarity") + 0.6 * cosine(F.col("va"), F.col("vb"))
    return j.withColumn("similarity", s).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def canonical_of_pairs(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, canonical``: of each pair the one with higher confidence, then longer name, then smaller id stands for the
    other; of several pairs of one entity the last by the other's id counts. Not transitive."""
    e = entities.groupBy("id").agg(F.max("confidence").alias("confidence"), F.max(F.length("name")).alias("len"))
    side = lambda p: e.select(F.col("id").alias(p), F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), F.col("len").alias("l")).alias(f"_{p}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    first = F.col("_a") >= F.col("_b")
    return j.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("canonical")).groupBy("id").agg(F.max("canonical").alias("canonical"))


def canonical_of_members(entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``id, canonical`` of every entity that another one stands for, those of equal type and name included.

    Of equal names the one with the highest confidence leads, then the smallest id; leaders of similar names are
    weighed by ``canonical_of_pairs``, and every member follows its leader. Of several canonicals of one id the last counts.
    """
    e = entities.where("type is not null and name is not null").select("id", "type", "name", "confidence")
    first = F.min(F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("id")))
    leaders = e.groupBy("type", "name").agg(first.alias("f")).select("type", "name", F.col("f.id").alias("id"), (-F.col("f.c")).alias("confidence"))
    best = canonical_of_pairs(leaders, similar_names(leaders, threshold)).withColumnRenamed("id", "leader")
    top = leaders.select("type", "name", F.col("id").alias("leader")).join(best, "leader", "left").select("type", "name", F.coalesce("canonical", "leader").alias("canonical"))
    return e.select("id", "type", "name").join(top, ["type", "name"]).where(F.col("id") != F.col("canonical")).groupBy("id").agg(F.max("canonical").alias("canonical"))


def mention_graph(occurrences: DataFrame, minimum: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Entities (``id, key, name, type, n_mentions, n_documents``) and mentions (``src, dst``, one per occurrence)."""
    o = occurrences.where(F.coalesce("confidence", F.lit(1.0)) >= minimum).withColumn("key", entity_key(F.col("type"), F.col("name"))).withColumn("id", entity_id(F.col("type"), F.col("name")))
    nodes = o.groupBy("id").agg(F.min("key").alias("key"), F.min(F.trim("name")).alias("name"), F.min("type").alias("type"), F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("doc_id").alias("n_documents"))
    return nodes, o.select(F.col("doc_id").alias("src"), F.col("id").alias("dst"))


def entity_relations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``src, dst, type``: relations (``subject, object, predicate``) between entities (``id, name``), each once.

    A name means the entity of that normalised name (ties: the smallest id), else the smallest of those whose name
    contains it or is contained in it. Names inside others are found by equal runs of words, so no pair of all with all
    is made: a name that only shares a part of a word with another is not inside it.
    """
    clean = lambda c: F.lower(F.trim(c))
    e = entities.select("id", clean(F.col("name")).alias("name")).where("id is not null and name <> ''")
    exact = e.groupBy("name").agg(F.min("id").alias("id"))
    asked = relations.select(F.explode(F.array("subject", "object")).alias("n")).select(clean(F.col("n")).alias("name")).where("name <> ''").distinct()
    direct = asked.join(exact, "name")
    open_ = asked.join(exact.select("name"), "name", "left_anti")
    inner = F.explode(_runs(F.col("name"))).alias("run")
    longer = exact.select("id", inner).groupBy("run").agg(F.min("id").alias("id")).join(open_, F.col("run") == F.col("name")).select("name", "id")
    shorter = open_.select("name", inner).join(exact.select(F.col("name").alias("run"), "id"), "run").select("name", "id")
    loose = longer.unionByName(shorter).groupBy("name").agg(F.min("id").alias("id"))
    names = direct.unionByName(loose)
    a = names.select(F.col("name").alias("_s"), F.col("id").alias("src"))
    b = names.select(F.col("name").alias("_o"), F.col("id").alias("dst"))
    j = relations.join(a, clean(F.col("subject")) == F.col("_s")).join(b, clean(F.col("object")) == F.col("_o"))
    return j.select("src", "dst", relation_type(F.col("predicate")).alias("type")).distinct()


def _runs(name: Column) -> Column:
    """All runs of neighbouring words of a text."""
    words = F.split(name, r"\s+")
    n = F.size(words)
    starts = F.sequence(F.lit(1), n)
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(words, i, k), " ")))))


def deduplicated(
    entities: DataFrame, strategy: str = "fuzzy", *, excluded: Sequence[str] = (), embed: Callable[[Column], Column] | None = None, resolve: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``id, canonical`` of every entity, itself where none stands for it: by names (``fuzzy``), vectors (``embedding``),
    both (``hybrid``) or what ``resolve`` says of the similar names (``judge``).

    ``embed`` makes the vectors from the names where the rows have none; ``resolve`` gets pairs (``a, b, similarity``)
    and returns those to merge. Entities of excluded types stand for themselves. Chains are followed one step.
    """
    kept = entities.where(~F.coalesce(F.col("type").isin(list(excluded)), F.lit(False))) if excluded else entities
    if strategy in ("embedding", "hybrid") and "vec" not in kept.columns:
        if embed is None:
            raise ValueError(f"the strategy {strategy} needs vectors or a function that makes them")
        kept = kept.withColumn("vec", embed(F.col("name")))
    if strategy == "fuzzy":
        best = canonical_of_members(kept)
    elif strategy == "embedding":
        best = canonical_of_pairs(kept, similar_vectors_in_type(kept))
    elif strategy == "hybrid":
        best = canonical_of_pairs(kept, hybrid_pairs(kept))
    elif strategy == "judge" and resolve is not None:
        best = canonical_of_pairs(kept, resolve(similar_names(kept)))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return entities.select("id").distinct().join(best, "id", "left").select("id", F.coalesce("canonical", "id").alias("canonical"))
