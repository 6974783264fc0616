"""The k most similar vectors of every vector by learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts, a small network learns to tell a vector's part, and
it then assigns every vector to its most probable part and routes every query to several. Inside a part the true
cosines decide. How many parts a query visits follows from held-out sample vectors and is the same rule at any size.
A sample can teach so many parts only; larger collections are cut twice, each part of the first cut again by a network
fitted on a sample of its own.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm.sampling import bounded_sample
from weftgraph.session import Scratch

#: Most vectors that graph and network are fitted on; a tenth of them is held out to choose the number of parts to visit.
SAMPLE_ROWS = 20_000
#: Vectors a part should hold, and sample vectors that a part needs to be learned.
PART_ROWS, PART_SAMPLE = 2_000, 64
#: Share of the held-out vectors' sample neighbours that the visited parts must hold.
TARGET_RECALL = 0.995
#: Most vectors and queries of one group of work; larger parts are split, so no group grows with the data.
BASE_BLOCK, QUERY_BLOCK = 8_192, 16_384


@dataclass
class Router:
    """A network with one hidden layer from vectors to parts, and the number of parts to visit."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each row, most probable first."""
        z = self.logits(x)
        n = min(n, z.shape[1])
        top = np.argpartition(-z, n - 1, axis=1)[:, :n]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(z, top, 1), axis=1, kind="stable"), 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def sample_graph(x: np.ndarray, k: int, block: int = 256) -> np.ndarray:
    """The k nearest rows of each row by cosine."""
    out = np.empty((len(x), k), dtype=np.int64)
    for lo in range(0, len(x), block):
        s = x[lo : lo + block] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, n_parts: int, rng: np.random.Generator, slack: float = 1.1) -> np.ndarray:
    """Parts of near equal size that cut few edges: balanced k-means to begin with, then moves towards the neighbours.

    A node moves to the part of most of its neighbours while that part has room; the strongest wishes go first.
    """
    n, room = len(x), int(np.ceil(slack * len(x) / n_parts))
    centres = x[rng.choice(n, n_parts, replace=False)]
    part = np.zeros(n, dtype=np.int64)
    for _ in range(8):
        part = _fill(x @ centres.T, room)
        sums = np.zeros_like(centres)
        np.add.at(sums, part, x)
        centres = unit(sums)
    for _ in range(10):
        votes = np.zeros((n, n_parts), dtype=np.float32)
        for j in range(graph.shape[1]):
            votes[np.arange(n), part[graph[:, j]]] += 1
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), part]
        size, moved = np.bincount(part, minlength=n_parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < room:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if moved < n // 500:
            break
    return part


def _fill(score: np.ndarray, room: int) -> np.ndarray:
    """Each row's best column with room left; rows that lose most by waiting choose first."""
    order = np.argsort(-score, axis=1)
    top = np.sort(score, axis=1)
    regret = top[:, -1] - top[:, -2] if score.shape[1] > 1 else top[:, -1]
    left, out = np.full(score.shape[1], room), np.empty(len(score), dtype=np.int64)
    for i in np.argsort(-regret, kind="stable"):
        for c in order[i]:
            if left[c]:
                left[c] -= 1
                out[i] = c
                break
    return out


def fit_router(x: np.ndarray, n_parts: int, *, k: int = 10, hidden: int = 128, epochs: int = 25, seed: int = 7) -> Router:
    """Graph, parts and network from unit vectors. A vector's target is its own part and those of its neighbours."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    if n_parts <= 1 or len(x) <= k:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = sample_graph(x, k)
    part = balanced_parts(x, graph, n_parts, rng)
    target = np.zeros((len(x), n_parts), dtype=np.float32)
    for j in range(k):
        target[np.arange(len(x)), part[graph[:, j]]] += 1.0 / (k + 2)
    target[np.arange(len(x)), part] += 2.0 / (k + 2)
    held = rng.permutation(len(x)) < max(1, len(x) // 10)
    train = np.flatnonzero(~held)
    p = [
        rng.normal(0, np.sqrt(2 / d), (d, hidden)).astype(np.float32), np.zeros(hidden, np.float32),
        rng.normal(0, np.sqrt(1 / hidden), (hidden, n_parts)).astype(np.float32), np.zeros(n_parts, np.float32),
    ]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    x32 = x.astype(np.float32)
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 0.0002
        rng.shuffle(train)
        for lo in range(0, len(train), 256):
            rows = train[lo : lo + 256]
            h = np.maximum(x32[rows] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z -= z.max(1, keepdims=True)
            e = np.exp(z)
            g = (e / e.sum(1, keepdims=True) - target[rows]) / len(rows)
            gh = (g @ p[2].T) * (h > 0)
            step += 1
            for i, grad in enumerate((x32[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    r = Router(*p)
    home = r.parts(x32, 1)[:, 0]
    routes = r.parts(x32[held], n_parts)
    near = home[graph[held][:, : min(5, k)]]
    # place of the neighbour's part in the query's route
    place = np.argsort(routes, axis=1)[np.arange(len(routes))[:, None], near]
    reached = np.sort(place.ravel())
    r.probes = int(reached[min(len(reached) - 1, int(np.ceil(TARGET_RECALL * len(reached))) - 1)]) + 1
    return r


def usable_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """``uuid, vec``: one row per uuid with a vector of ``dim`` finite numbers that are not all zero."""
    good = (
        (F.size("embedding") == dim)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0)
    )
    return (
        rows.where(F.col("uuid").isNotNull() & F.col("embedding").isNotNull())
        .select("uuid", F.col("embedding").cast("array<float>").alias("embedding"))
        .where(good)
        .groupBy("uuid")
        .agg(F.max("embedding").alias("vec"))
    )


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float32) if len(column) else np.empty((0, dim), np.float32)


def part_numbers(n: int, sample: int) -> tuple[int, int]:
    """Parts of the first cut, and of each of these in the second one (1 for none)."""
    want, most = -(-n // PART_ROWS), max(1, sample // PART_SAMPLE)
    if want <= most:
        return max(1, want), 1
    first = min(most, int(np.ceil(np.sqrt(want))))
    return first, -(-want // first)


def _route(classes: DataFrame, router, dim: int) -> DataFrame:
    """``uuid, vec, route``: the parts that a vector's neighbours are looked for in, its own part first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = router.value
        for b in batches:
            b["route"] = list(r.parts(unit(_matrix(b["vec"], dim)), r.probes).astype(np.int32)) if len(b) else []
            yield b

    return classes.select("uuid", "vec").mapInPandas(run, "uuid string, vec array<float>, route array<int>")


def _fit_inner(routed: DataFrame, inner: int, dim: int, sample_rows: int) -> dict[int, Router]:
    """A router for each part of the first cut, fitted in the executors on at most about ``sample_rows`` of its vectors.

    There are at most ``SAMPLE_ROWS / PART_SAMPLE`` of them, of about 200 KB each, so they fit the driver and the tasks.
    """
    home = F.col("route")[0]
    sizes = {r["p"]: r["n"] for r in routed.groupBy(home.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = routed.sparkSession.createDataFrame([(p, max(0.0, sample_rows - 7 * sample_rows**0.5) / n) for p, n in sizes.items()], "p int, share double")
    draw = F.pmod(F.xxhash64("uuid", F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    own = routed.select("uuid", "vec", home.alias("p")).join(F.broadcast(share), "p").where(draw < F.col("share"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(_matrix(pdf.sort_values("uuid")["vec"], dim))
        r = fit_router(x, max(1, min(inner, len(x) // PART_SAMPLE)), seed=7 + int(key[0]))
        return pd.DataFrame({"p": [key[0]], "router": [pickle.dumps(r)]})

    got = own.groupBy("p").applyInPandas(fit, "p int, router binary").collect()
    return {r["p"]: pickle.loads(bytes(r["router"])) for r in got}


def _route_again(routed: DataFrame, inner, n_inner: int, dim: int) -> DataFrame:
    """The routes within the parts of the first cut, as numbers of parts of both cuts; a vector's own part first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        routers = inner.value
        for b in batches:
            x = unit(_matrix(b["vec"], dim))
            routes: list[list[int]] = [[] for _ in range(len(b))]
            outer = np.stack(b["route"].to_numpy()) if len(b) else np.empty((0, 0), np.int32)
            for place in range(outer.shape[1]):
                for p in np.unique(outer[:, place]):
                    rows = np.flatnonzero(outer[:, place] == p)
                    r = routers.get(int(p))
                    parts = r.parts(x[rows], r.probes) if r else np.zeros((len(rows), 1), np.int64)
                    for i, own in zip(rows, parts + int(p) * n_inner):
                        routes[i].extend(own.tolist())
            b["route"] = routes
            yield b

    return routed.mapInPandas(run, "uuid string, vec array<float>, route array<int>")


def nearest_classes(classes: DataFrame, dim: int, k: int, scratch: Scratch, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``a, b, score``: for each class of equal vectors (``uuid, vec``) its k most similar other classes."""
    spark = classes.sparkSession
    n = classes.count()
    drawn = bounded_sample(classes, F.col("uuid"), sample_rows, n).toPandas().sort_values("uuid")
    drawn = _matrix(drawn["vec"], dim)
    n_outer, n_inner = part_numbers(n, len(drawn))
    router = spark.sparkContext.broadcast(fit_router(unit(drawn), n_outer))
    del drawn
    routed = scratch.write(_route(classes, router, dim), "routed")
    if n_inner > 1:
        inner = spark.sparkContext.broadcast(_fit_inner(routed, n_inner, dim, sample_rows))
        routed = scratch.write(_route_again(routed, inner, n_inner, dim), "routed-again")
    # a count per part reaches the driver
    held = {r[0]: r[1] for r in routed.select(F.col("route")[0].alias("p")).groupBy("p").count().collect()}
    asked = {r[0]: r[1] for r in routed.select(F.explode("route").alias("p")).groupBy("p").count().collect()}
    plan = spark.createDataFrame(
        [(p, -(-held.get(p, 0) // BASE_BLOCK), -(-q // QUERY_BLOCK)) for p, q in asked.items() if held.get(p, 0)],
        "part int, base_blocks long, query_blocks long",
    )
    plan = F.broadcast(plan)
    draw = F.pmod(F.xxhash64("uuid"), F.lit(1 << 40))
    base = (
        routed.select("uuid", "vec", F.col("route")[0].alias("part"))
        .join(plan, "part")
        .select("uuid", "vec", "part", (draw % F.col("base_blocks")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)).alias("j"))
    )
    asks = (
        routed.select("uuid", "vec", F.explode("route").alias("part"))
        .join(plan, "part")
        .select(F.col("uuid").alias("asker"), F.col("vec").alias("asked"), F.col("part").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("base_blocks") - 1)).alias("bi"), (draw % F.col("query_blocks")).alias("qj"))
    )

    def rerank(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(b):
            xb, xq = _matrix(b["vec"], dim), _matrix(q["asked"], dim)
            ub, ids, own = unit(xb.astype(np.float64)), b["uuid"].to_numpy(), q["asker"].to_numpy()
            fast = ub.astype(np.float32)
            # float32 finds candidates with room for its rounding, float64 orders them
            keep = min(len(b), 2 * k + 6)
            for lo in range(0, len(q), 1024):
                uq = unit(xq[lo : lo + 1024].astype(np.float64))
                s = uq.astype(np.float32) @ fast.T
                top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                exact = np.einsum("qd,qkd->qk", uq, ub[top])
                for r in range(len(uq)):
                    me = own[lo + r]
                    best = sorted((-e, ids[c]) for e, c in zip(exact[r], top[r]) if ids[c] != me)[:k]
                    out += [(me, other, -e) for e, other in best]
        return pd.DataFrame(out, columns=["a", "b", "score"])

    found = (
        asks.groupBy("p", "bi", "qj")
        .cogroup(base.groupBy("part", "i", "j"))
        .applyInPandas(rerank, "a string, b string, score double")
    )
    # equal cosines differ by rounding in the last place only
    best = F.row_number().over(W.partitionBy("a").orderBy(F.round("score", 12).desc(), "b"))
    return found.withColumn("_r", best).where(F.col("_r") <= k).drop("_r")


def similar_vectors(rows: DataFrame, dim: int = 64, k: int = 5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``uuid, neighbour, score``: the k most similar vectors of each usable vector (ties: the smaller uuid).

    Equal vectors are searched once, as a class with its k + 1 smallest uuids: no other member can be among the k
    nearest of anything, as those come first at the same cosine. So a vector that a third of all rows share costs as much as
    any other. Null uuids, missing or unusable vectors and repeated rows count as stated in ``usable_vectors``.
    """
    scratch = Scratch(rows.sparkSession, "neighbours")
    same = F.struct(F.xxhash64("vec").alias("h"), F.xxhash64(F.reverse("vec")).alias("g"))
    vectors = scratch.write(usable_vectors(rows, dim).withColumn("cls", same), "vectors")
    # the limit per group is applied before the shuffle as well
    rank = F.row_number().over(W.partitionBy("cls").orderBy("uuid"))
    first = scratch.write(vectors.withColumn("r", rank).where(F.col("r") <= k + 1), "first")
    heads = first.where("r = 1").select("uuid", "vec", "cls")
    near = nearest_classes(heads.select("uuid", "vec"), dim, k, scratch, sample_rows)
    near = near.join(heads.select(F.col("uuid").alias("a"), F.col("cls").alias("cls")), "a").select("cls", F.col("b"), "score")
    members = first.select("cls", F.col("uuid").alias("other"))
    head_of = heads.select(F.col("uuid").alias("b"), F.col("cls").alias("_c"))
    outside = near.join(head_of, "b").join(members.withColumnRenamed("cls", "_c"), "_c").select("cls", "other", "score")
    inside = members.select("cls", "other", F.lit(1.0).alias("score"))
    options = outside.unionByName(inside)
    top = F.row_number().over(W.partitionBy("cls").orderBy(F.round("score", 12).desc(), "other"))
    options = options.withColumn("_r", top).where(F.col("_r") <= k + 1).drop("_r")
    pairs = vectors.select("uuid", "cls").join(options, "cls").where(F.col("uuid") != F.col("other"))
    last = F.row_number().over(W.partitionBy("uuid").orderBy(F.round("score", 12).desc(), "other"))
    return pairs.withColumn("_r", last).where(F.col("_r") <= k).select("uuid", F.col("other").alias("neighbour"), "score")


def neighbour_pairs(rows: DataFrame, dim: int = 64, k: int = 5) -> DataFrame:
    """``uuid_a < uuid_b`` of which at least one is among the k most similar of the other."""
    s = similar_vectors(rows, dim, k)
    return s.select(F.least("uuid", "neighbour").alias("uuid_a"), F.greatest("uuid", "neighbour").alias("uuid_b")).distinct()
