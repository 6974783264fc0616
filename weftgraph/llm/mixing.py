"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.session import Scratch

#: A public byte-level BPE vocabulary; any file of ranks will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of a block, and documents that a shard should hold.
BLOCK_TOKENS, SHARD_ROWS = 512, 50_000


def sainte_lague(weights: Sequence[float], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2k + 1); ties go to the first. Weights that are not positive get none.

    Starting from each party's rounded share only the few seats by which those miss the total are dealt or taken back
    by quotient, so any number of seats costs the same. Exact fractions keep the result independent of rounding.
    """
    w = [Fraction(x) if x and x > 0 else Fraction(0) for x in weights]
    total = sum(w)
    if not total or seats <= 0:
        return [0] * len(w)
    got = [int(x * seats / total + Fraction(1, 2)) for x in w]
    gap = seats - sum(got)
    if gap > 0:
        heap = [(-x / (2 * got[i] + 1), i) for i, x in enumerate(w) if x]
        heapq.heapify(heap)
        for _ in range(gap):
            _, i = heapq.heappop(heap)
            got[i] += 1
            heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
    elif gap < 0:
        heap = [(x / (2 * got[i] - 1), -i) for i, x in enumerate(w) if got[i]]
        heapq.heapify(heap)
        for _ in range(-gap):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i]:
                heapq.heappush(heap, (w[-i] / (2 * got[-i] - 1), i))
    return got


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, source, n_tokens``: one row per doc_id; null texts have no tokens, null ids and sources no row."""

    with open(tokenizer, "rb") as f:
        vocabulary = f.read()
    # a vocabulary is a file of a published size, a megabyte or less; only the driver needs the path
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            # lone surrogates cannot be encoded; they count as the replacement character
            n = [len(enc.encode_ordinary(t.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))) if isinstance(t, str) else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": n})

    rows = documents.where("doc_id is not null and source is not null").select("doc_id", "source", "text")
    counted = rows.mapInPandas(count, "doc_id long, source string, n_tokens long")
    # of rows with one id the one with the most tokens, then the greatest source
    best = F.max(F.struct("n_tokens", "source")).alias("m")
    return counted.groupBy("doc_id").agg(best).select("doc_id", F.col("m.source").alias("source"), F.col("m.n_tokens").alias("n_tokens"))


def _targets(mixes: DataFrame) -> DataFrame:
    """One row per (mix, source): shares of repeated rows add up, their least repeats and the mix's greatest size hold."""
    rows = mixes.where("mix_name is not null and source_name is not null").groupBy("mix_name", "source_name").agg(
        F.sum(F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)).alias("share"),
        F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).cast("long").alias("repeats"),
        F.max(F.coalesce("size_ratio", F.lit(1.0))).alias("ratio"),
    )
    mix = W.partitionBy("mix_name")
    return rows.withColumn("ratio", F.max("ratio").over(mix)).withColumn("total_share", F.sum("share").over(mix))


def _plan(shards: DataFrame, mixes: DataFrame, block_tokens: int) -> DataFrame:
    """``mix_name, source, shard, passes, blocks``: whole passes over a source, and blocks of one more, by shard.

    First each mix deals its blocks to its sources, then each source the blocks of its last pass to its shards. What a
    source cannot give within its repeats stays open; other sources do not exceed their targets for it.
    """
    all_tokens = shards.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).head()["n"]
    totals = {r[0]: r[1] for r in shards.join(mixes.select(F.col("source_name").alias("source")).distinct(), "source", "left_semi").groupBy("source").agg(F.sum("tokens")).collect()}
    rows = []
    by_mix: dict[str, list] = {}
    for r in _targets(mixes).collect():  # as many rows as the table of targets
        by_mix.setdefault(r["mix_name"], []).append(r)
    for mix, parts in by_mix.items():
        parts.sort(key=lambda r: r["source_name"])
        seats = int(max(0.0, parts[0]["ratio"]) * all_tokens / block_tokens + 0.5)
        for r, got in zip(parts, sainte_lague([r["share"] for r in parts], seats)):
            have = totals.get(r["source_name"], 0)
            want = min(got * block_tokens, have * r["repeats"])
            passes = want // have if have else 0
            rest = (want - passes * have + block_tokens // 2) // block_tokens if passes < r["repeats"] else 0
            rows.append((mix, r["source_name"], passes, rest))
    spark = shards.sparkSession
    quotas = spark.createDataFrame(rows, "mix_name string, source string, passes long, rest long").where("passes > 0 or rest > 0")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        pdf["blocks"] = sainte_lague([int(x) for x in pdf["tokens"]], int(pdf["rest"].iloc[0]))
        return pdf[["mix_name", "source", "shard", "passes", "blocks"]]

    dealt = shards.join(F.broadcast(quotas), "source").groupBy("mix_name", "source")
    return dealt.applyInPandas(deal, "mix_name string, source string, shard long, passes long, blocks long")


def mixture(
    documents: DataFrame, mixes: DataFrame, *, seed: int = 17, tokenizer: str = TOKENIZER, pattern: str = PATTERN, block_tokens: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``mix_name, doc_id, source_name, n_tokens, times``: how often each document is taken; those not taken are absent.

    A source's documents are drawn to shards of about ``shard_rows`` by a seeded hash and lie in seeded order within
    a shard, cut into blocks of equal tokens; a document belongs to the block that holds its middle token. A document
    is taken once per whole pass, and once more if its block is among its shard's quota. So no source of any size is
    sorted in one task, and no document is taken more than ``max_repeats`` times. Sources without a name in the mix are
    left out, names without a source give no row, and their share stays open.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    docs = scratch.write(token_counts(documents, tokenizer, pattern), "tokens")
    n_shards = max(1, -(-docs.count() // shard_rows))
    draw = F.xxhash64(F.lit(seed), "doc_id")
    docs = docs.withColumn("shard", F.pmod(draw, F.lit(n_shards))).withColumn("place", F.xxhash64(F.lit(seed + 1), "doc_id"))
    shards = scratch.write(docs.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens")), "shards")
    plan = scratch.write(_plan(shards, mixes, block_tokens), "plan")
    before = F.sum("n_tokens").over(W.partitionBy("source", "shard").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = docs.withColumn("block", F.floor((before - F.col("n_tokens") / 2) / block_tokens))
    taken = F.col("passes") + F.when(F.col("block") < F.col("blocks"), 1).otherwise(0)
    return (
        placed.join(plan, ["source", "shard"])
        .select("mix_name", "doc_id", F.col("source").alias("source_name"), "n_tokens", taken.cast("long").alias("times"))
        .where("times > 0")
    )


def shares_reached(taken: DataFrame, mixes: DataFrame) -> DataFrame:
    """``mix_name, source_name, target_share, n_documents, n_tokens, reached_share``, shares relative to the mix."""
    got = taken.groupBy("mix_name", "source_name").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("n_tokens") * F.col("times")).alias("n_tokens"))
    t = _targets(mixes).select("mix_name", "source_name", (F.col("share") / F.nullif(F.col("total_share"), F.lit(0.0))).alias("target_share"))
    mix = W.partitionBy("mix_name")
    return t.join(got, ["mix_name", "source_name"], "left").select(
        "mix_name", "source_name", "target_share",
        F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"),
        F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
        (F.coalesce("n_tokens", F.lit(0)) / F.nullif(F.sum("n_tokens").over(mix), F.lit(0))).alias("reached_share"),
    )
