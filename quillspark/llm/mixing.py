"""Mixing sources to target weights, exactly.

Documents of a source are dealt into blocks by hash; a source's quota is so many copies of all its blocks,
some blocks once more, and a cut in one last block. A splitting tree hands the blocks to output shards: at
every inner node the blocks of the left half are drawn from the node's by the multivariate hypergeometric
distribution, so that each source's blocks are spread as by one global shuffle, yet exactly used up. Each
shard takes disjoint runs of the sources' permuted block lists and is shuffled by itself. Every source has
several blocks for each shard, whatever its size, so that a small one is spread as well as a large one. Only
block totals come to the driver; the blocks of a source are bounded whatever the corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut

#: Blocks of each source for each shard, and of a source at most.
BLOCKS_PER_SHARD, MAX_BLOCKS = 8, 20_000
#: Shards of a mix: so many tokens each, within these bounds.
SHARD_TOKENS, LEAST_SHARDS, MAX_SHARDS = 1 << 27, 16, 4096


def largest_exact_total(available: dict[str, int], shares: dict[str, float], repeats: dict[str, int]) -> float:
    """The largest mix in which every source that has tokens reaches its share without passing its cap."""
    have = {s: w for s, w in shares.items() if w > 0 and available.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    whole = sum(have.values())
    return min((repeats[s] * available[s] / (w / whole) for s, w in have.items()), default=0.0)


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """counts of blocks per source -> shards x sources, rows as equal in size as can be, columns summing to
    counts, drawn by the multivariate-hypergeometric splitting tree."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)
    stack = [(0, shards, counts.astype(np.int64))]
    while stack:
        low, high, here = stack.pop()
        if high - low == 1:
            out[low] = here
            continue
        middle = (low + high) // 2
        total = int(here.sum())
        take = total * (middle - low) // (high - low)
        left = rng.multivariate_hypergeometric(here, take, method="marginals") if total else here
        stack += [(low, middle, left), (middle, high, here - left)]
    return out


def plan_blocks(blocks: list[tuple[str, int, int]], quotas: dict[str, int], shards: int, seed: int) -> list[tuple[str, int, int, int, int | None]]:
    """blocks (source, block, tokens) and quotas in tokens -> (source, block, copy, shard, cut): every copy
    of a block in the mix; cut, where set, is the number of tokens to take of it."""
    rng = np.random.default_rng(seed)
    by_source: dict[str, list[tuple[int, int]]] = {}
    for source, block, tokens in sorted(blocks):
        by_source.setdefault(source, []).append((block, tokens))
    lists: list[list[tuple[str, int, int, int | None]]] = []
    for source in sorted(by_source):
        own, left, copy = by_source[source], quotas.get(source, 0), 0
        whole = sum(t for _, t in own)
        chosen: list[tuple[str, int, int, int | None]] = []
        while whole and left >= whole:
            chosen += [(source, b, copy, None) for b, _ in own]
            left -= whole
            copy += 1
        for k in rng.permutation(len(own)):
            block, tokens = own[k]
            if left <= 0:
                break
            chosen.append((source, block, copy, None if tokens <= left else left))
            left -= tokens
        lists.append([chosen[i] for i in rng.permutation(len(chosen))])
    plan, at = [], [0] * len(lists)
    for shard, row in enumerate(split_tree(np.array([len(x) for x in lists], dtype=np.int64), shards, rng) if lists else []):
        for k, n in enumerate(row):
            plan += [(s, b, c, shard, cut_at) for s, b, c, cut_at in lists[k][at[k] : at[k] + n]]
            at[k] += n
    return plan


def mix(sized: DataFrame, targets: DataFrame, seed: int = 42, shards: int | None = None, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """sized: doc_id, source, tokens. targets: source, target_share, max_repeats.

    Returns the mix (shard, position, doc_id, copy, source, tokens) and the report (source, target_share,
    max_repeats, available_tokens, mixed_tokens, documents, copies, actual_share). total_tokens defaults to
    the largest total that meets every share exactly; a larger one leaves capped sources short, which the
    report shows. Shares of sources without tokens are divided among the others in proportion.

    Defined cases: documents of null source or of a source without target take no part; documents without
    tokens are never drawn; a target named twice adds its shares and has the larger cap; null shares and
    caps count as 0; a source ends within one document of its quota; empty tables give an empty mix.
    A source of any size has BLOCKS_PER_SHARD blocks a shard (MAX_BLOCKS at most, none without documents), so only the one
    cut block of each source is ordered; shards hold about SHARD_TOKENS unless their number is given.
    """
    spark = sized.sparkSession
    goals = {r["source"]: (r["share"] or 0.0, r["cap"] or 0) for r in targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()}
    named = spark.createDataFrame([(s, float(w), int(c)) for s, (w, c) in goals.items()], "source string, target_share double, max_repeats int")
    usable = sized.where("source is not null and tokens > 0").select("doc_id", "source", F.col("tokens").cast("bigint").alias("tokens")).join(F.broadcast(named.select("source")), "source", "left_semi")
    usable = cut(usable)
    available = {r["source"]: r["tokens"] for r in usable.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    shares, repeats = {s: w for s, (w, _) in goals.items()}, {s: c for s, (_, c) in goals.items()}
    have = sum(w for s, w in shares.items() if available.get(s) and repeats[s] > 0)
    total = total_tokens if total_tokens is not None else largest_exact_total(available, shares, repeats)
    quotas = {s: min(int(round(total * shares[s] / have)), repeats[s] * available[s]) for s in available if have and repeats[s] > 0}

    if shards is None:
        shards = int(min(max(LEAST_SHARDS, -(-sum(quotas.values()) // SHARD_TOKENS)), MAX_SHARDS))
    numbers = spark.createDataFrame([(s, min(BLOCKS_PER_SHARD * shards, MAX_BLOCKS)) for s in available], "source string, blocks bigint")
    order = F.xxhash64(F.lit(seed), "doc_id")
    dealt = usable.join(F.broadcast(numbers), "source").select("doc_id", "source", "tokens", order.alias("mixed"), F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("blocks")).alias("block"))
    totals = [(r["source"], r["block"], r["tokens"]) for r in dealt.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).collect()]
    plan = spark.createDataFrame(plan_blocks(totals, quotas, shards, seed), "source string, block bigint, copy int, shard int, upto bigint")

    whole = dealt.join(F.broadcast(plan.where("upto is null").drop("upto")), ["source", "block"]).drop("block")
    running = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("mixed", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    parts = dealt.join(F.broadcast(plan.where("upto is not null")), ["source", "block"]).withColumn("before", F.coalesce(running, F.lit(0)))
    # The document across the cut is taken if that brings the source nearer to its quota.
    parts = parts.where("before + tokens <= upto or (before < upto and 2 * (upto - before) >= tokens)").drop("block", "upto", "before")
    drawn = whole.unionByName(parts)
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "copy"), "doc_id", "copy")) - 1
    mixed = drawn.withColumn("position", place).select("shard", F.col("position").cast("bigint").alias("position"), "doc_id", "copy", "source", "tokens")

    reached = drawn.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count("*").alias("documents"), (F.max("copy") + 1).alias("copies"))
    had = spark.createDataFrame(list(available.items()), "source string, available_tokens bigint")
    report = (
        named.join(had, "source", "left")
        .join(reached, "source", "left")
        .fillna(0, ["available_tokens", "mixed_tokens", "documents", "copies"])
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(Window.partitionBy())), F.lit(0.0)))
    )
    return mixed, report
