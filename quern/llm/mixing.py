"""Mixing sources to target shares of tokens (problem 8).

Each source's documents, in order of id, are one stream of tokens cut into
blocks of a fixed length (the last one may be shorter). The size of the mixture
is the largest at which every source that is there can give its share without
a block, and so a document, being taken more than ``max_repeats`` times. Slots
of an output shard get their source by a multinomial draw, on condition of the
exact totals (a free draw would miss the target shares by chance and the caps on
repeats with it); executors draw it in a splittable tree over the shards. The
j-th slot of a source takes the block that a pseudorandom permutation of the
source's indexes, a new one for each repetition, gives for j. Slots and blocks
meet in one join by index.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.bpe import with_token_count
from quern.session import stored

BLOCK = 1024
SHARD = 512


def source_name(c: Column) -> Column:
    """One spelling of a source's name: trimmed, lower case, words joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def permuted(i: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The image of i under a pseudorandom permutation of 0..n-1: a Feistel network on the next power of four, walked until it ends below n."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        x, m, h, s = out[todo], mask[todo], half[todo], seed[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for k in range(4):
            f = (right + s + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(31)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def segments(sized: DataFrame, block: int) -> tuple[DataFrame, dict[str, int]]:
    """Pieces (source, block, doc_id, first, n) of ``sized``(source, doc_id, tokens; read twice), and each source's tokens.

    The running sum is made in two steps, within the partitions of a range
    partitioning and over the partitions' totals, so no source is one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, upto = TaskContext.get().partitionId(), {}
        for b in batches:
            starts = []
            for s, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                starts.append(upto.get(s, 0))
                upto[s] = starts[-1] + n
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), *b.columns, pa.array(starts, pa.int64())], names=["part", "source", "doc_id", "tokens", "start"])

    ranged = sized.where("tokens > 0").select("source", "doc_id", F.col("tokens").cast("bigint")).repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id")
    placed = stored(ranged.mapInArrow(run, "part int, source string, doc_id bigint, tokens bigint, start bigint"), "placed")
    totals: dict[str, int] = {}
    bases = []
    for row in sorted(placed.groupBy("part", "source").agg(F.sum("tokens").alias("n")).collect(), key=lambda r: (r.source, r.part)):  # rows by partition
        bases.append((row.part, row.source, totals.get(row.source, 0)))
        totals[row.source] = bases[-1][2] + row.n
    base = placed.sparkSession.createDataFrame(bases, "part int, source string, base bigint")
    at = placed.join(base, ["part", "source"]).select("source", "doc_id", "tokens", (F.col("start") + F.col("base")).alias("start"))
    cut = at.select("*", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + tokens - 1) div {block}"))).alias("block"))
    lo, hi = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("tokens"), (F.col("block") + 1) * block)
    return cut.select("source", "block", "doc_id", (lo - F.col("start")).cast("int").alias("first"), (hi - lo).cast("int").alias("n"), (lo - F.col("block") * block).cast("int").alias("place")), totals


class Plan:
    """How many slots each source gets in all (``slots``), and how they are drawn to shards.

    A shard's counts are a multinomial draw of its slots by source, on condition
    of the totals: a binary tree over the shards, in whose nodes the left half's
    counts are drawn from the node's. Each node has a random number generator of
    its own, seeded by its place, so any range of shards can be drawn anywhere
    from the root down in as many steps as the tree is deep. The plan itself is one
    line a source, however many tokens there are.
    """

    def __init__(self, tokens: dict[str, int], targets: list[tuple[str, float, int]], block: int, shard: int, seed: int, total: int | None = None) -> None:
        there = [(s, share, repeats) for s, share, repeats in sorted(targets) if share > 0 and repeats > 0 and tokens.get(s)]
        self.sources, self.shard, self.seed = [s for s, _, _ in there], shard, seed
        self.blocks = np.array([-(-tokens[s] // block) for s, _, _ in there], np.int64)
        self.slots = np.zeros(len(there), np.int64)
        if there:
            whole = sum(share for _, share, _ in there)
            most = min(tokens[s] * repeats / (share / whole) for s, share, repeats in there)
            size = most if total is None else min(total, most)
            # blocks of a source hold tokens / blocks on average, as the last may be short
            self.slots = np.array([min(int(n) * repeats, round(size * share / whole / (tokens[s] / int(n)))) for (s, share, repeats), n in zip(there, self.blocks, strict=True)], np.int64)
        self.shards = -(-int(self.slots.sum()) // shard)

    def _split(self, counts: np.ndarray, left: int, node: tuple[int, int]) -> np.ndarray:
        """Of a node's slots by source, those of its left part of ``left`` slots."""
        rng = np.random.default_rng([self.seed, *node])
        out, open_, room = np.zeros_like(counts), int(counts.sum()), left
        for i, n in enumerate(counts.tolist()):
            out[i] = _draw(rng, n, open_ - n, room)
            open_ -= n
            room -= int(out[i])
        return out

    def shard_counts(self, start: int, stop: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, first ordinal by source, slots by source) of the shards from start on, before stop."""
        total = int(self.slots.sum())
        stack = [(0, self.shards, self.slots, np.zeros_like(self.slots))]
        while stack:
            lo, hi, counts, before = stack.pop()
            if lo >= stop or hi <= start or lo >= hi:
                continue
            if hi - lo == 1:
                yield lo, before, counts
                continue
            mid = (lo + hi) // 2
            left = self._split(counts, min(mid * self.shard, total) - lo * self.shard, (lo, hi))
            stack += [(mid, hi, counts - left, before + left), (lo, mid, left, before)]


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw: how many of ``n`` taken out of good and bad ones are good; for numbers of any size.

    numpy draws from up to 10^9 of a kind. Beyond, the normal law with the draw's
    mean and deviation stands for it, rounded and kept within the draw's bounds;
    the counts of all shards add up to the totals whichever way is taken.
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0 or n == good + bad:
        return min(n, good)
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    all_ = good + bad
    mean = n * (good / all_)
    deviation = sqrt(mean * (bad / all_) * ((all_ - n) / max(1, all_ - 1)))
    return int(min(max(round(rng.normal(mean, deviation)), n - bad, 0), n, good))


#: So many shards are drawn by one row of the plan.
RANGE = 4096


def slots(spark, plan: Plan) -> DataFrame:
    """(shard, slot, source, repeat, block): which block each slot takes; slots of a shard are in pseudorandom order.

    The plan goes to executors as it is, a line a source; they draw the counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                for shard, first, counts in plan.shard_counts(k * RANGE, min((k + 1) * RANGE, plan.shards)):
                    size = int(counts.sum())
                    which = np.repeat(np.arange(len(counts)), counts)
                    j = first[which] + np.arange(size) - np.repeat(np.cumsum(counts) - counts, counts)
                    blocks = plan.blocks[which]
                    repeat = j // blocks
                    pairs, at = np.unique(np.stack([which, repeat]), axis=1, return_inverse=True)
                    key = np.array([xxhash.xxh3_64_intdigest(f"{plan.seed}:{plan.sources[w]}:{r}") for w, r in pairs.T.tolist()], np.uint64)[at.ravel()]
                    slot = permuted(np.arange(size), np.full(size, size), np.full(size, xxhash.xxh3_64_intdigest(f"{plan.seed}#{shard}"), np.uint64))
                    names = pa.DictionaryArray.from_arrays(pa.array(which, pa.int32()), pa.array(plan.sources, pa.string())).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, shard, np.int64)), pa.array(slot), names, pa.array(repeat.astype(np.int32)), pa.array(permuted(j % blocks, blocks, key))], names=["shard", "slot", "source", "repeat", "block"])

    ranges = -(-plan.shards // RANGE)
    parts = max(1, min(ranges, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, ranges, 1, parts).mapInArrow(run, "shard bigint, slot bigint, source string, repeat int, block bigint")


def mixture(documents: DataFrame, targets: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 17, total: int | None = None, path: str | None = None) -> DataFrame:
    """(shard, slot, source, repeat, block, place, doc_id, first, n): the pieces of documents in each slot, in order of place.

    ``documents``(doc_id, text, source), ``targets``(source, target_share,
    max_repeats), both with sources in any spelling. Documents of other or null
    sources and without tokens are in no block. ``total``: tokens wanted; the
    largest possible mixture if null.
    """
    want = [(r.source, float(r.target_share), int(r.max_repeats)) for r in targets.where("source is not null and target_share is not null and max_repeats is not null").select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect()]
    mine = documents.select("doc_id", "text", source_name(F.col("source")).alias("source")).where(F.col("source").isin([s for s, _, _ in want]))
    # written, as the range partitioning reads its input twice
    pieces, tokens = segments(stored(with_token_count(mine, path=path).select("source", "doc_id", "tokens"), "sizes"), block)
    plan = Plan(tokens, want, block, shard, seed, total)
    return slots(documents.sparkSession, plan).join(pieces, ["source", "block"]).select("shard", "slot", "source", "repeat", "block", "place", "doc_id", "first", "n")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: (source, target_share, spread_share, max_repeats, tokens, actual_share, most_repeats); 0 for sources without documents.

    spread_share: the target once the shares of sources without documents are
    spread over the others in proportion.
    """
    per = mixed.groupBy("source").agg(F.sum("n").alias("tokens"), (F.max("repeat") + 1).alias("most_repeats"))
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").join(stored(per, "per"), "source", "left")
    all_ = t.agg(F.sum("tokens").alias("whole"), F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).alias("there")).first()
    zero = lambda c: F.coalesce(c, F.lit(0))
    actual = F.round(zero(F.col("tokens")) / F.lit(all_.whole or 1), 6)
    spread_share = F.round(F.when(F.col("tokens") > 0, F.col("target_share") / F.lit(all_.there or 1.0)).otherwise(0.0), 6)
    return t.select("source", "target_share", spread_share.alias("spread_share"), "max_repeats", zero(F.col("tokens")).alias("tokens"), actual.alias("actual_share"), zero(F.col("most_repeats")).alias("most_repeats"))
