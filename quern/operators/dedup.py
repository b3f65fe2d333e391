"""Deduplication, ranking, numbering and sampling, DataFrame -> DataFrame. Every operator takes its order from a column."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import normalized
from quern.session import cut, spread, stored

MASK = 0xFFFFFFFF


def first_by(df: DataFrame, key: Column | str, order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key; null keys are dropped. A partial aggregate comes before the shuffle, so a hot key is cheap."""
    k = F.col(key) if isinstance(key, str) else key
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    pick = F.max_by if last else F.min_by
    return df.withColumn("__k", k).where("__k is not null").groupBy("__k").agg(pick(row, F.col(order)).alias("__r")).select("__r.*")


def exact_marked(df: DataFrame, text: str = "text", order: str = "id") -> DataFrame:
    """``df`` and is_kept: whether the row is the first of its normalised text, by the unique column ``order``. Null texts count as empty ones.

    The normal form is made once. Hashes are grouped with partial sums before
    the shuffle, and firsts join by order and hash, so a text that a third of
    all rows share is no hot key.
    """
    d = stored(df.withColumn("__n", F.sha2(F.coalesce(normalized(F.col(text)), F.lit("")), 256)), "hashed")
    firsts = d.groupBy("__n").agg(F.min(order).alias(order)).withColumn("__k", F.lit(True))
    return d.join(firsts, [order, "__n"], "left").withColumn("is_kept", F.col("__k").isNotNull()).select(*df.columns, "is_kept")


def numbered(df: DataFrame, order: str, out: str, start: int = 1) -> DataFrame:
    """Dense numbers in the order of a column, by ranges: each partition numbers its rows, then an offset is added. No single task sorts the table, and rows are shuffled once."""
    kept = [c for c in df.columns if c != out]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n, n + b.num_rows)), pa.array(np.full(b.num_rows, part, np.int32))], names=[*kept, out, "__p"])
            n += b.num_rows

    src = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*src.schema.fields, T.StructField(out, T.LongType()), T.StructField("__p", T.IntegerType())])
    ranged = stored(src.repartitionByRange(F.col(order)).sortWithinPartitions(order).mapInArrow(run, schema), "ranged")
    offsets, total = [], start
    for r in sorted(ranged.groupBy("__p").count().collect(), key=lambda r: r["__p"]):  # one row a partition
        offsets.append((r["__p"], total))
        total += r["count"]
    base = df.sparkSession.createDataFrame(offsets, "__p int, __b long")
    return ranged.join(F.broadcast(base), "__p").withColumn(out, F.col(out) + F.col("__b")).select(*kept, out)


def batches(df: DataFrame, order: str, size: int, out: str = "batch_id") -> DataFrame:
    return numbered(df, order, "__n", 0).withColumn(out, F.floor(F.col("__n") / size)).drop("__n")


def head_then_least(df: DataFrame, order: str, most: int, key: str, least: int) -> DataFrame:
    """The first ``most`` rows, and of these the ones with a key of ``least`` or more."""
    return df.orderBy(order).limit(most).where(F.col(key) >= least)


#: A piece of a ranking is sorted by one task if it has no more rows than this.
SORTED = 100_000


def smallest(df: DataFrame, rank: str, key: str, k: int) -> DataFrame:
    """The k rows with the smallest hexadecimal ``rank``, ties by ``key``: never more than ``SORTED`` of them are sorted in one place.

    Ranks are counted by their next four digits (65,536 counts), which tells
    what is in for sure and in which part the boundary lies; that part is
    counted again by the next four, until it is small.
    """
    out, open_, done = df.limit(0), df, 0
    while k > 0 and done < 32:
        digits = F.substring(rank, done + 1, 4)
        counts = sorted((r["p"], r["n"]) for r in open_.groupBy(digits.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        before = 0
        for p, n in counts:
            if before + n > k:
                break
            before += n
        else:
            return out.unionAll(open_)  # all of them
        out, k, done = out.unionAll(open_.where(digits < p)), k - before, done + 4
        open_ = open_.where(digits == p)
        if n <= SORTED:
            break
    return out.unionAll(open_.orderBy(rank, key).limit(k)) if k > 0 else out


def audit_sample(df: DataFrame, rate: float, seed: int, key: str = "id") -> DataFrame:
    """Marks exactly round(n * rate) valid rows (half to even) for review: by the smallest md5 of seed and key.

    n counts all rows. Marked rows keep their label and get need_review and
    the reason audit_sampled.
    """
    valid = F.col("round1_label").isin("sarcastic", "non_sarcastic")
    k = df.select(F.bround(F.count(F.lit(1)) * F.lit(rate), 0).cast("bigint").alias("k")).first()["k"]
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    top = smallest(df.where(valid).select(F.col(key).alias("__id"), rank.alias("__r")), "__r", "__id", k).select("__id", F.lit(True).alias("__s"))
    d = df.join(top, F.col(key) == F.col("__id"), "left")
    s = F.col("__s").isNotNull()
    return d.withColumns({"need_review": F.when(s, F.lit(True)).otherwise(F.col("need_review")), "route_reason": F.when(s, F.lit("audit_sampled")).otherwise(F.col("route_reason"))}).drop("__id", "__r", "__s")


# Near duplicates: greedy, in order, by the share of equal MinHash values.

def minhash(df: DataFrame, text: str = "text", out: str = "signature", k: int = 3, hashes: int = 128) -> DataFrame:
    """``df`` and a signature array<bigint>: the least of (h xor i * 2654435761) over the 32-bit hashes of a text's word k-grams.

    The hash of a k-gram is the first 32 bits of its md5, the same on every
    machine. Shorter texts are one k-gram. Null texts are empty ones.
    """
    import hashlib

    masks = (np.arange(hashes, dtype=np.uint64) * np.uint64(2654435761)) & np.uint64(MASK)
    kept = [c for c in df.columns if c != out]

    def grams(t: str) -> np.ndarray:
        w = t.split()
        s = {t} if len(w) < k else {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}
        return np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:4], "big") for x in s], np.uint64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sig = np.empty((b.num_rows, hashes), np.int64)
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                sig[i] = (grams(t)[:, None] ^ masks[None, :]).min(axis=0)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel()), hashes).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], flat], names=[*kept, out])

    src = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(normalized(F.col(text)), F.lit("")).alias("__n"))
    return src.mapInArrow(run, src.drop("__n").schema.add(out, T.ArrayType(T.LongType())))


def agreeing(a: Column, b: Column, hashes: int = 128) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(hashes))


#: Counters of signature values, 4 MB however large the table: they only order the places of a signature.
COUNTERS = 1 << 20
#: How many rare places two signatures must share beyond the first to be compared.
MORE = 2
#: A list of more entries is split in blocks.
HOT = 20_000


def place_counts(reps: DataFrame) -> np.ndarray:
    """How often each counter of (place, value) occurs in the signatures."""
    step = 1 << 13

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for b in it:
            n += np.bincount(_counter(_places(b.column(0))).ravel(), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(COUNTERS // step, dtype=np.int32)), pa.array([x.tobytes() for x in n.reshape(-1, step)], pa.binary())], names=["at", "n"])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in it:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["at", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for r in reps.select("signature").mapInArrow(run, "at int, n binary").repartition("at").mapInArrow(add, "at int, n binary").collect():
        out[r.at * step : (r.at + 1) * step] = np.frombuffer(r.n, np.int64)
    return out


def _places(signatures: pa.Array) -> np.ndarray:
    """(rows, places) keys of (place, value)."""
    flat = signatures.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
    x = flat.reshape(len(signatures), -1) if len(signatures) else flat.reshape(0, 1)
    x = (x ^ (np.arange(x.shape[1], dtype=np.uint64) << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _counter(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(44)).astype(np.int64)


def met_in_lists(e: DataFrame, least: int, longest: int, hot: int = HOT) -> DataFrame:
    """(a, b) of all ids a < b that share ``least`` keys or more of ``e``(key, id).

    longest: no list is longer; where it may be more than ``hot``, long lists are
    found by a count and merged by pairs of blocks, each in a task of its own.
    """

    def met(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        return x.withColumnRenamed("id", "a").join(y.withColumnRenamed("id", "b"), on).where("a < b").select("a", "b")

    if longest <= hot:
        both = met(e, e, ["key"])
    else:
        e = stored(e, "entries")
        lists = stored(e.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("key", F.ceil(F.col("c") / hot).cast("int").alias("of")), "lists")
        short = e.join(lists.select("key"), "key", "left_anti")
        block = e.join(lists, "key").withColumn("i", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("of") - 1))
        left = block.withColumn("j", other).drop("of")
        right = block.withColumnRenamed("i", "j").withColumn("i", other).drop("of")
        both = met(short, short, ["key"]).unionAll(met(left, right, ["key", "i", "j"]))
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).select("a", "b")


def near_links(signed: DataFrame, order: str = "id", threshold: float = 0.85, hashes: int = 128, hot: int = HOT) -> DataFrame:
    """(a, b, similarity) of all pairs a < b with a similarity of at least ``threshold``.

    Two such signatures differ in at most hashes - ceil(hashes * threshold)
    places, so of the rarest that many and 1 + ``MORE`` places of each, in one
    order for all, they share 1 + ``MORE``: pairs meet on these places' values
    alone and none is lost. Signatures are fetched only for pairs that share so
    many. Equal signatures are one node from the start; they are linked to their
    first row only (a copy's other links are those of the first).
    """
    least = 1 + MORE
    places = min(hashes, hashes - ceil(hashes * threshold) + least)
    d = stored(signed.select(F.col(order).alias("id"), "signature", F.sha2(F.array_join("signature", ","), 256).alias("s")), "signatures")
    first = stored(d.groupBy("s").agg(F.min("id").alias("id"), F.first("signature").alias("signature")), "reps")
    copies = d.select("id", "s").join(first.select("s", F.col("id").alias("rep")), "s").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    reps = first.select("id", "signature")
    counts = place_counts(reps)
    shared = signed.sparkSession.sparkContext.broadcast(counts)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys = _places(b.column(1))
            rank = np.minimum(shared.value[_counter(keys)], (1 << 31) - 1).astype(np.uint64)
            best = np.lexsort((keys, rank), axis=1)[:, :places]
            picked = np.take_along_axis(keys, best, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(picked.ravel().view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), picked.shape[1])))], names=["key", "id"])

    kind = dict(reps.dtypes)["id"]
    met = stored(met_in_lists(reps.mapInArrow(run, f"key bigint, id {kind}"), least, int(counts.max(initial=0)), hot), "met")
    both = met.join(reps.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(reps.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    sure = both.withColumn("similarity", agreeing(F.col("sa"), F.col("sb"), hashes)).where(F.col("similarity") >= threshold)
    return sure.select("a", "b", "similarity").unionByName(copies)


def greedy_drops(links: DataFrame) -> DataFrame:
    """(id) of the rows that going through in order drops: those linked to an earlier row that is kept.

    Rounds over the open links, each cut: a row without an open earlier
    neighbour is kept, its later neighbours are dropped.
    """
    open_ = cut(links.select("a", "b").distinct())
    out = open_.select(F.col("b").alias("id")).limit(0)
    while not open_.isEmpty():
        later = open_.select(F.col("b").alias("a")).distinct()
        now = cut(open_.join(later, "a", "left_anti").select(F.col("b").alias("id")).distinct())
        out = out.unionAll(now)
        open_ = cut(open_.join(now.withColumnRenamed("id", "b"), "b", "left_anti").join(now.withColumnRenamed("id", "a"), "a", "left_anti").select("a", "b"))
    return out.distinct()


def near_marked(df: DataFrame, text: str = "text", order: str = "id", threshold: float = 0.85, hashes: int = 128) -> DataFrame:
    """``df`` and is_kept after greedy near deduplication."""
    links = near_links(minhash(spread(df.select(F.col(order), F.col(text))), text, hashes=hashes), order, threshold, hashes)
    links = stored(links, "links")
    copies = links.where("similarity = 1").select(F.col("b").alias("id"))  # dropped whatever becomes of their first row
    drops = greedy_drops(links.where("similarity < 1")).unionAll(copies).distinct().withColumn("__d", F.lit(True)).withColumnRenamed("id", order)
    return df.join(drops, order, "left").withColumn("is_kept", F.col("__d").isNull()).drop("__d")
