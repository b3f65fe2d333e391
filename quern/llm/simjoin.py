"""Near-duplicate records by T-occurrence search (problem 2).

Two texts are similar if both have at least ``least`` words and their sets of
runs of ``k`` words have a Jaccard similarity of ``t`` or more, which means
that they share at least T = ceil(t / (1 + t) * (|A| + |B|)) runs.

The search is DivideSkip, spread over the cluster. All runs have one order,
rarest first. For a pair the T - 1 - ``MORE`` most frequent runs of either
record are its *long* lists, which aren't merged; the inverted lists of all
others are *short*. Two records that share T runs share at least 1 + ``MORE`` of
the short lists: short lists are merged (an equi-join on the run, by Spark's
external sort) and the occurrences of each pair counted. What reaches that many
is probed in the long lists by binary search in the records' sorted runs, and
kept if the required overlap is reached. No step drops a pair that is similar.

Equal texts are one class from the start: a copy adds no list entry. A list of
more than ``HOT`` entries is split in blocks, and each pair of blocks is merged
apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.words import WordHash, counter, hash_column, paragraph_texts, shingle_batch
from quern.session import Scratch, cut, release, spread, stored

WORDS, RUNS = 1 << 16, 1 << 20
#: How many occurrences in short lists are asked for beyond the first.
MORE = 2
HOT = 20_000
#: The runs are merged in so many parts, one after another, so that only one part's entries are on disk.
PARTS = 2
#: A text with more copies than this is expanded to pairs in blocks.
COPIES = 2_000
_LONG, _INT, _BIN = pa.int64(), pa.int32(), pa.binary()


def word_table(df: DataFrame, keep: str = "") -> DataFrame:
    """(id, h, nw, words, extra column ``keep``) of ``df``(id, text, keep), for texts with a word.

    words: those of a paragraph parted by blanks, paragraphs by line ends; h
    tells word sequences apart, however they are split in paragraphs; nw is
    their number. Null texts and null ids have no row.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = paragraph_texts(b.column(1).to_pylist())
            flat = [x.replace("\n", " ") for x in texts]
            some = pa.array([bool(x) for x in texts])
            cols = [b.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in flat], _BIN), pa.array([x.count(" ") + 1 for x in flat], _INT), pa.array(texts, pa.string()), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays([c.filter(some) for c in cols], names=["id", "h", "nw", "words", *extra])

    extra = [keep] if keep else []
    kind = dict(df.dtypes)
    schema = f"id bigint, h binary, nw int, words string{f', {keep} {kind[keep]}' if keep else ''}"
    return df.where("id is not null and text is not null").select("id", "text", *extra).mapInArrow(run, schema)


Counts = tuple[np.ndarray, np.ndarray]


def run_counts(reps: DataFrame, k: int) -> Counts:
    """Counts of all words and all runs of the table, in WORDS and RUNS counters: 4.3 MB however large the table.

    They only give the order of runs; texts that share a counter cost time,
    never a pair.
    """
    step = 1 << 13

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, count = WordHash(), np.zeros(WORDS + RUNS, np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 5000):
                h, off = hash_column(whole.slice(start, 5000).column(0), memo)
                _, sh, _ = shingle_batch(h, off, k)
                count[:WORDS] += np.bincount(counter(h, WORDS), minlength=WORDS)
                count[WORDS:] += np.bincount(counter(sh, RUNS), minlength=RUNS)
        raw = np.minimum(count, 2**31 - 1).astype(np.int32).reshape(-1, step)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(raw), dtype=np.int32)), pa.array([x.tobytes() for x in raw], _BIN)], names=["at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
        blobs = [np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), _INT), pa.array(blobs, _BIN)], names=["at", "counts"])

    parts = reps.select("words").mapInArrow(run, "at int, counts binary").repartition("at").mapInArrow(add, "at int, counts binary")
    out = np.zeros(WORDS + RUNS, np.int32)
    for row in parts.collect():  # (WORDS + RUNS) / step rows
        out[row.at * step : (row.at + 1) * step] = np.frombuffer(row.counts, np.int32)
    return out[:WORDS], out[WORDS:]


def top_count(counts: Counts) -> int:
    """No run is in more texts."""
    return int(min(counts[0].max(initial=0), counts[1].max(initial=0)))


def needed(na: np.ndarray, nb: np.ndarray, t: Fraction) -> np.ndarray:
    """The overlap that sets of these sizes need for a similarity of t."""
    up, down = t.numerator, t.numerator + t.denominator
    return -((-(na + nb) * up) // down)


def entries(reps: DataFrame, counts: Counts, k: int, t: Fraction, more: int = MORE, part: int = 0, parts: int = 1) -> DataFrame:
    """Entries (sh, id, n, pos) of ``reps``(id, words): n runs in all, of which the run sh has place pos.

    A record is in as many lists as may be short in any pair: with the smallest
    partner it can have, T is the least, t * n. Of ``parts`` parts of all runs only
    those of ``part`` come out.
    """
    shared = reps.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                h, off = hash_column(b.column(1), memo)
                doc, sh, _ = shingle_batch(h, off, k, shared.value)
                n = np.bincount(doc, minlength=b.num_rows)
                pos = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
                least = -((-n * t.numerator) // t.denominator)
                short = pos < (n - least + np.minimum(1 + more, least))[doc]
                if parts > 1:
                    short &= (sh >> np.uint64(8)) % np.uint64(parts) == part
                d = doc[short]
                cols = [pa.array(sh[short].view(np.int64), _LONG), b.column(0).take(pa.array(d)), pa.array(n[d].astype(np.int32), _INT), pa.array(pos[short].astype(np.int32), _INT)]
                yield pa.RecordBatch.from_arrays(cols, names=["sh", "id", "n", "pos"])

    return reps.select("id", "words").mapInArrow(run, "sh bigint, id bigint, n int, pos int")


def long_lists(e: DataFrame, hot: int) -> DataFrame:
    """(sh, of): the lists of more than ``hot`` entries and the number of their blocks. Counted before the shuffle in part."""
    return e.groupBy("sh").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("sh", F.ceil(F.col("c") / hot).cast("int").alias("of"))


def _met(left: DataFrame, right: DataFrame, on: list[str], t: Fraction, more: int, turns: bool) -> DataFrame:
    """(a, b, need[, same]) for each occurrence of a pair in a short list of both.

    An entry is *near the front* if its list is short for a partner of at least
    its record's size. Of two records the smaller one's entry is always near the
    front, so entries that aren't needn't meet each other, and theirs are the
    longest lists. What two records share besides a run stands before it in both
    or after it in both; where these places are too few for the overlap, the
    meeting is left out.
    """
    up, down = t.numerator, t.numerator + t.denominator
    ceiling = lambda n: f"int((({n}) * {up}L + {down - 1}) div {down})"
    front = F.expr(f"pos < n - {ceiling('n + n')} + least({1 + more}, {ceiling('n + n')})")
    need = ceiling("na + nb")
    short = f"least({1 + more}, {need}) - {need}"
    # first what leaves out most, without a division; what has room for the overlap has it in either record too
    room = f"(na + nb) * {up}L <= (least(pa, pb) + least(na - pa, nb - pb)) * {down}L"
    ok = f"{room} AND pa < na + {short} AND pb < nb + {short}"
    extra = lambda c: [F.col("turn").alias(c)] if turns else []

    def met(x: DataFrame, y: DataFrame, apart: str) -> DataFrame:
        x = x.select(*on, F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), *extra("ta"))
        y = y.select(*on, F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), *extra("tb"))
        both = x.join(y, on).where(apart).where(ok)
        return both.select("a", "b", F.expr(need).alias("need"), *([F.expr("ta = tb").alias("same")] if turns else []))

    if turns:
        apart = "(a < b OR ta < tb) AND a <> b"
        return met(left, right.where(front), apart).unionAll(met(left.where(front), right.where(~front), apart))
    rest = met(left.where(front), right.where(~front), "a <> b")
    return met(left.where(front), right.where(front), "a < b").unionAll(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "need"))


def meetings(left: DataFrame, right: DataFrame, t: Fraction, more: int = MORE, turns: bool = False, lists: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(a, b, need[, same]) for each occurrence of a pair in short lists, a < b if both sides are one table.

    turns: ``right`` is the part of ``left`` with the last turn; same tells
    whether a is of it too (then a < b).
    lists: the ``long_lists`` of both sides, where there are any. Their entries
    are merged by pairs of blocks, the others as they are.
    """
    if lists is None:
        return _met(left, right, ["sh"], t, more, turns)
    of_l, of_r = lists
    any_hot = of_l.select("sh").unionAll(of_r.select("sh")).distinct()

    def cells(e: DataFrame, own: str, own_lists: DataFrame, other: str, other_lists: DataFrame) -> DataFrame:
        e = e.join(any_hot, "sh", "left_semi").join(own_lists.withColumnRenamed("of", "o1"), "sh", "left").join(other_lists.withColumnRenamed("of", "o2"), "sh", "left")
        e = e.withColumn(own, F.pmod(F.xxhash64("id"), F.coalesce("o1", F.lit(1))).cast("int"))
        return e.select("*", F.explode(F.sequence(F.lit(0), F.coalesce("o2", F.lit(1)) - 1)).alias(other)).drop("o1", "o2")

    plain = _met(left.join(any_hot, "sh", "left_anti"), right.join(any_hot, "sh", "left_anti"), ["sh"], t, more, turns)
    hot = _met(cells(left, "i", of_l, "j", of_r), cells(right, "j", of_r, "i", of_l), ["sh", "i", "j"], t, more, turns)
    return plain.unionAll(hot)


def counted(met: DataFrame, more: int = MORE) -> DataFrame:
    """Pairs (a, b[, same]) with enough ``meetings``."""
    keys = [c for c in met.columns if c != "need"]
    enough = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need")).where(F.col("c") >= F.least(F.lit(1 + more), F.col("need")))
    return enough.select(*keys)


def checked(pairs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """Those of ``pairs``(a, b, wa, wb: the words of both) that reach the required overlap: (a, b, shared, n_a, n_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                out, m = [], b.num_rows
                h, off = hash_column(pa.concat_arrays([b.column(2), b.column(3)]), memo)
                doc, sh, _ = shingle_batch(h, off, k)
                lo, hi = np.searchsorted(doc, np.arange(2 * m)), np.searchsorted(doc, np.arange(2 * m), "right")
                for i in range(m):
                    x, y = sh[lo[i] : hi[i]], sh[lo[m + i] : hi[m + i]]
                    probe, into = (y, x) if len(x) > len(y) else (x, y)
                    at = np.minimum(np.searchsorted(into, probe), len(into) - 1)  # the binary probes
                    shared = int((into[at] == probe).sum())
                    if shared >= int(needed(np.int64(len(x)), np.int64(len(y)), t)):
                        out.append((i, shared, len(x), len(y)))
                o = np.array(out, np.int64).reshape(-1, 4)
                take = pa.array(o[:, 0])
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(o[:, c].astype(np.int32), _INT) for c in (1, 2, 3))], names=["a", "b", "shared", "n_a", "n_b"])

    return pairs.select("a", "b", "wa", "wb").mapInArrow(run, "a bigint, b bigint, shared int, n_a int, n_b int")


def probed(pairs: DataFrame, texts: DataFrame, k: int, t: Fraction) -> DataFrame:
    """``checked`` for pairs (a, b) of one table ``texts``(id, words)."""
    # one join for both ends, then the ends of a pair meet: no text moves that is in no pair
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "a", "b")
    end = lambda x: F.max(F.when(F.col("id") == F.col(x), F.col("words"))).alias(f"w{x}")
    return checked(ends.join(texts.select("id", "words"), "id").groupBy("a", "b").agg(end("a"), end("b")), k, t)


class Near:
    """Similar pairs of a table: classes of equal word sequences, and pairs between these."""

    def __init__(self, members: DataFrame, reps: DataFrame, pairs: DataFrame) -> None:
        self.members, self.reps, self.pairs = members, reps, pairs


def near_duplicates(df: DataFrame, key: str = "id", text: str = "text", k: int = 5, t: Fraction | float = Fraction(4, 5), least: int | None = None, hot: int = HOT, more: int = MORE) -> Near:
    """Similar pairs of ``df``; ids should be unique (repeated rows of one id count once per text).

    members(id, rep, nw) of all texts with a word, reps(id, words) and pairs(a,
    b, shared, n_a, n_b) with a < b, all complete. Null ids, null texts and
    texts of fewer than ``least`` words (``k`` at least) are similar to none.
    """
    t = Fraction(t).limit_denominator(1000)
    least = max(k, least or k)
    spark = df.sparkSession
    src = spread(df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")))
    with Scratch(spark) as scratch:
        w = scratch.stored(word_table(src), "words")
        first = w.groupBy("h").agg(F.min("id").alias("rep"))
        members = stored(w.select("id", "h", "nw").join(first, "h").select("id", "rep", "nw"), "members")
        release(spark)
        reps = stored(w.where(F.col("nw") >= least).groupBy("h").agg(F.min("id").alias("id"), F.first("words").alias("words")).select("id", "words"), "reps")
    release(spark)
    counts = run_counts(reps, k)
    with Scratch(spark) as scratch:
        met = None
        for part in range(PARTS):
            with Scratch(spark) as short:
                e, lists = entries(reps, counts, k, t, more, part, PARTS), None
                if top_count(counts) > hot:  # else no list can be that long: the counts are of this table
                    e = short.stored(e, "entries")
                    lists = short.stored(long_lists(e, hot), "lists")
                    lists = None if lists.isEmpty() else (lists, lists)
                found = scratch.stored(meetings(e, e, t, more, lists=lists), "meetings")
            release(spark)
            met = found if met is None else met.unionAll(found)
        met = stored(counted(met, more), "met")
    release(spark)
    return Near(members, reps, stored(probed(met, reps, k, t), "pairs"))


def _blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (rep, id, block) and, of classes of more than one block, (rep, of)."""
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > COPIES).select("rep", F.ceil(F.col("c") / COPIES).cast("int").alias("of"))
    m = members.join(size, "rep", "left").select("rep", "id", F.pmod(F.xxhash64("id"), F.coalesce("of", F.lit(1))).cast("int").alias("block"))
    return m, size


def expanded(pairs: DataFrame, members: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(x, y): the members of both classes of each pair, of a class with itself x < y; a class of many copies is taken in blocks, each apart."""
    m, size = _blocks(members)
    out = pairs.select(a, b)
    for end, to in ((a, "x"), (b, "y")):
        out = out.join(size.withColumnRenamed("rep", end), end, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("of", F.lit(1)) - 1))).drop("of")
        out = out.join(m.select(F.col("rep").alias(end), "block", F.col("id").alias(to)), [end, "block"]).drop("block")
    return out.where((F.col(a) != F.col(b)) | (F.col("x") < F.col("y"))).select("x", "y")


def near_pairs(df: DataFrame, least: int | None = None, **options) -> DataFrame:
    """All similar pairs of records (id_a < id_b), copies expanded."""
    near = near_duplicates(df, least=least, **options)
    least = max(options.get("k", 5), least or 0)
    m = near.members.where(F.col("nw") >= least).select("id", "rep").distinct()
    several = m.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    m = m.join(several.select("rep").unionAll(near.pairs.select("a")).unionAll(near.pairs.select("b")).distinct(), "rep", "left_semi")
    own = several.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    out = expanded(near.pairs.select("a", "b").unionAll(own), stored(m, "in-pairs")).where("x <> y")
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, group_id) of all ``nodes``(id): the smallest id that links lead to.

    Large-star and small-star rounds over the links, each cut; they end after
    a number of rounds that grows with the logarithm of the longest chain.
    """
    links = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = cut(small.select("u", F.col("m").alias("v")).unionAll(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        if new.exceptAll(links).isEmpty() and links.exceptAll(new).isEmpty():
            break
        links = new
    low = links.groupBy("u").agg(F.min("v").alias("group_id")).withColumnRenamed("u", "id")
    return nodes.join(low, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def near_groups(df: DataFrame, key: str = "id", text: str = "text", least: int | None = None, **options) -> DataFrame:
    """One row per record: (id, class_id, group_id, links).

    class_id: the smallest id with the same words, however few; group_id: the
    smallest id that links lead to; links: the number of other records similar
    to this one. Records that are similar to none have their own id and 0.
    """
    near = near_duplicates(df, key, text, least=least, **options)
    least = max(options.get("k", 5), least or 0)
    m = near.members.distinct()
    size = m.groupBy("rep").agg(F.count(F.lit(1)).alias("c"), F.max("nw").alias("nw"))
    ends = near.pairs.select(F.col("a").alias("rep"), F.col("b").alias("o")).unionAll(near.pairs.select(F.col("b").alias("rep"), F.col("a").alias("o")))
    linked = ends.join(size.select(F.col("rep").alias("o"), "c"), "o").groupBy("rep").agg(F.sum("c").alias("l"))
    groups = components(near.pairs, ends.select(F.col("rep").alias("id")).distinct()).withColumnRenamed("id", "rep")
    copies: Column = F.when(F.col("nw") >= least, F.col("c") - 1).otherwise(0)
    group = F.when(F.col("nw") >= least, F.coalesce("group_id", "rep"))
    per = size.join(linked, "rep", "left").join(groups, "rep", "left").select("rep", group.alias("group_id"), (F.coalesce("l", F.lit(0)) + copies).alias("links"))
    ids = df.select(F.col(key).cast("bigint").alias("id")).where("id is not null").distinct()
    return ids.join(m.join(per, "rep"), "id", "left").select("id", F.coalesce("rep", "id").alias("class_id"), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
