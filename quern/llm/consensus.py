"""Consensus labels from several annotators (problem 6).

The true label of an item is hidden. A regularised classifier on features of
the item gives its prior, each annotator has a confusion matrix, and both are
fitted together by expectation-maximisation. The judge's label counts as one
more annotator. The E step sums log-likelihood ratios of all labels by item
(with partial sums before the shuffle, so an item or annotator that holds a
third of the labels is no hot group); the M step sums posteriors by annotator
and label, and fits the classifier on at most ``SAMPLE`` items, chosen by hash.
Confusion matrices and posteriors cover all labels and all items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.linear import Sparse, fit, score_rows, text_features
from quern.session import stored

#: At most about so many items train the classifier.
SAMPLE = 20_000
FEATURES = 1 << 12
JUDGE = "\x00judge"


def counted(labels: DataFrame) -> DataFrame:
    """(inner_id, annotator, label): for each annotator and item the 0 or 1 with the latest labelled_at.

    Other labels and rows without inner_id don't count; a null annotator is one
    annotator; of equally late labels the greater one counts.
    """
    ok = labels.where("inner_id is not null and label_human in (0, 1)")
    key = F.coalesce("annotator", F.lit("")).alias("annotator")
    last = ok.groupBy("inner_id", key).agg(F.max(F.struct(F.coalesce("labelled_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), F.col("label_human").alias("y"))).alias("m"))
    return last.select("inner_id", "annotator", F.col("m.y").cast("int").alias("label"))


def _judge(labels: DataFrame) -> DataFrame:
    """The judge's label of each item, as an annotator's; conflicting ones don't count."""
    j = labels.where("inner_id is not null and label_llm in (0, 1)").groupBy("inner_id").agg(F.min("label_llm").alias("lo"), F.max("label_llm").alias("hi"))
    return j.where("lo = hi").select("inner_id", F.lit(JUDGE).alias("annotator"), F.col("lo").cast("int").alias("label"))


def _features(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.concatenate([text_features(t, FEATURES - 64, pairs=False), [FEATURES - 64 + (hash_small(r) % 64)]]).astype(np.int32) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["inner_id", "at"])

    return items.select("inner_id", "text", "route").mapInArrow(run, "inner_id bigint, at array<int>")


def hash_small(x: str | None) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(x or "")


class Consensus:
    """posterior(inner_id, p), annotators(annotator, n, tpr, tnr) and the counted labels."""

    def __init__(self, labels: DataFrame, posterior: DataFrame, annotators: DataFrame) -> None:
        self.labels, self.posterior, self.annotators = labels, posterior, annotators


def consensus(labels: DataFrame, texts: DataFrame, rounds: int = 20, l2: float = 30.0, smooth: float = 2.0, still: float = 1e-3) -> Consensus:
    """Fit ``labels``(inner_id, llm_id, annotator, label_human, labelled_at, label_llm, llm_route_reason) with ``texts``(id, text).

    Items without a counted label have no row. Items without a text have no
    text features. ``smooth`` are pseudo-counts for each cell of a confusion
    matrix, half as many again on its diagonal. Rounds end when no annotator's
    sensitivity or specificity has moved by more than ``still``, at the latest
    after ``rounds``.
    """
    spark = labels.sparkSession
    human = stored(counted(labels), "labels")
    known = human.select("inner_id").distinct()
    all_labels = stored(human.unionByName(_judge(labels).join(known, "inner_id", "left_semi")), "votes")
    item = labels.where("inner_id is not null").groupBy("inner_id").agg(F.min("llm_id").alias("id"), F.min("llm_route_reason").alias("route")).join(known, "inner_id", "left_semi")
    first_text = texts.where("id is not null and text is not null").join(item.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    feats = stored(_features(item.join(first_text, "id", "left")), "features")

    n = feats.count()
    part = min(1.0, SAMPLE / max(n, 1))
    limit = int(-(2**63) + part * (2**64 - 1)) if part < 1 else 2**63 - 1
    chosen = F.xxhash64("inner_id") <= F.lit(limit)
    sample = feats.where(chosen).toPandas().sort_values("inner_id")
    x, ids = Sparse([np.asarray(r, np.int32) for r in sample["at"]]), sample["inner_id"].to_numpy()

    votes = all_labels.groupBy("inner_id").agg(F.avg("label").alias("p"))
    posterior = stored(votes, "posterior")
    model = (np.zeros(FEATURES), 0.0)
    matrix = None
    for _ in range(rounds):
        per = all_labels.join(posterior, "inner_id").groupBy("annotator").agg(
            F.sum(F.col("p") * F.col("label")).alias("p11"), F.sum("p").alias("p1"), F.sum((1 - F.col("p")) * (1 - F.col("label"))).alias("p00"), F.sum(1 - F.col("p")).alias("p0"), F.count(F.lit(1)).alias("n")
        )
        before, matrix = matrix, stored(per.select("annotator", "n", ((F.col("p11") + 1.5 * smooth) / (F.col("p1") + 2.5 * smooth)).alias("tpr"), ((F.col("p00") + 1.5 * smooth) / (F.col("p0") + 2.5 * smooth)).alias("tnr")), "matrix")
        if before is not None:
            both = matrix.join(before.select("annotator", F.col("tpr").alias("a"), F.col("tnr").alias("b")), "annotator")
            if (both.agg(F.max(F.greatest(F.abs(F.col("tpr") - F.col("a")), F.abs(F.col("tnr") - F.col("b")))).alias("m")).first().m or 0.0) < still:
                break
        y = posterior.where(chosen).toPandas().sort_values("inner_id")
        y = y.set_index("inner_id")["p"].reindex(ids).fillna(0.5).to_numpy()
        model = fit(x, y, FEATURES, l2, start=model)
        prior = _prior(feats, spark, model)
        ratio = F.when(F.col("label") == 1, F.log(F.col("tpr") / (1 - F.col("tnr")))).otherwise(F.log((1 - F.col("tpr")) / F.col("tnr")))
        said = all_labels.join(matrix, "annotator").groupBy("inner_id").agg(F.sum(ratio).alias("said"))
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("said") + F.col("prior")))
        posterior = stored(said.join(prior, "inner_id").select("inner_id", (1 / (1 + F.exp(-z))).alias("p")), "posterior")
    return Consensus(human, posterior, matrix)


def _prior(feats: DataFrame, spark, model: tuple[np.ndarray, float]) -> DataFrame:
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            rows = [np.asarray(r, np.int32) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_rows(rows, w, b), pa.float64())], names=["inner_id", "prior"])

    return feats.mapInArrow(run, "inner_id bigint, prior double")


def disputed(c: Consensus) -> DataFrame:
    """(inner_id, label) of the items whose counted human labels include both 0 and 1."""
    both = c.labels.groupBy("inner_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return both.join(c.posterior, "inner_id").select("inner_id", (F.col("p") >= 0.5).cast("bigint").alias("label"))


def item_labels(c: Consensus) -> DataFrame:
    """One row per item: the label, its probability, the number of counted labels and the share that agrees with it."""
    n = c.labels.groupBy("inner_id").agg(F.count(F.lit(1)).alias("n_labels"), F.avg("label").alias("m"))
    y = F.col("p") >= 0.5
    return n.join(c.posterior, "inner_id").select("inner_id", y.cast("bigint").alias("label"), F.when(y, F.col("p")).otherwise(1 - F.col("p")).alias("confidence"), "n_labels", F.when(y, F.col("m")).otherwise(1 - F.col("m")).alias("agreeing"))


def reliability(c: Consensus) -> DataFrame:
    """(annotator, n_labels, sensitivity, specificity, reliability): reliability is Youden's index, 0 for guessing, below 0 for turned labels."""
    name = F.when(F.col("annotator") == JUDGE, F.lit("(judge)")).otherwise(F.col("annotator"))
    return c.annotators.select(name.alias("annotator"), F.col("n").alias("n_labels"), F.col("tpr").alias("sensitivity"), F.col("tnr").alias("specificity"), (F.col("tpr") + F.col("tnr") - 1).alias("reliability"))


def krippendorff(labels: DataFrame) -> DataFrame:
    """One row: Krippendorff's nominal alpha of the counted labels over items with two or more, and what it is made of."""
    per = counted(labels).groupBy("inner_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").cast("double").alias("k")).where("n >= 2")
    a = per.agg(F.count(F.lit(1)).alias("n_items"), F.sum("n").alias("n_labels"), F.sum("k").alias("ones"), F.sum(2 * F.col("k") * (F.col("n") - F.col("k")) / (F.col("n") - 1)).alias("apart"))
    n = F.col("n_labels")
    do, de = F.col("apart") / n, 2 * F.col("ones") * (n - F.col("ones")) / (n * (n - 1))
    return a.select("n_items", n.cast("bigint").alias("n_labels"), F.round(do, 8).alias("observed"), F.round(de, 8).alias("expected"), F.when(de == 0, F.lit(1.0)).otherwise(F.round(1 - do / de, 8)).alias("alpha"))
