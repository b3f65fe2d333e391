"""Queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import abuse, batches, bpe, canon, consensus, mixing, pii, quality, simjoin
from quern.session import spread, stored, table

#: What TESTDATA.md calls similar.
SIMILAR = {"k": 3, "t": Fraction(1, 2), "least": 8}


def _batches(s: SparkSession, d: str, *result) -> DataFrame:
    return batches.deduplicated(s, table(s, d, "samples"), table(s, d, "incoming_posts"), *result, **SIMILAR)


def _consensus(s: SparkSession, d: str) -> consensus.Consensus:
    return consensus.consensus(table(s, d, "rater_labels"), table(s, d, "samples"))


def _shares(s: SparkSession, d: str) -> DataFrame:
    targets = table(s, d, "mix_targets")
    return mixing.shares(stored(mixing.mixture(table(s, d, "documents"), targets), "mixture"), targets)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: pii.found(table(s, d, "samples")),
    "p1_redacted": lambda s, d: pii.redacted(table(s, d, "samples").select("id", "text")).select("id", "redacted"),
    "p2_found": lambda s, d: simjoin.near_pairs(table(s, d, "samples"), **SIMILAR),
    "p2_groups": lambda s, d: simjoin.near_groups(table(s, d, "samples"), **SIMILAR),
    "p3_found": lambda s, d: canon.look_alike_pairs(table(s, d, "samples")),
    "p3_forms": lambda s, d: canon.form_classes(table(s, d, "samples")),
    "p4_found": lambda s, d: _batches(s, d),
    "p4_accepted": lambda s, d: _batches(s, d, lambda _, x: x.accepted()),
    "p4_report": lambda s, d: _batches(s, d, batches.report),
    "p5_found": lambda s, d: abuse.flagged(abuse.scores(table(s, d, "samples"), table(s, d, "review_labels"))),
    "p5_scores": lambda s, d: abuse.scores(table(s, d, "samples"), table(s, d, "review_labels")),
    "p5_rates": lambda s, d: abuse.rates(abuse.scores(table(s, d, "samples"), table(s, d, "review_labels"))),
    "p5_voters": lambda s, d: abuse.voters(abuse.supervised(table(s, d, "samples"), table(s, d, "review_labels"))),
    "p6_found": lambda s, d: consensus.disputed(_consensus(s, d)),
    "p6_labels": lambda s, d: consensus.item_labels(_consensus(s, d)),
    "p6_reliability": lambda s, d: consensus.reliability(_consensus(s, d)),
    "p6_agreement": lambda s, d: consensus.krippendorff(table(s, d, "rater_labels")),
    "p7_ids": lambda s, d: bpe.with_ids(table(s, d, "documents").select("doc_id", "text")).select("doc_id", "ids"),
    "p7_round_trip": lambda s, d: bpe.with_text(bpe.with_ids(table(s, d, "documents").select("doc_id", "text"))).select("doc_id", "decoded", F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("same")),
    "p8_mixture": lambda s, d: mixing.mixture(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p8_shares": lambda s, d: _shares(s, d),
    "p9_found": lambda s, d: quality.not_prose(spread(table(s, d, "documents").select("doc_id", "text"))),
    "p9_statistics": lambda s, d: quality.judged(spread(table(s, d, "documents").select("doc_id", "text"))),
}

ORACLE_SQL: dict[str, str] = {
    "p6_agreement": """
        WITH c AS (SELECT inner_id, coalesce(annotator, '') AS annotator, label_human AS y,
                          row_number() OVER (PARTITION BY inner_id, coalesce(annotator, '') ORDER BY labelled_at DESC NULLS LAST, label_human DESC) AS r
                   FROM rater_labels WHERE inner_id IS NOT NULL AND label_human IN (0, 1)),
        i AS (SELECT inner_id, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS k FROM c WHERE r = 1 GROUP BY 1 HAVING count(*) >= 2),
        a AS (SELECT count(*) AS n_items, sum(n) AS n, sum(k) AS k, sum(2 * k * (n - k) / (n - 1)) AS apart FROM i)
        SELECT n_items, n::BIGINT AS n_labels, round(apart / n, 8) AS observed, round(2 * k * (n - k) / (n * (n - 1)), 8) AS expected,
               CASE WHEN 2 * k * (n - k) / (n * (n - 1)) = 0 THEN 1.0 ELSE round(1 - (apart / n) / (2 * k * (n - k) / (n * (n - 1))), 8) END AS alpha FROM a""",
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS decoded, true AS same FROM documents",
}
