"""A round of annotation: judge, validate, repair, route, sample for audit, report."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import judge as J
from quern.operators.dedup import audit_sample, first_by
from quern.operators.stats import routed_stats

#: A judge takes a batch of records and returns the raw replies, one for each.
Judge = Callable[[pd.DataFrame], list[str]]


def rule_judge(batch: pd.DataFrame) -> list[str]:
    """A stand-in without a model: sarcastic if an exaggeration stands beside a clown or an upside-down face."""
    out = []
    for t in batch["text"].fillna(""):
        face = any(c in t for c in "🤡🙃🫠")
        label = int(face and any(w in t.lower() for w in ("hết sức", "quá trời", "tuyệt vời", "xuất sắc")))
        out.append(f'{{"llm_label": {label}, "has_emoji": {int(any(ord(c) > 0x1F000 for c in t))}, "needs_human_check": {int(not t.strip())}, "reasoning": {{"verdict": "rule"}}}}')
    return out


def judged(records: DataFrame, judge: Judge = rule_judge) -> DataFrame:
    """(id, raw1, raw2) of ``records``(id, text, ...): a model is loaded once in each worker and sees batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "raw1": judge(b), "raw2": None})

    return records.mapInPandas(run, "id bigint, raw1 string, raw2 string")


_loaded: dict[str, object] = {}


def loaded(name: str, load: Callable[[], object]) -> object:
    """What ``load`` gives, made once in each worker process; another name takes its place."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = load()
    return _loaded[name]


def judged_by(records: DataFrame, name: str, load: Callable[[], Judge]) -> DataFrame:
    """``judged`` by a model that each worker loads once, when its first batch comes."""
    return judged(records, lambda b: loaded(name, load)(b))


def cached(records: DataFrame, done: DataFrame) -> DataFrame:
    """Records that a checkpoint has."""
    return records.join(done.select("id").distinct(), "id", "left_semi")


def progress(results: DataFrame, records: DataFrame) -> DataFrame:
    """Results beside what is known of their records, for the progress log."""
    return results.join(records, "id")


def remaining(records: DataFrame, done: DataFrame) -> DataFrame:
    """Records that a checkpoint doesn't have yet."""
    return records.join(done.select("id").distinct(), "id", "left_anti")


def read_replies(replies: DataFrame) -> DataFrame:
    """(id, label, has_emoji, needs_human_check, notes, reasoning, parse_error) of ``replies``(id, raw1, raw2).

    A reply that is no JSON is replaced by the repair try; if that isn't usable
    either, or the first is JSON but no object, the record is invalid and has parse_error.
    """
    d = replies.withColumns({"v1": J.parsed(F.col("raw1")), "v2": J.parsed(F.col("raw2"))})
    d = d.withColumns({"ok1": J.is_object(F.col("v1")), "ok2": J.is_object(F.col("v2"))})
    r = F.when(F.col("ok1"), J.validated(F.col("v1"))).when(F.col("v1").isNotNull(), J.failed(J.UNEXPECTED)).when(F.col("ok2"), J.validated(F.col("v2"))).otherwise(J.failed(J.REPAIR_FAILED))
    bad = ~(F.col("ok1") | (F.col("v1").isNull() & F.col("ok2")))
    return d.select("id", r.alias("r"), bad.alias("parse_error")).select("id", "r.*", "parse_error")


def routed(inputs: DataFrame, results: DataFrame, order: str, stamp: str | None = None) -> DataFrame:
    """``inputs``(id, text, image_path) with their last result, routed; inputs without a result are left out.

    ``results``(id, label_llm1, has_emoji, needs_human_check, notes, reasoning, parse_error, image_missing).
    """
    last = first_by(results, "id", order, last=True)
    d = inputs.select("id", "text", "image_path").join(last.drop("text", "image_path"), "id")
    o = J.override_of(F.col("image_missing"), F.col("parse_error"))
    reason = J.route_reason(F.col("label_llm1"), F.col("needs_human_check"), o)
    at = F.lit(stamp) if stamp else J.utc_stamp(F.current_timestamp())
    return d.withColumns({"round1_label": J.round_label(F.col("label_llm1"), o), "route_reason": reason, "need_review": reason != "high_conf", "timestamp_utc": at})


def slim(r: DataFrame) -> DataFrame:
    return r.select("id", "text", "image_path", "label_llm1", "has_emoji", "needs_human_check", "reasoning", F.col("timestamp_utc").alias("timestamp"))


def outputs(r: DataFrame) -> dict[str, DataFrame]:
    """The tables that a round writes."""
    return {"all": r, "auto_accepted": r.where(~F.col("need_review")), "human_queue": r.where("need_review"), "stats": routed_stats(r)}


def whole_round(inputs: DataFrame, results: DataFrame, order: str, rate: float = 0.05, seed: int = 42, stamp: str | None = None) -> DataFrame:
    return audit_sample(routed(inputs, results, order, stamp), rate, seed)
