"""Agreement of annotators: joins of labels, kappas, coverage."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.judge import human_label, label_text
from quern.functions.text import blank_to_null, strip
from quern.operators.dedup import first_by


def human_by_item(tasks: DataFrame) -> DataFrame:
    """(inner_id, text, label): the first task of each number; tasks whose inner_id is no number are left out."""
    d = tasks.select(F.expr("try_cast(inner_id as bigint)").alias("inner_id"), F.col("data.text").alias("text"), human_label(F.col("annotations")).alias("label"), "id")
    return first_by(d, "inner_id", "id").drop("id")


def _first_by_text(d: DataFrame, order: str) -> DataFrame:
    """The first row of each text without blanks around it, as key; blank and null texts are left out."""
    return first_by(d.withColumn("key", blank_to_null(strip(F.col("text")))), "key", order)


def human_by_text(tasks: DataFrame) -> DataFrame:
    """(key, label, inner_id, id): the first task of each text."""
    d = tasks.select(F.col("data.text").alias("text"), human_label(F.col("annotations")).alias("label"), "inner_id", "id")
    return _first_by_text(d, "id").select("key", "label", "inner_id", "id")


def judge_by_text(records: DataFrame, order: str) -> DataFrame:
    """(key, label, id) of ``records``(id, text, label_llm1): the first record of each text; INVALID and null have no label."""
    label = F.when(F.col("label_llm1") != "INVALID", F.expr("try_cast(label_llm1 as int)")).alias("label")
    return _first_by_text(records, order).select("key", label, "id")


def annotated(tasks: DataFrame) -> DataFrame:
    """Tasks with an annotation, cancelled ones too."""
    return tasks.where(F.size("annotations") > 0)


def export_counts(tasks: DataFrame) -> DataFrame:
    """One row: the tasks of an export and those with annotations."""
    return tasks.agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.size("annotations") > 0).alias("n_annotated"))


def labels_per_annotator(labels: DataFrame) -> DataFrame:
    y = F.col("label_human")
    return labels.groupBy("annotator").agg(F.count_if(y == 1).alias("ones"), F.count_if(y == 0).alias("zeros"), F.count_if(y.isNull() | ~y.isin(0, 1)).alias("others"))


def judge_by_id(records: DataFrame, order: str) -> DataFrame:
    """(llm_id, label): the first record of each id; INVALID and null have no label."""
    return first_by(records, "id", order).select(F.col("id").alias("llm_id"), F.when(F.col("label_llm1") != "INVALID", F.expr("try_cast(label_llm1 as int)")).alias("label"), "notes")


def joined(human: DataFrame, judge: DataFrame, shift: int = -1) -> DataFrame:
    """(inner_id, llm_id, text, label_human, label_llm, status): llm_id = inner_id + shift.

    status: missing_llm, or one of invalid_both, invalid_human, invalid_llm, valid.
    """
    h = human.select("inner_id", (F.col("inner_id") + shift).alias("llm_id"), "text", F.col("label").alias("label_human"))
    d = h.join(judge.select("llm_id", F.col("label").alias("label_llm"), F.lit(True).alias("__j")), "llm_id", "left")
    a, b = F.col("label_human").isNull(), F.col("label_llm").isNull()
    status = F.when(F.col("__j").isNull(), "missing_llm").when(a & b, "invalid_both").when(a, "invalid_human").when(b, "invalid_llm").otherwise("valid")
    return d.withColumn("status", status).drop("__j")


def kappa_band(k: Column) -> Column:
    return (
        F.when(k.isNull() | F.isnan(k), "undefined").when(k < 0, "poor (less than chance)").when(k < 0.2, "slight").when(k < 0.4, "fair").when(k < 0.6, "moderate").when(k < 0.8, "substantial").otherwise("almost perfect")
    )


def pair_stats(pairs: DataFrame, a: str = "label_human", b: str = "label_llm") -> DataFrame:
    """One row of counts, agreement and both kappas of pairs of 0/1 labels; NaN without pairs, 1 if chance agrees always."""
    x, y = F.col(a), F.col(b)
    n = lambda c: F.count_if(c)
    d = pairs.agg(F.count(F.lit(1)).alias("n"), n(x == y).alias("agree"), n((x == 1) & (y == 1)).alias("tp"), n((x == 0) & (y == 0)).alias("tn"), n((x == 0) & (y == 1)).alias("fp"), n((x == 1) & (y == 0)).alias("fn"))
    c = {k: F.col(k).cast("double") for k in ("n", "agree", "tp", "tn", "fp", "fn")}
    po = c["agree"] / c["n"]
    pe = ((c["tp"] + c["fn"]) * (c["tp"] + c["fp"]) + (c["tn"] + c["fp"]) * (c["tn"] + c["fn"])) / (c["n"] * c["n"])
    ones = (2 * c["tp"] + c["fp"] + c["fn"]) / (2 * c["n"])
    fe = ones * ones + (1 - ones) * (1 - ones)
    kappa = lambda e: F.when(c["n"] == 0, F.lit(float("nan"))).when(e >= 1, F.lit(1.0)).otherwise((po - e) / (1 - e))
    d = d.select("n", "agree", (F.col("n") - F.col("agree")).alias("conflict"), F.round(F.when(c["n"] > 0, 100 * po), 2).alias("agree_pct"), "tp", "tn", "fp", "fn", F.round(kappa(pe), 6).alias("cohen_kappa"), F.round(kappa(fe), 6).alias("fleiss_kappa"))
    return d.withColumns({"cohen_band": kappa_band(F.col("cohen_kappa")), "fleiss_band": kappa_band(F.col("fleiss_kappa"))})


def fleiss(votes: DataFrame, item: str, label: str, categories: list) -> DataFrame:
    """(n_raters, n_items, kappa): Fleiss' kappa of the items with equally many ratings, one row for each number of ratings, two at least."""
    per = votes.where(F.col(label).isin(categories)).groupBy(item).agg(*[F.count_if(F.col(label) == c).cast("double").alias(f"c{i}") for i, c in enumerate(categories)])
    total = sum((F.col(f"c{i}") for i in range(1, len(categories))), F.col("c0"))
    d = per.withColumn("r", total).where("r >= 2")
    r = F.col("r")
    square = sum((F.col(f"c{i}") * F.col(f"c{i}") for i in range(1, len(categories))), F.col("c0") * F.col("c0"))
    g = d.groupBy(r.cast("int").alias("n_raters")).agg(F.count(F.lit(1)).alias("n_items"), F.avg((square - r) / (r * (r - 1))).alias("p"), *[(F.sum(f"c{i}") / F.sum(r)).alias(f"p{i}") for i in range(len(categories))])
    e = sum((F.col(f"p{i}") * F.col(f"p{i}") for i in range(1, len(categories))), F.col("p0") * F.col("p0"))
    k = F.when(e >= 1, F.lit(1.0)).otherwise((F.col("p") - e) / (1 - e))
    return g.select("n_raters", "n_items", F.round(k, 6).alias("kappa"))


def coverage(j: DataFrame) -> DataFrame:
    """One row of counts by status."""
    n = lambda s: F.count_if(F.col("status").isin(*s)).alias(s[0])
    return j.agg(F.count(F.lit(1)).alias("n_human"), n(["missing_llm"]), F.count_if(F.col("status").isin("invalid_human", "invalid_both")).alias("human_invalid"), F.count_if(F.col("status").isin("invalid_llm", "invalid_both")).alias("llm_invalid"), n(["valid"]))


def disagreements(j: DataFrame) -> DataFrame:
    d = j.where((F.col("status") == "valid") & (F.col("label_human") != F.col("label_llm")))
    return d.select("inner_id", "llm_id", "text", "label_human", label_text(F.col("label_human")).alias("label_human_str"), "label_llm", label_text(F.col("label_llm")).alias("label_llm_str"))


def unmatched(judge: DataFrame, human: DataFrame, shift: int = -1) -> DataFrame:
    """Judge ids that no human item points to."""
    return judge.select("llm_id").join(human.select((F.col("inner_id") + shift).alias("llm_id")), "llm_id", "left_anti")


def three_way(first: DataFrame, second: DataFrame, judge: DataFrame, key: str = "text") -> DataFrame:
    """(key, label_1, label_2, label_llm, missing, invalid_1, invalid_2, invalid_llm) over all keys of three tables(key, label).

    missing names the first of annotator_1, annotator_2 and llm without the key, and the invalid
    flags then are false.
    """
    part = lambda d, n: d.select(key, F.col("label").alias(f"label_{n}"), F.lit(True).alias(f"has_{n}"))
    d = part(first, "1").join(part(second, "2"), key, "full_outer").join(part(judge, "llm"), key, "full_outer")
    missing = F.when(F.col("has_1").isNull(), "annotator_1").when(F.col("has_2").isNull(), "annotator_2").when(F.col("has_llm").isNull(), "llm")
    d = d.withColumn("missing", missing)
    bad = lambda n: (F.col("missing").isNull() & F.col(f"label_{n}").isNull()).alias(f"invalid_{n}")
    return d.select(key, "label_1", "label_2", "label_llm", "missing", bad("1"), bad("2"), bad("llm"))


_PAIRS = [("1", "2"), ("1", "llm"), ("2", "llm")]


def skipped(t: DataFrame, key: str = "text", most: int = 60) -> DataFrame:
    """(reason, key) of the keys of ``three_way`` that make no triple, keys cut to ``most`` characters; a key may have several invalid reasons."""
    reason = lambda n: F.when(F.col(f"invalid_{n}"), F.lit(f"invalid_{n}"))
    missing = F.when(F.col("missing").isNotNull(), F.concat(F.lit("missing_"), "missing"))
    why = F.filter(F.array(missing, reason("1"), reason("2"), reason("llm")), lambda x: x.isNotNull())
    return t.select(F.explode(why).alias("reason"), F.substring(F.col(key).cast("string"), 1, most).alias("key"))


def three_way_report(t: DataFrame) -> DataFrame:
    """One row of coverage, full agreement, Fleiss' kappa of three raters and the label counts of ``three_way``, in one pass; percent null and kappa NaN without triples."""
    x, y, z = F.col("label_1"), F.col("label_2"), F.col("label_llm")
    valid = F.col("missing").isNull() & x.isNotNull() & y.isNotNull() & z.isNotNull()
    ones = F.when(valid, x + y + z).cast("double")
    n = lambda c: F.count_if(c)
    d = t.agg(
        F.count(F.lit(1)).alias("n_union"), n(F.col("missing").isNull()).alias("n_all_present"), n(valid).alias("n_valid"), *[n(F.col("missing") == m).alias(f"missing_{m}") for m in ("annotator_1", "annotator_2", "llm")],
        *[n(F.col(f"invalid_{k}")).alias(f"invalid_{k}") for k in ("1", "2", "llm")], n(valid & (x == y) & (y == z)).alias("n_all_agree"), *[n(valid & (c == v)).alias(f"{k}_{w}") for k, c in (("first", x), ("second", y), ("llm", z)) for v, w in ((1, "sarcastic"), (0, "not_sarcastic"))],
        F.avg((ones * ones + (3 - ones) * (3 - ones) - 3) / 6).alias("po"), (F.avg(ones) / 3).alias("p1"),
    )
    e = F.col("p1") * F.col("p1") + (1 - F.col("p1")) * (1 - F.col("p1"))
    k = F.round(F.when(F.col("n_valid") == 0, F.lit(float("nan"))).when(e >= 1, F.lit(1.0)).otherwise((F.col("po") - e) / (1 - e)), 4)
    pct = F.round(F.when(F.col("n_valid") > 0, 100.0 * F.col("n_all_agree") / F.col("n_valid")), 2)
    d = d.withColumns({"n_any_conflict": F.col("n_valid") - F.col("n_all_agree"), "all_agree_pct": pct, "fleiss_kappa": k})
    return d.withColumn("fleiss_band", kappa_band(F.col("fleiss_kappa"))).drop("po", "p1")


def pairwise(t: DataFrame) -> DataFrame:
    """``pair_stats`` of each two of the three raters over the valid triples of ``three_way``, and their names."""
    valid = t.where("missing IS NULL AND label_1 IS NOT NULL AND label_2 IS NOT NULL AND label_llm IS NOT NULL")
    out = [pair_stats(valid, f"label_{a}", f"label_{b}").select(F.lit(a).alias("a"), F.lit(b).alias("b"), "*") for a, b in _PAIRS]
    return out[0].unionAll(out[1]).unionAll(out[2])


def conflicts(t: DataFrame, key: str = "text") -> DataFrame:
    """Valid triples on which the two people differ."""
    d = t.where("missing IS NULL AND label_llm IS NOT NULL AND label_1 <> label_2")
    return d.select(key, *[c for n in ("1", "2", "llm") for c in (f"label_{n}", label_text(F.col(f"label_{n}")).alias(f"label_{n}_str"))])


def nested_report(coverage_row: DataFrame, pairs: DataFrame, two_way: DataFrame, skip: DataFrame, most: int = 1000) -> DataFrame:
    """(report) one JSON text of coverage, pairwise figures, distribution and skipped keys (at most ``most`` of a reason are listed: it is a report to read; all are counted)."""
    reasons = sorted(r["reason"] for r in skip.select("reason").distinct().collect())
    lists = {x: [r["key"] for r in skip.where(F.col("reason") == x).orderBy("key").limit(most).collect()] for x in reasons}
    part = lambda d, name: d.select(F.struct("*").alias(name))
    rows = [part(coverage_row, "coverage").first()[0].asDict(True), [r.asDict(True) for r in pairs.collect()], two_way.first().asDict(True), lists]
    text = json.dumps(dict(zip(("coverage", "pairwise", "agreement", "skipped"), rows, strict=True)), ensure_ascii=False, indent=2)
    return skip.sparkSession.createDataFrame([(text,)], "report string")
