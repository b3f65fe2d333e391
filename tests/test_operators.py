import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import judge as J
from quern.operators import agreement as A
from quern.operators import dedup as D
from quern.operators import merge as M
from quern.operators import stats as S
from quern.plans import annotate, preprocess


def links(spark, pairs):
    return spark.createDataFrame(pairs, "a bigint, b bigint")


def test_greedy_keeps_what_going_through_in_order_keeps(spark):
    drops = lambda p: sorted(r.id for r in D.greedy_drops(links(spark, p)).collect())
    assert drops([(1, 2), (2, 3), (3, 4), (4, 5)]) == [2, 4]
    assert drops([(1, 2), (2, 3)]) == [2]
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(40)})
    kept: list[int] = []
    for x in range(30):
        if not any((k, x) in edges for k in kept):
            kept.append(x)
    assert drops(edges) == [x for x in range(30) if x not in kept]


def test_near_dedup_against_all_pairs(spark):
    base = [f"từ{i} " * 3 + " ".join(f"w{i}_{j}" for j in range(40)) for i in range(5)]
    rows = []
    for i, t in enumerate(base):
        w = t.split()
        rows += [t, t, " ".join([*w[:20], "khác", *w[21:]]), " ".join(w[:-1])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, None, "", "ab"])], "id bigint, text string")
    sig = {r.id: r.signature for r in D.minhash(df).collect()}
    sim = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) / 128
    kept: list[int] = []
    for i in sorted(sig):
        if not any(sim(k, i) >= 0.85 for k in kept):
            kept.append(i)
    assert sorted(r.id for r in D.near_marked(df).where("is_kept").collect()) == kept


def test_threshold_edge(spark):
    a = list(range(128))
    rows = [(1, a), (2, a[:109] + [x + 1000 for x in a[109:]]), (3, [x + 5000 for x in a[:20]] + a[20:])]
    d = spark.createDataFrame(rows, "id bigint, signature array<bigint>")
    assert {(r.a, r.b) for r in D.near_links(d).collect()} == {(1, 2)}


def test_long_lists_are_split(spark):
    rng = random.Random(8)
    base = [rng.randrange(2**32) for _ in range(128)]
    rows = []
    for i in range(60):
        s = list(base)
        for j in rng.sample(range(128), rng.randrange(1, 26)):
            s[j] = rng.randrange(2**32)
        rows.append((i, s))
    d = spark.createDataFrame(rows, "id bigint, signature array<bigint>")
    want = {(i, j) for i, a in rows for j, b in rows if i < j and sum(x == y for x, y in zip(a, b, strict=True)) >= 109}
    for hot in (D.HOT, 7):
        assert {(r.a, r.b) for r in D.near_links(d, hot=hot).where("similarity < 1").collect()} == {p for p in want if rows[p[0]][1] != rows[p[1]][1]}


def test_the_smallest_are_exact_whatever_the_size(spark, monkeypatch):
    monkeypatch.setattr(D, "SORTED", 3)
    df = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("r"), "id").unionAll(spark.range(3000, 3010).select(F.lit("0" * 32).alias("r"), "id"))
    rows = sorted((r.r, r.id) for r in df.collect())
    for k in (0, 1, 4, 10, 11, 700, 3009, 3010, 5000):
        assert sorted((r.r, r.id) for r in D.smallest(df, "r", "id", k).collect()) == rows[:k]


def test_numbers_and_batches(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 200)], "k bigint").repartition(7)
    got = [(r.k, r.n) for r in D.numbered(df, "k", "n").orderBy("k").collect()]
    assert [n for _, n in got] == list(range(1, 201))
    assert D.numbered(df.limit(0), "k", "n").count() == 0
    assert D.batches(df, "k", 8).agg(F.max("batch_id")).first()[0] == 24


def test_first_and_last(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, None, 0), (4, "b", 2)], "id bigint, k string, o int")
    assert {r.id for r in D.first_by(df, "k", "o").collect()} == {2, 4}
    assert {r.id for r in D.first_by(df, "k", "o", last=True).collect()} == {1, 4}


def test_audit_sample_is_exact_and_repeatable(spark):
    rows = [(i, "sarcastic", False, "high_conf") for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, round1_label string, need_review boolean, route_reason string")
    picked = lambda seed: {r.id for r in D.audit_sample(df, 0.2, seed).where("route_reason = 'audit_sampled' and need_review").collect()}
    assert len(picked(1)) == 4 and picked(1) == picked(1) and picked(1) != picked(2)
    assert D.audit_sample(df.limit(0), 0.2, 1).count() == 0


ROUTES = [
    ("1", 0, False, False, "sarcastic", False, "high_conf"), ("0", 0, False, False, "non_sarcastic", False, "high_conf"), ("1", 1, False, False, "sarcastic", True, "low_conf"), ("0", 1, False, False, "non_sarcastic", True, "low_conf"),
    ("1", None, False, False, "sarcastic", True, "low_conf"), ("INVALID", None, False, False, "invalid", True, "uncertain"), ("1", 0, True, False, "sarcastic", True, "missing_image"), ("INVALID", None, False, True, "invalid", True, "invalid_json"), (None, None, None, None, "invalid", True, "uncertain"),
]


def test_routing(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROUTES)], "i int, l string, n int, m boolean, e boolean, want string, review boolean, reason string")
    o = J.override_of(F.col("m"), F.col("e"))
    for r in df.select("*", J.round_label(F.col("l"), o).alias("got"), J.route_reason(F.col("l"), F.col("n"), o).alias("why")).collect():
        assert (r.got, r.why, r.why != "high_conf") == (r.want, r.reason, r.review)


def test_replies(spark):
    rows = [
        ('{"llm_label": 1, "has_emoji": "0", "needs_human_check": true}', None, "1", False), ('<think>{x}</think> {"llm_label": "0"}', None, "0", False), ('x {"llm_label": 1.0} y', None, "1", False), ('{"llm_label": true}', None, "1", False),
        ('{"llm_label": "true"}', None, "INVALID", False), ('{"llm_label": -1}', None, "INVALID", False), ("[1]", '{"llm_label": 1}', "INVALID", True), ("???", '{"llm_label": 1}', "1", False), ("???", "!", "INVALID", True), (None, None, "INVALID", True), ("", None, "INVALID", True),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, raw1 string, raw2 string, want string, bad boolean")
    got = {r.id: r for r in annotate.read_replies(df).collect()}
    for i, (_, _, want, bad) in enumerate(rows):
        assert (got[i].label, got[i].parse_error) == (want, bad), rows[i]
    assert got[0].has_emoji == 0 and got[0].needs_human_check == 1
    extra = spark.createDataFrame([(1, '{"llm_label": 1, "Notes": "%s", "reasoning": "vì"}' % ("n" * 501), None)], "id bigint, raw1 string, raw2 string")
    r = annotate.read_replies(extra).first()
    assert len(r.notes) == 500 and r.reasoning == {"verdict": "vì"}


def test_human_labels(spark):
    kind = "id bigint, inner_id string, data struct<image:string,text:string>, annotations array<struct<was_cancelled:boolean,result:array<struct<value:struct<choices:array<string>>>>>>"
    one = lambda *choices, cancelled=False: (cancelled, [((list(choices),),)])
    rows = [(1, "5", ("i", "t"), [one("Sarcastic", cancelled=True), one("?", "Not Sarcastic")]), (2, "5", ("i", "t"), [one("Sarcastic")]), (3, "6", ("i", "t"), [one("sacarstic")]), (4, "x", ("i", "t"), []), (5, None, None, None), (6, "7", ("i", "t"), [])]
    assert {r.inner_id: r.label for r in A.human_by_item(spark.createDataFrame(rows, kind)).collect()} == {5: 0, 6: 1, 7: None}


def test_kappas_of_known_counts(spark):
    pairs = [(1, 1)] * 22 + [(0, 0)] * 14 + [(0, 1)] * 8 + [(1, 0)] * 4
    r = A.pair_stats(spark.createDataFrame(pairs, "label_human int, label_llm int")).first()
    assert (r.n, r.agree_pct, r.tp, r.tn, r.fp, r.fn) == (48, 75.0, 22, 14, 8, 4)
    assert round(r.cohen_kappa, 4) == 0.4894 and round(r.fleiss_kappa, 4) == 0.4857 and r.cohen_band == r.fleiss_band == "moderate"
    none = A.pair_stats(spark.createDataFrame([], "label_human int, label_llm int")).first()
    assert none.n == 0 and math.isnan(none.cohen_kappa) and none.cohen_band == "undefined"
    assert A.pair_stats(spark.createDataFrame([(1, 1)] * 3, "label_human int, label_llm int")).first().cohen_kappa == 1.0


def test_watermarks(spark):
    target = spark.createDataFrame([(i, "threads") for i in (1, 2, 4, 5, 6, 7, 8, 9, 10)], "id bigint, source string")
    rows = spark.createDataFrame([(i,) for i in range(1, 11)], "id bigint")
    assert [r.id for r in M.above(rows, M.watermark(target, "count")).collect()] == [10]
    assert M.above(rows, M.watermark(target, "max_id")).count() == 0
    assert M.next_id(rows) == 11 and M.next_id(rows.limit(0)) == 1


def test_rename_plan(spark):
    records = spark.createDataFrame([(1, "d/post00001.jpg"), (2, "d/a.JPG"), (3, "d/b.jpg"), (4, "d/c.jpg"), (5, None)], "id bigint, image_path string")
    listing = spark.createDataFrame([("d/a.JPG",)], "path string")
    left = M.leftover_ids(spark.createDataFrame([("tmp_3.jpg",), ("tmp_x.jpg",)], "path string"))
    assert {r.id: (r.target, r.state) for r in M.rename_plan(records, listing, left).collect()} == {1: ("post00001.jpg", "no_change"), 2: ("post00002.jpg", "renamed"), 3: ("post00003.jpg", "recovered"), 4: ("post00004.jpg", "missing")}


def test_stages_and_stats(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, " A ", "x"), (3, None, "x"), (4, "b", ""), (5, "c", "gone")], "id bigint, text string, image_path string")
    listing = spark.createDataFrame([("x",)], "path string")
    got = {r.id: r.drop_stage for r in preprocess.staged(df, listing=listing).collect()}
    assert got == {1: None, 2: "exact", 3: "null", 4: "null", 5: "image"}
    assert preprocess.staged(df.limit(0)).count() == 0
    r = S.routed_stats(spark.createDataFrame([], "round1_label string, route_reason string, need_review boolean, has_emoji int, needs_human_check int")).first()
    assert r.total == 0 and r.review_rate == 0 and r.labels["invalid"] == 0 and r.reasons == {}


@pytest.mark.parametrize("n", [0, 3])
def test_three_way(spark, n):
    t = lambda rows: spark.createDataFrame(rows[: n or 0] if n == 0 else rows, "text string, label int")
    a, b, c = t([("x", 1), ("y", None)]), t([("x", 0), ("z", 1)]), t([("x", 1), ("y", 1)])
    got = {r.text: r.missing for r in A.three_way(a, b, c).collect()}
    assert got == ({} if n == 0 else {"x": None, "y": "annotator_2", "z": "annotator_1"})
    assert list(itertools.chain(got)) is not None


def test_preprocess_full_runs_all_stages(spark, tmp_path):
    import hashlib

    import __spark_entry__
    from quern.catalog import QUERIES

    base = [f"w{i}" for i in range(60)]
    changed = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(base))
    rows = [
        (1, changed(), "a/1.jpg"), (2, changed(59), "a/2.jpg"), (3, changed().upper(), "a/3.jpg"), (4, "một bài khác hẳn", "a/4.jpg"), (5, "bài mất ảnh", "a/5.jpg"), (6, None, "a/6.jpg"),
        (7, "không ảnh", " "), (8, changed(0, 30, 45), "a/8.jpg"), (9, changed(0, 59), "a/9.jpg"), (10, changed(1, 59), "a/10.jpg"), (11, "một bài  khác hẳn", "a/11.jpg"),
    ]
    spark.createDataFrame([(*r, "s") for r in rows], "id bigint, text string, image_path string, source string").write.parquet(f"{tmp_path}/samples.parquet")

    def signature(t):
        w = t.split()
        g = {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} or {t}
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in g]
        return [min(x ^ (i * 2654435761 & 0xFFFFFFFF) for x in h) for i in range(128)]

    seen, kept, n_near = set(), [], 0
    for i, t, path in rows:
        if not t or not path.strip() or i % 5 == 0:
            continue
        n = " ".join(t.lower().split())
        if n in seen:
            continue
        seen.add(n)
        sig = signature(n)
        if any(sum(x == y for x, y in zip(sig, k, strict=True)) / 128 >= 0.85 for _, k in kept):
            n_near += 1
        else:
            kept.append((i, sig))
    assert n_near and any(i == 4 for i, _ in kept)
    got = QUERIES["preprocess_full"](spark, str(tmp_path)).collect()
    assert sorted((r.old_id, r.id) for r in got) == [(i, k) for k, (i, _) in enumerate(kept, 1)]
    assert "preprocess_full" not in __spark_entry__.oracle_sql() and "preprocess_full" in __spark_entry__.entry.__code__.co_consts


def test_three_way_report(spark):
    rows = lambda r: spark.createDataFrame(r, "text string, label int")
    a = rows([("a", 1), ("b", 0), ("c", 1), ("d", None), ("e" * 80, 1), ("f", 1)])
    b = rows([("a", 1), ("b", 0), ("c", 0), ("d", 1), ("f", None)])
    c = rows([("a", 1), ("b", 0), ("c", 1), ("d", None), ("f", 0), ("g", 1)])
    t = A.three_way(a, b, c)
    r = A.three_way_report(t).first()
    assert (r.n_union, r.n_all_present, r.n_valid, r.n_all_agree, r.n_any_conflict, r.all_agree_pct) == (7, 5, 3, 2, 1, 66.67)
    assert (r.missing_annotator_1, r.missing_annotator_2, r.missing_llm, r.invalid_1, r.invalid_2, r.invalid_llm) == (1, 1, 0, 1, 1, 1)
    p1 = 5 / 9
    pe = p1 * p1 + (1 - p1) ** 2
    assert r.fleiss_kappa == round(((1 + 1 + 1 / 3) / 3 - pe) / (1 - pe), 4)
    assert sorted((x.reason, x.key) for x in A.skipped(t).collect()) == [("invalid_1", "d"), ("invalid_2", "f"), ("invalid_llm", "d"), ("missing_annotator_1", "g"), ("missing_annotator_2", "e" * 60)]
    assert [x.text for x in A.conflicts(t).collect()] == ["c"] and {(x.a, x.b): x.agree for x in A.pairwise(t).collect()} == {("1", "2"): 2, ("1", "llm"): 3, ("2", "llm"): 2}
    import json

    said = json.loads(A.nested_report(A.three_way_report(t), A.pairwise(t), A.three_way_report(t).select("n_valid", "n_all_agree"), A.skipped(t)).first().report)
    assert said["skipped"]["invalid_llm"] == ["d"] and said["agreement"] == {"n_valid": 3, "n_all_agree": 2} and len(said["pairwise"]) == 3
    none = A.three_way_report(t.limit(0)).first()
    assert none.n_union == 0 and math.isnan(none.fleiss_kappa) and none.all_agree_pct is None and none.fleiss_band == "undefined"


def test_feed_rows(spark):
    rows = [(1, "https://x/123456789_n.jpg", "một bài dài", 300, 300, None), (2, "https://y/123456789_n.jpg", "một bài dài", 300, 300, False), (3, "data:image", "một bài dài", 300, 300, False), (4, "https://x/223456789_n.jpg", "một bài dài", 300, 300, False), (5, "https://x/5.jpg", "ngắn", 300, 300, False), (6, "https://x/6.jpg", "một bài dài", 100, 300, False), (7, "https://x/7.jpg", "một bài dài", 300, 300, True)]
    posts = spark.createDataFrame(rows, "id bigint, image_url string, text string, width int, height int, is_video boolean")
    seen = spark.createDataFrame([("223456789",)], "image_id string")
    assert sorted(r.id for r in M.feed_rows(posts, 8).collect()) == [1, 2, 4]
    assert sorted(r.id for r in M.feed_rows(posts, 8, seen=seen).collect()) == [1]
