import random
from fractions import Fraction
from pathlib import Path

import pytest

from quern.llm import batches, simjoin
from quern.llm.words import words
from quern.session import shared_dir

OPTIONS = {"k": 3, "t": Fraction(1, 2), "least": 8}


def grams(t):
    w = words(t)
    return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 8 else None


def similar(a, b):
    return a is not None and b is not None and 3 * len(a & b) >= len(a) + len(b)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(40)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[len(w) // 3 :] + w[: len(w) // 3]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 30))]
        texts.append(" ".join(w))
    return [*texts, None, "", "một hai ba", texts[0].upper(), "x y z " * 3000]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_all_pairs(spark, hot):
    texts = corpus(hot)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")], "id bigint, text string, a string")
    g = [grams(t) for t in texts]
    want = {(i, j) for j in range(len(g)) for i in range(j) if similar(g[i], g[j])}
    near = simjoin.near_pairs(df, hot=hot, **OPTIONS)
    assert {(r.id_a, r.id_b) for r in near.collect()} == want


def test_groups(spark):
    texts = corpus(9)
    g = [grams(t) for t in texts]
    rows = simjoin.near_groups(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), **OPTIONS).collect()
    assert len(rows) == len(texts)
    group = list(range(len(g)))
    for _ in range(len(g)):
        for j in range(len(g)):
            for i in range(j):
                if similar(g[i], g[j]):
                    group[i] = group[j] = min(group[i], group[j])
    for r in rows:
        assert r.group_id == group[r.id]
        assert r.links == sum(similar(g[r.id], x) for k, x in enumerate(g) if k != r.id)
    assert simjoin.near_groups(spark.createDataFrame([], "id bigint, text string"), **OPTIONS).count() == 0


def test_screening_in_order(spark):
    texts = corpus(4, 90)
    history = spark.createDataFrame(list(enumerate(texts[:40])), "id bigint, text string")
    new = [(1 + i // 20, 100 + i, t, "s") for i, t in enumerate(texts[40:])]
    df = spark.createDataFrame(new, "batch_id int, id bigint, text string, source string")
    accepted, want = [g for g in map(grams, texts[:40]) if g], set()
    for _, i, t, _ in new:
        g = grams(t)
        if any(similar(g, x) for x in accepted):
            want.add(i)
        elif g:
            accepted.append(g)
    store, s = batches.screened(spark, history, df, **OPTIONS)
    assert {r.id for r in s.rejected.collect()} == want
    assert s.accepted().count() == len(new) - len(want)
    assert sum(r.n_rows for r in batches.report(store, s).collect()) == len(new)
    # the same batches one after another, each appended before the next
    store = batches.HashStore(spark, k=3, t=Fraction(1, 2), least=8, buckets=4)
    store.append(history)
    got = set()
    for b in range(1, 3):
        s = batches.screen(store, df.where(f"batch_id = {b}"))
        got |= {r.id for r in s.rejected.collect()}
        store.append(s.accepted())
    assert got == {i for i in want if i < 140}
    store.drop()


def test_coverage_credits_accepted_rows_before(spark):
    import re

    p = [" ".join(f"p{i}w{j}" for j in range(9)) for i in range(8)]
    history = [(1, f"{p[0]}. {p[1]}.")]
    new = [
        (1, 10, f"{p[0]}. {p[2]}. {p[3]}.", "s"), (1, 11, f"{p[3]}. {p[4]}. {p[5]}. {p[6]}", "s"), (2, 12, f"{p[4]}. {p[7]}. {p[7]}", "s"),
        (2, 13, f"{p[0]}. {p[1]}. bản sao riêng", "s"), (3, 14, "bản sao riêng. câu khác hẳn", "s"), (None, 15, f"{p[6]}. đứng trước mọi lô", "s"), (3, 16, None, "s"),
    ]
    df = spark.createDataFrame(new, "batch_id int, id bigint, text string, source string")
    store, s = batches.screened(spark, spark.createDataFrame(history, "id bigint, text string"), df, **OPTIONS)
    rejected = {r.id for r in s.rejected.collect()}
    assert rejected == {13}
    parts = lambda t: [w for x in re.split(r"[.!?…:;]+(?=\s|$)|\n+", t or "") if (w := tuple(words(x)))]
    known, want = {x for _, t in history for x in parts(t)}, {}
    for b, i, t, _ in sorted(new, key=lambda r: (-1 if r[0] is None else r[0], r[1])):
        if ps := parts(t):
            want[i] = (b, sum(len(x) for x in ps if x in known) / sum(map(len, ps)))
        if i not in rejected:
            known |= set(ps)
    assert {r.id: r.covered for r in batches.coverage(store, s).collect()} == pytest.approx({i: c for i, (_, c) in want.items()})
    got = {r.batch_id: r.mean_covered for r in batches.report(store, s).collect()}
    for b in (None, 1, 2, 3):
        of = [c for x, c in want.values() if x == b]
        assert got[b] == pytest.approx(sum(of) / len(of), abs=1e-6)
    # what is known is appended once
    store.append(s.accepted())
    store.append(s.accepted())
    ph = [r.ph for r in store.table("paragraph").collect()]
    assert len(ph) == len(set(ph)) == len(known)
    store.drop()


@pytest.mark.parametrize("hot", [20_000, 2])
def test_a_store_opens_again_and_grows(spark, tmp_path, hot):
    """Each batch by a store object of its own; lists that only appends make long are split."""
    texts = corpus(11, 90)
    df = spark.createDataFrame([(i // 32, 100 + i, t, "s") for i, t in enumerate(texts)], "batch_id int, id bigint, text string, source string")
    accepted, want = [], set()
    for i, t in enumerate(texts):
        g = grams(t)
        if any(similar(g, x) for x in accepted):
            want.add(100 + i)
        elif g:
            accepted.append(g)
    path, got = f"file://{tmp_path}/store", set()
    for b in range(3):
        out = batches.deduplicated(spark, df.limit(0), df.where(f"batch_id = {b}"), path=path, hot=hot, **OPTIONS)
        got |= {r.id for r in out.collect()}
    assert got == want
    store = batches.HashStore(spark, path)
    assert (store.k, store.t, store.least) == (3, Fraction(1, 2), 8)
    assert store.table("content").count() == store.table("text").count() == len(accepted)
    assert max(r["count"] for r in store.table("run").groupBy("sh").count().collect()) > 2
    store.drop()


def test_a_second_process_appends(spark, tmp_path):
    import subprocess
    import sys

    base = [" ".join(f"{c}{i}" for i in range(12)) for c in "abc"]
    path = f"file://{tmp_path}/store"
    batches.deduplicated(spark, spark.createDataFrame([(1, base[0])], "id bigint, text string"), spark.createDataFrame([(1, 5, base[1], "s")], "batch_id int, id bigint, text string, source string"), path=path, **OPTIONS)
    code = f"""
from pyspark.sql import SparkSession
from quern.llm import batches
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/other").config("spark.sql.warehouse.dir", "{tmp_path}/wh").getOrCreate()
rows = [(2, 6, {base[0] + " x"!r}, "s"), (2, 7, {base[1] + " y"!r}, "s"), (2, 8, {base[2]!r}, "s")]
out = batches.deduplicated(s, None, s.createDataFrame(rows, "batch_id int, id bigint, text string, source string"), path="{path}")
print("FOUND", sorted(r.id for r in out.collect()))
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=batches.__file__.rsplit("/quern/", 1)[0])
    assert "FOUND [6, 7]" in said.stdout, said.stderr[-2000:]
    store = batches.HashStore(spark, path)
    assert sorted(r.id for r in store.table("content").collect()) == [1, 5, 8]
    store.drop()


def test_registered_groups_hold_the_registered_pairs(spark, tmp_path):
    from quern.llm.queries import QUERIES

    texts = [*corpus(21, 80), "ngắn thôi", "Ngắn thôi"]
    spark.createDataFrame([(i, t, "p", "s") for i, t in enumerate(texts)], "id bigint, text string, image_path string, source string").write.parquet(f"{tmp_path}/samples.parquet")
    pairs = {(r.id_a, r.id_b) for r in QUERIES["p2_found"](spark, str(tmp_path)).collect()}
    rows = {r.id: r for r in QUERIES["p2_groups"](spark, str(tmp_path)).collect()}
    assert pairs and all(rows[a].group_id == rows[b].group_id for a, b in pairs)
    assert sum(r.links for r in rows.values()) == 2 * len(pairs)
    n = len(texts)
    assert rows[n - 1].class_id == n - 2 and rows[n - 1].links == 0


def test_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "COPIES", 3)
    t = " ".join(f"w{i}" for i in range(20))
    texts = [t] * 10 + [t + " x"] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    rows = [(r.id_a, r.id_b) for r in simjoin.near_pairs(df, **OPTIONS).collect()]
    assert len(rows) == len(set(rows)) == 14 * 13 // 2


def test_screening_of_nulls_and_nothing(spark):
    kind = "batch_id int, id bigint, text string, source string, h int"
    t = "a b c d e f g h i"
    history = spark.createDataFrame([(1, None), (2, ""), (3, t), (None, t + " j")], "id bigint, text string")
    new = spark.createDataFrame([(1, 10, t, "s", 1), (None, 11, None, None, 1), (1, 12, t + " z", None, 1), (2, None, "x y z", "s", 1), (2, 13, "q w e r t y u i o p " * 3000, "s", 1), (2, 14, "q w e r t y u i o p " * 3000, "s", 1)], kind)
    found = lambda h, b: sorted(r.id for r in batches.deduplicated(spark, h, b, **OPTIONS).collect())
    assert found(history, new) == [10, 12, 14] and found(history.limit(0), new) == [12, 14] and found(history.limit(0), new.limit(0)) == []
    rows = batches.deduplicated(spark, history, new, batches.report, **OPTIONS).collect()
    assert sum(r.n_rows for r in rows) == 6 and sum(r.n_accepted for r in rows) == 3


def test_meetings_that_leave_no_room_for_the_overlap_are_left_out(spark):
    # of 12 runs each, 8 must be shared; a run at places 0 and 6 has at most 5 behind it in b
    e = spark.createDataFrame([(1, 10, 12, 0), (1, 11, 12, 6), (2, 10, 12, 1), (2, 11, 12, 2)], "sh bigint, id bigint, n int, pos int")
    assert [tuple(r) for r in simjoin.meetings(e, e, Fraction(1, 2)).collect()] == [(10, 11, 8)]


def test_runs_are_merged_in_parts_and_leave_nothing_on_disk(spark):
    texts = corpus(11)
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    reps = simjoin.word_table(df.where("length(text) > 40")).select("id", "words")
    counts = simjoin.run_counts(reps, 3)
    rows = lambda *part: sorted(map(tuple, simjoin.entries(reps, counts, 3, Fraction(1, 2), 2, *part).collect()))
    parts = [rows(i, simjoin.PARTS) for i in range(simjoin.PARTS)]
    assert simjoin.PARTS > 1 and all(parts) and sorted(sum(parts, [])) == rows()
    folder = Path(shared_dir(spark).removeprefix("file://"))
    names = lambda: {p.name for p in folder.iterdir()} if folder.exists() else set()
    before = names()
    simjoin.near_duplicates(df, hot=2, **OPTIONS)
    assert sorted(x.split("-")[0] for x in names() - before) == ["members", "met", "pairs", "reps"]


def test_a_store_hashes_each_record_once(spark, monkeypatch):
    texts = corpus(13)
    rows, whole = [], batches.entries
    monkeypatch.setattr(batches, "entries", lambda reps, *a, **o: rows.append(reps.count()) or whole(reps, *a, **o))
    store = batches.HashStore(spark, k=3, t=Fraction(1, 2), least=8, buckets=4)
    store.append(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"))
    kept = store.table("text")
    assert len(rows) == batches.PARTS > 1 and all(rows) and sum(rows) == kept.count()
    want = whole(kept, store.counts, 3, Fraction(1, 2))
    assert sorted(map(tuple, store.table("run").drop("turn").collect())) == sorted(map(tuple, want.collect()))
    store.drop()


def test_many_texts_at_a_time_have_the_paragraphs_and_hashes_of_each():
    import pyarrow as pa

    from quern.llm.words import WordHash, hash_batch, hash_column, paragraph_texts, paragraphs

    rng = random.Random(14)
    signs = list("aAbÀİßΣ1²½_-.!?…:;, \n\r\t\x1c 　‍️👩́ơһＡ中Ⅷ①")
    texts = [None, "", ".", "\n", "a.", "..a", *("".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000))]
    got = paragraph_texts(texts)
    assert got == ["\n".join(paragraphs(x)) for x in texts] and paragraph_texts([]) == []
    for some in (got, [x for x in got if x], [None, "a b\nc"], []):
        col, memo = pa.array(some, pa.string()), WordHash()
        for mine, each in zip(hash_column(col, memo), hash_batch([x or "" for x in some], memo), strict=True):
            assert (mine == each).all() and len(mine) == len(each)
        for mine, each in zip(hash_column(col[1:], memo), hash_batch([x or "" for x in some[1:]], memo), strict=True):
            assert (mine == each).all() and len(mine) == len(each)


def test_room_decides_as_the_needed_overlap_does():
    # what the join of meetings asks first is the same as need <= room, and no room is larger than either record
    for t in (Fraction(1, 2), Fraction(4, 5), Fraction(7, 9)):
        up, down = t.numerator, t.numerator + t.denominator
        for na in range(1, 25):
            for nb in range(1, 25):
                for pa, pb in ((0, 0), (na - 1, 0), (na // 2, nb // 3), (na // 3, nb - 1)):
                    room = min(pa, pb) + min(na - pa, nb - pb)
                    assert ((na + nb) * up <= room * down) == (-(-(na + nb) * up // down) <= room) and room <= min(na, nb)
