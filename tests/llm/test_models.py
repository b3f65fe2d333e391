import random

import numpy as np
import pytest

from quern.llm import abuse, consensus, mixing, pii, quality


PII_TEXTS = [
    "liên hệ chị Nguyễn Thị Hoa, sđt 0912 345 678 hoặc hoa.nt＠mail.example.com nhé", "ship về số nhà 12, thôn Bến Cải, xã Bờ Đá giùm mình", "cccd 0037 2607 6688 bị rơi, hộ chiếu B1234567",
    "stk 92519408859212, mã đơn SPN223510488, gọi 1900 0210, tag @abc_1, chị Hoa ở đường Hoa Mai", "hồ sơ của Trần Kim Ngân còn thiếu ảnh, gọi 0912345678 gặp em", "phụ huynh em Lê Quỳnh Anh nhớ đóng tiền", "tiệm ở 12 ngõ 7 phố Cầu Tre, quận Bờ Lau, giá 239.000đ, 53 phút",
    "cmnd 320357491 cấp lâu rồi, mail linh.tran@lop12.example giúp mình", "trọ phòng 43 chung cư Mây Chiều còn chỗ, alo 057.765.62.95", "công nhận mai tính, phạm vi hẹp, cao minh bạch lắm, văn hay chữ tốt", "hôm nay trời đẹp, mai đi chơi 3 ngày 2 đêm giá 1,4 triệu",
]


@pytest.fixture(scope="module")
def pii_model():
    return pii.train(PII_TEXTS * 6, rounds=30)


def test_pii(spark, pii_model, monkeypatch):
    rows = [*enumerate(PII_TEXTS[:4], 1), (5, None), (6, ""), (7, "x " * 20_000), (1, "liên hệ chị Nguyễn Thị Hoa")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "id bigint, text string, kind string")
    got = {(r.id, r.kind) for r in pii.found(df, model=pii_model).collect()}
    assert got == {(1, "person_name"), (1, "phone"), (1, "email"), (2, "address"), (3, "id_number")}
    red = {r.id: r.redacted for r in pii.redacted(df.where("id > 1"), model=pii_model).collect()}
    assert red[2] == "ship về [ADDRESS] giùm mình" and red[5] is None and red[6] == "" and red[7] == rows[6][1]
    assert pii.found(df.limit(0)).count() == 0


def test_pii_is_decided_without_patterns(pii_model, monkeypatch):
    want = [{k for k, _, _ in x} for x in pii.spans(PII_TEXTS, pii_model)]
    assert want[0] == {"person_name", "phone", "email"} and not want[3] and not want[9] and not want[10]
    monkeypatch.setattr(pii, "PATTERNS", [])
    monkeypatch.setattr(pii.Document, "matches", lambda self: 1 / 0)
    assert [{k for k, _, _ in x} for x in pii.spans(PII_TEXTS, pii_model)] == want


def test_pii_mentions_share_their_evidence(pii_model):
    """A name in lower case without accents or cue is found where the same name stands plainly, however often and far away; not without skip factors."""
    alone = pii.Model(pii_model.weights, pii_model.chain, np.zeros_like(pii_model.skip))
    t = "hồ sơ của Trần Kim Ngân còn thiếu ảnh. " + "trời đẹp quá đi chơi thôi " * 40 + "bữa trước tran kim ngan ghé qua. " * 10
    names = lambda m: [t[a:b] for k, a, b in pii.spans([t], m)[0] if k == "person_name"]
    assert names(alone) == ["Trần Kim Ngân"]
    assert names(pii_model) == ["Trần Kim Ngân"] + ["tran kim ngan"] * 10


def test_abuse(spark):
    texts = ["mày đúng là đồ súc vật, câm mồm lại", "hôm nay trời đẹp quá đi chơi thôi", "bác sĩ dặn tái khám sau một tuần", None, ""] * 12
    posts = spark.createDataFrame([(i, t, "a" if i % 2 else None) for i, t in enumerate(texts)], "id bigint, text string, source string")
    s = abuse.scores(posts, spark.createDataFrame([], "id bigint, unsafe int"))
    flagged = {r.id for r in abuse.flagged(s).collect()}
    assert flagged == {i for i in range(len(texts)) if i % 5 == 0}
    assert sum(r.n_posts for r in abuse.rates(s).collect()) == len(texts)
    assert abuse.scores(posts.limit(0), spark.createDataFrame([], "id bigint, unsafe int")).count() == 0


def test_label_model_tells_good_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    votes = np.full((4000, len(abuse.VOTERS)), -1)
    for j in range(4):
        said = rng.random(4000) < 0.6
        votes[said & y & (rng.random(4000) < 0.9), j] = 1
        votes[said & ~y & (rng.random(4000) < 0.03), j] = 1
    votes[(votes[:, :4] < 0).all(1), len(abuse.VOTERS) - 2] = 0
    rows, n = np.unique(votes, axis=0, return_counts=True)
    p, _ = abuse.label_model(rows, n.astype(float))
    of = {tuple(r): x for r, x in zip(rows, p, strict=True)}
    told = (votes[:, :4] == 1).sum(1) >= 2
    assert np.mean([(of[tuple(v)] > 0.5) for v in votes[told]]) > 0.9


def test_abuse_finds_what_no_voter_says_and_drops_what_weak_ones_say(spark):
    """Reviewed texts teach a phrase that no voter knows; a voter that is mostly wrong flags nothing alone; sources are one spelling."""
    rng = random.Random(5)
    filler = [f"chuyện {w} hôm nay ở {p}" for w in ("mưa", "nắng", "học bài", "nấu cơm", "đi chợ", "xem phim", "đọc sách") for p in ("nhà", "trường", "quán", "chợ", "công viên", "bến xe")]
    rows, want = [], set()
    for i in range(600):
        t, kind = f"{rng.choice(filler)} {rng.choice(filler)}", i % 6
        if kind == 0:
            t += " đồ khốn nạn, câm mồm lại"
        elif kind == 1:
            t += " quắn rọ xìu bẹp lắm nha"  # a phrase of no lexicon
        elif kind == 2:
            t += " mua loại máy này tốt"  # like_you by mistake
        if kind < 2:
            want.add(i)
        rows.append((i, t, ("Threads", " threads ", "THREADS", None)[i % 4]))
    posts = spark.createDataFrame(rows, "id bigint, text string, source string")
    reviews = spark.createDataFrame([(i, int(i in want)) for i in range(0, 600, 2)] + [(i, int(i in want)) for i in range(1, 600, 5)], "id bigint, unsafe int")
    s = abuse.scores(posts, reviews)
    got = {r.id for r in abuse.flagged(s).collect()}
    assert len(got & want) > 0.95 * len(want) and len(got - want) < 10
    assert {r.source for r in abuse.rates(s).collect()} == {"threads", None}
    v = {r.voter: r for r in abuse.voters(abuse.supervised(posts, reviews)).collect()}
    assert v["shut_up"].accuracy > 0.9 and v["like_you"].accuracy < 0.2 and v["like_you"].n_votes == 100
    assert abs(v["like_unsafe"].reviewed_accuracy - 1) < 0.1 and len(v) == len(abuse.VOTERS)
    plain = [abuse.plain(t) for _, t, _ in rows]
    majority = {i for i, t in enumerate(plain) if sum(abuse.votes(t, None)[: len(abuse.UNSAFE)]) > -len(abuse.UNSAFE)}
    assert len(got ^ want) < len(majority ^ want)


def test_consensus(spark):
    rng = random.Random(3)
    truth = {i: rng.randrange(2) for i in range(150)}
    rows = []
    for i, y in truth.items():
        for a, p in (("good", 0.95), ("fair", 0.8), ("turned", 0.1), ("guess", 0.5)):
            rows.append((i, i, a, y if rng.random() < p else 1 - y, f"2025-01-0{rng.randrange(1, 9)} 00:00:00", None))
    rows += [(0, 0, "good", 1 - truth[0], "2024-01-01 00:00:00", None), (None, 0, "good", 1, None, None), (5, 5, "x", None, None, 1), (5, 5, "x", -1, None, 1)]
    df = spark.createDataFrame(rows, "inner_id bigint, llm_id bigint, annotator string, label_human int, at string, label_llm int").selectExpr("*", "cast(at as timestamp_ntz) labelled_at", "cast(null as string) llm_route_reason")
    c = consensus.consensus(df, spark.createDataFrame([], "id bigint, text string"), rounds=6)
    labels = {r.inner_id: r.label for r in consensus.item_labels(c).collect()}
    assert len(labels) == 150 and sum(labels[i] == y for i, y in truth.items()) > 135
    rel = {r.annotator: r.reliability for r in consensus.reliability(c).collect()}
    assert rel["turned"] < 0 < rel["fair"] < rel["good"]
    assert {r.label for r in consensus.disputed(c).collect()} <= {0, 1}
    alpha = consensus.krippendorff(spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 0), (2, "b", 0)], "inner_id bigint, annotator string, label_human int").selectExpr("*", "cast(null as timestamp_ntz) labelled_at")).first()
    assert alpha.alpha == 1.0


def test_permutation_and_plan():
    for n in (1, 2, 5, 64, 1000):
        i = np.arange(n)
        out = mixing.permuted(i, np.full(n, n), np.full(n, 7, np.uint64))
        assert sorted(out) == list(range(n))
    plan = mixing.Plan({"a": 10_000, "b": 900}, [("a", 0.7, 1), ("b", 0.2, 3), ("c", 0.1, 2)], 100, 16, 1)
    n = dict(zip(plan.sources, plan.slots.tolist(), strict=True))
    assert n["b"] == 27 and abs(n["a"] / (n["a"] + n["b"]) - 7 / 9) < 0.02 and "c" not in n
    rows = list(plan.shard_counts(0, plan.shards))
    assert [r[0] for r in rows] == list(range(plan.shards)) and (sum(r[2] for r in rows) == plan.slots).all()
    assert all(r[2].sum() == 16 for r in rows[:-1]) and rows[-1][2].sum() == plan.slots.sum() - 16 * (plan.shards - 1)
    before = np.zeros(2, int)
    for _, first, counts in rows:
        assert (first == before).all()
        before = before + counts
    some = [*plan.shard_counts(2, 5)]
    assert [(k, a.tolist(), c.tolist()) for k, a, c in some] == [(k, a.tolist(), c.tolist()) for k, a, c in rows[2:5]]
    none = mixing.Plan({}, [("a", 1.0, 1)], 100, 16, 1)
    assert none.shards == 0 and not list(none.shard_counts(0, 1))


def test_plan_of_any_size_is_a_line_a_source():
    """10^13 and 10^16 tokens: any shards are drawn at once, still by chance and within the deviation of the draw."""
    for tokens in (10**13, 10**16):
        plan = mixing.Plan({"a": tokens, "b": tokens // 10}, [("a", 0.75, 1), ("b", 0.25, 40)], 1024, 512, 3)
        middle = plan.shards // 2
        rows = list(plan.shard_counts(middle, middle + 300))
        assert len(rows) == 300 and all(c.sum() == 512 for _, _, c in rows)
        b = np.array([c[1] for _, _, c in rows])
        assert abs(b.mean() - 128) < 3 and 6 < b.std() < 14
        assert all((f2 == f1 + c1).all() for (_, f1, c1), (_, f2, _) in zip(rows, rows[1:], strict=False))


def test_mixture(spark):
    docs = [(i, f"bài viết số {i} " * (5 + i % 7), "Threads" if i % 3 else " fb-page") for i in range(60)] + [(99, None, "threads"), (98, "", "threads"), (97, "x", None)]
    targets = spark.createDataFrame([("threads", 0.5, 1), ("fb_page", 0.4, 2), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    m = mixing.mixture(df, targets, block=32, shard=8)
    rows = m.collect()
    used = {}
    for r in rows:
        for t in range(r.first, r.first + r.n):
            used[(r.doc_id, t)] = used.get((r.doc_id, t), 0) + 1
    assert max(used.values()) <= 2 and not {r.doc_id for r in rows} & {97, 98, 99}
    s = {r.source: r.actual_share for r in mixing.shares(m, targets).collect()}
    assert s["gone"] == 0 and abs(s["threads"] - 5 / 9) < 0.06
    assert {r.source: round(r.spread_share, 4) for r in mixing.shares(m, targets).collect()} == {"threads": 0.5556, "fb_page": 0.4444, "gone": 0.0}
    again = mixing.mixture(df.repartition(5), targets, block=32, shard=8).collect()
    assert sorted(rows) == sorted(again)


def test_quality(spark):
    prose = "Hôm nay mình với bạn đi ăn bún chả ở quán đầu ngõ, ngon mà giá cũng hợp lý. Lần sau sẽ rủ cả nhà đi cùng cho vui."
    texts = [
        prose, prose.lower().replace(",", "").replace(".", ""), prose + "\n- một\n- hai", prose + " #ngon #bun", "- trứng\n- sữa\n- bánh mì\n- đường", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "a\tb\tc\n1\t2\t3\n4\t5\t6", "#a1 #b2 #c3 #d4 #e5 #f6 #g7 #h8", "12 33 4456 7 123 45 6 789 1234 5", "🥰😅✨😂", "chấm " * 40, "Thích · Trả lời · 3 giờ · Chia sẻ · 12K · Thích · Trả lời · GIF", " ​ ", "", None, (prose + "\n") * 1 + prose * 300,
    ]
    got = {r.doc_id: r.kind for r in quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(4)] == ["prose"] * 4
    assert got[4] == "list" and got[5] == got[6] == "table" and all(got[i] == "junk" for i in range(7, 12))
    assert got[12] == got[13] == "blank" and got[14] is None and got[15] in ("prose", "junk")


def test_quality_tells_repetition_at_any_length(spark):
    phrase = "mua ngay kẻo lỡ cơ hội vàng này"
    pool = [f"từ{i}" for i in range(1, 60)]
    rng = random.Random(2)
    long = " ".join(f"{rng.choice('bcdghklmnt')}{rng.choice(['anh', 'em', 'oi', 'uong', 'ay', 'on', 'iet'])}{rng.randrange(9)}" for _ in range(2000))
    sentence = "Sáng nay trời mưa to nên mình ở nhà đọc sách với mẹ và nấu một nồi cháo."
    texts = [
        *((phrase + " ") * k for k in (5, 45, 60, 600)), " ".join(f"câu thứ {i} của cả đoạn dài là một hai ba bốn năm sáu bảy tám chín mười mốt".split()[j] for i in [7] * 60 for j in range(18)),
        " ".join(rng.choice(pool) for _ in range(3000)), "\n\n".join([sentence] * 3), long, sentence, "a b a b c",
    ]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i].kind for i in range(7)] == ["junk"] * 7
    assert [got[i].kind for i in (7, 8)] == ["prose"] * 2
    assert got[6].repeated_runs > 0.5 and got[8].repeated_bigrams == got[8].repeated_runs == 0
    assert got[9].repeated_bigrams == 0.5 and got[9].n_words == 5  # of ab, ba, ab, bc


def test_quick_look_misses_no_text():
    rng = random.Random(4)
    bits = ["0912", "345", " ", ".", "-", "(", ")", "không", "một", "hai", "a", "còng", "@", "at", "[", "]", "nhà", "số", "12", "đường", "phố", "Nguyễn", "Hoa", "nguyen", "lan", "​", "\n", "x", "yz", "7", "o957478194", "B1234567", "，", "0️⃣"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 14)))
        if len(pii.Document(t).nodes()):
            assert pii.may_have_nodes(t), t


def test_scaled_fit_of_a_sample_is_the_same_for_any_size_of_the_table():
    from quern.llm.linear import Sparse, fit_scaled

    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, 6)) for _ in range(300)]
    y = np.array([0.9 if 7 in r or 11 in r else 0.01 for r in rows])
    weight = np.where(y > 0.5, 1.0, 12.0)
    fitted = [fit_scaled(Sparse(rows, 0.25), y, 64, l2=0.1, steps=120, weight=weight * times) for times in (1, 1000)]
    assert np.allclose(fitted[0][0], fitted[1][0], atol=1e-6) and abs(fitted[0][1] - fitted[1][1]) < 1e-6
