import random
import unicodedata

from quern.llm import canon


def test_rules():
    c = canon.canonical
    assert c(None) is None and c("") == "" and c("​  ") == ""
    assert c("Ｘin　chào­") == "Xin chào"
    assert c("рhօ̀ng") == "phòng" and c("Ðà") == "Đà"
    assert c(unicodedata.normalize("NFD", "Tiếng Việt")) == "Tiếng Việt"
    assert c("ậ") == c("ậ") == "ậ"
    assert c("👨‍👩‍👧") == "👨‍👩‍👧" and c("a‍b") == "ab"
    assert c("A") != c("a") and c("a\r\nb") == "a\nb"


def test_frame_equals_string_form(spark):
    rng = random.Random(2)
    odd = [ch for ch, _ in canon.tables()[0] if not any(0x1100 <= ord(z) < 0x1200 for z in unicodedata.normalize("NFKD", ch))]
    near = list("aeo uDxi\n ‍👨👩̛̣̀́ааɑÐ️\r\t1")
    texts = [None, "", " ", "́", "x" * 50_000 + "а"] + ["".join(rng.choice(near if rng.random() < 0.8 else odd) for _ in range(rng.randrange(25))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id bigint, text string, canonical bigint")
    got = {r.id: r.canonical for r in canon.with_canonical(df).collect()}
    assert got == {i: canon.canonical(t) for i, t in enumerate(texts)}
    assert all(canon.canonical(x) == x for x in got.values() if x)
    assert canon.with_canonical(df.limit(0)).count() == 0


def test_pairs(spark):
    rows = [(1, "chào bạn"), (2, "ｃhào bạn"), (3, "chào bạn"), (4, "Chào bạn"), (5, None), (6, " "), (7, "　"), (2, "ｃhào bạn"), (None, "chào bạn")]
    got = {(r.id_a, r.id_b) for r in canon.look_alike_pairs(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    assert got == {(1, 2), (2, 3)}
    forms = canon.form_classes(spark.createDataFrame(rows[:7], "id bigint, text string")).collect()
    assert {r.id: r.class_id for r in forms} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}


def test_letters_of_other_scripts_look_like_latin_ones(spark):
    same = ["PAS COC", "ꓑꓮꓢ ꓚꓳꓚ", "ⲢAS CⲞC", "ᏢᎪᏚ ᏟOᏟ", "РАЅ СОС"]
    assert {canon.canonical(t) for t in same} == {"PAS COC"} and canon.canonical("a‑b") == canon.canonical("a‐b") == "a-b"
    df = spark.createDataFrame([*enumerate(same), (9, "pas coc"), (10, same[0])], "id bigint, text string")
    pairs = {(r.id_a, r.id_b) for r in canon.look_alike_pairs(df).collect()}
    assert pairs == {(a, b) for a in (0, 1, 2, 3, 4, 10) for b in (0, 1, 2, 3, 4, 10) if a < b and (a, b) != (0, 10)}


def test_replacements_settle_in_any_order():
    table = canon.translation()
    assert not {ord(ch) for to in table.values() for ch in to} & table.keys()
    rng = random.Random(6)
    odd = [*map(chr, table), *"ae \n\r‍️👨👩̛̣̀́"]
    for text in ("".join(rng.choice(odd) for _ in range(rng.randrange(20))) for _ in range(2000)):
        want = text
        for pattern, to in canon._PYTHON_BEFORE:
            want = pattern.sub(to, want)
        assert canon._full(text) == unicodedata.normalize("NFC", unicodedata.normalize("NFD", want).translate(table))
