import unicodedata

from pyspark.sql import functions as F

from quern.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def cleaned(spark, text):
    return X.clean_threads(spark.createDataFrame([(1, text)], "id int, text string")).first().clean


def test_thread_cleaning(spark):
    assert cleaned(spark, None) is None and cleaned(spark, "  \n") is None
    assert cleaned(spark, "Thịnh hành\nbài hay") == "bài hay"
    assert cleaned(spark, "xem nhé Tiết lộ nội dung") is None
    assert cleaned(spark, "ten_nguoi\n3 giờ\nnội dung chính ở đây\n12K\n/\nDịch") == "nội dung chính ở đây"
    assert cleaned(spark, "một câu khá dài ở trên cùng\nten\n12/03/2025\nnội dung") == "một câu khá dài ở trên cùng\nnội dung"
    assert cleaned(spark, "câu này hay Dịch") == "câu này hay"
    assert cleaned(spark, "#1:\nảnh một\n#2:") == "ảnh một\n#2:"
    assert cleaned(spark, "x\na\nb\na\nb") == "x\na\nb"
    assert cleaned(spark, "trước Đang trả lời @nhật.vũ sau") == "trước"
    assert cleaned(spark, "Đang trả lời @nhật.vũ sau") == "sau"
    assert cleaned(spark, "chào @nhật.vũ nhé") == "chào username nhé"


def test_lines(spark):
    tail = lambda v: one(spark, v, X.drop_repeated_tail, "array<string>")
    assert tail([]) == [] and tail(["a"]) == ["a"] and tail(["a", "a"]) == ["a"]
    assert tail(["x", "a", "b", "a", "b"]) == ["x", "a", "b"] and tail(["a", "b", "c"]) == ["a", "b", "c"]
    assert one(spark, ["a", "a", "b", "a"], X.distinct_neighbours, "array<string>") == ["a", "b", "a"]


def test_halves_and_names(spark):
    assert one(spark, "haha", X.halve_repeated) == "ha" and one(spark, "aba", X.halve_repeated) == "aba"
    assert one(spark, "câu A câu A", X.halve_repeated) == "câu A"
    assert one(spark, "haha", lambda c: X.halve_repeated(c, 20)) == "haha"
    assert one(spark, "/x/1234567890_n.jpg", X.image_id) == "1234567890"
    assert one(spark, r"a\b\C.JPG", lambda c: X.post_image_name(F.lit(7), c)) == "post00007.jpg"
    assert one(spark, None, X.file_name) is None


def test_normal_form(spark):
    nfd = unicodedata.normalize("NFD", "Tiếng  Việt  ")
    assert one(spark, nfd, X.normalized) == "tiếng việt"


def test_facebook_posts(spark):
    clean = lambda v: one(spark, v, X.clean_facebook)
    assert clean(None) is None and clean(" \n ") is None
    assert clean(" a\nb\na\nb ") == "a\nb" and clean("câu A câu A") == "câu A" and clean("x\ny") == "x\ny"


def test_facebook_posts_strip_and_split_a_text_once(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(X.clean_facebook(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2 and plan.count("regexp_replace(") <= 10
    clean = lambda v: one(spark, v, X.clean_facebook)
    lines = "\n".join(f"dòng {i}" for i in range(300))
    assert clean(f"{lines}\n{lines}") == lines and clean("a\n\na\n\na") == "a" and clean("b a\na\nx\na") == "b a\na\nx\na"


def test_word_grams(spark):
    assert one(spark, "a b c a b c", X.word_grams) == ["a b c", "b c a", "c a b"] and one(spark, "a b", X.word_grams) == ["a b"] and one(spark, "", X.word_grams) == [""]
