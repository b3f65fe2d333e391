from pyspark.sql import functions as F

from quern.functions.html import sees_images, visible_text


def test_visible_text(spark):
    page = '<div>một<img alt="🙂"> hai<span style="display: none">ba</span><script>x</script><br>bốn &amp; năm</div>'
    df = spark.createDataFrame([(page,), (None,), ("",)], "p string")
    assert [r[0] for r in df.select(visible_text(F.col("p"))).collect()] == ["một 🙂  haibốn & năm", None, ""]


def test_model_names():
    assert sees_images("Qwen2.5-VL-7B") and sees_images("a-vl") and sees_images("qwen3.5-9b") and not sees_images("qwen2.5-7b")
