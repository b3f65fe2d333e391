import json

import pytest
from pyspark.sql import functions as F

from quern.plans import annotate
from quern.sources import readers, sinks
from quern.streaming.incremental import judge_stream, merge_new


def test_input_records(spark, tmp_path):
    rows = [{"id": 1, "text": "a", "image_path": "x", "image_paths": [], "other": 1}, {"id": "2", "text": "b", "image_path": "y", "image_paths": ["p"]}]
    (tmp_path / "a.json").write_text("\n " + json.dumps(rows))
    got = {r.id: r.image_paths for r in readers.input_records(spark, f"file://{tmp_path}/a.json").collect()}
    assert got == {1: None, 2: ["p"]}
    (tmp_path / "l.jsonl").write_text(json.dumps(rows[0]) + "\n{broken\n\n" + json.dumps(rows[1]) + "\n")
    assert {r.id for r in readers.input_records(spark, f"file://{tmp_path}/l.jsonl").collect()} == {1, 2}
    with pytest.raises(FileNotFoundError):
        readers.input_records(spark, f"file://{tmp_path}/none.json")


def test_sessions_and_listing(spark, tmp_path):
    for name, files in {"s1": {"a.json": [{"post_link": "l", "image_local": ["i"]}], "b.json": [{"post_link": "no"}]}, "s2": {"a.json": {"post_link": "m", "image_local": "one"}}}.items():
        (tmp_path / name).mkdir()
        for f, rows in files.items():
            (tmp_path / name / f).write_text(json.dumps(rows))
    got = {r.post_link: (r.session, r.image_local) for r in readers.session_rows(spark, f"file://{tmp_path}").collect()}
    assert got == {"l": ("s1", ["i"]), "m": ("s2", ["one"])}
    assert readers.file_listing(spark, f"file://{tmp_path}/s1/*").count() == 2


def test_replace_append_and_array(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    sinks.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    for _ in range(2):
        sinks.append_batch(spark.range(4), f"file://{tmp_path}/b", 1)
    assert spark.read.parquet(f"file://{tmp_path}/b").count() == 4
    lines = [r.value for r in sinks.json_array_text(spark.createDataFrame([(2, None), (1, "x")], "id int, t string"), "id").collect()]
    assert json.loads("\n".join(lines)) == [{"id": 1, "t": "x"}, {"id": 2, "t": None}]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, target, ck = (f"file://{tmp_path}/{x}" for x in ("src", "target", "ck"))
    for rows in ([(1, "a"), (2, "a"), (3, "b")], [(4, "b"), (5, "c")]):
        spark.createDataFrame(rows, "id bigint, k string").write.mode("append").parquet(src)
        merge_new(spark, spark.readStream.schema("id bigint, k string").parquet(src), target, "k", "id", ck)
    assert {(r.k, r.id) for r in spark.read.parquet(target).collect()} == {("a", 1), ("b", 3), ("c", 5)}


def test_replace_keeps_one_of_both(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    sinks.replace_table(spark.read.parquet(path).where("id > 1"), path)
    assert [r.id for r in spark.read.parquet(path).collect()] == [2] and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_long_single_line_array(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿ \n " + json.dumps([{"id": i, "text": "x" * 50} for i in range(2000)]))
    assert readers.is_array_file(spark, f"file://{tmp_path}/a.json") and readers.input_records(spark, f"file://{tmp_path}/a.json").count() == 2000
    (tmp_path / "b.json").write_text(" " * 9000 + "[]")
    (tmp_path / "c.json").write_text("")
    assert readers.is_array_file(spark, f"file://{tmp_path}/b.json") and not readers.is_array_file(spark, f"file://{tmp_path}/c.json")


def test_checkpoint_progress_and_reset(spark, tmp_path):
    lines = [{"id": 1, "label_llm1": "0"}, {"id": 2, "label_llm1": "1"}, {"id": 1, "label_llm1": "1", "has_emoji": 1}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    got = {r.id: r.label_llm1 for r in readers.checkpointed(spark, f"file://{tmp_path}/c.jsonl").collect()}
    assert got == {1: "1", 2: "1"} and readers.checkpointed(spark, f"file://{tmp_path}/none").count() == 0
    log = f"file://{tmp_path}/progress"
    for _ in range(2):
        sinks.append_progress(spark.range(2), log)
    assert spark.read.json(log).count() == 4
    sinks.reset(spark, log)
    sinks.reset(spark, log)
    assert readers.target_or_empty(spark, log, "id bigint").count() == 0


def test_tasks_export_and_settings(spark, tmp_path):
    (tmp_path / "empty.json").write_text("[]")
    with pytest.raises(ValueError):
        readers.labelling_tasks(spark, f"file://{tmp_path}/empty.json")
    tasks = sinks.import_tasks(spark.createDataFrame([("hay", "a/b/c.jpg")], "text string, image_path string"))
    assert tasks.first().data.asDict() == {"image": "/data/local-files/?d=images/c.jpg", "text": "hay"}
    assert sinks.export_name("20250102_030405") == "project-1-20250102_030405.json"
    (tmp_path / "round.yaml").write_text("# x\nrandom_audit_rate: 0.25\nseed: 7  # y\nllm_model: \"a/b\"\nload_in_4bit: true\n")
    values = readers.yaml_settings(str(tmp_path / "round.yaml"))
    assert values["llm_model"] == "a/b" and values["load_in_4bit"] is True
    c = readers.round_config(spark, values)
    assert (c.random_audit_rate, c.seed, c.batch_size) == (0.25, 7, 8)
    spark.conf.set("quern.round.seed", "9")
    assert readers.round_config(spark, values).seed == 9 and readers.round_config(spark).random_audit_rate == 0.1
    spark.conf.unset("quern.round.seed")


def test_prompt_template(tmp_path):
    (tmp_path / "p").write_text("Câu hỏi {text}\n\n")
    (tmp_path / "e").write_text("\n\nVí dụ\n")
    assert readers.prompt_template(str(tmp_path / "p")) == "Câu hỏi {text}\n\n"
    assert readers.prompt_template(str(tmp_path / "p"), str(tmp_path / "e")) == "Câu hỏi {text}\n\nVí dụ\n"
    assert readers.prompt_template(str(tmp_path / "p"), str(tmp_path / "none")) == "Câu hỏi {text}\n\n"


def test_images_of_records(spark, tmp_path):
    rows = [(1, "a.jpg", None), (2, "gone.jpg", None), (3, "x", ["gone.jpg", "b.png", "a.jpg"]), (4, None, None), (5, " ", []), (6, "/abs/c.webp", None), (7, "bad.jpg", None)]
    df = spark.createDataFrame(rows, "id bigint, image_path string, image_paths array<string>")
    files = [("two/a.jpg", b"\xff\xd8\xff1"), ("one/b.png", b"\x89PNG"), ("two/b.png", b"\x89PNG"), ("/abs/c.webp", b"RIFF"), ("one/bad.jpg", b"<html>")]
    listing = spark.createDataFrame(files, "path string, content binary").withColumn("opens", readers.opens(F.col("content")))
    got = {r.id: (r.images, r.image_missing) for r in readers.loaded_images(df, listing, ["one/", "two/"]).collect()}
    assert got == {1: (["two/a.jpg"], False), 2: ([], True), 3: (["one/b.png", "two/a.jpg"], False), 4: ([], False), 5: ([], False), 6: (["/abs/c.webp"], False), 7: ([], True)}
    assert not readers.loaded_images(df, listing, ["one/"], sees_images=False).where("image_missing").count()


def test_renames_in_two_passes_and_copies(spark, tmp_path):
    for name, text in {"b.jpg": "1", "post00001.jpg": "2", "c.jpg": "3", "tmp_4.jpg": "4"}.items():
        (tmp_path / name).write_text(text)
    # 1 and 2 change places by their names; 4 was left by a run that broke off
    plan = spark.createDataFrame([(1, "b.jpg", "post00001.jpg", "renamed"), (2, "post00001.jpg", "post00002.jpg", "renamed"), (3, "c.jpg", "c.jpg", "no_change"), (4, "d.jpg", "post00004.jpg", "recovered"), (5, "e.jpg", "post00005.jpg", "missing")], "id bigint, current string, target string, state string")
    assert sinks.rename_images(plan, str(tmp_path)) == 3
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"post00001.jpg": "1", "post00002.jpg": "2", "c.jpg": "3", "post00004.jpg": "4"}
    copies = spark.createDataFrame([(1, 1, "c.jpg", "images/n1.jpg"), (2, 1, "none.jpg", "images/n2.jpg")], "id bigint, n int, source string, target string")
    for want in ("copied", "exists"):
        assert [r.state for r in sinks.copy_images(copies, str(tmp_path), str(tmp_path / "out")).orderBy("id").collect()] == [want, "missing"]
    assert (tmp_path / "out/images/n1.jpg").read_text() == "3"


def test_a_round_stops_and_goes_on(spark, tmp_path):
    src, target, ck, made = (f"file://{tmp_path}/{x}" for x in ("src", "target", "ck", "outputs"))
    seen = []

    def judge(df):
        seen.append(sorted(r.id for r in df.select("id").collect()))
        r = annotate.read_replies(annotate.judged_by(df, "rules", lambda: annotate.rule_judge))
        return r.withColumnRenamed("label", "label_llm1").withColumn("image_missing", F.lit(False)).join(df.select("id", "text", "image_path"), "id")

    rows = [(1, "quá trời đẹp 🤡", "i"), (2, "bình thường", "i"), (3, "", "i")]
    for part in (rows[:2], rows[1:]):
        spark.createDataFrame(part, "id bigint, text string, image_path string").write.mode("append").parquet(src)
        judge_stream(spark, spark.readStream.schema("id bigint, text string, image_path string").parquet(src), judge, target, ck)
    assert seen == [[1, 2], [3]]
    done = spark.read.parquet(target)
    assert annotate.remaining(spark.createDataFrame([(3,), (4,)], "id bigint"), done).collect()[0].id == 4
    inputs = spark.createDataFrame(rows, "id bigint, text string, image_path string")
    routed = annotate.routed(inputs, done, "id")
    assert sinks.write_outputs(routed, made, dry_run=True) == [f"{made}/{n}" for n in ("all", "auto_accepted", "human_queue", "stats")] and not (tmp_path / "outputs").exists()
    sinks.write_outputs(routed, made)
    assert {r.id: r.round1_label for r in spark.read.parquet(f"{made}/all").collect()} == {1: "sarcastic", 2: "non_sarcastic", 3: "non_sarcastic"}
    assert [r.id for r in spark.read.parquet(f"{made}/human_queue").collect()] == [3] and spark.read.parquet(f"{made}/stats").first().total == 3


def test_a_model_is_loaded_once():
    made = []
    for name in ("a", "a", "b"):
        annotate.loaded(name, lambda: made.append(1) or len(made))
    assert len(made) == 2


def test_a_clusters_folder_must_be_set(spark):
    from quern import session

    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        session.shared_dir(Fake)
