"""Sources and sinks: nothing is lost and nothing is made up."""

import json

import pytest
from pyspark.sql import functions as F

from proseloom.sources import readers, writers


def test_one_book_is_rewritten_alone(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seg"), F.lit("old").alias("text"))
    writers.save_tables({"segments": rows}, path, buckets=8)
    new = spark.createDataFrame([(17, 1, "new")], "doc_id long, seg int, text string")
    writers.save_tables({"segments": new}, path, buckets=8)
    writers.save_tables({"segments": new.withColumn("doc_id", F.lit(500).cast("long"))}, path, buckets=8)
    found = {(r.doc_id, r.seg): r.text for r in writers.load_table(spark, path, "segments").collect()}
    want = {(d, s): "old" for d in range(200) for s in (1, 2) if d != 17} | {(17, 1): "new", (500, 1): "new"}
    assert found == want


def test_a_book_without_rows_is_emptied(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("old").alias("text"))
    writers.save_tables({"segments": rows}, path, buckets=2)
    writers.save_tables({"segments": rows.where("false")}, path, buckets=2, books=spark.range(3, 5).toDF("doc_id"))
    assert {r.doc_id for r in writers.load_table(spark, path, "segments").collect()} == set(range(50)) - {3, 4}
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    writers.save_tables({"single": one}, path, buckets=2)
    writers.save_tables({"single": one.where("false")}, path, buckets=2, books=one)
    assert writers.load_table(spark, path, "single").schema == one.schema
    assert writers.load_table(spark, path, "single").collect() == []


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("old").alias("text"))
    writers.save_tables({"segments": rows}, path, buckets=4)
    before = writers.load_table(spark, path, "segments")
    writers.save_tables({"segments": rows.limit(10).withColumn("text", F.lit("new"))}, path, buckets=4)
    wide = rows.where("doc_id = 99").withColumn("more", F.lit(1))
    writers.save_tables({"segments": wide}, path, buckets=4)
    assert {r.text for r in before.collect()} == {"old"} and before.count() == 100
    assert writers.versions(spark, path, "segments") == [0, 1, 2]
    now = writers.load_table(spark, path, "segments")
    assert now.columns == ["doc_id", "text", "more"] and now.count() == 100 and now.where("more = 1").count() == 1
    assert writers.load_table(spark, path, "segments", 1).where("text = 'new'").count() == 10
    writers.drop_old_versions(spark, path, "segments", keep=1)
    assert writers.versions(spark, path, "segments") == [2] and writers.load_table(spark, path, "segments").count() == 100


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    rows = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    writers.save_tables({"segments": rows}, path, buckets=4)
    first = writers.manifest(spark, path, "segments")
    writers.save_tables({"segments": rows.withColumn("text", F.lit("b"))}, path, buckets=4)
    # A writer that still saw the first version comes too late, and nothing of it stays.
    monkeypatch.setattr(writers, "manifest", lambda *_: first)
    with pytest.raises(writers.ConcurrentWrite):
        writers.save_tables({"segments": rows.withColumn("text", F.lit("c"))}, path, buckets=4)
    monkeypatch.undo()
    assert {r.text for r in writers.load_table(spark, path, "segments").collect()} == {"b"}
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "state" / "segments").iterdir() if not p.name.startswith(".")) == ["data", "data", "version", "version"]


def test_exported_parts_are_in_order(spark, tmp_path):
    rows = [(d, n, f"book {d} part {n}") for d in (2, 1) for n in range(30)]
    parts = spark.createDataFrame(rows, "doc_id long, part_no long, text string").repartition(5)
    writers.write_parts(parts, "text", str(tmp_path / "out"))
    lines = [line for file in sorted((tmp_path / "out").glob("part-*")) for line in file.read_text().splitlines()]
    assert lines == [text for _, _, text in sorted(rows)]


def test_broken_log_lines_are_set_apart(spark):
    lines = ["{broken", "null", "", "  ", "[1]", "3", '{"id": "a"}', '{"id": "b", "raw_probability": 0.9}', '{"id": "c", ', "text"]
    table = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted(r.id for r in readers.qc_log_parse(table).collect()) == ["a", "b"]
    assert sorted(r.value for r in readers.qc_log_quarantine(table).collect()) == sorted(["{broken", "null", "[1]", "3", '{"id": "c", ', "text"])


def test_every_answer_has_rows_or_is_quarantined(spark):
    span = {"type": "dialogue", "speaker": "Ann", "text": "Hello"}
    person, tie = {"name": "Ann", "aliases": ["A."]}, {"a": "Ann", "char_b": "Bob", "states": [{"from_segment": 1}]}
    answers = {
        "spans": (json.dumps({"spans": [span]}), "spans"),
        "list": (json.dumps([span, {"text": " "}, None]), "spans"),
        "cast": (json.dumps({"cast": [person, {"name": ""}]}), "discovery"),
        "cast list": (json.dumps([person]), "cast"),
        "ties": ("```json\n" + json.dumps({"relationships": [tie], "cast": [person]}) + "\n```", "discovery"),
        "tie list": (json.dumps([tie]), "relationships"),
        "after a list": ("See [1] first. " + json.dumps({"spans": [span]}), "spans"),
        "other": (json.dumps({"foo": 1}), "spans"),
        "empty": ("", "spans"),
        "null": (None, "spans"),
        "broken": ('{"spans": [{"text": "x"', "spans"),
        "numbers": ("[1, 2]", "spans"),
        "blank": (json.dumps({"spans": [{"text": " "}]}), None),
    }
    table = spark.createDataFrame([(k, kind, raw) for k, (raw, kind) in answers.items()], "response_id string, kind string, raw string")
    found = {name: {r.response_id for r in rows.collect()} for name, rows in readers.model_response_tables(table).items()}
    assert found == {
        "spans": {"spans", "list", "after a list"},
        "cast": {"cast", "cast list", "ties"},
        "relationships": {"ties", "tie list"},
        "quarantine": {"other", "empty", "null", "broken", "numbers", "blank"},
    }
