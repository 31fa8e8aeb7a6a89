import hashlib
import json

import pytest
from pyspark.sql import functions as F

from legajo.sources import providers, tables
from legajo.streaming import incremental


def test_lines_and_missing_files(spark, tmp_path):
    path = str(tmp_path / "a")
    tables.write_lines(spark.createDataFrame([(1, None), (2, "x")], "i int, t string"), path)
    assert sorted(tuple(r) for r in tables.read_lines(spark, path, "i int, t string").collect()) == [(1, None), (2, "x")]
    assert tables.read_lines(spark, str(tmp_path / "none*.jsonl"), "i int").count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_parquet(spark, str(tmp_path / "none"))


def test_pages(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps({"page_number": 1, "blocks": [{"block_id": 0, "lines": [{"text": "a", "size": 9.5}]}]}) + "\n")
    row = tables.read_pages(spark, str(tmp_path / "p.jsonl")).first()
    assert row["blocks"][0]["lines"][0]["text"] == "a" and row["tables"] is None


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 'dice "x", y', ["1", "2"]), (None, "é", [])], "p string, q string, r array<string>")
    assert tables.write_csv(df, str(tmp_path / "c")) == 2
    got = {(r["p"], r["q"], r["r"]) for r in tables.read_csv(spark, str(tmp_path / "c")).collect()}
    assert got == {("a\nb", 'dice "x", y', "1;2"), (None, "é", None)}


def test_checked_file_and_manifest(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    assert bytes(tables.checked_file(spark, str(tmp_path / "f.bin"), good).first()["content"]) == b"abc"
    with pytest.raises(Exception, match="hash"):
        tables.checked_file(spark, str(tmp_path / "f.bin"), "0" * 64).collect()
    assert [(r["file"], r["sha256"]) for r in tables.manifest(spark, {"x": str(tmp_path)}).collect()] == [("f.bin", good)]


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert tables.append_new(df, str(tmp_path / "t"), ["k"]) == 2
    assert tables.append_new(df, str(tmp_path / "t"), ["k"]) == 0


def test_graph_files():
    nodes, edges = [{"id": "a&b", "n": 2, "public": True}, {"id": "c", "n": 1, "public": False}], [{"source": "a&b", "target": "c", "weight": 1.5}]
    xml = tables.graphml(nodes, edges)
    assert 'id="a&amp;b"' in xml and ">true<" in xml and 'attr.type="double"' in xml
    assert json.loads(tables.node_link(nodes, edges))["links"][0]["weight"] == 1.5


def test_providers_say_what_they_used(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k int, t string")
    assert {tuple(r) for r in providers.scored(df, "k", "t", "sentiment").collect()} == {(1, None, "none"), (2, None, "none")}
    v = providers.hashed_vectors(df.select("k", F.split("t", " ").alias("w")), "k", "w", 16).collect()
    assert len(v) == 1 and abs(sum(x * x for x in v[0]["vector"]) - 1) < 1e-9


def test_stream(spark, tmp_path, data):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    spark.read.parquet(f"{data}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("at", F.col("ts").cast("timestamp"))
    q = incremental.append_to(incremental.first_deliveries(stream, ["event_id"], "at"), str(tmp_path / "out"), ["event_id"], str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{data}/events.parquet").select("event_id").distinct().count()
    counts = incremental.windowed_counts(stream, "at", ["event_type"], "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()
