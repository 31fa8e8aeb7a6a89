import pytest
from pyspark.sql import functions as F

from legajo.operators.packed import packed_found, packed_values, unpack

CASES = [
    ('"dice ""cerca de""";serie', ['dice "cerca de"', "serie"]),
    ("['a', 'b, c']", ["a", "b, c"]),
    ('["dice \\"cerca\\""]', ['dice "cerca"']),
    ("['dice \"cerca de\"', 'x']", ['dice "cerca de"', "x"]),
    ("\"cita 'de oídas'\", 'x'", ["cita 'de oídas'", "x"]),
    ("“a; b” / c", ["a; b", "c"]),
    ("difiere 1,2 puntos,a", ["difiere 1,2 puntos", "a"]),
    ("S1, S2 y S3", ["S1", "S2", "S3"]),
    ("• a\n• b", ["a", "b"]),
    ("a;; a ;", ["a", "a"]),
    ("obra/servicio", ["obra/servicio"]),
    ("O'Neill; d'art", ["O'Neill", "d'art"]),
    ("", []),
    ('""', []),
    ("[]", []),
    (None, None),
]


def test_values(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, c string")
    got = {r["i"]: r["v"] for r in df.select("i", packed_values(F.col("c")).alias("v")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i] == want, text


def test_long_field(spark):
    text = ";".join(f"'valor {i}'" for i in range(20_000))
    row = spark.createDataFrame([(text,), ("x" * 500_000,)], "c string").select(F.size(packed_values(F.col("c"))).alias("n")).collect()
    assert sorted(r["n"] for r in row) == [1, 20_000]


def test_positions_and_clashing_columns(spark):
    df = spark.createDataFrame([("k", "a;b", "z"), ("k", "a;b", "z")], "id string, f string, pos string")
    rows = unpack(df, {"id": F.col("id")}, ["f"]).distinct().collect()
    assert sorted((r["pos"], r["val"]) for r in rows) == [(1, "a"), (2, "b")]


def test_empty_tables(spark):
    claims = spark.createDataFrame([], "claim_id string, cues string, evidence_source_ids string, context_flags string")
    ledger = spark.createDataFrame([], "source_id string, claim_ids string")
    assert packed_found(claims, ledger).count() == 0


def test_missing_column_is_named(spark):
    with pytest.raises(Exception, match="claim_ids"):
        packed_found(spark.createDataFrame([], "claim_id string, cues string, evidence_source_ids string, context_flags string"), spark.createDataFrame([], "source_id string")).count()
