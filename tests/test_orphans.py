from datetime import datetime

from pyspark.sql import functions as F

from legajo.operators.orphans import canonical_key, orphan_report, orphans_found

T = [datetime(2026, m, 1) for m in range(1, 8)]


def tables(spark):
    claims = spark.createDataFrame(
        [("C00000001", None, T[0]), ("C00000001", None, T[4]), ("C00000002", None, T[3]), ("C00000003", T[1], T[0]), (None, None, T[0])],
        "claim_id string, deleted_at timestamp, loaded_at timestamp",
    )
    evidence = spark.createDataFrame(
        [
            (1, "C1", "s-00000001", T[1]), (1, "C1", "s-00000001", T[5]), (2, "C00000002", "S00000001", T[1]), (3, " c00000003 ", None, T[1]),
            (4, "C00000003", "S00000001", T[0]), (5, "K7", "S9", T[2]), (6, None, "", T[2]), (7, "CO000001", "S00000001", None),
        ],
        "evidence_id bigint, claim_id string, source_id string, loaded_at timestamp",
    )
    ledger = spark.createDataFrame(
        [("S00000001", "C00000001; C00000099,C00000099", None, T[0])], "source_id string, claim_ids string, deleted_at timestamp, loaded_at timestamp"
    )
    return claims, evidence, ledger


def test_kinds(spark):
    got = {(r["tab"], r["rec_id"], r["fld"], r["ref_key"], r["kind"], r["period"]) for r in orphans_found(*tables(spark)).collect()}
    assert got == {
        ("evidence", "2", "claim_id", "C00000002", "late", "2026-02"),
        ("evidence", "3", "claim_id", "C00000003", "deleted", "2026-02"),
        ("evidence", "5", "claim_id", "K7", "missing", "2026-03"),
        ("evidence", "5", "source_id", "S00000009", "missing", "2026-03"),
        ("evidence", "7", "claim_id", "CO000001", "missing", None),
        ("ledger", "S00000001", "claim_ids", "C00000099", "missing", "2026-01"),
    }


def test_report_sums(spark):
    rows = orphan_report(orphans_found(*tables(spark))).collect()
    assert sum(r["n_refs"] for r in rows) == 6


def test_keys(spark):
    cases = {"c-12": "C00000012", " S00000001": "S00000001", "C000000000123": "C00000123", "C123456789": "C123456789", "K1": "K1", "CO1": "CO1", "": None, "C0": "C00000000"}
    df = spark.createDataFrame([(k,) for k in cases], "k string").select("k", canonical_key(F.col("k")).alias("v"))
    assert {r["k"]: r["v"] for r in df.collect()} == cases


def test_empty(spark):
    claims, evidence, ledger = (t.limit(0) for t in tables(spark))
    assert orphans_found(claims, evidence, ledger).count() == 0
