"""Rules of records, statements and ids, one case each."""

import random

import pytest
from pyspark.sql import functions as F

from legajo.operators import claimrules as cr, integrity as it, pages as pg
from legajo.operators.ordered import numbered, runs

CLAIM = "claim_id string, sentence_id string, claim_text string"
ASSESSED = "claim_id string, assessment string, sentence_id string, claim_text_prefix string, robustness string"
EVIDENCE = "claim_id string, source_id string, source_type string, access_date string, supports boolean, contradicts boolean, contextualises boolean"


@pytest.fixture(scope="module")
def sound(spark):
    claims = spark.createDataFrame([("C1", "S1", "El gasto subió."), ("C2", "S2", "La obra cayó.")], CLAIM)
    ledger = spark.createDataFrame([("S9", "legislation"), ("S8", "coverage_of_audited_document")], "source_id string, source_type string")
    return claims, ledger


def rules(spark, sound, assessments, evidence):
    claims, ledger = sound
    got = it.problems(claims, spark.createDataFrame(evidence, EVIDENCE), spark.createDataFrame(assessments, ASSESSED), ledger)
    return {(r["rule"], r["rec_id"]) for r in got.collect()}


GOOD = ("C1", "supported", "S1", "El gasto", "robust")
PROOF = ("C1", "S9", "legislation", "2024-01-01", True, False, None)


def test_sound_records_have_no_problem(spark, sound):
    assert rules(spark, sound, [GOOD, GOOD, ("C1", "supported", None, None, None)], [PROOF]) == set()
    assert rules(spark, sound, [], []) == set()


@pytest.mark.parametrize(
    ("assessment", "proof", "want"),
    [
        (("C1", "perhaps", "S1", "El gasto", ""), PROOF, ("invalid assessment", "C1")),
        (("C1", None, "S1", "El gasto", ""), PROOF, ("invalid assessment", "C1")),
        (("C7", "supported", None, None, ""), PROOF, ("claim unknown", "C7")),
        (("C1", "supported", "S5", "El gasto", ""), PROOF, ("sentence drifted", "C1")),
        (("C1", "supported", "S1", "La obra", ""), PROOF, ("text drifted", "C1")),
        (("C2", "supported", "S2", "La obra", ""), PROOF, ("no evidence", "C2")),
        (GOOD, ("C1", "S9", "audited_document", "2024-01-01", True, False, None), ("no evidence from outside", "C1")),
        (("C1", "supported", "S1", "El gasto", "very"), PROOF, ("invalid robustness", "C1")),
        (GOOD, ("C1", "S5", "legislation", "2024-01-01", True, False, None), ("source not in the ledger", "C1/S5")),
        (GOOD, ("C1", "S8", "legislation", "2024-01-01", True, False, None), ("circular source", "C1/S8")),
        (GOOD, ("C1", "S9", "legislation", None, True, False, None), ("access date missing", "C1/S9")),
        (GOOD, ("C1", "S9", "legislation", "2024-01-01", None, False, None), ("says nothing", "C1/S9")),
    ],
)
def test_each_rule(spark, sound, assessment, proof, want):
    assert rules(spark, sound, [assessment], [proof]) == {want}


def test_missing_columns_are_told(spark, sound):
    claims, ledger = sound
    got = it.problems(claims, spark.createDataFrame([("C1",)], "claim_id string"), spark.createDataFrame([("C1",)], "claim_id string"), ledger).collect()
    assert ("missing column", "assessments", "assessment") in {tuple(r) for r in got} and len(got) == 7


def test_pins_find_their_claims(spark, sound):
    pins = spark.createDataFrame([("C5", "El"), ("C6", "La obra c"), ("C7", "Nada"), ("C8", None), ("C9", "")], "claim_id string, claim_text_prefix string")
    assert {r["claim_id"]: r["new_claim_id"] for r in it.repinned(pins, sound[0]).collect()} == {"C5": "C1", "C6": "C2", "C7": None, "C8": None, "C9": None}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("El plan costó $294,5 billones en total.", ("money", "COP billones", 294.5e12)),
        ("Se giraron US$ 15,3 mil millones.", ("money", "USD mil millones", 15.3e9)),
        ("La tasa subió 4,3 % este año.", ("percent", "%", None)),
        ("Hay 2.500 millones de usuarios.", ("count", "millones usuarios", 2.5e9)),
        ("Llegaron 15 camiones el 7 de agosto de 2022.", ("count", "camiones", 15.0)),
        ("La Ley 951 de 2005 rige.", ("", "", None)),
        ("", ("", "", None)),
    ],
)
def test_quantities_with_units(spark, text, want):
    q = spark.createDataFrame([(text,)], "text string").select(cr.quantity(F.col("text")).alias("q")).first()["q"]
    assert (q["kind"], q["unit"], q["base"]) == want


def test_claim_types(spark):
    rows = [("El hospital y los pacientes.", "", "salud", "keywords"), ("La salud y la obra.", "Vivienda", "infraestructura", "keywords+section"),
            ("La salud y la obra.", None, "salud", "keywords(tie)"), ("Nada de nada.", "III. Minas", "energia", "section"), ("Nada.", None, "otros", "default")]
    df = spark.createDataFrame(rows, "t string, s string, k string, r string")
    for r in df.select("*", cr.claim_type(F.col("t"), F.col("s")).alias("c")).collect():
        assert (r["c"]["type"], r["c"]["rule"]) == (r["k"], r["r"])


def test_candidates(spark):
    rows = [(1, "El gasto subió a $5 millones en agosto de 2022 por culpa de la crisis.", "s"), (2, "Fue una negligencia y un grave abandono de todos los deberes.", "s"),
            (3, "Nada se dijo de todo lo demás aquí.", "s"), (4, None, None), (5, "", "")]
    got = {r["i"]: r for r in cr.candidates(spark.createDataFrame(rows, "i int, text string, section string")).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["claim_kind"], got[1]["verifiable"], got[1]["is_causal"], got[1]["quantity_base"]) == ("factual_candidate", "yes_candidate", True, 5e6)
    assert (got[2]["claim_kind"], got[2]["verifiable"], got[2]["quantity_base"]) == ("evaluative_candidate", "no_candidate", None)
    assert cr.numeric_claims(cr.candidates(spark.createDataFrame(rows, "i int, text string, section string"))).count() == 1


def test_ids_follow_the_order(spark):
    values = random.Random(2).sample(range(10_000), 3_000)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = {r["v"]: r["id"] for r in numbered(df, "id", ["v"], "C%04d").collect()}
    assert got == {v: f"C{i:04d}" for i, v in enumerate(sorted(values), 1)}
    assert numbered(df.limit(0), "id", ["v"]).count() == 0


def test_runs_break_at_changes(spark):
    rows = [("d", 0, 0, "a"), ("d", 0, 1, "a"), ("d", 1, 2, "b"), ("d", 1, 3, None), ("d", 2, 4, None), ("d", 2, 5, "a"), ("e", 0, 0, None)]
    df = spark.createDataFrame(rows, "g string, chunk int, i int, c string")
    got = {(r["g"], r["i"]): r["run"] for r in runs(df, "c", "run", ["g"], "chunk", ["i"]).collect()}
    assert got == {("d", 0): 1, ("d", 1): 1, ("d", 2): 2, ("d", 3): 3, ("d", 4): 3, ("d", 5): 4, ("e", 0): 0}


def test_chapters_of_pages(spark):
    pages = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3), (None, 1)], "document_id string, page int")
    rows = [("d", 1, 1, "b"), ("d", 1, 1, "a"), ("d", 1, 2, "b"), ("d", 3, 3, None)]
    paragraphs = spark.createDataFrame(rows, "document_id string, page int, page_end int, chapter string")
    got = {(r["document_id"], r["page"]): r["chapter"] for r in pg.page_chapters(pages, paragraphs).collect()}
    assert got == {("d", 1): "b", ("d", 2): "b", ("d", 3): "none", (None, 1): "none"}
