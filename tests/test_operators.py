import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from legajo.functions import text as tx
from legajo.operators import calibration as ca
from legajo.operators import claimrules as cr
from legajo.operators import entities as en
from legajo.operators import integrity as it
from legajo.operators import pages as pg
from legajo.operators import statistics as st
from legajo.operators import stylometry as sy
from legajo.operators import topics as to
from legajo.operators import vectors as ve


def one(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normalisation_is_idempotent_and_composes(spark):
    raw = "•  Café\tcon le­che​  "
    first = one(spark, "t string", [(raw,), (None,)], tx.cleaned(F.col("t"), compose=True))
    assert first == [("Café con leche",), (None,)]
    assert one(spark, "t string", first, tx.cleaned(F.col("t"), compose=True)) == first


def test_numbers_and_quotes(spark):
    got = one(spark, "t string", [("1.234.567,8",), ("4,3",), ("15",), ("$294,5 billones",), ("",), (None,)], tx.spanish_number(F.col("t")))
    assert got == [(1234567.8,), (4.3,), (15.0,), (294.5,), (None,), (None,)]
    assert one(spark, "t string", [('Dijo «hola y ya», “ab” y "otra".',)], tx.quoted_spans(F.col("t")))[0][0] == ["hola y ya", "otra"]


def test_syllables(spark):
    words = {"casa": 2, "país": 2, "contraloría": 5, "gobierno": 3, "ciudad": 2, "pst": 1}
    assert dict(one(spark, "w string", [(w,) for w in words], "w", tx.syllables(F.col("w")))) == words


def test_phrases_share_separators(spark):
    assert one(spark, "t string", [("de la de la, DE LA; dela",)], tx.phrase_count(F.col("t"), ["de", "de la"]))[0][0] == 3
    assert one(spark, "t string", [("a causa de",)], tx.additive_count(F.col("t"), ["causa de", "a causa de"]))[0][0] == 2


def test_masked_dates_and_laws_are_no_quantities(spark):
    text = "El 7 de agosto de 2026 se aplicó la Ley 951 de 2005."
    assert one(spark, "t string", [(text,)], cr.main_quantity(F.col("t")))[0][0]["kind"] == ""
    cues = cr.cues(F.col("t"))
    hit = [k for k, v in zip(cues, one(spark, "t string", [(text,)], *cues.values())[0], strict=True) if v]
    assert hit == ["date", "law"]
    both = "Creció 4,5 % y costó $15,3 billones de pesos."
    q = one(spark, "t string", [(both,)], cr.main_quantity(F.col("t")))[0][0]
    assert (q["kind"], q["value"]) == ("money", 15.3)


def test_boxes(spark):
    boxes = [[0.0, 0.0, 10.0, 10.0], [0.0, 0.0, 9.5, 10.0], [20.0, 20.0, 25.0, 25.0], [8.0, 8.0, 18.0, 18.0]]
    kept = one(spark, "b array<array<double>>", [(boxes,)], pg.kept_boxes(F.col("b")))[0][0]
    assert sorted(kept) == sorted([boxes[0], boxes[2], boxes[3]])
    assert one(spark, "a array<double>, b array<double>", [(boxes[0], boxes[3])], pg.overlap_ratio(F.col("a"), F.col("b")))[0][0] == pytest.approx(0.04)


def test_joined_lines(spark):
    got = one(spark, "l array<string>", [(["El Regis- ", "tro de", "", "Co-", "Pago"],), ([],)], pg.joined_lines(F.col("l")))
    assert got == [("El Registro de Co- Pago",), ("",)]


def test_repeated_margins_need_three_pages(spark):
    rows = [("d", p, f"INFORME {p}") for p in (1, 2, 3)] + [("d", 1, "OTRA"), ("d", 2, "OTRA"), ("d", 2, None)]
    got = pg.repeated_margin_lines(spark.createDataFrame(rows, "document_id string, page int, text string")).collect()
    assert [(r["margin_key"], r["n_pages"]) for r in got] == [("INFORME #", 3)]


def test_integrity_rules(spark):
    claims = spark.createDataFrame([("C1", "supported"), ("C2", "unassessed")], "claim_id string, verification_status string")
    ledger = spark.createDataFrame([("S1", "commentary")], "source_id string, source_type string")
    evidence = spark.createDataFrame(
        [(1, "C9", "S1", "commentary", "2026-01-01", True, False, False), (2, "C2", "S9", "x", "", False, False, None), (3, None, "S1", "social_media", "d", True, None, None)],
        "evidence_id bigint, claim_id string, source_id string, source_type string, access_date string, supports boolean, contradicts boolean, contextualises boolean",
    )
    got = {(r["rule"], r["rec_id"]) for r in it.violations(claims, evidence, ledger).collect()}
    assert got == {
        ("claim unknown", "1"), ("source not in the ledger", "2"), ("source type differs from the ledger", "3"), ("assessed without evidence", "C1"),
        ("access date missing", "2"), ("neither supports nor contradicts nor contextualises", "2"),
    }
    with pytest.raises(ValueError, match="claim unknown"):
        it.assert_sound(claims, evidence, ledger)
    for refused in (it.assess_claim, it.register_source):
        with pytest.raises(NotImplementedError):
            refused("C1")
    assert it.require_columns(claims, ["claim_id", "x"]) == ["x"]


def test_moving_ttr_matches_brute_force(spark):
    rng = random.Random(5)
    docs = {k: [rng.choice("abcdefg") for _ in range(n)] for k, n in (("x", 3), ("y", 10), ("z", 77))}
    df = spark.createDataFrame([(k, i, t) for k, ts in docs.items() for i, t in enumerate(ts)], "k string, i int, token string")
    got = {r["k"]: r["mattr"] for r in st.moving_ttr(df, "k", ["i"], 10).collect()}
    for k, ts in docs.items():
        w = min(10, len(ts))
        want = np.mean([len(set(ts[i : i + w])) / w for i in range(len(ts) - w + 1)])
        assert got[k] == pytest.approx(want, abs=1e-6)


def test_acronyms(spark):
    rows = [("La Unidad Nacional de Protección (UNP) cerró.",), ("Según la Oficina (XYZ).",), (None,)]
    got = en.acronyms(spark.createDataFrame(rows, "text string")).collect()
    assert [(r["alias"], r["canonical"]) for r in got] == [("UNP", "Unidad Nacional de Protección")]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("s0", f"t{i}") for i in range(30)] + [("q", "q")]
    got = {r["node"]: r["component"] for r in en.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and {got[f"t{i}"] for i in range(30)} == {"s0"}


def test_components_of_whole_graphs_match_brute_force(spark, data):
    import __spark_entry__ as entry
    from legajo.session import table

    qs = entry.queries()
    pairs = table(spark, data, "lineitem").select("l_partkey", "l_suppkey").distinct().collect()
    graphs = {
        "supply_components": [(f"p{r[0]}", f"s{r[1]}") for r in pairs if None not in r],
        "entity_components": [(r["a"], r["b"]) for r in qs["entity_network"](spark, data).collect()],
    }
    for name, edges in graphs.items():
        near: dict[str, set[str]] = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        want: dict[str, str] = {}
        for node in sorted(near):
            todo = [node] if node not in want else []
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = node
                    todo += near[x]
        got = qs[name](spark, data).collect()
        assert len(got) == len(want) > 0 and {r["node"]: r["component"] for r in got} == want


def test_intervals():
    assert ca.proportion_interval(7, 144) == pytest.approx((0.01976, 0.09759), abs=1e-5)
    assert ca.proportion_interval(9, 144) == pytest.approx((0.02897, 0.11532), abs=1e-5)
    assert ca.proportion_interval(0, 10)[0] == 0.0 and ca.proportion_interval(10, 10)[1] == 1.0
    assert ca.expected_false_positives(40, 0.05, 0.05) == (0, 5)
    assert sy.chi2_quantile(0.975, 8) == pytest.approx(17.535, abs=1e-3)


def test_gate_refuses(spark):
    rows = [(0, 0.95, 0.04, 100, 100, 10, 4), (1, 0.95, 0.04, 10, 100, 10, 4), (2, 0.95, 0.04, 100, 100, 10, 1), (3, 0.5, 0.3, 100, 10, 10, 4),
            (4, None, 0.04, 100, 100, 10, 4), (5, float("nan"), 0.04, 100, 100, 10, 4)]
    metrics = spark.createDataFrame(rows, "i int, auc_low double, fpr double, n_neg long, n_pos long, n_groups long, n_makers long")
    got = {r["i"]: (r["status"], r["reasons"]) for r in ca.gated(metrics).collect()}
    assert got[0] == ("calibrated", [])
    assert got[1] == ("preliminary", ["n_neg 10 < 30"]) and got[2] == ("preliminary", ["n_makers 1 < 2"])
    assert got[3] == ("not_informative", ["auc_low 0.5 < 0.8", "fpr 0.3 > 0.1", "n_pos 10 < 30"])
    assert got[4] == ("not_informative", ["auc_low unknown < 0.8"]) and got[5][0] == "not_informative"
    assert ca.gated(metrics.limit(0)).count() == 0
    status = got[3][0]
    with pytest.raises(ValueError, match="not applied"):
        ca.applied(spark.createDataFrame([("a", 1.0)], "g string, s double"), "s", 0.5, status, "g")


def test_pairs_won_between_groups(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), f"g{rng.randint(0, 3)}", rng.randint(0, 40) / 4) for _ in range(300)]
    counts = spark.createDataFrame(rows, "y int, grp string, s double").groupBy("y", "grp", "s").agg(F.count(F.lit(1)).alias("n"))
    got = {(r["p"], r["q"]): r["u"] for r in ca._beaten(counts, "y", "grp", "s").collect()}
    want = {}
    for y, p, a in rows:
        for z, q, b in rows:
            if y == 1 and z == 0:
                want[p, q] = want.get((p, q), 0) + (1 if a > b else 0.5 if a == b else 0)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    empty = spark.createDataFrame([], "y int, grp string, s double")
    assert ca.bootstrap_auc(empty, "y", "s", "grp", 10).first()["replicates"] == 0


def test_held_out_rates_on_separated_classes(spark):
    rng = random.Random(7)
    rows = [(0, f"h{i % 8}", rng.gauss(0, 1)) for i in range(160)] + [(1, f"g{i % 8}", rng.gauss(4, 1)) for i in range(80)]
    df = ca.folds(spark.createDataFrame(rows, "y int, grp string, s double"), "grp", "y").cache()
    assert df.select("y", "grp", "fold").distinct().count() == 16
    r = ca.held_out_counts(df, ca.fold_thresholds(df, "y", "s"), "y", "s").first()
    assert r["fp"] / 160 <= 0.15 and r["tp"] / 80 > 0.9
    low, high = (ca.bootstrap_auc(df, "y", "s", "grp").first()[c] for c in ("low", "high"))
    assert 0.9 < low <= high <= 1


def test_logits():
    flat = sy.logit_scores(np.zeros((40, 50)), np.arange(40) % 50, np.zeros((40, 50)))
    assert flat["log_perplexity"] == pytest.approx(math.log(50)) and flat["ratio"] == pytest.approx(1)


def test_change_points_and_clusters():
    x = np.concatenate([np.zeros((10, 1)), np.full((8, 1), 5.0)]) + np.linspace(0, 0.1, 18)[:, None]
    assert sy.change_points(x, 1.0) == [10]
    assert sy.ward_clusters(x, 2) == [0] * 10 + [1] * 8


def test_divergence_and_units(spark):
    got = one(spark, "p array<double>, q array<double>", [([1.0, 0.0], [0.0, 1.0]), ([2.0, 2.0], [1.0, 1.0])], ve.divergence(F.col("p"), F.col("q")))
    assert got[0][0] == pytest.approx(1, abs=1e-6) and got[1][0] == pytest.approx(0, abs=1e-9)
    assert one(spark, "v array<double>", [([3.0, 4.0],), ([0.0, 0.0],)], ve.unit(F.col("v"))) == [([0.6, 0.8],), ([0.0, 0.0],)]


def test_very_long_words_and_names(spark):
    text = "x-" * 100_000 + " " + "Fondo Regional " * 20_000
    got = one(spark, "t string", [(text,)], tx.word_count(F.col("t"), "hyphenated"), tx.word_count(F.col("t"), "letters"))
    assert got == [(40_001, 140_000)]
    rows = spark.createDataFrame([("d", "p", 1, 1, "s", text)], "document_id string, paragraph_id string, sent_no int, page int, level2 string, text string")
    assert en.mentions(rows).where("entity_type = 'NAME'").count() == 1


def test_every_document_enters_the_topics(spark):
    rng = random.Random(3)
    docs = {f"d{i}": [rng.choice(["pan", "sal", "mar"] if i % 2 else ["ley", "voto", "juez"]) for _ in range(12)] for i in range(40)}
    tokens = spark.createDataFrame([(k, t) for k, ts in docs.items() for t in ts], "d string, token string")
    vectors, words = to.counted(tokens, "d", most_share=0.9)
    got, model = to.lda(vectors, "d", 2)
    counts = {w: sum(ts.count(w) for ts in docs.values()) for w in words}
    assert dict(zip(words, model.topicsMatrix().toArray().sum(axis=1), strict=True)) == pytest.approx({w: n + 2 * 0.01 for w, n in counts.items()}, rel=1e-6)
    topic = {r["d"]: r["topic"] for r in got.collect()}
    assert len(topic) == 40 and len({(k, int(d[1:]) % 2) for d, k in topic.items()}) == 2


def test_vocabulary_is_not_capped(spark):
    words = spark.range(3 * 20_500).select((F.col("id") % 3).cast("string").alias("d"), F.concat(F.lit("t"), F.floor(F.col("id") / 3)).alias("token"))
    others = spark.range(3, 8).select(F.col("id").cast("string").alias("d"), F.lit("x").alias("token"))
    assert len(to.counted(words.unionByName(others), "d")[1]) == 20_500


def test_factorisation_runs_until_the_error_stops_falling(spark):
    rng = np.random.default_rng(1)
    u = np.repeat(np.eye(2), 6, axis=0) * rng.uniform(1, 3, (12, 1)) + 0.3
    x = u @ rng.uniform(0, 1, (2, 9))
    rows = spark.createDataFrame([(f"d{i:02d}", f"t{j}", float(x[i, j])) for i in range(12) for j in range(9)], "d string, token string, w double")
    topic = {r["d"]: r["topic"] for r in to.nmf(rows, "d", 2).collect()}
    assert len(topic) == 12 and len({(topic[f"d{i:02d}"], i // 6) for i in range(12)}) == 2
    with pytest.raises(RuntimeError, match="still improves"):
        to.nmf(rows, "d", 2, rounds=2)


def test_both_factorisations_agree(spark):
    rng = np.random.default_rng(4)
    x = np.kron(np.eye(3), np.ones((5, 4))) * rng.uniform(0.5, 1.5, (15, 12))
    rows = spark.createDataFrame([(i, f"t{j:02d}", float(x[i, j])) for i in range(15) for j in range(12) if x[i, j] > 0], "d int, token string, w double")
    for held in (10_000, 5):  # the factor of the terms in memory, and distributed
        topic = {r["d"]: r["topic"] for r in to.nmf(rows, "d", 3, held=held).collect()}
        assert len(topic) == 15 and len({(topic[i], i // 5) for i in range(15)}) == 3
    assert to.nmf(rows.limit(0), "d", 3).count() == 0


def test_sweep_and_examples(spark):
    got = to.sweep(lambda k: k, [6, 7, 8], lambda k: -abs(k - 7)).collect()
    assert [r["k"] for r in got] == [7, 6, 8]
    assigned = spark.createDataFrame([("a", 0, 0.5), ("b", 0, 0.5), ("c", 0, 0.9), ("d", 1, None)], "p string, topic int, weight double")
    texts = spark.createDataFrame([("a", "x" * 300), ("b", None), ("c", "y")], "p string, t string")
    rows = {(r["topic"], r["rank"]): (r["p"], r["excerpt"]) for r in to.topic_examples(assigned, texts, "p", "t", 2).collect()}
    assert rows == {(0, 1): ("c", "y"), (0, 2): ("a", "x" * 200), (1, 1): ("d", None)}
