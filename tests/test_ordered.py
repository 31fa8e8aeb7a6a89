import random

import pandas as pd
from pyspark.sql import functions as F

from legajo.operators import ordered, ranks


def rows(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice("ab"), i // 13, i, rng.choice([None, 0, 3, 40, 90]), rng.choice([None, "x", "y"])) for i in range(n)]


def test_greedy_segments_match_a_walk(spark):
    data = rows(1)
    df = spark.createDataFrame(data, "g string, page int, i int, w int, v string")
    got = {(r["g"], r["i"]): r["segment"] for r in ordered.greedy_segments(df, "w", 100, ["g"], "page", ["i"]).collect()}
    for g in "ab":
        carry, segment = 0, 1
        for _, _, i, w, _ in (r for r in data if r[0] == g):
            assert got[(g, i)] == segment
            carry += w or 0
            if carry >= 100:
                carry, segment = 0, segment + 1


def test_carry_and_sum_and_previous(spark):
    data = rows(2)
    df = spark.createDataFrame(data, "g string, page int, i int, w int, v string")
    out = ordered.carried_forward(df, F.col("v"), "last", ["g"], "page", ["i"])
    out = ordered.running_sum(out, F.coalesce("w", F.lit(0)), "total", ["g"], "page", ["i"])
    out = ordered.previous(out, ["w"], ["g"], "page", ["i"])
    p = pd.DataFrame(data, columns=["g", "page", "i", "w", "v"]).sort_values(["g", "i"])
    p["last"] = p.groupby("g").v.ffill()
    p["total"] = p.w.fillna(0).groupby(p.g).cumsum()
    p["prev"] = p.groupby("g").w.shift()
    want = {(r.g, r.i): (r.last if isinstance(r.last, str) else None, int(r.total), None if pd.isna(r.prev) else int(r.prev)) for r in p.itertuples()}
    assert {(r["g"], r["i"]): (r["last"], r["total"], r["prev_w"]) for r in out.collect()} == want


def test_ranks_and_auc_with_ties(spark):
    rng = random.Random(3)
    data = [(i, rng.randint(0, 1), float(rng.randint(0, 20))) for i in range(300)]
    df = spark.createDataFrame(data, "i int, y int, s double")
    want = pd.Series([d[2] for d in data]).rank(method="average")
    got = {r["i"]: r["avg_rank"] for r in ranks.average_ranks(df, "s").collect()}
    assert all(got[i] == want[i] for i in range(300))
    pos, neg = [s for _, y, s in data if y], [s for _, y, s in data if not y]
    area = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(ranks.auc(df, "y", "s").first()["auc"] - area) < 1e-12
    last = ranks.roc_points(df, "y", "s").orderBy("threshold").first()
    assert (last["tp"], last["fp"]) == (len(pos), len(neg))


def test_rank_of_nulls_and_one_class(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, 2.0)], "i int, y int, s double")
    assert {r["i"]: r["avg_rank"] for r in ranks.average_ranks(df, "s").collect()} == {1: None, 2: 1.0}
    assert ranks.auc(df, "y", "s").first()["auc"] is None
