"""Calibration of binary scores: areas with intervals, thresholds by grouped folds, slices, a gate, and its use."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.operators.ranks import auc
from legajo.session import checkpointed, small_lookup

#: Bounds that a score must keep to be used (fixed values): of the area's interval, of held-out false positives, of the rows of
#: both classes, of the groups and of the makers of the positive class; and the false positives a threshold aims at.
AUC_LOW, FPR_HIGH, LEAST_ROWS, LEAST_GROUPS, LEAST_MAKERS, TARGET_FPR = 0.80, 0.10, 30, 5, 2, 0.05


def folds(df: DataFrame, group: str, label: str, k: int = 5) -> DataFrame:
    """df with fold: every k-th of the sorted groups of each class, so that a group is never on both sides."""
    groups = df.select(label, group).distinct()  # one row for each group and class
    order = Window.partitionBy(label).orderBy(group)
    return df.join(groups.select(label, group, F.pmod(F.row_number().over(order) - 1, F.lit(k)).alias("fold")), [label, group])


def fold_thresholds(df: DataFrame, label: str, score: str, target: float = TARGET_FPR, k: int = 5) -> DataFrame:
    """fold and threshold: the (1 - target) quantile of the negative scores outside the fold.

    The exact quantile needs the scores of one class in order; they are counted by value first.
    """
    negative = df.where(F.col(label) == 0).groupBy("fold", score).agg(F.count(F.lit(1)).alias("n"))
    others = negative.withColumn("out", F.explode(F.array([F.lit(i) for i in range(k)]))).where("out <> fold")
    return others.groupBy(F.col("out").alias("fold")).agg(F.percentile(score, F.lit(1 - target), F.col("n")).alias("threshold"))


def held_out_counts(df: DataFrame, thresholds: DataFrame, label: str, score: str) -> DataFrame:
    """One row: tp, fp, tn, fn of the held-out rows of all folds."""
    joined = df.join(F.broadcast(thresholds), "fold")  # one row for each fold
    above, positive = F.col(score) > F.col("threshold"), F.col(label) == 1
    return joined.agg(
        F.count_if(above & positive).alias("tp"), F.count_if(above & ~positive).alias("fp"),
        F.count_if(~above & ~positive).alias("tn"), F.count_if(~above & positive).alias("fn"),
    )


def sliced_auc(df: DataFrame, label: str, score: str, slices: dict[str, Column], least: int = 5) -> DataFrame:
    """slice, n_neg, n_pos, auc of all rows and of each slice (rows may lie in several): slices of fewer than ``least`` rows of
    a class are left out. ``slices`` maps a kind to a column with the name of the slice or null."""
    names = F.array(F.lit("all"), *[F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in slices.items()])
    rows = df.select(F.explode(F.filter(names, lambda n: n.isNotNull())).alias("slice"), label, score)
    return auc(rows, label, score, ["slice"]).where((F.col("n_pos") >= least) & (F.col("n_neg") >= least))


def bootstrap_auc(df: DataFrame, label: str, score: str, group: str, replicates: int = 2_000, seed: int = 7) -> DataFrame:
    """One row: low and high of the 95 % interval of the area, whole groups of each class drawn with replacement.

    A group's draws in a replicate follow a Poisson law with mean 1, decided by a hash of replicate and group: no group list
    is gathered, and a repeated task draws the same.
    """
    u = (F.pmod(F.xxhash64("replicate", label, group, F.lit(seed)), F.lit(1_000_000)) + 0.5) / 1_000_000
    limits, p, total = [], math.exp(-1), 0.0
    for i in range(8):
        total += p
        limits.append(total)
        p /= i + 1
    draws = F.lit(0)
    for limit in limits:
        draws = draws + F.when(u > limit, 1).otherwise(0)
    # The area is a sum over pairs of groups, so that the scores are walked once and a replicate only weighs the pairs. The
    # pairs of a score with all lower negative scores are counted by its place: counts of groups below, then inside a bucket.
    df = df.where(F.col(score).isNotNull() & F.col(group).isNotNull())  # rows without a group can not be drawn
    counts = checkpointed(df.groupBy(label, group, score).agg(F.count(F.lit(1)).alias("n")))  # the scores are computed once
    pairs = checkpointed(_beaten(counts, label, group, score))  # groups x groups
    sizes = counts.groupBy(label, group).agg(F.sum("n").alias("n"))
    numbered = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    drawn = sizes.select(label, group, "n", numbered).withColumn("w", draws).where("w > 0")
    totals = drawn.groupBy("replicate").agg(
        F.sum(F.when(F.col(label) == 1, F.col("w") * F.col("n")).otherwise(0)).alias("np"), F.sum(F.when(F.col(label) == 0, F.col("w") * F.col("n")).otherwise(0)).alias("nn")
    )
    positive = drawn.where(F.col(label) == 1).select("replicate", F.col(group).alias("p"), F.col("w").alias("wp"))
    negative = drawn.where(F.col(label) == 0).select("replicate", F.col(group).alias("q"), F.col("w").alias("wq"))
    won = pairs.join(positive, "p").join(negative, ["q", "replicate"]).groupBy("replicate").agg(F.sum(F.col("u") * F.col("wp") * F.col("wq")).alias("u"))
    sums = totals.join(won, "replicate", "left").withColumn("u", F.coalesce("u", F.lit(0.0)))
    area = F.col("u") / (F.col("np") * F.col("nn"))
    areas = sums.where("np > 0 and nn > 0").select(area.alias("a"))
    return areas.agg(F.percentile("a", F.lit(0.025)).alias("low"), F.percentile("a", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("replicates"))


def _beaten(counts: DataFrame, label: str, group: str, score: str) -> DataFrame:
    """p, q and u for each pair of a positive and a negative group: how often p's score is higher, ties by half.

    Scores lie in buckets between sampled quantiles (any bounds give the same result); below its own bucket a score has won
    against all, inside it pairs of scores are compared in one sorted walk that holds one count for each negative group.
    """
    bounds = sorted(set(counts.approxQuantile(score, [i / 64 for i in range(1, 64)], 0.01)))
    bucket = F.lit(0)
    for x in bounds:
        bucket = bucket + (F.col(score) > x).cast("int")
    placed = counts.withColumn("bucket", bucket)
    wins = placed.where(F.col(label) == 1).groupBy("bucket", F.col(group).alias("p")).agg(F.sum("n").alias("np"))
    losses = placed.where(F.col(label) == 0).groupBy("bucket", F.col(group).alias("q")).agg(F.sum("n").alias("nq"))
    upwards = losses.withColumn("above", F.explode(F.sequence(F.col("bucket") + 1, F.lit(len(bounds) + 1))))
    lower = upwards.groupBy(F.col("above").alias("bucket"), "q").agg(F.sum("nq").alias("nq"))
    between = wins.join(lower, "bucket").groupBy("p", "q").agg(F.sum((F.col("np") * F.col("nq")).cast("double")).alias("u"))

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        below: dict = {}
        equal: dict = {}
        waiting: list = []
        found: Counter = Counter()
        now = None

        def settle() -> None:
            for p, n in waiting:
                for q, k in below.items():
                    found[p, q] += n * k
                for q, k in equal.items():
                    found[p, q] += n * k / 2
            for q, k in equal.items():
                below[q] = below.get(q, 0) + k
            equal.clear()
            waiting.clear()

        for b in batches:
            for place, y, g, x, n in zip(b["bucket"], b["y"], b["g"], b["x"], b["n"], strict=True):
                if now is not None and (place, x) != now:
                    settle()
                    if place != now[0]:
                        below.clear()
                now = place, x
                if y == 1:
                    waiting.append((g, n))
                else:
                    equal[g] = equal.get(g, 0) + n
            yield pd.DataFrame([], columns=["p", "q", "u"])
        settle()
        yield pd.DataFrame([(p, q, float(u)) for (p, q), u in found.items()], columns=["p", "q", "u"])

    kind = counts.schema[group].dataType.simpleString()
    rows = placed.select("bucket", F.col(label).alias("y"), F.col(group).alias("g"), F.col(score).alias("x"), "n")
    within = rows.repartition("bucket").sortWithinPartitions("bucket", "x").mapInPandas(inside, f"p {kind}, q {kind}, u double")
    return between.unionByName(within).groupBy("p", "q").agg(F.sum("u").alias("u"))


def oriented(value: Column, sign: float) -> Column:
    """A score turned so that higher means more alike the positive class; null where it is not finite."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(sign) * value)


def gated(metrics: DataFrame) -> DataFrame:
    """``metrics`` (one row for each score: auc_low, fpr, n_neg, n_pos, n_groups, n_makers) with reasons and status.

    ``not_informative`` if the score does not separate or errs too often (also where that is not known), ``preliminary`` if it
    does but rests on few data, else ``calibrated``. Reasons name every bound that is broken, in the order of the bounds.
    """

    def broken(column: str, bad: Column, bound: float, sign: str) -> Column:
        shown = F.coalesce(F.round(column, 4).cast("string"), F.lit("unknown"))
        return F.when(F.coalesce(bad, F.lit(True)), F.concat(F.lit(f"{column} "), shown, F.lit(f" {sign} {bound:g}")))

    separates = [broken("auc_low", (F.col("auc_low") < AUC_LOW) | F.isnan("auc_low"), AUC_LOW, "<"), broken("fpr", F.col("fpr") > FPR_HIGH, FPR_HIGH, ">")]
    enough = [
        broken(column, F.col(column) < least, least, "<")
        for column, least in (("n_neg", LEAST_ROWS), ("n_pos", LEAST_ROWS), ("n_groups", LEAST_GROUPS), ("n_makers", LEAST_MAKERS))
    ]
    status = F.when(F.coalesce(*separates).isNotNull(), "not_informative").when(F.coalesce(*enough).isNotNull(), "preliminary").otherwise("calibrated")
    return metrics.withColumn("reasons", F.array_compact(F.array(*separates, *enough))).withColumn("status", status)


def applied(df: DataFrame, score: str, threshold: float, status: str, by: str) -> DataFrame:
    """``by`` (null for all rows), n and n_above; refuses a score that did not pass the gate."""
    if status not in ("calibrated", "preliminary"):
        raise ValueError(f"a score with status {status!r} is not applied")
    return df.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(score) > threshold).alias("n_above"), F.grouping(by).cast("int").alias("is_total"))


def _binomial_cdf(k: int, n: int, p: float) -> float:
    if k < 0:
        return 0.0
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    log_p, log_q = math.log(p), math.log1p(-p)
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q) for i in range(k + 1))


def proportion_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson interval of k of n, by bisection of the binomial distribution."""
    tail = (1 - level) / 2

    def solve(f) -> float:
        low, high = 0.0, 1.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) else (low, mid)
        return (low + high) / 2

    lower = 0.0 if k == 0 else solve(lambda p: 1 - _binomial_cdf(k - 1, n, p) < tail)
    upper = 1.0 if k == n else solve(lambda p: _binomial_cdf(k, n, p) > tail)
    return lower, upper


def binomial_quantile(q: float, n: int, p: float) -> int:
    """The least k with P(X <= k) >= q."""
    low, high = 0, n
    while low < high:
        mid = (low + high) // 2
        if _binomial_cdf(mid, n, p) >= q:
            high = mid
        else:
            low = mid + 1
    return low


def expected_false_positives(n: int, low: float, high: float) -> tuple[int, int]:
    return binomial_quantile(0.025, n, low), binomial_quantile(0.975, n, high)


def wording(name: str, status: str, reasons: list[str], n: int, above: int, expected: tuple[int, int]) -> str:
    """A plain result; it never says who wrote what."""
    if status == "not_informative":
        return f"{name}: does not separate the control classes reliably ({'; '.join(reasons)}); not applied."
    return f"{name} ({status}): {above} of {n} lie above the threshold; {expected[0]} to {expected[1]} would be expected of the negative class alone."


def first_row(df: DataFrame) -> dict:
    return small_lookup(df, 1)[0].asDict()
