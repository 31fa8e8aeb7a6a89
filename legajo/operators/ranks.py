"""Order statistics of whole tables without a window over one partition.

A global order is cut into buckets by value bounds (approximate quantiles, so that buckets are even); counts of the buckets
before are added to what a window inside the bucket finds. A value lies in one bucket, whatever task computes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def bounds(df: DataFrame, value: str, buckets: int = BUCKETS) -> list[float]:
    """Upper bounds of the buckets; they steer only the distribution, not the result."""
    marks = df.stat.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.005) if buckets > 1 else []
    return sorted(set(marks))


def bucket_of(value: Column, marks: list[float]) -> Column:
    if not marks:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(m)) for m in marks]), lambda m: m < value))


def running_totals(counts: DataFrame, value: str, amounts: list[str], by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """For rows with a unique ``value`` (per ``by``), add <amount>_before: the sum over all smaller (or larger) values."""
    by = by or []
    marks = bounds(counts, value)
    cut = counts.withColumn("_bucket", bucket_of(F.col(value), marks))
    totals = cut.groupBy(*by, "_bucket").agg(*[F.sum(a).alias(f"_{a}") for a in amounts])
    step = F.col("_bucket").desc() if descending else F.col("_bucket")
    earlier = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows a group
    offsets = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_{a}").over(earlier), F.lit(0)).alias(f"_{a}_base") for a in amounts])
    order = F.col(value).desc() if descending else F.col(value)
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(F.broadcast(offsets) if not by else offsets, [*by, "_bucket"])
    out = joined.select(
        *counts.columns,
        *[(F.coalesce(F.sum(a).over(inside), F.lit(0)) + F.col(f"_{a}_base")).alias(f"{a}_before") for a in amounts],
    )
    return out


def average_ranks(df: DataFrame, value: str, out: str = "avg_rank") -> DataFrame:
    """Ranks of all rows by ``value``, ties sharing their average rank. Null values get a null rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, value, ["n"]).select(value, (F.col("n_before") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranked, value, "left")


def auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from average ranks: ``by`` columns, n_pos, n_neg, auc (null without both classes)."""
    by = by or []
    counts = (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, score)
        .agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("n"))
    )
    ranked = running_totals(counts, score, ["n"], by)
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    total = ranked.groupBy(*by).agg(
        F.sum("p").alias("n_pos"), F.sum(F.col("n") - F.col("p")).alias("n_neg"), F.sum(F.col("p") * rank).alias("rank_sum")
    )
    area = (F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))
    return total.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), area).alias("auc"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns over rows where both are known: n and rho."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_ranks(average_ranks(known, a, "_ra"), b, "_rb")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("rho"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row for each distinct score: threshold, tp and fp of "score at least threshold"."""
    counts = (
        df.where(F.col(score).isNotNull())
        .groupBy(score)
        .agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("q"))
    )
    ranked = running_totals(counts, score, ["p", "q"], descending=True)
    return ranked.select(
        F.col(score).alias("threshold"), (F.col("p") + F.col("p_before")).alias("tp"), (F.col("q") + F.col("q_before")).alias("fp")
    )
