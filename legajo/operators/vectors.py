"""Vectors: norms, means, similarities between groups, clusters, components, and agreement of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.session import checkpointed


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector over its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def group_means(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``group`` and the unit vector of its mean. Sums are taken for each place on the map side."""
    places = df.select(group, F.posexplode(vector).alias("i", "x"))
    means = places.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    gathered = means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))  # one entry for each dimension
    return gathered.select(group, unit(F.transform("v", lambda s: s["m"])).alias("mean"))


def similarity_to_means(df: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """Each vector's cosine with the mean of its own group: a join by group, no pairs of vectors."""
    means = group_means(df, group, vector)
    return df.join(means, group).select(key, group, dot(unit(F.col(vector)), F.col("mean")).alias("cosine"))


def group_similarity(df: DataFrame, group: str, vector: str) -> DataFrame:
    """a < b and the cosine of the means of two groups. The pairs are those of groups (a bounded dimension), compared place by
    place through a join on the place."""
    means = group_means(df, group, vector).select(group, F.posexplode("mean").alias("i", "x"))
    left = means.select(F.col(group).alias("a"), "i", F.col("x").alias("xa"))
    right = means.select(F.col(group).alias("b"), "i", F.col("x").alias("xb"))
    return left.join(right, "i").where("a < b").groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("cosine"))


def divergence(p: Column, q: Column, smooth: float = 1e-9) -> Column:
    """Jensen-Shannon divergence to base 2 of two vectors of counts or shares, smoothed and scaled to 1."""

    def scaled(v: Column) -> Column:
        s = F.transform(v, lambda x: x.cast("double") + smooth)
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
        return F.transform(s, lambda x: x / total)

    a, b = scaled(p), scaled(q)
    m = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    kl = lambda u: F.aggregate(F.zip_with(u, m, lambda x, y: x * F.log2(x / y)), F.lit(0.0), lambda s, x: s + x)
    return (kl(a) + kl(b)) / 2


def continuity(df: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """``group`` and the mean cosine of neighbouring vectors in order; rows are paired by their rank, one shuffle."""
    from pyspark.sql import Window

    before = F.lag(vector).over(Window.partitionBy(group).orderBy(order))
    rows = df.withColumn("_b", before).where("_b is not null")
    return rows.groupBy(group).agg(F.avg(dot(unit(F.col(vector)), unit(F.col("_b")))).alias("continuity"), F.count(F.lit(1)).alias("n"))


def agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, adjusted Rand index and normalised mutual information of two labellings, from their contingency counts."""
    known = labels.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = checkpointed(known.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n")))
    choose = lambda n: n * (n - 1) / 2
    rows = cells.groupBy("a").agg(F.sum("n").alias("n"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n"))
    total = cells.agg(F.sum("n").alias("n"))
    ent = lambda df, name: df.crossJoin(F.broadcast(total.select(F.col("n").alias("t")))).agg(  # noqa: E731  (t is one row)
        F.sum(choose(F.col("n"))).alias(f"c_{name}"), (-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t")))).alias(f"h_{name}")
    )
    z = total.crossJoin(ent(cells, "ab")).crossJoin(ent(rows, "a")).crossJoin(ent(cols, "b"))  # one row each
    expected = F.col("c_a") * F.col("c_b") / choose(F.col("n"))
    most = (F.col("c_a") + F.col("c_b")) / 2
    mutual = F.col("h_a") + F.col("h_b") - F.col("h_ab")
    ari = F.when(most == expected, F.lit(1.0)).otherwise((F.col("c_ab") - expected) / (most - expected))
    nmi = F.when(F.col("h_a") + F.col("h_b") == 0, F.lit(1.0)).otherwise(mutual / ((F.col("h_a") + F.col("h_b")) / 2))
    return z.select("n", ari.alias("ari"), nmi.alias("nmi"))


def silhouette_by_means(df: DataFrame, group: str, vector: str) -> DataFrame:
    """One row: the mean simplified silhouette (distances to group means instead of to all members)."""
    u = df.select(group, unit(F.col(vector)).alias("u"))
    means = group_means(df, group, vector)
    listed = means.agg(F.collect_list(F.struct(F.col(group).alias("g"), F.col("mean").alias("m"))).alias("all"))  # one entry for each group
    d = u.crossJoin(F.broadcast(listed))
    own = F.element_at(F.filter("all", lambda s: s["g"] == F.col(group)), 1)["m"]
    others = F.filter("all", lambda s: s["g"] != F.col(group))
    a = 1 - dot(F.col("u"), own)
    b = F.array_min(F.transform(others, lambda s: 1 - dot(F.col("u"), s["m"])))
    return d.select(((b - a) / F.greatest(a, b)).alias("s")).agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))


def kmeans(df: DataFrame, key: str, vector: str, k: int, seeds: int = 3, iterations: int = 20) -> DataFrame:
    """``key`` and cluster of the cheapest of several k-means runs on unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = checkpointed(df.select(key, array_to_vector(unit(F.col(vector))).alias("features")))
    fits = [KMeans(k=k, seed=s, maxIter=iterations).fit(points) for s in range(42, 42 + seeds)]
    best = min(fits, key=lambda f: f.summary.trainingCost)
    return best.transform(points).select(key, F.col("prediction").alias("cluster"))


def principal_components(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """``key`` and its first ``k`` principal components (the covariance of the dimensions is gathered, never the rows)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    points = df.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="pc").fit(points).transform(points).select(key, vector_to_array("pc").alias("pc"))
