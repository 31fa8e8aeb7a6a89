"""Topics of texts: models behind one interface, their terms, coherence and shares. Topics are never named."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.session import checkpointed, small_lookup


def counted(tokens: DataFrame, doc: str, least_docs: int = 3, most_share: float = 0.5, vocabulary: int = 2**31 - 1):
    """Count vectors of documents (doc, features) and the vocabulary, by the library's vectoriser: all terms between the two bounds."""
    from pyspark.ml.feature import CountVectorizer

    docs = tokens.groupBy(doc).agg(F.collect_list("token").alias("words"))
    model = CountVectorizer(inputCol="words", outputCol="features", minDF=float(least_docs), maxDF=most_share, vocabSize=vocabulary).fit(docs)
    return model.transform(docs).select(doc, "features"), model.vocabulary


def lda(vectors: DataFrame, doc: str, k: int, iterations: int = 60, seed: int = 42):
    """(doc, topic, weight) of the dominant topic of each document, and the model.

    Batch variational Bayes: each pass reads every document once and puts its statistics in place of the former topics. The
    library's estimator draws with replacement even where subsamplingRate is 1, so its optimiser is set by its own classes.
    """
    from pyspark.ml.clustering import LocalLDAModel
    from pyspark.ml.functions import vector_to_array

    spark = vectors.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    vectors = checkpointed(vectors.select(doc, "features").repartition(parts, doc))  # read in every pass
    old, new = spark._jvm.org.apache.spark.mllib.clustering, spark._jvm.org.apache.spark.ml.clustering
    every = old.OnlineLDAOptimizer().setMiniBatchFraction(1.0).setSampleWithReplacement(False).setKappa(0.0)  # weight of a pass: 1
    fit = old.LDA().setK(k).setSeed(seed).setMaxIterations(iterations).setDocConcentration(0.1).setTopicConcentration(0.01).setOptimizer(every)
    topics = fit.run(getattr(getattr(new, "LDA$"), "MODULE$").getOldDataset(vectors._jdf, "features"))
    model = LocalLDAModel(new.LocalLDAModel(f"lda_{seed}", topics.vocabSize(), topics, spark._jsparkSession))
    shares = model.transform(vectors).select(doc, vector_to_array("topicDistribution").alias("w"))
    return dominant(shares, doc, "w"), model


def dominant(shares: DataFrame, doc: str, weights: str) -> DataFrame:
    """doc, topic (place of the largest weight, from 0) and weight."""
    top = F.array_max(weights)
    return shares.select(doc, (F.array_position(weights, top) - 1).cast("int").alias("topic"), top.alias("weight"))


def topic_shares(assigned: DataFrame, group: str) -> DataFrame:
    """group, topic, n and its share of the group."""
    counts = assigned.groupBy(group, "topic").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("t"))
    return counts.join(totals, group).select(group, "topic", "n", F.round(F.col("n") / F.col("t"), 4).alias("share"))


def class_terms(assigned: DataFrame, tokens: DataFrame, doc: str) -> DataFrame:
    """topic, token, weight: class-based TF-IDF, frequency in the class times ln(1 + mean class size / frequency overall)."""
    counts = tokens.join(assigned.select(doc, "topic"), doc).groupBy("topic", "token").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("topic").agg(F.sum("n").alias("size"))
    overall = counts.groupBy("token").agg(F.sum("n").alias("all"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    joined = counts.join(sizes, "topic").join(overall, "token").crossJoin(F.broadcast(mean))  # one row
    return joined.select("topic", "token", (F.col("n") / F.col("size") * F.log(1 + F.col("mean") / F.col("all"))).alias("weight"))


def coherence(topic_terms: DataFrame, tokens: DataFrame, doc: list[str], order: list[str], window: int = 10) -> DataFrame:
    """topic and its mean NPMI over pairs of its terms, from counts of sliding windows of ``window`` words.

    Only windows of the wanted terms are expanded, and pairs are counted by a join on the window.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*doc).orderBy(*order)
    at = tokens.select(*doc, "token", (F.row_number().over(w) - 1).alias("i"))
    sizes = at.groupBy(*doc).agg(F.count(F.lit(1)).alias("n"))
    windows = sizes.agg(F.sum(F.greatest(F.col("n") - window + 1, F.lit(1))).alias("total"))
    terms = topic_terms.select("token").distinct()
    mine = at.join(terms, "token", "left_semi").join(sizes, doc)
    last = F.greatest(F.col("n") - window, F.lit(0))
    inside = mine.select(*doc, "token", F.explode(F.sequence(F.greatest(F.col("i") - window + 1, F.lit(0)), F.least(F.col("i"), last))).alias("win")).distinct()
    single = inside.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    a, b = inside.withColumnRenamed("token", "a"), inside.withColumnRenamed("token", "b")
    both = a.join(b, [*doc, "win"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c_ab"))
    wanted = topic_terms.select("topic", F.col("token").alias("a")).join(topic_terms.select("topic", F.col("token").alias("b")), "topic").where("a < b")
    full = (
        wanted.join(both, ["a", "b"], "left").join(single.select(F.col("token").alias("a"), F.col("c").alias("c_a")), "a")
        .join(single.select(F.col("token").alias("b"), F.col("c").alias("c_b")), "b").crossJoin(F.broadcast(windows))
    )
    p = (F.coalesce("c_ab", F.lit(0)) + 1e-12) / F.col("total")
    npmi = F.log(p / (F.col("c_a") / F.col("total") * (F.col("c_b") / F.col("total")))) / -F.log(p)
    return full.groupBy("topic").agg(F.avg(npmi).alias("npmi"))


#: Terms x topics up to which the factor of the terms is held by the driver and each task; beyond, it stays distributed.
HELD_NUMBERS = 2_000_000


def nmf(weights: DataFrame, doc: str, k: int, rounds: int = 600, seed: int = 7, tolerance: float = 1e-4, sweeps: int = 20, held: int = HELD_NUMBERS) -> DataFrame:
    """doc, topic and weight of the dominant topic of each document, by a non-negative factorisation of (doc, token, w).

    Alternating coordinate descent: the factor of the documents is never stored, each round solves it anew from the factor of the
    terms, and only sums over documents (terms x k and k x k) come back. Where the terms are more than ``held`` numbers allow, both
    factors stay distributed (:func:`nmf_distributed`). Ends when the error falls by less than ``tolerance`` of the first error in a
    round; raises if ``rounds`` do not suffice. Documents without weights have no row.
    """
    x = checkpointed(weights.select(F.col(doc).alias("d"), F.col("token").alias("t"), F.col("w").cast("double").alias("w")).where("w > 0"))
    spark = x.sparkSession
    terms = x.select("t").distinct().limit(held // k + 1).toPandas()["t"].sort_values().tolist()
    if len(terms) > held // k:
        return nmf_distributed(x.withColumnRenamed("d", doc).withColumnRenamed("t", "token"), doc, k, rounds, seed, tolerance)
    kind = x.schema["d"].dataType.simpleString()
    if not terms:
        return spark.createDataFrame([], f"`{doc}` {kind}, topic int, weight double")
    size = x.agg(F.sum(F.col("w") * F.col("w"))).first()[0]
    places = spark.createDataFrame(pd.DataFrame({"t": terms, "i": range(len(terms))}))
    rows = checkpointed(x.join(places, "t").groupBy("d").agg(F.collect_list("i").alias("i"), F.collect_list("w").alias("w")))  # one document's terms

    def solved(b: pd.DataFrame, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The factor of a batch of documents and its products with the data; term, document and weight of all cells."""
        counts = b["i"].map(len).to_numpy()
        at, of, w = np.concatenate(b["i"].to_numpy()), np.repeat(np.arange(len(b)), counts), np.concatenate(b["w"].to_numpy())
        n = np.zeros((len(b), k))
        np.add.at(n, of, v[at] * w[:, None])
        g = v.T @ v
        u = np.maximum(0.0, n / (g.sum(axis=0) + 1e-12))
        _descend(u, n, g, sweeps)
        return u, n, at, of, w

    v = np.random.default_rng(seed).random((len(terms), k)) + 1e-3
    first = before = None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(v)

        def summed(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            inner, outer, met = np.zeros((k, k)), np.zeros(shared.value.shape), 0.0
            for b in batches:
                if len(b):
                    u, n, at, of, w = solved(b, shared.value)
                    inner += u.T @ u
                    np.add.at(outer, at, u[of] * w[:, None])
                    met += float((u * n).sum())
            seen = np.flatnonzero(outer.any(axis=1))
            cells = [(-1, j, x) for j, x in enumerate(inner.ravel().tolist())] + [(-2, 0, met)]
            cells += [(int(i), j, float(outer[i, j])) for i in seen for j in range(k)]
            yield pd.DataFrame(cells, columns=["i", "j", "x"])

        sums = rows.mapInPandas(summed, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()  # held + k * k + 1 at most
        shared.destroy()
        inner, outer = np.zeros(k * k), np.zeros(v.shape)
        square = sums[sums["i"] == -1]
        inner[square["j"]] = square["x"]
        inner = inner.reshape(k, k)
        met = float(sums.loc[sums["i"] == -2, "x"].sum())
        cell = sums[sums["i"] >= 0]
        outer[cell["i"], cell["j"]] = cell["x"]
        error = max(0.0, size - 2 * met + float((inner * (v.T @ v)).sum())) ** 0.5
        if error <= 1e-7 * size**0.5 or before is not None and before - error <= tolerance * first:
            break
        before, first = error, first or error
        _descend(v, outer, inner, sweeps)
    else:
        raise RuntimeError(f"the factorisation still improves after {rounds} rounds")
    last = spark.sparkContext.broadcast(v)

    def dominated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"d": b["d"], "u": solved(b, last.value)[0].tolist()})

    return dominant(rows.mapInPandas(dominated, f"d {kind}, u array<double>").withColumnRenamed("d", doc), doc, "u")


def _descend(f: np.ndarray, n: np.ndarray, g: np.ndarray, sweeps: int) -> None:
    """Rows of ``f`` brought near the least error, coordinate by coordinate, from their products with the data and the other factor."""
    for _ in range(sweeps):
        for j in range(g.shape[0]):
            f[:, j] = np.maximum(0.0, f[:, j] + (n[:, j] - f @ g[:, j]) / (g[j, j] + 1e-12))


def nmf_distributed(weights: DataFrame, doc: str, k: int, rounds: int = 600, seed: int = 7, tolerance: float = 1e-4, sweeps: int = 5) -> DataFrame:
    """:func:`nmf` for any number of terms: both factors stay in long form and are joined by key; only the k x k products of a
    factor with itself are gathered. Lineage is cut after every update."""
    x = checkpointed(weights.select(F.col(doc).alias("d"), F.col("token").alias("t"), F.col("w").cast("double").alias("w")))
    start = lambda c, salt: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.pmod(F.xxhash64(c, i, F.lit(seed + salt)), F.lit(10_000)) + 1) / 10_000.0)
    left = checkpointed(x.select("d").distinct().select("d", start("d", 0).alias("u")))
    right = checkpointed(x.select("t").distinct().select("t", start("t", 1).alias("v")))
    size = x.agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 0.0
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y)

    def gram(f: DataFrame, c: str) -> list[list[float]]:
        cells = f.select(F.posexplode(c).alias("i", "a"), F.col(c)).select("i", "a", F.posexplode(c).alias("j", "b")).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
        m = [[0.0] * k for _ in range(k)]
        for r in small_lookup(cells):
            m[r["i"]][r["j"]] = r["s"]
        return m

    def update(mine: DataFrame, key: str, c: str, other: DataFrame, other_key: str, oc: str, g: list[list[float]]) -> DataFrame:
        """Each row of a factor brought near its least error, and ``n``, its products with the data."""
        cells = x.join(other, other_key).select(key, F.posexplode(F.transform(oc, lambda y: y * F.col("w"))).alias("i", "p"))
        top = cells.groupBy(key, "i").agg(F.sum("p").alias("p")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("n"))
        rows = F.array(*[F.array(*[F.lit(float(y)) for y in row]) for row in g])

        def step(u: Column, i: Column) -> Column:
            j = F.pmod(i, F.lit(k))
            row = F.get(rows, j)
            better = F.greatest(F.lit(0.0), F.get(u, j) + (F.get("n", j) - dot(u, row)) / (F.get(row, j) + 1e-12))
            return F.transform(u, lambda y, at: F.when(at == j, better).otherwise(y))

        fresh = F.aggregate(F.sequence(F.lit(0), F.lit(sweeps * k - 1)), F.col(c), step)
        return checkpointed(mine.select(key, c).join(top, key).select(key, fresh.alias(c), "n"))

    first = before = None
    of_left = gram(left, "u")
    for _ in range(rounds):
        right = update(right, "t", "v", left, "d", "u", of_left)
        of_right = gram(right, "v")
        left = update(left, "d", "u", right, "t", "v", of_right)
        of_left = gram(left, "u")
        met = left.agg(F.sum(dot(F.col("u"), F.col("n")))).first()[0] or 0.0
        both = sum(a * b for p, q in zip(of_left, of_right, strict=True) for a, b in zip(p, q, strict=True))
        error = max(0.0, size - 2 * met + both) ** 0.5
        if error <= 1e-7 * size**0.5 or before is not None and before - error <= tolerance * first:
            return dominant(left.select(F.col("d").alias(doc), "u"), doc, "u")
        before, first = error, first or error
    raise RuntimeError(f"the factorisation still improves after {rounds} rounds")


def topic_examples(assigned: DataFrame, texts: DataFrame, doc: str, text: str, n: int = 3, characters: int = 200) -> DataFrame:
    """topic, rank, ``doc``, weight and the beginning of the text of the ``n`` documents that a topic weighs most in."""
    order = Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 9)), doc)
    best = assigned.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)  # few rows for each topic
    return best.join(texts.select(doc, F.substring(text, 1, characters).alias("excerpt")), doc, "left").select("topic", "rank", doc, "weight", "excerpt")


def sweep(fit, numbers: list[int], score) -> DataFrame:
    """k and score of ``fit(k)`` for each number of topics, the best first (ties: the fewer topics); a few rows."""
    rows = [(k, float(score(fit(k)))) for k in numbers]
    spark = SparkSession.active()
    return spark.createDataFrame(rows, "k int, score double").orderBy(F.desc("score"), "k")
