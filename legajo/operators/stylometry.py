"""Style figures of text segments, and their comparison. Figures describe places in a text; they say nothing about authors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.functions import lexicons as lx
from legajo.functions import text as tx
from legajo.operators.ordered import greedy_segments, runs
from legajo.session import checkpointed, small_lookup

#: Pages of a document that are walked in one step.
PAGES_PER_CHUNK = 64
MARKS = {"comma": ",", "semicolon": ";", "colon": ":", "paren": "(", "dash": "—", "guillemet": "«", "quote": "“", "percent": "%"}


#: What names a segment.
SEGMENT = ["document_id", "chapter", "segment"]
_ORDER = ["page", "paragraph_id", "sent_no"]


def _chunked(sentences: DataFrame, kind: str) -> DataFrame:
    """Sentences with their words and the chunk of pages they lie in; a missing chapter is the chapter without a name."""
    return sentences.select(
        "document_id", F.coalesce("chapter", F.lit("")).alias("chapter"), *_ORDER, "text", tx.word_count(F.col("text"), kind).alias("words"),
        F.floor(F.coalesce("page", F.lit(0)) / PAGES_PER_CHUNK).alias("chunk"),
    )


def segments(sentences: DataFrame, target: int, least: int) -> DataFrame:
    """document_id, chapter, page, paragraph_id, sent_no, text, words, segment (from 1): the sentences of a chapter in order, put
    together until ``target`` words, never across chapters.

    A rest of fewer than ``least`` words joins the segment before it, if the chapter has one. A document of any length is walked
    in pages.
    """
    s = _chunked(sentences, "letters")
    placed = greedy_segments(s, "words", target, ["document_id", "chapter"], "chunk", _ORDER).join(s, ["document_id", "chapter", "chunk", *_ORDER])
    sizes = placed.groupBy(*SEGMENT).agg(F.sum("words").alias("size"))
    last = sizes.groupBy("document_id", "chapter").agg(F.max("segment").alias("last"), F.max_by("size", "segment").alias("rest"))
    short = (F.col("segment") == F.col("last")) & (F.col("rest") < least) & (F.col("segment") > 1)
    joined = placed.join(last, ["document_id", "chapter"])
    return joined.select("document_id", "chapter", *_ORDER, "text", "words", F.when(short, F.col("segment") - 1).otherwise(F.col("segment")).alias("segment"))


def passages(sentences: DataFrame, most: int, least: int) -> DataFrame:
    """document_id, run, passage, chapter, page_start, page_end, n_sentences, n_words: consecutive sentences put together up to
    ``most`` words, never across a change of chapter (a chapter that comes back begins anew); passages of fewer than ``least``
    words are dropped, a longer sentence stands alone."""
    s = runs(_chunked(sentences, "unicode"), "chapter", "run", ["document_id"], "chunk", _ORDER)
    placed = greedy_segments(s, "words", most, ["document_id", "run"], "chunk", _ORDER, cap=True)
    joined = placed.join(s, ["document_id", "run", "chunk", *_ORDER])
    out = joined.groupBy("document_id", "run", F.col("segment").alias("passage")).agg(
        F.min("chapter").alias("chapter"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
        F.count(F.lit(1)).alias("n_sentences"), F.sum("words").alias("n_words"),
    )
    return out.where(F.col("n_words") >= least)


def segment_texts(placed: DataFrame) -> DataFrame:
    """document_id, chapter, segment, text (bounded by the segment's size), n_sentences and page_start."""
    ordered = F.array_sort(F.collect_list(F.struct(*_ORDER, "text")))
    grouped = placed.groupBy(*SEGMENT).agg(ordered.alias("v"), F.count(F.lit(1)).alias("n_sentences"), F.min("page").alias("page_start"))
    return grouped.select(*SEGMENT, F.array_join(F.transform("v", lambda x: x["text"]), " ").alias("text"), "n_sentences", "page_start")


def features(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Length, readability, punctuation, connectors and hedges of each text, as plain expressions over its words."""
    t = F.col("text")
    words = tx.word_list(F.lower(t))
    n = F.greatest(F.size("w"), F.lit(1))
    share = lambda cond: F.round(F.size(F.filter("w", cond)) / n, 4)
    rate = lambda count: F.round(count / n * 1000, 3)
    syllables = F.aggregate(F.transform("w", tx.syllables), F.lit(0), lambda s, x: s + x)
    sentences = F.greatest(F.size(tx.sentence_marks(t)), F.lit(1))
    d = texts.withColumn("w", words)
    d = d.withColumn("n_syllables", syllables).withColumn("n_sentences", sentences)
    return d.select(
        *keys, F.size("w").alias("n_words"), "n_sentences", "n_syllables",
        F.round(F.aggregate("w", F.lit(0), lambda s, x: s + F.length(x)) / n, 4).alias("mean_word_length"),
        share(lambda x: F.length(x) <= 3).alias("share_1_3"), share(lambda x: (F.length(x) >= 4) & (F.length(x) <= 6)).alias("share_4_6"),
        share(lambda x: (F.length(x) >= 7) & (F.length(x) <= 9)).alias("share_7_9"), share(lambda x: F.length(x) >= 10).alias("share_10"),
        F.round(F.size(F.array_distinct("w")) / n, 4).alias("type_token_ratio"),
        F.round(206.84 - 60.0 * (F.col("n_syllables") / n) - 102.0 * (F.col("n_sentences") / n), 2).alias("readability_a"),
        F.round(206.835 - 62.3 * (F.col("n_syllables") / n) - n / F.col("n_sentences"), 2).alias("readability_b"),
        rate(tx.additive_count(t, lx.CONNECTORS)).alias("connectors_per_1k"), rate(tx.additive_count(t, lx.HEDGING)).alias("hedging_per_1k"),
        *[F.round((F.length(t) - F.length(F.replace(t, F.lit(m)))) / F.greatest(F.length(t), F.lit(1)) * 1000, 3).alias(f"{k}_per_1k_chars") for k, m in MARKS.items()],
    )


def function_word_rates(texts: DataFrame, keys: list[str], words: list[str] = lx.FUNCTION_WORDS) -> DataFrame:
    """keys, word, rate in long form: each function word's share of the words (rows for words that occur)."""
    w = texts.select(*keys, tx.word_list(F.lower("text")).alias("w"))
    total = F.size("w")
    rows = w.select(*keys, total.alias("total"), F.explode("w").alias("word")).where(F.col("word").isin(words))
    return rows.groupBy(*keys, "word", "total").agg(F.count(F.lit(1)).alias("n")).select(*keys, "word", F.round(F.col("n") / F.col("total"), 6).alias("rate"))


def standardised(long: DataFrame, feature: str, value: str, keys: list[str], population: bool = True) -> DataFrame:
    """keys, feature and z: the value minus the mean over the deviation of its feature (0 where it does not vary)."""
    sd = F.stddev_pop(value) if population else F.stddev_samp(value)
    stats = long.groupBy(feature).agg(F.avg(value).alias("_m"), sd.alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return long.join(stats, feature).select(*keys, feature, z.alias("z"))


def coherence(rates: DataFrame, segment: list[str], group: list[str]) -> DataFrame:
    """How alike each segment is to the others of its group: segment, n_others, mean_cosine and js_to_others.

    ``rates`` is long: keys, word and rate. The mean cosine with all others follows from the sum of the unit vectors of the
    group, and the Jensen-Shannon divergence is taken from the summed distribution of the others, so that no pair of segments is
    formed. Null where a group has one segment; segments without words have no row.
    """
    norms = rates.groupBy(*segment).agg(F.sqrt(F.sum(F.col("rate") * F.col("rate"))).alias("_norm"), F.sum("rate").alias("_mass"))
    unit = rates.join(norms, segment).where("_norm > 0").select(*segment, "word", (F.col("rate") / F.col("_norm")).alias("u"), (F.col("rate") / F.col("_mass")).alias("p"))
    sums = unit.groupBy(*group, "word").agg(F.sum("u").alias("su"), F.sum("p").alias("sp"))
    sizes = norms.where("_norm > 0").groupBy(*group).agg((F.count(F.lit(1)) - 1).alias("n_others"))
    rows = unit.join(sums, [*group, "word"]).join(sizes, group)
    q = F.when(F.col("n_others") > 0, (F.col("sp") - F.col("p")) / F.col("n_others"))
    m = (F.col("p") + q) / 2
    part = lambda x: F.when(x > 1e-12, x * F.log2(x / m)).otherwise(F.lit(0.0))
    # words that only the others have add (q / 2) * log2(q / (q / 2)) = q / 2, and all q sum to one
    own = F.sum(q)
    return rows.groupBy(*segment, "n_others").agg(
        F.when(F.col("n_others") > 0, (F.sum(F.col("u") * F.col("su")) - 1) / F.col("n_others")).alias("mean_cosine"),
        F.when(F.col("n_others") > 0, (F.sum(part(F.col("p"))) + F.sum(part(q)) + (1 - own)) / 2).alias("js_to_others"),
    )


def evenly_spaced(df: DataFrame, order: list[str], k: int, group: list[str]) -> DataFrame:
    """At most ``k`` rows of each group, evenly spaced over its order (rounded half to even), the first and last among them."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    steps = F.when(F.col("_n") > k, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("_n") - 1) / (k - 1)).cast("bigint")))
    kept = ranked.where((F.col("_n") <= k) | F.array_contains(steps, F.col("_i").cast("bigint")))
    return kept.drop("_i", "_n")


# --- numeric comparison of segments ---


def _moments(df: DataFrame, names: list[str], mean: np.ndarray, spread: np.ndarray, turn: np.ndarray) -> tuple[int, np.ndarray, float]:
    """n, the sum of outer products and the sum of squared square lengths of the standardised and turned rows, summed first in
    each batch: one small matrix for each batch leaves the executors, no row does."""
    p = turn.shape[1]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = ((b[names].to_numpy(dtype=float) - mean) / spread) @ turn
            yield pd.DataFrame({"n": [len(z)], "outer": [(z.T @ z).ravel().tolist()], "fourth": [float(((z**2).sum(axis=1) ** 2).sum())]})

    sums = df.select(*names).mapInPandas(part, "n bigint, outer array<double>, fourth double")
    outer = sums.select(F.posexplode("outer").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    total = sums.agg(F.sum("n").alias("n"), F.sum("fourth").alias("fourth")).first()
    flat = np.zeros(p * p)
    for r in small_lookup(outer, 1_000_000):  # the square of the number of features
        flat[r["i"]] = r["x"]
    return int(total["n"] or 0), flat.reshape(p, p), float(total["fourth"] or 0.0)


def style_distances(features_frame: DataFrame, keys: list[str], components: int = 8) -> DataFrame:
    """keys, distance (squared Mahalanobis, over the first principal components, shrunk covariance) and is_outlier (beyond the
    97.5 % quantile of its law). Only moments of the features reach the driver, so that any number of segments will do.
    Fewer than three segments give no rows."""
    names = [c for c in features_frame.columns if c not in keys]
    f = checkpointed(features_frame)
    stats = f.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    mean = np.array([stats[f"m_{c}"] or 0.0 for c in names], dtype=float)
    spread = np.array([stats[f"s_{c}"] or 1.0 for c in names], dtype=float)
    n, outer, _ = _moments(f, names, mean, spread, np.eye(len(names)))
    fields = ", ".join(f"`{c}` {features_frame.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"{fields}, distance double, is_outlier boolean"
    if n < 3:
        return f.sparkSession.createDataFrame([], schema)
    values, vectors = np.linalg.eigh(outer / n)
    order = [i for i in np.argsort(values)[::-1][:components] if values[i] > 1e-9]
    turn = vectors[:, order]
    _, z_outer, fourth = _moments(f, names, mean, spread, turn)
    inverse, limit = shrunk_inverse(z_outer / n, fourth, n), chi2_quantile(0.975, len(order))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = ((b[names].to_numpy(dtype=float) - mean) / spread) @ turn
            d = np.einsum("ij,jk,ik->i", z, inverse, z)
            yield b[keys].assign(distance=d, is_outlier=d > limit)

    return f.mapInPandas(measure, schema)


def shrunk_inverse(s: np.ndarray, fourth: float, n: int) -> np.ndarray:
    """Inverse of a covariance shrunk towards its mean variance (Ledoit and Wolf, 2004). ``fourth`` is the sum of the rows'
    fourth powers of length."""
    p = len(s)
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min((fourth / n - (s**2).sum()) / (n * p), delta)
    shrink = 0.0 if delta == 0 else max(beta, 0.0) / delta
    return np.linalg.pinv((1 - shrink) * s + shrink * mu * np.eye(p))


def chi2_quantile(q: float, k: int) -> float:
    """Quantile of the chi-squared law by bisection of the incomplete gamma series."""

    def cdf(x: float) -> float:
        a, z = k / 2, x / 2
        if z <= 0:
            return 0.0
        term = total = 1 / a
        i = 0
        while abs(term) > 1e-15 * abs(total) and i < 10_000:
            i += 1
            term *= z / (a + i)
            total += term
        return total * math.exp(-z + a * math.log(z) - math.lgamma(a))

    low, high = 0.0, 10.0 * k + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < q else (low, mid)
    return (low + high) / 2


def change_points(x: np.ndarray, penalty: float, least: int = 3) -> list[int]:
    """Places where the mean changes: the cheapest cut of the rows into runs of at least ``least``, each cut costing ``penalty``."""
    n = len(x)
    sums, squares = np.vstack([np.zeros(x.shape[1]), x.cumsum(axis=0)]), np.concatenate([[0], (x**2).sum(axis=1).cumsum()])

    def cost(a: int, b: int) -> float:
        d = sums[b] - sums[a]
        return float(squares[b] - squares[a] - (d @ d) / (b - a))

    best, before, live = [-penalty] + [math.inf] * n, [0] * (n + 1), [0]
    for b in range(least, n + 1):
        options = [(best[a] + cost(a, b) + penalty, a) for a in live if b - a >= least]
        if options:
            best[b], before[b] = min(options)
        live = [a for a in live if b - a < least or best[a] + cost(a, b) <= best[b]] + ([b - least + 1] if b - least + 1 > 0 else [])
    cuts, b = [], n
    while b > 0:
        b = before[b]
        if b > 0:
            cuts.append(b)
    return cuts[::-1]


def ward_clusters(x: np.ndarray, k: int) -> list[int]:
    """Labels of ``k`` clusters by merging the two whose union adds least to the inner sum of squares."""
    members = {i: [i] for i in range(len(x))}
    means = {i: x[i].astype(float) for i in members}
    while len(members) > max(1, k):
        ids = list(members)
        pairs = ((len(members[a]) * len(members[b]) / (len(members[a]) + len(members[b])) * float(((means[a] - means[b]) ** 2).sum()), a, b)
                 for i, a in enumerate(ids) for b in ids[i + 1 :])
        _, a, b = min(pairs)
        na, nb = len(members[a]), len(members[b])
        means[a] = (na * means[a] + nb * means[b]) / (na + nb)
        members[a] += members.pop(b)
        means.pop(b)
    labels = [0] * len(x)
    for label, m in enumerate(sorted(members.values(), key=min)):
        for i in m:
            labels[i] = label
    return labels


# --- scores on given logits ---


def logit_scores(logits: np.ndarray, ids: np.ndarray, other: np.ndarray | None = None) -> dict[str, float]:
    """Perplexity scores of a token sequence from the logits of a model (and of a second one): the logits at a place predict the
    next token. No model is run here; logits come from a provider."""
    lg, target = np.asarray(logits, dtype=float)[:-1], np.asarray(ids)[1:]
    log_p = lg - np.logaddexp.reduce(lg, axis=-1, keepdims=True)
    p = np.exp(log_p)
    chosen = log_p[np.arange(len(target)), target]
    mean, variance = (p * log_p).sum(-1), (p * log_p**2).sum(-1) - ((p * log_p).sum(-1)) ** 2
    out = {
        "log_perplexity": float(-chosen.mean()), "mean_entropy": float(-mean.mean()),
        "discrepancy": float((chosen.sum() - mean.sum()) / math.sqrt(max(variance.sum(), 1e-12))),
    }
    if other is not None:
        o = np.asarray(other, dtype=float)[:-1]
        other_p = np.exp(o - np.logaddexp.reduce(o, axis=-1, keepdims=True))
        cross = float(-(other_p * log_p).sum(-1).mean())
        out |= {"cross_perplexity": cross, "ratio": out["log_perplexity"] / cross}
    return out
