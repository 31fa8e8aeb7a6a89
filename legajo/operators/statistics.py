"""Descriptive statistics of texts: corpus figures, vocabulary growth, terms, n-grams, TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions import text as tx


def corpus_figures(sentences: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row: sentences, paragraphs, pages, words, types, hapaxes, mean, median and deviation of sentence lengths, type-token
    ratio. ``sentences`` has paragraph_id, document_id, page and text; ``tokens`` has token."""
    lengths = sentences.select("paragraph_id", "document_id", "page", tx.word_count(F.lower("text")).alias("n"))
    one = lengths.agg(
        F.count(F.lit(1)).alias("n_sentences"), F.countDistinct("paragraph_id").alias("n_paragraphs"), F.countDistinct("document_id", "page").alias("n_pages"),
        F.sum("n").alias("n_words"), F.round(F.avg("n"), 6).alias("mean_length"), F.percentile("n", F.lit(0.5)).alias("median_length"),
        F.round(F.stddev_samp("n"), 6).alias("sd_length"),
    )
    types = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    two = types.agg(F.count(F.lit(1)).alias("n_types"), F.count_if(F.col("n") == 1).alias("n_hapax"), F.sum("n").alias("_all"))
    return one.crossJoin(two).select("*", F.round(F.col("n_types") / F.col("_all"), 6).alias("type_token_ratio")).drop("_all")  # one row each


def moving_ttr(tokens: DataFrame, key: str, order: list[str], window: int) -> DataFrame:
    """``key``, n_tokens and the mean share of types over all windows of ``window`` consecutive tokens (the plain share where
    there are fewer), in closed form: each token counts in the windows that begin after its previous occurrence."""
    at = tokens.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    seen = at.withColumn("p", F.coalesce(F.lag("i").over(Window.partitionBy(key, "token").orderBy("i")), F.lit(-1)))
    sizes = tokens.groupBy(key).agg(F.count(F.lit(1)).alias("n_tokens"))
    d = seen.join(sizes, key)
    width = F.least(F.lit(window), F.col("n_tokens"))
    windows = F.greatest(
        F.least(F.col("i"), F.col("n_tokens") - width) - F.greatest(F.col("p") + 1, F.col("i") - width + 1, F.lit(0)) + 1, F.lit(0)
    )
    total = d.groupBy(key, "n_tokens").agg(F.sum(windows).alias("types"))
    size = F.least(F.lit(window), F.col("n_tokens"))
    return total.select(key, "n_tokens", F.round(F.col("types") / (size * (F.col("n_tokens") - size + 1)), 6).alias("mattr"))


def term_frequencies(tokens: DataFrame, by: list[str], longer_than: int = 2) -> DataFrame:
    """``by``, token, n, per_10k (share of the group's tokens) and n_sentences; tokens of more than so many letters.

    Sentences are counted after a first grouping by sentence, so that a frequent word does not gather its sentences.
    """
    t = tokens.where(F.length("token") > longer_than)
    once = t.groupBy(*by, "token", "paragraph_id", "sent_no").agg(F.count(F.lit(1)).alias("n"))
    terms = once.groupBy(*by, "token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_sentences"))
    totals = terms.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = terms.join(totals, by) if by else terms.crossJoin(F.broadcast(totals))
    return joined.select(*by, "token", "n", F.round(F.col("n") * 10000.0 / F.col("total"), 2).alias("per_10k"), "n_sentences")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order`` (which must be total): with rank. Ranks are cut before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def ngrams(sentences: DataFrame, text: str, n: int, least: int = 2) -> DataFrame:
    """Runs of ``n`` words inside a sentence that occur at least ``least`` times."""
    words = sentences.select(tx.word_list(F.lower(text)).alias("w")).where(F.size("w") >= n)
    grams = F.expr(f"transform(sequence(1, size(w) - {n - 1}), i -> array_join(slice(w, i, {n}), ' '))")
    counted = words.select(F.explode(grams).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


def tf_idf(tokens: DataFrame, group: list[str], least_tokens: int = 30, least_groups: int = 2, least_letters: int = 3) -> DataFrame:
    """``group``, token, tfidf: sublinear frequency times smoothed inverse group frequency, rows scaled to length 1.

    Groups with fewer than ``least_tokens`` tokens are left out; idf = ln((1 + groups) / (1 + groups with the term)) + 1.
    """
    sizes = tokens.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least_tokens).select(*group)
    tf = tokens.where(F.length("token") >= least_letters).groupBy(*group, "token").agg(F.count(F.lit(1)).alias("n"))
    tf = tf.join(sizes, group)
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_groups)
    groups = sizes.agg(F.count(F.lit(1)).alias("groups"))
    weights = tf.join(df, "token").crossJoin(F.broadcast(groups))  # one row
    weights = weights.withColumn("w", (1 + F.log("n")) * (F.log((1 + F.col("groups")) / (1 + F.col("df"))) + 1))
    norms = weights.groupBy(*group).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norms, group).select(*group, "token", (F.col("w") / F.col("norm")).alias("tfidf"))


def cue_counts(text: Column, lists: dict[str, list[str]]) -> list[Column]:
    return [tx.phrase_count(text, words).alias(f"n_{name}") for name, words in lists.items()]


def polarity(positive: Column, negative: Column) -> Column:
    """(positive - negative) / (positive + negative); null where both are 0."""
    return F.when(positive + negative > 0, (positive - negative) / (positive + negative))


def content_words(tokens: DataFrame, stopwords: list[str], kept: list[str]) -> DataFrame:
    """Tokens without stopwords (but for the ``kept`` ones), numbers and single letters."""
    dropped = [w for w in dict.fromkeys(stopwords) if w not in set(kept)]
    return tokens.where(~F.col("token").isin(dropped) & F.col("token").rlike(r"^\p{L}{2,}+$"))


def top_terms(weights: DataFrame, group: str, k: int) -> DataFrame:
    """The ``k`` heaviest tokens of each group with their rank; ties by token. ``weights`` has group, token and tfidf."""
    order = Window.partitionBy(group).orderBy(F.desc("w"), "token")
    ranked = weights.select(group, "token", F.round("tfidf", 6).alias("w")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(group, "rank", "token", F.col("w").alias("tfidf"))  # a rank limit is kept inside each task first
