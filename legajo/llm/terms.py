"""How characteristic a term is of a record, against the whole collection.

Score: the correspondence-analysis residual (observed - expected) / sqrt(expected), divided by sqrt((1 - row share) *
(1 - column share)), from plain DataFrame arithmetic. A term that occurs once in the collection has a tiny expectation and
would beat every shared term, so that a prior count is added to each column margin before the expectation is taken; it
stands for the uncertainty of a margin known from few occurrences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prior occurrences added to each term's total.
COLUMN_PRIOR = 4.0


def record_terms(records: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and term for every occurrence; a term is a run of letters in lower case."""
    terms = F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit(r"(\p{L}+)"), F.lit(1))
    return records.select(F.col(f"`{key}`").alias(key), F.explode(terms).alias("term"))


def term_scores(records: DataFrame, probes: DataFrame, key: str, text: str, prior: float = COLUMN_PRIOR) -> DataFrame:
    """``key``, term, n, total and score of every term of the records in ``probes`` (a column ``key``, repeats allowed).

    ``records`` may hold repeated deliveries; equal rows count once. Records without letters and probes without a record give
    no row. Margins are counted over all records: term totals are summed on the map side before the one shuffle by term.
    """
    distinct = records.select(key, text).where(F.col(f"`{text}`").isNotNull()).distinct()
    totals = record_terms(distinct, key, text).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    wanted = distinct.join(probes.select(key).distinct(), key, "left_semi")
    own = record_terms(wanted, key, text).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    lengths = own.groupBy(key).agg(F.sum("n").alias("length"))
    size = totals.agg(F.sum("total").alias("size"))
    joined = own.join(lengths, key).join(totals, "term").join(F.broadcast(size))  # size is one row
    expected = F.col("length") * (F.col("total") + F.lit(prior)) / F.col("size")
    spread = F.sqrt(expected * (1 - F.col("length") / F.col("size")) * (1 - F.col("total") / F.col("size")))
    score = F.when(spread > 0, (F.col("n") - expected) / spread).otherwise(F.lit(0.0))
    return joined.select(key, "term", "n", "total", score.alias("score"))


def most_characteristic(scores: DataFrame, key: str) -> DataFrame:
    """``key`` and its term of the highest score; among equals the first in code-point order."""
    best = F.min(F.struct((-F.round("score", 9)).alias("minus"), F.col("term"))).alias("best")
    return scores.groupBy(key).agg(best).select(key, F.col("best.term").alias("term"))
