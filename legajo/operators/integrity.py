"""Joins between records, and rules that records must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.functions.lexicons import SOURCE_PRIORITY
from legajo.operators.packed import packed_values
from legajo.session import salt_of, small_lookup


def source_rank(source_type: Column) -> Column:
    """Place in the hierarchy of source types, from 0; unknown and null types come last."""
    at = F.array_position(F.array(*[F.lit(s) for s in SOURCE_PRIORITY]), F.coalesce(source_type, F.lit("")))
    return F.when(at > 0, at - 1).otherwise(F.lit(len(SOURCE_PRIORITY))).cast("int")


def hot_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join on keys of which one may hold a large part of ``left``: the left side is salted by ``spread``, the right repeated."""
    salted = left.withColumn("_salt", salt_of(*spread, salts=salts))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def evidence_per_claim(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every claim with what its evidence says: claim_id, n_evidence, n_supports, n_contradicts, stance (``none`` without any)."""
    sums = evidence.where("claim_id is not null").groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n_evidence"), F.count_if("supports").alias("n_supports"), F.count_if("contradicts").alias("n_contradicts")
    )
    joined = claims.select("claim_id").distinct().join(sums, "claim_id", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("n_evidence", "n_supports", "n_contradicts")}
    stance = (
        F.when(n["n_evidence"] == 0, "none").when((n["n_supports"] > 0) & (n["n_contradicts"] > 0), "disputed")
        .when(n["n_supports"] > 0, "supported").when(n["n_contradicts"] > 0, "contradicted").otherwise("context")
    )
    return joined.select("claim_id", *[v.alias(k) for k, v in n.items()], stance.alias("stance"))


def violations(claims: DataFrame, evidence: DataFrame, ledger: DataFrame) -> DataFrame:
    """Broken rules, one row for each: rule, rec_id, ref. An empty result means that the records are sound."""
    e = evidence.select("evidence_id", "claim_id", "source_id", "source_type", "access_date", "supports", "contradicts", "contextualises")
    keys = claims.select("claim_id").distinct()
    sources = ledger.select("source_id", F.col("source_type").alias("ledger_type")).distinct()

    def rule(name: str, df: DataFrame, rec: str, ref: str) -> DataFrame:
        return df.select(F.lit(name).alias("rule"), F.col(rec).cast("string").alias("rec_id"), F.col(ref).cast("string").alias("ref")).distinct()

    unknown_claim = e.where("claim_id is not null").join(keys, "claim_id", "left_anti")
    unknown_source = e.where("source_id is not null").join(sources, "source_id", "left_anti")
    other_type = hot_join(e, sources, ["source_id"], ["evidence_id"]).where("source_type <> ledger_type")
    no_evidence = claims.where("verification_status <> 'unassessed'").join(e.select("claim_id").distinct(), "claim_id", "left_anti")
    no_date = e.where("access_date is null or trim(access_date) = ''")
    says_nothing = e.where("not (coalesce(supports, false) or coalesce(contradicts, false) or coalesce(contextualises, false))")
    return (
        rule("claim unknown", unknown_claim, "evidence_id", "claim_id")
        .unionByName(rule("source not in the ledger", unknown_source, "evidence_id", "source_id"))
        .unionByName(rule("source type differs from the ledger", other_type, "evidence_id", "source_id"))
        .unionByName(rule("assessed without evidence", no_evidence, "claim_id", "verification_status"))
        .unionByName(rule("access date missing", no_date, "evidence_id", "access_date"))
        .unionByName(rule("neither supports nor contradicts nor contextualises", says_nothing, "evidence_id", "claim_id"))
    )


#: What an assessment may say, what of it needs no evidence from outside, and labels of robustness (fixed values).
ASSESSMENTS = ["supported", "mostly_supported", "mixed_or_disputed", "misleading_without_context", "unsupported", "contradicted",
               "not_independently_verifiable", "opinion_or_interpretation"]
NOT_FACTUAL = ["opinion_or_interpretation", "not_independently_verifiable"]
ROBUSTNESS = ["robust", "moderately robust", "sensitive to assumptions", "insufficient evidence", ""]
#: Source types that are the audited document itself, and reports about it (fixed values).
AUDITED, CIRCULAR = "audited_document", "coverage_of_audited_document"
NEEDED = {
    "assessments": ["claim_id", "assessment"],
    "evidence": ["claim_id", "source_id", "source_type", "access_date", "supports", "contradicts", "contextualises"],
}


def problems(claims: DataFrame, evidence: DataFrame, assessments: DataFrame, ledger: DataFrame, allowed: list[str] = ASSESSMENTS) -> DataFrame:
    """Broken rules of assessments and their evidence, one row for each: rule, rec_id, ref; empty where all is sound.

    Assessments may have sentence_id and claim_text_prefix (pins of what was assessed) and robustness; a pin that is null is not
    checked. Missing columns are told alone. Keys with very many rows are joined salted.
    """
    spark = claims.sparkSession
    absent = [("missing column", t, c) for t, df in (("assessments", assessments), ("evidence", evidence)) for c in require_columns(df, NEEDED[t])]
    if absent:
        return spark.createDataFrame(absent, "rule string, rec_id string, ref string")

    def rule(name: str, df: DataFrame, rec: str | Column, ref: str | Column) -> DataFrame:
        as_text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
        return df.select(F.lit(name).alias("rule"), as_text(rec).alias("rec_id"), as_text(ref).alias("ref")).distinct()

    a = assessments.withColumns({c: F.lit(None).cast("string") for c in ("sentence_id", "claim_text_prefix") if c not in assessments.columns})
    known = claims.groupBy("claim_id").agg(F.min("sentence_id").alias("_sentence"), F.min("claim_text").alias("_text"), F.lit(True).alias("_known"))
    sums = evidence.groupBy("claim_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.coalesce("source_type", F.lit("")) != AUDITED).alias("_external"))
    seen = a.join(known, "claim_id", "left").join(sums, "claim_id", "left")
    told = seen.where("_known")
    backed = told.where("_n > 0")
    types = ledger.groupBy("source_id").agg(F.min("source_type").alias("_ledger_type"), F.lit(True).alias("_listed"))
    columns = ["claim_id", "source_id", "access_date", "supports", "contradicts", "contextualises"]
    e = hot_join(evidence.select(*columns), types, ["source_id"], ["claim_id", "access_date"], "left")
    pair = F.concat_ws("/", F.coalesce("claim_id", F.lit("?")), F.coalesce("source_id", F.lit("?")))
    listed = e.where("_listed")
    parts = [
        rule("invalid assessment", a.where(~F.coalesce("assessment", F.lit("")).isin(allowed)), "claim_id", "assessment"),
        rule("claim unknown", seen.where("_known is null"), "claim_id", "assessment"),
        rule("sentence drifted", told.where("sentence_id is not null and not (sentence_id <=> _sentence)"), "claim_id", "sentence_id"),
        rule("text drifted", told.where("claim_text_prefix is not null and not coalesce(startswith(_text, claim_text_prefix), false)"), "claim_id", "claim_text_prefix"),
        rule("no evidence", told.where("_n is null"), "claim_id", "assessment"),
        rule("no evidence from outside", backed.where((F.col("_external") == 0) & ~F.coalesce("assessment", F.lit("")).isin(NOT_FACTUAL)), "claim_id", "assessment"),
        rule("source not in the ledger", e.where("_listed is null"), pair, "source_id"),
        rule("circular source", listed.where(F.col("_ledger_type") == CIRCULAR), pair, "source_id"),
        rule("access date missing", listed.where("coalesce(access_date, '') = ''"), pair, "source_id"),
        rule("says nothing", listed.where("not (coalesce(supports, false) or coalesce(contradicts, false) or coalesce(contextualises, false))"), pair, "source_id"),
    ]
    if "robustness" in assessments.columns:
        parts.append(rule("invalid robustness", backed.where(~F.coalesce("robustness", F.lit("")).isin(ROBUSTNESS)), "claim_id", "robustness"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_assessments(claims: DataFrame, assessments: DataFrame) -> DataFrame:
    """Claims with their assessment; those without one say ``unassessed``. Of several the first in code-point order holds."""
    one = assessments.groupBy("claim_id").agg(F.min("assessment").alias("assessment"))
    return claims.join(one, "claim_id", "left").withColumn("assessment", F.coalesce("assessment", F.lit("unassessed")))


def repinned(assessments: DataFrame, claims: DataFrame) -> DataFrame:
    """Assessments with new_claim_id: the claim whose text begins with their prefix, null unless it is just one.

    Prefixes may have any length: each length is joined by equality, so that no pair of texts is compared.
    """
    lengths = assessments.select(F.length("claim_text_prefix").alias("_k")).where("_k > 0").distinct()
    texts = claims.select(F.col("claim_id").alias("_to"), "claim_text").distinct().join(F.broadcast(_few(lengths)))
    hits = texts.select("_to", F.expr("substring(claim_text, 1, _k)").alias("claim_text_prefix")).distinct()
    found = hits.groupBy("claim_text_prefix").agg(F.count(F.lit(1)).alias("_hits"), F.min("_to").alias("_one"))
    return assessments.join(found, "claim_text_prefix", "left").withColumn("new_claim_id", F.when(F.col("_hits") == 1, F.col("_one"))).drop("_hits", "_one")


def _few(df: DataFrame) -> DataFrame:
    """A configuration table of checked size."""
    return df.sparkSession.createDataFrame(small_lookup(df), df.schema)


def assert_sound(claims: DataFrame, evidence: DataFrame, ledger: DataFrame, shown: int = 20) -> None:
    """Raise with the first broken rules, if there are any."""
    broken = violations(claims, evidence, ledger).orderBy("rule", "rec_id").limit(shown).collect()
    if broken:
        raise ValueError("records fail their checks:\n" + "\n".join(f"{r['rule']}: {r['rec_id']} ({r['ref']})" for r in broken))


def require_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The names of the columns that ``df`` lacks."""
    return [c for c in columns if c not in df.columns]


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys have not been processed (null keys count as never processed)."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def pinned(claims: DataFrame, pins: DataFrame, length: int) -> DataFrame:
    """Text prefixes and the claims they hit: prefix, n_hits, claim_id (null unless there is just one).

    Prefixes of one length are joined by equality with the beginning of the text, not by comparing all pairs.
    """
    left = pins.select("prefix").distinct()
    right = claims.select("claim_id", F.substring("claim_text", 1, length).alias("prefix")).distinct()
    hits = left.join(right, "prefix", "left").groupBy("prefix").agg(F.count("claim_id").alias("n_hits"), F.min("claim_id").alias("c"))
    return hits.select("prefix", "n_hits", F.when(F.col("n_hits") == 1, F.col("c")).alias("claim_id"))


def aliased(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """``name`` and canonical: the exact alias, else the long form in any case, else the name itself.

    ``aliases`` has alias and canonical; among several canonical forms the first in code-point order holds.
    """
    exact = aliases.groupBy(F.col("alias").alias(name)).agg(F.min("canonical").alias("_a"))
    folded = aliases.groupBy(F.lower("canonical").alias("_low")).agg(F.min("canonical").alias("_b"))
    joined = names.withColumn("_low", F.lower(name)).join(exact, name, "left").join(folded, "_low", "left")
    return joined.withColumn("canonical", F.coalesce("_a", "_b", name)).drop("_a", "_b", "_low")


def listed_sources(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """Claims with a list of source ids: claim_id, n_listed, n_known and the best rank among the known sources."""
    ids = claims.select("claim_id", F.explode(packed_values(F.col("evidence_source_ids"))).alias("source_id"))
    ranks = ledger.select("source_id", source_rank(F.col("source_type")).alias("rank")).groupBy("source_id").agg(F.min("rank").alias("rank"))
    joined = hot_join(ids, ranks, ["source_id"], ["claim_id"], "left")
    return joined.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_listed"), F.count("rank").alias("n_known"), F.min("rank").alias("best_rank"))


def drill_down(claims: DataFrame, paragraphs: DataFrame, evidence: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each claim with the length of its paragraph and its evidence as an ordered array of (evidence_id, source type)."""
    e = evidence.select("evidence_id", "claim_id", "source_id").where("claim_id is not null")
    types = ledger.groupBy("source_id").agg(F.min("source_type").alias("ledger_type"))
    known = hot_join(e, types, ["source_id"], ["evidence_id"], "left")
    pairs = known.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "ledger_type"))).alias("found"))
    p = paragraphs.select("paragraph_id", F.length("clean_text").alias("paragraph_chars")).distinct()
    joined = claims.select("claim_id", "paragraph_id").distinct().join(p, "paragraph_id", "left").join(pairs, "claim_id", "left")
    text = F.array_join(F.transform("found", lambda x: F.concat(x["evidence_id"].cast("string"), F.lit(":"), F.coalesce(x["ledger_type"], F.lit("?")))), ";")
    return joined.select("claim_id", "paragraph_id", "paragraph_chars", F.coalesce(F.size("found"), F.lit(0)).alias("n_evidence"), text.alias("trail"))


def replaced(current: DataFrame, marker: Column, fresh: DataFrame) -> DataFrame:
    """Rows marked by ``marker`` dropped and ``fresh`` put in their place; repeating it changes nothing."""
    return current.where(~F.coalesce(marker, F.lit(False))).unionByName(fresh, allowMissingColumns=True)


def difference(reported: Column, reconstructed: Column) -> dict[str, Column]:
    """Absolute and percent difference of a reconstructed from a reported value; no percent of 0."""
    d = reconstructed - reported
    return {"difference_absolute": F.round(d, 6), "difference_percent": F.when(reported != 0, F.round(100 * d / reported, 4))}


def register_source(*_, **__) -> None:
    """Sources are registered by people."""
    raise NotImplementedError("a source is entered in the ledger by hand, with its document")


def assess_claim(*_, **__) -> None:
    """Assessments are made by people."""
    raise NotImplementedError("an assessment needs external evidence and a reviewer; it is never generated")
