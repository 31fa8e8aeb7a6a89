"""Statements that can be checked: cues in a sentence, its main quantity, period and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.functions import text as tx
from legajo.functions.lexicons import (
    ADVERSARIAL, CAUSAL_CORE, CAUSAL_EXTENDED, CLAIM_TYPES, CUE_WEIGHTS, FACTUAL_THRESHOLD, MONTHS, NEGATIVE, POSITIVE, SCALES, SECTION_TYPES,
)

_MONTH = "(?:" + "|".join(MONTHS) + ")"
_SCALE = "(?:miles de millones|mil millones|billones|billón|millones|millón|miles|mil)"
#: Edges of a number among ASCII signs; Java's \b also looks at letters of other scripts ("2028年" is a year).
_EDGE_LEFT, _EDGE_RIGHT = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
# Patterns for the types of expressions.
MONEY = rf"(?:US\$|USD|COP|\$) ?[0-9][0-9.,]*(?: {_SCALE})?(?: de (?:pesos|dólares))?|[0-9][0-9.,]* (?:{_SCALE} )?(?:de )?(?:pesos|dólares)"
PERCENT = r"[0-9]+(?:[.,][0-9]+)? ?%|[0-9]+(?:[.,][0-9]+)? por ciento"
DATE = rf"[0-9]{{1,2}} de {_MONTH}(?: de [0-9]{{4}})?|{_MONTH} (?:de|del) [0-9]{{4}}|(?:Entre|entre|Desde|desde) [0-9]{{4}} (?:y|hasta|a) [0-9]{{4}}|{_EDGE_LEFT}(?:19|20)[0-9]{{2}}{_EDGE_RIGHT}"
LAW = r"(?:Ley|Decreto|Resolución|Res\.|Circular|Directiva|Acuerdo|Ordenanza) (?:No\.? ?|número )?[0-9][0-9.]*(?: de [0-9]{4})?"
COMPARATIVE = r"más de|menos de|mayor|menor|superior|inferior|aument|disminu|crec|redujo|increment|duplic|triplic|frente a|respecto"
RANKING = r"(?:el|la|los|las) (?:más|mayor|menor|peor|mejor)|primer lugar|ranking"
INSTITUTION = r"Contraloría|Procuraduría|Fiscalía|Superintendencia|Ministerio|Congreso|Registraduría|Defensoría|Secretaría|Auditoría|Instituto|Comisión"
SOURCE = r"(?:[Ss]egún|[Dd]e acuerdo con|[Cc]onforme a|[Cc]on base en|indicó|afirma|[Aa]ccording to) ([^,;:.()]{3,90})"
TYPES = {"MONEY": MONEY, "PERCENT": PERCENT, "DATE": DATE, "LAW": LAW}


def masked(text: Column) -> Column:
    """Legal references, then dates blanked, so that they are not read as quantities."""
    return F.regexp_replace(F.regexp_replace(text, LAW, " "), DATE, " ")


def cues(text: Column) -> dict[str, Column]:
    """What makes a sentence checkable, by name."""
    money, percent = text.rlike(MONEY), text.rlike(PERCENT)
    return {
        "money": money,
        "percent": percent,
        "number": masked(text).rlike("[0-9]") & ~money & ~percent,
        "date": text.rlike(DATE),
        "comparative": F.lower(text).rlike(COMPARATIVE),
        "ranking": F.lower(text).rlike(RANKING),
        "causal": tx.phrase_count(text, CAUSAL_CORE + CAUSAL_EXTENDED) > 0,
        "institution": text.rlike(INSTITUTION),
        "attribution": text.rlike(SOURCE),
        "law": text.rlike(LAW),
    }


def scored(sentences: DataFrame, text: str = "text", least_words: int = 6) -> DataFrame:
    """Sentences of at least ``least_words`` words with cues (joined by ``;``), score and whether it reaches the threshold."""
    marks = cues(F.col(text))
    score = F.lit(0)
    for name, hit in marks.items():
        score = score + F.when(hit, CUE_WEIGHTS[name]).otherwise(0)
    names = F.array_join(F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in marks.items()]), lambda x: x.isNotNull()), ";")
    rows = sentences.where(tx.word_count(F.col(text), "blank") >= least_words)
    return rows.select("*", names.alias("cues"), score.alias("score")).withColumn("is_candidate", F.col("score") >= FACTUAL_THRESHOLD)


def main_quantity(text: Column) -> Column:
    """struct(kind, raw, value): money before percent before any other number; null value where none can be read."""
    money = F.regexp_extract(text, f"({MONEY})", 1)
    percent = F.regexp_extract(text, f"({PERCENT})", 1)
    other = F.regexp_extract(masked(text), r"([0-9][0-9.]*(?:,[0-9]+)?)", 1)
    raw = F.when(money != "", money).when(percent != "", percent).otherwise(other)
    kind = F.when(money != "", "money").when(percent != "", "percent").when(other != "", "count").otherwise("")
    return F.struct(kind.alias("kind"), F.trim(raw).alias("raw"), F.when(raw != "", tx.spanish_number(raw)).alias("value"))


def periods(text: Column) -> Column:
    """Distinct dates of a text in order, joined by ``; ``."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({DATE})"), F.lit(1))), "; ")


def cited_source(text: Column) -> Column:
    """The source that a sentence names, else the note mark, else an empty string."""
    named = F.trim(F.regexp_extract(text, SOURCE, 1))
    return F.when(named != "", named).when(text.rlike(r"\[[0-9]+\]"), "note").otherwise("")


def priority(score: Column) -> Column:
    return F.when(score >= 7, "A").when(score >= 5, "B").otherwise("C")


def quantity_context(text: Column, raw: Column, before: int = 40, after: int = 30) -> Column:
    """The text around the first word of a quantity."""
    at = F.instr(text, F.regexp_extract(raw, r"(\S+)", 1))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, start, at - start + F.length(raw) + after)).otherwise(F.substring(text, F.lit(1), F.lit(before + after)))


#: Words that follow a number without being what it counts (fixed values).
_NO_UNITS = ["de", "del", "y", "a", "en", "que", "por", "con", "para", "la", "el", "los", "las", "un", "una", *MONTHS]
_COUNTED = r"^[^0-9]*[0-9][0-9.]*(?:,[0-9]+)?[ ]*(mil millones|billones|millones|mil)?[ ]*(?:de )?([a-záéíóúñ]+)?"


def quantity(text: Column) -> Column:
    """struct(kind, raw, value, unit, base): :func:`main_quantity` with its unit and, scale words worked in, its base value.

    The unit of money is its currency and scale word, of a count the word that follows, of a percentage ``%`` (without base).
    """
    q = main_quantity(text)
    low = F.lower(q["raw"])
    scale, factor = F.lit(""), F.lit(1.0)
    for word, value in reversed(SCALES.items()):
        scale, factor = F.when(low.contains(word), word).otherwise(scale), F.when(low.contains(word), value).otherwise(factor)
    currency = F.when(low.rlike("us[$]|usd|dólares"), "USD").otherwise("COP")
    counted_scale = F.regexp_extract(masked(text), _COUNTED, 1)
    counted = F.regexp_extract(masked(text), _COUNTED, 2)
    counted = F.when(counted.isin(_NO_UNITS), "").otherwise(counted)
    counted_factor = F.lit(1.0)
    for word, value in SCALES.items():
        counted_factor = F.when(counted_scale == word, value).otherwise(counted_factor)
    unit = (
        F.when(q["kind"] == "money", F.trim(F.concat(currency, F.lit(" "), scale)))
        .when(q["kind"] == "percent", "%")
        .when(q["kind"] == "count", F.trim(F.concat(counted_scale, F.lit(" "), counted)))
        .otherwise("")
    )
    base = F.when(q["kind"] == "money", q["value"] * factor).when(q["kind"] == "count", q["value"] * counted_factor)
    return F.struct(q["kind"].alias("kind"), q["raw"].alias("raw"), q["value"].alias("value"), unit.alias("unit"), base.alias("base"))


def claim_type(text: Column, section: Column, types: dict[str, list[str]] = CLAIM_TYPES, hints: dict[str, str] = SECTION_TYPES) -> Column:
    """struct(type, rule): the type with most stems in the text; among equals the first that the section's name speaks for, else
    the first of the list; without stems what the section says, else ``otros``."""
    low, place = F.lower(text), F.coalesce(section, F.lit(""))
    names = list(types)
    counts = F.array(*[F.regexp_count(low, F.lit("|".join(stems))) for stems in types.values()])
    best = F.array_max(counts)
    tops = F.filter(F.array(*[F.when(counts[i] == best, F.lit(n)) for i, n in enumerate(names)]), lambda n: n.isNotNull())
    told = F.coalesce(*[F.when(place.contains(h), F.lit(t)) for h, t in hints.items()])
    hinted = F.coalesce(*[F.when(place.contains(h) & F.array_contains(tops, t), F.lit(t)) for h, t in hints.items()])
    kind = F.when((best > 0) & (F.size(tops) == 1), tops[0]).when(best > 0, F.coalesce(hinted, tops[0])).otherwise(F.coalesce(told, F.lit("otros")))
    rule = (
        F.when((best > 0) & (F.size(tops) == 1), "keywords")
        .when((best > 0) & hinted.isNotNull(), "keywords+section").when(best > 0, "keywords(tie)")
        .when(told.isNotNull(), "section").otherwise("default")
    )
    return F.struct(kind.alias("type"), rule.alias("rule"))


#: Evaluating words; counted anywhere, inside other words too.
EVALUATIVE = NEGATIVE + POSITIVE + ADVERSARIAL


def candidates(sentences: DataFrame, text: str = "text", section: str = "section") -> DataFrame:
    """Sentences that state something to check, or evaluate: the columns of ``sentences`` with cues, score, claim_kind, claim_type,
    claim_type_rule, verifiable, is_causal, priority, time_period, source_cited and the :func:`quantity` of the factual ones.

    A sentence below the threshold is evaluative if it has two evaluating words and no quantity; the rest is left out. Sentences
    without text are none.
    """
    t = F.col(text)
    rows = scored(sentences.where(t.isNotNull()), text)
    has = {n: F.array_contains(F.split("cues", ";"), n) for n in CUE_WEIGHTS}
    amount = has["money"] | has["percent"] | has["number"]
    evaluating = F.regexp_count(F.lower(t), F.lit("|".join(sorted(set(EVALUATIVE), key=lambda w: (-len(w), w)))))
    kind = F.when(F.col("is_candidate"), "factual_candidate").when((evaluating >= 2) & ~amount, "evaluative_candidate")
    factual = F.col("claim_kind") == "factual_candidate"
    anchored = has["date"] | has["institution"] | has["law"]
    verifiable = F.when(factual & amount & anchored, "yes_candidate").when(factual, "uncertain").otherwise("no_candidate")
    typed = rows.withColumn("claim_kind", kind).where("claim_kind is not null").withColumn("_type", claim_type(t, F.col(section)))
    out = typed.withColumns(
        {
            "claim_type": F.col("_type.type"), "claim_type_rule": F.col("_type.rule"), "verifiable": verifiable, "is_causal": has["causal"],
            "priority": priority(F.col("score")), "time_period": periods(t), "source_cited": cited_source(t), "_quantity": F.when(factual, quantity(t)),
        }
    )
    return out.withColumns({f"quantity_{n}": F.col(f"_quantity.{n}") for n in ("kind", "raw", "value", "unit", "base")}).drop("_type", "_quantity", "is_candidate")


def numeric_claims(found: DataFrame, text: str = "text") -> DataFrame:
    """The factual candidates with a quantity: what it measures (the text around it), as reported, and empty columns for what a
    check against independent data will give."""
    q = found.where((F.col("claim_kind") == "factual_candidate") & (F.coalesce("quantity_raw", F.lit("")) != ""))
    return q.withColumns(
        {
            "variable": F.trim(quantity_context(F.col(text), F.col("quantity_raw"), 90, 60)), "reported_value": F.col("quantity_raw"),
            "reported_unit": F.col("quantity_unit"), "reported_period": F.col("time_period"), "reported_source": F.col("source_cited"),
            "reconstructed_value": F.lit(None).cast("double"), "difference_absolute": F.lit(None).cast("double"), "difference_percent": F.lit(None).cast("double"),
        }
    )
