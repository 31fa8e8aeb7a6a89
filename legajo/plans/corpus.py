"""The frames most queries begin with, and the same as common table expressions for their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions import text as tx
from legajo.functions.lexicons import ANALYTIC_BLOCKS
from legajo.session import table

PARAGRAPH_COLUMNS = [
    "document_id", "paragraph_id", "page", "page_end", "section", "chapter", "level2", "level3", "block_type", "is_ocr", "font_size", "raw_text",
    "clean_text", "n_words",
]


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs, repeated deliveries once."""
    return table(spark, d, "paragraphs").select(*PARAGRAPH_COLUMNS).distinct()


def analytic(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of running prose that are not known to come from character recognition; without a type they count as body."""
    kind = F.coalesce("block_type", F.lit("body"))
    return paragraphs(spark, d).where(kind.isin(ANALYTIC_BLOCKS) & ~F.coalesce("is_ocr", F.lit(False)) & F.col("clean_text").isNotNull())


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the analytic paragraphs by terminal marks, with the keys of their paragraph."""
    a = analytic(spark, d).select("document_id", "paragraph_id", "chapter", "level2", "section", "page", F.posexplode(tx.sentence_marks(F.col("clean_text"))).alias("i", "text"))
    return a.select("document_id", "paragraph_id", "chapter", "level2", "section", "page", (F.col("i") + 1).alias("sent_no"), "text")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Small-letter words of the sentences with their position in it (from 0)."""
    s = sentences(spark, d)
    return s.select("paragraph_id", "chapter", "level2", "sent_no", F.posexplode(tx.word_list(F.lower("text"))).alias("pos", "token"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims").drop("loaded_at").distinct()


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence").drop("loaded_at").distinct()


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger").drop("loaded_at").distinct()


_BLOCKS = ", ".join(f"'{b}'" for b in ANALYTIC_BLOCKS)
P = f"p as (select distinct {', '.join(PARAGRAPH_COLUMNS)} from paragraphs)"
A = f"{P}, a as (select * from p where coalesce(block_type, 'body') in ({_BLOCKS}) and not coalesce(is_ocr, false) and clean_text is not null)"
S = (
    A
    + r""", sv as (select *, list_filter(list_transform(string_split(regexp_replace(clean_text,
    '([.;:!?])\s+([«“"(¿¡]?[\p{Lu}0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as v from a),
s as (select document_id, paragraph_id, chapter, level2, section, page, unnest(range(1, len(v) + 1))::int as sent_no, unnest(v) as text from sv)"""
)
T = S + r""", tv as (select *, regexp_extract_all(lower(text), '\p{L}+') as w from s),
t as (select paragraph_id, chapter, level2, sent_no, unnest(range(len(w)))::int as pos, unnest(w) as token from tv)"""
C = "c as (select distinct * exclude (loaded_at) from claims)"
E = "e as (select distinct * exclude (loaded_at) from evidence)"
L = "l as (select distinct * exclude (loaded_at) from ledger)"


class Registry:
    """Queries by name, with the SQL that must give the same rows where SQL can."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"two queries are named {name}")
        self.queries[name] = query
        if sql:
            self.oracles[name] = sql


def sql_phrases(text: str, phrases: list[str]) -> str:
    """SQL for the number of phrase occurrences between word boundaries: separators are doubled, so that matches that share
    one do not hide each other."""
    alternatives = "|".join(p.replace("'", "''").replace(" ", "  ") for p in sorted(set(phrases), key=lambda p: (-len(p), p)))
    doubled = rf"regexp_replace(lower({text}), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
    return rf"len(regexp_extract_all({doubled}, '(?:^|[^\p{{L}}\p{{N}}_])(?:{alternatives})(?:$|[^\p{{L}}\p{{N}}_])'))"


def sql_words(text: str, kind: str = "letters") -> str:
    return f"regexp_extract_all({text}, '{tx.WORDS[kind]}')"
