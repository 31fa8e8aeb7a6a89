"""Queries of the text problems (2, 3, 4, 5, 8, 9 and 10), with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from legajo.llm import encoding, packing, quality, scans, sentences, terms, tokens
from legajo.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.repairs_found(table(spark, d, "paragraphs"), table(spark, d, "removed_headers_footers"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return scans.cleaned(table(spark, d, "paragraphs"), table(spark, d, "removed_headers_footers"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    scores = terms.term_scores(table(spark, d, "paragraphs"), table(spark, d, "term_probes"), "paragraph_id", "clean_text")
    return terms.most_characteristic(scores, "paragraph_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_records(encoding.garbled_sources(table(spark, d, "paragraphs"), table(spark, d, "page_extractions")))


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page_extractions")
    sources = encoding.garbled_sources(table(spark, d, "paragraphs"), pages)
    return encoding.repaired(sources, encoding.glyph_map(pages)).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    units = sentences.sentence_units(table(spark, d, "paragraphs"), table(spark, d, "causal_sentences"))
    return units.select("rec_id", "sent_no", "start_pos").distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_documents(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.kinds(table(spark, d, "documents"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_statistics(table(spark, d, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p5_found": p5_found,
    "p8_ids": p8_ids,
    "p9_packed": p9_packed,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}

_P3 = r"""
with docs as (select distinct paragraph_id, clean_text from paragraphs where clean_text is not null),
occurrences as (select paragraph_id, unnest(regexp_extract_all(lower(clean_text), '\p{L}+')) as term from docs),
totals as (select term, count(*) as total from occurrences group by term),
size as (select count(*) as size from occurrences),
own as (select paragraph_id, term, count(*) as n from occurrences where paragraph_id in (select paragraph_id from term_probes) group by all),
lengths as (select paragraph_id, sum(n) as length from own group by all),
expected as (select *, length * (total + 4.0::double) / size as e from own join lengths using (paragraph_id) join totals using (term), size),
scored as (select paragraph_id, term, (n - e) / sqrt(e * (1 - length / size) * (1 - total / size)) as score from expected)
select paragraph_id, term from scored
qualify row_number() over (partition by paragraph_id order by round(score, 9) desc, term) = 1
"""
_COMMON = ", ".join("'" + w + "'" for w in quality.COMMON_WORDS)
_P10 = rf"""
with d as (select doc_id, text, length(text) as c, regexp_extract_all(text, '\p{{L}}[\p{{L}}\p{{M}}]*') as w,
    regexp_extract_all(lower(text), '\p{{L}}[\p{{L}}\p{{M}}]*') as lw,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) as l from documents),
n as (select *, len(w)::int as n_words, len(l)::int as n_lines, length(regexp_replace(text, '\p{{L}}', '', 'g')) as rest from d)
select doc_id, n_words, n_lines,
  case when n_words > 0 then (c - rest) / n_words end as mean_word_length,
  case when c > 0 then (c - rest) / c end as letter_ratio,
  case when c > 0 then (c - length(regexp_replace(text, '\p{{N}}', '', 'g'))) / c end as digit_ratio,
  case when c > 0 then length(regexp_replace(text, '[\p{{L}}\p{{M}}\p{{N}}\s.,;:!?¿¡()"''«»“”‘’„—–\-…。，、！？；：（）「」।؟؛،%$/]', '', 'g')) / c end as symbol_ratio,
  case when n_lines > 0 then len(list_filter(l, lambda x: regexp_matches(x, '[.!?…。！？।؟]["''»”’)]*\s*$'))) / n_lines end
    as lines_ending_in_punctuation,
  case when n_words > 0 then len(list_filter(lw, lambda x: x in ({_COMMON}))) / n_words end as common_word_share
from n
"""
ORACLES = {"p3_found": _P3, "p10_statistics": _P10}
