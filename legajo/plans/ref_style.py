"""Queries over segments and their style."""

from __future__ import annotations

from pyspark.sql import functions as F

from legajo.functions import lexicons as lx
from legajo.operators import stylometry as sy
from legajo.plans import corpus as co
from legajo.plans.corpus import S, Registry, sql_phrases

R = Registry()
#: Words of a segment, and of a rest that stays one; words of a passage at least and at most.
TARGET, LEAST = 700, 500
PASSAGE_LEAST, PASSAGE_MOST = 220, 400
KEYS = sy.SEGMENT

# The SQL walks the sentences of each chapter one by one.
_SEG = rf"""with recursive {S},
o as (select document_id, coalesce(chapter, '') as chapter, page, paragraph_id, sent_no, text, len(regexp_extract_all(text, '\p{{L}}+')) as words,
 row_number() over (partition by document_id, coalesce(chapter, '') order by page, paragraph_id, sent_no) as rn from s),
walk(document_id, chapter, rn, carry, segment) as (
 select document_id, chapter, 0::bigint, 0::bigint, 1::bigint from (select distinct document_id, chapter from o)
 union all select w.document_id, w.chapter, o.rn, case when w.carry >= {TARGET} then o.words else w.carry + o.words end, w.segment + case when w.carry >= {TARGET} then 1 else 0 end
 from walk w join o on o.document_id = w.document_id and o.chapter = w.chapter and o.rn = w.rn + 1),
pl as (select o.*, w.segment from o join walk w using (document_id, chapter, rn)),
sz as (select document_id, chapter, segment, sum(words) as size from pl group by all),
la as (select document_id, chapter, max(segment) as last, arg_max(size, segment) as rest from sz group by all),
sg as (select document_id, chapter, page, paragraph_id, sent_no, words, text, case when segment = last and rest < {LEAST} and segment > 1 then segment - 1 else segment end as segment
 from pl join la using (document_id, chapter)),
tx as (select document_id, chapter, segment, string_agg(text, ' ' order by page, paragraph_id, sent_no) as text, count(*) as n_sentences, min(page) as page_start from sg group by all)"""


def _placed(s, d):
    return sy.segments(co.sentences(s, d), TARGET, LEAST)


def _texts(s, d):
    return sy.segment_texts(_placed(s, d))


R.add(
    "segments",
    lambda s, d: _placed(s, d).select("paragraph_id", "sent_no", "words", "segment"),
    _SEG + " select paragraph_id, sent_no, words::int as words, segment from sg",
)
R.add(
    "segment_texts",
    lambda s, d: _texts(s, d).select(*KEYS, F.length("text").alias("n_chars"), F.md5("text").alias("digest"), "n_sentences", "page_start"),
    _SEG + " select document_id, chapter, segment, length(text)::int as n_chars, md5(text) as digest, n_sentences, page_start from tx",
)
R.add(
    "capped_passages",
    lambda s, d: sy.passages(co.sentences(s, d), PASSAGE_MOST, PASSAGE_LEAST),
    rf"""with recursive {S}, q as (select *, coalesce(chapter, '') as ch from s),
b as (select *, case when ch is distinct from lag(ch) over (partition by document_id order by page, paragraph_id, sent_no) then 1 else 0 end as new from q),
k as (select *, sum(new) over (partition by document_id order by page, paragraph_id, sent_no)::bigint as run from b),
o as (select document_id, run, ch, page, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) as words,
 row_number() over (partition by document_id, run order by page, paragraph_id, sent_no) as rn from k),
walk(document_id, run, rn, carry, passage) as (
 select document_id, run, 0::bigint, 0::bigint, 1::bigint from (select distinct document_id, run from o)
 union all select w.document_id, w.run, o.rn, case when w.carry > 0 and w.carry + least(o.words, {PASSAGE_MOST}) > {PASSAGE_MOST} then least(o.words, {PASSAGE_MOST}) else w.carry + least(o.words, {PASSAGE_MOST}) end,
  w.passage + case when w.carry > 0 and w.carry + least(o.words, {PASSAGE_MOST}) > {PASSAGE_MOST} then 1 else 0 end
 from walk w join o on o.document_id = w.document_id and o.run = w.run and o.rn = w.rn + 1)
select document_id, run, passage, min(ch) as chapter, min(page) as page_start, max(page) as page_end, count(*) as n_sentences, sum(words)::bigint as n_words
from o join walk using (document_id, run, rn) group by document_id, run, passage having sum(words) >= {PASSAGE_LEAST}""",
)
_SYL = """list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouáéíóúü]+'))
 + len(list_filter(range(2, length(x) + 1), lambda i: contains('aeoáéíóú', x[i]) and contains('aeoáéíóú', x[i - 1]))))))"""
_MARKS = ", ".join(f"round((length(text) - length(replace(text, '{m}', ''))) / greatest(length(text), 1) * 1000, 3) as {k}_per_1k_chars" for k, m in sy.MARKS.items())
R.add(
    "segment_features",
    lambda s, d: sy.features(_texts(s, d), KEYS),
    _SEG
    + rf""", f as (select document_id, chapter, segment, text, regexp_extract_all(lower(text), '\p{{L}}+') as w, greatest(1, len(list_filter(list_transform(string_split(regexp_replace(text,
 '([.;:!?])\s+([«“"(¿¡]?[\p{{Lu}}0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''))) as n_sentences from tx),
g as (select *, greatest(len(w), 1) as n, coalesce({_SYL}, 0) as n_syllables from f)
select document_id, chapter, segment, len(w)::int as n_words, n_sentences::int as n_sentences, n_syllables::int as n_syllables,
 round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / n, 4) as mean_word_length,
 round(len(list_filter(w, lambda x: length(x) <= 3)) / n, 4) as share_1_3, round(len(list_filter(w, lambda x: length(x) between 4 and 6)) / n, 4) as share_4_6,
 round(len(list_filter(w, lambda x: length(x) between 7 and 9)) / n, 4) as share_7_9, round(len(list_filter(w, lambda x: length(x) >= 10)) / n, 4) as share_10,
 round(len(list_distinct(w)) / n, 4) as type_token_ratio,
 round(206.84::double - 60.0::double * (n_syllables / n) - 102.0::double * (n_sentences / n), 2) as readability_a,
 round(206.835::double - 62.3::double * (n_syllables / n) - n / n_sentences, 2) as readability_b,
 round(({' + '.join(sql_phrases('text', [p]) for p in lx.CONNECTORS)}) / n * 1000, 3) as connectors_per_1k,
 round(({' + '.join(sql_phrases('text', [p]) for p in lx.HEDGING)}) / n * 1000, 3) as hedging_per_1k, {_MARKS} from g""",
)
_FW = ", ".join(f"'{w}'" for w in lx.FUNCTION_WORDS)
_RATES = _SEG + rf""", ww as (select document_id, chapter, segment, regexp_extract_all(lower(text), '\p{{L}}+') as w from tx),
uu as (select document_id, chapter, segment, len(w) as total, unnest(w) as word from ww), rt as (select document_id, chapter, segment, word, round(count(*) / total, 6) as rate from uu where word in ({_FW}) group by document_id, chapter, segment, word, total)"""
R.add(
    "function_word_rates",
    lambda s, d: sy.function_word_rates(_texts(s, d), KEYS),
    _RATES + " select document_id, chapter, segment, word, rate from rt",
)
R.add(
    "standardised_rates",
    lambda s, d: sy.standardised(sy.function_word_rates(_texts(s, d), KEYS), "word", "rate", KEYS).select(
        *KEYS, "word", F.round("z", 4).alias("z")
    ),
    _RATES
    + """ select document_id, chapter, segment, word, round(case when stddev_pop(rate) over (partition by word) > 0
 then (rate - avg(rate) over (partition by word)) / stddev_pop(rate) over (partition by word) else 0 end, 4) as z from rt""",
)
R.add(
    "evenly_spaced_segments",
    lambda s, d: sy.evenly_spaced(_texts(s, d).select(*KEYS), ["chapter", "segment"], 4, ["document_id"]),
    _SEG
    + """, k as (select document_id, chapter, segment, row_number() over (partition by document_id order by chapter, segment) - 1 as i, count(*) over (partition by document_id) as n from tx)
select document_id, chapter, segment from k where n <= 4 or i in (select round_even(j * (n - 1) / 3, 0)::bigint from (select unnest(range(4)) as j))""",
)


R.add(
    "style_outliers",
    lambda s, d: sy.style_distances(sy.features(_texts(s, d), KEYS), KEYS).withColumn("distance", F.round("distance", 3)),
)

R.add(
    "segment_coherence",
    lambda s, d: sy.coherence(sy.function_word_rates(_texts(s, d), KEYS), KEYS, ["document_id"]).select(
        *KEYS, "n_others", F.round("mean_cosine", 5).alias("mean_cosine"), F.round("js_to_others", 5).alias("js_to_others")
    ),
    _RATES
    + """, nn as (select document_id, chapter, segment, sqrt(sum(rate * rate)) as norm, sum(rate) as mass from rt group by all),
v as (select rt.*, rate / norm as u, rate / mass as p from rt join nn using (document_id, chapter, segment)),
pr as (select a.document_id, a.chapter, a.segment, b.chapter as c2, b.segment as s2, sum(a.u * b.u) as cosine from v a join v b on a.document_id = b.document_id and a.word = b.word
 and (a.chapter, a.segment) is distinct from (b.chapter, b.segment) group by all),
kk as (select document_id, count(*) - 1 as n_others from nn group by 1),
wd as (select distinct document_id, word from v), gr as (select nn.document_id, nn.chapter, nn.segment, wd.word from nn join wd using (document_id)),
di as (select gr.document_id, gr.chapter, gr.segment, gr.word, coalesce(max(p), 0) as p, (select coalesce(sum(o.p), 0) from v o where o.document_id = gr.document_id and o.word = gr.word
 and (o.chapter, o.segment) is distinct from (gr.chapter, gr.segment)) as rest from gr left join v using (document_id, chapter, segment, word) group by gr.document_id, gr.chapter, gr.segment, gr.word),
js as (select document_id, chapter, segment, sum(case when p > 1e-12 then p * log2(p / ((p + rest / n_others) / 2)) else 0 end
 + case when rest > 1e-12 then rest / n_others * log2(rest / n_others / ((p + rest / n_others) / 2)) else 0 end) / 2 as js from di join kk using (document_id) where n_others > 0 group by all)
select nn.document_id, nn.chapter, nn.segment, n_others, round(case when n_others > 0 then coalesce((select sum(cosine) from pr where pr.document_id = nn.document_id and pr.chapter = nn.chapter
 and pr.segment = nn.segment), 0) / n_others end, 5) as mean_cosine, round(js, 5) as js_to_others
from nn join kk using (document_id) left join js using (document_id, chapter, segment)""",
)
