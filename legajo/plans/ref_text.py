"""Queries over texts: normalisation, words, statistics, framing."""

from __future__ import annotations

from pyspark.sql import functions as F

from legajo.functions import lexicons as lx
from legajo.functions import text as tx
from legajo.operators import ranks, statistics as st
from legajo.plans import corpus as co
from legajo.plans.corpus import P, Registry, S, T, sql_phrases, sql_words
from legajo.session import table

R = Registry()

_NORM = r"regexp_replace(regexp_replace(nfc_normalize({x}), '[\x{{00AD}}\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', '', 'g'), '[\t\x{{00A0}}\x{{202F}}]', ' ', 'g')"
_CLEAN = "regexp_replace(trim(regexp_replace(" + _NORM + r", '\s+', ' ', 'g')), '^[•●▪◦·– ]+', '')"

R.add(
    "cleaned_paragraphs",
    lambda s, d: co.paragraphs(s, d)
    .select("paragraph_id", tx.cleaned(F.col("raw_text"), compose=True).alias("t"))
    .select("paragraph_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest")),
    f"with {P}, q as (select paragraph_id, {_CLEAN.format(x='raw_text')} as t from p) select paragraph_id, length(t)::int as n_chars, md5(t) as digest from q",
)
R.add(
    "quoted_spans",
    lambda s, d: co.paragraphs(s, d)
    .select("paragraph_id", F.posexplode(tx.quoted_spans(F.col("clean_text"))).alias("pos", "quote")),
    f"""with {P}, q as (select paragraph_id, regexp_extract_all(clean_text, '«[^»]{{3,}}»|“[^”]{{3,}}”|"[^"]{{3,}}"') as v from p where clean_text is not null)
select paragraph_id, unnest(range(len(v)))::int as pos, unnest(list_transform(v, lambda x: substr(x, 2, length(x) - 2))) as quote from q""",
)
R.add(
    "number_strings",
    lambda s, d: co.paragraphs(s, d)
    .select(F.explode(tx.number_strings(F.col("clean_text"))).alias("number"))
    .groupBy("number")
    .agg(F.count(F.lit(1)).alias("n"))
    .where("n > 1"),
    rf"""with {P}, q as (select unnest(regexp_extract_all(clean_text, '{tx.NUMBER}')) as x from p)
select trim(x) as number, count(*) as n from q group by 1 having count(*) > 1""",
)
R.add(
    "word_definitions",
    lambda s, d: table(s, d, "documents").select("doc_id", *[tx.word_count(F.col("text"), k).alias(f"n_{k}") for k in tx.WORDS]).where("n_blank is not null"),
    "select doc_id, " + ", ".join(f"len({sql_words('text', k)})::int as n_{k}" for k in tx.WORDS) + " from documents where text is not null",
)
R.add(
    "prose_documents",
    lambda s, d: table(s, d, "documents").where(tx.is_prose(F.col("text"))).select("doc_id"),
    r"""with q as (select doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') as w, length(text) as c,
 length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) as l, length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) as u,
 length(text) - length(regexp_replace(text, '[\p{L}\s]', '', 'g')) as b from documents)
select doc_id from q where len(w) >= 20 and len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$'))) <= 0.2::double * len(w)
 and u <= 0.3::double * greatest(l, 1) and b >= 0.8::double * c""",
)
R.add(
    "artifact_rates",
    lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.round(tx.artifact_rate(F.col("text")), 6).alias("rate")),
    r"""with q as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '\S+'),
 lambda t: regexp_replace(t, '^[.,;:()«»“”"''¿?¡!]+|[.,;:()«»“”"''¿?¡!]+$', '', 'g')), lambda t: t <> '') as v from documents where text is not null)
select doc_id, case when len(v) > 0 then round(len(list_filter(v, lambda t: regexp_matches(t,
 '^(?:[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]|[0-9]+[a-zA-Z]+[0-9]*|[a-zA-Z]+[0-9]+[a-zA-Z0-9]*)$'))) / len(v), 6) else 0.0::double end as rate from q""",
)
R.add(
    "duplicate_texts",
    lambda s, d: table(s, d, "documents")
    .where("text is not null")
    .groupBy(F.sha1("text").alias("text_sha1"))
    .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    .where("n > 1"),
    "select sha1(text) as text_sha1, count(*) as n, min(doc_id) as first_doc from documents where text is not null group by 1 having count(*) > 1",
)
R.add(
    "short_quotes",
    lambda s, d: co.claims(s, d).select("claim_id", tx.short_quote(F.col("claim_text"), 8).alias("quote")),
    r"""with q as (select distinct claim_id, regexp_extract_all(claim_text, '\S+') as w from claims)
select claim_id, array_to_string(w[1:8], ' ') || case when len(w) > 8 then ' …' else '' end as quote from q""",
)
R.add(
    "entity_surfaces",
    lambda s, d: co.evidence(s, d).select(tx.surface(F.col("source_name")).alias("surface")).groupBy("surface").agg(F.count(F.lit(1)).alias("n")),
    rf"""with {co.E} select trim(regexp_replace(regexp_replace(trim(regexp_replace(source_name, '\s+', ' ', 'g')),
 '^[ .,;:«»“”"''()\[\]]+|[ .,;:«»“”"''()\[\]]+$', '', 'g'), '^(?:[Ee]l|[Ll]a|[Ll]os|[Ll]as|[Dd]el|[Aa]l|[Dd]e) +', '')) as surface, count(*) as n from e group by 1""",
)
R.add(
    "sentence_split",
    lambda s, d: co.sentences(s, d).select("paragraph_id", "sent_no", F.length("text").alias("n_chars")),
    f"with {S} select paragraph_id, sent_no, length(text)::int as n_chars from s",
)
R.add(
    "corpus_statistics",
    lambda s, d: st.corpus_figures(co.sentences(s, d), co.tokens(s, d)),
    rf"""with {T}, n as (select paragraph_id, document_id, page, len(regexp_extract_all(lower(text), '\p{{L}}+')) as n from s),
y as (select token, count(*) as n from t group by 1)
select * from (select count(*) as n_sentences, count(distinct paragraph_id) as n_paragraphs, count(distinct (document_id, page)) as n_pages, sum(n)::bigint as n_words,
 round(avg(n), 6) as mean_length, quantile_cont(n, 0.5) as median_length, round(stddev_samp(n), 6) as sd_length from n),
(select count(*) as n_types, count(*) filter (n = 1) as n_hapax, round(count(*) / sum(n), 6) as type_token_ratio from y)""",
)
R.add(
    "moving_ttr",
    lambda s, d: st.moving_ttr(co.tokens(s, d).where("chapter is not null"), "paragraph_id", ["sent_no", "pos"], 20),
    f"""with {T}, q as (select paragraph_id, list(token order by sent_no, pos) as w from t where chapter is not null group by 1)
select paragraph_id, len(w) as n_tokens, round(case when len(w) <= 20 then len(list_distinct(w)) / len(w)
 else list_sum(list_transform(range(1, len(w) - 18), lambda i: len(list_distinct(w[i:i + 19])))) / (20 * (len(w) - 19)) end, 6) as mattr from q""",
)
R.add(
    "term_frequency_by_source",
    lambda s, d: st.top_per_group(_source_terms(s, d), ["source"], [F.desc("n"), F.col("token")], 20),
    r"""with d as (select source, doc_id, string_split(text, chr(10)) as v from documents where text is not null),
pp as (select source, doc_id, unnest(range(len(v))) as line, unnest(v) as x from d),
tt as (select source, doc_id, line, unnest(regexp_extract_all(lower(x), '\p{L}+')) as token from pp),
c as (select source, token, count(*) as n, count(distinct (doc_id, line)) as n_sentences from tt where length(token) > 2 group by all),
z as (select *, sum(n) over (partition by source) as total from c)
select source, token, n, round(n * 10000.0::double / total::double, 2) as per_10k, n_sentences, row_number() over (partition by source order by n desc, token)::int as rank from z
qualify rank <= 20""",
)


def _source_terms(s, d):
    """Terms of the documents of each source; lines stand for sentences."""
    rows = table(s, d, "documents").where("text is not null").select("source", F.col("doc_id").alias("paragraph_id"), F.posexplode(F.split("text", "\n")).alias("sent_no", "x"))
    return st.term_frequencies(rows.select("source", "paragraph_id", "sent_no", F.explode(tx.word_list(F.lower("x"))).alias("token")), ["source"])


R.add(
    "term_frequencies",
    lambda s, d: st.term_frequencies(co.tokens(s, d), []).where("n >= 5"),
    f"""with {T}, c as (select token, count(*) as n, count(distinct (paragraph_id, sent_no)) as n_sentences from t where length(token) > 2 group by 1)
select token, n, round(n * 10000.0::double / (select sum(n) from c)::double, 2) as per_10k, n_sentences from c where n >= 5""",
)
for _n in (2, 3):
    R.add(
        f"ngrams_{_n}",
        lambda s, d, n=_n: st.ngrams(co.sentences(s, d), "text", n),
        rf"""with {S}, q as (select regexp_extract_all(lower(text), '\p{{L}}+') as w from s),
g as (select unnest(list_transform(range(1, len(w) - {_n - 2}), lambda i: array_to_string(w[i:i + {_n - 1}], ' '))) as ngram from q where len(w) >= {_n})
select ngram, count(*) as n from g group by 1 having count(*) >= 2""",
    )
_TFIDF = f"""with {T}, z as (select level2 from t where level2 is not null group by 1 having count(*) >= 30),
f as (select level2, token, count(*) as n from t where length(token) >= 3 and level2 in (select level2 from z) group by all),
df as (select token, count(*) as df from f group by 1 having count(*) >= 2),
w as (select level2, token, (1 + ln(n)) * (ln((1 + (select count(*) from z)) / (1 + df)) + 1) as w from f join df using (token)),
v as (select level2, token, w / sqrt(sum(w * w) over (partition by level2)) as tfidf from w)"""
R.add(
    "tfidf_by_section",
    lambda s, d: st.top_per_group(
        st.tf_idf(co.tokens(s, d).where("level2 is not null"), ["level2"]).withColumn("tfidf", F.round("tfidf", 6)), ["level2"], [F.desc("tfidf"), F.col("token")], 15
    ),
    _TFIDF + " select level2, token, round(tfidf, 6) as tfidf, row_number() over (partition by level2 order by round(tfidf, 6) desc, token)::int as rank from v qualify rank <= 15",
)
R.add(
    "tfidf_global_fresh",
    lambda s, d: _tfidf_global(s, d),
    _TFIDF + " select token, round(max(tfidf), 5) as max_tfidf, round(sum(tfidf) / (select count(*) from z), 5) as mean_tfidf from v group by 1",
)


def _tfidf_global(s, d):
    """Largest and mean weight of each term over all sections that count (0 where it does not occur)."""
    t = co.tokens(s, d).where("level2 is not null")
    groups = t.groupBy("level2").agg(F.count(F.lit(1)).alias("n")).where("n >= 30").agg(F.count(F.lit(1)).alias("groups"))
    w = st.tf_idf(t, ["level2"]).groupBy("token").agg(F.max("tfidf").alias("m"), F.sum("tfidf").alias("s"))
    return w.crossJoin(F.broadcast(groups)).select("token", F.round("m", 5).alias("max_tfidf"), F.round(F.col("s") / F.col("groups"), 5).alias("mean_tfidf"))


_LISTS = {"certainty": lx.CERTAINTY, "hedging": lx.HEDGING, "attribution": lx.ATTRIBUTION, "causal_core": lx.CAUSAL_CORE, "causal_extended": lx.CAUSAL_EXTENDED, "positive": lx.POSITIVE,
          "negative": lx.NEGATIVE, "adversarial": lx.ADVERSARIAL, **{f"frame_{k}": v for k, v in lx.FRAMES.items()}}
R.add(
    "framing_features",
    lambda s, d: co.sentences(s, d).select("paragraph_id", "sent_no", tx.word_count(F.col("text"), "hyphenated").alias("n_words"), *st.cue_counts(F.col("text"), _LISTS)),
    f"with {S} select paragraph_id, sent_no, len({sql_words('text', 'hyphenated')})::int as n_words, "
    + ", ".join(f"{sql_phrases('text', w)}::int as n_{k}" for k, w in _LISTS.items())
    + " from s",
)
R.add(
    "framing_by_chapter",
    lambda s, d: _framing_by_chapter(s, d),
    f"with {S} select chapter, sum(len({sql_words('text', 'hyphenated')}))::bigint as n_words, "
    + ", ".join(f"round(sum({sql_phrases('text', w)}) * 1000.0::double / sum(len({sql_words('text', 'hyphenated')})), 4) as {k}_per_1k" for k, w in _LISTS.items())
    + " from s group by 1",
)


def _framing_by_chapter(s, d):
    rows = co.sentences(s, d).select("chapter", tx.word_count(F.col("text"), "hyphenated").alias("n_words"), *st.cue_counts(F.col("text"), _LISTS))
    sums = rows.groupBy("chapter").agg(F.sum("n_words").alias("n_words"), *[F.sum(f"n_{k}").alias(f"s_{k}") for k in _LISTS])
    return sums.select("chapter", "n_words", *[F.round(F.col(f"s_{k}") * 1000.0 / F.col("n_words"), 4).alias(f"{k}_per_1k") for k in _LISTS])


_POLARITY = f"case when {sql_phrases('text', lx.POSITIVE)} + {sql_phrases('text', lx.NEGATIVE)} > 0 then ({sql_phrases('text', lx.POSITIVE)} - {sql_phrases('text', lx.NEGATIVE)}) / ({sql_phrases('text', lx.POSITIVE)} + {sql_phrases('text', lx.NEGATIVE)}) end"


def _polar(s, d):
    p, n = tx.phrase_count(F.col("text"), lx.POSITIVE), tx.phrase_count(F.col("text"), lx.NEGATIVE)
    return co.sentences(s, d).select("chapter", "paragraph_id", "sent_no", "text", p.alias("pos"), n.alias("neg"), st.polarity(p, n).alias("polarity"))


R.add(
    "sentiment_by_chapter",
    lambda s, d: _polar(s, d)
    .groupBy("chapter")
    .agg(
        F.count(F.lit(1)).alias("n_sentences"), F.sum("pos").cast("bigint").alias("n_positive"), F.sum("neg").cast("bigint").alias("n_negative"),
        F.round(F.avg("polarity"), 6).alias("mean_polarity"), F.count_if(F.col("polarity") < 0).alias("n_below_zero"),
    ),
    f"""with {S}, q as (select chapter, {sql_phrases('text', lx.POSITIVE)} as pos, {sql_phrases('text', lx.NEGATIVE)} as neg, {_POLARITY} as polarity from s)
select chapter, count(*) as n_sentences, sum(pos)::bigint as n_positive, sum(neg)::bigint as n_negative, round(avg(polarity), 6) as mean_polarity,
 count(*) filter (polarity < 0) as n_below_zero from q group by 1""",
)
R.add(
    "length_polarity_correlation",
    lambda s, d: ranks.spearman(co.sentences(s, d).select(tx.word_count(F.col("text")).cast("double").alias("a"), F.length("text").cast("double").alias("b")), "a", "b").select(
        "n", F.round("rho", 6).alias("rho")
    ),
    rf"""with {S}, q as (select len(regexp_extract_all(text, '\p{{L}}+')) as a, length(text) as b from s),
r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as rb from q)
select count(*) as n, round(corr(ra, rb), 6) as rho from r""",
)
R.add(
    "causal_sentences",
    lambda s, d: _causal(s, d),
    f"""with {S}, q as (select paragraph_id, sent_no, {sql_phrases('text', lx.CAUSAL_CORE)} as core, {sql_phrases('text', lx.CAUSAL_EXTENDED)} as ext, regexp_matches(text, '[0-9]') as has_number from s)
select paragraph_id, sent_no, core::int as n_core, ext::int as n_extended, case when core > 0 then 'core' else 'extended_only' end as marker_set, has_number from q where core + ext > 0""",
)


def _causal(s, d):
    core, extended = tx.phrase_count(F.col("text"), lx.CAUSAL_CORE), tx.phrase_count(F.col("text"), lx.CAUSAL_EXTENDED)
    rows = co.sentences(s, d).select("paragraph_id", "sent_no", core.alias("n_core"), extended.alias("n_extended"), F.col("text").rlike("[0-9]").alias("has_number"))
    rows = rows.where("n_core + n_extended > 0")
    return rows.select("paragraph_id", "sent_no", "n_core", "n_extended", F.when(F.col("n_core") > 0, "core").otherwise("extended_only").alias("marker_set"), "has_number")


R.add(
    "causal_marker_counts",
    lambda s, d: co.sentences(s, d)
    .select(F.explode(tx.phrase_hits(F.col("text"), [*lx.CAUSAL_CORE, "a raíz de", "a causa de"])).alias("marker"))
    .groupBy("marker")
    .agg(F.count(F.lit(1)).alias("n")),
    f"with {S} select * from (" + " union all ".join(
        f"select '{m}' as marker, sum({sql_phrases('text', [m])})::bigint as n from s" for m in [*lx.CAUSAL_CORE, "a raíz de", "a causa de"]
    ) + ") where n > 0",
)
R.add(
    "mention_of_phrase",
    lambda s, d: co.sentences(s, d).where(F.lower("text").contains("auditoría delegada")).groupBy("chapter").agg(F.count(F.lit(1)).alias("n")),
    f"with {S} select chapter, count(*) as n from s where contains(lower(text), 'auditoría delegada') group by 1",
)

_DROPPED = ", ".join(f"'{w}'" for w in dict.fromkeys(lx.STOPWORDS) if w not in lx.KEPT_WORDS)
R.add(
    "content_word_counts",
    lambda s, d: st.content_words(co.tokens(s, d), lx.STOPWORDS, lx.KEPT_WORDS).groupBy("token").agg(F.count(F.lit(1)).alias("n")),
    rf"with {T} select token, count(*) as n from t where token not in ({_DROPPED}) and regexp_matches(token, '^\p{{L}}{{2,}}$') group by 1",
)
R.add(
    "tfidf_by_chapter",
    lambda s, d: st.top_terms(st.tf_idf(co.tokens(s, d).where("chapter is not null"), ["chapter"], least_groups=1), "chapter", 12),
    rf"""with {T}, ct as (select chapter, token from t where chapter is not null), z as (select chapter from ct group by 1 having count(*) >= 30),
tf as (select chapter, token, count(*) as n from ct where length(token) >= 3 and chapter in (select chapter from z) group by all),
df as (select token, count(*) as df from tf group by 1),
w as (select chapter, token, (1 + ln(n)) * (ln((1 + (select count(*) from z)) / (1 + df)) + 1) as w from tf join df using (token)),
v as (select chapter, token, w / sqrt(sum(w * w) over (partition by chapter)) as tfidf from w)
select chapter, token, round(tfidf, 6) as tfidf, row_number() over (partition by chapter order by round(tfidf, 6) desc, token)::int as rank from v qualify rank <= 12""",
)
