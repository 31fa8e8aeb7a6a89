"""Queries over claims, evidence and sources: joins, checks, facets, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from legajo.functions import text as tx
from legajo.functions.lexicons import SOURCE_PRIORITY
from legajo.operators import entities as en, integrity as it, pages as pg, statistics as st
from legajo.operators.packed import packed_values
from legajo.plans import corpus as co
from legajo.plans.corpus import C, E, L, P, Registry
from legajo.session import table

R = Registry()
_RANK = "case " + " ".join(f"when source_type = '{s}' then {i}" for i, s in enumerate(SOURCE_PRIORITY)) + f" else {len(SOURCE_PRIORITY)} end"

R.add(
    "evidence_per_claim",
    lambda s, d: it.evidence_per_claim(co.claims(s, d), co.evidence(s, d)),
    f"""with {C}, {E}, q as (select claim_id, count(*) as n, count(*) filter (supports) as s, count(*) filter (contradicts) as k from e where claim_id is not null group by 1),
z as (select distinct claim_id from c)
select claim_id, coalesce(n, 0) as n_evidence, coalesce(s, 0) as n_supports, coalesce(k, 0) as n_contradicts, case when n is null then 'none'
 when s > 0 and k > 0 then 'disputed' when s > 0 then 'supported' when k > 0 then 'contradicted' else 'context' end as stance from z left join q using (claim_id)""",
)
R.add(
    "violations",
    lambda s, d: it.violations(co.claims(s, d), co.evidence(s, d), co.ledger(s, d)),
    f"""with {C}, {E}, {L}, src as (select distinct source_id, source_type as lt from l)
select distinct 'claim unknown' as rule, evidence_id::varchar as rec_id, claim_id as ref from e where claim_id is not null and claim_id not in (select claim_id from c)
union all select distinct 'source not in the ledger', evidence_id::varchar, source_id from e where source_id is not null and source_id not in (select source_id from l)
union all select distinct 'source type differs from the ledger', evidence_id::varchar, source_id from e join src using (source_id) where source_type <> lt
union all select distinct 'assessed without evidence', claim_id, verification_status from c where verification_status <> 'unassessed' and claim_id not in (select claim_id from e where claim_id is not null)
union all select distinct 'access date missing', evidence_id::varchar, access_date from e where access_date is null or trim(access_date) = ''
union all select distinct 'neither supports nor contradicts nor contextualises', evidence_id::varchar, claim_id from e where not (coalesce(supports, false) or coalesce(contradicts, false) or coalesce(contextualises, false))""",
)
R.add(
    "source_ranks",
    lambda s, d: co.ledger(s, d).select("source_id", it.source_rank(F.col("source_type")).alias("rank")).distinct(),
    f"with {L} select distinct source_id, ({_RANK})::int as rank from l",
)
R.add(
    "not_yet_processed",
    lambda s, d: it.not_done(co.evidence(s, d).select("evidence_id", "claim_id", "source_id"), co.evidence(s, d).where("reliability_notes is not null"), ["claim_id", "source_id"])
    .groupBy("source_id").agg(F.count(F.lit(1)).alias("n")),
    f"""with {E} select source_id, count(*) as n from e where not exists
 (select 1 from e x where x.reliability_notes is not null and x.claim_id = e.claim_id and x.source_id = e.source_id) group by 1""",
)
R.add(
    "usable_sources",
    lambda s, d: co.ledger(s, d).join(co.evidence(s, d).where("supports").select("source_id").distinct(), "source_id", "left_semi").select("source_id", "source_type").distinct(),
    f"with {L}, {E} select distinct source_id, source_type from l where source_id in (select source_id from e where supports)",
)
R.add(
    "pinned_prefixes",
    lambda s, d: it.pinned(co.claims(s, d), co.claims(s, d).select(F.substring("claim_text", 1, 24).alias("prefix")), 24),
    f"""with {C}, q as (select distinct claim_id, substr(claim_text, 1, 24) as prefix from c)
select prefix, count(claim_id) as n_hits, case when count(claim_id) = 1 then min(claim_id) end as claim_id from q where prefix is not null group by 1""",
)
R.add(
    "aliased_sources",
    lambda s, d: it.aliased(
        co.evidence(s, d).select("source_name").distinct(), "source_name",
        co.ledger(s, d).select(F.regexp_extract("organisation", r"(\S+)$", 1).alias("alias"), F.col("organisation").alias("canonical")).where("organisation is not null").distinct(),
    ),
    rf"""with {E}, {L}, n as (select distinct source_name from e), a as (select distinct regexp_extract(organisation, '(\S+)$', 1) as alias, organisation as canonical from l where organisation is not null)
select source_name, coalesce((select min(canonical) from a where alias = source_name), (select min(canonical) from a where lower(canonical) = lower(source_name)), source_name) as canonical from n""",
)
R.add(
    "alias_merges",
    lambda s, d: en.merge_log(
        it.aliased(
            co.evidence(s, d).select(F.upper("source_name").alias("source_name")), "source_name",
            co.ledger(s, d).select(F.lit("-").alias("alias"), F.col("organisation").alias("canonical")).where("organisation is not null").distinct(),
        ), "source_name",
    ),
    f"""with {E}, {L}, a as (select lower(organisation) as low, min(organisation) as canonical from l where organisation is not null group by 1)
select upper(source_name) as source_name, canonical, count(*) as n_merged from e join a on lower(source_name) = low where upper(source_name) <> canonical group by all""",
)
R.add(
    "listed_sources",
    lambda s, d: it.listed_sources(co.claims(s, d), co.ledger(s, d)),
    rf"""with {C}, {L}, i as (select claim_id, unnest(regexp_extract_all(evidence_source_ids, 'S[0-9A-Z-]+')) as source_id from c),
r as (select source_id, min(({_RANK})::int) as rank from l group by 1)
select claim_id, count(*) as n_listed, count(rank) as n_known, min(rank) as best_rank from i left join r using (source_id) group by 1""",
)
R.add(
    "claim_trail",
    lambda s, d: it.drill_down(co.claims(s, d), co.paragraphs(s, d), co.evidence(s, d), co.ledger(s, d)),
    f"""with {C}, {P}, {E}, {L}, lt as (select source_id, min(source_type) as t from l group by 1),
f as (select claim_id, count(*) as n, string_agg(evidence_id || ':' || coalesce(t, '?'), ';' order by evidence_id, t nulls first) as trail
  from (select distinct evidence_id, claim_id, source_id from e where claim_id is not null) left join lt using (source_id) group by 1)
select z.claim_id, z.paragraph_id, length(p.clean_text)::int as paragraph_chars, coalesce(n, 0)::int as n_evidence, trail
from (select distinct claim_id, paragraph_id from c) z left join p using (paragraph_id) left join f using (claim_id)""",
)
R.add(
    "status_coverage",
    lambda s, d: _coverage(s, d),
    f"""with {C}, v as (select unnest(['unassessed', 'supported', 'contradicted', 'never used']) as status),
n as (select verification_status as status, count(*) as n from c group by 1)
select 'status ' || status as metric, coalesce(n, 0)::double as value from v left join n using (status)
union all select 'claims', count(*)::double from c
union all select 'factual', count(*) filter (claim_kind = 'factual_candidate')::double from c
union all select 'assessed share', round(100.0::double * count(*) filter (verification_status <> 'unassessed') / count(*), 2) from c""",
)


def _coverage(s, d):
    """A tall table of metrics with a row for each status, also the unused ones."""
    c = co.claims(s, d)
    one = c.agg(
        F.count(F.lit(1)).cast("double").alias("claims"), F.count_if(F.col("claim_kind") == "factual_candidate").cast("double").alias("factual"),
        F.round(100.0 * F.count_if(F.col("verification_status") != "unassessed") / F.count(F.lit(1)), 2).alias("assessed share"),
    )
    tall = one.unpivot([], ["claims", "factual", "assessed share"], "metric", "value")
    statuses = s.createDataFrame([("unassessed",), ("supported",), ("contradicted",), ("never used",)], "status string")
    counts = c.groupBy(F.col("verification_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    by_status = statuses.join(counts, "status", "left").select(F.concat(F.lit("status "), "status").alias("metric"), F.coalesce("n", F.lit(0)).cast("double").alias("value"))
    return by_status.unionByName(tall)


R.add(
    "claims_by_chapter_and_kind",
    lambda s, d: co.claims(s, d).groupBy("chapter").pivot("claim_kind", ["factual_candidate", "evaluative_candidate"]).count().na.fill(0),
    f"""with {C} select chapter, count(*) filter (claim_kind = 'factual_candidate') as factual_candidate, count(*) filter (claim_kind = 'evaluative_candidate') as evaluative_candidate
from c group by 1""",
)
R.add(
    "sources_cited",
    lambda s, d: co.claims(s, d)
    .groupBy(F.when(F.trim(F.coalesce("source_cited_in_report", F.lit(""))) == "", "(none)").otherwise(F.trim("source_cited_in_report")).alias("source"))
    .agg(F.count(F.lit(1)).alias("n")),
    f"with {C} select case when trim(coalesce(source_cited_in_report, '')) = '' then '(none)' else trim(source_cited_in_report) end as source, count(*) as n from c group by 1",
)
R.add(
    "years_in_claims",
    lambda s, d: co.claims(s, d)
    .select(F.explode(F.regexp_extract_all("claim_text", F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1))).alias("y"))
    .select(F.col("y").cast("int").alias("year"))
    .where(F.col("year").between(2010, 2036))
    .groupBy("year")
    .agg(F.count(F.lit(1)).alias("n")),
    rf"""with {C}, y as (select unnest(regexp_extract_all(claim_text, '\b(?:19|20)[0-9]{{2}}\b'))::int as year from c)
select year, count(*) as n from y where year between 2010 and 2036 group by 1""",
)
R.add(
    "cue_totals",
    lambda s, d: co.claims(s, d).select(F.explode(packed_values(F.col("cues"))).alias("cue")).groupBy("cue").agg(F.count(F.lit(1)).alias("n")),
    rf"with {C}, q as (select unnest(regexp_extract_all(cues, '[a-z]+')) as cue from c) select cue, count(*) as n from q where cue <> 'y' group by 1",
)
R.add(
    "units_from_notes",
    lambda s, d: co.claims(s, d)
    .groupBy(F.regexp_extract(F.lower("claim_text"), r"[0-9] ([a-záéíóúñ]+)", 1).alias("unit_word"))
    .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("numeric_value"), 2).alias("total")),
    rf"with {C} select regexp_extract(lower(claim_text), '[0-9] ([a-záéíóúñ]+)', 1) as unit_word, count(*) as n, round(sum(numeric_value), 2) as total from c group by 1",
)
R.add(
    "claim_facets",
    lambda s, d: _facets(s, d),
    f"""with {C} select claim_id, priority, extraction_score from c where priority = 'A' and (contains(lower(claim_text), 'obra') or contains(lower(coalesce(section, '')), 'obra')
 or contains(lower(coalesce(notes, '')), 'obra')) order by (verification_status <> 'unassessed') desc, page, claim_id""",
)


def _facets(s, d, words: str = "obra", **equal):
    """Optional equality facets and free text over three columns, reviewed claims first."""
    df = co.claims(s, d)
    for column, value in (equal or {"priority": "A"}).items():
        df = df.where(F.col(column) == value)
    text = F.lit(False)
    for column in ("claim_text", "section", "notes"):
        text = text | F.lower(F.coalesce(column, F.lit(""))).contains(words)
    return df.where(text).orderBy((F.col("verification_status") != "unassessed").desc(), "page", "claim_id").select("claim_id", "priority", "extraction_score")


R.add(
    "latest_evidence",
    lambda s, d: st.top_per_group(
        co.evidence(s, d).where("claim_id is not null").select("claim_id", "evidence_id", "publication_date").distinct(), ["claim_id"],
        [F.desc_nulls_last("publication_date"), F.col("evidence_id")], 3,
    ),
    f"""with {E}, q as (select distinct claim_id, evidence_id, publication_date from e where claim_id is not null)
select *, row_number() over (partition by claim_id order by publication_date desc nulls last, evidence_id)::int as rank from q qualify rank <= 3""",
)
R.add(
    "evidence_pivot",
    lambda s, d: co.evidence(s, d).groupBy("source_type").pivot("supports", [True, False]).count().na.fill(0).select("source_type", F.col("true").alias("yes"), F.col("false").alias("no")),
    f"with {E} select source_type, count(*) filter (supports) as yes, count(*) filter (not supports) as no from e group by 1",
)
R.add(
    "ordered_source_types",
    lambda s, d: s.createDataFrame([(i, x) for i, x in enumerate(SOURCE_PRIORITY)], "rank int, source_type string")
    .join(co.ledger(s, d).groupBy("source_type").agg(F.count(F.lit(1)).alias("n")), "source_type", "left")
    .select("rank", "source_type", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")),
    f"""with {L}, v as (select unnest(range({len(SOURCE_PRIORITY)}))::int as rank, unnest({SOURCE_PRIORITY!r}) as source_type), n as (select source_type, count(*) as n from l group by 1)
select rank, source_type, coalesce(n, 0) as n from v left join n using (source_type)""",
)
R.add(
    "evidence_totals",
    lambda s, d: co.evidence(s, d)
    .rollup("source_type", F.substring("publication_date", 1, 4).alias("year"))
    .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level")),
    f"with {E}, q as (select source_type, substr(publication_date, 1, 4) as year from e) select source_type, year, count(*) as n, grouping_id(source_type, year)::int as level from q group by rollup (source_type, year)",
)
R.add(
    "withdrawn_upsert",
    lambda s, d: it.replaced(
        co.claims(s, d).select("claim_id", "unit"), F.col("unit").startswith("COP"), co.claims(s, d).where(F.col("unit").startswith("COP")).select("claim_id", F.lit("peso").alias("unit"))
    ).groupBy("unit").agg(F.count(F.lit(1)).alias("n")),
    f"with {C} select case when starts_with(unit, 'COP') then 'peso' else unit end as unit, count(*) as n from c group by 1",
)
R.add(
    "reported_differences",
    lambda s, d: co.claims(s, d)
    .where("numeric_value is not null")
    .select("claim_id", *[v.alias(k) for k, v in it.difference(F.col("numeric_value"), F.round("numeric_value", 0)).items()]),
    f"""with {C} select claim_id, round(round(numeric_value) - numeric_value, 6) as difference_absolute,
 case when numeric_value <> 0 then round(100 * (round(numeric_value) - numeric_value) / numeric_value, 4) end as difference_percent from c where numeric_value is not null""",
)
R.add(
    "plain_excerpts",
    lambda s, d: co.evidence(s, d).select(F.md5(tx.collapsed(tx.without_markup(F.concat(F.lit("## Nota\n- **x** "), "evidence_excerpt")))).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")),
    rf"""with {E} select md5(trim(regexp_replace('Nota' || chr(10) || 'x ' || evidence_excerpt, '\s+', ' ', 'g'))) as digest, count(*) as n from e group by 1""",
)
# --- star schema and events: the relational core on larger tables ---
R.add(
    "orders_without_lines",
    lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")),
    "select o_orderstatus, count(*) as n from orders where o_orderkey not in (select l_orderkey from lineitem) group by 1",
)
R.add(
    "revenue_by_nation",
    lambda s, d: _revenue(s, d),
    """select n_name, extract(year from o_orderdate)::int as year, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n_lines
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where l_shipdate >= timestamp '1997-01-01' group by all""",
)


def _revenue(s, d):
    lines = table(s, d, "lineitem").where(F.col("l_shipdate") >= F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))).select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(table(s, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(s, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "year").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n_lines"))


R.add(
    "events_per_day",
    lambda s, d: _calendar(s, d),
    """with c as (select unnest(generate_series(date '2024-01-01', date '2024-01-31', interval 1 day))::date as day), e as (select ts::date as day, event_type, value from events)
select day::varchar as day, count(value) as n, coalesce(round(sum(value), 4), 0)::double as total, count(distinct event_type) as n_types from c left join e using (day) group by 1""",
)


def _calendar(s, d):
    """A dense calendar with the events of each day; days without events have zeros."""
    days = s.range(31).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    per_day = (
        table(s, d, "events").groupBy(F.to_date("ts").alias("day"))
        .agg(F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("event_type").alias("n_types"))
    )
    return days.join(per_day, "day", "left").select(F.col("day").cast("string").alias("day"), *[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("n", "bigint"), ("total", "double"), ("n_types", "bigint"))])


R.add(
    "event_runs",
    lambda s, d: _runs(s, d),
    """with o as (select user_id, event_id, event_type, ts, coalesce((lag(event_type) over w <> event_type)::int, 1) as change from events window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(change) over (partition by user_id order by ts, event_id) as run from o), r as (select user_id, run, event_type, count(*) as n from i group by all)
select event_type, n as length, count(*) as n_runs from r group by all""",
)


def _runs(s, d):
    """Runs of consecutive events of one type for each user: how many of each length."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").select("user_id", "event_id", "event_type", "ts")
    e = e.withColumn("change", F.coalesce((F.lag("event_type").over(w) != F.col("event_type")).cast("int"), F.lit(1))).withColumn("run", F.sum("change").over(w))
    return e.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("length")).groupBy("event_type", "length").agg(F.count(F.lit(1)).alias("n_runs"))


def _assessed(s, d):
    """Claims with a status as assessments, pinned to their sentence and the beginning of their text."""
    c = co.claims(s, d).where("verification_status <> 'unassessed'")
    return c.select("claim_id", F.col("verification_status").alias("assessment"), "sentence_id", F.substring("claim_text", 1, 24).alias("claim_text_prefix"))


_PROBLEMS = f"""{C}, {E}, {L}, a as (select claim_id, verification_status as assessment, sentence_id, substr(claim_text, 1, 24) as pre from c where verification_status <> 'unassessed'),
kn as (select claim_id, min(sentence_id) as ks, min(claim_text) as kt from c group by 1),
su as (select claim_id, count(*) as n, count(*) filter (coalesce(source_type, '') <> 'audited_document') as ext from e group by 1),
se as (select a.*, ks, kt, kn.claim_id is not null as known, n, ext from a left join kn using (claim_id) left join su using (claim_id)),
ty as (select source_id, min(source_type) as lt from l group by 1),
ee as (select e.*, lt, ty.source_id is not null as listed, coalesce(e.claim_id, '?') || '/' || coalesce(e.source_id, '?') as pair from e left join ty using (source_id))"""
_ALLOWED = ", ".join(f"'{x}'" for x in it.ASSESSMENTS)
R.add(
    "record_problems",
    lambda s, d: it.problems(co.claims(s, d), co.evidence(s, d), _assessed(s, d), co.ledger(s, d)),
    f"""with {_PROBLEMS} select distinct * from (
select 'invalid assessment' as rule, claim_id as rec_id, assessment as ref from a where coalesce(assessment, '') not in ({_ALLOWED})
union all select 'claim unknown', claim_id, assessment from se where not known
union all select 'sentence drifted', claim_id, sentence_id from se where known and sentence_id is not null and sentence_id is distinct from ks
union all select 'text drifted', claim_id, pre from se where known and pre is not null and not coalesce(starts_with(kt, pre), false)
union all select 'no evidence', claim_id, assessment from se where known and n is null
union all select 'no evidence from outside', claim_id, assessment from se where known and n > 0 and ext = 0 and coalesce(assessment, '') not in ('opinion_or_interpretation', 'not_independently_verifiable')
union all select 'source not in the ledger', pair, source_id from ee where not listed
union all select 'circular source', pair, source_id from ee where listed and lt = 'coverage_of_audited_document'
union all select 'access date missing', pair, source_id from ee where listed and coalesce(access_date, '') = ''
union all select 'says nothing', pair, source_id from ee where listed and not (coalesce(supports, false) or coalesce(contradicts, false) or coalesce(contextualises, false)))""",
)
R.add(
    "claims_with_assessments",
    lambda s, d: it.with_assessments(co.claims(s, d).select("claim_id", "page"), _assessed(s, d)).orderBy((F.col("assessment") == "unassessed").cast("int"), "page", "claim_id"),
    f"""with {C} select c.claim_id, c.page, coalesce(a.assessment, 'unassessed') as assessment from c
left join (select claim_id, min(verification_status) as assessment from c where verification_status <> 'unassessed' group by 1) a using (claim_id)
order by (coalesce(a.assessment, 'unassessed') = 'unassessed')::int, page, claim_id""",
)
R.add(
    "repinned_assessments",
    lambda s, d: it.repinned(_assessed(s, d).select("claim_id", "claim_text_prefix"), co.claims(s, d)),
    f"""with {C}, a as (select claim_id, substr(claim_text, 1, 24) as claim_text_prefix from c where verification_status <> 'unassessed'),
k as (select distinct length(claim_text_prefix) as k from a where length(claim_text_prefix) > 0),
h as (select distinct claim_id, substr(claim_text, 1, k) as claim_text_prefix from c, k), f as (select claim_text_prefix, count(*) as n, min(claim_id) as o from h group by 1)
select a.claim_id, a.claim_text_prefix, case when n = 1 then o end as new_claim_id from a left join f using (claim_text_prefix)""",
)
# A page's chapter: that of most of its paragraphs, else of those that end on it, else a constant.
R.add(
    "chapter_of_pages",
    lambda s, d: pg.page_chapters(table(s, d, "page_extractions").select("document_id", F.col("page_number").alias("page")).distinct(), co.paragraphs(s, d)),
    f"""with {P}, pages as (select distinct document_id, page_number as page from page_extractions), n as (select document_id, page, chapter, count(*) as n from p where chapter is not null group by all),
m as (select document_id, page, arg_min(chapter, (-n, chapter)) as main from n group by all),
e as (select document_id, page_end as page, min(chapter) as ending from p where chapter is not null and page_end is not null group by all)
select document_id, page, coalesce(main, ending, 'none') as chapter from pages left join m using (document_id, page) left join e using (document_id, page)""",
)
# The document browser: the paragraphs of a chapter in order, and of one section of it if one is chosen, without running titles.
R.add(
    "browsed_paragraphs",
    lambda s, d: pg.browsed(co.paragraphs(s, d), "II. Obras y caminos").select("paragraph_id", "page", "block_type"),
    f"""with {P} select paragraph_id, page, block_type from p where chapter = 'II. Obras y caminos' and coalesce(block_type, '') <> 'running_title'""",
)
