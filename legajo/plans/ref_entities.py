"""Queries over checkable statements, entities and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from legajo.functions.lexicons import CAUSAL_CORE, CAUSAL_EXTENDED, CLAIM_TYPES, CUE_WEIGHTS, SCALES, SECTION_TYPES
from legajo.operators import claimrules as cr, entities as en
from legajo.operators.ordered import numbered
from legajo.plans import corpus as co
from legajo.plans.corpus import Registry, S, T, sql_phrases, sql_words
from legajo.session import table

R = Registry()


def _q(rx: str) -> str:
    """A pattern for SQL, whose engine has no look-around but reads \\b over ASCII signs."""
    return rx.replace("'", "''").replace("(?<![0-9A-Za-z_])", r"\b").replace("(?![0-9A-Za-z_])", r"\b")


_MASKED = f"regexp_replace(regexp_replace(text, '{_q(cr.LAW)}', ' ', 'g'), '{_q(cr.DATE)}', ' ', 'g')"
_CUES = {
    "money": f"regexp_matches(text, '{_q(cr.MONEY)}')",
    "percent": f"regexp_matches(text, '{_q(cr.PERCENT)}')",
    "number": f"regexp_matches({_MASKED}, '[0-9]') and not regexp_matches(text, '{_q(cr.MONEY)}') and not regexp_matches(text, '{_q(cr.PERCENT)}')",
    "date": f"regexp_matches(text, '{_q(cr.DATE)}')",
    "comparative": f"regexp_matches(lower(text), '{cr.COMPARATIVE}')",
    "ranking": f"regexp_matches(lower(text), '{cr.RANKING}')",
    "causal": f"{sql_phrases('text', CAUSAL_CORE + CAUSAL_EXTENDED)} > 0",
    "institution": f"regexp_matches(text, '{cr.INSTITUTION}')",
    "attribution": f"regexp_matches(text, '{_q(cr.SOURCE)}')",
    "law": f"regexp_matches(text, '{_q(cr.LAW)}')",
}
_SCORED = (
    f"{S}, k as (select paragraph_id, sent_no, chapter, text, " + ", ".join(f"({x}) as k_{n}" for n, x in _CUES.items()) + f" from s where len({sql_words('text', 'blank')}) >= 6),"
    " z as (select *, concat_ws(';', " + ", ".join(f"case when k_{n} then '{n}' end" for n in _CUES) + ") as cues, ("
    + " + ".join(f"case when k_{n} then {CUE_WEIGHTS[n]} else 0 end" for n in _CUES) + ")::int as score from k)"
)
R.add(
    "statement_cues",
    lambda s, d: cr.scored(co.sentences(s, d)).select("paragraph_id", "sent_no", "cues", "score"),
    f"with {_SCORED} select paragraph_id, sent_no, cues, score from z",
)
R.add(
    "statement_candidates",
    lambda s, d: cr.scored(co.sentences(s, d)).where("is_candidate").groupBy("chapter", cr.priority(F.col("score")).alias("priority")).agg(F.count(F.lit(1)).alias("n")),
    f"with {_SCORED} select chapter, case when score >= 7 then 'A' when score >= 5 then 'B' else 'C' end as priority, count(*) as n from z where score >= 3 group by all",
)
_QUANTITY = rf"""q as (select paragraph_id, sent_no, text, regexp_extract(text, '{_q(cr.MONEY)}') as m, regexp_extract(text, '{_q(cr.PERCENT)}') as p,
 regexp_extract({_MASKED}, '[0-9][0-9.]*(?:,[0-9]+)?') as o from s),
w as (select paragraph_id, sent_no, text, case when m <> '' then 'money' when p <> '' then 'percent' when o <> '' then 'count' else '' end as kind,
 trim(case when m <> '' then m when p <> '' then p else o end) as raw from q)"""
R.add(
    "main_quantities",
    lambda s, d: co.sentences(s, d).select("paragraph_id", "sent_no", cr.main_quantity(F.col("text")).alias("q")).select("paragraph_id", "sent_no", "q.kind", "q.raw", "q.value"),
    rf"""with {S}, {_QUANTITY} select paragraph_id, sent_no, kind, raw, try_cast(replace(replace(regexp_extract(raw,
 '[0-9]{{1,3}}(?:\.[0-9]{{3}})+(?:,[0-9]+)?|[0-9]+(?:,[0-9]+)?'), '.', ''), ',', '.') as double) as value from w""",
)
_LOW = "lower(raw)"
_SCALE_WORD = "case " + " ".join(f"when contains({_LOW}, '{w}') then '{w}'" for w in SCALES) + " else '' end"
_FACTOR = "case " + " ".join(f"when contains({_LOW}, '{w}') then {v}::double" for w, v in SCALES.items()) + " else 1 end"
_COUNT_FACTOR = "case " + " ".join(f"when cs = '{w}' then {v}::double" for w, v in SCALES.items()) + " else 1 end"
_NONE = ", ".join(f"'{w}'" for w in cr._NO_UNITS)
_UNITS = rf"""{_QUANTITY}, cw as (select *, regexp_extract({_MASKED}, '{cr._COUNTED}', 1) as cs, regexp_extract({_MASKED}, '{cr._COUNTED}', 2) as cn,
 try_cast(replace(replace(regexp_extract(raw, '[0-9]{{1,3}}(?:\.[0-9]{{3}})+(?:,[0-9]+)?|[0-9]+(?:,[0-9]+)?'), '.', ''), ',', '.') as double) as value from w),
un as (select paragraph_id, sent_no, kind, raw, value, case kind when 'money' then trim(case when regexp_matches({_LOW}, 'us[$]|usd|dólares') then 'USD' else 'COP' end || ' ' || {_SCALE_WORD})
 when 'percent' then '%' when 'count' then trim(cs || ' ' || case when cn in ({_NONE}) then '' else cn end) else '' end as unit,
 case kind when 'money' then value * {_FACTOR} when 'count' then value * {_COUNT_FACTOR} end as base from cw)"""
R.add(
    "quantity_units",
    lambda s, d: co.sentences(s, d).select("paragraph_id", "sent_no", cr.quantity(F.col("text")).alias("q")).select("paragraph_id", "sent_no", "q.*"),
    f"with {S}, {_UNITS} select * from un",
)
_COUNTS = {n: f"len(regexp_extract_all(lower(text), '{'|'.join(stems)}'))" for n, stems in CLAIM_TYPES.items()}
_TYPED = (
    ", ".join(f"{x} as c_{n}" for n, x in _COUNTS.items()),
    "greatest(" + ", ".join(f"c_{n}" for n in _COUNTS) + ")",
    "list_filter([" + ", ".join(f"case when c_{n} = best then '{n}' end" for n in _COUNTS) + "], lambda x: x is not null)",
    "case " + " ".join(f"when contains(coalesce(section, ''), '{h}') then '{t}'" for h, t in SECTION_TYPES.items()) + " end",
    "case " + " ".join(f"when contains(coalesce(section, ''), '{h}') and list_contains(tops, '{t}') then '{t}'" for h, t in SECTION_TYPES.items()) + " end",
)
_TYPES = f"""ct as (select paragraph_id, sent_no, section, text, {_TYPED[0]} from s), cb as (select *, {_TYPED[1]} as best from ct), cc as (select *, {_TYPED[2]} as tops, {_TYPED[3]} as told from cb),
cd as (select *, {_TYPED[4]} as hinted from cc), ty as (select paragraph_id, sent_no,
 case when best > 0 and len(tops) = 1 then tops[1] when best > 0 then coalesce(hinted, tops[1]) else coalesce(told, 'otros') end as claim_type,
 case when best > 0 and len(tops) = 1 then 'keywords' when best > 0 and hinted is not null then 'keywords+section' when best > 0 then 'keywords(tie)'
  when told is not null then 'section' else 'default' end as claim_type_rule from cd)"""
R.add(
    "claim_types",
    lambda s, d: co.sentences(s, d).select("paragraph_id", "sent_no", cr.claim_type(F.col("text"), F.col("section")).alias("t"))
    .select("paragraph_id", "sent_no", F.col("t.type").alias("claim_type"), F.col("t.rule").alias("claim_type_rule")),
    f"with {S}, {_TYPES} select * from ty",
)
_EVALUATING = f"len(regexp_extract_all(lower(text), '{'|'.join(sorted(set(cr.EVALUATIVE), key=lambda w: (-len(w), w)))}'))"
_AMOUNT, _ANCHOR = "(k_money or k_percent or k_number)", "(k_date or k_institution or k_law)"
_CANDIDATES = f"""{_SCORED}, {_UNITS}, {_TYPES}, ca as (select *, case when score >= 3 then 'factual_candidate' when {_EVALUATING} >= 2 and not {_AMOUNT} then 'evaluative_candidate' end as claim_kind from z),
cl as (select ca.*, claim_type, claim_type_rule, case when claim_kind = 'factual_candidate' and {_AMOUNT} and {_ANCHOR} then 'yes_candidate' when claim_kind = 'factual_candidate' then 'uncertain'
 else 'no_candidate' end as verifiable, k_causal as is_causal, case when score >= 7 then 'A' when score >= 5 then 'B' else 'C' end as priority,
 case when claim_kind = 'factual_candidate' then unit end as quantity_unit, case when claim_kind = 'factual_candidate' then base end as quantity_base,
 case when claim_kind = 'factual_candidate' then raw end as quantity_raw
 from ca join ty using (paragraph_id, sent_no) join un using (paragraph_id, sent_no) where claim_kind is not null)"""
_CLAIM_COLUMNS = ["paragraph_id", "sent_no", "cues", "score", "claim_kind", "claim_type", "claim_type_rule", "verifiable", "is_causal", "priority", "quantity_unit", "quantity_base"]
R.add("claim_candidates", lambda s, d: cr.candidates(co.sentences(s, d)).select(*_CLAIM_COLUMNS), f"with {_CANDIDATES} select {', '.join(_CLAIM_COLUMNS)} from cl")
R.add(
    "numeric_claims",
    lambda s, d: cr.numeric_claims(cr.candidates(co.sentences(s, d))).select("paragraph_id", "sent_no", "reported_value", "reported_unit", "variable"),
    rf"""with {_CANDIDATES}, i as (select *, instr(text, regexp_extract(quantity_raw, '\S+')) as k from cl where coalesce(quantity_raw, '') <> '')
select paragraph_id, sent_no, quantity_raw as reported_value, quantity_unit as reported_unit, trim(case when k > 0 then
 substr(text, greatest(1, k - 90), k - greatest(1, k - 90) + length(quantity_raw) + 60) else substr(text, 1, 150) end) as variable from i""",
)
R.add(
    "claim_ids",
    lambda s, d: numbered(cr.candidates(co.sentences(s, d)).select("document_id", "page", "paragraph_id", "sent_no"), "claim_id", ["document_id", "page", "paragraph_id", "sent_no"], "C%04d")
    .select("claim_id", "paragraph_id", "sent_no"),
    f"""with {_CANDIDATES} select format('C{{:04d}}', row_number() over (order by s.document_id nulls first, s.page nulls first, s.paragraph_id, s.sent_no)) as claim_id, s.paragraph_id, s.sent_no
from cl join s using (paragraph_id, sent_no)""",
)
R.add(
    "quantity_contexts",
    lambda s, d: co.sentences(s, d)
    .select("paragraph_id", "sent_no", "text", cr.main_quantity(F.col("text")).alias("q"))
    .where("q.kind <> ''")
    .select("paragraph_id", "sent_no", cr.quantity_context(F.col("text"), F.col("q.raw")).alias("context")),
    rf"""with {S}, {_QUANTITY}, i as (select *, instr(text, regexp_extract(raw, '\S+')) as k from w where kind <> '')
select paragraph_id, sent_no, case when k > 0 then substr(text, greatest(1, k - 40), k - greatest(1, k - 40) + length(raw) + 30) else substr(text, 1, 70) end as context from i""",
)
R.add(
    "statement_periods",
    lambda s, d: co.sentences(s, d).select("paragraph_id", "sent_no", cr.periods(F.col("text")).alias("period")).where("period <> ''"),
    rf"""with {S}, q as (select paragraph_id, sent_no, regexp_extract_all(text, '{_q(cr.DATE)}') as v from s)
select paragraph_id, sent_no, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '; ') as period from q where len(v) > 0""",
)
R.add(
    "named_sources",
    lambda s, d: co.sentences(s, d).groupBy(cr.cited_source(F.col("text")).alias("source")).agg(F.count(F.lit(1)).alias("n")),
    rf"""with {S}, q as (select trim(regexp_extract(text, '{_q(cr.SOURCE)}', 1)) as x, text from s)
select case when x <> '' then x when regexp_matches(text, '\[[0-9]+\]') then 'note' else '' end as source, count(*) as n from q group by 1""",
)
_SURFACE = r"""trim(regexp_replace(regexp_replace(trim(regexp_replace(raw, '\s+', ' ', 'g')), '^[ .,;:«»“”"''()\[\]]+|[ .,;:«»“”"''()\[\]]+$', '', 'g'),
 '^(?:[Ee]l|[Ll]a|[Ll]os|[Ll]as|[Dd]el|[Aa]l|[Dd]e) +', ''))"""
_M = (
    f"{S}, mv as ("
    + " union all ".join(f"select document_id, paragraph_id, sent_no, page, level2, '{k}' as entity_type, 'pattern' as method, unnest(regexp_extract_all(text, '{_q(rx)}')) as raw from s" for k, rx in cr.TYPES.items())
    + f" union all select document_id, paragraph_id, sent_no, page, level2, 'NAME', 'capitals', unnest(regexp_extract_all(text, '{en.NAME}')) from s),"
    + f" m as (select * from (select document_id, paragraph_id, sent_no, page, level2, {_SURFACE} as entity, entity_type, method from mv) where length(entity) > 1)"
)


def _mentions(s, d):
    return en.mentions(co.sentences(s, d))


R.add(
    "entity_mentions",
    lambda s, d: _mentions(s, d).groupBy("paragraph_id", "sent_no", "entity", "entity_type").agg(F.count(F.lit(1)).alias("n")),
    f"with {_M} select paragraph_id, sent_no, entity, entity_type, count(*) as n from m group by all",
)
R.add(
    "mentions_without_overlaps",
    lambda s, d: en.without_overlaps(_mentions(s, d), ["paragraph_id", "sent_no"]).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("n_entities")),
    f"""with {_M}, k as (select * from m where method = 'pattern' or not exists (select 1 from m x where x.method = 'pattern' and length(x.entity) > 6
 and x.paragraph_id = m.paragraph_id and x.sent_no = m.sent_no and (contains(lower(m.entity), lower(x.entity)) or contains(lower(x.entity), lower(m.entity)))))
select entity_type, count(*) as n, count(distinct entity) as n_entities from k group by 1""",
)
_PUBLIC = rf"regexp_matches(lower(entity), '(^|[^\p{{L}}])(?:{en.PUBLIC})([^\p{{L}}]|$)')"
R.add(
    "entity_summary",
    lambda s, d: en.summary(_mentions(s, d)),
    f"""with {_M} select entity, entity_type, count(*) as n, bool_or({_PUBLIC}) as is_public, count(distinct (document_id, page)) as n_pages, count(distinct paragraph_id) as n_paragraphs,
 coalesce(string_agg(distinct level2, ' | ' order by level2), '') as sections from m group by all""",
)
R.add(
    "modal_entity_types",
    lambda s, d: en.modal_type(_mentions(s, d)),
    f"""with {_M}, k as (select entity, entity_type, count(*) as n from m group by all)
select entity, entity_type from k qualify row_number() over (partition by entity order by n desc, entity_type) = 1""",
)


def _edges(s, d):
    return en.pairs(_mentions(s, d).where("method = 'capitals'"), "paragraph_id", "entity", least_items=3, least_weight=2)


_EDGES = f"""{_M}, o as (select entity from m where method = 'capitals' group by 1 having count(*) >= 3),
dd as (select distinct paragraph_id, entity from m where method = 'capitals' and entity in (select entity from o)),
ed as (select x.entity as a, y.entity as b, count(*) as weight from dd x join dd y on x.paragraph_id = y.paragraph_id and x.entity < y.entity group by all having count(*) >= 2)"""
R.add("entity_network", _edges, f"with {_EDGES} select a, b, weight from ed")
R.add(
    "network_degrees",
    lambda s, d: en.degrees(_edges(s, d)),
    f"with {_EDGES}, ends as (select a as node, weight from ed union all select b, weight from ed) select node, count(*) as degree, sum(weight)::bigint as strength from ends group by 1",
)
R.add(
    "network_density",
    lambda s, d: en.density(_edges(s, d)),
    f"""with {_EDGES}, n as (select count(*) as n from (select a from ed union select b from ed))
select n as nodes, (select count(*) from ed) as edges, case when n > 1 then round(2.0::double * (select count(*) from ed) / (n * (n - 1)), 6) end as density from n""",
)
R.add(
    "top_node_edges",
    lambda s, d: en.among(_edges(s, d), en.degrees(_edges(s, d)).orderBy(F.desc("strength"), "node").limit(10)),
    f"""with {_EDGES}, ends as (select a as node, weight from ed union all select b, weight from ed),
top as (select node from ends group by 1 order by sum(weight) desc, node limit 10) select a, b, weight from ed where a in (select node from top) and b in (select node from top)""",
)
R.add(
    "node_neighbours",
    lambda s, d: en.neighbours(_edges(s, d), "Auditoría Delegada"),
    f"with {_EDGES} select b as node, weight from ed where a = 'Auditoría Delegada' union all select a, weight from ed where b = 'Auditoría Delegada'",
)
R.add(
    "concept_network",
    lambda s, d: en.pairs(
        co.tokens(s, d).where(F.col("token").isin(_TERMS)).select(F.concat_ws("/", "paragraph_id", "sent_no").alias("w"), "token"), "w", "token", least_weight=2
    ),
    f"""with {T}, q as (select distinct paragraph_id, sent_no, token from t where token in ({', '.join(repr(x) for x in
 ['obras', 'contrato', 'compras', 'energía', 'agua', 'aguas', 'control', 'plan', 'registro', 'censo', 'usuarios', 'red', 'acueducto', 'mantenimiento'])}))
select x.token as a, y.token as b, count(*) as weight from q x join q y on x.paragraph_id = y.paragraph_id and x.sent_no = y.sent_no and x.token < y.token group by all having count(*) >= 2""",
)
_TERMS = ["obras", "contrato", "compras", "energía", "agua", "aguas", "control", "plan", "registro", "censo", "usuarios", "red", "acueducto", "mantenimiento"]


def _supply_links(lines):
    """The distinct pairs of part and supplier of order lines as a bipartite graph."""
    return lines.select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()


def _supply(s, d):
    """Parts and suppliers of a few thousand order lines only: the small graph that ``connected_components`` shares with its SQL."""
    return _supply_links(table(s, d, "lineitem").where("l_linenumber = 1 and l_quantity >= 49")).withColumn("weight", F.lit(1))


R.add(
    "connected_components",
    lambda s, d: en.components(_supply(s, d)),
    """with recursive g as (select distinct 'p' || l_partkey as a, 's' || l_suppkey as b from lineitem where l_linenumber = 1 and l_quantity >= 49),
u as (select a, b from g union select b, a from g), n as (select distinct a from u),
r(node, c) as (select a, a from n union select r.node, u.b from r join u on u.a = r.c)
select node, min(c) as component from r group by 1""",
)
# The whole graphs; recursive SQL walks every pair of nodes there, so they have none and are tested against brute force.
R.add("supply_components", lambda s, d: en.components(_supply_links(table(s, d, "lineitem"))))
R.add("entity_components", lambda s, d: en.components(_edges(s, d)))
