"""Queries and SQL of the general data-processing problems (1, 6 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from legajo.operators import orphans, packed, units
from legajo.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.packed_found(table(spark, d, "claims"), table(spark, d, "ledger"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_found(table(spark, d, "claims"), table(spark, d, "evidence"), table(spark, d, "ledger"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p6_found(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return units.common_quantities(table(spark, d, "claims"), table(spark, d, "common_units"))


QUERIES = {"p1_found": p1_found, "p6_found": p6_found, "p6_report": p6_report, "p7_found": p7_found}

# An independent reading of packed fields: values are matched, not split. DuckDB's expressions have no look-around, so that
# decimal commas and the word "y" between ids are rewritten first.
_MATCH = r"""regexp_extract_all(
    regexp_replace(regexp_replace(regexp_replace({f}, '([0-9]),([0-9])', '\1' || chr(57345) || '\2', 'g'),
      '([0-9]["''”]?) y (["''“]?[A-Z])', '\1;\2', 'g'), '\\"', '""', 'g'),
    '"(?:""|[^"])*"|“[^”]*”|''[^'']*''|[^\s"''“;|,；、·•\[\]/](?:[^;|,\t\n；、·\[\]/]|/[^ ])*')"""
_P1 = (
    """
with raw as (
  select 'claims' as tab, claim_id as rec_id, 'cues' as fld, {cues} as v from claims
  union all select 'claims', claim_id, 'evidence_source_ids', {evidence_source_ids} from claims
  union all select 'claims', claim_id, 'context_flags', {context_flags} from claims
  union all select 'ledger', source_id, 'claim_ids', {claim_ids} from ledger),
clean as (
  select tab, rec_id, fld, list_filter(list_transform(v, lambda x: replace(trim(replace(replace(case
      when x like '"%' then replace(substr(x, 2, length(x) - 2), '""', '"')
      when x like '“%' or x like '''%' then substr(x, 2, length(x) - 2) else x end, chr(57345), ','), chr(13), ' ')), chr(57345), ',')),
    lambda x: x <> '') as v from raw where v is not null),
numbered as (select distinct tab, rec_id, fld, v from clean)
select distinct tab, rec_id, fld, unnest(range(1, len(v) + 1))::int as pos, unnest(v) as val from numbered
"""
).format(**{f: _MATCH.format(f=f) for f in ("cues", "evidence_source_ids", "context_flags", "claim_ids")})

_KEY = (
    "(case when trim({x}) = '' then null when regexp_matches(upper(trim({x})), '^[CS]-?[0-9]+$') then "
    "upper(trim({x}))[1] || lpad(ltrim(regexp_extract(upper(trim({x})), '[0-9]+'), '0'), 8, '0') else upper(trim({x})) end)"
)
_ORPHANS = f"""
with e as (select evidence_id, claim_id, source_id, min(loaded_at) as seen from evidence group by all),
l as (select source_id, claim_ids, min(loaded_at) as seen from ledger group by all),
refs as (
  select 'evidence' as tab, evidence_id::varchar as rec_id, 'claim_id' as fld, 'claims' as parent, {_KEY.format(x='claim_id')} as ref_key, seen
  from e
  union all select 'evidence', evidence_id::varchar, 'source_id', 'ledger', {_KEY.format(x='source_id')}, seen from e
  union all select 'ledger', source_id, 'claim_ids', 'claims', {_KEY.format(x='k')}, seen
  from (select source_id, seen, unnest(regexp_extract_all(claim_ids, '[A-Za-z][-A-Za-z0-9]+')) as k from l)),
targets as (
  select 'claims' as parent, {_KEY.format(x='claim_id')} as ref_key, min(loaded_at) as born, min(deleted_at) as died from claims group by 1, 2
  union all select 'ledger', {_KEY.format(x='source_id')}, min(loaded_at), min(deleted_at) from ledger group by 1, 2),
found as (
  select distinct tab, rec_id, fld, ref_key, case when t.born is null then 'missing' when t.born > seen then 'late'
      when t.died <= seen then 'deleted' end as kind, strftime(seen, '%Y-%m') as period
  from refs left join targets t using (parent, ref_key) where ref_key is not null)
"""
ORACLES = {
    "p1_found": _P1,
    "p6_found": _ORPHANS + "select * from found where kind is not null",
    "p6_report": _ORPHANS
    + """select tab, fld, kind, period, count(*) as n_refs, count(distinct ref_key) as n_keys from found where kind is not null
group by all""",
}
