"""Queries over pages, blocks, lines and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from legajo.functions import text as tx
from legajo.operators import pages as pg
from legajo.plans import corpus as co
from legajo.plans.corpus import A, P, Registry
from legajo.session import table

R = Registry()
PE = "page_extractions"

_LINES = """
b as (select document_id, page_number, height, unnest(range(len(blocks)))::int as block_no, unnest(blocks) as b from page_extractions),
lv as (select document_id, page_number, height, block_no, b.block_id as block_id, unnest(range(len(b.lines)))::int as line_no, unnest(b.lines) as l from b),
ln as (select distinct document_id, page_number, height, block_no, block_id, line_no, l.text as text, l.size as size, l.bold as bold, l.bbox[2] as y0 from lv)"""
_MARGIN = r"""regexp_replace(upper(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(text,
  '[\x{00AD}\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g'), '[\t\x{00A0}\x{202F}]', ' ', 'g'), '\s+', ' ', 'g')), '[0-9]+', '#', 'g')), '^[ /]+|[ /]+$', '', 'g')"""

R.add(
    "page_summary",
    lambda s, d: pg.summary(table(s, d, PE)),
    r"""select distinct document_id, page_number, len(blocks)::int as n_blocks, list_sum(list_transform(blocks, lambda b: len(b.lines)))::int as n_lines,
len(tables)::int as n_tables, len(figures)::int as n_figures, len(regexp_extract_all(text, '\S+'))::int as n_words, used_ocr from page_extractions""",
)
R.add(
    "extraction_methods",
    lambda s, d: pg.summary(table(s, d, PE))
    .withColumn("method", pg.extraction_method(F.col("n_words"), F.col("used_ocr"), F.col("n_lines")))
    .groupBy("method")
    .agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_words").alias("n_words")),
    r"""with q as (select distinct document_id, page_number, list_sum(list_transform(blocks, lambda b: len(b.lines)))::int as n_lines,
 len(regexp_extract_all(text, '\S+'))::int as n_words, used_ocr from page_extractions)
select case when used_ocr then 'ocr' when n_words >= 5 then 'text_layer' when n_lines >= 5 then 'fallback' else 'empty' end as method,
 count(*) as n_pages, sum(n_words)::bigint as n_words from q group by 1""",
)
R.add(
    "detected_tables",
    lambda s, d: pg.detected_tables(table(s, d, PE)),
    """with t as (select document_id, page_number, unnest(range(len(tables)))::int + 1 as table_no, unnest(tables) as t from page_extractions),
r as (select document_id, page_number, table_no, list_filter(list_transform(t, lambda r: list_filter(r, lambda c: trim(c) <> '')), lambda r: len(r) > 0) as r from t)
select distinct document_id, page_number, table_no, len(r)::int as n_rows, list_sum(list_transform(r, lambda x: len(x)))::int as n_cells from r
where len(r) >= 2 and list_sum(list_transform(r, lambda x: len(x))) >= 2""",
)
R.add(
    "large_figures",
    lambda s, d: pg.large_figures(table(s, d, PE)),
    # pages of these tables hold one figure at most, so that suppression is tested on literal boxes
    """select distinct document_id, page_number, len(figures)::int as n_figures,
 len(list_filter(figures, lambda f: (f.bbox[3] - f.bbox[1]) * (f.bbox[4] - f.bbox[2]) >= 0.1 * width * height))::int as n_kept
from page_extractions where len(figures) > 0""",
)
R.add(
    "corrupted_blocks",
    lambda s, d: pg.corrupted_blocks(table(s, d, PE)),
    f"with {_LINES} select document_id, page_number, block_id, count(*) as n_bad from ln where regexp_matches(text, '[\\x00-\\x08\\x0b-\\x1f]') group by all",
)
R.add(
    "repeated_margin_lines",
    lambda s, d: pg.repeated_margin_lines(table(s, d, "removed_headers_footers").select("document_id", "page", "text", "y0").distinct()),
    f"""with m as (select document_id, page, {_MARGIN} as margin_key from (select distinct document_id, page, text, y0 from removed_headers_footers))
select document_id, margin_key, count(distinct page) as n_pages, count(*) as n_lines from m where margin_key <> '' group by all having count(distinct page) >= 3""",
)


def _removed(s, d):
    margin = table(s, d, "removed_headers_footers").select("document_id", "page", "text", "y0").distinct()
    margin = margin.withColumn("margin_key", tx.margin_key(F.col("text")))
    repeated = pg.repeated_margin_lines(margin).select("document_id", "margin_key")
    gone = margin.join(repeated, ["document_id", "margin_key"], "left_semi").select("document_id", "page", F.lit("removed").alias("fate"))
    kept = margin.join(repeated, ["document_id", "margin_key"], "left_anti").select("document_id", "page", F.lit("kept").alias("fate"))
    return gone.unionByName(kept).groupBy("document_id", "fate").agg(F.count(F.lit(1)).alias("n_lines"))


R.add(
    "margin_removal",
    _removed,
    f"""with m as (select document_id, page, {_MARGIN} as margin_key from (select distinct document_id, page, text, y0 from removed_headers_footers)),
r as (select document_id, margin_key from m where margin_key <> '' group by all having count(distinct page) >= 3)
select document_id, case when exists (select 1 from r where r.document_id = m.document_id and r.margin_key = m.margin_key) then 'removed' else 'kept' end as fate,
 count(*) as n_lines from m group by all""",
)
R.add(
    "line_role_groups",
    lambda s, d: pg.role_groups(pg.lines(table(s, d, PE))),
    f"""with {_LINES},
k as (select *, case when size >= 40 and regexp_matches(trim(text), '^[0-9]+$') then 'number' when size >= 12 then 'heading' when bold and size >= 10.5
  then 'subheading' else 'text' end as role from ln),
z as (select *, case when role in ('heading', 'number') then size else 0 end as ks from k),
g as (select *, coalesce((lag(role) over w <> role or lag(ks) over w <> ks)::int, 1) as change from z window w as (partition by document_id, page_number, block_no order by line_no)),
i as (select *, sum(change) over (partition by document_id, page_number, block_no order by line_no)::bigint as group_no from g)
select document_id, page_number, block_no, group_no, role, count(*) as n_lines, sum(length(text))::bigint as n_chars from i group by all""",
)
R.add(
    "joined_blocks",
    lambda s, d: pg.block_texts(table(s, d, PE)).select("document_id", "page_number", "block_no", F.length("text").alias("n_chars"), F.md5("text").alias("digest")),
    r"""with b as (select document_id, page_number, unnest(range(len(blocks)))::int as block_no, unnest(blocks) as b from page_extractions),
t as (select document_id, page_number, block_no, list_filter(list_transform(b.lines, lambda x: regexp_replace(x.text, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as v from b),
j as (select distinct document_id, page_number, block_no, case when len(v) = 0 then '' else list_reduce(v, lambda x, y:
  case when regexp_matches(x, '\p{L}-$') and regexp_matches(y, '^\p{Ll}') then x[:-2] || y else x || ' ' || y end) end as text from t)
select document_id, page_number, block_no, length(text)::int as n_chars, md5(text) as digest from j""",
)
R.add(
    "body_font_size",
    lambda s, d: pg.body_font(pg.lines(table(s, d, PE))),
    f"""with {_LINES}, z as (select document_id, size, sum(length(text)) as n from ln group by all)
select document_id, size as body_size from z qualify row_number() over (partition by document_id order by n desc, size desc) = 1""",
)
R.add(
    "typed_lines",
    lambda s, d: pg.lines(table(s, d, PE))
    .groupBy(pg.block_type(F.col("text"), F.col("size"), F.col("bold")).alias("block_type"))
    .agg(F.count(F.lit(1)).alias("n_lines")),
    f"""with {_LINES} select case when regexp_matches(trim(text), '^\\[[0-9]+\\]') then 'footnote'
 when regexp_matches(trim(text), '^(Figura|Tabla|Gráfico|Gráfica|Fuente)([^\\p{{L}}]|$)') then 'caption' when size >= 12 then 'heading'
 when bold and size >= 10.5 then 'subheading' when regexp_matches(trim(text), '^[•●▪◦·–]') then 'list_item'
 when regexp_matches(trim(text), '^[“«"]') and regexp_matches(trim(text), '[”»"]$') then 'quote' else 'body' end as block_type, count(*) as n_lines from ln group by 1""",
)
R.add(
    "carried_headings",
    lambda s, d: pg.with_heading(co.paragraphs(s, d)).select("document_id", "paragraph_id", "heading"),
    f"""with {P} select document_id, paragraph_id, last_value(case when block_type = 'heading' then clean_text end ignore nulls)
 over (partition by document_id order by page, paragraph_id rows between unbounded preceding and current row) as heading from p""",
)
R.add(
    "page_headings",
    lambda s, d: pg.page_heading(co.paragraphs(s, d)),
    f"""with {P} select document_id, page, arg_min(clean_text, paragraph_id) filter (block_type = 'heading') as heading from p group by all""",
)
_MERGED = rf"""with {P},
b as (select *, lag(clean_text) over w as pt, lag(section) over w as ps, row_number() over w as rn from p
  where block_type in ('body', 'list_item') and clean_text is not null window w as (partition by document_id order by page, paragraph_id)),
g as (select *, case when pt is not null and not regexp_matches(pt, '[.!?:;»”")]\s*$') and ps is not distinct from section
  and (regexp_matches(clean_text, '^\p{{Ll}}') or block_type = 'body') and not regexp_matches(clean_text, '^[•●▪◦·–]') then 0 else 1 end as first from b),
i as (select *, sum(first) over (partition by document_id order by page, paragraph_id) as island from g)"""
R.add(
    "merged_paragraphs",
    lambda s, d: pg.merged_paragraphs(co.paragraphs(s, d)).drop("places"),
    _MERGED
    + """ select document_id, min(paragraph_id) as paragraph_id, count(*)::int as n_parts, (sum(length(clean_text)) + count(*) - 1)::int as n_chars
from i group by document_id, island""",
)
R.add(
    "page_of_middle",
    lambda s, d: pg.merged_paragraphs(co.paragraphs(s, d)).select(
        "document_id", "paragraph_id", pg.page_of_offset(F.col("places"), F.floor(F.col("n_chars") / 2)).alias("page")
    ),
    _MERGED
    + """, o as (select *, sum(length(clean_text) + 1) over (partition by document_id, island order by paragraph_id) - length(clean_text) - 1 as off,
  sum(length(clean_text)) over (partition by document_id, island) + count(*) over (partition by document_id, island) - 1 as total,
  min(paragraph_id) over (partition by document_id, island) as fid from i)
select document_id, fid as paragraph_id, arg_max(page, off) as page from o where off <= floor(total / 2) group by document_id, island, fid""",
)
R.add(
    "section_labels",
    lambda s, d: co.paragraphs(s, d).select("paragraph_id", pg.section_label("chapter", "level2", "level3").alias("label")),
    f"""with {P} select paragraph_id, concat_ws(' > ', case when trim(chapter) <> '' then chapter end, case when trim(level2) <> '' then level2 end,
 case when trim(level3) <> '' then level3 end) as label from p""",
)
R.add(
    "chapter_changes",
    lambda s, d: pg.chapter_changes(co.paragraphs(s, d)),
    f"""with {P}, q as (select document_id, paragraph_id, lag(chapter) over (partition by document_id order by page, paragraph_id) as prev_chapter, chapter from p)
select * from q where prev_chapter is not null and prev_chapter <> chapter""",
)
R.add(
    "longest_prefix_split",
    lambda s, d: pg.longest_prefix(
        co.paragraphs(s, d).where("section is not null"), "section", co.paragraphs(s, d).select("chapter").distinct(), "chapter", "paragraph_id"
    ),
    rf"""with {P}, n as (select distinct chapter as name from p where chapter is not null),
h as (select paragraph_id, section, name from p, n where section is not null and starts_with(lower(section), lower(name))
  and lower(split_part(section, ' ', 1)) = lower(split_part(name, ' ', 1)))
select paragraph_id, name, regexp_replace(substr(section, length(name) + 1), '^[ :—>-]+|[ :—>-]+$', '', 'g') as rest from h
qualify row_number() over (partition by paragraph_id order by length(name) desc, name desc) = 1""",
)
R.add(
    "sections_table",
    lambda s, d: co.paragraphs(s, d)
    .where("block_type <> 'heading'")
    .groupBy("chapter", "level2")
    .agg(F.min("page").alias("page_start"), F.max("page_end").alias("page_end"), F.count("paragraph_id").alias("n_paragraphs"), F.sum("n_words").alias("n_words")),
    f"""with {P} select chapter, level2, min(page) as page_start, max(page_end) as page_end, count(paragraph_id) as n_paragraphs, sum(n_words)::bigint as n_words
from p where block_type <> 'heading' group by all""",
)
R.add(
    "words_per_page",
    lambda s, d: _dense_pages(s, d),
    f"""with {P}, w as (select document_id, page, sum(n_words) as n from p group by all), m as (select document_id, max(page) as last from p group by all),
c as (select document_id, unnest(range(1, last + 1))::int as page from m)
select document_id, page, coalesce(n, 0)::bigint as n_words from c left join w using (document_id, page)""",
)


def _dense_pages(s, d):
    """Every page of every document, with 0 words where it has no paragraph."""
    p = co.paragraphs(s, d)
    words = p.groupBy("document_id", "page").agg(F.sum("n_words").alias("n"))
    pages = words.groupBy("document_id").agg(F.max("page").alias("last")).select("document_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("page"))
    return pages.join(words, ["document_id", "page"], "left").select("document_id", "page", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_words"))


R.add(
    "analytic_filter",
    lambda s, d: co.analytic(s, d).where("n_words >= 20").groupBy("block_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("n_documents")),
    f"with {A} select block_type, count(*) as n, count(distinct document_id) as n_documents from a where n_words >= 20 group by 1",
)
