"""Queries of the text operators and, where SQL can express them, the SQL with the same rows."""

from __future__ import annotations

from docloom.llm import encoding, leakage, lookalikes, packing, repeated_lines, scan_noise, spam, splitting, text_kind
from docloom.session import table

_REPEATED = r"""
with b as (select doc_id, page_num, block_id, max_by(text, extracted_at) as text from raw_blocks group by all),
bl as (select doc_id, page_num, block_id, string_split(text, chr(10)) as ls from b),
fl as (select doc_id, page_num, line_idx, max(signature) as line from furniture_lines group by all),
l0 as (select 'block' as record, doc_id, page_num, block_id as item_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as line_no from bl
  union all select 'furniture', doc_id, page_num, line_idx, line, 0 from fl),
l1 as (select *, regexp_replace(regexp_replace(lower(line), '[^\p{L}\p{Nd}]+', '', 'g'), '\p{Nd}+', '0', 'g') as k from l0),
l as (select l1.*, s.source from l1 join (select doc_id, max(source) as source from inspect_reports group by 1) s using (doc_id)
  where regexp_matches(k, '\p{L}') and s.source is not null),
c as (select source, record, k, count(distinct doc_id) as n from l group by all),
z as (select s.source, count(*) as files from (select distinct doc_id from raw_blocks) d
  join (select doc_id, max(source) as source from inspect_reports group by 1) s using (doc_id) group by 1),
h as (select c.*, z.files from c join z using (source) where n >= 3 and n >= files * 0.1)
"""


def _rendered(spark, d):
    return table(spark, d, "rendered_documents")


def _layout(spark, d):
    return table(spark, d, "raw_blocks"), table(spark, d, "furniture_lines"), table(spark, d, "inspect_reports")


def _scans(spark, d):
    return table(spark, d, "raw_blocks"), table(spark, d, "ocr_triage"), table(spark, d, "inspect_reports")


def _leaks(spark, d):
    return table(spark, d, "documents"), table(spark, d, "eval_items")


QUERIES = {
    "p1_found": lambda spark, d: scan_noise.scan_defects(*_scans(spark, d)),
    "p1_repaired": lambda spark, d: scan_noise.repaired_blocks(*_scans(spark, d)),
    "p2_found": lambda spark, d: text_kind.text_kinds(_rendered(spark, d), table(spark, d, "common_words")),
    "p2_statistics": lambda spark, d: text_kind.document_statistics(_rendered(spark, d), table(spark, d, "common_words"), table(spark, d, "inspect_reports")),
    "p4_found": lambda spark, d: repeated_lines.repeated_lines(*_layout(spark, d)),
    "p4_lines": lambda spark, d: repeated_lines.repeated_line_table(*_layout(spark, d)),
    "p4_cleaned_blocks": lambda spark, d: repeated_lines.cleaned_blocks(*_layout(spark, d)),
    "p5_found": lambda spark, d: lookalikes.inconsistent(table(spark, d, "raw_words"), table(spark, d, "formula_candidates"), encoding.garbled_blocks(table(spark, d, "raw_blocks"))),
    "p5_groups": lambda spark, d: lookalikes.skeleton_groups(table(spark, d, "raw_words")),
    "p6_found": lambda spark, d: encoding.garbled_blocks(table(spark, d, "raw_blocks")),
    "p6_words": lambda spark, d: encoding.garbled_block_words(table(spark, d, "raw_blocks")),
    "p6_repaired": lambda spark, d: encoding.repaired_blocks(table(spark, d, "raw_blocks")),
    "p7_found": lambda spark, d: splitting.oversized(_rendered(spark, d)),
    "p7_pieces": lambda spark, d: splitting.rendered_pieces(_rendered(spark, d)),
    "p8_packed": lambda spark, d: packing.packed(table(spark, d, "documents")),
    "p8_containers": lambda spark, d: packing.containers(table(spark, d, "documents")),
    "p9_found": lambda spark, d: leakage.leaks(*_leaks(spark, d)),
    "p9_spans": lambda spark, d: leakage.leak_spans(*_leaks(spark, d)),
    "p10_found": lambda spark, d: spam.spam_documents(table(spark, d, "documents"), table(spark, d, "common_words")),
    "p10_shares": lambda spark, d: spam.spam_shares(table(spark, d, "documents"), table(spark, d, "common_words")),
}

SQL = {
    "p4_found": _REPEATED
    + "select record, doc_id, page_num, item_id, cast(line_no as bigint) as line_no from l where exists (select 1 from h where h.source = l.source and h.record = l.record and h.k = l.k)",
    "p4_lines": _REPEATED + "select source, record, k as key, n as n_files, files from h",
    "p4_cleaned_blocks": _REPEATED
    + """, k as (select bl.*, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as line from bl where ls is not null)
select k.doc_id, k.page_num, k.block_id, coalesce(string_agg(k.line, chr(10) order by k.line_no) filter (where x.line_no is null), '') as text from k
left join (select doc_id, page_num, item_id, line_no from l where record = 'block' and exists (select 1 from h where h.source = l.source and h.record = l.record and h.k = l.k)) x
on x.doc_id = k.doc_id and x.page_num = k.page_num and x.item_id = k.block_id and x.line_no = k.line_no group by all""",
    "p7_found": """
with r as (select doc_id, max_by(markdown, rendered_at) as markdown, max_by(sections, rendered_at) as sections from rendered_documents group by 1),
s as (select doc_id, unnest(sections) as s, generate_subscripts(sections, 1) - 1 as i from r)
select doc_id, cast(-1 as bigint) as section_idx from r where length(markdown) > 4000
union all select doc_id, cast(i as bigint) from s where length(s.content) > 4000""",
    "p9_found": r"""
with d as (select distinct doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items where text is not null),
ds as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as s from d where len(w) >= 12),
si as (select item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as s from i where len(w) >= 12)
select distinct ds.doc_id, si.item_id from ds join si on ds.s = si.s""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
