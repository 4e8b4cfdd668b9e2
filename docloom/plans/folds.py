"""Queries of the ordered folds with their SQL."""

from __future__ import annotations

from docloom.functions import predicates as P
from docloom.functions import text as T
from docloom.operators import base, folds, render
from docloom.operators.base import sql
from docloom.plans import facts as facts_plan
from docloom.plans.scalars import WS, _collapse, _has, _re, _trim, _value, _words

_ROWS = """br0 as (select *, coalesce(baseline_y, y1) as base from words),
br1 as (select *, case when base - lag(base) over w > 3 or lag(base) over w is null then 1 else 0 end as isnew from br0 window w as (partition by doc_id, page_num order by base, x0, block_id, widx)),
br as (select *, sum(isnew) over (partition by doc_id, page_num order by base, x0, block_id, widx rows unbounded preceding) as "row" from br1)"""
_WIDTHS = 'rw as (select doc_id, page_num, "row", count(*) as n from br group by all), rc as (select doc_id, page_num, n, count(*) as hits from rw where n >= 2 group by all), rm as (select distinct on (doc_id, page_num) doc_id, page_num, n, hits from rc order by doc_id, page_num, hits desc, n desc)'
_DATA = f"(len({_words('line')}) >= 4 and (len(list_filter({_words('line')}, lambda w: {_value('w')})) * 100 // greatest(len({_words('line')}), 1) >= 55 or (len(list_filter({_words('line')}, lambda w: length(regexp_replace(w, '[^0-9]', '', 'g')) >= 6)) > 0 and len(list_filter({_words('line')}, lambda w: {_value('w')})) >= 4)))"
_STRUCT = rf"regexp_matches({_trim('line')}, '^(#|<!--|\||!\[|\$\$|- |\*Figure|[0-9]+\. )|^\*(?s:.*)\*$')"
_CLS = (facts_plan._PAGE, facts_plan._BODY, facts_plan._BASE, facts_plan._LEVEL)


_LABEL = _trim("regexp_replace(" + _trim(_re("label")) + ", ':+$', '')")


def _is_field(t: str) -> str:
    return f"(ends_with({_trim(t)}, ':') and strlen({_trim(t)}) <= 48 and len({_words(t)}) <= 6 and not contains({_trim(t)}, '.'))"


def _is_choice(w: str) -> str:
    return rf"(len({w}) between 2 and 8 and len(list_filter({w}, lambda x: strlen(x) <= 18 and regexp_matches(x, '[\p{{L}}\p{{N}}]') and not regexp_matches(x, '[:.,]'))) = len({w}))"


def _md(s, d):
    return base.markdown_lines(s, d)


QUERIES = {
    "largest_gap": lambda s, d: folds.largest_gap(base.body_blocks(s, d)),
    "word_builder": lambda s, d: folds.word_builder(base.words(s, d)),
    "row_width_mode": lambda s, d: folds.row_width_mode(base.words(s, d)),
    "column_centres": lambda s, d: folds.column_centres(base.words(s, d)),
    "table_evidence": lambda s, d: folds.table_evidence(base.words(s, d), base.pages(s, d)),
    "upper_median_font": lambda s, d: folds.upper_median_font(base.words(s, d)),
    "adaptive_tolerance": lambda s, d: folds.adaptive_tolerance(base.words(s, d)),
    "row_runs": lambda s, d: folds.data_runs(_md(s, d), ["doc_id"]),
    "sections": lambda s, d: folds.sections(_md(s, d)),
    "list_numbering": lambda s, d: folds.list_numbering(_md(s, d)),
    "adjacent_distinct": lambda s, d: folds.adjacent_distinct(_md(s, d)),
    "merged_paragraphs": lambda s, d: folds.merged_paragraphs(_md(s, d)),
    "grid_pivot": lambda s, d: folds.grid_pivot(base.words(s, d)),
    "title_candidate": lambda s, d: folds.title_candidates(facts_plan._classified(s, d), base.pages(s, d)),
    "top_formulas": lambda s, d: folds.top_per_page(base.formulas(s, d).where("confidence is not null"), ["formula_index"], "confidence", 2).select("doc_id", "page_num", "formula_index", "confidence", "rank"),
}
QUERIES |= {
    "text_runs": lambda s, d: folds.text_runs(facts_plan._classified(s, d)),
    "scholarly_pages": lambda s, d: render.scholarly_pages(facts_plan._classified(s, d)),
    "implicit_tables": lambda s, d: folds.implicit_tables(_md(s, d).selectExpr("doc_id", "cast(0 as bigint) as page_num", "line_no as block_id", "line_no as reading_order", "line as text")),
    "form_fields": lambda s, d: folds.form_fields(_md(s, d), ["doc_id"]),
}

SQL = {
    "largest_gap": sql(
        "select distinct on (doc_id, page_num) doc_id, page_num, round(y0 - above, 6) as gap, round((y0 + above) / 2, 6) as cut from g where y0 - above > 2 order by doc_id, page_num, round(y0 - above, 6) desc, y0",
        "g as (select *, max(y1) over (partition by doc_id, page_num order by y0, x0, block_id rows between unbounded preceding and 1 preceding) as above from body_blocks)",
    ),
    "word_builder": sql(
        "select doc_id, page_num, block_id, line_id, word_no, string_agg(text, '' order by x0, widx) as text, min(x0) as x0, max(x1) as x1 from n group by doc_id, page_num, block_id, line_id, word_no",
        "g as (select *, coalesce(case when x0 - lag(x1) over w > 0.55::double * greatest(font_size, lag(font_size) over w) then 1 else 0 end, 1) as isnew, lag(x1) over w is null as isfirst from words window w as (partition by doc_id, page_num, block_id, line_id order by x0, widx))",
        "n as (select *, sum(case when isfirst then 1 else isnew end) over (partition by doc_id, page_num, block_id, line_id order by x0, widx rows unbounded preceding) as word_no from g)",
    ),
    "row_width_mode": sql("select rm.doc_id, rm.page_num, n as columns, hits, (select sum(hits) from rc where rc.doc_id = rm.doc_id and rc.page_num = rm.page_num) as rows from rm", _ROWS, _WIDTHS),
    "column_centres": sql(
        "select p.doc_id, p.page_num, ordinal, round(avg((x0 + x1) / 2), 6) as centre, count(*) as n from p join rm on rm.doc_id = p.doc_id and rm.page_num = p.page_num and rm.n = p.w group by all",
        _ROWS,
        _WIDTHS,
        'p as (select *, row_number() over (partition by doc_id, page_num, "row" order by x0, block_id, widx) as ordinal, count(*) over (partition by doc_id, page_num, "row") as w from br)',
    ),
    "table_evidence": sql(
        "select doc_id, page_num, rows, round(c, 9) as row_consistency, round(al, 9) as column_alignment, round(nd, 9) as numeric_density, round(pp, 9) as prose_penalty,"
        " round(least(greatest(c * 0.32::double + al * 0.24::double + nd * 0.24::double + 0.02::double + (case when rows <= 3 then 0.0 when rows <= 6 then 0.04 when rows <= 9 then 0.08 else 0.12 end)::double - pp, 0.0), 1.0), 9) as score from"
        " (select *, greatest(least(c * 0.70::double + least(wide / greatest(coalesce(pw, 612.0), 1.0), 1.0) * 0.30::double + (case when cols >= 6 then 0.05 else 0.0 end)::double, (case when hits < rows then 0.68 else 1.0 end)::double), 0.0) as al from"
        " (select e.*, h.hits, h.cols, hits / rows as c, vals / words as nd, prose / rows * 0.25::double as pp, p.pw from (select doc_id, page_num, count(*) as rows, sum(n) as words, sum(vals) as vals, max(wide) as wide, count_if(n >= 6 and stop and vals = 0) as prose from e group by all) e"
        " join (select distinct on (doc_id, page_num) doc_id, page_num, hits, n as cols from (select doc_id, page_num, n, count(*) as hits from e group by all) order by doc_id, page_num, hits desc, n desc) h using (doc_id, page_num)"
        " left join (select doc_id, page_num, max(width) as pw from pages group by all) p using (doc_id, page_num)))",
        _ROWS,
        f"""e as (select doc_id, page_num, "row", count(*) as n, count_if({_value("text")}) as vals, max(x1) - min(x0) as wide, bool_or(lower(text) in ({", ".join(f"'{w}'" for w in P.STOPWORDS)})) as stop from br group by all)""",
    ),
    "upper_median_font": sql("select doc_id, page_num, greatest(list_sort(list(font_size))[count(*) // 2 + 1], 1.0) as font_size from words group by all"),
    "adaptive_tolerance": sql(
        "select doc_id, page_num, round(case when len(gs) >= 3 then least(greatest(gs[cast(least(floor(len(gs) * 0.7::double), len(gs) - 1) as int) + 1], 25.0), 50.0) else 35.0 end, 6) as tolerance from (select p.doc_id, p.page_num, coalesce(gs, []) as gs from (select distinct doc_id, page_num from words) p left join (select doc_id, page_num, list(g order by g) as gs from (select doc_id, page_num, x0 - lag(x0) over (partition by doc_id, page_num order by x0) as g from words) where g > 5 group by all) using (doc_id, page_num))"
    ),
    "row_runs": sql(f"select doc_id, min(line_no) as first_line, count(*) as n_lines from (select doc_id, line_no, line_no - row_number() over (partition by doc_id order by line_no) as island from markdown_lines where {_DATA}) group by doc_id, island having count(*) >= 3"),
    "sections": sql(
        f"select doc_id, section_no, coalesce(title, 'Document') as title, cast(coalesce(level, 1) as int) as level, content, page_start, coalesce(lead(page_start) over (partition by doc_id order by section_no), last_page) as page_end from (select doc_id, section_no, max(title) as title, max(level) as level, {_trim('coalesce(string_agg(case when marker is null and level is null then line end, chr(10) order by line_no), chr(32))')} as content, min_by(page, line_no) as page_start, max(page) as last_page from s2 group by 1, 2) where title is not null or content <> ''",
        r"s0 as (select *, try_cast(nullif(regexp_extract(line, '^\s*<!-- page:([0-9]+) -->\s*$', 1), '') as bigint) as marker, nullif(length(regexp_extract(line, '^(#{1,6})\s+\S', 1)), 0) as level, nullif(regexp_extract(line, '^#{1,6}\s+(\S.*?)\s*$', 1), '') as title from markdown_lines)",
        "s2 as (select *, coalesce(last_value(marker ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding), 1) as page, count(level) over (partition by doc_id order by line_no rows unbounded preceding) as section_no from s0)",
    ),
    "list_numbering": sql(
        "select doc_id, line_no, min(line_no) over (partition by doc_id, island) as run, ordered, depth, case when ordered then row_number() over (partition by doc_id, island, ordered, depth order by line_no) end as number from (select *, line_no - row_number() over (partition by doc_id order by line_no) as island from i)",
        rf"i as (select doc_id, line_no, regexp_matches(line, '{P.ORDERED}') as ordered, cast(length(replace(regexp_extract(line, '^([ \t]*)', 1), chr(9), '  ')) // 2 as int) as depth from markdown_lines where regexp_matches(line, '{P.ORDERED}') or regexp_matches(line, '{P.UNORDERED}'))",
    ),
    "text_runs": sql(
        "select doc_id, page_num, block_id, least(max(n) over (partition by doc_id, page_num, island) - n + 1, 18) as run_length from (select *, n - row_number() over (partition by doc_id, page_num order by reading_order, block_id) as island from (select *, row_number() over (partition by doc_id, page_num order by reading_order, block_id) as n from cl3) where kind in ('Paragraph', 'ListItem'))",
        *_CLS,
    ),
    "scholarly_pages": sql(
        rf"select doc_id, page_num, blocks, abstract_at, metadata from (select doc_id, page_num, count(*) as blocks, min(case when lower(t) = 'abstract' or regexp_extract(t, '(?is)^abstract[{WS}:—–-]*(.*)$', 1) <> '' then p end) as abstract_at, count_if((regexp_matches(t, '{P.SCHOLARLY}') or regexp_matches(t, '{P.NOTE}')) and p < 16) as metadata from"
        " (select *, row_number() over (partition by doc_id order by reading_order, block_id) - 1 as p from cl3 where page_num = 0 and kind not in ('PageNumber', 'RunningHeader', 'RunningFooter', 'Artifact')) group by 1, 2) where blocks >= 3 and (abstract_at is not null or metadata > 0)",
        *_CLS,
    ),
    "form_fields": sql(
        rf"select doc_id, line_no, {_LABEL} as label, value from (select *, count(*) over (partition by doc_id, run) as size from (select *, sum(n) over (partition by doc_id order by line_no rows unbounded preceding) as run from (select *, case when line_no - lag(line_no) over (partition by doc_id order by line_no) > 2 or lag(line_no) over (partition by doc_id order by line_no) is null then 1 else 0 end as n from q2 where {_is_field('label')} and value is not null))) where size >= 3",
        rf"q1 as (select doc_id, line_no, regexp_extract(line, '^([^:]*:)', 1) as label, {_trim("regexp_extract(line, '^[^:]*:(.*)$', 1)")} as inl, {_trim('lead(line) over (partition by doc_id order by line_no)')} as nx from markdown_lines)",
        rf"q2 as (select doc_id, line_no, label, case when inl <> '' then case when strlen(inl) <= 60 and not contains(inl, '.') then inl end when {_is_choice(_words('nx'))} then array_to_string({_words('nx')}, ' | ') when nx <> '' and not {_is_field('nx')} and not {_is_choice(_words('nx'))} and strlen(nx) <= 48 and len({_words('nx')}) <= 6 then nx end as value from q1)",
    ),
    "adjacent_distinct": sql("select doc_id, line_no, line from (select *, lag(line) over (partition by doc_id order by line_no) as l from markdown_lines) where line is distinct from l"),
    "merged_paragraphs": sql(
        f"select doc_id, paragraph, count(*) as n_blocks, replace(replace(string_agg({_trim('line')}, chr(10) order by line_no), '-' || chr(10), ''), chr(10), ' ') as text from m2 group by 1, 2",
        rf"mf as (select *, starts_with({_trim('line')}, '```') or coalesce(sum(case when starts_with({_trim('line')}, '```') then 1 else 0 end) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as fenced from markdown_lines)",
        rf"m0 as (select *, lag(line) over (partition by doc_id order by line_no) as p, lag(line_no) over (partition by doc_id order by line_no) as pn from mf where {_trim('line')} <> '' and not {_STRUCT} and not fenced)",
        rf"m1 as (select *, coalesce(pn = line_no - 1 and (regexp_matches(p, '-[{WS}]*$') or regexp_matches(line, '^[{WS}]*[\p{{Ll}},;:)\]]') or not regexp_matches(p, '[.!?:][\"'')\]{WS}]*$')), false) as joins from m0)",
        "m2 as (select *, sum(case when joins then 0 else 1 end) over (partition by doc_id order by line_no rows unbounded preceding) as paragraph from m1)",
    ),
    "grid_pivot": sql("select doc_id, page_num, cast(\"row\" as bigint) as \"row\", string_agg(replace(text, '|', '\\|'), ' | ' order by x0, block_id, widx) as cells from br group by doc_id, page_num, \"row\"", _ROWS),
    "title_candidate": sql(
        "select distinct on (doc_id) doc_id, block_id, score from tc order by doc_id, score desc, reading_order, block_id",
        *_CLS,
        rf"tc as (select doc_id, block_id, reading_order, round(font_size * 6 - y0 * 0.03::double + (case when kind = 'Heading' then 20 else 0 end) + (case when {_has(_words('t'), P.TITLE_STOPWORDS)} then 6 else 0 end) - (case when strlen(t) > 140 then 8 else 0 end) - (case when length(regexp_replace(t, '[^0-9]', '', 'g')) > 8 then 12 else 0 end), 6) as score"
        rf" from cl3 where page_num = 0 and t <> '' and y0 <= height * 0.38::double and kind not in ('PageNumber', 'RunningHeader', 'RunningFooter') and not regexp_matches(t, '{P.SCHOLARLY}') and not regexp_matches(t, '{P.NOTE}') and not starts_with(lower(t), 'abstract')"
        rf" and not contains(t, '@') and not regexp_matches(t, '{P.AFFILIATION}') and (len({_words('t')}) >= 3 or strlen(t) >= 24)"
        rf" and not (regexp_matches(t, '^\s*[0-9]+(?:\.[0-9]+)?\.?\s*(?:[0-9]+\.?\s*)?(Introduction|Contents|Summary|Background|Methods?|Approach|Related Work|Experiments?|Results?|Conclusion|Overview)\b') or lower(t) in ('introduction', 'contents', 'summary')))",
    ),
    "top_formulas": sql("select * from (select doc_id, page_num, formula_index, confidence, row_number() over (partition by doc_id, page_num order by confidence desc, formula_index) as rank from formulas where confidence is not null) where rank <= 2"),
    "implicit_tables": sql(
        "select k.doc_id, k.page_num, min(reading_order) as first_order, count(*) as n_rows, k.v as n_values, string_agg(label || '|' || values, chr(10) order by reading_order, block_id) as rows from k join m on m.doc_id = k.doc_id and m.page_num = k.page_num and m.island = k.island and m.v = k.v group by k.doc_id, k.page_num, k.island, k.v having count(*) >= 3",
        "i0 as (select doc_id, cast(0 as bigint) as page_num, line_no as block_id, line_no as reading_order, line as text, row_number() over (partition by doc_id order by line_no) as n from markdown_lines)",
        rf"i1 as (select *, regexp_extract(t, '{T._ROW}', 1) as l, regexp_extract(t, '{T._ROW}', 2) as run from (select *, {_collapse(_re('text'))} as t from i0))",
        "i2 as (select *, " + _trim(f"regexp_replace({_trim('l')}, ':+$', '')") + r""" as label, regexp_replace(run, '[\s|/\\]+', '|', 'g') as values from i1)""",
        "k0 as (select *, len(string_split(values, '|')) as v from i2 where run <> '' and label <> '')",
        "k as (select *, n - row_number() over (partition by doc_id, page_num order by reading_order, block_id) as island from k0)",
        "m as (select distinct on (doc_id, page_num, island) doc_id, page_num, island, v from (select doc_id, page_num, island, v, count(*) as hits from k group by all) order by doc_id, page_num, island, hits desc, v desc)",
    ),
}
