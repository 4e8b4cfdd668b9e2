"""Queries of the decision tables and the evaluation with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import base, evaluate, folds, media, nested, policy
from docloom.operators.base import sql
from docloom.plans import folds as folds_plan
from docloom.plans import nested as nested_plan
from docloom.plans.scalars import _collapse, _re, _replaced, _trim, _words
from docloom.session import table

KEYS = ["doc_id", "page_num", "formula_index"]
_UNSAFE = "(contains(t, chr(65533)) or length(t) - length(replace(t, '?', '')) >= 3)"
_F = rf"f as (select *, {_trim("coalesce(source_text, '')")} as t from formulas)"
_NUM = r"nullif(regexp_extract({x}, '(?:^|\s)(\((?:[pP]\.)?[0-9]+(?:[.-][0-9]+)*\))\s*$', 1), '')"


def _n(x: str, chars: str) -> str:
    return f"(length({x}) - length(translate({x}, '{chars}', '')))"


def _times(s: str) -> str:
    return f"((length(latex) - length(replace(latex, '{s}', ''))) / {len(s)})"


def _lines(s, d):
    """Visual lines: words of a page with one baseline, joined."""
    w = folds.baseline_rows(base.words(s, d))
    parts = F.array_sort(F.collect_list(F.struct("x0", "block_id", "widx", "text")))
    return w.groupBy("doc_id", "page_num", "row").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.count(F.lit(1)).alias("n_words"), F.min("x0").alias("x0"), F.max("x1").alias("x1")
    )


def _expected(s, d):
    return base.rendered(s, d).select("doc_id", F.inline("sections")).where("title <> 'Document'").select("doc_id", "title", "level")


def _actual(s, d):
    lines = base.markdown_lines(s, d)
    return lines.select("doc_id", T.heading_title(F.col("line")).alias("title"), T.heading_level(F.col("line")).alias("level")).where("title is not null")


def _regions(s, d):
    return nested.fixture_table_regions(table(s, d, "fixture_files")).where("x0 is not null").select("fixture_id", "page_idx", F.col("region_idx").alias("idx"), "x0", "y0", "x1", "y1")


def _detected(s, d):
    """Regions as a detector might give them: moved by 6 points for each number, and every third in two halves."""
    r = _regions(s, d).withColumn("k", F.col("idx") % 3)
    moved = r.withColumns({"x0": F.col("x0") + 6 * F.col("k"), "x1": F.col("x1") + 6 * F.col("k"), "half": F.explode(F.when(F.col("k") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2))))})
    middle = (F.col("y0") + F.col("y1")) / 2
    cut = moved.withColumns({"y1": F.when(F.col("half") == 0, middle).otherwise(F.col("y1")), "y0": F.when(F.col("half") == 1, middle).otherwise(F.col("y0"))})
    return cut.select("fixture_id", "page_idx", (F.col("idx") * 2 + (F.col("half") == 1).cast("int")).alias("idx"), "x0", "y0", "x1", "y1")


def _labelled(s, d):
    """The sections of rendered documents as expected headings by page, and the headings of their Markdown."""
    page = F.coalesce("page_start", F.lit(1))
    sections = base.rendered(s, d).where("markdown is not null").select("doc_id", F.inline("sections")).where("title <> 'Document'").select("doc_id", page.alias("page"), "title", "level")
    lines = base.markdown_lines(s, d)
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    paged = lines.withColumn("page", F.coalesce(F.last(T.page_marker(F.col("line")), ignorenulls=True).over(upto), F.lit(1)).cast("bigint"))
    heads = paged.select("doc_id", "page", T.heading_title(F.col("line")).alias("title"), T.heading_level(F.col("line")).alias("level"))
    found = heads.groupBy("doc_id", "page").agg(F.count("title").alias("headings"))
    matches = evaluate.heading_matches(sections, heads.where("title is not null"), ["doc_id", "page"])
    expected = matches.select("doc_id", "page", F.col("expected").alias("headings_expected"), F.col("matched").alias("heading_matches"))
    return evaluate.labelled_pages(expected, found, ["doc_id"])


def _counts(s, d):
    blocks = base.body_blocks(s, d).groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("actual"))
    return blocks, base.pages(s, d).select("doc_id", "page_num", F.col("text_blocks").alias("expected"))


_METRICS = ["pages_with_readable_text", "image_only_pages", "low_density_pages"]

QUERIES = {
    "formula_emission": lambda s, d: policy.emission(base.formulas(s, d)).select(*KEYS, "emit", "decision"),
    "formula_emission_conservative": lambda s, d: policy.emission(base.formulas(s, d), emit="conservative").select(*KEYS, "emit", "decision"),
    "backend_rejection": lambda s, d: policy.backend_rejection(base.formulas(s, d)).select(*KEYS, "rejection"),
    "sane_latex": lambda s, d: policy.sane_latex(base.formulas(s, d)).select(*KEYS, "sane"),
    "formula_latex": lambda s, d: policy.formula_kind(base.formulas(s, d)).select(*KEYS, "text_latex"),
    "formula_index": lambda s, d: policy.formula_counts(base.formulas(s, d)),
    "formula_lines": lambda s, d: policy.line_score(_lines(s, d), base.pages(s, d)),
    "ocr_decisions": lambda s, d: policy.ocr_decision(base.triage(s, d)),
    "heading_matches": lambda s, d: evaluate.heading_matches(_expected(s, d), _actual(s, d), ["doc_id"]),
    "document_metrics": lambda s, d: evaluate.document_metrics(evaluate.heading_matches(_expected(s, d), _actual(s, d), ["doc_id"]), "doc_id"),
    "page_metrics": lambda s, d: evaluate.page_metrics(nested.fixture_pages(table(s, d, "fixture_files")), ["fixture_id", "page_idx"], "expected_formula_count", "expected_formula_detection_count", "formula_false_positive_budget"),
    "region_matches": lambda s, d: evaluate.greedy_region_matches(_regions(s, d), _detected(s, d), ["fixture_id", "page_idx"], 0.05),
    "page_results": lambda s, d: evaluate.page_results(_labelled(s, d), ["doc_id"]),
    "document_results": lambda s, d: evaluate.document_results(evaluate.page_results(_labelled(s, d), ["doc_id"]), ["doc_id"]),
    "markdown_elements": lambda s, d: evaluate.markdown_elements(base.markdown_lines(s, d), ["doc_id"]),
    "density_warnings": lambda s, d: media.density_warnings(evaluate.markdown_quality(base.markdown_lines(s, d)), 1.0, 0.5),
    "report_diff": lambda s, d: evaluate.report_diff(base.reports(s, d).select("doc_id", *_METRICS), base.triage(s, d).select("doc_id", *_METRICS), "doc_id", _METRICS),
    "count_agreement": lambda s, d: evaluate.count_agreement(*_counts(s, d), ["doc_id", "page_num"]),
    "markdown_quality": lambda s, d: evaluate.markdown_quality(base.markdown_lines(s, d)),
    "gfm_tables": lambda s, d: evaluate.gfm_tables(base.markdown_lines(s, d)),
    "numeric_leaves": lambda s, d: evaluate.numeric_leaves(table(s, d, "fixture_files").groupBy("fixture_id").agg(F.max_by("body", "received_at").alias("body")), "body", "fixture_id"),
    "numeric_rows": lambda s, d: _numeric(s, d),
}


def _numeric(s, d):
    row = T.numeric_row(F.col("line"))
    out = base.markdown_lines(s, d).select("doc_id", "line_no", row.alias("r")).where("r is not null and size(r.values) > 0")
    return out.select("doc_id", "line_no", F.col("r.label").alias("label"), F.array_join("r.values", "|").alias("values"))


def _emission(last: str) -> str:
    return sql(
        f"select doc_id, page_num, formula_index, decision in ('sidecar-recovered', 'high-confidence-local-auto', 'local-mode', 'formula-emit-all') as emit, decision from (select *, case when latex is null and t = '' then 'empty-formula-text' when {_UNSAFE} then 'unsafe-source-text' when latex is not null then 'sidecar-recovered' else {last} end as decision from f)",
        _F,
    )


_STOPS = ", ".join(f"'{w}'" for w in policy.SIDECAR_STOPWORDS)
_MD_HEAD = r"ah as (select doc_id, nullif(regexp_extract(line, '^#{1,6}\s+(\S.*?)\s*$', 1), '') as title, length(regexp_extract(line, '^(#{1,6})\s+\S', 1)) as level from markdown_lines)"
_MATCH = f"hm as (select e.doc_id, count(*) as expected, count_if(exists (select 1 from ah where ah.doc_id = e.doc_id and ah.level = e.level and lower({_collapse('ah.title')}) = lower({_collapse('e.title')}))) as matched from ex e group by 1)"
_EXPECT = "ex0 as (select doc_id, unnest(sections) as s from rendered), ex as (select doc_id, s.title as title, s.level as level from ex0 where s.title <> 'Document')"

_LABELLED = (
    r"lx0 as (select doc_id, unnest(sections) as s from rendered where markdown is not null), lx as (select doc_id, coalesce(s.page_start, 1) as page, s.title as title, s.level as level from lx0 where s.title <> 'Document')",
    r"lh as (select doc_id, line_no, coalesce(last_value(try_cast(nullif(regexp_extract(line, '^\s*<!-- page:([0-9]+) -->\s*$', 1), '') as bigint) ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding), 1) as page, nullif(regexp_extract(line, '^#{1,6}\s+(\S.*?)\s*$', 1), '') as title, length(regexp_extract(line, '^(#{1,6})\s+\S', 1)) as level from markdown_lines)",
    f"lm as (select e.doc_id, e.page, count(*) as n, count_if(exists (select 1 from lh where lh.doc_id = e.doc_id and lh.page = e.page and lh.level = e.level and lower({_collapse('lh.title')}) = lower({_collapse('e.title')}))) as hit from lx e group by 1, 2)",
    "lr as (select doc_id, page, f.n as found, m.n as expected, hit from lm m join (select doc_id, page, count(title) as n from lh group by 1, 2) f using (doc_id, page))",
)
_ZEROS = ("formula_found", "formula_expected", "formula_matches", "formula_false_positives", "detection_found", "detection_expected", "detection_matches", "detection_false_positives", "snippets_expected", "snippets_matched", "regions_found", "regions_expected", "region_matches", "decorative_expected", "decorative_suppressed", "figures_found", "figures_expected", "figure_matches", "caption_pairs_found", "caption_pairs_expected", "vector_regions_expected", "vector_regions_acknowledged")
_ONES = ("formula_recall", "formula_precision", "detection_recall", "detection_precision", "snippet_recall", "region_recall", "region_precision", "suppression_rate", "retention_rate", "pairing_rate", "acknowledgement_rate")
_FALSE = ("table_found", "table_expected", "table_true_positive", "table_false_positive")

SQL = {
    "page_results": sql(
        "select doc_id, page, found as heading_found, expected as heading_expected, hit as heading_matches, greatest(found - hit, 0) as heading_false_positives, round(case when expected = 0 then 1.0 else hit / expected end, 9) as heading_accuracy, round(case when found = 0 then 1.0 else hit / found end, 9) as heading_precision, "
        + ", ".join([*(f"cast(0 as bigint) as {c}" for c in _ZEROS), *(f"1.0::double as {c}" for c in _ONES), *(f"false as {c}" for c in _FALSE)])
        + " from lr",
        *_LABELLED,
    ),
    "document_results": sql(
        "select doc_id, count(*) as pages, 1.0::double as table_recall, 1.0::double as table_precision, round(case when sum(expected) = 0 then 1.0 else sum(hit) / sum(expected) end, 9) as heading_accuracy_micro, round(avg(round(case when expected = 0 then 1.0 else hit / expected end, 9)), 9) as heading_accuracy_macro,"
        " round(case when sum(found) = 0 then 1.0 else sum(hit) / sum(found) end, 9) as heading_precision_micro, round(avg(round(case when found = 0 then 1.0 else hit / found end, 9)), 9) as heading_precision_macro, "
        + ", ".join(f"1.0::double as {c}_{k}" for c in _ONES if c != "detection_precision" for k in ("micro", "macro"))
        + " from lr group by 1",
        *_LABELLED,
    ),
    "markdown_elements": sql(
        "select doc_id, count_if(k = 'heading') as headings, count_if(k = 'table' and pt is distinct from 'table') as tables, cast(count_if(k = 'block') // 2 + count_if(k = 'formula') as bigint) as formulas, count_if(k = 'figure') as figures,"
        " count_if(k = 'list' and pl is distinct from 'list') as lists, count_if(k = 'text' and pp is distinct from 'text') as paragraphs, cast((count_if(k = 'fence') + 1) // 2 as bigint) as code_blocks from me2 group by 1",
        r"me1 as (select doc_id, line_no, case when starts_with(t, '#') then 'heading' when starts_with(t, '$$') then 'block' when starts_with(t, '$') then 'formula' when starts_with(t, '```') then 'fence' when starts_with(t, '|') and ends_with(t, '|') then 'table' when starts_with(t, '![') and contains(t, '](') then 'figure' when regexp_matches(t, '^[-*+] ') or (regexp_matches(t, '^[0-9]\. ') and length(t) > 2) then 'list' when t = '' or starts_with(t, '<!--') then 'gap' else 'text' end as k from (select doc_id, line_no, trim(line) as t from markdown_lines))",
        "me2 as (select *, last_value(case when k not in ('heading', 'block', 'formula', 'fence') then k end ignore nulls) over w as pt, last_value(case when k not in ('heading', 'block', 'formula', 'fence', 'table', 'figure') then k end ignore nulls) over w as pl, last_value(case when k in ('text', 'gap') then k end ignore nulls) over w as pp from me1 window w as (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding))",
    ),
    "numeric_leaves": r"""
with recursive f as (select fixture_id, max_by(body, received_at) as body from fixture_files group by 1),
j as (select fixture_id, try_cast(regexp_replace(body, '^[\x{FEFF} \n\r\t]+|[\x{FEFF} \n\r\t]+$', '', 'g') as json) as v from f),
t as (select fixture_id, '' as path, v from j where v is not null
  union all select t.fixture_id, case when json_type(t.v) = 'ARRAY' then t.path || '[' || e.key || ']' when t.path = '' then e.key else t.path || '.' || e.key end, e.value from t, json_each(t.v) e where json_type(t.v) in ('ARRAY', 'OBJECT'))
select fixture_id, path, cast(v as double) as value from t where json_type(v) in ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')""",
    "formula_emission": _emission("case when confidence >= 70 then 'high-confidence-local-auto' else 'low-confidence-local-auto' end"),
    "formula_emission_conservative": _emission("'local-heuristic-rejected-by-conservative-policy'"),
    "backend_rejection": sql(
        f"select doc_id, page_num, formula_index, nullif(case when coalesce(confidence, 0) < 65 then 'candidate below sidecar confidence threshold' when visual and w > 0 and h > 0 and w / h <= 24 and not (w > 420 and (t = '' or contains(why, 'horizontal-rule'))) then '' when visual then 'visual-only crop too wide or ambiguous for sidecar OCR'"
        f" when contains(t, '<EOS>') or contains(t, '<pad>') then 'candidate contains model-special prose tokens' when equation_number is not null then '' when rel = 0 then 'candidate has no formula relation operator' when nw > 14 then 'candidate has too many words for sidecar OCR'"
        f" when instr(t, '=') > 0 and len({_words('rhs')}) >= 4 and regexp_matches(rhs, '{'|'.join(policy.DEFINITION_TERMS)}') then 'candidate looks like a variable definition line' when not contains(t, '=') and rel >= 2 and nw >= 4 then 'candidate looks like a table/range comparison'"
        f" when nw >= 10 and len(list_filter(string_split_regex(lower(t), '[^a-z]+'), lambda w: w in ({_STOPS}))) >= 3 and rel <= 1 then 'candidate looks like prose with an inline relation' when rel >= 2 or {_n('t', policy.SIDECAR_MATH)} >= 3 or (confidence >= 85 and nw <= 10) then '' else 'candidate below sidecar math-content threshold' end, '') as rejection from g",
        _F,
        f"g as (select *, len({_words('t')}) as nw, {_n('t', '=<>≤≥')} as rel, x1 - x0 as w, y1 - y0 as h, coalesce(reason, '') as why, lower(substr(t, instr(t, '=') + 1)) as rhs, (t = '' or coalesce(backend, '') = 'visual-page-render' or contains(coalesce(reason, ''), 'visual-isolated-equation-band')) as visual from f)",
    ),
    "sane_latex": sql(
        "select doc_id, page_num, formula_index, case when latex is not null then not (latex = '' or ("
        + _times("\\")
        + " > floor(greatest(y1 - y0, 1.0)) * 8 and strlen(latex) > 50) or ("
        + _times("\\left|")
        + " + "
        + _times("\\left\\|")
        + " > 3 and strlen(latex) > 100) or (strlen(latex) > floor(greatest(y1 - y0, 1.0)) * 50 and greatest(x1 - x0, 1.0) < 500) or (t <> '' and len(list_filter("
        + _words("lower(latex)")
        + ", lambda w: regexp_matches(w, '^[a-z]{9,}$') and not contains(lower(t), w))) >= 3) or ("
        + " + ".join(_times(x) for x in ("\\stackrel", "\\overset", "\\widetilde", "\\widehat"))
        + " > 5 and strlen(t) < 30)) end as sane from f",
        _F,
    ),
    "formula_latex": sql(
        rf"select doc_id, page_num, formula_index, coalesce({_trim('latex')}, case when {_NUM.format(x='t')} is not null then {_trim(_replaced(_trim(chr(114) + 'egexp_replace(t, ' + chr(39) + r'\s*\((?:[pP]\.)?[0-9]+(?:[.-][0-9]+)*\)\s*$' + chr(39) + ', ' + chr(39) * 2 + ')'), T.LATEX))} || ' \tag{{' || translate({_NUM.format(x='t')}, '()', '') || '}}' else {_trim(_replaced('t', T.LATEX))} end) as text_latex from f",
        _F,
    ),
    "formula_index": sql(
        "select doc_id, count(*) as candidates, count(distinct page_num) as pages, count_if(status = 'local-candidate') as local, count_if(status = 'needs-review') as needs_review, count_if(status = 'backend-recovered') as recovered, count(equation_number) as numbered, count(latex) as with_latex from formulas group by 1"
    ),
    "formula_lines": sql(
        rf"""select doc_id, page_num, "row", t as source_text, cast(c as int) as confidence, case when c >= 70 then 'local-candidate' else 'needs-review' end as status, array_to_string(list_filter([case when cen then 'centered' end, case when num then 'equation-number' end, case when rel then 'relation' end, case when cen and rel and n_words <= 4 then 'compact-display' end, case when m >= 2 then 'math-symbols' end, case when scr then 'script-like' end], lambda r: r is not null), '+') as reason
 from (select *, least(35 + (case when cen then 15 else 0 end) + (case when num then 22 else 0 end) + (case when rel then 15 else 0 end) + (case when cen and rel and n_words <= 4 then 10 else 0 end) + (case when m >= 2 then least(m, 5) * 4 else 0 end) + (case when scr then 8 else 0 end), 96) as c from l2)
 where strlen(t) between 3 and 180 and n_words <= 28 and (m >= 2 or rel or scr or num) and (cen or num or m >= 3) and not regexp_matches({_trim('text')}, '^/[0-9]{{1,4}}/|^\[[0-9]{{1,4}}\]\s*\S|^\([0-9]{{1,4}}\)\s*\S')
 and not (regexp_matches(lower(t), 'such as|typeset|detailed working|not reproduced') or (len({_words('t')}) >= 10 and length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) > 45 and m < 2 and not contains(t, '=')))""",
        folds_plan._ROWS,
        'l0 as (select doc_id, page_num, "row", string_agg(text, \' \' order by x0, block_id, widx) as text, count(*) as n_words, min(x0) as x0, max(x1) as x1 from br group by all)',
        "l1 as (select l0.*, coalesce(p.width, 612.0) as width from l0 left join pages p using (doc_id, page_num))",
        rf"l2 as (select *, {_trim('text')} as t, {_n('text', T.MATH)} as m, {_NUM.format(x='text')} is not null as num, regexp_matches({_trim('text')}, '[=≤≥<>]') as rel, regexp_matches({_trim('text')}, '[_₁₂^]') as scr, abs((x0 + x1) / 2 - width / 2) < width * 0.24::double as cen from l1)",
    ),
    "ocr_decisions": sql(
        "select doc_id, 'auto' as mode, case when n = 0 then 'not-needed' else 'apply' end as status, case when n = 0 then 'all-pages-readable' else 'triage' end as reason, n as pages from (select doc_id, coalesce(len(pages_needing_ocr), 0) as n from triage)"
    ),
    "heading_matches": sql("select * from hm", _EXPECT, _MD_HEAD, _MATCH),
    "document_metrics": sql(
        "select doc_id, cast(1 as bigint) as pages, expected, matched, round(case when expected = 0 then 1.0 else matched / expected end, 9) as macro, round(case when expected = 0 then 1.0 else matched / expected end, 9) as micro from hm", _EXPECT, _MD_HEAD, _MATCH
    ),
    "report_diff": sql(
        "select doc_id, metric, o.v as old, n.v as new from o full join n using (doc_id, metric) where o.v is distinct from n.v",
        *[f"{a} as ({' union all '.join(f'''select doc_id, '{m}' as metric, cast({m} as double) as v from {t}''' for m in _METRICS)})" for a, t in (("o", "reports"), ("n", "triage"))],
    ),
    "count_agreement": sql(
        "select doc_id, page_num, coalesce(actual, 0) as actual, coalesce(expected, 0) as expected, round(case when greatest(coalesce(actual, 0), coalesce(expected, 0)) = 0 then 1.0 else least(coalesce(actual, 0), coalesce(expected, 0)) / greatest(coalesce(actual, 0), coalesce(expected, 0)) end, 9) as agreement from a full join (select doc_id, page_num, text_blocks as expected from pages) using (doc_id, page_num)",
        "a as (select doc_id, page_num, count(*) as actual from body_blocks group by all)",
    ),
    "markdown_quality": sql(
        "select doc_id, count(marker) as pages, count_if(starts_with(line, '#')) as headings, count_if(starts_with(line, '|')) as table_lines, count_if(contains(line, '![')) as images, count_if(regexp_matches(line, '[A-Za-z][0-9]{2,3}\\.[0-9]{3}')) as glued_numbers, (select count(*) from e where e.doc_id = q1.doc_id and e.n = 0) as empty_pages from q1 group by doc_id",
        r"q0 as (select *, try_cast(nullif(regexp_extract(line, '^\s*<!-- page:([0-9]+) -->\s*$', 1), '') as bigint) as marker from markdown_lines)",
        "q1 as (select *, count(marker) over (partition by doc_id order by line_no rows unbounded preceding) as page_no from q0)",
        f"e as (select doc_id, page_no, count_if({_trim('line')} <> '' and marker is null) as n from q1 where page_no > 0 group by all)",
    ),
    "density_warnings": sql(
        "select doc_id, 'heading-density' as warning, round(h / greatest(p, 1), 6) as per_page from dq where h / greatest(p, 1) > 1.0"
        " union all select doc_id, 'image-density', round(i / greatest(p, 1), 6) from dq where i / greatest(p, 1) > 0.5",
        r"dq as (select doc_id, count_if(regexp_matches(line, '^\s*<!-- page:([0-9]+) -->\s*$')) as p, count_if(starts_with(line, '#')) as h, count_if(contains(line, '![')) as i from markdown_lines group by 1)",
    ),
    "gfm_tables": sql(
        rf"select doc_id, min(line_no) as first_line, count(*) as rows, max(len(string_split(regexp_replace(regexp_replace({_trim('line')}, '^\|', ''), '\|$', ''), '|'))) as columns from g where not regexp_matches(line, '^[\s|:-]+$') group by doc_id, island",
        r"g as (select *, line_no - row_number() over (partition by doc_id order by line_no) as island from markdown_lines where regexp_matches(line, '^\s*\|.*\|\s*$'))",
    ),
    "numeric_rows": sql(
        "select doc_id, line_no, label, values from (select doc_id, line_no, "
        + _trim(f"regexp_replace({_trim('l')}, ':+$', '')")
        + r""" as label, regexp_replace(run, '[\s|/\\]+', '|', 'g') as values, run from n) where run <> '' and label <> ''""",
        rf"n0 as (select *, {_collapse(_re('line'))} as t from markdown_lines)",
        f"n as (select *, regexp_extract(t, '{T._ROW}', 1) as l, regexp_extract(t, '{T._ROW}', 2) as run from n0)",
    ),
    "page_metrics": nested_plan._SQL_BASE
    + """, c as (select fixture_id, cast(page_idx as int) as page_idx, coalesce(try_cast(p ->> '$.expected_formula_count' as bigint), 0) as expected, coalesce(try_cast(p ->> '$.expected_formula_detection_count' as bigint), 0) as actual, coalesce(try_cast(p ->> '$.formula_false_positive_budget' as bigint), 0) as budget from p)
select fixture_id, page_idx, expected, actual, least(expected, actual) as hits, greatest(actual - expected - budget, 0) as over, round(case when expected = 0 then 1.0 else least(expected, actual) / expected end, 9) as recall, round(case when actual = 0 then 1.0 else least(expected, actual) / actual end, 9) as precision from c""",
}
