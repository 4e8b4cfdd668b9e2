"""Queries of the scalar functions and predicates over the layout tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import predicates as P
from docloom.functions import text as T
from docloom.operators import base

WS = T.WS
#: Words that mark prose, as SQL.
_STOP = "[" + ", ".join(f"'{w}'" for w in P.STOPWORDS) + "]"

_BASES = {
    "blocks": (base.blocks, "blocks", base.BLOCK_KEYS, "text"),
    "lines": (base.lines, "block_lines", [*base.BLOCK_KEYS, "line_no"], "line"),
    "markdown": (base.markdown_lines, "markdown_lines", ["doc_id", "line_no"], "line"),
    "formulas": (base.formulas, "formulas", ["doc_id", "page_num", "formula_index"], "source_text"),
}


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'), ' ')"


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[{WS}]+'), lambda w: w <> '')"


def _spacing(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(^|[^\p{{L}}])([0-9])(\p{{Lu}}\p{{Ll}})', '\1\2 \3', 'g'), '([0-9]\.)(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"


def _replaced(x: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        x = f"replace({x}, {_quote(a)}, {_quote(b)})"
    return x


def _quote(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" if ord(c) < 32 or c == "�" else "'" + c.replace("'", "''") + "'" for c in s) if s else "''"


def _clean(x: str) -> str:
    x = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = rf"regexp_replace({x}, '{T.INVISIBLE}', '', 'g')"
    x = f"translate({x}, chr(160) || chr(8239) || chr(8208) || chr(8209), '  --')"
    x = _replaced(x, T.LIGATURES)
    x = rf"regexp_replace({x}, '{T.CONTROLS}', '', 'g')"
    return _spacing(f"replace({x}, '-' || chr(10), '-')")


def _title(x: str) -> str:
    ws = _words(x)
    return rf"(len({ws}) between 1 and 12 and len(list_filter({ws}, lambda w: regexp_matches(w, '^\p{{Lu}}'))) >= 0.6 * len({ws}))"


def _value(x: str) -> str:
    t = f"regexp_replace({x}, '^[,;:†‡*]+|[,;:†‡*]+$', '', 'g')"
    digits = f"length(regexp_replace({t}, '[^0-9]', '', 'g'))"
    return rf"({t} in ('-', '–', '—') or ({digits} > 0 and regexp_matches({t}, '^[0-9A-Za-z.,/\-–—\"''+±]+$') and {digits} * 2 >= length({t})))"


def _has(ws: str, listed: tuple[str, ...]) -> str:
    return f"list_has_any(list_transform({ws}, lambda w: lower(w)), [{', '.join(repr(w) for w in listed)}])"


def _label(x: str) -> str:
    t = _trim(x)
    return f"(ends_with({t}, ':') and strlen({t}) <= 48 and len({_words(t)}) <= 6 and not contains({t}, '.'))"


def _choice(x: str) -> str:
    return rf"(len({_words(x)}) between 2 and 8 and len(list_filter({_words(x)}, lambda w: not (strlen(w) <= 18 and regexp_matches(w, '[\p{{L}}\p{{N}}]') and not regexp_matches(w, '[:.,]')))) = 0)"


def _author(x: str) -> str:
    ws = rf"list_filter(string_split_regex({x}, '[{WS},;]+'), lambda w: w <> '')"
    return (
        rf"(len({ws}) between 2 and 16 and len(list_filter({ws}, lambda w: regexp_matches(w, '^[^\p{{L}}]*\p{{Lu}}'))) * 5 >= len({ws}) * 4 and not {_has(ws, P.NAME_STOPWORDS)}"
        rf" and len(list_filter({ws}, lambda w: regexp_matches(w, '^[^\p{{L}}]*\p{{Ll}}'))) = 0)"
    )


#: Titles of a domain that are headings whatever their size, a parameter of the operator.
LISTED = {"Contents": 1, "Load Tests": 2, "Notes": 3, "General": 2}
#: A phrase to search for.
PHRASE = "the  Pump"

#: name: (base, Spark column, SQL expression) of functions that give a value for each row.
VALUES = {
    "clean_text": ("blocks", T.clean_text, _clean),
    "section_label_spacing": ("markdown", T.section_label_spacing, _spacing),
    "normalize_paragraphs": ("blocks", T.paragraph_text, lambda x: _collapse(f"replace({x}, '-' || chr(10), '-')")),
    "front_matter_text": ("blocks", T.front_matter_text, lambda x: f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {_trim('l')}), lambda l: l <> ''), chr(10))"),
    "clean_glyphs": ("blocks", T.clean_glyphs, lambda x: _collapse(_replaced(f"translate({x}, chr(160) || chr(173) || chr(8203) || chr(8204) || chr(8205) || chr(65533), ' ')", {k: v for k, v in T.LIGATURES.items() if v != "st"} | {"\uf0b7": "- ", "•": "- "}))),
    "furniture_tokens": ("lines", T.furniture_token, lambda x: rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g'))"),
    "strip_scripts": ("formulas", T.strip_scripts, lambda x: rf"regexp_replace({x}, '[_^]\{{([^}}]*)(?:\}}|$)', '\1', 'g')"),
    "table_cells_escaped": ("markdown", T.table_cell, lambda x: f"replace({x}, '|', '\\|')"),
    "comment_attributes": ("blocks", T.comment_attribute, lambda x: _replaced(x, {"&": "&amp;", '"': "&quot;", "--": "- -"})),
    "unicode_to_latex": ("formulas", T.unicode_to_latex, lambda x: _replaced(x, T.LATEX)),
    "equation_numbers": ("formulas", T.equation_number, lambda x: rf"nullif(regexp_extract({x}, '(?:^|\s)(\((?:[pP]\.)?[0-9]+(?:[.-][0-9]+)*\))\s*$', 1), '')"),
    "math_score": ("formulas", lambda c: T.math_score(c).cast("bigint"), lambda x: f"cast(length({x}) - length(translate({x}, '{T.MATH}', '')) as bigint)"),
    "strip_list_numbers": ("markdown", T.strip_list_number, lambda x: _re(x)),
    "abstract_text": ("blocks", T.abstract_text, lambda x: rf"nullif(regexp_extract({_trim(x)}, '(?is)^abstract[{WS}:—–-]*(.*)$', 1), '')"),
    "listed_heading_levels": ("lines", lambda c: P.listed_heading_level(c, LISTED), lambda x: "case " + " ".join(f"when lower({_collapse(x)}) = '{t.lower()}' then {v}" for t, v in LISTED.items()) + " end"),
    "field_labels": ("markdown", T.field_label, lambda x: _trim(f"regexp_replace({_trim(_re(x))}, ':+$', '')")),
}


def _re(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '^[0-9]+[.)][{WS}]+([^{WS}])', '\1')"


#: name: (base, Spark predicate, SQL predicate) of filters; the rows that pass come out with their text.
FILTERS = {
    "page_numbers": ("blocks", P.is_page_number, lambda x: rf"not contains({x}, chr(10)) and regexp_matches({x}, '{P.PAGE_NUMBER}')"),
    "ordered_items": ("lines", P.is_ordered_item, lambda x: f"regexp_matches({x}, '{P.ORDERED}')"),
    "unordered_items": ("lines", P.is_unordered_item, lambda x: f"regexp_matches({x}, '{P.UNORDERED}')"),
    "captions": ("blocks", P.is_caption, lambda x: f"regexp_matches({x}, '{P.CAPTION}')"),
    "caption_like": ("blocks", P.is_caption_like, lambda x: rf"regexp_matches(lower({_trim(x)}), '^(figure|fig\.|fig |table|exhibit|plate)')"),
    "code_lines": ("markdown", P.is_code, lambda x: f"regexp_matches({x}, '{P.CODE}')"),
    "scholarly_notes": ("blocks", P.is_scholarly, lambda x: f"(regexp_matches({x}, '{P.SCHOLARLY}') or regexp_matches({x}, '{P.NOTE}'))"),
    "title_case": ("lines", P.is_title_case, _title),
    "value_tokens": ("lines", lambda c: F.exists(T.words(c), P.is_value_token), lambda x: f"len(list_filter({_words(x)}, lambda w: {_value('w')})) > 0"),
    "data_rows": ("markdown", lambda c: P.is_data_row(T.words(c)), lambda x: f"(len({_words(x)}) >= 4 and (len(list_filter({_words(x)}, lambda w: {_value('w')})) * 100 // greatest(len({_words(x)}), 1) >= 55 or (len(list_filter({_words(x)}, lambda w: length(regexp_replace(w, '[^0-9]', '', 'g')) >= 6)) > 0 and len(list_filter({_words(x)}, lambda w: {_value('w')})) >= 4)))"),
    "prose_rows": ("lines", lambda c: P.is_prose_row(T.words(c)), lambda x: f"(len({_words(x)}) >= 6 and {_has(_words(x), P.STOPWORDS)} and len(list_filter({_words(x)}, lambda w: {_value('w')})) = 0)"),
    "header_rows": ("lines", P.is_header_row, lambda x: f"(len({_words(x)}) between 1 and 24 and (" + " or ".join(f"contains(lower({x}), '{w}')" for w in P.HEADER_WORDS) + "))"),
    "reference_lines": ("markdown", P.is_reference_line, lambda x: rf"regexp_matches({_trim(x)}, '^/[0-9]{{1,4}}/|^\[[0-9]{{1,4}}\]\s*\S|^\([0-9]{{1,4}}\)\s*\S')"),
    "unsafe_sources": ("blocks", P.is_unsafe_source, lambda x: f"(contains({x}, chr(65533)) or length({x}) - length(replace({x}, '?', '')) >= 3)"),
    "form_labels": ("markdown", lambda c: P.is_field_label(F.regexp_extract(c, "^([^:]*:)", 1)), lambda x: _label(f"regexp_extract({x}, '^([^:]*:)', 1)")),
    "choice_lines": ("markdown", P.is_choice_line, _choice),
    "field_values": ("markdown", P.is_field_value, lambda x: f"({_trim(x)} <> '' and not {_label(_trim(x))} and not {_choice(_trim(x))} and strlen({_trim(x)}) <= 48 and len({_words(x)}) <= 6)"),
    "author_lines": ("lines", P.is_author_line, _author),
    "title_stopwords": ("lines", P.has_title_stopword, lambda x: _has(_words(x), P.TITLE_STOPWORDS)),
    "sentence_ends": ("blocks", P.ends_sentence, lambda x: rf"regexp_matches({x}, '[.!?:][\"'')\]{WS}]*$')"),
    "affiliation_lines": ("lines", P.is_affiliation, lambda x: f"(contains({x}, '@') or regexp_matches({x}, '{P.AFFILIATION}'))"),
    "structural_lines": ("markdown", P.is_structural, lambda x: rf"regexp_matches({_trim(x)}, '^(#|<!--|\||!\[|\$\$|- |\*Figure|[0-9]+\. )|^\*(?s:.*)\*$')"),
    "formula_content": ("formulas", lambda c: P.is_formula_content(T.words(F.coalesce(c, F.lit(""))), F.coalesce(c, F.lit(""))), lambda x: rf"(len(list_filter({_words(f"coalesce({x}, '')")}, lambda w: {_trim('w')} in ('∑','∏','∫','√','∂','∞','=','+','−','≤','≥','≠','≈','→','⇒','×','÷') or regexp_matches(w, '[₁₂₃ⁱⁿ]'))) > 0 or regexp_matches(coalesce({x}, ''), '[_^]|\\frac|\\sum'))"),
    "formula_noise": ("markdown", P.is_formula_noise, lambda x: rf"({_trim(x)} not in ('+','−','=','×','÷','≤','≥','∑','∏','∫','√') and ({_trim(x)} = '' or (starts_with({_trim(x)}, '(') and ends_with({_trim(x)}, ')') and strlen({_trim(x)}) <= 6) or regexp_matches({_trim(x)}, 'http|www|://|\.com|\.org') or {_trim(x)} in ('•', '·', '●', '◦') or regexp_matches({_trim(x)}, '^[!-/:-@\[-`{{-~]+$')))"),
    "phrase_blocks": ("blocks", lambda c: P.contains_phrase(c, F.lit(PHRASE)), lambda x: f"contains(lower({_collapse(x)}), '{' '.join(PHRASE.lower().split())}')"),
    "readable_blocks": ("blocks", P.is_readable, lambda x: rf"regexp_matches({x}, '[\p{{L}}\p{{N}}]')"),
}


def _spark_value(kind, fn):
    read, _, keys, col = _BASES[kind]
    return lambda spark, d: read(spark, d).where(F.col(col).isNotNull()).select(*keys, fn(F.col(col)).alias("value"))


def _spark_filter(kind, fn):
    read, _, keys, col = _BASES[kind]
    return lambda spark, d: read(spark, d).where(fn(F.col(col))).select(*keys, F.col(col).alias("text"))


QUERIES = {n: _spark_value(k, f) for n, (k, f, _) in VALUES.items()} | {n: _spark_filter(k, f) for n, (k, f, _) in FILTERS.items()}
SQL = {n: base.sql(f"select {', '.join(_BASES[k][2])}, {e(_BASES[k][3])} as value from {_BASES[k][1]} where {_BASES[k][3]} is not null") for n, (k, _, e) in VALUES.items()} | {
    n: base.sql(f"select {', '.join(_BASES[k][2])}, {_BASES[k][3]} as text from {_BASES[k][1]} where {e(_BASES[k][3])}") for n, (k, _, e) in FILTERS.items()
}
