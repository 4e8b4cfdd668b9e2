"""Predicates on blocks, lines and words as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import WS, collapse, trim, words

#: Fixed patterns of what lines look like.
PAGE_NUMBER = r"^\s*[-–—]?\s*[0-9]+\s*[-–—]?\s*$|^\s*[Pp]age\s+[0-9]+\s*$"
ORDERED = r"^\s*([0-9]+[.)]\s+|\(?[a-zA-Z][.)]\s+)"
UNORDERED = r"^\s*[•·▪▸►\-*]\s+"
CAPTION = r"(?i)^\s*(figure|fig\.?|table|tbl\.?|algorithm|listing|exhibit)\s+[0-9ivx]+[.:)]"
CODE = r"^\s*(```|~~~|def |fn |pub |class |import |from |#include|int |void |return )"
SCHOLARLY = r"(?i)^\s*(arxiv:\S+|doi:\S+|https?://doi\.org/\S+|preprint\b|accepted at\b|published as\b)"
NOTE = r"(?i)(permission to make digital|all rights reserved|copyright held by|acm isbn|provided proper attribution|correspondence to:)"
NUMBERED = r"^\s*([0-9]+(?:\.[0-9]+)*)([.)])?\s+(.+\S)\s*$"
#: Words that mark a prose row among table rows.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with", "without")
#: Words that no author line has.
NAME_STOPWORDS = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with")
#: Words that a title tends to have.
TITLE_STOPWORDS = ("a", "about", "against", "all", "and", "are", "for", "from", "in", "is", "of", "on", "the", "to", "with")
#: Words of an affiliation.
AFFILIATION = (
    r"(?i)(?:^|[^\p{L}\p{N}_])(university|institute|department|school|college|research|laborator(?:y|ies)|openai|google|microsoft|meta|deepmind|anthropic|stanford|berkeley|toronto|eth zurich|san francisco)(?:$|[^\p{L}\p{N}_])"
)
#: Words of a table's header row.
HEADER_WORDS = ("nominal", "working", "load", "limit", "stock", "weight", "dimensions", "replacement", "size", "each", "(in)", "(kg)", "(mm)", "(t)", "tol", "pin", "bolt")
#: Words of an invoice's header row.
INVOICE = r"(?i)\b(item|description|quantity|price|amount|invoice)\b"


def single_line(c: Column) -> Column:
    """Whether text has one line."""
    return ~c.contains("\n")


def is_page_number(c: Column) -> Column:
    return single_line(c) & c.rlike(PAGE_NUMBER)


def is_ordered_item(c: Column) -> Column:
    return c.rlike(ORDERED)


def is_unordered_item(c: Column) -> Column:
    return c.rlike(UNORDERED)


def is_caption(c: Column) -> Column:
    return c.rlike(CAPTION)


def is_caption_like(c: Column) -> Column:
    """Loose test: only the first word."""
    return F.lower(trim(c)).rlike(r"^(figure|fig\.|fig |table|exhibit|plate)")


def is_code(c: Column) -> Column:
    return c.rlike(CODE)


def is_scholarly(c: Column) -> Column:
    return c.rlike(SCHOLARLY) | c.rlike(NOTE)


def is_title_case(c: Column) -> Column:
    """1 to 12 words of which at least 60 % start with a capital."""
    ws = words(c)
    capital = F.size(F.filter(ws, lambda w: w.rlike(r"^\p{Lu}")))
    return F.size(ws).between(1, 12) & (capital >= F.lit(0.6) * F.size(ws))


def numbered_heading_level(c: Column, size_ratio: Column, base: Column) -> Column:
    """The level of a numbered section heading, else null."""
    label, sep, title = (F.regexp_extract(c, NUMBERED, k) for k in (1, 2, 3))
    ok = single_line(c) & (title != "") & (F.octet_length(title) <= 100) & ~title.endswith(".") & ((size_ratio >= F.lit(1.05)) | is_title_case(title))
    depth = F.size(F.split(label, r"\."))
    first = F.when((depth == 1) & (sep == "."), 2).otherwise(base)
    return F.when(ok, F.least(F.greatest(depth + first - 1, F.lit(1)), F.lit(6)))


def listed_heading_level(c: Column, titles: dict[str, int]) -> Column:
    """The level of a heading whose text is one of a list of a domain's fixed titles, else null."""
    pairs = [F.struct(F.lit(t.lower()).alias("t"), F.lit(v).alias("v")) for t, v in titles.items()]
    found = F.filter(F.array(*pairs), lambda p: p["t"] == F.lower(collapse(c)))
    return F.get(found, 0)["v"] if pairs else F.lit(None).cast("int")


def size_level(ratio: Column) -> Column:
    """Heading level by font-size ratio."""
    return F.when(ratio >= F.lit(2.0), 1).when(ratio >= F.lit(1.6), 2).when(ratio >= F.lit(1.35), 3).when(ratio >= F.lit(1.15), 4).otherwise(5)


def in_header_zone(y1: Column, height: Column, zone: float = 0.07) -> Column:
    return y1 <= height * F.lit(zone)


def in_footer_zone(y0: Column, height: Column, zone: float = 0.07) -> Column:
    return y0 >= height * F.lit(1.0 - zone)


def indent_depth(x0: Column, width: Column) -> Column:
    share = x0 / width
    return F.when(share < F.lit(0.15), 0).when(share < F.lit(0.25), 1).otherwise(2)


def is_value_token(c: Column) -> Column:
    """A table value: letters, digits and number marks of which at least half are digits, or a lone dash."""
    t = F.regexp_replace(c, r"^[,;:†‡*]+|[,;:†‡*]+$", "")
    digits = F.length(F.regexp_replace(t, r"[^0-9]", ""))
    return t.isin("-", "–", "—") | ((digits > 0) & t.rlike(r"^[0-9A-Za-z.,/\-–—\"'+±]+$") & (digits * 2 >= F.length(t)))


def is_prose_row(tokens: Column) -> Column:
    """At least 6 words, a stop word and no table value."""
    lower = F.transform(tokens, F.lower)
    return (F.size(tokens) >= 6) & F.arrays_overlap(lower, F.array(*map(F.lit, STOPWORDS))) & ~F.exists(tokens, is_value_token)


def is_data_row(tokens: Column) -> Column:
    """At least 4 words of which 55 % are table values, or 4 are and one has 6 digits."""
    values = F.size(F.filter(tokens, is_value_token))
    stock = F.exists(tokens, lambda w: F.length(F.regexp_replace(w, "[^0-9]", "")) >= 6)
    return (F.size(tokens) >= 4) & ((F.floor(values * 100 / F.size(tokens)) >= 55) | (stock & (values >= 4)))


def is_no_table_block(c: Column, width: Column, font_size: Column, body_size: Column) -> Column:
    """Text that is no cell of a table: blank, captions, page numbers, list items, authors, headings, and over 200 bytes."""
    t = trim(c)
    lines = F.filter(F.split(t, "\n"), lambda x: trim(x) != "")
    names = is_affiliation(t) | ((F.size(lines) >= 2) & is_author_line(F.coalesce(F.get(lines, 0), F.lit(""))))
    ratio = font_size / F.greatest(body_size, F.lit(0.1))
    heading = (body_size > 0) & ((ratio >= F.lit(1.15)) | numbered_heading_level(t, ratio, F.lit(1)).isNotNull())
    number = is_page_number(t) & (width < 40) & (F.octet_length(t) <= 6)
    return (t == "") | is_caption(t) | number | is_ordered_item(t) | is_unordered_item(t) | names | heading | (F.octet_length(t) > 200)


def is_header_row(c: Column) -> Column:
    """A row with a word of a table header."""
    low = F.lower(c)
    found = F.lit(False)
    for w in HEADER_WORDS:
        found = found | low.contains(w)
    return F.size(words(c)).between(1, 24) & found


def is_reference_line(c: Column) -> Column:
    """A bibliography entry: /n/ or a bracketed number followed by text."""
    return trim(c).rlike(r"^/[0-9]{1,4}/|^\[[0-9]{1,4}\]\s*\S|^\([0-9]{1,4}\)\s*\S")


def is_unsafe_source(c: Column) -> Column:
    """Formula text that was damaged in extraction."""
    marks = F.length(c) - F.length(F.replace(c, F.lit("?"), F.lit("")))
    return c.contains("�") | (marks >= 3)


def is_field_label(c: Column) -> Column:
    """A form label: a trailing colon, at most 48 bytes and 6 words, no full stop."""
    t = trim(c)
    return t.endswith(":") & (F.octet_length(t) <= 48) & (F.size(words(t)) <= 6) & ~t.contains(".")


def is_choice_line(c: Column) -> Column:
    """2 to 8 words, each at most 18 bytes with a letter or digit and without colon, comma or full stop."""
    ws = words(c)
    return F.size(ws).between(2, 8) & F.forall(ws, lambda w: (F.octet_length(w) <= 18) & w.rlike(r"[\p{L}\p{N}]") & ~w.rlike("[:.,]"))


def is_field_value(c: Column) -> Column:
    """Short text that is neither a label nor a choice."""
    t = trim(c)
    return (t != "") & ~is_field_label(t) & ~is_choice_line(t) & (F.octet_length(t) <= 48) & (F.size(words(t)) <= 6)


def _names(c: Column) -> Column:
    return F.filter(F.split(c, rf"[{WS},;]+"), lambda w: w != "")


def is_author_line(c: Column) -> Column:
    """2 to 16 words of which 80 % start with a capital and none is a stop word or starts small."""
    ws = _names(c)
    capital = F.size(F.filter(ws, lambda w: w.rlike(r"^[^\p{L}]*\p{Lu}")))
    stop = F.arrays_overlap(F.transform(ws, F.lower), F.array(*map(F.lit, NAME_STOPWORDS)))
    return F.size(ws).between(2, 16) & (capital * 5 >= F.size(ws) * 4) & ~stop & ~F.exists(ws, lambda w: w.rlike(r"^[^\p{L}]*\p{Ll}"))


def is_affiliation(c: Column) -> Column:
    return c.contains("@") | c.rlike(AFFILIATION)


def has_title_stopword(c: Column) -> Column:
    return F.arrays_overlap(F.transform(words(c), F.lower), F.array(*map(F.lit, TITLE_STOPWORDS)))


def is_main_section(c: Column) -> Column:
    """A heading that starts the main text."""
    named = r"^\s*[0-9]+(?:\.[0-9]+)?\.?\s*(?:[0-9]+\.?\s*)?(Introduction|Contents|Summary|Background|Methods?|Approach|Related Work|Experiments?|Results?|Conclusion|Overview)\b"
    return c.rlike(named) | F.lower(trim(c)).isin("introduction", "contents", "summary") | F.lower(trim(c)).rlike(r"^(1introduction|1\. introduction|1\. 1\. introduction|1 contents)")


def ends_sentence(c: Column) -> Column:
    """Whether the last character besides quotes and brackets ends a sentence."""
    return c.rlike(rf"[.!?:][\"')\]{WS}]*$")


def merges_with_previous(previous: Column, current: Column) -> Column:
    """Whether a paragraph continues the one before."""
    joined = previous.rlike(rf"-[{WS}]*$") | current.rlike(rf"^[{WS}]*[\p{{Ll}},;:)\]]") | ~ends_sentence(previous)
    return (trim(previous) != "") & (trim(current) != "") & joined


def is_structural(c: Column) -> Column:
    """A Markdown block that isn't running text."""
    return trim(c).rlike(r"^(#|<!--|\||!\[|\$\$|- |\*Figure|[0-9]+\. )|^\*(?s:.*)\*$")


def is_significant_image(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Wide or high enough, at least 0.4 % of the page and more than 8 points each way."""
    w, h = x1 - x0, y1 - y0
    page_w, page_h = F.greatest(width, F.lit(1.0)), F.greatest(height, F.lit(1.0))
    return ((w / page_w >= F.lit(0.10)) | (h / page_h >= F.lit(0.06))) & (w * h / (page_w * page_h) >= F.lit(0.004)) & (w > 8) & (h > 8)


def is_readable(c: Column) -> Column:
    """Whether text has a letter or digit."""
    return c.rlike(r"[\p{L}\p{N}]")


def is_formula_noise(c: Column) -> Column:
    """Words that are no formula content: bracketed numbers, links, bullets, punctuation."""
    t = trim(c)
    operator = t.isin(*"+−=×÷≤≥∑∏∫√")
    noise = (t == "") | (t.startswith("(") & t.endswith(")") & (F.octet_length(t) <= 6)) | t.rlike(r"http|www|://|\.com|\.org") | t.isin("•", "·", "●", "◦") | t.rlike(r"^[!-/:-@\[-`{-~]+$")
    return ~operator & noise


def is_formula_content(words_: Column, source: Column) -> Column:
    """Whether words hold real formula content: operators, scripts or script markup."""
    sign = F.exists(words_, lambda w: trim(w).isin(*"∑∏∫√∂∞=+−≤≥≠≈→⇒×÷") | w.rlike("[₁₂₃ⁱⁿ]"))
    return sign | source.rlike(r"[_^]|\\frac|\\sum")


def contains_phrase(c: Column, needle: Column) -> Column:
    """Case-insensitive search on collapsed white space."""
    return F.lower(collapse(c)).contains(F.lower(collapse(needle)))
