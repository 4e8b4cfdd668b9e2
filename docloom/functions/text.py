"""Scalar text functions as Column expressions (all JVM-side, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a regular-expression class body.
WS = r"\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Characters that never render and are dropped.
INVISIBLE = r"[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{0305}]"
#: Control characters that are dropped.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{009F}]"
#: Presentation ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Symbols and their LaTeX.
LATEX = {
    "α": "\\alpha ", "β": "\\beta ", "γ": "\\gamma ", "δ": "\\delta ", "ε": "\\varepsilon ", "ζ": "\\zeta ", "η": "\\eta ", "θ": "\\theta ", "λ": "\\lambda ", "μ": "\\mu ", "ν": "\\nu ", "ξ": "\\xi ", "π": "\\pi ",
    "ρ": "\\rho ", "σ": "\\sigma ", "τ": "\\tau ", "φ": "\\phi ", "χ": "\\chi ", "ψ": "\\psi ", "ω": "\\omega ", "Γ": "\\Gamma ", "Δ": "\\Delta ", "∆": "\\Delta ", "Θ": "\\Theta ", "Λ": "\\Lambda ", "Π": "\\Pi ", "Σ": "\\Sigma ",
    "Φ": "\\Phi ", "Ψ": "\\Psi ", "Ω": "\\Omega ", "∑": "\\sum ", "∏": "\\prod ", "∫": "\\int ", "∂": "\\partial ", "∞": "\\infty ", "√": "\\sqrt{} ", "±": "\\pm ", "∓": "\\mp ", "×": "\\times ", "÷": "\\div ",
    "≤": "\\leq ", "≥": "\\geq ", "≠": "\\neq ", "≈": "\\approx ", "∝": "\\propto ", "∈": "\\in ", "∉": "\\notin ", "⊂": "\\subset ", "∪": "\\cup ", "∩": "\\cap ", "−": "-",
}
#: Characters that count as mathematics.
MATH = "=+−-×*/÷<>≤≥√∑∫∂∆Δπμστγαβθλφ" + "Ω"


def trim(c: Column) -> Column:
    """Without white space at either end (Unicode)."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def lines(c: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(c, "\n"), trim), lambda x: x != "")


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, rf"[{WS}]+"), lambda x: x != "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"[{WS}]+", " "))


def section_label_spacing(c: Column) -> Column:
    """A space between a section number and a capitalised word glued to it."""
    c = F.regexp_replace(c, r"(?<=[0-9])(?<!\p{L}[0-9])(?=\p{Lu}\p{Ll})", " ")
    return F.regexp_replace(c, r"(?<=[0-9]\.)(?=\p{Lu}\p{Ll})", " ")


def clean_text(c: Column) -> Column:
    """Extracted text without junk characters, with plain spaces, hyphens and letters."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = F.translate(F.regexp_replace(c, INVISIBLE, ""), "  ‐‑", "  --")
    for k, v in LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    c = F.regexp_replace(c, CONTROLS, "")
    return section_label_spacing(F.replace(c, F.lit("-\n"), F.lit("-")))


def paragraph_text(c: Column) -> Column:
    """One line: line-end hyphens closed up, white space collapsed."""
    return collapse(F.replace(c, F.lit("-\n"), F.lit("-")))


def front_matter_text(c: Column) -> Column:
    """Trimmed lines without empty ones."""
    return F.array_join(lines(c), "\n")


def clean_glyphs(c: Column) -> Column:
    """Clean-style text: plain spaces and letters, bullets as list dashes, no replacement characters."""
    c = F.translate(c, "\u00a0\u00ad\u200b\u200c\u200d\ufffd", " ")
    for k, v in {k: v for k, v in LIGATURES.items() if len(v) > 1 and v != "st"}.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return collapse(F.replace(F.replace(c, F.lit("\uf0b7"), F.lit("- ")), F.lit("•"), F.lit("- ")))


def furniture_token(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def strip_scripts(c: Column) -> Column:
    """Without the wrappers of sub- and superscript markup."""
    return F.regexp_replace(c, r"[_^]\{([^}]*)(?:\}|$)", "$1")


def heading_text(c: Column) -> Column:
    """A heading candidate: white space collapsed, script wrappers dropped."""
    return strip_scripts(collapse(c))


def table_cell(c: Column) -> Column:
    """Text that is safe inside a pipe table."""
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def comment_attribute(c: Column) -> Column:
    """Text that is safe inside a comment attribute."""
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("--", "- -")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def emphasis(c: Column, bold: Column, italic: Column) -> Column:
    """Inline markers around trimmed text; blank text stays."""
    marker = F.when(bold & italic, "***").when(bold, "**").when(italic, "*")
    return F.when(marker.isNull() | (trim(c) == ""), c).otherwise(F.concat(marker, trim(c), marker))


def unicode_to_latex(c: Column) -> Column:
    """Symbols as LaTeX commands; no replacement holds a symbol, so one after another is enough."""
    for k, v in LATEX.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def strip_list_number(c: Column) -> Column:
    """Without leading white space and a leading list number such as ``1.`` or ``2)``."""
    return F.regexp_replace(F.regexp_replace(c, rf"^[{WS}]+", ""), rf"^[0-9]+[.)][{WS}]+(?=[^{WS}])", "")


def field_label(c: Column) -> Column:
    """A form label without list number and trailing colons."""
    return trim(F.regexp_replace(trim(strip_list_number(c)), r":+$", ""))


def equation_number(c: Column) -> Column:
    """A trailing equation number in brackets, else null."""
    got = F.regexp_extract(c, r"(?:^|\s)(\((?:[pP]\.)?[0-9]+(?:[.-][0-9]+)*\))\s*$", 1)
    return F.when(got != "", got)


def math_score(c: Column) -> Column:
    """How many characters are mathematical symbols."""
    return F.length(c) - F.length(F.translate(c, MATH, ""))


def page_marker(c: Column) -> Column:
    """The page of a page-marker comment line, else null."""
    got = F.regexp_extract(c, r"^\s*<!-- page:([0-9]+) -->\s*$", 1)
    return F.when(got != "", got.cast("bigint"))


def heading_level(c: Column) -> Column:
    """The level of a Markdown heading line, else null."""
    got = F.regexp_extract(c, r"^(#{1,6})\s+\S", 1)
    return F.when(got != "", F.length(got))


def heading_title(c: Column) -> Column:
    """The title of a Markdown heading line, else null."""
    got = F.regexp_extract(c, r"^#{1,6}\s+(\S.*?)\s*$", 1)
    return F.when(got != "", got)


def abstract_text(c: Column) -> Column:
    """What follows an ``abstract`` prefix, its colon or dash left out, else null."""
    got = F.regexp_extract(trim(c), rf"(?is)^abstract[{WS}:—–-]*(.*)$", 1)
    return F.when(got != "", got)


#: Fixed pattern of a number in a table row: grouped, with cents, or whole; brackets and a minus allowed.
NUMBER = r"\(?-?(?:[0-9]{1,3}(?:[.,][0-9]{3})+(?:[.,][0-9]{2})?|[0-9]+[.,][0-9]{2}|[0-9]+)\)?"
_ROW = rf"^(.*?)[\s|/\\:]*({NUMBER}(?:[\s|/\\]+{NUMBER})*)[\s|/\\]*$"


def numeric_row(c: Column) -> Column:
    """(label, values): the trailing run of numbers parted by blanks, pipes or slashes; null without label.

    A line without any number is a label without values.
    """
    t = collapse(strip_list_number(c))
    label, run = (F.regexp_extract(t, _ROW, k) for k in (1, 2))
    values = F.when(run == "", F.array().cast("array<string>")).otherwise(F.split(run, r"[\s|/\\]+"))
    name = F.when(run == "", t).otherwise(trim(F.regexp_replace(trim(label), r":+$", "")))
    ok = (name != "") & ((run != "") | ~t.rlike("[0-9]"))
    return F.when(ok, F.struct(name.alias("label"), values.alias("values")))


def pdf_date_valid(c: Column) -> Column:
    """Whether a string is a PDF date: 14 digits, and Z or an offset."""
    return c.rlike(r"^D:[0-9]{14}(?:Z|[+-][0-9]{2}'[0-9]{2}'?)?\z")


def pdf_date_iso(c: Column) -> Column:
    """A PDF date as yyyy-MM-ddTHH:mm:ss with its offset, else null."""
    part = lambda i, n: F.substring(c, i, n)
    zone = F.regexp_replace(F.substring(c, 17, 7), "'", "")
    offset = F.when((zone == "") | (zone == "Z"), "Z").otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2)))
    iso = F.concat(part(3, 4), F.lit("-"), part(7, 2), F.lit("-"), part(9, 2), F.lit("T"), part(11, 2), F.lit(":"), part(13, 2), F.lit(":"), part(15, 2), offset)
    return F.when(pdf_date_valid(c), iso)


def page_selection(spec: Column, n: Column) -> Column:
    """1-based pages of a selection such as ``all``, ``odd``, ``2-4,7``; null where it is invalid.

    Repeats are dropped, the first mention gives the order.
    """
    numbers = F.transform(F.split(F.lower(F.regexp_replace(spec, r"\s", "")), ","), lambda p: _pages(p, n))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), F.array_distinct(F.flatten(numbers)))


def _pages(part: Column, n: Column) -> Column:
    low = F.regexp_extract(part, r"^([0-9]+)", 1).try_cast("bigint")
    high = F.regexp_extract(part, r"-([0-9]+)$", 1).try_cast("bigint")
    every = F.sequence(F.lit(1).cast("bigint"), n)
    ranged = part.rlike(r"^[0-9]+-[0-9]+$") & (low >= 1) & (high <= n) & (low <= high)
    single = part.rlike(r"^[0-9]+$") & (low >= 1) & (low <= n)
    return (
        F.when(part == "all", every)
        .when(part == "odd", F.filter(every, lambda p: p % 2 == 1))
        .when(part == "even", F.filter(every, lambda p: p % 2 == 0))
        .when(ranged, F.sequence(F.when(ranged, low).otherwise(1), F.when(ranged, high).otherwise(1)))
        .when(single, F.array(low))
    )


def version_order(c: Column) -> Column:
    """A dotted version as an array of numbers that compares in order."""
    return F.transform(F.split(F.regexp_replace(c, "^v", ""), r"\."), lambda p: F.coalesce(F.regexp_extract(p, "^([0-9]+)", 1).try_cast("bigint"), F.lit(0)))


def bpe_decode(tokens: Column) -> Column:
    """Vocabulary tokens joined to text: special tokens dropped, word marks as spaces."""
    ends = F.array_position(tokens, "</s>")
    kept = F.when(ends > 0, F.slice(tokens, F.lit(1), F.greatest(ends - 1, F.lit(0)).cast("int"))).otherwise(tokens)
    text = F.array_join(F.filter(kept, lambda t: ~t.isin("<s>", "<pad>")), "")
    return collapse(F.replace(text, F.lit("Ġ"), F.lit(" ")))
