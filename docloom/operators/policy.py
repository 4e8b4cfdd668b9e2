"""Decision tables for formulas, tables, pages and OCR: ordered tests, the first that holds gives the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import predicates as P
from docloom.functions import text as T

#: Words that mark a formula line as prose.
SIDECAR_STOPWORDS = ("the", "and", "or", "of", "to", "in", "we", "with", "for", "by", "is", "are", "this", "that", "as", "on", "from", "at", "be", "all", "used", "using", "have", "has")
#: Words of a variable's definition.
DEFINITION_TERMS = ("angle", "factor", "including", "margin", "object", "plates", "sling", "table", "thickness", "weight")
#: Characters that count as mathematics for the backend test.
SIDECAR_MATH = T.MATH + "^_"
#: Evidence bonus by source.
SOURCE_BONUS = {"RulingGrid": 0.18, "RulingBand": 0.12, "NumericRows": 0.10, "TextAlignment": 0.02, "ExplicitRegion": 0.14, "ExternalModel": 0.14}
INDEPENDENT = ("RulingGrid", "RulingBand", "NumericRows", "ExplicitRegion", "ExternalModel")


def _count(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def emission(formulas: DataFrame, mode: str = "auto", emit: str = "auto", render_math: bool = True) -> DataFrame:
    """Formulas with ``emit`` and ``decision``: whether and why a formula comes out as LaTeX."""
    on = render_math and mode != "off" and emit != "none"
    text = T.trim(F.coalesce("source_text", F.lit("")))
    off = "render-math-disabled" if not render_math else "formula-emission-disabled"
    last = {
        "conservative": F.lit("local-heuristic-rejected-by-conservative-policy"),
        "all": F.lit("formula-emit-all"),
        "auto": F.when(F.col("confidence") >= 70, "high-confidence-local-auto").otherwise("low-confidence-local-auto") if mode == "auto" else F.lit("local-mode"),
        "none": F.lit(off),
    }[emit]
    reason = F.when(F.col("latex").isNull() & (text == ""), "empty-formula-text").when(P.is_unsafe_source(text), "unsafe-source-text").when(F.col("latex").isNotNull(), "sidecar-recovered").otherwise(last) if on else F.lit(off)
    out = formulas.withColumn("decision", reason)
    return out.withColumn("emit", F.col("decision").isin("sidecar-recovered", "high-confidence-local-auto", "local-mode", "formula-emit-all"))


def backend_rejection(formulas: DataFrame) -> DataFrame:
    """Formulas with ``rejection``: why a formula isn't sent to a recognition backend; null where it is."""
    text = T.trim(F.coalesce("source_text", F.lit("")))
    n_words, relations = F.size(T.words(text)), _count(text, "=<>≤≥")
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    why = F.coalesce("reason", F.lit(""))
    visual = (text == "") | (F.coalesce("backend", F.lit("")) == "visual-page-render") | why.contains("visual-isolated-equation-band")
    broad = (width > 420) & ((text == "") | why.contains("horizontal-rule"))
    friendly = (width > 0) & (height > 0) & (width / height <= 24) & ~broad
    right = F.when(F.instr(text, "=") > 0, F.lower(F.expr("substring(text_, instr(text_, '=') + 1)")))
    definition = F.coalesce((F.size(T.words(right)) >= 4) & right.rlike("|".join(DEFINITION_TERMS)), F.lit(False))
    ranged = ~text.contains("=") & (relations >= 2) & (n_words >= 4)
    stop = F.size(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w.isin(*SIDECAR_STOPWORDS)))
    content = (relations >= 2) | (_count(text, SIDECAR_MATH) >= 3) | ((F.col("confidence") >= 85) & (n_words <= 10))
    tests = [
        (F.coalesce("confidence", F.lit(0)) < 65, "candidate below sidecar confidence threshold"),
        (visual & friendly, ""),
        (visual, "visual-only crop too wide or ambiguous for sidecar OCR"),
        (text.contains("<EOS>") | text.contains("<pad>"), "candidate contains model-special prose tokens"),
        (F.col("equation_number").isNotNull(), ""),
        (relations == 0, "candidate has no formula relation operator"),
        (n_words > 14, "candidate has too many words for sidecar OCR"),
        (definition, "candidate looks like a variable definition line"),
        (ranged, "candidate looks like a table/range comparison"),
        ((n_words >= 10) & (stop >= 3) & (relations <= 1), "candidate looks like prose with an inline relation"),
        (content, ""),
    ]
    reason = F.coalesce(*[F.when(c, r) for c, r in tests], F.lit("candidate below sidecar math-content threshold"))
    out = formulas.withColumn("text_", text).withColumn("rejection", reason).drop("text_")
    return out.withColumn("rejection", F.when(F.col("rejection") != "", F.col("rejection")))


def sane_latex(formulas: DataFrame) -> DataFrame:
    """Formulas with ``sane``: whether recovered LaTeX is plausible for its crop; null without LaTeX."""
    x, text = F.col("latex"), T.trim(F.coalesce("source_text", F.lit("")))
    height, width = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)), F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0))
    tall = F.floor(height)
    n = lambda s: (F.length(x) - F.length(F.replace(x, F.lit(s), F.lit("")))) / len(s)
    long_words = F.filter(T.words(F.lower(x)), lambda w: w.rlike("^[a-z]{9,}$") & ~F.lower(text).contains(w))
    bad = (
        (x == "")
        | ((n("\\") > tall * 8) & (F.octet_length(x) > 50))
        | ((n("\\left|") + n("\\left\\|") > 3) & (F.octet_length(x) > 100))
        | ((F.octet_length(x) > tall * 50) & (width < 500))
        | ((text != "") & (F.size(long_words) >= 3))
        | ((n("\\stackrel") + n("\\overset") + n("\\widetilde") + n("\\widehat") > 5) & (F.octet_length(text) < 30))
    )
    return formulas.withColumn("sane", F.when(x.isNotNull(), ~bad))


def tagged(formulas: DataFrame) -> DataFrame:
    """Formulas with ``number``, the number at the end of the source text, and ``bare``, the text without it."""
    text = T.trim(F.coalesce("source_text", F.lit("")))
    bare = T.trim(F.regexp_replace(text, r"\s*\((?:[pP]\.)?[0-9]+(?:[.-][0-9]+)*\)\s*$", ""))
    number = T.equation_number(text)
    return formulas.withColumns({"number": number, "bare": F.when(number.isNotNull(), bare).otherwise(text)})


def formula_kind(formulas: DataFrame, geometric: DataFrame | None = None) -> DataFrame:
    """Formulas with ``text_latex``: recovered LaTeX, that of ``geometric``, or the source text as LaTeX; the last two with the number as a tag.

    ``geometric`` has doc_id, page_num, formula_index and latex of the formulas with known words.
    """
    keys = ["doc_id", "page_num", "formula_index"]
    out = tagged(formulas)
    body = T.trim(T.unicode_to_latex(F.col("bare")))
    if geometric is not None:
        out = out.join(geometric.select(*keys, F.col("latex").alias("_geometric")), keys, "left")
        body = F.coalesce("_geometric", body)
    local = F.when(F.col("number").isNotNull(), F.concat(body, F.lit(" \\tag{"), F.translate("number", "()", ""), F.lit("}"))).otherwise(body)
    return out.withColumn("text_latex", F.coalesce(T.trim(F.col("latex")), local)).drop("number", "bare", "_geometric")


def formula_counts(formulas: DataFrame) -> DataFrame:
    """(doc_id, candidates, pages, by status, numbered, with_latex): the index of a file's formulas."""
    status = lambda s: F.count_if(F.col("status") == s)
    return formulas.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_distinct("page_num").alias("pages"), status("local-candidate").alias("local"), status("needs-review").alias("needs_review"),
        status("backend-recovered").alias("recovered"), F.count("equation_number").alias("numbered"), F.count("latex").alias("with_latex"),
    )


def line_score(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Formula candidates among text lines: (keys, confidence, status, reason).

    ``lines`` has doc_id, page_num, row, text, n_words and its box.
    """
    t = T.trim(F.col("text"))
    math = T.math_score(F.col("text"))
    number, relation = T.equation_number(F.col("text")).isNotNull(), t.rlike("[=≤≥<>]")
    script, heavy = t.rlike("[_₁₂^]"), math >= 2
    lower = F.lower(t)
    prose = lower.rlike("such as|typeset|detailed working|not reproduced") | ((F.size(T.words(t)) >= 10) & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) > 45) & (math < 2) & ~t.contains("="))
    width = F.coalesce("width", F.lit(612.0))
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - width / 2) < width * F.lit(0.24)
    ok = F.octet_length(t).between(3, 180) & (F.col("n_words") <= 28) & ~prose & (heavy | relation | script | number) & (centred | number | (math >= 3)) & ~P.is_reference_line(F.col("text"))
    compact = centred & relation & (F.col("n_words") <= 4)
    parts = [(centred, 15, "centered"), (number, 22, "equation-number"), (relation, 15, "relation"), (compact, 10, "compact-display"), (heavy, None, "math-symbols"), (script, 8, "script-like")]
    points = F.lit(35)
    for test, n, _ in parts:
        points = points + F.when(test, F.lit(n) if n is not None else F.least(math, F.lit(5)) * 4).otherwise(0)
    reasons = F.array_join(F.filter(F.array(*[F.when(test, r) for test, _, r in parts]), lambda r: r.isNotNull()), "+")
    confidence = F.least(points, F.lit(96))
    out = lines.join(pages.select("doc_id", "page_num", "width"), ["doc_id", "page_num"], "left").where(ok)
    return out.select("doc_id", "page_num", "row", t.alias("source_text"), confidence.cast("int").alias("confidence"), F.when(confidence >= 70, "local-candidate").otherwise("needs-review").alias("status"), reasons.alias("reason"))


def evidence_score(features: DataFrame) -> DataFrame:
    """Table features with ``score``: weighted consistency, alignment, numbers and caption, bonuses and penalties, in 0 to 1."""
    source = F.lit(0.0)
    for k, v in SOURCE_BONUS.items():
        source = F.when(F.col("source") == k, F.lit(v)).otherwise(source)
    rows = F.when(F.col("rows") <= 3, 0.0).when(F.col("rows") <= 6, 0.04).when(F.col("rows") <= 9, 0.08).otherwise(0.12)
    raw = (
        F.col("row_consistency") * F.lit(0.32) + F.col("column_alignment") * F.lit(0.24) + F.col("numeric_density") * F.lit(0.24) + F.col("caption_score") * F.lit(0.05)
        + source + rows - F.col("broad_page_penalty") - F.col("prose_penalty")
    )
    return features.withColumn("score", F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def emitted_tables(tables: DataFrame) -> DataFrame:
    """Tables that come out: confident layouts; broad ones (35 % high, 70 % wide) only with independent evidence."""
    layout = F.col("render") == "Layout"
    broad = layout & (F.col("y1") - F.col("y0") >= F.greatest("height", F.lit(1.0)) * F.lit(0.35)) & (F.col("x1") - F.col("x0") >= F.greatest("width", F.lit(1.0)) * F.lit(0.70))
    sure = F.col("source").isin(*INDEPENDENT) & (F.col("confidence") >= F.lit(0.72)) & (F.col("prose_penalty") < F.lit(0.12))
    return tables.where(~(layout & (F.col("confidence") < F.lit(0.45))) & (~broad | sure))


def ocr_decision(triage: DataFrame, mode: str = "auto", available: bool = True) -> DataFrame:
    """(doc_id, mode, status, reason, pages): whether a file goes through OCR before extraction."""
    needs = F.size(F.coalesce("pages_needing_ocr", F.array().cast("array<bigint>")))
    if mode == "off":
        status, reason = F.lit("skipped"), F.lit("ocr-disabled")
    elif mode == "force":
        status, reason = (F.lit("apply"), F.lit("forced")) if available else (F.lit("failed"), F.lit("no-command"))
    else:
        status = F.when(needs == 0, "not-needed").otherwise("apply" if available else "unavailable")
        reason = F.when(needs == 0, "all-pages-readable").otherwise("triage" if available else "no-command")
    return triage.select("doc_id", F.lit(mode).alias("mode"), status.alias("status"), reason.alias("reason"), needs.cast("bigint").alias("pages"))
