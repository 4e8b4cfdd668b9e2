"""Labelled evaluation: expectations against what was extracted, per page and per document, and report diffs."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.session import written

IOU = 0.5


def heading_matches(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (expected, matched): expected headings that an actual one of the same level and wording meets."""
    norm = lambda df: df.withColumns({"_t": F.lower(T.collapse(F.col("title"))), "_l": F.col("level").cast("int")})
    seen = norm(actual).select(*keys, "_t", "_l").distinct().withColumn("_hit", F.lit(1))
    joined = norm(expected).join(seen, [*keys, "_t", "_l"], "left")
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("matched"))


def greedy_region_matches(expected: DataFrame, actual: DataFrame, keys: list[str], least: float = IOU) -> DataFrame:
    """keys + (expected_idx, actual_idx, iou): one-to-one pairs of regions, the best overlap first.

    Pairs are found by an equi-join on the page; only their indices and overlaps reach the greedy
    fold, one page at a time.
    """
    right = actual.select(*keys, F.col("idx").alias("a"), *[F.col(k).alias(f"a_{k}") for k in ("x0", "y0", "x1", "y1")])
    w = F.greatest(F.least("x1", "a_x1") - F.greatest("x0", "a_x0"), F.lit(0.0)) * F.greatest(F.least("y1", "a_y1") - F.greatest("y0", "a_y0"), F.lit(0.0))
    union = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) + (F.col("a_x1") - F.col("a_x0")) * (F.col("a_y1") - F.col("a_y0")) - w
    pairs = expected.withColumnRenamed("idx", "e").join(right, keys).withColumn("iou", F.when(union > 0, w / union).otherwise(0.0)).where(F.col("iou") >= F.lit(least))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name in keys)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["iou", "e", "a"], ascending=[False, True, True])
        used_e, used_a, rows = set(), set(), []
        for row in pdf.itertuples(index=False):
            if row.e not in used_e and row.a not in used_a:
                used_e.add(row.e)
                used_a.add(row.a)
                rows.append((*[getattr(row, k) for k in keys], row.e, row.a, row.iou))
        return pd.DataFrame(rows, columns=[*keys, "expected_idx", "actual_idx", "iou"])

    return pairs.select(*keys, "e", "a", "iou").groupBy(*keys).applyInPandas(fold, f"{fields}, expected_idx int, actual_idx int, iou double")


def ratio_or_full(hit: str, total: str) -> Column:
    """A share that is 1 when nothing was expected."""
    return F.when(F.col(total) == 0, F.lit(1.0)).otherwise(F.col(hit) / F.col(total))


def snippet_hits(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (snippets, found): expected LaTeX snippets that occur in any actual formula of their page; blanks ignored.

    Pages are joined by key; a page's few snippets are tested against its own formulas only.
    """
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    own = actual.groupBy(*keys).agg(F.collect_set(bare(F.col("latex"))).alias("_all"))
    hit = F.exists("_all", lambda x: x.contains(F.col("_s")))
    j = expected.withColumn("_s", bare(F.col("snippet"))).join(own, keys, "left")
    return j.groupBy(*keys).agg(F.count("snippet").alias("snippets"), F.count_if(F.coalesce(hit, F.lit(False))).alias("found"))


def page_metrics(pages: DataFrame, keys: list[str], expected: str, actual: str, budget: str) -> DataFrame:
    """keys + (expected, actual, hits, over, recall, precision): counts of one page; what is over may use up a budget."""
    e, a = F.coalesce(F.col(expected), F.lit(0)), F.coalesce(F.col(actual), F.lit(0))
    counted = pages.select(*keys, e.alias("expected"), a.alias("actual"), F.least(e, a).alias("hits"), F.greatest(a - e - F.coalesce(F.col(budget), F.lit(0)), F.lit(0)).alias("over"))
    return counted.select("*", F.round(ratio_or_full("hits", "expected"), 9).alias("recall"), F.round(ratio_or_full("hits", "actual"), 9).alias("precision"))


def document_metrics(pages: DataFrame, doc: str) -> DataFrame:
    """(doc, pages, expected, matched, micro, macro): sums over pages, the share of sums and the mean of shares."""
    per = pages.withColumn("_r", ratio_or_full("matched", "expected"))
    agg = per.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), F.sum("expected").alias("expected"), F.sum("matched").alias("matched"), F.round(F.avg("_r"), 9).alias("macro"))
    return agg.withColumn("micro", F.round(ratio_or_full("matched", "expected"), 9))


def report_diff(old: DataFrame, new: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, old, new) of metrics that differ; a missing report counts as null."""
    melt = lambda df, side: df.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", side))
    both = melt(old, "old").join(melt(new, "new"), [key, "metric"], "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def count_agreement(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (actual, expected, agreement): smaller over larger count, 1 when both are 0."""
    j = actual.join(expected, keys, "full").fillna(0, ["actual", "expected"])
    high = F.greatest("actual", "expected")
    return j.withColumn("agreement", F.round(F.when(high == 0, 1.0).otherwise(F.least("actual", "expected") / high), 9))


def markdown_quality(lines: DataFrame) -> DataFrame:
    """(doc_id, pages, headings, table_lines, images, glued_numbers, empty_pages): counters of rendered Markdown."""
    page = F.count("marker").over(Window.partitionBy("doc_id").orderBy("line_no"))
    x = lines.withColumn("marker", T.page_marker(F.col("line"))).withColumn("page_no", page)
    full = F.count_if((T.trim(F.col("line")) != "") & F.col("marker").isNull()).alias("full")
    empty = x.where("page_no > 0").groupBy("doc_id", "page_no").agg(full).groupBy("doc_id").agg(F.count_if(F.col("full") == 0).alias("empty_pages"))
    line = F.col("line")
    counts = x.groupBy("doc_id").agg(
        F.count("marker").alias("pages"), F.count_if(line.rlike("^#")).alias("headings"), F.count_if(line.rlike(r"^\|")).alias("table_lines"),
        F.count_if(line.rlike(r"!\[")).alias("images"), F.count_if(line.rlike(r"[A-Za-z][0-9]{2,3}\.[0-9]{3}")).alias("glued_numbers"),
    )
    return counts.join(empty, "doc_id", "left").fillna(0, ["empty_pages"])


def gfm_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, first_line, rows, columns): pipe tables: neighbouring pipe lines, separator lines left out."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    pipes = lines.where(F.col("line").rlike(r"^\s*\|.*\|\s*$")).withColumn("island", F.col("line_no") - F.row_number().over(w))
    rows = pipes.where(~F.col("line").rlike(r"^[\s|:-]+$"))
    cells = F.size(F.split(F.regexp_replace(T.trim(F.col("line")), r"^\||\|$", ""), r"\|"))
    return rows.groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("rows"), F.max(cells).alias("columns")).drop("island")


def numeric_leaves(docs: DataFrame, column: str, key: str) -> DataFrame:
    """(key, path, value): every number in a JSON text by its path; booleans are no numbers.

    The texts become VARIANTs and are taken apart level by level in the JVM: each round explodes the
    objects and arrays of the last. Depth ends the rounds: a level without containers gives no rows.
    """
    rows = docs.select(key, F.lit("").alias("path"), F.expr(f"try_parse_json(regexp_replace({column}, r'{_AROUND}', ''))").alias("v")).where("v is not null")
    level = written(rows, "leaves")
    found = []
    while not level.isEmpty():
        kind = "schema_of_variant(v)"
        numbers = level.where(F.expr(f"{kind} = 'BIGINT' or {kind} = 'DOUBLE' or {kind} = 'FLOAT' or {kind} like 'DECIMAL%'"))
        found.append(numbers.select(key, "path", F.expr("try_variant_get(v, '$', 'double')").alias("value")))
        inner = level.where(F.expr(f"{kind} like 'OBJECT%' or {kind} like 'ARRAY%'"))
        parts = inner.selectExpr(key, "path", f"{kind} like 'ARRAY%' as listed", "v as _outer").lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("_outer").outer()))
        step = F.when(F.col("listed"), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "key"))
        level = written(parts.select(key, step.alias("path"), F.col("value").alias("v")).where("v is not null"), "leaves")
    return reduce(DataFrame.unionByName, found) if found else rows.select(key, "path", F.lit(0.0).alias("value")).limit(0)


#: Byte-order mark and white space around a JSON text.
_AROUND = r"^[\x{FEFF} \n\r\t]+|[\x{FEFF} \n\r\t]+$"


def labelled_pages(expected: DataFrame, actual: DataFrame, keys: list[str], debug: DataFrame | None = None) -> DataFrame:
    """Expectations with what was found on their page; pages that were not extracted are left out.

    ``expected`` and ``actual`` meet on keys and the 1-based ``page``; ``debug`` (candidates, by the
    same keys) may lack pages.
    """
    on = [*keys, "page"]
    found = expected.join(actual, on)
    return found.join(debug, on, "left") if debug is not None else found.withColumn("candidates", F.lit(None).cast("bigint"))


#: What a page expects and what it holds; missing columns and nulls count as 0.
_EXPECTED = (
    "expected_formula_count", "formula_false_positive_budget", "expected_tables", "expected_decorative_images", "expected_meaningful_figures", "expected_figure_captions",
    "expected_vector_only_regions", "headings_expected", "heading_matches", "regions_expected", "region_matches", "snippets_expected", "snippets_matched",
)
_FOUND = ("formulas", "headings", "tables", "images", "figures", "captioned_figures")


def page_results(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys + page + counts, matches and shares of formulas, headings, tables, regions and figures of each labelled page.

    A share is 1 where nothing was expected (or, for precision, found). Text or table metrics can be
    skipped by a page. What exceeds the expected formulas may use up the page's budget.
    """
    n = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") if c in pages.columns else F.lit(0).cast("bigint") for c in (*_EXPECTED, *_FOUND)}
    skip = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in pages.columns else F.lit(False)
    no_text, no_tables = skip("skip_text_metrics"), skip("skip_table_metrics")
    kept = lambda c, no: F.when(no, F.lit(0)).otherwise(n[c])
    less = lambda a, b: F.greatest(a - b, F.lit(0))
    share = lambda a, b: F.round(F.when(b == 0, F.lit(1.0)).otherwise(a / b), 9)

    formulas, wanted = kept("formulas", no_text), n["expected_formula_count"]
    hits = F.least(formulas, wanted)
    detection = F.col("expected_formula_detection_count") if "expected_formula_detection_count" in pages.columns else F.lit(None).cast("bigint")
    told = detection.isNotNull() & F.col("candidates").isNotNull()
    seen, asked = F.when(told, F.col("candidates")).otherwise(formulas), F.when(told, detection).otherwise(wanted)
    allowed = F.when(told, asked + n["formula_false_positive_budget"]).otherwise(asked)
    detected = F.least(seen, asked)
    headings, matched = kept("headings", no_text), F.when(no_text, F.lit(0)).otherwise(n["heading_matches"])
    tables, table_expected = kept("tables", no_tables), n["expected_tables"] > 0
    regions = F.when(n["regions_expected"] == 0, F.lit(0)).otherwise(tables)
    region_hits = F.when(no_tables, F.lit(0)).otherwise(n["region_matches"])
    figures, captioned = n["figures"], n["captioned_figures"]
    figure_hits, pairs = F.least(figures, n["expected_meaningful_figures"]), F.least(captioned, n["expected_figure_captions"])
    leaked = less(less(figures, captioned), less(n["expected_meaningful_figures"], captioned))
    suppressed = less(n["expected_decorative_images"], F.least(n["images"] + leaked, n["expected_decorative_images"]))
    vectors = F.least(figures, n["expected_vector_only_regions"])
    columns = {
        "formula_found": formulas, "formula_expected": wanted, "formula_matches": hits, "formula_false_positives": less(formulas, hits), "formula_recall": share(hits, wanted), "formula_precision": share(hits, formulas),
        "detection_found": seen, "detection_expected": asked, "detection_matches": detected, "detection_false_positives": less(seen, F.when(told, allowed).otherwise(detected)),
        "detection_recall": share(detected, asked), "detection_precision": F.when(told & (seen <= allowed), F.lit(1.0)).otherwise(share(detected, seen)),
        "snippets_expected": n["snippets_expected"], "snippets_matched": n["snippets_matched"], "snippet_recall": share(n["snippets_matched"], n["snippets_expected"]),
        "heading_found": headings, "heading_expected": n["headings_expected"], "heading_matches": matched, "heading_false_positives": less(headings, matched), "heading_accuracy": share(matched, n["headings_expected"]), "heading_precision": share(matched, headings),
        "table_found": tables > 0, "table_expected": table_expected, "table_true_positive": (tables > 0) & table_expected, "table_false_positive": (tables > 0) & ~table_expected,
        "regions_found": regions, "regions_expected": n["regions_expected"], "region_matches": region_hits, "region_recall": share(region_hits, n["regions_expected"]), "region_precision": share(region_hits, regions),
        "decorative_expected": n["expected_decorative_images"], "decorative_suppressed": suppressed, "suppression_rate": share(suppressed, n["expected_decorative_images"]),
        "figures_found": figures, "figures_expected": n["expected_meaningful_figures"], "figure_matches": figure_hits, "retention_rate": share(figure_hits, n["expected_meaningful_figures"]),
        "caption_pairs_found": pairs, "caption_pairs_expected": n["expected_figure_captions"], "pairing_rate": share(pairs, n["expected_figure_captions"]),
        "vector_regions_expected": n["expected_vector_only_regions"], "vector_regions_acknowledged": vectors, "acknowledgement_rate": share(vectors, n["expected_vector_only_regions"]),
    }
    return pages.select(*keys, "page", *[c.alias(name) for name, c in columns.items()])


#: Shares of a document: name, the counts whose sums give the micro share, the page share whose mean is the macro share.
_SHARES = (
    ("formula_recall", "formula_matches", "formula_expected"), ("formula_precision", "formula_matches", "formula_found"), ("detection_recall", "detection_matches", "detection_expected"),
    ("snippet_recall", "snippets_matched", "snippets_expected"), ("heading_accuracy", "heading_matches", "heading_expected"), ("heading_precision", "heading_matches", "heading_found"),
    ("region_recall", "region_matches", "regions_expected"), ("region_precision", "region_matches", "regions_found"), ("suppression_rate", "decorative_suppressed", "decorative_expected"),
    ("retention_rate", "figure_matches", "figures_expected"), ("pairing_rate", "caption_pairs_found", "caption_pairs_expected"), ("acknowledgement_rate", "vector_regions_acknowledged", "vector_regions_expected"),
)


def document_results(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys + pages + table recall and precision by pages + micro and macro shares of a document's pages."""
    flag = lambda c: F.count_if(F.col(c))
    share = lambda a, b: F.round(F.when(b == 0, F.lit(1.0)).otherwise(a / b), 9)
    out = [F.count(F.lit(1)).alias("pages"), share(flag("table_true_positive"), flag("table_expected")).alias("table_recall"), share(flag("table_true_positive"), flag("table_found")).alias("table_precision")]
    for name, hit, total in _SHARES:
        out += [share(F.sum(hit), F.sum(total)).alias(f"{name}_micro"), F.round(F.avg(name), 9).alias(f"{name}_macro")]
    return results.groupBy(*keys).agg(*out)


def markdown_elements(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys + headings, tables, formulas, figures, lists, paragraphs and code blocks of Markdown lines, told line by line.

    Each line has one class; tables and lists are counted at the first of lines that only headings,
    formulas and fences interrupt, paragraphs at the next line that is blank or a comment.
    """
    t = F.trim(F.col("line"))
    fence, dollars = t.startswith("```"), t.startswith("$$")
    kind = (
        F.when(t.startswith("#"), "heading").when(dollars, "block").when(t.startswith("$"), "formula").when(fence, "fence").when(t.startswith("|") & t.endswith("|"), "table")
        .when(t.startswith("![") & t.contains("]("), "figure").when(t.rlike(r"^[-*+] |^[0-9]\. ") & ((F.length(t) > 2) | ~t.rlike("^[0-9]")), "list").when((t == "") | t.startswith("<!--"), "gap").otherwise("text")
    )
    w = Window.partitionBy(*keys).orderBy("line_no")
    last = lambda *skipped: F.last(F.when(~F.col("k").isin(*skipped), F.col("k")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = lines.withColumn("k", kind)
    x = x.withColumns({"open_table": last("heading", "block", "formula", "fence"), "open_list": last("heading", "block", "formula", "fence", "table", "figure"), "after": F.last(F.when(F.col("k").isin("text", "gap"), F.col("k")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    one = lambda c: F.count_if(c)
    is_, new = (lambda k: F.col("k") == k), (lambda k, c: (F.col("k") == k) & ~F.col(c).eqNullSafe(F.lit(k)))
    return x.groupBy(*keys).agg(
        one(is_("heading")).alias("headings"), one(new("table", "open_table")).alias("tables"), (F.floor(one(is_("block")) / 2) + one(is_("formula"))).alias("formulas"), one(is_("figure")).alias("figures"),
        one(new("list", "open_list")).alias("lists"), one(new("text", "after")).alias("paragraphs"), F.ceil(one(is_("fence")) / 2).alias("code_blocks"),
    )


def evaluated(labels: dict[str, DataFrame], found: dict[str, DataFrame], keys: list[str], debug: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(page results, document results) of a conversion against labels.

    ``labels``: pages, headings and table_regions as ``nested`` gives them, with keys and the 1-based page.
    ``found``: blocks (kind, level, text), tables (box) and, where there are some, formulas, images and figures
    (caption), with keys and the 0-based page_num.
    """
    on = [*keys, "page"]
    paged = {k: df.withColumn("page", (F.col("page_num") + 1).cast("bigint")) for k, df in found.items()}
    heads = paged["blocks"].where("kind = 'Heading'")
    count = lambda df, name, what=F.lit(1): df.groupBy(*on).agg(F.count(what).alias(name))
    actual = count(paged["blocks"], "_blocks").join(count(heads, "headings"), on, "left").join(count(paged["tables"], "tables"), on, "left")
    for name in ("formulas", "images", "figures"):
        if name in paged:
            actual = actual.join(count(paged[name], name), on, "left")
    if "figures" in paged:
        actual = actual.join(paged["figures"].where(F.trim("caption") != "").groupBy(*on).agg(F.count(F.lit(1)).alias("captioned_figures")), on, "left")
    wanted = labels["headings"].select(*on, F.col("text").alias("title"), "level")
    matches = heading_matches(wanted, heads.select(*on, F.col("text").alias("title"), "level"), on).select(*on, F.col("expected").alias("headings_expected"), F.col("matched").alias("heading_matches"))
    regions = labels["table_regions"].where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    w = Window.partitionBy(*on).orderBy("y0", "x0", "y1", "x1")
    number = lambda df: df.select(*on, (F.row_number().over(w) - 1).alias("idx"), "x0", "y0", "x1", "y1")
    hits = greedy_region_matches(number(regions), number(paged["tables"]), on).groupBy(*on).agg(F.count(F.lit(1)).alias("region_matches"))
    expected = labels["pages"].join(matches, on, "left").join(count(regions, "regions_expected"), on, "left").join(hits, on, "left")
    pages = page_results(labelled_pages(expected, actual, keys, debug), keys)
    return pages, document_results(pages, keys)
