"""Joins, plans, enrichment, sources and streaming on small rows."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom import doctor
from docloom.functions import predicates, sqlfunctions
from docloom.operators import enrich, evaluate, facts, folds, media, nested, pageplan, render, spatial, visual
from docloom.sources import files
from docloom.streaming import arrivals

BOX = "x0 double, y0 double, x1 double, y1 double"


def test_merge_order_is_dense_and_by_place(spark):
    text = spark.createDataFrame([(1, 0, 10, 0, 100.0), (1, 0, 11, 1, 200.0), (1, 0, 12, 2, 150.0)], "doc_id bigint, page_num bigint, block_id bigint, reading_order bigint, y0 double")
    media = spark.createDataFrame([(1, 0, 1, 0.0, 120.0), (1, 0, 2, 0.0, 900.0), (1, 0, 3, 0.0, 50.0)], "doc_id bigint, page_num bigint, id bigint, x0 double, y0 double")
    out = [(r.origin, r.id) for r in spatial.merged_order(text, media).orderBy("reading_order").collect()]
    assert out == [("media", 3), ("text", 10), ("media", 1), ("text", 11), ("text", 12), ("media", 2)]


def test_greedy_matches_are_one_to_one(spark):
    s = f"doc_id bigint, idx int, {BOX}"
    expected = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1.0, 0.0, 11.0, 10.0)], s)
    actual = spark.createDataFrame([(1, 0, 0.5, 0.0, 10.5, 10.0), (1, 1, 30.0, 0.0, 40.0, 10.0)], s)
    rows = evaluate.greedy_region_matches(expected, actual, ["doc_id"]).collect()
    assert [(r.expected_idx, r.actual_idx) for r in rows] == [(0, 0)]


def test_furniture_needs_two_pages(spark):
    rows = [(1, p, 5, 0, 0, "Header", 8.0, 72.0, 20.0, 120.0, 28.0, 28.0) for p in range(3)] + [(2, 0, 5, 0, 0, "Lonely", 8.0, 72.0, 20.0, 120.0, 28.0, None)]
    words = spark.createDataFrame(rows, f"doc_id bigint, page_num bigint, block_id bigint, line_id bigint, widx bigint, text string, font_size double, {BOX}, baseline_y double")
    pages = spark.createDataFrame([(1, p, 612.0, 792.0) for p in range(3)], "doc_id bigint, page_num bigint, width double, height double")
    assert {(r.doc_id, r.signature) for r in facts.furniture(words, pages).collect()} == {(1, "header")}


def test_sections_carry_pages(spark):
    text = "intro\n<!-- page:2 -->\n# One\na\n<!-- page:3 -->\n## Two\nb".split("\n")
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(text)], "doc_id bigint, line_no int, line string")
    got = [(r.title, r.level, r.content, r.page_start, r.page_end) for r in folds.sections(lines).orderBy("section_no").collect()]
    assert got == [("Document", 1, "intro", 1, 2), ("One", 1, "a", 2, 3), ("Two", 2, "b", 3, 3)]


def test_page_markdown_numbers_lists(spark):
    rows = [(1, 0, 0, 0, "Heading", 2, "1.Scope", None, None), (1, 0, 1, 0, "ListItem", None, "4. first", True, 0), (1, 0, 2, 0, "ListItem", None, "9) second", True, 0), (1, 0, 3, 0, "PageNumber", None, "1", None, None), (1, 0, 4, 0, "Paragraph", None, "co-\nop is\n here", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, page_num bigint, position bigint, sub int, kind string, level int, text string, ordered boolean, depth int")
    assert render.page_markdown(df).first().markdown == "<!-- page:1 -->\n\n## 1. Scope\n\n1. first\n2. second\n\nco-op is here\n\n"


def test_booklet_of_five_pages(spark):
    docs = spark.createDataFrame([(1, 5)], "doc_id bigint, page_count bigint")
    assert [r.page for r in pageplan.booklet(docs).orderBy("sheet", "slot").collect()] == [None, 1, 2, None, 4, 5, None, 3]
    assert [r.page for r in pageplan.delete(docs, "all").collect()] == []
    with pytest.raises(ValueError, match="multiple of 90"):
        pageplan.rotate(docs, "all", 45)


def test_backends_keep_failures(spark):
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id bigint, text string")
    rows = {r.id: r for r in enrich.enriched(items, "text", enrich.command(["tr", "a-z", "A-Z"])).collect()}
    assert (rows[1].status, rows[1].output, rows[2].output, rows[3].status) == ("ok", "A", "A", "empty")
    assert enrich.enriched(items, "text", enrich.command(["sleep", "5"], timeout=0.2)).where("id = 1").first().status == "timed-out"
    assert enrich.command(["/no/such/command"])("x")[0] == "failed"
    cache = enrich.enriched(items, "text", enrich.command(["cat"])).where("id = 1").select("content_hash", "status", "output", "duration_ms", "error")
    assert enrich.enriched(items, "text", enrich.command(["false"]), cache).where("id = 2").first().output == "a"


def test_files_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# a"), (2, None)], "doc_id bigint, markdown string")
    out = files.write_markdown(docs, str(tmp_path / "md")).collect()
    assert {(r.doc_id, r.n_bytes) for r in out} == {(1, 3), (2, 0)}
    assert (tmp_path / "md/1.md").read_text() == "# a"
    files.write_markdown(docs, str(tmp_path / "own"), nested=True).collect()
    assert (tmp_path / "own/1/1.md").read_text() == "# a"
    (tmp_path / "v.txt").write_text("a\nb\n")
    assert [tuple(r) for r in files.vocabulary(spark, str(tmp_path / "v.txt")).collect()] == [(0, "a"), (1, "b")]
    arrived = spark.createDataFrame([(1, "f", '{"pages": [{}]}', dt.datetime(2024, 1, 1))], "fixture_id bigint, file_name string, body string, received_at timestamp")
    arrived.write.parquet(str(tmp_path / "in"))
    arrivals.stream_fixture_rows(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    files.write_reports(docs.withColumnRenamed("markdown", "m"), str(tmp_path / "r"), "doc_id")


def test_rules_that_touch_are_one(spark):
    rows = [(1, 0, "h", 100.0, 0.0, 50.0, 1.0), (1, 0, "h", 101.0, 51.0, 90.0, 3.0), (1, 0, "h", 100.5, 95.0, 120.0, 1.0), (1, 0, "v", 100.0, 0.0, 50.0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, page_num bigint, orientation string, pos double, lo double, hi double, thickness double")
    got = sorted((r.orientation, round(r.pos, 2), r.lo, r.hi) for r in folds.merged_rules(df).collect())
    assert got == [("h", 100.5, 95.0, 120.0), ("h", 100.75, 0.0, 90.0), ("v", 100.0, 0.0, 50.0)]


def test_form_fields(spark):
    text = ["Name:", "Ada L", "Date: 12 May", "Agree:", "Yes No", "Lonely sentence here.", "x", "y", "Far: off"]
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(text)], "doc_id bigint, line_no int, line string")
    assert [(r.label, r.value) for r in folds.form_fields(lines, ["doc_id"]).orderBy("line_no").collect()] == [("Name", "Ada | L"), ("Date", "12 May"), ("Agree", "Yes | No")]


def test_snippets(spark):
    expected = spark.createDataFrame([(1, "x ^2"), (1, "\\frac"), (2, "y"), (2, None)], "page int, snippet string")
    actual = spark.createDataFrame([(1, "a + x^ 2"), (1, None)], "page int, latex string")
    assert sorted(map(tuple, evaluate.snippet_hits(expected, actual, ["page"]).collect())) == [(1, 2, 1), (2, 1, 0)]


def test_tables_as_markdown(spark):
    df = spark.createDataFrame([([["A", "B|C"], ["1"]],)], "rows array<array<string>>")
    got = df.select(render.gfm_table(df.rows).alias("g"), render.key_values(df.rows).alias("k")).first()
    assert got.g == "| A | B\\|C |\n|---|---|\n| 1 |  |"


def test_nulls_in_geometry_are_no_failure(spark):
    rows = [(1, 0, 0, 0, 0, None, None, None, None, None, None, None), (1, 0, 0, 0, 1, "a", 10.0, 1.0, 2.0, 3.0, 4.0, None)]
    words = spark.createDataFrame(rows, f"doc_id bigint, page_num bigint, block_id bigint, line_id bigint, widx bigint, text string, font_size double, {BOX}, baseline_y double")
    alone = words.where("widx = 0")
    for op in (folds.upper_median_font, folds.adaptive_tolerance, folds.row_width_mode, folds.column_centres, folds.word_builder, folds.grid_pivot):
        op(words).collect()
        op(alone).collect()
        op(words.limit(0)).collect()


def test_leading_heading_is_a_block_of_its_own(spark):
    rows = [(1, 0, 0, 0, "1 Introduction\nThis is body text.\nAnd more", 13.0, 50.0, 180.0, 500.0, 225.0), (1, 0, 1, 1, "Plain text\n2 Method", 10.0, 50.0, 300.0, 500.0, 330.0), (1, 0, 2, 2, "3 Results", 10.0, 50.0, 400.0, 500.0, 412.0), (1, 0, 3, 3, None, 10.0, 50.0, 500.0, 500.0, 512.0)]
    blocks = spark.createDataFrame(rows, f"doc_id bigint, page_num bigint, block_id bigint, reading_order bigint, text string, font_size double, {BOX}")
    pages = spark.createDataFrame([(1, 0, 600.0, 800.0)], "doc_id bigint, page_num bigint, width double, height double")
    sizes = spark.createDataFrame([(1, 10.0)], "doc_id bigint, body_size double")
    bases = spark.createDataFrame([(1, 1)], "doc_id bigint, base_level int")
    got = [(r.block_id, r.reading_order, r.sub, r.kind, r.level, r.text, round(r.y0, 2), round(r.y1, 2)) for r in facts.headings_split(blocks, pages, sizes, bases).orderBy("reading_order", "sub").collect()]
    assert got == [
        (1_400_000, 0, 0, "Heading", 1, "1 Introduction", 180.0, 197.55),
        (0, 0, 1, "Paragraph", None, "This is body text.\nAnd more", 197.55, 225.0),
        (1, 1, 1, "Paragraph", None, "Plain text\n2 Method", 300.0, 330.0),
        (2, 2, 1, "Heading", 1, "3 Results", 400.0, 412.0),
        (3, 3, 1, "Paragraph", None, None, 500.0, 512.0),
    ]


def test_intermediates(spark):
    from docloom import session

    df = session.written(spark.range(3), "probe")
    path = df.inputFiles()[0].removeprefix("file:").replace("//", "/")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2]
    assert session.release(spark) >= 1
    assert not Path(path).exists()
    assert session.temporary_dir("local[4]", "probe") == session.temporary_dir("local[4]", "probe")
    with pytest.raises(RuntimeError, match="share"):
        session.temporary_dir("spark://host:7077", "probe")


def test_media_plan(spark):
    pages = spark.createDataFrame([(1, p, 600.0, 800.0) for p in range(4)], "doc_id bigint, page_num bigint, width double, height double")
    schema = f"doc_id bigint, page_num bigint, id bigint, kind string, caption string, {BOX}"
    tiny = [(1, p, 0, "Image", None, 0.0, 0.0, 20.0, 20.0) for p in range(3)]  # repeated, small, at the edge
    big = [(1, 0, 1, "Figure", "Figure 1", 100.0, 200.0, 500.0, 500.0), (1, 0, 2, "Image", None, 100.0, 520.0, 400.0, 600.0)]
    many = [(1, 3, k, "Image", "a caption" if k == 9 else None, 150.0 + k, 300.0, 350.0 + k, 420.0) for k in range(10)]
    media_ = spark.createDataFrame(tiny + big + many, schema)
    text = spark.createDataFrame([(1, 0, "Paragraph", "text", 0.0, 700.0, 10.0, 710.0)], f"doc_id bigint, page_num bigint, kind string, text string, {BOX}")
    rows = {(r.page_num, r.id): r for r in media.media_plan(media_, text, pages).collect()}
    assert [rows[p, 0].dropped for p in range(3)] == [True] * 3
    assert rows[0, 1].kept
    assert rows[0, 2].kept
    assert rows[0, 1].score == 25 + 15 + 55 + 20 + 8
    assert [k for k in range(10) if rows[3, k].kept] == [9]  # ten media leave room for one
    (r,) = media.repeated_media(media_, pages).collect()
    assert (r.n_pages, r.fingerprint.band) == (3, 0)
    front = spark.createDataFrame([(1, 0)], "doc_id bigint, page_num bigint")
    assert {r.id for r in media.media_plan(media_, text, pages, front).where("page_num = 0 and kept").collect()} == {1}


def test_warnings(spark):
    found = spark.createDataFrame([(1, 0, 0), (1, 1, 3), (2, 0, 1)], "doc_id bigint, page_num bigint, n_blocks bigint")
    formulas = spark.createDataFrame([(1, 0), (1, 1), (1, 1)], "doc_id bigint, page_num bigint")
    scans = spark.createDataFrame([(2, 1, 1, True), (1, 2, 0, False)], "doc_id bigint, page_count bigint, low_density_pages bigint, likely_scan_like boolean")
    got = {(r.doc_id, r.warning): (r.n, r.of) for r in media.warnings(found, formulas, scans).collect()}
    assert got == {(1, "pages-without-text"): (1, 2), (1, "formula-candidates"): (3, 2), (2, "scan-heavy"): (1, 1)}
    assert [r.warning for r in media.warnings(found, formulas, scans, hybrid=True).collect()] == ["pages-without-text"]


def test_page_results(spark):
    row = {"doc": 1, "page": 1, "formulas": 5, "expected_formula_count": 4, "expected_formula_detection_count": 3, "formula_false_positive_budget": 1, "headings": 3, "headings_expected": 4, "heading_matches": 2, "tables": 2, "expected_tables": 1, "regions_expected": 2, "region_matches": 1,
           "images": 1, "figures": 3, "captioned_figures": 1, "expected_meaningful_figures": 2, "expected_figure_captions": 2, "expected_decorative_images": 3, "expected_vector_only_regions": 1, "skip_text_metrics": False, "skip_table_metrics": False, "candidates": 6}
    skipped = row | {"page": 2, "skip_text_metrics": True, "skip_table_metrics": True, "candidates": None}
    schema = ", ".join(f"{k} {'boolean' if k.startswith('skip') else 'bigint'}" for k in row)
    df = spark.createDataFrame([tuple(row.values()), tuple(skipped.values())], schema)
    a, b = evaluate.page_results(df, ["doc"]).orderBy("page").collect()
    assert (a.formula_matches, a.formula_false_positives, a.formula_recall, a.formula_precision) == (4, 1, 1.0, 0.8)
    assert (a.detection_found, a.detection_matches, a.detection_false_positives, a.detection_precision) == (6, 3, 2, 0.5)
    assert (a.heading_false_positives, a.heading_accuracy, a.table_true_positive, a.region_recall, a.region_precision) == (1, 0.5, True, 0.5, 0.5)
    assert (a.figure_matches, a.caption_pairs_found, a.decorative_suppressed, a.vector_regions_acknowledged) == (2, 1, 1, 1)
    assert (b.formula_found, b.heading_found, b.table_found, b.region_matches, b.formula_recall, b.heading_precision) == (0, 0, False, 0, 0.0, 1.0)
    (d,) = evaluate.document_results(evaluate.page_results(df, ["doc"]), ["doc"]).collect()
    assert (d.pages, d.formula_recall_micro, d.formula_recall_macro, d.table_recall) == (2, 0.5, 0.5, 0.5)


def test_labelled_pages_leave_out_what_was_not_extracted(spark):
    expected = spark.createDataFrame([(1, 1, 2), (1, 3, 1)], "doc bigint, page bigint, headings_expected bigint")
    actual = spark.createDataFrame([(1, 1, 4), (1, 2, 4)], "doc bigint, page bigint, headings bigint")
    debug = spark.createDataFrame([(1, 1, 7)], "doc bigint, page bigint, candidates bigint")
    assert [(r.page, r.candidates) for r in evaluate.labelled_pages(expected, actual, ["doc"], debug).collect()] == [(1, 7)]


def test_routed_pages_with_tables(spark):
    found = spark.createDataFrame([(1, p, 0, False) for p in range(3)], "doc_id bigint, page_num bigint, math_chars bigint, low_density boolean")
    cells = spark.createDataFrame([(1, 1, 5), (1, 1, 6)], "doc_id bigint, page_num bigint, block_id bigint")
    formulas = spark.createDataFrame([(1, 2)], "doc_id bigint, page_num bigint")
    rows = {r.page_num: (r.has_table, r.has_formula) for r in facts.routed_pages(found, cells, formulas).collect()}
    assert rows == {1: (True, False), 2: (False, True)}


def test_no_table_blocks(spark):
    texts = ["", "Figure 2. Plan", "12", "1. item", "- item", "Ann Lee\nBerlin", "University of X", "3.1 Load Tests", "x" * 201, "12.5", "Pump house"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.x for r in df.orderBy("k").select(predicates.is_no_table_block(df.t, F.lit(30.0), F.lit(10.0), F.lit(10.0)).alias("x")).collect()]
    assert got == [True] * 9 + [False] * 2
    assert df.limit(1).select(predicates.is_no_table_block(F.lit("Pump house"), F.lit(30.0), F.lit(12.0), F.lit(10.0)).alias("x")).first().x


def test_metadata_fields(spark):
    df = spark.createDataFrame([(1, ["all"]), (2, ["Title", "title ", "none"]), (3, []), (4, None)], "k int, f array<string>")
    got = sorted((r.k, r.field) for r in pageplan.metadata_fields(df, "k", "f").collect())
    assert got == [(1, f) for f in sorted(pageplan.METADATA_FIELDS)] + [(2, "title")]


def test_text_runs_and_numbers_by_depth(spark):
    kinds = ["Paragraph"] * 20 + ["Heading"] + ["ListItem", "Paragraph"]
    df = spark.createDataFrame([(1, 0, k, k, kind) for k, kind in enumerate(kinds)], "doc_id bigint, page_num bigint, block_id bigint, reading_order bigint, kind string")
    rows = {r.block_id: r.run_length for r in folds.text_runs(df).collect()}
    assert (rows[0], rows[2], rows[19], rows[21], rows[22]) == (18, 18, 1, 2, 1)
    assert 20 not in rows
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(["1. a", "  1. b", "  2. c", "2. d", "- e", "", "7. f"])], "doc_id bigint, line_no bigint, line string")
    assert [(r.line_no, r.number) for r in folds.list_numbering(lines).orderBy("line_no").collect()] == [(0, 1), (1, 1), (2, 2), (3, 2), (4, None), (6, 1)]


def test_markdown_elements(spark):
    text = ["# A", "para one", "goes on", "", "- a", "- b", "1. c", "| x |", "|---|", "", "$$", "x", "$$", "$y$", "```", "code", "```", "![f](a.png)", "- d", "<!-- page:2 -->", "tail"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(text)], "doc_id bigint, line_no bigint, line string")
    (r,) = evaluate.markdown_elements(df, ["doc_id"]).collect()
    assert (r.headings, r.tables, r.formulas, r.figures, r.lists, r.paragraphs, r.code_blocks) == (1, 1, 2, 1, 2, 3, 1)


def test_numeric_leaves(spark):
    texts = ['{"a": 1, "b": [2.5, {"c": true, "d": -3}], "e": null, "f": "4"}', "[1, [2]]", "broken {", None, "7"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k bigint, t string")
    got = {(r.k, r.path): r.value for r in evaluate.numeric_leaves(df, "t", "k").collect()}
    assert got == {(0, "a"): 1.0, (0, "b[0]"): 2.5, (0, "b[1].d"): -3.0, (1, "[0]"): 1.0, (1, "[1][0]"): 2.0, (4, ""): 7.0}
    assert evaluate.numeric_leaves(df.limit(0), "t", "k").count() == 0


def test_sql_functions(spark):
    names = sqlfunctions.register(spark)
    assert names == ["geometric_latex", "unicode_latex", "page_selection", "split_sections"]
    for spec, n in (("all", 4), ("odd", 5), ("2-4,7", 9), ("3,1,3", 4), ("5", 4), ("2-1", 4), ("", 3), ("x", 3)):
        got = [r.page for r in spark.sql(f"select * from page_selection('{spec}', {n})").collect()]
        assert got == [r.page for r in sqlfunctions.selected_pages(spark, spec, n).collect()], spec
    rows = spark.sql("select title, level, content, page_start, page_end from split_sections('intro\n# A\nx\n<!-- page:2 -->\ny\n## B\nz')").collect()
    assert [tuple(r) for r in rows] == [("Document", 1, "intro", 1, 1), ("A", 1, "x\ny", 1, 2), ("B", 2, "z", 2, 2)]
    got = spark.sql("select geometric_latex(array(named_struct('text', 'x', 'x0', 0D, 'y0', 90D, 'x1', 10D, 'y1', 100D, 'font_size', 10D, 'baseline_y', 100D), named_struct('text', '2', 'x0', 12D, 'y0', 89D, 'x1', 18D, 'y1', 95D, 'font_size', 6D, 'baseline_y', 95D), named_struct('text', '=', 'x0', 30D, 'y0', 90D, 'x1', 40D, 'y1', 100D, 'font_size', 10D, 'baseline_y', 100D)), 'x2 =') as l, unicode_latex('α') as u").first()
    assert got.l == "x ^{2} ="
    assert got.u.strip() == "\\alpha"


def test_dark_bands_and_visual_formulas(spark):
    lines = [(1, 0, y, 30, 250, 350, 80) for y in range(100, 120)] + [(1, 0, y, 30, 240, 360, 10) for y in range(124, 130)] + [(1, 0, 300, 3, 10, 20, 3)]
    df = spark.createDataFrame(lines, "doc_id bigint, page_num bigint, y int, dark int, min_x int, max_x int, max_run int")
    (b,) = visual.dark_bands(df, 600).collect()
    assert (b.y0, b.y1, b.x0, b.x1, b.dark, b.run) == (100, 130, 240, 360, 780, 80)
    pages = spark.createDataFrame([(1, 0, 600.0, 800.0)], "doc_id bigint, page_num bigint, width double, height double")
    words = spark.createDataFrame([(1, 0, "near", 250.0, 80.0, 300.0, 86.0)], f"doc_id bigint, page_num bigint, text string, {BOX}")
    blocks = spark.createDataFrame([(1, 0, 0, "The load is given by", 50.0, 60.0, 200.0, 70.0)], f"doc_id bigint, page_num bigint, reading_order bigint, text string, {BOX}")
    none = spark.createDataFrame([], f"doc_id bigint, page_num bigint, {BOX}")
    bands = visual.dark_bands(df, 600)
    run = lambda **k: visual.visual_formulas(bands, words, blocks, pages, k.get("existing", none), k.get("excluded", none), k.get("references", none.select("doc_id", "page_num"))).collect()
    (r,) = run()
    assert r.reason == "visual-isolated-equation-band+cue:The load is given by+centered+text-gap+horizontal-rule"
    assert (r.formula_index, r.confidence, r.status) == (0, 68, "needs-review")
    same = spark.createDataFrame([(1, 0, 240.0, 100.0, 360.0, 130.0)], f"doc_id bigint, page_num bigint, {BOX}")
    assert run(existing=same) == run(excluded=same) == run(references=same.select("doc_id", "page_num")) == []


def test_tagged_blocks(spark):
    blocks = spark.createDataFrame([(1, 0, k, "Paragraph", None, None, None, 0.0, 20.0 * k, 100.0, 20.0 * k + 10) for k in range(5)], f"doc_id bigint, page_num bigint, block_id bigint, kind string, level int, ordered boolean, depth int, {BOX}")
    tags = spark.createDataFrame([(1, 0, role, 0.0, 20.0 * k, 100.0, 20.0 * k + 10) for k, role in enumerate(["/H2", "LBody", "TD", "Span"])], f"doc_id bigint, page_num bigint, role string, {BOX}")
    got = [(r.kind, r.level, r.ordered) for r in facts.tagged_blocks(blocks, tags).orderBy("block_id").collect()]
    assert got == [("Heading", 2, None), ("ListItem", None, False), ("TableCell", None, None), ("Paragraph", None, None), ("Paragraph", None, None)]


def test_reference_pages(spark):
    df = spark.createDataFrame([(1, 0, "References"), (1, 0, "x"), (1, 1, "[1] A"), (1, 1, "[2] B"), (1, 1, "c"), (1, 1, "d"), (1, 1, "e"), (1, 2, "[1] A"), (1, 2, "b"), (1, 2, "c")], "doc_id bigint, page_num bigint, text string")
    assert {r.page_num for r in visual.reference_pages(df).collect()} == {0, 1}


def test_fences_are_no_paragraphs(spark):
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(["some text", "goes on", "```", "code here", "more", "```", "end"])], "doc_id bigint, line_no bigint, line string")
    assert [r.text for r in folds.merged_paragraphs(df).orderBy("paragraph").collect()] == ["some text goes on", "end"]


def test_evaluation_of_a_conversion(spark):
    labels = {
        "pages": spark.createDataFrame([(1, 1, 1, 1), (1, 2, 0, 0), (1, 9, 3, 0)], "doc_id bigint, page bigint, expected_formula_count bigint, expected_tables bigint"),
        "headings": spark.createDataFrame([(1, 1, "Load tests", 2), (1, 1, "Missing", 2)], "doc_id bigint, page bigint, text string, level int"),
        "table_regions": spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, None, 0.0, 1.0, 1.0)], f"doc_id bigint, page bigint, {BOX}"),
    }
    found = {
        "blocks": spark.createDataFrame([(1, 0, "Heading", 2, "Load  Tests"), (1, 0, "Paragraph", None, "x"), (1, 1, "Heading", 1, "Other")], "doc_id bigint, page_num bigint, kind string, level int, text string"),
        "tables": spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 9.0), (1, 0, 50.0, 50.0, 60.0, 60.0)], f"doc_id bigint, page_num bigint, {BOX}"),
        "formulas": spark.createDataFrame([(1, 1)], "doc_id bigint, page_num bigint"),
        "figures": spark.createDataFrame([(1, 0, "Figure 1"), (1, 0, None)], "doc_id bigint, page_num bigint, caption string"),
    }
    pages, documents = evaluate.evaluated(labels, found, ["doc_id"])
    a, b = pages.orderBy("page").collect()
    assert (a.page, a.heading_matches, a.heading_expected, a.table_true_positive, a.region_matches, a.regions_found, a.formula_recall, a.figures_found) == (1, 1, 2, True, 1, 2, 0.0, 2)
    assert (b.page, b.heading_false_positives, b.formula_false_positives, b.regions_expected) == (2, 1, 1, 0)
    (d,) = documents.collect()
    assert (d.pages, d.heading_accuracy_micro, d.region_precision_micro) == (2, 0.5, 0.5)


def test_density_ratio_and_doctor(spark):
    blocks = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 10.0, 10.0, 20.0, 20.0)], f"doc_id bigint, page_num bigint, {BOX}")
    assert facts.density_ratio(blocks, blocks).first().density == 0.5
    rows = {r.check: r.ok for r in doctor.checks(spark).collect()}
    assert rows["spark"]
    assert rows["shared folder"]
    assert rows["executor package pandas"]


def test_debug_formulas_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "x", None, True), (1, 0, " ", "y", False), (1, 1, None, None, False)], "doc_id bigint, page_num bigint, latex string, source_text string, emit boolean")
    files.write_debug_formulas(df, str(tmp_path / "debug"))
    got = {r.page: (r.candidates, r.emitted, r.latex_values) for r in files.debug_formulas(spark, str(tmp_path / "debug"), ["doc_id"]).collect()}
    assert got == {1: (2, 1, ["x", "y"]), 2: (1, 0, [])}


def test_folders_are_listed_and_read(spark, tmp_path):
    for name, body in (("b.PDF", "x"), ("a.pdf", "yy"), ("c.txt", "z"), ("f.json", '{"pdf": "p", "pages": [{"page": 1}]}')):
        (tmp_path / name).write_text(body)
    assert [(r.name, r.length) for r in files.input_files(spark, str(tmp_path)).collect()] == [("a.pdf", 2), ("b.PDF", 1)]
    assert [r.name for r in files.input_files(spark, str(tmp_path), first=1).collect()] == ["a.pdf"]
    (r,) = files.fixture_folder(spark, str(tmp_path)).collect()
    assert r.file_name == "f.json"
    assert nested.fixture_pages(files.fixture_folder(spark, str(tmp_path))).first().page == 1


def test_arrivals_are_counted_by_window(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, "s", day), (2, "s", day + dt.timedelta(hours=3)), (3, "t", day + dt.timedelta(days=1))]
    spark.createDataFrame(rows, "doc_id bigint, source string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = arrivals.arriving(spark, str(tmp_path / "in"), "doc_id bigint, source string, at timestamp")
    query = arrivals.arrival_counts(stream, "at", "source").writeStream.format("memory").queryName("arrived").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.source, r.n) for r in spark.table("arrived").collect()) == [("s", 2), ("t", 1)]


def test_merge_of_a_group_over_many_ranges(spark):
    docs = spark.createDataFrame([(k, "s" if k % 3 else "t", k % 4) for k in range(200)], "doc_id bigint, source string, page_count bigint")
    got = {(r.source, r.doc_id, r.page): r.out_page for r in pageplan.merge(docs.repartition(7), "source").collect()}
    want, seen = {}, {"s": 0, "t": 0}
    for k in range(200):
        for page in range(1, k % 4 + 1):
            g = "s" if k % 3 else "t"
            seen[g] += 1
            want[g, k, page] = seen[g]
    assert got == want
