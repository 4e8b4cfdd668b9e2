"""Page-local algorithms: known layouts, invariants on random pages, independence of partitions."""

import random
from collections import namedtuple

import pytest

from docloom.operators import pagefolds as pf

Word = namedtuple("Word", "text x0 y0 x1 y1 base font_size block_id widx")
Rule = namedtuple("Rule", "orientation pos lo hi")


def word(text, x, y, size=10.0, width=30.0, block=0, n=0):
    return Word(text, float(x), float(y - size), float(x + width), float(y), float(y), float(size), block, n)


def test_two_columns_read_down_first():
    boxes = [(50, 100, 250, 120), (320, 100, 520, 120), (50, 125, 250, 145), (320, 125, 520, 145)]
    assert pf.reading_order(boxes) == [0, 2, 1, 3]


def test_spanning_title_then_columns():
    boxes = [(50, 40, 520, 60), (50, 100, 250, 300), (320, 100, 520, 300)]
    assert pf.reading_order(boxes) == [0, 1, 2]


@pytest.mark.parametrize("seed", range(20))
def test_order_is_a_permutation_and_stable(seed):
    rnd = random.Random(seed)
    boxes = [(x := rnd.uniform(0, 500), y := rnd.uniform(0, 700), x + rnd.uniform(1, 120), y + rnd.uniform(1, 60)) for _ in range(rnd.randint(0, 40))]
    assert sorted(pf.reading_order(boxes)) == list(range(len(boxes)))


@pytest.mark.parametrize("seed", range(20))
def test_suppression_leaves_no_overlap(seed):
    rnd = random.Random(seed)
    boxes = [(x := rnd.uniform(0, 200), y := rnd.uniform(0, 200), x + rnd.uniform(5, 90), y + rnd.uniform(5, 90)) for _ in range(25)]
    kept = pf.keep_first(boxes, 0.6)
    assert all(pf.smaller_share(boxes[a], boxes[b]) <= 0.6 for a in kept for b in kept if a < b)
    assert len(pf.keep_better(boxes, [1.0] * 25)) <= 25


def test_numeric_table_with_header():
    rows = [["Nominal", "Load", "Limit", "Size"]] + [[str(i), f"{i}.5", str(10 * i), f"{i},000"] for i in range(1, 6)]
    words = [word(t, 60 + 100 * c, 100 + 14 * r, block=r, n=c) for r, row in enumerate(rows) for c, t in enumerate(row)]
    (t,) = pf.coordinate_tables(words, 612.0)
    assert t["source"] == "NumericRows"
    assert t["render"] == "Markdown"
    assert t["rows"][0] == ["Nominal", "Load", "Limit", "Size"]
    assert t["rows"][1:] == rows[1:]
    assert t["ids"] == list(range(6))


def test_grid_cells():
    boxes = [(60 + 100 * c, 100 + 20 * r, 100 + 100 * c, 110 + 20 * r) for r in range(3) for c in range(3)]
    cells = pf.grid_cells(boxes, [False] * 9)
    assert cells == {3 * r + c: (r, c) for r in range(3) for c in range(3)}
    assert pf.grid_cells(boxes[:3], [False] * 3) == {}


def test_prose_is_no_table():
    text = "the load was applied to the beam and the crack grew with time".split()
    words = [word(text[(r + c) % len(text)], 60 + 40 * c, 100 + 14 * r, n=c) for r in range(12) for c in range(10)]
    assert pf.coordinate_tables(words, 612.0) == []


def test_form_columns():
    rows = [["Name", "Unit", "Place"]] + [[f"item{r}", "pump", "yard"] for r in range(5)]
    words = [word(t, (60, 250, 430)[c], 100 + 14 * r, block=r, n=c) for r, row in enumerate(rows) for c, t in enumerate(row)]
    found = pf.form_tables(pf.word_rows(words), 612.0)
    assert [t["rows"] for t in found] == [rows]
    assert (found[0]["source"], found[0]["render"]) == ("TextAlignment", "Layout")  # words alone don't reach 0.68
    assert pf.row_starts([10.0, 40.0, 90.0, 60.0 + 240.0]) == [25.0, 90.0, 300.0]  # 10 and 40 meet at 25, from which 90 is too far
    numbered = [word(f".{r}", 20, 100 + 14 * r, block=r, n=9) for r in range(6)]
    assert pf.form_tables(pf.word_rows(words + numbered), 612.0) == []


def test_captioned_rows():
    lines = ["Table 3: Loads", "alpha beta", "gamma delta 4", "epsilon zeta 5 6", "These values were taken in the yard by hand today."]
    words = [word(t, 60 + 50 * c, 100 + 14 * r, block=r, n=c) for r, line in enumerate(lines) for c, t in enumerate(line.split())]
    (t,) = pf.captioned_tables(pf.word_rows(words), 612.0)
    assert [" ".join(r) for r in t["rows"]][:3] == lines[1:4]
    assert (t["source"], t["render"], t["confidence"] >= 0.48) == ("ExplicitRegion", "Layout", True)


def test_evidence_follows_the_page_width():
    rows = [[str(i), f"{i}.5", "ab" if i == 2 else str(10 * i), f"{i},000"] for i in range(1, 6)]
    words = [word(t, 60 + 100 * c, 100 + 14 * r, block=r, n=c) for r, row in enumerate(rows) for c, t in enumerate(row)]
    narrow, wide = (pf.coordinate_tables(words, w)[0]["confidence"] for w in (400.0, 1200.0))
    assert narrow > wide


def test_white_space_and_rules_make_tables():
    words = [word(f"v{r}{c}", 60 + 150 * c, 100 + 20 * r, block=r, n=c) for r in range(4) for c in range(3)]
    (t,) = pf.region_tables(words, [], 612.0, 792.0)
    assert (t["source"], t["render"], len(t["rows"])) == ("TextAlignment", "Markdown", 4)
    rules = [Rule("h", 85, 50, 500), Rule("h", 170, 50, 500)]
    (t,) = pf.region_tables(words, rules, 612.0, 792.0)
    assert t["source"] == "RulingBand"
    prose = "the load was applied to the beam and it grew".split()
    page = [word(prose[(r + c) % len(prose)], 60 + 45 * c, 60 + 40 * r, block=r, n=c) for r in range(14) for c in range(10)]
    assert pf.region_tables(page, [], 612.0, 792.0) == []


def test_page_sizes_reach_the_folds(spark):
    schema = "doc_id bigint, page_num bigint, block_id bigint, widx bigint, text string, font_size double, x0 double, y0 double, x1 double, y1 double, baseline_y double"
    cell = lambda d, r, c, t: (d, 0, r, c, t, 10.0, 60.0 + 100 * c, 90.0 + 14 * r, 90.0 + 100 * c, 100.0 + 14 * r, None)
    words = spark.createDataFrame([cell(d, r, c, "ab" if (r, c) == (1, 2) else f"{r}{c}") for d in (1, 2, 3) for r in range(5) for c in range(4)], schema)
    pages = spark.createDataFrame([(1, 0, 400.0, 600.0), (2, 0, 1200.0, 800.0), (4, 0, 10.0, 10.0)], "doc_id bigint, page_num bigint, width double, height double")
    got = {r.doc_id: (r.width, r.confidence) for r in pf.page_tables(words, pages).collect()}
    assert {d: w for d, (w, _) in got.items()} == {1: 400.0, 2: 1200.0, 3: 612.0}
    assert got[1][1] > got[3][1] > got[2][1]
    blocks = spark.createDataFrame([(d, 0, "Caption", "Figure 1. A", 100.0, 500.0, 200.0, 510.0) for d in (1, 2)], "doc_id bigint, page_num bigint, kind string, text string, x0 double, y0 double, x1 double, y1 double")
    images = spark.createDataFrame([], "doc_id bigint, page_num bigint, image_index bigint, x0 double, y0 double, x1 double, y1 double")
    right = {r.doc_id: r.x1 for r in pf.page_figures(blocks, images, pages).collect()}
    assert right == {1: 400.0 * 0.92 + 6, 2: 1200.0 * 0.92 + 6}


def test_rules_make_regions():
    rules = [Rule("h", 100, 60, 500), Rule("h", 200, 60, 500), Rule("v", 60, 100, 200), Rule("v", 500, 100, 200)]
    words = [word("a", 70, 150), word("b", 200, 150), word("c", 400, 150)]
    (r,) = pf.ruled_regions(rules, words, 612.0, 792.0)
    assert r["source"] == "RulingGrid"
    assert r["crossings"] == 4
    assert pf.ruled_regions(rules[:1], words, 612.0, 792.0) == []


@pytest.mark.parametrize(
    ("words", "source", "want"),
    [
        ([word("x", 0, 100), word("2", 12, 95, 6), word("=", 30, 100), word("y", 50, 100)], "x2 = y", "x ^{2} = y"),
        ([word("a", 0, 100), word("i", 12, 104, 6), word("=", 30, 100), word("b", 50, 100)], "ai = b", "a _{i} = b"),
        ([word("α", 0, 100), word("=", 30, 100), word("β", 50, 100)], "α = β", "\\alpha  = \\beta "),
        ([word("plain", 0, 100), word("words", 40, 100)], "plain words", "plain words"),
        ([word("a+b", 10, 100, width=40), word("=", 15, 100), word("c+d", 10, 112, width=40), word("=", 15, 112)], "a+b=c+d", "\\frac{a+b =}{c+d =}"),
    ],
)
def test_geometric_latex(words, source, want):
    assert pf.geometric_latex(words, source) == want


def test_figures():
    image, caption = (100.0, 100.0, 300.0, 300.0), ((100.0, 310.0, 300.0, 325.0), "Figure 1. Plan")
    (f,) = pf.figures([image], [caption], [], 612.0, 792.0)
    assert (f["confidence"], f["images"], f["reason"]) == (82, [0], "caption-near-images")
    (g,) = pf.figures([], [((100.0, 400.0, 300.0, 415.0), "Figure 2")], [], 612.0, 792.0)
    assert g["reason"] == "caption-only-estimate"
    (h,) = pf.figures([image, (305.0, 100.0, 500.0, 300.0)], [], [], 612.0, 792.0)
    assert h["images"] == [0, 1]
    assert pf.figures([], [], [], 612.0, 792.0) == []


def test_partitions_dont_matter(spark):
    rnd = random.Random(5)
    rows = [(d, 0, b, (x := float(rnd.randint(0, 400))), (y := float(rnd.randint(0, 700))), x + 80, y + 20) for d in range(4) for b in range(15)]
    df = spark.createDataFrame(rows, "doc_id bigint, page_num bigint, block_id bigint, x0 double, y0 double, x1 double, y1 double")
    got = [sorted(map(tuple, pf.page_reading_order(df.repartition(n)).collect())) for n in (1, 8)]
    assert got[0] == got[1]
    assert len(got[0]) == len(rows)


def test_conversion_takes_latex_from_a_formulas_own_words(spark):
    from docloom.operators import convert

    box = "x0 double, y0 double, x1 double, y1 double"
    at = lambda p, k, t, x, y, s, width=30.0: (1, p, 0, k, t, s, x, y - s, x + width, y, y)
    rows = [at(0, 0, "x", 60.0, 100.0, 10.0, 10.0), at(0, 1, "2", 72.0, 95.0, 6.0, 6.0), at(0, 2, "=", 90.0, 100.0, 10.0), at(0, 3, "y", 120.0, 100.0, 10.0), at(0, 4, "(10.12-3)", 300.0, 100.0, 10.0)]
    rows += [at(1, k, t, 60.0 + 40 * k, 100.0, 10.0) for k, t in enumerate(["other", "=", "text"])]
    rows += [at(2, 0, "a+b", 60.0, 100.0, 10.0), at(2, 1, "=", 65.0, 100.0, 10.0), at(2, 2, "c+d", 60.0, 112.0, 10.0)]
    words = spark.createDataFrame(rows, f"doc_id bigint, page_num bigint, block_id bigint, widx bigint, text string, font_size double, {box}, baseline_y double")
    f = [(1, 0, 0, "x2 = y (10.12-3)", None, 50.0, 80.0, 400.0, 110.0), (1, 1, 0, "V_{1} = α (2)", None, 50.0, 80.0, 400.0, 110.0), (1, 2, 0, "a+b=c+d", None, 50.0, 80.0, 400.0, 120.0), (1, 2, 1, "a+b=c+d", " \\given ", 50.0, 80.0, 400.0, 120.0), (1, 3, 0, "β", None, 0.0, 0.0, 1.0, 1.0), (1, 3, 1, None, None, 0.0, 0.0, 1.0, 1.0)]
    formulas = spark.createDataFrame(f, f"doc_id bigint, page_num bigint, formula_index bigint, source_text string, latex string, {box}")
    got = {(r.page_num, r.formula_index): r.text_latex for r in convert.with_latex(words, formulas).collect()}
    assert got == {(0, 0): "x ^{2} = y \\tag{10.12-3}", (1, 0): "V_{1} = \\alpha \\tag{2}", (2, 0): "\\frac{a+b =}{c+d}", (2, 1): "\\given", (3, 0): "\\beta", (3, 1): ""}


def test_conversion_of_chosen_pages_with_figures(spark):
    from docloom.operators import convert

    box = "x0 double, y0 double, x1 double, y1 double"
    blocks = spark.createDataFrame([(1, p, b, b, t, 10.0, 72.0, 100.0 + 50 * b, 500.0, 120.0 + 50 * b) for p in range(3) for b, t in enumerate(["Some text of the page.", "Figure 1. The pump"])], f"doc_id bigint, page_num bigint, block_id bigint, reading_order bigint, text string, font_size double, {box}")
    words = blocks.selectExpr("doc_id", "page_num", "block_id", "0L as widx", "text", "font_size", "x0", "y0", "x1", "y1", "cast(null as double) as baseline_y")
    pages = spark.createDataFrame([(1, p, 595.0, 842.0, 1) for p in range(3)], "doc_id bigint, page_num bigint, width double, height double, images bigint")
    formulas = spark.createDataFrame([], f"doc_id bigint, page_num bigint, formula_index bigint, source_text string, latex string, confidence int, {box}")
    images = spark.createDataFrame([(1, 1, 0, 150.0, 200.0, 450.0, 400.0)], f"doc_id bigint, page_num bigint, image_index bigint, {box}")
    out = convert.convert(words, blocks, pages, formulas, convert.Options(pages=(2, 3)), images)
    (doc,) = out["documents"].collect()
    tags = spark.createDataFrame([(1, 2, "H1", 72.0, 100.0, 500.0, 120.0)], f"doc_id bigint, page_num bigint, role string, {box}")
    rules = spark.createDataFrame([(1, 1, "h", 95.0, 60.0, 520.0), (1, 1, "h", 240.0, 60.0, 520.0)], "doc_id bigint, page_num bigint, orientation string, pos double, lo double, hi double")
    tagged = convert.convert(words, blocks, pages, formulas, convert.Options(pages=(2, 3)), images, rules, tags)["documents"].first()
    assert "# Some text of the page." in tagged.markdown
    assert "<!-- page:1 -->" not in doc.markdown
    assert "![Figure 1. The pump](page2_fig0.png)" in doc.markdown
    assert doc.markdown.count("*Figure 1. The pump*") == 2
