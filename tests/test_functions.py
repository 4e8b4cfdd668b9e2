"""Scalar functions and predicates on rows the tables don't hold."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import predicates as P
from docloom.functions import text as T


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'string' if isinstance(v, (str, type(None))) else 'double' if isinstance(v, float) else 'bigint'}" for i, v in enumerate(values)))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "want"),
    [("a\r\nb\rc", "a\nb\nc"), ("so­ft​", "soft"), ("ﬁne ﬂow oﬃce", "fine flow office"), ("a b‐c", "a b-c"), ("x\x07y\tz", "xy\tz"), ("well-\nknown", "well-known"), ("2.1Scope", "2.1 Scope"), ("1.Scope", "1. Scope"), ("A4Size", "A4Size"), (None, None), ("", "")],
)
def test_clean_text(spark, text, want):
    assert one(spark, T.clean_text, text) == want


@pytest.mark.parametrize(("text", "want"), [("E = mc² (1)", "(1)"), ("x (p.2)", "(p.2)"), ("y (3.1.4) ", "(3.1.4)"), ("z (2-1)", "(2-1)"), ("f(x)", None), ("(1) a", None)])
def test_equation_number(spark, text, want):
    assert one(spark, T.equation_number, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("Steel plates 12 3,400.50 7", ("Steel plates", ["12", "3,400.50", "7"])), ("1. Bolts: 4 | 5", ("Bolts", ["4", "5"])), ("no numbers", ("no numbers", [])), ("12 34", None), ("Sum (5)", ("Sum", ["(5)"]))],
)
def test_numeric_row(spark, text, want):
    got = one(spark, T.numeric_row, text)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("text", "ratio", "want"), [("1 Introduction", 1.0, 1), ("1. Scope", 1.2, 2), ("2.3 Load Cases", 1.0, 2), ("1.2.3.4.5.6.7 Deep End", 1.0, 6), ("3 this is no title case", 1.0, None), ("3 this is large", 1.1, 1), ("4 Ends here.", 1.5, None)])
def test_numbered_heading(spark, text, ratio, want):
    assert one(spark, lambda t, r: P.numbered_heading_level(t, r, F.lit(1)), text, ratio) == want


@pytest.mark.parametrize(("spec", "n", "want"), [("3,1-2,1", 4, [3, 1, 2]), ("even", 5, [2, 4]), ("0", 3, None), ("2-9", 3, None), ("", 3, None)])
def test_page_selection(spark, spec, n, want):
    assert one(spark, lambda s, k: T.page_selection(s, k), spec, n) == want


@pytest.mark.parametrize(("word", "want"), [("12", True), ("1,5/2", True), ("–", True), ("ab1", False), ("12mm", True), ("", False), ("12†", True)])
def test_value_token(spark, word, want):
    assert one(spark, P.is_value_token, word) is want


@pytest.mark.parametrize(("fn", "text", "want"), [(P.is_scholarly, "arXiv:1234.5", True), (P.is_reference_line, "[1] Author, Title", True), (P.is_reference_line, "(3.1)", False), (P.is_page_number, "- 12 -", True), (P.is_page_number, "1\n2", False), (P.is_choice_line, "Yes No Maybe", True), (P.is_choice_line, "Well, no", False), (P.is_author_line, "Ada Lovelace, Alan Turing", True), (P.is_author_line, "Ada of London", False), (P.is_formula_noise, "(12)", True), (P.is_formula_noise, "=", False)])
def test_predicates(spark, fn, text, want):
    assert one(spark, fn, text) is want


def test_bpe_decode(spark):
    df = spark.createDataFrame([(["<s>", "\\fr", "ac", "Ġx", "</s>", "no"],)], "t array<string>")
    assert df.select(T.bpe_decode(F.col("t"))).first()[0] == "\\frac x"


def test_emphasis(spark):
    df = spark.createDataFrame([(" a ", True, True), (" a ", False, True), ("  ", True, False), ("a", False, False)], "t string, b boolean, i boolean")
    assert [r[0] for r in df.select(T.emphasis(F.col("t"), F.col("b"), F.col("i"))).collect()] == ["***a***", "*a*", "  ", "a"]
