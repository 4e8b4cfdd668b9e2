"""Splitting: round trips on any text, limits, overlaps, and the item list."""

from conftest_llm import T0, T1
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import splitting as S

TEXT = st.lists(st.sampled_from(["word ", "x", "é", ". ", "\n", "\n\n", "# H\n", "\r\n", "ü", "  ", "<!-- page:2 -->\n", "a" * 30]), max_size=400).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(20, 90), st.integers(0, 9))
def test_round_trip(text, limit, overlap):
    spans = S.split_spans(text, limit, overlap)
    assert "".join(text[b:c] for _, b, c in spans) == text
    assert all(c - a <= limit for a, _, c in spans)
    assert all(0 <= b - a <= overlap for a, b, _ in spans)
    for (a0, b0, _), (a, b, _) in zip(spans, spans[1:]):
        assert a >= b0 >= a0
        assert b > b0


def test_cuts_at_natural_boundaries():
    text = "\n\n".join("Sentence one of the paragraph. " * 30 for _ in range(12))
    spans = S.split_spans(text)
    assert len(spans) > 1
    assert all(text[b - 1] in "\n " for _, b, _ in spans[1:])


def test_items(spark, make):
    long = "Some words. " * 600
    section = lambda c: ("t", 1, c)
    rows = [
        (1, long, [section(long), section(None), section("short")], T0), (2, "x" * 4000, None, T0), (3, None, [], T0), (4, "", [section("y" * 4001)], T0),
        (5, "short now", None, T1), (5, long, None, T0), (6, long, None, T0), (6, long, None, T0), (7, "no break" * 100000, None, None),
    ]
    df = make("rendered", rows)
    assert {tuple(r) for r in S.oversized(df).collect()} == {(1, -1), (1, 0), (4, 0), (6, -1), (7, -1)}
    assert S.oversized(df).count() == 5
    pieces = S.rendered_pieces(df).collect()
    assert all(len(p.piece) <= 4000 for p in pieces)
    for key in {(p.doc_id, p.section_idx) for p in pieces}:
        own = sorted((p for p in pieces if (p.doc_id, p.section_idx) == key), key=lambda p: p.piece_idx)
        assert "".join(p.piece[p.own_start - p.char_start :] for p in own) == {(1, -1): long, (1, 0): long, (1, 2): "short", (2, -1): "x" * 4000, (4, -1): "", (4, 0): "y" * 4001, (5, -1): "short now", (6, -1): long, (7, -1): "no break" * 100000}[key]
    assert S.oversized(make("rendered", [])).count() == 0


def test_marks_stay_with_their_letter_wherever_a_cut_is_possible():
    text = "a" + "\u0301" * 3000 + "b" * 5000
    spans = S.split_spans(text, 4000, 200)
    assert all(c - a <= 4000 for a, _, c in spans)
    assert all(text[own] != "\u0301" for _, own, _ in spans)
    marks = "x" + "\u0301" * 9000
    assert all(c - a <= 4000 for a, _, c in S.split_spans(marks, 4000, 200))
