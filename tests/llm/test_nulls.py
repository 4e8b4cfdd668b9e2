"""Rows of nulls in every column change nothing: each operator gives what it gives without them."""

import pytest
from conftest_llm import T0

from docloom.llm import encoding, leakage, lookalikes, packing, repeated_lines, scan_noise, spam, splitting, text_kind

LONG = "Some words. " * 600
ROWS = {
    "blocks": [(d, 0, b, t, b, T0) for d in range(6) for b, t in enumerate(["Die Prüfung der Größe.", "Share this page", "Tail"])] + [(9, 0, 0, "Die PrÃ¼fung der GrÃ¶ÃŸe.", 0, T0)],
    "words": [(1, 0, 0, 0, "ｔhe", T0), (1, 0, 0, 1, "ВК-674", T0)],
    "formulas": [(1, 0, 0, "х = 1")],
    "furniture": [(d, 0, 0, "press archive") for d in range(6)],
    "reports": [(d, "s", "Tail", 0, 1) for d in range(10)],
    "triage": [(1, [1], T0)],
    "rendered": [(1, LONG, [("t", 1, LONG)], T0), (2, "a;1;2;3\nb;2;3;4\nc;3;4;5", None, T0)],
    "documents": [(1, "x " * 30, "en", T0), (2, "#a #b #c #d #e #f #g #h", None, T0)],
    "items": [(1, "x " * 12)],
}
CASES = {
    "scan": (scan_noise.scan_defects, ["blocks", "triage", "reports"], False),
    "kinds": (text_kind.text_kinds, ["rendered"], True),
    "lines": (repeated_lines.repeated_lines, ["blocks", "furniture", "reports"], False),
    "cleaned": (repeated_lines.cleaned_blocks, ["blocks", "furniture", "reports"], False),
    "looks": (lookalikes.inconsistent, ["words", "formulas", "blocks"], False),
    "garbled": (encoding.garbled_blocks, ["blocks"], False),
    "repaired": (encoding.repaired_blocks, ["blocks"], False),
    "split": (splitting.oversized, ["rendered"], False),
    "pieces": (splitting.rendered_pieces, ["rendered"], False),
    "packed": (packing.packed, ["documents"], False),
    "leaks": (leakage.leaks, ["documents", "items"], False),
    "spam": (spam.spam_documents, ["documents"], True),
}


@pytest.mark.parametrize("name", CASES)
def test_null_rows(make, common, name):
    op, kinds, with_words = CASES[name]
    run = lambda extra: {tuple(map(str, r)) for r in op(*[make(k, ROWS[k] + extra(k)) for k in kinds], *([common] if with_words else [])).collect()}
    plain = run(lambda k: [])
    assert run(lambda k: [tuple([None] * len(ROWS[k][0]))] * 2) == plain
    half = run(lambda k: [tuple(v if i == 0 else None for i, v in enumerate((77, *[None] * (len(ROWS[k][0]) - 1))))])
    assert plain <= half
