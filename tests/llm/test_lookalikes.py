"""Look-alike spelling: forms, what stays, block context, groups."""

import pytest
from conftest_llm import T0, T1
from pyspark.sql import functions as F

from docloom.llm import lookalikes as L


@pytest.fixture(scope="module")
def table(spark):
    return L.lookalikes(spark)


@pytest.mark.parametrize(
    ("text", "want"),
    [("ｔｈｅ", "the"), ("afte​r", "after"), ("schli­eßt", "schließt"), ("Schlüssel", "Schlüssel"), ("ﬁne", "fine"), ("10kΩ", "10kΩ"), ("22µm", "22μm"), ("470K", "470K"), ("how 7", "how 7"), ("sаmples", "samples"), ("bοlted", "bolted"), ("𝑅 = 𝟖", "R = 8"), ("（a），", "(a),"), ("﻿be", "be"), ("ΔА = α", "ΔA = α"), ("Տensor", "Sensor"), ("vаlvе", "valve"), ("ꓐolt", "Bolt"), ("pοrtаl", "portal")],
)
def test_brought_to_one_form(table, text, want):
    assert table.consistent(text) == want
    assert table.skeleton(text) == table.skeleton(want)


@pytest.mark.parametrize("text", ["m²", "x³", "x̂ = T + β ε", "a–b—c", "“quoted” ‘so’", "Датчик", "σ = p / Q", "Δx", "ν", "naïve", "R = 3 Ω", "H₂O", "co‐op", "", "1ª"])
def test_left_as_it_is(table, text):
    assert table.consistent(text) == text


def test_table_is_the_whole_of_unicode(table, spark):
    assert len(table.prototypes) > 5000
    assert {"а": "a", "Ι": "I", "І": "I", "Տ": "S", "Ꭺ": "A", "Ⲟ": "O"}.items() <= table.latin.items()
    assert all(table.skeleton(a) == table.skeleton(b) for a, b in table.latin.items())
    words = ["m1ll", "Illinois", 'a|b"c`', "100%", "plain\twords"]
    got = [r.s for r in spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string").orderBy("k").select(L.ascii_skeleton(F.col("w"), table).alias("s")).collect()]
    assert got == [table.skeleton(w) for w in words]


def cases(make, words, formulas=(), excluded=()):
    w = make("words", [(1, 0, b, k, t, T0) for b, k, t in words])
    f = make("formulas", [(1, 0, k, t) for k, t in enumerate(formulas)])
    x = make("blocks", [(1, 0, b, "", 0, T0) for b in excluded])
    return {(r.record, r.item_id, r.widx) for r in L.inconsistent(w, f, x).collect()}


def test_context_tells_borrowed_from_genuine(make):
    words = [(0, 0, "ВК-674"), (0, 1, "the"), (1, 0, "Насос"), (1, 1, "держит"), (2, 0, "sаme"), (2, 1, None), (3, 0, "ｘ")]
    assert cases(make, words, ["m = z / с", "σ = p", None, "К(x) = 3 x²", "х²"], [3]) == {("word", 0, 0), ("word", 2, 0), ("formula", 0, -1), ("formula", 3, -1), ("formula", 4, -1)}


def test_newest_extraction_and_repeats(make):
    old = make("words", [(1, 0, 0, 0, "ｘ", T0), (1, 0, 0, 1, "y​", T0)])
    new = make("words", [(1, 0, 0, 0, "x", T1), (1, 0, 0, 1, "y​", T1), (1, 0, 0, 1, "y​", T1)])
    w = old.unionByName(new)
    rows = L.word_cases(w, L.all_spellings(w, make("formulas", []))).collect()
    assert [(r.widx, r.form) for r in rows] == [(1, "y")]


def test_groups(make):
    w = make("words", [(1, 0, 0, k, t, T0) for k, t in enumerate(["same", "same", "sаme", "ｓame", "other"])])
    w = w.unionByName(make("words", [(1, 0, 0, 0, "same", T0), (2, 0, 0, 0, "old", T0), (2, 0, 0, 0, "sаme", T1)]))
    (g,) = L.skeleton_groups(w).collect()
    assert (g.skeleton, g.form, g.n_forms, g.n_words) == ("sarne", "same", 3, 5)


def test_empty_and_long(make):
    assert cases(make, []) == set()
    assert cases(make, [(0, 0, "ａ" * 100_000)]) == {("word", 0, 0)}


def test_genuine_letters_of_another_script_hide_no_borrowed_word(make):
    words = [(0, 0, "РК-743"), (0, 1, "σ"), (1, 0, "РК-743"), (1, 1, "держит"), (2, 0, "РК-ΒΕ"), (2, 1, "Δx"), (3, 0, "ΝΑ"), (3, 1, "σ")]
    w = make("words", [(1, 0, b, k, t, T0) for b, k, t in words])
    got = {(r.block_id, r.widx): r.form for r in L.word_cases(w, L.all_spellings(w, make("formulas", []))).collect()}
    assert got == {(0, 0): "PK-743", (2, 0): "PK-ΒΕ"}
