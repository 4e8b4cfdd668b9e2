"""Scanned pages: running lines, broken words, misread words, repair."""

from conftest_llm import T0, T1

from docloom.llm import scan_noise as N

TITLE = "Minor index of the impeller"
CLEAN = "The impeller drives the relay beside the manifold because the margin reveals a compact column.\nEvery low-carbon relay behind the column has been measured with the stair."
SCAN = [
    (0, TITLE), (1, "The irnpel1er drives the co-\nlumn."), (2, "Every low-\ncarbon relay has been mea‐\nii\nsured."), (3, "Nothing is wrong here."), (4, "A ma-\nnifo1d drives the relay."),
    (5, f"The relay beside the\n{TITLE.replace('m', 'rn')} 2\ncolumn."), (1000000, TITLE.upper().replace("I", "1")), (1000001, "- 2 -"), (6, None), (7, ""), (8, "Share this page with us"), (9, "pÃ¡gina bÃ¡rn"),
]


def tables(make, extra=()):
    blocks = [(d, 0, b, CLEAN, b, T0) for d in range(10, 22) for b in range(2)]
    blocks += [(1, 0, 0, TITLE, 0, T0), (1, 0, 1000000, TITLE, 0, T0)] + [(1, 1, b, t, b, T0) for b, t in SCAN if b] + list(extra)
    triage = [(1, [1, 2], T1), (1, [1], T0), (2, None, T0), (3, [], T0)] + [(d, [], T0) for d in range(10, 22)]
    reports = [(1, "s", TITLE, 0, 2)] + [(d, "s", None, 0, 1) for d in range(10, 22)]
    return make("blocks", blocks), make("triage", triage), make("reports", reports)


WANT = {
    (0, 1000000, "running"), (1, 1000000, "running"), (1, 1000001, "running"), (1, 1, "misread"), (1, 1, "hyphen"), (1, 2, "hyphen"), (1, 2, "running"), (1, 4, "hyphen"), (1, 4, "misread"), (1, 5, "running"),
}


def test_defects(make):
    rows = N.scan_defects(*tables(make)).collect()
    assert {(r.page_num, r.block_id, r.defect) for r in rows} == WANT
    assert len(rows) == len(WANT)


def test_delivered_twice(make):
    b, t, r = tables(make)
    assert {(x.page_num, x.block_id, x.defect) for x in N.scan_defects(b.unionByName(b), t.unionByName(t), r.unionByName(r)).collect()} == WANT


def test_repaired(make):
    texts = {(r.page_num, r.block_id): r.text for r in N.repaired_blocks(*tables(make)).collect()}
    assert texts[(1, 1)] == "The impeller drives the column."
    assert texts[(1, 2)] == "Every low-carbon relay has been measured."
    assert texts[(1, 4)] == "A manifold drives the relay."
    assert texts[(1, 5)] == "The relay beside the column."
    assert texts[(1, 1000001)] == ""
    assert texts[(1, 3)] == "Nothing is wrong here."


def test_long_text(make):
    long = (1, 1, 20, ("The relay drives the co-\nlumn. " * 3000).strip(), 20, T0)
    rows = N.scan_defects(*tables(make, [long])).where("block_id = 20").collect()
    assert [r.defect for r in rows] == ["hyphen"]


def test_empty(make):
    assert N.scan_defects(make("blocks", []), make("triage", []), make("reports", [])).count() == 0
