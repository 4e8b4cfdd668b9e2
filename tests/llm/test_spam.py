"""Stuffed pages: kinds of spam, what only looks like it, calibration, edge cases."""

import pytest
from conftest_llm import T0, T1

from docloom.llm import spam as S

PROSE = "The valve was opened by the crew and it is known that the level of the tank rose in the night. It was measured with care. "
SPAM = {
    "keywords": "buy cheap valve valve cheap pump buy pump cheap valve " * 20,
    "triads": "valve buy viewer, viewer download valve, valve offer viewer, " * 20,
    "urls": "\n".join(f"https://site{k}.example/page?id={k}" for k in range(30)),
    "links": "\n".join(f"[deal pump {k}](https://a.example/{k})" for k in range(30)),
    "anchors": " ".join(f'<a href="//x{k}.test">free pump</a>' for k in range(30)),
    "tags": " ".join(f"#valve{k}" for k in range(60)),
    "offers": " | ".join(f"AB{k} pump grey {k}.99 | in stock | add to cart" for k in range(30)),
    "bare hosts": "\n".join(f"www.pump-shop-{k}.example" for k in range(30)),
    "short lines": "\n".join(["cheap valve pump", "valve pump deal 9.99", "pump valve cheap"] * 12),
    "templates": "\n".join(f"Supplier valve near the {w}" for w in "silo shed yard loft dock mill barn hall pier quay".split() * 3),
}
FINE = {
    "prose": PROSE * 10,
    "table": "\n".join(f"Row{k};{k};{k}.5;n/a;{k * 7}" for k in range(40)),
    "labels": "\n".join(f"{w}: {k} kPa" for k, w in enumerate("Sensor Valve Tank Mill Crane Rope Hull Beam Deck Gate".split())),
    "references": PROSE * 4 + "\n\nSee also:\n- https://a.example/one\n- https://b.example/two",
    "short references": PROSE + "\n\nSee also:\n" + "\n".join(f"- https://reference-{k}.example/a-rather-long-page-name" for k in range(3)),
    "keywords line": PROSE * 3 + "\n\nKeywords: valve, pump, tank, level",
}


@pytest.fixture(scope="module")
def shares(make, common):
    rows = [(1000 + k, PROSE * 5, "en", T0) for k in range(250)]
    rows += [(k, t, "en" if k % 2 else None, T0) for k, t in enumerate([*SPAM.values(), *FINE.values()])]
    rows += [(90, None, "en", T0), (91, "", "xx", T0), (92, " \n\n ", None, T0), (93, SPAM["urls"] * 500, "en", T0), (94, SPAM["tags"], "en", T0), (94, SPAM["tags"], "en", T0)]
    return {r.doc_id: r.spam_share for r in S.spam_shares(make("documents", rows), common).collect()}


@pytest.mark.parametrize("k", range(len(SPAM)))
def test_spam(shares, k):
    assert shares[k] > 0.5, list(SPAM)[k]


@pytest.mark.parametrize("k", range(len(FINE)))
def test_fine(shares, k):
    assert shares[len(SPAM) + k] <= 0.5, list(FINE)[k]


def test_edges(shares):
    assert not {90, 91, 92} & set(shares)
    assert shares[93] > 0.5
    assert shares[94] > 0.5


def test_rare_languages_lean_on_all(make, common):
    rows = [(k, PROSE * 5, "en", T0) for k in range(60)] + [(100, PROSE, "xx", T0), (101, SPAM["keywords"], "xx", T0), (102, SPAM["keywords"], None, T0)]
    docs = make("documents", rows)
    limits, all_ = S.language_limits(S.segment_measures(docs, common))
    own = {r.lang: r for r in limits.collect()}
    assert set(own) == {"en", "xx"}
    assert abs(own["xx"].top_limit - all_["top"]) < 0.05
    assert {r.doc_id for r in S.spam_documents(docs, common).collect()} == {101, 102}


def test_newest_delivery(make, common):
    rows = [(k, PROSE * 5, "en", T0) for k in range(60)] + [(100, SPAM["urls"], "en", T0), (100, PROSE, "en", T1), (101, PROSE, "en", T0), (101, SPAM["urls"], "en", T1)]
    assert {r.doc_id for r in S.spam_documents(make("documents", rows), common).collect()} == {101}


def test_empty(make, common):
    assert S.spam_documents(make("documents", []), common).count() == 0
