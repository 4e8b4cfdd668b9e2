"""Text kinds: labelling functions, learning, documents of each kind."""

import pytest
from conftest_llm import T0, T1

from docloom.llm import text_kind as K

FW = {"the", "of", "and", "to", "in", "is", "that", "it", "was", "by", "on", "with"}
PROSE = "The valve was opened by the crew and it is known that the level of the tank rose in the night. It was measured with care."
PARTS = {
    "prose": PROSE,
    "list": "\n".join(f"{k}. steel bracket {k}" for k in range(9)),
    "labels": "\n".join(f"Sensor: {k} kPa" for k in range(9)),
    "contents": "\n".join(f"1.{k} Frame ........... {k}" for k in range(9)),
    "table": "\n".join(f"| Row{k} | {k} | {k}.5 |" for k in range(9)),
    "csv": "\n".join(f"Row{k};{k};{k}.5;n/a" for k in range(9)),
    "noise": "#I<<~* #1. ^^ * 1~>,:=.|l^!>|1 >=,<=._+l, +< =|*;~ _~>.. > ./ ~><* 1;=~<\n::.=I_*~\\#>\\: ~l \\ ; !~ >1: ,| ~+ ,<>::#1 ^1/#|",
    "repeats": "bookmark clause " * 40,
    "random": "parallel recorded primer excessive strainer turbine oscillator fatigue borehole insulation gravel vertical baseline dataset gradient",
    "cid": "(cid:12)(cid:99)(cid:41)\n" * 6,
    "code": "```\nlet a_1 = 3;\nlet b_2 = f(a_1);\nreturn b_2;\n```",
    "formula": "$$ x = y + z $$",
}
KIND = {"list": "list", "labels": "list", "contents": "list", "table": "table", "csv": "table", "noise": "junk", "repeats": "junk", "random": "junk", "cid": "junk"}


@pytest.mark.parametrize("name", KIND)
def test_some_function_votes_right(name):
    v = K.votes(K.statistics(PARTS[name], FW))
    said = [k for i, (_, k, _) in enumerate(K.LABELLERS) if v >> i & 1]
    assert KIND[name] in said


def test_learning_needs_no_labels():
    patterns = [(0b111, 900), (0b110000, 100), (0b1100000000, 80), (1 << 13, 40), (1 << 12 | 1 << 13, 30), (0, 20)]
    post, right, wrong = K.learn(patterns)
    assert post[0b111].argmax() == K.KINDS.index("prose")
    assert post[1 << 13].argmax() == K.KINDS.index("junk")
    assert (right > wrong).all()
    assert all(abs(p.sum() - 1) < 1e-9 for p in post.values())
    assert K.learn([])[0] == {}


def test_documents(make, common):
    rows = [(100 + k, "# T\n\n" + "\n\n".join([PROSE] * 3), None, T0) for k in range(60)]
    rows += [(k, f"<!-- page:1 -->\r\n\r\n## Head\r\n\r\n{t}\n\n{t}", None, T0) for k, t in enumerate(PARTS.values())]
    rows += [(50, None, None, T0), (51, "", None, T0), (52, "# only a heading", None, T0), (53, PROSE + "\n\n" + PARTS["formula"], None, T0)]
    rows += [(54, PARTS["table"], None, T0), (54, PROSE, None, T1), (55, PARTS["list"], None, None), (55, PARTS["list"], None, None), (56, PARTS["csv"] * 3000, None, T0)]
    got = {r.doc_id: r.text_kind for r in K.text_kinds(make("rendered", rows), common).collect()}
    want = {k: KIND[n] for k, n in enumerate(PARTS) if n in KIND} | {55: "list", 56: "table"}
    assert got == want
    stats = K.document_statistics(make("rendered", rows), common, make("reports", [(0, "s", None, 2, 3)])).where("doc_id = 0").first()
    assert stats.mostly_low_density
    assert stats.prose_share > 0.9
    assert 3 < stats.mean_word_length < 5


def test_empty(make, common):
    assert K.text_kinds(make("rendered", []), common).count() == 0
