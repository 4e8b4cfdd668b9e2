"""Repeated lines: thresholds, keys, delta merging, cleaning."""

from conftest_llm import T0, T1
from pyspark.sql import functions as F

from docloom.llm import repeated_lines as R


def name(d):
    return "".join("abcdefghij"[int(c)] for c in str(d))


def tables(make, files=30, hot=3):
    blocks = [(d, 0, 0, f"Body {name(d)} text\nShare This Page {d}!" if d < hot else f"Body of {name(d)} alone", 0, T0) for d in range(files)]
    blocks += [(0, 0, 1, None, 1, T0), (0, 0, 2, "", 2, T0), (0, 0, 3, "--- 12", 3, T0), (0, 0, 0, "Body a text\nShare This Page 0!", 0, T0), (99, 0, 0, "share this page 1", 0, T0)]
    furniture = [(d, 0, 0, "press archive") for d in range(files)] + [(d, 0, 1, "7") for d in range(files)] + [(1, 0, 2, None)]
    reports = [(d, "s", None, 0, 1) for d in range(files)] + [(99, None, None, 0, 1)]
    return make("blocks", blocks), make("furniture", furniture), make("reports", reports)


def test_thresholds(make):
    got = {tuple(r) for r in R.repeated_lines(*tables(make)).collect()}
    assert {r for r in got if r[0] == "block"} == {("block", d, 0, 0, 1) for d in range(3)}
    assert len({r for r in got if r[0] == "furniture"}) == 30
    assert not [r for r in R.repeated_lines(*tables(make, files=31)).collect() if r.record == "block"]  # under 10 %
    assert not [r for r in R.repeated_lines(*tables(make, files=10, hot=2)).collect() if r.record == "block"]  # under 3 files


def test_files_without_text_count(make):
    b, f, r = tables(make, files=30)
    b = b.unionByName(make("blocks", [(500, 0, 0, None, 0, T0)]))
    r = r.unionByName(make("reports", [(500, "s", None, 0, 1)]))
    assert not [x for x in R.repeated_lines(b, f, r).collect() if x.record == "block"]  # 3 of 31 files


def test_cleaned(make):
    rows = {(r.doc_id, r.block_id): r.text for r in R.cleaned_blocks(*tables(make)).collect()}
    assert rows[(0, 0)] == "Body a text"
    assert rows[(5, 0)] == "Body of f alone"
    assert rows[(99, 0)] == "share this page 1"


def test_newest_text_counts(make):
    b, f, r = tables(make)
    b = b.unionByName(make("blocks", [(0, 0, 0, "Other words", 0, T1)]))
    assert not [x for x in R.repeated_lines(b, f, r).collect() if x.record == "block"]


def test_crossings_of_a_delta(make):
    b, f, r = tables(make, files=40, hot=5)
    state = R.loaded(b.where("doc_id < 2"), f.where("doc_id < 2"), r)
    assert state.over.count() == 0
    after, rebuild = R.merged(state, b.where("doc_id between 2 and 30"), f.where("doc_id between 2 and 30"))
    assert {x.record for x in after.over.collect()} == {"block", "furniture"}
    assert {x.doc_id for x in rebuild.collect()} == {*range(31)}
    after, rebuild = R.merged(after, b.where("doc_id > 30"), f.where("doc_id > 30"))
    assert {x.doc_id for x in rebuild.collect()} == {*range(31, 40), 99}  # nothing crosses: 5 of 40 files
    more = make("blocks", [(d, 0, 0, f"Body {name(d)} text", 0, T0) for d in range(200, 215)])
    after, rebuild = R.merged(after, more, f.limit(0), make("reports", [(d, "s", None, 0, 1) for d in range(200, 215)]))
    assert [x.record for x in after.over.collect()] == ["furniture"]  # 5 of 55 files: the line falls under the share
    assert {x.doc_id for x in rebuild.collect()} == {*range(5), *range(200, 215)}
    assert {x.doc_id for x in R.found_lines(after).collect()} == set(range(40))


def test_the_cut_changes_nothing(make):
    b, f, r = tables(make, files=30)
    times = make("blocks", [(d, 0, 0, f"Body of {name(d)} now\nShare This Page {d}!", 0, T1) for d in range(2, 6)] + [(70, 0, 0, "Share this page", 0, None)])
    b, r = b.unionByName(times), r.unionByName(make("reports", [(70, "s", None, 0, 1)]))
    rows = lambda df: sorted(map(str, df.collect()))
    want = R.loaded(b, f, r)
    for share in (0.0, 0.5, 1.0):
        assert rows(R.repeated_lines(b, f, r, first_share=share)) == rows(R.found_lines(want))
    assert rows(R.cleaned_blocks(b, f, r, first_share=0.5)) == rows(R.rebuilt_blocks(b, R.found_lines(want)))
    table = {(x.record, x.key): (x.source, x.n_files, x.files) for x in R.repeated_line_table(b, f, r, first_share=0.5).collect()}
    assert table["block", "sharethispage0"] == ("s", 6, 31)
    assert table["furniture", "pressarchive"] == ("s", 30, 31)


def test_empty(make):
    assert R.repeated_lines(make("blocks", []), make("furniture", []), make("reports", [])).count() == 0


def test_partitions_with_files_delivered_again_equal_a_full_count(make):
    b, f, r = tables(make, files=40, hot=3)
    late = make("blocks", [(0, 0, 0, "Other words", 0, T1), (2, 0, 0, "Body c text\nShare This Page 2!", 0, T0), (50, 0, 0, "New\nShare This Page 5", 0, T1), (51, 0, 0, "Share this page", 0, T1), (51, 0, 1, "Share this page 51", 1, T1), (7, 0, 1, "Share This Page 7", 1, T1), (60, 0, 0, None, 0, T0)])
    again = make("furniture", [(3, 0, 0, "press archive"), (50, 0, 0, "press archive"), (8, 0, 5, None)])
    named = make("reports", [(50, "s", None, 0, 1), (60, "s", None, 0, 1), (51, "s", None, 0, 1), (9, "t", None, 0, 1)])
    all_b, all_f, all_r = b.unionByName(late), f.unionByName(again), r.unionByName(named)
    want = R.loaded(all_b, all_f, all_r)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).distinct().collect()))
    first = R.loaded(b, f, r)
    got, rebuild = R.merged(first, late, again, named)
    totals = lambda st: rows(st.counts.groupBy("source", "record", "key").agg(F.sum("n_files").alias("n_files")).where("n_files <> 0"))
    assert totals(got) == totals(want)
    assert [rows(getattr(got, k)) for k in ("files", "sizes", "over")] == [rows(getattr(want, k)) for k in ("files", "sizes", "over")]
    assert rows(R.standing(got.lines, got.files)) == rows(R.standing(want.lines, want.files))
    assert rows(R.found_lines(got)) == rows(R.repeated_lines(all_b, all_f, all_r))
    assert rows(R.found_lines(R.merged(got, b, f, r)[0])) == rows(R.found_lines(got))  # older text again
    assert rows(R.rebuilt_blocks(all_b, R.found_lines(got))) == rows(R.cleaned_blocks(all_b, all_f, all_r))
    assert {x.doc_id for x in rebuild.collect()} == {0, 1, 2, 3, 7, 8, 9, 50, 51, 60}
