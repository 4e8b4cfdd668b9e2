"""Packing: every token once, no container over its capacity, little unused space, token counts."""

from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import T0, T1
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=200))
def test_pack(sizes):
    sizes = np.array(sorted(sizes, reverse=True))
    where = P.pack(sizes, 100, 1.0, 0.01)
    fill = np.bincount(where, weights=sizes)
    assert fill.max() <= 100
    assert len(fill) <= 2 * np.ceil(sizes.sum() / 100) + 1


def by_scan(sizes, capacity, linear, quadratic):
    """The lowest-cost sequence with room by looking at every open one; full pieces first, on their own."""
    full = sum(x == capacity for x in sizes)
    rest = sizes[full:]
    bins = [[0.0, capacity] for _ in range(max(1, -(-sum(rest) // capacity)) if rest else 0)]
    out = list(range(full))
    for x in rest:
        fits = [(cost, k) for k, (cost, room) in enumerate(bins) if room >= x]
        if not fits:
            bins.append([0.0, capacity])
            fits = [(0.0, len(bins) - 1)]
        k = min(fits)[1]
        bins[k] = [bins[k][0] + linear * x + quadratic * float(x) * float(x), bins[k][1] - x]
        out.append(full + k)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=150))
def test_pack_equals_a_scan_of_all_sequences(sizes):
    sizes = sorted(sizes, reverse=True)
    assert P.pack(np.array(sizes), 60, 1.0, 0.01).tolist() == by_scan(sizes, 60, 1.0, 0.01)


def test_pack_is_not_quadratic():
    sizes = np.sort(np.random.default_rng(1).integers(1, 2048, 60_000))[::-1]
    sizes = np.concatenate([np.full(500_000, 2048), sizes])
    where = P.pack(sizes, 2048, 1.0, 1 / 4096)
    assert np.bincount(where, weights=sizes).max() <= 2048


@pytest.fixture(scope="module")
def placed(make):
    rows = [(k, "word " * (10 + k % 200), "en", T0) for k in range(800)]
    rows += [(900, "word " * 9000, None, None), (901, None, None, T0), (902, "", None, T0), (903, "old " * 50, None, T0), (903, "new", None, T1), (904, "twice", None, T0), (904, "twice", None, T0)]
    return P.packed(make("documents", rows), shard_items=300).collect(), P.token_counts(make("documents", rows)).collect()


def test_everything_once_and_within_capacity(placed):
    rows, counts = placed
    fill, got = defaultdict(int), defaultdict(list)
    for r in rows:
        fill[r.container] += r.token_end - r.token_start
        got[r.doc_id].append((r.token_start, r.token_end))
    assert max(fill.values()) <= P.CAPACITY
    for c in counts:
        spans = sorted(got.pop(c.doc_id))
        assert spans[0][0] == 0
        assert spans[-1][1] == c.n_tokens
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) == 1 or c.n_tokens > P.CAPACITY
    assert not got
    assert sum(fill.values()) / (len(fill) * P.CAPACITY) > 0.9


def test_positions_follow_each_other(placed):
    per = defaultdict(list)
    for r in placed[0]:
        per[r.container].append((r.position, r.position + r.token_end - r.token_start))
    assert all(a[1] == b[0] for spans in per.values() for a, b in zip(sorted(spans), sorted(spans)[1:]))


def test_counts(placed):
    n = {c.doc_id: c.n_tokens for c in placed[1]}
    assert n[903] == len(P.tokenizer().encode_ordinary("new"))
    assert 901 not in n
    assert 902 not in n


def test_empty(make):
    assert P.packed(make("documents", [])).count() == 0
