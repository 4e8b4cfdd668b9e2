"""Leakage: against a brute-force search, word rules, offsets, edge cases."""

import random

from conftest_llm import T0, T1

from docloom.llm import leakage as L


def brute(docs, items, run=12):
    windows = lambda t: {tuple(w[k : k + run]) for w in [L.words_of(t)] for k in range(len(w) - run + 1)} if t else set()
    return {(d, i) for d, t in docs for i, p in items if windows(t) & windows(p)}


def test_against_brute_force(make):
    rnd = random.Random(3)
    vocab = [f"w{k}" for k in range(6)]
    items = [(k, " ".join(rnd.choices(vocab, k=rnd.randint(5, 40)))) for k in range(20)]
    docs = []
    for d in range(60):
        text = rnd.choices(vocab, k=rnd.randint(0, 60))
        p = rnd.choice(items)[1].split()
        cut = rnd.randint(0, len(p))
        docs.append((d, ", ".join(text[:10] + p[cut : cut + rnd.randint(5, 20)] + text[10:]).upper()))
    got = {tuple(r) for r in L.leaks(make("documents", [(d, t, "en", T0) for d, t in docs]), make("items", items)).collect()}
    assert got == brute(docs, items)
    blocks = L.leak_spans(make("documents", [(d, t, "en", T0) for d, t in docs]), make("items", items), block_words=60)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == got


def test_words_and_offsets(make):
    passage = "Der Straße nach Süden folgt ein Weg von 12 km bis zum Tor"
    text = "Vorher — DER STRASSE; nach_Süden (folgt) ein\nWeg von 12 km: bis zum TOR! Danach"
    docs = make("documents", [(1, text, None, None), (1, text, None, None), (2, None, None, None), (3, "", None, None), (4, passage.replace("12", "13"), None, None), (5, "x " * 300_000 + passage, None, None)])
    items = make("items", [(7, passage), (8, passage), (9, None), (10, "too short")])
    rows = L.leak_spans(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 7), (1, 8), (5, 7), (5, 8)}
    hit = next(r for r in rows if r.doc_id == 1)
    assert text[hit.char_start : hit.char_end].startswith("DER")
    assert text[hit.char_start : hit.char_end].endswith("TOR")


def test_empty(make):
    assert L.leaks(make("documents", []), make("items", [(1, "a " * 20)])).count() == 0
    assert L.leaks(make("documents", [(1, "a " * 20, None, None)]), make("items", [])).count() == 0


def test_questions_and_answers(make):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = make("items", [(1, passage, "Which valve is meant below the quay?", "the winch"), (2, None, "What now?", "never"), (3, None, None, "winch"), (4, None, "Tell me in one sentence of at least thirteen words what the level of the tank was", "low")])
    docs = make("documents", [
        (10, "Quiz! Which VALVE is meant, below the quay? Answer: The winch.", None, T0),
        (11, "The winch alone. What now? never", None, T0),
        (12, "Which valve is meant below the quay " + "and so on " * 60 + "the winch", None, T0),
        (13, "it says: in one sentence of at least thirteen words what the level of it was low", None, T0),
        (14, "a " + passage + " b", None, T0), (14, "nothing now", None, T1),
        (15, "nothing", None, T0), (15, "a " + passage + " b", None, T1),
        (16, "tell me in one sentence of at least thirteen words what the level of the tank was. Low.", None, T0),
    ])
    rows = {(r.doc_id, r.item_id, r.field): r.n_words for r in L.leak_spans(docs, items).collect()}
    assert rows == {(10, 1, "question"): 7, (10, 1, "answer"): 2, (12, 1, "question"): 7, (13, 4, "question"): 12, (15, 1, "text"): 13, (16, 4, "question"): 17, (16, 4, "answer"): 1} | ({(13, 4, "answer"): 1} if (13, 4, "answer") in rows else {})
    assert {tuple(r) for r in L.leaks(docs, items).collect()} == {(15, 1)}
    small = {(r.doc_id, r.item_id, r.field): r.n_words for r in L.leak_spans(docs, items, block_words=10).collect()}
    assert small == rows


def test_blocks_stay_under_the_bound(make):
    items = make("items", [(k, "word " * 50) for k in range(40)])
    sizes = [sum(len(x[1].split()) for x in b) for b in L._blocks(items, 300)]
    assert sum(sizes) == 2000
    assert max(sizes) <= 300
