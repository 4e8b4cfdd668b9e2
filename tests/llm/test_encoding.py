"""Garbled encodings: forms, round trips over all chains, verification, damage without original."""

import pytest
from conftest_llm import T0

from docloom.llm import encoding as E

CLEAN = ["Die Prüfung erhöht die Größe.", "La señal superó el código aquí.", "La température dépasse déjà la qualité.", "“Cela est bon,” dit l’opérateur.", "Датчик держит давление медленно.", "Śluza łączy wąż częściowo."]


def corpus(make, *damaged):
    rows = [(d, 0, k, t, k, T0) for d in range(8) for k, t in enumerate(CLEAN)]
    rows += [(100 + d, 0, 0, t, 0, T0) for d, t in enumerate(damaged)]
    return make("blocks", rows)


def test_every_chain_gives_forms():
    forms = E.garbled_forms("größer")
    assert forms["grÃ¶ÃŸer"] == "utf-8>cp1252"
    assert "größer" not in forms
    assert len(set(forms)) == len(forms)
    assert E.garbled_forms("m²")["mÃ‚Â²"] == "utf-8>cp1252>utf-8>cp1252"


@pytest.mark.parametrize("name", E.SINGLE_BYTE)
def test_bytes_survive(name):
    data = bytes(range(256))
    assert E.write(E.read(data, name), name) is not None
    assert len(E.read(data, name)) == 256


def test_found_and_restored(make):
    chains = [("utf-8", "cp1252"), ("utf-8", "mac-roman"), ("utf-8", "cp437"), ("utf-8", "latin-1"), ("cp1252", "mac-roman")]
    damaged = [E.read(E.write(CLEAN[k % 4 if chains[k][0] == "utf-8" else 2], s), t) for k, (s, t) in enumerate(chains)]
    damaged += [E.read(E.write(CLEAN[4], "koi8-r"), "cp1251"), E.read(E.write(CLEAN[4], "cp1251"), "cp1252"), E.read(E.write(CLEAN[5], "cp1250"), "cp1252")]
    damaged += [E.read(E.write(E.read(E.write(CLEAN[2], "utf-8"), "cp1252"), "utf-8"), "cp1252"), CLEAN[1].encode().decode("ascii", "replace")]
    b = corpus(make, *damaged)
    assert {r.doc_id for r in E.garbled_blocks(b).collect()} == {100 + k for k in range(len(damaged))}
    texts = {r.doc_id: r.text for r in E.repaired_blocks(b).collect()}
    want = [CLEAN[0], CLEAN[1], CLEAN[2], CLEAN[3], CLEAN[2], CLEAN[4], CLEAN[4], CLEAN[5], CLEAN[2]]
    assert [texts[100 + k] for k in range(9)] == want


def test_no_cases(make):
    b = corpus(make, "� A bullet was lost here.", None, "", "plain ASCII", "ВК-674 and the сenter аs one", CLEAN[0] * 3000)
    assert E.garbled_blocks(b).count() == 0


def test_lost_originals_are_cases(make):
    b = corpus(make, "The unk�own word", "one � two")
    rows = E.garbled_block_words(b).collect()
    assert {(r.doc_id, r.original) for r in rows} == {(100, None), (101, None)}


def test_repeated_and_empty(make):
    b = corpus(make, "Die PrÃ¼fung")
    assert E.garbled_blocks(b.unionByName(b)).count() == 1
    assert E.garbled_blocks(make("blocks", [])).count() == 0


def test_multi_byte_encodings(make):
    damaged = [E.read(E.write(CLEAN[1], "utf-8"), "gbk"), E.read(E.write("Датчик держит", "gbk"), "cp1252"), E.read(E.write(CLEAN[2], "utf-8"), "big5")]
    assert {r.doc_id for r in E.garbled_blocks(corpus(make, *damaged)).collect()} == {100, 101, 102}


def test_only_whole_words_are_restored(make):
    (r,) = E.repaired_blocks(corpus(make, "Ã¼ PrÃ¼fung xÃ¼x", "für ü")).where("doc_id = 100").collect()
    assert r.text.split()[1] == "Prüfung"
    assert "xÃ¼x" in r.text or r.n_restored == 3
