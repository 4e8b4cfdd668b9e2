"""Recall of the searches for damaged words on damage planted here, over all chains, look-alikes and confusions."""

import random

from conftest_llm import T0

from docloom.llm import encoding, lookalikes, scan_noise

CLEAN = ["Die Prüfung erhöht die Größe über Nacht.", "La señal superó el código aquí también.", "La température dépasse déjà la qualité prévue.", "Датчик держит давление медленно вблизи.", "Śluza łączy wąż częściowo również.", "Größere Häuser stützen die Brücke."]


def test_garbled_by_every_chain(make):
    damaged = []
    for chain in encoding.CHAINS:
        for text in CLEAN:
            out = text
            for s, t in zip(chain[::2], chain[1::2], strict=True):
                data = encoding.write(out, s) if out is not None else None
                out = encoding.read(data, t) if data is not None else None
            if out is not None and out != text and not out.isascii():
                damaged.append(out)
    rows = [(d, 0, k, t, k, T0) for d in range(12) for k, t in enumerate(CLEAN)] + [(1000 + d, 0, 0, t, 0, T0) for d, t in enumerate(damaged)]
    found = {r.doc_id for r in encoding.garbled_blocks(make("blocks", rows)).collect()}
    assert not found & set(range(12))
    assert len(damaged) > 500
    assert len(found) >= 0.97 * len(damaged)


def test_borrowed_letters_of_the_whole_table(make, spark):
    table = lookalikes.lookalikes(spark)
    by_latin: dict[str, list[str]] = {}
    for c, a in table.latin.items():
        by_latin.setdefault(a, []).append(c)
    rnd = random.Random(7)
    words, plain = [], "valve pump turbine Sensor Kessel hydrant Portal cylinder Yard flange".split()
    for c, a in table.latin.items():
        w = rnd.choice([x for x in plain if a in x] or [f"max{a}mum"])
        words.append(w.replace(a, c, 1))
    rows = [(1, 0, k, 0, w, T0) for k, w in enumerate(words)] + [(2, 0, k, 0, w, T0) for k, w in enumerate(plain)]
    found = {(r.doc_id, r.item_id) for r in lookalikes.inconsistent(make("words", rows), make("formulas", []), make("blocks", [])).collect()}
    assert not [d for d, _ in found if d == 2]
    assert len(found) >= 0.99 * len(words)


def test_every_confusion(make):
    stems = "measure valve turbine concrete impeller hydrant winch manifold quarry village library buckle winding killer ballast inlet dinner cylinder gravel pillow".split()
    pairs = sorted({(w, w.replace(o, m, 1)) for m, o in scan_noise.CONFUSIONS for w in stems if o in w})
    clean = [(d, 0, 0, " ".join(stems), 0, T0) for d in range(10, 40)]
    scans = [(1, 1, k, f"{bad} stands here", k, T0) for k, (_, bad) in enumerate(pairs) if bad not in stems]
    blocks, triage = make("blocks", clean + scans), make("triage", [(1, [2], T0)])
    found = {r.block_id for r in scan_noise.scan_defects(blocks, triage, make("reports", [])).where("defect = 'misread'").collect()}
    assert len(scans) > 80
    assert len(found) >= 0.97 * len(scans)
