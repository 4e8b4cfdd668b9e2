"""Evaluation texts leaking into training text (problem 9).

One Aho-Corasick automaton over the normalised test passages, questions and answers scans each
document once. A word is a maximal run of Unicode letters or digits, case ignored, and everything
between words is ignored. The automaton's alphabet is word numbers, so a match always starts and ends
at words, and positions map back to characters of the text. Patterns are, by field of an item:

* text: each window of ``run`` words;
* question: each window of ``run`` words, or the whole question where it is shorter but has at
  least ``least`` words (fewer words occur by chance);
* answer: the whole answer, which counts only within ``near`` words of the item's question.

Scale: the documents are scanned where they lie, with no shuffle of texts; only rows of leaks are
shuffled. The test set is the fixed side. It streams through the driver in blocks of at most
``block_words`` words, a bound that does not grow with the corpus or the test set: each block is one
broadcast automaton (under 60 MB), one scan whose rows are written to the shared folder, and is given
up before the next is read. A larger test set costs more scans, not memory.

Defined results: rows without an id give none; null and empty texts and passages under ``run`` words match nothing; passages
that occur in two items report both; of a document delivered twice the newest counts, both where they are as new.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import of_newest, written

RUN = 12
#: Fewest words of a question that is searched as a whole.
LEAST = 4
#: Most words between an answer and its question.
NEAR = 50
#: Most words of test items that one automaton holds.
BLOCK_WORDS = 400_000

FIELDS = ("text", "question", "answer")
_WORD = re.compile(r"[^\W_]+")
#: Automatons of this worker by block, kept between batches.
_BUILT: dict[str, tuple] = {}


def words_of(text: str) -> list[str]:
    """The words of a text, case folded."""
    return _WORD.findall(text.casefold())


def _automaton(key: str, items: list[tuple], run: int, least: int):
    """(word numbers, automaton) for one block, built once per worker; a pattern's value is (length, owners)."""
    if key not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        numbers: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[tuple[int, int]]] = {}

        def add(item: int, field: int, text: str | None, whole: bool, shortest: int) -> bool:
            seq = tuple([numbers.setdefault(w, len(numbers) + 1) for w in words_of(text or "")])
            if len(seq) < shortest:
                return False
            for k in range(max(1, len(seq) - run + 1)) if not whole else (0,):
                owners.setdefault(seq if whole else seq[k : k + run], set()).add((item, field))
            return True

        for item, text, question, answer in items:
            add(item, 0, text, False, run)
            if add(item, 1, question, False, least):
                add(item, 2, answer, True, 1)
        found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in owners.items():
            found.add_word(window, (len(window), tuple(sorted(ids))))
        if owners:
            found.make_automaton()
        _BUILT[key] = (numbers, found if owners else None)
    return _BUILT[key]


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """The test items in blocks under the bound, streamed to the driver one partition at a time."""
    block, size = [], 0
    for row in items.where("item_id is not null").select("item_id", *FIELDS).distinct().toLocalIterator():
        n = sum(len(t) // 2 + 1 for t in row[1:] if t)  # words at most
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += n
    if block:
        yield block


def _hits(seq: tuple, automaton, near: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(first word, last word) of the longest stretch by (item, field)."""
    open_: dict[tuple[int, int], tuple[int, int]] = {}
    best: dict[tuple[int, int], tuple[int, int]] = {}
    asked: dict[int, list[int]] = {}
    answers = []
    for end, (length, ids) in automaton.iter(seq):
        for who in ids:
            if who[1] == 2:
                answers.append((who, end - length + 1, end))
                continue
            first, last = open_.get(who, (0, -2))
            first = first if last == end - 1 else end - length + 1
            open_[who] = (first, end)
            if who[1] == 1:
                asked.setdefault(who[0], []).append(end)
            if who not in best or end - first > best[who][1] - best[who][0]:
                best[who] = (first, end)
    if asked:
        for who, first, end in answers:
            if who not in best and any(abs(q - end) <= near + end - first for q in asked.get(who[0], ())):
                best[who] = (first, end)
    return best


def leak_spans(documents: DataFrame, items: DataFrame, run: int = RUN, block_words: int = BLOCK_WORDS, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """(doc_id, item_id, field, n_words, char_start, char_end): the longest shared stretch of each document and field of an item.

    ``n_words`` counts the words of the longest unbroken stretch; the offsets are positions in the original text.
    """
    schema = "doc_id bigint, collected_at timestamp, item_id bigint, field string, n_words int, char_start int, char_end int"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    texts = documents.select("doc_id", "collected_at", "text").where("doc_id is not null and text <> ''")
    scans = []
    for block in _blocks(items, block_words):
        shared = documents.sparkSession.sparkContext.broadcast(block)
        key = uuid.uuid4().hex

        def scan(batches: Iterator[pd.DataFrame], shared=shared, key=key) -> Iterator[pd.DataFrame]:
            numbers, automaton = _automaton(key, shared.value, run, least)
            get = numbers.get
            for pdf in batches:
                rows = []
                for doc, when, text in zip(pdf["doc_id"], pdf["collected_at"], pdf["text"], strict=True):
                    if automaton is None:
                        continue
                    seq = tuple([get(w, 0) for w in _WORD.findall(text.casefold())])
                    best = _hits(seq, automaton, near) if seq else None
                    if best:
                        at = _offsets(text, len(seq))
                        rows += [(doc, when, item, FIELDS[field], b - a + 1, at[a][0], at[b][1]) for (item, field), (a, b) in best.items()]
                yield pd.DataFrame(rows, columns=names)

        scans.append(written(texts.mapInPandas(scan, schema), "leaks"))
        shared.destroy()
    if not scans:
        return documents.sparkSession.createDataFrame([], schema).drop("collected_at")
    longest = F.max_by(F.struct("n_words", "char_start", "char_end"), F.struct("n_words", -F.col("char_start"))).alias("v")
    stands = of_newest(reduce(DataFrame.unionAll, scans), documents, ["doc_id"], "collected_at")
    return stands.groupBy("doc_id", "item_id", "field").agg(longest).select("doc_id", "item_id", "field", "v.*")


def _offsets(text: str, n: int) -> list[tuple[int, int]]:
    """Character spans of the words in the original text."""
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) == n:
        return spans
    # Case folding changed the number of words (a letter that folds to several characters): map by folding each word.
    out = []
    for a, b in spans:
        out += [(a, b)] * max(1, len(_WORD.findall(text[a:b].casefold())))
    return (out + [out[-1]] * n)[:n]


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id): every document with the items whose passages leaked into it."""
    return leak_spans(documents, items, run).where("field = 'text'").select("doc_id", "item_id")
