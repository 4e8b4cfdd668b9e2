"""Garbled text from wrong character encodings (problem 6).

Garbled forms of every distinct clean corpus word are generated under all encoding chains, and
the documents' words are hash-joined against that table; a join hit that passes the check below
is a garbled word, and its verified original is substituted.

A *word* here is a maximal run of ASCII letters, ASCII digits and non-ASCII characters with at
least one non-ASCII character: wrong decoding never makes or breaks ASCII characters. Chains are
(written as UTF-8, read as X), (written as S, read as T) for single-byte S and T, (written as S,
read as UTF-8 or ASCII with replacement characters), UTF-8 chains applied up to three times, UTF-8
read in a multi-byte encoding, and multi-byte text read in a Western encoding. Bytes that a
single-byte encoding leaves undefined are read as the control characters of the same number. UTF-16
is no chain: reading it wrong gives null characters or parts no words.

A hit (garbled g, original o) is accepted when o looks like a word and g does not, or when g has
at least ``MIN_SHAPED`` characters and o occurs in at least ``ratio`` times as many files as g in
any case. Up to three characters that are ASCII and look-alikes of it prove nothing. A word with U+FFFD in it is garbled also
without an original; a single U+FFFD that stands alone at the start of a line replaces a bullet
and is no case.

Scale: texts are read once and never shuffled: only words with non-ASCII characters leave the scan
(JVM regular expression) and are written, they are counted per file with map-side combining, and
Python sees each distinct word once. Garbled forms with a character that no word of the corpus has
cannot match and are not emitted; the characters in use, at most as many as Unicode has, go to the
driver for that. The joins are on the word, after the words of each block are made distinct, so a
hot word costs one row per block that holds it, and only garbled words are joined back.

Defined results: rows without doc_id give none; null and empty texts give no rows; of repeated deliveries the newest file
stands; ties between originals go to the word in more files, then to the smaller one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import newest_files, written

#: Single-byte encodings whose mix-ups are searched.
SINGLE_BYTE = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac-roman", "cp437", "cp850", "cp852", "iso8859-5", "iso8859-15", "mac-cyrillic")
#: Encodings that UTF-8 text is often read as twice or more.
REPEATED = ("cp1252", "latin-1")
#: Encodings of several bytes a character.
MULTI_BYTE = ("gbk", "big5", "shift_jis", "euc_jp", "euc_kr")
#: Western encodings that multi-byte text is read in.
WESTERN = ("cp1252", "latin-1")
#: In how many times more files an original must occur where shape alone doesn't tell.
RATIO = 3.0

#: Least length of a garbled word that itself looks like a word.
MIN_SHAPED = 4

_WORD = r"[0-9A-Za-z\\x{80}-\\x{10FFFF}]*[\\x{80}-\\x{10FFFF}][0-9A-Za-z\\x{80}-\\x{10FFFF}]*"
_READ: dict[str, list[str]] = {}
_WRITE: dict[str, dict[str, int]] = {}


def _tables(name: str) -> tuple[list[str], dict[str, int]]:
    """(character of each byte, byte of each character); undefined bytes stand for C1 controls."""
    if name not in _READ:
        _READ[name] = [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]
        _WRITE[name] = {c: b for b, c in reversed(list(enumerate(_READ[name])))}
    return _READ[name], _WRITE[name]


def write(text: str, name: str) -> bytes | None:
    """The bytes of a text, or None where the encoding lacks a character."""
    if name == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    if name in MULTI_BYTE:
        try:
            return text.encode(name)
        except UnicodeEncodeError:
            return None
    table = _tables(name)[1]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def read(data: bytes, name: str) -> str:
    """The text that reading the bytes gives."""
    if name in ("utf-8", "ascii", *MULTI_BYTE):
        return data.decode(name, "replace")
    table = _tables(name)[0]
    return "".join([table[b] for b in data])


def chains() -> list[tuple[str, ...]]:
    """All chains as (written, read, written, read, ...)."""
    out = [("utf-8", x) for x in SINGLE_BYTE] + [("utf-8", "ascii")]
    out += [(s, t) for s in SINGLE_BYTE for t in (*SINGLE_BYTE, "utf-8", "ascii") if s != t]
    twice = [("utf-8", x, "utf-8", y) for x in REPEATED for y in REPEATED] + [("utf-8", x, "utf-8", x) for x in SINGLE_BYTE if x not in REPEATED]
    thrice = [(*c, "utf-8", y) for c in twice[:4] for y in REPEATED]
    return out + twice + thrice + [("utf-8", m) for m in MULTI_BYTE] + [(m, w) for m in MULTI_BYTE for w in WESTERN]


CHAINS = chains()


def garbled_forms(word: str) -> dict[str, str]:
    """Each garbled form of a word with the first chain that gives it."""
    forms: dict[str, str] = {}
    sent = {s: write(word, s) for s in ("utf-8", *SINGLE_BYTE, *MULTI_BYTE)}
    for chain in CHAINS:
        data = sent[chain[0]]
        if data is None:
            continue
        text = read(data, chain[1])
        for s, t in zip(chain[2::2], chain[3::2], strict=True):
            text = read(write(text, s) or b"", t)
        if text != word and not text.isascii():
            forms.setdefault(text, ">".join(chain))
    return forms


_SHAPE = re.compile(r"(?:[^\W\d_]+[’'ʼ]?)*[^\W\d_]+|[^\W\d_]*\d+[^\W\d_]*")
_SYMBOLS = set("“”‘’„‚«»‹›—–…•°²³¹§·±×€£©®™¿¡ºª№½¼¾µ√∑≤≥≠∞∫‐¬®")
#: Symbols that stand beside ASCII letters and digits in units and formulas.
_UNIT_SYMBOLS = set("°²³·±×µ√∑≤≥≠’–—")


def looks_like_word(word: str) -> bool:
    """Whether a run reads as text: known symbols around letters of one script in a usual case pattern."""
    core = word.lstrip("“‘„‚«‹—–…•¿¡§±").rstrip("”’“»›—–…•")
    if not core:
        return len(word) <= 2
    if all(c in _UNIT_SYMBOLS or c.isascii() for c in core) and any(c.isascii() for c in core):
        return True
    letters = [c for c in core if c.isalpha()]
    for c in core:
        if not (c.isalpha() or c.isdigit() or c in "’-°²³µΩ") and unicodedata.category(c) != "Mn":
            return len(core) == 1 and c in _SYMBOLS
        if c in "ªºµ" and len(core) > 2:
            return False
    if len({_script(c) for c in letters if c not in "Ωµ"}) > 1:
        return False
    body = "".join(letters)
    return body.islower() or body.isupper() or (body[:1].isupper() and body[1:].islower()) or any(part and part[0].isupper() for part in core.split("’")[1:])


def _script(c: str) -> str:
    return "L" if c < "ɐ" else "C" if "Ѐ" <= c <= "ԯ" else "G" if "Ͱ" <= c <= "Ͽ" else "O"


#: Words that one task generates forms of.
TASK_WORDS = 5_000


def garbled_words(words: DataFrame) -> DataFrame:
    """(garbled, original, chain, n_files) for distinct words (word, n_files): the hash table.

    Only words that look like words have forms; those with a character outside the words are left
    out. Words are few bytes but much work, so they are spread by their number.
    """
    tasks = max(1, -(-words.count() // TASK_WORDS))
    used = {r[0] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()}  # characters: bounded by Unicode

    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for word, n in zip(pdf["word"], pdf["n_files"], strict=True):
                if not looks_like_word(word):
                    continue
                for form in {word, word.lower(), word.upper(), word.capitalize()}:
                    rows += [(g, form, chain, n) for g, chain in garbled_forms(form).items() if used.issuperset(g)]
                for c in set(word):
                    if c in _SYMBOLS and c != word:
                        rows += [(g, c, chain, n) for g, chain in garbled_forms(c).items() if len(g) > 1 and used.issuperset(g)]
            yield pd.DataFrame(rows, columns=["garbled", "original", "chain", "n_files"])

    clean = words.where(~F.col("word").contains("�")).select("word", "n_files").repartition(tasks, "word")
    forms = clean.mapInPandas(generate, "garbled string, original string, chain string, n_files bigint")
    return forms.groupBy("garbled", "original").agg(F.min("chain").alias("chain"), F.max("n_files").alias("n_files"))


#: A replacement character alone inside a line, in place of a word; kept as a word with a space, as no word has one.
_LONE = "� "


def block_words(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_num, block_id, word): distinct words with non-ASCII characters of each block of the newest extractions.

    A file is always delivered whole. An extraction delivered twice gives its words twice.
    """
    rows = blocks.select("doc_id", "page_num", "block_id", "extracted_at", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]"))  # extra columns can't clash
    words = F.expr(f"array_distinct(regexp_extract_all(text, '{_WORD}', 0))")
    lone = F.when(F.col("text").rlike(r"[^\n] � ?"), F.array(F.lit(_LONE))).otherwise(F.array().cast("array<string>"))
    found = rows.select("doc_id", "page_num", "block_id", "extracted_at", F.explode(F.concat(words, lone)).alias("word"))
    return newest_files(found, delivered=blocks).select("doc_id", "page_num", "block_id", "word")


def word_counts(words: DataFrame) -> DataFrame:
    """(word, n_files): in how many files each word occurs."""
    return words.where(F.col("word") != _LONE).select("doc_id", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n_files"))


def verified(counts: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(word, original, chain): garbled words with their best verified original."""
    folded = counts.groupBy(F.lower("word").alias("folded")).agg(F.sum("n_files").alias("n_word"))
    shaped = F.pandas_udf(lambda words: words.map(looks_like_word), "boolean")  # of hits only
    seen = counts.select("word", F.lower("word").alias("folded")).hint("merge").join(folded, "folded")
    hits = seen.hint("merge").join(garbled_words(counts).withColumnRenamed("garbled", "word"), "word")
    frequent = (F.length("word") >= MIN_SHAPED) & (F.col("n_files") >= F.col("n_word") * F.lit(ratio))
    weak = F.col("word").rlike("^[A-Za-z\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456]{1,3}$")
    hits = hits.where(frequent | ~weak).withColumn("word_shaped", shaped("word")).where((~F.col("word_shaped") & ~weak) | frequent)
    best = F.min_by(F.struct("original", "chain"), F.struct(-F.col("n_files"), "original", "chain")).alias("v")
    return hits.groupBy("word").agg(best).select("word", "v.*")


def garbled_block_words(blocks: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(doc_id, page_num, block_id, word, original, chain): garbled words of each block; original is null where it is lost."""
    words = written(block_words(blocks), "block-words")
    known = written(verified(written(word_counts(words), "word-counts"), ratio), "garbled")
    words = words.hint("merge")  # many rows in few bytes of file: not to be broadcast
    hits = words.join(known, "word").select("doc_id", "page_num", "block_id", "word", "original", "chain")
    lost = words.where(F.col("word").contains("�") & (F.col("word") != "�")).join(known, "word", "left_anti")
    none = F.lit(None).cast("string")
    lost = lost.select("doc_id", "page_num", "block_id", F.trim("word").alias("word"), none.alias("original"), none.alias("chain"))
    return hits.where(F.col("word") != "�").unionByName(lost).distinct()


def garbled_blocks(blocks: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(doc_id, page_num, block_id) of the blocks with at least one garbled word."""
    return garbled_block_words(blocks, ratio).select("doc_id", "page_num", "block_id").distinct()


def repaired_blocks(blocks: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(doc_id, page_num, block_id, text, n_garbled, n_restored) of the affected blocks, originals substituted word by word."""
    hits = garbled_block_words(blocks, ratio)
    pairs = F.array_sort(F.collect_set(F.when(F.col("original").isNotNull(), F.struct((-F.length("word")).alias("k"), "word", "original"))))
    per = hits.groupBy("doc_id", "page_num", "block_id").agg(F.count(F.lit(1)).alias("n_garbled"), F.count("original").alias("n_restored"), pairs.alias("pairs"))
    texts = blocks.select("doc_id", "page_num", "block_id", "extracted_at", "text").where(F.col("text").rlike(r"[^\x00-\x7F]"))
    texts = newest_files(texts, delivered=blocks).select("doc_id", "page_num", "block_id", "text").distinct()
    # Whole words only: a garbled word inside another word is left.
    edge = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"
    whole = lambda w: F.concat(F.lit(f"(?<!{edge})\\Q"), w, F.lit(f"\\E(?!{edge})"))
    fixed = F.aggregate("pairs", F.col("text"), lambda acc, p: F.regexp_replace(acc, whole(p["word"]), p["original"]))
    return texts.join(per, ["doc_id", "page_num", "block_id"]).select("doc_id", "page_num", "block_id", fixed.alias("text"), "n_garbled", "n_restored")
