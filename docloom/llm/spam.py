"""Keyword-stuffed and link-list pages (problem 10).

Every text is cut into segments (paragraphs; lines where a paragraph mixes kinds); segments of under
``JUDGED`` words without sentences, links or tags are taken together, so that keyword lines have
shares too. Per segment the operator measures top-word share, repeated n-gram share, duplicate-line
share, link-text ratio, tag share, separator density, function-word share and sentence ends. A limit
of each share is calibrated per language on the typical segment of that language: the median over
its sentences (n-grams, lines and variety: over its segments without sentences, mostly lists and
tables), and from there a fixed part of the way to 1; for function words and separators the upper
quartile. Stuffed pages are a minority and do not move these. A language's figures are shrunk towards
those of all languages with the weight of ``PRIOR`` segments, so a rare language has no limits of its
own accord and none is left out. A document is found when segments over the limits hold more than
half its characters; links that a line such as ``See also:`` introduces count only where sentences hold
under a quarter of the text.

Scale: texts are measured once where they lie, in Arrow batches; what leaves is some numbers per
segment, written to the shared folder because calibration and decision both read them. Quantiles
are mergeable sketches, a few numbers per language. Limits are joined by language as a table of their
own, which Spark broadcasts only while it is small; segments without a language spread over salted
keys. No document or group is collected.

Defined results: null, empty and blank texts are no cases, a row without doc_id gives none; of a document delivered twice the
newest counts, both where they are as new; under ``JUDGED`` words in all have no shares.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import of_newest, written

_WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")
_LINK = re.compile(r"\[[^\]\n]*\]\([^)\s]*\)|<a\b[^>]*>.*?</a>|(?:https?:)?//\S+|\bwww\.\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,12}/\S*", re.IGNORECASE)
_TAG = re.compile(r"(?<!\S)#[^\W_]\w*")
_END = re.compile(r"[^\W_][\"”’»)\]]*[.!?…](?=[\s\"”’»)\]]|$)")
_PRICE = re.compile(r"(?<![\w.,])\d{1,5}[.,]\d\d(?![\w])|[$€£]\s?\d")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
#: A line that introduces a list: some words and a colon.
_LEAD = re.compile(r"[^\n/#|]{1,60}:\s*$")
#: Share of sentences from which a page's introduced links are its references.
REFERRING = 0.25
#: Sentence ends per word from which a segment holds sentences.
SENTENCES = 0.025
#: Fewest words that have shares.
JUDGED = 8
#: A word is frequent in a text when it occurs so often, and makes up so much of the words that are no function words.
FREQUENT, FREQUENT_SHARE = 4, 0.02
_FIELDS = ["seg", "chars", "words", "top", "gram", "dup", "link", "tag", "sep", "function", "ends", "offer", "varied", "led"]
_SCHEMA = "doc_id bigint, collected_at timestamp, lang string, " + ", ".join(f"{f} double" for f in _FIELDS)


def _segments(text: str) -> list[tuple[str, bool]]:
    """(segment, led): paragraphs, cut into lines where these are partly links, tags or offers.

    ``led`` marks the lines of a paragraph that an introducing line such as ``See also:`` heads.
    """
    out = []
    for part in _PARAGRAPH.split(text) if "\n" in text else [text]:
        if "\n" in part and ("/" in part or "#" in part or _PRICE.search(part)):
            lines = [x for x in part.split("\n") if x.strip()]
            kinds = {bool(_LINK.search(x) or _TAG.search(x) or _PRICE.search(x)) for x in lines}
            if len(kinds) == 2:
                led = _LEAD.fullmatch(lines[0]) is not None
                out += [(x, led) for x in lines]
                continue
        if part.strip():
            out.append((part, False))
    return out


def _line_keys(segment: str) -> list[str]:
    return [re.sub(r"\d+", "0", x.strip()) for x in segment.split("\n") if x.strip()]


def measure(text: str, function_words: set[str]) -> list[tuple[float, ...]]:
    """The measures of each segment of a text, in the order of ``_FIELDS``.

    Repetition of n-grams and lines, variety and prices tell only segments without sentences
    apart; for segments with sentence ends they are left 0.
    """
    segments = _segments(text.casefold())
    counts: Counter = Counter()
    parts: list[tuple] = []
    short: list[tuple] = []
    for s, led in segments:
        link = sum(map(len, _LINK.findall(s))) if "/" in s or "www." in s else 0
        ws = _WORD.findall(_LINK.sub(" ", s) if link else s)
        counts.update(ws)
        tag = sum(map(len, _TAG.findall(s))) if "#" in s else 0
        part = (s, ws, link, len(_END.findall(s)), led, tag)
        (short if 0 < len(ws) < JUDGED and not part[3] and 2 * (link + tag) < len(s) else parts).append(part)
    if short:
        join = "\n".join
        parts.append((join(p[0] for p in short), [w for p in short for w in p[1]], sum(p[2] for p in short), 0, False, sum(p[5] for p in short)))
    listed = function_words.__contains__
    for w in [*filter(listed, counts)]:
        del counts[w]
    least = max(FREQUENT, FREQUENT_SHARE * counts.total())
    frequent = {w for w, n in counts.items() if n >= least and len(w) > 1}.__contains__
    bare = [p for p in parts if p[3] < SENTENCES * len(p[1]) or not p[1]]
    grams = Counter(g for p in bare for g in zip(p[1], p[1][1:]))
    lines = Counter(x for p in bare for x in _line_keys(p[0]))
    out = []
    for k, (s, ws, link, ends, led, tag) in enumerate(parts):
        n, size = len(ws), len(s)
        function = sum(map(listed, ws))
        own = n - function
        gram = dup = offer = 0.0
        varied = 1.0
        if not n or ends < SENTENCES * n:
            pairs = list(zip(ws, ws[1:]))
            keys = _line_keys(s)
            gram = sum(grams[g] >= FREQUENT for g in pairs) / max(1, len(pairs))
            dup = sum(lines[x] > 2 for x in keys) / max(1, len(keys))
            offer = len(_PRICE.findall(s)) / max(1, n)
            varied = len(set(ws)) / max(1, n)
        sep = sum(map(s.count, "|#,–;")) / max(1, n)
        out.append((float(k), float(size), float(n), sum(map(frequent, ws)) / max(1, own), gram, dup, link / size, tag / size, sep, function / max(1, n), ends / max(1, n), offer, varied, float(led)))
    return out


def segment_measures(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, collected_at, lang, measures): one row per segment of every text.

    ``common_words`` is the fixed list of function words; its distinct words are read to the
    driver, at most ``MAX_FUNCTION_WORDS``.
    """
    listed = [r[0] for r in common_words.select(F.lower("word")).where("word is not null").distinct().limit(MAX_FUNCTION_WORDS + 1).collect()]
    if len(listed) > MAX_FUNCTION_WORDS:
        raise ValueError("the list of function words is too long")
    function_words = {p for w in listed for p in (w, *re.split("[’']", w)) if p}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(doc, at, lang, *m) for doc, at, lang, text in zip(pdf["doc_id"], pdf["collected_at"], pdf["lang"], pdf["text"], strict=True) if text for m in measure(text, function_words)]
            yield pd.DataFrame(rows, columns=["doc_id", "collected_at", "lang", *_FIELDS])

    return documents.select("doc_id", "collected_at", "lang", "text").where("text is not null and doc_id is not null").mapInPandas(run, _SCHEMA)


MAX_FUNCTION_WORDS = 20_000

#: How many segments of all languages a language's own figures are mixed with.
PRIOR = 200.0
#: Parts of the way from the typical share to 1 at which the limits lie.
TOP, GRAM, DUP, LINK, TAG, VARIED = 0.5, 0.3, 0.5, 0.4, 0.4, 0.5
#: Share of top words over which a segment repeats itself in any language, so that repetitive sentences raise no limit beyond it.
TOP_MOST = 0.6
#: Separators a word over the upper quartile of sentences.
SEPARATORS = 0.1
_TYPICAL = {"top": (True, 0.5), "link": (True, 0.5), "tag": (True, 0.5), "sep": (True, 0.75), "function": (True, 0.75), "gram": (False, 0.5), "dup": (False, 0.5), "varied": (False, 0.5)}
_LIMITS = {
    "top": lambda v: v + TOP * (1 - v), "link": lambda v: v + LINK * (1 - v), "tag": lambda v: v + TAG * (1 - v), "sep": lambda v: v + SEPARATORS, "function": lambda v: v,
    "gram": lambda v: v + GRAM * (1 - v), "dup": lambda v: v + DUP * (1 - v), "varied": lambda v: v * VARIED,
}
#: Typical shares where a corpus has no such segments at all.
_NONE = {"top": 0.0, "link": 0.0, "tag": 0.0, "sep": 0.0, "function": 0.4, "gram": 0.0, "dup": 0.0, "varied": 1.0}
_SALT = 64


def _typical(measures: DataFrame, *keys: str) -> DataFrame:
    """Counts of segments with and without sentences, and the typical shares over them."""
    sentence = F.col("ends") >= SENTENCES
    of = lambda with_: F.when(sentence if with_ else ~sentence, F.lit(True))
    stats = [F.count(of(True)).alias("n_with"), F.count(of(False)).alias("n_without")]
    stats += [F.percentile_approx(F.when(of(with_), F.col(c)), q, 1000).alias(c) for c, (with_, q) in _TYPICAL.items()]
    return measures.where(F.col("words") >= JUDGED).groupBy(*keys).agg(*stats)


def language_limits(measures: DataFrame, prior: float = PRIOR) -> tuple[DataFrame, dict[str, float]]:
    """((lang, limits), limits of all languages)."""
    row = _typical(measures).first()
    common = {c: _NONE[c] if row[c] is None else row[c] for c in _TYPICAL}

    def own(c: str):
        n = F.col("n_with" if _TYPICAL[c][0] else "n_without")
        mixed = (n * F.coalesce(F.col(c), F.lit(common[c])) + F.lit(prior * common[c])) / (n + F.lit(prior))
        limit = _LIMITS[c](mixed)
        return (F.least(limit, F.lit(TOP_MOST)) if c == "top" else limit).alias(f"{c}_limit")

    limits = _typical(measures.where("lang is not null"), "lang").select("lang", *map(own, _TYPICAL))
    fixed = {c: _LIMITS[c](v) for c, v in common.items()}
    return limits, fixed | {"top": min(fixed["top"], TOP_MOST)}


def spam_shares(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, spam_share, link_share, tag_share, stuffed_share): shares of the text's characters."""
    measures = written(segment_measures(documents, common_words), "segments")
    limits, common = language_limits(measures)
    limits = written(limits, "limits")
    key = F.coalesce("lang", F.concat(F.lit("\0"), F.pmod(F.xxhash64("doc_id"), F.lit(_SALT)).cast("string")))
    joined = measures.withColumn("_lang", key).join(limits.withColumnRenamed("lang", "_lang"), "_lang", "left")
    limit = lambda c: F.coalesce(f"{c}_limit", F.lit(common[c]))
    over = lambda c: F.col(c) >= limit(c)
    repeated = over("top") & ((F.col("varied") < limit("varied")) | over("gram") | over("dup") | over("sep") | (F.col("offer") > 0))
    stuffed = (F.col("ends") < SENTENCES) & (F.col("words") >= JUDGED) & (F.col("function") < limit("function")) & repeated
    link, tag = over("link"), over("tag")
    share = lambda c: F.sum(F.when(c, F.col("chars")).otherwise(0.0)) / F.sum("chars")
    sentences, referred = share(F.col("ends") >= SENTENCES), share(link & (F.col("led") > 0))
    # The same delivery twice adds the same segments twice, so its shares stay the same.
    shares = joined.groupBy("doc_id", "collected_at").agg((share(link | tag | stuffed) - F.when(sentences >= REFERRING, referred).otherwise(0.0)).alias("spam_share"), share(link).alias("link_share"), share(tag).alias("tag_share"), share(stuffed & ~link & ~tag).alias("stuffed_share"))
    return of_newest(shares, documents, ["doc_id"], "collected_at")


def spam_documents(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id) of documents most of whose characters are stuffed keywords, links, tags or offers."""
    return spam_shares(documents, common_words).where("spam_share > 0.5").select("doc_id")
