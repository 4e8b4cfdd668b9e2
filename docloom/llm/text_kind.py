"""Per-document text statistics that tell prose from lists, tables and junk (problem 2).

Markdown bodies (headings and page markers aside) are cut into paragraphs. Thresholds on the
statistics of a paragraph are noisy labelling functions: each votes for one kind or abstains. Their
accuracies are learned by expectation-maximization on the agreements of all paragraphs, without any
labels, and each paragraph gets posterior kinds. A document's kind shares are its characters
weighted with the posteriors; it is found when more than half of them are not prose.

Scale: texts are measured once where they lie; a paragraph leaves as some numbers and a vote
pattern. EM needs only how often each pattern occurs: at most 2 to the number of labelling
functions rows, whatever the corpus, counted with map-side combining. The learned table goes back by
broadcast under the same bound. Measures are written to the shared folder because learning and
decision both read them.

Defined results: null markdown is no case, a row without doc_id gives none; a body that is empty besides headings and markers is no
case; the newest rendering of a document stands; equal shares go to list, then table, then junk.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import of_newest, written

#: Kinds of paragraphs; formulas and code are neither prose nor against it.
KINDS = ("prose", "quoted", "list", "table", "junk")
#: Most words a list of function words may have: the bound of what reaches the driver.
MAX_FUNCTION_WORDS = 20_000

_WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_HEADING = re.compile(r"\s{0,3}#{1,6}\s|\s*<!--.*-->\s*$")
_MARK = re.compile(r"\s*(?:[-*+•·▪▸►–◦○●■□]|\d{1,4}(?:\.\d{1,3})*[.)]|\(?[a-z]{1,2}\)|\(?[ivxlc]{1,6}\)|\(\d{1,4}\)|\[\d{1,4}\])\s+\S", re.IGNORECASE)
_LEADER = re.compile(r".*?(?:\.{4,}|(?:\s\.){3,}|…{2,}|_{4,})\s*\d{1,4}\s*$")
_LABEL = re.compile(r"\s*(?:[-*•]\s*)?[^\W\d_][^:|;\t]{0,40}:\s+\S.{0,60}$")
_CELL = re.compile(r"\s*\|\s*|\t|;| {2,}|(?<=\w),(?=\w*[^\W\d_])")
_TIGHT = re.compile(r"\w,\w*[^\W\d_]")
_NUMBERS = re.compile(r"(?<=\S\s)\s*(?:[-+−–]?\d[\d.,]*%?|n/a|–|-|—|/)(?!\S)")
_END = re.compile(r"[\w²³%°)][\"”’»)\]]*[.!?…](?=[\s\"”’»)\]]|$)")
_CODE = re.compile(r"\s*(?:(?:let|var|const|def|return|for|while|if|import|from|class|int|float|double|void|print|echo|set)\b.*[;:={(\)].*|.*[;{}]\s*|\w[\w.]*\(.*\)\s*|[\w.\[\]]+\s*[-+*/:]?=\s*\S.*|```.*|~~~.*)$")
_MATH = re.compile(r"\s*\${1,2}|.*\$\$\s*$|\s*\\\[")
_DUMP = re.compile(r"\(cid:\d+\)|(?<![\w-])(?:[0-9a-f]{2} ){6,}|[A-Za-z0-9+/]{40,}={0,2}|(?:\\x[0-9a-f]{2}){3,}|(?:\\u[0-9a-f]{4}){3,}|&#\d+;(?:&#\d+;)+", re.IGNORECASE)
_GLYPHS = re.compile(r"[^\w\s]|_")
_LEAD = re.compile(r"(?m)^\s*\(?\w{1,4}(?:\.\d{1,3})*[.)]\s")
_MIXED = re.compile(r"[^\W_][#%&@§*~^<>|=$+!?\\][^\W_]")

_COUNTS = ("chars", "lines", "words", "word_chars", "symbols", "common", "ends", "end_lines", "marks", "labels", "leaders", "rows", "numbers", "dump_chars", "distinct", "mixed", "code")
_FIELDS = ["seg", *_COUNTS, "votes"]
_SCHEMA = "doc_id bigint, rendered_at timestamp, " + ", ".join(f"{f} bigint" for f in _FIELDS)


def paragraphs(markdown: str) -> list[str]:
    """Body paragraphs: headings and page markers dropped, fenced code kept whole."""
    out, open_, fence = [], [], False
    for line in markdown.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        fence ^= line.lstrip().startswith(("```", "~~~"))
        if not fence and (not line.strip() or _HEADING.match(line)):
            if open_:
                out.append("\n".join(open_))
            open_ = []
        elif line.strip():
            open_.append(line)
    return [*out, "\n".join(open_)] if open_ else out


def _row(line: str, mark: bool) -> tuple[bool, int]:
    """(whether a line reads as a table row, how many tokens after its first are numbers)."""
    digits = any(c.isdigit() for c in line)
    numbers = len(_NUMBERS.findall(line)) if digits or "–" in line or "n/a" in line or "—" in line else 0
    if "|" in line or ";" in line or "\t" in line or "  " in line or _TIGHT.search(line):
        cells = _CELL.split(line.strip().strip("|"))
        if len(cells) >= 3 and sum(map(len, cells)) / len(cells) < 40 and not (mark and len(cells) < 4) and not _END.search(line):
            return True, numbers
    return numbers >= 2 and not mark and numbers >= 0.6 * (len(line.split()) - 1), numbers


def _quoted(line: str) -> bool:
    """Whether a line reads as code or a formula."""
    if "=" in line or line.rstrip()[-1:] in ";{})]:`~" or line.lstrip()[:1] in "`~$\\" or "$$" in line:
        return _CODE.match(line) is not None or _MATH.match(line) is not None
    return False


def _dumped(part: str) -> int:
    """Characters in dumps: glyph numbers, hexadecimal bytes, encoded data, escapes."""
    tokens = part.split()
    bytes_ = sum(len(t) == 2 for t in tokens)
    if "(cid:" in part or "\\" in part or "&#" in part or bytes_ >= 6 and bytes_ * 2 > len(tokens) or max(map(len, tokens), default=0) >= 40:
        return sum(map(len, _DUMP.findall(part)))
    return 0


def statistics(part: str, function_words: set[str]) -> dict[str, int]:
    """The counts of one paragraph."""
    lines = [x for x in part.split("\n") if x.strip()]
    words = _WORD.findall(part.casefold())
    marks = [_MARK.match(x) is not None for x in lines]
    rows = [_row(x, m) for x, m in zip(lines, marks, strict=True)]
    return {
        "chars": len(part), "lines": len(lines), "words": len(words), "word_chars": sum(map(len, words)), "symbols": len(_GLYPHS.findall(part)),
        "common": sum(map(function_words.__contains__, words)), "ends": len(_END.findall(_LEAD.sub("", part))), "end_lines": sum(x.rstrip().endswith((".", "!", "?", "…", ".”", ".’", ".»", ".)")) for x in lines),
        "marks": sum(marks), "labels": sum(":" in x and _LABEL.match(x) is not None for x in lines), "leaders": sum(x.rstrip()[-1:].isdigit() and _LEADER.match(x) is not None for x in lines),
        "rows": sum(r for r, _ in rows), "numbers": sum(n for _, n in rows), "dump_chars": _dumped(part), "distinct": len(set(words)), "mixed": len(_MIXED.findall(part)),
        "code": sum(map(_quoted, lines)),
    }


#: The labelling functions: name, kind voted for, condition on the counts of a paragraph.
LABELLERS = [
    ("sentences", "prose", lambda s: s["words"] >= 4 and s["ends"] >= 0.025 * s["words"] and s["mixed"] <= 0.05 * s["words"] and s["symbols"] < 0.25 * s["chars"]),
    ("function_words", "prose", lambda s: s["words"] >= 4 and s["common"] >= 0.15 * s["words"] and s["leaders"] + s["marks"] + s["rows"] < 0.6 * s["lines"]),
    ("long_lines", "prose", lambda s: s["words"] >= 14 * s["lines"] and s["common"] >= 0.08 * s["words"]),
    ("quoted_matter", "quoted", lambda s: s["code"] >= 0.6 * s["lines"] and s["symbols"] < 0.65 * s["chars"] and s["marks"] < 0.5 * s["lines"]),
    ("markers", "list", lambda s: s["marks"] >= 0.6 * s["lines"] and s["words"] <= 14 * s["lines"] and s["symbols"] < 0.25 * s["chars"]),
    ("labels", "list", lambda s: s["labels"] >= 0.6 * s["lines"] and s["words"] <= 12 * s["lines"] and s["symbols"] < 0.25 * s["chars"]),
    ("leaders", "list", lambda s: s["leaders"] >= 0.6 * s["lines"]),
    ("short_entries", "list", lambda s: s["lines"] >= 3 and 0 < s["words"] <= 5 * s["lines"] and s["end_lines"] <= 0.2 * s["lines"] and s["numbers"] <= s["lines"] and s["distinct"] >= 0.25 * s["words"] and s["rows"] < 0.5 * s["lines"] and s["code"] < 0.6 * s["lines"] and s["symbols"] < 0.25 * s["chars"]),
    ("cells", "table", lambda s: s["lines"] >= 2 and s["rows"] >= 0.6 * s["lines"] and s["symbols"] < 0.45 * s["chars"] and not s["dump_chars"]),
    ("figures", "table", lambda s: s["lines"] >= 2 and s["numbers"] >= 1.5 * s["lines"] and not s["dump_chars"] and s["rows"] >= 0.3 * s["lines"]),
    ("symbols", "junk", lambda s: s["symbols"] >= 0.3 * s["chars"] and s["rows"] < 0.6 * s["lines"] and s["code"] < 0.6 * s["lines"] and s["leaders"] < 0.6 * s["lines"]),
    ("dumps", "junk", lambda s: s["dump_chars"] >= 0.4 * s["chars"]),
    ("repetition", "junk", lambda s: s["words"] >= 16 and s["distinct"] <= 0.2 * s["words"] and s["ends"] < 0.02 * s["words"] and s["common"] < 0.3 * s["words"]),
    ("no_function_words", "junk", lambda s: s["words"] >= 12 and s["common"] <= 0.04 * s["words"] and s["words"] >= 6 * s["lines"] and s["marks"] + s["labels"] + s["rows"] + s["leaders"] < 0.3 * s["lines"] and s["code"] < 0.6 * s["lines"] and s["ends"] < 0.025 * s["words"]),
    ("mixed_words", "junk", lambda s: s["mixed"] >= 3 and s["mixed"] >= 0.05 * s["words"] and s["code"] < 0.6 * s["lines"]),
    ("letter_soup", "junk", lambda s: s["words"] >= 10 and s["word_chars"] <= 1.6 * s["words"] and s["common"] < 0.5 * s["words"]),
]


def votes(stats: dict[str, int]) -> int:
    """The vote pattern: bit k is set when labelling function k votes."""
    return sum(1 << k for k, (_, _, test) in enumerate(LABELLERS) if test(stats))


def paragraph_statistics(rendered: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, rendered_at, counts, votes): one row per body paragraph of every delivered markdown."""
    listed = [r[0] for r in common_words.select(F.lower("word")).where("word is not null").distinct().limit(MAX_FUNCTION_WORDS + 1).collect()]
    if len(listed) > MAX_FUNCTION_WORDS:
        raise ValueError("the list of function words is too long")
    function_words = {p for w in listed for p in (w, *re.split("[’']", w)) if len(p) > 1}  # single letters tell nothing

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, at, text in zip(pdf["doc_id"], pdf["rendered_at"], pdf["markdown"], strict=True):
                for k, part in enumerate(paragraphs(text)):
                    s = statistics(part, function_words)
                    rows.append((doc, at, k, *[s[c] for c in _COUNTS], votes(s)))
            yield pd.DataFrame(rows, columns=["doc_id", "rendered_at", *_FIELDS])

    return rendered.select("doc_id", "rendered_at", "markdown").where("markdown is not null and doc_id is not null").mapInPandas(run, _SCHEMA)


def learn(patterns: list[tuple[int, int]], rounds: int = 60) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """Posterior kinds by vote pattern, and per labelling function its rates of voting right and wrong.

    Expectation-maximization from (pattern, count): given the kind, labelling functions vote
    independently, right with one rate and wrong with another.
    """
    if not patterns:
        return {}, np.zeros(len(LABELLERS)), np.zeros(len(LABELLERS))
    ids = [p for p, _ in sorted(patterns)]
    n = np.array([c for _, c in sorted(patterns)], float)
    fired = np.array([[p >> k & 1 for k in range(len(LABELLERS))] for p in ids], float)
    own = np.array([[kind == k for k in KINDS] for _, kind, _ in LABELLERS], float)
    prior = np.array([0.6, 0.1, 0.1, 0.1, 0.1])
    right, wrong = np.full(len(LABELLERS), 0.6), np.full(len(LABELLERS), 0.03)
    for _ in range(rounds):
        rate = own * right[:, None] + (1 - own) * wrong[:, None]
        log = fired @ np.log(rate) + (1 - fired) @ np.log(1 - rate) + np.log(prior)
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post * n[:, None]
        # Pseudo-counts keep rates off 0 and 1; right votes stay likelier than wrong ones.
        right = ((fired.T @ mass * own).sum(1) + 1.0) / ((mass.sum(0) * own).sum(1) + 2)
        wrong = ((fired.T @ mass * (1 - own)).sum(1) + 0.04) / ((mass.sum(0) * (1 - own)).sum(1) + 2)
        right = np.minimum(right, 0.9)  # no missing vote rules a kind out
        wrong = np.clip(wrong, 0.002, 0.8 * right)
        prior = (mass.sum(0) + 1) / (mass.sum() + len(KINDS))
    return dict(zip(ids, post, strict=True)), right, wrong


def kind_shares(rendered: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, rendered_at, sums of the counts, shares by kind): one row per delivered markdown with a body."""
    measured = written(paragraph_statistics(rendered, common_words), "paragraphs")
    patterns = [(r[0], r[1]) for r in measured.groupBy("votes").count().collect()]  # at most 2 ** len(LABELLERS) rows
    posterior, _, _ = learn(patterns)
    rows = [(p, *map(float, v)) for p, v in posterior.items()]
    table = rendered.sparkSession.createDataFrame(rows, "votes bigint, " + ", ".join(f"p_{k} double" for k in KINDS))
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    shares = [(F.sum(F.col("chars") * F.col(f"p_{k}")) / F.sum("chars")).alias(f"{k}_share") for k in KINDS]
    # The same delivery twice adds every paragraph twice: sums double, shares stay; seg tells the copies.
    once = measured.dropDuplicates(["doc_id", "rendered_at", "seg"])
    return once.join(F.broadcast(table), "votes").groupBy("doc_id", "rendered_at").agg(*sums, *shares)


def text_kinds(rendered: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, text_kind) of documents whose body is by most of its characters not prose."""
    shares = kind_shares(rendered, common_words)
    best = F.greatest("list_share", "table_share", "junk_share")
    kind = F.when(F.col("list_share") == best, "list").when(F.col("table_share") == best, "table").otherwise("junk")
    found = shares.where("list_share + table_share + junk_share > 0.5").select("doc_id", "rendered_at", kind.alias("text_kind"))
    return of_newest(found, rendered, ["doc_id"], "rendered_at")


def document_statistics(rendered: DataFrame, common_words: DataFrame, reports: DataFrame) -> DataFrame:
    """Per document: word count, mean word length, symbol ratio, punctuated lines, common words, kinds, low-density pages."""
    s = of_newest(kind_shares(rendered, common_words), rendered, ["doc_id"], "rendered_at")
    pages = reports.groupBy("doc_id").agg(F.max("low_density_pages").alias("low_density_pages"), F.max("page_count").alias("page_count"))
    ratio = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    return s.join(pages, "doc_id", "left").select(
        "doc_id", "chars", "lines", "words", ratio("word_chars", "words").alias("mean_word_length"), ratio("symbols", "chars").alias("symbol_ratio"),
        ratio("end_lines", "lines").alias("punctuated_lines"), ratio("common", "words").alias("common_words"), *[f"{k}_share" for k in KINDS],
        "low_density_pages", (F.col("low_density_pages") * 2 > F.col("page_count")).alias("mostly_low_density"),
    )
