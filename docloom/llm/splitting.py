"""Oversized texts cut at natural boundaries with overlap (problem 7).

Recursive bisection: a text over the limit is cut at the strongest boundary near its middle,
and halves that still exceed the limit minus the overlap are cut again; afterwards every piece
but the first gets up to ``overlap`` characters of the piece before it. Boundary strengths, from
the strongest: page marker or heading start, blank line, line end, sentence end, other
punctuation, white space, between letters. Pieces without their overlaps join to the text.

Only oversized texts reach Python (Arrow batches, no shuffle); all others pass as one piece in
the JVM. A piece is never over the limit, whatever the text. Characters are code points, and a
cut never separates a combining mark or a carriage return from its line feed, unless a single run of
such marks is longer than a piece may be.

Defined results: a null text and a row without its first key give no piece, an empty one gives one empty piece; texts of
exactly the limit are not cut; duplicates count once, the newest rendering stands.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import latest, of_newest

LIMIT, OVERLAP = 4000, 200

#: Boundaries by strength; each pattern matches the end of the left piece.
_BOUNDARIES = [
    re.compile(r"\n+(?=(?:<!-- page|#{1,6} ))"),
    re.compile(r"\n(?:[ \t]*\r?\n)+"),
    re.compile(r"\n"),
    re.compile(r"[.!?…][\"”’»)\]]*\s+"),
    re.compile(r"[,;:–—|]\s+"),
    re.compile(r"\s+"),
]


def _joined(text: str, at: int) -> bool:
    """Whether a cut before position ``at`` would part what belongs together."""
    return unicodedata.combining(text[at]) > 0 or text[at] in "‍️" or (text[at] == "\n" and text[at - 1] == "\r")


def _cut(text: str, lo: int, hi: int) -> int:
    """The cut position in text[lo:hi]: the strongest boundary near the middle, nearest first."""
    mid, size = (lo + hi) // 2, hi - lo
    reach = max(1, size // 4)
    left, right = max(lo + 1, mid - reach), min(hi - 1, mid + reach)
    for pattern in _BOUNDARIES:
        best = None
        for m in pattern.finditer(text, max(lo, left - 8), hi):
            at = m.end()
            if at > right:
                break
            if at >= left and (best is None or abs(at - mid) < abs(best - mid)) and not _joined(text, at):
                best = at
        if best is not None:
            return best
    for away in range(hi - lo):
        for at in (mid - away, mid + away):
            if lo < at < hi and not _joined(text, at):
                return at
    return mid  # one cluster from end to end


def split_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(from, own, to) of each piece: text[from:to] with text[from:own] repeated from the piece before."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    most, spans, todo = limit - overlap, [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= most:
            spans.append((lo, hi))
        else:
            at = _cut(text, lo, hi)
            todo += [(at, hi), (lo, at)]
    out = []
    for k, (lo, hi) in enumerate(spans):
        back = max(spans[k - 1][0], lo - overlap) if k else lo
        if k and back > spans[k - 1][0]:  # the overlap starts at a word where there is one
            m = re.compile(r"\s").search(text, back - 1, lo)
            back = m.end() if m and m.end() < lo else back
        out.append((back, lo, hi))
    return out


def split_texts(items: DataFrame, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """keys + (piece_idx, n_pieces, char_start, own_start, char_end, piece) for a column ``text``."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half of limit")
    items = items.select(*keys, "text").where("text is not null").dropna(subset=[keys[0]])
    fields = [f for f in items.schema.fields if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", piece_idx int, n_pieces int, char_start int, own_start int, char_end int, piece string"
    names = [f.name for f in fields]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *key, text in pdf[[*names, "text"]].itertuples(index=False, name=None):
                spans = split_spans(text, limit, overlap)
                rows += [(*key, k, len(spans), a, b, c, text[a:c]) for k, (a, b, c) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=[*names, "piece_idx", "n_pieces", "char_start", "own_start", "char_end", "piece"])

    size = F.length("text")
    whole = items.where(size <= limit).select(*names, *[F.lit(v).cast("int").alias(n) for n, v in (("piece_idx", 0), ("n_pieces", 1), ("char_start", 0), ("own_start", 0))], size.alias("char_end"), F.col("text").alias("piece"))
    return whole.unionByName(items.where(size > limit).mapInPandas(pieces, schema))


def rendered_items(rows: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, *carried, section_idx, text): the whole markdown at -1 and each section's content."""
    contents = F.transform(F.col("sections"), lambda s, i: F.struct(i.cast("bigint").alias("section_idx"), s["content"].alias("text")))
    whole = F.array(F.struct(F.lit(-1).cast("bigint").alias("section_idx"), F.col("markdown").alias("text")))
    return rows.select("doc_id", *carried, F.inline(F.when(F.col("sections").isNull(), whole).otherwise(F.concat(whole, contents))))


def rendered_pieces(rendered: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every markdown and section content of the newest renderings."""
    one = latest(rendered, ["doc_id"], "rendered_at", "markdown", "sections")
    return split_texts(rendered_items(one), ["doc_id", "section_idx"], limit, overlap)


def oversized(rendered: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, section_idx) of the items that had to be cut.

    Every delivery is split where it lies; only the keys of cut items are shuffled.
    """
    pieces = split_texts(rendered_items(rendered, "rendered_at"), ["doc_id", "rendered_at", "section_idx"], limit, overlap)
    cut = pieces.where("n_pieces > 1 and piece_idx = 0").select("doc_id", "rendered_at", "section_idx")
    return of_newest(cut, rendered, ["doc_id"], "rendered_at")
