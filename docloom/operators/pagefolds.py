"""Page-local algorithms whose result depends on order or recursion, page by page.

A page holds at most some thousand words, so a group is bounded; pages are the unit of
parallelism. Each function sorts by a total order first and so doesn't depend on arrival order or
partitioning. Pure functions over plain boxes come first, the DataFrame operators after them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from operator import attrgetter
from statistics import fmean, median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.predicates import HEADER_WORDS, STOPWORDS, is_no_table_block
from docloom.functions.text import LATEX
from docloom.operators.policy import SOURCE_BONUS

PAGE = ["doc_id", "page_num"]
#: Page size where a report has none.
WIDTH, HEIGHT = 612.0, 792.0
Box = tuple[float, float, float, float]

# --- boxes -----------------------------------------------------------------------------------


def union(boxes: list[Box]) -> Box:
    """The smallest box around boxes."""
    x0, y0, x1, y1 = zip(*boxes, strict=True)
    return min(x0), min(y0), max(x1), max(y1)


def shared(a: Box, b: Box) -> float:
    """Area that two boxes share."""
    return max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)


def size(b: Box) -> float:
    return (b[2] - b[0]) * (b[3] - b[1])


def smaller_share(a: Box, b: Box) -> float:
    """Shared area over the smaller box."""
    return shared(a, b) / max(min(size(a), size(b)), 1.0)


def apart(a0: float, a1: float, b0: float, b1: float) -> float:
    """Distance of two intervals, 0 where they meet."""
    return max(b0 - a1, a0 - b1, 0.0)


# --- reading order ---------------------------------------------------------------------------


def _widest(intervals: list[tuple[float, float]], least: float) -> tuple[float, float] | None:
    """(gap, middle) of the first widest gap between intervals, if it is at least ``least``."""
    best, reach = None, None
    for lo, hi in sorted(intervals):
        if reach is not None and lo - reach > 2.0 and lo - reach >= least and (best is None or lo - reach > best[0]):
            best = (lo - reach, (lo + reach) / 2)
        reach = hi if reach is None else max(reach, hi)
    return best


def reading_order(boxes: list[Box], row_gap: float = 8.0, column_gap: float = 12.0, depth: int = 50, narrow: float = 0.1) -> list[int]:
    """Order of boxes by recursive cuts at the widest white space; columns win ties, leaves go by (y, x)."""
    order: list[int] = []
    todo: list[tuple[list[int], int]] = [(list(range(len(boxes))), 0)]
    while todo:
        items, level = todo.pop()
        cut = None
        if len(items) > 1 and level < depth:
            rows = _widest([(boxes[i][1], boxes[i][3]) for i in items], row_gap)
            columns = _widest([(boxes[i][0], boxes[i][2]) for i in items], column_gap)
            if rows is None and columns is None:
                region = union([boxes[i] for i in items])
                wide = [i for i in items if boxes[i][2] - boxes[i][0] >= narrow * (region[2] - region[0])]
                if 1 < len(wide) < len(items):
                    columns = _widest([(boxes[i][0], boxes[i][2]) for i in wide], column_gap)
            if columns and (rows is None or columns[0] >= rows[0]):
                cut = (columns[1], 0)
            elif rows:
                cut = (rows[1], 1)
        if cut:
            at, axis = cut
            first = [i for i in items if (boxes[i][axis] + boxes[i][axis + 2]) / 2 < at]
            second = [i for i in items if (boxes[i][axis] + boxes[i][axis + 2]) / 2 >= at]
            if first and second:
                todo += [(second, level + 1), (first, level + 1)]
                continue
        order += sorted(items, key=lambda i: (boxes[i][1], boxes[i][0], i))
    return order


# --- grouping --------------------------------------------------------------------------------


def lines_by_last(words: list, base: Callable, tolerance: Callable) -> list[list]:
    """Words sorted by baseline; each joins the last group while within its tolerance of the group's mean."""
    groups: list[list] = []
    for w in words:
        if groups and abs(fmean(base(x) for x in groups[-1]) - base(w)) <= tolerance(w):
            groups[-1].append(w)
        else:
            groups.append([w])
    return groups


def lines_by_first(words: list, base: Callable, tolerance: Callable) -> list[list]:
    """Like ``lines_by_last``, but each word joins the first group within tolerance."""
    groups: list[list] = []
    for w in words:
        home = next((g for g in groups if abs(fmean(base(x) for x in g) - base(w)) <= tolerance(w)), None)
        if home is None:
            groups.append([w])
        else:
            home.append(w)
    return sorted(groups, key=lambda g: fmean(base(x) for x in g))


def clusters(values: list[float], tolerance: float) -> list[float]:
    """Centres of sorted values; a value further than the tolerance from the running mean starts anew."""
    groups: list[list[float]] = []
    for v in sorted(values):
        if groups and v - groups[-1][-1] < 0.1:
            continue
        if groups and abs(v - fmean(groups[-1])) <= tolerance:
            groups[-1].append(v)
        else:
            groups.append([v])
    return [fmean(g) for g in groups]


# --- suppression -----------------------------------------------------------------------------


def keep_first(boxes: list[Box], share: float) -> list[int]:
    """Indices kept when each box is dropped that overlaps a kept one by more than a share."""
    kept: list[int] = []
    for i, b in enumerate(boxes):
        if all(smaller_share(boxes[k], b) <= share for k in kept):
            kept.append(i)
    return kept


def keep_better(boxes: list[Box], rank: list[float], share: float = 0.65) -> list[int]:
    """Indices kept when a box replaces the first kept one it overlaps if it ranks higher or is as high and smaller."""
    kept: list[int] = []
    for i, b in enumerate(boxes):
        slot = next((k for k, j in enumerate(kept) if smaller_share(b, boxes[j]) > share), None)
        if slot is None:
            kept.append(i)
        elif (rank[i], -size(b)) > (rank[kept[slot]], -size(boxes[kept[slot]])):
            kept[slot] = i
    return sorted(kept, key=lambda i: (boxes[i][1], boxes[i][0]))


# --- tables ----------------------------------------------------------------------------------

_EDGE = ",;:†‡*"
#: Bonus of table evidence up to so many rows.
ROW_BONUS = ((3, 0.0), (6, 0.04), (9, 0.08), (10**9, 0.12))


def is_value(text: str) -> bool:
    """A table value, the same test as the Column predicate."""
    t = text.strip(_EDGE)
    digits = sum(c.isdigit() and c.isascii() for c in t)
    return t in ("-", "–", "—") or (digits > 0 and re.fullmatch(r"[0-9A-Za-z.,/\-–—\"'+±]+", t) is not None and digits * 2 >= len(t))


def is_data(texts: list[str]) -> bool:
    values = sum(map(is_value, texts))
    stock = any(sum(c.isdigit() for c in t) >= 6 for t in texts)
    return len(texts) >= 4 and (values * 100 // len(texts) >= 55 or (stock and values >= 4))


def is_prose(texts: list[str]) -> bool:
    return len(texts) >= 6 and any(t.lower() in STOPWORDS for t in texts) and not any(map(is_value, texts))


class Row:
    """Words on one baseline, left to right."""

    def __init__(self, words: list):
        self.words = sorted(words, key=lambda w: (w.x0, w.block_id, w.widx))
        self.texts = [w.text for w in self.words]
        self.base = fmean(w.base for w in words)
        sizes = sorted(w.font_size for w in words)
        self.font = max(sizes[len(sizes) // 2], 1.0)
        self.box = union([(w.x0, w.y0, w.x1, w.y1) for w in words])


def word_rows(words: list) -> list[Row]:
    ordered = sorted(words, key=lambda w: (w.base, w.x0, w.block_id, w.widx))
    return [Row(g) for g in lines_by_first(ordered, lambda w: w.base, lambda w: max(w.font_size * 0.55, 3.0))]


def _runs(rows: list[Row], starts: Callable, goes_on: Callable, spread: float) -> list[tuple[int, int]]:
    """(start, end) of runs of rows: from a start row while rows go on and aren't too far apart."""
    out, i = [], 0
    while i < len(rows):
        if not starts(rows[i]):
            i += 1
            continue
        j = i + 1
        while j < len(rows) and goes_on(rows[j]) and rows[j].base - rows[j - 1].base <= rows[j].font * spread:
            j += 1
        out.append((i, j))
        i = j
    return out


def evidence_score(source: str, rows: int, consistency: float, alignment: float, numbers: float, caption: float = 0.0, prose: float = 0.0) -> float:
    """How sure a table is, 0 to 1: weighted evidence, bonuses by source and rows, less the penalty for prose rows."""
    extra = next(bonus for most, bonus in ROW_BONUS if rows <= most)
    return min(max(0.32 * consistency + 0.24 * alignment + 0.24 * numbers + 0.05 * caption + SOURCE_BONUS[source] + extra - prose, 0.0), 1.0)


def _modal_width(rows: list[Row]) -> tuple[int, int]:
    """(words, rows): the most frequent number of words in a row, the larger of equals."""
    return max(Counter(len(r.words) for r in rows).items(), key=lambda kv: (kv[1], kv[0]))


def _numbers(rows: list[Row]) -> float:
    texts = [t for r in rows for t in r.texts]
    return sum(map(is_value, texts)) / max(len(texts), 1)


def _reach(rows: list[Row], width: float) -> float:
    """The widest row as a share of the page, 1 at most."""
    return min(max(r.box[2] - r.box[0] for r in rows) / max(width, 1.0), 1.0)


def _found(rows: list[Row], cells: list[list[str]], source: str, confidence: float, prose: float, markdown: bool) -> dict:
    ids = sorted({w.block_id for r in rows for w in r.words})
    return {"box": union([r.box for r in rows]), "rows": cells, "confidence": confidence, "render": "Markdown" if markdown else "Layout", "source": source, "ids": ids, "layout": layout_text(rows), "prose": prose}


def _table(rows: list[Row], first: int, width: float, source: str) -> dict | None:
    """A table from rows of which those before ``first`` are its header; None where it is none."""
    data = rows[first:]
    columns, hits = _modal_width(data)
    prose = sum(is_prose(r.texts) for r in data)
    if columns < 3 or hits < 3 or (len(data) >= 8 and prose * 10 >= len(data) * 3):
        return None
    modal = [r for r in data if len(r.words) == columns]
    centres = _centres(modal, columns)
    nearest = lambda w: min(range(columns), key=lambda k: abs((w.x0 + w.x1) / 2 - centres[k]))

    def cells(row: Row) -> list[str]:
        if len(row.words) == columns:
            return row.texts
        out: list[list[str]] = [[] for _ in centres]
        for w in row.words:
            out[nearest(w)].append(w.text)
        return [" ".join(c) for c in out]

    heads: list[list[str]] = [[] for _ in centres]
    for r in rows[:first]:
        for w in r.words:
            token, home = w.text.strip().strip("|"), heads[nearest(w)]
            if token and token not in home:
                home.append(token)
    header = [" ".join(h) or f"Column {k + 1}" for k, h in enumerate(heads)]
    regular = len(modal) == len(data)
    consistency, penalty = hits / len(data), 0.25 * prose / len(data)
    alignment = 0.70 * consistency + 0.30 * _reach(data, width) + (0.05 if columns >= 6 else 0.0)
    score = evidence_score(source, len(data), consistency, min(alignment, 1.0 if regular else 0.68), _numbers(data), prose=penalty)
    return _found(rows, [header, *map(cells, data)], source, score, penalty, score >= 0.70 and regular)


def _centres(rows: list[Row], columns: int) -> list[float]:
    """Mean centre of each word position over rows of as many words."""
    return [fmean((r.words[k].x0 + r.words[k].x1) / 2 for r in rows) for k in range(columns)]


def row_starts(xs: list[float], gap: float = 45.0) -> list[float]:
    """Left edges of a row as groups: an edge within the gap of the last group moves it half way, another starts one."""
    out: list[float] = []
    for x in xs:
        if out and x - out[-1] <= gap:
            out[-1] = (out[-1] + x) / 2
        else:
            out.append(x)
    return out


def form_columns(starts: list[float], width: float) -> list[float]:
    """Column positions that rows of a form share; none where they are under 3, too narrow or too many."""
    xs = sorted(starts)
    gaps = sorted(b - a for a, b in zip(xs, xs[1:]) if b - a > 5.0)
    tolerance = min(max(gaps[min(int(len(gaps) * 0.70), len(gaps) - 1)], 25.0), 50.0) if len(gaps) >= 3 else 35.0
    groups: list[list[float]] = []
    for x in xs:
        if groups and abs(x - fmean(groups[-1])) <= tolerance:
            groups[-1].append(x)
        else:
            groups.append([x])
    columns = [fmean(g) for g in groups]
    span = columns[-1] - columns[0] if columns else 0.0
    most = max(int(20.0 * width / 612.0 + 0.5), 15)
    if not 3 <= len(columns) <= most or span <= 0 or span / len(columns) < 30.0 or len(columns) / max(span / 72.0, 0.1) > 10.0:
        return []
    return columns


def form_tables(rows: list[Row], width: float) -> list[dict]:
    """Tables of forms: runs of rows whose words start at columns that the page's rows share."""
    prose = [is_prose(r.texts) or (r.box[2] - r.box[0] > 0.55 * width and len(" ".join(r.texts)) > 60) for r in rows]
    barred = [p or re.fullmatch(r"\.\d+", r.texts[0].strip()) is not None for r, p in zip(rows, prose, strict=True)]
    starts = [row_starts([w.x0 for w in r.words]) for r in rows]
    shared_ = [x for s, no in zip(starts, barred, strict=True) if len(s) >= 3 and not no for x in s]
    columns = form_columns(shared_, width) if len(rows) >= 3 and width > 0 and len(shared_) >= 9 else []
    if not columns:
        return []
    near = lambda x: min(range(len(columns)), key=lambda k: abs(x - columns[k]))
    fits = [not no and len({near(x) for x in s if abs(x - columns[near(x)]) <= 40.0}) >= 2 for s, no in zip(starts, barred, strict=True)]
    if sum(fits) < 3 or sum(fits) * 5 < len(rows):
        return []
    home = lambda x: next((k for k in range(len(columns) - 1) if x < columns[k + 1] - 20.0), len(columns) - 1)
    out, i = [], 0
    while i < len(rows):
        j = i + 1
        while fits[i] and j < len(rows) and fits[j] and rows[j].base - rows[j - 1].base <= 3.4 * max(rows[j].font, rows[j - 1].font):
            j += 1
        run = rows[i:j]
        if fits[i] and len(run) >= 3:
            cells: list[list[str]] = []
            for r in run:
                row: list[list[str]] = [[] for _ in columns]
                for w in r.words:
                    row[home(w.x0)].append(w.text.strip())
                cells.append([" ".join(c) for c in row])
            alignment = 0.55 + 0.20 * _reach(run, width) + 0.25 * min(len(columns) / 6.0, 1.0)
            score = max(evidence_score("TextAlignment", len(run), 1.0, min(alignment, 1.0), _numbers(run)), 0.50)
            out.append(_found(run, cells, "TextAlignment", score, 0.0, score >= 0.68))
        i = j
    return out


def _captioned(row: Row) -> bool:
    text = " ".join(row.texts).lower()
    return "table " in text and ":" in text


def _after_table(row: Row, n: int) -> bool:
    """Whether a row after ``n`` rows of a captioned table no longer belongs to it: a caption, a section, a sentence, prose."""
    text = " ".join(row.texts)
    section = re.match(r"[.()]*[0-9]*[.()]*\s+[A-Z]", text) is not None
    sentence = len(row.words) >= 7 and text.rstrip().endswith(".") and re.match(r"(?i)(these|this|the|values) ", text) is not None
    return (n >= 1 and _captioned(row)) or (n >= 3 and section) or (n >= 4 and (sentence or is_prose(row.texts)))


def captioned_tables(rows: list[Row], width: float) -> list[dict]:
    """Up to 18 rows after a caption line, as they stand."""
    out, k = [], 0
    while k < len(rows):
        j = k + 1
        while _captioned(rows[k]) and j < len(rows) and j - k <= 18 and (j == k + 1 or rows[j].base - rows[j - 1].base <= rows[j].font * 3.4) and not _after_table(rows[j], j - k - 1):
            j += 1
        run = rows[k + 1 : j]
        if len(run) >= 3:
            consistency = max(Counter(len(r.words) for r in run).values()) / len(run)
            alignment = min(0.65 * consistency + 0.35 * _reach(run, width), 1.0)
            score = max(evidence_score("ExplicitRegion", len(run), consistency, alignment, _numbers(run), caption=0.95), 0.48)
            out.append(_found(run, [r.texts for r in run], "ExplicitRegion", score, 0.0, False))
        k = j
    return out


def aligned_tables(rows: list[Row], width: float) -> list[dict]:
    """Runs of at least 4 rows of 3 to 16 words whose words stand in stable columns; the first row is the header."""
    aligned = lambda r: 3 <= len(r.words) <= 16 and r.box[2] - r.box[0] >= 70 and sum(bool(t.strip()) for t in r.texts) >= 3
    out = []
    for i, j in _runs(rows, aligned, aligned, 2.8):
        run = rows[i:j]
        if len(run) < 4 or all(is_prose(r.texts) for r in run):
            continue
        columns, hits = _modal_width(run)
        modal = [r for r in run if len(r.words) == columns]
        if columns < 3 or hits < 3:
            continue
        centres = _centres(modal, columns)
        if all(abs((w.x0 + w.x1) / 2 - c) <= 1.8 * max(w.font_size, 8.0) for r in modal for w, c in zip(r.words, centres, strict=True)):
            out.append(_table(run, 1, width, "TextAlignment"))
    return [t for t in out if t]


def layout_text(rows: list[Row]) -> str:
    """Rows as text with words at their place: one character for each 0.45 of the font size (3.5 points at least)."""
    left = min(r.box[0] for r in rows)
    out = []
    for r in rows:
        step, line = max(r.font * 0.45, 3.5), ""
        for w in r.words:
            at = int((w.x0 - left) / step)
            gap = at - len(line)
            line += (" " * gap if gap > 6 else " " if line else "") + w.text
        out.append(line.rstrip())
    return "\n".join(out)


def _header_start(rows: list[Row], first: int) -> int:
    """Up to four rows with header words right above the data."""
    start = first
    while start and first - start < 4:
        above = rows[start - 1]
        close = rows[start].base - above.base <= rows[start].font * 2.8
        if not close or len(above.words) > 24 or not any(k in " ".join(above.texts).lower() for k in HEADER_WORDS):
            break
        start -= 1
    return start


def coordinate_tables(words: list, width: float) -> list[dict]:
    """Tables from word positions: numeric rows, and only where there are none, form columns, aligned and captioned rows."""
    rows = word_rows(words)
    if len(words) < 12 or len(rows) < 4:
        return []
    found = []
    weak = lambda r: len(r.words) >= 4 and sum(map(is_value, r.texts)) >= 3
    for i, j in _runs(rows, lambda r: is_data(r.texts), lambda r: is_data(r.texts) or weak(r), 2.6):
        if sum(is_data(r.texts) for r in rows[i:j]) >= 3:
            start = _header_start(rows, i)
            found.append(_table(rows[start:j], i - start, width, "NumericRows"))
    found = [t for t in found if t] or [*form_tables(rows, width), *aligned_tables(rows, width), *captioned_tables(rows, width)]
    return better_tables(found)


def better_tables(found: list[dict]) -> list[dict]:
    """Of tables that overlap the more confident one, Markdown ahead of layouts."""
    kept = keep_better([t["box"] for t in found], [t["confidence"] + (0.05 if t["render"] == "Markdown" else 0.0) for t in found])
    return [found[i] for i in kept]


def ruled_regions(rules: list, words: list, width: float, height: float) -> list[dict]:
    """Regions between neighbouring horizontal rules with text in columns, and grids of rules both ways.

    ``rules`` have orientation ('h' or 'v'), pos, lo and hi; horizontal ones count from 100 points, vertical from 20.
    """
    level = sorted((r for r in rules if r.orientation == "h" and r.hi - r.lo >= 100), key=lambda r: r.pos)
    upright = [r for r in rules if r.orientation == "v" and r.hi - r.lo >= 20]
    out = []
    long = [r for r in level if r.hi - r.lo >= 0.3 * width]
    for top, bottom in zip(long, long[1:]):
        x0, x1 = min(top.lo, bottom.lo), max(top.hi, bottom.hi)
        inside = [w for w in words if top.pos <= (w.y0 + w.y1) / 2 <= bottom.pos and w.x1 > x0 and w.x0 < x1]
        starts = clusters([w.x0 for w in inside], 12.0)
        if 8 <= bottom.pos - top.pos <= 320 and len(inside) >= 3 and len(starts) >= 2:
            out.append({"box": (max(x0, 0.0), max(top.pos, 0.0), min(x1, width), min(bottom.pos, height)), "source": "RulingBand", "crossings": 0})
    if len(level) >= 2 and len(upright) >= 2:
        box = (min(r.pos for r in upright), level[0].pos, max(r.pos for r in upright), level[-1].pos)
        inside = [w for w in words if shared(box, (w.x0, w.y0, w.x1, w.y1)) > 0]
        if box[2] - box[0] >= 0.3 * width and 0 < box[3] - box[1] <= 640 and len(inside) >= 3:
            out.append({"box": box, "source": "RulingGrid", "crossings": len(level) * len(upright)})
    return merge_regions(out)


def merge_regions(regions: list[dict], share: float = 0.6) -> list[dict]:
    """Overlapping regions as one: joint box, stronger source, most crossings."""
    strength = {"RulingGrid": 3, "RulingBand": 2, "Whitespace": 1}
    kept: list[dict] = []
    for r in regions:
        home = next((k for k in kept if smaller_share(k["box"], r["box"]) > share), None)
        if home is None:
            kept.append(dict(r))
        else:
            home["box"] = union([home["box"], r["box"]])
            home["source"] = max(home["source"], r["source"], key=lambda s: strength[s])
            home["crossings"] = max(home["crossings"], r["crossings"])
    return kept


def _centre(w) -> float:
    return (w.x0 + w.x1) / 2


def whitespace_region(words: list, width: float) -> list[dict]:
    """The region of rows that share at least 3 columns parted by white space: 3 rows of 3 words whose centres recur."""
    kept = sorted((w for w in words if w.text.strip()), key=lambda w: ((w.y0 + w.y1) / 2, w.x0, w.block_id, w.widx))
    rows = [r for r in lines_by_first(kept, lambda w: (w.y0 + w.y1) / 2, lambda w: 8.0) if len(r) >= 3]
    tolerance = min(max(width * 0.018, 8.0), 18.0)
    groups: list[list[float]] = []
    for x in sorted(_centre(w) for r in rows for w in r):
        if groups and abs(x - fmean(groups[-1])) <= tolerance:
            groups[-1].append(x)
        else:
            groups.append([x])
    columns = [fmean(g) for g in groups if len(g) >= 3]
    if len(kept) < 9 or len(rows) < 3 or len(columns) < 3:
        return []
    near = lambda w: min(range(len(columns)), key=lambda k: abs(_centre(w) - columns[k]))
    fits = [r for r in rows if len({near(w) for w in r if abs(_centre(w) - columns[near(w)]) <= 2.0 * max(w.font_size, 8.0)}) >= 3]
    if len(fits) < 3:
        return []
    x0, y0, x1, y1 = union([(w.x0, w.y0, w.x1, w.y1) for r in fits for w in r])
    return [{"box": (x0 - 3.0, y0 - 3.0, x1 + 3.0, y1 + 3.0), "source": "Whitespace", "crossings": 0}]


def region_tables(words: list, rules: list, width: float, height: float) -> list[dict]:
    """Tables in regions of ruling lines and of white space; regions of prose on most of a page are none."""
    found = []
    for region in merge_regions(ruled_regions(rules, words, width, height) + whitespace_region(words, width)):
        x0, y0, x1, y1 = region["box"]
        inside = [w for w in words if w.x0 < x1 and w.x1 > x0 and w.y0 < y1 and w.y1 > y0]
        if len(inside) < 3:
            continue
        rows = [Row(g) for g in lines_by_first(sorted(inside, key=lambda w: (w.base, w.x0, w.block_id, w.widx)), lambda w: w.base, lambda w: max(w.font_size * 0.65, 4.0))]
        prose = sum(len(r.texts) >= 6 and any(t.lower() in STOPWORDS for t in r.texts) and not any(c.isdigit() and c.isascii() for t in r.texts for c in t) for r in rows)
        if len(rows) >= 8 and y1 - y0 >= 0.45 * height and prose * 10 >= len(rows) * 3:
            continue
        source = "TextAlignment" if region["source"] == "Whitespace" else region["source"]
        consistency = max(Counter(len(r.words) for r in rows).values()) / len(rows)
        numbers = _numbers(rows)
        # A region of at least 35 % of the page's height needs stronger evidence.
        broad = {"TextAlignment": 0.28, "RulingBand": 0.12, "RulingGrid": 0.04}[source] if y1 - y0 >= 0.35 * height else 0.0
        score = evidence_score(source, len(rows), consistency, min((consistency + max(numbers, 0.20)) / 2, 1.0), numbers, prose=broad + 0.35 * prose / len(rows))
        found.append(_found(rows, [r.texts for r in rows], source, score, 0.35 * prose / len(rows), consistency >= 0.80 and len(rows) >= 3) | {"box": region["box"]})
    return found


def grid_cells(boxes: list[Box], numeric: list[bool]) -> dict[int, tuple[int, int]]:
    """(row, column) by box where boxes form a grid: rows of two or more that follow each other, 2 to 10 columns."""
    if len(boxes) < 4:
        return {}
    levels = clusters([b[1] for b in boxes], 6.0)
    near = lambda v, centres, tol: next((k for k in sorted(range(len(centres)), key=lambda k: abs(v - centres[k]))[:1] if abs(v - centres[k]) <= tol), None)
    row = [near(b[1], levels, 6.0) for b in boxes]
    full = [k for k in range(len(levels)) if row.count(k) >= 2]
    runs: list[list[int]] = []
    for k in full:
        if runs and k - runs[-1][-1] <= 2:
            runs[-1].append(k)
        else:
            runs.append([k])
    out: dict[int, tuple[int, int]] = {}
    for run in (r for r in runs if len(r) >= 2):
        members = [i for i in range(len(boxes)) if row[i] in run]
        anchor = {i: boxes[i][2] if numeric[i] else boxes[i][0] for i in members}
        columns = clusters(list(anchor.values()), 12.0)
        if not 2 <= len(columns) <= 10:
            continue
        column = {i: near(anchor[i], columns, 12.0) for i in members}
        held = Counter(c for c in column.values() if c is not None)
        if sum(n >= 2 for n in held.values()) >= 2:
            out |= {i: (run.index(row[i]), column[i]) for i in members if column[i] is not None}
    return out


# --- formulas --------------------------------------------------------------------------------

_OPERATORS = set("∑∏∫√∂∞=+−≤≥≠≈→⇒×÷")


def latex(text: str) -> str:
    return "".join([LATEX.get(c, c) for c in text])


def geometric_latex(words: list, source: str) -> str:
    """LaTeX from word positions: fractions, limits of big operators, sub- and superscripts; else symbol by symbol."""
    genuine = any(w.text.strip() in _OPERATORS or re.search("[₁₂₃ⁱⁿ]", w.text) for w in words) or re.search(r"[_^]|\\frac|\\sum", source)
    kept = [w for w in words if not _noise(w.text)]
    if len(words) < 2 or not genuine or len(kept) < 2:
        return latex(source)
    font = median([w.font_size for w in kept])
    tolerance = min(max(font * 0.4, 2.0), 8.0)
    rows = lines_by_first(sorted(kept, key=lambda w: (w.base, w.x0)), lambda w: w.base, lambda w: tolerance)
    rows = [sorted(r, key=lambda w: w.x0) for r in _with_scripts(rows, font)]
    mean = lambda r: fmean(w.base for w in r)
    span = lambda r: (min(w.x0 for w in r), max(w.x1 for w in r))
    if len(rows) == 2:
        (a0, a1), (b0, b1) = span(rows[0]), span(rows[1])
        least = min(a1 - a0, b1 - b0)
        overlap = max(min(a1, b1) - max(a0, b0), 0.0) / least if least > 0 else 0.0
        if overlap >= 0.5 and font * 0.8 <= mean(rows[1]) - mean(rows[0]) <= font * 2.0:
            top, bottom = (latex(" ".join(w.text for w in r)) for r in rows)
            return rf"\frac{{{top}}}{{{bottom}}}"
    big = next(((r, w) for r in rows for w in r if w.text.strip() in "∑∏∫" and w.text.strip()), None)
    if big:
        row, op = big
        limit = lambda below: " ".join(latex(w.text) for r in rows if r is not row and (mean(r) - mean(row) > font * 0.3 if below else mean(row) - mean(r) > font * 0.3) for w in r)
        below, above = limit(True), limit(False)
        k = row.index(op)
        scripts = (f"_{{{below}}}" if below or above else "") + (f"^{{{above}}}" if above else "")
        sides = [" ".join(latex(w.text) for w in part) for part in (row[:k], row[k + 1 :])]
        return (f"{sides[0]} " if sides[0] else "") + latex(op.text) + scripts + (f" {sides[1]}" if sides[1] else "")
    return " \\\\ ".join(_scripted(r, font) for r in rows)


def _noise(text: str) -> bool:
    t = text.strip()
    if t in set("+−=×÷≤≥∑∏∫√") and t:
        return False
    bracketed = t.startswith("(") and t.endswith(")") and len(t.encode()) <= 6
    return not t or bracketed or re.search(r"http|www|://|\.com|\.org", t) is not None or t in ("•", "·", "●", "◦") or re.fullmatch(r"[!-/:-@\[-`{-~]+", t) is not None


def _with_scripts(rows: list[list], font: float) -> list[list]:
    """Rows closer than 1.3 of the font size joined, nearest first, until none is."""
    rows = [list(r) for r in rows]
    while len(rows) > 1:
        level = [fmean(w.base for w in r) for r in rows]
        gap, i, j = min((abs(level[a] - level[b]), a, b) for a in range(len(rows)) for b in range(a))
        script = min(len(rows[i]), len(rows[j])) and (max(w.font_size for w in rows[i]) < 0.85 * font or max(w.font_size for w in rows[j]) < 0.85 * font)
        if gap >= font * 1.3 or not script:
            break
        rows[j] += rows.pop(i)
    return sorted(rows, key=lambda r: fmean(w.base for w in r))


def _scripted(row: list, font: float) -> str:
    """A row with words off its main baseline, or of small type, as sub- and superscripts."""
    if len(row) == 1:
        return latex(row[0].text)
    top = max(w.font_size for w in row)
    mains = sorted(w.base for w in row if w.font_size >= 0.9 * top)
    main = mains[(len(mains) - 1) // 2]
    out = []
    for w in row:
        small, off, t = w.font_size < 0.78 * font, w.base - main, latex(w.text)
        out.append(f"_{{{t}}}" if off > 0.25 * font or (small and off > 0) else f"^{{{t}}}" if -off > 0.25 * font or (small and off < 0) else t)
    return " ".join(out)


# --- figures ---------------------------------------------------------------------------------


def figures(images: list[Box], captions: list[tuple[Box, str]], bodies: list[Box], width: float, height: float, padding: float = 6.0) -> list[dict]:
    """Figure regions: captions with images near, captions alone beside free space, and groups of images."""
    pad = lambda b: (max(b[0] - padding, 0.0), max(b[1] - padding, 0.0), min(b[2] + padding, width), min(b[3] + padding, height))
    found, used = [], set()
    for box, text in captions:
        related = lambda im, box=box: (im[0] < box[2] and im[2] > box[0]) or abs(im[0] + im[2] - box[0] - box[2]) / 2 <= 0.75 * max(im[2] - im[0], box[2] - box[0])
        near = [k for k, im in enumerate(images) if apart(im[1], im[3], box[1], box[3]) <= max(height * 0.28, 120.0) and related(im)]
        if near:
            used.update(near)
            found.append({"box": pad(union([images[k] for k in near])), "caption": text.strip(), "images": near, "confidence": 82, "reason": "caption-near-images"})
            continue
        tall = min(max(height * 0.24, 90.0), 220.0)
        places = [("caption-only-estimate", (width * 0.08, max(box[1] - tall - 10, 0.0), width * 0.92, max(box[1] - 10, 0.0))), ("caption-only-proposal-below", (width * 0.08, min(box[3] + 10, height), width * 0.92, min(box[3] + 10 + tall, height)))]
        scored = []
        for reason, b in places:
            if b[3] - b[1] > height * 0.04:
                soiled = min(sum(shared(b, o) for o in bodies) / max(size(b), 1.0), 1.0)
                edge = 8.0 if b[1] <= 1.0 or b[3] >= height - 1.0 else 0.0
                scored.append((min(max(46.0 - soiled * 85.0 - edge, 8.0), 58.0), reason, b))
        if scored:
            score, reason, b = max(scored, key=lambda s: (s[0], s[1] == "caption-only-estimate"))
            grown = list(pad(b))
            if shared(tuple(grown), box) > 0:
                if reason == "caption-only-estimate":
                    grown[3] = max(min(grown[3], box[1] - 1.0), grown[1])
                else:
                    grown[1] = min(max(grown[1], box[3] + 1.0), grown[3])
            found.append({"box": tuple(grown), "caption": text.strip(), "images": [], "confidence": int(score + 0.5), "reason": reason})
    groups: list[list[int]] = []
    for k in sorted(set(range(len(images))) - used, key=lambda k: (images[k][1], images[k][0])):
        im = images[k]
        centre = ((im[0] + im[2]) / 2 / width, (im[1] + im[3]) / 2 / height)
        if size(im) / (width * height) < 0.012 and not (0.10 < centre[0] < 0.90 and 0.12 < centre[1] < 0.88):
            continue
        close = lambda o, im=im: apart(o[1], o[3], im[1], im[3]) <= height * 0.08 and apart(o[0], o[2], im[0], im[2]) <= width * 0.08
        home = next((g for g in groups if any(close(images[o]) for o in g)), None)
        if home is None:
            groups.append([k])
        else:
            home.append(k)
    bands: list[list[int]] = []
    for g in groups:
        b = union([images[k] for k in g])

        def beside(o: list[int], b: Box = b) -> bool:
            c = union([images[k] for k in o])
            overlap = max(min(b[3], c[3]) - max(b[1], c[1]), 0.0) / max(min(b[3] - b[1], c[3] - c[1]), 1.0)
            return overlap >= 0.65 and apart(b[0], b[2], c[0], c[2]) <= width * 0.35

        home = next((o for o in bands if beside(o)), None)
        if home is None:
            bands.append(list(g))
        else:
            home += g
    found += [{"box": pad(union([images[k] for k in g])), "caption": None, "images": sorted(g), "confidence": 52, "reason": "image-group"} for g in bands]
    ranked = sorted(found, key=lambda f: (-f["confidence"], f["box"][1]))
    kept = [ranked[i] for i in keep_first([f["box"] for f in ranked], 0.72)]
    return sorted(kept, key=lambda f: (f["box"][1], f["box"][0]))


# --- DataFrame operators ---------------------------------------------------------------------


def _per_page(df: DataFrame, schema: str, fold: Callable[[tuple, list], list[tuple]], keys: list[str] = PAGE) -> DataFrame:
    """A fold over the rows of each page; ``fold`` gets (key, rows) and gives tuples without the key.

    Rows are partitioned and sorted by page, the exchange a grouped map has too, and pages are cut
    from the stream of Arrow batches: no data frame is built for each page, and memory holds a batch
    and one page. Rows without a key are left out.
    """
    names = [*keys, *[c.split(" ")[0] for c in schema.split(", ")]]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    width = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, key = [], None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name="Row"):
                if row[:width] != key:
                    if page:
                        out += [(*key, *r) for r in fold(key, page)]
                    page, key = [], row[:width]
                page.append(row)
            yield pd.DataFrame(out, columns=names)
        if page:
            yield pd.DataFrame([(*key, *r) for r in fold(key, page)], columns=names)

    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *rest).dropna(subset=keys).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, f"{fields}, {schema}")


def _rows(rows: list, *by: str) -> list:
    """Rows in a total order."""
    return sorted(rows, key=attrgetter(*by))


def page_reading_order(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_num, block_id, position): blocks in reading order."""

    def fold(_: tuple, page: list) -> list[tuple]:
        rows = _rows(page, "y0", "x0", "block_id")
        return [(rows[i].block_id, k) for k, i in enumerate(reading_order([(r.x0, r.y0, r.x1, r.y1) for r in rows]))]

    return _per_page(blocks.select(*PAGE, "block_id", "x0", "y0", "x1", "y1").dropna(), "block_id bigint, position int", fold)


def page_grid_cells(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, page_num, block_id, cell_row, cell_col): blocks that form a grid; ``sizes`` has the body size of each file."""
    small = blocks.join(sizes, "doc_id", "left").withColumn("_body", F.coalesce("body_size", F.lit(0.0)))
    small = small.where(~is_no_table_block(F.col("text"), F.col("x1") - F.col("x0"), F.col("font_size"), F.col("_body")))

    def fold(_: tuple, page: list) -> list[tuple]:
        rows = _rows(page, "y0", "x0", "block_id")
        cells = grid_cells([(r.x0, r.y0, r.x1, r.y1) for r in rows], [is_value(r.text.strip()) for r in rows])
        return [(rows[i].block_id, *cell) for i, cell in cells.items()]

    return _per_page(small.select(*PAGE, "block_id", "text", "x0", "y0", "x1", "y1").dropna(), "block_id bigint, cell_row int, cell_col int", fold)


def page_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page_num, line_no, text, n_words, box): words grouped by the running mean of their baselines."""

    def fold(_: tuple, page: list) -> list[tuple]:
        rows = [r for r in _rows(page, "base", "x0", "block_id", "widx") if r.text.strip()]
        groups = lines_by_last(rows, lambda w: w.base, lambda w: min(max(0.65 * w.font_size, 3.0), 9.0))
        out = []
        for k, g in enumerate(groups):
            g = sorted(g, key=lambda w: (w.x0, w.block_id, w.widx))
            out.append((k, " ".join(w.text.strip() for w in g), len(g), *union([(w.x0, w.y0, w.x1, w.y1) for w in g])))
        return out

    return _per_page(_based(words), "line_no int, text string, n_words int, x0 double, y0 double, x1 double, y1 double", fold)


def _based(words: DataFrame) -> DataFrame:
    """Words with a place: text, box and size; ``base`` is the baseline, or the box's lower edge."""
    base = F.coalesce("baseline_y", "y1").alias("base")
    return words.where("text is not null").dropna(subset=["font_size", "x0", "y0", "x1", "y1"]).select(*PAGE, "block_id", "widx", "text", "font_size", "x0", "y0", "x1", "y1", base)


def _with_size(df: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Rows and one more for each page that has a size, told by ``width`` over 0: a fold gets its page's size without a join."""
    out = df.withColumns({"width": F.lit(0.0), "height": F.lit(0.0)})
    if pages is None:
        return out
    return out.unionByName(pages.where("width > 0 and height > 0").select(*PAGE, *_blank(df), "width", "height"))


def _sized(page: list) -> tuple[list, float, float]:
    """(rows, width, height) of a page; the usual size where no report has one."""
    width, height = max(((r.width, r.height) for r in page if r.width > 0), default=(WIDTH, HEIGHT))
    return [r for r in page if r.width == 0], width, height


def _blank(df: DataFrame) -> list:
    """Empty values for the columns of ``df`` besides its page."""
    return [F.lit("").alias(f.name) if f.dataType.simpleString() == "string" else F.lit(0).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name not in PAGE]


def _with_rules(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Words and ruling lines as rows of one table; lines have an orientation."""
    based = _based(words)
    w = based.withColumns({"orientation": F.lit(""), "pos": F.lit(0.0), "lo": F.lit(0.0), "hi": F.lit(0.0)})
    return w.unionByName(rules.dropna(subset=["orientation", "pos", "lo", "hi"]).select(*PAGE, *_blank(based), "orientation", "pos", "lo", "hi"))


_TABLE = "table_no int, source string, confidence double, render string, n_rows int, n_columns int, x0 double, y0 double, x1 double, y1 double, prose_penalty double, source_block_ids array<bigint>, rows array<array<string>>, layout_text string, width double, height double"


def _table_fold(coordinates: bool, ruled: bool) -> Callable:
    """The fold that finds a page's tables by coordinates, by ruling lines and white space, or both."""

    def fold(_: tuple, page: list) -> list[tuple]:
        rows, width, height = _sized(page)
        inside = _rows([r for r in rows if not ruled or not r.orientation], "base", "x0", "block_id", "widx")
        found = coordinate_tables(inside, width) if coordinates else []
        if ruled:
            found += region_tables(inside, [r for r in rows if r.orientation], width, height)
        if ruled and coordinates:
            found = better_tables(found)
        return [(k, t["source"], round(t["confidence"], 9), t["render"], len(t["rows"]), max(map(len, t["rows"])), *t["box"], round(t["prose"], 9), t["ids"], t["rows"], t["layout"], width, height) for k, t in enumerate(found)]

    return fold


def page_tables(words: DataFrame, pages: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_num, table_no, source, confidence, render, n_rows, n_columns, box, prose_penalty, source_block_ids, rows, layout_text, width, height).

    With ``rules`` (orientation, pos, lo, hi) also tables between ruling lines and of columns of white
    space; of tables that overlap the better one stays.
    """
    both = _based(words) if rules is None else _with_rules(words, rules)
    return _per_page(_with_size(both, pages), _TABLE, _table_fold(True, rules is not None))


def page_formulas(words: DataFrame, formulas: DataFrame) -> DataFrame:
    """(doc_id, page_num, formula_index, latex): LaTeX from the words inside each formula's box."""
    f = formulas.select(*PAGE, "formula_index", "source_text", *[F.col(k).alias(f"f_{k}") for k in ("x0", "y0", "x1", "y1")])
    inside = (F.col("x0") < F.col("f_x1")) & (F.col("x1") > F.col("f_x0")) & (F.col("y0") < F.col("f_y1")) & (F.col("y1") > F.col("f_y0"))
    both = f.join(_based(words), PAGE).where(inside)

    def fold(_: tuple, page: list) -> list[tuple]:
        return [(geometric_latex(_rows(page, "base", "x0", "block_id", "widx"), page[0].source_text or ""),)]

    return _per_page(both, "latex string", fold, [*PAGE, "formula_index"])


def _signs(text: str) -> list[str]:
    """A text's characters without white space and script marks, sorted."""
    return sorted(re.sub(r"[\s_^{}]", "", text))


def source_formulas(words: DataFrame, formulas: DataFrame) -> DataFrame:
    """(doc_id, page_num, formula_index, latex): LaTeX from the words a formula was read from, its number left out.

    ``formulas`` has bare and number besides source_text and its box. A box may touch other lines or
    lie over other text: only words with their middle inside count, and only where they are the
    formula's source text, character by character. Other formulas give no row.
    """
    f = formulas.select(*PAGE, "formula_index", "source_text", "bare", "number", *[F.col(k).alias(f"f_{k}") for k in ("x0", "y0", "x1", "y1")])
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    both = f.join(_based(words), PAGE).where(x.between(F.col("f_x0"), F.col("f_x1")) & y.between(F.col("f_y0"), F.col("f_y1")))

    def fold(_: tuple, page: list) -> list[tuple]:
        rows = _rows(page, "base", "x0", "block_id", "widx")
        if _signs("".join(w.text for w in rows)) != _signs(rows[0].source_text):
            return []
        return [(geometric_latex([w for w in rows if w.text.strip() != rows[0].number], rows[0].bare).strip(),)]

    return _per_page(both, "latex string", fold, [*PAGE, "formula_index"])


def page_figures(blocks: DataFrame, images: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_num, figure_no, confidence, reason, caption, box): figures of each page.

    ``blocks`` has kind; ``images`` has image_index and its box. Pages with neither caption nor image give none.
    """
    cols = [*PAGE, "role", "text", "x0", "y0", "x1", "y1"]
    caption = (F.col("kind") == "Caption") | F.lower(F.col("text")).rlike(r"^\s*(figure|fig\.|fig |table|exhibit|plate)")
    both = blocks.withColumn("role", F.when(caption, "caption").otherwise("body")).select(*cols)
    both = both.unionByName(images.select(*PAGE, F.lit("image").alias("role"), F.lit("").alias("text"), "x0", "y0", "x1", "y1")).dropna()

    def fold(_: tuple, page: list) -> list[tuple]:
        rows, width, height = _sized(page)
        rows = _rows(rows, "role", "y0", "x0")
        of = lambda role: [(r.x0, r.y0, r.x1, r.y1) for r in rows if r.role == role]
        found = figures(of("image"), [((r.x0, r.y0, r.x1, r.y1), r.text) for r in rows if r.role == "caption"], of("body"), width, height)
        return [(k, f["confidence"], f["reason"], f["caption"], *f["box"]) for k, f in enumerate(found)]

    return _per_page(_with_size(both, pages), "figure_no int, confidence int, reason string, caption string, x0 double, y0 double, x1 double, y1 double", fold)


def page_ruled_tables(words: DataFrame, rules: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The columns of ``page_tables``: only tables between ruling lines and of columns of white space."""
    return _per_page(_with_size(_with_rules(words, rules), pages), _TABLE, _table_fold(False, True))
