"""Functions for SQL: Arrow-batched scalar functions and table functions, registered under their names."""

from __future__ import annotations

from types import SimpleNamespace

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from docloom.functions import text as T

_WORDS = "array<struct<text string, x0 double, y0 double, x1 double, y1 double, font_size double, baseline_y double>>"


def _geometric(words: pd.Series, source: pd.Series) -> pd.Series:
    from docloom.operators.pagefolds import geometric_latex

    def one(row, text) -> str:
        listed = [SimpleNamespace(**w, base=w["y1"] if w["baseline_y"] is None else w["baseline_y"], block_id=0, widx=k) for k, w in enumerate(row if row is not None else [])]
        return geometric_latex(sorted(listed, key=lambda w: (w.base, w.x0)), text or "")

    return pd.Series([one(r, t) for r, t in zip(words, source, strict=True)])


@udtf(returnType="page: bigint")
class PageSelection:
    """The 1-based pages of a selection such as ``all``, ``odd`` or ``2-4,7``; none where it is invalid."""

    def eval(self, spec: str, n: int):
        pages: dict[int, None] = {}
        for part in "".join((spec or "").lower().split()).split(","):
            ends = part.split("-")
            if part in ("all", "odd", "even"):
                found = [p for p in range(1, n + 1) if part == "all" or p % 2 == (part == "odd")]
            elif len(ends) in (1, 2) and all(e.isascii() and e.isdigit() for e in ends) and 1 <= int(ends[0]) <= int(ends[-1]) <= n:
                found = range(int(ends[0]), int(ends[-1]) + 1)
            else:
                return
            pages |= dict.fromkeys(found)
        for p in pages:
            yield (p,)


@udtf(returnType="section_no: bigint, title: string, level: int, content: string, page_start: bigint, page_end: bigint")
class SplitSections:
    """The sections of one Markdown text, as ``folds.sections`` gives them for a table of lines."""

    def eval(self, markdown: str):
        import re

        page, no, opened, out = 1, 0, None, []
        for line in (markdown or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            marker, head = re.fullmatch(r"\s*<!-- page:([0-9]+) -->\s*", line), re.match(r"(#{1,6})\s+(\S.*?)\s*$", line)
            if marker:
                page = int(marker[1])
            if head or opened is None:
                no += bool(head)
                opened = {"no": no, "title": head[2] if head else None, "level": len(head[1]) if head else None, "lines": [], "start": page, "last": page}
                out.append(opened)
            if not marker and not head:
                opened["lines"].append(line)
            opened["last"] = max(opened["last"], page)
        kept = [s for s in out if s["title"] is not None or "\n".join(s["lines"]).strip()]
        for s, after in zip(kept, [*kept[1:], None]):
            yield (s["no"], s["title"] or "Document", s["level"] or 1, "\n".join(s["lines"]).strip(), s["start"], after["start"] if after else s["last"])


def register(spark: SparkSession) -> list[str]:
    """Registers the functions; gives their names."""
    from docloom.session import ship

    ship(spark)
    spark.udf.register("geometric_latex", pandas_udf(_geometric, "string"))
    spark.udf.register("unicode_latex", pandas_udf(_symbols, "string"))
    spark.udtf.register("page_selection", PageSelection)
    spark.udtf.register("split_sections", SplitSections)
    return ["geometric_latex", "unicode_latex", "page_selection", "split_sections"]


def _symbols(text: pd.Series) -> pd.Series:
    from docloom.operators.pagefolds import latex

    return text.map(lambda t: None if t is None else latex(t))


def selected_pages(spark: SparkSession, spec: str, n: int):
    """The same selection as an array expression, for tests and for plans that stay in the JVM."""
    return spark.range(1).select(F.explode(T.page_selection(F.lit(spec), F.lit(n).cast("bigint"))).alias("page"))
