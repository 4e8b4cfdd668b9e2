"""All core queries and the SQL that must give the same rows."""

from __future__ import annotations

from docloom.plans import facts, folds, nested, pageplan, pages, policy, scalars, spatial

_MODULES = [nested, scalars, facts, spatial, folds, pageplan, policy, pages]

#: Column types of the SQL side where it counts in wider integers.
_TYPES = {
    "inspect_documents": {"readable_pages": "bigint", "image_only_pages": "bigint", "low_density_pages": "bigint"},
    "ocr_triage_report": {"pages_with_readable_text": "bigint", "image_only_pages": "bigint", "low_density_pages": "bigint"},
    "conversion_warnings": {"n": "bigint"},
    "text_runs": {"run_length": "int"},
    "page_results": {"heading_matches": "bigint", "heading_false_positives": "bigint"},
    "markdown_elements": {"headings": "bigint", "tables": "bigint", "figures": "bigint", "lists": "bigint", "paragraphs": "bigint"},
    "scholarly_pages": {"abstract_at": "int", "metadata": "bigint"},
    "dark_bands": {"y0": "int", "y1": "int", "dark": "bigint"},
    "word_builder": {"word_no": "bigint"},
    "row_width_mode": {"rows": "bigint"},
    "column_centres": {"ordinal": "int"},
    "list_numbering": {"number": "int"},
    "merged_paragraphs": {"paragraph": "bigint"},
    "top_formulas": {"rank": "int"},
    "implicit_tables": {"n_values": "int"},
    "formula_index": {"local": "bigint", "needs_review": "bigint", "recovered": "bigint"},
    "formula_lines": {"row": "bigint"},
    "heading_matches": {"matched": "bigint"},
    "document_metrics": {"matched": "bigint"},
    "markdown_quality": {"headings": "bigint", "table_lines": "bigint", "images": "bigint", "glued_numbers": "bigint"},
    "gfm_tables": {"columns": "int"},
}


def _typed(name: str, text: str) -> str:
    casts = ", ".join(f'cast("{c}" as {t}) as "{c}"' for c, t in _TYPES.get(name, {}).items())
    return f"select * replace ({casts}) from ({text})" if casts else text


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: _typed(k, s) for m in _MODULES for k, s in m.SQL.items()}
