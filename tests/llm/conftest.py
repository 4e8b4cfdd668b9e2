import datetime as dt

import pytest

T0 = dt.datetime(2024, 1, 1)
T1 = dt.datetime(2024, 6, 1)


@pytest.fixture(scope="session")
def make(spark):
    """Tables of the given rows; every table gets extra columns whose names operators use inside."""
    extra = "_newest string, word string, line string, key string, token string, n_files string, shard string, form string, votes string, seg string, units string"
    schemas = {
        "blocks": "doc_id bigint, page_num bigint, block_id bigint, text string, reading_order bigint, extracted_at timestamp",
        "words": "doc_id bigint, page_num bigint, block_id bigint, widx bigint, text string, extracted_at timestamp",
        "formulas": "doc_id bigint, page_num bigint, formula_index bigint, source_text string",
        "furniture": "doc_id bigint, page_num bigint, line_idx bigint, signature string",
        "reports": "doc_id bigint, source string, title string, low_density_pages bigint, page_count bigint",
        "triage": "doc_id bigint, pages_needing_ocr array<bigint>, triaged_at timestamp",
        "rendered": "doc_id bigint, markdown string, sections array<struct<title string, level int, content string>>, rendered_at timestamp",
        "documents": "doc_id bigint, text string, lang string, collected_at timestamp",
        "items": "item_id bigint, text string, question string, answer string",
    }

    def table(kind, rows, clash=True):
        schema = schemas[kind]
        if kind == "items":
            rows = [(*r, *[None] * (4 - len(r))) for r in rows]
        if clash:
            schema += ", " + extra
            rows = [(*r, *["x"] * extra.count(" string")) for r in rows]
        return spark.createDataFrame(rows, schema)

    return table


@pytest.fixture(scope="session")
def common(spark):
    return spark.createDataFrame([("en", w) for w in "the of and to in a is that it was by on with not be are which when its has".split()] + [(None, None)], "lang string, word string")
