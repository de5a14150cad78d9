import re

import pytest

EXTRA = ["_id", "_key", "kept", "size", "group_size", "component_id", "node", "features"]


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text, lang, source) as a table with columns whose names operators use inside."""

    def build(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(*r, *([None] * (4 - len(r))), len(r[1] or "")) for r in rows]
        table = spark.createDataFrame(full, schema)
        from pyspark.sql import functions as F

        return table.withColumns({c: F.lit("x") for c in EXTRA})

    return build
