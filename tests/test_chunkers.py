"""Chunks by expressions against chunks by a function of each document in Python."""

import pytest
from pyspark.sql import functions as F
from test_library import BOX, F1, parsed

from sparkquarry import catalog
from sparkquarry.operators import chunkers, chunking
from sparkquarry.sources import documents as src


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01"])
def test_pages(spark, d):
    a, b = (rows(catalog.QUERIES[q](spark, d)) for q in ("page_chunks", "udtf_chunks"))
    assert a == b and len(a) > 1000


def test_tables_lists_and_long_texts(spark):
    text = lambda t: {"type": "text", "md": t, "bBox": BOX}
    grid = lambda *r: {"type": "table", "md": "| a | b |", "bBox": BOX, "rows": [list(x) for x in r]}
    docs = [F1, {"job_id": "x", "pages": [{"page": 2, "width": 5.0, "height": 6.0, "items": [
        text("before"), text("- one"), {"type": "heading", "md": " Medications  ", "bBox": BOX}, text("- " + "word " * 500), text("2. two"), text("plain " * 900), text(""), text("- three"), grid(("Drug", "Dose"), ("a", "1"), ("b", None)),
        {"type": "heading", "md": "Lab Results", "bBox": BOX}, grid(("Test", "Result"), *[(f"t{i}", "value " * 40) for i in range(60)]), grid(("Name", "Age"), ("x", "1")), {"type": "table", "md": "cell " * 900, "bBox": BOX}, grid(("test",))]}]}]
    items = src.items(parsed(spark, *docs))
    a, b = rows(chunking.section_chunks(items)), rows(chunkers.chunked(items))
    assert a == b and len(a) > 15


def test_a_function_of_ones_own(spark):
    def whole(items):
        yield {"chunk": "\n".join(i["content"] for i in items), "chunk_type": "document", "page": items[0]["page"]}
        yield {"chunk": " "}

    c = chunkers.chunked(src.items(parsed(spark, F1, {**F1, "job_id": "f2"})), whole).orderBy("job_id").collect()
    assert [(x.job_id, x.chunk_no, x.chunk_type) for x in c] == [("f1", 0, "document"), ("f2", 0, "document")] and "Medications\n1. Metformin" in c[0].chunk
    assert chunkers.chunked(src.items(parsed(spark, F1)).where(F.lit(False)), whole).count() == 0
