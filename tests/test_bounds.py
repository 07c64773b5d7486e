"""Questions in which letters beyond ASCII stand beside a pattern's words: queries and their SQL bound words alike."""

import duckdb
import pytest

from sparkquarry import catalog

TEXTS = ["enbeenbe test\u00e4 erlich", "\u00fctest of blood t\u00e4st", "what is \u00e4spirin", "blood \u00e4 test\u00df count", "\u00e4penicillin dose\u00e9 mg", "diagnose\u00f1 fever\u00e0"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    c.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, 0, 'user', ?)", list(enumerate(TEXTS)))
    c.executemany("INSERT INTO pages VALUES (?, '', ?)", [(i, f"<h1>{t}</h1>") for i, t in enumerate(["reactions\u00e4", "\u00e4allergies", "lab results\u00e9"])])
    for t in ("benchmark", "conversations", "pages"):
        c.execute(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT parquet)")
    return str(d), c


def same(spark, odd, name):
    d, c = odd
    rows = catalog.QUERIES[name](spark, d)
    want = c.execute(f"SELECT {', '.join(rows.columns)} FROM ({catalog.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, want))


def test_intent_scores(spark, odd):
    same(spark, odd, "intent_scores")
    same(spark, odd, "section_classify_strict")


def test_query_entities(spark, odd):
    same(spark, odd, "query_entities")


def test_query_entities_by_type(spark, odd):
    same(spark, odd, "query_entities_by_type")


def test_retrieval_strategy(spark, odd):
    same(spark, odd, "retrieval_strategy")
