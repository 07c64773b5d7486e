"""Questions with letters and white space beyond ASCII get what the SQL gives them."""

import duckdb
import pytest

from sparkquarry import catalog

ODD = [
    None, "", "aſpirin and Kidney diſeaſe", "lab ſ urine Ketones", "teſt level; amoxicillinſ x, liſinopril", "blood\x0btest blood\ttest",
    "what?\n", "what?", "treat\x0bpneumonia", "cnİs", "İmcg daily", "İtreat", "İTELL ME ABOUT asthma", "　htn \xa0", " arthritis ,x", "acetominopheń htń ́htn", "éhtn htné _htn htn9",
    "side\x0beffects side-effects", "first\x0bline", "abc\x0bitis gastritis", "x itis", "DIİABETES ſ",
]


@pytest.mark.parametrize("name", ["query_entities", "query_entities_by_type", "retrieval_strategy", "intent_scores", "query_clean", "abbrev_expand", "misspell_fix", "medical_terms"])
def test_equals_sql(spark, tmp_path, name):
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(ODD)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(catalog.SQL[name]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
