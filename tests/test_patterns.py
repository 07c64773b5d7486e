"""Entity patterns in their quick form find what they say, and go through a text once."""

import pytest
from pyspark.sql import functions as F
from sparkquarry.functions import vocab
from sparkquarry.functions.text import ascii_bounds, matches, strip, tokens, whole_words
from sparkquarry.functions.vectors import hash_embedding
from sparkquarry.operators import chunking, enrich, ner

TEXTS = [
    "", "itis", "arthritis Arthritis, bronchitis-gastritis", "xitis_ _itis 9itis äitis aitisä aitiś", "PINE pine opine alpines statin lovastatin",
    "Test TEST tests test-scan scanTest test", "5mg 5 MG 12.5 ml x5mg 5 mgs 1,000 units ٣mg", "once daily, twice a  day, daily every 6 hours; everyday", "İitis dıabetes diabetes K", None,
]


@pytest.mark.parametrize("kind", [*ner._LEXICON, *[f"query {k}" for k in vocab.QUERY_ENTITIES]])
def test_quick_forms_find_the_same(spark, kind):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for p in vocab.QUERY_ENTITIES[kind[6:]] if kind.startswith("query ") else ner._LEXICON[kind]:
        plain = F.regexp_extract_all("t", F.lit(f"(?i){p}"), F.lit(0))
        bounded = F.regexp_extract_all("t", F.lit(f"(?i){ascii_bounds(p)}"), F.lit(0))
        quick = F.regexp_extract_all("t", F.lit(f"(?i){ascii_bounds(whole_words(p))}"), F.lit(0))
        for r in texts.select("t", plain.alias("a"), matches(F.col("t"), F.lower("t"), p, ner._BEGIN.get(kind)).alias("b"), bounded.alias("c"), quick.alias("d")).collect():
            assert (r.a, r.c) == (r.b, r.d), (p, r.t)


def test_each_pattern_is_in_the_plan_once(spark):
    docs = spark.createDataFrame([(1, "Aspirin test")], "id long, chunk string")
    n = sum(map(len, vocab.CHUNK_ENTITIES.values()))
    plan = enrich.entities(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == n
    plan = ner.lexicon(docs, "chunk")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == sum(map(len, ner._LEXICON.values()))


def test_words_are_looked_for_in_one_pass_and_entities_ordered_once(spark):
    docs = spark.createDataFrame([(1, "Aspirin test")], "id long, chunk string")
    for df in (enrich.entities(docs), ner.lexicon(docs, "chunk")):
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower().replace("array_contains(", "")
        assert (plan.count("contains("), plan.count("arrowevalpython")) == (0, 1)
    some = spark.createDataFrame([("x",)], "t string").withColumn("e", F.array().cast(f"array<{ner.ENTITY}>")).select(ner.related(F.col("e")).alias("r"))
    assert some._jdf.queryExecution().analyzed().toString().count("array_sort(") == 1


def test_chunks_and_vectors_are_made_without_splitting_texts_in_expressions(spark):
    docs = spark.createDataFrame([("A b, c.",)], "t string")
    for c in (chunking.split_plain(F.col("t")), hash_embedding(F.col("t"))):
        assert "regexp_extract_all(" not in docs.select(c)._jdf.queryExecution().optimizedPlan().toString()


def test_plain_chunks_are_the_merged_windows(spark):
    texts = ["", " ", None, " a b ", *[" ".join(f"w{i}" for i in range(n)) + "  " for n in (511, 512, 513, 561, 562, 974, 975, 1100)], "ä x  ٣ 𝒳a-b" * 200]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    w = F.transform(chunking.merged_windows(tokens(F.col("t"))), lambda x: F.array_join(x, " "))
    n = F.size(tokens(F.col("t")))
    want = F.when(n == 0, F.array().cast("array<string>")).when(n <= chunking.SIZE, F.array(strip(F.col("t")))).otherwise(w)
    for r in d.select("t", want.alias("a"), chunking.split_plain(F.col("t")).alias("b")).collect():
        assert r.a == r.b, r.t
