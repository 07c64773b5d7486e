"""Retrieval: a batch of questions to cited answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import answer, query, rerank, search
from ..operators.embed import embedded
from ..sources import store
from ..sources.store import materialised


def hits(questions: DataFrame, points: DataFrame, k: int = search.TOP, mode: str = "any", model=None) -> tuple[DataFrame, DataFrame]:
    """(enhanced questions, merged hits). questions: qid, query, embedding_types (null: by confidence); model: see query.enhanced."""
    q = query.enhanced(questions, model=model)
    # questions are enhanced once; what is embedded, searched and answered reads them
    q = materialised(q.withColumn("rerank_query", rerank.rerank_text(F.col("search_texts"))))
    routed = embedded(search.routed(q), "cleaned").withColumnRenamed("embedding", "vector")
    return q, search.merged(search.search(routed, points, k, mode), k)


def search_collection(queries: DataFrame, table: str, name: str, k: int = search.TOP, mode: str = "any") -> DataFrame:
    """Hits of vectors (qid, vector, filters) in a collection by its name: a name that ends in an embedding type is that type's
    collection, any other is the base and stands for all its types; a collection that is not there has no hits.

    Hits of a base collection are merged, k for each question.
    """
    spark = queries.sparkSession
    kind = next((k_ for k_ in vocab.EMBEDDINGS if name.endswith(f"_{k_}")), None)
    base = name.removesuffix(f"_{kind}") if kind else name
    if base != table.rpartition(".")[2] or not spark.catalog.tableExists(table):
        found = search.search(queries.withColumn("embedding_type", F.lit("")), spark.createDataFrame([], store.POINT), k, mode)
    else:
        kinds = [kind] if kind else [r[0] for r in store.collections(spark, table).collect()]  # a handful
        q = queries.withColumn("embedding_type", F.explode(F.array(*map(F.lit, kinds)))) if kinds else queries.withColumn("embedding_type", F.lit(""))
        found = search.search(q, store.collection(spark, table, kind), k, mode)
    return search.merged(found, k)


def retrieve(questions: DataFrame, points: DataFrame, k: int = search.TOP, mode: str = "any", model=None) -> DataFrame:
    """qid, answer, cited, intent, confidence, entities and filters used, search_texts, embedding types searched."""
    q, found = hits(questions, points, k, mode, model)
    # ranking, its statistics and the list of what was searched all read the hits
    found = materialised(found)
    ranked = rerank.reranked(found.join(q.select("qid", "rerank_query"), "qid"))
    searched = found.groupBy("qid").agg(F.array_sort(F.collect_set("embedding_type")).alias("searched"))
    out = answer.answered(q, ranked).join(searched, "qid", "left")
    return out.select("qid", "answer", "cited", "intent", "confidence", "entities", "answer_filter", "boost_sections", "drugs", "diseases", "procedures", "search_texts", F.coalesce("searched", F.array().cast("array<string>")).alias("searched"))
