"""Reranking: BM25 over a question's candidates, or any scorer of (question, text)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75
#: Pairs that a model gets at once.
BATCH = 32


def rerank_text(texts: Column) -> Column:
    """The first three of a question's texts, joined."""
    return F.array_join(F.slice(texts, 1, 3), " ")


def bm25(candidates: DataFrame, query: str = "rerank_query", text: str = "text") -> DataFrame:
    """Add rerank_score: BM25 (Robertson and Zaragoza 2009) with statistics of the question's own candidates.

    candidates: qid, id (one row each), and the two texts. Words are counted once; term and length statistics are window
    aggregates over the counts of a question's candidates.
    """
    of = lambda c: tokens(F.lower(F.coalesce(c, F.lit(""))))
    words = candidates.select("qid", "id", of(text).alias("w"), F.array_distinct(of(query)).alias("q"))
    # a row for each word that the question has; one more, the empty word, keeps a candidate without any
    each = words.select("qid", "id", F.size("w").alias("len"), F.explode(F.concat(F.filter("w", lambda x: F.array_contains("q", x)), F.array(F.lit("")))).alias("term"))
    tf = each.groupBy("qid", "id", "len", "term").agg(F.count("*").alias("tf"))
    mine = Window.partitionBy("qid")
    own = F.col("term") == ""
    tf = tf.withColumns({"n": F.sum(own.cast("int")).over(mine), "mean": F.avg(F.when(own, F.col("len"))).over(mine), "df": F.count("*").over(Window.partitionBy("qid", "term"))}).where(~own)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest("mean", F.lit(1e-9))))
    s = tf.groupBy("qid", "id").agg(F.sum(part).alias("rerank_score"))
    return candidates.join(s, ["qid", "id"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))


def pairwise(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], query: str = "rerank_query", text: str = "text"):
    """A scorer for reranked() from ``load``, which is called once in each Python worker.

    It returns a function of a list of (question, text) pairs that gives their scores.  Pairs come in Arrow batches and go
    to it BATCH at a time, those of similar length together.  Where it fails, or cannot be loaded, or a score is no number,
    scores are null, and the whole question keeps its order.  Missing texts are empty ones.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:  # a model of the caller's: whatever goes wrong, candidates keep their order
            model = None
        for questions, texts in batches:
            pairs = [(q or "", t or "") for q, t in zip(questions, texts, strict=True)]
            out = np.full(len(pairs), np.nan)
            order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]) + len(pairs[i][1]))
            for k in range(0, len(order) if model else 0, BATCH):
                some = order[k : k + BATCH]
                try:
                    out[some] = np.asarray(model([pairs[i] for i in some]), float)
                except Exception:  # the same
                    out[some] = np.nan
            yield pd.Series(out, index=questions.index)

    def score(candidates: DataFrame) -> DataFrame:
        s = F.col("rerank_score")
        return candidates.withColumn("rerank_score", run(F.col(query), F.col(text))).withColumn("rerank_score", F.when(~F.isnan(s) & (F.abs(s) < float("inf")), s))

    return score


def reranked(candidates: DataFrame, scorer=bm25, k: int | None = 50) -> DataFrame:
    """Candidates by the scorer, the first k; without a scorer they keep their order and number, and so do all of a question's
    where the scorer left one without a score."""
    if scorer is None:
        return candidates.withColumn("rerank_position", F.col("position"))
    out = scorer(candidates).withColumn("_failed", F.max(F.col("rerank_score").isNull()).over(Window.partitionBy("qid")))
    w = Window.partitionBy("qid").orderBy(F.desc(F.when(~F.col("_failed"), F.col("rerank_score"))), "position")
    out = out.withColumn("rerank_position", F.row_number().over(w))
    return (out if k is None else out.where(F.col("_failed") | (F.col("rerank_position") <= k))).drop("_failed")
