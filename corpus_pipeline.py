"""A corpus pipeline from five of the training-data operators; each stage's rows are written and read by the next.

STAGES are (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.

Defined results, of every stage: null and empty texts are kept as they are until the mix, which takes no words of them;
texts of any length are taken whole; rows are rows: repeated ones and those that share a doc_id or have none are each
scored, deduplicated (one of equal texts stays) and mixed by their own text; columns beyond those of documents go,
whatever they are called; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkquarry.llm import bpe, linededup, minhash, mixing, toxicity
from sparkquarry.llm.common import DOC_COLUMNS, columns_of, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.clean_documents(columns_of(docs, *DOC_COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of line windows go, and documents of which nothing is left."""
    d = linededup.dedup(columns_of(docs, *DOC_COLUMNS))
    return d.where(~((d.removed_lines > 0) & d.text.rlike(r"^[\x20\x09-\x0D]*$"))).drop("n_lines", "removed_lines")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.kept_documents(columns_of(docs, *DOC_COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for each copy."""
    return mixing.mixed_documents(columns_of(docs, *DOC_COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: A learned score, sketches and tokenisation are not SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
