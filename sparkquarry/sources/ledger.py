"""A ledger of the ids that a collections' table holds, so that a batch reads only what it may hold.

Ids are kept beside the points in BUCKETS hashed buckets a type, and each batch leaves a Bloom filter of the ids that it
added to each bucket.  A new batch asks the filters first; only ids that one of them may know are looked up, and only their
buckets are read.  Most ids of a batch are new, so most buckets are not.  A filter says yes to one new id in a hundred.

The points are written before the ledger.  A batch that was cut short between the two leaves fewer ids than points; the
next one sees that by the counts and makes the ledger anew from the points.  Batches of one table come one after another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialised

#: Buckets of a type; bits of a filter for each id, and bits that an id sets; filters of a bucket from which they are made one.
BUCKETS, BITS, HASHES, SEGMENTS = 64, 10, 7, 32
_SLOT = ["embedding_type", "bucket"]


def _places(ids: pd.Series, bits: int) -> np.ndarray:
    """The bits that each id sets."""
    h = pd.util.hash_array(ids.to_numpy(dtype=object), categorize=False)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def bloom(ids: pd.Series) -> bytes:
    bits = np.zeros(max(64, len(ids) * BITS), bool)
    bits[_places(ids, len(bits)).ravel()] = True
    return len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes()


def may_hold(filter_: bytes, ids: pd.Series) -> np.ndarray:
    n = int.from_bytes(filter_[:8], "little")
    bits = np.unpackbits(np.frombuffer(filter_, np.uint8, offset=8), count=n).astype(bool)
    return bits[_places(ids, n)].all(1)


def _bucketed(df: DataFrame) -> DataFrame:
    return df.select("embedding_type", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket"), "id")


def _filters(ids: DataFrame) -> DataFrame:
    """A row for each bucket: the filter of its ids."""

    def make(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"embedding_type": g.embedding_type[:1], "bucket": g.bucket[:1], "filter": [bloom(g.id)]})

    return ids.groupBy(*_SLOT).applyInPandas(make, "embedding_type string, bucket int, filter binary")


def create(spark: SparkSession, table: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table}_ids (id string, embedding_type string, bucket int) USING parquet PARTITIONED BY (embedding_type, bucket)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table}_filters (embedding_type string, bucket int, filter binary) USING parquet")


def rebuild(spark: SparkSession, table: str) -> None:
    """The ledger made anew from the points."""
    spark.sql(f"DROP TABLE IF EXISTS {table}_ids")
    spark.sql(f"DROP TABLE IF EXISTS {table}_filters")
    create(spark, table)
    ids = materialised(_bucketed(spark.read.table(table)))
    _enter(ids, table)


def _enter(ids: DataFrame, table: str) -> None:
    ids.hint("rebalance", *_SLOT).select("id", *_SLOT).write.mode("append").insertInto(f"{table}_ids")
    _filters(ids).write.mode("append").insertInto(f"{table}_filters")


def upsert(batch: DataFrame, table: str) -> dict[str, int]:
    """Append the points whose ids are not stored; repeats inside the batch count once.

    Returns how many ids the batch had, how many of them filters may know, how many buckets were read, and what was added.
    """
    spark = batch.sparkSession
    create(spark, table)
    if spark.read.table(f"{table}_ids").count() != spark.read.table(table).count():
        rebuild(spark, table)
    filters = spark.read.table(f"{table}_filters")
    if filters.groupBy(*_SLOT).count().where(F.col("count") > SEGMENTS).limit(1).count():
        rebuild(spark, table)
        filters = spark.read.table(f"{table}_filters")
    batch = materialised(batch.dropDuplicates(["embedding_type", "id"]))
    ids = materialised(_bucketed(batch))

    def ask(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        some = np.zeros(len(own), bool)
        for f in known["filter"] if len(own) else []:
            some |= may_hold(f, own.id)
        return own[some]

    may = materialised(ids.groupBy(*_SLOT).cogroup(filters.groupBy(*_SLOT)).applyInPandas(ask, "embedding_type string, bucket int, id string"))
    slots = may.select(*_SLOT).distinct().collect()  # BUCKETS a type at most
    where = F.lit(False)
    for kind in {s[0] for s in slots}:
        where = where | ((F.col("embedding_type") == kind) & F.col("bucket").isin(sorted(s[1] for s in slots if s[0] == kind)))
    held = spark.read.table(f"{table}_ids").where(where).select(F.col("id").alias("_id"), F.col("embedding_type").alias("_t"))
    same = (F.col("id") == F.col("_id")) & (F.col("embedding_type") == F.col("_t"))
    fresh = materialised(batch.join(held, same, "left_anti"))
    fresh.select(*spark.read.table(table).columns).write.mode("append").insertInto(table)
    _enter(materialised(_bucketed(fresh)), table)
    return {"asked": ids.count(), "may": may.count(), "read": len(slots), "added": fresh.count()}
