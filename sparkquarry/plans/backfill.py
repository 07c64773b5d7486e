"""Backfill: stored points get the metadata that they lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrich import backfilled
from ..sources.store import materialised


def backfill(spark: SparkSession, table: str, into: str) -> int:
    """Write the completed points of a collections' table into another, and say how many were changed.

    Vectors are read once and written as they are.
    """
    out: DataFrame = backfilled(spark.read.table(table).drop("enrichment_version"))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {into} LIKE {table}")
    out.select(*[F.col(c) for c in spark.read.table(into).columns]).write.mode("overwrite").insertInto(into)
    return spark.read.table(into).where("enrichment_version is not null").count()


def resumed(spark: SparkSession, table: str, progress: str, limit: int | None = None) -> int:
    """Complete a collections' table in place, partition by partition, and say how many rows were changed.

    ``progress`` is a table of the partitions that are done and their changed rows; a run that was killed goes on after
    them, ``limit`` partitions at most.  A partition is written to the shared folder first and then put in the old one's
    place, and a row is completed from itself, so a partition that was cut short is done again with the same outcome.
    Partitions in which nothing lacks keep their files.  Rows that stay as they are keep their version.
    """
    spark.sql(f"CREATE TABLE IF NOT EXISTS {progress} (embedding_type string, changed bigint) USING parquet")
    kinds = spark.sql(f"SHOW PARTITIONS {table}").select(F.regexp_extract("partition", "embedding_type=([^/]+)", 1).alias("k"))
    done = {r[0] for r in spark.read.table(progress).collect()}  # a row an embedding type
    changed = 0
    for kind in sorted(r[0] for r in kinds.collect() if r[0] not in done)[:limit]:
        points = spark.read.table(table).where(F.col("embedding_type") == kind)
        kept = points.withColumn("_version", F.col("enrichment_version"))
        new = backfilled(kept.drop("enrichment_version")).withColumn("enrichment_version", F.coalesce("enrichment_version", "_version")).select(*points.columns)
        # rows that a run before this one has completed as far as they go are no work
        open_ = points.where(~F.coalesce(F.col("enrichment_version") == "2.0", F.lit(False)))
        n = backfilled(open_.drop("enrichment_version")).where("enrichment_version is not null").count()
        if n:
            # the partition is named, so no other one is touched
            spark.sql(f"INSERT OVERWRITE {table} PARTITION (embedding_type = {{kind}}) SELECT * FROM {{new}}", kind=kind, new=materialised(new).drop("embedding_type"))
            spark.catalog.refreshTable(table)
        spark.createDataFrame([(kind, n)], "embedding_type string, changed bigint").write.mode("append").insertInto(progress)
        changed += n
    return changed
