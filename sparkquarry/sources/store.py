"""The collection store: a Parquet table partitioned by embedding type, with ids made of content."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import strip

KEY = ["title", "type", "date", "original_filename"]
POINT = (
    "id string, embedding array<float>, text string, page int, bbox struct<x:double,y:double,w:double,h:double>, parse_type string, page_width double, page_height double, "
    "chunk_type string, answer_types array<string>, drugs array<string>, diseases array<string>, procedures array<string>, medical_entities array<string>, entity_types array<string>, boost_section string, "
    "section_title string, section_type string, has_medical_content boolean, title string, type string, description string, date string, original_filename string, saved_file_path string, enrichment_version string, embedding_type string"
)


def folder(spark: SparkSession) -> str:
    """A new folder that the driver and the executors see: below spark.checkpoint.dir, else below the warehouse.

    Only a local master, where one machine holds everything, may do with a warehouse that is a folder of that machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local[") and base.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """The rows of df from a table in the shared folder, for plans that read them more than once."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """The rows of df from a table of the warehouse that goes afterwards, for a batch that is read more than once."""
    spark, table = df.sparkSession, f"held_{uuid.uuid4().hex}"
    df.write.format("parquet").saveAsTable(table)
    try:
        yield spark.read.table(table)
    finally:
        spark.sql(f"DROP TABLE {table} PURGE")


def collection_name(base: Column, kind: Column) -> Column:
    return F.concat_ws("_", base, kind)


def parsed_name(name: Column) -> Column:
    """(base, embedding type) of a collection's name; the type is null where the name ends in none."""
    kinds = "|".join(vocab.EMBEDDINGS)
    kind = F.nullif(F.regexp_extract(name, f"_({kinds})$", 1), F.lit(""))
    return F.struct(F.when(kind.isNull(), name).otherwise(F.regexp_replace(name, f"_({kinds})$", "")).alias("base"), kind.alias("embedding_type"))


def create(spark: SparkSession, table: str) -> None:
    """Create the collections' table if there is none."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({POINT}) USING parquet PARTITIONED BY (embedding_type)")


def collections(spark: SparkSession, table: str) -> DataFrame:
    """The embedding types that hold points, from the table's partitions."""
    return spark.sql(f"SHOW PARTITIONS {table}").select(F.regexp_extract("partition", "embedding_type=([^/]+)", 1).alias("embedding_type")).distinct()


def collection(spark: SparkSession, table: str, kind: str | None = None) -> DataFrame:
    """The points of one embedding type, or of the whole base collection; a type that has none gives no rows."""
    points = spark.read.table(table)
    return points if kind is None else points.where(F.col("embedding_type") == kind)


def known(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Those keys of stored documents that the documents have: few where most are new, whatever is stored."""
    have = stored.select(*[F.col(k).alias(f"_{k}") for k in KEY]).distinct()
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return have.join(documents.select(*KEY), same, "left_semi").toDF(*KEY)


def new_documents(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose title, type, date and file name are not stored yet; missing values equal each other."""
    have = stored.select(*KEY).distinct()
    same = F.lit(True)
    for k in KEY:
        same = same & documents[k].eqNullSafe(have[k])
    return documents.join(have, same, "left_anti")


def point_id() -> Column:
    """The same for the same chunk of the same document in the same space, so writing again adds nothing."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("")) for k in KEY], F.col("embedding_type"), F.col("chunk_no").cast("string")), 256)


def points(chunks: DataFrame) -> DataFrame:
    """Enriched, embedded chunks with their document's metadata as points; blank ones go, vectors of a wrong length are refused."""
    c = chunks.where(strip(F.coalesce("chunk", F.lit(""))) != "").withColumn("id", point_id())
    if "dimensions" in c.columns:
        c = c.withColumn("embedding", F.when(F.size("embedding") == F.col("dimensions"), F.col("embedding")).otherwise(F.raise_error(F.lit("a vector has the wrong length")).cast("array<float>"))).drop("dimensions")
    low = lambda a: F.transform(a, lambda x: F.lower(x))
    have = {f.split(" ")[0]: f.split(" ", 1)[1] for f in POINT.split(", ")}
    c = c.withColumn("text", F.col("chunk")).withColumns({n: low(n) for n in ("drugs", "diseases", "procedures") if n in c.columns})
    return c.select(*[(F.col(n) if n in c.columns else F.lit(None)).cast(t).alias(n) for n, t in have.items()])


def upsert(batch: DataFrame, table: str) -> None:
    """Append the points whose ids are not stored; repeats inside the batch count once."""
    spark = batch.sparkSession
    with held(batch) as batch:
        # a handful of embedding types: only their partitions are read
        kinds = [r[0] for r in batch.select("embedding_type").distinct().collect()]
        have = spark.read.table(table).where(F.col("embedding_type").isin(kinds)).select("embedding_type", "id", F.lit(0).alias("own"))
        ids = have.unionByName(batch.select("embedding_type", "id", F.lit(1).alias("own"))).groupBy(F.col("embedding_type").alias("_t"), F.col("id").alias("_id"))
        same = F.col("id").eqNullSafe(F.col("_id")) & F.col("embedding_type").eqNullSafe(F.col("_t"))
        # most points are new and come once: they are written where they are, and only those with others of their id meet
        with held(ids.agg(F.count("*").alias("n"), F.sum("own").alias("own")).where("own > 0 and n > 1")) as odd:
            once = batch.join(odd, same, "left_anti")
            repeats = batch.join(odd.where("n = own"), same, "left_semi").dropDuplicates(["embedding_type", "id"])
            once.unionByName(repeats).write.mode("append").insertInto(table)
