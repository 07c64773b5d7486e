"""Shared folder, written tables, prefix sums and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, below ``spark.checkpoint.dir``.

    Only a local master may do without that setting: there one machine holds everything.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkquarry-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df from a table in the shared folder: lineage ends here, lost executors cost nothing before it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bucket(column: str | Column, buckets: int) -> Column:
    """A bucket of 0 to buckets-1 for an integer id, in plain arithmetic that any SQL engine repeats."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.pmod(F.pmod(c, F.lit(2147483647)) * 48271, F.lit(2147483647)) % buckets, F.lit(0))


def running_start(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same keys that come before, by (bucket, order).

    Two levels, so that no task sorts a whole key: sums inside a bucket, then over the few bucket totals.
    """
    df = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_total"))
    outer = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_kb"), F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_before"))
    same = F.col("_bucket") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(totals, same)
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_inside", "_before", "_kb", *[f"_k{i}" for i in range(len(keys))])
    )


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that links reach, for all nodes of ``edges`` (a, b).

    Alternates large stars and small stars (Kiveris et al. 2014): each step is a grouped minimum and a join on
    the node, edges stay linear in number, and each round is a written table.  It ends when all that is left are stars.
    """
    now = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    for _ in range(rounds):
        if _stars(now):
            break
        both = now.union(now.select("lo", "hi"))
        least = both.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("lo > hi").join(least, both.hi == least.n).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        large = written(large)
        small = large.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("m"))
        now = written(
            large.join(small, large.hi == small.n)
            .select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
    else:
        if not _stars(now):
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.union(nodes.select(F.col("component"), F.col("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node of (hi, lo) is either a centre or tied to one centre only."""
    ends = edges.select(F.col("hi").alias("n"), "lo").union(edges.select("lo", F.lit(None).cast("long")))
    odd = ends.groupBy("n").agg(F.min("lo").alias("m"), F.max("lo").alias("x"), F.count("lo").alias("up"), F.count("*").alias("all"))
    return odd.where("up > 0 and (m <> x or up < all)").limit(1).count() == 0


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: others, whatever they are called, take no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def bounded(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in slices that hold about ``size`` bytes of a column each, so that a task's memory does not depend on the batches."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = (np.flatnonzero(np.diff(ends // size)) + 1).tolist()
        for begin, end in zip([0, *cuts], [*cuts, len(b)], strict=True):
            yield b.slice(begin, end - begin)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch for each run of rows with equal integer keys; the rows come sorted by them."""
    rest = None
    for b in batches:
        if rest is not None:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        if not len(b):
            continue
        marks = np.stack([b.column(c).to_numpy().astype(np.int64) for c in keys])
        starts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist()]
        for begin, end in zip(starts[:-1], starts[1:], strict=True):
            yield b.slice(begin, end - begin)
        rest = b.slice(starts[-1])
    if rest is not None and len(rest):
        yield rest
