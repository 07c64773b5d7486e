"""Filtered, boosted vector search for batches of questions over several collections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import unit
from ..sources.store import materialised
from . import blocks
from .blocks import ENTITY_FIELDS

ASKED = ("types", "chunk_types", *ENTITY_FIELDS, "answer_filter", "boost_sections")
#: What filters, boosts and ranks look at in a point.
LOOKED_AT = ("id", "embedding_type", "type", "chunk_type", "answer_types", *ENTITY_FIELDS, "boost_section")
#: Candidates of a collection, questions that are sent to all executors at most and numbers in their vectors at most; beyond
#: that, questions of a block and points of a collection's part.
TOP, SENT, SENT_NUMBERS, BLOCK, PART = 50, 500, 1 << 20, 8192, 50_000


def overlaps(a: Column, b: Column) -> Column:
    """Whether two arrays share a value; a missing array shares none."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def routed(queries: DataFrame) -> DataFrame:
    """A row for each embedding type to search: those asked for, else one for clear intents and two for others."""
    kinds = F.when(F.size("embedding_types") > 0, F.col("embedding_types")).when(F.col("confidence") > 0.7, F.array(F.lit("pubmedbert"))).otherwise(F.array(F.lit("pubmedbert"), F.lit("biobert")))
    return queries.withColumn("embedding_type", F.explode(kinds))


def boosts() -> list[tuple[str, float, Column]]:
    """(name, factor, when) of the score's boosts, in order."""
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    section = overlaps(F.concat(F.coalesce("p.answer_types", F.array().cast("array<string>")), F.array_compact(F.array("p.boost_section"))), F.col("q.boost_sections"))
    return [
        ("chunk_type", 1.2, F.coalesce(F.array_contains("q.chunk_types", F.col("p.chunk_type")), F.lit(False))),
        ("section", 1.3, section),
        *[(f"{f}_match", 1.25, overlaps(low(F.col(f"p.{f}")), low(F.col(f"q.{f}")))) for f in ENTITY_FIELDS],
        ("answer_type", 1.15, overlaps(F.col("p.answer_types"), F.col("q.answer_filter"))),
    ]


def questions(queries: DataFrame) -> DataFrame:
    """What search takes of each question, vectors of unit length; a question whose vector has none finds nothing and goes."""
    for name in ASKED:
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast("array<string>"))
    return queries.select("qid", "embedding_type", unit(F.col("vector")).alias("vector"), *ASKED).where("vector is not null")


def candidates(points: DataFrame) -> DataFrame:
    """Points with all that filters and boosts look at."""
    for name in ("answer_types", *ENTITY_FIELDS):
        if name not in points.columns:
            points = points.withColumn(name, F.lit(None).cast("array<string>"))
    for name in ("type", "chunk_type", "boost_section"):
        if name not in points.columns:
            points = points.withColumn(name, F.lit(None).cast("string"))
    return points


def best(queries: DataFrame, points: DataFrame, k: int, mode: str = "any", sent: int = SENT) -> DataFrame:
    """Each question's first k points by cosine that it may get, aliases q and p, and original_score.

    Few questions go to all executors as a matrix (their number and size are checked): a collection is not moved at all.
    More are met in blocks: each block of BLOCK questions with each part of a collection, of about PART points by a hash of
    the id. Either way a task keeps k points a question, and its memory does not grow with the collection.
    """
    spark = queries.sparkSession
    points = points.where("embedding_type is not null")
    schema = points.drop("embedding").withColumns({"original_score": F.lit(0.0), "_no": F.lit(0).cast("long")}).schema
    asked = queries.limit(sent + 1).collect()
    if len(asked) <= sent and sum(len(r["vector"]) for r in asked) <= SENT_NUMBERS:
        asked = [(*r, n) for n, r in enumerate(asked)]
        q = spark.createDataFrame(asked, queries.withColumn("_no", F.lit(0).cast("long")).schema)
        kinds = {kind: _columns([dict(zip(q.columns, r, strict=True)) for r in asked if r[1] == kind]) for kind in {r[1] for r in asked}}

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {kind: blocks.Best(rows, k, mode) for kind, rows in kinds.items()}
            for batch in batches:
                for kind, b in own.items():
                    b.feed(batch.filter(pc.equal(batch.column("embedding_type"), kind)))
            for b in own.values():
                if (hits := b.rows()) is not None:
                    yield from hits.select(schema.names).to_batches()

        found = points.where(F.col("embedding_type").isin(list(kinds))).mapInArrow(here, schema)
    else:
        q = materialised(queries.withColumn("_no", F.monotonically_increasing_id()))
        n, parts = -(-q.count() // BLOCK), max(1, -(-points.count() // PART))
        block = F.pmod(F.xxhash64("_no"), F.lit(n)).cast("int")
        left = q.withColumns({"_block": block, "_part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
        right = points.withColumns({"_part": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), "_block": F.explode(F.sequence(F.lit(0), F.lit(n - 1)))})
        key = ["embedding_type", "_block", "_part"]

        def met(some: pa.Table, own: pa.Table) -> pa.Table:
            hits = None
            if some.num_rows and own.num_rows:
                hits = blocks.best(_columns(some.to_pylist()), own.drop_columns(["_block", "_part"]).combine_chunks().to_batches(), k, mode)
            return hits.select(schema.names) if hits is not None else to_arrow_schema(schema).empty_table()

        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(met, schema)
    top = Window.partitionBy("_no", "embedding_type").orderBy(F.desc("original_score"), "id")
    p = found.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k).drop("_r")
    p = p.select(F.col("_no").alias("_n"), "original_score", *[c for c in points.columns if c != "embedding"]).alias("p")
    return (F.broadcast(q) if len(asked) <= sent else q).alias("q").join(p, F.col("q._no") == F.col("p._n"))


def _columns(rows: list[dict]) -> dict[str, list]:
    return {c: [r[c] for r in rows] for c in ("_no", "vector", *blocks.ANSWERS)}


def boosted(hit: DataFrame, payload: list[str]) -> DataFrame:
    """Scores times the boosts that apply, and the rank that they give in the collection."""
    factor = reduce(lambda a, b: a * b, [F.when(c, F.lit(f)).otherwise(1.0) for _, f, c in boosts()])
    applied = F.array_compact(F.array(*[F.when(c, n) for n, _, c in boosts()]))
    hit = hit.withColumns({"score": F.col("original_score") * factor, "boost_applied": applied})
    out = hit.select(F.col("q.qid").alias("qid"), F.col("q._no").alias("_no"), "original_score", "score", "boost_applied", *[F.col(f"p.{c}") for c in payload])
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("_no", "embedding_type").orderBy(F.desc("score"), F.desc("original_score"), "id"))).drop("_no")


def search(queries: DataFrame, points: DataFrame, k: int = TOP, mode: str = "any", sent: int = SENT) -> DataFrame:
    """qid, id, embedding_type, original_score, score, boost_applied, rank (in the collection) and payload of each hit.

    The first k by cosine are taken before boosts: boosts change the order among them and bring nothing in.
    ``queries``: qid, embedding_type, vector, and whichever filters are set (types, chunk_types, drugs, diseases,
    procedures, answer_filter, boost_sections).

    mode: ``any``: of the conditions on chunk type, entities and answer types that a question sets at least one has to hold, and
    the document type if it asks for one; ``boost_only``: the document type alone, the others only score.

    Vectors that are null, have no length or not the question's length are no hits; a question with such a vector gets
    none.  Each row of queries is a question of its own, also where a qid comes again.
    """
    points = candidates(points)
    payload = [c for c in points.columns if c != "embedding"]
    rest = [c for c in payload if c not in LOOKED_AT]
    # pairs hold what filters and boosts look at; a point's other columns are read for the hits alone
    points = points.withColumn("_row", F.xxhash64(*[c for c, t in points.dtypes if c in payload and "map<" not in t]))
    hit = boosted(best(questions(queries), points.select(*LOOKED_AT, "embedding", "_row"), k, mode, sent), [*LOOKED_AT, "_row"])
    if rest:
        hit = materialised(hit)
        one = hit.select(F.col("id").alias("_id"), F.col("embedding_type").alias("_type"), F.col("_row").alias("_own")).distinct()
        # k rows a question at most: small where the questions were few
        same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("embedding_type") == F.col("_type")) & (F.col("_row") == F.col("_own"))
        found = points.select("id", "embedding_type", "_row", *rest).join(F.broadcast(one) if one.count() <= SENT * TOP else one, same, "left_semi").dropDuplicates(["id", "embedding_type", "_row"])
        found = found.select(F.col("id").alias("_id"), F.col("embedding_type").alias("_type"), F.col("_row").alias("_own"), *rest)
        hit = hit.join(found, same)
    return hit.select("qid", "original_score", "score", "boost_applied", *payload, "rank")


def merged(hits: DataFrame, k: int = TOP) -> DataFrame:
    """Hits of all collections of a question by score, k in all; a chunk found in two spaces stands twice."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "embedding_type", "id")
    return hits.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
