"""A coarse index of the collections: points stored by nearest centroid, searched cell by cell.

Each embedding type's unit vectors are clustered by angle on a sample of at most SAMPLE vectors of each cluster, picked by
a hash of the id, CENTROIDS clusters at most; every point is then stored under its nearest centroid, with its angle to it,
in Parquet partitioned by embedding type and centroid, and inside a file by angle.  Points without a usable vector, or
of a length that is not their type's commonest, are stored under centroid -1 and are never hits.

A question's first cells, by angle, give it k points and so the smallest cosine that still counts.  No point of a cell is
nearer to the question than the question's angle to the centroid less the cell's radius, so cells beyond that angle hold
no hit, nor do points whose own angle to the centroid differs too much from the question's.  ``exact`` goes on to all
cells and points that these bounds leave; without it the first cells are all that is read.  How many these are, a type's
own points say when the index is built: AUDITED of them are asked for their nearest others, exactly, and the first cells
are as many as hold RECALL of those.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import unit
from ..sources.store import materialised
from . import search as flat

#: Clusters at most, sample vectors of each, rounds of clustering; points that are asked for their neighbours, how many of
#: these, and which share of them the first cells are to hold; cells read first until that is known.
CENTROIDS, SAMPLE, ROUNDS, AUDITED, NEIGHBOURS, RECALL, LEAST = 1024, 64, 12, 200, 10, 0.95, 4
#: Radians by which bounds give way, for what arc cosines round off.
SLACK = 1e-6


def fitted(points: DataFrame, kind: str, k: int | None = None) -> np.ndarray:
    """Unit centroids of an embedding type: about the square root of the number of points, CENTROIDS at most."""
    own = points.where(F.col("embedding_type") == kind).select("id", unit(F.col("embedding")).alias("unit")).where("unit is not null")
    lengths = own.groupBy(F.size("unit").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return np.zeros((0, 0))
    own = own.where(F.size("unit") == lengths[0][0])
    k = k or min(CENTROIDS, max(2, round(lengths[0][1] ** 0.5)))
    # a bounded number of rows
    sample = materialised(own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * k).select("unit"))
    if k < 2 or sample.select("unit").distinct().limit(2).count() < 2:
        return np.array([r[0] for r in sample.limit(1).collect()])
    model = KMeans(k=k, seed=1, maxIter=ROUNDS, distanceMeasure="cosine", featuresCol="v", initMode="random").fit(sample.select(array_to_vector("unit").alias("v")))
    c = np.array([np.asarray(x) for x in model.clusterCenters()])
    return c / np.linalg.norm(c, axis=1, keepdims=True)


def nearest(centroids: dict[str, np.ndarray]):
    """A function of (embedding, embedding type) columns: the nearest centroid and the angle to it; null for odd vectors."""

    @F.pandas_udf("struct<centroid:int,angle:double>")
    def run(embedding: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"centroid": pd.array([-1] * len(embedding), "int32"), "angle": np.nan})
        for name, own in centroids.items():
            rows = np.array([i for i, (e, k) in enumerate(zip(embedding, kind, strict=True)) if k == name and e is not None and len(e) == own.shape[1]], int)
            if len(rows):
                m = np.stack([embedding.iloc[i] for i in rows]).astype(float)
                with np.errstate(all="ignore"):
                    cosine = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ own.T
                good = np.isfinite(cosine).all(1)
                best = cosine[good].argmax(1)
                out.loc[rows[good], "centroid"] = best.astype(np.int32)
                out.loc[rows[good], "angle"] = np.arccos(np.clip(cosine[good][np.arange(len(best)), best], -1, 1))
        return out

    return run


def build(points: DataFrame, path: str, k: int | None = None) -> None:
    """Write the points below ``path``/points and a row for each cell below ``path``/cells."""
    spark = points.sparkSession
    kinds = sorted(r[0] for r in points.where("embedding_type is not null").select("embedding_type").distinct().collect())
    centroids = {kind: c for kind in kinds if len(c := fitted(points, kind, k))}
    p = points.withColumn("_near", nearest(centroids)(F.col("embedding"), F.col("embedding_type")))
    p = p.select(*points.columns, F.coalesce("_near.centroid", F.lit(-1)).alias("centroid"), F.when(F.col("_near.centroid") >= 0, F.col("_near.angle")).alias("angle"))
    # large cells take several tasks, small ones share one
    p = p.hint("rebalance", "embedding_type", "centroid").sortWithinPartitions("embedding_type", "centroid", "angle").write
    # a table without partitions has no files, and so no columns
    (p.partitionBy("embedding_type", "centroid") if kinds else p).parquet(f"{path}/points")
    rows = [(kind, n, v.tolist()) for kind, own in centroids.items() for n, v in enumerate(own)]
    cells = spark.createDataFrame(rows, "embedding_type string, centroid int, vector array<double>")
    found = stored(spark, path).where("centroid >= 0").groupBy("embedding_type", "centroid").agg(F.max("angle").alias("radius"), F.count("*").alias("points"))
    cells.join(found, ["embedding_type", "centroid"]).write.parquet(f"{path}/cells")
    _audit(spark, path, list(centroids)).write.parquet(f"{path}/probes")


def _audit(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """embedding_type, probes: how many first cells hold RECALL of the neighbours of AUDITED points."""
    asked = [stored(spark, path).where((F.col("embedding_type") == kind) & (F.col("centroid") >= 0)).orderBy(F.xxhash64(F.lit("audit"), "id"), "id").limit(AUDITED).select(F.col("id").alias("qid"), "embedding_type", F.col("embedding").alias("vector")) for kind in kinds]
    if not asked:
        return spark.createDataFrame([], "embedding_type string, probes int")
    hit = _hits(reduce(DataFrame.unionByName, asked), path, NEIGHBOURS + 1, "boost_only", True, LEAST).where(~F.col("q.qid").eqNullSafe(F.col("p.id")))
    return hit.groupBy("q.embedding_type").agg(F.ceil(F.percentile("q.at", F.lit(RECALL))).cast("int").alias("probes"))


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/points")


class _Cells:
    """The cells of all types: numbers, unit centroids and radii; and which of them a question probes: the first ones by angle,
    or, once it has a reach, those beyond them that may hold points within it."""

    def __init__(self, rows: list, probes: dict[str, int], default: int):
        self.of = {}
        for kind in sorted({r["embedding_type"] for r in rows}):
            own = [r for r in rows if r["embedding_type"] == kind]
            self.of[kind] = tuple(np.array([r[x] for r in own]) for x in ("centroid", "vector", "radius", "points"))
        self.probes, self.default = probes, default

    def chosen(self, kind: str, vectors, reach) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Angles, places by angle and choice, a row a question and a column a cell. The angles are summed row by row, so that
        they are the same wherever they are asked for."""
        numbers, own, radius, _ = self.of.get(kind, (np.zeros(0, int), np.zeros((0, 0)), np.zeros(0), None))
        angle = np.full((len(vectors), len(numbers)), np.inf)
        for i, v in enumerate(vectors):
            if len(numbers) and own.shape[1] == len(v):
                angle[i] = np.arccos(np.clip((own * np.asarray(v, float)).sum(1), -1, 1))
        at = np.empty(angle.shape, np.int32)
        np.put_along_axis(at, np.argsort(angle, axis=1, kind="stable"), np.arange(angle.shape[1], dtype=np.int32)[None], axis=1)
        first = at < self.probes.get(kind, self.default)
        far = np.array([r is not None and r == r for r in reach], bool)
        r = np.array([0.0 if not f else x for f, x in zip(far, reach, strict=True)])
        beyond = ~first & (np.maximum(0.0, angle - radius) <= r[:, None])
        return angle, at, np.where(far[:, None], beyond, first) & np.isfinite(angle)

    def parts(self, wanted: dict[str, set[int]]) -> list[tuple[str, int, int, int]]:
        """(type, cell, part, pieces): small cells share a part of some PART points, larger ones take a part for each piece."""
        out = []
        for kind, some in wanted.items():
            part, filled = 0, 0
            for number, n in zip(self.of[kind][0], self.of[kind][3], strict=True):
                if number in some:
                    pieces = max(1, -(-int(n) // flat.PART))
                    if filled and filled + n > flat.PART:
                        part, filled = part + 1, 0
                    out.append((kind, int(number), part, pieces))
                    part, filled = (part + pieces, 0) if pieces > 1 else (part, filled + n)
        return out


def _first(q: DataFrame, points: DataFrame, mode: str, k: int, cells: _Cells) -> DataFrame:
    """The first k points of the cells that questions probe, structs q and p. Only those cells' files are read: their numbers,
    CENTROIDS a type at most, are in the scan's filter. Each block of questions meets each part of the cells once."""

    @F.pandas_udf("array<int>")
    def probed(vector: pd.Series, kind: pd.Series, reach: pd.Series) -> pd.Series:
        return pd.Series([cells.of[k_][0][cells.chosen(k_, [v], [r])[2][0]].astype(np.int32) if k_ in cells.of else [] for v, k_, r in zip(vector, kind, reach, strict=True)], index=vector.index)

    spark, columns = q.sparkSession, points.columns
    wanted = {kind: set(numbers) for kind, numbers in q.select("embedding_type", F.explode(probed("vector", "embedding_type", "reach")).alias("c")).groupBy("embedding_type").agg(F.collect_set("c")).collect()}
    where = F.lit(False)
    for kind, numbers in wanted.items():
        where = where | ((F.col("embedding_type") == kind) & F.col("centroid").isin(sorted(numbers)))
    parts = cells.parts(wanted)
    most = {kind: max(part + pieces for k_, _, part, pieces in parts if k_ == kind) for kind in wanted}
    n = max(1, -(-q.count() // flat.BLOCK))
    # a row a cell, CENTROIDS a type at most
    place = F.broadcast(spark.createDataFrame(parts, "_k string, _c int, _at int, _pieces int"))
    right = points.where(where).join(place, (F.col("embedding_type") == F.col("_k")) & (F.col("centroid") == F.col("_c")))
    right = right.select(*columns, (F.col("_at") + F.pmod(F.xxhash64("id"), F.col("_pieces"))).cast("int").alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_block"))
    last = F.coalesce(*[F.when(F.col("embedding_type") == kind, m - 1) for kind, m in most.items()], F.lit(None).cast("int"))
    left = q.withColumn("_block", F.pmod(F.xxhash64("_no"), F.lit(n)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), last)))
    schema = points.drop("embedding").withColumns({"original_score": F.lit(0.0), "_no": F.lit(0).cast("long"), "at": F.lit(0)}).schema

    def met(some: pa.Table, own: pa.Table) -> pa.Table:
        hits = None
        if some.num_rows and own.num_rows:
            asked = flat._columns(some.to_pylist())
            kind, reach, last = some["embedding_type"][0].as_py(), some["reach"].to_pylist(), some["last"].to_pylist()
            angle, at, chosen = cells.chosen(kind, asked["vector"], reach)
            r = np.array([np.inf if x is None else x for x in reach])
            b = flat.blocks.Best(asked, k, mode)
            # what questions have found so far bounds what they still look for
            b.bound = np.array([-2.0 if x is None else x for x in last])
            own = own.drop_columns(["_part", "_block"]).sort_by([("centroid", "ascending"), ("angle", "ascending")]).combine_chunks()
            of = own["centroid"].to_numpy()
            turned = own["angle"].to_numpy()
            edges = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            for begin, end in zip(edges, np.append(edges[1:], len(of)), strict=True):
                c = int(np.searchsorted(cells.of[kind][0], of[begin]))
                i = np.flatnonzero(chosen[:, c])
                if len(i):
                    # points that no question reaches go here; which of the others a question does not reach, its bound says
                    near = begin + np.searchsorted(turned[begin:end], (angle[i, c] - r[i]).min())
                    far = begin + np.searchsorted(turned[begin:end], (angle[i, c] + r[i]).max(), "right")
                    if near < far:
                        b.feed(own.slice(near, far - near).to_batches()[0], chosen[:, c])
            hits = b.rows()
            if hits is not None:
                no = np.array(asked["_no"])
                order = np.argsort(no)
                i = order[np.searchsorted(no[order], hits["_no"].to_numpy())]
                hits = hits.append_column("at", pa.array((at[i, np.searchsorted(cells.of[kind][0], hits["centroid"].to_numpy())] + 1).astype(np.int32)))
        return hits.select(schema.names) if hits is not None else to_arrow_schema(schema).empty_table()

    key = ["embedding_type", "_block", "_part"]
    top = Window.partitionBy("_no", "embedding_type").orderBy(F.desc("original_score"), "id")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(met, schema).withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k)
    found = found.select(F.col("_no").alias("_n"), "at", "original_score", F.struct(*[c for c in columns if c != "embedding"]).alias("p"))
    return q.join(found, F.col("_no") == F.col("_n")).select(F.struct("qid", "_no", "embedding_type", "at", *flat.ASKED).alias("q"), "p", "original_score")


def _hits(queries: DataFrame, path: str, k: int, mode: str, exact: bool, probes: int | None) -> DataFrame:
    """The first k points of each question, structs q and p; q.at is the place of the point's cell among the question's."""
    spark = queries.sparkSession
    own = {} if probes is not None else dict(map(tuple, spark.read.parquet(f"{path}/probes").collect()))  # a row a type
    # CENTROIDS a type at most
    cells = _Cells(spark.read.parquet(f"{path}/cells").orderBy("embedding_type", "centroid").collect(), own, probes or LEAST)
    q = materialised(flat.questions(queries).where(F.col("embedding_type").isin(list(cells.of))).withColumn("_no", F.monotonically_increasing_id()))
    points = flat.candidates(stored(spark, path))
    nothing = F.lit(None).cast("double")
    hit = _first(q.withColumns({"last": nothing, "reach": nothing}), points, mode, k, cells)
    if exact:
        hit = materialised(hit)
        last = hit.groupBy(F.col("q._no").alias("_n")).agg(F.when(F.count("*") >= k, F.min("original_score")).alias("last"))
        # with fewer than k hits so far, every cell may hold one
        reach = F.when(F.col("last").isNull(), float(np.pi)).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("last"))))) + SLACK
        far = materialised(q.join(last, F.col("_no") == F.col("_n"), "left").select(*q.columns, "last", reach.alias("reach")))
        top = Window.partitionBy("q._no", "q.embedding_type").orderBy(F.desc("original_score"), "p.id")
        hit = hit.unionByName(_first(far, points, mode, k, cells)).withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k)
    return hit


def search(queries: DataFrame, path: str, k: int = flat.TOP, mode: str = "any", exact: bool = True, probes: int | None = None) -> DataFrame:
    """The hits of ``operators.search.search`` over the points stored below ``path``: all of them, or those of the first cells.

    probes: cells read first, by default as many as the index was built with.
    """
    payload = [c for c in flat.candidates(stored(queries.sparkSession, path)).columns if c not in ("embedding", "angle", "centroid")]
    return flat.boosted(_hits(queries, path, k, mode, exact, probes), payload)


def recall(queries: DataFrame, path: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """qid, k (hits that there are) and found (of these, how many the first cells hold)."""
    every = search(queries, path, k, "boost_only").select("qid", "id")
    some = search(queries, path, k, "boost_only", False, probes).select("qid", "id").withColumn("_found", F.lit(1))
    return every.join(some, ["qid", "id"], "left").groupBy("qid").agg(F.count("*").alias("k"), F.count("_found").alias("found"))
