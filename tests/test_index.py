"""Searches with and without the centroid index, and vectors that cannot be compared."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquarry.operators import centroids, search

POINT = "id string, embedding array<double>, embedding_type string, type string, answer_types array<string>"


def vectors(spark, n=600, seed=1):
    r = np.random.default_rng(seed)
    middle = r.standard_normal((6, 12))
    rows = [(f"{i:04}", (middle[i % 6] + r.standard_normal(12) * 0.4).tolist(), "biobert" if i % 5 == 0 else "pubmedbert", "FAQ" if i % 3 else "POLICY", ["dosage"] if i % 4 else None) for i in range(n)]
    # copies, and vectors that nothing can be compared with
    rows += [(f"c{i}", rows[7][1], "pubmedbert", "FAQ", None) for i in range(30)]
    rows += [("z0", [0.0] * 12, "pubmedbert", "FAQ", None), ("z1", None, "pubmedbert", "FAQ", None), ("z2", [1.0] * 5, "pubmedbert", "FAQ", None), ("z3", [float("nan")] * 12, "pubmedbert", "FAQ", None), ("z4", [1.0] * 12, None, "FAQ", None)]
    return rows


def asked(spark, rows, kinds=("pubmedbert", "biobert")):
    q = [(i, rows[i * 13][1], k, ["FAQ"] if i % 2 else None, ["dosage"] if i % 3 else None) for i in range(12) for k in kinds]
    q += [(100, None, "pubmedbert", None, None), (101, [0.0] * 12, "pubmedbert", None, None), (102, [1.0] * 12, "scibert", None, None)]
    return spark.createDataFrame(q, "qid long, vector array<double>, embedding_type string, types array<string>, answer_filter array<string>")


def brute(q, rows, k):
    out = set()
    for r in q.collect():
        near = []
        for i, v, kind, type_, answers in rows:
            if kind == r.embedding_type and v and r.vector and len(v) == len(r.vector) and np.isfinite(v).all() and np.linalg.norm(v) * np.linalg.norm(r.vector) > 0:
                if (not r.types or type_ in r.types) and (not r.answer_filter or set(answers or []) & set(r.answer_filter)):
                    near.append((-round(float(np.dot(v, r.vector) / np.linalg.norm(v) / np.linalg.norm(r.vector)), 9), i))
        out |= {(r.qid, r.embedding_type, i, n + 1) for n, (_, i) in enumerate(sorted(near)[:k])}
    return out


def hits(df):
    return {(r.qid, r.embedding_type, r.id) for r in df.select("qid", "embedding_type", "id").collect()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = vectors(spark)
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    centroids.build(spark.createDataFrame(rows, POINT), path)
    return rows, path


def test_plain_search_by_brute_force(spark):
    rows = vectors(spark)
    q, p = asked(spark, rows), spark.createDataFrame(rows, POINT)
    want = {x[:3] for x in brute(q, rows, 7)}
    assert hits(search.search(q, p, 7)) == hits(search.search(q, p, 7, sent=0)) == want
    assert search.search(q, p, 7).where("original_score is null").count() == 0
    # a question that is asked twice is answered twice
    one = q.where("qid = 1 and embedding_type = 'biobert'")
    assert search.search(one.union(one), p, 7).count() == 2 * search.search(one, p, 7).count() == 14
    # questions of two lengths in one type meet points of their own
    two = one.union(one.withColumn("vector", F.array(*[F.lit(1.0)] * 5)).withColumn("embedding_type", F.lit("biobert")))
    assert search.search(two, p, 7).count() == 7


def test_exact_mode_is_the_plain_search(spark, index):
    rows, path = index
    q, p = asked(spark, rows), spark.createDataFrame(rows, POINT)
    for k, mode, probes in ((7, "any", None), (7, "any", 1), (3, "boost_only", 1), (400, "any", 2)):
        a = centroids.search(q, path, k, mode, probes=probes).select("qid", "embedding_type", "id", "rank", F.round("score", 9).alias("score"))
        b = search.search(q, p, k, mode).select("qid", "embedding_type", "id", "rank", F.round("score", 9).alias("score"))
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 < b.count(), (k, mode, probes)


def test_first_cells_hold_most(spark, index):
    rows, path = index
    q = asked(spark, rows, ("pubmedbert",)).where("qid < 100").drop("types", "answer_filter")
    r = centroids.recall(q, path, 10).collect()
    assert len(r) == 12 and sum(x.found for x in r) >= 0.9 * sum(x.k for x in r)
    assert centroids.stored(spark, path).count() == len(rows) and centroids.stored(spark, path).where("centroid < 0").count() == 5
    c = spark.read.parquet(f"{path}/cells").agg(F.sum("points"), F.max("radius")).first()
    assert c[0] == len(rows) - 5 and 0 < c[1] < np.pi


def test_far_cells_are_not_read(spark, tmp_path):
    rows = vectors(spark)
    path = f"file://{tmp_path}/i"
    centroids.build(spark.createDataFrame(rows, POINT), path)
    q = asked(spark, rows, ("pubmedbert",)).where("qid = 3").drop("types", "answer_filter")
    want = hits(centroids.search(q, path, 3, exact=False, probes=1))
    files = glob.glob(f"{tmp_path}/i/points/embedding_type=pubmedbert/*/*.parquet")
    mine = centroids._hits(q, path, 3, "any", False, 1).select("p.centroid").first()[0]
    spoilt = [f for f in files if f"centroid={mine}/" not in f]
    for f in spoilt:
        open(f, "wb").write(b"not a Parquet file")
    spark.catalog.clearCache()
    assert len(spoilt) > len(files) / 2 and hits(centroids.search(q, path, 3, exact=False, probes=1)) == want


def test_small_tables(spark, tmp_path):
    for n, name in ((0, "none"), (1, "one"), (2, "two")):
        rows = [(random.Random(i).random(), [1.0, float(i)]) for i in range(n)]
        p = spark.createDataFrame([(str(a), v, "biobert", "FAQ", None) for a, v in rows], POINT)
        centroids.build(p, f"file://{tmp_path}/{name}")
        q = spark.createDataFrame([(1, [1.0, 0.0], "biobert")], "qid long, vector array<double>, embedding_type string")
        assert centroids.search(q, f"file://{tmp_path}/{name}", 5).count() == n


def test_blocks_of_questions_meet_parts(spark, index, monkeypatch):
    """Many questions and points go to tasks in blocks and parts; a task hands on k points a question, not pairs."""
    rows, path = index
    q, p = asked(spark, rows), spark.createDataFrame(rows, POINT)
    want = {x[:3] for x in brute(q, rows, 7)}
    monkeypatch.setattr(search, "BLOCK", 5)
    monkeypatch.setattr(search, "PART", 50)
    assert hits(search.search(q, p, 7, sent=0)) == want
    assert hits(centroids.search(q, path, 7, probes=1)) == want


def test_a_block_of_products_keeps_few(monkeypatch):
    import pyarrow as pa

    from sparkquarry.operators import blocks

    monkeypatch.setattr(blocks, "NUMBERS", 64)
    monkeypatch.setattr(blocks, "PAIRS", 3)
    v = [[1.0, 0.0]] * 40 + [[0.0, 1.0]] * 3 + [[1.0, float("nan")], None, [1.0, None], [0.0, 0.0]]
    batch = pa.record_batch({"id": pa.array([f"{len(v) - i:03}" for i in range(len(v))]), "embedding": pa.array(v, pa.list_(pa.float32())), "type": pa.array(["a", None] * 23 + ["a"])})
    t = blocks.best({"_no": [4, 9], "vector": [[1.0, 0.0], [0.0, 1.0]], "types": [None, ["a", None]], **{f: [None, None] for f in blocks.ANSWERS if f != "types"}}, [batch], 3, "any")
    assert t.num_rows == 6 and [r for r in zip(t["_no"].to_pylist(), t["id"].to_pylist()) if r[0] == 4] == [(4, "008"), (4, "009"), (4, "010")]
    assert {r[1] for r in zip(t["_no"].to_pylist(), t["id"].to_pylist()) if r[0] == 9} == {"005", "007", "009"}
