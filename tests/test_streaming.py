"""What ingest and its streams leave on disk, and that batches and upserts lose nothing by it."""

import os

from pyspark.sql import functions as F

from sparkquarry.sources import store
from sparkquarry.streaming import ingest, replay


def there(spark):
    """Folders that were made beside the tables."""
    return {d for c in ("spark.checkpoint.dir", "spark.sql.warehouse.dir") for d in os.listdir(spark.conf.get(c).removeprefix("file:")) if not d.startswith("points_")}


def test_upsert_writes_new_ids_once_and_leaves_nothing(spark):
    have = {f.split(" ")[0]: f.split(" ", 1)[1] for f in store.POINT.split(", ")}

    def batch(*rows):
        p = spark.createDataFrame(rows, "id string, embedding_type string, text string")
        return p.select(*[(F.col(n) if n in p.columns else F.lit(None)).cast(t).alias(n) for n, t in have.items()])

    spark.sql("DROP TABLE IF EXISTS ups")
    store.create(spark, "ups")
    before = there(spark)
    store.upsert(batch(("a", "openai", "1"), ("b", "openai", "2"), ("b", "openai", "2"), ("a", "scibert", "3")), "ups")
    store.upsert(batch(("b", "openai", "x"), ("c", "openai", "4"), ("c", "openai", "4"), ("c", "scibert", "5"), ("a", "openai", "x"), ("a", "openai", "y")), "ups")
    store.upsert(batch(("c", "openai", "x")), "ups")
    got = sorted((r.id, r.embedding_type, r.text) for r in spark.read.table("ups").collect())
    assert got == [("a", "openai", "1"), ("a", "scibert", "3"), ("b", "openai", "2"), ("c", "openai", "4"), ("c", "scibert", "5")]
    assert there(spark) == before


def test_a_stream_takes_files_in_parts_and_drops_what_it_has_done(spark, monkeypatch):
    monkeypatch.setattr(ingest, "BYTES", 1)
    monkeypatch.setattr(replay, "DOCUMENTS", 7)
    places, seen = [], []
    monkeypatch.setattr(replay, "folder", lambda s, f=replay.folder: places.append(f(s)) or places[-1])
    monkeypatch.setattr(ingest, "stored", lambda b, *a, f=ingest.stored: seen.append(b.count()) or f(b, *a))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(14).coalesce(1)
    before = there(spark)
    got = replay.replayed_twice(spark, docs).first()
    # two files, and the same again, of which nothing is left; an empty batch may follow
    assert [n for n in seen if n] == [7, 7] and len(seen) >= 4
    assert (got.documents, got.passed) == (14, 14) and got.points >= 14
    assert not [d for d in there(spark) - before if d.startswith("held_")]
    left = [f for f in os.listdir(f"{places[0].removeprefix('file:')}/in") if f.startswith("part-")]
    assert len(left) < 4 and all(f.endswith(".gz") for f in left)
