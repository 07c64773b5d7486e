"""The ledger of stored ids: batches add what is new, and read little of what is stored."""

import pandas as pd
from pyspark.sql import functions as F

from sparkquarry.sources import ledger, store


def batch(spark, ids, kind="biobert"):
    have = {f.split(" ")[0]: f.split(" ", 1)[1] for f in store.POINT.split(", ")}
    p = spark.createDataFrame([(f"id{i}", kind) for i in ids], "id string, embedding_type string")
    return p.select(*[(F.col(n) if n in p.columns else F.lit(None)).cast(t).alias(n) for n, t in have.items()])


def test_filters():
    some, other = pd.Series([f"a{i}" for i in range(5000)]), pd.Series([f"b{i}" for i in range(5000)])
    f = ledger.bloom(some)
    assert ledger.may_hold(f, some).all() and ledger.may_hold(f, other).mean() < 0.02


def test_batches_add_what_is_new(spark, monkeypatch):
    for t in ("led", "led_ids", "led_filters"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    store.create(spark, "led")
    first = ledger.upsert(batch(spark, [*range(3000), 5, 5]), "led")
    assert first == {"asked": 3000, "may": 0, "read": 0, "added": 3000}
    new = ledger.upsert(batch(spark, range(3000, 3060)), "led")
    assert new["added"] == 60 and new["read"] < 10
    mixed = ledger.upsert(batch(spark, [*range(10), *range(4000, 4010)]), "led")
    assert mixed["added"] == 10 and mixed["read"] <= 20
    # the same id of another type is another point
    assert ledger.upsert(batch(spark, range(50), "openai"), "led")["added"] == 50
    assert ledger.upsert(batch(spark, []), "led")["added"] == 0
    # a batch that was cut short after its points
    batch(spark, [9000, 9001]).write.insertInto("led")
    assert ledger.upsert(batch(spark, [9000, 9001, 9002]), "led")["added"] == 1
    monkeypatch.setattr(ledger, "SEGMENTS", 1)
    assert ledger.upsert(batch(spark, [9002, 9003]), "led")["added"] == 1
    t = spark.read.table("led")
    assert t.count() == t.dropDuplicates(["id", "embedding_type"]).count() == spark.read.table("led_ids").count() == 3124
    assert spark.read.table("led_filters").count() <= 2 * ledger.BUCKETS + 2
