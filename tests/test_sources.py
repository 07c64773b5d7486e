"""The document source, streams without repeats, resumed backfills, and pair scorers."""

import glob
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from sparkquarry.operators import rerank
from sparkquarry.plans import backfill
from sparkquarry.sources import parsed, store
from sparkquarry.sources.documents import PARSED


def files(folder, n=300):
    lines = [json.dumps({"job_id": f"d{i}", "pages": [{"page": 1, "text": "tëxt " * (i % 40)}]}, ensure_ascii=False) for i in range(n)]
    lines[5], lines[6], lines[7], lines[8] = "{broken", "[1]", '{"pages": []}', ""
    os.makedirs(f"{folder}/sub", exist_ok=True)
    with open(f"{folder}/a.json", "w", encoding="utf-8") as f:
        f.write("\n".join(lines[:100]))
    with open(f"{folder}/sub/b.json", "w", encoding="utf-8") as f:
        f.write("\r\n".join(lines[100:200]) + "\n")
    with gzip.open(f"{folder}/c.json.gz", "wt", encoding="utf-8") as f:
        f.write("\n".join(lines[200:]))
    open(f"{folder}/_SUCCESS", "w").close()
    open(f"{folder}/d.json", "wb").write(b"\xff\xfe\n")
    return lines


@pytest.mark.parametrize("size", [701, 3000, 1 << 20])
def test_ranges_hold_each_line_once(spark, tmp_path, size):
    lines = files(tmp_path)
    rows = parsed.read(spark, str(tmp_path), range_bytes=size).collect()
    assert {r.job_id for r in rows if r.rejected is None} == {f"d{i}" for i in range(300)} - {"d5", "d6", "d7", "d8"} and len(rows) == 300
    assert sorted(r.rejected for r in rows if r.rejected) == ["no JSON", "no UTF-8", "no job_id", "no object"]
    for r in rows:
        if not r.file.endswith(".gz") and r.rejected is None:
            with open(r.file, "rb") as f:
                f.seek(r.at)
                assert f.readline().decode().strip() == r.document
    good, bad = parsed.documents(parsed.read(spark, f"file://{tmp_path}", range_bytes=size), PARSED)
    assert good.count() == 296 and bad.count() == 4 and good.where("job_id = 'd39'").first().pages[0].text == "tëxt " * 39
    assert len(lines) == 300


def test_parsers_and_empty_folders(spark, tmp_path):
    os.makedirs(f"{tmp_path}/none")
    assert parsed.read(spark, f"{tmp_path}/none").count() == 0
    with open(f"{tmp_path}/x.txt", "w") as f:
        f.write("a\tone\nb\t\n")
    rows = parsed.read(spark, f"{tmp_path}/x.txt", parser="sparkquarry.sources.parsed:tabbed").collect()
    assert [(r.job_id, r.rejected) for r in rows] == [("a", None), (None, "no text")] and json.loads(rows[0].document)["pages"][0]["text"] == "one"


def test_stream_of_the_source_equals_its_batch(spark, tmp_path):
    files(f"{tmp_path}/in")
    stream = parsed.read(spark, f"{tmp_path}/in", stream=True, range_bytes=4000)
    run = lambda: stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    run()
    with open(f"{tmp_path}/in/later.json", "w") as f:
        f.write('{"job_id": "late"}\n')
    run()
    run()
    a, b = spark.read.parquet(f"{tmp_path}/out"), parsed.read(spark, f"{tmp_path}/in")
    assert a.count() == b.count() == 301 and a.exceptAll(b).count() == 0


def table(spark, name):
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"DROP TABLE IF EXISTS {name}_done")
    store.create(spark, name)
    have = {f.split(" ")[0]: f.split(" ", 1)[1] for f in store.POINT.split(", ")}
    rows = [(f"{k}{i}", "aspirin for asthma" if i % 2 else None, k, ["x"] if k == "scibert" else None) for k in ("biobert", "openai", "pubmedbert", "scibert") for i in range(4)]
    p = spark.createDataFrame([*rows, rows[0]], "id string, text string, embedding_type string, answer_types array<string>").withColumns({"medical_entities": F.col("answer_types"), "entity_types": F.col("answer_types")})
    p.select(*[(F.col(n) if n in p.columns else F.lit(None)).cast(t).alias(n) for n, t in have.items()]).write.insertInto(name)
    return name


def state(spark, name):
    return sorted(map(str, spark.read.table(name).collect()))


def test_a_killed_backfill_goes_on(spark, monkeypatch):
    whole, cut = table(spark, "whole_points"), table(spark, "cut_points")
    assert backfill.resumed(spark, whole, "whole_points_done") == 13
    assert backfill.resumed(spark, cut, "cut_points_done", limit=1) == 5
    place = spark.sql("DESCRIBE FORMATTED cut_points").where("col_name = 'Location'").first().data_type.removeprefix("file:")
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{place}/*/*.parquet")}
    real = backfill.materialised

    def killed(df):
        monkeypatch.setattr(backfill, "materialised", real)
        raise KeyboardInterrupt

    monkeypatch.setattr(backfill, "materialised", killed)
    with pytest.raises(KeyboardInterrupt):
        backfill.resumed(spark, cut, "cut_points_done")
    assert backfill.resumed(spark, cut, "cut_points_done") == 8
    assert state(spark, cut) == state(spark, whole) and len(state(spark, cut)) == 17
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{place}/*/*.parquet")}
    for kind, same in (("scibert", True), ("biobert", True), ("openai", False)):
        assert ({k: v for k, v in before.items() if f"={kind}/" in k} == {k: v for k, v in after.items() if f"={kind}/" in k}) is same
    assert backfill.resumed(spark, cut, "cut_points_done") == 0


def test_repeats_inside_a_stream_stay_out(spark):
    from sparkquarry.streaming import replay

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25)  # a small stream is enough here
    one, two = replay.replayed(spark, docs).first(), replay.replayed_twice(spark, docs).first()
    assert (two.points, two.documents, two.passed) == (one.points, one.documents, 25)


def test_pair_scorers(spark):
    rows = [(q, f"{q}{i}", f"text {'x ' * (i * 7 % 50)}", i, f"question {q}") for q in (1, 2, 3) for i in range(70)] + [(4, "a", None, 1, None)]
    c = spark.createDataFrame(rows, "qid long, id string, text string, position int, rerank_query string")

    def by_length():
        def score(pairs):
            assert len(pairs) <= rerank.BATCH and all(isinstance(t, str) for p in pairs for t in p)
            if any("2" in q for q, _ in pairs):
                raise RuntimeError("out of memory")
            return [len(t) for _, t in pairs]

        return score

    one = c.where("qid <> 2")
    got = rerank.reranked(one, rerank.pairwise(by_length), 10).collect()
    assert len(got) == 21 and [r.id for r in sorted((r for r in got if r.qid == 1), key=lambda r: r.rerank_position)] == [f"1{i}" for i in sorted(range(70), key=lambda i: (-(i * 7 % 50), i))[:10]]
    # all of a question's candidates keep their order where one pair has no score
    failed = rerank.reranked(c.where("qid = 2"), rerank.pairwise(by_length), 10).collect()
    assert [(r.position, r.rerank_score) for r in sorted(failed, key=lambda r: r.rerank_position)] == [(i, None) for i in range(70)]

    def missing():
        raise OSError("no such model")

    assert rerank.reranked(one, rerank.pairwise(missing), 10).where("rerank_position <> position and qid <> 4 and rerank_position <> position + 1").count() == 0
    assert rerank.reranked(one, rerank.pairwise(lambda: lambda pairs: [float("nan")] * len(pairs)), 10).count() == one.count()
