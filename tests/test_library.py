"""Golden values and properties of the retrieval operators."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquarry import catalog
from sparkquarry.functions import text as tx
from sparkquarry.functions import vectors as vec
from sparkquarry.functions import vocab
from sparkquarry.operators import answer, chunking, embed, enrich, ner, query, rerank, search, sections
from sparkquarry.plans import backfill, ingest, retrieve
from sparkquarry.sources import documents as src
from sparkquarry.sources import store

BOX = {"x": 0, "y": 0, "w": 10, "h": 10}
F1 = {
    "job_id": "f1",
    "pages": [{"page": 1, "width": 612, "height": 792, "items": [
        {"type": "heading", "level": 1, "md": "Medications", "bBox": BOX},
        {"type": "text", "md": "1. Metformin 500mg PO BID for diabetes", "bBox": BOX},
        {"type": "text", "md": "2. Lisinopril 10mg PO daily for hypertension", "bBox": BOX},
        {"type": "heading", "level": 1, "md": "Lab Results", "bBox": BOX},
        {"type": "table", "md": "", "bBox": BOX, "rows": [["Test", "Result", "Range"], ["Glucose", "126", "70-100"], ["HbA1c", "7.2", "<5.7"]]},
    ], "images": [{"x": 0, "y": 0, "width": 5, "height": 5, "ocr": [{"text": "Patient ID: 12345"}, {"text": " "}, {"text": "Date: 2025-01-15"}]}]}],
}


def parsed(spark, *docs):
    return src.parsed_of(spark.createDataFrame([(json.dumps(d),) for d in docs], "json string"))


def test_section_chunks_of_a_note(spark):
    c = enrich.enriched(chunking.healthcare_chunks(parsed(spark, F1))).orderBy("chunk_no").collect()
    assert [x.chunk_type for x in c] == ["text", "list", "lab_result"]
    assert c[0].section_title == "Document Content" and c[0].chunk.endswith("Patient ID: 12345 Date: 2025-01-15")
    assert c[1].chunk == "[Section: Medications]\n\n1. Metformin 500mg PO BID for diabetes\n2. Lisinopril 10mg PO daily for hypertension"
    assert (c[1].section_type, c[1].boost_section) == ("medications", "dosage")
    assert c[1].drugs == ["lisinopril", "metformin"] and c[1].diseases == ["diabetes", "hypertension"]
    assert c[2].chunk == "[Section: Lab Results]\nTest | Result | Range\nGlucose | 126 | 70-100\nHbA1c | 7.2 | <5.7"
    assert (c[2].section_type, c[2].boost_section, c[2].procedures) == ("lab_results", None, ["test"])
    assert [x.chunk_type for x in chunking.healthcare_chunks(parsed(spark, F1), compat=True).orderBy("chunk_no").collect()] == ["list", "lab_result"]


def test_plain_chunks_of_a_note(spark):
    c = chunking.generic_chunks(parsed(spark, F1)).orderBy("chunk_no").collect()
    assert [x.chunk for x in c] == ["Patient ID: 12345 Date: 2025-01-15", F1["pages"][0]["items"][1]["md"], F1["pages"][0]["items"][2]["md"], "Test\tResult\tRange\nGlucose\t126\t70-100\nHbA1c\t7.2\t<5.7"]


def test_pages_without_items_and_without_number(spark):
    d = {"job_id": "p", "pages": [{"page": 1, "width": 5, "height": 6, "text": "page text"}, {"text": "no number"}, {"page": 2, "items": [{"type": "text", "md": "no box"}]}]}
    assert [x.chunk for x in chunking.generic_chunks(parsed(spark, d)).collect()] == ["page text"]


@pytest.mark.parametrize("n, sizes", [(0, []), (1, [1]), (512, [512]), (513, [563]), (600, [512, 138]), (2000, [512, 512, 512, 512, 152])])
def test_window_sizes(spark, n, sizes):
    words = " ".join(f"w{i}" for i in range(n))
    got = spark.createDataFrame([(words,)], "t string").select(F.explode(chunking.split_plain(F.col("t"))).alias("c")).select(tx.token_count(F.col("c")).alias("n")).collect()
    assert [g.n for g in got] == sizes


def test_long_list_is_split_not_lost(spark):
    d = {"job_id": "l", "pages": [{"page": 1, "items": [{"type": "heading", "md": "Notes"}, *[{"type": "text", "md": f"- item {i} " + "word " * 20} for i in range(30)]]}]}
    c = chunking.healthcare_chunks(parsed(spark, d)).collect()
    assert len(c) > 1 and all(x.chunk.startswith("[Section: Notes]") for x in c)
    assert {f" {i} " for i in range(30)} <= {f" {i} " for i in range(30) if any(f"item {i} " in x.chunk for x in c)}
    assert chunking.healthcare_chunks(parsed(spark, d), compat=True).count() == 0


def test_headings(spark):
    h = spark.createDataFrame([("Contraindications",), ("Adverse Reactions",), ("Special notes",)], "h string")
    got = h.select(sections.section_type(F.col("h")), sections.section_type(F.col("h"), ner=True), sections.section_type(F.col("h"), strict=True)).collect()
    assert [tuple(g) for g in got] == [("indication", "contraindications", "contraindications"), ("imaging", "adverse_reactions", "adverse_reactions"), ("physical_exam", "physical_exam", None)]


def test_intents(spark):
    want = {"metformin dosage": ("dosage", 0.5), "what is metformin": ("definition", 0.95), "lisinopril side effects": ("side_effects", 0.75), "when not to use metformin": ("contraindications", 1 / 3), "how to treat hypertension": ("treatment", 2.5 / 3), "what is the dosage of metformin?": ("definition", 2 / 3), "Can warfarin be used with aspirin?": ("general", 0.5)}
    got = query.with_intent(spark.createDataFrame([(q,) for q in want], "query string")).collect()
    assert all(g.intent == want[g.query][0] and abs(g.confidence - want[g.query][1]) < 1e-9 for g in got)


def test_question_rewriting(spark):
    want = {"tx for dm2": "treatment for diabetes mellitus type 2", "sx of mi": "symptoms of myocardial infarction", "metropolol side effects": "metoprolol side effects"}
    got = query.analysed(spark.createDataFrame([(q,) for q in want], "query string")).collect()
    assert {g.query: g.cleaned for g in got} == want
    assert {k: v for g in got for k, v in g.expansions.items()} == {"tx": "treatment", "dm2": "diabetes mellitus type 2", "sx": "symptoms", "mi": "myocardial infarction"}
    strict = spark.createDataFrame([("take 2.5 mg ,then rest.Now",)], "q string").select(tx.cleaned(F.col("q")), tx.cleaned(F.col("q"), strict=True)).first()
    assert tuple(strict) == ("take 2. 5 mg, then rest. Now", "take 2.5 mg, then rest. Now")


def test_entities_of_a_model(spark):
    d = ner.processed(ner.lexicon(spark.createDataFrame([("Patient prescribed Metformin 500 mg twice a day; history of HTN and asthma.",)], "text string")))
    e = {x.text: x for x in d.first().entities}
    assert e["Metformin"].metadata["related_dosage"] == "500 mg" and e["Metformin"].start == 19 and e["500 mg"].normalized == "500mg"
    assert e["twice a day"].normalized == "twice daily" and abs(e["asthma"].confidence - 0.99) < 1e-9
    c = ner.enriched(spark.createDataFrame([("Metformin 500 mg for diabetes", "dosage"), ("nothing", None)], "chunk string, section_type string")).collect()
    assert c[0].answer_types == ["definition", "diagnosis", "dosage"] and c[0].drugs == ["metformin"] and c[1].answer_types == ["general"] and not c[1].has_medical_entities


def points(spark):
    rows = [("a", [1.0, 0.0], "pubmedbert", ["dosage"], ["metformin"], "dosage", "FAQ"), ("b", [0.9, 0.1], "pubmedbert", ["general"], [], None, "FAQ"), ("c", [0.0, 1.0], "pubmedbert", None, None, None, "POLICY"), ("d", [1.0, 0.0], "biobert", ["dosage"], ["Metformin"], "dosage", "FAQ")]
    return spark.createDataFrame(rows, "id string, embedding array<double>, embedding_type string, answer_types array<string>, drugs array<string>, boost_section string, type string").withColumn("text", F.concat(F.lit("text of "), "id"))


def test_boosts_multiply_and_filters_select(spark):
    q = spark.createDataFrame([(1, [0.85, (1 - 0.85**2) ** 0.5], "pubmedbert", ["dosage"], ["metformin"], ["dosage"])], "qid long, vector array<double>, embedding_type string, answer_filter array<string>, drugs array<string>, boost_sections array<string>")
    hit = search.search(q, points(spark)).collect()
    assert len(hit) == 1 and abs(hit[0].score - 0.85 * 1.3 * 1.25 * 1.15) < 1e-9 and hit[0].boost_applied == ["section", "drugs_match", "answer_type"]
    assert search.search(q, points(spark), mode="boost_only").count() == 3
    plain = q.drop("answer_filter", "drugs")
    assert search.search(plain, points(spark)).count() == 3
    assert [r.id for r in search.search(plain.withColumn("types", F.array(F.lit("POLICY"))), points(spark)).collect()] == ["c"]
    both = search.search(q.withColumn("embedding_type", F.explode(F.array(F.lit("pubmedbert"), F.lit("biobert"), F.lit("scibert")))), points(spark))
    assert [(r.id, r.embedding_type) for r in search.merged(both).orderBy("position").collect()] == [("d", "biobert"), ("a", "pubmedbert")]
    # the other join, for more questions than are sent around
    assert sorted(map(tuple, search.search(q, points(spark), sent=0).select("qid", "id", "rank").collect())) == sorted(map(tuple, search.search(q, points(spark)).select("qid", "id", "rank").collect()))


def test_topk_is_a_prefix(spark):
    q, p = catalog._points(spark, "/root/testdata/sf0.001")
    q = q.withColumn("embedding_type", F.lit("pubmedbert"))
    few, many = search.search(q, p, 5), search.search(q, p, 20)
    assert few.select("qid", "id").exceptAll(many.where("rank <= 5").select("qid", "id")).count() == 0


def test_rerank_without_scorer_keeps_all(spark):
    c = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "y", 2)], "qid long, id string, text string, position int")
    assert rerank.reranked(c, None).orderBy("rerank_position").select("id").collect()[0].id == "a"


def test_missing_answer(spark):
    a = answer.cited(spark.createDataFrame([(None,)], "raw_answer string").withColumn("contexts", F.array().cast("array<struct<no:int,text:string,id:string>>"))).first()
    assert a.answer == answer.FAILED and a.cited == []


def test_web_pages(spark):
    html = "<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><nav><li>menu</li></nav><h1>Medications</h1><p>Take &lt;one&gt; <b>daily</b><p>second</p><ul><li>first<li>other</ul></body></html>"
    got = src.page_items(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("ord").collect()
    assert [(g.type, g.content) for g in got] == [("text", "T"), ("heading", "Medications"), ("text", "Take <one> daily"), ("text", "second"), ("text", "- first"), ("text", "- other")]


def documents(spark, n=3):
    d = parsed(spark, *[{**F1, "job_id": f"j{i}"} for i in range(n)])
    return d.withColumns({"title": F.concat(F.lit("t"), "job_id"), "type": F.lit("GUIDELINE"), "description": F.lit(""), "date": F.lit("2024-06-15"), "original_filename": F.lit("a.pdf"), "saved_file_path": F.lit("m/a.pdf"), "embedding_type": F.lit(None).cast("string"), "chunker_type": F.element_at(F.array(F.lit("healthcare"), F.lit("generic"), F.lit(None)), F.expr("cast(substr(job_id, 2) as int) % 3 + 1")), "enable_ner": F.col("job_id") == "j2"})


def test_ingest_is_idempotent_and_searchable(spark):
    spark.sql("DROP TABLE IF EXISTS pts")
    ingest.ingest(documents(spark), "pts")
    first = spark.read.table("pts").count()
    ingest.ingest(documents(spark), "pts")
    assert spark.read.table("pts").count() == first > 6
    ingest.ingest(documents(spark, 4), "pts")
    assert spark.read.table("pts").count() > first
    assert [r.embedding_type for r in store.collections(spark, "pts").collect()] == ["pubmedbert"]
    q = spark.createDataFrame([(1, "metformin dosage", None), (2, "zzz", ["scibert"])], "qid long, query string, embedding_types array<string>")
    got = {r.qid: r for r in retrieve.retrieve(q, spark.read.table("pts"), 5).collect()}
    assert "^[1]" in got[1].answer and got[1].intent == "dosage" and got[1].searched == ["pubmedbert"]
    assert got[2].answer == answer.NO_HITS and got[2].searched == []
    spark.sql("DROP TABLE IF EXISTS pts2")
    changed = backfill.backfill(spark, "pts", "pts2")
    assert changed == spark.read.table("pts2").where("enrichment_version is not null").count() > 0
    assert store.collection(spark, "pts2").count() == store.collection(spark, "pts2", "pubmedbert").count() > store.collection(spark, "pts2", "scibert").count() == 0
    assert spark.read.table("pts2").count() == spark.read.table("pts").count()
    assert spark.read.table("pts2").where("answer_types is null or size(answer_types) = 0").count() == 0


def test_stream_equals_batch(spark):
    from sparkquarry.streaming import ingest as stream
    from sparkquarry.streaming import replay

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)  # a small stream is enough here
    base = replay.folder(spark)
    docs = replay.as_parsed(docs)
    docs.write.json(f"{base}/in")
    for t in ("s1", "b1"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    for state in ("one", "two"):  # a second pass without memory of the first adds nothing
        stream.start(stream.read(spark, f"{base}/in"), "s1", f"{base}/{state}").awaitTermination()
    ingest.ingest(docs, "b1")
    a, b = spark.read.table("s1").select("id", "text"), spark.read.table("b1").select("id", "text")
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


def test_wrong_length_is_refused_and_models_register(spark):
    c = spark.createDataFrame([("x", "openai")], "chunk string, embedding_type string")
    try:
        embed.register("openai", embed.batched(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]))
        assert embed.embedded(c).first().embedding == [1.0, 1.0]
        with pytest.raises(ValueError):
            embed.register("word2vec", None)
    finally:
        embed._MODELS.clear()


def test_points_of_a_wrong_length_are_refused(spark):
    c = spark.createDataFrame([("x", "openai", 0)], "chunk string, embedding_type string, chunk_no int").withColumns({k: F.lit("k") for k in store.KEY})
    try:
        embed.register("openai", embed.batched(lambda: lambda texts: [[1.0, 2.0] for _ in texts]))
        with pytest.raises(Exception, match="wrong length"):
            store.points(embed.embedded(c).withColumn("dimensions", embed.dimensions_of(F.col("embedding_type")))).collect()
        embed.register("openai", embed.batched(lambda: lambda texts: [[1.0, 2.0] for _ in texts]), 2)
        assert store.points(embed.embedded(c).withColumn("dimensions", embed.dimensions_of(F.col("embedding_type")))).first().embedding == [1.0, 2.0]
    finally:
        embed._MODELS.clear()
        embed._DIMENSIONS.clear()


def test_pooling_with_a_mask(spark):
    m = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((1.0, 8.0), (3.0, 6.0), (100.0, 100.0))])
    mask = lambda *x: F.array(*map(F.lit, x))
    from sparkquarry.functions.vectors import pooled

    r = spark.range(1).select(pooled(m, "mean", mask(1, 1, 0)).alias("a"), pooled(m, "max", mask(1, 1, 0)).alias("b"), pooled(m, "mean", mask(0, 0, 0)).alias("c"), pooled(m, "max", mask(0, 0, 0)).alias("d"), pooled(m).alias("e"), pooled(m, "cls", mask(0, 1, 1)).alias("f")).first()
    assert tuple(r) == ([2.0, 7.0], [3.0, 8.0], [0.0, 0.0], None, [104 / 3, 38.0], [1.0, 8.0])


def test_texts_in_parts():
    long = "One sentence. " * 300 + "x" * 4000 + ". end"
    parts = ner.parts_of(long)
    assert "".join(p for _, p in parts) == long and all(long[o : o + len(p)] == p for o, p in parts)
    assert max(len(p) for _, p in parts if "xx" not in p) <= ner.PART and len(parts) > 3
    assert ner.parts_of("short. text") == [(0, "short. text")] and ner.parts_of("") == [(0, "")]


def test_a_batched_model_serves_chunks_and_questions(spark):
    def _finder():
        return lambda texts: [[{"word": m[0], "entity_group": "I-Medication", "start": m.start(), "end": m.end(), "score": 0.99} for m in re.finditer("zolpidem", t, re.I)] for t in texts]

    c = spark.createDataFrame([(1, "word " * 800 + ". Take Zolpidem now"), (2, None), (3, "")], "id long, chunk string").withColumn("section_type", F.lit(None).cast("string"))
    got = {r.id: r for r in ner.enriched(c, ner.batched(_finder)).collect()}
    assert [(e.text, e.start) for e in got[1].ner_entities] == [("Zolpidem", 4000 + 7)] and got[1].drugs == ["zolpidem"]
    assert not got[2].has_medical_entities and not got[3].has_medical_entities
    q = spark.createDataFrame([(1, "zolpidem dosage"), (2, "metformin dosage")], "qid long, query string")
    e = {r.qid: r for r in query.search_strategy(query.enhanced(q, model=ner.batched(_finder))).collect()}
    assert e[1].drugs == ["zolpidem"] and e[1].entities_by_type == {"drug": ["zolpidem"]} and e[1].boost_weight == 1.3
    assert "zolpidem medication information" not in (e[2].search_texts or []) and e[2].entities_by_type["drug"] == ["metformin"]


def test_page_sizes(spark):
    d = spark.createDataFrame([("a", "612", None), ("b", "wide", "5.5")], "job_id string, page_width string, page_height string")
    c = spark.createDataFrame([("a", None, None), ("a", 3.0, 4.0), ("b", None, None), ("z", None, None)], "job_id string, page_width double, page_height double")
    got = sorted(map(tuple, chunking.with_page_size(c, d).select("job_id", chunking.size_text(F.col("page_width")), chunking.size_text(F.col("page_height"))).collect()))
    assert got == [("a", "3.0", "4.0"), ("a", "612.0", "NA"), ("b", "NA", "5.5"), ("z", "NA", "NA")]


def test_uploads_and_names(spark, tmp_path):
    (tmp_path / "a..b.pdf").write_bytes(b"%PDF")
    assert src.read_uploads(spark, str(tmp_path)).first().original_filename == "ab.pdf"
    (tmp_path / "d.json").write_text(json.dumps(F1) + "\n")
    assert src.read_parsed(spark, str(tmp_path / "d.json")).first().pages[0].page == 1


@pytest.mark.parametrize("name", ["vector_topk", "chunk_generic", "page_chunks", "bm25_search", "corpus_stats"])
def test_catalog_runs(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_searches_ask_every_hundredth_vector(spark):
    d = "/root/testdata/sf0.001"
    e = catalog.table(spark, d, "embeddings").orderBy("vec_id").collect()
    ids, label = np.array([r.vec_id for r in e]), np.array([r.label for r in e])
    v = np.array([r.embedding for r in e], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    kind = np.where(label < 5, "pubmedbert", "biobert")
    asked = ids[ids % 100 == 0].tolist()
    assert len(asked) > 3

    def best(q, keep):
        c = v @ v[q]
        return [(int(ids[i]), c[i], i) for i in sorted(np.flatnonzero(keep), key=lambda i: (-c[i], ids[i]))[:10]]

    def got(name, place="rank"):
        out = {}
        for r in catalog.QUERIES[name](spark, d).orderBy("qid", place).collect():
            out.setdefault(r.qid, []).append((r.id, r.score))
        return out

    def same(found, wanted):
        assert {*found} == {q for q, w in wanted.items() if w}
        for q, rows in found.items():
            assert [i for i, _ in rows] == [i for i, _ in wanted[q]] and np.allclose([s for _, s in rows], [s for _, s in wanted[q]], atol=1e-4)

    places = {q: int(np.flatnonzero(ids == q)[0]) for q in asked}
    same(got("vector_topk_whole"), {q: [(i, c) for i, c, _ in best(at, label >= 0)] for q, at in places.items()})
    same(got("vector_topk_filtered_whole"), {q: [(i, c) for i, c, _ in best(at, label == label[at])] for q, at in places.items()})
    boosted = {q: [(i, c * (1.3 if label[n] % 2 == 1 else 1.0) * 1.15, c) for i, c, n in best(at, label % 3 == 1)] for q, at in places.items()}
    same(got("vector_topk_boosted_whole"), {q: [(i, s) for i, s, _ in sorted(w, key=lambda x: (-x[1], -x[2], x[0]))] for q, w in boosted.items()})
    both = {q: sorted([(i, c, k) for k in ("biobert", "pubmedbert") for i, c, _ in best(at, kind == k)], key=lambda x: (-x[1], x[2], x[0]))[:10] for q, at in places.items()}
    same(got("multi_collection_merge_whole", "position"), {q: [(i, c) for i, c, _ in w] for q, w in both.items()})


def test_entities_of_all_documents(spark, tmp_path):
    texts = ["Überdosis: Metformin 500 mg daily", "naïve café, no entity", None, "给予 aspirin 与 biopsy", "plain aspirin", "ſ İ K metformin\u00a0x"]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    real = {r.doc_id: r.text for r in catalog.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    fixtures = {-r.id: r.c for r in catalog.rows(spark, catalog.CHUNKS, "id", "c").collect()}
    for d, docs in ((str(tmp_path), dict(enumerate(texts, 1))), ("/root/testdata/sf0.001", real)):
        wanted = {}  # by Java's rules: letters of all scripts bound words, case folds in ASCII only
        for i, t in (docs | fixtures).items():
            seen, own = set(), []
            for patterns in vocab.CHUNK_ENTITIES.values():
                hits = dict.fromkeys(m.lower() for p in patterns for m in (x.group(0) for x in re.finditer(p.replace(r"\b", r"(?u:\b)"), t or "", re.I | re.A)))
                own.append([h for h in hits if h not in seen])
                seen |= {*hits}
            wanted[i] = tuple("|".join(o) for o in own)
        got = {r.id: (r.drugs, r.diseases, r.procedures) for r in catalog.QUERIES["entity_extract_whole"](spark, d).collect()}
        assert got == wanted
        assert catalog.QUERIES["entity_stats_whole"](spark, d).first()[:] == (len(wanted), sum(any(w) for w in wanted.values()), sum(bool(w[2]) for w in wanted.values()))
    named = catalog.QUERIES["ner_process_whole"](spark, str(tmp_path)).collect()
    assert {(r.id, r.text.lower()) for r in named if r.id > 0} >= {(1, "metformin"), (1, "500 mg"), (4, "aspirin"), (4, "biopsy"), (5, "aspirin"), (6, "metformin")}
    whole = dict(enumerate(texts, 1)) | fixtures | {-101: "metformin 500 mg twice a day was prescribed"}
    assert {r.id for r in named} >= {-101, -1} and all(whole[r.id][r.s : r.e] == r.text for r in named)


def test_backfill_completes_each_row_from_itself(spark):
    rows = [("a", "Metformin for diabetes", [], [], []), ("a", "biopsy steps", ["kept"], [], []), (None, "aspirin", None, None, None), ("b", None, [], [], []), ("c", "insulin", ["x"], ["y"], ["z"])]
    p = spark.createDataFrame(rows, "id string, text string, answer_types array<string>, medical_entities array<string>, entity_types array<string>").withColumns({"boost_section": F.lit(None).cast("string"), "section_type": F.lit("dosage")})
    out = enrich.backfilled(p)
    got = [(r.id, r.text, r.answer_types, r.medical_entities, r.enrichment_version) for r in out.collect()]
    assert len(got) == 5 and got[0][3] == ["metformin", "diabetes"] and got[1][2] == ["kept"] and got[2][3] == ["aspirin"] and got[3][2:4] == (["general"], []) and got[4][2:] == (["x"], ["y"], None)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    e = enrich.entities(spark.createDataFrame([(None,)], "chunk string")).first()
    assert e.drugs == [] and e.entity_types == [] and e.has_medical_content is False


@pytest.mark.parametrize("n", [1, 64, 65, 768, 1536])
def test_hashing_embedder_at_any_width(spark, n):
    import hashlib

    text = "One two, two; THREE 4 four-five"
    want = np.zeros(n)
    for t in re.findall(r"[a-z0-9]+|[^\sa-z0-9]", text.lower()):
        want[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % n] += 1
    got = spark.createDataFrame([(text,)], "t string").select(vec.hash_embedding(F.col("t"), n)).first()[0]
    assert np.allclose(got, want / np.linalg.norm(want))


def test_documents_that_share_a_job_id(spark):
    one = documents(spark, 1)
    two = one.unionByName(one.withColumn("title", F.lit("other"))).unionByName(one.withColumn("job_id", F.lit(None).cast("string")))
    p = ingest.prepared(two)
    single = ingest.prepared(one).count()
    assert p.count() == p.dropDuplicates(["id"]).count() and p.where("title = 'other'").count() > 0 and p.count() >= 2 * single
    sizes = spark.createDataFrame([("f1", "100", "7"), ("f1", "90", None), (None, "5", "6")], "job_id string, page_width string, page_height string")
    chunks = spark.createDataFrame([("f1", None, None), (None, None, 1.0), ("x", None, None)], "job_id string, page_width double, page_height double")
    assert sorted(map(tuple, chunking.with_page_size(chunks, sizes).collect()), key=str) == sorted([("f1", 90.0, 7.0), (None, 5.0, 1.0), ("x", None, None)], key=str)


def test_medical_types(spark):
    c = spark.createDataFrame([(t, "x", None) for t in ("medication", "lab_result", "vital_signs", "text", None)], "chunk_type string, chunk string, section_type string")
    assert [r.medical_type for r in enrich.enriched(c).collect()] == ["medication", "lab_result", "vital_signs", None, None]


def test_collections_by_name(spark):
    spark.sql("DROP TABLE IF EXISTS named")
    store.create(spark, "named")
    have = {f.split(" ")[0]: f.split(" ", 1)[1] for f in store.POINT.split(", ")}
    p = spark.createDataFrame([("a", [1.0, 0.0], "biobert"), ("b", [0.8, 0.6], "biobert"), ("c", [0.9, 0.1], "openai")], "id string, embedding array<float>, embedding_type string")
    p.select(*[(F.col(n) if n in p.columns else F.lit(None)).cast(t).alias(n) for n, t in have.items()]).write.insertInto("named")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<double>")
    got = lambda name: [r.id for r in retrieve.search_collection(q, "named", name, 5).orderBy("position").collect()]
    assert got("named") == ["a", "c", "b"] and got("named_biobert") == ["a", "b"] and got("named_scibert") == [] and got("elsewhere") == got("other_biobert") == []
