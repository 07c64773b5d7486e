"""Named queries over the test tables, and SQL that another engine can check them with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import subwords
from .functions import text as tx
from .functions import vectors as vec
from .functions import vocab
from .operators import answer, centroids, chunkers, chunking, embed, enrich, inverted, ner, query, rerank, search, sections
from .plans import backfill, retrieve
from .sources import documents as src
from .sources import ledger, parsed, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def named(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def joined(c: str | Column, by: str = "|") -> Column:
    return F.array_join(c, by)


# ---- rows both engines read

HEADINGS = "VALUES (1,'Medications'),(2,'Contraindications'),(3,'Adverse Reactions'),(4,'Past Medical History'),(5,'Medical History'),(6,'Dosage and Administration'),(7,'Lab Results'),(8,'Vital Signs'),(9,'Follow-up'),(10,'Discharge Summary'),(11,'Drug Interactions'),(12,'Treatment Guidelines'),(13,'Inclusion Criteria'),(14,'Warnings and Precautions'),(15,'Notes'),(16,'  Chief   Complaint ')"
CHUNKS = "VALUES (1,'Metformin 500 mg twice daily refers to treatment of diabetes and hypertension'),(2,'Amoxicillin allergy: avoid, do not use. Test for pneumonia'),(3,'Colonoscopy procedure and biopsy steps'),(4,'No label here at all'),(5,'Compared to aspirin, ibuprofen shows a side effect risk'),(6,'Lisinopril and metformin, lisinopril again; arthritis and gastritis screening'),(7,'Prevention of influenza and asthma by prophylaxis'),(8,'')"
QUESTIONS = "VALUES (1,'metformin dosage'),(2,'what is metformin'),(3,'metformin side effects'),(4,'lisinopril side effects'),(5,'when not to use metformin'),(6,'how to treat hypertension'),(7,'treatment for pneumonia'),(8,'how to diagnose diabetes'),(9,'what is the dosage of metformin?'),(10,'Can warfarin be used with aspirin?'),(11,'tx for dm2'),(12,'sx of mi'),(13,'metropolol side effects'),(14,'prevent influenza'),(15,'aspirin vs. ibuprofen'),(16,'colonoscopy procedure'),(17,'tell me about asthma ,please'),(18,'pt with htn ,sob and n/v'),(19,'metformine dose 2.5 mg for diabetis'),(20,'warnings for insulin use')"
ITEMS = "VALUES ('a',1,'text','intro before any heading'),('a',2,'heading','Medications'),('a',3,'text','1. Metformin 500mg'),('a',4,'text','2. Lisinopril 10mg'),('a',5,'text','Plain paragraph'),('a',6,'text','- dash item'),('a',7,'heading','Lab Results'),('a',8,'text','- first'),('a',9,'text','a) second'),('a',10,'table','x'),('b',1,'text','only text'),('b',2,'text','1. one')"
# rows of the tables beside the ones above: (SQL that DuckDB runs, what Spark reads)
MORE_QUESTIONS = "SELECT 1000 + item_id AS qid, coalesce(text, '') AS query FROM benchmark UNION ALL SELECT 1000000 + 1000 * conv_id + turn, coalesce(text, '') FROM conversations WHERE role = 'user'"
MORE_HEADINGS = "SELECT 101 + page_id AS id, regexp_extract(coalesce(html, ''), '<(title|h1|h2)>([^<]*)</', 2) AS h FROM pages"
MORE_ITEMS = "SELECT 'c' || conv_id AS job_id, turn AS ord, CASE WHEN turn % 4 = 0 THEN 'heading' WHEN turn % 7 = 5 THEN 'table' ELSE 'text' END AS type, coalesce(text, '') AS content FROM conversations"
MORE_TABLES = "SELECT 100 + 1000 * conv_id + turn AS id, replace(coalesce(text, ''), ' ', ',') AS h FROM conversations"
TABLES = "VALUES (1,'Test,Result,Range'),(2,'Drug,Dose,Route'),(3,'BP,HR'),(4,'Name,Age'),(5,'')"


def rows(spark: SparkSession, values: str, *names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM ({values}) AS t({', '.join(names)})")


def both(values: str, names: str, more: str) -> str:
    """SQL of literal rows and a table's rows, in one table expression."""
    return f"(SELECT * FROM ({values}) v({names}) UNION ALL {more})"


ALL_QUESTIONS, ALL_HEADINGS = both(QUESTIONS, "qid, query", MORE_QUESTIONS), both(HEADINGS, "id, h", MORE_HEADINGS)
ALL_ITEMS, ALL_TABLES = both(ITEMS, "job_id, ord, type, content", MORE_ITEMS), both(TABLES, "id, h", MORE_TABLES)


def asked(spark: SparkSession, d: str) -> DataFrame:
    b, c = table(spark, d, "benchmark"), table(spark, d, "conversations").where("role = 'user'")
    more = b.selectExpr("1000 + item_id", "coalesce(text, '')").union(c.selectExpr("1000000 + 1000 * conv_id + turn", "coalesce(text, '')"))
    return rows(spark, QUESTIONS, "qid", "query").union(more)


def headings(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(101 + F.col("page_id"), F.regexp_extract(F.coalesce("html", F.lit("")), "<(title|h1|h2)>([^<]*)</", 2))
    return rows(spark, HEADINGS, "id", "h").union(p)


def headers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(100 + 1000 * F.col("conv_id") + F.col("turn"), F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(",")))
    return rows(spark, TABLES, "id", "h").union(c)


def _labels_sql(c: str, table_: dict[str, list[str]]) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(lower({c}), '{'|'.join(map(tx.quoted, v))}') THEN '{k}' END" for k, v in table_.items())
    return f"coalesce(nullif(array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), '|'), ''), 'general')"


def _first_sql(c: str, patterns: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(trim(lower({c})), '{p}') THEN '{v}'" for p, v in patterns.items()) + " END"


def _types_sql(c: str, patterns: dict[str, list[str]]) -> str:
    """CTE columns: distinct matches by type; what an earlier type has is taken out. A list of columns f0, f1, ..."""
    cols = []
    for i, ps in enumerate(patterns.values()):
        hits = " || ".join(f"list_transform(regexp_extract_all({c}, '(?i){p}', 0), lambda x: lower(x))" for p in ps)
        cols.append(f"({hits}) AS h{i}")
    return ", ".join(cols)


# ---- vectors

_TOP = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS qid, e.vec_id AS id, e.label, q.label AS ql, list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS c FROM q, e)
"""


def _points(spark: SparkSession, d: str, kind: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector as a question, and all vectors as points."""
    e = table(spark, d, "embeddings")
    kind = F.lit("pubmedbert") if kind is None else kind
    p = e.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("type"), F.array(F.concat(F.lit("a"), (F.col("label") % 3).cast("string"))).alias("answer_types"), F.concat(F.lit("s"), (F.col("label") % 2).cast("string")).alias("boost_section"), kind.alias("embedding_type"))
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), F.col("label").alias("ql")), p


def _topk(q: DataFrame, p: DataFrame) -> DataFrame:
    return search.search(q.withColumn("embedding_type", F.lit("pubmedbert")), p, 10).select("qid", "id", F.round("original_score", 4).alias("score"), "rank")


@named(_TOP + "SELECT qid, id, round(c, 4) AS score, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, id) AS r FROM s) WHERE r <= 10")
def vector_topk(spark, d):
    return _topk(*_points(spark, d))


@named(_TOP + "SELECT qid, id, round(c, 4) AS score, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, id) AS r FROM s WHERE label = ql) WHERE r <= 10")
def vector_topk_filtered(spark, d):
    return _topk_filtered(*_points(spark, d))


def _topk_filtered(q: DataFrame, p: DataFrame) -> DataFrame:
    q = q.withColumns({"embedding_type": F.lit("pubmedbert"), "types": F.array(F.col("ql").cast("string"))})
    return search.search(q, p, 10).select("qid", "id", F.round("original_score", 4).alias("score"), "rank")


_BOOSTED = _TOP + """, t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, id) AS r FROM s WHERE label % 3 = 1),
b AS (SELECT *, c * (CASE WHEN label % 2 = 1 THEN 1.3 ELSE 1.0 END) * 1.15 AS sc FROM t WHERE r <= 10)
"""


@named(_BOOSTED + "SELECT qid, id, round(c, 4) AS original_score, round(sc, 4) AS score, CASE WHEN label % 2 = 1 THEN 'section|answer_type' ELSE 'answer_type' END AS boosts, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, c DESC, id)::INTEGER AS rank FROM b")
def vector_topk_boosted(spark, d):
    return _topk_boosted(*_points(spark, d))


def _topk_boosted(q: DataFrame, p: DataFrame) -> DataFrame:
    q = q.withColumns({"embedding_type": F.lit("pubmedbert"), "answer_filter": F.array(F.lit("a1")), "boost_sections": F.array(F.lit("s1"))})
    return search.search(q, p, 10).select("qid", "id", F.round("original_score", 4).alias("original_score"), F.round("score", 4).alias("score"), joined("boost_applied").alias("boosts"), "rank")


@named(_TOP + """, t AS (SELECT *, CASE WHEN label < 5 THEN 'pubmedbert' ELSE 'biobert' END AS kind FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY c DESC, id) AS r FROM t),
m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, kind, id) AS pos FROM k WHERE r <= 10)
SELECT qid, id, kind AS embedding_type, round(c, 4) AS score, pos::INTEGER AS position FROM m WHERE pos <= 10""")
def multi_collection_merge(spark, d):
    return _merge(*_points(spark, d, _kind()))


def _merge(q: DataFrame, p: DataFrame) -> DataFrame:
    q = search.routed(q.withColumns({"confidence": F.lit(0.5), "embedding_types": F.lit(None).cast("array<string>")}))
    hits = search.search(q, p.drop("type").withColumn("type", F.lit("x")), 10)
    return search.merged(hits, 10).select("qid", "id", "embedding_type", F.round("score", 4).alias("score"), "position")


def _kind() -> Column:
    return F.when(F.col("label") < 5, "pubmedbert").otherwise("biobert")


@named(_TOP + """, t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, id) AS r FROM s WHERE label % 4 IN (ql % 4, 1))
SELECT qid, id, round(c, 4) AS original_score, round(c * 1.2, 4) AS score, 'chunk_type' AS boosts, r::INTEGER AS rank FROM t WHERE r <= 10""")
def vector_topk_chunk_types(spark, d):
    """Points of two chunk types, one of them the question's own."""
    q, p = _points(spark, d)
    kind = lambda c: F.concat(F.lit("c"), (F.col(c) % 4).cast("string"))
    q = q.withColumns({"embedding_type": F.lit("pubmedbert"), "chunk_types": F.array(kind("ql"), F.lit("c1"))})
    p = p.withColumn("chunk_type", F.concat(F.lit("c"), (F.col("type").cast("int") % 4).cast("string")))
    h = search.search(q, p, 10)
    return h.select("qid", "id", F.round("original_score", 4).alias("original_score"), F.round("score", 4).alias("score"), joined("boost_applied").alias("boosts"), "rank")


# the same questions, asked of the centroid index; its exact mode answers as the plain search does
def _indexed(spark: SparkSession, points: DataFrame) -> str:
    path = store.folder(spark)
    centroids.build(points, path)
    return path


@named(SQL["vector_topk"])
def vector_topk_whole(spark, d):
    q, p = _points(spark, d)
    return centroids.search(q.withColumn("embedding_type", F.lit("pubmedbert")), _indexed(spark, p), 10).select("qid", "id", F.round("original_score", 4).alias("score"), "rank")


@named(SQL["vector_topk_filtered"])
def vector_topk_filtered_whole(spark, d):
    q, p = _points(spark, d)
    q = q.withColumns({"embedding_type": F.lit("pubmedbert"), "types": F.array(F.col("ql").cast("string"))})
    return centroids.search(q, _indexed(spark, p), 10).select("qid", "id", F.round("original_score", 4).alias("score"), "rank")


@named(SQL["vector_topk_boosted"])
def vector_topk_boosted_whole(spark, d):
    q, p = _points(spark, d)
    q = q.withColumns({"embedding_type": F.lit("pubmedbert"), "answer_filter": F.array(F.lit("a1")), "boost_sections": F.array(F.lit("s1"))})
    return centroids.search(q, _indexed(spark, p), 10).select("qid", "id", F.round("original_score", 4).alias("original_score"), F.round("score", 4).alias("score"), joined("boost_applied").alias("boosts"), "rank")


@named(SQL["multi_collection_merge"])
def multi_collection_merge_whole(spark, d):
    q, p = _points(spark, d, _kind())
    q = search.routed(q.withColumns({"confidence": F.lit(0.5), "embedding_types": F.lit(None).cast("array<string>")}))
    return search.merged(centroids.search(q, _indexed(spark, p.withColumn("type", F.lit("x"))), 10), 10).select("qid", "id", "embedding_type", F.round("score", 4).alias("score"), "position")


@named("SELECT (count(*) FILTER (WHERE vec_id % 100 = 0))::BIGINT AS questions, least(10, count(*))::BIGINT AS k, true AS recalled FROM embeddings")
def centroid_recall(spark, d):
    """Whether the index's first cells hold nine in ten of the ten nearest vectors of every hundredth one."""
    q, p = _points(spark, d)
    r = centroids.recall(q.withColumn("embedding_type", F.lit("pubmedbert")), _indexed(spark, p))
    return r.agg(F.count("*").alias("questions"), F.max("k").alias("k"), (F.sum("found") >= 0.9 * F.sum("k")).alias("recalled"))


@named("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (3 * x::DOUBLE) * (3 * x::DOUBLE)))), 3) AS length_before, 1.0::DOUBLE AS length_after FROM embeddings")
def l2_normalize(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    return table(spark, d, "embeddings").select("vec_id", F.round(vec.norm(v), 3).alias("length_before"), F.round(vec.norm(vec.normalised(v)), 6).alias("length_after"))


@named("WITH e AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) SELECT label, (i - 1)::INTEGER AS i, round(avg(x), 4) AS mean, round(max(x), 4) AS most FROM u GROUP BY label, i")
def pooled_by_label(spark, d):
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy("label", "i").agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.max("x"), 4).alias("most"))


@named("""
WITH e AS (SELECT vec_id // 8 AS grp, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT grp, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
p AS (SELECT grp, i, min_by(x, vec_id) AS cls, coalesce(avg(x) FILTER (WHERE vec_id % 3 <> 0), 0) AS mean, max(x) FILTER (WHERE vec_id % 3 <> 0) AS most FROM u GROUP BY grp, i)
SELECT grp, round(sum(cls), 4) AS cls, round(sum(mean), 4) AS mean, round(sum(most), 4) AS most FROM p GROUP BY grp""")
def pooled_vectors(spark, d):
    """Runs of eight vectors as one, those with an id divisible by three masked out of means and maxima."""
    g = table(spark, d, "embeddings").groupBy(F.expr("vec_id div 8").alias("grp")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("e"))
    g = g.select("grp", F.transform("e.embedding", lambda v: vec.doubled(v)).alias("m"), F.transform("e.vec_id", lambda i: F.when(i % 3 != 0, 1).otherwise(0)).alias("mask"))
    total = lambda how: F.round(F.aggregate(vec.pooled(F.col("m"), how, F.col("mask")), F.lit(0.0), lambda a, x: a + x), 4)
    return g.select("grp", total("cls").alias("cls"), total("mean").alias("mean"), total("max").alias("most"))


@named("WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT id, round(list_sum(v), 4) AS cls, round(list_sum(list_transform(v, lambda x: 1.5 * x)), 4) AS mean, round(list_sum(list_transform(v, lambda x: greatest(x, 2 * x))), 4) AS most FROM v")
def pooling(spark, d):
    """Every vector and its double as one, by each way of pooling."""
    v = vec.doubled(F.col("embedding"))
    m = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(v, F.transform(v, lambda x: 2 * x)).alias("m"))
    return m.select("id", *[F.round(F.aggregate(vec.pooled(F.col("m"), h), F.lit(0.0), lambda a, x: a + x), 4).alias(n) for h, n in (("cls", "cls"), ("mean", "mean"), ("max", "most"))])


@named(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9]+|[^\sA-Za-z0-9]') AS t FROM documents),
u AS (SELECT doc_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 64) AS b FROM (SELECT doc_id, unnest(t) AS w FROM t)),
c AS (SELECT doc_id, b, count(*)::DOUBLE AS n FROM u GROUP BY doc_id, b)
SELECT doc_id, count(*)::BIGINT AS buckets, round(max(n) / sqrt(sum(n * n)), 4) AS most FROM c GROUP BY doc_id""")
def hash_embed(spark, d):
    e = table(spark, d, "documents").select("doc_id", vec.hash_embedding(F.col("text")).alias("v"))
    return e.select("doc_id", F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("buckets"), F.round(F.array_max("v"), 4).alias("most")).where("buckets > 0")


# ---- names, routes

_NAMES = "VALUES (1,'medical','pubmedbert'),(2,'a_b','openai'),(3,'x','biolinkbert')"
_MORE_NAMES = "SELECT 10 + doc_id, coalesce(source, ''), CASE doc_id % 3 WHEN 0 THEN 'biobert' WHEN 1 THEN 'openai' ELSE 'other' END FROM documents"


@named(f"SELECT id, b || '_' || k AS name, CASE WHEN k = 'other' THEN b || '_' || k ELSE b END AS base, nullif(k, 'other') AS embedding_type FROM (SELECT * FROM ({_NAMES}) t(id, b, k) UNION ALL {_MORE_NAMES})")
def collection_naming(spark, d):
    more = table(spark, d, "documents").selectExpr("10 + doc_id", "coalesce(source, '')", "CASE doc_id % 3 WHEN 0 THEN 'biobert' WHEN 1 THEN 'openai' ELSE 'other' END")
    r = rows(spark, _NAMES, "id", "b", "k").union(more)
    r = r.withColumn("name", store.collection_name(F.col("b"), F.col("k"))).withColumn("p", store.parsed_name(F.col("name")))
    return r.select("id", "name", "p.base", "p.embedding_type")


@named("SELECT id, CASE WHEN upper(trim(t)) IN ('GUIDELINE','POLICY','FAQ','DOCUMENT') THEN 'pdf' ELSE 'unknown' END AS parse_type FROM (SELECT * FROM (VALUES (1,'guideline'),(2,' POLICY '),(3,'memo'),(4,'Faq')) v(id, t) UNION ALL SELECT 10 + doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'policy' ELSE source END, '') FROM documents)")
def parse_type_tag(spark, d):
    return rows(spark, "VALUES (1,'guideline'),(2,' POLICY '),(3,'memo'),(4,'Faq')", "id", "t").union(table(spark, d, "documents").selectExpr("10 + doc_id", "coalesce(CASE WHEN doc_id % 3 = 0 THEN 'policy' ELSE source END, '')")).select("id", src.parse_type(F.col("t")).alias("parse_type"))


@named("SELECT id, CASE WHEN t NOT IN ('GUIDELINE','POLICY','FAQ','DOCUMENT') THEN 'unknown document type' WHEN e NOT IN ('openai','pubmedbert','biobert','scibert','clinicalbert','biolinkbert') THEN 'unknown embedding type' ELSE 'accepted' END AS outcome FROM (SELECT * FROM (VALUES (1,'GUIDELINE','biobert'),(2,'memo','biobert'),(3,'FAQ','word2vec'),(4,'POLICY','pubmedbert')) v(id, t, e) UNION ALL SELECT 10 + doc_id, CASE WHEN doc_id % 3 = 0 THEN 'FAQ' ELSE coalesce(source, '') END, CASE WHEN doc_id % 2 = 0 THEN 'biobert' ELSE coalesce(lang, '') END FROM documents)")
def upload_validation(spark, d):
    u = rows(spark, "VALUES (1,'GUIDELINE','biobert'),(2,'memo','biobert'),(3,'FAQ','word2vec'),(4,'POLICY','pubmedbert')", "id", "type", "embedding_type")
    u = u.union(table(spark, d, "documents").selectExpr("10 + doc_id", "CASE WHEN doc_id % 3 = 0 THEN 'FAQ' ELSE coalesce(source, '') END", "CASE WHEN doc_id % 2 = 0 THEN 'biobert' ELSE coalesce(lang, '') END")).withColumn("chunker_type", F.lit(None).cast("string"))
    good, bad = src.validated(u)
    return good.select("id", F.lit("accepted").alias("outcome")).union(bad.select("id", "reason"))


# ---- sections, groups

@named(f"SELECT id, {_first_sql('h', vocab.SECTIONS)} AS kind FROM {ALL_HEADINGS} t")
def section_classify(spark, d):
    return headings(spark, d).select("id", sections.section_type(F.col("h")).alias("kind"))


@named(f"SELECT id, {_first_sql('h', vocab.NER_SECTIONS)} AS kind FROM {ALL_HEADINGS} t")
def section_classify_ner(spark, d):
    return headings(spark, d).select("id", sections.section_type(F.col("h"), ner=True).alias("kind"))


@named(f"SELECT id, {_first_sql('h', tx.strict_patterns(vocab.SECTIONS))} AS kind FROM {ALL_HEADINGS} t")
def section_classify_strict(spark, d):
    return headings(spark, d).select("id", sections.section_type(F.col("h"), strict=True).alias("kind"))


def _value_sql(c: str, table_: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


@named(f"SELECT id, kind, {_value_sql('kind', vocab.BOOST_SECTIONS)} AS boost, {_value_sql('kind', vocab.BACKFILL_BOOST_SECTIONS)} AS backfill FROM (SELECT id, {_first_sql('h', vocab.SECTIONS)} AS kind FROM {ALL_HEADINGS} t UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, '{k}')" for i, k in enumerate([*vocab.BOOST_SECTIONS, "imaging"])) + ") k(id, kind))")
def boost_section_map(spark, d):
    """The boost sections of all headings' types, and of the types by name."""
    kinds = ", ".join(f"({-i - 1}, '{k}')" for i, k in enumerate([*vocab.BOOST_SECTIONS, "imaging"]))
    k = headings(spark, d).select("id", sections.section_type(F.col("h")).alias("kind")).union(rows(spark, f"VALUES {kinds}", "id", "kind"))
    return k.select("id", "kind", sections.boost_section(F.col("kind")).alias("boost"), sections.boost_section(F.col("kind"), backfill=True).alias("backfill"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("turn") % 4 == 0, "heading").when(F.col("turn") % 7 == 5, "table").otherwise("text")
    c = table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")), "turn", kind, F.coalesce("text", F.lit("")))
    r = rows(spark, ITEMS, "job_id", "ord", "type", "content").union(c)
    return r.withColumn("level", F.when(F.col("type") == "heading", 1))


_SECTIONED = f"""
WITH i AS (SELECT * FROM {ALL_ITEMS}),
s AS (SELECT *, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER w AS section_id, last_value(CASE WHEN type = 'heading' THEN content END IGNORE NULLS) OVER w AS title
  FROM i WINDOW w AS (PARTITION BY job_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, coalesce(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), 'Document Content') AS section_title FROM s WHERE type <> 'heading'),
k AS (SELECT *, CASE WHEN regexp_matches(content, '^\\s*(?:•|\\-|\\d+\\.|\\w\\))') THEN 'list' WHEN type = 'table' THEN 'table' ELSE 'text' END AS kind FROM b),
n AS (SELECT *, CASE WHEN kind = 'list' AND lag(kind) OVER w = 'list' AND lag(section_id) OVER w = section_id THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY job_id ORDER BY ord))
"""


@named(_SECTIONED + f"SELECT job_id, ord, section_id::BIGINT AS section_id, section_title, CASE WHEN section_id > 0 THEN {_first_sql('section_title', vocab.SECTIONS)} END AS section_type FROM b")
def section_assign(spark, d):
    return sections.with_sections(_items(spark, d)).select("job_id", "ord", "section_id", "section_title", "section_type")


@named(_SECTIONED + "SELECT job_id, ord, kind AS group_kind, sum(new) OVER (PARTITION BY job_id ORDER BY ord)::BIGINT AS group_id FROM n")
def list_grouping(spark, d):
    return sections.with_groups(sections.with_sections(_items(spark, d))).select("job_id", "ord", "group_kind", "group_id")


@named("WITH t AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id, count(*)::BIGINT AS items, sum(CASE WHEN regexp_matches(text, '^\\s*(?:•|\\-|\\d+\\.|\\w\\))') THEN 1 ELSE 0 END)::BIGINT AS list_items FROM t GROUP BY conv_id")
def list_items_by_conversation(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("items"), F.sum(sections.is_list_item(F.col("text")).cast("long")).alias("list_items"))


# ---- chunks

_TOKENS = r"WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[^\sA-Za-z0-9]') AS t, text FROM documents WHERE text IS NOT NULL)"


@named(_TOKENS + " SELECT doc_id, len(t)::INTEGER AS n FROM t")
def token_count(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.token_count(F.col("text")).alias("n"))


@named(_TOKENS + f""", w AS (
  SELECT doc_id, i, len(t) AS n, t[i * {chunking.SIZE - chunking.OVERLAP} + 1 : i * {chunking.SIZE - chunking.OVERLAP} + {chunking.SIZE}] AS w
  FROM (SELECT doc_id, t, unnest(generate_series(0, greatest(0, ceil((len(t) - {chunking.SIZE}) / {chunking.SIZE - chunking.OVERLAP}.0)::BIGINT))) AS i FROM t WHERE len(t) > 0)
), z AS (SELECT *, max(i) OVER (PARTITION BY doc_id) AS last FROM w),
y AS (SELECT *, max(CASE WHEN i = last THEN len(w) END) OVER (PARTITION BY doc_id) AS tail, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM z),
m AS (SELECT doc_id, i, last, n, CASE WHEN last > 0 AND tail < {chunking.LEAST} AND i = last - 1 THEN w || nxt ELSE w END AS w FROM y WHERE NOT (last > 0 AND tail < {chunking.LEAST} AND i = last))
SELECT doc_id, i::INTEGER AS chunk_no, len(w)::INTEGER AS n, md5(array_to_string(w, ' ')) AS digest FROM m""")
def chunk_generic(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    c = t.select("doc_id", F.posexplode(chunking.merged_windows(F.col("t"))).alias("chunk_no", "w"))
    return c.select("doc_id", "chunk_no", F.size("w").alias("n"), F.md5(joined("w", " ").cast("binary")).alias("digest"))


@named(_TOKENS + f""", c AS (SELECT *, {chunking.SECTION_SIZE} - len(regexp_extract_all('[Section: ' || lang || ']' || chr(10), '[A-Za-z0-9]+|[^\\sA-Za-z0-9]')) AS size FROM t JOIN (SELECT doc_id AS d2, lang FROM documents) ON doc_id = d2)
SELECT doc_id, i::INTEGER AS chunk_no, md5(CASE WHEN whole THEN '[Section: ' || lang || ']' || chr(10) || text ELSE '[Section: ' || lang || ']' || chr(10) || array_to_string(t[i * (size - {chunking.SECTION_OVERLAP}) + 1 : i * (size - {chunking.SECTION_OVERLAP}) + size], ' ') END) AS digest
FROM (SELECT *, len(t) <= size AS whole, unnest(generate_series(0, CASE WHEN len(t) <= size THEN 0 ELSE ceil((len(t) - size) / (size - {chunking.SECTION_OVERLAP})::DOUBLE)::BIGINT END)) AS i FROM c)""")
def chunk_context_windows(spark, d):
    c = table(spark, d, "documents").where("text is not null and lang is not null")
    context = F.concat(F.lit("[Section: "), F.col("lang"), F.lit("]\n"))
    return c.select("doc_id", F.posexplode(chunking.split_in_section(context, F.col("text"))).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.md5(F.col("c").cast("binary")).alias("digest"))


def _pieces() -> tuple[str, ...]:
    """The vocabulary of a public model, from its file."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return subwords.vocabulary_of(f.read())


@named()
def subword_chunks(spark, d):
    """Every document in windows of 512 of a model's own tokens: how many, and the chunk that they make."""
    c = table(spark, d, "documents").select("doc_id", F.posexplode(subwords.split(F.col("text"), _pieces(), chunking.SIZE, chunking.OVERLAP, chunking.LEAST)).alias("chunk_no", "c"))
    return c.select("doc_id", "chunk_no", F.col("c.tokens").alias("n"), F.md5(F.col("c.chunk").cast("binary")).alias("digest"))


@named()
def subword_context_windows(spark, d):
    """Every document in windows of what its language's name, as a section's context, leaves of 384 model tokens."""
    context = F.concat(F.lit("[Section: "), F.coalesce("lang", F.lit("")), F.lit("]\n"))
    c = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.split_in_section(context, F.coalesce("text", F.lit("")), _pieces())).alias("chunk_no", "c"))
    return c.select("doc_id", "chunk_no", F.md5(F.col("c").cast("binary")).alias("digest"))


@named("SELECT id, CASE WHEN h = '' THEN 'text' " + " ".join(f"WHEN regexp_matches(lower(replace(h, ',', ' ')), '{'|'.join(v)}') THEN '{k}'" for k, v in vocab.TABLE_TYPES.items()) + f" ELSE 'generic' END AS kind FROM {ALL_TABLES} t")
def table_type(spark, d):
    r = headers(spark, d).withColumn("rows", F.when(F.col("h") == "", F.array().cast("array<array<string>>")).otherwise(F.array(F.split("h", ","))))
    return r.select("id", chunking.table_type(F.col("rows")).alias("kind"))


_TURNS = r"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations"


def _tables(spark: SparkSession, d: str, *head: str) -> DataFrame:
    """Conversations as tables, a turn a row: conv_id, rows."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    cells = {"Test": lambda t: F.array(t["text"])}.get(head[0], lambda t: F.array(t["role"], t["text"]))
    return c.select("conv_id", F.concat(F.array(F.array(*map(F.lit, head))), F.transform("t", cells)).alias("rows"))


@named(rf"""WITH RECURSIVE t AS (SELECT conv_id, i, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\sA-Za-z0-9]')) AS n FROM ({_TURNS})),
r AS (SELECT conv_id, i, 0 AS part, n AS used FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.i, CASE WHEN r.used + t.n > 120 THEN r.part + 1 ELSE r.part END, CASE WHEN r.used + t.n > 120 THEN t.n ELSE r.used + t.n END FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
SELECT conv_id, part, count(*)::INTEGER AS n, max(used)::INTEGER AS tokens FROM r GROUP BY conv_id, part""")
def lab_table_pack(spark, d):
    """Every conversation's turns as rows of a table, packed into parts of 120 tokens."""
    p = _tables(spark, d, "Test").select("conv_id", F.posexplode(chunking.packed_rows(F.col("rows"), F.lit(""), budget=120)).alias("part", "p"))
    tokens = F.aggregate("p", F.lit(0), lambda a, r: a + tx.token_count(chunking.row_text(r)))
    return p.select("conv_id", "part", F.size("p").alias("n"), tokens.alias("tokens"))


@named(f"SELECT conv_id, (i - 1)::INTEGER AS part, regexp_replace('[Section: M]' || chr(10) || 'Drug | Dose' || chr(10) || role || ' | ' || text, '^\\s+|\\s+$', '', 'g') AS chunk, 'medication' AS chunk_type FROM ({_TURNS})")
def medication_rows(spark, d):
    """Every conversation's turns as rows of a table of medications, a chunk a row."""
    c = _tables(spark, d, "Drug", "Dose").select("conv_id", F.posexplode(chunking.table_chunks(F.lit("[Section: M]\n"), F.col("rows"), F.lit(""))).alias("part", "c"))
    return c.select("conv_id", "part", tx.strip(F.col("c.chunk")).alias("chunk"), "c.chunk_type")


@named(rf"""WITH t AS (SELECT * FROM ({_TURNS})), c AS (SELECT conv_id, '| ' || string_agg(role || ' | ' || text, chr(10) ORDER BY i) AS md FROM t GROUP BY conv_id),
w AS (SELECT conv_id, md, '[Section: V]' || chr(10) || chr(10) || md AS whole FROM c)
SELECT conv_id, 0 AS part, md5(whole) AS digest, 'table' AS chunk_type FROM w WHERE len(regexp_extract_all(whole, '[A-Za-z0-9]+|[^\sA-Za-z0-9]')) <= {chunking.TABLE_SIZE}""")
def vital_tables(spark, d):
    """Every conversation as a table of vital signs, a chunk of its own where it fits."""
    t = _tables(spark, d, "BP", "HR").withColumn("md", F.concat(F.lit("| "), F.array_join(F.transform(F.slice("rows", 2, F.size("rows")), chunking.row_text), "\n")))
    c = t.select("conv_id", F.posexplode(chunking.table_chunks(F.lit("[Section: V]\n"), F.col("rows"), F.col("md"))).alias("part", "c")).where("c.chunk_type = 'table'")
    return c.select("conv_id", "part", F.md5(F.col("c.chunk").cast("binary")).alias("digest"), "c.chunk_type")


@named("SELECT id, len(list_filter(regexp_split_to_array(trim(h), '\\s+'), lambda x: x <> '')) > 15 AS kept FROM (SELECT * FROM (VALUES (1,'a b c d e f g h i j k l m n o'),(2,'a b c d e f g h i j k l m n o p'),(3,'')) v(id, h) UNION ALL " + MORE_HEADINGS + ") t")
def heading_gate(spark, d):
    return rows(spark, "VALUES (1,'a b c d e f g h i j k l m n o'),(2,'a b c d e f g h i j k l m n o p'),(3,'')", "id", "h").union(headings(spark, d).where("id > 100")).select("id", (F.size(tx.words(F.col("h"))) > chunking.HEADING_WORDS).alias("kept"))


@named(rf"SELECT conv_id AS id, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE x <> ''), '') AS ocr FROM (SELECT conv_id, i, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM ({_TURNS})) GROUP BY conv_id")
def ocr_concat(spark, d):
    """Every conversation's turns as the texts that were recognised in an image."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("o"))
    return c.select(F.col("conv_id").alias("id"), src.ocr_text(F.col("o")).alias("ocr"))


@named()
def page_chunks(spark, d):
    """Chunks of web pages, section by section."""
    return enrich.enriched(chunking.section_chunks(src.page_items(table(spark, d, "pages")))).select("job_id", "chunk_no", "chunk_type", "section_title", "section_type", joined("answer_types").alias("answer_types"), "chunk")


@named()
def udtf_chunks(spark, d):
    """The same by a chunker in Python, as a table function."""
    return enrich.enriched(chunkers.chunked(src.page_items(table(spark, d, "pages")))).select("job_id", "chunk_no", "chunk_type", "section_title", "section_type", joined("answer_types").alias("answer_types"), "chunk")


# ---- enrichment

_DOC_AND_ROWS = f"(SELECT doc_id AS id, text AS c FROM documents WHERE text IS NOT NULL UNION ALL SELECT -id, c FROM ({CHUNKS}) t(id, c))"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("chunk"))
    return docs.union(rows(spark, CHUNKS, "id", "c").select((-F.col("id")).cast("long"), "c"))


@named(f"SELECT id::BIGINT AS id, {_labels_sql('c', vocab.ANSWER_TYPES)} AS answer_types FROM {_DOC_AND_ROWS}")
def answer_types(spark, d):
    return enrich.answer_types(_texts(spark, d)).select("id", joined("answer_types").alias("answer_types"))


@named(f"SELECT id::BIGINT AS id, {_labels_sql('c', vocab.BACKFILL_ANSWER_TYPES)} AS answer_types FROM {_DOC_AND_ROWS}")
def answer_types_backfill(spark, d):
    return enrich.answer_types(_texts(spark, d), backfill=True).select("id", joined("answer_types").alias("answer_types"))


_UNIQ = "list_filter({h}, lambda x, i: list_position({h}, x) = i)"


def _entities_sql(source: str, c: str, patterns: dict[str, list[str]], names: list[str]) -> str:
    ctes = [f"h AS (SELECT id, {_types_sql(c, patterns)} FROM {source})"]
    cols = []
    for i, n in enumerate(names):
        u = _UNIQ.format(h=f"h{i}")
        earlier = " AND ".join(f"NOT list_contains(h{j}, y)" for j in range(i)) or "true"
        cols.append(f"array_to_string(list_filter({u}, lambda y: {earlier}), '|') AS {n}")
    return f"WITH {', '.join(ctes)} SELECT id, {', '.join(cols)} FROM h"


# a word that holds a letter or digit beyond ASCII is no entity: patterns are words of ASCII letters, bounded by what is no
# letter of any script; DuckDB bounds words by ASCII letters only, so such words go before it looks
_BEYOND = "[^\\x00-\\x7F\\PL]|[^\\x00-\\x7F\\P{{Nd}}]|[^\\x00-\\x7F\\P{{Mn}}]".replace("{{", "{").replace("}}", "}")
_ALL_TEXTS = f"(SELECT id, regexp_replace(c, '(?:[0-9A-Za-z_]|{_BEYOND})*(?:{_BEYOND})(?:[0-9A-Za-z_]|{_BEYOND})*', '·', 'g') AS c FROM (SELECT doc_id AS id, coalesce(text, '') AS c FROM documents UNION ALL SELECT -id, c FROM ({CHUNKS}) v(id, c)))"
_EXTRACTED = _entities_sql(_ALL_TEXTS, "c", vocab.CHUNK_ENTITIES, ["drugs", "diseases", "procedures"])


def _all_texts(spark: SparkSession, d: str) -> DataFrame:
    """All documents, whatever their script, those without text as empty ones; and the fixture rows under negative ids."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("chunk"))
    return docs.union(rows(spark, CHUNKS, "id", "c").select((-F.col("id")).cast("long"), "c"))


@named(_EXTRACTED)
def entity_extract(spark, d):
    """Entities of every document."""
    return enrich.entities(_all_texts(spark, d)).select("id", *[joined(n).alias(n) for n in ("drugs", "diseases", "procedures")])


@named(f"SELECT count(*)::BIGINT AS docs, sum(CASE WHEN drugs || diseases || procedures <> '' THEN 1 ELSE 0 END)::BIGINT AS with_entities, sum(CASE WHEN procedures <> '' THEN 1 ELSE 0 END)::BIGINT AS with_procedures FROM ({_EXTRACTED})")
def entity_stats(spark, d):
    e = enrich.entities(_all_texts(spark, d))
    return e.agg(F.count("*").alias("docs"), F.sum(F.col("has_medical_content").cast("long")).alias("with_entities"), F.sum((F.size("procedures") > 0).cast("long")).alias("with_procedures"))


for _name in ("entity_extract", "entity_stats"):
    QUERIES[f"{_name}_whole"], SQL[f"{_name}_whole"] = QUERIES[_name], SQL[_name]


@named(r"""WITH t AS (SELECT lang, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^\sA-Za-z0-9]')) AS n FROM documents)
SELECT lang, count(*)::BIGINT AS docs, round(avg(n), 2) AS mean_tokens, max(n)::INTEGER AS most_tokens, sum(CASE WHEN n = 0 THEN 0 ELSE 1 + greatest(0, ceil((n - 512) / 462.0)) END)::BIGINT AS windows FROM t GROUP BY lang""")
def corpus_stats(spark, d):
    t = table(spark, d, "documents").select("lang", tx.token_count(F.col("text")).alias("n"))
    return t.groupBy("lang").agg(F.count("*").alias("docs"), F.round(F.avg("n"), 2).alias("mean_tokens"), F.max("n").alias("most_tokens"), F.sum(F.when(F.col("n") > 0, 1 + F.greatest(F.lit(0), F.ceil((F.col("n") - 512) / 462))).otherwise(0)).cast("long").alias("windows"))


# ---- model entities

_NER = "VALUES (1,'metformin 500 mg twice a day was prescribed')"


#: Phrases, what a model says of them (text, type, begin, end, confidence), and what the steps make of that (text, type,
#: begin, end, confidence, normal form, related amount, related drug).
_PHRASES = {
    "metformin 500 mg twice a day was prescribed": (
        [("twice a day", "frequency", 17, 28, 0.85), ("metformin", "drug", 0, 9, 0.9), ("500", "strength", 10, 13, 0.8), ("mg", "dosage", 14, 16, 0.75), ("day", "duration", 25, 28, 0.2)],
        [("metformin", "drug", 0, 9, 0.9, "", "500 mg", ""), ("500 mg", "dosage", 10, 16, 0.75, "500mg", "", "metformin"), ("twice a day", "frequency", 17, 28, 0.85, "twice daily", "", "")],
    ),
    "history of HTN and aspirin": ([("HTN", "disease", 11, 14, 0.8), ("aspirin", "drug", 19, 26, 0.95)], [("HTN", "disease", 11, 14, 0.8, "hypertension", "", ""), ("aspirin", "drug", 19, 26, 0.95, "", "", "")]),
    "acet-minophen 5 mg": (
        [("acet", "drug", 0, 4, 0.9), ("minophen", "drug", 5, 13, 0.8), ("5 mg", "dosage", 14, 18, 0.9)],
        [("acet-minophen", "drug", 0, 13, 0.8, "", "5 mg", ""), ("5 mg", "dosage", 14, 18, 0.9, "5mg", "", "acet-minophen")],
    ),
}


def _ner(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of every conversation, followed by one of the phrases: id, text, and entities as a model would find them."""
    c = table(spark, d, "conversations").select((1000 * F.col("conv_id") + F.col("turn")).alias("id"), "turn", F.coalesce("text", F.lit("")).alias("own"))
    of = lambda found: F.array(*[ner.entity(F.lit(t), F.lit(k), F.length("own") + 1 + a, F.length("own") + 1 + b, F.lit(x)) for t, k, a, b, x in found]).cast(f"array<{ner.ENTITY}>")
    which = lambda values: F.when(F.col("turn") % 3 == 0, values[0]).when(F.col("turn") % 3 == 1, values[1]).otherwise(values[2])
    return c.select("id", "turn", F.concat("own", F.lit(" "), which([F.lit(p) for p in _PHRASES])).alias("text"), which([of(found) for found, _ in _PHRASES.values()]).alias("entities"))


_SPOKEN = "SELECT 1000 * conv_id + turn AS id, turn, coalesce(text, '') AS own, CASE turn % 3 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES)) + " END AS phrase FROM conversations"
_RAISED = "CASE " + " ".join(f"WHEN type = '{k}' AND regexp_matches(near, '{'|'.join(ws)}') THEN least(1.0, confidence * 1.1)" for k, ws in vocab.CONTEXT_WORDS.items()) + " ELSE confidence END"
_EXPECTED = (
    "WITH x(phrase, text, type, s, e, confidence, normalized, related_dosage, related_drug) AS (VALUES "
    + ", ".join(f"('{p}', '{t}', '{k}', {a}, {b}, {x}::DOUBLE, '{n}', '{m}', '{r}')" for p, (_, made) in _PHRASES.items() for t, k, a, b, x, n, m, r in made)
    + f"), y AS (SELECT id, turn, x.*, length(own) + 1 + s AS begins, length(own) + 1 + e AS ends, own || ' ' || phrase AS whole FROM ({_SPOKEN}) JOIN x USING (phrase)), z AS (SELECT *, lower(substr(whole, (greatest(begins - 50, 0) + 1)::BIGINT, (ends + 50 - greatest(begins - 50, 0))::BIGINT)) AS near FROM y) "
)


@named(_EXPECTED + f"SELECT id, text, type, begins::INTEGER AS s, ends::INTEGER AS e, round({_RAISED}, 4)::DOUBLE AS confidence, normalized, related_dosage, related_drug FROM z")
def ner_process(spark, d):
    """A model's entities in every turn of every conversation, after all steps."""
    e = ner.processed(_ner(spark, d)).select("id", F.explode("entities").alias("e"))
    meta = lambda k: F.coalesce(F.element_at("e.metadata", k), F.lit("")).alias(k)
    return e.select("id", "e.text", "e.type", F.col("e.start").alias("s"), F.col("e.end").alias("e"), F.round("e.confidence", 4).alias("confidence"), F.coalesce("e.normalized", F.lit("")).alias("normalized"), meta("related_dosage"), meta("related_drug"))


@named()
def ner_process_whole(spark, d):
    """The default model's entities of every document and of the fixture rows, after all steps."""
    texts = _all_texts(spark, d).union(rows(spark, _NER, "id", "t").select((-100 - F.col("id")).cast("long"), "t"))
    e = ner.processed(ner.lexicon(texts, "chunk"), "chunk").select("id", F.explode("entities").alias("e"))
    return e.select("id", "e.text", "e.type", F.col("e.start").alias("s"), F.col("e.end").alias("e"), F.round("e.confidence", 4).alias("confidence"), "e.normalized")


_TAGS = "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'B-' ELSE 'I-' END || upper(regexp_extract(coalesce(text, ''), '[A-Za-z]+', 0)) AS tag FROM documents"
_NAMED_TAGS = ", ".join(f"({-i - 1}, 'B-{k.upper()}')" for i, k in enumerate([*vocab.TAG_TYPES, "nothing"]))


@named(f"SELECT id, tag, CASE " + " ".join(f"WHEN contains(lower(tag), '{k}') THEN '{v}'" for k, v in vocab.TAG_TYPES.items()) + f" ELSE 'other' END AS kind FROM (SELECT * FROM (VALUES {_NAMED_TAGS}) t(id, tag) UNION ALL {_TAGS})")
def ner_tag_map(spark, d):
    """The types of all tags by name, and of tags made of the documents' first words."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.when(F.col("doc_id") % 2 == 0, "B-").otherwise("I-"), F.upper(F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0))).alias("tag"))
    t = rows(spark, f"VALUES {_NAMED_TAGS}", "id", "tag").union(t)
    return t.select("id", "tag", ner.tag_type(F.col("tag")).alias("kind"))


def _numbers():
    """A model that finds runs of digits."""
    import re

    return lambda texts: [[{"word": m[0], "entity_group": "B-DOSAGE", "start": m.start(), "end": m.end(), "score": 0.8} for m in re.finditer("[0-9]+", t)] for t in texts]


@named("SELECT doc_id AS id, len(regexp_extract_all(coalesce(text, ''), '[0-9]+'))::BIGINT AS n, coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda x: length(x))), 0)::BIGINT AS chars, true AS placed FROM documents")
def ner_batched(spark, d):
    """A batched model over every document, long ones in parts: whether all entities stand where their offsets say."""
    e = ner.batched(_numbers)(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), "text", "entities")
    placed = F.forall("entities", lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]) == x["text"])
    return e.select("id", F.size("entities").cast("long").alias("n"), F.aggregate("entities", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"])).alias("chars"), placed.alias("placed"))


@named(f"SELECT id::BIGINT AS id, true AS same FROM {_ALL_TEXTS}")
def entity_json(spark, d):
    """Whether the default model's entities of every document come back from JSON as they were."""
    e = ner.lexicon(_all_texts(spark, d), "chunk", "e").withColumn("back", ner.from_json(ner.to_json(F.col("e"))))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["text"], x["type"], x["start"], x["end"], x["confidence"], x["normalized"], F.size(x["synonyms"]), F.size(x["metadata"])))
    return e.select("id", plain("e").eqNullSafe(plain("back")).alias("same"))


@named(rf"SELECT qid, (i - 1)::INTEGER AS i, CASE lower(w) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.ENTITY_ABBREVIATIONS.items()) + rf" END AS normalized FROM (SELECT qid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT qid, list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> '') AS w FROM {ALL_QUESTIONS} t))")
def ner_abbrev(spark, d):
    """Every word of every question as an entity, spelled out where it is an abbreviation."""
    w = asked(spark, d).select("qid", F.posexplode(tx.words(F.col("query"))).alias("i", "t"))
    w = w.withColumn("e", F.array(ner.entity(F.col("t"), F.lit("drug"), F.lit(0), F.lit(3), F.lit(0.9))))
    return w.select("qid", "i", ner.abbreviations(F.col("e"))[0]["normalized"].alias("normalized"))


@named(_EXPECTED + "SELECT id, type, text AS texts FROM z")
def ner_summary(spark, d):
    """The texts of each type in every turn of every conversation."""
    e = ner.processed(_ner(spark, d)).select("id", F.explode(ner.summary(F.col("entities"))).alias("type", "t"))
    return e.select("id", "type", joined("t").alias("texts"))


@named(_EXPECTED + "SELECT id, count(*)::INTEGER AS n FROM z GROUP BY id")
def ner_unique(spark, d):
    """How many different entities every turn of every conversation has; they are there twice."""
    return ner.processed(_ner(spark, d)).select("id", F.size(ner.unique(F.concat("entities", "entities"))).alias("n"))


@named(f"SELECT id, array_to_string(list_sort((CASE turn % 3 WHEN 1 THEN ['definition', 'diagnosis'] ELSE ['definition', 'dosage'] END) || (CASE WHEN turn % 4 = 0 THEN ['treatment'] ELSE [] END)), '|') AS types FROM ({_SPOKEN}) UNION ALL SELECT -1, 'general'")
def ner_answer_types(spark, d):
    """What every turn of every conversation answers, by its entities and its section; and a text without any."""
    e = ner.processed(_ner(spark, d))
    kind = F.when(F.col("turn") % 4 == 0, "treatment")
    none = spark.range(1).select(F.lit(-1).cast("long").alias("id"), joined(ner.answer_types(F.array().cast(f"array<{ner.ENTITY}>"), F.lit(None).cast("string"))).alias("types"))
    return e.select("id", joined(ner.answer_types(F.col("entities"), kind)).alias("types")).union(none)


# ---- questions

def _questions(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).withColumn("embedding_types", F.lit(None).cast("array<string>"))


_CLEAN = r"regexp_replace(regexp_replace(trim(regexp_replace(query, '\s+', ' ', 'g')), '\s+([,.])', '\1', 'g'), '([,.])(\w)', '\1 \2', 'g')"


_LETTER = "(?:[^\\x00-\\x7F\\PL]|[^\\x00-\\x7F\\P{Nd}])"


def _rewrite_sql(c: str, table_: dict[str, str]) -> str:
    """Whole words replaced. DuckDB bounds words by ASCII letters only: a mark stands where these meet others meanwhile."""
    c = f"regexp_replace(regexp_replace({c}, '([0-9A-Za-z_])({_LETTER})', '\\1__Q__\\2', 'g'), '({_LETTER})([0-9A-Za-z_])', '\\1__Q__\\2', 'g')"
    for k, v in table_.items():
        c = f"regexp_replace({c}, '(?i)\\b{tx.quoted(k)}\\b', '{v}', 'g')"
    return f"replace({c}, '__Q__', '')"


@named(f"SELECT qid, {_CLEAN} AS cleaned FROM {ALL_QUESTIONS} t")
def query_clean(spark, d):
    return _questions(spark, d).select("qid", tx.cleaned(F.col("query")).alias("cleaned"))


@named(f"SELECT qid, {_rewrite_sql(_CLEAN, tx.longest_first(vocab.ABBREVIATIONS))} AS expanded FROM {ALL_QUESTIONS} t")
def abbrev_expand(spark, d):
    return _questions(spark, d).select("qid", tx.rewritten(tx.cleaned(F.col("query")), tx.longest_first(vocab.ABBREVIATIONS))[0].alias("expanded"))


@named(f"SELECT qid, {_rewrite_sql('query', vocab.MISSPELLINGS)} AS corrected FROM {ALL_QUESTIONS} t")
def misspell_fix(spark, d):
    return _questions(spark, d).select("qid", tx.rewritten(F.col("query"), vocab.MISSPELLINGS)[0].alias("corrected"))


_CLEANED = f"(SELECT qid AS id, {_rewrite_sql(_rewrite_sql(_CLEAN, tx.longest_first(vocab.ABBREVIATIONS)), vocab.MISSPELLINGS)} AS c FROM {ALL_QUESTIONS} t)"


@named(_entities_sql(_CLEANED, "c", vocab.QUERY_ENTITIES, list(vocab.QUERY_ENTITIES)).replace("SELECT id, array_to_string", "SELECT id AS qid, array_to_string"))
def query_entities(spark, d):
    e = query.analysed(_questions(spark, d))
    return e.select("qid", *[joined(F.transform(F.filter("entities", query._is(k)), lambda x: x["text"])).alias(k) for k in vocab.QUERY_ENTITIES])


_QUERY_ENTITIES = _entities_sql(_CLEANED, "c", vocab.QUERY_ENTITIES, list(vocab.QUERY_ENTITIES))


@named(" UNION ALL ".join(f"SELECT id AS qid, '{k}' AS type, {k} AS texts FROM ({_QUERY_ENTITIES}) WHERE {k} <> ''" for k in vocab.QUERY_ENTITIES))
def query_entities_by_type(spark, d):
    e = query.search_strategy(query.enhanced(_questions(spark, d)))
    return e.select("qid", F.explode("entities_by_type").alias("type", "texts")).select("qid", "type", joined("texts").alias("texts"))


@named(f"SELECT id AS qid, array_to_string(list_filter(list_distinct_(w), lambda x: regexp_matches(x, '^.{{3,}}({'|'.join(vocab.TERM_SUFFIXES)})$')), '|') AS terms FROM (SELECT id, regexp_split_to_array(lower(c), '\\s+') AS w FROM {_CLEANED})".replace("list_distinct_(w)", _UNIQ.format(h="w")))
def medical_terms(spark, d):
    return query.analysed(_questions(spark, d)).select("qid", joined("medical_terms").alias("terms"))


def _score_sql(intent: str) -> str:
    parts = [f"(CASE WHEN regexp_matches(lower(query), '{p}') THEN 1.0 ELSE 0.0 END)" for p in vocab.INTENT_PATTERNS[intent]]
    parts += [f"(CASE WHEN contains(lower(query), '{k}') THEN 0.5 ELSE 0.0 END)" for k in vocab.INTENT_KEYWORDS[intent]]
    return " + ".join(parts)


_SCORES = "WITH s AS (" + " UNION ALL ".join(f"SELECT qid, query, '{i}' AS intent, {n} AS o, ({_score_sql(i)})::DOUBLE AS score FROM {ALL_QUESTIONS} t" for n, i in enumerate(vocab.INTENT_PATTERNS)) + "), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, o) AS r FROM s)"


@named(_SCORES + " SELECT qid, intent, score FROM s")
def intent_scores(spark, d):
    return _questions(spark, d).select("qid", F.explode(query.intent_scores(F.col("query"))).alias("s")).select("qid", "s.intent", "s.score")


_PRIMARY = _SCORES + ", p AS (SELECT a.qid, a.intent AS i1, a.score AS s1, b.score AS s2 FROM r a JOIN r b ON a.qid = b.qid AND a.r = 1 AND b.r = 2), f AS (SELECT qid, CASE WHEN s1 > 0 THEN i1 ELSE 'general' END AS intent, CASE WHEN s1 <= 0 THEN 0.5 WHEN s2 > 0 THEN least(0.95, s1 / (s1 + s2)) ELSE least(0.95, s1 / 3) END AS confidence FROM p)"


@named(_PRIMARY + f" SELECT qid, intent, round(confidence, 4)::DOUBLE AS confidence, intent IN ({', '.join(repr(i) for i in vocab.SPECIFIC_SOURCE_INTENTS)}) AS specific FROM f")
def intent_primary(spark, d):
    return query.with_intent(_questions(spark, d)).select("qid", "intent", F.round("confidence", 4).alias("confidence"), F.col("requires_specific_source").alias("specific"))


@named(_SCORES + " SELECT r.qid, r.intent, round(r.score / greatest(a.score, 1.0), 4)::DOUBLE AS share FROM r JOIN r a ON a.qid = r.qid AND a.r = 1 WHERE r.r BETWEEN 2 AND 4 AND r.score > 0 AND a.score > 0")
def intent_secondary(spark, d):
    return query.with_intent(_questions(spark, d)).select("qid", F.explode("secondary").alias("s")).select("qid", "s.intent", F.round("s.share", 4).alias("share"))


@named(_PRIMARY + " SELECT s.*, count(qid)::BIGINT AS questions FROM (VALUES " + ", ".join(f"('{i}', '{'|'.join(c)}', {str(p).lower()}, {m}::DOUBLE)" for i, (c, p, m) in vocab.STRATEGIES.items()) + ") s(intent, chunk_types, precision_required, min_confidence) LEFT JOIN f ON f.intent = s.intent GROUP BY ALL")
def retrieval_strategy(spark, d):
    """The strategies, and how many of all questions each is for."""
    q = query.with_intent(_questions(spark, d)).groupBy("intent").agg(F.count("*").alias("questions"))
    s = query.strategies(spark).select("intent", joined("chunk_types").alias("chunk_types"), "precision_required", "min_confidence")
    return s.join(q, "intent", "left").withColumn("questions", F.coalesce("questions", F.lit(0).cast("long")))


@named(_PRIMARY + " SELECT qid, unnest(CASE WHEN qid % 5 = 0 THEN ['scibert'] WHEN confidence > 0.7 THEN ['pubmedbert'] ELSE ['pubmedbert', 'biobert'] END) AS embedding_type FROM f")
def embed_type_routing(spark, d):
    """The embedding types that each question goes to; every fifth one names its own."""
    q = query.with_intent(_questions(spark, d)).withColumn("embedding_types", F.when(F.col("qid") % 5 == 0, F.array(F.lit("scibert"))))
    return search.routed(q).select("qid", "embedding_type")


def _config_sql(n: int) -> str:
    return "CASE intent " + " ".join(f"WHEN '{i}' THEN '{'|'.join(v[n])}'" for i, v in vocab.INTENT_CONFIG.items()) + f" ELSE '{'|'.join(vocab.INTENT_CONFIG['general'][n])}' END"


@named(_PRIMARY + f" SELECT qid, {_config_sql(0)} AS answer_filter, {_config_sql(1)} AS boost_sections, CASE intent {' '.join(f"WHEN '{i}' THEN {w}" for i, w in vocab.BOOST_WEIGHTS.items())} ELSE {vocab.BOOST_WEIGHTS['general']} END::DOUBLE AS boost_weight FROM f")
def boost_params(spark, d):
    return query.enhanced(_questions(spark, d)).select("qid", joined("answer_filter").alias("answer_filter"), joined("boost_sections").alias("boost_sections"), "boost_weight")


@named(_PRIMARY + " SELECT qid, intent, coalesce(c.chunk_types, '') AS chunk_types, coalesce(c.min_confidence, 0.5)::DOUBLE AS min_confidence, intent IN (" + ", ".join(map(repr, vocab.SPECIFIC_SOURCE_INTENTS)) + ") AS authoritative FROM f LEFT JOIN (VALUES " + ", ".join(f"('{i}', '{'|'.join(c)}', {m})" for i, (c, _, m) in vocab.STRATEGIES.items()) + ") c(name, chunk_types, min_confidence) ON c.name = f.intent")
def query_strategies(spark, d):
    """What the library form of retrieval filters by, of each question."""
    m = query.metadata_filters(query.enhanced(_questions(spark, d)))
    return m.select("qid", "intent", F.coalesce(joined("metadata_filters.chunk_types"), F.lit("")).alias("chunk_types"), "metadata_filters.min_confidence", F.col("metadata_filters.require_authoritative_source").alias("authoritative"))


_SYNONYMS = "CASE x " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in vocab.SYNONYMS.items()) + " ELSE []::VARCHAR[] END"


def _forms_sql(kind: str) -> str:
    """Surface forms of a type's entities, in order, each once, for intents that filter by the type."""
    wanted = ", ".join(f"'{i}'" for i, v in vocab.INTENT_CONFIG.items() if kind in v[2])
    forms = f"flatten(list_transform(list_filter(string_split({kind}, '|'), lambda x: x <> ''), lambda x: [x] || {_SYNONYMS}))"
    low = f"list_transform({forms}, lambda x: lower(x))"
    return f"CASE WHEN intent IN ({wanted}) THEN array_to_string({_UNIQ.format(h=low)}, '|') ELSE '' END AS {query.PLURAL[kind]}"


@named(f"SELECT f.qid, {', '.join(map(_forms_sql, query.PLURAL))} FROM ({_PRIMARY} SELECT qid, intent FROM f) f JOIN ({_QUERY_ENTITIES}) e ON e.id = f.qid")
def entity_filters(spark, d):
    """What each question filters by: all forms of its entities of the intent's types."""
    return query.enhanced(_questions(spark, d)).select("qid", *[joined(n).alias(n) for n in query.PLURAL.values()])


@named()
def search_variants(spark, d):
    """All texts that each question is searched by."""
    return query.enhanced(_questions(spark, d)).select("qid", joined("search_texts").alias("texts"))


@named()
def enhanced_queries(spark, d):
    e = query.metadata_filters(query.rewrites(query.search_strategy(query.enhanced(_questions(spark, d)))))
    return e.select("qid", "cleaned", "intent", joined("rewrites").alias("rewrites"), "use_entity_filtering", "metadata_filters.min_confidence", joined("metadata_filters.chunk_types").alias("chunk_types"))


# ---- store

@named("SELECT a.doc_id FROM documents a WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.doc_id)")
def dedup_anti_join(spark, d):
    key = lambda df: df.select("doc_id", F.col("doc_id").cast("string").alias("title"), F.lit("DOCUMENT").alias("type"), F.lit(None).cast("string").alias("date"), F.lit("f").alias("original_filename"))
    return store.new_documents(key(table(spark, d, "documents")), key(table(spark, d, "labels").select("doc_id"))).select("doc_id")


@named("SELECT doc_id, sha256(doc_id::VARCHAR || '|DOCUMENT||f|pubmedbert|0') AS id FROM documents")
def point_ids(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("title"), F.lit("DOCUMENT").alias("type"), F.lit(None).cast("string").alias("date"), F.lit("f").alias("original_filename"), F.lit("pubmedbert").alias("embedding_type"), F.lit(0).alias("chunk_no"))
    return c.select("doc_id", store.point_id().alias("id"))


@named(f"WITH l AS (SELECT DISTINCT doc_id FROM labels) SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'kept' ELSE {_labels_sql('d.text', vocab.BACKFILL_ANSWER_TYPES)} END AS answer_types FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL")
def backfill_missing(spark, d):
    have = table(spark, d, "labels").select("doc_id").distinct().withColumn("_have", F.lit(True))
    p = table(spark, d, "documents").where("text is not null").join(have, "doc_id", "left")
    none = F.array().cast("array<string>")
    p = p.select(F.col("doc_id").alias("id"), "text", F.when(F.col("_have"), F.array(F.lit("kept"))).otherwise(none).alias("answer_types"), none.alias("medical_entities"), none.alias("entity_types"), F.lit(None).cast("string").alias("boost_section"), F.lit(None).cast("string").alias("section_type"))
    return enrich.backfilled(p).select(F.col("id").alias("doc_id"), joined("answer_types").alias("answer_types"))


def _as_points(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents as points, by doc_id, with whatever fields of a point they have."""
    have = {f.split(" ")[0]: f.split(" ", 1)[1] for f in store.POINT.split(", ")}
    return docs.select(*[(F.col(n) if n in docs.columns else F.lit(None)).cast(t).alias(n) for n, t in have.items()])


def _own_table(spark: SparkSession, made: Callable[[str], DataFrame]) -> DataFrame:
    """What ``made`` makes with a collections' table of its own, which is dropped after it."""
    name = f"points_{uuid.uuid4().hex}"
    try:
        store.create(spark, name)
        return store.materialised(made(name))
    finally:
        for t in (name, f"{name}_ids", f"{name}_filters", f"{name}_done"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


@named("SELECT 1 AS batch, count(*)::BIGINT AS asked, count(*)::BIGINT AS added FROM documents WHERE lang = 'en' UNION ALL SELECT 2, count(*)::BIGINT, count(*) FILTER (WHERE lang IS DISTINCT FROM 'en')::BIGINT FROM documents")
def ledger_batches(spark, d):
    """The English documents' points into a table, then those of all documents: what each batch asked for and added."""

    def made(name):
        p = _as_points(spark, table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.lit("biobert").alias("embedding_type"), F.col("lang").alias("type")))
        added = [ledger.upsert(p.where("type = 'en'"), name), ledger.upsert(p, name)]
        return spark.createDataFrame([(i + 1, x["asked"], x["added"]) for i, x in enumerate(added)], "batch int, asked long, added long")

    return _own_table(spark, made)


@named(SQL["backfill_missing"])
def backfill_resumed(spark, d):
    """The same in a table, by a run that stops after one partition and another that goes on."""

    def made(name):
        have = table(spark, d, "labels").select("doc_id").distinct().withColumn("_have", F.lit(True))
        p = table(spark, d, "documents").where("text is not null").join(have, "doc_id", "left")
        kind = F.when(F.col("lang") == "en", "biobert").otherwise("pubmedbert")
        p = p.select(F.col("doc_id").cast("string").alias("id"), "text", kind.alias("embedding_type"), F.when(F.col("_have"), F.array(F.lit("kept"))).alias("answer_types"))
        _as_points(spark, p).write.insertInto(name)
        backfill.resumed(spark, name, f"{name}_done", limit=1)
        backfill.resumed(spark, name, f"{name}_done")
        return spark.read.table(name).select(F.col("id").cast("long").alias("doc_id"), joined("answer_types").alias("answer_types"))

    return _own_table(spark, made)


# ---- ranking and answers

_BM25 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9]+|[^\sA-Za-z0-9]') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
u AS (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM u GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+|[^\sA-Za-z0-9]')) AS term FROM benchmark)),
x AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS sc FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(sc, 6) DESC, doc_id) AS r FROM x)
SELECT item_id AS qid, doc_id AS id, round(sc, 3) AS score, r::INTEGER AS rank FROM r WHERE r <= 5
"""


@named(_BM25)
def bm25_search(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return inverted.bm25_search(q, docs, 5).select("qid", "id", F.round("score", 3).alias("score"), "rank")


_CONV = rf"""WITH t AS (SELECT conv_id, i, regexp_extract_all(lower(text), '[A-Za-z0-9]+|[^\sA-Za-z0-9]') AS w FROM ({_TURNS})),
q AS (SELECT DISTINCT conv_id, unnest(w) AS term FROM t WHERE i = 1),
s AS (SELECT conv_id, count(*) AS n, greatest(avg(len(w)), 1e-9) AS mean FROM t GROUP BY conv_id),
tf AS (SELECT conv_id, i, l, term, count(*) AS tf FROM (SELECT conv_id, i, len(w) AS l, unnest(w) AS term FROM t) GROUP BY ALL),
m AS (SELECT tf.*, count(*) OVER (PARTITION BY tf.conv_id, tf.term) AS df FROM tf JOIN q USING (conv_id, term)),
x AS (SELECT conv_id, i, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS sc FROM m JOIN s USING (conv_id) GROUP BY conv_id, i)
SELECT t.conv_id AS qid, t.i AS id, round(coalesce(sc, 0), 4) AS score, row_number() OVER (PARTITION BY t.conv_id ORDER BY round(coalesce(sc, 0), 9) DESC, t.i)::INTEGER AS position FROM t LEFT JOIN x USING (conv_id, i)"""


@named(_CONV)
def bm25_rerank(spark, d):
    """Every conversation's turns, reranked by what its first turn says."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.row_number().over(w).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.first(F.coalesce("text", F.lit(""))).over(w).alias("rerank_query")).withColumn("position", F.col("id"))
    score = lambda x: rerank.bm25(x).withColumn("rerank_score", F.round("rerank_score", 9))
    return rerank.reranked(c, score, None).select("qid", "id", F.round("rerank_score", 4).alias("score"), F.col("rerank_position").alias("position"))


@named(f"SELECT conv_id AS qid, string_agg(text, ' ' ORDER BY i) FILTER (WHERE i <= 3) AS query FROM ({_TURNS}) GROUP BY conv_id")
def rerank_query_text(spark, d):
    """What candidates are reranked by, of every conversation's turns as one question's texts."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return c.select(F.col("conv_id").alias("qid"), rerank.rerank_text(F.col("t.text")).alias("query"))


_OVERLAP = _BM25.replace("AS sc FROM q", "AS sc, count(*) AS shared FROM q").split("SELECT item_id AS qid")[0]


@named(_OVERLAP + ", p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, r) AS p FROM r WHERE r <= 10) SELECT item_id AS qid, doc_id AS id, shared::DOUBLE AS score, p::INTEGER AS position FROM p WHERE p <= 5")
def pair_rerank(spark, d):
    """The ten best documents for each benchmark item, reranked by a model of pairs that counts shared words."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    c = inverted.bm25_search(q, docs, 10).join(docs, "id").join(q, "qid").select("qid", "id", "text", F.col("rank").alias("position"), F.col("query").alias("rerank_query"))
    return rerank.reranked(c, rerank.pairwise(_shared_words), 5).select("qid", "id", F.col("rerank_score").alias("score"), F.col("rerank_position").alias("position"))


def _shared_words():
    """A model of pairs that counts the words that both have."""
    import re

    words = lambda t: {*re.findall(tx.TOKEN, t.lower())}
    return lambda pairs: [len(words(a) & words(b)) for a, b in pairs]


@named("SELECT conv_id AS qid, string_agg('<Context_' || n || '>' || chr(10) || text || chr(10) || '</Context_' || n || '>', chr(10) || chr(10) ORDER BY n) AS contexts FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def context_assembly(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("id"), "text", (F.col("turn") + 1).cast("int").alias("rerank_position"))
    return answer.contexts(c).select("qid", F.col("context_text").alias("contexts"))


_CITED_SQL = rf"""WITH t AS (SELECT conv_id, i, text, (i * 7) % 5 + 1 AS cites FROM ({_TURNS}) WHERE NOT contains(text, '^[')), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k FROM t)
SELECT conv_id AS qid, string_agg(text || '^[' || k || ']', ' ' ORDER BY k) AS answer, string_agg('Context_' || cites, '|' ORDER BY k) AS refs,
  string_agg(CASE WHEN cites <= 3 THEN 'source ' || cites ELSE 'Original context Context_' || cites || ' not found' END, '|' ORDER BY k) AS sources FROM o GROUP BY conv_id"""


@named(_CITED_SQL)
def citation_renumber(spark, d):
    """Every conversation's turns as an answer, each followed by a citation of one of five contexts, of which three are there."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select("conv_id", F.row_number().over(w).alias("i"), F.coalesce("text", F.lit("")).alias("text")).where(~F.col("text").contains("^["))
    t = t.groupBy(F.col("conv_id").alias("qid")).agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("t"))
    raw = F.array_join(F.transform("t", lambda x: F.concat(x["text"], F.lit("^[Context_"), ((x["i"] * 7) % 5 + 1).cast("string"), F.lit("]"))), " ")
    c = F.array(*[F.struct(F.lit(n).alias("no"), F.lit(f"source {n}").alias("text"), F.lit(str(n)).alias("id")) for n in (1, 2, 3)])
    a = answer.cited(t.select("qid", raw.alias("raw_answer")).withColumn("contexts", c))
    return a.select("qid", "answer", joined(F.transform("cited", lambda x: x["references_original_context"])).alias("refs"), joined(F.transform("cited", lambda x: F.coalesce(x["source"]["text"], x["error"]))).alias("sources"))


@named(f"SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN '- Item ' || item_id || ' is used. ^[1]' ELSE '{answer.NO_HITS}' END AS answer FROM benchmark")
def no_hit_response(spark, d):
    """Every benchmark item as a question; for every second one nothing was found."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    ranked = q.where("qid % 2 = 0").select("qid", F.lit("p").alias("id"), F.concat(F.lit("Item "), F.col("qid").cast("string"), F.lit(" is used. "), F.coalesce("query", F.lit(""))).alias("text"), F.lit(1).alias("rerank_position"))
    return answer.answered(q, ranked).select("qid", "answer")


def _stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents with text, as points of one collection, stored before they are searched."""
    docs = table(spark, d, "documents").where("text is not null")
    c = docs.select(F.col("doc_id").cast("string").alias("job_id"), F.posexplode(chunking.split_plain(F.col("text"))).alias("chunk_no", "chunk")).withColumn("section_type", F.lit(None).cast("string"))
    c = enrich.enriched(c).withColumns({"embedding_type": F.lit("pubmedbert"), "id": F.concat_ws("-", "job_id", "chunk_no"), "text": F.col("chunk")})
    return store.materialised(embed.embedded(c))


def _benchmark_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("query"), F.array(F.lit("pubmedbert")).alias("embedding_types"))


_BUCKETED = r"list_transform(list_transform(range(64), lambda b: len(list_filter(bs, lambda x: x = b))::DOUBLE), lambda n: (n / sqrt(list_sum(list_transform(range(64), lambda b: (len(list_filter(bs, lambda x: x = b)) * len(list_filter(bs, lambda x: x = b)))::DOUBLE))))::FLOAT::DOUBLE)"
_BUCKETS_OF = r"list_transform(regexp_extract_all(lower({0}), '[A-Za-z0-9]+|[^\sA-Za-z0-9]'), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64)"
_WINDOWS = SQL["chunk_generic"].rpartition("SELECT doc_id, i::INTEGER AS chunk_no")[0]


@named(_WINDOWS + f""", c AS (SELECT doc_id || '-' || i AS id, {_BUCKETS_OF.format("array_to_string(w, ' ')")} AS bs FROM m),
cv AS (SELECT id, {_BUCKETED} AS v FROM c),
b AS (SELECT id - 1000 AS qid, {_BUCKETS_OF.format('c')} AS bs FROM {_CLEANED} WHERE id BETWEEN 1000 AND 999999),
qv AS (SELECT qid, {_BUCKETED} AS v FROM b WHERE len(bs) > 0),
x AS (SELECT qid, id, list_dot_product(qv.v, cv.v) / (sqrt(list_dot_product(qv.v, qv.v)) * sqrt(list_dot_product(cv.v, cv.v))) AS sc FROM qv, cv),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, id) AS r FROM x)
SELECT qid::BIGINT AS qid, id, round(sc, 4) AS score FROM r WHERE r <= 10""")
def retrieve_hits(spark, d):
    """What the retrieval plan finds for benchmark items as questions, over chunks of all documents."""
    _, found = retrieve.hits(_benchmark_questions(spark, d), _stored_chunks(spark, d), 10, "boost_only")
    return found.select("qid", "id", F.round("original_score", 4).alias("score"))


@named()
def retrieve_answers(spark, d):
    """The whole retrieval plan: benchmark items as questions over chunks of all documents."""
    out = retrieve.retrieve(_benchmark_questions(spark, d), _stored_chunks(spark, d), 10, "boost_only")
    return out.select("qid", "answer", "intent", F.size("cited").alias("citations"), joined("searched").alias("searched"))


@named("SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY event_type")
def event_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@named(_TOKENS + f""", n AS (SELECT doc_id, len(t)::BIGINT AS n FROM t WHERE len(t) > 0),
w AS (SELECT doc_id, n, CASE WHEN n <= {chunking.SIZE} THEN 1 ELSE 1 + ceil((n - {chunking.SIZE}) / {chunking.SIZE - chunking.OVERLAP}.0)::BIGINT END AS w FROM n)
SELECT 'pubmedbert' AS embedding_type, sum(CASE WHEN w > 1 AND n - (w - 1) * {chunking.SIZE - chunking.OVERLAP} < {chunking.LEAST} THEN w - 1 ELSE w END)::BIGINT AS points, count(*)::BIGINT AS documents FROM w""")
def stream_ingest(spark, d):
    """Documents through the streaming plan into a collections' table: points stored by embedding type."""
    from .streaming.replay import replayed

    return replayed(spark, table(spark, d, "documents"))


@named("SELECT doc_id::VARCHAR AS job_id, (CASE WHEN doc_id % 10 = 3 THEN 0 ELSE 1 END)::INTEGER AS n_pages, CASE WHEN doc_id % 10 = 3 THEN 'no JSON' ELSE md5(coalesce(text, '')) END AS digest FROM documents")
def parsed_source(spark, d):
    """Documents through files, every tenth one spoilt, and the data source that reads them."""
    from .streaming.replay import as_parsed

    path = store.folder(spark)
    p = as_parsed(table(spark, d, "documents"))
    p.select(F.when(F.col("job_id").endswith("3"), F.concat(F.lit('{"job_id": "'), "job_id")).otherwise(F.to_json(F.struct("job_id", "pages"))).alias("value")).write.text(path)
    good, bad = parsed.documents(parsed.read(spark, path), src.PARSED)
    good = good.select("job_id", F.size("pages").alias("n_pages"), F.md5(F.col("pages")[0]["text"].cast("binary")).alias("digest"))
    return good.union(bad.select(F.substring("document", 13, 20), F.lit(0), "rejected"))


@named(SQL["stream_ingest"].replace("count(*)::BIGINT AS documents FROM w", "count(*)::BIGINT AS documents, (SELECT count(*) FROM documents)::BIGINT AS passed FROM w"))
def stream_distinct(spark, d):
    """The streaming plan with every file there twice: points and documents as with each once."""
    from .streaming.replay import replayed_twice

    return replayed_twice(spark, table(spark, d, "documents"))


@named("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
