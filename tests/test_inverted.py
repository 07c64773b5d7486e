"""BM25 by inverted lists against summing every posting."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sparkquarry.functions.text import tokens
from sparkquarry.operators import inverted, rerank
from sparkquarry.sources.store import folder


def scores(questions, docs):
    words = {i: re.findall(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]", t.lower()) for i, t in docs if t is not None}
    mean = sum(map(len, words.values())) / max(len(words), 1)
    df = Counter(w for ws in words.values() for w in {*ws})
    counts, out = {i: Counter(ws) for i, ws in words.items()}, {}
    for q, text in questions:
        for i, c in counts.items():
            s = [math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(words[i]) / mean)) for w in {*re.findall(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]", (text or "").lower())} if c[w]]
            if s:
                out[q, i] = sum(s)
    return out


def first(found, k):
    by = {}
    for (q, i), s in found.items():
        by.setdefault(q, []).append((-round(s, 6), i))
    return {(q, i, n + 1) for q, rows in by.items() for n, (_, i) in enumerate(sorted(rows)[:k])}


def corpus(seed, n):
    r = random.Random(seed)
    common, rare = ["the", "of", ",", "and"], [f"w{i}" for i in range(400)]
    return [(i, " ".join(r.choices(common + rare, weights=[400] * 4 + [4000 / (k + 5) for k in range(400)], k=r.randint(1, 80)))) for i in range(n)]


def test_hits_equal_summing_everything(spark):
    docs = [*corpus(1, 700), (900, None), (901, ""), (902, "   "), (903, "w7 w7 w7"), (904, "w7 w7 w7"), (905, "W7, w399")]
    r = random.Random(2)
    questions = [*[(q, " ".join(["the", ","] + r.choices([f"w{i}" for i in range(400)], k=1 + q % 25))) for q in range(30)], (30, None), (31, ""), (32, "nowhere"), (33, "the the of , and"), (34, "w399"), (35, docs[11][1])]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(questions, "qid long, query string")
    want = scores(questions, docs)
    path = folder(spark)
    inverted.index(d, path)
    for k in (1, 5, 2000):
        got = inverted.search(q, path, k).collect()
        assert {(x.qid, x.id, x["rank"]) for x in got} == first(want, k)
        assert all(abs(x.score - want[x.qid, x.id]) < 1e-9 for x in got)
    assert {(x.qid, x.id, x["rank"]) for x in inverted.bm25_search(q, d, 5).collect()} == first(want, 5)
    # what meets is a small part of what would meet without bounds
    tables = inverted.rounds(q, path, 1)
    met = sum(t.count() for n, t in tables.items() if n.startswith(("seeds", "met_", "looked_up_")))
    assert met < 0.5 * len([1 for _ in d.select("id", F.explode(F.array_distinct(tokens(F.lower("text")))).alias("term")).join(tables["asked"], "term").collect()])
    assert inverted.bm25_search(q, d.limit(0), 5).count() == inverted.bm25_search(q.limit(0), d, 5).count() == 0


def test_rerank_scores_by_brute_force(spark):
    docs = corpus(3, 60) + [(61, ""), (62, None)]
    questions = {1: "w1 w2 the w5, w5", 2: "", 3: "nowhere"}
    rows = [(q, i, t, n, text) for q, text in questions.items() for n, (i, t) in enumerate(docs) if (i + q) % 2]
    c = spark.createDataFrame(rows, "qid long, id long, text string, position int, rerank_query string")
    got = {(x.qid, x.id): x.rerank_score for x in rerank.bm25(c).collect()}
    assert len(got) == len(rows)
    for q, text in questions.items():
        want = scores([(q, text)], [(i, t or "") for i, t in docs if (i + q) % 2])
        assert all(abs(got[q, i] - want.get((q, i), 0)) < 1e-9 for i, _ in docs if (i + q) % 2)


def test_terms_are_counted_without_moving_rows(spark, tmp_path):
    d = spark.createDataFrame([(1, "A a b, 𝒳 ä x"), (2, "")], "id long, text string")
    rows = d.mapInArrow(inverted._counted, "id long, len int, term string, tf long")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.where("id = 2").collect())) == [(2, 0, "", 1)]
    low = d.where("id = 1").selectExpr("id", "lower(text) AS text")
    words = [w for r in low.select(tokens(F.col("text"))).collect() for w in r[0]]
    want = sorted([(1, len(words), w, words.count(w)) for w in {*words}] + [(1, len(words), "", 1)])
    assert sorted(map(tuple, low.mapInArrow(inverted._counted, "id long, len int, term string, tf long").collect())) == want
