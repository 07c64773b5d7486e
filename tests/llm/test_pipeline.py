"""The pipeline's stages over small tables, each against what it has to do."""

import hashlib
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, brute, edited, prose

from sparkquarry.llm import bpe, linededup, mixing, toxicity
from sparkquarry.llm.common import written

STAGE = dict(corpus_pipeline.STAGES)


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, d))
        seen.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.join(before.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert seen[0] > seen[1] > 0 and seen[2] <= seen[1] and seen[3] <= seen[2] and seen[4] == seen[5]
    assert corpus_pipeline.run(spark, d).count() == seen[5]


def without_repeated_lines(texts):
    """Windows by hand, over {doc_id: text}: three lines, or one or two of 50 words, that came before."""
    first, windows = {}, []
    for i in sorted(texts):
        lines = [(n, x.strip("\t\x0b\x0c\r ")) for n, x in enumerate((texts[i] or "").split("\n"))]
        lines = [x for x in lines if x[1]]
        for k in range(len(lines)):
            for n in (1, 2, 3):
                w = lines[k : k + n]
                if len(w) == n and (n == 3 or sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for _, x in w) >= 50):
                    key, place = (n, tuple(x for _, x in w)), (i, w[0][0])
                    windows.append((key, place, w[-1][0]))
                    first[key] = min(first.get(key, place), place)
    covered = {(i, n) for key, (i, a), b in windows if first[key] != (i, a) for n in range(a, b + 1)}
    out = {}
    for i, t in texts.items():
        kept = [x for n, x in enumerate((t or "").split("\n")) if (i, n) not in covered]
        if t is None or len(kept) == len(t.split("\n")) or "".join(kept).strip():
            out[i] = None if t is None else "\n".join(kept)
    return out


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A table of rows that are odd in some way, and its labels."""
    bad = "vilequ scornfa wretchx"
    passage = "\n".join(prose(900 + i, 12) for i in range(5))
    texts = [prose(i, 20 + i % 60) + (f" {bad}" if i % 9 == 0 else "") for i in range(120)]
    texts += [None, "", " \n\t", "word", prose(700, 25_000)] + [f"{prose(800 + i, 30)}\n{passage}\n{prose(850 + i, 30)}" for i in range(6)]
    texts += [edited(i, prose(5, 150), 3) for i in range(12)] + [prose(5, 150)] * 3 + [prose(6, 60) + "\n" + prose(7, 55)] * 2
    rows = [(i, t, "en" if i % 5 else None, ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, DOCS).withColumns({"rank": F.lit("x"), "_plan": F.lit(1), "score": F.lit(2.0), "component": F.lit("c"), "kept": F.lit(False)})
    docs.write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(bad in (t or ""))) for i, t in enumerate(texts) if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{d}/labels.parquet")
    return d, spark.read.parquet(f"{d}/documents.parquet"), dict(enumerate(texts)), bad


def plain(spark, texts):
    return spark.createDataFrame([(i, t, "en", ["a", "b", None][(i or 0) % 3], len(t or "")) for i, t in texts], DOCS).withColumn("text_", F.lit(1)).withColumn("id", F.lit("x"))


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_rejecting_toxic_documents(spark, odd):
    d, docs, texts, bad = odd
    kept = by_id(STAGE["toxicity"](spark, docs, d))
    # what the scorer says of each row, by the score that test_scores_by_brute_force works out by hand
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    assert kept == {i: t for i, t in texts.items() if scores[i] < 0.5}
    assert sum(bad in (t or "") for t in kept.values()) <= 1 and len(kept) >= len(texts) - 15 and {120, 121, 122, 123, 124} <= {*kept}


def test_dropping_repeated_lines(spark, odd):
    d, docs, texts, _ = odd
    assert by_id(STAGE["line_dedup"](spark, docs, d)) == without_repeated_lines(texts)
    # rows that share id and text are one document, null ids come first
    t = "\n".join(prose(i, 9) for i in range(4))
    got = sorted(((r.doc_id, r.text) for r in linededup.dedup(plain(spark, [(4, t), (4, t), (None, t), (9, t), (2, "x" * 200_000 + "\n" + t)])).collect()), key=str)
    assert got == sorted([(None, t), (2, "x" * 200_000), (4, ""), (4, ""), (9, "")], key=str)


def test_keeping_one_of_each_group(spark, odd):
    d, docs, texts, _ = odd
    want = {i for i, (_, c) in brute(texts).items() if i == c}
    assert by_id(STAGE["minhash_near_dedup"](spark, docs, d)) == {i: texts[i] for i in want}


def test_mixing_what_is_left(spark, odd):
    d, docs, texts, _ = odd
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    out = STAGE["mix_sources"](spark, docs, d).collect()
    took = {r.doc_id: r for r in mixing.taken(docs).collect()}
    held = {}
    for r in out:
        words = iter(split(texts[r.doc_id]))
        assert all(w in words for w in split(r.text)) and r.n_chars == len(r.text)  # pieces of the text, in order
        held[r.doc_id] = held.get(r.doc_id, 0) + len(split(r.text))
    assert held == {i: r.taken for i, r in took.items() if r.taken} and all(r.taken <= 3 * r["size"] == 3 * len(split(texts[i])) for i, r in took.items())
    # targets by hand: level by level, the excess of sources at their limit goes to the others by weight
    sizes = {s: sum(len(split(t)) for i, t in texts.items() if i % 3 == n) for n, s in enumerate(["a", "b", None])}
    weights, target, left = dict(zip(["a", "b", None], (5, 2, 1))), {}, {*sizes}
    while left:
        rest, total = sum(sizes.values()) - sum(target.values()), sum(weights[s] for s in left)
        over = [s for s in left if rest * weights[s] / total > 3 * sizes[s]]
        target |= {s: 3 * sizes[s] for s in over} if over else {s: rest * weights[s] / total for s in left}
        left = left - {*over} if over else set()
    for s, n in sizes.items():
        own = [r for i, r in took.items() if ["a", "b", None][i % 3] == s]
        assert all(r.source_size == n and abs(r.target - target[s]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 3 * mixing.BLOCK


def test_encoding_what_is_mixed(spark, odd):
    from tokenizers import Tokenizer

    d, docs, texts, _ = odd
    library = Tokenizer.from_file(bpe.default_path())
    for r in STAGE["bpe"](spark, docs, d).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_all_stages_on_odd_and_on_empty_tables(spark, odd, tmp_path):
    d, docs, texts, _ = odd
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} <= {*texts}
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    repeated = plain(spark, [(1, prose(1, 50)), (1, prose(1, 50)), (1, prose(2, 50)), (None, prose(3, 50)), (None, prose(3, 50)), (None, None)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, repeated, d).collect()
        # equal texts and texts of one id are a group: two stay, and the row without text
        assert len(out) == 3 if name == "minhash_near_dedup" else len(out) >= 1, name
